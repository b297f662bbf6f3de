"""Grading replies as their files arrive.

The text rules keep no state, so they run on a stream as they are. This is the append sink of reply
tables in its resumable form: Spark's checkpoint remembers which files have been graded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quizlake.functions.compare import answer_status


def append_graded(
    replies: DataFrame,
    path: str,
    checkpoint: str,
    extractor: Callable[[Column], Column],
    response: str = "response",
) -> StreamingQuery:
    """Grade every reply not yet graded and append it to ``path``; stops when it has caught up.

    ``replies`` is a streaming DataFrame; ``checkpoint`` must lie on shared storage.
    """
    text = F.col(response)
    graded = replies.withColumn("answer", extractor(text)).withColumn(
        "status", answer_status(text, F.col("answer"))
    )
    writer = graded.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

from pyspark.sql import functions as F

from quizlake.functions.extract import last_letter
from quizlake.streaming.replies import append_graded


def test_new_files_are_graded_once(spark, tmp_path):
    source, sink, marks = (str(tmp_path / name) for name in ("in", "out", "marks"))
    schema = "response_id long, response string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def catch_up():
        stream = spark.readStream.schema(schema).parquet(source)
        append_graded(stream, sink, marks, last_letter).awaitTermination(120)
        return spark.read.parquet(sink).orderBy("response_id").select("response_id", "answer", "status").collect()

    arrive([(1, "Answer: A"), (2, "hm")])
    assert [tuple(r) for r in catch_up()] == [(1, "A", "answered"), (2, None, "unparsed")]
    assert len(catch_up()) == 2
    arrive([(3, None)])
    assert [tuple(r) for r in catch_up()][2] == (3, None, "pending")
    assert spark.read.parquet(sink).where(F.col("response_id") < 3).count() == 2

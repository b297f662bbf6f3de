"""Rows laid out once in seeded order, and taken from there a stretch at a time.

Ranking is a pass over all rows; whoever takes rows in many rounds should not repeat it. A ledger
writes the lowest rows by seeded hash in slabs, each four times what was asked for or twice as long as
all before it, as Parquet in folders of rank ranges. A stretch reads the folders of its ranges and no
others. Nothing is laid out that no round comes near.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.operators.sampling import sample_uniform
from quizlake.session import scratch_path

#: Least ranks in a folder, and most folders of a slab.
_WIDTH, _FOLDERS = 1_000, 1_000


@dataclass(frozen=True)
class _Slab:
    """Ranks above ``first`` up to ``last`` in folders of ``width`` ranks."""

    path: str
    first: int
    last: int
    width: int


class RankLedger:
    """The rows of ``df`` by rank in the order of ``sample_uniform``; ``df`` must stay the same."""

    def __init__(self, df: DataFrame, key: str, seed: int) -> None:
        self._df, self._key, self._seed = df, key, seed
        self._slabs: list[_Slab] = []
        self._cursor, self._ended = 0, False

    def _laid(self) -> int:
        return self._slabs[-1].last if self._slabs else 0

    def _lay(self, wanted: int) -> None:
        first = self._laid()
        size = max(4 * wanted, 2 * first)
        width = max(_WIDTH, -(-size // _FOLDERS))
        rows = sample_uniform(self._df, first + size, self._key, self._seed, rank="_rank").where(F.col("_rank") > first)
        path = scratch_path(self._df.sparkSession, "ledger")
        # A folder's rows come together, so that it is one file unless it is large.
        placed = rows.withColumn("_range", F.floor((F.col("_rank") - 1) / width)).hint("rebalance", "_range")
        placed.write.partitionBy("_range").parquet(path)
        found = self._df.sparkSession.read.schema(placed.schema).parquet(path).count()
        self._ended = found < size
        if found:
            self._slabs.append(_Slab(path, first, first + found, width))

    def take(self, n: int) -> DataFrame | None:
        """The next ``n`` rows, fewer at the end, None after it."""
        start, end = self._cursor, self._cursor + n
        while self._laid() < end and not self._ended:
            self._lay(end - self._laid())
        end = min(end, self._laid())
        if end <= start:
            return None
        self._cursor = end
        out = None
        for slab in self._slabs:
            low, high = max(start, slab.first), min(end, slab.last)
            if low < high:
                rows = self._df.sparkSession.read.parquet(slab.path)
                rows = rows.where(F.col("_range").between(low // slab.width, (high - 1) // slab.width) & F.col("_rank").between(low + 1, high))
                rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self._df.schema])
                out = rows if out is None else out.unionByName(rows)
        return out

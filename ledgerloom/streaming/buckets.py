"""Sums of stretches of blocks that are kept up delivery by delivery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from ..sources.ledger import Ledger
from .settlement import _new


class BlockBuckets:
    """Tumbling stretches of `width` blocks. A delivery folds its own rows and adds them to the buckets that it touches; all others stay as written.

    Buckets lie in partitions of `per` of them. A commit names, for every folder, the partitions that are live in it, so a delivery
    reads and writes only its own partitions and a reader finds each bucket once. Rows and the number of the delivery become visible
    together: one that comes again changes nothing. Rows of buckets that were complete are added like any others. Rows without a
    block share the bucket NULL. A commit lists as many partitions as the blocks fill: their range / (width * per).

    `sums` are added up; first_block and last_block are the ends of what a bucket holds. Table: buckets (bucket, keys, rows, sums, first_block, last_block).
    """

    TABLE = "buckets"

    def __init__(self, ledger: Ledger, block: str, width: int = 20_000, *, per: int = 64, keys: tuple[str, ...] = (), sums: dict[str, Column] | None = None):
        if width < 1 or per < 1:
            raise ValueError("width and per must be at least 1")
        self.ledger, self.block, self.width, self.per, self.keys = ledger, block, width, per, list(keys)
        self.sums = {"rows": F.count(F.lit(1))} | (sums or {})

    def fold(self, rows: DataFrame) -> DataFrame:
        """The buckets of rows by themselves, with the partition `part` of each."""
        bucket = F.floor(F.col(self.block) / self.width).cast("bigint").alias("bucket")
        ends = [F.min(self.block).alias("first_block"), F.max(self.block).alias("last_block")]
        folded = rows.groupBy(bucket, *self.keys).agg(*[c.alias(n) for n, c in self.sums.items()], *ends)
        return folded.withColumn("part", F.floor(F.col("bucket") / self.per).cast("bigint"))

    def _stored(self, state: dict, parts: list | None = None) -> list[DataFrame]:
        """Live rows of every folder, of these partitions only if any are named. The names become partition filters."""
        found = []
        for entry in state["tables"].get(self.TABLE, []):
            named = [p for p in entry["parts"] if parts is None or p in parts]
            if named:
                numbers = [p for p in named if p is not None]
                inside = F.col("part").isin(numbers) if numbers else F.lit(False)
                found.append(self.ledger._rows(self.TABLE, [entry]).filter(inside | F.col("part").isNull() if None in named else inside))
        return found

    def sink(self, batch: DataFrame, number: int) -> None:
        base = _new(self.ledger, number)
        if base is None:
            return
        fresh = settle(self.fold(batch), "buckets")
        parts = [r[0] for r in fresh.select("part").distinct().collect()]
        if not parts:
            self.ledger.publish(base, {}, cursor=number)
            return
        merged = reduce(DataFrame.unionByName, [fresh, *self._stored(base, parts)]).groupBy("part", "bucket", *self.keys).agg(
            *[F.sum(n).cast(fresh.schema[n].dataType).alias(n) for n in self.sums], F.min("first_block").alias("first_block"), F.max("last_block").alias("last_block")
        )
        entry = self.ledger.write(merged.select(*fresh.columns).repartition("part"), self.TABLE, "part", parts=parts)
        kept = [e | {"parts": left} for e in base["tables"].get(self.TABLE, []) if (left := [p for p in e["parts"] if p not in parts])]
        self.ledger.publish(base, {self.TABLE: [*kept, entry]}, cursor=number)

    def read(self) -> DataFrame | None:
        """All buckets, or None before the first delivery."""
        found = self._stored(self.ledger.state())
        return reduce(DataFrame.unionByName, found).drop("part") if found else None

"""Top-k, dedupe and paging. Every rank takes a unique tie key, so results do not depend on row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top rows; each task keeps only its own best k before the merge."""
    return df.orderBy(*order).limit(k)


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame, computed before any trim, to every row."""
    names = totals.columns
    one = totals.select(F.struct(*names).alias("t")).scalar()
    # One projection: a second one on top of a sort and a limit would turn the top-k into a full sort.
    return df.select(*df.columns, *[one[n].alias(n) for n in names])


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int | None, rank: str = "rank"
) -> DataFrame:
    """First n rows per group. The limit runs before the shuffle too, so a hot group stays small."""
    window = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window))
    if n is not None:
        ranked = ranked.filter(F.col(rank) <= n)
    return ranked.withColumn(rank, F.col(rank).cast("bigint"))


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One defined winner per key."""
    return top_per_group(df, keys, order, 1, "__rank").drop("__rank")


def top_or_rest(totals: DataFrame, key: str, value: str, n: int, rest: str) -> DataFrame:
    """The n largest keys of an aggregated frame and one row for all others."""
    best = totals.orderBy(F.desc(value), F.asc(key)).limit(n).select(F.col(key).alias("__top"))
    marked = totals.join(best, F.col(key).eqNullSafe(F.col("__top")), "left")
    name = F.when(F.col("__top").isNotNull(), F.col(key)).otherwise(F.lit(rest))
    sums = [F.sum(c).alias(c) for c in totals.columns if c != key]
    return marked.groupBy(name.alias(key)).agg(*sums, F.count(F.lit(1)).alias("members"))


def page_after(df: DataFrame, keys: Sequence[tuple[str, str]], after: Sequence[object] | None, size: int) -> DataFrame:
    """One page of a list sorted by `keys` (name, asc|desc), starting behind the last row already seen."""
    order = [F.desc(c) if way == "desc" else F.asc(c) for c, way in keys]
    if after is not None:
        behind = F.lit(False)
        equal = F.lit(True)
        for (name, way), seen in zip(keys, after, strict=True):
            ahead = F.col(name) < F.lit(seen) if way == "desc" else F.col(name) > F.lit(seen)
            behind = behind | (equal & ahead)
            equal = equal & (F.col(name) == F.lit(seen))
        df = df.filter(behind)
    return df.orderBy(*order).limit(size)

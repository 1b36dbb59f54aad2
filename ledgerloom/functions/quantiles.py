"""Exact order statistics by counting, spread out for a hot key.

`percentile` and `median` keep every distinct value of a group in one buffer. Here values fall into cells whose order is that of the
values, and cells are counted: first by binary exponent and a part of the mantissa, then, where a wanted rank still has more than
ORDERED values around it, in equal cells between the smallest and the largest of those. Only what is left at the end is put in order, so a
key with a third of all rows leaves no task more than that. All of it is plain hash aggregation; the answer is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: Values of a key that may be put in order together, and cells of a later round.
ORDERED, CELLS = 4096, 4096


def _first_cell(v: Column) -> Column:
    """A 64th of a binary order of magnitude, numbered in the order of the values: logarithms never run against it."""
    step = F.floor(F.greatest(F.least(F.log2(F.abs(v)), F.lit(1100.0)), F.lit(-1100.0)) * 64) + 100_000
    return F.when(F.isnan(v), F.lit(1_000_000).cast("long")).when(v > 0, step).when(v < 0, -step).otherwise(F.lit(0).cast("long"))


def _later_cell(v: Column) -> Column:
    wide = F.col("__hi") / 2 - F.col("__lo") / 2
    return F.when(wide > 0, F.floor((v / 2 - F.col("__lo") / 2) / wide * CELLS)).otherwise(F.lit(0).cast("long"))


BRACKET = ["n", "__name", "__below", "__held", "__lo", "__hi"]


def _bracket(counts: DataFrame, keys: list[str], ranks: dict[str, Column], named: bool) -> DataFrame:
    """One row a key and rank: between which values the rank lies, how many there are, and how many below. One cell holds a rank."""
    every = Window.partitionBy(*keys, *(["__name"] if named else []))
    placed = counts.withColumn("__cum", F.col("__below") + F.sum("__m").over(every.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)))
    if not named:
        placed = placed.withColumn("n", F.sum("__m").over(every)).withColumn("__name", F.explode(F.array(*[F.lit(name) for name in ranks])))
    rank = _by_name(ranks)
    around = placed.filter((F.col("__cum") >= rank) & (F.col("__cum") - F.col("__m") < rank))
    return around.select(*keys, "n", "__name", (F.col("__cum") - F.col("__m")).alias("__below"), F.col("__m").alias("__held"), "__lo", "__hi")


def _by_name(ranks: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.col("__name") == name, rank.cast("long")) for name, rank in ranks.items()])


def exact_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """One row per key: `n` values and, per name, the value at a 1-based rank.

    `ranks` are expressions over `n`, such as the two middle ranks for a median. NULL values and NULL keys are left out.
    The frame is read once to count and once for the values around the ranks; further rounds read only those. Each round splits what is
    around a rank as long as its values differ, so rounds end.
    """
    known = df.filter(F.col(value).isNotNull())
    for key in keys:
        known = known.filter(F.col(key).isNotNull())
    whole = not keys
    keys = list(keys) or ["__all"]
    rows = (known.withColumn("__all", F.lit(0)) if whole else known).select(*keys, value, F.col(value).cast("double").alias("__v"))
    cells = lambda frame, more: frame.groupBy(*keys, *more, "__cell").agg(F.count(F.lit(1)).alias("__m"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    counts = settle(cells(rows.withColumn("__cell", _first_cell(F.col("__v"))), []), "value-cells")
    bracket = settle(_bracket(counts.withColumn("__below", F.lit(0).cast("long")), keys, ranks, False), "rank-bracket")
    inside = (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
    kept = _within(rows, bracket, keys, whole).filter(inside)
    wide = (F.col("__held") > ORDERED) & (F.col("__lo") < F.col("__hi")) & ~F.isnan("__hi")
    while not bracket.filter(wide).isEmpty():
        kept = settle(kept.select(*keys, value, "__v", *BRACKET), "rank-values")
        counts = cells(kept.withColumn("__cell", F.when(wide, _later_cell(F.col("__v"))).otherwise(F.lit(0).cast("long"))), ["n", "__name", "__below"])
        bracket = settle(_bracket(counts, keys, ranks, True), "rank-bracket")
        narrowed = bracket.withColumnsRenamed({c: f"{c}_" for c in BRACKET[2:]})
        kept = kept.join(narrowed, [*keys, "n", "__name"]).select(*keys, value, "__v", "n", "__name", *[F.col(f"{c}_").alias(c) for c in BRACKET[2:]]).filter(inside)
    ordered = kept.groupBy(*keys, "n", "__name", "__below", value).agg(F.count(F.lit(1)).alias("__m"))
    order = Window.partitionBy(*keys, "__name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    reached = ordered.withColumn("__cum", F.col("__below") + F.sum("__m").over(order)).filter(F.col("__cum") >= _by_name(ranks))
    picks = [F.min(F.when(F.col("__name") == name, F.col(value))).alias(name) for name in ranks]
    return reached.groupBy(*keys, "n").agg(*picks).select(*([] if whole else keys), "n", *ranks)


def _within(rows: DataFrame, bracket: DataFrame, keys: list[str], whole: bool) -> DataFrame:
    """Rows with the brackets of their key; those of all rows together are a row a rank and become literals."""
    if not whole:
        return rows.join(bracket.select(*keys, *BRACKET), keys)
    found = [F.struct(*[F.lit(r[c]).cast(bracket.schema[c].dataType).alias(c) for c in BRACKET]) for r in bracket.collect()]
    if not found:
        found = [F.struct(*[F.lit(None).cast(bracket.schema[c].dataType).alias(c) for c in BRACKET])]
    return rows.select("*", F.inline(F.array(*found)))


def counted_ranks(counts: DataFrame, value: str, times: str, ranks: dict[str, Column]) -> DataFrame:
    """One row: the value at each 1-based rank, an expression over `n`, of values given as (value, times), one row a value.

    For values that repeat, such as whole days: the order is over the different values only. NULL values are left out.
    """
    known = counts.filter(F.col(value).isNotNull())
    cumulative = F.sum(times).over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = known.select(value, cumulative.alias("__cum"), F.sum(times).over(Window.partitionBy()).alias("n"))
    return placed.agg(*[F.min(F.when(F.col("__cum") >= rank, F.col(value))).alias(name) for name, rank in ranks.items()])


def middles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Lower and upper middle value per key."""
    return exact_ranks(df, keys, value, {"lower": F.expr("(n + 1) div 2"), "upper": F.expr("n div 2 + 1")})


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Element n>>1 of the sorted values, per key, with the number of values."""
    return exact_ranks(df, keys, value, {name: F.expr("n div 2 + 1")})


def mean_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Mean of the two middle values, per key."""
    both = middles(df, keys, value)
    mean = (F.col("lower").cast("double") + F.col("upper").cast("double")) / 2
    return both.select(*keys, "n", mean.alias(name))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, at: float, name: str) -> DataFrame:
    """Smallest value with at least the fraction `at` of the values at or below it."""
    return exact_ranks(df, keys, value, {name: F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(at)))})

"""Ordered computations that a hot key cannot pile into one task.

The order is cut into stretches: of fixed width, or of about equal numbers of rows. Each stretch is its own window; what a
stretch inherits from the earlier ones comes from a frame with one row per stretch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def stretch_of(position: str, width: int | None):
    return F.col("__s") if width is None else F.floor(F.col(position) / width).cast("bigint")


def in_stretches(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The frame with its stretch `__s`: ranges of the order with about as many rows each, one for a shuffle partition.

    Written once, so that the ranges stay what they are. The order must tell all rows apart; a position with very many
    rows is then cut as well.
    """
    ranged = df.repartitionByRange(*order)
    return settle(ranged.withColumn("__s", F.spark_partition_id().cast("bigint")), "stretches")


def previous_in_order(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], carried: Sequence[str], width: int | None, step: str = "step"
) -> DataFrame:
    """Per row: its 1-based position in the key's order, and the `carried` columns of the row before it.

    `order` is unique within a key; its first column is the integer that is cut into stretches of `width`. Without
    a width the frame brings its stretches along, as `in_stretches` gives them.
    Adds `step` and `previous_<column>`.
    """
    keys = list(keys)
    order = [order] if isinstance(order, str) else list(order)
    rows = df.withColumn("__s", stretch_of(order[0], width))
    last_of = F.struct(*[F.col(c) for c in carried])
    stretches = rows.groupBy(*keys, "__s").agg(
        F.count(F.lit(1)).alias("__n"), F.max_by(last_of, F.struct(*order)).alias("__last")
    )
    across = Window.partitionBy(*keys).orderBy("__s")
    carry = stretches.select(
        *keys,
        "__s",
        F.coalesce(
            F.sum("__n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
        F.lag("__last").over(across).alias("__carry"),
    )
    inside = Window.partitionBy(*keys, "__s").orderBy(*order)
    out = (
        rows.withColumn("__rn", F.row_number().over(inside))
        .withColumn("__prev", F.lag(last_of).over(inside))
        .join(carry, [*keys, "__s"])
    )
    previous = F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col("__prev"))
    return out.withColumn("__p", previous).select(
        *df.columns,
        (F.col("__before") + F.col("__rn")).alias(step),
        *[F.col("__p")[c].alias(f"previous_{c}") for c in carried],
    )


def running_max(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], value: str, width: int | None, name: str) -> DataFrame:
    """Largest `value` up to and including each row of the key's order, NULLs left out."""
    keys = list(keys)
    order = [order] if isinstance(order, str) else list(order)
    rows = df.withColumn("__s", stretch_of(order[0], width))
    across = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, "__s").agg(F.max(value).alias("__m")).select(*keys, "__s", F.max("__m").over(across).alias("__carry"))
    inside = Window.partitionBy(*keys, "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__here", F.max(value).over(inside)).join(carry, [*keys, "__s"])
    return out.select(*df.columns, F.greatest("__here", "__carry").alias(name))

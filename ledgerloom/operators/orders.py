"""Orders with fills: filters, drill-down rows, page summaries, address profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.ordered import previous_in_order
from ..functions.quantiles import upper_median
from ..session import settle
from .ranking import with_totals
from .swaps import ranked_text


def drill_down(
    orders: DataFrame,
    fills: DataFrame,
    address: str | None = None,
    source: str | None = None,
    status: str | None = None,
    day: str | None = None,
) -> DataFrame:
    """Orders matching every stated condition. An address counts as trader or as filler, in any letter case."""
    out = orders
    if source is not None:
        out = out.filter(F.col("source") == source)
    if status is not None:
        out = out.filter(F.col("status") == status)
    if day is not None:
        out = out.filter(F.col("day") == F.lit(day).cast("date"))
    if address is not None:
        wanted = address.lower()
        filled = fills.filter(F.lower("filler") == wanted).select("order_id").distinct().withColumn("__hit", F.lit(True))
        out = out.join(filled, "order_id", "left")
        out = out.filter((F.lower("trader") == wanted) | F.col("__hit")).drop("__hit")
    return out


def drill_rows(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """One row per order with its first fill, latency in days, delivered rate and counts."""
    sent, got = F.col("side") == "in", F.col("side") == "out"
    first = F.min_by(F.when(got, F.struct("at", "filler", "chain")), F.when(got, F.struct("at", "fill_key")))
    folded = fills.groupBy("order_id").agg(
        F.count_if(got).alias("fills"),
        F.count_if(sent).alias("inputs"),
        F.sum(F.when(sent, F.col("amount").cast("decimal(28,6)"))).alias("amount_in"),
        F.sum(F.when(got, F.col("amount").cast("decimal(28,6)"))).alias("amount_out"),
        first.alias("first_fill"),
    )
    rate = F.when(F.col("amount_in") > 0, S.dbl(F.col("amount_out")) / S.dbl(F.col("amount_in")))
    return orders.join(folded, "order_id", "left").select(
        "order_id",
        "trader",
        "source",
        "status",
        "day",
        F.coalesce("fills", F.lit(0)).alias("fills"),
        F.coalesce("inputs", F.lit(0)).alias("inputs"),
        F.col("first_fill.filler").alias("first_filler"),
        F.datediff("first_fill.at", "day").cast("bigint").alias("latency_days"),
        rate.alias("implied_rate"),
        (F.col("first_fill.chain") != F.col("source")).alias("cross_chain"),
    )


def page_summary(rows: DataFrame) -> DataFrame:
    """One row over a page of orders; the latency median is the upper middle one."""
    rows = settle(rows.select("usd", "fee_usd", "trader", "filler", "status", "latency"), "order-page")
    median = upper_median(rows, [], "latency", "median_latency").select("median_latency")
    totals = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        S.sum_or_zero(F.col("usd")).alias("usd"),
        F.count_if(F.col("usd").isNull()).alias("unpriced"),
        S.sum_or_zero(F.col("fee_usd").cast("decimal(18,6)")).alias("fee_usd"),
        F.countDistinct("trader").alias("traders"),
        F.countDistinct("filler").alias("fillers"),
        F.count_if(F.col("status") == "FILLED").alias("filled"),
        F.count_if(F.col("status") == "REFUNDED").alias("refunded"),
        F.count_if(F.col("status").isNull()).alias("without_status"),
    )
    out = with_totals(totals, median)
    return out.withColumn("usd", S.dbl(F.col("usd"))).withColumn("fee_usd", S.dbl(F.col("fee_usd")))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of rows per value of each column, NULL shown as 'unrecorded'."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("unrecorded")).alias("value"))
                for c in columns
            ]
        )
    )
    return df.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def address_profiles(placed: DataFrame, filled: DataFrame) -> DataFrame:
    """Both roles of every address at once: orders placed with dollars, and orders filled as a count only."""
    as_trader = placed.groupBy(F.col("trader").alias("address")).agg(
        F.count(F.lit(1)).alias("placed"),
        S.sum_or_zero(F.col("usd")).alias("placed_usd"),
        F.count_if(F.col("usd").isNull()).alias("placed_unpriced"),
        F.count_if("failed").alias("placed_refunded"),
        F.min("day").alias("placed_first"),
        F.max("day").alias("placed_last"),
    )
    chains = placed.groupBy(F.col("trader").alias("address"), "chain").agg(F.count(F.lit(1)).alias("n"))
    mix = ranked_text(chains, "address", "chain", "n", F.col("n").cast("string"), None, "placed_chains")
    # Orders, not fills: one order filled twice by an address counts once.
    as_filler = (
        filled.select(F.col("filler").alias("address"), "order_id").distinct()
        .groupBy("address").agg(F.count(F.lit(1)).alias("filled"))
    )
    return (
        as_trader.join(mix, "address", "left")
        .join(as_filler, "address", "full_outer")
        .select(
            "address",
            F.coalesce("placed", F.lit(0)).alias("placed"),
            F.coalesce("filled", F.lit(0)).alias("filled"),
            S.dbl(F.coalesce("placed_usd", F.lit(0))).alias("placed_usd"),
            F.coalesce("placed_unpriced", F.lit(0)).alias("placed_unpriced"),
            F.coalesce("placed_refunded", F.lit(0)).alias("placed_refunded"),
            "placed_first",
            "placed_last",
            "placed_chains",
        )
    )


def volume_comparison(trades: DataFrame, multiplier: int = 2000) -> DataFrame:
    """Own order sum beside the fee-implied volume and the source's own figure."""
    fee, theirs = F.col("fee_usd").cast("decimal(18,6)"), F.col("indexer_usd").cast(S.MONEY)
    sums = trades.agg(
        S.sum_or_zero(F.col("usd")).alias("order_sum"),
        S.sum_or_zero(fee).alias("dust_usd"),
        F.count(fee).alias("priced_fees"),
        F.count_if(fee.isNull()).alias("unpriced_fees"),
        S.sum_or_zero(theirs).alias("indexer_usd"),
        F.count(theirs).alias("indexer_priced"),
        F.count_if(theirs.isNull()).alias("indexer_zero"),
    )
    return sums.select(
        S.dbl(F.col("order_sum")).alias("order_sum"),
        S.dbl(F.col("dust_usd")).alias("dust_usd"),
        S.dbl(F.col("dust_usd") * multiplier).alias("headline_usd"),
        "priced_fees",
        "unpriced_fees",
        S.dbl(F.col("indexer_usd")).alias("indexer_usd"),
        "indexer_priced",
        "indexer_zero",
    )


def timeline(steps: DataFrame, order: str, at: str, label: str, width: int = 100_000) -> DataFrame:
    """Status steps of each order in time order, as numbered rows with the step before."""
    numbered = previous_in_order(steps.select(order, at, label), [order], at, [label], width)
    return numbered.select(order, at, label, "step", F.col(f"previous_{label}").alias("previous"))


def order_ends(placed: DataFrame, fills: DataFrame) -> DataFrame:
    """How far each order came: placed, filled, redeemed or refunded, the last of these that any of its fills reached.

    placed(order_id, placed_at), fills(order_id, filled_at, end), end NULL while nothing has followed. Orders without fills stay.
    """
    folded = fills.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("fills"),
        F.min("filled_at").alias("first_fill"),
        F.count_if(F.col("end") == "refunded").alias("__refunded"),
        F.count_if(F.col("end") == "redeemed").alias("__redeemed"),
    )
    state = F.when(F.col("__refunded") > 0, "refunded").when(F.col("__redeemed") > 0, "redeemed").when(F.col("fills") > 0, "filled").otherwise("placed")
    return placed.join(folded, "order_id", "left").select(
        "order_id",
        F.coalesce("fills", F.lit(0)).alias("fills"),
        state.alias("state"),
        (F.unix_seconds("first_fill") - F.unix_seconds("placed_at")).alias("first_latency_s"),
    )

"""Balance frames: legs, closes of day, cohorts, supply reconciliation, archived observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import upper_median
from ..session import settle
from .ranking import top_k, top_per_group, with_totals

RAW = "decimal(38,0)"


def two_legs(frames: DataFrame, keys: Sequence[str], first: str, second: str, amount: str) -> DataFrame:
    """Both legs of each account side by side; a leg nobody read stays NULL, an account without legs is absent."""
    leg = lambda name: F.sum(F.when(F.col("leg") == name, F.col(amount))).alias(name)
    return frames.filter(F.col("leg").isin(first, second)).groupBy(*keys).agg(leg(first), leg(second)).withColumn(
        "total", F.coalesce(F.col(first), F.lit(0)) + F.coalesce(F.col(second), F.lit(0))
    )


def day_with_dust(rows: DataFrame, day: str, ident: str, legs: Sequence[str], floor: object, cap: int = 40) -> DataFrame:
    """Rows at or above the floor and among the day's first `cap`; all others in one dust row per day.

    Dust is the day's total minus what was kept, so no day is ever ranked beyond its first rows.
    """
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in legs]
    kept = top_per_group(rows.filter(F.col("total") >= F.lit(floor)), [day], [F.desc("total"), F.asc(ident)], cap, "rank")
    whole = rows.groupBy(day).agg(F.count(F.lit(1)).alias("n"), *sums)
    held = kept.groupBy(day).agg(F.count(F.lit(1)).alias("k"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"k_{c}") for c in legs])
    rest = whole.join(held, day, "left").select(
        day,
        F.lit(None).cast(rows.schema[ident].dataType).alias(ident),
        *[(F.col(c) - F.coalesce(F.col(f"k_{c}"), F.lit(0))).alias(c) for c in legs],
        (F.col("n") - F.coalesce(F.col("k"), F.lit(0))).alias("members"),
        F.lit("dust").alias("bucket"),
    )
    shown = kept.select(day, ident, *[F.col(c) for c in legs], F.lit(1).cast("bigint").alias("members"), F.lit("kept").alias("bucket"))
    return shown.unionByName(rest)


def cohort_days(rows: DataFrame, cohort: DataFrame, day: str, ident: str, legs: Sequence[str]) -> DataFrame:
    """Per day over the cohort's accounts: sums per leg, accounts holding anything, sum of the ten largest."""
    held = rows.join(cohort.select(ident), ident, "left_semi")
    best = top_per_group(held, [day], [F.desc("total"), F.asc(ident)], 10).groupBy(day).agg(F.sum("total").alias("top_ten"))
    days = held.groupBy(day).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in legs],
        F.sum("total").alias("total"),
        F.count_if(F.col("total") > 0).alias("nonzero"),
    )
    return days.join(best, day, "left")


def cohort_holders(rows: DataFrame, cohort: DataFrame, day: str, ident: str, legs: Sequence[str]) -> DataFrame:
    """What each account of the cohort holds on a day, by leg: long rows, nothing where nothing is held."""
    held = rows.join(cohort.select(ident), ident, "left_semi")
    pairs = F.array(*[F.struct(F.lit(c).alias("leg"), F.col(c).alias("amount")) for c in legs])
    return held.select(day, ident, F.inline(pairs)).filter(F.col("amount") != 0)


def archive_addresses(obs: DataFrame, threshold: object) -> DataFrame:
    """Per address: final balance (highest block), peak, first and last day, observations; small finals left out."""
    rows = obs.groupBy("address").agg(
        F.max_by("balance", "block").alias("last"),
        F.max("balance").alias("peak"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count(F.lit(1)).alias("observations"),
    )
    return rows.filter(F.col("last") > F.lit(threshold))


def day_closes(obs: DataFrame, key: str = "address") -> DataFrame:
    """Last observation of each key and day."""
    return obs.groupBy(key, "day").agg(F.max_by("balance", "block").alias("balance"))


def clipped_peaks(obs: DataFrame, key: str = "address") -> DataFrame:
    """How much of a key's true peak the day closes miss."""
    days = obs.groupBy(key, "day").agg(F.max("balance").alias("top"), F.max_by("balance", "block").alias("close"))
    folded = days.groupBy(key).agg(F.max("top").alias("peak"), F.max("close").alias("daily_peak"))
    part = F.when(F.col("peak") == 0, F.lit(0.0)).otherwise(
        (F.col("peak").cast("double") - F.col("daily_peak").cast("double")) / F.col("peak").cast("double")
    )
    return folded.withColumn("clipped", part)


def close_of_day(blocks: DataFrame, chain: str, day: str, height: str, at: str) -> DataFrame:
    """The last block inside each UTC day; a day without a block is absent."""
    return blocks.groupBy(chain, day).agg(F.max(height).alias(height), F.max_by(at, height).alias(at))


def day_ranges(blocks: DataFrame, chain: str, day: str, height: str) -> DataFrame:
    """First block of each day and the half-open range up to the next day's first block (open at the head)."""
    first = blocks.groupBy(chain, day).agg(F.min(height).alias("from_block"))
    window = Window.partitionBy(chain).orderBy(day)
    return first.withColumn("to_block", F.lead("from_block").over(window))


def sticky_ids(rows: DataFrame, ident: str, day: str) -> DataFrame:
    """Every id stays enumerated from its first appearance to the last day of all rows: an interval for each id."""
    last = rows.agg(F.max(day).alias("last")).scalar()
    return rows.groupBy(ident).agg(F.min(day).alias("first_seen")).withColumn("listed_until", last)


def largest_before(series: DataFrame, day: str, value: str, event_day: str) -> DataFrame:
    """Largest holding before an event day, and its share of what all days' largest holding reached."""
    cut = F.lit(event_day).cast("date")
    before = F.col(day) < cut
    best = F.max_by(F.when(before, F.struct(day, value)), F.when(before, F.struct(F.col(value), -F.unix_date(day))))
    return series.agg(best.alias("b"), F.max(value).alias("all_time"), F.count_if(before).alias("days_before")).select(
        F.col(f"b.{day}").alias("day"),
        F.col(f"b.{value}").alias("largest"),
        F.try_divide(F.col(f"b.{value}").cast("double"), F.col("all_time").cast("double")).alias("share"),
        "days_before",
    )


def archive_pairs(mine: DataFrame, archived: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of both series, compared on the first leg only."""
    both = archived.select(*keys, F.col("value").alias("archived")).filter("archived IS NOT NULL").join(
        mine.filter("relay IS NOT NULL"), list(keys)
    )
    a, m = F.col("archived").cast("double"), F.col("relay").cast("double")
    deviation = F.when(F.col("archived") == 0, F.when(F.col("relay") == 0, 0.0).otherwise(1.0)).otherwise(F.abs(m - a) / a)
    return both.withColumn("deviation", deviation).withColumn("gap", F.abs(F.col("relay") - F.col("archived")))


def archive_scores(pairs: DataFrame, day: str, quantum: float, tolerance: float = 0.0001) -> DataFrame:
    """Pairs, upper-median and largest deviation, with the final day scored apart."""
    pairs = settle(pairs.select(day, "deviation", "gap"), "archive-pairs")
    final = pairs.agg(F.max(day).alias("final_day"))
    scored = with_totals(pairs, final).withColumn("part", F.when(F.col(day) == F.col("final_day"), "tail").otherwise("body"))
    med = upper_median(scored, ["part"], "deviation", "median").drop("n")
    sums = scored.groupBy("part").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("deviation") > tolerance).alias("over"),
        F.max("deviation").alias("max"),
        F.max("gap").alias("max_gap"),
        F.count_if(F.col("gap") > F.lit(quantum)).alias("beyond_quantum"),
    )
    return sums.join(med, "part")


def worst_pairs(pairs: DataFrame, metric: str, tie: Sequence[str], n: int = 5) -> DataFrame:
    return top_k(pairs, [F.desc(metric), *[F.asc(c) for c in tie]], n)


def decompose_holders(assets: DataFrame, holders: DataFrame) -> DataFrame:
    """Per asset: sovereign total, rest of the holders, residual against supply, and what the sums say.

    assets(asset, supply, claimed, complete), holders(asset, holder, chain NULL unless sovereign, amount).
    """
    sovereign = F.col("chain").isNotNull()
    sums = holders.groupBy("asset").agg(
        F.count(F.lit(1)).alias("swept"),
        F.countDistinct("chain").alias("chains"),
        F.sum("amount").alias("holder_sum"),
        F.coalesce(F.sum(F.when(sovereign, F.col("amount"))), F.lit(0)).alias("sovereign_total"),
    )
    supply, held = F.col("supply"), F.coalesce("holder_sum", F.lit(0))
    apart = F.coalesce("sovereign_total", F.lit(0))
    swept = F.coalesce("swept", F.lit(0))
    checkable = supply.isNotNull() & F.col("complete")
    return assets.join(sums, "asset", "left").select(
        "asset",
        "supply",
        swept.alias("swept"),
        F.coalesce("chains", F.lit(0)).alias("chains"),
        held.alias("holder_sum"),
        apart.alias("sovereign_total"),
        (held - apart).alias("other_holders"),
        (supply - apart).alias("on_chain"),
        (supply - held).alias("unaccounted"),
        F.when(checkable, held == supply).alias("sum_matches"),
        (F.col("claimed") == swept).alias("count_matches"),
        (supply - apart < 0).alias("negative_residual"),
    )


def reconciliation(rows: DataFrame) -> DataFrame:
    """One row: how many assets add up, do not, or could not be checked."""
    return rows.agg(
        F.count(F.lit(1)).alias("assets"),
        F.count_if("sum_matches").alias("exact"),
        F.count_if(~F.col("sum_matches")).alias("mismatched"),
        F.count_if(F.col("sum_matches").isNull()).alias("unchecked"),
        F.count_if("negative_residual").alias("negative"),
        F.count_if(~F.col("count_matches")).alias("short_sweeps"),
        F.count_if(~F.col("sum_matches") & (F.col("unaccounted") < 0)).alias("over_accounted"),
    )


def holdings_per_chain(holders: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct assets and symbols per sovereign chain."""
    held = holders.filter(F.col("chain").isNotNull()).select("chain", "asset").distinct().join(tokens, "asset", "left")
    return held.groupBy("chain").agg(
        F.count(F.lit(1)).alias("assets"), F.countDistinct("symbol").alias("symbols"), F.count_if(F.col("decimals").isNull()).alias("unscaled")
    )


def holdings_per_network(assets: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per network: assets, those with a known supply, those without decimals, and distinct symbols. assets(network, asset, supply), tokens(asset, symbol, decimals)."""
    one = assets.groupBy("network", "asset").agg(F.max("supply").alias("supply")).join(tokens, "asset", "left")
    return one.groupBy("network").agg(
        F.count(F.lit(1)).alias("assets"),
        F.count("supply").alias("with_supply"),
        F.count_if(F.col("decimals").isNull()).alias("unscaled"),
        F.countDistinct("symbol").alias("symbols"),
    )


def symbols_per_chain(holders: DataFrame, tokens: DataFrame) -> DataFrame:
    """The symbols that a chain holds, as long rows with the number of assets behind each; assets without a token count under NULL."""
    held = holders.filter(F.col("chain").isNotNull()).select("chain", "asset").distinct().join(tokens, "asset", "left")
    return held.groupBy("chain", "symbol").agg(F.count(F.lit(1)).alias("assets"))


def sovereign_totals(rows: DataFrame, snapshot: str, legs: Sequence[str], issuance: DataFrame) -> DataFrame:
    """Per snapshot: sums per leg, accounts that exist, and the share of issuance they hold."""
    sums = rows.groupBy(snapshot).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in legs], F.sum("total").alias("total"), F.count(F.lit(1)).alias("accounts")
    )
    return sums.join(issuance, snapshot, "left").withColumn(
        "share", F.try_divide(F.col("total").cast("double"), F.col("issuance").cast("double")) * 100
    )

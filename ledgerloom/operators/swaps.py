"""Trade summaries: totals, venues, routes, accounts, daily summaries, rate board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.quantiles import mean_median, middles
from ..session import settle
from .ranking import top_k, top_per_group, with_totals

# Statuses that mean a trade completed.
SETTLED = ["FILLED", "REDEEMED", "COMPLETED", "EXECUTED"]


def is_settled() -> Column:
    return ~F.col("failed") & (F.col("status").isNull() | F.col("status").isin(SETTLED))


def volume(df: DataFrame, *keys: str) -> DataFrame:
    """Dollars and number of trades per key; unpriced trades count but add nothing."""
    return df.groupBy(*keys).agg(S.sum_or_zero(F.col("usd")).alias("usd"), F.count(F.lit(1)).alias("count"))


def with_route(trades: DataFrame) -> DataFrame:
    return trades.withColumn("route", S.route_name(F.col("token_in"), F.col("token_out")))


def swap_summary(trades: DataFrame) -> DataFrame:
    """One row of totals. Days and accounts come from a single pass over the trades."""
    parts = trades.groupingSets([[F.col("date")], [F.col("account")]], "date", "account").agg(
        F.grouping("account").alias("is_day"),
        S.sum_or_zero(F.col("usd")).alias("usd"),
        F.count(F.lit(1)).alias("count"),
        F.count_if(is_settled()).alias("settled"),
        S.sum_or_zero(F.when(F.col("failed"), F.col("usd"))).alias("failed_usd"),
        F.count_if(F.col("usd").isNull()).alias("unpriced"),
    )
    parts = settle(parts, "swap-summary")
    days = parts.filter("is_day = 1")
    accounts = parts.filter("is_day = 0")

    first_peak = F.max_by(F.struct("date", "usd", "count"), F.struct(F.col("usd"), -F.unix_date("date")))
    totals = days.agg(
        F.sum("usd").alias("usd"),
        F.sum("count").alias("trades"),
        (F.datediff(F.max("date"), F.min("date")) + 1).cast("bigint").alias("span_days"),
        F.count(F.lit(1)).alias("active_days"),
        first_peak.alias("peak"),
        F.sum("settled").alias("settled"),
        F.sum("failed_usd").alias("failed_usd"),
        F.sum("unpriced").alias("unpriced"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    holders = accounts.agg(
        F.count(F.lit(1)).alias("accounts"), F.count_if(F.col("usd") < 100).alias("accounts_under_hundred")
    )
    leaders = (
        top_k(accounts, [F.desc("usd"), F.asc("account")], 10)
        .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("usd"), F.asc("account"))))
        .agg(F.sum(F.when(F.col("rank") <= 4, F.col("usd"))).alias("top_four"), F.sum("usd").alias("top_ten"))
    )
    day_median = mean_median(days, [], "usd", "median_active_day").select("median_active_day")
    account_median = mean_median(accounts, [], "usd", "median_account").select("median_account")
    row = totals
    for extra in (holders, leaders, day_median, account_median):
        row = with_totals(row, extra)
    return row.select(
        S.dbl(F.col("usd")).alias("usd"),
        "trades",
        "accounts",
        "span_days",
        "active_days",
        F.col("peak.date").alias("peak_date"),
        S.dbl(F.col("peak.usd")).alias("peak_usd"),
        F.col("peak.count").alias("peak_count"),
        "settled",
        (F.col("settled") / F.col("trades") * 100).alias("settled_share"),
        S.dbl(F.col("failed_usd")).alias("failed_usd"),
        "unpriced",
        "median_active_day",
        "median_account",
        "accounts_under_hundred",
        S.share(F.col("top_four"), F.col("usd")).alias("top_four_share"),
        S.dbl(F.col("top_four")).alias("top_four_usd"),
        S.share(F.col("top_ten"), F.col("usd")).alias("top_ten_share"),
        "first_date",
        "last_date",
    )


def ranked_text(totals: DataFrame, owner: str, label: str, value: str, text: Column, n: int | None, name: str) -> DataFrame:
    """The n largest labels of each owner (all of them without n) in one line of text."""
    best = top_per_group(totals, [owner], [F.desc(value), F.asc(label)], n)
    item = F.struct(F.col("rank"), F.concat(F.col(label), F.lit(" "), text).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"])
    return best.groupBy(owner).agg(F.array_join(ordered, " / ").alias(name))


def account_rollup(trades: DataFrame) -> DataFrame:
    """One row per account, with its six largest venues and busiest routes in words."""
    # One pass down to (account, id, venue, route); everything else folds that smaller frame.
    fine = with_route(trades).groupBy("account", "account_id", "venue", "route").agg(
        S.sum_or_zero(F.col("usd")).alias("usd"),
        F.count(F.lit(1)).alias("count"),
        F.count_if("failed").alias("failed"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
    )
    fine = settle(fine, "account-rollup")
    base = fine.groupBy("account").agg(
        F.sum("usd").alias("usd"),
        F.sum("count").alias("count"),
        F.sum("failed").alias("failed"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.countDistinct("account_id").alias("account_ids"),
        F.max("account_id").alias("__id"),
    )
    per = lambda key: fine.groupBy("account", key).agg(F.sum("usd").alias("usd"), F.sum("count").alias("count"))
    whole = F.format_number(F.floor(S.dbl(F.col("usd")) + 0.5), 0)
    venues = ranked_text(per("venue"), "account", "venue", "usd", whole, 6, "venues")
    by_count = F.col("count").cast("string")
    routes = ranked_text(per("route"), "account", "route", "count", by_count, 6, "routes")
    return (
        base.join(venues, "account", "left")
        .join(routes, "account", "left")
        .select(
            "account",
            S.dbl(F.col("usd")).alias("usd"),
            "count",
            "failed",
            "first",
            "last",
            "account_ids",
            F.when(F.col("account_ids") == 1, F.col("__id")).alias("account_id"),
            "venues",
            "routes",
        )
    )


def asset_sides(trades: DataFrame, *keys: str) -> DataFrame:
    """Per symbol: dollars credited to the input side only, and trades on either side."""
    sides = F.explode(
        F.array(
            F.struct(F.coalesce("token_in", F.lit("?")).alias("symbol"), F.lit(True).alias("is_in")),
            F.struct(F.coalesce("token_out", F.lit("?")).alias("symbol"), F.lit(False).alias("is_in")),
        )
    )
    return (
        trades.select(*keys, "usd", sides.alias("s"))
        .groupBy(*keys, F.col("s.symbol").alias("symbol"))
        .agg(
            S.sum_or_zero(F.when(F.col("s.is_in"), F.col("usd"))).alias("usd"),
            F.count_if(F.col("s.is_in")).alias("trades_in"),
            F.count_if(~F.col("s.is_in")).alias("trades_out"),
        )
    )


def day_summary(trades: DataFrame) -> DataFrame:
    """One row per UTC day, from one pass with several groupings."""
    routed = with_route(trades)
    d, v, r, a = (F.col(c) for c in ("date", "venue", "route", "account"))
    parts = routed.groupingSets([[d], [d, v], [d, r], [d, a]], d, v, r, a).agg(
        F.grouping_id().alias("level"),
        S.sum_or_zero(F.col("usd")).alias("usd"),
        F.count(F.lit(1)).alias("trades"),
        F.sum("hops").alias("legs"),
        F.count_if(F.col("usd").isNull()).alias("unpriced"),
        F.count_if("is_pallet").alias("pallet_trades"),
        S.sum_or_zero(F.when(F.col("is_pallet"), F.col("usd"))).alias("pallet_usd"),
    )
    parts = settle(parts, "day-summary")
    days = parts.filter("level = 7")
    venues = parts.filter("level = 3")
    routes = parts.filter("level = 5")
    accounts = parts.filter("level = 6")

    leaders = (
        top_per_group(accounts, ["date"], [F.desc("usd"), F.asc("account")], 10)
        .groupBy("date")
        .agg(F.sum(F.when(F.col("rank") <= 4, F.col("usd"))).alias("top_four"), F.sum("usd").alias("top_ten"))
    )
    holders = accounts.groupBy("date").agg(F.count(F.lit(1)).alias("accounts"))
    route_count = routes.groupBy("date").agg(F.count(F.lit(1)).alias("routes_total"))
    cents = F.col("usd").cast("decimal(38,2)").cast("string")
    venue_text = ranked_text(venues, "date", "venue", "usd", cents, None, "venues")
    part_of = lambda x: F.when(F.col("usd") > 0, S.six_digits(S.dbl(x) / S.dbl(F.col("usd")) * 100))
    out = days.drop("venue", "route", "account", "level")
    for extra in (holders, leaders, route_count, venue_text):
        out = out.join(extra, "date")
    return out.select(
        "date",
        "trades",
        "legs",
        S.six_digits(F.col("legs") / F.col("trades")).alias("leg_inflation"),
        S.round_cents(S.dbl(F.col("usd"))).alias("usd"),
        "unpriced",
        "accounts",
        "pallet_trades",
        S.round_cents(S.dbl(F.col("pallet_usd"))).alias("pallet_usd"),
        part_of(F.col("top_four")).alias("top_four_share"),
        part_of(F.col("top_ten")).alias("top_ten_share"),
        "routes_total",
        "venues",
    )


def concentration(accounts: DataFrame, depth: int = 400) -> DataFrame:
    """Cumulative share of all volume by account rank; the total is taken before the trim."""
    total = accounts.agg(F.sum("usd").alias("total"))
    best = with_totals(top_k(accounts, [F.desc("usd"), F.asc("account")], depth), total)
    order = Window.orderBy(F.desc("usd"), F.asc("account"))
    cum = F.sum("usd").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return best.select(
        F.row_number().over(order).cast("bigint").alias("rank"), "account", S.share(cum, F.col("total")).alias("share")
    )


def rate_board(trades: DataFrame, tie: str = "id", window: int = 25, limit: int = 12) -> DataFrame:
    """Delivered rate per route: median of the latest settled rates, latest rate and its drift."""
    usable = with_route(trades).filter(
        F.col("token_in").isNotNull()
        & F.col("token_out").isNotNull()
        & (F.col("amount_in") > 0)
        & (F.col("amount_out") > 0)
        & (F.col("token_in") != F.col("token_out"))
    )
    rated = usable.select("route", "date", tie, "failed", (F.col("amount_out") / F.col("amount_in")).alias("rate"))
    counts = rated.groupBy("route").agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(~F.col("failed")).alias("settled_observations")
    )
    # The latest rates of both kinds are kept first; which kind counts is decided per route afterwards.
    latest = top_per_group(rated, ["route", "failed"], [F.desc("date"), F.desc(tie)], window)
    basis = latest.join(counts, "route").filter(~F.col("failed") | (F.col("settled_observations") == 0))
    basis = settle(basis, "rate-basis")
    med = middles(basis, ["route"], "rate").select(
        "route", F.col("n").alias("window"), ((F.col("lower") + F.col("upper")) / 2).alias("median")
    )
    last = basis.groupBy("route").agg(F.max_by("rate", F.struct("date", tie)).alias("latest"), F.max("date").alias("latest_at"))
    counts = basis.groupBy("route").agg(F.max("observations").alias("observations"), F.max("settled_observations").alias("settled_observations"))
    board = counts.join(med, "route").join(last, "route").withColumn(
        "drift", F.when(F.col("median") > 0, (F.col("latest") - F.col("median")) / F.col("median") * 100)
    )
    return top_k(board, [F.desc("observations"), F.asc("route")], limit)


def platform_ratio(rows: DataFrame, own: Column, pooled: Column | None = None) -> DataFrame:
    """Own dollars per day beside the sum over every leg: pools count a route once per leg.

    `own` marks the rows that are a trade's own dollars, `pooled` those that pools count, by default all.
    """
    pool_usd = F.col("usd") if pooled is None else F.when(pooled, F.col("usd"))
    days = rows.groupBy("date").agg(
        F.sum(F.when(own, F.col("usd"))).alias("own_usd"), F.sum(pool_usd).alias("pool_usd"), F.count_if(own).alias("__own")
    )
    return days.filter("__own > 0").select(
        "date",
        S.dbl(F.col("own_usd")).alias("own_usd"),
        S.dbl(F.col("pool_usd")).alias("pool_usd"),
        F.try_divide(S.dbl(F.col("pool_usd")), S.dbl(F.col("own_usd"))).alias("ratio"),
    )


def activity(trades: DataFrame, days: int) -> DataFrame:
    """Per account: trades ever and inside the last whole days of the source, first and last day, active days."""
    head = trades.agg(F.date_sub(F.max("date"), days - 1).alias("start"))
    marked = with_totals(trades.select("account", "date"), head)
    per_day = marked.groupBy("account", "date", "start").agg(F.count(F.lit(1)).alias("n"))
    inside = F.col("date") >= F.col("start")
    return per_day.groupBy("account").agg(
        F.sum("n").alias("trades"),
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("in_window"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.count(F.lit(1)).alias("active_days"),
    ).withColumn("window_share", F.col("in_window") / F.col("trades"))

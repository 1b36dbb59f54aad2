"""The main frames of whole reports as named queries beside SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import tables as T
from . import capitals, expressions, graphs, registry_joins, reports, series
from .registry import ORACLES, query

WINDOW_DAYS = 200
WINDOWED_SQL = T.TRADES_SQL.replace("trades AS", "all_trades AS", 1) + f""",
trades AS (SELECT * FROM all_trades WHERE date >= (SELECT greatest(max(date) - {WINDOW_DAYS - 1}, min(date)) FROM all_trades))"""


@query("rep_swap_window_totals", ORACLES["a01_swap_summary"].replace(T.TRADES_SQL, WINDOWED_SQL))
def swap_window_totals(spark, folder):
    return reports.swap_window(T.trades(spark, folder), WINDOW_DAYS)["totals"]


@query("rep_swap_days", ORACLES["a02_day_summary"])
def swap_days(spark, folder):
    return reports.swap_days(T.trades(spark, folder))["days"]


@query("rep_netflow_days", ORACLES["a27_day_with_dust"])
def netflow_days(spark, folder):
    out = reports.netflow_series(series.leg_frames(spark, folder), 2000)["days"]
    return out.select("day", "account", *[F.col(c).cast("bigint").alias(c) for c in ("relay", "hub")], "members", "bucket")


@query("rep_cohort_days", ORACLES["a28_cohort_days"])
def cohort_days(spark, folder):
    frames = series.leg_frames(spark, folder)
    cohort = frames.groupBy("account").agg(F.sum("amount").alias("s")).filter("s > 300000")
    out = reports.cohort_series(frames, cohort, "2024-01-20")["days"]
    return out.select("day", *[F.col(c).cast("bigint").alias(c) for c in ("relay", "hub", "total", "top_ten")], "nonzero")


@query("rep_message_summary", ORACLES["a38_window_summary"])
def message_summary(spark, folder):
    return reports.message_window(graphs.last_days(spark, folder, 90))["summary"]


@query("rep_message_days", f"WITH {graphs.WINDOW_SQL} SELECT date, {graphs.STATS_SQL} FROM win GROUP BY date")
def message_days(spark, folder):
    return reports.message_window(graphs.last_days(spark, folder, 90))["days"]


@query(
    "rep_message_routes",
    f"""WITH {graphs.WINDOW_SQL} SELECT origin, dest, count(*) AS messages, cast(sum(latency) AS double) / count(latency) AS mean_latency,
      count(*) FILTER (outcome = 'Success') / count(*) * 100 AS delivered FROM win WHERE match_status = 'matched' GROUP BY ALL ORDER BY messages DESC, origin, dest LIMIT 20""",
)
def message_routes(spark, folder):
    return reports.message_window(graphs.last_days(spark, folder, 90))["matched_routes"]


def sovereigns(spark, folder):
    """Accounts named by customers in credit and by urgent orders; the register is the table of customers, issuance is all that moved on a day."""
    legs = series.legs2(spark, folder)
    customer, orders = T.table(spark, folder, "customer"), T.table(spark, folder, "orders")
    sources = {
        "credit": customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("account")),
        "urgent": orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("account")),
    }
    registered = customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("account"))
    return reports.sovereign_report(sources, registered, legs, legs.groupBy("day").agg(F.sum("total").alias("issuance")), "day")


SOVEREIGN_SQL = f"""{series.FRAMES_SQL},
named AS (SELECT DISTINCT c_custkey AS account, 'credit' AS source FROM customer WHERE c_acctbal > 0 UNION ALL SELECT DISTINCT o_custkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query(
    "rep_sovereign_totals",
    f"""WITH {SOVEREIGN_SQL}, i AS (SELECT day, sum(total) AS issuance FROM legs2 GROUP BY day)
    SELECT day, cast(coalesce(sum(relay), 0) AS bigint) AS relay, cast(coalesce(sum(hub), 0) AS bigint) AS hub, cast(sum(total) AS bigint) AS total, count(*) AS accounts, cast(any_value(issuance) AS bigint) AS issuance,
      cast(sum(total) AS double) / cast(any_value(issuance) AS double) * 100 AS share FROM legs2 JOIN i USING (day) WHERE account IN (SELECT account FROM named) GROUP BY day""",
)
def sovereign_totals(spark, folder):
    whole = [F.col(c).cast("bigint").alias(c) for c in ("relay", "hub", "total", "issuance")]
    return sovereigns(spark, folder)["totals"].select("day", *whole, "accounts", "share")


@query(
    "rep_sovereign_missing",
    f"""WITH {SOVEREIGN_SQL} SELECT account, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS named_by FROM named
    WHERE account NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY account""",
)
def sovereign_missing(spark, folder):
    return sovereigns(spark, folder)["missing"]


def pegs(spark, folder):
    return reports.peg_report(*capitals.peg_frames(spark, folder), capitals.book_orders(spark, folder))


@query(
    "rep_peg_pools",
    f"SELECT pool, count(*) AS assets, max(abs(gap_bps)) AS widest_bps, max(peg_age) AS peg_age, bool_or(ramping) AS ramping, bool_and(aligned) AS aligned FROM ({ORACLES['q23_peg_states']}) GROUP BY pool",
)
def peg_pools(spark, folder):
    return pegs(spark, folder)["pools"]


@query("rep_peg_book", ORACLES["q24_order_book_counts"])
def peg_book(spark, folder):
    return pegs(spark, folder)["book_counts"]


def wraps(spark, folder):
    """Parts as reserves: what is supplied of a part is its key times its size, in hundreds."""
    supplied = T.table(spark, folder, "part").select(F.col("p_partkey").alias("wrap"), (F.col("p_partkey") * F.col("p_size") * 100).cast("bigint").alias("supplied"))
    settings = expressions.reserve_configuration(spark, folder).withColumnRenamed("p_partkey", "wrap").drop("decimals")
    return reports.wrap_map(supplied.join(settings, "wrap"), *registry_joins.wrap_frames(spark, folder))


WRAP_SQL = f"""
wraps AS (SELECT j.*, s.* EXCLUDE (p_partkey, decimals), cast(supply_cap AS double) AS cap, cast(p_partkey * p.p_size * 100 AS bigint) AS supplied
  FROM ({ORACLES['j15_confirmed_wraps']}) j JOIN ({ORACLES['p17_reserve_configuration']}) s ON s.p_partkey = j.wrap JOIN part p USING (p_partkey))"""


@query(
    "rep_wrap_map",
    f"WITH {WRAP_SQL} SELECT wrap, underlying, confirmed, decimals_agree, ltv_bps, supply_cap, frozen, category, supplied, CASE WHEN cap <> 0 THEN cast(supplied AS double) / cap * 100 END AS cap_use FROM wraps",
)
def wrap_reserves(spark, folder):
    return wraps(spark, folder)["reserves"].select("wrap", "underlying", "confirmed", "decimals_agree", "ltv_bps", "supply_cap", "frozen", "category", "supplied", "cap_use")


@query(
    "rep_wrap_categories",
    f"""WITH {WRAP_SQL} SELECT category, count(*) AS members, min(wrap) AS first_member, max(ltv_bps / 10000) AS ltv, 1.0::double / (1 - max(ltv_bps / 10000)) AS max_leverage
    FROM wraps WHERE category > 0 GROUP BY category""",
)
def wrap_categories(spark, folder):
    return wraps(spark, folder)["categories"]


def staking(spark, folder):
    """Months of lines: the quantity stands behind the quantity less its discount."""
    lines = T.table(spark, folder, "lineitem")
    staked, issued = F.sum(S.money(F.col("l_quantity"))), F.sum(S.money(F.col("l_quantity") * (1 - F.col("l_discount"))))
    pools = lines.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("snapshot")).agg(S.dbl(staked).alias("staked"), S.dbl(issued).alias("issued"))
    return reports.staking_ratio(pools, "snapshot", 1.04, 1.06)


STAKING_SQL = """
pools AS (SELECT strftime(l_shipdate, '%Y-%m') AS snapshot, cast(sum(cast(l_quantity AS decimal(18,4))) AS double) AS staked, cast(sum(cast(l_quantity * (1 - l_discount) AS decimal(18,4))) AS double) AS issued FROM lineitem GROUP BY ALL),
ratios AS (SELECT *, staked / issued AS ratio, coalesce(staked / issued BETWEEN 1.04 AND 1.06, false) AS plausible FROM pools)"""


@query("rep_staking_ratios", f"WITH {STAKING_SQL} SELECT * FROM ratios")
def staking_ratios(spark, folder):
    return staking(spark, folder)["ratios"]


@query(
    "rep_staking_checks",
    f"""WITH {STAKING_SQL} SELECT 'ratio_known' AS check, count(*) FILTER (ratio IS NULL) AS broken, count(*) FILTER (ratio IS NULL) = 0 AS holds FROM ratios
    UNION ALL SELECT 'ratio_in_band', count(*) FILTER (NOT plausible), count(*) FILTER (NOT plausible) = 0 FROM ratios""",
)
def staking_checks(spark, folder):
    return staking(spark, folder)["checks"]

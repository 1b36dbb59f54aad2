"""Trade queries: projections, rollups, ranks and dense series over lines, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import axis, ranking, swaps
from ..session import settle
from ..sources import tables as T
from .registry import query, six_sql

# Two orders of one sample give the lower and the upper middle value.
MEAN_MEDIAN = "(quantile_disc({0}, 0.5) + percentile_disc(0.5) WITHIN GROUP (ORDER BY {0} DESC)) / 2"


@query(
    "a01_swap_summary",
    f"""WITH {T.TRADES_SQL},
    d AS (SELECT date, coalesce(sum(usd), 0) AS usd, count(*) AS n FROM trades GROUP BY date),
    a AS (SELECT account, coalesce(sum(usd), 0) AS usd FROM trades GROUP BY account),
    r AS (SELECT *, row_number() OVER (ORDER BY usd DESC, account) AS rk FROM a)
    SELECT cast(sum(usd) AS double) AS usd, count(*) AS trades, (SELECT count(*) FROM a) AS accounts,
      cast(date_diff('day', min(date), max(date)) + 1 AS bigint) AS span_days, (SELECT count(*) FROM d) AS active_days,
      (SELECT date FROM d ORDER BY usd DESC, date LIMIT 1) AS peak_date,
      (SELECT cast(usd AS double) FROM d ORDER BY usd DESC, date LIMIT 1) AS peak_usd,
      (SELECT n FROM d ORDER BY usd DESC, date LIMIT 1) AS peak_count,
      cast(count(*) FILTER (NOT failed AND (status IS NULL OR status IN ('FILLED','REDEEMED','COMPLETED','EXECUTED'))) AS bigint) AS settled,
      count(*) FILTER (NOT failed AND (status IS NULL OR status IN ('FILLED','REDEEMED','COMPLETED','EXECUTED'))) / count(*) * 100 AS settled_share,
      cast(coalesce(sum(usd) FILTER (failed), 0) AS double) AS failed_usd,
      count(*) FILTER (usd IS NULL) AS unpriced,
      (SELECT {MEAN_MEDIAN.format("cast(usd AS double)")} FROM d) AS median_active_day,
      (SELECT {MEAN_MEDIAN.format("cast(usd AS double)")} FROM a) AS median_account,
      (SELECT count(*) FROM a WHERE usd < 100) AS accounts_under_hundred,
      (SELECT cast(sum(usd) AS double) FROM r WHERE rk <= 4) / cast(sum(usd) AS double) * 100 AS top_four_share,
      (SELECT cast(sum(usd) AS double) FROM r WHERE rk <= 4) AS top_four_usd,
      (SELECT cast(sum(usd) AS double) FROM r WHERE rk <= 10) / cast(sum(usd) AS double) * 100 AS top_ten_share,
      min(date) AS first_date, max(date) AS last_date FROM trades""",
)
def swap_summary(spark, folder):
    return swaps.swap_summary(T.trades(spark, folder))


DAY_LISTS_SQL = """
    d AS (SELECT date, sum(coalesce(usd, 0)) AS usd, count(*) AS trades, sum(hops) AS legs,
                 count(*) FILTER (usd IS NULL) AS unpriced, count(*) FILTER (is_pallet) AS pallet_trades,
                 coalesce(sum(usd) FILTER (is_pallet), 0) AS pallet_usd, count(DISTINCT account) AS accounts,
                 count(DISTINCT token_in || '→' || token_out) AS routes_total
          FROM trades GROUP BY date),
    a AS (SELECT date, account, sum(coalesce(usd, 0)) AS usd FROM trades GROUP BY date, account),
    ar AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY usd DESC, account) AS rk FROM a),
    top AS (SELECT date, sum(usd) FILTER (rk <= 4) AS four, sum(usd) FILTER (rk <= 10) AS ten FROM ar GROUP BY date),
    v AS (SELECT date, venue, sum(coalesce(usd, 0)) AS usd FROM trades GROUP BY date, venue),
    vt AS (SELECT date, string_agg(venue || ' ' || cast(cast(usd AS decimal(38,2)) AS varchar), ' / ' ORDER BY usd DESC, venue) AS venues
           FROM v GROUP BY date)"""


@query(
    "a02_day_summary",
    f"""WITH {T.TRADES_SQL}, {DAY_LISTS_SQL}
    SELECT date, trades, cast(legs AS bigint) AS legs, {six_sql("legs / trades")} AS leg_inflation,
      floor(cast(usd AS double) * 100 + 0.5) / 100 AS usd, unpriced, accounts, pallet_trades,
      floor(cast(pallet_usd AS double) * 100 + 0.5) / 100 AS pallet_usd,
      CASE WHEN usd > 0 THEN {six_sql("cast(four AS double) / cast(usd AS double) * 100")} END AS top_four_share,
      CASE WHEN usd > 0 THEN {six_sql("cast(ten AS double) / cast(usd AS double) * 100")} END AS top_ten_share,
      routes_total, venues
    FROM d JOIN top USING (date) JOIN vt USING (date)""",
)
def day_summary(spark, folder):
    return swaps.day_summary(T.trades(spark, folder))


@query(
    "a03_daily_by_venue",
    f"""WITH {T.EVENT_TRADES_SQL}
    SELECT date, venue, cast(sum(usd) AS double) AS usd, count(*) AS count FROM event_trades GROUP BY date, venue""",
)
def daily_by_venue(spark, folder):
    daily = swaps.volume(T.event_trades(spark, folder), "date", "venue")
    return daily.withColumn("usd", S.dbl(F.col("usd")))


@query(
    "a04_venues_by_volume",
    f"""WITH {T.EVENT_TRADES_SQL}
    SELECT venue, cast(sum(usd) AS double) AS usd FROM event_trades GROUP BY venue""",
)
def venues_by_volume(spark, folder):
    venues = swaps.volume(T.event_trades(spark, folder), "venue")
    return venues.orderBy(F.desc("usd"), F.asc("venue")).select("venue", S.dbl(F.col("usd")).alias("usd"))


ROUTES_SQL = """routes AS (SELECT token_in || '→' || token_out AS route, coalesce(sum(usd), 0) AS usd, count(*) AS count
    FROM trades GROUP BY ALL)"""


@query(
    "a05_routes",
    f"WITH {T.TRADES_SQL}, {ROUTES_SQL} SELECT route, cast(usd AS double) AS usd, count FROM routes",
)
def routes(spark, folder):
    frame = swaps.volume(swaps.with_route(T.trades(spark, folder)), "route")
    return frame.withColumn("usd", S.dbl(F.col("usd")))


@query(
    "a06_account_rollup",
    f"""WITH {T.TRADES_SQL},
    v AS (SELECT account, venue, coalesce(sum(usd), 0) AS usd FROM trades GROUP BY ALL),
    vr AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY usd DESC, venue) AS rk FROM v),
    vt AS (SELECT account, string_agg(venue || ' ' || format('{{:,}}', cast(floor(cast(usd AS double) + 0.5) AS bigint)), ' / ' ORDER BY rk) AS venues
           FROM vr WHERE rk <= 6 GROUP BY account),
    r AS (SELECT account, token_in || '→' || token_out AS route, count(*) AS n FROM trades GROUP BY ALL),
    rr AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY n DESC, route) AS rk FROM r),
    rt AS (SELECT account, string_agg(route || ' ' || n, ' / ' ORDER BY rk) AS routes FROM rr WHERE rk <= 6 GROUP BY account)
    SELECT account, cast(coalesce(sum(usd), 0) AS double) AS usd, count(*) AS count, count(*) FILTER (failed) AS failed,
      min(date) AS first, max(date) AS last, count(DISTINCT account_id) AS account_ids,
      CASE WHEN count(DISTINCT account_id) = 1 THEN max(account_id) END AS account_id,
      any_value(venues) AS venues, any_value(routes) AS routes
    FROM trades JOIN vt USING (account) JOIN rt USING (account) GROUP BY account""",
)
def account_rollup(spark, folder):
    return swaps.account_rollup(T.trades(spark, folder))


SIDES_SQL = """sides AS (SELECT date, token_in AS symbol, usd, true AS is_in FROM trades
    UNION ALL SELECT date, token_out, usd, false FROM trades)"""


@query(
    "a07_asset_sides",
    f"""WITH {T.TRADES_SQL}, {SIDES_SQL}
    SELECT symbol, cast(coalesce(sum(usd) FILTER (is_in), 0) AS double) AS usd, count(*) FILTER (is_in) AS trades_in,
      count(*) FILTER (NOT is_in) AS trades_out FROM sides GROUP BY symbol""",
)
def asset_sides(spark, folder):
    sides = swaps.asset_sides(T.trades(spark, folder))
    return sides.withColumn("usd", S.dbl(F.col("usd")))


@query(
    "a13_daily_by_asset",
    f"""WITH {T.TRADES_SQL}
    SELECT date, token_in AS symbol, cast(coalesce(sum(usd), 0) AS double) AS usd, count(*) AS count
    FROM trades GROUP BY ALL""",
)
def daily_by_asset(spark, folder):
    frame = swaps.volume(T.trades(spark, folder), "date", F.col("token_in").alias("symbol"))
    return frame.withColumn("usd", S.dbl(F.col("usd")))


@query(
    "a43_account_activity",
    f"""WITH {T.EVENT_TRADES_SQL}, s AS (SELECT max(date) - 6 AS start FROM event_trades)
    SELECT account, count(*) AS trades, count(*) FILTER (date >= start) AS in_window, min(date) AS first_day,
      max(date) AS last_day, count(DISTINCT date) AS active_days, count(*) FILTER (date >= start) / count(*) AS window_share
    FROM event_trades, s GROUP BY account""",
)
def account_activity(spark, folder):
    return swaps.activity(T.event_trades(spark, folder), 7)


@query(
    "a44_platform_ratio",
    f"""WITH {T.LEGS_SQL}, o AS (SELECT date, sum(usd) AS u FROM legs WHERE side = 'in' GROUP BY date),
    p AS (SELECT date, sum(usd) AS u FROM legs GROUP BY date)
    SELECT date, cast(o.u AS double) AS own_usd, cast(p.u AS double) AS pool_usd, cast(p.u AS double) / cast(o.u AS double) AS ratio
    FROM o LEFT JOIN p USING (date)""",
)
def platform_ratio(spark, folder):
    return swaps.platform_ratio(T.legs(spark, folder), F.col("side") == "in")


@query(
    "w01_cumulative_volume",
    f"""WITH {T.EVENT_TRADES_SQL}, d AS (SELECT date, sum(usd) AS usd FROM event_trades GROUP BY date)
    SELECT date, cast(usd AS double) AS usd, cast(sum(usd) OVER (ORDER BY date) AS double) AS cumulative FROM d""",
)
def cumulative_volume(spark, folder):
    daily = swaps.volume(T.event_trades(spark, folder), "date")
    out = axis.running(daily, [F.asc("date")], "usd", "cumulative")
    return out.select("date", S.dbl(F.col("usd")).alias("usd"), S.dbl(F.col("cumulative")).alias("cumulative"))


@query(
    "w02_concentration",
    f"""WITH {T.LEGS_SQL}, a AS (SELECT account, coalesce(sum(usd), 0) AS usd FROM legs GROUP BY account),
    c AS (SELECT row_number() OVER (ORDER BY usd DESC, account) AS rank, account,
      sum(usd) OVER (ORDER BY usd DESC, account ROWS UNBOUNDED PRECEDING) AS cum, sum(usd) OVER () AS total FROM a)
    SELECT rank, account, cast(cum AS double) / cast(total AS double) * 100 AS share FROM c WHERE rank <= 400""",
)
def concentration(spark, folder):
    return swaps.concentration(swaps.volume(T.legs(spark, folder), "account"))


@query(
    "w03_rate_board",
    f"""WITH {T.TRADES_SQL},
    s AS (SELECT token_in || '→' || token_out AS route, date, id, failed, amount_out / amount_in AS rate FROM trades
          WHERE amount_in > 0 AND amount_out > 0 AND token_in <> token_out),
    c AS (SELECT route, count(*) AS observations, count(*) FILTER (NOT failed) AS settled_observations FROM s GROUP BY route),
    b AS (SELECT s.*, row_number() OVER (PARTITION BY route ORDER BY date DESC, id DESC) AS rk
          FROM s JOIN c USING (route) WHERE NOT failed OR settled_observations = 0),
    m AS (SELECT route, count(*) AS "window", {MEAN_MEDIAN.format("rate")} AS median,
          max(rate) FILTER (rk = 1) AS latest, max(date) AS latest_at FROM b WHERE rk <= 25 GROUP BY route)
    SELECT route, observations, settled_observations, "window", median, latest, latest_at,
      CASE WHEN median > 0 THEN (latest - median) / median * 100 END AS drift
    FROM c JOIN m USING (route) ORDER BY observations DESC, route LIMIT 12""",
)
def rate_board(spark, folder):
    return swaps.rate_board(T.trades(spark, folder))


@query(
    "w08_latest_per_account",
    """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events)
    SELECT user_id, event_id, event_type, rank FROM r WHERE rank <= 5""",
)
def latest_per_account(spark, folder):
    events = T.table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    return ranking.top_per_group(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).drop("ts")


@query(
    "w09_keep_latest_line",
    f"""WITH r AS (SELECT *, {T.LINE_KEY_SQL} AS k FROM lineitem),
    w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, k DESC) AS rk FROM r)
    SELECT l_orderkey AS order_id, l_linenumber AS line, k AS line_key, l_extendedprice AS price FROM w WHERE rk = 1""",
)
def keep_latest_line(spark, folder):
    lines = T.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        T.line_key().alias("line_key"),
        F.col("l_extendedprice").alias("price"),
        "l_shipdate",
    )
    return ranking.keep_one(lines, ["order_id", "line"], [F.desc("l_shipdate"), F.desc("line_key")]).drop("l_shipdate")


@query(
    "t01_top_routes",
    f"""WITH {T.TRADES_SQL}, {ROUTES_SQL}
    SELECT route, cast(usd AS double) AS usd, count, (SELECT count(*) FROM routes) AS routes_total,
      (SELECT cast(sum(usd) AS double) FROM routes) AS usd_total
    FROM routes ORDER BY routes.usd DESC, route LIMIT 40""",
)
def top_routes(spark, folder):
    frame = settle(swaps.volume(swaps.with_route(T.trades(spark, folder)), "route"), "routes")
    totals = frame.agg(F.count(F.lit(1)).alias("routes_total"), S.dbl(F.sum("usd")).alias("usd_total"))
    best = ranking.top_k(frame, [F.desc("usd"), F.asc("route")], 40)
    return ranking.with_totals(best, totals).withColumn("usd", S.dbl(F.col("usd")))


@query(
    "t03_top_accounts_per_day",
    f"""WITH {T.TRADES_SQL}, a AS (SELECT date, account, coalesce(sum(usd), 0) AS usd, count(*) AS count FROM trades GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY usd DESC, account) AS rank, count(*) OVER (PARTITION BY date) AS accounts_total FROM a)
    SELECT date, account, cast(usd AS double) AS usd, count, rank, accounts_total FROM r WHERE rank <= 5""",
)
def top_accounts_per_day(spark, folder):
    frame = settle(swaps.volume(T.trades(spark, folder), "date", "account"), "day-accounts")
    counts = frame.groupBy("date").agg(F.count(F.lit(1)).alias("accounts_total"))
    best = ranking.top_per_group(frame, ["date"], [F.desc("usd"), F.asc("account")], 5)
    return best.join(counts, "date").withColumn("usd", S.dbl(F.col("usd")))


@query(
    "t03_top_routes_per_day",
    f"""WITH {T.TRADES_SQL}, a AS (SELECT date, token_in || '→' || token_out AS route, coalesce(sum(usd), 0) AS usd, count(*) AS count FROM trades GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY usd DESC, route) AS rank, count(*) OVER (PARTITION BY date) AS routes_total, sum(usd) OVER (PARTITION BY date) AS usd_total FROM a)
    SELECT date, route, cast(usd AS double) AS usd, count, rank, routes_total, cast(usd_total AS double) AS usd_total FROM r WHERE rank <= 40""",
)
def top_routes_per_day(spark, folder):
    frame = settle(swaps.volume(swaps.with_route(T.trades(spark, folder)), "date", "route"), "day-routes")
    totals = frame.groupBy("date").agg(F.count(F.lit(1)).alias("routes_total"), S.dbl(F.sum("usd")).alias("usd_total"))
    best = ranking.top_per_group(frame, ["date"], [F.desc("usd"), F.asc("route")], 40)
    return best.join(totals, "date").withColumn("usd", S.dbl(F.col("usd")))


@query(
    "t04_top_routes_and_rest",
    f"""WITH {T.TRADES_SQL}, {ROUTES_SQL},
    k AS (SELECT *, row_number() OVER (ORDER BY usd DESC, route) AS rk FROM routes)
    SELECT CASE WHEN rk <= 8 THEN route ELSE 'other' END AS route, cast(sum(usd) AS double) AS usd,
      cast(sum(count) AS bigint) AS count, count(*) AS members FROM k GROUP BY ALL""",
)
def top_routes_and_rest(spark, folder):
    frame = settle(swaps.volume(swaps.with_route(T.trades(spark, folder)), "route"), "routes")
    return ranking.top_or_rest(frame, "route", "usd", 8, "other").withColumn("usd", S.dbl(F.col("usd")))


@query(
    "t05_nulls_last_sort",
    """WITH v AS (SELECT p_partkey, p_name, CASE WHEN p_size > 5 THEN p_retailprice END AS price FROM part)
    SELECT p_partkey, p_name, price, row_number() OVER (ORDER BY price DESC NULLS LAST, p_name, p_partkey) AS position
    FROM v ORDER BY price DESC NULLS LAST, p_name, p_partkey LIMIT 500""",
)
def nulls_last_sort(spark, folder):
    from pyspark.sql import Window

    part = T.table(spark, folder, "part").select(
        "p_partkey", "p_name", F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("price")
    )
    order = [F.desc_nulls_last("price"), F.asc("p_name"), F.asc("p_partkey")]
    page = ranking.top_k(part, order, 500)
    return page.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


@query(
    "t06_order_page",
    """SELECT o_orderkey, cast(o_orderdate AS date) AS order_date, o_totalprice, (SELECT count(*) FROM orders) AS total
    FROM orders WHERE cast(o_orderdate AS date) < DATE '2000-06-01'
       OR (cast(o_orderdate AS date) = DATE '2000-06-01' AND o_orderkey < 9000)
    ORDER BY order_date DESC, o_orderkey DESC LIMIT 50""",
)
def order_page(spark, folder):
    import datetime

    orders = T.table(spark, folder, "orders")
    listing = orders.select("o_orderkey", F.to_date("o_orderdate").alias("order_date"), "o_totalprice")
    page = ranking.page_after(
        listing, [("order_date", "desc"), ("o_orderkey", "desc")], [datetime.date(2000, 6, 1), 9000], 50
    )
    return ranking.with_totals(page, orders.agg(F.count(F.lit(1)).alias("total")))


@query(
    "g01_dense_daily_by_venue",
    f"""WITH {T.EVENT_TRADES_SQL}, a AS (SELECT cast(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS date) AS date FROM event_trades),
    v AS (SELECT DISTINCT venue FROM event_trades), d AS (SELECT date, venue, sum(usd) AS usd, count(*) AS count FROM event_trades GROUP BY ALL)
    SELECT date, venue, cast(coalesce(usd, 0) AS double) AS usd, coalesce(count, 0) AS count FROM (SELECT * FROM a, v) LEFT JOIN d USING (date, venue)""",
)
def dense_daily_by_venue(spark, folder):
    daily = swaps.volume(T.event_trades(spark, folder), "date", "venue")
    venues = daily.select("venue").distinct()
    out = axis.dense(daily, "date", {"usd": 0, "count": 0}, venues)
    return out.select("date", "venue", S.dbl(F.col("usd")).alias("usd"), "count")

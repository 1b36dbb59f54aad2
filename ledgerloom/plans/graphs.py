"""Transfer graph, corridor, message and quality queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..operators import messages as M
from ..operators import quality as Q
from ..sources import tables as T
from .registry import query

TEXT = lambda name: F.col(name).cast("string").alias(name)


def chain_blocks(spark, folder):
    """One block per line with one transfer event, arguments as a JSON object; 32-byte accounts in upper case."""
    word = lambda c: F.concat(F.lit("0x"), F.lpad(F.hex(c), 64, "0"))
    name = (
        F.when(F.col("l_returnflag") == "N", "Balances.Transfer")
        .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "PoolAssets.Transferred")
        .when(F.col("l_returnflag") == "A", "Assets.Transferred")
        .otherwise("ForeignAssets.Transferred")
    )
    args = F.to_json(
        F.struct(
            # Lines with number 7 carry a short account and must be left out.
            F.when(F.col("l_linenumber") == 7, "0xdeadbeef").otherwise(word("l_suppkey")).alias("from"),
            word("l_partkey").alias("to"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string").alias("amount"),
            F.col("l_linenumber").cast("string").alias("assetId"),
        )
    )
    return T.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("number"),
        (F.unix_date(F.to_date("l_shipdate")).cast("bigint") * 86_400_000).alias("timestamp"),
        F.array(F.struct(name.alias("name"), args.alias("args"))).alias("events"),
    )


NAMES = ["Balances.Transfer", "Assets.Transferred", "PoolAssets.Transferred", "ForeignAssets.Transferred"]

DECODED_SQL = """
decoded AS (SELECT l_orderkey AS block, cast(l_shipdate AS date) AS day, lower(lpad(to_hex(l_suppkey), 64, '0')) AS sender, lower(lpad(to_hex(l_partkey), 64, '0')) AS receiver,
    cast(round(l_extendedprice * 100) AS bigint) AS amount,
    CASE WHEN l_returnflag = 'N' THEN 'native' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'pool:' || l_linenumber WHEN l_returnflag = 'A' THEN 'assets:' || l_linenumber ELSE 'foreign:' || l_linenumber END AS asset
  FROM lineitem WHERE l_linenumber <> 7)"""


@query("p05_decoded_transfers", f"WITH {DECODED_SQL} SELECT block, day, sender, receiver, amount, asset FROM decoded")
def decoded_transfers(spark, folder):
    edges = G.decode_transfers(chain_blocks(spark, folder), NAMES)
    return edges.select("block", F.to_date("at").alias("day"), "sender", "receiver", F.col("amount").cast("bigint").alias("amount"), "asset")


@query(
    "p05_decode_quality",
    """SELECT CASE WHEN l_returnflag = 'N' THEN 'Balances.Transfer' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'PoolAssets.Transferred' WHEN l_returnflag = 'A' THEN 'Assets.Transferred' ELSE 'ForeignAssets.Transferred' END AS event,
      CASE WHEN l_linenumber = 7 THEN 'account' END AS reason, count(*) AS events FROM lineitem GROUP BY ALL""",
)
def decode_quality(spark, folder):
    return G.decode_quality(chain_blocks(spark, folder), NAMES)


@query("p06_asset_keys", f"WITH {DECODED_SQL} SELECT asset, count(*) AS transfers, cast(sum(amount) AS double) AS amount FROM decoded GROUP BY asset")
def asset_keys(spark, folder):
    edges = G.decode_transfers(chain_blocks(spark, folder), NAMES)
    return edges.groupBy("asset").agg(F.count(F.lit(1)).alias("transfers"), S.dbl(F.sum("amount")).alias("amount"))


@query(
    "p07_windowed_edges",
    f"""WITH {T.EDGES_SQL}, h AS (SELECT max(day) - 365 AS cut FROM edges)
    SELECT chain, asset, count(*) AS edges, cast(sum(amount) AS varchar) AS amount, min(day) AS first_day FROM edges, h WHERE day >= cut GROUP BY ALL""",
)
def windowed_edges(spark, folder):
    _, head = T.shipped_span(spark, folder)
    kept = T.transfer_edges(spark, folder, head and head - datetime.timedelta(days=365))
    return kept.groupBy("chain", "asset").agg(
        F.count(F.lit(1)).alias("edges"), F.sum("amount").cast("string").alias("amount"), F.min("day").alias("first_day")
    )


@query(
    "a10_event_counts",
    f"""WITH {T.EDGES_SQL}, h AS (SELECT max(day) - 365 AS cut FROM edges)
    SELECT chain, event, count(*) AS events, count(*) FILTER (day >= cut) AS in_window FROM edges, h GROUP BY ALL""",
)
def event_counts(spark, folder):
    return G.event_counts(T.transfer_edges(spark, folder), 365, head=T.shipped_span(spark, folder)[1])


ENDS_SQL = """ends AS (SELECT sender AS account, receiver AS other, true AS is_out, * FROM edges UNION ALL SELECT receiver, sender, false, * FROM edges)"""


@query(
    "a09_counterparties",
    f"""WITH {T.EDGES_SQL}, {ENDS_SQL} SELECT account, other, count(*) AS transfers, count(*) FILTER (is_out) AS sent, count(*) FILTER (NOT is_out) AS received,
      CASE WHEN bool_and(is_out) THEN 'out' WHEN bool_or(is_out) THEN 'both' ELSE 'in' END AS direction, min(day) AS first_day, max(day) AS last_day,
      string_agg(DISTINCT chain, ',' ORDER BY chain) AS chains FROM ends GROUP BY account, other""",
)
def counterparties(spark, folder):
    return G.counterparties(T.transfer_edges(spark, folder))


@query(
    "a09_counterparties_of_targets",
    f"""WITH {T.EDGES_SQL}, {ENDS_SQL}, t AS (SELECT 'c:' || c_custkey AS account FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 's:' || s_suppkey FROM supplier WHERE s_nationkey = 7)
    SELECT account, other, count(*) AS transfers, count(*) FILTER (is_out) AS sent, count(*) FILTER (NOT is_out) AS received,
      CASE WHEN bool_and(is_out) THEN 'out' WHEN bool_or(is_out) THEN 'both' ELSE 'in' END AS direction, min(day) AS first_day, max(day) AS last_day,
      string_agg(DISTINCT chain, ',' ORDER BY chain) AS chains FROM ends WHERE account IN (SELECT account FROM t) GROUP BY account, other""",
)
def counterparties_of_targets(spark, folder):
    """The asked accounts: customers in debt, and the suppliers of one nation."""
    customers = T.table(spark, folder, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("account"))
    suppliers = T.table(spark, folder, "supplier").filter("s_nationkey = 7").select(F.concat(F.lit("s:"), F.col("s_suppkey")).alias("account"))
    return G.counterparties(T.transfer_edges(spark, folder), customers.union(suppliers))


BAGS_SQL = """bags AS (SELECT account, chain, asset, count(*) AS transfers, coalesce(sum(amount) FILTER (is_out), 0) AS sent_raw, coalesce(sum(amount) FILTER (NOT is_out), 0) AS received_raw FROM ends GROUP BY ALL)"""


@query(
    "a09_asset_bags",
    f"""WITH {T.EDGES_SQL}, {ENDS_SQL}, {BAGS_SQL} SELECT account, chain, asset, transfers, 0::bigint AS self_transfers, cast(sent_raw AS varchar) AS sent_raw, cast(received_raw AS varchar) AS received_raw FROM bags""",
)
def asset_bags(spark, folder):
    bags = G.asset_bags(T.transfer_edges(spark, folder))
    return bags.select("account", "chain", "asset", "transfers", "self_transfers", TEXT("sent_raw"), TEXT("received_raw"))


@query(
    "q20_denomination",
    f"""WITH {T.EDGES_SQL}, {ENDS_SQL}, {BAGS_SQL}, d AS (SELECT p_type AS asset, cast(min(p_size) AS bigint) AS decimals FROM part WHERE p_type <> 'PROMO' GROUP BY p_type),
    k AS (SELECT bags.*, decimals, row_number() OVER (PARTITION BY account ORDER BY (decimals IS NULL), transfers DESC, chain || '/' || asset) AS rk,
      sum(transfers) OVER (PARTITION BY account) AS all_transfers, count(*) OVER (PARTITION BY account) AS assets FROM bags LEFT JOIN d USING (asset))
    SELECT account, cast(all_transfers AS bigint) AS all_transfers, assets, chain || '/' || asset AS denomination, transfers,
      cast(sent_raw AS double) / pow(10.0, decimals) AS sent, cast(received_raw AS double) / pow(10.0, decimals) AS received
    FROM k WHERE rk = 1""",
)
def denomination(spark, folder):
    part = T.table(spark, folder, "part").filter("p_type <> 'PROMO'")
    decimals = part.groupBy(F.col("p_type").alias("asset")).agg(F.min("p_size").cast("bigint").alias("decimals"))
    return G.denomination(G.asset_bags(T.transfer_edges(spark, folder)), decimals)


@query(
    "u02_union_edges",
    f"WITH {T.EDGES_SQL} SELECT chain, event, count(*) AS edges, count(DISTINCT sender) AS senders FROM edges GROUP BY ALL",
)
def union_edges(spark, folder):
    edges = T.transfer_edges(spark, folder)
    relay = edges.filter("chain = 'relay'").drop("chain").withColumn("chain", F.lit("relay"))
    hub = edges.filter("chain = 'hub'").drop("chain").withColumn("chain", F.lit("hub"))
    both = relay.unionByName(hub)
    return both.groupBy("chain", "event").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("sender").alias("senders"))


@query(
    "r10_block_buckets",
    "SELECT cast(floor(event_id / 2000) AS bigint) AS bucket, count(*) AS rows, min(event_id) AS first_block, max(event_id) AS last_block FROM events GROUP BY ALL",
)
def block_buckets(spark, folder):
    return G.block_buckets(T.table(spark, folder, "events"), "event_id", 2000)


CORRIDORS_SQL = """pairs AS (SELECT origin, dest, count(*) AS messages, count(usd) AS priced, coalesce(sum(usd), 0) AS usd FROM messages GROUP BY ALL)"""


@query("a11_corridors", f"WITH {T.MESSAGES_SQL}, {CORRIDORS_SQL} SELECT origin, dest, messages, priced, cast(usd AS double) AS usd FROM pairs")
def corridors(spark, folder):
    return G.corridors(T.messages(spark, folder)).withColumn("usd", S.dbl(F.col("usd")))


@query(
    "a11_corridor_nodes",
    f"""WITH {T.MESSAGES_SQL}, {CORRIDORS_SQL} SELECT chain, cast(sum(s) AS bigint) AS sent, cast(sum(r) AS bigint) AS received, cast(sum(s + r) AS bigint) AS messages
    FROM (SELECT origin AS chain, messages AS s, 0 AS r FROM pairs UNION ALL SELECT dest, 0, messages FROM pairs) GROUP BY chain""",
)
def corridor_nodes(spark, folder):
    return G.corridor_nodes(G.corridors(T.messages(spark, folder)))


@query(
    "a12_corridor_matrix",
    f"""WITH {T.MESSAGES_SQL}, {CORRIDORS_SQL} SELECT origin, dest, cast(sum(messages) AS bigint) AS messages, cast(sum(usd) AS double) AS usd,
      cast(grouping(origin) * 2 + grouping(dest) AS bigint) AS level FROM pairs GROUP BY GROUPING SETS ((origin, dest), (origin), (dest), ())""",
)
def corridor_matrix(spark, folder):
    matrix = G.corridor_matrix(G.corridors(T.messages(spark, folder)))
    return matrix.withColumn("usd", S.dbl(F.col("usd"))).withColumn("level", F.col("level").cast("bigint"))


@query(
    "a14_usual_quantity",
    """WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) AS rk, count(*) OVER (PARTITION BY l_suppkey) AS d FROM c)
    SELECT l_suppkey, l_quantity AS mode, n AS support, d AS distinct_values FROM k WHERE rk = 1""",
)
def usual_quantity(spark, folder):
    return G.mode_of(T.table(spark, folder, "lineitem"), "l_suppkey", "l_quantity")


@query(
    "a15_id_conflicts",
    """WITH c AS (SELECT event_type AS name, user_id AS id, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, id) AS rk, sum(n) OVER (PARTITION BY name) AS rows FROM c)
    SELECT name, id, n AS agreeing, cast(rows AS bigint) AS rows, cast(rows - n AS bigint) AS conflicting FROM k WHERE rk = 1""",
)
def id_conflicts(spark, folder):
    rows = T.table(spark, folder, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("ident"))
    return G.best_supported_id(rows, "name", "ident")


WINDOW_SQL = f"""{T.MESSAGES_SQL}, span AS (SELECT greatest(max(date) - 89, min(date)) AS lo, max(date) AS hi, max(date) - 89 < min(date) AS clamped FROM messages),
win AS (SELECT messages.*, lo, hi, clamped FROM messages, span WHERE date >= lo)"""


@query(
    "p08_whole_day_window",
    f"WITH {WINDOW_SQL} SELECT date, count(*) AS messages, min(lo) AS window_from, max(hi) AS window_to, bool_or(clamped) AS clamped FROM win GROUP BY date",
)
def whole_day_window(spark, folder):
    return last_days(spark, folder, 90).groupBy("date", "window_from", "window_to", "clamped").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "a38_window_summary",
    f"""WITH {WINDOW_SQL} SELECT count(*) AS total, count(*) FILTER (outcome = 'Success') AS completed, count(*) FILTER (outcome = 'Failed') AS failed,
      count(*) FILTER (outcome = 'Success') / count(*) * 100 AS success_rate, count(*) FILTER (match_status = 'matched') AS matched,
      percentile_disc(0.5) WITHIN GROUP (ORDER BY latency DESC) AS median_latency, quantile_disc(latency, 0.95) AS p95_latency FROM win""",
)
def window_summary(spark, folder):
    return M.window_summary(last_days(spark, folder, 90))


def last_days(spark, folder, days):
    """The head comes from the fact table alone; the joins see the window's lines only."""
    first, last = T.shipped_span(spark, folder)
    return M.known_window(T.messages(spark, folder, last and last - datetime.timedelta(days=days - 1)), "date", days, first, last)


STATS_SQL = "count(*) AS total, count(*) FILTER (outcome = 'Success') AS completed, count(*) FILTER (outcome = 'Failed') AS failed, count(*) FILTER (outcome IS NULL) AS unresolved"


@query("a39_daily_messages", f"WITH {T.MESSAGES_SQL} SELECT date, {STATS_SQL} FROM messages GROUP BY date")
def daily_messages(spark, folder):
    return M.daily_stats(T.messages(spark, folder))


@query("a39_daily_messages_by_route", f"WITH {T.MESSAGES_SQL} SELECT date, origin, dest, {STATS_SQL} FROM messages GROUP BY date, origin, dest")
def daily_messages_by_route(spark, folder):
    return M.daily_stats(T.messages(spark, folder), "origin", "dest")


@query(
    "a40_busiest_routes",
    f"""WITH {T.MESSAGES_SQL} SELECT origin, dest, count(*) AS messages, cast(sum(latency) AS double) / count(latency) AS mean_latency,
      count(*) FILTER (outcome = 'Success') / count(*) * 100 AS delivered FROM messages WHERE match_status = 'matched' GROUP BY ALL ORDER BY messages DESC, origin, dest LIMIT 20""",
)
def busiest_routes(spark, folder):
    return M.busiest_routes(T.messages(spark, folder), 20, matched_only=True)


def events(spark, folder):
    return T.table(spark, folder, "events").withColumn("day", F.to_date("ts"))


@query(
    "a41_daily_activity",
    """SELECT cast(ts AS date) AS period, count(*) AS transactions, count(DISTINCT user_id) AS accounts, cast(sum(cast(value AS decimal(18,4))) AS double) AS fees, count(*) / 86400.0::double AS tps
    FROM events GROUP BY ALL""",
)
def daily_activity(spark, folder):
    measures = [
        F.count(F.lit(1)).alias("transactions"),
        F.countDistinct("user_id").alias("accounts"),
        S.dbl(F.sum(S.money(F.col("value")))).alias("fees"),
        (F.count(F.lit(1)) / F.lit(86400.0)).alias("tps"),
    ]
    return M.rollup_by_period(events(spark, folder), F.col("day"), [], measures)


@query(
    "a41_call_heatmap",
    "SELECT event_type AS kind, cast(isodow(ts) AS bigint) AS period, cast(hour(ts) AS bigint) AS hour, count(*) AS calls FROM events GROUP BY ALL",
)
def call_heatmap(spark, folder):
    weekday = (F.weekday("ts") + 1).cast("bigint")
    keys = [F.hour("ts").cast("bigint").alias("hour"), F.col("event_type").alias("kind")]
    return M.rollup_by_period(events(spark, folder), weekday, keys, [F.count(F.lit(1)).alias("calls")])


@query(
    "a41_monthly_voters",
    "SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority AS kind, count(DISTINCT o_custkey) AS voters, count(*) AS votes FROM orders GROUP BY ALL",
)
def monthly_voters(spark, folder):
    measures = [F.countDistinct("o_custkey").alias("voters"), F.count(F.lit(1)).alias("votes")]
    orders = T.table(spark, folder, "orders")
    return M.rollup_by_period(orders, F.date_format("o_orderdate", "yyyy-MM"), [F.col("o_orderpriority").alias("kind")], measures)


@query(
    "a41_daily_utilisation",
    "SELECT cast(ts AS date) AS period, count(DISTINCT hour(ts)) AS busy, count(DISTINCT hour(ts)) / 24 * 100 AS utilisation FROM events GROUP BY ALL",
)
def daily_utilisation(spark, folder):
    busy = F.countDistinct(F.hour("ts"))
    return M.rollup_by_period(events(spark, folder), F.col("day"), [], [busy.alias("busy"), (busy / 24 * 100).alias("utilisation")])


@query(
    "a41_sale_cycles",
    """SELECT cast(floor(date_diff('day', DATE '1970-01-01', cast(o_orderdate AS date)) / 28) AS bigint) AS period, count(*) AS sales, min(o_totalprice) AS lowest, max(o_totalprice) AS highest,
      cast(sum(cast(o_totalprice AS decimal(18,4))) AS double) AS revenue FROM orders GROUP BY ALL""",
)
def sale_cycles(spark, folder):
    cycle = F.floor(F.unix_date(F.to_date("o_orderdate")) / 28).cast("bigint")
    measures = [
        F.count(F.lit(1)).alias("sales"),
        F.min("o_totalprice").alias("lowest"),
        F.max("o_totalprice").alias("highest"),
        S.dbl(F.sum(S.money(F.col("o_totalprice")))).alias("revenue"),
    ]
    return M.rollup_by_period(T.table(spark, folder, "orders"), cycle, [], measures)


@query(
    "a41_monthly_balances",
    """SELECT strftime(o_orderdate, '%Y-%m') AS period, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS balance, max(cast(o_orderdate AS date)) AS as_of,
      count(*) FILTER (o_orderstatus = 'F') / count(*) * 100 AS percent_staked FROM orders GROUP BY ALL""",
)
def monthly_balances(spark, folder):
    filled = F.count_if(F.col("o_orderstatus") == "F")
    closing = [F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).alias("n"), filled.alias("f")]
    days = M.rollup_by_period(T.table(spark, folder, "orders"), F.to_date("o_orderdate"), [], closing).withColumnRenamed("period", "day")
    measures = [
        F.max_by("close", "day").alias("balance"),
        F.max("day").alias("as_of"),
        (F.sum("f") / F.sum("n") * 100).alias("percent_staked"),
    ]
    return M.rollup_by_period(days, F.date_format("day", "yyyy-MM"), [], measures)


CEILING = 95_000.0

HISTOGRAM_SQL = f"""{T.MESSAGES_SQL},
rows_in AS (SELECT id, symbol, decimals, usd, length(regexp_replace(regexp_replace(raw_amount, '^[-+]?0*', ''), '\\..*$', '')) AS digits FROM messages WHERE usd IS NOT NULL),
hist AS (SELECT symbol, digits, count(*) AS n FROM rows_in GROUP BY ALL),
steps AS (SELECT *, digits - lag(digits) OVER (PARTITION BY symbol ORDER BY digits) AS gap, sum(n) OVER (PARTITION BY symbol ORDER BY digits DESC) AS above FROM hist),
tops AS (SELECT symbol, cast(sum(n) AS bigint) AS support, max(digits) FILTER (gap >= 4) AS top, arg_max(above, digits) FILTER (gap >= 4) AS above FROM steps GROUP BY symbol),
cuts AS (SELECT symbol, support, CASE WHEN support >= 5 AND above <= support * 0.2 THEN top END AS cut FROM tops)"""


def priced_messages(spark, folder):
    digits = S.digit_count(F.col("raw_amount"))
    return T.messages(spark, folder).filter("usd IS NOT NULL").select("id", "symbol", "decimals", "usd", digits.alias("digits"))


@query("q06_outlier_cuts", f"WITH {HISTOGRAM_SQL} SELECT symbol, support, cut FROM cuts")
def outlier_cuts(spark, folder):
    histogram = priced_messages(spark, folder).groupBy("symbol", "digits").agg(F.count(F.lit(1)).alias("n"))
    return Q.outlier_cuts(histogram, "symbol", "digits", "n").withColumn("cut", F.col("cut").cast("bigint"))


FLAGGED_SQL = f"""{HISTOGRAM_SQL}, dec AS (SELECT symbol, decimals, count(*) AS n FROM rows_in WHERE decimals IS NOT NULL GROUP BY ALL),
usual AS (SELECT symbol, decimals AS usual_decimals FROM dec QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, decimals) = 1),
flagged AS (SELECT rows_in.*, support, cut, usual_decimals, CASE WHEN support >= 5 AND decimals <> usual_decimals THEN 'decimals-disagree' WHEN digits >= cut THEN 'magnitude-outlier' WHEN usd > {CEILING} THEN 'over-ceiling' END AS reason
  FROM rows_in LEFT JOIN cuts USING (symbol) LEFT JOIN usual USING (symbol))"""


@query("q05_flagged_rows", f"WITH {FLAGGED_SQL} SELECT id, symbol, digits, decimals, cast(usd AS double) AS usd, support, cut, usual_decimals, reason FROM flagged")
def flagged_rows(spark, folder):
    flagged = Q.flag_outliers(priced_messages(spark, folder), CEILING)
    return flagged.select(
        "id", "symbol", F.col("digits").cast("bigint").alias("digits"), "decimals", S.dbl(F.col("usd")).alias("usd"), "support", F.col("cut").cast("bigint").alias("cut"), "usual_decimals", "reason"
    )


@query(
    "q05_excluded_totals",
    f"WITH {FLAGGED_SQL} SELECT coalesce(reason, 'included') AS reason, count(*) AS rows, cast(sum(usd) AS double) AS usd FROM flagged GROUP BY ALL",
)
def excluded_totals(spark, folder):
    flagged = Q.flag_outliers(priced_messages(spark, folder), CEILING)
    return flagged.groupBy(F.coalesce("reason", F.lit("included")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"), S.dbl(F.sum("usd")).alias("usd"))


GRID_SQL = "grid AS (SELECT cast(ts AS date) AS day, event_type AS chain, CASE WHEN event_type = 'error' THEN NULL WHEN value < 1 THEN 0 ELSE value END AS v FROM events)"


def grid_rows(spark, folder):
    value = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("value") < 1, 0.0).otherwise(F.col("value"))
    return events(spark, folder).select("day", F.col("event_type").alias("chain"), value.alias("v"))


@query(
    "a42_daily_grid",
    f"WITH {GRID_SQL} SELECT day, count(*) AS rows, count(DISTINCT chain) AS chains, count(*) FILTER (v = 0) AS zero_rows, count(*) FILTER (v IS NULL) AS null_rows FROM grid GROUP BY day",
)
def daily_grid(spark, folder):
    return Q.daily_grid(grid_rows(spark, folder), "day", "chain", "v")


@query(
    "q15_truncation",
    f"""WITH {GRID_SQL} SELECT count(*) AS rows, min(day) AS covered_from, max(day) AS covered_to, count(DISTINCT day) AS days, count(*) = 10000 AS at_cap,
      count(*) = 10000 AND max(day) < DATE '2024-02-15' AS truncated FROM grid""",
)
def truncation(spark, folder):
    return Q.truncation(Q.daily_grid(grid_rows(spark, folder), "day", "chain", "v"), "day", 10_000, "2024-02-15")


@query(
    "w12_partial_tail",
    """WITH d AS (SELECT cast(ts AS date) AS day, count(DISTINCT user_id) AS users FROM events GROUP BY ALL), l AS (SELECT * FROM d ORDER BY day DESC LIMIT 8),
    m AS (SELECT max(day) AS last_day, arg_max(users, day) AS last_count FROM l), e AS (SELECT users FROM l, m WHERE day < last_day),
    t AS (SELECT (quantile_disc(users, 0.5) + percentile_disc(0.5) WITHIN GROUP (ORDER BY users DESC)) / 2 AS typical FROM e)
    SELECT last_day, last_count, typical, last_count < typical AS partial FROM m, t""",
)
def partial_tail(spark, folder):
    users = events(spark, folder).groupBy("day").agg(F.countDistinct("user_id").alias("users"))
    return Q.partial_tail(users, "day", "users")


OBSERVED = "2024-01-31 06:00:00"

FRESH_SQL = f"""heads AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY user_id),
lag AS (SELECT c_custkey AS user_id, lo, hi, epoch_us(TIMESTAMP '{OBSERVED}') // 1000 - epoch_us(hi) // 1000 AS lag_ms FROM customer LEFT JOIN heads ON user_id = c_custkey),
fresh AS (SELECT user_id, lag_ms, cast(lo AS date) AS covers_from, CASE WHEN lag_ms IS NULL THEN 'unknown' WHEN lag_ms >= 129600000 THEN 'frozen' WHEN lag_ms >= 43200000 THEN 'stale' ELSE 'live' END AS state FROM lag)"""


def fresh(spark, folder):
    rows = events(spark, folder).select("user_id", F.col("ts").cast("timestamp").alias("at"))
    expected = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    return Q.freshness(rows, expected, "user_id", "at", F.lit(OBSERVED).cast("timestamp"), 43_200_000, 129_600_000)


@query("r08_freshness", f"WITH {FRESH_SQL} SELECT user_id, lag_ms, covers_from, state, false AS clock_skew FROM fresh")
def freshness(spark, folder):
    return fresh(spark, folder).select("user_id", "lag_ms", F.to_date("covers_from").alias("covers_from"), "state", "clock_skew")


@query(
    "r08_worst_state",
    f"WITH {FRESH_SQL} SELECT state, count(*) AS sources, min(user_id) AS first_source, cast(max(CASE state WHEN 'live' THEN 0 WHEN 'unknown' THEN 1 WHEN 'stale' THEN 2 WHEN 'unreachable' THEN 3 ELSE 4 END) AS bigint) AS severity FROM fresh GROUP BY state",
)
def worst_state(spark, folder):
    return Q.worst_state(fresh(spark, folder), "user_id")


@query(
    "q09_expectations",
    """SELECT 'positive_quantity' AS check, count(*) FILTER (NOT l_quantity > 0) AS broken, count(*) FILTER (NOT l_quantity > 0) = 0 AS holds FROM lineitem UNION ALL
    SELECT 'taxed', count(*) FILTER (NOT l_tax > 0), count(*) FILTER (NOT l_tax > 0) = 0 FROM lineitem UNION ALL
    SELECT 'price_band', count(*) FILTER (NOT l_extendedprice BETWEEN 900 AND 100000), count(*) FILTER (NOT l_extendedprice BETWEEN 900 AND 100000) = 0 FROM lineitem""",
)
def expectations(spark, folder):
    checks = {
        "positive_quantity": F.col("l_quantity") > 0,
        "taxed": F.col("l_tax") > 0,
        "price_band": F.col("l_extendedprice").between(900, 100000),
    }
    return Q.violations(T.table(spark, folder, "lineitem"), checks)


@query(
    "q09_required",
    "SELECT l_returnflag, count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL",
)
def required(spark, folder):
    """The refusing form: a single row against an expectation fails the query instead of being counted."""
    checks = {"positive_quantity": F.col("l_quantity") > 0, "flagged": F.col("l_returnflag").isNotNull()}
    rows = Q.require(T.table(spark, folder, "lineitem"), checks)
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"))


@query(
    "q14_count_check",
    """WITH c AS (SELECT l_orderkey, max(l_linenumber) AS claimed, count(*) AS rows_read FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS order_id, cast(coalesce(claimed, 0) AS bigint) AS claimed, coalesce(rows_read, 0) AS rows_read, coalesce(claimed, 0) = coalesce(rows_read, 0) AS complete FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""",
)
def count_check(spark, folder):
    lines = T.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_linenumber")
    last = lines.groupBy("order_id").agg(F.max("l_linenumber").cast("bigint").alias("expected"))
    claimed = T.table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id")).join(last, "order_id", "left")
    return Q.count_check(lines, claimed, ["order_id"], "expected")


@query(
    "w11_numbering_gaps",
    """SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(DISTINCT l_linenumber) AS present, max(l_linenumber) - min(l_linenumber) + 1 - count(DISTINCT l_linenumber) AS missing
    FROM lineitem GROUP BY l_orderkey""",
)
def numbering_gaps(spark, folder):
    return Q.numbering_gaps(T.table(spark, folder, "lineitem"), ["l_orderkey"], "l_linenumber")


@query(
    "q17_cohort_check",
    """WITH s AS (SELECT lower(lpad(to_hex(c_custkey), 64, '0')) AS id, cast(c_acctbal AS decimal(18,2)) AS amount FROM customer UNION ALL
      SELECT lower(lpad(to_hex(c_custkey), 60, '0')), cast(c_acctbal AS decimal(18,2)) FROM customer WHERE c_mktsegment = 'BUILDING'),
    p AS (SELECT id, count(*) AS n, sum(amount) AS s FROM s GROUP BY id)
    SELECT cast(sum(n) AS bigint) AS rows, count(*) FILTER (length(id) <> 64) AS malformed, count(*) FILTER (n > 1) AS duplicated, cast(sum(s) AS varchar) AS total,
      (SELECT cast(sum(cast(c_acctbal AS decimal(18,2))) AS varchar) FROM customer) AS declared, sum(s) = (SELECT sum(cast(c_acctbal AS decimal(18,2))) FROM customer) AS total_matches FROM p""",
)
def cohort_check(spark, folder):
    customer = T.table(spark, folder, "customer")
    amount = F.col("c_acctbal").cast("decimal(18,2)").alias("amount")
    ident = lambda n: F.lower(F.lpad(F.hex("c_custkey"), n, "0")).alias("id")
    seed = customer.select(ident(64), amount).unionByName(customer.filter("c_mktsegment = 'BUILDING'").select(ident(60), amount))
    declared = customer.agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")))
    return Q.cohort_check(seed, "id", "amount", declared).withColumn("total", F.col("total").cast("string")).withColumn("declared", F.col("declared").cast("string"))

"""Balance and series queries."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import axis as A
from ..operators import balances as B
from ..operators import quality as Q
from ..session import fresh_path, settle
from ..sources import landing as L
from ..sources import tables as T
from .registry import query

MICRO = "decimal(38,0)"


def leg_frames(spark, folder):
    """Views and clicks are the relay leg, purchases and signups the hub leg, errors belong to neither; cents."""
    kind = F.col("event_type")
    leg = F.when(kind.isin("view", "click"), "relay").when(kind.isin("purchase", "signup"), "hub")
    return T.table(spark, folder, "events").select(
        F.to_date("ts").alias("day"),
        F.col("user_id").alias("account"),
        F.col("event_id").alias("block"),
        leg.alias("leg"),
        F.round(F.col("value") * 100).cast(MICRO).alias("amount"),
    )


FRAMES_SQL = """
frames AS (SELECT cast(ts AS date) AS day, user_id AS account, event_id AS block, CASE WHEN event_type IN ('view', 'click') THEN 'relay' WHEN event_type IN ('purchase', 'signup') THEN 'hub' END AS leg,
    cast(round(value * 100) AS bigint) AS amount FROM events),
legs2 AS (SELECT day, account, sum(amount) FILTER (leg = 'relay') AS relay, sum(amount) FILTER (leg = 'hub') AS hub, sum(amount) AS total FROM frames WHERE leg IS NOT NULL GROUP BY ALL)"""

LONG = lambda *names: [F.col(n).cast("bigint").alias(n) for n in names]


def legs2(spark, folder):
    return B.two_legs(leg_frames(spark, folder), ["day", "account"], "relay", "hub", "amount")


@query("j06_two_legs", f"WITH {FRAMES_SQL} SELECT day, account, cast(relay AS bigint) AS relay, cast(hub AS bigint) AS hub, cast(total AS bigint) AS total FROM legs2")
def two_legs(spark, folder):
    return legs2(spark, folder).select("day", "account", *LONG("relay", "hub", "total"))


@query(
    "a27_day_with_dust",
    f"""WITH {FRAMES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total DESC, account) AS rk FROM legs2),
    b AS (SELECT *, CASE WHEN total >= 2000 AND rk <= 40 THEN 'kept' ELSE 'dust' END AS bucket FROM k)
    SELECT day, account, cast(relay AS bigint) AS relay, cast(hub AS bigint) AS hub, 1::bigint AS members, bucket FROM b WHERE bucket = 'kept' UNION ALL
    SELECT day, NULL, cast(coalesce(sum(relay) FILTER (bucket = 'dust'), 0) AS bigint), cast(coalesce(sum(hub) FILTER (bucket = 'dust'), 0) AS bigint), count(*) FILTER (bucket = 'dust'), 'dust' FROM b GROUP BY day""",
)
def day_with_dust(spark, folder):
    out = B.day_with_dust(settle(legs2(spark, folder), "day-accounts"), "day", "account", ["relay", "hub"], 2000)
    return out.select("day", "account", *LONG("relay", "hub"), "members", "bucket")


@query(
    "a28_cohort_days",
    f"""WITH {FRAMES_SQL}, c AS (SELECT account FROM frames GROUP BY account HAVING sum(amount) > 300000), h AS (SELECT * FROM legs2 WHERE account IN (SELECT account FROM c)),
    k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total DESC, account) AS rk FROM h)
    SELECT day, cast(coalesce(sum(relay), 0) AS bigint) AS relay, cast(coalesce(sum(hub), 0) AS bigint) AS hub, cast(sum(total) AS bigint) AS total, count(*) FILTER (total > 0) AS nonzero,
      cast(sum(total) FILTER (rk <= 10) AS bigint) AS top_ten FROM k GROUP BY day""",
)
def cohort_days(spark, folder):
    cohort = leg_frames(spark, folder).groupBy("account").agg(F.sum("amount").alias("s")).filter("s > 300000")
    out = B.cohort_days(settle(legs2(spark, folder), "day-accounts"), cohort, "day", "account", ["relay", "hub"])
    return out.select("day", *LONG("relay", "hub", "total", "top_ten"), "nonzero")


@query(
    "a28_cohort_holders",
    f"""WITH {FRAMES_SQL}, c AS (SELECT account FROM frames GROUP BY account HAVING sum(amount) > 300000)
    SELECT day, account, leg, cast(sum(amount) AS bigint) AS amount FROM frames WHERE leg IS NOT NULL AND account IN (SELECT account FROM c) GROUP BY ALL HAVING sum(amount) <> 0""",
)
def cohort_holders(spark, folder):
    cohort = leg_frames(spark, folder).groupBy("account").agg(F.sum("amount").alias("s")).filter("s > 300000")
    return B.cohort_holders(legs2(spark, folder), cohort, "day", "account", ["relay", "hub"]).select("day", "account", "leg", *LONG("amount"))


def observations(spark, folder):
    return leg_frames(spark, folder).select(F.col("account").alias("address"), "block", F.col("amount").alias("balance"), "day")


@query(
    "a29_archive_addresses",
    f"""WITH {FRAMES_SQL} SELECT account AS address, arg_max(amount, block) AS last, max(amount) AS peak, min(day) AS first_day, max(day) AS last_day, count(*) AS observations
    FROM frames GROUP BY account HAVING arg_max(amount, block) > 1000""",
)
def archive_addresses(spark, folder):
    out = B.archive_addresses(observations(spark, folder), 1000)
    return out.select("address", *LONG("last", "peak"), "first_day", "last_day", "observations")


@query(
    "w07_clipped_peaks",
    f"""WITH {FRAMES_SQL}, d AS (SELECT account, day, arg_max(amount, block) AS b FROM frames GROUP BY ALL), p AS (SELECT account, max(b) AS dp FROM d GROUP BY account)
    SELECT account AS address, max(amount) AS peak, max(dp) AS daily_peak, (max(amount)::double - max(dp)::double) / max(amount)::double AS clipped FROM frames JOIN p USING (account) GROUP BY account""",
)
def clipped_peaks(spark, folder):
    return B.clipped_peaks(observations(spark, folder)).select("address", *LONG("peak", "daily_peak"), "clipped")


AXIS_SQL = "axis AS (SELECT cast(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS date) AS day FROM closes)"
CLOSES_SQL = f"{FRAMES_SQL}, closes AS (SELECT account, day, arg_max(amount, block) AS balance FROM frames GROUP BY ALL), {AXIS_SQL}, ids AS (SELECT DISTINCT account FROM closes), dense AS (SELECT ids.account, axis.day, balance FROM ids CROSS JOIN axis LEFT JOIN closes USING (account, day))"


def sparse_closes(spark, folder):
    rows = leg_frames(spark, folder).select("account", "block", F.col("amount").alias("balance"), "day")
    return B.day_closes(rows, "account")


def dense_closes(spark, folder):
    closes = sparse_closes(spark, folder)
    return A.dense(closes, "day", {}, closes.select("account").distinct())


@query(
    "w04_filled_forward",
    f"""WITH {CLOSES_SQL} SELECT account, day AS from_day, cast(coalesce(lead(day) OVER (PARTITION BY account ORDER BY day) - INTERVAL 1 DAY, (SELECT max(day) FROM closes)) AS date) AS to_day,
      cast(balance AS bigint) AS balance FROM closes""",
)
def filled_forward(spark, folder):
    """Carried forward as intervals: a row for each close, not for each account and day."""
    return A.carried(sparse_closes(spark, folder), ["account"], "day").select("account", "from_day", "to_day", *LONG("balance"))


PRESENT_SQL = f"{CLOSES_SQL}, present AS (SELECT day FROM frames GROUP BY day HAVING max(amount) > 25000)"
ZERO_SQL = f"""{PRESENT_SQL}, firsts AS (SELECT account, min(day) FILTER (balance IS NOT NULL) AS f FROM dense GROUP BY account),
zeroed AS (SELECT account, day, CASE WHEN day NOT IN (SELECT day FROM present) THEN NULL WHEN day < f THEN NULL ELSE cast(coalesce(balance, 0) AS bigint) END AS balance FROM dense JOIN firsts USING (account))"""


def covered_days(spark, folder):
    """Days count as read if their largest amount is above a bar; every event is looked at."""
    return leg_frames(spark, folder).groupBy("day").agg(F.max("amount").alias("most"), F.sum("amount").cast("bigint").alias("total")).filter("most > 25000")


def zeroed(spark, folder):
    read = covered_days(spark, folder).select("day").withColumn("present", F.lit(True))
    rows = dense_closes(spark, folder).join(read, "day", "left").fillna({"present": False})
    return A.zero_after_first(rows, ["account"], "day", "balance", "present").select("account", "day", *LONG("balance"))


@query("w05_zero_after_dropout", f"WITH {ZERO_SQL} SELECT account, day, balance FROM zeroed")
def zero_after_dropout(spark, folder):
    return zeroed(spark, folder)


@query(
    "w06_peaks",
    f"""WITH {ZERO_SQL} SELECT account, max(balance) AS peak, arg_min(day, (-balance, day)) FILTER (balance IS NOT NULL) AS peak_on, arg_max(balance, day) FILTER (balance IS NOT NULL) AS last,
      max(day) FILTER (balance IS NOT NULL) AS last_on FROM zeroed GROUP BY account""",
)
def peaks(spark, folder):
    closes = sparse_closes(spark, folder).select("account", "day", *LONG("balance"))
    return A.sparse_peaks(closes, covered_days(spark, folder), "account", "day", "balance")


@query(
    "g02_dense_with_missing",
    f"""WITH {FRAMES_SQL}, closes AS (SELECT day, sum(amount) AS total FROM frames GROUP BY day HAVING max(amount) > 25000), {AXIS_SQL}
    SELECT day, cast(total AS bigint) AS total, total IS NULL AS missing FROM axis LEFT JOIN closes USING (day)""",
)
def dense_with_missing(spark, folder):
    daily = covered_days(spark, folder).select("day", "total")
    return A.dense(daily, "day", {}).withColumn("missing", F.col("total").isNull())


@query(
    "w11_missing_days",
    f"WITH {FRAMES_SQL}, closes AS (SELECT day FROM frames GROUP BY day HAVING max(amount) > 25000), {AXIS_SQL} SELECT day FROM axis WHERE day NOT IN (SELECT day FROM closes)",
)
def missing_days(spark, folder):
    return A.missing_days(covered_days(spark, folder), "day")


@query(
    "j11_archive_scores",
    f"""WITH {FRAMES_SQL}, mine AS (SELECT day, account, relay FROM legs2 WHERE relay IS NOT NULL), pairs AS (SELECT day, account, relay, relay // 100 * 100 AS archived FROM mine),
    s AS (SELECT *, CASE WHEN archived = 0 THEN CASE WHEN relay = 0 THEN 0.0::double ELSE 1.0::double END ELSE abs(relay::double - archived::double) / archived::double END AS deviation, abs(relay - archived) AS gap,
      CASE WHEN day = (SELECT max(day) FROM pairs) THEN 'tail' ELSE 'body' END AS part FROM pairs)
    SELECT part, count(*) AS pairs, percentile_disc(0.5) WITHIN GROUP (ORDER BY deviation DESC) AS median, count(*) FILTER (deviation > 0.0001) AS over, max(deviation) AS max,
      cast(max(gap) AS bigint) AS max_gap, count(*) FILTER (gap > 50) AS beyond_quantum FROM s GROUP BY part""",
)
def archive_scores(spark, folder):
    out = B.archive_scores(archived_pairs(spark, folder), "day", 50.0)
    return out.withColumn("max_gap", F.col("max_gap").cast("bigint"))


def archived_pairs(spark, folder):
    """The archive keeps whole units only."""
    mine = settle(legs2(spark, folder), "day-accounts")
    archived = mine.select("day", "account", (F.floor(F.col("relay") / 100) * 100).alias("value"))
    return B.archive_pairs(mine.select("day", "account", "relay"), archived, ["day", "account"])


@query(
    "t02_worst_archive_gaps",
    f"""WITH {FRAMES_SQL}, pairs AS (SELECT day, account, relay, relay // 100 * 100 AS archived FROM legs2 WHERE relay IS NOT NULL)
    SELECT day, account, cast(relay - archived AS bigint) AS gap FROM pairs ORDER BY gap DESC, day, account LIMIT 5""",
)
def worst_archive_gaps(spark, folder):
    return B.worst_pairs(archived_pairs(spark, folder), "gap", ["day", "account"]).select("day", "account", *LONG("gap"))


@query(
    "j12_close_of_day",
    "SELECT event_type AS chain, cast(ts AS date) AS day, max(event_id) AS block, epoch_us(arg_max(ts, event_id)) AS at_us FROM events GROUP BY ALL",
)
def close_of_day(spark, folder):
    blocks = T.table(spark, folder, "events").select(
        F.col("event_type").alias("chain"), F.to_date("ts").alias("day"), F.col("event_id").alias("block"), F.col("ts").cast("timestamp").alias("at")
    )
    return B.close_of_day(blocks, "chain", "day", "block", "at").select("chain", "day", "block", F.unix_micros("at").alias("at_us"))


@query(
    "j13_day_ranges",
    "WITH f AS (SELECT event_type AS chain, cast(ts AS date) AS day, min(event_id) AS from_block FROM events GROUP BY ALL) SELECT *, lead(from_block) OVER (PARTITION BY chain ORDER BY day) AS to_block FROM f",
)
def day_ranges(spark, folder):
    blocks = T.table(spark, folder, "events").select(F.col("event_type").alias("chain"), F.to_date("ts").alias("day"), F.col("event_id").alias("block"))
    return B.day_ranges(blocks, "chain", "day", "block")


@query(
    "u03_sticky_ids",
    f"""WITH {FRAMES_SQL}, f AS (SELECT account, min(day) AS first_seen FROM frames GROUP BY account)
    SELECT account, first_seen, (SELECT max(day) FROM frames) AS listed_until FROM f""",
)
def sticky_ids(spark, folder):
    return B.sticky_ids(leg_frames(spark, folder), "account", "day")


@query(
    "w14_largest_before",
    f"""WITH {FRAMES_SQL}, d AS (SELECT day, max(hub) AS v FROM legs2 GROUP BY day)
    SELECT (SELECT day FROM d WHERE day < DATE '2024-01-20' ORDER BY v DESC NULLS LAST, day LIMIT 1) AS day, cast(max(v) FILTER (day < DATE '2024-01-20') AS bigint) AS largest,
      max(v) FILTER (day < DATE '2024-01-20')::double / max(v)::double AS share, count(*) FILTER (day < DATE '2024-01-20') AS days_before FROM d""",
)
def largest_before(spark, folder):
    daily = legs2(spark, folder).groupBy("day").agg(F.max("hub").alias("v"))
    return B.largest_before(daily, "day", "v", "2024-01-20").withColumn("largest", F.col("largest").cast("bigint"))


CUT, TAIL = datetime.date(2001, 1, 1), datetime.date(2000, 11, 1)

HISTORY_SQL = f"""
od AS (SELECT cast(o_orderdate AS date) AS day, count(*) AS trades, cast(count(*) * 2 AS bigint) AS legs, cast(sum(cast(o_totalprice AS decimal(18,4))) AS double) AS usd FROM orders GROUP BY ALL),
history AS (SELECT day, trades, legs, usd, 'stored' AS origin FROM od WHERE day < DATE '{CUT}' UNION ALL
  SELECT day, trades, NULL, NULL, 'tail' FROM od WHERE day >= DATE '{TAIL}' AND day NOT IN (SELECT day FROM od WHERE day < DATE '{CUT}')),
closes AS (SELECT day FROM history), {AXIS_SQL}, full_days AS (SELECT axis.day, trades, legs, usd, origin FROM axis LEFT JOIN history USING (day))"""


def history(spark, folder):
    """Stored days up to a cut carry everything; the live tail overlaps them and carries counts only."""
    daily = T.table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("trades"), (F.count(F.lit(1)) * 2).alias("legs"), S.dbl(F.sum(S.money(F.col("o_totalprice")))).alias("usd")
    )
    stored = daily.filter(F.col("day") < F.lit(CUT))
    tail = daily.filter(F.col("day") >= F.lit(TAIL)).select(
        "day", "trades", F.lit(None).cast("bigint").alias("legs"), F.lit(None).cast("double").alias("usd")
    )
    return A.prefer(stored, tail, ["day"], "stored")


@query("u01_stored_and_tail", f"WITH {HISTORY_SQL} SELECT day, trades, legs, usd, origin FROM history")
def stored_and_tail(spark, folder):
    return history(spark, folder)


@query(
    "u01_tail_wins",
    f"""WITH {HISTORY_SQL} SELECT day, trades, CASE WHEN day >= DATE '{TAIL}' THEN 'tail' ELSE 'stored' END AS origin FROM od WHERE day < DATE '{CUT}' OR day >= DATE '{TAIL}'""",
)
def tail_wins(spark, folder):
    daily = T.table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("trades"))
    return A.prefer(daily.filter(F.col("day") < F.lit(CUT)), daily.filter(F.col("day") >= F.lit(TAIL)), ["day"], "tail")


@query(
    "a36_months",
    f"""WITH {HISTORY_SQL} SELECT strftime(day, '%Y-%m') AS month, count(*) AS days, count(trades) AS present, count(*) FILTER (origin = 'stored') AS stored, count(*) FILTER (origin = 'tail') AS counted,
      cast(coalesce(sum(trades), 0) AS bigint) AS trades, cast(coalesce(sum(legs), 0) AS bigint) AS legs, cast(sum(cast(usd AS decimal(28,4))) AS double) AS usd, count(usd) AS usd_days FROM full_days GROUP BY ALL""",
)
def months(spark, folder):
    days = A.dense(history(spark, folder), "day", {}).withColumn("usd", F.col("usd").cast("decimal(28,4)"))
    return A.month_rollup(days, "day").withColumn("usd", S.dbl(F.col("usd")))


@query(
    "a37_series_totals",
    f"""WITH {HISTORY_SQL} SELECT count(*) AS days, count(*) FILTER (trades IS NULL) AS missing, count(*) FILTER (day < DATE '1995-02-01') AS before_floor,
      (SELECT day FROM full_days ORDER BY trades DESC NULLS LAST, day LIMIT 1) AS busiest_day, max(trades) AS busiest_trades,
      sum(legs) FILTER (legs IS NOT NULL) / sum(trades) FILTER (legs IS NOT NULL) AS leg_inflation, count(legs) AS inflation_days FROM full_days""",
)
def series_totals(spark, folder):
    days = A.dense(history(spark, folder), "day", {})
    with_legs = F.col("legs").isNotNull()
    busiest = F.max_by(F.when(F.col("trades").isNotNull(), F.col("day")), F.when(F.col("trades").isNotNull(), F.struct(F.col("trades"), -F.unix_date("day"))))
    return days.agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("trades").isNull()).alias("missing"),
        F.count_if(F.col("day") < F.lit(datetime.date(1995, 2, 1))).alias("before_floor"),
        busiest.alias("busiest_day"),
        F.max("trades").alias("busiest_trades"),
        (F.sum("legs") / F.sum(F.when(with_legs, F.col("trades")))).alias("leg_inflation"),
        F.count("legs").alias("inflation_days"),
    )


MONTHS_SQL = """
span AS (SELECT min(cast(o_orderdate AS date)) AS lo, max(cast(o_orderdate AS date)) AS hi FROM orders),
m AS (SELECT cast(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS date) AS first_day FROM span)"""


@query(
    "g03_month_frames",
    f"WITH {MONTHS_SQL} SELECT strftime(first_day, '%Y-%m') AS month, first_day, last_day(first_day) AS last_day, cast(day(last_day(first_day)) AS bigint) AS days FROM m",
)
def month_frames(spark, folder):
    return A.months_between(T.table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day")), "day")


@query(
    "r02_settled_months",
    f"""WITH {MONTHS_SQL} SELECT strftime(first_day, '%Y-%m') AS month, TIMESTAMP '2001-05-01 02:00:00' >= last_day(first_day) + INTERVAL 1 DAY + INTERVAL 2 HOUR
      AND (SELECT hi FROM span) >= last_day(first_day) + INTERVAL 1 DAY AS settled FROM m""",
)
def settled_months(spark, folder):
    rows = T.table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day"))
    head = rows.agg(F.max("day").cast("timestamp").alias("h")).scalar()
    frames = A.months_between(rows, "day").withColumn("__head", head)
    out = A.settled_months(frames, F.lit("2001-05-01 02:00:00").cast("timestamp"), F.col("__head"), 2)
    return out.select("month", "settled")


@query(
    "r02_settled_by_source",
    """WITH o AS (SELECT DISTINCT n_name AS source, CASE WHEN o_orderpriority LIKE '1%' THEN strftime(o_orderdate, '%Y-%m') WHEN o_orderpriority LIKE '2%' THEN strftime(o_orderdate, '%Y-0%m') ELSE strftime(o_orderdate, '%Y-%m') END AS month
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
    f AS (SELECT n_name AS source, CAST(make_date(1993 + cast(n_regionkey AS int), 3, 1) AS date) AS floor FROM nation WHERE n_nationkey % 5 <> 4),
    h AS (SELECT max(o_orderdate) AS head FROM orders),
    c AS (SELECT o.*, floor, head, f.source IS NULL AS unknown, regexp_matches(month, '^[0-9]{4}-(0[1-9]|1[0-2])$') AS good, CASE WHEN good THEN cast(month || '-01' AS date) END AS first FROM o LEFT JOIN f ON o.source = f.source, h)
    SELECT source, month, CASE WHEN unknown THEN 'unknown source' WHEN NOT good THEN 'malformed month' WHEN first < floor THEN 'below floor' END AS refused,
      coalesce(refused IS NULL AND TIMESTAMP '1998-02-01 02:00:00' >= first + INTERVAL 1 MONTH + INTERVAL 2 HOUR AND head >= first + INTERVAL 1 MONTH, false) AS settled FROM c""",
)
def settled_by_source(spark, folder):
    """Nations as sources with a floor by region, one in five without; months of urgent orders come malformed. The clock stands at 1998-02-01 02:00."""
    orders, customer, nation = (T.table(spark, folder, n) for n in ("orders", "customer", "nation"))
    name = F.when(F.col("o_orderpriority").startswith("2"), F.date_format("o_orderdate", "yyyy-0MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    months = (
        orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select("c_nationkey", name.alias("month")).distinct()
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("source"), "month")
    )
    floors = nation.filter(F.col("n_nationkey") % 5 != 4).select(F.col("n_name").alias("source"), F.make_date(F.lit(1993) + F.col("n_regionkey").cast("int"), F.lit(3), F.lit(1)).alias("floor"))
    head = orders.agg(F.max("o_orderdate").cast("timestamp").alias("h")).scalar()
    out = A.settled_months(months.withColumn("__head", head), F.lit("1998-02-01 02:00:00").cast("timestamp"), F.col("__head"), 2, floors)
    return out.select("source", "month", "refused", "settled")


def holder_frames(spark, folder):
    """Suppliers hold what they shipped of a part; suppliers of region 0 are sovereign accounts of their nation."""
    li, supplier, nation, part = (T.table(spark, folder, n) for n in ("lineitem", "supplier", "nation", "part"))
    qty = F.col("l_quantity").cast(MICRO)
    holders = (
        li.groupBy(F.col("l_partkey").alias("asset"), F.col("l_suppkey").alias("s_suppkey"))
        .agg(F.sum(qty).alias("amount"))
        .join(supplier, "s_suppkey")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("asset", F.col("s_suppkey").alias("holder"), F.when(F.col("n_regionkey") == 0, F.col("n_name")).alias("chain"), "amount")
    )
    claims = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(qty).alias("q"), F.countDistinct("l_suppkey").alias("c"))
    size = F.col("p_size")
    assets = part.join(claims, "p_partkey").select(
        F.col("p_partkey").alias("asset"),
        F.when(size > 1, F.col("q") + F.when(size > 45, 5).when(size > 40, -3).otherwise(0)).alias("supply"),
        (F.col("c") + F.when(size == 2, 1).otherwise(0)).alias("claimed"),
        (size != 3).alias("complete"),
    )
    return assets, holders


HOLDERS_SQL = """
holders AS (SELECT l_partkey AS asset, l_suppkey AS holder, any_value(CASE WHEN n_regionkey = 0 THEN n_name END) AS chain, cast(sum(l_quantity) AS bigint) AS amount
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
claims AS (SELECT l_partkey, cast(sum(l_quantity) AS bigint) AS q, count(DISTINCT l_suppkey) AS c FROM lineitem GROUP BY ALL),
assets AS (SELECT p_partkey AS asset, CASE WHEN p_size > 1 THEN q + CASE WHEN p_size > 45 THEN 5 WHEN p_size > 40 THEN -3 ELSE 0 END END AS supply, c + CASE WHEN p_size = 2 THEN 1 ELSE 0 END AS claimed, p_size <> 3 AS complete FROM part JOIN claims ON l_partkey = p_partkey),
hs AS (SELECT asset, count(*) AS swept, count(DISTINCT chain) AS chains, cast(sum(amount) AS bigint) AS holder_sum, cast(coalesce(sum(amount) FILTER (chain IS NOT NULL), 0) AS bigint) AS sovereign_total FROM holders GROUP BY asset),
decomposed AS (SELECT asset, supply, swept, chains, holder_sum, sovereign_total, holder_sum - sovereign_total AS other_holders, supply - sovereign_total AS on_chain, supply - holder_sum AS unaccounted,
  CASE WHEN supply IS NOT NULL AND complete THEN holder_sum = supply END AS sum_matches, claimed = swept AS count_matches, supply - sovereign_total < 0 AS negative_residual FROM assets JOIN hs USING (asset))"""


@query("a24_holder_decomposition", f"WITH {HOLDERS_SQL} SELECT * FROM decomposed")
def holder_decomposition(spark, folder):
    out = B.decompose_holders(*holder_frames(spark, folder))
    return out.select(
        "asset", *LONG("supply", "swept", "chains", "holder_sum", "sovereign_total", "other_holders", "on_chain", "unaccounted"), "sum_matches", "count_matches", "negative_residual"
    )


@query(
    "q13_reconciliation",
    f"""WITH {HOLDERS_SQL} SELECT count(*) AS assets, count(*) FILTER (sum_matches) AS exact, count(*) FILTER (NOT sum_matches) AS mismatched, count(*) FILTER (sum_matches IS NULL) AS unchecked,
      count(*) FILTER (negative_residual) AS negative, count(*) FILTER (NOT count_matches) AS short_sweeps, count(*) FILTER (NOT sum_matches AND unaccounted < 0) AS over_accounted FROM decomposed""",
)
def reconciliation(spark, folder):
    return B.reconciliation(B.decompose_holders(*holder_frames(spark, folder)))


@query(
    "a25_holdings_per_chain",
    f"""WITH {HOLDERS_SQL} SELECT chain, count(DISTINCT asset) AS assets, count(DISTINCT p_name) AS symbols, count(DISTINCT CASE WHEN p_size > 45 THEN asset END) AS unscaled
    FROM holders JOIN part ON asset = p_partkey WHERE chain IS NOT NULL GROUP BY chain""",
)
def holdings_per_chain(spark, folder):
    tokens = T.table(spark, folder, "part").select(
        F.col("p_partkey").alias("asset"), F.col("p_name").alias("symbol"), F.when(F.col("p_size") <= 45, F.col("p_size")).alias("decimals")
    )
    return B.holdings_per_chain(holder_frames(spark, folder)[1], tokens)


@query(
    "a25_holdings_per_network",
    f"""WITH {HOLDERS_SQL} SELECT p_type AS network, count(*) AS assets, count(supply) AS with_supply, count(*) FILTER (p_size > 45) AS unscaled, count(DISTINCT p_name) AS symbols
    FROM assets JOIN part ON asset = p_partkey GROUP BY p_type""",
)
def holdings_per_network(spark, folder):
    """Part types as networks; the supplies are those that the holder sweep claims."""
    part = T.table(spark, folder, "part")
    tokens = part.select(F.col("p_partkey").alias("asset"), F.col("p_name").alias("symbol"), F.when(F.col("p_size") <= 45, F.col("p_size")).alias("decimals"))
    networks = part.select(F.col("p_partkey").alias("asset"), F.col("p_type").alias("network"))
    return B.holdings_per_network(holder_frames(spark, folder)[0].join(networks, "asset").select("network", "asset", "supply"), tokens)


@query(
    "a25_symbols_per_chain",
    f"""WITH {HOLDERS_SQL} SELECT chain, p_name AS symbol, count(DISTINCT asset) AS assets FROM holders JOIN part ON asset = p_partkey WHERE chain IS NOT NULL GROUP BY ALL""",
)
def symbols_per_chain(spark, folder):
    tokens = T.table(spark, folder, "part").select(F.col("p_partkey").alias("asset"), F.col("p_name").alias("symbol"))
    return B.symbols_per_chain(holder_frames(spark, folder)[1], tokens)


@query(
    "a26_sovereign_totals",
    """WITH r AS (SELECT strftime(l_shipdate, '%Y-%m') AS snapshot, l_suppkey, sum(l_quantity) FILTER (l_linestatus = 'F') AS relay, sum(l_quantity) FILTER (l_linestatus = 'O') AS hub, sum(l_quantity) AS total
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0 GROUP BY ALL),
    i AS (SELECT strftime(l_shipdate, '%Y-%m') AS snapshot, sum(l_quantity) AS issuance FROM lineitem GROUP BY ALL)
    SELECT snapshot, cast(coalesce(sum(relay), 0) AS bigint) AS relay, cast(coalesce(sum(hub), 0) AS bigint) AS hub, cast(sum(total) AS bigint) AS total, count(*) AS accounts,
      cast(any_value(issuance) AS bigint) AS issuance, sum(total) / any_value(issuance) * 100 AS share FROM r JOIN i USING (snapshot) GROUP BY snapshot""",
)
def sovereign_totals(spark, folder):
    li, supplier, nation = (T.table(spark, folder, n) for n in ("lineitem", "supplier", "nation"))
    rows = li.select(
        F.date_format("l_shipdate", "yyyy-MM").alias("snapshot"),
        F.col("l_suppkey").alias("s_suppkey"),
        F.when(F.col("l_linestatus") == "F", "relay").otherwise("hub").alias("leg"),
        F.col("l_quantity").cast(MICRO).alias("amount"),
    )
    issuance = rows.groupBy("snapshot").agg(F.sum("amount").alias("issuance"))
    sovereign = supplier.join(nation.filter("n_regionkey = 0"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey")
    legs = B.two_legs(rows.join(sovereign, "s_suppkey", "left_semi"), ["snapshot", "s_suppkey"], "relay", "hub", "amount")
    out = B.sovereign_totals(legs, "snapshot", ["relay", "hub"], issuance)
    return out.select("snapshot", *LONG("relay", "hub", "total", "issuance"), "accounts", "share")


@query(
    "s01_balance_csv",
    f"""WITH {FRAMES_SQL} SELECT 'u' || account AS address, block, amount AS balance, day FROM frames""",
)
def balance_csv(spark, folder):
    """Writes the events as a balance CSV with timestamps of mixed precision, then reads it with the checked header."""
    path = fresh_path(spark, "balances-csv")
    stamp = F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    T.table(spark, folder, "events").select(
        F.concat(F.lit("u"), "user_id").alias("address"),
        F.col("event_id").alias("block_number"),
        F.round(F.col("value") * 100).cast(MICRO).alias("balance"),
        stamp.alias("timestamp"),
    ).write.option("header", True).csv(path)
    return L.read_balances(spark, path).withColumn("balance", F.col("balance").cast("bigint"))


@query("s02_label_csv", "SELECT s_name AS name, 'nation ' || s_nationkey || ', id ' || s_suppkey AS address FROM supplier")
def label_csv(spark, folder):
    path = fresh_path(spark, "labels-csv")
    line = F.concat("s_name", F.lit(",nation "), "s_nationkey", F.lit(", id "), "s_suppkey")
    T.table(spark, folder, "supplier").select(line.alias("value")).write.text(path)
    return L.read_labels(spark, path)


@query(
    "s02_label_quality",
    """SELECT s_nationkey % 5 <> 0 AS usable, count(*) AS lines FROM supplier WHERE s_nationkey % 5 <> 1 GROUP BY ALL""",
)
def label_quality(spark, folder):
    """Lines of some nations lost their comma, those of others everything: the former are counted as not usable, blank lines are none."""
    path = fresh_path(spark, "labels-csv")
    group = F.col("s_nationkey") % 5
    line = F.when(group == 0, F.col("s_name")).when(group == 1, "  ").otherwise(F.concat("s_name", F.lit(",nation "), "s_nationkey"))
    T.table(spark, folder, "supplier").select(line.alias("value")).write.text(path)
    return L.read_label_lines(spark, path).groupBy("usable").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "s03_ndjson_blocks",
    """SELECT event_type AS name, event_type <> 'error' AS usable, count(*) AS blocks, count(DISTINCT event_id) AS numbers FROM events GROUP BY ALL""",
)
def ndjson_blocks(spark, folder):
    """Writes the events as blocks, one JSON object per line; error events lose their timestamp."""
    path = fresh_path(spark, "blocks")
    at = F.when(F.col("event_type") != "error", F.unix_millis(F.col("ts").cast("timestamp")))
    header = F.struct(F.col("event_id").alias("number"), at.alias("timestamp"))
    body = F.array(F.struct(F.col("event_type").alias("name"), F.col("props").alias("args")))
    T.table(spark, folder, "events").select(F.to_json(F.struct(header.alias("header"), body.alias("events"))).alias("value")).write.text(path)
    blocks = L.read_blocks(spark, path)
    return blocks.select("number", "usable", F.explode_outer("events").alias("e")).groupBy(F.col("e.name").alias("name"), "usable").agg(
        F.count(F.lit(1)).alias("blocks"), F.countDistinct("number").alias("numbers")
    )


@query(
    "s09_archive_dataset",
    f"WITH {FRAMES_SQL} SELECT cast(account % 5 AS bigint) AS network, count(*) AS days, cast(sum(coalesce(relay, 0)) AS bigint) AS relay FROM legs2 GROUP BY ALL",
)
def archive_dataset(spark, folder):
    path = fresh_path(spark, "archive")
    series = legs2(spark, folder).withColumn("network", F.col("account") % 5)
    L.write_series(series, path, "network")
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("network").cast("bigint").alias("network")).agg(
        F.count(F.lit(1)).alias("days"), F.sum(F.coalesce("relay", F.lit(0))).cast("bigint").alias("relay")
    )


@query(
    "s04_landing_coverage",
    """SELECT 'events' AS source, count(*) AS rows, max(event_id) + 1 AS claimed, count(*) = max(event_id) + 1 AS complete FROM events UNION ALL
    SELECT 'orders', count(*), max(o_orderkey) + 1, count(*) = max(o_orderkey) + 1 FROM orders UNION ALL SELECT 'lineitem', count(*), max(l_orderkey) + 1, count(*) = max(l_orderkey) + 1 FROM lineitem""",
)
def landing_coverage(spark, folder):
    ids = {"events": "event_id", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    tables = [(T.table(spark, folder, name), F.lit(name).alias("source"), key) for name, key in ids.items()]
    read = reduce(DataFrame.unionByName, [df.select(source) for df, source, _ in tables])
    claimed = reduce(DataFrame.unionByName, [df.agg((F.max(key) + 1).alias("expected")).select(source, "expected") for df, source, key in tables])
    return Q.count_check(read, claimed, ["source"], "expected").select("source", F.col("rows_read").alias("rows"), "claimed", "complete")

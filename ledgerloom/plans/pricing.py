"""Pricing, valuation and order queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import orders as O
from ..operators import pricing as P
from ..operators import ranking
from ..sources import tables as T
from .registry import query, six_sql

PEGGED = ("Brand#1", "Brand#2")

UPPER = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {0} DESC)"


def pricing_legs(spark, folder):
    """Each line states a price between its brand and its part name; an untaxed line hides its brand."""
    li, part = T.table(spark, folder, "lineitem"), T.table(spark, folder, "part")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        T.line_key().alias("id"),
        F.col("l_orderkey").alias("height"),
        F.when(F.col("l_tax") != 0, F.col("p_brand")).alias("in_symbol"),
        F.col("l_quantity").alias("in_amount"),
        F.col("p_name").alias("out_symbol"),
        F.col("l_extendedprice").alias("out_amount"),
    )


PRICING_LEGS_SQL = f"""
plegs AS MATERIALIZED (
  SELECT {T.LINE_KEY_SQL} AS id, l_orderkey AS height, CASE WHEN l_tax <> 0 THEN p_brand END AS in_symbol, l_quantity AS in_amount,
         p_name AS out_symbol, l_extendedprice AS out_amount
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def rates_sql(passes: int = 5, legs: str = "plegs") -> str:
    """Unrolled sweep; every pass adds the symbols it reaches. On these tables the third pass finds nothing more."""
    seed = " UNION ALL ".join(f"SELECT '{s}' AS symbol, 1.0::double AS rate, NULL::bigint AS observations, 0 AS pass" for s in PEGGED)
    parts = [f"""usable AS (SELECT * FROM {legs} WHERE in_symbol IS NOT NULL AND out_symbol IS NOT NULL AND in_amount > 0 AND out_amount > 0),
    r0 AS MATERIALIZED ({seed})"""]
    for p in range(1, passes + 1):
        parts.append(f"""r{p} AS MATERIALIZED (SELECT * FROM r{p - 1} UNION ALL
      SELECT symbol, {UPPER.format("price")} AS rate, count(*) AS observations, {p} AS pass FROM (
        SELECT out_symbol AS symbol, in_amount * i.rate / out_amount AS price FROM usable JOIN r{p - 1} i ON in_symbol = i.symbol ANTI JOIN r{p - 1} o ON out_symbol = o.symbol
        UNION ALL
        SELECT in_symbol, out_amount * o.rate / in_amount FROM usable JOIN r{p - 1} o ON out_symbol = o.symbol ANTI JOIN r{p - 1} i ON in_symbol = i.symbol)
      GROUP BY symbol)""")
    return ",\n    ".join(parts)


@query(
    "q01_derived_rates",
    f"WITH {PRICING_LEGS_SQL}, {rates_sql()} SELECT symbol, rate, observations, pass FROM r5",
)
def derived_rates(spark, folder):
    return P.derive_rates(pricing_legs(spark, folder), PEGGED)


@query(
    "q02_usable_legs",
    f"""WITH {PRICING_LEGS_SQL}, {rates_sql(0)} SELECT in_symbol, out_symbol, count(*) AS legs, max(in_amount) AS most_in
    FROM usable GROUP BY ALL""",
)
def usable_legs(spark, folder):
    legs = P.usable_legs(pricing_legs(spark, folder))
    return legs.groupBy("in_symbol", "out_symbol").agg(F.count(F.lit(1)).alias("legs"), F.max("in_amount").alias("most_in"))


SAMPLE_SQL = """span AS (SELECT min(height) AS lo, max(height) AS hi FROM plegs),
    sample AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY height, id) AS rank FROM (
      SELECT plegs.*, cast(floor((height - lo) / greatest(1, ceil((hi - lo + 1) / 5))) AS bigint) AS chunk FROM plegs, span))"""


@query(
    "q03_rate_sample",
    f"""WITH {PRICING_LEGS_SQL}, {SAMPLE_SQL} SELECT chunk, rank, id, height, in_symbol, out_symbol FROM sample WHERE rank <= 1000""",
)
def rate_sample(spark, folder):
    sample = P.rate_sample(pricing_legs(spark, folder), "height", "id")
    return sample.select("chunk", "rank", "id", "height", "in_symbol", "out_symbol")


@query(
    "q04_valued_trades",
    f"""WITH {PRICING_LEGS_SQL}, {rates_sql()} SELECT id, in_symbol, in_amount, in_amount * rate AS usd
    FROM plegs LEFT JOIN r5 ON in_symbol = symbol""",
)
def valued_trades(spark, folder):
    legs = pricing_legs(spark, folder)
    rates = P.derive_rates(legs, PEGGED)
    return P.value_input(legs.select("id", "in_symbol", "in_amount"), rates, "in_symbol", "in_amount")


NORMAL_SQL = """folded AS (
  SELECT order_id, min(account) AS account, min(operation) AS operation, count(*) FILTER (side = 'in') AS inputs,
    count(*) FILTER (side = 'out') AS outputs,
    arg_min(asset_id, (leg, leg_key)) FILTER (side = 'in') AS asset_in, arg_min(amount, (leg, leg_key)) FILTER (side = 'in') AS amount_in,
    arg_max(asset_id, (leg, leg_key)) FILTER (side = 'out') AS asset_out, arg_max(amount, (leg, leg_key)) FILTER (side = 'out') AS amount_out
  FROM legs GROUP BY order_id)"""


@query(
    "p01_routed_trades",
    f"""WITH {T.LEGS_SQL}, {NORMAL_SQL}
    SELECT order_id, account, operation AS venue, inputs, outputs, inputs + outputs AS hops, asset_in, amount_in, asset_out, amount_out
    FROM folded WHERE inputs > 0 AND outputs > 0""",
)
def routed_trades(spark, folder):
    return P.with_both_sides(P.normalise_routed(T.legs(spark, folder)))


@query(
    "p01_routed_quality",
    f"""WITH {T.LEGS_SQL}, {NORMAL_SQL}
    SELECT count(*) AS read, count(*) FILTER (inputs > 0 AND outputs > 0) AS kept,
      count(*) FILTER (inputs = 0 OR outputs = 0) AS without_balances, count(*) FILTER (inputs > 1 AND outputs > 0) AS many_inputs FROM folded""",
)
def routed_quality(spark, folder):
    return P.routed_quality(P.normalise_routed(T.legs(spark, folder)))


@query(
    "p02_initiation_venue",
    """WITH o AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'view' THEN ':x/1'
      WHEN event_type = 'click' THEN 'click:' || user_id ELSE event_type || '/' || event_id END AS operation FROM events)
    SELECT coalesce(nullif(split_part(split_part(operation, '/', 1), ':', 1), ''), 'Direct') AS venue, count(*) AS trades FROM o GROUP BY ALL""",
)
def initiation_venue(spark, folder):
    kind = F.col("event_type")
    operation = (
        F.when(kind == "error", "")
        .when(kind == "view", ":x/1")
        .when(kind == "click", F.concat(F.lit("click:"), "user_id"))
        .otherwise(F.concat(kind, F.lit("/"), "event_id"))
    )
    events = T.table(spark, folder, "events")
    return events.groupBy(S.initiation_venue(operation).alias("venue")).agg(F.count(F.lit(1)).alias("trades"))


@query(
    "p03_orders_as_trades",
    f"""WITH {T.LEGS_SQL}
    SELECT order_id, min(account) AS account, CASE min(order_status) WHEN 'F' THEN 'FILLED' WHEN 'P' THEN 'REFUNDED' END AS status,
      min(order_status) = 'P' AS failed, cast(sum(usd) FILTER (side = 'in') AS double) AS usd,
      count(*) FILTER (side = 'in' AND usd IS NULL) AS unpriced_legs, CASE WHEN min(order_status) <> 'O' THEN min(operation) END AS partner
    FROM legs GROUP BY order_id""",
)
def orders_as_trades(spark, folder):
    # The partner tag arrives as text in a zero-padded 32-byte word; orders without a status carry a stray byte.
    stray = F.when(F.col("order_status") == "O", F.lit("01")).otherwise(F.lit(""))
    word = F.concat(F.lit("0x"), F.rpad(F.concat(stray, F.hex("operation")), 64, "0"))
    status = F.when(F.col("order_status") == "F", "FILLED").when(F.col("order_status") == "P", "REFUNDED")
    legs = T.legs(spark, folder).withColumn("partner_hex", word).withColumn("status", status)
    return P.normalise_orders(legs).withColumn("usd", S.dbl(F.col("usd")))


@query(
    "p04_routed_value",
    f"""WITH {T.LEGS_SQL}
    SELECT order_id, count(*) AS in_legs, count(*) FILTER (usd IS NULL) AS unpriced_legs,
      CASE WHEN count(*) FILTER (usd IS NULL) = 0 THEN cast(sum(usd) AS double) END AS usd
    FROM legs WHERE side = 'in' GROUP BY order_id""",
)
def routed_value(spark, folder):
    return P.value_routed(T.legs(spark, folder)).withColumn("usd", S.dbl(F.col("usd")))


@query(
    "a08_account_flows",
    f"""WITH {T.LEGS_SQL}, f AS (
      SELECT account, asset_id, coalesce(sum(amount) FILTER (side = 'in'), 0) AS sent, coalesce(sum(amount) FILTER (side = 'out'), 0) AS received,
        cast(coalesce(sum(usd) FILTER (side = 'in'), 0) AS decimal(28,4)) AS su, cast(coalesce(sum(usd) FILTER (side = 'out'), 0) AS decimal(28,4)) AS ru,
        count(*) FILTER (side = 'in') AS legs_out, count(*) FILTER (side = 'out') AS legs_in, count(*) FILTER (amount IS NULL) AS unstated, count(usd) > 0 AS priced
      FROM legs GROUP BY ALL)
    SELECT account, asset_id, {six_sql("sent")} AS sent, {six_sql("received")} AS received,
      {six_sql("received - sent")} AS net,
      CASE WHEN priced THEN floor(cast(su AS double) * 100 + 0.5) / 100 END AS sent_usd,
      CASE WHEN priced THEN floor(cast(ru AS double) * 100 + 0.5) / 100 END AS received_usd,
      CASE WHEN priced THEN floor(cast(ru - su AS double) * 100 + 0.5) / 100 END AS net_usd, legs_out, legs_in, unstated, priced
    FROM f""",
)
def account_flows(spark, folder):
    return P.net_flows(T.legs(spark, folder))


@query(
    "q19_unknown_tokens",
    """SELECT l_partkey AS token, count(*) AS legs FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY l_partkey""",
)
def unknown_tokens(spark, folder):
    known = T.table(spark, folder, "part").filter("p_size > 10").select(F.col("p_partkey").alias("token"))
    legs = T.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("token"))
    return P.unknown_tokens(legs, known, "token")


@query(
    "q21_fees",
    f"""WITH {T.LEGS_SQL} SELECT leg_key, amount * fee_rate AS fee_amount, cast(usd AS double) * fee_rate AS fee_usd FROM legs""",
)
def fees(spark, folder):
    fee = P.fee_split(F.col("usd"), F.col("amount"), F.col("fee_rate"))
    return T.legs(spark, folder).select("leg_key", fee.alias("f")).select("leg_key", "f.*")


@query(
    "q22_exception_decimals",
    f"""WITH {T.MESSAGES_SQL}, d AS (SELECT id, symbol, raw_amount, CASE WHEN symbol = 'red widget' AND length(raw_amount) < 7 THEN 6
      WHEN symbol = 'small ring' AND length(raw_amount) < 6 THEN 2 ELSE decimals END AS used FROM messages)
    SELECT id, cast(used AS bigint) AS used, cast(raw_amount AS double) / pow(10.0, used) AS amount FROM d""",
)
def exception_decimals(spark, folder):
    rules = [("small ring", 6, 2), ("red widget", 7, 6)]
    used = P.with_exception_decimals(F.col("symbol"), F.col("raw_amount"), F.col("decimals"), rules)
    return T.messages(spark, folder).select(
        "id", used.cast("bigint").alias("used"), S.scale_amount(F.col("raw_amount"), used).alias("amount")
    )


def order_frames(spark, folder):
    """Orders with the customer's nation as source chain, and their lines as fills by supplier."""
    orders, customer = T.table(spark, folder, "orders"), T.table(spark, folder, "customer")
    nation, supplier = T.table(spark, folder, "nation"), T.table(spark, folder, "supplier")
    placed = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("c_name").alias("trader"),
            F.col("n_name").alias("source"),
            F.col("o_orderstatus").alias("status"),
            F.to_date("o_orderdate").alias("day"),
            F.col("o_totalprice").alias("total"),
        )
    )
    fills = (
        T.table(spark, folder, "lineitem")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("s_name").alias("filler"),
            F.col("n_name").alias("chain"),
            F.to_date("l_shipdate").alias("at"),
            T.line_key().alias("fill_key"),
            F.when(F.col("l_linestatus") == "F", "in").otherwise("out").alias("side"),
            F.col("l_quantity").alias("amount"),
        )
    )
    return placed, fills


ORDER_FRAMES_SQL = f"""
placed AS (SELECT o_orderkey AS order_id, c_name AS trader, n_name AS source, o_orderstatus AS status, cast(o_orderdate AS date) AS day, o_totalprice AS total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
fills AS (SELECT l_orderkey AS order_id, s_name AS filler, n_name AS chain, cast(l_shipdate AS date) AS filled_on, {T.LINE_KEY_SQL} AS fill_key,
    CASE WHEN l_linestatus = 'F' THEN 'in' ELSE 'out' END AS side, l_quantity AS amount
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


@query(
    "p09_drill_down",
    f"""WITH {ORDER_FRAMES_SQL} SELECT order_id, trader, source, status, day FROM placed
    WHERE status = 'F' AND (source = 'NATION_3' OR order_id IN (SELECT order_id FROM fills WHERE chain = 'NATION_3'))""",
)
def drill_down(spark, folder):
    placed, fills = order_frames(spark, folder)
    by_chain = O.drill_down(
        placed.withColumn("who", F.col("trader")).withColumn("trader", F.col("source")),
        fills.withColumn("filler", F.col("chain")),
        address="Nation_3",
        status="F",
    )
    return by_chain.select("order_id", F.col("who").alias("trader"), "source", "status", "day")


@query(
    "p10_drill_rows",
    f"""WITH {ORDER_FRAMES_SQL}, f AS (SELECT order_id, count(*) FILTER (side = 'out') AS fills, count(*) FILTER (side = 'in') AS inputs,
      sum(amount) FILTER (side = 'in') AS ai, sum(amount) FILTER (side = 'out') AS ao,
      arg_min(filler, (filled_on, fill_key)) FILTER (side = 'out') AS first_filler, min(filled_on) FILTER (side = 'out') AS first_at,
      arg_min(chain, (filled_on, fill_key)) FILTER (side = 'out') AS first_chain FROM fills GROUP BY order_id)
    SELECT order_id, trader, source, status, day, coalesce(fills, 0) AS fills, coalesce(inputs, 0) AS inputs, first_filler,
      date_diff('day', day, first_at) AS latency_days, CASE WHEN ai > 0 THEN ao / ai END AS implied_rate, first_chain <> source AS cross_chain
    FROM placed LEFT JOIN f USING (order_id)""",
)
def drill_rows(spark, folder):
    return O.drill_rows(*order_frames(spark, folder))


@query(
    "a16_facets",
    f"""WITH {T.MESSAGES_SQL} SELECT facet, value, count(*) AS n FROM (
      SELECT 'kind' AS facet, coalesce(kind, 'unrecorded') AS value FROM messages UNION ALL
      SELECT 'outcome', coalesce(outcome, 'unrecorded') FROM messages UNION ALL
      SELECT 'match_status', coalesce(match_status, 'unrecorded') FROM messages) GROUP BY ALL""",
)
def facets(spark, folder):
    return O.facets(T.messages(spark, folder), ["kind", "outcome", "match_status"])


def page_rows(spark, folder):
    li, orders = T.table(spark, folder, "lineitem"), T.table(spark, folder, "orders")
    usd = F.when(F.col("l_tax") != 0, S.money(F.col("l_extendedprice") * (1 - F.col("l_discount"))))
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        usd.alias("usd"),
        (S.dbl(usd) * F.col("l_tax")).alias("fee_usd"),
        F.col("o_custkey").alias("trader"),
        F.col("l_suppkey").alias("filler"),
        T.status_of(F.col("o_orderstatus"), F.col("l_linestatus")).alias("status"),
        F.when(days >= 0, days).cast("bigint").alias("latency"),
        F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice")).alias("indexer_usd"),
    )


PAGE_ROWS_SQL = """
page AS (SELECT *, CASE WHEN l_tax <> 0 THEN cast(cast(usd AS double) * l_tax AS decimal(18,6)) END AS fee_usd FROM (
  SELECT *, CASE WHEN l_tax <> 0 THEN cast(l_extendedprice * (1 - l_discount) AS decimal(18,4)) END AS usd,
    CASE WHEN o_orderstatus = 'F' THEN 'FILLED' WHEN o_orderstatus = 'P' AND l_linestatus = 'F' THEN 'REFUNDED' WHEN o_orderstatus = 'P' THEN 'PLACED' END AS status,
    CASE WHEN cast(l_shipdate AS date) >= cast(o_orderdate AS date) THEN date_diff('day', cast(o_orderdate AS date), cast(l_shipdate AS date)) END AS latency,
    CASE WHEN o_totalprice < 400000 THEN cast(o_totalprice AS decimal(18,4)) END AS indexer_usd
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


@query(
    "a17_order_page_summary",
    f"""WITH {PAGE_ROWS_SQL} SELECT count(*) AS rows, cast(coalesce(sum(usd), 0) AS double) AS usd, count(*) FILTER (usd IS NULL) AS unpriced,
      cast(coalesce(sum(fee_usd), 0) AS double) AS fee_usd, count(DISTINCT o_custkey) AS traders, count(DISTINCT l_suppkey) AS fillers,
      count(*) FILTER (status = 'FILLED') AS filled, count(*) FILTER (status = 'REFUNDED') AS refunded, count(*) FILTER (status IS NULL) AS without_status,
      {UPPER.format("latency")} AS median_latency FROM page""",
)
def order_page_summary(spark, folder):
    return O.page_summary(page_rows(spark, folder))


@query(
    "a19_volume_comparison",
    f"""WITH {PAGE_ROWS_SQL} SELECT cast(coalesce(sum(usd), 0) AS double) AS order_sum, cast(coalesce(sum(fee_usd), 0) AS double) AS dust_usd,
      cast(coalesce(sum(fee_usd), 0) * 2000 AS double) AS headline_usd, count(fee_usd) AS priced_fees, count(*) FILTER (fee_usd IS NULL) AS unpriced_fees,
      cast(coalesce(sum(indexer_usd), 0) AS double) AS indexer_usd, count(indexer_usd) AS indexer_priced, count(*) FILTER (indexer_usd IS NULL) AS indexer_zero FROM page""",
)
def volume_comparison(spark, folder):
    return O.volume_comparison(page_rows(spark, folder))


@query(
    "a18_address_profiles",
    f"""WITH {ORDER_FRAMES_SQL},
    p AS (SELECT trader AS address, count(*) AS placed, sum(cast(total AS decimal(18,4))) FILTER (total < 400000) AS usd, count(*) FILTER (total >= 400000) AS unpriced,
      count(*) FILTER (status = 'P') AS refunded, min(day) AS f, max(day) AS l FROM placed GROUP BY ALL),
    c AS (SELECT trader AS address, string_agg(status || ' ' || n, ' / ' ORDER BY n DESC, status) AS chains
      FROM (SELECT trader, status, count(*) AS n FROM placed GROUP BY ALL) GROUP BY ALL),
    q AS (SELECT filler AS address, count(DISTINCT order_id) AS filled FROM fills GROUP BY ALL)
    SELECT address, coalesce(placed, 0) AS placed, coalesce(filled, 0) AS filled, cast(coalesce(usd, 0) AS double) AS placed_usd,
      coalesce(unpriced, 0) AS placed_unpriced, coalesce(refunded, 0) AS placed_refunded, f AS placed_first, l AS placed_last, chains AS placed_chains
    FROM p LEFT JOIN c USING (address) FULL JOIN q USING (address)""",
)
def address_profiles(spark, folder):
    placed, fills = order_frames(spark, folder)
    trades = placed.select(
        "trader",
        F.col("status").alias("chain"),
        "day",
        (F.col("status") == "P").alias("failed"),
        F.when(F.col("total") < 400000, S.money(F.col("total"))).alias("usd"),
    )
    return O.address_profiles(trades, fills)


@query(
    "w13_status_timeline",
    """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step,
      lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations""",
)
def status_timeline(spark, folder):
    return O.timeline(T.table(spark, folder, "conversations"), "conv_id", "turn", "role")


@query(
    "j09_semi_and_anti",
    """SELECT c_custkey, c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_pending FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
      AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)""",
)
def semi_and_anti(spark, folder):
    customer = T.table(spark, folder, "customer").select("c_custkey", "c_name")
    orders = T.table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    pending = orders.filter("o_orderstatus = 'P'").select("c_custkey").distinct().withColumn("has_pending", F.lit(True))
    return (
        customer.join(orders.filter("o_orderpriority = '1-URGENT'"), "c_custkey", "left_semi")
        .join(orders.filter("o_totalprice > 480000"), "c_custkey", "left_anti")
        .join(pending, "c_custkey", "left")
        .fillna({"has_pending": False})
    )

"""Capital, reserve, pool and peg queries. The snapshot is the month a line shipped in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import capital as C
from ..sources import tables as T
from .registry import query, six_sql

MONTH = "strftime(l_shipdate, '%Y-%m')"
D = lambda x: f"cast({x} AS double)"


def positions(spark, folder):
    li, part = T.table(spark, folder, "lineitem"), T.table(spark, folder, "part")
    usd = F.when(F.col("l_tax") != 0, S.money(F.col("l_extendedprice") * (1 - F.col("l_discount"))))
    borrowed = F.when(F.col("l_linestatus") == "O", (F.col("l_extendedprice") * F.col("l_discount")).cast(S.MONEY))
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.date_format("l_shipdate", "yyyy-MM").alias("snapshot"),
        F.col("l_returnflag").alias("venue"),
        F.col("p_brand").alias("asset"),
        F.col("l_quantity").alias("amount"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity") - 1).alias("net_amount"),
        usd.alias("usd"),
        borrowed.alias("borrowed_usd"),
        (F.col("p_type") == "PROMO").alias("derived"),
        F.col("p_type").alias("path"),
    )


POSITIONS_SQL = f"""
positions AS (SELECT {MONTH} AS snapshot, l_returnflag AS venue, p_brand AS asset, l_quantity AS amount, CASE WHEN l_linestatus = 'O' THEN l_quantity - 1 END AS net_amount,
    CASE WHEN l_tax <> 0 THEN cast(l_extendedprice * (1 - l_discount) AS decimal(18,4)) END AS usd,
    CASE WHEN l_linestatus = 'O' THEN cast(l_extendedprice * l_discount AS decimal(18,4)) END AS borrowed_usd, p_type = 'PROMO' AS derived, p_type AS path
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(
    "a22_capital_by_venue",
    f"""WITH {POSITIONS_SQL}, s AS (SELECT snapshot, venue, grouping(venue) = 1 AS is_total, count(*) AS positions, count(*) FILTER (usd IS NULL) AS unpriced, coalesce(sum(usd), 0) AS g,
      coalesce(sum(usd) FILTER (derived), 0) AS de, coalesce(sum(usd) FILTER (NOT derived), 0) AS di, coalesce(sum(borrowed_usd) FILTER (NOT derived AND usd IS NOT NULL), 0) AS b
      FROM positions GROUP BY GROUPING SETS ((snapshot, venue), (snapshot)))
    SELECT snapshot, venue, is_total, positions, unpriced, {D("g")} AS gross, {D("de")} AS derived_usd, {D("di")} AS distinct_usd, {D("b")} AS borrowed, {D("di - b")} AS net FROM s""",
)
def capital_by_venue(spark, folder):
    return C.capital_by_venue(positions(spark, folder), "snapshot")


@query(
    "a23_capital_by_asset",
    f"""WITH {POSITIONS_SQL} SELECT snapshot, asset, {D("coalesce(sum(usd - coalesce(borrowed_usd, 0)), 0)")} AS net, {D("coalesce(sum(usd), 0)")} AS gross, coalesce(sum(coalesce(net_amount, amount)) FILTER (usd IS NOT NULL), 0) AS net_amount, coalesce(sum(amount) FILTER (usd IS NOT NULL), 0) AS gross_amount,
      count(*) FILTER (usd IS NULL) AS unpriced, count(DISTINCT venue) AS venues FROM positions WHERE NOT derived GROUP BY ALL""",
)
def capital_by_asset(spark, folder):
    return C.capital_by_asset(positions(spark, folder), "snapshot")


@query(
    "q12_supply_check",
    f"""WITH {POSITIONS_SQL}, h AS (SELECT snapshot, asset, sum(amount) FILTER (usd IS NOT NULL) AS gross_amount, sum(amount) FILTER (usd IS NOT NULL AND borrowed_usd IS NULL) AS net_amount, sum(amount) FILTER (venue <> 'R') AS issued
      FROM positions WHERE NOT derived GROUP BY ALL)
    SELECT snapshot, asset, {six_sql("net_amount / issued")} AS net_share, {six_sql("gross_amount / issued")} AS gross_share,
      {six_sql("net_amount / issued")} > 1.02 AS over_net, {six_sql("gross_amount / issued")} > 1.02 AS over_gross FROM h WHERE issued > 0""",
)
def supply_check(spark, folder):
    rows = positions(spark, folder).filter(~F.col("derived"))
    exact = lambda condition: S.dbl(F.sum(F.when(condition, F.col("amount").cast("decimal(28,6)"))))
    priced = F.col("usd").isNotNull()
    held = rows.groupBy("snapshot", "asset").agg(
        exact(priced).alias("gross_amount"), exact(priced & F.col("borrowed_usd").isNull()).alias("net_amount")
    )
    issued = rows.groupBy("snapshot", "asset").agg(exact(F.col("venue") != "R").alias("issued"))
    return C.supply_check(held, issued, ["snapshot", "asset"])


RESERVES_SQL = f"""{POSITIONS_SQL},
reserves AS (SELECT snapshot, asset, sum(usd) FILTER (venue <> 'R') AS supplied_usd, sum(usd) FILTER (venue = 'R') AS borrowed_usd, asset IN ('Brand#1', 'Brand#2', 'Brand#3') AS is_wrapper, count(*) < 20 AS frozen FROM positions GROUP BY ALL)"""


def reserves(spark, folder):
    return positions(spark, folder).groupBy("snapshot", "asset").agg(
        F.sum(F.when(F.col("venue") != "R", F.col("usd"))).alias("supplied_usd"),
        F.sum(F.when(F.col("venue") == "R", F.col("usd"))).alias("borrowed_usd"),
        (F.count(F.lit(1)) < 20).alias("frozen"),
    ).withColumn("is_wrapper", F.col("asset").isin("Brand#1", "Brand#2", "Brand#3"))


@query(
    "a20_market_totals",
    f"""WITH {RESERVES_SQL} SELECT snapshot, count(*) AS reserves, {D("sum(supplied_usd)")} AS supplied, {D("sum(borrowed_usd)")} AS borrowed, {D("sum(supplied_usd - borrowed_usd)")} AS available, {D("sum(supplied_usd) FILTER (is_wrapper)")} AS wrapped,
      {D("sum(borrowed_usd)")} / {D("sum(supplied_usd)")} AS utilisation, {D("sum(supplied_usd) FILTER (is_wrapper)")} / {D("sum(supplied_usd)")} AS wrapper_share,
      count(*) FILTER (supplied_usd IS NULL) AS unpriced, count(*) FILTER (frozen) AS frozen FROM reserves GROUP BY snapshot""",
)
def market_totals(spark, folder):
    return C.market_totals(reserves(spark, folder), "snapshot")


@query(
    "a21_read_paths",
    f"""WITH {POSITIONS_SQL}, r AS (SELECT snapshot, path, asset, sum(usd) AS tvl FROM positions GROUP BY ALL), p AS (SELECT snapshot, path, count(*) AS assets, sum(tvl) AS tvl FROM r GROUP BY ALL),
    w AS (SELECT snapshot, sum(assets) AS a, sum(tvl) AS t FROM p GROUP BY snapshot)
    SELECT snapshot, path, assets, {D("tvl")} AS tvl, cast(a - assets AS bigint) AS missed_assets, {D("t - coalesce(tvl, 0)")} AS missed_tvl, {D("t - coalesce(tvl, 0)")} / {D("t")} AS missed_share FROM p JOIN w USING (snapshot)""",
)
def read_paths(spark, folder):
    rows = positions(spark, folder).groupBy("snapshot", "path", "asset").agg(F.sum("usd").alias("tvl"))
    return C.read_paths(rows, "snapshot")


@query(
    "a45_half_of_total",
    f"""WITH {RESERVES_SQL}, k AS (SELECT snapshot, row_number() OVER w AS rk, sum(supplied_usd) OVER (PARTITION BY snapshot ORDER BY supplied_usd DESC, asset ROWS UNBOUNDED PRECEDING) AS cum,
      sum(supplied_usd) OVER (PARTITION BY snapshot) AS total, count(*) OVER (PARTITION BY snapshot) AS n FROM reserves WHERE supplied_usd > 0 WINDOW w AS (PARTITION BY snapshot ORDER BY supplied_usd DESC, asset))
    SELECT snapshot, min(rk) AS half_held_by, max(n) AS reserves FROM k WHERE cum * 2 >= total GROUP BY snapshot HAVING max(n) >= 2""",
)
def half_of_total(spark, folder):
    return C.half_of_total(reserves(spark, folder), "snapshot", "asset", "supplied_usd")


@query(
    "q11_pool_checks",
    f"""WITH {T.LEGS_SQL}, s AS (SELECT order_id AS pool, coalesce(sum(usd), 0) AS leg_sum, count(*) FILTER (usd IS NULL) AS unpriced, max(leg_key) FILTER (usd IS NULL) AS k, arg_max(amount, leg_key) FILTER (usd IS NULL) AS a FROM legs GROUP BY order_id),
    g AS (SELECT s.*, cast(o_totalprice AS decimal(18,4)) AS via, cast(o_totalprice AS decimal(18,4)) - leg_sum AS gap FROM s JOIN orders ON o_orderkey = pool)
    SELECT pool, {D("leg_sum")} AS leg_sum, {D("via")} AS via_shares, {D("gap")} AS gap, {six_sql(f'''{D("gap")} / {D("via")} * 100''')} AS gap_percent, unpriced,
      CASE WHEN gap > 0 AND unpriced = 1 THEN k END AS implied_leg, CASE WHEN gap > 0 AND unpriced = 1 THEN {D("gap")} / a END AS implied_price, CASE WHEN gap > 0 AND unpriced > 1 THEN {D("gap")} END AS unattributed FROM g""",
)
def pool_checks(spark, folder):
    legs = T.legs(spark, folder).select(F.col("order_id").alias("pool"), F.col("leg_key").alias("leg"), "amount", "usd")
    pools = T.table(spark, folder, "orders").select(F.col("o_orderkey").alias("pool"), S.money(F.col("o_totalprice")).alias("via_shares"))
    return C.pool_checks(pools, legs)


@query(
    "j14_resolved_prices",
    f"""WITH RECURSIVE w AS (SELECT p_partkey AS id, CASE WHEN p_type IN ('SMALL', 'PROMO', 'LARGE') THEN p_partkey // 3 END AS underlying, 1 + p_size / 100 AS ratio FROM part),
    o AS (SELECT p_partkey AS node, CASE WHEN p_type = 'ECONOMY' THEN p_retailprice END AS oracle, CASE WHEN p_size > 25 THEN p_retailprice + 1 END AS spot FROM part),
    walk AS (SELECT id, id AS node, 0 AS hop, 1.0::double AS factor FROM w UNION ALL
      SELECT walk.id, w.underlying, hop + 1, factor * ratio FROM walk JOIN o ON o.node = walk.node JOIN w ON w.id = walk.node WHERE oracle IS NULL AND w.underlying IS NOT NULL),
    p AS (SELECT walk.*, oracle, spot FROM walk LEFT JOIN o USING (node)),
    b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hop DESC) AS rk FROM p WHERE oracle IS NOT NULL OR spot IS NOT NULL)
    SELECT w.id, {six_sql("coalesce(oracle, spot) * factor")} AS price, CASE WHEN b.id IS NULL THEN NULL WHEN oracle IS NOT NULL THEN 'oracle' ELSE 'spot' END AS via, cast(hop AS bigint) AS hops
    FROM w LEFT JOIN b ON b.id = w.id AND rk = 1""",
)
def resolved_prices(spark, folder):
    """Three part types wrap the part at a third of their key; economy parts have an oracle, larger ones a spot price."""
    part = T.table(spark, folder, "part")
    underlying = F.when(F.col("p_type").isin("SMALL", "PROMO", "LARGE"), F.floor(F.col("p_partkey") / 3).cast("bigint"))
    wraps = part.select(F.col("p_partkey").alias("id"), underlying.alias("underlying"), (1 + F.col("p_size") / 100).alias("ratio"))
    oracle = part.filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    spot = part.filter("p_size > 25").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") + 1).alias("price"))
    return C.resolve_prices(part.select(F.col("p_partkey").alias("id")), wraps, oracle, spot)


@query(
    "a33_mint_capacity",
    f"""WITH b AS (SELECT {MONTH} AS snapshot, l_returnflag AS minter, cast(sum(l_quantity) AS bigint) AS capacity, cast(coalesce(sum(l_quantity) FILTER (l_linestatus = 'F' OR l_returnflag = 'N'), 0) AS bigint) AS level FROM lineitem GROUP BY ALL),
    s AS (SELECT {MONTH} AS snapshot, cast(sum(l_quantity) FILTER (l_linestatus = 'F' OR l_returnflag <> 'A') AS bigint) AS supply FROM lineitem GROUP BY ALL),
    t AS (SELECT snapshot, cast(sum(level) AS bigint) AS level_sum FROM b GROUP BY snapshot)
    SELECT snapshot, minter, capacity, level, level_sum, supply, capacity - level AS headroom, capacity > 0 AND level >= capacity AS at_capacity, level_sum = supply AS matches_supply FROM b JOIN t USING (snapshot) JOIN s USING (snapshot)""",
)
def mint_capacity(spark, folder):
    li = T.table(spark, folder, "lineitem")
    month = F.date_format("l_shipdate", "yyyy-MM").alias("snapshot")
    total = lambda c=None: F.coalesce(F.sum(F.col("l_quantity").cast("bigint") if c is None else F.when(c, F.col("l_quantity").cast("bigint"))), F.lit(0))
    flag = F.col("l_linestatus") == "F"
    buckets = li.groupBy(month, F.col("l_returnflag").alias("minter")).agg(
        total().alias("capacity"), total(flag | (F.col("l_returnflag") == "N")).alias("level")
    )
    supply = li.groupBy(month).agg(total(flag | (F.col("l_returnflag") != "A")).alias("supply"))
    return C.mint_capacity(buckets, supply, "snapshot")


@query(
    "a34_registrations",
    "SELECT c_nationkey AS collateral, count(*) AS registrations, count(DISTINCT c_mktsegment) AS operators FROM customer GROUP BY GROUPING SETS ((c_nationkey), ())",
)
def registrations(spark, folder):
    customer = T.table(spark, folder, "customer")
    return C.registrations(customer.select(F.col("c_nationkey").alias("collateral"), "c_mktsegment"), "collateral", "c_mktsegment")


@query(
    "a35_risk_categories",
    "SELECT p_size AS category, count(*) AS members, min(p_partkey) AS first_member, p_size / 100 AS ltv, 1.0::double / (1 - p_size / 100) AS max_leverage FROM part GROUP BY p_size",
)
def risk_categories(spark, folder):
    part = T.table(spark, folder, "part").withColumnRenamed("p_size", "category")
    return C.risk_categories(part, "category", "p_partkey", F.col("category") / 100)


PEG_SQL = """
n AS (SELECT o_orderkey AS pool, o_custkey AS a1, o_custkey + 1 AS a2, o_totalprice, o_orderstatus, o_orderpriority FROM orders),
e AS (SELECT pool, a1 AS asset, 0 AS position, * EXCLUDE (pool) FROM n UNION ALL SELECT pool, a2, 1, * EXCLUDE (pool) FROM n),
r AS (SELECT c_custkey AS asset, 1 + c_nationkey / 10 AS rate FROM customer WHERE c_acctbal > 0)"""


@query(
    "q23_peg_states",
    f"""WITH {PEG_SQL}, p AS (SELECT *, CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN false ELSE true END AS aligned FROM e)
    SELECT pool, p.asset, cast(position AS bigint) AS position, CASE WHEN aligned THEN CASE position WHEN 0 THEN 1.0::double ELSE 1 + o_totalprice / 100000 END END AS peg,
      CASE WHEN rate > 0 THEN (CASE WHEN aligned THEN CASE position WHEN 0 THEN 1.0::double ELSE 1 + o_totalprice / 100000 END END - rate) / rate * 10000 END AS gap_bps,
      CASE WHEN o_orderstatus <> 'O' THEN 20000000 - (20000000 - pool) END AS peg_age, o_orderpriority = '2-HIGH' AND 20000000 < 20000000 + pool - 100 AS ramping, aligned
    FROM p LEFT JOIN r ON r.asset = p.asset""",
)
def peg_states(spark, folder):
    return C.peg_states(*peg_frames(spark, folder))


def peg_frames(spark, folder):
    """Two-asset pools from orders: open orders carry no pegs, urgent ones a peg list of the wrong length."""
    orders, customer = T.table(spark, folder, "orders"), T.table(spark, folder, "customer")
    head = F.lit(20_000_000).cast("bigint")
    high = F.col("o_orderpriority") == "2-HIGH"
    pools = orders.select(
        F.col("o_orderkey").alias("pool"),
        F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("assets"),
        F.lit(100).alias("initial_amp"),
        F.when(high, 200).otherwise(100).alias("final_amp"),
        (head + F.col("o_orderkey") - 100).alias("final_block"),
        head.alias("head"),
    )
    ratios = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), 1 + F.col("o_totalprice") / 100000))
    pegs = orders.filter("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").alias("pool"), ratios.alias("ratios"), (head - F.col("o_orderkey")).alias("recorded_block")
    )
    rates = customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("asset"), (1 + F.col("c_nationkey") / 10).alias("rate"))
    return pools, pegs, rates


BOOK_SQL = """
book AS (SELECT *, CASE WHEN amount_in > 0 THEN amount_out / amount_in END AS price, amount_in IS NULL OR amount_out IS NULL AS unpriced FROM (
  SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice / 100 END AS amount_in, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey / 10 END AS amount_out,
    o_orderstatus = 'P' AS is_pallet, o_totalprice > 250000 AS partially_fillable FROM orders))"""


def book_orders(spark, folder):
    urgency = F.col("o_orderpriority")
    return T.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(urgency != "5-LOW", F.col("o_totalprice") / 100).alias("amount_in"),
        F.when(urgency != "1-URGENT", F.col("o_custkey") / 10).alias("amount_out"),
        (F.col("o_orderstatus") == "P").alias("is_pallet"),
        (F.col("o_totalprice") > 250000).alias("partially_fillable"),
    )


def book(spark, folder):
    return C.order_book(book_orders(spark, folder))


@query("q24_order_book", f"WITH {BOOK_SQL} SELECT * FROM book")
def order_book(spark, folder):
    return book(spark, folder)


@query(
    "q24_order_book_counts",
    f"WITH {BOOK_SQL} SELECT count(*) AS orders, count(*) FILTER (unpriced) AS unpriced, count(*) FILTER (is_pallet) AS pallet, count(*) FILTER (partially_fillable) AS partially_fillable FROM book",
)
def order_book_counts(spark, folder):
    return C.order_book_counts(book(spark, folder))

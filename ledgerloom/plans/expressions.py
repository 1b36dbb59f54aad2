"""Column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import tables as T
from .registry import query, six_sql

@query(
    "f01_days_of_epochs",
    "SELECT event_id, cast(ts AS date) AS of_seconds, cast(ts AS date) AS of_millis FROM events",
)
def days_of_epochs(spark, folder):
    ts = F.col("ts").cast("timestamp")
    return T.table(spark, folder, "events").select(
        "event_id", S.day_of_seconds(F.unix_seconds(ts)).alias("of_seconds"), S.day_of_millis(F.unix_millis(ts)).alias("of_millis")
    )


@query(
    "f02_scaled_amounts",
    "SELECT p_partkey, CASE WHEN p_size < 40 THEN p_retailprice * 100 / pow(10.0, p_size % 7) END AS amount FROM part",
)
def scaled_amounts(spark, folder):
    decimals = F.when(F.col("p_size") < 40, F.col("p_size") % 7)
    return T.table(spark, folder, "part").select("p_partkey", S.scale_amount(F.col("p_retailprice") * 100, decimals).alias("amount"))


@query("f03_cents", f"SELECT {T.LINE_KEY_SQL} AS id, floor((l_extendedprice / 8 - 5000) * 100 + 0.5) / 100 AS cents FROM lineitem")
def cents(spark, folder):
    value = S.round_cents(F.col("l_extendedprice") / 8 - 5000)
    return T.table(spark, folder, "lineitem").select(T.line_key().alias("id"), value.alias("cents"))


@query("f04_six_digits", f"SELECT {T.LINE_KEY_SQL} AS id, {six_sql('l_extendedprice * l_discount')} AS six FROM lineitem")
def six_digits(spark, folder):
    value = S.six_digits(F.col("l_extendedprice") * F.col("l_discount"))
    return T.table(spark, folder, "lineitem").select(T.line_key().alias("id"), value.alias("six"))


@query(
    "f05_token_cents",
    f"SELECT {T.LINE_KEY_SQL} AS id, cast(floor((cast(round(l_extendedprice * 100) AS hugeint) * 200 + 700) / 1400) AS double) / 100 AS token FROM lineitem",
)
def token_cents(spark, folder):
    planck = F.round(F.col("l_extendedprice") * 100).cast("decimal(20,0)")
    value = S.token_cents(planck, F.lit(700).cast("decimal(10,0)"))
    return T.table(spark, folder, "lineitem").select(T.line_key().alias("id"), value.alias("token"))


@query(
    "f06_digit_counts",
    "SELECT o_orderkey, length(cast(cast(round(o_totalprice * 100) AS bigint) AS varchar)) AS digits FROM orders",
)
def digit_counts(spark, folder):
    raw = F.concat(F.lit("-000"), F.round(F.col("o_totalprice") * 100).cast("bigint"), F.lit(".50"))
    return T.table(spark, folder, "orders").select("o_orderkey", S.digit_count(raw).cast("bigint").alias("digits"))


@query(
    "f07_addresses",
    "SELECT c_custkey, lpad(lower(to_hex(c_custkey)), 40, '0') AS address FROM customer",
)
def addresses(spark, folder):
    word = F.concat(F.lit("0X"), F.lpad(F.hex("c_custkey"), 64, "0"))
    return T.table(spark, folder, "customer").select("c_custkey", S.normal_address(word).alias("address"))


@query(
    "f08_chain_keys",
    """SELECT n_nationkey, n_name AS chain, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'MACHINERY' GROUP BY ALL""",
)
def chain_keys(spark, folder):
    """Chains arrive as 'EVM-n', as a bare number, or as something that names no chain."""
    segment = F.col("c_mktsegment")
    raw = F.when(segment == "BUILDING", F.concat(F.lit("EVM-"), "c_nationkey")).when(segment == "MACHINERY", "nowhere").otherwise(F.col("c_nationkey").cast("string"))
    keys = T.table(spark, folder, "nation").select(
        F.explode(F.array(F.concat(F.lit("EVM-"), "n_nationkey"), F.col("n_nationkey").cast("string"))).alias("raw"), "n_nationkey", F.col("n_name").alias("chain")
    )
    counts = T.table(spark, folder, "customer").groupBy(raw.alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(keys, "raw").groupBy("n_nationkey", "chain").agg(F.sum("n").alias("customers"))


@query(
    "f09_printable_text",
    "SELECT s_suppkey, s_name AS partner, CASE WHEN s_acctbal < 5000 THEN s_name END AS clean FROM supplier",
)
def printable_text(spark, folder):
    word = F.rpad(F.hex("s_name"), 64, "0")
    stray = F.rpad(F.concat(F.hex("s_name"), F.when(F.col("s_acctbal") < 5000, "").otherwise("07")), 64, "0")
    return T.table(spark, folder, "supplier").select("s_suppkey", S.printable_or_null(word).alias("partner"), S.printable_or_null(stray).alias("clean"))


APY = "(31536000.0::double * (x - x * x / 2 + x * x * x / 3))"


@query(
    "f10_compound_apy",
    f"""WITH r AS (SELECT o_orderkey, floor(o_totalprice)::double / 5e6 / 31536000.0 AS x FROM orders), y AS (SELECT o_orderkey, {APY} AS y FROM r)
    SELECT o_orderkey, {six_sql("100 * y * (1 + y / 2 * (1 + y / 3 * (1 + y / 4 * (1 + y / 5 * (1 + y / 6 * (1 + y / 7 * (1 + y / 8 * (1 + y / 9))))))))")} AS apy FROM y""",
)
def compound_apy(spark, folder):
    ray = F.floor("o_totalprice").cast("double") * F.lit(2e20)
    return T.table(spark, folder, "orders").select("o_orderkey", S.six_digits(S.compound_apy(ray)).alias("apy"))


@query("f11_little_endian", "SELECT l_orderkey, max(l_partkey * 1000 + l_linenumber) AS number FROM lineitem GROUP BY l_orderkey")
def little_endian(spark, folder):
    packed = S.swap_bytes(F.lpad(F.hex(F.col("l_partkey") * 1000 + F.col("l_linenumber")), 16, "0"))
    return T.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max(S.hex_uint_le(packed)).alias("number"))


@query(
    "f12_ratios",
    f"""SELECT {T.LINE_KEY_SQL} AS id, CASE WHEN l_discount <> 0 THEN (l_tax - l_discount) / l_discount * 10000 END AS gap_bps, CASE WHEN l_tax <> 0 THEN (l_discount - l_tax) / l_tax * 100 END AS diff_pct FROM lineitem""",
)
def ratios(spark, folder):
    return T.table(spark, folder, "lineitem").select(
        T.line_key().alias("id"),
        S.gap_bps(F.col("l_tax"), F.col("l_discount")).alias("gap_bps"),
        S.percent_diff(F.col("l_discount"), F.col("l_tax")).alias("diff_pct"),
    )


@query(
    "f13_fractions",
    "SELECT l_orderkey, max(l_quantity / 10000.0::double) AS permill, max(l_quantity / 10000000.0::double) AS perbill FROM lineitem GROUP BY l_orderkey",
)
def fractions(spark, folder):
    parts = [F.max(S.permill(F.col("l_quantity"))).alias("permill"), F.max(S.perbill(F.col("l_quantity"))).alias("perbill")]
    return T.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(*parts)


@query(
    "f14_block_times",
    """WITH e AS (SELECT min(event_id) AS b0, max(event_id) AS b1, epoch_us(min(ts)) // 1000000 AS t0, epoch_us(max(ts)) // 1000000 AS t1 FROM events)
    SELECT o_orderkey, t0 + (o_orderkey - b0) * ((t1 - t0) / (b1 - b0)) AS seconds FROM orders, e""",
)
def block_times(spark, folder):
    from ..operators.ranking import with_totals

    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    clock = T.table(spark, folder, "events").agg(
        F.min("event_id").alias("b0"), F.max("event_id").alias("b1"), F.min(seconds).alias("t0"), F.max(seconds).alias("t1")
    )
    rows = with_totals(T.table(spark, folder, "orders").select("o_orderkey"), clock)
    at = S.block_time(F.col("o_orderkey"), F.col("b0"), F.col("t0"), F.col("b1"), F.col("t1"))
    return rows.select("o_orderkey", at.alias("seconds"))


@query("f15_json_arguments", "SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events")
def json_arguments(spark, folder):
    return T.table(spark, folder, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    "f17_canonical_params",
    """SELECT CASE WHEN o_orderstatus = 'O' THEN '{"month":"' || strftime(o_orderdate, '%Y-%m') || '","status":"O"}' ELSE '{"month":"' || strftime(o_orderdate, '%Y-%m') || '"}' END AS params, count(*) AS orders
    FROM orders GROUP BY ALL""",
)
def canonical_params(spark, folder):
    params = S.canonical_json(
        status=F.when(F.col("o_orderstatus") == "O", F.col("o_orderstatus")), month=F.date_format("o_orderdate", "yyyy-MM")
    )
    return T.table(spark, folder, "orders").groupBy(params.alias("params")).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "p13_account_labels",
    """SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL WHEN s_nationkey < 6 THEN 'child' WHEN s_nationkey < 12 THEN 'sibling' WHEN s_nationkey < 21 THEN 'pallet' END AS kind,
      CASE WHEN s_acctbal >= 0 AND s_nationkey < 12 THEN s_suppkey END AS para_id,
      CASE WHEN s_acctbal < 0 THEN NULL WHEN s_nationkey BETWEEN 12 AND 17 THEN 'py/' || lpad(cast(s_suppkey AS varchar), 5, '0') WHEN s_nationkey BETWEEN 18 AND 20 THEN '0x0100000000000000' END AS pallet_id,
      CASE WHEN s_acctbal < 0 THEN NULL WHEN s_nationkey < 12 THEN 'para ' || s_suppkey WHEN s_nationkey <= 17 THEN 'pallet py/' || lpad(cast(s_suppkey AS varchar), 5, '0') WHEN s_nationkey <= 20 THEN 'pallet 0x0100000000000000' END AS label FROM supplier""",
)
def account_labels(spark, folder):
    nation = F.col("s_nationkey")
    number = S.swap_bytes(F.lpad(F.hex("s_suppkey"), 8, "0"))
    name = F.hex(F.concat(F.lit("py/"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")))
    account = (
        F.when(F.col("s_acctbal") < 0, "not hex")
        .when(nation < 6, F.rpad(F.concat(F.lit("0x70617261"), number), 66, "0"))
        .when(nation < 12, F.rpad(F.concat(F.lit("0x7369626C"), number), 66, "0"))
        .when(nation < 18, F.rpad(F.concat(F.lit("0x6D6F646C"), name), 66, "0"))
        .when(nation < 21, F.rpad(F.lit("0x6D6F646C01"), 66, "0"))
        .otherwise(F.concat(F.lit("0x"), F.lpad(F.hex("s_suppkey"), 64, "0")))
    )
    return T.table(spark, folder, "supplier").select("s_suppkey", S.account_label(account).alias("l")).select("s_suppkey", "l.kind", "l.para_id", "l.pallet_id", "l.label")


@query("p14_pallet_names", "SELECT c_custkey, c_name AS display FROM customer")
def pallet_names(spark, folder):
    tail = F.concat(F.hex("c_name"), F.lit("00"), F.hex("c_mktsegment"))
    return T.table(spark, folder, "customer").select("c_custkey", S.printable_head(tail).alias("display"))


ROUTE_RULES_SQL = """rules AS (SELECT DISTINCT substr(reverse(c_name), 1, 2) AS prefix, c_mktsegment AS class, false AS exact FROM customer
      UNION ALL SELECT DISTINCT substr(reverse(c_name), 1, 4), c_mktsegment || ' line', false FROM customer WHERE c_custkey % 10 = 3
      UNION ALL SELECT reverse(c_name), 'own name', true FROM customer WHERE c_nationkey = 7),
    kept AS (SELECT prefix, exact, min(class) AS class FROM rules GROUP BY ALL)"""


def route_rules(spark, folder):
    """Rules drawn from the customers: two and four leading digits of the turned name by segment, and the whole name in one nation."""
    customer = T.table(spark, folder, "customer")
    segment, phone = F.col("c_mktsegment"), F.reverse("c_name")
    rule = lambda rows, prefix, name, exact: rows.select(prefix.alias("prefix"), name.alias("class"), F.lit(exact).alias("exact"))
    coarse = rule(customer, F.substring(phone, 1, 2), segment, False)
    fine = rule(customer.filter(F.col("c_custkey") % 10 == 3), F.substring(phone, 1, 4), F.concat(segment, F.lit(" line")), False)
    return coarse.union(fine).union(rule(customer.filter("c_nationkey = 7"), phone, F.lit("own name"), True))


@query(
    "p16_route_classes",
    f"""WITH {ROUTE_RULES_SQL}, ends AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'zz' ELSE reverse(c_name) END AS location FROM orders JOIN customer ON o_custkey = c_custkey),
    named AS (SELECT coalesce(e.class, f.class, c.class, 'elsewhere') AS route FROM ends
      LEFT JOIN kept e ON e.exact AND e.prefix = location LEFT JOIN kept f ON NOT f.exact AND f.prefix = substr(location, 1, 4) AND length(f.prefix) = 4
      LEFT JOIN kept c ON NOT c.exact AND c.prefix = substr(location, 1, 2) AND length(c.prefix) = 2)
    SELECT route, count(*) AS orders FROM named GROUP BY ALL""",
)
def route_classes(spark, folder):
    orders, customer = T.table(spark, folder, "orders"), T.table(spark, folder, "customer")
    ends = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.when(F.col("o_orderkey") % 11 == 0, "zz").otherwise(F.reverse("c_name")).alias("location"))
    return S.classified(ends, "location", route_rules(spark, folder), "elsewhere").groupBy("route").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "p17_reserve_configuration",
    """SELECT p_partkey, cast(p_size * 100 AS bigint) AS ltv_bps, cast(p_size * 110 AS bigint) AS liquidation_threshold_bps, 10500::bigint AS liquidation_bonus_bps, cast(p_size % 19 AS bigint) AS decimals,
      p_size > 10 AS active, p_size > 40 AS frozen, p_size < 30 AS borrowing_enabled, p_size = 7 AS paused, 1000::bigint AS reserve_factor_bps, p_partkey * 1000 AS borrow_cap, p_partkey * 3000 AS supply_cap, 500::bigint AS protocol_fee_bps, cast(p_size % 4 AS bigint) AS category FROM part""",
)
def reserve_configuration(spark, folder):
    size, key = F.col("p_size").cast("bigint"), F.col("p_partkey")
    word_of = lambda v, digits: F.lpad(F.hex(v), digits, "0")
    bit = lambda c, n: F.when(c, 1 << n).otherwise(0)
    flags = (bit(size > 10, 0) + bit(size > 40, 1) + bit(size < 30, 2) + bit(size == 7, 4)).cast("bigint")
    big = lambda n: F.lit(n).cast("bigint")
    word = F.concat(
        F.lit("0" * 20), word_of(size % 4, 2), word_of(big(500), 4), word_of(key * 3000, 9), word_of(key * 1000, 9), word_of(big(1000), 4),
        word_of(flags, 2), word_of(size % 19, 2), word_of(big(10500), 4), word_of(size * 110, 4), word_of(size * 100, 4),
    )
    return T.table(spark, folder, "part").select("p_partkey", word.alias("w")).select("p_partkey", *S.reserve_configuration(F.col("w")))


@query(
    "p18_owner_kinds",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'pallet' WHEN c_mktsegment = 'MACHINERY' THEN 'sovereign' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'custodial' WHEN c_mktsegment = 'FURNITURE' THEN 'proxy' END AS kind FROM customer""",
)
def owner_kinds(spark, folder):
    segment = F.col("c_mktsegment")
    system = F.when(segment == "BUILDING", "pallet").when(segment == "MACHINERY", "sibling")
    label = F.when(segment == "HOUSEHOLD", "Example Exchange 7").when(segment == "FURNITURE", "Staker: proxy/01").when(segment == "AUTOMOBILE", F.col("c_name"))
    kind = S.owner_kind(system, label, r"\b(exchange|custody|custodian)\b", r"\b(proxy|staker)\b")
    return T.table(spark, folder, "customer").select("c_custkey", kind.alias("kind"))


@query(
    "q27_indexer_health",
    """SELECT event_type AS chain, max(event_id) AS height, (SELECT max(event_id) FROM events) - max(event_id) AS behind, (SELECT max(event_id) FROM events) - max(event_id) < 3 AS healthy FROM events GROUP BY event_type""",
)
def indexer_health(spark, folder):
    from ..operators.ranking import with_totals

    events = T.table(spark, folder, "events")
    target = events.agg(F.max("event_id").alias("target"))
    heads = events.groupBy(F.col("event_type").alias("chain")).agg(F.max("event_id").alias("height"))
    behind = F.col("target") - F.col("height")
    return with_totals(heads, target).select("chain", "height", behind.alias("behind"), (behind < 3).alias("healthy"))

"""Registry, dictionary and quote queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import registry as R
from ..session import settle
from ..sources import tables as T
from .registry import query


def part_registry(spark, folder):
    """Dear parts are registered; some registry rows disagree with the indexer on decimals, some lack a symbol."""
    part = T.table(spark, folder, "part")
    indexer = part.filter("p_size > 1").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") > 3, F.col("p_partkey")).alias("registry_id"),
        F.when(F.col("p_type") != "LARGE", F.col("p_name")).alias("symbol"),
        (F.col("p_size") % 7).cast("bigint").alias("decimals"),
    )
    registry = part.filter("p_retailprice < 1500").select(
        F.col("p_partkey").alias("registry_id"),
        F.when(F.col("p_type") != "SMALL", F.upper("p_name")).alias("symbol"),
        (F.col("p_size") % 7 + F.when(F.col("p_brand") == "Brand#5", 1).otherwise(0)).cast("bigint").alias("decimals"),
    )
    ids = T.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    return ids, indexer, registry


MEANING_SQL = """
ids AS (SELECT DISTINCT l_partkey AS id FROM lineitem),
ix AS (SELECT p_partkey AS id, CASE WHEN p_size > 3 THEN p_partkey END AS registry_id, CASE WHEN p_type <> 'LARGE' THEN p_name END AS symbol, p_size % 7 AS decimals FROM part WHERE p_size > 1),
rg AS (SELECT p_partkey AS registry_id, CASE WHEN p_type <> 'SMALL' THEN upper(p_name) END AS symbol, p_size % 7 + CASE WHEN p_brand = 'Brand#5' THEN 1 ELSE 0 END AS decimals FROM part WHERE p_retailprice < 1500),
meaning AS (SELECT ids.id, ix.registry_id,
    CASE WHEN rg.symbol IS NOT NULL THEN rg.symbol WHEN ix.symbol IS NOT NULL THEN ix.symbol END AS symbol,
    cast(CASE WHEN rg.symbol IS NOT NULL THEN rg.decimals WHEN ix.symbol IS NOT NULL THEN ix.decimals END AS bigint) AS decimals,
    rg.symbol IS NULL AND ix.symbol IS NOT NULL AS borrowed, coalesce(rg.decimals <> ix.decimals, false) AS disagree, ix.registry_id IS NOT NULL AS mapped
  FROM ids LEFT JOIN ix USING (id) LEFT JOIN rg ON ix.registry_id = rg.registry_id)"""


@query("j01_asset_meaning", f"WITH {MEANING_SQL} SELECT * FROM meaning")
def asset_meaning(spark, folder):
    return R.resolve_meaning(*part_registry(spark, folder))


@query(
    "j02_symbol_labels",
    f"""WITH {MEANING_SQL}, u AS (SELECT symbol, count(*) AS users FROM meaning WHERE symbol IS NOT NULL GROUP BY symbol)
    SELECT id, meaning.symbol, CASE WHEN users > 1 THEN meaning.symbol || '·' || coalesce(registry_id, id) ELSE meaning.symbol END AS label
    FROM meaning LEFT JOIN u ON u.symbol = meaning.symbol""",
)
def symbol_labels(spark, folder):
    return R.label_symbols(R.resolve_meaning(*part_registry(spark, folder))).select("id", "symbol", "label")


@query(
    "q18_shared_symbols",
    "SELECT p_name AS symbol, count(*) AS ids, min(p_partkey) AS first_id FROM part GROUP BY p_name HAVING count(*) > 1",
)
def shared_symbols(spark, folder):
    part = T.table(spark, folder, "part")
    return R.shared_symbols(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("symbol")))


def token_key(key: str):
    """Addresses arrive as 32-byte words in upper case; the key is their last forty digits."""
    return S.normal_address(F.concat(F.lit("0X"), F.lpad(F.hex(key), 64, "0")))


TOKEN_KEY_SQL = "lpad(lower(to_hex({0})), 40, '0')"


def token_tables(spark, folder):
    part, li = T.table(spark, folder, "part"), T.table(spark, folder, "lineitem")
    chain = F.when(F.col("p_size") < 20, "A").when(F.col("p_size") < 35, "N").otherwise("R")
    ours = part.select(
        chain.alias("chain"),
        token_key("p_partkey").alias("key"),
        F.col("p_name").alias("symbol"),
        (F.col("p_size") % 7).cast("bigint").alias("decimals"),
    )
    seen = li.select(F.col("l_returnflag").alias("chain"), "l_partkey").distinct()
    theirs = seen.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "chain",
        token_key("l_partkey").alias("key"),
        F.when(F.col("p_type") == "PROMO", F.upper("p_name")).otherwise(F.col("p_name")).alias("symbol"),
        (F.col("p_size") % 7 + F.when(F.col("p_brand") == "Brand#5", 1).otherwise(0)).cast("bigint").alias("decimals"),
    )
    return ours, theirs


TOKEN_TABLES_SQL = f"""
ours AS (SELECT CASE WHEN p_size < 20 THEN 'A' WHEN p_size < 35 THEN 'N' ELSE 'R' END AS chain, {TOKEN_KEY_SQL.format("p_partkey")} AS key,
    p_name AS symbol, cast(p_size % 7 AS bigint) AS decimals FROM part),
theirs AS (SELECT DISTINCT l_returnflag AS chain, {TOKEN_KEY_SQL.format("l_partkey")} AS key, CASE WHEN p_type = 'PROMO' THEN upper(p_name) ELSE p_name END AS symbol,
    cast(p_size % 7 + CASE WHEN p_brand = 'Brand#5' THEN 1 ELSE 0 END AS bigint) AS decimals FROM lineitem JOIN part ON l_partkey = p_partkey),
audited AS (SELECT coalesce(o.chain, t.chain) AS chain, coalesce(o.key, t.key) AS key, o.symbol AS our_symbol, o.decimals AS our_decimals, t.symbol AS their_symbol, t.decimals AS their_decimals,
    CASE WHEN t.key IS NULL THEN 'only-ours' WHEN o.key IS NULL THEN 'adopted' WHEN o.decimals <> t.decimals THEN 'decimals-clash' WHEN o.symbol <> t.symbol THEN 'symbol-clash' ELSE 'agree' END AS verdict
  FROM ours o FULL JOIN theirs t ON o.chain = t.chain AND o.key = t.key)"""


@query("j10_registry_audit", f"WITH {TOKEN_TABLES_SQL} SELECT * FROM audited")
def registry_audit(spark, folder):
    return R.audit(*token_tables(spark, folder), ["chain", "key"])


@query(
    "j03_described_legs",
    f"""WITH {TOKEN_TABLES_SQL}, l AS (SELECT {T.LINE_KEY_SQL} AS id, l_returnflag AS chain, {TOKEN_KEY_SQL.format("l_partkey")} AS key FROM lineitem)
    SELECT id, chain, key, verdict, CASE WHEN verdict <> 'decimals-clash' THEN coalesce(our_symbol, their_symbol) END AS symbol,
      CASE WHEN verdict <> 'decimals-clash' THEN coalesce(our_decimals, their_decimals) END AS decimals, coalesce(verdict = 'decimals-clash', false) AS blocked
    FROM l LEFT JOIN audited USING (chain, key)""",
)
def described_legs(spark, folder):
    legs = T.table(spark, folder, "lineitem").select(
        T.line_key().alias("id"), F.col("l_returnflag").alias("chain"), token_key("l_partkey").alias("key")
    )
    return R.describe_legs(legs, R.audit(*token_tables(spark, folder), ["chain", "key"]), ["chain", "key"])


def located_assets(spark, folder):
    """Part supply is what its lines moved; quotes and the listing cover the cheaper parts only."""
    part, li = T.table(spark, folder, "part"), T.table(spark, folder, "lineitem")
    supply = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.col("l_quantity").cast("decimal(18,0)")).alias("supply"))
    location = F.lpad(F.hex("p_partkey"), 40, "0")
    assets = part.join(supply, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"),
        location.alias("location"),
        F.col("p_name").alias("symbol"),
        F.when(F.col("p_size") <= 45, F.col("p_size") % 7).cast("bigint").alias("decimals"),
        S.dbl(F.coalesce("supply", F.lit(0))).alias("supply"),
    )
    quotes = part.filter("p_retailprice < 1400 AND p_size > 4").select(
        location.alias("location"),
        F.col("p_retailprice").alias("usd"),
        (F.col("p_size") % 7 + F.when(F.col("p_brand") == "Brand#5", 1).otherwise(0)).cast("bigint").alias("decimals"),
        F.when(F.col("p_size") < 25, "oracle").otherwise("spot").alias("source"),
    )
    known = part.filter("p_retailprice < 1450").select(location.alias("location"))
    return assets, quotes, known


LOCATED_SQL = """
supply AS (SELECT l_partkey AS p_partkey, sum(l_quantity) AS supply FROM lineitem GROUP BY ALL),
assets AS (SELECT p_partkey AS id, lpad(to_hex(p_partkey), 40, '0') AS location, p_name AS symbol, CASE WHEN p_size <= 45 THEN cast(p_size % 7 AS bigint) END AS decimals, coalesce(supply, 0)::double AS supply
  FROM part LEFT JOIN supply USING (p_partkey)),
quotes AS (SELECT lpad(to_hex(p_partkey), 40, '0') AS location, p_retailprice AS usd, p_size % 7 + CASE WHEN p_brand = 'Brand#5' THEN 1 ELSE 0 END AS q_decimals, CASE WHEN p_size < 25 THEN 'oracle' ELSE 'spot' END AS source
  FROM part WHERE p_retailprice < 1400 AND p_size > 4),
known AS (SELECT lpad(to_hex(p_partkey), 40, '0') AS location FROM part WHERE p_retailprice < 1450),
staged AS (SELECT a.*, q.usd AS price, q.source AS q_source, q_decimals,
    CASE WHEN a.decimals IS NULL THEN 'no-decimals' WHEN q.location IS NULL AND k.location IS NULL THEN 'not-listed' WHEN q.location IS NULL THEN 'no-venue'
         WHEN q_decimals <> a.decimals THEN 'decimals-disagree' ELSE 'priced' END AS status
  FROM assets a LEFT JOIN quotes q USING (location) LEFT JOIN known k USING (location)),
valued AS (SELECT id, location, symbol, decimals, supply, price, CASE WHEN status = 'priced' THEN q_source END AS source, status,
    CASE WHEN status = 'priced' THEN supply / pow(10.0, decimals) * price END AS usd,
    CASE WHEN decimals IS NULL THEN supply / pow(10.0, q_decimals) * price END AS would_be_usd FROM staged)"""


@query("j04_priced_by_location", f"WITH {LOCATED_SQL} SELECT * FROM valued")
def priced_by_location(spark, folder):
    return R.price_by_location(*located_assets(spark, folder))


def exact_sum(x: str) -> str:
    return f"cast(cast(sum(cast({x} AS decimal(28,8))) AS decimal(38,4)) AS double)"


@query(
    "q10_valued_totals",
    f"""WITH {LOCATED_SQL} SELECT count(*) AS assets, count(*) FILTER (status = 'priced') AS priced, {exact_sum("usd")} AS priced_usd,
      count(*) FILTER (source = 'oracle') AS by_oracle, {exact_sum("CASE WHEN source = 'oracle' THEN usd END")} AS by_oracle_usd,
      count(*) FILTER (source = 'spot') AS by_spot, {exact_sum("CASE WHEN source = 'spot' THEN usd END")} AS by_spot_usd,
      count(*) FILTER (status = 'no-decimals') AS no_decimals, count(*) FILTER (status = 'not-listed') AS not_listed, count(*) FILTER (status = 'no-venue') AS no_venue,
      count(*) FILTER (status = 'decimals-disagree') AS decimals_disagree, count(*) FILTER (status = 'priced') / count(*) AS coverage_by_count, {exact_sum("would_be_usd")} AS excluded_usd FROM valued""",
)
def valued_totals(spark, folder):
    return R.valued_totals(R.price_by_location(*located_assets(spark, folder)))


@query(
    "j05_namesakes",
    f"""WITH {LOCATED_SQL}, g AS (SELECT upper(symbol) AS sym, id, usd FROM valued)
    SELECT v.id, v.symbol, (SELECT count(*) FROM g WHERE g.sym = upper(v.symbol) AND g.id <> v.id) AS namesakes,
      (SELECT count(usd) FROM g WHERE g.sym = upper(v.symbol) AND g.id <> v.id) AS priced_namesakes,
      (SELECT arg_max(g.id, (g.usd, -g.id)) FROM g WHERE g.sym = upper(v.symbol) AND g.id <> v.id AND g.usd IS NOT NULL) AS dearest_id,
      (SELECT max(g.usd) FROM g WHERE g.sym = upper(v.symbol) AND g.id <> v.id) AS dearest_usd
    FROM valued v WHERE v.usd IS NULL""",
)
def namesakes(spark, folder):
    valued = settle(R.price_by_location(*located_assets(spark, folder)).select("id", "symbol", "usd"), "valued")
    return R.namesakes(valued, valued)


@query(
    "t05_value_order",
    f"""WITH {LOCATED_SQL} SELECT id, symbol, usd, row_number() OVER (ORDER BY usd DESC NULLS LAST, symbol, id) AS position FROM valued
    ORDER BY usd DESC NULLS LAST, symbol, id LIMIT 400""",
)
def value_order(spark, folder):
    from pyspark.sql import Window

    from ..operators.ranking import top_k

    order = [F.desc_nulls_last("usd"), F.asc("symbol"), F.asc("id")]
    valued = R.price_by_location(*located_assets(spark, folder)).select("id", "symbol", "usd")
    return top_k(valued, order, 400).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


ENUM_SQL = """
named AS (SELECT DISTINCT c_custkey AS id, 'customer' AS source FROM customer UNION ALL SELECT DISTINCT o_custkey, 'orders' FROM orders
  UNION ALL SELECT DISTINCT user_id, 'events' FROM events UNION ALL SELECT DISTINCT l_partkey, 'lineitem' FROM lineitem)"""


def id_sources(spark, folder):
    names = {"customer": "c_custkey", "orders": "o_custkey", "events": "user_id", "lineitem": "l_partkey"}
    return {t: T.table(spark, folder, t).select(F.col(c).alias("id")) for t, c in names.items()}


@query(
    "j07_enumerated_ids",
    f"WITH {ENUM_SQL} SELECT id, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS named_by FROM named GROUP BY id",
)
def enumerated_ids(spark, folder):
    return R.enumerate_sources(id_sources(spark, folder), "id")


@query(
    "u04_missing_ids",
    f"""WITH {ENUM_SQL} SELECT id, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS named_by FROM named
    WHERE id NOT IN (SELECT id FROM named WHERE source IN ('customer', 'orders')) GROUP BY id""",
)
def missing_ids(spark, folder):
    sources = id_sources(spark, folder)
    enumerated = R.enumerate_sources(sources, "id")
    for registered in ("customer", "orders"):
        enumerated = enumerated.join(sources[registered], "id", "left_anti")
    return enumerated


@query(
    "j08_topology_names",
    """WITH n AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN (n_regionkey + 1) % 5 ELSE n_regionkey END AS network,
        CASE c_mktsegment WHEN 'BUILDING' THEN cast(n_nationkey AS varchar) WHEN 'MACHINERY' THEN lower(n_name) WHEN 'HOUSEHOLD' THEN 'N' || n_nationkey
          WHEN 'AUTOMOBILE' THEN n_name ELSE 'zone' || n_nationkey END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    a AS (SELECT n_regionkey AS network, n_nationkey AS para, n_name AS chain, unnest([cast(n_nationkey AS varchar), lower(n_name), 'n' || n_nationkey]) AS alias FROM nation)
    SELECT name, n.network, para, chain, count(*) AS rows FROM n LEFT JOIN a ON n.network = a.network AND lower(name) = alias GROUP BY ALL""",
)
def topology_names(spark, folder):
    customer, nation = T.table(spark, folder, "customer"), T.table(spark, folder, "nation")
    segment = F.col("c_mktsegment")
    name = (
        F.when(segment == "BUILDING", F.col("n_nationkey").cast("string"))
        .when(segment == "MACHINERY", F.lower("n_name"))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("N"), "n_nationkey"))
        .when(segment == "AUTOMOBILE", F.col("n_name"))
        .otherwise(F.concat(F.lit("zone"), "n_nationkey"))
    )
    network = F.when(segment == "AUTOMOBILE", (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey"))
    names = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        network.alias("network"), name.alias("name")
    ).agg(F.count(F.lit(1)).alias("rows"))
    topology = nation.select(
        F.col("n_regionkey").alias("network"),
        F.col("n_nationkey").alias("para"),
        F.col("n_name").alias("name"),
        F.array(F.concat(F.lit("n"), "n_nationkey")).alias("aliases"),
    )
    return R.resolve_names(names, topology)


@query(
    "j15_confirmed_wraps",
    """WITH u AS (SELECT p_name, min(p_partkey) AS underlying, max(p_partkey) AS last_wrap FROM part GROUP BY p_name)
    SELECT p_partkey AS wrap, underlying, last_wrap = p_partkey AS confirmed,
      (SELECT q.p_size % 7 FROM part q WHERE q.p_partkey = underlying) = p_size % 7 AS decimals_agree FROM part JOIN u USING (p_name)""",
)
def confirmed_wraps(spark, folder):
    return R.confirm_wraps(*wrap_frames(spark, folder))


def wrap_frames(spark, folder):
    """Parts wrap the first part of their name, which lists the last one back."""
    part = T.table(spark, folder, "part").select("p_partkey", "p_name", (F.col("p_size") % 7).alias("decimals"))
    first = part.groupBy("p_name").agg(F.min("p_partkey").alias("underlying"), F.max("p_partkey").alias("wrap"))
    wraps = part.join(first.drop("wrap"), "p_name").select(F.col("p_partkey").alias("wrap"), "underlying", "decimals")
    listed = first.join(part.select(F.col("p_partkey").alias("underlying"), "decimals"), "underlying")
    return wraps, listed


@query(
    "j16_staked_price",
    """WITH r AS (SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'st' || p_name ELSE p_name END AS symbol FROM part),
    s AS (SELECT p_name AS symbol, max(p_retailprice) AS price FROM part WHERE p_size > 40 GROUP BY p_name)
    SELECT r.p_partkey, r.symbol, coalesce(e.price, b.price) AS price, CASE WHEN e.price IS NOT NULL THEN 'symbol' WHEN b.price IS NOT NULL THEN 'stripped' END AS via
    FROM r LEFT JOIN s e ON e.symbol = r.symbol LEFT JOIN s b ON b.symbol = regexp_replace(r.symbol, '^st', '')""",
)
def staked_price(spark, folder):
    part = T.table(spark, folder, "part")
    symbol = F.when(F.col("p_type") == "SMALL", F.concat(F.lit("st"), "p_name")).otherwise(F.col("p_name"))
    spot = part.filter("p_size > 40").groupBy(F.col("p_name").alias("symbol")).agg(F.max("p_retailprice").alias("price"))
    return R.staked_price(part.select("p_partkey", symbol.alias("symbol")), spot)


def hub_pools(spark, folder):
    """Monthly pool rows: what each brand moved against what was paid for it; five brands have no oracle."""
    li, part = T.table(spark, folder, "lineitem"), T.table(spark, folder, "part")
    return (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("snapshot"), F.col("p_brand").alias("asset"))
        .agg(
            S.dbl(F.sum(F.col("l_quantity").cast("decimal(18,2)"))).alias("reserve"),
            S.dbl(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).alias("hub_reserve"),
            F.max(F.when(F.col("p_size") > 20, F.col("p_retailprice"))).alias("oracle"),
        )
    )


HUB_SQL = """
pools AS (SELECT strftime(l_shipdate, '%Y-%m') AS snapshot, p_brand AS asset, cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS reserve,
    cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double) AS hub_reserve, max(CASE WHEN p_size > 20 THEN p_retailprice END) AS oracle
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
anchors AS (SELECT snapshot, reserve * oracle / hub_reserve AS hub FROM pools WHERE oracle IS NOT NULL AND reserve <> 0 AND hub_reserve <> 0),
hubs AS (SELECT snapshot, count(*) AS anchors, (quantile_disc(hub, 0.5) + percentile_disc(0.5) WITHIN GROUP (ORDER BY hub DESC)) / 2 AS hub_usd, max(hub) AS hi, min(hub) AS lo FROM anchors GROUP BY snapshot),
spots AS (SELECT pools.*, anchors, hub_usd, CASE WHEN anchors > 1 AND hub_usd <> 0 THEN (hi - lo) / hub_usd * 10000 END AS spread_bps,
    CASE WHEN reserve <> 0 THEN hub_reserve * hub_usd / reserve END AS spot FROM pools LEFT JOIN hubs USING (snapshot))"""


@query("q07_hub_prices", f"WITH {HUB_SQL} SELECT snapshot, asset, reserve, hub_reserve, oracle, anchors, hub_usd, spread_bps, spot FROM spots")
def hub_prices(spark, folder):
    return R.hub_prices(hub_pools(spark, folder), "snapshot")


@query(
    "q08_preferred_quotes",
    f"WITH {HUB_SQL} SELECT snapshot, asset, coalesce(oracle, spot) AS usd, CASE WHEN oracle IS NOT NULL THEN 'oracle' WHEN spot IS NOT NULL THEN 'spot' END AS source FROM spots",
)
def preferred_quotes(spark, folder):
    return R.prefer_oracle(R.hub_prices(hub_pools(spark, folder), "snapshot")).select("snapshot", "asset", "usd", "source")


@query(
    "u05_price_cross_check",
    f"WITH {HUB_SQL} SELECT snapshot, asset, oracle, spot, (spot - oracle) / oracle * 100 AS difference_pct FROM spots WHERE oracle IS NOT NULL AND spot IS NOT NULL",
)
def price_cross_check(spark, folder):
    gap = R.price_gap(R.hub_prices(hub_pools(spark, folder), "snapshot"))
    return gap.select("snapshot", "asset", "oracle", "spot", "difference_pct")


@query(
    "t02_worst_price_gaps",
    f"""WITH {HUB_SQL} SELECT snapshot, asset, abs((spot - oracle) / oracle * 100) AS gap FROM spots WHERE oracle IS NOT NULL AND spot IS NOT NULL
    ORDER BY gap DESC, snapshot, asset LIMIT 5""",
)
def worst_price_gaps(spark, folder):
    gap = R.price_gap(R.hub_prices(hub_pools(spark, folder), "snapshot"))
    return R.worst_gaps(gap.select("snapshot", "asset", F.abs("difference_pct").alias("gap")), "gap", ["snapshot", "asset"], 5)


@query(
    "p12_bridged_classes",
    """WITH a AS (SELECT p_partkey AS id, CASE WHEN p_size <= 5 THEN 'zz' ELSE '02' || CASE WHEN p_size <= 30 THEN '09' WHEN p_size <= 40 THEN '00' ELSE '04' END || lpad(to_hex(p_partkey % 7), 2, '0') END AS location FROM part),
    c AS (SELECT *, CASE WHEN location = 'zz' THEN 'undecodable' WHEN substr(location, 3, 2) NOT IN ('09', '00') THEN 'wrong-first-junction' WHEN substr(location, 3, 4) = '0900' THEN 'own-network' END AS anomaly FROM a)
    SELECT id, lower(location) AS location, anomaly, CASE WHEN anomaly IS NOT NULL THEN NULL WHEN substr(location, 3, 2) = '09' THEN 'bridged' ELSE 'sibling' END AS kind FROM c""",
)
def bridged_classes(spark, folder):
    size = F.col("p_size")
    junction = F.when(size <= 30, "09").when(size <= 40, "00").otherwise("04")
    network = F.lower(F.lpad(F.hex(F.col("p_partkey") % 7), 2, "0"))
    location = F.when(size <= 5, "zz").otherwise(F.concat(F.lit("02"), junction, network))
    part = T.table(spark, folder, "part")
    return R.bridged_classes(part.select(F.col("p_partkey").alias("id"), location.alias("location")))

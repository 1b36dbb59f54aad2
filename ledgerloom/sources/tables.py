"""Landed tables as canonical frames.

Every frame keeps the raw columns' types, reads only the columns it names, and is lazy: the scans prune to
what a query uses. `*_SQL` strings state the same mapping for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_key() -> Column:
    """Text that tells any two lines apart: the pair (order, line number) repeats in the landed table."""
    return F.concat_ws(
        "-",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(F.col("l_quantity") * 100).cast("bigint"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint"),
        F.unix_date(F.to_date("l_shipdate")),
    )


LINE_KEY_SQL = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_quantity * 100) as bigint), "
    "cast(round(l_extendedprice * 100) as bigint), date_diff('day', DATE '1970-01-01', cast(l_shipdate AS date)))"
)


def status_of(order_status: Column, line_status: Column) -> Column:
    """F is filled, O carries no status, P is either refunded or still only placed."""
    return (
        F.when(order_status == "F", "FILLED")
        .when((order_status == "P") & (line_status == "F"), "REFUNDED")
        .when(order_status == "P", "PLACED")
    )


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """Lines joined to their order and part, one row per trade; lines without tax carry no price."""
    li, orders, part = (table(spark, folder, n) for n in ("lineitem", "orders", "part"))
    status = status_of(F.col("o_orderstatus"), F.col("l_linestatus"))
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            line_key().alias("id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("o_custkey").alias("account"),
            F.col("o_orderpriority").alias("account_id"),
            F.to_date("l_shipdate").alias("date"),
            F.col("l_returnflag").alias("venue"),
            status.alias("status"),
            F.coalesce(status == "REFUNDED", F.lit(False)).alias("failed"),
            F.col("p_brand").alias("token_in"),
            F.col("p_type").alias("token_out"),
            F.col("l_quantity").alias("amount_in"),
            F.col("l_extendedprice").alias("amount_out"),
            F.when(F.col("l_tax") != 0, S.money(value)).alias("usd"),
            F.col("l_linenumber").alias("hops"),
            (F.col("l_linestatus") == "F").alias("is_pallet"),
        )
    )


TRADES_SQL = f"""
lines_of AS (
  SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'FILLED'
                 WHEN o_orderstatus = 'P' AND l_linestatus = 'F' THEN 'REFUNDED'
                 WHEN o_orderstatus = 'P' THEN 'PLACED' END AS order_state
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
trades AS (
  SELECT {LINE_KEY_SQL} AS id, l_orderkey AS order_id, o_custkey AS account, o_orderpriority AS account_id,
         cast(l_shipdate AS date) AS date, l_returnflag AS venue, order_state AS status,
         coalesce(order_state = 'REFUNDED', false) AS failed, p_brand AS token_in, p_type AS token_out,
         l_quantity AS amount_in, l_extendedprice AS amount_out,
         CASE WHEN l_tax <> 0 THEN cast(l_extendedprice * (1 - l_discount) AS decimal(18,4)) END AS usd,
         l_linenumber AS hops, l_linestatus = 'F' AS is_pallet
  FROM lines_of)
"""


def event_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Events as priced trades: one venue per event type."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("account"),
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("venue"),
        S.money(F.col("value")).alias("usd"),
    )


EVENT_TRADES_SQL = """
event_trades AS (
  SELECT event_id AS id, user_id AS account, cast(ts AS date) AS date, event_type AS venue,
         cast(value AS decimal(18,4)) AS usd FROM events)
"""


def legs(spark: SparkSession, folder: str) -> DataFrame:
    """Order legs in long form: one row per leg, F lines are sent and O lines are received.

    Long rows instead of nested lists: an order of any size is folded by partial aggregation.
    """
    li, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("account"),
        F.col("o_orderpriority").alias("operation"),
        F.when(F.col("l_linestatus") == "F", "in").otherwise("out").alias("side"),
        F.col("l_linenumber").cast("bigint").alias("leg"),
        line_key().alias("leg_key"),
        F.col("l_partkey").alias("asset_id"),
        F.col("l_quantity").alias("amount"),
        F.when(F.col("l_tax") != 0, S.money(value)).alias("usd"),
        F.to_date("l_shipdate").alias("date"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("l_tax").alias("fee_rate"),
    )


LEGS_SQL = f"""
legs AS (
  SELECT l_orderkey AS order_id, o_custkey AS account, o_orderpriority AS operation,
         CASE WHEN l_linestatus = 'F' THEN 'in' ELSE 'out' END AS side, cast(l_linenumber AS bigint) AS leg,
         {LINE_KEY_SQL} AS leg_key, l_partkey AS asset_id, l_quantity AS amount,
         CASE WHEN l_tax <> 0 THEN cast(l_extendedprice * (1 - l_discount) AS decimal(18,4)) END AS usd,
         cast(l_shipdate AS date) AS date, o_orderstatus AS order_status, l_tax AS fee_rate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def shipped_span(spark: SparkSession, folder: str) -> tuple:
    """First and last day of the lines, from one column of the fact table alone; (None, None) of an empty one."""
    return tuple(table(spark, folder, "lineitem").agg(F.to_date(F.min("l_shipdate")), F.to_date(F.max("l_shipdate"))).first())


def lines_since(spark: SparkSession, folder: str, since=None) -> DataFrame:
    """Lines from a day on: a literal bound on the raw column, so that the scan skips older row groups before any join."""
    lines = table(spark, folder, "lineitem")
    return lines if since is None else lines.filter(F.col("l_shipdate") >= F.lit(since).cast(lines.schema["l_shipdate"].dataType))


def transfer_edges(spark: SparkSession, folder: str, since=None) -> DataFrame:
    """Customer to supplier transfers, amounts in cents."""
    li, orders, part = lines_since(spark, folder, since), table(spark, folder, "orders"), table(spark, folder, "part")
    return (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("block"),
            F.to_date("l_shipdate").alias("day"),
            F.concat(F.lit("c:"), F.col("o_custkey")).alias("sender"),
            F.concat(F.lit("s:"), F.col("l_suppkey")).alias("receiver"),
            F.round(F.col("l_extendedprice") * 100).cast("decimal(38,0)").alias("amount"),
            F.col("p_type").alias("asset"),
            F.col("l_returnflag").alias("event"),
            F.when(F.col("l_linestatus") == "F", "relay").otherwise("hub").alias("chain"),
            line_key().alias("edge_key"),
        )
    )


EDGES_SQL = f"""
edges AS (
  SELECT l_orderkey AS block, cast(l_shipdate AS date) AS day, 'c:' || o_custkey AS sender,
         's:' || l_suppkey AS receiver, cast(round(l_extendedprice * 100) AS decimal(38,0)) AS amount,
         p_type AS asset, l_returnflag AS event, CASE WHEN l_linestatus = 'F' THEN 'relay' ELSE 'hub' END AS chain,
         {LINE_KEY_SQL} AS edge_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
"""


def messages(spark: SparkSession, folder: str, since=None) -> DataFrame:
    """Cross-chain messages: customer nation to supplier nation.

    A line shipped before its order date has no matching arrival: it is unmatched and has no latency.
    """
    li, orders, part = lines_since(spark, folder, since), table(spark, folder, "orders"), table(spark, folder, "part")
    customer, supplier, nation = (table(spark, folder, n) for n in ("customer", "supplier", "nation"))
    origin = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("origin"))
    dest = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dest"))
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(origin, "c_nationkey")
        .join(dest, "s_nationkey")
        .select(
            line_key().alias("id"),
            F.to_date("l_shipdate").alias("date"),
            "origin",
            "dest",
            F.col("c_nationkey").cast("string").alias("origin_para"),
            F.col("o_orderpriority").alias("kind"),
            F.when(F.col("o_orderstatus") == "F", "Success").when(F.col("o_orderstatus") == "O", "Failed").alias("outcome"),
            F.when(days >= 0, "matched").otherwise("unmatched").alias("match_status"),
            F.when(days >= 0, days).cast("bigint").alias("latency"),
            F.col("p_name").alias("symbol"),
            F.concat(
                F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
                # A few rows carry six digits too many, as wrongly scaled amounts do.
                F.when((F.col("l_quantity") == 50) & (F.col("l_discount") > 0.095), "000000").otherwise(""),
            ).alias("raw_amount"),
            (F.col("p_size") % 7).cast("bigint").alias("decimals"),
            F.when(F.col("l_tax") != 0, S.money(value)).alias("usd"),
        )
    )


MESSAGES_SQL = f"""
messages AS (
  SELECT {LINE_KEY_SQL} AS id, cast(l_shipdate AS date) AS date, o.n_name AS origin, d.n_name AS dest,
         cast(c_nationkey AS varchar) AS origin_para, o_orderpriority AS kind,
         CASE WHEN o_orderstatus = 'F' THEN 'Success' WHEN o_orderstatus = 'O' THEN 'Failed' END AS outcome,
         CASE WHEN cast(l_shipdate AS date) >= cast(o_orderdate AS date) THEN 'matched' ELSE 'unmatched' END AS match_status,
         CASE WHEN cast(l_shipdate AS date) >= cast(o_orderdate AS date)
              THEN date_diff('day', cast(o_orderdate AS date), cast(l_shipdate AS date)) END AS latency,
         p_name AS symbol, cast(cast(round(l_extendedprice * 100) AS bigint) AS varchar) || CASE WHEN l_quantity = 50 AND l_discount > 0.095 THEN '000000' ELSE '' END AS raw_amount,
         cast(p_size % 7 AS bigint) AS decimals,
         CASE WHEN l_tax <> 0 THEN cast(l_extendedprice * (1 - l_discount) AS decimal(18,4)) END AS usd
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation o ON c_nationkey = o.n_nationkey JOIN nation d ON s_nationkey = d.n_nationkey)
"""


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Balance observations: user as key, event id as block, event type as leg."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("block"),
        F.to_date("ts").alias("day"),
        F.col("event_type").alias("leg"),
        S.money(F.col("value")).alias("balance"),
    )


OBSERVATIONS_SQL = """
obs AS (
  SELECT user_id AS key, event_id AS block, cast(ts AS date) AS day, event_type AS leg,
         cast(value AS decimal(18,4)) AS balance FROM events)
"""


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """Stored objects: documents by content hash, the document id standing in for the block."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("block"),
        F.sha2("text", 256).alias("hash"),
        F.col("n_chars").alias("size"),
        F.col("lang").alias("codec"),
        F.col("source").alias("hashing"),
    )


OBJECTS_SQL = """
objects AS (
  SELECT doc_id AS block, sha256(text) AS hash, n_chars AS size, lang AS codec, source AS hashing FROM documents)
"""

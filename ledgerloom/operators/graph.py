"""Transfer graphs: decoding, counterparties of every account at once, corridors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranking import with_totals

ACCOUNT = r"^(0x)?[0-9a-fA-F]{64}$"
ARGS = "struct<from:string,to:string,amount:string,assetId:string>"


def account_hex(x: Column) -> Column:
    """Lower-case account without prefix, for text that matches `ACCOUNT`."""
    return F.lower(F.right(x, F.lit(64)))


def asset_key(name: Column, asset_id: Column) -> Column:
    """Key that keeps equal numbers of different asset tables apart. The event names."""
    return (
        F.when(name == "Balances.Transfer", F.lit("native"))
        .when(name == "Assets.Transferred", F.concat(F.lit("assets:"), asset_id))
        .when(name == "PoolAssets.Transferred", F.concat(F.lit("pool:"), asset_id))
        .when(name == "ForeignAssets.Transferred", F.concat(F.lit("foreign:"), asset_id))
        .otherwise(F.concat(F.lit("other:"), name))
    )


def named_events(blocks: DataFrame, event_names: list[str]) -> DataFrame:
    """Events of the names with their arguments `a`: a positional list is an error, not a guess."""
    events = blocks.select("number", "timestamp", F.inline("events")).filter(F.col("name").isin(event_names))
    args = F.when(F.startswith(F.ltrim("args"), F.lit("[")), F.raise_error(F.lit("event arguments are positional"))).otherwise(
        F.from_json("args", ARGS)
    )
    # The one-element explode keeps the filters below from parsing the JSON a second time.
    return events.select("number", "timestamp", F.col("name").alias("event"), F.explode(F.array(args)).alias("a"))


def malformed() -> Column:
    """Why a named event is no transfer, or NULL: arguments that don't parse, an account that is no account, no amount."""
    fine = lambda end: F.coalesce(F.col(f"a.{end}").rlike(ACCOUNT), F.lit(False))
    return F.when(F.col("a").isNull(), "arguments").when(~(fine("from") & fine("to")), "account").when(F.col("a.amount").isNull(), "amount")


def decode_quality(blocks: DataFrame, event_names: list[str]) -> DataFrame:
    """Events by name and the reason that keeps them out of the transfers; NULL for those that are decoded."""
    found = named_events(blocks, event_names).groupBy("event", malformed().alias("reason"))
    return found.agg(F.count(F.lit(1)).alias("events"))


def decode_transfers(blocks: DataFrame, event_names: list[str]) -> DataFrame:
    """Transfer edges of blocks(number, timestamp, events[{name, args json}]).

    Rows without two well-formed accounts and an amount are no transfers; `decode_quality` counts them.
    """
    decoded = named_events(blocks, event_names)
    whole = F.col("a.from").rlike(ACCOUNT) & F.col("a.to").rlike(ACCOUNT) & F.col("a.amount").isNotNull()
    return decoded.filter(whole).select(
        F.col("number").alias("block"),
        F.timestamp_millis("timestamp").alias("at"),
        account_hex(F.col("a.from")).alias("sender"),
        account_hex(F.col("a.to")).alias("receiver"),
        # Wider amounts than 38 digits stay visible in amount_text; the number is NULL for them.
        F.col("a.amount").try_cast("decimal(38,0)").alias("amount"),
        F.col("a.amount").alias("amount_text"),
        asset_key(F.col("event"), F.col("a.assetId")).alias("asset"),
        "event",
    )


def event_counts(edges: DataFrame, days: int, day: str = "day", head=None) -> DataFrame:
    """Events by name over everything read, and those inside the last `days` days of the head, which may be known already."""
    if head is not None:
        inside = F.col(day) >= F.date_sub(F.lit(head), days)
        return edges.groupBy("chain", "event").agg(F.count(F.lit(1)).alias("events"), F.count_if(inside).alias("in_window"))
    cut = edges.agg(F.date_sub(F.max(day), days).alias("cut"))
    per_day = edges.groupBy("chain", "event", day).agg(F.count(F.lit(1)).alias("n"))
    return with_totals(per_day, cut).groupBy("chain", "event").agg(
        F.sum("n").alias("events"),
        F.coalesce(F.sum(F.when(F.col(day) >= F.col("cut"), F.col("n"))), F.lit(0)).alias("in_window"),
    )


def both_ends(edges: DataFrame) -> DataFrame:
    """Every edge seen from each of its accounts. A self transfer shows once and counts apart."""
    own = F.struct(F.col("sender").alias("account"), F.col("receiver").alias("other"), F.lit(True).alias("out"))
    far = F.struct(F.col("receiver").alias("account"), F.col("sender").alias("other"), F.lit(False).alias("out"))
    ends = F.when(F.col("sender") == F.col("receiver"), F.array(own)).otherwise(F.array(own, far))
    kept = [c for c in edges.columns if c not in ("sender", "receiver")]
    return edges.select(*kept, F.explode(ends).alias("e")).select(*kept, "e.*", (F.col("e.account") == F.col("e.other")).alias("self"))


def counterparties(edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One row per account and other side; with targets(account) only for these, and only their edges are folded."""
    if targets is not None:
        names = targets.select("account").distinct()
        asked = lambda end: names.select(F.col("account").alias(end), F.lit(True).alias(f"__{end}"))
        edges = edges.join(asked("sender"), "sender", "left").join(asked("receiver"), "receiver", "left").filter("__sender OR __receiver").drop("__sender", "__receiver")
    ends = both_ends(edges).filter(~F.col("self"))
    if targets is not None:
        ends = ends.join(names, "account", "left_semi")
    sent = F.count_if("out")
    got = F.count_if(~F.col("out"))
    return ends.groupBy("account", "other").agg(
        F.count(F.lit(1)).alias("transfers"),
        sent.alias("sent"),
        got.alias("received"),
        F.when((sent > 0) & (got > 0), "both").when(sent > 0, "out").otherwise("in").alias("direction"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.array_join(F.sort_array(F.collect_set("chain")), ",").alias("chains"),
    )


def asset_bags(edges: DataFrame, *keys: str) -> DataFrame:
    """Per account (and further keys) and asset: transfers, exact sums either way, self transfers apart."""
    ends = both_ends(edges)
    amount = lambda condition: F.coalesce(F.sum(F.when(condition & ~F.col("self"), F.col("amount"))), F.lit(0))
    return ends.groupBy("account", *keys, "chain", "asset").agg(
        F.count(F.lit(1)).alias("transfers"),
        F.count_if("self").alias("self_transfers"),
        amount(F.col("out")).alias("sent_raw"),
        amount(~F.col("out")).alias("received_raw"),
    )


def denomination(bags: DataFrame, decimals: DataFrame) -> DataFrame:
    """The scalable asset each account moved most often; amounts of other assets are not added to it."""
    key = F.concat_ws("/", "chain", "asset")
    known = bags.join(decimals, "asset", "left")
    scalable = F.col("decimals").isNotNull()
    best = F.min_by(
        F.when(scalable, F.struct("chain", "asset", "transfers", "decimals", "sent_raw", "received_raw")),
        F.when(scalable, F.struct(-F.col("transfers"), key)),
    )
    picked = known.groupBy("account").agg(
        F.sum("transfers").alias("all_transfers"), F.count(F.lit(1)).alias("assets"), best.alias("d")
    )
    return picked.select(
        "account",
        "all_transfers",
        "assets",
        F.concat_ws("/", "d.chain", "d.asset").alias("denomination"),
        F.col("d.transfers").alias("transfers"),
        S.scale_amount(F.col("d.sent_raw"), F.col("d.decimals")).alias("sent"),
        S.scale_amount(F.col("d.received_raw"), F.col("d.decimals")).alias("received"),
    )


def block_buckets(edges: DataFrame, block: str, width: int = 20_000) -> DataFrame:
    """Tumbling stretches of blocks, each folded once."""
    bucket = F.floor(F.col(block) / width).cast("bigint")
    return edges.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(block).alias("first_block"), F.max(block).alias("last_block")
    )


def corridors(messages: DataFrame) -> DataFrame:
    """Messages, priced messages and dollars per directed pair."""
    return messages.groupBy("origin", "dest").agg(
        F.count(F.lit(1)).alias("messages"), F.count("usd").alias("priced"), S.sum_or_zero(F.col("usd")).alias("usd")
    )


def corridor_nodes(pairs: DataFrame) -> DataFrame:
    """Sent and received per chain, from the corridor frame."""
    ends = F.explode(
        F.array(
            F.struct(F.col("origin").alias("chain"), F.col("messages").alias("sent"), F.lit(0).cast("bigint").alias("received")),
            F.struct(F.col("dest").alias("chain"), F.lit(0).cast("bigint").alias("sent"), F.col("messages").alias("received")),
        )
    )
    return pairs.select(ends.alias("e")).groupBy("e.chain").agg(
        F.sum("e.sent").alias("sent"), F.sum("e.received").alias("received"), F.sum(F.col("e.sent") + F.col("e.received")).alias("messages")
    )


def corridor_matrix(pairs: DataFrame) -> DataFrame:
    """Cells with row and column totals in long form; NULL stands for the total."""
    o, d = F.col("origin"), F.col("dest")
    return pairs.groupingSets([[o, d], [o], [d], []], o, d).agg(
        F.sum("messages").alias("messages"), F.sum("usd").alias("usd"), F.grouping_id().alias("level")
    )


def best_supported_id(rows: DataFrame, name: str, ident: str) -> DataFrame:
    """Per name the id most of its rows carry (smallest on a tie), and how many rows disagree."""
    counts = rows.groupBy(name, ident).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(ident).isNotNull()
    return counts.groupBy(name).agg(
        F.min_by(F.when(known, F.col(ident)), F.when(known, F.struct(-F.col("n"), F.col(ident)))).alias("id"),
        F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("agreeing"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("rows"),
    ).withColumn("conflicting", F.col("rows") - F.col("agreeing"))


def mode_of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key, the smallest on a tie."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(
        F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"), F.max("n").alias("support"), F.count(F.lit(1)).alias("distinct_values")
    )

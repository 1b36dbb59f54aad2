"""Prices stated by trades, and what trades are worth at them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.quantiles import upper_median
from ..session import settle
from .ranking import top_per_group, with_totals

RATES = "symbol string, rate double, observations bigint, pass int"


def usable_legs(legs: DataFrame) -> DataFrame:
    """Both symbols known and both amounts positive."""
    return legs.filter(
        F.col("in_symbol").isNotNull()
        & F.col("out_symbol").isNotNull()
        & (F.col("in_amount") > 0)
        & (F.col("out_amount") > 0)
    )


def derive_rates(legs: DataFrame, pegged: Iterable[str]) -> DataFrame:
    """Sweep outwards from the pegged symbols: a trade with one priced side states a price for the other.

    A pass gives every newly reached symbol the upper median of its observations; a priced symbol is not revised. Passes go on until one
    reaches no new symbol. A pass joins only the symbols that the one before it priced to legs of which no side was priced before;
    it leaves what those legs state and the legs that are still open, so each pass reads less than the one before.
    """
    spark = legs.sparkSession
    sides = ["in_symbol", "in_amount", "out_symbol", "out_amount"]
    open_legs = usable_legs(legs).select(*sides)
    rates = front = spark.createDataFrame([(symbol, 1.0, None, 0) for symbol in pegged], RATES)
    number = 0
    while True:
        number += 1
        paid = front.select(F.col("symbol").alias("in_symbol"), F.col("rate").alias("in_rate"))
        got = front.select(F.col("symbol").alias("out_symbol"), F.col("rate").alias("out_rate"))
        both = open_legs.join(paid, "in_symbol", "left").join(got, "out_symbol", "left")
        forward = F.col("in_rate").isNotNull() & F.col("out_rate").isNull()
        backward = F.col("out_rate").isNotNull() & F.col("in_rate").isNull()
        price = F.when(forward, F.col("in_amount") * F.col("in_rate") / F.col("out_amount")).when(backward, F.col("out_amount") * F.col("out_rate") / F.col("in_amount"))
        neither = F.col("in_rate").isNull() & F.col("out_rate").isNull()
        swept = both.filter(forward | backward | neither).select(
            F.when(forward, F.col("out_symbol")).when(backward, F.col("in_symbol")).alias("symbol"),
            price.alias("price"),
            *[F.when(neither, F.col(c)).alias(c) for c in sides],
            F.when(neither, "open").otherwise("stated").alias("kind"),
        )
        swept = settle(swept, f"sweep-{number}", "kind")
        stated = swept.filter("kind = 'stated'").select("symbol", "price")
        found = upper_median(stated, ["symbol"], "price", "rate").select(
            "symbol", "rate", F.col("n").alias("observations"), F.lit(number).alias("pass")
        )
        found = settle(found, f"rates-{number}")
        if found.isEmpty():
            break
        rates = rates.unionByName(found)
        front = found.filter("rate <> 0")
        open_legs = swept.filter("kind = 'open'").select(*sides)
    return rates


def value_input(trades: DataFrame, rates: DataFrame, symbol: str, amount: str, name: str = "usd") -> DataFrame:
    """Dollars of the input side; unknown without a rate."""
    known = rates.select(F.col("symbol").alias("__symbol"), F.col("rate").alias("__rate"))
    joined = trades.join(known, F.col(symbol) == F.col("__symbol"), "left")
    return joined.withColumn(name, F.col(amount) * F.col("__rate")).drop("__symbol", "__rate")


def all_or_nothing(usd: Column) -> Column:
    """Sum over the legs, unknown as soon as one leg is."""
    return F.when(F.count_if(usd.isNull()) == 0, F.sum(usd))


def value_routed(legs: DataFrame) -> DataFrame:
    """Dollars per routed trade: every input leg must be priced."""
    sent = F.col("side") == "in"
    return legs.filter(sent).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("in_legs"),
        F.count_if(F.col("usd").isNull()).alias("unpriced_legs"),
        all_or_nothing(F.col("usd")).alias("usd"),
    )


def normalise_routed(legs: DataFrame) -> DataFrame:
    """One trade per order with legs on both sides: first input, last output, venue, number of legs."""
    at = F.struct("leg", "leg_key")
    sent, got = F.col("side") == "in", F.col("side") == "out"
    leg = F.struct("asset_id", "amount")
    folded = legs.groupBy("order_id", "account", "operation").agg(
        F.count_if(sent).alias("inputs"),
        F.count_if(got).alias("outputs"),
        F.min_by(F.when(sent, leg), F.when(sent, at)).alias("first_in"),
        F.max_by(F.when(got, leg), F.when(got, at)).alias("last_out"),
    )
    return folded.select(
        "order_id",
        "account",
        S.initiation_venue(F.col("operation")).alias("venue"),
        "inputs",
        "outputs",
        (F.col("inputs") + F.col("outputs")).alias("hops"),
        F.col("first_in.asset_id").alias("asset_in"),
        F.col("first_in.amount").alias("amount_in"),
        F.col("last_out.asset_id").alias("asset_out"),
        F.col("last_out.amount").alias("amount_out"),
    )


def with_both_sides(normalised: DataFrame) -> DataFrame:
    return normalised.filter((F.col("inputs") > 0) & (F.col("outputs") > 0))


def routed_quality(normalised: DataFrame) -> DataFrame:
    """How many trades were read, kept, and dropped for want of a side."""
    whole = (F.col("inputs") > 0) & (F.col("outputs") > 0)
    return normalised.agg(
        F.count(F.lit(1)).alias("read"),
        F.count_if(whole).alias("kept"),
        F.count_if(~whole).alias("without_balances"),
        F.count_if(whole & (F.col("inputs") > 1)).alias("many_inputs"),
    )


def normalise_orders(legs: DataFrame) -> DataFrame:
    """Orders as trades: dollars of the priced input legs only, unknown when none is priced."""
    sent = F.col("side") == "in"
    # What an order has once is a grouping key: text in an aggregate's buffer would force a sort.
    return legs.groupBy("order_id", "account", "status", "partner_hex").agg(
        F.sum(F.when(sent, F.col("usd"))).alias("usd"),
        F.count_if(sent & F.col("usd").isNull()).alias("unpriced_legs"),
    ).select(
        "order_id",
        "account",
        "status",
        F.coalesce(F.col("status") == "REFUNDED", F.lit(False)).alias("failed"),
        "usd",
        "unpriced_legs",
        S.printable_or_null(F.col("partner_hex")).alias("partner"),
    )


def net_flows(legs: DataFrame) -> DataFrame:
    """Per account and asset: what went out, what came in, the difference, in units and in dollars.

    `amount` NULL is an unstated leg; an asset without any priced leg has no dollar figures.
    """
    sent, got = F.col("side") == "in", F.col("side") == "out"
    amount, usd = F.col("amount").cast("decimal(28,6)"), F.col("usd")
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
    flows = legs.groupBy("account", "asset_id").agg(
        zero(F.when(sent, amount)).alias("sent"),
        zero(F.when(got, amount)).alias("received"),
        zero(F.when(sent, usd)).alias("sent_usd"),
        zero(F.when(got, usd)).alias("received_usd"),
        F.count_if(sent).alias("legs_out"),
        F.count_if(got).alias("legs_in"),
        F.count_if(F.col("amount").isNull()).alias("unstated"),
        (F.count("usd") > 0).alias("priced"),
    )
    net, net_usd = F.col("received") - F.col("sent"), F.col("received_usd") - F.col("sent_usd")
    dollars = lambda x, name: F.when(F.col("priced"), S.round_cents(S.dbl(x))).alias(name)
    return flows.select(
        "account",
        "asset_id",
        S.six_digits(S.dbl(F.col("sent"))).alias("sent"),
        S.six_digits(S.dbl(F.col("received"))).alias("received"),
        S.six_digits(S.dbl(net)).alias("net"),
        dollars(F.col("sent_usd"), "sent_usd"),
        dollars(F.col("received_usd"), "received_usd"),
        dollars(net_usd, "net_usd"),
        "legs_out",
        "legs_in",
        "unstated",
        "priced",
    )


def rate_sample(trades: DataFrame, height: str, tie: str, chunks: int = 5, size: int = 1000) -> DataFrame:
    """The first `size` trades of each of a few equally wide stretches of the height span."""
    span = trades.agg(F.min(height).alias("__lo"), F.max(height).alias("__hi"))
    width = F.greatest(F.lit(1), F.ceil((F.col("__hi") - F.col("__lo") + 1) / F.lit(chunks)))
    chunk = F.floor((F.col(height) - F.col("__lo")) / width).cast("bigint")
    marked = with_totals(trades, span).withColumn("chunk", chunk).drop("__lo", "__hi")
    return top_per_group(marked, ["chunk"], [F.asc(height), F.asc(tie)], size)


def unknown_tokens(legs: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """Legs whose token no table names, counted per token."""
    return legs.join(tokens.select(key), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("legs"))


def fee_split(usd: Column, amount: Column, fee_rate: Column) -> Column:
    """Fee in the input token and in dollars; an unknown price leaves the dollars unknown."""
    return F.struct((amount * fee_rate).alias("fee_amount"), (S.dbl(usd) * fee_rate).alias("fee_usd"))


def with_exception_decimals(symbol: Column, raw: Column, decimals: Column, rules: list[tuple[str, int, int]]) -> Column:
    """Decimals of a row, where short raw amounts of a listed symbol use other ones: (symbol, below digits, decimals)."""
    out = decimals
    for name, below, other in rules:
        out = F.when((symbol == name) & (F.length(raw) < below), F.lit(other)).otherwise(out)
    return out

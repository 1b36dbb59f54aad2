"""Positions, lending reserves, pools and pegs. Every frame carries its snapshot, so history is one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import settle


#: A walk of some hops from `id`: where it leads (`to`, NULL at its end), the product of ratios and the number of hops up to there, and the
#: deepest price on it, with the product and hops up to that.
WALK = ["id", "to", "factor", "hops", "unit", "by_oracle", "unit_factor", "unit_hops"]


def _joined_walks(first: DataFrame, second: DataFrame) -> DataFrame:
    """Each walk of `first` followed by the walk of `second` that starts where it leads."""
    then = second.select(*[F.col(c).alias(f"__{c}") for c in WALK])
    deeper = F.col("__unit").isNotNull()
    pick = lambda there, here: F.when(deeper, there).otherwise(here)
    return first.join(then, F.col("to") == F.col("__id")).select(
        "id",
        F.col("__to").alias("to"),
        (F.col("factor") * F.col("__factor")).alias("factor"),
        (F.col("hops") + F.col("__hops")).alias("hops"),
        pick(F.col("__unit"), F.col("unit")).alias("unit"),
        pick(F.col("__by_oracle"), F.col("by_oracle")).alias("by_oracle"),
        pick(F.col("factor") * F.col("__unit_factor"), F.col("unit_factor")).alias("unit_factor"),
        pick(F.col("hops") + F.col("__unit_hops"), F.col("unit_hops")).alias("unit_hops"),
    )


def _walked(steps: DataFrame, most: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Walks to their end, those still going after 2 ** most hops, and all walks by round.

    Every round doubles the walks: one followed by the walk of the node it leads to. Ended walks are joined to, but not again.
    """
    whole, rounds = settle(steps, "walks"), []
    while True:
        rounds.append(whole)
        going = whole.filter(F.col("to").isNotNull())
        if len(rounds) > most or going.isEmpty():
            return whole.filter(F.col("to").isNull()), going, rounds
        whole = settle(whole.filter(F.col("to").isNull()).unionByName(_joined_walks(going, whole)), "walks")


def _around(on_cycle: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """Walks once around for nodes of cycles (id, length), put together from walks of doubled lengths."""
    walks, most = None, on_cycle.agg(F.max("length")).first()[0]
    for k in range(most.bit_length()):
        odd = F.shiftright("length", k).bitwiseAND(F.lit(1)) == 1
        if walks is None:
            walks = on_cycle.select("id", "length", F.col("id").alias("to"), F.lit(1.0).alias("factor"), F.lit(0).cast("bigint").alias("hops"), F.lit(None).cast("double").alias("unit"), F.lit(None).cast("boolean").alias("by_oracle"), F.lit(None).cast("double").alias("unit_factor"), F.lit(None).cast("bigint").alias("unit_hops"))
        longer = _joined_walks(walks.filter(odd), rounds[k]).join(walks.select("id", "length"), "id")
        walks = settle(longer.unionByName(walks.filter(~odd)), "around")
    return walks.withColumn("to", F.lit(None).cast(on_cycle.schema["id"].dataType)).select(*WALK)


def resolve_prices(assets: DataFrame, wraps: DataFrame, oracle: DataFrame, spot: DataFrame) -> DataFrame:
    """Price of wrapped assets: the oracle first, else the wrapped asset's price times the ratio, else the spot.

    assets(id), wraps(id, underlying, ratio), oracle(id, price), spot(id, price), one row an id. A walk ends at an oracle price, at an asset that
    wraps nothing known, or where it comes back to an asset that it has seen; without an oracle the deepest spot on it counts. Walks are
    doubled in length each round, so a chain of d wraps takes log d rounds. Nodes whose walks never end lie on or before a cycle: nodes of
    cycles are where such walks have led after as many hops as there are wraps; they are walked once around, the others up to them.
    """
    links = wraps.filter(F.col("underlying").isNotNull() & F.col("ratio").isNotNull()).select("id", "underlying", F.col("ratio").cast("double").alias("ratio"))
    prices = oracle.select("id", F.col("price").cast("double").alias("oracle")).join(spot.select("id", F.col("price").cast("double").alias("spot")), "id", "full_outer")
    nodes = assets.select("id").union(links.select("id")).union(links.select("underlying")).distinct()
    known = nodes.join(links, "id", "left").join(prices, "id", "left")
    ends = F.col("oracle").isNotNull() | F.col("underlying").isNull()
    priced = F.coalesce("oracle", "spot").isNotNull()
    first = known.select(
        "id",
        F.when(~ends, F.col("underlying")).alias("to"),
        F.coalesce("ratio", F.lit(1.0)).alias("factor"),
        F.lit(1).cast("bigint").alias("hops"),
        F.coalesce("oracle", "spot").alias("unit"),
        F.when(priced, F.col("oracle").isNotNull()).alias("by_oracle"),
        F.when(priced, F.lit(1.0)).alias("unit_factor"),
        F.when(priced, F.lit(0).cast("bigint")).alias("unit_hops"),
    )
    first = settle(first, "wraps")
    done, going, rounds = _walked(first, first.filter("to IS NOT NULL").count().bit_length())
    if not going.isEmpty():
        on_cycle = settle(going.select(F.col("to").alias("id")).distinct(), "on-cycle")
        tails = going.join(on_cycle, "id", "left_anti").select("id")
        # From a node of a cycle, the smallest node around names the cycle; reached by doubling as well.
        least = first.join(on_cycle, "id", "left_semi").select("id", "to", F.col("id").alias("name"))
        for _ in range(len(rounds)):
            then = least.select(F.col("id").alias("__id"), F.col("to").alias("__to"), F.col("name").alias("__name"))
            least = settle(least.join(then, F.col("to") == F.col("__id")).select("id", F.col("__to").alias("to"), F.least("name", "__name").alias("name")), "cycle-names")
        lengths = least.groupBy("name").agg(F.count(F.lit(1)).alias("length"))
        around = settle(_around(settle(least.join(lengths, "name").select("id", "length"), "cycle-lengths"), rounds), "cycles")
        before, _, _ = _walked(first.join(tails, "id", "left_semi").unionByName(around), len(rounds))
        done = done.join(around.select("id").union(tails), "id", "left_anti").unionByName(before)
    return assets.select("id").join(done, "id", "left").select(
        "id",
        S.six_digits(F.col("unit") * F.col("unit_factor")).alias("price"),
        F.when(F.col("unit").isNull(), F.lit(None).cast("string")).when(F.col("by_oracle"), "oracle").otherwise("spot").alias("via"),
        F.col("unit_hops").alias("hops"),
    )


def capital_by_venue(positions: DataFrame, snapshot: str) -> DataFrame:
    """Gross, derived, distinct, borrowed and net dollars per venue, with the snapshot's total (venue NULL)."""
    usd, derived = F.col("usd"), F.col("derived")
    s, v = F.col(snapshot), F.col("venue")
    out = positions.groupingSets([[s, v], [s]], s, v).agg(
        F.grouping("venue").cast("boolean").alias("is_total"),
        F.count(F.lit(1)).alias("positions"),
        F.count_if(usd.isNull()).alias("unpriced"),
        S.sum_or_zero(usd).alias("gross"),
        S.sum_or_zero(F.when(derived, usd)).alias("derived_usd"),
        S.sum_or_zero(F.when(~derived, usd)).alias("distinct_usd"),
        S.sum_or_zero(F.when(~derived & usd.isNotNull(), F.col("borrowed_usd"))).alias("borrowed"),
    )
    money = [S.dbl(F.col(c)).alias(c) for c in ("gross", "derived_usd", "distinct_usd", "borrowed")]
    net = S.dbl(F.col("distinct_usd") - F.col("borrowed")).alias("net")
    return out.select(snapshot, "venue", "is_total", "positions", "unpriced", *money, net)


def capital_by_asset(positions: DataFrame, snapshot: str) -> DataFrame:
    """Per base asset, receipts left out and what is borrowed against it taken off; `net_amount` NULL means all of it."""
    usd = F.col("usd")
    rows = positions.filter(~F.col("derived")).groupBy(snapshot, "asset").agg(
        S.sum_or_zero(usd - F.coalesce("borrowed_usd", F.lit(0))).alias("net"),
        S.sum_or_zero(usd).alias("gross"),
        S.sum_or_zero(F.when(usd.isNotNull(), F.coalesce("net_amount", "amount").cast("decimal(28,6)"))).alias("net_amount"),
        S.sum_or_zero(F.when(usd.isNotNull(), F.col("amount").cast("decimal(28,6)"))).alias("gross_amount"),
        F.count_if(usd.isNull()).alias("unpriced"),
        F.countDistinct("venue").alias("venues"),
    )
    sums = ("net", "gross", "net_amount", "gross_amount")
    return rows.select(snapshot, "asset", *[S.dbl(F.col(c)).alias(c) for c in sums], "unpriced", "venues")


def pool_checks(pools: DataFrame, legs: DataFrame) -> DataFrame:
    """What a pool's shares say beside what its legs sum to; a positive gap prices a single unpriced leg.

    pools(pool, via_shares), legs(pool, leg, amount, usd).
    """
    unpriced = F.col("usd").isNull()
    sums = legs.groupBy("pool").agg(
        S.sum_or_zero(F.col("usd")).alias("leg_sum"),
        F.count_if(unpriced).alias("unpriced"),
        F.max(F.when(unpriced, F.struct("leg", "amount"))).alias("one"),
    )
    gap = F.col("via_shares") - F.col("leg_sum")
    usable = (F.col("gap") > 0) & (F.col("unpriced") > 0)
    single = usable & (F.col("unpriced") == 1)
    return (
        pools.join(sums, "pool")
        .withColumn("gap", gap)
        .select(
            "pool",
            S.dbl(F.col("leg_sum")).alias("leg_sum"),
            S.dbl(F.col("via_shares")).alias("via_shares"),
            S.dbl(F.col("gap")).alias("gap"),
            S.six_digits(S.dbl(F.col("gap")) / F.when(F.col("via_shares") != 0, S.dbl(F.col("via_shares"))) * 100).alias("gap_percent"),
            "unpriced",
            F.when(single, F.col("one.leg")).alias("implied_leg"),
            F.when(single & (F.col("one.amount") != 0), S.dbl(F.col("gap")) / S.dbl(F.col("one.amount"))).alias("implied_price"),
            F.when(usable & (F.col("unpriced") > 1), S.dbl(F.col("gap"))).alias("unattributed"),
        )
    )


def supply_check(held: DataFrame, issuance: DataFrame, keys: Sequence[str], tolerance: float = 1.02) -> DataFrame:
    """Amount held, net and gross, over what was issued; a share above the tolerance is flagged."""
    rows = held.join(issuance, list(keys)).filter("issued > 0")
    net, gross = F.col("net_amount") / F.col("issued"), F.col("gross_amount") / F.col("issued")
    return rows.select(
        *keys,
        S.six_digits(net).alias("net_share"),
        S.six_digits(gross).alias("gross_share"),
        (S.six_digits(net) > tolerance).alias("over_net"),
        (S.six_digits(gross) > tolerance).alias("over_gross"),
    )


def market_totals(reserves: DataFrame, snapshot: str) -> DataFrame:
    """Totals per snapshot; a sum over nothing known is NULL, not zero."""
    wrapper = F.when(F.col("is_wrapper"), F.col("supplied_usd"))
    sums = reserves.groupBy(snapshot).agg(
        F.count(F.lit(1)).alias("reserves"),
        F.sum("supplied_usd").alias("supplied"),
        F.sum("borrowed_usd").alias("borrowed"),
        F.sum(F.col("supplied_usd") - F.col("borrowed_usd")).alias("available"),
        F.sum(wrapper).alias("wrapped"),
        F.count_if(F.col("supplied_usd").isNull()).alias("unpriced"),
        F.count_if("frozen").alias("frozen"),
    )
    d = lambda c: S.dbl(F.col(c))
    return sums.select(
        snapshot,
        "reserves",
        *[d(c).alias(c) for c in ("supplied", "borrowed", "available", "wrapped")],
        F.try_divide(d("borrowed"), d("supplied")).alias("utilisation"),
        F.try_divide(d("wrapped"), d("supplied")).alias("wrapper_share"),
        "unpriced",
        "frozen",
    )


def read_paths(rows: DataFrame, snapshot: str) -> DataFrame:
    """Per read path: what it sees, and what a reader of that path alone would miss."""
    s, p = F.col(snapshot), F.col("path")
    paths = rows.groupBy(s, p).agg(F.count(F.lit(1)).alias("assets"), F.sum("tvl").alias("tvl"))
    whole = paths.groupBy(s).agg(F.sum("assets").alias("all_assets"), F.sum("tvl").alias("all_tvl"))
    missed = F.col("all_tvl") - F.coalesce("tvl", F.lit(0))
    return paths.join(whole, snapshot).select(
        snapshot,
        "path",
        "assets",
        S.dbl(F.col("tvl")).alias("tvl"),
        (F.col("all_assets") - F.col("assets")).alias("missed_assets"),
        S.dbl(missed).alias("missed_tvl"),
        F.try_divide(S.dbl(missed), S.dbl(F.col("all_tvl"))).alias("missed_share"),
    )


def half_of_total(reserves: DataFrame, snapshot: str, asset: str, value: str) -> DataFrame:
    """How many of the largest reserves hold half of everything, per snapshot."""
    known = reserves.filter(F.col(value) > 0).select(snapshot, asset, value)
    total = known.groupBy(snapshot).agg(F.sum(value).alias("__total"), F.count(F.lit(1)).alias("reserves"))
    order = Window.partitionBy(snapshot).orderBy(F.desc(value), F.asc(asset))
    ranked = known.withColumn("__rank", F.row_number().over(order)).withColumn(
        "__cum", F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    halves = ranked.join(total, snapshot).filter(F.col("__cum") * 2 >= F.col("__total"))
    return halves.groupBy(snapshot).agg(F.min("__rank").cast("bigint").alias("half_held_by"), F.max("reserves").alias("reserves")).filter("reserves >= 2")


def mint_capacity(buckets: DataFrame, supply: DataFrame, snapshot: str) -> DataFrame:
    """Capacity, level and headroom per minter, and whether the levels add up to the supply."""
    sums = buckets.groupBy(snapshot).agg(F.sum("level").alias("level_sum"))
    return (
        buckets.join(sums, snapshot)
        .join(supply, snapshot)
        .withColumn("headroom", F.col("capacity") - F.col("level"))
        .withColumn("at_capacity", (F.col("capacity") > 0) & (F.col("level") >= F.col("capacity")))
        .withColumn("matches_supply", F.col("level_sum") == F.col("supply"))
    )


def registrations(vaults: DataFrame, collateral: str, operator: str) -> DataFrame:
    """Registrations and distinct operators per collateral, and over all (collateral NULL)."""
    c = F.col(collateral)
    return vaults.groupingSets([[c], []], c).agg(
        F.count(F.lit(1)).alias("registrations"), F.countDistinct(operator).alias("operators")
    )


def risk_categories(members: DataFrame, category: str, member: str, ltv: Column) -> DataFrame:
    """Members and largest leverage per category; the member list itself is the input frame."""
    return members.groupBy(category).agg(
        F.count(F.lit(1)).alias("members"), F.min(member).alias("first_member"), F.max(ltv).alias("ltv")
    ).withColumn("max_leverage", F.try_divide(F.lit(1.0), 1 - F.col("ltv")))


def peg_states(pools: DataFrame, pegs: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per pool asset: its peg aligned by position, the gap to an outside rate, age, ramping, alignment.

    pools(pool, assets array, initial_amp, final_amp, final_block, head), pegs(pool, ratios array, recorded_block),
    rates(asset, rate).
    """
    aligned = F.size("assets") == F.size("ratios")
    rows = (
        pools.join(pegs, "pool", "left")
        .withColumn("aligned", F.when(F.col("ratios").isNotNull(), aligned))
        .select("*", F.posexplode("assets").alias("position", "asset"))
    )
    peg = F.when(F.col("aligned"), F.try_element_at("ratios", F.col("position") + 1))
    ramping = (F.col("initial_amp") != F.col("final_amp")) & (F.col("head") < F.col("final_block"))
    return rows.withColumn("peg", peg).join(rates, "asset", "left").select(
        "pool",
        "asset",
        F.col("position").cast("bigint").alias("position"),
        "peg",
        F.when(F.col("rate") > 0, S.gap_bps(F.col("peg"), F.col("rate"))).alias("gap_bps"),
        (F.col("head") - F.col("recorded_block")).alias("peg_age"),
        ramping.alias("ramping"),
        "aligned",
    )


def order_book(orders: DataFrame) -> DataFrame:
    """Implied price per open order; an amount nobody can scale leaves it unpriced."""
    price = F.when(F.col("amount_in") > 0, F.col("amount_out") / F.col("amount_in"))
    return orders.withColumn("price", price).withColumn(
        "unpriced", F.col("amount_in").isNull() | F.col("amount_out").isNull()
    )


def order_book_counts(book: DataFrame) -> DataFrame:
    return book.agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if("unpriced").alias("unpriced"),
        F.count_if("is_pallet").alias("pallet"),
        F.count_if("partially_fillable").alias("partially_fillable"),
    )

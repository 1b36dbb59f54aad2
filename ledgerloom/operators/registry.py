"""What a token is and what it is worth: registries, dictionaries, quotes and their disagreements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.quantiles import middles
from ..session import settle
from .ranking import top_k


def resolve_meaning(ids: DataFrame, indexer: DataFrame, registry: DataFrame) -> DataFrame:
    """Symbol and decimals per id: the registry first, else what the indexer says (flagged), else unknown.

    ids(id), indexer(id, registry_id, symbol, decimals), registry(registry_id, symbol, decimals).
    """
    theirs = indexer.select(
        "id", "registry_id", F.col("symbol").alias("i_symbol"), F.col("decimals").alias("i_decimals")
    )
    ours = registry.select("registry_id", F.col("symbol").alias("r_symbol"), F.col("decimals").alias("r_decimals"))
    from_registry = F.col("r_decimals").isNotNull() & F.col("r_symbol").isNotNull()
    from_indexer = ~from_registry & F.col("i_decimals").isNotNull() & F.col("i_symbol").isNotNull()
    pick = lambda r, i: F.when(from_registry, F.col(r)).when(from_indexer, F.col(i))
    return (
        ids.join(theirs, "id", "left")
        .join(ours, "registry_id", "left")
        .select(
            "id",
            "registry_id",
            pick("r_symbol", "i_symbol").alias("symbol"),
            pick("r_decimals", "i_decimals").alias("decimals"),
            from_indexer.alias("borrowed"),
            F.coalesce(F.col("r_decimals") != F.col("i_decimals"), F.lit(False)).alias("disagree"),
            F.col("registry_id").isNotNull().alias("mapped"),
        )
    )


def label_symbols(resolved: DataFrame) -> DataFrame:
    """A symbol carried by more than one id gets the id appended."""
    users = resolved.filter(F.col("symbol").isNotNull()).groupBy("symbol").agg(F.count(F.lit(1)).alias("users"))
    own = F.coalesce(F.col("registry_id"), F.col("id")).cast("string")
    label = F.when(F.col("users") > 1, F.concat("symbol", F.lit("·"), own)).otherwise(F.col("symbol"))
    return resolved.join(users, "symbol", "left").withColumn("label", label).drop("users")


def shared_symbols(tokens: DataFrame) -> DataFrame:
    """Symbols that more than one id carries."""
    counts = tokens.groupBy("symbol").agg(F.count(F.lit(1)).alias("ids"), F.min("id").alias("first_id"))
    return counts.filter("ids > 1")


def audit(ours: DataFrame, theirs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full comparison of two registries, one row per token, with its class."""
    keys = list(keys)
    left = ours.select(*keys, F.col("symbol").alias("our_symbol"), F.col("decimals").alias("our_decimals"), F.lit(True).alias("__o"))
    once = theirs.groupBy(*keys).agg(F.min(F.struct("symbol", "decimals")).alias("t"))
    right = once.select(*keys, F.col("t.symbol").alias("their_symbol"), F.col("t.decimals").alias("their_decimals"), F.lit(True).alias("__t"))
    verdict = (
        F.when(F.col("__t").isNull(), "only-ours")
        .when(F.col("__o").isNull(), "adopted")
        .when(F.col("our_decimals") != F.col("their_decimals"), "decimals-clash")
        .when(F.col("our_symbol") != F.col("their_symbol"), "symbol-clash")
        .otherwise("agree")
    )
    return left.join(right, keys, "full_outer").withColumn("verdict", verdict).drop("__o", "__t")


def describe_legs(legs: DataFrame, audited: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Token of each leg: blocked when decimals clash, own table first, adopted rows second, else unknown."""
    vouched = ~F.col("verdict").isin("decimals-clash")
    dictionary = audited.select(
        *keys,
        "verdict",
        F.when(vouched, F.coalesce("our_symbol", "their_symbol")).alias("symbol"),
        F.when(vouched, F.coalesce("our_decimals", "their_decimals")).alias("decimals"),
    )
    return legs.join(dictionary, list(keys), "left").withColumn("blocked", F.coalesce(~vouched, F.lit(False)))


def price_by_location(assets: DataFrame, quotes: DataFrame, known: DataFrame) -> DataFrame:
    """Value by location bytes, never by ticker, with a stated status for every asset."""
    q = quotes.select("location", F.col("usd").alias("price"), F.col("decimals").alias("q_decimals"), F.col("source").alias("__source"), F.lit(True).alias("__q"))
    k = known.select("location", F.lit(True).alias("__k"))
    status = (
        F.when(F.col("decimals").isNull(), "no-decimals")
        .when(F.col("__q").isNull() & F.col("__k").isNull(), "not-listed")
        .when(F.col("__q").isNull(), "no-venue")
        .when(F.col("q_decimals") != F.col("decimals"), "decimals-disagree")
        .otherwise("priced")
    )
    priced = F.col("status") == "priced"
    return (
        assets.join(q, "location", "left")
        .join(k, "location", "left")
        .withColumn("status", status)
        .select(
            *assets.columns,
            "price",
            F.when(priced, F.col("__source")).alias("source"),
            "status",
            F.when(priced, S.scale_amount(F.col("supply"), F.col("decimals")) * F.col("price")).alias("usd"),
            F.when(F.col("decimals").isNull(), S.scale_amount(F.col("supply"), F.col("q_decimals")) * F.col("price")).alias("would_be_usd"),
        )
    )


def valued_totals(valued: DataFrame) -> DataFrame:
    """Totals with coverage: what is priced, by which source, and why the rest is not."""
    # Eight places hold every value exactly; the sums are given with four.
    exact = lambda x: x.cast("decimal(28,8)")
    usd = exact(F.col("usd"))
    total = lambda condition, x: S.dbl(F.sum(F.when(condition, x)).cast("decimal(38,4)"))
    status = F.col("status")
    return valued.agg(
        F.count(F.lit(1)).alias("assets"),
        F.count_if(status == "priced").alias("priced"),
        total(F.lit(True), usd).alias("priced_usd"),
        F.count_if(F.col("source") == "oracle").alias("by_oracle"),
        total(F.col("source") == "oracle", usd).alias("by_oracle_usd"),
        F.count_if(F.col("source") == "spot").alias("by_spot"),
        total(F.col("source") == "spot", usd).alias("by_spot_usd"),
        F.count_if(status == "no-decimals").alias("no_decimals"),
        F.count_if(status == "not-listed").alias("not_listed"),
        F.count_if(status == "no-venue").alias("no_venue"),
        F.count_if(status == "decimals-disagree").alias("decimals_disagree"),
        F.try_divide(F.count_if(status == "priced"), F.count(F.lit(1))).alias("coverage_by_count"),
        total(F.lit(True), exact(F.col("would_be_usd"))).alias("excluded_usd"),
    )


def namesakes(assets: DataFrame, registry: DataFrame) -> DataFrame:
    """For each unpriced asset: how many other ids carry its symbol, how many of those are priced, and the dearest.

    The members of a symbol are summed up once, so the work grows with the members, not with their pairs; the
    full list of a symbol's members is the registry itself, keyed by upper-cased symbol.
    """
    sym = F.upper("symbol").alias("__sym")
    ranked = F.when(F.col("usd").isNotNull(), F.struct(F.col("usd"), -F.col("id"), F.col("id").alias("id")))
    groups = registry.select(sym, "id", "usd").groupBy("__sym").agg(
        F.count(F.lit(1)).alias("members"), F.count("usd").alias("priced_members"), F.max(ranked).alias("best")
    )
    seconds = (
        registry.select(sym, "id", "usd")
        .join(groups.select("__sym", F.col("best.id").alias("best_id")), "__sym")
        .filter(F.col("id") != F.col("best_id"))
        .groupBy("__sym")
        .agg(F.max(ranked).alias("second"))
    )
    own = registry.select("id", F.col("usd").isNotNull().alias("__own"))
    unpriced = assets.filter(F.col("usd").isNull()).select("id", "symbol", sym)
    dearest = F.when(F.col("best.id") == F.col("id"), F.col("second")).otherwise(F.col("best"))
    return (
        unpriced.join(groups, "__sym", "left")
        .join(seconds, "__sym", "left")
        .join(own, "id", "left")
        .withColumn("d", dearest)
        .select(
            "id",
            "symbol",
            (F.coalesce("members", F.lit(0)) - F.col("__own").isNotNull().cast("bigint")).alias("namesakes"),
            (F.coalesce("priced_members", F.lit(0)) - F.coalesce(F.col("__own"), F.lit(False)).cast("bigint")).alias("priced_namesakes"),
            F.col("d.id").alias("dearest_id"),
            F.col("d.usd").alias("dearest_usd"),
        )
    )


def enumerate_sources(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Every id any source names, with the names of those sources. Each frame is reduced to its ids first."""
    tagged = None
    for name, frame in sources.items():
        ids = frame.select(key).distinct().withColumn("source", F.lit(name))
        tagged = ids if tagged is None else tagged.unionByName(ids)
    return tagged.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
        F.count(F.lit(1)).alias("named_by"),
    )


def resolve_names(names: DataFrame, topology: DataFrame) -> DataFrame:
    """Chains by number, numeric text or alias, within a network; an unknown name stays unknown.

    topology(network, para, name, aliases array): keyed by network and number, never by number alone.
    """
    keys = F.array_distinct(
        F.transform(F.concat(F.array(F.col("para").cast("string"), F.col("name")), F.col("aliases")), F.lower)
    )
    lookup = topology.select("network", F.explode(keys).alias("__alias"), "para", F.col("name").alias("chain"))
    return names.withColumn("__alias", F.lower(F.trim("name"))).join(lookup, ["network", "__alias"], "left").drop("__alias")


def confirm_wraps(wraps: DataFrame, listed: DataFrame) -> DataFrame:
    """A wrap is confirmed when the token it claims lists it back; decimals are compared as well.

    wraps(wrap, underlying, decimals), listed(underlying, wrap, decimals).
    """
    back = listed.select("underlying", F.col("wrap").alias("__back"), F.col("decimals").alias("__decimals"))
    return wraps.join(back, "underlying", "left").select(
        "wrap",
        "underlying",
        F.coalesce(F.col("__back") == F.col("wrap"), F.lit(False)).alias("confirmed"),
        (F.col("__decimals") == F.col("decimals")).alias("decimals_agree"),
    )


def staked_price(reserves: DataFrame, spot: DataFrame) -> DataFrame:
    """Price by exact symbol, else by the symbol without its staking prefix."""
    exact = spot.select("symbol", F.col("price").alias("__exact"))
    base = spot.select(F.col("symbol").alias("__base"), F.col("price").alias("__based"))
    stripped = reserves.withColumn("__base", F.regexp_replace("symbol", "^st", ""))
    return stripped.join(exact, "symbol", "left").join(base, "__base", "left").select(
        *reserves.columns,
        F.coalesce("__exact", "__based").alias("price"),
        F.when(F.col("__exact").isNotNull(), "symbol").when(F.col("__based").isNotNull(), "stripped").alias("via"),
    )


def hub_prices(pools: DataFrame, at: str) -> DataFrame:
    """Implied hub price per snapshot and each asset's spot price from it.

    pools(at, asset, reserve, hub_reserve, oracle). The hub price is the mean-of-middles median over the assets
    an oracle prices; the spread between those anchors is kept.
    """
    pools = settle(pools, "hub-pools")
    anchored = F.col("oracle").isNotNull() & (F.col("reserve") != 0) & (F.col("hub_reserve") != 0)
    anchors = pools.filter(anchored).select(at, (F.col("reserve") * F.col("oracle") / F.col("hub_reserve")).alias("hub"))
    med = middles(anchors, [at], "hub").select(at, "n", ((F.col("lower") + F.col("upper")) / 2).alias("hub_usd"))
    spread = anchors.groupBy(at).agg(F.max("hub").alias("hi"), F.min("hub").alias("lo"))
    hub = med.join(spread, at).select(
        at,
        F.col("n").alias("anchors"),
        "hub_usd",
        F.when((F.col("n") > 1) & (F.col("hub_usd") != 0), (F.col("hi") - F.col("lo")) / F.col("hub_usd") * 10000).alias("spread_bps"),
    )
    spot = F.when(F.col("reserve") != 0, F.col("hub_reserve") * F.col("hub_usd") / F.col("reserve"))
    return pools.join(hub, at, "left").withColumn("spot", spot)


def prefer_oracle(spots: DataFrame) -> DataFrame:
    """Oracle price first, implied spot second, and where it came from."""
    return spots.withColumn("usd", F.coalesce("oracle", "spot")).withColumn(
        "source", F.when(F.col("oracle").isNotNull(), "oracle").when(F.col("spot").isNotNull(), "spot")
    )


def price_gap(spots: DataFrame) -> DataFrame:
    """Assets both paths price, and how far the spot lies from the oracle."""
    both = spots.filter(F.col("oracle").isNotNull() & F.col("spot").isNotNull())
    return both.withColumn("difference_pct", S.percent_diff(F.col("spot"), F.col("oracle")))


def bridged_classes(assets: DataFrame) -> DataFrame:
    """Rows of a location table sorted into bridged and sibling; odd rows are kept and flagged.

    A location is hex: two digits of junction count, two of junction kind, then the network id.
    """
    h = F.lower(F.col("location"))
    anomaly = (
        F.when(~h.rlike("^[0-9a-f]{6,}$"), "undecodable")
        .when(~F.substring(h, 3, 2).isin("09", "00"), "wrong-first-junction")
        .when((F.substring(h, 3, 2) == "09") & (F.substring(h, 5, 2) == F.lit("00")), "own-network")
    )
    kind = F.when(anomaly.isNotNull(), F.lit(None).cast("string")).when(F.substring(h, 3, 2) == "09", "bridged").otherwise("sibling")
    return assets.withColumn("anomaly", anomaly).withColumn("kind", kind)


def worst_gaps(pairs: DataFrame, metric: str, tie: Sequence[str], n: int) -> DataFrame:
    return top_k(pairs, [F.desc(metric), *[F.asc(c) for c in tie]], n)



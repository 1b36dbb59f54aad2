"""Whole reports: the named results a caller asks for, each a set of frames composed from the operators.

A report takes canonical frames and returns `{name: DataFrame}`. Nothing is collected; a frame that several
parts use is written once. Arguments are rejected when they make no sense, never adjusted.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import axis, balances, capital, graph, messages, objects, orders, pricing, quality, ranking, registry, swaps
from ..session import settle

Report = dict[str, DataFrame]


def need(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def counted_top(frame: DataFrame, order: list[Column], k: int, total: str) -> DataFrame:
    """Top rows with the number of all rows beside them."""
    return ranking.with_totals(ranking.top_k(frame, order, k), frame.agg(F.count(F.lit(1)).alias(total)))


def swap_window(trades: DataFrame, days: int, top_accounts: int = 250, top_routes: int = 40) -> Report:
    """Trades of the last whole days: totals, venues, dense days, routes, accounts and concentration."""
    need(days >= 1, "days must be at least 1")
    window = settle(messages.whole_day_window(trades, "date", days), "swap-window")
    routes = swaps.volume(swaps.with_route(window), "route")
    accounts = swaps.account_rollup(window)
    venues = swaps.volume(window, "venue")
    daily = swaps.volume(window, "date", "venue")
    per_day = axis.dense(swaps.volume(window, "date"), "date", {"usd": 0, "count": 0})
    return {
        "window": window.select("window_from", "window_to", "clamped").limit(1),
        "totals": swaps.swap_summary(window),
        "venues": venues.orderBy(F.desc("usd"), F.asc("venue")),
        "days": axis.running(per_day, [F.asc("date")], "usd", "cumulative"),
        "days_by_venue": axis.dense(daily, "date", {"usd": 0, "count": 0}, venues.select("venue")),
        "routes": counted_top(routes, [F.desc("usd"), F.asc("route")], top_routes, "routes_total"),
        "accounts": counted_top(accounts, [F.desc("usd"), F.asc("account")], top_accounts, "accounts_total"),
        "concentration": swaps.concentration(swaps.volume(window, "account")),
    }


def swap_days(trades: DataFrame, legs: DataFrame | None = None, accounts: int = 50, routes: int = 40) -> Report:
    """One summary per day, with each day's largest accounts and routes, and the ratio to pool volume when legs are given."""
    trades = settle(trades, "swap-days")
    by = lambda frame, key, n: ranking.top_per_group(swaps.volume(frame, "date", key), ["date"], [F.desc("usd"), F.asc(key)], n)
    out = {
        "days": swaps.day_summary(trades),
        "assets": swaps.asset_sides(trades, "date"),
        "accounts": by(trades, "account", accounts),
        "routes": by(swaps.with_route(trades), "route", routes),
    }
    if legs is not None:
        both = trades.select("date", "usd", F.lit(True).alias("own")).unionByName(legs.select("date", "usd", F.lit(False).alias("own")))
        out["platform"] = swaps.platform_ratio(both, F.col("own"), ~F.col("own"))
    return out


def swap_history(stored: DataFrame, tail: DataFrame) -> Report:
    """Stored days and counted tail on one axis; the stored day wins. Frames carry day, trades, legs, usd."""
    days = settle(axis.dense(axis.prefer(stored, tail, ["day"], "stored"), "day", {}), "swap-history")
    return {"days": days, "months": axis.month_rollup(days, "day"), "missing": days.filter("trades IS NULL").select("day")}


def account_page(legs: DataFrame, trades: DataFrame, days: int) -> Report:
    """Flows, activity and latest trades of every account."""
    need(days >= 1, "days must be at least 1")
    return {
        "flows": pricing.net_flows(legs),
        "activity": swaps.activity(trades, days),
        "recent": ranking.top_per_group(trades, ["account"], [F.desc("date"), F.desc("id")], 25),
    }


def priced_trades(trades: DataFrame, legs: DataFrame, pegged: Iterable[str]) -> Report:
    """Rates stated by the legs, trades valued at them, and the symbols nothing prices."""
    rates = pricing.derive_rates(legs, pegged)
    valued = pricing.value_input(trades.drop("usd"), rates, "token_in", "amount_in")
    return {"rates": rates, "trades": valued, "unpriced": pricing.unknown_tokens(trades.filter("token_in IS NOT NULL"), rates.withColumnRenamed("symbol", "token_in"), "token_in")}


def capital_report(positions: DataFrame, issuance: DataFrame, pools: DataFrame, pool_legs: DataFrame, snapshot: str) -> Report:
    """Capital per venue and asset, pool self-checks and the supply check."""
    positions = settle(positions, "positions")
    assets = capital.capital_by_asset(positions, snapshot)
    held = assets.select(snapshot, "asset", "net_amount", "gross_amount")
    return {
        "venues": capital.capital_by_venue(positions, snapshot),
        "assets": assets,
        "pools": capital.pool_checks(pools, pool_legs),
        "supply": capital.supply_check(held, issuance, [snapshot, "asset"]),
    }


def market_report(reserves: DataFrame, read_rows: DataFrame, snapshot: str) -> Report:
    return {
        "totals": capital.market_totals(reserves, snapshot),
        "read_paths": capital.read_paths(read_rows, snapshot),
        "concentration": capital.half_of_total(reserves, snapshot, "asset", "supplied_usd"),
    }


def inventory_report(assets: DataFrame) -> Report:
    """Located assets sorted into bridged and sibling, the odd ones, and symbols carried twice."""
    classes = registry.bridged_classes(assets)
    return {
        "bridged": classes.filter("kind = 'bridged'"),
        "siblings": classes.filter("kind = 'sibling'"),
        "anomalies": classes.filter("anomaly IS NOT NULL"),
        "shared_symbols": registry.shared_symbols(assets),
    }


def holder_report(assets: DataFrame, holders: DataFrame, tokens: DataFrame) -> Report:
    rows = settle(balances.decompose_holders(assets, holders), "holders")
    return {"assets": rows, "chains": balances.holdings_per_chain(holders, tokens), "reconciliation": balances.reconciliation(rows)}


def netflow_series(frames: DataFrame, floor: object, cap: int = 40) -> Report:
    """Daily two-leg balances with dust, per-account series as intervals from close to close, and peaks of series that fall to 0.

    frames(day, account, leg, amount) with the legs relay and hub.
    """
    legs = settle(balances.two_legs(frames, ["day", "account"], "relay", "hub", "amount"), "netflows")
    closes = legs.select("account", "day", F.col("total").alias("balance"))
    return {
        "days": balances.day_with_dust(legs, "day", "account", ["relay", "hub"], floor, cap),
        "series": axis.carried(closes, ["account"], "day"),
        "peaks": axis.sparse_peaks(closes, legs.select("day").distinct(), "account", "day", "balance"),
        "missing": axis.missing_days(legs, "day"),
    }


def cohort_series(frames: DataFrame, cohort: DataFrame, event_day: str) -> Report:
    legs = settle(balances.two_legs(frames, ["day", "account"], "relay", "hub", "amount"), "cohort")
    days = balances.cohort_days(legs, cohort, "day", "account", ["relay", "hub"])
    return {
        "days": days,
        "largest_before": balances.largest_before(legs.groupBy("day").agg(F.max("hub").alias("hub")), "day", "hub", event_day),
    }


def object_report(stored: DataFrame, links: DataFrame) -> Report:
    """Rollups, duplication, sizes and uploads of stored objects, from links first and by adjacency for the rest."""
    shaped = settle(objects.with_shape(stored), "objects")
    groups = objects.manifest_groups(shaped, links)
    claimed = objects.claimed_pieces(groups.select("root"), links, shaped)
    marked = shaped.join(claimed.withColumn("claimed", F.lit(True)), "hash", "left").fillna({"claimed": False})
    return {
        "rollups": objects.rollups(shaped, ["shape", "codec", "hashing"]),
        "duplication": objects.duplication(shaped),
        "sizes": objects.size_histogram(shaped),
        "groups": groups,
        "runs": objects.adjacent_runs(marked),
    }


def message_report(rows: DataFrame, ceiling: float, excluded: int = 40) -> Report:
    """Messages with outliers taken out of the dollars but not out of the counts.

    rows(id, date, origin, dest, origin_para, kind, outcome, match_status, symbol, digits, decimals, usd).
    """
    rows = settle(rows, "messages")
    flagged = settle(quality.flag_outliers(rows.filter("usd IS NOT NULL"), ceiling), "flagged")
    clean = rows.join(flagged.filter("reason IS NOT NULL").select("id", "reason"), "id", "left")
    clean = clean.withColumn("usd", F.when(F.col("reason").isNull(), F.col("usd")))
    pairs = settle(graph.corridors(clean), "corridors")
    daily = swaps.volume(clean, "date")
    return {
        "days": axis.dense(daily, "date", {"usd": 0, "count": 0}),
        "days_by_asset": swaps.volume(clean.filter("usd IS NOT NULL"), "date", "symbol"),
        "corridors": pairs,
        "chains": graph.corridor_nodes(pairs).join(graph.best_supported_id(rows, "origin", "origin_para").withColumnRenamed("origin", "chain"), "chain", "left"),
        "matrix": graph.corridor_matrix(pairs),
        "facets": orders.facets(rows, ["kind", "outcome", "match_status"]),
        "excluded": ranking.top_k(flagged.filter("reason IS NOT NULL"), [F.desc("usd"), F.asc("id")], excluded),
        "excluded_by_reason": flagged.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("rows"), F.sum("usd").alias("usd")),
    }


def grid_report(rows: DataFrame, day: str, chain: str, value: str, cap: int, requested_to: str | None) -> Report:
    grid = settle(quality.daily_grid(rows, day, chain, value), "grid")
    return {"grid": grid, "coverage": quality.truncation(grid, day, cap, requested_to), "partial_tail": quality.partial_tail(grid, day, "chains")}


def order_report(placed: DataFrame, fills: DataFrame, trades: DataFrame, **filters: str | None) -> Report:
    """Orders matching the filters with their first fill, and the rate board over all trades."""
    unknown = set(filters) - {"address", "source", "status", "day"}
    need(not unknown, f"unknown filters: {sorted(unknown)}")
    chosen = orders.drill_down(placed, fills, **filters)
    return {"rows": orders.drill_rows(chosen, fills), "facets": orders.facets(placed, ["source", "status"]), "rates": swaps.rate_board(trades)}


def bridged_prices(assets: DataFrame, quotes: DataFrame, known: DataFrame) -> Report:
    valued = settle(registry.price_by_location(assets, quotes, known), "bridged-prices")
    brief = valued.select("id", "symbol", "usd")
    return {
        "assets": valued.orderBy(F.desc_nulls_last("usd"), F.asc("symbol"), F.asc("id")),
        "totals": registry.valued_totals(valued),
        "namesakes": registry.namesakes(brief, brief),
    }


def oracle_report(pools: DataFrame, at: str) -> Report:
    spots = settle(registry.hub_prices(pools, at), "spots")
    gap = registry.price_gap(spots)
    return {"quotes": registry.prefer_oracle(spots), "cross_check": gap, "worst": registry.worst_gaps(gap.withColumn("gap", F.abs("difference_pct")), "gap", [at, "asset"], 5)}


def transfer_report(edges: DataFrame, decimals: DataFrame, days: int, parties: int = 400, recent: int = 250) -> Report:
    """Counterparties, asset sums, denomination and latest transfers of every account over a window of days."""
    need(days >= 1, "days must be at least 1")
    cut = edges.agg(F.date_sub(F.max("day"), days).alias("cut"))
    window = settle(ranking.with_totals(edges, cut).filter("day >= cut").drop("cut"), "edges")
    bags = settle(graph.asset_bags(window), "bags")
    both = graph.both_ends(window).filter(~F.col("self"))
    return {
        "events": graph.event_counts(edges, days),
        "parties": ranking.top_per_group(graph.counterparties(window), ["account"], [F.desc("transfers"), F.asc("other")], parties),
        "assets": bags,
        "denomination": graph.denomination(bags, decimals),
        "recent": ranking.top_per_group(both, ["account"], [F.desc("block"), F.desc("edge_key")], recent),
    }


def archive_report(obs: DataFrame, labels: DataFrame, threshold: object) -> Report:
    """Addresses worth keeping, their labels, dense closes and clipped peaks."""
    kept = settle(balances.archive_addresses(obs, threshold), "archive")
    rows = obs.join(kept.select("address"), "address", "left_semi")
    closes = balances.day_closes(rows)
    series = axis.fill_forward(axis.dense(closes, "day", {}, closes.select("address").distinct()), ["address"], "day", "balance")
    named = labels.groupBy("address").agg(F.min("name").alias("name"))
    return {"addresses": kept.join(named, "address", "left"), "series": series, "clipped": balances.clipped_peaks(rows)}


def lease_report(stored: DataFrame, clock: DataFrame, retention: int) -> Report:
    need(retention > 0, "retention must be positive")
    rows = objects.project_expiry(stored, clock, retention)
    return {"objects": rows, "days": rows.groupBy(S.day_of_millis(F.floor("expires_ms").cast("bigint")).alias("day")).agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))}


def sovereign_report(sources: dict[str, DataFrame], registered: DataFrame, legs: DataFrame, issuance: DataFrame, snapshot: str) -> Report:
    """Accounts that any source names, those that the register lacks, and what the named ones hold on both legs; the rest is shown apart.

    sources: frames with `account`; registered(account); legs(snapshot, account, relay, hub, total); issuance(snapshot, issuance).
    """
    need(len(sources) > 0, "at least one source must name accounts")
    ids = settle(registry.enumerate_sources(sources, "account"), "sovereigns")
    other = legs.join(ids, "account", "left_anti").groupBy(snapshot)
    return {
        "accounts": ids,
        "missing": ids.join(registered.select("account").distinct(), "account", "left_anti"),
        "totals": balances.sovereign_totals(legs.join(ids, "account", "left_semi"), snapshot, ["relay", "hub"], issuance),
        "unnamed": other.agg(F.count(F.lit(1)).alias("accounts"), F.sum("total").alias("total")),
    }


def peg_report(pools: DataFrame, pegs: DataFrame, rates: DataFrame, open_orders: DataFrame) -> Report:
    """Peg state of every pool asset, one line a pool (its widest gap either way, the age of its pegs), and the order book beside it.

    A pool whose peg list does not fit its assets has no pegs; it says aligned = false and has no gap.
    """
    assets = settle(capital.peg_states(pools, pegs, rates), "pegs")
    book = settle(capital.order_book(open_orders), "order-book")
    lines = assets.groupBy("pool").agg(
        F.count(F.lit(1)).alias("assets"),
        F.max(F.abs("gap_bps")).alias("widest_bps"),
        F.max("peg_age").alias("peg_age"),
        F.bool_or("ramping").alias("ramping"),
        F.bool_and("aligned").alias("aligned"),
    )
    return {"assets": assets, "pools": lines, "book": book, "book_counts": capital.order_book_counts(book)}


def wrap_map(reserves: DataFrame, wraps: DataFrame, listed: DataFrame) -> Report:
    """Every wrap with what its underlying says about it and its reserve's settings, the ones not confirmed, and the risk categories.

    reserves(wrap, supplied and the columns of `scalars.reserve_configuration`); a wrap without a reserve keeps NULLs. A cap of 0 is no
    cap: it has no use. Category 0 is no category.
    """
    use = F.try_divide(F.col("supplied").cast("double"), F.col("supply_cap").cast("double")) * 100
    rows = settle(registry.confirm_wraps(wraps, listed).join(reserves, "wrap", "left").withColumn("cap_use", use), "wrap-map")
    ltv = F.col("ltv_bps") / 10000
    return {
        "reserves": rows,
        "unconfirmed": rows.filter("NOT confirmed"),
        "categories": capital.risk_categories(rows.filter("category > 0"), "category", "wrap", ltv),
    }


def staking_ratio(pools: DataFrame, snapshot: str, low: float, high: float) -> Report:
    """Staked units behind one issued unit, and whether that is plausible; the newest plausible one is the figure to quote.

    pools(snapshot, staked, issued). Nothing issued: the ratio is unknown, which is not plausible.
    """
    need(0 < low <= high, "the band must be positive and in order")
    ratio = F.try_divide(F.col("staked").cast("double"), F.col("issued").cast("double"))
    inside = F.col("ratio").between(low, high)
    rows = pools.withColumn("ratio", ratio).withColumn("plausible", F.coalesce(inside, F.lit(False)))
    return {
        "ratios": rows,
        "checks": quality.violations(rows, {"ratio_known": F.col("ratio").isNotNull(), "ratio_in_band": inside}),
        "latest": ranking.top_k(rows.filter("plausible"), [F.desc(snapshot)], 1),
    }


def message_window(window: DataFrame, routes: int = 20) -> Report:
    """Messages of a window (`messages.known_window`): its summary, every day, every day and route, and the busiest routes, all and matched."""
    need(routes >= 1, "routes must be at least 1")
    window = settle(window, "message-window")
    return {
        "summary": messages.window_summary(window),
        "days": messages.daily_stats(window),
        "days_by_route": messages.daily_stats(window, "origin", "dest"),
        "routes": messages.busiest_routes(window, routes),
        "matched_routes": messages.busiest_routes(window, routes, matched_only=True),
    }

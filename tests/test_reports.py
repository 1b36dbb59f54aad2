import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.plans import capitals, graphs, pricing, registry_joins, reports, series, stored
from ledgerloom.sources import tables as T


def rows(frames):
    return {name: frame.collect() for name, frame in frames.items()}


def test_swap_window(spark, small):
    out = rows(reports.swap_window(T.trades(spark, small), 400))
    total = out["totals"][0]
    assert abs(total.usd - float(sum(r.usd for r in out["days"]))) < 1e-6
    assert total.trades == sum(r["count"] for r in out["days"]) == sum(r["count"] for r in out["venues"])
    assert out["accounts"][0].accounts_total == total.accounts
    assert len(out["days"]) == (out["window"][0].window_to - out["window"][0].window_from).days + 1 or out["days"][0]["count"] > 0
    with pytest.raises(ValueError):
        reports.swap_window(T.trades(spark, small), 0)


def test_swap_days_and_history(spark, small):
    legs = T.legs(spark, small)
    out = rows(reports.swap_days(T.trades(spark, small), legs))
    assert sum(r.trades for r in out["days"]) == sum(r.trades_in for r in out["assets"]) == T.table(spark, small, "lineitem").count()
    days = series.history(spark, small)
    stored_, tail = (days.filter(F.col("origin") == o).drop("origin") for o in ("stored", "tail"))
    hist = rows(reports.swap_history(stored_, tail))
    assert sum(r.days for r in hist["months"]) == len(hist["days"])
    assert len(hist["missing"]) == sum(r.days - r.present for r in hist["months"])


def test_prices_accounts_and_orders(spark, small):
    legs = pricing.pricing_legs(spark, small)
    priced = rows(reports.priced_trades(T.trades(spark, small), legs, pricing.PEGGED))
    known = {r.symbol for r in priced["rates"]}
    assert all((r.usd is None) == (r.token_in not in known) for r in priced["trades"])
    page = rows(reports.account_page(T.legs(spark, small), T.trades(spark, small), 30))
    assert sum(r.legs_in + r.legs_out for r in page["flows"]) == sum(r.trades for r in page["activity"])
    placed, fills = pricing.order_frames(spark, small)
    book = rows(reports.order_report(placed, fills, T.trades(spark, small), status="F"))
    assert {r.status for r in book["rows"]} == {"F"}
    with pytest.raises(ValueError):
        reports.order_report(placed, fills, T.trades(spark, small), colour="red")


def test_messages_graphs_and_grids(spark, small):
    base = T.messages(spark, small).withColumn("digits", S.digit_count(F.col("raw_amount")))
    out = rows(reports.message_report(base, 95_000.0))
    n = T.table(spark, small, "lineitem").count()
    assert sum(r["count"] for r in out["days"]) == sum(r.messages for r in out["corridors"]) == n
    assert sum(r.rows for r in out["excluded_by_reason"]) > 0
    assert all(r.conflicting == 0 for r in out["chains"])
    grid = rows(reports.grid_report(graphs.grid_rows(spark, small), "day", "chain", "v", 10, None))
    assert grid["coverage"][0].truncated is False
    decimals = spark.createDataFrame([("ECONOMY", 2)], "asset string, decimals int")
    graph = rows(reports.transfer_report(T.transfer_edges(spark, small), decimals, 30))
    assert sum(r.transfers for r in graph["parties"]) == sum(r.transfers for r in graph["assets"])


def test_balances_capital_objects_and_prices(spark, small):
    frames = series.leg_frames(spark, small).filter("leg IS NOT NULL")
    flows = rows(reports.netflow_series(frames, 2000))
    assert sum(int(r.relay or 0) + int(r.hub or 0) for r in flows["days"]) == int(frames.agg(F.sum("amount")).collect()[0][0])
    cohort = frames.select("account").distinct()
    assert len(rows(reports.cohort_series(frames, cohort, "2024-01-20"))["days"]) > 0
    archive = rows(reports.archive_report(series.observations(spark, small), spark.createDataFrame([("x", "1")], "name string, address string"), 100))
    assert {r.address for r in archive["series"]} == {r.address for r in archive["addresses"]}
    reserve_rows = capitals.positions(spark, small).groupBy("snapshot", "path", "asset").agg(F.sum("usd").alias("tvl"))
    market = rows(reports.market_report(capitals.reserves(spark, small), reserve_rows, "snapshot"))
    assert len(market["totals"]) >= len(market["concentration"]) > 0
    assets, holders = series.holder_frames(spark, small)
    tokens = T.table(spark, small, "part").select(F.col("p_partkey").alias("asset"), F.col("p_name").alias("symbol"), F.col("p_size").alias("decimals"))
    held = rows(reports.holder_report(assets, holders, tokens))
    assert held["reconciliation"][0].assets == len(held["assets"])
    prices = rows(reports.bridged_prices(*registry_joins.located_assets(spark, small)))
    assert prices["totals"][0].assets == len(prices["assets"])
    oracle = rows(reports.oracle_report(registry_joins.hub_pools(spark, small), "snapshot"))
    assert len(oracle["worst"]) == 5 and len(oracle["quotes"]) >= len(oracle["cross_check"])
    things = stored.chain_objects(spark, small)
    links = things.filter(F.col("codec") == 0x70).select(F.col("hash").alias("parent"), F.sha2(F.col("hash"), 256).alias("child"))
    out = rows(reports.object_report(things, links))
    assert [r.objects for r in out["rollups"] if r.facet == "all"] == [things.count()]
    assert out["groups"] == []
    issuance = capitals.positions(spark, small).groupBy("snapshot", "asset").agg(F.sum("amount").alias("issued"))
    legs = T.legs(spark, small).select(F.col("order_id").alias("pool"), F.col("leg_key").alias("leg"), "amount", "usd")
    pools = T.table(spark, small, "orders").select(F.col("o_orderkey").alias("pool"), S.money(F.col("o_totalprice")).alias("via_shares"))
    money = rows(reports.capital_report(capitals.positions(spark, small), issuance, pools, legs, "snapshot"))
    assert sum(r.positions for r in money["venues"] if r.is_total) == T.table(spark, small, "lineitem").count()
    clock = spark.createDataFrame([(100, 86_400_000, 6000.0)], "head_block long, head_ms long, block_ms double")
    leases = rows(reports.lease_report(things.select("block", "size"), clock, 10))
    assert sum(r.objects for r in leases["days"]) == things.count()
    located = T.table(spark, small, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("symbol"), F.lit("020901").alias("location"))
    kinds = rows(reports.inventory_report(located))
    assert len(kinds["bridged"]) == located.count()


def test_sovereign_accounts_named_missing_and_unnamed(spark):
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "account string")
    legs = spark.createDataFrame([("d1", "a", 1, None, 1), ("d1", "b", 2, 5, 7), ("d1", "z", None, 4, 4), ("d2", "z", 9, None, 9)], "day string, account string, relay long, hub long, total long")
    issuance = spark.createDataFrame([("d1", 16), ("d2", 0)], "day string, issuance long")
    out = rows(reports.sovereign_report({"chain": ids("a", "b", "a"), "list": ids("b", "c")}, ids("a", "q"), legs, issuance, "day"))
    assert {(r.account, r.sources) for r in out["accounts"]} == {("a", "chain"), ("b", "chain,list"), ("c", "list")}
    assert {r.account for r in out["missing"]} == {"b", "c"}
    assert [(r.day, r.relay, r.hub, r.total, r.accounts, r.share) for r in out["totals"]] == [("d1", 3, 5, 8, 2, 50.0)]
    assert {(r.day, r.accounts, r.total) for r in out["unnamed"]} == {("d1", 1, 4), ("d2", 1, 9)}
    with pytest.raises(ValueError):
        reports.sovereign_report({}, ids("a"), legs, issuance, "day")


def test_pegs_by_pool_and_the_book(spark):
    pools = spark.createDataFrame([(1, ["x", "y"], 5, 5, 90, 100), (2, ["x", "y"], 5, 9, 900, 100), (3, ["x"], 5, 5, 90, 100)], "pool long, assets array<string>, initial_amp int, final_amp int, final_block long, head long")
    pegs = spark.createDataFrame([(1, [1.0, 1.5], 40), (2, [1.0], 90)], "pool long, ratios array<double>, recorded_block long")
    rates = spark.createDataFrame([("x", 1.25), ("y", 1.5)], "asset string, rate double")
    orders = spark.createDataFrame([(1, 2.0, 3.0, True, False), (2, None, 3.0, False, True)], "id long, amount_in double, amount_out double, is_pallet boolean, partially_fillable boolean")
    out = rows(reports.peg_report(pools, pegs, rates, orders))
    assert {r.pool: (r.assets, r.widest_bps, r.peg_age, r.ramping, r.aligned) for r in out["pools"]} == {1: (2, 2000.0, 60, False, True), 2: (2, None, 10, True, False), 3: (1, None, None, False, None)}
    assert (out["book_counts"][0].orders, out["book_counts"][0].unpriced) == (2, 1)


def test_wraps_with_their_reserves(spark):
    wraps = spark.createDataFrame([("w", "u", 6), ("v", "u", 7), ("lone", "gone", 6)], "wrap string, underlying string, decimals int")
    listed = spark.createDataFrame([("u", "w", 6)], "underlying string, wrap string, decimals int")
    reserves = spark.createDataFrame([("w", 50, 200, 9000, 1), ("v", 5, 0, 5000, 0)], "wrap string, supplied long, supply_cap long, ltv_bps long, category long")
    out = rows(reports.wrap_map(reserves, wraps, listed))
    assert {r.wrap: (r.confirmed, r.decimals_agree, r.cap_use) for r in out["reserves"]} == {"w": (True, True, 25.0), "v": (False, False, None), "lone": (False, None, None)}
    assert {r.wrap for r in out["unconfirmed"]} == {"v", "lone"}
    assert [(r.category, r.members, round(r.max_leverage, 6)) for r in out["categories"]] == [(1, 1, 10.0)]


def test_staking_ratio_quotes_the_newest_plausible_one(spark):
    pools = spark.createDataFrame([("m1", 105.0, 100.0), ("m2", 110.0, 100.0), ("m3", 300.0, 100.0), ("m4", 1.0, 0.0)], "snapshot string, staked double, issued double")
    out = rows(reports.staking_ratio(pools, "snapshot", 1.0, 1.2))
    assert [r.snapshot for r in out["latest"]] == ["m2"]
    assert {r.check: r.broken for r in out["checks"]} == {"ratio_known": 1, "ratio_in_band": 2}
    with pytest.raises(ValueError):
        reports.staking_ratio(pools, "snapshot", 1.2, 1.0)

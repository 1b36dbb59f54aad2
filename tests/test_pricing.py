from pyspark.sql import functions as F

from ledgerloom.operators import pricing as P
from ledgerloom.operators import registry as R

LEGS = "in_symbol string, in_amount double, out_symbol string, out_amount double"


def rates(spark, legs):
    out = P.derive_rates(spark.createDataFrame(legs, LEGS), ["USDC"]).collect()
    return {r.symbol: (r.rate, r.observations, r["pass"]) for r in out}


def test_prices_reach_one_hop_per_pass(spark):
    got = rates(spark, [("USDC", 10.0, "A", 5.0), ("A", 1.0, "B", 4.0), ("C", 1.0, "B", 8.0)])
    assert got == {"USDC": (1.0, None, 0), "A": (2.0, 1, 1), "B": (0.5, 1, 2), "C": (4.0, 1, 3)}


def test_even_observations_take_the_upper_middle(spark):
    legs = [("USDC", float(p), "A", 1.0) for p in (1, 2, 3, 9)]
    assert rates(spark, legs)["A"] == (3.0, 4, 1)


def test_a_priced_symbol_is_not_revised_and_unlinked_ones_stay_unknown(spark):
    got = rates(spark, [("USDC", 10.0, "A", 5.0), ("USDC", 3.0, "B", 1.0), ("B", 1.0, "A", 9.0), ("X", 1.0, "Y", 1.0), ("USDC", 0.0, "Z", 1.0)])
    assert got["A"] == (2.0, 1, 1) and set(got) == {"USDC", "A", "B"}


def test_passes_go_on_until_nothing_new_is_reached(spark):
    chain = [("USDC", 1.0, "s1", 1.0)] + [(f"s{i}", 1.0, f"s{i + 1}", 1.0) for i in range(1, 8)] + [("s8", 1.0, "USDC", 1.0)]
    assert {s: p for s, (_, _, p) in rates(spark, chain).items()} == {"USDC": 0, "s1": 1, "s8": 1, "s2": 2, "s7": 2, "s3": 3, "s6": 3, "s4": 4, "s5": 4}
    line = [("USDC", 1.0, "s1", 1.0)] + [(f"s{i}", 1.0, f"s{i + 1}", 1.0) for i in range(1, 8)]
    assert rates(spark, line)["s8"][2] == 8


LEG = "order_id int, account int, operation string, side string, leg int, leg_key string, asset_id int, amount double, usd decimal(18,4)"


def legs(spark, rows):
    return spark.createDataFrame(rows, LEG)


def test_two_valuation_rules(spark):
    from decimal import Decimal as D

    rows = [
        (1, 1, "Router", "in", 1, "a", 7, 1.0, D(10)),
        (1, 1, "Router", "in", 2, "b", 8, 1.0, None),
        (1, 1, "Router", "out", 3, "c", 9, 2.0, D(9)),
        (2, 1, "Router", "in", 1, "d", 7, 1.0, D(4)),
    ]
    routed = {r.order_id: r.usd for r in P.value_routed(legs(spark, rows)).collect()}
    assert routed == {1: None, 2: D("4.0000")}
    orders = P.normalise_orders(legs(spark, rows).withColumn("status", F.lit("REFUNDED")).withColumn("partner_hex", F.lit("0x")))
    got = {r.order_id: (r.usd, r.failed, r.partner) for r in orders.collect()}
    assert got == {1: (D("10.0000"), True, None), 2: (D("4.0000"), True, None)}
    whole = P.with_both_sides(P.normalise_routed(legs(spark, rows))).collect()
    assert [(r.order_id, r.asset_in, r.asset_out, r.hops) for r in whole] == [(1, 7, 9, 3)]
    quality = P.routed_quality(P.normalise_routed(legs(spark, rows))).collect()[0]
    assert (quality.read, quality.kept, quality.without_balances, quality.many_inputs) == (2, 1, 1, 1)


def test_flows_of_unknown_price_have_no_dollars(spark):
    rows = [(1, 1, "", "in", 1, "a", 7, 2.0, None), (2, 1, "", "out", 1, "b", 7, 5.0, None), (3, 1, "", "out", 1, "c", 7, None, None)]
    row = P.net_flows(legs(spark, rows)).collect()[0]
    assert (row.sent, row.received, row.net, row.net_usd, row.unstated, row.legs_in) == (2.0, 5.0, 3.0, None, 1, 2)


def test_registry_before_indexer_and_shared_symbols(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    indexer = spark.createDataFrame([(1, 11, "AAA", 10), (2, 12, "USDT", 6), (3, None, "USDT", 6)], "id int, registry_id int, symbol string, decimals int")
    registry = spark.createDataFrame([(11, "AAA", 12)], "registry_id int, symbol string, decimals int")
    out = {r.id: r for r in R.label_symbols(R.resolve_meaning(ids, indexer, registry)).collect()}
    assert (out[1].decimals, out[1].disagree, out[1].borrowed) == (12, True, False)
    assert (out[2].label, out[3].label, out[2].borrowed) == ("USDT·12", "USDT·3", True)
    assert (out[4].symbol, out[4].label, out[4].mapped) == (None, None, False)


def test_audit_blocks_clashing_decimals(spark):
    schema = "chain string, key string, symbol string, decimals int"
    ours = spark.createDataFrame([("1", "a", "A", 6), ("1", "b", "B", 6), ("1", "c", "C", 6)], schema)
    theirs = spark.createDataFrame([("1", "a", "A", 6), ("1", "a", "A", 6), ("1", "b", "B", 18), ("1", "d", "D", 8)], schema)
    audited = R.audit(ours, theirs, ["chain", "key"])
    assert {r.key: r.verdict for r in audited.collect()} == {"a": "agree", "b": "decimals-clash", "c": "only-ours", "d": "adopted"}
    legs_ = spark.createDataFrame([("1", k) for k in "abcde"], "chain string, key string")
    got = {r.key: (r.symbol, r.blocked) for r in R.describe_legs(legs_, audited, ["chain", "key"]).collect()}
    assert got == {"a": ("A", False), "b": (None, True), "c": ("C", False), "d": ("D", False), "e": (None, False)}


def test_namesakes_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "A", "b", "c", None]), rng.choice([None, float(rng.randint(1, 4))])) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, symbol string, usd double")
    same = lambda r: [o for o in rows if r[1] and o[1] and o[1].upper() == r[1].upper() and o[0] != r[0]]
    for got in R.namesakes(df, df).collect():
        others = same(rows[got.id])
        priced = sorted((o for o in others if o[2] is not None), key=lambda o: (-o[2], o[0]))
        if rows[got.id][1] is not None:
            assert (got.namesakes, got.priced_namesakes) == (len(others), len(priced))
        assert (got.dearest_id, got.dearest_usd) == ((priced[0][0], priced[0][2]) if priced else (None, None))


def test_hub_price_is_the_mean_of_the_middles(spark):
    pools = spark.createDataFrame([("s", "a", 2.0, 1.0, 1.0), ("s", "b", 4.0, 1.0, 1.0), ("s", "c", 8.0, 1.0, None)], "at string, asset string, reserve double, hub_reserve double, oracle double")
    out = {r.asset: r for r in R.prefer_oracle(R.hub_prices(pools, "at")).collect()}
    assert (out["a"].hub_usd, out["c"].spot, out["c"].source, out["a"].source) == (3.0, 3.0 / 8, "spot", "oracle")

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph as G
from ledgerloom.operators import quality as Q

BLOCK = "number long, timestamp long, events array<struct<name:string,args:string>>"
NAMES = ["Balances.Transfer", "Assets.Transferred", "PoolAssets.Transferred", "ForeignAssets.Transferred"]
A, B = "aa" * 32, "bb" * 32


def blocks(spark, *events):
    return spark.createDataFrame([(1, 86_400_000, [(n, json.dumps(a)) for n, a in events])], BLOCK)


def test_named_arguments_decode_exactly(spark):
    args = {"from": "0x" + A.upper(), "to": B, "amount": "340282366920938463463374607431768211455"}
    row = G.decode_transfers(blocks(spark, ("Balances.Transfer", {**args, "amount": "6886503"}), ("Balances.Transfer", args)), NAMES).orderBy("amount_text").collect()
    assert row[1].amount == Decimal(6886503) and row[1].sender == A and row[1].asset == "native"
    # 39 digits do not fit: the number is unknown, the text stays.
    assert row[0].amount is None and row[0].amount_text == args["amount"]


def test_positional_arguments_are_an_error(spark):
    with pytest.raises(Exception, match="positional"):
        G.decode_transfers(blocks(spark, ("Balances.Transfer", ["x", "y", "1"])), NAMES).collect()


def test_short_accounts_are_no_transfer_and_keys_stay_apart(spark):
    base = {"from": A, "to": B, "amount": "1"}
    rows = G.decode_transfers(
        blocks(
            spark,
            ("Balances.Transfer", {**base, "from": "0xdeadbeef"}),
            ("Assets.Transferred", {**base, "assetId": 1984}),
            ("PoolAssets.Transferred", {**base, "assetId": 1984}),
            ("ForeignAssets.Transferred", {**base, "assetId": {"parents": 1}}),
            ("System.Remarked", base),
        ),
        NAMES,
    ).collect()
    assert sorted(r.asset for r in rows) == ["assets:1984", 'foreign:{"parents":1}', "pool:1984"]


EDGE = "sender string, receiver string, amount decimal(38,0), asset string, chain string, event string, day date"


def edges(spark, rows):
    return spark.createDataFrame([(s, r, Decimal(a), k, c, "e", d) for s, r, a, k, c, d in rows], EDGE)


D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 9)


def test_self_transfers_count_once_and_are_not_netted(spark):
    frame = edges(spark, [("x", "x", 5, "n", "relay", D1), ("x", "y", 7, "n", "hub", D1), ("y", "x", 2, "n", "hub", D2)])
    assert {(r.account, r.other, r.direction, r.transfers, r.chains) for r in G.counterparties(frame).collect()} == {
        ("x", "y", "both", 2, "hub"),
        ("y", "x", "both", 2, "hub"),
    }
    bags = {(r.account, r.chain): (r.transfers, r.self_transfers, int(r.sent_raw), int(r.received_raw)) for r in G.asset_bags(frame).collect()}
    assert bags[("x", "relay")] == (1, 1, 0, 0) and bags[("x", "hub")] == (2, 0, 7, 2)


def test_events_before_the_cut_still_count(spark):
    frame = edges(spark, [("x", "y", 1, "n", "hub", D1), ("x", "y", 1, "n", "hub", D2)])
    row = G.event_counts(frame, 3).collect()[0]
    assert (row.events, row.in_window) == (2, 1)


def test_denomination_needs_known_decimals(spark):
    frame = edges(spark, [("x", "y", 100, "odd", "hub", D1)] * 3 + [("x", "y", 50, "n", "hub", D1)])
    decimals = spark.createDataFrame([("n", 1)], "asset string, decimals int")
    row = G.denomination(G.asset_bags(frame), decimals).filter("account = 'x'").collect()[0]
    assert (row.denomination, row.transfers, row.all_transfers, row.sent) == ("hub/n", 1, 4, 5.0)


@pytest.mark.parametrize(
    "digits,cut",
    [
        ({13: 5, 15: 5, 16: 5, 17: 5, 21: 1}, 21),
        ({11: 3, 14: 3, 15: 2, 16: 2, 20: 1, 21: 1}, 20),
        ({7: 1, 12: 8, 13: 8, 14: 8}, None),
        ({5: 4, 6: 4, 7: 4, 8: 1}, None),
        ({10: 3, 20: 1}, None),
        ({1: 1, 6: 30, 12: 1}, 12),
    ],
)
def test_outlier_cut(spark, digits, cut):
    frame = spark.createDataFrame([("s", d, n) for d, n in digits.items()], "symbol string, digits int, n long")
    assert Q.outlier_cuts(frame, "symbol", "digits", "n").collect()[0].cut == cut


def test_first_reason_wins_and_rows_stay(spark):
    rows = [("s", 10, 6, 1.0)] * 9 + [("s", 20, 18, 9e9), ("s", 20, 6, 9e9), ("t", 5, 6, 9e9)]
    frame = spark.createDataFrame(rows, "symbol string, digits int, decimals int, usd double")
    reasons = sorted(str(r.reason) for r in Q.flag_outliers(frame, 25e6).collect())
    assert reasons == ["None"] * 9 + ["decimals-disagree", "magnitude-outlier", "over-ceiling"]


def test_freshness_states(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = spark.createDataFrame([("a", at(23)), ("b", at(12)), ("c", at(-9)), ("d", at(25)), ("e", at(23))], "s string, at timestamp")
    expected = spark.createDataFrame([(s,) for s in "abcdef"], "s string")
    out = Q.freshness(rows, expected, "s", "at", F.lit(at(24)), 7_200_000, 86_400_000, F.col("s") == "e")
    got = {r.s: (r.state, r.clock_skew) for r in out.collect()}
    assert got == {"a": ("live", False), "b": ("stale", False), "c": ("frozen", False), "d": ("live", True), "e": ("unreachable", False), "f": ("unknown", False)}
    worst = max(Q.worst_state(out, "s").collect(), key=lambda r: r.severity)
    assert worst.state == "frozen"


@pytest.mark.parametrize("cap,to,expected", [(3, "2024-02-01", True), (3, "2024-01-02", False), (9, None, False), (3, None, None)])
def test_truncation_is_three_valued(spark, cap, to, expected):
    grid = spark.createDataFrame([(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 2)], "day date, rows long")
    assert Q.truncation(grid, "day", cap, to).collect()[0].truncated is expected


def test_durability_without_a_floor_is_unknown(spark):
    facts = spark.createDataFrame([("2024-01-01", True), ("2024-01-02", False)], "segment string, full boolean")
    floor = lambda v: spark.createDataFrame([(v,)], "f string")
    state = lambda v: Q.durability(facts, floor(v), "segment", F.col("full")).collect()[0].state
    assert (state("2024-01-01"), state("2024-01-02"), state(None)) == ("ok", "at-risk", "unknown")


def test_require_stops_on_the_first_broken_row(spark):
    frame = spark.range(5)
    assert Q.require(frame, {"small": F.col("id") < 5}).count() == 5
    with pytest.raises(Exception, match="expectation broken: small"):
        Q.require(frame, {"small": F.col("id") < 4}).collect()

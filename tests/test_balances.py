import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import axis, capital
from ledgerloom.operators import balances as B
from ledgerloom.sources import landing

DAY = dt.date(2026, 7, 1)


def test_cohort_day_is_exact(spark):
    rows = [(DAY, f"a{i:02d}", "hub", Decimal(10**18 + i * 10**12)) for i in range(12)] + [(DAY, "a00", "relay", Decimal(500 * 10**10)), (DAY, "zero", "hub", Decimal(0))]
    frames = spark.createDataFrame(rows, "day date, account string, leg string, amount decimal(38,0)")
    legs = B.two_legs(frames, ["day", "account"], "relay", "hub", "amount")
    cohort = frames.select("account").distinct()
    row = B.cohort_days(legs, cohort, "day", "account", ["relay", "hub"]).collect()[0]
    totals = sorted([10**18 + i * 10**12 for i in range(1, 12)] + [10**18 + 500 * 10**10], reverse=True)
    assert (row.nonzero, int(row.hub), int(row.relay), int(row.top_ten)) == (12, 12 * 10**18 + 66 * 10**12, 500 * 10**10, sum(totals[:10]))


def test_a_leg_nobody_read_stays_unknown(spark):
    frames = spark.createDataFrame([(DAY, "a", "relay", Decimal(3)), (DAY, "b", "other", Decimal(1))], "day date, account string, leg string, amount decimal(38,0)")
    out = B.two_legs(frames, ["day", "account"], "relay", "hub", "amount").collect()
    assert [(r.account, int(r.relay), r.hub, int(r.total)) for r in out] == [("a", 3, None, 3)]


def test_dust_keeps_the_day_whole(spark):
    rows = [(DAY, i, Decimal(i), None, Decimal(i)) for i in range(1, 101)]
    legs = spark.createDataFrame(rows, "day date, account int, relay decimal(38,0), hub decimal(38,0), total decimal(38,0)")
    out = B.day_with_dust(legs, "day", "account", ["relay", "hub"], 50, cap=10).collect()
    assert len(out) == 11 and sum(int(r.relay) for r in out) == 5050
    dust = [r for r in out if r.bucket == "dust"][0]
    assert (dust.members, dust.account) == (90, None)


def test_archive_addresses_and_clipping(spark):
    obs = spark.createDataFrame([("a", 1, Decimal(5), DAY), ("a", 2, Decimal(90), DAY), ("a", 3, Decimal(40), DAY), ("b", 1, Decimal(1), DAY)], "address string, block long, balance decimal(38,0), day date")
    row = B.archive_addresses(obs, 1).collect()
    assert [(r.address, int(r.last), int(r.peak), r.observations) for r in row] == [("a", 40, 90, 3)]
    clipped = {r.address: r.clipped for r in B.clipped_peaks(obs).collect()}
    assert clipped["a"] == pytest.approx(50 / 90) and clipped["b"] == 0.0


def test_unknown_before_first_zero_after(spark):
    days = [DAY + dt.timedelta(days=i) for i in range(5)]
    rows = [("k", days[0], None, True), ("k", days[1], 7, True), ("k", days[2], None, True), ("k", days[3], None, False), ("k", days[4], 9, True), ("never", days[0], None, True)]
    frame = spark.createDataFrame(rows, "k string, day date, v int, present boolean")
    out = axis.zero_after_first(frame, ["k"], "day", "v", "present")
    assert [r.v for r in out.filter("k = 'k'").orderBy("day").collect()] == [None, 7, 0, None, 9]
    assert out.filter("k = 'never'").collect()[0].v is None
    peak = {r.k: r for r in axis.peaks(out, ["k"], "day", "v").collect()}
    assert (peak["k"].peak, peak["k"].peak_on, peak["k"].last_on) == (9, days[4], days[4]) and peak["never"].peak is None


def test_archive_compares_the_first_leg_and_scores_the_last_day_apart(spark):
    d2 = DAY + dt.timedelta(days=1)
    mine = spark.createDataFrame([(DAY, "a", 101.0, 5.0), (d2, "a", 50.0, 0.0), (DAY, "b", None, 3.0)], "day date, k string, relay double, hub double")
    archived = spark.createDataFrame([(DAY, "a", 100.0), (d2, "a", 100.0), (DAY, "b", 9.0), (DAY, "c", 9.0)], "day date, k string, value double")
    out = {r.part: r for r in B.archive_scores(B.archive_pairs(mine, archived, ["day", "k"]), "day", 10.0).collect()}
    assert (out["body"].pairs, out["body"].median, out["tail"].max, out["tail"].beyond_quantum) == (1, 0.01, 0.5, 1)


def test_reconciliation_is_unknown_when_incomplete(spark):
    assets = spark.createDataFrame([("a", Decimal(10), 2, True), ("b", Decimal(10), 1, False), ("c", None, 1, True), ("d", Decimal(5), 1, True)], "asset string, supply decimal(38,0), claimed long, complete boolean")
    holders = spark.createDataFrame([("a", "x", "s", Decimal(4)), ("a", "y", None, Decimal(6)), ("b", "x", "s", Decimal(11)), ("c", "x", None, Decimal(1)), ("d", "x", "s", Decimal(9))], "asset string, holder string, chain string, amount decimal(38,0)")
    out = {r.asset: r for r in B.decompose_holders(assets, holders).collect()}
    assert (out["a"].sum_matches, out["b"].sum_matches, out["c"].sum_matches, out["d"].sum_matches) == (True, None, None, False)
    assert out["b"].negative_residual and int(out["d"].unaccounted) == -4
    total = B.reconciliation(B.decompose_holders(assets, holders)).collect()[0]
    assert (total.exact, total.mismatched, total.unchecked, total.over_accounted) == (1, 1, 2, 1)


def test_sticky_ids_stay_listed(spark):
    rows = spark.createDataFrame([(1, DAY), (2, DAY + dt.timedelta(days=2))], "id int, day date")
    got = [tuple(r) for r in B.sticky_ids(rows, "id", "day").orderBy("id").collect()]
    end = DAY + dt.timedelta(days=2)
    assert got == [(1, DAY, end), (2, end, end)]


def test_csv_readers(spark, tmp_path):
    (tmp_path / "b.csv").write_text("address,block_number,balance,timestamp\nx,1,170141183460469231731687303715884105727,2024-01-01T05:00\ny,2,5,2024-01-02 00:00:00.123456\n")
    rows = landing.read_balances(spark, str(tmp_path / "b.csv")).orderBy("block").collect() if False else None
    (tmp_path / "ok.csv").write_text("address,block_number,balance,timestamp\nx,1,99999999999999999999999999999999999999,2024-01-01T05:00\ny,2,5,2024-01-02 00:00:00.123456\n")
    rows = landing.read_balances(spark, str(tmp_path / "ok.csv")).orderBy("block").collect()
    assert [(r.address, r.day.isoformat()) for r in rows] == [("x", "2024-01-01"), ("y", "2024-01-02")]
    (tmp_path / "bad.csv").write_text("block_number,address,balance,timestamp\n1,x,5,2024-01-01\n")
    with pytest.raises(Exception):
        landing.read_balances(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "labels.csv").write_text("name,addr, with comma\nplain,x\n")
    assert [r.address for r in landing.read_labels(spark, str(tmp_path / "labels.csv")).collect()] == ["addr, with comma", "x"]


def test_unusable_block_lines_stay_visible(spark, tmp_path):
    (tmp_path / "blocks").write_text('{"header":{"number":1,"timestamp":5},"events":[]}\n{"header":{"number":2}}\nnot json\n')
    rows = landing.read_blocks(spark, str(tmp_path / "blocks")).collect()
    assert sorted((r.usable, r.corrupt) for r in rows) == [(False, False), (False, True), (True, False)]


def test_wrapped_prices(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    assets = frame([(i,) for i in range(1, 8)], "id int")
    wraps = frame([(1, 2, 2.0), (2, 3, 3.0), (4, 5, 2.0), (5, None, None), (6, 7, 1.0), (7, 6, 1.0)], "id int, underlying int, ratio double")
    oracle = frame([(3, 10.0)], "id int, price double")
    spot = frame([(1, 7.0), (4, 9.0), (6, 4.0)], "id int, price double")
    got = {r.id: (r.price, r.via) for r in capital.resolve_prices(assets, wraps, oracle, spot).collect()}
    assert got[1] == (60.0, "oracle") and got[3] == (10.0, "oracle")
    assert got[4] == (9.0, "spot") and got[5] == (None, None)
    assert got[6] == (4.0, "spot") and got[7] == (4.0, "spot")


def test_pool_gap_prices_a_single_unpriced_leg_only(spark):
    pools = frame = spark.createDataFrame([(1, Decimal(100)), (2, Decimal(100)), (3, Decimal(10))], "pool int, via_shares decimal(18,4)")
    legs = spark.createDataFrame([(1, "a", 1.0, Decimal(60)), (1, "b", 8.0, None), (2, "a", 1.0, None), (2, "b", 1.0, None), (3, "a", 1.0, Decimal(60)), (3, "b", 1.0, None)], "pool int, leg string, amount double, usd decimal(18,4)")
    out = {r.pool: (r.implied_price, r.unattributed) for r in capital.pool_checks(pools, legs).collect()}
    assert frame is pools and out == {1: (5.0, None), 2: (None, 100.0), 3: (None, None)}


def test_nothing_known_is_not_zero(spark):
    rows = spark.createDataFrame([("s", None, None, False, False)], "snapshot string, supplied_usd decimal(18,4), borrowed_usd decimal(18,4), is_wrapper boolean, frozen boolean")
    row = capital.market_totals(rows, "snapshot").collect()[0]
    assert (row.supplied, row.utilisation, row.unpriced) == (None, None, 1)


def test_peg_list_of_the_wrong_length_is_not_used(spark):
    pools = spark.createDataFrame([(1, [5, 6], 10, 20, 100, 50), (2, [5, 6], 10, 10, 100, 50)], "pool int, assets array<int>, initial_amp int, final_amp int, final_block int, head int")
    pegs = spark.createDataFrame([(1, [1.0, 1.1], 40), (2, [1.0], 45)], "pool int, ratios array<double>, recorded_block int")
    rates = spark.createDataFrame([(6, 1.0)], "asset int, rate double")
    out = {(r.pool, r.asset): r for r in capital.peg_states(pools, pegs, rates).collect()}
    assert out[(1, 6)].gap_bps == pytest.approx(1000.0) and out[(1, 6)].ramping and out[(1, 6)].peg_age == 10
    assert out[(2, 6)].peg is None and out[(2, 6)].aligned is False
    assert F is not None

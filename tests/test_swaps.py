import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import axis, ranking, swaps

SCHEMA = (
    "id string, account string, account_id string, date date, venue string, status string, failed boolean, token_in string, "
    "token_out string, amount_in double, amount_out double, usd decimal(18,4), hops int, is_pallet boolean"
)
DAY = dt.date(2026, 7, 1)


def trades(spark, rows):
    base = dict(account_id=None, date=DAY, venue="PoolA", status=None, failed=False, token_in="USDT", token_out="AAA", amount_in=1.0, amount_out=1.0, hops=2, is_pallet=False)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    full = [{**base, "id": str(i), "account": f"a{i}", **r} for i, r in enumerate(rows)]
    from decimal import Decimal

    for r in full:
        r["usd"] = None if r["usd"] is None else Decimal(r["usd"])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMA)


def test_unpriced_trades_count_but_add_nothing(spark):
    row = swaps.day_summary(trades(spark, [{"usd": 100}, {"usd": None}, {"usd": 50}])).collect()[0]
    assert (row.trades, row.usd, row.unpriced, row.legs, row.leg_inflation) == (3, 150.0, 1, 6, 2.0)


def test_day_lists_and_shares(spark):
    rows = [{"usd": 400, "venue": "PoolB", "is_pallet": True, "token_in": "AAA", "token_out": "USDT"}] + [{"usd": u} for u in (300, 200, 100, 50)]
    row = swaps.day_summary(trades(spark, rows)).collect()[0]
    assert (row.usd, row.accounts, row.pallet_trades, row.pallet_usd) == (1050.0, 5, 1, 400.0)
    assert row.venues == "PoolA 650.00 / PoolB 400.00"
    assert (row.routes_total, row.top_four_share, row.top_ten_share) == (2, 95.2381, 100.0)
    sides = {r.symbol: (float(r.usd), r.trades_in, r.trades_out) for r in swaps.asset_sides(trades(spark, rows)).collect()}
    assert sides["USDT"] == (650.0, 4, 1)


def test_a_day_without_volume_has_no_shares(spark):
    row = swaps.day_summary(trades(spark, [{"usd": None}])).collect()[0]
    assert (row.trades, row.usd, row.top_four_share) == (1, 0.0, None)


def test_summary_medians_peak_and_settled(spark):
    rows = [
        {"usd": 10, "account": "x", "status": "FILLED"},
        {"usd": 30, "account": "y", "status": "REFUNDED", "failed": True, "date": DAY + dt.timedelta(days=3)},
        {"usd": 30, "account": "z", "date": DAY + dt.timedelta(days=1), "status": "PLACED"},
    ]
    row = swaps.swap_summary(trades(spark, rows)).collect()[0]
    assert (row.usd, row.span_days, row.active_days, row.settled, row.failed_usd) == (70.0, 4, 3, 1, 30.0)
    assert row.peak_date == DAY + dt.timedelta(days=1)
    assert (row.median_active_day, row.median_account) == (30.0, 30.0)


def test_account_id_only_when_there_is_exactly_one(spark):
    rows = [{"usd": 1, "account": "p", "account_id": "k1"}, {"usd": 2, "account": "p", "account_id": "k2"}, {"usd": 3, "account": "q", "account_id": "k3"}]
    out = {r.account: (r.account_ids, r.account_id) for r in swaps.account_rollup(trades(spark, rows)).collect()}
    assert out == {"p": (2, None), "q": (1, "k3")}


def test_rate_board_falls_back_to_all_rates_when_none_settled(spark):
    rows = [{"usd": 1, "failed": True, "amount_out": 2.0}, {"usd": 1, "failed": True, "amount_out": 4.0}]
    row = swaps.rate_board(trades(spark, rows)).collect()[0]
    assert (row.settled_observations, row.window, row.median) == (0, 2, 3.0)


def test_concentration_keeps_the_whole_total(spark):
    accounts = spark.createDataFrame([(f"a{i:03d}", 1) for i in range(100)], "account string, usd int")
    head = swaps.concentration(accounts, depth=10).orderBy("rank").collect()
    assert len(head) == 10 and head[-1].share == 10.0


def test_top_or_rest_keeps_everything(spark):
    frame = spark.createDataFrame([(f"r{i}", i) for i in range(20)], "route string, usd int")
    out = ranking.top_or_rest(frame, "route", "usd", 3, "other").collect()
    assert len(out) == 4 and sum(r.usd for r in out) == sum(range(20)) and sum(r.members for r in out) == 20


def test_paging_walks_the_whole_list_once(spark):
    frame = spark.createDataFrame([(i // 3, i) for i in range(20)], "day int, id int")
    seen, after = [], None
    while True:
        page = ranking.page_after(frame, [("day", "desc"), ("id", "asc")], after, 6).collect()
        if not page:
            break
        seen += [r.id for r in page]
        after = [page[-1].day, page[-1].id]
    assert sorted(seen) == list(range(20)) and len(seen) == 20


def test_halves_add_up(spark, small):
    from ledgerloom.sources import tables as T

    frame = T.trades(spark, small)
    whole = {r.venue: (r.usd, r["count"]) for r in swaps.volume(frame, "venue").collect()}
    early, late = (swaps.volume(frame.filter(c), "venue").collect() for c in ("date < '1998-01-01'", "date >= '1998-01-01'"))
    both = {}
    for r in early + late:
        u, n = both.get(r.venue, (0, 0))
        both[r.venue] = (u + r.usd, n + r["count"])
    assert both == whole


def test_row_order_does_not_matter(spark, small):
    from ledgerloom.sources import tables as T

    frame = T.trades(spark, small)
    shuffled = frame.orderBy(F.xxhash64("id")).repartition(7)
    for op in (swaps.rate_board, swaps.swap_summary):
        assert op(frame).collect() == op(shuffled).collect()


def test_dense_axis_fills_zero_or_leaves_unknown(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 1), 5), (dt.date(2024, 1, 4), 7)], "date date, n int")
    assert [r.n for r in axis.dense(rows, "date", {"n": 0}).orderBy("date").collect()] == [5, 0, 0, 7]
    assert [r.n for r in axis.dense(rows, "date", {}).orderBy("date").collect()] == [5, None, None, 7]
    assert axis.dense(rows.limit(0), "date", {}).count() == 0


@pytest.mark.parametrize("winner,expected", [("stored", "stored"), ("tail", "tail")])
def test_declared_precedence(spark, winner, expected):
    day = dt.date(2024, 1, 1)
    stored = spark.createDataFrame([(day, 1)], "day date, n int")
    tail = spark.createDataFrame([(day, 2)], "day date, n int")
    assert axis.prefer(stored, tail, ["day"], winner).collect()[0].origin == expected


def test_settled_months(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 3, 2),)], "day date")
    months = axis.months_between(rows, "day")
    at = lambda text: F.lit(text).cast("timestamp")
    late = axis.settled_months(months, at("2024-03-01 02:00:00"), at("2024-03-02 00:00:00"), 2)
    assert [r.settled for r in late.orderBy("month").collect()] == [True, True, False]
    early = axis.settled_months(months, at("2024-03-01 01:59:59"), at("2024-03-02 00:00:00"), 2)
    assert [r.settled for r in early.orderBy("month").collect()] == [True, False, False]
    behind = axis.settled_months(months, at("2024-04-01 00:00:00"), at("2024-02-29 23:00:00"), 2)
    assert [r.settled for r in behind.orderBy("month").collect()] == [True, False, False]

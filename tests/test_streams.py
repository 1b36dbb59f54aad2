import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import facts as K
from ledgerloom.sources.ledger import Ledger, Overtaken, read_written
from ledgerloom.streaming import rollup as R
from ledgerloom.streaming import settlement as St

ROW = "event_id long, at timestamp, kind string"
T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(hours=h), "k") for i, h in rows], ROW)


def run(spark, landing, out, cursor, files=None):
    days = R.settled_days(R.read_landing(spark, str(landing), files), "at", "2 hours", [], {"rows": F.count(F.lit(1))})
    R.drain(days, R.replace_partitions(str(out), "day"), str(cursor))
    return {str(r.day): r.rows for r in spark.read.parquet(str(out)).collect()}


def test_one_or_many_batches_give_the_same_days(spark, tmp_path):
    rows = [(i, i * 3) for i in range(40)]
    one, many = tmp_path / "one", tmp_path / "many"
    events(spark, rows).coalesce(1).write.parquet(str(one))
    for i in range(0, 40, 8):
        events(spark, rows[i : i + 8]).coalesce(1).write.mode("append").parquet(str(many))
    whole = run(spark, one, tmp_path / "o1", tmp_path / "c1")
    split = run(spark, many, tmp_path / "o2", tmp_path / "c2", files=1)
    batch = {}
    for _, h in rows:
        day = str((T0 + dt.timedelta(hours=h)).date())
        batch[day] = batch.get(day, 0) + 1
    last = str((T0 + dt.timedelta(hours=39 * 3)).date())
    batch.pop(last)
    assert whole == split == batch


AT_ONCE = dt.timedelta(0)


def settlement(spark, path, clock=dt.datetime(2100, 1, 1), wait=AT_ONCE):
    return St.DaySettlement(Ledger(spark, str(path)), "at", dt.timedelta(hours=2), [], {"rows": F.count(F.lit(1))}, wait=wait, clock=lambda: clock)


def days(ledger, table="settled"):
    rows = ledger.read(table)
    return {} if rows is None else {str(r.day): r.rows for r in rows.collect()}


def test_late_rows_are_kept_and_days_stay_closed(spark, tmp_path):
    landing, one = tmp_path / "landing", settlement(spark, tmp_path / "ledger")
    for rows in ([(1, 1), (2, 30), (3, 60)], [(8, 61), (9, 2), (10, 40)]):
        events(spark, rows).write.mode("append").parquet(str(landing))
        R.drain(R.read_landing(spark, str(landing)), one.sink, str(tmp_path / "c"))
        assert days(one.ledger) == {"2024-01-01": 1, "2024-01-02": 1}
    # What was on time is not late, and every row that a closed day left out is kept.
    assert sorted(r.event_id for r in one.ledger.read("late").collect()) == [9, 10]
    assert days(one.ledger, "open") == {"2024-01-03": 2}


def test_clock_and_then_head_hold_a_day_back(spark, tmp_path):
    clock = dt.datetime(2024, 1, 2, 0, 30)
    one = settlement(spark, tmp_path / "l", clock, dt.timedelta(hours=1))
    one.sink(events(spark, [(1, 1), (2, 30)]), 0)
    assert days(one.ledger) == {}  # the head has passed the first of January, the clock has not waited long enough
    one.clock = lambda: dt.datetime(2024, 1, 2, 1, 0)
    one.release()
    one.release()
    assert days(one.ledger) == {"2024-01-01": 1}  # given out without a new row, once
    one.clock = lambda: dt.datetime(2024, 6, 1)
    one.sink(events(spark, [(3, 49)]), 1)
    assert days(one.ledger) == {"2024-01-01": 1}  # now the head holds the second back: its end lies one hour behind, not two
    one.sink(events(spark, [(4, 51), (5, 3)]), 2)
    assert days(one.ledger) == {"2024-01-01": 1, "2024-01-02": 1}
    assert [r.event_id for r in one.ledger.read("late").collect()] == [5]


def test_shuffled_files_lose_no_row(spark, tmp_path):
    landing, one = tmp_path / "landing", settlement(spark, tmp_path / "l")
    rows = [(i, (i * 37) % 200) for i in range(60)]
    for k in range(0, 60, 6):
        events(spark, rows[k : k + 6]).coalesce(1).write.mode("append").parquet(str(landing))
    spark.createDataFrame([(99, None, "k")], ROW).write.mode("append").parquet(str(landing))
    R.drain(R.read_landing(spark, str(landing), 1), one.sink, str(tmp_path / "c"))
    late = one.ledger.read("late")
    assert sum(days(one.ledger).values()) + sum(days(one.ledger, "open").values()) + late.count() == 61
    assert late.filter("at IS NULL").count() == 1 and late.count() > 1
    whole = {}
    for i, h in rows:
        day = str((T0 + dt.timedelta(hours=h)).date())
        whole[day] = whole.get(day, 0) + 1
    for r in late.filter("at IS NOT NULL").groupBy(F.to_date("at").alias("day")).count().collect():
        whole[str(r.day)] -= r["count"]
    assert {d: n for d, n in whole.items() if n} == days(one.ledger) | days(one.ledger, "open")
    # Folders are folded: eleven batches have left a few.
    assert len(one.ledger.state()["tables"]["late"]) < Ledger.FOLD


def test_a_repeated_batch_is_passed_over(spark, tmp_path):
    one = settlement(spark, tmp_path / "l")
    for _ in range(2):
        one.sink(events(spark, [(1, 1), (2, 60)]), 0)
    assert days(one.ledger) == {"2024-01-01": 1} and days(one.ledger, "open") == {"2024-01-03": 1}
    rows = Ledger(spark, str(tmp_path / "rows"))
    for number in (0, 0, 1):
        St.append_sink(rows, "rows")(events(spark, [(number, 1)]), number)
    assert sorted(r.event_id for r in rows.read("rows").collect()) == [0, 1]


def test_keys_are_kept_once_and_nothing_vanishes(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    sink = St.keep_first_sink(ledger, ["event_id"], "at", dt.timedelta(hours=10))
    batches = [[(1, 5), (2, 6), (2, 7)], [(2, 6), (3, 30)], [(1, 5), (4, 25), (3, 30)], [(5, 60), (4, 25)]]
    for number, rows in enumerate(batches):
        sink(events(spark, rows), number)
    ids = lambda t: sorted(r.event_id for r in ledger.read(t).collect())
    assert ids("kept") == [1, 2, 3, 4, 5]
    assert ids("late") == [1] and ids("repeated") == [2, 2, 3, 4]
    sink(events(spark, [(4, 25)]), 4)  # its key is forgotten by now, so it may not come out again
    assert ids("late") == [1, 4] and ids("kept") == [1, 2, 3, 4, 5]
    # Keys older than the delay are remembered no longer.
    assert sorted(r.event_id for r in ledger.read("seen").collect()) == [5]


def steps(spark, rows):
    return spark.createDataFrame([(o, s, None if h is None else T0 + dt.timedelta(hours=h)) for o, s, h in rows], "order_id long, step string, at timestamp")


def test_orders_end_once_filled_or_not(spark, tmp_path):
    orders = St.OrderEnds(Ledger(spark, str(tmp_path / "l")), dt.timedelta(hours=1), dt.timedelta(hours=10))
    orders.sink(steps(spark, [(1, "placed", 0), (2, "placed", 1), (3, "filled", 2), (1, "filled", 3)]), 0)
    orders.sink(steps(spark, [(3, "placed", 2), (1, "redeemed", 9), (4, "placed", 9), (9, "filled", 4)]), 1)
    for _ in range(2):
        orders.sink(steps(spark, [(5, "placed", 20), (4, "filled", 19), (2, "filled", 20), (8, "placed", None)]), 2)
    ends = {r.order_id: (r.fills, r.state, r.first_latency_s, r.final) for r in orders.ends().collect()}
    assert ends == {1: (2, "redeemed", 3 * 3600, True), 2: (0, "placed", None, True), 3: (1, "filled", 0, True), 4: (1, "filled", 36000, False), 5: (0, "placed", None, False)}
    ledger = orders.ledger
    assert sorted((r.order_id, r.step) for r in ledger.read("late").collect()) == [(8, "placed")]
    # Outside of the order's bound, and without an order that could still come.
    assert sorted(r.order_id for r in ledger.read("stray").collect()) == [2, 9]
    assert ledger.read("waiting").count() == 0
    orders.sink(steps(spark, [(1, "refunded", 8)]), 3)
    assert ledger.read("late").count() == 2 and {r.order_id: r.state for r in orders.ends().collect()}[1] == "redeemed"


def test_order_ends_are_those_of_a_plain_fold(spark, tmp_path):
    import random

    draw = random.Random(5)
    rows = [(o, "placed", o % 50) for o in range(80)] + [(draw.randrange(90), draw.choice(["filled", "refunded", "redeemed"]), draw.randrange(70)) for _ in range(300)]
    draw.shuffle(rows)
    orders = St.OrderEnds(Ledger(spark, str(tmp_path / "l")), dt.timedelta(hours=100), dt.timedelta(hours=10))
    for k in range(4):
        orders.sink(steps(spark, rows[k::4]), k)
    want = {}
    for o, s, h in rows:
        if s == "placed":
            inside = [(x, t) for p, x, t in rows if p == o and x != "placed" and h <= t <= h + 10]
            kinds = {x for x, _ in inside}
            state = next((k for k in ("refunded", "redeemed", "filled") if k in kinds), "placed")
            want[o] = (len(inside), state if inside else "placed", (min(t for _, t in inside) - h) * 3600 if inside else None)
    assert {r.order_id: (r.fills, r.state, r.first_latency_s) for r in orders.ends().collect()} == want


def test_redelivery_adds_nothing(spark, tmp_path):
    landing, out = tmp_path / "landing", tmp_path / "out"
    rows = events(spark, [(i, i) for i in range(10)])
    sink = lambda batch, number: batch.write.mode("append").parquet(str(out))
    for _ in range(2):
        rows.write.mode("append").parquet(str(landing))
        R.drain(R.drop_redelivered(R.read_landing(spark, str(landing)), ["event_id"], "at", "1 day"), sink, str(tmp_path / "c"))
    ids = [r.event_id for r in spark.read.parquet(str(out)).collect()]
    assert sorted(ids) == list(range(10))


def test_months_pass_on_when_whole(spark, tmp_path):
    day = lambda n: dt.date(2024, 2, 1) + dt.timedelta(days=n)
    rows = lambda days: spark.createDataFrame([(day(n), 1) for n in days], "day date, trades long")
    sink = R.month_sink(str(tmp_path / "d"), str(tmp_path / "m"))
    sink(rows(range(0, 20)), 0)
    sink(rows(range(10, 28)), 1)
    assert read_written(spark, str(tmp_path / "m")) is None or spark.read.parquet(str(tmp_path / "m")).count() == 0
    sink(rows([28, 29]), 2)
    assert [(r.month, r.days, r.trades) for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [("2024-02", 29, 29)]


def put(spark, path, rows, version, stored):
    frame = spark.createDataFrame(rows, "day date, n long")
    facts = K.stamp(frame, "s", "o", F.lit("{}"), "day", code_version=version, stored_at=F.lit(stored).cast("timestamp"))
    K.put_facts(facts, path)


def test_putting_a_segment_again_replaces_it(spark, tmp_path):
    path = str(tmp_path / "facts")
    d = lambda m, n: dt.date(2024, m, n)
    put(spark, path, [(d(1, 1), 1), (d(1, 2), 2), (d(2, 1), 3)], "1", "2024-03-01 00:00:00")
    put(spark, path, [(d(1, 2), 20)], "2", "2024-03-02 00:00:00")
    put(spark, path, [(d(1, 2), 20)], "2", "2024-03-02 00:00:00")
    facts = K.read_facts(spark, path)
    assert sorted((r.segment, r.n, r.code_version, r.head) for r in facts.collect()) == [
        ("2024-01-01", 1, "1", None),
        ("2024-01-02", 20, "2", None),
        ("2024-02-01", 3, "1", None),
    ]
    row = K.coverage(facts).collect()[0]
    assert (row.segments, row.earliest, row.latest) == (3, "2024-01-01", "2024-02-01")
    assert K.facts_before(facts, "s", "o", "2024-01-02").count() == 1
    plan = K.facts_before(facts, "s", "o", "2024-01-02")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(source" in plan


def test_a_batch_of_many_partitions_is_put_in_slices(spark, tmp_path):
    rows = "SELECT 'v' || n %% 3 AS source, 'daily' AS operation, '{}' AS params, m || '-01' AS segment, %d AS n, 'h' AS head, '%d' AS code_version, TIMESTAMP'2024-01-0%d 00:00:00' AS stored_at, m AS month FROM (SELECT id AS n, format_string('20%%02d-01', id) AS m FROM range(%d, %d))"
    path = str(tmp_path / "facts")
    K.put_facts(spark.sql(rows % (1, 1, 1, 0, 8)), path)
    K.put_facts(spark.sql(rows % (2, 2, 2, 3, 14)), path, most=2)
    found = sorted((r.month, r.n) for r in K.read_facts(spark, path).collect())
    assert found == [(f"20{k:02}-01", 1 if k < 3 else 2) for k in range(14)]


def test_a_stop_between_two_slices_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "facts")
    d = lambda m, n: dt.date(2024, m, n)
    put(spark, path, [(d(1, 1), 1), (d(2, 1), 2)], "1", "2024-03-01 00:00:00")
    before, rows = K.read_facts(spark, path), lambda: sorted((r.segment, r.n) for r in K.read_facts(spark, path).collect())
    written = K._written

    def stops(ledger, frame):
        if frame.filter("month = '2024-02'").count():
            raise RuntimeError("stopped")
        return written(ledger, frame)

    monkeypatch.setattr(K, "_written", stops)
    new = K.stamp(spark.createDataFrame([(d(1, 1), 10), (d(2, 1), 20), (d(3, 1), 30)], "day date, n long"), "s", "o", F.lit("{}"), "day", code_version="2", stored_at=F.lit("2024-03-02 00:00:00").cast("timestamp"))
    with pytest.raises(RuntimeError):
        K.put_facts(new, path, most=1, cursor=7)
    assert rows() == [("2024-01-01", 1), ("2024-02-01", 2)] and Ledger(spark, path).state()["cursor"] is None
    monkeypatch.setattr(K, "_written", written)
    K.put_facts(new, path, most=1, cursor=7)
    assert rows() == [("2024-01-01", 10), ("2024-02-01", 20), ("2024-03-01", 30)] and Ledger(spark, path).state()["cursor"] == 7
    # Who read the table before still has it; old folders go when told to, those of the half batch too.
    assert sorted(r.n for r in before.collect()) == [1, 2]
    assert Ledger(spark, path).vacuum(keep=1) > 0
    assert rows() == [("2024-01-01", 10), ("2024-02-01", 20), ("2024-03-01", 30)]


def test_of_two_writers_the_later_one_fails(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    base = ledger.state()
    entry = ledger.write(spark.range(3), "rows")
    ledger.publish(base, {"rows": [entry]}, cursor=1)
    with pytest.raises(Overtaken):
        ledger.publish(base, {"rows": []}, cursor=2)
    assert ledger.read("rows").count() == 3
    # A commit file that was cut off is no commit, and does not stop the next writer.
    (tmp_path / "l" / "log" / "000000000002.json").write_text('{"version": 2, "tab')
    assert ledger.state()["version"] == 1
    ledger.publish(ledger.state(), {}, cursor=3)
    assert ledger.state()["cursor"] == 3 and ledger.state()["version"] == 3


def test_facts_of_a_stream_are_put_once(spark, tmp_path):
    path = str(tmp_path / "facts")
    batch = lambda n: K.stamp(spark.createDataFrame([(dt.date(2024, 1, 1), n)], "day date, n long"), "s", "o", F.lit("{}"), "day", stored_at=F.lit("2024-03-01 00:00:00").cast("timestamp"), code_version=str(n))
    sink = K.facts_sink(path)
    sink(batch(1), 0)
    sink(batch(5), 0)  # the same number again: rows of batch 0 are in
    assert [r.n for r in K.read_facts(spark, path).collect()] == [1]
    sink(batch(2), 1)
    assert [r.n for r in K.read_facts(spark, path).collect()] == [2]
    sink(batch(3).limit(0), 2)
    assert Ledger(spark, path).state()["cursor"] == 2 and [r.n for r in K.read_facts(spark, path).collect()] == [2]


def test_coverage_from_the_manifest_opens_no_facts(spark, tmp_path):
    path = str(tmp_path / "facts")
    put(spark, path, [(dt.date(2024, m, 1), m) for m in (1, 2, 3)], "1", "2024-03-01 00:00:00")
    put(spark, path, [(dt.date(2024, 2, d), d) for d in (1, 9)], "2", "2024-03-02 00:00:00")
    found = K.stored_coverage(spark, path)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in K.coverage(K.read_facts(spark, path)).collect()] == [("s", "o", "{}", 4, "2024-01-01", "2024-03-01")]
    assert all("/data/manifest/" in f for f in found.inputFiles())


@pytest.mark.parametrize("hours,matched", [(10, 1), (24 * 100, 0)])
def test_fills_outside_the_bound_do_not_match(spark, tmp_path, hours, matched):
    placed = spark.createDataFrame([(1, T0)], "order_id long, placed_at timestamp")
    filled = spark.createDataFrame([(1, T0 + dt.timedelta(hours=hours))], "order_id long, filled_at timestamp")
    placed.write.parquet(str(tmp_path / "p"))
    filled.write.parquet(str(tmp_path / "f"))
    out = str(tmp_path / "o")
    joined = R.life_cycle(R.read_landing(spark, str(tmp_path / "p")), R.read_landing(spark, str(tmp_path / "f")), "1 day", "90 days")
    R.drain(joined, lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / "c"))
    got = spark.read.parquet(out).collect()
    assert [r.latency_s for r in got] == [hours * 3600] * matched


def test_a_delivery_reads_and_writes_only_its_own_buckets(spark, tmp_path):
    import random

    from ledgerloom.sources.ledger import Ledger
    from ledgerloom.streaming.buckets import BlockBuckets

    draw = random.Random(5)
    ledger = Ledger(spark, str(tmp_path / "buckets"))
    buckets = BlockBuckets(ledger, "block", 10, per=4, keys=("kind",), sums={"total": F.sum("value")})
    assert buckets.read() is None
    deliveries = [[(draw.randrange(400), draw.choice("ab"), draw.randrange(9)) for _ in range(300)], [(draw.randrange(380, 440), "a", 1) for _ in range(50)], [], [(5, "c", 7), (None, "a", 2), (-3, "a", 1)], [(None, "a", 3), (399, "b", 4)]]
    want, scanned = {}, []
    for number, rows in enumerate(deliveries):
        for block, kind, value in rows:
            key = (None if block is None else block // 10, kind)
            n, total, ends = want.get(key, (0, 0, []))
            want[key] = (n + 1, total + value, ends + ([] if block is None else [block]))
        before = {p: e["put"] for e in ledger.state()["tables"].get("buckets", []) for p in e["parts"]}
        batch = spark.createDataFrame(rows, "block long, kind string, value long")
        buckets.sink(batch, number)
        buckets.sink(batch, number)
        after = {p: e["put"] for e in ledger.state()["tables"].get("buckets", []) for p in e["parts"]}
        touched = {None if b is None else b // 40 for b, _, _ in rows}
        assert {p for p in after if after[p] != before.get(p)} == touched
        scanned.append(len(touched))
        if want:
            got = {(r.bucket, r.kind): (r.rows, r.total, r.first_block, r.last_block) for r in buckets.read().collect()}
            assert got == {k: (n, t, min(e, default=None), max(e, default=None)) for k, (n, t, e) in want.items()}
    assert scanned == [10, 2, 0, 3, 2]
    plan = buckets._stored(ledger.state(), [10])[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan or "isnotnull(part" in plan
    ledger.vacuum(keep=1)
    assert {(r.bucket, r.kind) for r in buckets.read().collect()} == set(want)

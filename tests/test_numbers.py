import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import ordered, quantiles
from ledgerloom.functions import scalars as S


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10, 999, 1000])
def test_order_statistics_are_exact(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.gauss(0, 1), float(rng.randint(0, 5))]) for _ in range(n)]
    df = spark.createDataFrame([("k", v) for v in values] + [("other", 1.0), ("k", None)], "k string, v double")
    s = sorted(values)
    row = quantiles.middles(df, ["k"], "v").filter("k = 'k'").collect()[0]
    assert (row.n, row.lower, row.upper) == (n, s[(n - 1) // 2], s[n // 2])
    row = quantiles.nearest_rank(df.filter("k = 'k'"), [], "v", 0.95, "p").collect()[0]
    assert row.p == s[max(1, math.ceil(n * 0.95)) - 1]


def test_order_statistics_with_a_hot_key_and_repeats(spark):
    df = spark.range(400_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"),
        (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 7).alias("v"),
    )
    got = {r.k: (r.lower, r.upper) for r in quantiles.middles(df, ["k"], "v").collect()}
    want = df.groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("s")).collect()
    assert got == {r.k: (r.s[(len(r.s) - 1) // 2], r.s[len(r.s) // 2]) for r in want}


@pytest.mark.parametrize("shape", ["narrow", "wide", "ties"])
def test_order_statistics_over_many_rounds(spark, monkeypatch, shape):
    """A third of all rows in one key, few values ordered together: ranks are narrowed round by round."""
    monkeypatch.setattr(quantiles, "ORDERED", 20)
    monkeypatch.setattr(quantiles, "CELLS", 64)
    rng = random.Random(7)
    value = {
        "narrow": lambda: 1 + rng.randrange(10**6) * 1e-12,
        "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) * rng.random(),
        "ties": lambda: rng.choice([-1.0, -0.0, 0.0, 0.0, 1.0, 1.001]),
    }[shape]
    rows = [(0 if i % 3 == 0 else 1 + i % 40, value()) for i in range(3000)]
    df = spark.createDataFrame([*rows, (None, 1.0), (3, None)], "k int, v double")
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    got = {r.k: (r.n, r.lower, r.upper) for r in quantiles.middles(df, ["k"], "v").collect()}
    want = {k: (len(v), sorted(v)[(len(v) - 1) // 2], sorted(v)[len(v) // 2]) for k, v in groups.items()}
    assert got == want
    every = sorted(v for _, v in [*rows, (None, 1.0)])
    row = quantiles.nearest_rank(df, [], "v", 0.9, "p").collect()[0]
    assert (row.n, row.p) == (len(every), every[math.ceil(len(every) * 0.9) - 1])
    assert quantiles.middles(df.limit(0), [], "v").collect() == quantiles.middles(df.limit(0), ["k"], "v").collect() == []


def test_order_statistics_of_decimals_beyond_doubles(spark):
    values = [Decimal(10**20 + k) for k in range(31)]
    df = spark.createDataFrame([(v,) for v in reversed(values)], "v decimal(38,0)")
    row = quantiles.middles(df, [], "v").collect()[0]
    assert (row.lower, row.upper) == (values[15], values[15])


def test_six_digits_round_the_binary_value(spark):
    rng = random.Random(5)
    values = [1.403125, 1.390625, 463.3125, 1078.735, 0.0, -2.5, -463.3125, 9.999995, 999999.5, 1e-9, 123456789.0, 1e15 + 0.5]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 12) for _ in range(500)] + [rng.randint(1, 10**7) / 2**rng.randint(0, 20) for _ in range(500)]

    def expected(x):
        if x == 0:
            return 0.0
        exact = Decimal(x)
        return float(exact.quantize(Decimal(1).scaleb(exact.adjusted() - 5), rounding=ROUND_HALF_UP))

    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", S.six_digits(F.col("v")).alias("six")).collect():
        assert r.six == expected(r.v), r.v
    assert df.limit(1).select(S.six_digits(F.lit(None).cast("double")).alias("x")).collect()[0].x is None


def test_rounding_halves_go_up(spark):
    df = spark.createDataFrame([(-0.025,), (0.125,), (0.375,)], "v double")
    assert [r.c for r in df.select(S.round_cents(F.col("v") * 100 / 100).alias("c")).collect()] == [math.floor(v * 100 + 0.5) / 100 for v in (-0.025, 0.125, 0.375)]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).collect()[0].x
    lit = F.lit
    assert get(S.hex_uint_le(lit("3b191d0000000000"))) == 1907003
    assert get(S.hex_uint_le(lit("ff80"))) == 0x80FF
    assert get(S.digit_count(lit("-000123.99"))) == 3 and get(S.digit_count(lit("100000000000000000000"))) == 21
    assert get(S.normal_address(lit("0xABCDEF" + "0" * 40))) == "0" * 40
    assert get(S.initiation_venue(lit("DCA:12/34"))) == "DCA" and get(S.initiation_venue(lit("/x"))) == "Direct"
    assert get(S.initiation_venue(lit(None).cast("string"))) == "Direct"
    assert get(S.printable_or_null(lit("0x" + "6162" + "00" * 30))) == "ab"
    assert get(S.printable_or_null(lit("0x" + "00" * 32))) is None
    assert get(S.printable_or_null(lit("0x61ff" + "00" * 30))) is None
    assert get(S.scale_amount(lit("16988412"), lit(None).cast("int"))) is None
    assert get(S.token_cents(lit(16988412).cast("decimal(38,0)"), lit(100).cast("decimal(10,0)"))) == 169884.12
    label = get(S.account_label(lit("0x7369626Cd0070000" + "00" * 24)))
    assert (label.kind, label.para_id, label.label) == ("sibling", 2000, "para 2000")
    assert get(S.account_label(lit("0xdeadbeef"))) is None
    assert get(S.canonical_json(b=lit(1), a=lit("x"), gone=lit(None).cast("string"))) == '{"a":"x","b":1}'
    assert get(S.share(lit(1), lit(0))) == 0.0
    assert get(S.gap_bps(lit(1.0), lit(0.0))) is None


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_stretches_do_not_show(spark, width):
    rng = random.Random(width)
    rows = [(k, p, rng.randint(0, 9)) for k in "ab" for p in rng.sample(range(60), 25)]
    df = spark.createDataFrame(rows, "k string, p int, v int")
    prev = ordered.previous_in_order(df, ["k"], "p", ["v"], width)
    top = ordered.running_max(prev, ["k"], "p", "v", width, "top")
    for k in "ab":
        seen = [r for r in top.orderBy("p").collect() if r.k == k]
        values = [v for _, _, v in sorted(r for r in rows if r[0] == k)]
        assert [r.step for r in seen] == list(range(1, 26))
        assert [r.previous_v for r in seen] == [None, *values[:-1]]
        assert [r.top for r in seen] == [max(values[: i + 1]) for i in range(25)]

"""Wrap walks by doubling, beside walks one hop at a time."""

import random

import pytest

from ledgerloom.operators import capital

PRICES = "id long, price double"


def walked(node, wraps, oracle, spot):
    seen, factor, hop, best = set(), 1.0, 0, (None, None, None)
    while node not in seen:
        seen.add(node)
        if node in oracle:
            return oracle[node] * factor, "oracle", hop
        if node in spot:
            best = (spot[node] * factor, "spot", hop)
        if node not in wraps:
            break
        under, ratio = wraps[node]
        node, factor, hop = under, factor * ratio, hop + 1
    return best


def resolved(spark, ids, wraps, oracle, spot):
    frame = lambda rows: spark.createDataFrame(list(rows.items()), PRICES)
    links = spark.createDataFrame([(i, u, r) for i, (u, r) in wraps.items()], "id long, underlying long, ratio double")
    found = capital.resolve_prices(spark.createDataFrame([(i,) for i in ids], "id long"), links, frame(oracle), frame(spot))
    return {r.id: (r.price, r.via, r.hops) for r in found.collect()}


def check(got, ids, wraps, oracle, spot):
    assert set(got) == set(ids)
    for i in ids:
        price, via, hops = walked(i, wraps, oracle, spot)
        assert got[i][1:] == (via, hops), i
        assert (got[i][0] is None) == (price is None) and (price is None or got[i][0] == pytest.approx(price, rel=1e-5)), i


@pytest.mark.parametrize("seed", [1, 2])
def test_random_wraps_with_cycles(spark, seed):
    draw = random.Random(seed)
    n = 60
    wraps = {i: (draw.randrange(n + 5), draw.choice([0.5, 1.5, 2.0, 1.25])) for i in range(n) if draw.random() < 0.9}
    oracle = {i: 10.0 + i for i in range(n) if draw.random() < 0.04}
    spot = {i: 100.0 + i for i in range(n) if draw.random() < 0.2}
    check(resolved(spark, range(n), wraps, oracle, spot), range(n), wraps, oracle, spot)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, written = 1000, []
    settle = capital.settle
    monkeypatch.setattr(capital, "settle", lambda df, name, *p: written.append(name) or settle(df, name, *p))
    wraps = {i: (i + 1, 1.001) for i in range(n)}
    oracle = {n: 5.0}
    check(resolved(spark, range(n), wraps, oracle, {}), range(n), wraps, oracle, {})
    assert written.count("walks") <= 11


@pytest.mark.parametrize("length", [1, 7])
def test_cycles_of_every_entry(spark, length):
    ids = range(length + 3)
    wraps = {i: ((i + 1) % length, 2.0) for i in range(length)} | {length: (0, 3.0), length + 1: (length, 0.5)}
    for spot in ({0: 1.0}, {length - 1: 7.0, length: 9.0}):
        check(resolved(spark, ids, wraps, {}, spot), ids, wraps, {}, spot)

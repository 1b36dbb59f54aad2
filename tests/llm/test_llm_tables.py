"""Neighbours, mixing and the pipeline on small tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import side_by_side as sbs
from llm_tools import HARD, WORD, documents, hard, write_tables

import corpus_pipeline
from ledgerloom.llm import bpe, common, mixing, neighbours, queries, simhash, toxicity
from test_llm_copies import plain_dedup, plain_fingerprint, smallest


def vectors(n, size=64, centres=9, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, size))
    return (middle[rng.integers(0, centres, n)] + 0.7 * rng.normal(size=(n, size))).astype(np.float32)


def test_bounds_hold_for_almost_all_pairs():
    v = vectors(2000).astype(np.float64)
    frame = neighbours.fit(v[:500])
    low, high = neighbours.estimates(v[:80], *neighbours.encode(v, frame), frame)
    true = v @ v[:80].T
    inside = ((low <= true) & (true <= high)).mean()
    assert inside > 0.99
    assert ((high + low) / 2 - true).std() < 0.4 * true.std()


def test_neighbours_beside_brute_force_over_many_cells(spark, monkeypatch, tmp_path):
    for name, value in (("ROWS", 300), ("QUERIES_A_CELL", 20), ("CHUNK", 90), ("SAMPLE", 500)):
        monkeypatch.setattr(neighbours, name, value)
    v = vectors(1500)
    v[100:160] = v[60]  # ties
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(2000, None, 0), (2020, [float("nan")] * 64, 0), (2040, [0.0] * 64, 0), (2060, [None] + [1.0] * 63, 0), (2080, [1.0, 2.0], 0), (None, [1.0] * 64, 0), (2100, [float("inf")] * 64, 0)]
    folder = write_tables(tmp_path, [], embeddings=rows)
    got = neighbours.op3_neighbours(spark, folder).collect()
    con = sbs.connect(folder)
    want = {(r[0], r[1]): (r[2], r[3]) for r in con.execute(neighbours.ORACLE.replace("FROM embeddings\n", "FROM embeddings\n").replace("AND len(list_filter(embedding, lambda x: x <> 0)) > 0", "AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(embedding) = 64")).fetchall()}
    assert len(got) == len(want)
    same = sum(want[(r["query_id"], r["rank"])] == (r["vec_id"], r["score"]) for r in got)
    assert same >= 0.99 * len(want)
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert all(s == neighbours.exact(v.astype(float), v.astype(float), np.array([c]), np.array([q]))[0] for (q, c), s in list(scores.items())[:200])


def test_neighbours_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>, rank int, score string, v int"
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, "x", 2), (1, [2.0, 0.0], 1, "x", 2), (2, [2.0, 0.0], 1, "x", 2), (20, [0.0, 1.0], 1, "x", 2)], schema)
    got = [tuple(r) for r in neighbours.search(few).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert neighbours.search(few.limit(0)).collect() == []


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and weight[s] * left > 3 * sizes[s] * free}
        if not over:
            return {s: float(3 * sizes[s]) if s in capped else weight[s] * left / free for s in order}
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_by_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = {f"é{i}" if i % 4 else (None if i == 0 else f"Z{i}"): rng.choice([0, 1, 5, 100, 1000, 100_000]) for i in range(14)}
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(want) and all(math.isclose(got[s], want[s], rel_tol=1e-12, abs_tol=1e-9) for s in want)


def mixed_documents(spark, n=300):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 900])), "en", rng.choice(["a", "a", "a", "b", "c", None]), None) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")


def test_mix_comes_to_its_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PLACES", 50)
    monkeypatch.setattr(mixing, "STRETCH", 64)
    docs = mixed_documents(spark)
    got = mixing.mix(docs, block=37).collect()
    assert len(got) == 300
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    taken, targets = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    assert all(taken[s] == math.floor(t + 0.5) for s, t in targets.items())
    key = lambda rows: sorted((r["doc_id"], r["taken"]) for r in rows)
    assert key(got) == key(mixing.mix(docs.repartition(7), block=1024).collect())


def test_every_stretch_of_the_schedule_is_close_to_the_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 100)
    sources = spark.createDataFrame([("a", 0, 9000, 5000.0), ("b", 1, 9000, 2500.4), ("c", 2, 9000, 1.0), ("d", 3, 0, 0.0), ("e", 4, 9000, 2499.6)], "source string, idx int, source_size long, target double")
    slots = sorted((r["slot"], r["idx"], r["rank"], r["taken"]) for r in mixing.schedule(sources, 5).collect())
    by = defaultdict(list)
    for slot, idx, rank, taken in slots:
        by[idx].append((rank, taken))
    assert {i: [r for r, _ in x] == list(range(len(x))) for i, x in by.items()} == {0: True, 1: True, 2: True, 4: True}
    assert {i: sum(t for _, t in x) for i, x in by.items()} == {0: 5000, 1: 2500, 2: 1, 4: 2500}
    share = np.cumsum([idx == 0 for _, idx, _, _ in slots]) - 0.5 * np.arange(1, len(slots) + 1)
    assert np.abs(share).max() < 6


def test_mix_of_hard_rows(spark):
    docs = hard(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    words = sum(len(WORD.findall(t["text"] or "")) for t in docs.select("text").collect())
    assert abs(sum(r["taken"] for r in got) - words) <= 4
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []


def test_mixing_query_beside_its_sql(spark, tmp_path):
    rows = [(i, t, "en", [None, "b", "a"][i % 3], 1) for i, t in enumerate(HARD * 3)]
    folder = write_tables(tmp_path, rows)
    assert sbs.differences(sbs.spark_rows(mixing.op10_mixing(spark, folder)), sbs.sql_rows(sbs.connect(folder), mixing.ORACLE)) is None


def pipeline_rows(n=90):
    rng = random.Random(12)
    words = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "haven", "inlet", "joker", "knoll", "lemon"]
    line = "This boilerplate line is shared by many of the documents here"
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(30, 90)))
        if i % 9 == 0:
            text += " disgusting worthless"
        if i % 4 == 1:
            text += "\n" + line
        if i % 10 == 7:
            text = rows[i - 1][1]
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    rows += [(n, None, "en", "s0", None), (n + 1, "", "de", None, 0)]
    return rows, [(i, 1, int(i % 9 == 0)) for i in range(n) if i % 5]


def test_pipeline_stage_by_stage(spark, tmp_path):
    rows, labels = pipeline_rows()
    folder = write_tables(tmp_path, rows, labels)
    docs = common.table(spark, folder, "documents")
    model = toxicity.fit(docs, common.table(spark, folder, "labels"))
    score = toxicity.scorer(model)
    first = corpus_pipeline.drop_toxic(spark, docs, folder)
    want = [r for r in rows if score(r[1] or "") < toxicity.THRESHOLD]
    assert sorted(map(tuple, first.collect()), key=str) == sorted(want, key=str)
    assert {r[0] for r in rows} - {r[0] for r in want} >= {i for i in range(0, 90, 9)} - {i for i in range(7, 90, 10)}
    assert first.columns == docs.columns

    second = corpus_pipeline.drop_shared_lines(spark, first, folder)
    assert sorted([(r["doc_id"], r["text"] or "") for r in second.collect()]) == sorted((i, t) for i, t, _, _ in plain_dedup([(r[0], r[1]) for r in want]))
    assert all(r["n_chars"] == len(r["text"]) for r in second.collect() if r["text"] is not None)

    kept = {r["doc_id"]: r["text"] or "" for r in second.collect()}
    prints = {i: plain_fingerprint(t) for i, t in kept.items()}
    root = smallest(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    third = corpus_pipeline.drop_near_copies(spark, second, folder)
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(i for i in root if root[i] == i)

    fourth = corpus_pipeline.mix_sources(spark, third, folder)
    took = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(third).collect()}
    times = Counter(r["doc_id"] for r in fourth.collect())
    assert all(times[i] == (math.floor(t / s + 0.5) if s else 0) for i, (t, s) in took.items())
    assert max(times.values()) <= 3 and fourth.columns == docs.columns

    last = corpus_pipeline.encode(spark, fourth, folder).collect()
    assert len(last) == sum(times.values())
    one = bpe.coder(bpe.read_vocabulary(corpus_pipeline.public_tokenizers.path(bpe.VOCABULARY)))
    texts = {r["doc_id"]: r["text"] or "" for r in third.collect()}
    assert all(one.decode(bytes(r["ids"])).decode() == texts[r["doc_id"]] for r in last)


def test_pipeline_runs_as_registered_and_bears_an_empty_table(spark, tmp_path):
    rows, labels = pipeline_rows(40)
    full = tmp_path / "full"
    none = tmp_path / "none"
    full.mkdir(), none.mkdir()
    assert queries.queries()["pipeline"](spark, write_tables(full, rows, labels)).count() > 10
    assert queries.queries()["pipeline"](spark, write_tables(none, [])).collect() == []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "encoding"]


def test_every_query_is_registered():
    names = queries.queries()
    assert sorted(int(n.split("_")[0][2:]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def test_vectors_of_doubles_keep_their_precision(spark):
    rows = [(20, [0.3, 0.0])] + [(k, [0.3 + d, 1e-12]) for k, d in ((1, 1e-10), (2, 3e-10), (3, 2e-10), (4, -1e-10))]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [2, 3, 1, 4]
    assert all(r["score"] == 0.3 * dict(rows)[r["vec_id"]][0] + 0.0 for r in found)

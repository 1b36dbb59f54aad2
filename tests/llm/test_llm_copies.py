"""Line dedup, SimHash and components beside brute force."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import side_by_side as sbs
import xxhash
from llm_tools import DOCS, HARD, documents, hard, write_tables

from ledgerloom.llm import line_dedup, simhash
from ledgerloom.llm.components import components
from ledgerloom.session import settle

A_TO_Z = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def plain_dedup(rows):
    """(doc_id, text) rows: kept text, lines, dropped, as the contract says it."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(A_TO_Z)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                held[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < 5 or i == max(held[key(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(3)
    shared = [f"Shared line {k} " + "Ünïcode wörds and MORE " * 2 for k in range(6)] + ["too short to count", "x" * 39, "y" * 40]
    texts = []
    for i in range(60):
        lines = [rng.choice(["", "  ", "\t" + rng.choice(shared) + " \r", rng.choice(shared).upper(), rng.choice(shared), f"own line {i} " * 5]) for _ in range(rng.randint(1, 9))]
        texts.append("\n".join(lines))
    docs = documents(spark, texts + HARD)
    want = plain_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = sorted([(r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup(docs).collect()], key=str)
    assert got == want
    assert sum(w[3] for w in want) > 20


def test_line_dedup_bears_hard_rows(spark):
    line = "the very same line of more than forty characters"
    frame = hard(spark)
    extra = frame.limit(1).select(*[(frame[c] if c not in ("doc_id", "text") else None) for c in frame.columns if c not in ("doc_id", "text")])
    rows = [(k, f"{line}\nown {k}") for k in (50, 51, 52, 52, 53, 54)] + [(None, line)]
    more = spark.createDataFrame(rows, "doc_id long, text string").crossJoin(extra).select(*frame.columns)
    both = frame.union(more)
    out = line_dedup.dedup(both)
    assert [c for c in out.columns if c not in ("n_lines", "n_dropped")] == both.columns
    got = sorted([(r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in out.collect()], key=str)
    assert got == plain_dedup([(r["doc_id"], r["text"]) for r in both.collect()])
    assert line_dedup.dedup(both.limit(0)).collect() == []


def test_runs_do_not_depend_on_batches_or_levels(spark):
    texts = [f"line number {k % 7} that many documents of this table share\nown {k}" for k in range(80)]
    docs = documents(spark, texts)
    one = sorted(map(tuple, line_dedup.dropped_lines(docs, batches=1).select("doc_id", "gone").collect()))
    for batches in (2, 5):
        assert sorted(map(tuple, line_dedup.dropped_lines(docs, batches=batches).select("doc_id", "gone").collect())) == one
    assert len(one) == 80 - 7


def test_closed_keys_are_not_added_again_and_levels_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, least=2, fan_in=2)
    for first in (30, 20, 10):
        runs.add(spark.createDataFrame([(1, 1, first + k) for k in range(3)] + [(first, 2, first)], "h1 long, h2 long, doc_id long"))
    assert [len(level) for level in runs.levels] == [1, 1]
    found = {(r["h1"], r["h2"]): (r["n"], r["newest"]) for r in runs.merged().collect()}
    assert found[(1, 1)] == (3, 32) and found[(10, 2)] == (1, 10)


def test_line_dedup_stays_in_the_jvm(spark, small):
    plan = line_dedup.op2_line_dedup(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "BroadcastNestedLoop"))


def plain_fingerprint(text):
    words = text.translate(A_TO_Z).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def smallest(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_by_definition(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    rng = random.Random(1)
    texts = ["", " ", "One", "ONE two", "a b c", "ÄÖ   x y"] + [" ".join(rng.choice("The quick brown FOX é q".split(" ")) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(t) % (1 << 64) == plain_fingerprint(t)


def near_prints(rng, n, around):
    """Fingerprints within a few bits of some centres: many links of one and two bits, and chains of them."""
    found = {0, 1, 3, (1 << 64) - 1}
    centres = [rng.getrandbits(64) for _ in range(around)]
    while len(found) < n:
        x = rng.choice(centres) if rng.random() < 0.6 else rng.choice(sorted(found))
        for b in rng.sample(range(64), rng.randint(0, 3)):
            x ^= 1 << b
        found.add(x)
    return sorted(found)


def test_links_lose_no_pair(spark):
    prints = near_prints(random.Random(5), 90, 2)
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    want = {frozenset(map(simhash._signed, (a, b))) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 2}
    assert len(want) > 50
    for crowd in (10_000, 2):  # pairs only, both ways
        got = {frozenset((r["a"], r["b"])) for r in simhash.links(frame, crowd=crowd).collect()}
        assert got == want
    for distance, m in ((1, 2),):
        want = {frozenset(map(simhash._signed, (a, b))) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= distance}
        assert {frozenset((r["a"], r["b"])) for r in simhash.links(frame, distance=distance, m=m, crowd=5).collect()} == want


def test_chains_keep_to_their_budgets():
    for _, key, ways in simhash.chains():
        assert key.bit_count() in (42, 43)
        for flip, rest in ways:
            assert flip & ~key == 0 and flip.bit_count() <= 1
            assert all(r & key == 0 and (r | flip).bit_count() <= 2 for r in rest)


def test_components_of_chains_hubs_and_nothing(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(1000, 1200)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(90)] + [(5, 5), (-3, 100)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    want = smallest({x for e in edges for x in e}, edges)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_classes_by_brute_force(spark, small):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = smallest(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    rows = simhash.op4_simhash(spark, small).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in texts}
    assert any(want[i] != i for i in want)


def test_classes_bear_hard_rows_and_one_of_each_stays(spark):
    docs = hard(spark)
    found = simhash.classes(docs).collect()
    assert len(found) == docs.count()
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]
    blank = {r["doc_id"] for r in found if r["fp"] == 0 and r["doc_id"] is not None}
    assert {r["component_id"] for r in found if r["fp"] == 0} == {min(blank)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # One row of each class, by the smallest id and then by the text; rows without an id all stay.
    class_of = {r["fp"]: r["class_fp"] for r in found}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {(i, class_of[simhash._signed(simhash.fingerprint(t or "") % (1 << 64))]) for i, t in rows if i is not None}
    first = {c: min(i for i, d in want if d == c) for _, c in want}
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter(first.values()) + Counter([None])
    assert simhash.classes(docs.limit(0)).collect() == [] and simhash.keep_one(docs.limit(0)).collect() == []


def test_a_copy_takes_no_other_text_of_its_id_along(spark):
    a, b, c = "alpha beta gamma delta", "one two three four five", "six seven eight nine ten"
    docs = documents(spark, []).union(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(1, b), (2, a), (2, b), (3, a), (4, c), (4, c), (5, c)]], DOCS))
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()) == [(1, b), (2, a), (4, c)]
    # Two texts under one id that are copies of nothing both stay, and each stands for its own class.
    twice = spark.createDataFrame([(7, a, "en", "s", 1), (7, c, "en", "s", 1), (8, a, "en", "s", 1), (9, c, "en", "s", 1), (7, c, "en", "s", 1)], DOCS)
    for up in (True, False):
        assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(twice.orderBy("text", ascending=up)).collect()) == [(7, a), (7, c)]


CLASHING = ("i", "s", "n", "k", "id", "same", "doc", "lines", "gone", "times", "__times", "__n", "__same", "__lines", "__loser", "__lost", "class_fp", "component_id", "fp")


def test_clashing_names_pass_through_the_stages(spark):
    from ledgerloom.llm import mixing

    line = "This line stands in many documents, more than forty letters"
    docs = documents(spark, [f"{line}\nown words number {k} of document {k} and more {k}" for k in range(12)])
    for name in CLASHING:
        docs = docs.withColumn(name, docs["doc_id"] * 10)
    for stage in (simhash.keep_one, mixing.mixed, lambda d: line_dedup.dedup(d).drop("n_lines", "n_dropped")):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == r["doc_id"] * 10 for r in rows for c in CLASHING)


def test_line_dedup_query_beside_its_sql(spark, tmp_path):
    line = "This line stands in many documents, more than forty letters"
    rows = [(k, f"{line}{'' if k % 2 else ' '}\nown {k}\n", "en", "s", 1) for k in range(9)] + [(20, None, "en", "s", 1), (21, "", "en", "s", 1)]
    folder = write_tables(tmp_path, rows)
    got = sbs.spark_rows(line_dedup.op2_line_dedup(spark, folder))
    assert sbs.differences(got, sbs.sql_rows(sbs.connect(folder), line_dedup.ORACLE)) is None
    kept = {r["doc_id"]: r["kept_sha256"] for r in line_dedup.op2_line_dedup(spark, folder).collect()}
    assert kept[3] == hashlib.sha256(b"own 3\n").hexdigest() and kept[20] == kept[21] == hashlib.sha256(b"").hexdigest()


def joins(df):
    return [x.strip(" +-:*()0123456789") for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "+- Join" not in x]


def test_exploded_fingerprints_are_not_broadcast(spark):
    # Files of a known, small size: Spark would take all 69 rows that are made of a fingerprint for one.
    prints = settle(spark.createDataFrame([(simhash._signed(p),) for p in near_prints(random.Random(6), 40, 2)], "fp long"), "test-prints")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10_000_000
    inner = [x for x in joins(simhash.links(prints)) if "Inner" in x]
    assert inner and all(x.startswith("SortMergeJoin") for x in inner)


def test_links_of_dense_groups_are_not_broadcast(spark, monkeypatch):
    from ledgerloom import session

    seen = []
    monkeypatch.setattr(session, "WATCHERS", [lambda df: seen.append(joins(df))])
    dense = settle(spark.createDataFrame(list(itertools.combinations(range(60), 2)), "a long, b long"), "test-links")
    assert {r["root"] for r in components(dense).collect()} == {0}
    found = [x for xs in seen for x in xs]
    assert found and all(x.startswith("SortMergeJoin") for x in found)


def test_the_near_dedup_stage_broadcasts_no_exploded_rows(spark, small, monkeypatch):
    import corpus_pipeline

    from ledgerloom import session

    seen = []
    monkeypatch.setattr(session, "WATCHERS", [lambda df: seen.append(joins(df))])
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert 0 < corpus_pipeline.drop_near_copies(spark, docs, small).count() < docs.count()
    inner = [x for xs in seen for x in xs if "Inner" in x]
    assert inner and all(x.startswith("SortMergeJoin") for x in inner)

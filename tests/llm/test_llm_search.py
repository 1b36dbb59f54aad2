"""Lexical search, token alignment and the n-gram join beside SQL and brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import side_by_side as sbs
from llm_tools import HARD, documents, hard, write_tables

from ledgerloom.llm import alignment, jaccard, lexical

ITEMS = "item_id long, text string"


def prose(seed, n, vocabulary=60, low=5, high=80):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["Über", "naïve", "日本"]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [" ".join(draw.choices(words, weights, k=draw.randrange(low, high))) for _ in range(n)]


# Lexical search


def ranked(docs, items, top=10):
    """The contract, read word by word."""
    counts = [(i, Counter(t.decode() for t in lexical.terms(x or ""))) for i, x in docs]
    counts = [(i, c) for i, c in counts if c]
    n, words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n // words
            score = sum(lexical.weight(n, df[t]) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in {t.decode() for t in lexical.terms(text or "")} if c[t])
            if score > 0:
                scores.append((-score, i))
        out[item] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:top])]
    return out


def found(frame):
    out = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r["item_id"], r["rank"])):
        out[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return out


def test_search_is_the_plain_ranking(spark):
    texts = prose(1, 400) + ["copy of one text w1 w2 w3"] * 15
    items = [(k, t) for k, t in enumerate(prose(2, 12, low=3, high=20))] + [(50, "copy of one TEXT"), (51, "absent zzz"), (52, ""), (53, None), (54, "w0")]
    docs = list(enumerate(texts))
    got = found(lexical.search(documents(spark, texts), spark.createDataFrame(items, ITEMS)))
    want = {k: v for k, v in ranked(docs, items).items() if v}
    assert got == want


def test_search_by_blocks_of_questions_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 16 * 60)
    texts = prose(3, 300)
    items = [(k, t) for k, t in enumerate(prose(4, 20, low=3, high=20))]
    got = found(lexical.search(documents(spark, texts), spark.createDataFrame(items, ITEMS), pairs=40, top=3))
    assert got == ranked(list(enumerate(texts)), items, 3)


def test_blocks_are_skipped_and_bounds_hold():
    texts = prose(5, 1500, vocabulary=200) + [f"w150 w151 w152 w153 w{k}" for k in range(30)]
    counts = [Counter(lexical.terms(t)) for t in texts]
    df = Counter(t for c in counts for t in c)
    order = sorted(df, key=lambda t: (df[t], t))
    place = {t: i for i, t in enumerate(order)}
    held = [sorted((place[t], k) for t, k in c.items()) for c in counts]
    sizes = np.array([len(h) for h in held])
    ranks, tf = (np.array([x[k] for h in held for x in h]) for k in (0, 1))
    words = sum(sum(c.values()) for c in counts)
    values = lexical.impacts(tf, np.repeat([sum(c.values()) for c in counts], sizes), len(texts), words)
    shard = lexical.Shard.unpack(lexical.Shard(np.arange(len(texts)), sizes, ranks, values, len(order)).block().pack(), len(order))
    for t, (docs, starts, summary) in shard.lists.items():
        assert sorted(docs) == [i for i, h in enumerate(held) if t in {x for x, _ in h}]
        if summary is not None:
            for b, (lo, hi) in enumerate(zip(starts[:-1], starts[1:])):
                assert (summary[b] * shard.steps[t:] >= shard.dense[docs[lo:hi], t:].max(0)).all()
    read = total = 0
    for question in prose(6, 30, vocabulary=200, low=4, high=15) + ["w150 w151 w152 w153"]:
        asked = np.array(sorted({place[t] for t in lexical.terms(question) if t in place}))
        weights = np.array([lexical.weight(len(texts), df[order[t]]) for t in asked])
        docs, scores, (some, every) = shard.search(asked, weights, 10, 0)
        full = shard.dense[:, asked].astype(np.int64) @ weights
        best = np.lexsort((np.arange(len(full)), -full))[:10]
        assert docs.tolist() == best[full[best] > 0].tolist() and scores.tolist() == full[best][full[best] > 0].tolist()
        # With a bar the same are found, as far as they reach it.
        above = shard.search(asked, weights, 10, int(scores[4]))[0]
        assert above.tolist() == docs[scores >= scores[4]].tolist()
        read, total = read + some, total + every
    assert read < total / 2


def test_search_bears_hard_rows(spark):
    docs = hard(spark)
    docs = docs.withColumn("item_id", docs["doc_id"])
    items = spark.createDataFrame([(1, "word"), (1, "another text"), (None, "word"), (2, "ünïcödé 中文"), (3, "many WORDS many")], ITEMS)
    for name in ("rank", "doc_id", "score", "term"):
        items = items.withColumn(name, items["text"])
    got = found(lexical.search(docs, items))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = ranked([r for r in rows], [(1, "word another text"), (2, "ünïcödé 中文"), (3, "many words")], top=100)
    for item in (1, 2, 3):
        assert [x[1:] for x in got[item]] == [x[1:] for x in want[item] if x[1] is not None][:10]
    assert None not in got
    empty = docs.limit(0)
    assert lexical.search(empty, items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []


def test_search_query_beside_its_sql(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = prose(7, 200) + HARD
    folder = write_tables(tmp_path, [(k, t, "en", "s", 1) for k, t in enumerate(texts)])
    items = [{"item_id": k, "text": t} for k, t in enumerate(prose(8, 15, low=3, high=30) + ["Über alles", None])]
    pq.write_table(pa.Table.from_pylist(items, schema=pa.schema([("item_id", pa.int64()), ("text", pa.string())])), f"{folder}/benchmark.parquet")
    got = sbs.spark_rows(lexical.op11_lexical_search(spark, folder))
    assert got[1] and sbs.differences(got, sbs.sql_rows(sbs.connect(folder), lexical.ORACLE)) is None


# Alignment


def plain_alignment(texts):
    """(n_a, n_b, groups, links as id pairs) of each text, from sets of ends."""
    import public_tokenizers
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(public_tokenizers.path(alignment.LEFT))
    left.encode_special_tokens = True
    one = alignment.Aligner(alignment.read(alignment.LEFT), alignment.read(alignment.RIGHT))
    out = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = one.b.ids(text) if text else []
        bytes_a, bytes_b = [one.a.tokens[i] for i in a], [one.b.tokens[i] for i in b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((0, 0, [], []))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends)))
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for low, high in zip([0, *common[:-1]], common):
            groups.append(tuple([i for i, (s, e) in zip(ids, span) if low <= s and e <= high] for ids, span in zip((a, b), spans)))
        links, at = [], 0
        for i, (s, e) in zip(a, spans[0]):
            while spans[1][at][1] <= s:
                at += 1
            k = at
            while k < len(b) and spans[1][k][0] < e:
                links.append((i, b[k]))
                k += 1
        out.append((len(a), len(b), groups, links))
    return out


ODD = ["<|endoftext|> and <s> </s> <unk>", "  two spaces  lead", "a\tb\r\nc", "x" * 700, "▁ is no space", "日本語 😀‍👩", "don't we'll 12345 67", " "]


@pytest.mark.parametrize("frequent", [0, 3, alignment.FREQUENT])
def test_alignment_is_that_of_sets_of_ends(spark, frequent):
    texts = prose(9, 40) + HARD[:6] + ODD + ["The same text twice, unforgettably."] * 5
    plain = plain_alignment(texts)
    counts = Counter(p for *_, links in plain for p in set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    rows = alignment.linked(documents(spark, texts), alignment.read(alignment.LEFT), alignment.read(alignment.RIGHT), keep=["doc_id"], frequent=frequent).collect()
    assert len(rows) == len(texts) and sum(n for n, *_ in plain) > 0
    for r in rows:
        n_a, n_b, groups, links = plain[r["doc_id"]]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        best = sum(counts[p] == most[p[0]] for p in links)
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"]) == (n_a, n_b, len(groups), len(links), text)
        assert (r["n_best"], r["count_sum"]) == (best, sum(counts[p] for p in links))


def test_walk_of_random_ends():
    draw = random.Random(11)
    for _ in range(300):
        total = draw.randrange(1, 200)
        ends = [np.array(sorted(set(draw.sample(range(1, total + 1), draw.randrange(0, total))) | {total})) for _ in range(2)]
        if draw.random() < 0.5:  # long stretches alike
            ends[1] = np.array(sorted(set(ends[0].tolist()) ^ set(draw.sample(range(1, total + 1), min(total, 2))) | {total}))
        runs, groups, left, right = alignment.walk(*ends)
        x, y = alignment.linked_places(runs, left, right)
        begins = [np.append(0, e[:-1]) for e in ends]
        want = {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if begins[0][i] < ends[1][j] and begins[1][j] < ends[0][i]}
        assert len(x) == len(want) and set(zip(x.tolist(), y.tolist())) == want
        assert len(groups) + sum(n for *_, n in runs) == len(set(ends[0].tolist()) & set(ends[1].tolist()))


def test_alignment_bears_hard_rows_and_its_query_digests(spark, tmp_path):
    left, right = alignment.read(alignment.LEFT), alignment.read(alignment.RIGHT)
    docs = hard(spark)
    for name in ("N_A", "groups", "pairs", "times", "best", "codes", "__row", "n_best", "pair"):
        docs = docs.withColumn(name, docs["lang"])
    out = alignment.linked(docs, left, right)
    assert out.count() == docs.count()
    assert {tuple(r) for r in out.filter("text IS NULL OR text = ''").select("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").collect()} == {(0, 0, 0, 0, "", 0, 0)}
    assert alignment.linked(docs.limit(0), left, right).collect() == []
    texts = prose(12, 6) + [None, ""]
    folder = write_tables(tmp_path, [(k, t, "en", "s", 1) for k, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in alignment.op12_alignment(spark, folder).collect()}
    whole = {r["doc_id"]: r["groups"] for r in alignment.linked(documents(spark, texts), left, right, keep=["doc_id"]).collect()}
    for k, t in enumerate(texts):
        assert got[k]["groups_sha256"] == (hashlib.sha256(whole[k].encode()).hexdigest() if t else "")


def test_a_vocabulary_out_of_order_is_refused():
    import json

    data = json.loads(alignment.read(alignment.LEFT))
    merges = data["model"]["merges"]
    merges[0], merges[500] = merges[500], merges[0]
    with pytest.raises(ValueError):
        alignment.ByteLevel(json.dumps(data).encode())


# N-gram join


def plain_join(docs, words=4, percent=85):
    """Sizes and components by comparing every pair of sets."""
    sets, up = {}, {}
    for k, (i, text) in enumerate(docs):
        w = (text or "").encode().lower().split()
        sets[k] = frozenset() if not w else frozenset([tuple(w)]) if len(w) < words else frozenset(zip(*[w[j:] for j in range(words)]))
        up[k] = k
    def root(k):
        while up[k] != k:
            k = up[k]
        return k
    keys = [k for k in sets if sets[k] and docs[k][0] is not None]
    for n, x in enumerate(keys):
        for y in keys[:n]:
            both = len(sets[x] & sets[y])
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                up[max(root(x), root(y))] = min(root(x), root(y))
    least = {}
    for k in keys:
        least[root(k)] = min(least.get(root(k), docs[k][0]), docs[k][0])
    return Counter((i, len(sets[k]), None if i is None else least[root(k)] if sets[k] else i) for k, (i, _) in enumerate(docs))


def near_copies(seed, groups=6, each=25):
    """Groups of texts with some words changed, so that pairs lie on both sides of the threshold, and a passage that many share."""
    draw = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = []
    for g in range(groups):
        base = [f"g{g}x{draw.randrange(400)}" for _ in range(draw.choice([30, 90, 200]))]
        for _ in range(each):
            words = list(base)
            for _ in range(draw.randrange(0, max(2, len(base) // 25))):
                words[draw.randrange(len(words))] = f"c{draw.randrange(10**6)}"
            if draw.random() < 0.1:
                words = words[: draw.randrange(len(words) // 2, len(words))]
            texts.append(" ".join(words) + (f" {passage}" if draw.random() < 0.3 else ""))
    texts += [f"{passage} {' '.join(f'q{draw.randrange(10**6)}' for _ in range(draw.choice([2, 3, 30])))}" for _ in range(40)]
    draw.shuffle(texts)
    return texts + texts[:5]


@pytest.mark.parametrize("options", [{}, {"frequent": 0}, {"tree": 3}, {"frequent": 0, "tree": 2, "percent": 70}])
def test_join_finds_the_components_of_all_links(spark, options):
    texts = near_copies(21 + len(options)) + ["three words only", "Three WORDS only", "two words", "one", "", None, " \n"]
    docs = [(100 + i, t) for i, t in enumerate(texts)]
    got = Counter(tuple(r) for r in jaccard.joined(documents(spark, texts, first=100), **options).collect())
    want = plain_join(docs, percent=options.get("percent", 85))
    assert got == want
    assert len({c for _, n, c in want if n}) < len(texts) - 20  # there are links


def test_trees_prune_and_keep_every_link():
    known = jaccard._Hashes()
    sets = list({jaccard.set_hash(s): s for s in (jaccard.shingles(t, known) for t in near_copies(31))}.values())
    links = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    one = jaccard.Tree(np.arange(len(sets)), sets)
    pairs = {(int(max(one.keys[i], one.keys[j])), int(min(one.keys[i], one.keys[j]))) for i, j in jaccard.survivors(one, one)[0]}
    assert links <= pairs and len(pairs) < len(sets) * (len(sets) - 1) / 4
    half = len(sets) // 2
    a, b = jaccard.Tree(np.arange(half), sets[:half]), jaccard.Tree(np.arange(half, len(sets)), sets[half:])
    across = {(int(b.keys[j]), int(a.keys[i])) for i, j in jaccard.survivors(a, b)[0]}
    assert {(i, j) for i, j in links if j < half <= i} <= across
    packed = jaccard.Tree.unpack(a.pack())
    assert packed.keys.tolist() == a.keys.tolist() and all((x == y).all() for x, y in zip(packed.sets, a.sets))
    # Signatures of different widths say the same or leave more.
    for x, y in [(sets[i], sets[j]) for i, j in sorted(links)[:50]]:
        sign = [jaccard.Signatures(np.array([k]), np.array([len(s)]), jaccard.bitmap(s, p)[None, :]) for k, (s, p) in enumerate(((x, 10), (y, 8)))]
        assert len(jaccard.survivors(*sign)[0]) == 1


def test_trees_meet_only_where_sizes_and_places_allow(spark, monkeypatch):
    kept, freed, settle = {}, [], jaccard.settle

    def seen(df, name, *rest):
        freed.append(spark.conf.get(jaccard.CLEANUP, "false"))
        kept.setdefault(name, []).append(settle(df, name, *rest))
        return kept[name][-1]

    monkeypatch.setattr(jaccard, "settle", seen)
    before = spark.conf.get(jaccard.CLEANUP, "false")
    # One passage in texts of many sizes: nearly all of them share hashes, few could be alike.
    draw, passage = random.Random(9), " ".join(f"p{k}" for k in range(30))
    texts = [f"{passage} {' '.join(f'q{draw.randrange(10**6)}' for _ in range(1 + 2 * k))}" for k in range(60)]
    got = Counter(tuple(r) for r in jaccard.joined(documents(spark, texts), frequent=0, tree=1).collect())
    assert got == plain_join(list(enumerate(texts)))
    sizes = {}
    for r in kept["placed"][0].collect():
        sizes.setdefault(r["tree"], []).append(r["n"])
    pairs = {(r["t1"], r["t2"]) for name in ("next-trees", "open-pairs") for df in kept[name] for r in df.collect()}
    assert pairs
    assert all(100 * max(sizes[x]) >= 85 * min(sizes[y]) and 100 * max(sizes[y]) >= 85 * min(sizes[x]) for x, y in pairs)
    # Shuffle files go with each query, and the session is left as it was.
    assert set(freed) == {"true"} and spark.conf.get(jaccard.CLEANUP, "false") == before == "false"


def test_the_first_common_hash_decides_who_may_meet(spark):
    rows = [(100, 100, 100, 90, 90, 90), (100, 100, 93, 100, 100, 95), (100, 100, 91, 100, 100, 100), (100, 100, 100, 80, 80, 80), (60, 100, 95, 80, 130, 90)]
    frame = spark.createDataFrame(rows, "small1 int, large1 int, reach1 int, small2 int, large2 int, reach2 int")
    assert [r[0] for r in frame.select(jaccard.may_meet(85)).collect()] == [True, True, False, False, True]
    listed = spark.createDataFrame([(1, 7, 50, 50, 50), (1, 3, 52, 52, 51), (1, 9, 90, 90, 90), (2, 7, 50, 50, 44), (2, 5, 50, 50, 49)], "hash long, tree long, small long, large long, reach long")
    assert [tuple(r) for r in jaccard._neighbours(listed, 85).collect()] == [(3, 7)]


def test_join_bears_hard_rows(spark):
    docs = hard(spark)
    for name in ("n_shingles", "__node", "hash", "tree", "node", "home", "power"):
        docs = docs.withColumn(name, docs["lang"])
    got = Counter(tuple(r) for r in jaccard.joined(docs).collect())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got == plain_join(rows)
    assert jaccard.joined(docs.limit(0)).collect() == []


def test_join_query_of_a_table(spark, tmp_path):
    texts = near_copies(41, groups=2)
    folder = write_tables(tmp_path, [(k, t, "en", "s", 1) for k, t in enumerate(texts)])
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.op13_ngram_jaccard(spark, folder).collect())
    assert got == plain_join(list(enumerate(texts)))



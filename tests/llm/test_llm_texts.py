"""Personal data, quality, toxicity, language and language models on small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tools import HARD, WORD, documents, hard

from ledgerloom.llm import common, language, lm_scoring, pii, quality, toxicity

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHORS = pii.anchors()


def plain_luhn(digits):
    odd = digits[::-1][::2]
    even = digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (EMAIL, lambda s: True),
        "ip": (IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (CARD, lambda s: 13 <= len(digits(s)) <= 19 and plain_luhn(digits(s))),
        "phone": (PHONE, lambda s: 9 <= len(digits(s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, good) in rules.items() for m in p.finditer(text) if good(m[0])]


def base_spans(text):
    return [s for s in pii.spans(text, ANCHORS) if s[0] in pii.BASE]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.-+ 0123456789()_%é\n:/w", max_size=80))
def test_base_spans_are_those_of_the_patterns(text):
    assert base_spans(text) == plain_spans(text)


def test_base_spans_of_dense_texts():
    rng = random.Random(4)
    parts = ["a@b.co", "x.y@q-r.de.", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+12", "+", "@", "..", "é", "0", "12345678901234567890", "1.2.3.4.5.6.7.8", "@a.b@c.d", "00001.2.3.4"]
    for _ in range(1000):
        text = "".join(rng.choice(parts + [" ", ""]) for _ in range(rng.randint(1, 9)))
        assert base_spans(text) == plain_spans(text)
    for text in ("1" * 50_000, "1." * 20_000, "a" * 50_000 + "@", "@" * 20_000, "+1" * 20_000, "1 " * 20_000, "a@b." * 10_000):
        assert base_spans(text) == plain_spans(text)


def test_added_spans():
    text = "see https://example.org/a?b=1, IBAN: GB82 WEST 1234 5698 7654 32. account no: 1234-5678-90 Password=abc12345 token = \"0f0f0f0f0f\" IBAN GB82WEST12345698765433"
    found = {(k, text[a:b]) for k, a, b in pii.spans(text, ANCHORS) if k in pii.ADDED}
    assert found == {("url", "https://example.org/a?b=1"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("account", "1234-5678-90"), ("secret", "abc12345"), ("secret", "0f0f0f0f0f")}
    assert [s for s in pii.spans("clean words without anything; account of a token", ANCHORS)] == []


def test_personal_data_of_hard_rows(spark, small):
    docs = hard(spark)
    found = pii.find(docs).collect()
    assert len(found) == docs.count() and all(r["spans"] == [] for r in found)
    masked = pii.masked(documents(spark, ["mail a@b.co or +1 212 555 0100", None, ""])).collect()
    assert [r["text"] for r in masked] == ["mail <email> or <phone>", None, ""]
    rows = pii.op7_pii(spark, small).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in rows:
        want = Counter(k for k, _, _ in plain_spans(texts[r["doc_id"]]))
        assert tuple(r[f"n_{k}"] for k in pii.BASE) == tuple(want[k] for k in pii.BASE)


def plain_statistics(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)]


def test_statistics_by_definition():
    rng = random.Random(9)
    texts = [t or "" for t in HARD if t is None or len(t) < 40_000] + ["".join(rng.choice("ab é\n\t#|x ") for _ in range(rng.randint(0, 300))) for _ in range(400)]
    for t in texts:
        assert quality.statistics(t)[:5] == plain_statistics(t)


def test_trees_are_monotonic_and_flat_scores_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 2] < 0.4) ^ (rng.random(3000) < 0.1)).astype(float)
    trees = quality.grow(x, y, list(quality.FEATURES.values()))
    assert ((trees.score(x) > 0.5) == (x[:, 2] < 0.4)).mean() > 0.97
    for f, direction in enumerate(quality.FEATURES.values()):
        if direction:
            grid = np.repeat(x[:50], 40, 0)
            grid[:, f] = np.tile(np.linspace(-0.1, 1.1, 40), 50)
            steps = np.diff(trees.score(grid).reshape(50, 40), axis=1) * direction
            assert (steps >= -1e-12).all()
    for row in x[:20]:
        total = trees.bias
        for at in trees.roots:
            while trees.feature[at] >= 0:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        assert abs(trees.score(row[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12
    assert quality.grow(x[:0], y[:0], list(quality.FEATURES.values())).score(x[:3]).min() > 0.9


def test_quality_of_hard_rows_and_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in quality.op5_quality(spark, folder).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2 and not rows[i]["base_failed"]]
    assert sum((rows[i]["score"] >= 0.5) == (labels[i] == 1) for i in out) >= 0.97 * len(out)
    docs = hard(spark)
    found = quality.measured(docs)
    none = spark.createDataFrame([(None, None), (3, None), (5, 1)], "doc_id long, quality int")
    judged = quality.judged(found, quality.fit(found, none)).collect()
    assert len(judged) == docs.count()
    assert all(r["base_failed"] and not r["kept"] for r in judged if r["n_words"] < 50)
    assert quality.measured(docs.limit(0)).collect() == []


def accuracy(rows, labels):
    y = np.array([labels[r["doc_id"]] == 1 for r in rows])
    p = np.array([r["predicted"] == 1 for r in rows])
    return (p & y).sum() / max(1, p.sum()), (p & y).sum() / max(1, y.sum())


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = toxicity.op6_toxicity(spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows[:500])
    precision, recall = accuracy([r for r in rows if r["held_out"] and r["doc_id"] in labels], labels)
    assert precision >= 0.8 and recall >= 0.75


def test_misspellings_share_ngrams_and_hard_texts_get_a_score(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(20)) for _ in range(150)]
    toxic = [t + " " + rng.choice(["disgusting", "worthless", "pathetic"]) for t in clean[:70]]
    model = toxicity.train(clean + toxic, [0] * 150 + [1] * 70, 0.3)
    score = toxicity.scorer(model)
    assert score("alpha beta disgustin gamma delta") > 0.5 > score("alpha beta gamma delta")
    assert score("alpha worthles") > 0.5
    for label in (0, 1):
        assert (toxicity.scorer(toxicity.train(clean, [label] * 150))("alpha") > 0.5) == bool(label)
    assert toxicity.scorer(toxicity.train([], []))("x") < 0.5
    docs = hard(spark)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)


def test_language_of_held_out_documents_and_hard_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = common.table(spark, folder, "documents")
    filters = language.fit(docs)
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in language.identify(docs.select("doc_id", "text"), filters).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(langs[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    found = language.identify(hard(spark), filters).collect()
    assert {r["lang_pred"] for r in found if not any(map(str.isalpha, r["text"] or ""))} == {"und"}
    assert all(r["lang_pred"] in filters.languages for r in found if any(map(str.isalpha, r["text"] or "")))
    assert all(0 <= r["score"] <= 1 for r in found)
    assert language.predict("word", language.train([], [])) == ("und", 0.0)


def test_filters_hold_every_learned_ngram_and_many_languages():
    names = [f"l{i:03}" for i in range(70)]
    rng = random.Random(6)
    words = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(6)] for n in names}
    filters = language.train([" ".join(words[n] * 5) for n in names], names)
    assert all(language.predict(" ".join(words[n][:4]), filters)[0] == n for n in names)
    text = " ".join(words["l069"])
    total = language.counted(text, filters)
    assert total[69] > 0.9 * sum(max(0, len(language.letters(text)) - n + 1) for n in language.NGRAMS) > 3 * total[3]


def test_language_models_by_dictionaries(spark, monkeypatch):
    texts = ["the cat sat on the mat", "the cat ran", "", None, "a dog ran on", "mat mat mat cat"]
    docs = documents(spark, texts)
    models = lm_scoring.fit(docs, spark.createDataFrame([(0,), (1,), (1,), (None,)], "doc_id long"))
    known = lm_scoring._Classes()
    ids = [lm_scoring.classes(t or "", known) for t in texts]
    alone = Counter(int(i) for x in ids for i in x)
    both = Counter(int(p) for x in ids for p in lm_scoring.pairs(x[:-1], x[1:]))
    target = Counter(int(i) for x in ids[:2] for i in x)
    target_pairs = Counter(int(p) for x in ids[:2] for p in lm_scoring.pairs(x[:-1], x[1:]))
    scale = sum(target.values()) / sum(alone.values())
    assert all(abs(models.words[1][k] - n * scale) < 1e-5 for k, n in alone.items())

    def loss(x, words, pairs, factor):
        total, every = 0.0, sum(words.values())
        for k, w in enumerate(x):
            p = (1 - lm_scoring.FLOOR) * words[int(w)] / every + lm_scoring.FLOOR / lm_scoring.WORDS
            if k:
                seen = words[int(x[k - 1])] * factor
                n = min(pairs[int(lm_scoring.pairs(x[k - 1 : k], x[k : k + 1])[0])] * factor, seen)
                p = (n + lm_scoring.TRUST * p) / (seen + lm_scoring.TRUST)
            total -= np.log(p)
        return total / len(x)

    for r in lm_scoring.score(docs, models).collect():
        x = ids[r["doc_id"]]
        want = loss(x, target, target_pairs, 1) - loss(x, alone, both, scale) if len(x) else 0.0
        assert abs(r["score"] - want) < 1e-4 and r["n_words"] == len(x)
    found = lm_scoring.score(hard(spark), models).collect()
    assert all(np.isfinite(r["score"]) for r in found)
    assert np.isfinite([r["score"] for r in lm_scoring.score(docs, lm_scoring.fit(docs, docs.limit(0))).collect()]).all()
    assert lm_scoring.score(docs.limit(0), models).collect() == []


def plain_scores(texts, target):
    """Scores from dictionaries of real words and pairs of them."""
    words = [re.findall(WORD, (t or "").translate(LOW)) for t in texts]
    counts = [(Counter(w for x in held for w in x), Counter(p for x in held for p in zip(x, x[1:]))) for held in ([words[i] for i in target], words)]
    every = [sum(c[0].values()) for c in counts]
    factors = [1.0, every[0] / every[1]]
    found = []
    for x in words:
        total = [0.0, 0.0]
        for k, w in enumerate(x):
            for m, ((alone, both), factor) in enumerate(zip(counts, factors)):
                p = (1 - lm_scoring.FLOOR) * alone[w] / every[m] + lm_scoring.FLOOR / lm_scoring.WORDS
                if k:
                    p = (both[x[k - 1], w] * factor + lm_scoring.TRUST * p) / (alone[x[k - 1]] * factor + lm_scoring.TRUST)
                total[m] -= np.log(p)
        found.append((len(x), (total[0] - total[1]) / len(x) if x else 0.0))
    return found


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_language_models_count_every_word_and_pair_for_itself(spark):
    # Among 40,000 words thousands share one of 2^18 classes.
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(40_000)}" if rng.random() < 0.7 else rng.choice(["the", "The", "of"]) for _ in range(rng.randrange(400))) for _ in range(120)]
    texts += ["", None, "the", "only", "the of " * 500] + texts[:3]
    docs = documents(spark, texts)
    target = [i for i in range(len(texts)) if i % 3 == 0]
    want = plain_scores(texts, target)
    wanted = spark.createDataFrame([(i,) for i in target], "doc_id long")
    for frequent, held in (((1 << 16, 1 << 17), 2_000_000), ((3, 2), 3_000), ((0, 0), 5_000)):
        models = lm_scoring.fit(docs, wanted, frequent=frequent)
        for frame in (models.docs, docs):
            found = lm_scoring.score(frame, models, held=held, keep=["doc_id"]).collect()
            assert sorted(r["doc_id"] for r in found) == list(range(len(texts)))
            assert all(r["n_words"] == want[r["doc_id"]][0] and abs(r["score"] - want[r["doc_id"]][1]) < 1e-9 for r in found)


def test_language_models_make_one_sum_a_document(spark, monkeypatch):
    # One sum a document and part would be some 2,400 rows here, and grow with the square of the corpus.
    rng = random.Random(9)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 30_000}" for _ in range(150)) for _ in range(400)]
    docs = documents(spark, texts)
    target = list(range(0, 400, 5))
    models = lm_scoring.fit(docs, spark.createDataFrame([(i,) for i in target], "doc_id long"), frequent=(50, 50))
    plain, made = type(docs).mapInArrow, []

    def noted(self, run, schema, *rest):
        rows = spark.sparkContext.accumulator(0)
        made.append(rows)

        def kept(batches):
            for b in run(batches):
                rows.add(b.num_rows)
                yield b

        return plain(self, kept, schema, *rest)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    found = lm_scoring.score(models.docs, models, held=10_000, keep=["doc_id"]).collect()
    want = plain_scores(texts, target)
    assert len(found) == 400 and all(abs(r["score"] - want[r["doc_id"]][1]) < 1e-9 for r in found)
    assert made and all(0 < rows.value <= 400 for rows in made)


def test_packed_numbers_come_back():
    for numbers in ([], [0], [0, 255, 256, 7], [1 << 40, 3], list(range(70_000))):
        data = lm_scoring._packed(np.array(numbers, np.int64))
        assert lm_scoring._unpacked(data).tolist() == numbers and len(data) <= 1 + 8 * len(numbers)


def test_long_secrets_are_covered_to_their_end(spark):
    long = "eyJhbGciOi" + "Ab9_-." * 400
    text = f"token: {long} and more"
    assert [s for s in pii.spans(text, ANCHORS) if s[0] == "secret"] == [("secret", 7, 7 + len(long))]
    assert pii.masked(documents(spark, [text])).first()["text"] == "token: <secret> and more"


def test_scores_do_not_depend_on_the_number_of_cores(spark, tmp_path):
    draw = random.Random(3)
    texts = [" ".join(draw.choices([f"w{k}" for k in range(50)], k=draw.randrange(5, 60))) for _ in range(120)]
    documents(spark, texts).repartition(6).write.parquet(str(tmp_path / "docs"))
    wanted = spark.createDataFrame([(k,) for k in range(0, 120, 7)], "doc_id long")
    scores = []
    for fitting, scoring in ((4, 40), (40, 2)):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", fitting)
        docs = spark.read.parquet(str(tmp_path / "docs"))
        models = lm_scoring.fit(docs, wanted)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", scoring)
        scores.append({r["doc_id"]: r["score"] for r in lm_scoring.score(models.docs, models, keep=["doc_id"]).collect()})
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert scores[0].keys() == set(range(120)) and all(abs(scores[0][k] - scores[1][k]) < 1e-9 for k in scores[0])

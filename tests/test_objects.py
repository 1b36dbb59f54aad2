import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import objects as O

OBJECT = "block long, idx int, hash string, hashing int, size long, family string, claimed boolean, expiry long"


def brute_runs(rows):
    """Walk the whole order once, as the definition says."""
    out, run = [], []
    for block, idx, digest, hashing, size, family, claimed, expiry in sorted(rows):
        near = run and hashing == run[0][1] and block - run[-1][0] <= O.MAX_GAP
        if claimed:
            run = []
        elif family == "dag":
            if near:
                out.append((block, len(run) + 1, size + sum(r[2] for r in run), min([expiry, *[r[3] for r in run]])))
            run = []
        elif family != "leaf":
            run = []
        else:
            if not near:
                run = []
            run.append((block, hashing, size, expiry))
    return sorted(out)


@pytest.mark.parametrize("seed,width", [(1, 10), (2, 64), (3, 1000), (4, 1)])
def test_runs_equal_a_single_walk(spark, seed, width):
    rng = random.Random(seed)
    rows, block = [], 0
    for i in range(300):
        block += rng.choice([0, 1, 2, 5, 70])
        rows.append((block, i, f"h{i}", rng.choice([1, 1, 1, 2]), rng.randint(1, 9), rng.choice(["leaf"] * 5 + ["dag", "standalone"]), rng.random() < 0.05, rng.randint(1, 999)))
    got = O.adjacent_runs(spark.createDataFrame(rows, OBJECT), width).collect()
    assert sorted((r.manifest_block, r.pieces, r.total_bytes, r.expiry) for r in got) == brute_runs(rows)


def test_manifest_groups(spark):
    objects = spark.createDataFrame(
        [("r", 1, 0, 5, 100, "dag"), ("m", 2, 0, 3, 90, "dag"), ("x", 3, 0, 2, 50, "leaf"), ("x", 4, 0, 2, 80, "leaf"), ("y", 5, 0, 1, 70, "leaf"), ("lone", 6, 0, 9, 9, "leaf"), ("unread", 7, 0, 9, 9, "dag")],
        "hash string, block long, idx int, size long, expiry long, family string",
    )
    links = spark.createDataFrame([("r", "m"), ("r", "gone"), ("m", "x"), ("m", "y"), ("x", "m"), ("gone", "hidden")], "parent string, child string")
    row = O.manifest_groups(objects, links).collect()
    assert len(row) == 1
    group = row[0]
    # The piece with two copies lives to 80, so y at 70 goes first; what hangs under a missing piece is not reached.
    assert (group.root, group.pieces, group.missing, group.members) == ("r", 5, 1, 3)
    assert (group.total_bytes, group.stored_bytes, group.expiry) == (11, 13, 70)
    roles = {r.hash: r.role for r in O.manifest_roles(objects, links).collect()}
    assert roles == {"r": "dag-root", "m": "dag-inner", "x": "dag-inner", "y": "leaf", "lone": "standalone", "unread": "dag-unread"}


def brute_groups(stored, links):
    """One walk a root, as the definition says."""
    down, copies = {}, {}
    for a, b in links:
        down.setdefault(a, set()).add(b)
    for h, block, idx, size, expiry, _ in stored:
        copies.setdefault(h, []).append((block, idx, size, expiry))
    out = {}
    for root in [h for h in copies if h in down and not any(b == h for _, b in links)]:
        seen, todo = {root}, [root]
        while todo:
            node = todo.pop()
            if node in copies:
                new = down.get(node, set()) - seen
                seen |= new
                todo += new
        have = [copies[n] for n in seen if n in copies]
        if len(have) > 1:
            size, held = sum(max(c)[2] for c in have), sum(x[2] for c in have for x in c)
            out[root] = (len(seen), len(seen) - len(have), len(have) - 1, size, held, min(max(x[3] for x in c) for c in have))
    return out


def groups(spark, stored, links):
    frame = spark.createDataFrame(stored, "hash string, block long, idx int, size long, expiry long, family string")
    rows = O.manifest_groups(frame, spark.createDataFrame(links, "parent string, child string")).collect()
    return {r.root: (r.pieces, r.missing, r.members, r.total_bytes, r.stored_bytes, r.expiry) for r in rows}


@pytest.mark.parametrize("seed,more", [(1, 0), (2, 12), (3, 60), (4, 200)])
def test_groups_of_random_graphs_equal_one_walk_a_root(spark, seed, more):
    rng = random.Random(seed)
    n = 90
    links = [(f"n{rng.randrange(i)}", f"n{i}") for i in range(6, n)] + [(f"n{rng.randrange(n)}", f"n{rng.randrange(6, n)}") for _ in range(more)]
    links += [("lost1", "lost2"), ("lost2", "lost1"), ("n80", "n80")] + links[:5]
    stored = [(f"n{i}", i, 0, rng.randint(1, 9), rng.randint(1, 999), "leaf") for i in range(n) if i < 6 or rng.random() < 0.9]
    stored += [(h, b + 1, 1, rng.randint(1, 9), rng.randint(1, 999), f) for h, b, _, _, _, f in stored if rng.random() < 0.2]
    stored += [("lost1", 500, 0, 1, 1, "dag"), ("lost2", 501, 0, 1, 1, "dag")]
    want = brute_groups(stored, links)
    assert want and groups(spark, stored, links) == want
    claimed = O.claimed_pieces(spark.createDataFrame([(r,) for r in want], "root string"), spark.createDataFrame(links, "parent string, child string"), spark.createDataFrame(stored, "hash string, block long, idx int, size long, expiry long, family string"))
    found = [r[0] for r in claimed.collect()]
    assert len(found) == len(set(found)) and len(found) >= max(w[0] for w in want.values())


def test_a_deep_tree_is_folded_in_few_rounds_and_few_rows(spark, monkeypatch):
    written, settle = [], O.settle

    def watched(df, name, *by):
        out = settle(df, name, *by)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(O, "settle", watched)
    n = 600
    stored = [(f"n{i}", i, 0, 1, 1000 - i, "dag") for i in range(n)]
    assert groups(spark, stored, [(f"n{i}", f"n{i + 1}") for i in range(n - 1)]) == {"n0": (n, 0, n - 1, n, n, 1001 - n)}
    assert sum(name == "ups" for name, _ in written) <= 24
    # The walk from the root has nothing to do: the whole chain is one tree.
    assert sum(rows for name, rows in written if name == "reach") == 1


def record(size, kind=0):
    le = lambda v, n: v.to_bytes(n, "little").hex()
    return "11" * 32 + "22" * 32 + "12" + le(0x55, 8) + le(size, 4) + le(1, 4) + le(2, 4) + f"{kind:02x}"


@pytest.mark.parametrize("count,prefix", [(3, "0c"), (70, (70 << 2 | 1).to_bytes(2, "little").hex()), (2, (2 << 2 | 2).to_bytes(4, "little").hex()), (1, "03" + (1).to_bytes(4, "little").hex())])
def test_packed_vectors(spark, count, prefix):
    sizes = [1000 + i * 66_000 for i in range(count)]
    packed = "0x" + prefix + "".join(record(s) for s in sizes)
    frame = spark.createDataFrame([(1, packed), (2, packed[:-4]), (3, "0x"), (4, "0x00")], "block long, packed string")
    rows = O.explode_records(frame, "packed").collect()
    assert sorted(r.size for r in rows if r.block == 1) == sizes
    assert sorted(r.size for r in rows if r.block == 2) == sizes[:-1]
    assert {r.block for r in rows} <= {1, 2}
    assert all((r.hashing, r.codec, r.extrinsic, r.block_chunks) == (0x12, 0x55, 1, 2) for r in rows)


def test_shapes_take_the_first_rule(spark):
    rows = [(O.DAG, O.SHA2, 262144), (O.RAW, O.SHA2, 262144), (O.RAW, O.SHA2, 131072), (O.RAW, O.SHA2, 5), (O.RAW, O.BLAKE2, 4096), (O.RAW, O.BLAKE2, 4097), (1, O.SHA2, 5)]
    out = O.with_shape(spark.createDataFrame(rows, "codec int, hashing int, size long")).collect()
    assert [r["shape"] for r in out] == ["dag-node", "leaf-256k", "bundle-piece", "deploy-file", "app-record", "app-blob", "unknown"]
    assert [r.family for r in out] == ["dag", "leaf", "leaf", "leaf", "standalone", "standalone", "unknown"]


def test_duplicate_bytes_and_empty_buckets(spark):
    frame = spark.createDataFrame([("a", 1, 10), ("a", 2, 10), ("a", 3, 10), ("b", 4, 5000)], "hash string, block long, size long")
    row = O.duplication(frame).collect()[0]
    assert (row.distinct_content, row.repeated_content, row.duplicate_bytes, row.max_copies) == (2, 1, 20, 3)
    buckets = O.size_histogram(frame).orderBy("bucket").collect()
    assert [r.objects for r in buckets] == [3, 0, 1, 0, 0, 0, 0]
    assert F is not None

"""Stored objects: packed records, rollups, duplication, adjacent runs, manifest groups, leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.ordered import in_stretches, previous_in_order, running_max
from ..session import settle
from .ranking import with_totals

# A record is 86 bytes; content codecs and hash functions by number.
RECORD_DIGITS = 172
RAW, DAG = 0x55, 0x70
SHA2, BLAKE2 = 0x12, 0xB220
MAX_GAP = 64

# Upper edges of the size histogram, the last bucket is open.
SIZE_BUCKETS = [
    ("< 1 KiB", 1024),
    ("1–4 KiB", 4096),
    ("4–16 KiB", 16384),
    ("16–64 KiB", 65536),
    ("64–256 KiB", 262144),
    ("256 KiB–1 MiB", 1048576),
    ("≥ 1 MiB", None),
]

# Shape rules in order (name, family, certain, precision).
SHAPES = [
    ("dag-node", "dag", True, 1.0),
    ("leaf-256k", "leaf", True, 1.0),
    ("car-section", "leaf", True, 1.0),
    ("leaf-max", "leaf", True, 1.0),
    ("bundle-piece", "leaf", False, 0.966),
    ("deploy-file", "leaf", False, 0.994),
    ("app-record", "standalone", False, 0.932),
    ("app-blob", "standalone", False, 0.983),
    ("unknown", "unknown", False, None),
]


def _vector(packed: str) -> tuple[Column, Column, Column, Column]:
    """Of a packed vector: its digits, where records begin, how many are announced and how many are there whole."""
    h = F.regexp_replace(F.col(packed), "^0x", "")
    mode = F.conv(F.substring(h, 1, 2), 16, 10).cast("int").bitwiseAND(3)
    le = lambda start, digits: S.hex_uint_le(F.substring(h, start, digits))
    big = F.shiftright(F.conv(F.substring(h, 1, 2), 16, 10).cast("int"), 2) + 4
    count = (
        F.when(mode == 0, F.shiftright(le(1, 2), 2))
        .when(mode == 1, F.shiftright(le(1, 4), 2))
        .when(mode == 2, F.shiftright(le(1, 8), 2))
        .otherwise(S.hex_uint_le(F.substr(h, F.lit(3), big * 2)))
    )
    start = F.when(mode == 0, 2).when(mode == 1, 4).when(mode == 2, 8).otherwise(big * 2 + 2)
    room = F.floor((F.length(h) - start) / RECORD_DIGITS).cast("bigint")
    whole = F.least(count, room)
    return h, start, count, whole


def record_quality(blocks: DataFrame, packed: str) -> DataFrame:
    """The columns of blocks with `announced` and `cut_off`: records that the vector's length promises, and those that it has no room for."""
    h, _, count, whole = _vector(packed)
    kept = [c for c in blocks.columns if c != packed]
    filled = F.length(h) > 0
    return blocks.select(
        *kept,
        F.coalesce(F.when(filled, count.cast("bigint")), F.lit(0)).alias("announced"),
        F.coalesce(F.when(filled, (count - F.greatest(whole, F.lit(0))).cast("bigint")), F.lit(0)).alias("cut_off"),
    )


def explode_records(blocks: DataFrame, packed: str) -> DataFrame:
    """Packed vectors to one row per record: a compact length, then fixed-width little-endian fields.

    A record cut off at the end of its vector is left out; `record_quality` counts those.
    """
    h, start, _, whole = _vector(packed)
    kept = [c for c in blocks.columns if c != packed]
    rows = (
        blocks.filter(F.length(h) > 0)
        .select(*kept, h.alias("__h"), start.alias("__start"), whole.alias("__n"))
        .filter("__n > 0")
        .select(*kept, "__h", "__start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)).alias("idx"))
        .select(*kept, "idx", F.substr("__h", (F.col("__start") + F.col("idx") * RECORD_DIGITS + 1).cast("int"), F.lit(RECORD_DIGITS)).alias("__r"))
    )
    text = lambda at, digits: F.substring("__r", at, digits)
    return rows.select(
        *kept,
        "idx",
        text(1, 64).alias("chunk_root"),
        text(65, 64).alias("content_hash"),
        S.hex_uint(text(129, 2)).alias("hashing"),
        S.hex_uint_le(text(131, 16)).alias("codec"),
        S.hex_uint_le(text(147, 8)).alias("size"),
        S.hex_uint_le(text(155, 8)).alias("extrinsic"),
        S.hex_uint_le(text(163, 8)).alias("block_chunks"),
        S.hex_uint(text(171, 2)).alias("kind"),
    )


def with_shape(objects: DataFrame, sha2: int = SHA2, blake2: int = BLAKE2) -> DataFrame:
    """The first shape rule each object meets, with its family and how sure the rule is."""
    codec, hashing, size = F.col("codec"), F.col("hashing"), F.col("size")
    raw = codec == RAW
    tests = [
        codec == DAG,
        raw & (size == 262144),
        raw & (size == 262183),
        raw & (size == 2097152),
        raw & (hashing == sha2) & (size >= 131072),
        raw & (hashing == sha2),
        raw & (hashing == blake2) & (size <= 4096),
        raw & (hashing == blake2),
    ]
    shape = S.first_rule(list(zip(tests, [name for name, *_ in SHAPES])), SHAPES[-1][0])
    by_name = lambda i: F.coalesce(*[F.when(F.col("shape") == s[0], F.lit(s[i])) for s in SHAPES])
    return (
        objects.withColumn("shape", shape)
        .withColumn("family", by_name(1))
        .withColumn("certain", by_name(2))
        .withColumn("precision", by_name(3))
    )


def rollups(objects: DataFrame, facets: list[str]) -> DataFrame:
    """Objects, bytes, mean and largest object per value of each facet, and over all (facet 'all')."""
    pairs = [F.struct(F.lit("all").alias("facet"), F.lit("").alias("value"))] + [
        F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facets
    ]
    rows = objects.select("block", "size", F.explode(F.array(*pairs)).alias("p"))
    # One number that orders by size and then by the earlier block: a struct would force a sort.
    largest = F.col("size").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") - F.col("block")
    return rows.groupBy("p.facet", "p.value").agg(
        F.count(F.lit(1)).alias("objects"),
        F.sum("size").alias("bytes"),
        (F.sum("size") / F.count(F.lit(1))).alias("mean_size"),
        F.max("size").alias("largest"),
        F.max_by("block", largest).alias("largest_block"),
    )


def per_day(objects: DataFrame, times: DataFrame, facet: str) -> DataFrame:
    """Objects, bytes and the largest object by day and value of a facet. times(block, day), one row a block."""
    return objects.join(times, "block", "left").groupBy("day", facet).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("size").cast("bigint").alias("bytes"), F.max("size").alias("largest")
    )


def duplication(objects: DataFrame) -> DataFrame:
    """Distinct contents, repeated ones, the bytes the repeats hold, and most copies of one content."""
    per_hash = objects.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min_by("size", "block").alias("size"))
    more = F.col("copies") > 1
    return per_hash.agg(
        F.count(F.lit(1)).alias("distinct_content"),
        F.count_if(more).alias("repeated_content"),
        F.coalesce(F.sum(F.when(more, F.col("size") * (F.col("copies") - 1))), F.lit(0)).alias("duplicate_bytes"),
        F.coalesce(F.max("copies"), F.lit(0)).alias("max_copies"),
    )


def size_histogram(objects: DataFrame) -> DataFrame:
    """Objects and bytes per size bucket, empty buckets included."""
    bucket = F.lit(len(SIZE_BUCKETS) - 1)
    for number, (_, edge) in reversed(list(enumerate(SIZE_BUCKETS[:-1]))):
        bucket = F.when(F.col("size") < edge, number).otherwise(bucket)
    counts = objects.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))
    labels = objects.sparkSession.createDataFrame(
        [(number, label) for number, (label, _) in enumerate(SIZE_BUCKETS)], "bucket int, label string"
    )
    return labels.join(counts, "bucket", "left").fillna({"objects": 0, "bytes": 0})


def adjacent_runs(objects: DataFrame, width: int | None = None) -> DataFrame:
    """Leaves written next to each other and closed by a manifest of the same producer, as guessed uploads.

    objects(block, idx, hash, hashing, size, family, claimed, expiry). The order is the whole chain's: it is
    cut into stretches, of `width` blocks or else of equal numbers of rows, and only one row per stretch is looked at together.
    """
    order = ["block", "idx"]
    rows = objects.withColumn(
        "kind",
        F.when(F.col("claimed"), "other").when(F.col("family") == "dag", "dag").when(F.col("family") == "leaf", "leaf").otherwise("other"),
    )
    if width is None:
        rows = in_stretches(rows.select("block", "idx", "hash", "hashing", "size", "expiry", "kind"), order)
    rows = previous_in_order(rows, [], order, ["block", "hashing", "kind"], width)
    follows = (
        (F.col("previous_kind") == "leaf")
        & (F.col("hashing") == F.col("previous_hashing"))
        & (F.col("block") - F.col("previous_block") <= MAX_GAP)
    )
    follows = F.coalesce(follows, F.lit(False))
    starts = (F.col("kind") == "leaf") & ~follows
    marked = rows.withColumn("__start", F.when(starts, F.col("step"))).withColumn("__follows", follows)
    runs = running_max(marked, [], order, "__start", width, "run")
    member = F.col("kind") == "leaf"
    closes = (F.col("kind") == "dag") & F.col("__follows")
    return (
        runs.filter(member | closes)
        .groupBy("run")
        .agg(
            F.max(F.when(closes, F.struct("block", "idx", "hash"))).alias("manifest"),
            F.count(F.lit(1)).alias("pieces"),
            F.sum("size").alias("total_bytes"),
            F.min("block").alias("first_block"),
            F.min("expiry").alias("expiry"),
        )
        .filter("manifest IS NOT NULL")
        .select("run", F.col("manifest.block").alias("manifest_block"), "pieces", "total_bytes", "first_block", "expiry")
    )


def manifest_roles(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Role of each stored content: root or inner manifest, leaf, manifest not read yet, or standalone."""
    parents = links.select(F.col("parent").alias("hash")).distinct().withColumn("__p", F.lit(True))
    children = links.select(F.col("child").alias("hash")).distinct().withColumn("__c", F.lit(True))
    contents = objects.groupBy("hash").agg(F.max("family").alias("family"))
    role = (
        F.when(F.col("__p") & F.col("__c"), "dag-inner")
        .when(F.col("__p"), "dag-root")
        .when(F.col("__c"), "leaf")
        .when(F.col("family") == "dag", "dag-unread")
        .otherwise("standalone")
    )
    return contents.join(parents, "hash", "left").join(children, "hash", "left").select("hash", "family", role.alias("role"))


def nearest_heads(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, head): where the walk from a node to its only parent, and on from there, ends: at a node with no parent or with several.

    Every round doubles the length of all walks that are still open, so a chain of n nodes takes log n rounds. What can't end, a
    circle with no way in and all below it, is left out. edges(node, child) without repeats, nodes(node).
    """
    above = edges.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("parent"))
    only = F.col("n").eqNullSafe(1)
    ups = settle(nodes.join(above, "node", "left").select("node", F.when(only, F.col("parent")).otherwise(F.col("node")).alias("head"), (~only).alias("ended")), "ups")
    while True:
        there = ups.select(F.col("node").alias("head"), F.col("head").alias("__on"), F.col("ended").alias("__ended"))
        walked = ups.filter("NOT ended").join(there, "head").select("node", F.col("__on").alias("head"), F.col("__ended").alias("ended"))
        walked = settle(walked, "ups")
        if walked.filter("ended").isEmpty():
            return ups.filter("ended").select("node", "head")
        ups = settle(ups.filter("ended").unionByName(walked), "ups")


def reached(starts: DataFrame, hops: DataFrame) -> DataFrame:
    """(root, head): all that each root leads to. What was seen from a root is not walked again, so cycles end. starts(root, head), hops(head, child)."""
    frontier = settle(starts.select("root", "head").distinct(), "reach")
    seen = frontier
    while not frontier.isEmpty():
        step = frontier.join(hops, "head").select("root", F.col("child").alias("head")).distinct()
        frontier = settle(step.join(seen, ["root", "head"], "left_anti").select("root", "head"), "reach")
        seen = seen.unionByName(frontier)
    return seen


def walkable(links: DataFrame, stored: DataFrame) -> DataFrame:
    """Links (node, child) of what is stored, each once: what is missing is not walked through."""
    edges = links.select(F.col("parent").alias("node"), "child").filter("node <> child").distinct()
    return edges.join(stored.select(F.col("hash").alias("node")).distinct(), "node", "left_semi")


def claimed_pieces(roots: DataFrame, links: DataFrame, stored: DataFrame) -> DataFrame:
    """(hash): everything that any of the roots leads to, these included; one row a piece. roots(root)."""
    starts = roots.select(F.lit(0).alias("root"), F.col("root").alias("head"))
    hops = settle(walkable(links, stored).select(F.col("node").alias("head"), "child"), "hops")
    return reached(starts, hops).select(F.col("head").alias("hash"))


def manifest_groups(objects: DataFrame, links: DataFrame) -> DataFrame:
    """One row per root manifest with everything under it. A piece that is not stored is listed but not walked through.

    A piece lives as long as its longest-lived copy; the upload as long as its first piece to go.
    objects(hash, block, idx, size, expiry, family).

    A piece with one parent belongs to whatever its parent belongs to, so it is added to the nearest piece above that has none or
    several. Only such heads are walked from each root: the rows of the walk are roots and shared pieces, not roots and pieces.
    """
    roots = settle(manifest_roles(objects, links).filter("role = 'dag-root'").select(F.col("hash").alias("root")), "roots")
    newest = F.max_by("size", F.struct("block", "idx"))
    pieces = objects.groupBy(F.col("hash").alias("node")).agg(F.max("expiry").alias("last_expiry"), F.sum("size").alias("stored"), newest.alias("size"))
    pieces = settle(pieces.withColumn("present", F.lit(True)), "pieces")
    edges = settle(walkable(links, objects), "links")
    nodes = edges.select(F.col("child").alias("node")).unionByName(pieces.select("node")).distinct()
    heads = settle(nearest_heads(edges, nodes), "heads")
    folded = (
        heads.join(pieces, "node", "left")
        .groupBy("head")
        .agg(
            F.count(F.lit(1)).alias("pieces"),
            F.count("present").alias("present"),
            F.sum("size").alias("total_bytes"),
            F.sum("stored").alias("stored_bytes"),
            F.min("last_expiry").alias("expiry"),
        )
    )
    # A link to a piece that is a head leads there from the head of the piece that it starts from.
    shared = heads.filter("node = head").select(F.col("node").alias("child"))
    hops = edges.join(shared, "child", "left_semi").join(heads, "node").filter("head <> child").select("head", "child").distinct()
    return (
        reached(roots.select("root", F.col("root").alias("head")), settle(hops, "hops"))
        .join(folded, "head")
        .groupBy("root")
        .agg(
            F.sum("pieces").alias("pieces"),
            (F.sum("pieces") - F.sum("present")).alias("missing"),
            (F.sum("present") - 1).alias("members"),
            F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("total_bytes"),
            F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("stored_bytes"),
            F.min("expiry").alias("expiry"),
        )
        .filter("members > 0")
    )


def lease_clock(objects: DataFrame, retention: int, head_block: Column, head_ms: Column, block_ms: Column) -> DataFrame:
    """Expiry block and projected time of each object from a measured block time."""
    expiry = F.col("block") + F.lit(retention)
    return objects.withColumn("expiry_block", expiry).withColumn(
        "expires_ms", (head_ms + (expiry - head_block) * block_ms)
    )


def timed_clock(blocks: DataFrame, block: str, ms: str) -> DataFrame:
    """One row: first and last timed block, and the measured time per block between them."""
    ends = blocks.agg(F.min(F.struct(block, ms)).alias("a"), F.max(F.struct(block, ms)).alias("b"))
    span = F.greatest(F.lit(1), F.col(f"b.{block}") - F.col(f"a.{block}"))
    return ends.select(
        F.col(f"b.{block}").alias("head_block"),
        F.col(f"b.{ms}").alias("head_ms"),
        ((F.col(f"b.{ms}") - F.col(f"a.{ms}")) / span).alias("block_ms"),
    )


def project_expiry(objects: DataFrame, clock: DataFrame, retention: int) -> DataFrame:
    rows = with_totals(objects, clock)
    return lease_clock(rows, retention, F.col("head_block"), F.col("head_ms"), F.col("block_ms")).drop("head_block", "head_ms", "block_ms")

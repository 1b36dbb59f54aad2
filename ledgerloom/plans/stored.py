"""Stored-object queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import objects as O
from ..sources import tables as T
from .registry import query


def chain_objects(spark, folder):
    """Documents as stored objects: French ones are manifests, the first ten sources hash with one function, the rest with another."""
    first = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int") < 10
    return T.table(spark, folder, "documents").select(
        F.col("doc_id").alias("block"),
        F.lit(0).alias("idx"),
        F.sha2("text", 256).alias("hash"),
        F.when(first, O.SHA2).otherwise(O.BLAKE2).alias("hashing"),
        F.when(F.col("lang") == "fr", O.DAG).otherwise(O.RAW).alias("codec"),
        (F.col("n_chars") * 64).alias("size"),
        (F.col("doc_id") + 1000).alias("expiry"),
    )


CHAIN_SQL = f"""
chain AS (SELECT doc_id AS block, sha256(text) AS hash, CASE WHEN cast(regexp_extract(source, '([0-9]+)$', 1) AS int) < 10 THEN {O.SHA2} ELSE {O.BLAKE2} END AS hashing,
    CASE WHEN lang = 'fr' THEN {O.DAG} ELSE {O.RAW} END AS codec, n_chars * 64 AS size, doc_id + 1000 AS expiry FROM documents),
shaped AS (SELECT *, CASE WHEN codec = {O.DAG} THEN 'dag-node' WHEN size = 262144 THEN 'leaf-256k' WHEN size = 262183 THEN 'car-section' WHEN size = 2097152 THEN 'leaf-max'
    WHEN hashing = {O.SHA2} AND size >= 131072 THEN 'bundle-piece' WHEN hashing = {O.SHA2} THEN 'deploy-file' WHEN size <= 4096 THEN 'app-record' ELSE 'app-blob' END AS shape FROM chain)"""


@query("p15_object_shapes", f"WITH {CHAIN_SQL} SELECT block, size, shape, CASE WHEN shape = 'dag-node' THEN 'dag' WHEN shape LIKE 'app%' THEN 'standalone' ELSE 'leaf' END AS family FROM shaped")
def object_shapes(spark, folder):
    return O.with_shape(chain_objects(spark, folder)).select("block", "size", "shape", "family")


@query(
    "a30_object_rollups",
    f"""WITH {CHAIN_SQL}, f AS (SELECT 'all' AS facet, '' AS value, * FROM shaped UNION ALL SELECT 'shape', shape, * FROM shaped UNION ALL SELECT 'codec', cast(codec AS varchar), * FROM shaped UNION ALL SELECT 'hashing', cast(hashing AS varchar), * FROM shaped)
    SELECT facet, value, count(*) AS objects, cast(sum(size) AS bigint) AS bytes, sum(size) / count(*) AS mean_size, max(size) AS largest, arg_min(block, (-size, block)) AS largest_block FROM f GROUP BY ALL""",
)
def object_rollups(spark, folder):
    return O.rollups(O.with_shape(chain_objects(spark, folder)), ["shape", "codec", "hashing"])


@query(
    "a30_objects_per_day",
    f"""WITH {CHAIN_SQL} SELECT cast(ts AS date) AS day, shape, count(*) AS objects, cast(sum(size) AS bigint) AS bytes, max(size) AS largest
    FROM shaped LEFT JOIN events ON event_id = block GROUP BY ALL""",
)
def objects_per_day(spark, folder):
    """The event of an object's number says when its block was; objects whose block has no time stay, without a day."""
    times = T.table(spark, folder, "events").select(F.col("event_id").alias("block"), F.to_date("ts").alias("day"))
    return O.per_day(O.with_shape(chain_objects(spark, folder)), times, "shape")


@query(
    "a31_duplication",
    f"""WITH {T.OBJECTS_SQL}, c AS (SELECT hash, count(*) AS copies, arg_min(size, block) AS size FROM objects GROUP BY hash)
    SELECT count(*) AS distinct_content, count(*) FILTER (copies > 1) AS repeated_content, cast(coalesce(sum(size * (copies - 1)), 0) AS bigint) AS duplicate_bytes, max(copies) AS max_copies FROM c""",
)
def duplication(spark, folder):
    return O.duplication(T.objects(spark, folder))


LABELS_SQL = " UNION ALL ".join(f"SELECT {i} AS bucket, '{label}' AS label" for i, (label, _) in enumerate(O.SIZE_BUCKETS))
BUCKET_SQL = " ".join(f"WHEN size < {edge} THEN {i}" for i, (_, edge) in enumerate(O.SIZE_BUCKETS[:-1]))


@query(
    "a32_size_histogram",
    f"""WITH {T.OBJECTS_SQL}, l AS ({LABELS_SQL}), c AS (SELECT CASE {BUCKET_SQL} ELSE {len(O.SIZE_BUCKETS) - 1} END AS bucket, count(*) AS objects, cast(sum(size) AS bigint) AS bytes FROM objects GROUP BY ALL)
    SELECT bucket, label, coalesce(objects, 0) AS objects, coalesce(bytes, 0) AS bytes FROM l LEFT JOIN c USING (bucket)""",
)
def size_histogram(spark, folder):
    return O.size_histogram(T.objects(spark, folder))


@query(
    "w10_adjacent_runs",
    f"""WITH {CHAIN_SQL}, k AS (SELECT *, CASE WHEN shape = 'dag-node' THEN 'dag' WHEN shape LIKE 'app%' THEN 'other' ELSE 'leaf' END AS kind FROM shaped),
    p AS (SELECT *, row_number() OVER (ORDER BY block) AS step, coalesce(lag(kind) OVER w = 'leaf' AND lag(hashing) OVER w = hashing AND block - lag(block) OVER w <= 64, false) AS follows FROM k WINDOW w AS (ORDER BY block)),
    r AS (SELECT *, max(CASE WHEN kind = 'leaf' AND NOT follows THEN step END) OVER (ORDER BY block) AS run FROM p)
    SELECT run, max(block) FILTER (kind = 'dag') AS manifest_block, count(*) AS pieces, cast(sum(size) AS bigint) AS total_bytes, min(block) AS first_block, min(expiry) AS expiry
    FROM r WHERE kind = 'leaf' OR (kind = 'dag' AND follows) GROUP BY run HAVING max(block) FILTER (kind = 'dag') IS NOT NULL""",
)
def adjacent_runs(spark, folder):
    objects = O.with_shape(chain_objects(spark, folder)).withColumn("claimed", F.lit(False))
    return O.adjacent_runs(objects)


@query(
    "q26_lease_clock",
    """WITH ends AS (SELECT min(event_id) AS b0, max(event_id) AS b1, epoch_us(arg_min(ts, event_id)) // 1000 AS t0, epoch_us(arg_max(ts, event_id)) // 1000 AS t1 FROM events)
    SELECT doc_id AS block, doc_id + 100800 AS expiry_block, t1 + (doc_id + 100800 - b1) * ((t1 - t0) / greatest(1, b1 - b0)) AS expires_ms FROM documents, ends""",
)
def lease_clock(spark, folder):
    timed = T.table(spark, folder, "events").select(F.col("event_id").alias("block"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    objects = T.table(spark, folder, "documents").select(F.col("doc_id").alias("block"))
    return O.project_expiry(objects, O.timed_clock(timed, "block", "ms"), 100_800)


def le(value, digits: int):
    return S.swap_bytes(F.lpad(F.hex(value), digits, "0"))


@query(
    "s05_packed_records",
    f"""WITH {CHAIN_SQL}, n AS (SELECT doc_id, 1 + n_chars % 3 AS records, lang FROM documents), e AS (SELECT doc_id AS block, unnest(generate_series(0, records - 1)) AS idx, records, lang FROM n)
    SELECT e.block, idx, hash AS content_hash, CASE WHEN hashing = {O.SHA2} THEN 18 ELSE 32 END::bigint AS hashing, codec::bigint AS codec, size, idx AS extrinsic, records AS block_chunks, 0::bigint AS kind
    FROM e JOIN chain ON chain.block = e.block WHERE NOT (lang = 'de' AND idx = records - 1)""",
)
def packed_records(spark, folder):
    """Packs one to three records per document, the German ones with the last record cut short, and unpacks them."""
    out = O.explode_records(packed_blocks(spark, folder), "packed")
    return out.drop("chunk_root").withColumn("content_hash", F.lower("content_hash"))


@query(
    "s05_record_quality",
    "SELECT doc_id AS block, cast(1 + n_chars % 3 AS bigint) AS announced, CASE WHEN lang = 'de' THEN 1 ELSE 0 END::bigint AS cut_off FROM documents",
)
def record_quality(spark, folder):
    """How many records each block announces, and how many its vector has no room for."""
    return O.record_quality(packed_blocks(spark, folder), "packed")


def packed_blocks(spark, folder):
    docs = T.table(spark, folder, "documents").select(
        F.col("doc_id").alias("block"), (1 + F.col("n_chars") % 3).alias("records"), "lang"
    )
    rows = chain_objects(spark, folder).join(docs, "block")
    record = lambda i: F.concat(
        F.lpad(F.lit("ab"), 64, "0"),
        F.col("hash"),
        F.when(F.col("hashing") == O.SHA2, "12").otherwise("20"),
        le(F.col("codec").cast("bigint"), 16),
        le(F.col("size"), 8),
        le(i, 8),
        le(F.col("records"), 8),
        F.lit("00"),
    )
    body = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("records") - 1), record), "")
    packed = F.concat(F.lit("0x"), F.lpad(F.hex(F.shiftleft("records", 2)), 2, "0"), body)
    cut = F.when(F.col("lang") == "de", F.substr(packed, F.lit(1), F.length(packed) - 10)).otherwise(packed)
    return rows.select("block", cut.alias("packed"))


def part_manifests(spark, folder):
    """Parts as a forest: every forty keys one tree with three children per node, some links pointing back up.

    Promotional parts are linked but not stored; parts of two brands are stored twice, the copy living longer.
    """
    part = T.table(spark, folder, "part")
    local = F.col("p_partkey") % 40
    parent = F.col("p_partkey") - local + F.floor((local - 1) / 3)
    name = lambda c: F.concat(F.lit("d"), c.cast("bigint").cast("string"))
    # The first key of a tree has no parent; a link back up never points at it.
    up = F.when(local > 0, name(parent))
    back_up = F.when((local > 3) & (F.col("p_size") > 40), name(parent))
    down = part.select(up.alias("parent"), name(F.col("p_partkey")).alias("child")).filter("parent IS NOT NULL")
    back = part.select(name(F.col("p_partkey")).alias("parent"), back_up.alias("child")).filter("child IS NOT NULL")
    stored = part.filter((F.col("p_type") != "PROMO") | (local == 0))
    once = stored.select(
        name(F.col("p_partkey")).alias("hash"),
        F.col("p_partkey").alias("block"),
        F.lit(0).alias("idx"),
        F.col("p_size").cast("bigint").alias("size"),
        (F.col("p_partkey") + F.col("p_size")).alias("expiry"),
        F.when(F.col("p_size") == 1, "dag").otherwise("leaf").alias("family"),
    )
    again = once.join(part.filter(F.col("p_brand").isin("Brand#1", "Brand#2")).select(F.col("p_partkey").alias("block")), "block", "left_semi")
    copies = once.unionByName(
        again.select("hash", (F.col("block") + 5).alias("block"), F.lit(1).alias("idx"), "size", (F.col("expiry") + 500).alias("expiry"), "family")
    )
    return copies, down.unionByName(back)


MANIFEST_SQL = """
p AS (SELECT *, p_partkey % 40 AS local, p_partkey - p_partkey % 40 + cast(floor((p_partkey % 40 - 1) / 3) AS bigint) AS up FROM part),
links AS (SELECT 'd' || up AS parent, 'd' || p_partkey AS child FROM p WHERE local > 0 UNION ALL SELECT 'd' || p_partkey, 'd' || up FROM p WHERE local > 3 AND p_size > 40),
once AS (SELECT 'd' || p_partkey AS hash, p_partkey AS block, 0 AS idx, cast(p_size AS bigint) AS size, p_partkey + p_size AS expiry, CASE WHEN p_size = 1 THEN 'dag' ELSE 'leaf' END AS family, p_brand FROM p WHERE p_type <> 'PROMO' OR local = 0),
copies AS (SELECT * EXCLUDE p_brand FROM once UNION ALL SELECT hash, block + 5, 1, size, expiry + 500, family FROM once WHERE p_brand IN ('Brand#1', 'Brand#2')),
roles AS (SELECT hash, max(family) AS family, CASE WHEN hash IN (SELECT parent FROM links) AND hash IN (SELECT child FROM links) THEN 'dag-inner' WHEN hash IN (SELECT parent FROM links) THEN 'dag-root'
  WHEN hash IN (SELECT child FROM links) THEN 'leaf' WHEN max(family) = 'dag' THEN 'dag-unread' ELSE 'standalone' END AS role FROM copies GROUP BY hash)"""


@query("q25_manifest_roles", f"WITH {MANIFEST_SQL} SELECT hash, family, role FROM roles")
def manifest_roles(spark, folder):
    return O.manifest_roles(*part_manifests(spark, folder))


@query(
    "q25_manifest_groups",
    f"""WITH RECURSIVE {MANIFEST_SQL}, have AS (SELECT DISTINCT hash FROM copies),
    reach AS (SELECT hash AS root, hash AS node FROM roles WHERE role = 'dag-root' UNION SELECT reach.root, links.child FROM reach JOIN have ON have.hash = reach.node JOIN links ON links.parent = reach.node),
    pieces AS (SELECT hash, max(expiry) AS last_expiry, sum(size) AS stored, arg_max(size, (block, idx)) AS size FROM copies GROUP BY hash)
    SELECT root, count(*) AS pieces, count(*) FILTER (hash IS NULL) AS missing, count(*) FILTER (hash IS NOT NULL AND node <> root) AS members, cast(coalesce(sum(size), 0) AS bigint) AS total_bytes,
      cast(coalesce(sum(stored), 0) AS bigint) AS stored_bytes, min(last_expiry) AS expiry FROM reach LEFT JOIN pieces ON hash = node GROUP BY root HAVING count(*) FILTER (hash IS NOT NULL AND node <> root) > 0""",
)
def manifest_groups(spark, folder):
    return O.manifest_groups(*part_manifests(spark, folder))

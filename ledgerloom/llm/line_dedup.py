"""Line deduplication against levelled sorted runs of line hashes. DataFrame operations only.

A line is known by 128 bits of its key. Batches of documents are added from the largest ids to the smallest. A batch
counts its keys by document, merge-anti-joins the runs on the keys that are already closed (held by enough documents;
their largest holder is known by then), and adds the rest as a run of its own, sorted by hash. Enough runs of a level are
compacted into one run of the next. At the end the runs say which keys are closed, and lines lose by an anti-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import fresh_path, settle

from . import common
from .common import quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_DOCUMENTS = 40, 5
BATCHES, FAN_IN = 4, 2
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case; other letters stay as they are."""
    bare = F.btrim(line, F.lit(common.SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """Levelled runs in the shared folder. A run holds (h1, h2, n, newest): documents holding a key, and the largest id of them."""

    def __init__(self, spark: SparkSession, least: int = LEAST_DOCUMENTS, fan_in: int = FAN_IN):
        self.spark, self.least, self.fan_in = spark, least, fan_in
        self.levels: list[list[str]] = []

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n long, newest long").parquet(*paths)

    def _write(self, run: DataFrame) -> str:
        path = fresh_path(self.spark, "line-run")
        run.sortWithinPartitions(*KEY).write.parquet(path)
        return path

    def merged(self) -> DataFrame:
        """All runs as one: a row for each key."""
        return self._read([p for level in self.levels for p in level]).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))

    def closed(self) -> DataFrame:
        return self.merged().filter(F.col("n") >= self.least)

    def add(self, held: DataFrame) -> None:
        """Add a batch, given as (h1, h2, doc_id) rows. Its ids must lie below those of earlier batches."""
        keys = held.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("newest"))
        if self.levels:
            keys = keys.join(self.closed().select(*KEY).hint("merge"), KEY, "left_anti")
        self._push(0, self._write(keys))

    def _push(self, level: int, path: str) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fan_in:
            runs, self.levels[level] = self.levels[level], []
            one = self._read(runs).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))
            self._push(level + 1, self._write(one))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, same, lines): same tells texts under one id apart, so that repeated ids keep their own lines."""
    whole = F.coalesce(quoted(text), F.lit(""))
    return docs.select(quoted(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("same"), F.split(whole, "\n", -1).alias("lines"))


def occurrences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, same, at, h1, h2): every line whose key is long enough, by its hash. Rows without an id take no part."""
    exploded = _lines(docs.filter(quoted(doc_id).isNotNull()), doc_id, text).select("doc_id", "same", F.posexplode("lines").alias("at", "line"))
    keyed = exploded.filter(F.char_length("line") >= length).select("doc_id", "same", "at", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= length).select("doc_id", "same", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LEAST_LENGTH, least: int = LEAST_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, same, gone): the positions of the lines that each text loses; texts that lose none are left out."""
    spark = docs.sparkSession
    cuts = docs.select(F.percentile_approx(quoted(doc_id).cast("long"), [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or []
    batch = reduce(lambda at, cut: at + (F.col("doc_id") <= cut).cast("int"), cuts, F.lit(0))  # 0 holds the largest ids
    held = settle(occurrences(docs, doc_id=doc_id, text=text, length=length).withColumn("batch", batch), "line-hashes", "batch")
    runs = LineRuns(spark, least)
    for b in range(len(cuts) + 1):
        runs.add(held.filter(F.col("batch") == b).select(*KEY, "doc_id"))
    # Written once, so that the join has a shuffle on both sides and a line with a third of all rows can be split.
    closed = settle(runs.closed().select(*KEY, "newest"), "closed-lines")
    lost = held.join(closed.hint("merge"), KEY).filter(F.col("doc_id") < F.col("newest"))
    return lost.groupBy("doc_id", "same").agg(F.collect_set("at").alias("gone"))


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Documents without the lines that many documents share; `n_lines` and `n_dropped` say how many there were and went.

    A key of at least `length` code points that at least `least` documents hold loses all its lines except those in the
    largest id holding it. The other lines stay, joined by \\n; a text that loses all its lines becomes empty.
    Null and empty texts are one empty line; the former stay null. Rows without an id hold no keys and keep their lines. Rows with the same
    id count as one document; each keeps or loses its own lines. Columns called n_lines or n_dropped give way.
    A key held by a third of all documents is summed before the shuffle; joins on it are split.
    """
    gone = dropped_lines(docs, doc_id=doc_id, text=text, **options)
    kept = common.without(docs, ["n_lines", "n_dropped"])
    whole = F.coalesce(quoted(text), F.lit(""))
    # Documents travel whole, as one column, so that no name of theirs can clash.
    packed = kept.select(F.struct(*[quoted(c).alias(c) for c in kept.columns]).alias("doc"), quoted(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("same"))
    both = packed.join(gone, ["doc_id", "same"], "left")
    inner = F.col("doc").getField(text)
    split = both.withColumn("lines", F.split(F.coalesce(inner, F.lit("")), "\n", -1))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text_left = F.when(F.col("gone").isNull(), inner).otherwise(F.array_join(F.transform(F.array_sort(stays), lambda i: F.get(F.col("lines"), i)), "\n"))
    return split.select(
        *[(text_left if c == text else F.col("doc").getField(c)).alias(c) for c in kept.columns],
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that at least five share, by digest."""
    kept = dedup(common.table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS l
  FROM documents),
keyed AS (
  SELECT *, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS newest FROM keyed WHERE length(k) >= {LEAST_LENGTH}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}),
marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id <> newest, false) AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES: dict[str, str] = {"op2_line_dedup": ORACLE}

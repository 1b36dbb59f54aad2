"""Mixing sources to target weights by a low-discrepancy schedule.

Documents of a source are shuffled and laid end to end; the stream of words, repeated as often as the target asks, is cut
into blocks of equal size. Slots of the mix get the points of a golden-ratio sequence, each point falls into a source's
share of the cumulative weights, and slots are ranked within their source: the r-th slot of a source takes its r-th block.
So every stretch of the mix holds the sources close to their weights, and the same input gives the same mix.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import settle

from . import common
from .common import quoted

WEIGHTS = (1, 2, 3)  # by code point of the source, repeating
MOST = 3  # times that a document may be taken
BLOCK = 1024  # words of a slot
STRETCH = 1 << 16  # slots ranked together
PLACES = 1 << 12  # documents of all sources, about, whose sizes are summed together
#: The golden ratio's fraction of 2**31, made odd: multiples of it modulo 2**31 visit every value once a period.
RATIO, SPAN = 1327217885, 1 << 31


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, idx, target): one row a source of sizes (source, size); null is a source of its own, the last.

    Weights share all sizes; a source stops at `most` times its own size and the excess goes to the others by weight until none
    is above. Sources in order of source_size / weight stop first, so one pass over the sorted sources settles it.
    """
    lcm = F.lit(6) if set(weights) <= {1, 2, 3} else None
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source, not for each document
    idx = by_source.withColumn("idx", F.row_number().over(order) - 1)
    weighed = idx.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("idx") % len(weights)).cast("long"))
    ratio = F.col("source_size") * (lcm / F.col("weight")).cast("long") if lcm is not None else F.col("source_size") / F.col("weight")
    whole, before = Window.partitionBy(), Window.orderBy(ratio, "idx").rowsBetween(Window.unboundedPreceding, -1)
    wide = lambda c: c.cast("decimal(38,0)")
    left_size = wide(F.sum("source_size").over(whole)) - most * wide(F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    left_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = weighed.withColumn("left_size", left_size.cast("decimal(30,0)")).withColumn("left_weight", left_weight)
    full = ranked.withColumn("full", wide(most * F.col("source_size")) * F.col("left_weight").cast("decimal(8,0)") < F.col("weight").cast("decimal(2,0)") * F.col("left_size"))
    open_size = F.max(F.when(~F.col("full"), F.col("left_size"))).over(whole)
    open_weight = F.max(F.when(~F.col("full"), F.col("left_weight"))).over(whole)
    share = (F.col("weight").cast("decimal(2,0)") * open_size).cast("double") / open_weight.cast("double")
    return full.select("source", "source_size", "idx", F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def streams(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, sources). Documents: (doc_id, same, size, idx, start), start being a document's first word in its source's stream.

    The order within a source is by the md5 of the id. Stretches of that order are summed first, so a source with a third
    of all documents is no single task.
    """
    sized = settle(
        docs.select(
            quoted(doc_id).alias("doc_id"), quoted(source).cast("string").alias("source"), F.xxhash64(F.coalesce(quoted(text), F.lit(""))).alias("same"),
            word_count(quoted(text)).alias("size"), F.md5(F.coalesce(quoted(doc_id).cast("string"), F.lit("")).cast("binary")).alias("place"),
        ),
        "sizes",
    )
    sources = settle(targets(sized), "sources")
    parts = sized.count() // PLACES + 1
    placed = sized.withColumn("part", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32)))
    sums = placed.groupBy("source", "part").agg(F.sum("size").alias("n")).join(sources.select("source", "idx").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    earlier = Window.partitionBy("idx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), "idx", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    within = Window.partitionBy("idx", "part").orderBy("place", "doc_id", "same", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = joined.withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    return laid.select("doc_id", "source", "same", "size", "idx", "start"), sources


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, idx, rank, taken): the order in which the mix takes blocks of each source; taken is a block's words, less in the last."""
    spark = sources.sparkSession
    needs = sources.withColumn("words", F.floor(F.col("target") + 0.5)).withColumn("slots", F.ceil(F.col("words") / block).cast("long")).filter(F.col("slots") > 0)
    upto = F.sum("slots").over(Window.orderBy("idx")).cast("double") / F.sum("slots").over(Window.partitionBy())
    shares = needs.withColumn("upto", F.floor(upto * SPAN)).withColumn("from", F.coalesce(F.lag("upto").over(Window.orderBy("idx")), F.lit(0)))
    total = needs.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    points = spark.range(total).select(F.col("id").alias("slot"), ((F.col("id") % SPAN) * RATIO % SPAN).alias("point"))
    # A share covers some of 1,024 equal cells, so that points find their source by an equal cell and one comparison.
    cell = lambda c, less: ((F.col(c) - less) * 1024 / SPAN).cast("long")
    cells = shares.filter(F.col("upto") > F.col("from")).select("idx", "from", "upto", "slots", "words", F.explode(F.sequence(cell("from", 0), cell("upto", 1))).alias("cell"))
    placed = points.withColumn("cell", (F.col("point") * 1024 / SPAN).cast("long")).join(cells, "cell").filter((F.col("point") >= F.col("from")) & (F.col("point") < F.col("upto"))).select("slot", "idx")
    # Ranks by stretches of slots: counts of the earlier stretches, then the place within the own one.
    staged = placed.withColumn("stretch", F.floor(F.col("slot") / STRETCH))
    counts = staged.groupBy("idx", "stretch").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("idx", "stretch", F.coalesce(F.sum("n").over(Window.partitionBy("idx").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    ranked = staged.join(offsets, ["idx", "stretch"]).select("slot", "idx", (F.col("offset") + F.row_number().over(Window.partitionBy("idx", "stretch").orderBy("slot")) - 1).alias("rank"))
    kept = ranked.join(needs.select("idx", "slots"), "idx").filter(F.col("rank") < F.col("slots")).select("slot", "idx", "rank")
    # The sequence keeps each share within a few slots; those that a source still lacks close the mix.
    had = counts.groupBy("idx").agg(F.sum("n").alias("had"))
    lacking = needs.join(had, "idx", "left").select("idx", F.coalesce("had", F.lit(0)).alias("had"), "slots").filter(F.col("had") < F.col("slots"))
    closing = lacking.select("idx", F.explode(F.sequence("had", F.col("slots") - 1)).alias("rank")).select((F.lit(total) + F.col("rank")).alias("slot"), "idx", "rank")
    every = kept.union(closing.select("slot", "idx", "rank"))
    return every.join(needs.select("idx", "words"), "idx").select("slot", "idx", "rank", F.least(F.lit(block), F.col("words") - F.col("rank") * block).alias("taken"))


def pieces(documents: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, doc_id, same, idx, start, size, first, until): the words of a document that a slot takes, counted from 0, the end exclusive."""
    slots = schedule(sources, block)
    words = sources.select("idx", F.col("source_size").alias("length"), F.floor(F.col("target") + 0.5).alias("words"))
    rounds = documents.filter(F.col("size") > 0).join(words, "idx").withColumn("low", F.explode(F.transform(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda r: r * F.col("length") + F.col("start"))))
    used = rounds.filter(F.col("low") < F.col("words")).withColumn("high", F.least(F.col("low") + F.col("size"), F.col("words")))
    cut = used.withColumn("rank", F.explode(F.sequence((F.col("low") / block).cast("long"), ((F.col("high") - 1) / block).cast("long"))))
    took = cut.join(slots, ["idx", "rank"])
    return took.select(
        "slot", "doc_id", "same", "idx", "start", "size",
        (F.greatest(F.col("low"), F.col("rank") * block) - F.col("low")).alias("first"),
        (F.least(F.col("high"), F.col("rank") * block + F.col("taken")) - F.col("low")).alias("until"),
    )


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """(doc_id, source, same, size, source_size, target, taken): one row a document; taken is how many of its words the mix holds.

    Null texts and texts without words have size 0 and are never taken. Null sources are one source. Rows that repeat an id are
    documents of their own. No document is taken more than three times. An empty table gives no rows.
    """
    documents, sources = streams(docs, doc_id=doc_id, text=text, source=source)
    documents = settle(documents, "streams")
    key = ["idx", "start", "size"]
    taken = pieces(documents, sources, block).groupBy(*key).agg(F.sum(F.col("until") - F.col("first")).alias("taken"))
    both = documents.join(taken, key, "left").join(sources.select("idx", "source_size", "target"), "idx")
    return both.select("doc_id", "source", "same", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs.

    A document that the end of its source's target cuts counts as taken once more if at least half of it lies before the cut;
    there is at most one such document in a source. Texts without words are not taken.
    """
    found = mix(docs, doc_id=doc_id, text=text, source=source)
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    often = found.filter(F.col("size") > 0).select(F.col("doc_id").alias("id"), "same", times.alias("times")).filter(F.col("times") > 0)
    # Rows that repeat an id and a text are told apart by their number among themselves, on both sides. Documents travel whole, as one
    # column, so that no name of theirs can clash.
    number = lambda df, by: df.withColumn("n", F.row_number().over(Window.partitionBy("id", "same").orderBy(by)))
    packed = docs.select(F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("doc"), quoted(doc_id).alias("id"), F.xxhash64(F.coalesce(quoted(text), F.lit(""))).alias("same"))
    left, right = number(packed, F.lit(0)), number(often, F.col("times").desc()).toDF("i", "s", "times", "k")
    joined = left.join(right, F.col("id").eqNullSafe(F.col("i")) & (F.col("same") == F.col("s")) & (F.col("n") == F.col("k")))
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix takes, and its source's target."""
    found = mix(common.table(spark, folder, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
ranked AS (
  SELECT *, (sum(source_size) OVER ())::HUGEINT - 3 * coalesce(sum(source_size) OVER before, 0)::HUGEINT AS left_size,
         (sum(weight) OVER ())::HUGEINT - coalesce(sum(weight) OVER before, 0)::HUGEINT AS left_weight
  FROM sources WINDOW before AS (ORDER BY source_size * (6 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, 3 * source_size::HUGEINT * left_weight < weight * left_size AS capped FROM ranked),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN (3 * source_size)::DOUBLE
              ELSE (weight * max(left_size) FILTER (WHERE NOT capped) OVER ())::DOUBLE / (max(left_weight) FILTER (WHERE NOT capped) OVER ())::DOUBLE END AS target
  FROM capped),
laid AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS words,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id::VARCHAR), s.doc_id))::BIGINT - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (words // source_size) * size + greatest(0, least(start + size, words % source_size) - start) END::BIGINT AS taken
FROM laid
"""

QUERIES = {"op10_mixing": op10_mixing}
ORACLES: dict[str, str] = {"op10_mixing": ORACLE}

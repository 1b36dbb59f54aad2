"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector is taken relative to its centroid, rotated by one random orthogonal matrix and kept as the signs of its coordinates,
packed, with three numbers that correct the estimate: the length of the difference, how well the signs follow its direction,
and its product with the centroid. From these comes an estimate of the inner product with any query and a bound of its error.
A candidate is reranked on its original vector if its upper bound reaches the k-th best lower bound.

Queries are looked up in all rows, block by block: a cell of the grid of row groups and query groups is one small task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import settle

from . import common

NEIGHBOURS, EVERY = 20, 20
#: Vectors that centroids are fitted on, at most; every row is indexed.
SAMPLE, CENTROIDS, STEPS = 4096, 32, 8
#: Width of the error bound in standard deviations of the estimate.
SPREAD = 3.0
ROWS, QUERIES_A_CELL, CHUNK, PAIRS = 16_384, 512, 2_048, 1 << 15
FIRST_LOOK = 2 * NEIGHBOURS


@dataclass
class Frame:
    """What all codes share: the rotation, and the centroids."""

    rotation: np.ndarray
    centroids: np.ndarray


def fit(vectors: np.ndarray, seed: int = 5) -> Frame:
    """A random rotation, and centroids of a bounded sample."""
    rng = np.random.default_rng(seed)
    size = vectors.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(size, size)))[0]
    centroids = vectors[rng.permutation(len(vectors))[:CENTROIDS]].copy()
    for _ in range(STEPS):
        own = np.argmax(vectors @ centroids.T - 0.5 * (centroids**2).sum(1), 1)
        for c in range(len(centroids)):
            if (own == c).any():
                centroids[c] = vectors[own == c].mean(0)
    return Frame(rotation, centroids)


def encode(vectors: np.ndarray, frame: Frame) -> tuple[np.ndarray, ...]:
    """(centroid, packed signs, length, follow, product) of each vector."""
    own = np.argmax(vectors @ frame.centroids.T - 0.5 * (frame.centroids**2).sum(1), 1)
    rest = vectors - frame.centroids[own]
    turned = rest @ frame.rotation
    length = np.sqrt((rest**2).sum(1))
    follow = np.abs(turned).sum(1) / (np.maximum(length, 1e-30) * np.sqrt(vectors.shape[1]))
    return own, np.packbits(turned > 0, axis=1), length, np.where(length > 0, follow, 1.0), (rest * frame.centroids[own]).sum(1)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with an id and a vector of finite numbers that are not all zero, of the commonest length (of two, the longer).

    Null vectors, vectors that hold a null, and vectors of another length take no part.
    """
    # Components stay as they are: only narrower or other kinds of numbers are widened.
    kind = vectors.select(common.quoted(embedding)).schema[0].dataType.simpleString()
    named = vectors.select(common.quoted(vec_id).cast("long").alias("vec_id"), common.quoted(embedding).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    whole = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    fine = named.filter(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))
    sizes = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return fine.filter(F.size("v") == (sizes["n"] if sizes else 0))


def indexed(fine: DataFrame, frame: Frame) -> DataFrame:
    """(vec_id, v, own, code, length, follow, product): every row with its code."""
    shared = fine.sparkSession.sparkContext.broadcast(frame)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own, code, *numbers = encode(_matrix(b.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), *(pa.array(n, pa.float64()) for n in numbers)], ["vec_id", "v", "own", "code", "length", "follow", "product"])

    return fine.mapInArrow(run, f"vec_id long, v {fine.schema['v'].dataType.simpleString()}, own int, code binary, length double, follow double, product double")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def estimates(queries: np.ndarray, own: np.ndarray, code: np.ndarray, length: np.ndarray, follow: np.ndarray, product: np.ndarray, frame: Frame, spread: float = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) for each row and query: bounds of their inner product from the codes alone."""
    size = queries.shape[1]
    single = np.float32
    signs = (single(2) * np.unpackbits(code, axis=1, count=size) - single(1)) / single(np.sqrt(size))
    # With q for a query and c for a row's centroid: signs * (q - c) = signs * q - signs * c, so one product serves all centroids.
    ours = (signs * (frame.centroids @ frame.rotation).astype(single)[own]).sum(1)
    scale = (length / follow).astype(single)
    middle = (signs @ (queries @ frame.rotation).T.astype(single)) * scale[:, None]
    middle += (product.astype(single) - scale * ours)[:, None]
    with_centroid = frame.centroids @ queries.T
    away = np.sqrt(np.maximum(0, (queries**2).sum(1) - 2 * with_centroid + (frame.centroids**2).sum(1)[:, None]))
    middle += with_centroid.astype(single)[own]
    doubt = length * np.sqrt(np.maximum(0, 1 - follow**2)) / follow / np.sqrt(max(1, size - 1))
    reach = away.astype(single)[own] * (spread * doubt).astype(single)[:, None] + single(1e-5) * (1 + np.abs(middle))
    return middle - reach, middle + reach


def exact(rows: np.ndarray, queries: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows r with queries q in double precision, summed from the first component to the last."""
    out = np.empty(len(r))
    by_row, by_query = np.ascontiguousarray(rows.T), np.ascontiguousarray(queries.T)
    for at in range(0, len(r), PAIRS):
        left, right = r[at : at + PAIRS], q[at : at + PAIRS]
        total = np.zeros(len(left))
        for d in range(rows.shape[1]):
            total += by_row[d][left] * by_query[d][right]
        out[at : at + PAIRS] = total
    return out


def best(ids: np.ndarray, vectors: np.ndarray, codes: tuple, query_ids: np.ndarray, queries: np.ndarray, frame: Frame, k: int) -> pd.DataFrame:
    """The k best rows of a cell for each of its queries. What one chunk of rows has come to is the bar for the next one."""
    q_of, id_of, score_of = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    reached = np.full(len(queries), -np.inf)  # the k-th best score so far
    for at in range(0, len(ids), CHUNK):
        part = slice(at, at + CHUNK)
        low, high = estimates(queries, *(c[part] for c in codes), frame)
        same = ids[part][:, None] == query_ids[None, :]
        low[same], high[same] = -np.inf, -np.inf
        bar = np.maximum(reached, np.partition(low, -k, axis=0)[-k]) if len(low) >= k else reached
        if len(low) > FIRST_LOOK >= k:
            # The exact scores of those that look best are a bar as well, and a higher one than any estimate gives.
            looks = np.argpartition(low + high, -FIRST_LOOK, axis=0)[-FIRST_LOOK:]
            seen = exact(vectors[part], queries, looks.ravel(), np.tile(np.arange(len(queries)), FIRST_LOOK)).reshape(looks.shape)
            seen[np.take_along_axis(same, looks, 0)] = -np.inf
            bar = np.maximum(bar, np.partition(seen, -k, axis=0)[-k])
        del low
        r, q = np.nonzero((high >= bar) & ~same)
        del high, same
        q_of, id_of = np.concatenate((q_of, q)), np.concatenate((id_of, ids[part][r]))
        score_of = np.concatenate((score_of, exact(vectors[part], queries, r, q)))
        order = np.lexsort((id_of, -score_of, q_of))
        place = np.arange(len(order)) - np.searchsorted(q_of[order], q_of[order], side="left")
        kept = order[place < k]
        q_of, id_of, score_of = q_of[kept], id_of[kept], score_of[kept]
        full = np.flatnonzero(np.bincount(q_of, minlength=len(queries)) == k)
        last = np.searchsorted(q_of, full, side="right") - 1
        reached[full] = score_of[last]
    return pd.DataFrame({"query_id": query_ids[q_of], "vec_id": id_of, "score": score_of})


def search(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", every: int = EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows to each row whose id is divisible by `every`, its own id left out.

    Nearest first by inner product of the original vectors, ties to the smaller id; fewer rows where there are fewer candidates.
    Rows that repeat an id are candidates of their own. Rows and queries go to groups by hash, of bounded size; a cell hands on k
    rows for a query, so nothing grows in one task. The result may miss a neighbour whose error bound fails, which is rare.
    """
    spark = vectors.sparkSession
    fine = usable(vectors, vec_id, embedding)
    total = fine.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = common.sample(fine, SAMPLE, F.col("vec_id")).select("v").limit(2 * SAMPLE).toArrow().column(0).combine_chunks()
    frame = fit(_matrix(drawn if isinstance(drawn, pa.Array) else drawn.chunk(0)))
    shared = spark.sparkContext.broadcast(frame)
    index = settle(indexed(fine, frame), "vector-codes")
    asked = index.filter(F.pmod("vec_id", F.lit(every)) == 0)
    groups, query_groups = total // ROWS + 1, total // every // QUERIES_A_CELL + 1
    spread = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(n)).cast("int")
    rows = index.withColumn("g", spread(groups, 3)).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))
    queries = asked.select("vec_id", "v", spread(query_groups, 4).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        codes = (left["own"].to_numpy(), np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1), *(left[c].to_numpy() for c in ("length", "follow", "product")))
        stack = lambda df: np.stack(df["v"].to_numpy()).astype(np.float64)
        return best(left["vec_id"].to_numpy(), stack(left), codes, right["vec_id"].to_numpy(), stack(right), shared.value, k)

    near = rows.groupBy("g", "h").cogroup(queries.groupBy("g", "h")).applyInPandas(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of all other vectors for every twentieth id."""
    return search(common.table(spark, folder, "embeddings"))


ORACLE = f"""
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {NEIGHBOURS}
"""

QUERIES = {"op3_neighbours": op3_neighbours}
ORACLES: dict[str, str] = {"op3_neighbours": ORACLE}

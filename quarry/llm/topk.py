"""Exact top-k by inner product over a pivot-distance index.

Inner products become distances by one more coordinate: with M the largest norm, |q,0 - v,sqrt(M^2-|v|^2)|^2 =
|q|^2 + M^2 - 2 q.v, so the nearest vectors are those of the highest scores. Vectors are keyed by their nearest pivot
and the distance to it, range-partitioned and sorted by that key; runs of neighbouring keys form annuli. For a query,
a vector at distance d from pivot p is at least |d(q,p) - d| away, so an annulus whose bound exceeds the distance of the
query's k-th best is never opened, and a pivot's annuli are expanded outwards from d(q,p) until the bound stops them.
Every score that counts is the exact integer product.

Queries go out in blocks of QUERY_BLOCK rows (so a broadcast has a fixed size, whatever their number); each block is
one pass over the index. Before its pass, the k-th best score among a bounded set of vectors starts the bound. Each
task returns at most k rows per query, and only those that reach the starting bound.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows with a null
vec_id; vectors of different length are never compared; a query's own rows are those with its vec_id; repeated ids are
one query; equal scores go to the smaller vec_id; a table without vectors gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.llm.common import cut

PIVOTS = 64
#: Vectors that pivots are fitted on and that start each query's bound: a bounded sample; every vector is indexed.
FIT_ROWS = 4096
QUERY_BLOCK = 8192
#: Vectors in one annulus.
ANNULUS = 256
SCALE = 256


def usable(table: DataFrame) -> DataFrame:
    """vec_id, x: array<long> floor(SCALE * component) of the rows that take part."""
    wide = F.transform("embedding", lambda v: v.cast("double"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("v"))
    fine = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine).select("vec_id", F.transform("v", lambda v: F.floor(v * F.lit(float(SCALE))).cast("long")).alias("x"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T: in floating point while every sum stays exact there, else in 64-bit integers."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Pivots:
    def __init__(self, sample: np.ndarray, top_norm2: float):
        self.m2 = top_norm2
        x = self.lift(sample)
        r = np.random.default_rng(5)
        c = x[r.choice(len(x), min(PIVOTS, len(x)), replace=False)]
        for _ in range(8):
            near = self._d2(x, c).argmin(1)
            c = np.stack([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
        self.c = c

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x.astype(np.float64)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.m2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest])

    @staticmethod
    def _d2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        return np.sqrt(self._d2(self.lift(x, query), self.c))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of scores: highest first, equal ones by smaller id."""
    if scores.shape[1] > 4 * k:
        cut_at = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        width = int((scores >= cut_at[:, None]).sum(1).max())
        if width < scores.shape[1] // 2:
            near = np.argpartition(-scores, width - 1, axis=1)[:, :width]
            scores, ids = np.take_along_axis(scores, near, 1), np.take_along_axis(ids, near, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


_NONE = -np.iinfo(np.int64).max  # its negative is a number too


def search_annuli(pivots: Pivots, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, cells, k: int):
    """Top k of each query in the given annuli. floor: scores below it never count. cells: (pivot, ids, x, dist), distances sorted."""
    n = len(queries)
    best, who = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)
    q2 = (queries.astype(np.float64) ** 2).sum(1)
    dq = pivots.distances(queries, True)
    every = np.arange(n)

    def radius(scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The distance that belongs to a score, with room for rounding."""
        span = q2[rows] + pivots.m2
        return np.sqrt(np.maximum(span - 2.0 * scores, 0)) + 1e-6 * (1 + np.sqrt(span))

    limit = np.where(floor == _NONE, np.inf, radius(floor.astype(np.float64), every))
    first, last, of = (np.array([c[3][0] for c in cells]), np.array([c[3][-1] for c in cells]), np.array([c[0] for c in cells]))
    bounds = np.maximum(np.maximum(first - dq[:, of], dq[:, of] - last), 0)
    # Each query goes outwards from its own distance to the pivots, ring by ring, and stops at the first that its bound rules out: all later ones lie farther.
    outward = np.argsort(bounds, axis=1, kind="stable")
    open_ = every
    for step in range(len(cells)):
        ring = outward[open_, step]
        on = bounds[open_, ring] <= limit[open_]
        open_, ring = open_[on], ring[on]
        if not len(open_):
            break
        for at in np.unique(ring):
            rows = open_[ring == at]
            _, ids, x, _ = cells[at]
            scores = products(queries[rows], x)
            scores[query_ids[rows][:, None] == ids[None]] = _NONE
            worth = np.flatnonzero(scores.max(1) >= np.maximum(best[rows, k - 1], floor[rows]))
            if not len(worth):
                continue
            rows = rows[worth]
            s, i = _top(np.concatenate([best[rows], scores[worth]], 1), np.concatenate([who[rows], np.broadcast_to(ids, (len(rows), len(ids)))], 1), k)
            best[rows], who[rows] = s, i
            full = rows[best[rows, k - 1] != _NONE]
            limit[full] = np.minimum(limit[full], radius(best[full, k - 1].astype(np.float64), full))
    return best, who


_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def search(rows: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: rows as usable() gives them; is_query is a condition on vec_id."""
    spark = rows.sparkSession
    table = cut(rows.withColumn("dim", F.size("x")), "topk-rows")
    parts = [_search_dim(table.where(F.col("dim") == r["dim"]), r["dim"], float(r["m2"]), is_query, k) for r in table.groupBy("dim").agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))).alias("m2")).collect()]
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_dim(table: DataFrame, dim: int, m2: float, is_query, k: int) -> DataFrame:
    spark = table.sparkSession
    if dim == 0:
        only = table.select("vec_id").distinct()
        q = only.where(is_query).select(F.col("vec_id").alias("query_id"))
        few = only.orderBy("vec_id").limit(k + 1)  # all scores are 0: the smallest other ids win
        return q.join(F.broadcast(few), F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", F.lit(0).cast("long").alias("score"))
    sample = table.select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toArrow()
    sample_ids, sample_x = sample.column("vec_id").to_numpy(), _matrix(sample.column("x"))
    pivots = Pivots(sample_x, m2)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = pivots.distances(_matrix(batch.column(1)))
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near], pa.float64())], names=["vec_id", "x", "pivot", "dist"])

    keyed = table.select("vec_id", "x").mapInArrow(key, "vec_id bigint, x array<bigint>, pivot int, dist double")
    # The id breaks ties, so that equal vectors do not all meet in one range.
    index = cut(keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id"), "topk-index")

    queries = cut(table.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x")), "topk-queries")
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = []
    for block in range(n_blocks):
        # Blocks are cut by hash; one may be somewhat larger than QUERY_BLOCK.
        got = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block).select("vec_id", "x").toArrow()
        if not got.num_rows:
            continue
        ids, x = got.column("vec_id").to_numpy(), _matrix(got.column("x"))
        floor = np.full(len(ids), _NONE)
        for at in range(0, len(ids), 512):
            s = products(x[at : at + 512], sample_x)
            s[ids[at : at + 512][:, None] == sample_ids[None]] = _NONE
            if s.shape[1] >= k:
                floor[at : at + 512] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        sent = spark.sparkContext.broadcast((pivots, x, ids, floor))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pivots, x, ids, floor = sent.value
            most: tuple | None = None
            for batch in batches:  # sorted by pivot and distance
                if not batch.num_rows:
                    continue
                vec, mat, pivot, dist = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
                edges = np.flatnonzero(np.diff(pivot)) + 1
                cells = []
                for a, b in zip([0, *edges], [*edges, len(vec)]):
                    cells += [(int(pivot[c]), vec[c : min(c + ANNULUS, b)], mat[c : min(c + ANNULUS, b)], dist[c : min(c + ANNULUS, b)]) for c in range(a, b, ANNULUS)]
                start = floor if most is None else np.maximum(floor, most[0][:, -1])
                found = search_annuli(pivots, x, ids, start, cells, k)
                most = found if most is None else _top(np.concatenate([most[0], found[0]], 1), np.concatenate([most[1], found[1]], 1), k)
            if most is not None:
                real = (most[0] != _NONE) & (most[0] >= floor[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], real.shape)[real]), pa.array(most[1][real]), pa.array(most[0][real])], names=["query_id", "vec_id", "score"])

        parts.append(index.select("vec_id", "x", "pivot", "dist").mapInArrow(scan, _FOUND))
    if not parts:
        return spark.createDataFrame([], _FOUND)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

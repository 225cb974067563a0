"""Nearest neighbours by a block matrix join with int8 product tiles.

Vectors and queries are dealt into blocks; a tile is one block of each, and every query block
meets every vector block. Inside a tile both sides are int8 times a scale per vector, whose
rounding error is known exactly, so one integer matrix product bounds every distance from both
sides. Only pairs whose lower bound is within the k-th smallest upper bound are computed from
the original vectors, in double precision. Heaps keep each query's k nearest, per tile and then
over all tiles, so the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

K, EVERY = 10, 100
#: Vectors in a block: so many at least and at most, in between a 64th of all; queries in a block.
LEAST_BLOCK, MOST_BLOCK, QUERY_BLOCK = 2048, 65536, 4096
#: Elements of a product matrix held at once.
HELD = 1 << 21


def usable(v: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and the norms of what rounding left, a row each."""
    scale = np.abs(x).max(1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of rows to q, squares added one component after the other."""
    total = np.zeros(len(x))
    for j in range(len(q)):
        d = x[:, j] - q[j]
        total += d * d
    return np.sqrt(total)


def tile(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int = K) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """(query, its k nearest [(distance, id)]) among x; rows with the query's id are passed over."""
    with np.errstate(all="ignore"):
        xi, xs, xe = quantised(x)
        qi, qs, qe = quantised(q)
        kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # exact in both
        xf, xn = xi.astype(kind).T.copy(), (xi.astype(np.int64) ** 2).sum(1) * xs**2
        step = max(1, HELD // max(1, len(x)))
        for at in range(0, len(q), step):
            part = slice(at, at + step)
            dots = (qi[part].astype(kind) @ xf).astype(np.float64)
            mid = np.sqrt(np.maximum(0, xn + ((qi[part].astype(np.int64) ** 2).sum(1) * qs[part] ** 2)[:, None] - 2 * dots * xs * qs[part, None]))
            slack = xe + qe[part, None] + 1e-7 * (1 + mid)
            low, high = np.nan_to_num(mid - slack, nan=0.0, posinf=0.0), np.nan_to_num(mid + slack, nan=np.inf)
            for i, row in enumerate(high):
                own = ids == qids[at + i]
                row[own] = np.inf
                bound = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
                near = np.flatnonzero((low[i] <= bound) & ~own)
                found = zip(exact(x[near], q[at + i]).tolist(), ids[near].tolist(), strict=True)
                if best := heapq.nsmallest(k, found):
                    yield int(qids[at + i]), best


def _matrix(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return t.column("vec_id").to_numpy(), flat.astype(np.float64).reshape(-1, dim)


FOUND = pa.schema([("query_id", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64())])


def _tiles(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            dim = key[0].as_py()
            for query, best in tile(*_matrix(left, dim), *_matrix(right, dim), k):
                out += [(query, s, v) for s, v in best]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(FOUND)], schema=FOUND)

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}  # of (-distance, -id): the farthest is on top
        for b in batches:
            for q, s, v in zip(*(b.column(n).to_pylist() for n in ("query_id", "score", "vec_id")), strict=True):
                h = heaps.setdefault(q, [])
                if len(h) < k:
                    heapq.heappush(h, (-s, -v))
                else:
                    heapq.heappushpop(h, (-s, -v))
        rows = [(q, i + 1, -v, -s) for q, h in heaps.items() for i, (s, v) in enumerate(sorted(h, reverse=True))]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["query_id", "rank", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for vectors(vec_id, embedding) and queries of the same columns.

    Vectors null, zero or with null or non-finite components, and null ids, take no part. Only
    vectors of a query's own length are compared with it, never those of its own id. A query id
    that repeats is asked once, with the smallest of its vectors; repeated vector rows are
    candidates each. A query without candidates has no row; empty tables give none.
    """
    pick = lambda df: df.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.size("embedding").alias("dim"))
    x, q = pick(vectors), stored(pick(queries).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("m")).select("vec_id", "m.*"), "ann-queries")
    n, nq = x.count(), q.count()
    blocks = max(1, -(-n // min(MOST_BLOCK, max(LEAST_BLOCK, n // 64))))
    query_blocks = max(1, -(-nq // QUERY_BLOCK))
    block = lambda count, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count)).cast("int")
    x = x.withColumn("b", block(blocks, 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    q = q.withColumn("qb", block(query_blocks, 2)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = x.groupBy("dim", "b", "qb").cogroup(q.groupBy("dim", "b", "qb")).applyInArrow(_tiles(k), "query_id long, score double, vec_id long")
    return found.repartition("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth, by exact distance."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(e, e.filter(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, 
    -- one component after the other, as adding in another order changes the last bit
    sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY rank <= 10
"""

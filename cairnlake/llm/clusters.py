"""Centroid clustering of integer vectors, exact, with Hamerly's bounds.

Vectors become integers and are packed in chunks, once, into a table bucketed by chunk. Beside it
each round writes a small table of the same buckets: per vector its cluster, one upper bound of the
distance to its centroid and one lower bound of that to every other. Centroids that moved loosen the
bounds by their drift; a vector whose bounds still part keeps its cluster unread, any other gets a
full scan in integers. Only vectors that changed cluster send what they add and take, so sums stay
exact and the driver gets k * (components + 1) numbers a round, whatever the table's size. Equal
buckets on both sides mean that no round exchanges vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, stored, table

DIM, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Vectors of a chunk; bytes of vectors in a bucket; Spark takes no more buckets than MOST_BUCKETS.
CHUNK, BUCKET_BYTES, MOST_BUCKETS = 4096, 64 << 20, 100_000
#: Larger integers could take a squared distance out of 64 bits.
LARGEST = 1 << 27
#: Room for rounding in bounds.
EPS = 1e-12


def fit_for(v: Column, dim: int) -> Column:
    """Exactly dim components, none null or non-finite."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact for a power of two; an error where distances would leave 64 bits."""
    x = np.floor(x.astype(np.float64) * scale)
    if x.size and np.abs(x).max() > LARGEST:
        raise OverflowError(f"a component times {scale} is beyond {LARGEST}: squared distances would not fit 64 bits")
    return x.astype(np.int32)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of rows of x to rows of c."""
    x, c = x.astype(np.int64), c.astype(np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if most * most * x.shape[1] < 1 << 52 else np.int64  # products are exact in both
    dots = (x.astype(kind) @ c.T.astype(kind)).astype(np.int64)
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * dots


def _pack(dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            for start in range(0, b.num_rows, CHUNK):
                part = b.slice(start, CHUNK)
                x = integers(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
                ids = pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), ids, pa.array([x.tobytes()], pa.binary())], ["chunk", "ids", "x"])
                at += 1

    return run


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), upper and lower bound."""
    d = squared(x, c)
    own = d.argmin(1)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, own].astype(np.float64)) * (1 + EPS)
    d[rows, own] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1).astype(np.float64)) * (1 - EPS) if len(c) > 1 else np.full(len(x), np.inf)
    return own, upper, lower


def reassigned(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds after centroids moved to c by drift, and how many vectors were scanned."""
    own, upper, k = own.copy(), (upper + drift[own]) * (1 + EPS) + EPS, len(c)
    others = np.array([max((drift[j] for j in range(k) if j != i), default=0.0) for i in range(k)])
    lower = np.where(np.isinf(lower), lower, (lower - others[own]) * (1 - EPS) - EPS)
    gaps = squared(c, c).astype(np.float64)
    np.fill_diagonal(gaps, np.inf)
    apart = np.maximum(lower, np.sqrt(gaps.min(1))[own] / 2 * (1 - EPS))
    open_ = np.flatnonzero(upper >= apart)
    if len(open_):  # first the distance to the own centroid alone
        diff = x[open_].astype(np.int64) - c[own[open_]]
        upper[open_] = np.sqrt((diff * diff).sum(1).astype(np.float64)) * (1 + EPS)
        open_ = open_[upper[open_] >= apart[open_]]
    if len(open_):
        own[open_], upper[open_], lower[open_] = _nearest(x[open_], c)
    return own, upper, lower, len(open_)


STATE = "chunk long, cluster binary, upper binary, lower binary, change array<long>, scanned long"


def _assign(dim: int, c: np.ndarray, drift: np.ndarray | None):
    """The next state of each chunk. change: what its vectors add to and take from the clusters'
    counts and sums, k * (1 + dim) numbers; null if nothing changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(c)
        for b in batches:
            for r in range(b.num_rows):
                x = np.frombuffer(b.column("x")[r].as_buffer(), np.int32).reshape(-1, dim)
                if drift is None:
                    before, (own, upper, lower), scanned = None, _nearest(x, c), len(x)
                    moved = np.arange(len(x))
                else:
                    before = np.frombuffer(b.column("cluster")[r].as_buffer(), np.int32)
                    upper, lower = (np.frombuffer(b.column(n)[r].as_buffer(), np.float64) for n in ("upper", "lower"))
                    own, upper, lower, scanned = reassigned(x, before.astype(np.int64), upper, lower, c, drift)
                    moved = np.flatnonzero(own != before)
                change = np.zeros((k, dim + 1), np.int64)
                rows = np.concatenate([np.ones((len(moved), 1), np.int64), x[moved].astype(np.int64)], 1)
                for j in range(k):
                    change[j] += rows[own[moved] == j].sum(0)
                    if before is not None:
                        change[j] -= rows[before[moved] == j].sum(0)
                yield pa.RecordBatch.from_arrays(
                    [b.column("chunk").slice(r, 1)] + [pa.array([a.tobytes()], pa.binary()) for a in (own.astype(np.int32), upper, lower)] + [pa.array([change.ravel().tolist() if change.any() else None], pa.list_(pa.int64())), pa.array([scanned], pa.int64())],
                    ["chunk", "cluster", "upper", "lower", "change", "scanned"],
                )

    return run


def _distances(dim: int, c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = np.frombuffer(b.column("x")[r].as_buffer(), np.int32).reshape(-1, dim).astype(np.int64)
                own = np.frombuffer(b.column("cluster")[r].as_buffer(), np.int32)
                d = x - c[own]
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(r, 1).flatten(), pa.array(own), pa.array((d * d).sum(1))], ["vec_id", "cluster", "distance"])

    return run


class _Tables:
    """Bucketed tables of one run, dropped at its end; their files are in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.names.append(full := f"{name}_{uuid.uuid4().hex}")
        df.write.bucketBy(self.buckets, "chunk").option("path", fresh_path(self.spark, name)).saveAsTable(full)
        return self.spark.table(full)

    def drop(self) -> None:
        for n in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")


def clustered(vectors: DataFrame, dim: int = DIM, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for vectors(vec_id, embedding).

    Vectors null, of another length than dim, or with a null or non-finite component are left out.
    Rows that repeat a vec_id are vectors each; where such rows tie as first centroids, the smaller
    vector goes first. A null vec_id is clustered and returned but starts no centroid. With fewer
    than k vectors there are so many centroids; an empty table gives no rows. A component whose
    integer is beyond 2^27 is an error: its squared distances would not fit 64 bits. Only vec_id
    and embedding are read.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter(fit_for(F.col("v"), dim))
    first = kept.filter("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    c = integers(np.array([list(r.v) for r in first], np.float64), scale).astype(np.int64)
    k = len(c)
    buckets = int(min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), kept.count() * dim * 4 // BUCKET_BYTES)))
    tables = _Tables(spark, buckets)
    try:
        x = tables.put(kept.mapInArrow(_pack(dim, scale), "chunk long, ids array<long>, x binary").repartition(buckets, "chunk"), "cluster_vectors")
        state = tables.put(x.mapInArrow(_assign(dim, c, None), STATE), "cluster_state")
        total = [0] * (k * (dim + 1))
        for _ in range(rounds):
            for r in state.filter("change IS NOT NULL").select(F.posexplode("change").alias("i", "n")).groupBy("i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
                total[r.i] += int(r.n)
            each = [total[j * (dim + 1) : (j + 1) * (dim + 1)] for j in range(k)]
            new = np.array([[s // e[0] for s in e[1:]] if e[0] else c[j].tolist() for j, e in enumerate(each)], np.int64)
            if (new == c).all():
                break  # every later round is the same
            drift = np.sqrt(((new - c) ** 2).sum(1).astype(np.float64)) * (1 + EPS)
            c = new
            state = tables.put(x.join(state.select("chunk", "cluster", "upper", "lower"), "chunk").mapInArrow(_assign(dim, c, drift), STATE), "cluster_state")
        out = stored(x.join(state.select("chunk", "cluster"), "chunk").mapInArrow(_distances(dim, c), "vec_id long, cluster int, distance long"), "clusters")
    finally:
        tables.drop()
    sums = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows at most
    text = spark.createDataFrame([(j, ",".join(map(str, c[j].tolist()))) for j in range(k)], "cluster int, components string")
    per = sums.crossJoin(sums.agg(F.sum("cluster_inertia").alias("inertia"))).join(text, "cluster").select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return out.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten rounds."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Each round: the nearest centroid of every vector, then floors of means."""
    steps = [
        """WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS INTEGER) AS k, x AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY k < 8
)"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT n, vec_id, x, k, list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d
  FROM kept, c{r} QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, k) = 1
)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""m{r} AS MATERIALIZED (
  SELECT k, i, CAST(((s - ((s % m) + m) % m)) // m AS BIGINT) AS v
  FROM (SELECT k, i, sum(x[i]) AS s, count(*) AS m FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i)
), c{r + 1} AS MATERIALIZED (
  SELECT c{r}.k, COALESCE(g.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT k, list(v ORDER BY i) AS c FROM m{r} GROUP BY k) g ON c{r}.k = g.k
)"""
            )
    last = f"a{ROUNDS}"
    return ",\n".join(steps) + (
        f"\nSELECT vec_id, {last}.k AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY {last}.k) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} JOIN c{ROUNDS} ON {last}.k = c{ROUNDS}.k"
    )


ORACLE = _oracle()

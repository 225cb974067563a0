"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank.

Coarse centroids deal all vectors into lists; a vector is kept there with the codes of its residual
and the exact norm of what the codes leave out. Unit vectors whose cosine reaches the threshold lie
within a distance r. Of such a pair in two lists, one vector at least lies within r / 2 of the plane
halfway between both centroids, so a vector that probes every list whose plane is that near, and is
itself found by the others' probes, misses no link. In a list, distances come from tables of the
query's residual against the codebooks; the codes' error bounds them from below, and what may
reach the threshold is computed again from the vectors. Equal vectors are one class; long lists are
split in blocks, and a task gives each vector's links and the root of its component in the tile,
never a row a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import usable
from .common import stored, table
from .jaccard import components

LEAST = 0.95
#: The models are fitted on so many vectors at most; vectors a list; lists at most.
SAMPLE, LIST_VECTORS, MOST_LISTS = 16_384, 512, 1024
#: Subspaces of the residual and codes of each.
SPACES, CODES = 8, 256
#: Vectors of a list, and queries of it, that meet in one task.
BLOCK = 2048
#: Elements of a table of distances held at once; room for rounding in single precision.
HELD, EPS = 1 << 20, 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centroids of x, at most as many as x has rows; an empty one stays where it is."""
    rnd = np.random.default_rng(seed)
    c = x[rnd.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        count = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c


@dataclass
class Model:
    """For vectors of one length: centroids, and a codebook for each subspace of the residuals."""

    centroids: np.ndarray
    cuts: list[int]
    books: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> Model:
        """x: unit vectors, one at least."""
        c = np.unique(lloyd(x, lists, 10, 1), axis=0)
        rest = x - c[_distances(x, c).argmin(1)]
        cuts = np.linspace(0, x.shape[1], min(SPACES, x.shape[1]) + 1).astype(int).tolist()
        return cls(c, cuts, [lloyd(rest[:, a:b], CODES, 6, 2) for a, b in zip(cuts, cuts[1:], strict=False)])

    def place(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """The nearest list of each vector, and the lists it probes, its own first."""
        d = _distances(x, self.centroids)
        own = d.argmin(1)
        far = d - d[np.arange(len(x)), own][:, None]  # twice the gap times the distance to the plane halfway
        gaps = np.sqrt(np.maximum(0, _distances(self.centroids, self.centroids)))
        near = far <= 2 * (margin + EPS) * gaps[own]
        near[np.arange(len(x)), own] = False
        return own, [np.concatenate([own[i : i + 1], np.flatnonzero(near[i])]).astype(np.int32) for i in range(len(x))]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, a byte each, and the norm of what they leave out."""
        rest = x - self.centroids[own]
        codes, left = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = _distances(part, book).argmin(1)
            left += ((part - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def possible(self, q: np.ndarray, at: int, codes: np.ndarray, error: np.ndarray, reach: float) -> Iterator[tuple[int, np.ndarray]]:
        """Of the queries q against a list's codes, blocks of what may lie within reach: (first row, mask)."""
        rest, limit = (q - self.centroids[at]), (reach + error + EPS) ** 2
        step = max(1, HELD // max(1, len(codes)))
        for first in range(0, len(q), step):
            part = rest[first : first + step]
            total = np.zeros((len(part), len(codes)), np.float32)
            for m, book in enumerate(self.books):
                tables = _distances(part[:, self.cuts[m] : self.cuts[m + 1]], book).astype(np.float32)
                total += tables[:, codes[:, m]]
            yield first, total <= limit


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T)


def reach_of(least: float) -> float:
    """Distance of unit vectors whose cosine is least."""
    return float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-7


def _rows(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _index(models, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                t = b.filter(pa.array(dims == dim))
                model, x = models.value[int(dim)], _rows(t.column("v"), int(dim))
                own, probes = model.place(x, margin)
                codes, error = model.encode(x, own)
                made = [pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array([p.tolist() for p in probes], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([t.column(c) for c in ("cls", "rep", "n", "dim", "v")] + made, ["cls", "rep", "n", "dim", "v", "list", "codes", "error", "probes"])

    return run


FOUND = pa.schema([("cls", pa.int64()), ("root", pa.int64()), ("n", pa.int64())])


def _roots(a: np.ndarray, b: np.ndarray, name_a: np.ndarray, name_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest name in each one's component of the bipartite links (a[i], b[i])."""
    nodes, inverse = np.unique(np.concatenate([name_a, name_b]), return_inverse=True)
    x, y = inverse[: len(name_a)][a], inverse[len(name_a) :][b]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            root = nodes[label]
            return root[inverse[: len(name_a)]], root[inverse[len(name_a) :]]


def _tile(models, least: float):
    """Links of a block of a list's vectors with a block of those that probe the list."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            dim, at = key[0].as_py(), key[1].as_py()
            model = models.value[dim]
            y, q = _rows(left.column("v"), dim), _rows(right.column("q_v"), dim)
            codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(y), -1)
            hits = []
            for first, mask in model.possible(q, at, codes, left.column("error").to_numpy(), reach_of(least)):
                some, any_ = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
                if len(some):
                    close = (q[first + some] @ y[any_].T >= least) & mask[np.ix_(some, any_)]
                    i, j = np.nonzero(close)
                    hits.append((first + some[i], any_[j]))
            if hits:
                i, j = (np.concatenate([h[k] for h in hits]) for k in (0, 1))
                names_q, names_y = right.column("q_cls").to_numpy(), left.column("cls").to_numpy()
                home = right.column("q_list").to_numpy()
                probes = left.column("probes").combine_chunks()
                probed = np.zeros((len(y), len(model.centroids)), bool)
                probed[np.repeat(np.arange(len(y)), np.diff(probes.offsets.to_numpy())), probes.flatten().to_numpy()] = True
                # a pair of two lists that is found from both counts where the query's list comes first
                good = np.where(home[i] == at, names_q[i] != names_y[j], (home[i] < at) | ~probed[j, home[i]])
                i, j = i[good], j[good]
                n_q, n_y = right.column("q_n").to_numpy(), left.column("n").to_numpy()
                links_q, across = np.zeros(len(q), np.int64), home[i] != at
                links_y = np.zeros(len(y), np.int64)
                np.add.at(links_q, i, n_y[j])
                np.add.at(links_y, j[across], n_q[i[across]])  # within a list each asks for itself
                root_q, root_y = _roots(i, j, names_q, names_y)
                in_q, in_y = np.unique(i), np.unique(j)
                out = [np.concatenate([a[in_q], b[in_y]]) for a, b in ((names_q, names_y), (root_q, root_y), (links_q, links_y))]
        return pa.Table.from_arrays([pa.array(o, pa.int64()) for o in out], schema=FOUND)

    return run


def models_of(good: DataFrame, least: float) -> dict[int, Model]:
    """A model for each length of vectors, fitted on a bounded sample that is drawn by hash."""
    counts = {r.dim: r.n for r in good.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = {}
    for dim, n in counts.items():
        own = good.filter(F.col("dim") == dim).select("v")
        if n > SAMPLE:
            own = own.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < (SAMPLE << 20) // n)
        x = [r.v for r in own.limit(SAMPLE).collect()] or [[1.0] + [0.0] * (dim - 1)]
        found[dim] = Model.fit(np.unique(unit(np.array(x, np.float64)), axis=0), max(1, min(MOST_LISTS, n // LIST_VECTORS)))
    return found


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding).

    Vectors link from a cosine of least on, in double precision; only vectors of equal length do.
    Vectors null, zero or with null or non-finite components link with nothing; so do rows without
    a vec_id, whose component and kept are null. Rows that repeat a vec_id are vectors each, and
    link with each other if they are near. Only vec_id and embedding are read; an empty table gives
    an empty result.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    fine = usable(F.col("v")) & F.col("vec_id").isNotNull()
    good = raw.filter(fine).withColumn("dim", F.size("v"))
    models = spark.sparkContext.broadcast(models_of(good, least))
    margin = reach_of(least) / 2
    classes = good.groupBy("v", "dim").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("cls", F.monotonically_increasing_id())
    index = stored(classes.mapInArrow(_index(models, margin), f"cls long, rep long, n long, dim int, v {raw.schema['v'].dataType.simpleString()}, list int, codes binary, error double, probes array<int>"), "near-index")

    asks = index.select(*(F.col(c).alias(f"q_{c}") for c in ("cls", "n", "dim", "v", "list")), F.explode("probes").alias("probe"))
    blocks = lambda df, name: df.groupBy("dim", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = blocks(index, "ys").join(blocks(index.select("dim", F.explode("probes").alias("list")), "qs"), ["dim", "list"])  # a row a list
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lists = index.select("cls", "n", "dim", "v", "list", "codes", "error", "probes").join(F.broadcast(sizes), ["dim", "list"]).withColumn("y", deal("cls", "ys")).withColumn("q", spread("qs")).drop("ys", "qs")
    asked = sizes.select(F.col("dim").alias("q_dim"), F.col("list").alias("probe"), "ys", "qs")
    asks = asks.join(F.broadcast(asked), ["q_dim", "probe"]).withColumn("q_q", deal("q_cls", "qs")).withColumn("q_y", spread("ys")).drop("ys", "qs")
    found = stored(lists.groupBy("dim", "list", "y", "q").cogroup(asks.groupBy("q_dim", "probe", "q_y", "q_q")).applyInArrow(_tile(models, least), "cls long, root long, n long"), "near-links")

    links = found.groupBy("cls").agg(F.sum("n").alias("links"))
    comp = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), "near-cc")
    names = index.select("cls", "rep", "n")
    joined = names.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    joined = stored(joined.join(links, "cls", "left").select("cls", "comp", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "near-classes")
    lowest = joined.groupBy("comp").agg(F.min("rep").alias("component_id"))
    linked = joined.filter("n_links > 0").join(lowest, "comp").select("cls", "n_links", "component_id")
    # only vectors that link need their class: the others are their own component
    keyed = index.select("cls", "v").join(linked, "cls").select("v", "n_links", "component_id")
    rows = raw.withColumn("fine", fine)
    out = rows.filter("fine").join(keyed, "v", "left").unionByName(rows.filter("NOT fine").withColumns({"n_links": F.lit(None).cast("long"), "component_id": F.lit(None).cast("long")}))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS e,
    vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
  FROM embeddings
), u AS MATERIALIZED (
  SELECT n, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE fine
), links AS MATERIALIZED (
  SELECT a.n AS n, b.n AS m FROM u a JOIN u b ON a.n <> b.n AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT n, n AS m FROM u UNION SELECT reach.n, links.m FROM reach JOIN links ON reach.m = links.n
), comp AS (
  SELECT reach.n, min(u.vec_id) AS component_id FROM reach JOIN u ON reach.m = u.n GROUP BY reach.n
), degree AS (
  SELECT n, count(*) AS n_links FROM links GROUP BY n
)
SELECT vec_id, COALESCE(n_links, 0) AS n_links, COALESCE(component_id, vec_id) AS component_id, vec_id = COALESCE(component_id, vec_id) AS kept
FROM v LEFT JOIN degree USING (n) LEFT JOIN comp USING (n)
"""

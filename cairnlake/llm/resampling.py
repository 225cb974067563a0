"""Importance resampling towards a target distribution, by hashed word runs.

One scan of each text keeps the running CRC states of the last n starts: a word extends each by a
blank and itself, so every run of up to n words costs one step and no run is put together. The scan
emits the buckets of a text, sorted and packed, and a histogram for each task. The histograms of
corpus and target give a gain a bucket; a text's weight is the mean of its gains. Weight plus Gumbel
noise from the id's hash is the score, and the highest scores are drawn, ranked by range partitions.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stored, table

N, BUCKETS, SEED, SHARE, LEAST_WORDS = 2, 10_000, 7, 25, 20
#: Words of a text that are in hand at once.
BLOCK = 1 << 16
#: A-Z to a-z; ASCII that is neither letter nor digit to blanks; bytes of other letters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WORDS = re.compile(rb"[^ ]+")


def blocks(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, BLOCK at a time, and last what is left."""
    text = text.translate(_FOLD)
    if len(text) <= 2 * BLOCK:
        yield text.split()
        return
    found = []
    for m in _WORDS.finditer(text):
        found.append(m[0])
        if len(found) == BLOCK:
            yield found
            found = []
    yield found


def run_states(text: bytes, n: int = N) -> tuple[int, list[np.ndarray]]:
    """Number of words, and the CRC of every run of 1 to n words."""
    total, out, ring = 0, [], []  # ring[i]: the state of the run that began i + 1 words ago
    for words in blocks(text):
        total += len(words)
        states = list(map(zlib.crc32, words))
        grown: list[list[int]] = [states]
        out.append(np.array(states, np.uint32))
        for i in range(n - 1):
            # starts of the block before come first; each goes on by a blank, then by the next word
            carried = ring[i : i + 1] if i < len(ring) else []
            starts = carried + grown[i][:-1] if len(grown[i]) else []
            ends = words[len(words) - len(starts) :]
            longer = list(map(zlib.crc32, ends, map(zlib.crc32, repeat(b" "), starts)))
            grown.append(longer)
            out.append(np.array(longer, np.uint32))
        if words:
            ring = [g[-1] for g in grown[: n - 1] if g]
    return total, out


SCAN = "kind int, doc_id long, n_words long, n_features long, noise long, buckets binary"


def noise(doc_id: int, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scan(n: int, buckets: int, seed: int):
    """kind 0: a row for each text; kind 1: the histogram of all texts of the task."""
    narrow = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind, ids, words, features, noises, packed):
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([[kind] * len(ids), ids, words, features, noises, packed], kinds, strict=True)], ["kind", "doc_id", "n_words", "n_features", "noise", "buckets"])

        histogram = np.zeros(buckets, np.int64)
        for b in batches:
            held, size = [], 0
            for at in range(b.num_rows):
                doc, text = b.column("doc_id")[at].as_py(), b.column("text")[at].as_py()
                words, states = run_states((text or "").encode(), n)
                found = np.sort(np.concatenate(states) % buckets).astype(narrow) if states else np.zeros(0, narrow)
                histogram += np.bincount(found, minlength=buckets)
                packed = np.diff(found, prepend=narrow.type(0)).astype(narrow).tobytes()  # small steps: they compress
                held.append((doc, words, len(found), None if doc is None else noise(doc, seed), packed))
                size += len(packed)
                if size > 1 << 22:
                    yield rows(0, *map(list, zip(*held, strict=True)))
                    held, size = [], 0
            if held:
                yield rows(0, *map(list, zip(*held, strict=True)))
        yield rows(1, [None], [0], [int(histogram.sum())], [None], [histogram.astype("<i8").tobytes()])
        release()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histograms of many tasks as one, bucket by bucket."""
    total = None
    for b in batches:
        for x in b.column("buckets"):
            h = np.frombuffer(x.as_buffer(), "<i8")
            total = h.copy() if total is None else total + h
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])


def _weigh(gains: list[int], buckets: int):
    narrow, gain = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4"), np.array(gains, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights = []
            for x in b.column("buckets"):
                found = np.cumsum(np.frombuffer(x.as_buffer(), narrow), dtype=np.int64)
                weights.append(int(gain[found].sum()) // len(found) if len(found) else 0)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in ("doc_id", "n_words", "n_features", "noise")] + [pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "noise", "weight"])

    return run


def gain(s: int, total: int, t: int, target_total: int, buckets: int) -> int:
    return math.floor(1000 * math.log(float((t + 1) * (total + buckets)) / float((s + 1) * (target_total + buckets))))


def scored(documents: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for each row of documents(doc_id, text), towards target(text)."""
    scans = [stored(df.mapInArrow(_scan(n, buckets, seed), SCAN), name) for df, name in ((documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "resample-scan"), (target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "resample-target"))]
    counts = []
    for s in scans:
        each = s.filter("kind = 1").select("buckets").mapInArrow(_added, "bucket long, n long")
        counts.append({r.bucket: int(r.n) for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect()})  # a row a bucket at most
    source, aim = counts
    total, target_total = sum(source.values()), sum(aim.values())
    gains = [gain(source.get(b, 0), total, aim.get(b, 0), target_total, buckets) for b in range(buckets)]
    weighed = scans[0].filter("kind = 0").drop("kind").mapInArrow(_weigh(gains, buckets), "doc_id long, n_words long, n_features long, noise long, weight long")
    return weighed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))


def resampled(documents: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: of the texts with least_words words and more, share percent are drawn.

    A null or empty text, or one without words, has no features and weight 0. A null doc_id has a
    weight, but no score and no rank; it counts among the texts drawn from. Rows that repeat a
    doc_id are texts each; equal score and doc_id rank in any order, their rows being alike but for
    n_features and weight. An empty table gives no rows; an empty target favours rare buckets.
    """
    spark = documents.sparkSession
    all_ = stored(scored(documents, target, n, buckets, seed), "resample-scored")
    enough = F.col("n_words") >= least_words
    draws = share * all_.filter(enough).count() // 100
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fit = all_.filter(enough & F.col("score").isNotNull())
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc(), F.col("weight").asc()]
    placed = fit.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n_features", "weight", "score", F.spark_partition_id().alias("p"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("at"))
    placed = stored(placed, "resample-placed")
    before, starts = 0, []
    for r in placed.groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():  # one row a partition
        starts.append((r.p, before))
        before += r.n
    offsets = spark.createDataFrame(starts, "p int, before long")
    rank = F.col("before") + F.col("at") + 1
    ranked = placed.join(F.broadcast(offsets), "p").select("doc_id", "n_features", "weight", "score", F.when(rank <= draws, rank).alias("rank"))
    rest = all_.filter(~enough | F.col("score").isNull()).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents, drawn towards the benchmark's texts."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = """
WITH bits AS MATERIALIZED (
  -- the table of the CRC with polynomial 0xEDB88320: eight halvings of each byte
  SELECT list(list_reduce(list_concat([CAST(b AS BIGINT)], range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
), texts AS MATERIALIZED (
  SELECT 0 AS kind, row_number() OVER () AS n, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), runs AS MATERIALIZED (
  SELECT kind, n, f, count(*) AS c FROM (
    SELECT kind, n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts
  ) GROUP BY ALL
), names AS MATERIALIZED (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)
), crc AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, len(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[xor(a % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM names, bits
), held AS MATERIALIZED (
  SELECT kind, n, bucket, sum(c) AS c FROM runs JOIN crc USING (f) GROUP BY ALL
), totals AS (
  SELECT COALESCE(sum(c) FILTER (kind = 0), 0) AS s_all, COALESCE(sum(c) FILTER (kind = 1), 0) AS t_all FROM held
), gains AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT bucket, COALESCE(sum(c) FILTER (kind = 0), 0) AS s, COALESCE(sum(c) FILTER (kind = 1), 0) AS t FROM held GROUP BY bucket), totals
), weights AS (
  SELECT n, CAST(sum(c) AS BIGINT) AS m, CAST(sum(c * gain) AS BIGINT) AS g FROM held JOIN gains USING (bucket) WHERE kind = 0 GROUP BY n
), rows_ AS (
  SELECT doc_id, len(w) AS words, COALESCE(m, 0) AS n_features, CASE WHEN m > 0 THEN (g - ((g % m) + m) % m) // m ELSE 0 END AS weight,
    CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM texts LEFT JOIN weights USING (n) WHERE kind = 0
), scored AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM rows_
), ranked AS (
  SELECT *, CASE WHEN words >= 20 AND score IS NOT NULL THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC NULLS LAST, doc_id) END AS r,
    25 * (count(*) FILTER (words >= 20) OVER ()) // 100 AS most FROM scored
)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN r <= most THEN r END AS rank FROM ranked
"""

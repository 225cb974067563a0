"""Clustering, near-duplicate vectors and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from cairnlake.llm import clusters, near_vectors, resampling
from cairnlake.llm.jaccard import components

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"embedding {kind}, label int, distance string, vec_id long").repartition(3)


def odd(dim):
    """Vectors that take no part: null, empty, of another length, with null or non-finite components."""
    return [(None, 1, "x", 9001), ([], 1, "x", 9002), ([1.0] * (dim + 1), 1, "x", 9003), ([1.0] * (dim - 1) + [None], 1, "x", 9004), ([NAN] + [1.0] * (dim - 1), 1, "x", 9005), ([INF] * dim, 1, "x", 9006)]


def brute_clusters(rows, dim, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for v, _, _, i in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    c = [x for _, x in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    assign = lambda: [min(range(len(c)), key=lambda j: (far(x, c[j]), j)) for _, x in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            if mine := [x for (_, x), o in zip(kept, own, strict=True) if o == j]:
                c[j] = [sum(s) // len(mine) for s in zip(*mine, strict=True)]
    own = assign()
    d = [far(x, c[o]) for (_, x), o in zip(kept, own, strict=True)]
    return sorted((-1 if i is None else i, o, e, sum(f for f, p in zip(d, own, strict=True) if p == o), sum(d), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _), o, e in zip(kept, own, d, strict=True))


def got_clusters(df, dim, k, rounds):
    out = clusters.clustered(df, dim, k, rounds)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in out.collect())


@pytest.mark.parametrize("seed,k,rounds", [(1, 4, 10), (2, 7, 3)])
def test_clusters_equal_brute_force(spark, seed, k, rounds):
    rnd = random.Random(seed)
    dim, f = 6, lambda x: float(np.float32(x))
    centers = [[rnd.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows = [([f(x + rnd.gauss(0, 0.2)) for x in rnd.choice(centers)], 1, "x", i) for i in range(300)]
    rows += [([f(rnd.randrange(-2, 3) / 2) for _ in range(dim)], 1, "x", 400 + i) for i in range(60)]  # ties
    rows += [([0.0] * dim, 1, "x", 7), ([0.0] * dim, 1, "x", 7), ([0.5] * dim, 1, "x", None)] + rows[:40] + odd(dim)
    assert got_clusters(frame(spark, rows), dim, k, rounds) == brute_clusters(rows, dim, k, rounds)


def test_clusters_of_few_and_of_large(spark):
    assert got_clusters(frame(spark, []), 4, 8, 10) == [] == got_clusters(frame(spark, odd(4)), 4, 8, 10)
    rows = [([100000.0, -100000.0, 3.0, 0.1], 1, "x", 1), ([-100000.0, 100000.0, 3.0, -0.1], 1, "x", 2), ([1.0, 1.0, 1.0, 1.0], 1, "x", 3)]
    assert got_clusters(frame(spark, rows, "array<double>"), 4, 8, 10) == brute_clusters(rows, 4, 8, 10)
    assert spark.sql("SHOW TABLES").filter("tableName like 'cluster%'").count() == 0


def test_bounds_spare_scans():
    """A vector whose bounds part keeps its cluster without a scan, and any other is right."""
    rnd = np.random.default_rng(5)
    c = rnd.integers(-1000, 1000, (8, 16))
    x = (c[rnd.integers(0, 8, 4000)] + rnd.integers(-150, 150, (4000, 16))).astype(np.int32)
    own, upper, lower = clusters._nearest(x, c)
    for step in (3, 40, 400):
        new = c + rnd.integers(-step, step + 1, c.shape)
        own, upper, lower, scanned = clusters.reassigned(x, own, upper, lower, new, np.sqrt(((new - c) ** 2).sum(1)))
        d = clusters.squared(x, new)
        assert (own == d.argmin(1)).all() and (upper >= np.sqrt(d[np.arange(4000), own]) * (1 - 1e-12)).all()
        d[np.arange(4000), own] = 1 << 60
        assert (lower <= np.sqrt(d.min(1)) * (1 + 1e-12)).all() and (scanned < 400 or step == 400)
        c = new


def brute_near(rows, least=0.95):
    fine = [v is not None and i is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v, _, _, i in rows]
    u = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None for (v, *_), ok in zip(rows, fine, strict=True)]
    n = len(rows)
    near = [[b for b in range(n) if b != a and fine[a] and fine[b] and len(u[a]) == len(u[b]) and u[a] @ u[b] >= least] for a in range(n)]
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            todo += (new := [b for b in near[todo.pop()] if b not in seen])
            seen.update(new)
        i = rows[a][3]
        low = min(rows[b][3] for b in seen) if i is not None else None
        out.append((i, len(near[a]), low, None if i is None else i == low))
    return sorted(out, key=repr)


def near_rows(seed, dim, n):
    rnd = random.Random(seed)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:  # a step away from an earlier one: chains and near misses
            v = [x + rnd.gauss(0, rnd.choice([0.03, 0.1, 0.2, 0.3]) / math.sqrt(dim)) for x in rnd.choice(rows)[0]]
        else:
            v = [rnd.gauss(0, 1) / math.sqrt(dim) for _ in range(dim)]
        rows.append((f(v), 1, "x", i * 7 + (5 << 60)))
    rows += [(f([3 * x for x in rows[0][0]]), 1, "x", 3)] + [(rows[1][0], 1, "x", 900 + i) for i in range(9)]
    rows += [(rows[2][0], 1, "x", rows[3][3]), (rows[4][0], 1, "x", None), ([0.0] * dim, 1, "x", 11), ([1.0, 0.0], 1, "x", 12), ([0.99, 0.01], 1, "x", 13)]
    return rows + [r for r in odd(dim) if r[3] != 9003]


@pytest.mark.parametrize("seed,dim,lists,block", [(1, 8, 16, 37), (2, 24, 60, 2048)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, seed, dim, lists, block):
    rows = near_rows(seed, dim, 500)
    monkeypatch.setattr(near_vectors, "LIST_VECTORS", len(rows) // lists)
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    got = near_vectors.near_vectors(frame(spark, rows).drop("distance").withColumnRenamed("label", "n"))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_near(rows)


def test_near_vectors_of_none(spark):
    assert near_vectors.near_vectors(frame(spark, [])).collect() == []
    assert sorted(tuple(r) for r in near_vectors.near_vectors(frame(spark, [([0.0], 1, "x", 2), (None, 1, "x", 1)])).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_components_of_large_ids(spark):
    top = (1 << 63) - 1
    edges = [(top - i, top - i - 1) for i in range(40)] + [(7, 7), (3, 5), (5, 3), (-9, 3)]
    got = {(r.node, r.comp) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(top - i, top - 40) for i in range(41)} | {(3, -9), (5, -9), (-9, -9)}


def brute_runs(text, n=2):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + m]) for m in range(1, n + 1) for i in range(len(words) - m + 1)]


TEXTS = [None, "", " \n", "One", "one TWO", "É é ß x\x7fy a-b 1.5", "x" * 300_000, "word " * 30_000, "a\x00b\tc"]


@pytest.mark.parametrize("n,block", [(1, 4), (2, 3), (2, 1 << 16), (3, 1), (4, 5)])
def test_run_states(monkeypatch, n, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    for text in [*TEXTS, "some more words of a text that takes several blocks"]:
        words, runs = brute_runs(text, n)
        got, states = resampling.run_states((text or "").encode(), n)
        assert got == words and sorted(np.concatenate(states).tolist()) == sorted(zlib.crc32(r.encode()) for r in runs)


@pytest.mark.parametrize("aim", [["gamma delta words", None, "one two"], []])
def test_resampled_equals_brute_force(spark, aim):
    rnd = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "été", "42", "words"]
    texts = TEXTS + [" ".join(rnd.choices(vocabulary, k=rnd.choice([5, 19, 20, 21, 60]))) for _ in range(80)]
    rows = [(t, i % 3, i) for i, t in enumerate(texts)] + [(texts[20], 0, 20), (texts[30], 0, None)]
    df = spark.createDataFrame(rows, "text string, rank int, doc_id long").repartition(4)
    buckets = 500
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    held = [(i, *brute_runs(t)) for t, _, i in rows]
    s, t = ([0] * buckets for _ in range(2))
    for side, features in [(s, f) for _, _, f in held] + [(t, brute_runs(a)[1]) for a in aim]:
        for f in features:
            side[crc(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    want = []
    for i, words, features in held:
        weight = sum(gain[crc(f)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(features), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    enough = [r for r in want if r[5] >= 20]
    for rank, r in enumerate(sorted((r for r in enough if r[3] is not None), key=lambda r: (-r[3], r[0]))[: 25 * len(enough) // 100], 1):
        r[4] = rank
    out = resampling.resampled(df, spark.createDataFrame([(a,) for a in aim], "text string"), buckets=buckets)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted((tuple(r[:5]) for r in want), key=repr)


def test_resampled_of_none(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resampled(empty, empty).collect() == []

"""Nearest neighbours and the Jaccard join against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import ann, jaccard
from cairnlake.llm.shingles import Shingler, split_sets


def brute_sets(texts):
    blank = "".join(map(chr, (32, *range(9, 14))))
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        words = [w for w in low.translate(str.maketrans(dict.fromkeys(blank, " "))).split(" ") if w]
        out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set())
    return out


def brute_components(ids, texts):
    sets, root = brute_sets(texts), {i: i for i in ids if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if ids[a] is not None and ids[b] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i) if i is not None else None) for i, s in zip(ids, sets, strict=True)}


def corpus(seed=7, n=260):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rnd.choices(vocabulary, k=60)
    texts = [None, "", " \t\n", "one", "ONE", "a b c d", "A b\x0bc  d", "é É e", "a b c d e", "x\x1cy b c d e", "word " * 3000]
    for _ in range(n // 4):
        words = rnd.choices(vocabulary, k=rnd.choice([5, 6, 7, 8, 9, 12, 20, 45, 120, 300]))
        if rnd.random() < 0.5:
            at = rnd.randrange(len(words))
            words[at:at] = passage
        texts.append(" ".join(words))
        for _ in range(3):
            near = list(words)
            for _ in range(rnd.randrange(0, 1 + len(near) // 40)):
                near[rnd.randrange(len(near))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                near = near[: -max(1, len(near) // 6)]
            texts.append(" ".join(near).upper() if rnd.random() < 0.2 else " ".join(near))
    return texts


def test_components(spark):
    texts = corpus()
    ids = list(range(100, 100 + len(texts)))
    random.Random(1).shuffle(ids)
    ids[0] = None
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, rep int, component_id string")
    got = [tuple(r) for r in jaccard.jaccard_components(df).collect()]
    assert set(got) == brute_components(ids, texts) and len(got) == len(texts)


def test_components_with_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "LOCAL", 1)
    monkeypatch.setattr(jaccard, "TASK_SIGNATURES", 2000)
    texts = corpus(11)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {tuple(r) for r in jaccard.jaccard_components(df).collect()} == brute_components(list(range(len(texts))), texts)


def test_components_of_large_ids(spark, monkeypatch):
    """Ids near the ends of 64 bits, and more tasks than 16 bits could tell apart."""
    monkeypatch.setattr(jaccard, "TASK_SIGNATURES", 1)
    texts = corpus(5, 40)
    ids = [(1 << 62) + 977 * i if i % 2 else 977 * i - (1 << 63) for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert {tuple(r) for r in jaccard.jaccard_components(df).collect()} == brute_components(ids, texts)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(df).collect() == []
    assert {tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame([(1, None), (2, "")], df.schema)).collect()} == {(1, 0, 1), (2, 0, 2)}


def test_signatures_guarantee_links():
    rnd = np.random.default_rng(3)
    none = np.zeros(0, np.uint64)
    for size in [2, 3, 4, 5, 7, 8, 11, 16, 23, 40, 64, 91, 200, 700] * 6:
        a = np.unique(rnd.integers(0, 1 << 52, size, dtype=np.uint64))
        cut = rnd.integers(0, len(a) // 7 + 1)
        fresh = np.unique(rnd.integers(0, 1 << 52, rnd.integers(0, len(a) // 8 + 1), dtype=np.uint64))
        b = np.unique(np.concatenate([rnd.permutation(a)[cut:], fresh]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            hot = np.sort(rnd.permutation(a)[: rnd.integers(0, len(a) + 1)])
            for frequent in (none, hot):
                (x, m), (y, n) = jaccard.all_signatures(a, frequent), jaccard.all_signatures(b, frequent)
                _, i, j = np.intersect1d(x, y, return_indices=True)
                sizes, none_at = np.array([len(a), len(b)]), np.array([0])
                assert any(jaccard.possible(sizes, np.array([m[p], n[q]]), none_at, np.array([2])).all() for p, q in zip(i, j, strict=True))


def test_shingles_do_not_depend_on_batches():
    s, texts = Shingler(), ["a b c d e f", "", "b c d e f g h", "x"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    elements, bounds = split_sets(s.sets(np.frombuffer(b"".join(raw), np.uint8), offsets), 4)
    for i, r in enumerate(raw):
        alone, _ = split_sets(s.sets(np.frombuffer(r, np.uint8), np.array([0, len(r)])), 1)
        assert alone.tolist() == elements[bounds[i] : bounds[i + 1]].tolist()
    assert np.diff(bounds).tolist() == [2, 0, 3, 1]


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 4), (7, 7)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], []])
def test_graph_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.comp for r in jaccard.components(df).collect()}
    want = {}
    for a, b in edges:
        if a != b:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_nearest(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(7)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(400, rows[3][1]), (500, None), (600, [0.0] * 7), (700, [1.0, None]), (701, [math.nan]), (702, [math.inf]), (703, []), (800, [1.0, 2.0]), (801, [1.5, 2.0]), (900, [3.0]), (1100, [1e200] * 7), (1101, [1e-200] * 7)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, query_id string")
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    want = set()
    for q, v in good:
        if q % 100 == 0:
            near = []
            for i, w in good:
                if i != q and len(v) == len(w):
                    total = 0.0
                    for a, b in zip(w, v, strict=True):
                        total += (a - b) * (a - b)
                    near.append((math.sqrt(total), i))
            want |= {(q, n, i, d) for n, (d, i) in enumerate(sorted(near)[:10], 1)}
    got = {tuple(r) for r in ann.nearest(df, df.filter(F.col("vec_id") % 100 == 0)).collect()}
    assert got == want
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []


def test_nothing_in_common(spark):
    """No two sets share a signature, and a table of copies of one text only."""
    far = spark.createDataFrame([(i, " ".join(f"{i}x{k}" for k in range(30))) for i in range(20)], "doc_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_components(far).collect()} == set(range(20))
    same = spark.createDataFrame([(i, "a b c d e f g") for i in range(40)], "doc_id long, text string").repartition(7)
    assert {(r.n_shingles, r.component_id) for r in jaccard.jaccard_components(same).collect()} == {(3, 0)}


def test_repeated_rows(spark):
    """Rows that repeat a doc_id and its text are one node, and every row has its component."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, 1), (5, text, 2), (3, text + " end", 1), (9, "other words that stand alone here", 1), (None, text, 1), (4, None, 1), (4, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, comp int")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=str)
    want = sorted([(False, 5, 26, 3), (False, 5, 26, 3), (False, 3, 27, 3), (False, 9, 2, 9), (True, 0, 26, None), (False, 4, 0, 4), (False, 4, 0, 4)], key=str)
    assert got == want


def test_blocks_of_near_copies(spark, monkeypatch):
    """A blurred group, compared in many small blocks, against brute force."""
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 7)
    rnd = random.Random(31)
    base = [f"b{i}" for i in range(40)]
    texts = []
    for _ in range(90):
        words = list(base)
        for _ in range(rnd.randrange(0, 4)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(12)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {tuple(r) for r in jaccard.jaccard_components(df).collect()} == brute_components(list(range(len(texts))), texts)

"""N-gram Jaccard join by PartEnum signatures: exact components of similar shingle sets.

Two sets link when 100 |A∩B| >= 75 |A∪B|. Then |AΔB| <= (|A| + |B|) / 7. Sizes fall into bands of ratio √2; a set signs in its own band and, where a larger
partner may be in the next, in that one too. In a band the shingles are dealt over `parts`
parts of three cells. If fewer than 2 * parts differences fall on the parts, some part has at
most one of its three cells changed, so two cells agree: every pair of cells of each part is
enumerated as a signature (PartEnum with n2 = 3, k2 = 1). Cells that are empty agree for
nothing, so a set counts its parts with two or more filled cells; twice that count beyond the
most differences guarantees a common signature that isn't empty. Sets that can't guarantee it
also sign their prefix: |A| - ⌈3|A|/4⌉ + 1 shingles in one order common to all sets; two such
sets that link share one of these.

Shingles that many sets have (passages repeated all over) are left out of the parts and come
last in the prefix. That loses nothing, as leaving shingles out only lowers differences while
the bound stays, and any choice of shingles is valid; it keeps the buckets small.

Equal sets are one node, and one of them signs. In a bucket every node pairs with one center (a
star). Pairs are verified on the whole texts. Where a bucket's nodes are then still in several
components, all its pairs across components are verified too, so no link between components is
missed: block against block inside a task, so that such pairs never become rows. "Exact" means
that shingles are told apart by 52 bits of their hash.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, remembered, stored, table
from .shingles import Shingler, mix, split_sets, texts

#: Similarity in hundredths; signatures a reducing task holds, about twice; signatures that a
#: signing task holds before it sends them.
LEAST, TASK_SIGNATURES, SENT_SIGNATURES = 75, 250_000, 600_000
#: A shingle is frequent from so many sets on; a task reports those it saw in LOCAL sets; the
#: most frequent MOST_FREQUENT of them are used (8 bytes each on every executor).
FREQUENT, LOCAL, MOST_FREQUENT = 6, 2, 1_000_000
#: Distinct shingles a task counts before it forgets those seen once; texts held by verification.
COUNTED, HELD_TEXTS = 1_000_000, 64
#: Ids of documents in pairs to verify that are broadcast, 8 bytes each; more are joined.
BROADCAST_IDS = 1_000_000
#: Nodes and their shingles that one comparing task holds twice, about.
BLOCK_NODES, BLOCK_SHINGLES = 512, 200_000
RATIO, STEP = 2**0.5, 1.05


def band(size: int) -> int:
    return int(np.floor(np.log(size) / np.log(RATIO) + 1e-9))


def parts_of(level: int) -> int:
    """Parts of a band: somewhat over the seventh of its largest size that the most differences
    ask for, as some parts stay too empty."""
    return max(1, int(np.ceil(0.17 * RATIO ** (level + 1))))


def most_differences(size: int, level: int) -> int:
    """|AΔB| <= (|A| + |B|) / 7 for a set and any it links with in the band."""
    return (size + min(100 * size // LEAST, int(np.ceil(RATIO ** (level + 1))))) // 7


def among(elements: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which elements are in the sorted known ones, by bisection: known may be long."""
    if not len(known):
        return np.zeros(len(elements), bool)
    return known[np.minimum(np.searchsorted(known, elements), len(known) - 1)] == elements


def signatures(elements: np.ndarray, level: int, frequent: np.ndarray) -> tuple[np.ndarray, bool]:
    """A set's PartEnum signatures in a band, and whether they alone guarantee its links."""
    n, parts = len(elements), parts_of(level)
    elements = elements[~among(elements, frequent)]
    h = mix(elements + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    cell = (h >> np.uint64(32)).astype(np.int64) % (3 * parts)
    values = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    # sums modulo 2**64, so exact: in floats they would round
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1]])) if len(cell) else np.zeros(0, int)
    sums = np.zeros(3 * parts, np.uint64)
    filled = np.zeros(3 * parts, bool)
    if len(cell):
        at = cell[order][starts]
        sums[at] = np.add.reduceat(values[order], starts)
        filled[at] = True
    sums, filled = sums.reshape(parts, 3), filled.reshape(parts, 3)
    i = np.arange(parts, dtype=np.uint64) * np.uint64(4)
    out = []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        on = filled[:, a] | filled[:, b]
        salt = mix(i[on] + np.uint64(pair) + np.uint64(level << 40))
        out.append(mix(salt ^ (sums[on, a] + mix(sums[on, b] + np.uint64(1)))))
    sure = 2 * int((filled.sum(1) >= 2).sum()) > most_differences(n, level)
    return np.concatenate(out), sure


def prefix(elements: np.ndarray, frequent: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Signatures of the first |A| - ⌈least |A| / 100⌉ + 1 shingles, frequent ones last."""
    n = len(elements)
    last = among(elements, frequent)
    h = mix(elements ^ np.uint64(0x2545F4914F6CDD1D))
    order = np.lexsort((h, last))
    return mix(h[order[: n - -(-least * n // 100) + 1]] + np.uint64(0x632BE59BD9B4E019))


def all_signatures(elements: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's signatures, and how many shingles come before each in its prefix (0 for those of
    parts). If a signature is the first that two sets share, what comes before isn't common."""
    n = len(elements)
    own, sure = signatures(elements, band(n), frequent)
    out = [own]
    if (up := band(int(n * 100 // LEAST))) != band(n):
        more, sure_up = signatures(elements, up, frequent)
        out.append(more)
        sure &= sure_up
    skipped = np.zeros(sum(map(len, out)), np.int64)
    if not sure:
        out.append(prefix(elements, frequent))
        skipped = np.concatenate([skipped, np.arange(len(out[-1]))])
    sig, at = np.unique(np.concatenate(out), return_index=True)
    return sig, skipped[at]


def size_level(n: int) -> int:
    """A set's size in one byte, by steps of STEP."""
    return min(255, int(np.log(n) / np.log(STEP) + 1e-9))


def size_bounds() -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest size that a level can stand for."""
    low = np.floor(STEP ** np.arange(256) * (1 - 1e-9)).astype(np.int64)
    high = np.ceil(STEP ** np.arange(1, 257) * (1 + 1e-9)).astype(np.int64)
    high[255] = 1 << 40
    return np.maximum(low, 1), high


def possible(size: np.ndarray, skipped: np.ndarray, starts: np.ndarray, counts: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
    """Members of buckets that may have a partner there: two sets of a and b shingles that link
    have 3 (a + b) / 7 in common at least, all behind the shingles skipped; b is 3 a / 4 at least,
    and no smaller than the bucket's smallest. Where sizes are known within bounds, size is the
    upper and low the lower one."""
    low = size if low is None else low
    smallest = np.repeat(np.minimum.reduceat(low, starts), counts)
    other = np.maximum(-(-LEAST * low // 100), smallest)
    return (size - skipped) * (100 + LEAST) >= LEAST * (size + other)


# --- passes over the texts ---


SCAN = "kind int, doc_id long, n_shingles long, h1 long, h2 long"


def _set_hashes(elements: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two 64-bit hashes of each set, in which order plays no part."""
    n = np.diff(bounds)
    h1, h2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(elements):
        on = n > 0
        a = mix(elements + np.uint64(0xA24BAED4963EE407))
        h1[on] = np.add.reduceat(a, bounds[:-1][on])
        h2[on] = np.bitwise_xor.reduceat(mix(a + np.uint64(0x9FB21C651E98DF25)), bounds[:-1][on])
    return n, h1.view(np.int64), h2.view(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a row per text. Kind 1: shingles (h1) that several of the task's sets have, with
    their number of sets (n_shingles)."""
    shingler, seen = Shingler(), set()
    known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []

    def settle() -> None:
        nonlocal known, counts, held
        if held:
            new, n = np.unique(np.concatenate(held), return_counts=True)
            both, at = np.unique(np.concatenate([known, new]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
            known, held = both, []
            if len(known) > COUNTED:
                known, counts = known[counts > 1], counts[counts > 1]

    for b in batches:
        ids = b.column("doc_id")
        for i, j, data, offsets in texts(b.column("text")):
            elements, bounds = split_sets(shingler.sets(data, offsets), j - i)
            n, h1, h2 = _set_hashes(elements, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int32)), ids[i:j], pa.array(n), pa.array(h1), pa.array(h2)], ["kind", "doc_id", "n_shingles", "h1", "h2"])
            for k in np.flatnonzero(n):
                if (key := (int(h1[k]), int(n[k]))) not in seen:  # equal sets count once
                    seen.add(key)
                    held.append(elements[bounds[k] : bounds[k + 1]])
            if sum(map(len, held)) > COUNTED // 4:
                settle()
    settle()
    on = counts >= LOCAL
    m = int(on.sum())
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(np.zeros(m, np.int64)), pa.array(counts[on]), pa.array(known[on].view(np.int64)), pa.array(np.zeros(m, np.int64))], ["kind", "doc_id", "n_shingles", "h1", "h2"])
    release()


def planes(x: np.ndarray) -> bytes:
    """All first bytes, all second bytes and so on: what compresses well stands together."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str, n: int, at: int = 0) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, width * n, at).reshape(width, n).T).view(kind).ravel()


def _sign(tasks: int, frequent):
    """A row per task p to come: signatures' low 32 bits (p follows from the other 32, so that two
    signatures meet by chance as rarely in each of many tasks as in few; that is only one more
    pair to verify), shares of rare shingles, levels of size, prefix
    places and differences of ids, byte plane by byte plane, as many bytes whatever p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, hot = Shingler(), set(), frequent.value
        docs, sigs, skips, held = [], [], [], 0

        def blocks() -> Iterator[pa.RecordBatch]:
            if not sigs:
                return
            each = [len(x) for x in sigs]
            spread = lambda i, t: np.repeat(np.array([d[i] for d in docs], t), each)
            sig, skip, doc, size, rare = np.concatenate(sigs), np.concatenate(skips).astype("<u4"), spread(0, np.int64), spread(1, np.uint8), spread(2, np.uint8)
            to = ((sig >> np.uint64(32)) * np.uint64(tasks) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            there, first = np.unique(to[order], return_index=True)
            rows = []
            for p, on in zip(there, np.split(order, first[1:]), strict=True):
                low = (sig[on] & np.uint64(0xFFFFFFFF)).astype("<u4")
                rows.append((int(p), len(on), b"".join((low.tobytes(), rare[on].tobytes(), size[on].tobytes(), planes(skip[on]))), planes(np.diff(doc[on], prepend=0).astype("<i8"))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["p", "n", "sig", "doc"])

        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for i, j, data, offsets in texts(b.column("text")):
                elements, bounds = split_sets(shingler.sets(data, offsets), j - i)
                n, h1, _ = _set_hashes(elements, bounds)
                for k in np.flatnonzero(n):
                    key = (int(h1[k]), int(n[k]))
                    if ids[i + k] is None or key in seen:  # equal sets sign once in a task
                        continue
                    seen.add(key)
                    own = elements[bounds[k] : bounds[k + 1]]
                    s, skipped = all_signatures(own, hot)
                    docs.append((ids[i + k], size_level(len(own)), int(255 * (1 - among(own, hot).mean()))))
                    sigs.append(s)
                    skips.append(skipped)
                    held += len(s)
                if held > SENT_SIGNATURES:
                    yield from blocks()
                    docs, sigs, skips, held = [], [], [], 0
        yield from blocks()
        release()

    return run


def _buckets(batch: pa.Table) -> pa.Table:
    """Of one task's signatures: star pairs (a the center; members empty), and larger buckets'
    centers (a) and members. A star's
    center is the node with the smallest share of rare shingles: among copies that each differ
    a little, the one most like what they have in common."""
    columns: list[tuple] = []
    for n, sig, doc in zip(batch.column("n").to_pylist(), batch.column("sig").to_pylist(), batch.column("doc").to_pylist(), strict=True):
        take = lambda t, at: np.frombuffer(sig, t, n, at * n)  # noqa: B023, E731
        columns.append((take("<u4", 0), np.cumsum(from_planes(doc, "<i8", n)), take("u1", 4), take("u1", 5), from_planes(sig, "<u4", n, 6 * n)))
    sig, doc, rare, level, skip = (np.concatenate(c) for c in zip(*columns, strict=True))
    del columns
    order = np.argsort(sig)
    sig = sig[order]
    start = np.concatenate([[True], sig[1:] != sig[:-1]])
    many = ~start | np.concatenate([~start[1:], [False]])  # of buckets of two or more
    sig, order = sig[many], order[many]
    by = np.lexsort((doc[order], rare[order], sig))
    sig, order = sig[by], order[by]
    least, greatest = size_bounds()
    doc, low, size, skip = doc[order], least[level[order]], greatest[level[order]], skip[order].astype(np.int64)
    del order, rare, level

    def bounds() -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, int)
        return starts, np.concatenate([starts[1:], [len(sig)]]) if len(sig) else starts

    for _ in range(2):  # who goes may take the smallest along
        starts, ends = bounds()
        keep = possible(size, skip, starts, ends - starts, low) if len(sig) else np.zeros(0, bool)
        if len(sig):
            keep[1:] &= (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
        sig, doc, low, size, skip = sig[keep], doc[keep], low[keep], size[keep], skip[keep]
    starts, ends = bounds()
    center = np.repeat(doc[starts], ends - starts) if len(sig) else doc
    pair = center != doc
    pairs = np.unique(np.column_stack([center[pair], doc[pair]]), axis=0) if pair.any() else np.zeros((0, 2), np.int64)
    lists = sorted({(int(doc[a]), np.sort(doc[a:b]).tobytes()) for a, b in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True)})
    members = [[]] * len(pairs) + [np.frombuffer(x, np.int64).tolist() for _, x in lists]
    firsts, seconds = pairs[:, 0].tolist() + [c for c, _ in lists], pairs[:, 1].tolist() + [0] * len(lists)
    return pa.Table.from_arrays([pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(members, pa.list_(pa.int64()))], ["a", "b", "members"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows a, text_a, b, text_b: those that link."""
    shingler, known = Shingler(), OrderedDict()

    def elements(text: str) -> np.ndarray:
        if (got := known.pop(text, None)) is None:
            raw = np.frombuffer(text.encode(), np.uint8)
            got = shingler.sets(raw, np.array([0, len(raw)]))
            if len(known) >= HELD_TEXTS:
                known.popitem(last=False)
        known[text] = got
        return got

    for batch in batches:
        rows = []
        for a, s, b, t in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "b", "tb")), strict=True):
            x, y = elements(s or ""), elements(t or "")
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and 100 * both >= LEAST * (len(x) + len(y) - both):
                rows.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])
    release()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the nodes of one or two blocks (i, j, block, node, comp, buckets, text): the pairs of
    different components that share a bucket and link, of one block among themselves, or of one
    with the other."""
    shingler, rows, sets, buckets = remembered("shingler", 0, Shingler), [], [], []
    for b in batches:
        for i, j, data, offsets in texts(b.column("text")):
            elements, bounds = split_sets(shingler.sets(data, offsets), j - i)
            sets += [elements[bounds[k] : bounds[k + 1]] for k in range(j - i)]
        rows += zip(*(b.column(c).to_pylist() for c in ("i", "j", "block", "node", "comp")), strict=True)
        buckets += b.column("buckets").to_pylist()
    by = sorted(range(len(rows)), key=lambda k: (len(sets[k]), rows[k][3]))
    node, comp, block = (np.array([rows[k][c] for k in by], np.int64) for c in (3, 4, 2))
    size = np.array([len(sets[k]) for k in by], np.int64)
    alone = not rows or rows[0][0] == rows[0][1]
    inside: dict[int, list[int]] = {}
    for place, k in enumerate(by):
        for x in buckets[k]:
            inside.setdefault(x, []).append(place)
    meet = np.zeros((len(by), len(by)), bool)
    for m in {tuple(m) for m in inside.values()}:
        meet[np.ix_(m, m)] = True
    every, at = np.unique(np.concatenate([sets[k] for k in by]), return_inverse=True) if rows else (np.zeros(0), np.zeros(0, int))
    bounds, on, found = np.concatenate([[0], np.cumsum(size)]), np.zeros(len(every), np.int32), []
    for x in range(len(by)):
        last = int(np.searchsorted(size, 100 * size[x] // LEAST, side="right"))  # larger ones can't link
        open_ = meet[x, x + 1 : last] & (comp[x + 1 : last] != comp[x])
        if not alone:
            open_ &= block[x + 1 : last] != block[x]
        other = np.flatnonzero(open_) + x + 1
        if not len(other) or not size[x]:
            continue
        mine, n = at[bounds[x] : bounds[x + 1]], size[other]
        on[mine] = 1
        begin = np.cumsum(n) - n
        places = at[np.arange(begin[-1] + n[-1]) + np.repeat(bounds[other] - begin, n)] if len(other) < last - x - 1 else at[bounds[x + 1] : bounds[last]]
        both = np.add.reduceat(on.take(places), begin).astype(np.int64)
        on[mine] = 0
        good = 100 * both >= LEAST * (size[x] + n - both)
        found += [(int(node[x]), int(y)) for y in node[other[good]]]
    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


# --- components ---


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, comp) for the nodes of edges(a, b): comp is the smallest node that can be reached.

    Large-star and small-star in turn until all edges are stars: no node has two edges down, and
    no center has one. Each round is written to the shared folder. A hub of many edges costs an
    aggregated minimum, never a gathered list.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        twice = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if twice.isEmpty() and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = stored(small.filter("a <> b").distinct(), name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select("b", "b")).groupBy("node").agg(F.min("comp").alias("comp"))


def jaccard_components(documents: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id.

    A null or empty text, or one without words, has size 0 and links with nothing. Texts of
    fewer than five words are one shingle. doc_id names a document: rows that repeat it are one
    node. A null doc_id takes no part and has a null component. Only doc_id and text are read;
    an empty table gives an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = stored(docs.mapInArrow(_scan, SCAN), "jaccard-scan")
    sets = scanned.filter("kind = 0").drop("kind")
    hot = scanned.filter("kind = 1").groupBy("h1").agg(F.sum("n_shingles").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.col("n").desc(), "h1").limit(MOST_FREQUENT)
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r.h1 for r in hot.collect()], np.int64).view(np.uint64)))
    reps = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    nodes = stored(sets.join(reps, ["h1", "h2", "n_shingles"], "left").select("doc_id", "n_shingles", "rep"), "jaccard-nodes")
    rep = nodes.filter("rep IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("n_shingles").alias("n"))

    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    tasks = max(1, -(-int(total) * 14 // 10 // TASK_SIGNATURES) * 2)

    def small(ids: DataFrame) -> DataFrame:
        """ids, to be broadcast if they are few."""
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    own = nodes.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce(F.col("rep") != F.col("doc_id"), F.lit(False))).alias("copy"))
    copies = stored(own.filter("copy").select("doc_id"), "jaccard-copies")  # only one of equal sets signs
    signed = docs.join(small(copies), "doc_id", "left_anti").mapInArrow(_sign(tasks, frequent), "p int, n long, sig binary, doc binary")
    found = stored(signed.groupBy("p").applyInArrow(_buckets, "a long, b long, members array<long>"), "jaccard-buckets")

    def as_reps(pairs: DataFrame) -> DataFrame:
        """Distinct pairs of representatives whose sizes allow a link."""
        pairs = pairs.distinct()
        for side in ("a", "b"):
            pairs = pairs.join(rep.select(F.col("doc_id").alias(side), F.col("rep").alias(f"r{side}"), F.col("n").alias(f"n{side}")), side)
        pairs = pairs.filter("ra <> rb").filter(f"100 * na >= {LEAST} * nb AND {LEAST} * na <= 100 * nb")
        return pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        own = docs.join(small(wanted), "doc_id", "left_semi")  # only these texts are exchanged
        for side in ("a", "b"):
            pairs = pairs.join(own.select(F.col("doc_id").alias(side), F.col("text").alias(f"t{side}")), side)
        return stored(pairs.mapInArrow(_verify, "a long, b long").distinct(), name)

    pairs = stored(found.filter("size(members) = 0").select("a", "b").distinct(), "jaccard-pairs")
    stars = stored(as_reps(pairs), "jaccard-stars")
    links = verified(stars, "jaccard-links")
    comp = components(links)
    placed = rep.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("comp"), F.col("rep").alias("node"), "n")
    # a bucket all of whose nodes are in its center's component is done; others have an open pair
    ends = [placed.select(F.col("doc_id").alias(s), F.col("comp").alias(f"c{s}")) for s in ("a", "b")]
    centers = pairs.join(ends[0], "a").join(ends[1], "b").filter("ca <> cb").select("a").distinct()
    lists = found.filter("size(members) > 0").join(centers, "a", "left_semi")
    lists = lists.groupBy("a", F.xxhash64("members").alias("bucket"), F.size("members").alias("k")).agg(F.first("members").alias("members"))  # buckets alike are one
    lists = lists.select("a", "bucket", F.explode("members").alias("doc_id"))
    seen = stored(lists.join(placed, "doc_id").select("a", "bucket", "node", "n", "comp"), "jaccard-open")
    mixed = seen.groupBy("a", "bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("a", "bucket")
    members = seen.join(mixed, ["a", "bucket"], "left_semi").groupBy("a", "node").agg(F.min("n").alias("n"), F.min("comp").alias("comp"), F.collect_set("bucket").alias("buckets"))
    members = stored(members, "jaccard-members")
    # a center's members are compared in blocks: pairs never are rows
    sizes = members.groupBy("a").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(sizes, "a").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("a", "node", "comp", "buckets", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    own = docs.join(small(wanted), "doc_id", "left_semi").withColumnRenamed("doc_id", "node")
    whole = own.groupBy("node").agg(F.min("text").alias("text"))  # a repeated doc_id is one node
    more = dealt.join(whole, "node").groupBy("a", "i", "j").applyInArrow(_compare, "a long, b long")
    more = stored(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-more")
    comp = components(links.union(more))
    out = nodes.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id")).alias("component_id"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the size of its set and its component."""
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM sets
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY ALL
"""

"""SentencePiece encoding and decoding over a relational lattice.

A text is cut wherever two neighbouring characters stand together in no piece; no piece reaches
over such a cut, so the segments between are encoded each for itself, and each distinct segment
once. The lattice is relational: a segment's substrings of bounded length are exploded and
equi-joined to the piece table, and the edges found are grouped by segment and folded with
Spark's aggregate().

The fold follows the model's kind. For unigram models it would be Viterbi's best sum. The
model at hand is byte-pair encoding, whose pieces carry merge ranks, not log chances, and the
best sum of ranks is not its encoding: here the fold's state is a bit mask of the places where
the segment is still parted, and each step applies the edge of best rank, leftmost first, that
joins exactly two parts. This is the model's own rule, so the ids are the library's. Segments of
more than MASK_CHARS characters, which fit no mask, go by the same rule with a heap.
segment_unigrams() has Viterbi's fold for vocabularies whose scores do add up.

Segments meet their documents by chunk, a bounded run of documents of one task, which waits as
segment numbers in a file of the shared folder; only segments and their ids are exchanged.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, release, remembered, table
from .shingles import mix

SPACE = "▁"
#: Bytes of text in a chunk, and of one that is cut or decoded at once (a longer text is by
#: itself); characters that the mask holds; segments packed at once.
CHUNK_BYTES, PART_BYTES, MASK_CHARS, PACKED_ROWS = 12 << 20, 1 << 20, 62, 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass
class Pieces:
    """A model's tables, at most its vocabulary's size."""

    ids: dict[str, int]
    rank: dict[str, int]
    bytes_at: list[int]
    text: list[bytes]

    @staticmethod
    def load(model: bytes) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = m.get_piece_size()
        own = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        ids = {m.id_to_piece(i): i for i in own}
        order = {s: r for r, s in enumerate(sorted({m.get_score(i) for i in own}, reverse=True))}
        bytes_at = [0] * 256
        text = [b""] * n
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                bytes_at[int(piece[3:5], 16)] = i
                text[i] = bytes([int(piece[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i)):
                text[i] = piece.replace(SPACE, " ").encode()
        return Pieces(ids, {p: order[m.get_score(i)] for p, i in ids.items()}, bytes_at, text)

    def single(self, char: str) -> list[int]:
        """One character's ids: its piece, or its bytes'."""
        if (i := self.ids.get(char)) is not None:
            return [i]
        return [self.bytes_at[b] for b in char.encode()]

    def longest(self) -> int:
        return max(map(len, self.ids))

    def merged(self, seg: str) -> list[tuple[int, int]]:
        """(start, id) of the pieces of two or more characters, by a heap of joinable pairs."""
        n, rank = len(seg), self.rank
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (r := rank.get(seg[i : after[j]])) is not None:
                heapq.heappush(heap, (r, i, after[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or after[j] != end:
                continue
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
            offer(before[i])
            offer(i)
        return [(i, self.ids[seg[i : after[i]]]) for i in range(n) if alive[i] and after[i] - i > 1]


class Segmenter:
    """Cuts texts into segments."""

    def __init__(self, pieces: Pieces):
        chars = sorted({c for p in pieces.ids for c in p})
        self.kind = np.zeros(sys.maxunicode + 2, np.uint16 if len(chars) < 1 << 16 else np.uint32)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.kinds = len(chars) + 1
        self.joins = np.zeros(self.kinds * self.kinds, bool)
        pairs = np.array(sorted({(ord(a), ord(b)) for p in pieces.ids for a, b in zip(p, p[1:], strict=False)}), np.int64).reshape(-1, 2)
        self.joins[self.kind[pairs[:, 0]] * np.int64(self.kinds) + self.kind[pairs[:, 1]]] = True
        self.value = mix(np.arange(1, sys.maxunicode + 3, dtype=np.uint64))
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) <= n:
            one, n = np.ones(1, np.uint64), max(n + 1, PART_BYTES + 4096)
            self.power = np.concatenate([one, np.cumprod(np.full(n, _BASE, np.uint64))])
            self.inverse = np.concatenate([one, np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))])

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts as the model reads them, joined; begins and ends of the segments, their
        hashes, and the number of segments of each text."""
        read = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(read)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if not len(code):
            zero = np.zeros(0, np.int64)
            return whole, zero, zero, np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        kind = self.kind[code].astype(np.int32 if self.kinds < 46_000 else np.int64)
        begin = np.ones(len(code), bool)
        np.logical_not(self.joins[kind[:-1] * kind.dtype.type(self.kinds) + kind[1:]], out=begin[1:])
        stops = np.cumsum(np.array([len(r) for r in read], np.int64))
        begin[stops[stops < len(code)]] = True
        first = np.flatnonzero(begin)
        last = np.concatenate([first[1:], [len(code)]])
        self._powers(len(code))
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(self.value[code] * self.power[: len(code)], out=sums[1:])
        h = mix((sums[last] - sums[first]) * self.inverse[first] + (last - first).astype(np.uint64))
        return whole, first, last, h, np.diff(np.searchsorted(first, np.concatenate([[0], stops])))


def _chunk_path(root: str, chunk: int) -> str:
    return f"{root}/{chunk & (1 << 64) - 1:016x}.chunk"


class ChunkFile:
    """A chunk's documents: their ids, SHA-256 sums, numbers of segments and segment numbers, and
    the segments that don't go through the lattice."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.sums, self.codes, self.segs, self.held, self.name = [], [], [], 0, hashlib.blake2b(digest_size=8)

    def add(self, doc: int | None, raw: bytes) -> None:
        self.ids.append(doc)
        self.sums.append(hashlib.sha256(raw).digest())
        self.name.update(self.sums[-1] + repr(doc).encode())
        self.held += len(raw)

    def bytes(self) -> bytes:
        import zstandard

        flat = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint32)
        plane = (flat & 0xFF).astype(np.uint8).tobytes() + (flat >> 8 & 0xFF).astype(np.uint8).tobytes() + (flat >> 16).astype("<u2").tobytes()
        alone = {i: x for i, x in enumerate(self.segs) if not 1 < len(x) <= MASK_CHARS}
        nulls = np.array([i is None for i in self.ids], np.uint8).tobytes()
        heads = [np.array([i or 0 for i in self.ids], "<i8").tobytes(), nulls, np.array(self.counts, "<i8").tobytes(), b"".join(self.sums)]
        heads += [np.array(list(alone), "<u4").tobytes(), np.array([len(x.encode()) for x in alone.values()], "<u4").tobytes(), "".join(alone.values()).encode()]
        packed = [zstandard.ZstdCompressor(level=4).compress(x) for x in (b"".join(heads), plane)]
        return struct.pack("<QQQQQ", len(self.ids), len(alone), len(self.segs), len(packed[0]), len(packed[1])) + b"".join(packed)

    @staticmethod
    def read(data: bytes) -> dict:
        import zstandard

        docs, alone, segs, size, _ = struct.unpack_from("<QQQQQ", data)
        unpack = zstandard.ZstdDecompressor().decompress
        head, plane = unpack(data[40 : 40 + size]), unpack(data[40 + size :])
        n = len(plane) // 4
        codes = np.frombuffer(plane, np.uint8, n).astype(np.uint32) | np.frombuffer(plane, np.uint8, n, n).astype(np.uint32) << 8 | np.frombuffer(plane, "<u2", n, 2 * n).astype(np.uint32) << 16
        at = 9 * docs
        ids = [None if z else i for i, z in zip(np.frombuffer(head, "<i8", docs).tolist(), np.frombuffer(head, np.uint8, docs, 8 * docs), strict=True)]
        counts, sums = np.frombuffer(head, "<i8", docs, at), head[at + 8 * docs : at + 40 * docs]
        at += 40 * docs
        places, ends = np.frombuffer(head, "<u4", alone, at).tolist(), np.cumsum(np.frombuffer(head, "<u4", alone, at + 4 * alone).astype(np.int64)).tolist()
        text = head[at + 8 * alone :]
        return {"ids": ids, "counts": counts, "sums": sums, "codes": codes, "segs": segs, "alone": [(p, text[a:b].decode()) for p, a, b in zip(places, [0, *ends], ends, strict=False)]}


def _chunks(folder: str, model: Broadcast):
    """Writes each chunk's file and gives (chunk, code, seg) of its distinct segments that need
    the lattice; code -1 stands for the chunk itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = remembered("segmenter", model.value, lambda: Segmenter(Pieces.load(model.value)))
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, done, known, file = TaskContext.get().partitionId(), 0, {}, ChunkFile()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done, file
            if not file.ids:
                return
            file.name.update(struct.pack("<QQ", part, done))  # equal chunks, if rows repeat, stay apart
            chunk, done = int.from_bytes(file.name.digest(), "little", signed=True), done + 1
            temp = f"{root}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(temp, compression=None) as stream:
                stream.write(file.bytes())
            fs.move(temp, _chunk_path(root, chunk))
            latticed = [-1, *(i for i, x in enumerate(file.segs) if 1 < len(x) <= MASK_CHARS)]
            for i in range(0, len(latticed), 50_000):
                mine = latticed[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), chunk)), pa.array(mine, pa.int32()), pa.array([file.segs[j] if j >= 0 else "" for j in mine], pa.string())], ["chunk", "code", "seg"])
            known.clear()
            file = ChunkFile()

        for b in batches:
            rows = list(zip(b.column("doc_id").to_pylist(), (t or "" for t in b.column("text").to_pylist()), strict=True))
            while rows:
                take, size = 0, 0
                while take < len(rows) and (not take or size + len(rows[take][1]) <= PART_BYTES):
                    size += len(rows[take][1])
                    take += 1
                here, rows = rows[:take], rows[take:]
                whole, first, last, h, n = segmenter.cut([t for _, t in here])
                if len(h):
                    kinds = pa.array(h).dictionary_encode()
                    back, names = kinds.indices.to_numpy(), kinds.dictionary.to_pylist()
                    where = np.empty(len(names), np.int64)
                    where[back[::-1]] = np.arange(len(h) - 1, -1, -1)  # the first place of each stays
                    at = list(map(known.get, names))
                    for k in [k for k, code in enumerate(at) if code is None]:
                        at[k] = known[names[k]] = len(file.segs)
                        file.segs.append(whole[first[where[k]] : last[where[k]]])
                    file.codes.append(np.array(at, np.uint32)[back])
                for doc, t in here:
                    file.add(doc, t.encode())
                file.counts.extend(n.tolist())
                if file.held >= CHUNK_BYTES:
                    yield from flush()
        yield from flush()
        release()

    return run


class Filler:
    """All ids of segments from their pieces of two or more characters."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.chars = np.array([len(t.decode()) if t[:1] < b"\x80" or len(t) > 1 else 1 for t in pieces.text], np.int64)

    def __call__(self, whole: str, lengths: np.ndarray, n: np.ndarray, start: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """whole: the segments, joined; n pieces of each, by start and id. All segments' ids in a
        row, and how many each has: characters that no piece covers go by themselves."""
        begin = np.cumsum(lengths) - lengths
        at = np.repeat(begin, n) + start
        kinds, back = np.unique(np.frombuffer(whole.encode("utf-32-le"), np.uint32), return_inverse=True)
        single = [self.pieces.single(chr(k)) for k in kinds.tolist()]
        sizes = np.array([len(x) for x in single], np.int64)[back] if len(kinds) else np.zeros(0, np.int64)
        covered = np.zeros(len(back) + 1, np.int64)
        np.add.at(covered, at + 1, 1)
        np.add.at(covered, at + self.chars[ids], -1)
        sizes[np.cumsum(covered)[:-1] > 0] = 0
        sizes[at] = 1
        ends = np.cumsum(sizes)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        first = ends - sizes
        lead = np.array([x[0] for x in single], np.int64)[back] if len(kinds) else np.zeros(0, np.int64)
        flat[first[sizes > 0]] = lead[sizes > 0]
        for j in np.flatnonzero(sizes > 1).tolist():  # characters that go by their bytes
            flat[first[j] : ends[j]] = single[back[j]]
        flat[first[at]] = ids
        total = np.concatenate([[0], ends])
        return flat, total[begin + lengths] - total[begin]


def _pack(model: Broadcast):
    """Rows (chunk, code, seg, picks) as a row a chunk, or a few: codes, numbers of ids and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fill = remembered("filler", model.value, lambda: Filler(Pieces.load(model.value)))
        held: list[tuple[np.ndarray, ...]] = []

        def done() -> Iterator[pa.RecordBatch]:
            pack = zstandard.ZstdCompressor(level=1).compress
            if not held:
                return
            chunk, code, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            ids = np.concatenate([h[3] for h in held])
            held.clear()
            at = np.cumsum(n) - n
            order = np.lexsort((code, chunk))
            names, first = np.unique(chunk[order], return_index=True)
            for name, rows in zip(names.tolist(), np.split(order, first[1:]), strict=True):
                mine = ids[_runs(at[rows], n[rows])]
                parts = [np.diff(code[rows], prepend=0).astype("<i4"), n[rows].astype("u1"), (mine & 0xFFFF).astype("<u2"), (mine >> 16).astype("u1")]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)]), pa.array([len(mine)]), pa.array([pack(b"".join(x.tobytes() for x in parts))])], ["chunk", "n", "m", "blob"])

        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            lists, segs = b.column("picks"), b.column("seg")
            picks = lists.flatten().to_numpy()
            flat, n = fill("".join(segs.to_pylist()), pc.utf8_length(segs).to_numpy().astype(np.int64), lists.value_lengths().fill_null(0).to_numpy(), picks >> 20, picks & 0xFFFFF)
            held.append((b.column("chunk").to_numpy(), b.column("code").to_numpy(), n, flat.astype(np.int32)))
            size += b.num_rows
            if size >= PACKED_ROWS:
                yield from done()
                size = 0
        yield from done()
        release()

    return run


def _unpack(n: int, m: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, numbers of ids, ids."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    ids = np.frombuffer(raw, "<u2", m, 5 * n).astype(np.int32) | np.frombuffer(raw, "u1", m, 5 * n + 2 * m).astype(np.int32) << 16
    return np.cumsum(np.frombuffer(raw, "<i4", n)), np.frombuffer(raw, "u1", n, 4 * n).astype(np.int64), ids


RESULT = "doc_id long, ids array<int>, ids_crc32 long, decoded binary, decoded_sha256 string, round_trip boolean"


class Assembler:
    def __init__(self, pieces: Pieces):
        self.pieces, self.fill = pieces, Filler(pieces)
        self.length = np.array([len(t) for t in pieces.text], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(pieces.text), np.uint8)

    def lists(self, file: dict, got: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By segment number: where its ids begin, how many, and all ids."""
        found = [self.pieces.merged(x) for _, x in file["alone"]]
        picks = [np.array([p[k] for ps in found for p in ps], np.int64) for k in (0, 1)]
        sizes = lambda xs: np.array([len(x) for x in xs], np.int64)
        flat, n = self.fill("".join(x for _, x in file["alone"]), sizes([x for _, x in file["alone"]]), sizes(found), *picks)
        got = [*got, (np.array([c for c, _ in file["alone"]], np.int64), n, flat.astype(np.int32))]
        code, n, ids = (np.concatenate([g[i] for g in got]) for i in range(3))
        at, own = np.cumsum(n) - n, code >= 0
        if not np.array_equal(np.sort(code[own]), np.arange(file["segs"])):
            raise ValueError("a chunk's documents and segments went apart: the input must be read alike each time")
        start, size = np.empty(file["segs"], np.int64), np.empty(file["segs"], np.int64)
        start[code[own]], size[code[own]] = at[own], n[own]
        return start, size, ids

    def documents(self, file: dict, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for k, end in enumerate(np.cumsum(file["counts"]).tolist()):
            mine = file["codes"][end - int(file["counts"][k]) : end]
            own = ids[_runs(start[mine], size[mine])]
            text = self.bytes[_runs(self.at[own], self.length[own])].tobytes()[1:]  # without the space put before
            sha = hashlib.sha256(text)
            rows.append((file["ids"][k], own, zlib.crc32(own.astype("<u4").tobytes()), text, sha.hexdigest(), sha.digest() == file["sums"][32 * k : 32 * k + 32]))
            held += len(text)
            if held >= PART_BYTES or len(rows) >= 4096:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.cumsum([0, *(len(r[1]) for r in rows)])
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([r[1] for r in rows]), pa.int32()))
        kinds = [pa.int64(), None, pa.int64(), pa.binary(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([lists if t is None else pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "ids", "ids_crc32", "decoded", "decoded_sha256", "round_trip"])


def _assemble(folder: str, model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = remembered("assembler", model.value, lambda: Assembler(Pieces.load(model.value)))
        got, chunk = [], None
        for b in batches:
            for r in b.to_pylist():
                chunk = r["chunk"]
                got.append(_unpack(r["n"], r["m"], r["blob"]))
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        with fs.open_input_file(_chunk_path(root, chunk)) as stream:
            file = ChunkFile.read(stream.read())
        yield from make.documents(file, *make.lists(file, got))
        release()

    return run


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... sizes[0] of them, then the next run's."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def lattice_edge(rank: Column, i: Column, j: Column, piece: Column) -> Column:
    """An edge from character i to j: its ends and the places inside as bits, and its pick."""
    ends, inside = _bit(i).bitwiseOR(_bit(j)), _bit(j) - _bit(i + 1)
    pick = F.call_function("shiftleft", i.cast("long"), F.lit(20)).bitwiseOR(piece.cast("long"))
    return F.struct(rank.alias("rank"), i.alias("i"), ends.alias("ends"), inside.alias("inside"), pick.alias("pick"))


def fold_merges(n: Column, edges: Column) -> Column:
    """Start << 20 | id of the pieces of two or more characters, in order, of a segment of n
    characters. edges: sorted edges of its lattice.

    What the lambdas use again and again comes to them as lambda variables, which are computed
    once; the optimiser may put a column's whole expression in its place.
    """

    def fold(edges: Column) -> Column:
        def step(s: Column, _: Column) -> Column:  # the mask, or its complement when nothing is left to join
            joins = lambda e: (s.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(s.bitwiseAND(e["inside"])) == 1)
            inside = F.get(F.filter(edges, joins), F.lit(0))["inside"]
            return F.when(s < 0, s).otherwise(F.coalesce(s.bitwiseAND(F.bitwise_not(inside)), F.bitwise_not(s)))

        def picks(s: Column) -> Column:
            mask = F.when(s < 0, F.bitwise_not(s)).otherwise(s)
            kept = F.transform(F.array(mask), lambda m: F.filter(edges, lambda e: m.bitwiseAND(e["inside"].bitwiseOR(e["ends"])) == e["ends"]))[0]
            return F.sort_array(F.transform(kept, lambda e: e["pick"]))

        return F.aggregate(F.sequence(F.lit(1), n - 1), _bit(n + 1) - 1, step, picks)

    return F.transform(F.array(edges), fold)[0]


def segment_pieces(segments: DataFrame, pieces: Pieces) -> DataFrame:
    """(seg, picks) for distinct (seg, n), segments of n characters, up to MASK_CHARS: picks = start << 20 | id
    of each piece of two or more characters, in order; all other characters stand alone. Segments
    without any are left out."""
    spark = segments.sparkSession
    rows = [(p, pieces.rank[p], i) for p, i in pieces.ids.items() if len(p) > 1]
    vocabulary = F.broadcast(spark.createDataFrame(rows, "piece string, rank int, id int"))  # the model's size
    short = segments.filter(F.col("n").between(2, MASK_CHARS))
    spans = short.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 2)))
    spans = spans.withColumn("j", F.explode(F.sequence(F.col("i") + 2, F.least(F.col("n"), F.col("i") + pieces.longest()))))
    edges = spans.join(vocabulary, F.substring("seg", F.col("i") + 1, F.col("j") - F.col("i")) == F.col("piece"))
    grouped = edges.groupBy("seg").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(lattice_edge(F.col("rank"), F.col("i"), F.col("j"), F.col("id")))).alias("edges"))
    return grouped.select("seg", fold_merges(F.col("n"), F.col("edges")).alias("picks"))


def fold_viterbi(n: Column, edges: Column) -> Column:
    """The picks of the best path through the lattice of a segment of n characters: for unigram
    vocabularies, whose scores are log chances and add up. edges: (i, j, score, pick), among
    them one for every single character. Equal sums go to the greater pick of the last edge."""

    def forward(edges: Column) -> Column:
        start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("pick"), F.lit(0).alias("i")))

        def step(best: Column, j: Column) -> Column:
            ways = F.transform(F.filter(edges, lambda e: e["j"] == j), lambda e: F.struct((F.get(best, e["i"])["score"] + e["score"]).alias("score"), e["pick"].alias("pick"), e["i"].alias("i")))
            return F.concat(best, F.array(F.array_max(ways)))

        return F.aggregate(F.sequence(F.lit(1), n), start, step)

    def back(best: Column) -> Column:
        start = F.struct(n.alias("at"), F.array().cast("array<long>").alias("picks"))

        def step(s: Column, _: Column) -> Column:
            e, more = F.get(best, s["at"]), s["at"] > 0
            return F.struct(F.when(more, e["i"]).otherwise(F.lit(0)).alias("at"), F.when(more, F.concat(F.array(e["pick"]), s["picks"])).otherwise(s["picks"]).alias("picks"))

        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["picks"])

    return F.transform(F.transform(F.array(edges), forward), back)[0]


def segment_unigrams(segments: DataFrame, vocabulary: DataFrame, longest: int, unknown: tuple[float, int]) -> DataFrame:
    """(seg, picks) for distinct, not empty segments: start << 20 | id of each piece of the best
    sum of scores. vocabulary: piece, score, id, of a model's size; a character that is no piece
    goes by `unknown`, its score and id."""
    spans = segments.withColumn("n", F.length("seg")).filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spans = spans.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("n"), F.col("i") + longest))))
    named = spans.withColumn("piece", F.substring("seg", F.col("i") + 1, F.col("j") - F.col("i"))).join(F.broadcast(vocabulary), "piece", "left")
    edges = named.filter("id IS NOT NULL OR j = i + 1")
    score, number = F.coalesce("score", F.lit(float(unknown[0]))), F.coalesce("id", F.lit(unknown[1]))
    pick = F.call_function("shiftleft", F.col("i").cast("long"), F.lit(20)).bitwiseOR(number.cast("long"))
    grouped = edges.groupBy("seg").agg(F.max("n").alias("n"), F.collect_list(F.struct("i", "j", score.alias("score"), pick.alias("pick"))).alias("edges"))
    return grouped.select("seg", fold_viterbi(F.col("n"), F.col("edges")).alias("picks"))


def sentencepiece_documents(documents: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids, ids_crc32 (of the ids as little-endian 32-bit
    numbers), decoded (bytes), decoded_sha256, round_trip (whether they are the text's own).

    A null or empty text has no ids. Rows repeat as in the input; null doc_ids stay. Only
    doc_id and text are read, an empty table gives an empty result. A text that holds the
    model's own space mark decodes with spaces in its place, and round_trip says so. Documents
    wait in `folder`, in the shared folder by default. A lost task is run again and must find
    the same rows in the same order, as a scan of files does; otherwise the query fails.
    """
    docs, folder = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), folder or fresh_path(documents.sparkSession, "pieces")
    with open(path, "rb") as f:
        model = documents.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary's size
    # The one exchange by segment serves both the distinct segments and the join with them: the
    # minima and the filter are there so that both sides need the same columns and rows of it, and
    # n is an aggregate so that a test of it stays behind the exchange.
    named = docs.mapInArrow(_chunks(folder, model), "chunk long, code int, seg string").filter("seg IS NOT NULL").repartition("seg")
    distinct = named.groupBy("seg").agg(F.min("chunk").alias("c"), F.min("code").alias("d"), F.max(F.length("seg")).alias("n")).filter("c IS NOT NULL AND d IS NOT NULL").select("seg", "n")
    picked = segment_pieces(distinct, Pieces.load(model.value))
    coded = named.join(picked, "seg", "left").select("chunk", "code", "seg", "picks").mapInArrow(_pack(model), "chunk long, n long, m long, blob binary")
    return coded.groupBy("chunk").applyInArrow(_assemble(folder, model), RESULT)


def decode(ids: Column, path: str) -> Column:
    """Text of an array of ids, as a JVM expression: pieces joined, without the space before."""
    with open(path, "rb") as f:
        pieces = Pieces.load(f.read())
    table_ = F.array(*[F.lit(t.hex()) for t in pieces.text])
    hexed = F.array_join(F.transform(ids, lambda i: F.element_at(table_, i + 1)), "")
    return F.substring(F.decode(F.unhex(hexed), "UTF-8"), F.lit(2), F.length(hexed))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number and checksum of its ids, and what they decode to."""
    import public_tokenizers

    out = sentencepiece_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", "decoded_sha256", "round_trip")

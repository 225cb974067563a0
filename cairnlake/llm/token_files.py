"""Token ids in seekable files: independent zstandard frames, a directory, a seek table.

A file holds documents in ascending doc_id order. Each frame is a block of whole documents and
decompresses alone. After the frames stand two skippable frames: a directory with the first
and last doc_id, documents and ids of each frame, and the seek table of zstandard's seekable
format, with compressed and raw sizes and the low half of each frame's XXH64. A reader finds
a document's frame from the two tables and decompresses that one only.

Files go to the shared folder through pyarrow's file systems; a retried task writes the same
bytes and moves them to the same name, so executors may be lost at any time.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, release, remembered, table

END_ID = 2
#: Ids in a frame, about; compression level; words whose ids a worker remembers; bytes of text
#: and documents encoded at once (a longer text is encoded by itself).
FRAME_IDS, LEVEL, MEMO, BATCH_BYTES, BATCH_DOCS = 1 << 17, 3, 600_000, 4 << 20, 4096
SEEK_MAGIC, SEEK_FRAME, DIR_FRAME = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
#: Words that Unicode's normal form NFC leaves alone, that have one lower case everywhere and no
#: white space; U+007F isn't among the ASCII characters that stand for themselves.
PLAIN = re.compile("[\x21-\x7e\xa1-\u024f]+").fullmatch


def _byte_chars() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: printable ones themselves,
    the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """A tokenizer's ids for whole texts. Where the tokenizer lower-cases, parts words by a
    pattern and merges bytes, it never joins characters across ASCII white space, so each distinct
    word is encoded once and its ids are remembered: word -> place in one run of all ids. Texts
    are parted and their words told apart in Arrow, ids gathered in numpy. New words of plain
    letters go to the merges directly; any other word through the whole tokenizer. The memory
    starts anew when full; tasks that follow each other in a process share it. Any other
    tokenizer gets whole texts.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        make = lambda: (tokenizers.Tokenizer.from_str(model), *self._recipe(json.loads(model)), {}, array("I"), array("q"), array("I"))
        self.tokenizer, self.pattern, self.special, self.known, self.flat, self.starts, self.sizes = remembered("words", model, make)

    @staticmethod
    def _recipe(spec: dict) -> tuple[object | None, list[str]]:
        """The pattern that parts lower-cased words, if the tokenizer works as described."""
        import regex

        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        first, last = steps[0], steps[-1]
        known = (
            [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and spec["normalizer"]["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
            and len(steps) == 2
            and (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True)
            and (last.get("type"), last.get("add_prefix_space"), last.get("use_regex")) == ("ByteLevel", False, False)
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        pattern = first.get("pattern", {}).get("Regex") if known else None
        return regex.compile(rf"{pattern}|\n") if pattern else None, [t["content"] for t in spec["added_tokens"]]

    def _store(self, words: list[str], ids: bytes, sizes: np.ndarray) -> None:
        at = len(self.flat)
        self.known.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.flat.frombytes(ids)
        self.starts.frombytes((at + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        self.sizes.frombytes(sizes.astype(np.uint32).tobytes())

    def _learn(self, words: list[str]) -> None:
        whole = "\n".join(words)
        odd = [s for s in self.special if s in whole]
        plain = [w for w in words if PLAIN(w) and not any(s in w for s in odd)]
        words = list(set(words).difference(plain)) if len(plain) < len(words) else []
        if plain:
            found = self.pattern.findall("\n".join(plain).lower() + "\n")
            tokenize, chars = self.tokenizer.model.tokenize, _byte_chars()
            ids = {p: array("I", [t.id for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(chars))]).tobytes() for p in set(found)}
            ids["\n"] = b""
            runs = list(map(ids.__getitem__, found))
            total = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs))) // 4
            self._store(plain, b"".join(runs), np.diff(total[[p == "\n" for p in found]], prepend=0))
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            rows = [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._store(part, b"".join(rows), np.array([len(r) // 4 for r in rows], np.int64))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null as empty) and END_ID."""
        if self.pattern is None:
            return [np.array([*e.ids, END_ID], np.uint32) for e in self.tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) > MEMO:
            self.known.clear()
            for x in (self.flat, self.starts, self.sizes):
                del x[:]
        if not self.known:
            self._store(["", "\n"], array("I", [END_ID]).tobytes(), np.array([0, 1]))  # the second ends a text
        found = list(map(self.known.get, distinct))
        if new := [w for w, at in zip(distinct, found, strict=True) if at is None]:
            self._learn(new)
            found = [self.known[w] if at is None else at for w, at in zip(distinct, found, strict=True)]
        place = np.array(found, np.int64)
        counts = lists.value_lengths().to_numpy()
        at = np.insert(place[words.indices.to_numpy()], np.cumsum(counts), 1)
        flat, starts, sizes = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.starts, np.int64), np.frombuffer(self.sizes, np.uint32)
        n = sizes[at].astype(np.int64)
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1]) + np.repeat(starts[at] - (ends - n), n)]
        return np.split(ids, ends[np.cumsum(counts + 1) - 1][:-1])


def _frame(ids: list[int | None], rows: list[np.ndarray]) -> bytes:
    flat = np.concatenate(rows)
    wide = flat.max() >= 1 << 16
    nulls = np.array([x is None for x in ids], np.uint8)
    return struct.pack("<IB", len(ids), 4 if wide else 2) + np.array([x or 0 for x in ids], "<i8").tobytes() + nulls.tobytes() + np.array([len(r) for r in rows], "<u4").tobytes() + flat.astype("<u4" if wide else "<u2").tobytes()


def _unframe(raw: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    n, width = struct.unpack_from("<IB", raw)
    at = 5
    ids = np.frombuffer(raw, "<i8", n, at).tolist()
    nulls = np.frombuffer(raw, np.uint8, n, at + 8 * n)
    counts = np.frombuffer(raw, "<u4", n, at + 9 * n)
    flat = np.frombuffer(raw, f"<u{width}", offset=at + 13 * n).astype("<u4")
    return [None if z else x for x, z in zip(ids, nulls, strict=True)], np.split(flat, np.cumsum(counts)[:-1])


class FrameWriter:
    """Writes one file to a binary stream; add() documents in order, then close()."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.press = stream, zstandard.ZstdCompressor(level=LEVEL)
        self.ids, self.rows, self.held, self.seek, self.heads = [], [], 0, [], []
        self.docs = self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.rows.append(ids)
        self.held += len(ids)
        if self.held >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        import xxhash

        if not self.ids:
            return
        raw = _frame(self.ids, self.rows)
        packed = self.press.compress(raw)
        self.stream.write(packed)
        self.seek.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        numbers = [x for x in self.ids if x is not None] or [-(1 << 63)]
        self.heads.append(struct.pack("<qqBIQ", numbers[0], numbers[-1], self.ids[0] is None, len(self.ids), self.held))
        self.docs, self.total = self.docs + len(self.ids), self.total + self.held
        self.ids, self.rows, self.held = [], [], 0

    def close(self) -> None:
        self._flush()
        heads = b"".join(self.heads)
        self.stream.write(struct.pack("<II", DIR_FRAME, len(heads)) + heads)
        table_ = b"".join(self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SEEK_FRAME, len(table_)) + table_)


class FrameReader:
    """Random access to one file, a seekable binary stream of known size."""

    def __init__(self, stream, size: int):
        import zstandard

        self.stream, self.unpress = stream, zstandard.ZstdDecompressor()
        stream.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums at the end")
        width = struct.calcsize("<qqBIQ")
        tail = 8 + width * n + 8 + 12 * n + 9
        stream.seek(size - tail)
        data = stream.read(tail)
        self.heads = [struct.unpack_from("<qqBIQ", data, 8 + width * i) for i in range(n)]
        self.frames, at = [], 0
        for i in range(n):
            packed, raw, check = struct.unpack_from("<III", data, 16 + width * n + 12 * i)
            self.frames.append((at, packed, raw, check))
            at += packed

    def frame(self, i: int) -> tuple[list[int | None], list[np.ndarray]]:
        import xxhash

        at, packed, size, check = self.frames[i]
        self.stream.seek(at)
        raw = self.unpress.decompress(self.stream.read(packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return _unframe(raw)

    def documents(self, wanted: Iterable[int]) -> dict[int, list[np.ndarray]]:
        """The ids of the wanted documents, a list for each as a doc_id may repeat; only
        frames that can hold one are decompressed."""
        wanted, out = set(wanted), {}
        for i, (first, last, *_rest) in enumerate(self.heads):
            if any(first <= w <= last for w in wanted):
                for doc, ids in zip(*self.frame(i), strict=True):
                    if doc in wanted:
                        out.setdefault(doc, []).append(ids)
        return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of texts, bounded in bytes."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        before = ends[a - 1] if a else 0
        b = int(np.searchsorted(ends, before + BATCH_BYTES, side="right"))
        b = min(max(b, a + 1), a + BATCH_DOCS, len(texts))
        yield a, b
        a = b


def _writer(folder: str, tokenizer: Broadcast):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name, temp = f"{root}/tokens-{part:06d}.zst", f"{root}/.{uuid.uuid4().hex}"
        encode = WordEncoder(tokenizer.value)
        with fs.open_output_stream(temp, compression=None) as stream:
            out = FrameWriter(stream)
            for b in batches:
                ids, texts = b.column("doc_id").to_pylist(), b.column("text")
                for i, j in _slices(texts):
                    for doc, row in zip(ids[i:j], encode(texts[i:j]), strict=True):
                        out.add(doc, row)
            out.close()
        release()
        if out.docs:
            fs.move(temp, name)
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name.rpartition("/")[2]], "bytes": [fs.get_file_info(name).size], "docs": [out.docs], "ids": [out.total]})
        else:
            fs.delete_file(temp)

    return write


def write_tokens(documents: DataFrame, folder: str, tokenizer: str) -> list[dict]:
    """Writes the files; a manifest row per file (part, file, bytes, docs, ids, start), by
    doc_id. start: ids in all files before it."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    rows = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")  # equal doc_ids may part
    with open(tokenizer, encoding="utf-8") as f:
        shipped = documents.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary's size
    files = rows.mapInArrow(_writer(folder, shipped), "part long, file string, bytes long, docs long, ids long").collect()
    out, start = [], 0
    for f in sorted(files, key=lambda f: f["part"]):
        out.append(f.asDict() | {"start": start})
        start += f["ids"]
    return out


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for f in b.to_pylist():
                start = f["start"]
                with fs.open_input_file(f"{root}/{f['file']}") as stream:
                    reader = FrameReader(stream, f["bytes"])
                    for i in range(len(reader.frames)):
                        ids, rows = reader.frame(i)
                        counts = np.array([len(r) for r in rows])
                        starts = start + np.cumsum(counts) - counts
                        start += int(counts.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def token_files(documents: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    Every text is encoded whole, null as empty, and ends with END_ID. Null doc_ids come first;
    rows of equal doc_id follow each other. An empty table writes no file. Only doc_id and
    text are read.
    """
    spark = documents.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    files = write_tokens(documents, folder, tokenizer)
    schema = "part long, file string, bytes long, docs long, ids long, start long"
    rows = spark.createDataFrame([tuple(f.values()) for f in files], schema).repartition(max(1, len(files)))
    return rows.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document where its ids stand in the files, their number and checksum."""
    import public_tokenizers

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

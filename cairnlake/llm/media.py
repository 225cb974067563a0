"""Media columns: ISO base media files, walked and indexed without decoding their payload.

`wrap` stores bytes losslessly as an audio track of 8-bit PCM ('ipcm', ISO/IEC 23003-5) in an
ISO/IEC 14496-12 file; `index` walks the nested boxes of any such file, decodes the sample
tables and gives codec, duration and the byte ranges of the key frames; `payload` puts the
sample ranges together again. All three go by the box structure alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Payload unit; bytes in a sample; samples in a chunk; a key sample every so many samples.
UNIT, SAMPLE, CHUNK, KEY_EVERY, TIMESCALE = 64, 1024, 8, 16, 8000
#: Boxes that hold boxes.
NESTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 with zeros up to a positive multiple of UNIT; its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


def wrap(payload: bytes) -> bytes:
    """An ISO media file whose only track's samples are the payload, in order."""
    n = -(-len(payload) // SAMPLE)
    sizes = [SAMPLE] * (n - 1) + [len(payload) - SAMPLE * (n - 1)]
    chunks = -(-n // CHUNK)
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"ipcm", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16), full(b"pcmC", struct.pack(">BB", 0, 8)))
    keys = range(1, n + 1, KEY_EVERY)
    runs = [(n - 1, SAMPLE), (1, sizes[-1])] if n > 1 else [(1, sizes[0])]
    to_chunk = [(1, CHUNK)] if n % CHUNK == 0 else [(1, n)] if chunks == 1 else [(1, CHUNK), (chunks, n % CHUNK)]

    def moov(start: int) -> bytes:
        wide = start + len(payload) >= 1 << 32
        offsets = [start + c * CHUNK * SAMPLE for c in range(chunks)]
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">I", len(runs)), *(struct.pack(">II", *r) for r in runs)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(to_chunk)), *(struct.pack(">III", first, per, 1) for first, per in to_chunk)),
            full(b"stsz", struct.pack(f">II{n}I", 0, n, *sizes)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        long = len(payload)  # one sample a byte
        head = struct.pack(">QQIQ", 0, 0, TIMESCALE, long)
        info = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        media = box(b"mdia", full(b"mdhd", head, struct.pack(">HH", 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"), info)
        track = box(b"trak", full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, long), bytes(8), struct.pack(">hhhh", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7), media)
        return box(b"moov", full(b"mvhd", head, struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1), track)

    ftyp = box(b"ftyp", b"iso6", struct.pack(">I", 512), b"iso6", b"mp42")
    mdat_head = 8 if len(payload) + 8 < 1 << 32 else 16
    index = moov(len(ftyp) + len(moov(0)) + mdat_head)
    return ftyp + index + box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, body start, end) of every box, outer first; ValueError if one is cut off."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("box header is cut off")
        n, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if n == 1:
            if end - start < 16:
                raise ValueError("box header is cut off")
            n, body = struct.unpack_from(">Q", data, body)[0], start + 16
        stop = end if n == 0 else start + n
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} has a bad size")
        yield (*path, kind), body, stop
        if kind in NESTS:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


def _counted(data: bytes, at: int, unit: str, per: int = 1, skip: int = 4) -> list[tuple]:
    n = struct.unpack_from(">I", data, at + skip)[0]
    flat = struct.unpack_from(f">{n * per}{unit}", data, at + skip + 4)
    return [flat[i : i + per] for i in range(0, n * per, per)]


def _small_sizes(data: bytes, at: int) -> list[int]:
    """stz2: sizes of 4, 8 or 16 bits."""
    bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if bits not in (4, 8, 16):
        raise ValueError("stz2 has fields of 4, 8 or 16 bits")
    raw = data[at + 12 : at + 12 + -(-n * bits // 8)]
    if bits == 4:
        return [x for b in raw for x in (b >> 4, b & 15)][:n]
    return list(raw) if bits == 8 else list(struct.unpack(f">{n}H", raw))


def _optional(data: bytes, at: int, flags: int, fields: tuple[tuple[int, str], ...]) -> tuple[list[int | None], int]:
    """Fields that are there if their flag is, and the place behind them."""
    out: list[int | None] = []
    for flag, unit in fields:
        out.append(struct.unpack_from(f">{unit}", data, at)[0] if flags & flag else None)
        at += struct.calcsize(f">{unit}") if flags & flag else 0
    return out, at


#: Fields of tfhd behind the track, and of each sample of trun, by flag; a sample that isn't a key.
TFHD, TRUN, NO_KEY = ((0x1, "Q"), (0x2, "I"), (0x8, "I"), (0x10, "I"), (0x20, "I")), ((0x100, "I"), (0x200, "I"), (0x400, "I"), (0x800, "I")), 0x10000


class _Fragments:
    """Samples of movie fragments (moof), added to their tracks."""

    def __init__(self, data: bytes):
        self.data, self.defaults = data, {}

    def see(self, kind: bytes, at: int, tracks: dict[int, dict]) -> None:
        data, flags = self.data, struct.unpack_from(">I", self.data, at)[0] & 0xFFFFFF if kind != b"moof" else 0
        if kind == b"moof":
            self.start = at - (16 if data[at - 12 : at - 8] == b"moof" else 8)
            self.end = None
        elif kind == b"trex":
            track, _, *rest = struct.unpack_from(">5I", data, at + 4)
            self.defaults[track] = rest  # duration, size, flags
        elif kind == b"tfhd":
            track = struct.unpack_from(">I", data, at + 4)[0]
            (base, _, *own), _ = _optional(data, at + 8, flags, TFHD)
            known = self.defaults.get(track, [0, 0, 0])
            self.now = [k if o is None else o for o, k in zip(own, known, strict=True)]
            self.base = base if base is not None else self.start
            self.track = tracks.get(track)
            self.end = self.base if base is not None or flags & 0x20000 or self.end is None else self.end
        elif kind == b"trun" and self.track is not None:
            n = struct.unpack_from(">I", data, at + 4)[0]
            (offset, first), at = _optional(data, at + 8, flags, ((0x1, "i"), (0x4, "I")))
            place, t = self.base + offset if offset is not None else self.end, self.track
            for i in range(n):
                (duration, size, mark, _), at = _optional(data, at, flags, TRUN)
                size, mark = self.now[1] if size is None else size, (first if i == 0 and first is not None else self.now[2]) if mark is None else mark
                t.setdefault("late", []).append((place, size, not mark & NO_KEY))
                t["late_duration"] = t.get("late_duration", 0) + (self.now[0] if duration is None else duration)
                place += size
            self.end = place


def index(data: bytes) -> list[dict]:
    """Per track: handler, codec, timescale, duration, edits [(duration, media time)], samples
    [(offset, size)], keys [sample number from 0], key_ranges [(first byte, end)] of the runs from
    each key to the next. Samples of movie fragments follow those of the tables; handler and codec
    are empty, timescale and duration 0 where their boxes are absent."""
    tracks: list[dict] = []
    fragments, by_id = _Fragments(data), {}
    for path, at, _end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"keys": None, "handler": "", "codec": "", "timescale": 0, "duration": 0, "edits": []})
        t = tracks[-1] if tracks else {}
        if kind == b"tkhd":
            by_id[struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]] = t
        elif kind == b"mdhd":
            wide = data[at] == 1
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
        elif kind == b"hdlr":
            t["handler"] = data[at + 8 : at + 12].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = data[at + 12 : at + 16].decode("latin-1")
        elif kind == b"elst":
            form = ">Qqi" if data[at] == 1 else ">Iii"
            t["edits"] = [struct.unpack_from(form, data, at + 8 + i * struct.calcsize(form))[:2] for i in range(struct.unpack_from(">I", data, at + 4)[0])]
        elif kind == b"stss":
            t["keys"] = [x[0] - 1 for x in _counted(data, at, "I")]
        elif kind == b"stsc":
            t["stsc"] = _counted(data, at, "I", 3)
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, at + 4)
            t["sizes"] = [same] * n if same else list(struct.unpack_from(f">{n}I", data, at + 12))
        elif kind == b"stz2":
            t["sizes"] = _small_sizes(data, at)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = [x[0] for x in _counted(data, at, "I" if kind == b"stco" else "Q")]
        elif kind in (b"moof", b"trex", b"tfhd", b"trun"):
            fragments.see(kind, at, by_id)
    for t in tracks:
        sizes, samples, k = t.get("sizes", []), [], 0
        runs = t.get("stsc", [])
        for (first, per, _), until in zip(runs, [*(r[0] for r in runs[1:]), len(t.get("chunks", [])) + 1][: len(runs)], strict=True):
            for chunk in range(first - 1, until - 1):
                at = t["chunks"][chunk]
                for size in sizes[k : k + per]:
                    samples.append((at, size))
                    at += size
                    k += 1
        if len(samples) != len(sizes):
            raise ValueError("sample tables disagree")
        keys = list(range(len(samples))) if t["keys"] is None else t["keys"]
        for place, size, key in t.pop("late", []):
            if key:
                keys = [*keys, len(samples)] if not keys or keys[-1] != len(samples) else keys
            samples.append((place, size))
        if any(a < 0 or n < 0 or a + n > len(data) for a, n in samples):
            raise ValueError("a sample lies outside the file")
        t["duration"] = t["duration"] or t.pop("late_duration", 0)
        t["samples"], t["keys"] = samples, keys
        t["key_ranges"] = [(samples[a][0], samples[b - 1][0] + samples[b - 1][1]) for a, b in zip(keys, [*keys[1:], len(samples)][: len(keys)], strict=True)]
    return tracks


def payload(data: bytes, track: dict) -> bytes:
    return b"".join(data[a : a + n] for a, n in track["samples"])


def feature(track: dict) -> str:
    """Codec, timing and where the key frames' bytes are, in one line."""
    spans = ",".join(f"{a}-{b}" for a, b in track["key_ranges"])
    return f"{track['codec']}/{track['handler']} timescale={track['timescale']} duration={track['duration']} samples={len(track['samples'])} keys={len(track['keys'])} ranges={zlib.crc32(spans.encode()):08x} first={spans.split(',')[0]}"


def described(data: bytes | None) -> tuple:
    """What media_columns() says of one file, from payload_bytes on."""
    if not data:
        return (None,) * 9
    found = index(data)
    if not found:
        raise ValueError("no track")
    track = found[0]
    read = payload(data, track)
    keys = [{"first": a, "end": e} for a, e in track["key_ranges"]]
    length = track["duration"] / track["timescale"] if track["timescale"] else None
    return len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(track), track["codec"], length, keys


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
INDEX_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<first: long, end: long>>"


def _wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column("doc_id"), b.column("text")
        for i in range(0, b.num_rows, 256):
            raw = [padded(x.as_py()) for x in texts[i : i + 256]]
            yield pa.RecordBatch.from_arrays([ids[i : i + 256].cast(pa.int64()), pa.array([n for _, n in raw], pa.int64()), pa.array([wrap(p) for p, _ in raw], pa.binary())], ["doc_id", "n_bytes", "media"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "keyframes")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]
    for b in batches:
        rows = []
        for doc, n, data in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media"), strict=True):
            rows.append((doc, n, *described(data.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)


def to_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's padded UTF-8 as an ISO media file.

    A null or empty text gives one unit of zeros. Rows repeat as in the input; equal texts
    give equal files. Only doc_id and text are read. A null doc_id stays null.
    """
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_wrap, MEDIA_SCHEMA)


def media_columns(media: DataFrame) -> DataFrame:
    """Per file: sizes, digests, codec, duration and key-frame byte ranges, read from the
    stored bytes. The payload is only hashed, never decoded. A null or empty file has nulls; one
    that is cut off, has no track or samples outside itself raises an error. Rows repeat as in the
    input; an empty table gives an empty result."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_index, INDEX_SCHEMA)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its text stored as a media file, and what is read back of it."""
    out = media_columns(to_media(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

"""The text operators against brute force, round trips and held-out accuracy."""

import hashlib
import io
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import license_scan, media, mixing, pieces, pii, quality, token_files, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [None, "", " ", "x", "é" * 70, "日本語テキスト処理" * 9, "a" * 5000, "Hello  world\n a", "▁ ▁▁x", "🙂é\tü", "    " * 9 + "y", "=#" * 90]


def frame(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int")


# --- media ---


@pytest.mark.parametrize("n", [64, 128, 1024, 1088, 8192, 8256, 20_032])
def test_container_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = media.wrap(payload)
    track = media.index(data)[0]
    assert media.payload(data, track) == payload and track["codec"] == "ipcm" and track["duration"] == n
    assert b"".join(data[a:b] for a, b in track["key_ranges"]) == payload
    kinds = [p[-1] for p, _, _ in media.walk(data)]
    assert kinds[0] == b"ftyp" and kinds[-1] == b"mdat" and {b"moov", b"trak", b"stsz", b"stco", b"stss"} <= set(kinds)


def test_container_damage():
    data = media.wrap(bytes(64))
    for bad in (data[:-1], data[:20], data[:4] + b"xx"):
        with pytest.raises((ValueError, struct.error)):
            list(media.walk(bad)) and media.index(bad)
    wide = struct.pack(">I4sQ", 1, b"free", 24) + bytes(8) + data
    assert media.index(struct.pack(">I4s", 8, b"skip") + data)[0]["codec"] == "ipcm"
    assert [p[-1] for p, _, _ in media.walk(wide)][0] == b"free"


def test_media_columns(spark):
    got = {r.doc_id: r for r in media.media_columns(media.to_media(frame(spark, ODD))).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[0].media_sha256 == got[1].media_sha256
    assert media.media_columns(media.to_media(frame(spark, ODD).limit(0))).collect() == []


# --- licences ---


def test_licenses(spark):
    s = license_scan.SENTENCES
    mit = " ".join((s["mit-grant"], s["mit-notice"], s["mit-asis"]))
    texts = [
        "Intro line\nReleased under the MIT License.\nmore",
        "Foo. " + s["apache2-name"] + " Bar.",
        "\n".join(re.findall(r".{1,60}(?:\s|$)", mit)),
        "// " + s["cc-by-nc-4"],
        "the MIT License is nice",
        s["bsd-grant"] + "\n1. " + s["bsd-source"] + "\n2. " + s["bsd-binary"],
        s["bsd-grant"] + " " + s["bsd-source"] + " " + s["bsd-binary"] + " " + s["bsd-endorse"],
        s["bsd-binary"] + " " + s["bsd-grant"],
        None,
        "",
        "LICENSED UNDER   THE APACHE LICENSE, VERSION 2.0.",
    ]
    got = [r.licenses for r in license_scan.scan_licenses(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["MIT", "Apache-2.0", "MIT", "CC-BY-NC-4.0", "", "BSD-2-Clause", "BSD-3-Clause", "", "", "", "Apache-2.0"]
    for licence, _, seq in license_scan.RULES:
        found = license_scan.Scanner().matches("Some words. " + " ".join(s[x] for x in seq) + " The end.")
        assert licence in {m[0] for m in found}


# --- pieces ---


def test_sentencepiece(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(2)
    texts = ODD + ["".join(rnd.choice("etaoinshr  .,!\n") for _ in range(150)) for _ in range(40)] + ["internationalization singing ringing", "a b" * 40]
    rows = pieces.sentencepiece_documents(frame(spark, texts + texts[:20]), path).collect()
    assert len(rows) == len(texts) + 20
    for r in rows:
        text = (texts + texts[:20])[r.doc_id] or ""
        assert r.ids == model.encode(text) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.round_trip == ("▁" not in text)
    few = spark.createDataFrame([(r.doc_id, r.ids, bytes(r.decoded)) for r in rows[:12]], "doc_id long, ids array<int>, decoded binary")
    for r in few.select(pieces.decode(F.col("ids"), path).alias("t"), "decoded").collect():
        assert r.t.encode() == bytes(r.decoded)
    assert pieces.sentencepiece_documents(frame(spark, ODD).limit(0), path).collect() == []


# --- mixing ---


def brute_targets(sizes, weights, share, times):
    total, open_, out = share * sum(sizes), set(range(len(sizes))), {}
    while open_:
        level = (total - sum(out.values())) / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > times * sizes[i]}
        if not over:
            return [out.get(i, level * weights[i]) for i in range(len(sizes))]
        out |= {i: times * sizes[i] for i in over}
        open_ -= over
    return [out[i] for i in range(len(sizes))]


def test_mixing(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 40, 400])), rnd.choice(["a", "a", "a", "B", "é", None, "z"])) for i in range(900)] + [(5, None, "a"), (6, "x", "only"), (None, "n n n", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block=8, shard_words=5000).collect()
    assert len(got) == len(rows)
    sources = sorted({s for _, _, s in rows if s is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len((t or "").split()) for _, t, x in rows if x == s) for s in sources]
    want = dict(zip(sources, brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], 1.5, 2), strict=True))
    for s, size in zip(sources, sizes, strict=True):
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {size} and all(abs(r.target - want[s]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(16, 0.02 * want[s])
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    key = lambda rs: Counter((r.doc_id, r.size, r.source, r.taken) for r in rs)
    assert key(got) == key(mixing.mix(df.repartition(7), block=8, shard_words=5000).collect())
    out = mixing.mixed_documents(df, block=8, shard_words=5000).collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in got)
    assert mixing.mix(df.limit(0)).collect() == []


def test_small_sources_meet_their_targets_in_many_shards(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(8), "a") for i in range(300)] + [(1000 + i, words(400), "b") for i in range(200)] + [(2000 + i, words(20), None) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for shard_words in (100, 1_000_000):
        got = mixing.mix(df, weights=(5, 2, 2), shard_words=shard_words).collect()
        for s in ("a", "b", None):
            mine = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 32 + 0.005 * mine[0].target
        assert all(0 <= r.taken <= 2 * r.size for r in got)


def test_apportionment(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for g in range(12):
        votes, seats = [rnd.choice([0.0, 1.0, rnd.uniform(0, 900)]) for _ in range(rnd.randrange(1, 9))], rnd.randrange(0, 60)
        if not sum(votes):
            votes[0] = 5.0
        bids = sorted(((-v / (2 * k + 1), p) for p, v in enumerate(votes) for k in range(seats) if v), key=lambda b: b)[:seats]
        for p, v in enumerate(votes):
            rows.append((g, p, v, seats))
            want[g, p] = sum(1 for _, x in bids if x == p)
    df = spark.createDataFrame(rows, "g int, p int, v double, n long")
    got = mixing.sainte_lague(df, ["g"], "p", "v", F.col("n"), "seats").collect()
    assert {(r.g, r.p): r.seats for r in got} == want


# --- personal data ---


def brute_spans(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii(spark):
    rnd = random.Random(8)
    texts = ODD + ["a@b.c%d@e.f g", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1111", "4" * 40, "+1 (555) 123-4567 +12 34", "x😀a@b.co 😀 10.0.0.1", "1 " * 9000 + "4111111111111111", "9" * 9000, "a@b.c-d.e_f@g.h", "4111111111111111@x.y 1.1.1.1", "+4111111111111111", "tel 555 123 4567 and (020) 7946-0018", "me (at) example.org"]
    texts += ["".join(rnd.choice("0123456789  .-+@()ab\n") for _ in range(80)) for _ in range(300)]
    found = pii.find_pii(frame(spark, texts).withColumn("base", F.lit(1)))
    rows = found.select("doc_id", "text", pii.joined(F.col("base")).alias("b"), "base", "added", pii.redacted(F.col("text"), F.concat("base", "added")).alias("r")).collect()
    for r in rows:
        assert r.b == brute_spans(r.text)
        for x in (*r.base, *r.added):
            assert r.text[x.start : x.end] == x.found
        assert not any(a.start < b.end and b.start < a.end for a in r.added for b in r.base)
        if not (r.base or r.added):
            assert r.r == r.text
        elif r.base:
            assert "[" in r.r and not any(x.found in r.r for x in r.base if len(x.found) > 12)
    assert pii.find_pii(frame(spark, ODD).limit(0)).collect() == []


def test_pii_beyond_the_base_rules(spark):
    card, other, group = "4465758382889437", "4845168114407329", "4111 1111 1111 1111"
    cases = [f"a {card} {other} b", f"a {group} {group.replace(' ', '-')} b", "me (at) example.org", "you [at] mail.example.com", "tel 555 123 4567 or", "Phone: 020 7946 0018.", "(020) 7946-0018"]
    wanted = [[card, other], [group, group.replace(" ", "-")], *[[c] for c in cases[2:4]], ["555 123 4567"], ["020 7946 0018"], ["(020) 7946-0018"]]
    plain = ["hotel 555 123 4567", "4465758382889438 4465758382889439", "2019-2020 2021-2022", "look (at) this", "x @ y", "1 234 567 890 123"]
    known = [f"a@b{i}.example.org, +1 (555) 000-{1000 + i}, 10.0.0.{i}" for i in range(40)]
    texts = [f"n{i} {t}" for i in range(40) for t in cases + plain] + known
    rows = pii.find_pii(frame(spark, texts)).select("doc_id", "text", "added").collect()
    for r in rows:
        body = r.text.split(" ", 1)[1]
        want = wanted[cases.index(body)] if body in cases else []
        assert [x.found for x in sorted(r.added, key=lambda x: x.start)] == want, r.text


def test_boosting_learns_and_calibrates():
    rows = [(1, d, lead, 1, 1, c, 50, 50 * ((d == 3) and lead == 1)) for d in range(6) for lead in range(3) for c in range(2)]
    model = pii.Boosted(np.array(rows, float))
    chosen = {v[:3] for v in model.chosen(0.95)}
    assert (1, 3, 1) in chosen and not {(1, d, 1) for d in (0, 1, 2, 4, 5)} & chosen
    assert pii.Boosted(np.zeros((0, 8))).least_score(0.5) is None


# --- quality ---


def test_quality(spark):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice(["alpha", "beta", "of", "the", "river", "stone"]) for _ in range(rnd.randrange(5, 90))).capitalize() + "."
    bad = lambda: rnd.choice([good().upper().replace(" ", "!! "), good().replace(" ", " | "), "Spam " * 60, good().replace(" ", "$$$ ")])
    truth = [i % 3 > 0 for i in range(600)]
    texts = [good() if t else bad() for t in truth] + [None, "", "x", "word " * 20_000]
    labels = spark.createDataFrame([(i, int(t), 0) for i, t in enumerate(truth) if i < 300] + [(9999, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts).withColumn("score", F.lit("own"))
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == len(texts) and set(docs.columns) <= set(got[0].asDict())
    held = [got[i].keep == truth[i] for i in range(300, 600)]
    assert sum(held) / len(held) > 0.97 and all(got[i].keep for i in range(300, 600) if truth[i])
    assert all(r.keep for r in quality.score_quality(docs, labels.limit(0)).collect())
    assert quality.score_quality(docs.limit(0), labels).collect() == []


# --- urls ---


def test_cascade_is_exact(spark):
    keys = spark.createDataFrame([(f"host{i}.example", i % 5 == 0) for i in range(4000)], "key string, listed boolean")
    levels = url_filter.build_cascade(keys)
    assert len(levels) > 1
    assert keys.filter(url_filter.contains(F.col("key"), levels) != F.col("listed")).count() == 0
    assert url_filter.build_cascade(keys, max_bytes=8) is None
    assert url_filter.build_cascade(keys.filter("NOT listed")) == []


def test_urls(spark):
    cases = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"), "http://net/": ("net", "/", "net/", "block"), "http://net": ("net", "", None, "allow"), "x": ("", "", None, "allow"),
        None: ("", "", None, "allow"), "http://xexample.com/de/": ("xexample.com", "/de/", None, "allow"), "http://example.com/de/a": ("example.com", "/de/a", "example.com/de/", "block"), "https://m.casino-win.example.com/en/": ("m.casino-win.example.com", "/en/", None, "block"),
        "https://casino-win.org/fr/": ("casino-win.org", "/fr/", "org/fr/", "allow"), "a://b://c.net/x": ("b:", "//c.net/x", None, "allow"), "http://É.net?x://y": ("É.net", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    for cut in (url_filter.MAX_BYTES, 1):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, url_filter.listed_hosts(df), max_bytes=cut).collect()}
        assert [got[i] for i in range(len(cases))] == list(cases.values())
    listed = spark.createDataFrame([("net",), ("net",), (None,), ("nowhere",), ("",)], "key string")
    twice = url_filter.judge_urls(df.union(df), listed, rules=[("allow", "example.com", "/d"), ("block", "example.com", "/d")]).collect()
    assert len(twice) == 2 * len(cases) and {(r.host, r.verdict) for r in twice if r.listed} == {("net", "block"), ("", "block")}
    assert {(r.rule, r.verdict) for r in twice if r.rule} == {("example.com/d", "block")}
    assert url_filter.judge_urls(df.limit(0), listed).collect() == [] and not any(r.listed for r in url_filter.judge_urls(df, listed.limit(0)).collect())


# --- token files ---


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rnd = random.Random(6)
    texts = ODD + ["a\x1cb <|endoftext|> İstanbul ΑΣ don't", " x\x85y ", "<|startoftext|>"] + [" ".join(rnd.choice(["alpha", "Beta's", "12,5", "Ünder"]) for _ in range(rnd.randrange(900))) for _ in range(60)]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    df = spark.createDataFrame([(i * 3 - 50, texts[i], "own") for i in order] + [(None, "null id", "own"), (-50, "again", "own")], "doc_id long, text string, start string")
    got = sorted(token_files.token_files(df, path, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    ids = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got]
    want = {}
    for i, t in [(None, "null id"), (-50, "again"), *((k * 3 - 50, t) for k, t in enumerate(texts))]:
        e = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((i, len(e), zlib.crc32(np.array(e, "<u4").tobytes())))
    assert Counter(ids) == Counter(x for xs in want.values() for x in xs)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    name = min((tmp_path / "t").glob("tokens-*.zst"), key=lambda p: p.name)
    data = name.read_bytes()
    reader = token_files.FrameReader(io.BytesIO(data), len(data))
    doc = next(d for d in reader.frame(0)[0] if d is not None)
    assert doc in reader.documents([doc])
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()  # any reader passes over the tables
    assert len(whole) == sum(f[2] for f in reader.frames)
    spoilt = bytearray(data)
    spoilt[reader.frames[0][0] + reader.frames[0][1] // 2] ^= 1
    with pytest.raises(Exception):
        token_files.FrameReader(io.BytesIO(bytes(spoilt)), len(data)).frame(0)
    assert token_files.token_files(df.limit(0), path).collect() == []


def test_words_of_every_character():
    """Each code point up to U+024F, alone and between letters, as the library encodes it; and a
    tokenizer of another kind, which gets whole texts."""
    import json

    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    texts = [t for c in range(0x250) for t in (chr(c), f"a{chr(c)}b", f"Ab{chr(c)}{chr(c)} 1{chr(c)}")]
    other = json.loads(spec)
    other["pre_tokenizer"]["pretokenizers"] = other["pre_tokenizer"]["pretokenizers"][-1:]
    for model in (spec, json.dumps(other)):
        library = Tokenizer.from_str(model)
        got = token_files.WordEncoder(model)(pa.array([*texts, None]))
        assert [g.tolist() for g in got] == [[*library.encode(t, add_special_tokens=False).ids, token_files.END_ID] for t in [*texts, ""]]


# --- cases of their own ---


def test_fragmented_media_and_odd_files(spark):
    one = bytes(range(200))
    sizes, flags = [50, 100, 50], [0, media.NO_KEY, 0]
    trex = media.full(b"trex", struct.pack(">5I", 1, 1, 10, 0, 0))
    tkhd = media.full(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, 0), bytes(60))
    mdhd = media.full(b"mdhd", struct.pack(">4I", 0, 0, 1000, 0), bytes(4))
    elst = media.box(b"edts", media.full(b"elst", struct.pack(">IIii", 1, 30, 5, 0x10000)))
    stsz = media.box(b"minf", media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"raw ", bytes(8)))))
    moov = media.box(b"moov", media.box(b"trak", tkhd, elst, media.box(b"mdia", mdhd, stsz)), media.box(b"mvex", trex))
    run = lambda at: media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 1), flags=0x20000), media.full(b"trun", struct.pack(">Ii", 3, at), *(struct.pack(">II", n, f) for n, f in zip(sizes, flags, strict=True)), flags=0x601)))
    data = moov + run(len(run(0)) + 8) + media.box(b"mdat", one)
    track = media.index(data)[0]
    assert media.payload(data, track) == one and track["keys"] == [0, 2] and track["duration"] == 30 and track["edits"] == [(30, 5)] and track["codec"] == "raw "
    assert [data[a:b] for a, b in track["key_ranges"]] == [one[:150], one[150:]]
    assert media._small_sizes(media.full(b"stz2", bytes(3), bytes([4]), struct.pack(">I", 3), bytes([0x12, 0x30]))[8:], 0) == [1, 2, 3]
    with pytest.raises(ValueError, match="outside"):
        media.index(data[: -len(one) - 8] + media.box(b"mdat", one[:9]))
    bare = media.box(b"moov", media.box(b"trak"))
    rows = [(1, 3, None), (2, 0, b""), (3, 5, bare), (3, 5, bare)]
    got = media.media_columns(spark.createDataFrame(rows, media.MEDIA_SCHEMA)).collect()
    assert [(r.doc_id, r.payload_bytes, r.codec, r.duration_s) for r in got] == [(1, None, None, None), (2, None, None, None), (3, 0, "", None), (3, 0, "", None)]


def test_sentences_between(spark):
    """Unknown sentences count: a licence's sentences that stand far apart are no licence."""
    s = license_scan.SENTENCES
    mit = [s[x] if s[x][-1] in ".:;" else s[x] + "." for x in ("mit-grant", "mit-notice", "mit-asis")]
    texts = [f" {' '.join(f'Filler {i} goes here.' for i in range(n))} ".join(mit) for n in (0, 1, license_scan.MOST_BETWEEN, license_scan.MOST_BETWEEN + 1, 5000)]
    assert [[(f.license, f.how) for f in r.found] for r in license_scan.scan_licenses(frame(spark, texts)).orderBy("doc_id").collect()] == [[("MIT", "text")]] * 3 + [[]] * 2


def test_licenses_by_brute_force(spark):
    s, rnd, names = license_scan.SENTENCES, random.Random(5), sorted(license_scan.SENTENCES)
    parts = {x: [license_scan.normalised(p) for p in re.split(r"(?<=[.:;!?])(?=\s)|(?<=[.:;!?]\")(?=\s)", s[x])] for x in names}
    rules = [(licence, how, [p for x in seq for p in parts[x]]) for licence, how, seq in license_scan.RULES]
    texts, want = [], []
    for _ in range(160):
        seq = rnd.choice(license_scan.RULES)[2] if rnd.random() < 0.6 else ()
        used = [*rnd.choices(names, k=rnd.randrange(3)), *seq, *rnd.choices(names, k=rnd.randrange(8)), *(seq[:2] if rnd.random() < 0.3 else ())]
        texts.append("Here. " + " ".join(f"Filler {i} goes here. {s[x]}" + ("" if s[x][-1] in ".:;" else ".") for i, x in enumerate(used)) + " The end.")
        seen, out, i = [p for x in used for p in (None, *parts[x])], [], 0  # each comes after a filler
        while i < len(seen):
            best = None
            for licence, how, rule in rules:
                at = i if rule[0] == seen[i] else None
                for x in rule[1:]:
                    near = [j for j in range(at + 1, min(len(seen), at + 2 + license_scan.MOST_BETWEEN)) if seen[j] == x] if at is not None else []
                    at = near[0] if near else None
                if at is not None and (best is None or len(rule) > best[0]):
                    best = (len(rule), licence, how, at)
            if best:
                out.append(best[1:3])
                i = best[3]
            i += 1
        want.append(out)
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2 + [(None, "x", "y")], "doc_id long, text string, found string")
    got = license_scan.scan_licenses(rows).collect()
    assert len(got) == 2 * len(texts) + 1
    for r in got:
        if r.doc_id is not None:
            assert [(f.license, f.how) for f in r.found] == want[r.doc_id], texts[r.doc_id]
    assert license_scan.scan_licenses(rows.limit(0)).collect() == []
    with pytest.raises(ValueError, match="no word"):
        license_scan.Scanner({"x": "..."}, ())


def test_many_matches(spark):
    """Texts of many spans, near each other and apart; places as a plain scan finds them."""
    texts = ["".join(f"u{i}@mail{i % 7}.example.org{sep}" for i in range(n)) for n, sep in ((20_000, " "), (257, ","), (16, " é\n"))] + [f"{'x ' * 900}call +39 040 {i:07d} or 10.0.{i % 256}.7; " * 40 for i in range(3)]
    got = {r.doc_id: r.base for r in pii.find_pii(frame(spark, texts)).collect()}
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for i, t in enumerate(texts):
        for kind, pattern in plain.items():
            want = [(m.start(), m.end()) for m in re.finditer(pattern, t) if kind != "phone" or 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
            assert [(x["start"], x["end"]) for x in got[i] if x["kind"] == kind] == want


def test_secrets(spark):
    rnd = random.Random(11)
    key = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    held = [key(40) for _ in range(60)]
    texts = [f'word token = "{k}" more' for k in held] + ["a" * 60, "internationalisation-of-everything", "see " + "x1" * 8, "call a@b.example.org"] * 10
    rows = pii.find_pii(frame(spark, texts + texts[:3])).collect()
    assert [[x.found for x in r.added] for r in rows if r.doc_id < 60] == [[k] for k in held]
    assert not any(r.added for r in rows if 60 <= r.doc_id < len(texts)) and len(rows) == len(texts) + 3
    with pytest.raises(ValueError, match="hidden"):
        pii.find_pii(frame(spark, ["x"]).withColumn("base", F.lit(1)), keep=["base"])


def brute_features(t):
    import unicodedata

    blank = "".join(map(chr, (32, *range(9, 14))))
    parts = t.translate(str.maketrans(dict.fromkeys(blank, " "))).split(" ")
    spaced = re.split(r"[\x20\x09-\x0D]+", t)
    words, n = sum(1 for w in parts if w), len(t)
    kinds = [unicodedata.category(c) for c in t]
    letters, share = sum(k[0] == "L" for k in kinds), lambda a, b: a / (b + 8)
    count = lambda chars: sum(c in chars for c in t)
    return [share(sum(k == "Lu" for k in kinds), letters), share(letters, n), share(count("0123456789"), n), share(count("!?"), words), share(count("#$%&*+=@\\^_`~<>{}[]"), words), share(count("|"), words), share(count(".,;:"), words), min(share(n, words), 30) / 10, share(sum(a == b for a, b in zip(spaced, spaced[1:], strict=False)), words)]


def test_quality_by_brute_force(spark):
    """Features from Python, the whole co-training over plain lists, scores by the formula."""
    rnd = random.Random(21)
    text = lambda ok: " ".join(rnd.choice(["alpha", "Beta", "of", "the"]) + ("" if ok else rnd.choice(["!!", "|", "$", ""])) for _ in range(rnd.randrange(4, 60))) + "."
    truth = [i % 3 > 0 for i in range(260)]
    texts = [text(ok) for ok in truth] + [None, " "]
    docs = frame(spark, texts).withColumn("_f", F.lit(1)).withColumn("_y", F.lit(1)).withColumn("id", F.lit(1)).withColumn("row", F.lit(1))
    labelled = {i: int(ok) for i, ok in enumerate(truth) if i % 2 == 0}
    labels = spark.createDataFrame([(i, y, 0) for i, y in labelled.items()] * 2 + [(1, 0, 0), (1, 1, 0), (None, 1, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    page = docs.select("doc_id", *[c.cast("double").alias(f"p{i}") for i, c in enumerate(quality.page_features(set(docs.columns)).values())]).collect()
    pages = {r[0]: list(r)[1:] for r in page}
    own = {i: brute_features(t or "") for i, t in enumerate(texts)}
    free = [i for i in range(len(truth)) if i not in labelled]
    for r in docs.select("doc_id", F.array(*[c.cast("double") for c in quality.text_features(F.col("text")).values()]).alias("f")).collect():
        assert np.allclose(r.f, own[r.doc_id])

    def surest(view, model, most):
        z = sorted((float(model.raw(np.array([own[i] if view == 0 else pages[i]]))[0]), i) for i in free)
        pick = lambda rows: [(a, i, own[i] + pages[i]) for a, i in rows][:most]
        return pick([x for x in z if x[0] < -quality.SURE_FROM]), pick(sorted((x for x in z if x[0] > quality.SURE_FROM), key=lambda x: (-x[0], x[1])))

    ids = sorted(labelled)
    models, prior = quality.co_train([np.array([own[i] for i in ids]), np.array([pages[i] for i in ids])], np.array([labelled[i] for i in ids]), surest)
    for i, t in enumerate(texts):
        odds = models[0].odds(np.array([own[i]]))[0] + models[1].odds(np.array([pages[i]]))[0] - prior if (t or "").strip() else prior
        assert abs(got[i].score - 1 / (1 + np.exp(-odds))) < 1e-6
    twice = quality.score_quality(docs.union(docs), labels).collect()
    assert len(twice) == 2 * len(texts) and {(r.doc_id, round(r.score, 6)) for r in twice} == {(i, round(r.score, 6)) for i, r in got.items()}


def test_viterbi_by_brute_force(spark):
    rnd = random.Random(17)
    pieces_ = {c: (-3.0 - k / 8, k + 1) for k, c in enumerate("abcd")} | {w: (-float(rnd.randrange(2, 40)) / 4 - k / 64, 10 + k) for k, w in enumerate(["ab", "abc", "bc", "cd", "bcd", "aa", "dab", "cdab"])}
    unknown = (-20.0, 0)
    segs = sorted({"".join(rnd.choice("abcdx") for _ in range(rnd.randrange(1, 12))) for _ in range(150)})

    def paths(s, at=0):
        if at == len(s):
            yield 0.0, []
        for end in range(at + 1, min(len(s), at + 4) + 1):
            found = pieces_.get(s[at:end]) or (unknown if end == at + 1 else None)
            if found:
                for total, rest in paths(s, end):
                    yield total + found[0], [at << 20 | found[1], *rest]

    vocabulary = spark.createDataFrame([(p, x, i) for p, (x, i) in pieces_.items()], "piece string, score double, id int")
    got = {r.seg: r.picks for r in pieces.segment_unigrams(spark.createDataFrame([(x,) for x in [*segs, ""]], "seg string"), vocabulary, 4, unknown).collect()}
    assert set(got) == set(segs)
    for x in segs:
        best = max(total for total, _ in paths(x))
        assert got[x] in [p for total, p in paths(x) if abs(total - best) < 1e-9]

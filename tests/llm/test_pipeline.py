"""The pipeline, stage by stage, against brute force and the library."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from corpus_pipeline import STAGES


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(12)
    sentence = lambda n: " ".join(rnd.choice(["alpha", "beta", "of", "the", "river", "stone", "Über", "cloud"]) + rnd.choice(["", "", "", ","]) for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(240):
        text = sentence(rnd.randrange(12, 120))
        if i % 6 == 0:
            text = text.upper().replace(" ", "!! ")
        elif i % 10 == 1 and i > 10:
            text = rows[i - 10][1]
        elif i % 10 == 3:
            text += f" Write to a{i}@example.org or +1 (555) 000-{1000 + i}."
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
        labels.append((i, int(i % 6 > 0), 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", "src0", 0)]
    rows = [(*r, "own", None, 3) for r in rows]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, base string, keep boolean, score int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows


def test_stages(spark, corpus):
    sf, rows = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        seen[name] = docs.collect()
        if name != STAGES[-1][0]:
            assert docs.columns == columns
    truth = {r[0] for r in rows if r[0] >= 1000 or r[0] % 6}
    assert {r.doc_id for r in seen["quality"]} == truth
    left = {r.doc_id: r.text for r in seen["near_duplicates"]}
    assert len(left) == len(seen["near_duplicates"]) and {1000, 1001} <= set(left)
    texts = [r.text for r in seen["quality"] if r.text]
    assert len(set(texts)) == len({t for t in left.values() if t})
    clean = {r.doc_id: r.text for r in seen["personal_data"]}
    assert set(clean) == set(left)
    for i, t in clean.items():
        if i % 10 == 3 and i < 1000:
            assert "@example.org" not in t and "[EMAIL]" in t and "[PHONE]" in t
        elif left[i] is not None:
            assert t == left[i]
    words = {i: (t or "").split() for i, t in clean.items()}
    taken: dict = {}
    for r in seen["mixing"]:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert all(n <= 2 * len(words[i]) for i, n in taken.items())
    total = sum(map(len, words.values()))
    assert abs(sum(taken.values()) - 1.5 * total) <= 0.05 * total
    assert len(seen["tokens"]) == len(seen["mixing"]) and all(r.round_trip and r.n_ids == len(r.ids) for r in seen["tokens"])


def test_run(spark, corpus):
    sf, _ = corpus
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"] and out.count() > 200


def test_repeated_rows_long_texts_and_empty_table(spark, corpus, tmp_path):
    """A row that repeats goes once, a very long text passes all stages whole, no rows give none."""
    sf, rows = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    near = dict(STAGES)["near_duplicates"]
    twice = docs.filter("doc_id IN (2, 1000)")
    out = near(spark, docs.union(twice).union(twice), sf).filter("doc_id IN (2, 1000)").collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.doc_id)] == [2, 1000]
    rnd = random.Random(3)
    long = " ".join(f"word{rnd.randrange(5000)}" for _ in range(60_000)) + "."
    own = spark.createDataFrame([(2000, long, "en", "src0", len(long), "own", None, 3)], docs.schema)
    one = docs.filter("doc_id < 30").union(own)
    for name, stage in STAGES[1:]:
        one = spark.createDataFrame(stage(spark, one, sf).collect(), stage(spark, one, sf).schema)
        kept = one.filter("doc_id = 2000").collect()
        assert kept, name
        if name in ("near_duplicates", "personal_data"):
            assert kept[0].text == long
    assert all(r.round_trip for r in kept)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

"""Compaction plans of boundaries that lie in many blocks."""

import random

from cairnlake.operators import lake


def one_pass(rows, most_inputs, most_bytes):
    """{lake_id: (bin, position, logical_offset)} of one boundary, entry after entry."""
    no, held, n, out = 0, 0, 0, {}
    for key, size in sorted(rows):
        if n and (held + size > most_bytes or n == most_inputs):
            no, held, n = no + 1, 0, 0
        out[key] = no, n + 1, held
        held, n = held + size, n + 1
    return out


def test_blocks_make_the_bins_of_one_pass(spark):
    rng = random.Random(5)
    schema = "lake_id string, tenant_id string, tier string, retention_class string, label string, status string, size_bytes long"
    sizes = {(t, f"{t}{i:03d}"): rng.choice([0, 1, 30, 55, 100, 101, 400]) if t != "small" else 1 for t, n in (("mixed", 300), ("small", 120), ("few", 3)) for i in range(n)}
    rows = [(k, t, "RAW", "STANDARD", "OPEN", "VERIFIED", s) for (t, k), s in sizes.items()]
    df = spark.createDataFrame(rows, schema)
    want = {}
    for t in ("mixed", "small", "few"):
        bins = one_pass([(k, s) for (b, k), s in sizes.items() if b == t and s <= 400], 7, 400)
        shared = [b for b, _, _ in bins.values()]
        want |= {k: (t, b, p, o) if shared.count(b) > 1 else "SINGLE_INPUT" for k, (b, p, o) in bins.items()}
    for packed in (3, 40, 10_000):
        got, ids = {}, {}
        for r in lake.compaction_plan(df, most_inputs=7, most_bytes=400, packed=packed).collect():
            got[r.lake_id] = r.reason or (r.bin_id, r.position, r.logical_offset)
            if not r.reason:
                t, b, *_ = want[r.lake_id]
                assert ids.setdefault(r.bin_id, (t, b)) == (t, b)
        assert {k: v if isinstance(v, str) else (*ids[v[0]], v[1], v[2]) for k, v in got.items()} == want
        assert len(set(ids.values())) == len(ids)

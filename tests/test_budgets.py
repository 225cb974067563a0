"""Budgets over blocks of time, as a stream, and percentiles by ranges, against plain loops."""

import math
import random
from datetime import datetime, timedelta

import pytest

from cairnlake.operators import admission, serve
from cairnlake.streaming.intake import budget_stream

START = datetime(2024, 1, 1)


def plainly(rows, names, ceilings, seconds):
    """(key, request) -> admitted, request by request."""
    out, state = {}, {}
    for key, at, request, *amounts in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        until, used = state.get(key, (None, None))
        fresh = until is None or at >= until
        sums = amounts if fresh else [u + a for u, a in zip(used, amounts)]
        ok = fresh or all(s <= ceilings[n] for s, n in zip(sums, names))
        state[key] = (at + timedelta(seconds=seconds) if fresh else until, sums if ok else used)
        out[key, request] = ok
    return out


def made(seed, n, spread, keys=("a", "b", None)):
    rnd = random.Random(seed)
    return [(rnd.choice(keys), START + timedelta(seconds=rnd.choice((rnd.randrange(spread), rnd.randrange(spread // 50) * 50))), i, 1.0, float(rnd.randrange(5))) for i in range(n)]


SCHEMA = "key string, at timestamp, request_id long, calls double, nodes double"


@pytest.mark.parametrize(("seed", "n", "spread", "seconds"), [(1, 400, 20_000, 60), (2, 400, 3_000, 60), (3, 300, 400_000, 900), (4, 1, 100, 7), (5, 500, 900, 30)])
def test_admit(spark, seed, n, spread, seconds):
    rows, ceilings = made(seed, n, spread), {"calls": 5, "nodes": 9}
    want = plainly(rows, ["calls", "nodes"], ceilings, seconds)
    sums = {}
    for key, _, request, calls, nodes in rows:
        s = sums.setdefault(key, [0, 0, 0.0, 0.0])
        s[0] += 1
        if want[key, request]:
            s[1], s[2], s[3] = s[1] + 1, s[2] + calls, s[3] + nodes
    got = admission.admit(spark.createDataFrame(rows, SCHEMA), {"calls": "calls", "nodes": "nodes"}, ceilings, seconds).collect()
    assert {r.key: [r.requests, r.accepted, r.sum_calls, r.sum_nodes] for r in got} == sums and all(r.rejected == r.requests - r.accepted for r in got)


def test_admit_odd_rows(spark):
    """Empty logs, requests without a time, and before 1970."""
    log = spark.createDataFrame([("a", None, 1, 1.0, 0.0), ("a", datetime(1969, 12, 31, 23, 59, 59), 2, 1.0, 0.0), ("a", datetime(1970, 1, 1), 3, 1.0, 0.0), ("z", None, 4, 1.0, 0.0)], SCHEMA)
    got = {r.key: (r.requests, r.accepted) for r in admission.admit(log, {"calls": "calls"}, {"calls": 1}).collect()}
    assert got == {"a": (3, 1), "z": (1, 0)}
    assert admission.admit(log.limit(0), {"calls": "calls"}, {"calls": 1}).count() == 0


def test_steps():
    """A block's step function against its entries walked one by one, for every end it may begin with."""
    rnd = random.Random(7)
    for _ in range(300):
        length, begin = rnd.randrange(1, 12), rnd.randrange(-3, 3) * 48
        t = sorted({begin + rnd.randrange(4 * length) for _ in range(rnd.randrange(1, 15))})
        upto, exits = admission._exits(t, begin, length)
        for until in (admission.NEVER, *range(begin - 2, begin + length)):
            end = until
            for x in t:
                end = x + length if x >= end else end
            assert next((e for u, e in zip(upto, exits) if u >= until), until) == end


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_budget_stream(spark, rocks, tmp_path):
    """Files of shuffled requests, one run each, give what a loop in order gives; entries leave the state."""
    rows, ceilings, seconds = made(11, 120, 1200, ("a", "b")), {"calls": 5, "nodes": 9}, 60
    want = plainly(rows, ["calls", "nodes"], ceilings, seconds)
    late = random.Random(3)
    rows.sort(key=lambda r: r[1] + timedelta(seconds=late.randrange(240)))
    parts = [rows[:50], rows[50:], [("flush", START + timedelta(days=1), 1000, 1.0, 0.0)]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = budget_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), {"calls": "calls", "nodes": "nodes"}, ceilings, seconds, "5 minutes")
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    got = {(r.key, r.request_id): r.admitted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want


def test_percentiles(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(("hot", "hot", "cold", None)), rnd.choice((None, float(rnd.randrange(40)), rnd.random()))) for _ in range(900)] + [("none", None), ("one", 3.0)]
    shares = (0.0, 0.5, 0.95, 1.0)
    got = {r.g: tuple(r)[1:] for r in serve.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        want[g] = (len(v), *(v[max(1, math.ceil(s * len(v))) - 1] if v else None for s in shares), v[-1] if v else None)
    assert got == want
    assert serve.percentiles(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0

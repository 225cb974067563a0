"""Traversals and edge policies: by brute force, and on edges that leave their derived ids out."""

import itertools
import random

import pytest

from cairnlake.operators import access, graph

SCOPE = graph.Scope("t", ("OPEN",))
OBJECTS = "object_id string, canonical_type string, tenant_id string, status string, label string"
EDGES = "relationship_id string, source_id string, relation string, target_id string, label string, status string"


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(3)
    objects = [(f"o{i}", "X", "t" if i % 5 else "other", "ACTIVE", rnd.choice(["OPEN", "SENSITIVE"])) for i in range(14)]
    pairs = rnd.sample(list(itertools.product(range(14), range(14))), 50)
    edges = [(f"o{a}|o{b}", f"o{a}", rnd.choice("rs"), f"o{b}", rnd.choice(["OPEN", "OPEN", "SENSITIVE"]), rnd.choice(["ACTIVE", "ACTIVE", "SUPERSEDED"])) for a, b in pairs]
    return objects, edges, spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(edges, EDGES)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_traverse(spark, made, depth):
    objects, edges, o, e = made
    own = {x[0] for x in objects if x[2] == "t"}
    live = [x for x in edges if x[5] == "ACTIVE" and x[4] == "OPEN" and x[3] in own]
    ids = ["o0", "o1", "o5", "o5"]  # two of another tenant, one twice
    expected, paths = [], [([s], None) for s in ids]
    for d in range(1, depth + 1):
        paths = [([*p, x[3]], x) for p, _ in paths for x in live if x[1] == p[-1] and x[3] not in p]
        expected += [(p[0], d, *x[:4], p) for p, x in paths]
    starts = spark.createDataFrame([(i,) for i in ids], "object_id string")
    got = graph.traverse(o, e, starts, ["r", "s"], depth, SCOPE)
    assert got.columns == ["start_id", "depth", "relationship_id", "source_id", "relation", "target_id", "path"]
    assert sorted(map(tuple, got.collect())) == sorted(expected) and expected
    bare = graph.traverse(o, e.drop("relationship_id"), starts, ["r", "s"], depth, SCOPE)
    assert sorted(map(tuple, bare.collect())) == sorted((*x[:2], *x[3:]) for x in expected)


def test_neighbors_and_policy_without_ids(spark, made):
    objects, edges, o, e = made
    own, seen = {x[0] for x in objects if x[2] == "t"}, {x[0] for x in objects if x[4] == "OPEN"}
    got = graph.neighbors(o, e.drop("relationship_id"), o.filter("object_id < 'o5'"), ["r"], SCOPE)
    assert sorted(map(tuple, got.collect())) == sorted(x[1:4] for x in edges if x[2] == "r" and x[4:] == ("OPEN", "ACTIVE") and x[1] < "o5" and x[3] in own)
    got = access.edge_policy(e.drop("relationship_id"), o, ["OPEN"]).select("source_id", "target_id")
    assert sorted(map(tuple, got.collect())) == sorted((x[1], x[3]) for x in edges if x[4] == "OPEN" and {x[1], x[3]} <= seen)

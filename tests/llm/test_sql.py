"""The operators that SQL can express, against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from cairnlake import llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    want = con.execute(llm.oracle_sql()[name]).fetchdf()
    got = llm.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    plain = lambda df: sorted(repr([None if x is None or x != x else x.item() if hasattr(x, "item") else x for x in r]) for r in df[columns].astype(object).values.tolist())
    assert plain(got) == plain(want)


def test_other_modules_stand_alone():
    """Nothing outside the subpackage imports it."""
    root = os.path.dirname(os.path.dirname(llm.__file__))
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f), encoding="utf-8") as text:
                        assert "cairnlake.llm" not in text.read(), f

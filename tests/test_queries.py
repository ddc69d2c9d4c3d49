"""Every query outside the llm subpackage against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from spanloom import plans
from spanloom.plans.inputs import TABLES

QUERIES = plans.all_queries()


@pytest.fixture(scope="module")
def duck(smallest):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{smallest}/{t}.parquet'")
    return con


def shown(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return f"[{','.join(map(shown, v))}]"
    return str(v)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_equals_its_sql(spark, smallest, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, smallest)
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    ours = sorted(tuple(shown(r[c]) for c in sorted(names)) for r in df.collect())
    theirs = sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql))
def test_query_without_sql_has_rows(spark, smallest, name):
    df = QUERIES[name][0](spark, smallest)
    assert df.columns and df.limit(1).count() == 1


@pytest.mark.parametrize("name", ["c2_label_factor", "c8_runtime", "c9_enhanced"])
def test_texts_are_not_broadcast(spark, smallest, name):
    assert "Broadcast" not in QUERIES[name][0](spark, smallest)._jdf.queryExecution().executedPlan().toString()


def test_texts_of_one_split_are_dealt_over_the_tasks(spark, smallest):
    assert spark.read.parquet(f"{smallest}/customer.parquet").rdd.getNumPartitions() == 1
    assert QUERIES["c9_enhanced"][0](spark, smallest).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_nothing_else_imports_the_llm_subpackage():
    import re
    from pathlib import Path

    root = Path(plans.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"spanloom\.llm|from \.*llm|import llm", p.read_text()), p

"""The pipeline's stages against brute force, each on its own input, and the queries against their SQL."""

from __future__ import annotations

import inspect
import os
from pathlib import Path

import duckdb
import pytest
from test_llm_operators import brute_contamination, brute_lines, near_classes

import corpus_pipeline
from spanloom.llm import queries
from spanloom.llm import sentencepiece_codec as codec
from spanloom.llm.common import fresh_path, shared_dir, table


@pytest.fixture(scope="module")
def stages(spark, smallest):
    docs = table(spark, smallest, "documents")
    found = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, smallest).write.parquet(path)
        found[name] = docs = spark.read.parquet(path)
    return found


def rows(df):
    return {r.doc_id: r for r in df.collect()}


ODD = [
    (1, "the quick brown fox of the house is in the garden and it was with us for the day " * 3, "a"), (1, "quite another text of the same id with words of its own that nobody else has here today", "b"), (2, None, "a"), (3, "", "b"), (None, "a text without an id", "c"),
    (4, "the quick brown fox of the house is in the garden and it was with us for the day " * 3, "c"), (5, "x", None), (5, "x", None), (6, "word " * 60_000, "a"),
]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, __h long, __key string, __rest string, __own int, rejected string, n_removed string, junk_score int, ids string, items int"


@pytest.mark.parametrize("odd", [True, False])
def test_stages_on_odd_rows_and_none(spark, tmp_path, odd):
    made = [(i, t, "en", s, 7, 1, 2, 3, "k", "r", 4, "no", "n", 5, "i", 6) for i, t, s in (ODD if odd else [])]
    docs = spark.createDataFrame(made, CLASH)
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)] if odd else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "nothing of this kind stands in any of them at all, not even near the end of it")] if odd else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda df: sorted(((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in df.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names, name
        rest = [c for c in docs.columns if c not in ("text", "n_chars")]
        assert {tuple(r[c] for c in rest if c not in ("doc_id", "source")) for r in out.collect()} <= {tuple(r[c] for c in rest if c not in ("doc_id", "source")) for r in docs.collect()}, name
        if odd:
            kept = key(out)
            assert {(True, 0, False, "a text without an id"), (False, 5, False, "x")} <= set(kept), name
            if name == "near_duplicates":
                assert [k[:2] for k in kept] == [(False, 1), (False, 1), (False, 2), (False, 5), (False, 6), (True, 0)]
            else:
                assert len(kept) == len(ODD) or name == "quality", name
        else:
            assert out.count() == 0
    tokens = corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()
    assert len(tokens) == len(made) and all(r.n_tokens == len(r.ids) for r in tokens)


def test_run_leaves_but_the_last_stages_input(spark, smallest):
    shared = Path(shared_dir(spark))
    before = set(os.listdir(shared))
    out = corpus_pipeline.run(spark, smallest).count()
    assert out > 100 and [x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before] == ["stage-decontaminate"]


def test_clusters_must_name_a_shared_folder():
    class Stub:
        conf = type("C", (), {"get": lambda self, key, default: None})()
        sparkContext = type("S", (), {"master": "spark://host:7077", "applicationId": "x"})()

    with pytest.raises(RuntimeError):
        shared_dir(Stub())


def test_all_but_the_last_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert 4 <= len(names) <= 5 and corpus_pipeline.ORACLE_SQL is None
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])
    assert all(len(inspect.signature(f).parameters) == 3 for _, f in corpus_pipeline.STAGES)


def test_quality_keeps_clean_documents(spark, smallest, stages):
    kept = set(rows(stages["quality"]))
    marks = table(spark, smallest, "labels").collect()
    assert {r.doc_id for r in marks if r.quality == 1 and r.toxic == 0} <= kept
    junk = {r.doc_id for r in marks if r.quality == 0}
    assert len(junk - kept) >= 0.8 * len(junk)


def test_lines(stages):
    before, after = rows(stages["quality"]), rows(stages["lines"])
    expected = brute_lines([(i, r.text, r.source) for i, r in before.items()], 10)
    assert {i: r.text for i, r in after.items()} == {i: x[2] for i, x in expected.items()}


def test_one_of_each_class_stays(stages):
    before, after = rows(stages["lines"]), rows(stages["near_duplicates"])
    assert set(after) == {c for _, c in near_classes([(i, r.text) for i, r in before.items()])}


def test_no_contaminated_document_stays(spark, smallest, stages):
    before, after = rows(stages["near_duplicates"]), rows(stages["decontaminate"])
    items = [(r.item_id, r.text) for r in table(spark, smallest, "benchmark").collect()]
    bad = {i for i, r in before.items() if any(x.endswith("True)") for x in brute_contamination([(i, r.text)], items))}
    assert bad and set(after) == set(before) - bad


def test_tokens_are_the_librarys(stages):
    c = codec.Codec(codec._model_bytes(codec.MODEL))
    texts, found = rows(stages["decontaminate"]), rows(stages["encode"])
    assert set(texts) == set(found)
    for i, r in found.items():
        assert list(r.ids) == c.judge.encode(texts[i].text or "") and r.n_tokens == len(r.ids)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, smallest, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{smallest}/{t}.parquet'")
    df = queries.QUERIES[name](spark, smallest)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(str(r[c]) for c in sorted(names)) for r in df.collect()) == sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))

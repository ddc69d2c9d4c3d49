"""Operators that SQL doesn't express, on small inputs."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import validators
from spanloom.operators import classify, context, extract, grid, layout, linking, matching, review, rules, tokens

ENTITY = "doc_id long, entity_id int, start int, end int, type string, text string, confidence double, source string"


def test_matching_is_one_to_one(spark):
    found = [(1, 1, 0, 5, "A", "Ann a", 0.5, "x"), (1, 2, 10, 20, "A", "ann  A", 0.5, "x"), (1, 3, 30, 40, "B", "b", 0.5, "x"), (1, 4, 50, 55, "B", "c", 0.5, "x"), (2, 1, 0, 3, "A", "z", 0.5, "x")]
    expected = [(1, 11, 100, 105, "A", "ann a", 1.0, "y"), (1, 12, 12, 22, "A", "other", 1.0, "y"), (1, 13, 34, 44, "B", "bb", 1.0, "y"), (1, 14, 54, 70, "B", "cc", 1.0, "y")]
    out = matching.match(spark.createDataFrame(found, ENTITY), spark.createDataFrame(expected, ENTITY)).orderBy("doc_id", "entity_id").collect()
    assert [(r.doc_id, r.entity_id, r.expected_id, r.kind, r.overlap) for r in out] == [(1, 1, 11, "exact", 1.0), (1, 2, 12, "fuzzy", 0.8), (1, 3, 13, "fuzzy", 0.6), (1, 4, None, "none", 0.0), (2, 1, None, "none", 0.0)]


def test_enhancer(spark):
    full = "E-mail: ann@b.ch for you" + " " * 200 + "x@y.ch in test.com"
    rows = [(1, "EMAIL", 8, 16, "ann@b.ch", full, "en", 0.3), (1, "EMAIL", 224, 230, "x@y.ch", full, "en", 0.5), (1, "EMAIL", 224, 230, "x@y.ch", full, "it", 0.5), (1, "ADDRESS", 0, 3, "E-m", full, "en", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, type string, start int, end int, text string, full string, lang string, confidence double")
    out = [r.enhanced for r in context.enhance(df).orderBy("type", "start", "lang").collect()]
    up = min(0.35, (1.0 + 0.8) * 1.2 / 1.2 * 0.35)
    assert out[0] == 0.5 and out[1] == pytest.approx(max(0.4, 0.3 + up), abs=1e-6)
    assert out[2] == pytest.approx(0.5 - 0.9 * 0.8 / 1.2 * 0.35, abs=1e-6) and out[3] == 0.5


def test_enhancer_regions(spark):
    """Words of all regions that hold the span count, of its own document only; regions without words or ends count for none."""
    rows = [(k, "EMAIL", 4, 10, "a@b.ch", "zzz a@b.ch", "it", 0.5) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, type string, start int, end int, text string, full string, lang string, confidence double")
    given = [(1, 0, 20, ["ZZZ"]), (1, 5, 20, ["zzz"]), (1, 0, 20, None), (1, None, 20, ["zzz"]), (2, 0, 9, ["zzz"]), (4, 0, 20, ["zzz"]), (None, 0, 20, ["zzz"])]
    regions = spark.createDataFrame(given, "doc_id long, from int, to int, words array<string>")
    out = context.enhance(df, regions=regions)
    assert out.columns == [*df.columns, "enhanced"]
    assert [(r.doc_id, r.enhanced) for r in out.orderBy("doc_id").collect()] == [(1, pytest.approx(0.5 + 0.8 * 1.2 / 1.2 * 0.35, abs=1e-6)), (2, 0.5), (3, 0.5)]


def test_spans_keep_columns_of_their_own_text(spark):
    docs = spark.createDataFrame([(1, "a@b.ch", "x"), (1, "c@d.ch", "y"), (2, None, "z")], "doc_id long, text string, full string")
    out = extract.extract(docs, extract.HIGH_RECALL[2:3], keep=("full",))
    assert sorted((r.doc_id, r.text, r.full) for r in out.collect()) == [(1, "a@b.ch", "x"), (1, "c@d.ch", "y")]


def test_sizes_round_as_in_the_sql(spark):
    """Every quarter and eighth of a unit, and what is a byte off."""
    import duckdb

    sizes = sorted({max(0, k * unit // 8 + off) for unit in (1024, 1048576) for k in range(1, 2000) for off in (-1, 0, 1)} | {786432 * 7919})
    out = {r.size: r.shown for r in spark.createDataFrame([(x,) for x in sizes] + [(None,)], "size long").select("size", review.readable_size(F.col("size")).alias("shown")).collect()}
    theirs = dict(duckdb.execute("select size, case when size < 1024 then size || ' B' when size < 1048576 then format('{:.1f} KB', size / 1024) else format('{:.1f} MB', size / 1048576) end from (select unnest(?::bigint[]) as size)", [sizes]).fetchall())
    assert out[786432 * 7919] == "5939.2 MB" and out[1280] == "1.2 KB" and out[1792] == "1.8 KB"
    assert {k: v for k, v in out.items() if k is not None} == theirs
    assert out[None] is None


def test_tables(spark):
    items = [(1, 10 * r + c, f"{r}{c}", 100.0 * c + r % 2, 700.0 - 20 * r, 30.0) for r in range(4) for c in range(3)]
    items += [(2, i, "one line", 50.0, 700.0 - 20 * i, 30.0) for i in range(5)]
    prose = "a rather long sentence, which goes on and on, without any end."
    items += [(3, 10 * r + c, prose, 300.0 * c, 700.0 - 20 * r, 250.0) for r in range(3) for c in range(2)]
    out = layout.detect_tables(spark.createDataFrame(items, "page_id long, item_id int, str string, x double, y double, width double")).collect()
    assert [(r.page_id, r.rows, r.columns, r.cells, r.confidence) for r in out] == [(1, 4, 3, 12, 0.96)]


def test_lines(spark):
    items = [(1, 1, "World", 60.0, 700.0, 20.0), (1, 2, "Hello", 10.0, 701.0, 45.0), (1, 3, "ab", 10.0, 680.0, 9.0), (1, 4, "cd", 20.0, 681.0, 9.0)]
    out = layout.lines_of(spark.createDataFrame(items, "page_id long, item_id int, str string, x double, y double, width double")).orderBy("line").collect()
    assert [r.text for r in out] == ["Hello World", "abcd"]


def test_registry_scores(spark):
    docs = spark.createDataFrame([(1, "756.1234.5678.97 and x@mail1.ch or y@b.ch"), (2, None)], "doc_id long, text string")
    r = rules.Registry()
    r.register(rules.Recognizer("mail", ((extract.HIGH_RECALL[2], 0.8),), deny=("X@mail1.ch",), weak=True))
    assert [(x.text, x.score) for x in r.analyze(docs).collect()] == [("y@b.ch", 0.32)]
    refusing = rules.Registry()
    refusing.register(rules.Recognizer("mail", ((extract.HIGH_RECALL[2], 0.8),), validator=lambda c: F.struct(c.startswith("y").alias("valid"))))
    refusing.register(rules.Recognizer("upper", ((extract.Pattern("WORD", "x", "AND|OR"), 0.5),)))
    assert sorted((x.text, x.score) for x in refusing.analyze(docs).collect()) == [("and", 0.5), ("or", 0.5), ("y@b.ch", 0.8)]
    assert [x.text for x in refusing.analyze(docs, types=("EMAIL",)).collect()] == ["y@b.ch"]
    assert refusing.load([{"name": "a", "type": "T", "regex": "(", "score": 0.1}, {"name": "b", "type": "T", "regex": "x", "score": 2}, {"name": "c", "type": "T", "regex": "756", "score": 1}]) == ["a", "b"]
    assert refusing.analyze(docs, types=("T",)).count() == 1
    assert rules.Registry().analyze(docs).count() == 0


def test_sentences_and_runs(spark):
    docs = spark.createDataFrame([(1, "One is here. Two? Dr. Who is. and\nEnd.")], "doc_id long, text string")
    rows = tokens.sentences(docs).orderBy("position").collect()
    assert "".join(r.text for r in rows) == "One is here. Two? Dr. Who is. and\nEnd." and [r.text.strip() for r in rows][:2] == ["One is here.", "Two?"]
    assert all(r.end - r.start == len(r.text) for r in rows)


def test_document_types(spark):
    docs = spark.createDataFrame([(1, "Invoice no. A123\ninvoice invoice total vat tax subtotal quantity CHF 100.00 rechnung betrag mwst netto brutto"), (2, ""), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.doc_type for r in classify.classify(docs).collect()}
    assert out[1] == "INVOICE" and out[2] == "UNKNOWN"


def test_occurrences_overlap(spark):
    docs = spark.createDataFrame([(1, "aaaa"), (2, "b")], "doc_id long, text string")
    marked = spark.createDataFrame([(1, "X", "aa", 0, 2), (2, "X", "zz", 0, 2)], "doc_id long, type string, text string, start int, end int")
    assert sorted((r.doc_id, r.start, r.end) for r in rules.expand_occurrences(marked, docs).collect()) == [(1, 1, 3), (1, 2, 4)]


def test_person_names(spark):
    names = ["Anna Muster", "Anna", "ANNA Muster", "Rue Basse", "Roche Holding", "Müller Élise", "A B", "anna muster"]
    rows = spark.createDataFrame([(n,) for n in names], "t string").select("t", extract.is_person_name(F.col("t")).alias("ok")).collect()
    assert [r.t for r in rows if r.ok] == ["Anna Muster", "Müller Élise"]


def test_review_states(spark):
    found = spark.createDataFrame([(1, 1, 0, 2, "A", "t", 0.9, "x"), (1, 2, 0, 2, "A", "u", 0.9, "x")], ENTITY)
    actions = spark.createDataFrame([(1, 1, 1, "approved"), (1, 1, 2, "rejected")], "doc_id long, entity_id int, ts int, status string")
    assert {r.entity_id: r.status for r in review.decided(found, actions).collect()} == {1: "rejected", 2: "pending"}
    assert review.batch_states(spark.createDataFrame([], "status string")).first().percent == 0


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert extract.extract(none, extract.HIGH_RECALL).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert extract.extract(nulls, extract.DETECTOR).count() == 0


def brute_chunks(text, most, overlap):
    """Chunks of whole sentences by plain loops, sentence by sentence."""
    def sentences():
        out, now, i = [], "", 0
        while i < len(text):
            now += text[i]
            if text[i] in ".!?":
                after, then = text[i + 1 : i + 2], text[i + 2 : i + 3]
                ends = i == len(text) - 1 or after == "\n" or (after.isspace() and then and then in "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÉÈÊËÎÏÔÛÙŸŒÆ")
                if ends and not re.search(tokens.SHORTENED, now, re.I):
                    out.append((i + 1 - len(now), i + 1))
                    now = ""
                    while text[i + 1 : i + 2].isspace():
                        i += 1
            i += 1
        return [*out, (len(text) - len(now), len(text))] if now.strip() else out

    count = lambda s: max(-(-len(s) // 4), len(s.split()))
    if not text:
        return []
    found = sentences()
    if count(text) <= most or not found:
        return [(0, len(text))]
    bounds = [(a, found[i + 1][0] if i + 1 < len(found) else b) for i, (a, b) in enumerate(found)]
    out, held, size, first = [], [], 0, 0
    for i, (a, b) in enumerate(found):
        n = count(text[a:b])
        if size + n > most and held:
            out.append((bounds[first][0], bounds[first + len(held) - 1][1]))
            again, total = [], 0
            for s in reversed(held):
                if total >= overlap:
                    break
                again.insert(0, s)
                total += s
            held, size, first = again, total, i - len(again)
        held.append(n)
        size += n
    return [*out, (bounds[first][0], bounds[first + len(held) - 1][1])]


def test_token_chunks_against_plain_loops(spark, smallest):
    texts = [r.text for r in spark.read.parquet(f"{smallest}/documents.parquet").select("text").collect()]
    texts += ["", " ", "no end", "One. Two. Three! Four? Dr. Five e.g. Six. seven\nEight.\nNine.  Ten.", "A. " * 400, "word " * 900 + ". Next one. Last"]
    for most, overlap in ((512, 50), (8, 3), (1, 5), (3, 0)):
        for text in texts:
            assert tokens.token_chunks(text or "", most, overlap) == brute_chunks(text or "", most, overlap)
    docs = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.end) for r in tokens.sentence_chunks(docs).collect()] == [(2, 0, 3)]


def test_predictions_are_whole_or_none(spark):
    def model():
        def predict(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad")
            return [[("P", 0, 1, 0.9), ("P", 0, 1, 0.2)] for _ in texts]

        return predict

    def choosy():
        def predict(texts):
            if len(texts) > 1:
                raise ValueError("one at a time")
            return [[("P", 0, 1, 0.9)]]

        return predict

    rows = spark.createDataFrame([(1, 5, "ok"), (2, 0, "fine")], "doc_id long, start int, text string").coalesce(1)
    assert sorted((r.doc_id, r.start, r.type) for r in tokens.predictions(rows, model, types={"P": "PER"}).collect()) == [(1, 5, "PER"), (2, 0, "PER")]
    assert tokens.predictions(rows, choosy).count() == 2
    with pytest.raises(Exception, match="the model fails on a chunk of 3"):
        tokens.predictions(rows.union(spark.createDataFrame([(3, 0, "bad")], rows.schema)).coalesce(1), model).collect()


def test_merged_tables(spark):
    rows = [(1, 1, ["A ", "b"], ["r1"], 0.0, 0.0, 1.0, 1.0, 0.8), (1, 2, ["a", "B"], ["r2", "r3"], -1.0, 0.0, 3.0, 1.0, 0.6), (1, 3, ["a"], ["r4"], 0.0, 0.0, 1.0, 1.0, 0.9)]
    out = grid.merge_tables(spark.createDataFrame(rows, "doc_id long, table_id int, header array<string>, rows array<string>, x double, y double, x2 double, y2 double, confidence double")).orderBy("table_id").collect()
    assert [(r.table_id, r.header, r.rows, r.x, r.x2, r.confidence) for r in out] == [(1, ["A ", "b"], ["r1", "r2", "r3"], -1.0, 3.0, 0.7), (3, ["a"], ["r4"], 0.0, 1.0, 0.9)]


def test_validator_registry_keeps_the_higher_priority():
    r = validators.ValidatorRegistry()
    assert r.register("A", validators.email, 1) and not r.register("A", validators.phone, 1) and r.register("A", validators.phone, 2)
    assert r.get("A") is validators.phone and r.get("B") is None and "A" in r and len(r) == 1
    r.freeze()
    with pytest.raises(RuntimeError):
        r.register("B", validators.email)


def test_rule_configurations():
    kinds = {k: {} for k in (*classify.RULE_SETS, "UNKNOWN")}
    assert classify.rule_errors({"version": "1", "documentTypes": kinds}) == []
    kinds["FORM"] = {"thresholds": {"autoAnonymize": 0.5, "flagForReview": 0.6, "minConfidence": 0.7}}
    del kinds["LETTER"]
    assert classify.rule_errors({"documentTypes": kinds}) == ["no version", "LETTER: missing", "FORM: autoAnonymize is less than flagForReview", "FORM: flagForReview is less than minConfidence"]


def test_offsets_in_the_original(spark):
    rows = spark.createDataFrame([(1, [(5, 10, 3), (20, 22, 8)])], "k int, e array<struct<start:long,end:long,length:long>>")
    at = lambda n: rows.select(linking.original_offset(F.lit(n).cast("long"), F.col("e"))).first()[0]
    assert [at(n) for n in (0, 4, 5, 7, 8, 17, 18, 25, 26, 30)] == [0, 4, 5, 5, 10, 19, 20, 20, 22, 26]

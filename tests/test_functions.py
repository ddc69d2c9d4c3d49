"""Functions, folds, sources, sinks and streams on small inputs."""

from __future__ import annotations

import io
import json
import re
import unicodedata
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import text as t
from spanloom.functions import validators as v
from spanloom.functions.spans import spans
from spanloom.operators import address, linking, overlap, rules, tokens
from spanloom.sources import markup, sinks
from spanloom.streaming import streams

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def check(spark, validator, texts):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", validator(F.col("t")).alias("r")).orderBy("i").collect()
    return [(r.r.valid, r.r.confidence) for r in rows]


def avs(body: str) -> str:
    total = sum(int(d) * (1 if i % 2 == 0 else 3) for i, d in enumerate(body))
    return body + str((10 - total % 10) % 10)


def iban(country: str, rest: str) -> str:
    digits = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{rest}"


def test_avs(spark):
    good = avs("756123456789")
    bad = good[:-1] + str((int(good[-1]) + 1) % 10)
    assert check(spark, v.swiss_avs, [good, f"{good[:3]}.{good[3:7]}.{good[7:11]}.{good[11:]}", bad, "757" + good[3:], "756", "7" * 21]) == [(True, 0.95), (True, 0.95), (False, 0.3), (False, 0.4), (False, 0.4), (False, 0.3)]


def test_iban(spark):
    good = iban("CH", "00762011623852957")
    spaced = " ".join(good[i : i + 4] for i in range(0, len(good), 4))
    gb = iban("GB", "WEST12345698765432")
    assert check(spark, v.iban, [good, spaced, good.lower(), gb, good[:-1] + str((int(good[-1]) + 1) % 10), good[:-1], "CH12", "X" * 40, "CH" + "é" * 19]) == [(True, 0.95)] * 4 + [(False, 0.4), (False, 0.4), (False, 0.3), (False, 0.3), (False, 0.4)]


def test_uid(spark):
    body = "11607387"
    rest = 11 - sum(int(d) * w for d, w in zip(body, [5, 4, 3, 2, 7, 6, 5, 4], strict=True)) % 11
    good = body + str(0 if rest == 11 else rest)
    text = f"CHE-{good[:3]}.{good[3:6]}.{good[6:]}"
    assert check(spark, v.vat, [text, text[:-1] + str((int(text[-1]) + 1) % 10), "CHE-123", "DE123456789", "XX12"]) == [(True, 0.9), (False, 0.5), (False, 0.4), (True, 0.75), (False, 0.4)]


def test_dates(spark):
    assert check(spark, v.date, ["29.02.2024", "29.02.2023", "31/12/99", "1. März 2024", "3 juillet 2020", "32.01.2020", "01.13.2020", "01.01.1890", "nothing"]) == [(True, 0.85), (False, 0.3), (True, 0.85), (True, 0.85), (True, 0.85), (False, 0.3), (False, 0.3), (False, 0.4), (False, 0.4)]


def test_hostile_inputs_end(spark):
    long = ["a" * 20_000, "a@" + "a." * 10_000, "1" * 20_000, " " * 20_000]
    for check_ in v.VALIDATORS.values():
        assert len(check(spark, check_, long)) == 4


@few
@given(st.lists(st.text("ab1 é😀@.", max_size=40), min_size=1, max_size=6))
def test_spans_are_those_of_python(spark, texts):
    pattern = r"[ab1]+@[ab]+|é+"
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", spans(F.col("t"), pattern).alias("s")).collect()
    for r in rows:
        assert [(s.start, s.end, s.text) for s in r.s] == [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, texts[r.i])]


_entities = st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20), st.sampled_from(["EMAIL", "IBAN", "PHONE"]), st.sampled_from(["ML", "RULE"]), st.integers(0, 10)), min_size=1, max_size=12)
_SCHEMA = "doc_id long, entity_id int, start int, end int, type string, text string, confidence double, source string"


@few
@given(_entities)
def test_folds_leave_no_overlaps(spark, drawn):
    rows = spark.createDataFrame([(1, i, a, a + n, k, f"t{a % 3}", c / 10, s) for i, (a, n, k, s, c) in enumerate(drawn)], _SCHEMA)
    for fold in (overlap.final_dedup, overlap.merge_sources):
        found = sorted((r.start, r.end) for r in fold(rows).collect())
        assert found
        if fold is overlap.final_dedup:
            assert all(a[1] <= b[0] or a[0] == b[0] or a[1] > b[0] for a, b in zip(found, found[1:], strict=False))


@few
@given(st.text("abc é😀\n", max_size=40), st.lists(st.integers(0, 40), max_size=6))
def test_splice_is_undone_by_its_mapping(spark, text, cuts):
    points = sorted({min(c, len(text)) for c in cuts})
    edits = [(a, b, f"<{i}>") for i, (a, b) in enumerate(zip(points[::2], points[1::2], strict=False))]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = spark.createDataFrame([(1, *e) for e in edits], "doc_id long, start int, end int, token string")
    got = linking.rewrite(docs, rows).first()
    expected, at = "", 0
    for a, b, tok in edits:
        expected, at = expected + text[at:a] + tok, b
    assert got.rewritten == expected + text[at:] and got.n_entities == len(edits)
    back = got.rewritten
    for a, b, tok in edits:
        back = back.replace(tok, text[a:b])
    assert back == text


def test_unicode_and_its_map(spark):
    texts = ["plain", "ﬁne ①½ é éx", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", t.normalise_unicode(F.col("t")).alias("n")).orderBy("i").collect()
    for r in rows[:3]:
        assert r.n.text == unicodedata.normalize("NFKC", texts[r.i]) and len(r.n.index_map) == len(r.n.text) + 1
    assert rows[3].n is None or rows[3].n.text in (None, "")
    mapped = spark.createDataFrame([(rows[1].n.index_map,)], "m array<int>").select(*t.map_span(F.col("m"), F.lit(0), F.lit(2))).first()
    assert tuple(mapped) == (0, 1)


def test_address_walk(spark):
    rows = [(1, 0, 10, "STREET_NAME", "Hauptweg"), (1, 11, 13, "STREET_NUMBER", "12"), (1, 14, 18, "POSTAL_CODE", "8001"), (1, 14, 18, "STREET_NUMBER", "8001"), (1, 19, 25, "CITY", "Zürich"), (1, 500, 504, "POSTAL_CODE", "1000"), (2, 5, 9, "CITY", "Bern")]
    found = address.link_components(spark.createDataFrame(rows, "doc_id long, start int, end int, type string, text string"))
    out = found.select("doc_id", "types", address.pattern_of(F.col("types")).alias("p"), address.score_of(address.pattern_of(F.col("types")), F.col("types"), F.col("texts")).alias("s")).collect()
    assert [(r.doc_id, r.types, r.p) for r in out] == [(1, ["STREET_NAME", "STREET_NUMBER", "POSTAL_CODE", "CITY"], "SWISS")]
    assert out[0].s == pytest.approx((0.8 + 0.3 + 0.2 + 0.1) / 1.7, abs=1e-5)


def test_registry():
    r = rules.Registry()
    one = rules.Recognizer("a", (), ("CH",), ("de",), 1)
    assert r.register(one) and not r.register(one) and r.register(rules.Recognizer("a", (), (), (), 2))
    assert r.load([{"name": "x", "type": "X", "regex": "x+", "score": 1, "priority": 9}, {"name": "y"}, {"name": "z", "type": "Z", "regex": "(", "score": 1}]) == ["y", "z"]
    assert [x.name for x in r.chosen(("DE",), "fr")] == ["x", "a"]


def test_fuzzy_replacement(spark):
    docs = spark.createDataFrame([(1, "Anna-Muster met ANNA  MUSTER and Annamuster."), (2, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, "Anna Muster", "P1"), (1, "x", "P2")], "doc_id long, original string, token string")
    assert {r.doc_id: r.replaced for r in rules.fuzzy_replace(docs, pairs).collect()} == {1: "P1 met P1 and P1.", 2: None}


def test_chunks_cover_the_text(spark):
    text = " ".join(f"word{i}" for i in range(900)) + "\n" + "x" * 2500
    rows = tokens.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("doc_id", "chunk").collect()
    assert all(r.text == text[r.start : r.end] and r.end - r.start <= 1000 for r in rows)
    assert rows[0].start == 0 and rows[-1].end == len(text) and all(b.start <= a.end for a, b in zip(rows, rows[1:], strict=False))


def test_failing_model_gives_no_predictions_if_told_so(spark):
    def model():
        def predict(texts):
            raise RuntimeError("down")

        return predict

    assert tokens.predictions(tokens.chunks(spark.createDataFrame([(1, "a b")], "doc_id long, text string")), model, skip=True).count() == 0


def test_html():
    html = "<html><head><title>no</title><style>x{}</style></head><body><h2>A &amp; b</h2><p>one <b>two</b><br>three <a href='/x'>l</a></p><script>no()</script><ul><li>i</li></ul><pre>c</pre></body>"
    assert markup.as_markdown(html) == "## A & b\n\none **two**\nthree [l](/x)\n\n- i\n\n```\nc\n```"
    assert markup.as_markdown(None) == ""


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_files(spark, tmp_path):
    docx = f'<w:document {W}><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r></w:p></w:document>'
    book = f'<workbook {S}><sheets><sheet name="One"/></sheets></workbook>'
    sheet = f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row><row><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c></row></sheetData></worksheet>'
    (tmp_path / "a.docx").write_bytes(_zip({"word/document.xml": docx}))
    (tmp_path / "b.xlsx").write_bytes(_zip({"xl/workbook.xml": book, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f"<sst {S}><si><t>a|b</t></si></sst>"}))
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.pdf").write_bytes(b"x")
    (tmp_path / "e.txt").write_text("über")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in markup.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.docx"].markdown == "## Head\n\n- **bold**" and rows["e.txt"].markdown == "über"
    assert rows["b.xlsx"].markdown == "## One\n\n| a\\|b | 2 |\n| --- | --- |\n| TRUE | #ERROR |"
    assert rows["c.docx"].error.startswith("BadZipFile") and rows["d.pdf"].error == "Unsupported file type: pdf"


def test_tables_and_names(spark):
    rows = spark.createDataFrame([(2, "x|y", "b\nc"), (1, None, "z")], "i int, a string, b string")
    assert markup.markdown_table(["a", "b"], rows, "i").first().markdown == "| a | b |\n| --- | --- |\n|  | z |\n| x\\|y | b<br>c |"
    assert spark.range(1).select(sinks.out_name(F.lit("/d/x.y.docx"))).first()[0] == "x.y-anon.md"


def test_log_files(spark, tmp_path):
    entry = {"id": "1", "timestamp": "2024-01-02T03:04:05Z", "action": "ADD", "entityType": "EMAIL", "confidence": 0.5, "context": "c", "documentHash": "h"}
    (tmp_path / "corrections-2024-01.json").write_text(json.dumps({"version": "1", "month": "2024-01", "entries": [entry, entry | {"action": "DROP"}, entry | {"timestamp": "never"}]}))
    (tmp_path / "corrections-2024-02.json").write_text("{broken")
    rows = sinks.read_log_json(spark, str(tmp_path)).collect()
    assert [(r.id, r.month, r.entityType) for r in rows] == [("1", "2024-01", "EMAIL")]


def test_streams(spark, smallest, tmp_path):
    events = spark.read.parquet(f"{smallest}/events.parquet")
    source = tmp_path / "in"
    events.where("event_id % 2 = 0").write.parquet(str(source))
    log = lambda: streams.read_files(spark, str(source), events.schema)
    streams.log_stream(log(), str(tmp_path / "log"), str(tmp_path / "cp"))
    events.where("event_id % 2 = 1").write.mode("append").parquet(str(source))
    streams.log_stream(log(), str(tmp_path / "log"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == events.count()
    streams.run_to_end(streams.windowed_counts(log(), late="0 seconds"), str(tmp_path / "w"), str(tmp_path / "cw"))
    found = spark.read.parquet(str(tmp_path / "w"))
    whole = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("m"))
    assert found.count() > 0 and found.join(whole, ["start", "event_type"]).where("n <> m").count() == 0
    streams.pseudonymise_stream(log(), lambda df: df.groupBy("user_id").agg(F.count("*").alias("n")), str(tmp_path / "p"), str(tmp_path / "cq"))
    assert spark.read.parquet(str(tmp_path / "p")).agg(F.sum("n")).first()[0] == events.count()
    streams.run_to_end(streams.sessions(log(), late="0 seconds"), str(tmp_path / "s"), str(tmp_path / "cs"))
    assert spark.read.parquet(str(tmp_path / "s")).where("start >= end").count() == 0


def test_partitioned_log(spark, smallest, tmp_path):
    events = spark.read.parquet(f"{smallest}/events.parquet")
    sinks.append_log(events, str(tmp_path / "log"))
    month = sinks.read_log(spark, str(tmp_path / "log")).first().month
    some = sinks.read_log(spark, str(tmp_path / "log"), [month])
    assert some.count() > 0 and "PartitionFilters: [" in some._jdf.queryExecution().executedPlan().toString()


def test_hangul_and_marks_are_composed(spark):
    rows = spark.createDataFrame([("\u1112\u1161\u11ab x e\u0301 \ufb01",), ("ascii",)], "t string").select(t.normalise_unicode(F.col("t")).alias("n")).collect()
    assert rows[0].n.text == "\ud55c x \u00e9 fi" and rows[0].n.index_map == [0, 3, 4, 5, 6, 8, 9, 9, 10] and rows[1].n.text == "ascii"


def test_sheets_by_their_relationships():
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="T{i}" r:id="r{i}"/>' for i in range(1, 12)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, 12)) + "</Relationships>")
        for i in range(1, 12):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData><row><c><v>{i}</v></c></row></sheetData></worksheet>')
    found = markup.xlsx_tables(data.getvalue())
    assert [x.split("\n\n")[1].split("\n")[0] for x in found.split("## ")[1:]] == [f"| {i} |" for i in range(1, 12)] and "## T10\n\n| 10 |" in found

"""Reading of marked-up texts: front matter, CSV lines, HTML, and office files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def frontmatter(**fields: Column) -> Column:
    """A YAML head of the fields that aren't null, in their order."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def with_frontmatter(text: Column, name: Column, kind: Column) -> Column:
    """A plain text as Markdown: front matter, then a title unless the text has headings or fenced code. Colons and quotes leave the name."""
    clean = F.regexp_replace(name, '[:"]', "")
    has = text.rlike(r"(?m)^#{1,6}\s") | F.contains(text, F.lit("```"))
    return F.concat(frontmatter(source=clean, format=kind), F.lit("\n\n"), F.when(has, F.lit("")).otherwise(F.concat(F.lit("# "), clean, F.lit("\n\n"))), text)


def csv_cells(line: Column) -> Column:
    """The cells of a CSV line, trimmed; quoted ones may hold commas and doubled quotes, but no line ends."""
    raw = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'\G\s*("(?:[^"]|"")*"|[^,]*?)\s*,'), F.lit(1))
    return F.transform(raw, lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) >= 2), F.btrim(F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')))).otherwise(F.btrim(c)))


def markdown_table(header: list[str], rows: DataFrame, order: str) -> DataFrame:
    """(markdown): the rows as a table; pipes are escaped and line ends become <br>."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in header]), F.lit(" |"))
    head = f"| {' | '.join(header)} |\n| {' | '.join('---' for _ in header)} |"
    return rows.agg(F.concat_ws("\n", F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda s: s["l"]), "\n")).alias("markdown"))


class _Markdown(HTMLParser):
    """HTML as Markdown: headings, lists, emphasis, links, images, code and breaks; scripts, styles and heads are left out."""

    MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`", "del": "~~"}
    BLOCKS = {"p", "div", "article", "section", "ul", "ol", "nav", "footer", "header", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head", "title"):
            self.hidden += 1
        elif tag in self.BLOCKS:
            self.out.append("\n\n" + ("#" * int(tag[1]) + " " if len(tag) == 2 and tag[1].isdigit() else "```\n" if tag == "pre" else "> " if tag == "blockquote" else ""))
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in self.MARKS:
            self.out.append(self.MARKS[tag])
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{dict(attrs).get('alt') or ''}]({dict(attrs).get('src') or ''})")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head", "title"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS:
            self.out.append("\n```\n\n" if tag == "pre" else "\n\n")
        elif tag in self.MARKS:
            self.out.append(self.MARKS[tag])
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(" ".join(data.split(" ")))

    def text(self) -> str:
        import re

        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(self.out))).strip()


def as_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    return parser.text()


def html_to_markdown(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id_col, markdown) of HTML pages. Markup nests, so pages are parsed in Python, by batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "markdown": [as_markdown(h) for h in pdf[html_col]]})

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} long, markdown string")


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/package/2006/relationships}"
OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_text(data: bytes) -> str:
    """The paragraphs of a Word file as Markdown: headings by style, list items, bold and italic runs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{W}p"):
        style = p.find(f"{W}pPr/{W}pStyle")
        name = style.get(f"{W}val", "") if style is not None else ""
        runs = []
        for r in p.iter(f"{W}r"):
            text = "".join(x.text or "" for x in r.iter(f"{W}t"))
            bold, italic = r.find(f"{W}rPr/{W}b") is not None, r.find(f"{W}rPr/{W}i") is not None
            runs.append(f"**{text}**" if bold and text else f"_{text}_" if italic and text else text)
        line = "".join(runs)
        level = name[-1] if name.lower().startswith("heading") and name[-1:].isdigit() else ""
        out.append(f"{'#' * int(level)} {line}" if level else f"- {line}" if p.find(f"{W}pPr/{W}numPr") is not None else line)
    return "\n\n".join(x for x in out if x)


def xlsx_tables(data: bytes, most: int = 1000) -> str:
    """The sheets of an Excel file as Markdown tables, the first row as header."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        # a sheet's part is named by the workbook's relationships, whatever its number
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{R}Relationship")} if "xl/_rels/workbook.xml.rels" in names else {}
        sheets = [(s.get("name", ""), targets.get(s.get(f"{OFFICE}id"), f"worksheets/sheet{i}.xml")) for i, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"), 1)]
        parts = []
        for title, target in sheets:
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if path not in names:
                continue
            rows = []
            for row in list(ElementTree.fromstring(z.read(path)).iter(f"{S}row"))[: most + 1]:
                cells = []
                for c in row.iter(f"{S}c"):
                    v, kind = c.find(f"{S}v"), c.get("t", "n")
                    raw = (v.text or "") if v is not None else "".join(t.text or "" for t in c.iter(f"{S}t"))
                    cells.append(shared[int(raw)] if kind == "s" and raw else {"1": "TRUE", "0": "FALSE"}.get(raw, raw) if kind == "b" else "#ERROR" if kind == "e" else raw)
                rows.append("| " + " | ".join(x.replace("|", "\\|").replace("\n", "<br>") for x in cells) + " |")
            if rows:
                rows.insert(1, "|" + " --- |" * rows[0].count(" | ") + " --- |")
            parts.append(f"## {title}\n\n" + "\n".join(rows))
    return "\n\n".join(parts)


KINDS = {"docx": docx_text, "xlsx": xlsx_tables, "html": lambda b: as_markdown(b.decode("utf-8", "replace")), "htm": lambda b: as_markdown(b.decode("utf-8", "replace")), "txt": lambda b: b.decode("utf-8", "replace"), "md": lambda b: b.decode("utf-8", "replace"), "csv": lambda b: b.decode("utf-8", "replace")}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, markdown, error) of the files below path, by their endings; a file that can't be read has an error instead of
    a text, and doesn't stop the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                kind = where.rpartition(".")[2].lower()
                try:
                    out.append((where, kind, KINDS[kind](bytes(content)), None) if kind in KINDS else (where, kind, None, f"Unsupported file type: {kind}"))
                except Exception as e:
                    out.append((where, kind, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "format", "markdown", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, format string, markdown string, error string")


# Types of annotated fixtures and this library's; others keep theirs, in capitals and without outer space.
ANNOTATED_TYPES = {
    "PERSON": "PERSON_NAME", "PER": "PERSON_NAME", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE_NUMBER", "IBAN_CODE": "IBAN", "CREDIT_CARD": "CREDIT_CARD", "IP_ADDRESS": "IP_ADDRESS", "DATE_TIME": "DATE",
    "LOCATION": "ADDRESS", "ORGANIZATION": "ORGANIZATION", "US_SSN": "SSN", "US_DRIVER_LICENSE": "DRIVER_LICENSE", "URL": "URL", "NRP": "NATIONALITY",
}
_SAMPLE = "full_text string, template_id string, spans array<struct<entity_type:string,entity_value:string,start_position:int,end_position:int>>"


def annotated(lines: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """(id_col, full, type, start, end, text) of annotated samples, a JSON object in each line; samples without spans have no rows, nor have lines that are no JSON."""
    rows = lines.select(id_col, F.from_json(line_col, _SAMPLE).alias("s")).select(id_col, F.col("s.full_text").alias("full"), F.explode("s.spans").alias("e"))
    kind = F.upper(F.btrim("e.entity_type"))
    known = F.create_map(*[F.lit(x) for kv in ANNOTATED_TYPES.items() for x in kv])
    return rows.select(id_col, "full", F.coalesce(known[kind], kind).alias("type"), F.col("e.start_position").alias("start"), F.col("e.end_position").alias("end"), F.col("e.entity_value").alias("text"))

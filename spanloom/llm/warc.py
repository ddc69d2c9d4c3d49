"""WARC archives: writing, reading, and resolving revisit records by payload digest.

Every record is a gzip member of its own, so that archives can be read from any record on. Spark's text writer writes them, with an
empty gzip member as its line separator, and its text reader splits files at that, wherever they are cut into partitions: no task holds
more than a record, whatever a file's size. Any other reader takes the files as gzipped archives.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm import textvec as tv
from spanloom.llm.common import fresh_path, settled, small_batches, table

#: Payloads of fewer bytes are never made revisits.
LEAST_BYTES = 0
CRLF = "\r\n"
#: Fixed value: an empty gzip member.
SEPARATOR = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
#: The separator and how Spark takes it, as text of one byte a character.
LINES = {"lineSep": SEPARATOR.decode("latin-1"), "encoding": "ISO-8859-1"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: each five hex digits are four letters."""
    hexed = F.sha1(payload)

    def four(i: Column) -> Column:
        v = F.conv(F.substring(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def record_id(*parts: Column) -> Column:
    """A urn that stands for the parts; equal parts, equal urn."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _clean(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[\r\n]", " ")


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages, as (page_id, url, payload, digest, bytes, original, copy): original is, for a revisit, the largest page_id with the same payload, else null.
    copy tells rows of equal page_id and payload apart.

    Only ids and digests are aggregated, and pre-aggregated before the shuffle; payloads are shuffled once, to meet their digest's
    largest id. Null payloads are empty. A row with a null id is a response if no row with its payload has an id.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"hex": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    each = settled(rows.groupBy("hex", "page_id", "bytes").agg(F.count("*").alias("times")), "digests")
    largest = each.where(F.col("bytes") >= least_bytes).groupBy("hex").agg(F.max("page_id").alias("largest"))
    rows = rows.join(largest, "hex", "left").withColumn("copy", F.lit(0))
    again = settled(each.where("times > 1").select("hex", "page_id"), "repeated")
    if not again.isEmpty():
        same = lambda: (rows["hex"] == again["hex"]) & rows["page_id"].eqNullSafe(again["page_id"])
        w = Window.partitionBy("hex", "page_id").orderBy("url")
        rows = rows.join(again, same(), "left_anti").unionByName(rows.join(again, same(), "left_semi").withColumn("copy", F.row_number().over(w) - 1))
    original = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return rows.select("page_id", "url", "payload", base32_sha1(F.col("payload")).alias("digest"), "bytes", original.alias("original"), "copy")


def as_records(rows: DataFrame, date: str) -> Column:
    """The record of a row of deduplicated(), with the blank line after it, and fresh headers: all of one archive have its date."""
    uri = F.coalesce(_clean(F.col("url")), F.lit("about:blank"))
    head = lambda kind: [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), record_id(F.lit(date), F.col("page_id"), F.col("digest"), F.col("copy")), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), uri, F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"), F.coalesce(F.concat(F.lit(f"{CRLF}Page-Id: "), F.col("page_id").cast("string")), F.lit(""))]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    kind = F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: ")
    response = F.concat(*head("response"), kind, (F.octet_length(http) + F.col("bytes")).cast("string"), F.lit(CRLF * 2), http, F.col("payload"), F.lit(CRLF * 2))
    bare = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF * 2}"
    profile = f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "
    revisit = F.concat(*head("revisit"), F.lit(profile), record_id(F.lit(date), F.col("original"), F.col("digest"), F.lit(0)), kind, F.lit(f"{len(bare)}{CRLF * 2}{bare}{CRLF * 2}"))
    return F.when(F.col("original").isNull(), response).otherwise(revisit)


def write_archives(rows: DataFrame, path: str, date: str | None = None) -> None:
    """Rows of deduplicated() as archives below path, a gzip member for each record. date: of the records, by default that of writing."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = []
            for record in b.column(0):
                zip_ = zlib.compressobj(6, zlib.DEFLATED, 31)
                members.append(zip_.compress(record.as_buffer()) + zip_.flush())
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["value"])

    members = small_batches(rows.select(as_records(rows, date).alias("value"))).mapInArrow(tv.trimmed(run), "value binary")
    members.select(F.col("value").cast("string")).write.options(**LINES).text(path)


class _Reader:
    """Reads the bytes of a file, gzipped or not, piece by piece."""

    def __init__(self, data: bytes, piece: int = 1 << 20):
        self.data, self.piece, self.at, self.held = memoryview(data), piece, 0, bytearray()
        self.zip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = bytes(self.data[self.at : self.at + self.piece])
        self.at += len(piece)
        while piece:
            if self.zip is None:
                self.held += piece
                break
            self.held += self.zip.decompress(piece)
            piece = self.zip.unused_data
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        looked = 0
        while (i := self.held.find(mark, looked)) < 0:
            looked = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.held[:i])
        del self.held[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        if len(self.held) < n:
            raise ValueError("an archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive. ValueError where it isn't one."""
    r = _Reader(data)
    while (head := r.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0]:
            continue
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:60]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, r.take(int(fields.get("content-length", "0")))
        r.until(b"\r\n\r\n")


_FIELDS = {"type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "uri": "warc-target-uri", "date": "warc-date", "digest": "warc-payload-digest", "page_id": "page-id"}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(type, record_id, refers_to, uri, date, digest, page_id, payload_bytes, payload) of all records of archives that write_archives has written
    below path. A response's digest and length are of the payload as it was read; ValueError if its header says another digest.
    payload is null without payloads, and for revisits, as are their bytes."""
    members = spark.read.options(**LINES).text(path).select(F.col("value").cast("binary").alias("content"))
    return _parsed(members, payloads)


def read_other_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The same of archives from elsewhere, gzipped by record or as a whole or not at all. Spark reads each file whole, of 2 GB at most."""
    return _parsed(spark.read.format("binaryFile").load(path).select("content"), payloads)


def _parsed(contents: DataFrame, payloads: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            size = 0
            for content in b.column(0):
                for fields, block in records(content.as_buffer().to_pybytes()):
                    row = {k: fields.get(v) for k, v in _FIELDS.items()}
                    row["digest"] = (row["digest"] or "").removeprefix("sha1:")
                    row["page_id"] = int(row["page_id"]) if row["page_id"] is not None else None
                    row["payload_bytes"] = row["payload"] = None
                    if row["type"] == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                        if (found := base64.b32encode(hashlib.sha1(body).digest()).decode()) != row["digest"]:
                            raise ValueError(f"{row['record_id']}: digest {found}, header {row['digest']}")
                        row["payload_bytes"], row["payload"] = len(body), body if payloads else None
                        size += len(body) if payloads else 0
                    rows.append(row)
                    if size > 2 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([*[(k, pa.string()) for k in _FIELDS if k != "page_id"], ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    return small_batches(contents).mapInArrow(tv.trimmed(run), ", ".join(f"{k} string" for k in _FIELDS if k != "page_id") + ", page_id long, payload_bytes long, payload binary")


def resolve_revisits(found: DataFrame) -> DataFrame:
    """Records with original_page and payload_bytes of what they stand for: the headers, written out once, are shuffled by payload digest, and those of
    revisits meet the original responses. A revisit whose response is missing keeps nulls. No payload is shuffled."""
    heads = settled(found.drop("payload"), "headers")
    originals = heads.where("type = 'response'").groupBy("digest").agg(F.max("page_id").alias("original_page"), F.max("payload_bytes").alias("original_bytes"))
    responses = heads.where("type = 'response'").withColumn("original_page", F.lit(None).cast("long"))
    revisits = heads.where("type = 'revisit'").join(originals, "digest", "left").withColumn("payload_bytes", F.col("original_bytes")).drop("original_bytes")
    return responses.unionByName(revisits)


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes deduplicated archives of pages below path and reads them back, resolved: (page_id, payload_bytes, payload_digest, record_type, refers_to).
    An empty table writes archives without records and gives no rows. Repeated rows of the largest id are responses each, with ids of
    their own. Null urls are about:blank; further columns don't matter."""
    write_archives(deduplicated(pages, id_col, url_col, payload_col), path)
    found = resolve_revisits(read_archives(pages.sparkSession, path, payloads=False))
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("original_page").alias("refers_to"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as the written archives have it."""
    return archive_pages(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))


_FOUR = "||".join(f"substr('{ALPHABET}', ((('0x' || substr(hex, i * 5 + 1, 5))::int >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
ORACLE = f"""with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as hex from pages),
m as (select *, max(page_id) over (partition by hex) as top from p)
select page_id, n::bigint as payload_bytes, array_to_string(list_transform(range(8), lambda i: {_FOUR}), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from m"""

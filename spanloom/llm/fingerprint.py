"""Document fingerprints from closed syncmers.

A k-mer of bytes is a closed syncmer if the least of its inner s-mers is its first or its last. That depends on the k-mer
alone, so two texts that share a passage choose the same anchors in it, wherever it stands.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import textvec as tv
from spanloom.llm.common import small_batches, table

#: Bytes of a k-mer and of its inner s-mers. K - S + 1 inner places give an anchor for every eighth byte or so.
K, S = 20, 5
#: Slots of a fingerprint; each holds the least anchor whose hash falls into it.
SLOTS = 64
#: Bytes of text in a range of ids, about, and ranges whose bounds the driver holds, at most; beyond, ranges grow. A task streams
#: through its range, so its memory doesn't.
RANGE_BYTES, MOST_RANGES = 64 << 20, 20_000

_BYTE_HASH = tv.mix(np.arange(1, 257, dtype=np.uint64))


def _runs(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive bytes."""
    out, n = np.zeros(0, np.uint64), len(raw) - k + 1
    if n > 0:
        each = _BYTE_HASH[raw]
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(each * tv.powers(tv._KBASE, len(raw)), out=total[1:])
        out = tv.mix((total[k:] - total[:-k]) * tv.powers(tv._KBASE_INV, n))
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive numbers."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors(raw: np.ndarray, offsets: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the text, hash) of each closed syncmer of many texts. A text without any, as each shorter than k,
    has itself as its only anchor, at place 0; an empty one has none."""
    length = np.diff(offsets)
    without = length > 0
    parts = []
    if len(raw) >= k:
        inner = _runs(raw, s)
        width = k - s + 1
        low = _least(inner, width)
        chosen = np.flatnonzero((low == inner[: len(low)]) | (low == inner[width - 1 :]))
        text = np.searchsorted(offsets, chosen, "right") - 1
        fits = chosen + k <= offsets[text + 1]
        chosen, text = chosen[fits], text[fits]
        without[text] = False
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE_HASH[raw] * tv.powers(tv._KBASE, len(raw)), out=total[1:])
        parts.append((text, chosen - offsets[text], tv.mix((total[chosen + k] - total[chosen]) * tv.powers(tv._KBASE_INV, len(raw))[chosen] + np.uint64(k))))
    short = np.flatnonzero(without)
    if len(short):
        ends = offsets[short + 1]
        parts.append((short, np.zeros(len(short), np.int64), np.array([int.from_bytes(hashlib.blake2b(raw[a:b].tobytes(), digest_size=8).digest()) for a, b in zip(offsets[short], ends, strict=True)], np.uint64)))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def sketches(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places), one row of SLOTS for each text: the slot's least anchor and where it stands first; an empty slot
    has the place -1."""
    n = len(offsets) - 1
    text, place, h = anchors(raw, offsets)
    slot = text * SLOTS + (h >> np.uint64(58)).astype(np.int64)
    h = h & np.uint64((1 << 58) - 1)
    best = np.full(n * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(best, slot, h)
    at = np.full(n * SLOTS, np.iinfo(np.int64).max)
    mine = h == best[slot]
    np.minimum.at(at, slot[mine], place[mine])
    at[at == np.iinfo(np.int64).max] = -1
    return best.reshape(n, SLOTS), at.reshape(n, SLOTS)


def shown(hashes: np.ndarray, places: np.ndarray) -> list[str]:
    """Each sketch as text: for each slot 24 bits of its hash and its place, in hex, '-' for an empty one; '' without any."""
    short = (hashes >> np.uint64(34)).tolist()
    return ["" if max(p) < 0 else ",".join(f"{h:06x}@{x:x}" if x >= 0 else "-" for h, x in zip(hs, p, strict=True)) for hs, p in zip(short, places.tolist(), strict=True)]


def _chain(a: np.ndarray, b: np.ndarray) -> int:
    """The most anchors that both texts have in the same order."""
    tails: list[int] = []
    for x in b[np.lexsort((b, a))].tolist():
        i = bisect_right(tails, x)
        tails[i : i + 1] = [x]
    return len(tails)


def likeness(ha: np.ndarray, pa_: np.ndarray, hb: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Row by row, the share of the slots that either sketch fills whose anchors agree and stand in the same order in
    both texts; 1 for two empty sketches."""
    has_a, has_b = pa_ >= 0, pb >= 0
    same = has_a & has_b & (ha == hb)
    count = same.sum(1)
    moved = np.where(same, pa_ - pb, 0)
    low = np.where(same, moved, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
    high = np.where(same, moved, np.iinfo(np.int64).min).max(1, initial=np.iinfo(np.int64).min)
    for i in np.flatnonzero((count > 1) & (low != high)):
        count[i] = _chain(pa_[i][same[i]], pb[i][same[i]])
    filled = (has_a | has_b).sum(1)
    return np.where(filled == 0, 1.0, count / np.maximum(filled, 1))


def sketch_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = tv.text_bytes(pa.array(texts, pa.large_string()))
    parts = [sketches(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in tv.chunks(offsets)]
    if not parts:
        return np.zeros((0, SLOTS), np.uint64), np.zeros((0, SLOTS), np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fingerprint_documents(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs with out_col, the fingerprint of text_col; null counts as empty. Equal texts have equal fingerprints. Nothing is
    shuffled; a column out_col is replaced."""
    kept = docs.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = shown(*sketch_texts([t or "" for t in b.column(text_col).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.string())], [*b.schema.names, out_col])

    return small_batches(kept).mapInArrow(tv.trimmed(run), kept.selectExpr("*", f"'' as `{out_col}`").schema)


def range_of(ids: np.ndarray, known: np.ndarray, h: np.ndarray, bounds: np.ndarray, null_ranges: int) -> np.ndarray:
    """The range of each row, ascending in the order of rows: by descending id, nulls (not known) last, equal ids by their hash h. bounds: ascending ids, which cut
    the rows into about equal parts; an id that is several bounds holds as many parts, and its rows are dealt to them by h."""
    part = (h.view(np.uint64) ^ np.uint64(1 << 63)).astype(np.float64) / 2.0**64
    low = np.searchsorted(bounds, ids, "left")
    times = np.searchsorted(bounds, ids, "right") - low
    own = np.maximum(times - 1, 1)
    at = low + np.where(times > 0, own - np.minimum((part * own).astype(np.int64), own - 1), 0)
    last = len(bounds) + 1 + np.minimum((part * null_ranges).astype(np.int64), null_ranges - 1)
    return np.where(known, len(bounds) - at, last).astype(np.int32)


def with_next(docs: DataFrame, id_col: str, text_col: str, work: Callable[[list, list[str], list[str]], pa.RecordBatch], schema: str) -> DataFrame:
    """work(ids, texts, next texts) over all rows; a row's next is the one after it by descending id, nulls last, equal ids
    by hashes of the text; after the last comes the first.

    Rows are dealt into ranges of the id whose bounds the driver knows (MOST_RANGES at most), once. The first row of each
    range is also sent to the range before it, so no range waits for another.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.select("id", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), F.col("text")).alias("g"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"), F.count("id").alias("known")).first()
    n = max(1, min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["bytes"] or 0) // RANGE_BYTES))))
    cuts = docs.approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 and total["known"] else []
    bounds = np.sort(np.array(cuts, np.float64).astype(np.int64))
    null_ranges = max(1, round(n * (total["n"] - total["known"]) / max(total["n"], 1)))

    @F.pandas_udf("int")
    def ranged(ids: pd.Series, known: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(range_of(ids.to_numpy(), known.to_numpy(bool), h.to_numpy(), bounds, null_ranges))

    key = ranged(F.coalesce("id", F.lit(0)), F.col("id").isNotNull(), F.col("h"))
    rows = docs.withColumn("range", key)
    heads = rows.select("range", "id", "h").groupBy("range").agg(F.max(F.struct("id", (-1 - F.col("h")).alias("h"))).alias("head")).orderBy("range").collect()
    order = [r["range"] for r in heads]
    before = dict(zip(order, [*order[-1:], *order[:-1]], strict=True))
    known = spark.createDataFrame([(r["range"], before[r["range"]], r["head"]["id"], -1 - r["head"]["h"]) for r in heads], "range int, to int, head_id long, head_h long")
    rows = rows.join(F.broadcast(known), "range")
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("copy"))
    sent = F.struct(F.col("to").alias("range"), F.lit(1).alias("copy"))
    is_head = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    rows = rows.withColumn("at", F.explode(F.when(is_head, F.array(own, sent)).otherwise(F.array(own))))
    rows = rows.select("at.range", "at.copy", "id", "text", "h", "g").repartitionById(len(bounds) + 1 + null_ranges, "range")
    rows = rows.sortWithinPartitions("range", "copy", F.col("id").desc_nulls_last(), "h", "g").select("range", "copy", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            rng, copy, ids = (b.column(i).to_pylist() for i in range(3))
            off = b.column(3).cast(pa.large_string())
            for i, j in tv.chunks(np.frombuffer(off.buffers()[1], np.int64, len(off) + 1, off.offset * 8)):
                texts = off.slice(i, j - i).to_pylist()
                pairs: list[tuple] = []
                for k, text in zip(range(i, j), texts, strict=True):
                    if held is not None and held[0] == rng[k]:
                        pairs.append((held[1], held[2], text))
                    held = None if copy[k] else (rng[k], ids[k], text)
                if pairs:
                    yield work([p[0] for p in pairs], [p[1] for p in pairs], [p[2] for p in pairs])

    return small_batches(rows).mapInArrow(tv.trimmed(run), schema)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its text's fingerprint, that of its edited text (the last half of its code points gives way to the first
    as many of the next document's), the edited text's digest, and the likeness of the fingerprint to the edited text's and to the next
    document's. Null texts are empty; an empty table gives no rows; repeated ids and rows each have their row, and may be any share of the table. A
    single row's next is itself. Other columns don't matter."""

    def work(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts, strict=True)]
        a, e = sketch_texts(texts), sketch_texts(edited)
        rest = [i for i in range(len(texts)) if i + 1 == len(texts) or texts[i + 1] is not nexts[i]]
        more = sketch_texts([nexts[i] for i in rest])
        x = tuple(np.concatenate([own[1:], own[:1]]) for own in a)
        for mine, other in zip(x, more, strict=True):
            mine[rest] = other
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(shown(*a)), pa.array(shown(*e)), pa.array(likeness(*a, *e)), pa.array(likeness(*a, *x))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_next(docs, id_col, text_col, work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and its likeness to the edited and to the next document's."""
    return compare_with_edits(table(spark, sf_dir, "documents"))

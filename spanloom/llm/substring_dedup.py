"""Substring dedup by relative Lempel-Ziv parsing against blocks of the corpus.

The corpus is dealt into blocks of bounded size; each is a reference and has an index of its windows of SPAN words, each with the place where it
first stands. Texts are factored greedily: where a window stands in the index with an earlier start, a factor begins there and is
extended along its source, window by window, as far as both agree; the next factor is looked for from its end. Windows that straddle a
factor's boundary are looked up one by one, so none that another source holds is lost. A block factors its own texts so; and
passages around anchors (the least k-gram of each window, the same wherever the window stands) that several blocks have meet at
their anchor, where each is factored against all earlier ones. The union of a text's factors is what is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm import textvec as tv
from spanloom.llm.common import settled, small_batches, table

#: Words of a window, and of the k-grams that its anchor is chosen from.
SPAN, K = 20, 6
REACH = SPAN - K + 1
#: Bytes of text in a block, on average.
BLOCK_BYTES = 4 << 20
#: Occurrences from which an anchor's windows no longer meet at it in one task, but each by an aggregation of its first place.
HOT = 2_000
#: Bytes of a window's hash that travel with its anchor, which has eight more.
PRINT = 6
#: Low bits of a packed k-gram that hold its place: words of a block, at most.
PLACE = 31


class Block:
    """The words, windows and anchors of a block's texts, in the order of their ids."""

    def __init__(self, rows: pa.Table):
        some, ids, h = (rows.column(c).to_numpy() for c in ("some", "id", "h"))
        self.order = np.lexsort((h, ids, some))
        self.some, self.ids, self.h = some[self.order], ids[self.order], h[self.order]
        texts = rows.column("text").combine_chunks().cast(pa.large_string()).take(pa.array(self.order))
        self.raw, offsets = tv.text_bytes(texts)
        self.words = tv.words_of(self.raw, offsets)
        first, n = self.words.first, len(self.words.hash)
        self.n_windows = max(0, n - SPAN + 1)
        self.valid = np.flatnonzero(tv.whole(first, SPAN))
        self.window = tv.grams_of(self.words.hash, SPAN)
        self.gram = tv.grams_of(self.words.hash, K, seed=1)
        place = np.arange(len(self.gram), dtype=np.uint64)
        if len(place) >> PLACE:
            raise ValueError(f"a block of {len(place)} words")
        packed = (self.gram & ~np.uint64((1 << PLACE) - 1)) | place
        have = 1
        while have < REACH and len(packed):
            step = min(have, REACH - have)
            packed = np.minimum(packed[:-step], packed[step:])
            have += step
        #: For each window, the place of its anchor: the first of its least k-grams.
        self.anchor = (packed & np.uint64((1 << PLACE) - 1)).astype(np.int64)

    def sources(self) -> np.ndarray:
        """For each valid window, the first of the block that equals it."""
        _, at, back = np.unique(self.window[self.valid], return_index=True, return_inverse=True)
        return self.valid[at[back]]

    def keys(self) -> np.ndarray:
        """A number for each text's id and hash."""
        return row_keys(self.some, self.ids, self.h)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in it) of every word."""
        doc = self.words.doc
        return doc, np.arange(len(doc)) - self.words.first[doc]


def row_keys(some: np.ndarray, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    return tv.mix(tv.mix(ids.view(np.uint64)) + some.astype(np.uint64)) ^ h.view(np.uint64)


def factors_of(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows) of each factor of the block's texts against the block itself: greedily, each from its window's first place in
    the block, which must be an earlier one, as far as source and text agree. All texts are parsed side by side, a factor a round."""
    source = np.full(b.n_windows + 1, -1)
    source[b.valid] = b.sources()
    later = b.valid[source[b.valid] < b.valid]
    none = np.zeros(0, np.int64)
    if not len(later):
        return none, none
    n = len(b.words.hash)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(tv.mix(b.words.hash) * tv.powers(tv._KBASE, n), out=total[1:])
    scale = tv.powers(tv._KBASE_INV, n + 1)
    close = np.maximum(b.words.first[1:] - SPAN + 1, b.words.first[:-1])  # after each text's last window
    home = np.searchsorted(b.words.first, later, "right") - 1
    at = np.flatnonzero(np.append(True, home[1:] != home[:-1]))  # the next later window of each text
    stop = np.append(at[1:], len(later))
    begins, sizes = [], []
    while len(at):
        p = later[at]
        s = source[p]
        low = np.ones(len(p), np.int64)
        high = np.minimum(close[home[at]] - p, close[np.searchsorted(b.words.first, s, "right") - 1] - s)
        while len(go := np.flatnonzero(low < high)):
            mid = (low[go] + high[go] + 1) // 2
            words = mid + SPAN - 1
            x, y = s[go], p[go]
            same = (total[x + words] - total[x]) * scale[x] == (total[y + words] - total[y]) * scale[y]
            low[go] = np.where(same, mid, low[go])
            high[go] = np.where(same, high[go], mid - 1)
        begins.append(p)
        sizes.append(low)
        at = np.searchsorted(later, p + low)  # what straddles the boundary is looked up like any other window
        open_ = at < stop
        at, stop = at[open_], stop[open_]
    return np.concatenate(begins), np.concatenate(sizes)


_ANCHORS = pa.schema([("anchor", pa.int64()), ("block", pa.int32()), ("n", pa.int32())])
_ROW = [("block", pa.int32()), ("some", pa.int8()), ("id", pa.int64()), ("h", pa.int64()), ("lo", pa.int32())]
_ROW_SQL = "block int, some byte, id long, h long, lo int"
_SENT = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), *_ROW, ("prints", pa.binary())])
_FACTORS = pa.schema([*_ROW, ("n", pa.int32())])


def _index(rows: pa.Table) -> pa.Table:
    """The block's distinct anchors and how often each stands there."""
    b = Block(rows)
    at = np.unique(b.anchor[b.valid])
    anchors, n = np.unique(b.gram[at], return_counts=True)
    block = rows.column("block")[0].as_py() if len(rows) else 0
    return pa.table([anchors.view(np.int64), np.full(len(anchors), block, np.int32), n.astype(np.int32)], schema=_ANCHORS)


def _send(rows: pa.Table, shared: pa.Table) -> pa.Table:
    """The block's passages that other blocks may have, each window once: the windows of an anchor in a row, or each
    in a row of its own, with its hash, where the anchor is hot."""
    if not len(rows) or not len(shared):
        return _SENT.empty_table()
    b = Block(rows)
    block = rows.column("block")[0].as_py()
    known = shared.column("anchor").to_numpy().view(np.uint64)
    by = np.argsort(known)
    known, hot = known[by], shared.column("hot").to_numpy(zero_copy_only=False)[by]
    mine = b.valid[b.sources() == b.valid]
    anchor = b.gram[b.anchor[mine]]
    at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
    has = known[at] == anchor
    mine, anchor, is_hot = mine[has], anchor[has], hot[at[has]]
    doc, place = b.places()
    out = []

    def send(key: np.ndarray, window: pa.Array, lo: np.ndarray, prints: pa.Array) -> None:
        d = doc[lo]
        out.append(pa.table([key.view(np.int64), window, np.full(len(lo), block, np.int32), b.some[d], b.ids[d], b.h[d], place[lo].astype(np.int32), prints], schema=_SENT))

    one = mine[is_hot]
    send(anchor[is_hot], pa.array(b.window[one].view(np.int64)), one, pa.nulls(len(one), pa.binary()))
    cool = mine[~is_hot]
    if len(cool):
        at = b.anchor[cool]
        # a row holds consecutive windows of one anchor: local duplicates in between end it
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (cool[1:] != cool[:-1] + 1)))
        n = np.diff(np.append(new, len(cool)))
        prints = np.ascontiguousarray(b.window[cool]).view(np.uint8).reshape(-1, 8)[:, :PRINT]
        off = np.concatenate([[0], np.cumsum(n)]) * PRINT
        blobs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(prints))])
        send(anchor[~is_hot][new], pa.nulls(len(new), pa.int64()), cool[new], blobs)
    return pa.concat_tables(out)


def factored(key: np.ndarray, n: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, first window, windows) of the factors of passages, in the order of their anchors and then of their places. key: of each passage's
    anchor. n: how many windows it has. window: their hashes, one passage after the other. Each passage is factored
    greedily against the earlier ones of its anchor; all are parsed side by side, a window a round."""
    starts = np.cumsum(n) - n
    ends = starts + n
    w = np.repeat(tv.mix(key), n) ^ window
    _, at, back = np.unique(w, return_index=True, return_inverse=True)
    first = at[back]
    row = np.repeat(np.arange(len(n)), n)
    source = np.full(len(n), -1)
    begins, inside = np.zeros(len(w), bool), np.zeros(len(w), bool)
    for j in range(int(n.max(initial=0))):
        live = np.flatnonzero(n > j)
        p, s = starts[live] + j, source[live]
        on = np.maximum(s + 1, 0)
        goes_on = (s >= 0) & (on < ends[row[np.maximum(s, 0)]])
        goes_on[goes_on] = w[on[goes_on]] == w[p[goes_on]]
        fresh = ~goes_on & (first[p] < p)
        source[live] = np.where(goes_on, on, np.where(fresh, first[p], -1))
        begins[p], inside[p] = fresh, goes_on | fresh
    begin = np.flatnonzero(begins)
    if not len(begin):
        return begin, begin, begin
    # a factor ends at the next one's begin, at a window outside, or with its passage
    cut = np.flatnonzero(begins | ~inside)
    stop = np.append(cut, len(w))[np.searchsorted(cut, begin, "right")]
    return row[begin], begin - starts[row[begin]], np.minimum(stop, ends[row[begin]]) - begin


def _factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The factors of _send's passages, which come in the order of their anchor and place. An anchor has fewer than HOT passages."""

    def parsed(rows: pa.Table) -> pa.RecordBatch | None:
        if not len(rows):
            return None
        blobs = rows.column("prints").combine_chunks()
        off = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, blobs.offset * 4).astype(np.int64)
        data = np.frombuffer(blobs.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(-1, PRINT)
        wide = np.zeros((len(data), 8), np.uint8)
        wide[:, :PRINT] = data
        passage, begin, n = factored(rows.column("anchor").to_numpy().view(np.uint64), np.diff(off) // PRINT, wide.view(np.uint64).ravel())
        if not len(passage):
            return None
        out = rows.select([f.name for f in _FACTORS][:-2]).take(pa.array(passage))
        lo = rows.column("lo").to_numpy()[passage] + begin
        return out.append_column("lo", pa.array(lo, pa.int32())).append_column("n", pa.array(n, pa.int32())).cast(_FACTORS).combine_chunks().to_batches()[0]

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        keys = t.column("anchor").to_numpy()
        if not len(keys):
            continue
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if (out := parsed(t.slice(0, cut))) is not None:
            yield out
        held = t.slice(cut).combine_chunks()
    if held is not None and (out := parsed(held)) is not None:
        yield out


_OUT = "some byte, id long, n_words long, n_removed long, kept string, spans array<struct<start:int,length:int>>"
_OUT_SCHEMA = pa.schema([("some", pa.int8()), ("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))])


def _cut(rows: pa.Table, others: pa.Table) -> pa.Table:
    """The block's texts without the words of their factors, against this block and, as given, against others."""
    if not len(rows):
        return _OUT_SCHEMA.empty_table()
    b = Block(rows)
    first, n = b.words.first, len(b.words.hash)
    begin, size = factors_of(b)
    if len(others):
        own = b.keys()
        by = np.argsort(own, kind="stable")
        theirs = row_keys(*(others.column(c).to_numpy() for c in ("some", "id", "h")))
        doc = by[np.searchsorted(own[by], theirs)]
        begin = np.concatenate([begin, first[doc] + others.column("lo").to_numpy()])
        size = np.concatenate([size, others.column("n").to_numpy()])
    change = np.bincount(begin, minlength=n + 1).astype(np.int64)
    change -= np.bincount(begin + size + SPAN - 1, minlength=n + 1)
    gone = np.cumsum(change)[:n] > 0
    docs = len(first) - 1
    removed = np.concatenate([[0], np.cumsum(gone)])
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    edge[first[:-1][first[:-1] < n]] = gone[first[:-1][first[:-1] < n]]
    begin = np.flatnonzero(edge)
    size = removed[np.append(begin[1:], n)] - removed[begin] if len(begin) else np.zeros(0, np.int64)
    home = np.searchsorted(first, begin, "right") - 1
    begin_doc = np.searchsorted(home, np.arange(docs + 1))
    spans = pa.ListArray.from_arrays(pa.array(begin_doc, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - first[home], pa.int32()), pa.array(size, pa.int32())], ["start", "length"]))
    kept = np.flatnonzero(~gone)
    length = b.words.ends[kept] - b.words.starts[kept]
    text = np.empty(int((length + 1).sum()), np.uint8)
    to = np.cumsum(length + 1) - (length + 1)
    text[tv.ragged(to, length)] = b.raw[tv.ragged(b.words.starts[kept], length)]
    text[to + length] = 0x20
    bounds = np.append(to, len(text))[np.searchsorted(kept, first)]
    data = text.tobytes()
    texts = [data[x : max(x, y - 1)].decode() for x, y in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
    return pa.table([b.some, b.ids, np.diff(first), removed[first[1:]] - removed[first[:-1]], pa.array(texts, pa.string()), spans], schema=_OUT_SCHEMA)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept, spans) of every row: kept is the text's words, joined by one space, without those
    that a window of SPAN words covers which also starts earlier: at a smaller id, or earlier in the same text. spans are
    the removed factors, by word. Windows are judged on the input.

    Null texts have no words. Null ids come first. Rows of one id are taken in the order of a hash of their text, so of
    repeated rows one is the first. An empty table gives no rows; further columns don't matter. Texts are shuffled once, by block (dealt by id and
    text, so that no repeated id fills a block); an anchor travels once for each block that it stands in, and windows only where
    their anchor stands in another block, each once for each block. Anchors that stand in HOT places or more don't meet in one task: the
    first places of their windows are found by an aggregation, and a join finds the others. So neither a passage that a third of the
    rows share nor a group of copies makes a task's rows grow faster than the number of blocks.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_BYTES))
    number = F.col(id_col).cast("long")
    rows = docs.select(number.isNotNull().cast("byte").alias("some"), F.coalesce(number, F.lit(0)).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.select("some", "id", F.xxhash64("text").alias("h"), "text", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"))
    dealt = rows.groupBy("block")
    anchors = dealt.applyInArrow(tv.trimmed_one(_index), "anchor long, block int, n int")
    w = Window.partitionBy("anchor")
    shared = anchors.select("anchor", "block", F.min("block").over(w).alias("a"), F.max("block").over(w).alias("b"), F.sum("n").over(w).alias("n"))
    shared = shared.where("a <> b").select("block", "anchor", (F.col("n") >= HOT).alias("hot"))
    sent = settled(dealt.cogroup(shared.groupBy("block")).applyInArrow(tv.trimmed_pair(_send), f"anchor long, window long, {_ROW_SQL}, prints binary"), "passages")
    place = ["some", "id", "h", "lo"]
    cool = sent.where("window is null").drop("window").repartition("anchor").sortWithinPartitions("anchor", *place)
    factors = small_batches(cool).mapInArrow(tv.trimmed(_factor), f"{_ROW_SQL}, n int")
    hot = sent.where("window is not null").drop("prints")
    first = hot.groupBy("anchor", "window").agg(F.min(F.struct(*place)).alias("first"))
    hot = hot.join(first, ["anchor", "window"]).where(F.struct(*place) != F.col("first"))
    factors = factors.unionByName(hot.select("block", *place, F.lit(1).alias("n")))
    out = dealt.cogroup(factors.groupBy("block")).applyInArrow(tv.trimmed_pair(_cut), _OUT)
    return out.select(F.when(F.col("some") == 1, F.col("id")).alias(id_col), "n_words", "n_removed", "kept", "spans")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, those removed, and a digest of the rest."""
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + {SPAN - 1}], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - {SPAN} + 2)) as i from d where len(w) >= {SPAN})),
k as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as n from g) where n > 1),
c as (select distinct doc_id, unnest(range(i, i + {SPAN})) as p from k),
r as (select doc_id, list(p) as gone, count(*) as n from c group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(array_to_string(case when n is null then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end, ' ')) as kept_sha256
from d left join r using (doc_id)"""

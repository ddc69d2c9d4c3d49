"""Near-duplicate classes by BagMinHash signatures on word shingles.

A text is a bag of five-word shingles. A shingle's weight, its count, is discretised into levels 0, 1, 2, ...; levels are
grouped into dyadic ranges, each with a Poisson process of points (time, signature component, level). A point counts if its
level is below the weight, so a component's first counting point agrees between two bags with the chance of their weighted
Jaccard similarity. Bands of the signature give candidates, which the multisets themselves confirm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import textvec as tv
from spanloom.llm.common import bounded, free_name, settled, small_batches, table
from spanloom.llm.components import connected_components

#: Words of a shingle, and least similarity of a link.
SHINGLE, LEAST = 5, 0.8
#: Bands and rows of a band. Two bags of similarity 0.8 share no band with a chance of (1 - 0.8 ** 4) ** 24 = 3e-6.
BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
#: Rounds of meeting each band's leader, after which what is left is compared in blocks.
ROUNDS = 3
#: Equal places of two signatures (by one byte each) from which bags may be similar: five standard deviations below LEAST * SIZE.
PLAUSIBLE = int(LEAST * SIZE - 5 * (LEAST * (1 - LEAST) * SIZE) ** 0.5)
#: Signatures in a block, from the least for small groups to the most for large ones, and bytes of text in a block.
LEAST_BLOCK, MOST_BLOCK, BLOCK_BYTES = 512, 4096, 1 << 19
#: Rows of a few numbers that are broadcast, at most.
MOST_BROADCAST = 500_000


def shingles_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of many texts, sorted by text and shingle. A text of fewer words, but not none, is one shingle."""
    words = tv.words_of(raw, offsets)
    grams, ok = tv.grams_of(words.hash, SHINGLE), tv.whole(words.first, SHINGLE)
    doc = words.doc[: len(grams)][ok]
    shingle = grams[ok]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        whole = []
        for i in short:
            own = words.hash[words.first[i] : words.first[i + 1]]
            whole.append(tv.grams_of(own, len(own), seed=len(own))[0])
        doc, shingle = np.concatenate([doc, short]), np.concatenate([shingle, np.array(whole, np.uint64)])
    by = np.lexsort((shingle, doc))
    doc, shingle = doc[by], shingle[by]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return doc[new], shingle[new], np.diff(np.append(new, len(doc)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1 from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """BagMinHash signatures, one row for each of n bags: the time of each component's first counting point; inf for empty bags.

    All points up to a time by which the bag's components are very likely filled are drawn, round by round, from the processes
    that aren't past it; bags with an unfilled component are drawn again up to twice that time. So the result doesn't
    depend on the limit.
    """
    out = np.full(n * size, np.inf)
    total = np.bincount(doc, weight, n)
    limit = (np.log(size) + 4) / np.maximum(total, 1)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        asked = np.zeros(n, bool)
        asked[todo] = True
        out.reshape(n, size)[todo] = np.inf
        use = np.flatnonzero(asked[doc])
        step = 0
        while len(use):
            # the range [2 ** (step - 1), 2 ** step) of levels, and [0, 1) at first
            low = 0 if step == 0 else 1 << (step - 1)
            width = max(1, low)
            d, e, w = doc[use], element[use], weight[use]
            seed = tv.mix(e + tv.gold(step + 1))
            time = np.zeros(len(use))
            live = np.arange(len(use))
            drawn = 0
            while len(live):
                drawn += 1
                r = tv.mix(seed[live] + tv.gold(drawn))
                time[live] -= np.log(_uniform(r)) / (width * size)
                live = live[time[live] <= limit[d[live]]]
                r = tv.mix(tv.mix(seed[live] ^ np.uint64(0x5851F42D4C957F2D)) + tv.gold(drawn))
                counts = np.ones(len(live), bool) if width == 1 else low + ((r >> np.uint64(32)) % np.uint64(width)).astype(np.int64) < w[live]
                at = d[live] * size + ((r & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
                np.minimum.at(out, at[counts], time[live][counts])
            step += 1
            use = use[weight[use] > (1 << (step - 1))]
        open_ = np.isinf(out.reshape(n, size)[todo]).any(1)
        todo = todo[open_]
        limit[todo] *= 2
    return out.reshape(n, size)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """A hash of each band, different from band to band."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * tv.GOLD, (len(signature), BANDS)).copy()
    for i in range(ROWS):
        h = tv.mix(h ^ bits[:, :, i])
    return h


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags, as (sorted elements, counts); 0 if one is empty."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 0.0


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = tv.text_bytes(pa.array([text], pa.large_string()))
    _, shingle, count = shingles_of(raw, offsets)
    return shingle, count


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, a, b, size, bands, print) of (id, h, text): two more hashes of the text, how many shingles it has, its bands and a
    byte of each place of its signature."""
    for batch in batches:
        raw, offsets = tv.text_bytes(batch.column(2))
        for i, j in tv.chunks(offsets):
            part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            doc, shingle, count = shingles_of(part, off)
            n = j - i
            size = np.bincount(doc, count, n).astype(np.int64)
            signature = signatures(doc, shingle, count, n)
            bands = bands_of(signature)
            prints = (tv.mix(signature.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
            digest = tv.text_hash(part, off)
            some = size > 0
            ends = np.concatenate([[0], np.cumsum(some * BANDS)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(size), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands[some].ravel().view(np.int64))), pa.array([x.tobytes() for x in prints], pa.binary())],
                ["id", "h", "a", "b", "size", "bands", "print"],
            )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, similarity) of those (u, v, text of u, text of v) that are similar; the text of v is often that of the row before."""
    held: tuple[str | None, tuple | None] = (None, None)
    for batch in batches:
        u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at, found = [], []
        for k in range(len(u)):
            text = batch.column(3)[k].as_py()
            if held[0] != text:
                held = (text, _bag(text))
            if (s := similarity(_bag(batch.column(2)[k].as_py()), held[1])) >= LEAST:
                at.append(k)
                found.append(s)
        yield pa.RecordBatch.from_arrays([pa.array([u[k] for k in at], pa.int64()), pa.array([v[k] for k in at], pa.int64()), pa.array(found, pa.float64())], ["u", "v", "similarity"])


@dataclass(frozen=True)
class _Texts:
    """rows: (id, h, text) of all rows. nodes: (node, id, h) of each distinct text. Texts are read again where they are wanted."""

    rows: DataFrame
    nodes: DataFrame

    def of(self, wanted: DataFrame) -> DataFrame:
        """(node, text) of the nodes of wanted; a text once for each repeated row."""
        keys = self.nodes.join(bounded(wanted.select("node").distinct(), MOST_BROADCAST), "node", "left_semi")
        return self.rows.join(bounded(keys, MOST_BROADCAST), ["id", "h"]).select("node", "text")


def _confirm(pairs: DataFrame, texts: _Texts) -> DataFrame:
    """Similar pairs of (u, v). Both texts come by joins on their nodes; a much-paired one's rows may be split."""
    found = texts.of(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))))
    both = pairs.join(found.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u").join(found.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
    return small_batches(both.select("u", "v", "tu", "tv")).mapInArrow(tv.trimmed(_verified), "u long, v long, similarity double")


def _asked(queries: pa.Table, block: pa.Table) -> tuple[np.ndarray, ...]:
    ids, classes, sizes = (block.column(c).to_numpy() for c in ("node", "class", "size"))
    return ids, classes, sizes, *(queries.column(c).to_numpy() for c in ("node", "class", "size"))


def _plausible(queries: pa.Table, block: pa.Table) -> pa.Table:
    """(c, d): joins the classes of queries with those of the block's members whose signatures agree as those of similar bags do. Classes
    that are joined through others have no row of their own, so there are fewer rows than classes."""
    schema = pa.schema([("c", pa.int64()), ("d", pa.int64())])
    if not len(queries) or not len(block):
        return schema.empty_table()
    _, classes, sizes, _, own, own_size = _asked(queries, block)
    prints = np.stack([np.frombuffer(x, np.uint8) for x in block.column("print").to_pylist()])
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.setdefault(c, c)) != c:
            parent[c] = c = parent[up]
        return c

    for c, size, p in zip(own.tolist(), own_size.tolist(), queries.column("print").to_pylist(), strict=True):
        fits = (classes != c) & (np.minimum(sizes, size) >= LEAST * np.maximum(sizes, size) - 1e-9)
        at = np.flatnonzero(fits)
        at = at[(prints[at] == np.frombuffer(p, np.uint8)).sum(1) >= PLAUSIBLE]
        for d in np.unique(classes[at]).tolist():
            x, y = sorted((root(c), root(d)))
            parent[y] = x
    out = [(c, root(c)) for c in parent if root(c) != c]
    return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=schema)


def _compared(queries: pa.Table, block: pa.Table) -> pa.Table:
    """(u, v, similarity): for each query and each other class of the block, its most similar member, if it is similar.
    All are compared: the queries' shingles are looked up in the block's."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("similarity", pa.float64())])
    if not len(queries) or not len(block):
        return schema.empty_table()
    ids, classes, sizes, own_id, own, own_size = _asked(queries, block)
    raw, offsets = tv.text_bytes(block.column("text"))
    doc, shingle, count = shingles_of(raw, offsets)
    by = np.argsort(shingle, kind="stable")
    doc, shingle, count = doc[by], shingle[by], count[by]
    found = []
    raw, offsets = tv.text_bytes(queries.column("text"))
    which, mine, times = shingles_of(raw, offsets)
    first = np.searchsorted(which, np.arange(len(queries) + 1))
    for q in range(len(queries)):
        s, t = mine[first[q] : first[q + 1]], times[first[q] : first[q + 1]]
        lo, n = np.searchsorted(shingle, s), np.searchsorted(shingle, s, "right")
        at = tv.ragged(lo, n - lo)
        both = np.bincount(doc[at], np.minimum(count[at], np.repeat(t, n - lo)), len(ids))
        like = np.where(classes == own[q], 0, both / np.maximum(sizes + own_size[q] - both, 1))
        hits = np.flatnonzero(like >= LEAST)
        hits = hits[np.argsort(-like[hits], kind="stable")]
        for k in hits[np.unique(classes[hits], return_index=True)[1]]:
            found.append((max(own_id[q], ids[k]), min(own_id[q], ids[k]), like[k]))
    return pa.table([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], schema=schema)


def _in_blocks(members: DataFrame, key: str, weight: Column, most: Column, work, schema: str) -> DataFrame:
    """work(queries, block) over members, of a group each (key). Both sides are dealt into parts of about most of weight (a column over
    n, the group's members): the blocks hold all members, the queries are all but those of the group's largest class, and each part of the
    queries meets each block in a task of its own. So a task holds two parts, whatever the group's size."""
    sizes = members.groupBy(key, "class").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    sizes = sizes.groupBy(key).agg(F.max(F.struct("n", "class", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    parts = lambda w: F.greatest(F.lit(1), F.ceil(w / most)).cast("int")
    sizes = sizes.select(key, F.col("top.class").alias("main"), parts(F.col("w")).alias("blocks"), parts(F.col("w") - F.col("top.w")).alias("asks"))
    columns = [F.col(c).alias(c) for c in members.columns]
    rows = members.join(sizes, key)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), n).cast("int")
    blocks = rows.select(*columns, own(1, F.col("blocks")).alias("block"), each(F.col("asks")).alias("ask"))
    queries = rows.where("class <> main").select(*columns, each(F.col("blocks")).alias("block"), own(2, F.col("asks")).alias("ask"))
    return queries.groupBy(key, "block", "ask").cogroup(blocks.groupBy(key, "block", "ask")).applyInArrow(tv.trimmed_pair(work), schema)


def _classes(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(id, h, class) of rows (id, h, text): class stands for the texts that are joined by links, and is their least node. A text's node is
    the least id that has it, or, if that id has other texts too, a hash of the text; and whether all nodes are ids."""
    sketches = settled(small_batches(rows.select("id", "h", "text")).mapInArrow(tv.trimmed(_sketched), "id long, h long, a long, b long, size long, bands array<long>, print binary"), "sketches")
    stands = sketches.groupBy("a", "b").agg(F.min_by(F.struct("id", "h", "size", "bands", "print"), F.struct("id", "h")).alias("s"))
    stands = stands.select("a", "b", "s.*")
    several = settled(sketches.groupBy("id").agg(F.min(F.struct("a", "b")).alias("low"), F.max(F.struct("a", "b")).alias("high")).where("low <> high").select("id"), "several")
    plain = several.isEmpty()
    if plain:
        stands = stands.withColumn("node", F.col("id"))
    else:
        stands = stands.join(bounded(several.withColumn("several", F.lit(True)), MOST_BROADCAST), "id", "left").withColumn("node", F.when(F.col("several"), F.xxhash64("a", "b")).otherwise(F.col("id"))).drop("several")
    stands = settled(stands, "texts")
    texts = _Texts(rows, stands.select("node", "id", "h"))
    bands = settled(stands.select("node", "size", F.explode("bands").alias("band")), "bands")
    shared = bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    members = settled(bands.join(shared.select("band"), "band", "left_semi").distinct(), "members")
    left, classes = members.withColumn("class", F.col("node")), members.select("node", F.col("node").alias("class")).distinct()
    for turn in range(ROUNDS):
        pairs = settled(_with_leader(left, turn), "pairs")
        if pairs.isEmpty():
            continue
        classes, left = _regrouped(members, classes, settled(_confirm(pairs, texts), "links", instead=(pairs,)))
    edges = None
    if not left.isEmpty():
        prints = left.join(stands.select("node", "print"), "node")
        most = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), 16 * F.sqrt("n")))
        edges = settled(_in_blocks(prints, "band", F.lit(1), most, _plausible, "c long, d long").distinct(), "plausible")
    if edges is not None and not edges.isEmpty():
        clusters = connected_components(edges, "c", "d").select(F.col("node").alias("class"), F.col("component").alias("cluster"))
        some = classes.join(clusters, "class").join(stands.select("node", "size"), "node")
        found = texts.of(some).dropDuplicates(["node"])
        found = _in_blocks(some.join(found, "node"), "cluster", F.octet_length("text") + 1, F.lit(BLOCK_BYTES), _compared, "u long, v long, similarity double")
        classes, _ = _regrouped(members, classes, settled(found, "links"))
    named = stands.select("a", "b", "node").join(classes, "node", "left").select("a", "b", F.coalesce("class", "node").alias("class"))
    return sketches.select("id", "h", "a", "b").join(named, ["a", "b"]).select("id", "h", "class"), plain


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).where("id is not null")
    return rows.select("id", F.xxhash64("text").alias("h"), "text")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, class_id): class_id is the least id of the texts that are joined by links, directly or not.

    Equal texts are of one class, whatever their length, and one of them, that of the least id, stands for all. Two texts are linked if
    they share a band and their bags' similarity is LEAST or more. In every band, members first meet its leaders. Links join classes, and bands
    whose members are then of one class are done. In the others, members outside the band's largest class are held against all others
    by their signatures, in blocks; classes that may be linked so form clusters, and in each the members outside its largest
    class are compared exactly with all its members, in blocks. So no group is expanded into pairs, and a link that
    a band shows is lost only if signatures agree in fewer than PLAUSIBLE of SIZE places (a chance of about 1e-6 at LEAST, less above).
    Null and empty texts have no shingles and equal each other; rows with a null id have a null class. Rows of one id and
    different texts are texts of their own. An empty table gives no rows; further columns don't matter. The working tables are written to
    the shared folder.
    """
    found, plain = _classes(_keyed(docs, id_col, text_col))
    if plain:
        out = found.select(F.col("id").alias(id_col), F.col("class").alias("class_id"))
    else:
        # both written out, so that a large class's rows may be split
        found = settled(found, "classes")
        least = settled(found.groupBy("class").agg(F.min("id").alias("class_id")), "least")
        out = found.join(least, "class").select(F.col("id").alias(id_col), "class_id")
    nulls = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias(id_col), F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(nulls)


def _regrouped(members: DataFrame, classes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, class) of all members after new links between the classes so far, and members with their class of those bands that still
    have several."""
    of = lambda end, name: classes.select(F.col("node").alias(end), F.col("class").alias(name))
    edges = links.select("u", "v").join(of("u", "c"), "u").join(of("v", "d"), "v").where("c <> d").select(F.greatest("c", "d").alias("c"), F.least("c", "d").alias("d")).distinct()
    groups = connected_components(edges, "c", "d").select(F.col("node").alias("class"), "component")
    classes = settled(classes.join(groups, "class", "left").select("node", F.coalesce("component", "class").alias("class")), "classes")
    here = members.join(classes, "node")
    mixed = here.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("band")
    return classes, settled(here.join(mixed, "band", "left_semi"), "left")


def _with_leader(left: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs (u > v) of a band's members with its leader, without pairs of one class and those whose sizes rule a similarity of
    LEAST out. The leader is the band's least node, and in the last round the least node of its greatest class. In the first round each
    member meets but one of its bands' leaders, that of the most bands; what that joins needn't be compared again."""
    first = F.struct(F.lit(0).cast("long"), F.col("node")) if turn < ROUNDS - 1 else F.struct(-F.col("class"), F.col("node"))
    leader = left.groupBy("band").agg(F.min_by(F.struct("node", "size", "class"), first).alias("l"))
    pairs = left.join(leader, "band").where("class <> l.class")
    fits = F.least("size", "l.size") >= LEAST * F.greatest("size", "l.size") - 1e-9
    pairs = pairs.where(fits).groupBy("node", F.col("l.node").alias("other")).agg(F.count("*").alias("n"))
    if turn == 0:
        pairs = pairs.groupBy("node").agg(F.max_by("other", F.struct(F.col("n"), -F.col("other"))).alias("other"))
    return pairs.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: of its least id, and of that id's texts the one with the least hash (rows with null ids all stay;
    of repeated rows one stays). Columns stay as they are. Only ids and hashes are worked on; the rows that go are then
    taken out by an anti join, which shuffles no text unless they are many."""
    found = settled(_classes(_keyed(docs, id_col, text_col))[0], "classes")
    best = settled(found.groupBy("class").agg(F.min(F.struct("id", "h")).alias("best")).select("best.*"), "kept")
    rows = found.groupBy("id", "h").agg(F.count("*").alias("n"))
    gone = bounded(settled(rows.join(best, ["id", "h"], "left_anti").select("id", "h"), "gone"), MOST_BROADCAST)
    h = free_name(docs, "__h")
    keyed = docs.withColumn(h, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    at = lambda df: (keyed[id_col] == df["id"]) & (keyed[h] == df["h"])
    kept = keyed.join(gone, at(gone), "left_anti")
    twice = settled(rows.where("n > 1").join(best, ["id", "h"], "left_semi").select("id", "h"), "repeated")
    if not twice.isEmpty():
        more = bounded(twice, MOST_BROADCAST)
        kept = kept.join(more, at(more), "left_anti").unionByName(keyed.join(more, at(more), "left_semi").dropDuplicates([id_col, h]))
    return kept.select(docs.columns)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class."""
    return near_duplicates(table(spark, sf_dir, "documents"))

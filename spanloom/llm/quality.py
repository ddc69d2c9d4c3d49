"""Quality classifier: a weak-label model and hashed linear scorers.

Overlapping heuristic labellers vote on every document, or abstain. Expectation-maximisation over the counts of all
vote patterns estimates how often each labeller says what in either class. The posterior labels of a bounded sample
train two scorers, which then judge every document: one for junk, logistic, on hashed words and byte trigrams; one for insults, on
hashed beginnings of words. Few words make a document toxic, whatever its length, and insults are stems with any ending in any language; so the
second learns which beginnings of words stand more often in toxic documents than in others, and weighs how many words have
them against how many words there are. A document that either finds bad is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import textvec as tv
from spanloom.llm.common import settled, small_batches, table

#: Documents that train the scorers, at most; chosen by the least hashes of their ids.
SAMPLE = 6_000
#: Of them, so many are chosen among those that some labeller finds bad, if there are.
SAMPLE_BAD = 3_000
#: Bytes of text of the sample, at most; a document that would pass it is left out.
SAMPLE_BYTES = 64 << 20
#: Rows of a training step.
AT_ONCE = 256
#: Hash buckets of a scorer.
BUCKETS = 1 << 18
#: Further places of a scorer: the tenths of repeated words, and one for short texts.
TENTHS = 11
#: Scores from here on reject.
REJECT_JUNK, REJECT_TOXIC = 0.5, 0.95
#: A text's weights have unit length from so many features on; a shorter text's are less, for it says less.
LEAST_FEATURES = 150
#: Lengths in bytes of a word's beginnings; a shorter or longer word counts as a whole too.
BEGINNINGS = range(4, 13)
#: A beginning tells if so many toxic documents of the sample have it, and so much more often (logarithm) than others.
LEAST_BAD, LEAST_RATIO = 5, 1.5
#: Least weights that are tried, ascending, the share of told good documents that may be found toxic with the one that is taken, and from which score on they count as that: less
#: than rejects, for the sample is small.
CUTS, MOST_WRONG, WRONG = (2.0, 2.5, 3.0, 3.5, 4.0), 0.0005, 0.8
#: What a listed insult weighs at least, and the shares of telling words in toxic and other documents that stand in where the sample has none.
LISTED_WEIGHT, USUAL_RATES = 7.0, (0.025, 0.001)

ABSTAIN, GOOD, BAD = -1, 0, 1

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = """the of and to in a is that for it as was with be by on not he this are or his from at which but have an they
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
le de un à être et en avoir que pour dans ce il qui ne sur se pas plus par je avec tout faire son mettre la les des du une au elle
el en y a los se del las por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando""".split()
#: Common insults.
INSULTS = """idiot idiots moron morons scum clown loser losers stupid trash worthless pathetic disgusting imbecile dumb garbage vermin
trottel dummkopf abschaum versager widerlich crétin imbécile connard ordure idiota imbécil basura escoria estúpido""".split()
SYMBOLS = "#$%&*|!<>{}=~^@+\\"


@dataclass(frozen=True)
class Task:
    """kinds: for each kind of bad document, the labellers that see it; the others may find it good. wrong: how often a labeller
    finds a good document bad, at first. sure: the labeller whose votes are always right, if any. by_words: whether it is scored by the
    beginnings of words."""

    name: str
    labellers: tuple[str, ...]
    kinds: tuple[tuple[str, ...], ...]
    prior: float
    reject: float
    wrong: float = 0.02
    sure: str = ""
    by_words: bool = False


JUNK = Task("junk", ("symbols", "shouting", "repeats", "phrases", "prose", "marked_low"), (("symbols", "prose", "marked_low"), ("shouting", "symbols", "marked_low"), ("repeats", "phrases", "marked_low")), 0.1, REJECT_JUNK)
#: A text without a listed insult may be toxic in other words or another language; only marks tell.
TOXIC = Task("toxic", ("insults", "marked_toxic"), (("insults", "marked_toxic"),), 0.05, REJECT_TOXIC, 0.001, "marked_toxic", True)
TASKS = (JUNK, TOXIC)


def _known(words: list[str]) -> np.ndarray:
    raw, offsets = tv.text_bytes(pa.array(words))
    return np.unique(tv.words_of(raw, offsets, _EDGES).hash)


#: Bytes between words for the labellers: all of ASCII but letters and digits.
_EDGES = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many distinct hashes each text has."""
    if not len(h):
        return np.zeros(n, np.int64)
    keys = np.unique(tv.mix(h ^ tv.mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    return np.bincount(doc[keys], minlength=n)


def _vote(value: np.ndarray, good: float, bad: float, sure: np.ndarray) -> np.ndarray:
    """BAD from bad on, GOOD up to good, else ABSTAIN; ABSTAIN too where not sure."""
    return np.where(~sure, ABSTAIN, np.where(value >= bad, BAD, np.where(value <= good, GOOD, ABSTAIN))).astype(np.int8)


def heuristic_votes(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Each heuristic labeller's vote on each of many texts. On an empty text all abstain."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    some = np.diff(offsets) > 0
    kind = np.zeros(256, np.int8)
    kind[[ord(c) for c in SYMBOLS]] = 1
    symbols = _per_text(kind[raw] == 1, offsets) / size
    upper = _per_text((raw >= 65) & (raw <= 90), offsets)
    letters = upper + _per_text((raw >= 97) & (raw <= 122), offsets)
    words = tv.words_of(_LOWER[raw], offsets, _EDGES)
    doc, count = words.doc, np.diff(words.first)
    many = count >= 20
    repeated = 1 - _distinct(doc, words.hash, n) / np.maximum(count, 1)
    grams, ok = tv.grams_of(words.hash, 5), tv.whole(words.first, 5)
    fives = doc[: len(grams)][ok]
    phrases = 1 - _distinct(fives, grams[ok], n) / np.maximum(np.bincount(fives, minlength=n), 1)
    prose = np.bincount(doc[np.isin(words.hash, _known(FUNCTION_WORDS))], minlength=n) / np.maximum(count, 1)
    rude = np.isin(words.hash, _known(INSULTS))
    hits = np.bincount(doc[rude], minlength=n)
    return {
        "symbols": _vote(symbols, 0.02, 0.06, some),
        "shouting": _vote(upper / np.maximum(letters, 1), 0.2, 0.6, letters >= 10),
        "repeats": _vote(repeated, 0.6, 0.85, many),
        "phrases": _vote(phrases, 0.2, 0.6, many),
        "prose": _vote(1 - prose, 0.93, 0.995, many),
        "insults": _vote(hits, 0, 1, some),
    }


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight): the distinct hashed words and byte trigrams of each text, each text's weights of unit length
    at most, and, with a weight of one, which tenth of its words are repeats, if it has twenty words."""
    n = len(offsets) - 1
    words = tv.words_of(_LOWER[raw], offsets)
    count = np.diff(words.first)
    width = np.uint64(BUCKETS)
    key = np.unique(words.doc.astype(np.uint64) * width + (words.hash >> np.uint64(40)) % width)
    kinds = np.bincount((key // width).astype(np.int64), minlength=n)
    tenth = np.where(count >= 20, (10 * (1 - kinds / np.maximum(count, 1))).astype(np.int64), 10)
    if len(raw) >= 3:
        three = (raw[:-2].astype(np.uint64) << np.uint64(16)) | (raw[1:-1].astype(np.uint64) << np.uint64(8)) | raw[2:]
        at = np.repeat(np.arange(n), np.diff(offsets)).astype(np.uint64)
        ok = at[:-2] == at[2:]
        key = np.concatenate([key, at[:-2][ok] * width + tv.mix(three[ok] + np.uint64(7)) % width])
    key = np.unique(key)
    text, bucket = (key // width).astype(np.int64), (key % width).astype(np.int64)
    per = np.bincount(text, minlength=n)
    where = np.append(np.searchsorted(text, np.arange(n)), len(text))[:n]
    return np.insert(text, where, np.arange(n)), np.insert(bucket, where, BUCKETS + tenth), np.insert(1 / np.sqrt(np.maximum(per, LEAST_FEATURES))[text], where, 1.0)


@dataclass
class VoteModel:
    """shares[c]: of the documents that are in class c; class 0 is good, each further class a kind of bad.
    rates[l, c]: how often labeller l, if it votes, votes bad in class c. sure: the labeller whose votes decide, or -1."""

    shares: np.ndarray
    rates: np.ndarray
    sure: int = -1

    def by_class(self, votes: np.ndarray) -> np.ndarray:
        """The chance of each class, for documents with such votes (-1, 0, 1 by labeller). Abstaining says nothing."""
        logs = np.log(self.shares)[None, :] + np.zeros((len(votes), 1))
        for i, rate in enumerate(self.rates):
            logs += np.where((votes[:, i] == BAD)[:, None], np.log(rate), np.where((votes[:, i] == GOOD)[:, None], np.log1p(-rate), 0.0))
        if self.sure >= 0:
            logs[votes[:, self.sure] == BAD, 0] = -np.inf
            logs[votes[:, self.sure] == GOOD, 1:] = -np.inf
        chance = np.exp(logs - logs.max(1, keepdims=True))
        return chance / chance.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance that a document with such votes is bad."""
        return 1 - self.by_class(votes)[:, 0]

    @classmethod
    def fit(cls, task: Task, votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> VoteModel:
        """Expectation-maximisation over vote patterns and how many documents have each. It starts from labellers that see
        nine of ten documents of their kinds, one of ten of other kinds, and are wrong on task.wrong of the good ones, and weighs
        that as much as ten documents."""
        sure = task.labellers.index(task.sure) if task.sure else -1
        first = np.array([[task.wrong, *(0.9 if x in kind else 0.1 for kind in task.kinds)] for x in task.labellers])
        shares = np.array([1 - task.prior, *[task.prior / len(task.kinds)] * len(task.kinds)])
        model = cls(shares, first, sure)
        for _ in range(rounds):
            weight = model.by_class(votes) * counts[:, None]
            new = (weight.sum(0) + 10 * shares) / (counts.sum() + 10)
            bad = np.stack([((votes[:, i] == BAD)[:, None] * weight).sum(0) for i in range(len(first))])
            said = np.stack([((votes[:, i] != ABSTAIN)[:, None] * weight).sum(0) for i in range(len(first))])
            rates = np.clip((bad + 10 * first) / (said + 10), 1e-3, 1 - 1e-3)
            done = np.abs(new - model.shares).max() < 1e-9 and np.abs(rates - model.rates).max() < 1e-9
            model = cls(new, rates, sure)
            if done:
                break
        return model


def train(rows: list[tuple[np.ndarray, float, float]], steps: int = 500, rate: float = 0.5, decay: float = 1e-6) -> np.ndarray:
    """Weights, and a bias at last, of a logistic scorer: about so many adaptive steps, each over AT_ONCE rows of (distinct buckets, chance that it is bad, weight)."""
    size = BUCKETS + TENTHS + 1
    w, g = np.zeros(size), np.full(size, 1e-8)
    order = np.random.default_rng(0)
    for _ in range(-(-steps * AT_ONCE // max(len(rows), AT_ONCE))):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // AT_ONCE)):
            if not len(batch):
                continue
            sizes = np.array([len(rows[i][0]) for i in batch])
            at = np.concatenate([rows[i][0] for i in batch]).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
            x = np.where(at < BUCKETS, np.repeat(1 / np.sqrt(np.maximum(sizes - 1, LEAST_FEATURES)), sizes), 1.0)
            text = np.repeat(np.arange(len(batch)), sizes)
            z = np.bincount(text, w[at] * x, len(batch)) + w[-1]
            err = (1 / (1 + np.exp(-z)) - np.array([rows[i][1] for i in batch])) * np.array([rows[i][2] for i in batch])
            grad = np.bincount(at, err[text] * x, size)
            grad[-1] = err.sum()
            grad = grad / len(batch) + decay * w
            g += grad * grad
            w -= rate * grad / np.sqrt(g)
    return w


def beginnings(words: tv.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, hash) of the words' beginnings, one length after the other, and of whole words of other lengths at last. So the last hash that a
    word has here is that of all of it."""
    length = words.ends - words.starts
    at, h = np.arange(len(length)), np.full(len(length), tv.GOLD)
    for k in range(1, BEGINNINGS[-1] + 1):
        on = length[at] >= k
        at = at[on]
        h = (h[on] ^ words.raw[words.starts[at] + (k - 1)]) * tv._BASE
        if k >= BEGINNINGS[0]:
            yield at, tv.mix(h + tv.gold(k))
    at = np.flatnonzero((length < BEGINNINGS[0]) | (length > BEGINNINGS[-1]))
    yield at, tv.mix(words.hash[at] + tv.GOLD)


@dataclass
class Telling:
    """hashes, weights: of the beginnings that tell, by ascending hash. start: the score of a text without words. drift: what each word takes from
    it, which is how much likelier a word in a toxic text is to be a telling one."""

    hashes: np.ndarray
    weights: np.ndarray
    start: float
    drift: float

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def word_weights(self, words: tv.Words) -> np.ndarray:
        """The weight of each word's most telling beginning, 0 if none tells."""
        out = np.zeros(len(words.starts))
        if not len(self.hashes):
            return out
        for at, h in beginnings(words):
            some = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
            where = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            hit = self.hashes[where] == h[some]
            out[at[some[hit]]] = np.maximum(out[at[some[hit]]], self.weights[where[hit]])
        return out

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's logarithm of how much likelier it is toxic than not."""
        words = tv.words_of(_LOWER[raw], offsets, _EDGES)
        return self.start + _per_text(self.word_weights(words), words.first) - self.drift * np.diff(words.first)


def _listed() -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the listed insults, as whole words, and their weights."""
    words = tv.words_of(*tv.text_bytes(pa.array(INSULTS)), _EDGES)
    whole = np.zeros(len(words.starts), np.uint64)
    for at, h in beginnings(words):
        whole[at] = h
    return np.unique(whole), np.full(len(np.unique(whole)), LISTED_WEIGHT)


def _sums(raw: np.ndarray, offsets: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, documents that have such a beginning by their chance to be bad and to be good, words by the same) of a few texts; hash 0 stands for
    all documents and words."""
    words = tv.words_of(_LOWER[raw], offsets, _EDGES)
    at, h = (np.concatenate(x) for x in zip(*beginnings(words), strict=True))
    doc = words.doc[at]
    by = np.lexsort((h, doc))
    doc, h = doc[by], h[by]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(doc) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(doc)))
    doc, h = np.append(doc[new], np.arange(len(bad))), np.append(h[new], np.zeros(len(bad), np.uint64))
    times = np.append(times, np.diff(words.first))
    kinds, back = np.unique(h, return_inverse=True)
    p = bad[doc]
    return kinds, *(np.bincount(back, x, len(kinds)) for x in (p, 1 - p, p * times, (1 - p) * times))


def fit_telling(told: DataFrame, share: float) -> Telling:
    """Which beginnings of words tell, and how much, from told: (text, p), documents and their chance to be toxic. Documents and words are counted
    by beginning where the rows are; only the beginnings that tell come to the driver, and then a few sums of each document. Of CUTS the lowest least weight is
    taken with which at most MOST_WRONG of the told good documents are found toxic, or else the one with which fewest are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tv.text_bytes(b.column(0))
            p = b.column(1).to_numpy(zero_copy_only=False)
            for i, j in tv.chunks(offsets):
                kinds, *sums = _sums(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), *map(pa.array, sums)], ["h", *names])

    names = ["bad", "good", "bad_words", "good_words"]
    counts = small_batches(told.select("text", "p")).mapInArrow(tv.trimmed(counted), "h long, " + ", ".join(f"{n} double" for n in names))
    counts = settled(counts.groupBy("h").agg(*[F.sum(n).alias(n) for n in names]), "beginnings")
    whole = counts.where("h = 0").first() or dict.fromkeys(names, 0.0)
    ratio = F.log((F.col("bad") + 0.5) / (whole["bad"] + 1)) - F.log((F.col("good") + 0.5) / (whole["good"] + 1))
    weight = F.log((F.col("bad_words") + 0.5) / (whole["bad_words"] + 1)) - F.log((F.col("good_words") + 0.5) / (whole["good_words"] + 1))
    tell = counts.where((F.col("h") != 0) & (F.col("bad") >= LEAST_BAD) & (ratio > LEAST_RATIO) & (weight >= CUTS[0])).select("h", weight.alias("w")).collect()
    h, w = _listed()
    h = np.concatenate([np.array([r["h"] for r in tell], np.int64).view(np.uint64), h])
    w = np.concatenate([np.array([r["w"] for r in tell], np.float64), w])
    by = np.lexsort((-w, h))
    h, at = np.unique(h[by], return_index=True)
    found = Telling(h, w[by][at], float(np.log(share / (1 - share))), 0.0)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tv.text_bytes(b.column(0))
            for i, j in tv.chunks(offsets):
                words = tv.words_of(_LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], _EDGES)
                best = found.word_weights(words)
                sums = [_per_text(x, words.first).astype(np.float64) for c in CUTS for x in (np.where(best >= c, best, 0), best >= c)]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), pa.array(np.diff(words.first).astype(np.float64)), *map(pa.array, sums)], [f"c{k}" for k in range(len(sums) + 2)])

    # a dozen numbers for each document of the sample
    facts = small_batches(told.select("text", "p")).mapInArrow(tv.trimmed(hits), ", ".join(f"c{k} double" for k in range(2 * len(CUTS) + 2))).toArrow()
    p, n, *sums = (facts.column(k).to_numpy() for k in range(facts.num_columns))
    best, limit = None, np.log(WRONG / (1 - WRONG))
    for k, cut in enumerate(CUTS):
        toxic, other = (float(sums[2 * k + 1] @ q / max(n @ q, 1.0)) for q in (p, 1 - p)) if whole["bad"] >= LEAST_BAD else USUAL_RATES
        drift = max(toxic - other, 0.0)
        wrong = float(((found.start + sums[2 * k] - drift * n >= limit) & (p < 0.5)).sum() / max((p < 0.5).sum(), 1))
        if best is None or wrong < best[0]:
            best = (wrong, cut, drift)
        if wrong <= MOST_WRONG:
            break
    keep = found.weights >= best[1]
    return Telling(found.hashes[keep], found.weights[keep], found.start, best[2])


def votes_of(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame | None) -> DataFrame:
    """(id, h, size in bytes, one column for each labeller): votes on each row; marks of labels(doc_id, quality, toxic) are two labellers, of
    several rows of one id the worst."""
    names = [x for t in TASKS for x in t.labellers if not x.startswith("marked")]
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tv.text_bytes(b.column(2))
            for i, j in tv.chunks(offsets):
                found = heuristic_votes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), *(pa.array(found[x]) for x in names)], ["id", "h", "size", *names])

    out = small_batches(rows).mapInArrow(tv.trimmed(run), "id string, h long, size long, " + ", ".join(f"{x} byte" for x in names))
    if labels is None:
        return out.withColumns({"marked_low": F.lit(ABSTAIN).cast("byte"), "marked_toxic": F.lit(ABSTAIN).cast("byte")})
    marks = labels.groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    mark = lambda c, bad: F.when(c.isNull(), ABSTAIN).otherwise((c == bad).cast("int")).cast("byte")
    return out.join(marks, "id", "left").withColumns({"marked_low": mark(F.col("q"), 0), "marked_toxic": mark(F.col("t"), 1)}).drop("q", "t")


@dataclass
class Scorer:
    """weights: of the logistic scorer, or telling: of the one by words."""

    task: Task
    votes: VoteModel
    weights: np.ndarray | None = None
    telling: Telling | None = None


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labels: DataFrame | None = None, sample: int = SAMPLE) -> list[Scorer]:
    """A scorer for each task. The vote patterns of all rows are counted (3 ** labellers at most, whatever the rows); the
    scorers learn from sample rows of SAMPLE_BYTES together at most, weighed as the corpus has them."""
    spark = docs.sparkSession
    names = [x for t in TASKS for x in t.labellers]
    votes = settled(votes_of(docs, id_col, text_col, labels), "votes")
    patterns = votes.groupBy(*names).count().collect()
    table_ = np.array([[r[x] for x in names] for r in patterns], np.int64).reshape(-1, len(names))
    counts = np.array([r["count"] for r in patterns], np.float64)
    models = {}
    for t in TASKS:
        at = [names.index(x) for x in t.labellers]
        models[t.name] = VoteModel.fit(t, table_[:, at], counts)
    keyed = votes.withColumn("r", F.xxhash64("id", "h"))
    suspect = F.greatest(*[F.col(x) for x in names]) == BAD
    some = keyed.where(suspect).orderBy("r").limit(min(SAMPLE_BAD, sample)).collect()
    some += keyed.orderBy("r").limit(sample - len(some)).collect()
    chosen: dict[tuple, list[int]] = {}
    left = SAMPLE_BYTES
    for r in some:
        if (r["id"], r["h"]) not in chosen and r["size"] <= left:
            chosen[r["id"], r["h"]] = [r[x] for x in names]
            left -= r["size"]
    order = sorted(chosen, key=lambda k: (k[1], k[0] or ""))
    said = np.array([chosen[k] for k in order], np.int64).reshape(-1, len(names))
    of = {t.name: said[:, [names.index(x) for x in t.labellers]] for t in TASKS}
    bad = {t.name: models[t.name].posterior(of[t.name]) for t in TASKS}
    # where there are marks, only marked rows teach about insults: the others show but those that are listed
    told = {t.name: np.ones(len(order), bool) for t in TASKS}
    for t in TASKS:
        if t.sure and (marks := of[t.name][:, models[t.name].sure])[marks == BAD].size >= LEAST_BAD:
            told[t.name] = marks != ABSTAIN
    columns = [x for t in TASKS for x in (f"p_{t.name} double", f"told_{t.name} boolean")]
    facts = zip(*[x.tolist() for t in TASKS for x in (bad[t.name], told[t.name])], strict=True)
    wanted = spark.createDataFrame([(*k, i, *f) for i, (k, f) in enumerate(zip(order, facts, strict=True))], "id string, h long, at int, " + ", ".join(columns))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    rows = rows.alias("d").join(F.broadcast(wanted.alias("w")), F.expr("d.h = w.h and d.id <=> w.id")).select("w.*", "text").dropDuplicates(["at"])
    rows = settled(rows, "sample")
    share = counts[(table_ == BAD).any(1)].sum() / max(counts.sum(), 1)
    seen = (said == BAD).any(1)
    weight = np.where(seen, share / max(seen.mean(), 1e-9), (1 - share) / max(1 - seen.mean(), 1e-9)) if len(order) else np.zeros(0)
    out = []
    buckets = None
    for t in TASKS:
        model = models[t.name]
        if t.by_words:
            p = rows.where(f"told_{t.name}").select("text", F.col(f"p_{t.name}").alias("p"))
            out.append(Scorer(t, model, telling=fit_telling(p, float(np.clip(1 - model.shares[0], 0.01, 0.5)))))
            continue
        buckets = _buckets(rows) if buckets is None else buckets
        out.append(Scorer(t, model, train([(buckets[i], p, x) for i, (p, x) in enumerate(zip(bad[t.name], weight, strict=True)) if i in buckets])))
    tv.trim()
    return out


def _buckets(rows: DataFrame) -> dict[int, np.ndarray]:
    """The buckets of each text of the sample (at, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tv.text_bytes(b.column(1))
            for i, j in tv.chunks(offsets):
                text, bucket, _ = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.searchsorted(text, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))], ["at", "buckets"])

    found = small_batches(rows.select("at", "text")).mapInArrow(tv.trimmed(run), "at int, buckets array<int>").toArrow()
    lists = found.column("buckets").combine_chunks()
    off, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    return {k: flat[off[i] : off[i + 1]] for i, k in enumerate(found.column("at").to_pylist())}


def score(docs: DataFrame, scorers: list[Scorer], text_col: str = "text") -> DataFrame:
    """docs with a column <task>_score (double, 0 to 1) for each scorer, and rejected: whether one reaches its limit. Null and
    empty texts score 0 and are kept: nothing speaks against them. Columns of these names are replaced."""
    spark = docs.sparkSession
    names = [f"{s.task.name}_score" for s in scorers]
    limits = [s.task.reject for s in scorers]
    models = spark.sparkContext.broadcast([s.telling or s.weights.astype(np.float32) for s in scorers])
    kept = docs.drop(*names, "rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tv.text_bytes(b.column(text_col))
            parts = [np.zeros((len(limits), 0))]
            for i, j in tv.chunks(offsets):
                part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                parts.append(np.where(np.diff(off) > 0, 1 / (1 + np.exp(-np.clip(scored(models.value, part, off), -500, 500))), 0.0))
            scores = np.concatenate(parts, 1)
            rejected = np.any([s >= at for s, at in zip(scores, limits, strict=True)], axis=0) if len(limits) else np.zeros(len(b), bool)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(s) for s in scores), pa.array(rejected)], [*b.schema.names, *names, "rejected"])

    schema = kept.selectExpr("*", *[f"cast(0 as double) as {n}" for n in names], "true as rejected").schema
    return small_batches(kept).mapInArrow(tv.trimmed(run), schema)


def scored(models: list[Telling | np.ndarray], raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of scores of many texts, as logarithms of odds, for each model."""
    n = len(offsets) - 1
    text, bucket, x = features(raw, offsets)
    return np.stack([m.score(raw, offsets) if isinstance(m, Telling) else np.bincount(text, m[bucket] * x, n) + m[-1] for m in models]) if models else np.zeros((0, n))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labels: DataFrame | None = None) -> DataFrame:
    """docs with junk_score, toxic_score and rejected, by scorers fitted on these docs.

    Null and empty texts are kept. Repeated rows have equal scores. An empty table gives no rows. Further columns stay. labels, if
    given, are marks of some ids: (doc_id, quality, toxic)."""
    return score(docs, fit(docs, id_col, text_col, labels), text_col)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labels: DataFrame | None = None) -> DataFrame:
    """The rows of docs that classify() doesn't reject, with docs's columns as they are, whatever their names."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("__rest"), F.col(text_col).alias("text"))
    found = score(rows, fit(docs, id_col, text_col, labels)).where("not rejected")
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col("__rest")[c].alias(c) for c in docs.columns])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores and whether it is rejected."""
    found = classify(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))
    return found.select("doc_id", "junk_score", "toxic_score", "rejected")

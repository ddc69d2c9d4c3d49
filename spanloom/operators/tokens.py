"""Token predictions and chunks: merging of sub-words, chunking of texts, and merging of chunks' predictions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.regex import spark_regex

MOST_GAP = 5
#: Least score of a model's prediction.
LEAST_SCORE = 0.3
# Abbreviations after which no sentence ends.
ABBREVIATIONS = ["dr", "mr", "mrs", "ms", "prof", "etc", "vs", "nr", "no", "str", "st", "av", "ch", "bzw", "inc"]


def merge_tokens(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, token_id, tag, word, start, end, score), tagged B-x, I-x or O, as entities: an I- of the type before it, within
    MOST_GAP characters, goes on with its entity."""
    w = Window.partitionBy("doc_id").orderBy("start", "token_id")
    rows = tokens.where("tag <> 'O'").withColumns({"type": F.regexp_replace("tag", "^[BI]-", ""), "inner": F.col("tag").startswith("I-")})
    goes_on = F.col("inner") & (F.lag("type").over(w) == F.col("type")) & (F.col("start") - F.lag("end").over(w) <= MOST_GAP)
    rows = rows.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("entity", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy("doc_id", "entity", "type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "token_id", "word"))), lambda s: s["word"]), " ").alias("text"))
    return found.drop("entity")


def merge_runs(tokens: DataFrame) -> DataFrame:
    """Consecutive tokens of one type as one entity, whatever their tags' heads and gaps."""
    w = Window.partitionBy("doc_id").orderBy("start", "token_id")
    rows = tokens.where("tag <> 'O'").withColumn("type", F.regexp_replace("tag", "^[BI]-", ""))
    rows = rows.withColumn("new", F.when(F.lag("type").over(w) == F.col("type"), 0).otherwise(1)).withColumn("entity", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "entity", "type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("entity")


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, position, start, end, text): sentences end at . ! or ? before the end, a line's end, or a space and a capital, unless an abbreviation stands before."""
    ends = spark_regex(r"(?<!\b(?:" + "|".join(ABBREVIATIONS) + r"))(?<=[.!?])(?=\n|[ ]+[A-ZÄÖÜÀ-Ý])", fold=False)
    pieces = F.split(F.col(text_col), ends, -1)
    rows = docs.select(id_col, F.posexplode(pieces).alias("position", "text"))
    w = Window.partitionBy(id_col).orderBy("position")
    end = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return rows.select(id_col, "position", (end - F.length("text")).alias("start"), end.alias("end"), "text")


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 100, look: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, chunk, start, end, text): overlapping pieces of at most size characters, cut at the last line end or space of their last look
    characters. The cuts depend on one another, so a text is walked in Python, by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in zip(pdf[id_col], pdf[text_col].fillna(""), strict=True):
                at = n = 0
                while at < len(text):
                    end = min(len(text), at + size)
                    if end < len(text):
                        cut = max(text.rfind("\n", end - look, end), text.rfind(" ", end - look, end))
                        end = cut + 1 if cut > at else end
                    out.append((doc, n, at, end, text[at:end]))
                    if end == len(text):
                        break
                    at, n = max(at + 1, end - overlap), n + 1
            yield pd.DataFrame(out, columns=[id_col, "chunk", "start", "end", "text"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} long, chunk int, start int, end int, text string")


# Abbreviations after which the chunker's sentences go on, in either case; a full stop stands for itself.
SHORTENED = r"(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|e\.g|i\.e|Inc|Ltd|Corp|Co)\.$"
CAPITALS = "A-ZÄÖÜÀÂÇÉÈÊËÎÏÔÛÙŸŒÆ"
MOST_TOKENS, OVERLAP_TOKENS = 512, 50


def sentence_bounds(text: str) -> list[tuple[int, int]]:
    """(start, end) of the chunker's sentences; the space after one belongs to neither, but none stands alone."""
    out, start = [], 0
    for m in _SENTENCE_END.finditer(text):
        if m.start() < start:
            continue
        end = m.start() + 1
        if not _SHORTENED.search(text, max(start, end - 6), end):
            out.append((start, end))
            start = end
            while start < len(text) and text[start].isspace():
                start += 1
    if text[start:].strip():
        out.append((start, len(text)))
    return out


_SENTENCE_END = re.compile(rf"[.!?](?=\Z|\n|\s[{CAPITALS}])")
_SHORTENED = re.compile(SHORTENED, re.I)


def estimated_tokens(text: str) -> int:
    """A quarter of the characters, or the words if they are more."""
    return max(-(-len(text) // 4), len(text.split()))


def token_chunks(text: str, most: int = MOST_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, int]]:
    """(start, end) of chunks of whole sentences, of at most so many estimated tokens unless one sentence has more; each begins with the sentences that end the one before
    and have overlap tokens together, or the first few more. A text that fits is one chunk; an empty one has none."""
    if not text:
        return []
    found = sentence_bounds(text) if estimated_tokens(text) > most else []
    if not found:
        return [(0, len(text))]
    sizes = [estimated_tokens(text[a:b]) for a, b in found]
    # a sentence reaches to the next one
    ends = [*(b for b, _ in found[1:]), found[-1][1]]
    out, first, held = [], 0, 0
    for i, size in enumerate(sizes):
        if held + size > most and i > first:
            out.append((found[first][0], ends[i - 1]))
            back, held = i, 0
            while back > first and held < overlap:
                back -= 1
                held += sizes[back]
            first = back
        held += size
    out.append((found[first][0], ends[-1]))
    return out


def sentence_chunks(docs: DataFrame, most: int = MOST_TOKENS, overlap: int = OVERLAP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, chunk, start, end, text): token_chunks of each text. Where one chunk ends depends on where it began, so a text is walked in Python, by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(doc, i, a, b, text[a:b]) for doc, text in zip(pdf[id_col], pdf[text_col].fillna(""), strict=True) for i, (a, b) in enumerate(token_chunks(text, most, overlap))]
            yield pd.DataFrame(out, columns=[id_col, "chunk", "start", "end", "text"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} long, chunk int, start int, end int, text string")


def predictions(pieces: DataFrame, model: Callable[[], Callable[[list[str]], list[list[tuple[str, int, int, float]]]]], id_col: str = "doc_id", least: float = LEAST_SCORE, types: dict[str, str] | None = None, skip: bool = False) -> DataFrame:
    """(id_col, type, start, end, score) of a model over chunks: model() is called once for each worker's task and gives a function from texts to predictions. Those under
    least are dropped; types renames the model's. Where a batch fails, its texts are tried one by one, and RuntimeError names what still fails: a result is whole or none. With skip, chunks that
    fail by themselves have no predictions, and the others have theirs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = model()
        for pdf in batches:
            out = []
            texts = pdf["text"].tolist()
            try:
                found = predict(texts)
            except Exception:
                found = []
                for doc, text in zip(pdf[id_col], texts, strict=True):
                    try:
                        found += predict([text])
                    except Exception as why:
                        if not skip:
                            raise RuntimeError(f"the model fails on a chunk of {doc}: {why}") from why
                        found.append([])
            for doc, base, hits in zip(pdf[id_col], pdf["start"], found, strict=True):
                out += [(doc, (types or {}).get(kind, kind), int(base) + a, int(base) + b, float(s)) for kind, a, b, s in hits if s >= least]
            yield pd.DataFrame(out, columns=[id_col, "type", "start", "end", "score"])

    return pieces.select(id_col, "start", "text").mapInPandas(run, f"{id_col} long, type string, start int, end int, score double")


def merge_chunks(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Predictions of overlapping chunks, merged: by start, one of the type of the last kept and overlapping it by over half of the shorter
    joins it, with the higher score and both bounds."""
    kind = "array<struct<start:int,end:int,type:string,score:double>>"
    rows = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "type", "score"))).alias("all"))

    def step(acc, x):
        last = F.element_at(acc, -1)
        common = F.least(last["end"], x["end"]) - x["start"]
        short = F.least(last["end"] - last["start"], x["end"] - x["start"])
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["type"].alias("type"), F.greatest(last["score"], x["score"]).alias("score"))
        return F.when(F.size(acc) == 0, F.array(x)).when((last["type"] == x["type"]) & (common * 2 > short), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), joined)).otherwise(F.array_append(acc, x))

    walked = F.aggregate("all", F.array().cast(kind), step)
    return rows.select(id_col, F.explode(walked).alias("e")).select(id_col, "e.type", "e.start", "e.end", "e.score")

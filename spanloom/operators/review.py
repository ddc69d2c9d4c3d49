"""Review of entities and batches of files: filters, states and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(found: DataFrame, types: list[str] | None = None, flagged: bool | None = None, least: float | None = None, text: str | None = None) -> DataFrame:
    """Entities that pass all given filters; text is looked for in the text and its replacement, in either case."""
    if types:
        found = found.where(F.col("type").isin(*types))
    if flagged is not None:
        found = found.where((F.col("confidence") < 0.6) == F.lit(flagged))
    if least is not None:
        found = found.where(F.col("confidence") >= least)
    if text:
        found = found.where(F.contains(F.lower("text"), F.lit(text.lower())))
    return found


def decided(found: DataFrame, actions: DataFrame) -> DataFrame:
    """found with status: the latest action (doc_id, entity_id, ts, status) on each entity, else pending."""
    last = actions.groupBy("doc_id", "entity_id").agg(F.max_by("status", "ts").alias("status"))
    return found.join(last, ["doc_id", "entity_id"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def review_result(rows: DataFrame) -> DataFrame:
    """Of each document the counts by status, and the texts to be replaced."""
    use = F.col("status").isin("approved", "edited")
    return rows.groupBy("doc_id").agg(F.count_if(use).alias("approved"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("status") == "pending").alias("pending"), F.array_join(F.array_sort(F.collect_set(F.when(use, F.col("text")))), "|").alias("texts"))


def manual_replacements(marked: DataFrame) -> DataFrame:
    """marked with replacement TYPE_MANUAL_n, numbered by type in the order of the start."""
    n = F.expr("row_number() over (partition by doc_id, type order by start, entity_id)")
    return marked.withColumn("replacement", F.concat_ws("_", "type", F.lit("MANUAL"), n.cast("string")))


def without_frontmatter(found: DataFrame, text: Column) -> DataFrame:
    """found without spans that begin in the front matter of text."""
    head = F.length(F.regexp_extract(text, r"\A---\n(?s:.*?)\n---\n", 0))
    return found.where(F.col("start") >= head)


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The common part of two spans, of the shorter; 0 where one is empty."""
    short = F.least(e1 - s1, e2 - s2)
    return F.when(short <= 0, 0.0).otherwise(F.round(F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2)) / short, 6))


def merge_detectors(regex: DataFrame, model: DataFrame) -> DataFrame:
    """Entities of two detectors: a regex entity that a model's overlaps is BOTH, 1.1 times as sure as the surer, at most 1; the others stay, of the model's those that no regex entity overlaps."""
    m = model.select(F.col("doc_id").alias("md"), F.col("start").alias("ms"), F.col("end").alias("me"), F.col("confidence").alias("mc"))
    on = (F.col("doc_id") == F.col("md")) & (F.col("start") < F.col("me")) & (F.col("ms") < F.col("end"))
    best = regex.join(m, on).groupBy("doc_id", "entity_id").agg(F.max("mc").alias("mc"))
    both = regex.join(best, ["doc_id", "entity_id"], "left")
    both = both.withColumns({"source": F.when(F.col("mc").isNotNull(), "BOTH").otherwise(F.col("source")), "confidence": F.round(F.when(F.col("mc").isNotNull(), F.least(F.lit(1.0), F.greatest("mc", "confidence") * 1.1)).otherwise(F.col("confidence")), 6)}).drop("mc")
    r = regex.select(F.col("doc_id").alias("rd"), F.col("start").alias("rs"), F.col("end").alias("re"))
    alone = model.join(r, (F.col("doc_id") == F.col("rd")) & (F.col("start") < F.col("re")) & (F.col("rs") < F.col("end")), "left_anti")
    return both.unionByName(alone.select(both.columns))


def batch_states(files: DataFrame) -> DataFrame:
    """Counts of files (status) by state, and the percentage that is done."""
    done = F.col("status").isin("completed", "failed", "cancelled")
    return files.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed", "failed", "cancelled")], F.coalesce(F.round(F.try_divide(100 * F.count_if(done), F.count("*")), 2), F.lit(0.0)).alias("percent"))


def failures(rates: DataFrame, least_precision: float, least_recall: float) -> DataFrame:
    """Types whose precision or recall doesn't reach its threshold, with which."""
    rows = rates.select("type", F.array_compact(F.array(F.when(F.col("precision") < least_precision, "precision"), F.when(F.col("recall") < least_recall, "recall"))).alias("f"))
    return rows.where(F.size("f") > 0).select("type", F.array_join("f", ",").alias("failed"))


# Messages of errors that a retry may mend.
RETRYABLE = r"(?i)timeout|timed out|network|econnreset|temporar|busy|out of memory|overloaded"


def retry_delay(attempt: Column, message: Column) -> Column:
    """Milliseconds to wait before attempt 1, 2 or 3: 100, doubled each time, 5,000 at most; null for other attempts and errors that stay."""
    wait = F.least(F.lit(5000), F.lit(100) * F.pow(F.lit(2), attempt - 1)).cast("int")
    return F.when(attempt.between(1, 3) & message.rlike(RETRYABLE), wait)


def timeout_ms(size: Column) -> Column:
    """Thirty seconds and ten for each megabyte, between ten seconds and ten minutes."""
    return F.greatest(F.lit(10_000), F.least(F.lit(600_000), 30_000 + F.ceil(size / 1048576) * 10_000)).cast("int")


def readable_size(size: Column) -> Column:
    """Bytes as B, KB or MB, these with one decimal; halves of it go to the even one, which a format alone would raise. Null: null."""
    shown = lambda unit: F.format_string("%.1f", F.bround(size / unit, 1))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1048576, F.concat(shown(1024), F.lit(" KB"))).when(size.isNotNull(), F.concat(shown(1048576), F.lit(" MB")))


def ui_language(locale: Column) -> Column:
    """The two letters of a locale, if they are a language with texts; else en."""
    code = F.lower(F.substring(locale, 1, 2))
    return F.when(code.isin("en", "fr", "de"), code).otherwise("en")


def input_warnings(text: Column) -> Column:
    """What speaks against giving a text to a model: empty, too short or long, replacement or control characters."""
    controls = F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    checks = [(text.isNull() | (F.btrim(text) == ""), "empty"), (F.length(text) > 100_000, "too long"), (F.contains(text, F.lit("�")), "replacement characters"), ((controls > 10) | (controls > F.length(text) * 0.1), "control characters")]
    return F.array_join(F.array_compact(F.array(*[F.when(c, name) for c, name in checks])), ",")

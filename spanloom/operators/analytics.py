"""Analytics of corrections, metrics and detection quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import text_key

MOST_PATTERNS, MOST_CONTEXTS = 20, 3


def share(part: Column, whole: Column) -> Column:
    """part of whole, rounded; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, 6))


def correction_summary(log: DataFrame) -> DataFrame:
    """Counts of a log's rows, dismissals, additions and documents, and the rates of the first two; zeros if it is empty."""
    n, gone, added = F.count("*"), F.count_if(F.col("action") == "DISMISS"), F.count_if(F.col("action") == "ADD")
    return log.agg(n.alias("total"), gone.alias("dismissals"), added.alias("additions"), F.count_distinct("document").alias("documents"), share(gone, n).alias("dismissal_rate"), share(added, n).alias("addition_rate"))


def by_type(log: DataFrame) -> DataFrame:
    return log.groupBy("entity_type").agg(F.count_if(F.col("action") == "DISMISS").alias("dismissals"), F.count_if(F.col("action") == "ADD").alias("additions"), F.count("*").alias("total"))


def week_of(ts: Column) -> Column:
    """Calendar year and ISO week; the last days of a year may be in week 1 of that same calendar year."""
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def trend(log: DataFrame, period: Column) -> DataFrame:
    return log.groupBy(period.alias("period")).agg(F.count_if(F.col("action") == "DISMISS").alias("dismissals"), F.count_if(F.col("action") == "ADD").alias("additions"), F.count("*").alias("total"))


def period_bounds(log: DataFrame) -> DataFrame:
    return log.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


def in_range(log: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows from start to end, each an ISO date; bounds that aren't are ignored."""
    for bound, keep in ((start, lambda c, x: c >= x), (end, lambda c, x: c < x + F.expr("interval 1 day"))):
        if bound and len(bound) == 10 and bound[4] == bound[7] == "-" and bound.replace("-", "").isdigit():
            log = log.where(keep(F.col("ts"), F.lit(bound).cast("timestamp")))
    return log


def frequent_patterns(log: DataFrame, least: int = 2, most: int = MOST_PATTERNS) -> DataFrame:
    """The most frequent (pattern, type) pairs: counts, confidence summed over those that have one and divided by all, sources, first and last.
    The top ones alone reach the driver's side of the plan."""
    rows = log.withColumn("pattern", text_key(F.col("text"))).groupBy("pattern", "entity_type")
    found = rows.agg(F.count("*").alias("n"), F.sum("confidence").alias("s"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    found = found.where(F.col("n") >= least).withColumn("confidence", F.when(F.col("s") > 0, F.round(F.col("s") / F.col("n"), 6))).drop("s")
    return found.orderBy(F.desc("n"), "pattern", "entity_type").limit(most)


def retained(log: DataFrame, now: Column, days: int = 90, most: int = 1000) -> DataFrame:
    """Rows not older than days, and of those the newest of each month's file, so many at most."""
    young = log.where(F.col("ts") >= now - F.expr(f"interval {days} days"))
    rank = F.row_number().over(Window.partitionBy(month_of(F.col("ts"))).orderBy(F.desc("ts"), F.desc("id")))
    return young.withColumn("__n", rank).where(F.col("__n") <= most).drop("__n")


def capped_scan(log: DataFrame, files: int = 60, per_file: int = 500) -> DataFrame:
    """Rows of the newest month files, and of each the first so many."""
    rows = log.withColumn("month", month_of(F.col("ts")))
    newest = rows.select("month").distinct().orderBy(F.desc("month")).limit(files)
    rank = F.row_number().over(Window.partitionBy("month").orderBy("ts", "id"))
    return rows.join(F.broadcast(newest), "month", "left_semi").withColumn("__n", rank).where(F.col("__n") <= per_file).drop("__n")


def latency_metrics(rows: DataFrame) -> DataFrame:
    """rows (duration, kind, lang) as nearest-rank percentiles and means, over all, by kind and by language."""
    rows = rows.select("duration", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("lang", F.lit("unknown")).alias("lang"))
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by duration)")
    found = rows.groupingSets([[], [F.col("kind")], [F.col("lang")]], F.col("kind"), F.col("lang"))
    return found.agg(F.count("*").alias("n"), F.round(F.avg("duration"), 6).alias("mean"), F.min("duration").alias("least"), F.max("duration").alias("most"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def precision_recall(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """By type: true positives (equal keys, one to one by occurrence), false positives and negatives, precision, recall and F1."""
    numbered = lambda df: df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("start")))
    a = numbered(found).select(*keys, "__n", F.lit(1).alias("a"))
    b = numbered(expected).select(*keys, "__n", F.lit(1).alias("b"))
    both = a.join(b, [*keys, "__n"], "full_outer").groupBy("type")
    rows = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("tp"), F.count_if(F.col("b").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    return with_rates(rows)


def with_rates(rows: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


# Signs that make a spreadsheet take a cell for a formula.
FORMULA = r"^[=+\-@\t\r]"


def csv_cell(c: Column) -> Column:
    """A cell of a CSV file: formulas are quoted as text, and quotes are doubled where quotes, commas or line ends are in it."""
    safe = F.when(c.rlike(FORMULA), F.concat(F.lit("'"), c)).otherwise(c)
    return F.when(c.rlike(FORMULA) | safe.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)

"""Layout of positioned text: lines, headings, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE, SPACE = 5.0, 2.0


def lines_of(items: DataFrame) -> DataFrame:
    """items (page_id, item_id, str, x, y, width) as text lines (page_id, line, text): from top to bottom, an item more than LINE below the one before it
    begins a line; in a line from left to right, with a space where the gap is over SPACE."""
    top = Window.partitionBy("page_id").orderBy(F.desc("y"), "x", "item_id")
    rows = items.withColumn("new", F.when(F.lag("y").over(top) - F.col("y") <= LINE, 0).otherwise(1))
    rows = rows.withColumn("line", F.sum("new").over(top.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    along = Window.partitionBy("page_id", "line").orderBy("x", "item_id")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(along)
    rows = rows.withColumn("piece", F.concat(F.when(gap > SPACE, " ").otherwise(""), F.col("str")))
    return rows.groupBy("page_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "item_id", "piece"))), lambda s: s["piece"]), "").alias("text"))


def is_heading(line: Column, after: Column) -> Column:
    """A line of 10 to 100 characters in capitals with two words or more, or numbered, before a blank line, that is no address, date, number or name."""
    caps = (line == F.upper(line)) & line.rlike("[A-Z]") & (F.size(F.split(line, r"\s+")) >= 2)
    other = line.rlike(r"@|\+?\d{2,}[\s.-]?\d{2,}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|^[-=_*]{3,}$|^\d{4,5}\s+[A-Z]|^[A-Z][a-zà-ÿ]+\s+[A-Z][a-zà-ÿ]+(\s+[A-Z][a-zà-ÿ]+)?$")
    return F.length(line).between(10, 100) & ~other & (caps | line.rlike(r"^\d+(?:\.\d+)*\.?\s+[A-Z]")) & (F.coalesce(after, F.lit("")) == "")


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, position, line) of the lines that look like headings."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("position", "line")).withColumn("line", F.btrim("line"))
    w = Window.partitionBy("doc_id").orderBy("position")
    return rows.withColumn("after", F.lead("line").over(w)).where(is_heading(F.col("line"), F.col("after"))).select("doc_id", "position", "line")


def detect_tables(items: DataFrame, tolerance: float = 5.0, least: int = 2) -> DataFrame:
    """(page_id, rows, columns, cells, confidence) of a borderless table on each page: left edges and heights are clustered by gaps over tolerance, clusters of least items or more
    are columns and rows, and each item falls into the cell of its clusters. Pages of one column or row have none; nor do pages of running text
    (cells of over 40 characters on average with more than half of them sentences)."""

    def clustered(rows: DataFrame, by: Column, name: str) -> DataFrame:
        w = Window.partitionBy("page_id").orderBy(by, "item_id")
        rows = rows.withColumn("__v", by)
        rows = rows.withColumn("__new", F.when(F.col("__v") - F.lag("__v").over(w) <= tolerance, 0).otherwise(1))
        rows = rows.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return rows.withColumn(f"{name}_n", F.count("*").over(Window.partitionBy("page_id", name))).drop("__v", "__new")

    rows = clustered(clustered(items, -F.col("y"), "row"), F.col("x"), "col").where((F.col("row_n") >= least) & (F.col("col_n") >= least))
    cells = rows.groupBy("page_id", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "item_id", "str"))), lambda s: s["str"]), " ").alias("text"))
    found = cells.groupBy("page_id").agg(F.count_distinct("row").alias("rows"), F.count_distinct("col").alias("columns"), F.count("*").alias("cells"), F.avg(F.length("text")).alias("mean"), F.avg(F.when(F.col("text").rlike("[.,]"), 1).otherwise(0)).alias("prose"), F.avg(F.when(F.length(F.regexp_replace("text", "[^0-9]", "")) > F.length("text") * 0.6, 1).otherwise(0)).alias("numeric"))
    found = found.where((F.col("rows") >= 2) & (F.col("columns") >= 2) & ~((F.col("mean") > 40) & (F.col("prose") > 0.5)))
    full = F.col("cells") / (F.col("rows") * F.col("columns"))
    sure = 0.65 + F.when(F.col("rows") >= 3, 0.08).otherwise(0.0) + F.when(F.col("columns") >= 3, 0.08).otherwise(0.0) + F.when(full > 0.8, 0.1).otherwise(0.0) + F.when(F.col("numeric") > 0.3, 0.05).otherwise(0.0)
    return found.select("page_id", "rows", "columns", "cells", F.round(F.least(F.lit(1.0), sure), 4).alias("confidence"))


# What a letter's page holds.
DATED, REFERRED = r"(?i)\b(?:Date|Datum)\b|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}", r"(?i)\b(?:référence|Referenz|reference|Réf|Ref|Notre\s+référence)\b"
SALUTED = r"(?i)\b(?:Mesdames|Messieurs|Madame|Monsieur|Sehr geehrte|Dear)\b"
LEAST_ITEMS, LEAST_WIDTH, QUARTER, EDGE, LEAST_COLUMN = 20, 200.0, 0.25, 10.0, 5


def page_layouts(items: DataFrame) -> DataFrame:
    """(page_id, letter, columns, split) of pages of items (page_id, item_id, str, x). A letter has LEAST_ITEMS items, a page wider than LEAST_WIDTH, between a tenth and 35 % of its items in the
    left quarter, a date or reference, and a salutation. Two columns part 20 before the edge, by tens, at which most items begin, over 50 from the left; each has LEAST_COLUMN
    items or more. Pages are aggregates; nothing of a page is gathered but counts by edge."""
    from spanloom.functions.regex import spark_regex

    has = lambda p: F.max(F.col("str").rlike(spark_regex(p.replace("(?i)", ""), fold=True)))
    page = items.groupBy("page_id").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), has(DATED).alias("dated"), has(REFERRED).alias("referred"), has(SALUTED).alias("saluted"))
    wide = F.col("high") - F.col("low") >= LEAST_WIDTH
    edges = items.join(page.where(wide).select("page_id", "low"), "page_id").withColumn("edge", F.floor(F.col("x") / EDGE + 0.5) * EDGE)
    edges = edges.where(F.col("edge") > F.col("low") + 50).groupBy("page_id", "edge").agg(F.count("*").alias("m"), F.min("item_id").alias("first"))
    main = edges.groupBy("page_id").agg(F.max_by("edge", F.struct("m", -F.col("first"))).alias("edge"))
    rows = page.join(main, "page_id", "left").withColumn("split", F.when(wide, F.coalesce(F.col("edge"), F.col("low")) - 20))
    left = items.join(rows.select("page_id", "low", "high", "split"), "page_id").groupBy("page_id").agg(F.count(F.when(F.col("x") < F.col("low") + (F.col("high") - F.col("low")) * QUARTER, 1)).alias("quarter"), F.count(F.when(F.col("x") < F.col("split"), 1)).alias("side"))
    rows = rows.join(left, "page_id")
    share = F.col("quarter") / F.col("n")
    letter = (F.col("n") >= LEAST_ITEMS) & wide & (share > 0.1) & (share < 0.35) & (F.col("dated") | F.col("referred")) & F.col("saluted")
    two = wide & (F.col("side") >= LEAST_COLUMN) & (F.col("n") - F.col("side") >= LEAST_COLUMN)
    return rows.select("page_id", letter.alias("letter"), F.when(two, 2).otherwise(1).alias("columns"), F.when(two, F.col("split")).alias("split"))


def raw_text(items: DataFrame) -> DataFrame:
    """(page_id, text): items in their order, with a line's end where the height changes and a space elsewhere."""
    w = Window.partitionBy("page_id").orderBy("item_id")
    before = F.lag("y").over(w)
    rows = items.withColumn("piece", F.concat(F.when(before.isNull(), "").when(before != F.col("y"), "\n").otherwise(" "), F.col("str")))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "piece"))), lambda s: s["piece"]), "").alias("text"))

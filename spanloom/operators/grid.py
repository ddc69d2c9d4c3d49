"""Bordered tables: lines of positioned items, the cells of their grid, the choice among detections, and merging over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Y_NEAR, X_NEAR, LEAST = 2.0, 3.0, 2
#: Confidence of a grid, what regular lines and a header add, and from where a table is accepted, or accepted with a warning.
BASE, REGULAR, HEADED, ACCEPT, WARN = 0.7, 0.1, 0.05, 0.7, 0.5
#: Mean gap of columns, share of numbers, and lead in confidence that speak for a borderless table.
WIDE, NUMBERS, LEAD = 50.0, 0.3, 0.1


def first_fit(values: Column, near: float) -> Column:
    """The lines of values, an array in the order of the items: a value joins the first line within near of it, or begins one; lines of LEAST values or more."""
    lines = F.array().cast("array<struct<at:double,n:int>>")

    def step(acc: Column, v: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda x: F.abs(v - x["at"]) <= near), True).cast("int")
        more = F.transform(acc, lambda x, i: F.struct(x["at"].alias("at"), (x["n"] + F.when(i == at - 1, 1).otherwise(0)).alias("n")))
        return F.when(at == 0, F.array_append(acc, F.struct(v.alias("at"), F.lit(1).alias("n")))).otherwise(more)

    return F.transform(F.filter(F.aggregate(values, lines, step), lambda x: x["n"] >= LEAST), lambda x: x["at"])


def grid_lines(items: DataFrame) -> DataFrame:
    """(page_id, ys, xs) of items (page_id, item_id, x, y): horizontal lines from the top, vertical ones from the left. A page's items are one row."""
    each = F.array_sort(F.collect_list(F.struct("item_id", "x", "y")))
    rows = items.groupBy("page_id").agg(each.alias("i"))
    ys, xs = first_fit(F.col("i.y"), Y_NEAR), first_fit(F.col("i.x"), X_NEAR)
    return rows.select("page_id", F.sort_array(ys, asc=False).alias("ys"), F.sort_array(xs).alias("xs"))


def is_numeric(content: Column) -> Column:
    """Over six tenths of the signs, but $, commas and spaces, are digits."""
    clean = F.regexp_replace(content, r"[$,\s]", "")
    return F.length(F.regexp_replace(clean, r"[^0-9]", "")) > F.length(clean) * 0.6


def cells(items: DataFrame) -> DataFrame:
    """(page_id, row, col, content, alignment, header): the cells of each page's grid, empty ones too. An item (page_id, item_id, x, y, str, font) falls into the cells whose
    lines are near it; the first row is the header, as are rows most of whose items are bold."""
    lines = grid_lines(items).where((F.size("ys") >= LEAST) & (F.size("xs") >= LEAST))
    rows = lines.select("page_id", "xs", F.posexplode("ys").alias("row", "cy"))
    grid = rows.select("page_id", "row", "cy", F.posexplode("xs").alias("col", "cx"))
    own = items.select(F.col("page_id").alias("p"), "item_id", "x", "y", "str", F.coalesce(F.contains(F.lower("font"), F.lit("bold")), F.lit(False)).alias("bold"))
    near_y = (F.col("page_id") == F.col("p")) & (F.abs(F.col("y") - F.col("cy")) <= Y_NEAR)
    bold = rows.join(own, near_y).groupBy("page_id", "row").agg((F.count(F.when(F.col("bold"), 1)) > F.count("*") / 2).alias("bold_row"))
    found = grid.join(own, near_y & (F.abs(F.col("x") - F.col("cx")) <= X_NEAR), "left")
    found = found.groupBy("page_id", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "str"))), lambda s: s["str"]), " ").alias("content"))
    found = found.join(bold, ["page_id", "row"], "left")
    return found.select("page_id", "row", "col", "content", F.when(is_numeric(F.col("content")), "right").otherwise("left").alias("alignment"), ((F.col("row") == 0) | F.coalesce("bold_row", F.lit(False))).alias("header"))


def _regular(lines: Column) -> Column:
    """Three lines or more, whose spacings differ from their mean by less than a fifth of it, on average."""
    gaps = F.transform(F.sequence(F.lit(1), F.size(lines) - 1), lambda i: F.abs(F.get(lines, i) - F.get(lines, i - 1)))
    mean = F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g) / F.size(gaps)
    off = F.aggregate(gaps, F.lit(0.0), lambda a, g: a + F.abs(g - mean)) / F.size(gaps)
    return F.when(F.size(lines) >= 3, off < mean * 0.2).otherwise(False)


def lattice(items: DataFrame) -> DataFrame:
    """(page_id, rows, columns, confidence) of each page's bordered table; pages of running text (cells of over 40 signs on average, over half of them with a full stop or a
    comma) have none."""
    lines = grid_lines(items).where((F.size("ys") >= LEAST) & (F.size("xs") >= LEAST))
    sure = BASE + F.when(_regular(F.col("ys")), REGULAR).otherwise(0.0) + F.when(_regular(F.col("xs")), REGULAR).otherwise(0.0) + HEADED
    text = cells(items).groupBy("page_id").agg(F.avg(F.length("content")).alias("mean"), F.avg(F.when(F.col("content").rlike("[.,]"), 1.0).otherwise(0.0)).alias("prose"))
    found = lines.join(text, "page_id").where(~((F.col("mean") > 40) & (F.col("prose") > 0.5)))
    return found.select("page_id", F.size("ys").alias("rows"), F.size("xs").alias("columns"), F.round(F.least(F.lit(1.0), sure), 4).alias("confidence"))


def page_shape(items: DataFrame) -> DataFrame:
    """(page_id, gap, numeric): the mean positive gap between neighbours in a row of items (page_id, item_id, str, x, y, width), rows by tens of y, and the share of numbers."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id", F.floor(F.col("y") / 10)).orderBy("x", "item_id")
    rows = items.withColumn("g", F.col("x") - F.lag(F.col("x") + F.col("width")).over(w))
    some = F.btrim("str") != ""
    return rows.groupBy("page_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("g") > 0, F.col("g"))), F.lit(0.0)), 6).alias("gap"), F.round(F.coalesce(F.avg(F.when(some, F.when(is_numeric(F.col("str")), 1.0).otherwise(0.0))), F.lit(0.0)), 6).alias("numeric"))


def choose(bordered: DataFrame, borderless: DataFrame, shapes: DataFrame) -> DataFrame:
    """(page_id, method, confidence, state): of two detections (page_id, confidence) of each page the one to take: the only accepted one; of two accepted ones the borderless one where
    columns are wide or numbers many, or where it is surer by LEAD. state: accepted, low (from WARN on) or none."""
    a, b = bordered.select("page_id", F.col("confidence").alias("a")), borderless.select("page_id", F.col("confidence").alias("b"))
    rows = shapes.join(a, "page_id", "left").join(b, "page_id", "left").withColumns({"a": F.coalesce("a", F.lit(0.0)), "b": F.coalesce("b", F.lit(0.0))})
    both = (F.col("a") >= ACCEPT) & (F.col("b") >= ACCEPT)
    stream = F.when(both, (F.col("gap") > WIDE) | (F.col("numeric") > NUMBERS) | (F.col("b") > F.col("a") + LEAD)).otherwise(F.col("b") >= ACCEPT)
    sure = F.when(stream, F.col("b")).otherwise(F.col("a"))
    state = F.when(sure >= ACCEPT, "accepted").when(sure >= WARN, "low").otherwise("none")
    return rows.select("page_id", F.when(sure < WARN, "none").when(stream, "stream").otherwise("lattice").alias("method"), F.when(sure < WARN, 0.0).otherwise(sure).alias("confidence"), state.alias("state"))


def merge_tables(tables: DataFrame) -> DataFrame:
    """tables (doc_id, table_id, header, rows, x, y, x2, y2, confidence) of a document with equal headers, but for case and outer space, as one: the first's id and header, all rows in
    order, the box around all, the mean confidence."""
    key = F.transform("header", lambda c: F.lower(F.btrim(c)))
    rows = tables.withColumn("__key", key).groupBy("doc_id", "__key")
    ordered = F.array_sort(F.collect_list(F.struct("table_id", "header", "rows")))
    out = rows.agg(ordered.alias("t"), *[f(c).alias(c) for c, f in (("x", F.min), ("y", F.min), ("x2", F.max), ("y2", F.max))], F.round(F.avg("confidence"), 6).alias("confidence"))
    return out.select("doc_id", F.col("t")[0]["table_id"].alias("table_id"), F.col("t")[0]["header"].alias("header"), F.flatten(F.transform("t", lambda x: x["rows"])).alias("rows"), "x", "y", "x2", "y2", "confidence")

"""Line dedup: lines that many sites share are boilerplate; one occurrence of each stays.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bounded, row_key, settled, table

#: A line is boilerplate from so many distinct sites on.
LEAST_SITES = 10
#: Registers of a sketch: two to this power; the standard error is 1.04 / sqrt(registers) = 1.6 %.
LOG_REGISTERS = 12
#: Estimates within this share of the threshold, over ten standard errors, are replaced by exact counts.
NEAR = 0.2
#: Line hashes (16 bytes each) up to which a table of lines is broadcast; beyond, the join shuffles.
MOST_BROADCAST = 500_000
BLANKS = " \t\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_rows(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """A row for each line that isn't blank: two hashes of the trimmed line, its place, its site's hash."""
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.xxhash64(site_col).alias("site"), F.col(site_col).isNotNull().alias("sited"), F.posexplode_outer(_lines(F.col(text_col))).alias("pos", "raw"))
    rows = rows.withColumn("line", F.btrim("raw", F.lit(BLANKS))).where("line <> ''")
    return rows.select("key", "id", "pos", "site", "sited", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def boilerplate_lines(lines: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """(h1, h2): the hashes of lines that stand on least_sites distinct sites or more. lines: (h1, h2, site, sited).

    A line must occur least_sites times, on two sites, to get a sketch at all; that is exact. The sketches, of sites by
    line hash, are merged by aggregation. Near the threshold exact distinct counts of the sites decide, so the result
    is that of exact counting unless an estimate is off by over ten standard errors.
    """
    lines = lines.where("sited").select("h1", "h2", "site")
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("site").alias("a"), F.max("site").alias("b"))
    often = settled(often.where((F.col("n") >= least_sites) & ((F.col("a") != F.col("b")) | F.lit(least_sites <= 1))).select("h1", "h2"), "often")
    some = lines.join(bounded(often, MOST_BROADCAST), ["h1", "h2"], "left_semi")
    sketched = settled(some.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("n_sites")), "sketched")
    near = F.abs(F.col("n_sites") - least_sites) <= max(1.0, NEAR * least_sites)
    exact = lines.join(bounded(sketched.where(near).select("h1", "h2"), MOST_BROADCAST), ["h1", "h2"], "left_semi").distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count("*").alias("n_sites"))
    return sketched.where(~near).unionByName(exact).where(F.col("n_sites") >= least_sites).select("h1", "h2")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", least_sites: int = LEAST_SITES) -> DataFrame:
    """docs with text_col without boilerplate, and n_lines and n_removed (long).

    A boilerplate line's first occurrence, by least id and then place, stays, so that a passage that many sites copied
    isn't lost with its copies; rows with a null id come after all others. Lines are compared without outer white space;
    blank lines are never removed, rows without a site count for no site but lose their boilerplate too. Null text: stays null,
    no lines. Repeated rows are treated alike: each keeps a first occurrence. A document whose lines all go stays,
    with an empty text. An empty table gives no rows. Further columns stay; n_lines, n_removed, __key and __gone are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "__key", "__gone")
    lines = settled(_line_rows(docs, id_col, text_col, site_col), "lines")
    found = settled(boilerplate_lines(lines, least_sites), "boilerplate")
    rows = lines.join(bounded(found, MOST_BROADCAST), ["h1", "h2"]).select("h1", "h2", "key", "id", "pos").distinct()
    rows = settled(rows, "occurrences")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key"), F.col("pos"))
    first = settled(rows.groupBy("h1", "h2").agg(F.min(order).alias("f")), "first")
    gone = rows.join(bounded(first, MOST_BROADCAST), ["h1", "h2"]).where((F.col("key") != F.col("f.key")) | (F.col("pos") != F.col("f.pos")))
    gone = gone.groupBy(F.col("key").alias("__key")).agg(F.array_sort(F.collect_list("pos")).alias("__gone"))
    keyed = docs.withColumn("__key", row_key(id_col, text_col)).join(gone, "__key", "left")
    cut = _lines(F.col(text_col))
    # what stands between two lines that go, so that a long text is copied once
    between = F.zip_with(F.concat(F.array(F.lit(-1)), "__gone"), F.concat("__gone", F.array(F.size(cut))), lambda a, b: F.slice(cut, a + 2, b - a - 1))
    kept = F.flatten(between)
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(cut)).cast("long")
    out = keyed.withColumns({"n_lines": n_lines, "n_removed": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")})
    return out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).drop("__key", "__gone")


def cut_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """docs without boilerplate lines, as dedup_lines() finds them; length_col, if there is one, is the length of what is left where lines went. All other columns stay, whatever
    their names."""
    others = [c for c in docs.columns if c not in (id_col, text_col, site_col)]
    rows = docs.select(id_col, text_col, site_col, F.struct(*others).alias("__rest") if others else F.lit(0).alias("__rest"))
    cut = dedup_lines(rows, id_col, text_col, site_col)

    def kept(name: str) -> Column:
        if name not in others:
            return F.col(name)
        own = F.col("__rest")[name]
        return (F.when(F.col("n_removed") > 0, F.length(text_col).cast(docs.schema[name].dataType)).otherwise(own) if name == length_col else own).alias(name)

    return cut.select(*[kept(c) for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more sources share."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = f"""with l as (select doc_id, source, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
t as (select *, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as line from l),
b as (select line, min((doc_id, pos)) as f from t where line <> '' group by line having count(distinct source) >= {LEAST_SITES}),
k as (select t.*, b.line is not null and f <> (doc_id, pos) as gone from t left join b using (line)),
o as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(raw, chr(10) order by pos) filter (not gone), '') as text from k group by doc_id)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, case when d.text is null then null else o.text end as text
from documents d left join o using (doc_id)"""

"""Operator 5: line dedup by site-relative frequency.

Per host, the pages that hold a line are divided by the host's pages; lines over the ratio are boilerplate and go from
every page of the host. Pages of a host with one and the same text count as one page, above and below the line: copies are
no sign of boilerplate, and which of them stays is decided by near-duplicate detection (``every_page`` counts them one by one). A line of a single page repeats
nothing and is never boilerplate, however small its host.

Lines are counted as 128-bit digests, with map-side combining, so a line of half of all pages is one
small row per task. By pigeonhole a host has at most (its mean lines a page) / ratio boilerplate lines,
so their digests fit in one row per host. That table is written, and Spark broadcasts it only if its
files are small; else it is shuffled, and a hot host's pages are split by adaptive execution.

Defined results: null text is empty and stays null; a null host is a host of its own; the input's other columns are
kept, but ``n_lines`` and ``n_dropped`` of ``line_dedup`` replace columns of those names; an empty table stays empty. Lines
without a character outside ``[\\x20\\x09-\\x0D]`` are never boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import table, written

RATIO = 0.02
FULL_LINE = r"[^\x20\x09-\x0D]"


def _digests(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.unhex(F.md5(x)))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, every_page: bool = False) -> DataFrame:
    """site, drop array<binary>: digests of the lines that exceed the ratio on a site; sites without such lines are left out.

    every_page: copies of a page count one by one, instead of as one page.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(FULL_LINE))
    # An extra null line per page carries the page count through the same aggregation.
    marked = F.concat(F.array(F.lit(None).cast("binary")), F.array_distinct(_digests(lines)))
    pages = docs.select(F.col(host).alias("site"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("page"), marked.alias("lines"))
    if not every_page:
        pages = pages.groupBy("site", "page").agg(F.first("lines").alias("lines"))
    counts = pages.select("site", F.explode("lines").alias("line")).groupBy("site", "line").agg(F.count("*").alias("n"))
    counts = counts.where((F.col("n") > 1) | F.col("line").isNull())
    totals = counts.where(F.col("line").isNull()).select(F.col("site").alias("its_site"), F.col("n").alias("pages"))
    both = counts.where(F.col("line").isNotNull()).join(totals, F.col("site").eqNullSafe(F.col("its_site")))
    return both.where(F.col("n") > ratio * F.col("pages")).groupBy("site").agg(F.collect_list("line").alias("drop"))


def _cleaned(docs: DataFrame, host: str, ratio: float, every_page: bool = False) -> DataFrame:
    """row (the input's columns as a struct), text, n_lines, n_dropped for every row of docs."""
    drops = written(boilerplate(docs, host, ratio, every_page))
    rows = docs.select(F.struct("*").alias("row"))
    both = rows.join(drops, rows[f"row.{host}"].eqNullSafe(drops["site"]), "left")
    lines = F.split(F.coalesce("row.text", F.lit("")), "\n")
    # The digests found in this page are few, so that the test per line is short.
    here = F.when(F.col("drop").isNull(), F.array().cast("array<binary>")).otherwise(F.array_intersect(_digests(lines), F.col("drop")))
    both = both.select("row", here.alias("here"))
    kept = F.when(F.size("here") == 0, lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("here"), F.unhex(F.md5(x)))))
    both = both.select("row", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    dropped = F.col("n_lines") - F.size("kept")
    text = F.when(dropped == 0, F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    return both.select("row", text.alias("text"), "n_lines", dropped.cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = RATIO, every_page: bool = False) -> DataFrame:
    """docs with boilerplate lines taken out of ``text``, plus n_lines and n_dropped. every_page: see ``boilerplate``."""
    own = ("n_lines", "n_dropped")
    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in own]
    return _cleaned(docs, host, ratio, every_page).select(*columns, *own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without boilerplate lines; ``n_chars`` follows the text."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return _cleaned(docs, "source", RATIO).select(*[new[c] if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def stage_sql(source: str) -> str:
    """SQL for the same lines: doc_id, lang and source of the source's rows, with n_lines, n_dropped and the new text."""
    return f"""
select doc_id, lang, source, len(ls) as n_lines, len(ls) - len(ks) as n_dropped,
 case when len(ls) = len(ks) then text else array_to_string(ks, chr(10)) end as text
from (select s.*, string_split(coalesce(s.text, ''), chr(10)) as ls,
  list_filter(string_split(coalesce(s.text, ''), chr(10)), lambda x: not list_contains(coalesce(d.lines, []), x)) as ks
 from {source} s left join (
  select source, list(line) as lines from (
   select source, line, count(*) as n, any_value(pages) as pages from (
    select source, pages, unnest(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) as line
    from (select source, t, count(*) over (partition by source) as pages from (select distinct source, coalesce(text, '') as t from {source})))
   group by all) where n > 1 and n > {RATIO} * pages group by source) d on s.source is not distinct from d.source)"""


SQL = f"select doc_id, cast(n_lines as bigint) as n_lines, cast(n_dropped as bigint) as n_dropped, md5(coalesce(text, '')) as text_md5 from ({stage_sql('documents')})"

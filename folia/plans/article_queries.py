"""Queries over article XML. The given documents are put into articles by a view, so their SQL can name what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.operators import extract as X
from folia.operators import nodes as N
from folia.plans.fixtures import kept, oracle, view

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = oracle(sql)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(N.node_table(view(spark, sf_dir, "fx_article_xml")))


def read_nodes(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Nodes of a view's articles with the columns that extraction reads."""
    return kept(N.node_table(view(spark, sf_dir, name), fields=X.READ))


def rich_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(N.node_table(view(spark, sf_dir, "fx_rich_xml")))


def full_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(N.node_table(view(spark, sf_dir, "fx_full_xml")))


_CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_TITLE = _CLEAN.format("substring(replace(text, chr(10), ' '), 1, 40)")
_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_HTML = "replace(replace(" + _ESC + ", '\"', '&quot;'), '''', '&#x27;')"
_N_TAGS = "35 + len(string_split(text, chr(10)))"
register("a7_xml_nodes", lambda s, d: nodes(s, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("depth").cast("long").alias("deepest"),
    F.count_if(F.col("tag") == "p").alias("paragraphs")), "select doc_id, count(*) as n, 6 as deepest, count(*) filter (where t = '<p>') as paragraphs from (select doc_id, unnest(regexp_extract_all(xml, '<[a-z][a-z-]*[^>]*>')) as t from fx_article_xml) as x group by doc_id")
# A candidate that is cut in its body is well-formed only if the cut lies in the text of an open paragraph.
_KIND = "(roster_idx + c.doc_id) % 4"
_TAIL = "substring(xml, position('<title>One</title><p>' in xml) + 21, 300)"
_LAST_TAG = f"coalesce(regexp_extract_all({_TAIL}, '<[^<>]*>')[-1], '<p>')"
_WHOLE = f"{_LAST_TAG} in ('<p>', '</xref>') and not regexp_matches({_TAIL}, '<[^>]*$') and not regexp_matches({_TAIL}, '&[a-z]*$')"
register(
    "d1_wellformed_check",
    lambda s, d: N.parsed(view(s, d, "fx_candidates").withColumnRenamed("raw_response", "xml").select("doc_id", "roster_idx", "xml")).select("doc_id",
        "roster_idx", "parse_ok", F.regexp_extract(F.coalesce("parse_error", F.lit("")), "text outside the root", 0).alias("outside")),
    f"select c.doc_id, roster_idx, {_KIND} in (0, 2) or {_KIND} = 1 and {_WHOLE} as parse_ok, case when {_KIND} = 3 then 'text outside the root' else '' end as outside from fx_candidates c join fx_article_xml a on a.doc_id = c.doc_id",
)
_DATE = "case when doc_id % 4 = 0 then '5' else '' end || case when doc_id % 2 = 0 then '3' else '' end || (2000 + doc_id % 25)"
_META_TEXT = _CLEAN.format(f"'10.5555/d' || doc_id || substring(replace(text, chr(10), ' '), 1, 40) || 'S' || (doc_id % 50) || 'G' || (doc_id % 7) || 'Inst ' || source || {_DATE} || (doc_id % 30) || 'Short abstract.' || lang || source")
register(
    "f1_node_text", lambda s, d: X.subtree_text(nodes(s, d), F.col("tag") == "article-meta").select("doc_id",
        F.length("text").cast("long").alias("n"), F.md5("text").alias("text")),
    f"select doc_id, length(t) as n, md5(t) as text from (select doc_id, {_META_TEXT} as t from documents) as m",
)
register("f2_first_text", lambda s, d: X.articles(nodes(s, d)).select("doc_id", "title"), f"select doc_id, {_TITLE} as title from documents")
register(
    "f3_article_header", lambda s, d: X.articles(nodes(s, d)),
    f"select doc_id, {_TITLE} as title, '' as translated_title, 'Journal ' || source as journal_title, 'Press ' || lang as publisher, cast(doc_id % 30 as varchar) as volume, '' as issue, '' as fpage, '' as lpage, '' as elocation, '10.5555/d' || doc_id as doi from documents",
)
register("f4_pub_date", lambda s, d: X.pub_date(nodes(s, d)), "select doc_id, case when doc_id % 4 = 0 then '5/' else '' end || case when doc_id % 2 = 0 then '3/' else '' end || (2000 + doc_id % 25) as pub_date from documents")
register("f5_keywords", lambda s, d: X.keywords(nodes(s, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "keyword"),
    "select doc_id, 1 as pos, lang as keyword from documents union all select doc_id, 2, source from documents")
register(
    "f6_authors", lambda s, d: X.authors(nodes(s, d)).select("doc_id", "full", "orcid", "corresponding",
        F.array_join("affiliations", "; ").alias("affiliations"), F.size("emails").cast("long").alias("emails")),
    "select doc_id, 'G' || (doc_id % 7) || ' S' || (doc_id % 50) as \"full\", '' as orcid, doc_id % 3 < 2 as corresponding, 'Inst ' || source as affiliations, 0 as emails from documents",
)
register("e6_author_affiliations", lambda s, d: X.author_affiliations(nodes(s, d)).select("doc_id", F.col("pos").cast("long").alias("pos"),
    "affiliation"), "select doc_id, 1 as pos, 'Inst ' || source as affiliation from documents")
register(
    "e7_author_emails", lambda s, d: X.author_emails(rich_nodes(s, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "email"),
    "select doc_id, 1 as pos, 'm' || (doc_id % 5) || '@x.org' as email from documents union all select doc_id, 2, 'n' || (doc_id % 2) || '@x.org' from documents",
)
register("e8_citation_edges", lambda s, d: X.citations(nodes(s, d)).select("doc_id", F.col("k").cast("long").alias("k"), "rid",
    F.col("ref_pos").cast("long").alias("ref_pos")), "select doc_id, 0 as k, 'r1' as rid, 1 as ref_pos from documents")
register("f7_abstract_paragraphs", lambda s, d: X.abstract_paragraphs(nodes(s, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "html"),
    "select doc_id, 1 as pos, 'Short <em>abstract</em>.' as html from documents")
register(
    "f8_sections", lambda s, d: X.sections(nodes(s, d)).select("doc_id", "id", "label", "title", F.size("paragraphs").cast("long").alias("n"),
        F.md5(F.array_join("paragraphs", "|")).alias("paragraphs")),
    f"""select doc_id, 's1' as id, '' as label, 'One' as title, len(ps) as n, md5(array_to_string(ps, '|')) as paragraphs from (
 select doc_id, list_append(list_filter([trim({_HTML.format('p')}, ' ') for p in string_split(text, chr(10))], lambda p: p <> ''), 'See <a class="citation" href="#r1" data-rid="r1">1</a>.') as ps from documents) as x""",
)
register("f9_section_toc", lambda s, d: X.section_toc(X.sections(nodes(s, d))).select("doc_id", F.col("level").cast("long").alias("level"), "number",
    "shown", "title"), "select doc_id, 1 as level, '1' as number, '1' as shown, 'One' as title from documents")
register(
    "f10_figures", lambda s, d: X.figures(rich_nodes(s, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "id", "label", "caption", "href"),
    "select doc_id, 1 as pos, 'fig-1' as id, 'F' as label, 'Cap & ' || (doc_id % 9) as caption, 'g' || (doc_id % 4) || '.png' as href from documents",
)
register(
    "f11_tables_cells", lambda s, d: X.table_cells(rich_nodes(s, d)).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("row_no", "cell_pos", "doc_pos")], "text"),
    "select doc_id, 1 as row_no, 1 as cell_pos, 2 as doc_pos, 'h' as text from documents union all select doc_id, 1, 2, 1, cast(doc_id % 8 as varchar) from documents union all select doc_id, 2, 1, 1, 'second' from documents",
)
register("f12_references", lambda s, d: X.references(nodes(s, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "id", "label", "html"),
    "select doc_id, 1 as pos, 'r1' as id, '1' as label, 'Ref ' || source as html from documents")
register("f13_inline_html", lambda s, d: (lambda n: X.inline_of(n, n.where(F.col("tag") == "mixed-citation")))(nodes(s, d)).select("doc_id", "html"),
    "select doc_id, '1. Ref ' || source as html from documents")
# Several authors, nested sections, several references.
register(
    "f6_authors_several", lambda s, d: X.authors(full_nodes(s, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "full", "orcid",
        "corresponding", F.array_join("affiliations", "; ").alias("affiliations")),
    """select doc_id, 1 as pos, 'G' || (doc_id % 7) || ' S' || (doc_id % 50) as "full", '' as orcid, doc_id % 3 < 2 as corresponding, 'Inst ' || source as affiliations from documents
 union all select doc_id, 2, 'H T', '0000-000' || (doc_id % 9), false, 'Inst ' || source || '; 2Lab ' || (doc_id % 4) from documents union all select doc_id, 3, 'U', '', false, '' from documents""",
)
register(
    "e6_author_affiliations_shared", lambda s, d: X.author_affiliations(full_nodes(s, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "affiliation"),
    "select doc_id, unnest([1, 1, 2]) as pos, unnest(['Inst ' || source, 'Inst ' || source, '2Lab ' || (doc_id % 4)]) as affiliation from documents",
)
register(
    "e8_citation_edges_several", lambda s, d: X.citations(full_nodes(s, d)).groupBy("doc_id", "rid",
        "ref_pos").agg(F.count("*").alias("n")).select("doc_id", "rid", F.col("ref_pos").cast("long").alias("ref_pos"), "n"),
    "select doc_id, unnest(['r1', 'r2']) as rid, unnest([1, 2]) as ref_pos, unnest([2, 2]) as n from documents",
)
register(
    "f9_section_toc_nested", lambda s, d: X.section_toc(X.sections(full_nodes(s, d))).select("doc_id", F.col("level").cast("long").alias("level"), "number", "shown", "title"),
    "select doc_id, unnest([1, 2, 3, 1]) as level, unnest(['1', '1.1', '1.1.1', '2']) as number, unnest(['1', '1.1', '1.1.1', '7']) as shown, unnest(['One', 'In', 'Deeper', 'Two']) as title from documents",
)
register(
    "f12_references_several", lambda s, d: X.references(full_nodes(s, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "id", "label", "html"),
    "select doc_id, unnest([1, 2, 3]) as pos, unnest(['r1', 'r2', 'r3']) as id, unnest(['1', '2.', '']) as label, unnest(['Ref ' || source, 'Next <em>one</em>', 'Last']) as html from documents",
)
register("f14_serialize_xml", lambda s, d: N.serialize(nodes(s, d)).select("doc_id", F.md5("xml").alias("xml")),
    "select doc_id, md5(replace(xml, '<xref ref-type=\"aff\" rid=\"aff1\"/>', '<xref ref-type=\"aff\" rid=\"aff1\"></xref>')) as xml from fx_article_xml")
register(
    "f21_history_dates", lambda s, d: X.history_dates(rich_nodes(s, d)),
    "select doc_id, 'received' as date_type, '1' as day, cast(1 + doc_id % 12 as varchar) as month, '2019' as year from documents union all select doc_id, 'accepted', null, null, '2020' from documents",
)
_CITED = '<p>See <xref ref-type="table" rid="t1">1</xref>.</p></sec><table-wrap id="t1"><p>A</p></table-wrap><table-wrap id="t2"><p>B</p></table-wrap></body>'
_PLACED = '<p>See <xref ref-type="table" rid="t1">1</xref>.</p><table-wrap id="t1"><p>A</p></table-wrap></sec><sec sec-type="supplementary-material"><title>Supplementary material</title><table-wrap id="t2"><p>B</p></table-wrap></sec></body>'
register(
    "c10_move_orphan_tables", lambda s, d: (lambda x: N.move_orphans(x, kept(N.node_table(x))))(with_loose_tables(s, d)).select("doc_id", F.md5("xml").alias("xml")),
    f"select doc_id, md5(replace(xml, '</sec></body>', '{_PLACED}')) as xml from fx_article_xml",
)


def with_loose_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles with a cited and an uncited table in the body itself."""
    return view(spark, sf_dir, "fx_article_xml").withColumn("xml", F.replace("xml", F.lit("</sec></body>"), F.lit(_CITED)))


# The whole clean-up: every third article has loose tables, every sixth of those is also broken by an open tag.
def _untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = with_loose_tables(spark, sf_dir).select("doc_id", F.col("xml").alias("loose")).join(view(spark, sf_dir, "fx_article_xml"), "doc_id")
    text = F.when(F.col("doc_id") % 3 > 0, F.col("xml")).when(F.col("doc_id") % 18 == 0, F.replace("loose", F.lit("</table-wrap></body>"), F.lit("</body>"))).otherwise(F.col("loose"))
    return xml.select("doc_id", F.concat(F.lit("\ufeff"), F.replace(text, F.lit("</title><p>"), F.lit("</title><break/><p>")), F.lit(" ")).alias("xml"))


_TIDY = f"""select doc_id, case when doc_id % 3 > 0 then xml when doc_id % 18 = 0 then replace(xml, '</sec></body>', '{_CITED[: -len("</table-wrap></body>")]}</body>') else replace(xml, '</sec></body>', '{_PLACED}') end as xml from fx_article_xml"""
register("c11_sanitize_articles", lambda s, d: N.clean_articles(_untidy(s, d), kept).select("doc_id", F.md5("xml").alias("xml")),
    f"select doc_id, md5(xml) as xml from ({_TIDY}) as t")

"""Relational extraction of articles from the node table. Every function takes nodes and returns rows keyed by doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions.text import clean_whitespace, escape_html, strip, strip_ref_number
from folia.functions.xml_tree import HOLDERS, NEAREST
from folia.operators.nodes import contents, enclosed, inline_html

TITLE = "Section "
#: The columns of nodes that the functions of this module read, but for texts of elements outside HOLDERS, which need content.
READ = ("node_id", "end_id", "parent_id", "ordinal", "depth", "sec_level", "text_from", "text_to", "tag", "parent_tag", "grand_tag", "region", *NEAREST, "holder_id", "text", "tail", "attrs", "inner")


def attr(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name], F.lit(""))


_KEPT = ("doc_id", "node_id as top_id", "parent_id", "tag", "parent_tag", "region", *NEAREST, "attrs")


def held_text(nodes: DataFrame, where: Column) -> DataFrame:
    """subtree_text of nodes that are all in HOLDERS: the outermost carry their text, and only those inside others meet them to cut theirs."""
    chosen = nodes.where(where & F.col("tag").isin(*HOLDERS))
    own = F.when(F.col("end_id") == F.col("node_id"), F.col("text")).otherwise(F.col("inner").cast("string"))
    here = chosen.where("end_id = node_id or holder_id < 0").withColumn("text", own).selectExpr(*_KEPT, "text")
    holders = nodes.where("inner is not null").select("doc_id", F.col("node_id").alias("holder_id"), F.col("text_from").alias("_from"), F.col("inner").alias("_inner"))
    cut = F.substring("_inner", F.col("text_from") - F.col("_from") + 1, F.col("text_to") - F.col("text_from")).cast("string")
    deep = chosen.where("end_id > node_id and holder_id >= 0").drop("inner").join(holders, ["doc_id", "holder_id"]).withColumn("text", cut).selectExpr(*_KEPT, "text")
    return here.unionByName(deep).withColumn("text", clean_whitespace(F.coalesce("text", F.lit(""))))


def subtree_text(nodes: DataFrame, where: Column) -> DataFrame:
    """doc_id, top_id, parent_id, tag, parent_tag, region, nearest ancestors, attrs, text of the nodes that meet the condition: all text below them, white space cleaned."""
    chosen = nodes.where(where)
    # A node without children is its own text; the others cut theirs from the document's.
    alone = chosen.where("end_id = node_id").selectExpr(*_KEPT, "text")
    cut = F.substring("content", F.col("text_from") + 1, F.col("text_to") - F.col("text_from")).cast("string")
    wide = chosen.where("end_id > node_id").drop("content").join(contents(nodes), "doc_id").withColumn("text", cut).selectExpr(*_KEPT, "text")
    return alone.unionByName(wide).withColumn("text", clean_whitespace(F.coalesce("text", F.lit(""))))


def first(value: Column, at: Column, where: Column) -> Column:
    return F.min_by(F.when(where, value), F.when(where, at))


def is_in(tags: str, parent: str | None = None, region: str | None = None, grand: str | None = None) -> Column:
    """The element is one of the tags, and its parent, grandparent and part of the article are as named."""
    out = F.col("tag").isin(*tags.split())
    for column, value in (("parent_tag", parent), ("region", region), ("grand_tag", grand)):
        out = out & (F.col(column) == value) if value else out
    return out


#: Field of the article record and the elements that hold it, as (part of the front, element); of several, the first that is there.
HEADER = {
    "title": (("article-meta", "article-title"),),
    "translated_title": (("article-meta", "trans-title"), ("article-meta", "translated-title")),
    "journal_title": (("journal-meta", "journal-title"), ("article-meta", "journal-title")),
    "publisher": (("journal-meta", "publisher-name"), ("article-meta", "publisher-name")),
    "volume": (("article-meta", "volume"),),
    "issue": (("article-meta", "issue"),),
    "fpage": (("article-meta", "fpage"),),
    "lpage": (("article-meta", "lpage"),),
    "elocation": (("article-meta", "elocation-id"),),
    "doi": (("article-meta", "article-id"),),
}


def articles(nodes: DataFrame) -> DataFrame:
    """One row per document with its header fields, '' where missing."""
    tags = sorted({t for places in HEADER.values() for _, t in places})
    texts = held_text(nodes, F.col("region").isin("article-meta", "journal-meta") & F.col("tag").isin(*tags) & ((F.col("tag") != "article-id") | (attr("pub-id-type") == "doi")))
    place = lambda part, tag: is_in(tag, region=part)
    fields = [F.coalesce(*[first(F.col("text"), F.col("top_id"), place(*p)) for p in places], F.lit("")).alias(name) for name, places in HEADER.items()]
    have = texts.groupBy("doc_id").agg(*fields)
    return nodes.where("node_id = 0").select("doc_id").distinct().join(have, "doc_id", "left").fillna("", list(HEADER))


def _dates(nodes: DataFrame, holder: str, region: str | None = None, grand: str | None = None) -> DataFrame:
    parts = held_text(nodes, is_in("day month year", holder, region, grand))
    one = [first(F.col("text"), F.col("top_id"), (F.col("tag") == t) & (F.col("text") != "")).alias(t) for t in ("day", "month", "year")]
    return parts.groupBy("doc_id", "parent_id").agg(*one)


def pub_date(nodes: DataFrame) -> DataFrame:
    """doc_id, pub_date: of the first date that has a year, with month and day as far as they are known."""
    dates = _dates(nodes, "pub-date", region="article-meta").where("year is not null")
    day = F.when(F.col("month").isNotNull(), F.col("day"))
    return dates.groupBy("doc_id").agg(F.min_by(F.concat_ws("/", day, "month", "year"), "parent_id").alias("pub_date"))


def history_dates(nodes: DataFrame) -> DataFrame:
    """doc_id, date_type, day, month, year of every date of the history."""
    kinds = nodes.where(is_in("date", "history")).select("doc_id", F.col("node_id").alias("parent_id"), attr("date-type").alias("date_type"))
    return kinds.join(_dates(nodes, "date", grand="history"), ["doc_id", "parent_id"]).select("doc_id", "date_type", "day", "month", "year")


def keywords(nodes: DataFrame) -> DataFrame:
    """doc_id, pos, lang, keyword in order; blank ones left out."""
    groups = nodes.where(F.col("tag") == "kwd-group").select("doc_id", F.col("node_id").alias("parent_id"), attr("lang").alias("lang"))
    texts = held_text(nodes, is_in("kwd", "kwd-group", "article-meta")).where("text <> ''").join(groups, ["doc_id", "parent_id"])
    return texts.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("top_id")).alias("pos"), "lang", F.col("text").alias("keyword"))


def contributors(nodes: DataFrame) -> DataFrame:
    """The authors' contrib elements, whole rows of nodes."""
    return nodes.where(is_in("contrib", "contrib-group", "article-meta") & (attr("contrib-type") == "author"))


def _inside(rows: DataFrame, nodes: DataFrame, authors: DataFrame, at: str) -> DataFrame:
    return enclosed(rows, nodes, authors, "contrib_id", at=at).withColumnRenamed("top_id", "author")


def author_affiliations(nodes: DataFrame) -> DataFrame:
    """doc_id, author, pos, affiliation: those that an author refers to, in order, else the first one inside the author's element."""
    authors = contributors(nodes)
    texts = held_text(nodes, is_in("aff", region="article-meta")).select("doc_id", F.col("top_id").alias("at"), "tag", "contrib_id", F.col("attrs")["id"].alias("id"), "text")
    named = texts.where("id <> ''").groupBy("doc_id", "id").agg(F.max_by("text", "at").alias("affiliation"))
    refs = _inside(_references_to(nodes, "aff"), nodes, authors, "at")
    hits = refs.join(named, ["doc_id", "id"]).select("doc_id", "author", "at", "affiliation")
    own = _inside(texts, nodes, authors, "at").join(hits.select("doc_id", "author"), ["doc_id", "author"], "left_anti")
    own = own.groupBy("doc_id", "author").agg(F.min("at").alias("at"), F.min_by("text", "at").alias("affiliation")).where("affiliation <> ''")
    every = hits.unionByName(own)
    return every.select("doc_id", "author", F.row_number().over(W.partitionBy("doc_id", "author").orderBy("at")).alias("pos"), "affiliation")


def _references_to(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(is_in("xref") & (attr("ref-type") == kind)).select("doc_id", F.col("node_id").alias("at"), "tag", "contrib_id", F.col("attrs")["rid"].alias("id"))


def author_emails(nodes: DataFrame) -> DataFrame:
    """doc_id, author, pos, email: the author's own, then those of the correspondence notes referred to, each once."""
    authors, corresp = contributors(nodes), is_in("corresp", "author-notes")
    texts = held_text(nodes, is_in("email") | corresp)
    emails = texts.where("tag = 'email' and text <> ''").select("doc_id", F.col("top_id").alias("at"), "tag", "contrib_id", "corresp_id", "text")
    own = _inside(emails, nodes, authors, "at").select("doc_id", "author", F.lit(0).alias("turn"), "at", "text")
    notes = nodes.where(corresp).select("doc_id", F.col("node_id").alias("note"), F.col("attrs")["id"].alias("id"))
    inner = enclosed(emails, nodes, nodes.where(corresp), "corresp_id", at="at").groupBy("doc_id", F.col("top_id").alias("note")).agg(F.min_by("text", "at").alias("inner"))
    whole = texts.where("tag = 'corresp'").select("doc_id", F.col("top_id").alias("note"), F.col("text").alias("whole"))
    values = notes.join(whole, ["doc_id", "note"]).join(inner, ["doc_id", "note"], "left").select("doc_id", "id", F.coalesce("inner", "whole").alias("text")).where("text <> ''")
    refs = _inside(_references_to(nodes, "corresp"), nodes, authors, "at")
    noted = refs.join(values, ["doc_id", "id"]).select("doc_id", "author", F.lit(1).alias("turn"), "at", "text")
    # Own addresses stay as they are; a note's is added only if it is not there yet.
    w = W.partitionBy("doc_id", "author", "text").orderBy("turn", "at")
    every = own.unionByName(noted).withColumn("_n", F.row_number().over(w)).where("turn = 0 or _n = 1")
    return every.select("doc_id", "author", F.row_number().over(W.partitionBy("doc_id", "author").orderBy("turn", "at")).alias("pos"), F.col("text").alias("email"))


def authors(nodes: DataFrame) -> DataFrame:
    """doc_id, author, pos, full, orcid, corresponding, affiliations, emails; nameless authors are left out."""
    people = contributors(nodes)
    child = is_in("surname given-names", "name", grand="contrib") | is_in("collab", "contrib") | (is_in("contrib-id") & (attr("contrib-id-type") == "orcid"))
    texts = held_text(nodes, child).select("doc_id", F.col("top_id").alias("at"), "tag", "contrib_id", "text")
    refs = _references_to(nodes, "corresp").where("id <> ''").select("doc_id", "at", "tag", "contrib_id", F.lit("").alias("text"))
    inner = _inside(texts.unionByName(refs), nodes, people, "at")
    part = lambda t: F.coalesce(first(F.col("text"), F.col("at"), (F.col("tag") == t) & (F.col("text") != "")), F.lit(""))
    names = inner.groupBy("doc_id", "author").agg(part("surname").alias("surname"), part("given-names").alias("given"),
        part("collab").alias("collab"), part("contrib-id").alias("orcid"), F.bool_or(F.col("tag") == "xref").alias("noted"))
    out = people.select("doc_id", F.col("node_id").alias("author"), F.col("attrs").alias("author_attrs")).join(names, ["doc_id", "author"])
    full = F.coalesce(F.nullif("collab", F.lit("")), F.concat_ws(" ", F.nullif("given", F.lit("")), F.nullif("surname", F.lit(""))))
    # Any non-empty corresp attribute marks an author, "no" included.
    corresponding = (F.coalesce(F.col("author_attrs")["corresp"], F.lit("")) != "") | F.coalesce("noted", F.lit(False))
    out = out.select("doc_id", "author", full.alias("full"), "orcid", corresponding.alias("corresponding")).where("full <> ''")
    lists = lambda rows, c: rows.groupBy("doc_id", "author").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]).alias(c + "s"))
    out = out.join(lists(author_affiliations(nodes), "affiliation"), ["doc_id", "author"], "left").join(lists(author_emails(nodes), "email"), ["doc_id", "author"], "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"affiliations": F.coalesce("affiliations", none), "emails": F.coalesce("emails", none)})
    return out.withColumn("pos", F.row_number().over(W.partitionBy("doc_id").orderBy("author")))


def inline_of(nodes: DataFrame, chosen: DataFrame, kind: str = "para_id", inside: bool = False) -> DataFrame:
    """doc_id, top_id, html of the content of the chosen nodes (rows of nodes).

    A node that holds nothing but text is done where it stands; the others are looked up by their nearest element of the kind.
    inside: all chosen nodes are of the kind or inside an element of it, so nodes outside are not looked at.
    """
    plain = chosen.where("end_id = node_id").select("doc_id", F.col("node_id").alias("top_id"), F.trim(escape_html(F.col("text"))).alias("html"))
    # Elements of the kind without children, and not inside another one, are in no other node's content.
    of_kind = F.col("tag") == NEAREST[kind]
    rows = nodes.where((F.col(kind) >= 0) | (of_kind & (F.col("end_id") > F.col("node_id"))) | (F.lit(not inside) & ~of_kind)).drop("content", "inner")
    return plain.unionByName(inline_html(enclosed(rows, nodes, chosen.where("end_id > node_id"), kind), "doc_id"))


def abstract_paragraphs(nodes: DataFrame) -> DataFrame:
    html = inline_of(nodes, nodes.where(is_in("p", "abstract", "article-meta")), inside=True).where("html <> ''")
    return html.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("top_id")).alias("pos"), "html")


def sections(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, end_id, parent_id, depth, sec_level, idx (among its siblings), id, label, title, paragraphs."""
    secs = nodes.where(is_in("sec") & (F.col("sec_level") > 0))
    idx = F.row_number().over(W.partitionBy("doc_id", "parent_id").orderBy("node_id"))
    secs = secs.select("doc_id", "node_id", "end_id", "parent_id", "depth", "sec_level", F.col("attrs")["id"].alias("given"), idx.alias("idx"))
    heads = held_text(nodes, is_in("label title", "sec") & (F.col("sec_level") > 0)).where("text <> ''")
    heads = heads.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(first(F.col("text"), F.col("top_id"),
        F.col("tag") == "label").alias("label"), first(F.col("text"), F.col("top_id"), F.col("tag") == "title").alias("title"))
    paras = nodes.where(is_in("p", "sec") & (F.col("sec_level") > 0))
    # A paragraph of text alone knows its section; the others meet theirs.
    plain, mixed = paras.where("end_id = node_id"), paras.where("end_id > node_id")
    homes = mixed.select("doc_id", F.col("node_id").alias("top_id"), F.col("parent_id").alias("sec"))
    html = plain.select("doc_id", F.col("node_id").alias("top_id"), F.trim(escape_html(F.col("text"))).alias("html"), F.col("parent_id").alias("sec"))
    html = html.unionByName(inline_of(nodes, mixed, inside=True).join(homes, ["doc_id", "top_id"])).where("html <> ''")
    html = html.groupBy("doc_id", F.col("sec").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("top_id", "html"))), lambda x: x["html"]).alias("paragraphs"))
    out = secs.join(heads, ["doc_id", "node_id"], "left").join(html, ["doc_id", "node_id"], "left")
    idx_text = F.col("idx").cast("string")
    return out.select(
        "doc_id", "node_id", "end_id", "parent_id", "depth", "sec_level", "idx", F.coalesce(F.nullif("given", F.lit("")), F.concat(F.lit("sec-"), idx_text)).alias("id"),
        F.coalesce("label", F.lit("")).alias("label"), F.coalesce("title", F.concat(F.lit(TITLE), idx_text)).alias("title"),
            F.coalesce("paragraphs", F.array().cast("array<string>")).alias("paragraphs"),
    )


def section_toc(secs: DataFrame) -> DataFrame:
    """doc_id, node_id, level, number (dotted), id, shown (label or number), title."""
    # Sections only, with those above them: few rows a document.
    up = secs.select("doc_id", F.col("node_id").alias("up"), F.col("end_id").alias("up_end"), F.col("sec_level").alias("up_level"), F.col("idx").alias("up_idx"))
    chain = secs.select("doc_id", "node_id").join(up, "doc_id").where("node_id >= up and node_id <= up_end").groupBy("doc_id",
        "node_id").agg(F.array_sort(F.collect_list(F.struct("up_level", "up_idx"))).alias("chain"))
    number = F.array_join(F.transform("chain", lambda x: x["up_idx"].cast("string")), ".")
    out = secs.join(chain, ["doc_id", "node_id"])
    return out.select("doc_id", "node_id", F.col("sec_level").alias("level"), number.alias("number"), "id", F.coalesce(F.nullif("label", F.lit("")), number).alias("shown"), "title")


def _media(nodes: DataFrame, tag: str, fallback: str) -> DataFrame:
    """doc_id, node_id, end_id, pos, id, label, caption of the elements of a tag in the body."""
    items = nodes.where(is_in(tag, region="body"))
    pos = F.row_number().over(W.partitionBy("doc_id").orderBy("node_id"))
    items = items.select("doc_id", "node_id", "end_id", pos.alias("pos"), F.col("attrs")["id"].alias("given"))
    heads = held_text(nodes, is_in("label caption", tag)).groupBy("doc_id", F.col("parent_id").alias("node_id"))
    heads = heads.agg(first(F.col("text"), F.col("top_id"), F.col("tag") == "label").alias("label"),
        first(F.col("text"), F.col("top_id"), F.col("tag") == "caption").alias("caption"))
    out = items.join(heads, ["doc_id", "node_id"], "left").fillna("", ["label", "caption"])
    return out.withColumn("id", F.coalesce(F.nullif("given", F.lit("")), F.concat(F.lit(fallback), F.col("pos").cast("string")))).drop("given")


def figures(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, pos, id, label, caption, href."""
    items = _media(nodes, "fig", "fig-")
    pictures = nodes.where(is_in("graphic")).select("doc_id", "node_id", "tag", "fig_id", attr("href").alias("href"))
    first_one = enclosed(pictures, nodes, nodes.where(is_in("fig", region="body")), "fig_id").groupBy("doc_id",
        F.col("top_id").alias("first")).agg(F.min_by("href", "node_id").alias("href")).withColumnRenamed("first", "node_id")
    return items.join(first_one, ["doc_id", "node_id"], "left").fillna("", ["href"]).drop("end_id")


def tables(nodes: DataFrame) -> DataFrame:
    return _media(nodes, "table-wrap", "table-").drop("end_id")


def table_cells(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id (of the table-wrap), row_no, cell_pos (headers first), doc_pos, text; rows without cells are left out."""
    wraps = nodes.where(is_in("table-wrap", region="body"))
    grids = nodes.where(is_in("table"))
    grid = enclosed(grids.select("doc_id", "node_id", "tag", "wrap_id"), nodes, wraps, "wrap_id").groupBy("doc_id", "top_id").agg(F.min("node_id").alias("grid"))
    first_grids = grids.join(grid.select("doc_id", F.col("grid").alias("node_id")), ["doc_id", "node_id"], "left_semi")
    lines = nodes.where(is_in("tr"))
    rows = enclosed(lines.select("doc_id", "node_id", "tag", "grid_id"), nodes, first_grids, "grid_id").select("doc_id", F.col("node_id").alias("tr"), F.col("top_id").alias("grid"))
    rows = rows.join(grid.withColumnRenamed("top_id", "node_id"), ["doc_id", "grid"])
    cells = held_text(nodes, is_in("th td") & (F.col("grid_id") >= 0)).select("doc_id", F.col("top_id").alias("at"), "tag", "row_id", "text")
    found = rows.join(enclosed(cells, nodes, lines, "row_id", at="at").withColumnRenamed("top_id", "tr"), ["doc_id", "tr"]).withColumnRenamed("at", "top_id")
    w = W.partitionBy("doc_id", "node_id", "tr")
    return found.select(
        "doc_id", "node_id", F.dense_rank().over(W.partitionBy("doc_id", "node_id").orderBy("tr")).alias("row_no"),
        F.row_number().over(w.orderBy(F.desc(F.col("tag") == "th"), "top_id")).alias("cell_pos"), F.row_number().over(w.orderBy("top_id")).alias("doc_pos"), "text",
    )


def references(nodes: DataFrame) -> DataFrame:
    """doc_id, pos, id, label, html: the citation's content, else the whole reference, without a repeated number."""
    refs = nodes.where(is_in("ref", "ref-list", "back"))
    pos = F.row_number().over(W.partitionBy("doc_id").orderBy("node_id"))
    items = refs.select("doc_id", "node_id", pos.alias("pos"), attr("id").alias("id"))
    labels = held_text(nodes, is_in("label", "ref", grand="ref-list")).groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.min_by("text", "top_id").alias("label"))
    inner = nodes.where(is_in("mixed-citation element-citation", "ref", grand="ref-list"))
    best = inner.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.min_by("node_id", F.struct(F.col("tag") != "mixed-citation", "node_id")).alias("cite"))
    chosen = items.join(best, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.coalesce("cite", "node_id").alias("top_id"))
    targets = nodes.join(chosen.select("doc_id", F.col("top_id").alias("node_id")), ["doc_id", "node_id"], "left_semi")
    # A whole reference is taken without its label, which has a column of its own.
    unlabelled = nodes.withColumn("text", F.when(is_in("label", "ref", grand="ref-list"), "").otherwise(F.col("text")))
    html = chosen.join(inline_of(unlabelled, targets, "ref_id", inside=True), ["doc_id", "top_id"], "left").select("doc_id", "node_id", "html")
    out = items.join(labels, ["doc_id", "node_id"], "left").join(html, ["doc_id", "node_id"], "left").fillna("", ["label", "html"])
    number = F.coalesce(F.nullif("label", F.lit("")), F.col("pos").cast("string"))
    return out.select("doc_id", "pos", "id", "label", strip_ref_number(strip(F.col("html")), number).alias("html"))


def citations(nodes: DataFrame) -> DataFrame:
    """doc_id, xref (node), k, rid, ref_pos: a row per target of an in-text citation; ref_pos is null for one that is not there."""
    marks = nodes.where((F.lower("tag") == "xref") & (F.lower(attr("ref-type")) == "bibr"))
    marks = marks.select("doc_id", F.col("node_id").alias("xref"), F.posexplode(F.split(F.trim(attr("rid")), r"\s+")).alias("k", "rid")).where("rid <> ''")
    refs = references(nodes).where("id <> ''").groupBy("doc_id", F.col("id").alias("rid")).agg(F.min("pos").alias("ref_pos"))
    return marks.join(refs, ["doc_id", "rid"], "left").select("doc_id", "xref", "k", "rid", "ref_pos")

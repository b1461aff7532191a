"""Publication: parts of an article page as HTML strings, and the page. Wording and style come in as options."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.text import doi_url, escape_html, orcid_short, orcid_url
from folia.operators.extract import section_toc

#: Endings of image names and their types.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp"}


@dataclass(frozen=True)
class Words:
    """Headings and labels of a page."""

    keywords: str = "Keywords"
    authors: str = "Authors"
    corresponding: str = "Corresponding author"
    figures: str = "Figures"
    figure: str = "Figure"
    tables: str = "Tables"
    table: str = "Table"
    references: str = "References"
    abstract: str = "Abstract"
    no_abstract: str = "No abstract"
    no_content: str = "No content"
    journal: str = "Journal"
    publisher: str = "Publisher"
    issue: str = "Issue"
    pages: str = "Pages"
    location: str = "Location"
    date: str = "Date"
    style: str = ""


def _panel(title: str, inner: Column, ident: str = "") -> Column:
    head = f'<section class="panel"{f""" id="{ident}" """.rstrip() if ident else ""}><h3>{title}</h3>'
    return F.when(inner != "", F.concat(F.lit(head), inner, F.lit("</section>"))).otherwise("")


def _ordered(df: DataFrame, pos: str, html: Column, *keys: str) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), html.alias("html"))))
    return df.groupBy(*(keys or ("doc_id",))).agg(F.array_join(F.transform(lines, lambda x: x["html"]), "").alias("html"))


def html_keywords(keywords: DataFrame, words: Words = Words()) -> DataFrame:
    items = _ordered(keywords, "pos", F.concat(F.lit("<li>"), escape_html(F.col("keyword")), F.lit("</li>")))
    return items.select("doc_id", _panel(words.keywords, F.concat(F.lit('<ul class="keyword-list">'), "html", F.lit("</ul>"))).alias("html"))


def html_authors(authors: DataFrame, words: Words = Words()) -> DataFrame:
    mark = F.when(F.col("corresponding"), F.lit(f'<span class="author-corresponding">{words.corresponding}</span>')).otherwise("")
    name = F.concat(F.lit('<span class="author-name">'), escape_html(F.col("full")), F.lit("</span>"), mark)
    affs = F.array_join(F.transform("affiliations", escape_html), "; ")
    orcid = F.when(orcid_url(F.col("orcid")).isNotNull(), F.concat(F.lit('<a class="author-orcid" href="'), escape_html(orcid_url(F.col("orcid"))),
        F.lit('">ORCID: '), escape_html(orcid_short(F.col("orcid"))), F.lit("</a>")))
    mails = F.array_join(F.transform("emails", lambda m: F.concat(F.lit('<a class="author-email" href="mailto:'), escape_html(m), F.lit('">'), escape_html(m), F.lit("</a>"))), "")
    body = F.concat(name, F.when(affs != "", F.concat(F.lit('<div class="author-affiliations">'), affs, F.lit("</div>"))).otherwise(""), F.coalesce(orcid, F.lit("")), mails)
    items = _ordered(authors, "pos", F.concat(F.lit('<li class="author">'), body, F.lit("</li>")))
    return items.select("doc_id", _panel(words.authors, F.concat(F.lit('<ul class="author-list">'), "html", F.lit("</ul>"))).alias("html"))


def html_sections(secs: DataFrame) -> DataFrame:
    """doc_id, html: nested sections with headings h2 to h6. A section opens at its node and closes after its last descendant."""
    toc = section_toc(secs).select("doc_id", "node_id", "level", "shown")
    rows = secs.join(toc, ["doc_id", "node_id"])
    heading = F.concat(F.lit("h"), F.least(F.col("level") + 1, F.lit(6)).cast("string"))
    number = F.when(F.col("shown").endswith("."), escape_html(F.col("shown"))).otherwise(F.concat(escape_html(F.col("shown")), F.lit(".")))
    kind = F.concat(F.lit("article-section level-"), F.col("level").cast("string"), F.when(F.col("level") == 1, " main-section").otherwise(" subsection"))
    paras = F.array_join(F.transform("paragraphs", lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "")
    open_ = F.concat(
        F.lit('<section id="'), escape_html(F.col("id")), F.lit('" class="'), kind, F.lit('"><'), heading, F.lit('><span class="section-number">'),
            number, F.lit('</span><span class="section-title">'), escape_html(F.col("title")), F.lit("</span></"), heading, F.lit(">"), paras,
    )
    events = F.array(
        F.struct(F.col("node_id").alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("deep"), open_.alias("s")),
        F.struct(F.col("end_id").alias("at"), F.lit(1).alias("turn"), (-F.col("depth")).alias("deep"), F.lit("</section>").alias("s")),
    )
    flat = rows.select("doc_id", F.inline(events))
    ordered = F.array_sort(F.collect_list(F.struct("at", "turn", "deep", "s")))
    return flat.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "").alias("html"))


def image_embed(figures: DataFrame, images: DataFrame) -> DataFrame:
    """figures with href of a local image replaced by its data (images: name, content); other hrefs stay."""
    local = ~(F.col("href").startswith("data:") | F.col("href").startswith("http")) & (F.col("href") != "")
    ending = F.lower(F.regexp_extract("href", r"([^.]*)$", 1))
    mime = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), ending), F.lit("application/octet-stream"))
    both = figures.join(images.select(F.col("name").alias("href"), F.col("content").alias("_bytes")), "href", "left")
    data = F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.replace(F.base64("_bytes"), F.lit("\r\n"), F.lit("")))
    return both.withColumn("href", F.when(local & F.col("_bytes").isNotNull(), data).otherwise(F.col("href"))).drop("_bytes")


def html_figures(figures: DataFrame, words: Words = Words()) -> DataFrame:
    label, caption = escape_html(F.coalesce(F.nullif("label", F.lit("")), F.lit(words.figure))), escape_html(F.col("caption"))
    picture = F.when(F.col("href") != "", F.concat(F.lit('<img src="'), escape_html(F.col("href")), F.lit('" alt="'),
        F.coalesce(F.nullif(caption, F.lit("")), label), F.lit('" loading="lazy">'))).otherwise("")
    block = F.concat(F.lit('<figure id="'), escape_html(F.col("id")), F.lit('" class="media">'), picture,
        F.lit('<figcaption><span class="media-label">'), label, F.lit("</span> "), caption, F.lit("</figcaption></figure>"))
    return _ordered(figures, "pos", block).select("doc_id", _panel(words.figures, F.col("html"), "figures").alias("html"))


def html_tables(tables: DataFrame, cells: DataFrame, words: Words = Words()) -> DataFrame:
    rows = _ordered(cells, "cell_pos", F.concat(F.lit("<td>"), escape_html(F.col("text")), F.lit("</td>")), "doc_id", "node_id", "row_no")
    grid = _ordered(rows, "row_no", F.concat(F.lit("<tr>"), F.col("html"), F.lit("</tr>")), "doc_id", "node_id").withColumnRenamed("html", "grid")
    both = tables.join(grid, ["doc_id", "node_id"], "left").fillna("", ["grid"])
    label = escape_html(F.coalesce(F.nullif("label", F.lit("")), F.lit(words.table)))
    block = F.concat(F.lit('<figure id="'), escape_html(F.col("id")), F.lit('" class="table-wrap"><figcaption><span class="media-label">'), label,
        F.lit("</span> "), escape_html(F.col("caption")), F.lit("</figcaption><table>"), F.col("grid"), F.lit("</table></figure>"))
    return _ordered(both, "pos", block).select("doc_id", _panel(words.tables, F.col("html"), "tables").alias("html"))


def html_references(references: DataFrame, words: Words = Words()) -> DataFrame:
    ident = F.when(F.col("id") != "", F.concat(F.lit(' id="'), escape_html(F.col("id")), F.lit('"'))).otherwise("")
    items = _ordered(references, "pos", F.concat(F.lit("<li"), ident, F.lit(">"), F.col("html"), F.lit("</li>")))
    return items.select("doc_id", _panel(words.references, F.concat(F.lit('<ol class="reference-list">'), "html", F.lit("</ol>")), "references").alias("html"))


def html_meta(articles: DataFrame, words: Words = Words()) -> DataFrame:
    """doc_id, html: rows for the fields that are there. Needs the header fields and pub_date."""

    def line(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"<li><span>{name}:</span> "), value, F.lit("</li>")))

    e = lambda c: escape_html(F.coalesce(F.col(c), F.lit("")))
    doi = F.when(F.col("doi") != "", F.concat(F.lit('<a href="'), escape_html(doi_url(F.col("doi"))), F.lit('">'), e("doi"), F.lit("</a>"))).otherwise("")
    rows = [line(words.journal, e("journal_title")), line(words.publisher, e("publisher")), line(words.issue, F.concat(e("volume"), e("issue"))),
        line(words.pages, F.concat(e("fpage"), e("lpage"))), line(words.location, e("elocation")), line("DOI", doi), line(words.date, e("pub_date"))]
    return articles.select("doc_id", F.concat(F.lit('<ul class="meta">'), F.array_join(F.array_compact(F.array(*rows)), ""), F.lit("</ul>")).alias("html"))


def html_document(articles: DataFrame, parts: dict[str, DataFrame], words: Words = Words()) -> DataFrame:
    """doc_id, html: the page. parts: meta, authors, keywords, abstract, sections, figures, tables, references as (doc_id, html)."""
    page = articles.select("doc_id", "title")
    for name, part in parts.items():
        page = page.join(part.select("doc_id", F.col("html").alias(name)), "doc_id", "left")
    for name in ("meta", "authors", "keywords", "abstract", "sections", "figures", "tables", "references"):
        page = page.withColumn(name, F.coalesce(name, F.lit(""))) if name in parts else page.withColumn(name, F.lit(""))
    abstract = F.when(F.col("abstract") != "", F.col("abstract")).otherwise(F.lit(f"<p>{words.no_abstract}</p>"))
    body = F.when(F.col("sections") != "", F.col("sections")).otherwise(F.lit(f"<p>{words.no_content}</p>"))
    title = escape_html(F.col("title"))
    html = F.concat(
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), title,
            F.lit(f"</title><style>{words.style}</style></head><body><header><h1>"), title, F.lit("</h1></header>"), F.col("meta"), F.col("authors"),
        F.lit(f'<section id="abstract"><h2>{words.abstract}</h2>'), abstract, F.lit("</section>"), F.col("keywords"), body, F.col("figures"),
            F.col("tables"), F.col("references"), F.lit("</body></html>"),
    )
    return page.select("doc_id", html.alias("html"))

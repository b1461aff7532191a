"""Whole jobs: operators put together. ``keep`` stores rows that are used more than once (a written table or a checkpoint)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.functions.text import fence_extract
from folia.operators import assemble as A
from folia.operators import candidates as E
from folia.operators import extract as X
from folia.operators import manuscripts as M
from folia.operators import nodes as N
from folia.operators import publish as P
from folia.operators import validate as V
from folia.operators.calls import call_model
from folia.operators.settings import apply_journal

Keep = Callable[[DataFrame], DataFrame]


def metadata_job(blocks: DataFrame, template: str, fn: Callable[[str], dict], profile: DataFrame | None, keep: Keep, partitions: int | None = None) -> DataFrame:
    """doc_id, meta, error, missing, gate: head of the text, prompt, call, parse, journal's defaults, required fields."""
    prompts = A.head_context(blocks).select("doc_id", A.render(F.lit(template), text_snippet=F.col("context")).alias("prompt"))
    answers = keep(call_model(prompts, fn, partitions).select("doc_id", F.col("text").alias("response"), "error_class"))
    parsed = M.parse_metadata(answers)
    if profile is not None:
        # The profile is one row; only fields of the metadata take part in the required fields.
        title = apply_journal(parsed.select("doc_id", F.col("meta.journal_title")), profile).select("doc_id", F.col("journal_title").alias("_title"))
        parsed = parsed.join(title, "doc_id").withColumn("meta", F.when(F.col("meta").isNotNull(), F.col("meta").withField("journal_title", F.col("_title")))).drop("_title")
    return M.gate(parsed)


def score_candidates(cands: DataFrame, keep: Keep, version: str = "1.4") -> DataFrame:
    """cands (doc_id, roster_idx, xml) scored with the errors of validation and the audit of their parsed body, ranked."""
    keys = ("doc_id", "roster_idx")
    cands = keep(cands)
    rows = keep(N.node_rows(cands, "xml", *keys, fields=V.READ))
    nodes = rows.where("node_id >= 0").drop("parse_error")
    broken = rows.where("parse_error is not null").select(*keys, F.lit(0).alias("node_id"), F.lit("syntax").alias("rule"), F.col("parse_error").alias("message"))
    errors = V.validate(nodes, version, *keys).unionByName(broken)
    return E.leaderboard(E.score(cands, V.verdicts(cands, errors, *keys), V.body_audit(rows, *keys)))


def generate_job(docs: DataFrame, roster: DataFrame, template: str, fn: Callable[[str, str], dict], keep: Keep, partitions: int | None = None) -> DataFrame:
    """docs (doc_id, text): prompt, fan-out over the roster, call of fn(prompt, label), clean-up, validation, score, rank."""
    prompts = docs.select("doc_id", A.render(F.lit(template), texto_articulo=F.col("text")).alias("prompt"))
    answers = keep(call_model(prompts, fn, partitions, arguments=("prompt", "label"), roster=roster, without=("prompt",)))
    cands = answers.where("error_class is null").withColumn("xml", fence_extract(F.col("text"))).drop("text")
    return score_candidates(N.clean_articles(cands, keep, "xml", "doc_id", "roster_idx"), keep)


def publish_job(nodes: DataFrame, images: DataFrame | None = None, words: P.Words = P.Words()) -> DataFrame:
    """doc_id, html. nodes is read by every part: give a written table."""
    figures = X.figures(nodes)
    if images is not None:
        figures = P.image_embed(figures, images)
    articles = X.articles(nodes).join(X.pub_date(nodes), "doc_id", "left").fillna("", ["pub_date"])
    abstract = X.abstract_paragraphs(nodes).withColumn("html", F.concat(F.lit("<p>"), "html", F.lit("</p>")))
    parts = {
        "meta": P.html_meta(articles, words), "authors": P.html_authors(X.authors(nodes), words), "keywords": P.html_keywords(X.keywords(nodes), words),
        "abstract": P._ordered(abstract, "pos", F.col("html")), "sections": P.html_sections(X.sections(nodes)), "figures": P.html_figures(figures, words),
        "tables": P.html_tables(X.tables(nodes), X.table_cells(nodes), words), "references": P.html_references(X.references(nodes), words),
    }
    return P.html_document(articles, parts, words)


def article_record(nodes: DataFrame) -> DataFrame:
    """doc_id and the article record as one JSON string."""
    articles = X.articles(nodes).join(X.pub_date(nodes), "doc_id", "left")
    lists = {
        "authors": X.authors(nodes).select("doc_id", "pos", F.struct("full", "orcid", "corresponding", "affiliations", "emails").alias("v")),
        "keywords": X.keywords(nodes).select("doc_id", "pos", F.col("keyword").alias("v")),
        "abstract_paragraphs": X.abstract_paragraphs(nodes).select("doc_id", "pos", F.col("html").alias("v")),
        "figures": X.figures(nodes).select("doc_id", "pos", F.struct("id", "label", "caption", "href").alias("v")),
        "references": X.references(nodes).select("doc_id", "pos", F.struct("id", "label", "html").alias("v")),
    }
    for name, rows in lists.items():
        grouped = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias(name))
        articles = articles.join(grouped, "doc_id", "left")
    return articles.select("doc_id", F.to_json(F.struct(*[c for c in articles.columns if c != "doc_id"])).alias("json"))

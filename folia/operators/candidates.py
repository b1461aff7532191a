"""Candidate versions of articles: fan-out, audit, score, rank, pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions.quality import audit_warnings, body_text, lazy_warning, quality_score, short_warning
from folia.functions.text import bound, fence_extract, sanitize_text


MOST_MODELS = 1000


def stated(roster: DataFrame) -> DataFrame:
    """The roster: a stated list of models, of at most ``MOST_MODELS``."""
    if roster.limit(MOST_MODELS + 1).count() > MOST_MODELS:
        raise ValueError(f"a roster has at most {MOST_MODELS} models")
    return roster


def fanout(docs: DataFrame, roster: DataFrame) -> DataFrame:
    """Every document with every entry of the roster."""
    return docs.crossJoin(F.broadcast(stated(roster)))


def clean(cands: DataFrame, column: str = "raw_response") -> DataFrame:
    return cands.withColumn("xml", sanitize_text(fence_extract(F.col(column))))


def score(cands: DataFrame, errors: DataFrame | None = None, audit: DataFrame | None = None) -> DataFrame:
    """cands (doc_id, roster_idx, xml) with warnings, complete, n_errors, score.

    errors: doc_id, roster_idx, n_errors of validation. audit: doc_id, roster_idx, body_text of the parsed body; without it, patterns find the text.
    """
    keys = ["doc_id", "roster_idx"]
    if audit is None:
        out = cands.withColumn("warnings", bound(F.col("xml"), lambda x: audit_warnings(x, body_text(x))))
    else:
        # What the text itself says is found before the join, so that it need not come along.
        judged = audit.select(*keys, short_warning(F.col("body_text")).alias("_short"))
        out = cands.withColumn("_lazy", lazy_warning(F.col("xml"))).join(judged, keys, "left")
        out = out.withColumn("warnings", F.array_compact(F.array("_lazy", "_short"))).drop("_lazy", "_short")
    if errors is not None:
        out = out.join(errors.select(*keys, "n_errors"), keys, "left")
    else:
        out = out.withColumn("n_errors", F.lit(0))
    out = out.withColumn("n_errors", F.coalesce("n_errors", F.lit(0)).cast("int")).withColumn("complete", F.size("warnings") == 0)
    return out.withColumn("score", quality_score(F.col("n_errors"), F.col("complete")))


def leaderboard(scored: DataFrame) -> DataFrame:
    """scored with rank: best score first, ties in the roster's order."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "roster_idx")))


def winners(board: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row of board per document: the first, or the one that overrides (doc_id, roster_idx) name."""
    if overrides is None:
        return board.where("rank = 1").withColumn("overridden", F.lit(False))
    chosen = overrides.select("doc_id", F.col("roster_idx").alias("_chosen"))
    named = board.join(chosen, "doc_id", "left")
    hit = F.coalesce(F.col("_chosen") == F.col("roster_idx"), F.lit(False))
    # An override that names no candidate of the document has no effect.
    best = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(hit), "rank"))
    return named.withColumn("overridden", hit).withColumn("_best", best).where("_best = 1").drop("_best", "_chosen")


def error_report(errors: DataFrame) -> DataFrame:
    """Counts by category, with a total row (category null)."""
    return errors.rollup("category").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def active_providers(configured: DataFrame, local: list[str], registry: list[str]) -> DataFrame:
    """Configured providers and the local ones, that the registry knows."""
    spark = configured.sparkSession
    names = configured.select("provider").union(spark.createDataFrame([(x,) for x in local], "provider string"))
    return names.intersect(spark.createDataFrame([(x,) for x in registry], "provider string"))


def catalog(models: DataFrame, include: str, exclude: str, preferred: str, most: int) -> DataFrame:
    """models (provider, model) that match include and not exclude; per provider the preferred one first, then names descending, at most ``most``."""
    kept = models.where(F.col("model").rlike(include) & ~F.col("model").rlike(exclude)).distinct()
    place = F.row_number().over(W.partitionBy("provider").orderBy(F.desc(F.col("model") == preferred), F.desc("model")))
    return kept.withColumn("place", place).where(F.col("place") <= most)


def pick_version(wanted: Column, known: tuple[str, ...] = ("1.3", "1.4"), default: str = "1.4") -> tuple[Column, Column]:
    """used, fell_back: the wanted grammar version if it is there, else the default."""
    there = F.coalesce(wanted.isin(*known), F.lit(False))
    return F.when(there, wanted).otherwise(default).alias("used"), (~there).alias("fell_back")

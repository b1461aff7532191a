"""Settings kept as an append-only log, and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Field of the journal profile and its key in the settings.
JOURNAL_KEYS = {"title": "default_journal_title", "abbrev_title": "journal_abbrev_title", "journal_id": "journal_publisher_id",
    "publisher": "default_publisher_name", "issn_print": "default_journal_issn", "issn_electronic": "journal_issn_electronic",
    "doi_base": "journal_doi_base", "subject": "journal_subject", "license_url": "journal_license_url", "default_lang": "journal_default_lang"}
#: Field of the profile and the metadata field that it overrides.
OVERRIDES = {"title": "journal_title", "publisher": "publisher_name", "issn_print": "issn", "issn_electronic": "issn_electronic",
    "doi_base": "doi_base", "abbrev_title": "abbrev_journal_title", "journal_id": "journal_id", "license_url": "license_url", "subject": "subject"}


def current_settings(log: DataFrame, *keys: str) -> DataFrame:
    """The latest value per key (and per the columns in keys); a key whose latest entry deletes it is absent."""
    last = F.max_by(F.struct("value", "op"), F.struct("ts", "seq")).alias("last")
    return log.groupBy(*keys, "key").agg(last).where("last.op <> 'delete'").select(*keys, "key", "last.value")


def with_defaults(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """defaults (key, value) with the stored value where there is one that is not empty."""
    stored = settings.select("key", F.col("value").alias("_stored"))
    return defaults.join(stored, "key", "left").select("key", F.coalesce(F.nullif("_stored", F.lit("")), "value").alias("value"))


def journal_profile(settings: DataFrame, *keys: str) -> DataFrame:
    """One row (per the columns in keys) with the ten fields, '' where not set; values trimmed."""
    fields = [F.coalesce(F.max(F.when(F.col("key") == k, F.trim("value"))), F.lit("")).alias(name) for name, k in JOURNAL_KEYS.items()]
    return settings.groupBy(*keys).agg(*fields)


def apply_journal(meta: DataFrame, profile: DataFrame, *keys: str) -> DataFrame:
    """meta with the profile's non-empty fields in place of its own. Without keys the profile is one row."""
    named = profile.select(*keys, *[F.col(p).alias(f"_{p}") for p in OVERRIDES])
    if not keys and named.limit(2).count() != 1:
        raise ValueError("without keys the profile has to be one row")
    both = meta.join(named, list(keys), "left") if keys else meta.crossJoin(F.broadcast(named))
    new = {m: F.coalesce(F.nullif(F.col(f"_{p}"), F.lit("")), F.col(m) if m in meta.columns else F.lit(None).cast("string")) for p, m in OVERRIDES.items()}
    return both.withColumns(new).drop(*[f"_{p}" for p in OVERRIDES])


def backfill(target: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """target, and the rows of legacy whose key target has not."""
    return target.unionByName(legacy.join(target.select(key), key, "left_anti").select(target.columns))

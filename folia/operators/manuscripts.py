"""Admission of manuscripts and metadata responses as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.quality import input_gate, required_missing
from folia.functions.text import json_object_slice

MAX_BYTES = 50 * 1024 * 1024
TOO_LARGE = "too large"
#: First bytes of the accepted formats.
MAGIC = {".docx": b"PK\x03\x04", ".pdf": b"%PDF"}
METADATA = "struct<article_title:string,journal_title:string,publication_date:string,doi:string,roi:string,authors:array<struct<given_names:string,surname:string,email:string,aff_id:string>>,affiliations:array<struct<id:string,institution:string,country:string>>,abstract:string,keywords:array<string>>"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def admit(df: DataFrame, max_bytes: int = MAX_BYTES, magic: dict[str, bytes] = MAGIC) -> DataFrame:
    """df (path, length, content) with reason: null if accepted; size, suffix and first bytes are tested in this order."""
    head = F.substring("content", 1, 4)
    kind = suffix(F.col("path"))
    wrong = F.lit(True)
    for name, first in magic.items():
        wrong = wrong & ~((kind == name) & (head == F.lit(bytearray(first))))
    reason = F.when(F.col("length") > max_bytes, TOO_LARGE).when(~kind.isin(*magic), "wrong type").when(wrong, "content does not match type")
    return df.withColumn("reason", reason)


def parse_metadata(df: DataFrame, column: str = "response") -> DataFrame:
    """df with meta (struct), roi taken as doi where doi is absent, and error with the first 500 characters of what cannot be parsed."""
    sliced = df.withColumn("_json", json_object_slice(F.col(column)))
    valid = F.try_parse_json("_json").isNotNull()
    parsed = sliced.withColumn("_meta", F.when(valid, F.from_json("_json", METADATA)))
    keys = F.json_object_keys("_json")
    doi = F.when(F.array_contains(keys, "doi"), F.col("_meta.doi")).otherwise(F.col("_meta.roi"))
    meta = F.when(valid, F.col("_meta").withField("doi", doi).dropFields("roi"))
    return parsed.withColumn("meta", meta).withColumn("error", F.when(~valid, F.substring("_json", 1, 500))).drop("_json", "_meta")


def gate(df: DataFrame) -> DataFrame:
    """df (meta) with missing and gate."""
    fields = [F.col(f"meta.{n}") for n in ("article_title", "journal_title", "publication_date", "doi")]
    out = df.withColumn("missing", required_missing(*fields, F.size(F.col("meta.authors"))))
    return out.withColumn("gate", input_gate(F.col("missing")))

"""A training-data pipeline over documents: each stage is one operator of folia.llm, and works on all rows that the stage before kept.

Defined results: a null text counts as empty and is rejected by the quality rules, as every text under 50 words is; a null doc_id or source is
a value like any other; rows that repeat id and text are near duplicates of each other, so one of them stays; of equal ids with different texts
each is judged by its own text; columns beyond those of documents go through all stages but the last; an empty table gives no rows and
the last stage's columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folia.llm import decontaminate, line_dedup, repetition, sampled_pieces, simhash
from folia.llm.common import removed, shared_dir, table

STAGES = [
    ("quality rules", repetition.quality_stage),
    ("line dedup", line_dedup.stage),
    ("simhash near-dedup", simhash.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("sentencepiece encoding", sampled_pieces.stage),
]

#: SimHash needs XXH64, the repetition rules a suffix array: not expressible in DuckDB SQL. Tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; between stages the rows are written to the shared folder and read again.

    A stage's input is deleted as soon as its output is written, so two tables are there at once.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

"""Operator 12: exact dedup by content sort, with DataFrame operations only.

A text's key is the text without white space. Sampled splitters range-partition the rows by the first bytes of the key (a
splitter stays small however long the texts are), then by a hash; external sorting inside a partition puts equal keys beside each
other, and the window operator compares every key with its neighbour's in full. The first row of a run of equal keys stays:
the one with the most code points, then with the smallest id.

A key that holds many bytes in all is hot. Bytes per hash, summed with map-side combining, tell the hot keys; their rows are
dealt over several salts, each salt sorts its part, and one representative of each part is sorted and compared in full again.
There are at most ``MAX_HOT`` hot keys by construction, so their list is broadcast. A text is shuffled once; a representative twice.

Defined results: null text is empty, and all empty texts are equal; null ids come after all others; of rows that repeat id and
text one stays; other columns are ignored by ``classes`` and kept by ``unique``; no rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.llm.common import cut, table, written

BLANKS = " \t\n\x0b\x0c\r"
SPLITTER = 64  # bytes of a key that a splitter holds
PART_BYTES = 32 << 20  # bytes of keys in a partition
HOT_BYTES = 64 << 20  # bytes of equal keys from which they are dealt over salts
MAX_HOT = 200_000
MAX_WAYS = 256


def key_of(text: Column) -> Column:
    key = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        key = F.replace(key, F.lit(blank), F.lit(""))
    return key


def _ranked(rows: DataFrame, by: list[str], parts: int) -> DataFrame:
    """rows with rank, keep and total of their run: rows that agree in ``by`` and whose keys are equal in full."""
    runs = W.partitionBy(*by, "key").orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id"))
    whole = runs.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    new = {"rank": F.row_number().over(runs), "keep": F.first("doc_id").over(whole), "total": F.sum("n").over(whole)}
    return rows.repartitionByRange(parts, *by).withColumns(new)


def _classes(docs: DataFrame, hot_bytes: int, carried: Column) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs, and ``carried`` of the rows that stay."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.length(text).alias("n_chars"), key_of(F.col("text")).alias("key"), carried.alias("carried"))
    rows = rows.withColumns({"head": F.substring(F.encode("key", "UTF-8"), 1, SPLITTER), "hash": F.xxhash64("key")})
    sums = cut(rows.groupBy("hash").agg(F.sum(F.octet_length("key").cast("long") + 64).alias("bytes")))
    size = sums.agg(F.sum("bytes")).first()[0] or 0
    parts = max(math.ceil(size / PART_BYTES), spark.sparkContext.defaultParallelism)
    limit = max(hot_bytes, size // MAX_HOT)  # fewer than MAX_HOT keys can be over it
    ways = F.least(F.lit(MAX_WAYS), F.ceil(F.col("bytes") * 4 / limit)).cast("int")
    hot = sums.where(F.col("bytes") > limit).select("hash", ways.alias("ways"))
    rows = rows.withColumn("n", F.lit(1).cast("long"))
    by, any_hot = ["head", "hash"], not hot.isEmpty()
    if any_hot:
        salt = F.when(F.col("ways").isNull(), 0).otherwise(F.expr("cast(pmod(xxhash64(doc_id, n_chars), ways) as int)"))
        rows, by = rows.join(F.broadcast(hot), "hash", "left").withColumn("salt", salt), [*by, "salt"]
    else:
        rows = rows.withColumns({"ways": F.lit(None).cast("int"), "salt": F.lit(0)})
    is_hot = F.col("ways").isNotNull()
    sorted_once = _ranked(rows, by, parts).select(
        "doc_id", "n_chars", "head", "hash", "salt", is_hot.alias("hot"), F.sha2("key", 256).alias("text_sha256"), "rank", "keep", "total",
        F.when(is_hot & (F.col("rank") == 1), F.col("key")).alias("key"), F.when(F.col("rank") == 1, F.col("carried")).alias("carried"),
    )
    sorted_once = cut(sorted_once)
    one = F.col("rank") == 1
    out = ["doc_id", F.col("keep").alias("keep_id"), F.col("total").alias("group_size"), one.alias("kept"), "text_sha256", "carried"]
    few = sorted_once.where(~F.col("hot")).select(*out)
    if not any_hot:
        return few
    # Each salt's first row stands for its run: a few rows of each hot key, with the run's size.
    heads = sorted_once.where(F.col("hot") & one).select("doc_id", "n_chars", "head", "hash", "salt", "text_sha256", "key", F.col("total").alias("n"))
    joined = _ranked(heads, ["head", "hash"], parts).select("text_sha256", "salt", "keep", "total", one.alias("best"))
    many = sorted_once.where("hot").drop("keep", "total").join(written(joined), ["text_sha256", "salt"])
    out[3] = (one & F.col("best")).alias("kept")
    return few.unionByName(many.select(*out))


def classes(docs: DataFrame, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text)."""
    return _classes(docs, hot_bytes, F.lit(None).cast("int")).drop("carried")


def unique(docs: DataFrame, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """The rows of docs that stay, whole: one of each run of equal texts, with all columns of docs."""
    return _classes(docs, hot_bytes, F.struct("*")).where("kept").select("carried.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


SQL = r"""
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by key) as group_size, row_number() over w = 1 as kept, sha256(key) as text_sha256
from (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as key from documents)
window w as (partition by key order by n desc, doc_id nulls last)"""

"""Operator 3: sharding by extendible hashing, with DataFrame operations only.

A row's key is the first 60 bits of the MD5 of its id and text. The directory is indexed by the first
D bits; a bucket of depth d owns 2^(D-d) directory entries. A bucket splits on its next bit only while
its bytes exceed the limit and it holds more than one key, so the shard of a row is the shortest prefix of its key whose
rows fit, or that it has to itself. No shard's prefix begins another's: a key's bits lead to exactly one shard.
Byte sums and key bounds of all prefixes come from one pre-aggregated table of directory cells; if a cell still
exceeds the limit, only its rows go on to further bits. No text is shuffled: rows are keys and sizes.

Defined results: null text has 0 bytes; a row longer than the limit ends alone in its shard (``oversized``);
rows whose 60 bits all agree (exact repeats of id and text) cannot be told apart by hashing: they share
a shard, marked ``oversized`` if it exceeds the limit. Extra columns are ignored; no rows give no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import cut, table

BITS = 60
LIMIT = 1 << 20
SPARE = 3  # directory entries per expected shard, as a power of two
STEP = 8  # bits that a full cell goes on by


def key_bits(*columns: Column) -> Column:
    """The first 60 bits of the MD5 of the columns, null as empty, joined by a colon."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def prefix(key: Column, depth) -> Column:
    """The first depth bits of a key of 60 bits."""
    return F.call_function("shiftright", key, (F.lit(BITS) - depth).cast("int"))


def _sums(cells: DataFrame, *by: Column | str) -> DataFrame:
    return cells.groupBy(*by).agg(F.sum("bytes").alias("bytes"), F.min("least").alias("least"), F.max("most").alias("most"))


def directory(rows: DataFrame, limit: int, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, n_bytes): shards of depth low to high, and the cells (prefix of high bits) that have to split further."""
    single = rows.select(prefix(F.col("key"), F.lit(high)).alias("cell"), F.col("n_bytes").alias("bytes"), F.col("key").alias("least"), F.col("key").alias("most"))
    cells = cut(_sums(single, "cell"))
    splits = (F.col("bytes") > limit) & (F.col("least") < F.col("most"))
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
    levels = _sums(levels, "depth", F.expr(f"shiftright(cell, cast({high} - depth as int))").alias("prefix"))
    # A bucket is made where its parent was split; at depth 0 there is no parent. Buckets of depth low > 0 have split already.
    parents = levels.where(splits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("half"))
    final = levels.where(~splits).select("depth", "prefix", F.col("bytes").alias("shard_bytes"))
    made = final.withColumn("half", F.expr("shiftright(prefix, 1)")).join(parents, ["depth", "half"], "left_semi").drop("half")
    if low == 0:
        made = made.unionByName(final.where(F.col("depth") == 0))
    return made, cells.where(splits)


def keyed_shards(rows: DataFrame, limit: int) -> DataFrame:
    """rows (key, n_bytes, any others) with the shard that each one's key leads to: depth, prefix, shard_bytes."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    todo, low, high, out = rows, 0, min(BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + SPARE)), None
    while True:
        made, full = directory(todo.select("key", "n_bytes"), limit, low, high)
        width = F.expr(f"cast({high} - depth as int)")
        entries = F.sequence(F.call_function("shiftleft", F.col("prefix"), width), F.call_function("shiftleft", F.col("prefix") + 1, width) - 1)
        celled = todo.withColumn("cell", prefix(F.col("key"), F.lit(high)))
        part = celled.join(made.withColumn("cell", F.explode(entries)), "cell").drop("cell")
        out = part if out is None else out.unionByName(part)
        if high == BITS or full.isEmpty():  # cells of all bits hold one key and never split
            return out
        todo, low, high = cut(celled.join(full, "cell", "left_semi").select(rows.columns)), high, min(BITS, high + STEP)


def assign_shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard (bits of the prefix), depth, shard_bytes, oversized for every row of docs (doc_id, text)."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    out = keyed_shards(cut(docs.select("doc_id", size.alias("n_bytes"), key_bits(F.col("doc_id"), F.col("text")).alias("key"))), limit)
    return out.select("doc_id", "n_bytes", _bits().alias("shard"), F.col("depth").cast("long").alias("depth"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


def _bits() -> Column:
    return F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), cast(depth as int), '0')"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Writes every row of docs once under path and returns the shards written: shard, n_rows, shard_bytes.

    The files hold the struct columns ``row`` (the input's columns) and ``shard``, in order of shard; each shard is in one file,
    a file holds several. Parquet's statistics lead a reader of one shard to its row group. Rows meet their shard by key, so
    null and repeated ids are written like any other.
    """
    rows = docs.select(F.struct("*").alias("row"), key_bits(F.col("doc_id"), F.col("text")).alias("key"))
    sizes = cut(rows.select("key", F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes")))
    keys = keyed_shards(sizes, limit).select("key", _bits().alias("shard"), "n_bytes", "shard_bytes")
    places = cut(keys.groupBy("key", "shard", "shard_bytes").agg(F.count("*").alias("n_rows")))
    placed = rows.join(places.select("key", "shard"), "key").drop("key")
    placed.repartitionByRange("shard").sortWithinPartitions("shard").write.parquet(path)
    return places.groupBy("shard").agg(F.sum("n_rows").alias("n_rows"), F.first("shard_bytes").alias("shard_bytes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


SQL = f"""
with k as (select doc_id, cast(strlen(coalesce(text, '')) as bigint) as n_bytes,
  cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15) as bigint) as h from documents),
lv as (select d.d, k.h >> ({BITS} - d.d) as p, sum(n_bytes) as b, sum(n_bytes) > {LIMIT} and min(h) < max(h) as splits from k, range(0, {BITS + 1}) as d(d) group by 1, 2),
sh as (select l.d, l.p, l.b from lv l left join lv u on u.d = l.d - 1 and u.p = l.p >> 1 where not l.splits and (l.d = 0 or u.splits))
select doc_id, n_bytes, case when d = 0 then '' else right(lpad(bin(p), 64, '0'), cast(d as int)) end as shard, cast(d as bigint) as depth,
 cast(b as bigint) as shard_bytes, b > {LIMIT} as oversized
from k join sh on sh.p = k.h >> ({BITS} - sh.d)"""

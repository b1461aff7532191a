"""Streams run to the end over the given events; their SQL is the batch form."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.plans import table_queries as G
from folia.plans.fixtures import oracle, view
from folia.streaming import usage as S

QUERIES: dict = {}
SQL: dict = {}
FILES = 4
LONG = "35 days"  # the rows of the given table come in no order of time


def _drain(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """The usage log in several files, some rows twice, and a closing row in the last; then the stream over them."""
    folder = S.scratch(spark)
    usage = view(spark, sf_dir, "fx_token_usage").withColumn("ts", F.col("ts").cast("timestamp"))
    usage.repartition(FILES, "usage_id").write.parquet(f"{folder}/in")
    closing = S.with_closing_row(usage).where("usage_id = -1")
    closing.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = S.read_usage(spark, f"{folder}/in", per_trigger=2)
    return S.drained(make(stream), f"{folder}/checkpoint", f"{folder}/out")


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = oracle(sql)


def _named(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with S.rocksdb(spark):
        return _drain(spark, sf_dir, lambda u: S.stream_alerts(u, LONG)).where("model <> 'closing'")


register(
    "i1_stream_usage_daily", lambda s, d: _drain(s, d, lambda u: S.stream_usage_daily(u, LONG)).select(F.col("day").cast("string").alias("day"), "total_tokens", "requests"),
    "select cast(cast(ts as date) as varchar) as day, cast(sum(total_tokens) as bigint) as total_tokens, count(*) as requests from fx_token_usage group by 1",
)
register(
    "i2_stream_rate_limits", lambda s, d: _drain(s, d, lambda u: S.stream_rates(u, LONG)).select(_named("minute"), "model", "requests", "tokens", "over"),
    f"""select strftime(minute, '%Y-%m-%d %H:%M:%S') as minute, r.model, requests, tokens, requests > coalesce(rpm, 10) or tokens > coalesce(tpm, 250000) as over from (
 select date_trunc('minute', ts) as minute, model, count(*) as requests, cast(sum(total_tokens) as bigint) as tokens from fx_token_usage group by all) as r left join {G._QUOTAS} on q.model = r.model""",
)
register(
    "i3_stream_quota_alerts", _alerts,
    f"""select u.model, cast(cast(ts as date) as varchar) as day, cast(b.band as integer) as band from fx_token_usage u left join {G._QUOTAS} on q.model = u.model cross join (values (80), (100)) as b(band)
 group by all having 100 * count(*) >= b.band * any_value(coalesce(rpd, 500))""",
)
register(
    "i4_stream_dedupe", lambda s, d: _drain(s, d, lambda u: S.stream_dedupe(u.union(u), LONG)).where("usage_id <> -1").select("usage_id", "model", "total_tokens"),
    "select usage_id, model, total_tokens from fx_token_usage",
)
register(
    "i5_stream_sessions", lambda s, d: _drain(s, d, lambda u: S.stream_sessions(u, "30 minutes", LONG)).select("user_id", _named("start"),
        _named("end"), "requests", "total_tokens"),
    """select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval 30 minutes, '%Y-%m-%d %H:%M:%S') as "end", count(*) as requests, cast(sum(total_tokens) as bigint) as total_tokens from (
 select *, sum(fresh) over (partition by user_id order by ts, usage_id) as session from (
 select *, case when ts - lag(ts) over (partition by user_id order by ts, usage_id) <= interval 30 minutes then 0 else 1 end as fresh from fx_token_usage) as a) as b group by user_id, session""",
)
# The sliding window: a minute that begins every half.
register(
    "i2_stream_rate_limits_sliding", lambda s, d: _drain(s, d, lambda u: S.stream_rates(u, LONG, "30 seconds")).select(_named("minute"), "model", "requests", "tokens", "over"),
    f"""select strftime(minute, '%Y-%m-%d %H:%M:%S') as minute, r.model, requests, tokens, requests > coalesce(rpm, 10) or tokens > coalesce(tpm, 250000) as over from (
 select time_bucket(interval 30 seconds, ts) - k * interval 30 seconds as minute, model, count(*) as requests, cast(sum(total_tokens) as bigint) as tokens from fx_token_usage cross join (values (0), (1)) as h(k) group by all) as r left join {G._QUOTAS} on q.model = r.model""",
)


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage log, then a far row that moves the watermark, then a tenth of the log again as new events: all of it is late."""
    folder = S.scratch(spark)
    usage = view(spark, sf_dir, "fx_token_usage").withColumn("ts", F.col("ts").cast("timestamp"))
    again = usage.where("usage_id % 10 = 3").withColumn("usage_id", F.col("usage_id") + 1_000_000_000)
    counted = []
    for part in (usage, S.with_closing_row(usage).where("usage_id = -1"), again):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = S.stream_dedupe(S.read_usage(spark, f"{folder}/in"))
        counted.append(S.late_rows(spark, lambda x=stream: S.started(x, f"{folder}/checkpoint", f"{folder}/out")))
    late = counted[0].unionByName(counted[1]).unionByName(counted[2]).agg(F.coalesce(F.sum("late"), F.lit(0)).alias("late"))
    kept = spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("kept"))
    return late.join(kept)


register("i6_late_rows", _late, "select count(*) filter (where usage_id % 10 = 3) as late, count(*) + 1 as kept from fx_token_usage")


def _appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream into a table; the first run dies after it has written its second batch and before that is committed."""
    folder = S.scratch(spark)
    view(spark, sf_dir, "fx_token_usage").withColumn("ts", F.col("ts").cast("timestamp")).repartition(FILES, "usage_id").write.parquet(f"{folder}/in")

    def die(number: int) -> None:
        if number == 1:
            raise RuntimeError("killed")

    try:
        S.append_stream(S.read_usage(spark, f"{folder}/in"), f"{folder}/log", f"{folder}/checkpoint", die)
    except StreamingQueryException:
        S.append_stream(S.read_usage(spark, f"{folder}/in"), f"{folder}/log", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/log").select("usage_id", "model", "total_tokens")


register("a12_usage_append_stream", _appended_once, "select usage_id, model, total_tokens from fx_token_usage")

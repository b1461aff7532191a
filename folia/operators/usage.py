"""Token usage: totals, history, days, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Model, requests a day, tokens a minute, requests a minute.
QUOTAS = (
    ("gemini-2.5-flash", 500, 250_000, 10),
    ("gemini-2.5-flash-lite", 500, 250_000, 10),
    ("gemini-2.5-pro", 25, 250_000, 5),
    ("gemini-3-flash-preview", 500, 250_000, 10),
    ("gemini-3-pro-preview", 25, 250_000, 5),
    ("gemini-2.0-flash", 1500, 1_000_000, 15),
)
DEFAULT_QUOTA = (500, 250_000, 10)


def quota_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUOTAS, "model string, rpd bigint, tpm bigint, rpm bigint")


def with_limits(df: DataFrame) -> DataFrame:
    """df (model) with rpd, tpm, rpm; the default for unknown models. The table of limits is fixed."""
    joined = df.join(F.broadcast(quota_limits(df.sparkSession)), "model", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in zip(("rpd", "tpm", "rpm"), DEFAULT_QUOTA, strict=True)})


def usage_summary(usage: DataFrame, as_of: str) -> DataFrame:
    """All-time and one day's totals and the time of the last operation, in one pass."""
    today = F.to_date("ts") == F.to_date(F.lit(as_of))
    return usage.agg(
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), F.count("*").alias("total_requests"),
        F.coalesce(F.sum(F.when(today, F.col("total_tokens"))), F.lit(0)).alias("today_tokens"), F.count_if(today).alias("today_requests"),
        F.max_by("ts", "usage_id").alias("last_used"),
    )


def history(usage: DataFrame, n: int = 20) -> DataFrame:
    return usage.orderBy(F.desc("usage_id")).limit(n)


def per_day(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.to_date("ts").alias("day")).agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("requests"))


def daily(usage: DataFrame, n: int = 30) -> DataFrame:
    """The last n days that have data."""
    return per_day(usage).orderBy(F.desc("day")).limit(n)


def daily_filled(usage: DataFrame, first: str, last: str) -> DataFrame:
    days = usage.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    return days.join(per_day(usage), "day", "left").select("day", F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), F.coalesce("requests", F.lit(0)).alias("requests"))


def quota_status(usage: DataFrame, as_of: str, scope: str = "all") -> DataFrame:
    """Per model with usage: requests of the day against its limit; scope 'all' counts the requests of every model, 'model' its own."""
    today = F.to_date("ts") == F.to_date(F.lit(as_of))
    own = usage.groupBy("model").agg(F.count_if(today).alias("own"))
    if scope == "all":
        total = own.agg(F.sum("own").alias("used"))
        own = own.crossJoin(F.broadcast(total))  # one row
    else:
        own = own.withColumn("used", F.col("own"))
    out = with_limits(own.select("model", "used"))
    share = F.least(F.col("used") / F.greatest("rpd", F.lit(1)), F.lit(1.0))
    band = F.when(share >= 1, "exhausted").when(share >= 0.8, "nearly exhausted").otherwise("ok")
    return out.select("model", "used", "rpd", F.greatest(F.col("rpd") - F.col("used"), F.lit(0)).alias("remaining"), share.alias("share"), band.alias("band"))


def usage_cube(usage: DataFrame) -> DataFrame:
    return usage.rollup("provider", "model", "operation").agg(F.grouping_id().alias("level"), F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("requests"))


def quota_table(df: DataFrame) -> DataFrame:
    """Limits of df's models in display form."""
    return with_limits(df.select("model").distinct()).select("model", F.format_number("rpd", 0).alias("rpd"), F.format_number("tpm", 0).alias("tpm"),
        F.col("rpm").cast("string").alias("rpm"))


def merge_rounds(rounds: DataFrame) -> DataFrame:
    """Sums over the continuation rounds of each call."""
    return rounds.groupBy("call_id").agg(F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("rounds"))

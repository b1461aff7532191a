"""Usage analytics on streams. Each function takes a streaming or batch frame with ``ts`` as TIMESTAMP."""

from __future__ import annotations

import atexit
import contextlib
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from folia.operators.usage import with_limits

USAGE = "usage_id bigint, ts timestamp, user_id bigint, operation string, model string, provider string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint"


def read_usage(spark: SparkSession, path: str, schema: str = USAGE, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def stream_usage_daily(usage: DataFrame, watermark: str = "1 hour") -> DataFrame:
    windows = usage.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"))
    return windows.agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("requests")).select(F.to_date("window.start").alias("day"), "total_tokens", "requests")


def stream_rates(usage: DataFrame, watermark: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Requests and tokens per minute and model against the limits."""
    window = F.window("ts", "1 minute", slide) if slide else F.window("ts", "1 minute")
    rates = usage.withWatermark("ts", watermark).groupBy(window, "model").agg(F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens"))
    limited = with_limits(rates)
    over = (F.col("requests") > F.col("rpm")) | (F.col("tokens") > F.col("tpm"))
    return limited.select(F.col("window.start").alias("minute"), "model", "requests", "tokens", over.alias("over"))


def stream_dedupe(usage: DataFrame, watermark: str = "1 hour") -> DataFrame:
    return usage.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["usage_id"])


def stream_sessions(usage: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    sessions = usage.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "user_id")
    return sessions.agg(F.count("*").alias("requests"), F.sum("total_tokens").alias("total_tokens")).select("user_id",
        F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "requests", "total_tokens")


class QuotaAlerts(StatefulProcessor):
    """Counts the requests of a model on a day; emits a row when a band is first crossed.

    The state is two numbers a model and day. A timer drops it once the watermark has passed the day's end: later rows of that day are late and not read.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "n bigint, told int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        model, day = key
        known = self.state.exists()
        n, told = self.state.get() if known else (0, 0)
        out = []
        for frame in rows:
            if not known:
                self.handle.registerTimer(int(frame["day_end"].iloc[0]))
                known = True
            limit = max(int(frame["rpd"].iloc[0]), 1)
            n += len(frame)
            for band in (80, 100):
                if told < band and 100 * n >= band * limit:
                    out.append((model, day, band))
                    told = band
        self.state.update((n, told))
        if out:
            yield pd.DataFrame(out, columns=["model", "day", "band"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_alerts(usage: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """model, day, band: one alert per model and day on reaching 80 and 100 per cent of the day's requests. Needs the RocksDB state store."""
    start = F.date_trunc("day", "ts")
    dated = with_limits(usage.withWatermark("ts", watermark)).where("ts is not null")
    dated = dated.withColumns({"day": F.to_date("ts").cast("string"), "day_end": F.unix_millis(start + F.expr("interval 1 day"))})
    return dated.groupBy("model", "day").transformWithStateInPandas(QuotaAlerts(), "model string, day string, band int", "Append", "EventTime")


def started(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over all files that are there, into Parquet under path, and returns the finished query."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drained(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all files that are there, into Parquet under path, and returns the rows."""
    started(stream, checkpoint, path, mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def append_stream(usage: DataFrame, path: str, checkpoint: str, wrote: Callable[[int], None] = lambda number: None) -> None:
    """Appends a stream of usage events below path, each once whatever fails: a batch that runs again replaces its own folder.

    wrote(number) is called when a batch's rows are written and the batch is not yet committed.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        wrote(number)

    query = usage.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class LateRows(StreamingQueryListener):
    """Collects how many rows each batch of the session's streams dropped behind the watermark: (query, batch, operator, rows).

    An operator counts what reaches it: rows for removal of duplicates, partial sums for aggregates.
    """

    def __init__(self):
        self.rows: list[tuple[str, int, str, int]] = []
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802  Spark's name
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows += [(str(p.runId), p.batchId, o.operatorName, o.numRowsDroppedByWatermark) for o in p.stateOperators if o.numRowsDroppedByWatermark]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.runId))


def late_rows(spark: SparkSession, run: Callable[[], StreamingQuery], patience: float = 60.0) -> DataFrame:
    """run, batch, operator, late: rows that the finished stream of run() dropped as late, by batch."""
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        query = str(run().runId)
        waited = time.monotonic() + patience
        while query not in listener.ended and time.monotonic() < waited:  # events come after the query's end
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(listener)
    if query not in listener.ended:
        raise TimeoutError("the stream's last event has not come")
    return spark.createDataFrame([r for r in listener.rows if r[0] == query], "run string, batch bigint, operator string, late bigint")


class rocksdb:  # noqa: N801  used as a context
    """Keeps state in RocksDB while a query that needs it is started."""

    KEY = "spark.sql.streaming.stateStore.providerClass"
    VALUE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark: SparkSession):
        self.conf, self.before = spark.conf, spark.conf.get(self.KEY, None)

    def __enter__(self) -> None:
        self.conf.set(self.KEY, self.VALUE)

    def __exit__(self, *_: object) -> None:
        self.conf.unset(self.KEY) if self.before is None else self.conf.set(self.KEY, self.before)


def with_closing_row(usage: DataFrame) -> DataFrame:
    """usage and one row of a far day, so that the watermark passes all windows of the given rows."""
    last = usage.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 40 days")).alias("ts"))
    far = last.select(*[F.col("ts") if f.name == "ts" else F.lit(-1 if "int" in f.dataType.simpleString() else "closing").cast(f.dataType).alias(f.name) for f in usage.schema])
    return usage.unionByName(far)


_made: dict[str, object] = {}  # folders of this process and the file system's settings


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names; a local one only where none is named. It goes when this process ends."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    folder = f"{base or 'file://' + tempfile.mkdtemp(prefix='folia-')}/streams/{uuid.uuid4().hex}"
    _made[folder] = spark.sparkContext._jsc.hadoopConfiguration()
    return folder


@atexit.register
def _remove_made() -> None:
    from pyspark import SparkContext

    for folder, conf in _made.items():
        with contextlib.suppress(Exception):  # the JVM can be gone by now
            path = SparkContext._gateway.jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)

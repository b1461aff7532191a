"""New files to tables, batch by batch.

A batch's rows stand in folders with its number, and its manifest, which says what became of every file, is written last: a batch
that is run again replaces its own folders, so nothing is written twice and nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.operators import manuscripts as M
from folia.operators import nodes as N
from folia.operators import validate as V
from folia.sources.files import contents, docx_blocks, listed, shared_folder
from folia.sources.files import tasks as _tasks
from folia.streaming.usage import scratch

ARRIVING = "doc_id bigint, xml string"
FILES = "path string, modificationTime timestamp, length bigint, content binary"
FOUND = "path string, length bigint"
MANIFEST = "path string, sha256 string, status string, reason string, batch int"


class _Batch:
    """Tables of one batch below a target."""

    def __init__(self, spark: SparkSession, target: str, number: int):
        self.spark, self.target, self.number = spark, target, number
        self.kept = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.target}/{name}/batch={self.number}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept += 1
        return self.write(df, f"work/{self.kept}")

    def articles(self, docs: DataFrame) -> DataFrame:
        """Cleans docs (doc_id, xml) and writes articles, nodes and errors; returns doc_id, parse_ok, parse_error."""
        cleaned = N.clean_articles(docs.select("doc_id", "xml"), self.keep)
        articles = self.write(N.parsed(cleaned), "articles")
        nodes = self.write(N.node_table(articles.select("doc_id", "xml")), "nodes")
        self.write(V.validate(nodes), "errors")
        return articles.select("doc_id", "parse_ok", "parse_error")

    def done(self) -> None:
        """Removes what was kept on the way."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.target}/work")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for k in range(1, self.kept + 1):
            files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.target}/work/{k}/batch={self.number}"), True)


def _place(spark: SparkSession, path: str):
    """A path's file system, and the path for it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, path: str) -> bool:
    files, path = _place(spark, path)
    return files.exists(path)


def _run(stream: DataFrame, write, checkpoint: str):
    # Files are looked up by a few tasks, not by up to 10,000, and without asking where their blocks lie.
    spark = stream.sparkSession
    settings = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(_tasks(spark)), "spark.sql.sources.ignoreDataLocality": "true"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return query


def stream_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = ARRIVING, per_trigger: int = 2):
    """Reads arriving Parquet files of articles and appends to articles, nodes and errors below target. Returns the finished query."""

    def write(rows: DataFrame, number: int) -> None:
        batch = _Batch(rows.sparkSession, target, number)
        batch.articles(rows)
        batch.done()

    return _run(spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(source), write, checkpoint)


def _arrivals(spark: SparkSession, folder: str, checkpoint: str, per_trigger: int) -> DataFrame:
    """A stream of the files (FOUND) below a shared folder, about per_trigger a batch and never more.

    Tasks list the folder; what is not in the tables of arrivals below the checkpoint yet is added to them, and they are the stream's source.
    So neither the driver nor the stream's memory has an entry per file: they have one per table of arrivals.
    """
    log = f"{checkpoint}/arrivals"
    found = listed(spark, folder).select("path", "length")
    if _exists(spark, log):
        found = found.join(spark.read.schema(FOUND).parquet(log).select("path"), "path", "left_anti")
    kept = f"{scratch(spark)}/new"
    found.write.parquet(kept)
    new = spark.read.schema(FOUND).parquet(kept)
    n, tables = new.count(), min(_tasks(spark), per_trigger)
    most = per_trigger // tables
    if n:
        # Dealt a little under what a table may hold, as the rows are not dealt quite evenly.
        parts = max(min(n, tables), -(-n * 10 // (most * 9)))
        new.repartition(parts).write.mode("append").option("maxRecordsPerFile", most).parquet(log)
    else:
        files, path = _place(spark, log)
        files.mkdirs(path)
    return spark.readStream.schema(FOUND).option("maxFilesPerTrigger", tables).parquet(log)


def stream_files(spark: SparkSession, source: str, target: str, checkpoint: str, per_trigger: int = 1000, max_bytes: int = M.MAX_BYTES):
    """Takes in files as they arrive below source: articles (.xml) and manuscripts (.docx, .pdf). Returns the finished query.

    Below target: articles, nodes and errors of the XML files, blocks of the Word files, and the manifest (MANIFEST) with one row per
    file. Its status is article, blocks, accepted (a PDF: its text is not read here), broken (with the first error), rejected (with the
    admission's reason), or replayed (the same bytes came before, in an earlier batch or under an earlier path of this one).

    A folder of the shared file system is listed and read by tasks, empty files included. Other stores and patterns are listed by Spark's own
    stream of files, which keeps every path on the driver and leaves empty files out.
    """
    folder = shared_folder(spark, source)

    def write(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        batch = _Batch(spark, target, number)
        rows = contents(rows) if folder else rows
        files = rows.select("path", "length", "content", F.sha2("content", 256).alias("sha256"), M.suffix(F.col("path")).alias("suffix"))
        is_xml: Column = F.col("suffix") == ".xml"
        large = F.when(F.col("length") > max_bytes, M.TOO_LARGE)
        # Contents are written once, where they are read; of what came before only paths and digests are compared.
        files = batch.keep(M.admit(files.coalesce(_tasks(spark)), max_bytes).withColumn("reason", F.when(is_xml, large).otherwise(F.col("reason"))))
        place = F.row_number().over(W.partitionBy("sha256").orderBy("path"))
        earlier = manifest(spark, target).where(F.col("batch") < number).where("status <> 'replayed'").select("sha256").distinct().withColumn("earlier", F.lit(True))
        came = files.select("path", "sha256", place.alias("place")).join(earlier, "sha256", "left").where("earlier or place > 1")
        came = batch.keep(came.select("path", F.lit(True).alias("came")))  # written, so that its size is known
        files = files.join(came, "path", "left").withColumn("came", F.coalesce("came", F.lit(False)))
        new = files.where("not came and reason is null")
        xml = new.where(is_xml).select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("xml"))
        read = batch.articles(xml).select("doc_id", F.when(F.col("parse_ok"), "article").otherwise("broken").alias("became"), F.col("parse_error").alias("why"))
        blocks = batch.write(docx_blocks(new.where("suffix = '.docx'")), "blocks")
        words = blocks.groupBy("doc_id").agg(F.max("error").alias("why"))
        read = read.unionByName(words.select("doc_id", F.when(F.col("why").isNull(), "blocks").otherwise("broken").alias("became"), "why"))
        said = files.drop("content").join(read.withColumnRenamed("doc_id", "path"), "path", "left")
        plain = F.when(F.col("suffix") == ".docx", "blocks").otherwise("accepted")  # a Word file without any block
        status = F.when(F.col("came"), "replayed").when(F.col("reason").isNotNull(), "rejected").otherwise(F.coalesce("became", plain))
        batch.write(said.select("path", "sha256", status.alias("status"), F.when(~F.col("came"), F.coalesce("reason", "why")).alias("reason")), "manifest")
        batch.done()

    if folder:
        return _run(_arrivals(spark, folder, checkpoint, per_trigger), write, checkpoint)
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(source)
    return _run(stream, write, checkpoint)


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """What became of every file so far; no rows before the first batch."""
    if not _exists(spark, f"{target}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{target}/manifest")

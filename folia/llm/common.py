"""Helpers that the operators share: reading tables, cutting lineage, slicing Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_tables: dict[str, object] = {}  # tables of this process and the file system's settings
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Only where it is unset (tests) is a local one made."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='folia-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through files in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again.

    The files' size is then known to the planner: it broadcasts the table only while it is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise. The table goes when this process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    _tables[path] = spark.sparkContext._jsc.hadoopConfiguration()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_tables() -> None:
    for path, conf in _tables.items():
        with contextlib.suppress(Exception):  # the JVM can be gone by now
            at = SparkContext._gateway.jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of this package that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def row_key(*columns: str) -> Column:
    """64-bit key of a row's identity and text: rows that repeat a doc_id with another text stay apart."""
    return F.xxhash64(*columns)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows whose texts add up to about max_bytes; a longer row comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for k, n in enumerate(sizes):
            if k > start and total + n > max_bytes:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)


def map_slices(df: DataFrame, column: str, make: Callable[[pa.RecordBatch], dict], schema: str, max_bytes: int = 4_000_000) -> DataFrame:
    """mapInArrow over slices: make returns the output columns of one slice."""
    target = pa.schema([(f.name, _arrow(f.dataType)) for f in _parsed(schema)])

    def run(batches):
        for part in slices(batches, column, max_bytes):
            out = make(part)
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, target.field(k).type) for k, v in ((n, out[n]) for n in target.names)], schema=target)

    return df.mapInArrow(run, schema)


def _parsed(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def numbered(items: list) -> tuple[np.ndarray, list]:
    """Dense numbers of the items in order of first appearance, and the distinct items."""
    index: dict = defaultdict(itertools.count().__next__)
    codes = np.fromiter(map(index.__getitem__, items), np.int64, len(items))
    return codes, list(index)

"""Files as tables and tables as files."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions.batches import PIECE, by_bytes, pieces, runs
from folia.functions.text import xml_output
from folia.operators.assemble import image_name
from folia.streaming.usage import scratch

BLOCKS = "doc_id string, pos int, kind string, text string, rows array<array<string>>, image struct<name:string,content_type:string,bytes:binary>, error string"
_ARROW = pa.schema({"doc_id": pa.string(), "pos": pa.int32(), "kind": pa.string(), "text": pa.string(), "rows": pa.list_(pa.list_(pa.string())),
    "image": pa.struct({"name": pa.string(), "content_type": pa.string(), "bytes": pa.binary()}), "error": pa.string()})
#: Namespaces of the word-processing format.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def tasks(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def shared_folder(spark: SparkSession, path: str) -> str | None:
    """The folder's name where it is one of the file system that driver and executors share; None for other stores, patterns and single files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    name = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    name = name.removeprefix("file:")
    return name if name.startswith("/") and os.path.isdir(name) else None


def _entries(folder: str) -> Iterator[os.DirEntry]:
    """What stands in a folder, but for names that Spark's readers leave out too."""
    with os.scandir(folder) as found:
        for e in found:
            if not (e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name or e.name.endswith("._COPYING_")):
                yield e


_LISTED = pa.schema({"path": pa.string(), "modificationTime": pa.timestamp("us", "UTC"), "length": pa.int64()})


def _folders_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_pydict({"folder": pa.array([e.path for e in _entries(folder) if e.is_dir()], pa.string())})


def _files_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            rows: list[tuple] = []
            for e in _entries(folder):
                if e.is_file():
                    is_, name = e.stat(), f"file:{e.path}"
                    rows.append((name, is_.st_mtime_ns // 1000, is_.st_size))
                if len(rows) == 10_000:
                    yield _listing(rows)
                    rows = []
            yield _listing(rows)


def _listing(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows) if rows else [()] * len(_LISTED), _LISTED.types)], schema=_LISTED)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length of all files at any depth below a folder of the shared file system, empty ones included.

    Folders are looked through by tasks, one level after the other, and only their names are written; nothing is listed by the driver.
    """
    base, levels = scratch(spark), []
    below = spark.createDataFrame([(folder,)], "folder string")
    while True:
        path = f"{base}/{len(levels)}"
        below.write.parquet(path)
        level = spark.read.schema("folder string").parquet(path)
        if level.isEmpty():
            break
        levels.append(path)
        below = level.repartition(tasks(spark)).mapInArrow(_folders_below, "folder string")
    return spark.read.schema("folder string").parquet(*levels).repartition(tasks(spark)).mapInArrow(_files_in, "path string, modificationTime timestamp, length bigint")


def contents(files: DataFrame) -> DataFrame:
    """files (path and length, as listed) with content, read where the rows stand, about a megabyte at a time (a larger file alone)."""
    names = files.columns
    at, size = names.index("path"), names.index("length")

    def run(batches):
        for batch in batches:
            for start, n in runs(batch.column(size).to_pylist(), PIECE):
                part, read = batch.slice(start, n), []
                for path in part.column(at).to_pylist():
                    with open(path.removeprefix("file:"), "rb") as file:
                        read.append(file.read())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(read, pa.binary())], names=[*names, "content"])

    return files.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in files.schema), "content binary"]))


def read_manuscripts(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of all Word and PDF files below a path.

    In a folder of the shared file system tasks find and read them, empty files included. Elsewhere Spark's own reader does, which lists
    on the driver and leaves empty files out.
    """
    folder = shared_folder(spark, path)
    if folder is None:
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,pdf}").option("recursiveFileLookup", True).load(path)
    return contents(listed(spark, folder).where(F.col("path").rlike(r"\.(docx|pdf)$")).repartition(tasks(spark)))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, page_no, text of page texts kept as Parquet."""
    return spark.read.schema("doc_id bigint, page_no int, text string").parquet(path)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """path, xml: one row per file."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def _paragraph(p) -> str:
    out = []
    for e in p.iter():
        if e.tag == _W + "t":
            out.append(e.text or "")
        elif e.tag == _W + "tab":
            out.append("\t")
        elif e.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def _body(part) -> Iterator[ElementTree.Element]:
    """The children of a document's body as they are read; what has been used is let go, and nothing is read before it is asked for."""
    stack: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(part, events=("start", "end")):
        if event == "start":
            stack.append(e)
            continue
        stack.pop()
        if stack and stack[-1].tag == _W + "body":
            yield e
            stack[-1].remove(e)


def _blocks(content: bytes, max_blocks: int | None = None) -> list[tuple]:
    """(kind, text, rows, image) of a Word file's body, in order; of a limit's blocks only as much is decoded as they take."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        relations, types = {}, {}
        if "word/_rels/document.xml.rels" in names:
            relations = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")).iter(_REL + "Relationship")}
        if "[Content_Types].xml" in names:
            types = {e.get("Extension", "").lower(): e.get("ContentType") for e in ElementTree.fromstring(z.read("[Content_Types].xml")) if e.get("Extension")}
        out: list[tuple] = []
        with z.open("word/document.xml") as part:
            for e in _body(part):
                if e.tag == _W + "p":
                    text, found = _paragraph(e), False
                    for blip in e.iter(_A + "blip"):
                        found = True
                        target = "word/" + (relations.get(blip.get(_R + "embed")) or "").removeprefix("/word/")
                        if target in names:
                            kind = types.get(target.rpartition(".")[2].lower(), "image/" + target.rpartition(".")[2])
                            out.append(("image", text, None, (target.rpartition("/")[2], kind, z.read(target))))
                    if not found:
                        out.append(("paragraph", text, None, None))
                elif e.tag == _W + "tbl":
                    rows = [["\n".join(_paragraph(p) for p in c.iter(_W + "p")) for c in r.findall(_W + "tc")] for r in e.findall(_W + "tr")]
                    out.append(("table", None, rows, None))
                if max_blocks is not None and len(out) >= max_blocks:
                    break
    return out[:max_blocks]


def docx_blocks(files: DataFrame, max_blocks: int | None = None) -> DataFrame:
    """BLOCKS of files (path, content): one row per paragraph, table and picture; a file that cannot be read gives one row with error.

    max_blocks: only a file's first blocks, and the decoder stops behind them, so faults further on are not seen. Files are decoded about
    a megabyte at a time (a larger one alone).
    """

    def decoded(path: str, content: bytes) -> list[tuple]:
        try:
            found = _blocks(content, max_blocks)
        except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
            return [(path, 0, "error", None, None, None, str(e)[:500])]
        return [(path, k, kind, text, table, image and dict(zip(("name", "content_type", "bytes"), image)), None) for k, (kind, text, table, image) in enumerate(found)]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                rows = [row for path, content in zip(*(c.to_pylist() for c in part.columns)) for row in decoded(path, content)]
                yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows) if rows else [[]] * len(_ARROW), _ARROW.types)], schema=_ARROW)

    by_bytes(files.sparkSession)
    return files.where(F.lower("path").endswith(".docx")).select("path", "content").mapInArrow(run, BLOCKS)


def images(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, name, content: pictures numbered per document."""
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    return blocks.where("kind = 'image'").select("doc_id", "pos", image_name(number, F.col("image.content_type")).alias("name"), F.col("image.bytes").alias("content"))


def write_xml(df: DataFrame, path: str, version: str = "1.4") -> None:
    """doc_id, xml as Parquet, with declaration and DOCTYPE."""
    df.select("doc_id", xml_output(F.col("xml"), version).alias("xml")).write.parquet(path)


def write_html(df: DataFrame, path: str) -> None:
    df.select("doc_id", "html").write.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def append_usage(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)

"""Article XML as a table of nodes, and back.

node_id is the place in document order and end_id the last descendant, so that "d is below a" is a range
test within one document. Every node carries its nearest ancestors of the kinds that are asked for (``NEAREST``), so that "inside
a section" or "inside an author" is a join on equal numbers; a subtree's text is a slice of the root's ``content``.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from folia.functions.batches import by_bytes, pieces
from folia.functions.text import escape_html, escape_xml, sanitize_text
from folia.functions.xml_tree import INTS, NEAREST, STRINGS, Columns, read_into

_KINDS = {n: ("int", pa.int32()) for n in INTS} | {n: ("string", pa.string()) for n in STRINGS} | {n: ("binary", pa.binary()) for n in ("content", "inner")}
_KINDS |= {"attrs": ("map<string,string>", pa.map_(pa.string(), pa.string())), "children": ("array<string>", pa.list_(pa.string())), "loose": ("boolean", pa.bool_())}
_KINDS |= {"parse_error": ("string", pa.string())}


@arrow_udf(StringType())
def xml_error(xml: pa.Array) -> pa.Array:
    return pa.array([read_into(Columns(), x) for x in xml.to_pylist()], pa.string())


def parsed(df: DataFrame, column: str = "xml") -> DataFrame:
    """df with parse_ok, parse_error."""
    out = df.withColumn("parse_error", xml_error(F.col(column)))
    return out.withColumn("parse_ok", F.col("parse_error").isNull())


def _arrays(out: Columns, names: Iterable[str]) -> list[pa.Array]:
    lists = out.lists()
    attrs = pa.MapArray.from_arrays(pa.array(out.attribute_starts, pa.int32()), pa.array(out.keys, pa.string()), pa.array(out.values, pa.string()))
    lists |= {"children": out.children, "loose": out.loose}
    return [attrs if n == "attrs" else pa.array(lists[n], _KINDS[n][1]) for n in names if n != "parse_error"]


def node_rows(df: DataFrame, column: str = "xml", *keys: str, fields: Iterable[str] | None = None) -> DataFrame:
    """node_table with ``parse_error`` in the first row of a document; a document without any node has one row, its node_id is -1.

    fields: the columns of nodes that are wanted, where not all are; what is not wanted does not leave Python. node_id and parse_error always come.
    Nodes leave Python as flat columns, those of about a megabyte of documents at a time.
    """
    keys = list(keys or ("doc_id",))
    kinds = _KINDS if fields is None else {n: kind for n, kind in _KINDS.items() if n in {"node_id", "parse_error", *fields}}

    def batch(rows: pa.RecordBatch, out: Columns, errors: list) -> pa.RecordBatch:
        starts = out.document_starts
        of = pa.array([k for k, (a, b) in enumerate(zip(starts, starts[1:])) for _ in range(b - a)], pa.int32())
        first = [None] * starts[-1]
        for a, b, error in zip(starts, starts[1:], errors):
            if b > a:
                first[a] = error
        full = [*(rows.column(k).take(of) for k in range(len(keys))), *_arrays(out, kinds), pa.array(first, pa.string())]
        bare = [k for k, (a, b) in enumerate(zip(starts, starts[1:])) if a == b]
        if bare:
            none = [pa.array([-1] * len(bare), kind) if n == "node_id" else pa.array([errors[k] for k in bare], kind) if n == "parse_error" else pa.nulls(len(bare), kind) for n, (_, kind) in kinds.items()]
            full = [pa.concat_arrays([a, b]) for a, b in zip(full, [*(rows.column(k).take(pa.array(bare)) for k in range(len(keys))), *none])]
        return pa.RecordBatch.from_arrays(full, [*keys, *kinds])

    def run(batches):
        for rows in batches:
            for part in pieces(rows, len(keys)):
                out = Columns()
                errors = [read_into(out, xml) for xml in part.column(len(keys)).to_pylist()]
                made = batch(part, out, errors)
                del out, errors  # not kept while Spark takes the nodes
                yield made

    by_bytes(df.sparkSession)
    columns = df.select(*keys, column)
    schema = ", ".join([*(f"`{k}` {columns.schema[k].dataType.simpleString()}" for k in keys), *(f"{n} {kind}" for n, (kind, _) in kinds.items())])
    return columns.mapInArrow(run, schema)


def node_table(df: DataFrame, column: str = "xml", *keys: str, fields: Iterable[str] | None = None) -> DataFrame:
    """One row per node of df's documents, with the key columns (doc_id unless named) and the named columns of nodes, or all."""
    return node_rows(df, column, *keys, fields=fields).where("node_id >= 0").drop("parse_error")


def enclosed(rows: DataFrame, nodes: DataFrame, chosen: DataFrame, kind: str, *keys: str, at: str = "node_id") -> DataFrame:
    """rows (at, tag and the kind's column among others) with top_id of every chosen node that they are in or that they are.

    Both sides meet on the document and the nearest element of the kind, so the pairs are linear in the document. Only elements of
    the kind inside another one are looked up by range, to add what lies deeper.
    """
    keys = list(keys or ("doc_id",))
    own = F.when(F.col("tag") == NEAREST[kind], F.col(at)).otherwise(F.col(kind))
    here = F.when(F.col("tag") == NEAREST[kind], F.col("node_id")).otherwise(F.col(kind))
    tops = chosen.select(*keys, F.col("node_id").alias("top_id"), F.col("end_id").alias("top_end"), here.alias("anchor"))
    nested = nodes.where((F.col("tag") == NEAREST[kind]) & (F.col(kind) >= 0)).select(*keys, F.col("node_id").alias("anchor"))
    deep = nested.join(tops.drop("anchor"), keys).where("anchor > top_id and anchor <= top_end").select(tops.columns)
    both = rows.withColumn("anchor", own).join(tops.unionByName(deep), [*keys, "anchor"])
    return both.where((F.col(at) >= F.col("top_id")) & (F.col(at) <= F.col("top_end"))).drop("anchor", "top_end")


def contents(nodes: DataFrame, *keys: str) -> DataFrame:
    """keys, content: the text of every document, which a node's text_from and text_to cut (bytes)."""
    return nodes.where("node_id = 0").select(*(keys or ("doc_id",)), "content")


def events(nodes: DataFrame, open_: Column, close: Column, *group: str) -> DataFrame:
    """The group columns and html: opening and closing strings and escaped texts of the nodes in document order.

    A node opens at (node_id, 0) and closes after its last descendant; of nodes that end together the deepest closes first.
    """
    parts = F.array(
        F.struct(F.col("node_id").alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("deep"), F.concat(open_, F.lit("")).alias("s")),
        F.struct(F.col("end_id").alias("at"), F.lit(1).alias("turn"), (-F.col("depth")).alias("deep"), close.alias("s")),
    )
    rows = nodes.select(*group, F.inline(parts))
    ordered = F.array_sort(F.collect_list(F.struct("at", "turn", "deep", "s")))
    return rows.groupBy(*group).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "").alias("html"))


def attributes_text(attrs: Column) -> Column:
    one = lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), F.replace(escape_xml(e["value"]), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    return F.array_join(F.transform(F.map_entries(attrs), one), "")


def serialize(nodes: DataFrame, *keys: str) -> DataFrame:
    """keys, xml of node tables. Attributes lose their prefixes with the parse; text is escaped."""
    name = F.concat(F.when(F.col("ns") == "", "").otherwise(F.concat("ns", F.lit(":"))), "tag")
    open_ = F.concat(F.lit("<"), name, attributes_text(F.col("attrs")), F.lit(">"), escape_xml(F.col("text")))
    close = F.concat(F.lit("</"), name, F.lit(">"), escape_xml(F.col("tail")))
    return events(nodes, open_, close, *(keys or ("doc_id",))).withColumnRenamed("html", "xml")


#: Inline elements and their HTML.
INLINE = {"italic": ("<em>", "</em>"), "i": ("<em>", "</em>"), "source": ("<em>", "</em>"), "bold": ("<strong>", "</strong>"),
    "b": ("<strong>", "</strong>"), "strong": ("<strong>", "</strong>"), "underline": ('<span class="underline">', "</span>"),
    "u": ('<span class="underline">', "</span>"), "sup": ("<sup>", "</sup>"), "sub": ("<sub>", "</sub>")}


def inline_html(nodes: DataFrame, *keys: str) -> DataFrame:
    """keys, top_id, html of the content of each top: rows of nodes carry top_id, the top itself included."""
    keys = keys or ("doc_id",)
    rid, tag = F.col("attrs")["rid"], F.lower("tag")
    text = escape_html(F.col("text"))
    cite = (tag == "xref") & (F.lower(F.coalesce(F.col("attrs")["ref-type"], F.lit(""))) == "bibr")
    target = F.get(F.split(F.trim(F.coalesce(rid, F.lit(""))), r"\s+"), F.lit(0))
    href = F.coalesce(F.col("attrs")["href"], F.lit(""))
    link = (tag == "ext-link") & (href != "")
    doi = (tag == "pub-id") & (F.col("attrs")["pub-id-type"] == "doi") & (text != "")
    bare = F.col("end_id") == F.col("node_id")
    opened = (
        F.when(cite, F.concat(F.lit('<a class="citation" href="#'), escape_html(target), F.lit('" data-rid="'), escape_html(F.trim(F.coalesce(rid, F.lit("")))), F.lit('">')))
        .when(link, F.concat(F.lit('<a class="external-link" href="'), escape_html(href), F.lit('" target="_blank" rel="noopener">'),
            F.when(bare & (text == ""), escape_html(href)).otherwise("")))
        .when(doi, F.concat(F.lit('<a href="https://doi.org/'), text, F.lit('" target="_blank" rel="noopener">')))
    )
    closed = F.when(cite | link | doi, F.lit("</a>"))
    for name, (a, b) in INLINE.items():
        opened, closed = opened.when(tag == name, F.lit(a)), closed.when(tag == name, F.lit(b))
    top = F.col("node_id") == F.col("top_id")
    # Parts of a name are set apart by a space.
    gap = F.when(tag.isin("surname", "given-names") & (F.col("ordinal") > 0), F.lit(" ")).otherwise("")
    open_ = F.when(top, text).otherwise(F.concat(gap, opened.otherwise(""), text))
    close = F.when(top, "").otherwise(F.concat(closed.otherwise(""), escape_html(F.col("tail"))))
    return events(nodes, open_, close, *keys, "top_id").withColumn("html", F.trim("html"))


#: The columns of nodes that move_orphans reads.
MOVES = ("node_id", "parent_id", "parent_tag", "tag", "attrs", "sec_id", "src_from", "src_close", "src_tail")


def move_orphans(sources: DataFrame, nodes: DataFrame, *keys: str, column: str = "xml", title: str = "Supplementary material") -> DataFrame:
    """keys, xml: table-wraps that stand in body itself go to the end of the first section that cites them, else into new sections at its end.

    sources (keys, column) holds the text that nodes were read from; it is cut and put together again, so all else stays as it was.
    A loose table-wrap without id stays; loose table-wrap-foots go, but only from documents with a loose table-wrap. Text behind an
    element goes with it. Documents without a loose table-wrap are not in the result.
    """
    keys = list(keys or ("doc_id",))
    body = nodes.where(F.col("tag") == "body").groupBy(*keys).agg(F.min_by(F.struct(F.col("node_id").alias("id"), F.col("src_close").alias("end")), "node_id").alias("body"))
    loose = nodes.where((F.col("parent_tag") == "body") & F.col("tag").isin("table-wrap", "table-wrap-foot")).join(body, keys).where(F.col("parent_id") == F.col("body.id"))
    loose = loose.select(*keys, "node_id", "tag", F.col("src_from").alias("cut"), F.col("src_tail").alias("until"), F.col("attrs")["id"].alias("id"), F.col("body.end").alias("body_end"))
    cited = nodes.where((F.col("tag") == "xref") & (F.col("attrs")["ref-type"] == "table") & (F.col("sec_id") >= 0))
    cited = cited.select(*keys, F.col("node_id").alias("xref"), F.col("attrs")["rid"].alias("id"), F.col("sec_id").alias("sec"))
    sections = nodes.where(F.col("tag") == "sec").select(*keys, F.col("node_id").alias("sec"), F.col("src_close").alias("sec_end"))
    # The nearest section of the first citation that stands in one.
    homes = loose.where("tag = 'table-wrap' and id <> ''").select(*keys, "node_id", "id").join(cited, [*keys, "id"]).join(sections, [*keys, "sec"])
    homes = homes.groupBy(*keys, "node_id").agg(F.min_by("sec_end", "xref").alias("home"))
    placed = loose.join(homes, [*keys, "node_id"], "left").withColumn("moves", (F.col("tag") == "table-wrap") & (F.coalesce("id", F.lit("")) != ""))
    goes = F.col("moves") | (F.col("tag") == "table-wrap-foot")
    part = F.struct(F.coalesce("home", "body_end").alias("to"), "node_id", "cut", "until", F.col("home").isNull().alias("fresh"))
    edits = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("moves"), part))).alias("parts"),
        F.array_sort(F.collect_list(F.when(goes, F.struct("cut", "until")))).alias("cuts"), F.bool_or(F.col("tag") == "table-wrap").alias("any")).where("any")
    both = sources.select(*keys, F.col(column).alias("xml")).join(edits, keys)
    # In order of the source: what is put in stands before the tag that closes its new place, what is cut is left out.
    piece = lambda a, b: F.substring(F.col("xml"), a + 1, b - a)
    fresh = lambda p, x: F.when(p["fresh"], F.concat(F.lit(f'<sec sec-type="supplementary-material"><title>{title}</title>'), x, F.lit("</sec>"))).otherwise(x)
    put = F.transform("parts", lambda p: F.struct(p["to"].alias("at"), F.lit(1).alias("turn"), p["node_id"].alias("n"), p["to"].alias("next"), fresh(p, piece(p["cut"], p["until"])).alias("s")))
    cut = F.transform("cuts", lambda c: F.struct(c["cut"].alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("n"), c["until"].alias("next"), F.lit("").alias("s")))
    both = both.select(*keys, "xml", F.array_sort(F.concat(put, cut)).alias("edits"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda now, e: F.struct(e["next"].alias("at"), F.concat(now["out"], F.array(piece(now["at"], e["at"]), e["s"])).alias("out"))
    end = lambda now: F.concat(F.array_join(now["out"], ""), piece(now["at"], F.length("xml")))
    return both.select(*keys, F.aggregate("edits", start, step, end).alias("xml"))


def clean_articles(df: DataFrame, keep, column: str = "xml", *keys: str) -> DataFrame:
    """df with the column cleaned: the string steps, then loose tables moved into sections.

    Only texts that name a table-wrap are parsed for the last step; a text that is not well-formed, or has no loose table, stays as
    the string steps left it. ``keep`` stores rows that are used more than once.
    """
    keys = list(keys or ("doc_id",))
    cleaned = keep(df.withColumn(column, sanitize_text(F.col(column))))
    suspects = cleaned.where(F.contains(F.col(column), F.lit("<table-wrap")) & F.contains(F.col(column), F.lit("<body"))).select(*keys, column)
    rows = keep(node_rows(suspects, column, *keys, fields=MOVES))
    broken = rows.where("parse_error is not null").select(*keys).distinct()
    nodes = rows.where("node_id >= 0").join(broken, keys, "left_anti")
    # Written, so that its size is known: few texts have loose tables, and the others then stay where they are.
    moved = keep(move_orphans(suspects, nodes, *keys, column=column).withColumnRenamed("xml", "_moved"))
    return cleaned.join(moved, keys, "left").withColumn(column, F.coalesce("_moved", F.col(column))).select(df.columns)

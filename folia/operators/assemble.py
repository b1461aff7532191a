"""Document assembly: typed blocks to one text, prompts from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions.text import pipe_cells, is_separator_row, strip

#: The grammar of placeholders in an assembled text.
IMAGE = "IMAGEN-PLACEHOLDER"
TABLE = "TABLA-PLACEHOLDER"
SNIPPET = 3000
HEAD = 50
IMAGE_TYPES = ("png", "jpeg", "jpg", "gif", "tiff", "bmp", "svg+xml")


def image_name(number: Column, content_type: Column) -> Column:
    kind = F.element_at(F.split(content_type, "/"), -1)
    return F.concat(F.lit("imagen_"), number.cast("string"), F.lit("."), F.when(kind.isin(*IMAGE_TYPES), kind).otherwise("png"))


def image_placeholder(file: Column, caption: Column) -> Column:
    return F.concat(F.lit(f'\n[{IMAGE} file="'), file, F.lit('" caption="'), strip(caption), F.lit('"]\n'))


def table_content(rows: Column) -> Column:
    """array<array<string>> as text: cells by ' | ', rows by '; '."""
    cell = lambda c: F.replace(strip(c), F.lit("\n"), F.lit(" "))
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, cell), " | ")), "; ")


def table_placeholder(caption: Column, content: Column) -> Column:
    return F.concat(F.lit(f'\n[{TABLE} caption="'), caption, F.lit('" content="'), content, F.lit('"]\n'))


def block_parts(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, pos, kind, text[, rows]) with ``part``: the text of a paragraph, the placeholder of an image, the content of a table."""
    number = F.sum(F.when(F.col("kind") == "image", 1).otherwise(0)).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    kind = F.col("content_type") if "content_type" in blocks.columns else F.lit("image/png")
    content = table_content(F.col("rows")) if "rows" in blocks.columns else table_content(F.array(F.array("text")))
    part = F.when(F.col("kind") == "image", image_placeholder(image_name(number, kind), F.col("text"))).when(F.col("kind") == "table", content).otherwise(F.col("text"))
    return blocks.withColumn("part", part)


def fold_captions(parts: DataFrame) -> DataFrame:
    """doc_id, pos array<int>, parts array<string> in order: a table takes the part before it as caption, whatever that is by then, and blanks it.

    So of a run of tables the last one stays, with those before it folded into its caption. ``k`` is a table's place in
    its run; every part is looked at once, and once more as part of a run.
    """
    w = W.partitionBy("doc_id").orderBy("pos")
    place = F.row_number().over(w)
    other = F.max(F.when(F.col("kind") != "table", F.col("place"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    placed = parts.withColumn("place", place).withColumn("k", F.col("place") - F.coalesce(other, F.lit(0)))
    grouped = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "part", "k"))).alias("all"))

    def folded(x: Column, i: Column) -> Column:
        before = strip(F.coalesce(F.get("all", i - x["k"])["part"], F.lit("")))
        run = F.slice("all", i - x["k"] + 2, x["k"] - 1)
        caption = F.aggregate(run, before, lambda done, y: strip(table_placeholder(done, y["part"])))
        taken = F.coalesce(F.get("all", i + 1)["kind"] == "table", F.lit(False)) & ((x["kind"] == "table") | (strip(x["part"]) != ""))
        return F.when(taken, "").when(x["kind"] == "table", table_placeholder(caption, x["part"])).otherwise(x["part"])

    return grouped.select("doc_id", F.col("all.pos").alias("pos"), F.transform("all", folded).alias("parts"))


def assemble(blocks: DataFrame) -> DataFrame:
    """doc_id, text of blocks."""
    return fold_captions(block_parts(blocks)).select("doc_id", F.array_join("parts", "\n").alias("text"))


def head_context(blocks: DataFrame, n: int = HEAD) -> DataFrame:
    """doc_id, context: the first n paragraphs by line."""
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    head = blocks.where(F.col("kind") == "paragraph").withColumn("rank", rank).where(F.col("rank") <= n)
    return head.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("context"))


def head_pages(pages: DataFrame, n: int = 2) -> DataFrame:
    """doc_id, context: texts of the first n pages, pages without text left out."""
    head = pages.where((F.col("page_no") < n) & (F.coalesce("text", F.lit("")) != ""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: F.concat(x["text"], F.lit("\n")))
    return head.groupBy("doc_id").agg(F.array_join(lines, "").alias("context"))


def render(template: Column, **values: Column) -> Column:
    """Literal substitution of {name}; text_snippet is cut to the first SNIPPET characters."""
    for name, value in values.items():
        value = F.substring(value, 1, SNIPPET) if name == "text_snippet" else value
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def metadata_block(meta: dict[str, Column], fallback: str = "from the text") -> Column:
    """One line per field, with a fallback for missing ones."""
    return F.array_join(F.array(*[F.concat(F.lit(f"- {k}: "), F.coalesce(v, F.lit(fallback))) for k, v in meta.items()]), "\n")


#: Outlines of the three correction prompts; the wording comes with the caller's templates.
CORRECTION = {"plan": "{errors}", "analysis": "{errors}\n{xml}", "interactive": "{errors}\n{xml}\n{feedback}"}


def render_correction(errors: Column, xml: Column, feedback: Column, kind: str, template: str | None = None) -> Column:
    lines = F.array_join(F.transform(errors, lambda e: F.concat(F.lit("- "), e)), "\n")
    fenced = lambda x: F.concat(F.lit("<USER_DOCUMENT_START>\n"), x, F.lit("\n<USER_DOCUMENT_END>"))
    said = F.when(F.coalesce(strip(feedback), F.lit("")) != "", fenced(feedback)).otherwise("")
    return render(F.lit(template or CORRECTION[kind]), errors=fenced(lines), xml=fenced(xml), feedback=said)


def table_cells(df: DataFrame, column: str) -> DataFrame:
    """Rows of df with row_no, cell_no, cell for pipe-delimited text: separator rows go, short rows are padded and long ones cut to the first row's width."""
    keys = [c for c in df.columns if c != column]
    lines = F.filter(F.split(column, "\n"), lambda x: x.contains("|"))
    kept = F.transform(F.filter(lines, lambda x: ~is_separator_row(x)), pipe_cells)
    wide = df.select(*keys, kept.alias("rows")).withColumn("width", F.size(F.get("rows", F.lit(0))))
    rows = wide.select(*keys, "width", F.posexplode("rows").alias("row_no", "cells"))
    fitted = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.col("width"))), F.lit(1), F.col("width"))
    return rows.select(*keys, "row_no", F.posexplode(fitted).alias("cell_no", "cell"))

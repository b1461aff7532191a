"""Set-based validation of node tables: each rule gives rows (keys, node_id, rule, message).

Every node knows its children's names, so the content rules run them through the node's automaton where it stands; attributes are judged
where they stand too. The identifier rules take one grouping by identifier. The grammar's tables are fixed and broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.text import strip
from folia.sources.grammar import attr_decl, automaton_table, content_model

KEYS = ("doc_id",)
#: The columns of nodes that the rules and the audit read.
READ = ("node_id", "tag", "ns", "children", "loose", "attrs", "text_from", "text_to", "content")
_NAME = r"[\p{L}_:][\p{L}\p{M}\p{N}._:·\-]*"
_TOKEN = r"[\p{L}\p{M}\p{N}._:·\-]+"
#: What a value of each type looks like.
PATTERNS = {"ID": _NAME, "IDREF": _NAME, "IDREFS": rf"{_NAME}(\s+{_NAME})*", "NMTOKEN": _TOKEN, "NMTOKENS": rf"{_TOKEN}(\s+{_TOKEN})*"}


def _name() -> Column:
    return F.when(F.col("ns") == "", F.col("tag")).otherwise(F.concat("ns", F.lit(":"), "tag"))


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def content_errors(nodes: DataFrame, version: str = "1.4", *keys: str) -> DataFrame:
    """Undeclared elements, children that break their parent's content model, and text where only elements may stand."""
    keys, spark = list(keys or KEYS), nodes.sparkSession
    rows = nodes.select(*keys, "node_id", _name().alias("element"), "children", "loose")
    rows = rows.join(F.broadcast(automaton_table(spark)), "element", "left")

    # state: before the last child; to: behind it, -1 where the child does not fit, and there the run ends; at: children taken.
    def step(now: Column, c: Column) -> Column:
        symbol = F.get("symbols", F.array_position("tags", c).cast("int") - 1)
        to = F.coalesce(F.get("moves", now["to"] * F.col("width") + symbol), F.lit(-1))
        return F.when(now["to"] < 0, now).otherwise(F.struct(now["to"].alias("state"), to.alias("to"), (now["at"] + 1).alias("at")))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("to"), F.lit(0).alias("at"))
    ran = rows.withColumn("ran", F.aggregate("children", start, step))
    # A run that no child stopped has to be in a state where the element may end.
    stopped = F.col("ran.to") < 0
    last = F.when(stopped, F.col("ran.state")).otherwise(F.col("ran.to"))
    short = ~F.get("ends", last)
    got = F.when(stopped, _say("(", F.get("children", F.col("ran.at") - 1), ") as child ", F.col("ran.at").cast("string"))).otherwise(
        _say("(nothing more) after child ", F.size("children").cast("string")))
    model = _say("Element ", F.col("element"), " content does not follow the DTD, expecting (", F.get("expected", last), "), got ", got)
    rules = F.array(
        F.when(F.col("moves").isNull(), F.struct(F.lit("undeclared element").alias("rule"), _say("Element ", F.col("element"), " is not declared in the grammar").alias("message"))),
        F.when(stopped | short, F.struct(F.lit("content model").alias("rule"), model.alias("message"))),
        F.when(~F.col("mixed") & F.col("loose"), F.struct(F.lit("text not allowed").alias("rule"), _say("Element ", F.col("element"), " may not contain text").alias("message"))),
    )
    return ran.select(*keys, "node_id", F.inline(F.array_compact(rules)))


def _typed(nodes: DataFrame, version: str, keys: list[str]) -> DataFrame:
    """keys, node_id, element, attribute, value, type, allowed of the attributes that declared elements carry; type is null for undeclared ones."""
    used = nodes.where(F.size("attrs") > 0).select(*keys, "node_id", _name().alias("element"), F.explode("attrs").alias("attribute", "value"))
    return used.join(F.broadcast(attr_decl(nodes.sparkSession, version).select("element", "attribute", "type", "allowed")), ["element", "attribute"], "left")


def attribute_errors(nodes: DataFrame, version: str = "1.4", *keys: str) -> DataFrame:
    """Attributes that their element does not have, values that are not of the declared type, and required attributes that are missing.

    Undeclared elements are not judged.
    """
    keys, spark = list(keys or KEYS), nodes.sparkSession
    known = F.broadcast(content_model(spark, version).select("element"))
    used = _typed(nodes, version, keys).join(known, "element", "left_semi")
    a, e = F.col("attribute"), F.col("element")
    bad = F.lit(False)
    for kind, pattern in PATTERNS.items():
        bad = bad | ((F.col("type") == kind) & ~F.col("value").rlike(rf"^\s*{pattern}\s*$"))
    outside = (F.col("type") == "enumeration") & ~F.array_contains("allowed", F.trim("value"))
    found = (
        F.when(F.col("type").isNull(), F.struct(F.lit("undeclared attribute").alias("rule"), _say("No declaration for attribute ", a, " of element ", e).alias("message")))
        .when(outside, F.struct(F.lit("attribute value").alias("rule"), _say('Value "', F.col("value"), '" for attribute ', a, " of ", e, " is not among the enumerated set").alias("message")))
        .when(bad, F.struct(F.lit("attribute value").alias("rule"), _say("Syntax of value for attribute ", a, " of ", e, " is not valid").alias("message")))
    )
    wrong = used.select(*keys, "node_id", found.alias("found")).where("found is not null").select(*keys, "node_id", "found.*")
    must = attr_decl(spark, version).where("required").select("element", "attribute")
    bare = nodes.select(*keys, "node_id", _name().alias("element"), "attrs").join(F.broadcast(must), "element").where(~F.map_contains_key("attrs", a))
    return wrong.unionByName(bare.select(*keys, "node_id", F.lit("missing attribute").alias("rule"), _say("Element ", e, " does not carry attribute ", a).alias("message")))


def identifier_errors(nodes: DataFrame, version: str = "1.4", *keys: str) -> DataFrame:
    """Identifiers used more than once (at their last use), and references to identifiers that are not there."""
    keys = list(keys or KEYS)
    typed = _typed(nodes, version, keys).where("type in ('ID', 'IDREF', 'IDREFS')")
    words = typed.select(*keys, "node_id", "attribute", (F.col("type") != "ID").alias("refers"), F.explode(F.split(F.trim("value"), r"\s+")).alias("id")).where("id <> ''")
    by_id = words.groupBy(*keys, "id").agg(F.count_if(~F.col("refers")).alias("n"), F.max(F.when(~F.col("refers"), F.col("node_id"))).alias("last"),
        F.collect_list(F.when(F.col("refers"), F.struct("node_id", "attribute"))).alias("references"))
    twice = by_id.where("n > 1").select(*keys, F.col("last").alias("node_id"), F.lit("duplicate id").alias("rule"), _say("ID ", F.col("id"), " is used more than once").alias("message"))
    lost = by_id.where("n = 0").select(*keys, "id", F.inline("references"))
    message = _say("IDREF attribute ", F.col("attribute"), " references an unknown ID ", F.col("id"))
    return twice.unionByName(lost.select(*keys, "node_id", F.lit("dangling reference").alias("rule"), message.alias("message")))


def _only(rule: str, errors):
    def part(nodes: DataFrame, version: str = "1.4", *keys: str) -> DataFrame:
        return errors(nodes, version, *keys).where(F.col("rule") == rule)

    return part


undeclared_elements = _only("undeclared element", content_errors)
content_violations = _only("content model", content_errors)
text_not_allowed = _only("text not allowed", content_errors)
undeclared_attributes = attribute_errors
duplicate_ids = _only("duplicate id", identifier_errors)
dangling_idrefs = _only("dangling reference", identifier_errors)


def validate(nodes: DataFrame, version: str = "1.4", *keys: str) -> DataFrame:
    """All rules' rows. nodes is read a few times: give a written table."""
    return reduce(DataFrame.unionByName, [f(nodes, version, *keys) for f in (content_errors, attribute_errors, identifier_errors)])


def body_audit(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, parse_ok, body_text of every document of ``node_rows``: all text of the first body below its tags, '' without one.

    A document that is not well-formed has no text to judge (null): the audit lets it pass, and parse_ok says why.
    """
    keys = list(keys or KEYS)
    roots = rows.where("node_id <= 0").select(*keys, F.col("parse_error").isNull().alias("parse_ok"), "content")  # one a document
    bodies = rows.where("tag = 'body'").groupBy(*keys).agg(F.min_by(F.struct("text_from", "text_to"), "node_id").alias("body"))
    text = F.substring("content", F.col("body.text_from") + 1, F.col("body.text_to") - F.col("body.text_from")).cast("string")
    both = roots.join(bodies, keys, "left")
    return both.select(*keys, "parse_ok", F.when(F.col("parse_ok"), F.coalesce(strip(text), F.lit(""))).alias("body_text"))


def verdicts(documents: DataFrame, errors: DataFrame, *keys: str) -> DataFrame:
    """keys, n_errors, valid, messages for every document."""
    keys = list(keys or KEYS)
    counted = errors.groupBy(*keys).agg(F.count("*").alias("n_errors"),
        F.transform(F.array_sort(F.collect_list(F.struct("node_id", "rule", "message"))), lambda x: x["message"]).alias("messages"))
    out = documents.select(*keys).distinct().join(counted, keys, "left")
    return out.select(*keys, F.coalesce("n_errors", F.lit(0)).cast("int").alias("n_errors"), F.col("n_errors").isNull().alias("valid"),
        F.coalesce("messages", F.array().cast("array<string>")).alias("messages"))

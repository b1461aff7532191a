"""Column functions that clean model responses and XML strings. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the defects that model responses have.
XML_FENCE = r"(?si)```xml\s*(.*?)(?:```|$)"
JSON_FENCE = r"(?si)```json\s*(.*?)(?:```|$)"
XML_START = r"(?s)(<\?xml|<!DOCTYPE|<article).*"
TRUNCATED_TAG = r"<([a-zA-Z][\w-]*)\s*\n\s*(<[a-zA-Z])"
ALIGN_CELL = r'(?s)<align="([^"]*)">(.*?)</align>'
BREAK = r"<break\s*/>"
LAZY_COMMENT = r"<!--\s*(?i:contenido|cuerpo|texto|referencias|inserte|...\s*).*?-->"
BARE_AMPERSAND = r"&(?![a-zA-Z]+;|#\d+;|#x[0-9a-fA-F]+;)"
TAG_NAME = r"^[a-zA-Z][a-zA-Z0-9\-]*$"
EDITABLE_TAGS = ("article-title", "trans-title", "abstract", "kwd-group", "journal-title", "publisher-name", "issn", "volume", "issue", "fpage", "lpage", "year")
MARKUP_TAGS = ("abstract", "kwd-group")
TAG_SEARCH = 500_000
#: The code points with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bound(x: Column, *steps: Callable[[Column], Column]) -> Column:
    """Steps one after the other, each on a bound value: a step that names its input several times does not have it evaluated as often."""
    for step in steps:
        x = F.get(F.transform(F.array(x), step), F.lit(0))
    return x


def strip(x: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.trim(x, F.lit(WHITE_SPACE))


def _strip_whole(x: Column) -> Column:
    """strip for whole texts, which mostly have nothing to lose: their ends are looked at, characters are not counted. x is evaluated several times: give a column or a bound value."""
    white = F.exists(F.array(*map(F.lit, WHITE_SPACE)), lambda c: x.startswith(c) | x.endswith(c))
    return F.when(white, strip(x)).otherwise(x)


def clean_whitespace(x: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def fence_extract(x: Column) -> Column:
    """Content of an XML fence, else of a JSON fence, else the text itself; trimmed."""
    found = F.when(x.rlike("(?i)```xml"), F.regexp_extract(x, XML_FENCE, 1)).when(x.rlike("(?i)```json"), F.regexp_extract(x, JSON_FENCE, 1))
    # A text without a fence is not searched for its kinds.
    return F.when(x.contains("```"), strip(found.otherwise(x))).otherwise(_strip_whole(x))


def xml_start_extract(x: Column) -> Column:
    """From the first XML start to the end, without a closing fence."""
    found = F.when(x.rlike(XML_START), F.regexp_replace(F.regexp_extract(x, XML_START, 0), "```$", ""))
    return strip(found.otherwise(x))


def corrected_xml_pick(x: Column) -> Column:
    """The response if it starts as XML, else its XML fence, else null."""
    return F.when(strip(x).startswith("<"), strip(x)).when(x.rlike("(?i)```xml"), strip(F.regexp_extract(x, XML_FENCE, 1)))


def strip_bom_trim(x: Column) -> Column:
    return F.ltrim(_strip_whole(x), F.lit("﻿"))


def fix_truncated_tag(x: Column) -> Column:
    return F.when(x.contains("\n"), F.regexp_replace(x, TRUNCATED_TAG, "$2")).otherwise(x)


def fix_align_cell(x: Column) -> Column:
    return F.when(x.contains('<align="'), F.regexp_replace(x, ALIGN_CELL, '<td align="$1">$2</td>')).otherwise(x)


def drop_break(x: Column) -> Column:
    return F.when(x.contains("<break"), F.regexp_replace(x, BREAK, "")).otherwise(x)


def dedupe_xml_decl(x: Column) -> Column:
    """With two or more XML declarations: from the first one on, the others cut out."""
    parts = F.split(x, r"<\?xml")
    # The text after the first "?>" of a part, not after its last.
    rest = F.transform(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))),
        lambda p: F.when(F.instr(p, "?>") > 0, F.right(p, F.length(p) - F.instr(p, "?>") - 1)).otherwise(""))
    # Few texts have a declaration, and those without are not split.
    return F.when(x.contains("<?xml") & (F.size(parts) > 2), F.concat(F.lit("<?xml"), F.element_at(parts, 2), F.array_join(rest, ""))).otherwise(x)


def ensure_article_root(x: Column) -> Column:
    def rooted(bare: Column) -> Column:
        opened = bare.startswith("<article") | bare.startswith("<?xml")
        return F.concat(F.when(opened, "").otherwise("<article>\n"), x, F.when(bare.endswith("</article>"), "").otherwise("\n</article>"))

    return bound(x, _strip_whole, rooted)


def sanitize_text(x: Column) -> Column:
    """The string steps of the clean-up, in order."""
    return bound(x, strip_bom_trim, fix_truncated_tag, fix_align_cell, drop_break, dedupe_xml_decl, ensure_article_root)


#: How calls write their token counts.
TOKEN_BLOCK = r"\{[^\}]*token[^\}]*\}"
TOKEN_COUNT = r"(?i){what}{gap}tokens\D*(\d+)"


def token_metrics(x: Column) -> Column:
    """struct<total, prompt, completion, found>: counts in a braces block that names tokens, else in plain text."""
    block = F.regexp_extract(x, TOKEN_BLOCK, 0)

    def number(text: Column, what: str, gap: str) -> Column:
        return F.regexp_extract(text, TOKEN_COUNT.format(what=what, gap=gap), 1).try_cast("bigint")

    inner = [number(block, w, r"[_\s-]*") for w in ("total", "prompt", "completion")]
    plain = [number(x, w, r"\s*") for w in ("total", "prompt", "completion")]
    good = (block != "") & ((F.coalesce(inner[0], F.lit(0)) > 0) | (F.coalesce(inner[1], F.lit(0)) > 0))
    # Counts of a block that lacks total and prompt stay unless the plain text has its own.
    names = ("total", "prompt", "completion")
    values = [F.when(good, a).otherwise(F.coalesce(b, F.when(block != "", a))).alias(n) for n, a, b in zip(names, inner, plain, strict=True)]
    found = good | plain[0].isNotNull() | plain[1].isNotNull() | plain[2].isNotNull()
    return F.struct(*values, found.alias("found"))


def call_error_classify(x: Column) -> Column:
    """rate_limit, recitation or other; null without an error."""
    rate = x.contains("429") | x.contains("Quota exceeded") | F.lower(x).contains("rate_limit")
    recitation = x.contains("Recitation") | x.contains("FinishReason.RECITATION")
    return F.when(x.isNull(), None).when(rate, "rate_limit").when(recitation, "recitation").otherwise("other")


def json_object_slice(x: Column) -> Column:
    """Without fences, from the first { to the last }."""
    bare = F.replace(F.regexp_replace(x, r"```json\s*", ""), F.lit("```"), F.lit(""))
    return strip(F.when(bare.rlike(r"(?s)\{.*\}"), F.regexp_extract(bare, r"(?s)\{.*\}", 0)).otherwise(bare))


def xml_presanitize(x: Column) -> Column:
    """Declaration, DOCTYPE and the first article element, bare ampersands escaped; null without an article."""
    x = F.translate(x, "\x0b\x0c", "  ")
    declared = F.regexp_extract(x, r"<\?xml[^>]*?>", 0)
    declared = F.when(declared == "", '<?xml version="1.0" encoding="UTF-8"?>').otherwise(declared)
    doctype = F.nullif(F.regexp_extract(x, r"<!DOCTYPE[^>]*?>", 0), F.lit(""))
    article = F.nullif(F.regexp_extract(x, r"(?s)<article.*?</article>", 0), F.lit(""))
    return F.when(article.isNotNull(), F.regexp_replace(F.concat_ws("\n", declared, doctype, article), BARE_AMPERSAND, "&amp;"))


def doctype(version: str) -> str:
    return f'<!DOCTYPE article PUBLIC "-//NLM//DTD JATS (Z39.96) Journal Publishing DTD with MathML3 v{version} 2024//EN" "JATS-journalpublishing{version.replace(".", "-")}-mathml3.dtd">'


def doctype_rewrite(x: Column, version: str) -> Column:
    return F.regexp_replace(x, r"(?s)<!DOCTYPE.*?>", doctype(version))


def xml_output(x: Column, version: str) -> Column:
    """One declaration, the DOCTYPE of the version, and the article without its own declaration."""
    bare = F.when(x.startswith("<?xml") & x.contains("?>"), strip(F.right(x, F.length(x) - F.instr(x, "?>") - 1))).otherwise(x)
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n{doctype(version)}\n'), bare)


def _tag_pattern(tag: str) -> str:
    return rf"(?si)(<{tag}(?:>|\s[^>]*>))(.*?)(</{tag}>)"


def _valid_tag(tag: str) -> bool:
    return tag[:1].isascii() and tag[:1].isalpha() and tag.replace("-", "").isascii() and tag.replace("-", "").isalnum()


def tag_extract(x: Column, tag: str) -> Column:
    """Inner text of the first <tag> in the first part of the document; '' without one or for a bad name."""
    return strip(F.regexp_extract(F.substring(x, 1, TAG_SEARCH), _tag_pattern(tag), 2)) if _valid_tag(tag) else F.lit("")


def escape_xml(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape_html(x: Column) -> Column:
    x = escape_xml(x)
    return F.replace(F.replace(x, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def tag_inject(x: Column, tag: str, value: Column, scope: str = "front") -> Column:
    """Puts value into <tag>: its first occurrence in front, or with scope 'all' every occurrence."""
    if not _valid_tag(tag):
        return x
    value = value if tag in MARKUP_TAGS else escape_xml(value)
    # The value is literal: backslashes and dollars have no meaning in it.
    literal = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    if scope == "all":
        return F.regexp_replace(x, F.lit(_tag_pattern(tag)), F.concat(F.lit("$1"), literal, F.lit("$3")))
    front = F.regexp_extract(x, r"(?s)^.*?</front>", 0)
    head = F.regexp_replace(front, F.lit(rf"(?si)^(.*?<{tag}(?:>|\s[^>]*>))(.*?)(</{tag}>)"), F.concat(F.lit("$1"), literal, F.lit("$3")))
    return F.concat(head, F.right(x, F.length(x) - F.length(front)))


def strip_ref_number(x: Column, label: Column) -> Column:
    """Without the label's digits in front, and the point, hyphen, bracket or blanks after them, unless nothing would be left."""
    digits, text = F.regexp_replace(label, r"[^\d]", ""), F.regexp_replace(x, r"(?U)^\s+", "")
    rest = strip(F.regexp_replace(F.right(text, F.length(text) - F.length(digits)), r"(?U)^[.\-\s)]*", ""))
    return F.when((digits != "") & text.startswith(digits) & (rest != ""), rest).otherwise(x)


def author_split(x: Column) -> Column:
    """Comma-separated names: the last word is the surname."""
    names = F.filter(F.transform(F.split(x, ","), strip), lambda n: n != "")

    def one(n: Column) -> Column:
        words = F.split(n, " ")
        return F.struct(F.array_join(F.slice(words, 1, F.size(words) - 1), " ").alias("given_names"), F.element_at(words, -1).alias("surname"), F.lit("").alias("aff_id"))

    return F.transform(names, one)


def author_display(authors: Column) -> Column:
    """'Given Surname, ...' of an array of structs; nameless authors are left out."""
    full = F.transform(authors, lambda a: F.trim(F.concat(F.coalesce(a["given_names"], F.lit("")), F.lit(" "), F.coalesce(a["surname"], F.lit("")))))
    return F.array_join(F.filter(full, lambda n: n != ""), ", ")


def doi_url(doi: Column) -> Column:
    return F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("https://doi.org/"), doi))


def orcid_url(orcid: Column) -> Column:
    bare = F.trim(F.coalesce(orcid, F.lit("")))
    return F.when(bare == "", None).when(F.lower(bare).startswith("http"), bare).otherwise(F.concat(F.lit("https://orcid.org/"), bare))


def orcid_short(orcid: Column) -> Column:
    return F.regexp_extract(F.rtrim(orcid_url(orcid), F.lit("/")), "[^/]+$", 0)


def model_label_strip(x: Column) -> Column:
    return F.when(x.startswith("[") & x.contains("] "), F.right(x, F.length(x) - F.instr(x, "] ") - 1)).otherwise(x)


def is_separator_row(line: Column) -> Column:
    return line.contains("-") & (F.trim(F.translate(line, "|:-", "")) == "")


def pipe_cells(line: Column) -> Column:
    return F.transform(F.split(F.trim(strip(line), F.lit("|")), r"\|"), strip)


def timestamp_display(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")

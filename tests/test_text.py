"""Golden cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from folia.functions import quality as Q
from folia.functions import text as X
from folia.operators import assemble as A


def value(spark, make, *args):
    df = spark.createDataFrame([args], [f"c{k}" for k in range(len(args))]) if all(a is not None for a in args) else spark.createDataFrame([args],
        ", ".join(f"c{k} string" for k in range(len(args))))
    return df.select(make(*[F.col(c) for c in df.columns])).first()[0]


@pytest.mark.parametrize(("text", "found"), [("<!-- ab -->", True), ("<!--x-->", False), ("<!-- contenido -->", True), ("<!-- texto\n -->", False)])
def test_lazy_comments(spark, text, found):
    assert bool(value(spark, Q.lazy_comments, text)) is found


@pytest.mark.parametrize(("errors", "complete", "score"), [(0, True, 100), (3, True, 85), (25, True, 0), (3, False, 20), (0, False, 20), (25, False, 0)])
def test_score(spark, errors, complete, score):
    assert value(spark, Q.quality_score, errors, complete) == score


@pytest.mark.parametrize(("label", "body", "out"), [("3", "3. Smith", "Smith"), ("3", "3", "3"), ("3", "33 Smith", "3 Smith"),
    ("x", "3. Smith", "3. Smith"), ("11", "11. Ref", "Ref"), ("2", " 2) A", "A")])
def test_ref_number(spark, label, body, out):
    assert value(spark, X.strip_ref_number, body, label) == out


def test_whitespace_is_unicode(spark):
    assert value(spark, X.clean_whitespace, " a   b\n") == "a b"
    assert value(spark, X.clean_whitespace, None) == ""


def test_presanitize(spark):
    out = value(spark, X.xml_presanitize, "junk<article>a & b &amp; &#12; &x</article>tail")
    assert out == '<?xml version="1.0" encoding="UTF-8"?>\n<article>a &amp; b &amp; &#12; &amp;x</article>'
    assert value(spark, X.xml_presanitize, "no such element") is None


def test_inject_first_in_front_or_all(spark):
    xml = "<front><year>1</year></front><back><year>2</year></back>"
    assert value(spark, lambda x: X.tag_inject(x, "year", F.lit("9$1\\")), xml) == "<front><year>9$1\\</year></front><back><year>2</year></back>"
    assert value(spark, lambda x: X.tag_inject(x, "year", F.lit("<9>"), "all"), xml) == "<front><year>&lt;9&gt;</year></front><back><year>&lt;9&gt;</year></back>"
    assert value(spark, lambda x: X.tag_inject(x, "a b", F.lit("9")), xml) == xml
    assert value(spark, lambda x: X.tag_inject(x, "abstract", F.lit("<p>n</p>"), "all"), "<abstract>o</abstract>") == "<abstract><p>n</p></abstract>"


def test_fences(spark):
    assert value(spark, X.fence_extract, "a ```XML\n<x/>\n``` b") == "<x/>"
    assert value(spark, X.fence_extract, "```json\n{}") == "{}"
    assert value(spark, X.fence_extract, " plain ") == "plain"
    assert value(spark, X.corrected_xml_pick, "no") is None


def test_truncated_and_declarations(spark):
    assert value(spark, X.fix_truncated_tag, "<publisher\n<publisher-name>") == "<publisher-name>"
    assert value(spark, X.dedupe_xml_decl, '<?xml a?><x><?xml b?>y<?xml c ?>z') == "<?xml a?><x>yz"
    assert value(spark, X.ensure_article_root, "<p/>") == "<article>\n<p/>\n</article>"


def test_sanitize_is_idempotent(spark):
    once = value(spark, X.sanitize_text, "﻿<article><break /><p>x</p></article>")
    assert once == "<article><p>x</p></article>" == value(spark, X.sanitize_text, once)


def test_caption_fold_takes_the_part_before_whatever_it_is(spark):
    blocks = spark.createDataFrame([(1, 0, "paragraph", "A"), (1, 1, "table", "x"), (1, 2, "table", "y"), (1, 3, "paragraph", "z")],
        "doc_id int, pos int, kind string, text string")
    parts = A.fold_captions(A.block_parts(blocks)).first()["parts"]
    assert parts[0] == parts[1] == "" and 'caption="[TABLA' in parts[2] and 'caption="A"' in parts[2] and parts[3] == "z"


def test_pad_and_cut_rows(spark):
    df = spark.createDataFrame([(1, "| a | b |\n|---|:-:|\n| c |\n| d | e | f |")], "id int, t string")
    rows = [tuple(r) for r in A.table_cells(df, "t").orderBy("row_no", "cell_no").collect()]
    assert rows == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c"), (1, 1, 1, ""), (1, 2, 0, "d"), (1, 2, 1, "e")]


def test_nulls_do_not_fail(spark):
    df = spark.createDataFrame([(None,)], "c string")
    made = [f(F.col("c")) for f in (X.fence_extract, X.sanitize_text, X.json_object_slice, X.call_error_classify, X.author_split, X.orcid_url,
        X.model_label_strip, Q.lazy_comments, Q.error_explain)]
    assert df.select(*[m.alias(f"m{k}") for k, m in enumerate(made)]).count() == 1


def test_density_rounds_as_the_sql_does(spark):
    import duckdb

    rows = [(641, 640), (6410, 6400), (1, 3), (5, 2), (3201, 3200), (321, 320), (1, 128), (0, 7), (10**9, 7), (4, 0), (0, 0), (None, 3), (3, None)]
    found = spark.createDataFrame(rows, "n int, total bigint").select(Q.density(F.col("n"), F.col("total"))).collect()
    values = ", ".join(f"({'null' if n is None else n}, {'null' if t is None else t}::bigint)" for n, t in rows)
    assert [str(r[0]) for r in found] == [str(r[0]) for r in duckdb.sql(f"select round(n / t, 6) from (values {values}) as v(n, t)").fetchall()]
    assert found[0][0] == 1.001562


def test_rounding_goes_away_from_zero_at_halves(spark):
    got = spark.createDataFrame([(x,) for x in (2.5, -2.5, 3.5, 0.49999999999999994, 1e300, -0.2)], "x double").select(Q.rounded(F.col("x"), 0)).collect()
    assert [r[0] for r in got] == [3.0, -3.0, 4.0, 0.0, 1e300, 0.0]


def test_texts_that_need_no_step_are_left_as_the_steps_would_leave_them(spark):
    import re

    texts = ["", " ", "x", " x", "x　", "﻿ x", "﻿<article>é</article>\n", "<a\n<b>", "<a <b>", "a\n\n<b\n <c>", "```XML\n<a/>\n```", "`` ```json {}``` ", "no ``` kind ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", X.fence_extract(F.col("x")).alias("f"), X.strip_bom_trim(F.col("x")).alias("b"),
        X.fix_truncated_tag(F.col("x")).alias("t"), X._strip_whole(F.col("x")).alias("w"), X.strip(F.col("x")).alias("s")).collect()
    for r in rows:
        assert r["w"] == r["s"]
        if r["x"] is None:
            assert r["f"] is r["b"] is r["t"] is None
            continue
        assert r["b"] == r["x"].strip(X.WHITE_SPACE).lstrip("﻿") and r["t"] == re.sub(X.TRUNCATED_TAG, r"\2", r["x"])
        found = re.search("(?si)```xml\\s*(.*?)(?:```|$)", r["x"]) or re.search("(?si)```json\\s*(.*?)(?:```|$)", r["x"])
        assert r["f"] == (found[1] if found else r["x"]).strip(X.WHITE_SPACE)

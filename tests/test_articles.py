"""Cases of the node table, extraction and validation."""

from xml.etree import ElementTree

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folia.functions.xml_tree import Columns, read, read_into
from folia.operators import candidates as E
from folia.operators import extract as X
from folia.operators import nodes as N
from folia.operators import usage as G
from folia.operators import validate as V


def table(spark, *xml):
    return N.node_table(spark.createDataFrame(list(enumerate(xml)), "doc_id bigint, xml string"))


names = st.sampled_from(["p", "sec", "italic", "a-b"])
texts = st.text("ab <&>\"'\né", max_size=6)


def build(tree):
    tag, text, children, tail = tree
    e = ElementTree.Element(tag, {"id": text} if len(text) % 2 else {})
    e.text, e.tail = text, tail
    for c in children:
        e.append(build(c))
    return e


trees = st.recursive(st.tuples(names, texts, st.just([]), texts), lambda inner: st.tuples(names, texts, st.lists(inner, max_size=4), texts), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(trees)
def test_reader_equals_a_strict_parser_on_wellformed_input(tree):
    root = build(tree)
    root.tail = None
    xml = ElementTree.tostring(root, encoding="unicode")
    nodes, error = read(xml)
    assert error is None
    flat = list(root.iter())
    # Line ends inside attributes become spaces for a strict parser.
    assert [(n["tag"], n["text"], n["tail"]) for n in nodes] == [(e.tag, e.text or "", e.tail or "") for e in flat]
    assert all(n["parent_id"] < n["node_id"] <= n["end_id"] for n in nodes)


@settings(max_examples=200, deadline=None)
@given(st.text("<>/a!-[]?&;\"'= ", max_size=40))
def test_reader_never_fails(text):
    nodes, error = read(text)
    assert all(n["parent_id"] < n["node_id"] <= n["end_id"] < len(nodes) for n in nodes)
    assert nodes or error


@pytest.mark.parametrize(("xml", "ok"), [("<a>&nbsp;</a>", False), ("<a><b></a>", False), ("<a/>", True), ("", False),
    ("<!DOCTYPE a [<!ENTITY x 'y'>]><a>t</a>", True), ("<a/><b/>", False)])
def test_parse_ok(xml, ok):
    assert (read(xml)[1] is None) is ok


def test_authors(spark):
    front = """<article><front><article-meta><contrib-group>
      <contrib contrib-type="author" corresp="no"><name><surname>S</surname><given-names>G</given-names></name><xref ref-type="aff" rid="a1"/><xref ref-type="aff" rid="zz"/><email>e@x</email><xref ref-type="corresp" rid="c1"/></contrib>
      <contrib contrib-type="author"><collab>Group <italic>X</italic></collab><aff>Inline</aff><contrib-id contrib-id-type="orcid">0000-1</contrib-id></contrib>
      <contrib contrib-type="author"></contrib><contrib contrib-type="editor"><name><surname>Z</surname></name></contrib></contrib-group>
      <aff id="a1">First <b>Inst</b></aff><author-notes><corresp id="c1">Mail: <email>n@x</email></corresp></author-notes></article-meta></front></article>"""
    rows = [r.asDict() for r in X.authors(table(spark, front)).orderBy("pos").select("full", "orcid", "corresponding", "affiliations", "emails").collect()]
    assert rows == [
        {"full": "G S", "orcid": "", "corresponding": True, "affiliations": ["First Inst"], "emails": ["e@x", "n@x"]},
        {"full": "Group X", "orcid": "0000-1", "corresponding": False, "affiliations": ["Inline"], "emails": []},
    ]


def test_sections_and_toc(spark):
    n = table(spark, "<article><body><sec><title>A</title><sec><p>x</p></sec><sec><label>L</label><p/></sec></sec><sec/></body></article>")
    secs = X.sections(n)
    assert [(r["id"], r["title"]) for r in secs.orderBy("node_id").collect()] == [("sec-1", "A"), ("sec-1", "Section 1"), ("sec-2", "Section 2"), ("sec-2", "Section 2")]
    toc = X.section_toc(secs).orderBy("node_id").collect()
    assert [(r["level"], r["number"], r["shown"]) for r in toc] == [(1, "1", "1"), (2, "1.1", "1.1"), (2, "1.2", "L"), (1, "2", "2")]


def test_cells_headers_first(spark):
    n = table(spark, '<article><body><table-wrap id="t"><label>T</label><caption><p>C</p></caption><table><tr><td>1</td><th>2</th></tr><tr/></table></table-wrap></body></article>')
    assert [(r["cell_pos"], r["doc_pos"], r["text"]) for r in X.table_cells(n).orderBy("cell_pos").collect()] == [(1, 2, "2"), (2, 1, "1")]
    assert X.tables(n).select("id", "label", "caption").first() == ("t", "T", "C")


def test_figures_and_references(spark):
    n = table(spark, '<article><body><fig><caption><p>c</p></caption><graphic xlink:href="a.png"/></fig></body><back><ref-list><ref id="r1"><label>11</label>11. Ref</ref><ref id="r2"><element-citation><source>B</source></element-citation><mixed-citation>M</mixed-citation></ref></ref-list></back></article>')
    assert X.figures(n).select("id", "caption", "href").first() == ("fig-1", "c", "a.png")
    assert [r["html"] for r in X.references(n).orderBy("pos").collect()] == ["Ref", "M"]


def test_dates(spark):
    n = table(spark, '<article><front><article-meta><pub-date><day>4</day></pub-date><pub-date><day>5</day><year>2020</year></pub-date><history><date date-type="received"><day>1</day><month>2</month><year>2019</year></date></history></article-meta></front></article>')
    assert X.pub_date(n).first()["pub_date"] == "2020"
    assert tuple(X.history_dates(n).first()) == (0, "received", "1", "2", "2019")


def test_orphan_tables(spark):
    xml = '<article><body><sec id="s1"><p><xref ref-type="table" rid="t1">1</xref></p></sec><table-wrap id="t1"><p>T1</p></table-wrap><table-wrap id="t2"><p>T2</p></table-wrap><table-wrap><p>n</p></table-wrap><table-wrap-foot>f</table-wrap-foot></body></article>'
    docs = spark.createDataFrame(list(enumerate((xml, "<article><body><table-wrap-foot>f</table-wrap-foot></body></article>"))), "doc_id bigint, xml string")
    out = N.move_orphans(docs, N.node_table(docs)).collect()
    assert [r["xml"] for r in out] == ['<article><body><sec id="s1"><p><xref ref-type="table" rid="t1">1</xref></p><table-wrap id="t1"><p>T1</p></table-wrap></sec><table-wrap><p>n</p></table-wrap><sec sec-type="supplementary-material"><title>Supplementary material</title><table-wrap id="t2"><p>T2</p></table-wrap></sec></body></article>']


def test_rules(spark):
    n = table(spark, '<article><front><article-meta/></front><body><sec id="i"><foo/><break align="x"/></sec><sec id="i"><title>t</title><p><xref rid="q i"/></p></sec></body></article>')
    rules = {(r["rule"], r["node_id"]) for r in V.validate(n).collect()}
    kinds = {k for k, _ in rules}
    assert {"undeclared element", "content model", "duplicate id", "dangling reference"} <= kinds
    assert ("content model", 1) in rules  # front without journal-meta


def test_leaderboard_ties_keep_roster_order(spark):
    df = spark.createDataFrame([(1, 2, 100), (1, 0, 100), (1, 1, 100)], "doc_id int, roster_idx int, score int")
    assert [r["roster_idx"] for r in E.leaderboard(df).orderBy("rank").collect()] == [0, 1, 2]
    over = spark.createDataFrame([(1, 9)], "doc_id int, roster_idx int")
    assert E.winners(E.leaderboard(df), over).select("roster_idx", "overridden").first() == (0, False)


@pytest.mark.parametrize(("used", "band"), [(0, "ok"), (399, "ok"), (400, "nearly exhausted"), (499, "nearly exhausted"), (500, "exhausted")])
def test_quota_bands(spark, used, band):
    rows = spark.range(max(used, 1)).select(F.lit("unknown").alias("model"), F.to_timestamp(F.lit("2024-01-15" if used else "2024-01-14")).alias("ts"))
    out = G.quota_status(rows, "2024-01-15").first()
    assert out["rpd"] == 500 and out["band"] == band and out["used"] == used


def test_document_types_take_linear_time():
    import time

    from folia.functions.xml_tree import read

    start = time.time()
    for part in ("<!DOCTYPE a [", "<!DOCTYPE a ", "<!DOCTYPE a [ ] ", '<!DOCTYPE a [<!ENTITY b "c">'):
        read(part * 100_000)
    assert time.time() - start < 10
    (typed,), (plain,) = (read(x)[0] for x in ('<!DOCTYPE a SYSTEM "x" [<!ENTITY b "c">\n] ><a>t</a>', "<a>t</a>"))
    assert {k: v for k, v in typed.items() if not k.startswith("src_")} == {k: v for k, v in plain.items() if not k.startswith("src_")}
    assert read("<!DOCTYPE a><a/>")[1] is None and read("<!DOCTYPE a [ <a/>")[1] == "doctype without end at 0"


def test_grammar_versions_differ_in_their_own_number(spark):
    from folia.sources.grammar import VERSIONS, attr_decl, content_model

    models = [sorted(tuple(r)[1:] for r in content_model(spark, v).collect()) for v in VERSIONS]
    assert models[0] == models[1]
    declared = [{(r["element"], r["attribute"]): r["allowed"] for r in attr_decl(spark, v).collect()} for v in VERSIONS]
    assert {k for k in declared[1] if declared[0][k] != declared[1][k]} == {("article", "dtd-version")}
    assert "1.4" in declared[1]["article", "dtd-version"] and "1.4" not in declared[0]["article", "dtd-version"]


def test_paths_and_texts_stay_linear_in_deep_documents():
    sizes = []
    for depth in (2000, 8000):
        out = Columns()
        read_into(out, "<p>x" * depth)
        lists = out.lists()
        assert lists["content"][0] == b"x" * depth and lists["text_to"][0] == depth and lists["para_id"][-1] == depth - 2
        sizes.append(sum(len(str(x)) for column in lists.values() for x in column))
    assert sizes[1] < 5 * sizes[0]


def test_body_audit_on_nodes(spark):
    docs = ["<article><body><p>a &amp; b<![CDATA[<c>]]></p><!-- no text --> </body></article>", "<article/>", "<article><body><p>x</body></article>", "", "<article><body/></article>"]
    rows = N.node_rows(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, xml string"))
    found = {r["doc_id"]: (r["parse_ok"], r["body_text"]) for r in V.body_audit(rows).collect()}
    assert found == {0: (True, "a & b<c>"), 1: (True, ""), 2: (False, None), 3: (False, None), 4: (True, "")}


def test_clean_up_moves_tables_of_wellformed_texts_only(spark):
    loose = '<article><body><sec><p><xref ref-type="table" rid="t"/></p></sec><table-wrap id="t" xmlns:xlink="x" xlink:href="u"><p>T</p></table-wrap> tail</body></article>'
    docs = spark.createDataFrame([(1, loose), (2, loose.replace("</p></sec>", "</sec>")), (3, None), (4, "<article><break/></article>")], "doc_id bigint, xml string")
    out = {r["doc_id"]: r["xml"] for r in N.clean_articles(docs, lambda x: x.cache()).collect()}
    assert out[1] == '<article><body><sec><p><xref ref-type="table" rid="t"/></p><table-wrap id="t" xmlns:xlink="x" xlink:href="u"><p>T</p></table-wrap> tail</sec></body></article>'
    assert out[2] == loose.replace("</p></sec>", "</sec>") and out[4] == "<article></article>" and len(out) == 4


def test_scoring_reads_only_the_columns_that_it_needs(spark):
    from folia.plans import jobs as J

    kept, docs = [], ["<article><body><p>x</p></body></article>", "<article><p></article>", ""]

    def keep(df):
        kept.append(df.columns)
        return df.cache()

    cands = spark.createDataFrame([(k, 0, x) for k, x in enumerate(docs)], "doc_id bigint, roster_idx int, xml string")
    board = {r["doc_id"]: r["n_errors"] for r in J.score_candidates(cands, keep).collect()}
    assert kept[1] == ["doc_id", "roster_idx", *(n for n in N._KINDS if n in V.READ), "parse_error"] and "text" not in kept[1]
    whole = V.verdicts(cands, V.validate(N.node_table(cands, "xml", "doc_id", "roster_idx"), "1.4", "doc_id", "roster_idx"), "doc_id", "roster_idx")
    assert {r["doc_id"]: r["n_errors"] for r in whole.collect()} == {k: n - (k > 0) for k, n in board.items()}  # and a syntax error each
    everything = N.node_rows(cands, "xml", "doc_id", "roster_idx")
    some = N.node_rows(cands, "xml", "doc_id", "roster_idx", fields=V.READ)
    assert sorted(map(str, everything.select(some.columns).collect())) == sorted(map(str, some.collect()))


def test_content_errors_name_the_state_and_the_child(spark):
    n = table(spark, "<article><front/><p/><p/></article>", "<sec><title/></sec>", "<fig-group/>", "<nope><p/></nope>", "<title-group/>")
    found = {(r["doc_id"], r["rule"]): r["message"] for r in V.content_errors(n).where("node_id = 0").collect()}
    assert found[0, "content model"].endswith("got (p) as child 2") and found[4, "content model"].endswith("got (nothing more) after child 0")
    assert (3, "undeclared element") in found


def test_held_texts_equal_those_cut_from_the_document(spark):
    docs = ['<article><body><table-wrap><caption><title>a <b>é</b></title><p>x</p></caption><table><tr><td>1 <i>2</i><table><tr><td>3<td><b>4</b>5</td></td><th/></tr></table></td></tr></table></table-wrap><p>q <p>r <b>s</b></p><p>t</p></p></body></article>',
        "<article><body><sec><label>&lt;<b/>1</label><title>T</title><p> u &amp; v </p><p><italic>w</italic></p></sec><td>open"]
    data = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, xml string")
    whole, some = N.node_table(data), N.node_table(data, fields=X.READ)
    cut = X.subtree_text(whole, F.col("tag").isin(*X.HOLDERS)).select("doc_id", "top_id", "text")
    assert sorted(X.held_text(some, F.lit(True)).select(cut.columns).collect()) == sorted(cut.collect())
    # Paragraphs of text alone, and those that others stand in.
    html = {(r["doc_id"], r["top_id"]): r["html"] for r in X.inline_of(some, some.where("tag = 'p'")).collect()}
    assert sorted(html.values()) == sorted(["x", "q r <strong>s</strong>t", "r <strong>s</strong>", "t", "u &amp; v", "<em>w</em>"])
    assert {r["html"] for r in X.inline_of(some, some.where("tag = 'title'")).collect()} == {"a <strong>é</strong>", "T"}
    assert X.sections(some).select("paragraphs").collect() == [(["u &amp; v", "<em>w</em>"],)]

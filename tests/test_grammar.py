"""Every element of the grammar, by itself: a shortest valid content gets no error, a stranger among its children gets one."""

import pytest

from folia.operators import nodes as N
from folia.operators import validate as V
from folia.sources import grammar as G


def shortest():
    """A valid element of each name as XML, by growing depth; children by a shortest run of the automaton."""
    made, automata = {}, G.automata()
    required = {}
    for d in G.attributes():
        if d.required:
            required.setdefault(d.element, []).append(f' {d.name}="{(d.allowed or ["x"])[0]}"')
    while len(made) < len(automata):
        before = len(made)
        for name, a in automata.items():
            if name in made:
                continue
            paths, todo = {0: ""}, [0]
            while todo:
                state = todo.pop(0)
                for tag, to in a.steps[state].items():
                    if to not in paths and tag in made:
                        paths[to] = paths[state] + made[tag]
                        todo.append(to)
            ends = [paths[s] for s in paths if a.ends[s]]
            if ends:
                made[name] = f"<{name}{''.join(required.get(name, []))}>{min(ends, key=len)}</{name}>"
        assert len(made) > before, set(automata) - set(made)
    return made


@pytest.fixture(scope="module")
def errors(spark):
    rows = []
    for name, xml in shortest().items():
        end = xml.rindex("</")
        rows += [(f"{name} good", xml), (f"{name} stranger", xml[:end] + "<q/>" + xml[end:]), (f"{name} attribute", xml.replace(">", ' zz="1">', 1)), (f"{name} text", xml[:end] + "loose" + xml[end:])]
    nodes = N.node_table(spark.createDataFrame(rows, "doc_id string, xml string")).cache()
    found = {r[0]: [] for r in rows}
    for r in V.content_errors(nodes).unionByName(V.attribute_errors(nodes)).collect():
        found[r["doc_id"]].append((r["node_id"], r["rule"]))
    return found


@pytest.mark.parametrize("name", sorted(G.automata()))
def test_element(errors, name):
    assert errors[f"{name} good"] == []
    assert (0, "content model") in errors[f"{name} stranger"] and any(rule == "undeclared element" for _, rule in errors[f"{name} stranger"])
    assert errors[f"{name} attribute"] == [(0, "undeclared attribute")]
    assert errors[f"{name} text"] == ([] if G.automata()[name].mixed else [(0, "text not allowed")])


@pytest.mark.parametrize(("kind", "good", "bad"), [
    ("ID", ["a", "_b-1", "é:x"], ["1a", "a b", "", "-x"]), ("IDREFS", ["a", "a  b"], ["a 1", ""]), ("NMTOKEN", ["1a", "en-US"], ["a b", "", "a/b"]), ("NMTOKENS", ["1 2"], ["a /"]),
])
def test_value_types(spark, kind, good, bad):
    where = {"ID": ("p", "id"), "IDREFS": ("xref", "rid"), "NMTOKEN": ("p", "lang"), "NMTOKENS": ("index-term", "index-type")}[kind]
    values = [(v, True) for v in good] + [(v, False) for v in bad]
    docs = spark.createDataFrame([(k, f'<{where[0]} {where[1]}="{v}"/>') for k, (v, _) in enumerate(values)], "doc_id bigint, xml string")
    wrong = {r["doc_id"] for r in V.attribute_errors(N.node_table(docs)).collect()}
    assert wrong == {k for k, (_, ok) in enumerate(values) if not ok}


def test_messages_name_the_child_and_what_was_expected(spark):
    docs = spark.createDataFrame([(1, "<name><prefix/></name>"), (2, "<custom-meta><meta-name/></custom-meta>"), (3, "<name><surname/><suffix/><prefix/></name>")], "doc_id bigint, xml string")
    said = {r["doc_id"]: r["message"] for r in V.content_violations(N.node_table(docs)).collect()}
    assert said == {
        1: "Element name content does not follow the DTD, expecting (surname | given-names), got (prefix) as child 1",
        2: "Element custom-meta content does not follow the DTD, expecting (meta-value), got (nothing more) after child 1",
        3: "Element name content does not follow the DTD, expecting (nothing more), got (prefix) as child 3",
    }


def test_valid_articles_of_the_whole_vocabulary_pass(spark):
    xml = """<article dtd-version="9.9"><front><journal-meta><journal-id>j</journal-id><issn>1</issn></journal-meta><article-meta><title-group><article-title>t</article-title></title-group>
 </article-meta></front><body><sec><title>T</title><p><inline-formula><mml:math><mml:mfrac><mml:mi>x</mml:mi><mml:mn>2</mml:mn></mml:mfrac></mml:math><tex-math>x</tex-math></inline-formula><italic toggle="yes">i</italic></p>
 <def-list><def-item><term>a</term><def><p>b</p></def></def-item></def-list></sec></body><back><fn-group><fn fn-type="nonsense"><p>q</p></fn></fn-group></back></article>"""
    n = N.node_table(spark.createDataFrame([(1, xml)], "doc_id int, xml string"))
    assert sorted(r["message"] for r in V.validate(n).collect()) == [
        'Value "9.9" for attribute dtd-version of article is not among the enumerated set', 'Value "nonsense" for attribute fn-type of fn is not among the enumerated set',
    ]

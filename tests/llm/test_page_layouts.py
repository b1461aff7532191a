"""Operator 9 on hand-made pages of many layouts with the text that a reader would call the article."""

import re

import pyarrow.parquet as pq
import pytest

from folia.llm import html_text

LONG = "This is a long paragraph of running text, and it goes on with clauses, commas and further words until it is long enough."
MORE = "A second paragraph follows the first one; it has its own sentences. They are as long as such sentences usually are in print."
SIDE = "Side text may be just as long as the article's own paragraphs, with full sentences, commas and everything else that text has."

#: (name, html, blocks of the article)
LAYOUTS = [
    ("plain article", f"<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>{MORE}</p></article><footer><p>{SIDE}</p></footer></body>", ["Title", LONG, MORE]),
    ("aside inside", f"<article><h1>Title</h1><p>{LONG}</p><aside><p>{SIDE}</p></aside><p>{MORE}</p></article>", ["Title", LONG, MORE]),
    ("long aside inside", f"<article><p>{LONG}</p><aside><h3>Box</h3><p>{SIDE}</p><p>{SIDE} 2</p><p>{SIDE} 3</p><ul><li>{SIDE}</li></ul></aside><p>{MORE}</p></article>", [LONG, MORE]),
    ("nav inside", f"<article><nav><p>{SIDE}</p><ul><li><a href=a>Part one</a></li></ul></nav><p>{LONG}</p><p>{MORE}</p></article>", [LONG, MORE]),
    ("footer inside", f"<article><p>{LONG}</p><p>{MORE}</p><footer><p>{SIDE}</p></footer></article>", [LONG, MORE]),
    ("header inside", f"<article><header><h1>Title</h1><p>{SIDE}</p></header><p>{LONG}</p></article>", ["Title", LONG]),
    ("site header", f"<body><header><h1>The Site</h1><p>{SIDE}</p></header><main><p>{LONG}</p><p>{MORE}</p></main></body>", [LONG, MORE]),
    ("form inside", f"<article><p>{LONG}</p><form><p>{SIDE}</p><label>Mail <input></label></form><p>{MORE}</p></article>", [LONG, MORE]),
    ("comments inside", f"<article><p>{LONG}</p><p>{MORE}</p><div class='comments'><p>{SIDE}</p><p>{SIDE} again</p></div></article>", [LONG, MORE]),
    ("comment list by id", f"<article><p>{LONG}</p><section id='comments'><ol><li><p>{SIDE}</p></li><li><p>{SIDE}</p></li></ol></section></article>", [LONG]),
    ("advert inside", f"<article><p>{LONG}</p><div class='ad-slot sponsored'><p>{SIDE}</p></div><p>{MORE}</p></article>", [LONG, MORE]),
    ("notice inside", f"<article><div class='cookie notice'><p>{SIDE}</p></div><p>{LONG}</p><p>{MORE}</p></article>", [LONG, MORE]),
    ("linked list inside", f"<article><h2>Sources</h2><p>{LONG}</p><h2>List</h2><ul><li><a href=x>linked item</a></li><li>plain</li></ul></article>", ["Sources", LONG, "List", "linked item", "plain"]),
    ("short list inside", f"<article><p>{LONG}</p><ul><li>one</li><li>two</li><li>three</li></ul><p>{MORE}</p></article>", [LONG, "one", "two", "three", MORE]),
    ("all linked list inside", f"<article><p>{LONG}</p><ol><li><a href=a>first link</a></li><li><a href=b>second link</a></li></ol><p>{MORE}</p></article>", [LONG, "first link", "second link", MORE]),
    ("table inside", f"<article><p>{LONG}</p><table><tr><th>a</th><td>1</td></tr><tr><th>b</th><td>2</td></tr></table></article>", [LONG, "a", "1", "b", "2"]),
    ("quote, code and caption", f"<article><p>{LONG}</p><blockquote><p>Short quote</p></blockquote><pre>x = 1</pre><figure><figcaption>A caption</figcaption></figure></article>", [LONG, "Short quote", "x = 1", "A caption"]),
    ("definition list", f"<article><p>{LONG}</p><dl><dt>term</dt><dd>its meaning</dd></dl></article>", [LONG, "term", "its meaning"]),
    ("main with sidebar", f"<body><div class='wrap'><main><p>{LONG}</p><p>{MORE}</p></main><div class='sidebar'><p>{SIDE}</p><p>{SIDE}</p></div></div></body>", [LONG, MORE]),
    ("no article element", f"<body><div class='menu'><a href=x>Home</a></div><div class='content'><h1>Title</h1><p>{LONG}</p><p>{MORE}</p></div><div class='footer'><p>{SIDE}</p></div></body>", ["Title", LONG, MORE]),
    ("sections of an article", f"<article><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>{MORE}</p></section></article>", ["One", LONG, "Two", MORE]),
    ("share bar and related", f"<article><h1>Title</h1><div class='share'><a href=x>Share</a></div><p>{LONG}</p><p>{MORE}</p><div class='related'><h3>Read on</h3><ul><li><a href=a>Other story</a></li></ul></div></article>", ["Title", LONG, MORE]),
    ("dialog and menu inside", f"<article><dialog><p>{SIDE}</p></dialog><p>{LONG}</p><menu><li>Copy</li></menu></article>", [LONG]),
    ("body class with sidebar", f"<body class='has-sidebar'><article><p>{LONG}</p><p>{MORE}</p></article><div class='sidebar'><p>{SIDE}</p></div></body>", [LONG, MORE]),
    ("linked paragraph", f"<article><p>{LONG}</p><p><a href=x>Read the report</a></p><p>{MORE}</p></article>", [LONG, "Read the report", MORE]),
    ("two articles", f"<body><article><h2>A</h2><p>{LONG}</p></article><article><h2>B</h2><p>{MORE}</p></article></body>", ["A", LONG, "B", MORE]),
]


@pytest.fixture(scope="module")
def models():
    batch = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).combine_chunks().to_batches()[0]
    rows = html_text._count(batch)
    return {"trained": html_text.Model(dict(zip(zip(rows["what"], rows["value"], rows["label"]), rows["n"]))), "untrained": html_text.Model({})}


@pytest.mark.parametrize("which", ["trained", "untrained"])
@pytest.mark.parametrize("layout", LAYOUTS, ids=lambda x: x[0])
def test_layout(models, which, layout):
    _, html, blocks = layout
    assert html_text.texts_of_pages([html], models[which]) == ["\n\n".join(blocks)]


def test_training_tells_without_names(models):
    """Held-out pages without semantic elements and names: the trained model finds the text, the prior alone does not."""
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"])["html"].to_pylist()[-200:]
    exact = dict.fromkeys(models, 0)
    for html in pages:
        nodes = html_text.parse(html)
        gold = "\n\n".join(n[3] for n, y in zip(nodes, html_text.labels(nodes)) if n[3] and y)
        bare = re.sub(r' (class|id|role)=("[^"]*"|\S+)', "", re.sub(r"<(/?)(article|main|nav|aside|footer|header|form)\b[^>]*>", r"<\1div>", html))
        for name, model in models.items():
            exact[name] += html_text.texts_of_pages([bare], model) == [gold]
    assert exact["trained"] >= 195 and exact["untrained"] < 20

"""Queries of the column functions and document assembly, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions import quality as Q
from folia.functions import text as X
from folia.operators import assemble as A
from folia.operators import calls as H
from folia.operators import manuscripts as M
from folia.plans.fixtures import oracle, run, view
from folia.sources import files as S
from folia.streaming.usage import scratch

QUERIES: dict = {}
SQL: dict = {}
VERSION = "1.4"


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = oracle(sql)


def column(name: str, source: str, keys: str, make, sql: str) -> None:
    """A column function over a view: the keys and the result as ``out``. sql is the DuckDB expression."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, source).select(*keys.split(", "), make().alias("out"))

    register(name, query, f"select {keys}, {sql} as out from {source}")


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_C, _CK = "fx_candidates", "doc_id, roster_idx"


def strip_sql(x: str) -> str:
    return _STRIP.format(x)


def fence_sql(x: str) -> str:
    return strip_sql(f"case when regexp_matches({x}, '(?i)```xml') then regexp_extract({x}, '(?si)```xml\\s*(.*?)(?:```|$)', 1) when regexp_matches({x}, '(?i)```json') then regexp_extract({x}, '(?si)```json\\s*(.*?)(?:```|$)', 1) else {x} end")


def bom_sql(x: str) -> str:
    return f"ltrim({strip_sql(x)}, chr(65279))"


def truncated_sql(x: str) -> str:
    return f"regexp_replace({x}, '<([a-zA-Z][\\w-]*)\\s*\\n\\s*(<[a-zA-Z])', '\\2', 'g')"


def align_sql(x: str) -> str:
    return f"""regexp_replace({x}, '(?s)<align="([^"]*)">(.*?)</align>', '<td align="\\1">\\2</td>', 'g')"""


def break_sql(x: str) -> str:
    return f"regexp_replace({x}, '<break\\s*/>', '', 'g')"


def decl_sql(x: str) -> str:
    return f"""(case when len(string_split({x}, '<?xml')) > 2 then '<?xml' || string_split({x}, '<?xml')[2] || array_to_string(
 [case when instr(p, '?>') > 0 then substr(p, instr(p, '?>') + 2) else '' end for p in string_split({x}, '<?xml')[3:]], '') else {x} end)"""


def root_sql(x: str) -> str:
    t = strip_sql(x)
    head = f"(case when starts_with({t}, '<article') or starts_with({t}, '<?xml') then {x} else '<article>' || chr(10) || {x} end)"
    return f"(case when ends_with({t}, '</article>') then {head} else {head} || chr(10) || '</article>' end)"


#: Raw responses with each defect planted, so that every clean-up step has rows to change.
DEFECTS = "replace(replace(replace(raw_response, '<issn>', '<issn' || chr(10) || '<publisher-x>'), '<volume>', '<align=\"left\">v</align><break /><volume>'), '<body>', '<?xml version=\"1.0\"?><body><?xml version=\"1.0\"?>')"
VIEW_DEFECTS = f"select doc_id, roster_idx, concat(' ', chr(10), {DEFECTS}, ' ') as raw from fx_candidates"


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, VIEW_DEFECTS)


def defect(name: str, make, sql) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = make(F.col("raw"))
        return defects(spark, sf_dir).select("doc_id", "roster_idx", F.length(out).cast("long").alias("n"), F.md5(out).alias("out"))

    register(name, query, f"select doc_id, roster_idx, cast(length(x) as bigint) as n, md5(x) as out from (select doc_id, roster_idx, {sql('raw')} as x from ({VIEW_DEFECTS}) as d) as e")


# B: assembly
_PART = """select doc_id, pos, kind, case when kind = 'image' then chr(10) || '[IMAGEN-PLACEHOLDER file="imagen_' || cast(sum(case when kind = 'image' then 1 else 0 end)
 over (partition by doc_id order by pos) as varchar) || '.png" caption="' || {strip} || '"]' || chr(10) when kind = 'table' then {strip} else text end as part from fx_blocks""".format(strip=strip_sql("text"))
#: A table's place in its run; runs of the view have at most three tables.
_RUNS = f"""select *, r - coalesce(max(case when kind <> 'table' then r end) over (partition by doc_id order by pos), 0) as k from (
 select *, row_number() over (partition by doc_id order by pos) as r from ({_PART}) as p) as q"""


def _table_sql(caption: str, content: str) -> str:
    return f"""'[TABLA-PLACEHOLDER caption="' || {caption} || '" content="' || {content} || '"]'"""


_BEFORE = [f"coalesce({strip_sql(f'lag(part, {k}) over w')}, '')" for k in (1, 2, 3)]
_NESTED = [_BEFORE[0], _table_sql(_BEFORE[1], "lag(part, 1) over w"), _table_sql(_table_sql(_BEFORE[2], "lag(part, 2) over w"), "lag(part, 1) over w")]
_FOLD = f"""select doc_id, pos, case when lead(kind) over w = 'table' and (kind = 'table' or {strip_sql('part')} <> '') then ''
 when kind = 'table' then chr(10) || {_table_sql(f"case k when 1 then {_NESTED[0]} when 2 then {_NESTED[1]} else {_NESTED[2]} end", 'part')} || chr(10)
 else part end as part from ({_RUNS}) as p window w as (partition by doc_id order by pos)"""


def _parts(spark, sf_dir):
    return A.block_parts(view(spark, sf_dir, "fx_blocks"))


register("b1_paragraph_text", lambda s, d: _parts(s, d).where("kind = 'paragraph'").select("doc_id", "pos", "part"),
    "select doc_id, pos, text as part from fx_blocks where kind = 'paragraph'")
register("b2_image_placeholder", lambda s, d: _parts(s, d).where("kind = 'image'").select("doc_id", "pos", "part"),
    f"select doc_id, pos, part from ({_PART}) as p where kind = 'image'")
register(
    "b3_table_flatten",
    lambda s, d: view(s, d, "documents").select("doc_id", A.table_content(F.transform(F.split("text", "\n"), lambda r: F.split(r, " "))).alias("content")),
    f"select doc_id, array_to_string([array_to_string([{strip_sql('c')} for c in string_split(r, ' ')], ' | ') for r in string_split(text, chr(10))], '; ') as content from documents",
)
register("b4_table_caption_fold", lambda s, d: A.fold_captions(_parts(s, d)).select("doc_id",
    F.inline(F.arrays_zip("pos", F.col("parts").alias("part")))).withColumnRenamed("parts", "part"), _FOLD)
register("b5_assemble_text", lambda s, d: A.assemble(view(s, d, "fx_blocks")), f"select doc_id, string_agg(part, chr(10) order by pos) as text from ({_FOLD}) as p group by doc_id")
register(
    "b6_metadata_context", lambda s, d: A.head_context(view(s, d, "fx_blocks")),
    "select doc_id, string_agg(text, chr(10) order by pos) as context from (select *, row_number() over (partition by doc_id order by pos) as r from fx_blocks where kind = 'paragraph') where r <= 50 group by doc_id",
)
register(
    "b7_prompt_render",
    lambda s, d: view(s, d, "documents").select("doc_id", A.render(F.lit("v{version} of $1 \\ {lang}: {text_snippet}"), version=F.lit(VERSION),
        text_snippet=F.col("text")).alias("prompt")),
    "select doc_id, concat('v1.4 of $1 \\ {lang}: ', substring(text, 1, 3000)) as prompt from documents",
)


def _meta(spark, sf_dir):
    return M.gate(M.parse_metadata(view(spark, sf_dir, "fx_metadata_raw")))


_BARE = strip_sql("replace(regexp_replace(response, '```json\\s*', '', 'g'), '```', '')")
_JSON = strip_sql(f"case when regexp_matches({_BARE}, '(?s)\\{{.*\\}}') then regexp_extract({_BARE}, '(?s)\\{{.*\\}}', 0) else {_BARE} end")
_PARSED = f"""select doc_id, j, json_valid(j) as ok, case when json_valid(j) then j else null end as v from (select doc_id, {_JSON} as j from fx_metadata_raw) as r"""
_FIELDS = f"""select doc_id, j, ok, json_extract_string(v, '$.article_title') as article_title, json_extract_string(v, '$.journal_title') as journal_title,
 json_extract_string(v, '$.publication_date') as publication_date, case when list_contains(json_keys(v), 'doi') then json_extract_string(v, '$.doi') else json_extract_string(v, '$.roi') end as doi,
 coalesce(json_array_length(v, '$.authors'), 0) as authors from ({_PARSED}) as p"""
_META = [f"meta.{n}" for n in ("article_title", "journal_title", "publication_date", "doi")]
register(
    "b8_metadata_block",
    lambda s, d: _meta(s, d).select("doc_id", A.metadata_block({"title": F.col("meta.article_title"), "journal": F.col("meta.journal_title"),
        "doi": F.col("meta.doi")}).alias("block")),
    f"select doc_id, '- title: ' || coalesce(article_title, 'from the text') || chr(10) || '- journal: ' || coalesce(journal_title, 'from the text') || chr(10) || '- doi: ' || coalesce(doi, 'from the text') as block from ({_FIELDS}) as f",
)
register(
    "b9_correction_prompt_render",
    lambda s, d: view(s, d, "fx_error_messages").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("err_id", "message"))),
        lambda x: x["message"]).alias("errors"))
    .select("doc_id", A.render_correction(F.col("errors"), F.lit("<a/>"), F.when(F.col("doc_id") % 2 == 0, "more"), "interactive").alias("prompt")),
    """select doc_id, '<USER_DOCUMENT_START>' || chr(10) || string_agg('- ' || message, chr(10) order by err_id) || chr(10) || '<USER_DOCUMENT_END>' || chr(10) || '<USER_DOCUMENT_START>' || chr(10) || '<a/>' || chr(10) || '<USER_DOCUMENT_END>' || chr(10)
 || case when doc_id % 2 = 0 then '<USER_DOCUMENT_START>' || chr(10) || 'more' || chr(10) || '<USER_DOCUMENT_END>' else '' end as prompt from fx_error_messages group by doc_id""",
)

# C: clean-up
column("c1_fence_extract", _C, _CK, lambda: F.md5(X.fence_extract(F.col("raw_response"))), f"md5({fence_sql('raw_response')})")
_START = strip_sql("case when regexp_matches(raw_response, '(?s)(<\\?xml|<!DOCTYPE|<article).*') then regexp_replace(regexp_extract(raw_response, '(?s)(<\\?xml|<!DOCTYPE|<article).*', 0), '```$', '') else raw_response end")
column("c2_xml_start_extract", _C, _CK, lambda: F.md5(X.xml_start_extract(F.col("raw_response"))), f"md5({_START})")
_FENCED_XML = r"regexp_extract(raw_response, '(?si)```xml\s*(.*?)(?:```|$)', 1)"
_SPACED = r"regexp_replace(text, '[\s\v]+', ' ', 'g')"
column(
    "c3_corrected_xml_pick", _C, _CK, lambda: F.md5(X.corrected_xml_pick(F.col("raw_response"))),
    f"md5(case when starts_with({strip_sql('raw_response')}, '<') then {strip_sql('raw_response')} when regexp_matches(raw_response, '(?i)```xml') then {strip_sql(_FENCED_XML)} end)",
)
defect("c4_strip_bom_trim", X.strip_bom_trim, bom_sql)
defect("c5_fix_truncated_tag", X.fix_truncated_tag, truncated_sql)
defect("c6_fix_align_cell", X.fix_align_cell, align_sql)
defect("c7_drop_break", X.drop_break, break_sql)
defect("c8_dedupe_xml_decl", X.dedupe_xml_decl, decl_sql)
defect("c9_ensure_article_root", X.ensure_article_root, root_sql)


def sanitize_steps(source: str, column: str) -> str:
    """doc_id, roster_idx, x of a subquery, with the string steps of the clean-up applied to a column, one select per step."""
    sql = f"(select doc_id, roster_idx, {column} as x from {source}) as s"
    for k, step in enumerate((bom_sql, truncated_sql, align_sql, break_sql, decl_sql, root_sql)):
        sql = f"(select doc_id, roster_idx, {step('x')} as x from {sql}) as s{k}"
    return sql


register(
    "c11_sanitize_pipeline", lambda s, d: defects(s, d).select("doc_id", "roster_idx", F.md5(X.sanitize_text(F.col("raw"))).alias("out")),
    f"select doc_id, roster_idx, md5(x) as out from {sanitize_steps(f'({VIEW_DEFECTS}) as d', 'raw')}",
)
_LOG = "case doc_id % 4 when 0 then concat('{\"total_tokens\": ', cast(tokens as string), ', \"prompt_tokens\": ', cast(doc_id as string), '}') when 1 then concat('Total tokens: ', cast(tokens as string), ' completion tokens=', cast(doc_id as string)) when 2 then concat('{token} prompt  Tokens ', cast(doc_id as string)) else 'nothing here' end"
_LOGS = f"select doc_id, roster_idx, {_LOG} as log from fx_candidates"


def _token_sql(what: str, text: str, gap: str) -> str:
    return f"try_cast(regexp_extract({text}, '(?i){what}{gap}tokens\\D*(\\d+)', 1) as bigint)"


_BLOCK = "regexp_extract(log, '\\{[^\\}]*token[^\\}]*\\}', 0)"
_GOOD = f"({_BLOCK} <> '' and (coalesce({_token_sql('total', _BLOCK, '[_\\s-]*')}, 0) > 0 or coalesce({_token_sql('prompt', _BLOCK, '[_\\s-]*')}, 0) > 0))"
_COUNTS = ", ".join(f"case when {_GOOD} then {_token_sql(w, _BLOCK, '[_\\s-]*')} else coalesce({_token_sql(w, 'log', '\\s*')}, {_token_sql(w, _BLOCK, '[_\\s-]*')}) end as {w}" for w in ("total", "prompt", "completion"))
_FOUND = f"({_GOOD} or " + " or ".join(f"{_token_sql(w, 'log', '\\s*')} is not null" for w in ("total", "prompt", "completion")) + ")"
register("c12_token_metrics_scrape", lambda s, d: run(s, d, _LOGS).select("doc_id", "roster_idx",
    X.token_metrics(F.col("log")).alias("m")).select("doc_id", "roster_idx", "m.*"), f"select doc_id, roster_idx, {_COUNTS}, {_FOUND} as found from ({_LOGS}) as l")
_ERRORS = "case o_orderkey % 5 when 0 then concat('HTTP 429 for ', o_orderpriority) when 1 then 'Rate_Limit reached' when 2 then 'FinishReason.RECITATION' when 3 then 'Quota exceeded' else o_orderpriority end"
register(
    "c13_call_error_classify", lambda s, d: run(s, d, f"select o_orderkey, {_ERRORS} as e from orders").select("o_orderkey", X.call_error_classify(F.col("e")).alias("out")),
    f"select o_orderkey, case when contains(e, '429') or contains(e, 'Quota exceeded') or contains(lower(e), 'rate_limit') then 'rate_limit' when contains(e, 'Recitation') or contains(e, 'FinishReason.RECITATION') then 'recitation' else 'other' end as out from (select o_orderkey, {_ERRORS} as e from orders) as o",
)
column("c14_json_object_slice", "fx_metadata_raw", "doc_id", lambda: X.json_object_slice(F.col("response")), _JSON)
register("c15_metadata_parse", lambda s, d: _meta(s, d).select("doc_id", *_META,
    F.coalesce(F.size("meta.authors"), F.lit(0)).cast("long").alias("authors"), "error"),
    f"select doc_id, article_title, journal_title, publication_date, doi, authors, case when not ok then substring(j, 1, 500) end as error from ({_FIELDS}) as f")
register("c16_metadata_normalize", lambda s, d: _meta(s, d).select("doc_id", "meta.doi"), f"select doc_id, doi from ({_FIELDS}) as f")
column("c17_clean_whitespace", "documents", "doc_id", lambda: F.md5(X.clean_whitespace(F.col("text"))), f"md5({strip_sql(_SPACED)})")
_PRE = "concat('lead & text ', chr(12), '<!DOCTYPE x>', replace(xml, 'Short', 'Short & &lt; &#12; &x'), ' tail')"
_PRE_SQL = """replace(replace(p, chr(11), ' '), chr(12), ' ')"""
register(
    "c18_xml_presanitize", lambda s, d: run(s, d, f"select doc_id, {_PRE} as p from fx_article_xml").select("doc_id", F.md5(X.xml_presanitize(F.col("p"))).alias("out")),
    f"""select doc_id, md5(regexp_replace(replace('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || regexp_extract(p, '<!DOCTYPE[^>]*?>', 0) || chr(10) || regexp_extract(p, '(?s)<article.*?</article>', 0), '&', '&amp;'),
 '&amp;([a-zA-Z]+;|#[0-9]+;|#x[0-9a-fA-F]+;)', '&\\1', 'g')) as out from (select doc_id, {_PRE_SQL} as p from (select doc_id, {_PRE} as p from fx_article_xml) as a) as b""",
)
_OLD = "concat('<!DOCTYPE article', chr(10), ' SYSTEM \"x.dtd\">', xml)"
register("c19_doctype_rewrite", lambda s, d: run(s, d, f"select doc_id, {_OLD} as p from fx_article_xml").select("doc_id",
    F.md5(X.doctype_rewrite(F.col("p"), VERSION)).alias("out")), f"select doc_id, md5(regexp_replace({_OLD}, '(?s)<!DOCTYPE.*?>', '{X.doctype(VERSION)}', 'g')) as out from fx_article_xml")
column("c20_tag_extract", "fx_article_xml", "doc_id", lambda: X.tag_extract(F.col("xml"), "article-title"),
    strip_sql("regexp_extract(substring(xml, 1, 500000), '(?si)(<article-title(?:>|\\s[^>]*>))(.*?)(</article-title>)', 2)"))
column("c21_tag_inject", "fx_article_xml", "doc_id", lambda: F.md5(X.tag_inject(F.col("xml"), "volume", F.lit("9 & $1"), "all")),
    "md5(regexp_replace(xml, '(?si)(<volume(?:>|\\s[^>]*>))(.*?)(</volume>)', '\\1' || '9 &amp; $1' || '\\3', 'g'))")
_REF = "select doc_id, case doc_id % 4 when 0 then '3. Smith' when 1 then '3' when 2 then '33 Smith' else 'Smith' end as body, case doc_id % 3 when 0 then 'no. 3' when 1 then '3' else 'x' end as label from documents"
_DIGITS = "regexp_replace(label, '[^0-9]', '', 'g')"
_REST = f"regexp_replace(substr(body, length({_DIGITS}) + 1), '^[.\\-\\s)]*', '')"
register("c22_strip_ref_number", lambda s, d: run(s, d, _REF).select("doc_id", X.strip_ref_number(F.col("body"), F.col("label")).alias("out")),
    f"select doc_id, case when {_DIGITS} <> '' and starts_with(body, {_DIGITS}) and {strip_sql(_REST)} <> '' then {strip_sql(_REST)} else body end as out from ({_REF}) as r")
_NAMES = "select doc_id, concat(source, ' de ', lang, ', ', lang, ',, ', source, ' Z') as names from documents"
register(
    "c23_author_split", lambda s, d: run(s, d, _NAMES).select("doc_id",
        F.posexplode(X.author_split(F.col("names"))).alias("pos", "a")).select("doc_id", F.col("pos").cast("long").alias("pos"), "a.given_names", "a.surname"),
    "select doc_id, unnest(range(len(l))) as pos, unnest([array_to_string(string_split(n, ' ')[:-2], ' ') for n in l]) as given_names, unnest([string_split(n, ' ')[-1] for n in l]) as surname from (select doc_id, list_filter([trim(n) for n in string_split(names, ',')], lambda n: n <> '') as l from (" + _NAMES + ") as a) as b",
)
register(
    "c24_author_display", lambda s, d: _meta(s, d).select("doc_id", X.author_display(F.col("meta.authors")).alias("out")),
    f"select doc_id, case when ok then case when authors > 0 then 'A B C' else '' end end as out from ({_FIELDS}) as f",
)
_LINKS = "select c_custkey, case when c_custkey % 3 = 0 then '' else concat('10.5555/', c_name) end as doi, case c_custkey % 3 when 0 then 'https://orcid.org/0000-1/' when 1 then ' 0000-2 ' else '' end as orcid from customer"
register(
    "c25_doi_orcid_links", lambda s, d: run(s, d, _LINKS).select("c_custkey", X.doi_url(F.col("doi")).alias("doi"),
        X.orcid_url(F.col("orcid")).alias("orcid"), X.orcid_short(F.col("orcid")).alias("short")),
    f"select c_custkey, case when doi <> '' then 'https://doi.org/' || doi end as doi, u as orcid, regexp_extract(rtrim(u, '/'), '[^/]+$', 0) as short from (select c_custkey, doi, case when trim(orcid) = '' then null when starts_with(lower(trim(orcid)), 'http') then trim(orcid) else 'https://orcid.org/' || trim(orcid) end as u from ({_LINKS}) as l) as m",
)
_MODELS = "select usage_id, case usage_id % 3 when 0 then concat('[LOCAL] ', model) when 1 then concat('[x', model) else model end as m from fx_token_usage"
register("c26_model_label_strip", lambda s, d: run(s, d, _MODELS).select("usage_id", X.model_label_strip(F.col("m")).alias("out")),
    f"select usage_id, case when starts_with(m, '[') and contains(m, '] ') then substr(m, instr(m, '] ') + 2) else m end as out from ({_MODELS}) as x")
register(
    "c27_pipe_table_cells", lambda s, d: A.table_cells(view(s, d, "documents").where("text like '%|%'").select("doc_id", "text"),
        "text").select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.col("cell_no").cast("long").alias("cell_no"), "cell"),
    f"""select doc_id, row_no, unnest(range(w)) as cell_no, unnest((cells || list_transform(range(w), lambda i: ''))[:w]) as cell from (
 select doc_id, unnest(range(len(rs))) as row_no, unnest(rs) as cells, len(rs[1]) as w from (
 select doc_id, [[{strip_sql('c')} for c in string_split(trim({strip_sql('l')}, '|'), '|')] for l in string_split(text, chr(10)) if contains(l, '|') and not (contains(l, '-') and trim(translate(l, '|:-', '')) = '')] as rs
 from documents where text like '%|%') as a) as b""",
)
register("c28_timestamp_display", lambda s, d: view(s, d, "events").select("event_id", X.timestamp_display(F.col("ts")).alias("out")),
    "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as out from events")

# A: admission and sinks in column form
_ADMIT = """select doc_id, case when length > 52428800 then 'too large' when lower(regexp_extract(path, '(\\.[^./]*)$', 1)) not in ('.docx', '.pdf') then 'wrong type'
 when not ((lower(regexp_extract(path, '(\\.[^./]*)$', 1)) = '.docx' and substring(head, 1, 4) = 'PK' || chr(3) || chr(4)) or (lower(regexp_extract(path, '(\\.[^./]*)$', 1)) = '.pdf' and substring(head, 1, 4) = '%PDF')) then 'content does not match type' end as reason from fx_manuscripts"""
register("a2_manuscript_admit", lambda s, d: M.admit(view(s, d, "fx_manuscripts").withColumn("content", F.col("head").cast("binary"))).select("doc_id", "reason"), _ADMIT)
_PAGES = "select doc_id, cast(floor(pos / 4) as integer) as page_no, string_agg(text, chr(10) order by pos) as text from fx_blocks group by 1, 2"


def _page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lines a page, all pages written to files and read from there."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    pages = view(spark, sf_dir, "fx_blocks").groupBy("doc_id", F.floor(F.col("pos") / 4).cast("int").alias("page_no")).agg(F.array_join(lines, "\n").alias("text"))
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    pages.write.parquet(path)
    return S.read_pages(spark, path)


register("a5_page_text_source", lambda s, d: A.head_pages(_page_texts(s, d)),
    f"select doc_id, string_agg(text || chr(10), '' order by page_no) as context from ({_PAGES}) as p where page_no < 2 and text <> '' group by doc_id")
_DECL = "case when doc_id % 2 = 0 then concat('<?xml version=\"1.0\"?> ', chr(10), xml) else xml end"


def _written_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    S.write_xml(run(spark, sf_dir, f"select doc_id, {_DECL} as xml from fx_article_xml"), path, VERSION)
    return spark.read.parquet(path)


register(
    "a8_xml_sink", lambda s, d: _written_xml(s, d).select("doc_id", F.md5("xml").alias("out")),
    f"select doc_id, md5('<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '{X.doctype(VERSION)}' || chr(10) || xml) as out from fx_article_xml",
)

# D: audit and scores in string form
_BODY = strip_sql("regexp_replace(regexp_replace(regexp_extract(raw_response, '(?s)<body[^>]*>(.*?)</body>', 1), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')")
_LAZY = "regexp_extract_all(raw_response, '<!--\\s*(?i:contenido|cuerpo|texto|referencias|inserte|...\\s*).*?-->', 0)"
_ERR = "fx_error_messages"
_EM = {k: f"regexp_matches(message, '{p}')" for k, p in (("a", Q.CONTENT_MODEL), ("b", Q.NO_ATTRIBUTE), ("c", Q.UNDECLARED))}
column(
    "d10_error_explain", _ERR, "err_id", lambda: F.concat_ws(" / ", Q.error_category(F.col("message")), Q.error_explain(F.col("message"))),
    f"""case when {_EM['a']} then 'content model / element ' || regexp_extract(message, '{Q.CONTENT_MODEL}', 1) || ' is incomplete or out of order; expected ' || regexp_extract(message, '{Q.CONTENT_MODEL}', 2)
 when {_EM['b']} then 'attribute / attribute ' || regexp_extract(message, '{Q.NO_ATTRIBUTE}', 1) || ' is not allowed in ' || regexp_extract(message, '{Q.NO_ATTRIBUTE}', 2)
 when {_EM['c']} then 'undeclared element / element ' || regexp_extract(message, '{Q.UNDECLARED}', 1) || ' is not known here'
 when len(string_split(message, ':')) > 4 then 'structure / structural problem: ' || trim(array_to_string(string_split(message, ':')[5:], ':')) else 'other / ' || message end""",
)
column("d11_lazy_comments", _C, _CK, lambda: F.concat_ws("|", F.slice(Q.lazy_comments(F.col("raw_response")), 1, 2)), f"array_to_string({_LAZY}[:2], '|')")
column("d12_body_text_audit", _C, _CK, lambda: F.concat_ws("|", F.length(Q.body_text(F.col("raw_response"))).cast("string"),
    (F.length(Q.body_text(F.col("raw_response"))) < 500).cast("string")), f"cast(length({_BODY}) as varchar) || '|' || cast(length({_BODY}) < 500 as varchar)")
_COMPLETE = f"len({_LAZY}) = 0 and length({_BODY}) >= 500"
register(
    "d13_completeness",
    lambda s, d: view(s, d, _C).select("doc_id", "roster_idx", Q.audit_warnings(F.col("raw_response"),
        Q.body_text(F.col("raw_response"))).alias("w")).select("doc_id", "roster_idx", F.concat_ws("; ", "w").alias("warnings"), (F.size("w") == 0).alias("complete")),
    f"select doc_id, roster_idx, concat_ws('; ', case when len({_LAZY}) > 0 then 'comments suggest omitted text: ' || array_to_string({_LAZY}[:2], ', ') end, case when length({_BODY}) < 500 then 'the body is shorter than 500 characters' end) as warnings, {_COMPLETE} as complete from fx_candidates",
)
_SCORES = f"select doc_id, roster_idx, tokens % 25 as n_errors, {_COMPLETE} as complete from fx_candidates"


def _scored(spark, sf_dir):
    w = Q.audit_warnings(F.col("raw_response"), Q.body_text(F.col("raw_response")))
    return view(spark, sf_dir, _C).select("doc_id", "roster_idx", (F.col("tokens") % 25).cast("int").alias("n_errors"),
        w.alias("w")).withColumn("score", Q.quality_score(F.col("n_errors"), F.size("w") == 0))


_SCORE = "cast(case when complete then greatest(0, 100 - 5 * n_errors) else least(20, greatest(0, 100 - 5 * n_errors)) end as integer)"
register("d14_quality_score", lambda s, d: _scored(s, d).select("doc_id", "roster_idx", "score"), f"select doc_id, roster_idx, {_SCORE} as score from ({_SCORES}) as s")
register(
    "d15_score_band", lambda s, d: _scored(s, d).select("doc_id", "roster_idx", Q.score_band(F.col("score")).alias("band"), Q.score_message(F.col("score")).alias("message")),
    f"select doc_id, roster_idx, case when s >= 90 then 'green' when s >= 60 then 'orange' else 'red' end as band, case when s = 100 then 'clean' when s >= 90 then 'minor warnings' else 'structural errors' end as message from (select doc_id, roster_idx, {_SCORE} as s from ({_SCORES}) as s) as t",
)
register("d16_semantic_error_flag", lambda s, d: _scored(s, d).select("doc_id", "roster_idx",
    Q.semantic_error_flag(F.concat(F.array(F.lit("Element x")), "w")).alias("flag")), f"select doc_id, roster_idx, not complete as flag from ({_SCORES}) as s")
_MISSING = "concat_ws(',', case when coalesce(article_title, '') = '' then 'article_title' end, case when coalesce(journal_title, '') = '' then 'journal_title' end, case when coalesce(publication_date, '') = '' then 'publication_date' end, case when coalesce(doi, '') = '' then 'doi' end, case when authors <= 0 then 'authors' end)"
register("d17_required_fields", lambda s, d: _meta(s, d).select("doc_id", F.concat_ws(",", "missing").alias("missing")),
    f"select doc_id, {_MISSING} as missing from ({_FIELDS}) as f")
register("d18_input_gate", lambda s, d: _meta(s, d).select("doc_id", "gate"),
    f"select doc_id, case when {_MISSING} = '' then 'verified' else 'saved incomplete' end as gate from ({_FIELDS}) as f")
register(
    "d20_text_density",
    lambda s, d: view(s, d, _C).select("doc_id", "roster_idx", F.length(Q.body_text(F.col("raw_response"))).alias("n")).join(view(s, d,
        "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "roster_idx", Q.density(F.col("n"), F.col("n_chars")).alias("density")),
    f"select c.doc_id, roster_idx, round(length({_BODY}) / n_chars, 6) as density from fx_candidates c join documents d on c.doc_id = d.doc_id",
)

# H: model-call steps without a call
_CHUNK = "select call_id, round, case when round % 2 = 1 then concat('```xml', chr(10), text, chr(10), '```') else text end as text, finish_reason from fx_chunks"
_UNFENCE = strip_sql("regexp_replace(regexp_replace(" + strip_sql("text") + ", '^```[a-zA-Z]*\\n?', ''), '```$', '')")
register(
    "h3_continuation_stitch", lambda s, d: H.stitch(run(s, d, _CHUNK)).select("call_id", F.md5("text").alias("text"), "rounds"),
    f"""select call_id, md5(string_agg(case when k = 0 then text else {_UNFENCE} end, chr(10) order by k)) as text, count(*) as rounds from (
 select *, coalesce(min(case when contains(upper(finish_reason), 'MAX_TOKENS') or contains(lower(finish_reason), 'length') then 1 else 0 end) over (partition by call_id order by round rows between unbounded preceding and 1 preceding), 1) as go from (
 select *, row_number() over (partition by call_id order by round) - 1 as k from ({_CHUNK}) as c) as d where k <= 3) as e where go = 1 and (k = 0 or coalesce(text, '') <> '') group by call_id""",
)
register(
    "h4_chat_history_build", lambda s, d: H.chat_history(view(s, d, "conversations")).select("conv_id",
        F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n").alias("messages")),
    "select conv_id, string_agg((case when role in ('user', 'assistant') then role else 'user' end) || ': ' || text, chr(10) order by turn) as messages from conversations group by conv_id",
)
_ANSWERS = f"select o_orderkey, case when o_orderkey % 3 = 0 then '' else o_orderstatus end as text, case when o_orderkey % 2 = 0 then {_ERRORS} end as e from orders"
register(
    "h5_response_status", lambda s, d: run(s, d, _ANSWERS).select("o_orderkey",
        Q.response_status(F.col("text"), X.call_error_classify(F.col("e"))).alias("r")).select("o_orderkey", "r.status", "r.quota_exceeded"),
    f"select o_orderkey, case when e is not null then 'error' when text = '' then 'empty' else 'ok' end as status, coalesce(contains(e, '429') or contains(e, 'Quota exceeded') or contains(lower(e), 'rate_limit'), false) as quota_exceeded from ({_ANSWERS}) as a",
)

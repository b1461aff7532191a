"""Views over the given tables that have the shape of the engine's inputs: Spark frames and, in the same words, SQL for DuckDB.

Each view is one SQL text over base tables and earlier views. Spark reads it with the frames put in by
name; an oracle query gets it as common table expressions.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from folia.streaming.usage import scratch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The hint is for Spark: a small table is often one row group, which is one task.
_ARTICLE = """select /*+ repartition(doc_id) */ doc_id, concat('<article article-type="research-article"><front><journal-meta><journal-id>',
 source, '</journal-id><journal-title-group><journal-title>Journal ', source,
 '</journal-title></journal-title-group><issn>0000-0000</issn><publisher><publisher-name>Press ', lang,
 '</publisher-name></publisher></journal-meta><article-meta><article-id pub-id-type="doi">10.5555/d',
 cast(doc_id as string), '</article-id><title-group><article-title>',
 replace(replace(replace(substring(replace(text, chr(10), ' '), 1, 40), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
 '</article-title></title-group><contrib-group><contrib contrib-type="author"',
 case when doc_id % 3 = 0 then ' corresp="yes"' when doc_id % 3 = 1 then ' corresp="no"' else '' end,
 '><name><surname>S', cast(doc_id % 50 as string), '</surname><given-names>G', cast(doc_id % 7 as string),
 '</given-names></name><xref ref-type="aff" rid="aff1"/></contrib></contrib-group><aff id="aff1">Inst ', source,
 '</aff><pub-date>', case when doc_id % 4 = 0 then '<day>5</day>' else '' end,
 case when doc_id % 2 = 0 then '<month>3</month>' else '' end, '<year>', cast(2000 + doc_id % 25 as string),
 '</year></pub-date><volume>', cast(doc_id % 30 as string),
 '</volume><abstract><p>Short <italic>abstract</italic>.</p></abstract><kwd-group><kwd>', lang, '</kwd><kwd>', source,
 '</kwd></kwd-group></article-meta></front><body><sec id="s1"><title>One</title><p>',
 replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '</p><p>'),
 '</p><p>See <xref ref-type="bibr" rid="r1">1</xref>.</p></sec></body><back><ref-list><ref id="r1"><label>1</label><mixed-citation>1. Ref ',
 source, '</mixed-citation></ref></ref-list></back></article>') as xml
from documents"""

VIEWS = {
    "fx_token_usage": """select event_id as usage_id, ts, user_id,
 case event_type when 'click' then 'generation' when 'view' then 'metadata' when 'purchase' then 'correction'
      when 'signup' then 'correction_plan' else 'chatbot' end as operation,
 case user_id % 7 when 0 then 'gemini-2.5-flash' when 1 then 'gemini-2.5-pro' when 2 then 'gemini-2.0-flash'
      when 3 then 'gpt-4o' when 4 then 'mistral-large-latest' when 5 then 'llama3.1' else 'no-such-model' end as model,
 case user_id % 7 when 0 then 'gemini' when 1 then 'gemini' when 2 then 'gemini' when 3 then 'openai'
      when 4 then 'mistral' when 5 then 'ollama' else 'other' end as provider,
 cast(floor(value * 10) as bigint) as prompt_tokens,
 cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as completion_tokens,
 cast(floor(value * 10) as bigint) + cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as total_tokens
from events""",
    "fx_roster": """select * from (values (0,'Gemini (gemini-2.5-flash)','gemini','gemini-2.5-flash'),
 (1,'OpenAI (gpt-4o)','openai','gpt-4o'), (2,'Mistral (mistral-large-latest)','mistral','mistral-large-latest'),
 (3,'Ollama (llama3.1)','ollama','llama3.1')) as t(roster_idx, label, provider, model)""",
    "fx_article_xml": _ARTICLE,
    # The same articles with addresses, a note, a history, a figure and a table.
    "fx_rich_xml": """select doc_id, replace(replace(replace(replace(xml, '<xref ref-type="aff" rid="aff1"/>',
  concat('<xref ref-type="aff" rid="aff1"/><email>m', cast(doc_id % 5 as string), '@x.org</email><xref ref-type="corresp" rid="c1"/>')),
 '</aff><pub-date>', concat('</aff><author-notes><corresp id="c1">Mail <email>n', cast(doc_id % 2 as string), '@x.org</email></corresp></author-notes><pub-date>')),
 '<abstract>', concat('<history><date date-type="received"><day>1</day><month>', cast(1 + doc_id % 12 as string), '</month><year>2019</year></date><date date-type="accepted"><year>2020</year></date></history><abstract>')),
 '<p>See ', concat('<fig><label>F</label><caption><p>Cap &amp; ', cast(doc_id % 9 as string), '</p></caption><graphic xlink:href="g', cast(doc_id % 4 as string), '.png"/></fig><table-wrap id="tab"><caption><p>T</p></caption><table><tr><td>', cast(doc_id % 8 as string), '</td><th>h</th></tr><tr><td>second</td></tr></table></table-wrap><p>See ')) as xml
from fx_article_xml""",
    # The same articles with three authors of shared and missing affiliations, nested sections and several references.
    "fx_full_xml": """select doc_id, replace(replace(replace(replace(xml, '</contrib></contrib-group>',
  concat('</contrib><contrib contrib-type="author"><contrib-id contrib-id-type="orcid">0000-000', cast(doc_id % 9 as string), '</contrib-id><name><surname>T</surname><given-names>H</given-names></name>',
  '<xref ref-type="aff" rid="aff1"/><xref ref-type="aff" rid="aff2"/></contrib><contrib contrib-type="author"><name><surname>U</surname></name></contrib></contrib-group>')),
 '</aff><pub-date>', concat('</aff><aff id="aff2"><label>2</label>Lab ', cast(doc_id % 4 as string), '</aff><pub-date>')),
 '</sec></body>', '<sec id="s2"><title>In</title><p>deep</p><sec><title>Deeper</title><p>x</p></sec></sec></sec><sec id="s3"><label>7</label><title>Two</title><p>See <xref ref-type="bibr" rid="r1 r2">1, 2</xref> and <xref ref-type="bibr" rid="r2">2</xref>.</p></sec></body>'),
 '</ref></ref-list>', '</ref><ref id="r2"><label>2.</label><mixed-citation>2. Next <italic>one</italic></mixed-citation></ref><ref id="r3"><mixed-citation>Last</mixed-citation></ref></ref-list>') as xml
from fx_article_xml""",
    "fx_candidates": """select a.doc_id, r.roster_idx, r.label, r.provider, r.model,
 case (r.roster_idx + a.doc_id) % 4
  when 0 then a.xml
  when 1 then concat(substring(a.xml, 1, position('<title>One</title><p>' in a.xml) + 320), '</p></sec></body></article>')
  when 2 then replace(a.xml, '<title>One</title>', '<title>One</title><!-- contenido omitido --><break/>')
  else concat('Result:', chr(10), '```xml', chr(10), replace(a.xml, '</article>', ''), chr(10), '```') end as raw_response,
 cast(length(a.xml) % 5000 as bigint) as tokens
from fx_article_xml a cross join fx_roster r""",
    # Candidates with known numbers of errors: none, one, two, four, and one that is not well-formed; some also with an omission.
    "fx_judged": """select doc_id, roster_idx, label, provider, model, fault, case roster_idx when 3 then concat('Result:', chr(10), '```xml', chr(10), x, chr(10), '```') else x end as raw_response
from (select a.doc_id, r.roster_idx, r.label, r.provider, r.model, (3 * r.roster_idx + a.doc_id) % 5 as fault,
 replace(case (3 * r.roster_idx + a.doc_id) % 5 when 0 then a.xml
  when 1 then replace(a.xml, '<sec id="s1">', '<sec id="s1" colour="red">')
  when 2 then replace(a.xml, '<title>One</title>', '<title>One</title><foo>x</foo>')
  when 3 then replace(replace(replace(a.xml, 'rid="r1"', 'rid="r1 r9"'), '<journal-meta><journal-id>', '<journal-meta><issn>1</issn><journal-id>'), '<kwd-group>', '<kwd-group xml:lang="en us" sort="a">')
  else replace(a.xml, '</sec></body>', '</body>') end,
  '<title>One</title>', case when (r.roster_idx + a.doc_id) % 7 = 2 then '<title>One</title><!-- contenido omitido --><break/>' else '<title>One</title>' end) as x
 from fx_article_xml a cross join fx_roster r)""",
    "fx_manuscripts": """select doc_id, concat('in/', cast(doc_id as string),
 case doc_id % 5 when 0 then '.pdf' when 1 then '.DOCX' when 2 then '.txt' else '.docx' end) as path,
 n_chars * 4096 as length,
 concat(case doc_id % 5 when 0 then '%PDF' when 4 then 'xxxx' else concat('PK', chr(3), chr(4)) end, substring(text, 1, 20)) as head
from documents""",
    "fx_metadata_raw": """select c_custkey as doc_id, concat('Here it is: ', chr(10), '```json', chr(10), '{"article_title": "', c_name, '"',
 case when c_custkey % 4 = 0 then '' else concat(', "journal_title": "J', cast(c_nationkey as string), '"') end,
 case when c_custkey % 3 = 0 then ', "roi": ' else ', "doi": ' end,
 case when c_custkey % 5 = 0 then 'null' else concat('"10.5555/', cast(c_custkey as string), '"') end,
 case when c_custkey % 6 = 0 then '' else ', "publication_date": "2024-01-02"' end,
 case when c_custkey % 7 = 0 then ', "authors": []' else ', "authors": [{"given_names": "A B", "surname": "C"}]' end,
 case when c_custkey % 11 = 0 then '' else '}' end, chr(10), '```') as response
from customer""",
    "fx_chunks": """select conv_id as call_id, turn as round, text,
 case when (conv_id + turn) % 4 = 3 then 'stop' when conv_id % 2 = 0 then 'MAX_TOKENS' else 'length' end as finish_reason,
 cast(length(text) as bigint) as completion_tokens
from conversations""",
    "fx_settings_log": """select event_id as seq, ts,
 case user_id % 5 when 0 then 'default_journal_title' when 1 then 'default_publisher_name' when 2 then 'default_journal_issn'
      when 3 then 'jats_version' else 'journal_doi_base' end as key,
 concat('v', cast(event_id as string)) as value, case when event_type = 'error' then 'delete' else 'set' end as op
from events""",
    "fx_error_messages": """select o_orderkey as err_id, o_custkey as doc_id, case o_orderkey % 4
 when 0 then '<string>:12:0:ERROR:VALID: Element sec content does not follow the DTD, expecting (title , p), got (p )'
 when 1 then 'No declaration for attribute align of element break'
 when 2 then 'Element foo is not declared in article list of possible elements'
 else concat('a:', cast(o_orderkey as string), ':0:E: tail text') end as message
from orders""",
    "fx_blocks": """select doc_id, pos, case when pos % 7 = 6 then 'image' when pos % 10 in (3, 4, 5, 8) then 'table' else 'paragraph' end as kind, line as text
from (select doc_id, posexplode(split(text, '\\n')) as (pos, line) from documents)""",
}

#: Where the dialects differ.
DUCKDB = {
    "fx_blocks": """select doc_id, cast(pos as integer) as pos, case when pos % 7 = 6 then 'image' when pos % 10 in (3, 4, 5, 8) then 'table' else 'paragraph' end as kind, line as text
from (select doc_id, unnest(range(len(l))) as pos, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents))""",
}


def _names(sql: str) -> list[str]:
    return [n for n in (*TABLES, *VIEWS) if re.search(rf"\b(?:from|join)\s+{n}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a given table, as a frame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return run(spark, sf_dir, VIEWS[name])


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over tables and views by name."""
    names = _names(sql)
    if not names:
        return spark.sql(sql)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        sql = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in names})


def oracle(sql: str) -> str:
    """The same SQL for DuckDB, with the views that it needs in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n in _names(text):
            if n in VIEWS and n not in needed:
                need(DUCKDB.get(n, VIEWS[n]))
                needed.append(n)

    need(sql)
    parts = [f"{n} as ({DUCKDB.get(n, VIEWS[n])})" for n in needed]
    if not parts:
        return sql
    return f"with {', '.join(parts)}{', ' + sql.lstrip()[5:] if sql.lstrip().lower().startswith('with ') else ' ' + sql}"


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: for rows that several operators use."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

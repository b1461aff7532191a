"""Queries over candidates, settings and usage, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions import quality as Q
from folia.functions import text as X
from folia.operators import candidates as E
from folia.operators import nodes as N
from folia.operators import settings as S
from folia.operators import usage as G
from folia.plans import jobs as J
from folia.plans.fixtures import kept, oracle, run, view

QUERIES: dict = {}
SQL: dict = {}
AS_OF = "2024-01-15"
FIRST, LAST = "2023-12-25", "2024-02-05"


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = oracle(sql)


# The flagship: which candidate of each article is best? Scores follow from validation; a body that cannot be parsed is not audited.
_LONG = "fault = 4 or length(concat('One', replace(text, chr(10), ''), 'See 1.', case when fault = 2 then 'x' else '' end)) >= 500"
_SCORED = f"""select doc_id, roster_idx, n_errors, cast(case when complete then 100 - 5 * n_errors else least(20, 100 - 5 * n_errors) end as integer) as score from (
 select j.doc_id, roster_idx, cast(case fault when 4 then 1 when 3 then 4 else fault end as integer) as n_errors, ({_LONG}) and (roster_idx + j.doc_id) % 7 <> 2 as complete
 from fx_judged j join documents d on d.doc_id = j.doc_id)"""
JUDGED_BOARD = f"select *, row_number() over (partition by doc_id order by score desc, roster_idx) as rank from ({_SCORED}) as s"


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers taken from their fences, cleaned, validated, audited, scored and ranked."""
    cands = view(spark, sf_dir, "fx_judged").withColumn("xml", X.fence_extract(F.col("raw_response"))).drop("raw_response", "fault")
    return J.score_candidates(N.clean_articles(cands, kept, "xml", "doc_id", "roster_idx"), kept)


def _overrides(spark, sf_dir):
    return view(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("roster_idx"))


register("e1_candidate_fanout", lambda s, d: E.fanout(view(s, d, "documents").select("doc_id"), view(s, d, "fx_roster")),
    "select doc_id, roster_idx, label, provider, model from documents cross join fx_roster")
register("e2_leaderboard", lambda s, d: board(s, d).select("doc_id", "roster_idx", "n_errors", "score", "rank"),
    f"select doc_id, roster_idx, n_errors, cast(score as integer) as score, cast(rank as integer) as rank from ({JUDGED_BOARD}) as b")
register(
    "e3_winner_pick", lambda s, d: E.winners(board(s, d), _overrides(s, d)).select("doc_id", "roster_idx", "score", "overridden"),
    f"""select doc_id, roster_idx, cast(score as integer) as score, coalesce(hit, false) as overridden from (select b.*, quality = roster_idx as hit,
 row_number() over (partition by b.doc_id order by coalesce(quality = roster_idx, false) desc, rank) as best from ({JUDGED_BOARD}) as b left join labels l on l.doc_id = b.doc_id) as w where best = 1""",
)


def _settings(spark, sf_dir):
    return S.current_settings(view(spark, sf_dir, "fx_settings_log"))


_CURRENT = "select key, v as value from (select key, arg_max(value, (ts, seq)) as v, arg_max(op, (ts, seq)) as o from fx_settings_log group by key) as m where o <> 'delete'"
register("a13_settings_upsert", _settings, _CURRENT)
# Per user: many keys with many entries each.
_LOG_BY_USER = "select l.*, e.user_id from fx_settings_log l join events e on e.event_id = l.seq"
_BY_USER = f"select user_id, key, v as value from (select user_id, key, arg_max(value, (ts, seq)) as v, arg_max(op, (ts, seq)) as o from ({_LOG_BY_USER}) as l group by user_id, key) as m where o <> 'delete'"


def _user_settings(spark, sf_dir):
    return S.current_settings(run(spark, sf_dir, _LOG_BY_USER), "user_id")


_DEFAULTS = "select distinct key, concat('default of ', key) as value from fx_settings_log union all select concat('template_', cast(item_id as string)), text from benchmark"
register("a9_template_store", lambda s, d: S.with_defaults(_settings(s, d), run(s, d, _DEFAULTS)),
    f"select x.key, coalesce(nullif(c.value, ''), x.value) as value from ({_DEFAULTS}) as x left join ({_CURRENT}) as c on c.key = x.key")
_QUOTAS = "(values " + ", ".join(f"('{m}', {a}, {b}, {c})" for m, a, b, c in G.QUOTAS) + ") as q(model, rpd, tpm, rpm)"
register(
    "a14_quota_dim", lambda s, d: G.with_limits(view(s, d, "fx_token_usage").select("usage_id", "model")).select("usage_id", "model", "rpd", "tpm", "rpm"),
    f"select usage_id, u.model, cast(coalesce(rpd, 500) as bigint) as rpd, cast(coalesce(tpm, 250000) as bigint) as tpm, cast(coalesce(rpm, 10) as bigint) as rpm from fx_token_usage u left join {_QUOTAS} on q.model = u.model",
)


_CATEGORY = f"case when regexp_matches(message, '{Q.CONTENT_MODEL}') then 'content model' when regexp_matches(message, '{Q.NO_ATTRIBUTE}') then 'attribute' when regexp_matches(message, '{Q.UNDECLARED}') then 'undeclared element' when len(string_split(message, ':')) > 4 then 'structure' else 'other' end"
register(
    "d19_error_report", lambda s, d: E.error_report(view(s, d, "fx_error_messages").select("doc_id", Q.error_category(F.col("message")).alias("category"))),
    f"select category, count(*) as n, count(distinct doc_id) as documents from (select doc_id, {_CATEGORY} as category from fx_error_messages) as m group by rollup (category)",
)
_PROFILE = ", ".join(f"coalesce(max(case when key = '{k}' then trim(value) end), '') as {n}" for n, k in S.JOURNAL_KEYS.items())
register("e5_journal_profile", lambda s, d: S.journal_profile(_user_settings(s, d), "user_id"), f"select user_id, {_PROFILE} from ({_BY_USER}) as b group by user_id")
_META = "select c_custkey as user_id, c_name as journal_title, case when c_custkey % 2 = 0 then c_mktsegment end as issn, '' as doi_base from customer"
register(
    "e4_journal_defaults", lambda s, d: S.apply_journal(run(s, d, _META), S.journal_profile(_user_settings(s, d), "user_id"),
        "user_id").select("user_id", "journal_title", "issn", "doi_base", "publisher_name", "subject"),
    f"""select m.user_id, coalesce(nullif(p.title, ''), m.journal_title) as journal_title, coalesce(nullif(p.issn_print, ''), m.issn) as issn, coalesce(nullif(p.doi_base, ''), m.doi_base) as doi_base,
 nullif(p.publisher, '') as publisher_name, nullif(p.subject, '') as subject from ({_META}) as m left join (select user_id, {_PROFILE} from ({_BY_USER}) as b group by user_id) as p on p.user_id = m.user_id""",
)
register(
    "e9_provider_sets", lambda s, d: E.active_providers(view(s, d, "fx_token_usage").select("provider").distinct(), ["ollama", "lmstudio"],
        ["gemini", "openai", "anthropic", "mistral", "ollama", "lmstudio"]),
    "(select provider from fx_token_usage union select * from (values ('ollama'), ('lmstudio')) as l(provider)) intersect select * from (values ('gemini'), ('openai'), ('anthropic'), ('mistral'), ('ollama'), ('lmstudio')) as r(provider)",
)
_CATALOG = "select distinct c_mktsegment as provider, concat(case c_nationkey % 3 when 0 then 'gpt-' when 1 then 'o3-' else 'vision-gpt-' end, cast(c_nationkey as string)) as model from customer"
register(
    "e10_model_catalog_filter", lambda s, d: E.catalog(run(s, d, _CATALOG), "gpt|o1|o3|o4", "vision", "gpt-3", 5),
    f"select provider, model, place from (select *, cast(row_number() over (partition by provider order by (model = 'gpt-3') desc, model desc) as integer) as place from ({_CATALOG}) as c where regexp_matches(model, 'gpt|o1|o3|o4') and not regexp_matches(model, 'vision')) as d where place <= 5",
)
register(
    "e11_legacy_key_backfill", lambda s, d: S.backfill(_user_settings(s, d).where("key = 'jats_version'").select("user_id", "value"),
        view(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("1.4").alias("value")), "user_id"),
    f"with t as (select user_id, value from ({_BY_USER}) as b where key = 'jats_version') select * from t union all select c_custkey, '1.4' from customer where c_custkey not in (select user_id from t where user_id is not null)",
)

# G: usage
_U = "fx_token_usage"
register("g1_usage_totals", lambda s, d: G.usage_summary(view(s, d, _U), AS_OF).select("total_tokens", "total_requests"),
    "select cast(coalesce(sum(total_tokens), 0) as bigint) as total_tokens, count(*) as total_requests from fx_token_usage")
register("g2_usage_today", lambda s, d: G.usage_summary(view(s, d, _U), AS_OF).select("today_tokens", "today_requests"),
    f"select cast(coalesce(sum(total_tokens), 0) as bigint) as today_tokens, count(*) as today_requests from fx_token_usage where cast(ts as date) = date '{AS_OF}'")
register("g3_usage_last", lambda s, d: G.usage_summary(view(s, d, _U), AS_OF).select(X.timestamp_display(F.col("last_used")).alias("last_used")),
    "select strftime(arg_max(ts, usage_id), '%Y-%m-%d %H:%M:%S') as last_used from fx_token_usage")
register("g4_usage_history", lambda s, d: G.history(view(s, d, _U)).select("usage_id", "operation", "model", "total_tokens"),
    "select usage_id, operation, model, total_tokens from fx_token_usage order by usage_id desc limit 20")
register("g5_usage_daily", lambda s, d: G.daily(view(s, d, _U)).select(F.col("day").cast("string").alias("day"), "total_tokens", "requests"),
    "select cast(cast(ts as date) as varchar) as day, cast(sum(total_tokens) as bigint) as total_tokens, count(*) as requests from fx_token_usage group by 1 order by 1 desc limit 30")
register(
    "g6_usage_daily_filled", lambda s, d: G.daily_filled(view(s, d, _U), FIRST, LAST).select(F.col("day").cast("string").alias("day"), "total_tokens", "requests"),
    f"select cast(d.day as varchar) as day, cast(coalesce(sum(total_tokens), 0) as bigint) as total_tokens, count(usage_id) as requests from (select cast(unnest(generate_series(date '{FIRST}', date '{LAST}', interval 1 day)) as date) as day) as d left join fx_token_usage u on cast(u.ts as date) = d.day group by d.day",
)
for _scope in ("all", "model"):
    register(
        f"g7_quota_status_{_scope}", lambda s, d, scope=_scope: G.quota_status(view(s, d, _U), AS_OF, scope),
        f"""select model, cast(used as bigint) as used, rpd, cast(greatest(rpd - used, 0) as bigint) as remaining, least(used / greatest(rpd, 1), 1.0) as share,
 case when used / greatest(rpd, 1) >= 1 then 'exhausted' when used / greatest(rpd, 1) >= 0.8 then 'nearly exhausted' else 'ok' end as band
 from (select m.model, {'(select count(*) from fx_token_usage where cast(ts as date) = date ' + repr(AS_OF) + ')' if _scope == 'all' else 'own'} as used, cast(coalesce(rpd, 500) as bigint) as rpd
 from (select model, count(*) filter (where cast(ts as date) = date '{AS_OF}') as own from fx_token_usage group by model) as m left join {_QUOTAS} on q.model = m.model) as x""",
    )
register(
    "g8_usage_by_provider_model", lambda s, d: G.usage_cube(view(s, d, _U)),
    "select provider, model, operation, cast(grouping_id(provider, model, operation) as bigint) as level, cast(sum(total_tokens) as bigint) as total_tokens, count(*) as requests from fx_token_usage group by rollup (provider, model, operation)",
)
register(
    "g9_quota_table", lambda s, d: G.quota_table(view(s, d, _U)),
    f"select distinct u.model, format('{{:,}}', cast(coalesce(rpd, 500) as bigint)) as rpd, format('{{:,}}', cast(coalesce(tpm, 250000) as bigint)) as tpm, cast(coalesce(rpm, 10) as varchar) as rpm from fx_token_usage u left join {_QUOTAS} on q.model = u.model",
)
register("g10_call_cost_merge", lambda s, d: G.merge_rounds(view(s, d, "fx_chunks")),
    "select call_id, cast(sum(completion_tokens) as bigint) as completion_tokens, count(*) as rounds from fx_chunks group by call_id")

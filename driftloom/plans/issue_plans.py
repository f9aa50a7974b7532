"""Issue filters, unions, roll-ups and their DuckDB twins: name, query, SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import issue_algebra as ia
from driftloom.operators import provenance as pv
from driftloom.sources.tables import table

from .adapters import ISSUES, SPLIT, issues, runs

EFFECTS = {"error": (10.0, 20.0, 0.2), "purchase": (2.0, 15.0, 0.0), "signup": (0.0, 10.0, 0.0)}
_WITH = f"with {ISSUES}"
_PATHS = "case when file is not null then 'src/p' || (line % 5) || '/' || file || '.py' end"


def _paths(s: SparkSession, d: str) -> DataFrame:
    folder = F.concat(F.lit("src/p"), (F.col("line") % 5).cast("string"), F.lit("/"), F.col("file"), F.lit(".py"))
    return issues(s, d).withColumn("file", folder)


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.concat(F.lit("m"), (F.col("c_custkey") % 45).cast("string")).alias("file")).distinct()


_FILES = "files as (select distinct 'm' || (c_custkey % 45) as file from customer)"


def _filters(s: SparkSession, d: str) -> DataFrame:
    i = issues(s, d)
    named = {
        "kind": ia.by_kind(i, "error"), "file": ia.by_file(i, "m3"), "severity": ia.at_least(i, 4), "kinds": ia.of_kinds(i, ["error", "click"]),
        "ignored": ia.without_kinds(i, ["click"]), "confident": ia.confident(i), "fixable": ia.fixable(i, skip=["click"]),
    }
    parts = [f.agg(F.lit(n).alias("filter"), F.count("*").alias("rows"), F.sum("event_id").alias("ids")) for n, f in named.items()]
    return ia.union_all(parts)


_FILTERS = _WITH + " " + " union all ".join(
    f"select '{n}' as filter, count(*) as rows, sum(event_id)::bigint as ids from issues where {rule}"
    for n, rule in {
        "kind": "kind = 'error'", "file": "file = 'm3'", "severity": "severity >= 4", "kinds": "kind in ('error', 'click')", "ignored": "kind <> 'click'",
        "confident": "confidence >= 0.8", "fixable": "kind is not null and file is not null and kind <> 'click'",
    }.items()
)


def _confidences(s: SparkSession, d: str) -> DataFrame:
    factors = {"has_docstring": F.lit(0.5) + F.col("line") % 3, "is_test_file": F.lit(0.9), "unknown": F.lit(0.0)}
    return issues(s, d).select("event_id", F.round(ia.adjusted(F.col("confidence"), factors), 6).alias("confidence"))


def _ordered(s: SparkSession, d: str) -> DataFrame:
    out = None
    for key in ("severity", "file", "kind"):
        top = ia.ordered(issues(s, d), key, "event_id").limit(25).select(F.lit(key).alias("by"), "event_id")
        out = top if out is None else out.unionByName(top)
    return out


_ORDERED = _WITH + " " + " union all ".join(
    f"select * from (select '{k}' as by, event_id from issues order by {o}, event_id limit 25)"
    for k, o in {"severity": "severity desc", "file": "coalesce(file, ''), coalesce(line, 0)", "kind": "kind nulls first"}.items()
)


def _merged(s: SparkSession, d: str) -> DataFrame:
    old, new = runs(s, d)
    return ia.merged(new, old, "event_id").select("event_id", "kind", "file", "line", "severity")


def _violations(s: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("severity") >= 5, "critical").when(F.col("severity") == 4, "high").when(F.col("severity") == 3, "medium").otherwise("low")
    rows = issues(s, d).select(
        level.alias("severity"), (F.col("line") < 10).alias("in_test"), (F.col("line") > 40).alias("recent"), (F.col("line") == 77).alias("critical_path")
    )
    return ia.violations(rows, {"critical": 0, "high": 5, "medium": 10_000})


def _rollups(s: SparkSession, d: str) -> DataFrame:
    i = issues(s, d)
    return ia.union_all([ia.rollup_by(i, k).withColumn("by", F.lit(k)) for k in ("kind", "severity", "symbol")])


def _dated(s: SparkSession, d: str) -> DataFrame:
    dates = issues(s, d).where("kind in ('error', 'click')").groupBy("kind").agg(F.min("ts").cast("date").alias("date"))
    return ia.timeline(issues(s, d), dates)


def _fingerprints(s: SparkSession, d: str) -> DataFrame:
    said = issues(s, d).withColumn("message", F.concat(F.lit("value "), F.col("line").cast("string"), F.lit(" at 'x' in /a/b.py")))
    return pv.fingerprints(said, "message")


_PRINTS = f"""{_WITH}, m as (select *, 'value ' || line || ' at ''x'' in /a/b.py' as message from issues),
  n as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(message, '[0-9]+', 'N', 'g'), '"[^"]*"', '""', 'g'), '''[^'']*''', '''''', 'g'), '/[^\\s]*\\.py', '/PATH.py', 'g') as form from m),
  p as (select *, substr(sha256(kind || '|' || form || '|{{}}'), 1, 16) as content_hash, substr(sha256(coalesce(file, '') || '|' || line), 1, 8) as location_hash from n),
  prints as (select *, 'TC_' || kind || '_' || content_hash || '_' || location_hash as issue_id from p)"""


def _processed(s: SparkSession, d: str) -> DataFrame:
    p = _fingerprints(s, d)
    old, new = (p.where(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz")), p.where(F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz")))
    events = old.select("issue_id", F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("detected").alias("event"), "ts", "event_id")
    return pv.process(new, pv.upsert(old, "issue_id", "ts", "event_id"), events).groupBy("status").agg(F.count("*").alias("issues"))


def _history(s: SparkSession, d: str) -> DataFrame:
    p = _fingerprints(s, d)
    kind = F.element_at(F.array(F.lit("detected"), F.lit("resolved"), F.lit("regressed")), (1 + F.col("event_id") % 3).cast("int"))
    return pv.history(p.select("issue_id", kind.alias("event"), "ts", "event_id"))


PLANS = [
    ("issue_filters", _filters, _FILTERS),
    ("issue_confidence", _confidences, f"{_WITH} select event_id, round(greatest(0.0::double, least(1.0::double, confidence * (0.5::double + line % 3) * 0.9::double)), 6) as confidence from issues"),
    ("issue_excluded", lambda s, d: _paths(s, d).groupBy(ia.excluded(F.coalesce("file", F.lit("")), "src", ["p1", "/p3/"]).alias("excluded"), ia.allowed(F.col("symbol"), ["s1", "s2"]).alias("allowed")).agg(F.count("*").alias("rows")),
        f"{_WITH} select coalesce(({_PATHS}) like 'src/p1%' or ({_PATHS}) like 'src/p3%', false) as excluded, coalesce(symbol in ('s1', 's2'), false) as allowed, count(*) as rows from issues group by 1, 2"),
    ("issue_records", lambda s, d: ia.records(issues(s, d)).select("issue.kind", "issue.severity", "issue.file", "issue.message").groupBy("kind", "severity").agg(F.count("file").alias("files"), F.count("message").alias("messages")),
        f"{_WITH} select kind, severity, count(file) as files, 0::bigint as messages from issues group by 1, 2"),
    ("issue_order", _ordered, _ORDERED),
    ("issue_union", lambda s, d: ia.union_all(list(runs(s, d))).groupBy("kind").agg(F.count("*").alias("rows")), f"{_WITH} select kind, count(*) as rows from issues group by 1"),
    ("issue_merge_priority", _merged, f"""{_WITH}, r as (select *, (ts < timestamp '{SPLIT}')::int as rank from issues), n as (select *, row_number() over (partition by file, line, kind order by rank, event_id) as n from r)
        select event_id, kind, file, line, severity from n where n = 1"""),
    ("action_dedupe", lambda s, d: ia.first_of(issues(s, d), ["kind", "file", "symbol"], "event_id").select("event_id", "kind", "file", "symbol"),
        f"{_WITH}, n as (select *, row_number() over (partition by kind, file, symbol order by event_id) as n from issues) select event_id, kind, file, symbol from n where n = 1"),
    ("symbol_groups", lambda s, d: ia.symbol_groups(issues(s, d), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("g"), (F.col("event_id") % 9).cast("string")))),
        f"{_WITH}, k as (select coalesce(case when event_id % 2 = 0 then 'g' || (event_id % 9) end, symbol) as key, severity from issues) select key, count(*) as issues, max(severity) as worst from k where key is not null group by 1"),
    ("merge_gate", lambda s, d: ia.blocks_merge(ia.at_least(runs(s, d)[1], 1).where("severity < 4"), 9.5).unionByName(ia.blocks_merge(runs(s, d)[1], 0.0)),
        "select false as blocked union all select true"),
    ("issue_statistics", lambda s, d: ia.statistics(issues(s, d)), f"""{_WITH} select count(*) as issues, count(*) filter (severity >= 4) as critical, count(*) filter (severity = 3) as high, count(*) filter (severity = 2) as medium,
        count(*) filter (severity <= 1) as low, count(distinct file) as files, count(distinct kind) as kinds, max(confidence) as top, round(avg(confidence), 6) as mean from issues"""),
    ("file_nodes", lambda s, d: ia.file_nodes(_files(s, d), issues(s, d), "event_id"), f"""{_WITH}, {_FILES}, g as (select file, count(*) as n, sum(severity)::bigint as w, count(distinct kind) as k, arg_max(kind, severity::bigint * 1000000000 - event_id) as m from issues where file is not null group by 1)
        select file, coalesce(n, 0) as issues, coalesce(w, 0) as weight, coalesce(k, 0) as kinds, m as dominant from files left join g using (file)"""),
    ("risk_heatmap", lambda s, d: ia.heatmap(_files(s, d), issues(s, d)), f"""{_WITH}, {_FILES}, r as (select file, coalesce(sum(severity), 0)::bigint as risk from files left join issues using (file) group by 1), t as (select *, risk / max(risk) over () as share from r)
        select file, risk, case when share >= 0.8 then 'critical' when share >= 0.6 then 'high' when share >= 0.4 then 'medium' when share >= 0.2 then 'low' else 'minimal' end as level from t"""),
    ("issue_timeline", _dated, f"""{_WITH} select kind, count(*) as issues, round(100.0::double * count(*) / sum(count(*)) over (), 4) as percent, case when kind in ('error', 'click') then strftime(min(ts), '%Y-%m-%d') else '2023-01-01' end as date from issues group by 1"""),
    ("kind_clusters", lambda s, d: ia.kind_clusters(issues(s, d)), f"{_WITH} select kind, count(*) as issues, count(distinct file) as files, sum(severity)::bigint as weight from issues group by 1 having count(*) > 1"),
    ("issue_rollups", _rollups, _WITH + " " + " union all ".join(f"select '{k}' as by, {k}::varchar as value, count(*) as issues, sum(severity)::bigint as weight, round(avg(severity), 4) as mean from issues group by 2" for k in ("kind", "severity", "symbol"))),
    ("top_files", lambda s, d: ia.top_files(issues(s, d), 12), f"{_WITH} select file, count(*) as issues, sum(severity)::bigint as weight, round(avg(severity), 4) as mean, string_agg(distinct kind, ',' order by kind) as kinds from issues where file is not null group by 1 order by 2 desc, 1 limit 12"),
    ("worst_issues_fixable", lambda s, d: ia.worst_with_fix(issues(s, d), issues(s, d).where("kind = 'signup' and severity = 1"), "event_id", 200).select("event_id", "severity", "fixable"),
        f"""{_WITH}, t as (select * from issues order by severity desc, confidence desc, event_id limit 200), f as (select distinct file, line from issues where kind = 'signup' and severity = 1)
        select event_id, severity, f.file is not null as fixable from t left join f on t.file = f.file and t.line = f.line"""),
    ("first_per_severity", lambda s, d: ia.per_severity(issues(s, d), "event_id").select("event_id", "severity", "nth"), f"{_WITH}, n as (select event_id, severity, row_number() over (partition by severity order by event_id) as nth from issues) select * from n where nth <= 20"),
    ("stub_violations", _violations, f"""{_WITH}, v as (select case when severity >= 5 then 'critical' when severity = 4 then 'high' when severity = 3 then 'medium' else 'low' end as s, line < 10 as t, line > 40 as r, line = 77 as c from issues),
        n as (select count(*) filter (s = 'critical' and ok) as critical, count(*) filter (s = 'high' and ok) as high, count(*) filter (s = 'medium' and ok) as medium, count(*) filter (s = 'low' and ok) as low, count(*) filter (c) as p from (select *, not t and (not r or s = 'critical') as ok from v))
        select critical, high, medium, low, not (critical > 0 or high > 5 or medium > 10000 or p > 0) as passed from n"""),
    ("root_cause_confidence", lambda s, d: ia.cluster_confidence(_paths(s, d).where("symbol is not null"), "symbol"), f"""{_WITH}, p as (select *, {_PATHS} as path from issues where symbol is not null),
        g as (select symbol, count(*) as issues, arg_min(kind, (6 - severity) || kind) as representative, count(distinct (path, line)) filter (path is not null) as places, count(distinct kind) as k, count(distinct severity) as v, count(distinct regexp_replace(path, '/[^/]*$', '')) as f from p group by 1)
        select symbol, issues, representative, places, round(least(1.0::double, 0.5::double + case when k = 1 then 0.2::double else 0 end + case when v = 1 then 0.1::double else 0 end + case when f = 1 then 0.2::double when f = 2 then 0.1::double else 0 end), 6) as confidence from g"""),
    ("fix_impact", lambda s, d: ia.fix_impact(_paths(s, d), EFFECTS), f"""{_WITH}, p as (select *, {_PATHS} as path, case kind when 'error' then 10.0::double when 'purchase' then 2.0 else 0.0 end as r, case kind when 'error' then 20.0::double when 'purchase' then 15.0 when 'signup' then 10.0 else 0.0 end as a from issues)
        select sum(r) as removed, sum(a) as added, sum(r) - sum(a) as net, count(distinct path) as files, count(distinct regexp_replace(path, '/[^/]*$', '')) as folders, round(least(1.0::double, 0.2::double * count(*) filter (kind = 'error')), 6) as complexity from p"""),
    ("impact_scores", lambda s, d: issues(s, d).select("event_id", ia.impact_score(F.col("severity"), F.col("confidence"), 1 + F.col("line") % 4, F.col("line") > 25).alias("impact")),
        f"{_WITH} select event_id, round(least(1.0::double, confidence * severity / 5.0::double * least(2.0::double, 1 + 0.1::double * (line % 4)) + case when line > 25 then 0.1::double else 0.0 end), 3) as impact from issues"),
    ("related_issue_edges", lambda s, d: ia.related(issues(s, d), ["file", "symbol"]), _WITH + " " + " union all ".join(
        f"select event_id as src, f as dst, '{k}' as by from (select *, min(event_id) over (partition by {k}) as f from issues where {k} is not null) where event_id <> f" for k in ("file", "symbol"))),
    ("issue_fingerprints", lambda s, d: _fingerprints(s, d).select("event_id", "content_hash", "location_hash", "issue_id"), f"{_PRINTS} select event_id, content_hash, location_hash, issue_id from prints"),
    ("fingerprint_upsert", lambda s, d: pv.upsert(_fingerprints(s, d), "issue_id", "ts", "event_id").select("issue_id", "event_id"),
        f"{_PRINTS} select issue_id, event_id from (select *, row_number() over (partition by issue_id order by ts desc, event_id desc) as n from prints) where n = 1"),
    ("similar_issues", lambda s, d: pv.similar(pv.upsert(_fingerprints(s, d), "issue_id", "ts", "event_id")), f"""{_PRINTS}, u as (select distinct issue_id, content_hash from prints)
        select issue_id, content_hash, count(*) over (partition by content_hash) - 1 as similar, min(issue_id) over (partition by content_hash) as first_id from u qualify count(*) over (partition by content_hash) > 1"""),
    ("issue_history", _history, f"""{_PRINTS}, e as (select issue_id, ['detected', 'resolved', 'regressed'][1 + event_id % 3] as event, ts, event_id from prints)
        select issue_id, count(*) as events, min(ts) as first_seen, max(ts) as last_seen, arg_max(event, (ts, event_id)) = 'resolved' as resolved, count(*) filter (event = 'regressed') as regressions from e group by 1"""),
    ("provenance_status", _processed, f"""{_PRINTS}, e as (select issue_id, arg_max(case when event_id % 3 = 0 then 'resolved' else 'detected' end, (ts, event_id)) as last from prints where ts < timestamp '{SPLIT}' group by 1),
        c as (select distinct issue_id from prints where ts >= timestamp '{SPLIT}')
        select case when e.issue_id is null then 'new' when last = 'resolved' then 'regressed' else 'known' end as status, count(*) as issues from c left join e using (issue_id) group by 1"""),
    ("shard_merge", lambda s, d: pv.merge_absent(table(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("index").alias("origin")), table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("shard").alias("origin")), "id"),
        "select c_custkey as id, case when c_custkey % 3 = 0 then 'index' else 'shard' end as origin from customer where c_custkey % 3 = 0 or c_custkey % 2 = 0"),
    ("cache_validity", lambda s, d: pv.validity(
        table(s, d, "documents").select("doc_id", F.col("n_chars").alias("size"), F.sha2("text", 256).alias("digest")),
        table(s, d, "documents").where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"), F.sha2(F.when(F.col("doc_id") % 11 == 0, F.lit("x")).otherwise(F.col("text")), 256).alias("digest")),
        "doc_id", ["size", "digest"]).groupBy("state").agg(F.count("*").alias("files")),
        "select case when doc_id % 5 = 0 then 'missing' when doc_id % 7 = 0 or (doc_id % 11 = 0 and text <> 'x') then 'stale' else 'valid' end as state, count(*) as files from documents group by 1"),
    ("needs_reanalysis", lambda s, d: pv.changed_since(
        table(s, d, "orders").select(F.col("o_orderkey").alias("path"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime")),
        table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("path"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - F.col("o_orderkey") % 3 + 1).alias("mtime")), "path", "mtime").select("path"),
        "select o_orderkey as path from orders where (o_orderkey % 2 = 0 and o_orderkey % 3 > 1) or (o_orderkey % 2 <> 0 and epoch(o_orderdate) > 0)"),
    ("repo_fingerprint", lambda s, d: pv.repo_fingerprint(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.md5("text").alias("hash")), "path", ["size", "hash"]),
        "select count(*) as files, bit_xor(('0x' || substr(md5(doc_id::varchar || '|' || n_chars || '|' || md5(text)), 1, 15))::bigint) as digest from documents"),
]

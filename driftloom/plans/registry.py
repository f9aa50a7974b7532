"""Collects every registered query and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.columns import words
from driftloom.operators import cooccur, dedup, domains, graph, rules, scoring, text, timeseries, vectors
from driftloom.sources.tables import table

from . import cluster_plans, code_plans, function_plans, graph_plans, history_plans, issue_plans, search_plans
from .adapters import BASKETS, EDGES, ISSUES, WEIGHT, WEIGHTS, baskets, edges, events, issues, nodes, runs

Query = Callable[[SparkSession, str], DataFrame]

FILLERS = {"license": "(?i)all rights reserved|licensed under", "marks": "[#%$*&]{3}", "token": "token = \"[0-9a-f]+\""}


def _scores(s: SparkSession, d: str) -> DataFrame:
    return scoring.module_scores(issues(s, d), WEIGHTS)


def _leveled(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).select("module", scoring.risk_level(F.col("score"), 450.0, 300.0).alias("level"))


def _terms(s: SparkSession, d: str) -> DataFrame:
    return text.term_counts(table(s, d, "documents"), "doc_id", "text", words)


def _tfidf(s: SparkSession, d: str) -> DataFrame:
    return text.tfidf_top(_terms(s, d), table(s, d, "documents").count(), "doc_id", 5)


def _words(s: SparkSession, d: str) -> DataFrame:
    return text.term_counts(table(s, d, "documents"), "doc_id", "text", words)


def _bands(s: SparkSession, d: str) -> DataFrame:
    return dedup.bands(dedup.minhash(table(s, d, "benchmark"), "item_id", "text"), "item_id")


def _lsh_pairs(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "benchmark")
    return dedup.verified_pairs(dedup.candidate_pairs(_bands(s, d), "item_id"), rows, "item_id", "text", 0.1)


def _near_vectors(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings")
    return vectors.top_k(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 10)


def _distances(s: SparkSession, d: str) -> DataFrame:
    return vectors.distances(table(s, d, "embeddings"), "vec_id", "embedding", "label")


def _daily(s: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    return events(s, d).groupBy("event_type", day.alias("day")).agg(F.count("*").alias("n"))


def _layers(s: SparkSession, d: str) -> DataFrame:
    ends = edges(s, d)
    ids = ends.select(F.col("src").alias("node")).unionByName(ends.select(F.col("dst").alias("node"))).distinct()
    return ids.withColumn("layer", (F.col("node") % 4).cast("int"))


def _domains(s: SparkSession, d: str) -> DataFrame:
    return s.range(4).select(F.col("id").alias("domain"), (F.col("id") * 600).alias("low"), (F.col("id") * 600 + 499).alias("high"))


def _votes(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    by = lambda c: p.select(F.col("s_suppkey").alias("member"), c.alias("bucket"))
    return domains.votes([by(F.col("s_nationkey").cast("string")), by(F.col("n_regionkey").cast("string")), by(F.floor(F.col("s_acctbal") / 1000).cast("string"))], 2)


def _ranges(s: SparkSession, d: str) -> DataFrame:
    seen = events(s, d).groupBy("user_id").agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"))
    return timeseries.overlaps(seen, "user_id", "low", "high", 0.99)


#: Families of queries in modules of their own.
FAMILIES = [*issue_plans.PLANS, *graph_plans.PLANS, *function_plans.PLANS, *code_plans.PLANS, *history_plans.PLANS, *cluster_plans.PLANS, *search_plans.PLANS]


def queries() -> dict[str, Query]:
    return {name: query for name, query, _ in FAMILIES} | {
        "risk_module_scores": _scores,
        "risk_level": _leveled,
        "risk_global_score": lambda s, d: scoring.global_score(_scores(s, d)),
        "issue_distribution": lambda s, d: scoring.distribution(issues(s, d)),
        "severity_bands": lambda s, d: scoring.severity_bands(issues(s, d)),
        "top_modules": lambda s, d: scoring.top_modules(_scores(s, d)),
        "issue_dedupe": lambda s, d: scoring.deduplicate(issues(s, d), "event_id").select("event_id", "kind", "file", "line", "symbol"),
        "issues_by_file": lambda s, d: scoring.group_by_file(issues(s, d)),
        "pr_classify": lambda s, d: scoring.classify(*runs(s, d)),
        "issue_trend": lambda s, d: scoring.trend(*runs(s, d), WEIGHTS),
        "exact_duplicates": lambda s, d: dedup.exact_groups(table(s, d, "documents"), "doc_id", "text"),
        "canonical_pick": lambda s, d: dedup.canonical_pick(table(s, d, "documents"), "doc_id", "text", "n_chars"),
        "consolidation_summary": lambda s, d: dedup.consolidation(dedup.exact_groups(table(s, d, "documents"), "doc_id", "text")),
        "shingle_jaccard_pairs": lambda s, d: dedup.shingle_pairs(table(s, d, "part"), "p_partkey", "p_name", 3, 0.2),
        "name_levenshtein_pairs": lambda s, d: dedup.edit_pairs(table(s, d, "part"), "p_name", 5),
        "name_levenshtein_all_pairs": lambda s, d: dedup.edit_pairs(table(s, d, "part"), "p_name", 5),
        "minhash_signatures": lambda s, d: dedup.minhash(table(s, d, "benchmark"), "item_id", "text"),
        "lsh_bucket_stats": lambda s, d: dedup.band_stats(_bands(s, d)),
        "lsh_candidate_pairs": lambda s, d: dedup.candidate_pairs(_bands(s, d), "item_id"),
        "lsh_verified_pairs": _lsh_pairs,
        "lsh_document_pairs": lambda s, d: dedup.similar_pairs(table(s, d, "documents"), "doc_id", "text", 0.8),
        "lsh_benchmark_pairs": lambda s, d: dedup.similar_pairs(table(s, d, "benchmark"), "item_id", "text", 0.1),
        "token_df": lambda s, d: text.document_frequency(_terms(s, d)),
        "tfidf_topk": _tfidf,
        "word_entropy": lambda s, d: text.entropy(_terms(s, d), "doc_id"),
        "word_df": lambda s, d: text.document_frequency(_words(s, d)),
        "word_tfidf_topk": lambda s, d: text.tfidf_top(_words(s, d), table(s, d, "documents").count(), "doc_id", 5),
        "word_entropy_all": lambda s, d: text.entropy(_words(s, d), "doc_id"),
        "filler_pattern_hits": lambda s, d: text.pattern_hits(table(s, d, "documents"), "doc_id", "text", FILLERS),
        "cosine_topk": _near_vectors,
        "cosine_label_pairs": lambda s, d: vectors.label_pairs(table(s, d, "embeddings"), "vec_id", "embedding", "label", 0.3),
        "hamming_sign_pairs": _distances,
        "background_stats": lambda s, d: vectors.background(table(s, d, "embeddings"), "vec_id", "embedding", "label"),
        "zscore_pairs": lambda s, d: vectors.outliers(table(s, d, "embeddings"), "vec_id", "embedding", "label", 1.0),
        "one_median_per_label": lambda s, d: vectors.medians(table(s, d, "embeddings"), "vec_id", "embedding", "label"),
        "fix_chains": lambda s, d: timeseries.sessions(events(s, d), "user_id", "ts", 6 * 3600, 3),
        "ping_pong": lambda s, d: timeseries.alternations(events(s, d), "user_id", "ts", "event_type", "event_id"),
        "markov_transitions": lambda s, d: timeseries.transitions(events(s, d), "user_id", "ts", "event_type", "event_id"),
        "drift_steps": lambda s, d: timeseries.drift_steps(events(s, d), "user_id", "ts", "value", "event_id"),
        "volatility": lambda s, d: timeseries.volatility(events(s, d), "user_id", "value", 10_000.0),
        "drift_stages": lambda s, d: timeseries.stages(events(s, d), "user_id", "ts", "value", "event_id", 50.0),
        "trend_slope": lambda s, d: timeseries.slope(_daily(s, d), "event_type", "day", "n", 0.5),
        "last_snapshots": lambda s, d: timeseries.last_snapshots(events(s, d), "user_id", "ts", "event_id").select("event_id", "user_id", "value"),
        "pattern_evolution": lambda s, d: timeseries.evolution(events(s, d), "event_type", "ts"),
        "recent_regressions": lambda s, d: timeseries.recent(events(s, d), "ts", "event_type", "error", 7).select("event_id", "user_id", "value"),
        "temporal_overlap": _ranges,
        "coedit_frequency": lambda s, d: cooccur.frequency(baskets(s, d)),
        "linkage_disequilibrium": lambda s, d: cooccur.linkage(baskets(s, d)),
        "linkage_groups": lambda s, d: cooccur.groups(baskets(s, d), 0.035),
        "connected_components": lambda s, d: graph.components(edges(s, d)),
        "module_coupling": lambda s, d: graph.coupling(edges(s, d)),
        "god_modules": lambda s, d: graph.gods(edges(s, d), 20),
        "orphan_nodes": lambda s, d: graph.orphans(nodes(s, d), edges(s, d)),
        "reciprocal_edges": lambda s, d: graph.reciprocal(edges(s, d)),
        "influence_2hop": lambda s, d: graph.influence(edges(s, d), 2),
        "influence_3hop": lambda s, d: graph.influence(edges(s, d)),
        "layer_violations": lambda s, d: graph.layer_violations(edges(s, d), _layers(s, d)),
        "tad_cohesion": lambda s, d: domains.cohesion(edges(s, d), _layers(s, d).withColumnRenamed("layer", "group")),
        "contact_probability": lambda s, d: domains.contact_decay(table(s, d, "lineitem"), "l_quantity", "l_discount", (5.0, 10.0, 20.0, 40.0)),
        "decay_slope": lambda s, d: domains.decay_slope(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"),
        "domain_interval_stats": lambda s, d: domains.width_contacts(edges(s, d), 600, "src", "dst"),
        "domain_interval_stats_all": lambda s, d: domains.width_contacts(edges(s, d), 600, "src", "dst"),
        "vote_groups": _votes,
        "normalized_messages": lambda s, d: rules.normalized_messages(events(s, d), "props"),
        "character_entropy": lambda s, d: rules.character_entropy(table(s, d, "part"), "p_name"),
        "frequent_tokens": lambda s, d: rules.frequent_tokens(table(s, d, "part"), "p_name", 0.05),
        "arithmetic_progressions": lambda s, d: rules.progressions(table(s, d, "lineitem"), "l_orderkey", "l_linenumber", "l_linenumber"),
        "contact_by_distance": lambda s, d: table(s, d, "lineitem").select("l_quantity").distinct().select(
            "l_quantity", F.round(rules.contact(F.col("l_quantity")), 6).alias("probability")
        ),
        "quota_sample": lambda s, d: rules.quota_sample(events(s, d), "event_type", "event_id", 10),
        "empirical_significance": lambda s, d: rules.significance(_distances(s, d)),
        "cross_module_pairs": lambda s, d: rules.cross_group_pairs(table(s, d, "embeddings"), "vec_id", "embedding", "label", 0.3),
        "recent_average": lambda s, d: rules.recent_average(events(s, d), "user_id", "ts", "value", "event_id"),
        "undefined_references": lambda s, d: rules.unmatched(
            table(s, d, "events").select(F.col("user_id").alias("id")), table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), "id"
        ),
    }


_SCORES = f"""scores as (select coalesce(file, '<global>') as module, round(sum({WEIGHT} * severity * confidence), 2) as score,
  count(*) as issues from issues group by 1)"""
_TERMS = r"terms as (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as term from documents) group by all)"
_WORDS = "words as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) as word from benchmark)"
_SIGS = _WORDS + ", sigs as (select item_id, " + ", ".join(
    f"min(('0x' || substr(md5('{i}:' || word), 1, 8))::bigint) as h{i}" for i in range(8)
) + " from words group by 1)"
_BANDS = _SIGS + ", bands as (" + " union all ".join(
    f"select {b} as band, h{2 * b} || ':' || h{2 * b + 1} as bucket, item_id from sigs" for b in range(4)
) + ")"
_CANDS = _BANDS + ", cands as (select distinct x.item_id as a, y.item_id as b from bands x join bands y using (band, bucket) where x.item_id < y.item_id)"
_DIST = """signed as (select label, vec_id, [(v > 0)::int for v in embedding] as s from embeddings),
dist as (select x.label, x.vec_id as a, y.vec_id as b,
  list_sum([(x.s[i] <> y.s[i])::int for i in range(1, len(x.s) + 1)])::double / len(x.s) as distance
  from signed x join signed y on x.label = y.label and x.vec_id < y.vec_id)"""
_COS = "{e}list_cosine_similarity([v::double for v in x.embedding], [v::double for v in y.embedding])"
_PAIRS = BASKETS + """, sizes as (select item, count(*) as n from baskets group by 1),
both_ as (select x.item as a, y.item as b, count(*) as "both" from baskets x join baskets y using (basket) where x.item < y.item group by 1, 2),
pairs as (select a, b, s.n as na, t.n as nb, "both" from both_ join sizes s on s.item = a join sizes t on t.item = b)"""
_FREQ = _PAIRS + ', freq as (select a, b, "both", round("both"::double / least(na, nb), 6) as frequency from pairs)'
_DEG = EDGES + """, ids as (select src as node from edges union select dst from edges),
i as (select dst as node, count(distinct src) as fan_in from edges group by 1), o as (select src as node, count(distinct dst) as fan_out from edges group by 1),
deg as (select node, coalesce(fan_in, 0) as fan_in, coalesce(fan_out, 0) as fan_out from ids left join i using (node) left join o using (node))"""
_LAYERS = EDGES + ", layers as (select distinct node, (node % 4)::int as layer from (select src as node from edges union select dst from edges))"
_ORDER = "over (partition by user_id order by ts, event_id)"


_CONTACTS = f"""with {EDGES} select case when floor(src / 600) = floor(dst / 600) then 'intra' else 'inter' end as kind, count(*) as contacts, round(avg(abs(src - dst)), 4) as mean,
    round(stddev_pop(abs(src - dst)), 4) as deviation from edges where src is not null and dst is not null group by 1"""
_EDITS = "with n as (select distinct p_name as name from part) select x.name as a, y.name as b, levenshtein(x.name, y.name) as edits from n x join n y on x.name < y.name where levenshtein(x.name, y.name) <= 5"


def _closure(pairs: str) -> str:
    """Least reachable node of each node, over (u, v) pairs in both directions."""
    return f"""sym as (select distinct u, v from ({pairs})),
reach(u, v) as (select u, v from sym union select r.u, s.v from reach r join sym s on s.u = r.v)
select u as node, least(min(v), u) as component from reach group by u"""


def oracle_sql() -> dict[str, str]:
    runs_sql = f"with {ISSUES}, b as (select * from issues where ts < '2024-01-16'), c as (select * from issues where ts >= '2024-01-16')"
    return {name: sql for name, _, sql in FAMILIES if sql} | {
        "risk_module_scores": f"with {ISSUES}, {_SCORES} select * from scores",
        "risk_level": f"with {ISSUES}, {_SCORES} select module, case when score >= 450 then 'CRITICAL' when score >= 300 then 'WARNING' else 'OK' end as level from scores",
        "risk_global_score": f"with {ISSUES}, {_SCORES} select round(coalesce(avg(score) * least(count(*) / 10.0, 2.0), 0), 2)::double as global_score from scores",
        "issue_distribution": f"with {ISSUES} select kind, count(*) as issues from issues group by 1",
        "severity_bands": f"with {ISSUES} select case when severity >= 4 then 'critical' when severity = 3 then 'high' when severity = 2 then 'medium' else 'low' end as band, count(*) as issues from issues group by 1",
        "top_modules": f"with {ISSUES}, {_SCORES} select * from scores order by score desc, module limit 10",
        "issue_dedupe": f"with {ISSUES} select event_id, kind, file, line, symbol from issues qualify row_number() over (partition by kind, file, line, symbol order by event_id) = 1",
        "issues_by_file": f"with {ISSUES} select coalesce(file, '<no-file>') as file, count(*) as issues, max(severity) as worst, count(distinct kind) as kinds from issues group by 1",
        "pr_classify": runs_sql + """, s as (select kind, file, line, symbol, max(b) as b, max(c) as c from (
            select kind, file, line, symbol, 1 as b, 0 as c from b union all select kind, file, line, symbol, 0, 1 from c) group by all)
            select case when b = 0 then 'new' when c = 0 then 'fixed' else 'existing' end as status, count(*) as identities from s group by 1""",
        "issue_trend": runs_sql + f""", t as (select (select round(sum({WEIGHT} * severity * confidence), 2) from b) as before, (select round(sum({WEIGHT} * severity * confidence), 2) from c) as after)
            select before, after, round(after - before, 2) as change, case when before = 0 then 0.0 else round(100 * round(after - before, 2) / before, 2) end as percent,
            case when round(after - before, 2) < 0 then 'improving' else 'worsening' end as direction from t""",
        "exact_duplicates": "select md5(coalesce(text, '')) as content_hash, count(*) as copies, min(doc_id) as canonical, count(*) - 1 as redundant from documents group by 1 having count(*) > 1",
        "canonical_pick": "select content_hash, doc_id as canonical, copies from (select *, md5(coalesce(text, '')) as content_hash, row_number() over (partition by md5(coalesce(text, '')) order by n_chars desc, doc_id) as nth, count(*) over (partition by md5(coalesce(text, ''))) as copies from documents) where nth = 1 and copies > 1",
        "consolidation_summary": "select count(*) as clusters, sum(n)::bigint as files, sum(n - 1)::bigint as redundant from (select count(*) as n from documents group by md5(coalesce(text, '')) having count(*) > 1)",
        "shingle_jaccard_pairs": """with names as (select p_name as name, min(p_partkey) as key from part group by 1),
            s as (select key, unnest(list_distinct([substr(name, i, 3) for i in range(1, length(name) - 1)])) as g from names), n as (select key, count(*) as n from s group by 1),
            b as (select x.key as a, y.key as b, count(*) as "both" from s x join s y using (g) where x.key < y.key group by 1, 2)
            select * from (select a, b, round("both"::double / (p.n + q.n - "both"), 6) as similarity from b join n p on p.key = a join n q on q.key = b) where similarity > 0.2""",
        "name_levenshtein_pairs": _EDITS,
        "name_levenshtein_all_pairs": _EDITS,
        "minhash_signatures": f"with {_SIGS} select * from sigs",
        "lsh_bucket_stats": f"with {_BANDS}, z as (select band, bucket, count(*) as n from bands group by 1, 2) select band, count(*) as buckets, count(*) filter (n > 1) as shared, max(n) as largest from z group by 1",
        "lsh_candidate_pairs": f"with {_CANDS} select * from cands",
        "lsh_verified_pairs": f"""with {_CANDS}, sets as (select item_id, list(word) as w from words group by 1)
            select * from (select a, b, round(len(list_intersect(p.w, q.w))::double / (len(p.w) + len(q.w) - len(list_intersect(p.w, q.w))), 6) as similarity
            from cands join sets p on p.item_id = a join sets q on q.item_id = b) where similarity >= 0.1""",
        "token_df": f"with {_TERMS} select term, count(*) as df, sum(tf)::bigint as uses from terms group by 1",
        "tfidf_topk": f"""with {_TERMS}, d as (select term, count(*) as df from terms group by 1), w as (select doc_id, term, tf,
            round(tf * (ln((1.0 + (select count(*) from documents)) / (1.0 + df)) + 1), 4) as weight from terms join d using (term)),
            r as (select *, row_number() over (partition by doc_id order by weight desc, term) as nth from w) select * from r where nth <= 5""",
        "word_entropy": f"""with {_TERMS}, p as (select *, sum(tf) over (partition by doc_id) as whole from terms)
            select doc_id, round(-sum(tf / whole * log2(tf / whole)), 4) + 0.0::double as entropy, max(whole)::bigint as words, round(count(*) / max(whole), 4) as variety from p group by 1""",
        "word_df": f"with {_TERMS} select term, count(*) as df, sum(tf)::bigint as uses from terms group by 1",
        "word_tfidf_topk": f"""with {_TERMS}, d as (select term, count(*) as df from terms group by 1), w as (select doc_id, term, tf,
            round(tf * (ln((1.0 + (select count(*) from documents)) / (1.0 + df)) + 1), 4) as weight from terms join d using (term)),
            r as (select *, row_number() over (partition by doc_id order by weight desc, term) as nth from w) select * from r where nth <= 5""",
        "word_entropy_all": f"""with {_TERMS}, p as (select *, sum(tf) over (partition by doc_id) as whole from terms)
            select doc_id, round(-sum(tf / whole * log2(tf / whole)), 4) + 0.0::double as entropy, max(whole)::bigint as words, round(count(*) / max(whole), 4) as variety from p group by 1""",
        "filler_pattern_hits": "select * from (" + " union all ".join(
            f"select doc_id, '{n}' as rule, len(regexp_extract_all(text, '{p}')) as hits from documents" for n, p in FILLERS.items()
        ) + ") where hits > 0",
        "cosine_topk": f"""with s as (select x.vec_id as a, y.vec_id as b, round({_COS.format(e="")}, 6) as similarity from embeddings x join embeddings y on x.vec_id <> y.vec_id where x.vec_id % 50 = 0),
            r as (select *, row_number() over (partition by a order by similarity desc, b) as nth from s) select * from r where nth <= 10""",
        "cosine_label_pairs": f"select * from (select x.label, x.vec_id as a, y.vec_id as b, round({_COS.format(e='')}, 6) as similarity from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id) where similarity >= 0.3",
        "hamming_sign_pairs": f"with {_DIST} select * from dist",
        "background_stats": f"with {_DIST} select count(*) as pairs, round(avg(distance), 6) as mean, round(stddev_pop(distance), 6) as std from dist",
        "zscore_pairs": f"with {_DIST}, st as (select avg(distance) as m, sqrt(var_pop(distance) + 1e-12) as s from dist) select * from (select a, b, round((m - distance) / s, 4) as z from dist, st) where z >= 1.0",
        "one_median_per_label": f"""with {_DIST}, e as (select label, a as node, distance from dist union all select label, b, distance from dist),
            t as (select label, node, round(sum(distance), 6) as total from e group by 1, 2) select label, node as median, total from t qualify row_number() over (partition by label order by total, node) = 1""",
        "fix_chains": """with g as (select *, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) > 21600000000 then 1 else 0 end as new_ from events window w as (partition by user_id order by ts)),
            c as (select *, sum(new_) over (partition by user_id order by ts)::bigint as chain from g)
            select user_id, chain, count(*) as size, ((max(epoch_us(ts)) - min(epoch_us(ts))) // 1000000)::bigint as seconds from c group by 1, 2 having count(*) >= 3""",
        "ping_pong": f"""with m as (select user_id, case when event_type = lag(event_type, 2) {_ORDER} and event_type <> lag(event_type, 1) {_ORDER} then 1 else 0 end as back from events)
            select user_id, count(*) as events, sum(back)::bigint as returns, round(sum(back)::double / (count(*) - 2), 6) as share from m group by 1 having count(*) >= 4""",
        "markov_transitions": f"""with t as (select event_type as source, lead(event_type) {_ORDER} as target from events), c as (select source, target, count(*) as n from t where target is not null group by 1, 2)
            select source, target, n, round(n / sum(n) over (partition by source), 6) as probability from c""",
        "drift_steps": f"""with d as (select user_id, round(100 * abs(value - lag(value) {_ORDER}))::bigint as d from events)
            select user_id, count(*) as steps, max(d) as largest, round(avg(d), 4) as mean, round(avg((d < 1000)::int), 4) as calm from d where d is not null group by 1""",
        "volatility": "select user_id, count(*) as n, round(case when count(*) < 2 then 0.0 else least(var_pop(value) / 10000.0, 1.0) end, 4) as volatility from events group by 1",
        "drift_stages": f"""with g as (select *, case when abs(value - lag(value) {_ORDER}) > 50 then 1 else 0 end as new_ from events), c as (select *, sum(new_) {_ORDER}::bigint as stage from g)
            select user_id, stage, count(*) as size, min(value) as low, max(value) as high from c group by 1, 2""",
        "trend_slope": """with p as (select event_type, datediff('day', date '2024-01-01', ts::date) as day, count(*) as n from events group by 1, 2), f as (select event_type, count(*) as n, regr_slope(n, day) as s from p group by 1)
            select event_type, n, case when n >= 3 then round(s, 4) end as slope, case when n < 3 then 'insufficient' when s > 0.5 then 'rising' when s < -0.5 then 'falling' else 'stable' end as direction from f""",
        "last_snapshots": "select event_id, user_id, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 10",
        "pattern_evolution": """with d as (select event_type, ts::date as day, count(*) as n from events group by 1, 2), r as (select *, row_number() over (partition by event_type order by day) as a, row_number() over (partition by event_type order by day desc) as z from d)
            select event_type, count(*) as days, sum(case when a <= 2 then n else 0 end)::bigint as early, sum(case when z <= 4 then n else 0 end)::bigint as late, round(1 - stddev_pop(n) / (avg(n) + 1), 4) as steadiness from r group by 1""",
        "recent_regressions": "select event_id, user_id, value from events where event_type = 'error' and ts > (select max(ts) from events) - interval 7 days",
        "temporal_overlap": """with r as (select user_id as k, min(event_id) as low, max(event_id) as high from events group by 1)
            select x.k as a, y.k as b, least(x.high, y.high) - greatest(x.low, y.low) as shared from r x join r y on x.k < y.k and x.low <= y.high and y.low <= x.high
            where least(x.high, y.high) - greatest(x.low, y.low) >= 0.99::double * least(x.high - x.low, y.high - y.low)""",
        "coedit_frequency": f"with {_FREQ} select * from freq",
        "linkage_disequilibrium": f"""with {_PAIRS}, p as (select a, b, na / t.n::double as pa, nb / t.n::double as pb, "both" / t.n::double as pab from pairs, (select count(distinct basket) as n from baskets) t),
            d as (select a, b, pab - pa * pb as d, case when pab - pa * pb >= 0 then least(pa * (1 - pb), (1 - pa) * pb) else least(pa * pb, (1 - pa) * (1 - pb)) end as most from p)
            select a, b, round(d, 6) as d, round(case when most = 0 then 0.0 else d / most end, 6) as d_prime from d""",
        "linkage_groups": f"with recursive {_FREQ}, " + _closure("select a as u, b as v from freq where frequency >= 0.035 union select b, a from freq where frequency >= 0.035"),
        "module_coupling": f"with {_DEG} select node, fan_in, fan_out, round(fan_out::double / greatest(1, fan_in + fan_out), 6) as instability from deg",
        "god_modules": f"with {_DEG} select node, fan_in from deg where fan_in > 20",
        "orphan_nodes": f"with {EDGES} select p_partkey as node from part where p_partkey not in (select src from edges) and p_partkey not in (select dst from edges)",
        "reciprocal_edges": f"with {EDGES} select distinct src, dst from edges where src < dst and (dst, src) in (select (src, dst) from edges)",
        "influence_2hop": f"""with {EDGES}, e as (select distinct src, dst from edges), h as (select dst as node, src as by_, 1 as hop from e where src <> dst
            union all select y.dst, x.src, 2 from e y join e x on x.dst = y.src where y.src <> y.dst and y.dst <> x.src), f as (select node, by_, min(hop) as hop from h group by 1, 2)
            select node, count(*) as reached, round(sum(1.0::double / hop), 4) as influence from f group by 1""",
        "layer_violations": f"with {_LAYERS}, k as (select case when p.layer < q.layer then 'backward' when p.layer - q.layer > 1 then 'skip_layer' end as kind from edges join layers p on p.node = src join layers q on q.node = dst) select kind, count(*) as edges from k where kind is not null group by 1",
        "tad_cohesion": f"""with {_LAYERS}, t as (select p.layer as g1, q.layer as g2 from edges join layers p on p.node = src join layers q on q.node = dst),
            u as (select g1 as g, g1 = g2 as inside from t union all select g2, false from t where g1 <> g2)
            select g as "group", count(*) filter (inside) as internal, count(*) filter (not inside) as external, round((count(*) filter (inside))::double / count(*), 6) as cohesion from u group by 1""",
        "contact_probability": "select case when l_quantity >= 40 then 4 when l_quantity >= 20 then 3 when l_quantity >= 10 then 2 when l_quantity >= 5 then 1 else 0 end as bin, count(*) as contacts, round(avg(l_discount), 4) as strength from lineitem group by 1",
        "decay_slope": "select count(*) as n, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 4) as slope from lineitem where l_quantity > 0 and l_extendedprice > 0",
        "domain_interval_stats": _CONTACTS,
        "domain_interval_stats_all": _CONTACTS,
        "influence_3hop": f"""with {EDGES}, e as (select distinct src, dst from edges), h1 as (select dst as node, src as by_ from e where src <> dst),
            h2 as (select distinct h.node, e.src as by_ from h1 h join e on e.dst = h.by_ where e.src <> h.node), h3 as (select distinct h.node, e.src as by_ from h2 h join e on e.dst = h.by_ where e.src <> h.node),
            f as (select node, by_, min(hop) as hop from (select *, 1 as hop from h1 union all select *, 2 from h2 union all select *, 3 from h3) group by 1, 2)
            select node, count(*) as reached, round(sum(1.0::double / hop), 4) as influence from f group by 1""",
        "vote_groups": """with p as (select s_suppkey as m, s_nationkey::varchar as x, n_regionkey::varchar as y, floor(s_acctbal / 1000)::varchar as z from supplier join nation on s_nationkey = n_nationkey)
            select p.m as a, q.m as b, ((p.x = q.x)::int + (p.y = q.y)::int + (p.z = q.z)::int)::bigint as votes from p join p q on p.m < q.m where (p.x = q.x)::int + (p.y = q.y)::int + (p.z = q.z)::int >= 2""",
        "normalized_messages": """select regexp_replace(regexp_replace(coalesce(props, ''), '[0-9]+', 'N', 'g'), '"[^"]*"', '""', 'g') as form, count(*) as rows from events group by 1""",
        "character_entropy": """with n as (select distinct p_name as name from part), c as (select name, unnest(string_split(name, '')) as c from n), k as (select name, c, count(*) as n from c group by 1, 2),
            p as (select name, n / sum(n) over (partition by name) as p from k) select name, round(-sum(p * log2(p)), 4) as entropy from p group by 1""",
        "frequent_tokens": """with n as (select distinct p_name as name from part), t as (select name, unnest(list_distinct(string_split(name, ' '))) as token from n)
            select token, count(*) as names from t group by 1 having count(*) >= 0.05::double * (select count(*) from n)""",
        "arithmetic_progressions": """with s as (select l_orderkey, l_linenumber - lag(l_linenumber) over (partition by l_orderkey order by l_linenumber) as s from lineitem)
            select l_orderkey, count(*) as n, min(s) = max(s) as perfect from s group by 1 having count(*) >= 2""",
        "contact_by_distance": "select distinct l_quantity, round(least(1.0::double, pow(l_quantity + 1e-6, -1.2)), 6) as probability from lineitem",
        "quota_sample": """with r as (select event_type, event_id, row_number() over (partition by event_type order by md5(event_id::varchar), event_id) as n, count(*) over (partition by event_type) as c from events)
            select event_type, event_id from r where n <= greatest(1, floor(c * 10 / 100))""",
        "empirical_significance": f"with {_DIST} select a, b, round(cume_dist() over (order by distance), 6) as p from dist",
        "cross_module_pairs": f"""with s as (select x.label as low, y.label as high from embeddings x join embeddings y on x.label < y.label where round({_COS.format(e='')}, 6) > 0.3)
            select low, high, count(*) as pairs, (case when count(*) > 10 then 4 when count(*) > 5 then 3 when count(*) > 2 then 2 else 1 end)::int as severity from s group by 1, 2""",
        "recent_average": "select event_id, round(avg(round(100 * value)::bigint) over (partition by user_id order by ts, event_id rows between 9 preceding and current row), 4) as mean from events",
        "undefined_references": "select user_id as id, count(*) as uses from events where user_id not in (select c_custkey from customer where c_acctbal > 0) group by 1",
    }

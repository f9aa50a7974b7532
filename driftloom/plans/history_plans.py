"""Histories, checks of guesses, and signature searches, with their DuckDB twins: name, query, SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import scores
from driftloom.operators import dedup, histories, signatures, timeseries
from driftloom.sources.tables import table

from .adapters import events

SCALE = 60.0
_O = ["ts", "event_id"]


def _seconds(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def _trends(s: SparkSession, d: str) -> DataFrame:
    return histories.drift_trends(events(s, d), "user_id", _O, "value", SCALE)


_D = f"least(1.0::double, abs({{a}} - {{b}}) / {SCALE}::double)"
_TRENDS = f"""l as (select user_id, list(value order by ts, event_id) as v, count(*) as n from events group by 1),
  f as (select *, {_D.format(a='v[1]', b='v[n // 2 + 1]')} as x, {_D.format(a='v[n // 2 + 1]', b='v[n]')} as y, {_D.format(a='v[1]', b='v[n]')} as w, list_transform(v[2:], lambda q: {_D.format(a='v[1]', b='q')}) as d from l),
  trends as (select user_id, n::int as states, case when n < 3 then 'stable' when w > (x + y) * 0.8::double then 'expanding' when w < 0.2::double then 'contracting' when abs(x - y) < 0.1::double then 'stable' else 'oscillating' end as trend,
    case when n < 3 then 'insufficient_data' when len(list_filter(range(1, len(d)), lambda i: d[i] > d[i + 1])) = 0 then 'monotonic_drift' when d[len(d)] < d[len(d) // 2 + 1] then 'returning_drift' else 'chaotic_drift' end as trajectory, round(w, 6) as moved from f)"""


def _chains(s: SparkSession, d: str) -> DataFrame:
    """Confidence of each session of errors: how many, of how many kinds, and whether it took hours."""
    e = _seconds(s, d)
    kinds = e.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), ((F.max("at") - F.min("at")) < 86400 * 14).alias("short"))
    return kinds.select("user_id", F.round(scores.chain_confidence(F.col("n"), F.col("kinds"), F.col("short")), 6).alias("confidence"))


def _parts(s: SparkSession, d: str) -> DataFrame:
    """Parts with bit signatures: words of the name; type, size bucket and words; brand and letters."""
    p = table(s, d, "part")
    words = F.split("p_name", " ")
    second = F.concat(words, F.array("p_type", F.concat(F.lit("size:"), scores.log_bucket(F.col("p_size")))))
    third = F.concat(words, F.array("p_brand", "p_type"), F.transform(words, lambda w: F.substring(w, 1, 2)))
    return p.select("p_partkey", signatures.bit_signature(F.array(F.element_at(words, 1)), 1).alias("l1"), signatures.bit_signature(second, 2).alias("l2"), signatures.bit_signature(third, 16).alias("l3"))


# bit places of each level, as sets
_BITS = """p as (select p_partkey, p_size, p_type, p_brand, string_split(p_name, ' ') as w, case when p_size <= 0 then '0' when p_size <= 2 then p_size::varchar else '2^~' || floor(log2(p_size))::int end as b from part),
  g as (select p_partkey, list_distinct(list_transform([w[1]], lambda f: ('0x' || substr(md5(f), 1, 8))::bigint % 64)) as l1, list_sort(list_distinct(list_transform(list_concat(w, [p_type, 'size:' || b]), lambda f: ('0x' || substr(md5(f), 1, 8))::bigint % 128))) as l2,
    list_sort(list_distinct(list_transform(list_concat(list_concat(w, [p_brand, p_type]), list_transform(w, lambda x: x[1:2])), lambda f: ('0x' || substr(md5(f), 1, 8))::bigint % 1024))) as l3 from p),
  c as (select l1, l2, l3, min(p_partkey) as rep, count(*) as members from g group by 1, 2, 3)"""
_JAC = "len(list_intersect({x}, {y}))::double / len(list_distinct(list_concat({x}, {y})))"


def _cascade(s: SparkSession, d: str) -> DataFrame:
    return signatures.cascade(_parts(s, d), "p_partkey", "l1", "l2", "l3")


def _refined(s: SparkSession, d: str) -> DataFrame:
    pairs = signatures.bucket_links(table(s, d, "part"), "p_brand", "p_partkey")
    return signatures.refined(pairs, _parts(s, d), "p_partkey", "l2", "l3")


def _sigs(s: SparkSession, d: str) -> DataFrame:
    rows = dedup.minhash(table(s, d, "benchmark"), "item_id", "text")
    return rows.select("item_id", F.array(*[F.col(f"h{i}") for i in range(8)]).alias("sig"))


_SIGS = "w as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) as w from benchmark), s as (select item_id, " + ", ".join(f"min(('0x' || substr(md5('{i}:' || w), 1, 8))::bigint) as h{i}" for i in range(8)) + " from w group by 1), z as (select item_id, [h0, h1, h2, h3, h4, h5, h6, h7] as sig from s)"
_SAME = "len(list_filter(range(1, 9), lambda i: x.sig[i] = y.sig[i]))"

PLANS = [
    ("drift_trends", _trends, f"with {_TRENDS} select * from trends"),
    ("conceptual_drift", lambda s, d: histories.conceptual_drift(_trends(s, d)), f"with {_TRENDS} select * from trends where states >= 5 and moved > 0.6"),
    ("drift_summary", lambda s, d: histories.drift_summary(_trends(s, d)), f"with {_TRENDS} select trend, count(*) as keys, count(*) filter (moved > 0.8) as high_risk from trends group by 1"),
    ("dead_ends", lambda s, d: histories.dead_ends(events(s, d).withColumn("user_id", F.col("event_id") % 150), "user_id", _O, "value", SCALE, F.lit("2024-04-01").cast("date"), 0.5, 2.0, 60),
        f"""with e as (select *, event_id % 150 as k from events), t as (select k, ts, {_D.format(a='value', b='lag(value) over (partition by k order by ts, event_id)')} as step_, lag(value) over (partition by k order by ts, event_id) is null as first_ from e),
        g as (select k, ts::date as day, sum(case when not first_ then step_ end) as moved, count(*) as n, max(ts) as last from t group by 1, 2), r as (select *, moved is not null as has, row_number() over (partition by k, moved is not null order by day) as u, row_number() over (partition by k, moved is not null order by day desc) as w from g),
        f as (select k as user_id, sum(n)::bigint as states, count(*) filter (has) as windows, round(sum(moved) filter (has and u <= 2), 6) as burst, round(sum(moved) filter (has and w <= 4), 6) as recent, datediff('day', max(last)::date, date '2024-04-01')::int as idle from r group by 1)
        select *, case when idle > 90 then 'high' when idle > 45 then 'medium' else 'low' end as risk from f where states >= 3 and windows >= 2 and burst > 0.5 and recent < 2.0 and idle > 60"""),
    ("state_stability", lambda s, d: histories.stability(events(s, d), "user_id", _O, "value"), """with w as (select *, avg(value) over n as m, stddev_pop(value) over n as x, row_number() over o as k, value - lag(value) over o as c from events window o as (partition by user_id order by ts, event_id), n as (partition by user_id order by ts, event_id rows between 2 preceding and current row))
        select user_id, ts, event_id, round(case when k < 2 then 0.0::double when m = 0 then 1.0 else greatest(0.0::double, 1 - x / m) end, 4) as stability, round(c, 6) as change from w"""),
    ("state_loops", lambda s, d: histories.loops(events(s, d), "user_id", _O, "event_type").groupBy("user_id").agg(F.count("*").alias("loops"), F.count_if("swing").alias("swings")), """with w as (select user_id, event_type as s, lag(event_type, 1) over o as a, lag(event_type, 2) over o as b, lag(event_type, 3) over o as c from events window o as (partition by user_id order by ts, event_id))
        select user_id, count(*) as loops, count(*) filter (coalesce(s = b and a = c and s <> a, false)) as swings from w where coalesce(s = a, false) or coalesce(s = b, false) or coalesce(s = c, false) group by 1"""),
    ("iteration_verdicts", lambda s, d: histories.continuation(events(s, d), "user_id", _O, "props", "value", 40, 0.05), """with w as (select user_id, ts, event_id, value, row_number() over o as k, row_number() over (partition by user_id, props order by ts, event_id) as seen, lag(value) over o as b from events window o as (partition by user_id order by ts, event_id))
        select user_id, ts, event_id, case when k > 40 then 'limit' when seen > 1 then 'loop' when (case when b = 0 then 0.0::double else (b - value) / b end) < 0.05::double then 'stalled' else 'continue' end as verdict from w"""),
    ("burst_facts", lambda s, d: histories.burst_facts(_seconds(s, d), "user_id", "at"), """with e as (select user_id, epoch_us(ts) / 1000000.0::double as sec from events), g as (select *, sec - lag(sec) over (partition by user_id order by sec) as gap from e)
        select user_id, count(*) as rows, round((max(sec) - min(sec)) / 3600, 4) as hours, (max(sec) - min(sec)) / 3600 <= 24 as burst, count(distinct floor(sec / 86400)) as days, round(coalesce(1 / (1 + stddev_pop(gap) / nullif(avg(gap), 0)), 0), 6) as evenness from g group by 1"""),
    ("chain_confidence", _chains, """select user_id, round(least(0.95::double, 0.6::double + case when count(*) >= 5 then 0.1::double else 0 end + case when count(*) >= 10 then 0.1::double else 0 end + case when count(distinct event_type) >= 3 then 0.1::double else 0 end
        + case when epoch_us(max(ts)) - epoch_us(min(ts)) < 1209600000000 then 0.1::double else 0 end), 6) as confidence from events group by 1"""),
    ("throttled_warnings", lambda s, d: histories.throttled(events(s, d), ["event_type", "user_id"], _O).select("event_id", "nth"), "with n as (select event_id, row_number() over (partition by event_type, user_id order by ts, event_id) as nth from events) select * from n where nth = 1 or nth % 5 = 0"),
    ("silent_keys", lambda s, d: histories.silent(_seconds(s, d).withColumn("user_id", F.col("event_id") % 997), "user_id", "at", 86400.0 * 2).select("user_id", F.round("silence", 3).alias("silence")), """with l as (select event_id % 997 as user_id, max(epoch_us(ts) / 1000000.0::double) as last from events group by 1)
        select user_id, round((select max(last) from l) - last, 3) as silence from l where (select max(last) from l) - last > 172800"""),
    ("strategy_outcomes", lambda s, d: histories.outcomes(events(s, d), "event_type", F.col("value") > 30), "select event_type, count(*) as tries, count(*) filter (value > 30) as successes, count(*) filter (not value > 30) as failures, round(avg((value > 30)::int), 6) as rate from events group by 1"),
    ("strategy_ranks", lambda s, d: histories.ranked_strategies(table(s, d, "lineitem"), "l_returnflag", {"l_quantity": 0.5, "l_discount": 30.0, "l_tax": -10.0}), "select l_returnflag, round(0.5::double * avg(l_quantity) + 30.0::double * avg(l_discount) - 10.0::double * avg(l_tax), 6) as score from lineitem group by 1"),
    ("operation_timings", lambda s, d: histories.timings(events(s, d), "event_type", "value"), "select event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 4) as mean, min(value) as least, max(value) as most from events group by 1"),
    ("file_batches", lambda s, d: histories.batches(table(s, d, "documents"), "source", "n_chars", "doc_id").select("doc_id", "batch"), "select doc_id, ((row_number() over (partition by source order by n_chars desc, doc_id) - 1) // 50)::int as batch from documents"),
    ("guess_validation", lambda s, d: histories.validated(table(s, d, "lineitem").withColumn("guess", 1500 * F.col("l_quantity")), "l_extendedprice", "guess"), """with r as (select l_extendedprice as t, 1500 * l_quantity as g from lineitem), k as (select t, g, rank() over (order by t) + (count(*) over (partition by t) - 1) / 2.0::double as rt, rank() over (order by g) + (count(*) over (partition by g) - 1) / 2.0::double as rg from r)
        select round(corr(t, g), 6) as pearson, round(corr(rt, rg), 6) as spearman, round(sqrt(sum((t - g) ** 2) / count(*)), 4) as rmse, round(1 - sum((t - g) ** 2) / (var_pop(t) * count(*)), 6) as r2 from k"""),
    ("cross_validation", lambda s, d: histories.cross_validated(table(s, d, "orders"), ["o_orderkey"], "o_totalprice", "o_custkey"), "with f as (select ntile(5) over (order by o_orderkey) as f, o_totalprice as t, o_custkey as g from orders), r as (select f, corr(t, g) as r from f group by 1) select count(*) as folds, round(avg(r), 6) as mean from r"),
    ("grid_search", lambda s, d: histories.grid_search(table(s, d, "lineitem"), "l_quantity", "l_discount", (0.8, 1.2, 1.6), (0.05, 0.5, 1.0)), """with g as (select a, s from (values (0.8::double), (1.2), (1.6)) x(a), (values (0.05::double), (0.5), (1.0)) y(s)), f as (select a as alpha, s as scale, round(corr(s * pow(l_quantity + 1, -a), l_discount) - avg((s * pow(l_quantity + 1, -a) - l_discount) ** 2), 6) as fit from lineitem, g group by 1, 2)
        select * from f order by fit desc, alpha, scale limit 1"""),
    ("signature_cascade", _cascade, f"""with {_BITS} select x.rep as a, y.rep as b, x.members, y.members as members_b from c x join c y on x.l1 = y.l1 and x.rep < y.rep where {_JAC.format(x='x.l2', y='y.l2')} >= 0.35 and {_JAC.format(x='x.l3', y='y.l3')} >= 0.25"""),
    ("signature_refinement", _refined, f"""with {_BITS}, k as (select p_brand, min(p_partkey) as a from part group by 1), q as (select a, p_partkey as b from part join k using (p_brand) where a <> p_partkey)
        select q.a, q.b from q join g x on x.p_partkey = q.a join g y on y.p_partkey = q.b where {_JAC.format(x='x.l2', y='y.l2')} >= 0.35 and {_JAC.format(x='x.l3', y='y.l3')} >= 0.25"""),
    ("bit_signature_facts", lambda s, d: _parts(s, d).select("p_partkey", signatures.popcount(F.col("l1")).alias("l1"), signatures.popcount(F.col("l2")).alias("l2"), signatures.popcount(F.col("l3")).alias("l3"), signatures.bit_distance(F.slice("l2", 1, 1), F.col("l1")).alias("apart")),
        f"with {_BITS} select p_partkey, len(l1)::int as l1, len(l2)::int as l2, len(l3)::int as l3, (len(list_filter(l2, lambda x: x < 64 and not list_contains(l1, x))) + len(list_filter(l1, lambda x: not list_contains(l2, x))))::int as apart from g"),
    ("minhash_probe", lambda s, d: signatures.probe(_sigs(s, d).where("item_id % 50 = 0"), _sigs(s, d), "item_id", 4, 0.25), f"""with {_SIGS} select x.item_id as query, y.item_id, round({_SAME} / 8.0::double, 6) as likeness from z x join z y on x.item_id % 50 = 0
        where ((x.sig[1:2] = y.sig[1:2]) or (x.sig[3:4] = y.sig[3:4]) or (x.sig[5:6] = y.sig[5:6]) or (x.sig[7:8] = y.sig[7:8])) and {_SAME} >= 2"""),
    ("minhash_union", lambda s, d: _sigs(s, d).alias("x").join(_sigs(s, d).withColumn("item_id", F.col("item_id") - 1).alias("y"), "item_id").select("item_id", F.array_join(signatures.merged(F.col("x.sig"), F.col("y.sig")), ",").alias("sig"), F.round(signatures.estimate(F.col("x.sig"), F.col("y.sig")), 6).alias("likeness")),
        f"with {_SIGS} select x.item_id, array_to_string(list_transform(range(1, 9), lambda i: least(x.sig[i], y.sig[i])), ',') as sig, round({_SAME} / 8.0::double, 6) as likeness from z x join z y on y.item_id = x.item_id + 1"),
    ("unseen_pairs", lambda s, d: signatures.unseen(signatures.bucket_links(table(s, d, "part"), "p_brand", "p_partkey"), signatures.bucket_links(table(s, d, "part"), "p_type", "p_partkey")),
        """with x as (select distinct least(a, p_partkey) as a, greatest(a, p_partkey) as b from (select p_partkey, min(p_partkey) over (partition by p_brand) as a from part) where a <> p_partkey), y as (select distinct a, p_partkey as b from (select p_partkey, min(p_partkey) over (partition by p_type) as a from part) where a <> p_partkey)
        select * from x except select * from y"""),
    ("latest_buffer", lambda s, d: timeseries.last_snapshots(events(s, d), "event_type", "ts", "event_id").select("event_id", "event_type"), "with n as (select event_id, event_type, row_number() over (partition by event_type order by ts desc, event_id desc) as n from events) select event_id, event_type from n where n <= 10"),
]

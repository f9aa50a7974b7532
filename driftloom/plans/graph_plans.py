"""Directed-graph queries and their DuckDB twins: name, query, SQL. Calls link customers inside groups of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import graph, paths
from driftloom.operators import issue_algebra as ia
from driftloom.sources.tables import table

from .adapters import EDGES, ISSUES, edges, issues


def calls(s: SparkSession, d: str) -> DataFrame:
    """Edges from each order's customer to a neighbour in its own or, from every first of two groups, the next group of eight."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    room = F.when(F.expr("(o_custkey div 8) % 2 = 1"), 8).otherwise(12)
    return table(s, d, "orders").select(c.alias("src"), (c - c % 8 + o % room).alias("dst"))


CALLS = "calls as (select o_custkey as src, o_custkey - o_custkey % 8 + o_orderkey % (case when (o_custkey // 8) % 2 = 1 then 8 else 12 end) as dst from orders)"
_REACH = f"""with recursive {CALLS}, e as (select distinct src, dst from calls), r as (select src, dst from e union select r.src, e.dst from r join e on r.dst = e.src),
  n as (select src as node from e union select dst from e), scc as (select n.node, least(n.node, coalesce((select min(x.dst) from r x join r y on y.src = x.dst and y.dst = x.src where x.src = n.node), n.node)) as scc from n)"""


def _forward(s: SparkSession, d: str) -> DataFrame:
    return calls(s, d).where("src < dst")


def _weighted(s: SparkSession, d: str) -> DataFrame:
    return calls(s, d).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def _members(s: SparkSession, d: str) -> DataFrame:
    return paths.strong_components(calls(s, d))


def _imports(s: SparkSession, d: str) -> DataFrame:
    line = F.col("l_linenumber")
    return table(s, d, "lineitem").select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 30).cast("string")).alias("src"), F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string"), F.lit(".sub")).alias("dst"),
        (line % 2 == 0).alias("top"), (line == 5).alias("star"), F.when(line < 4, line).alias("names"),
    )


def _shared(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    uses = o.select(F.col("o_custkey").alias("node"), F.col("o_orderpriority").alias("symbol"))
    home = table(s, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("symbol"))
    return paths.shared_symbols(uses, _members(s, d), home.unionByName(uses.where("symbol = '1-URGENT'")))


def _elements(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_custkey").alias("module"), F.col("c_name").alias("element"))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    asked = issues(s, d).select("event_id", "file", F.coalesce("symbol", F.lit("none")).alias("name"))
    known = issues(s, d).where("severity = 5 and symbol is not null").select(F.col("event_id").alias("id"), "file", F.col("symbol").alias("name"))
    return paths.resolve(asked, known).select("event_id", "target")


def _fixes(s: SparkSession, d: str) -> DataFrame:
    return issues(s, d).select(F.col("event_id").alias("id"), "file", "line", F.concat("symbol", F.lit("/"), "file").alias("symbol"), F.when(F.col("kind") == "error", "delete").otherwise("replace").alias("action"))


def _issue_groups(s: SparkSession, d: str) -> DataFrame:
    i = issues(s, d)
    found = graph.components(ia.related(i, ["file", "symbol"]))
    return paths.grouped_components(i, i.select(F.col("event_id").alias("node")), found).groupBy("component").agg(F.count("*").alias("issues"))


def _labels(rounds: int, pairs: str, nodes: str) -> str:
    """Least-label propagation over ``pairs`` (u, v) for some rounds."""
    out = f"l0 as (select node, node as label from {nodes})"
    for k in range(rounds):
        out += f", l{k + 1} as (select l.node, least(l.label, coalesce(m.label, l.label)) as label from l{k} l left join (select u as node, min(label) as label from {pairs} join l{k} on node = v group by 1) m on m.node = l.node)"
    return out


PLANS = [
    ("import_weights", lambda s, d: paths.import_weights(_imports(s, d)), """select 'm' || (l_suppkey % 30) as src, 'p' || (l_partkey % 20) as dst, round(sum((case when l_linenumber % 2 = 0 then 2.0::double else 1.0 end) *
        (case when l_linenumber = 5 then 3.0::double when l_linenumber < 4 then 1 + 0.2::double * l_linenumber else 1.0 end)), 6) as weight from lineitem group by 1, 2"""),
    ("strong_components", _members, f"{_REACH} select node, scc from scc"),
    ("cyclic_groups", lambda s, d: paths.cyclic_groups(calls(s, d), _members(s, d)), f"""{_REACH}, z as (select scc, count(*) as size from scc group by 1),
        i as (select x.scc, count(*) as inside from e join scc x on x.node = src join scc y on y.node = dst where x.scc = y.scc group by 1) select scc, size, inside, round(inside / (size * size), 6) as density from z join i using (scc)"""),
    ("break_edges", lambda s, d: paths.light_edges(_weighted(s, d), _members(s, d)), f"""{_REACH}, w as (select src, dst, count(*)::double as weight from calls group by 1, 2)
        select x.scc, row_number() over (partition by x.scc order by weight, src, dst) as nth, src, dst, weight from w join scc x on x.node = src join scc y on y.node = dst where x.scc = y.scc and src <> dst qualify nth <= 3"""),
    ("shared_symbols", _shared, f"""{_REACH}, u as (select distinct o_custkey as node, o_orderpriority as symbol from orders), c as (select scc, symbol, count(*) as users from u join scc using (node) group by 1, 2 having count(*) > 1),
        h as (select symbol, min(node) as home from (select c_mktsegment as symbol, c_custkey as node from customer union all select symbol, node from u where symbol = '1-URGENT') group by 1) select scc, symbol, users, home from c left join h using (symbol)"""),
    ("short_cycles", lambda s, d: paths.cycles(calls(s, d), 3).groupBy("size").agg(F.count("*").alias("cycles"), F.sum(F.col("path")[0]).alias("starts")),
        f"""with {CALLS}, e as (select distinct src, dst from calls), c as (select 1 as size, src as a from e where src = dst union all select 2, x.src from e x join e y on x.dst = y.src and y.dst = x.src where x.src < x.dst
        union all select 3, x.src from e x join e y on x.dst = y.src join e z on y.dst = z.src and z.dst = x.src where x.src < x.dst and x.src < y.dst and y.dst <> x.dst) select size, count(*) as cycles, sum(a)::bigint as starts from c group by 1"""),
    ("weakest_links", lambda s, d: paths.weakest_links(paths.cycles(calls(s, d), 2), F.col("b") % 5 == 0), f"""with {CALLS}, e as (select distinct src, dst from calls), c as (select src::varchar as cycle, src as a, src as b from e where src = dst
        union all select x.src || '>' || x.dst, case when x.dst % 5 = 0 or x.src % 5 <> 0 then x.src else x.dst end, case when x.dst % 5 = 0 or x.src % 5 <> 0 then x.dst else x.src end from e x join e y on x.dst = y.src and y.dst = x.src where x.src < x.dst) select * from c"""),
    ("topological_levels", lambda s, d: paths.levels(_forward(s, d)), f"""with recursive {CALLS}, e as (select distinct src, dst from calls where src < dst), n as (select src as node from e union select dst from e),
        l as (select node, 0 as level from n where node not in (select dst from e) union select e.dst, level + 1 from l join e on e.src = l.node) select node, max(level) as level from l group by 1"""),
    ("shortest_distances", lambda s, d: paths.distances(calls(s, d), calls(s, d).select(F.col("src").alias("node")), 6).groupBy("hops").agg(F.count("*").alias("pairs"), F.sum("node").alias("nodes")),
        f"""with recursive {CALLS}, e as (select distinct src, dst from calls), r as (select distinct src as source, src as node, 0 as hops from e union select source, e.dst, hops + 1 from r join e on e.src = r.node where hops < 6),
        f as (select source, node, min(hops) as hops from r group by 1, 2) select hops, count(*) as pairs, sum(node)::bigint as nodes from f group by 1"""),
    ("cascade_potential", lambda s, d: paths.cascades(calls(s, d), table(s, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("group")), 20),
        f"""{_REACH}, p as (select src, dst from r where src <> dst), d as (select src as node, count(*) as n from p group by 1), u as (select dst as node, count(*) as n from p group by 1), g as (select src as node, count(distinct c_mktsegment) as n from p join customer on c_custkey = dst group by 1)
        select n.node, coalesce(d.n, 0) as descendants, coalesce(u.n, 0) as ancestors, coalesce(g.n, 0) as groups, round((2 * coalesce(d.n, 0) + coalesce(u.n, 0)) * (1 + 0.1::double * coalesce(g.n, 0)), 4) as potential from n left join d using (node) left join u using (node) left join g using (node)"""),
    ("degree_facts", lambda s, d: paths.degree_facts(edges(s, d)), f"""with {EDGES}, e as (select distinct src, dst from edges), t as (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e), k as (select node, sum(i)::bigint as fan_in, sum(o)::bigint as fan_out from t group by 1)
        select *, fan_in * fan_out + fan_in as paths, round(least(1.0::double, (0.7::double * fan_in + 0.3::double * fan_out) / 20), 6) as reach from k"""),
    ("issue_intersections", lambda s, d: paths.intersections(paths.degree_facts(edges(s, d))), f"""with {EDGES}, e as (select distinct src, dst from edges), t as (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e), k as (select node, (sum(i) * sum(o) + sum(i))::bigint as paths from t group by 1)
        select * from k where paths > greatest(2.0::double, 0.1::double * (select count(*) from k))"""),
    ("influential_top_tenth", lambda s, d: paths.top_share(paths.degree_facts(edges(s, d)).select("node", "paths"), "paths", "node"), f"""with {EDGES}, e as (select distinct src, dst from edges), t as (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e), k as (select node, (sum(i) * sum(o) + sum(i))::bigint as paths from t group by 1)
        select node, paths from k qualify row_number() over (order by paths desc, node) <= greatest(1, floor(0.1 * count(*) over ()))"""),
    ("import_anchors", lambda s, d: paths.anchors(calls(s, d), _elements(s, d)), f"""with {CALLS}, e as (select distinct src, dst from calls where src < dst or dst < src)
        select x.src, x.dst, p.c_name as a, q.c_name as b from e x join e y on x.dst = y.src and y.dst = x.src join customer p on p.c_custkey = x.src join customer q on q.c_custkey = x.dst where x.src < x.dst"""),
    ("call_resolution", _resolved, f"""with {ISSUES}, k as (select event_id as id, file, symbol as name from issues where severity = 5 and symbol is not null), a as (select event_id, file, coalesce(symbol, 'none') as name from issues),
        s as (select file, name, min(id) as i from k group by 1, 2), o as (select name, min(id) as i from k group by 1) select event_id, coalesce(s.i, o.i) as target from a left join s on s.file = a.file and s.name = a.name left join o on o.name = a.name"""),
    ("layer_dependencies", lambda s, d: paths.layer_dependencies(calls(s, d), table(s, d, "customer").select("c_custkey", "c_mktsegment")), f"""with {CALLS}, e as (select distinct src, dst from calls)
        select p.c_mktsegment as from_layer, q.c_mktsegment as to_layer, count(*) as edges from e join customer p on p.c_custkey = src join customer q on q.c_custkey = dst where p.c_mktsegment <> q.c_mktsegment group by 1, 2"""),
    ("fix_conflicts", lambda s, d: paths.place_conflicts(_fixes(s, d)), f"""with {ISSUES}, f as (select event_id as id, file, line, symbol || '/' || file as symbol, case when kind = 'error' then 'delete' else 'replace' end as action from issues)
        select 'place' as by, file || ':' || line as key, count(*) as fixes from f where file is not null group by 2 having count(*) > 1
        union all select 'symbol', symbol, count(*) from f where symbol is not null group by 2 having max(id) filter (action = 'replace') > min(id) filter (action = 'delete')"""),
    ("related_issue_groups", _issue_groups, f"""with {ISSUES}, n as (select event_id as node from issues), pairs as (select event_id as u, min(event_id) over (partition by file) as v from issues where file is not null union select event_id, min(event_id) over (partition by symbol) from issues where symbol is not null),
        ways as (select u, v from pairs union select v, u from pairs), {_labels(8, "ways", "n")} select label as component, count(*) as issues from l8 group by 1"""),
    ("component_risk", lambda s, d: paths.risk_bands(graph.components(calls(s, d))), f"""with {CALLS}, ways as (select src as u, dst as v from calls union select dst, src from calls), n as (select distinct u as node from ways), {_labels(12, "ways", "n")},
        z as (select label as component, count(*) as size from l12 group by 1) select component, size, case when size >= 10 then 'high' when size >= 5 then 'medium' else 'low' end as risk from z"""),
]

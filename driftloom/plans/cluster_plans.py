"""Groups, matrices, samples and layers, with their DuckDB twins: name, query, SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import clusters as cl
from driftloom.operators import vectors
from driftloom.sources.tables import table

from .adapters import ISSUES, issues
from .graph_plans import CALLS, _labels, calls


def _brands(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_brand").alias("cluster"), F.col("p_name").alias("member"))


def _types(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.concat("p_type", (F.col("p_size") % 9).cast("string")).alias("cluster"), F.col("p_name").alias("member"))


_B = "b as (select distinct p_brand as cluster, p_name as member from part), t as (select distinct p_type || (p_size % 9) as cluster, p_name as member from part)"


def _matrix(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 12).alias("i"), (F.col("l_partkey") % 12).alias("j"))
    return e.agg(F.sum("l_quantity").alias("value"))


_M = "m as (select l_suppkey % 12 as i, l_partkey % 12 as j, sum(l_quantity) as value from lineitem group by 1, 2)"


def _risks(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 12).alias("i"), (F.col("l_partkey") % 12).alias("j"))
    return e.agg((F.max("l_discount") * 7).alias("risk")).where("i <> j")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").where("l_partkey <> l_suppkey").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_discount").alias("value"))


def _costs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("site"), (F.col("l_partkey") % 50).alias("client")).agg(F.round(F.avg("l_quantity"), 4).alias("cost"))


_C = "c as (select l_suppkey % 10 as site, l_partkey % 50 as client, round(avg(l_quantity), 4) as cost from lineitem group by 1, 2)"


_WEIGHTS = {"(?i)todo|fixme": 0.2, "[!?]{2,}": 0.1, r"\d{4,}": 0.05}

PLANS = [
    ("cluster_representatives", lambda s, d: cl.representatives(_brands(s, d), "cluster", "member"), "select p_brand as cluster, min(p_name) as representative, count(*) as size from part group by 1"),
    ("cluster_overlaps", lambda s, d: cl.overlapping(_brands(s, d), _types(s, d), 0.5), f"with {_B}, n as (select cluster, count(*) as n from b group by 1), m as (select cluster, count(*) as n from t group by 1), h as (select b.cluster as a, t.cluster as b, count(*) as k from b join t using (member) group by 1, 2) select a, b, round(k / least(n.n, m.n), 6) as share from h join n on n.cluster = a join m on m.cluster = b where round(k / least(n.n, m.n), 6) >= 0.5"),
    ("cluster_absorption", lambda s, d: cl.absorbed(table(s, d, "part").where("p_size < 3").select(F.col("p_size").alias("cluster"), F.col("p_name").alias("member")), table(s, d, "part").select((F.col("p_partkey") % 400).cast("int").alias("cluster"), F.col("p_name").alias("member"))),
        "with f as (select p_size as cluster, p_name as member from part where p_size < 3), g as (select (p_partkey % 400)::int as cluster, p_name as member from part), t as (select distinct cluster from g where member in (select member from f)) select 'first' as kind, * from f union all select 'second', * from g where cluster not in (select cluster from t)"),
    ("grouping_keys", lambda s, d: cl.grouped_by_keys(table(s, d, "part"), "p_partkey", {"brand": F.col("p_brand"), "name": F.substring_index("p_name", " ", 1), "size": F.floor(F.col("p_size") / 10)}),
        "with k as (select 'brand' as by, p_brand as key, p_partkey as m from part union all select 'name', string_split(p_name, ' ')[1], p_partkey from part union all select 'size', (p_size // 10)::varchar, p_partkey from part) select \"by\", key, count(*) as members, min(m) as first from k group by 1, 2 having count(*) >= 2"),
    ("inside_shares", lambda s, d: cl.inside_share(calls(s, d), table(s, d, "customer").select(F.floor(F.col("c_custkey") / 8).alias("cluster"), F.col("c_custkey").alias("member"))), f"with {CALLS} select src // 8 as cluster, count(*) as edges, round(avg(coalesce((src // 8 = dst // 8 and dst in (select c_custkey from customer))::int, 0)), 6) as inside from calls where src in (select c_custkey from customer) group by 1"),
    ("stability_index", lambda s, d: cl.stability_index(table(s, d, "lineitem"), "l_suppkey", "l_quantity"), "with g as (select avg(l_quantity) as m, stddev_pop(l_quantity) as s from lineitem group by l_suppkey) select round(1 / (1 + avg(s / m)), 6) as stability from g where m <> 0"),
    ("similarity_matrix", lambda s, d: cl.symmetric(_pairs(s, d)), "with p as (select l_suppkey as a, l_partkey as b, l_discount as value from lineitem where l_partkey <> l_suppkey), u as (select a as i, b as j, value from p union all select b, a, value from p union all select distinct a, a, 1.0::double from p union all select distinct b, b, 1.0::double from p) select i, j, max(value) as value from u group by 1, 2"),
    ("heatmap_glyphs", lambda s, d: cl.glyphs(_matrix(s, d), _risks(s, d)), f"""with {_M}, r as (select l_suppkey % 12 as i, l_partkey % 12 as j, max(l_discount) * 7 as risk from lineitem group by 1, 2), e as (select min(value) as low, max(value) as high from m)
        select m.i, m.j, coalesce(case when risk > 0.8 then '!' when risk > 0.5 then '^' when risk > 0.2 then '~' end, [' ', '.', ':', '*', '#'][least(floor((value - low) / (high - low) * 4), 4)::int + 1]) as glyph from m cross join e left join r on r.i = m.i and r.j = m.j and m.i <> m.j"""),
    ("matrix_changes", lambda s, d: cl.changed_totals(_matrix(s, d), _matrix(s, d).withColumn("value", F.col("value") * (1 - F.col("j") / 20)), F.floor(F.col("i") / 4)), f"with {_M}, t as (select i // 4 as domain, round(sum(value), 4) as before, round(sum(value * (1 - j / 20)), 4) as after from m group by 1) select domain, before, after, round(after - before, 4) as change, round(100 * round(after - before, 4) / before, 4) as percent from t"),
    ("staged_sample", lambda s, d: cl.staged_sample(table(s, d, "part"), "p_partkey", {"name": (F.substring_index("p_name", " ", 1), 3), "brand": (F.col("p_brand"), 2), "size": (F.floor(F.col("p_size") / 10), 1)}),
        """with a as (select p_partkey from part qualify row_number() over (partition by string_split(p_name, ' ')[1] order by md5(p_partkey::varchar), p_partkey) <= 3), b as (select p_partkey from part where p_partkey not in (select * from a) qualify row_number() over (partition by p_brand order by md5(p_partkey::varchar), p_partkey) <= 2),
        c as (select p_partkey from part where p_partkey not in (select * from a) and p_partkey not in (select * from b) qualify row_number() over (partition by p_size // 10 order by md5(p_partkey::varchar), p_partkey) <= 1)
        select p_partkey, 'name' as stage from a union all select p_partkey, 'brand' from b union all select p_partkey, 'size' from c"""),
    ("pattern_scores", lambda s, d: table(s, d, "documents").select("doc_id", F.round(cl.pattern_score(F.col("text"), _WEIGHTS, F.when(F.col("n_chars") > 5000, 0.3).otherwise(0.0)), 6).alias("score")),
        "select doc_id, round(least(1.0::double, case when n_chars > 5000 then 0.3::double else 0 end + " + " + ".join(f"{w}::double * len(regexp_extract_all(coalesce(text, ''), '{p}'))" for p, w in _WEIGHTS.items()) + "), 6) as score from documents"),
    ("repetitive_lists", lambda s, d: table(s, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.when(F.col("p_brand").endswith("1"), F.concat(F.lit("item"), F.col("p_partkey").cast("string"))).when(F.col("p_brand").endswith("2"), F.lit("x")).otherwise(F.concat(F.lit("foo"), F.col("p_type"))))).alias("l")).select("p_brand", cl.repetitive(F.col("l"), "^foo").alias("kind")),
        "select p_brand, case when p_brand like '%1' and count(*) >= 3 then 'numbered' when p_brand like '%1' then null when p_brand like '%2' then case when count(*) >= 3 then 'uniform' end else 'placeholder' end as kind from part group by 1"),
    ("issue_layers", lambda s, d: cl.layered(issues(s, d), F.coalesce("file", F.lit("")), {"core": "^m1", "edge": "^m[23]", "none": "^zz"}), f"with {ISSUES}, l as (select case when file like 'm1%' then 'core' when file like 'm2%' or file like 'm3%' then 'edge' else 'unknown' end as layer from issues) select n.layer, count(l.layer) as rows from (values ('core'), ('edge'), ('none'), ('unknown')) n(layer) left join l using (layer) group by 1"),
    ("unused_imports", lambda s, d: cl.unused_imports(table(s, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("name")).distinct(), table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("name"))),
        "with i as (select distinct l_orderkey as file, l_partkey as name from lineitem), u as (select distinct l_orderkey as file, l_partkey as name, 1 as u from lineitem where l_returnflag = 'R') select file, count(*) as imports, count(*) filter (u is null) as unused, round(avg((u is null)::int), 6) as ratio from i left join u using (file, name) group by 1"),
    ("cluster_spread", lambda s, d: cl.spread_of(table(s, d, "part"), "p_brand", "p_size"), "select p_brand, count(*) as size, round(avg(p_size), 4) as mean, round(var_pop(p_size) / avg(p_size), 4) as spread from part group by 1 having count(*) >= 2"),
    ("snapshot_changes", lambda s, d: cl.between_snapshots(issues(s, d).groupBy("symbol", F.dayofmonth("ts").alias("day")).agg(F.count("*").alias("n")).where("symbol is not null"), "symbol", "day", "n"), f"""with {ISSUES}, d as (select symbol as k, day(ts)::int as s, count(*) as v from issues where symbol is not null group by 1, 2), p as (select k, s + 1 as s, v as w from d where s + 1 <= (select max(s) from d))
        select s as snapshot, count(*) filter (v = w) as kept, count(*) filter (v <> w) as changed, count(*) filter (w is null) as added, count(*) filter (v is null) as gone from d full join p using (k, s) group by 1"""),
    ("lacking_checks", lambda s, d: cl.lacking_checks(issues(s, d).select("symbol", (F.col("kind") == "error").alias("e"), (F.col("line") == 0).alias("b"), F.col("file").isNull().alias("n"), (F.col("severity") > 9).alias("z")), "symbol", ["e", "b", "n", "z"], 1),
        f"with {ISSUES} select symbol, ((max((kind = 'error')::int) = 0)::int + (max((line = 0)::int) = 0)::int + (max((file is null)::int) = 0)::int + 1)::int as lacking from issues group by 1"),
    ("greedy_facilities", lambda s, d: cl.greedy_facilities(_costs(s, d), 2), f"""with {_C}, t as (select site, round(sum(cost), 6) as total from c group by 1), a as (select * from t order by total, site limit 1), b as (select client, cost as best from c where site = (select site from a)),
        u as (select c.site, round(sum(least(cost, best)), 6) as total from c join b using (client) group by 1), z as (select * from u order by total, site limit 1) select 1::int as nth, site, total from a union all select 2, site, total from z"""),
    ("density_clusters", lambda s, d: vectors.density_clusters(table(s, d, "embeddings"), "vec_id", "embedding", "label", 0.25, 4), f"""with p as (select x.vec_id as u, y.vec_id as v from embeddings x join embeddings y on x.label = y.label and x.vec_id <> y.vec_id where round(list_cosine_similarity([v::double for v in x.embedding], [v::double for v in y.embedding]), 6) >= 0.25),
        core as (select u as node from p group by 1 having count(*) + 1 >= 4), ways as (select u, v from p where u in (select node from core) and v in (select node from core)), {_labels(14, "ways", "core")},
        near as (select u as node, min(l14.label) as border from p join l14 on node = v group by 1) select vec_id as node, coalesce(l14.label, border) as cluster from embeddings left join l14 on l14.node = vec_id left join near on near.node = vec_id"""),
]

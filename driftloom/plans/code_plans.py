"""Source-text facts and the rules over them, with their DuckDB twins: name, query, SQL.

The tables hold no code, so each part stands for a small module whose text follows from its columns; the twins derive the
facts from the columns without any parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import detectors as dt
from driftloom.sources import code
from driftloom.sources.tables import table

VERBS = ("get", "verify", "compute", "load", "check", "mock")
BODIES = ("pass", "raise NotImplementedError('later')", "return None", "...", "return helper_%(b)s(p) + 1", "if p:\n        return unknown_%(b)s(q)\n    return p")
KINDS = ("pass", "not_implemented", "trivial_return", "ellipsis", "code", "code")


def modules(s: SparkSession, d: str) -> DataFrame:
    """One module for each part: path, text. Every tenth text has a broken line, every tenth too many of them."""
    p = table(s, d, "part")
    a, b = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    verb = F.element_at(F.array(*[F.lit(v) for v in VERBS]), (1 + F.col("p_partkey") % 6).cast("int"))
    body = F.lit("")
    for k, form in enumerate(BODIES):
        body = F.when(F.col("p_size") % 6 == k, F.replace(F.lit(form), F.lit("%(b)s"), b)).otherwise(body)
    broken = F.when(F.col("p_partkey") % 10 == 9, "x = = 1\n").when(F.col("p_partkey") % 10 == 8, "x = = 1\n" * 5).otherwise("")
    doc = F.when(F.col("p_size") % 2 == 0, '    """What it does."""\n').otherwise("")
    cls = F.concat(F.upper(F.substring(a, 1, 1)), F.substring(a, 2, 99), F.col("p_size").cast("string"))
    parent = F.when(F.col("p_partkey") % 3 == 0, "(Root)").otherwise("")
    supers = F.when(F.col("p_partkey") % 4 == 0, "        super().__init__()\n").otherwise("")
    text = F.concat(
        broken, F.lit("import os, "), a, F.lit("_lib\nfrom "), b, F.lit("_pkg import x"), (F.col("p_size") % 3).cast("string"), F.lit(", y\n\n\ndef "), verb, F.lit("_"), a, F.lit("_"),
        b, F.lit("(p, q):\n"), doc, F.lit("    "), body, F.lit("\n\n\nclass "), cls, parent, F.lit(":\n    def __init__(self):\n"), supers,
        F.lit("        self."), b, F.lit(" = os.getcwd()\n\n    def run(self):\n        return 1 if y else 0\n"),
    )
    path = F.concat(F.lit("m"), (F.col("p_partkey") % 25).cast("string"), F.lit("/f"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return p.select(path.alias("path"), text.alias("text"))


# lines dropped stay as empty lines, so line numbers of a broken text are those of its own lines
MODULES = """mods as (select *, 'm' || (p_partkey % 25) || '/f' || p_partkey || '.py' as path, string_split(p_name, ' ')[1] as a, string_split(p_name, ' ')[-1] as b,
  ['get', 'verify', 'compute', 'load', 'check', 'mock'][1 + p_partkey % 6] as verb, (p_partkey % 10 = 9)::int as off, p_size % 6 as k, upper(string_split(p_name, ' ')[1][1]) || string_split(p_name, ' ')[1][2:] || p_size as cls from part),
  good as (select * from mods where p_partkey % 10 <> 8),
  funcs as (select path, verb || '_' || a || '_' || b as name, null as owner, 5 + off as line, ['pass', 'not_implemented', 'trivial_return', 'ellipsis', 'code', 'code'][1 + k] as body, case when k = 5 then 2 else 1 end as complexity, p_size % 2 = 0 as documented, a, b, k, p_partkey, p_size from good
    union all select path, '__init__', cls, null, 'code', 1, false, a, b, k, p_partkey, p_size from good union all select path, 'run', cls, null, 'code', 2, false, a, b, k, p_partkey, p_size from good),
  callrows as (select path, 'getcwd' as name, 0 as args from good union all select path, 'helper_' || b, 1 from good where k = 4 union all select path, 'unknown_' || b, 1 from good where k = 5
    union all select path, 'NotImplementedError', 1 from good where k = 1 union all select path, 'super', 0 from good where p_partkey % 4 = 0 union all select path, '__init__', 0 from good where p_partkey % 4 = 0)"""
_W = f"with {MODULES}"


def _facts(kind: str):
    return lambda s, d: code.facts(modules(s, d), kind)


def functions(s: SparkSession, d: str) -> DataFrame:
    return code.facts(modules(s, d), "functions")


def _stub_rows(s: SparkSession, d: str) -> DataFrame:
    return dt.triage(dt.placeholders(functions(s, d)), block=r"get_red", allow=r"m7/")


_STUB = "body in ('pass', 'not_implemented', 'trivial_return', 'todo', 'ellipsis')"


def _import_lines(s: SparkSession, d: str) -> DataFrame:
    """Import lines for the joins on line numbers: each line item of an order is a line of a file."""
    return table(s, d, "lineitem").select((F.col("l_suppkey")).alias("file"), (F.col("l_orderkey") % 400 + F.col("l_linenumber")).cast("int").alias("line"), (F.col("l_partkey") % 3).alias("module"))


_LINES = "ils as (select l_suppkey as file, (l_orderkey % 400 + l_linenumber)::int as line, l_partkey % 3 as module from lineitem)"


def _segments(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select((F.col("o_custkey") % 10).alias("file"), (F.col("o_orderkey") % 380).alias("low"), (F.col("o_orderkey") % 380 + F.col("o_custkey") % 30).alias("high"), F.col("o_orderkey").alias("ordinal"))


PLANS = [
    ("parse_statuses", lambda s, d: code.statuses(modules(s, d)).groupBy("status").agg(F.count("*").alias("files"), F.sum(F.size("warnings")).alias("warnings")),
        f"{_W} select case p_partkey % 10 when 8 then 'quarantined' when 9 then 'recovered' else 'parsed' end as status, count(*) as files, sum(case p_partkey % 10 when 8 then 4 when 9 then 1 else 0 end)::bigint as warnings from mods group by 1"),
    ("parse_rates", lambda s, d: code.rates(code.statuses(modules(s, d))), f"{_W} select count(*) as files, round(avg((p_partkey % 10 <> 8)::int), 6) as parsed, round(avg((p_partkey % 10 = 9)::int), 6) as partial, round(avg((p_partkey % 10 = 8)::int), 6) as quarantined from mods"),
    ("code_functions", lambda s, d: functions(s, d).groupBy("path", "name", "owner", "body", "complexity", "documented").agg(F.count("*").alias("n")), f"{_W} select path, name, owner, body, complexity, documented, count(*) as n from funcs group by all"),
    ("code_classes", lambda s, d: code.facts(modules(s, d), "classes").select("path", "name", F.array_join("bases", ",").alias("bases"), F.array_join("methods", ",").alias("methods"), "has_init", "super_init", F.array_join("fields", ",").alias("fields")),
        f"{_W} select path, cls as name, case when p_partkey % 3 = 0 then 'Root' else '' end as bases, '__init__,run' as methods, true as has_init, p_partkey % 4 = 0 as super_init, b as fields from good"),
    ("code_imports", lambda s, d: code.facts(modules(s, d), "imports").select("path", "module", F.array_join("names", ",").alias("names"), "line", "level", "star", "top"),
        f"{_W} select path, 'os' as module, '' as names, 1 + off as line, 0 as level, false as star, true as top from good union all select path, a || '_lib', '', 1 + off, 0, false, true from good union all select path, b || '_pkg', 'x' || (p_size % 3) || ',y', 2 + off, 0, false, true from good"),
    ("code_calls", lambda s, d: code.facts(modules(s, d), "calls").groupBy("path", "name", "args").agg(F.count("*").alias("n")), f"{_W} select path, name, args, count(*) as n from callrows group by all"),
    ("undefined_names", _facts("undefined"), f"{_W} select path, 'helper_' || b as name from good where k = 4 union all select path, 'unknown_' || b from good where k = 5 union all select path, 'Root' from good where p_partkey % 3 = 0"),
    ("code_lines", lambda s, d: code.lines(modules(s, d)).groupBy("path").agg(F.max("number").alias("lines"), F.count_if(F.length("line") > 0).alias("filled")),
        f"{_W} select path, 15 + off + case when p_partkey % 10 = 8 then 5 else 0 end + (p_size % 2 = 0)::int + (p_partkey % 4 = 0)::int + case when k = 5 then 2 else 0 end as lines, (9 + off + case when p_partkey % 10 = 8 then 5 else 0 end + (p_size % 2 = 0)::int + (p_partkey % 4 = 0)::int + case when k = 5 then 2 else 0 end)::bigint as filled from mods"),
    ("stub_patterns", lambda s, d: code.pattern_hits(modules(s, d), {"pass": r"^\s*pass\s*$", "later": r"NotImplementedError", "dots": r"^\s*\.\.\.\s*$"}).groupBy("path", "pattern").agg(F.count("*").alias("hits"), F.max(F.size(F.split("context", "\n"))).alias("context")),
        f"{_W} select path, ['pass', 'later', null, 'dots'][1 + k] as pattern, 1::bigint as hits, 5 as context from mods where k in (0, 1, 3)"),
    ("ignored_paths", lambda s, d: modules(s, d).groupBy(code.ignored(F.col("path"), ["m1/", "f?.py", "m2*/f1*"]).alias("ignored")).agg(F.count("*").alias("files")),
        f"{_W} select path like 'm1/%' or regexp_matches(path, '/f.\\.py$') or regexp_matches(path, '^m2[^/]*/f1[^/]*$') as ignored, count(*) as files from mods group by 1"),
    ("placeholder_functions", lambda s, d: dt.placeholders(functions(s, d), ["get_red_widget"]).select("path", "name", "body", "severity"), f"{_W} select path, name, body, case when body = 'trivial_return' then 1 else 2 end as severity from funcs where {_STUB} and name <> 'get_red_widget'"),
    ("graded_placeholders", lambda s, d: dt.graded_placeholders(functions(s, d), code.facts(modules(s, d), "calls")).select("path", "name", "kind", "grade"),
        f"""{_W}, g as (select path, name, case when body in ('todo', 'pass', 'trivial_return', 'not_implemented') then body when regexp_matches(name, '^(calculate|compute|process|validate|analyze|transform|convert|parse|generate|build|verify|check)') and complexity <= 1 then 'low_complexity_logic' when body = 'ellipsis' then 'ellipsis' end as kind from funcs)
        select path, name, kind, case kind when 'not_implemented' then 1 when 'low_complexity_logic' then 3 else 2 end + (name in (select name from callrows))::int as grade from g where kind is not null"""),
    ("stub_counts", lambda s, d: dt.stub_counts(functions(s, d)), f"{_W}, c as (select body as kind, count(*) as stubs from funcs where {_STUB} group by 1) select * from c union all select 'all', sum(stubs)::bigint from c having sum(stubs) > 10"),
    ("most_stubbed_files", lambda s, d: dt.most_stubbed(functions(s, d), 7), f"{_W} select path, count(*) as stubs from funcs where {_STUB} group by 1 order by 2 desc, 1 limit 7"),
    ("real_placeholders", lambda s, d: dt.real_placeholders(functions(s, d)).select("path", "name"), f"{_W} select path, name from funcs where {_STUB} and name not like 'mock\\_%' escape '\\'"),
    ("stub_triage", lambda s, d: _stub_rows(s, d).select("path", "name", "priority"), f"""{_W} select path, name, case when name like 'get_red%' then 'P0' when path like 'm7/%' then 'P3' when regexp_matches(name, '{dt.SECURITY}') then 'P0' when regexp_matches(path, '{dt.SECURITY_PATH}') then 'P0'
        when regexp_matches(name, '{dt.FUNCTIONAL}') then 'P1' when regexp_matches(name, '{dt.EXPERIMENTAL}') then 'P3' else 'P1' end as priority from funcs where {_STUB}"""),
    ("triage_report", lambda s, d: _stub_rows(s, d).groupBy("priority").agg(F.count("*").alias("stubs")), f"""{_W}, t as (select case when name like 'get_red%' then 'P0' when path like 'm7/%' then 'P3' when regexp_matches(name, '{dt.SECURITY}') then 'P0' when regexp_matches(path, '{dt.SECURITY_PATH}') then 'P0'
        when regexp_matches(name, '{dt.FUNCTIONAL}') then 'P1' when regexp_matches(name, '{dt.EXPERIMENTAL}') then 'P3' else 'P1' end as priority from funcs where {_STUB}) select priority, count(*) as stubs from t group by 1"""),
    ("structural_duplicates", lambda s, d: dt.structural_duplicates(functions(s, d)).select("copies", "files", "first"), f"""{_W}, f as (select case when name = 'run' then 'run' when name = '__init__' then 'init' || (p_partkey % 4 = 0) || b else k::varchar end as s, path from funcs where not {_STUB})
        select count(*) as copies, count(distinct path) as files, min(path) as first from f group by s having count(*) > 1"""),
    ("undefined_calls", lambda s, d: dt.undefined_calls(code.facts(modules(s, d), "calls"), functions(s, d), code.facts(modules(s, d), "classes"), ["super", "NotImplementedError", "getcwd"]).withColumn("signatures", F.array_join("signatures", ",")),
        f"{_W} select name, count(*) as uses, '1' as signatures from callrows where name like 'helper%' or name like 'unknown%' group by 1"),
    ("single_method_classes", lambda s, d: dt.single_method_classes(code.facts(modules(s, d), "classes"), functions(s, d)), f"{_W} select path, cls as name from good"),
    ("needless_super_init", lambda s, d: dt.needless_super_init(code.facts(modules(s, d), "classes")), f"{_W} select path, cls as name from good where p_partkey % 4 = 0"),
    ("import_clusters", lambda s, d: dt.import_clusters(_import_lines(s, d).select(F.col("file").alias("path"), F.col("module").cast("string").alias("module"), (F.col("line") > 300).alias("star")), 150),
        f"with {_LINES} select file as path, module::varchar as module, count(*) as imports, count(*) filter (line > 300) as stars from ils group by 1, 2 having count(*) >= 150"),
    ("repeated_import_patterns", lambda s, d: dt.repeated_import_patterns(table(s, d, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_partkey") % 3).cast("string").alias("module"))),
        """with c as (select l_orderkey as path, (l_partkey % 3)::varchar as module, count(*) as n from lineitem group by 1, 2 having count(*) >= 2), s as (select path, string_agg(module || ':' || n, ',' order by module) as signature, sum(n)::bigint as n from c group by 1)
        select signature, count(*) as files, sum(n)::bigint as imports from s group by 1 having count(*) >= 2"""),
    ("import_islands", lambda s, d: dt.line_islands(_import_lines(s, d), "file", "line", "module", 0, 3, 0.5), f"""with {_LINES}, g as (select *, line - lag(line) over w as step from ils window w as (partition by file order by line)),
        i as (select *, sum((step is null or step > 0)::int) over (partition by file order by line range unbounded preceding) as island from g)
        select file, island::bigint as island, count(*) as rows, count(distinct module) as modules, min(line) as first, max(line) as last from i group by 1, 2 having count(*) >= 3 and count(distinct module) / count(*) < 0.5"""),
    ("far_twins", lambda s, d: dt.far_twins(_import_lines(s, d).distinct(), "file", "module", "line", 20, 40).groupBy("file", "module").agg(F.count("*").alias("pairs"), F.sum("distance").alias("distance")),
        f"with {_LINES}, u as (select distinct * from ils) select x.file, x.module, count(*) as pairs, sum(y.line - x.line)::bigint as distance from u x join u y on x.file = y.file and x.module = y.module and y.line - x.line between 20 and 40 group by 1, 2"),
    ("containing_segments", lambda s, d: dt.containing_segment(_import_lines(s, d).withColumn("file", F.col("file") % 10), _segments(s, d), "file", "line").groupBy("file", "line", "segment").agg(F.count("*").alias("points")),
        f"""with {_LINES}, p as (select file % 10 as file, line, count(*) as n from ils group by 1, 2), s as (select o_custkey % 10 as file, o_orderkey % 380 as low, o_orderkey % 380 + o_custkey % 30 as high, o_orderkey as ordinal from orders)
        select p.file, p.line, min(ordinal) as segment, max(n) as points from p left join s on s.file = p.file and p.line between low and high group by 1, 2"""),
    ("canonical_split", lambda s, d: dt.canonical_split(table(s, d, "part"), "p_name", "p_size", "p_partkey").select("p_partkey", "p_name", "canonical", "shadow"),
        "with c as (select p_name, arg_max(p_partkey, (p_size, -p_partkey)) as canonical from part group by 1 having count(*) > 1) select p_partkey, p_name, canonical, p_partkey <> canonical as shadow from part join c using (p_name)"),
    ("module_similarity", lambda s, d: dt.module_similarity(functions(s, d).where("owner is null").withColumn("path", F.regexp_extract("path", "^[^/]*", 0)), code.facts(modules(s, d), "imports").withColumn("path", F.regexp_extract("path", "^[^/]*", 0)), 0.2),
        f"""{_W}, n as (select distinct regexp_extract(path, '^[^/]*') as path, name from funcs where owner is null), m as (select distinct regexp_extract(path, '^[^/]*') as path, unnest(['os', a || '_lib', b || '_pkg']) as module from good),
        c as (select path, count(*) as n from n group by 1), w as (select path, count(*) as m from m group by 1), p as (select x.path as a, y.path as b, count(*) as shared from n x join n y on x.name = y.name and x.path < y.path group by 1, 2),
        q as (select x.path as a, y.path as b, count(*) as common from m x join m y on x.module = y.module and x.path < y.path group by 1, 2),
        z as (select p.a, p.b, round(0.7::double * shared / greatest(ca.n, cb.n) + 0.3::double * common / (wa.m + wb.m - common), 6) as score from p join q on p.a = q.a and p.b = q.b join c ca on ca.path = p.a join c cb on cb.path = p.b join w wa on wa.path = p.a join w wb on wb.path = p.b)
        select * from z where score > 0.2"""),
    ("method_groups", lambda s, d: dt.method_groups(code.facts(modules(s, d), "classes")), f"{_W} select b as fields, count(*) as classes, '__init__,run' as methods from good group by 1 having count(*) >= 3"),
]

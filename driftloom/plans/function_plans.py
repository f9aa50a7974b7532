"""Queries over name, score and vector expressions, and their DuckDB twins: name, query, SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import names, scores
from driftloom.operators import hypervectors as hv
from driftloom.sources.tables import table

SIZE = 64
#: Tables of three bits with which the embeddings' nearest ten are found with a recall of 0.9.
_TABLES = 16
_VERBS = ("get", "fetch", "set", "make", "Check", "delete")


def parts(s: SparkSession, d: str) -> DataFrame:
    """Parts with a snake and a camel name, a path, a module and a message."""
    p = table(s, d, "part")
    verb = F.element_at(F.array(*[F.lit(v) for v in _VERBS]), (1 + F.col("p_size") % 6).cast("int"))
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    return p.select(
        "p_partkey", "p_size", "p_retailprice", F.concat_ws("_", verb, first, second).alias("snake"),
        F.concat(first, F.initcap(second), F.upper(F.substring(verb, 1, 1)), F.lit("Id"), F.col("p_size").cast("string")).alias("camel"),
        F.concat(F.lit("pkg/"), first, F.lit("/"), F.when(F.col("p_size") % 4 == 0, "__init__").otherwise(second), F.lit(".py")).alias("path"),
        F.concat(F.lit("pkg."), first, F.lit("."), second).alias("module"), F.concat(F.lit("api_key = '"), first, F.lit("' of "), second).alias("message"),
    )


PARTS = """parts as (select p_partkey, p_size, p_retailprice, v || '_' || a || '_' || b as snake, a || upper(b[1]) || lower(b[2:]) || upper(v[1]) || 'Id' || p_size as camel,
  'pkg/' || a || '/' || (case when p_size % 4 = 0 then '__init__' else b end) || '.py' as path, 'pkg.' || a || '.' || b as module, 'api_key = ''' || a || ''' of ' || b as message
  from (select *, ['get', 'fetch', 'set', 'make', 'Check', 'delete'][1 + p_size % 6] as v, string_split(p_name, ' ')[1] as a, string_split(p_name, ' ')[-1] as b from part))"""
_W = f"with {PARTS}"
_STOPS = ", ".join(f"'{w}'" for w in names.NAME_STOPS)


#: What stands before and behind a name ("!": no name at all), and the kind of leftover that it makes.
_JUNK = [
    ("", ".tmp", "temp"), ("", ".TEMP", "temp"), ("", "~", "temp"), ("", ".orig", "temp"), ("tmp_", ".swp", "temp"), ("temp_", "", "temp"), ("", ".py", None), ("src/tmp_", "", None),
    ("", ".bak", "backup"), ("", ".backup3", "backup"), ("", ".old", "backup"), ("", ".20240101", "backup"), ("", "_backup", "backup"), ("", "_old", "backup"), ("", "(copy).py", "backup"), ("", ".save", "backup"),
    ("dist", "!", "build"), ("build/", "!", "build"), ("", ".egg-info", "build"), ("", ".dll", "build"), ("", ".so", "build"), ("", ".dylib", "build"), ("a", ".exe", "build"), ("x/dist", "!", None),
    ("", ".swp", "editor"), ("", ".kate-swp", "editor"), (".#", "", "editor"), ("", ".sublime-workspace", "editor"), (".idea/workspace.xml", "!", "editor"), (".vscode/", ".json", "editor"),
    (".DS_Store", "!", "os"), ("Thumbs.DB", "!", "os"), ("$RECYCLE.BIN", "!", "os"), (".Spotlight-V100/", "!", "os"), ("", ".log", "debug"), ("core.12", "!", "debug"), ("error.txt", "!", "debug"), ("nohup.out", "!", "debug"),
    (".coverage.host", "!", "test"), ("coverage.xml", "!", "test"), ("junit.xml", "!", "test"), ("__pycache__", "!", "python"), ("", ".pyd", "python"), (".tox", "!", "python"), ("htmlcov/", "!", "python"), ("", ".cover", "python"),
    ("node_modules", "!", "package"), ("vendor/", "!", "package"), ("packages", "!", "package"),
]


def _rounded(value, places=6):
    """As SQL's round on doubles: the scaled value to the nearest whole number. Spark's own rounds the shortest decimal, whose ties differ."""
    return F.round(value * F.lit(10.0**places)) / F.lit(10.0**places)


def _joined(tokens, n="tokens"):
    return F.array_join(tokens, " ").alias(n)


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", "label", "embedding", hv.bipolar(F.slice("embedding", 1, SIZE)).alias("v"))


_V = f"v as (select vec_id, label, list_transform(embedding[1:{SIZE}], lambda x: case when x > 0 then 1 else -1 end) as v from embeddings), u as (select vec_id, label, unnest(v) as x, generate_subscripts(v, 1) - 1 as i from v)"


def _listed(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.array_join(F.transform("vector", lambda x: x.cast("string")), ",").alias("vector"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Each part with the next one of its size."""
    from pyspark.sql import Window

    after = Window.partitionBy("p_size").orderBy("p_partkey")
    p = parts(s, d)
    return p.select("*", *[F.lead(c).over(after).alias(f"next_{c}") for c in ("snake", "camel", "path", "module", "p_retailprice")]).where("next_snake is not null")


_N = _W + ", n as (select *, lead(snake) over w as next_snake, lead(camel) over w as next_camel, lead(path) over w as next_path, lead(module) over w as next_module, lead(p_retailprice) over w as next_p_retailprice from parts window w as (partition by p_size order by p_partkey)), nn as (select * from n where next_snake is not null)"
_LCP = "list_max(list_transform(range(0, least(len({a}), len({b}))::bigint + 1), lambda k: case when {x} = {y} then k else 0 end))"
_TOK = "list_distinct(list_filter(list_transform(case when len(regexp_extract_all({c}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')) > 0 then regexp_extract_all({c}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') else string_split({c}, '_') end, lambda x: lower(x)), lambda x: len(x) >= 2))"


def _sequence_tokens(s: SparkSession, d: str) -> DataFrame:
    return _listed(hv.sequence_vectors(table(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("t")), "p_partkey", F.col("t"), SIZE), "p_partkey")


def _cleanup(s: SparkSession, d: str) -> DataFrame:
    v = _vectors(s, d)
    return hv.nearest(v, "vec_id", "v", hv.bundle(v, "label", F.col("v")), "label")


PLANS = [
    ("identifier_tokens", lambda s, d: parts(s, d).select("p_partkey", _joined(names.identifier_tokens(F.col("snake"))), F.size(names.identifier_tokens(F.col("snake"), 4)).alias("long")),
        f"{_W} select p_partkey, lower(replace(snake, '_', ' ')) as tokens, len(list_filter(string_split(snake, '_'), lambda x: len(x) >= 4))::int as long from parts"),
    ("doc_tokens", lambda s, d: table(s, d, "documents").select("doc_id", _joined(names.doc_tokens(F.col("text")))),
        "select doc_id, array_to_string(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'), lambda w: len(w) >= 2)[1:50], ' ') as tokens from documents"),
    ("name_tokens", lambda s, d: parts(s, d).select("p_partkey", _joined(names.name_tokens(F.col("snake"))), _joined(names.name_tokens(F.col("camel")), "camel")),
        f"{_W} select p_partkey, array_to_string(list_filter(string_split(lower(snake), '_'), lambda t: t not in ({_STOPS})), ' ') as tokens, lower(trim(regexp_replace(camel, '([A-Z])', ' \\1', 'g'))) as camel from parts"),
    ("name_patterns", lambda s, d: parts(s, d).select(names.name_pattern(F.col("snake")).alias("snake"), names.name_pattern(F.col("camel")).alias("camel")).groupBy("snake", "camel").agg(F.count("*").alias("names")),
        f"{_W} select lower(string_split(snake, '_')[1]) || '_*' as snake, regexp_extract(camel, '^(.[^A-Z]*)', 1) || '_*' as camel, count(*) as names from parts group by 1, 2"),
    ("token_grams", lambda s, d: table(s, d, "part").select(F.explode(names.n_grams(F.split("p_name", " "), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("parts")),
        "select p_name as gram, count(*) as parts from part where len(string_split(p_name, ' ')) = 2 group by 1"),
    ("redacted_messages", lambda s, d: parts(s, d).groupBy(names.redacted(F.col("message")).alias("message")).agg(F.count("*").alias("rows")),
        f"{_W} select 'api_key=***REDACTED***'' of ' || regexp_extract(message, ' of (.*)$', 1) as message, count(*) as rows from parts group by 1"),
    ("junk_kinds", lambda s, d: parts(s, d).select(names.junk_kind(F.element_at(F.array(*[F.concat(F.lit(x), F.when(F.lit(y != "!"), F.col("snake")).otherwise(""), F.lit(y.strip("!"))) for x, y, _ in _JUNK]), (1 + F.col("p_partkey") % len(_JUNK)).cast("int"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("files")),
        f"select [{', '.join('null' if k is None else repr(k) for _, _, k in _JUNK)}][1 + p_partkey % {len(_JUNK)}] as kind, count(*) as files from part group by 1"),
    ("size_texts", lambda s, d: table(s, d, "orders").select("o_orderkey", names.size_text(F.col("o_orderkey").cast("double") * F.col("o_orderkey") * 1000).alias("size")),
        "select o_orderkey, case when b < 1024 then format('{:.1f} B', b) when b < 1024.0::double ** 2 then format('{:.1f} KB', b / 1024) when b < 1024.0::double ** 3 then format('{:.1f} MB', b / 1024.0::double ** 2) when b < 1024.0::double ** 4 then format('{:.1f} GB', b / 1024.0::double ** 3) else format('{:.1f} TB', b / 1024.0::double ** 4) end as size from (select o_orderkey, o_orderkey::double * o_orderkey * 1000 as b from orders)"),
    ("prefix_families", lambda s, d: parts(s, d).select(names.prefix_family(F.col("snake"), {"reader": ("get_", "fetch_"), "check": ("check_",)}, F.col("path")).alias("family")).groupBy("family").agg(F.count("*").alias("names")),
        f"{_W} select case when lower(snake) like 'get\\_%' escape '\\' then 'reader_get_' when lower(snake) like 'fetch\\_%' escape '\\' then 'reader_fetch_' when lower(snake) like 'check\\_%' escape '\\' then 'check_check_' when lower(path) like '%test%' then 'test_code' when lower(path) like '%util%' then 'utilities_general' else 'uncategorized' end as family, count(*) as names from parts group by 1"),
    ("module_names", lambda s, d: parts(s, d).select("p_partkey", names.module_of(F.col("path")).alias("module"), names.module_name(F.concat(F.lit(" ..A-"), F.col("camel"))).alias("clean"), names.relative_import(F.col("module"), F.col("camel"), (F.col("p_size") % 5).cast("int")).alias("relative")),
        f"{_W} select p_partkey, replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '/__init__$', ''), '/', '.') as module, 'a_' || lower(camel) as clean, case p_size % 5 when 0 then module || '.' || camel when 1 then regexp_replace(module, '\\.[^.]*$', '') || '.' || camel when 2 then 'pkg.' || camel when 3 then camel end as relative from parts"),
    ("abstractness", lambda s, d: parts(s, d).select(names.abstractness(F.concat("camel", F.when(F.col("p_size") % 3 == 0, "Base").when(F.col("p_size") % 3 == 1, "HandlerImpl").otherwise(""))).alias("abstract")).groupBy("abstract").agg(F.count("*").alias("names")),
        "select [0.8, 0.2, 0.5][1 + p_size % 3]::double as abstract, count(*) as names from part group by 1"),
    ("shown_paths", lambda s, d: parts(s, d).select("p_partkey", names.shown_path(F.concat(F.element_at(F.array(F.lit("/root/x/"), F.lit("/other/deep/"), F.lit(""), F.lit("./")), (1 + F.col("p_partkey") % 4).cast("int")), F.col("path")), "/root/x").alias("shown")),
        f"{_W} select p_partkey, ['./', '~/', './', './'][1 + p_partkey % 4] || path as shown from parts"),
    ("name_similarities", lambda s, d: _pairs(s, d).select("p_partkey", F.round(names.verb_similarity(F.col("snake"), F.col("next_snake")), 6).alias("verbs"), F.round(names.token_similarity(F.col("snake"), F.col("next_snake")), 6).alias("tokens"),
        F.round(names.positional_similarity(F.col("camel"), F.col("next_camel")), 6).alias("places"), names.common_prefix(F.col("snake"), F.col("next_snake")).alias("prefix")),
        f"""{_N} select p_partkey, round(case when snake = next_snake then 1.0::double when {' or '.join(f"(regexp_matches(snake, '{'|'.join(g)}') and regexp_matches(next_snake, '{'|'.join(g)}'))" for g in names.VERB_GROUPS)} then 0.8::double else 1 - levenshtein(snake, next_snake)::double / greatest(len(snake), len(next_snake)) end, 6) as verbs,
        round(case when snake = next_snake then 1.0::double else len(list_intersect({_TOK.format(c='snake')}, {_TOK.format(c='next_snake')}))::double / len(list_distinct(list_concat({_TOK.format(c='snake')}, {_TOK.format(c='next_snake')}))) end, 6) as tokens,
        round(len(list_filter(range(1, least(len(camel), len(next_camel))::bigint + 1), lambda k: camel[k] = next_camel[k]))::double / greatest(len(camel), len(next_camel)), 6) as places,
        snake[1:{_LCP.format(a='snake', b='next_snake', x='snake[1:k]', y='next_snake[1:k]')}] as prefix from nn"""),
    ("package_distances", lambda s, d: _pairs(s, d).select("p_partkey", names.package_distance(F.col("module"), F.col("next_module")).alias("distance"), names.pair_key(F.col("module"), F.col("next_module")).alias("pair")),
        f"""{_N}, m as (select *, string_split(module, '.') as a, string_split(next_module, '.') as b from nn)
        select p_partkey, (len(a) + len(b) - 2 * {_LCP.format(a='a', b='b', x='a[1:k]', y='b[1:k]')})::int as distance, sha256(least(module, next_module) || '||' || greatest(module, next_module)) as pair from m"""),
    ("normalized_code", lambda s, d: table(s, d, "documents").select("doc_id", F.md5(names.normalized_code(F.concat("text", F.lit(" # note\n  x = 1")))).alias("code")),
        "select doc_id, md5(trim(regexp_replace(regexp_replace(text || ' # note\n  x = 1', '#[^\n]*', '', 'g'), '\\s+', ' ', 'g'))) as code from documents where text is not null union all select doc_id, null from documents where text is null"),
    ("polymer_scores", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", _rounded(scores.polymer_distance({"token": F.col("l_extendedprice") / 100, "ast": F.col("l_quantity"), "module": F.col("l_linenumber").cast("double"), "git": F.col("l_discount")})).alias("distance"),
        _rounded(scores.contact(F.col("l_quantity"), scores.tad_penalty(F.nullif("l_returnflag", F.lit("N")), F.when(F.col("l_linestatus") == "F", "R").otherwise("A"), F.col("l_discount"), F.col("l_tax")))).alias("contact")),
        """select l_orderkey, l_linenumber, round(0.3::double * least(1.0::double, l_extendedprice / 100 / 1000) + 0.25::double * least(1.0::double, l_quantity / 100) + 0.25::double * least(1.0::double, l_linenumber / 10.0::double) + 0.2::double * least(1.0::double, l_discount), 6) as distance,
        round(least(1.0::double, pow(l_quantity + 1e-6::double, -1.2::double)) * case when l_returnflag = 'N' then 0.7::double when l_returnflag = (case when l_linestatus = 'F' then 'R' else 'A' end) then 1.0::double else greatest(0.1::double, 0.7::double * (1 - 0.3::double * greatest(l_discount, l_tax))) end, 6) as contact from lineitem"""),
    ("spatial_distances", lambda s, d: _pairs(s, d).select("p_partkey", scores.spatial_distance(F.col("path"), F.col("next_path"), F.when(F.col("p_size") % 2 == 0, "import").otherwise("other")).alias("distance")),
        f"""{_N} select p_partkey, ((path <> next_path)::int * 1.0::double + (regexp_extract(path, '([^/]*)\\.py$', 1) <> regexp_extract(next_path, '([^/]*)\\.py$', 1))::int * 2 + (string_split(path, '/')[2] <> string_split(next_path, '/')[2])::int * 4) * case when p_size % 2 = 0 then 0.6::double else 1 end as distance from nn"""),
    ("pair_scores", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", scores.is_contact_violation(F.col("l_quantity"), F.col("l_linenumber").cast("double")).alias("violation"), F.round(scores.match_confidence(1 - F.col("l_discount"), 1 - F.col("l_tax"), F.col("l_returnflag") == "R"), 6).alias("confidence"),
        F.round(scores.z_score(F.col("l_quantity"), F.lit(25.0), F.col("l_tax")), 6).alias("z"), scores.significant(F.col("l_tax"), F.when(F.col("l_linenumber") > 3, F.col("l_discount"))).alias("significant"), F.round(scores.thrash_severity(1 - F.col("l_discount"), F.col("l_quantity"), F.when(F.col("l_returnflag") == "A", "setup").otherwise("x")), 6).alias("severity")),
        """select l_orderkey, l_linenumber, abs(ln(l_quantity / l_linenumber)) > 2 as violation, round(case when l_returnflag = 'R' then 1.0::double when 1 - l_discount > 0.95 and 1 - l_tax > 0.9 then least(1.0::double, 1.1::double * (0.6::double * (1 - l_discount) + 0.4::double * (1 - l_tax))) else 0.6::double * (1 - l_discount) + 0.4::double * (1 - l_tax) end, 6) as confidence,
        round(case when l_tax = 0 then 0.0::double else (l_quantity - 25) / l_tax end, 6) as z, coalesce(case when l_linenumber > 3 then l_discount end, l_tax) < 0.05::double as significant,
        round(least(5.0::double, 2 + 2 * (1 - l_discount - 0.7::double) + least(l_quantity / 100, 1.0::double) + case when l_returnflag = 'A' then 0.5::double else 0 end), 6) as severity from lineitem"""),
    ("fix_predictions", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", scores.thrash_prediction(F.col("l_extendedprice") / 12345.678, 10 * F.col("l_discount"), 1 - 5 * F.col("l_tax")).alias("p"), scores.replication_timing(F.col("l_quantity") / 50, 10 * F.col("l_discount"), F.col("l_tax") * 10).alias("t"), scores.risk_grade(F.col("l_discount") * 10).alias("grade")).select("l_orderkey", "l_linenumber", "p.*", "t.*", "grade"),
        """with x as (select *, l_extendedprice / 12345.678::double as i, 10 * l_discount as c, 1 - 5 * l_tax as k from lineitem), y as (select *, i * (1 - 0.5::double * c) * k as r, c * (1 - k) as risk_, (i * (1 - 0.5::double * c) * k) / (c + 0.1::double) * k as roi_ from x)
        select l_orderkey, l_linenumber, round(r, 4) as reduction, round(risk_, 4) as risk, round(roi_, 4) as roi, case when roi_ > 2 and risk_ < 0.3::double then 'High' when roi_ > 1 or risk_ < 0.5::double then 'Medium' else 'Low' end as priority,
        round(0.4::double * (l_quantity / 50) + 0.3::double * c + 0.3::double * (l_tax * 10), 6) as score, (l_quantity / 50 > 0.6::double and c > 0.5::double and l_tax * 10 > 0.4::double) as early,
        case when l_discount * 10 < 0.3::double then 'LOW' when l_discount * 10 < 0.6::double then 'MEDIUM' when l_discount * 10 < 0.8::double then 'HIGH' else 'CRITICAL' end as grade from y"""),
    ("structure_scores", lambda s, d: _pairs(s, d).select("p_partkey", F.round(scores.structure_similarity(F.col("module"), F.col("next_module"), [(F.col("p_retailprice"), F.col("next_p_retailprice")), (F.length("snake"), F.length("next_snake"))]), 6).alias("similarity"),
        F.round(scores.fragmentation_risk(F.col("p_size"), F.lit(0.25), F.lit(0.5)), 6).alias("risk"), F.round(scores.import_anxiety(F.col("p_size"), F.lit(2), F.lit(1), F.lit(3)), 6).alias("anxiety"), scores.log_bucket(F.col("p_size")).alias("bucket"), F.round(scores.chain_confidence(F.col("p_size"), F.lit(3), F.col("p_size") % 2 == 0), 6).alias("chain")),
        f"""{_N} select p_partkey, round(case when module = next_module then 1.0::double else ((1 - abs(p_retailprice - next_p_retailprice) / greatest(p_retailprice, next_p_retailprice)) + (1 - abs(len(snake) - len(next_snake))::double / greatest(len(snake), len(next_snake)))) / 2 end, 6) as similarity,
        round(0.3::double * least(p_size / 10.0::double, 1.0::double) + 0.2::double * 0.75::double + 0.25::double, 6) as risk, round(0.5::double * p_size + 6.4::double, 6) as anxiety, case when p_size <= 0 then '0' when p_size <= 2 then p_size::varchar else '2^~' || floor(log2(p_size))::int end as bucket,
        round(least(0.95::double, 0.7::double + case when p_size >= 5 then 0.1::double else 0 end + case when p_size >= 10 then 0.1::double else 0 end + case when p_size % 2 = 0 then 0.1::double else 0 end), 6) as chain from nn"""),
    ("bound_vectors", lambda s, d: _vectors(s, d).select("vec_id", F.array_join(hv.bind(F.col("v"), hv.permute(F.col("v"), 3)), ",").alias("bound"), F.round(hv.agreement(hv.bind(hv.bind(F.col("v"), hv.permute(F.col("v"))), hv.permute(F.col("v"))), F.col("v")), 6).alias("unbound")),
        f"with {_V}, p as (select vec_id, v, list_concat(v[{SIZE - 2}:], v[1:{SIZE - 3}]) as w from v) select vec_id, array_to_string(list_transform(range(1, {SIZE + 1}), lambda k: v[k] * w[k]), ',') as bound, 1.0::double as unbound from p"),
    ("label_bundles", lambda s, d: _listed(hv.bundle(_vectors(s, d), "label", F.col("v")), "label"), f"with {_V}, t as (select label, i, sign(sum(x))::int as x from u group by 1, 2) select label, string_agg(x::varchar, ',' order by i) as vector from t group by 1"),
    ("weighted_bundles", lambda s, d: _listed(hv.weighted_bundle(_vectors(s, d), "label", F.col("v"), (F.col("vec_id") % 5) / 8), "label"), f"with {_V}, t as (select label, i, sign(sum(x * greatest(1, floor(10 * (vec_id % 5) / 8.0::double))))::int as x from u group by 1, 2) select label, string_agg(x::varchar, ',' order by i) as vector from t group by 1"),
    ("ternary_bundles", lambda s, d: _listed(hv.ternary_bundle(_vectors(s, d).where("vec_id % 2 = 0 or label is not null"), "label", F.col("v")), "label"), f"with {_V}, t as (select label, i, case when avg(x) > 0.33::double then 1 when avg(x) < -0.33::double then -1 else 0 end as x from u group by 1, 2) select label, string_agg(x::varchar, ',' order by i) as vector from t group by 1"),
    ("sequence_vectors", _sequence_tokens, f"""with t as (select p_partkey, unnest(string_split(p_name, ' ')) as w, generate_subscripts(string_split(p_name, ' '), 1) - 1 as pos from part), i as (select range as i from range({SIZE})),
        b as (select p_partkey, i, case when substr(md5(w || ':' || ((i - pos + {SIZE}) % {SIZE})), 1, 1) >= '8' then 1 else -1 end as x from t, i), z as (select p_partkey, i, sign(sum(x))::int as x from b group by 1, 2) select p_partkey, string_agg(x::varchar, ',' order by i) as vector from z group by 1"""),
    ("vector_cleanup", _cleanup, f"""with {_V}, t as (select label, i, sign(sum(x))::int as y from u group by 1, 2), m as (select vec_id, t.label as c, round(count(*) filter (x = y)::double / {SIZE}, 6) as a from u join t using (i) group by 1, 2)
        select vec_id, arg_max(c, (a, -c)) as candidate, max(a) as agreement from m group by 1"""),
    ("plane_buckets", lambda s, d: hv.hashed(_vectors(s, d), "vec_id", "v", 4, 6, SIZE), f"""with {_V}, p as (select t.range as slot, b.range as b, i.range as i, ('0x' || substr(md5(t.range || ':' || b.range || ':' || i.range), 1, 4))::int % 3 - 1 as w from range(4) t, range(6) b, range({SIZE}) i),
        q as (select vec_id, slot, b, (sum(x * w) > 0)::int as bit from u join p using (i) group by 1, 2, 3) select vec_id, slot, sum(bit << (5 - b))::int as bucket from q group by 1, 2"""),
    ("bucket_neighbours", lambda s, d: hv.bucket_search(table(s, d, "embeddings").where("vec_id % 50 = 0"), table(s, d, "embeddings"), "vec_id", "embedding", _TABLES, 3, 10, SIZE), f"""with e as (select vec_id, embedding::double[] as e from embeddings),
        u as (select vec_id, unnest(e) as x, generate_subscripts(e, 1) - 1 as i from e), p as (select t.range as slot, b.range as b, i.range as i, ('0x' || substr(md5(t.range || ':' || b.range || ':' || i.range), 1, 4))::int % 3 - 1 as w from range({_TABLES}) t, range(3) b, range({SIZE}) i),
        q as (select vec_id, slot, b, (round(sum(x * w), 6) > 0)::int as bit from u join p using (i) group by 1, 2, 3), h as (select vec_id, slot, sum(bit << (2 - b))::int as bucket from q group by 1, 2),
        m as (select distinct x.vec_id as query, y.vec_id from h x join h y using (slot, bucket) where x.vec_id % 50 = 0 and x.vec_id <> y.vec_id),
        c as (select query, m.vec_id, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 6) as similarity from m join e a on a.vec_id = query join e b on b.vec_id = m.vec_id)
        select *, row_number() over (partition by query order by similarity desc, vec_id) as nth from c qualify nth <= 10"""),
]

"""Rules over parsed facts of source texts (see ``sources.code``) and joins between them.

Facts come as functions, classes, imports and calls with a path. All rules are built-in expressions; groups go through partial
aggregates. Empty tables give empty results; repeated rows count as often as they come.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Forms that decide the results.
LOGIC_NAMES = r"^(calculate|compute|process|validate|analyze|transform|convert|parse|generate|build|verify|check)"
SECURITY = r"verify|authenticate|validate.*signature|digest|hsm|hardware.*security|key.*management|secure.*element|encrypt|decrypt|sign|hash|random|entropy|stark|proof|commitment|merkle|polynomial|field.*arithmetic|dilithium|kyber|falcon|sphincs|lattice"
SECURITY_PATH = r"crypto|security|auth|hsm|quantum|proof"
FUNCTIONAL = r"get.*config|load.*settings|read.*properties|generate.*id|create.*uuid|get.*identifier|get.*data|fetch|retrieve|load"
EXPERIMENTAL = r"generate.*verilog|generate.*fpga|compile.*to|transpile|benchmark|profile|debug|visualize|experimental|prototype|research|poc"
STUBS = ("pass", "not_implemented", "trivial_return", "todo", "ellipsis")


def full_name() -> Column:
    return F.concat_ws(".", "owner", "name")


def placeholders(functions: DataFrame, allow: Sequence[str] = ()) -> DataFrame:
    """Functions whose body is a stub, but allowed names: severity 2, trivial returns 1."""
    found = functions.where(F.col("body").isin(*STUBS) & ~full_name().isin(*(allow or [""])))
    return found.withColumn("severity", F.when(F.col("body") == "trivial_return", 1).otherwise(2))


def graded_placeholders(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Stubs with a grade, one higher where something calls them: todo, pass, trivial return and ellipsis 2, not implemented 1, and 3 for a
    name that promises logic on a body without a branch."""
    kind = (
        F.when(F.col("body").isin("todo", "pass", "trivial_return", "not_implemented"), F.col("body"))
        .when(F.lower("name").rlike(LOGIC_NAMES) & (F.col("complexity") <= 1), "low_complexity_logic")
        .when(F.col("body") == "ellipsis", "ellipsis")
    )
    grade = F.when(F.col("kind") == "not_implemented", 1).when(F.col("kind") == "low_complexity_logic", 3).otherwise(2)
    used = calls.select("name").distinct().withColumn("called", F.lit(1))
    rows = functions.withColumn("kind", kind).where("kind is not null").join(used, "name", "left")
    return rows.select("path", "name", "line", "kind", (grade + F.coalesce("called", F.lit(0))).alias("grade"))


def stub_counts(functions: DataFrame, many: int = 10) -> DataFrame:
    """Stubs of each kind, and a row ``all`` if there are more than ``many``."""
    by_kind = functions.where(F.col("body").isin(*STUBS)).groupBy(F.col("body").alias("kind")).agg(F.count("*").alias("stubs"))
    whole = by_kind.agg(F.sum("stubs").alias("stubs")).where(F.col("stubs") > many)
    return by_kind.unionByName(whole.select(F.lit("all").alias("kind"), "stubs"))


def most_stubbed(functions: DataFrame, limit: int = 5) -> DataFrame:
    """The files with most stubs; the limit is the feature."""
    counted = functions.where(F.col("body").isin(*STUBS)).groupBy("path").agg(F.count("*").alias("stubs"))
    return counted.orderBy(F.col("stubs").desc(), "path").limit(limit)


def real_placeholders(functions: DataFrame) -> DataFrame:
    """Stubs that are neither abstract nor mocks (by decorator, name or path)."""
    abstract = F.exists("decorators", lambda d: d.rlike(r"(^|\.)(abstractmethod|overload)$"))
    mock = F.lower(F.coalesce("owner", F.lit(""))).rlike("mock|fake|stub|dummy") | F.lower("name").rlike("^(mock|fake)_")
    return functions.where(F.col("body").isin(*STUBS) & ~abstract & ~mock)


def triage(stubs: DataFrame, block: str | None = None, allow: str | None = None) -> DataFrame:
    """Priority of each stub by ordered rules: blocked P0, allowed P3, security names or paths P0, functional P1, experimental P3, else P1."""
    key, said = F.concat(F.col("path"), F.lit("::"), full_name()), F.lower("name")
    rules = [(key.rlike(block), "P0")] if block else []
    rules += [(key.rlike(allow), "P3")] if allow else []
    rules += [(said.rlike(SECURITY), "P0"), (F.lower("path").rlike(SECURITY_PATH), "P0"), (said.rlike(FUNCTIONAL), "P1"), (said.rlike(EXPERIMENTAL), "P3")]
    out = F.lit("P1")
    for rule, priority in reversed(rules):
        out = F.when(rule, priority).otherwise(out)
    return stubs.withColumn("priority", out)


def structural_duplicates(functions: DataFrame) -> DataFrame:
    """Functions of equal structure in more than one place, stubs apart: structure, copies, files, first path."""
    grouped = functions.where(~F.col("body").isin(*STUBS)).groupBy("structure").agg(
        F.count("*").alias("copies"), F.countDistinct("path").alias("files"), F.min("path").alias("first")
    )
    return grouped.where("copies > 1")


def undefined_calls(calls: DataFrame, functions: DataFrame, classes: DataFrame, builtins: Sequence[str]) -> DataFrame:
    """Called names that nothing defines: name, uses, the numbers of arguments they get."""
    known = functions.select("name").union(classes.select("name")).distinct()
    free = calls.where(~F.col("name").isin(*builtins)).join(known, "name", "left_anti")
    return free.groupBy("name").agg(F.count("*").alias("uses"), F.sort_array(F.collect_set("args")).alias("signatures"))


def single_method_classes(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """Classes of one public method that does not use self."""
    public = functions.where(F.col("owner").isNotNull() & ~F.col("name").startswith("_"))
    grouped = public.groupBy("path", F.col("owner").alias("name")).agg(F.count("*").alias("methods"), F.max(F.col("uses_self").cast("int")).alias("uses"))
    return classes.select("path", "name").join(grouped.where("methods = 1 and uses = 0"), ["path", "name"], "left_semi")


def needless_super_init(classes: DataFrame, depth: int = 10) -> DataFrame:
    """Classes whose ``__init__`` calls super where no class above them (by name, ``depth`` levels) has one."""
    up = classes.select("name", F.explode("bases").alias("base")).distinct()
    own = classes.where("has_init").select(F.col("name").alias("base")).distinct().withColumn("real", F.lit(1))
    reach = front = up
    for _ in range(depth - 1):
        front = front.join(up.select(F.col("name").alias("base"), F.col("base").alias("above")), "base").select("name", F.col("above").alias("base"))
        reach = reach.unionByName(front)
    real = reach.distinct().join(own, "base").select("name").distinct()
    return classes.where("super_init").join(real, "name", "left_anti").select("path", "name")


def import_clusters(imports: DataFrame, least: int = 3) -> DataFrame:
    """Modules that a file imports at least so often: path, module, imports, stars."""
    grouped = imports.where(F.col("module").isNotNull()).groupBy("path", "module").agg(F.count("*").alias("imports"), F.count_if("star").alias("stars"))
    return grouped.where(F.col("imports") >= least)


def repeated_import_patterns(imports: DataFrame, least: int = 2, files: int = 2) -> DataFrame:
    """Sets of modules that several files import in the same numbers: signature, files, imports."""
    per_file = imports.groupBy("path", "module").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    signed = per_file.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "module", F.col("n").cast("string")))), ",").alias("signature"), F.sum("n").alias("n"))
    return signed.groupBy("signature").agg(F.count("*").alias("files"), F.sum("n").alias("imports")).where(F.col("files") >= files)


def line_islands(rows: DataFrame, group: str, line: str, module: str, gap: int = 3, least: int = 5, most: float = 0.3) -> DataFrame:
    """Blocks of lines of one group no more than ``gap`` apart, with at least ``least`` rows and a share of different modules below ``most``."""
    order = Window.partitionBy(group).orderBy(line)
    step = F.col(line) - F.lag(line).over(order)
    marked = rows.withColumn("new", F.when(step.isNull() | (step > gap), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = numbered.groupBy(group, "island").agg(F.count("*").alias("rows"), F.countDistinct(module).alias("modules"), F.min(line).alias("first"), F.max(line).alias("last"))
    return blocks.where((F.col("rows") >= least) & (F.col("modules") / F.col("rows") < most))


def far_twins(rows: DataFrame, group: str, name: str, line: str, least: int, most: int | None = None) -> DataFrame:
    """Rows of one group and name that lie ``least`` to ``most`` lines apart: group, name, a, b, distance.

    Lines are dealt into buckets of ``most``, so a row meets its own bucket and the next one only; without ``most``, all later ones.
    """
    left, right = rows.select(group, name, F.col(line).alias("a")), rows.select(group, name, F.col(line).alias("b"))
    gap = F.col("b") - F.col("a")
    if most is None:
        return left.join(right, [group, name]).where(gap >= max(least, 1)).select(group, name, "a", "b", gap.alias("distance"))
    left = left.withColumn("bucket", F.explode(F.array(F.floor(F.col("a") / most), F.floor(F.col("a") / most) + 1)))
    right = right.withColumn("bucket", F.floor(F.col("b") / most))
    return left.join(right, [group, name, "bucket"]).where(gap.between(max(least, 1), most)).select(group, name, "a", "b", gap.alias("distance"))


def containing_segment(points: DataFrame, segments: DataFrame, group: str, point: str, width: int = 64) -> DataFrame:
    """Each point with the first segment (low, high, ordinal) of its group that holds it, null if none.

    Segments are listed in every bucket of ``width`` that they touch, so a point meets the segments of its own bucket.
    """
    places = segments.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    asked = points.withColumn("bucket", F.floor(F.col(point) / width))
    held = asked.select(group, point, "bucket").distinct().join(places, [group, "bucket"]).where((F.col(point) >= F.col("low")) & (F.col(point) <= F.col("high")))
    first = held.groupBy(group, point).agg(F.min("ordinal").alias("segment"))
    return points.join(first, [group, point], "left")


def canonical_split(symbols: DataFrame, name: str, priority: str, tie: str) -> DataFrame:
    """Definitions of each name: the one of highest priority is canonical, the others are its shadows. Names defined once drop out."""
    counted = symbols.groupBy(name).agg(F.count("*").alias("n"), F.max_by(tie, F.struct(F.col(priority), -F.col(tie))).alias("canonical")).where("n > 1")
    return symbols.join(counted, name).withColumn("shadow", F.col(tie) != F.col("canonical")).drop("n")


def module_similarity(functions: DataFrame, imports: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of files by 0.7 x shared function names / larger number + 0.3 x Jaccard of imported modules, above ``least``.

    Only files that share a name can pass 0.3, so candidates come from a join on names.
    """
    names = functions.select("path", "name").distinct()
    size = names.groupBy("path").agg(F.count("*").alias("n"))
    pairs = names.toDF("a", "name").join(names.toDF("b", "name"), "name").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    modules = imports.where("module is not null").select("path", "module").distinct()
    width = modules.groupBy("path").agg(F.count("*").alias("m"))
    both = pairs.join(modules.toDF("a", "module"), "a").join(modules.toDF("b", "module"), ["b", "module"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    joined = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").join(width.toDF("a", "ma"), "a", "left").join(width.toDF("b", "mb"), "b", "left").join(both, ["a", "b"], "left")
    common, union = F.coalesce("common", F.lit(0)), F.coalesce("ma", F.lit(0)) + F.coalesce("mb", F.lit(0)) - F.coalesce("common", F.lit(0))
    score = 0.7 * F.col("shared") / F.greatest("na", "nb") + 0.3 * F.when(union == 0, 0.0).otherwise(common / union)
    return joined.withColumn("score", F.round(score, 6)).where(F.col("score") > least).select("a", "b", "score")


def method_groups(classes: DataFrame, least: int = 3) -> DataFrame:
    """Sets of fields that at least so many classes share exactly, with the methods that all of them have."""
    key = F.array_join(F.sort_array("fields"), "|")
    groups = classes.where(F.size("fields") > 0).groupBy(key.alias("fields")).agg(F.count("*").alias("classes")).where(F.col("classes") >= least)
    held = classes.select(key.alias("fields"), F.explode(F.array_distinct("methods")).alias("method")).groupBy("fields", "method").agg(F.count("*").alias("n"))
    common = groups.join(held, "fields").where("n = classes").groupBy("fields").agg(F.array_join(F.sort_array(F.collect_list("method")), ",").alias("methods"))
    return groups.join(common, "fields", "left")

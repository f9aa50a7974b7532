"""Transitive closure, and duplicates that inheritance explains.

``closure`` is semi-naive: a round joins only the pairs that are new with all that are known, in both directions, so paths double in
length each round, cycles end when nothing is new, and depth has no cap. Each round is cut into the shared checkpoint folder.
Ends that are null drop out; repeated edges count once; an empty table gives an empty closure.

``true_duplicates`` groups functions by structure and drops the groups that scope explains: interface names in classes of their own,
delegation, accessors and serialisation across classes, and classes of which one is an ancestor of another, at any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.sources.shared import cut

# Names that decide the results.
INTERFACE = (
    "get", "set", "update", "delete", "create", "read", "write", "connect", "disconnect", "start", "stop", "run", "execute", "process", "handle",
    "validate", "serialize", "deserialize", "encode", "decode", "parse", "format", "render", "compile", "save", "load", "open", "close", "init",
    "cleanup", "reset", "to_dict", "from_dict", "to_json", "from_json", "dict_for_update", "transform", "convert", "export", "import", "fetch",
    "push", "pull", "sync", "refresh", "reload", "clear", "flush",
)
DELEGATES = ("dict_for_update", "to_dict", "from_dict", "serialize", "deserialize", "validate", "clean", "save", "load", "export", "import", "convert", "transform", "process", "handle", "dispatch")
ACCESSORS = ("get_", "set_", "is_", "has_", "can_")
SERIAL = ("to_json", "from_json", "to_dict", "from_dict", "to_xml", "from_xml", "to_yaml", "from_yaml", "to_string", "from_string", "serialize", "deserialize", "dump", "dumps", "load", "loads", "dict_for_update", "as_dict")
UTILITIES = ("dict_for_update", "to_dict", "from_dict", "as_dict")
FIXTURES = ("setUp", "tearDown", "setUpClass", "tearDownClass")


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All (src, dst) with a path of one edge or more."""
    known = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct())
    fresh = known
    while True:
        ahead = fresh.join(known.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        back = known.join(fresh.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        fresh = cut(ahead.unionByName(back).distinct().join(known, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = cut(known.unionByName(fresh))


def ancestors(classes: DataFrame) -> DataFrame:
    """Classes and all that they inherit from, by simple name: src (class), dst (ancestor). ``classes``: name, bases."""
    return closure(classes.select(F.col("name").alias("src"), F.explode("bases").alias("base")).select("src", F.substring_index("base", ".", -1).alias("dst")).where("src <> dst"))


def checked(functions: DataFrame) -> DataFrame:
    """The functions that may be duplicates at all: no special, abstract, property, mock or fixture methods, no utilities of classes."""
    decorated = lambda name: F.exists("decorators", lambda d: F.substring_index(d, ".", -1).isin(*name))
    skip = (
        F.col("name").rlike("^__.*__$")
        | decorated(("abstractmethod", "property", "cached_property", "setter", "getter", "deleter"))
        | F.col("name").isin(*FIXTURES)
        | F.lower("name").contains("mock")
        | (F.col("name").isin(*UTILITIES) & F.col("owner").isNotNull())
    )
    return functions.where(~skip)


def true_duplicates(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Groups of equal structure that scope does not explain: structure, copies, first (path), owners (number of classes).

    ``functions``: path, name, owner, decorators, structure; ``classes``: name, bases.
    """
    kept = checked(functions)
    every = lambda rule: F.min(F.coalesce(rule, F.lit(False)).cast("int")) == 1
    owned = F.col("owner").isNotNull()
    name = F.col("name")
    facts = kept.groupBy("structure").agg(
        F.count("*").alias("copies"),
        F.min("path").alias("first"),
        F.count_distinct("owner").alias("owners"),
        (every(owned) & every(name.isin(*INTERFACE) | name.rlike("^(to|from)_"))).alias("interface"),
        _any([every(F.lower(name).contains(d)) for d in DELEGATES]).alias("delegates"),
        every(name.isin(*DELEGATES)).alias("delegate_names"),
        _any([every(name.startswith(a)) for a in ACCESSORS]).alias("accessors"),
        every(name.isin(*SERIAL)).alias("serial"),
    )
    across = F.col("owners") > 1
    explained = (F.col("interface") & (F.col("owners") == F.col("copies"))) | F.col("delegate_names") | ((F.col("delegates") | F.col("accessors") | F.col("serial")) & across)
    members = kept.where(owned).select("structure", "owner").distinct()
    # a class meets its ancestors, and those the classes of the same group: never one another's pairs
    above = members.join(ancestors(classes).select(F.col("src").alias("owner"), F.col("dst").alias("above")), "owner").select("structure", F.col("above").alias("owner"))
    related = above.join(members, ["structure", "owner"], "left_semi").select("structure").distinct()
    return facts.where((F.col("copies") > 1) & ~explained).join(related, "structure", "left_anti").select("structure", "copies", "first", "owners")


def _any(rules: list[Column]) -> Column:
    found = rules[0]
    for rule in rules[1:]:
        found = found | rule
    return found

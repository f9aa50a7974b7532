"""Directed graphs: strong components, cycles, levels, distances, reach, and what stands in a cycle's way.

Edges have src and dst; repeated edges count once unless a weight is summed. Iterations cut their lineage into the shared
checkpoint folder after each step, so a lost executor repeats one step. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut as cut
from .ranks import numbered


def import_weights(imports: DataFrame) -> DataFrame:
    """Summed weight of each import edge. Rows have src, dst, top (at module level), star, names (number, or null for a plain import).

    Targets count by their first dotted part; a row weighs 1, doubled at module level, threefold for a star, and 1 + 0.2 n for n names.
    """
    names = F.when(F.col("star"), 3.0).when(F.col("names").isNotNull(), 1 + 0.2 * F.col("names")).otherwise(1.0)
    weight = F.when(F.col("top"), 2.0).otherwise(1.0) * names
    return imports.groupBy("src", F.substring_index("dst", ".", 1).alias("dst")).agg(F.round(F.sum(weight), 6).alias("weight"))


def _spread(start: DataFrame, step: DataFrame, best) -> DataFrame:
    """Passes values (node, value) along steps (a, b) until none gets better; ``best`` is F.min or F.max."""
    now = cut(start)
    while True:
        heard = step.join(now.select(F.col("node").alias("a"), "value"), "a").select(F.col("b").alias("node"), "value")
        old = now.select("node", "value", F.col("value").alias("old"))
        moved = cut(old.unionByName(heard, allowMissingColumns=True).groupBy("node").agg(best("value").alias("value"), F.max("old").alias("old")).where("old is not null"))
        if not moved.where("value <> old").take(1):
            return moved.select("node", "value")
        now = moved.select("node", "value")


def strong_components(edges: DataFrame) -> DataFrame:
    """Strong components: node, scc (its smallest node).

    Each round colours nodes with the least (then the greatest, in turn) node that reaches them; a colour's own node and what
    reaches it inside the colour are one component. Edges between colours cannot lie in one and go.
    """
    ends = edges.select("src", "dst").distinct()
    nodes = cut(ends.select(F.col("src").alias("node")).union(ends.select("dst")).distinct())
    left = cut(ends.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    done, turn = None, 0
    while True:
        colour = _spread(nodes.withColumn("value", F.col("node")), left, F.max if turn % 2 else F.min)
        mine = colour.select(F.col("node").alias("a"), F.col("value").alias("ca"))
        inside = cut(left.join(mine, "a").join(mine.toDF("b", "cb"), "b").where("ca = cb").select("a", "b"))
        # what reaches the colour's own node, backwards inside the colour
        back = inside.select(F.col("b").alias("a"), F.col("a").alias("b"))
        hit = _spread(colour.select("node", (F.col("node") == F.col("value")).cast("int").alias("value")), back, F.max)
        found = hit.where("value = 1").select("node").join(colour, "node")
        least = found.groupBy("value").agg(F.min("node").alias("scc"))
        got = found.join(least, "value").select("node", "scc")
        done = cut(got if done is None else done.unionByName(got))
        nodes = cut(hit.where("value = 0").select("node"))
        if not nodes.take(1):
            return done
        keep = nodes.select(F.col("node").alias("a"))
        left = cut(inside.join(keep, "a", "left_semi").join(keep.toDF("b"), "b", "left_semi"))
        turn += 1


def cyclic_groups(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Strong components (node, scc) of more than one node or with a loop: size, edges inside, and edges by node squared (density)."""
    size = members.groupBy("scc").agg(F.count("*").alias("size"))
    left, right = members.toDF("src", "scc"), members.toDF("dst", "scc_of_dst")
    inside = edges.select("src", "dst").distinct().join(left, "src").join(right, "dst").where("scc = scc_of_dst")
    inside = inside.groupBy("scc").agg(F.count("*").alias("inside"))
    return size.join(inside, "scc").select("scc", "size", "inside", F.round(F.col("inside") / (F.col("size") * F.col("size")), 6).alias("density"))


def shared_symbols(uses: DataFrame, members: DataFrame, definitions: DataFrame) -> DataFrame:
    """Symbols (node, symbol) that several nodes of one strong component use, with the node that defines them if any."""
    named = uses.select("node", "symbol").distinct().join(members, "node")
    counted = named.groupBy("scc", "symbol").agg(F.count("*").alias("users")).where("users > 1")
    home = definitions.groupBy("symbol").agg(F.min("node").alias("home"))
    return counted.join(home, "symbol", "left")


def light_edges(weighted: DataFrame, members: DataFrame, limit: int = 3) -> DataFrame:
    """The lightest edges (src, dst, weight) inside each strong component, where a cycle is cheapest to break; the limit is the feature."""
    left, right = members.toDF("src", "scc"), members.toDF("dst", "scc_of_dst")
    inside = weighted.where("src <> dst").join(left, "src").join(right, "dst").where("scc = scc_of_dst")
    ranked = inside.withColumn("nth", F.row_number().over(Window.partitionBy("scc").orderBy("weight", "src", "dst")))
    return ranked.where(F.col("nth") <= limit).select("scc", "nth", "src", "dst", "weight")


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """Simple cycles of up to ``longest`` edges, each once, from its smallest node: path (array of nodes), size."""
    step = edges.select("src", "dst").distinct()
    open_paths = step.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    out = step.where("src = dst").select(F.array("src").alias("path"))
    for size in range(2, longest + 1):
        grown = open_paths.join(step.withColumnRenamed("src", "at"), "at")
        out = out.unionByName(grown.where(F.col("dst") == F.col("path")[0]).select("path"))
        if size < longest:
            ahead = (F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))
            open_paths = grown.where(ahead).select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at"))
    return out.withColumn("size", F.size("path"))


def weakest_links(found: DataFrame, handy: Column) -> DataFrame:
    """The edge of each cycle (path) to break: the first into a node that ``handy`` (of column ``b``) holds for, else the first."""
    step = F.transform("path", lambda a, i: F.struct(a.alias("a"), F.get("path", (i + 1) % F.size("path")).alias("b"), i.alias("place")))
    steps = found.select("path", F.explode(step).alias("s")).select("path", "s.a", "s.b", "s.place")
    picked = steps.groupBy("path").agg(F.min_by(F.struct("a", "b"), F.struct((~handy).cast("int"), F.col("place"))).alias("e"))
    return picked.select(F.array_join(F.transform("path", lambda v: v.cast("string")), ">").alias("cycle"), "e.a", "e.b")


def levels(edges: DataFrame) -> DataFrame:
    """Topological levels: node, level (edges on the longest path to it); nodes on or behind a cycle have none (null)."""
    step = cut(edges.select("src", "dst").distinct())
    nodes = cut(step.select(F.col("src").alias("node")).union(step.select("dst")).distinct())
    done, level = None, 0
    while True:
        free = nodes.join(step.select(F.col("dst").alias("node")), "node", "left_anti")
        got = cut(free.withColumn("level", F.lit(level)))
        if not got.take(1):
            rest = nodes.withColumn("level", F.lit(None).cast("int"))
            return rest if done is None else done.unionByName(rest)
        done = cut(got if done is None else done.unionByName(got))
        nodes = cut(nodes.join(got, "node", "left_anti"))
        step = cut(step.join(got.select(F.col("node").alias("src")), "src", "left_anti"))
        level += 1


def distances(edges: DataFrame, sources: DataFrame, most: int = 10) -> DataFrame:
    """Shortest directed distances (source, node, hops) from each source (node) within ``most`` edges."""
    step = edges.select("src", "dst").distinct()
    front = cut(sources.select(F.col("node").alias("source"), F.col("node")).distinct().withColumn("hops", F.lit(0)))
    seen = front
    for hop in range(1, most + 1):
        ahead = front.select("source", F.col("node").alias("src")).join(step, "src").select("source", F.col("dst").alias("node")).distinct()
        front = cut(ahead.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if not front.take(1):
            break
        seen = cut(seen.unionByName(front))
    return seen


def cascades(edges: DataFrame, groups: DataFrame, most: int = 10) -> DataFrame:
    """How far a change of each node goes: descendants, ancestors, groups (node, group) met, and (2 d + a) (1 + 0.1 groups).

    Reach is followed for ``most`` edges; the node itself counts on neither side.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    pairs = distances(edges, nodes, most).where("source <> node")
    down = pairs.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("descendants"))
    up = pairs.groupBy("node").agg(F.count("*").alias("ancestors"))
    met = pairs.join(groups, "node").groupBy(F.col("source").alias("node")).agg(F.countDistinct("group").alias("groups"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = nodes.join(down, "node", "left").join(up, "node", "left").join(met, "node", "left")
    joined = joined.select("node", zero("descendants"), zero("ancestors"), zero("groups"))
    score = (2 * F.col("descendants") + F.col("ancestors")) * (1 + 0.1 * F.col("groups"))
    return joined.withColumn("potential", F.round(score, 4))


def degree_facts(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node, paths through it (in x out + in), and runtime reach min(1, (0.7 in + 0.3 out) / 20)."""
    step = edges.select("src", "dst").distinct()
    ends = step.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(step.select("dst", F.lit(1), F.lit(0)))
    counted = ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    paths = F.col("fan_in") * F.col("fan_out") + F.col("fan_in")
    reach = F.least(F.lit(1.0), (0.7 * F.col("fan_in") + 0.3 * F.col("fan_out")) / 20.0)
    return counted.withColumns({"paths": paths, "reach": F.round(reach, 6)})


def intersections(facts: DataFrame) -> DataFrame:
    """Nodes with paths above max(2, a tenth of the nodes), most paths first."""
    limit = facts.agg(F.greatest(F.lit(2.0), 0.1 * F.count("*")).alias("limit"))
    return facts.crossJoin(limit).where("paths > limit").select("node", "paths").orderBy(F.col("paths").desc(), "node")


def top_share(rows: DataFrame, by: str, tie: str, share: float = 0.1) -> DataFrame:
    """The highest rows by a column, a share of all but one at least, in order; no task or driver holds them all."""
    order, most = [F.col(by).desc(), F.col(tie)], max(1, int(rows.count() * share))
    return numbered(rows, order, name="_nth").where(F.col("_nth") <= most).drop("_nth").orderBy(*order)


def anchors(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Element pairs (a, b) of modules that import each other both ways. ``elements`` have module and element."""
    one = edges.select("src", "dst").where("src <> dst").distinct()
    both = one.join(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).where("src < dst")
    left, right = elements.select(F.col("module").alias("src"), F.col("element").alias("a")), elements.select(F.col("module").alias("dst"), F.col("element").alias("b"))
    return both.join(left, "src").join(right, "dst").select("src", "dst", "a", "b")


def resolve(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (file, name) with the symbol (id, file, name) they mean: of the same file, else the least id of that name; else null."""
    same = symbols.groupBy("file", "name").agg(F.min("id").alias("same"))
    any_ = symbols.groupBy("name").agg(F.min("id").alias("other"))
    joined = calls.join(same, ["file", "name"], "left").join(any_, "name", "left")
    return joined.withColumn("target", F.coalesce("same", "other")).drop("same", "other")


def layer_dependencies(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Which layer (node, layer) depends on which other: from_layer, to_layer, edges."""
    left, right = layers.toDF("src", "from_layer"), layers.toDF("dst", "to_layer")
    named = edges.select("src", "dst").distinct().join(left, "src").join(right, "dst").where("from_layer <> to_layer")
    return named.groupBy("from_layer", "to_layer").agg(F.count("*").alias("edges"))


def place_conflicts(fixes: DataFrame) -> DataFrame:
    """Places (file, line) with more than one fix, and symbols that one fix deletes and a later one (by id) replaces: by, key, fixes."""
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    same = fixes.where(F.col("file").isNotNull()).groupBy(place.alias("key")).agg(F.count("*").alias("fixes")).where("fixes > 1")
    by_symbol = fixes.where(F.col("symbol").isNotNull()).groupBy(F.col("symbol").alias("key")).agg(
        F.min(F.when(F.col("action") == "delete", F.col("id"))).alias("gone"), F.max(F.when(F.col("action") == "replace", F.col("id"))).alias("set"),
        F.count("*").alias("fixes"),
    ).where("set > gone")
    return same.select(F.lit("place").alias("by"), "key", "fixes").unionByName(by_symbol.select(F.lit("symbol").alias("by"), "key", "fixes"))


def grouped_components(edges: DataFrame, nodes: DataFrame, component: DataFrame) -> DataFrame:
    """All nodes with their component (node, component); those without edges are their own."""
    return nodes.join(component, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def risk_bands(members: DataFrame, bands: Sequence[tuple[int, str]] = ((10, "high"), (5, "medium"), (0, "low"))) -> DataFrame:
    """Components (node, component) with their size and the band of the first limit that it reaches."""
    sized = members.groupBy("component").agg(F.count("*").alias("size"))
    band = F.lit(bands[-1][1])
    for least, name in reversed(bands):
        band = F.when(F.col("size") >= least, name).otherwise(band)
    return sized.withColumn("risk", band)

"""Selection on the forest of preferences, level by level, as joins and aggregations only.

Every name of at least three ranks prefers its best candidate, whose first source rank belongs to another name: its parent.
Each name has one parent at most, so following parents ends at a root or runs into a cycle. Cycles are found by doubling
the step (2, 4, 8, ... parents at once); a cycle loses one edge. On the forest that is left, a name is kept or
compressed, never together with its parent; sums over the levels from below give the most that a subtree saves either
way, and the levels from above settle it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import preference_edges
from .selection import in_turn
from .tables import kept, released


def preferences(found: DataFrame, ranked: DataFrame, intervals: DataFrame) -> DataFrame:
    """text_id, name, src_name, cov of the best candidate of each name of at least three ranks."""
    sizes = intervals.select("text_id", "name", "size")
    return preference_edges(found, ranked).join(sizes, ["text_id", "name"]).where("size >= 3").select("text_id", "name", "src_name", "cov")


def on_cycles(edges: DataFrame) -> DataFrame:
    """text_id, name, top, weakest of the names of edges (text_id, name, src_name, cov) that lie on a cycle: the largest name of their
    cycle, and (cov, name) of its edge of least coverage, of several that of the least name.

    After enough doublings every path is on a cycle or past a root; where it is, it has seen the whole cycle.
    """
    most = edges.groupBy("text_id").count().agg(F.max("count")).first()[0] or 0
    step = edges.select("text_id", "name", F.col("src_name").alias("to"), F.col("name").alias("top"), F.struct("cov", F.col("name").alias("n")).alias("weakest"))
    step = kept(step, "step")
    for _ in range(most.bit_length()):
        on = step.select("text_id", F.col("name").alias("to"), F.col("to").alias("far"), F.col("top").alias("t"), F.col("weakest").alias("w"))
        # A path that leaves the edges (at a root) is on no cycle and is dropped.
        after = step.join(on, ["text_id", "to"]).select("text_id", "name", F.col("far").alias("to"), F.greatest("top", "t").alias("top"), F.least("weakest", "w").alias("weakest"))
        before, step = step, kept(after, "step")
        released(before)
    # Names below a cycle run into it, too; those on it are reached.
    reached = step.select("text_id", F.col("to").alias("name")).distinct()
    inside = kept(step.join(reached, ["text_id", "name"]), "cycles")
    released(step)
    return inside.select("text_id", "name", "top", "weakest")


def forest(edges: DataFrame, repair: bool = False, least_gain: int = 1) -> DataFrame:
    """edges (text_id, name, src_name, cov), none from a name to itself, less one of each cycle: that of its largest name, or with
    repair that of least coverage if at least ``least_gain`` less is lost by it."""
    cycles = on_cycles(edges)
    if not repair:
        return edges.join(cycles.where("name = top").select("text_id", "name"), ["text_id", "name"], "left_anti")
    largest = edges.select("text_id", F.col("name").alias("top"), F.col("cov").alias("top_cov"))
    weaker = F.col("top_cov") - F.col("weakest.cov") >= least_gain
    lost = cycles.join(largest, ["text_id", "top"]).where(F.when(weaker, F.col("weakest.n")).otherwise(F.col("top")) == F.col("name"))
    return edges.join(lost.select("text_id", "name"), ["text_id", "name"], "left_anti")


def levels(trees: DataFrame) -> list[DataFrame]:
    """The names of a forest (text_id, name, src_name, cov) by depth: text_id, name, parent, cov; roots have neither of the two."""
    roots = trees.select("text_id", F.col("src_name").alias("name")).distinct().join(trees, ["text_id", "name"], "left_anti")
    level = kept(roots.select("text_id", "name", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("int").alias("cov")), "level")
    out = []
    while not level.isEmpty():
        out.append(level)
        above = level.select("text_id", F.col("name").alias("src_name"))
        level = kept(trees.join(above, ["text_id", "src_name"]).select("text_id", "name", F.col("src_name").alias("parent"), "cov"), "level")
    return out


def wanted(trees: DataFrame) -> DataFrame:
    """text_id, name, depth of the names to compress: on every tree a set of greatest coverage without a name and its parent; of two
    choices that save the same the one that keeps the name higher up. Roots are kept."""
    by_depth = levels(trees)
    below, gains = None, []
    for level in reversed(by_depth):  # what a subtree saves if its name is kept, and if it is compressed
        if below is None:
            sums = level.withColumns({"keep": F.lit(0).cast("long"), "free": F.lit(0).cast("long")})
        else:
            of_children = below.groupBy("text_id", F.col("parent").alias("name")).agg(F.sum(F.greatest("keep", "compress")).alias("keep"), F.sum("keep").alias("free"))
            sums = level.join(of_children, ["text_id", "name"], "left").na.fill(0, ["keep", "free"])
        below = kept(sums.select("text_id", "name", "parent", "keep", (F.coalesce("cov", F.lit(-1)) + F.col("free")).alias("compress")), "gain")
        gains.append(below)
    out, above = None, None
    for depth, level in enumerate(reversed(gains)):
        if above is None:
            state = level.select("text_id", "name", F.lit(False).alias("wanted"))
        else:
            parents = above.select("text_id", F.col("name").alias("parent"), F.col("wanted").alias("taken"))
            state = level.join(parents, ["text_id", "parent"]).select("text_id", "name", (~F.col("taken") & (F.col("compress") > F.col("keep"))).alias("wanted"))
        above = kept(state.withColumn("depth", F.lit(depth)), "wanted")
        out = above if out is None else out.union(above)
    if out is None:
        return trees.select("text_id", "name", F.lit(0).alias("depth")).limit(0)
    return out.where("wanted").select("text_id", "name", "depth")


def forest_turns(found: DataFrame, ranked: DataFrame, intervals: DataFrame, repair: bool = False) -> DataFrame:
    """text_id, name, turn: the wanted names from the deepest level up, by name in a level; then all others by size, then name."""
    edges = kept(preferences(found, ranked, intervals).where("name <> src_name"), "edges")
    first = wanted(kept(forest(edges, repair), "forest"))
    names = found.select("text_id", "name").distinct().join(intervals.select("text_id", "name", "size"), ["text_id", "name"]).join(first, ["text_id", "name"], "left")
    key = lambda a, b: F.struct(F.lit(a).alias("phase"), b.cast("long").alias("by"), F.col("name").alias("n"))
    return names.select("text_id", "name", F.when(F.col("depth").isNotNull(), key(0, -F.col("depth"))).otherwise(key(1, -F.col("size"))).alias("turn"))


def forest_rounds(found: DataFrame, ranked: DataFrame, intervals: DataFrame, repair: bool = False, rounds: int = 1000) -> DataFrame:
    """tree-dp (with repair tree-dp4) without retargeting: the forest's choice takes its links first, leftovers follow greedily."""
    return in_turn(found, ranked, forest_turns(found, ranked, intervals, repair), rounds)

"""Choosing links: one task per component of names that share ranks, or rounds of joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .links import preference_edges, source_edges
from .tables import components, kept, numbered, released

#: Candidates of a text up to which it is one group.
SMALL = 20_000
CHOSEN = T.StructType().add("text_id", "long").add("name", "long").add("add", "integer").add("src_lo", "integer").add("src_hi", "integer").add("cov", "integer").add("covered", T.ArrayType(T.IntegerType())).add("whole", "boolean")


def select(found: DataFrame, ranked: DataFrame, intervals: DataFrame, algo: str = "greedy", min_coverage: int = 3, **options) -> DataFrame:
    """The chosen links, at most one a name; ``whole`` is false where an exact search ran out of nodes.

    A component's candidates are one group. Components lie within a text, so groups are
    bounded by the texts; text_ids are independent tasks. Where no text has more than SMALL candidates, its text is
    the group and components are not looked for; names of different components do not meet, so the links are the same.
    """
    algo = kernels.algorithm(algo)
    found = kept(found, "candidates")
    most = found.groupBy("text_id").count().agg(F.max("count")).first()[0] or 0
    small = algo != "exact" and most <= SMALL  # an exact search has a budget for each component
    labels = found.select("text_id", F.col("name").alias("node")).distinct().withColumn("component", F.lit(0)) if small else components(source_edges(found, ranked))
    sources = ranked.select("text_id", F.col("rank").alias("src_lo"), F.col("name").alias("src_name"))
    sizes = intervals.select("text_id", "name", "size")
    of_source = sizes.withColumnsRenamed({"name": "src_name", "size": "src_size"})
    rows = found.join(labels.withColumnRenamed("node", "name"), ["text_id", "name"]).join(sources, ["text_id", "src_lo"]).join(sizes, ["text_id", "name"]).join(of_source, ["text_id", "src_name"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        links = [kernels.Link(int(n), int(a), int(lo), int(hi), tuple(int(x) for x in cov)) for n, a, lo, hi, cov in zip(frame["name"], frame["add"], frame["src_lo"], frame["src_hi"], frame["covered"], strict=True)]
        size = {**dict(zip(frame["src_name"].tolist(), frame["src_size"].tolist(), strict=True)), **dict(zip(frame["name"].tolist(), frame["size"].tolist(), strict=True))}
        c = kernels.Component(links, size, dict(zip(frame["src_lo"].tolist(), frame["src_name"].tolist(), strict=True)), min_coverage)
        whole = kernels.ALGORITHMS[algo](c, **options) is not False
        out = [(int(frame["text_id"].iloc[0]), x.name, x.add, x.src_lo, x.src_hi, x.cov, list(x.covered), whole) for x in c.chosen.values()]
        return pd.DataFrame(out, columns=CHOSEN.names)

    return rows.groupBy("text_id", "component").applyInPandas(run, CHOSEN)


def greedy_rounds(found: DataFrame, ranked: DataFrame, intervals: DataFrame, rounds: int = 1000) -> DataFrame:
    """Greedy selection as joins only, for components too large for a task: names of more ranks first, then smaller names."""
    order = F.struct((-F.col("size")).alias("s"), F.col("name").alias("n"))
    turns = found.select("text_id", "name").distinct().join(intervals, ["text_id", "name"]).select("text_id", "name", order.alias("turn"))
    return in_turn(found, ranked, turns, rounds)


def dependency_rounds(found: DataFrame, ranked: DataFrame, intervals: DataFrame, rounds: int = 1000) -> DataFrame:
    """dep-order as joins only: names that others prefer to read from decide after those (no retargeting follows)."""
    return in_turn(found, ranked, dependency_turns(found, ranked, intervals, rounds), rounds)


def dependency_turns(found: DataFrame, ranked: DataFrame, intervals: DataFrame, rounds: int = 1000) -> DataFrame:
    """text_id, name, turn of the names that have a preference: the reverse of a topological order of the preferences.

    A name of at least three ranks prefers its best candidate and depends on the name of its first source rank. Names without
    a dependency are the first layer, those that depend on a layer the next; in a layer, dependents stand in the order of
    what they depend on, then by name. Names that no layer reaches (they depend on a cycle) follow by size, then name.
    Every layer is numbered by a range sort, so that no task holds one.
    """
    sizes = intervals.select("text_id", "name", "size")
    prefer = preference_edges(found, ranked).join(sizes, ["text_id", "name"]).where("size >= 3")
    prefer = kept(prefer.select("text_id", "name", "src_name"), "prefer")
    edges = prefer.where("name <> src_name")
    nodes = kept(found.select("text_id", "name").union(prefer.select("text_id", F.col("src_name"))).distinct(), "nodes")
    layer = numbered(nodes.join(edges, ["text_id", "name"], "left_anti"), "pos", "text_id", "name")
    order, ahead = None, 0
    for _ in range(rounds):
        layer = kept(layer.select("text_id", "name", (F.col("pos") + ahead).alias("pos")), "layer")
        order = layer if order is None else order.union(layer)
        if not (n := layer.count()):
            break
        ahead += n
        above = layer.select("text_id", F.col("name").alias("src_name"), F.col("pos").alias("above"))
        layer = numbered(edges.join(above, ["text_id", "src_name"]).select("text_id", "name", "above"), "pos", "text_id", "above", "name")
    else:
        raise RuntimeError(f"preferences are deeper than {rounds} layers")
    rest = nodes.join(order, ["text_id", "name"], "left_anti").join(sizes, ["text_id", "name"]).withColumn("above", -F.col("size"))
    rest = numbered(rest.select("text_id", "name", "above"), "pos", "text_id", "above", "name").select("text_id", "name", (F.col("pos") + ahead).alias("pos"))
    return order.union(rest).join(prefer.select("text_id", "name"), ["text_id", "name"]).select("text_id", "name", (-F.col("pos")).alias("turn"))


def in_turn(found: DataFrame, ranked: DataFrame, turns: DataFrame, rounds: int = 1000) -> DataFrame:
    """The links of names that decide one after another in order of ``turn`` (text_id, name, turn), as joins only.

    In a round, every name decides that stands before all its undecided neighbours: it takes its best candidate whose source
    is kept and whose covered ranks are neither removed nor read by others. Neighbours never decide together, so
    the outcome is that of deciding one by one. Names without a turn take none.
    """
    edges = source_edges(found, ranked).where("a <> b")
    near = kept(edges.union(edges.select("text_id", "b", "a")).distinct(), "near")
    undecided = kept(turns, "undecided")
    found = kept(found, "candidates")
    chosen = found.limit(0)
    for _ in range(rounds):
        if undecided.isEmpty():
            return chosen
        others = undecided.select("text_id", F.col("name").alias("b"), F.col("turn").alias("other"))
        earlier = near.join(undecided.withColumnRenamed("name", "a"), ["text_id", "a"]).join(others, ["text_id", "b"]).where("other < turn")
        ready = undecided.join(earlier.select("text_id", F.col("a").alias("name")).distinct(), ["text_id", "name"], "left_anti").select("text_id", "name")
        own = found.join(ready, ["text_id", "name"])
        removed = chosen.select("text_id", F.explode("covered").alias("rank"))
        read = chosen.select("text_id", F.explode(F.sequence("src_lo", F.col("src_hi") - 1)).alias("rank"))
        key = ["text_id", "name", "add", "src_lo"]
        source = own.select(*key, F.explode(F.sequence("src_lo", F.col("src_hi") - 1)).alias("rank")).join(removed, ["text_id", "rank"], "left_semi")
        covered = own.select(*key, F.explode("covered").alias("rank")).join(removed.union(read).distinct(), ["text_id", "rank"], "left_semi")
        free = own.join(source.select(*key).union(covered.select(*key)).distinct(), key, "left_anti")
        best = free.groupBy("text_id", "name").agg(F.max(F.struct("cov", "add", (-F.col("src_lo")).alias("first"), "src_lo", "src_hi", "covered")).alias("b"))
        before = chosen, undecided
        chosen = kept(chosen.unionByName(best.select("text_id", "name", *[F.col(f"b.{c}").alias(c) for c in ("add", "src_lo", "src_hi", "cov", "covered")])), "chosen")
        undecided = kept(undecided.join(ready, ["text_id", "name"], "left_anti"), "undecided")
        released(*before)
    raise RuntimeError(f"names are undecided after {rounds} rounds")


def infeasible(chosen: DataFrame) -> DataFrame:
    """text_id, name, why: links that cannot stand together. Empty for every selection made here."""
    twice = chosen.groupBy("text_id", "name").count().where("count > 1").select("text_id", "name", F.lit("second link of the name").alias("why"))
    source = chosen.select("text_id", "name", F.explode(F.sequence("src_lo", F.col("src_hi") - 1)).alias("rank"))
    removed = chosen.select("text_id", F.explode("covered").alias("rank")).distinct()
    return twice.union(source.join(removed, ["text_id", "rank"], "left_semi").select("text_id", "name", F.lit("source rank is removed").alias("why")).distinct())

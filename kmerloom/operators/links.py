"""Candidate links: ranks of one name whose positions are other ranks' positions, shifted.

A link of add a says that the positions of some ranks of name c (the covered ones) are those of a
run of consecutive ranks (the source), each plus a * span. The source stays stored, the covered
ranks need not be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import islands

UNIVERSES = ("legacy", "maximal", "full")


def shifted(ranked: DataFrame, intervals: DataFrame, span: int, max_add: int, least: int) -> DataFrame:
    """text_id, name, lo, hi, add, t (rank of name), s (rank of the position add * span before t's).

    Names with fewer ranks than the least coverage are left out before the join.
    """
    if max_add < 1:
        raise ValueError("max_add is at least 1")
    wanted = intervals.where(F.col("size") >= F.greatest(F.lit(2), F.lit(least))).select("text_id", "name", "lo", "hi")
    t = ranked.join(wanted, ["text_id", "name"]).select("text_id", "name", "lo", "hi", F.col("rank").alias("t"), "orig")
    t = t.withColumn("add", F.explode(F.sequence(F.lit(1), F.lit(max_add)))).withColumn("orig", F.col("orig") - F.col("add") * span)
    s = ranked.select("text_id", "orig", F.col("rank").alias("s"), F.col("lcp").alias("s_lcp"))
    return t.join(s, ["text_id", "orig"]).drop("orig")


def candidates(ranked: DataFrame, intervals: DataFrame, span: int, max_add: int = 8, min_coverage: int = 3, intra: bool = True) -> DataFrame:
    """text_id, name, add, src_lo, src_hi, cov, covered: maximal runs with lcp >= add + 1 inside.

    A run that reaches into its own interval is cut into its maximal windows that hold none of the
    ranks they cover, or dropped without ``intra``.
    """
    keys = ["text_id", "name", "add"]
    pairs = islands(shifted(ranked, intervals, span, max_add, min_coverage), keys, "s", F.col("s_lcp") < F.col("add") + 1)
    runs = pairs.groupBy(*keys, "run").agg(
        F.min("s").alias("src_lo"), (F.max("s") + 1).alias("src_hi"), F.count("*").cast("int").alias("cov"),
        F.transform(F.array_sort(F.collect_list(F.struct("s", "t"))), lambda p: p["t"]).alias("covered"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
    ).where(F.col("cov") >= min_coverage)
    apart = (F.col("src_hi") <= F.col("lo")) | (F.col("src_lo") >= F.col("hi"))
    columns = [*keys, "src_lo", "src_hi", "cov", "covered"]
    found = runs.where(apart).select(*columns)
    return found.unionByName(_windows(runs.where(~apart), min_coverage).select(*columns)) if intra else found


def _windows(runs: DataFrame, min_coverage: int) -> DataFrame:
    """Maximal sub-runs [p, q) of each run with no t in [p, q) that covers a rank of [p, q)."""
    keys = ["text_id", "name", "add", "run"]
    places = runs.select(*keys, "src_lo", F.col("cov").alias("length"), F.posexplode("covered").alias("t", "rank")).withColumn("u", F.col("rank") - F.col("src_lo"))
    # A pair (t, u) traps every window from min(t, u) or before to max(t, u) or after.
    traps = places.where("u >= 0 AND u < length").groupBy(*keys, F.greatest("t", "u").alias("t")).agg(F.max(F.least("t", "u") + 1).alias("bar"))
    barred = places.join(traps, [*keys, "t"], "left").withColumn("bar", F.coalesce("bar", F.lit(0)))
    order = Window.partitionBy(*keys).orderBy("t")
    ends = barred.withColumns({"p": F.max("bar").over(order.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("bar").over(order)})
    ends = ends.where("next IS NULL OR next > p").select(*keys, "p", (F.col("t") + 1).alias("q")).where(F.col("q") - F.col("p") >= min_coverage)
    cut = runs.join(ends, keys)
    n = F.col("q") - F.col("p")
    return cut.withColumns({"covered": F.slice("covered", F.col("p") + 1, n), "src_hi": F.col("src_lo") + F.col("q"), "src_lo": F.col("src_lo") + F.col("p"), "cov": n.cast("int")})


def all_links(ranked: DataFrame, intervals: DataFrame, span: int, max_add: int = 8, min_coverage: int = 3, sub_runs: bool = True) -> DataFrame:
    """Every decodable link, for exact selection: sub-runs of runs of consecutive ranks whose successors have one name.

    Without sub_runs only whole runs: linear in the text. With them a run of length L has up to
    L^2 / 2 links, by definition; meant for small texts.
    """
    pairs = islands(shifted(ranked, intervals, span, max_add, min_coverage), ["text_id", "name", "add"], "s", F.lit(False))
    keys = ["text_id", "name", "add", "run"]
    runs = pairs.groupBy(*keys).agg(F.min("s").alias("src"), F.transform(F.array_sort(F.collect_list(F.struct("s", "t"))), lambda p: p["t"]).alias("tgt")).where(F.size("tgt") >= min_coverage)
    size = F.size("tgt")
    p = F.explode(F.sequence(F.lit(0), size - min_coverage)) if sub_runs else F.explode(F.array(F.lit(0)))
    starts = runs.withColumn("p", p)
    last = F.sequence(F.col("p") + min_coverage, size) if sub_runs else F.array(size)
    cut = starts.withColumn("q", F.explode(last)).select(*keys, (F.col("src") + F.col("p")).alias("src_lo"), (F.col("src") + F.col("q")).alias("src_hi"), F.slice("tgt", F.col("p") + 1, F.col("q") - F.col("p")).alias("covered"))
    free = cut.where(~F.exists("covered", lambda r: (r >= F.col("src_lo")) & (r < F.col("src_hi"))))
    return free.select("text_id", "name", "add", "src_lo", "src_hi", F.size("covered").alias("cov"), "covered")


def preferred(found: DataFrame, keep: int | None = None) -> DataFrame:
    """The best candidate of each name (largest coverage, then add, then first source), or the ``keep`` best, numbered."""
    best = Window.partitionBy("text_id", "name").orderBy(F.col("cov").desc(), F.col("add").desc(), "src_lo")
    numbered = found.withColumn("place", F.row_number().over(best))
    return numbered.where("place = 1").drop("place") if keep is None else numbered.where(F.col("place") <= keep)


def preference_edges(found: DataFrame, ranked: DataFrame, keep: int | None = None) -> DataFrame:
    """text_id, src_name, name, add, cov: from the name of the first source rank to the name it serves."""
    source = ranked.select("text_id", F.col("rank").alias("src_lo"), F.col("name").alias("src_name"))
    return preferred(found, keep).join(source, ["text_id", "src_lo"]).select("text_id", "src_name", "name", "add", "cov")


def source_edges(found: DataFrame, ranked: DataFrame) -> DataFrame:
    """text_id, a (name), b (name of any of its candidates' source ranks)."""
    ranks = found.select("text_id", F.col("name").alias("a"), F.explode(F.sequence("src_lo", F.col("src_hi") - 1)).alias("rank")).distinct()
    return ranks.join(ranked.select("text_id", "rank", F.col("name").alias("b")), ["text_id", "rank"]).select("text_id", "a", "b").distinct()


def conflicts(links: DataFrame) -> DataFrame:
    """text_id, name, other: pairs of links (one a name) where a source rank of ``name`` is covered by ``other``."""
    source = links.select("text_id", "name", F.explode(F.sequence("src_lo", F.col("src_hi") - 1)).alias("rank"))
    covered = links.select("text_id", F.col("name").alias("other"), F.explode("covered").alias("rank"))
    return source.join(covered, ["text_id", "rank"]).select("text_id", "name", "other").distinct()


def mean_degrees(found: DataFrame, ranked: DataFrame, cap: int = 16) -> DataFrame:
    """text_id, mean_degree: neighbours of a name in the dependency graph (either reads from the other), at most ``cap`` of each counted."""
    edges = source_edges(found, ranked).where("a <> b")
    both = edges.union(edges.select("text_id", "b", "a")).distinct()
    degrees = both.groupBy("text_id", "a").agg(F.least(F.count("*"), F.lit(cap)).alias("n"))
    return degrees.groupBy("text_id").agg((F.sum("n") / F.count("*")).alias("mean_degree"))

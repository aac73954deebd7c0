"""Text forms of a selection problem: linear program, tables and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(links: DataFrame) -> DataFrame:
    """links with ``e``, their number within the text."""
    return links.withColumn("e", F.row_number().over(Window.partitionBy("text_id").orderBy("name", "add", "src_lo", "src_hi")) - 1)


def constraints(links: DataFrame) -> DataFrame:
    """text_id, kind, line: at most one link a name; a chosen link drops what it covers and keeps its source; what no
    chosen link covers is kept. x_r: rank r is kept, y_e: link e is chosen."""
    e = numbered(links)
    y = F.concat(F.lit("y_"), F.col("e").cast("string"))
    x = F.concat(F.lit("x_"), F.col("rank").cast("string"))
    one = e.groupBy("text_id", "name").agg(F.sort_array(F.collect_list("e")).alias("es"))
    one = one.select("text_id", F.lit("one").alias("kind"), F.concat(F.array_join(F.transform("es", lambda v: F.concat(F.lit("y_"), v.cast("string"))), " + "), F.lit(" <= 1")).alias("line"))
    covered = e.select("text_id", "e", F.explode("covered").alias("rank"))
    drop = covered.select("text_id", F.lit("drop").alias("kind"), F.concat(x, F.lit(" + "), y, F.lit(" <= 1")).alias("line"))
    source = e.select("text_id", "e", F.explode(F.sequence("src_lo", F.col("src_hi") - 1)).alias("rank"))
    keep = source.select("text_id", F.lit("keep").alias("kind"), F.concat(x, F.lit(" - "), y, F.lit(" >= 0")).alias("line"))
    by_rank = covered.groupBy("text_id", "rank").agg(F.sort_array(F.collect_list("e")).alias("es"))
    stay = by_rank.select("text_id", F.lit("stay").alias("kind"), F.concat(x, F.lit(" + "), F.array_join(F.transform("es", lambda v: F.concat(F.lit("y_"), v.cast("string"))), " + "), F.lit(" >= 1")).alias("line"))
    return one.union(drop).union(keep).union(stay)


def write_lp(links: DataFrame, path: str) -> None:
    """The program of each text below path/text_id=...: minimise the kept covered ranks subject to the constraints."""
    lines = constraints(links).withColumn("part", F.lit(2))
    ranks = links.select("text_id", F.explode("covered").alias("rank")).distinct()
    goal = ranks.groupBy("text_id").agg(F.sort_array(F.collect_list("rank")).alias("rs"))
    head = goal.select("text_id", F.concat(F.lit("Minimize\n obj: "), F.array_join(F.transform("rs", lambda r: F.concat(F.lit("x_"), r.cast("string"))), " + "), F.lit("\nSubject To")).alias("line"), F.lit(1).alias("part"))
    variables = ranks.select("text_id", F.concat(F.lit("x_"), F.col("rank").cast("string")).alias("v")).union(numbered(links).select("text_id", F.concat(F.lit("y_"), F.col("e").cast("string")).alias("v")))
    tail = variables.groupBy("text_id").agg(F.concat(F.lit("Binary\n "), F.array_join(F.sort_array(F.collect_list("v")), " "), F.lit("\nEnd")).alias("line")).select("text_id", "line", F.lit(3).alias("part"))
    whole = head.unionByName(lines.select("text_id", F.concat(F.lit(" "), F.col("line")).alias("line"), "part")).unionByName(tail)
    whole.repartition("text_id").sortWithinPartitions("text_id", "part").select("text_id", "line").write.mode("overwrite").partitionBy("text_id").text(path)


def mermaid(edges: DataFrame) -> DataFrame:
    """text_id, line: an arrow from the source's name to the name it serves, with add and coverage."""
    return edges.select("text_id", F.format_string("  n%s -->|add=%s cov=%s| n%s", F.col("src_name"), F.col("add"), F.col("cov"), F.col("name")).alias("line"))

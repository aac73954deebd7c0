"""Tables kept between jobs, and connected components of edge tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none: a temporary one in local mode, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, so that iterations have a short lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.kept_at = path
    return table


def released(*tables: DataFrame) -> None:
    """Deletes tables that ``kept`` wrote and that nothing reads any more: those of a loop's earlier rounds."""
    for table in tables:
        if path := getattr(table, "kept_at", None):
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df, kept, with its rows numbered from 0 by ``order`` as ``name``: a range sort and offsets of its partitions, no window."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = kept(placed, "numbered")
    part = F.shiftright("_at", 33)  # a partition's number; below it the place inside
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")


def placed(df: DataFrame, *order: str) -> DataFrame:
    """df, kept, range-sorted by ``order``, with ``part`` (number of the range) and ``at`` (ascending in a part)."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = kept(rows, "placed")
    return rows.withColumns({"part": F.shiftright("_id", 33).cast("int"), "at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def with_offsets(df: DataFrame, length: str, *order: str) -> DataFrame:
    """df with ``offset``: the sum of ``length`` over all rows before, by ranges and then inside each."""
    rows = placed(df, *order)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = rows.groupBy("part").agg(F.sum(length).alias("own")).select("part", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum(length).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(F.broadcast(starts), "part").withColumn("offset", F.col("start") + F.col("inside")).drop("part", "at", "start", "inside")


def islands(df: DataFrame, keys: list[str], by: str, broken) -> DataFrame:
    """df with ``run``, a number of the island of consecutive values of ``by`` (one row each) of its keys; a row where
    ``broken`` holds starts one.

    Rows are cut into ranges of (keys, by) and islands are found inside each, so that no task holds a key, however
    frequent. What a range's first island continues is read off a table with a row a range.
    """
    rows = placed(df.withColumn("_broken", broken), *keys, by)
    own = Window.partitionBy("part", *keys).orderBy(by)
    begins = F.coalesce((F.col(by) != F.lag(by).over(own) + 1) | F.col("_broken"), F.lit(True))
    rows = rows.withColumn("_starts", begins)
    edge = F.struct("at", *keys, by, "_broken")
    ends = rows.groupBy("part").agg(F.min(edge).alias("low"), F.max(edge).alias("high"), F.max(F.when(F.col("_starts") & (F.col("at") > 0), F.col("at"))).alias("last"))
    inorder = Window.orderBy("part")  # a row a range
    before = F.lag("high").over(inorder)
    same = [F.col(f"low.{k}").eqNullSafe(F.col(f"before.{k}")) for k in keys]
    follows = reduce(lambda x, y: x & y, same, (F.col(f"low.{by}") == F.col(f"before.{by}") + 1) & ~F.col("low._broken"))
    ends = ends.withColumn("before", before).withColumn("follows", F.coalesce(follows, F.lit(False)))
    # The last start of a range: inside it, or its first row unless that continues an island.
    start = F.when(F.col("last").isNotNull(), F.struct("part", F.col("last").alias("at"))).when(~F.col("follows"), F.struct("part", F.lit(0).cast("long").alias("at")))
    root = F.last(F.when(start.isNotNull(), start), ignorenulls=True).over(inorder.rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.withColumn("root", root).where("follows").select("part", F.col("root.part").alias("_part"), F.col("root.at").alias("_at"))
    number = lambda part, at: F.shiftleft(F.col(part).cast("long"), 33) + F.col(at)
    mark = F.last(F.when(F.col("_starts"), F.col("at")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("_mark", mark).join(F.broadcast(carried), "part", "left")
    run = F.when((F.col("_mark") == 0) & F.col("_part").isNotNull(), number("_part", "_at")).otherwise(number("part", "_mark"))
    return found.withColumn("run", run).drop("part", "at", "_broken", "_starts", "_mark", "_part", "_at")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """text_id, node, component (its smallest node) of every node of edges (text_id, a, b).

    Every round each label becomes the smallest among the node and its neighbours, then the
    label's own label (so paths halve); rounds end when nothing changes.
    """
    both = kept(edges.select("text_id", "a", "b").union(edges.select("text_id", "b", "a")).distinct(), "edges")
    first = both.groupBy("text_id", "a").agg(F.min("b").alias("low"))
    labels = held = kept(first.select("text_id", F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), ["text_id", "b"]).groupBy("text_id", F.col("a").alias("node")).agg(F.min("component").alias("low"))
        step = labels.join(near, ["text_id", "node"]).select("text_id", "node", F.col("component").alias("was"), F.least("component", "low").alias("to"))
        far = labels.select("text_id", F.col("node").alias("to"), F.col("component").alias("further"))
        after = kept(step.join(far, ["text_id", "to"]).select("text_id", "node", "was", F.least("to", "further").alias("component")), "labels")
        settled = after.where("component <> was").isEmpty()
        released(held)
        labels, held = after.select("text_id", "node", "component"), after
        if settled:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")

"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Each source has a weight schedule over training time t in [0, 1],

    w_s(t) = target_s * (1 + slope_s * (2 t - 1)),   |slope_s| <= 1,

whose integral, the cumulative token demand, is D_s(t) = target_s * (t + slope_s * (t^2 - t)),
so D_s(1) = target_s. A source's documents queue in a fixed pseudo-random order (MD5 of the
id); the words before a document in that queue are its cumulative offset u, and the inverse
D_s^-1(u) is the training position at which it is due. A source that repeats takes its queue
again from the start (epoch 1, 2, ...). The stream is range-sorted by position.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, of all words; a
target stops at ``max_repeat`` times its source's size and the excess is shared again by
weight. That repeated resharing ends at target = min(cap, weight * level) for one level,
which is found by sorting the sources by cap / weight; only per-source rows meet there.

Cumulative offsets are summed in two levels: a source's queue is cut into buckets by the leading
bits of its order key, as many as the table needs for about ``part`` rows each, bucket totals are
summed over buckets, and rows are summed inside a bucket, so a source with a third of all rows
is never one task's work. Rows without a doc_id have their text's MD5 as key. Rows that are alike (source, id,
size, text) are one row of that sum, in SALTS parts, so that many copies are not one task's work either.

Defined results: an empty table gives no rows; a null text has size 0 and is never taken;
ids may repeat or be null; with no words at all, every
target is 0. Repeated rows are queued one after another; rows are queued by key, doc_id, size and
text, so that the order of the input changes nothing. Extra columns are ignored by the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import packed_row, word_count

WEIGHTS = (5, 2, 1)
#: Schedule slopes beside the weights: heavy sources lead, light ones come late.
SLOPES = (-0.5, 0.0, 0.5)


def targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_repeat: int = 3) -> DataFrame:
    """sizes: source, source_size, one row per source. Adds weight, slope and target."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(ordered) - 1) % len(weights)
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (place + 1).cast("int"))
    table = sizes.select("source", "source_size", pick(weights, "double").alias("weight"), pick(slopes, "double").alias("slope"))
    cap = (F.col("source_size") * max_repeat).cast("double")
    by_fill = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = table.withColumns(
        {
            "total": F.sum("source_size").over(Window.partitionBy()),
            "capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_repeat,
            "open": F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    # The first source whose cap lies above the level of those still open fixes the level for all after it.
    fixed = F.min(F.when(cap > F.col("weight") * F.col("level"), F.struct(cap / F.col("weight"), "source", "level"))).over(Window.partitionBy())["level"]
    return level.withColumn("fixed", fixed).select(
        "source", "source_size", "weight", "slope", F.coalesce(F.least(cap, F.col("weight") * F.col("fixed")), cap, F.lit(0.0)).alias("target")
    )


#: Places over which equal rows (of one source, id, size and text) are dealt.
SALTS = 64


def _rows(docs: DataFrame, text: str) -> DataFrame:
    """docs packed as ``row``, with a number and a hash of each row, doc_id, source and size. The number holds as long as the table is
    read in one order; ``stream`` compares the hash."""
    mark = F.xxhash64("doc_id", "source", text, F.col(text).isNull())
    return docs.select(packed_row(docs), F.monotonically_increasing_id().alias("id"), mark.alias("mark"), "doc_id", "source", F.col(text).alias("text"), word_count(text).alias("size"))


def plan(docs: DataFrame, text: str = "text", weights=WEIGHTS, slopes=SLOPES, max_repeat: int = 3, part: int = 50_000, whole_documents: bool = False) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words), position (of its first use), last_position; and its
    row's number and hash, offset and slope.

    The last document that a source still needs is taken in part; with whole_documents it is
    taken whole if at least half of it is needed and otherwise not. Positions are null where nothing is taken.
    """
    bits = max(10, (docs.count() // part).bit_length())
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    sized = _rows(docs, text).select("id", "mark", "doc_id", "source", "size", key.alias("key"), (F.col("id") % SALTS).cast("int").alias("salt"))
    sized = sized.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - min(bits, 32)))
    # Rows that are alike in all of this may take any of their group's places; a group has SALTS rows at most.
    alike = ["source", "bucket", "key", "doc_id", "size", "mark", "salt"]
    groups = sized.groupBy(*alike).agg(F.count("*").alias("n"))
    parts = groups.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    sums = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, slopes, max_repeat)
    queue = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("ahead", F.coalesce(F.sum("words").over(queue), F.lit(0)))
    starts = starts.join(sums, starts.source.eqNullSafe(sums.source)).select(starts.source, "bucket", "ahead", "source_size", "target", "slope")
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "mark", "salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    placed = groups.join(starts, groups.source.eqNullSafe(starts.source) & (groups.bucket == starts.bucket)).select(
        *[groups[c] for c in alike], "source_size", "target", "slope", (F.col("ahead") + F.col("within")).alias("offset")
    )
    rows = sized.withColumn("copy", F.row_number().over(Window.partitionBy(*alike).orderBy("id")) - 1)
    same = [rows[c].eqNullSafe(placed[c]) for c in alike]
    joined = rows.join(placed, reduce(lambda x, y: x & y, same)).select(
        "id", rows.mark, rows.doc_id, rows.source, rows["size"], "source_size", "target", "slope", (F.col("offset") + F.col("copy") * rows["size"]).alias("offset")
    )
    want = F.floor(F.col("target") + F.lit(0.5))
    full = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), want - full * F.col("source_size") - F.col("offset")))
    if whole_documents:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(0)
    taken = F.least(full * F.col("size") + part, F.col("size") * max_repeat).cast("long")
    at = lambda offset: position(offset, F.col("target"), F.col("slope"))
    return joined.withColumn("taken", taken).select(
        "id", "mark", "doc_id", "source", "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, at(F.col("offset"))).alias("position"),
        F.when(F.col("taken") > 0, at(F.col("offset") + (F.ceil(F.col("taken") / F.col("size")) - 1) * F.col("source_size"))).alias("last_position"), "offset", "slope",
    )


def position(offset: Column, target: Column, slope: Column) -> Column:
    """t with target * (t + slope * (t^2 - t)) = offset: the inverse of the cumulative demand, at most 1."""
    u = F.when(target > 0, F.least(offset / target, F.lit(1.0))).otherwise(F.lit(1.0))
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u)
    # The quadratic's stable form; it is u itself where the slope is 0.
    return 2 * u / ((1 - slope) + root)


def stream(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixed corpus: every use of a document as a row with its columns, range-sorted by training position.

    Rows find their decisions by their numbers, so equal or absent doc_ids are documents of their own. A table whose rows
    come in another order each time it is read is an error; write it first.
    """
    planned = plan(docs, text, whole_documents=True, **options)
    uses = F.when(F.col("taken") > 0, F.sequence(F.lit(0), (F.col("taken") / F.col("size")).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    decisions = planned.select("id", F.col("mark").alias("planned"), F.transform(uses, lambda e: position(F.col("offset") + e * F.col("source_size"), F.col("target"), F.col("slope"))).alias("positions"))
    rows = _rows(docs, text).select("row", "id", "mark", "doc_id")
    moved = F.when(F.col("mark") == F.col("planned"), F.col("positions")).otherwise(F.raise_error(F.lit("the rows moved between two reads")).cast("array<double>"))
    mixed = rows.join(decisions, "id", "left").select("row", "doc_id", "mark", F.explode(moved).alias("position"))
    return mixed.repartitionByRange("position", "doc_id", "mark").sortWithinPartitions("position", "doc_id", "mark").select("row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
         CAST([-0.5, 0.0, 0.5][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS slope
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sources
  WINDOW before AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fixed AS (
  SELECT arg_min(level, 3.0 * source_size / weight) AS level FROM levels WHERE 3 * source_size > weight * level
), targets AS (
  SELECT source, source_size, slope, least(CAST(3 * source_size AS DOUBLE), weight * fixed.level) AS target FROM sources, fixed
), queued AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.slope, CAST(floor(t.target + 0.5) AS BIGINT) AS want,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY key, s.doc_id
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), used AS (
  SELECT *, CAST(want // source_size * size + greatest(0, least(size, want % source_size - ahead)) AS BIGINT) AS taken FROM queued
), due AS (
  SELECT *, least(ahead / target, 1.0) AS u, least((ahead + (ceil(taken / size) - 1) * source_size) / target, 1.0) AS v FROM used
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(2 * u / (1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)), 6) END AS position,
       CASE WHEN taken > 0 THEN round(2 * v / (1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * v)), 6) END AS last_position
FROM due
"""


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"), F.round("last_position", 6).alias("last_position")
    )

"""A packed index on disk, in buckets: a look-up reads the buckets of its names and of the blocks that these point to.

Folders: ``entries`` (text_id, name, start, pb, entry) in buckets of the name, ``blocks`` (cell, text_id, block, pb,
c_bytes) in buckets of the cell, a hash of (text_id, block). Both are plain Parquet of Spark's bucketed form, sorted
by that column; a session that loads the index registers them as tables of its catalogue, over the same files.

Up to FEW names (or cells) are fetched and given to the scan as values, so that Spark picks buckets before it reads,
and row groups by their least and largest values. More of them are joined; the bucketed side is then not shuffled.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shape import Shape
from ..operators import index
from .index import GappedIndex

#: Values that a scan is given at most; rows of a bucket on average; buckets at most.
FEW, ROWS, MOST = 10_000, 100_000, 8192


#: Columns of the tables, by the column that they are dealt by.
TYPES = {"name": {"text_id": "bigint", "name": "bigint", "start": "bigint", "pb": "int", "entry": "binary"}, "cell": {"cell": "bigint", "text_id": "bigint", "block": "int", "pb": "int", "c_bytes": "binary"}}


def _cell():
    return F.xxhash64("text_id", "block").alias("cell")


def _write(table: DataFrame, path: str, column: str, buckets: int) -> None:
    name = f"packed_{uuid.uuid4().hex}"
    spread = table.select(*[F.col(c).cast(kind) for c, kind in TYPES[column].items()]).repartition(buckets, column)  # by the hash that buckets go by: a file a bucket
    spread.write.bucketBy(buckets, column).sortBy(column).format("parquet").option("path", path).option("parquet.block.size", 1 << 20).saveAsTable(name)
    table.sparkSession.sql(f"DROP TABLE {name}")  # the catalogue's entry; the files stay


def _register(spark: SparkSession, path: str, column: str, buckets: int) -> DataFrame:
    name = f"packed_{uuid.uuid4().hex}"
    columns = ", ".join(f"{c} {kind}" for c, kind in TYPES[column].items())
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({column}) SORTED BY ({column}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def save(built: GappedIndex, path: str, buckets: int | None = None) -> None:
    """The packed form of an index below path. buckets: as many for either table, or by their rows."""
    heads, entries = built.serialized()
    spark = heads.sparkSession
    wide = entries.join(heads.where("block = 0").select("text_id", "pb"), "text_id").select("text_id", "name", "start", "pb", "entry")
    blocks = heads.select(_cell(), "text_id", "block", "pb", "c_bytes")
    n = [buckets or min(MOST, max(1, -(-wide.count() // ROWS))), buckets or min(MOST, max(1, -(-blocks.count() * index.BLOCK // ROWS)))]
    _write(wide, f"{path}/entries", "name", n[0])
    _write(blocks, f"{path}/blocks", "cell", n[1])
    meta = spark.createDataFrame([(built.shape.pattern, index.BLOCK, *n)], "pattern string, block int, entry_buckets int, block_buckets int")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def _some(table: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of the table with a value of ``wanted``, which has that column, each once."""
    few = [r[0] for r in wanted.limit(FEW + 1).collect()]
    return table.where(F.col(column).isin(few)) if len(few) <= FEW else table.join(wanted, column, "left_semi")


@dataclass
class PackedIndex:
    shape: Shape
    entries: DataFrame
    blocks: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PackedIndex:
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta.block != index.BLOCK:
            raise ValueError(f"the index has blocks of {meta.block} positions, not of {index.BLOCK}")
        return cls(Shape(meta.pattern), _register(spark, f"{path}/entries", "name", meta.entry_buckets), _register(spark, f"{path}/blocks", "cell", meta.block_buckets))

    def positions_of(self, names: DataFrame) -> DataFrame:
        """text_id, name, pos for a table with a column ``name``; names without positions have no rows, null is no name."""
        found = _some(self.entries, "name", names.select("name").where("name IS NOT NULL").distinct())
        ranges = index.block_ranges(index.fields(found), self.shape.span).withColumn("cell", _cell())
        blocks = _some(self.blocks, "cell", ranges.select("cell").distinct())
        return index.from_blocks(ranges.drop("cell"), blocks)

    def locate(self, queries: DataFrame) -> DataFrame:
        """query_id, text_id, pos: distinct positions of all whole windows of queries (query_id, query)."""
        windows = index.windows(queries, self.shape).select("query_id", "name").distinct()
        return windows.join(self.positions_of(windows), "name").select("query_id", "text_id", "pos")

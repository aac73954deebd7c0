"""Column expressions and table helpers that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_folder

#: The white space of the contracts, space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none: a temporary one in local mode, else an error,
    since executors on other machines would not see it."""
    return shared_folder(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A value is hot if it belongs to more than 1 / HOT of all rows; there are fewer than HOT such values.
HOT = 4096


def hot_values(rows: DataFrame, column: str) -> DataFrame:
    """column, hot (true) of the hot values: fewer than HOT rows whatever the table, so that they can be broadcast."""
    most = rows.count() // HOT
    return written(rows.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(column, F.lit(True).alias("hot")), "hot")


def salted_join(rows: DataFrame, groups: DataFrame, columns: list[str], hot: DataFrame, salts: int = 64) -> DataFrame:
    """Inner equi-join of a table with one that has a row per group; rows whose first column is hot are dealt over ``salts`` places."""
    marked = lambda df: df.join(F.broadcast(hot), columns[0], "left")
    places = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    own = F.when(F.col("hot"), (F.monotonically_increasing_id() % salts).cast("int")).otherwise(0)
    return marked(rows).withColumn("_salt", own).drop("hot").join(marked(groups).withColumn("_salt", F.explode(places)).drop("hot"), [*columns, "_salt"]).drop("_salt")


def packed_row(docs: DataFrame) -> Column:
    """All columns of a row as one, ``row``, so that none of them can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def row_mark(docs: DataFrame) -> Column:
    """A hash of the whole row; maps and variants, which Spark does not hash, count as JSON."""
    known = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return F.xxhash64(*known, *[c.isNull() for c in known])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(name: str = "text") -> Column:
    """Number of words; null counts as no words."""
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

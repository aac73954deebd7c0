"""The index of a text collection: build once, then look up names, queries and reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packed import breakeven_coverage, estimated_width
from ..functions.shape import Shape, spelling
from ..operators import index, kernels, links, selection, suffixes
from ..operators.tables import kept


def diff_problem(texts: DataFrame, shape: str, max_add: int = 8, min_coverage: int = 3, universe: str = "full", intra: bool = True, large: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The selection problem itself: ranked suffixes, intervals and candidate links of a universe. large: for texts that no task can hold."""
    if universe not in links.UNIVERSES:
        raise ValueError(f"unknown universe {universe!r}")
    parsed = Shape(shape)
    ranked = kept((suffixes.gsa_by_doubling if large else suffixes.gsa)(texts, parsed), "gsa")
    intervals = kept(suffixes.intervals(ranked), "intervals")
    if universe == "legacy":
        return ranked, intervals, links.candidates(ranked, intervals, parsed.span, max_add, min_coverage, intra)
    return ranked, intervals, links.all_links(ranked, intervals, parsed.span, max_add, min_coverage, sub_runs=universe == "full")


#: The tables of an index, in the order of its fields.
TABLES = ("texts", "ranked", "intervals", "chosen", "ranks", "c_array", "h_table")


@dataclass
class GappedIndex:
    shape: Shape
    texts: DataFrame
    ranked: DataFrame
    intervals: DataFrame
    chosen: DataFrame
    ranks: DataFrame
    c_array: DataFrame
    h_table: DataFrame

    @classmethod
    def build(cls, texts: DataFrame, shape: str, algo: str = "greedy", max_add: int = 8, min_coverage: int | str = 3, universe: str = "legacy", intra: bool = True, keep: int | None = None, large: bool = False, **options) -> GappedIndex:
        """texts: text_id, dna. Other options go to the algorithm (generations, cluster, nodes, ...).

        keep: at most so many candidates a name, the best ones. large: for texts or components that no task can hold; suffixes
        are sorted and links selected (greedily) by range sorts and joins alone.

        min_coverage "auto" takes the break-even of the longest text's position width.
        """
        parsed = Shape(shape)
        if min_coverage == "auto":
            longest = texts.agg(F.max(F.length("dna")).alias("n"))
            min_coverage = longest.select(breakeven_coverage(estimated_width(F.coalesce("n", F.lit(0))), max_add)).first()[0]
        if large and kernels.algorithm(algo) != "greedy":
            raise ValueError("large texts are indexed greedily")
        ranked, intervals, found = diff_problem(texts, shape, max_add, min_coverage, universe, intra, large)
        if keep is not None:
            found = links.preferred(found, keep).drop("place")
        if large:
            chosen = selection.greedy_rounds(found, ranked, intervals).withColumn("whole", F.lit(True))
        else:
            chosen = kept(selection.select(found, ranked, intervals, algo, min_coverage, **options), "chosen")
        return cls.of_links(texts, parsed, ranked, intervals, chosen)

    @classmethod
    def of_links(cls, texts: DataFrame, shape: Shape, ranked: DataFrame, intervals: DataFrame, chosen: DataFrame) -> GappedIndex:
        """The index of given links; an error if they cannot stand together."""
        if not (bad := selection.infeasible(chosen)).isEmpty():
            raise ValueError(f"links are not feasible together: {bad.first().why}")
        ranks, c_array, h_table = index.compress(ranked, intervals, chosen)
        return cls(shape, texts, ranked, intervals, chosen, kept(ranks, "ranks"), kept(c_array, "c"), kept(h_table, "h"))

    def save(self, path: str) -> None:
        """The tables of the index below path, and its shape."""
        spark = self.texts.sparkSession
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(self.shape.pattern,)], "pattern string").write.mode("overwrite").parquet(f"{path}/shape")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GappedIndex:
        shape = Shape(spark.read.parquet(f"{path}/shape").first().pattern)
        return cls(shape, *[spark.read.parquet(f"{path}/{name}") for name in TABLES])

    def windows(self, queries: DataFrame) -> DataFrame:
        """query_id, window, name, text_id, pos: every whole window of each query with its positions."""
        return self.hits(queries)

    def positions_of(self, names: DataFrame) -> DataFrame:
        """text_id, name, pos for a table of names."""
        return index.positions(self.h_table.join(names.select("name").distinct(), "name"), self.c_array, self.shape.span, ["text_id", "name"])

    def decoded(self) -> DataFrame:
        """All positions of all names."""
        return index.positions(self.h_table, self.c_array, self.shape.span, ["text_id", "name"])

    def hits(self, queries: DataFrame) -> DataFrame:
        """queries (query_id, query): query_id, window, name, text_id, pos."""
        found = self.h_table.join(index.windows(queries, self.shape), "name")
        return index.positions(found, self.c_array, self.shape.span, ["query_id", "window", "name", "text_id"])

    def locate(self, queries: DataFrame) -> DataFrame:
        """query_id, text_id, pos: distinct positions of all windows, not shifted back to the query's start.

        A position has one name, so a query's distinct names have distinct positions.
        """
        names = self.h_table.select("name").distinct()
        probes = kept(index.windows(queries, self.shape).select("query_id", "name").join(names, "name", "left_semi").distinct(), "probes")
        # A name's positions are decoded once, not once for each query that has it.
        listed = kept(self.positions_of(probes), "listed")
        return probes.join(listed, "name").select("query_id", "text_id", "pos")

    def stats(self) -> DataFrame:
        """text_id, m, names, c_count."""
        n = self.ranks.groupBy("text_id").agg(F.count("*").alias("m"), F.countDistinct("name").alias("names"), F.sum(F.col("kept").cast("long")).alias("c_count"))
        return n

    def serialized(self) -> tuple[DataFrame, DataFrame]:
        return index.serialize(self.c_array, self.h_table)

    def sizes(self) -> DataFrame:
        return index.sizes(*self.serialized(), self.texts)

    def differences(self) -> DataFrame:
        """Where the decoded positions are not the true ones: empty."""
        return index.differences(suffixes.postings(self.texts, self.shape), self.decoded())

    def table(self) -> DataFrame:
        """The gapped suffix array with spellings and compression marks."""
        extra = self.ranked.select("text_id", "rank", "lexpos", "lcp")
        return self.ranks.join(extra, ["text_id", "rank"]).withColumn("spelling", spelling(F.col("name"), self.shape))

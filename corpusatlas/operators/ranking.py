"""Ranks, first occurrences, duplicate flags and islands, without windows over whole tables where counts do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusatlas.storage import keep


def competition_rank(df: DataFrame, score: str, name: str = "rank") -> DataFrame:
    """1 + the rows with a greater score. Distinct scores are dealt by range; a window runs within each range, another over
    one row a range."""
    tally = df.groupBy(score).agg(F.count("*").alias("__n"))
    dealt = keep(tally.repartitionByRange(F.desc(score)).withColumn("__p", F.spark_partition_id()), "ranks")
    sums = dealt.groupBy("__p").agg(F.sum("__n").alias("__s"))
    before = sums.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__b"))
    above = F.sum("__n").over(Window.partitionBy("__p").orderBy(F.desc(score))) - F.col("__n")
    ranks = dealt.withColumn("__a", above).join(before, "__p").select(F.col(score).alias("__score"), (F.col("__b") + F.col("__a") + 1).alias(name))
    return df.join(ranks, F.col(score).eqNullSafe(F.col("__score"))).drop("__score")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def top_by(df: DataFrame, keys: list[str], n: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first n rows of each key with their place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def flag_repeated(df: DataFrame, keys: list[str], name: str = "repeated") -> DataFrame:
    """Whether a row's key occurs more than once; null and empty keys never do. Counts are aggregated before the join."""
    seen = df.filter(" AND ".join(f"coalesce(CAST(`{k}` AS STRING), '') <> ''" for k in keys)).groupBy(*keys).count().filter("count > 1").select(*keys, F.lit(True).alias(name))
    return df.join(seen, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def dense_labels(df: DataFrame, label: str, order: str, name: str = "cluster") -> DataFrame:
    """Labels renumbered from 1 by first appearance. The window runs over the labels only."""
    first = df.groupBy(label).agg(F.min(order).alias("__o"))
    ids = first.select(label, F.row_number().over(Window.orderBy("__o")).alias(name))
    return df.join(F.broadcast(ids), label)


def islands(df: DataFrame, order: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Contiguous runs of equal values: run id, first, last, length. For parameter sweeps, not corpora."""
    k = keys or []
    a, b = Window.partitionBy(*k).orderBy(order), Window.partitionBy(*k, value).orderBy(order)
    runs = df.withColumn("__g", F.row_number().over(a) - F.row_number().over(b))
    return runs.groupBy(*k, value, "__g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("__g")


def gap_to_next(df: DataFrame, keys: list[str], score: str, *ties: Column, name: str = "gap") -> DataFrame:
    """The best row of each key with its lead over the runner-up (1 without one)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    ranked = df.withColumns({"__r": F.row_number().over(w), name: F.coalesce(F.col(score) - F.lead(score).over(w), F.lit(1.0))})
    return ranked.filter("__r = 1").drop("__r")

"""Publication age: periods, dense cluster-by-period grids, shares, changes and sensitivity.

Everything first sums rows to (cluster, year) counts, so period lookups and grids work on tables whose size depends on the
numbers of clusters and years, not on the papers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusatlas import contracts


def periods_table(spark: SparkSession, periods: list[tuple[str, int, int]]) -> DataFrame:
    """(period, start_year, end_year), both ends included."""
    return spark.createDataFrame([(p, a, b) for p, a, b in periods], "period string, start_year int, end_year int")


def valid_years(papers: DataFrame, year: str, minimum: int, reference: int) -> DataFrame:
    """Years are whole numbers within [minimum, reference]."""
    y = F.col(year)
    return contracts.holds(papers, y.isNotNull() & (y == F.floor(y)) & y.between(minimum, reference), f"bad {year}", year)


def with_period(papers: DataFrame, periods: DataFrame, year: str = "year") -> DataFrame:
    """Range join; every year must lie in exactly one period. The lookup is by distinct year, so it is small."""
    years = papers.select(year).distinct().join(F.broadcast(periods), F.col(year).between(F.col("start_year"), F.col("end_year")), "left")
    contracts.holds(years.groupBy(year).agg(F.count("period").alias("n")), F.col("n") == 1, "a year in no period or in several", year)
    return papers.join(F.broadcast(years), year, "left")


def counts_by_year(papers: DataFrame) -> DataFrame:
    """papers (cluster, year, assigned) summed to (cluster, year, assigned, n)."""
    return papers.groupBy("cluster", "year", "assigned").agg(F.count("*").alias("n"))


def period_shares(papers: DataFrame, periods: DataFrame) -> DataFrame:
    """Dense cluster x period grid: papers, the period's assigned, unassigned and all papers, and the share of the
    assigned ones in percent (null for a period without any)."""
    counts = with_period(counts_by_year(papers), periods)
    return _grid(counts, periods.select("period", "start_year", "end_year"), "period")


def annual_shares(papers: DataFrame, last_year: int) -> DataFrame:
    """The same by year, from the first year on."""
    counts = counts_by_year(papers)
    years = counts.agg(F.min("year").alias("a")).select(F.explode(F.sequence(F.col("a").cast("int"), F.lit(last_year))).alias("year"))
    return _grid(counts.withColumn("year", F.col("year").cast("int")), years, "year")


def _grid(counts: DataFrame, bins: DataFrame, key: str) -> DataFrame:
    clusters = counts.filter("assigned").select("cluster").distinct()
    n = counts.filter("assigned").groupBy("cluster", key).agg(F.sum("n").alias("papers"))
    of = counts.groupBy(key).agg(F.sum(F.when(F.col("assigned"), F.col("n")).otherwise(0)).alias("period_assigned_papers"), F.sum("n").alias("period_all_papers"))
    # clusters x bins is the report itself
    grid = clusters.crossJoin(F.broadcast(bins)).join(n, ["cluster", key], "left").join(F.broadcast(of), key, "left").na.fill(0, ["papers", "period_assigned_papers", "period_all_papers"])
    return grid.withColumn("period_unassigned_papers", F.col("period_all_papers") - F.col("period_assigned_papers")).withColumn("share_pct", F.when(F.col("period_assigned_papers") > 0, 100.0 * F.col("papers") / F.col("period_assigned_papers")))


def share_by_cluster(papers: DataFrame, periods: DataFrame) -> DataFrame:
    """Dense grid of assigned papers with the share of the cluster's total."""
    grid = period_shares(papers, periods)
    total = F.sum("papers").over(Window.partitionBy("cluster"))
    return grid.select("cluster", "period", "papers", total.alias("cluster_papers"), F.when(total > 0, 100.0 * F.col("papers") / total).alias("share_pct"))


def share_matrix(papers: DataFrame, periods: DataFrame, labels: list[str]) -> DataFrame:
    """Shares pivoted to one column per period, in the given order."""
    return share_by_cluster(papers, periods).groupBy("cluster").pivot("period", labels).agg(F.first("share_pct"))


def cluster_summary(papers: DataFrame, reference: int, small: int = 10) -> DataFrame:
    """Sizes, years and ages of assigned papers per cluster. Quantiles are exact and linear, over (year, count) pairs."""
    y = papers.filter("assigned").groupBy("cluster", "year").agg(F.count("*").alias("n"))
    age = F.lit(reference) - F.col("year")

    def quantile(c: Column, q: float) -> Column:
        return F.call_function("percentile", c.cast("double"), F.lit(q), F.col("n"))

    known = F.when(F.col("year").isNotNull(), F.col("n"))
    out = y.groupBy("cluster").agg(
        F.sum("n").alias("papers"),
        F.sum(known).alias("dated"),
        quantile(F.col("year"), 0.5).alias("median_year"),
        (F.sum(F.col("year") * F.col("n")) / F.sum(known)).alias("mean_year"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
        quantile(age, 0.5).alias("median_age"),
        (F.sum(age * F.col("n")) / F.sum(known)).alias("mean_age"),
        quantile(age, 0.25).alias("q25_age"),
        quantile(age, 0.75).alias("q75_age"),
        F.min(age).alias("min_age"),
        F.max(age).alias("max_age"),
    )
    return out.withColumn("small_cluster", F.col("papers") < small)


def period_changes(shares: DataFrame, early: str, late: str) -> DataFrame:
    """Percentage points from the early to the late period per cluster."""
    at = lambda p: F.max(F.when(F.col("period") == p, F.col("share_pct")))
    return shares.groupBy("cluster").agg(at(early).alias("early_pct"), at(late).alias("late_pct")).withColumn("change_pp", F.col("late_pct") - F.col("early_pct"))


def year_sensitivity(papers: DataFrame, periods: DataFrame, early: str, late: str) -> DataFrame:
    """period_changes by `year` and by `alternative_year`, and whether the signs agree (null where undefined)."""
    a = period_changes(period_shares(papers, periods), early, late).select("cluster", F.col("change_pp").alias("primary_pp"))
    b = period_changes(period_shares(papers.withColumn("year", F.col("alternative_year")), periods), early, late).select("cluster", F.col("change_pp").alias("alternative_pp"))
    return a.join(b, "cluster", "full").withColumn("same_sign", F.signum("primary_pp") == F.signum("alternative_pp"))


def coverage(papers: DataFrame) -> DataFrame:
    """One row: papers, assigned ones, clusters, authors, and papers whose alternative year differs."""
    return papers.agg(F.count("*").alias("papers"), F.count_if(F.col("assigned")).alias("assigned"), F.count_if(~F.col("assigned")).alias("unassigned"), F.count_distinct(F.when(F.col("assigned"), F.col("cluster"))).alias("clusters"), F.count_distinct("author").alias("authors"), F.count_if(F.col("alternative_year") != F.col("year")).alias("differing_years"))


def load_paper_ages(memberships: DataFrame, metadata: DataFrame, reference: int, minimum: int = 1800) -> DataFrame:
    """memberships (paper_id, cluster, assigned) x metadata (paper_id, year, alternative_year): ages. The join must keep
    rows one to one, and years must be valid."""
    out = contracts.lookup_join(memberships, metadata, "paper_id")
    valid_years(out, "year", minimum, reference)
    return out.withColumns({"age": F.lit(reference) - F.col("year"), "year_difference": F.col("alternative_year") - F.col("year")})


def union_memberships(*frames: DataFrame) -> DataFrame:
    """Memberships of several corpora by column name; a paper that several hold must have one year."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    contracts.holds(out.groupBy("paper_id").agg(F.count_distinct("year").alias("n")), F.col("n") <= 1, "years disagree", "paper_id")
    return out

"""Publication-age queries: an order is a paper, its priority the cluster, its date the publication date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.operators import ages
from corpusatlas.session import table

PERIODS = [("<=1995", 1900, 1995), ("1996-1997", 1996, 1997), ("1998-1999", 1998, 1999), ("2000-2001", 2000, 2001)]
REFERENCE = 2001


def papers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("cluster"), F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") != "P").alias("assigned"), F.col("o_custkey").alias("author"))


def with_alternative(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.year(F.min("l_shipdate")).alias("shipped"))
    return papers(spark, d).join(first, "paper_id", "left").withColumn("alternative_year", F.coalesce("shipped", "year"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def whole(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def ages_period_shares(spark: SparkSession, d: str) -> DataFrame:
    out = ages.period_shares(papers(spark, d), ages.periods_table(spark, PERIODS))
    return rounded(whole(out, "start_year", "end_year"), "share_pct")


def ages_annual_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whole(ages.annual_shares(papers(spark, d), REFERENCE), "year"), "share_pct")


def ages_cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    out = ages.cluster_summary(papers(spark, d), REFERENCE)
    return rounded(whole(out, "min_year", "max_year", "min_age", "max_age"), "median_year", "mean_year", "median_age", "mean_age", "q25_age", "q75_age")


def ages_period_changes(spark: SparkSession, d: str) -> DataFrame:
    shares = ages.period_shares(papers(spark, d), ages.periods_table(spark, PERIODS))
    return rounded(ages.period_changes(shares, PERIODS[0][0], PERIODS[-1][0]), "early_pct", "late_pct", "change_pp")


def ages_share_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ages.share_by_cluster(papers(spark, d), ages.periods_table(spark, PERIODS)), "share_pct")


def ages_share_matrix(spark: SparkSession, d: str) -> DataFrame:
    labels = [p for p, _, _ in PERIODS]
    out = ages.share_matrix(papers(spark, d), ages.periods_table(spark, PERIODS), labels)
    return rounded(out.toDF("cluster", "p1", "p2", "p3", "p4"), "p1", "p2", "p3", "p4")


def ages_year_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    wide = [*PERIODS[:-1], ("2000-2001", 2000, 2003)]
    out = ages.year_sensitivity(with_alternative(spark, d), ages.periods_table(spark, wide), wide[0][0], wide[-1][0])
    return rounded(out, "primary_pp", "alternative_pp")


def ages_coverage(spark: SparkSession, d: str) -> DataFrame:
    return ages.coverage(with_alternative(spark, d))


def ages_paper_ages(spark: SparkSession, d: str) -> DataFrame:
    p = with_alternative(spark, d)
    out = ages.load_paper_ages(p.select("paper_id", "cluster", "assigned"), p.select("paper_id", "year", "alternative_year"), REFERENCE)
    return whole(out, "year", "alternative_year", "age", "year_difference")


QUERIES = {f.__name__: f for f in (ages_period_shares, ages_annual_shares, ages_cluster_summary, ages_period_changes, ages_share_by_cluster, ages_share_matrix, ages_year_sensitivity, ages_coverage, ages_paper_ages)}

_P = "p AS (SELECT o_orderkey AS paper_id, o_orderpriority AS cluster, year(o_orderdate) AS year, o_orderstatus <> 'P' AS assigned, o_custkey AS author FROM orders)"
_B = "b AS (SELECT * FROM (VALUES ('<=1995', 1900, 1995), ('1996-1997', 1996, 1997), ('1998-1999', 1998, 1999), ('2000-2001', 2000, 2001)) AS t(period, start_year, end_year))"
_G = f"""{_P}, {_B}, c AS (SELECT DISTINCT cluster FROM p WHERE assigned),
n AS (SELECT cluster, period, count(*) AS papers FROM p JOIN b ON year BETWEEN start_year AND end_year WHERE assigned GROUP BY ALL),
o AS (SELECT period, count(*) FILTER (assigned) AS a, count(*) AS t FROM p JOIN b ON year BETWEEN start_year AND end_year GROUP BY ALL),
g AS (SELECT c.cluster, b.period, start_year::BIGINT AS start_year, end_year::BIGINT AS end_year, coalesce(papers, 0) AS papers, coalesce(a, 0) AS period_assigned_papers,
  coalesce(t, 0) AS period_all_papers, coalesce(t, 0) - coalesce(a, 0) AS period_unassigned_papers, CASE WHEN a > 0 THEN 100.0 * coalesce(papers, 0) / a END AS share_pct
  FROM c CROSS JOIN b LEFT JOIN n ON n.cluster = c.cluster AND n.period = b.period LEFT JOIN o ON o.period = b.period)"""
_S = """s AS (SELECT cluster, period, papers, sum(papers) OVER (PARTITION BY cluster)::BIGINT AS cluster_papers FROM g)"""
_A = "a AS (SELECT p.*, coalesce(year(s), p.year) AS alternative_year FROM p LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey = paper_id)"


def _changes(year: str, name: str) -> str:
    return f"""{name} AS (SELECT cluster, max(100.0 * late / ln) - max(100.0 * early / en) AS pp FROM (SELECT cluster, count(*) FILTER ({year} <= 1995) AS early, count(*) FILTER ({year} >= 2000) AS late FROM a WHERE assigned GROUP BY 1),
 (SELECT count(*) FILTER ({year} <= 1995) AS en, count(*) FILTER ({year} >= 2000) AS ln FROM a WHERE assigned) GROUP BY 1)"""


ORACLES = {
    "ages_period_shares": f"WITH {_G} SELECT cluster, period, start_year, end_year, papers, period_assigned_papers, period_all_papers, period_unassigned_papers, round(share_pct::DOUBLE, 6) AS share_pct FROM g",
    "ages_annual_shares": f"""WITH {_P}, y AS (SELECT unnest(range((SELECT min(year) FROM p), 2002)) AS year), c AS (SELECT DISTINCT cluster FROM p WHERE assigned),
n AS (SELECT cluster, year, count(*) AS papers FROM p WHERE assigned GROUP BY ALL), o AS (SELECT year, count(*) FILTER (assigned) AS a, count(*) AS t FROM p GROUP BY ALL)
SELECT c.cluster, y.year::BIGINT AS year, coalesce(papers, 0) AS papers, coalesce(a, 0) AS period_assigned_papers, coalesce(t, 0) AS period_all_papers, coalesce(t, 0) - coalesce(a, 0) AS period_unassigned_papers,
round((CASE WHEN a > 0 THEN 100.0 * coalesce(papers, 0) / a END)::DOUBLE, 6) AS share_pct FROM c CROSS JOIN y LEFT JOIN n ON n.cluster = c.cluster AND n.year = y.year LEFT JOIN o ON o.year = y.year""",
    "ages_cluster_summary": f"""WITH {_P} SELECT cluster, count(*) AS papers, count(year) AS dated, quantile_cont(year, 0.5)::DOUBLE AS median_year, round(avg(year), 6) AS mean_year, min(year) AS min_year, max(year) AS max_year,
quantile_cont(2001 - year, 0.5)::DOUBLE AS median_age, round(avg(2001 - year), 6) AS mean_age, round(quantile_cont(2001 - year, 0.25)::DOUBLE, 6) AS q25_age, round(quantile_cont(2001 - year, 0.75)::DOUBLE, 6) AS q75_age,
min(2001 - year) AS min_age, max(2001 - year) AS max_age, count(*) < 10 AS small_cluster FROM p WHERE assigned GROUP BY cluster""",
    "ages_period_changes": f"""WITH {_G} SELECT cluster, round(max(share_pct::DOUBLE) FILTER (period = '<=1995'), 6) AS early_pct, round(max(share_pct::DOUBLE) FILTER (period = '2000-2001'), 6) AS late_pct,
round(max(share_pct::DOUBLE) FILTER (period = '2000-2001') - max(share_pct::DOUBLE) FILTER (period = '<=1995'), 6) AS change_pp FROM g GROUP BY cluster""",
    "ages_share_by_cluster": f"WITH {_G}, {_S} SELECT cluster, period, papers, cluster_papers, round((100.0 * papers / cluster_papers)::DOUBLE, 6) AS share_pct FROM s",
    "ages_share_matrix": f"WITH {_G}, {_S} SELECT cluster, " + ", ".join(f"round(max((100.0 * papers / cluster_papers)::DOUBLE) FILTER (period = '{p}'), 6) AS p{i + 1}" for i, (p, _, _) in enumerate(PERIODS)) + " FROM s GROUP BY cluster",
    "ages_year_sensitivity": f"WITH {_P}, {_A}, {_changes('year', 'x')}, {_changes('alternative_year', 'y')} SELECT cluster, round(x.pp::DOUBLE, 6) AS primary_pp, round(y.pp::DOUBLE, 6) AS alternative_pp, sign(x.pp) = sign(y.pp) AS same_sign FROM x JOIN y USING (cluster)",
    "ages_coverage": f"WITH {_P}, {_A} SELECT count(*) AS papers, count(*) FILTER (assigned) AS assigned, count(*) FILTER (NOT assigned) AS unassigned, count(DISTINCT cluster) FILTER (assigned) AS clusters, count(DISTINCT author) AS authors, count(*) FILTER (alternative_year <> year) AS differing_years FROM a",
    "ages_paper_ages": f"WITH {_P}, {_A} SELECT paper_id, cluster, assigned, year, alternative_year, 2001 - year AS age, alternative_year - year AS year_difference FROM a",
}

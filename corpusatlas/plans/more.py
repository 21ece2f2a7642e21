"""Queries on file names, reuse of earlier work, positions, repeated rows and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.functions import text as T
from corpusatlas.operators import agreement, cluster, linkage, ranking, selection, vectors
from corpusatlas.plans.ages import rounded
from corpusatlas.session import table
from corpusatlas.storage import keep


def filename_titles(spark: SparkSession, d: str) -> DataFrame:
    line = F.translate(F.split("text", "\n")[0], "/", " ")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(line, F.lit(".pdf"))).otherwise(F.concat(F.lit("in/Author "), "doc_id", F.lit(" - "), F.col("doc_id") % 40 + 1990, F.lit(" - "), line, F.lit(".pdf")))
    return table(spark, d, "documents").select("doc_id", T.title_and_year(name).alias("x")).select("doc_id", F.ltrim("x.title").alias("title"), F.col("x.year").cast("long").alias("year"))


def approved_reuse(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_partkey").alias("place"))
    saved = papers.withColumns({"approved": F.col("p_partkey") % 3 == 0, "match_doi": F.concat(F.lit("10.1/"), "p_partkey"), "match_title": F.upper("p_name")})
    return linkage.reuse_approved(papers, saved, "p_partkey", "place", ["p_name"]).select("p_partkey", "approved_doi", "approved_title")


def pending_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A third of the vectors is cached, a third of those with another digest."""
    x = table(spark, d, "embeddings").select("vec_id", "embedding", F.lit("a").alias("digest"))
    cached = x.filter("vec_id % 3 = 0").withColumn("digest", F.when(F.col("vec_id") % 9 == 0, "b").otherwise("a"))
    return vectors.pending(x.select("vec_id", "digest"), cached, "vec_id").select("vec_id")


def coverage_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("vec_id", F.explode(F.array(F.lit(3), F.lit(5))).alias("setting"))
    labels = x.withColumns({"a": F.when(F.col("vec_id") % 10 == 0, 0).otherwise(F.col("vec_id") % F.col("setting") + 1), "b": F.when(F.col("vec_id") % 7 == 0, 0).otherwise(F.floor(F.col("vec_id") / 2) % F.col("setting") + 1)})
    return rounded(agreement.coverage_sensitivity(labels, [3, 5]), "ari").withColumn("setting", F.col("setting").cast("long"))


def hierarchy_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The cut at 15 clusters at the most, members in the order of the tree."""
    return keep(cluster.hierarchy(table(spark, d, "embeddings"), "vec_id", 15), "tree").orderBy("leaf")  # a sort reads its input twice


def numbered_orders(spark: SparkSession, d: str) -> DataFrame:
    return selection.numbered(table(spark, d, "orders").select("o_custkey", "o_orderkey"), [F.desc("o_orderkey")], ["o_custkey"]).withColumn("row", F.col("row").cast("long"))


def first_orders(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_by(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], F.asc("o_orderkey"))


def repeated_texts(spark: SparkSession, d: str) -> DataFrame:
    return ranking.flag_repeated(table(spark, d, "documents").select("doc_id", "text"), ["text"]).select("doc_id", "repeated")


def dense_sources(spark: SparkSession, d: str) -> DataFrame:
    return ranking.dense_labels(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", F.col("cluster").cast("long").alias("cluster"))


def manual_edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 60).alias("src"), (F.col("l_partkey") % 50).alias("dst")).distinct()
    return linkage.add_manual_edges(li.filter("(src + dst) % 3 = 0"), li.filter("(src + dst) % 2 = 0"))


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    both = T.embedding_text(F.when(F.col("doc_id") % 5 > 0, lines[0]), F.array_join(F.slice(lines, 2, F.size(lines)), " "))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(both, 256).alias("text"))


def comparable_solutions(spark: SparkSession, d: str) -> DataFrame:
    """One solution per market segment and nation count of the customers: pairs worth comparing."""
    k = table(spark, d, "customer").groupBy((F.col("c_custkey") % 6).alias("solution")).agg((F.count("*") % 3).alias("k"))
    return agreement.compare_solutions(k.withColumn("method", F.when(F.col("solution") % 2 == 0, "a").otherwise("b")))


QUERIES = {f.__name__: f for f in (filename_titles, approved_reuse, pending_vectors, coverage_sensitivity, hierarchy_leaves, numbered_orders, first_orders, repeated_texts, dense_sources, manual_edges, embedding_texts, comparable_solutions)}

ORACLES = {
    "filename_titles": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN ltrim(translate(string_split(text, chr(10))[1], '/', ' '), ' ') END AS title, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 40 + 1990 END AS year FROM documents",
    "approved_reuse": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || p_partkey ELSE '' END AS approved_doi, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE '' END AS approved_title FROM part",
    "pending_vectors": "SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 9 = 0",
    "coverage_sensitivity": """WITH x AS (SELECT vec_id, s::BIGINT AS setting, CASE WHEN vec_id % 10 = 0 THEN 0 ELSE vec_id % s + 1 END AS a, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE (vec_id // 2) % s + 1 END AS b FROM embeddings, unnest([3, 5]) AS u(s)),
y AS (SELECT * FROM x WHERE a > 0 AND b > 0), n AS (SELECT setting, count(*) AS n FROM y GROUP BY 1),
i AS (SELECT setting, sum(c * (c - 1) / 2.0) AS i FROM (SELECT setting, count(*) AS c FROM y GROUP BY setting, a, b) GROUP BY 1),
ra AS (SELECT setting, sum(c * (c - 1) / 2.0) AS x FROM (SELECT setting, count(*) AS c FROM y GROUP BY setting, a) GROUP BY 1),
rb AS (SELECT setting, sum(c * (c - 1) / 2.0) AS y FROM (SELECT setting, count(*) AS c FROM y GROUP BY setting, b) GROUP BY 1),
k AS (SELECT setting, count(DISTINCT a) FILTER (a > 0) AS a_k, count(DISTINCT b) FILTER (b > 0) AS b_k FROM x GROUP BY 1),
e AS (SELECT *, x * y / (n * (n - 1) / 2.0) AS e FROM n JOIN i USING (setting) JOIN ra USING (setting) JOIN rb USING (setting) JOIN k USING (setting))
SELECT setting, n AS compared, round((i - e) / ((x + y) / 2 - e), 6) AS ari, a_k, b_k FROM e""",
    "numbered_orders": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS row FROM orders",
    "first_orders": "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1",
    "repeated_texts": "SELECT doc_id, coalesce(text, '') <> '' AND count(*) OVER (PARTITION BY text) > 1 AS repeated FROM documents",
    "dense_sources": "SELECT doc_id, cluster FROM documents JOIN (SELECT source, row_number() OVER (ORDER BY min(doc_id)) AS cluster FROM documents GROUP BY 1) USING (source)",
    "manual_edges": "WITH e AS (SELECT DISTINCT l_orderkey % 60 AS src, l_partkey % 50 AS dst FROM lineitem) SELECT src, dst, CASE WHEN (src + dst) % 3 = 0 THEN 'provider' ELSE 'manual' END AS source FROM e WHERE (src + dst) % 3 = 0 OR (src + dst) % 2 = 0",
    "embedding_texts": "WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN nullif(string_split(text, chr(10))[1], '') END AS a, nullif(array_to_string(string_split(text, chr(10))[2:], ' '), '') AS b FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), a, b)) AS text FROM x",
    "comparable_solutions": "WITH s AS (SELECT c_custkey % 6 AS solution, count(*) % 3 AS k FROM customer GROUP BY 1), m AS (SELECT *, CASE WHEN solution % 2 = 0 THEN 'a' ELSE 'b' END AS method FROM s) SELECT x.solution AS first, y.solution AS second, CASE WHEN x.method = y.method THEN 'adjacent_counts' ELSE 'same_count' END AS kind FROM m x JOIN m y ON x.method < y.method AND x.k = y.k OR x.method = y.method AND y.k = x.k + 1",
}

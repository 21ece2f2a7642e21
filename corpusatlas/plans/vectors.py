"""Queries on vectors and on partitions of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.operators import agreement, graphs, vectors
from corpusatlas.plans.ages import rounded, whole
from corpusatlas.session import table


def emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def labels(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).select(F.col("label").cast("long").alias("a"), (F.col("vec_id") % 10).alias("b"))


def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whole(vectors.knn(emb(spark, d), "vec_id", 15), "rank"), "similarity")


def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.similarity_graph(vectors.knn(emb(spark, d), "vec_id", 15)), "weight")


def knn_mutual_graph(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.similarity_graph(vectors.knn(emb(spark, d), "vec_id", 15), mutual=True), "weight")


def knn_graph_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    from corpusatlas.storage import keep

    edges = keep(vectors.similarity_graph(vectors.knn(emb(spark, d), "vec_id", 15), mutual=True), "knn").select("src", "dst")
    return rounded(graphs.graph_summary(emb(spark, d).select(F.col("vec_id").alias("node")), edges), "median_degree")


def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.nearest(emb(spark, d), "vec_id", 7, 10).withColumn("query", F.col("query").cast("long")), "similarity")


def cosine_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whole(vectors.silhouettes(emb(spark, d), "label", "vec_id"), "label"), "silhouette")


def silhouette_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.silhouette_summary(vectors.silhouettes(emb(spark, d), "label", "vec_id"), "label")
    return rounded(whole(out, "label"), "mean_silhouette", "negative_fraction")


def cluster_mean_similarity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whole(vectors.mean_similarity(emb(spark, d), "label"), "a", "b"), "similarity")


def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whole(vectors.representatives(emb(spark, d), "label", "vec_id"), "label", "rank"), "centrality")


def weighted_centroids(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.weighted_centroids(emb(spark, d).withColumn("w", F.col("vec_id") % 7 + 1), ["label"], "w")
    return rounded(out.select(F.col("label").cast("long").alias("label"), "n", F.posexplode("centroid").alias("dim", "value")).withColumn("dim", F.col("dim").cast("long")), "value")


def partition_contingency(spark: SparkSession, d: str) -> DataFrame:
    return agreement.contingency(labels(spark, d))


def partition_ari(spark: SparkSession, d: str) -> DataFrame:
    return agreement.adjusted_rand(agreement.contingency(labels(spark, d))).select(F.round("ari", 6).alias("ari"))


def partition_ami(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.adjusted_mutual_information(agreement.contingency(labels(spark, d))), "mi", "expected_mi", "ami")


def partition_matching(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.matching(agreement.contingency(labels(spark, d))), "jaccard")


def partition_agreement(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.partition_agreement(labels(spark, d)), "ari", "matched_fraction")


QUERIES = {f.__name__: f for f in (knn_edges, knn_graph, knn_mutual_graph, knn_graph_diagnostics, nearest_neighbours, cosine_silhouette, silhouette_by_cluster, cluster_mean_similarity, cluster_representatives, weighted_centroids, partition_contingency, partition_ari, partition_ami, partition_matching, partition_agreement)}

_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
_U = f"{_V}, u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)"
_S = f"{_U}, s AS MATERIALIZED (SELECT x.vec_id AS src, y.vec_id AS dst, x.label AS la, y.label AS lb, list_dot_product(x.e, y.e) AS sim FROM u x JOIN u y ON x.vec_id <> y.vec_id)"
_K = f"{_S}, k AS (SELECT * FROM (SELECT src, dst, sim, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS rank FROM s) WHERE rank <= 15)"
_G = f"{_K}, g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(sim) AS w, count(*) AS votes FROM k WHERE sim > 0 GROUP BY 1, 2)"
_SIL = f"""{_S}, m AS (SELECT src, la, lb, sum(1 - sim) AS t, count(*) AS n FROM s GROUP BY ALL), x AS (SELECT src, la, max(t / n) FILTER (la = lb) AS a, min(t / n) FILTER (la <> lb) AS b FROM m GROUP BY ALL),
sil AS (SELECT src AS vec_id, la AS label, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM x)"""
_C = "t AS (SELECT label AS a, vec_id % 10 AS b, count(*) AS n FROM embeddings GROUP BY ALL), ra AS (SELECT a, sum(n) AS na FROM t GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM t GROUP BY 1), tot AS (SELECT sum(n) AS N0 FROM t)"

ORACLES = {
    "knn_edges": f"WITH {_K} SELECT src, dst, round(sim, 6) AS similarity, rank FROM k",
    "knn_graph": f"WITH {_G} SELECT a AS src, b AS dst, round(w, 6) AS weight FROM g",
    "knn_mutual_graph": f"WITH {_G} SELECT a AS src, b AS dst, round(w, 6) AS weight FROM g WHERE votes = 2",
    "nearest_neighbours": f"WITH {_U} SELECT 7::BIGINT AS query, y.vec_id, round(list_dot_product(x.e, y.e), 6) AS similarity FROM u x, u y WHERE x.vec_id = 7 AND y.vec_id <> 7 ORDER BY round(list_dot_product(x.e, y.e), 9) DESC, y.vec_id LIMIT 10",
    "cosine_silhouette": f"WITH {_SIL} SELECT vec_id, label::BIGINT AS label, round(silhouette, 6) AS silhouette FROM sil",
    "silhouette_by_cluster": f"WITH {_SIL} SELECT label::BIGINT AS label, count(*) AS n, round(avg(silhouette), 6) AS mean_silhouette, round(avg((silhouette < 0)::INT), 6) AS negative_fraction FROM sil GROUP BY 1",
    "cluster_mean_similarity": f"WITH {_S} SELECT la::BIGINT AS a, lb::BIGINT AS b, round(avg(sim), 6) AS similarity FROM s GROUP BY 1, 2",
    "cluster_representatives": f"WITH {_S}, c AS (SELECT src AS vec_id, la AS label, avg(sim) AS centrality FROM s WHERE la = lb GROUP BY 1, 2) SELECT vec_id, label::BIGINT AS label, round(centrality, 6) AS centrality, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(centrality, 9) DESC, vec_id) AS rank FROM c) WHERE rank <= 3",
    "weighted_centroids": f"WITH {_V}, x AS (SELECT label, unnest(range(64)) AS dim, unnest(e) * (vec_id % 7 + 1) AS x, vec_id FROM v), m AS (SELECT label, dim, count(*) AS n, sum(x) AS x FROM x GROUP BY 1, 2) SELECT label::BIGINT AS label, n, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS value FROM m",
    "partition_contingency": "SELECT label::BIGINT AS a, vec_id % 10 AS b, count(*) AS n FROM embeddings GROUP BY ALL",
    "partition_ari": f"WITH {_C}, q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS i, (SELECT sum(na * (na - 1) / 2) FROM ra) AS x, (SELECT sum(nb * (nb - 1) / 2) FROM rb) AS y, (SELECT N0 * (N0 - 1) / 2 FROM tot) AS z) SELECT round(((i - x * y / z) / ((x + y) / 2 - x * y / z))::DOUBLE, 6) AS ari FROM q",
    "partition_ami": f"""WITH {_C}, mi AS (SELECT sum(n / N0 * ln(N0 * n / (na * nb))) AS mi FROM t JOIN ra USING (a) JOIN rb USING (b), tot), h AS (SELECT (SELECT -sum(na / N0 * ln(na / N0)) FROM ra, tot) AS ha, (SELECT -sum(nb / N0 * ln(nb / N0)) FROM rb, tot) AS hb),
e AS (SELECT sum(k / N0 * ln(N0 * k / (na * nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(N0 - na + 1) + lgamma(N0 - nb + 1) - lgamma(N0 + 1) - lgamma(k + 1) - lgamma(na - k + 1) - lgamma(nb - k + 1) - lgamma(N0 - na - nb + k + 1))) AS emi FROM ra, rb, tot, unnest(range(greatest(1, na + nb - N0)::BIGINT, least(na, nb)::BIGINT + 1)) AS u(k))
SELECT round(mi, 6) AS mi, round(emi, 6) AS expected_mi, round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS ami FROM mi, h, e""",
    "knn_graph_diagnostics": f"""WITH RECURSIVE {_G}, e AS MATERIALIZED (SELECT a AS x, b AS y FROM g WHERE votes = 2 UNION ALL SELECT b, a FROM g WHERE votes = 2), reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
comp AS (SELECT c, count(*) AS size FROM (SELECT x, min(y) AS c FROM reach GROUP BY 1) GROUP BY 1), d AS (SELECT vec_id, count(e.y) AS degree FROM embeddings LEFT JOIN e ON e.x = vec_id GROUP BY 1)
SELECT count(*) AS nodes, (sum(degree) / 2)::BIGINT AS edges, count(*) FILTER (degree = 0) AS isolates, min(degree) AS min_degree, round(median(degree), 6) AS median_degree, max(degree) AS max_degree, (SELECT count(*) FROM comp) AS components, (SELECT max(size) FROM comp) AS largest FROM d""",
}

"""Queries on review tables, work lists and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.operators import review, vectors
from corpusatlas.plans.ages import rounded
from corpusatlas.plans.vectors import _S as VECTORS
from corpusatlas.session import table
from corpusatlas.sources.writers import dense_index
from corpusatlas.streaming import windows


def example_roles(spark: SparkSession, d: str) -> DataFrame:
    scored = table(spark, d, "part").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("key"), "p_retailprice")
    return review.example_roles(scored, "cluster", "key", "p_retailprice")


def review_cards(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").withColumn("cluster", F.col("label").cast("long"))
    best = vectors.representatives(x, "cluster", "vec_id")
    examples = best.select("cluster", F.col("vec_id").alias("key"), F.lit("central").alias("roles"))
    terms = best.select("cluster", "rank", F.concat(F.lit("v"), "vec_id").alias("term"))
    return review.cards(x.groupBy("cluster").agg(F.count("*").alias("n")), terms, examples)


def balanced_groups(spark: SparkSession, d: str) -> DataFrame:
    costs = table(spark, d, "documents").select("doc_id", "n_chars")
    out = review.balanced_groups(costs, "doc_id", "n_chars", 4)
    return out.groupBy("group").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("cost"))


def title_search(spark: SparkSession, d: str) -> DataFrame:
    return review.title_search(table(spark, d, "part").select("p_partkey", "p_name"), "RED", "p_name", "p_partkey")


def vector_row_map(spark: SparkSession, d: str) -> DataFrame:
    return dense_index(table(spark, d, "embeddings").select("vec_id"), "vec_id", "embedding_row")


def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = windows.tumbling(table(spark, d, "events"), "1 hour", "1 hour", "event_type")
    return rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), "value")


def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = windows.sessions(table(spark, d, "events"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")})


QUERIES = {f.__name__: f for f in (example_roles, review_cards, balanced_groups, title_search, vector_row_map, events_tumbling, events_sessions)}

ORACLES = {
    "example_roles": "WITH r AS (SELECT p_brand AS cluster, p_partkey AS key, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS b FROM part), h AS (SELECT *, row_number() OVER (PARTITION BY cluster, a <= 3 OR b <= 2 ORDER BY sha256('42|' || key), key) AS c FROM r) SELECT cluster, key, CASE WHEN a <= 3 OR b <= 2 THEN concat_ws('; ', CASE WHEN a <= 3 THEN 'central' END, CASE WHEN b <= 2 THEN 'boundary' END) ELSE 'random' END AS roles FROM h WHERE a <= 3 OR b <= 2 OR c <= 2",
    "title_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(p_partkey::VARCHAR, 'red')",
    "vector_row_map": "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS embedding_row FROM embeddings",
    "events_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY date_trunc('hour', ts), event_type",
    "events_sessions": """WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS end, count(*) AS events FROM s GROUP BY user_id, n""",
    "balanced_groups": """WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r, n_chars FROM documents),
f AS (SELECT 0::BIGINT AS r, [0, 0, 0, 0]::BIGINT[] AS t, 0::BIGINT AS c, 0::BIGINT AS g UNION ALL SELECT o.r, list_transform(t, lambda x, i: x + CASE WHEN i = list_position(t, list_min(t)) THEN n_chars ELSE 0 END), n_chars, list_position(t, list_min(t)) FROM f JOIN o ON o.r = f.r + 1)
SELECT (g - 1)::INT AS "group", count(*) AS documents, sum(c)::BIGINT AS cost FROM f WHERE r > 0 GROUP BY 1""",
    "review_cards": f"""WITH {VECTORS}, c AS (SELECT src AS vec_id, la AS label, avg(sim) AS centrality FROM s WHERE la = lb GROUP BY 1, 2), b AS (SELECT * FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY round(centrality, 9) DESC, vec_id) AS rank FROM c) WHERE rank <= 3),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label::BIGINT AS cluster, '## Cluster ' || label || ': ' || any_value(n) || ' papers' || chr(10) || chr(10) || string_agg('v' || vec_id, ', ' ORDER BY rank) || chr(10) || chr(10) || string_agg('- ' || vec_id || ' (central)', chr(10) ORDER BY vec_id) AS card FROM n JOIN b USING (label) GROUP BY 1, label""",
}

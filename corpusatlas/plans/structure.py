"""Queries on clustering runs, record linkage, documents as blocks, and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.operators import cluster, documents, linkage, provenance, ranking, vectors
from corpusatlas.plans.ages import rounded, whole
from corpusatlas.session import table
from corpusatlas.storage import keep


def emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def kmeans_sweep(spark: SparkSession, d: str) -> DataFrame:
    runs, labels = cluster.kmeans_runs(emb(spark, d), "vec_id", [3, 5], [1, 2])
    best = cluster.best_runs(runs, "k", "inertia")
    return rounded(best.join(cluster.mean_pairwise_ari(labels, "k", "vec_id"), "k"), "inertia", "mean_ari", "min_ari")


def leiden_runs(spark: SparkSession, d: str) -> DataFrame:
    edges = keep(vectors.similarity_graph(vectors.knn(emb(spark, d), "vec_id", 15)), "graph")
    return cluster.leiden_sweep(emb(spark, d).select(F.col("vec_id").alias("node")), edges, [0.8, 1.0], [1, 2])


def leiden_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.sweep_summary(keep(leiden_runs(spark, d), "runs")), "objective", "mean_ari", "min_ari")


def hierarchy_cut(spark: SparkSession, d: str) -> DataFrame:
    return cluster.hierarchy(emb(spark, d), "vec_id", 8)


def pca_projection(spark: SparkSession, d: str) -> DataFrame:
    out, _ = cluster.pca(emb(spark, d), "vec_id")
    return rounded(out.select("vec_id", F.col("pc")[0].alias("x"), F.col("pc")[1].alias("y")), "x", "y")


def subsample_stability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.subsample_stability(emb(spark, d), "vec_id", 4, [1, 2]), "ari")


def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return cluster.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("spearman", 6).alias("spearman"))


def first_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lower(F.split("text", "\n")[0]).alias("title_key"))


def link_exact_titles(spark: SparkSession, d: str) -> DataFrame:
    """Documents not divisible by 4 look up their first lines among those that are."""
    x = first_lines(spark, d)
    entries = x.filter("doc_id % 4 = 0").select("title_key", F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("10.1/"), F.col("doc_id") % 16)).otherwise("").alias("doi"), (F.col("doc_id") % 5 + 1990).alias("year"))
    papers = x.filter("doc_id % 4 <> 0").select("doc_id", "title_key", F.lit("").alias("fallback_key"), F.when(F.col("doc_id") % 3 == 0, 2000).cast("long").alias("filename_year"))
    return whole(linkage.bibliography_lookup(papers, entries, "doc_id").na.fill(0, ["year"]), "year")


def link_fuzzy_titles(spark: SparkSession, d: str) -> DataFrame:
    """All first lines against all benchmark texts."""
    papers = first_lines(spark, d).select("doc_id", "title_key", F.lit("").alias("doi"), (F.col("doc_id") % 3).alias("year"))
    other = table(spark, d, "benchmark").select(F.col("item_id").alias("cand_id"), F.lower("text").alias("cand_key"), F.lit("").alias("cand_doi"), (F.col("item_id") % 3).alias("cand_year"))
    return rounded(linkage.resolve_titles(papers, other, "doc_id", "cand_id"), "score", "gap")


def reference_edges_alias(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers stand for aliases of the parts they ship; an order refers to its suppliers."""
    li = table(spark, d, "lineitem")
    aliases = li.filter("l_quantity >= 49").select(F.col("l_partkey").alias("key"), F.concat(F.col("l_suppkey").cast("string"), F.lit("-"), (F.col("l_partkey") % 40).cast("string")).alias("alias")).distinct()
    refs = li.select((F.col("l_orderkey") % 500).alias("src"), F.concat(F.col("l_suppkey").cast("string"), F.lit("-"), (F.col("l_orderkey") % 40).cast("string")).alias("alias"))
    reserved = aliases.filter("alias LIKE '1%'").select("alias").distinct()
    return linkage.alias_edges(refs, aliases, reserved)


def reference_edges_two_way(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    refs = li.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").cast("string").alias("target_id"), F.col("l_suppkey").cast("string").alias("target_doi"))
    part = table(spark, d, "part")
    by_id = part.select(F.col("p_partkey").alias("key"), F.col("p_partkey").cast("string").alias("alias"))
    by_doi = part.filter("p_partkey < 60").select(F.col("p_partkey").alias("key"), F.col("p_partkey").cast("string").alias("alias"))
    return linkage.two_way_edges(refs, by_id, by_doi)[0]


def canonical_records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    same = docs.groupBy("text").agg(F.min("doc_id").alias("canonical_key"))
    mapping = docs.join(same, "text").filter("doc_id <> canonical_key").select(F.col("doc_id").alias("duplicate_key"), "canonical_key")
    return linkage.canonical_keys(docs.select("doc_id"), mapping, "doc_id")


def newest_events(spark: SparkSession, d: str) -> DataFrame:
    return linkage.newest(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def front_matches(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    reference = lines.filter("ord BETWEEN 1 AND 2").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("reference")).filter("length(reference) BETWEEN 40 AND 600")
    return rounded(linkage.front_matches(lines, reference, "doc_id"), "score")


def page_mentions(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.lower("text").alias("page_key"))
    titles = table(spark, d, "benchmark").select(F.col("item_id").alias("title_id"), F.lower("text").alias("title_key"))
    return linkage.page_mentions(pages, titles).withColumn("excerpt", F.sha2("excerpt", 256))


def section_groups(spark: SparkSession, d: str) -> DataFrame:
    """Turns are blocks; a user's turn opens a section."""
    x = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return documents.section_groups(x, "conv_id", "turn", F.col("role") == "user")


def segment_packing(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("section"), "text")
    return documents.pack_segments(x, "conv_id", 64)


def html_visible_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", documents.visible_text(F.col("html")).alias("text"))


def abstract_candidates(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return documents.extract_abstract(lines, "doc_id").withColumn("abstract", F.sha2("abstract", 256))


def heading_parts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    h = F.concat(F.when(n % 3 == 0, F.concat(n % 7, F.lit(". "))).when(n % 3 == 1, F.concat(n % 7, F.lit("."), n % 4, F.lit(" "))).otherwise(F.lit("")), F.split("text", "\n")[0], F.lit(":"))
    x = table(spark, d, "documents").select("doc_id", h.alias("h"))
    return x.select("doc_id", documents.heading_number(F.col("h")).alias("number"), documents.heading_level(F.col("h")).cast("long").alias("level"), documents.heading_name(F.col("h")).alias("name"))


def prioritised_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    one = lambda m, v: docs.filter(F.col("doc_id") % m == 0).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(v), "doc_id")).otherwise("").alias("abstract"))
    return documents.prioritised(docs, "doc_id", "abstract", [("extraction", one(2, "e")), ("doi", one(3, "d")), ("supplement", one(1, "s"))])


def membership_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return whole(provenance.membership_fingerprints(emb(spark, d), "label", "vec_id"), "label")


def partition_catalog(spark: SparkSession, d: str) -> DataFrame:
    x = emb(spark, d)
    both = x.select(F.lit("labels").alias("solution"), F.col("label").alias("cluster")).unionByName(x.select(F.lit("residues").alias("solution"), (F.col("vec_id") % 7).cast("int").alias("cluster")))
    return provenance.catalog(both, "solution", "cluster")


def named_memberships(spark: SparkSession, d: str) -> DataFrame:
    x = emb(spark, d).select("vec_id", F.col("label").cast("long").alias("cluster"))
    names = provenance.membership_fingerprints(x, "cluster", "vec_id").filter("cluster < 5").select("cluster", "fingerprint", F.concat(F.lit("topic "), "cluster").alias("name"))
    return provenance.attach_names(x, names, "cluster", "vec_id")


def sweep_islands(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    x = x.select((F.col("y") * 12 + F.col("m")).cast("long").alias("month"), (F.col("n") % 2).alias("odd"))
    return ranking.islands(x, "month", "odd")


def centre_examples(spark: SparkSession, d: str) -> DataFrame:
    labels = emb(spark, d).select("vec_id", F.col("label").cast("long").alias("cluster"))
    return rounded(whole(cluster.central_to_centres(emb(spark, d), labels, "vec_id"), "rank"), "similarity")


def graph_checks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.graph_checks(emb(spark, d), "vec_id", 1.0, [15, 10], [1]), "ari")


def trustworthiness(spark: SparkSession, d: str) -> DataFrame:
    projected, _ = cluster.pca(emb(spark, d), "vec_id")
    return rounded(vectors.trustworthiness(emb(spark, d).select("vec_id", "embedding"), projected, "vec_id"), "trustworthiness")


QUERIES = {f.__name__: f for f in (kmeans_sweep, leiden_sweep, hierarchy_cut, pca_projection, subsample_stability, rank_correlation, link_exact_titles, link_fuzzy_titles, reference_edges_alias, reference_edges_two_way, canonical_records, newest_events, front_matches, page_mentions, section_groups, segment_packing, html_visible_text, abstract_candidates, heading_parts, prioritised_sources, membership_fingerprints, partition_catalog, named_memberships, sweep_islands, centre_examples, graph_checks, trustworthiness)}

_FP = "SELECT cluster, sum(n)::BIGINT AS n, sha256(string_agg(d, ',' ORDER BY b, d)) AS fingerprint FROM (SELECT cluster, b, count(*) AS n, sha256(string_agg(k, ',' ORDER BY k)) AS d FROM (SELECT cluster, k, substr(sha256(k), 1, 3) AS b FROM x) GROUP BY ALL) GROUP BY 1"

ORACLES = {
    "rank_correlation": "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman FROM r",
    "link_exact_titles": """WITH t AS (SELECT doc_id, lower(string_split(text, chr(10))[1]) AS k FROM documents), e AS (SELECT k, CASE WHEN doc_id % 8 = 0 THEN '10.1/' || (doc_id % 16) ELSE '' END AS doi, doc_id % 5 + 1990 AS year FROM t WHERE doc_id % 4 = 0),
l AS (SELECT k, count(*) AS c, count(DISTINCT doi) FILTER (doi <> '') AS nd, min(doi) FILTER (doi <> '') AS doi, count(DISTINCT year) AS ny, min(year) AS year FROM e WHERE k <> '' GROUP BY 1)
SELECT doc_id, coalesce(c, 0) AS candidates, CASE WHEN nd = 1 THEN doi ELSE '' END AS doi, coalesce(CASE WHEN doc_id % 3 = 0 THEN 2000 END, CASE WHEN ny = 1 THEN year END, 0)::BIGINT AS year, CASE WHEN c IS NULL THEN 'missing' WHEN nd > 1 THEN 'ambiguous' ELSE 'matched' END AS metadata_status FROM t LEFT JOIN l USING (k) WHERE doc_id % 4 <> 0""",
    "reference_edges_alias": """WITH a AS (SELECT DISTINCT l_partkey AS key, l_suppkey || '-' || (l_partkey % 40) AS alias FROM lineitem WHERE l_quantity >= 49), u AS (SELECT alias, min(key) AS key FROM a GROUP BY 1 HAVING count(DISTINCT key) = 1)
SELECT DISTINCT l_orderkey % 500 AS src, key AS dst FROM lineitem JOIN u ON alias = l_suppkey || '-' || (l_orderkey % 40) WHERE alias NOT LIKE '1%' AND l_orderkey % 500 <> key""",
    "reference_edges_two_way": """WITH r AS (SELECT l_orderkey AS src, a.p_partkey AS k1, b.p_partkey AS k2 FROM lineitem LEFT JOIN part a ON a.p_partkey = l_partkey LEFT JOIN part b ON b.p_partkey = l_suppkey AND b.p_partkey < 60),
ok AS (SELECT src, coalesce(k1, k2) AS dst, concat_ws('+', CASE WHEN k1 IS NOT NULL THEN 'id' END, CASE WHEN k2 IS NOT NULL THEN 'doi' END) AS m FROM r WHERE NOT (k1 IS NOT NULL AND k2 IS NOT NULL AND k1 <> k2) AND coalesce(k1, k2) IS NOT NULL)
SELECT src, dst, string_agg(DISTINCT m, ';' ORDER BY m) AS methods FROM ok WHERE src <> dst GROUP BY ALL""",
    "canonical_records": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical_key, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate FROM documents",
    "newest_events": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "page_mentions": r"WITH t AS (SELECT item_id AS title_id, lower(text) AS k FROM benchmark), p AS (SELECT doc_id AS page_id, lower(text) AS x FROM documents) SELECT page_id, title_id, sha256(substr(x, greatest(1, strpos(x, k) - 170), length(k) + 340)) AS excerpt FROM p JOIN t ON contains(x, k) WHERE len(regexp_extract_all(k, '\S+')) >= 4",
    "section_groups": "SELECT conv_id, turn, role, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS section FROM conversations",
    "heading_parts": r"""WITH h AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN (doc_id % 7) || '. ' WHEN 1 THEN (doc_id % 7) || '.' || (doc_id % 4) || ' ' ELSE '' END || string_split(text, chr(10))[1] || ':' AS h FROM documents),
x AS (SELECT doc_id, h, regexp_extract(h, '^\s*((?:\d+|[IVX]+)(?:\.\d+)*)[.)]?\s+', 1) AS number FROM h)
SELECT doc_id, number, CASE WHEN number = '' THEN 0 ELSE len(string_split(number, '.')) END AS level, lower(trim(regexp_replace(regexp_replace(h, '^\s*((?:\d+|[IVX]+)(?:\.\d+)*)[.)]?\s+', ''), '[\s:.]+$', ''))) AS name FROM x""",
    "prioritised_sources": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'e' || doc_id END AS abstract, CASE WHEN doc_id % 2 = 0 THEN 'extraction' ELSE 'missing' END AS origin FROM documents",
    "centre_examples": "WITH x AS (SELECT label, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(range(64)) AS i, unnest(e) AS v FROM x) GROUP BY ALL) GROUP BY 1), s AS (SELECT label, vec_id, list_cosine_similarity(e, c) AS s FROM x JOIN c USING (label)) SELECT label::BIGINT AS cluster, vec_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 3",
    "membership_fingerprints": f"WITH x AS (SELECT label::BIGINT AS cluster, vec_id::VARCHAR AS k FROM embeddings) SELECT cluster AS label, n, fingerprint FROM ({_FP})",
    "partition_catalog": "WITH x AS (SELECT 'labels' AS solution, label AS cluster FROM embeddings UNION ALL SELECT 'residues', vec_id % 7 FROM embeddings), s AS (SELECT solution, cluster, count(*) AS n FROM x GROUP BY ALL) SELECT solution, sum(n)::BIGINT AS papers, coalesce(sum(n) FILTER (cluster = 0), 0)::BIGINT AS unassigned, count(*) FILTER (cluster > 0) AS clusters, min(n) FILTER (cluster > 0) AS smallest, max(n) FILTER (cluster > 0) AS largest, count(*) FILTER (cluster > 0 AND n = 1) AS singletons FROM s GROUP BY 1",
    "named_memberships": "SELECT vec_id, label::BIGINT AS cluster, CASE WHEN label = 0 THEN 'Unassigned' WHEN label < 5 THEN 'topic ' || label ELSE 'Name pending review' END AS name, label < 5 AS matched FROM embeddings",
    "sweep_islands": "WITH c AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS month, count(*) % 2 AS odd FROM orders GROUP BY 1), g AS (SELECT *, row_number() OVER (ORDER BY month) - row_number() OVER (PARTITION BY odd ORDER BY month) AS g FROM c) SELECT odd, min(month) AS first, max(month) AS last, count(*) AS length FROM g GROUP BY odd, g",
    "segment_packing": r"""WITH RECURSIVE x AS (SELECT conv_id, turn, role, regexp_extract_all(text, '\S+') AS w, regexp_split_to_array(text, '\S+') AS g FROM conversations),
b AS (SELECT *, len(w) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM x WHERE len(w) > 0),
f AS (SELECT conv_id, n, turn, role, k, 0::BIGINT AS pos, least(64, k) AS take, least(64, k) AS used, 0::BIGINT AS segment FROM b WHERE n = 1
 UNION ALL SELECT conv_id, n, turn, role, k, pos, CASE WHEN fresh THEN least(64, k - pos) ELSE least(64 - used, k - pos) END, CASE WHEN fresh THEN least(64, k - pos) ELSE used + least(64 - used, k - pos) END, segment + fresh::BIGINT
 FROM (SELECT f.conv_id, b.n, b.turn, b.role, b.k, f.used, f.segment, CASE WHEN b.n = f.n THEN f.pos + f.take ELSE 0 END AS pos, f.used >= 64 OR b.role <> f.role OR b.n > f.n AND b.k > 64 - f.used AND b.k <= 64 AS fresh
  FROM f JOIN b ON b.conv_id = f.conv_id AND b.n = f.n + CASE WHEN f.pos + f.take < f.k THEN 0 ELSE 1 END)),
o AS (SELECT conv_id, turn, list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda s: length(s))), 0) AS a, length(w[i]) AS own, i FROM b, unnest(range(1, k + 1)) AS u(i))
SELECT f.conv_id, segment::INT AS segment, f.turn AS ord, p.a::INT AS start, (q.a + q.own)::INT AS end, take::INT AS tokens FROM f JOIN o p ON p.conv_id = f.conv_id AND p.turn = f.turn AND p.i = f.pos + 1 JOIN o q ON q.conv_id = f.conv_id AND q.turn = f.turn AND q.i = f.pos + f.take""",
}

"""Institution, selection, deduplication and citation-graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.operators import graphs, institutions, selection
from corpusatlas.plans.ages import rounded, whole
from corpusatlas.session import table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("institution_id"))
    return institutions.paper_institutions(rows)


def registry(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("institution_id"), F.col("s_name").alias("name"), "country")


def institution_ranking(spark: SparkSession, d: str) -> DataFrame:
    out = institutions.ranking(links(spark, d), registry(spark, d))
    return rounded(whole(out, "rank"), "share_pct").withColumn("paper_ids", F.sha2("paper_ids", 256))


def institution_cluster_matrix(spark: SparkSession, d: str) -> DataFrame:
    clusters = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("cluster"))
    out = institutions.cluster_matrix(links(spark, d), clusters, PRIORITIES)
    names = [f"c{i}" for i in range(1, 6)]
    shares = [f"{n}_pct" for n in names]
    return rounded(out.toDF("institution_id", *names, "total", *shares), *shares)


def paper_institutions(spark: SparkSession, d: str) -> DataFrame:
    return institutions.names_by_paper(links(spark, d), registry(spark, d))


def institution_groups(spark: SparkSession, d: str) -> DataFrame:
    """Campuses mapped to the least supplier of the same nation."""
    s = table(spark, d, "supplier")
    parent = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("parent_id"))
    grouping = s.join(parent, "s_nationkey").select(F.col("s_suppkey").alias("institution_id"), "parent_id")
    out = institutions.paper_institutions(links(spark, d), grouping)
    return out.groupBy("institution_id").agg(F.count("*").alias("papers"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.when(F.col("doc_id") % 10 == 0, F.col("doc_id") + 10**9).otherwise(F.col("doc_id")).alias("doc_id"), (F.col("toxic") == 1).alias("exclude"))


def scope_exclusion_audit(spark: SparkSession, d: str) -> DataFrame:
    _, audit = selection.exclude(table(spark, d, "documents").select("doc_id"), decisions(spark, d), "doc_id")
    return audit


def scope_excluded_corpus(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = selection.exclude(table(spark, d, "documents").select("doc_id", "lang"), decisions(spark, d), "doc_id")
    return kept


def corpus_reviewed_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    same = docs.groupBy("text").agg(F.min("doc_id").alias("canonical_key"))
    mapping = docs.join(same, "text").filter("doc_id <> canonical_key AND doc_id % 4 <> 0").select(F.col("doc_id").alias("duplicate_key"), "canonical_key")
    return selection.drop_reviewed_duplicates(docs.select("doc_id", "source"), mapping, "doc_id")


def records(spark: SparkSession, d: str) -> DataFrame:
    doi = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1/"), (F.col("doc_id") % 97).cast("string"))).otherwise("")
    return table(spark, d, "documents").select("doc_id", doi.alias("doi"), F.split("text", "\n")[0].alias("text"))


def corpus_clean_dedup(spark: SparkSession, d: str) -> DataFrame:
    rules = [("missing", F.length("text") < 12), ("retracted", F.col("doc_id") % 50 == 7), ("future_year", F.col("doc_id") % 41 == 3)]
    return selection.clean_records(records(spark, d), "doc_id", rules, ["doi", "text"]).select("doc_id", "reason")


def corpus_review_flags(spark: SparkSession, d: str) -> DataFrame:
    from corpusatlas.operators.ranking import flag_repeated

    rows = flag_repeated(records(spark, d).withColumn("title", F.lower("text")), ["title"])
    flags = [("shared_title", F.col("repeated")), ("no_doi", F.col("doi") == ""), ("symbols", F.col("text").rlike("[#*$%&]"))]
    return selection.review_flags(rows, flags).select("doc_id", "flags")


def citations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Works (node, cluster) and directed edges."""
    part = table(spark, d, "part")
    n = part.count()
    e = table(spark, d, "lineitem").filter("l_linenumber = 1 AND l_quantity >= 45").select(F.col("l_partkey").alias("src"), (F.col("l_orderkey") % n).alias("dst")).filter("src <> dst").distinct()
    works = part.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("cluster"))
    return works, e.join(works.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def citation_degrees(spark: SparkSession, d: str) -> DataFrame:
    works, edges = citations(spark, d)
    return graphs.degrees(works.select("node"), edges)


def citation_components(spark: SparkSession, d: str) -> DataFrame:
    works, edges = citations(spark, d)
    return graphs.with_components(works.select("node"), edges)


def citation_summary(spark: SparkSession, d: str) -> DataFrame:
    works, edges = citations(spark, d)
    return rounded(graphs.graph_summary(works.select("node"), edges), "median_degree")


def citation_modularity(spark: SparkSession, d: str) -> DataFrame:
    works, edges = citations(spark, d)
    return rounded(graphs.modularity(works, graphs.undirected(edges)), "within_fraction", "objective")


def citation_members(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graphs.community_tables(*citations(spark, d))[0], "external_fraction")


def citation_representatives(spark: SparkSession, d: str) -> DataFrame:
    out = graphs.community_tables(*citations(spark, d))[1]
    return whole(out.select("cluster", "rank", "node", "within_degree"), "rank")


def citation_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    works, edges = citations(spark, d)
    titles = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("title"))
    return graphs.neighbourhood(edges, titles)


QUERIES = {f.__name__: f for f in (institution_ranking, institution_cluster_matrix, paper_institutions, institution_groups, scope_exclusion_audit, scope_excluded_corpus, corpus_reviewed_duplicates, corpus_clean_dedup, corpus_review_flags, citation_degrees, citation_components, citation_summary, citation_modularity, citation_members, citation_representatives, citation_neighbourhood)}

_L = "l AS (SELECT DISTINCT l_orderkey AS paper_id, l_suppkey AS institution_id FROM lineitem)"
_DEC = "dec AS (SELECT CASE WHEN doc_id % 10 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, toxic = 1 AS exclude FROM labels)"
_REC = "rec AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || (doc_id % 97) ELSE '' END AS doi, string_split(text, chr(10))[1] AS text FROM documents)"
_E = """e AS (SELECT DISTINCT l_partkey AS src, l_orderkey % (SELECT count(*) FROM part) AS dst FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 45 AND l_partkey <> l_orderkey % (SELECT count(*) FROM part) AND l_orderkey % (SELECT count(*) FROM part) IN (SELECT p_partkey FROM part)),
u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), both_ways AS (SELECT a AS x, b AS y FROM u UNION ALL SELECT b, a FROM u),
dg AS (SELECT p_partkey AS node, p_brand AS cluster, (SELECT count(*) FROM e WHERE dst = p_partkey) AS in_degree, (SELECT count(*) FROM e WHERE src = p_partkey) AS out_degree, (SELECT count(*) FROM both_ways WHERE x = p_partkey) AS degree FROM part)"""
_R = f"""{_E}, reach AS (SELECT p_partkey AS x, p_partkey AS y FROM part UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x),
comp AS (SELECT x AS node, min(y) AS component FROM reach GROUP BY x), sized AS (SELECT node, component, count(*) OVER (PARTITION BY component) AS component_size FROM comp)"""
_M = f"""{_E}, ends AS (SELECT a, b, pa.p_brand AS ca, pb.p_brand AS cb FROM u JOIN part pa ON a = pa.p_partkey JOIN part pb ON b = pb.p_partkey)"""
_W = f"""{_M}, wd AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM ends WHERE ca = cb UNION ALL SELECT b FROM ends WHERE ca = cb) GROUP BY 1), mem AS (SELECT dg.*, coalesce(n, 0) AS within_degree FROM dg LEFT JOIN wd USING (node))"""

ORACLES = {
    "institution_ranking": f"""WITH {_L}, n AS (SELECT institution_id, count(*) AS papers, string_agg(paper_id::VARCHAR, ';' ORDER BY paper_id) AS ids FROM l GROUP BY 1)
SELECT institution_id, papers, sha256(ids) AS paper_ids, round((100.0 * papers / (SELECT count(DISTINCT paper_id) FROM l))::DOUBLE, 6) AS share_pct, rank() OVER (ORDER BY papers DESC) AS rank, s_name AS name, n_name AS country
FROM n JOIN supplier ON s_suppkey = institution_id JOIN nation ON s_nationkey = n_nationkey""",
    "institution_cluster_matrix": f"""WITH {_L}, c AS (SELECT institution_id, """ + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS c{i + 1}" for i, p in enumerate(PRIORITIES)) + """, count(*) AS total FROM l JOIN orders ON o_orderkey = paper_id GROUP BY 1)
SELECT *, """ + ", ".join(f"round((100.0 * c{i} / total)::DOUBLE, 6) AS c{i}_pct" for i in range(1, 6)) + " FROM c",
    "paper_institutions": f"WITH {_L}, n AS (SELECT DISTINCT paper_id, s_name FROM l JOIN supplier ON s_suppkey = institution_id) SELECT paper_id, count(*) AS institutions, string_agg(s_name, '; ' ORDER BY s_name) AS names FROM n GROUP BY 1",
    "institution_groups": f"WITH {_L}, p AS (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS parent FROM supplier) SELECT parent AS institution_id, count(DISTINCT paper_id) AS papers FROM l JOIN p ON s_suppkey = institution_id GROUP BY 1",
    "scope_exclusion_audit": f"WITH {_DEC} SELECT doc_id, exclude, CASE WHEN doc_id NOT IN (SELECT doc_id FROM documents) THEN 'not_in_loaded_corpus' WHEN exclude THEN 'excluded' ELSE 'kept_by_decision' END AS status FROM dec",
    "scope_excluded_corpus": f"WITH {_DEC} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dec WHERE exclude)",
    "corpus_reviewed_duplicates": "SELECT doc_id, source FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS m FROM documents) WHERE doc_id = m OR doc_id % 4 = 0",
    "corpus_clean_dedup": f"""WITH RECURSIVE {_REC}, j AS (SELECT *, CASE WHEN length(text) < 12 THEN 'missing' WHEN doc_id % 50 = 7 THEN 'retracted' WHEN doc_id % 41 = 3 THEN 'future_year' ELSE '' END AS reason FROM rec),
o AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, doi, text FROM j WHERE reason = ''),
s AS (SELECT 0::BIGINT AS i, 0::BIGINT AS doc_id, ''::VARCHAR AS reason, []::VARCHAR[] AS dois, []::VARCHAR[] AS texts
UNION ALL SELECT o.i, o.doc_id, x.reason, CASE WHEN x.reason = '' AND doi <> '' THEN list_append(dois, doi) ELSE dois END, CASE WHEN x.reason = '' THEN list_append(texts, text) ELSE texts END
FROM s JOIN o ON o.i = s.i + 1, LATERAL (SELECT CASE WHEN doi <> '' AND list_contains(dois, doi) THEN 'duplicate_doi' WHEN list_contains(texts, text) THEN 'duplicate_text' ELSE '' END AS reason) AS x)
SELECT doc_id, reason FROM s WHERE i > 0 UNION ALL SELECT doc_id, reason FROM j WHERE reason <> ''""",
    "corpus_review_flags": f"WITH {_REC} SELECT doc_id, array_to_string(list_filter([CASE WHEN text <> '' AND count(*) OVER (PARTITION BY lower(text)) > 1 THEN 'shared_title' END, CASE WHEN doi = '' THEN 'no_doi' END, CASE WHEN regexp_matches(text, '[#*$%&]') THEN 'symbols' END], lambda x: x IS NOT NULL), ';') AS flags FROM rec",
    "citation_degrees": f"WITH {_E} SELECT node, in_degree, out_degree, degree FROM dg",
    "citation_components": f"WITH RECURSIVE {_R} SELECT * FROM sized",
    "citation_summary": f"WITH RECURSIVE {_R} SELECT count(*) AS nodes, (sum(degree) / 2)::BIGINT AS edges, count(*) FILTER (degree = 0) AS isolates, min(degree) AS min_degree, median(degree)::DOUBLE AS median_degree, max(degree) AS max_degree, (SELECT count(DISTINCT component) FROM sized) AS components, (SELECT max(component_size) FROM sized) AS largest FROM dg",
    "citation_modularity": f"WITH {_M}, s AS (SELECT c, count(*)::DOUBLE AS s FROM (SELECT ca AS c FROM ends UNION ALL SELECT cb FROM ends) GROUP BY 1) SELECT round(count(*) FILTER (ca = cb) / count(*), 6) AS within_fraction, round(count(*) FILTER (ca = cb) / count(*) - (SELECT sum(s * s) FROM s) / (4.0 * count(*) * count(*)), 6) AS objective FROM ends",
    "citation_members": f"WITH {_W} SELECT *, round(CASE WHEN degree > 0 THEN 1 - within_degree / degree END, 6) AS external_fraction FROM mem",
    "citation_representatives": f"WITH {_W} SELECT cluster, rank, node, within_degree FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY within_degree DESC, in_degree DESC, node) AS rank FROM mem) WHERE rank <= 3",
    "citation_neighbourhood": f"WITH {_E} SELECT src AS node, 'outgoing' AS direction, dst AS other, pa.p_name AS title, pb.p_name AS other_title FROM e JOIN part pa ON src = pa.p_partkey JOIN part pb ON dst = pb.p_partkey UNION ALL SELECT dst, 'incoming', src, pb.p_name, pa.p_name FROM e JOIN part pa ON src = pa.p_partkey JOIN part pb ON dst = pb.p_partkey",
}

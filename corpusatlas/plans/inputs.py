"""Queries on what comes in and goes out: reports, responses, page trees, plans, prose, samples and formatted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.operators import ages, documents, readability, selection
from corpusatlas.plans.ages import whole
from corpusatlas.session import table
from corpusatlas.sources import readers, writers


def in_order(*fields) -> Column:
    """The group's rows as an array of structs, by the first field."""
    return F.sort_array(F.collect_list(F.struct(*fields)))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return readers.status_report(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), "o_orderkey")


def valid_document_years(spark: SparkSession, d: str) -> DataFrame:
    return ages.valid_years(table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 40 + 1980).alias("year")), "year", 1800, 2026)


def tolerant_discounts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").filter(selection.close_to(F.col("l_discount"), 0.05))
    return x.groupBy("l_returnflag").agg(F.count("*").alias("n"))


def section_pages(spark: SparkSession, d: str) -> DataFrame:
    """Four turns are a segment, two a page."""
    x = table(spark, d, "conversations").select("conv_id", F.floor(F.col("turn") / 4).alias("segment"), F.floor(F.col("turn") / 2).alias("page"))
    return documents.section_report(x.groupBy("conv_id", "segment").agg(in_order("page").alias("sources")), "conv_id")


def span_texts(spark: SparkSession, d: str) -> DataFrame:
    spans = F.array(F.struct(F.lit(10).alias("start"), F.lit(20).alias("end")), F.struct(F.lit(0).alias("start"), F.lit(5).alias("end")))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", documents.span_text(F.col("text"), spans).alias("text"))


def page_trees(spark: SparkSession, d: str) -> DataFrame:
    """A conversation is a document, its user's turns are headings; all turns stand below the first."""
    place = F.concat(F.lit("/page/"), "turn", F.lit("/T/"), "turn")
    kind = F.when(F.col("role") == "user", "SectionHeader").when(F.col("turn") % 5 == 3, "blocks.PageFooter").otherwise("blocks.Text")
    html = F.concat(F.lit("<p>"), F.when(F.col("turn") == 4, "References").otherwise(F.concat("role", F.lit(" &amp; "), "turn")), F.lit("</p>"))
    hierarchy = F.struct(F.lit("/page/0/T/0").alias("1"))
    x = table(spark, d, "conversations").groupBy("conv_id").agg(in_order("turn", place.alias("id"), kind.alias("block_type"), html.alias("html"), hierarchy.alias("section_hierarchy")).alias("children"))
    return x.select("conv_id", F.to_json(F.struct(F.lit("/doc").alias("id"), "children")).alias("tree"))


def page_leaves(spark: SparkSession, d: str) -> DataFrame:
    out = documents.flatten_pages(page_trees(spark, d), "conv_id", "tree").withColumn("section", F.array_join("section", "|")).drop("html")
    return whole(out, "ord", "page")


def reference_status(spark: SparkSession, d: str) -> DataFrame:
    """Orders are papers, their lines references on two pages each."""
    li = table(spark, d, "lineitem")
    reference = F.struct(F.when(F.col("l_partkey") % 7 > 0, F.col("l_partkey")).alias("id"), F.lit("t").alias("title"), F.lit(2000).alias("year"), F.lit("").alias("doi"))
    pages = li.groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("p")).agg(F.collect_list(reference).alias("data"))
    pages = pages.select("l_orderkey", F.when((F.col("l_orderkey") % 11 == 0) & (F.col("p") == 1), 429).otherwise(200).alias("http_status"), "data")
    reported = li.groupBy("l_orderkey").agg((F.count("*") + F.first((F.col("l_orderkey") % 5 == 0).cast("int"))).alias("reference_count"))
    return readers.reference_pages(pages, reported, "l_orderkey")[1]


def works_by_doi(spark: SparkSession, d: str) -> DataFrame:
    work = F.struct(F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.concat(F.lit("10.1/D"), F.col("p_partkey") % 1500)).alias("doi"), F.col("p_partkey").alias("id"), F.col("p_name").alias("display_name"), (F.col("p_size") + 1950).alias("publication_year"))
    responses = table(spark, d, "part").groupBy("p_size").agg(F.collect_list(work).alias("results"))
    return whole(readers.works_by_doi(responses), "year")


def united_memberships(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("paper_id"), F.col("label").cast("long").alias("cluster"), (F.col("vec_id") % 40 + 1980).alias("year"))
    return ages.union_memberships(x.withColumn("corpus", F.lit("a")), x.select("paper_id", "year").withColumn("corpus", F.lit("b")))


def prepared_documents(spark: SparkSession, d: str) -> DataFrame:
    """A seventh of the documents has no text."""
    x = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("text")).alias("text"))
    return documents.prepare_corpus(x, "doc_id", skip_empty=True)[1].drop("plan_id")


def formatted_report(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.max(F.when(F.col("l_returnflag") == "A", 1.5)).alias("some"))
    return writers.formatted(x, 3)


def sampled_documents(spark: SparkSession, d: str) -> DataFrame:
    """The sampling operator's 50 rows."""
    return selection.reproducible_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


def prose_reasons(spark: SparkSession, d: str) -> DataFrame:
    """A user's turns are headings, the others blocks."""
    t = F.col("turn")
    kind = F.when(F.col("role") == "user", "heading").when(t % 10 == 5, "table").otherwise("text")
    text = F.when(F.col("role") == "user", F.when(t % 6 == 2, "Introduction").when(t % 6 == 4, "References").otherwise("Method")).when(t % 4 == 1, "12 May 2020").when(t % 6 == 3, "12 (3)").otherwise("words")
    x = table(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"), text.alias("text"))
    return readability.prose_blocks(x, "conv_id", "turn").select("conv_id", "turn", "reason")


def plan_passages(spark: SparkSession, d: str) -> DataFrame:
    """A conversation is a prepared segment, its turns are the sources."""
    text = F.coalesce("text", F.lit(""))
    x = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(in_order("turn", text.alias("text")).alias("b"))
    sources = F.transform("b", lambda t: F.struct(F.concat(F.lit("b"), t["turn"]).alias("block_id"), t["turn"].cast("int").alias("page"), F.lit(0).alias("start"), F.length(t["text"]).alias("end")))
    segment = F.struct(F.array_join(F.transform("b", lambda t: t["text"]), "\n\n").alias("text"), F.lit(0).alias("token_count"), F.lit("s").alias("section_name"), sources.alias("sources"))
    out = readers.passages(x.select("id", F.array(segment).alias("segments"))).withColumn("text", F.sha2("text", 256))
    return whole(out, "segment", "passage", "page", "start", "end")


QUERIES = {f.__name__: f for f in (status_counts, valid_document_years, tolerant_discounts, section_pages, span_texts, page_leaves, reference_status, works_by_doi, united_memberships, prepared_documents, formatted_report, sampled_documents, prose_reasons, plan_passages)}

ORACLES = {
    "status_counts": "SELECT o_orderstatus AS status, count(*) AS records FROM orders GROUP BY 1",
    "valid_document_years": "SELECT doc_id, doc_id % 40 + 1980 AS year FROM documents",
    "tolerant_discounts": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE abs(l_discount - 0.05) <= 1e-12 GROUP BY 1",
    "section_pages": "SELECT conv_id, turn // 4 AS segment, min(turn // 2) AS first_page, max(turn // 2) AS last_page, count(*) AS blocks FROM conversations GROUP BY 1, 2",
    "span_texts": "SELECT doc_id, substr(text, 1, 5) || chr(10) || chr(10) || substr(text, 11, 10) AS text FROM documents WHERE text IS NOT NULL",
    "page_leaves": """WITH b AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'SectionHeader' WHEN turn % 5 = 3 THEN 'PageFooter' ELSE 'Text' END AS kind, CASE WHEN turn = 4 THEN 'References' ELSE role || ' & ' || turn END AS text FROM conversations),
t AS (SELECT conv_id, text AS title FROM b WHERE turn = 0 AND kind = 'SectionHeader'), r AS (SELECT *, CASE WHEN kind = 'SectionHeader' AND text = 'References' THEN 'reference_section' WHEN kind = 'PageFooter' THEN kind END AS exclusion_reason FROM b LEFT JOIN t USING (conv_id))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, '/page/' || turn || '/T/' || turn AS id, kind, turn + 1 AS page, coalesce(title, '/page/0/T/0') AS section, text, exclusion_reason IS NULL AS include, exclusion_reason FROM r""",
    "reference_status": """WITH l AS (SELECT l_orderkey, count(DISTINCT l_linenumber % 2) AS pages, count(*) AS records, count(*) FILTER (l_partkey % 7 = 0) AS without_id, max(l_orderkey % 11 = 0 AND l_linenumber % 2 = 1) AS bad FROM lineitem GROUP BY 1)
SELECT l_orderkey, pages, records, without_id, records + (l_orderkey % 5 = 0)::INT AS reference_count, CASE WHEN bad THEN 'incomplete_http_429' ELSE 'complete_api_pagination' END AS reference_status, l_orderkey % 5 = 0 AS count_differs FROM l""",
    "works_by_doi": "SELECT '10.1/d' || (p_partkey % 1500) AS doi, min(p_partkey) AS id, min(p_name) AS title, min(p_size)::BIGINT + 1950 AS year FROM part WHERE p_partkey % 9 <> 0 GROUP BY p_partkey % 1500 HAVING count(*) = 1",
    "united_memberships": "WITH x AS (SELECT vec_id AS paper_id, label::BIGINT AS cluster, vec_id % 40 + 1980 AS year FROM embeddings) SELECT paper_id, cluster, year, 'a' AS corpus FROM x UNION ALL SELECT paper_id, NULL, year, 'b' FROM x",
    "prepared_documents": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR trim(coalesce(text, '')) = '' THEN 'skipped_empty' ELSE 'prepared' END AS status FROM documents",
    "formatted_report": "SELECT l_returnflag, count(*)::VARCHAR AS n, printf('%.3f', round(avg(l_quantity), 6)::DOUBLE) AS mean, CASE WHEN l_returnflag = 'A' THEN '1.500' ELSE '' END AS some FROM lineitem GROUP BY 1",
    "sampled_documents": "SELECT doc_id FROM documents ORDER BY sha256('42|' || doc_id), doc_id LIMIT 50",
    "prose_reasons": """WITH b AS (SELECT conv_id, turn, role = 'user' AS h, CASE WHEN role <> 'user' AND turn % 10 = 5 THEN 'table' ELSE 'text' END AS kind, CASE WHEN role = 'user' THEN CASE turn % 6 WHEN 2 THEN 'Introduction' WHEN 4 THEN 'References' ELSE 'Method' END WHEN turn % 4 = 1 THEN 'date' WHEN turn % 6 = 3 THEN 'number' ELSE 'words' END AS t FROM conversations),
w AS (SELECT *, max(t = 'Introduction') OVER (PARTITION BY conv_id ORDER BY turn) AS begun, max(t = 'Introduction') OVER (PARTITION BY conv_id) AS any_, last_value(CASE WHEN h THEN t = 'References' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS out FROM b)
SELECT conv_id, turn, CASE WHEN h THEN 'heading' WHEN any_ AND NOT begun THEN 'before_start' WHEN coalesce(out, false) THEN 'excluded_section' WHEN kind = 'table' THEN 'not_text' WHEN t = 'number' THEN 'no_letters' WHEN t = 'date' THEN 'date' ELSE '' END AS reason FROM w""",
    "plan_passages": "SELECT conv_id AS id, 0::BIGINT AS segment, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS passage, turn AS page, 'b' || turn AS block_id, 0::BIGINT AS start, length(coalesce(text, '')) AS end, sha256(coalesce(text, '')) AS text FROM conversations",
}

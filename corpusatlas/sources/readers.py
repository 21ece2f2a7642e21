"""Readers with explicit schemas and contracts. Missing text is the empty string, never null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusatlas import contracts

#: The columns a document's JSON holds.
DOCUMENT = "pdf_sha256 string, source_filename string, Key string, title string, title_source string, metadata_source string, quality_flags array<string>, blocks array<struct<id: string, type: string, page: int, bbox: array<double>, section: array<string>, text: string, html: string, include: boolean, exclusion_reason: string>>"
SEGMENTS = "id string, segments array<struct<text: string, token_count: int, section_name: string, sources: array<struct<block_id: string, page: int, start: int, end: int>>>>"


def discover(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """(path, bytes, sha256, duplicate) of the files below a folder; the first path of a content is no duplicate."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    rows = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy("sha256").orderBy("path")) > 1)


def csv_strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as strings, quotes doubled, line breaks in fields; a row with a wrong number of fields is an error."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").option("nullValue", "\0").option("emptyValue", "").option("encoding", "UTF-8").option("enforceSchema", False)
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    return reader.csv(path).na.fill("")


def records(spark: SparkSession, path: str, key: str, required: list[str]) -> DataFrame:
    """csv_strings with required columns and a key that is unique and not empty."""
    df = csv_strings(spark, path)
    # a byte order mark belongs to no column name
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if missing := sorted(set(required) - set(df.columns)):
        raise contracts.ContractError(f"missing columns: {', '.join(missing)}")
    contracts.holds(df, F.trim(key) != "", "an empty key", key)
    return contracts.unique(df, key)


def file_digest(spark: SparkSession, path: str) -> str:
    """sha256 of one file."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def checked_csv(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """csv_strings of a file whose digest is the frozen one."""
    if (found := file_digest(spark, path)) != sha256:
        raise contracts.ContractError(f"{path}: sha256 is {found}")
    return csv_strings(spark, path)


def documents(spark: SparkSession, path: str, report: DataFrame) -> DataFrame:
    """The documents that the latest report lists as extracted or cached; a row with an error stops the read."""
    contracts.holds(report, F.col("status") != "error", "an extraction failed", "pdf_sha256")
    fine = report.filter(F.col("status").isin("extracted", "cached")).select("pdf_sha256").distinct()
    return contracts.unique(spark.read.schema(DOCUMENT).option("multiLine", True).json(path).join(fine, "pdf_sha256"), "pdf_sha256")


def status_report(results: DataFrame, key: str) -> DataFrame:
    """(status, records) of a batch in which each record may fail on its own; sorted statuses, zeros left out."""
    return results.groupBy("status").agg(F.count(key).alias("records"))


def passages(plans: DataFrame, body: str = "text") -> DataFrame:
    """(id, segment, passage, page, block_id, start, end, text) of prepared plans. The spans of a segment must tile its
    text, blank lines between them."""
    seg = plans.select("id", F.posexplode("segments").alias("segment", "s"))
    tiles = F.aggregate("s.sources", F.lit(0), lambda a, x: a + x["end"] - x["start"]) + 2 * F.greatest(F.size("s.sources") - 1, F.lit(0))
    contracts.holds(seg, tiles == F.length("s.text"), "spans do not tile the text", "id", "segment")
    src = seg.withColumn("r", F.monotonically_increasing_id()).select("r", "id", "segment", F.col(f"s.{body}").alias("t"), F.posexplode("s.sources").alias("passage", "x"))
    size = F.col("x.end") - F.col("x.start")
    before = (F.sum(size + 2).over(Window.partitionBy("r").orderBy("passage")) - size - 2).cast("int")
    return src.withColumn("b", before).select("id", "segment", "passage", "x.page", "x.block_id", "x.start", "x.end", F.substring("t", F.col("b") + 1, size).alias("text"))


def works_by_doi(responses: DataFrame) -> DataFrame:
    """(doi, id, title, year) from cached responses (results: array of works); a DOI with two works is ambiguous and left
    out."""
    works = responses.select(F.explode("results").alias("w")).select(F.lower("w.doi").alias("doi"), "w.id", F.col("w.display_name").alias("title"), F.col("w.publication_year").alias("year")).filter("doi <> ''")
    one = works.groupBy("doi").agg(F.count_distinct("id").alias("n"), F.min(F.struct("id", "title", "year")).alias("w")).filter("n = 1")
    return one.select("doi", "w.*")


def reference_pages(pages: DataFrame, reported: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """pages (key, http_status, data: array<struct<id, title, year, doi>>) against reported (key, reference_count):
    observations, and per paper pages, records, those without id, status and whether the reported count differs."""
    rows = pages.select(key, "http_status", F.explode_outer("data").alias("r"))
    seen = rows.filter("r IS NOT NULL").select(F.col(key).alias("source"), F.col("r.id").alias("target"), "r.title", "r.year", "r.doi")
    n = seen.groupBy(F.col("source").alias(key)).agg(F.count("*").alias("records"), F.count_if(F.col("target").isNull()).alias("without_id"))
    p = pages.groupBy(key).agg(F.count("*").alias("pages"), F.max(F.when(F.col("http_status") != 200, F.col("http_status"))).alias("bad"))
    out = p.join(n, key, "left").na.fill(0, ["records", "without_id"]).join(reported, key, "left")
    status = F.when(F.col("bad").isNull(), "complete_api_pagination").otherwise(F.concat(F.lit("incomplete_http_"), F.col("bad").cast("string")))
    return seen, out.withColumns({"reference_status": status, "count_differs": ~F.col("records").eqNullSafe(F.col("reference_count"))}).drop("bad")


def literal_settings(source: str, names: list[str]) -> dict:
    """The literal values that a script's top level assigns to the names, read from its syntax tree; nothing is run. A name
    that is missing, assigned twice or not a literal is an error."""
    import ast

    found: dict = {}
    for node in ast.parse(source).body:
        if not isinstance(node, ast.Assign | ast.AnnAssign) or node.value is None:
            continue
        for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
            if isinstance(target, ast.Name) and target.id in names:
                if target.id in found:
                    raise contracts.ContractError(f"{target.id} is assigned twice")
                try:
                    found[target.id] = ast.literal_eval(node.value)
                except ValueError as e:
                    raise contracts.ContractError(f"{target.id} is no literal") from e
    if missing := sorted(set(names) - set(found)):
        raise contracts.ContractError(f"not assigned: {', '.join(missing)}")
    return found

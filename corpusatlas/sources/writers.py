"""Writers: report tables, never-overwritten bundles with manifests, content-addressed corpora, graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusatlas import contracts
from corpusatlas.sources.readers import file_digest


def formatted(df: DataFrame, digits: int = 10) -> DataFrame:
    """Doubles with a fixed number of digits, everything as strings, null as empty."""
    return df.select(*[F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))) if t in ("double", "float") else F.col(c).cast("string"), F.lit("")).alias(c) for c, t in df.dtypes])


def report_table(df: DataFrame, path: str, *order) -> None:
    """One CSV file in order; for report tables."""
    formatted(df.orderBy(*order)).coalesce(1).write.mode("errorifexists").option("header", True).option("quoteAll", False).csv(path)


def table_digest(df: DataFrame) -> str:
    """A digest of the rows that does not depend on their order: their number and the sums of four parts of their hashes,
    folded in the tasks."""
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    got = df.select(row.alias("h")).agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *[part(i) for i in range(4)]), 256)).first()[0]
    return got


def export_bundle(spark: SparkSession, tables: dict[str, DataFrame], root: str, stamp: str) -> str:
    """Tables and a manifest of their rows and digests in a new folder `<stamp>_<digest>`; an existing one is an error."""
    rows = [(name, df.count(), table_digest(df)) for name, df in sorted(tables.items())]
    manifest = spark.createDataFrame(rows, "artefact string, rows long, sha256 string")
    folder = f"{root}/{stamp}_{table_digest(manifest)[:8]}"
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    return folder


def verify_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest, after every table's digest has been compared with it."""
    manifest = spark.read.json(f"{folder}/manifest")
    for r in manifest.collect():
        if table_digest(spark.read.parquet(f"{folder}/{r['artefact']}")) != r["sha256"]:
            raise contracts.ContractError(f"{r['artefact']} differs from its manifest")
    return manifest


def scope_bundle(kept: DataFrame, vectors: DataFrame, key: str, root: str, least: int = 20) -> str:
    """Kept rows, their vectors and a row map (position from 0 by key) in a folder named by the kept keys' digest; an
    existing one is reused if it verifies."""
    n = kept.count()
    if n < least:
        raise contracts.ContractError(f"{n} rows are too few")
    spark = kept.sparkSession
    folder = f"{root}/{table_digest(kept.select(key))[:16]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/_SUCCESS")
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        verify_bundle(spark, folder)
        return folder
    own = contracts.covered(kept.select(key), vectors, key).join(vectors, key)
    rows = dense_index(kept.select(key), key, "embedding_row")
    tables = {"papers": kept, "vectors": own, "row_map": rows}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    listed = [(name, df.count(), table_digest(spark.read.parquet(f"{folder}/{name}"))) for name, df in tables.items()]
    spark.createDataFrame(listed, "artefact string, rows long, sha256 string").coalesce(1).write.json(f"{folder}/manifest")
    return folder


def dense_index(df: DataFrame, key: str, name: str = "row") -> DataFrame:
    """Positions from 0 in order of the key: counts of range partitions plus places in them, no window over all rows."""
    from corpusatlas.storage import keep

    x = keep(df.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("__id", F.monotonically_increasing_id()), "index")
    part = F.shiftrightunsigned("__id", 33)
    counts = x.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    at = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return x.withColumn("part", part).join(F.broadcast(before), "part").select(key, (F.col("before") + at).alias(name))


def graph_tables(nodes: DataFrame, edges: DataFrame, path: str, key: str = "node") -> None:
    """nodes with dense positions, and edges by position (a sparse matrix in coordinates)."""
    index = dense_index(nodes, key, "position")
    nodes.join(index, key).write.parquet(f"{path}/nodes")
    s, d = (index.select(F.col(key).alias(c), F.col("position").alias(p)) for c, p in (("src", "row"), ("dst", "column")))
    edges.join(s, "src").join(d, "dst").write.parquet(f"{path}/edges")


def frozen(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256) of input files, to be compared later."""
    return spark.createDataFrame([(p, file_digest(spark, p)) for p in paths], "path string, sha256 string")

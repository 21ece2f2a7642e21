"""Digests of inputs, memberships and files, and checks that stored partitions still fit their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas import contracts


def membership_fingerprints(labels: DataFrame, cluster: str, key: str) -> DataFrame:
    """(cluster, n, fingerprint): sha256 of a cluster's sorted member ids, comma-joined; independent of row order.

    Members are digested in two steps, so that a large cluster is not one string: ids fall in 4096 buckets by sha256."""
    bucket = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 3)
    parts = labels.groupBy(cluster, bucket.alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ","), 256).alias("d"))
    return parts.groupBy(cluster).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ","), 256).alias("fingerprint"))


def input_fingerprint(vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """One row: vectors, dimensions, digest over the keys, the type and the exact values (the shortest decimals that give a
    value back, so two values have one only if they are equal; null and missing dimensions count)."""
    values = F.transform(column, lambda x: F.coalesce(x.cast("string"), F.lit("null")))
    row = F.sha2(F.concat_ws(",", F.lit(dict(vectors.dtypes)[column]), F.coalesce(F.col(key).cast("string"), F.lit("null")), values), 256)
    x = vectors.select(row.alias("d"), F.size(column).alias("m"))
    parts = x.groupBy(F.substring("d", 1, 3).alias("b")).agg(F.count("*").alias("n"), F.max("m").alias("m"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("e"))
    return parts.agg(F.sum("n").alias("vectors"), F.max("m").cast("long").alias("dimensions"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "e"))), lambda v: v["e"]), ","), 256).alias("fingerprint"))


def validate_labels(labels: DataFrame, solution: str, cluster: str, key: str, allow_zero: bool = False) -> DataFrame:
    """Per solution: clusters count from 1 (0 only for isolates where allowed) without gaps, one label per key."""
    contracts.unique(labels, solution, key)
    x = labels.filter(F.col(cluster) > 0).groupBy(solution).agg(F.max(cluster).alias("hi"), F.count_distinct(cluster).alias("k"))
    contracts.holds(x, F.col("hi") == F.col("k"), "labels have gaps", solution)
    if not allow_zero:
        contracts.holds(labels, F.col(cluster) > 0, "label zero", solution, key)
    return labels


def catalog(labels: DataFrame, solution: str, cluster: str) -> DataFrame:
    """(solution, papers, unassigned, clusters, smallest, largest, singletons)."""
    sizes = labels.groupBy(solution, cluster).agg(F.count("*").alias("n"))
    own = F.when(F.col(cluster) > 0, F.col("n"))
    return sizes.groupBy(solution).agg(F.sum("n").alias("papers"), F.coalesce(F.sum(F.when(F.col(cluster) == 0, F.col("n"))), F.lit(0)).alias("unassigned"), F.count(own).alias("clusters"), F.min(own).alias("smallest"), F.max(own).alias("largest"), F.count_if(own == 1).alias("singletons"))


def attach_names(labels: DataFrame, names: DataFrame, cluster: str, key: str) -> DataFrame:
    """labels with names (cluster, fingerprint, name) where the membership is exactly the named one; 0 is unassigned."""
    prints = membership_fingerprints(labels, cluster, key)
    ok = prints.join(names, [cluster, "fingerprint"]).select(cluster, "name")
    named = labels.join(F.broadcast(ok), cluster, "left")
    return named.withColumns({"matched": F.col("name").isNotNull(), "name": F.when(F.col(cluster) == 0, "Unassigned").otherwise(F.coalesce("name", F.lit("Name pending review")))})


def adopt_labels(papers: DataFrame, historical: DataFrame, recorded: DataFrame, key: str, cluster: str, order: str) -> DataFrame:
    """Historical labels (key, order, cluster) for today's papers (key, order), after four checks: the same keys in the same
    order, one label each, labels without gaps, and members that have the recorded (cluster, fingerprint)."""
    contracts.same_rows(papers.select(key, order), historical.select(key, order), "the historical labels are of another corpus")
    contracts.unique(historical, key)
    one = F.lit("historical")
    validate_labels(historical.withColumn("__s", one), "__s", cluster, key, allow_zero=True)
    found = membership_fingerprints(historical.filter(F.col(cluster) > 0), cluster, key)
    contracts.same_rows(found.select(cluster, "fingerprint"), recorded.select(cluster, "fingerprint"), "members differ from the record")
    return historical.select(key, cluster)


def same_settings(run: DataFrame, reference: DataFrame, fields: list[str], digests: str | None = None) -> DataFrame:
    """run (one row of settings), after checks: the listed fields are those of the reference run, and no artefact digest (a
    column of arrays) occurs twice."""
    contracts.same_rows(run.select(*fields), reference.select(*fields), f"settings differ in one of {', '.join(fields)}")
    if digests:
        contracts.holds(run, F.size(digests) == F.size(F.array_distinct(digests)), "an artefact occurs twice", *fields)
    return run


def run_identity(semantic: dict, runtime: dict | None = None) -> str:
    """The id of a run's settings: a digest of those that its result depends on. Those that only change speed (runtime) have
    no part in it; a name in both is an error."""
    import hashlib
    import json

    if both := sorted(set(semantic) & set(runtime or {})):
        raise contracts.ContractError(f"settings of both kinds: {', '.join(both)}")
    return hashlib.sha256(json.dumps(semantic, sort_keys=True, ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def activate(spark, path: str, name: str, target: str, run_id: str) -> None:
    """`name` points to the run from now on: a row added to the table of pointers, earlier ones stay."""
    spark.createDataFrame([(name, target, run_id)], "name string, target string, run_id string").withColumn("activated_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def resolve(pointers: DataFrame, name: str, run_id: str | None = None) -> str:
    """Where `name` points to. A name without a pointer, or (if given) with one of another run, is an error; the newest run
    is never taken in its place. Pointers of the same instant must agree."""
    own = pointers.filter(F.col("name") == name)
    last = own.join(own.agg(F.max("activated_at").alias("activated_at")), "activated_at", "left_semi").select("target", "run_id").distinct().limit(2).collect()
    if len(last) != 1:
        raise contracts.ContractError(f"{name}: {'no pointer' if not last else 'pointers of one instant differ'}")
    if run_id is not None and last[0]["run_id"] != run_id:
        raise contracts.ContractError(f"{name} points to run {last[0]['run_id']}")
    return last[0]["target"]

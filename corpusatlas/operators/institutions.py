"""Institution evidence, rankings and cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas.operators.ranking import competition_rank


def paper_institutions(evidence: DataFrame, grouping: DataFrame | None = None) -> DataFrame:
    """Distinct (paper_id, institution_id) of evidence rows; grouping (institution_id, parent_id) maps campuses."""
    if grouping is not None:
        evidence = evidence.join(grouping, "institution_id", "left").withColumn("institution_id", F.coalesce("parent_id", "institution_id")).drop("parent_id")
    return evidence.select("paper_id", "institution_id").distinct()


def ranking(links: DataFrame, registry: DataFrame, list_ids: bool = True) -> DataFrame:
    """Institutions by distinct papers: papers, share of all papers in percent, competition rank, ids of the papers."""
    ids = [F.array_join(F.array_sort(F.collect_list("paper_id")), ";").alias("paper_ids")] if list_ids else []
    n = links.groupBy("institution_id").agg(F.count("*").alias("papers"), *ids)
    total = links.select("paper_id").distinct().agg(F.count("*").alias("total"))
    out = n.crossJoin(F.broadcast(total)).withColumn("share_pct", 100.0 * F.col("papers") / F.col("total")).drop("total")
    return competition_rank(out, "papers").join(registry, "institution_id", "left")


def cluster_matrix(links: DataFrame, clusters: DataFrame, labels: list[str]) -> DataFrame:
    """Papers of each institution per cluster, a column each (zeros kept), with shares of the row."""
    counts = links.join(clusters, "paper_id").groupBy("institution_id").pivot("cluster", labels).agg(F.count("paper_id")).na.fill(0)
    total = sum((F.col(f"`{c}`") for c in labels[1:]), F.col(f"`{labels[0]}`"))
    return counts.withColumns({"total": total} | {f"{c}_pct": 100.0 * F.col(f"`{c}`") / total for c in labels})


def names_by_paper(links: DataFrame, registry: DataFrame) -> DataFrame:
    """(paper_id, institutions, names): the sorted distinct names, joined by `; `."""
    named = links.join(registry, "institution_id").select("paper_id", "name").distinct()
    return named.groupBy("paper_id").agg(F.count("*").alias("institutions"), F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("names"))

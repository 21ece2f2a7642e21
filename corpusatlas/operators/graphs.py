"""Graphs as (src, dst[, weight]) tables: components, degrees, communities and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas import contracts
from corpusatlas.operators.ranking import top_by
from corpusatlas.storage import keep


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct unordered pairs (src < dst). A loop is an error."""
    contracts.holds(edges, F.col(src) != F.col(dst), "an edge leads to its own source", src, dst)
    return edges.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable over edges in either direction. Nodes without edges are not listed.

    Each round hangs every neighbourhood below its least node (minima are aggregated before the shuffle) and writes the
    new edges to shared storage; paths at least halve, so rounds grow with the logarithm of the longest one."""
    e = keep(edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).filter("hi <> lo").distinct(), "edges")
    for _ in range(most_rounds):
        ways = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = ways.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        raised = ways.join(low, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        least = raised.groupBy("hi").agg(F.min("lo").alias("m"))
        lowered = raised.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
        now = keep(lowered.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        settled = now.count() == e.count() and now.exceptAll(e).isEmpty()
        e = now
        if settled:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
    raise RuntimeError("components did not settle")


def with_components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """nodes with component (isolates are their own) and component_size."""
    out = nodes.join(connected_components(edges).select(F.col("node").alias(node), F.col("root").alias("component")), node, "left").withColumn("component", F.coalesce("component", node))
    return out.join(out.groupBy("component").agg(F.count("*").alias("component_size")), "component")


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """in_degree and out_degree of directed edges, and degree in the undirected graph; zeros for isolates."""
    into = edges.groupBy(F.col("dst").alias(node)).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("src").alias(node)).agg(F.count("*").alias("out_degree"))
    both = undirected(edges).select(F.explode(F.array("src", "dst")).alias(node)).groupBy(node).agg(F.count("*").alias("degree"))
    names = ["in_degree", "out_degree", "degree"]
    return nodes.join(into, node, "left").join(out, node, "left").join(both, node, "left").na.fill(0, names)


def graph_summary(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """One row: nodes, undirected edges, components, isolates, largest component, least, median and greatest degree."""
    d = degrees(nodes, edges, node)
    c = with_components(nodes.select(node), edges, node)
    a = d.agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.count_if(F.col("degree") == 0).alias("isolates"), F.min("degree").alias("min_degree"), F.median("degree").alias("median_degree"), F.max("degree").alias("max_degree"))
    return a.crossJoin(c.agg(F.count_distinct("component").alias("components"), F.max("component_size").alias("largest")))


def modularity(labels: DataFrame, edges: DataFrame, gamma: float = 1.0, weight: str | None = None) -> DataFrame:
    """One row for labels (node, cluster): within_fraction of edge weight, and the objective within_fraction - gamma *
    sum of squared degree shares. Edges are unordered pairs."""
    w = F.col(weight) if weight else F.lit(1.0)
    ends = edges.select("src", "dst", w.alias("w")).join(labels.select(F.col("node").alias("src"), F.col("cluster").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("cluster").alias("b")), "dst")
    pairs = ends.groupBy("a", "b").agg(F.sum("w").alias("w"))
    inside = pairs.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("total"))
    strength = pairs.select(F.explode(F.array("a", "b")).alias("cluster"), "w").groupBy("cluster").agg(F.sum("w").alias("s"))
    squares = strength.agg(F.sum(F.col("s") * F.col("s")).alias("squares"))
    share = F.col("inside") / F.col("total")
    return inside.crossJoin(squares).select(share.alias("within_fraction"), (share - gamma * F.col("squares") / (4 * F.col("total") * F.col("total"))).alias("objective"))


def community_tables(nodes: DataFrame, edges: DataFrame, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """For nodes (node, cluster): members with degrees, within_degree and external_fraction, and the `top`
    representatives of each cluster by within_degree, in_degree and node."""
    pairs = undirected(edges)
    side = nodes.select("node", "cluster")
    ends = pairs.join(side.select(F.col("node").alias("src"), F.col("cluster").alias("a")), "src").join(side.select(F.col("node").alias("dst"), F.col("cluster").alias("b")), "dst")
    own = ends.filter("a = b").select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("within_degree"))
    members = degrees(side, edges).join(own, "node", "left").na.fill(0, ["within_degree"])
    members = members.withColumn("external_fraction", F.when(F.col("degree") > 0, 1 - F.col("within_degree") / F.col("degree")))
    return members, top_by(members, ["cluster"], top, F.desc("within_degree"), F.desc("in_degree"), F.asc("node"))


def neighbourhood(edges: DataFrame, nodes: DataFrame, node: str = "node", title: str = "title") -> DataFrame:
    """Each edge from both of its ends, with both titles: node, direction, other, title, other_title."""
    both = edges.select(F.col("src").alias(node), F.lit("outgoing").alias("direction"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias(node), F.lit("incoming").alias("direction"), F.col("src").alias("other")))
    return both.join(nodes.select(node, title), node).join(nodes.select(F.col(node).alias("other"), F.col(title).alias(f"other_{title}")), "other")

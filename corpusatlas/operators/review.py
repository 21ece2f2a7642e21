"""Tables that people review: proposals per cluster, curated choices bound to exact memberships, cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas import contracts
from corpusatlas.operators.provenance import membership_fingerprints
from corpusatlas.operators.ranking import top_by


def example_roles(scored: DataFrame, cluster: str, key: str, score: str, central: int = 3, boundary: int = 2, others: int = 2, seed: int = 42) -> DataFrame:
    """(cluster, key, roles): the members with the highest scores, those with the lowest, and some of the rest by a seeded
    hash; a member of several roles has them joined."""
    best = top_by(scored, [cluster], central, F.desc(score), F.asc(key)).withColumn("role", F.lit("central"))
    least = top_by(scored, [cluster], boundary, F.asc(score), F.asc(key)).withColumn("role", F.lit("boundary"))
    rest = scored.join(best.select(key), key, "left_anti").join(least.select(key), key, "left_anti")
    some = top_by(rest, [cluster], others, F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256), F.asc(key)).withColumn("role", F.lit("random"))
    every = best.select(cluster, key, "role").unionByName(least.select(cluster, key, "role")).unionByName(some.select(cluster, key, "role"))
    order = F.when(F.col("role") == "central", 0).when(F.col("role") == "boundary", 1).otherwise(2)
    return every.groupBy(cluster, key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "role"))), lambda x: x["role"]), "; ").alias("roles"))


def with_proposals(clusters: DataFrame, proposals: DataFrame) -> DataFrame:
    """clusters (solution, cluster, membership_id) with the labels proposed for exactly these members."""
    return clusters.join(proposals, ["solution", "cluster", "membership_id"], "left").withColumn("proposed_label", F.coalesce("proposed_label", F.lit("Name pending review")))


def cards(clusters: DataFrame, terms: DataFrame, examples: DataFrame) -> DataFrame:
    """(cluster, card): Markdown with the size, the ranked terms and the examples of each cluster."""
    t = terms.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("terms"))
    e = examples.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "roles"))), lambda x: F.concat(F.lit("- "), x["key"].cast("string"), F.lit(" ("), x["roles"], F.lit(")"))), "\n").alias("examples"))
    x = clusters.join(t, "cluster", "left").join(e, "cluster", "left")
    return x.select("cluster", F.concat_ws("\n\n", F.concat(F.lit("## Cluster "), F.col("cluster").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" papers")), F.col("terms"), F.col("examples")).alias("card"))


def validate_choices(choices: DataFrame, labels: DataFrame, cluster: str = "cluster", key: str = "key", per_cluster: int = 2) -> DataFrame:
    """choices (cluster, key, fingerprint) hold for exactly these memberships, `per_cluster` distinct members in each."""
    prints = membership_fingerprints(labels, cluster, key).select(cluster, F.col("fingerprint").alias("__now"))
    x = choices.join(prints, cluster, "left")
    contracts.holds(x, F.col("fingerprint") == F.col("__now"), "a choice for another membership", cluster, key)
    contracts.covered(choices.select(cluster, key), labels.select(cluster, key), cluster, key)
    contracts.holds(choices.groupBy(cluster).agg(F.count_distinct(key).alias("n")), F.col("n") == per_cluster, "wrong number of choices", cluster)
    return choices


def verify_excerpts(excerpts: DataFrame, texts: DataFrame, key: str = "key") -> DataFrame:
    """excerpts (key, start, excerpt) stand at their offsets in texts (key, text)."""
    x = excerpts.join(texts, key, "left")
    return contracts.holds(x, F.substring("text", F.col("start") + 1, F.length("excerpt")) == F.col("excerpt"), "an excerpt is not where it says", key)


def balanced_groups(costs: DataFrame, key: str, cost: str, groups: int) -> DataFrame:
    """(key, cost, group): greatest cost first, each to the group with the least so far, ties by key and group. The fold is
    sequential, in one task over (key, cost); for work lists, not corpora."""
    kinds = dict(costs.dtypes)

    def run(pdf):
        import heapq

        heap, out = [(0, g) for g in range(groups)], []
        ordered = pdf.sort_values([cost, key], ascending=[False, True], kind="stable")
        for c in ordered[cost]:
            total, g = heapq.heappop(heap)
            out.append(g)
            heapq.heappush(heap, (total + c, g))
        return ordered.assign(group=out)[[key, cost, "group"]]

    return costs.select(key, cost).groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: run(pdf[[key, cost]]), f"{key} {kinds[key]}, {cost} {kinds[cost]}, group int")


def title_search(rows: DataFrame, phrase: str, *columns: str) -> DataFrame:
    """Rows with the phrase, in any case and taken literally, in one of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(phrase.lower()))
    return rows.filter(found)

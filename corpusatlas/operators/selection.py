"""Choosing the corpus: audited exclusions, reviewed duplicates, eligibility and order-dependent deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusatlas import contracts
from corpusatlas.operators.graphs import connected_components
from corpusatlas.operators.grouped import fold_groups
from corpusatlas.storage import keep


def exclude(papers: DataFrame, decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """papers without those that decisions (key, exclude) exclude, and an audit row for each decision."""
    contracts.unique(decisions, key)
    kept = papers.join(decisions.filter("exclude").select(key), key, "left_anti")
    here = papers.select(key).distinct().withColumn("__here", F.lit(True))
    status = F.when(F.col("__here").isNull(), "not_in_loaded_corpus").when(F.col("exclude"), "excluded").otherwise("kept_by_decision")
    return kept, decisions.join(here, key, "left").withColumn("status", status).drop("__here")


def drop_reviewed_duplicates(papers: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Drops rows of mapping (duplicate_key, canonical_key) whose canonical row is present. Mappings are direct."""
    chains = mapping.join(mapping.select(F.col("duplicate_key").alias("canonical_key")), "canonical_key", "left_semi")
    contracts.holds(chains, F.lit(False), "a canonical row is itself a duplicate", "duplicate_key", "canonical_key")
    here = mapping.join(papers.select(F.col(key).alias("canonical_key")), "canonical_key", "left_semi")
    return papers.join(here.select(F.col("duplicate_key").alias(key)), key, "left_anti")


def first_claims(rows: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """rows in order keep or lose: a row is rejected if an earlier *kept* row holds one of its keys. Adds `claimed_by`
    (the first key that was taken: its name) and `kept`.

    Only kept rows hold keys, so a rejected row must not block a later one; two independent dedup passes would be wrong.
    Rows that share all keys follow their first, so only that one takes part; those are grouped by connected shared keys
    and folded in order within each component. Empty keys claim nothing."""
    slots = keep(rows.select(order, *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]), "claims")
    firsts = slots.groupBy(*keys).agg(F.min(order).alias(order))
    keyed = firsts.select(F.col(order).alias("node"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in keys])).alias("kv")).filter("kv.v <> ''").select("node", F.xxhash64("kv.k", "kv.v").alias("h"))
    least = keyed.groupBy("h").agg(F.min("node").alias("least"))
    edges = keyed.join(least, "h").filter("node <> least").select(F.col("node").alias("src"), F.col("least").alias("dst")).distinct()
    roots = connected_components(edges)
    grouped = keep(firsts.join(roots.withColumnRenamed("node", order), order, "left").select("root", order, *keys), "roots")

    def fold(_, rows):
        held = [set() for _ in keys]
        for _, *r in rows:
            if not any(v and v in h for v, h in zip(r[1:], held, strict=True)):
                yield tuple(r)
                for v, h in zip(r[1:], held, strict=True):
                    h.add(v)

    kinds = dict(firsts.dtypes)
    # rows without a shared key are components of one: they keep what they have
    folded = fold_groups(grouped.filter("root IS NOT NULL"), "root", [order], fold, f"{order} {kinds[order]}, " + ", ".join(f"{k} string" for k in keys))
    holders = keep(folded.unionByName(grouped.filter("root IS NULL").drop("root")), "holders")
    # a row loses to the first of its keys that an earlier kept row holds
    claimed = F.lit("")
    for k in reversed(keys):
        slots = slots.join(holders.filter(F.col(k) != "").select(k, F.col(order).alias(f"__{k}")), k, "left")
        claimed = F.when(F.col(f"__{k}") < F.col(order), k).otherwise(claimed)
    out = slots.select(order, claimed.alias("claimed_by"))
    return rows.join(out, order).withColumn("kept", F.col("claimed_by") == "")


def eligibility(rows: DataFrame, rules: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """One reason per row, the first rule that applies; empty if none."""
    out = F.lit("")
    for reason, condition in reversed(rules):
        out = F.when(condition, reason).otherwise(out)
    return rows.withColumn(name, out)


def clean_records(rows: DataFrame, order: str, rules: list[tuple[str, Column]], keys: list[str]) -> DataFrame:
    """The eligibility cascade, then first claims among the eligible; `reason` is empty for kept rows."""
    judged = eligibility(rows, rules)
    fine = first_claims(judged.filter("reason = ''"), order, keys)
    dup = F.concat(F.lit("duplicate_"), F.col("claimed_by"))
    return fine.withColumn("reason", F.when(F.col("kept"), "").otherwise(dup)).drop("claimed_by", "kept").unionByName(judged.filter("reason <> ''"))


def review_flags(rows: DataFrame, flags: list[tuple[str, Column]], name: str = "flags") -> DataFrame:
    """The names of the flags that hold, joined by `;`."""
    return rows.withColumn(name, F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags])), ";"))


def reproducible_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones every time: the first by a seeded hash of the key."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256), key).limit(n)


def close_to(column: Column, value: float, tolerance: float = 1e-12) -> Column:
    return F.abs(column - value) <= tolerance


def numbered(rows: DataFrame, order: list, keys: list[str], name: str = "row") -> DataFrame:
    """Positions from 1 within keys, by a total order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

"""How far two partitions of the same items agree: contingency, adjusted Rand index, adjusted mutual information, matching.

All of it works on the contingency table, whose size depends on the numbers of clusters.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, n) of items with two labels."""
    return pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def _choose2(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def _margins(table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table.groupBy("a").agg(F.sum("n").alias("na")), table.groupBy("b").agg(F.sum("n").alias("nb")), table.agg(F.sum("n").alias("total"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """One row: ari; 1 where both partitions are trivial."""
    rows, columns, total = _margins(table)
    parts = table.agg(F.sum(_choose2(F.col("n"))).alias("i")).crossJoin(rows.agg(F.sum(_choose2(F.col("na"))).alias("x"))).crossJoin(columns.agg(F.sum(_choose2(F.col("nb"))).alias("y"))).crossJoin(total)
    expected = F.col("x") * F.col("y") / _choose2(F.col("total"))
    top = (F.col("x") + F.col("y")) / 2 - expected
    return parts.select(F.when((F.col("total") < 2) | (F.abs(top) < 1e-300), 1.0).otherwise((F.col("i") - expected) / top).alias("ari"))


def log_factorial(n: Column) -> Column:
    """ln n!: a table below 20, Stirling's series from there (its error is under 1e-13)."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(20)])
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    return F.when(n < 20, F.get(small, n.cast("int"))).otherwise(series)


def adjusted_mutual_information(table: DataFrame) -> DataFrame:
    """One row: mi, expected_mi, ami (arithmetic mean of the entropies; 1 where both are trivial)."""
    rows, columns, total = _margins(table)
    full = table.join(rows, "a").join(columns, "b").crossJoin(F.broadcast(total))
    n, na, nb, big = (F.col(c).cast("double") for c in ("n", "na", "nb", "total"))
    mi = full.agg(F.sum(n / big * F.log(big * n / (na * nb))).alias("mi"))
    entropy = lambda m, c: m.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total")))).alias(f"h_{c}"))
    # every pair of clusters, with every overlap that is possible for it
    grid = rows.crossJoin(F.broadcast(columns)).crossJoin(F.broadcast(total)).withColumn("k", F.explode(F.sequence(F.greatest(F.lit(1), F.col("na") + F.col("nb") - F.col("total")), F.least("na", "nb"))))
    k = F.col("k")
    lf = log_factorial
    chance = F.exp(lf(F.col("na")) + lf(F.col("nb")) + lf(F.col("total") - F.col("na")) + lf(F.col("total") - F.col("nb")) - lf(F.col("total")) - lf(k) - lf(F.col("na") - k) - lf(F.col("nb") - k) - lf(F.col("total") - F.col("na") - F.col("nb") + k))
    expected = grid.agg(F.sum(k / big * F.log(big * k / (na * nb)) * chance).alias("expected_mi"))
    out = mi.crossJoin(entropy(rows, "na")).crossJoin(entropy(columns, "nb")).crossJoin(expected)
    top = (F.col("h_na") + F.col("h_nb")) / 2 - F.col("expected_mi")
    return out.select("mi", "expected_mi", F.when(F.abs(top) < 1e-15, 1.0).otherwise((F.col("mi") - F.col("expected_mi")) / top).alias("ami"))


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one matching of rows to columns with the greatest total gain (shortest augmenting paths)."""
    g = gain if gain.shape[0] <= gain.shape[1] else gain.T
    n, m = g.shape
    cost = g.max(initial=0) - g.astype(float)
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        best, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while owner[j]:
            used[j] = True
            row = owner[j]
            free = ~used[1:]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = free & (reduced < best[1:])
            best[1:][better], way[1:][better] = reduced[better], j
            k = int(np.argmin(np.where(free, best[1:], np.inf))) + 1
            delta = best[k]
            u[owner[used]] += delta
            v[used] -= delta
            best[1:][free] -= delta
            j = k
        while j:
            owner[j], j = owner[way[j]], way[j]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted(pairs if g is gain else [(b, a) for a, b in pairs])


def matching(table: DataFrame) -> DataFrame:
    """(a, b, common, na, nb, jaccard) of the matched clusters of the best one-to-one matching; the contingency table goes
    to one task."""
    def solve(pdf):
        import pandas as pd

        wide = pdf.pivot(index="a", columns="b", values="n").fillna(0).sort_index().sort_index(axis=1)
        got = assignment(wide.to_numpy())
        na, nb = wide.sum(axis=1).to_numpy(), wide.sum(axis=0).to_numpy()
        rows = [(wide.index[i], wide.columns[j], int(wide.iat[i, j]), int(na[i]), int(nb[j])) for i, j in got]
        out = pd.DataFrame(rows, columns=["a", "b", "common", "na", "nb"])
        out["jaccard"] = out["common"] / (out["na"] + out["nb"] - out["common"])
        return out

    kinds = dict(table.dtypes)
    return table.groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: solve(pdf[["a", "b", "n"]]), f"a {kinds['a']}, b {kinds['b']}, common long, na long, nb long, jaccard double")


def partition_agreement(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: ari, matched items under the best matching, their fraction."""
    table = contingency(pairs, a, b)
    m = matching(table).agg(F.sum("common").alias("matched"))
    return adjusted_rand(table).crossJoin(m).crossJoin(table.agg(F.sum("n").alias("items"))).withColumn("matched_fraction", F.col("matched") / F.col("items"))


def compare_solutions(solutions: DataFrame) -> DataFrame:
    """Pairs of solutions (solution, method, k) worth comparing: the same count across methods, adjacent counts within."""
    x, y = solutions.alias("x"), solutions.alias("y")
    rule = (F.col("x.method") < F.col("y.method")) & (F.col("x.k") == F.col("y.k")) | (F.col("x.method") == F.col("y.method")) & (F.col("y.k") == F.col("x.k") + 1)
    return x.join(y, rule).select(F.col("x.solution").alias("first"), F.col("y.solution").alias("second"), F.when(F.col("x.method") == F.col("y.method"), "adjacent_counts").otherwise("same_count").alias("kind"))


def coverage_sensitivity(labels: DataFrame, settings: list, a: str = "a", b: str = "b") -> DataFrame:
    """(setting, compared, ari, a_k, b_k) of two partitions at each setting, over the items that both assign (label above 0);
    the numbers of clusters are those of all items."""
    out = None
    for s in settings:  # a sweep's few settings
        own = labels.filter(F.col("setting") == s)
        both = own.filter((F.col(a) > 0) & (F.col(b) > 0))
        k = own.agg(F.count_distinct(F.when(F.col(a) > 0, F.col(a))).alias("a_k"), F.count_distinct(F.when(F.col(b) > 0, F.col(b))).alias("b_k"))
        one = adjusted_rand(contingency(both, a, b)).crossJoin(both.agg(F.count("*").alias("compared"))).crossJoin(k)
        one = one.select(F.lit(s).alias("setting"), "compared", "ari", "a_k", "b_k")
        out = one if out is None else out.unionByName(one)
    return out

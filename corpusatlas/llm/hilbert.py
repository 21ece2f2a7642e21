"""Shards cut from a Hilbert-curve order of quantised metadata, so that files prune on several dimensions at once.

Each dimension becomes a number of `bits` bits (its rank among quantile cuts, or a category's place in the cumulated
counts), the numbers become an index on the Hilbert curve, and the rows in order of (index, text checksum, doc_id, row)
are cut into runs. Only DataFrame operations: the curve is a fold over (bit, dimension) steps.

The rank in the whole order is a row's place in its range partition plus the counts of the partitions before it. Range
partitioning by the full order splits a hot index among tasks.

The table may hold: nulls in any column (a null dimension ranks lowest, a null text counts no bytes and has checksum 0,
null doc_ids sort first); repeated rows and doc_ids (each row gets a slot of its own); texts of any length (only their size
and checksum are used); nothing (no row); any other columns (kept by write_shards, but for one named `shard`, which it
writes; not read by the rest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusatlas.llm.common import free_name, materialise


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """The curve index of a point with coordinates of `bits` bits each (Skilling's transform, most significant first)."""
    n, point = len(dims), F.array(*[d.cast("long") for d in dims])
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        own, first, p = F.get(x, i), F.get(x, F.lit(0)), step["q"] - 1
        swap = first.bitwiseXOR(own).bitwiseAND(p)
        return F.transform(x, lambda v, j: F.when(own.bitwiseAND(q) != 0, F.when(j == 0, v.bitwiseXOR(p)).otherwise(v)).when(i == 0, v).when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v))

    x = F.aggregate(steps, point, undo)
    # Gray code: each coordinate takes in the ones before it
    x = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)) if n > 1 else F.array().cast("array<int>"), x, lambda a, i: F.transform(a, lambda v, j: F.when(j == i, v.bitwiseXOR(F.get(a, i - 1))).otherwise(v)))
    high = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])

    def spread(a: Column) -> Column:
        t = F.aggregate(high, F.lit(0).cast("long"), lambda acc, q: F.when(F.get(a, F.lit(n - 1)).bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc))
        return F.transform(F.array(t), lambda m: F.transform(a, lambda v: v.bitwiseXOR(m)))[0]

    x = F.transform(F.array(x), spread)[0]
    order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    return F.transform(F.array(x), lambda a: F.aggregate(order, F.lit(0).cast("long"), lambda acc, s: acc * 2 + F.call_function("shiftright", F.get(a, s["i"]), s["b"]).bitwiseAND(F.lit(1).cast("long"))))[0]


def number_rank(df: DataFrame, column: str, bits: int, accuracy: int = 4096) -> Column:
    """A number's place among 2**bits quantile cuts."""
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.select(F.percentile_approx(column, cuts, accuracy)).first()[0] or []
    edges = sorted(set(found))
    below = F.array(*[F.lit(x).cast("long") for x in edges]) if edges else F.array().cast("array<bigint>")
    return F.coalesce(F.size(F.filter(below, lambda e: e < F.col(column))), F.lit(0))


def category_rank(df: DataFrame, column: str, bits: int, most: int = 4096) -> tuple[DataFrame, Column]:
    """(value, rank) of the `most` commonest values: the middle of a value's stretch of the cumulated counts; and the rank
    of any other value, which a hash deals over the stretch that is left."""
    top = (1 << bits) - 1
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    common = counts.orderBy(F.desc("count"), column).limit(most)
    total = counts.agg(F.sum("count")).first()[0] or 1
    w = Window.orderBy(column)  # at most `most` rows
    ranks = common.select(F.col(column).alias("value"), F.least(F.floor((F.sum("count").over(w) - F.col("count") / 2) / total * (top + 1)), F.lit(top)).alias("rank"))
    start = min(top, int((common.agg(F.sum("count")).first()[0] or 0) / total * (top + 1)))
    return ranks, F.lit(start) + F.pmod(F.xxhash64(column), F.lit(top + 1 - start))


def shard_by_hilbert(docs: DataFrame, shards: int = 24, categories: tuple[str, ...] = ("lang", "source"), numbers: tuple[str, ...] = (), bits: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, shard, slot and the carried columns, over all documents; shard sizes in rows
    differ by one at most."""
    # categories are few: their ranks go to all tasks as a broadcast table of at most `most` rows each
    base = docs.select("doc_id", *carry, *categories, *numbers, (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    base, dims = materialise(base, "shard-rows"), []
    ranked = base
    for c in categories:
        name = free_name(ranked, f"rank_{c}")
        ranks, other = category_rank(base, c, bits)
        ranked = ranked.join(F.broadcast(ranks.toDF(f"{name}v", name)), F.col(c) == F.col(f"{name}v"), "left").drop(f"{name}v")
        dims.append(F.when(F.col(c).isNull(), 0).otherwise(F.coalesce(F.col(name), other)))
    dims += [number_rank(base, c, bits) for c in (*numbers, "size")]
    last = free_name(docs, "place")
    keys = ["hilbert", "text_crc32", "doc_id", last]
    ranked = ranked.select("doc_id", *carry, "size", "text_crc32", hilbert_index(dims, bits).alias("hilbert"), F.monotonically_increasing_id().alias(last))
    ordered = ranked.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # a partition's number and a row's place in it, as Spark numbers rows: (partition << 33) + place
    place = materialise(ordered.drop(last).withColumn("__id", F.monotonically_increasing_id()), "shard-order")
    part, at = F.shiftrightunsigned("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = place.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row per partition
    w = Window.orderBy("part")
    before = counts.select("part", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.col("before") + F.col("at")
    # the first `extra` shards hold one row more
    small, extra = F.floor(F.col("total") / shards), F.col("total") % shards
    edge = extra * (small + 1)
    shard = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(extra + F.floor((rank - edge) / F.greatest(small, F.lit(1))))
    first = F.when(F.col("shard") < extra, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - extra) * small)
    out = place.withColumns({"part": part, "at": at}).join(F.broadcast(before), "part")
    return out.withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", "hilbert", "shard", (rank - first).cast("long").alias("slot"), *carry)


def write_shards(docs: DataFrame, path: str, shards: int = 24, rows_per_file: int = 100_000, **settings) -> None:
    """The documents themselves, a folder a shard, in the order of the curve; each row once, whatever its id. A shard's
    files are runs of `rows_per_file` rows, so the parquet statistics of every dimension prune files."""
    row, shard, slot, run = (free_name(docs, c) for c in ("row", "at_shard", "at_slot", "run"))
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    order = shard_by_hilbert(numbered, shards, carry=(row,), **settings).select(row, F.col("shard").alias(shard), F.col("slot").alias(slot))
    dealt = numbered.join(order, row).withColumn(run, F.floor(F.col(slot) / rows_per_file))
    named = dealt.repartitionByRange(max(shards, -(-numbered.count() // rows_per_file)), shard, run).sortWithinPartitions(shard, slot)
    named.select(*docs.columns, F.col(shard).alias("shard")).write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)

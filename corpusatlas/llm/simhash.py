"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most three bits are linked. Cut in two segments of 32 bits, such a pair has one
segment that differs in at most one bit. So each segment is indexed whole, and once for each bit with that bit as a
wildcard: on one side where the bit is 0, on the other where it is 1. An equality join on (segment, wildcard, value) meets
every pair; the join condition verifies the distance and keeps one meeting of each pair.

Only distinct fingerprints are joined: copies cost nothing. A fingerprint has at most 43,744 others within three bits, so
links are bounded per fingerprint whatever the size of a group; buckets are never collected, and a join's hot bucket is
split by the engine. Components are labels lowered over the links (iterative, each round written to the shared folder).

Three bits of 64 find texts that hardly differ. For near copies by similarity (`near_groups`, `drop_near_duplicates`:
shingles of five words, Jaccard similarity of 0.8 or more) the same index takes fingerprints of 12 segments of 28 bits. A
pair is met if any segment differs in one bit at most, which is certain up to 23 differing bits of 336 (similarity 0.92
or so) and likely beyond; candidates are verified on their sketches, then on the shingles themselves. Links that the
fingerprints leave out between two of the groups so found are completed exactly: in one order of all shingles, a pair of
0.8 or more has one in common among the first fifth of each (`met_by_prefix`); they too are verified on the shingles.
What is on disk at a time is bounded: variants and prefixes are shuffled in rounds, a quarter each, texts only where their
shingles are compared, and a table goes with the last step that reads it.

The tables may hold: null texts (no words: fingerprint zero; for near_groups all texts without words are equal), null
doc_ids (near_duplicates: they take part in links; the smallest known id names the component, null if there is none;
drop_near_duplicates: they give way to known ones), repeated rows and doc_ids (each row is judged by its own text; of
equal rows one stays), texts of any length (work grows with the words), nothing (no row), any other columns (kept by
drop_near_duplicates, not read by the others).
"""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusatlas.llm.common import cache, free_name, let, map_arrow, materialise
from corpusatlas.llm.decontaminate import bit_table, places
from corpusatlas.operators.graphs import connected_components
from corpusatlas.storage import free_shuffles, release

SEGMENT = 32
LOW = (1 << SEGMENT) - 1
#: In how many parts, one after the other, the largest shuffles of near_groups are done.
ROUNDS = 4


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    # bytes: A-Z lower-cased, split at ASCII white space only, as str methods would not
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = np.array([xxh64_intdigest(b" ".join(w[i : i + size]), seed) for i in range(max(1, len(w) - size + 1))], dtype="<u8")
    votes, step = np.zeros(64, dtype=np.int64), 1 << 14
    for i in range(0, len(h), step):
        votes += np.unpackbits(h[i : i + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def step(batch):
        import pyarrow as pa

        fps = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, fp long")


def signatures(fps: DataFrame, one: int) -> DataFrame:
    """The index rows of one side: (key, fp). Key: segment, wildcard bit (32: none) and the segment's value without it."""
    long = lambda v: F.lit(v).cast("long")
    rows = fps.select("fp", F.explode(F.array(long(0), long(1))).alias("s")).select("fp", "s", F.when(F.col("s") == 0, F.col("fp").bitwiseAND(long(LOW))).otherwise(F.shiftrightunsigned("fp", SEGMENT)).alias("v"))
    wild = F.filter(F.transform(F.array(*[F.lit(b) for b in range(SEGMENT)]), lambda b: F.struct(b.alias("b"), F.call_function("shiftleft", long(1), b).alias("m"))), lambda x: (F.col("v").bitwiseAND(x["m"]) != 0) == F.lit(bool(one)))
    keys = F.concat(F.transform(wild, lambda x: (F.col("s") * 64 + x["b"]) * long(1 << SEGMENT) + F.col("v").bitwiseAND(F.bitwise_not(x["m"]))), F.array((F.col("s") * 64 + SEGMENT) * long(1 << SEGMENT) + F.col("v")))
    return rows.select(F.explode(keys).alias("key"), "fp")


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """(a, b): each pair of distinct fingerprints at `most` (three or fewer) differing bits, once."""
    if most > 3:
        raise ValueError("two segments find three differing bits at most")
    a, b = signatures(fps, 0).withColumnRenamed("fp", "a"), signatures(fps, 1).withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    bits = lambda c: F.bit_count(c)
    whole = F.shiftrightunsigned("key", SEGMENT).bitwiseAND(F.lit(63).cast("long")) == SEGMENT
    upper = F.shiftrightunsigned("key", SEGMENT + 6) == 1
    # the wildcard keys meet in one order of the sides only; the whole keys in both. Segment 1 counts if 0 has not met
    once = (~whole | (F.col("a") < F.col("b"))) & (~upper | (bits(x.bitwiseAND(F.lit(LOW).cast("long"))) > 1))
    # a merge join: the planner takes a table of signatures for as small as its fingerprints, and would broadcast it
    return a.join(b.hint("merge"), "key").filter((bits(x) <= most) & once).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 3, most: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    rows = materialise(fingerprints(docs, size), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(distinct.select("fp"), most).toDF("src", "dst"))
    labelled = distinct.join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    # only fingerprints in a component of several need more than their own least id
    names = labelled.join(lowest, "root").select("fp", "component_id")
    return rows.join(names, "fp").select("doc_id", "fp", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Near copies by similarity: longer fingerprints, more segments, verified by the shingles themselves.

def lane(k: int) -> np.uint64:
    """What sets the k-th 64 bits of a long fingerprint apart: multiples of the golden ratio's fraction."""
    return np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)


class WordHashes(dict):
    """Hashes of the words that a worker has met; emptied when it grows beyond `most`."""

    def __init__(self, most: int = 100_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KNOWN = cache(WordHashes())


def known_words() -> dict:
    """The worker's hashes of words."""
    return _KNOWN


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The hashes of the distinct shingles; of the whole sequence if it is shorter; none without a word."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter((_KNOWN[x] for x in w), np.uint64, len(w))
    n = max(1, len(w) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(w))):
        out = mixed(out + h[i : i + n] + np.uint64(i + 1))
    return np.unique(out)


def long_fingerprint(h: np.ndarray, segments: int, bits: int) -> np.ndarray:
    """`segments` numbers of `bits` bits; a bit is 1 if it is set in over half of the distinct shingles' hashes."""
    lanes = -(-segments * bits // 64)
    votes, step = np.zeros((lanes, 64), np.int64), 1 << 12
    for i in range(0, len(h), step):
        part = h[i : i + step]
        for k in range(lanes):
            x = mixed(part + lane(k)).view(np.uint8).reshape(-1, 8)
            votes[k] += np.unpackbits(x, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    out = (votes.ravel()[: segments * bits] * 2 > len(h)).reshape(segments, bits)
    return out @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def prefix_length(n: int, similarity: float) -> int:
    """How many of n shingles hold one that is common with any set of that Jaccard similarity, in one order of all."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def common_shingles(rows: DataFrame, size: int, nodes: int, sample: int = 10_000, least: int = 4, most: int = 200_000) -> np.ndarray:
    """The `most` commonest shingles of about `sample` rows that `least` of these have, from rare to common. They only
    set the order in which prefixes are taken, so what the sample misses costs time and no link."""

    def cut(batch):
        import pyarrow as pa

        sets = [shingles(t, size).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *sets]))], ["h"])

    some = rows.filter(F.pmod(F.xxhash64("row"), F.lit(max(1, nodes // sample))) == 0).select("text")
    counted = map_arrow(some, cut, "h long", kept=known_words).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    got = counted.orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()
    return got.column("h").to_numpy()[::-1].copy().view(np.uint64)


def sketches(rows: DataFrame, size: int, segments: int, bits: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(row, doc_id, words, sketch, n, prefix) of rows (row, doc_id, text): a digest of the sequence of words, the
    fingerprint, the number of distinct shingles, and the first of them: uncommon ones by hash, then the common ones from
    rare to common. Whole hashes: of fewer bits, more and more would meet by chance as the corpus grows."""
    order = np.argsort(common)
    held = rows.sparkSession.sparkContext.broadcast((common[order], order))

    def first(h: np.ndarray) -> np.ndarray:
        known, rank = held.value
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        met = known[at] == h if len(known) else np.zeros(len(h), bool)
        rest = h[met][np.argsort(rank[at[met]])] if met.any() else h[:0]
        return np.r_[h[~met], rest][: prefix_length(len(h), similarity)]

    def step(batch):
        import pyarrow as pa
        from xxhash import xxh128_digest

        words, out, n, prefix = [], [], [], []
        for t in batch.column("text").to_pylist():
            words.append(xxh128_digest(b" ".join((t or "").encode().lower().split())))
            h = shingles(t, size)
            out.append(long_fingerprint(h, segments, bits))
            n.append(len(h))
            prefix.append(first(h).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(words, pa.binary()), pa.array(out, pa.list_(pa.int64())), pa.array(n, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))], ["row", "doc_id", "words", "sketch", "n", "prefix"])

    return map_arrow(rows.select("row", "doc_id", "text"), step, "row long, doc_id long, words binary, sketch array<long>, n int, prefix array<long>", kept=known_words)


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def together(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def candidates(nodes: DataFrame, bits: int, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): nodes (node, sketch) that have a segment in common, or a segment that differs in one bit.

    The holders of one value of a segment are joined to one of them, not to each other, and only values, not their
    holders, meet through the wildcard variants: two at a variant. So pairs grow with the nodes, however large a group;
    two members of a group that are like each other but not like the chosen one stay apart in that segment. A segment's
    variants are much larger than the nodes, so the segments are dealt out to `rounds`."""
    parts = []
    for i in range(rounds):
        pairs, values = sharing(nodes.select("node", F.posexplode("sketch").alias("s", "v")).filter(F.col("s") % rounds == i), bits)
        parts.append(materialise(pairs, "sharing"))
        release(values)
        free_shuffles(nodes.sparkSession)
    out = materialise(together(parts).distinct(), "pairs")
    release(*parts)
    return out


def sharing(held: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """The candidates by the segments held (node, s, v), and the kept table of their values."""
    values = materialise(held.groupBy("s", "v").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("head"), F.count("*").alias("n")), "segments")
    shared = held.join(values.filter("n > 1"), ["s", "v"]).filter(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b"))
    long = lambda c: c.cast("long")

    def variants(one: bool, name: str) -> DataFrame:
        wild = F.filter(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.struct(b.alias("b"), F.call_function("shiftleft", long(F.lit(1)), b).alias("m"))), lambda x: (F.col("v").bitwiseAND(x["m"]) != 0) == F.lit(one))
        keys = F.transform(wild, lambda x: (long(F.col("s")) * 64 + x["b"]) * F.lit(1 << 50).cast("long") + F.col("v").bitwiseAND(F.bitwise_not(x["m"])))
        return values.select(F.explode(keys).alias("key"), F.col("head").alias(name))

    near = variants(False, "a").join(variants(True, "b").hint("merge"), "key").filter("a <> b").select("a", "b")
    return shared.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), values


def segment_bits(nodes: int) -> int:
    """Bits of a segment: 28, or four more than number the nodes, so that few unrelated nodes share one."""
    return min(50, max(28, nodes.bit_length() + 4))


def widest(similarity: float, total: int) -> int:
    """The most bits of `total` that two sketches of that Jaccard similarity differ in, but for one pair in forty."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(np.ceil(total * p + 2 * np.sqrt(total * p * (1 - p))))


def likely(column: str, keys: DataFrame, bits: int = 32, most: int = 1 << 24) -> Column:
    """True for each value that keys has in that column, and for few others: a table of `bits` bits a key, `most` in all,
    that goes to all tasks as a constant. What it leaves out need not be shuffled to be joined to the keys."""
    slots, count = 2, keys.count()
    while 64 * slots < min(most, count * bits):
        slots *= 2
    key = F.xxhash64(column)
    table = F.from_json(F.lit(json.dumps(bit_table(keys.select(key.alias("k")), slots))), "array<bigint>")
    one, two = (F.call_function("shiftrightunsigned", F.get(table, at), bit).bitwiseAND(F.lit(1).cast("long")) == 1 for at, bit in places(key, slots))
    return one & two


def true_links(pairs: DataFrame, rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """(src, dst): the pairs (a, b) of rows of which `similarity` or more of the distinct shingles are common."""
    concerned = materialise(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "concerned")
    texts = rows.filter(likely("row", concerned)).join(concerned, "row", "left_semi").select("row", "text")

    def cut(batch):
        import pyarrow as pa

        sets = [shingles(t, size).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    sets = materialise(map_arrow(texts, cut, "node long, set array<long>", kept=known_words), "sets")
    a, b = (sets.select(F.col("node").alias(n), F.col("set").alias(f"s{n}")) for n in "ab")
    both = let(F.size(F.array_intersect("sa", "sb")), lambda n: n >= similarity * (F.size("sa") + F.size("sb") - n))
    out = materialise(pairs.join(a, "a").join(b, "b").filter(both).select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
    release(concerned, sets)
    free_shuffles(rows.sparkSession)
    return out


def met_by_fingerprint(nodes: DataFrame, rows: DataFrame, size: int, similarity: float, total: int, bits: int) -> DataFrame:
    """(src, dst): links between nodes (node, sketch) that meet as candidates and whose sketches are near enough."""
    pairs = candidates(nodes, bits)
    a, b = (nodes.select(F.col("node").alias(n), F.col("sketch").alias(f"s{n}")) for n in "ab")
    close = materialise(pairs.join(a, "a").join(b, "b").filter(distance(F.col("sa"), F.col("sb")) <= widest(similarity, total)).select("a", "b"), "close")
    out = true_links(close, rows, size, similarity)
    release(pairs, close)
    return out


def met_by_prefix(held: DataFrame, similarity: float, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): all pairs of rows (node, n, prefix, group) of different groups that may have the similarity; none that has
    it is missing. Two such sets have a shingle of both prefixes in common, and as many there as their sizes ask for.

    Shingles that only one group has in its prefixes are in no partner that is met behind them, so they lower how many can
    be common (`reach`). Groups meet first, each once at a shingle: members of one group are never paired. Then groups that
    meet at fewer shingles than the sizes ask for go, then members that share fewer with the other group; only members that
    are left are paired, one row a pair, and counted by their lists. So rows don't grow with members times members times
    shingles. The shingles are dealt out to `rounds` until only those are left that several groups have."""
    parts, spark = [], held.sparkSession
    for i in range(rounds):
        each = held.select("node", "n", "group", F.posexplode("prefix").alias("at", "k")).filter(F.pmod("k", F.lit(rounds)) == i).repartition("k")
        shared = each.groupBy("k").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo <> hi").select("k")
        parts.append(materialise(each.join(shared.hint("merge"), "k", "left_semi"), "several"))
        free_shuffles(spark)
    ahead = F.row_number().over(Window.partitionBy("node").orderBy("at")) - 1
    some = materialise(together(parts).withColumn("reach", F.col("n") - F.col("at") + ahead), "holders")
    release(*parts)
    least = lambda u, v: (F.col(u) + F.col(v)) * (similarity / (1 + similarity)) - 1e-6
    near = lambda u, v: F.col(u) >= F.col(v) * (similarity - 1e-9)
    sizes = some.groupBy("k", "group").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("reach").alias("reach"))
    a, b = (sizes.select("k", F.col("group").alias(f"g{x}"), *[F.col(c).alias(c + x) for c in ("lo", "hi", "reach")]) for x in "ab")
    may = (F.col("ga") < F.col("gb")) & near("hia", "lob") & near("hib", "loa") & (F.least("reacha", "reachb") >= least("loa", "lob"))
    meet = materialise(a.join(b.hint("merge"), "k").filter(may).select("k", "ga", "gb", "loa", "hia", "lob", "hib"), "meetings")
    free_shuffles(spark)
    # sets of m and s <= m shingles have over t / (1 + t) * (m + s) - t * m of their prefixes in common; least for m large, s small
    share = similarity / (1 + similarity)
    fewest = lambda s, m: F.greatest(F.col(s), F.col(m) * similarity) * share - F.col(m) * (similarity - share)
    enough = lambda loa, hia, lob, hib: F.col("c") > F.least(fewest(lob, hia), fewest(loa, hib)) - 1e-6
    ranges = [f(c).alias(c) for f, c in ((F.min, "loa"), (F.max, "hia"), (F.min, "lob"), (F.max, "hib"))]
    like = meet.groupBy("ga", "gb").agg(F.count("*").alias("c"), F.collect_list("k").alias("shared"), *ranges)
    left = materialise(like.filter(enough("loa", "hia", "lob", "hib")).drop("c"), "alike")
    lists = materialise(some.groupBy("node", "n", "group").agg(F.collect_list("k").alias("ks")), "lists")

    def members(x: str, y: str) -> DataFrame:
        own = lists.select(F.col("group").alias(f"g{x}"), F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("ks").alias(f"k{x}"))
        common = F.size(F.array_intersect("shared", f"k{x}")).alias("c")
        met = left.join(own.hint("merge"), f"g{x}").select("ga", "gb", x, f"n{x}", f"k{x}", f"lo{y}", f"hi{y}", common)
        return met.filter(enough(f"n{x}", f"n{x}", f"lo{y}", f"hi{y}")).select("ga", "gb", x, f"n{x}", f"k{x}")

    pairs = members("a", "b").join(members("b", "a").hint("merge"), ["ga", "gb"]).filter(near("na", "nb") & near("nb", "na"))
    counted = pairs.withColumn("c", F.size(F.array_intersect("ka", "kb")))
    # of the set whose prefix ends first, at most ceil(similarity * n) - 1 shingles stand behind the prefix
    behind = F.ceil(F.greatest("na", "nb") * similarity - 1e-9) - 1
    out = materialise(counted.filter(F.col("c") + behind >= least("na", "nb")).select("a", "b"), "met")
    release(some, meet, left, lists)
    free_shuffles(spark)
    return out


def near_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, segments: int = 12, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """docs with a row number (column 0), and (row, best): for each row of a group the row of the one that stays.

    Rows are equal if their words are. Texts are linked if `similarity` or more of their distinct shingles are common.
    Fingerprints find most links; the pairs of texts that these leave in different groups meet by their prefixes, so no
    link between two groups is missing. Groups are the components; of a group stays the smallest doc_id (a null comes
    last), of equal ids the first row."""
    spark, row = docs.sparkSession, free_name(docs, "row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", compression="zstd")
    rows = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    count = numbered.count()
    bits = bits or segment_bits(count)
    seen = materialise(sketches(rows, size, segments, bits, similarity, common_shingles(rows, size, count)), "sketches", compression="zstd")
    members = materialise(seen.select("row", "doc_id", "words"), "members")
    nodes = materialise(seen.groupBy("words").agg(F.min("row").alias("node"), F.min_by("sketch", "row").alias("sketch")), "nodes")
    links = met_by_fingerprint(nodes.select("node", "sketch"), rows, size, similarity, segments * bits, bits)
    roots = connected_components(links)
    groups = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("group"))
    held = materialise(seen.select(F.col("row").alias("node"), "n", "prefix").join(groups, "node"), "prefixes", compression="zstd")
    release(seen)
    free_shuffles(spark)
    met = met_by_prefix(held, similarity)
    release(held)
    more = true_links(met, rows, size, similarity)
    release(met)
    roots = connected_components(more.unionByName(roots.select(F.col("node").alias("src"), F.col("root").alias("dst"))))
    grouped = nodes.select("words", "node").join(roots, "node", "left").select("words", F.coalesce("root", "node").alias("root"))
    member = members.join(grouped, "words")
    stays = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("best"))
    return numbered, member.join(stays, "root").select(F.col("row").alias(row), "best")


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """docs with one row of each group of near_groups. All columns stay as they are."""
    numbered, groups = near_groups(docs, **settings)
    row = numbered.columns[-1]
    losers = materialise(groups.filter(F.col(row) != F.col("best")).select(row), "losers")
    stay = ~likely(row, losers)
    return numbered.filter(stay).unionByName(numbered.filter(~stay).join(losers, row, "left_anti").select(numbered.columns)).select(docs.columns)

"""Benchmark decontamination by windows of words; DataFrame operations only.

Every window of `size` consecutive words of a benchmark item (all its words, if it has fewer) is looked for in every
document. The windows' hashes are a broadcast hash set: a table of bits, two for each hash, `bits_per_window` bits a
window and `most_bits` at most (2 MB), that goes to all tasks as one constant of the plan. Documents are scanned where they
lie; a window whose bits are set is a candidate, and its words are verified by joining them to the benchmark's windows. The
table only decides how many windows are verified, never which are found, so benchmarks of any size take this one path.

The tables may hold: null texts (no words), null ids (documents: kept apart from others; items: not named), repeated rows
(documents: each row is judged by its own text; items: windows count once), texts of any length (work and memory grow
with a text's words; spans are cut out in one pass), no item (nothing is hit), no document (no row), any other columns
(not read by `find_hits`, kept by `decontaminate`).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusatlas.llm.common import ascii_lower, free_name, let, materialise, positions, window_hashes, words

#: Words are runs of ASCII digits and letters and of all that is not ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORIGINAL_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORIGINAL_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return words(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def benchmark_windows(items: DataFrame, size: int) -> DataFrame:
    """(length, window, item_id): the distinct windows of each item, words space-joined."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    return w.select("item_id", n.alias("length"), F.explode(F.transform(positions(F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i + 1, n), " "))).alias("window")).distinct()


def window_keys(w: Column, length: int) -> Column:
    """A hash of each window of words, in order of place."""
    return let(F.transform(w, lambda v: F.xxhash64(v)), lambda h: window_hashes(h, length))


def places(key: Column, slots: int) -> list[tuple[Column, Column]]:
    """A hash's two bits in a table of longs (a power of two, 2 to 2**18): the long's place, and the bit in it."""
    shift, low = 64 - (slots.bit_length() - 1), F.lit(63).cast("long")
    first = F.shiftrightunsigned(key, shift).cast("int"), key.bitwiseAND(low).cast("int")
    return [first, (F.shiftrightunsigned(F.shiftleft(key, 20), shift).cast("int"), F.shiftrightunsigned(key, 6).bitwiseAND(low).cast("int"))]


def bit_table(keys: DataFrame, slots: int) -> list[int]:
    """The longs with the bits of all hashes in column `k`: `slots` numbers, whatever the input."""
    spots = keys.select(F.explode(F.array(*[F.struct(at.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")) for at, bit in places(F.col("k"), slots)])).alias("p"))
    table = [0] * slots
    for r in spots.groupBy("p.at").agg(F.bit_or("p.bit").alias("bits")).collect():
        table[r["at"]] = r["bits"]
    return table


def covered(spots: Column) -> Column:
    """The union of [pos, pos + length) over structs (pos, length), as sorted disjoint structs (s, e)."""
    span = "struct<s:int,e:int>"

    def add(a: Column, x: Column) -> Column:
        end, last = (x["pos"] + x["length"]).alias("e"), F.struct(a["s"].alias("s"), a["e"].alias("e"))
        grown = F.struct(a["s"].alias("s"), F.greatest(a["e"], end).alias("e"), a["done"].alias("done"))
        return F.when(x["pos"] <= a["e"], grown).otherwise(F.struct(x["pos"].alias("s"), end, F.when(a["e"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(last))).alias("done")))

    start = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.array().cast(f"array<{span}>").alias("done"))
    return F.aggregate(F.array_sort(spots), start, add, lambda a: F.when(a["e"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))))


def find_hits(docs: DataFrame, items: DataFrame, size: int = 13, bits_per_window: int = 32, most_bits: int = 1 << 24) -> DataFrame:
    """One row per row of docs: row, doc_id, text_key, n_words, n_hit, spans (hit words: structs s, e), n_items, items."""
    named = materialise(benchmark_windows(items, size), "benchmark")
    lengths = sorted(r["length"] for r in named.select("length").distinct().collect())  # `size` values at most
    windows = materialise(named.select("length", "window").distinct(), "windows")
    slots = 2
    while 64 * slots < min(most_bits, windows.count() * bits_per_window):
        slots *= 2
    keys = windows.select(F.coalesce(*[F.when(F.col("length") == n, F.get(window_keys(F.split("window", " "), n), F.lit(0))) for n in lengths], F.lit(0)).cast("long").alias("k"))
    # the optimizer turns the text into an array once
    table = F.from_json(F.lit(json.dumps(bit_table(keys, slots))), "array<bigint>")

    def known(t: Column, k: Column) -> Column:
        one, two = (F.call_function("shiftrightunsigned", F.get(t, at), bit).bitwiseAND(F.lit(1).cast("long")) == 1 for at, bit in places(k, slots))
        return one & two

    def candidates(w: Column, t: Column, n: int) -> Column:
        near = F.filter(F.transform(window_keys(w, n), lambda k, i: F.when(known(t, k), i)), lambda i: i.isNotNull())
        return F.transform(near, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("length"), F.array_join(F.slice(w, i + 1, n), " ").alias("window")))

    none = F.array().cast("array<struct<pos:int,length:int,window:string>>")
    near = let(item_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), let(table, lambda t: F.concat(none, *[candidates(w, t, n) for n in lengths])).alias("c")))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), near.alias("x"), F.monotonically_increasing_id().alias("row"))
    found = materialise(rows.select("row", "doc_id", "text_key", "x.*"), "candidates")
    met = found.select("row", F.explode("c").alias("c")).select("row", "c.*").join(windows, ["length", "window"])
    own = met.groupBy("row").agg(F.collect_set(F.struct("pos", "length", "window")).alias("c"))  # a document's own windows
    hits = materialise(own.select("row", covered(F.transform("c", lambda c: F.struct(c["pos"].alias("pos"), c["length"].alias("length")))).alias("spans"), F.array_distinct(F.transform("c", lambda c: c["window"])).alias("windows")), "hits")
    of = hits.select("row", F.explode("windows").alias("window")).join(named.filter(F.col("item_id").isNotNull()).select("window", "item_id"), "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = found.drop("c").join(hits.select("row", "spans"), "row", "left").join(of, "row", "left")
    out = out.withColumns({"spans": F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.withColumns({"n_hit": F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]), "n_items": F.size("items").cast("long")})


def contaminated(most: int = 20) -> Column:
    """A twentieth of the words or more are hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * most >= F.col("n_words"))


def without_spans(text: Column, spans: Column) -> Column:
    """text without the words in spans (sorted, disjoint structs s, e) and the gap after each."""
    pieces = F.regexp_extract_all(text, F.lit(f"({ORIGINAL_WORD})|({ORIGINAL_GAP})"), F.lit(0))
    lead = F.when(text.rlike(f"^{ORIGINAL_GAP}"), 1).otherwise(0)

    def kept(x: Column) -> Column:
        # word j is piece lead + 2j, its gap the piece behind it; what stays lies before, between and behind the spans
        begin = F.concat(F.array(F.lit(0)), F.transform(x["c"], lambda c: x["l"] + 2 * c["e"]))
        end = F.concat(F.transform(x["c"], lambda c: x["l"] + 2 * c["s"]), F.array(F.size(x["p"])))
        return F.array_join(F.flatten(F.zip_with(begin, end, lambda b, e: F.slice(x["p"], b + 1, F.greatest(e - b, F.lit(0))))), "")

    return let(F.struct(spans.alias("c"), lead.alias("l"), pieces.alias("p")), kept)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 13, **settings) -> DataFrame:
    """docs without contaminated documents, and without the hit spans in the others. All columns stay as they are."""
    hits = find_hits(docs, items, size, **settings).filter(F.col("n_hit") > 0)
    names = {c: free_name(docs, c) for c in ("id", "key", "bad", "spans")}
    verdict = hits.groupBy("doc_id", "text_key").agg(F.first(contaminated()).alias(names["bad"]), F.first("spans").alias(names["spans"])).withColumnsRenamed({"doc_id": names["id"], "text_key": names["key"]})
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    joined = docs.join(verdict, docs["doc_id"].eqNullSafe(verdict[names["id"]]) & (key == verdict[names["key"]]), "left").filter(F.coalesce(F.col(names["bad"]), F.lit(False)) == F.lit(False))
    clean = F.when(F.col(names["spans"]).isNotNull(), without_spans(F.col("text"), F.col(names["spans"]))).otherwise(F.col("text"))
    return joined.select(*[clean.alias(c) if c.lower() == "text" else docs[c] for c in docs.columns])

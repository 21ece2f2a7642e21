"""Quality rules from the frequency of lines across documents; DataFrame operations only.

A line's key is a hash of its text in lower case, digits as 0, white space collapsed. A line is boilerplate on a host
(here: source) if more than max(min_docs, max_share * the host's texts) different texts of the host have it; exact copies
of a text count once, so copying a document does not make its lines boilerplate. Boilerplate lines are removed; a
document is depleted if fewer than `least_words` words or less than `least_share` of its words stay.

Base rules (words are runs of anything but ASCII white space): n_words < 10, or over 20 % of the words in repeated
five-word windows.

The table may hold: null texts (no words: they fail the base rule), null sources (one host of their own), null doc_ids
and repeated rows (each row is judged by its own text and host), texts of any length (work grows with the words), nothing
(no row), any other columns (not read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusatlas.llm.common import let, materialise, window_hashes, words

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\f\r"


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_window_words(w: Column, size: int) -> Column:
    """How many words stand in a window of `size` words that the array has twice or more."""
    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: window_hashes(h, size))

    def covered(h: Column) -> Column:
        # equal windows side by side after sorting by hash, then by place
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def spots(r: Column) -> Column:
            own = F.filter(F.transform(r, lambda x, j: F.when((x["h"] == F.get(r, j - 1)["h"]) | (x["h"] == F.get(r, j + 1)["h"]), x["i"])), lambda x: x.isNotNull())
            return let(F.sort_array(own), lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(s, j + 1) - x, F.lit(size)))), F.lit(0).cast("long"), lambda a, x: a + x))

        return let(ranked, spots)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def lines_of(text: Column) -> Column:
    """The lines that hold a word, as structs: line, words."""
    solid = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANK))) > 0)
    return F.transform(solid, lambda x: F.struct(x.alias("line"), words(x).alias("words")))


def measured(docs: DataFrame, window: int, keyed: bool = False) -> DataFrame:
    """docs with a struct `m`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; if keyed, also lines (k, n).
    The text is split once."""
    text, long = F.coalesce("text", F.lit("")), lambda c: c.cast("long")

    def of(x: Column) -> Column:
        line = F.transform(x, lambda s: s["line"])
        keys = [F.transform(x, lambda s: F.struct(line_key(s["line"]).alias("k"), F.size(s["words"]).alias("n"))).alias("lines")] * keyed
        return let(F.flatten(F.transform(x, lambda s: s["words"])), lambda w: F.struct(long(F.size(w)).alias("n_words"), long(F.length(F.array_join(w, ""))).alias("word_chars"), repeated_window_words(w, window).alias("n_repeat_words"), long(F.size(line) - F.size(F.array_distinct(line))).alias("n_dup_lines"), long(F.length(text) - F.length(without(text, SYMBOLS))).alias("n_symbols"), *keys))

    return docs.withColumn("m", let(lines_of(F.col("text")), of))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_rules(docs: DataFrame, least_words: int = 10, window: int = 5, repeated_percent: int = 20) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each row."""
    m = measured(docs.select("doc_id", "text"), window).select("doc_id", *[F.col(f"m.{c}").alias(c) for c in MEASURES])
    return m.withColumn("base_failed", failed(least_words, repeated_percent))


def failed(least_words: int = 10, repeated_percent: int = 20) -> Column:
    return (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeated_percent)


def line_key(line: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(line)), r"\p{Nd}", "0")
    return F.xxhash64(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " "))


def without_lines(text: Column, keys: Column) -> Column:
    """text without the lines that have one of the keys; lines without a word stay."""
    blank = lambda x: F.length(F.btrim(x, F.lit(BLANK))) == 0
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: blank(x) | ~F.array_contains(keys, line_key(x))), "\n")


def judge_lines(docs: DataFrame, host: str = "source", min_docs: int = 50, max_share: float = 0.01, least_words: int = 10, least_share: float = 0.5, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, the base measures, base_failed, removed_words, depleted, kept; with keep_text also text,
    the document without its boilerplate lines (null stays null)."""
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), "text")
    text = ["text"] * keep_text
    base = measured(rows, 5, keyed=True).select("doc_id", "host", *text, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), *[F.col(f"m.{c}").alias(c) for c in MEASURES], F.col("m.lines").alias("lines")).withColumn("base_failed", failed())
    base = materialise(base.withColumn("row", F.monotonically_increasing_id()), "line-rows")
    host_key = F.coalesce("host", F.lit(""))
    each = base.select("row", "text_key", host_key.alias("h"), F.col("host").isNull().alias("no_host"), F.explode("lines").alias("line")).select("row", "text_key", "h", "no_host", F.col("line.k").alias("k"), F.col("line.n").alias("n"))
    common = each.groupBy("h", "no_host", "k", "text_key").agg(F.lit(1).alias("one")).groupBy("h", "no_host", "k").agg(F.count("*").alias("texts")).filter(F.col("texts") > min_docs)
    sizes = base.groupBy(host_key.alias("h"), F.col("host").isNull().alias("no_host"), "text_key").agg(F.lit(1).alias("one")).groupBy("h", "no_host").agg(F.count("*").alias("of"))
    common = common.join(sizes, ["h", "no_host"]).filter(F.col("texts") > F.col("of") * max_share).select("h", "no_host", "k")
    removed = each.join(common, ["h", "no_host", "k"]).groupBy("row").agg(F.sum("n").cast("long").alias("removed_words"), *[F.collect_set("k").alias("gone")] * keep_text)
    out = base.drop("lines", "text_key", "host").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("removed_words")
    out = out.withColumn("depleted", (F.col("removed_words") > 0) & ((left < least_words) | (left < F.col("n_words") * least_share)))
    if keep_text:
        out = out.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("gone")))).drop("gone")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).drop("row")

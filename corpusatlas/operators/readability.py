"""Readability of prose with counters of our own: words are runs of letters, syllables are vowel groups (one at least),
sentences are runs of closing punctuation (one at least). The formulas are the usual ones; scores are comparable within
this counter only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOWELS = "aeiouyáéíóúàèìòùâêîôûäëïöüæœ"


def counters(text: Column) -> Column:
    """struct(words, sentences, syllables, complex_words)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    groups = F.transform(F.regexp_extract_all(t, F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.greatest(F.lit(1), F.regexp_count(w, F.lit(f"[{VOWELS}]+"))))
    return F.transform(F.array(groups), lambda g: F.struct(F.size(g).cast("long").alias("words"), F.greatest(F.lit(1), F.regexp_count(t, F.lit("[.!?]+"))).cast("long").alias("sentences"), F.aggregate(g, F.lit(0).cast("long"), lambda a, x: a + x).alias("syllables"), F.size(F.filter(g, lambda x: x >= 3)).cast("long").alias("complex_words")))[0]


def scores(rows: DataFrame, text: str) -> DataFrame:
    """rows with the counters, fog and flesch; null scores for a text without words."""
    x = rows.withColumn("__c", counters(F.col(text))).select("*", "__c.*").drop("__c")
    w, s = F.col("words"), F.col("sentences")
    fog = 0.4 * (w / s + 100.0 * F.col("complex_words") / w)
    flesch = 206.835 - 1.015 * w / s - 84.6 * F.col("syllables") / w
    return x.withColumns({"fog": F.when(w > 0, fog), "flesch": F.when(w > 0, flesch)})


def summary(scored: DataFrame, group: str, value: str, groups: DataFrame | None = None) -> DataFrame:
    """Per group: n, scored, min, max, mean, median, sample deviation, quartiles. groups: a table of all groups, so that empty
    ones are listed too."""
    v = F.col(value)
    out = scored.groupBy(group).agg(F.count("*").alias("n"), F.count(v).alias("scored"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"), F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.75).alias("q75"))
    return out if groups is None else groups.join(out, group, "left").na.fill(0, ["n", "scored"])


def quality_flags(scored: DataFrame, least_words: int = 100, longest: float = 60.0) -> DataFrame:
    flags = [("few_words", F.col("words") < least_words), ("long_sentences", F.col("words") / F.col("sentences") > longest), ("no_prose", F.col("words") == 0)]
    return scored.withColumn("quality_flags", F.concat_ws("; ", *[F.when(c, F.lit(n)) for n, c in flags]))


def prose_blocks(blocks: DataFrame, document: str, order: str, starts: str = r"(?i)^\s*(?:abstract|introduction)\b", excluded: str = r"(?i)^\s*(?:references|bibliography|appendix|acknowledge?ments)\b") -> DataFrame:
    """blocks (document, order, kind, text) with `reason`: empty for prose, else why a block is left out. Prose starts at an
    abstract or introduction heading (at once if there is none) and pauses in excluded sections."""
    from pyspark.sql import Window

    w = Window.partitionBy(document).orderBy(order)
    whole = Window.partitionBy(document)
    heading = F.col("kind") == "heading"
    start = heading & F.col("text").rlike(starts)
    x = blocks.withColumns({"__begun": F.max(start.cast("int")).over(w), "__any": F.max(start.cast("int")).over(whole), "__out": F.last(F.when(heading, F.col("text").rlike(excluded)), ignorenulls=True).over(w)})
    reason = F.when(heading, "heading").when((F.col("__any") == 1) & (F.col("__begun") == 0), "before_start").when(F.coalesce("__out", F.lit(False)), "excluded_section").when(F.col("kind") != "text", "not_text").when(~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)), "no_letters").when(F.col("text").rlike(r"^\s*(?:\d{1,2}\s+\p{L}+\s+\d{4}|\p{L}+\s+\d{1,2},\s+\d{4}|\d{4})\s*$"), "date").otherwise("")
    return x.withColumn("reason", reason).drop("__begun", "__any", "__out")

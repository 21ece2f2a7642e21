"""Terms that set clusters apart, and where an expression occurs.

Term tables are long (paper, term, tf), so every step is a hash aggregate with map-side combination; cluster and term
totals are joined back by key.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusatlas.functions import text as T
from corpusatlas.functions.java import register
from corpusatlas.operators.ranking import top_by
from corpusatlas.storage import keep


def term_counts(papers: DataFrame, key: str, text: Column, stopwords: tuple[str, ...], form_kc: bool = True) -> DataFrame:
    """(key, term, tf)."""
    return papers.select(key, F.explode(T.term_tokens(text, stopwords, form_kc)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n: int | DataFrame, min_df: int = 3, max_df: float = 0.9) -> DataFrame:
    """(term, df, idf) of terms in at least min_df papers and at most max_df of them. n: all papers."""
    total = F.lit(n) if isinstance(n, int) else F.col("n_papers")
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    if not isinstance(n, int):
        df = df.crossJoin(F.broadcast(n))
    return df.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * total)).select("term", "df", (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """counts of vocabulary terms with tfidf: (1 + ln tf) * idf, scaled to length 1 per paper."""
    raw = counts.join(vocab, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.withColumn("tfidf", F.col("w") / norm).drop("w")


def topic_terms(weights: DataFrame, labels: DataFrame, key: str, top: int = 10, min_fraction: float = 0.1, min_papers: int = 3) -> DataFrame:
    """(cluster, ranking, rank, term, score, inside_count, inside_n, outside_count, outside_n, prevalence_gap).

    Rankings: `ctfidf`, tf / cluster length * ln(1 + mean length / corpus count), and `contrast`, mean tfidf inside minus
    outside, papers without the term included. A term needs max(min_papers, ceil(min_fraction * papers)) papers inside and
    a positive score; ties go by term."""
    w = weights.join(labels.select(key, "cluster"), key)
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("inside_n"))
    inside = w.groupBy("cluster", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("inside_count"), F.sum("tfidf").alias("inside_sum"))
    return rank_topics(inside, inside.groupBy("cluster").agg(F.sum("tf").alias("length")), sizes, top, min_fraction, min_papers)


def rank_topics(inside: DataFrame, length: DataFrame, sizes: DataFrame, top: int, min_fraction: float, min_papers: int) -> DataFrame:
    """topic_terms from sums: inside (cluster, term, tf, inside_count, inside_sum), each term with all its clusters, length
    (cluster, length) over all terms, sizes (cluster, inside_n)."""
    total = sizes.agg(F.sum("inside_n").alias("n_all"))
    overall = inside.groupBy("term").agg(F.sum("tf").alias("corpus_tf"), F.sum("inside_count").alias("df"), F.sum("inside_sum").alias("all_sum"))
    mean = length.agg(F.avg("length").alias("mean_length"))
    x = inside.join(overall, "term").join(F.broadcast(sizes.join(length, "cluster").crossJoin(mean).crossJoin(total)), "cluster")
    x = x.withColumns({"outside_n": F.col("n_all") - F.col("inside_n"), "outside_count": F.col("df") - F.col("inside_count")})
    ctfidf = F.col("tf") / F.col("length") * F.log(1 + F.col("mean_length") / F.col("corpus_tf"))
    outside = F.when(F.col("outside_n") > 0, (F.col("all_sum") - F.col("inside_sum")) / F.col("outside_n")).otherwise(0.0)
    gap = F.col("inside_count") / F.col("inside_n") - F.when(F.col("outside_n") > 0, F.col("outside_count") / F.col("outside_n")).otherwise(0.0)
    scored = x.select("cluster", "term", "inside_count", "inside_n", "outside_count", "outside_n", gap.alias("prevalence_gap"), F.explode(F.array(F.struct(F.lit("ctfidf").alias("ranking"), ctfidf.alias("score")), F.struct(F.lit("contrast").alias("ranking"), (F.col("inside_sum") / F.col("inside_n") - outside).alias("score")))).alias("s")).select("*", "s.ranking", "s.score").drop("s")
    fit = scored.filter((F.col("inside_count") >= F.greatest(F.lit(min_papers), F.ceil(F.col("inside_n") * min_fraction))) & (F.col("score") > 0))
    return top_by(fit, ["cluster", "ranking"], top, F.desc(F.round("score", 9)), F.asc("term"))


class Terms:
    """The terms of papers (key, text, cluster) with their tfidf, from each paper's counts; rows of one key are one paper.

    Papers are dealt to chunks. A chunk counts the papers of its terms, and these counts are shuffled by term, not the papers'
    own; the vocabulary's terms come back to the chunks that have them, and weights are made there. kind 0: terms as
    `term_tokens` has them; 1: as in `cluster_overview`."""

    def __init__(self, papers: DataFrame, key: str, text: Column, stopwords: tuple[str, ...], min_df: int = 3, max_df: float = 0.9, kind: int = 0, chunk: int = 2048):
        self.papers, self.key, self.n, self.kinds = papers, key, papers.count(), dict(papers.dtypes)
        x = papers.select(key, F.lower(T.nfkc(T.empty_if_null(text)) if kind == 0 else T.empty_if_null(text)).alias("t"), F.col("cluster").alias("c"))
        self.repeated = not papers.groupBy(key).count().filter("count > 1").isEmpty()
        one = x.groupBy(key).agg(F.collect_list(F.struct("t", "c")).alias("x")).select(key, F.col("x.t").alias("t"), F.col("x.c").alias("c")) if self.repeated else x.select(key, F.array("t").alias("t"), F.array("c").alias("c"))
        self.chunks = max(1, -(-self.n // chunk))
        dealt = one.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(self.chunks)).cast("int")).repartition(self.chunks, "chunk")
        bag = F.call_function(register(papers.sparkSession, "TermBag", "map<string,bigint>"), F.col("t"), F.lit("\n".join(stopwords)), F.lit(kind))
        self.bags = dealt.select("chunk", key, bag.alias("bag"), "c")
        self.counts = self.bags.select("chunk", F.explode(F.map_keys("bag")).alias("term")).groupBy("chunk", "term").agg(F.count("*").alias("n"))
        self.limits = min_df, max_df * self.n

    def known(self, df: DataFrame) -> DataFrame:
        return df.filter((F.col("df") >= self.limits[0]) & (F.col("df") <= self.limits[1])).withColumn("idf", F.log((1 + F.lit(self.n)) / (1 + F.col("df"))) + 1)

    def vocabulary(self) -> DataFrame:
        """(term, df, idf)."""
        return self.known(self.counts.groupBy("term").agg(F.sum("n").alias("df")))

    def _weighed(self, make, schema: str) -> DataFrame:
        """make(keys, labels, rows, terms, places, tf, tfidf, vocabulary) for each chunk: the papers' keys and labels, and for
        each of their terms in the vocabulary the paper's row, the term, its place in the vocabulary, counts and weights."""
        key = self.key
        back = self.known(self.counts.withColumn("df", F.sum("n").over(Window.partitionBy("term")))).select("chunk", "term", "df", "idf").repartition(self.chunks, "chunk")

        def run(papers, terms):
            import pyarrow as pa

            papers, terms = papers.combine_chunks(), terms.combine_chunks()
            bag = papers.column("bag").combine_chunks()
            bag = bag.chunk(0) if isinstance(bag, pa.ChunkedArray) and bag.num_chunks else bag
            if not papers.num_rows or not terms.num_rows:
                return pa.Table.from_batches([], schema=empty(papers))
            place = {t: i for i, t in enumerate(terms.column("term").to_pylist())}
            at = np.asarray(bag.offsets)
            words = bag.keys.slice(at[0], at[-1] - at[0])
            tf = np.asarray(bag.items)[at[0] : at[-1]]
            row = np.repeat(np.arange(papers.num_rows), np.diff(at))
            get = place.get
            places = np.fromiter((get(w, -1) for a in range(0, len(words), 65536) for w in words.slice(a, 65536).to_pylist()), np.int64, len(row))
            there = places >= 0
            row, tf, places = row[there], tf[there], places[there]
            w = (1 + np.log(tf)) * terms.column("idf").to_numpy()[places]
            norm = np.sqrt(np.bincount(row, w * w, papers.num_rows))
            return pa.Table.from_batches(make(pa, papers.column(key).combine_chunks(), papers.column("c").combine_chunks(), row, words.filter(pa.array(there)), places, tf, w / norm[row], terms), schema=empty(papers))

        def empty(papers):
            import pyarrow as pa

            types = {"term": pa.string(), "tf": pa.int64(), "tfidf": pa.float64(), "inside_count": pa.int64(), "inside_sum": pa.float64(), key: papers.schema.field(key).type, "cluster": papers.schema.field("c").type.value_type}
            return pa.schema([(c.split(" ")[0], types[c.split(" ")[0]]) for c in schema.split(", ")])

        return self.bags.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(run, schema)

    def weights(self) -> DataFrame:
        """(key, term, tf, tfidf)."""

        def make(pa, keys, labels, row, words, places, tf, tfidf, terms):
            return [pa.RecordBatch.from_arrays([keys.take(pa.array(row)), words, pa.array(tf), pa.array(tfidf)], names=[self_key, "term", "tf", "tfidf"])]

        self_key = self.key
        return self._weighed(make, f"{self.key} {self.kinds[self.key]}, term string, tf bigint, tfidf double")

    def topics(self, top: int = 10, min_fraction: float = 0.1, min_papers: int = 3) -> DataFrame:
        """topic_terms. A chunk tells of each cluster the sum of counts, and of the terms only those that some cluster can rank:
        a term of fewer papers than any cluster asks for has too few in each."""
        sizes = self.papers.groupBy("cluster").agg(F.count("*").alias("inside_n"))
        small = sizes.agg(F.min("inside_n")).first()[0] or 0
        least = 0 if self.repeated else max(min_papers, math.ceil(small * min_fraction))

        def make(pa, keys, labels, row, words, places, tf, tfidf, terms):
            at = np.asarray(labels.offsets)
            names = labels.values.slice(at[0], at[-1] - at[0]).dictionary_encode(null_encoding="encode")
            code, kinds = np.asarray(names.indices), len(names.dictionary)
            if len(code) != len(keys):  # a paper of several rows counts for each
                times = np.diff(at)[row]
                first = (at[:-1] - at[0])[row]
                pick = np.repeat(np.arange(len(row)), times)
                nth = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
                own, places, tf, tfidf = code[first[pick] + nth], places[pick], tf[pick], tfidf[pick]
            else:
                own = code[row]
            length = np.bincount(own, tf, kinds).astype(np.int64)
            some = terms.column("df").to_numpy()[places] >= least
            slot = own[some] * np.int64(terms.num_rows) + places[some]
            slot, back = np.unique(slot, return_inverse=True)
            sums = [np.bincount(back, x, len(slot)) for x in (tf[some], np.ones(some.sum()), tfidf[some])] if len(slot) else [np.zeros(0)] * 3
            cluster = names.dictionary.take(pa.array(np.r_[slot // terms.num_rows, np.arange(kinds)].astype(np.int64)))
            term = pa.concat_arrays([terms.column("term").combine_chunks().take(pa.array((slot % terms.num_rows).astype(np.int64))), pa.nulls(kinds, pa.string())])
            none = np.zeros(kinds)
            return [pa.RecordBatch.from_arrays([cluster, term, pa.array(np.r_[sums[0].astype(np.int64), length]), pa.array(np.r_[sums[1], none].astype(np.int64)), pa.array(np.r_[sums[2], none])], names=["cluster", "term", "tf", "inside_count", "inside_sum"])]

        parts = self._weighed(make, f"cluster {self.kinds['cluster']}, term string, tf bigint, inside_count bigint, inside_sum double")
        told = keep(parts.groupBy("cluster", "term").agg(*[F.sum(c).alias(c) for c in ("tf", "inside_count", "inside_sum")]), "inside")
        return rank_topics(told.filter("term IS NOT NULL"), told.filter("term IS NULL AND tf > 0").select("cluster", F.col("tf").alias("length")), sizes, top, min_fraction, min_papers)


def ranked_terms(terms: DataFrame, cluster, ranking: str, kind: str, top: int) -> DataFrame:
    """A cluster's terms of one kind: `word` or `expression` (with a space)."""
    spaced = F.col("term").contains(" ")
    return terms.filter((F.col("cluster") == cluster) & (F.col("ranking") == ranking) & (spaced if kind == "expression" else ~spaced)).orderBy(F.desc("score"), "rank").limit(top)


def expression_names(terms: DataFrame, top: int = 8) -> DataFrame:
    """(cluster, name): the top two-word contrast expressions joined by ` · `."""
    two = terms.filter((F.col("ranking") == "contrast") & F.col("term").contains(" "))
    best = top_by(two, ["cluster"], top, F.asc("rank"), name="place")
    return best.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), " · ").alias("name"))


def passages(papers: DataFrame, key: str, text: str = "text", separator: str = "\n", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, passage, start, end, text, and the columns `also`): the non-empty pieces of texts with their offsets."""
    rows = papers.select(key, *also, F.coalesce(F.col(text), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("r"))
    parts = rows.select(key, *also, "r", F.posexplode(F.split("t", separator)).alias("passage", "text"))
    n = F.length("text").cast("long")
    end = F.sum(n + len(separator)).over(Window.partitionBy("r").orderBy("passage")) - len(separator)
    return parts.select(key, F.col("passage").cast("long").alias("passage"), (end - n).alias("start"), end.alias("end"), "text", *also).filter("text <> ''")


def occurrences(rows: DataFrame, key: str, phrase: str) -> DataFrame:
    """(key, occurrences, passage, text): papers with the phrase, their counts and first passage with it."""
    hit = rows.withColumn("__n", F.regexp_count("text", F.lit(T.phrase_pattern(phrase)))).filter("__n > 0")
    return hit.groupBy(key).agg(F.sum("__n").cast("long").alias("occurrences"), F.min(F.struct("passage", "text")).alias("first")).select(key, "occurrences", "first.passage", "first.text")


def search_expression(found: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Per cluster, zero rows kept: papers, papers containing, percent, occurrences, occurrences per paper."""
    x = labels.join(found.select(key, "occurrences"), key, "left").groupBy("cluster").agg(F.count("*").alias("papers"), F.count("occurrences").alias("containing"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"))
    return x.withColumns({"containing_pct": 100.0 * F.col("containing") / F.col("papers"), "per_paper": F.col("occurrences") / F.col("papers")})


def supporting_papers(found: DataFrame, labels: DataFrame, key: str, cluster) -> DataFrame:
    """Papers with the phrase: whether in the cluster, occurrences, first passage."""
    return found.join(labels, key).withColumn("inside", F.col("cluster") == cluster)


def excerpts(rows: DataFrame, terms: DataFrame, key: str, before: int = 130, length: int = 600) -> DataFrame:
    """(key, term, passage, excerpt): of the terms of a paper's cluster, the first by rank that occurs, in its first passage.
    rows: passages with their cluster. The best is kept while passages are read: texts are not shuffled."""
    asked = terms.select("cluster", "term", "rank", F.split("term", " ")[0].alias("__w"), F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), F.regexp_replace("term", " ", r"\\s+"), F.lit(r"(?![\p{L}\p{N}_])")).alias("__p"))
    w = rows.select(key, "cluster", "passage", "text", F.lower("text").alias("__t")).join(F.broadcast(asked), "cluster")
    hit = w.withColumn("at", F.when(F.contains("__t", "__w"), F.regexp_instr("__t", F.col("__p"))).otherwise(0)).filter("at > 0")
    start = F.greatest(F.lit(0), F.col("at") - 1 - before)
    best = hit.groupBy(key).agg(F.min(F.struct("rank", "passage", "term", F.substring("text", start + 1, F.lit(length)).alias("excerpt"))).alias("b"))
    return best.select(key, "b.term", "b.passage", "b.excerpt")


def search_totals(per_cluster: DataFrame) -> DataFrame:
    """One row: search_expression over all clusters."""
    return per_cluster.agg(F.sum("papers").alias("papers"), F.sum("containing").alias("containing"), F.sum("occurrences").alias("occurrences"))


def caution_examples(rows: DataFrame, key: str, pattern: str, top: int = 5, before: int = 160, after: int = 200) -> DataFrame:
    """The first passages with the pattern, one a paper, `top` papers in key order, with the text around."""
    hit = rows.withColumn("__at", F.regexp_instr("text", F.lit(pattern))).filter("__at > 0")
    first = hit.groupBy(key).agg(F.min(F.struct("passage", "__at", "text")).alias("x")).orderBy(key).limit(top)
    start = F.greatest(F.lit(1), F.col("x.__at") - before)
    return first.select(key, "x.passage", F.substring("x.text", start, F.col("x.__at") - start + after).alias("excerpt"))


def cluster_overview(papers: DataFrame, key: str, text: str, stopwords: tuple[str, ...], top: int = 8, min_df: int = 2) -> DataFrame:
    """(cluster, rank, term, score): contrast over a vocabulary whose expressions skip stop words, terms in `min_df` papers
    or more."""
    return Terms(papers, key, F.col(text), stopwords, min_df, 1.0, kind=1).topics(top, 0.0, 1).filter("ranking = 'contrast'").select("cluster", "rank", "term", "score")

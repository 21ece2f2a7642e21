"""Resolving records across sources: exact and fuzzy titles, identifier aliases, reviewed decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas import contracts
from corpusatlas.functions import text as T
from corpusatlas.operators.grouped import fold_groups
from corpusatlas.operators.ranking import flag_repeated
from corpusatlas.storage import keep


def bibliography_lookup(papers: DataFrame, entries: DataFrame, key: str, least_words: int = 4) -> DataFrame:
    """papers (key, title_key, fallback_key, filename_year) against entries (title_key, doi, year): candidates, doi if all
    candidates agree, year from the file name or else if unique, metadata_status (matched, ambiguous, missing)."""
    lookup = entries.filter("title_key <> ''").groupBy("title_key").agg(F.count("*").alias("candidates"), F.collect_set(F.when(F.col("doi") != "", F.col("doi"))).alias("dois"), F.collect_set("year").alias("years"))
    by_title = papers.join(lookup, "title_key", "left")
    other = lookup.withColumnsRenamed({"title_key": "fallback_key", "candidates": "c2", "dois": "d2", "years": "y2"})
    long = F.regexp_count("fallback_key", F.lit(r"\S+")) >= least_words
    x = by_title.join(other, "fallback_key", "left")
    use = F.col("candidates").isNull() & long & F.col("c2").isNotNull()
    x = x.withColumns({"candidates": F.when(use, F.col("c2")).otherwise(F.coalesce("candidates", F.lit(0))), "dois": F.when(use, F.col("d2")).otherwise(F.col("dois")), "years": F.when(use, F.col("y2")).otherwise(F.col("years"))})
    doi = F.when(F.size("dois") == 1, F.col("dois")[0]).otherwise("")
    year = F.coalesce("filename_year", F.when(F.size("years") == 1, F.col("years")[0]))
    status = F.when(F.col("candidates") == 0, "missing").when(F.size("dois") > 1, "ambiguous").otherwise("matched")
    return x.select(key, F.col("candidates").cast("long").alias("candidates"), doi.alias("doi"), year.alias("year"), status.alias("metadata_status"))


def best_titles(titles: DataFrame, candidates: DataFrame, other: str, block: int = 256) -> DataFrame:
    """(title_key, score, gap, and the columns of candidates): the best candidate (other, cand_key, ...) of each distinct
    title, and its lead over the runner-up, which may have the same title. Null titles count as empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    # of each candidate title, the candidate of the lowest id and whether there are more
    row = F.struct(*[c for c in candidates.columns if c != other])
    one = candidates.filter(F.col(other).isNotNull()).groupBy(text(F.col("cand_key")).alias("k")).agg(F.min(other).alias("id"), F.min_by(row, other).alias("row"), F.count("*").alias("n"))
    parts = one.select(F.pmod(F.xxhash64("k"), F.lit(1 << 20)).alias("h"), "k", "id", (F.col("n") > 1).alias("more"))
    n = max(1, -(-one.count() // block))
    blocks = parts.groupBy((F.col("h") % n).alias("b")).agg(F.array_sort(F.collect_list(F.struct("id", "k", "more"))).alias("c")).select("c")
    asked = titles.select(text(F.col("title_key")).alias("t")).distinct()
    pairs = asked.repartition(asked.sparkSession.sparkContext.defaultParallelism * 4, "t").crossJoin(F.broadcast(blocks) if n <= 16 else blocks)
    top = pairs.select("t", T.two_best(titles.sparkSession, F.col("t"), F.col("c")).alias("top")).select("t", F.explode("top").alias("x")).select("t", "x.*")
    # a block's two best are enough: the best two of all are among them
    two = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "more"))), 1, 2)
    ranked = top.groupBy("t").agg(two.alias("two"))
    first, second = F.col("two")[0], F.get(F.col("two"), F.lit(1))
    gap = F.when(first["more"], 0.0).otherwise(F.coalesce(second["minus"] - first["minus"], F.lit(1.0)))
    chosen = ranked.select(F.col("t").alias("title_key"), first["id"].alias(other), (-first["minus"]).alias("score"), gap.alias("gap"))
    return chosen.join(one.select(F.col("id").alias(other), "row"), other).select("title_key", other, "score", "gap", "row.*")


def resolve_titles(papers: DataFrame, candidates: DataFrame, key: str, other: str, least_words: int = 4, least_gap: float = 0.05) -> DataFrame:
    """papers (key, title_key, doi, year) against candidates (other, cand_key, cand_doi, cand_year): the best candidate by
    ratio, the gap to the next, and a status: strong, review or none.

    Every candidate is ranked, ties by id: each distinct title against each distinct candidate title, in blocks of candidates
    that keep their two best. Strong: equal titles of enough words, and an equal doi, or the same year with a clear gap and
    no other doi. Two papers with one strong candidate go to review. None: without any candidate."""
    best = keep(best_titles(papers.select("title_key"), candidates, other), "titles")  # scored once, read twice
    best = papers.join(best.withColumnRenamed("title_key", "__t"), F.coalesce("title_key", F.lit("")) == F.col("__t")).drop("__t")
    same_doi = (F.col("doi") != "") & (F.col("doi") == F.col("cand_doi"))
    conflict = (F.col("doi") != "") & (F.col("cand_doi") != "") & (F.col("doi") != F.col("cand_doi"))
    strong = (F.col("title_key") == F.col("cand_key")) & (F.regexp_count("title_key", F.lit(r"\S+")) >= least_words) & (same_doi | F.coalesce((F.col("year") == F.col("cand_year")) & (F.col("gap") >= least_gap) & ~conflict, F.lit(False)))
    best = flag_repeated(best.withColumn("claim", F.when(strong, F.col(other).cast("string")).otherwise("")), ["claim"])
    status = F.when(F.col("claim") == "", "review").when(F.col("repeated"), "review").otherwise("strong")
    return papers.select(key).join(best.select(key, other, "score", "gap", status.alias("status")), key, "left").withColumn("status", F.coalesce("status", F.lit("none")))


def unique_aliases(aliases: DataFrame, key: str, alias: str) -> DataFrame:
    """(alias, key) of aliases that name one key only."""
    one = aliases.groupBy(alias).agg(F.count_distinct(key).alias("n"), F.min(key).alias(key)).filter("n = 1")
    return one.select(alias, key)


def alias_edges(references: DataFrame, aliases: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """references (src, alias) to edges (src, dst) through aliases (key, alias) that are unique; reserved aliases, loops and
    repeats go."""
    known = unique_aliases(aliases, "key", "alias")
    if reserved is not None:
        known = known.join(reserved, "alias", "left_anti")
    return references.join(known, "alias").select("src", F.col("key").alias("dst")).filter("src <> dst").distinct()


def two_way_edges(references: DataFrame, by_id: DataFrame, by_doi: DataFrame) -> tuple[DataFrame, DataFrame]:
    """references (src, target_id, target_doi) resolved by id and by doi alias: edges (src, dst, methods) and the conflicts
    where both resolve to different keys."""
    i = unique_aliases(by_id, "key", "alias").withColumnsRenamed({"alias": "target_id", "key": "k1"})
    d = unique_aliases(by_doi, "key", "alias").withColumnsRenamed({"alias": "target_doi", "key": "k2"})
    x = references.join(i, "target_id", "left").join(d, "target_doi", "left")
    conflict = F.col("k1").isNotNull() & F.col("k2").isNotNull() & (F.col("k1") != F.col("k2"))
    ok = x.filter(~conflict & F.coalesce("k1", "k2").isNotNull()).select("src", F.coalesce("k1", "k2").alias("dst"), F.concat_ws("+", F.when(F.col("k1").isNotNull(), "id"), F.when(F.col("k2").isNotNull(), "doi")).alias("method")).filter("src <> dst")
    return ok.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("method")), ";").alias("methods")), x.filter(conflict).select("src", "target_id", "target_doi", "k1", "k2")


def canonical_keys(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """rows with canonical_key through mapping (duplicate_key, canonical_key); chains are an error."""
    chain = mapping.select(F.col("canonical_key").alias("k")).join(mapping.select(F.col("duplicate_key").alias("k")), "k", "left_semi")
    contracts.holds(chain, F.lit(False), "a chained duplicate", "k")
    m = mapping.select(F.col("duplicate_key").alias(key), "canonical_key")
    return rows.join(m, key, "left").withColumns({"is_duplicate": F.col("canonical_key").isNotNull(), "canonical_key": F.coalesce("canonical_key", key)})


def add_manual_edges(edges: DataFrame, manual: DataFrame) -> DataFrame:
    """edges with those of manual that are new; `source` says which."""
    new = manual.join(edges, ["src", "dst"], "left_anti").select("src", "dst").distinct()
    return edges.select("src", "dst", F.lit("provider").alias("source")).unionByName(new.withColumn("source", F.lit("manual")))


def newest(records: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest record of each key."""
    return records.groupBy(key).agg(F.max_by(F.struct(*records.columns), F.struct(*order)).alias("r")).select("r.*")


def front_matches(blocks: DataFrame, references: DataFrame, document: str, most: int = 8, least: float = 0.94) -> DataFrame:
    """Runs of up to `most` neighbouring blocks (document, ord, text) that match the document's reference text, of a length
    within 0.9 to 1.12 of it: the best by ratio."""
    # a document's references come before its blocks, so that its texts are shuffled once
    kind = dict(blocks.dtypes)["ord"]
    asked = references.select(document, F.lit(None).cast(kind).alias("ord"), F.col("reference").alias("text"), F.lit(0).alias("side"))
    rows = asked.unionByName(blocks.select(document, "ord", "text", F.lit(1).alias("side")))

    def run(key, rows):
        from difflib import SequenceMatcher

        wanted, ords, texts, best = [], [], [], None
        for _, at, text, side in rows:
            if side:
                ords.append(at)
                texts.append(text)
            elif text:
                wanted.append(text)
        for reference in wanted:
            matcher, size = SequenceMatcher(None, "", reference), len(reference)
            for i in range(len(texts)):
                length = -1
                ahead = [t for t in texts[i : i + most] if t is not None]
                for n in range(1, len(ahead) + 1):
                    length += 1 + len(ahead[n - 1])
                    if length / size > 1.12:
                        break
                    if length / size < 0.9:
                        continue
                    matcher.set_seq1(" ".join(ahead[:n]))
                    if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and (score := matcher.ratio()) >= least:
                        best = max(best or (-1.0,), (score, -ords[i], -n))
        return [(key, -best[1], -best[2], best[0])] if best else []

    return fold_groups(rows, document, ["side", "ord"], run, f"{document} {dict(blocks.dtypes)[document]}, first {kind}, n int, score double")


def page_mentions(pages: DataFrame, titles: DataFrame, least_words: int = 4, around: int = 170) -> DataFrame:
    """(page_id, title_id, excerpt): normalised titles of enough words (three or more) that occur in normalised page texts,
    words parted by single spaces in both.

    A title's words but its first and last stand in the page as whole words. So its first three inner words (fewer, if it
    has fewer) meet the page's runs of words in an equality join; the text of a meeting page is then searched."""
    words = F.split("title_key", " ")
    inner = F.least(F.size(words) - 2, F.lit(3))
    t = titles.filter((F.regexp_count("title_key", F.lit(r"\S+")) >= max(3, least_words)) & (F.size(words) >= 3)).select("title_id", "title_key", F.xxhash64(F.slice(words, 2, inner)).alias("k"))
    # the words are bound to a variable: in the inner function they would be split anew for each word
    runs_of = lambda w: F.flatten(F.transform(w, lambda _, i: F.array(*[F.xxhash64(F.slice(w, i + 1, n)) for n in (1, 2, 3)])))
    runs = F.transform(F.array(F.split("page_key", " ")), runs_of)[0]
    keys = t.select("k").distinct()
    few = keys.count() <= 100_000
    rows = keep(pages.select("page_id", "page_key").withColumn("r", F.monotonically_increasing_id()), "pages")
    found = rows.select("r", F.explode(F.array_distinct(runs)).alias("k"))
    # runs are many more than pages: unless titles are many too, they are not shuffled
    found = found.join(F.broadcast(keys), "k") if few else found
    met = keep(found.join(t.select("title_id", "k"), "k").select("r", "title_id"), "met")
    hit = rows.join(met, "r").join(t.drop("k"), "title_id")
    at = F.instr("page_key", F.col("title_key"))
    return hit.filter(at > 0).select("page_id", "title_id", F.substring("page_key", F.greatest(F.lit(1), at - around), F.length("title_key") + 2 * around).alias("excerpt"))


def reuse_approved(papers: DataFrame, saved: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """papers with the doi and title of the saved review (approved, match_doi, match_title), empty where it was not approved.
    A review is reused only if its keys, their order and its query fields are those of the papers."""
    columns = [key, order, *fields]
    contracts.same_rows(papers.select(*columns), saved.select(*columns), "the saved review is of another selection")
    own = saved.select(key, *[F.when(F.col("approved"), F.col(c)).otherwise("").alias(f"approved_{c[6:]}") for c in ("match_doi", "match_title")])
    return papers.join(own, key)

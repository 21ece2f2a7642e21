"""Queries on text: normalisation, screening, terms, expressions and readability over `documents`.

A document's first line is its title, the rest its abstract, its source the journal, its language the type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.functions import text as T
from corpusatlas.operators import readability, screening, topics
from corpusatlas.plans.ages import rounded, whole
from corpusatlas.session import table
from corpusatlas.storage import keep

STOP = ("the", "of", "and", "to", "in", "a", "is", "it", "for", "on", "that", "with", "was", "as", "at", "by", "be", "this", "from", "are", "or", "an", "not")
RULES = screening.Rules(core="thand|thing", chemistry="anenan", venture="whon|bleed", startup="edsh", ambiguous="stble", chemistry_journals=("src3",), trade_journals=("src5",), venture_journals=("src7",), other_types=("fr",))
PHRASE = "is the"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def records(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    return docs(spark, d).select("doc_id", lines[0].alias("title"), F.array_join(F.slice(lines, 2, F.size(lines)), " ").alias("abstract"), F.col("source").alias("journal"), F.col("lang").alias("document_type"))


def clustered(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "text", (F.col("doc_id") % 5).alias("cluster"))


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    form = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://doi.org/10.1/A"), "doc_id")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("doi: 10.1/B"), "doc_id")).when(F.col("doc_id") % 4 == 2, F.concat(F.lit(" HTTP://dx.doi.org/10.1/c"), "doc_id"))
    raw = F.concat(F.lit("<p>"), "text", F.lit("</p> P <.001 "), F.when(F.col("doc_id") % 2 == 0, "© 2020 Publisher").otherwise(""))
    x = docs(spark, d).select("doc_id", T.normalize_doi(form).alias("doi"), T.clean_abstract(raw).alias("c"))
    return x.select("doc_id", "doi", F.sha2("c.text", 256).alias("text"), F.col("c.removed").alias("removed"), T.word_count(F.col("c.text")).alias("words"))


def text_unicode_forms(spark: SparkSession, d: str) -> DataFrame:
    x = records(spark, d)
    return x.select("doc_id", T.normalize(F.col("title")).alias("plain"), T.normalize_scope(F.col("title")).alias("scope"), T.normalize_title(F.col("title")).alias("key"))


def screen_decisions(spark: SparkSession, d: str) -> DataFrame:
    out = screening.decide(records(spark, d), RULES)
    return out.select("doc_id", "decision", "reason", "core_in_title", "core_mentions", "core_matches", "venture_matches")


def screen_overrides(spark: SparkSession, d: str) -> DataFrame:
    audit = screening.decide(records(spark, d), RULES).withColumn("record_sha256", F.sha2(F.concat_ws("|", "doc_id", "title"), 256)).select("doc_id", "record_sha256", "decision", "reason")
    overrides = audit.filter("doc_id % 9 = 0").select("doc_id", "record_sha256", F.lit("keep").alias("decision"), F.lit("reviewed").alias("reason"))
    return screening.override(keep(audit, "audit"), overrides, "doc_id").drop("record_sha256")


def screen_funnel(spark: SparkSession, d: str) -> DataFrame:
    x = records(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    stages = [("labelled", F.col("quality").isNotNull()), ("not toxic", F.col("toxic") == 0), ("core", F.concat_ws(" ", "title", "abstract").rlike(RULES.core)), ("no chemistry", ~F.col("abstract").rlike(RULES.chemistry)), ("good", F.col("quality") == 1)]
    return screening.funnel(x, stages)


def mention_positions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(screening.mentions(records(spark, d), "doc_id", "abstract", RULES.core), "word_fraction")


def mention_late_only(spark: SparkSession, d: str) -> DataFrame:
    return screening.late_only(screening.mentions(records(spark, d), "doc_id", "abstract", RULES.core), "doc_id")


def mention_categories(spark: SparkSession, d: str) -> DataFrame:
    x = records(spark, d).withColumns({"phrase": screening.mention_category(F.col("title"), F.col("abstract"), "thand"), "short": screening.mention_category(F.col("title"), F.col("abstract"), "thing")})
    return screening.category_counts(x, ["phrase", "short"])


def mention_rule_comparison(spark: SparkSession, d: str) -> DataFrame:
    return screening.presence_comparison(records(spark, d), F.col("abstract").rlike("thand"), F.col("abstract").rlike("thing"))


def mention_lists(spark: SparkSession, d: str) -> DataFrame:
    return screening.list_mentions(docs(spark, d), "doc_id", "text", r"\bthing\b").withColumn("items", F.array_join("items", "|"))


def passages_explode(spark: SparkSession, d: str) -> DataFrame:
    return topics.passages(docs(spark, d), "doc_id").withColumn("text", F.sha2("text", 256))


def weighed(spark: SparkSession, d: str) -> topics.Terms:
    return topics.Terms(clustered(spark, d), "doc_id", F.col("text"), STOP)


def term_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weighed(spark, d).vocabulary(), "idf")


def term_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(weighed(spark, d).weights(), "tfidf")


def terms(spark: SparkSession, d: str, fraction: float = 0.02) -> DataFrame:
    return weighed(spark, d).topics(10, fraction)


def topic_terms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whole(terms(spark, d), "rank"), "score", "prevalence_gap")


def topic_ranked_words(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whole(topics.ranked_terms(terms(spark, d), 1, "ctfidf", "word", 5), "rank").select("term", "rank", "score"), "score")


def topic_names(spark: SparkSession, d: str) -> DataFrame:
    return topics.expression_names(weighed(spark, d).topics(1000, 0.01), 4)


def search_expression(spark: SparkSession, d: str) -> DataFrame:
    papers = clustered(spark, d)
    found = topics.occurrences(topics.passages(papers, "doc_id"), "doc_id", PHRASE)
    return rounded(topics.search_expression(found, papers.select("doc_id", "cluster"), "doc_id"), "containing_pct", "per_paper")


def supporting_papers(spark: SparkSession, d: str) -> DataFrame:
    papers = clustered(spark, d)
    found = topics.occurrences(topics.passages(papers, "doc_id"), "doc_id", PHRASE)
    return topics.supporting_papers(found, papers.select("doc_id", "cluster"), "doc_id", 2).withColumn("text", F.sha2("text", 256))


def topic_excerpts(spark: SparkSession, d: str) -> DataFrame:
    papers = clustered(spark, d)
    best = keep(terms(spark, d).filter("ranking = 'contrast'"), "best")
    return topics.excerpts(topics.passages(papers, "doc_id", also=("cluster",)).filter("length(text) >= 100"), best, "doc_id").withColumn("excerpt", F.sha2("excerpt", 256))


def readability_scores(spark: SparkSession, d: str) -> DataFrame:
    out = readability.scores(docs(spark, d).select("doc_id", "text"), "text").drop("text")
    return rounded(out, "fog", "flesch")


def readability_by_period(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select(T.time_bin((F.col("doc_id") % 40 + 1990).cast("int")).alias("period"), "text")
    out = readability.summary(readability.scores(x, "text"), "period", "fog")
    return rounded(out, "min", "max", "mean", "median", "std", "q25", "q75")


def readability_flags(spark: SparkSession, d: str) -> DataFrame:
    return readability.quality_flags(readability.scores(docs(spark, d).select("doc_id", "text"), "text")).select("doc_id", "quality_flags")


def search_totals(spark: SparkSession, d: str) -> DataFrame:
    return topics.search_totals(search_expression(spark, d))


def journal_labels(spark: SparkSession, d: str) -> DataFrame:
    patterns = {"stem": "anenan", "ending": "stble", "middle": "whon"}
    return records(spark, d).select("doc_id", screening.labels_matched(F.col("abstract"), patterns).alias("labels"))


def protected_titles(spark: SparkSession, d: str) -> DataFrame:
    x = records(spark, d).filter(F.col("title").rlike(RULES.core))
    return screening.protected_diagnostic(x, {"journal": F.col("journal").isin("src3", "src5"), "startup": F.col("abstract").rlike(RULES.startup), "short": F.length("abstract") < 100})


def caution_examples(spark: SparkSession, d: str) -> DataFrame:
    return topics.caution_examples(topics.passages(clustered(spark, d), "doc_id"), "doc_id", r"the\W+the").withColumn("excerpt", F.sha2("excerpt", 256))


def topic_overview(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whole(topics.cluster_overview(clustered(spark, d), "doc_id", "text", STOP), "rank"), "score")


QUERIES = {f.__name__: f for f in (text_normalize, text_unicode_forms, screen_decisions, screen_overrides, screen_funnel, mention_positions, mention_late_only, mention_categories, mention_rule_comparison, mention_lists, passages_explode, term_vocabulary, term_weights, topic_terms, topic_ranked_words, topic_names, search_expression, supporting_papers, topic_excerpts, readability_scores, readability_by_period, readability_flags, search_totals, journal_labels, protected_titles, caution_examples, topic_overview)}

_REC = "rec AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, array_to_string(string_split(text, chr(10))[2:], ' ') AS abstract, source AS journal, lang AS document_type FROM documents)"


def _matches(name: str) -> str:
    p = getattr(RULES, name)
    m = f"regexp_extract_all(concat_ws(' ', title, abstract), '{p}')"
    return f"array_to_string(list_filter({m}, lambda x, i: list_position({m}, x) = i), '; ') AS {name}_matches"


_DEC = f"""{_REC}, f AS (SELECT *, regexp_matches(title, '{RULES.core}') AS core_in_title, len(regexp_extract_all(abstract, '{RULES.core}')) AS core_mentions, {", ".join(map(_matches, ("core", "chemistry", "venture", "startup", "ambiguous")))} FROM rec),
x AS (SELECT *, core_in_title OR core_mentions >= 2 AS core FROM f),
dec AS (SELECT *, CASE WHEN chemistry_matches <> '' OR journal = 'src3' THEN ['exclude', 'chemistry'] WHEN journal = 'src5' THEN ['exclude', 'trade journal'] WHEN venture_matches <> '' AND (NOT core OR journal = 'src7') THEN ['exclude', 'venture capital']
 WHEN venture_matches <> '' THEN ['review', 'venture capital'] WHEN startup_matches <> '' AND core THEN ['review', 'startup'] WHEN startup_matches <> '' THEN ['exclude', 'startup'] WHEN ambiguous_matches <> '' THEN ['review', 'ambiguous financing']
 WHEN core_matches = '' THEN ['exclude', 'not mentioned'] WHEN document_type = 'fr' THEN ['review', 'document type'] WHEN NOT core THEN ['review', 'not central'] ELSE ['keep', 'core'] END AS v FROM x)"""
_WORD = r"[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*"
_MEN = f"""{_REC}, p AS (SELECT doc_id, abstract, list_transform(regexp_split_to_array(abstract, '{RULES.core}'), lambda x: length(x)) AS p, list_transform(regexp_extract_all(abstract, '{RULES.core}'), lambda x: length(x)) AS m FROM rec),
spot AS (SELECT doc_id, abstract, i AS mention, list_sum(p[1:i]) + coalesce(list_sum(m[1:i - 1]), 0) AS start FROM p, unnest(range(1, len(m) + 1)) AS u(i)),
men AS (SELECT doc_id, mention, len(regexp_extract_all(abstract, '{_WORD}')) AS words, len(regexp_extract_all(substr(abstract, 1, start::BIGINT), '{_WORD}')) AS word_index FROM spot)"""
_STOP = ", ".join(f"'{s}'" for s in STOP)
_EN = "en AS (SELECT doc_id, text, doc_id % 5 AS cluster FROM documents)"
_GOOD = "(length({0}) >= 2 AND NOT regexp_matches({0}, '^\\p{{Nd}}') AND {0} NOT IN (" + _STOP + "))"
_RUNS = f"""{_EN},
runs AS (SELECT doc_id, unnest(list_transform(regexp_split_to_array(replace(lower(text), '-', ' '), '[.!?;:\\n\\r,()\\[\\]{{}}]+'), lambda s: regexp_extract_all(s, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+|\\p{{Nd}}+'))) AS r FROM en),
tok AS (SELECT doc_id, w AS term FROM runs, unnest(r) AS u(w) WHERE {_GOOD.format('w')} UNION ALL SELECT doc_id, r[i] || ' ' || r[i + 1] FROM runs, unnest(range(1, len(r))) AS u(i) WHERE {_GOOD.format('r[i]')} AND {_GOOD.format('r[i + 1]')})"""
_WORDS = f"""{_EN}, ws AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS w FROM en),
tok AS (SELECT doc_id, unnest(w) AS term FROM ws UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM ws, unnest(range(1, len(w))) AS u(i))"""

def _weights(tok: str, min_df: int, max_df: float) -> str:
    """Counts, vocabulary and weights of the tokens (doc_id, term)."""
    return f"""{tok},
cnt AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), np AS (SELECT count(*) AS n FROM en),
voc AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM cnt GROUP BY 1), np WHERE df >= {min_df} AND df <= {max_df} * n),
raw AS (SELECT doc_id, term, tf, (1 + ln(tf)) * idf AS w FROM cnt JOIN voc USING (term)), tw AS (SELECT doc_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM raw)"""


_TOK, _ALL_TOK = _weights(_RUNS, 3, 0.9), _weights(_WORDS, 2, 1.0)


def _topics(fraction: float, top: int, tok: str = _TOK, least: int = 3) -> str:
    return f"""{tok}, sz AS (SELECT cluster, count(*) AS inside_n FROM en GROUP BY 1), ins AS (SELECT cluster, term, sum(tf) AS tf, count(*) AS inside_count, sum(tfidf) AS s FROM tw JOIN en USING (doc_id) GROUP BY ALL),
ov AS (SELECT term, sum(tf) AS ctf, sum(inside_count) AS df, sum(s) AS alls FROM ins GROUP BY 1), len_ AS (SELECT cluster, sum(tf) AS length FROM ins GROUP BY 1),
sc AS (SELECT cluster, term, inside_count, inside_n, (df - inside_count)::BIGINT AS outside_count, n - inside_n AS outside_n, tf / length * ln(1 + (SELECT avg(length) FROM len_) / ctf) AS a, s / inside_n - (alls - s) / (n - inside_n) AS b FROM ins JOIN ov USING (term) JOIN sz USING (cluster) JOIN len_ USING (cluster), np),
both_ AS (SELECT * EXCLUDE (a, b), 'ctfidf' AS ranking, a AS score FROM sc UNION ALL SELECT * EXCLUDE (a, b), 'contrast', b FROM sc),
top_ AS (SELECT *, row_number() OVER (PARTITION BY cluster, ranking ORDER BY round(score, 9) DESC, term) AS rank FROM both_ WHERE score > 0 AND inside_count >= greatest({least}, ceil(inside_n * {fraction}))),
terms AS (SELECT * FROM top_ WHERE rank <= {top})"""


_PAS = """en AS (SELECT doc_id, text, doc_id % 5 AS cluster FROM documents), pas AS (SELECT doc_id, i - 1 AS passage, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM en), unnest(range(1, len(l) + 1)) AS u(i) WHERE l[i] <> ''),
tk AS (SELECT doc_id, passage, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w, regexp_split_to_array(lower(text), '[\\p{L}\\p{N}_]+') AS g FROM pas),
k AS (SELECT doc_id, passage, text, len(list_filter(range(1, len(w)), lambda i: w[i] = 'is' AND w[i + 1] = 'the' AND regexp_full_match(g[i + 1], '[\\s-]+'))) AS k FROM tk),
hit AS (SELECT doc_id, sum(k)::BIGINT AS occurrences, min(passage) AS passage, arg_min(text, passage) AS text FROM k WHERE k > 0 GROUP BY 1)"""
_V = readability.VOWELS
_READ = f"""c AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda w: greatest(1, len(regexp_extract_all(w, '[{_V}]+')))) AS g, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS sentences FROM documents),
r AS (SELECT doc_id, len(g) AS words, sentences, coalesce(list_sum(g), 0)::BIGINT AS syllables, len(list_filter(g, lambda x: x >= 3)) AS complex_words FROM c),
sco AS (SELECT *, CASE WHEN words > 0 THEN 0.4::DOUBLE * (words / sentences + 100.0::DOUBLE * complex_words / words) END AS fog, CASE WHEN words > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * words / sentences - 84.6::DOUBLE * syllables / words END AS flesch FROM r)"""

ORACLES = {
    "text_normalize": r"""WITH raw AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://doi.org/10.1/A' || doc_id WHEN 1 THEN 'doi: 10.1/B' || doc_id WHEN 2 THEN ' HTTP://dx.doi.org/10.1/c' || doc_id END AS doi, '<p>' || text || '</p> P <.001 ' || CASE WHEN doc_id % 2 = 0 THEN '© 2020 Publisher' ELSE '' END AS t FROM documents),
c AS (SELECT doc_id, lower(trim(regexp_replace(trim(coalesce(doi, '')), '(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', ''))) AS doi,
  trim(regexp_replace(translate(regexp_replace(t, '(?i)</?(?:p|br|div|span|b|i|em|strong|sub|sup|jats:p)\b[^>]*>', ' ', 'g'), chr(173) || chr(8203) || chr(65279), ''), '[\s\p{Z}]+', ' ', 'g')) AS t FROM raw),
x AS (SELECT doc_id, doi, t, regexp_extract(t, '(?is)^(.*?)(?:©|\bcopyrights?\s*:?\s*(?:©|\d{4}|the author))', 1) AS head, regexp_matches(t, '(?i)(?:©|\bcopyrights?\s*:?\s*(?:©|\d{4}|the author))') AS cut, lower(t) IN ('', '[no abstract available]', 'no abstract available', 'n/a', 'null') AS missing FROM c),
y AS (SELECT doc_id, doi, CASE WHEN missing THEN '' WHEN cut THEN rtrim(head) ELSE t END AS text, CASE WHEN cut AND NOT missing THEN substr(t, length(head) + 1) ELSE '' END AS removed FROM x)
SELECT doc_id, doi, sha256(text) AS text, removed, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM y""",
    "screen_decisions": f"WITH {_DEC} SELECT doc_id, v[1] AS decision, v[2] AS reason, core_in_title, core_mentions, core_matches, venture_matches FROM dec",
    "screen_overrides": f"WITH {_DEC} SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'keep' ELSE v[1] END AS decision, CASE WHEN doc_id % 9 = 0 THEN 'reviewed' ELSE v[2] END AS reason, v[1] AS automatic_decision, doc_id % 9 = 0 AS manual_override FROM dec",
    "screen_funnel": f"""WITH {_REC}, l AS (SELECT *, quality IS NOT NULL AS a, coalesce(toxic = 0, false) AS b, regexp_matches(concat_ws(' ', title, abstract), '{RULES.core}') AS c, NOT regexp_matches(abstract, '{RULES.chemistry}') AS d, coalesce(quality = 1, false) AS e FROM rec LEFT JOIN labels USING (doc_id)),
n AS (SELECT [count(*), count(*) FILTER (a), count(*) FILTER (a AND b), count(*) FILTER (a AND b AND c), count(*) FILTER (a AND b AND c AND d), count(*) FILTER (a AND b AND c AND d AND e)] AS n FROM l)
SELECT (i - 1)::BIGINT AS position, ['all', 'labelled', 'not toxic', 'core', 'no chemistry', 'good'][i] AS stage, n[i] AS papers, CASE WHEN i = 1 THEN 0 ELSE n[i - 1] - n[i] END AS dropped FROM n, unnest(range(1, 7)) AS u(i)""",
    "mention_positions": f"WITH {_MEN} SELECT doc_id, mention, word_index, words, round(word_index / words, 6) AS word_fraction FROM men",
    "mention_late_only": f"WITH {_MEN} SELECT doc_id, count(*) AS mentions, bool_and(word_index / words >= 2.0::DOUBLE / 3) AS late_only FROM men GROUP BY 1",
    "mention_categories": f"""WITH {_REC}, x AS (SELECT 'phrase' AS method, regexp_matches(title, 'thand') AS a, regexp_matches(abstract, 'thand') AS b FROM rec UNION ALL SELECT 'short', regexp_matches(title, 'thing'), regexp_matches(abstract, 'thing') FROM rec),
y AS (SELECT method, CASE WHEN a AND b THEN 'both' WHEN a THEN 'title_only' WHEN b THEN 'abstract_only' ELSE 'neither' END AS category FROM x)
SELECT method, category, (SELECT count(*) FROM y WHERE y.method = m.method AND y.category = c.category) AS papers FROM (SELECT unnest(['phrase', 'short']) AS method) m, (SELECT unnest(['neither', 'title_only', 'abstract_only', 'both']) AS category) c""",
    "mention_rule_comparison": f"WITH {_REC}, x AS (SELECT regexp_matches(abstract, 'thand') AS a, regexp_matches(abstract, 'thing') AS b FROM rec) SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (b AND NOT a) AS second_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM x",
    "passages_explode": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, i - 1 AS passage, l[i] AS text, (coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0))::BIGINT AS start FROM l, unnest(range(1, len(l) + 1)) AS u(i)) SELECT doc_id, passage, start, start + length(text) AS end, sha256(text) AS text FROM p WHERE text <> ''",
    "term_vocabulary": f"WITH {_TOK} SELECT term, df, round(idf, 6) AS idf FROM voc",
    "term_weights": f"WITH {_TOK} SELECT doc_id, term, tf, round(tfidf, 6) AS tfidf FROM tw",
    "topic_terms": f"WITH {_topics(0.02, 10)} SELECT cluster, ranking, rank, term, round(score, 6) AS score, inside_count, inside_n, outside_count, outside_n, round(inside_count / inside_n - outside_count / outside_n, 6) AS prevalence_gap FROM terms",
    "topic_ranked_words": f"WITH {_topics(0.02, 10)} SELECT term, rank, round(score, 6) AS score FROM terms WHERE cluster = 1 AND ranking = 'ctfidf' AND NOT contains(term, ' ') ORDER BY score DESC, rank LIMIT 5",
    "topic_names": f"WITH {_topics(0.01, 1000)}, e AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY rank) AS r FROM terms WHERE ranking = 'contrast' AND contains(term, ' ')) SELECT cluster, string_agg(term, ' · ' ORDER BY r) AS name FROM e WHERE r <= 4 GROUP BY 1",
    "search_expression": f"WITH {_PAS} SELECT cluster, count(*) AS papers, count(occurrences) AS containing, coalesce(sum(occurrences), 0)::BIGINT AS occurrences, round((100.0::DOUBLE * count(occurrences) / count(*)), 6) AS containing_pct, round(coalesce(sum(occurrences), 0) / count(*), 6) AS per_paper FROM en LEFT JOIN hit USING (doc_id) GROUP BY 1",
    "search_totals": f"WITH {_PAS} SELECT count(*) AS papers, count(occurrences) AS containing, coalesce(sum(occurrences), 0)::BIGINT AS occurrences FROM en LEFT JOIN hit USING (doc_id)",
    "journal_labels": f"WITH {_REC} SELECT doc_id, concat_ws('; ', CASE WHEN regexp_matches(abstract, 'anenan') THEN 'stem' END, CASE WHEN regexp_matches(abstract, 'stble') THEN 'ending' END, CASE WHEN regexp_matches(abstract, 'whon') THEN 'middle' END) AS labels FROM rec",
    "protected_titles": f"WITH {_REC}, x AS (SELECT (journal IN ('src3', 'src5'))::INT AS a, regexp_matches(abstract, '{RULES.startup}')::INT AS b, (length(abstract) < 100)::INT AS c FROM rec WHERE regexp_matches(title, '{RULES.core}')) SELECT count(*) FILTER (a = 1) AS journal, count(*) FILTER (b = 1) AS startup, count(*) FILTER (c = 1) AS short, count(*) FILTER (a + b + c > 0) AS any, count(*) FILTER (a + b + c > 1) AS several FROM x",
    "supporting_papers": f"WITH {_PAS} SELECT doc_id, occurrences, passage, sha256(hit.text) AS text, cluster, cluster = 2 AS inside FROM hit JOIN en USING (doc_id)",
    "readability_scores": f"WITH {_READ} SELECT doc_id, words, sentences, syllables, complex_words, round(fog, 6) AS fog, round(flesch, 6) AS flesch FROM sco",
    "readability_by_period": f"""WITH {_READ}, p AS (SELECT CASE WHEN y <= 1999 THEN '≤1999' ELSE (y // 10 * 10) || '–' || least(y // 10 * 10 + 9, 2026) END AS period, fog FROM (SELECT doc_id % 40 + 1990 AS y, fog FROM sco))
SELECT period, count(*) AS n, count(fog) AS scored, round(min(fog), 6) AS min, round(max(fog), 6) AS max, round(avg(fog), 6) AS mean, round(median(fog), 6) AS median, round(stddev_samp(fog), 6) AS std, round(quantile_cont(fog, 0.25), 6) AS q25, round(quantile_cont(fog, 0.75), 6) AS q75 FROM p GROUP BY 1""",
    "readability_flags": f"WITH {_READ} SELECT doc_id, concat_ws('; ', CASE WHEN words < 100 THEN 'few_words' END, CASE WHEN words / sentences > 60 THEN 'long_sentences' END, CASE WHEN words = 0 THEN 'no_prose' END) AS quality_flags FROM sco",
    "topic_overview": f"WITH {_topics(0.0, 8, _ALL_TOK, 1)} SELECT cluster, rank, term, round(score, 6) AS score FROM terms WHERE ranking = 'contrast'",
    "topic_excerpts": f"""WITH {_topics(0.02, 10)}, pas AS (SELECT doc_id, cluster, i - 1 AS passage, l[i] AS text FROM (SELECT doc_id, cluster, string_split(text, chr(10)) AS l FROM en), unnest(range(1, len(l) + 1)) AS u(i) WHERE length(l[i]) >= 100),
c AS (SELECT doc_id, passage, pas.text, term, rank, '(?s)^(.*?(?:^|[^\\p{{L}}\\p{{N}}_]))' || replace(term, ' ', '\\s+') || '(?:[^\\p{{L}}\\p{{N}}_]|$)' AS p FROM pas JOIN terms USING (cluster) WHERE ranking = 'contrast' AND contains(lower(pas.text), string_split(term, ' ')[1])),
h AS (SELECT *, length(regexp_extract(lower(text), p, 1)) AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY rank, passage) AS r FROM c WHERE regexp_matches(lower(text), p))
SELECT doc_id, term, passage, sha256(substr(text, greatest(0, pos - 130) + 1, 600)) AS excerpt FROM h WHERE r = 1""",
    "caution_examples": r"""WITH pas AS (SELECT doc_id, i - 1 AS passage, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)),
h AS (SELECT doc_id, min(passage) AS passage, arg_min(text, passage) AS text FROM pas WHERE regexp_matches(text, 'the\W+the') GROUP BY 1 ORDER BY 1 LIMIT 5), a AS (SELECT *, length(regexp_extract(text, '^(.*?)the\W+the', 1)) + 1 AS pos FROM h)
SELECT doc_id, passage, sha256(substr(text, greatest(1, pos - 160), pos - greatest(1, pos - 160) + 200)) AS excerpt FROM a""",
    "text_unicode_forms": f"""WITH {_REC}, p AS (SELECT doc_id, trim(regexp_replace(nfc_normalize(coalesce(title, '')), '[\\s\\p{{Z}}]+', ' ', 'g')) AS plain FROM rec)
SELECT doc_id, plain, replace(lower(plain), 'ß', 'ss') AS scope, trim(regexp_replace(replace(replace(lower(strip_accents(plain)), 'ß', 'ss'), '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS key FROM p""",
}

"""Text functions as columns; Python (Arrow) only where Spark has no such function: Unicode forms, entities, ratios."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpusatlas.functions.java import register

#: What search and index treat as dashes, and characters without width.
DASHES = "‐‑‒–—−"
INVISIBLE = "­​﻿"
DOI_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"
#: Formatting tags, what stands for a missing abstract, and how publishers' notices begin.
TAGS = r"(?i)</?(?:jats:p|strong|span|div|sub|sup|br|em|p|b|i)\b[^>]*>"
MISSING = ("", "[no abstract available]", "no abstract available", "n/a", "null")
COPYRIGHT = r"(?i)(?:©|\bcopyrights?\s*:?\s*(?:©|\d{4}|the author))"
FAIR_DEALING = ("Apart from any fair dealing for the purposes of research or private study,", "Copyright, Designs and Patents Act 1988")
SCOPE_DASHES = "–—‑‐"


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def once(value: Column, use) -> Column:
    """use(value), with the value computed once: bound to a variable, not written out wherever it is used."""
    return F.transform(F.array(value), use)[0]


def normalize_doi(c: Column) -> Column:
    """Lower-case DOI without resolver or `doi:` prefix; null becomes empty."""
    return F.lower(F.trim(F.regexp_replace(F.trim(empty_if_null(c)), DOI_PREFIX, "")))


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(empty_if_null(c), r"[\s\p{Z}]+", " "))


def word_count(c: Column) -> Column:
    return F.size(F.array_remove(F.split(F.trim(empty_if_null(c)), r"\s+"), "")).cast("long")


def embedding_text(title: Column, abstract: Column) -> Column:
    return F.concat_ws("\n\n", F.nullif(title, F.lit("")), F.nullif(abstract, F.lit("")))


def clean_abstract(c: Column, decoded: bool = True) -> Column:
    """struct(text, removed): formatting tags to spaces, placeholders to nothing, a fair-dealing notice removed whole, any
    other text cut at the first copyright notice. Entities and Unicode forms are those of `normalize`, which texts that are
    not decoded go through."""
    t = F.regexp_replace(empty_if_null(c), TAGS, " ")
    t = collapse(F.translate(t, INVISIBLE, "")) if decoded else normalize(t)
    opening, act = FAIR_DEALING

    def part(t: Column) -> Column:
        at = F.when((F.length(t) <= max(map(len, MISSING))) & F.lower(t).isin(*MISSING), -1).when(t.startswith(opening) & t.contains(act), 1).otherwise(F.regexp_instr(t, F.lit(COPYRIGHT)))
        return once(at, lambda at: F.struct(F.when(at < 0, "").when(at > 0, F.rtrim(F.substring(t, F.lit(1), at - 1))).otherwise(t).alias("text"), F.when(at > 0, F.substring(t, at, F.length(t))).otherwise("").alias("removed")))

    return once(t, part)


def title_and_year(filename: Column) -> Column:
    """struct(title, year) of a name like `Author - 2001 - Title.pdf`, parted at the first year between dashes; nulls if it
    has none."""
    stem = F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"(?<=.)\.[^.]*$", "")
    year = F.regexp_extract(stem, r"\s-\s+((?:19|20)\d{2})\s+-\s", 1)
    title = F.regexp_extract(stem, r"^.*?\s-\s+(?:19|20)\d{2}\s+-\s+(.*)$", 1)
    return F.struct(F.when(year != "", title).alias("title"), F.when(year != "", year.cast("int")).alias("year"))


def preview(blocks: Column) -> Column:
    """Blocks (id, type, page, text) as one readable text: a bracketed line for each, its text below, a blank line between."""
    return F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("[page "), F.coalesce(b["page"].cast("string"), F.lit("?")), F.lit(" | "), b["type"], F.lit(" | "), b["id"], F.lit("]\n"), F.coalesce(b["text"], F.lit("")))), "\n\n")


def match_evidence(c: Column, pattern: str) -> Column:
    """The distinct matches in order of appearance, joined by `; `."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))), "; ")


def term_tokens(c: Column, stopwords: tuple[str, ...], form_kc: bool = True) -> Column:
    """Words of two letters or more that are not stop words, and two-word expressions of such words side by side. Sentence
    punctuation, digits and stop words part expressions; hyphens count as spaces. Texts are brought to NFKC unless the
    caller says that they are (form_kc=False); pure ASCII needs no such form."""
    plain = empty_if_null(c)
    text = F.translate(F.lower(nfkc(plain) if form_kc else plain), "-", " ")
    runs = F.transform(F.split(text, r"[.!?;:\n\r,()\[\]{}]+"), lambda s: F.regexp_extract_all(s, F.lit(r"([\p{L}\p{Nl}\p{No}]+|\p{Nd}+)"), F.lit(1)))
    # each word is judged once: what is no term becomes null and parts expressions
    good = F.transform(runs, lambda r: F.transform(r, lambda w: F.when((F.length(w) >= 2) & ~w.rlike(r"^\p{Nd}") & ~w.isin(*stopwords), w)))
    pairs = F.transform(good, lambda r: F.transform(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(r, i + 1))))
    return F.array_compact(F.flatten(F.concat(good, pairs)))


def phrase_pattern(phrase: str, gap: str = r"[\s-]+") -> str:
    """The phrase as whole words, any gap between its words, any case."""
    import re

    return r"(?iu)(?<![\p{L}\p{N}_])" + gap.join(re.escape(w) for w in phrase.split()) + r"(?![\p{L}\p{N}_])"


def time_bin(year: Column, early_end: int = 1999, last: int = 2026) -> Column:
    """Up to early_end, then decades, the last one up to `last`; unknown without a year."""
    decade = F.floor(year / 10) * 10
    end = F.least(decade + 9, F.lit(last))
    return F.when(year.isNull(), "unknown").when(year <= early_end, F.lit(f"≤{early_end}")).otherwise(F.format_string("%d–%d", decade.cast("long"), end.cast("long")))


def _unicode(form: str):
    @F.pandas_udf("string")
    def norm(texts):
        import unicodedata

        return texts.fillna("").map(lambda t: unicodedata.normalize(form, t))

    return norm


def nfkc(c: Column) -> Column:
    return _unicode("NFKC")(c)


def normalize(c: Column) -> Column:
    """Entities decoded, NFC, characters without width dropped, white space collapsed."""

    @F.pandas_udf("string")
    def form(texts):
        import html
        import unicodedata

        return texts.fillna("").map(lambda t: unicodedata.normalize("NFC", html.unescape(t)))

    return collapse(F.translate(form(c), INVISIBLE, ""))


def normalize_scope(c: Column) -> Column:
    """NFKC, dashes and hyphens as - (minus signs and figure dashes stay), soft hyphens dropped, white space collapsed, case
    folded."""

    @F.pandas_udf("string")
    def fold(texts):
        return texts.map(lambda t: t.casefold())

    return fold(collapse(F.translate(F.translate(nfkc(c), "­", ""), SCOPE_DASHES, "-" * len(SCOPE_DASHES))))


class Folding(dict):
    """What str.translate makes of a decomposed, case-folded character: letters and digits stay, marks go, an ampersand is
    the word, anything else parts words. Filled as characters are met."""

    def __missing__(self, code: int):
        import unicodedata

        c = chr(code)
        self[code] = c if c.isalnum() else None if unicodedata.combining(c) else " and " if c == "&" else " "
        return self[code]


def normalize_title(c: Column) -> Column:
    """The words of a title in lower case without accents, & as and, one space between them."""

    @F.pandas_udf("string")
    def norm(texts):
        fold = Folding()
        return texts.fillna("").str.normalize("NFKD").str.casefold().str.translate(fold).str.split().str.join(" ")

    return norm(c)


def similarity_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Twice the characters in matching blocks over all characters (order matters; not an edit distance). Pairs whose shared
    characters can't bring them to `least` get 0."""

    @F.pandas_udf("double")
    def ratio(x, y):
        import pandas as pd
        from difflib import SequenceMatcher

        out = []
        for s, t in zip(x, y, strict=True):
            m = SequenceMatcher(None, s or "", t or "")
            out.append(m.ratio() if not least or (m.real_quick_ratio() >= least and m.quick_ratio() >= least) else 0.0)
        return pd.Series(out, dtype=float)

    return ratio(a, b)


def two_best(spark: SparkSession, text: Column, choices: Column) -> Column:
    """Of choices (k, id, more), the two whose k has the highest similarity_ratio to text, the earlier of equal ones, as
    (id, more, score). In Java: difflib takes most of a second for a thousand pairs."""
    r = F.call_function(register(spark, "TitleRatio", "array<double>"), text, F.transform(choices, lambda c: c["k"]))
    one = lambda x, i: F.struct(F.get(choices, x[i].cast("int"))["id"].alias("id"), F.get(choices, x[i].cast("int"))["more"].alias("more"), x[i + 1].alias("score"))
    both = F.transform(F.array(r), lambda x: F.array(F.when(x[0] >= 0, one(x, 0)), F.when(x[2] >= 0, one(x, 2))))
    return F.array_compact(F.flatten(both))

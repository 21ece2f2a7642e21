"""Toxicity scores from a lexicon that is learned, matched by Levenshtein automata on a trie.

Lexicon: words and word beginnings (marked *) that toxic training documents use in several contexts and clean ones
hardly ever; contexts (the word before) rather than documents are counted, so copies of one document do not make its words
terms. A word of a text is matched by running its Levenshtein automaton along the trie (terms of `fuzzy_from` letters or
more may have one error, of three times that two; two swapped letters are one error); beginnings match exactly. Only words
that become equal to a term when both lose as many letters as it may have errors reach the automaton, which leaves out no
match. Misspellings that clean training documents contain are not taken.

Each match counts by its term's weight, less for a misspelling, and less in a context window that quotes (a quotation
mark on either side within `window` words) or reports (a word of saying or denying). A logistic regression on the sum and
its share of the words gives the score. The training sample is bounded: `max_rows` labelled documents of each class.

The table may hold: null or empty texts (scored as texts without a match), texts of any length (work grows with the
words), null doc_ids (never in training), repeated rows (labels: toxic if any row says so), no label at all (every score
is 0), nothing, any other columns (kept by `score`; one of the score's own name is replaced).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusatlas.llm.common import free_name, only

WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»‘’']")
QUOTES = frozenset("\"“”„«»‘’'")
#: Words that report or deny what they govern: fixed values of this operator.
REPORTING = frozenset("said says called quoted wrote word term slur insult not never".split())
#: Lengths of the beginnings that may become terms.
PREFIXES = range(3, 9)


def shortened(word: str, most: int) -> set[str]:
    """The word, and what is left of it without 1 to `most` of its letters."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


class Trie:
    """Terms with weights; children by character, all in dictionaries."""

    def __init__(self, terms: dict[str, float], fuzzy_from: int = 5, most_known: int = 100_000):
        self.fuzzy_from, self.most_known, self.root = fuzzy_from, most_known, {}
        heads, short, lengths = set(), set(), set()
        for term, weight in terms.items():
            node, stem, end = self.root, term.rstrip("*"), "*" if term.endswith("*") else ""
            for c in stem:
                node = node.setdefault(c, {})
            node[end] = max(weight, node.get(end, 0.0))
            heads.add(stem[:3])
            if not end and self.errors(len(stem)):
                lengths.add(len(stem))
                short |= shortened(stem, self.errors(len(stem)))
        self.heads, self.short = frozenset(heads), frozenset(short)
        # errors that a word of a length may have against any term
        self.budget = {n: k for n in range(max(lengths, default=0) + 3) if (k := max((self.errors(m) for m in lengths if abs(m - n) <= self.errors(m)), default=0))}
        self.known: dict[str, tuple[float, bool]] = {}

    def match_all(self, words) -> dict[str, tuple[float, bool]]:
        """The matches among words."""
        known, out = self.known, {}
        for w in words:
            if (got := known.get(w)) is None:
                if len(known) >= self.most_known:
                    known.clear()
                got = known[w] = self.match(w)
            if got[0]:
                out[w] = got
        return out

    def errors(self, n: int) -> int:
        """How many a term of n letters may have."""
        return 0 if n < self.fuzzy_from else 1 if n < 3 * self.fuzzy_from else 2

    def match(self, word: str) -> tuple[float, bool]:
        """The greatest weight of a matching term (0: none), exact ones first; whether it is exact."""
        if word[:3] in self.heads and (exact := self._exact(word)):
            return exact
        k = self.budget.get(len(word), 0)
        if k and not self.short.isdisjoint(shortened(word, k)):
            return self._fuzzy(word, k), False
        return 0.0, False

    def _exact(self, word: str):
        node, best = self.root, 0.0
        for c in word:
            if "*" in node:
                best = max(best, node["*"])
            if (node := node.get(c)) is None:
                break
        else:
            best = max(best, node.get("", 0.0), node.get("*", 0.0))
        return (best, True) if best else None

    def _fuzzy(self, word: str, k: int) -> float:
        """Walks automaton and trie together. The automaton's state holds, per number of errors up to k, the set of places
        in the word that can be reached, as bits."""
        n, at = len(word), defaultdict(int)
        for i, c in enumerate(word):
            at[c] |= 1 << i
        final, best = 1 << n, 0.0
        keep = (final << 1) - 1
        start = [(1 << (e + 1)) - 1 & keep for e in range(k + 1)]  # e letters of the word left out
        stack = [(self.root, start, [0] * (k + 1), 0)]
        while stack:
            node, state, turned, depth = stack.pop()
            for c, child in node.items():
                if c == "":
                    if any(s & final for s in state[: self.errors(depth) + 1]):
                        best = max(best, child)
                    continue
                if c == "*":
                    continue
                new, swap, here = [], [], at.get(c, 0)
                for e in range(k + 1):
                    now = (state[e] & here) << 1
                    if e:
                        # a letter of the term left out, another in its place, a letter too many, two letters swapped
                        now |= state[e - 1] | state[e - 1] << 1 | new[-1] << 1 | (turned[e] & here) << 2
                    new.append(now & keep)
                    swap.append(state[e - 1] & here >> 1 if e else 0)
                if any(new) or any(swap):
                    stack.append((child, new, swap, depth + 1))
        return best


class Scorer:
    def __init__(self, terms: dict[str, float], safe: frozenset[str] = frozenset(), window: int = 6, fuzzy_weight: float = 0.6, quoted_weight: float = 0.3):
        self.trie, self.safe, self.window, self.fuzzy_weight, self.quoted_weight = Trie(terms), safe, window, fuzzy_weight, quoted_weight
        self.beta = np.array([-50.0, 0.0, 0.0])

    def hits(self, words: set[str]) -> dict[str, float]:
        found = self.trie.match_all(words)
        return {w: weight if exact else weight * self.fuzzy_weight for w, (weight, exact) in found.items() if exact or w not in self.safe}

    def features(self, text: str | None) -> tuple[float, float]:
        low = (text or "").lower()
        words = WORD.findall(low)
        found = self.hits(set(words))
        if not found:
            return 0.0, 0.0
        tokens, total = TOKEN.findall(low), 0.0
        for i, w in enumerate(tokens):
            if w in found:
                before, after = tokens[max(0, i - self.window) : i], tokens[i + 1 : i + 1 + self.window]
                quoted = not QUOTES.isdisjoint(before) and not QUOTES.isdisjoint(after) or not REPORTING.isdisjoint(before)
                total += found[w] * (self.quoted_weight if quoted else 1.0)
        return float(np.log1p(total)), float(np.log1p(100 * total / len(words)))

    def train(self, texts: list[str], toxic: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> None:
        """Newton's method on the penalised likelihood, classes weighted alike."""
        x = np.c_[np.ones(len(texts)), np.array([self.features(t) for t in texts]).reshape(-1, 2)]
        y = toxic.astype(float)
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        beta = np.zeros(3)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (weight * (y - p)) - ridge * len(y) * np.array([0, 1, 1]) * beta * 0.01
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, ridge * len(y) * 0.01 + 1e-9, ridge * len(y) * 0.01 + 1e-9])
            step = np.linalg.solve(hess, grad)
            beta = beta + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        self.beta = beta

    def score(self, text: str | None) -> float:
        z = float(self.beta @ np.array([1.0, *self.features(text)]))
        return 1 / (1 + np.exp(-z)) if z > -700 else 0.0


def spread(words) -> set[str]:
    """The words and their beginnings."""
    return {*words, *(w[:n] + "*" for w in words for n in PREFIXES if len(w) > n)}


def frequencies(texts: list[str]) -> Counter:
    out: Counter = Counter()
    for t in texts:
        out.update(spread(set(WORD.findall(t.lower()))))
    return out


def learn(texts: list[str], toxic: list[int], least_contexts: int = 8, ratio: float = 20.0) -> Scorer:
    """A scorer from labelled texts; equal texts count once."""
    rows = sorted({t: y for y, t in sorted((int(y), t or "") for t, y in zip(texts, toxic, strict=True))}.items())
    bad, good = [t for t, y in rows if y], [t for t, y in rows if not y]
    if not bad or not good:
        return Scorer({})
    in_bad, in_good = frequencies(bad), frequencies(good)
    need, weights = max(3, min(least_contexts, len(bad) // 4)), {}
    for term, n in in_bad.items():
        if n >= 3 and len(term.rstrip("*")) >= 3 and in_good[term] <= 0.001 * len(good):
            odds = ((n + 0.5) / (len(bad) + 1)) / ((in_good[term] + 0.5) / (len(good) + 1))
            if odds >= ratio or n >= 5 and not in_good[term]:
                weights[term] = float(min(1.0, 0.5 + np.log10(max(odds, 1.0)) / 5))
    contexts, ends = defaultdict(set), defaultdict(set)
    for t in bad:
        words = WORD.findall(t.lower())
        for before, w in zip(["", *words], words, strict=False):
            for term in spread([w]) & weights.keys():
                contexts[term].add(before)
                ends[term].add(w)
    terms = [k for k in weights if len(contexts[k]) >= need and (k[-1] != "*" or len(ends[k]) >= 4)]
    scorer = Scorer({k: weights[k] for k in terms})
    scorer.safe = frozenset(w for w, (_, exact) in scorer.trie.match_all(w for w in in_good if w[-1:] != "*").items() if not exact)
    scorer.train([t for t, _ in rows], np.array([y for _, y in rows]))
    return scorer


def held_out(fold: int = 3, rest: int = 1) -> Column:
    """Documents whose crc32(doc_id as text) leaves `rest`; those without an id count as not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == rest, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train: Column, max_rows: int = 3_000, **settings) -> Scorer:
    """Learns from at most `max_rows` labelled documents of each class, the first by a hash of the id, of those for which
    `train` holds."""
    known = labels.filter(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = [known.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for c in (F.col("toxic") == 1, F.col("toxic") != 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * max_rows ids at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
    # an id that many rows share counts once, so the sample stays bounded
    first = rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    got = first.select("text", "toxic").toPandas()
    return learn(list(got["text"]), list(got["toxic"]), **settings)


def score(docs: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """docs with a score column, 0 to 1."""
    scorer.trie.known.clear()
    held = docs.sparkSession.sparkContext.broadcast(scorer)  # words of the bounded training sample at most

    @F.pandas_udf("double")
    def judge(texts):
        import pandas as pd

        only()
        s = held.value
        return pd.Series([s.score(t) for t in texts], dtype=float)

    return docs.withColumn(name, judge.asNondeterministic()(F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.7, train: Column | None = None, **settings) -> DataFrame:
    """docs with a score under the limit."""
    scorer = fit(docs, labels, ~held_out() if train is None else train, **settings)
    name = free_name(docs, "score")
    return score(docs, scorer, name).filter(F.col(name) < limit).drop(name)

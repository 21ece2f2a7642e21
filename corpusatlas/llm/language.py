"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased, runs of non-letters become one space, and a document starts after three boundary marks. A window of
four characters is a 64-bit number (16 bits each; beyond the basic plane 32 neighbouring letters share one), a perfect hash. One
table of sorted numbers per order holds, for the languages that have the window, the interpolated log probability of the
last character; a language without it falls back to the weight of the context times the lower order. A text's language is
the one of lowest cross-entropy per character.

Counts come from all training documents, and the model that goes to the tasks holds every window of every language: it
grows with the distinct windows, and passes through the driver. Rejection is calibrated on all
training documents: the mean and the spread of the cross-entropy of documents in their own language, summed in the tasks.
A language without such a document (none of its texts has a letter) is predicted only if all are so, and rejects no text
with letters.

The table may hold: null or letterless texts (`und`, score 0, rejected), null langs (not learned from), no or one language
(every text with letters gets the only one; without any, `und`), texts of any length (a long one is a portion of its own),
repeated rows, nothing, any other columns (kept by `identify`; one of the result's own name is replaced).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusatlas.llm.common import free_name, map_arrow, materialise, only, portions

ORDER = 4
SHIFT, MASK = np.uint64(16), (1 << 16) - 1
SURROGATE, END = 0xD800, 0xE000  # no characters of their own: stand for letters beyond the basic plane
_KINDS: list = []


def kinds() -> np.ndarray:
    """Of 16-bit numbers: 2 for letters, 1 for combining marks, 0 for the rest."""
    if not _KINDS:
        import unicodedata

        of = [{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(MASK)] + [0]
        of[SURROGATE:END] = [2] * (END - SURROGATE)
        _KINDS.append(np.array(of, np.uint8))
    return _KINDS[0]


def basic(c: np.ndarray) -> np.ndarray:
    """Code points as 16 bits."""
    if (odd := (c >= MASK) | (c >= SURROGATE) & (c < END)).any():
        import unicodedata

        values, at = np.unique(c[odd], return_inverse=True)
        c = c.copy()
        c[odd] = np.array([SURROGATE + (v >> 5) % (END - SURROGATE) if unicodedata.category(chr(v))[0] == "L" else MASK for v in values.tolist()], c.dtype)[at]
    return c.astype(np.uint16)


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, each text after ORDER - 1 zeros; the place after each text's last character."""
    gap = "\0" * (ORDER - 1)
    joined = gap + gap.join((t or "").replace("\0", " ").lower() for t in texts) + gap
    c = basic(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"))
    edge = c == 0
    c = np.where((kinds()[c] > 0) | edge, c, 32).astype(np.uint64)
    space = c == 32
    c = c[~(space & np.r_[False, space[:-1] | edge[:-1]])]  # no space after a space or a boundary
    edge = c == 0
    # the ORDER - 1 zeros after each text start where a zero follows something else, or after an empty text
    zeros = np.flatnonzero(edge)
    return c, zeros[ORDER - 1 :: ORDER - 1]


def windows(c: np.ndarray) -> np.ndarray:
    """The number of the window that ends at each character from ORDER - 1 on."""
    g = c[: len(c) - ORDER + 1].copy()
    for i in range(1, ORDER):
        g = (g << SHIFT) | c[i : len(c) - ORDER + 1 + i]
    return g


def suffix(grams: np.ndarray, n: int) -> np.ndarray:
    return grams & np.uint64((1 << 16 * n) - 1)


class Model:
    """Sorted tables for all languages: logs[n] for windows of order n, weights[n] behind n characters. A table is its sorted
    keys, where each key's entries start, and the entries' languages and values."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        per = {n: [] for n in range(1, ORDER + 1)}
        back = {n: [] for n in range(ORDER)}
        alphabet = np.unique(np.concatenate([suffix(g, 1) for g, _ in counts.values()])) if counts else np.array([0], np.uint64)
        self.floor = float(-np.log(len(alphabet) + 1))
        for lang in langs:
            order = np.argsort(counts[lang][0])
            grams, times = counts[lang][0][order], counts[lang][1][order].astype(float)
            levels = {ORDER: (grams, times)}
            for n in range(ORDER - 1, 0, -1):  # continuation counts: how many characters precede the shorter window
                levels[n] = tuple(x for x in np.unique(suffix(levels[n + 1][0], n), return_counts=True))
            lower: tuple | None = None
            for n in range(1, ORDER + 1):
                g, t = levels[n][0], np.asarray(levels[n][1], dtype=float)
                ones, twos = (t == 1).sum(), (t == 2).sum()
                d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
                ctx, at = np.unique(g >> SHIFT, return_inverse=True)
                total = np.bincount(at, t)
                gamma = d * np.bincount(at) / total
                below = np.full(len(g), np.exp(self.floor)) if lower is None else lower[1][np.searchsorted(lower[0], suffix(g, n - 1))]
                p = np.maximum(t - d, 0) / total[at] + gamma[at] * below
                per[n].append((g, np.log(p)))
                back[n - 1].append((ctx, np.log(gamma)))
                lower = (g, p)
        self.weights = {n: self._table(back[n]) for n in back}
        self.logs = {n: self._table(per[n]) for n in per}
        self.mean, self.spread = np.full(len(langs), np.inf), np.ones(len(langs))  # uncalibrated: rejects no text with letters

    @staticmethod
    def _table(parts: list) -> tuple[np.ndarray, ...]:
        keys = np.concatenate([k for k, _ in parts] or [np.empty(0, np.uint64)])
        langs = np.repeat(np.arange(len(parts), dtype=np.min_scalar_type(len(parts))), [len(k) for k, _ in parts])
        values = np.concatenate([v.astype(np.float32) for _, v in parts] or [np.empty(0, np.float32)])
        order = np.argsort(keys, kind="stable")
        keys, start = np.unique(keys[order], return_index=True)
        return keys, np.r_[start, len(order)], langs[order], values[order]

    @staticmethod
    def _fill(out: np.ndarray, table: tuple[np.ndarray, ...], wanted: np.ndarray) -> None:
        """Writes the entries of each wanted key to its row of out."""
        keys, start, langs, values = table
        if not len(keys):
            return
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        rows = np.flatnonzero(keys[at] == wanted)
        first, n = start[at[rows]], start[at[rows] + 1] - start[at[rows]]
        entries = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        out[np.repeat(rows, n), langs[entries]] = values[entries]

    def log_probability(self, grams: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Of the last character of each window of n characters: a column per language."""
        wanted, back = np.unique(grams, return_inverse=True)
        out = np.zeros((len(wanted), len(self.langs)), dtype=np.float32)
        self._fill(out, self.weights[n - 1], wanted >> SHIFT)
        out += self.log_probability(suffix(wanted, n - 1), n - 1) if n > 1 else np.float32(self.floor)
        self._fill(out, self.logs[n], wanted)
        return out[back]

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character for each text and language; characters of each text (0: no letter)."""
        c, ends = encode(texts)
        starts = np.r_[ORDER - 1, ends[:-1] + ORDER - 1]
        n = ends - starts
        logs = self.log_probability(windows(c))
        total = np.add.reduceat(np.vstack([logs, np.zeros((1, logs.shape[1]), np.float32)]), np.minimum(np.c_[starts, ends].ravel() - (ORDER - 1), len(logs)), axis=0, dtype=np.float64)[::2]
        has = np.add.reduceat(np.r_[kinds()[c] == 2, False].astype(np.int64), np.minimum(np.c_[starts, ends].ravel(), len(c)))[::2]
        n = np.where((n > 0) & (has > 0), n, 0)
        return -total / np.maximum(n, 1)[:, None], n

    def judge(self, texts: list[str | None], limit: float = 8.0, ratio: float = 1.5):
        """Language, score and rejection of each text.

        The score is the language's posterior, taken over at most 64 characters so that long texts don't saturate it. A
        text is rejected if its cross-entropy is both `limit` calibrated deviations and `ratio` times above the mean."""
        x, n = self.cross_entropy(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if (calibrated := np.isfinite(self.mean)).any():
            x[:, ~calibrated] = np.inf
        best = x.argmin(axis=1)
        rows = np.arange(len(x))
        odds = np.exp(-(x - x[rows, best][:, None]) * np.minimum(n, 64)[:, None])
        score = np.where(n > 0, 1 / odds.sum(axis=1), 0.0)
        over = x[rows, best] - self.mean[best]
        reject = (over * np.sqrt(np.clip(n, 1, 256)) > limit * self.spread[best]) & (x[rows, best] > ratio * self.mean[best]) | (n == 0)
        return [self.langs[b] if k else "und" for b, k in zip(best, n, strict=True)], score, reject


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): windows of all documents with a lang, counted in each task and then summed."""

    def count(batches):
        import pyarrow as pa

        held: dict[str, list] = {}

        def fold(lang):
            g, at = np.unique(np.concatenate([k for k, _ in held[lang]]), return_inverse=True)
            held[lang] = [(g, np.bincount(at, np.concatenate([v for _, v in held[lang]])).astype(np.int64))]

        for b in batches:
            for part in portions(b, rows=256):
                by: dict[str, list] = {}
                for lang, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    by.setdefault(lang, []).append(t)
                for lang, texts in by.items():
                    c, _ = encode(texts)
                    g = windows(c)
                    g = g[c[ORDER - 1 :] != 0]
                    held.setdefault(lang, []).append(tuple(np.unique(g, return_counts=True)))
                    if sum(len(k) for k, _ in held[lang][1:]) > max(1 << 18, len(held[lang][0][0])):
                        fold(lang)
        for lang in held:
            fold(lang)
            g, n = held[lang][0]
            for i in range(0, len(g), 1 << 16):
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g[i : i + (1 << 16)]), pa.string()), "gram": g[i : i + (1 << 16)].view(np.int64), "n": n[i : i + (1 << 16)]})

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, train: Column) -> Model:
    """A model of the rows of docs (doc_id, text, lang) for which `train` holds."""
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counted = materialise(gram_counts(rows), "grams")
    langs, counts = sorted(r.lang for r in counted.select("lang").distinct().collect()), {}
    if langs:
        place = (F.array_position(F.array(*[F.lit(k) for k in langs]), F.col("lang")) - 1).cast("int")
        got = counted.select(place.alias("lang"), "gram", "n").toArrow()
        at, gram, n = (got.column(k).to_numpy() for k in ("lang", "gram", "n"))
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(langs) + 1))
        counts = {k: (gram[part].view(np.uint64), n[part].astype(float)) for i, k in enumerate(langs) for part in [order[ends[i] : ends[i + 1]]]}
    model = Model(langs, counts)
    if langs:
        held, at = docs.sparkSession.sparkContext.broadcast(model), {k: i for i, k in enumerate(langs)}
        names = ("docs", "x", "w", "wx", "wxx")

        def measure(batch):
            import pyarrow as pa

            x, n = held.value.cross_entropy(batch.column("text").to_pylist())
            own = np.array([at.get(k, -1) for k in batch.column("lang").to_pylist()], dtype=np.int32)
            keep = np.flatnonzero((own >= 0) & (n > 0))
            own, w = own[keep], np.clip(n[keep], 1, 256).astype(float)
            x = x[keep, own]
            met, to = np.unique(own, return_inverse=True)
            sums = [np.bincount(to, v, len(met)) for v in (np.ones(len(x)), x, w, w * x, w * x * x)]
            yield pa.RecordBatch.from_pydict({"lang": pa.array(met, pa.int32())} | {k: pa.array(v, pa.float64()) for k, v in zip(names, sums, strict=True)})

        sums = map_arrow(rows.select("lang", "text"), measure, "lang int, docs double, x double, w double, wx double, wxx double", most=1 << 20)
        for r in sums.groupBy("lang").agg(*[F.sum(k).alias(k) for k in names]).collect():
            mean = r.x / r.docs
            model.mean[r.lang] = mean
            model.spread[r.lang] = max(1e-3, float(np.sqrt(max(0.0, r.wxx - 2 * mean * r.wx + mean * mean * r.w) / r.docs)))
        held.unpersist()
    return model


def identify(docs: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """docs with a struct column: lang, score, rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # grows with the distinct windows

    @F.pandas_udf("lang string, score double, rejected boolean")
    def judge(texts):
        import pandas as pd

        import pyarrow as pa

        only()
        batch = pa.RecordBatch.from_arrays([pa.Array.from_pandas(texts, type=pa.string())], ["text"])
        parts = [held.value.judge(p.column("text").to_pylist()) for p in portions(batch, rows=256, most=1 << 20)]
        return pd.DataFrame({"lang": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts] or [[]]), "rejected": np.concatenate([p[2] for p in parts] or [[]]).astype(bool)})

    return docs.withColumn(name, judge.asNondeterministic()(F.col("text")))


def held_out(fold: int = 5, rest: int = 0) -> Column:
    """Documents whose crc32(doc_id as text) leaves `rest`; those without an id are learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == rest, F.lit(False))


def keep_identified(docs: DataFrame, train: Column | None = None, **settings) -> DataFrame:
    """docs without those that no language model accepts."""
    model = fit(docs, ~held_out() if train is None else train, **settings)
    name = free_name(docs, "language")
    return identify(docs, model, name).filter(~F.col(f"{name}.rejected")).drop(name)

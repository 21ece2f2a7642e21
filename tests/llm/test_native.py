import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from corpusatlas.llm import decontaminate as dc
from corpusatlas.llm import hilbert, line_quality
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string"


def plain_index(point, bits):
    """The textbook form of the transform."""
    x, n, m = list(point), len(point), 1 << (bits - 1)
    q = m
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, m
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out * 2 + (v >> b & 1)
    return out


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 2)])
def test_hilbert_index(spark, dims, bits):
    df = spark.range((1 << bits) ** dims).select(*[((F.col("id") / (1 << bits) ** i).cast("long") % (1 << bits)).alias(f"x{i}") for i in range(dims)])
    rows = df.withColumn("h", hilbert.hilbert_index([F.col(c) for c in df.columns], bits)).collect()
    assert sorted(r.h for r in rows) == list(range(len(rows)))
    assert all(r.h == plain_index(list(r)[:-1], bits) for r in rows)
    path = [list(r)[:-1] for r in sorted(rows, key=lambda r: r.h)]
    assert all(sum(abs(a - b) for a, b in zip(u, v)) == 1 for u, v in zip(path, path[1:]))


def shards_of(spark, rows, n=24, schema=SCHEMA):
    return hilbert.shard_by_hilbert(spark.createDataFrame(rows, schema), n).collect()


def test_shards(spark):
    rows = [(i, "same" if i % 3 else "text é " * (i % 50), "en" if i % 2 else None, "src0") for i in range(500)] + [(None, None, None, None)] * 5
    got = shards_of(spark, rows)
    assert len(got) == 505
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    order = []
    for s in range(24):
        own = sorted(by[s], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        order += [r.hilbert for r in own]
    assert order == sorted(order)
    text = {d: t for d, t, *_ in rows}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)


def test_few_rows(spark):
    assert shards_of(spark, []) == []
    assert [(r.shard, r.slot) for r in sorted(shards_of(spark, [(1, "a", "en", "s"), (2, "b", "en", "s")]), key=lambda r: r.shard)] == [(0, 0), (1, 0)]


def test_shard_files_keep_every_row_and_prune(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i % 300 if i % 7 else None, "t " * rng.randint(0, 60), rng.choice(["en", "de", "fr", "es"]), f"s{rng.randrange(40)}", "mine") for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA + ", slot string")
    hilbert.write_shards(df, f"{tmp_path}/x", shards=24)
    back = spark.read.parquet(f"{tmp_path}/x")
    assert sorted(map(tuple, back.drop("shard").collect()), key=str) == sorted(rows, key=str)
    per = back.groupBy("shard").agg(F.collect_set("lang").alias("l"), F.collect_set("source").alias("s"), F.min(F.length("text")).alias("a"), F.max(F.length("text")).alias("z")).collect()
    assert len(per) == 24
    # a filter on one dimension has to open a part of the files only, whichever dimension it is
    opened = [sum("de" in r.l for r in per), sum("s3" in r.s for r in per), sum(r.a <= 5 <= r.z for r in per)]
    assert all(n < 24 for n in opened) and sum(opened) <= 40, opened  # of 72


def test_values_beyond_the_common_ones(spark):
    df = spark.createDataFrame([(v,) for v in ["a"] * 50 + ["b"] * 30 + [f"r{i}" for i in range(40)]], "v string")
    ranks, other = hilbert.category_rank(df, "v", 8, most=2)
    common = dict(ranks.collect())
    got = {r.v: r.o for r in df.filter("v like 'r%'").select("v", other.alias("o")).collect()}
    assert set(common) == {"a", "b"} and common["a"] < common["b"] < min(got.values()) and max(got.values()) < 256 and len(set(got.values())) > 20


def plain_shards(rows, bits=8):
    """Shard and slot of each row, with the quantisation and the order written out."""
    def middle(values):
        n, out, seen = Counter(v for v in values if v is not None), {}, 0
        for v in sorted(n):
            seen += n[v]
            out[v] = min(int((seen - n[v] / 2) / sum(n.values()) * 256), 255)
        return out
    lang, source = middle([r[2] for r in rows]), middle([r[3] for r in rows])
    size = lambda r: len((r[1] or "").encode()) + 8
    sizes = sorted(map(size, rows))
    edges = sorted({sizes[max(0, -(-k * len(sizes) // 256) - 1)] for k in range(1, 256)})
    keyed = []
    for r in rows:
        point = (lang.get(r[2], 0), source.get(r[3], 0), sum(e < size(r) for e in edges))
        keyed.append((plain_index(point, bits), zlib.crc32((r[1] or "").encode()), r[0]))
    keyed.sort()
    small, extra = divmod(len(rows), 24)
    out, at = {}, 0
    for s in range(24):
        for slot in range(small + (s < extra)):
            out[keyed[at][2]] = (keyed[at][0], s, slot)
            at += 1
    return out


def test_shards_against_plain(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(0, 900), rng.choice(["en", "de", None]), f"s{rng.randrange(9)}") for i in range(700)]
    assert {r.doc_id: (r.hilbert, r.shard, r.slot) for r in shards_of(spark, rows)} == plain_shards(rows)


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)})
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, len(w) < 10 or 100 * repeated > 20 * len(w)


def test_base_rules(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "a b c d e a b c d e", "a b c d e " * 9, "a b c d e f\n" * 4, "x#y $ & <b>\n\n x#y $ & <b>", "é ñ 日本 " * 3, "one two three four five six seven eight nine ten"]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 60))).replace(" a", "\na") for _ in range(60)]
    rows = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in line_quality.base_rules(rows).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures(t), t


def test_line_frequency(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"{own(i)}\nThe  Same line 12", "en", "a") for i in range(60)]
    rows += [(100 + i, f"tiny{i} word\nthe same LINE 34 " + "", "en", "a") for i in range(5)]
    rows += [(200 + i, "one copied text of more than ten words in two lines\n" + own(999), "en", "a") for i in range(80)]
    rows += [(300, "x " * 3 + own(300) + "\nthe same line 12", "en", "b"), (None, None, None, None)]
    got = {r.doc_id: r for r in line_quality.judge_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].removed_words == 4 and got[i].kept for i in range(60))
    assert all(not got[100 + i].kept for i in range(5))
    assert all(got[200 + i].kept and got[200 + i].removed_words == 0 for i in range(80))  # copies are one text
    assert got[300].removed_words == 0 and got[300].kept  # another host
    assert not got[None].kept and got[None].n_words == 0


def test_texts_without_frequent_lines(spark):
    """The lines go from the texts too, and what stays has the words that were not counted as removed."""
    rows = [(i, f"own{i} a b c d e f g h\n\n  The Same   line {i % 10}\nlast{i} x y z\nthe same line 7", "en", "a") for i in range(60)]
    rows += [(100, "the same line 3\nstays", "en", "b"), (101, None, "en", "a"), (102, "The same line 9", "en", "a"), (103, "", "en", "a")]
    got = {r.doc_id: r for r in line_quality.judge_lines(spark.createDataFrame(rows, SCHEMA), keep_text=True).collect()}
    assert all(got[i].text == f"own{i} a b c d e f g h\n\nlast{i} x y z" and got[i].removed_words == 8 for i in range(60))
    assert (got[100].text, got[101].text, got[102].text, got[103].text) == ("the same line 3\nstays", None, "", "")
    assert all(len((r.text or "").split()) == r.n_words - r.removed_words for r in got.values())


def test_depleted(spark):
    line = "a common line of exactly twelve words that many different documents all have"
    rows = [(i, f"{line}\n" + " ".join(f"q{i}z{k}" for k in range(11 if i < 55 else 40)), "en", "a") for i in range(60)]
    got = {r.doc_id: r for r in line_quality.judge_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].removed_words == 13 and got[0].depleted and not got[0].kept
    assert got[59].removed_words == 13 and got[59].kept


def test_lines_of_no_or_long_documents(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert line_quality.judge_lines(df).count() == 0
    long = "\n".join(f"line {i} w{i}a w{i}b w{i}c w{i}d w{i}e" for i in range(20_000))
    got = line_quality.judge_lines(spark.createDataFrame([(1, long, "en", "a")], SCHEMA)).first()
    assert (got.n_words, got.n_dup_lines, got.kept) == (140_000, 0, True)
    extra = spark.createDataFrame([(1, "a b c", "en", "a", "mine", 5)], SCHEMA + ", host string, n_words int")
    assert line_quality.judge_lines(extra).first().n_words == 3


def doc_words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, named = doc_words(t), set(), set()
        for item, text in items:
            b = doc_words(text)
            n = min(13, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named.add(str(item))
        out.append((d, len(w), len(hit), tuple(sorted(named)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_bits", [1 << 24, 64])
def test_hits(spark, most_bits):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(4)] + ["Éa", "日本", "x9"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, say(30)), (2, say(5)), (3, say(13)), (10, "short one"), (11, None), (12, ""), (13, "Short, ONE!")]
    docs = [(i, say(rng.randint(0, 200))) for i in range(40)] + [(100, items[0][1].upper().replace(" ", ", ")), (101, None), (102, "a b short-one c"), (103, "Short one"), (103, "Short one"), (None, items[2][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_hits(df, bench, most_bits=most_bits).select("doc_id", "n_words", "n_hit", "items", dc.contaminated().alias("c")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.c) for r in got), key=str) == brute(docs, items)


def test_covered(spark):
    rng = random.Random(5)
    rows = [(i, [(rng.randrange(60), rng.choice((2, 5, 13))) for _ in range(rng.randrange(9))]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, s array<struct<pos:int,length:int>>")
    for r in df.select("id", dc.covered(F.col("s")).alias("c")).collect():
        places = {p + k for p, n in rows[r.id][1] for k in range(n)}
        assert sorted(k for s, e in r.c for k in range(s, e)) == sorted(places)
        assert all(a.e < b.s for a, b in zip(r.c, r.c[1:]))


def test_long_document_and_large_benchmark(spark):
    """100,000 words against 200,000 windows: more than one bit table's comfort, and no window is lost."""
    rng = random.Random(4)
    items = [(i, " ".join(f"b{rng.randrange(10**6)}" for _ in range(113))) for i in range(2000)]
    words = [f"w{rng.randrange(5000)}" for _ in range(100_000)]
    for k in range(50):
        words[2000 * k : 2000 * k + 20] = items[k][1].split()[:20]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bits in (1 << 24, 1 << 12):
        got = {r.doc_id: r for r in dc.find_hits(docs, bench, most_bits=bits).collect()}
        assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[2].n_hit) == (100_000, 1000, 50, 0)
        assert [(x.s, x.e) for x in got[1].spans] == [(2000 * k, 2000 * k + 20) for k in range(50)]
    assert len(dc.decontaminate(docs, bench).filter("doc_id = 1").first().text.split()) == 99_000


def test_no_items_no_docs(spark):
    df, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.find_hits(df, bench).first().n_hit == 0
    assert dc.find_hits(df.filter("doc_id = 2"), df.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_spans_go(spark):
    item = " ".join(f"b{i}" for i in range(13))
    clean = " ".join(f"c{i}" for i in range(400))
    rows = [(1, f"Start, {clean}: {item.upper()}. End", "x", 1), (2, item, "y", 2), (3, clean, "z", 3), (4, None, "w", 4), (None, clean, "v", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __bad string, n_hit long")
    out = {r.doc_id: r for r in dc.decontaminate(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4, None} and out[3].text == clean and out[4].text is None
    assert out[1].text == f"Start, {clean}: End" and out[1]["__bad"] == "x" and out[1].n_hit == 1

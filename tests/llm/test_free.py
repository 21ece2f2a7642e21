import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from corpusatlas.llm import bitpack, chat, language, packing, simhash, toxicity
from corpusatlas.llm.tokens import Coder, default_tokenizer
from pyspark.sql import functions as F

TEXTS = ["", " ", "Hello, world!  It's 2024.", "naïve café ÀÉÎ ß ÿ", "<|endoftext|> x<|startoftext|>y", "tab\tnew\nline\r\nvt\x0bnbsp\xa0end\x85x y", "日本語 テキスト", "é combining", "ΣΑΣ ας", "İstanbul", "a" * 500, "don't we'll I'd", "###---!!!", "x1y2z3", "“quotes” — dash…", "\x1c\x1d sep", "UPPER lower MiXeD."]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_coder_is_the_tokenizer():
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice("abcXYZé ß.,!'\n1<|>") for _ in range(80)) for _ in range(300)]
    c = Coder(default_tokenizer(), max_chunks=50, max_pieces=20)
    assert c.by_chunk
    for i in range(0, len(texts), 40):
        got = [list(np.frombuffer(x, "<u4")) for x in c.encode(texts[i : i + 40])]
        assert got == library(texts[i : i + 40])


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_pack_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1001, dtype=np.uint64).astype("<u4")
    data = bitpack.pack(ids, width)
    assert len(data) == -(-1001 * width // 8) and (bitpack.unpack(data, width, 1001) == ids).all()


def test_token_file(tmp_path):
    from corpusatlas.llm import files

    rng = np.random.default_rng(3)
    docs = [(d, rng.integers(0, 9000, n).astype("<u4")) for d, n in [(None, 3), (-5, 0), (2, 100), (2, 1), (9, 57)]]
    files.write(str(tmp_path / "x.bin"), bitpack.build(docs, 14, 16))
    with bitpack.TokenFile(str(tmp_path / "x.bin")) as f:
        assert f.doc_ids == [d for d, _ in docs]
        assert all((f.document(i) == docs[i][1]).all() for i in range(5))
        whole = np.concatenate([x for _, x in docs])
        assert all((f.range(a, b) == whole[a:b]).all() for a, b in [(0, 161), (15, 17), (16, 32), (5, 5), (160, 161)])
        assert [len(x) for _, x in f.documents(20)] == [3, 0, 100, 1, 57]


def test_files_of_documents(spark):
    texts = [*TEXTS, None, "repeat me", "repeat me"]
    rows = [(i * 3 - 4, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (5, "twice", "x")]
    got = bitpack.encode_to_files(spark.createDataFrame(rows, "doc_id long, text string, start string"), docs_per_file=4).collect()
    enc = {t: library([t or ""])[0] + [1] for _, t, _ in rows}
    want = [(d, len(enc[t]), zlib.crc32(np.array(enc[t], "<u4").tobytes())) for d, t, _ in rows]
    got = sorted(got, key=lambda r: r.start)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    assert bitpack.encode_to_files(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_an_id_spread(spark, tmp_path):
    rows = [(None, f"text number {i}") for i in range(400)] + [(7, f"other {i}") for i in range(400)] + [(9, "long " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = bitpack.write_tokens(df, str(tmp_path), docs_per_file=50, bytes_per_file=4000)
    files = manifest.collect()
    assert sum(r.n_docs for r in files) == 801 and max(r.n_docs for r in files) <= 400
    assert len(files) > 10 and all(4 * r.n_tokens < 4000 + 24 or r.n_docs == 1 or 4 * r.n_tokens > 20_000 for r in files)
    got = sorted(bitpack.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(801)]


def test_portions():
    import pyarrow as pa
    from corpusatlas.llm.common import portions

    texts = ["a" * 10] * 5 + [None, "b" * 1000, "", "c" * 30] + ["d"] * 20
    b = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    parts = list(portions(b, rows=8, most=40))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows <= 8 and (p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 40) for p in parts)


def test_best_fit():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 101, 3000))[::-1]
    for rule in ("norm", "dot"):
        bins = packing.best_fit(lengths, 100, rule=rule)
        assert np.bincount(bins, lengths).max() <= 100
    tight = packing.best_fit(lengths, 100)
    assert len(set(tight)) <= 1.02 * lengths.sum() / 100
    small = lengths[lengths <= 40]
    assert len(set(packing.best_fit(small, 100))) == -(-small.sum() // 100)
    capped = packing.best_fit(lengths, 100, documents=3)
    assert np.bincount(capped).max() <= 3
    assert len(packing.best_fit(np.array([], dtype=int), 100)) == 0


def test_capacities_bind():
    lengths = np.array([50] * 10 + [5] * 40)
    bins = packing.best_fit(lengths, 100, documents=4, attention=5000)
    assert np.bincount(bins).max() <= 4
    assert np.bincount(bins, lengths**2).max() <= 5000


def test_pack_documents(spark):
    rows = [(i, " ".join(f"w{i}{k}" for k in range(n))) for i, n in enumerate([0, 1, 3000, 900, 10, 10, 10, 400])] + [(None, None), (3, "again")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), keep_ids=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.start == 2048 * r.piece
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= 2048
    doc = sorted((r for r in got if r.doc_id == 2), key=lambda r: r.piece)
    assert list(np.frombuffer(b"".join(bytes(r.ids) for r in doc), "<u4")) == library([rows[2][1]])[0] + [0]
    assert sum(r.length for r in got if r.doc_id is None) == 1
    assert len(by) == -(-sum(r.length for r in got) // 2048)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_fingerprint(t, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(5)
    for t in [None, "", " \t", "a", "A b", "É ß x\x1cy \x85 z", *(" ".join(rng.choice("abcdeÉ") for _ in range(rng.randint(1, 90))) for _ in range(80))]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def brute_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_links_find_every_pair(spark):
    rng, fps = random.Random(6), set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(12):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    base = rng.getrandbits(64)
    fps |= {base ^ i << 20 for i in range(64)} | {0, 2**64 - 1, 1 << 63}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = [tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(df).collect()]
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_signatures_are_not_broadcast(spark):
    """Signatures are many times the table they are made of, which is all that the planner knows of their size."""
    few = spark.range(100).select(F.col("id").alias("fp"))
    assert "Broadcast" not in simhash.links(few)._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates(spark):
    rng = random.Random(7)
    base = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(300)) for _ in range(6)]
    rows = [(i, base[i % 6] + (f" end{i}" if i % 2 else "")) for i in range(60)] + [(100, None), (101, ""), (102, "Solo"), (102, "Solo"), (None, base[0]), (None, "no id at all")]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")).collect()
    fps = {plain_fingerprint(t) for _, t in rows}
    root = brute_components(fps)
    least = {}
    for d, t in rows:
        k = root[plain_fingerprint(t)]
        if d is not None:
            least[k] = min(d, least.get(k, d))
    want = sorted(((d, f"{plain_fingerprint(t):016x}", least.get(root[plain_fingerprint(t)])) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def jaccard(a, b, size=5):
    cut = lambda t: {tuple(w[i : i + size]) for w in [t.lower().split()] for i in range(max(1, len(w) - size + 1))}
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


def test_no_link_is_left_out(spark):
    """Pairs of 0.80 to 0.84, where fingerprints often differ too much: all are in one group, and none below 0.8."""
    rng, texts = random.Random(5), []
    passage = [f"common{i}" for i in range(60)]
    for k in range(150):
        n = rng.randint(60, 400)
        w = [f"t{k}w{i}" for i in range(n)] + passage * (k % 3 == 0)
        texts.append(" ".join(w))
        m, lost = len(w) - 4, 0
        while (m - lost - 1) / (m + lost + 1) >= 0.8:
            lost += 1
        more = 5 * (k % 5 == 0)  # too different
        texts.append(" ".join([*w[: len(w) - lost - more], *(f"o{k}w{i}" for i in range(lost + more))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    numbered, groups = simhash.near_groups(df)
    row = numbered.columns[-1]
    ids = dict(numbered.select(row, "doc_id").collect())
    best = {ids[a]: ids[b] for a, b in groups.collect()}
    for k in range(150):
        assert (best[2 * k + 1] == 2 * k) == (jaccard(texts[2 * k], texts[2 * k + 1]) >= 0.8) == (k % 5 != 0)


def alike(n):
    """Texts of which every second one differs from the one before in its last words, all of words of their own."""
    return [" ".join([*(f"p{i // 2}w{k}" for k in range(60)), *(f"q{i}w{k}" for k in range(4))]) for i in range(n)]


def test_finished_steps_leave_no_table(spark):
    """While the result may still be read, there are only the tables that it reads."""
    from pathlib import Path

    from corpusatlas import storage

    df = spark.createDataFrame(list(enumerate(alike(40))), "doc_id long, text string")
    folder = Path(storage.shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    with storage.scratch(spark):
        _, groups = simhash.near_groups(df)
        left = {p.name for p in folder.iterdir()} - before
        assert {x.rpartition("-")[0] for x in left} == {"numbered", "members", "nodes", "links", "edges"}
        assert groups.count() == 40 and len({r.best for r in groups.collect()}) == 20
    assert not {p.name for p in folder.iterdir()} - before


def test_rounds_find_the_same_pairs(spark):
    """Shuffles in parts lose no pair, and find none twice."""
    rng = random.Random(3)
    sketches = [[rng.getrandbits(10) for _ in range(12)] for _ in range(150)]
    nodes = spark.createDataFrame(list(enumerate(sketches)), "node long, sketch array<long>")
    prefixes = [(i, 10, sorted(rng.sample(range(60), 3)), i // 2) for i in range(100)]
    held = spark.createDataFrame(prefixes, "node long, n int, prefix array<long>, group long")
    for pairs in (lambda rounds: simhash.candidates(nodes, 10, rounds), lambda rounds: simhash.met_by_prefix(held, 0.8, rounds)):
        got = [sorted((r.a, r.b) for r in pairs(rounds).collect()) for rounds in (1, 4)]
        assert got[0] == got[1] and len(set(got[0])) == len(got[0]) > 20


def test_likely_rows(spark):
    """All rows of the keys, and few others."""
    rows = spark.range(20_000).withColumnRenamed("id", "row")
    for keys in (rows.filter("row % 100 = 7"), rows.limit(0), rows):
        got = {r.row for r in rows.filter(simhash.likely("row", keys)).collect()}
        want = {r.row for r in keys.collect()}
        assert want <= got and len(got) <= 1.2 * len(want) + 10
    crowded = rows.filter(simhash.likely("row", rows.filter("row % 2 = 0"), most=128))
    assert {r.row for r in crowded.collect()} >= set(range(0, 20_000, 2))


def test_prefixes_spread(spark):
    """Different shingles have different numbers in prefixes, though the first by hash are taken."""
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(alike(400))], "row long, doc_id long, text string")
    got = [x for r in simhash.sketches(rows, 5, 12, 28, 0.8, np.empty(0, np.uint64)).collect() for x in r.prefix]
    assert len({x % 2**32 for x in got}) > 0.99 * len(set(got)) and len({x % 2**24 for x in got}) > 0.99 * len(set(got))


def test_groups_by_similarity(spark):
    """Every link is a true one, and of the pairs of 0.9 or more nearly all are found."""
    rng, texts = random.Random(17), []
    for _ in range(60):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
        for share in (0, 0, 0.01, 0.02, 0.04, 0.1, 0.3):
            texts.append(" ".join(f"z{rng.randint(0, 10**6)}" if rng.random() < share else w for w in base))
    numbered, groups = simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    row = numbered.columns[-1]
    ids = dict(numbered.select(row, "doc_id").collect())
    best = {ids[a]: ids[b] for a, b in groups.collect()}
    like = {(i, j): jaccard(texts[i], texts[j]) for k in range(0, len(texts), 7) for i in range(k, k + 7) for j in range(k, i)}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, j), v in like.items():
        if v >= 0.8:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    assert set(best) == set(range(len(texts))) and all(find(i) == find(b) for i, b in best.items())
    near = [best[i] == best[j] for (i, j), v in like.items() if v >= 0.9]
    assert len(near) > 100 and sum(near) >= 0.97 * len(near)
    assert all(best[i] == best[j] for (i, j), v in like.items() if v == 1)


def test_one_row_of_a_group_stays(spark):
    base = " ".join(f"w{i * i % 997}" for i in range(300))
    rows = [(1, base, "a"), (2, "another text with words of its own", "b"), (2, base + " tail", "c"), (5, "same row", "d"), (5, "same row", "d"), (None, base, "e"), (None, "no id at all here", "f"), (7, None, "g"), (8, " ", "h"), (9, base.upper(), "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row string")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["__row"] for r in kept.collect()) == ["a", "b", "d", "f", "g"]
    assert simhash.drop_near_duplicates(df.filter("doc_id = 77")).count() == 0


def test_language(spark):
    say = {"aa": "the cat sat on the mat and then ran off with that hat ", "bb": "der hund lief schnell über die straße und bellte laut ", "cc": "le chien était très fatigué après une longue journée "}
    rng = random.Random(8)
    rows = [(i, " ".join(rng.sample(say[k].split(), 8)), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (903, "日本語の文章です" * 40, None), (904, "𐌰𐌱𐌲 letters beyond", "aa"), (905, "\0\0x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, ~language.held_out())
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    held = [(i, k) for i, _, k in rows[:180] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].language.lang == k for i, k in held) >= 0.95 * len(held)
    assert all(got[i].language.lang == "und" and got[i].language.rejected and got[i].language.score == 0 for i in (900, 901, 902))
    assert got[903].language.rejected and got[903].language.lang in say
    assert got[904].language.lang in say and got[905].language.lang in say
    assert all(0 <= r.language.score <= 1 for r in got.values())
    kept = {r.doc_id for r in language.keep_identified(df).collect()}
    assert kept >= {i for i, _, _ in rows[:180]} and not kept & {900, 901, 902, 903}
    empty = language.fit(df, F.lit(False))
    assert {r.language.lang for r in language.identify(df, empty).collect()} == {"und"}


def test_every_language_is_calibrated(spark):
    say = {"aa": "the cat sat on the mat and then ran off with that hat ", "zz": "wij fietsen vandaag langs het kanaal naar huis toe "}
    rng = random.Random(9)
    # the rare language's ids come last in the order of xxhash64, behind more than 4,000 others
    ids = [r.id for r in spark.range(4300).orderBy(F.xxhash64("id")).collect()]
    rows = [(i, " ".join(rng.sample(say[k].split(), 8)), k) for at, i in enumerate(ids) for k in ["zz" if at >= 4280 else "aa"]]
    df = spark.createDataFrame([*rows, (5000, "\u0301\u0301", "cc"), (5001, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059" * 40, None)], "doc_id long, text string, lang string")
    model = language.fit(df, F.lit(True))
    x = {k: model.cross_entropy([t for _, t, lang in rows if lang == k])[0][:, model.langs.index(k)] for k in say}
    assert all(np.isclose(model.mean[model.langs.index(k)], x[k].mean()) for k in say)
    assert np.isinf(model.mean[model.langs.index("cc")])
    got = {r.doc_id: r.language for r in language.identify(df, model).collect()}
    assert all(got[i].lang == k and not got[i].rejected for i, _, k in rows)
    assert {r.doc_id for r in language.keep_identified(df, F.lit(True)).collect()} == {i for i, _, _ in rows}


def test_every_window_is_in_the_model(spark):
    rng = random.Random(10)
    wide = ["".join(rng.choices([chr(c) for c in range(0x4E00, 0x5E00)], k=50_000)) for _ in range(9)]  # 450,000 windows, twice each
    rare = ["wij fietsen vandaag langs het kanaal", "wij lopen morgen langs het strand"]
    rows = [(t, "aa") for t in wide * 2] + [(t, "zz") for t in rare]
    model = language.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string"), F.lit(True))
    assert model.langs == ["aa", "zz"]
    counts = {}
    for lang, texts in (("aa", wide * 2), ("zz", rare)):
        c, _ = language.encode(texts)
        counts[lang] = np.unique(language.windows(c)[c[3:] != 0], return_counts=True)
    assert len(counts["aa"][0]) > 400_000
    whole = language.Model(["aa", "zz"], counts)
    want = [*rare, "het strand vandaag", wide[0][:500]]
    assert np.array_equal(model.cross_entropy(want)[0], whole.cross_entropy(want)[0])
    assert model.judge(want)[0] == ["zz", "zz", "zz", "aa"] and not model.judge(rare)[2].any()


def test_kneser_ney_sums_to_one():
    texts = ["abra cadabra abracadabra", "bar car radar"]
    c, _ = language.encode(texts)
    g = language.windows(c)
    g = g[c[3:] != 0]
    m = language.Model(["x"], {"x": np.unique(g, return_counts=True)})
    alphabet = np.unique(g & np.uint64(0xFFFF))
    rest = np.exp(m.floor)
    for context in [g[0] >> np.uint64(16), g[5] >> np.uint64(16), np.uint64(0x7A007A007A)]:
        p = np.exp(m.log_probability((context << np.uint64(16)) | alphabet).astype(float)).sum()
        assert abs(p - 1) <= rest + 1e-6


def test_cross_entropy_ignores_neighbours():
    texts = [None, "ab ab", "", "zz", "123", "ab"]
    c, _ = language.encode(["ab ab zz"])
    m = language.Model(["x"], {"x": np.unique(language.windows(c), return_counts=True)})
    x, n = m.cross_entropy(texts)
    for i, t in enumerate(texts):
        y, k = m.cross_entropy([t])
        assert np.allclose(x[i], y[0]) and n[i] == k[0]
    assert list(n > 0) == [False, True, False, True, False, True]


def damerau(a, b):
    """Distance with swaps of neighbours, each letter edited once."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_distance():
    rng = random.Random(9)
    terms = {"abcde": 1.0, "bacda": 0.5, "eeddcc": 0.7, "abc": 0.4, "abcd": 0.45, "abcdeabcdeabcde": 0.9, "edcbaedcbaedcbaed": 0.95}
    trie = toxicity.Trie(terms)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(4000)}

    def damaged(w):
        i, kind = rng.randrange(len(w)), rng.randrange(4)
        return w[:i] + (w[i + 1 :], rng.choice("abcde") + w[i:], rng.choice("abcde") + w[i + 1 :], w[i + 1 : i + 2] + w[i] + w[i + 2 :])[kind]

    for t in terms:
        for _ in range(400):
            words |= {x := damaged(t), y := damaged(x), damaged(y)}
    found = trie.match_all(words)
    for w in words:
        near = [v for t, v in terms.items() if damerau(w, t) <= trie.errors(len(t)) and w != t]
        exact = terms.get(w)
        want = (exact, True) if exact else (max(near, default=0.0), False)
        assert trie.match(w) == want, w
        assert found.get(w, (0.0, False)) == want, w


def test_prefixes():
    trie = toxicity.Trie({"lowei*": 0.8})
    assert trie.match("loweischaft") == (0.8, True) and trie.match("lowei")[0] == 0.8 and trie.match("lowe")[0] == 0


def test_toxicity(spark):
    rng = random.Random(10)
    filler = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "tu") for b in ("ra", "ne", "so") for c in ("l", "n", "st")]
    bad = ["grumbolt", "snarfle", "wretchy"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(filler) for _ in range(60)]
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, "you grumbollt snarfl wretchyy " + " ".join(filler)), (1001, " ".join(filler)), (1002, None), (1003, ""), (None, "snarfle wretchy grumbolt"), (1004, 'they quoted "grumbolt" once ' + " ".join(filler * 8)), (1005, "x " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (3, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    scorer = toxicity.fit(df, lab, ~toxicity.held_out())
    got = {r.doc_id: r.score for r in toxicity.score(df, scorer).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == bool(y) for i, y in held)
    assert got[1000] >= 0.7 and got[None] >= 0.7
    assert max(got[i] for i in (1001, 1002, 1003, 1004, 1005)) < 0.7
    assert scorer.features('said "grumbolt" to me')[0] < scorer.features("you grumbolt to me")[0]
    assert {r.doc_id for r in toxicity.drop_toxic(df.withColumn("score", F.lit("mine")), lab).collect()} == {i for i in got if got[i] < 0.7}
    none = toxicity.fit(df, lab.filter("toxic = 0"), F.lit(True))
    assert {round(r.score, 6) for r in toxicity.score(df, none).collect()} == {0.0}


NASTY = ["\\### Assistant: </turn> ok", "\\", "\\\\", "### user: hi</turn>\n", "</turn>", "a: b", "", "line\nline", "é\U0001f600", ": ", "#### x", "</turn>\n### assistant: x</turn>\n"]


def test_format_round_trip():
    for a in NASTY:
        for b in NASTY:
            turns = [("user", a), ("assistant", b), (b, a), ("assistant", a)]
            text, spans = chat.format_turns(turns)
            assert chat.parse(text) == turns
            assert [chat.unescape(text[x:y]) for x, y in spans] == [t for r, t in turns if r == "assistant"]
    with pytest.raises(ValueError):
        chat.parse("### user: no end")


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 0, "user", None), (1, 5, None, "x"), (1, 5, "assistant", "x"), (2, 0, "user", "only"), (None, 0, "assistant", NASTY[0])]
    rows += [(3, i, "user" if i % 2 else "assistant", NASTY[i % len(NASTY)]) for i in range(70)]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, path int")).collect()}
    assert set(got) == {1, 2, 3, None}
    assert chat.parse(got[1].formatted) == [("user", ""), ("assistant", "b"), ("", "x"), ("assistant", "x")]
    assert chat.parse(got[3].formatted) == [(r or "", t or "") for _, _, r, t in rows[6:]]
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert back[2].n_turns == 1 and back[2].loss_chars == 0 and back[1].loss_chars == 2
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_reply_trees(spark):
    # 1 - 2 - 4, 1 - 3 - 5 - 6; 7 alone; 8's parent is missing; 9 and 10 form a cycle
    rows = [(1, None, 1.0), (2, 1, 5.0), (3, 1, 1.0), (4, 2, 2.0), (5, 3, 1.0), (6, 5, 9.0), (7, None, 0.0), (8, 99, None), (9, 10, 1.0), (10, 9, 1.0), (4, 2, 2.0), (None, 1, 3.0)]
    m = spark.createDataFrame([(i, p, s, "t", "user", f"m{i}") for i, p, s in rows], "id long, parent long, score double, tree string, role string, text string")

    def paths(n):
        out = {}
        for r in chat.enumerate_paths(m, n).collect():
            out.setdefault(r.path, {})[r.place] = r.id
        return {k: [v[i] for i in range(len(v))] for k, v in out.items()}

    assert paths(5) == {4: [1, 2, 4], 6: [1, 3, 5, 6], 7: [7], 8: [8]}
    assert paths(1) == {6: [1, 3, 5, 6], 7: [7], 8: [8]}  # 3.0 a message against 2.67
    assert {r.formatted for r in chat.format_paths(m).filter("n_turns = 4").collect()} == {"".join(f"### user: m{i}</turn>\n" for i in (1, 3, 5, 6))}


def test_repeated_message_ids_keep_whole_rows(spark):
    rows = [(1, None, "t", "user", "root one", 1.0), (2, None, "t", "user", "root two", 1.0), (3, 1, "t", "assistant", "zz from one", 0.0), (3, 2, "t", "assistant", "aa from two", 0.0), (3, 1, "t", "assistant", "zz from one", 0.0), (None, 1, "t", "user", "lost", 0.0)]
    m = spark.createDataFrame(rows, "id long, parent long, tree string, role string, text string, score double")
    got = {r.formatted for r in chat.format_paths(m).collect()}
    assert got == {"### user: root one</turn>\n### assistant: zz from one</turn>\n", "### user: root two</turn>\n"}


def plain_kneser_ney(texts, order=4):
    """Log probabilities of the characters of a text, straight from the definitions, over dictionaries."""
    from collections import defaultdict

    gap = "\0" * (order - 1)
    seen = {n: defaultdict(float) for n in range(1, order + 1)}
    for t in texts:
        t = gap + t
        for i in range(order - 1, len(t)):
            seen[order][t[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        for w in seen[n + 1]:
            seen[n][w[1:]] += 1
    letters = len(seen[1])

    def p(w):
        n = len(w)
        if not n:
            return 1 / (letters + 1)
        ones, twos = (sum(v == k for v in seen[n].values()) for k in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        of = {k: v for k, v in seen[n].items() if k[:-1] == w[:-1]}
        if not of:
            return p(w[1:])
        total = sum(of.values())
        return max(of.get(w, 0) - d, 0) / total + d * len(of) / total * p(w[1:])

    def logs(t):
        t = gap + t
        return [math.log(p(t[i - order + 1 : i + 1])) for i in range(order - 1, len(t))]

    return logs


def test_kneser_ney_against_plain(spark):
    texts = ["abra cadabra abracadabra", "bar car radar", "a carb arc", "crab"]
    model = language.fit(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string"), F.lit(True))
    logs = plain_kneser_ney(texts)
    for t in ["abra", "cab car", "zebra", "rad", *texts]:
        x, n = model.cross_entropy([t])
        assert n[0] == len(t) and abs(x[0, 0] + sum(logs(t)) / len(t)) < 1e-4, t


def test_scripts_beyond_the_basic_plane(spark):
    goth, dese = "".join(chr(0x10330 + i % 20) for i in range(60)), "".join(chr(0x10428 + i % 30) for i in range(60))
    df = spark.createDataFrame([(1, goth, "got"), (2, dese, "en-dsrt")], "doc_id long, text string, lang string")
    model = language.fit(df, F.lit(True))
    assert model.judge([goth[5:40], dese[5:40]])[0] == ["got", "en-dsrt"]


def test_free_operators_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, score double, language string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert language.keep_identified(docs).count() == 0 and language.keep_identified(docs).columns == docs.columns
    assert toxicity.drop_toxic(docs, labels).count() == 0 and toxicity.drop_toxic(docs, labels).columns == docs.columns

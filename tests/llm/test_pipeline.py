
import corpus_pipeline
from test_entry_llm import small_tables


def test_stages_and_run(spark, tmp_path):
    d = small_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, d)
        assert docs.columns == names, name
        docs.write.parquet(f"{d}/after-{name}")
        docs = spark.read.parquet(f"{d}/after-{name}")
        ids = {r.doc_id for r in docs.collect()}
        assert len(ids) == docs.count() <= before
        if name == "toxicity":
            assert not ids & set(range(0, 300, 10)) and 1 in ids
        if name == "language":
            assert 901 not in ids and 1 in ids
        if name == "simhash":
            assert 700 not in ids
        if name == "decontamination":
            assert 800 not in ids and 801 in ids
            assert "bench0" not in docs.filter("doc_id = 801").first().text
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in packed} == ids
    run = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in run) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def plain_run(docs, labels, items):
    """The pipeline as loops over lists: (doc_id, text) of what is packed, in the order of the rows."""
    import zlib

    from corpusatlas.llm import language, toxicity
    from test_free import jaccard
    from test_native import brute, doc_words

    crc = lambda d: zlib.crc32(str(d).encode())
    marks = {}
    for d, t in labels:
        marks[d] = max(t, marks.get(d, 0))
    sample = {d: t for d, t, _ in sorted(docs, key=lambda r: r[1] or "", reverse=True) if d is not None and d in marks and crc(d) % 3 != 1}
    scorer = toxicity.learn(list(sample.values()), [marks[d] for d in sample])
    rows = [r for r in docs if scorer.score(r[1]) < 0.7]
    import numpy as np

    counts, own = {}, {}
    for d, t, k in rows:
        if k is not None and t is not None and (d is None or crc(d) % 5):
            own.setdefault(k, []).append(t)
    for k, texts in own.items():
        c, _ = language.encode(texts)
        counts[k] = np.unique(language.windows(c)[c[3:] != 0], return_counts=True)
    model = language.Model(sorted(own), counts)
    for i, k in enumerate(model.langs):
        x, n = model.cross_entropy(own[k])
        x, n = x[n > 0, i], np.clip(n[n > 0], 1, 256)
        model.mean[i], model.spread[i] = x.mean(), max(1e-3, np.sqrt((n * (x - x.mean()) ** 2).mean()))
    gone = model.judge([t for _, t, _ in rows])[2]
    rows = [r for r, bad in zip(rows, gone, strict=True) if not bad]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0, 1 << 60)), (d is None, d or 0, i))
    rows = [rows[i] for _, _, i in best.values()]
    out = []
    for d, t, _ in rows:
        (_, n, hits, _, bad), = brute([(d, t)], items)
        if not bad:
            out.append((d, t, hits, n, len(doc_words(t))))
    return out


def test_run_against_loops(spark, tmp_path):
    from test_free import library

    d = small_tables(spark, tmp_path / "base")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    base = sorted((r.doc_id, r.text, r.lang) for r in docs.collect())
    changed = " ".join("other" if i == 40 else w for i, w in enumerate(base[2][1].split()))
    edges = [(None, base[3][1], "aa"), (5, base[5][1], "aa"), (5, base[5][1] + " " + base[6][1], "aa"), (902, None, "aa"), (903, "", None), (904, changed, "aa"), (905, base[7][1] + " " + base[8][1], None), (906, base[1][1].upper(), "aa")]
    rows = base + edges
    d = str(tmp_path)
    spark.createDataFrame([(*r, "src0", 0) for r in rows], docs.schema).write.parquet(f"{d}/documents.parquet")
    labels, items = (spark.read.parquet(f"{d}/base/{n}.parquet") for n in ("labels", "benchmark"))
    labels.write.parquet(f"{d}/labels.parquet")
    items.write.parquet(f"{d}/benchmark.parquet")
    want = plain_run(rows, [(r.doc_id, r.toxic) for r in labels.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = corpus_pipeline.run(spark, d).collect()
    first = sorted((str(r.doc_id), r.length) for r in got if r.piece == 0)
    assert [k for k, _ in first] == sorted(str(k) for k, *_ in want)
    clean = [(str(k), min(2048, len(library([t])[0]) + 1)) for k, t, hits, *_ in want if not hits]
    assert len(clean) > 200 and set(clean) <= set(first)
    ids = {r.doc_id for r in got}
    assert not {902, 903, 904, 700, 906} & ids and {905, 801} <= ids and all(r.length <= 2048 for r in got)
    assert sum(r.doc_id == 5 for r in got) == 2


def test_empty_tables(spark, tmp_path):
    d = small_tables(spark, tmp_path / "base")
    for n in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{n}.parquet").limit(0).write.parquet(f"{tmp_path}/{n}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

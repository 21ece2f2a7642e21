"""Queries without SQL over all documents and whole texts, by brute force on a small fixture."""

from difflib import SequenceMatcher

import pytest

from corpusatlas.plans import structure


@pytest.fixture
def tables(spark, tmp_path):
    # no id is divisible by 10 or leaves 1 or 2; the reference's lines come again behind line 8
    docs = [(13, "alpha beta gamma delta epsilon zeta"), (24, "one fine title of a benchmark\nmore"), (35, "\n".join(["t", "a first reference line of text", "and the second line of the reference", *"bcdefghi", "a first reference line of text", "and the second line of the reference"]))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "One fine title of a benchmark"), (2, "beta alpha gamma"), (3, "something else")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs


def test_link_fuzzy_titles_takes_all_rows(spark, tables):
    d, docs = tables
    got = {r.doc_id: (r.cand_id, r.score) for r in structure.link_fuzzy_titles(spark, d).collect()}
    items = [(1, "one fine title of a benchmark"), (2, "beta alpha gamma"), (3, "something else")]
    want = {i: min((-SequenceMatcher(None, t.lower().split("\n")[0], k).ratio(), c) for c, k in items) for i, t in docs}
    assert got == {i: (c, pytest.approx(-s, abs=1e-4)) for i, (s, c) in want.items()}


def test_title_ratios_are_difflibs(spark):
    """Popular characters, astral characters, empty texts and ties; as a column of Spark, not in Python workers."""
    import random

    from corpusatlas.functions import text as T
    from pyspark.sql import functions as F

    rng = random.Random(3)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    keys = ["", "a", *(some(rng.randint(1, 420), "abcdef é\U0001d538" * 3 + "xyz") for _ in range(24))]
    texts = ["", "abc", *(k[:90] + "zz" + k[95:] for k in keys[2:6]), *(some(rng.randint(0, 300), "abcdef é\U0001d538q") for _ in range(40))]
    choices = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(k).alias("k"), F.lit(False).alias("more")) for i, k in enumerate(keys)])
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.two_best(spark, F.col("t"), choices).alias("top"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for t, top in df.collect():
        want = sorted((-SequenceMatcher(None, t, k).ratio(), i) for i, k in enumerate(keys))[:2]
        assert [(-x.score, x.id) for x in top] == want


def test_front_matches_takes_whole_texts(spark, tables):
    d, docs = tables
    from corpusatlas.operators import linkage
    from pyspark.sql import functions as F

    got = structure.front_matches(spark, d).collect()
    assert {(r.doc_id, r["first"], r.n, r.score) for r in got} == {(35, 1, 2, 1.0)}
    lines = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    reference = spark.createDataFrame([(35, "a first reference line of text and the second line of the referense")], "doc_id long, reference string")
    found = linkage.front_matches(lines.filter("ord > 2"), reference, "doc_id").collect()
    assert [(r["first"], r.n) for r in found] == [(11, 2)]


def test_page_mentions_splits_a_page_once(spark):
    """A page of many words: when its words were split for each word, this took minutes."""
    import time

    from corpusatlas.operators import linkage

    words = " ".join(f"w{i % 977}" for i in range(60_000))
    pages = spark.createDataFrame([(1, words + " a title of five words"), (2, "w1 w2 w3 w4 w6")], "page_id int, page_key string")
    titles = spark.createDataFrame([(1, "a title of five words"), (2, "w1 w2 w3 w4 w5"), (3, "w1 w2 w3 w4 w7")], "title_id int, title_key string")
    began = time.time()
    assert sorted((r.page_id, r.title_id) for r in linkage.page_mentions(pages, titles).collect()) == [(1, 1), (1, 2)]
    assert time.time() - began < 30


def test_knn_is_exact_over_blocks_and_ties(spark):
    """Against numpy, with equal vectors in several blocks; a vector is shuffled once a block and part, not once a block pair."""
    import numpy as np

    from corpusatlas.operators import vectors

    rng = np.random.default_rng(5)
    x = rng.normal(size=(2300, 8)).astype(np.float32)
    x[200:260] = x[7]
    df = spark.createDataFrame([(int(i) * 3, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(5)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(np.clip(u @ u.T, -1, 1), 9)
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1, kind="stable")[:, :6]
    got = {(r.src, r["rank"]): r.dst for r in vectors.knn(df, "id", 6, block=300).collect()}
    assert got == {(i * 3, j + 1): int(want[i, j]) * 3 for i in range(len(x)) for j in range(6)}
    rows = vectors.deal_pairs(vectors.unit(df.selectExpr("id", "embedding AS v"), "v"), 2300, 300)
    assert rows.count() <= 2300 * (8 + 4)


def test_trustworthiness_is_exact_over_blocks(spark):
    """Against the ranks of the whole matrix, with equal vectors and points; no task holds a matrix of all pairs."""
    import numpy as np

    from corpusatlas.operators import vectors

    rng = np.random.default_rng(6)
    x, p = rng.normal(size=(2200, 6)), rng.normal(size=(2200, 2))
    x[30:40], p[60:70] = x[5], p[8]
    rows = [(i, v.tolist(), q.tolist()) for i, (v, q) in enumerate(zip(x, p, strict=True))]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, pc array<double>")
    u, n, k = x / np.linalg.norm(x, axis=1, keepdims=True), len(x), 7
    far = np.round(1 - u @ u.T, 10)
    np.fill_diagonal(far, np.inf)
    rank = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1, kind="stable") + 1
    d = ((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    over = np.maximum(np.take_along_axis(rank, np.argsort(d, axis=1, kind="stable")[:, :k], 1) - k, 0).sum()
    got = vectors.trustworthiness(df.select("id", "embedding"), df.select("id", "pc"), "id", k, block=500)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.first()[0] == pytest.approx(1 - 2 * over / (n * k * (2 * n - 3 * k - 1)), abs=1e-12)


def test_hierarchy_needs_no_matrix():
    """The tree of the matrix of distances, in memory that follows the vectors."""
    import tracemalloc

    import numpy as np

    from corpusatlas.operators import cluster

    rng = np.random.default_rng(7)
    x = rng.normal(size=(7000, 8)) + 0.3
    x[40:60] = x[3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    small = x[:900]
    a, b = cluster.average_linkage(1 - np.clip(small @ small.T, -1, 1)), cluster.average_linkage_of(small)
    assert np.allclose(a[:, 2], b[:, 2]) and (cluster.cut(a, 900, 8) == cluster.cut(b, 900, 8)).all()
    tracemalloc.start()
    assert len(cluster.average_linkage_of(x)) == 6999
    assert tracemalloc.get_traced_memory()[1] < 7000 * 7000 * 8 / 2
    tracemalloc.stop()


def test_terms_in_chunks_are_those_of_the_long_table(spark):
    """Repeated keys, null texts, digits, marks and other scripts; the papers' own counts are not shuffled by term."""
    import random

    from corpusatlas.operators import topics
    from pyspark.sql import functions as F

    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma-ray", "x", "12", "v2", "the", "naïve", "Ⅷb", "²c", "ﬁrm", "d.e", "zwölf", "𝔸b", "a_b", "٣٤", "(of)", "ß1"]
    rows = [(i % 90, " ".join(rng.choice(words) + rng.choice(["", "", ",", "\n"]) for _ in range(rng.randint(0, 30))) if i % 13 else None, i % 4) for i in range(100)]
    papers = spark.createDataFrame(rows, "k int, text string, cluster int")
    for some in (papers, papers.filter("k >= 10")):
        counts = topics.term_counts(some, "k", F.col("text"), ("the", "of"))
        old = topics.tfidf(counts, topics.vocabulary(counts, some.count()), "k")
        new = topics.Terms(some, "k", F.col("text"), ("the", "of"), chunk=16)
        assert "FlatMapCoGroupsInArrow" in new.weights()._jdf.queryExecution().executedPlan().toString()
        got = {(r.k, r.term): (r.tf, round(r.tfidf, 9)) for r in new.weights().collect()}
        assert got == {(r.k, r.term): (r.tf, round(r.tfidf, 9)) for r in old.collect()} and got
        assert {(r.term, r.df) for r in new.vocabulary().collect()} == {(r.term, r.df) for r in topics.vocabulary(counts, some.count()).collect()}
        show = lambda df: {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("cluster", "ranking", "rank", "term", "score", "inside_count", "outside_count").collect()}
        assert show(new.topics(6, 0.2)) == show(topics.topic_terms(old, some, "k", 6, 0.2))


def test_documents_are_folded_many_to_a_call(spark):
    """Keys over many batches, one of no key, against plain Python; no query runs pandas for a document or a component."""
    from corpusatlas.operators import documents, linkage, selection
    from corpusatlas.operators.grouped import fold_groups
    from pyspark.sql import functions as F

    rows = [(None if i % 50 == 0 else i % 7, 5000 - i, f"t{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, o int, t string").repartition(6)
    got = fold_groups(df, "k", ["o"], lambda k, part: [(k, ",".join(r[2] for r in part))], "k int, all string").collect()
    want = {k: ",".join(t for x, _, t in sorted(rows, key=lambda r: r[1]) if x == k) for k in [None, *range(7)]}
    assert {r.k: r.all for r in got} == want and len(got) == len(want)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan(documents.extract_abstract(df.select("k", F.col("o").alias("ord"), F.col("t").alias("text")), "k"))
    reference = df.groupBy("k").agg(F.first("t").alias("reference"))
    assert "Window" not in plan(linkage.front_matches(df.select("k", F.col("o").alias("ord"), F.col("t").alias("text")), reference, "k"))

    # a row without a shared key is no group of Python
    lone = spark.createDataFrame([(i, "", f"x{i}") for i in range(50)] + [(50, "d", "x3"), (51, "d", "y")], "id int, doi string, text string")
    kept = selection.first_claims(lone, "id", ["doi", "text"])
    assert sorted((r.id, r.claimed_by) for r in kept.filter("NOT kept").collect()) == [(50, "text")]
    assert "Pandas" not in plan(kept)


def test_cleaned_texts_are_computed_once(spark):
    """The notice is sought once in the plan, however often its place is used."""
    from corpusatlas.functions import text as T
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("One two. © 2020 P",), ("N/A",), (None,)], "x string")
    out = df.select(T.clean_abstract(F.col("x")).alias("c")).select("c.text", "c.removed", T.word_count(F.col("c.text")).alias("n"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("the author") == 1
    assert [tuple(r) for r in out.collect()] == [("One two.", "© 2020 P", 2), ("", "", 0), ("", "", 0)]

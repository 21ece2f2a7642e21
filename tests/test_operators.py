"""Operators on small frames, with the edge cases that matter."""

import math
import random
from difflib import SequenceMatcher
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusatlas import contracts
from corpusatlas.functions import text as T
from corpusatlas.operators import ages, agreement, cluster, documents, graphs, linkage, ranking, readability, review, screening, selection, topics, vectors


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def value(spark, column, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_dois(spark):
    assert value(spark, T.normalize_doi, "https://doi.org/10.1/A", "http://dx.doi.org/10.1/a", "doi: 10.1/A", None, "", " 10.1/b ") == ["10.1/a", "10.1/a", "10.1/a", "", "", "10.1/b"]


def test_clean_abstract(spark):
    got = value(spark, T.clean_abstract, "P <.001 holds", "<p>One</p>two", "Fine text. © 2020 Publisher", "[No abstract available]", None)
    assert [(r.text, r.removed) for r in got] == [("P <.001 holds", ""), ("One two", ""), ("Fine text.", "© 2020 Publisher"), ("", ""), ("", "")]


def test_titles(spark):
    assert value(spark, T.normalize_title, "Éa & B: the_Straße", "x--Y  2", None) == ["ea and b the strasse", "x y 2", ""]
    assert value(spark, T.normalize, "a&amp;b  c­d", None) == ["a&b cd", ""]
    assert value(spark, T.normalize_scope, "Private–Equity  ﬁrm", "ß") == ["private-equity firm", "ss"]


def test_term_tokens(spark):
    stop = ("in", "the", "of")
    got = value(spark, lambda c: T.term_tokens(c, stop), "funds in markets", "private-equity", "top 10 funds", "one, two", "aa/bb cc_dd", "a I x")
    assert got[0] == ["funds", "markets"] and "private equity" in got[1] and "top funds" not in got[2]
    assert "one two" not in got[3] and {"aa bb", "cc dd"} <= set(got[4]) and got[5] == []


def test_phrases(spark):
    p = T.phrase_pattern("private equity")
    got = value(spark, lambda c: F.regexp_count(c, F.lit(p)), "Private-equity and private  equity", "xprivate equity", "éprivate equity", "private equity.", "private, equity")
    assert got == [2, 0, 0, 1, 0]


def test_ratio(spark):
    df = frame(spark, [("private equity", "equity private"), ("", ""), (None, "x")], "a string, b string")
    got = [r.v for r in df.select(T.similarity_ratio(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == [SequenceMatcher(None, "private equity", "equity private").ratio(), 1.0, 0.0]


def test_periods(spark):
    p = ages.periods_table(spark, [("a", 1990, 1995), ("b", 1996, 2000), ("c", 2001, 2002)])
    papers = frame(spark, [("x", 1995, True), ("x", 1996, True), ("y", 1996, True), ("y", 1990, False)], "cluster string, year int, assigned boolean")
    got = {(r.cluster, r.period): r for r in ages.period_shares(papers, p).collect()}
    assert len(got) == 6 and got["x", "c"].share_pct is None and got["y", "a"].papers == 0 and got["y", "a"].period_unassigned_papers == 1 and got["y", "b"].share_pct == 50
    with pytest.raises(contracts.ContractError):
        ages.with_period(frame(spark, [(1980,)], "year int"), p)
    s = {r.cluster: r for r in ages.cluster_summary(frame(spark, [("x", 2000 - i, True) for i in (1, 2, 3, 4)], "cluster string, year int, assigned boolean"), 2000).collect()}["x"]
    assert (s.q25_age, s.median_age, s.small_cluster) == (1.75, 2.5, True)


def test_contracts(spark):
    a, b = frame(spark, [(1,), (2,)], "k int"), frame(spark, [(1, "x"), (1, "y")], "k int, v string")
    for bad in (lambda: contracts.lookup_join(a, b, "k"), lambda: contracts.lookup_join(a, b.limit(1), "k"), lambda: contracts.holds(a, F.col("k") > 1, "small")):
        with pytest.raises(contracts.ContractError):
            bad()


def test_ranks(spark):
    df = frame(spark, [("a", 3), ("b", 3), ("c", 1), ("d", 5)], "k string, s int")
    assert {r.k: r["rank"] for r in ranking.competition_rank(df, "s").collect()} == {"d": 1, "a": 2, "b": 2, "c": 4}
    assert {r.k: r.cluster for r in ranking.dense_labels(df, "k", "s").collect()}["c"] == 1
    gap = frame(spark, [("p", 0.9), ("p", 0.85), ("q", 0.5)], "k string, s double")
    assert {r.k: round(r.gap, 9) for r in ranking.gap_to_next(gap, ["k"], "s").collect()} == {"p": 0.05, "q": 1.0}


def test_first_claims(spark):
    rows = [(1, "d1", "t1"), (2, "d2", "t1"), (3, "d2", "t2"), (4, "d1", "t3"), (5, "", "t4"), (6, "", "t5"), (7, "", "t4"), (8, None, "t9"), (9, "d2", "t2")]
    got = {r.i: (r.kept, r.claimed_by) for r in selection.first_claims(frame(spark, rows, "i long, doi string, text string"), "i", ["doi", "text"]).collect()}
    assert {i for i, (k, _) in got.items() if k} == {1, 3, 5, 6, 8}
    assert got[2][1] == "text" and got[4][1] == "doi" and got[9][1] == "doi"


def test_exclusions(spark):
    papers = frame(spark, [("a",), ("b",)], "k string")
    kept, audit = selection.exclude(papers, frame(spark, [("a", True), ("b", False), ("z", True)], "k string, exclude boolean"), "k")
    assert [r.k for r in kept.collect()] == ["b"] and {r.k: r.status for r in audit.collect()} == {"a": "excluded", "b": "kept_by_decision", "z": "not_in_loaded_corpus"}
    with pytest.raises(contracts.ContractError):
        selection.drop_reviewed_duplicates(papers, frame(spark, [("a", "b"), ("b", "c")], "duplicate_key string, canonical_key string"), "k")
    left = selection.drop_reviewed_duplicates(papers, frame(spark, [("a", "zz")], "duplicate_key string, canonical_key string"), "k")
    assert left.count() == 2


def test_graphs(spark):
    edges = frame(spark, [(1, 2), (2, 1), (2, 3), (5, 6)], "src long, dst long")
    nodes = frame(spark, [(i, 0) for i in range(1, 8)], "node long, cluster int")
    assert {r.node: r.component for r in graphs.with_components(nodes.select("node"), edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    d = {r.node: (r.in_degree, r.out_degree, r.degree) for r in graphs.degrees(nodes.select("node"), edges).collect()}
    assert d[2] == (1, 2, 2) and d[7] == (0, 0, 0)
    assert graphs.modularity(nodes.select("node", "cluster"), graphs.undirected(edges)).first().objective == 0
    with pytest.raises(contracts.ContractError):
        graphs.undirected(frame(spark, [(1, 1)], "src long, dst long"))


def test_agreement(spark):
    same = frame(spark, [(i % 3, (i + 1) % 3) for i in range(30)], "a int, b int")
    t = agreement.contingency(same)
    assert agreement.adjusted_rand(t).first().ari == pytest.approx(1) and agreement.adjusted_mutual_information(t).first().ami == pytest.approx(1)
    one = agreement.contingency(frame(spark, [(0, i) for i in range(5)], "a int, b int"))
    assert agreement.adjusted_rand(one).first().ari == 0
    rng = np.random.default_rng(0)
    for shape in ((4, 4), (3, 5), (5, 3)):
        g = rng.integers(0, 20, shape)
        got = sum(g[i, j] for i, j in agreement.assignment(g))
        small = g if shape[0] <= shape[1] else g.T
        assert got == max(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(small.shape[1]), len(small)))
    lf = spark.range(0, 60).select(agreement.log_factorial(F.col("id")).alias("v")).collect()
    assert all(abs(r.v - math.lgamma(i + 1)) < 1e-10 for i, r in enumerate(lf))


def test_vectors(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [0.0, 2.0], 1), (4, [-1.0, 0.0], 2)]
    v = frame(spark, rows, "k long, embedding array<float>, label int")
    nn = {(r.src, r["rank"]): r.dst for r in vectors.knn(v, "k", 2, block=2).collect()}
    assert nn[0, 1] == 1 and nn[2, 1] == 3 and nn[0, 2] == 2 and len(nn) == 10
    assert {(r.src, r.dst) for r in vectors.similarity_graph(vectors.knn(v, "k", 2)).collect()} == {(0, 1), (2, 3)}
    assert len(vectors.knn(v, "k", 15).collect()) == 20
    s = {r.k: r.silhouette for r in vectors.silhouettes(v, "label", "k").collect()}
    assert s[4] == 0 and s[0] == pytest.approx(1)
    sim = {(r.a, r.b): r.similarity for r in vectors.mean_similarity(v, "label").collect()}
    assert sim[2, 2] is None and sim[0, 0] == pytest.approx(1) and sim[0, 2] == pytest.approx(-1)
    with pytest.raises(Exception, match="zero vector"):
        vectors.unit(frame(spark, [(0, [0.0, 0.0])], "k long, embedding array<float>")).collect()


def test_leiden_finds_planted():
    rng = np.random.default_rng(1)
    pairs = {tuple(sorted(rng.integers(0, 20, 2) + 20 * g)) for g in range(4) for _ in range(90)} | {(0, 20), (20, 40), (40, 60)}
    pairs = sorted(p for p in pairs if p[0] != p[1])
    s, d = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    w = np.ones(len(s))
    labels = cluster.leiden(80, s, d, w, 1.0, 7)
    truth = np.repeat(np.arange(4), 20)
    assert cluster.objective(80, s, d, w, labels, 1.0) >= cluster.objective(80, s, d, w, truth, 1.0) - 1e-9
    # communities are connected
    for c in set(labels):
        own = {int(x) for x in np.flatnonzero(labels == c)}
        seen, stack = set(), [min(own)]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += [int(b) for a, b in pairs if a == x and b in own] + [int(a) for a, b in pairs if b == x and a in own]
        assert seen == own


def brute_linkage(d):
    groups, heights = [[i] for i in range(len(d))], []
    while len(groups) > 1:
        h, i, j = min((np.mean([d[a, b] for a in groups[i] for b in groups[j]]), i, j) for i in range(len(groups)) for j in range(i))
        heights.append(h)
        groups[j] += groups.pop(i)
    return heights


def test_hierarchy():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = 1 - x @ x.T
    m = cluster.average_linkage(d)
    assert np.allclose(m[:, 2], brute_linkage(d)) and m[-1, 3] == 30
    assert len(set(cluster.cut(m, 30, 7))) == 7 and len(set(cluster.cut(m, 30, 99))) == 30
    tied = cluster.average_linkage(np.ones((4, 4)) - np.eye(4))
    assert len(set(cluster.cut(tied, 4, 2))) == 1  # equal heights stay together


def test_sections(spark):
    got = value(spark, documents.heading_number, "2.1 Data", "IV. Results", "Introduction", "3) x")
    assert got == ["2.1", "IV", "", "3"]
    b = frame(spark, [(1, i, k, t) for i, (k, t) in enumerate([("text", "o"), ("heading", "1 Introduction"), ("text", "a"), ("heading", "1.1 More"), ("heading", "2 Data")])], "d int, ord int, kind string, text string")
    out = documents.section_groups(b, "d", "ord", documents.main_heading(F.col("kind"), F.col("text")))
    assert [r.section for r in out.orderBy("ord").collect()] == [0, 1, 1, 1, 2]


def test_segments(spark):
    rows = [(1, 0, "a", "w " * 5), (1, 1, "a", "w " * 4), (1, 2, "b", "w " * 2), (1, 3, "b", "x" * 50), (1, 4, "b", "w " * 23), (2, 0, "a", None)]
    out = documents.pack_segments(frame(spark, rows, "d int, ord int, section string, text string"), "d", 10).collect()
    used = {}
    for r in out:
        used[r.segment] = used.get(r.segment, 0) + r.tokens
    assert max(used.values()) <= 10 and sum(used.values()) == 35 and {r.ord for r in out if r.segment == 0} == {0, 1}


def test_abstracts(spark):
    rows = [(1, 0, "Title"), (1, 1, "Abstract. We study things. Keywords: a, b"), (1, 2, "more of it"), (1, 3, "1. Introduction"), (1, 4, "no"), (2, 0, "w " * 50), (3, 0, "short")]
    got = {r.d: (r.abstract, r.method, r.review) for r in documents.extract_abstract(frame(spark, rows, "d int, ord int, text string"), "d").collect()}
    assert got[1][0].startswith("We study things.") and got[1][1:] == ("marker", True) and got[2][1] == "candidate" and got[3][1] == "missing"


def test_html(spark):
    got = value(spark, documents.visible_text, "<p>a &amp; b<script>x</script></p><table><tr><td>1</td><td>2</td></tr></table><math>x</math>", None)
    assert got == ["a & b\n1 | 2\n$x$", ""]


def test_screening(spark):
    rules = screening.Rules(core="PE", chemistry="polymer", venture="VC", startup="startup", ambiguous="loan", trade_journals=("news",), other_types=("note",))
    rows = [("PE polymer", "PE PE", "j", ""), ("PE", "PE VC", "j", ""), ("x", "PE VC", "j", ""), ("PE", "startup", "j", ""), ("x", "PE startup", "j", ""), ("x", "y", "j", ""), ("PE", "", "j", "note"), ("x", "PE", "j", ""), ("x", "PE PE", "j", ""), ("PE", "", "News", ""), ("PE", "loan", "j", "")]
    df = frame(spark, [(i, *r) for i, r in enumerate(rows)], "i int, title string, abstract string, journal string, document_type string")
    got = [(r.decision, r.reason) for r in screening.decide(df, rules).orderBy("i").collect()]
    assert [g[0] for g in got] == ["exclude", "review", "exclude", "review", "exclude", "exclude", "review", "review", "keep", "exclude", "review"]
    audit = screening.decide(df, rules).select("i", screening.record_hash("title").alias("record_sha256"), "decision", "reason")
    with pytest.raises(contracts.ContractError):
        screening.override(audit, frame(spark, [(0, "stale", "keep", "r")], "i int, record_sha256 string, decision string, reason string"), "i")


def test_lists():
    def items(t, term="PE"):
        at = t.index(term)
        return screening.list_mention(t, at, at + len(term))

    assert len(items("investors (PE, VC and hedge funds) buy")) == 3
    assert items("We study PE and it is great, we think") == []
    assert len(items("assets such as PE and bonds.")) == 2
    assert items("PE and bonds.") == []


def test_late_mentions(spark):
    df = frame(spark, [(1, "a b PE"), (2, "PE b c"), (3, "a b c")], "k int, t string")
    got = {r.k: r.late_only for r in screening.late_only(screening.mentions(df, "k", "t", "PE"), "k").collect()}
    assert got == {1: True, 2: False}


def test_topics(spark):
    papers = frame(spark, [(i, "alpha beta" if i < 20 else "gamma beta", i // 20) for i in range(40)], "k int, text string, cluster int")
    counts = topics.term_counts(papers, "k", F.col("text"), ())
    w = topics.tfidf(counts, topics.vocabulary(counts, 40, 3, 1.0), "k")
    got = {(r.cluster, r.ranking, r["rank"]): r.term for r in topics.topic_terms(w, papers, "k", 3).collect()}
    assert got[0, "contrast", 1] == "alpha" and got[0, "contrast", 2] == "alpha beta" and (0, "contrast", 3) not in got
    found = topics.occurrences(topics.passages(papers, "k"), "k", "alpha beta")
    assert {r.cluster: (r.containing, r.occurrences) for r in topics.search_expression(found, papers, "k").collect()} == {0: (20, 20), 1: (0, 0)}


def test_linkage(spark):
    aliases = frame(spark, [("k1", "a"), ("k2", "a"), ("k2", "b"), ("k3", "c")], "key string, alias string")
    refs = frame(spark, [("k1", "a"), ("k1", "b"), ("k2", "b"), ("k1", "c"), ("k1", "b")], "src string, alias string")
    assert {tuple(r) for r in linkage.alias_edges(refs, aliases, frame(spark, [("c",)], "alias string")).collect()} == {("k1", "k2")}
    edges, bad = linkage.two_way_edges(frame(spark, [("s", "a", "x"), ("s", "b", "y"), ("s", None, "x")], "src string, target_id string, target_doi string"), frame(spark, [("k1", "a"), ("k2", "b")], "key string, alias string"), frame(spark, [("k1", "x"), ("k9", "y")], "key string, alias string"))
    assert {(r.dst, r.methods) for r in edges.collect()} == {("k1", "doi;id+doi")} and bad.count() == 1
    papers = frame(spark, [(1, "deep learning for funds", "10.1/a", 2000), (2, "short title x", "", 2001), (3, "another fine long title", "", 2001)], "p int, title_key string, doi string, year int")
    cands = frame(spark, [(10, "deep learning for funds", "10.1/a", 1999), (11, "short title x", "", 2001), (12, "another fine long title", "", 2001)], "c int, cand_key string, cand_doi string, cand_year int")
    assert {r.p: r.status for r in linkage.resolve_titles(papers, cands, "p", "c").collect()} == {1: "strong", 2: "review", 3: "strong"}


def test_every_title_is_ranked(spark):
    rng = random.Random(3)
    common = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "of", "x"], k=rng.randint(0, 7))) for _ in range(150)]
    cands = [(i, t, "", 2000) for i, t in enumerate([*common, *["one title that many rows share"] * 60, None])]
    papers = [(1000 + i, t, "", 2000) for i, t in enumerate([*common[:40], "one title that many rows share", "", "zz", "the alpha beta gam"])]
    got = linkage.resolve_titles(frame(spark, papers, "p int, title_key string, doi string, year int"), frame(spark, cands, "c int, cand_key string, cand_doi string, cand_year int"), "p", "c").collect()
    assert len(got) == len(papers)
    for r in got:
        ranked = sorted((-SequenceMatcher(None, papers[r.p - 1000][1], t or "").ratio(), i) for i, t, _, _ in cands)
        assert (r.c, r.score, r.gap) == (ranked[0][1], -ranked[0][0], ranked[1][0] - ranked[0][0])


def test_readability(spark):
    df = frame(spark, [(1, "The cat sat. Beautiful animal!"), (2, "..."), (3, None)], "k int, text string")
    got = {r.k: r for r in readability.scores(df, "text").collect()}
    assert (got[1].words, got[1].sentences, got[1].syllables, got[1].complex_words) == (5, 2, 9, 2)
    assert got[1].fog == pytest.approx(0.4 * (2.5 + 40)) and got[2].fog is None and got[3].flesch is None


def test_review(spark):
    costs = frame(spark, [(i, c) for i, c in enumerate([7, 5, 5, 4, 3])], "k int, c int")
    got = review.balanced_groups(costs, "k", "c", 2).groupBy("group").agg(F.sum("c").alias("t")).collect()
    assert sorted(r.t for r in got) == [11, 13]
    text = frame(spark, [(1, "hello world")], "key int, text string")
    review.verify_excerpts(frame(spark, [(1, 6, "world")], "key int, start int, excerpt string"), text)
    with pytest.raises(contracts.ContractError):
        review.verify_excerpts(frame(spark, [(1, 5, "world")], "key int, start int, excerpt string"), text)


def test_bundles(spark, tmp_path):
    from corpusatlas.sources import readers, writers

    df = frame(spark, [(i, [float(i), 1.0]) for i in range(25)], "k long, v array<double>")
    folder = writers.export_bundle(spark, {"t": df}, str(tmp_path), "s1")
    assert writers.verify_bundle(spark, folder).count() == 1
    with pytest.raises(Exception):
        writers.export_bundle(spark, {"t": df}, str(tmp_path), "s1")
    a = writers.scope_bundle(df.select("k"), df, "k", str(tmp_path / "scope"))
    assert writers.scope_bundle(df.select("k"), df, "k", str(tmp_path / "scope")) == a
    assert [r.embedding_row for r in spark.read.parquet(f"{a}/row_map").orderBy("k").collect()] == list(range(25))
    with pytest.raises(contracts.ContractError):
        writers.scope_bundle(df.select("k").limit(3), df, "k", str(tmp_path / "few"))
    (tmp_path / "a.csv").write_text('﻿EID,Title\n1,"a ""b""\nc"\n2,\n', encoding="utf-8")
    got = readers.records(spark, str(tmp_path / "a.csv"), "EID", ["Title"]).collect()
    assert [(r.EID, r.Title) for r in got] == [("1", 'a "b"\nc'), ("2", "")]
    with pytest.raises(contracts.ContractError):
        readers.checked_csv(spark, str(tmp_path / "a.csv"), "0" * 64)
    (tmp_path / "x.pdf").write_bytes(b"1"), (tmp_path / "y.PDF").write_bytes(b"1")
    assert [r.duplicate for r in readers.discover(spark, str(tmp_path)).orderBy("path").collect()] == [False, True]


def test_stream_matches_batch(spark, tmp_path):
    from corpusatlas.streaming import windows

    events = frame(spark, [(i, 1000 + 600 * i, 1.0) for i in range(20)], "event_id long, s long, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "value", (F.col("event_id") % 2).alias("user_id"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream).writeStream.format("memory").queryName("got").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("got").collect()} == {tuple(r) for r in windows.tumbling(events).collect()}

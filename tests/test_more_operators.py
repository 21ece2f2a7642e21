"""Operators that no query reaches, on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from corpusatlas import contracts
from corpusatlas.operators import agreement, documents, graphs, linkage, provenance, readability, review, screening, selection, vectors
from corpusatlas.sources import readers, writers


def test_spans(spark):
    df = spark.createDataFrame([("hello big world", [(0, 5), (10, 15)])], "t string, s array<struct<start:int,end:int>>")
    assert df.select(documents.span_text(F.col("t"), F.col("s"))).first()[0] == "hello\n\nworld"
    bad = spark.createDataFrame([("hello", [(0, 3), (2, 4)])], "t string, s array<struct<start:int,end:int>>")
    with pytest.raises(Exception, match="overlapping"):
        bad.select(documents.span_text(F.col("t"), F.col("s"))).collect()


def test_blocks(spark):
    kind = "array<struct<type:string,text:string,html:string,include:boolean>>"
    rows = [("Text", "a", "a", True), ("Text", " ", "", True), ("Equation", "x", "x", True), ("Text", "f $x$", "f <math>x</math> g", True), ("Text", "no", "", False)]
    df = spark.createDataFrame([(rows,)], f"b {kind}")
    got = lambda m: [b.text for b in df.select(documents.embedding_blocks(F.col("b"), m)).first()[0]]
    assert got("keep") == ["a", "x", "f $x$"] and got("omit") == ["a", "f [FORMULA] g"]


def test_page_trees(spark):
    head = {"id": "/h", "block_type": "blocks.SectionHeader", "html": "<h1>One $</h1>"}
    listed = [{"id": "/r", "block_type": "SectionHeader", "html": "<h2>7. References</h2>"}, {"id": "/x", "block_type": "Text", "html": "a book", "section_hierarchy": {"10": "/r", "2": "/h"}}]
    page = {"id": "/page/0/Page/1", "children": [head, {"id": "/t/1", "block_type": "Text", "html": "<p>a &amp; b</p>", "section_hierarchy": {"1": "/h"}}, {"id": "/page/0/T/2", "block_type": "Text", "html": None}]}
    tree = {"id": "/doc", "children": [page, {"id": "/page/3/T/1", "block_type": "Code", "html": "x", "section_hierarchy": {"1": "/none"}}, {"id": "/f", "block_type": "PageFooter", "html": "9"}, *listed]}
    rows = documents.flatten_pages(spark.createDataFrame([(1, json.dumps(tree)), (2, None)], "k int, t string"), "k", "t")
    got = rows.orderBy("ord").collect()
    assert [(r.k, r.kind, r.page, r.text, r.section, r.exclusion_reason) for r in got] == [
        (1, "SectionHeader", 1, "One $", [], None), (1, "Text", 1, "a & b", ["One $"], None), (1, "Text", 1, "", [], None), (1, "Code", 4, "x", ["/none"], None), (1, "PageFooter", None, "9", [], "PageFooter"), (1, "SectionHeader", None, "7. References", [], "reference_section"), (1, "Text", None, "a book", ["One $", "7. References"], "reference_section")]
    assert [r.include for r in got] == [True, True, False, True, False, False, False]
    assert tuple(documents.document_status(rows, "k", fallback=F.lit("f.pdf")).first()) == (1, "One", "first_page_heading", "")


def test_paper_sections(spark):
    def sections(*blocks, title="A title"):
        rows = [(1, i, "SectionHeader" if level else "Text", text, level, title) for i, (text, level) in enumerate(blocks)]
        out = documents.paper_sections(spark.createDataFrame(rows, "d int, ord int, kind string, text string, level int, title string"), "d", "ord").orderBy("ord").collect()
        return [r.section for r in out], out[-1].section_name, out[-1].structure_flags

    assert sections(("a title", 1), ("2. Early", 1), ("1. Introduction", 2), ("x", None), ("2. Method", 3), ("2.1 Part", 1), ("y", None), ("Appendix A", 4)) == ([0, 0, 0, 0, 1, 1, 1, 2], "Appendix A", "")
    assert sections(("Introduction", 2), ("Data", 2), ("More", 3)) == ([0, 1, 1], "Data", "unnumbered_heading_levels_need_review")
    assert sections(("Abstract", 1), ("plain", None))[2] == "introduction_not_detected;unnumbered_heading_levels_need_review;no_section_boundaries_detected"


def test_structured_and_flagged_abstracts(spark):
    def found(*texts, kinds=None):
        rows = [(1, i, t, (kinds or {}).get(i, "Text")) for i, t in enumerate(texts)]
        return documents.extract_abstract(spark.createDataFrame(rows, "d int, ord int, text string, kind string"), "d").first()

    long = "CONCLUSIONS " + "word " * 20
    got = found("IMPORTANCE why", "OBJECTIVE what", long, "after it")
    assert got.method == "structured" and got.abstract.endswith(long.strip()) and "no_confirmed" not in got.flags
    got = found("A B S T R A C T: " + "word " * 1200, "still", "We thank all", "no")
    assert got.method == "marker" and got.abstract.endswith("still") and len(got.abstract.split()) == 1201 and "inspect_abstract_length" in got.flags
    got = found("Abstract", "one two", "A heading", "three", kinds={2: "SectionHeader", 1: "Text"})
    assert got.abstract == "one two" and found("Abstract", "figure", kinds={1: "Figure"}).flags.startswith("no_confirmed_end_boundary;inspect_abstract_length;empty_after_heading")
    got = found(*[f"{i} " + "word " * 50 for i in range(10)])
    assert got.method == "candidate" and len(got.candidates) == 8 and got.review
    assert found("short", None).method == "missing"


def test_list_items():
    def items(t, term="PE"):
        at = t.index(term)
        return screening.list_mention(t, at, at + len(term))

    assert items("They buy bonds, stocks, and PE. It is so.") == []  # two items: the first is a clause
    assert items("Bonds, stocks, and PE.") == ["Bonds", "stocks", "PE"]
    assert items("assets (bonds (a, b, c), PE, cash) rise") == ["bonds (a, b, c)", "PE", "cash"]
    assert items("assets (bonds, cash), PE markets were fine") == []
    assert items("It rises, for example PE & bonds; cash") == ["PE", "bonds", "cash"]
    assert items("many kinds, e.g. PE or bonds.") == ["PE", "bonds"]
    assert items("PE") == [] and items("(PE) x") == [] and items("Bonds, " + "x " * 11 + ", PE") == []


def test_runs_and_pointers(spark, tmp_path):
    a = provenance.run_identity({"model": "m", "limit": 5}, {"batch": 8})
    assert a == provenance.run_identity({"limit": 5, "model": "m"}, {"batch": 64}) != provenance.run_identity({"limit": 6, "model": "m"})
    with pytest.raises(contracts.ContractError):
        provenance.run_identity({"batch": 1}, {"batch": 1})
    path = str(tmp_path / "pointers")
    provenance.activate(spark, path, "vectors", "/runs/1", a)
    provenance.activate(spark, path, "vectors", "/runs/2", "b")
    pointers = spark.read.parquet(path)
    assert provenance.resolve(pointers, "vectors") == provenance.resolve(pointers, "vectors", "b") == "/runs/2"
    for name, run in (("none", None), ("vectors", a)):
        with pytest.raises(contracts.ContractError):
            provenance.resolve(pointers, name, run)
    v = lambda x: provenance.input_fingerprint(spark.createDataFrame([(1, [0.5, x])], "k int, embedding array<double>"), "k").first().fingerprint
    assert v(0.25) == v(0.25) != v(0.25 + 1e-12)


def test_literal_settings():
    source = "import os\nTERMS = ['a', 'b']\nTOP: int = 5\nbad = os.getcwd()\nif True:\n    TERMS = []\n"
    assert readers.literal_settings(source, ["TERMS", "TOP"]) == {"TERMS": ["a", "b"], "TOP": 5}
    for names in (["bad"], ["absent"]):
        with pytest.raises(contracts.ContractError):
            readers.literal_settings(source, names)


def test_passages_tile(spark):
    plan = [(1, [("ab\n\ncde", 2, "s", [("b1", 1, 0, 2), ("b2", 2, 5, 8)])])]
    got = readers.passages(spark.createDataFrame(plan, readers.SEGMENTS.replace("id string", "id int"))).orderBy("passage").collect()
    assert [(r.block_id, r.page, r.text) for r in got] == [("b1", 1, "ab"), ("b2", 2, "cde")]
    with pytest.raises(contracts.ContractError):
        readers.passages(spark.createDataFrame([(1, [("abc", 2, "s", [("b1", 1, 0, 2)])])], readers.SEGMENTS.replace("id string", "id int")))


def test_cached_responses(spark):
    works = [([("W1", "10.1/A", "t", 2000), ("W2", "10.1/b", "u", 2001)],), ([("W3", "10.1/B", "u", 2001), ("W1", "10.1/a", "t", 2000)],)]
    df = spark.createDataFrame(works, "results array<struct<id:string,doi:string,display_name:string,publication_year:int>>")
    assert [(r.doi, r.id) for r in readers.works_by_doi(df).collect()] == [("10.1/a", "W1")]
    pages = spark.createDataFrame([(1, 200, [("r1", "t", 1, "d"), (None, "x", 2, "")]), (1, 200, [("r2", "t", 1, "d")]), (2, 404, [])], "k int, http_status int, data array<struct<id:string,title:string,year:int,doi:string>>")
    seen, report = readers.reference_pages(pages, spark.createDataFrame([(1, 3), (2, 5)], "k int, reference_count long"), "k")
    got = {r.k: (r.pages, r.records, r.without_id, r.reference_status, r.count_differs) for r in report.collect()}
    assert seen.count() == 3 and got == {1: (2, 3, 1, "complete_api_pagination", False), 2: (1, 0, 0, "incomplete_http_404", True)}


def test_prose(spark):
    rows = [("text", "before"), ("heading", "Abstract"), ("text", "Real prose."), ("text", "123 456"), ("text", "12 May 2020"), ("heading", "References"), ("text", "A ref"), ("heading", "Model"), ("table", "x")]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "d int, ord int, kind string, text string")
    got = [r.reason for r in readability.prose_blocks(df, "d", "ord").orderBy("ord").collect()]
    assert got == ["before_start", "heading", "", "no_letters", "date", "heading", "excluded_section", "heading", "not_text"]


def test_labels_and_names(spark):
    x = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 2, "c")], "solution string, cluster int, key string")
    provenance.validate_labels(x, "solution", "cluster", "key")
    with pytest.raises(contracts.ContractError):
        provenance.validate_labels(x.filter("cluster > 1"), "solution", "cluster", "key")
    with pytest.raises(contracts.ContractError):
        provenance.validate_labels(x.union(x.limit(1)), "solution", "cluster", "key")
    a = provenance.input_fingerprint(spark.createDataFrame([(1, [0.5]), (2, [0.25])], "k int, embedding array<float>"), "k").first()
    b = provenance.input_fingerprint(spark.createDataFrame([(2, [0.25]), (1, [0.5])], "k int, embedding array<float>"), "k").first()
    assert a == b and a.vectors == 2
    prints = provenance.membership_fingerprints(x, "cluster", "key")
    choices = prints.select("cluster", "fingerprint").join(x.filter("cluster = 2").select("cluster", "key"), "cluster")
    review.validate_choices(choices, x)
    with pytest.raises(contracts.ContractError):
        review.validate_choices(choices, x.filter("key <> 'c'"))


def test_vector_runs(spark):
    papers = spark.createDataFrame([("a",), ("b",)], "k string")
    good = spark.createDataFrame([("a", [1.0, 0.0], 5), ("b", [0.0, 1.0], 7)], "k string, embedding array<double>, token_count int")
    vectors.validate_run(good, papers, "k", 2, limit=10)
    for bad, size, limit in ((good.limit(1), 2, 10), (good, 3, 10), (good, 2, 6), (good.withColumn("embedding", F.array(F.lit(2.0), F.lit(0.0))), 2, 10), (good.union(good), 2, 10)):
        with pytest.raises(contracts.ContractError):
            vectors.validate_run(bad, papers, "k", size, limit=limit)


def test_small_tables(spark):
    s = spark.createDataFrame([("k3", "kmeans", 3), ("k4", "kmeans", 4), ("l3", "leiden", 3)], "solution string, method string, k int")
    assert {tuple(r) for r in agreement.compare_solutions(s).collect()} == {("k3", "k4", "adjacent_counts"), ("k3", "l3", "same_count")}
    e = spark.createDataFrame([(1, 2)], "src int, dst int")
    got = {tuple(r) for r in linkage.add_manual_edges(e, spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")).collect()}
    assert got == {(1, 2, "provider"), (2, 3, "manual")}
    df = spark.createDataFrame([(i,) for i in range(50)], "k long")
    assert selection.reproducible_sample(df, "k", 5).collect() == selection.reproducible_sample(df.orderBy(F.desc("k")), "k", 5).collect()
    assert screening.presence_comparison(df, F.col("k") < 10, F.col("k") < 5).first().asDict() == {"both": 5, "first_only": 5, "second_only": 0, "neither": 40}
    seg = spark.createDataFrame([(1, 0, [("b", 4), ("c", 2)])], "d int, segment int, sources array<struct<block_id:string,page:int>>")
    assert tuple(documents.section_report(seg, "d").first()) == (1, 0, 2, 4, 2)
    assert [tuple(r) for r in writers.formatted(spark.createDataFrame([(1, 0.5, None), (2, None, "x")], "a int, b double, c string"), 3).collect()] == [("1", "0.500", ""), ("2", "", "x")]


def test_graph_tables(spark, tmp_path):
    nodes, edges = spark.createDataFrame([(9,), (3,), (5,)], "node long"), spark.createDataFrame([(3, 9)], "src long, dst long")
    writers.graph_tables(nodes, edges, str(tmp_path))
    assert [tuple(r)[2:] for r in spark.read.parquet(f"{tmp_path}/edges").select("src", "dst", "row", "column").collect()] == [(0, 2)]
    assert graphs.graph_summary(nodes, edges).first().isolates == 1


def test_notices_and_placeholders(spark):
    from corpusatlas.functions import text as T

    notice = "Apart from any fair dealing for the purposes of research or private study, as the Copyright, Designs and Patents Act 1988 says."
    cases = {"(a) one, (b) two and (c) three results.": ("(a) one, (b) two and (c) three results.", ""), "a <b and c> d": ("a d", ""), "x <.001 y": ("x <.001 y", ""), "n/a": ("", ""), "NULL": ("", ""), notice: ("", notice), "Fine. Copyright 2020 P": ("Fine.", "Copyright 2020 P"), "copyrights matter": ("copyrights matter", ""), "One<br/>two<jats:p>three": ("One two three", "")}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.clean_abstract(F.col("t")).alias("c"))
    assert {r.t: tuple(r.c) for r in df.collect()} == cases
    assert spark.createDataFrame([("P &lt;.05 e\u0301",)], "t string").select(T.clean_abstract(F.col("t"), decoded=False).alias("c")).first().c.text == "P <.05 \u00e9"


def test_names_previews_and_titles(spark):
    from corpusatlas.functions import text as T

    names = {"a/Lee - 1999 - One - two.pdf": ("One - two", 1999), "Lee - 1899 - Old.pdf": (None, None), "Plain.pdf": (None, None), "X - 2001 - A - 2002 - B.pdf": ("A - 2002 - B", 2001)}
    got = spark.createDataFrame([(k,) for k in names], "n string").select("n", T.title_and_year(F.col("n")).alias("x")).collect()
    assert {r.n: tuple(r.x) for r in got} == names
    blocks = spark.createDataFrame([([("b1", "Text", 2, "Hello"), ("b2", "Title", None, None)],)], "b array<struct<id:string,type:string,page:int,text:string>>")
    assert blocks.select(T.preview(F.col("b")).alias("p")).first().p == "[page 2 | Text | b1]\nHello\n\n[page ? | Title | b2]\n"
    titles = {"\u00c9tude & Co._x": "etude and co x", "Stra\u00dfe \ufb01n": "strasse fin", None: ""}
    got = spark.createDataFrame([(k,) for k in titles], "t string").select("t", T.normalize_title(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == titles


def test_mentions_count_hyphenated_words_once(spark):
    from corpusatlas.operators import screening

    df = spark.createDataFrame([(1, "a well-known firm's PE fund and PE")], "k long, t string")
    assert [(r.mention, r.word_index, r.words) for r in screening.mentions(df, "k", "t", "PE").orderBy("mention").collect()] == [(1, 3, 7), (2, 6, 7)]


def test_preparation_and_selection(spark):
    from corpusatlas.contracts import ContractError
    from corpusatlas.operators import documents, linkage, provenance

    docs = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "k long, text string")
    with pytest.raises(ContractError):
        documents.prepare_corpus(docs, "k")
    kept, audit = documents.prepare_corpus(docs, "k", skip_empty=True)
    assert [r.k for r in kept.collect()] == [1] and {r.k: r.status for r in audit.collect()} == {1: "prepared", 2: "skipped_empty", 3: "skipped_empty"}
    assert documents.prepare_corpus(docs.filter("k = 1"), "k")[1].first().plan_id == audit.first().plan_id
    assert documents.checked_selection(docs.select("k").filter("k < 3"), docs, "k", 3).count() == 2
    for bad in (dict(selected=docs.select("k").unionByName(docs.select("k"))), dict(selected=spark.range(9, 10).toDF("k")), dict(selected=docs.select("k"), count=5)):
        with pytest.raises(ContractError):
            documents.checked_selection(**{"available": docs, "key": "k"} | bad)
    papers = spark.createDataFrame([(1, 1, "t"), (2, 2, "u")], "k long, o long, q string")
    saved = papers.withColumns({"approved": F.col("k") == 1, "match_doi": F.lit("d"), "match_title": F.lit("m")})
    assert {r.k: (r.approved_doi, r.approved_title) for r in linkage.reuse_approved(papers, saved, "k", "o", ["q"]).collect()} == {1: ("d", "m"), 2: ("", "")}
    with pytest.raises(ContractError):
        linkage.reuse_approved(papers, saved.withColumn("o", F.col("o") + 1), "k", "o", ["q"])
    labels = spark.createDataFrame([(1, 1, 1), (2, 2, 2)], "k long, o long, cluster long")
    record = provenance.membership_fingerprints(labels, "cluster", "k")
    assert provenance.adopt_labels(papers, labels, record, "k", "cluster", "o").count() == 2
    with pytest.raises(ContractError):
        provenance.adopt_labels(papers, labels, record.withColumn("fingerprint", F.lit("x")), "k", "cluster", "o")
    run = spark.createDataFrame([("m", 8, ["a", "b"])], "model string, batch int, files array<string>")
    assert provenance.same_settings(run, run.withColumn("batch", F.lit(4)), ["model"], "files").count() == 1
    with pytest.raises(ContractError):
        provenance.same_settings(run, run.withColumn("batch", F.lit(4)), ["model", "batch"])


def test_page_mentions_against_search(spark):
    import random

    from corpusatlas.operators import linkage

    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["ab", "cd", "e", "fg", "the"]) for _ in range(n))
    pages = [(i, say(60)) for i in range(30)] + [(99, None)]
    titles = [(i, say(rng.randint(1, 7))) for i in range(60)] + [(98, "b cd e f")]
    got = linkage.page_mentions(spark.createDataFrame(pages, "page_id long, page_key string"), spark.createDataFrame(titles, "title_id long, title_key string"))
    want = {(p, t) for p, x in pages for t, k in titles if x and len(k.split()) >= 4 and k in x}
    assert {(r.page_id, r.title_id) for r in got.collect()} == want and want


def test_leaves_lie_side_by_side():
    import numpy as np
    from corpusatlas.operators import cluster

    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 3))
    merges = cluster.average_linkage(np.linalg.norm(x[:, None] - x[None], axis=2))
    at = cluster.leaf_order(merges, 30)
    assert sorted(at) == list(range(30)) and list(cluster.leaf_order(np.empty((0, 4)), 1)) == [0]
    members = {i: [i] for i in range(30)}
    for k, (a, b, *_) in enumerate(merges):
        members[30 + k] = members[int(a)] + members[int(b)]
        places = sorted(at[m] for m in members[30 + k])
        assert places == list(range(places[0], places[0] + len(places)))

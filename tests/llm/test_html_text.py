import functools
import math
import random
from collections import Counter, defaultdict

from corpusatlas.llm.html_text import ROOT, Tree, extract, importance, main_text, noise_paths, path_id, walk


def at(path):
    return functools.reduce(path_id, path.strip("/").split("/"), ROOT)


def test_main_text_rules():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <nav><a href=/>Menu</a></nav><header>Top</header><div class="ad">Buy</div><div id="cookie-notice">Cookies</div>
    <article><header><h1>Head &amp; line</h1></header><p>One  two<br>three <b>four</b><p>Five &lt;six&gt; &copy;
    <aside>Related</aside><form><input value=x>Send</form><ul><li>a<li>b</ul><table><tr><td>x<td>y</table>
    <section class="comments"><p>First!</p></section></article><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "Head & line\n\nOne two three four\n\nFive <six> ©\n\na\n\nb\n\nx\n\ny"


def test_main_text_edges():
    assert main_text(None) == main_text("") == main_text("<p> </p>") == ""
    assert main_text("plain") == "plain"
    assert main_text("<p>a<p>b") == "a\n\nb"
    assert main_text("a < b <b>c") == "a < b c"
    assert main_text("<script>x") == ""
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert len(main_text("<p>" + "w " * 200_000)) == 399_999


def pages(n, host="h.example"):
    return [(i, f"http://{host}/p{i}", f"<html><body><div class=x>Same words here</div><div class=y><p>Own words {i} {i * 7}</p><p>More {i * i}</p></div></body></html>") for i in range(n)]


def test_style_tree_removes_what_pages_repeat(spark):
    df = spark.createDataFrame(pages(12) + [(100, None, None), (101, "http://other.example/", "<div class=x>Same words here</div>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert len(got) == 14
    assert got[3] == "Own words 3 21\n\nMore 9"
    assert got[100] == "" and got[101] == "Same words here"


def test_importance_values(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pages(9), "page_id long, url string, html string").select(F.lit("h").alias("host"), F.xxhash64("html").alias("page"), "html")
    x = {r.path: r for r in importance(df).collect()}
    same, own = x[at("/html/body/div.x")], x[at("/html/body/div.y/p")]
    assert abs(same.content) < 1e-9 and abs(same.composite) < 0.2
    assert own.content > 0.9 and own.pages == 9


def plain_importance(pages, gamma=0.9):
    """The definitions written out over one host's pages: entropies over dictionaries."""
    styles, texts, above, having = defaultdict(Counter), defaultdict(Counter), {}, defaultdict(set)
    for k, source in enumerate(dict.fromkeys(pages)):
        seen = set()
        for node, _ in walk(Tree(source).root):
            if node.unread:
                continue
            having[node.path].add(k)
            tags = [c.tag for c in node.children if not isinstance(c, str)]
            seen.add(("s", node.path, tuple(t for i, t in enumerate(tags) if not i or t != tags[i - 1])))
            if text := " ".join("".join(c for c in node.children if isinstance(c, str)).split()):
                seen.add(("t", node.path, text))
            line, n = [], node
            while n.parent:
                line.append(n.path)
                n = n.parent
            above[node.path] = line
        for kind, path, value in seen:
            (styles if kind == "s" else texts)[path][value] += 1
    under = defaultdict(list)
    for path, values in texts.items():
        m = len(having[path])
        for c in values.values():
            for up in above[path]:
                under[up] += [math.log(c) / math.log(m) if m > 1 else 0.0] * c
    out = {}
    for path, values in styles.items():
        m = len(having[path])
        shown = -sum(c / m * math.log(c / m) for c in values.values()) / math.log(m) if m > 1 else 1.0
        content = 1 - sum(under[path]) / len(under[path]) if under[path] else shown
        share = gamma ** len(values)
        out[path] = (m, (1 - share) * shown + share * content)
    return out


def test_importance_against_plain(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(40)}"
    made = ["<html><body><nav><ul><li>Home<li>News</ul></nav><div class=box>" + "".join(rng.choice(["<p>{}</p>", "<div class=x><b>{}</b></div>", "<h2>{}</h2>", "<p class=q>same</p>{}"]).format(word()) for _ in range(rng.randrange(1, 7))) + "</div><footer>Imprint</footer></body></html>" for _ in range(25)]
    made.append(made[0])
    df = spark.createDataFrame([(h,) for h in made], "html string").select(F.lit("h").alias("host"), F.xxhash64("html").alias("page"), "html")
    got, want = {r.path: r for r in importance(df).collect()}, plain_importance(made)
    assert got.keys() == want.keys()
    assert all(got[p].pages == m and abs(got[p].composite - v) < 1e-9 for p, (m, v) in want.items())


def test_importance_removes_furniture_that_no_list_names(spark):
    """Menus and imprints as plain divs, and unmarked ones beside the article's own text: only the tree can tell."""
    make = lambda i: f"<html><body><div><a>Home</a><a>News</a></div><section><p>Own text {i} {i * 7}</p><div>Read this first</div><p>More {i * i}</p></section><div>All rights</div></body></html>"
    df = spark.createDataFrame([(i, "http://h.example/", make(i)) for i in range(12)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract(df).collect()} == {i: f"Own text {i} {i * 7}\n\nMore {i * i}" for i in range(12)}
    assert extract(df, min_pages=99).first().text.startswith("HomeNews\n\nOwn text")


def test_furniture_counts_in_the_tree(spark):
    from pyspark.sql import functions as F

    make = lambda i: f"<html><body><nav><a>Home</a></nav><article><p>Own {i}</p></article><footer>Imprint</footer></body></html>"
    df = spark.createDataFrame([(make(i),) for i in range(9)], "html string").select(F.lit("h").alias("host"), F.xxhash64("html").alias("page"), "html")
    noise = set(noise_paths(df).first().noise)
    assert {at("/html/body/nav"), at("/html/body/nav/a"), at("/html/body/footer")} <= noise and at("/html/body/article/p") not in noise


def test_lenient_tokens():
    inside = lambda x: main_text(f"<body><article>{x}</article><p>out</p></body>")
    assert inside('<p>a</p><svg class="i"/><p>b</p>') == inside("<p>a</p><iframe src=x /><p>b</p>") == "a\n\nb"
    assert "b" in inside("<p>a</p><select><option>x<p>b</p>") and "b" in inside("<p>a</p><object data=x><p>b</p>")
    assert inside("<p>a</p><select><option>x</select><p>b</p>") == "a\n\nb"
    assert inside("<p>a</p><script>var x = 1 < 2;<p>b</p>") == inside("<p>a</p><style>p{}<p>b</p>") == "a\n\nb"
    assert inside("<p title=it's>Hello</p><p>x</p><p>it's</p>") == "Hello\n\nx\n\nit's"
    assert inside('<p title="5" tall">Hello</p>') == "Hello"
    assert inside('<p title="a > b" class=\'c>d\'>Hello</p>') == "Hello"
    assert inside('<div class="entry-header"><h2>Head</h2></div><p class="share">Share of votes</p>') == "Head\n\nShare of votes"
    assert inside('<div class="share-buttons"><p>Tweet</p></div><p>x</p>') == "x"
    assert inside("<p>let <math><mi>x</mi></math> be</p>") == "let x be"
    assert main_text("<head><title>t</title><p>a") == "a"
    assert main_text("<script>" * 20_000 + "<p>end") == "end" and main_text("<select>" * 5000 + "<p>end") == "end"
    assert main_text("<p a=b " * 20_000).count("<") >= 0


def test_copies_of_a_page_do_not_count(spark):
    df = spark.createDataFrame([(i, "http://h/", "<p>Only page</p>") for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in extract(df).collect()} == {"Only page"}


def test_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "http://h/", "<p>x</p>", "mine", "host")], "page_id long, url string, html string, text string, __host string")
    row = extract(df).first()
    assert row.text == "x" and row["__host"] == "host"
    assert extract(df.filter("page_id = 2")).count() == 0


def test_deep_articles_stay(spark):
    from pyspark.sql import functions as F

    # the wrapper's layout is the same on all pages, and its texts stand deeper than 24 elements
    deep = lambda i: "<div class=w-1/2>" * 30 + f"<p>Own words {i} {i * 7}</p>" + "</div>" * 30
    html = [(i, f"http://h.example/p{i}", f"<html><body><main><section><div class=x>Same words here</div>{deep(i)}</section></main></body></html>") for i in range(12)]
    df = spark.createDataFrame(html, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract(df).collect()} == {i: f"Own words {i} {i * 7}" for i in range(12)}
    x = {r.path: r.content for r in importance(df.select(F.lit("h").alias("host"), F.xxhash64("html").alias("page"), "html")).collect()}
    assert x[path_id(at("/html/body/main/section"), "div.w-1/2")] > 0.9 and len(x) == 37  # root, html, body, main, section, div.x, 30 wrappers, p

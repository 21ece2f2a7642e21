import random

import __spark_entry__ as entry


def small_tables(spark, folder):
    """documents, labels, benchmark, pages and conversations with planted cases."""
    rng = random.Random(11)
    word = lambda: rng.choice(["ba", "ko", "mi", "tu"]) + rng.choice(["ra", "ne", "so", "li"]) + rng.choice(["l", "n", "st", "", "mo"])
    docs, labels = [], []
    for i in range(300):
        w = [word() for _ in range(80)]
        if i % 10 == 0:
            for bad in ("grumbolt", "snarfle", "wretchy", "grumbolt"):
                w[rng.randrange(80)] = bad
        docs.append((i, " ".join(w), "aa", f"src{i % 3}", 0))
        labels.append((i, 1, int(i % 10 == 0)))
    docs += [(700, docs[1][1], "aa", "src0", 0), (901, "12345 !!!", "aa", "src0", 0)]
    item = " ".join(f"bench{i}" for i in range(20))
    docs += [(800, item + " tail", "aa", "src1", 0), (801, " ".join(word() for _ in range(600)) + " " + item, "aa", "src1", 0)]
    frames = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, item)], "item_id long, text string"),
        "pages": ([(i, f"http://h{i % 2}/", f"<article><p>{i}</p></article><footer>f</footer>") for i in range(20)], "page_id long, url string, html string"),
        "conversations": ([(i // 2, i % 2, ["user", "assistant"][i % 2], f"t{i}") for i in range(20)], "conv_id long, turn long, role string, text string"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_query_runs(spark, tmp_path):
    d = small_tables(spark, tmp_path)
    queries = entry.queries()
    own = [n for n in queries if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in own) == list(range(1, 11)) and "pipeline" in queries
    rows = {n: queries[n](spark, d).count() for n in own}
    documents = spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(rows[n] == documents for n in own if n.split("_")[0] in ("op2", "op3", "op4", "op5", "op7", "op8", "op10"))
    assert rows["op1_html_extraction"] == 20 and rows["op9_chat_formatting"] == 11

"""Cases in which a part of the job used to be left out."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_brute import rooted, shingles

from redsieve.llm import lines, minhash, queries, urls


def test_minhash_of_few_shared_passages(spark):
    rng = np.random.default_rng(4)
    passages = [" ".join(f"p{p}w{i}" for i in range(12)) for p in range(30)]
    docs = {d: " ".join(passages[p] for p in sorted(rng.choice(30, 20, replace=False))) for d in range(1200)}
    sets = {d: shingles(t) for d, t in docs.items()}
    at = {x: i for i, x in enumerate(sorted(set().union(*sets.values())))}
    held = np.zeros((len(docs), len(at)), np.float32)
    for d, s in sets.items():
        held[d, [at[x] for x in s]] = 1
    both = held @ held.T
    n = held.sum(axis=1)
    links = np.argwhere(np.triu(100 * both >= 75 * (n[:, None] + n - both), 1)).tolist()
    assert len(links) > 20
    roots = rooted(docs, links)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == roots


def test_urls_of_any_depth(spark):
    deep = "a/b/c/d/e/f"
    rows = [(1, "x://a.b.c.d.e.f.example.org/"), (2, f"x://example.net/{deep}/g/h?q"), (3, f"x://www.a.b.c.d.e.f.g.example.net/{deep}"), (4, "x://example.net/a/b/c/d/e"), (5, "x://notexample.org/"), (6, "x://y.one/z"), (7, f"x://example.net/{deep}x"), (8, "x://m.listed.example/A//b/c.html"), (9, "x://listed.example:1/A/b"), (10, "x://nowhere.org/z")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("example.org/",), (f"example.net/{deep}/",), ("one/",), (None,), ("nowhere.org",), ("HTTPS://www.Listed.Example:8080/A//b/?q#f",)], "entry string")
    out = {r.page_id: r.verdict for r in urls.judge(pages, listed, rules=()).collect()}
    assert out == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "block", 9: "allow", 10: "block"}


def test_short_lines_by_exact_copies(spark, tmp_path):
    long = "one line that is long enough to count"
    rows = [(1, f"Share\n\n{long}\nOK"), (2, f"Share\n\n \n{long}!\nOk\nShare"), (3, "Share\nOK"), (4, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = {(r.doc_id, r.line_no): ((r.class_doc_id, r.class_line_no), r.n_links, r.kept) for r in queries.op8_lines(spark, str(tmp_path)).collect()}
    first, ok, whole = (1, 0), (1, 3), (1, 2)
    assert out == {
        (1, 0): (first, 0, True), (1, 2): (whole, 1, True), (1, 3): (ok, 0, True),
        (2, 0): (first, 0, False), (2, 3): (whole, 1, False), (2, 4): ((2, 4), 0, True), (2, 5): (first, 0, False),
        (3, 0): (first, 0, False), (3, 1): (ok, 0, False),
    }
    assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()} == {1: rows[0][1], 2: "\n \nOk", 4: " \n"}


def test_null_ids_and_repeats_are_no_product(spark):
    texts = [" ".join(f"d{d}w{i}" for i in range(30)) for d in range(40)]
    rows = [(None, t) for t in texts] + [(None, f"{t} more") for t in texts[:10]] + [(7, texts[0])] * 50
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert len(out) == len(rows) and len({r.root for r in out}) == 40
    assert sum(r.component_id == 7 for r in out) == 52


def test_stages_keep_clashing_columns(spark, tmp_path):
    text = "one line that is long enough to count\nand another one of many words in a row"
    rows = [(1, text, "s", 5, 0.25, "k", None), (1, text, "s", 5, 0.5, "k", None), (2, None, None, 0, 0.5, None, None), (3, "", "s", 0, 0.5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, score double, key string, row map<string,int>")
    docs = docs.withColumns({c: F.lit(1) for c in ("gone", "t", "of", "d", "n", "size", "kept", "root", "line_no", "quality", "lang")})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = stage(spark, docs, str(tmp_path))
        assert docs_after.columns == docs.columns
        assert {r.score for r in docs_after.collect()} <= {0.25, 0.5}
        docs = docs_after
    assert sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id == 1) == [(1, text)]


def test_near_duplicates_go_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "s"), (1, a, "s"), (1, b, "s"), (2, f"{a} more", "s"), (None, f"{b} more", "s"), (None, c, "s"), (None, f"{c} more", "s"), (3, None, "s"), (3, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted((x for x in got if x[0] == 1), key=repr) == [(1, a), (1, b)]
    nulls = [x for x in got if x[0] is None]
    assert len(nulls) == 1 and nulls[0][1] in (c, f"{c} more")
    assert got.count((3, None)) == 2 and len(got) == 5

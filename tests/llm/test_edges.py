"""Every operator on nulls, empty and long texts, repeated rows, empty tables and columns with clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from redsieve.llm import ann, bpe, chat, covertree, lines, minhash, mixing, pii, quality, urls

LONG = " ".join(f"word{i % 977} x{i}" for i in range(40_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near mail a.b@c.de now", "en", "s1", 10),
    (2, None, "en", "s1", 0),
    (3, "", None, None, 0),
    (4, LONG, "en", "s2", len(LONG)),
    (5, "one line that is long enough to count\nshort", "en", "s2", 1),
    (5, "one line that is long enough to count\nshort", "en", "s2", 1),
    (None, "one line that is long enough to count", None, "s1", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators use inside.
CLASH = ("size", "key", "score", "h", "t", "n", "k", "label")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("op", [pii.report, bpe.digest, mixing.mix_plan, minhash.near_duplicates, lines.line_classes, lines.dedup_lines, mixing.mix, pii.sanitise], ids=lambda f: f.__name__)
def test_empty_table(empty, op):
    assert op(empty).count() == 0


@pytest.mark.parametrize("op", [pii.report, bpe.digest, mixing.mix_plan, minhash.near_duplicates], ids=lambda f: f.__name__)
def test_a_row_for_each_row(docs, op):
    assert op(docs).count() == len(ROWS)


def test_minhash_defined_results(docs):
    rows = {(r.doc_id, r.n_shingles): r for r in minhash.near_duplicates(docs).collect()}
    assert rows[2, 0].kept and rows[2, 0].component_id == 2
    assert rows[3, 0].component_id == 3
    assert rows[5, 5].component_id == 5
    assert not rows[None, 4].kept


def test_bpe_null_and_empty_have_no_tokens(docs):
    rows = {r.doc_id: r for r in bpe.digest(docs).collect()}
    assert rows[2].n_tokens == rows[3].n_tokens == 0
    assert rows[4].n_tokens > 80_000


def test_pii_defined_results(docs):
    rows = {r.doc_id: r for r in pii.report(docs).collect()}
    assert (rows[1].n_email, rows[1].spans) == (1, "email:54:62")
    assert rows[2].base_sha256 == rows[3].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert "[EMAIL]" in {r.doc_id: r.text for r in pii.sanitise(docs).collect()}[1]
    assert pii.sanitise(docs).columns == docs.columns


def test_pii_repeated_rows_count_each(spark):
    rows = [(i, f"Zorblax of {'abcdefghij'[i]}eta wrote to x.y@corp.example and left Quuxville") for i in range(3)] + [(9 + i, f"nothing here but matter {'abcdefghij'[i]}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    once = {r.doc_id: r.spans for r in pii.report(df).collect()}
    # the first and the last word of a text are terms too
    assert all("term:0:7" in once[i] and once[i].split(",")[-1].startswith("term:") for i in range(3))
    thrice = df.unionByName(df).unionByName(df)
    rows = pii.report(thrice).collect()
    assert len(rows) == 3 * len(once) and all(r.spans == once[r.doc_id] for r in rows)


def test_mixing_defined_results(docs):
    rows = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    assert rows[3].source_size == 0 and rows[3].target == 0 and rows[3].taken == 0
    assert rows[2].size == 0
    assert all(r.taken <= 2 * r.size for r in rows.values())
    assert mixing.mix(docs).columns == docs.columns


def test_mixing_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {r.target for r in mixing.mix_plan(df).collect()} == {0.0}


def test_mixing_by_a_weight_of_ones_own(spark):
    rows = [(i, "some words here", "a", float(i % 2)) for i in range(2000)] + [(5000 + i, "others", "b", None) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, w double").withColumn("key", F.lit(1)).withColumn("row", F.lit(2))
    out = mixing.mix(df, F.col("w"))
    assert out.columns == df.columns
    heavy, light = (out.where(f"source = 'a' and w = {w}").count() for w in (1, 0))
    assert heavy > 1.05 * light


def test_lines_defined_results(docs):
    out = {(r.doc_id, r.text) for r in lines.dedup_lines(docs).collect()}
    # the null id comes first, so its copy of the line stays
    assert (None, ROWS[6][1]) in out
    assert (5, "short") in out
    assert (2, None) in out and (3, "") in out
    assert lines.dedup_lines(docs).columns == docs.columns


def test_quality_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    assert {r.score for r in quality.score(docs.drop("score"), model).collect()} == {0.5}


def test_quality_samples_labels_that_have_a_text(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 30)
    docs = spark.createDataFrame([(i, f"good words flow on here {i} and there" if i % 2 else f"%%% $$$ {i} ###") for i in range(200)], "doc_id long, text string")
    labels = spark.range(200_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    rows = quality.score(docs, quality.learn(docs, labels)).collect()
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in rows)


def test_quality_learns_little(spark):
    rows = [(i, f"good words flow on here {i} and there" if i % 2 else f"%%% $$$ {i} ###", i % 2) for i in range(40)] + [(99, None, 1), (98, "", 0)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    out = quality.score(spark.createDataFrame([(1, "good words flow on there"), (2, None)], "doc_id long, text string"), model).collect()
    assert all(0 <= r.score <= 1 for r in out)


VECTORS = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, [None, 1.0], 0), (7, [0.0, 3.0], None), (7, [0.0, 3.0], 1), (20, [1.0, 0.1], 0), (40, [float("inf"), 1.0], 0), (9, [1.0, 0.0, 0.0], 0), (None, [0.0, 1.0], 0)]


def test_vectors_defined_results(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").withColumn("c", F.lit(1)).withColumn("node", F.lit(1))
    rows = covertree.near_vectors(df).collect()
    assert len(rows) == len(VECTORS)
    by = {r.vec_id: r for r in rows}
    assert by[1].n_links == 2 and by[2].component_id == 1 and by[20].component_id == 1 and not by[20].kept
    assert all(by[i].n_links == 0 and by[i].kept for i in (3, 4, 5, 6, 40, 9))
    assert by[7].n_links == 2 and by[7].kept and not by[None].kept


def test_vectors_of_any_size(spark):
    rows = [(i, [1.0, i / 1000]) for i in range(40)] + [(100, [1e-200, 0.0]), (101, [0.0, 5e-324]), (102, [1e300, 1e300]), (103, [2e-310, 2e-310])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    by = {r.vec_id: r for r in covertree.near_vectors(df).collect()}
    assert all(by[i].n_links == 40 and by[i].component_id == 0 for i in (*range(40), 100))
    assert by[101].n_links == 0 and by[102].n_links == by[103].n_links == 1 and by[103].component_id == 102
    near = ann.nearest(df, 100).collect()
    assert [(r.vec_id, r.rank) for r in near if r.query_id == 0][:2] == [(102, 1), (1, 2)] and len(near) == 40


def test_ann_gets_all_candidates_and_is_steady(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(13)] + [(0, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df).collect()]
    assert len(got) == 12 and {r[0] for r in got} == {0}
    assert sorted(got) == sorted(tuple(r) for r in ann.nearest(df.orderBy(F.rand(3))).collect())


def test_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert covertree.near_vectors(df).count() == 0
    assert ann.nearest(df).count() == 0


def test_ann_defined_results(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int")
    rows = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df).orderBy("rank").collect()]
    assert rows[:2] == [(20, 1, 2, 2.0), (20, 2, 1, 1.0)]
    assert [r[2] for r in rows[2:]] == [7, 7]


def test_urls_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://WWW.Bad.Example.NET:80/a/b/?q"), (5, "x://a.org/"), (6, "x://y.example.org/en/12#z"), (6, "x://y.example.org/en/12#z"), (7, "x://com"), (8, "x://fine.net/\nnext")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("z")).withColumn("entry", F.lit("z"))
    listed = spark.createDataFrame([("bad.example.net/a/",), (None,), ("://",), ("",)], "entry string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, listed).collect()}
    assert out[1] == out[2] == out[3] == ("", "", None, "allow")
    assert out[4] == ("www.bad.example.net:80", "/a/b/", None, "block")
    assert out[5] == ("a.org", "/", "org/", "allow")
    assert out[6] == ("y.example.org", "/en/12", "example.org/en/1", "block")
    assert out[7] == ("com", "", None, "allow")
    assert out[8] == ("fine.net", "/\nnext", None, "allow")
    assert urls.judge(pages, listed).count() == len(rows)
    assert urls.judge(pages.limit(0), listed).count() == 0
    assert urls.judge(pages, listed.limit(0)).where("verdict = 'block' and rule is null").count() == 0


def test_chat_defined_results(spark):
    rows = [(1, 0, "user", "hi \\ </turn> ### x"), (1, 1, "assistant", None), (2, None, None, "a"), (None, 1, "user", "u"), (None, 2, "assistant", "v" * 500_000), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (4, 0, "us\\er: ###", "\\n:\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(3))
    segments = chat.format_conversations(df)
    out = {r.conv_id: r for r in chat.read_back(segments).collect()}
    assert {c: r.n_turns for c, r in out.items()} == {1: 2, 2: 1, None: 2, 3: 2, 4: 1}
    assert out[1].valid and out[None].valid and not out[2].valid and not out[3].valid
    assert out[None].loss_chars == 500_000
    t = chat.Template()
    for r in segments.collect():
        if r.part == "text":
            assert "</turn>" not in r.text and "###" not in r.text
        if r.part == "open":
            assert r.text.startswith("### ") and r.text.count("###") == 1
    for text in ("", "\\", "\\\\", "###", "####</turn></turn>", "\\### Assistant: </turn> ok", "a\nb"):
        assert t.unescaped(t.escaped(text)) == text
    for role in ("user", "", "a: b", "\\: ###"):
        for text in ("", "\\", "</turn>", "</turn>\n", "### x: y", "\\</turn>\n\\"):
            emitted = t.opening(role) + t.escaped(text) + t.close
            assert t.turn_of(emitted + "### ") == (role, text, "### ")
            assert t.turn_of(emitted[:-1]) is None
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_large_ids_stay_exact_beside_nulls(spark):
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "a b c d e f", "s"), (None, "x y", "s"), (big + 2, "", None)], "doc_id long, text string, source string")
    for op in (bpe.digest, minhash.near_duplicates, mixing.mix_plan, pii.report):
        assert {r.doc_id for r in op(docs).collect()} == {big, None, big + 2}
    turns = spark.createDataFrame([(big, big, "user", "u"), (None, None, "user", "u")], "conv_id long, turn long, role string, text string")
    segments = chat.format_conversations(turns)
    assert {r.turn for r in segments.collect()} == {big, None}
    assert {r.conv_id for r in chat.read_back(segments).collect()} == {big, None}

import json
import re

import cli
import pytest
from pyspark.sql import functions as F

from redsieve.functions import rx
from redsieve.operators import evaluate, harvest, names
from redsieve.operators import redact as R
from redsieve.operators.structured import SPECS, RegexSpec
from redsieve.plans.config import RedactionConfig, parse_options, parse_types
from redsieve.sources import docx, synthetic
from redsieve.sources.sinks import audit_json, mapping_json, scrub_columns
from redsieve.streaming.redaction import counts_by_window, each_batch, redact_stream

CASES = {
    "Reach Mr. Rohan Dey at rohan.dey@gmail.com or +91 9876543210.": {("PERSON", "Rohan Dey"), ("EMAIL", "rohan.dey@gmail.com"), ("PHONE", "+91 9876543210")},
    "Call +91 9876543210.": {("PHONE", "+91 9876543210")},
    "Host is 192.168.1.14.": {("IP_ADDRESS", "192.168.1.14")},
    "SSN 452-11-8873 on file.": {("SSN", "452-11-8873")},
    "SSN 000-45-6789 and 666-45-6789 are structurally invalid identifiers.": set(),
    "Card 4539 1488 0343 6467 charged.": {("CREDIT_CARD", "4539 1488 0343 6467")},
    "Order 4532-1122-3344-5566 shipped.": set(),
    "Origin 203.0.113.42 logged.": {("IP_ADDRESS", "203.0.113.42")},
    "Build 999.999.999.999 failed.": set(),
    "Date of birth 14/03/1982 recorded.": {("DATE_OF_BIRTH", "14/03/1982")},
    "The board met on December 10, 2025.": set(),
    "Issued by SEBI under the Companies Act, 2013 and listed on BSE Limited.": set(),
    "Revenue was 4,200.00 million across 10,00,000 Equity Shares; see page 124.": set(),
    "The Escrow Collection Bank and the Refund Bank hold the Equity Share capital.": set(),
    "Managing Director and Compliance Officer attended.": set(),
    "Shares transferred from Shubhkamal Leasing and Investment Private Limited.": {("ORGANISATION", "Shubhkamal Leasing and Investment Private Limited")},
    "Our team includes Sandesh Bhagwat, Chief Executive Officer, and others.": {("PERSON", "Sandesh Bhagwat")},
    "having its Registered Office at 11/3, Village Birdewadi, Chakan Taluka - Khed, Pune - 410 501, Maharashtra, India.": {
        ("ADDRESS", "11/3, Village Birdewadi, Chakan Taluka - Khed, Pune - 410 501, Maharashtra, India")
    },
    "S. no. 245/ 104, Pushpakamal Society, lane no. 3 Prabhat Road, Pune - 411 004, Maharashtra": {
        ("ADDRESS", "S. no. 245/ 104, Pushpakamal Society, lane no. 3 Prabhat Road, Pune - 411 004, Maharashtra")
    },
    "": set(),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(t,) for t in CASES] + [(None,)], "text string")
    return {r.text: r for r in R.redact(df).collect()}


@pytest.mark.parametrize("text", list(CASES))
def test_detection(found, text):
    assert {(s.pii_type, s.text) for s in found[text].spans} == CASES[text]


def test_spans_are_apart_and_in_order(found):
    for r in found.values():
        assert all(a.end <= b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
        assert all(r.text[s.start : s.end] == s.text for s in r.spans)


def test_text_without_spans_stays(found):
    assert all(r.redacted == r.text for r in found.values() if not r.spans)
    assert found[None].redacted is None


def test_no_comma_is_crossed(spark):
    df = spark.createDataFrame([("Alpha Family Trust, Beta Family Trust and Gamma Family Trust.",)], "text string")
    assert all("," not in s.text for s in R.detect(df).first().spans)


def test_names_are_shared_within_a_scope_only(spark):
    df = spark.createDataFrame([(1, "Mr. Kiran Talwar came."), (1, "Then KIRAN TALWAR left."), (2, "Then Kiran Talwar left.")], "doc long, text string")
    out = [(r.doc, [s.text for s in r.spans]) for r in R.detect(df, scope="doc").orderBy("doc", "text").collect()]
    assert out == [(1, ["Kiran Talwar"]), (1, ["KIRAN TALWAR"]), (2, [])] or out == [(1, ["Mr. Kiran Talwar"]), (1, ["Then KIRAN TALWAR"]), (2, [])]


def test_header_labels_are_no_names(spark):
    rows = [("d", "Weighted Cost", "x | Managing Director", True), ("d", "Weighted Cost", "x | Managing Director", False), ("d", "Anil Kulkarni", "Name | Managing Director", False)]
    df = spark.createDataFrame(rows, "scope string, text string, context string, is_header boolean")
    assert {r.name for r in harvest.person_names(df).collect()} == {"Anil Kulkarni"}


def test_types_are_filtered_before_resolution(spark):
    text = "Goods at Plot 4, Sector 5, Alpha Steel Private Limited, Pune - 411 004"
    df = spark.createDataFrame([(text,)], "text string")
    assert {s.pii_type for s in R.detect(df).first().spans} == {"ADDRESS"}
    assert {s.pii_type for s in R.detect(df, config=RedactionConfig(types=("ORGANISATION",))).first().spans} == {"ORGANISATION"}


def test_a_recogniser_of_ones_own(spark):
    spec = RegexSpec("PassportRecognizer", "PASSPORT", r"\b[A-Z]\d{7}\b", 0.9, gate=("passport",))
    df = spark.createDataFrame([("passport K1234567, bin K7654321" + " " * 80 + "K1111111",)], "text string")
    out = R.redact(df, specs=(*SPECS, spec)).first()
    assert [s.text for s in out.spans] == ["K1234567", "K7654321"]


def test_no_python_and_no_product_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc long, text string")
    plan = R.redact(df, scope="doc")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_rows_of_their_own_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "x")], "doc long, text string")
    plan = R.redact(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_scope_and_rows_agree(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc long, text string")
    one, two = ({r.doc: r.spans for r in R.detect(df, scope=s).collect()} for s in (None, "doc"))
    assert one == two


def test_disabled_types_leave_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc long, text string")
    plan = R.detect(df, config=RedactionConfig(types=("EMAIL",)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.fixture(scope="module")
def scored(spark):
    gold = evaluate.synthetic_corpus(spark).withColumn("doc", F.lit("s"))
    return spark.createDataFrame(evaluate.predicted(R.detect(gold, scope="doc")).collect(), evaluate.predicted(R.detect(gold, scope="doc")).schema)


def test_published_figures(scored):
    micro = {r["mode"]: (r.precision, r.recall, r.f1, r.tp, r.fp, r.fn) for r in evaluate.micro(scored).collect()}
    assert micro == {"strict": (0.9048, 0.8261, 0.8636, 19, 2, 4), "relaxed": (0.9524, 0.8696, 0.9091, 20, 1, 3)}
    macro = {r["mode"]: r.f1 for r in evaluate.macro(scored).collect()}
    assert macro == {"strict": 0.9221, "relaxed": 0.9481}
    assert evaluate.token_accuracy(scored).first().token_accuracy == 0.9615
    wrong = {(r.kind, r.text) for r in evaluate.errors(scored).collect()}
    assert wrong == {("false_positive", "10.0.0.1"), *(("false_negative", n) for n in ("Priya Raghunathan", "Marcus Whitfield", "Sanjay Iyer"))}


def test_a_label_that_is_not_there_fails(spark):
    df = spark.createDataFrame([(0, "abc", "all", [["PERSON", "xyz"]])], "block_idx int, text string, stratum string, entities array<array<string>>")
    with pytest.raises(Exception, match="does not occur"):
        evaluate.annotate(df).collect()


def test_truth_file(spark, tmp_path):
    truth = {"source_document": "x", "blocks": [{"text": "Ann Rao", "entities": [["PERSON", "Ann Rao"]]}, {"index": 7, "stratum": "dense", "entities": [["EMAIL", "a@b.c"]]}]}
    (tmp_path / "t.json").write_text(json.dumps(truth))
    blocks = spark.createDataFrame([(7, "to a@b.c")], "block_idx int, text string")
    rows = {r.block_idx: r for r in evaluate.load_truth(spark, str(tmp_path / "t.json"), blocks).collect()}
    assert rows[7].gold[0].start == 3 and rows[7].stratum == "dense" and rows[0].stratum == "all"
    parts = {r.part for r in evaluate.report(evaluate.load_truth(spark, str(tmp_path / "t.json"), blocks).withColumn("pred", F.col("gold"))).collect()}
    assert parts == {"per_type", "micro", "macro", "by_stratum_relaxed", "errors", "tokens"}


def test_mapping_and_audit(spark):
    df = spark.createDataFrame([(1, "a@b.co and A@B.CO"), (2, "a@b.co")], "doc_id long, text string")
    found = R.detect(df)
    rows = R.mapping(found, ("doc_id",)).collect()
    assert [(r.pii_type, r.original) for r in rows] == [("EMAIL", "a@b.co")]
    audit = json.loads(audit_json(found).first().json)
    assert audit["blocks_processed"] == 2 and audit["entities_redacted"] == 3 and audit["counts_by_type"] == {"EMAIL": 3} and not audit["ner_active"]
    assert json.loads(mapping_json(R.mapping(found, ("doc_id",))).first().json).keys() == {"a@b.co"}
    assert scrub_columns(spark.createDataFrame([("x", "")], "a string, b string"), "a", "b").first() == ("Redacted", "")


def test_options():
    assert parse_types("email, nonsense") == ("EMAIL",)
    assert parse_types("nonsense") is None and parse_types("") is None
    config = parse_options({"types": "SSN", "ner": "Yes", "mapping": "0", "scrub_metadata": "off"})
    assert config.types == ("SSN",) and config.use_ner and not config.emit_mapping and not config.scrub_metadata


def test_runs_are_spliced():
    runs = [(0, 7, "Kushal "), (7, 15, "Subbayya"), (15, 21, " Hegde")]
    assert "".join(docx.splice_runs(runs, [(0, 21, "John Doe")])) == "John Doe"
    assert "".join(docx.splice_runs([(0, 12, "A and B here")], [(0, 1, "X"), (6, 7, "Y")])) == "X and Y here"
    assert docx.splice_runs(runs, [(10, 18, "Z")]) == ["Kushal ", "SubZ", "gde"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("docx")
    data = docx.document(
        ["Reach Mr. Rohan Dey at rohan.dey@gmail.com.", " ", "Rohan Dey signed."],
        [[["OUR TEAM", None, None], ["Anil Kulkarni", "Managing Director", "x"]]],
        header="Page of Northwind Components Private Limited",
        author="Rohan Dey",
    )
    (path / "one.docx").write_bytes(data)
    return path


def test_docx_blocks(spark, folder):
    rows = docx.read_docx(spark, str(folder)).orderBy("block_idx").collect()
    texts = [r.text for r in rows]
    assert texts == ["Reach Mr. Rohan Dey at rohan.dey@gmail.com.", "Rohan Dey signed.", "OUR TEAM", "Anil Kulkarni", "Managing Director", "x", "Page of Northwind Components Private Limited"]
    assert rows[2].is_header and not rows[3].is_header and rows[6].location == "section0:header"
    assert rows[3].context == "OUR TEAM | OUR TEAM | OUR TEAM | Anil Kulkarni | Managing Director | x"


def test_docx_round_trip(spark, folder, tmp_path):
    out = docx.redact_docx(spark, str(folder)).collect()[0]
    assert "author" in out.scrubbed and out.n_entities >= 4
    (tmp_path / "two.docx").write_bytes(out.content)
    text = " ".join(r.text for r in docx.read_docx(spark, str(tmp_path)).collect())
    assert not any(x in text for x in ("Rohan", "gmail", "Kulkarni", "Northwind Components"))
    assert "Managing Director" in text


def test_streams(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "mail a@b.co"), ("2024-01-01 00:20:00", "ip 10.0.0.1")], "ts string, text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").json(str(tmp_path / "in"))
    done = redact_stream(stream)
    query = counts_by_window(done, "ts").writeStream.format("memory").queryName("n").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert {r.pii_type: r.n_entities for r in spark.table("n").collect()} == {"EMAIL": 1, "IP_ADDRESS": 1}
    seen = []
    query = stream.writeStream.foreachBatch(each_batch(lambda df, i: seen.extend(df.collect()), config=RedactionConfig(types=("EMAIL", "PERSON")))).option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    assert len(seen) == 2


def test_ner_degrades(spark):
    df = spark.createDataFrame([("Ann Rao",)], "text string")
    assert R.detect(df, config=RedactionConfig(use_ner=True)).count() == 1


def test_rows_without_a_scope_share_nothing(spark):
    df = spark.createDataFrame([(None, "Mr. Kiran Talwar came."), (None, "Then KIRAN TALWAR left."), (1, "Then Kiran Talwar left.")], "doc long, text string")
    out = {r.text: [s.text for s in r.spans] for r in R.detect(df, scope="doc").collect()}
    assert out[df.collect()[0].text] and not out["Then KIRAN TALWAR left."] and not out["Then Kiran Talwar left."]


def test_jargon_is_no_name(spark):
    phrases = ["Red Herring", "Weighted Average", "Motilal Securities", "Monday Tuesday", "Book Running", "Pimpri Chinchwad", "Anil Companies", "Net Proceeds", "Anil Utilisation", "Anil Utilization"]
    people = ["Priya Raghunathan", "Anil Kulkarni", "Edward Said", "Kate West", "Jude Law", "Mira Gross", "B. N. Rao"]
    df = spark.createDataFrame([(p,) for p in phrases + people], "p string")
    assert {r.p for r in df.where(names.is_name_like(F.col("p"))).collect()} == set(people)


def test_places_count_code_points(spark):
    role, name = "Managing Director", "Anil Kulkarni"
    rows = [("😀" * 200 + name + "x" * 237 + role, True), (name + "😀" * 238 + role, False), ("😀😀" + role + "y" * 200 + name, True), (name + " 😀" * 118 + role, True)]
    df = spark.createDataFrame(rows, "context string, want boolean")
    for r in df.select("want", names.keyword_is_near(F.lit(name), F.col("context")).alias("got")).collect():
        assert r.got == r.want


def test_many_matches_are_placed_rightly(spark):
    text = "".join(f"{'é' * (i % 5)}{i} " for i in range(1000))
    found = spark.createDataFrame([(text,)], "text string").select(rx.spans_of("text", "[0-9]+").alias("m")).first().m
    assert [(m.start, m.end, m.text) for m in found] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]


def test_cells_that_go_on_from_above(spark):
    data = docx.document([], [[["Name", "Role"], ["Anil Kulkarni", "Managing Director"], [docx.ABOVE, "Trustee"]]])
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"PK broken")), ("c", bytearray(docx.document(["x"])))], "path string, content binary")
    rows = docx.blocks_of(files).collect()
    name = [r for r in rows if r.text == "Anil Kulkarni"]
    assert len(name) == 1 and name[0].context == "Name | Role | Anil Kulkarni | Managing Director | Name | Role | Anil Kulkarni | Trustee"
    assert [r.doc_id for r in rows if r.error] == ["b"] and {r.doc_id for r in rows} == {"a", "b", "c"}
    done = {r.doc_id: r for r in docx.redact_files(files).collect()}
    assert done["b"].content is None and "BadZipFile" in done["b"].error and done["a"].n_entities == 1


def test_synthetic_files(spark, tmp_path):
    (tmp_path / "one.docx").write_bytes(synthetic.document())
    (tmp_path / "truth.json").write_text(synthetic.truth("one.docx"))
    blocks = docx.read_docx(spark, str(tmp_path))
    assert [r.text for r in blocks.orderBy("block_idx").collect()] == [text for text, _ in synthetic.CASES]
    assert evaluate.load_truth(spark, str(tmp_path / "truth.json"), blocks).where("size(gold) > 0").count() == 11


def test_ner_in_detection(spark):
    model = lambda texts: [[(t.find(s), t.find(s) + len(s), label) for s, label in (("Anita Rao", "PERSON"), ("Equity Share", "PERSON"), ("NSDL", "ORG"), ("Acme Foods", "ORG")) if s in t] for t in texts]
    df = spark.createDataFrame([("Anita Rao of Acme Foods holds Equity Share at NSDL",), (None,)], "text string")
    found = R.detect(df, config=RedactionConfig(use_ner=True, ner_model=model)).collect()
    assert [(s.pii_type, s.text, s.score) for s in found[0].spans] == [("PERSON", "Anita Rao", 0.6), ("ORGANISATION", "Acme Foods", 0.6)] and found[1].spans == []


def test_command_line(spark, folder, tmp_path, capsys):
    assert cli.main([str(tmp_path / "nothing"), str(tmp_path / "out0"), "--format", "docx"]) == 1
    assert cli.main([str(tmp_path / "nothing"), str(tmp_path / "out0")]) == 1
    assert cli.main([str(folder), str(tmp_path / "out"), "--format", "docx", "--audit", str(tmp_path / "audit"), "--mapping", str(tmp_path / "map")]) == 0
    audit = json.loads(spark.read.text(str(tmp_path / "audit")).first()[0])
    mapped = json.loads(spark.read.text(str(tmp_path / "map")).first()[0])
    assert audit["metadata_fields_scrubbed"] == ["author"] and audit["blocks_processed"] == 7
    assert "Rohan Dey" in mapped["PERSON"] and "rohan.dey@gmail.com" in mapped["EMAIL"]
    assert "Redacted" in capsys.readouterr().out
    spark.createDataFrame([(1, "to a@b.co")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    assert cli.main([str(tmp_path / "in"), str(tmp_path / "out2"), "--no-ner", "--types", "EMAIL", "--mapping", str(tmp_path / "map2")]) == 0
    assert "a@b.co" not in spark.read.parquet(str(tmp_path / "out2")).first().text
    assert spark.read.json(str(tmp_path / "map2")).first().original == "a@b.co"

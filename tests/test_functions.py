import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from redsieve.functions import rx
from redsieve.functions.scalars import luhn, mirrored, normalise, verhoeff
from redsieve.functions.surrogates import surrogate
from redsieve.operators.structured import SPECS

#: A fixed value: published surrogates were made with it.
PUBLISHED_SALT = "pii-redactor-v1"
GOLDEN = [
    ("PERSON", "Rohan Dey", "Maya Valdez"),
    ("EMAIL", "rohan.dey@gmail.com", "maya.valdez@example.com"),
    ("ORGANISATION", "Northwind Components Private Limited", "Lanternfish Systems Private Limited"),
    ("SSN", "452-11-8873", "662-14-2934"),
    ("IP_ADDRESS", "203.0.113.42", "198.51.100.59"),
    ("DATE_OF_BIRTH", "14/03/1982", "04/11/1995"),
    ("PHONE", "+91 22 4009 4400", "+91 84 6597 9998"),
    ("PAN", "AABCK1234M", "VFPTN0563W"),
    ("CREDIT_CARD", "4539 1488 0343 6467", "4648 4992 2986 3133"),
    ("UNKNOWN", "x", "[REDACTED]"),
    ("PERSON", "ROHAN DEY", "MAYA VALDEZ"),
]


def test_golden_surrogates(spark):
    rows = spark.createDataFrame(GOLDEN, "t string, v string, want string").select("want", surrogate(F.col("t"), F.col("v"), PUBLISHED_SALT).alias("got"))
    assert all(r.want == r.got for r in rows.collect())


def test_surrogates_depend_on_the_salt(spark):
    df = spark.createDataFrame([("PERSON", "Rohan Dey")], "t string, v string")
    one, two = ({df.select(surrogate(F.col("t"), F.col("v"), s).alias("x")).first().x for s in salts} for salts in (("a", "a"), ("a", "b", "c", "d")))
    assert len(one) == 1 and len(two) > 1


def test_card_surrogates_pass_the_check(spark):
    df = spark.range(200).select(surrogate(F.lit("CREDIT_CARD"), F.col("id").cast("string")).alias("v"))
    assert df.where(~luhn("v")).count() == 0


def test_check_digits(spark):
    rows = [("4539 1488 0343 6467", True), ("4111111111111111", True), ("4539 1488 0343 6468", False), ("1234", False), (None, None)]
    df = spark.createDataFrame(rows, "v string, want boolean").select("v", "want", luhn("v").alias("got"))
    assert all(r.got == r.want for r in df.collect() if r.v)
    rows = [("2340 1234 5678", True), ("1234 5678 9012", False), ("12345", False), ("", False)]
    assert all(r.got == r.want for r in spark.createDataFrame(rows, "v string, want boolean").select("want", verhoeff("v").alias("got")).collect())


def test_normal_form_and_case(spark):
    df = spark.createDataFrame([("  A  b\tC ", "ÉA", "日本")], "a string, b string, c string")
    row = df.select(normalise("a").alias("n"), mirrored(F.lit("x"), F.col("b")).alias("u"), mirrored(F.lit("x"), F.col("c")).alias("l")).first()
    assert tuple(row) == ("a b c", "X", "x")


#: Without classes in which Python and Java differ.
PATTERNS = {s.pii_type: s.pattern for s in SPECS}


@pytest.mark.parametrize("kind", sorted(PATTERNS))
def test_matches_with_offsets_as_python_has_them(spark, kind):
    pieces = st.sampled_from(["a@b.co", "+91 98765 43210", "10.0.0.1", "::", "452-11-8873", "4111111111111111", "14/03/1982", "7 Jan 2001", "ABCDE1234K", "2340 1234 5678", "12345678", "U12345MH1999PLC123456", "www.x.y", "http://a/b?c", " ", ".", "-", "é", "😀", "\n", "Jan", "x", "1"])

    @settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck), database=None, derandomize=True)
    @given(st.lists(st.lists(pieces, max_size=12).map("".join), min_size=60, max_size=80))
    def run(texts):
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        for r in df.select("text", rx.spans_of("text", "(?U)" + PATTERNS[kind]).alias("m")).collect():
            want = [(m.start(), m.end(), m[0]) for m in re.finditer(PATTERNS[kind], r.text)]
            assert [(m.start, m.end, m.text) for m in r.m] == want, r.text

    run()


def test_no_matches_in_null(spark):
    df = spark.createDataFrame([(None, None), ("a1", None), (None, "[0-9]")], "text string, p string")
    assert all(r.m == [] for r in df.select(rx.spans_of("text", F.col("p")).alias("m")).collect())


def test_words_begin_with_a_needle(spark):
    from redsieve.functions.scalars import begins_any

    texts = {"aged 40": True, "managed": False, "un-aged": True, "the directors": True, "AnnDirector": True, "QBAGED": False, "codirectors": False, "a directorate, aged": True, "éaged": False, "4aged": False, "": False, None: False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", begins_any(F.col("t"), ("aged", "director")).alias("b")).collect()
    assert {r.t: r.b for r in rows} == texts


def test_a_role_near_by_begins_a_word(spark):
    from redsieve.operators.names import keyword_is_near

    gap = "x " * 120
    near = {f"{gap}Ann Rao | director": True, "Ann Rao damaged": False, f"director {gap}Ann Rao": True, f"dam aged{gap}xxxxx Ann Rao": True, f"damaged{gap}xxxxx Ann Rao": False, f"Ann Rao {gap}x aged": True, f"Ann Rao {gap}xxxxxxx aged": False, "none": True}
    rows = spark.createDataFrame([(t,) for t in near], "t string").select("t", keyword_is_near(F.lit("Ann Rao"), F.col("t")).alias("b")).collect()
    for r in rows:
        assert r.b == near[r.t], r.t


def test_a_gate_begins_a_word(spark):
    from redsieve.operators.structured import recognise

    din = next(s for s in SPECS if s.pii_type == "DIN")
    want = {"edin token 81a5e43159407a3": 0, "DIN 43159407": 1, "DINs: 43159407": 1, "me" + "din" + " " * 47 + "43159407": 0, ". " + "din" + " " * 47 + "43159407": 1, ". din" + " " * 48 + "43159407": 0}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", F.size(recognise("t", din)).alias("n")).collect()
    assert {r.t: r.n for r in rows} == want


def test_a_phone_before_a_card_is_found(spark):
    from redsieve.operators.structured import recognise

    phone = next(s for s in SPECS if s.pii_type == "PHONE")
    row = spark.createDataFrame([("erntou +1 (269) 555-3296 4524132264652876 and",)], "t string").select(recognise("t", phone).alias("s")).first()
    assert [s.text for s in row.s] == ["+1 (269) 555-3296"]

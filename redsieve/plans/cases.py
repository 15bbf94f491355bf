"""Queries over texts made from keys and word lists, and over fixed documents, each with its SQL.

They hold what plans.queries leaves out: word lists, guards, plug-ins, truth, options, Word documents.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions.policy import Policy
from ..functions.scalars import words
from ..operators import contextual, evaluate, harvest, ner
from ..operators import names as N
from ..operators import redact as R
from ..operators.structured import SPAN, RegexSpec, empty_spans
from ..sources import docx, synthetic
from ..sources.sinks import mapping_json
from . import queries as Q
from .config import RedactionConfig, parse_options
from .queries import _read, _rows, _word, text_of
from .sql import _SLICE, ORACLES, _hash, _list, _person, _pick, _slice_surrogate


def _nth(values: tuple[str, ...], key: str) -> Column:
    return F.get(words(values), (F.col(key) % len(values)).cast("int"))


def _nth_sql(values: tuple[str, ...], key: str) -> str:
    return f"{_list(values)}[cast({key} as int) % {len(values)} + 1]"


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 100))


_CAPITAL = "upper(substr({0}, 1, 1)) || substr({0}, 2)"
_HEAD = f"{_word('s_suppkey')} || ' ' || {_word('s_nationkey + 1000')}"


def _supplier(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) as id", f"{_HEAD} as head", *more)


def org_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generic head or jargon alone, behind a name, and before the suffix."""
    df = _supplier(spark, sf_dir)
    generic, jargon = _capital(_nth(P.GENERIC_HEAD_NOUNS, "id")), _capital(_nth(P.ORG_LEADING_STOPWORDS, "id"))
    kind = F.col("id") % 4
    phrase = F.when(kind == 0, generic).when(kind == 1, F.concat_ws(" ", "head", generic)).when(kind == 2, jargon).otherwise(F.concat_ws(" ", "head", jargon))
    return df.select("id", N.is_org_like(F.concat(phrase, F.lit(" Limited"))).alias("org_like"))


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word of a list behind a given name makes it no name."""
    lists = (P.ORG_INDICATOR_TOKENS, tuple(w for w in P.FUNCTION_WORDS if len(w) > 1), NO_NAMES)
    df = _read(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) as id", f"{_word('c_custkey')} as own")
    last = F.col("own")
    for k, values in enumerate(lists):
        last = F.when(F.col("id") % 4 == k, _capital(_nth(values, "id"))).otherwise(last)
    return df.select("id", N.is_name_like(F.concat(F.lit("Anil "), last)).alias("name_like"))


#: Of the vocabulary that keeps jargon from being names.
NO_NAMES = (
    "herring", "average", "securities", "tuesday", "companies", "utilization", "kolkata", "chinchwad", "proceeds", "intermediaries",
    "facilities", "underwriting", "practising", "accountants", "farms", "officers", "tribunal", "gst", "media", "litigation",
)


def surname_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No family is called by such a word."""
    df = _read(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) as id", f"{_word('c_custkey + 1000')} as own")
    last = F.when(F.col("id") % 2 == 0, _capital(_nth(NO_NAMES, "id"))).otherwise(F.col("own"))
    return df.select("id", harvest.surname_of(F.concat(F.lit("Anil "), last)).alias("surname"))


def trim_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = F.concat_ws(" ", _capital(_nth(P.ORG_LEADING_NOISE, "id")), _nth(P.ORG_LEADING_NOISE, "more"), F.col("head"))
    return _supplier(spark, sf_dir, "cast(s_nationkey as bigint) as more").select("id", N.trim_org_noise(noise).alias("name"))


_MAILBOXES = tuple(m for m in P.ROLE_MAILBOXES if "-" not in m)


def role_mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _supplier(spark, sf_dir, f"{_word('s_suppkey')} as own")
    local = F.concat_ws(".", F.when(F.col("id") % 2 == 0, _nth(_MAILBOXES, "id")).otherwise(F.lit("anil")), F.lower("own"))
    return df.select("id", N.name_from_email(local).alias("name"))


def address_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stop behind an abbreviation doesn't end what an address begins with."""
    df = _supplier(spark, sf_dir).select("id", F.concat(F.lit("It ended here. Plot "), _nth(P.ADDRESS_ABBREVIATIONS, "id"), F.lit(". 5, "), "head", F.lit(" - 411004")).alias("text"))
    return _rows(df, contextual.addresses("text"), "id")


def org_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.concat(F.lit(" of "), "head", F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), F.upper(_nth(P.ORG_SUFFIXES, "id")))).otherwise(F.lit("")))
    return _supplier(spark, sf_dir).select("id", N.looks_like_org(tail).alias("org"))


def header_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three rows a table: a header, which for every other table is a label that the cell below repeats; that cell; for every third a banner."""
    df = _read(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) as scope", "c_custkey as k", f"{_word('c_custkey')} || ' ' || {_word('c_nationkey + 1000')} as name")
    cell = lambda text, context, head: F.struct(text.alias("text"), context.alias("context"), F.lit(head).alias("is_header"))
    label = F.when(F.col("k") % 2 == 0, F.upper("name")).otherwise(F.lit("Column"))
    banner = F.when(F.col("k") % 3 == 0, F.concat(F.lit("OUR PROMOTERS: Banner "), F.substring_index("name", " ", 1)))
    rows = F.array(cell(label, label, True), cell(F.col("name"), F.concat_ws(" | ", label, F.lit("Managing Director"), "name"), False), cell(banner, banner, True))
    blocks = df.select("scope", F.inline(rows))
    return harvest.person_names(blocks).select(F.col("scope").cast("long").alias("id"), "name")


def seen_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations by their suffix, but where a known one stands."""
    df = text_of(spark, sf_dir, "org").where("id % 3 < 2")
    there = F.array(F.struct(F.lit(12).alias("start"), F.lit(14).alias("end"), F.lit("ORGANISATION").alias("pii_type"), F.lit("x").alias("text"), F.lit(0.9).alias("score"), F.lit("x").alias("source"))).cast(SPAN)
    df = df.withColumn("seen", F.when(F.col("id") % 2 == 0, there).otherwise(empty_spans()))
    return _rows(df, contextual.by_legal_form("text", F.col("seen")), "id")


def _stub(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """A model that knows the words of the text below."""
    for text in texts:
        out = []
        for label, surface in (("PERSON", text.split(",")[0]), ("PERSON", "Chief Executive Officer"), ("ORG", "BSE Limited"), ("ORG", "Companies Act"), ("ORG", "Acme Traders"), ("GPE", "Pune"), ("DATE", "Monday")):
            if (at := text.find(surface)) >= 0:
                out.append((at, at + len(surface), label))
        yield out


_NER = "' , Chief Executive Officer, told BSE Limited under the Companies Act of Acme Traders in Pune on Monday.'"


def ner_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model finds, as far as its people are shaped like names and its organisations are neither public bodies nor laws."""
    df = _supplier(spark, sf_dir).select("id", F.concat("head", F.expr(_NER)).alias("text"))
    spans = df.select("id", F.inline(ner.entities("text", _stub)))
    return spans.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "pii_type", F.col("text").alias("surface"))


PASSPORT = RegexSpec("PassportRecognizer", "PASSPORT", r"\b[A-Z]\d{7}\b", 0.9, gate=("passport",), window=20)


def own_recogniser(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "case when o_orderkey % 2 = 0 then 'Passport ' else 'Ticket ' end || 'K' || lpad(cast(o_orderkey % 10000000 as string), 7, '0') || ' seen'"
    df = _read(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as bigint) as id", f"{text} as text")
    return _rows(R.detect(df, specs=(PASSPORT,), config=RedactionConfig(types=("PASSPORT",))), F.col("spans"), "id")


def _tickets(text: str) -> Iterator[SimpleNamespace]:
    at = text.find("Ref")
    if at >= 0:
        yield SimpleNamespace(start=at, end=at + 3, pii_type="TICKET", score=0.5, source="own")


def own_analyser(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = text_of(spark, sf_dir, "ssn")
    return _rows(R.detect(df, config=RedactionConfig(types=("TICKET",)), analysers=(R.analyser_of(_tickets),)), F.col("spans"), "id")


def own_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy with a word of its own: names that hold it are none."""
    policy = Policy(more_non_person=("qb", "qbd"))
    df = _read(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) as id", f"'Anil ' || {_word('c_custkey')} as name")
    return df.select("id", N.is_name_like(F.col("name"), policy).alias("name_like"))


def truth_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic truth, of which every other block is named by its index and found in a table of blocks."""
    whole = json.loads(synthetic.truth())
    whole["blocks"] = [{"index": i, "entities": b["entities"]} if i % 2 else b for i, b in enumerate(whole["blocks"])]
    raw = spark.range(1).select(F.from_json(F.lit(json.dumps(whole)), evaluate.TRUTH).alias("x")).select("x.*")
    blocks = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(synthetic.CASES)], "block_idx int, text string")
    rows = evaluate.truth_of(raw, blocks).select("block_idx", F.inline("gold"))
    return rows.select(*(F.col(c).cast("long").alias(c) for c in ("block_idx", "start", "end")), "label", F.col("text").alias("surface"))


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options as an HTTP request would carry them."""
    given = ({"types": "email, nonsense", "ner": "Yes"}, {"types": "nonsense", "mapping": "1"}, {"scrub_metadata": "off", "salt": "s"}, {})
    rows = [(i, ",".join(c.types or ("all",)), c.use_ner, c.emit_mapping, c.scrub_metadata) for i, c in enumerate(map(parse_options, given))]
    return spark.createDataFrame(rows, "id long, types string, ner boolean, mapping boolean, scrub boolean")


def mapping_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping_json(Q.mapping_table(spark, sf_dir))


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each part of the report has."""
    report = evaluate.report(Q._annotated(spark, sf_dir))
    return report.select("part", F.json_array_length("json").cast("long").alias("n")).where("part != 'errors'")


def _documents(spark: SparkSession) -> DataFrame:
    data = docx.document(
        ["Reach Mr. Rohan Dey at rohan.dey@gmail.com.", " "],
        [[["Contact Person", "Role", "Role"], ["Anil Kulkarni", "Managing Director", "since"], [docx.ABOVE, "Trustee", "now"], ["OUR PROMOTERS: Sandesh Bhagwat", None, None]]],
        header="Northwind Components Private Limited",
        author="Rohan Dey",
    )
    return spark.createDataFrame([("one.docx", bytearray(data)), ("two.docx", bytearray(b"no archive"))], "path string, content binary")


def docx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = docx.blocks_of(_documents(spark))
    return blocks.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "text", "context", "location", "is_header", F.col("error").isNotNull().alias("damaged"))


def docx_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the redacted document, and what was scrubbed."""
    done = docx.redact_files(_documents(spark))
    scrubbed = done.select(F.col("doc_id").alias("d"), F.array_join("scrubbed", ",").alias("scrubbed"), "n_entities")
    again = docx.blocks_of(done.where("error is null").select(F.col("doc_id").alias("path"), "content"))
    both = scrubbed.join(again, F.col("d") == F.col("doc_id"), "left")
    return both.select(F.col("d").alias("doc_id"), F.col("block_idx").cast("long").alias("block_idx"), "text", "scrubbed", "n_entities")


def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) as t({columns})"


def _fake(person: str) -> str:
    return _person(f"'{person.lower()}'", _hash(f"'{person.lower()}'"))


_MAIL = f"replace(lower({_person(chr(39) + 'rohan dey' + chr(39), _hash(chr(39) + 'rohan dey' + chr(39)))}), ' ', '.') || '@' || {_pick(P.DOMAINS, _hash(chr(39) + 'rohan.dey@gmail.com' + chr(39)))}"
_NORTHWIND = _hash("'northwind components private limited'")
_COMPANY = f"{_pick(P.COMPANY_HEADS, _NORTHWIND)} || ' ' || {_pick(P.COMPANY_TAILS, _NORTHWIND, 1)} || ' Private Limited'"
_HEADER = "Contact Person | Role | Role"
_ANIL = f"{_HEADER} | Anil Kulkarni | Managing Director | since | {_HEADER} | Anil Kulkarni | Trustee | now"
_BANNER = "OUR PROMOTERS: Sandesh Bhagwat"
_BLOCKS = [
    ("one.docx", 0, "Reach Mr. Rohan Dey at rohan.dey@gmail.com.", "", "body", False, False),
    ("one.docx", 1, "Contact Person", f"{_HEADER} | {_HEADER}", "body:table", True, False),
    ("one.docx", 2, "Role", f"{_HEADER} | {_HEADER}", "body:table", True, False),
    ("one.docx", 3, "Role", f"{_HEADER} | {_HEADER}", "body:table", True, False),
    ("one.docx", 4, "Anil Kulkarni", _ANIL, "body:table", False, False),
    *(("one.docx", 5 + i, text, f"{_HEADER} | Anil Kulkarni | Managing Director | since", "body:table", False, False) for i, text in enumerate(("Managing Director", "since"))),
    *(("one.docx", 7 + i, text, f"{_HEADER} | Anil Kulkarni | Trustee | now", "body:table", False, False) for i, text in enumerate(("Trustee", "now"))),
    ("one.docx", 9, _BANNER, f"{_HEADER} | {_BANNER} | {_BANNER} | {_BANNER}", "body:table", False, False),
    ("one.docx", 10, "Northwind Components Private Limited", "", "section0:header", False, False),
    ("two.docx", None, None, None, None, None, True),
]
#: Published figures: support, tp, fp, fn by type; strict and relaxed differ for people only.
_SCORES = {
    "AADHAAR": (1, 1, 0, 0), "ADDRESS": (1, 1, 0, 0), "CREDIT_CARD": (4, 4, 0, 0), "DATE_OF_BIRTH": (3, 3, 0, 0), "EMAIL": (1, 1, 0, 0),
    "IP_ADDRESS": (3, 3, 1, 0), "ORGANISATION": (1, 1, 0, 0), "PAN": (1, 1, 0, 0), "PHONE": (1, 1, 0, 0), "SSN": (2, 2, 0, 0),
}
_REPORT = [(mode, label, *n) for mode in ("strict", "relaxed") for label, n in _SCORES.items()] + [("strict", "PERSON", 5, 1, 1, 4), ("relaxed", "PERSON", 5, 2, 0, 3)]

_NAMED = f"select cast(s_suppkey as bigint) as id, {_HEAD} as head, cast(s_nationkey as bigint) as more, {_word('s_suppkey')} as own from supplier"
_STRUCTURED = " union all ".join(
    f"""select id as doc_id, start, "end", surface, '{kind}' as pii_type, {score}::double as score, '{source}' as source from ({ORACLES[name]})"""
    for name, kind, score, source in (
        ("email_spans", "EMAIL", 0.99, "EmailRecognizer"), ("phone_spans", "PHONE", 0.95, "PhoneRecognizer"), ("ip_spans", "IP_ADDRESS", 0.99, "IPAddressRecognizer"), ("card_spans", "CREDIT_CARD", 0.98, "CreditCardRecognizer"),
    )
)

SQL: dict[str, str] = {
    "org_like": "select cast(s_suppkey as bigint) as id, s_suppkey % 4 = 1 as org_like from supplier",
    "word_lists": "select cast(c_custkey as bigint) as id, c_custkey % 4 = 3 as name_like from customer",
    "surname_words": f"select cast(c_custkey as bigint) as id, case when c_custkey % 2 = 1 then {_word('c_custkey + 1000')} end as surname from customer",
    "trim_noise": f"select id, head as name from ({_NAMED})",
    "role_mailboxes": f"select id, case when id % 2 = 1 then 'Anil ' || upper(substr(own, 1, 1)) || lower(substr(own, 2)) end as name from ({_NAMED})",
    "address_abbreviations": f"""select id, cast(15 as bigint) as start, cast(15 + length(surface) as bigint) as "end", surface from (
        select id, 'Plot ' || {_nth_sql(P.ADDRESS_ABBREVIATIONS, 'id')} || '. 5, ' || head || ' - 411004' as surface from ({_NAMED}))""",
    "org_tail": "select cast(s_suppkey as bigint) as id, s_suppkey % 2 = 0 as org from supplier",
    "header_guard": f"""with n as (select cast(c_custkey as bigint) as id, {_word('c_custkey')} as one, {_word('c_nationkey + 1000')} as two from customer)
        select id, one || ' ' || two as name from n where id % 2 = 1 union all select id, 'Banner ' || one from n where id % 3 = 0""",
    "seen_spans": f"""select id, cast(10 as bigint) as start, cast(10 + length(surface) as bigint) as "end", surface from (
        select id, head || case id % 3 when 0 then ' Private Limited' else ' Limited' end as surface from ({_NAMED}) where id % 3 < 2 and id % 2 = 1)""",
    "ner_spans": f"""with t as (select id, head || {_NER} as text, head || ' ' as who from ({_NAMED})),
        f as (select id, text, unnest([{{'k': 'PERSON', 's': who}}, {{'k': 'ORGANISATION', 's': 'Acme Traders'}}, {{'k': 'ADDRESS', 's': 'Pune'}}]) as x from t)
        select id, cast(position(x.s in text) - 1 as bigint) as start, cast(position(x.s in text) - 1 + length(x.s) as bigint) as "end", x.k as pii_type, x.s as surface from f""",
    "own_recogniser": """select cast(o_orderkey as bigint) as id, cast(9 as bigint) as start, cast(17 as bigint) as "end", 'K' || lpad(cast(o_orderkey % 10000000 as string), 7, '0') as surface from orders where o_orderkey % 2 = 0""",
    "own_analyser": """select cast(o_orderkey as bigint) as id, cast(0 as bigint) as start, cast(3 as bigint) as "end", 'Ref' as surface from orders""",
    "own_words": "select cast(c_custkey as bigint) as id, c_custkey not in (1, 13) as name_like from customer",
    "truth_gold": f"""with c as (select * from {_values([(i, text, label, surface) for i, (text, found) in enumerate(synthetic.CASES) for label, surface in found], "block_idx, text, label, surface")})
        select cast(block_idx as bigint) as block_idx, cast(position(surface in text) - 1 as bigint) as start, cast(position(surface in text) - 1 + length(surface) as bigint) as "end", label, surface from c""",
    "options": f"""select cast(id as bigint) as id, types, ner, mapping, scrub from {_values([(0, "EMAIL", True, False, True), (1, "all", False, True, True), (2, "all", False, False, False), (3, "all", False, False, True)], "id, types, ner, mapping, scrub")}""",
    "mapping_file": f"""with s as (select *, row_number() over (partition by pii_type, lower(surface) order by doc_id, start) as k from ({_SLICE})),
        m as (select pii_type, surface as original, {_slice_surrogate()} as surrogate from s where k = 1)
        select pii_type, '{{' || string_agg('"' || original || '":"' || surrogate || '"', ',' order by original) || '}}' as json from m group by pii_type""",
    "evaluation_report": f"""select 'per_type' as part, count(*) as n from ({ORACLES["eval_per_type"]}) union all select 'micro', count(*) from ({ORACLES["eval_micro"]}) union all select 'macro', count(*) from ({ORACLES["eval_macro"]})
        union all select 'by_stratum_relaxed', count(*) from ({ORACLES["eval_stratum"]}) union all select 'tokens', count(*) from ({ORACLES["token_accuracy"]})""",
    "docx_blocks": f"select doc_id, cast(block_idx as bigint) as block_idx, text, context, location, is_header, damaged from {_values(_BLOCKS, 'doc_id, block_idx, text, context, location, is_header, damaged')}",
    "docx_redacted": f"""with b as (select doc_id, cast(block_idx as bigint) as block_idx, text from {_values([b[:3] for b in _BLOCKS], "doc_id, block_idx, text")})
        select doc_id, block_idx, case block_idx when 0 then 'Reach Mr. ' || {_fake("Rohan Dey")} || ' at ' || {_MAIL} || '.' when 4 then {_fake("Anil Kulkarni")}
            when 9 then 'OUR PROMOTERS: ' || {_fake("Sandesh Bhagwat")} when 10 then {_COMPANY} else text end as text,
            case when block_idx is null then '' else 'author' end as scrubbed, cast(case when block_idx is null then 0 else 5 end as bigint) as n_entities from b""",
    "synthetic_report": f"""select mode, label, cast(support as bigint) as support, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, round(tp::double / (tp + fp), 4) as precision,
        round(tp::double / (tp + fn), 4) as recall, round(2.0::double * tp / (2 * tp + fp + fn), 4) as f1 from {_values(_REPORT, "mode, label, support, tp, fp, fn")}""",
    "detect_documents": f"""with s as ({_STRUCTURED})
        select * from s a where not exists (select 1 from s b where a.doc_id = b.doc_id and a.start < b."end" and b.start < a."end"
            and (length(b.surface) > length(a.surface) or (length(b.surface) = length(a.surface) and (b.score > a.score or (b.score = a.score and b.start < a.start)))))""",
    "audit_documents": f"""with c as (select pii_type, count(*) as n from ({_SLICE}) group by pii_type)
        select '{{"blocks_processed":' || (select count(*) from documents) || ',"entities_redacted":' || (select coalesce(sum(n), 0)::bigint from c) || ',"counts_by_type":{{' ||
            coalesce(string_agg('"' || pii_type || '":' || n, ',' order by pii_type), '') || '}},"metadata_fields_scrubbed":[],"ner_active":false}}' as json from c""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            org_like, word_lists, surname_words, trim_noise, role_mailboxes, address_abbreviations, org_tail, header_guard, seen_spans, ner_spans,
            own_recogniser, own_analyser, own_words, truth_gold, options, mapping_file, evaluation_report, docx_blocks, docx_redacted,
        )
    }

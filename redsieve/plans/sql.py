"""SQL for DuckDB that gives the rows of plans.queries.

DuckDB's expressions know neither look-around nor Unicode classes. Patterns with
look-around are therefore matched without it, and their neighbours tested by offset;
on text that is made from keys the places follow from how it was made.
"""

from __future__ import annotations

from ..functions import policy as P
from ..functions.surrogates import SALT
from .queries import LETTERS, SURROGATES, TEXTS, _word


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _matches(source: str, pattern: str, keep: str = "true", ids: str = "id") -> str:
    """Rows (ids, start, end, surface) of matches of a pattern in (ids, text); keep may use text, start, surface, prev and next."""
    p = pattern.replace("'", "''")
    return f"""
    with x as (select {ids}, text, regexp_extract_all(text, '{p}') as m, string_split_regex(text, '{p}') as g from ({source})),
    y as (select {ids}, text, m, g, unnest(range(len(m))) as i from x where len(m) > 0),
    z as (select {ids}, text, m[i + 1] as surface, cast(list_sum(list_transform(g[1:i + 1], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i], lambda s: length(s))), 0) as bigint) as start from y),
    w as (select *, case when start = 0 then '' else substr(text, start, 1) end as prev, substr(text, start + length(surface) + 1, 1) as next, substr(text, start + length(surface) + 1, 2) as next2 from z)
    select {ids}, start, start + length(surface) as "end", surface from w where {keep}"""


def _source(name: str) -> str:
    table, key, text = TEXTS[name]
    return f"select cast({key} as bigint) as id, {text} as text from {table}"


_LUHN = """list_sum(list_transform(range(length({d})), lambda i: case when (length({d}) - i) % 2 = 0 then (case when cast(substr({d}, i + 1, 1) as int) > 4 then 2 * cast(substr({d}, i + 1, 1) as int) - 9 else 2 * cast(substr({d}, i + 1, 1) as int) end) else cast(substr({d}, i + 1, 1) as int) end)) % 10 = 0"""
_DIGITS = "regexp_replace({t}, '[^0-9]', '', 'g')"
_CARD = "length(" + _DIGITS.format(t="surface") + ") >= 13 and " + _LUHN.format(d=_DIGITS.format(t="surface"))
_ALONE = "not regexp_matches(prev, '[0-9.]') and not regexp_matches(next, '[0-9]') and not regexp_matches(next2, '^[.][0-9]')"
_DOCS = "select cast(doc_id as bigint) as id, text from documents"

#: Runs of all that a card's pattern or its look-around mentions; in them, the longest match from each start that is free, first come first kept.
_CARDS = f"""
    with r as ({_matches(_DOCS, r"[0-9 .\-]{13,}")}),
    s as (select id, start, surface as run, unnest(range(length(surface))) as i from r),
    c as (select id, start, run, i, unnest(range(13, 38)) as n from s where regexp_matches(substr(run, i + 1, 1), '[0-9]') and (i = 0 or not regexp_matches(substr(run, i, 1), '[0-9.]'))),
    f as (select id, start, run, i, max(n) as n from c where i + n <= length(run) and regexp_full_match(substr(run, i + 1, n), '(?:[0-9][ \\-]?){{12,18}}[0-9]')
        and not regexp_matches(substr(run, i + n + 1, 2), '^[0-9]|^[.][0-9]') group by all),
    l as (select id, start, run, list({{'i': i, 'n': n}} order by i) as l from f group by all),
    k as (select id, start, run, unnest(list_reduce(l[2:], lambda acc, x: case when x.i < acc[len(acc)].i + acc[len(acc)].n then acc else list_append(acc, x) end, [l[1]])) as x from l),
    o as (select id, start + x.i as start, start + x.i + x.n as "end", substr(run, x.i + 1, x.n) as surface from k)
    select * from o where {_CARD}"""

#: The dihedral group of order ten, and the permutation, from their rules.
_D = "(case when {a} < 5 and {b} < 5 then ({a} + {b}) % 5 when {a} < 5 then 5 + ({a} + {b}) % 5 when {b} < 5 then 5 + ({a} - {b} + 5) % 5 else ({a} - {b} + 5) % 5 end)"
_PERMUTED = ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]


def _verhoeff(number: str) -> str:
    source = f"select o_orderkey as id, reverse({number}) as r from orders"
    steps = [f"select id, r, 0 as c0 from ({source})"]
    for i in range(12):
        digit = f"cast(substr('{_PERMUTED[i % 8]}', cast(substr(r, {i + 1}, 1) as int) + 1, 1) as int)"
        c, p = f"c{i}", f"p{i}"
        steps.append(f"select id, r, {_D.format(a=c, b=p)} as c{i + 1} from (select *, {digit} as {p} from ({steps[-1]}))")
    return f"select id, c12 = 0 as valid from ({steps[-1]})"


_VERHOEFF_NUMBER = "lpad(cast((o_orderkey * 7919 + 2340) % 10000 as string), 4, '0') || lpad(cast(o_custkey % 10000 as string), 4, '0') || lpad(cast(o_orderkey % 10000 as string), 4, '0')"


def _fixed(name: str, start: int, size: str, keep: str = "true") -> str:
    """Spans whose place follows from the text's making."""
    return f"""select id, cast({start} as bigint) as start, cast({start} + {size} as bigint) as "end", substr(text, {start + 1}, {size}) as surface from (select *, cast(id as bigint) as k from ({_source(name)})) where {keep}"""


def _hash(value: str) -> str:
    return f"cast('0x' || substr(sha256('{SALT}|' || {value}), 1, 16) as ubigint)"


def _pick(pool, h: str, offset: int = 0) -> str:
    return f"{_list(pool)}[cast((cast({h} as hugeint) + {offset * 7919}) % {len(pool)} as int) + 1]"


def _mod(h: str, bits: int, n: int) -> str:
    return f"cast(({h} >> {bits}) % {n} as bigint)"


def _person(norm: str, h: str) -> str:
    n = f"len(list_filter(string_split({norm}, ' '), lambda t: t != ''))"
    first, last, middle = _pick(P.FIRST_NAMES, h), _pick(P.LAST_NAMES, h, 1), _pick(P.LAST_NAMES, h, 2)
    return f"case when {n} = 1 then {last} when {n} >= 3 then {first} || ' ' || {middle} || ' ' || {last} else {first} || ' ' || {last} end"


def _digits_of(h: str, n: str) -> str:
    """n digits (h >> 3 i) % 10."""
    return f"list_transform(range({n}), lambda i: case when 3 * i > 63 then 0 else cast(({h} >> cast(least(3 * i, 63) as int)) % 10 as int) end)"


def _surrogate(pii_type: str) -> str:
    table, key, value = SURROGATES[pii_type]
    base = f"select id, value, norm, {_hash('norm')} as h from (select cast({key} as bigint) as id, {value} as value, lower({value}) as norm from {table})"
    two = lambda n: f"lpad(cast({n} as string), 2, '0')"
    year, month, day = f"(1955 + {_mod('h', 0, 45)})", f"(1 + {_mod('h', 8, 12)})", f"(1 + {_mod('h', 16, 28)})"
    hexa = lambda i: f"lpad(lower(to_hex({_mod('h', 8 * i, 65536)})), 4, '0')"
    letter = lambda bits: f"chr(cast(65 + {_mod('h', bits, 26)} as int))"
    local = "replace(string_split(norm, '@')[1], '.', ' ')"
    drawn = f"list_concat([4], {_digits_of('h', '14')})"
    total = f"list_sum(list_transform(range(15), lambda i: case when i % 2 = 0 then case when {drawn}[i + 1] > 4 then 2 * {drawn}[i + 1] - 9 else 2 * {drawn}[i + 1] end else {drawn}[i + 1] end))"
    card = f"(array_to_string({drawn}, '') || cast((10 - {total} % 10) % 10 as string))"
    digits = _DIGITS.format(t="value")
    new = _digits_of("h", f"length({digits})")
    # the n-th digit of the value is replaced by the n-th new one, the first two of a number with a plus stay
    phone = f"""array_to_string(list_transform(range(length(value)), lambda j: case when not regexp_matches(substr(value, j + 1, 1), '[0-9]') then substr(value, j + 1, 1)
        when starts_with(value, '+') and length(regexp_replace(substr(value, 1, j), '[^0-9]', '', 'g')) < 2 then substr(value, j + 1, 1)
        else cast({new}[length(regexp_replace(substr(value, 1, j), '[^0-9]', '', 'g')) + 1] as string) end), '')"""
    made = {
        "PERSON": _person("norm", "h"),
        "EMAIL": f"replace(lower({_person(local, _hash(local))}), ' ', '.') || '@' || {_pick(P.DOMAINS, 'h')}",
        "PHONE": phone,
        "ORGANISATION": f"{_pick(P.COMPANY_HEADS, 'h')} || ' ' || {_pick(P.COMPANY_TAILS, 'h', 1)} || case when ends_with(norm, ' private limited') then ' Private Limited' when ends_with(norm, ' llp') then ' LLP' else '' end",
        "ADDRESS": f"{_pick(P.STREETS, 'h')} || ', ' || {_pick(P.LOCALITIES, 'h', 1)} || ', ' || {_pick(P.CITIES, 'h', 2)}",
        "SSN": f"cast(100 + {_mod('h', 0, 800)} as string) || '-' || {two('1 + ' + _mod('h', 10, 99))} || '-' || lpad(cast(1 + {_mod('h', 20, 9999)} as string), 4, '0')",
        "CREDIT_CARD": f"substr({card}, 1, 4) || ' ' || substr({card}, 5, 4) || ' ' || substr({card}, 9, 4) || ' ' || substr({card}, 13, 4)",
        "DATE_OF_BIRTH": f"case when contains(value, '/') then {two(day)} || '/' || {two(month)} || '/' || cast({year} as string) when contains(value, '-') then {two(day)} || '-' || {two(month)} || '-' || cast({year} as string) else {_list(P.MONTHS)}[cast({month} as int)] || ' ' || cast({day} as string) || ', ' || cast({year} as string) end",
        "IP_ADDRESS": f"case when contains(value, ':') then '2001:db8:' || {hexa(0)} || ':' || {hexa(1)} || ':' || {hexa(2)} || ':' || {hexa(3)} else '198.51.100.' || cast({_mod('h', 0, 254)} + 1 as string) end",
        "PAN": " || ".join(letter(5 * i) for i in range(5)) + f" || lpad(cast({_mod('h', 25, 10000)} as string), 4, '0') || {letter(40)}",
        "AADHAAR": f"cast(2000 + {_mod('h', 0, 8000)} as string) || ' ' || cast({_mod('h', 12, 9000)} + 1000 as string) || ' ' || cast({_mod('h', 24, 9000)} + 1000 as string)",
        "DIN": f"lpad(cast({_mod('h', 0, 90000000)} + 10000000 as string), 8, '0')",
        "CIN": f"'U' || cast({_mod('h', 0, 90000)} + 10000 as string) || 'XX' || cast(1980 + {_mod('h', 0, 40)} as string) || 'PLC' || cast({_mod('h', 8, 900000)} + 100000 as string)",
        "BANK_ACCOUNT": f"array_to_string({new}, '')",
        "WEBSITE": f"case when starts_with(lower(value), 'http') then 'https://www.' else 'www.' end || replace(lower({_pick(P.COMPANY_HEADS, 'h')}), ' ', '') || '-example.com'",
    }[pii_type]
    return f"select id, case when regexp_matches(value, '[A-Za-z]') and not regexp_matches(value, '[a-z]') then upper({made}) else {made} end as surrogate from ({base})"


_HEAD = f"{_word('c_custkey')} || ' ' || {_word('c_nationkey + 1000')}"
_NAME = f"select cast(c_custkey as bigint) as id, {_HEAD} as name from customer"
_CAPPED = lambda t: f"upper(substr({t}, 1, 1)) || lower(substr({t}, 2))"
_WHO = f"select cast(s_suppkey as bigint) as id, {_word('s_suppkey')} || ' ' || {_word('s_nationkey + 1000')} as who from supplier"
_EMAIL = _matches(_DOCS, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}", r"not regexp_matches(prev, '[\p{L}\p{N}_]') and not regexp_matches(next, '[\p{L}\p{N}_]')")
_IP = _matches(
    _DOCS,
    r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    r"not regexp_matches(prev, '[\p{L}\p{N}_.]') and not regexp_matches(next, '[\p{L}\p{N}_]') and not regexp_matches(next2, '^[.][0-9]') and len(list_filter(string_split(surface, '.'), lambda o: cast(o as int) > 255)) = 0",
)
_FOUND = f"select id as doc_id, start, \"end\", surface, 'EMAIL' as pii_type from ({_EMAIL}) union all select id, start, \"end\", surface, 'IP_ADDRESS' from ({_IP})"
#: The longer of two that overlap stays; of these two types none do in one place but nested ones.
_SLICE = f"select * from ({_FOUND}) a where not exists (select 1 from ({_FOUND}) b where a.doc_id = b.doc_id and a.start < b.\"end\" and b.start < a.\"end\" and length(b.surface) > length(a.surface))"


def _slice_surrogate() -> str:
    """Of the surfaces in _SLICE."""
    local = "replace(string_split(lower(surface), '@')[1], '.', ' ')"
    mail = f"replace(lower({_person(local, _hash(local))}), ' ', '.') || '@' || {_pick(P.DOMAINS, _hash('lower(surface)'))}"
    ip = f"'198.51.100.' || cast({_mod(_hash('surface'), 0, 254)} + 1 as string)"
    made = f"case when pii_type = 'EMAIL' then {mail} else {ip} end"
    return f"case when regexp_matches(surface, '[A-Za-z]') and not regexp_matches(surface, '[a-z]') then upper({made}) else {made} end"


_PERSON_HIT, _PERSON_OFF, _TYPE_OFF, _EMAIL_HIT = "(id % 7 != 0 and id % 3 != 0)", "(id % 7 != 0)", "(id % 7 = 0)", "(id % 5 != 0)"


def _eval_counts(keys: str = "", rows: str = "") -> str:
    """mode, label, tp, fp, fn summed over blocks."""
    one = lambda mode, label, tp, pred, gold: f"select id, stratum, '{mode}' as mode, '{label}' as label, cast({tp} as int) as tp, cast({pred} as int) as n_pred, cast({gold} as int) as n_gold from b"
    parts = []
    for mode in ("strict", "relaxed"):
        parts.append(one(mode, "PERSON", _PERSON_HIT if mode == "strict" else _PERSON_OFF, _PERSON_OFF, "true"))
        parts.append(one(mode, "EMAIL", _EMAIL_HIT, _EMAIL_HIT, "true"))
        parts.append(one(mode, "PHONE", "false", _TYPE_OFF, "false"))
    each = " union all ".join(parts)
    return f"with b as (select o_orderkey as id, o_orderpriority as stratum from orders), e as ({each}), t as (select mode, label, stratum, sum(tp) as tp, sum(n_pred - tp) as fp, sum(n_gold - tp) as fn, sum(n_gold + n_pred) as any_ from e group by all)"


_RATES = """cast(sum(tp) + sum(fn) as bigint) as support, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn,
    round(case when sum(tp) + sum(fp) = 0 then 0.0 else sum(tp)::double / (sum(tp) + sum(fp)) end, 4) as precision,
    round(case when sum(tp) + sum(fn) = 0 then 0.0 else sum(tp)::double / (sum(tp) + sum(fn)) end, 4) as recall,
    round(case when sum(tp) = 0 then 0.0 else 2 * (sum(tp)::double / (sum(tp) + sum(fp))) * (sum(tp)::double / (sum(tp) + sum(fn))) / (sum(tp)::double / (sum(tp) + sum(fp)) + sum(tp)::double / (sum(tp) + sum(fn))) end, 4) as f1"""

ORACLES: dict[str, str] = {
    "email_spans": _EMAIL,
    "ip_spans": _IP,
    "phone_spans": _matches(
        _DOCS,
        r"\+\s?[0-9]{1,3}[\s\-]?(?:\([0-9]{1,4}\)[\s\-]?)?[0-9]{2,5}[\s\-]?[0-9]{3,5}[\s\-]?[0-9]{0,5}|0[0-9]{2,4}[\s\-][0-9]{6,8}",
        f"{_ALONE} and length({_DIGITS.format(t='surface')}) between 8 and 15",
    ),
    "card_spans": _CARDS,
    "website_spans": _matches("select cast(page_id as bigint) as id, html as text from pages", r"(?i)(?:https?://|www\.)[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+", r"not regexp_matches(prev, '[\p{L}\p{N}_]')"),
    "email_counts_by_lang": f"select lang, cast(sum(coalesce(n, 0)) as bigint) as n_emails, count(*) as n_docs from documents d left join (select id, count(*) as n from ({_EMAIL}) group by id) e on d.doc_id = e.id group by lang",
    "ssn_spans": _fixed("ssn", 8, "11", "substr(text, 9, 3) not in ('000', '666') and substr(text, 9, 1) != '9' and substr(text, 13, 2) != '00' and substr(text, 16, 4) != '0000'"),
    "pan_spans": _fixed("pan", 4, "10", "k % 3 != 0"),
    "aadhaar_spans": f"""select a.id, a.start, a."end", a.surface from ({_fixed("aadhaar", 3, "14")}) a join ({_verhoeff(_VERHOEFF_NUMBER)}) v on a.id = v.id where v.valid""",
    "din_gated": _fixed("din", 5, "8", "k % 2 = 0"),
    "cin_spans": _fixed("cin", 4, "21", "k % 5 != 0"),
    "bank_gated": _fixed("bank", 12, "12", "k % 2 = 0"),
    "dob_gated": _fixed("dob", 14, "10", "k % 2 = 0"),
    "luhn_flag": f"select id, {_LUHN.format(d='number')} as valid from (select o_orderkey as id, lpad(cast(o_orderkey as string), 10, '4') || lpad(cast(o_custkey as string), 6, '0') as number from orders)",
    "verhoeff_flag": _verhoeff(_VERHOEFF_NUMBER),
    "hash64_bucket": f"select c_custkey as id, cast({_hash('lower(c_name)')} % 1000 as bigint) as bucket from customer",
    "harvest_honorific": _NAME,
    "harvest_name_role": _NAME,
    "harvest_label_list": f"{_NAME} union select cast(c_custkey as bigint), {_word('c_custkey')} || ' ' || {_word('c_nationkey + 2000')} from customer",
    "harvest_email": f"select cast(c_custkey as bigint) as id, {_CAPPED(_word('c_custkey'))} || ' ' || {_CAPPED(_word('c_nationkey + 1000'))} as name from customer where c_custkey % 4 != 0",
    "harvest_short_block": f"{_NAME} where c_custkey % 2 = 0",
    "harvest_org_alias": f"""with o as (select cast(s_suppkey as bigint) as id, {_word('s_suppkey')} || ' ' || {_word('s_nationkey + 1000')} as head, s_suppkey % 3 as r from supplier)
        select id, head || case r when 0 then ' Private Limited' else ' Limited' end as name from o where r < 2 union select id, head from o where r < 2""",
    "person_variants": f"""with n as ({_NAME}) select id, name from n
        union select id, unnest({_list(P.VARIANT_HONORIFICS)}) || ' ' || string_split(name, ' ')[2] from n""",
    "surname_families": f"select distinct cast(c_nationkey as bigint) as nation, {_word('c_nationkey + 1000')} as surname from customer",
    # a known surname takes the capitalised words before it along
    "propagate_person": f"""with w as ({_WHO}), s as (
        select id, 0 as block, 0 as start, 'Dr. ' || who as surface from w union all select id, 1, 0, 'Later ' || upper(who) from w union all select id, 1, 6 + length(who) + 5, who from w)
        select id, cast(block as bigint) as block, cast(start as bigint) as start, cast(start + length(surface) as bigint) as "end", surface from s""",
    "propagate_by_words": f"""with w as ({_WHO}), s as (
        select id, 0 as block, 4 as start, who from w union all select id, 1, 6, who from w union all select id, 1, 6 + length(who) + 5, who from w)
        select id, cast(block as bigint) as block, cast(start as bigint) as start, cast(start + length(who) as bigint) as "end" from s""",
    "propagate_org": f"""select id, cast(10 as bigint) as start, cast(10 + length(surface) as bigint) as "end", surface from (
        select id, who || case id % 3 when 0 then ' Private Limited' else ' Limited' end as surface from ({_WHO}) where id % 3 < 2)""",
    "surname_spans": f"""select id, cast(8 as bigint) as start, cast(13 + length(n) as bigint) as "end", 'Anil ' || n as surface from (select cast(s_suppkey as bigint) as id, {_word('s_nationkey + 1000')} as n from supplier)""",
    "address_spans": f"""select id, cast(21 as bigint) as start, cast(length(text) as bigint) as "end", substr(text, 22) as surface from ({_source('address')})""",
    "allowlist_anti": "select cast(s_suppkey as bigint) as id, s_name || ' Limited' as phrase from supplier where s_suppkey % 4 > 1",
    "legislation_filter": "select cast(s_suppkey as bigint) as id, s_suppkey % 3 < 2 as legislation from supplier",
    "name_like": "select cast(c_custkey as bigint) as id, c_custkey % 5 in (0, 4) as name_like from customer",
    "resolve_overlaps": """with s as (select l_orderkey as id, cast(l_partkey % 50 as int) as a, cast(l_partkey % 50 + 1 + l_quantity as int) as b, cast(l_linenumber as string) as t from lineitem),
        r as (select id, list({'a': a, 'b': b, 't': t} order by a - b, a, t) as l from s group by id),
        k as (select id, list_reduce(l[2:], lambda acc, x: case when len(list_filter(acc, lambda y: x.a < y.b and y.a < x.b)) > 0 then acc else list_append(acc, x) end, [l[1]]) as k from r),
        u as (select id, unnest(k) as x from k)
        select id, cast(x.a as bigint) as start, cast(x.b as bigint) as "end", x.t as surface from u""",
    "redact_text": f"""with s as (select *, {_slice_surrogate()} as fake from ({_SLICE})),
        o as (select doc_id, start, "end", fake, coalesce(lag("end") over (partition by doc_id order by start), 0) as past, row_number() over (partition by doc_id order by start desc) as back from s),
        j as (select o.doc_id, string_agg(substr(d.text, past + 1, start - past) || fake, '' order by start) as head, max("end") as tail, count(*) as n from o join documents d on o.doc_id = d.doc_id group by o.doc_id)
        select j.doc_id, head || substr(d.text, tail + 1) as redacted, n as n_entities from j join documents d on j.doc_id = d.doc_id""",
    "redaction_counts": f"select pii_type, count(*) as n_entities from ({_SLICE}) group by pii_type",
    "mapping_table": f"""with s as (select *, row_number() over (partition by pii_type, lower(surface) order by doc_id, start) as k from ({_SLICE}))
        select pii_type, surface as original, {_slice_surrogate()} as surrogate from s where k = 1""",
    "type_filter_exposes_inner": """select cast(s_suppkey as bigint) as id, cast(case when s_suppkey % 2 = 0 then 0 else 5 end as bigint) as start,
        cast(case when s_suppkey % 2 = 0 then 20 else 10 end as bigint) as "end", case when s_suppkey % 2 = 0 then 'ADDRESS' else 'ORGANISATION' end as surface from supplier""",
    "eval_per_type": f"{_eval_counts()} select mode, label, {_RATES} from t where any_ > 0 group by mode, label",
    "eval_micro": f"{_eval_counts()} select mode, {_RATES} from t group by mode",
    "eval_macro": f"""{_eval_counts()}, r as (select mode, label, sum(tp)::double as a, sum(fp) as b, sum(fn) as c from t group by mode, label having sum(tp) + sum(fn) > 0),
        p as (select mode, case when a + b = 0 then 0.0 else a / (a + b) end as p, a / (a + c) as q from r)
        select mode, round(avg(p), 4) as precision, round(avg(q), 4) as recall, round(avg(case when p + q = 0 then 0.0 else 2 * p * q / (p + q) end), 4) as f1 from p group by mode""",
    "eval_stratum": f"select stratum, support, precision, recall, f1 from ({_eval_counts()} select stratum, {_RATES} from t where mode = 'relaxed' group by stratum)",
    "eval_errors": """select 'false_positive' as kind, 'PHONE' as label, count(*) as n from orders where o_orderkey % 7 = 0 having count(*) > 0
        union all select 'false_negative', 'PERSON', count(*) from orders where o_orderkey % 7 = 0 having count(*) > 0
        union all select 'false_negative', 'EMAIL', count(*) from orders where o_orderkey % 5 = 0 having count(*) > 0""",
    "token_accuracy": """select cast(sum(3 + cast(o_orderkey % 7 != 0 as int) + cast(o_orderkey % 5 != 0 as int)) as bigint) as correct, cast(5 * count(*) as bigint) as total,
        round(sum(3 + cast(o_orderkey % 7 != 0 as int) + cast(o_orderkey % 5 != 0 as int))::double / (5 * count(*)), 4) as token_accuracy from orders""",
    "locate_label": """select cast(s_suppkey as bigint) as id, cast(10 as bigint) as start, cast(case when s_suppkey % 2 = 0 then 22 else 21 end as bigint) as "end" from supplier""",
    "base64_text": "select c_custkey as id, base64(encode(c_name)) as encoded from customer",
    "escaped_pattern": "select cast(s_suppkey as bigint) as id, cast(length(regexp_replace(s_name || ' (P.) & Co', '([#().&-])', '\\\\\\1', 'g')) as bigint) as n, true as found from supplier",
} | {f"surrogate_{t.lower()}": _surrogate(t) for t in SURROGATES}

__all__ = ["LETTERS", "ORACLES"]

"""SQL for DuckDB that gives the rows of the queries, where SQL can express them.

Without SQL, and held against brute force in tests: op2_bpe, op5_quality, op8_lines (edit distance by code points), op9_ann (approximate)
and pipeline.
"""

from __future__ import annotations

from .queries import LISTED, PLANTED_CONVERSATION, PLANTED_TEXT, THIN

_WORD = r"[^\x20\x09-\x0D]+"

_SIZES = f"""
    d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) as size,
        (cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as string), '')), 1, 13) as ubigint)::double + 0.5::double) / 4503599627370496.0::double as u,
        coalesce(0.1::double + 0.9::double * length(translate(text, '#%&*$!|<>{{}}', '')) / nullif(length(text), 0), 0.1::double) as w from documents),
    s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
    n as (select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from s),
    f as (select *, source_size * 2 as cap, sum(source_size) over () as total,
        coalesce(sum(source_size * 2) over fill, 0) as capped, sum(w) over () - coalesce(sum(w) over fill, 0) as open from n
        window fill as (order by source_size * 2 / w::double, source nulls last rows between unbounded preceding and 1 preceding)),
    l as (select *, (total * 1.5::double - capped) / open as level, row_number() over (order by cap / w::double, source nulls last) as turn from f),
    e as (select min({{'turn': turn, 'level': level}}) as at from l where level * w <= cap),
    t as (select source, source_size, least(cap::double, coalesce(e.at.level * w, cap::double)) as target from l left join e on true),
    g as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t)"""

_COMPONENTS = """
    walk(id, root) as (select id, id from nodes union select l.b, w.root from walk w join links l on l.a = w.id where w.root < l.b),
    least_of as (select id, min(root) as component_id from walk group by id)"""

_RULES = (("org/", "org", "/", "allow"), ("example.org/es/", "example.org", "/es/", "block"), ("example.org/en/1", "example.org", "/en/1", "block"), ("com/fr/", "com", "/fr/", "allow"), ("com/de/", "com", "/de/", "block"))
_LISTED = ", ".join(f"('{e}')" for e in LISTED)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CANONICAL = (
    "regexp_replace(regexp_replace({host}, ':[0-9]*$', ''), '^www[.]', '')",
    "case when trim({path}, '/') = '' then '/' else '/' || trim({path}, '/') || '/' end",
)
_ESCAPED = r"length(text) + coalesce(list_sum(list_transform(regexp_extract_all(text, '\\|###|</turn>'), lambda m: length(m))), 0)"

_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    ("card", r"[0-9](?:[ -]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(length({_DIGITS})), lambda j: case when (length({_DIGITS}) - j) % 2 = 1 then cast(substr({_DIGITS}, j + 1, 1) as int)
    when cast(substr({_DIGITS}, j + 1, 1) as int) > 4 then 2 * cast(substr({_DIGITS}, j + 1, 1) as int) - 9 else 2 * cast(substr({_DIGITS}, j + 1, 1) as int) end)) % 10 = 0"""
#: Offsets add up from the pieces between matches and the matches.
_UPTO = "cast(list_sum(list_transform(g[1:i + 1], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i], lambda y: length(y))), 0) as bigint)"
_ENTITIES = f"""
    docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
    found as ({" union all ".join(f"select r, {k} as k, '{kind}' as kind, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as g from docs" for k, (kind, pattern) in enumerate(_KINDS))}),
    each as (select r, k, kind, m, g, unnest(range(len(m))) as i from found where len(m) > 0),
    placed as (select r, k, kind, {_UPTO} as s, m[i + 1] as v from each),
    ent as (select *, s + length(v) as e, k || ':' || lower(v) as x from placed where case kind when 'email' then true
        when 'ip' then len(list_filter(string_split(v, '.'), lambda o: length(ltrim(o, '0')) > 3 or coalesce(try_cast(nullif(ltrim(o, '0'), '') as int), 0) > 255)) = 0
        when 'card' then length({_DIGITS}) between 12 and 19 and {_LUHN} else length({_DIGITS}) between 9 and 15 end)"""
_TERMS = f"""
    runs as (select r, regexp_extract_all(text, '\\p{{L}}{{4,}}') as m, string_split_regex(text, '\\p{{L}}{{4,}}') as g from docs where r in (select r from ent)),
    words as (select r, m, g, unnest(range(len(m))) as i from runs where len(m) > 0),
    here as (select r, lower(m[i + 1]) as term, {_UPTO} as s, {_UPTO} + length(m[i + 1]) as e from words),
    held as (select distinct ent.r, ent.x, here.term from ent join here using (r)),
    pairs as (select x, term, count(distinct r) as n_te from held join docs using (r) group by x, term having count(distinct text) > 1),
    df as (select term, count(*) as n_t from (select unnest(list_distinct(regexp_extract_all(lower(text), '\\p{{L}}{{4,}}'))) as term from docs) where term in (select term from pairs) group by term),
    ne as (select x, count(distinct r) as n_e from ent group by x),
    n as (select count(*)::double as n from docs),
    telling as (select x, term from pairs join df using (term) join ne using (x), n
        where n_e < n and ln(n * n_te / (n_t::double * n_e)) / ln(n / n_e) >= 0.9),
    told as (select distinct ent.r, telling.term from ent join telling using (x)),
    terms as (select distinct r, s, e from here join told using (r, term)
        where not exists (select 1 from ent where ent.r = here.r and here.s < ent.e and ent.s < here.e))"""

ORACLES: dict[str, str] = {
    "op1_pii": f"""
    with {_ENTITIES}, {_TERMS},
    spans as (select r, s, e, k, kind from ent union all select r, s, e, 4, 'term' from terms),
    by_doc as (select r, {", ".join(f"count(*) filter (k = {k}) as n_{kind}" for k, (kind, _) in enumerate(_KINDS))},
        string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < 4) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans from spans group by r)
    select doc_id, {", ".join(f"coalesce(n_{kind}, 0) as n_{kind}" for kind, _ in _KINDS)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from docs left join by_doc using (r)""",
    "op3_near_vectors": f"""
    with recursive e as (select vec_id as id, embedding::double[] as x, list_max(list_transform(embedding::double[], lambda y: abs(y))) as most from embeddings),
    f as (select id, case when most > 0 then list_transform(x, lambda y: y / most) else x end as x from e),
    v as (select id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) as norm from f),
    links as (select p.id as a, q.id as b from v p, v q where p.id != q.id and p.norm > 0 and q.norm > 0 and list_inner_product(p.x, q.x) / (p.norm * q.norm) >= 0.95),
    nodes as (select id from v), {_COMPONENTS}
    select id as vec_id, (select count(*) from links where a = o.id) as n_links, component_id, id = component_id as kept from least_of o""",
    "op4_mixing": f"""
    with {_SIZES},
    k as (select d.doc_id, d.source, d.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size as room,
        row_number() over (partition by d.source order by -ln(d.u) / d.w, d.doc_id) as r from d join g on d.source is not distinct from g.source),
    p1 as (select *, 0 as last, sum(size) over (partition by source order by r) as upto from k),
    q1 as (select *, room > 0 and upto <= room as in1 from p1),
    p2 as (select * exclude (upto), coalesce(max(r) filter (in1) over (partition by source), 0) as last1, room - coalesce(sum(size) filter (in1) over (partition by source), 0) as room2 from q1),
    f2 as (select *, r > last1 and size <= room2 and room2 > 0 as fit2 from p2),
    q2 as (select *, fit2 and sum(case when fit2 then size else 0 end) over (partition by source order by r) <= room2 as in2 from f2),
    p3 as (select *, coalesce(max(r) filter (in2) over (partition by source), last1) as last2, room2 - coalesce(sum(size) filter (in2) over (partition by source), 0) as room3 from q2),
    f3 as (select *, r > last2 and size <= room3 and room3 > 0 as fit3 from p3),
    q3 as (select *, fit3 and sum(case when fit3 then size else 0 end) over (partition by source order by r) <= room3 as in3 from f3)
    select doc_id, cast(size as bigint) as size, source_size, target, cast(size * (epochs + cast(in1 or in2 or in3 as int)) as bigint) as taken from q3""",
    "op6_urls": f"""
    with p as (select page_id, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as r from pages),
    q as (select page_id, {_LOWER.format("regexp_extract(r, '^[^/?#]*')")} as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from p),
    rules(rule, h, f, v) as (values {", ".join(map(str, _RULES))}),
    entries(e) as (values {_LISTED} union all select url from pages where length(html) < {THIN}),
    whole as (select case when contains(e, '://') then substr(e, position('://' in e) + 3) else e end as r from entries where e is not null),
    parts as (select {_LOWER.format("regexp_extract(r, '^[^/?#]*')")} as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from whole),
    listed as (select distinct {_CANONICAL[0].format(host="host")} as h, {_CANONICAL[1].format(path="path")} as f from parts where {_CANONICAL[0].format(host="host")} != ''),
    best as (select page_id, max_by(rule, length(rule)) as rule, max_by(v, length(rule)) as v from q join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, f) group by page_id),
    hit as (select distinct page_id from (select page_id, {_CANONICAL[0].format(host="host")} as c, {_CANONICAL[1].format(path="path")} as path from q) join listed
        on (c = h or ends_with(c, '.' || h)) and starts_with(path, f))
    select q.page_id, host, path, rule, coalesce(v, case when hit.page_id is not null then 'block' else 'allow' end) as verdict from q left join best using (page_id) left join hit using (page_id)""",
    "op7_chat": f"""
    with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select {PLANTED_CONVERSATION}, i, ['user', 'assistant'][i + 1], '{PLANTED_TEXT}' from range(2) r(i))
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
        cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
        cast(sum(length('### ' || role || ': ') + {_ESCAPED} + length('</turn>') + 1) as bigint) as formatted_chars,
        regexp_full_match(string_agg(role, ',' order by turn, role, text), '(system,)?user,assistant(,user,assistant)*') as valid
    from c group by conv_id""",
    "op10_minhash": f"""
    with recursive w as (select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
    s as (select id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
    n as (select id, len(s) as n, s from s),
    u as (select id, n, unnest(s) as x from n),
    met as (select p.id as a, q.id as b, any_value(p.n) as n, any_value(q.n) as m, count(*) as i from u p join u q on p.x = q.x and p.id != q.id group by p.id, q.id),
    links as (select a, b from met where 100 * i >= 75 * (n + m - i)),
    nodes as (select id from n), {_COMPONENTS}
    select id as doc_id, cast(n as bigint) as n_shingles, component_id, id = component_id as kept from least_of join n using (id)""",
}

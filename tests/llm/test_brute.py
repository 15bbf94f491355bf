"""Every query against a plain version, on the smallest tables."""

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from redsieve.llm import ann, bpe, covertree, lines, minhash, mixing, pii, quality, queries, urls
from redsieve.llm.components import components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def table(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def rooted(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    return dict(table("documents")[["doc_id", "text"]].itertuples(index=False))


def luhn(digits):
    each = [int(c) for c in reversed(digits)]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(each)) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v, d: 12 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 9 <= len(d) <= 15),
}


def plain_spans(text):
    out = []
    for k, (kind, (pattern, ok)) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            if ok(m[0], re.sub("[^0-9]", "", m[0])):
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


TRICKY = [
    "a@b.c.d-e_f@g.h x@y a@@b.c @b.c 1@2.3", "p@q..r s@t.u. é@é.é a@b.é", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.01.1.1 1.2.3", "..1.1.1.1..",
    "4111 1111 1111 1111 4111-1111-1111-1111-4", "+1 (743) 555-3824. +12 +1+1 2345678901", "😀 a@b.cd 😀 1.2.3.4", "+1" + " " * 5000 + "2", "a" * 20000 + "@b", "a." * 20000 + "@b.c",
    "x@" + "a." * 20000 + "b", "1" * 30000, "1-" * 9999 + "1",
]


def test_pii_base_spans(spark, texts):
    cases = dict(texts) | {10**6 + i: t for i, t in enumerate(TRICKY)}
    df = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    for r in pii.report(df).collect():
        base = plain_spans(cases[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), r.doc_id
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_pii_disclosing_terms(spark):
    rows = [(i, f"The agent Zorblax wrote to x.y@corp.example about matter {'abcdefghijklmnopqrst'[i]}eta") for i in range(4)]
    rows += [(10 + i, f"The agent wrote about the matter {'abcdefghijklmnopqrst'[i]}eta again") for i in range(20)]
    out = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("term:10:17" in out[i] for i in range(4))
    assert all("term:4:9" not in out[i] for i in range(4))
    assert all(out[i] == "" for i in range(10, 30))
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Zorblax" not in clean[0] and "[EMAIL]" in clean[0] and clean[12] == rows[6][1]


def test_bpe_as_the_library(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    more = ["it's DON'T", "<|startoftext|>hi<|endoftext|> x", "ΑΣ İ ẞ", "a\x1cb\x85c d", "12½", "日本語 😀", "rrrr rrrrr aaaa", "\x00\x01", "é ́x", "a" * 3000, "ab" * 3000]
    cases = dict(texts) | {10**6 + i: x for i, x in enumerate(more)}
    for r in bpe.digest(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect():
        ids = t.encode(cases[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids), cases[r.doc_id][:50]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_round_trip(spark, texts):
    df = spark.createDataFrame(list(texts.items())[:20], "doc_id long, text string")
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    squeeze = lambda x: re.sub(r"\s+", "", x)
    for doc, text in back.items():
        if texts[doc].isascii():
            assert squeeze(text.replace("</w>", "")) == squeeze(texts[doc].lower())


def vectors_with_copies(n=900, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[300:600] = x[:10][rng.integers(0, 10, 300)] + rng.normal(scale=0.07, size=(300, dim))
    x[600:650] = x[0]
    return x.astype(np.float32)


def test_cover_tree_exact(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 128)
    x = vectors_with_copies()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    roots = rooted(range(len(x)), zip(*(a.tolist() for a in np.nonzero(np.triu(near))), strict=True))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for r in covertree.near_vectors(df).collect():
        assert (r.n_links, r.component_id, r.kept) == (near[r.vec_id].sum(), roots[r.vec_id], roots[r.vec_id] == r.vec_id)


def group_of(x, cells, lead, block=256):
    """Vectors as one group of the cover trees, ids as numbered."""
    rows = pd.DataFrame({"home": 0, "cell": cells, "c": np.arange(len(x)), "embedding": list(x), "weight": 1})
    (out,) = covertree._groups(block)(iter([rows]))
    return covertree._Group(out["body"][0], lead)


def test_cover_tree_on_vectors_without_structure(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cells = (x @ x[:100].T).argmax(axis=1)
    one, other = ((x[at], cells[at]) for at in (np.flatnonzero(cells < 10), np.flatnonzero((cells >= 10) & (cells < 20))))
    # near copies across the groups, some just at the threshold
    other[0][:500] = 0.95 * one[0][:500] + np.sqrt(1 - 0.95**2) * np.linspace(0.9, 1.1, 500)[:, None] * other[0][:500]
    lead = covertree._leads({64: x[:200]})[64]
    a, b = group_of(*one, lead), group_of(*other, lead)
    tried, products = 0, covertree._products

    def counted(a, b, i, j, cosine):
        nonlocal tried
        tried += len(i) * len(j)
        return products(a, b, i, j, cosine)

    monkeypatch.setattr(covertree, "_products", counted)
    found = [(int(a.ids[i]), int(b.ids[j])) for u, v in covertree._met(a, b, 0.95) for i, j in zip(u, v, strict=True)]
    back = lambda g: g.x(np.argsort(g.ids))
    want = set(zip(*(k.tolist() for k in np.nonzero(back(a) @ back(b).T >= 0.95)), strict=True))
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100
    assert tried < 0.6 * len(a.ids) * len(b.ids)


def test_cover_tree_groups_of_clusters():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(150, 40)), 8, axis=0) + rng.normal(scale=0.2, size=(1200, 40))
    x[:200] = rng.normal(size=(200, 40))
    g = group_of(x, np.repeat([0, 1, 2, 3], 300), covertree._leads({40: x[::9]})[40], block=128)
    assert any(t is None for t in g.trees) and any(t is not None for t in g.trees)
    found = [tuple(sorted((int(g.ids[i]), int(g.ids[j])))) for u, v in covertree._met(g, g, 0.95) for i, j in zip(u, v, strict=True)]
    y = g.x(np.argsort(g.ids))
    want = set(zip(*(k.tolist() for k in np.nonzero(np.triu(y @ y.T >= 0.95, 1))), strict=True))
    assert len(found) == len(set(found)) and set(found) == want and want


def test_cover_tree_homes():
    cells = {64 * covertree.PIVOTS[1] + k: n for k, n in enumerate([3, 4, 500, 2, 90])} | {7 * covertree.PIVOTS[1]: 5}
    homes = covertree._homes(cells, 10)
    assert [h[0] for h in homes] == sorted(cells)
    # one length a home; a cell that fills more than a group (a sixteenth of 599 rows) has several homes to itself
    assert [h[1:] for h in homes] == [(0, 1), (1, 1), (1, 1), (2, 14), (16, 1), (17, 3)]


def test_ann_recall(spark):
    e = table("embeddings")
    x = np.stack(e["embedding"]).astype(np.float64)
    ids = e["vec_id"].to_numpy()
    got = defaultdict(list)
    for r in queries.op9_ann(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = ids[np.lexsort((ids, -s))[: ann.TOP]]
        hits += len(set(best) & {v for v, _ in got[ids[q]]})
        total += len(best)
        for v, score in got[ids[q]]:
            assert abs(score - s[ids == v][0]) < 1e-12
    assert hits / total >= 0.9


def test_ann_recall_on_large_sample(spark):
    x = vectors_with_copies(6000, 24)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.nearest(df).collect():
        got[r.query_id].add(r.vec_id)
    x = x.astype(np.float64)
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s, kind="stable")[:20].tolist()) & got[q])
    assert hits / (20 * len(range(0, len(x), 20))) >= 0.9


def test_balanced_parts():
    x = vectors_with_copies(800)
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    part = ann.balanced_parts(np.argpartition(-near, 10, axis=1)[:, :10], 8)
    assert np.bincount(part, minlength=8).max() <= 105 + 1


def test_quality_held_out_accuracy(spark):
    known = dict(table("labels")[["doc_id", "quality"]].itertuples(index=False))
    rows = queries.op5_quality(spark, "/root/testdata/sf0.01").collect() if Path("/root/testdata/sf0.01").exists() else []
    known = dict(pd.read_parquet("/root/testdata/sf0.01/labels.parquet")[["doc_id", "quality"]].itertuples(index=False))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    told = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert np.mean([a == b for a, b in told]) >= 0.93


def test_quality_scores_by_hand(spark):
    import zstandard

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    held = [zstandard.ZstdCompressionDict(d) for d in (model.good, model.bad)]

    def by_hand(text):
        sizes = [len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text.encode())) for d in held]
        x = (sizes[1] - sizes[0]) / max(sizes) if text else 0.0
        return 1 / (1 + np.exp(-(model.slope * x + model.intercept)))

    rows = quality.score(docs, model).select("text", "score").collect()
    query = {r.doc_id: (r.score, r.predicted) for r in queries.op5_quality(spark, SF).collect()}
    assert len(rows) == len(query) and model.slope > 0
    for r in rows:
        assert r.score == pytest.approx(by_hand(r.text or ""), abs=1e-9)
    assert sorted(s for s, _ in query.values()) == pytest.approx(sorted(r.score for r in rows))
    assert all(p == (s >= 0.5) for s, p in query.values())


def edits(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, old = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return row[-1]


def test_line_links_exact(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdé 😀"), 30 + i)) for i in range(12)]
    found = set(base)
    for line in base:
        for _ in range(12):
            x = list(line)
            for _ in range(rng.integers(1, 5)):
                k, at = rng.integers(0, 3), rng.integers(0, len(x))
                x[at : at + (k != 0)] = [] if k == 1 else [rng.choice(list("abcdé"))]
            found.add("".join(x))
    rows = [(i, line) for i, line in enumerate(sorted(found))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tau in (1, 2):
        want = {frozenset((a, b)) for a, s in rows for b, t in rows if a < b and edits(s, t, tau) <= tau}
        occ = lines.occurrences(df, 8)
        ids = {r.h: r.doc_id for r in occ.collect()}
        got = {frozenset((ids[r.a], ids[r.b])) for r in lines.similar_lines(occ, tau).collect()}
        assert got == want


@pytest.mark.parametrize("hot", [2, 64])
def test_line_classes(spark, monkeypatch, hot):
    """All pairs of lines, n_links and classes; templated lines make keys hot."""
    monkeypatch.setattr(lines, "HOT", hot)
    rng = np.random.default_rng(7)
    names = ["".join(rng.choice(list("abcdé"), 5)) for _ in range(9)]
    pool = [f"Posted on 2024-{m:02d}-{d:02d} by {n}" for m in (1, 2, 11) for d in (1, 2, 21) for n in names] + ["Share", "", " ", "Share!", "x" * 24, "x" * 25, "x" * 30]
    docs = {d: "\n".join(pool[k] for k in rng.integers(0, len(pool), 8)) for d in range(60)}
    every = [(d, i, x) for d, t in docs.items() for i, x in enumerate(t.split("\n")) if x.strip()]
    first = {}
    for d, i, x in every:
        first.setdefault(x, (d, i))
    keys = sorted(first, key=lambda x: first[x])
    long = [n for n, x in enumerate(keys) if len(x) >= lines.MIN_CHARS]
    links = [(m, n) for m in long for n in long if m < n and edits(keys[m], keys[n], 2) <= 2]
    assert len(links) > 100
    roots, place = rooted(range(len(keys)), links), {x: n for n, x in enumerate(keys)}
    degree = np.bincount(np.array(links).ravel(), minlength=len(keys))
    text = {(d, i): x for d, i, x in every}
    rows = lines.line_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), short=True).collect()
    assert len(rows) == len(every)
    for r in rows:
        n = place[text[r.doc_id, r.line_no]]
        want = first[keys[roots[n]]]
        assert (r.class_doc_id, r.class_line_no, r.n_links) == (*want, degree[n]) and r.kept == (want == (r.doc_id, r.line_no))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_copies(texts):
    """The texts, and copies of some with words changed, around the threshold."""
    rng, out = np.random.default_rng(9), dict(texts)
    for k, doc in enumerate(sorted(texts)[:40]):
        words = texts[doc].split()
        for j in range(3):
            changed = list(words)
            for _ in range(max(1, len(words) // rng.integers(25, 90))):
                changed[rng.integers(0, len(changed))] = f"new{rng.integers(0, 10**9)}"
            out[10**6 + 10 * k + j] = " ".join(changed)
    return out


def test_minhash_exact(spark, texts):
    docs = near_copies(texts)
    sets = {d: shingles(t) for d, t in docs.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    roots = rooted(docs, links)
    assert len(links) > 50
    for r in minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), roots[r.doc_id])


@pytest.mark.parametrize("many", [1, 10**9])
def test_components_of_a_chain(spark, monkeypatch, many):
    monkeypatch.setattr(sys.modules["redsieve.llm.components"], "MANY_EDGES", many)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    out = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_mix_plan_and_mixture_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.mix_plan(docs).where("size > 0")
    taken = mixing.mix(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    both = plan.join(taken, "doc_id", "left").select("doc_id", F.expr("taken / size").alias("want"), F.coalesce("n", F.lit(0)).alias("got"))
    assert both.where("want != got").count() == 0
    again = mixing.mix_plan(docs.orderBy(F.rand(1)))
    assert again.exceptAll(mixing.mix_plan(docs)).count() == 0


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    bloom = urls.BlockedBloom.of_size(1 << 12)
    bloom.add(h)
    assert bloom.may_hold(h).all()
    assert bloom.may_hold(rng.integers(0, 2**64, 20_000, dtype=np.uint64)).mean() < 0.01


def test_pipeline_stages(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(spark.createDataFrame(stage(spark, seen[-1], SF).toPandas()) if len(seen) < 5 else stage(spark, seen[-1], SF))
        if len(seen) <= 5:
            assert set(seen[-1].columns) == set(docs.columns)
    good, lined, unique, mixed, ids = (df.toPandas() for df in seen[1:])
    assert 0.7 * len(texts) < len(good) < len(texts)
    kept = [x for t in lined["text"] if t for x in t.split("\n") if len(x) >= lines.MIN_CHARS]
    assert len(kept) == len(set(kept))
    sets = [shingles(t) for t in unique["text"]]
    assert not any(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a)
    assert mixed.groupby("doc_id").size().max() <= 2 and set(mixed["doc_id"]) <= set(unique["doc_id"])
    assert len(ids) == len(mixed)
    run = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(run["ids_sha256"]) == sorted(ids["ids_sha256"])


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_by_rounds_and_at_once(spark, monkeypatch, few):
    from redsieve.llm import components as C

    monkeypatch.setattr(C, "FEW_EDGES", few)
    # a path in random order, a star, ids that floats don't hold, loops, nulls and repeats
    big, nodes = 1 << 62, random.Random(4).sample(range(10_000), 300)
    edges = [*zip(nodes, nodes[1:]), *((20_000, 20_001 + i) for i in range(50)), (big + 1, big), (-5, -9), (7_777_777, 7_777_777), (None, 3), (-5, -9)]
    out = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert out == {n: min(nodes) for n in nodes} | {n: 20_000 for n in range(20_000, 20_051)} | {big: big, big + 1: big, -5: -9, -9: -9}


def test_rounds_of_few_edges_need_no_shuffle(spark, monkeypatch):
    from redsieve.llm import components as C

    plans = []
    monkeypatch.setattr(C, "settle", lambda df, name, settle=C.settle: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df, name))
    C.components(spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long"), "a", "b").collect()
    assert len(plans) > 2 and "hashpartitioning" in plans[0] and not any("hashpartitioning" in p for p in plans[1:])

"""Near-duplicate vectors: dual traversal of cover trees, exact for a cosine threshold.

For unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c). Each
block of vectors gets a cover tree: nested levels whose radii halve, every node a
vector that is the centre of what hangs below it, with its true covering radius. A
pair of blocks is traversed from both roots. A pair of nodes is dropped when their
distance less both covering radii is over the threshold; what is left goes down to the
vectors, which are compared in double precision. A node's centre is its first child, so
levels are nested; centres of one level are apart by its radius under one parent.

Levels that gather next to nothing, as those of vectors without structure, are left out:
there the vectors hang below the root. Of two such blocks only vectors are compared that
are no farther from the other's centre than its covering angle and the threshold's
together, first by their leading coordinates: with the lengths of the rest as one more
coordinate, these have an inner product of at least the cosine. No pair is lost by that.

Above the blocks stand two coarser levels. Vectors are put to the nearest of a bounded
number of pivots, which grows with the table. A cell's vectors are cut into blocks by
halving them between two far ends, then by their angle to the centre. Cells that follow
each other are near in space, and are packed into groups of bounded size. Each two groups
whose covering angles leave room meet in one row, read from their files without a shuffle;
there, pairs of blocks are dropped by their centres alone.

Links are counted where they are found, and each pair of groups gives one row for
each of its linked vectors, with the least vector it hangs together with there. So a
group of copies costs rows in proportion to its size, not to its square. Equal
vectors are one vector with a weight before all this.

Defined results: null or zero vectors, and such with null or non-finite
components, link with nothing; components may be as small or large as finite numbers
are; vectors of different length never link; rows with one
vec_id are different vectors of that id, each with its own row, and linked with it
if alike; rows with a null vec_id take part, and are never kept; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import rows_a_batch, settle
from .vectors import unit, valid

COSINE = 0.95
BLOCK = 1024
#: Vectors that others are dealt to, the first by a digest of their id: one for each two blocks that the table fills, within these bounds.
PIVOTS = (16, 4096)
#: No more pivots of one length than fill so many bytes, but for the least number.
PIVOT_BYTES = 16 << 20
#: A group is a sixteenth of the table, but at least two blocks and at most so many bytes of floats.
GROUPS, GROUP_BYTES = 16, 8 << 20
LEVELS = 6
#: Leading coordinates by which vectors are compared first.
LEAD = 23
#: Node pairs that are compared at once.
CHUNK = 1 << 15
#: Pairs found that are kept until they are joined.
KEPT = 1 << 20
_SLACK = 1e-7
#: What a cosine in single precision may be off, at least and for each component, with room to spare.
_SLACK_SINGLE = (1e-5, 2e-7)


class CoverTree:
    """Level by level: the centre (a row) of each node, its covering radius, its parent, and where its children are."""

    def __init__(self, x: np.ndarray):
        self.x = x
        top = np.zeros(1, np.int64)
        owner = np.zeros(len(x), np.int64)
        dist = self._to(np.arange(len(x)), np.zeros(len(x), np.int64))
        self.levels = [(top, np.array([dist.max()]))]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        radius = 1.0
        for _ in range(LEVELS if self._gathers() else 0):
            centres, owner_new, parent, far = [], np.empty(len(x), np.int64), [], []
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(len(self.levels[-1][0]) + 1))
            for node in range(len(self.levels[-1][0])):
                rest = order[bounds[node] : bounds[node + 1]]
                # nested: a node's own centre is the first centre below it
                own = self.levels[-1][0][node]
                rest = np.concatenate([[own], rest[rest != own]])
                while len(rest):
                    d = np.sqrt(np.maximum(0.0, 2 - 2 * (x[rest] @ x[rest[0]])))
                    d[0] = 0.0
                    near = d <= radius
                    owner_new[rest[near]] = len(centres)
                    far.append(d[near].max())
                    centres.append(rest[0])
                    parent.append(node)
                    rest = rest[~near]
            self.levels.append((np.array(centres), np.array(far)))
            self.children.append(self._spans(np.array(parent), len(self.levels[-2][0])))
            owner, radius = owner_new, radius / 2
        order = np.argsort(owner, kind="stable")
        self.levels.append((order, np.zeros(len(x))))
        self.children.append(self._spans(owner[order], len(self.levels[-2][0])))

    def _gathers(self) -> bool:
        """Whether most vectors have another within the first level's radius."""
        x = self.x.astype(np.float32)
        alone = sum(int((np.count_nonzero(x[s : s + BLOCK] @ x.T >= 0.5, axis=1) <= 1).sum()) for s in range(0, len(x), BLOCK))
        return 4 * alone <= len(x)

    def packed(self) -> bytes:
        return pickle.dumps((self.levels, self.children))

    @classmethod
    def of(cls, x: np.ndarray, packed: bytes) -> CoverTree:
        out = cls.__new__(cls)
        out.x = x
        out.levels, out.children = pickle.loads(packed)
        return out

    def _to(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", self.x[a], self.x[b])))

    @staticmethod
    def _spans(parent: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children; children of one node are next to each other."""
        count = np.bincount(parent, minlength=n)
        return np.concatenate([[0], np.cumsum(count)[:-1]]), count


def _product(at: tuple[np.ndarray, np.ndarray], bt: tuple[np.ndarray, np.ndarray], ia: np.ndarray, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the pairs (ia, ib)."""
    na, nb = at[1][ia], bt[1][ib]
    each = na * nb
    k = np.repeat(np.arange(len(ia)), each)
    off = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return at[0][ia][k] + off // nb[k], bt[0][ib][k] + off % nb[k]


def dual(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of pairs (row of a, row of b) with at least that cosine, each pair once."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    last = len(a.levels) - 1
    while stack:
        level, ia, ib = stack.pop()
        if len(ia) > CHUNK:
            for s in range(0, len(ia), CHUNK):
                stack.append((level, ia[s : s + CHUNK], ib[s : s + CHUNK]))
            continue
        (ca, ra), (cb, rb) = a.levels[level], b.levels[level]
        cos = np.einsum("ij,ij->i", a.x[ca[ia]], b.x[cb[ib]])
        if level == last:
            ok = cos >= cosine
            if ok.any():
                yield ca[ia[ok]], cb[ib[ok]]
            continue
        d = np.sqrt(np.maximum(0.0, 2 - 2 * cos))
        go = d - ra[ia] - rb[ib] <= eps + _SLACK
        ia, ib = ia[go], ib[go]
        each = a.children[level][1][ia] * b.children[level][1][ib]
        big = each >= 1024
        stack.extend((level + 1, *found) for k in np.flatnonzero(big) for found in _wide(a, b, level, ia[k], ib[k], eps))
        ia, ib, each = ia[~big], ib[~big], np.cumsum(each[~big])
        s = 0
        while s < len(ia):
            e = max(s + 1, int(np.searchsorted(each, (each[s - 1] if s else 0) + 8 * CHUNK, side="right")))
            stack.append((level + 1, *_product(a.children[level], b.children[level], ia[s:e], ib[s:e])))
            s = e


def _wide(a: CoverTree, b: CoverTree, level: int, na: int, nb: int, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of all pairs of children of two nodes with many, those that aren't dropped, by matrix products."""
    (a0, an), (b0, bn) = ((t.children[level][0][k], t.children[level][1][k]) for t, k in ((a, na), (b, nb)))
    (ca, ra), (cb, rb) = a.levels[level + 1], b.levels[level + 1]
    right = b.x[cb[b0 : b0 + bn]].T
    for s in range(a0, a0 + an, 256):
        e = min(s + 256, a0 + an)
        room = eps + _SLACK + ra[s:e, None] + rb[None, b0 : b0 + bn]
        i, j = np.nonzero(2 - 2 * (a.x[ca[s:e]] @ right) <= room * room)
        if len(i):
            yield i + s, j + b0


def _least_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it hangs together with by edges (u, v)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], least)
        np.minimum.at(new, root[v], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class _Group:
    """A row of the groups, as arrays: all vectors as units in single precision, their leading coordinates, and the blocks."""

    def __init__(self, body: bytes, lead: np.ndarray | None):
        self.ids, self.weight, self.raw, scale, self.starts, self.centres, self.angles, self.trees = pickle.loads(body)
        self.single = unit(self.raw).astype(np.float32) if scale is None else self.raw * scale[:, None]
        self.slack = max(_SLACK_SINGLE[0], _SLACK_SINGLE[1] * self.single.shape[1])
        first = self.single[:, :LEAD] if lead is None else self.single @ lead.astype(np.float32)
        self.lead = np.empty((len(first), first.shape[1] + 1), np.float32)
        self.lead[:, :-1] = first
        # the rest is never taken for shorter than it is
        self.lead[:, -1] = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", first, first)) + self.slack)

    def x(self, rows: np.ndarray | slice) -> np.ndarray:
        """Rows as units in double precision."""
        return unit(self.raw[rows].astype(np.float64))

    def block(self, k: int) -> slice:
        return slice(self.starts[k], self.starts[k + 1])

    def tree(self, k: int) -> CoverTree:
        if isinstance(self.trees[k], bytes):
            self.trees[k] = CoverTree.of(self.x(self.block(k)), self.trees[k])
        return self.trees[k]

    def near(self, other: _Group, eps: float) -> np.ndarray:
        """For each block of the other one, which vectors may have a vector of it within the angle eps."""
        least = np.cos(np.minimum(np.pi, other.angles + eps)) - self.slack
        return other.centres.astype(np.float32) @ self.single.T >= least[:, None].astype(np.float32)


def _products(a: _Group, b: _Group, i: np.ndarray, j: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of pairs of the rows i of a and j of b with at least that cosine."""
    left, right = a.lead[i], b.lead[j].T
    least = np.float32(cosine - a.slack)
    for s in range(0, len(i), 256):
        # at most 256 x BLOCK
        found = np.flatnonzero(left[s : s + 256] @ right >= least)
        for f in range(0, len(found), CHUNK):
            at = found[f : f + CHUNK]
            u, v = i[at // len(j) + s], j[at % len(j)]
            ok = np.einsum("ij,ij->i", a.x(u), b.x(v)) >= cosine
            yield u[ok], v[ok]


def _met(a: _Group, b: _Group, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of pairs (row of a, row of b) with at least that cosine; of one group with itself each pair once, the lesser row first."""
    eps = float(np.arccos(np.clip(cosine, -1, 1))) + _SLACK
    near_a, near_b = a.near(b, eps), b.near(a, eps)
    apart = np.arccos(np.clip(a.centres @ b.centres.T, -1, 1))
    for k, m in zip(*(x.tolist() for x in np.nonzero(apart <= a.angles[:, None] + b.angles[None, :] + eps)), strict=True):
        if a is b and k > m:
            continue
        sa, sb = a.block(k), b.block(m)
        if a.trees[k] is not None and b.trees[m] is not None:
            found = ((u + sa.start, v + sb.start) for u, v in dual(a.tree(k), b.tree(m), cosine))
        else:
            found = _products(a, b, np.flatnonzero(near_a[m, sa]) + sa.start, np.flatnonzero(near_b[k, sb]) + sb.start, cosine)
        for u, v in found:
            if a is b:
                once = u < v
                u, v = u[once], v[once]
            if len(u):
                yield u, v


def _linked(cosine: float, leads: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, _Group] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                # rows of one group come one after another
                if r.group_a not in held:
                    held = {r.group_a: _Group(r.body_a, leads.get(r.dim))}
                a = held[r.group_a]
                same = r.group_a == r.group_b
                b = a if same else _Group(r.body_b, leads.get(r.dim))
                n = len(a.ids)
                nodes = a.ids if same else np.concatenate([a.ids, b.ids])
                weight = a.weight if same else np.concatenate([a.weight, b.weight])
                order = np.argsort(nodes, kind="stable")
                place = np.empty(len(nodes), np.int64)
                place[order] = np.arange(len(nodes))
                root, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
                some: list[tuple[np.ndarray, np.ndarray]] = []

                def joined() -> np.ndarray:
                    """The roots known, joined by the pairs kept, of which a forest is left."""
                    u, v = (place[np.concatenate([p[k] for p in some])] for k in (0, 1))
                    return _least_of(len(nodes), np.concatenate([np.arange(len(nodes)), u]), np.concatenate([root, v]))

                for u, v in _met(a, b, cosine):
                    v = v if same else v + n
                    np.add.at(links, u, weight[v])
                    np.add.at(links, v, weight[u])
                    some.append((u, v))
                    if sum(len(p[0]) for p in some) >= KEPT:
                        root, some = joined(), []
                root = joined() if some else root
                at = np.flatnonzero(links)
                yield pd.DataFrame({"node": nodes[at], "links": links[at], "root": nodes[order][root[place[at]]]})

    return run


def _halves(x: np.ndarray, rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows in runs of at most that many, near in space: the half nearer to one of two far ends, and the other half, as long as it takes."""
    if len(rows) <= most:
        yield rows
        return
    one = rows[np.argmin(x[rows] @ x[rows[0]])]
    other = rows[np.argmin(x[rows] @ x[one])]
    order = np.argsort(x[rows] @ (x[one] - x[other]), kind="stable")
    yield from _halves(x, rows[order[: len(rows) // 2]], most)
    yield from _halves(x, rows[order[len(rows) // 2 :]], most)


def _centre(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The direction of the mean, or of the first row if there is none, and the cosines of all rows to it."""
    mean = x.mean(axis=0)
    length = np.linalg.norm(mean)
    centre = mean / length if length > 1e-6 else x[0]
    return centre, x @ centre


def _groups(block: int):
    """Rows (home, cell, c, embedding, weight), sorted by home and cell, as one row for each home, with its blocks and their trees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(home: int, dim: int, held: list) -> pd.DataFrame:
            cells, ids, weight = (np.array([h[k] for h in held], np.int64) for k in (0, 1, 3))
            raw = np.stack([np.asarray(h[2], np.float64) for h in held])
            x = unit(raw)
            with np.errstate(over="ignore"):
                small = raw.astype(np.float32)
            # vectors that floats hold travel as floats
            raw = small if (small == raw).all() else raw
            laid, starts, centres, angles, trees = [], [0], [], [], []
            for cell in np.split(np.arange(len(x)), np.flatnonzero(np.diff(cells)) + 1):
                for part in _halves(x, cell, 4 * block):
                    centre, cos = _centre(x[part])
                    order = np.argsort(-cos, kind="stable")
                    for shell in np.array_split(order, -(-len(part) // block)):
                        tree = CoverTree(x[part[shell]])
                        laid.append(part[shell])
                        starts.append(starts[-1] + len(shell))
                        centres.append(centre)
                        angles.append(np.arccos(np.clip(cos[shell].min(), -1, 1)))
                        trees.append(tree.packed() if len(tree.levels) > 2 else None)
            at = np.concatenate(laid)
            centre, cos = _centre(x)
            # factors that make units of floats, where these are neither very small nor very large
            with np.errstate(over="ignore"):
                length = np.linalg.norm(raw, axis=1)
            fair = raw.dtype == np.float32 and (length > 1e-15).all() and (length < 1e15).all()
            scale = (1 / length[at]).astype(np.float32) if fair else None
            body = pickle.dumps((ids[at], weight[at], raw[at], scale, starts, np.array(centres), np.array(angles), trees), protocol=5)
            return pd.DataFrame([{"group": home, "dim": dim, "centre": centre, "angle": float(np.arccos(np.clip(cos.min(), -1, 1))), "body": body}])

        key, held = None, []
        for batch in batches:
            for home, cell, c, x, weight in batch[["home", "cell", "c", "embedding", "weight"]].itertuples(index=False, name=None):
                now = (home, len(x))
                if held and now != key:
                    yield out(*key, held)
                    held = []
                key = now
                held.append((cell, c, x, weight))
        if held:
            yield out(*key, held)

    return run


def _homes(cells: dict[int, int], block: int) -> list[tuple[int, int, int]]:
    """(cell, first home, number of homes): cells of one length that follow each other share a home as long as they fit; a larger one has several."""
    whole: dict[int, int] = defaultdict(int)
    for cell, n in cells.items():
        whole[cell // PIVOTS[1]] += n
    out, home, room, last = [], -1, 0, None
    for cell, n in sorted(cells.items()):
        dim = cell // PIVOTS[1]
        most = max(1, min(max(2 * block, math.ceil(whole[dim] / GROUPS)), GROUP_BYTES // (4 * dim)))
        if dim != last or n > room:
            home, room, last = home + 1, most, dim
        parts = math.ceil(n / most)
        out.append((cell, home, parts))
        home, room = home + parts - 1, 0 if parts > 1 else room - n
    return out


def _pivots(rows: DataFrame, k: int) -> dict[int, np.ndarray]:
    """At most k vectors for each of the lengths found, near ones next to each other; of very many lengths, the rest is dealt to one cell each by the length alone."""
    out: dict[int, np.ndarray] = {}
    for dim in [r[0] for r in rows.select("dim").distinct().limit(64).collect()]:
        most = min(k, max(PIVOTS[0], PIVOT_BYTES // (8 * dim)))
        got = rows.where(F.col("dim") == dim).orderBy(F.md5(F.col("c").cast("string"))).limit(most).select("embedding").toLocalIterator()
        x = unit(np.array([r[0] for r in got], np.float64))
        out[dim] = x[np.concatenate(list(_halves(x, np.arange(len(x)), 1)))]
    return out


def _leads(pivots: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each length orthonormal directions, those along which its pivots are longest."""
    return {dim: np.linalg.svd(p[:512], full_matrices=False)[2][:LEAD].T for dim, p in pivots.items()}


def _dealt(pivots: dict[int, np.ndarray]):
    """c, weight, embedding, cell; cells are numbered by length and nearest pivot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        single = {dim: p.astype(np.float32).T for dim, p in pivots.items()}
        for batch in batches:
            cell = np.zeros(len(batch), np.int64)
            for dim, group in batch.groupby("dim"):
                at = batch.index.get_indexer(group.index)
                cell[at] = int(dim) * PIVOTS[1]
                if (p := single.get(int(dim))) is not None:
                    x = unit(np.stack([np.asarray(e, np.float64) for e in group["embedding"]])).astype(np.float32)
                    cell[at] += np.concatenate([(x[s : s + 1024] @ p).argmax(axis=1) for s in range(0, len(x), 1024)])
            yield pd.DataFrame({"c": batch["c"].to_numpy(), "weight": batch["weight"].to_numpy(), "embedding": batch["embedding"].to_numpy(), "cell": cell})

    return run


def near_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row for each row of embeddings."""
    spark = embeddings.sparkSession
    sound = valid(embeddings).withColumn("c", F.xxhash64("embedding"))
    classes = settle(
        sound.groupBy("c").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight")).withColumn("dim", F.size("embedding")),
        "vectors",
    )
    pivots = _pivots(classes, min(max(PIVOTS[0], math.ceil(classes.count() / (2 * BLOCK))), PIVOTS[1]))
    put = settle(classes.select("c", "embedding", "weight", "dim").mapInPandas(_dealt(pivots), "c long, weight long, embedding array<double>, cell long"), "dealt")
    # a row for each pivot
    cells = {r["cell"]: r["n"] for r in put.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    homes = spark.createDataFrame(_homes(cells, BLOCK), "cell long, first long, parts int")
    home = (F.col("first") + F.pmod(F.xxhash64("c"), F.col("parts"))).alias("home")
    spread = put.join(F.broadcast(homes), "cell").select(home, "cell", "c", "embedding", "weight").repartition("home")
    schema = "group long, dim int, centre array<double>, angle double, body binary"
    with rows_a_batch(spark, 2048):
        groups = settle(spread.sortWithinPartitions("home", "cell", "c").mapInPandas(_groups(BLOCK), schema), "groups")
    side = lambda s: groups.select(*(F.col(c).alias(f"{c}_{s}") for c in groups.columns))
    cos = "aggregate(zip_with(centre_a, centre_b, (x, y) -> x * y), 0D, (s, z) -> s + z)"
    eps = float(np.arccos(min(1.0, max(-1.0, cosine)))) + _SLACK
    # each two groups once, half of them from either side; a difference, as an equation would make a shuffle of it
    once = "if((group_a + group_b) % 2 = 0, group_a <= group_b, group_a > group_b) and dim_a - dim_b = 0"
    room = f"(group_a = group_b or acos(greatest(-1D, least(1D, {cos}))) - angle_a - angle_b <= {eps}D)"
    met = side("a").join(side("b").hint("shuffle_replicate_nl"), F.expr(f"{once} and {room}")).select("group_a", "body_a", "group_b", "body_b", F.col("dim_a").alias("dim"))
    with rows_a_batch(spark, 1, read=2):
        found = settle(met.mapInPandas(_linked(cosine, _leads(pivots)), "node long, links long, root long"), "found")
    roots = settle(components(found, "node", "root"), "vector-roots")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = (
        classes.select(F.col("c").alias("node"), F.col("vec_id").alias("least"), "weight")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .select("node", "least", F.coalesce("links", F.lit(0)).alias("links"), "weight", F.coalesce("root", "node").alias("root"))
    )
    of = settle(of, "vector-of")
    least = settle(of.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of = of.join(least, "root").select(F.col("node").alias("c"), (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    every = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sound = valid(every)
    keyed = sound.select("vec_id", F.xxhash64("embedding").alias("c")).join(of, "c").select("vec_id", "n_links", "component_id")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    alone = every.where(~F.coalesce(ok, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = keyed.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

"""Embedding near-duplicates: exact threshold links by dual traversal of cover trees.

Distinct vectors are dealt to balls around pivots, and balls to blocks. Each block becomes a cover
tree: nested levels of halving radius whose nodes know their exact covering radius. Trees meet only
where their balls come within the threshold; such pairs are traversed level by level: a pair of nodes
whose distance exceeds the threshold by more than both radii is pruned, one that lies within it by as
much is accepted whole, and only what is left is compared vector by vector.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.llm.common import table
from ontoweave.plans.components import components
from ontoweave.plans.storage import discard, materialize

#: Pairs of vectors that are compared at once.
CHUNK = 100_000


@dataclass(frozen=True)
class CoverTree:
    """Parameters.

    cosine: least cosine of a link. pivots: most vectors (those with the smallest hash, one for every
    ``block``) that stand at the top of all trees and deal the others to balls. block: vectors of a
    block, whatever the input; a larger ball is split by hash. levels: halvings of the radius below
    the root's 2. tasks: most partitions for pairs of blocks.
    """

    cosine: float = 0.9
    pivots: int = 4096
    block: int = 8192
    levels: int = 4
    tasks: int = 4096


def build(raw: np.ndarray, levels: int) -> dict[str, np.ndarray]:
    """A cover tree over the rows of ``raw``.

    ``order`` puts rows in tree order, so that every node is a range of rows; level by level,
    ``centre``, ``start``, ``end`` and ``radius`` describe the nodes and ``child`` the range of their
    children one level down. Children of a node lie more than their level's radius apart and cover
    all its rows within it; a node's centre is also a child's centre (the levels are nested).
    """
    unit = (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float64)
    nodes = [(0, np.arange(len(raw)))]
    out: dict[str, np.ndarray] = {}
    made = [nodes]
    child_ranges = []
    for level in range(1, levels + 1):
        bound = 1.0 - (2.0 / 2**level) ** 2 / 2  # least dot product within the radius
        below, ranges = [], []
        for centre, rows in nodes:
            begin = len(below)
            left, c = rows, centre
            while True:
                near = unit[left] @ unit[c] >= bound
                near |= left == c
                below.append((c, left[near]))
                left = left[~near]
                if not len(left):
                    break
                c = left[0]
            ranges.append((begin, len(below)))
        child_ranges.append(np.array(ranges, dtype=np.int32))
        nodes = below
        made.append(nodes)
    order = np.concatenate([rows for _, rows in made[-1]])
    place = np.empty(len(raw), dtype=np.int32)
    place[order] = np.arange(len(raw))
    ends = np.cumsum([len(rows) for _, rows in made[-1]])
    starts, stops = ends - np.array([len(rows) for _, rows in made[-1]]), ends
    for level in range(levels, -1, -1):
        if level < levels:
            r = child_ranges[level]
            starts, stops = starts[r[:, 0]], stops[r[:, 1] - 1]
        centre = np.array([c for c, _ in made[level]])
        radius = np.array([np.sqrt(max(0.0, 2 - 2 * float((unit[rows] @ unit[c]).min()))) for c, rows in made[level]]) + 1e-7
        radius[stops - starts == 1] = 0.0
        out |= {f"centre{level}": place[centre], f"start{level}": starts.astype(np.int32), f"end{level}": stops.astype(np.int32), f"radius{level}": radius}
        if level < levels:
            out[f"child{level}"] = child_ranges[level]
    return out | {"order": order}


class _Sets:
    """Disjoint sets over 0..n-1, joined in bulk; the least member names a set."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.label[u], self.label[v]
            differ = a != b
            if not differ.any():
                return
            u, v, a, b = u[differ], v[differ], a[differ], b[differ]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.label, high, low)
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


class Pair:
    """Dual traversal of two trees, or of one with itself; sums weighted links and joins components."""

    def __init__(self, a: dict, b: dict, p: CoverTree, same: bool):
        self.a, self.b, self.p, self.same = a, b, p, same
        self.eps = float(np.sqrt(2 - 2 * p.cosine))
        self.shift = 0 if same else len(a["ids"])
        n = len(a["ids"]) + (0 if same else len(b["ids"]))
        self.links = np.zeros(n, dtype=np.int64)
        self.sets = _Sets(n)
        for t in (a, b):
            if "unit" not in t:
                t["raw"] = t["raw"].astype(np.float64)
                t["norm"] = np.linalg.norm(t["raw"], axis=1)
                t["unit"] = t["raw"] / t["norm"][:, None]
                t["unit32"] = t["unit"].astype(np.float32)
                t["heavy"] = np.concatenate([[0], np.cumsum(t["weight"])])
        zero = np.zeros(1, dtype=np.int64)
        self._descend(0, zero, zero)

    def _descend(self, level: int, x: np.ndarray, y: np.ndarray) -> None:
        """Node pairs ``(x, y)`` of one level that could not be pruned."""
        a, b = self.a, self.b
        if level == self.p.levels:
            self._leaves(a[f"start{level}"][x], a[f"end{level}"][x], b[f"start{level}"][y], b[f"end{level}"][y])
            return
        cx, cy = a[f"child{level}"][x], b[f"child{level}"][y]
        wide = (cx[:, 1] - cx[:, 0]).astype(np.int64) * (cy[:, 1] - cy[:, 0])
        big = wide > 50_000
        for i in np.flatnonzero(big):
            self._tile(level + 1, *cx[i], *cy[i])
        small = np.flatnonzero(~big)
        for part in np.array_split(small, max(1, int(wide[small].sum() // CHUNK) + 1)) if len(small) else []:
            u, v = _product(cx[part], cy[part])
            self._sift(level + 1, u, v)

    def _tile(self, level: int, x0: int, x1: int, y0: int, y1: int) -> None:
        """All children of one wide pair, by blocks of matrix products; rows are bounded in single precision first."""
        a, b = self.a, self.b
        while level < self.p.levels and max(a[f"radius{level}"][x0:x1].max(), b[f"radius{level}"][y0:y1].max()) > 2 * self.eps:
            # nodes this wide prune nothing; their children, hardly more, do
            x, y = a[f"child{level}"], b[f"child{level}"]
            x0, x1, y0, y1, level = x[x0, 0], x[x1 - 1, 1], y[y0, 0], y[y1 - 1, 1], level + 1
        columns = y0 + np.argsort(b[f"radius{level}"][y0:y1], kind="stable")
        radius = b[f"radius{level}"][columns]
        single = int((radius == 0).sum())  # columns of like radius share a bound; most nodes are single vectors
        cuts = [0, *([single] if single else []), *range(single + 128, len(columns), 128), len(columns)]
        for c0, c1 in zip(cuts, cuts[1:]):
            cols = columns[c0:c1]
            if not len(cols):
                continue
            q = b["unit32"][b[f"centre{level}"][cols]].T
            widest = float(radius[c1 - 1])
            for at in range(x0, x1, 512):
                rows = np.arange(at, min(at + 512, x1))
                reach = np.minimum(self.eps + a[f"radius{level}"][rows] + widest, 2.0)
                dots = a["unit32"][a[f"centre{level}"][rows]] @ q
                u, v = np.nonzero(dots >= (1 - reach * reach / 2 - 1e-5).astype(np.float32)[:, None])
                for k in range(0, len(u), CHUNK):
                    self._sift(level, rows[u[k : k + CHUNK]], cols[v[k : k + CHUNK]])

    def _sift(self, level: int, x: np.ndarray, y: np.ndarray) -> None:
        """Prune, accept whole, or descend."""
        a, b = self.a, self.b
        dots = np.einsum("ij,ij->i", a["unit"][a[f"centre{level}"][x]], b["unit"][b[f"centre{level}"][y]])
        far = np.sqrt(np.maximum(0.0, 2 - 2 * dots))
        reach = a[f"radius{level}"][x] + b[f"radius{level}"][y]
        whole = far + reach <= self.eps - 1e-6
        a0, a1, b0, b1 = a[f"start{level}"][x], a[f"end{level}"][x], b[f"start{level}"][y], b[f"end{level}"][y]
        many = (a1 - a0).astype(np.int64) * (b1 - b0) > 256
        for i in np.flatnonzero(whole & many):
            self._accept(a0[i], a1[i], b0[i], b1[i])
        few = whole & ~many  # comparing these is cheaper than accepting them one by one
        if few.any():
            self._leaves(a0[few], a1[few], b0[few], b1[few])
        open_ = ~whole & (far <= self.eps + reach + 1e-6)
        if open_.any():
            self._descend(level, x[open_], y[open_])

    def _accept(self, a0: int, a1: int, b0: int, b1: int) -> None:
        a, b = self.a, self.b
        self.links[a0:a1] += b["heavy"][b1] - b["heavy"][b0]
        if self.same:
            lo, hi = max(a0, b0), min(a1, b1)
            if lo < hi:  # not with itself
                self.links[lo:hi] -= a["weight"][lo:hi]
        else:
            self.links[self.shift + b0 : self.shift + b1] += a["heavy"][a1] - a["heavy"][a0]
        members = np.concatenate([np.arange(a0, a1), self.shift + np.arange(b0, b1)])
        self.sets.join(np.full(len(members), members[0]), members)

    def _leaves(self, a0, a1, b0, b1) -> None:
        """Vector by vector, in double precision."""
        a, b = self.a, self.b
        cx, cy = np.stack([a0, a1], axis=1), np.stack([b0, b1], axis=1)
        wide = (a1 - a0).astype(np.int64) * (b1 - b0)
        for part in np.array_split(np.arange(len(a0)), max(1, int(wide.sum() // CHUNK) + 1)):
            for k in part[wide[part] > CHUNK]:  # one wide pair by rows
                for at in range(a0[k], a1[k], 32):
                    self._compare(*_product(np.array([[at, min(at + 32, a1[k])]]), cy[k : k + 1]))
            rest = part[wide[part] <= CHUNK]
            if len(rest):
                self._compare(*_product(cx[rest], cy[rest]))

    def _compare(self, x: np.ndarray, y: np.ndarray) -> None:
        a, b = self.a, self.b
        cos = np.einsum("ij,ij->i", a["raw"][x], b["raw"][y]) / (a["norm"][x] * b["norm"][y])
        ok = cos >= self.p.cosine
        if self.same:
            ok &= x != y
        x, y = x[ok], y[ok]
        if not len(x):
            return
        np.add.at(self.links, x, b["weight"][y])
        if not self.same:
            np.add.at(self.links, self.shift + y, a["weight"][x])
        self.sets.join(x, self.shift + y)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked vectors' ids, their links, and the id that names their component here."""
        ids = self.a["ids"] if self.same else np.concatenate([self.a["ids"], self.b["ids"]])
        on = np.flatnonzero(self.links > 0)
        return ids[on], self.links[on], ids[self.sets.label[on]]


def _product(cx: np.ndarray, cy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of each pair of ranges."""
    nx, ny = (cx[:, 1] - cx[:, 0]).astype(np.int64), (cy[:, 1] - cy[:, 0]).astype(np.int64)
    total = nx * ny
    which = np.repeat(np.arange(len(total)), total)
    within = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return cx[which, 0] + within // ny[which], cy[which, 0] + within % ny[which]


def _dump(tree: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **tree)
    return out.getvalue()


def _load(blob: bytes) -> dict:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def links(vectors: DataFrame, p: CoverTree = CoverTree()) -> tuple[DataFrame, DataFrame]:
    """``(id, links)`` and ``(u, v)``: weighted links of distinct ``(id, weight, vector)`` rows of one length, and edges that span their components."""
    n = vectors.count()
    order = F.xxhash64("id")
    tops = vectors.select("id", "vector").orderBy(order, "id").limit(max(1, min(p.pivots, -(-n // p.block)))).collect()
    pivot = np.array([r["vector"] for r in tops], dtype=np.float64).reshape(len(tops), -1)
    pivot = pivot / np.linalg.norm(pivot, axis=1, keepdims=True) if len(pivot) else pivot

    def nearest(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(2))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                home = (x.astype(np.float32) @ pivot.astype(np.float32).T).argmax(axis=1)
                far = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", x, pivot[home])))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), pa.array(far)], ["id", "weight", "vector", "home", "far"])

    dealt = materialize(vectors.select("id", "weight", "vector").mapInArrow(nearest, "id long, weight long, vector array<double>, home int, far double"), "vectors")
    balls = dealt.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()  # at most ``pivots`` rows
    homes = len(pivot)
    radius, parts = np.full(homes, -np.inf), np.zeros(homes, dtype=np.int64)
    for r in balls:
        radius[r["home"]], parts[r["home"]] = r["radius"], -(-r["n"] // p.block)
    first = np.cumsum(parts) - parts
    blocks = int(max(1, parts.sum()))
    home_of = np.repeat(np.arange(homes), parts)
    # Balls farther apart than the threshold hold no pair; the other balls' blocks meet.
    between = np.sqrt(np.maximum(0.0, 2 - 2 * (pivot @ pivot.T))) if homes else np.zeros((0, 0))
    meets = between <= np.sqrt(2 - 2 * p.cosine) + radius[:, None] + radius[None, :] + 1e-6
    np.fill_diagonal(meets, True)
    at = F.array(*[F.lit(int(v)) for v in first])
    of = F.array(*[F.lit(max(1, int(v))) for v in parts])
    block = (F.element_at(at, F.col("home") + 1) + F.pmod(F.xxhash64("id", F.lit(1)), F.element_at(of, F.col("home") + 1))).cast("int")

    def grow(batches):
        cols = [(b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2)), b.column(3).to_numpy()) for b in batches if b.num_rows]
        if not cols:
            return
        ids, weight, raw, where = (np.concatenate(c) for c in zip(*cols))
        for k in np.unique(where):
            mine = np.flatnonzero(where == k)
            mine = mine[np.argsort(ids[mine], kind="stable")]
            tree = build(raw[mine], p.levels)
            o = mine[tree.pop("order")]
            single = raw[o].astype(np.float32)  # what came as single precision travels as such
            blob = _dump(tree | {"ids": ids[o], "weight": weight[o], "raw": single if (single == raw[o]).all() else raw[o]})
            me = int(k)
            for other in np.flatnonzero(meets[home_of[me]][home_of]).tolist():
                low, high = min(me, other), max(me, other)
                pair = high * (high + 1) // 2 + low
                yield pa.RecordBatch.from_arrays([pa.array([pair], pa.int64()), pa.array([me], pa.int32()), pa.array([blob], pa.binary())], ["pair", "block", "tree"])

    def meet(batches):
        held = None
        for b in batches:
            for pair, blob in zip(b.column(0).to_pylist(), b.column(2)):
                tree = _load(blob.as_py())
                low = int((np.sqrt(8 * pair + 1) - 1) // 2)
                alone = low * (low + 3) // 2 == pair
                if alone:
                    found = Pair(tree, tree, p, True).rows()
                elif held is not None and held[0] == pair:
                    found = Pair(held[1], tree, p, False).rows()
                    held = None
                else:
                    held = (pair, tree)
                    continue
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["id", "links", "root"])

    pairs = blocks * (blocks + 1) // 2
    tasks = min(pairs, p.tasks)
    trees = dealt.select("id", "weight", "vector", block.alias("block")).repartitionById(blocks, F.col("block")).mapInArrow(grow, "pair long, block int, tree binary")
    met = trees.repartitionById(tasks, F.pmod("pair", F.lit(tasks)).cast("int")).sortWithinPartitions("pair", "block").mapInArrow(meet, "id long, links long, root long")
    met = materialize(met, "links")
    discard(dealt)
    return met.groupBy("id").agg(F.sum("links").alias("links")), met.select(F.col("id").alias("u"), F.col("root").alias("v"))


def near_duplicates(vectors: DataFrame, p: CoverTree = CoverTree(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each input row.

    Rows whose vector is null, empty, zero, or holds null or non-finite components, and rows without
    an id, link with nothing. Vectors of different lengths never link; each length is traversed by
    itself. Equal vectors are reduced to one of their weight before trees are built; repeated rows
    count as vectors of their own. Vectors whose squares would leave the range of doubles are scaled
    by a power of two, which changes no cosine. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0)
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    scale = F.when((largest > 1e100) | (largest < 1e-100), F.pow(F.lit(2.0), -F.floor(F.log2(largest)))).otherwise(F.lit(1.0))
    rows = rows.withColumn("sound", sound).withColumn("scale", F.when(F.col("sound"), scale))
    rows = rows.withColumn("vector", F.when(F.col("sound"), F.transform("vector", lambda x: x * F.col("scale") + F.lit(0.0))))
    # Rows find their group by two hashes of its vector, so that vectors are not moved again.
    rows = rows.select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.hash("vector").alias("h2"))
    groups = rows.where("vector IS NOT NULL").groupBy("h1", "h2", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
    groups = materialize(groups, "distinct-vectors")
    lengths = [r["n"] for r in groups.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    sums, edges = None, None
    for n in lengths:
        s, e = links(groups.where(F.size("vector") == n), p)
        sums, edges = (s, e) if sums is None else (sums.unionByName(s), edges.unionByName(e))
    if sums is None:
        sums = spark.createDataFrame([], "id long, links long")
        edges = spark.createDataFrame([], "u long, v long")
    found = components(edges)
    least = found.groupBy("component").agg(F.min("node").alias("component_id"))
    linked = found.join(least, "component").select(F.col("node").alias("id"), "component_id")
    whole = groups.select("h1", "h2", "id", "weight").join(sums, "id", "left").join(linked, "id", "left")
    whole = whole.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    own = rows.select("vec_id", F.when(F.col("vector").isNotNull(), F.col("h1")).alias("h1"), "h2")
    out = own.join(whole, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_covertree(spark, sf_dir: str) -> DataFrame:
    """All embeddings at cosine 0.9 or more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_10 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
c AS (SELECT u, least(u, min(w)) AS component_id FROM r GROUP BY u),
k AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN k ON k.u = vec_id LEFT JOIN c ON c.u = vec_id
"""

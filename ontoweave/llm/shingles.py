"""Near-duplicates by the exact similarity of word shingles, on top of SimHash ball hashing.

Every text gets a SimHash of its shingles; fingerprints within three bits meet by ball hashing, and
the texts that meet are compared on all shingles. Similar texts can lie many bits apart, so what ball
hashing can't reach is completed by prefix filtering, which misses no pair: shingles are ordered by
how many texts hold them, rare ones first, and two texts of similarity t share a shingle among the
first n - ceil(t n) + 1 of each. All shingles are counted by an exchange of their hashes; those that
one text has alone make no candidates. Candidates that connect are compared together in a task, or,
if they are too many, by joins. Links become components.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.llm import simhash
from ontoweave.llm.common import by_key, frugal, give_back, kept, keyed_texts, slices
from ontoweave.plans.components import components
from ontoweave.plans.storage import discard, materialize

#: One shingle of a text's prefix: its hash, the text, the number of the text's shingles, its place among them.
RECORD = np.dtype([("key", "<u8"), ("node", "<u8"), ("size", "<u4"), ("at", "<u4")])

#: Shingles are counted by their upper 48 bits; the lower 16 of a packed record name the text, or, under this bit, say how many of a slice hold it.
SEVERAL = 1 << 15

#: Texts that share a shingle are all paired up to so many; the candidates' graph has a chain of more.
SMALL = 16


@dataclass(frozen=True)
class Shingling:
    """Parameters.

    words: of a shingle. similarity: least Jaccard similarity of the sets of shingles. local: bytes of
    shingles of connected candidates that one task compares; more are compared by joins. stars, few:
    rounds of these joins in which a shingle's texts are compared with one of them only, at most and
    while more pairs than ``few`` a record are left to compare. block: bytes of records that a part
    holds. fps_per_part: fingerprints whose variants a part holds. All but the first two change the
    work, not the result. sample, common: of no effect any more, all shingles are counted.
    """

    words: int = 5
    similarity: float = 0.8
    sample: int = 5_000
    common: int = 1 << 16
    local: int = 8 << 20
    stars: int = 4
    few: int = 4
    block: int = 16 << 20
    fps_per_part: int = 12_000


class _Hashes(dict):
    """64-bit hashes of words, forgotten when there are many."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 1 << 16:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_HASHES = _Hashes()
kept(__name__, _HASHES.clear)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def node_of(words: list[bytes]) -> int:
    """The text's name: equal for texts with the same words."""
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words; of the whole text if it is shorter."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    g = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        g = (g ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    return np.unique(g)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _binary(column) -> list[bytes]:
    return pc.cast(column, pa.binary()).to_pylist()


def sliced(texts: DataFrame, p: Shingling) -> DataFrame:
    """Slices of the rows: ``ids``, ``nodes`` and ``fps`` (SimHash of the shingles) of each row, and what is compared.

    That is ``text``, each different text with a shingle's words once (fewer are alike only if equal),
    joined and compressed, ``held``, their names, and ``ends``, where they end.
    """

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for b in slices(batches):
            own = _binary(b.column(1))
            nodes, fps, first = np.empty(len(own), dtype=np.uint64), np.empty(len(own), dtype=np.uint64), {}
            for i, t in enumerate(own):
                w = words_of(t)
                nodes[i], fps[i] = node_of(w), simhash.fingerprint(shingle_set(w, p.words))
                if len(w) >= p.words:
                    first.setdefault(int(nodes[i]), i)
            held = list(first.values())
            text, ends = b"".join(own[i] for i in held), np.cumsum([len(own[i]) for i in held], dtype=np.int64)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            ids = pa.concat_arrays([b.column(0)])
            lists = [one(ids), one(pa.array(nodes.view(np.int64))), one(pa.array(fps.view(np.int64)))]
            blobs = [nodes[held].tobytes(), ends.tobytes(), pa.compress(text, codec="zstd", asbytes=True)]
            yield pa.RecordBatch.from_arrays([pa.array([at]), *lists, *(pa.array([x], pa.binary()) for x in blobs)], ["slice", "ids", "nodes", "fps", "held", "ends", "text"])
            at += 1

    return texts.mapInArrow(frugal(run), "slice long, ids array<long>, nodes array<long>, fps array<long>, held binary, ends binary, text binary")


def _read_slice(held: bytes, ends: bytes, text: bytes, p: Shingling) -> tuple[np.ndarray, list[np.ndarray]]:
    """The slice's different texts and their shingles."""
    stops = np.frombuffer(ends, dtype=np.int64).tolist()
    whole = pa.decompress(text, decompressed_size=stops[-1], codec="zstd", asbytes=True)
    return np.frombuffer(held, dtype=np.uint64), [shingle_set(words_of(whole[a:b]), p.words) for a, b in zip([0, *stops], stops)]


def _packed(nodes: np.ndarray, sets: list[np.ndarray], parts: int):
    """The slice's different shingles as packed records in the order of their parts, that order, the parts' counts, and each shingle's place before it."""
    key, first, place, n = np.unique(np.concatenate(sets) >> np.uint64(16), return_index=True, return_inverse=True, return_counts=True)
    owner = np.repeat(nodes, [len(x) for x in sets])[first] & np.uint64(SEVERAL - 1)
    rec = key << np.uint64(16) | np.where(n > 1, np.minimum(n, SEVERAL - 1).astype(np.uint64) | np.uint64(SEVERAL), owner)
    part = ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part.astype(np.uint16 if parts <= 65536 else np.uint32), kind="stable")
    return rec[order], order, np.bincount(part.astype(np.int64), minlength=parts), place


def frequencies(rec: np.ndarray) -> np.ndarray:
    """For each packed record how frequent its shingle is, on a scale of eight steps a doubling; 0 only if one text has it and no copy of that is elsewhere."""
    order = np.argsort(rec)
    s = rec[order]
    key, low = s >> np.uint64(16), (s & np.uint64(0xFFFF)).astype(np.int64)
    new = np.ones(len(s), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    other = np.ones(len(s), dtype=bool)
    other[1:] = s[1:] != s[:-1]
    several = low >= SEVERAL
    head = np.flatnonzero(new)
    n = np.add.reduceat(np.where(several, low - SEVERAL, other), head)
    scale = 1 + np.minimum(254, 8 * np.log2(n)).astype(np.uint8)
    alone = np.diff(np.append(head, len(s))) == 1
    scale[alone & ~several[head]] = 0
    out = np.empty(len(s), dtype=np.uint8)
    out[order] = np.repeat(scale, np.diff(np.append(head, len(s))))
    return out


def counted(cut: DataFrame, parts: int, p: Shingling) -> DataFrame:
    """``(slice, part, scale)``: the frequencies, over all slices, of each slice's shingles that fall into the part."""

    def emit(batches):
        for b in batches:
            for at, *row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0]:
                    rec, _, n, _ = _packed(*_read_slice(*row, p), parts)
                    ends, own = np.cumsum(n), np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.full(len(own), at)), pa.array([rec[ends[x] - n[x] : ends[x]].tobytes() for x in own], pa.binary())], ["part", "slice", "blob"])

    def run(batches):
        rows: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            for part, at, x in zip(*(c.to_pylist() for c in b.columns)):
                rows.setdefault(part, []).append((at, x))
        for part in list(rows):
            own = rows.pop(part)
            scale = frequencies(np.concatenate([np.frombuffer(x, dtype=np.uint64) for _, x in own]))
            ends = np.cumsum([0, *(len(x) // 8 for _, x in own)])
            blobs = [pa.compress(scale[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([at for at, _ in own]), pa.array([part] * len(own), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "part", "scale"])

    dealt = cut.select("slice", "held", "ends", "text").mapInArrow(frugal(emit), "part int, slice long, blob binary").repartitionById(parts, F.col("part"))
    return dealt.mapInArrow(frugal(run), "slice long, part int, scale binary")


def prefix_of(shingles: np.ndarray, scale: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The places, rare ones first, of those shingles that any text as similar must share one of, without those that no other text has."""
    n = len(shingles)
    rare_first = np.argsort(scale, kind="stable")[: n - math.ceil(similarity * n - 1e-9) + 1]
    at = np.flatnonzero(scale[rare_first])
    return rare_first[at], at


def candidates(cut: DataFrame, scales: DataFrame, parts: int, p: Shingling) -> DataFrame:
    """``(node, size, keys, at, shingles)`` of every different text that shares a shingle of its prefix, or has copies."""

    def run(batches):
        for b in batches:
            for held, ends, text, own in zip(*(c.to_pylist() for c in b.columns)):
                nodes, sets = _read_slice(held, ends, text, p)
                _, order, n, place = _packed(nodes, sets, parts)
                scale = np.empty(len(order), dtype=np.uint8)
                blobs = [np.frombuffer(pa.decompress(x["scale"], decompressed_size=int(n[x["part"]]), codec="zstd", asbytes=True), dtype=np.uint8) for x in sorted(own, key=lambda x: x["part"])]
                scale[order] = np.concatenate(blobs)
                scale = scale[place]
                rows, a = [], 0
                for node, s in zip(nodes.view(np.int64).tolist(), sets):
                    which, at = prefix_of(s, scale[a : a + len(s)], p.similarity)
                    a += len(s)
                    if len(at):
                        rows.append((node, len(s), s[which].tobytes(), at.astype(np.uint32).tobytes(), s.tobytes()))
                if rows:
                    node, size, *blobs = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(size, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], ["node", "size", "keys", "at", "shingles"])

    of = scales.groupBy("slice").agg(F.collect_list(F.struct("part", "scale")).alias("scales"))
    both = cut.select("slice", "held", "ends", "text").join(of, "slice").select("held", "ends", "text", "scales")
    return both.mapInArrow(frugal(run), "node long, size int, keys binary, at binary, shingles binary").dropDuplicates(["node"])


def _records(batches):
    """The batches' prefix records, 2^20 or few more at a time."""
    pieces, n = [], 0
    for b in batches:
        for node, size, keys, at in zip(*(c.to_pylist() for c in b.columns)):
            rec = np.empty(len(keys) // 8, dtype=RECORD)
            rec["key"], rec["node"], rec["size"], rec["at"] = np.frombuffer(keys, np.uint64), np.int64(node).astype(np.uint64), size, np.frombuffer(at, np.uint32)
            pieces.append(rec)
            n += len(rec)
            if n >= 1 << 20:
                yield np.concatenate(pieces)
                pieces, n = [], 0
    if pieces:
        yield np.concatenate(pieces)


def chained(rec: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of texts, one a row, that connect what sharing a shingle and sizes that allow the similarity connect.

    Up to ``SMALL`` texts of a shingle are all paired if they may be alike; more are chained by size, which
    connects all whose sizes allow it and so, at least, all that are alike.
    """
    rec = rec[np.lexsort((rec["node"], rec["size"], rec["key"]))]
    key, node, size, left = rec["key"], rec["node"].view(np.int64) if len(rec) else rec["node"].astype(np.int64), rec["size"].astype(np.float64), (rec["size"] - rec["at"]).astype(np.float64)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(rec) else np.empty(0, dtype=np.int64)
    few = np.repeat(np.diff(np.append(head, len(rec))) <= SMALL, np.diff(np.append(head, len(rec))))
    pairs = []
    for d in range(1, SMALL):
        a = np.flatnonzero(key[d:] == key[:-d])
        if d > 1:
            a = a[few[a]]
        if not len(a):
            break
        b = a + d
        ok = size[a] >= similarity * size[b] - 1e-6
        ok &= ~few[a] | (np.minimum(left[a], left[b]) >= similarity / (1 + similarity) * (size[a] + size[b]) - 1e-6)
        pairs.append(np.stack([np.minimum(node[a[ok]], node[b[ok]]), np.maximum(node[a[ok]], node[b[ok]])], axis=1))
    return np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), dtype=np.int64)


def may_connect(found: DataFrame, parts: int, p: Shingling) -> DataFrame:
    """Edges ``(u, v)`` of a graph in which all texts that are alike are connected; few others are."""

    def emit(batches):
        for rec in _records(batches):
            part = ((rec["key"] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            rec, n = rec[order], np.bincount(part.astype(np.int64), minlength=parts)
            ends, own = np.cumsum(n), np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([rec[ends[x] - n[x] : ends[x]].tobytes() for x in own], pa.binary())], ["part", "blob"])

    def run(batches):
        blobs = [x for b in batches for x in b.column(1).to_pylist()]
        if blobs:
            pairs = chained(np.concatenate([np.frombuffer(x, dtype=RECORD) for x in blobs]), p.similarity)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], ["u", "v"])

    return found.select("node", "size", "keys", "at").mapInArrow(frugal(emit), "part int, blob binary").repartitionById(parts, F.col("part")).mapInArrow(frugal(run), "u long, v long")


def linked(nodes: list[int], keys: list[np.ndarray], at: list[np.ndarray], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that span all that alike texts connect. A text is compared with those that share a shingle of its prefix and are not yet reached."""
    n = len(nodes)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), [len(k) for k in keys])
    key, left = np.concatenate(keys), np.concatenate([len(s) - a.astype(np.int64) for s, a in zip(sets, at)])
    order = np.argsort(key, kind="stable")
    owner, left, key = owner[order], left[order], key[order]
    fresh, out = np.ones(n, dtype=bool), []
    for start in range(n):
        reached = [start] if fresh[start] else []
        fresh[start] = False
        while reached and fresh.any():
            x = reached.pop()
            lo, hi = np.searchsorted(key, keys[x]), np.searchsorted(key, keys[x], side="right")
            near = [np.empty(0, dtype=np.int64)]
            for a, b, mine in zip(lo.tolist(), hi.tolist(), (size[x] - at[x].astype(np.int64)).tolist()):
                y = owner[a:b]
                near.append(y[fresh[y] & (np.minimum(left[a:b], mine) >= similarity / (1 + similarity) * (size[y] + size[x]) - 1e-6)])
            near = np.unique(np.concatenate(near))
            near = near[np.minimum(size[near], size[x]) >= similarity * np.maximum(size[near], size[x]) - 1e-6]
            for y in near.tolist():
                if alike(sets[x], sets[y], similarity):
                    fresh[y] = False
                    reached.append(y)
                    out.append((nodes[x], nodes[y]))
    return out


def local_links(members: DataFrame, parts: int, p: Shingling) -> DataFrame:
    """Links ``(u, v)`` that span the classes of alike texts within each ``component``; a task compares a component."""

    def run(batches):
        def solved(rows):
            node, keys, at, sets = zip(*rows)
            of = lambda x, kind: [np.frombuffer(y, dtype=kind) for y in x]
            pairs = linked(list(node), of(keys, np.uint64), of(at, np.uint32), of(sets, np.uint64), p.similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

        last, rows = None, []
        for b in batches:
            for component, *row in zip(*(c.to_pylist() for c in b.columns)):
                if component != last and rows:
                    yield solved(rows)
                    rows = []
                last = component
                rows.append(row)
        if rows:
            yield solved(rows)

    dealt = members.select("component", "node", "keys", "at", "shingles").repartition(parts, "component").sortWithinPartitions("component")
    return dealt.mapInArrow(frugal(run), "u long, v long")


def ball_pairs(nodes: DataFrame, p: Shingling) -> DataFrame:
    """``(u, v)``: texts whose fingerprints are equal or meet by ball hashing, each with one text of the fingerprint."""
    reps = materialize(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "similar-reps")
    n = reps.count()
    parts = max(1, -(-n // p.fps_per_part), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")) if n > 1000 else 1)
    met = simhash.collide(simhash.emit_variants(reps.select("fp").repartition(max(1, -(-n // 4096))), parts), parts).distinct()
    a, b = reps.select(F.col("fp").alias("u"), F.col("rep").alias("ru")), reps.select(F.col("fp").alias("v"), F.col("rep").alias("rv"))
    far = met.join(a, "u").join(b, "v").select("ru", "rv")
    near = nodes.join(reps, "fp").where("node <> rep").select(F.col("node").alias("ru"), F.col("rep").alias("rv"))
    pairs = far.union(near).select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
    out = materialize(pairs, "similar-pairs")
    discard(reps)
    return out


def _possible(a: str, b: str, p: Shingling):
    """The sizes and the shingles left behind the shared one allow the similarity."""
    a_size, b_size = F.col(f"{a}.size"), F.col(f"{b}.size")
    left = F.least(a_size - F.col(f"{a}.at"), b_size - F.col(f"{b}.at"))
    # Shingles before the shared one may be shared too, but then the texts meet in the first of these.
    return (F.least(a_size, b_size) >= F.lit(p.similarity) * F.greatest(a_size, b_size) - 1e-6) & (left >= F.lit(p.similarity / (1 + p.similarity)) * (a_size + b_size) - 1e-6)


def _verified(pairs: DataFrame, found: DataFrame, p: Shingling) -> DataFrame:
    """The pairs ``(u, v)`` of texts that are alike."""
    u, v = found.select(F.col("node").alias("u"), F.col("shingles").alias("a")), found.select(F.col("node").alias("v"), F.col("shingles").alias("b"))

    def run(batches):
        for b in slices(batches):
            ok = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), p.similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return materialize(pairs.join(u, "u").join(v, "v").select("u", "v", "a", "b").mapInArrow(frugal(run), "u long, v long"), "similar-links")


def links(members: DataFrame, found: DataFrame, p: Shingling) -> DataFrame:
    """Pairs ``(u, v)`` of alike texts that connect all that alike texts connect.

    This is for members of components too large for a task; ``found`` are links that are known. First
    every shingle's texts are compared with one of them, of the largest component there, another one
    each round, which links large groups of near copies by as many pairs as texts. At last all pairs
    that share a shingle and are still in different components are compared, so no link between
    components is missed.
    """

    def spread(batches):
        for rec in _records(batches):
            cols = [rec["key"].astype(np.int64), rec["node"].astype(np.int64), rec["size"].astype(np.int32), rec["at"].astype(np.int32)]
            for at in range(0, len(rec), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in cols], ["key", "node", "size", "at"])

    rows = materialize(members.select("node", "size", "keys", "at").mapInArrow(frugal(spread), "key long, node long, size int, at int"), "similar-rows")
    total = rows.count()
    met = rows.groupBy("node").agg(F.count(F.lit(1)).alias("met"))
    fields = ["node", "size", "at"]
    for r in range(p.stars + 1):
        group = components(found).withColumnRenamed("component", "g")
        now = rows.join(group, "node", "left").withColumn("c", F.coalesce("g", "node")).drop("g")
        if not r:  # the text that meets most others, if there is a hub it is that one
            now = now.join(met, "node")
        now = materialize(now, "similar-now")
        prefer = -F.col("met") if not r else F.lit(0).cast("long")
        pick = F.min(F.struct(prefer.alias("m"), F.xxhash64("key", "node", F.lit(r)).alias("h"), *fields)).alias("pick")
        parts = now.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"), pick)
        keys = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.max(F.struct("n", (-F.col("pick.m")).alias("m"), "pick", "c")).alias("top"))
        keys = materialize(keys.where("parts > 1").select("key", F.col("top.c").alias("c"), ((F.col("n") * F.col("n") - F.col("squares")) / 2).alias("left"), *(F.col(f"top.pick.{x}").alias(x) for x in fields)), "similar-stars")
        left = keys.agg(F.sum("left")).first()[0] or 0
        last = r == p.stars or left <= p.few * total
        if left:
            a, b = (now if last else keys).alias("a"), now.alias("b")
            if last:
                a = now.join(keys.select("key"), "key", "left_semi").alias("a")
            way = F.col("a.node") < F.col("b.node") if last else F.col("a.node") != F.col("b.node")
            met_in = a.join(b, F.col("a.key") == F.col("b.key")).where(way & (F.col("a.c") != F.col("b.c")) & _possible("a", "b", p))
            pairs = materialize(met_in.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct(), "similar-pairs")
            found = found.union(_verified(pairs, members, p))
            discard(pairs)
        discard(now)
        discard(keys)
        give_back(members.sparkSession)
        if last or not left:
            break
    discard(rows)
    return found


def similar_documents(docs: DataFrame, p: Shingling = Shingling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, component_id)`` for each input row.

    Texts link if the sets of their shingles have at least the similarity; ``component_id`` is the
    smallest doc_id reachable through links, itself included. Only A-Z are lower-cased; words are
    runs of anything but ASCII white space. A text with fewer words than a shingle links to
    equal ones only, as wordless and null texts do. Repeated doc_ids give one row each, and a row
    without doc_id gets the smallest other doc_id of its component, or null; an empty table gives no
    rows. Shingles of one text are held in a task, 8 bytes a word.
    """
    spark, texts = docs.sparkSession, keyed_texts(docs, id_col, text_col)
    cut = materialize(sliced(texts, p), "similar-slices")
    named = materialize(cut.select(F.inline(F.arrays_zip("ids", "nodes", "fps"))).toDF("doc_id", "node", "fp"), "similar-nodes")
    least = materialize(named.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.count(F.lit(1)).alias("copies")), "similar-least")
    n, size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    enough = int(spark.conf.get("spark.sql.shuffle.partitions")) if n > 1000 else 1
    first = ball_pairs(least.select("node", "fp"), p)
    give_back(spark)
    # A word and its space take some six bytes.
    parts = max(enough, math.ceil(size / 6 * 8 / p.block))
    scales = materialize(counted(cut, parts, p), "similar-scales")
    give_back(spark)
    found = materialize(candidates(cut, scales, parts, p), "similar-candidates")
    discard(cut)
    discard(scales)
    give_back(spark)
    total = found.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * 8
    parts = max(enough, math.ceil(total / p.block))
    near = components(may_connect(found, parts, p))
    group = materialize(near.join(found.select("node", "size"), "node"), "similar-groups")
    too_large = F.sum(F.col("size").cast("long") * 8) > p.local
    sized = materialize(group.groupBy("component").agg(too_large.alias("large")), "similar-sizes")
    members = found.join(group.join(sized, "component").select("node", "component", "large"), "node")
    joined = _verified(first, found, p).union(materialize(local_links(members.where("not large"), parts, p), "similar-local"))
    if not sized.where("large").isEmpty():
        large = materialize(members.where("large"), "similar-large")
        joined = links(large, joined, p)
        discard(large)
    linked_by = components(joined)
    for t in (first, found, group, sized):
        discard(t)
    member = linked_by.join(least, "node").select("node", "component", "least")
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    classed = member.join(smallest, "component").select("node", "component_id")
    whole = least.join(classed, "node", "left").select("node", "copies", F.coalesce("component_id", "least").alias("component_id"))
    return by_key(named.drop("fp"), materialize(whole, "similar-components"), "node", n).select("doc_id", "component_id")

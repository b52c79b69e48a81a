"""Suffix-array deduplication of repeated byte strings.

A byte is removed if it lies in a string of ``width`` bytes that also starts in a document with a
smaller id. Every such string holds an anchor: a gram whose hash is least in it. Grams that only one
document has are dropped first; the suffixes at all other anchors are sorted within blocks of
documents, exchanged as front-coded runs, and merged by loser trees that compare two suffixes only
beyond the prefix they are known to share. The merged order and its common prefixes tell which
strings around an anchor occur in a smaller document.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.llm.common import slices, table
from ontoweave.plans.storage import materialize, shared_dir

NO_ID = np.iinfo(np.int64).max
_PRIME = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1
SHARED, SMALLER, HOT = 1, 2, 4
#: Bytes of text that are hashed at once; their arrays stay in the cache.
SLICE = 1 << 16


@dataclass(frozen=True)
class Repeats:
    """Parameters.

    width: bytes of a repeated string. gram: bytes of an anchor; a string has ``width - gram + 1``
    places for one. block: bytes of text that are sorted together. part: bytes of text per merging
    task. hot: documents from which on a gram's strings are dealt one by one instead of by gram, so
    that what a third of all documents hold does not meet in one task.
    """

    width: int = 50
    gram: int = 16
    block: int = 8 << 20
    part: int = 16 << 20
    hot: int = 4096

    @property
    def back(self) -> int:
        return self.width - self.gram


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes in columns of equal significance, compressed."""
    flat = [(str(a.dtype), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"") for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(flat))


def _unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        d = np.dtype(kind)
        out.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(d.itemsize, -1).T).view(d).reshape(-1) if raw else np.empty(0, dtype=d))
    return out


def gram_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes at each place, built from powers of two of bytes."""
    by = {1: text.astype(np.uint64) + np.uint64(1)}
    power, s = {1: _PRIME}, 1
    while 2 * s <= k:
        by[2 * s] = by[s][:-s] * np.uint64(power[s]) + by[s][s:]
        power[2 * s] = power[s] * power[s] & _WORD
        s *= 2
    h, done = None, 0
    for s in sorted(by, reverse=True):
        if done + s <= k:
            if h is None:
                h = by[s]
            else:
                n = len(by[s]) - done
                h = h[:n] * np.uint64(power[s]) + by[s][done : done + n]
            done += s
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _slide(a: np.ndarray, w: int, f) -> np.ndarray:
    """``f`` over every ``w`` neighbours."""
    s = 1
    while 2 * s <= w:
        a = f(a[:-s], a[s:])
        s *= 2
    return f(a[: len(a) - (w - s)], a[w - s :]) if s < w else a


def anchors(text: np.ndarray, ends: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least in some string of ``width`` bytes of one document.

    ``ends`` are the documents' ends in the text. All least grams of a string are anchors, so equal
    strings have equal anchors; strings that cross an end are none.
    """
    if len(text) < p.width:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    h = gram_hashes(text, p.gram) | np.uint64(1)
    w = p.back + 1
    least = _slide(h, w, np.minimum)
    n = len(least)
    cross = np.zeros(n + 1, dtype=np.int32)
    inner = ends[ends < len(text)]
    np.add.at(cross, np.clip(inner - p.width + 1, 0, n), 1)
    np.subtract.at(cross, np.minimum(inner, n), 1)
    least[np.cumsum(cross[:-1]) > 0] = 0
    edge = np.zeros(w - 1, dtype=np.uint64)
    at = np.flatnonzero(h <= _slide(np.concatenate([edge, least, edge]), w, np.maximum))
    return at, h[at]


class Block:
    """Some documents' bytes, their anchors, and what is asked and answered about them."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, text: np.ndarray, p: Repeats):
        self.ids, self.ends, self.text, self.p = ids, ends, text, p
        starts = np.concatenate([[0], ends[:-1]])
        at, gram = [], []
        first = 0
        while first < len(ends):  # some documents at a time bound the memory
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE, side="right")))
            a, b = starts[first], ends[last - 1]
            x, h = anchors(text[a:b], ends[first:last] - a, p)
            at.append(x + a), gram.append(h)
            first = last
        self.at = np.concatenate(at) if at else np.empty(0, dtype=np.int64)
        self.gram = np.concatenate(gram) if gram else np.empty(0, dtype=np.uint64)
        self.doc = np.searchsorted(ends, self.at, side="right").astype(np.int32)
        self.starts, self.padded = starts, None
        order = np.lexsort((ids[self.doc], self.gram))
        g, i = self.gram[order], ids[self.doc][order]
        fresh = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, dtype=bool)
        first = np.flatnonzero(fresh)
        other = fresh.copy()
        if len(g):
            other[1:] |= i[1:] != i[:-1]
        self.entry_gram, self.entry_least = g[first], i[first]
        self.entry_docs = np.add.reduceat(other.astype(np.uint32), first) if len(first) else np.empty(0, dtype=np.uint32)
        self.entry = np.empty(len(g), dtype=np.int64)
        self.entry[order] = np.cumsum(fresh) - 1

    def questions(self, parts: int):
        """Per part: the distinct grams, their least document and number of documents."""
        part = (self.entry_gram >> np.uint64(40)) % np.uint64(parts)
        for k in np.unique(part):
            mine = part == k
            yield int(k), _pack(self.entry_gram[mine], self.entry_least[mine], self.entry_docs[mine])

    def take_flags(self, flags: dict[int, np.ndarray], parts: int) -> None:
        """The answers to ``questions``, in their order; then the suffixes to sort."""
        p = self.p
        part = (self.entry_gram >> np.uint64(40)) % np.uint64(parts)
        flag = np.zeros(len(part), dtype=np.uint8)
        for k, a in flags.items():
            flag[part == k] = a
        occ = np.flatnonzero(flag[self.entry] & SHARED)
        hot = (flag[self.entry[occ]] & HOT) > 0
        cold = occ[~hot]
        keys, where = [], []
        for a in range(0, len(cold), 50_000):
            o = cold[a : a + 50_000]
            keys.append(self._keys(self.at[o], self.doc[o], self.gram[o], parts, True))
            where.append(np.stack([self.at[o], self.doc[o]], axis=1))
        hot_at, hot_doc = self._hot_windows(occ[hot])
        for a in range(0, len(hot_at), 50_000):
            s, d = hot_at[a : a + 50_000], hot_doc[a : a + 50_000]
            keys.append(self._keys(s, d, None, parts, False))
            where.append(np.stack([s, d], axis=1))
        size = 4 + p.width + 1 + p.back + 1
        distinct, inverse, base = [], [], 0
        for k in keys:  # equal contexts of a slice first, then of the block
            u, inv = np.unique(k, return_inverse=True)
            distinct.append(u), inverse.append(inv.reshape(-1) + base)
            base += len(u)
        every = np.concatenate(distinct) if distinct else np.empty(0, dtype=f"S{size}")
        self.items, again = np.unique(every, return_inverse=True)
        again = again.reshape(-1)
        self.item = again[np.concatenate(inverse)] if inverse else np.empty(0, dtype=np.int64)
        self.where = np.concatenate(where) if where else np.empty((0, 2), dtype=np.int64)
        self.item_least = np.full(len(self.items), NO_ID, dtype=np.int64)
        np.minimum.at(self.item_least, self.item, self.ids[self.where[:, 1]])
        self.raw = np.frombuffer(self.items.tobytes(), dtype=np.uint8).reshape(-1, size) if len(self.items) else np.empty((0, size), dtype=np.uint8)

    def _hot_windows(self, occ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all strings about anchors with hot grams, each once."""
        p = self.p
        mark = np.zeros(len(self.text) + 1, dtype=bool)
        docs = self.doc[occ]
        for d in range(p.back + 1):
            s = self.at[occ] - d
            ok = (s >= self.starts[docs]) & (s + p.width <= self.ends[docs])
            mark[s[ok]] = True
        s = np.flatnonzero(mark)
        return s, np.searchsorted(self.ends, s, side="right").astype(np.int32)

    def _keys(self, at, doc, gram, parts: int, with_left: bool) -> np.ndarray:
        """Sort keys: part, suffix, its length, the bytes before it backwards, their number."""
        p = self.p
        n, size = len(at), 4 + p.width + 1 + p.back + 1
        key = np.zeros((n, size), dtype=np.uint8)
        right = np.minimum(self.ends[doc] - at, p.width)
        if self.padded is None:
            self.padded = np.concatenate([np.zeros(p.back, dtype=np.uint8), self.text, np.zeros(p.width, dtype=np.uint8)])
        padded = self.padded
        body = np.lib.stride_tricks.sliding_window_view(padded, p.width)[at + p.back]
        body[np.arange(p.width)[None, :] >= right[:, None]] = 0
        key[:, 4 : 4 + p.width], key[:, 4 + p.width] = body, right
        if with_left:
            left = np.minimum(at - self.starts[doc], p.back)
            before = np.lib.stride_tricks.sliding_window_view(padded, p.back)[at][:, ::-1].copy()
            before[np.arange(p.back)[None, :] >= left[:, None]] = 0
            key[:, 5 + p.width : -1], key[:, -1] = before, left
            part = (gram >> np.uint64(17)) % np.uint64(parts)
        else:
            part = gram_hashes_rows(body) % np.uint64(parts)
        key[:, :4] = part.astype(">u4").view(np.uint8).reshape(-1, 4)
        return key.reshape(-1).view(f"S{size}")

    def runs(self):
        """Per part: the sorted run, front-coded."""
        p = self.p
        part = np.ascontiguousarray(self.raw[:, :4]).view(">u4").reshape(-1)
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
        for a, b in zip(edges, edges[1:]):
            raw = self.raw[a:b]
            body, right = raw[:, 4 : 4 + p.width], raw[:, 4 + p.width]
            same = common(body, right)
            keep = (np.arange(p.width)[None, :] >= same[:, None]) & (np.arange(p.width)[None, :] < right[:, None])
            rest = body[keep]
            left = raw[:, -1]
            before = raw[:, 5 + p.width : -1][np.arange(p.back)[None, :] < left[:, None]]
            yield int(part[a]), _pack(same, right, rest, left, before, self.item_least[a:b])

    def removed(self, masks: dict[int, np.ndarray]) -> np.ndarray:
        """Which bytes go, given for each item a bit per place of a string about it."""
        p = self.p
        part = np.ascontiguousarray(self.raw[:, :4]).view(">u4").reshape(-1)
        mask = np.zeros(len(part), dtype=np.uint64)
        for k, m in masks.items():
            mask[np.searchsorted(part, k) : np.searchsorted(part, k, side="right")] = m
        bits = mask[self.item]
        at, doc = self.where[:, 0], self.where[:, 1]
        # A whole context that a smaller document of this block shares is no item of its own.
        later = self.ids[doc] > self.item_least[self.item]
        left, right = self.raw[self.item, -1], self.raw[self.item, 4 + p.width]
        start = np.zeros(len(self.text) + 1, dtype=np.int32)
        for d in range(p.back + 1):
            hit = ((bits >> np.uint64(d)) & np.uint64(1)).astype(bool) | (later & (left >= d) & (right >= p.width - d))
            start[at[hit] - d] = 1
        s = np.flatnonzero(start)
        cover = np.zeros(len(self.text) + p.width + 1, dtype=np.int32)
        cover[s] += 1
        np.subtract.at(cover, s + p.width, 1)
        return np.cumsum(cover)[: len(self.text)] > 0


def gram_hashes_rows(body: np.ndarray) -> np.ndarray:
    h = np.zeros(len(body), dtype=np.uint64)
    for k in range(body.shape[1]):
        h = h * np.uint64(_PRIME) + body[:, k] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def common(body: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before it."""
    out = np.zeros(len(body), dtype=np.uint8)
    if len(body) > 1:
        differ = body[1:] != body[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), body.shape[1])
        out[1:] = np.minimum(first, np.minimum(length[1:], length[:-1]))
    return out


def _beyond(x: bytes, y: bytes, known: int) -> tuple[int, bool]:
    """Bytes that ``x`` and ``y`` have in common, given that they share ``known``; whether x sorts first."""
    a, b = x[known:], y[known:]
    n = min(len(a), len(b))
    apart = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    if not apart:
        return known + n, len(a) <= len(b)
    return known + n - (apart.bit_length() + 7) // 8, a < b


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs of ``(suffixes, common prefix with the one before)``.

    Returns which run each merged suffix comes from, and what it has in common with the one merged
    before it. The tree keeps losers; ``known`` is what a run's suffix shares with the last winner.
    Of two suffixes the one that shares more with it comes first, without looking at either; only
    where both share as much are bytes compared, beyond the known prefix.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    known, nxt = [0] * k, [1] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None or known[a] > known[b]:
            return a, b
        if known[a] < known[b]:
            return b, a
        same, first = _beyond(x, y, known[a])
        if first:
            known[b] = same
            return a, b
        known[a] = same
        return b, a

    winners = list(range(k))
    node = k
    while node > 1:
        node //= 2
        nexts = []
        for i in range(node):
            w, l = play(winners[2 * i], winners[2 * i + 1])
            loser[node + i] = l
            nexts.append(w)
        winners = nexts
    w = winners[0]
    order, shared = [], []
    while (x := head[w]) is not None:
        order.append(w)
        shared.append(known[w])
        texts, same = runs[w]
        i = nxt[w]
        if i < len(texts):
            head[w], known[w], nxt[w] = texts[i], same[i], i + 1
        else:
            head[w] = None
        at = (k + w) >> 1
        while at:
            l = loser[at]
            y = head[l]
            if y is not None:
                x = head[w]
                if x is None or known[l] > known[w]:
                    loser[at], w = w, l
                elif known[l] == known[w]:
                    both, first = _beyond(x, y, known[w])
                    if first:
                        known[l] = both
                    else:
                        known[w] = both
                        loser[at], w = w, l
            at >>= 1
    return order, shared


def answer_grams(blobs: list[tuple[int, bytes]], p: Repeats) -> list[tuple[int, bytes]]:
    """Per block's question: which grams several documents share, a smaller one has, or very many have."""
    asked = [_unpack(b) for _, b in blobs]
    gram, least, docs = (np.concatenate([a[i] for a in asked]) for i in range(3))
    order = np.argsort(gram, kind="stable")
    g = gram[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, dtype=np.int64)
    flag = np.zeros(len(g), dtype=np.uint8)
    if len(g):
        n = np.diff(np.append(first, len(g)))
        total = np.repeat(np.add.reduceat(docs[order].astype(np.int64), first), n)
        smallest, largest = np.repeat(np.minimum.reduceat(least[order], first), n), np.repeat(np.maximum.reduceat(least[order], first), n)
        several = (total > 1) & ((smallest < largest) | (np.repeat(np.maximum.reduceat(docs[order], first), n) > 1))
        flag[order] = several * SHARED | (smallest < least[order]) * SMALLER | (several & (total >= p.hot)) * HOT
    cuts = np.cumsum([len(a[0]) for a in asked])
    return [(block, _pack(f)) for (block, _), f in zip(blobs, np.split(flag, cuts[:-1]))]


def answer_runs(blobs: list[tuple[int, bytes]], p: Repeats) -> list[tuple[int, bytes]]:
    """Per block's run: for each suffix a bit per string about it that a smaller document has."""
    runs, lefts, befores, rights, docs, sizes = [], [], [], [], [], []
    for _, blob in blobs:
        same, right, rest, left, before, least = _unpack(blob)
        texts, cut, last = [], rest.tobytes(), b""
        at, same_list = 0, same.tolist()
        for s, r in zip(same_list, right.tolist()):
            last = last[:s] + cut[at : at + r - s]
            at += r - s
            texts.append(last)
        runs.append((texts, same_list))
        m = np.zeros((len(left), p.back), dtype=np.uint8)
        m[np.arange(p.back)[None, :] < left[:, None]] = before
        lefts.append(left), befores.append(m), rights.append(right), docs.append(least), sizes.append(len(left))
    order, shared = merge(runs)
    run = np.array(order, dtype=np.int64)
    n = len(run)
    base = np.cumsum([0] + sizes)
    # the i-th suffix of a run in merged order is its i-th overall
    by_run = np.argsort(run, kind="stable")
    source = np.empty(n, dtype=np.int64)
    source[by_run] = np.arange(n)
    del runs, order
    same = np.array(shared, dtype=np.int16)
    left, right, doc = (np.concatenate(x)[source] for x in (lefts, rights, docs))
    key = np.concatenate([np.concatenate(befores), np.concatenate(lefts)[:, None]], axis=1)[source]
    by_left = np.argsort(np.ascontiguousarray(key).reshape(-1).view(f"S{p.back + 1}"), kind="stable")
    left_same = common(key[by_left][:, :-1], left[by_left])
    # Equal whole contexts: all but one of the smallest document are repeats at every place.
    before = np.concatenate([[-1], right[:-1].astype(np.int64)]) if n else np.empty(0, dtype=np.int64)
    whole_right = np.cumsum((same != right) | (right != before))
    whole_left = np.empty(n, dtype=np.int64)
    ordered = left[by_left].astype(np.int64)
    whole_left[by_left] = np.cumsum((left_same != ordered) | (ordered != np.concatenate([[-1], ordered[:-1]]))) if n else ordered
    both = whole_right * np.int64(n + 1) + whole_left
    whole = np.lexsort((doc, both))
    fresh = np.concatenate([[True], both[whole][1:] != both[whole][:-1]]) if n else np.empty(0, dtype=bool)
    leader = whole[np.flatnonzero(fresh)]
    smallest = np.empty(n, dtype=np.int64)
    smallest[whole] = doc[leader][np.cumsum(fresh) - 1] if n else doc
    low, high = np.maximum(p.width - right.astype(np.int64), 0), np.minimum(left.astype(np.int64), p.back)
    every = np.where(high >= low, (np.uint64(2) << high.astype(np.uint64)) - (np.uint64(1) << np.minimum(low, 63).astype(np.uint64)), np.uint64(0))
    mask = np.where(doc > smallest, every, np.uint64(0))
    group_left = np.empty(n, dtype=np.int64)
    l_left, l_right = left[leader], right[leader]
    for d in range(p.back + 1):
        ok = np.flatnonzero((l_left >= d) & (l_right >= p.width - d))
        if not len(ok):
            continue
        ok = leader[ok]
        group = np.cumsum(same < p.width - d)
        group_left[by_left] = np.cumsum(left_same < d) if d else 0
        both = group[ok] * np.int64(n + 1) + group_left[ok]
        o = np.argsort(both)
        b, who = both[o], doc[ok][o]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        least = np.repeat(np.minimum.reduceat(who, first), np.diff(np.append(first, len(b))))
        mask[ok[o[least < who]]] |= np.uint64(1) << np.uint64(d)
    alike = doc == smallest  # further rows of the leader's own document have what it has
    number = np.empty(n, dtype=np.int64)
    number[whole] = np.cumsum(fresh) - 1
    mask = np.where(alike, mask[leader][number] if n else mask, mask)
    out = np.empty(n, dtype=np.uint64)
    out[source] = mask
    return [(block, _pack(out[base[i] : base[i + 1]])) for i, (block, _) in enumerate(blobs)]


def write_blocks(docs: DataFrame, p: Repeats, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Documents in blocks of about ``p.block`` bytes, as a table bucketed by block, so that joins on it move answers only."""

    def run(batches):
        part, number, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            body = b"".join(texts)
            own = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
            lost = np.array([i is None for i in ids], dtype=bool)
            row = pickle.dumps((own, lost, np.cumsum([len(t) for t in texts]), body))
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), pa.array([zstandard.ZstdCompressor(level=3).compress(row)], pa.binary())], ["block", "docs"])

        for b in slices(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i), texts.append(t)
                size += len(t)
                if size >= p.block:
                    yield flush()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield flush()

    spark = docs.sparkSession
    name = f"ontoweave_blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("text"))
    made = rows.mapInArrow(run, "block long, docs binary")
    made.write.format("parquet").option("compression", "none").option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry alone; the files are in the shared folder
    return out


def _open(blob: bytes, p: Repeats) -> tuple[Block, np.ndarray]:
    own, lost, ends, body = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    return Block(own, ends.astype(np.int64), np.frombuffer(body, dtype=np.uint8), p), lost


_ASKED = "part int, block long, blob binary"


def _asked(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["part", "block", "blob"])


def _answered(asked: DataFrame, parts: int, answer, p: Repeats, kind: int) -> DataFrame:
    """Each part's questions answered in one task; answers go to the shared folder."""

    def run(batches):
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)))]
        for part in sorted({r[0] for r in rows}):
            own = sorted((r[1], r[2]) for r in rows if r[0] == part)
            for block, blob in answer(own, p):
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([blob], pa.binary())], ["kind", "part", "block", "blob"])

    dealt = asked.repartitionById(parts, F.col("part")).mapInArrow(run, "kind int, part int, block long, blob binary")
    return materialize(dealt, "answers")


def remove_repeats(docs: DataFrame, p: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per input row, and ``kept`` (binary) with ``with_text``.

    Texts are UTF-8 bytes, a null text is empty. Strings never cross documents and are judged on the
    input. Rows with equal doc_id do not count as smaller than one another; rows without doc_id come
    after all others and do not count for one another. An empty table gives no rows. A block is one
    row, so a single text may not reach 2 GB.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // p.part)) if total > p.block else 1
    blocks = write_blocks(docs, p, id_col, text_col, max(1, -(-total // p.block)))

    def ask(batches):
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1)):
                found, _ = _open(blob.as_py(), p)
                rows = [(k, block, q) for k, q in found.questions(parts)]
                if rows:
                    yield from _asked(rows).to_batches()

    flags = _answered(blocks.mapInArrow(ask, _ASKED), parts, answer_grams, p, 0)

    def told(answers: pa.Table, kind: int) -> dict[int, np.ndarray]:
        return {k: _unpack(b)[0] for what, k, b in zip(answers["kind"].to_pylist(), answers["part"].to_pylist(), answers["blob"].to_pylist()) if what == kind}

    def sort(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for block, blob in zip(left["block"].to_pylist(), left["docs"]):
            found, _ = _open(blob.as_py(), p)
            found.take_flags(told(right, 0), parts)
            rows += [(k, block, r) for k, r in found.runs()]
        return _asked(rows)

    runs = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(sort, _ASKED)
    masks = _answered(runs, parts, answer_runs, p, 1)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for blob in left["docs"]:
            found, lost = _open(blob.as_py(), p)
            found.take_flags(told(right, 0), parts)
            gone = found.removed(told(right, 1))
            for i, none, a, b in zip(found.ids.tolist(), lost, found.starts, found.ends):
                cut = gone[a:b]
                kept = found.text[a:b][~cut].tobytes()
                spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if len(cut) else 0
                out.append((None if none else i, int(b - a), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        cols = list(zip(*out)) or [[]] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    answers = flags.unionByName(masks)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def op2_suffixes(spark, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings of smaller ones."""
    return remove_repeats(table(spark, sf_dir, "documents"))

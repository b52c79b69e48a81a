"""Quality by importance resampling over hashed n-gram generative models.

A target model is fitted on labelled good documents and a raw model on all documents. A document's
log importance weight is the sum of the log ratios of its n-grams, every occurrence counted, and the
documents to keep are drawn by Gumbel top-k: standard Gumbel noise, keyed by doc_id, is added to
every weight and the k largest stay, which draws k documents without replacement in proportion to
their importance.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ontoweave.llm.common import frugal, kept, slices, table
from ontoweave.plans.storage import discard, materialize

#: Letters of a word's beginning that stand for all its forms.
STEM = 5
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Counts travel in chunks of this many buckets.
CHUNK = 1 << 13


@dataclass(frozen=True)
class Resampling:
    """Parameters.

    buckets: size of both models for each kind of feature, whatever the corpus. orders: n-grams
    counted besides the beginnings of words. max_target: labelled good documents that the target
    model is fitted on at most, those with the smallest hash of doc_id, which bounds what is sent to
    the executors. prior: occurrences added to both counts of a bucket. shrink: squared deviance at
    which half of a bucket's log ratio is believed; the counts' deviance is that of Poisson numbers,
    so buckets that differ by chance are drawn to one and none is left out. keep: share of the
    documents that are drawn; None takes the share of good ones among the labelled.
    """

    buckets: int = 1 << 18
    orders: tuple[int, ...] = (1, 2)
    max_target: int = 50_000
    prior: float = 1.0
    shrink: float = 256.0
    keep: float | None = None
    seed: int = 11

    @property
    def size(self) -> int:
        """Buckets of a model: a part for each order, then one for the beginnings of words."""
        return self.buckets * (len(self.orders) + 1)


class _Stems(dict):
    """64-bit hashes of words' beginnings by word, forgotten when there are many."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1 << 16:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w[:STEM], 1)
        return h


class _Hashes(dict):
    """64-bit hashes of words, forgotten when there are many."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1 << 16:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_HASHES, _STEMS = _Hashes(), _Stems()
kept(__name__, _HASHES.clear, _STEMS.clear)


def grams(text: str, buckets: int, orders: tuple[int, ...]) -> np.ndarray:
    """The buckets of a text's n-grams and of its words' beginnings, one for every occurrence: words and runs of other signs, lower-cased.

    Every order has buckets of its own, so the many rare pairs don't blur the counts of words; the
    beginnings pool the rare forms of a word.
    """
    words = TOKEN.findall(text.lower())
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    out = []
    for i, n in enumerate(orders):
        if len(h) < n:
            continue
        g = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        g ^= np.uint64(n)
        g *= np.uint64(0xD6E8FEB86659FD93)
        out.append((g >> np.uint64(32)) % np.uint64(buckets) + np.uint64(i * buckets))
    if words:
        g = np.fromiter(map(_STEMS.__getitem__, words), dtype=np.uint64, count=len(words))
        out.append((g >> np.uint64(32)) % np.uint64(buckets) + np.uint64(len(orders) * buckets))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, dtype=np.int64)


def count_grams(docs: DataFrame, good: np.ndarray, p: Resampling, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Occurrences of each bucket in all documents and in the good ones, and the number of documents.

    Counts are summed within each task, shuffled as chunks and come to the driver as 2 * size
    numbers in all.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chunks = p.size // CHUNK

    def run(batches):
        raw, target, n = np.zeros(p.size, dtype=np.int64), np.zeros(p.size, dtype=np.int64), 0
        for b in slices(batches):
            ids = b.column(0)
            of_target = np.isin(ids.fill_null(0).to_numpy(), good) & ids.is_valid().to_numpy(zero_copy_only=False)
            for t, is_good in zip(b.column(1).to_pylist(), of_target):
                g = grams(t, p.buckets, p.orders)
                np.add.at(raw, g, 1)
                if is_good:
                    np.add.at(target, g, 1)
                n += 1
        if n:
            part = lambda a: pa.array([zlib.compress(a[i * CHUNK : (i + 1) * CHUNK].tobytes(), 1) for i in range(chunks)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(range(chunks), pa.int32()), part(raw), part(target), pa.array([n if i == 0 else 0 for i in range(chunks)], pa.int64())], ["chunk", "raw", "target", "n"])

    def add(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for c, raw, target, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                s = sums.setdefault(c, [np.zeros(CHUNK, dtype=np.int64), np.zeros(CHUNK, dtype=np.int64), 0])
                s[0] += np.frombuffer(zlib.decompress(raw), dtype=np.int64)
                s[1] += np.frombuffer(zlib.decompress(target), dtype=np.int64)
                s[2] += n
        if sums:
            cols = list(zip(*[(c, s[0].tobytes(), s[1].tobytes(), s[2]) for c, s in sums.items()]))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.int64()))], ["chunk", "raw", "target", "n"])

    schema = "chunk int, raw binary, target binary, n long"
    sums = texts.mapInArrow(frugal(run), schema).repartitionById(chunks, F.col("chunk")).mapInArrow(frugal(add), schema).collect()
    raw, target = np.zeros(p.size, dtype=np.int64), np.zeros(p.size, dtype=np.int64)
    for r in sums:
        at = slice(r["chunk"] * CHUNK, (r["chunk"] + 1) * CHUNK)
        raw[at], target[at] = np.frombuffer(r["raw"], dtype=np.int64), np.frombuffer(r["target"], dtype=np.int64)
    return raw, target, sum(r["n"] for r in sums)


def log_ratios(raw: np.ndarray, target: np.ndarray, p: Resampling) -> np.ndarray:
    """Log ratio of the smoothed models by bucket, drawn towards zero where chance may explain it.

    Both models are over occurrences: the raw counts are scaled to as many as the target has.
    """
    expected = raw * (target.sum() / max(1, raw.sum()))
    ratio = np.log((target + p.prior) / (expected + p.prior))
    seen = np.where(target > 0, target * np.log(np.maximum(target, 1) / np.maximum(expected, 1e-300)), 0.0)
    deviance = np.where(raw > 0, np.maximum(2 * (seen - (target - expected)), 0.0), 0.0)
    return ratio * deviance**2 / (deviance**2 + p.shrink)


def _noise(ids, p: Resampling) -> np.ndarray:
    h = np.array([xxhash.xxh64_intdigest(b"" if d is None else int(d).to_bytes(8, "little", signed=True), p.seed) for d in ids], dtype=np.uint64)
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def _score(ids, texts, ratio: np.ndarray, p: Resampling) -> tuple[np.ndarray, np.ndarray]:
    w = np.array([ratio[grams(t or "", p.buckets, p.orders)].sum() for t in texts])
    return w, w + _noise(ids, p)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The exact k-th largest of a double column ``key``, by four rounds of histograms of 65,536 bins."""
    if k <= 0:
        return float("inf")
    bits = F.expr("CAST(key AS DOUBLE)")
    wide = keys.select(bits.alias("key")).mapInArrow(frugal(_as_ordered), "o long")
    wide = materialize(wide, "ordered")
    prefix, want = None, k
    for shift in (48, 32, 16, 0):
        part = wide if prefix is None else wide.where(F.shiftright("o", shift + 16) == prefix)
        bins = part.groupBy((F.shiftright("o", shift)).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(bins, key=lambda r: -r["b"]):
            if r["n"] >= want:
                prefix = r["b"]
                break
            want -= r["n"]
        else:
            discard(wide)
            return float("-inf")
    discard(wide)
    o = np.array([prefix], dtype=np.int64)
    return float(np.where(o < 0, o ^ np.int64(0x7FFFFFFFFFFFFFFF), o).view(np.float64)[0])


def _as_ordered(batches):
    for b in batches:
        o = (b.column(0).to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(o < 0, o ^ np.int64(0x7FFFFFFFFFFFFFFF), o))], ["o"])


def good_documents(labels: DataFrame, p: Resampling) -> tuple[np.ndarray, float]:
    """Ids of the labelled good documents (quality 1, not toxic; at most ``max_target``), and their share of all labelled; rows with nulls are no labels."""
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.min(F.expr("CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END")).alias("good"))
    labelled, good = labels.agg(F.count(F.lit(1)), F.coalesce(F.sum("good"), F.lit(0))).first()
    chosen = labels.where("good = 1").select("d").orderBy(F.xxhash64("d"), "d").limit(p.max_target).collect()
    return np.array(sorted(r["d"] for r in chosen), dtype=np.int64), good / labelled if labelled else 1.0


def draw(docs: DataFrame, labels: DataFrame, p: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``(doc_id, log_weight, gumbel_key)`` of the k documents drawn, or with ``whole`` all columns of their rows.

    Two passes over the texts: one counts, the other weighs and writes the keys (with ``whole`` beside
    the rows, so that no third pass is needed) to the shared folder, where the exact k-th key is found.
    """
    good, share = good_documents(labels, p)
    raw, target, n = count_grams(docs, good, p, id_col, text_col)
    ratio = log_ratios(raw, target, p)
    k = min(n, round((share if p.keep is None else p.keep) * n)) if len(good) else n
    key, weight = _unused("_key", docs.columns), _unused("_weight", docs.columns)
    rows = docs if whole else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    at = (docs.columns.index(id_col), docs.columns.index(text_col)) if whole else (0, 1)

    def run(batches):
        for b in slices(batches):
            w, keys = _score(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist(), ratio, p)
            own = list(b.columns) if whole else [b.column(0)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(w), pa.array(keys)], [str(i) for i in range(len(own) + 2)])

    out = StructType([*(rows.schema if whole else rows.schema[:1]), StructField(weight, DoubleType()), StructField(key, DoubleType())])
    scores = materialize(rows.mapInArrow(frugal(run), out), "weights")
    kept = scores.where(F.col(key) >= kth_largest(scores.select(F.col(key).alias("key")), k))
    return kept.select(*docs.columns) if whole else kept.select("doc_id", F.col(weight).alias("log_weight"), F.col(key).alias("gumbel_key"))


def _unused(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def resample(docs: DataFrame, labels: DataFrame, p: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the k rows of ``docs`` with the largest perturbed weights.

    k is ``keep`` of the rows. Rows that tie with the k-th all stay, so equal rows share their fate. A
    null or empty text has weight zero; a null doc_id has the noise of no id; a doc_id labelled twice
    is good if all its labels are. Without labelled good documents no weight can be given and all rows
    stay; an empty table gives no rows.
    """
    return draw(docs, labels, p, id_col, text_col, whole=True)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """The documents drawn, with weight and key: doc_id, log_weight, gumbel_key, kept (true)."""
    return draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("kept", F.lit(True))

"""Best-two-fit packing of tokenised documents into sequences of a fixed size.

What packs into what depends on lengths alone, so the packing is planned on the histogram of lengths
(at most as many numbers as a sequence has tokens, whatever the input's size) and laid out by rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoweave.llm.common import frugal, kept, keyed_texts, slices, table
from ontoweave.llm.tokens import default_path, encoder
from ontoweave.plans.storage import materialize

END_ID = 0
kept(__name__, encoder.cache_clear)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only one longer than ``size`` is cut, its first piece short."""
    first = n - size * ((n - 1) // size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, size: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids, then ``END_ID``, cut at ``size``."""

    def run(batches):
        e = encoder(path)
        for b in slices(batches):
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*e.ids(t), END_ID], dtype="<u4")
                out += [(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), size))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(frugal(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Bins as ``(lengths, how many bins alike)``.

    A bin takes the longest unpacked document and then, again and again, the longest that still
    fits. While a gap is left, its smallest document is replaced by two unpacked ones that fit the
    gap that then opens more tightly. The bin is repeated as often as the unpacked lengths allow, so
    every step uses up a length and the plan grows with the number of lengths, not of documents.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    every = np.arange(size + 1)
    while left.any():
        free = left.copy()
        fits = lambda: np.maximum.accumulate(np.where(free > 0, every, 0))  # noqa: B023, E731  longest unpacked up to a length
        gap, one = size, []
        below = fits()
        while gap and below[gap]:
            length = int(below[gap])
            one.append(length)
            free[length] -= 1
            gap -= length
            if not free[length]:
                below = fits()
        while gap and one:
            smallest = min(one)
            room = gap + smallest
            a = np.flatnonzero(free[: room + 1] > 0)
            a = a[a < room]
            if not len(a):
                break
            other = room - a
            b = below[other]
            twice = (b == a) & (free[a] < 2)  # one document can't be both
            b = np.where(twice, below[np.maximum(np.minimum(other, a - 1), 0)], b)
            total = np.where(b > 0, a + b, 0)
            k = int(total.argmax())
            if total[k] <= smallest:
                break
            one.remove(smallest)
            one += [int(a[k]), int(b[k])]
            free[smallest] += 1
            free[a[k]] -= 1
            free[b[k]] -= 1
            gap = room - int(total[k])
            below = fits()
        used = np.bincount(one, minlength=size + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        bins.append((sorted(one, reverse=True), times))
    return bins


def layout(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows ``(length, first rank, first sequence, copies a bin, offset)``, by length and first rank."""
    rows, rank, sequence = [], {}, 0
    for lengths, times in bins:
        offset = 0
        for length in dict.fromkeys(lengths):
            copies = lengths.count(length)
            rows.append((length, rank.get(length, 0), sequence, copies, offset))
            rank[length] = rank.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, size: int = 2048, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for each piece of every document.

    A null or empty text is the single id ``END_ID``. Repeated rows are packed each; a null doc_id
    stays null; an empty table gives no rows. A length that a third of all documents share is ranked
    in blocks of hashed ids, so no task gets more than its share.
    """
    cuts = materialize(pieces(docs, size, tokenizer_path or default_path(), id_col, text_col), "pieces")
    spark = docs.sparkSession
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    total = sum(histogram.values())
    table_ = layout(plan(histogram, size))
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(16, total // 20_000))).cast("int")
    blocked = cuts.withColumn("_block", block)
    sizes = blocked.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("length", "_block", F.coalesce(before, F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = blocked.withColumn("_within", within).join(firsts, ["length", "_block"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_within") - 1).alias("rank"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches):
        keys = table_[:, 0] << 44 | table_[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = table_[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            past = rank - row[:, 1]
            sequence, offset = row[:, 2] + past // row[:, 3], row[:, 4] + past % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns[:5]), pa.array(sequence), pa.array(offset)], columns)

    return ranked.mapInArrow(frugal(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))

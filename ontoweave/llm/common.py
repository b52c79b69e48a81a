"""What the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words.
SPACES = b"\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text)`` with null texts empty; other columns, whatever their names, are dropped."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Keys with more than one row in this many are hot; there are fewer of them than this.
HOT = 256


def by_key(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row per ``key`` and the number of its rows as ``copies``.

    Rows of hot keys stay where they are: fewer than ``HOT`` keys have more than ``total / HOT`` of the
    ``total`` rows, so their facts are broadcast. All others are joined by a shuffle in which no key is
    large. A null key has no facts and is dropped, as in an inner join.
    """
    is_hot = F.col("copies") * HOT > total
    hot = facts.where(is_hot)
    few = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return few.unionByName(rest.join(facts.where(~is_hot), key)).drop("copies")


def slices(batches, max_bytes: int = 4 << 20):
    """Record batches cut so that no slice holds much more text than ``max_bytes`` (one long text aside)."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.zeros(b.num_rows, dtype=np.int64)
        for i, f in enumerate(b.schema):
            if pa.types.is_string(f.type) or pa.types.is_large_string(f.type) or pa.types.is_binary(f.type):
                sizes += pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        ends = np.cumsum(sizes)
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield b.slice(at, stop - at)
            at = stop


#: What a worker keeps between tasks, by the module whose tasks use it: functions that drop it.
KEPT: dict[str, list[Callable[[], None]]] = {}


def kept(of: str, *drops: Callable[[], None]) -> None:
    KEPT.setdefault(of, []).extend(drops)


def drop_others(of: str) -> None:
    """Drop what tasks of other modules have left in this worker."""
    for module, drops in KEPT.items():
        if module != of:
            for drop in drops:
                drop()


def trim() -> None:
    """Give the system back what is free but held by the allocators of Arrow and C."""
    pa.default_memory_pool().release_unused()
    if malloc_trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only glibc has it
        malloc_trim(0)


def frugal(run):
    """``run`` for mapInArrow, whose worker holds nothing of other operators and after a task only its own caches.

    Spark uses its Python workers again and again, so what every operator leaves in each of them adds up.
    """
    of = run.__module__

    def own(batches):
        drop_others(of)
        try:
            yield from run(batches)
        finally:
            trim()

    return own


def give_back(spark) -> None:
    """Shuffle files of plans that are of no more use: Spark deletes them once both sides have collected the plans."""
    for _ in range(2):  # Python's side is told to the driver's with a delay
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()

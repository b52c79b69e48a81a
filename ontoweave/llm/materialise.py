"""Training-order materialisation of token ids.

Documents are tokenised once and their ids, in the order of doc_id, form one stream that is cut into
sequences of a fixed length; only the last is filled up. A keyed Feistel permutation with
cycle-walking gives every sequence its global slot, so that key and documents alone decide the order,
however the input is split. Range partitions of slots write files in which sequence ``slot`` starts at
``(slot - first_slot) * stride`` bytes, so that training reads sequentially and resumes anywhere.
"""

from __future__ import annotations

import json
import sys
import uuid
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.llm.common import give_back, keyed_texts, slices, table
from ontoweave.llm.tokens import default_path, encoder
from ontoweave.plans.storage import discard, materialize, shared_dir

END_ID = 0


@dataclass(frozen=True)
class Order:
    """Parameters.

    key: of the permutation. length: ids of a sequence. shard: sequences of a shard. rounds: of the
    Feistel network. width: bytes of an id (little-endian, unsigned).
    """

    key: int = 20_240_601
    length: int = 2048
    shard: int = 1024
    rounds: int = 6
    width: int = 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_keys(key: int, rounds: int) -> np.ndarray:
    return _mix(np.uint64(key & 0xFFFFFFFFFFFFFFFF) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """The slot of each index in ``[0, n)``, a bijection chosen by ``key``; or, inverted, the index of each slot.

    The network permutes the next larger domain of an even number of bits, at most four times n;
    values that land beyond n are permuted again until they fall inside, which keeps it a bijection.
    """
    half = max(1, (max(1, int(n - 1).bit_length()) + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = _round_keys(key, rounds)

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left + k) & mask), left
            else:
                left, right = right, left ^ (_mix(right + k) & mask)
        return left << shift | right

    out = once(np.asarray(index).astype(np.uint64))
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def token_stream(docs: DataFrame, o: Order, path: str, id_col: str, text_col: str) -> DataFrame:
    """``(part, first, n, blob)``: runs of ids of every range of doc_id, ``first`` ids after the range's beginning.

    Every document is followed by ``END_ID``. Documents are sorted by doc_id, null last, then by a
    hash of the text; rows that agree in both are the same.
    """
    code, end = {1: "B", 2: "H", 4: "I", 8: "Q"}[o.width], END_ID.to_bytes(o.width, "little")

    def packed(ids: list[int]) -> bytes:
        out = array(code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(batches):
        e = encoder(path)
        for b in slices(batches):
            ids = [packed(e.ids(t)) + end for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.binary())], ["lost", "doc_id", "h", "ids"])

    def join(batches):
        squeeze, part, first, held, size = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal first
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([size // o.width], pa.int64()), pa.array([squeeze.compress(b"".join(held))], pa.binary())], ["part", "first", "n", "blob"])
            first += size // o.width
            return row

        for b in batches:
            for x in b.column(3):
                held.append(x.as_py())
                size += len(held[-1])
                if size >= 1 << 20:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    texts = keyed_texts(docs, id_col, text_col).select(F.col("doc_id").isNull().alias("lost"), "doc_id", F.xxhash64("text").alias("h"), "text")
    spark = docs.sparkSession
    ids = texts.mapInArrow(encode, "lost boolean, doc_id long, h long, ids binary")
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = materialize(ids, "token-ids")  # sorting by ranges looks at its input twice
    sorted_ids = ids.repartitionByRange(ranges, "lost", "doc_id", "h").sortWithinPartitions("lost", "doc_id", "h")
    out = materialize(sorted_ids.mapInArrow(join, "part int, first long, n long, blob binary"), "token-table")
    discard(ids)
    return out


def shards(tokens: DataFrame, o: Order = Order(), finished: frozenset[int] = frozenset()) -> tuple[DataFrame, int]:
    """``(shard, first_slot, n_sequences, payload)`` of a token stream, every shard's bytes but the finished ones', and the number of sequences.

    A null or empty text adds its ``END_ID`` alone; repeated rows are repeated text; other columns
    are ignored; an empty table gives no shards. An id that ``width`` bytes can't hold stops the job.
    Only the number of ids of each range comes to the driver. A shard is put together in one task.
    """
    counts = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    ids = sum(counts.values())
    total = -(-ids // o.length)
    schema = "shard long, first_slot long, n_sequences long, payload binary"
    if not total:
        return tokens.sparkSession.createDataFrame([], schema), 0
    offset = dict(zip(sorted(counts), np.cumsum([0] + [counts[k] for k in sorted(counts)]).tolist()))
    n_shards, stride = -(-total // o.shard), o.length * o.width

    def deal(batches):
        """Each run's pieces of sequences, by shard: slots, first bytes in the sequence, bytes."""
        squeeze, expand = zstandard.ZstdCompressor(level=2), zstandard.ZstdDecompressor()
        for b in batches:
            for part, first, n, blob in zip(*(b.column(i).to_pylist() for i in range(4))):
                body = np.frombuffer(expand.decompress(blob), dtype=np.uint8)
                begin = (offset[part] + first) * o.width
                index = np.arange(begin // stride, -(-(begin + len(body)) // stride))
                slot = permute(index, total, o.key, o.rounds)
                a, z = np.maximum(index * stride, begin), np.minimum((index + 1) * stride, begin + len(body))
                order = np.argsort(slot)
                shard = slot[order] // o.shard
                edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
                out = []
                for i, j in zip(edges, edges[1:]):
                    if (k := int(shard[i])) in finished:
                        continue
                    w = order[i:j]
                    joined = b"".join(body[x - begin : y - begin].tobytes() for x, y in zip(a[w], z[w]))
                    out.append((k, np.stack([slot[w], a[w] - index[w] * stride, z[w] - a[w]]).tobytes(), squeeze.compress(joined)))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["shard", "places", "blob"])

    def gather(batches):
        """The shard of this task."""
        expand, shard, body = zstandard.ZstdDecompressor(), None, None
        for b in batches:
            for k, places, blob in zip(*(b.column(i).to_pylist() for i in range(3))):
                if shard is None:
                    shard, first = k, k * o.shard
                    body = np.full(min(o.shard, total - first) * o.length, END_ID, dtype=f"<u{o.width}").view(np.uint8)
                data, at = np.frombuffer(expand.decompress(blob), dtype=np.uint8), 0
                for slot, inside, size in np.frombuffer(places, dtype=np.int64).reshape(3, -1).T.tolist():
                    to = (slot - first) * stride + inside
                    body[to : to + size] = data[at : at + size]
                    at += size
        if shard is not None:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([first], pa.int64()), pa.array([len(body) // stride], pa.int64()), pa.array([body.tobytes()], pa.binary())], ["shard", "first_slot", "n_sequences", "payload"])

    dealt = tokens.mapInArrow(deal, "shard int, places binary, blob binary")
    return dealt.repartitionById(n_shards, F.col("shard")).mapInArrow(gather, schema), total


def _name(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:09d}.bin"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shards(docs: DataFrame, uri: str, o: Order = Order(), tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one file a shard into the folder ``uri``, which all executors share, and a manifest; returns ``(shard, first_slot, n_sequences)``.

    Files are written under another name and renamed, so a file with its name is whole; a run that is
    repeated after a loss writes only the shards that are missing. A manifest of another order or
    another number of sequences stops the run.
    """
    place, folder = _place(uri)
    place.create_dir(folder, recursive=True)
    have = {x.base_name for x in place.get_file_info(fs.FileSelector(folder))}
    finished = frozenset(int(x[6:15]) for x in have if x.startswith("shard-") and x.endswith(".bin"))
    tokens = token_stream(docs, o, tokenizer_path or default_path(), id_col, text_col)
    give_back(docs.sparkSession)
    made, total = shards(tokens, o, finished)
    says = {"key": o.key, "length": o.length, "shard": o.shard, "rounds": o.rounds, "width": o.width, "sequences": total}
    if "manifest.json" in have:
        with place.open_input_stream(f"{folder}/manifest.json") as f:
            if json.loads(f.read()) != says:
                raise ValueError(f"{uri} holds shards of another order")
    else:
        if finished:
            raise ValueError(f"{uri} holds shards without a manifest")
        with place.open_output_stream(f"{folder}/manifest.json") as f:
            f.write(json.dumps(says).encode())

    def write(batches):
        where, inside = _place(uri)
        for b in batches:
            for shard, payload in zip(b.column(0).to_pylist(), b.column(3)):
                draft = f"{inside}/draft-{shard}-{uuid.uuid4().hex}"
                with where.open_output_stream(draft) as f:
                    f.write(payload.as_buffer())
                where.move(draft, _name(inside, shard))
            yield pa.RecordBatch.from_arrays(b.columns[:3], ["shard", "first_slot", "n_sequences"])

    spark = docs.sparkSession
    new = materialize(made.mapInArrow(write, "shard long, first_slot long, n_sequences long"), "shards")
    discard(tokens)
    size = F.lit(o.shard).cast("long")
    old = spark.createDataFrame([(k,) for k in sorted(finished)], "shard long").select("shard", (F.col("shard") * size).alias("first_slot"), F.least(size, F.lit(total) - F.col("shard") * size).cast("long").alias("n_sequences"))
    return new.unionByName(old)


def read_shards(spark, written: DataFrame, uri: str, o: Order = Order()) -> DataFrame:
    """``(shard, first_slot, n_sequences, stride, payload)``, the bytes read back from the files."""
    stride = o.length * o.width

    def run(batches):
        place, folder = _place(uri)
        for b in batches:
            for shard, first, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                with place.open_input_file(_name(folder, shard)) as f:
                    payload = f.read()
                if len(payload) != n * stride:
                    raise ValueError(f"shard {shard} has {len(payload)} bytes instead of {n * stride}")
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([stride], pa.int32()), pa.array([payload], pa.binary())], ["shard", "first_slot", "n_sequences", "stride", "payload"])

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return written.repartition(tasks, "shard").mapInArrow(run, "shard long, first_slot long, n_sequences long, stride int, payload binary")


def read_from(uri: str, slot: int = 0):
    """The sequences from ``slot`` on, one after the other, as arrays of ids; one seek, then sequential reads, without Spark."""
    place, folder = _place(uri)
    with place.open_input_stream(f"{folder}/manifest.json") as f:
        o = json.loads(f.read())
    stride = o["length"] * o["width"]
    while slot < o["sequences"]:
        shard = slot // o["shard"]
        end = min((shard + 1) * o["shard"], o["sequences"])
        with place.open_input_file(_name(folder, shard)) as f:
            f.seek((slot - shard * o["shard"]) * stride)
            for _ in range(slot, end):
                yield np.frombuffer(f.read(stride), dtype=f"<u{o['width']}")
        slot = end


def op8_training_order(spark, sf_dir: str) -> DataFrame:
    """All documents as shard files in training order, read back, with a digest of each shard's bytes."""
    uri = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    written = write_shards(table(spark, sf_dir, "documents"), uri)
    return read_shards(spark, written, uri).withColumn("payload_sha256", F.sha2("payload", 256))

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at Hamming distance three or less meet in a string half-way between them. Every
distinct fingerprint emits the variants within half the radius, variants are shuffled in packed
blobs, colliding fingerprints are deduplicated and verified, and links become components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.llm.common import by_key, frugal, keyed_texts, slices, table
from ontoweave.plans.components import components
from ontoweave.plans.storage import materialize

BITS = 64
#: Bytes of one packed variant: the variant and the number of the mask that made it.
RECORD = np.dtype([("variant", "<u8"), ("mask", "<u2")])


def ball_masks() -> tuple[np.ndarray, np.ndarray]:
    """XOR masks for fingerprints of even and of odd weight, for radius three.

    At distance 3 the weights differ in parity, so one side is even and the other odd. Of the three
    differing bits at least two lie in the same 32-bit half. Even fingerprints emit all pairs of bits
    inside the low half, odd ones all pairs inside the high half, and both emit themselves and every
    single bit: for two low bits the even side flips them and the odd side flips the third, else the
    other way round. Distances 0, 1 and 2 meet in the single flips. These are exactly the variants
    within half the radius that a pair can need, so no pair is missed.
    """
    one = [0] + [1 << i for i in range(BITS)]
    low = [(1 << i) | (1 << j) for i, j in combinations(range(BITS // 2), 2)]
    high = [(1 << i) | (1 << j) for i, j in combinations(range(BITS // 2, BITS), 2)]
    return np.array(one + low, dtype=np.uint64), np.array(one + high, dtype=np.uint64)


def simhash_text(text: str, words_per_shingle: int = 3) -> int:
    """The fingerprint of one text; bits set in over half of the shingles' XXH64 (seed 42)."""
    words = [w for w in text.encode().lower().split()]
    return int(fingerprint(_shingle_hashes(words, words_per_shingle)))


def _shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - k + 1].tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, stops)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """Bits set in over half of the hashes; zero without any."""
    n = len(hashes)
    if not n:
        return np.uint64(0)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, one row per input row; ``fp`` holds the unsigned fingerprint's bits as a long.

    Only A-Z are lower-cased; words are runs of anything but ASCII white space. A null or wordless
    text has fingerprint zero; a text with fewer words than a shingle counts as one shingle.
    """

    def run(batches):
        for b in slices(batches):
            out = [np.int64(simhash_bytes(t, words_per_shingle)) for t in pc.cast(b.column(1), pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["doc_id", "fp"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(frugal(run), "doc_id long, fp long")


def simhash_bytes(text: bytes, k: int) -> np.int64:
    return np.uint64(fingerprint(_shingle_hashes(text.lower().split(), k))).astype(np.int64)


def emit_variants(fps: DataFrame, parts: int) -> DataFrame:
    """``(part, blob)``: each fingerprint's variants, packed ten bytes each, dealt by the variant's hash."""

    def run(batches):
        even, odd = ball_masks()
        for b in batches:
            f_all = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(f_all), 2048):
                f = f_all[at : at + 2048]
                weight = np.bitwise_count(f) & 1
                pieces = []
                for masks, own in ((even, f[weight == 0]), (odd, f[weight == 1])):
                    rec = np.empty((len(own), len(masks)), dtype=RECORD)
                    rec["variant"] = own[:, None] ^ masks[None, :]
                    rec["mask"] = np.arange(len(masks), dtype=np.uint16)[None, :]
                    if masks is odd:
                        rec["mask"] |= 1 << 15
                    pieces.append(rec.reshape(-1))
                rec = np.concatenate(pieces)
                part = ((rec["variant"] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)
                order = np.argsort(part.astype(np.uint16 if parts <= 65536 else np.uint32), kind="stable")
                rec, counts = rec[order], np.bincount(part.astype(np.int64), minlength=parts)
                ends = np.cumsum(counts)
                own = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), pa.array([rec[ends[p] - counts[p] : ends[p]].tobytes() for p in own], pa.binary())], ["part", "blob"]
                )

    return fps.select("fp").mapInArrow(frugal(run), "part int, blob binary")


def collide(variants: DataFrame, parts: int, radius: int = 3) -> DataFrame:
    """Distinct verified links ``(u, v)`` between fingerprints that met in a variant.

    In a group that met in one variant, members at distance one or less from it are linked to all
    others (at most 1 + 2 bits), so a star from the nearest member spans the group; members that are
    all two bits away link, if at all, through another variant. A group therefore emits as many
    links as members, never their pairs, and loses no component.
    """

    def run(batches):
        even, odd = ball_masks()
        blobs = [x for b in batches for x in b.column(1).to_pylist()]
        if not blobs:
            return
        rec = np.concatenate([np.frombuffer(x, dtype=RECORD) for x in blobs])
        del blobs
        order = np.argsort(rec["variant"])
        same = np.empty(len(rec), dtype=bool)
        v = rec["variant"][order]
        same[0], same[1:] = False, v[1:] == v[:-1]
        live = same.copy()
        live[:-1] |= same[1:]
        rec, v = rec[order[live]], v[live]
        if not len(rec):
            return
        is_odd, number = (rec["mask"] >> 15).astype(bool), rec["mask"] & 0x7FFF
        mask = np.where(is_odd, odd[np.minimum(number, len(odd) - 1)], even[np.minimum(number, len(even) - 1)])
        fp, dist = v ^ mask, np.bitwise_count(mask)
        order = np.lexsort((fp, dist, v))
        fp, dist, v = fp[order], dist[order], v[order]
        head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(v))))
        centre = fp[head][group]
        ok = (dist[head][group] <= 1) & (centre != fp) & (np.bitwise_count(centre ^ fp) <= radius)
        pairs = np.unique(np.stack([centre[ok].view(np.int64), fp[ok].view(np.int64)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    dealt = variants.repartitionById(parts, F.col("part"))
    return dealt.mapInArrow(frugal(run), "u long, v long")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", fps_per_part: int = 12_000) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each input row.

    Fingerprints link at three or fewer differing bits; ``component_id`` is the smallest doc_id
    reachable through links, itself included. Exact copies share a fingerprint and are reduced to
    one before variants are made, so a hot group of copies costs one fingerprint, and its rows get
    their component without a shuffle (``common.by_key``). Repeated doc_ids give one row each; a null
    doc_id gets the smallest other doc_id of its component, or null. An empty table gives no rows.
    Every part holds the variants of about ``fps_per_part`` fingerprints
    (7 MB per thousand while sorted), whatever the input's size.
    """
    fps = materialize(fingerprints(docs, words_per_shingle, id_col, text_col), "fingerprints")
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "distinct-fingerprints")
    n, rows = least.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    parts = max(1, -(-n // fps_per_part), int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")) if n > 1000 else 1)
    spread = least.select("fp").repartition(max(1, -(-n // 4096)))
    links = collide(emit_variants(spread, parts), parts)
    found = components(links)
    member = found.join(least, found["node"] == least["fp"]).select("node", "component", "least")
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = member.join(smallest, "component").select(F.col("node").alias("fp"), "component_id")
    whole = least.join(linked, "fp", "left").select("fp", "copies", F.coalesce("component_id", "least").alias("component_id"))
    whole = materialize(whole, "fingerprint-components")
    return by_key(fps, whole, "fp", rows).select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, and windows of the resulting templates are
hash-joined with those of the benchmark. Windows that lie on one alignment of a document with an item
make a passage, and the values in its slots must map one to one to the item's, which also catches
questions asked again with other numbers or names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.llm.common import frugal, kept, keyed_texts, slices, table
from ontoweave.plans.storage import discard, materialize

# The words that count as numbers and as units.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs ounce ounces gram grams kilogram kilograms ml l litre litres liter liters s sec second seconds minute minutes hour hours day days week weeks month months year years percent dollars dollar euro euros pounds cents mph kmh degrees hz khz mhz ghz kb mb gb tb w kw v".split())
NUMERIC = re.compile(r"[+-]?[$€£]?\d[\d,.:/]*(%|st|nd|rd|th)?")
MEASURE = re.compile(r"([+-]?\d[\d,.]*)([a-zµ°]+)")
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…–—¿¡·•"
#: Low bits of a word's code: is a number, may be a unit, is capitalised, ends a sentence.
NUM, UNIT, CAP, STOP, FLAGS = 1, 2, 4, 8, 15


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) & ~FLAGS


CODE_NUM, CODE_NAME, CODE_UNIT, CODE_MEASURE = _hash("<num>"), _hash("<name>"), _hash("<unit>"), _hash("<num><unit>")


class _Codes(dict):
    """Codes of words with their flags, forgotten when there are many; 0 for tokens without letter or digit."""

    def __missing__(self, w: str) -> int:
        if len(self) > 400_000:
            self.clear()
        core = w.strip(STRIP)
        low = core.lower()
        stop = STOP if w.rstrip("\"')]»”’")[-1:] in ".!?:" else 0
        if not core:
            code = 0
        elif NUMERIC.fullmatch(low) or low in NUMBERS:
            code = CODE_NUM | NUM | stop
        elif (m := MEASURE.fullmatch(low)) and m.group(2) in UNITS:
            code = CODE_MEASURE | NUM | stop
        else:
            code = _hash(low) | (UNIT if low in UNITS else 0) | (CAP if core[0].isupper() and not core.isupper() else 0) | stop
        self[w] = code
        return code


_CODES = _Codes()


def template(text: str, begins: bool = True) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Template codes, slot types (0 none, else the placeholder), the words, and each code's word number.

    A capital makes a name unless the word begins a sentence, as the first one does if ``begins``.
    """
    words = text.split()
    raw = np.fromiter(map(_CODES.__getitem__, words), dtype=np.uint64, count=len(words))
    at = np.flatnonzero(raw)
    raw = raw[at]
    flags = (raw & np.uint64(FLAGS)).astype(np.int8)
    codes = raw & ~np.uint64(FLAGS)
    n = len(raw)
    slots = np.zeros(n, dtype=np.int8)
    if n:
        first = np.empty(n, dtype=bool)
        first[0], first[1:] = begins, (flags[:-1] & STOP) > 0
        after_number = np.zeros(n, dtype=bool)
        after_number[1:] = (flags[:-1] & NUM) > 0
        name = ((flags & CAP) > 0) & ~first
        unit = ((flags & UNIT) > 0) & after_number
        number = (flags & NUM) > 0
        slots[number], slots[name], slots[unit] = 1, 2, 3
        codes[name], codes[unit] = CODE_NAME, CODE_UNIT
    return codes, slots, words, at


class _Literals(dict):
    """Hashes of the words themselves, forgotten when there are many."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1 << 16:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w.strip(STRIP).lower(), 3)
        return h


_LITERALS = _Literals()
kept(__name__, _CODES.clear, _LITERALS.clear)


def _rolled(codes: np.ndarray, width: int) -> np.ndarray:
    n = len(codes) - width + 1
    h = np.full(max(n, 0), width, dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def literals(words: list[str], at: np.ndarray) -> np.ndarray:
    return np.fromiter(map(_LITERALS.__getitem__, (words[i] for i in at.tolist())), dtype=np.uint64, count=len(at))


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in the filter, ``bits`` a power of two."""
    return h & np.uint64(bits - 1), ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(20)) & np.uint64(bits - 1)


def window_hashes(codes: np.ndarray, slots: np.ndarray, words: list[str], at: np.ndarray, width: int) -> np.ndarray:
    """One hash per window of ``width`` codes; of the words themselves where fewer than half of them (rounded down) are not placeholders."""
    h = _rolled(codes, width)
    count = np.concatenate([[0], np.cumsum(slots == 0)])
    bare = np.flatnonzero(count[width:] - count[:-width] < width // 2) if len(h) else ()
    if len(bare):
        h[bare] = _rolled(literals(words, at) ^ np.uint64(1), width)[bare]
    return h


@dataclass(frozen=True)
class Decontamination:
    """Parameters.

    width: words of a template window. coverage, run: a document leaks an item if matched windows on
    one alignment cover this share of the item's words, or this many words without a break.
    consistency: share of the aligned slots that must follow one mapping of values, one to one by
    kind of slot. least_item: items with fewer words leak only where all their words follow one
    another as they are. filter_bits: most bits, a power of two, of the filter of benchmark windows that
    goes to the executors; a larger benchmark lets more windows pass to the join, which decides.
    """

    width: int = 5
    coverage: float = 0.5
    run: int = 13
    consistency: float = 0.8
    least_item: int = 8
    filter_bits: int = 1 << 27


WORD = re.compile(r"\S+")
#: How a passage looks: its text, the template, what is covered, the item's places with slots and the values there, code points.
PASSAGE = "dkey string, ckey long, coverage double, longest_run long, pos array<int>, value array<string>, start int, end int"


def _cores(words: list[str], at) -> list[str]:
    return [words[i].strip(STRIP).lower() for i in at]


def _items(benchmark: DataFrame, p: Decontamination, id_col: str, text_col: str) -> DataFrame:
    """``(item_id, ckey, words, slots, hashes, pos)`` per item: its template's name, words and windows; short items have one window, the whole."""
    rows = keyed_texts(benchmark, id_col, text_col)
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["item_id", "ckey", "words", "slots", "hashes", "pos"]

    def run(batches):
        for b in slices(batches):
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes, slots, words, at = template(t)
                # Inside a document the item need not begin a sentence; its first word may then look like a name.
                inside, inside_slots, *_ = template(t, False)
                n = len(codes)
                if not n:
                    continue
                if n < p.least_item:
                    h = _rolled(literals(words, at), n)
                    pairs = [(int(h[0]), 0)]
                    name = literals(words, at).tobytes()
                else:
                    both = zip(window_hashes(codes, slots, words, at, p.width).tolist(), window_hashes(inside, inside_slots, words, at, p.width).tolist())
                    pairs = [(h, pos) for pos, hs in enumerate(both) for h in set(hs)]
                    name = codes.tobytes() + inside.tobytes()
                hashes = np.array([h for h, _ in pairs], dtype=np.uint64).view(np.int64).tolist()
                ckey = int(np.uint64(xxhash.xxh3_64_intdigest(name + bytes([min(n, p.least_item)]))).astype(np.int64))
                out.append((i, ckey, _cores(words, at), np.maximum(slots, inside_slots).tolist(), hashes, [pos for _, pos in pairs]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    made = rows.mapInArrow(frugal(run), "item_id long, ckey long, words array<string>, slots array<int>, hashes array<long>, pos array<int>")
    return materialize(made, "items")


def _filter(items: DataFrame, p: Decontamination) -> tuple[np.ndarray, list[int]]:
    """A bitmap of all windows' hashes, at most ``filter_bits``, and the lengths of short items."""
    n, short = items.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)), F.collect_set(F.when(F.size("words") < p.least_item, F.size("words")))).first()
    bits = min(p.filter_bits, 1 << max(16, (256 * n - 1).bit_length())) if n else 1 << 16

    def run(batches):
        out = np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            for h in _probes(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64), bits):
                np.bitwise_or.at(out, (h >> np.uint64(3)).astype(np.int64), (1 << (h & np.uint64(7))).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["bits"])

    whole = np.zeros(bits // 8, dtype=np.uint8)
    for r in items.select("hashes").mapInArrow(frugal(run), "bits binary").toLocalIterator():  # one task's bitmap at a time
        whole |= np.frombuffer(r["bits"], dtype=np.uint8)
    return whole, sorted(short)


def _windows(texts: DataFrame, seen_bits: np.ndarray, short: list[int], p: Decontamination) -> DataFrame:
    """``(doc_id, dkey, h, d, start, end, words)``: per text the windows that pass the filter, as arrays; texts without any go.

    A text that comes again in one task brings no windows the second time.
    """
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
    names = ["doc_id", "dkey", "h", "d", "start", "end", "words"]
    size = len(seen_bits) * 8

    def passing(h):
        one, two = _probes(h, size)
        hits = np.flatnonzero((seen_bits[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)) & 1)
        at = two[hits]
        return hits[((seen_bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]

    def run(batches):
        known: dict[str, bool] = {}
        for b in slices(batches):
            out = []
            for doc, t, key in zip(*(b.column(i).to_pylist() for i in range(3))):
                if key in known:
                    if known[key]:
                        out.append((doc, key, [], [], [], [], []))
                    continue
                codes, slots, words, at = template(t)
                found = []  # hash, first code, length
                h = window_hashes(codes, slots, words, at, p.width)
                found += [(x, d, p.width) for d, x in zip(hits.tolist(), h[hits].tolist())] if len(hits := passing(h)) else []
                if short:
                    own = literals(words, at)
                    for n in short:
                        h = _rolled(own, n)
                        found += [(x, d, n) for d, x in zip(hits.tolist(), h[hits].tolist())] if len(hits := passing(h)) else []
                if len(known) > 100_000:
                    known.clear()
                known[key] = bool(found)
                if found:
                    places = [m.span() for m in WORD.finditer(t)]
                    hs = np.array([x for x, *_ in found], dtype=np.uint64).view(np.int64).tolist()
                    out.append((doc, key, hs, [d for _, d, _ in found], [places[at[d]][0] for _, d, _ in found], [places[at[d + n - 1]][1] for _, d, n in found], [" ".join(_cores(words, at[d : d + n])) for _, d, n in found]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    made = texts.mapInArrow(frugal(run), "doc_id long, dkey string, h array<long>, d array<int>, start array<int>, end array<int>, words array<string>")
    return materialize(made, "windows")


class _Alignment:
    """Windows ``(d, pos, start, end, words)`` of one copy of an item, in order."""

    __slots__ = ("windows",)

    def __init__(self, first):
        self.windows = [first]

    def passage(self, size: int, slots: list[int], p: Decontamination):
        """``(coverage, longest run, places, values, start, end)``, or None if too little is covered."""
        covered, longest, begin, last = np.zeros(size, dtype=bool), 0, None, None
        values: dict[int, str] = {}
        for d, pos, _, _, words in self.windows:
            covered[pos : pos + p.width] = True
            begin = d if last != (d - 1, pos - 1) else begin
            last = (d, pos)
            longest = max(longest, d - begin + p.width)
            for j, w in enumerate(words.split(" ")):
                if slots[pos + j]:
                    values.setdefault(pos + j, w)
        share = float(covered.mean())
        if share < p.coverage and longest < p.run:
            return None
        places = sorted(values)
        return share, longest, places, [values[k] for k in places], self.windows[0][2], max(w[3] for w in self.windows)


def alignments(windows, size: int):
    """The alignments in windows sorted by place in the document: every diagonal, and chains that go forward in both texts.

    A window goes on with the chain of the nearest diagonal, the longest of equals, so a copy with
    words put in or left out is one chain. Diagonals and chains end where no window follows within the
    item's size, so what is open is bounded by the item.
    """
    diagonals: dict[int, _Alignment] = {}
    chains: list[_Alignment] = []
    for w in windows:
        d, pos = w[0], w[1]
        for k in [k for k, x in diagonals.items() if d - k > size]:
            yield diagonals.pop(k)
        yield from (c for c in chains if d - c.windows[-1][0] > size and _bends(c))
        chains = [c for c in chains if d - c.windows[-1][0] <= size]
        if (mine := diagonals.get(d - pos)) is None:
            diagonals[d - pos] = _Alignment(w)
        elif mine.windows[-1][0] != d:
            mine.windows.append(w)
        before = [c for c in chains if c.windows[-1][0] < d and c.windows[-1][1] < pos]
        if before:
            min(before, key=lambda c: (abs(d - pos - c.windows[-1][0] + c.windows[-1][1]), -len(c.windows))).windows.append(w)
        else:
            chains.append(_Alignment(w))
    yield from diagonals.values()
    yield from (c for c in chains if _bends(c))


def _bends(c: _Alignment) -> bool:
    """Not on one diagonal, which is judged anyway."""
    return len({d - pos for d, pos, *_ in c.windows}) > 1


def consistent(pairs: list[tuple[int, str, str]]) -> int:
    """Slots ``(kind, item's value, document's value)`` that follow one mapping, one to one within a kind, the most frequent first."""
    ahead: dict[tuple[int, str], str] = {}
    back: dict[tuple[int, str], str] = {}
    agreed = 0
    for (kind, a, b), n in sorted(Counter(pairs).items(), key=lambda x: (-x[1], x[0])):
        if ahead.setdefault((kind, a), b) == b and back.setdefault((kind, b), a) == a:
            agreed += n
    return agreed


def _passages(met: DataFrame, p: Decontamination) -> DataFrame:
    """``PASSAGE`` rows of windows ``(dkey, ckey, d, pos, start, end, words, size, slots)`` sorted by text, template and place."""
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32(), pa.int32()]
    names = ["dkey", "ckey", "coverage", "longest_run", "pos", "value", "start", "end"]

    def rows(batches):
        last = None
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(9))):
                if r[:4] != last:  # a text that two tasks held, or a hash that both forms of an item share
                    yield r
                last = r[:4]

    def run(batches):
        stream, out = rows(batches), []
        head = next(stream, None)
        while head is not None:
            group, size, slots = head[:2], head[7], head[8]

            def own():
                nonlocal head
                while head is not None and head[:2] == group:
                    yield head[2:7]
                    head = next(stream, None)

            if size < p.least_item:
                for d, _, start, end, words in own():
                    values = words.split(" ")
                    out.append((*group, 1.0, size, list(range(size)), values, start, end))
            else:
                for a in alignments(own(), size):
                    if x := a.passage(size, slots, p):
                        out.append((*group, *x))
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return met.mapInArrow(frugal(run), PASSAGE)


def _judged(passages: DataFrame, p: Decontamination) -> DataFrame:
    """``(dkey, item_id, coverage, longest_run, n_slots, n_consistent, verbatim, start, end)`` of the passages, joined with items, whose slots are consistent."""
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
    names = ["dkey", "item_id", "coverage", "longest_run", "n_slots", "n_consistent", "verbatim", "start", "end"]

    def run(batches):
        for b in batches:
            out = []
            for key, item, share, longest, pos, value, start, end, words, slots in zip(*(b.column(i).to_pylist() for i in range(10))):
                same = all(words[k] == v for k, v in zip(pos, value))
                pairs = [(slots[k], words[k], v) for k, v in zip(pos, value)]
                agreed = consistent(pairs)
                if same or (len(words) >= p.least_item and agreed >= p.consistency * len(pairs)):
                    out.append((key, item, share, longest, len(pairs), agreed, same, start, end))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return passages.mapInArrow(frugal(run), "dkey string, item_id long, coverage double, longest_run long, n_slots long, n_consistent long, verbatim boolean, start long, end long")


def _found(docs: DataFrame, benchmark: DataFrame, p: Decontamination, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, dkey)`` of the texts with windows of the benchmark, and every leak by text and item."""
    items = _items(benchmark, p, item_col, item_text_col)
    texts = keyed_texts(docs, id_col, text_col).withColumn("dkey", F.md5("text"))
    windows = _windows(texts, *_filter(items, p), p)
    mine = windows.select("dkey", F.explode(F.arrays_zip("h", "d", "start", "end", "words")).alias("w")).select("dkey", "w.*")
    # Items of one template share its windows; which of them a passage follows is judged afterwards.
    templates = items.dropDuplicates(["ckey"])
    theirs = templates.select("ckey", F.explode(F.arrays_zip("hashes", "pos")).alias("w")).select("ckey", F.col("w.hashes").alias("h"), F.col("w.pos").alias("pos"))
    about = templates.select("ckey", F.size("words").alias("size"), "slots")
    met = mine.join(theirs, "h").join(about, "ckey")
    met = met.select("dkey", "ckey", "d", "pos", "start", "end", "words", "size", "slots").repartition("dkey", "ckey").sortWithinPartitions("dkey", "ckey", "d", "pos")
    # Both sides of the join run Python; written in between, a task needs one worker at a time.
    covered = materialize(_passages(met, p), "passages")
    passages = covered.join(items.select("item_id", "ckey", F.col("words").alias("item_words"), F.col("slots").alias("item_slots")), "ckey")
    judged = _judged(passages.select("dkey", "item_id", "coverage", "longest_run", "pos", "value", "start", "end", "item_words", "item_slots"), p)
    order = [F.col("coverage"), F.col("longest_run"), F.col("verbatim"), (-F.col("start")).alias("m"), F.col("end"), F.col("n_slots"), F.col("n_consistent")]
    best = judged.groupBy("dkey", "item_id").agg(F.max(F.struct(*order)).alias("x"))
    leaks = best.select("dkey", "item_id", "x.coverage", "x.longest_run", "x.n_slots", "x.n_consistent", "x.verbatim", (-F.col("x.m")).alias("start"), "x.end")
    leaks = materialize(leaks, "leaks")
    discard(covered)
    discard(items)
    return windows, leaks


def leaks(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, coverage, longest_run, n_slots, n_consistent, verbatim, start, end)``, one row per document and item.

    start and end are code points of the passage. Null and wordless texts and items never match;
    repeated rows of a document give one row; an item_id that several items have is reported once a
    document, with its best passage; empty tables give no rows. A null doc_id or item_id stays null.
    One pass over the documents, from which only windows that pass the benchmark's filter are
    shuffled. A document's words are held in a task.
    """
    windows, found = _found(docs, benchmark, p, id_col, text_col, item_col, item_text_col)
    return windows.select("doc_id", "dkey").distinct().join(found, "dkey").drop("dkey")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination(), text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` whose text leaks no item; rows with a null or empty text stay, repeated rows share their fate, an empty table stays empty."""
    windows, found = _found(docs.select(F.lit(0).alias("doc_id"), F.col(text_col)), benchmark, p, "doc_id", text_col, "item_id", "text")
    discard(windows)
    key = "_text_key"
    while key in docs.columns:
        key += "_"
    bad = found.select(F.col("dkey").alias(key)).distinct()
    return docs.withColumn(key, F.md5(F.coalesce(F.col(text_col), F.lit("")))).join(bad, key, "left_anti").select(*docs.columns)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item in a document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

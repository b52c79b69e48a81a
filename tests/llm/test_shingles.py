"""Shingle similarity against brute force, and the pipeline stage that uses it."""

import random

import numpy as np

import corpus_pipeline
from ontoweave.llm import shingles
from ontoweave.llm.shingles import Shingling, similar_documents


def brute(rows, k=5, similarity=0.8):
    """The smallest id that links reach, over all pairs, with sets of word tuples."""

    def shingles(text):
        words = text.encode().lower().split()
        return {tuple(words)} if len(words) <= k else set(zip(*[words[i:] for i in range(k)]))

    sets = [shingles(t or "") for _, t in rows]
    label = [i for i, _ in rows]
    moved = True
    while moved:
        moved = False
        for a in range(len(rows)):
            for b in range(a):
                if label[a] != label[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    return dict(zip([i for i, _ in rows], label))


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    passage = [word() for _ in range(40)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(r.choice([7, 30, 120]))] + (passage if g % 3 == 0 else [])
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows) + 10, " ".join(w)))
    long = [word() for _ in range(60)]
    rows += [(len(rows) + 10, " ".join(long[i : i + 40])) for i in range(0, 20, 2)]  # a chain of shifts
    rows += [(880, "a a a a a"), (881, "a a A a a a"), (882, "a a a a"), (900, None), (901, ""), (902, "  "), (903, "one two"), (904, "One  two"), (905, "one three"), (906, "a b c d e"), (907, "A b c d e"), (1, rows[30][1])]
    return rows


def test_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert 30 < sum(a != b for a, b in want.items()) < len(want) - 30
    for p in (Shingling(), Shingling(stars=0), Shingling(sample=20, common=5, stars=1)):
        assert {r["doc_id"]: r["component_id"] for r in similar_documents(df, p).collect()} == want
    assert {r["doc_id"]: r["component_id"] for r in similar_documents(df, Shingling(similarity=0.5)).collect()} == brute(rows, similarity=0.5)
    assert similar_documents(df.where("false")).collect() == []


def test_stage_drops_near_copies_with_a_few_edits(spark):
    r = random.Random(7)
    words = ["".join(r.choices("klmnoprst", k=5)) for _ in range(200)]
    edited = list(words)
    edited[40], edited[90], edited[150] = "x", "y", "z"  # similarity 181 / 211
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert {x["doc_id"] for x in corpus_pipeline.near_duplicate(spark, docs, "").collect()} == {1, 3}


def test_joins_and_parts_match_brute_force(spark):
    """Components too large for a task, many parts and slices of a few texts give the same classes."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    want = brute(rows)
    for p in (Shingling(local=0), Shingling(local=0, stars=0), Shingling(local=4000, block=2048)):
        assert {r["doc_id"]: r["component_id"] for r in similar_documents(df, p).collect()} == want


def test_few_rows_are_written_for_a_text(spark, monkeypatch):
    """Texts that share most of their words but are not alike, and near copies, make few rows each, however many they are."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    common, base, keep = [word() for _ in range(90)], [word() for _ in range(150)], shingles.materialize
    written = []
    monkeypatch.setattr(shingles, "materialize", lambda df, label="t": written.append((label, (out := keep(df, label)).count())) or out)

    def rows(n):
        texts = [" ".join([*common, *(word() for _ in range(60))]) for _ in range(n)]
        near = [list(base) for _ in range(n)]
        for x in near[1:]:
            x[r.randrange(150)] = word()
        docs = [(i, t) for i, t in enumerate(texts + [" ".join(x) for x in near])]
        written.clear()
        got = similar_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), Shingling(sample=20, common=5))
        assert {x["doc_id"]: x["component_id"] for x in got.collect()} == {i: min(i, n) for i in range(2 * n)}
        return sum(x for _, x in written)

    assert rows(30) < 15 * 60 and rows(150) < 15 * 300  # 168 a text where joins paired what a sample's order let meet


def test_near_copies_are_compared_with_few(monkeypatch):
    r = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([np.arange(100, dtype=np.uint64) + 7, r.integers(1 << 40, 1 << 60, 5).astype(np.uint64)])) for _ in range(200)]
    at = [np.arange(21, dtype=np.uint32)] * 200
    seen, was = [], shingles.alike
    monkeypatch.setattr(shingles, "alike", lambda *x: seen.append(1) or was(*x))
    links = shingles.linked(list(range(200)), [s[:21] for s in sets], at, sets, 0.8)
    assert len(links) == 199 == len(seen)


def test_only_shingles_of_one_text_have_no_frequency():
    nodes = np.array([5, 6, 7], dtype=np.uint64)
    key = lambda *x: np.array(x, dtype=np.uint64) << np.uint64(20)
    one = shingles._packed(nodes, [key(1, 2, 3), key(2, 4), key(9)], 4)
    two = shingles._packed(nodes[1:2], [key(4, 8, 3)], 4)
    scale = shingles.frequencies(np.concatenate([one[0], two[0]]))
    got = {}
    for (rec, *_), s in zip((one, two), (scale[: len(one[0])], scale[len(one[0]) :])):
        got |= {int(k): got.get(int(k), set()) | {int(x)} for k, x in zip(rec >> np.uint64(20), s)}
    assert got == {1: {0}, 2: {9}, 3: {9}, 4: {1}, 8: {0}, 9: {0}}  # 4: of the same text in both slices

"""The importance weights and the draw against brute force, and words that are rare each but start alike."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from ontoweave.llm import quality

SF = "/root/testdata/sf0.001"


def test_rare_forms_of_a_word_count_together(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(300)]
    text = lambda: " ".join(r.choices(words, k=30))
    docs = [(i, text()) for i in range(800)]
    docs += [(1000 + i, f"{text()} zurgo{i} zurgo{i}x") for i in range(60)]  # every form in one document only
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {x["doc_id"] for x in quality.resample(df, labels, quality.Resampling(keep=800 / 860)).collect()}
    assert len(kept) == 800 and len([d for d in kept if d >= 1000]) < 6


def test_pairs_leave_the_counts_of_words_alone():
    one, two = quality.grams("alpha", 64, (1, 2)), quality.grams("alpha beta gamma delta", 64, (1, 2))
    assert set(one) <= set(two) and (np.bincount(two // 64, minlength=3) > 0).all()


def test_ratios_of_chance_are_small_and_none_is_left_out():
    p = quality.Resampling()
    raw, target = np.array([100, 110, 90, 4000, 700]), np.array([10, 9, 11, 400, 0])
    ratio = quality.log_ratios(raw, target, p)
    assert ratio[4] < -3 and (np.abs(ratio[:3]) < 0.05).all() and (ratio[[0, 1, 2, 3]] != 0).any()


def slow(docs, labels, p):
    """Weights and keys by plain loops over features that are named by strings' hashes."""

    def bucket(h, part):
        return (h >> 32) % p.buckets + part * p.buckets

    def features(text):
        words = re.findall(r"\w+|[^\w\s]+", text.lower())
        h = [xxhash.xxh64_intdigest(w) for w in words]
        m = (1 << 64) - 1
        out = [bucket(((x ^ 1) * 0xD6E8FEB86659FD93) & m, 0) for x in h]
        out += [bucket(((((a * 0x9E3779B97F4A7C15 + b) & m) ^ 2) * 0xD6E8FEB86659FD93) & m, 1) for a, b in zip(h, h[1:])]
        return out + [bucket(xxhash.xxh64_intdigest(w[:5], 1), 2) for w in words]

    bags = {d: Counter(features(t)) for d, t in docs}
    raw, target = Counter(), Counter()
    for d, bag in bags.items():
        raw.update(bag)
        if labels.get(d) == (1, 0):
            target.update(bag)
    scale = sum(target.values()) / sum(raw.values())
    ratio = {}
    for g, n in raw.items():
        e, t = n * scale, target[g]
        deviance = max(0, 2 * ((t * math.log(t / e) if t else 0) - t + e))
        ratio[g] = math.log((t + p.prior) / (e + p.prior)) * deviance**2 / (deviance**2 + p.shrink)
    weight = {d: sum(ratio[g] * n for g, n in bag.items()) for d, bag in bags.items()}
    noise = lambda d: -math.log(-math.log(((xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), p.seed) >> 11) + 0.5) / 2**53))
    return weight, {d: w + noise(d) for d, w in weight.items()}


def test_the_query_draws_what_brute_force_draws(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    p = quality.Resampling()
    weight, key = slow(docs, labels, p)
    k = round(len(docs) * sum(v == (1, 0) for v in labels.values()) / len(labels))
    want = sorted(key, key=lambda d: -key[d])[:k]
    got = {r["doc_id"]: r for r in quality.op1_quality(spark, SF).collect()}
    assert got.keys() == set(want) and 0 < k < len(docs)
    for d, r in got.items():
        assert r["log_weight"] == pytest.approx(weight[d], abs=1e-6) and r["gumbel_key"] == pytest.approx(key[d], abs=1e-6)


def test_the_draw_is_a_sample_and_not_a_cutoff(spark):
    """Documents of equal weight are drawn by chance, another seed draws others, and all of them are k."""
    docs = spark.createDataFrame([(i, "the same words in every one") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    one, two = ({r["doc_id"] for r in quality.resample(docs, labels, quality.Resampling(seed=s)).collect()} for s in (1, 2))
    assert len(one) == len(two) == 200 and 60 < len(one & two) < 140

"""Cover trees against brute force; the pipeline's stages against what they promise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ontoweave.llm import covertree
from ontoweave.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, cosine):
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n in {len(v) for _, v in sound}:
        ids = [i for i, v in sound if len(v) == n]
        x = np.array([v for _, v in sound if len(v) == n], dtype=float)
        norm = np.linalg.norm(x, axis=1)
        near = (x @ x.T) / (norm[:, None] * norm[None, :]) >= cosine
        np.fill_diagonal(near, False)
        label = np.array(ids)
        while True:
            new = np.minimum(label, np.where(near, label[None, :], 1 << 60).min(axis=1))
            if (new == label).all():
                break
            label = new
        out |= {i: (int(near[k].sum()), int(label[k])) for k, i in enumerate(ids)}
    return {i: out.get(i, (0, i)) for i, _ in rows}


@pytest.mark.parametrize("p", [covertree.CoverTree(), covertree.CoverTree(block=40, pivots=8), covertree.CoverTree(cosine=0.6, block=64, pivots=16)])
def test_links_match_brute_force(spark, p):
    r = np.random.default_rng(0)
    centre = r.normal(size=(6, 24))
    rows = [(i, (centre[i % 6] + r.choice([0.05, 0.3, 0.6]) * r.normal(size=24)).tolist()) for i in range(260)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)]  # equal vectors
    rows += [(2000 + i, r.normal(size=3).tolist()) for i in range(60)]  # another length
    rows += [(3000, None), (3001, [0.0] * 24), (3002, [float("nan")] * 24), (3003, []), (3004, [None, 1.0]), (3005, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("links", F.lit("clash")).withColumn("block", F.lit(1)).repartition(3)
    got = covertree.near_duplicates(df, p).collect()
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in got} == brute(rows, p.cosine)
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got)


def test_vectors_without_id_and_no_vectors(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((tuple(x) for x in covertree.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, False)]
    assert covertree.near_duplicates(df.where("false")).collect() == []


def test_tree_covers_and_nests():
    r = np.random.default_rng(2)
    raw = r.normal(size=(300, 8))
    tree = covertree.build(raw, 4)
    x = (raw / np.linalg.norm(raw, axis=1, keepdims=True))[tree["order"]]
    for level in range(5):
        ends = tree[f"end{level}"]
        assert ends[-1] == 300 and (tree[f"start{level}"][1:] == ends[:-1]).all()
        for c, a, b, radius in zip(tree[f"centre{level}"], tree[f"start{level}"], ends, tree[f"radius{level}"]):
            far = np.linalg.norm(x[a:b] - x[c], axis=1).max()
            assert a <= c < b and far <= radius + 1e-6 and far <= 2.0 / 2**level + 1e-6
        if level:
            assert set(tree[f"centre{level - 1}"]) <= set(tree[f"centre{level}"])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    planted = [(90_001, "unique text of its own " + leak, "en", "x", 1), (90_002, "some plain words about nothing at all, token = abcdef1234567890 indeed", "en", "x", 1), (90_003, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    docs = docs.union(docs.limit(3)).withColumn("fp", F.lit("clash")).withColumn("_key2", F.lit(1))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 90_001 in seen["near_duplicate"] and 90_001 not in seen["decontaminate"]
    assert "[SECRET]" in seen["secrets"][90_002] and seen["secrets"].keys() == seen["decontaminate"].keys()
    assert docs.count() == docs.select("doc_id").distinct().count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(seen["secrets"])
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_every_query_runs_whole(spark):
    for name, columns in {"op2_suffixes": 200, "op3_decontaminate": None, "op9_secrets": 200, "op7_simhash": 200, "op10_covertree": 500}.items():
        got = QUERIES[name](spark, SF)
        assert columns is None or got.count() == columns


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_vectors_of_any_size_link_by_cosine(spark):
    one = [3.0, 4.0, 0.5]
    rows = [(i, [x * s for x in one]) for i, s in enumerate((1.0, 1e200, 1e-200, 1e300, 1e-300))] + [(9, [1e300, -1e300, 1e300])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (4, 0) for i in range(5)} | {9: (0, 9)}


def test_balls_far_apart_do_not_meet(spark):
    """Clusters at right angles: the trees that travel are those of one cluster."""
    r = np.random.default_rng(4)
    rows = [(i, (np.eye(16)[i % 8] + 0.01 * r.normal(size=16)).tolist()) for i in range(400)]
    p = covertree.CoverTree(block=50, pivots=8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in covertree.near_duplicates(df, p).collect()}
    assert got == {i: (49, i % 8) for i in range(400)} == brute(rows, 0.9)

"""What Python workers hold: one worker a task, and nothing of earlier operators."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

from ontoweave.llm import decontaminate, packing, quality, shingles, tokens
from ontoweave.llm.common import frugal


def test_decontaminate_has_one_python_operator_a_task(spark, monkeypatch):
    r"""Two in one task need two workers at once; counted along each path of the plans between exchanges."""
    plans, write = [], decontaminate.materialize

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(decontaminate, "materialize", seen)
    item = "Ann has 12 red apples and gives 5 of them to her brother before lunch on Monday"
    docs = spark.createDataFrame([(1, f"so it goes . {item} . the end"), (2, "nothing of the kind is said in this text")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.drop_leaking(docs, benchmark).collect()] == [2]
    found = 0
    for plan in plans:
        path: list[tuple[int, bool | None]] = []  # depth of each node above; whether it is Python, None for an exchange
        for line in plan.split("\n"):
            m = re.match(r"([\s:+|*()\d-]*)(\w+)", line)
            if m is None:
                continue
            depth = len(re.match(r"[\s:+-]*", line)[0])
            path = [x for x in path if x[0] < depth]
            kind = None if "Exchange" in m[2] else m[2] == "MapInArrow"
            found += bool(kind)
            if kind:
                above = [k for _, k in path]
                since = above[max((i for i, k in enumerate(above) if k is None), default=-1) + 1 :]
                assert not any(since), plan
            path.append((depth, kind))
    assert found >= 4


def test_a_task_drops_what_other_operators_left():
    quality.grams("some words of a text", 1 << 10, (1, 2))
    decontaminate.template("some words of a text")
    shingles.shingle_set([b"some", b"words"], 2)
    tokens.encoder(packing.default_path())

    def run(batches):
        shingles.shingle_set([b"more", b"words"], 2)
        yield from batches

    run.__module__ = shingles.__name__
    assert list(frugal(run)(iter([1, 2]))) == [1, 2]
    assert not quality._HASHES and not quality._STEMS and not decontaminate._CODES and not decontaminate._LITERALS
    assert tokens.encoder.cache_info().currsize == 0
    assert {b"some", b"more", b"words"} <= set(shingles._HASHES)  # its own stay


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_a_task_gives_memory_back():
    code = """
import re
import pyarrow as pa
from ontoweave.llm.common import frugal

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def run(batches):
    for b in batches:
        texts = [b"x" * 3000 for _ in range(30_000)]
        arrays = [pa.array(texts[i : i + 100]) for i in range(0, 30_000, 100)]
        texts, last = None, b"y" * 3000  # the C heap can't shrink from its end
        yield last

pa.array([b"x"])  # imports come first
before = held()
out = list(frugal(run)(iter([1, 2])))
print(held() - before)
"""
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, check=True)
    assert float(done.stdout) < 20

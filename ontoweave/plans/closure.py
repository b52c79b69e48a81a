"""Transitive closure: breadth-first on the driver for small edge lists, else doubling with DataFrames."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.plans.storage import materialize

#: Distinct edges up to which the driver does the work; the closure then has 250,000 pairs at most.
DRIVER_EDGES = 500


def closure(edges: DataFrame, src: str, dst: str, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """``(src, dst)`` for every path of one edge or more; ``(x, x)`` only for nodes on a cycle.

    Cycles are fine. Beyond ``driver_edges`` distinct edges each round joins the newest pairs with all
    pairs found so far, so the rounds grow with the logarithm of the longest path, and only new pairs
    go on; each round is cut off in the shared folder.
    """
    base = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    spark = edges.sparkSession
    few = base.limit(driver_edges + 1).collect()
    if len(few) <= driver_edges:
        pairs = closure_of([(r["a"], r["b"]) for r in few])
        return spark.createDataFrame(pairs, base.schema).select(F.col("a").alias(src), F.col("b").alias(dst))
    known = new = materialize(base, "closure")  # a union of what each round added; nothing is written twice
    first = True
    while not new.isEmpty():
        a, b = new.select("a", F.col("b").alias("m")), known.select(F.col("a").alias("m"), "b")
        step = a.join(b, "m").select("a", "b")
        if not first:
            step = step.union(known.select("a", F.col("b").alias("m")).join(new.select(F.col("a").alias("m"), "b"), "m").select("a", "b"))
        new = materialize(step.distinct().join(known, ["a", "b"], "left_anti"), "closure")
        known, first = known.union(new), False
    return known.select(F.col("a").alias(src), F.col("b").alias(dst))


def closure_of(edges: list[tuple]) -> list[tuple]:
    """The same for a short list."""
    nxt = defaultdict(set)
    for a, b in edges:
        nxt[a].add(b)
    out = []
    for a in list(nxt):
        seen, todo = set(), list(nxt[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += nxt.get(x, ())
        out += [(a, x) for x in seen]
    return sorted(out)

"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.plans.storage import discard, materialize


def components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """``(node, component)`` for every node that an edge with two different ends touches.

    ``component`` is one (arbitrary) node of the component. Each round draws a fresh hash order,
    points every node at the least node of its closed neighbourhood and contracts; the expected
    number of nodes falls by a constant factor whatever the graph's shape (long paths and hubs
    included), so the rounds grow with the logarithm of the nodes. The neighbourhood minimum is an
    aggregate with map-side combine, hence a hub is never gathered in one task. Null ends and loops
    are ignored; an empty edge table gives an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    e = materialize(e, "edges")
    labels = None
    r = 0
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(F.lit(r), c).alias("h"), c.alias("n"))  # noqa: B023, E731
        rep = both.groupBy("u").agg(F.min(order(F.col("v"))).alias("m"))
        rep = rep.select(F.col("u").alias("n"), F.least(F.col("m"), order(F.col("u")))["n"].alias("p"))
        rep = materialize(rep, "parents")
        a, b = rep.select(F.col("n").alias("u"), F.col("p").alias("pu")), rep.select(F.col("n").alias("v"), F.col("p").alias("pv"))
        step = e.join(a, "u").join(b, "v").where("pu <> pv")
        step = step.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        old_e, old_l = e, labels
        e = materialize(step, "edges")
        if labels is None:
            labels = rep.select(F.col("n").alias("node"), F.col("p").alias("component"))
            first = rep
        else:
            moved = rep.select(F.col("n").alias("component"), F.col("p").alias("to"))
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            labels = materialize(labels, "labels")
            discard(old_l if r > 1 else first)
            discard(rep)
        discard(old_e)
        r += 1
    return labels if labels is not None else e.select(F.col("u").alias("node"), F.col("v").alias("component"))

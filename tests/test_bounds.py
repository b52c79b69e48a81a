"""Lists of any length; circles are errors."""

import pytest
from pyspark.sql import functions as F

from ontoweave.functions import terms as T
from ontoweave.operators import collections as C


def cells(spark, n, last):
    """A list of ``n`` cells c1, c2 and so on, whose last cell's rest is ``last``."""
    i = spark.range(1, n + 1)
    node = F.concat(F.lit("c"), F.col("id"))
    rest = F.when(F.col("id") == n, F.lit(last)).otherwise(F.concat(F.lit("c"), F.col("id") + 1))
    out = i.select(node.alias("s"), F.lit(T.FIRST).alias("p"), F.col("id").cast("string").alias("o")).union(i.select(node, F.lit(T.REST), rest))
    return out.union(spark.createDataFrame([("x", "u:has", "c1")], "s string, p string, o string"))


def test_long_list_is_read_whole(spark):
    got = C.read_lists(cells(spark, 17_000, T.NIL), "u:has")
    assert got.count() == 17_000 and got.where("position = CAST(item AS LONG)").count() == 17_000


@pytest.mark.parametrize("n", [1, 5])
def test_circle_is_an_error(spark, n):
    with pytest.raises(ValueError, match="circle"):
        C.read_lists(cells(spark, n, "c1"), "u:has").collect()

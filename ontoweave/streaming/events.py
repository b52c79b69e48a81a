"""Events as a stream: triples with types inferred on the fly, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.functions import terms as T


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def typed_triples(events: DataFrame, closure: DataFrame, base: str, vocab: str) -> DataFrame:
    """Type triples of each event, with all superclasses: stateless, by a join with the small closed hierarchy."""
    me = F.concat(F.lit(base), F.col("event_id").cast("string"))
    cls = F.concat(F.lit(vocab), F.initcap("event_type"), F.lit("Event"))
    t = events.select(me.alias("s"), cls.alias("cls"))
    up = t.join(closure.select(F.col("sub").alias("cls"), "sup"), "cls").select("s", F.col("sup").alias("cls"))
    return t.union(up).select("s", F.lit(T.TYPE).alias("p"), F.col("cls").alias("o"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window; rows later than the watermark are dropped."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    return d.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")

"""Supply-chain events (EPCIS): XML and JSON, their graph, a generator, and event analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.functions import terms as T

#: The simple event of documents.
EVENT = "event_id string, event_type string, event_time string, epcs array<string>, biz_step string, disposition string, action string"
_LOCATION = (
    "struct<id:string,name:string,address:struct<street:string,city:string,state:string,postal_code:string,country:string>,"
    "coordinates:struct<lat:double,lon:double>,capabilities:array<string>>"
)
#: The full event.
FULL_EVENT = (
    "event_id string, event_type string, event_time timestamp, record_time timestamp, action string, biz_step string, disposition string, "
    f"read_point struct<id:string,name:string,location:{_LOCATION},reader_type:string>, business_location {_LOCATION}, "
    "epc_list array<string>, quantity_list map<string,int>, child_epcs array<string>, parent_id string, "
    "business_transaction_list array<struct<transaction_type:string,transaction_id:string>>, "
    "source_list array<struct<source_type:string,source_id:string,destination_type:string,destination_id:string>>, "
    "destination_list array<struct<source_type:string,source_id:string,destination_type:string,destination_id:string>>, extension map<string,string>"
)
E = "http://example.org/epcis/"
# The kinds of events.
EVENT_TYPES = ("ObjectEvent", "AggregationEvent", "TransactionEvent", "TransformationEvent", "AssociationEvent")
_XML_ROW = "eventID string, eventTime string, epcList struct<epc:array<string>>, action string, bizStep string, disposition string"


def read_xml(spark: SparkSession, path: str, event_types=EVENT_TYPES) -> DataFrame:
    """One row per event element of the documents under ``path``.

    An event without an id is named by a digest of its content, never at random.
    """
    out = None
    for kind in event_types:
        raw = spark.read.format("xml").option("rowTag", kind).option("recursiveFileLookup", "true").schema(_XML_ROW).load(path)
        one = _simple(raw, kind)
        out = one if out is None else out.unionByName(one)
    return out


def _simple(raw: DataFrame, kind: str) -> DataFrame:
    epcs = F.coalesce(F.col("epcList.epc"), F.array().cast("array<string>"))
    digest = F.concat(F.lit("urn:event:"), F.sha2(F.to_json(F.struct("eventTime", "epcList", "action", "bizStep", "disposition")), 256))
    return raw.select(F.coalesce("eventID", digest).alias("event_id"), F.lit(kind).alias("event_type"), F.col("eventTime").alias("event_time"), epcs.alias("epcs"), F.col("bizStep").alias("biz_step"), "disposition", "action")


def parse_xml(documents: DataFrame, column: str = "value", kind: str = "ObjectEvent") -> DataFrame:
    """Events of XML documents held in a string column, one document per row."""
    body = f"EventList struct<{kind}:array<struct<{', '.join(f.replace(' ', ':', 1) for f in _split(_XML_ROW))}>>>"
    parsed = documents.select(F.from_xml(F.col(column), f"EPCISBody struct<{body.replace(' ', ':', 1)}>").alias("d"))
    raw = parsed.select(F.explode(F.col(f"d.EPCISBody.EventList.{kind}")).alias("e")).select("e.*")
    return _simple(raw, kind)


def _split(ddl: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


def write_xml(events: DataFrame, path: str, event_types=EVENT_TYPES) -> None:
    """One folder per event type; readers with the event types as row tags give the events back."""
    body = F.struct(F.col("epcs").alias("epc"))
    rows = events.select("event_type", F.col("event_id").alias("eventID"), F.col("event_time").alias("eventTime"), body.alias("epcList"), "action", F.col("biz_step").alias("bizStep"), "disposition")
    for kind in event_types:
        one = rows.where(F.col("event_type") == kind).drop("event_type")
        one.write.format("xml").option("rootTag", "EPCISDocument").option("rowTag", kind).save(f"{path}/{kind}")


def write_json(events: DataFrame, path: str) -> None:
    events.write.json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def to_triples(events: DataFrame) -> DataFrame:
    """Types, EPCs, steps and dispositions of simple events as triples."""
    none = F.lit(None).cast("string")
    row = lambda s, p, o, kind="iri", dt=None: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"), none.alias("o_lang"))
    iri = lambda base, c: F.concat(F.lit(E + base), c)
    me = iri("event/", F.col("event_id"))
    fixed = F.array(
        row(me, T.TYPE, iri("", F.col("event_type"))),
        row(me, E + "eventTime", F.col("event_time"), "lit", T.DATETIME),
        row(me, E + "action", F.col("action"), "lit", T.STRING),
        row(me, E + "hasBizStep", iri("step/", F.col("biz_step"))),
        row(me, E + "hasDisposition", iri("disposition/", F.col("disposition"))),
    )
    of_epcs = F.flatten(F.transform("epcs", lambda x: F.array(row(me, E + "hasEPC", iri("epc/", x)), row(iri("epc/", x), T.TYPE, F.lit(E + "EPC")))))
    return events.select(F.explode(F.concat(fixed, of_epcs)).alias("t")).select("t.*").where("o IS NOT NULL").distinct()


def axioms() -> list[tuple]:
    """The event classes and what is above them."""
    return [("SubClassOf", E + k, E + "EPCISEvent") for k in EVENT_TYPES] + [("ObjectPropertyDomain", E + "hasEPC", E + "EPCISEvent"), ("ObjectPropertyRange", E + "hasEPC", E + "EPC")]


SCALES = {"small": (100, 500), "medium": (1_000, 5_000), "large": (10_000, 50_000)}


def generate(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``n`` simple events: 70 % observations, 20 % aggregations, 10 % transactions, a minute apart.

    Every value is a hash of the seed and the event's number, so any partitioning gives the same rows.
    """
    h = lambda salt, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(m))
    kind = F.when(F.col("id") % 10 < 7, "ObjectEvent").when(F.col("id") % 10 < 9, "AggregationEvent").otherwise("TransactionEvent")
    steps = F.array(*map(F.lit, ("commissioning", "packing", "shipping", "receiving", "storing")))
    states = F.array(*map(F.lit, ("active", "in_progress", "in_transit", "sellable")))
    epcs = F.transform(F.sequence(F.lit(0), (1 + h("k", 3)).cast("int") - 1), lambda i: F.concat(F.lit("urn:epc:id:sgtin:"), (h("e", 1000) + i).cast("string")))
    time = F.date_format(F.timestamp_seconds(1_700_000_000 + 60 * F.col("id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return spark.range(n).select(F.concat(F.lit("evt-"), F.col("id").cast("string")).alias("event_id"), kind.alias("event_type"), time.alias("event_time"), epcs.alias("epcs"), F.element_at(steps, (1 + h("s", 5)).cast("int")).alias("biz_step"), F.element_at(states, (1 + h("d", 4)).cast("int")).alias("disposition"), F.element_at(F.array(F.lit("ADD"), F.lit("OBSERVE"), F.lit("DELETE")), (1 + h("a", 3)).cast("int")).alias("action"))


# Analytics
def by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def all_epcs(events: DataFrame) -> DataFrame:
    return events.select(F.explode("epcs").alias("epc")).distinct().orderBy("epc")


def biz_steps(events: DataFrame) -> DataFrame:
    return events.where("biz_step IS NOT NULL").select("biz_step").distinct().orderBy("biz_step")


def trace(events: DataFrame, epc: str | None = None) -> DataFrame:
    """The events of one item, or of each, in order of time, each with the step before."""
    from pyspark.sql import Window

    w = Window.partitionBy("epc").orderBy("event_time", "event_id")
    own = events.select(F.explode("epcs").alias("epc"), "event_id", "event_time", "biz_step")
    own = own if epc is None else own.where(F.col("epc") == epc)
    return own.select("epc", F.row_number().over(w).alias("position"), "event_id", "event_time", "biz_step", F.lag("biz_step").over(w).alias("previous_step"))


def from_table(events: DataFrame) -> DataFrame:
    """The driver's event table as simple events: the type is the step, ``props.k`` the item."""
    k = F.get_json_object("props", "$.k")
    epcs = F.when(k.isNotNull(), F.array(F.concat(F.lit("urn:epc:"), k))).otherwise(F.array().cast("array<string>"))
    return events.select(F.col("event_id").cast("string").alias("event_id"), F.lit("ObjectEvent").alias("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("event_time"), epcs.alias("epcs"), F.col("event_type").alias("biz_step"), F.lit("active").alias("disposition"), F.lit("OBSERVE").alias("action"))

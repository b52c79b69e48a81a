"""Relational tables seen as a graph, without copying them.

Every predicate of every table is one branch of a union whose predicate (and, for types, whose class)
is a literal. A pattern with a constant predicate therefore folds all other branches away and reads
only the columns that its own branch needs.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.functions import terms as T
from ontoweave.model import KnowledgeGraph
from ontoweave.plans.algebra import classes_of, predicates_of

D, V = "http://example.org/d/", "http://example.org/v/"


@dataclass(frozen=True)
class Branch:
    """Triples ``(subject, predicate, object)`` from one table; ``datatype`` makes the object a literal."""

    table: str
    subject: Column
    predicate: str
    object: Column
    datatype: str | None = None
    repeats: bool = False  # several rows may give one triple
    classes: tuple[str, ...] = ()  # of a type: the only classes, or with a leading *, what they end in

    def may_type(self, classes: set[str]) -> bool:
        """Whether the branch can have one of the classes as its object."""
        return any(c.endswith(k[1:]) if k[0] == "*" else c == k for k in self.classes for c in classes)


def node(table: str, *keys: str) -> Column:
    return F.concat(F.lit(f"{D}{table}/"), F.concat_ws("-", *[F.col(k).cast("string") for k in keys]) if len(keys) > 1 else F.col(keys[0]).cast("string"))


def _kind(column: str, suffix: str) -> Column:
    return F.concat(F.lit(V), F.initcap(F.lower(column)), F.lit(suffix))


def branches() -> list[Branch]:
    """The mapping of the driver's tables."""
    cls = lambda name: F.lit(V + name)
    one = lambda t, k: node(t, k)
    line = node("lineitem", "l_orderkey", "l_linenumber")
    out = []
    for table, key, name in (("region", "r_regionkey", "Region"), ("nation", "n_nationkey", "Nation"), ("customer", "c_custkey", "Customer"), ("supplier", "s_suppkey", "Supplier"), ("part", "p_partkey", "Part"), ("orders", "o_orderkey", "Order"), ("events", "event_id", "Event"), ("documents", "doc_id", "Document")):
        out.append(Branch(table, one(_path(table), key), T.TYPE, cls(name), classes=(V + name,)))
    out += [
        Branch("lineitem", line, T.TYPE, cls("LineItem"), repeats=True, classes=(V + "LineItem",)),
        Branch("customer", one("customer", "c_custkey"), T.TYPE, _kind("c_mktsegment", "Customer"), classes=("*Customer",)),
        Branch("part", one("part", "p_partkey"), T.TYPE, _kind("p_type", "Part"), classes=("*Part",)),
        Branch("events", one("event", "event_id"), T.TYPE, _kind("event_type", "Event"), classes=("*Event",)),
        Branch("labels", one("document", "doc_id"), T.TYPE, F.when(F.col("quality") == 1, V + "HighQuality"), classes=(V + "HighQuality",)),
        Branch("labels", one("document", "doc_id"), T.TYPE, F.when(F.col("toxic") == 1, V + "Toxic"), classes=(V + "Toxic",)),
        Branch("nation", one("nation", "n_nationkey"), V + "inRegion", one("region", "n_regionkey")),
        Branch("customer", one("customer", "c_custkey"), V + "inNation", one("nation", "c_nationkey")),
        Branch("supplier", one("supplier", "s_suppkey"), V + "inNation", one("nation", "s_nationkey")),
        Branch("orders", one("order", "o_orderkey"), V + "placedBy", one("customer", "o_custkey")),
        Branch("lineitem", line, V + "ofOrder", one("order", "l_orderkey"), repeats=True),
        Branch("lineitem", line, V + "ofPart", one("part", "l_partkey"), repeats=True),
        Branch("lineitem", line, V + "suppliedBy", one("supplier", "l_suppkey"), repeats=True),
        Branch("events", one("event", "event_id"), V + "byUser", one("user", "user_id")),
    ]
    for table, subject, column, name, kind in (
        ("region", one("region", "r_regionkey"), "r_name", "name", T.STRING),
        ("nation", one("nation", "n_nationkey"), "n_name", "name", T.STRING),
        ("customer", one("customer", "c_custkey"), "c_name", "name", T.STRING),
        ("customer", one("customer", "c_custkey"), "c_acctbal", "acctbal", T.DOUBLE),
        ("supplier", one("supplier", "s_suppkey"), "s_name", "name", T.STRING),
        ("part", one("part", "p_partkey"), "p_name", "name", T.STRING),
        ("part", one("part", "p_partkey"), "p_size", "size", T.INTEGER),
        ("orders", one("order", "o_orderkey"), "o_totalprice", "totalPrice", T.DOUBLE),
        ("orders", one("order", "o_orderkey"), "o_orderstatus", "status", T.STRING),
        ("events", one("event", "event_id"), "value", "value", T.DOUBLE),
        ("documents", one("document", "doc_id"), "lang", "lang", T.STRING),
        ("labels", one("document", "doc_id"), "quality", "quality", T.INTEGER),
    ):
        out.append(Branch(table, subject, V + name, F.col(column).cast("string"), kind))
    date = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return [*out, Branch("orders", one("order", "o_orderkey"), V + "orderDate", date, T.DATETIME)]


def _path(table: str) -> str:
    return {"orders": "order", "events": "event", "documents": "document"}.get(table, table)


def triples(spark: SparkSession, sf_dir: str, predicates: Iterable[str] | None = None, classes: set[str] | None = None) -> DataFrame:
    """All branches as one lazy table of triples (a set, as in RDF).

    ``predicates`` keeps their branches only; ``classes`` those type branches that can have them.
    """
    tables: dict[str, DataFrame] = {}
    parts = []
    for b in branches():
        if predicates is not None and b.predicate not in predicates:
            continue
        if classes is not None and b.predicate == T.TYPE and not b.may_type(classes):
            continue
        if b.table not in tables:  # one look at the files per table
            tables[b.table] = spark.read.parquet(f"{sf_dir}/{b.table}.parquet")
        kind = F.lit("iri" if b.datatype is None else "lit")
        one = tables[b.table].select(b.subject.alias("s"), F.lit(b.predicate).alias("p"), b.object.alias("o"), kind.alias("o_kind"), F.lit(b.datatype).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
        one = one.where("s IS NOT NULL AND o IS NOT NULL")
        parts.append(one.distinct() if b.repeats else one)
    if not parts:
        return spark.createDataFrame([], T.TRIPLE)
    while len(parts) > 1:  # in pairs, since every union is analysed as it is made
        parts = [parts[i].unionAll(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


class MappedGraph(KnowledgeGraph):
    """The tables as a graph. A query makes only the branches of the predicates that it names."""

    def __init__(self, spark: SparkSession, sf_dir: str, predicates: Iterable[str] | None = None, axioms: list[tuple] = ()):
        self.sf_dir, self.predicates = sf_dir, None if predicates is None else set(predicates)
        self._triples: DataFrame | None = None
        super().__init__(spark, self, axioms)

    @property
    def triples(self) -> DataFrame:
        if self._triples is None:
            self._triples = triples(self.spark, self.sf_dir, self.predicates)
        return self._triples

    @triples.setter
    def triples(self, given) -> None:
        self._triples = None if given is self else given

    def source(self, algebra) -> DataFrame:
        named = predicates_of(algebra)
        if named is None or self._triples is not None:
            return self.triples
        return triples(self.spark, self.sf_dir, named if self.predicates is None else named & self.predicates, classes_of(algebra))

    def edges(self, prop: str | None = None) -> DataFrame:
        if prop is None or self._triples is not None:
            return super().edges(prop)
        return triples(self.spark, self.sf_dir, {prop}).where("o_kind <> 'lit'").select("s", "p", "o")

    def types(self) -> DataFrame:
        if self._triples is not None:
            return super().types()
        return triples(self.spark, self.sf_dir, {T.TYPE}).select(F.col("s").alias("x"), F.col("o").alias("cls"))

    def types_of(self, classes: list[str]) -> DataFrame:
        if self._triples is not None:
            return super().types_of(classes)
        t = triples(self.spark, self.sf_dir, {T.TYPE}, set(classes))
        return t.where(F.col("o").isin(classes)).select(F.col("s").alias("x"), F.col("o").alias("cls"))


SEGMENTS = ("Automobile", "Building", "Furniture", "Household", "Machinery")
EVENT_TYPES = ("Click", "Error", "Purchase", "Signup", "View")


def tbox(part_types: list[str] = ()) -> list[tuple]:
    """The axioms about the mapped graph, as ``(kind, argument...)``."""
    out = [("SubClassOf", V + f"{s}Customer", V + "Customer") for s in SEGMENTS]
    out += [("SubClassOf", V + "Customer", V + "Party"), ("SubClassOf", V + "Supplier", V + "Party")]
    out += [("SubClassOf", V + f"{e}Event", V + "Event") for e in EVENT_TYPES]
    out += [("SubClassOf", V + f"{t}Part", V + "Part") for t in part_types]
    out += [("SubObjectPropertyOf", V + p, V + "partOf") for p in ("inRegion", "inNation", "placedBy", "ofOrder")]
    out += [("TransitiveObjectProperty", V + "partOf"), ("InverseObjectProperties", V + "placedBy", V + "placed"), ("SymmetricObjectProperty", V + "sameNation")]
    out += [("ObjectPropertyDomain", V + "placedBy", V + "Order"), ("ObjectPropertyRange", V + "placedBy", V + "Customer"), ("ObjectPropertyDomain", V + "ofPart", V + "LineItem"), ("ObjectPropertyRange", V + "ofPart", V + "Part")]
    return [*out, ("DisjointClasses", V + "HighQuality", V + "Toxic"), ("FunctionalObjectProperty", V + "ofPart")]

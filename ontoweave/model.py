"""The knowledge graph: a table of triples and axioms about its vocabulary."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.functions import terms as T
from ontoweave.plans.closure import closure
from ontoweave.plans.compile import Compiler
from ontoweave.plans.sparql import parse

#: Axiom kinds with two named arguments, the predicate that says the same, and the table's columns.
PAIRS = {
    "SubClassOf": (T.SUBCLASS, ("sub", "sup")),
    "SubObjectPropertyOf": (T.SUBPROP, ("sub", "sup")),
    "SubDataPropertyOf": (None, ("sub", "sup")),
    "InverseObjectProperties": (T.OWL + "inverseOf", ("p", "q")),
    "ObjectPropertyDomain": (T.DOMAIN, ("prop", "cls")),
    "ObjectPropertyRange": (T.RANGE, ("prop", "cls")),
    "DataPropertyDomain": (None, ("prop", "cls")),
    "DataPropertyRange": (None, ("prop", "cls")),
}
#: Axiom kinds with any number of members, and the predicate that relates two of them.
SETS = {
    "EquivalentClasses": T.OWL + "equivalentClass",
    "DisjointClasses": T.OWL + "disjointWith",
    "EquivalentObjectProperties": T.OWL + "equivalentProperty",
    "DisjointObjectProperties": T.OWL + "propertyDisjointWith",
    "SameIndividual": T.SAME_AS,
    "DifferentIndividuals": T.OWL + "differentFrom",
}
CHARACTERISTICS = {
    "FunctionalObjectProperty": T.OWL + "FunctionalProperty",
    "InverseFunctionalObjectProperty": T.OWL + "InverseFunctionalProperty",
    "TransitiveObjectProperty": T.OWL + "TransitiveProperty",
    "SymmetricObjectProperty": T.OWL + "SymmetricProperty",
    "AsymmetricObjectProperty": T.OWL + "AsymmetricProperty",
    "ReflexiveObjectProperty": T.OWL + "ReflexiveProperty",
    "IrreflexiveObjectProperty": T.OWL + "IrreflexiveProperty",
}
ENTITY_KINDS = {
    T.OWL + "Class": "class", T.OWL + "ObjectProperty": "object_property", T.OWL + "DatatypeProperty": "data_property",
    T.OWL + "AnnotationProperty": "annotation_property", T.OWL + "NamedIndividual": "individual",
}


class KnowledgeGraph:
    """Triples as a DataFrame (``terms.TRIPLE``) and axioms as tuples ``(kind, argument...)``.

    The vocabulary is small next to the data, so given axioms are a list; axioms that are in the
    triples themselves are found there as well, and both sources are united.
    """

    def __init__(self, spark: SparkSession, triples: DataFrame | None = None, axioms: list[tuple] = (), axioms_in_triples: bool = False):
        self.spark = spark
        self.triples = triples if triples is not None else spark.createDataFrame([], T.TRIPLE)
        self.axioms = list(axioms)
        self.axioms_in_triples = axioms_in_triples
        self._kept: dict[tuple, tuple] = {}

    def _once(self, name: str, make) -> DataFrame:
        """``make()``, unless it was made before from the same axioms and triples."""
        key, triples = (name, tuple(self.axioms)), self.triples if self.axioms_in_triples else None
        if key not in self._kept or self._kept[key][0] is not triples:
            self._kept[key] = (triples, make())
        return self._kept[key][1]

    # Axiom tables
    def pairs(self, kind: str) -> DataFrame:
        """Named arguments of a two-place axiom kind."""
        return self._once(f"pairs {kind}", lambda: self._pairs(kind))

    def _pairs(self, kind: str) -> DataFrame:
        predicate, (a, b) = PAIRS[kind]
        rows = sorted({(x[1], x[2]) for x in self.axioms if x[0] == kind and isinstance(x[1], str) and isinstance(x[2], str)})
        out = self.spark.createDataFrame(rows, f"{a} string, {b} string")
        if self.axioms_in_triples and predicate:
            found = self.triples.where((F.col("p") == predicate) & (F.col("o_kind") == "iri") & ~F.col("s").startswith("_:")).select(F.col("s").alias(a), F.col("o").alias(b))
            out = out.union(found).distinct()
        return out

    def members(self, kind: str) -> DataFrame:
        """``(axiom_id, member)`` of the named members of n-ary axioms."""
        rows = [(i, m) for i, x in enumerate(self.axioms) if x[0] == kind for m in dict.fromkeys(x[1:]) if isinstance(m, str)]
        out = self.spark.createDataFrame(rows, "axiom_id long, member string")
        if self.axioms_in_triples:
            found = self.triples.where((F.col("p") == SETS[kind]) & (F.col("o_kind") != "lit")).select(F.xxhash64("s", "o").alias("axiom_id"), F.explode(F.array("s", "o")).alias("member"))
            out = out.union(found).distinct()
        return out

    def member_pairs(self, kind: str) -> DataFrame:
        """``(a, b)`` with a < b for every two members of one axiom."""
        return self._once(f"member pairs {kind}", lambda: self._member_pairs(kind))

    def _member_pairs(self, kind: str) -> DataFrame:
        if not self.axioms_in_triples:
            rows = sorted({(a, b) for x in self.axioms if x[0] == kind for a in x[1:] for b in x[1:] if isinstance(a, str) and isinstance(b, str) and a < b})
            return self.spark.createDataFrame(rows, "a string, b string")
        m = self.members(kind)
        x, y = m.select("axiom_id", F.col("member").alias("a")), m.select("axiom_id", F.col("member").alias("b"))
        return x.join(y, "axiom_id").where("a < b").select("a", "b").distinct()

    def with_characteristic(self, kind: str) -> list[str]:
        """Properties declared to have a characteristic, in both sources."""
        out = {x[1] for x in self.axioms if x[0] == kind}
        if self.axioms_in_triples:
            t = self.triples.where((F.col("p") == T.TYPE) & (F.col("o") == CHARACTERISTICS[kind]))
            out |= {r["s"] for r in t.select("s").distinct().collect()}
        return sorted(out)

    # Entities
    def entities(self) -> DataFrame:
        """``(iri, kind)`` of what is declared or used as a class, property or individual."""
        rows = set()
        for kind, *args in self.axioms:
            role = {"SubClassOf": "class", "EquivalentClasses": "class", "DisjointClasses": "class", "SubObjectPropertyOf": "object_property", "InverseObjectProperties": "object_property", "SameIndividual": "individual", "DifferentIndividuals": "individual"}.get(kind) or ("object_property" if kind in CHARACTERISTICS else None)
            if kind == "Declaration":
                rows.add((args[1], args[0]))
            elif role:
                rows |= {(a, role) for a in args if isinstance(a, str)}
            elif kind in ("ObjectPropertyDomain", "ObjectPropertyRange"):
                rows.add((args[0], "object_property"))
                rows.add((args[1], "class")) if isinstance(args[1], str) else None
        given = self.spark.createDataFrame(sorted(rows), "iri string, kind string")
        t = self.triples
        table = F.create_map(*[F.lit(x) for kv in ENTITY_KINDS.items() for x in kv])
        types = t.where((F.col("p") == T.TYPE) & (F.col("o_kind") == "iri"))
        declared = types.select(F.col("s").alias("iri"), F.try_element_at(table, F.col("o")).alias("kind")).where("kind IS NOT NULL")
        own = ~F.col("o").startswith(T.OWL) & ~F.col("o").startswith(T.RDFS)
        used = types.where(own).select(F.explode(F.array(F.struct(F.col("o").alias("iri"), F.lit("class").alias("kind")), F.struct(F.col("s").alias("iri"), F.when(F.col("s").startswith("_:"), "bnode").otherwise("individual").alias("kind")))).alias("e")).select("e.*")
        reserved = F.col("p").startswith(T.RDF) | F.col("p").startswith(T.RDFS) | F.col("p").startswith(T.OWL)
        props = t.where(~reserved).select(F.col("p").alias("iri"), F.when(F.col("o_kind") == "lit", "data_property").otherwise("object_property").alias("kind"))
        return given.union(declared).union(used).union(props).distinct()

    # Queries
    @cached_property
    def predicate_counts(self) -> dict[str, int]:
        """Triples per predicate (as many rows as the vocabulary has), for ordering patterns."""
        return {r["p"]: r["n"] for r in self.triples.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}

    def query(self, text: str, prefixes: dict[str, str] | None = None, inference: bool = False, use_counts: bool = False, keep_order: bool = False) -> DataFrame:
        """A SPARQL query's rows; with ``inference`` over the materialised graph.

        Patterns are joined connected ones first, then by constants and (``use_counts``) by how rare
        their predicates are, or with ``keep_order`` as they are written.
        """
        graph = self.materialized() if inference else self
        q = parse(text, prefixes)
        return Compiler(graph.source(q), graph.predicate_counts if use_counts else None, keep_order).run(q)

    def source(self, algebra) -> DataFrame:
        """The triples that a query needs; here all of them."""
        return self.triples

    def register(self, name: str = "kg") -> None:
        """Temporary views for SQL: ``<name>_triples``, ``_types``, ``_edges``, ``_class_closure``, ``_inherited_types``."""
        from ontoweave.plans.reason import inherited_types

        views = {"triples": self.triples, "types": self.types(), "edges": self.edges(), "class_closure": self.class_closure(), "inherited_types": inherited_types(self)}
        for view, df in views.items():
            df.createOrReplaceTempView(f"{name}_{view}")

    def run(self, algebra) -> DataFrame:
        return Compiler(self.source(algebra)).run(algebra)

    def explain(self, text: str, prefixes: dict[str, str] | None = None, mode: str = "formatted") -> str:
        """Spark's plan of a query, with cost estimates in mode ``cost``."""
        df = self.query(text, prefixes)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def batch(self, texts: dict[str, str], prefixes: dict[str, str] | None = None) -> dict[str, DataFrame]:
        """Several queries over one graph."""
        return {name: self.query(text, prefixes) for name, text in texts.items()}

    def materialized(self, rules: set[str] | None = None) -> "KnowledgeGraph":
        from ontoweave.plans.reason import materialize_graph

        return materialize_graph(self, rules)

    # Hierarchies
    def class_edges(self) -> DataFrame:
        """Asserted subsumptions between named classes, equivalences in both directions."""
        eq = self.member_pairs("EquivalentClasses")
        return self.pairs("SubClassOf").union(eq).union(eq.select("b", "a")).distinct()

    def class_closure(self) -> DataFrame:
        return self._once("class closure", lambda: closure(self.class_edges(), "sub", "sup"))

    def property_edges(self) -> DataFrame:
        eq = self.member_pairs("EquivalentObjectProperties")
        return self.pairs("SubObjectPropertyOf").union(eq).union(eq.select("b", "a")).distinct()

    def property_closure(self) -> DataFrame:
        return self._once("property closure", lambda: closure(self.property_edges(), "sub", "sup"))

    def types(self) -> DataFrame:
        """``(x, cls)`` as asserted."""
        return self.triples.where((F.col("p") == T.TYPE) & (F.col("o_kind") != "lit")).select(F.col("s").alias("x"), F.col("o").alias("cls"))

    def types_of(self, classes: list[str]) -> DataFrame:
        """``(x, cls)`` as asserted, of the given classes only."""
        return self.types().where(F.col("cls").isin(classes))

    def edges(self, prop: str | None = None) -> DataFrame:
        """``(s, p, o)`` between resources, without types."""
        t = self.triples.where((F.col("o_kind") != "lit") & (F.col("p") != T.TYPE))
        return (t.where(F.col("p") == prop) if prop else t).select("s", "p", "o")

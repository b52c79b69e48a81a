"""One query per operator, over the mapped tables or over small fixed documents, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.functions import terms as T
from ontoweave.model import KnowledgeGraph
from ontoweave.operators import collections as C
from ontoweave.plans import algebra as A
from ontoweave.plans import expressions as X
from ontoweave.plans import profiles as P
from ontoweave.plans import reason as R
from ontoweave.plans import rules as RU
from ontoweave.plans import sparql
from ontoweave.plans.closure import closure
from ontoweave.plans.abox import Told
from ontoweave.plans.storage import materialize, shared_dir
from ontoweave.plans.tableau import Tableau
from ontoweave.sources import epcis, formats, functional, imports, ntriples, owl_rdf, relational, turtle
from ontoweave.sources.relational import D, V
from ontoweave.streaming import events as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PREFIX = {"v": V, "d": D, "e": epcis.E}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle.replace("{D}", D).replace("{V}", V).replace("{E}", epcis.E).replace("{RDF}", T.RDF).replace("{RDFS}", T.RDFS).replace("{OWL}", T.OWL).replace("{XSD}", T.XSD)
        return f

    return keep


def graph(spark: SparkSession, sf_dir: str, *names: str) -> KnowledgeGraph:
    """The mapped graph; only the named predicates' branches, where given."""
    only = [T.TYPE if n == "a" else V + n for n in names] or None
    return relational.MappedGraph(spark, sf_dir, only, relational.tbox())


def typed_graph(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    """The mapped types, with the classes of parts that the data has."""
    types = sorted(r[0] for r in table(spark, sf_dir, "part").select(F.initcap(F.lower("p_type"))).distinct().collect())
    return relational.MappedGraph(spark, sf_dir, [T.TYPE], relational.tbox(types))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ask(name: str, text: str, oracle: str, *predicates: str):
    """A SPARQL query over the mapped graph."""

    @query(name, oracle)
    def run(spark, sf_dir):
        return graph(spark, sf_dir, *predicates).query(text, PREFIX)

    return run


def values(rows: list[tuple], names: str) -> str:
    """SQL for expected rows spelled out."""
    def show(x):
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"{x!r}::DOUBLE" if isinstance(x, float) else "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({names})"


def mini(spark, edges=(), types=(), literals=(), axioms=()) -> KnowledgeGraph:
    """A small graph over local names."""
    rows = [(s, T.TYPE, c, "iri", None, None) for s, c in types] + [(s, p, o, "iri", None, None) for s, p, o in edges] + [(s, p, o, "lit", dt, None) for s, p, o, dt in literals]
    return KnowledgeGraph(spark, spark.createDataFrame(rows, T.TRIPLE), list(axioms))


# ---------------------------------------------------------------- sources
_DOCS = {
    "turtle": "@prefix : <http://e/> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n:Student a owl:Class ; rdfs:subClassOf :Person .\n:PhD owl:equivalentClass :Student .\n:alice a :Student ; :age 23 ; :name \"Al#ice\"@en ; :likes ( :x :y ) .\n",
    "rdfxml": '<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:e="http://e/"><owl:Class rdf:about="http://e/Student"><rdfs:subClassOf rdf:resource="http://e/Person"/></owl:Class><owl:FunctionalProperty rdf:about="http://e/enrolledIn"/><e:Student rdf:about="http://e/john"><e:enrolledIn rdf:resource="http://e/course101"/><e:name xml:lang="en">John</e:name></e:Student></rdf:RDF>',
    "owlxml": '<Ontology xmlns="http://www.w3.org/2002/07/owl#" ontologyIRI="http://e/o"><Prefix name="" IRI="http://e/"/><Declaration><Class IRI="http://e/A"/></Declaration><SubClassOf><Class abbreviatedIRI=":A"/><ObjectSomeValuesFrom><ObjectProperty abbreviatedIRI=":p"/><Class abbreviatedIRI=":B"/></ObjectSomeValuesFrom></SubClassOf><DisjointClasses><Class abbreviatedIRI=":A"/><Class abbreviatedIRI=":C"/></DisjointClasses><ClassAssertion><Class abbreviatedIRI=":A"/><NamedIndividual abbreviatedIRI=":x"/></ClassAssertion></Ontology>',
    "functional": "Prefix(:=<http://e/>)\nPrefix(xsd:=<http://www.w3.org/2001/XMLSchema#>)\nOntology(<http://e/o>\nDeclaration(Class(:A))\nSubClassOf(:A ObjectIntersectionOf(:B ObjectComplementOf(:C)))\nSubObjectPropertyOf(ObjectPropertyChain(:p :q) :r)\nTransitiveObjectProperty(:p)\nObjectPropertyAssertion(:p :x :y)\nDataPropertyAssertion(:age :x \"3\"^^xsd:integer)\n)",
    "manchester": "Prefix: : <http://e/>\nOntology: <http://e/o>\nClass: A\n  SubClassOf: p some (B or C), (and B C)\nObjectProperty: p\n  Characteristics: Transitive\nIndividual: x\n  Types: A\n  Facts: p y\n",
    "jsonld": '{"@context": {"@vocab": "http://e/", "knows": {"@type": "@id"}, "name": {"@container": "@language"}, "kid": {"@reverse": "http://e/parent"}}, "@id": "http://e/a", "@type": "Person", "name": {"en": "Ann"}, "knows": "http://e/b", "age": 5, "kid": {"@id": "http://e/c"}}',
    "ntriples": "<http://e/a> <http://e/p> <http://e/b> .\n<http://e/a> <http://e/q> \"x\\ty\"@en .\n",
}


@query("S1_parsers", values([(f.name, f.kind) for f in formats.FORMATS.values()], "name, kind"))
def _(spark, sf_dir):
    return spark.createDataFrame([(f.name, f.kind) for f in formats.FORMATS.values()], "name string, kind string")


_EXT = [("ttl", "turtle"), ("turtle", "turtle"), ("rdf", "rdfxml"), ("owl", "functional"), ("ofn", "functional"), ("owx", "owlxml"), ("xml", "owlxml"), ("nt", "ntriples"), ("jsonld", "jsonld"), ("json-ld", "jsonld"), ("json", "jsonld"), ("man", "manchester"), ("mn", "manchester"), ("manchester", "manchester"), ("csv", None)]


@query("S2_extension", values(_EXT, "extension, format"))
def _(spark, sf_dir):
    return spark.createDataFrame([(e, (lambda f: f and f.name)(formats.by_extension(e))) for e, _ in _EXT], "extension string, format string")


_MIME = [("text/turtle", "turtle"), ("application/rdf+xml; charset=utf-8", "rdfxml"), ("application/ld+json", "jsonld"), ("application/n-triples", "ntriples"), ("text/owl-manchester", "manchester"), ("application/owl+xml", "owlxml"), ("image/png", None)]


@query("S3_content_type", values(_MIME, "content_type, format"))
def _(spark, sf_dir):
    return spark.createDataFrame([(c, (lambda f: f and f.name)(formats.by_content_type(c))) for c, _ in _MIME], "content_type string, format string")


@query("S4_sniff", values([(k, k) for k in _DOCS], "document, format"))
def _(spark, sf_dir):
    return spark.createDataFrame([(k, (lambda f: f and f.name)(formats.sniff(t))) for k, t in _DOCS.items()], "document string, format string")


@query(
    "S5_ntriples",
    """SELECT '{D}nation/'||n_nationkey AS s, '{V}name' AS p, n_name AS o, 'lit' AS o_kind, '{XSD}string' AS o_dt, NULL AS o_lang FROM nation
    UNION ALL SELECT '{D}nation/'||n_nationkey, '{V}inRegion', '{D}region/'||n_regionkey, 'iri', NULL, NULL FROM nation
    UNION ALL SELECT '_:b'||r_regionkey, '{V}label', 'a'||chr(9)||'"é'||r_name, 'lit', '{RDF}langString', 'en-us' FROM region
    UNION ALL SELECT '_:b'||r_regionkey, '{V}code', r_regionkey::VARCHAR, 'lit', '{XSD}integer', NULL FROM region""",
)
def _(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]).alias("value")
    n, r = F.col("n_nationkey").cast("string"), F.col("r_regionkey").cast("string")
    lines = nation.select(text(f"<{D}nation/", n, f"> <{V}name> \"", F.col("n_name"), '" .'))
    lines = lines.union(nation.select(text(f"<{D}nation/", n, f"> <{V}inRegion> <{D}region/", F.col("n_regionkey").cast("string"), "> . # comment")))
    lines = lines.union(region.select(text("_:b", r, f' <{V}label> "a\\t\\"\\u00e9', F.col("r_name"), '"@en-US .')))
    lines = lines.union(region.select(text("_:b", r, f' <{V}code> "', r, f'"^^<{T.INTEGER}> .'))).union(spark.createDataFrame([("# only a comment",), ("not a triple",), ("",)], "value string"))
    return ntriples.parse_lines(lines)


def _doc_query(name: str, doc: str, rows: list[tuple]):
    @query(name, values(rows, "kind, a, b, c"))
    def run(spark, sf_dir):
        return formats.axiom_rows(spark, formats.axioms_of(_DOCS[doc], doc))


_doc_query("S6_turtle", "turtle", [("Declaration", "class", "http://e/Student", None), ("SubClassOf", "http://e/Student", "http://e/Person", None), ("EquivalentClasses", "http://e/PhD", "http://e/Student", None), ("ClassAssertion", "http://e/Student", "http://e/alice", None), ("DataPropertyAssertion", "http://e/age", "http://e/alice", f"23|{T.INTEGER}|"), ("DataPropertyAssertion", "http://e/name", "http://e/alice", f"Al#ice|{T.LANG_STRING}|en"), ("ObjectPropertyAssertion", "http://e/likes", "http://e/alice", "_:doc2")])
_doc_query("S7_rdfxml", "rdfxml", [("Declaration", "class", "http://e/Student", None), ("SubClassOf", "http://e/Student", "http://e/Person", None), ("FunctionalObjectProperty", "http://e/enrolledIn", None, None), ("ClassAssertion", "http://e/Student", "http://e/john", None), ("ObjectPropertyAssertion", "http://e/enrolledIn", "http://e/john", "http://e/course101"), ("DataPropertyAssertion", "http://e/name", "http://e/john", f"John|{T.LANG_STRING}|en")])
_doc_query("S9_owlxml", "owlxml", [("Declaration", "class", "http://e/A", None), ("SubClassOf", "http://e/A", "some(http://e/p http://e/B)", None), ("DisjointClasses", "http://e/A", "http://e/C", None), ("ClassAssertion", "http://e/A", "http://e/x", None)])
_doc_query("S10_functional", "functional", [("Declaration", "class", "http://e/A", None), ("SubClassOf", "http://e/A", "and(http://e/B not(http://e/C))", None), ("SubPropertyChainOf", "http://e/p http://e/q", "http://e/r", None), ("TransitiveObjectProperty", "http://e/p", None, None), ("ObjectPropertyAssertion", "http://e/p", "http://e/x", "http://e/y"), ("DataPropertyAssertion", "http://e/age", "http://e/x", f"3|{T.INTEGER}|")])
_doc_query("S11_manchester", "manchester", [("Declaration", "class", "http://e/A", None), ("SubClassOf", "http://e/A", "some(http://e/p or(http://e/B http://e/C))", None), ("SubClassOf", "http://e/A", "and(http://e/B http://e/C)", None), ("Declaration", "object_property", "http://e/p", None), ("TransitiveObjectProperty", "http://e/p", None, None), ("Declaration", "individual", "http://e/x", None), ("ClassAssertion", "http://e/A", "http://e/x", None), ("ObjectPropertyAssertion", "http://e/p", "http://e/x", "http://e/y")])
_doc_query("S12_jsonld", "jsonld", [("ClassAssertion", "http://e/Person", "http://e/a", None), ("DataPropertyAssertion", "http://e/name", "http://e/a", f"Ann|{T.LANG_STRING}|en"), ("ObjectPropertyAssertion", "http://e/knows", "http://e/a", "http://e/b"), ("DataPropertyAssertion", "http://e/age", "http://e/a", f"5|{T.INTEGER}|"), ("ObjectPropertyAssertion", "http://e/parent", "http://e/c", "http://e/a")])


@query("S8_quoted_triples", "SELECT '{D}nation/'||n_nationkey AS s, CASE WHEN length('_:reified_'||'{D}nation/'||n_nationkey||'_'||'{V}inRegion'||'_'||'{D}region/'||n_regionkey) <= 200 THEN '_:reified_'||'{D}nation/'||n_nationkey||'_'||'{V}inRegion'||'_'||'{D}region/'||n_regionkey ELSE 'x' END AS quoted FROM nation")
def _(spark, sf_dir):
    t = graph(spark, sf_dir, "inRegion").triples
    return C.quoted_ids(t).select("s", "quoted")




@query("S13_restrictions", values([("c1", "some(http://e/p http://e/B)"), ("c2", "only(http://e/p http://e/B)"), ("c3", "exact(2 http://e/p)"), ("c4", f"dsome(http://e/age restriction({T.INTEGER} minInclusive(18) maxExclusive(65)))"), ("c5", "value(http://e/p http://e/x)")], "cls, expression"))
def _(spark, sf_dir):
    doc = "@prefix : <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . :c1 rdfs:subClassOf [ owl:onProperty :p ; owl:someValuesFrom :B ] . :c2 rdfs:subClassOf [ owl:onProperty :p ; owl:allValuesFrom :B ] . :c3 rdfs:subClassOf [ owl:onProperty :p ; owl:cardinality 2 ] . :c4 rdfs:subClassOf [ owl:onProperty :age ; owl:someValuesFrom [ owl:onDatatype xsd:integer ; owl:withRestrictions ( [ xsd:minInclusive 18 ] [ xsd:maxExclusive 65 ] ) ] ] . :c5 rdfs:subClassOf [ owl:onProperty :p ; owl:hasValue :x ] ."
    rows = [(a[1].rsplit("/", 1)[-1], X.render(a[2])) for a in owl_rdf.axioms(turtle.parse(doc)) if a[0] == "SubClassOf"]
    return spark.createDataFrame(rows, "cls string, expression string")


@query("S14_imports", values([("http://e/A", "http://e/B"), ("http://e/B", "http://e/C"), ("http://e/C", "http://e/D")], "sub, sup"))
def _(spark, sf_dir):
    head = "@prefix : <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . "
    docs = {"http://e/1": head + "<http://e/1> owl:imports <http://e/2> . :A rdfs:subClassOf :B .", "http://e/2": head + "<http://e/2> owl:imports <http://e/3> , <http://e/1> . :B rdfs:subClassOf :C .", "http://e/3": head + "<http://e/3> owl:imports <http://e/1> . :C rdfs:subClassOf :D . :A rdfs:subClassOf :B ."}
    root = formats.load(spark, docs["http://e/1"], "turtle")
    return imports.Resolver([imports.registry(docs)]).resolve(root).pairs("SubClassOf")


_EPCIS_SQL = "SELECT event_id::VARCHAR AS event_id, 'ObjectEvent' AS event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS event_time, coalesce('urn:epc:'||json_extract_string(props, '$.k'), '') AS epcs, event_type AS biz_step, 'active' AS disposition, 'OBSERVE' AS action FROM events"


@query("S15_epcis_xml", _EPCIS_SQL)
def _(spark, sf_dir):
    path = f"{shared_dir(spark)}/epcis-xml-{uuid.uuid4().hex}"
    epcis.write_xml(epcis.from_table(table(spark, sf_dir, "events")), path, ("ObjectEvent",))
    return epcis.read_xml(spark, path, ("ObjectEvent",)).withColumn("epcs", F.array_join("epcs", ","))


@query("K1_epcis_json", _EPCIS_SQL)
def _(spark, sf_dir):
    path = f"{shared_dir(spark)}/epcis-json-{uuid.uuid4().hex}"
    epcis.write_json(epcis.from_table(table(spark, sf_dir, "events")), path)
    return epcis.read_json(spark, path).withColumn("epcs", F.array_join("epcs", ","))


@query(
    "S16_epcis_triples",
    """WITH e AS (SELECT '{E}event/'||event_id AS s, *, json_extract_string(props, '$.k') AS k FROM events)
    SELECT s, '{RDF}type' AS p, '{E}ObjectEvent' AS o FROM e UNION ALL SELECT s, '{E}eventTime', strftime(ts, '%Y-%m-%dT%H:%M:%S') FROM e
    UNION ALL SELECT s, '{E}action', 'OBSERVE' FROM e UNION ALL SELECT s, '{E}hasBizStep', '{E}step/'||event_type FROM e
    UNION ALL SELECT s, '{E}hasDisposition', '{E}disposition/active' FROM e UNION ALL SELECT s, '{E}hasEPC', '{E}epc/urn:epc:'||k FROM e WHERE k IS NOT NULL
    UNION ALL SELECT DISTINCT '{E}epc/urn:epc:'||k, '{RDF}type', '{E}EPC' FROM e WHERE k IS NOT NULL""",
)
def _(spark, sf_dir):
    return epcis.to_triples(epcis.from_table(table(spark, sf_dir, "events"))).select("s", "p", "o")


@query("S17_synthetic_events", values([("ObjectEvent", 700, 1, 3), ("AggregationEvent", 200, 1, 3), ("TransactionEvent", 100, 1, 3)], "event_type, n, least, most"))
def _(spark, sf_dir):
    return epcis.generate(spark, 1000).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("epcs")).cast("int").alias("least"), F.max(F.size("epcs")).cast("int").alias("most"))


_UNIVERSITY = [("Declaration", "class", "Person"), ("SubClassOf", "Student", "Person"), ("SubClassOf", "Teacher", "Person"), ("Declaration", "class", "Course"), ("ObjectPropertyDomain", "teaches", "Teacher"), ("ObjectPropertyRange", "teaches", "Course"), ("EquivalentClasses", "Pupil", "Student"), ("DisjointClasses", "Student", "Teacher")]


def university(spark) -> KnowledgeGraph:
    return mini(spark, [("tom", "teaches", "maths"), ("ann", "attends", "maths")], [("tom", "Teacher"), ("ann", "Student"), ("maths", "Course"), ("bob", "Pupil")], [("ann", "age", "20", T.INTEGER)], _UNIVERSITY)


@query("S19_entities", values([("Person", "class"), ("Student", "class"), ("Teacher", "class"), ("Course", "class"), ("Pupil", "class"), ("teaches", "object_property"), ("attends", "object_property"), ("age", "data_property"), ("tom", "individual"), ("ann", "individual"), ("maths", "individual"), ("bob", "individual")], "iri, kind"))
def _(spark, sf_dir):
    return university(spark).entities()


@query("S19_axioms_by_type", values([("SubClassOf", 2), ("Declaration", 2), ("EquivalentClasses", 1), ("DisjointClasses", 1), ("ObjectPropertyDomain", 1), ("ObjectPropertyRange", 1)], "kind, n"))
def _(spark, sf_dir):
    return formats.axiom_rows(spark, university(spark).axioms).groupBy("kind").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("S20_instances_of_class", "SELECT '{D}supplier/'||s_suppkey AS x FROM supplier")
def _(spark, sf_dir):
    return R.instances(graph(spark, sf_dir, "a"), V + "Supplier", inherited=False)


@query("S20_properties_for_domain", values([(V + "ofPart", V + "LineItem", "domain"), (V + "ofPart", V + "Part", "range"), (V + "placedBy", V + "Order", "domain"), (V + "placedBy", V + "Customer", "range")], "prop, cls, side"))
def _(spark, sf_dir):
    g = KnowledgeGraph(spark, axioms=relational.tbox())
    return g.pairs("ObjectPropertyDomain").withColumn("side", F.lit("domain")).union(g.pairs("ObjectPropertyRange").withColumn("side", F.lit("range")))


@query("S21_axioms_of_entity", values([("SubClassOf", "Student", "Person"), ("EquivalentClasses", "Pupil", "Student"), ("DisjointClasses", "Student", "Teacher")], "kind, a, b"))
def _(spark, sf_dir):
    rows = formats.axiom_rows(spark, university(spark).axioms)
    return rows.where("a = 'Student' OR b = 'Student' OR c = 'Student'").select("kind", "a", "b")


@query("S22_storage", "SELECT '{V}inRegion' AS p, count(*) AS n FROM nation UNION ALL SELECT '{V}placedBy', count(*) FROM orders")
def _(spark, sf_dir):
    return materialize(graph(spark, sf_dir, "inRegion", "placedBy").triples, "store").groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("S23_bulk_axioms", "SELECT 'Class'||i AS sub, 'Class'||(i // 2) AS sup FROM range(1, 50) t(i)")
def _(spark, sf_dir):
    return KnowledgeGraph(spark, axioms=[("SubClassOf", f"Class{i}", f"Class{i // 2}") for i in range(1, 50)]).pairs("SubClassOf")


# ---------------------------------------------------------------- sinks
@query("K2_ntriples_sink", "SELECT '<{D}nation/'||n_nationkey||'> <{V}name> \"'||n_name||'\" .' AS value FROM nation UNION ALL SELECT '<{D}region/'||r_regionkey||'> <{V}name> \"'||r_name||'\" .' FROM region UNION ALL SELECT '<{D}nation/'||n_nationkey||'> <{V}inRegion> <{D}region/'||n_regionkey||'> .' FROM nation")
def _(spark, sf_dir):
    t = graph(spark, sf_dir, "name", "inRegion").triples.where(F.col("s").startswith(D + "nation/") | F.col("s").startswith(D + "region/"))
    path = f"{shared_dir(spark)}/nt-{uuid.uuid4().hex}"
    ntriples.write(t, path)
    return spark.read.text(path)


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit(D + "conversation/"), F.col("conv_id").cast("string")).alias("subject"), F.col("turn").alias("position"), F.col("role").alias("item"), F.lit("lit").alias("item_kind"))


_TURNS = "WITH t AS (SELECT '{D}conversation/'||conv_id AS s, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) "


@query("K3_list_triples", _TURNS + "SELECT s||'_'||i AS s, '{RDF}first' AS p, role AS o, 'lit' AS o_kind FROM t UNION ALL SELECT s||'_'||i, '{RDF}rest', CASE WHEN i < n THEN s||'_'||(i+1) ELSE '{RDF}nil' END, 'iri' FROM t UNION ALL SELECT s, '{V}turns', s||'_1', 'iri' FROM t WHERE i = 1")
def _(spark, sf_dir):
    return C.list_triples(_turns(spark, sf_dir), V + "turns").select("s", "p", "o", "o_kind")


@query("K3_list_read", _TURNS + "SELECT s AS subject, i::BIGINT AS position, role AS item FROM t")
def _(spark, sf_dir):
    return C.read_lists(C.list_triples(_turns(spark, sf_dir), V + "turns"), V + "turns")


@query("K4_container_triples", _TURNS + "SELECT s, '{RDF}_'||i AS p, role AS o FROM t UNION ALL SELECT s, '{RDF}type', '{RDF}Seq' FROM t WHERE i = 1")
def _(spark, sf_dir):
    return C.container_triples(_turns(spark, sf_dir)).select("s", "p", "o")


@query("K5_statement_triples", "WITH t AS (SELECT '{D}nation/'||n_nationkey AS s, '{D}region/'||n_regionkey AS o FROM nation) SELECT '{RDF}type' AS p, '{RDF}Statement' AS o FROM t UNION ALL SELECT '{RDF}subject', s FROM t UNION ALL SELECT '{RDF}predicate', '{V}inRegion' FROM t UNION ALL SELECT '{RDF}object', o FROM t")
def _(spark, sf_dir):
    return C.statement_triples(graph(spark, sf_dir, "inRegion").triples).select("p", "o")


# ---------------------------------------------------------------- patterns, filters
ask("F1_type_scan", "SELECT ?x WHERE { ?x a v:Customer }", "SELECT '{D}customer/'||c_custkey AS x FROM customer")
ask("F2_property_values", "SELECT ?c WHERE { <http://example.org/d/order/1> v:placedBy ?c }", "SELECT '{D}customer/'||o_custkey AS c FROM orders WHERE o_orderkey = 1")
ask("F2_subject_of_value", "SELECT ?o WHERE { ?o v:placedBy <http://example.org/d/customer/1> }", "SELECT '{D}order/'||o_orderkey AS o FROM orders WHERE o_custkey = 1")
ask("F2_edge_exists", "SELECT ?n WHERE { <http://example.org/d/nation/1> v:inRegion <http://example.org/d/region/1> . <http://example.org/d/nation/1> v:name ?n }", "SELECT n_name AS n FROM nation WHERE n_nationkey = 1 AND n_regionkey = 1")
ask("F3_variable_predicate", "SELECT ?x ?p ?o WHERE { ?x a v:Customer ; ?p ?o }", "SELECT '{D}customer/'||c_custkey AS x, '{RDF}type' AS p, '{V}Customer' AS o FROM customer UNION ALL SELECT '{D}customer/'||c_custkey, '{RDF}type', '{V}'||upper(c_mktsegment[1])||lower(c_mktsegment[2:])||'Customer' FROM customer UNION ALL SELECT '{D}customer/'||c_custkey, '{V}inNation', '{D}nation/'||c_nationkey FROM customer UNION ALL SELECT '{D}customer/'||c_custkey, '{V}name', c_name FROM customer UNION ALL SELECT '{D}customer/'||c_custkey, '{V}acctbal', c_acctbal::VARCHAR FROM customer")


@query("F4_query_kinds", values([("?x a v:C", "type"), ("?x v:p ?y", "property"), ("?x ?p ?y", "variable_predicate"), ("?x v:p+ ?y", "path")], "pattern, kind"))
def _(spark, sf_dir):
    rows = []
    for text in ("?x a v:C", "?x v:p ?y", "?x ?p ?y", "?x v:p+ ?y"):
        p = sparql.parse(f"SELECT ?x WHERE {{ {text} }}", PREFIX).child.patterns[0].p
        rows.append((text, "variable_predicate" if isinstance(p, A.Var) else "path" if not isinstance(p, A.Iri) else "type" if p.value == T.TYPE else "property"))
    return spark.createDataFrame(rows, "pattern string, kind string")


ask("F5_indexed_type_scan", "SELECT ?x WHERE { ?x a v:BuildingCustomer }", "SELECT '{D}customer/'||c_custkey AS x FROM customer WHERE c_mktsegment = 'BUILDING'")
ask("F6_value_scan", "SELECT ?s ?v WHERE { ?s v:acctbal ?v FILTER(?v < 0) }", "SELECT '{D}customer/'||c_custkey AS s, c_acctbal::VARCHAR AS v FROM customer WHERE c_acctbal < 0")


@query("F7_repeated_variable", values([("a",), ("c",)], "x"))
def _(spark, sf_dir):
    return mini(spark, [("a", V + "p", "a"), ("a", V + "p", "b"), ("c", V + "p", "c")]).query("SELECT ?x WHERE { ?x v:p ?x }", PREFIX)


@query("F8_named_class_only", values([("a",)], "x"))
def _(spark, sf_dir):
    return mini(spark, types=[("a", V + "C")], axioms=[("ClassAssertion", ("not", V + "C"), "b")]).query("SELECT ?x WHERE { ?x a v:C }", PREFIX)


ask("F9_projection", "SELECT ?n WHERE { ?x v:inRegion ?r ; v:name ?n }", "SELECT n_name AS n FROM nation", "inRegion", "name")
ask("F10_filter", "SELECT ?o ?v WHERE { ?o v:totalPrice ?v FILTER(?v > 300000) }", "SELECT '{D}order/'||o_orderkey AS o, o_totalprice::VARCHAR AS v FROM orders WHERE o_totalprice > 300000")
for _op, _sql in (("=", "="), ("!=", "<>"), ("<", "<"), (">", ">"), ("<=", "<="), (">=", ">=")):
    _key = {"=": "eq", "!=": "ne", "<": "lt", ">": "gt", "<=": "le", ">=": "ge"}[_op]
    ask(f"F11_compare_{_key}", f"SELECT ?p WHERE {{ ?p v:size ?n FILTER(?n {_op} 25) }}", f"SELECT '{{D}}part/'||p_partkey AS p FROM part WHERE p_size {_sql} 25")
ask("F11_compare_dates", 'SELECT ?o WHERE { ?o v:orderDate ?d FILTER(?d < "1993-01-01T00:00:00"^^xsd:dateTime) }', "SELECT '{D}order/'||o_orderkey AS o FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01'")
ask("F12_and_or_not", "SELECT ?p WHERE { ?p v:size ?n FILTER((?n < 5 || ?n > 45) && !(?n = 1)) }", "SELECT '{D}part/'||p_partkey AS p FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT p_size = 1")
ask("F13_term_equality", 'SELECT ?n WHERE { ?n v:name ?x FILTER(?x = "FRANCE" || ?x = "Nation_3" || ?x = "NATION_3") }', "SELECT '{D}nation/'||n_nationkey AS n FROM nation WHERE n_name IN ('FRANCE', 'Nation_3', 'NATION_3') UNION ALL SELECT '{D}region/'||r_regionkey FROM region WHERE r_name IN ('FRANCE', 'Nation_3', 'NATION_3') UNION ALL SELECT '{D}customer/'||c_custkey FROM customer WHERE c_name IN ('FRANCE', 'Nation_3', 'NATION_3') UNION ALL SELECT '{D}supplier/'||s_suppkey FROM supplier WHERE s_name IN ('FRANCE', 'Nation_3', 'NATION_3') UNION ALL SELECT '{D}part/'||p_partkey FROM part WHERE p_name IN ('FRANCE', 'Nation_3', 'NATION_3')")
ask("F14_type_test", "SELECT ?o WHERE { ?o v:placedBy ?c FILTER EXISTS { ?c a v:MachineryCustomer } }", "SELECT '{D}order/'||o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
ask("F15_is_literal", "SELECT ?x ?p ?o WHERE { ?x a v:Supplier ; ?p ?o FILTER isLiteral(?o) }", "SELECT '{D}supplier/'||s_suppkey AS x, '{V}name' AS p, s_name AS o FROM supplier")
ask("F15_is_iri", "SELECT ?x ?p ?o WHERE { ?x a v:Supplier ; ?p ?o FILTER(isIRI(?o) && !isBlank(?o)) }", "SELECT '{D}supplier/'||s_suppkey AS x, '{RDF}type' AS p, '{V}Supplier' AS o FROM supplier UNION ALL SELECT '{D}supplier/'||s_suppkey, '{V}inNation', '{D}nation/'||s_nationkey FROM supplier")
ask("F15_not_bound", "SELECT ?x WHERE { ?x a v:Document OPTIONAL { ?x v:quality ?q } FILTER(!bound(?q)) }", "SELECT '{D}document/'||doc_id AS x FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
ask("F16_string_tests", 'SELECT ?x WHERE { ?x v:name ?n ; a v:Customer FILTER(STRSTARTS(?n, "Customer") && CONTAINS(?n, "99")) }', "SELECT '{D}customer/'||c_custkey AS x FROM customer WHERE starts_with(c_name, 'Customer') AND contains(c_name, '99')")
ask("F16_in_list", "SELECT ?p WHERE { ?p v:size ?n FILTER(?n IN (1, 7, 49)) }", "SELECT '{D}part/'||p_partkey AS p FROM part WHERE p_size IN (1, 7, 49)")
ask("F16_in_subquery", "SELECT ?o WHERE { ?o v:placedBy ?c { SELECT ?c WHERE { ?c v:acctbal ?b FILTER(?b > 9000) } } }", "SELECT '{D}order/'||o_orderkey AS o FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
ask("F17_class_instances", "SELECT (?x AS ?instance) WHERE { ?x a v:Region }", "SELECT '{D}region/'||r_regionkey AS instance FROM region")
ask("F17_all_classes", "SELECT DISTINCT ?c WHERE { ?x a ?c }", "SELECT '{V}'||c AS c FROM (VALUES ('Region'),('Nation'),('Customer'),('Supplier'),('Part'),('Order'),('Event'),('Document'),('LineItem'),('HighQuality'),('Toxic')) t(c) UNION SELECT '{V}'||upper(c_mktsegment[1])||lower(c_mktsegment[2:])||'Customer' FROM customer UNION SELECT '{V}'||upper(p_type[1])||lower(p_type[2:])||'Part' FROM part UNION SELECT '{V}'||upper(event_type[1])||lower(event_type[2:])||'Event' FROM events")
ask("F17_all_individuals", "SELECT DISTINCT ?x WHERE { ?x a ?c FILTER(?c IN (v:Region, v:Nation, v:Supplier)) }", "SELECT '{D}region/'||r_regionkey AS x FROM region UNION ALL SELECT '{D}nation/'||n_nationkey FROM nation UNION ALL SELECT '{D}supplier/'||s_suppkey FROM supplier", "a")
ask("F17_all_properties", "SELECT DISTINCT ?p WHERE { ?x ?p ?o }", "SELECT p FROM (VALUES ('{RDF}type'), ('{V}inRegion'), ('{V}inNation'), ('{V}placedBy'), ('{V}ofOrder'), ('{V}ofPart'), ('{V}suppliedBy'), ('{V}byUser'), ('{V}name'), ('{V}acctbal'), ('{V}size'), ('{V}totalPrice'), ('{V}status'), ('{V}value'), ('{V}lang'), ('{V}quality'), ('{V}orderDate')) t(p)")

# ---------------------------------------------------------------- joins
_CHAIN = "SELECT DISTINCT '{D}lineitem/'||l_orderkey||'-'||l_linenumber AS l, '{D}order/'||o_orderkey AS o, '{D}customer/'||c_custkey AS c, '{D}nation/'||n_nationkey AS n, '{D}region/'||n_regionkey AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
ask("J1_bgp_chain", "SELECT ?l ?o ?c ?n ?r WHERE { ?l v:ofOrder ?o . ?o v:placedBy ?c . ?c v:inNation ?n . ?n v:inRegion ?r }", _CHAIN)
FLAGSHIP = "SELECT ?o ?c ?n ?r WHERE { ?o a v:Order . ?o v:placedBy ?c . ?c a v:BuildingCustomer . ?c v:inNation ?n . ?n v:inRegion ?r }"
ask("J1_flagship", FLAGSHIP, "SELECT '{D}order/'||o_orderkey AS o, '{D}customer/'||o_custkey AS c, '{D}nation/'||c_nationkey AS n, '{D}region/'||n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")


@query("J2_compatible_merge", values([("1", "p", "m"), ("1", "q", "m"), ("2", "p", "n"), ("2", "q", "n")], "x, y, z"))
def _(spark, sf_dir):
    return mini(spark, [("1", V + "r", "p"), ("1", V + "r", "q"), ("1", V + "s", "m"), ("2", V + "s", "n"), ("p", V + "t", "p"), ("q", V + "t", "q")]).query("SELECT ?x ?y ?z WHERE { { ?x v:s ?z OPTIONAL { ?x v:r ?y } } { ?y v:t ?y } }", PREFIX)


ask("J3_hash_join", "SELECT ?c ?s WHERE { ?c a v:BuildingCustomer . ?c v:inNation ?n . ?s a v:Supplier . ?s v:inNation ?n }", "SELECT '{D}customer/'||c_custkey AS c, '{D}supplier/'||s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_mktsegment = 'BUILDING'", "a", "inNation")
ask("J4_star_join", "SELECT ?o ?s ?v ?c WHERE { ?o v:status ?s ; v:totalPrice ?v ; v:placedBy ?c }", "SELECT '{D}order/'||o_orderkey AS o, o_orderstatus AS s, o_totalprice::VARCHAR AS v, '{D}customer/'||o_custkey AS c FROM orders")


@query("J5_join_of_patterns", "SELECT '{D}nation/'||n_nationkey AS n, '{D}region/'||n_regionkey AS r, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    p = lambda s, q, o: A.Bgp((A.Pattern(A.Var(s), A.Iri(V + q), A.Var(o)),))
    return graph(spark, sf_dir).run(A.Project(A.Join(p("n", "inRegion", "r"), p("r", "name", "name")), ("n", "r", "name")))


@query("J6_maybe_bound_join", values([("2", "p"), ("2", "q"), ("1", "p"), ("1", "q")], "x, y"))
def _(spark, sf_dir):
    return mini(spark, [("1", V + "a", "k"), ("2", V + "a", "k"), ("1", V + "r", "p"), ("1", V + "r", "q"), ("p", V + "t", "p"), ("q", V + "t", "q")]).query("SELECT ?x ?y WHERE { { ?x v:a ?k OPTIONAL { ?x v:r ?y } } { ?y v:t ?y } }", PREFIX)


ask("J7_product", "SELECT ?r ?n WHERE { ?r a v:Region . ?n a v:Nation }", "SELECT '{D}region/'||r_regionkey AS r, '{D}nation/'||n_nationkey AS n FROM region, nation", "a")
ask("J8_optional", "SELECT ?x ?q WHERE { ?x a v:Document OPTIONAL { ?x v:quality ?q } }", "SELECT '{D}document/'||d.doc_id AS x, quality::VARCHAR AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
ask("J8_optional_filter", "SELECT ?c ?o WHERE { ?c a v:FurnitureCustomer OPTIONAL { ?o v:placedBy ?c . ?o v:totalPrice ?v FILTER(?v > 200000) } }", "SELECT '{D}customer/'||c_custkey AS c, '{D}order/'||o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 WHERE c_mktsegment = 'FURNITURE'")


@query("J9_rule_body", values([("ann", "Person")], "x, cls"))
def _(spark, sf_dir):
    g = KnowledgeGraph(spark, spark.createDataFrame([("ann", T.TYPE, "Student", "iri", None, None), ("Student", T.SUBCLASS, "Person", "iri", None, None)], T.TRIPLE))
    return g.query("SELECT ?x (?d AS ?cls) WHERE { ?c rdfs:subClassOf ?d . ?x a ?c }")


ask("J10_edge_self_join", "SELECT ?c ?r WHERE { ?c v:inNation ?n . ?n v:inRegion ?r }", "SELECT '{D}customer/'||c_custkey AS c, '{D}region/'||n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT '{D}supplier/'||s_suppkey, '{D}region/'||n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")


@query("J11_shared_variables", values([("x y", "y z", "y"), ("x y", "u v", "")], "left_vars, right_vars, shared"))
def _(spark, sf_dir):
    rows = []
    for a, b in (("?x v:p ?y", "?y v:q ?z"), ("?x v:p ?y", "?u v:q ?v")):
        l, r = (A.variables(sparql.parse(f"SELECT * WHERE {{ {t} }}", PREFIX)) for t in (a, b))
        rows.append((" ".join(l), " ".join(r), " ".join(v for v in l if v in r)))
    return spark.createDataFrame(rows, "left_vars string, right_vars string, shared string")


ask("J12_semi_join", "SELECT ?x WHERE { ?x a v:Document FILTER EXISTS { ?x a v:Toxic } }", "SELECT '{D}document/'||doc_id AS x FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)", "a")
ask("J12_anti_join", "SELECT ?x WHERE { ?x a v:Document FILTER NOT EXISTS { ?x a v:HighQuality } }", "SELECT '{D}document/'||doc_id AS x FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)", "a")
ask("J12_correlated_exists", "SELECT ?o WHERE { ?o v:placedBy ?c ; v:totalPrice ?v FILTER EXISTS { ?other v:placedBy ?c ; v:totalPrice ?w FILTER(?w > ?v) } }", "SELECT '{D}order/'||o_orderkey AS o FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_totalprice > a.o_totalprice)", "placedBy", "totalPrice")
ask("J12_minus", "SELECT ?x WHERE { ?x a v:HighQuality MINUS { ?x a v:Toxic } }", "SELECT '{D}document/'||doc_id AS x FROM labels WHERE quality = 1 AND toxic = 0", "a")

# ---------------------------------------------------------------- aggregation, order, sets
ask("A1_distinct", "SELECT DISTINCT ?u ?c WHERE { ?e v:byUser ?u ; a ?c FILTER(?c != v:Event) }", "SELECT DISTINCT '{D}user/'||user_id AS u, '{V}'||upper(event_type[1])||lower(event_type[2:])||'Event' AS c FROM events")
ask("A2_reduced", "SELECT REDUCED ?s WHERE { ?o v:status ?s }", "SELECT DISTINCT o_orderstatus AS s FROM orders")
@query("A3_group_by", "SELECT '{D}customer/'||o_custkey AS c, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_custkey")
def _(spark, sf_dir):
    out = graph(spark, sf_dir, "placedBy", "totalPrice").query("SELECT ?c (COUNT(?o) AS ?n) (SUM(?v) AS ?total) (MIN(?v) AS ?least) (MAX(?v) AS ?most) (AVG(?v) AS ?mean) WHERE { ?o v:placedBy ?c ; v:totalPrice ?v } GROUP BY ?c", PREFIX)
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4), "least": F.col("least").cast("double"), "most": F.col("most").cast("double")})


ask("A3_having", "SELECT ?c (COUNT(DISTINCT ?s) AS ?n) WHERE { ?o v:placedBy ?c ; v:status ?s } GROUP BY ?c HAVING(COUNT(DISTINCT ?s) > 2)", "SELECT '{D}customer/'||o_custkey AS c, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 2")


@query("A3_terms", "SELECT '{D}customer/'||o_custkey AS c, min(o_orderstatus) AS first, max(o_orderstatus) AS last, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS every FROM orders GROUP BY o_custkey")
def _(spark, sf_dir):
    return graph(spark, sf_dir, "placedBy", "status").query('SELECT ?c (MIN(?s) AS ?first) (MAX(?s) AS ?last) (GROUP_CONCAT(DISTINCT ?s; SEPARATOR="|") AS ?every) WHERE { ?o v:placedBy ?c ; v:status ?s } GROUP BY ?c', PREFIX)


@query("A4_event_counts", "SELECT event_type AS biz_step, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    e = epcis.from_table(table(spark, sf_dir, "events"))
    return epcis.by_type(e.withColumn("event_type", F.col("biz_step"))).withColumnRenamed("event_type", "biz_step")


@query("A5_distinct_epcs", "SELECT DISTINCT 'urn:epc:'||json_extract_string(props, '$.k') AS epc FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(spark, sf_dir):
    return epcis.all_epcs(epcis.from_table(table(spark, sf_dir, "events")))


@query("A5_biz_steps", "SELECT DISTINCT event_type AS biz_step FROM events")
def _(spark, sf_dir):
    return epcis.biz_steps(epcis.from_table(table(spark, sf_dir, "events")))


@query("A6_hierarchy_counts", values([("subsumptions", 5), ("equivalences", 1), ("disjointnesses", 2)], "what, n"))
def _(spark, sf_dir):
    return R.hierarchy_counts(university(spark)).withColumn("n", F.col("n").cast("int"))


@query("A7_statistics", values([("class", 5), ("object_property", 2), ("data_property", 1), ("individual", 4)], "kind, n"))
def _(spark, sf_dir):
    return university(spark).entities().groupBy("kind").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("A8_role_counts", "SELECT '{D}customer/'||o_custkey AS o, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return R.role_counts(graph(spark, sf_dir, "placedBy").edges().select(F.col("o").alias("s"), "p", F.col("s").alias("o"))).select(F.col("s").alias("o"), "n")


@query("A9_functional_groups", "SELECT '{D}lineitem/'||l_orderkey||'-'||l_linenumber AS x, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_partkey) > 1")
def _(spark, sf_dir):
    return R.functional_groups(graph(spark, sf_dir, "ofPart").edges(), V + "ofPart")


@query("A9_inverse_functional_groups", "SELECT '{D}region/'||n_regionkey AS x, count(DISTINCT n_nationkey) AS n FROM nation GROUP BY 1 HAVING count(DISTINCT n_nationkey) > 1")
def _(spark, sf_dir):
    return R.functional_groups(graph(spark, sf_dir, "inRegion").edges(), V + "inRegion", inverse=True)


ask("A10_tiers", "SELECT ?tier (COUNT(?c) AS ?n) WHERE { ?c v:acctbal ?b BIND(IF(?b < 0, \"debt\", IF(?b < 5000, \"low\", \"high\")) AS ?tier) } GROUP BY ?tier", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS tier, count(*) AS n FROM customer GROUP BY 1")


@query("A10_trace", "WITH e AS (SELECT 'urn:epc:'||json_extract_string(props, '$.k') AS epc, event_id::VARCHAR AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS event_time, event_type AS biz_step FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL) SELECT epc, row_number() OVER w::INT AS position, event_id, event_time, biz_step, lag(biz_step) OVER w AS previous_step FROM e WINDOW w AS (PARTITION BY epc ORDER BY event_time, event_id)")
def _(spark, sf_dir):
    return epcis.trace(epcis.from_table(table(spark, sf_dir, "events")))


ask("L1_limit", "SELECT ?o ?v WHERE { ?o v:totalPrice ?v } ORDER BY DESC(?v) ?o LIMIT 10", "SELECT '{D}order/'||o_orderkey AS o, o_totalprice::VARCHAR AS v FROM orders ORDER BY o_totalprice DESC, o LIMIT 10")
ask("L2_sorted_instances", "SELECT ?x WHERE { ?x a v:Nation } ORDER BY ?x", "SELECT '{D}nation/'||n_nationkey AS x FROM nation", "a")
ask("L3_order_offset", "SELECT ?n WHERE { ?x v:inRegion ?r ; v:name ?n } ORDER BY ?n LIMIT 5 OFFSET 3", "SELECT n_name AS n FROM nation ORDER BY n_name LIMIT 5 OFFSET 3", "inRegion", "name")
ask("U1_union", "SELECT ?c WHERE { { ?c a v:BuildingCustomer } UNION { ?c a v:AutomobileCustomer } }", "SELECT '{D}customer/'||c_custkey AS c FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')", "a")
ask("U1_ragged_union", "SELECT ?x ?r ?n WHERE { { ?x v:inRegion ?r } UNION { ?x v:inNation ?n . ?x a v:Supplier } }", "SELECT '{D}nation/'||n_nationkey AS x, '{D}region/'||n_regionkey AS r, NULL AS n FROM nation UNION ALL SELECT '{D}supplier/'||s_suppkey, NULL, '{D}nation/'||s_nationkey FROM supplier", "a", "inRegion", "inNation")
ask("U2_union_of_many", "SELECT ?c WHERE { { ?c a v:Region } UNION { ?c a v:Nation } UNION { ?c a v:Supplier } UNION { ?c a v:Region } }", "SELECT '{D}region/'||r_regionkey AS c FROM region UNION ALL SELECT '{D}nation/'||n_nationkey FROM nation UNION ALL SELECT '{D}supplier/'||s_suppkey FROM supplier UNION ALL SELECT '{D}region/'||r_regionkey FROM region", "a")


@query("U3_merge", "SELECT '{D}nation/'||n_nationkey AS s, '{V}inRegion' AS p FROM nation UNION ALL SELECT '{D}customer/'||c_custkey, '{V}inNation' FROM customer UNION ALL SELECT '{D}supplier/'||s_suppkey, '{V}inNation' FROM supplier")
def _(spark, sf_dir):
    return imports.merge(graph(spark, sf_dir, "inRegion", "inNation"), graph(spark, sf_dir, "inRegion")).triples.select("s", "p")


# ---------------------------------------------------------------- reasoning: hierarchy
_PART_CLASSES = "SELECT DISTINCT '{V}'||upper(p_type[1])||lower(p_type[2:])||'Part' AS sub, '{V}Part' AS sup FROM part"
_EDGES = "e AS (" + " UNION ALL ".join([f"SELECT '{{V}}{s}Customer' AS sub, '{{V}}Customer' AS sup" for s in relational.SEGMENTS] + ["SELECT '{V}Customer', '{V}Party'", "SELECT '{V}Supplier', '{V}Party'"] + [f"SELECT '{{V}}{k}Event', '{{V}}Event'" for k in relational.EVENT_TYPES] + [_PART_CLASSES]) + ")"
_CLOSURE = f"WITH RECURSIVE {_EDGES}, c AS (SELECT sub, sup FROM e UNION SELECT c.sub, e.sup FROM c JOIN e ON c.sup = e.sub) "


@query("R1_is_subclass", values([("BuildingCustomer", "Party", True), ("Party", "Customer", False), ("Customer", "Customer", True)], "sub, sup, holds"))
def _(spark, sf_dir):
    g = KnowledgeGraph(spark, axioms=relational.tbox())
    rows = [(a, b, R.is_subclass_of(g, V + a, V + b)) for a, b in (("BuildingCustomer", "Party"), ("Party", "Customer"), ("Customer", "Customer"))]
    return spark.createDataFrame(rows, "sub string, sup string, holds boolean")


@query("R2_superclasses_with_equivalents", values([("Pupil", "Student"), ("Pupil", "Person"), ("Student", "Pupil"), ("Student", "Person"), ("Teacher", "Person")], "sub, sup"))
def _(spark, sf_dir):
    return university(spark).class_closure().where("sub <> sup")


@query("R3_class_closure", _CLOSURE + "SELECT * FROM c")
def _(spark, sf_dir):
    return typed_graph(spark, sf_dir).class_closure()


@query("R4_classify", _CLOSURE + ", k AS (SELECT sub AS x FROM e UNION SELECT sup FROM e UNION SELECT '{V}HighQuality' UNION SELECT '{V}Toxic') SELECT * FROM c UNION SELECT x, '{OWL}Thing' FROM k UNION SELECT '{OWL}Nothing', x FROM k UNION SELECT '{OWL}Nothing', '{OWL}Thing'")
def _(spark, sf_dir):
    return R.classify(typed_graph(spark, sf_dir))


@query("R5_direct_edges", f"WITH {_EDGES} SELECT * FROM e")
def _(spark, sf_dir):
    g = typed_graph(spark, sf_dir)
    g.axioms += [("SubClassOf", V + "BuildingCustomer", V + "Party")]  # implied, so not direct
    return R.direct_edges(g)


@query("R6_asserted_parents", f"WITH {_EDGES} SELECT sub, string_agg(sup, ' ' ORDER BY sup) AS parents FROM e GROUP BY sub")
def _(spark, sf_dir):
    return R.asserted_parents(typed_graph(spark, sf_dir)).withColumn("parents", F.array_join("parents", " "))


@query("R7_instances", "SELECT '{D}customer/'||c_custkey AS x FROM customer UNION ALL SELECT '{D}supplier/'||s_suppkey FROM supplier")
def _(spark, sf_dir):
    return R.instances(graph(spark, sf_dir, "a"), V + "Party")


@query("R8_instance_check", values([("customer/1", "Party", True), ("nation/1", "Party", False)], "x, cls, holds"))
def _(spark, sf_dir):
    g = graph(spark, sf_dir, "a")
    rows = [(x, c, not R.instances(g, V + c).where(F.col("x") == D + x).isEmpty()) for x, c in (("customer/1", "Party"), ("nation/1", "Party"))]
    return spark.createDataFrame(rows, "x string, cls string, holds boolean")


@query("R9_disjoint_classes", values([("Student", "Teacher"), ("Pupil", "Teacher")], "a, b"))
def _(spark, sf_dir):
    return R.disjoint_classes(university(spark))


@query("R10_equivalent_classes", values([("Pupil", "Student"), ("A", "B"), ("A", "C"), ("B", "C")], "a, b"))
def _(spark, sf_dir):
    g = university(spark)
    g.axioms += [("SubClassOf", "A", "B"), ("SubClassOf", "B", "C"), ("SubClassOf", "C", "A")]
    return R.equivalent_classes(g)


_TORN = [("SubClassOf", "TA", "Student"), ("SubClassOf", "TA", "Teacher"), ("SubClassOf", "JuniorTA", "TA"), ("SubClassOf", "Void", T.NOTHING)]


@query("R11_unsatisfiable", values([("TA",), ("JuniorTA",), ("Void",)], "cls"))
def _(spark, sf_dir):
    g = university(spark)
    g.axioms += _TORN
    return R.unsatisfiable_classes(g)


@query("R12_consistent", values([("university", True), ("with bob a teacher", False), ("with mutual subclasses", True)], "graph, consistent"))
def _(spark, sf_dir):
    g = university(spark)
    rows = [("university", R.is_consistent(g)), ("with bob a teacher", R.would_be_consistent(g, ("ClassAssertion", "Teacher", "bob"))), ("with mutual subclasses", R.would_be_consistent(g, ("SubClassOf", "Student", "Pupil")))]
    return spark.createDataFrame(rows, "graph string, consistent boolean")


@query("R13_facade_consistent", values([(True, True)], "top, bottom_empty"))
def _(spark, sf_dir):
    t = Tableau(_UNIVERSITY)
    return spark.createDataFrame([(t.is_satisfiable(T.THING), not t.is_satisfiable(T.NOTHING))], "top boolean, bottom_empty boolean")


@query("R14_clashes", "SELECT 'disjoint_types' AS kind, '{D}document/'||doc_id AS subject, '{V}HighQuality {V}Toxic' AS detail FROM labels WHERE quality = 1 AND toxic = 1")
def _(spark, sf_dir):
    g = graph(spark, sf_dir, "a")
    g.axioms = [x for x in g.axioms if x[0] in ("SubClassOf", "DisjointClasses")]
    return R.clashes(g)


@query("R15_what_if", values([("ClassAssertion Teacher ann", False), ("ClassAssertion Person ann", True), ("DifferentIndividuals ann bob", True), ("ClassAssertion ('not', 'Person') ann", False), ("ClassAssertion ('or', ('not', 'Person'), 'Teacher') ann", False)], "axiom, consistent"))
def _(spark, sf_dir):
    g = university(spark)
    axioms = [("ClassAssertion", "Teacher", "ann"), ("ClassAssertion", "Person", "ann"), ("DifferentIndividuals", "ann", "bob"), ("ClassAssertion", ("not", "Person"), "ann"), ("ClassAssertion", ("or", ("not", "Person"), "Teacher"), "ann")]
    return spark.createDataFrame([(" ".join(map(str, x)), R.would_be_consistent(g, x)) for x in axioms], "axiom string, consistent boolean")


# ---------------------------------------------------------------- reasoning: rules
_FACTS = [("partOf", T.TYPE, T.OWL + "TransitiveProperty"), ("a", "partOf", "b"), ("b", "partOf", "c"), ("c", "partOf", "d"), ("Dog", T.SUBCLASS, "Mammal"), ("Mammal", T.SUBCLASS, "Animal"), ("rex", T.TYPE, "Dog"), ("near", T.TYPE, T.OWL + "SymmetricProperty"), ("a", "near", "b")]
_DERIVED = [("a", "partOf", "c"), ("a", "partOf", "d"), ("b", "partOf", "d"), ("Dog", T.SUBCLASS, "Animal"), ("rex", T.TYPE, "Mammal"), ("rex", T.TYPE, "Animal"), ("b", "near", "a")]


@query("R16_forward_chaining", values(_FACTS + _DERIVED, "s, p, o"))
def _(spark, sf_dir):
    t = spark.createDataFrame([(*x, "iri", None, None) for x in _FACTS], T.TRIPLE)
    return RU.saturate(t).select("s", "p", "o")


def _one_rule(name: str, rule_name: str, rows: list[tuple]):
    @query(name, values(_FACTS + rows, "s, p, o"))
    def run(spark, sf_dir):
        t = spark.createDataFrame([(*x, "iri", None, None) for x in _FACTS], T.TRIPLE)
        return RU.saturate(t, [r for r in RU.RULES if r.name == rule_name]).select("s", "p", "o")


_one_rule("R17_rule_transitive", "transitive_property", _DERIVED[:3])
_one_rule("R18_rule_subclass", "subclass_transitivity", _DERIVED[3:4])
_one_rule("R20_rule_symmetric", "symmetric_property", _DERIVED[6:])


@query("R19_inherited_types", "SELECT '{V}Party' AS cls, count(*) AS n FROM (SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier) UNION ALL SELECT '{V}Customer', count(*) FROM customer UNION ALL SELECT '{V}Event', count(*) FROM events UNION ALL SELECT '{V}Part', count(*) FROM part UNION ALL SELECT '{V}'||upper(event_type[1])||lower(event_type[2:])||'Event', count(*) FROM events GROUP BY event_type")
def _(spark, sf_dir):
    wanted = [V + c for c in ("Party", "Customer", "Event", "Part")] + [V + f"{k}Event" for k in relational.EVENT_TYPES]
    return R.inherited_types(typed_graph(spark, sf_dir)).where(F.col("cls").isin(wanted)).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query("R21_label_expansion", values([("tom", "Teacher"), ("tom", "Person"), ("ann", "Student"), ("ann", "Pupil"), ("ann", "Person"), ("bob", "Pupil"), ("bob", "Student"), ("bob", "Person"), ("maths", "Course")], "x, cls"))
def _(spark, sf_dir):
    return R.inherited_types(university(spark))


@query("R22_transitive_edges", """WITH RECURSIVE e AS (SELECT DISTINCT '{D}lineitem/'||l_orderkey||'-'||l_linenumber AS a, '{D}order/'||l_orderkey AS b FROM lineitem
    UNION ALL SELECT '{D}order/'||o_orderkey, '{D}customer/'||o_custkey FROM orders UNION ALL SELECT '{D}customer/'||c_custkey, '{D}nation/'||c_nationkey FROM customer UNION ALL SELECT '{D}nation/'||n_nationkey, '{D}region/'||n_regionkey FROM nation),
    c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS s, b AS o FROM c""")
def _(spark, sf_dir):
    return closure(_part_of(spark, sf_dir), "s", "o")


def _part_of(spark, sf_dir):
    t = graph(spark, sf_dir, "ofOrder", "placedBy", "inNation", "inRegion").edges()
    return t.where(~F.col("s").startswith(D + "supplier/")).select("s", "o")


@query("R22_part_of_path", "SELECT DISTINCT '{D}customer/'||c_custkey AS x, y FROM (SELECT c_custkey, '{D}nation/'||c_nationkey AS y FROM customer UNION ALL SELECT c_custkey, '{D}region/'||n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def _(spark, sf_dir):
    return graph(spark, sf_dir, "a", "inNation", "inRegion").query("SELECT ?x ?y WHERE { ?x a v:Customer . ?x (v:inNation|v:inRegion)+ ?y }", PREFIX)


@query("R23_symmetric_edges", "SELECT '{D}supplier/'||a.s_suppkey AS s, '{D}supplier/'||b.s_suppkey AS o FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey <> b.s_suppkey")
def _(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a, b = s.select(F.col("s_suppkey").alias("x"), "s_nationkey"), s.select(F.col("s_suppkey").alias("y"), "s_nationkey")
    iri = lambda c: F.concat(F.lit(D + "supplier/"), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    one_way = a.join(b, "s_nationkey").where("x < y").select(iri("x").alias("s"), F.lit(V + "sameNation").alias("p"), iri("y").alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
    g = KnowledgeGraph(spark, one_way, [("SymmetricObjectProperty", V + "sameNation")])
    return R.property_edges(g, {"symmetric"}).select("s", "o")


@query("R24_reflexive_edges", values([("a", "a"), ("b", "b"), ("c", "c")], "s, o"))
def _(spark, sf_dir):
    g = mini(spark, [("a", "p", "b")], [("c", "C")], axioms=[("ReflexiveObjectProperty", "knows")])
    return R.property_edges(g).where("p = 'knows'").select("s", "o")


@query("R25_functional_clash", "SELECT '{D}lineitem/'||l_orderkey||'-'||l_linenumber AS x FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_partkey) > 1")
def _(spark, sf_dir):
    return R.functional_groups(graph(spark, sf_dir, "ofPart").edges(), V + "ofPart").select("x")


@query("R25_functional_merge", values([("b", "b"), ("c", "b"), ("d", "b")], "x, rep"))
def _(spark, sf_dir):
    g = mini(spark, [("a", "mother", "b"), ("a", "mother", "c"), ("e", "mother", "c"), ("e", "mother", "d")], axioms=[("FunctionalObjectProperty", "mother")])
    return R.same_components(R.same_edges(g, g.edges(), g.types()))


@query("R26_inverse_functional_merge", values([("a", "a"), ("b", "a")], "x, rep"))
def _(spark, sf_dir):
    g = mini(spark, [("a", "ssn", "1"), ("b", "ssn", "1"), ("c", "ssn", "2")], axioms=[("InverseFunctionalObjectProperty", "ssn")])
    return R.same_components(R.same_edges(g, g.edges(), g.types()))


@query("R27_same_as_components", "SELECT '{D}document/'||doc_id AS x, '{D}document/'||min(doc_id) OVER (PARTITION BY text) AS rep FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    e = d.join(d.groupBy("h").agg(F.min("doc_id").alias("u")), "h").select("u", F.col("doc_id").alias("v"))
    iri = lambda c: F.concat(F.lit(D + "document/"), F.col(c).cast("string"))
    return R.same_components(e).select(iri("x").alias("x"), iri("rep").alias("rep"))


@query("R28_different_clash", values([("a", "c")], "a, b"))
def _(spark, sf_dir):
    g = mini(spark, axioms=[("SameIndividual", "a", "b"), ("SameIndividual", "b", "c"), ("SameIndividual", "x", "y"), ("DifferentIndividuals", "a", "c"), ("DifferentIndividuals", "a", "x")])
    reps = R.same_components(R.same_edges(g, g.edges(), g.types()))
    return R.different_clashes(g.member_pairs("DifferentIndividuals"), reps)


_LOOPS = [("a", "parent", "a"), ("a", "parent", "b"), ("b", "parent", "a"), ("b", "parent", "c")]


@query("R29_irreflexive_clash", values([("a",)], "s"))
def _(spark, sf_dir):
    return R.irreflexive_clashes(mini(spark, _LOOPS).edges(), "parent")


@query("R30_asymmetric_clash", values([("a", "a"), ("a", "b")], "s, o"))
def _(spark, sf_dir):
    return R.asymmetric_clashes(mini(spark, _LOOPS).edges(), "parent")


@query("R31_property_hierarchy", "SELECT '{D}nation/'||n_nationkey AS s, '{V}partOf' AS p, '{D}region/'||n_regionkey AS o FROM nation UNION ALL SELECT '{D}order/'||o_orderkey, '{V}partOf', '{D}customer/'||o_custkey FROM orders")
def _(spark, sf_dir):
    return R.property_edges(graph(spark, sf_dir, "inRegion", "placedBy"), {"property_hierarchy"}).where(F.col("p") == V + "partOf")


@query("R32_domain_range", "SELECT DISTINCT '{D}order/'||o_orderkey AS x, '{V}Order' AS cls FROM orders UNION ALL SELECT DISTINCT '{D}customer/'||o_custkey, '{V}Customer' FROM orders")
def _(spark, sf_dir):
    g = graph(spark, sf_dir, "placedBy")
    return R.domain_range_types(g, g.edges())


@query("R33_inverse_edges", "SELECT '{D}customer/'||o_custkey AS s, '{D}order/'||o_orderkey AS o FROM orders")
def _(spark, sf_dir):
    return R.property_edges(graph(spark, sf_dir, "placedBy"), {"inverse"}).where(F.col("p") == V + "placed").select("s", "o")


@query("R34_negative_clash", values([("a", "p", "b"), ("a", "age", "5")], "s, p, o"))
def _(spark, sf_dir):
    g = mini(spark, [("a", "p", "b"), ("a", "p", "c")], literals=[("a", "age", "5", T.INTEGER)], axioms=[("NegativeObjectPropertyAssertion", "p", "a", "b"), ("NegativeObjectPropertyAssertion", "p", "b", "c"), ("NegativeDataPropertyAssertion", "age", "a", ("5", T.INTEGER, None))])
    return R.negative_clashes(g, g.edges())


@query("R35_abox_load", "SELECT '{V}inRegion' AS p, count(*) AS n FROM nation UNION ALL SELECT '{V}inNation', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)")
def _(spark, sf_dir):
    return graph(spark, sf_dir, "inRegion", "inNation").edges().groupBy("p").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- reasoning: class expressions
def _members(name: str, expression, oracle: str, *predicates: str):
    @query(name, oracle)
    def run(spark, sf_dir):
        g = graph(spark, sf_dir, *predicates)
        g.axioms = [x for x in g.axioms if x[0] in ("SubClassOf", "DisjointClasses")]
        return X.members(g, expression, g.edges())


_members("R36_intersection", ("and", V + "HighQuality", V + "Document"), "SELECT '{D}document/'||doc_id AS x FROM labels WHERE quality = 1", "a")
_members("R37_union", ("or", V + "BuildingCustomer", V + "Supplier"), "SELECT '{D}customer/'||c_custkey AS x FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT '{D}supplier/'||s_suppkey FROM supplier", "a")
_members("R38_existential", ("some", V + "placedBy", V + "MachineryCustomer"), "SELECT '{D}order/'||o_orderkey AS x FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'", "a", "placedBy")
_members("R38_inverse_existential", ("some", ("inverse", V + "inRegion"), V + "Nation"), "SELECT DISTINCT '{D}region/'||n_regionkey AS x FROM nation", "a", "inRegion")
_members("R36_complement", ("not", V + "Toxic"), "SELECT '{D}document/'||doc_id AS x FROM labels WHERE quality = 1", "a")


@query("R39_universal", "SELECT DISTINCT '{D}region/'||n_regionkey AS x, '{V}Area' AS cls FROM nation")
def _(spark, sf_dir):
    # every nation is in areas only: the filler goes to all successors of its instances
    g = graph(spark, sf_dir, "a", "inRegion")
    g.axioms = [("SubClassOf", V + "Nation", ("only", V + "inRegion", V + "Area"))]
    return Told(g).types.where(F.col("cls") == V + "Area")


@query("R39_universal_clash", "SELECT DISTINCT 'complement' AS kind, '{D}customer/'||o_custkey AS subject, '{V}MachineryCustomer' AS detail FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def _(spark, sf_dir):
    # no order may be placed by a machinery customer
    g = graph(spark, sf_dir, "a", "placedBy")
    g.axioms = [("SubClassOf", V + "Order", ("only", V + "placedBy", ("not", V + "MachineryCustomer")))]
    return R.clashes(g).where("kind IN ('complement', 'universal')")


@query("R40_nominals", values([("a", "one"), ("b", "one"), ("c", "value"), ("d", "self")], "x, how"))
def _(spark, sf_dir):
    g = mini(spark, [("c", "p", "a"), ("c", "p", "b"), ("d", "q", "d"), ("d", "q", "a")])
    parts = [(("one", "a", "b"), "one"), (("value", "p", "a"), "value"), (("self", "q"), "self")]
    out = None
    for e, how in parts:
        one = X.members(g, e).select("x", F.lit(how).alias("how"))
        out = one if out is None else out.union(one)
    return out


@query("R41_data_range", "SELECT '{D}part/'||p_partkey AS x FROM part WHERE p_size >= 10 AND p_size < 20")
def _(spark, sf_dir):
    g = graph(spark, sf_dir, "size")
    return X.members(g, ("dsome", V + "size", ("restriction", T.INTEGER, ("minInclusive", "10"), ("maxExclusive", "20"))), g.edges(), g.types())


@query("R41_empty_ranges", values([("float (1, next float)", True), ("float [1, 1]", False), ("integer (1, 2)", True), ("integer [1, 2)", False), ("decimal (1, 2)", False)], "range, empty"))
def _(spark, sf_dir):
    f = T.XSD + "float"
    after = T.float_neighbours(1.0)[1]
    rows = [("float (1, next float)", ("restriction", f, ("minExclusive", "1"), ("maxExclusive", repr(after)))), ("float [1, 1]", ("restriction", f, ("minInclusive", "1"), ("maxInclusive", "1"))), ("integer (1, 2)", ("restriction", T.INTEGER, ("minExclusive", "1"), ("maxExclusive", "2"))), ("integer [1, 2)", ("restriction", T.INTEGER, ("minInclusive", "1"), ("maxExclusive", "2"))), ("decimal (1, 2)", ("restriction", T.DECIMAL, ("minExclusive", "1"), ("maxExclusive", "2")))]
    return spark.createDataFrame([(n, X.empty_range(r)) for n, r in rows], "range string, empty boolean")


@query("R42_cardinality_clash", "SELECT '{D}region/'||n_regionkey AS s FROM nation GROUP BY n_regionkey HAVING count(*) > 4")
def _(spark, sf_dir):
    # nations are all different; a region holds four at most
    g = graph(spark, sf_dir, "inRegion")
    nations = sorted(r["s"] for r in g.edges(V + "inRegion").select("s").distinct().collect())  # 25 individuals of an axiom
    g.axioms = [("DifferentIndividuals", *nations), ("SubClassOf", ("some", ("inverse", V + "inRegion"), T.THING), ("max", 4, ("inverse", V + "inRegion")))]
    return R.clashes(g).where("kind = 'max_cardinality'").select(F.col("subject").alias("s"))


@query("R42_no_clash_of_a_circle", values([("clique", 1), ("circle", 0)], "shape, clashes"))
def _(spark, sf_dir):
    # four successors that differ along a circle may be two; three that differ pairwise may not
    near = {"circle": ("ab", "bc", "cd", "da"), "clique": ("ab", "bc", "ca", "cd")}
    rows = []
    for shape, pairs in near.items():
        g = mini(spark, [("x", "p", o) for o in "abcd"], axioms=[("DifferentIndividuals", *p) for p in pairs])
        rows.append((shape, R.cardinality_clashes(g.edges(), g.member_pairs("DifferentIndividuals"), "p", 2).count()))
    return spark.createDataFrame(rows, "shape string, clashes long")


@query("R43_disjoint_clash", "SELECT '{D}document/'||doc_id AS x, '{V}HighQuality' AS a, '{V}Toxic' AS b FROM labels WHERE quality = 1 AND toxic = 1")
def _(spark, sf_dir):
    g = graph(spark, sf_dir, "a")
    return R.disjoint_type_clashes(g)


_TBOX = [("SubClassOf", "A", "B"), ("SubClassOf", "B", ("some", "p", "C")), ("DisjointClasses", "C", "D"), ("SubClassOf", "E", ("and", "A", ("only", "p", "D"))), ("EquivalentClasses", "F", ("or", "A", "E"))]


@query("R44_tableau_subsumption", values([("A", "B", True), ("B", "A", False), ("A", "F", True), ("F", "B", True), ("E", "D", True)], "sub, sup, holds"))
def _(spark, sf_dir):
    t = Tableau(_TBOX)
    return spark.createDataFrame([(a, b, t.subsumes(b, a)) for a, b in (("A", "B"), ("B", "A"), ("A", "F"), ("F", "B"), ("E", "D"))], "sub string, sup string, holds boolean")


@query("R45_consistency_by_individual", values([("disjoint_types", "y", "C D")], "kind, subject, detail"))
def _(spark, sf_dir):
    return R.clashes(mini(spark, types=[("x", "C"), ("z", "D"), ("y", "C"), ("y", "D")], axioms=[("DisjointClasses", "C", "D")]))


@query("R46_materialize_all", values([("a", "anc", "b"), ("a", "anc", "c"), ("b", "anc", "c"), ("a", "par", "b"), ("b", "par", "c"), ("b", "chi", "a"), ("c", "chi", "b"), ("a", T.TYPE, "Person"), ("b", T.TYPE, "Person"), ("c", T.TYPE, "Person"), ("a", T.TYPE, "Thing"), ("b", T.TYPE, "Thing"), ("c", T.TYPE, "Thing")], "s, p, o"))
def _(spark, sf_dir):
    g = mini(spark, [("a", "par", "b"), ("b", "par", "c")], axioms=[("SubObjectPropertyOf", "par", "anc"), ("TransitiveObjectProperty", "anc"), ("InverseObjectProperties", "par", "chi"), ("ObjectPropertyDomain", "par", "Person"), ("ObjectPropertyRange", "par", "Person"), ("SubClassOf", "Person", "Thing")])
    return g.materialized().triples.select("s", "p", "o")


@query("R47_rules_switched_off", values([("a", "par", "b"), ("b", "chi", "a")], "s, p, o"))
def _(spark, sf_dir):
    g = mini(spark, [("a", "par", "b")], axioms=[("SubObjectPropertyOf", "par", "anc"), ("InverseObjectProperties", "par", "chi")])
    return g.materialized({"inverse"}).triples.select("s", "p", "o")


@query("R48_blocking", values([("P", True), ("P and only r not P", False)], "expression, satisfiable"))
def _(spark, sf_dir):
    t = Tableau([("SubClassOf", "P", ("some", "r", "P")), ("TransitiveObjectProperty", "r")])
    return spark.createDataFrame([("P", t.is_satisfiable("P")), ("P and only r not P", t.is_satisfiable(("and", "P", ("only", "r", ("not", "P")))))], "expression string, satisfiable boolean")


@query("R49_backtracking", values([("first branch fails", True), ("all branches fail", False), ("merge under max", True), ("no merge of distinct", False)], "case_name, satisfiable"))
def _(spark, sf_dir):
    t = Tableau([("DisjointClasses", "A", "B"), ("DisjointClasses", "C", "B")])
    cases = [("first branch fails", ("and", "B", ("or", "A", "D"))), ("all branches fail", ("and", "B", ("or", "A", "C"))), ("merge under max", ("and", ("some", "p", "A"), ("some", "p", "D"), ("max", 1, "p"))), ("no merge of distinct", ("and", ("some", "p", "A"), ("some", "p", "B"), ("max", 1, "p")))]
    return spark.createDataFrame([(n, t.is_satisfiable(e)) for n, e in cases], "case_name string, satisfiable boolean")


@query("R50_parallel_consistency", "SELECT 'complement' AS kind, count(*) AS clashes FROM labels WHERE quality = 1 AND toxic = 1 UNION ALL SELECT 'disjoint_types', count(*) FROM labels WHERE quality = 1 AND toxic = 1")
def _(spark, sf_dir):
    # every individual is checked by the joins of all its axioms, complex ones too, in one distributed pass
    g = graph(spark, sf_dir, "a")
    g.axioms = [("DisjointClasses", V + "HighQuality", V + "Toxic"), ("SubClassOf", V + "Toxic", ("not", V + "HighQuality"))]
    return R.clashes(g).groupBy("kind").agg(F.count(F.lit(1)).alias("clashes"))


@query("R51_property_chain", "SELECT '{D}customer/'||c_custkey AS s, '{D}region/'||n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT '{D}supplier/'||s_suppkey, '{D}region/'||n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf_dir):
    g = graph(spark, sf_dir, "inNation", "inRegion")
    g.axioms = [("SubPropertyChainOf", (V + "inNation", V + "inRegion"), V + "locatedIn")]
    return R.property_edges(g).where(F.col("p") == V + "locatedIn").select("s", "o")


@query("R52_has_key", "WITH l AS (SELECT '{D}document/'||d.doc_id AS x, lang, quality, toxic FROM documents d JOIN labels USING (doc_id)), k AS (SELECT x, min(x) OVER (PARTITION BY lang, quality) AS u FROM l) SELECT DISTINCT u, x AS v FROM k WHERE u <> x")
def _(spark, sf_dir):
    g = graph(spark, sf_dir, "a", "lang", "quality")
    return R.key_pairs(g, g.types(), V + "Document", (V + "lang", V + "quality"))


@query("R53_structural_problems", values([("subclass_cycle", "A"), ("subclass_cycle", "B"), ("symmetric_and_asymmetric", "p"), ("reflexive_and_irreflexive", "q"), ("repeated_disjoint_member", "C"), ("cardinality", "p")], "kind, subject"))
def _(spark, sf_dir):
    g = KnowledgeGraph(spark, axioms=[("SubClassOf", "A", "B"), ("SubClassOf", "B", "A"), ("SymmetricObjectProperty", "p"), ("AsymmetricObjectProperty", "p"), ("ReflexiveObjectProperty", "q"), ("IrreflexiveObjectProperty", "q"), ("DisjointClasses", "C", "D", "C"), ("ObjectMaxCardinality", 2_000_000, "p")])
    return R.structural_problems(g)


@query("R54_entity_problems", values([("", "empty"), ("http://e/a\tb", "control_character"), ("nocolon", "no_scheme")], "iri, problem").replace("a\tb", "a'||chr(9)||'b"))
def _(spark, sf_dir):
    return R.entity_problems(spark.createDataFrame([("http://e/ok",), ("",), ("http://e/a\tb",), ("nocolon",)], "iri string"))


_PROFILED = [("SubClassOf", "A", ("only", "p", "B")), ("SubClassOf", "A", ("min", 2, "p", "B")), ("SubClassOf", "A", ("max", 1, "p")), ("EquivalentClasses", "A", "B", "C"), ("DisjointClasses", "A", "D"), ("TransitiveObjectProperty", "p"), ("SubClassOf", "E", ("not", "A")), ("SubClassOf", "E", ("self", "q")), ("SubClassOf", "E", ("one", "x", "y")), ("SubPropertyChainOf", ("p", "p", "p"), "q")]


@query("R55_el_violations", values([("disjoint_classes", "A"), ("equivalent_classes", "A"), ("expression", "p"), ("expression", "p"), ("expression", "p"), ("expression", ""), ("nominal_with_several", "y")], "violation, subject"))
def _(spark, sf_dir):
    return P.el_violations(KnowledgeGraph(spark, axioms=_PROFILED)).select("violation", "subject")


@query("R56_ql_violations", values([("TransitiveObjectProperty", "p"), ("property_chain", "q"), ("min_cardinality", "p"), ("max_cardinality", "p")], "violation, subject"))
def _(spark, sf_dir):
    return P.ql_violations(KnowledgeGraph(spark, axioms=_PROFILED)).select("violation", "subject")


@query("R57_rl_violations", values([("complement", "", "error"), ("self_restriction", "q", "error"), ("nominal_with_several", "", "warning")], "violation, subject, severity"))
def _(spark, sf_dir):
    return P.rl_violations(KnowledgeGraph(spark, axioms=_PROFILED))


@query("R58_profiles", values([("mixed", "EL", False), ("mixed", "QL", False), ("mixed", "RL", False), ("mapped", "EL", False), ("mapped", "QL", False), ("mapped", "RL", True)], "graph, profile, conforms"))
def _(spark, sf_dir):
    a = P.profiles(KnowledgeGraph(spark, axioms=_PROFILED)).select(F.lit("mixed").alias("graph"), "profile", "conforms")
    return a.union(P.profiles(KnowledgeGraph(spark, axioms=relational.tbox())).select(F.lit("mapped").alias("graph"), "profile", "conforms"))


@query("R59_profile_report", values([("EL", "disjoint_classes", 1, "medium"), ("EL", "equivalent_classes", 1, "medium"), ("EL", "expression", 4, "medium"), ("EL", "nominal_with_several", 1, "medium"), ("QL", "TransitiveObjectProperty", 1, "medium"), ("QL", "property_chain", 1, "medium"), ("QL", "min_cardinality", 1, "medium"), ("QL", "max_cardinality", 1, "medium"), ("RL", "complement", 1, "low"), ("RL", "self_restriction", 1, "low"), ("RL", "nominal_with_several", 1, "low")], "profile, violation, n, effort"))
def _(spark, sf_dir):
    return P.report(KnowledgeGraph(spark, axioms=_PROFILED)).withColumn("n", F.col("n").cast("int"))


@query("R60_satisfiable_by_profile", values([("A", True), ("E", False), ("F", True)], "cls, satisfiable"))
def _(spark, sf_dir):
    t = Tableau(_TBOX)
    return spark.createDataFrame([(c, t.is_satisfiable(c)) for c in ("A", "E", "F")], "cls string, satisfiable boolean")


@query("L4_minimal_explanations", values([("nothing", "x", T.NOTHING), ("unsatisfiable_class", "V", "")], "kind, subject, detail"))
def _(spark, sf_dir):
    g = mini(spark, types=[("x", "V"), ("y", "C"), ("y", "D")], axioms=[("SubClassOf", "V", T.NOTHING), ("DisjointClasses", "C", "D")])
    found = R.clashes(g)
    return R.minimal_explanations(found.where("kind = 'unsatisfiable_class'")).drop("size").union(R.minimal_explanations(found.where("kind <> 'unsatisfiable_class' AND kind <> 'disjoint_types'")).drop("size"))


@query("L5_explanation_cap", "SELECT 'disjoint_types' AS kind, '{D}document/'||doc_id AS subject FROM labels WHERE quality = 1 AND toxic = 1 ORDER BY subject LIMIT 10")
def _(spark, sf_dir):
    g = graph(spark, sf_dir, "a")
    found = R.disjoint_type_clashes(g).select(F.lit("disjoint_types").alias("kind"), F.col("x").alias("subject"), F.concat_ws(" ", "a", "b").alias("detail"))
    return R.minimal_explanations(found).select("kind", "subject")


# ---------------------------------------------------------------- scalar functions
@query("FN_iri_parts", "SELECT 'http://example.org/d/nation/'||n_nationkey AS iri, n_nationkey::VARCHAR AS local, 'http://example.org/d/nation/' AS ns, false AS is_owl FROM nation")
def _(spark, sf_dir):
    iri = relational.node("nation", "n_nationkey")
    return table(spark, sf_dir, "nation").select(iri.alias("iri"), T.local_name(iri).alias("local"), T.namespace(iri).alias("ns"), T.in_namespace(iri, T.OWL).alias("is_owl"))


@query("FN_text", "SELECT r_regionkey AS k, '&lt;'||r_name||' &amp; &quot;x&quot;&gt;' AS escaped, '<'||r_name||' & \"x\">' AS back, 'a b '||r_name AS spaced FROM region")
def _(spark, sf_dir):
    raw = F.concat(F.lit("<"), "r_name", F.lit(' & "x">'))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), T.escape_xml(raw).alias("escaped"), T.unescape_xml(T.escape_xml(raw)).alias("back"), T.normalize_whitespace(F.concat(F.lit("  a \t b\n "), "r_name", F.lit(" "))).alias("spaced"))


@query("FN_parse", values([("true", True, None, None), ("0", False, 0, 0.0), ("12", None, 12, 12.0), ("-3.5", None, None, -3.5), ("x", None, None, None)], "t, b, i, f"))
def _(spark, sf_dir):
    d = spark.createDataFrame([("true",), ("0",), ("12",), ("-3.5",), ("x",)], "t string")
    t = F.col("t")
    return d.select("t", T.parse_boolean(t).alias("b"), T.parse_integer(t).cast("int").alias("i"), T.parse_float(t).alias("f"))


@query("FN_names", values([("owl:Thing", T.OWL + "Thing", "owl", "Thing", True), ("x:y", None, "x", "y", True), ("plain", None, None, None, False)], "q, full_iri, prefix, local, valid"))
def _(spark, sf_dir):
    d = spark.createDataFrame([("owl:Thing",), ("x:y",), ("plain",)], "q string")
    q = F.col("q")
    parts = T.curie_parts(q)
    return d.select("q", T.expand_qname(q).alias("full_iri"), parts["prefix"].alias("prefix"), parts["local"].alias("local"), T.valid_iri(q).alias("valid"))


@query("FN_float_neighbours", values([(1.0, 0.9999999403953552, 1.0000001192092896)], "x, below, above"))
def _(spark, sf_dir):
    return spark.createDataFrame([(1.0, *T.float_neighbours(1.0))], "x double, below double, above double")


@query("FN_jsonld_compact", values([("http://e/name", "name"), ("http://f/x", "f:x"), ("http://g/y", "http://g/y")], "iri, compact"))
def _(spark, sf_dir):
    from ontoweave.sources.jsonld import Context

    c = Context().extend({"@vocab": "http://e/", "f": "http://f/"})
    return spark.createDataFrame([(i, c.compact(i)) for i in ("http://e/name", "http://f/x", "http://g/y")], "iri string, compact string")


# ---------------------------------------------------------------- documented features, streaming
ask("Q_path_sequence", "SELECT ?o ?r WHERE { ?o v:placedBy/v:inNation/v:inRegion ?r }", "SELECT '{D}order/'||o_orderkey AS o, '{D}region/'||n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", "placedBy", "inNation", "inRegion")
ask("Q_path_inverse", "SELECT ?r ?n WHERE { ?r ^v:inRegion ?n }", "SELECT '{D}region/'||n_regionkey AS r, '{D}nation/'||n_nationkey AS n FROM nation", "inRegion")
ask("Q_path_zero_or_more", "SELECT ?x ?y WHERE { ?x a v:Nation . ?x v:inRegion* ?y }", "SELECT '{D}nation/'||n_nationkey AS x, '{D}nation/'||n_nationkey AS y FROM nation UNION ALL SELECT '{D}nation/'||n_nationkey, '{D}region/'||n_regionkey FROM nation", "a", "inRegion")


@query("Q_inference_on_off", "SELECT 'asserted' AS mode, 0::BIGINT AS n UNION ALL SELECT 'inferred', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)")
def _(spark, sf_dir):
    g = graph(spark, sf_dir, "a")
    g.axioms = [x for x in g.axioms if x[0] == "SubClassOf"]
    g.triples = g.triples.where(F.col("s").startswith(D + "customer/") | F.col("s").startswith(D + "supplier/"))
    text = "SELECT (COUNT(?x) AS ?n) WHERE { ?x a v:Party }"
    return g.query(text, PREFIX).select(F.lit("asserted").alias("mode"), "n").union(g.query(text, PREFIX, inference=True).select(F.lit("inferred").alias("mode"), "n"))


@query("Q_batch", "SELECT 'nations' AS name, count(*) AS n FROM nation UNION ALL SELECT 'regions', count(*) FROM region")
def _(spark, sf_dir):
    out = graph(spark, sf_dir, "a").batch({"nations": "SELECT (COUNT(?x) AS ?n) WHERE { ?x a v:Nation }", "regions": "SELECT (COUNT(?x) AS ?n) WHERE { ?x a v:Region }"}, PREFIX)
    return out["nations"].select(F.lit("nations").alias("name"), "n").union(out["regions"].select(F.lit("regions").alias("name"), "n"))


@query("Q_validate", values([("SELECT ?x WHERE { ?y v:p ?z }", "?x is not bound"), ("SELECT ?x WHERE { ?x a ", "expected an IRI, found 'the end'"), ("SELECT ?x WHERE { ?x nope:p ?z }", "unknown prefix 'nope'")], "query, problem"))
def _(spark, sf_dir):
    texts = ("SELECT ?x WHERE { ?y v:p ?z }", "SELECT ?x WHERE { ?x a v:C }", "SELECT ?x WHERE { ?x a ", "SELECT ?x WHERE { ?x nope:p ?z }")
    return spark.createDataFrame([(t, p) for t in texts for p in sparql.check(t, PREFIX)], "query string, problem string")


@query("Q_explain", values([(True, True)], "names_scan, prunes_other_tables"))
def _(spark, sf_dir):
    text = graph(spark, sf_dir).explain("SELECT ?n ?r WHERE { ?n v:inRegion ?r }", PREFIX)
    return spark.createDataFrame([("nation.parquet" in text, "lineitem.parquet" not in text)], "names_scan boolean, prunes_other_tables boolean")




@query("Q_join_orders", "SELECT how, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES ('as written'), ('by counts')) t(how) WHERE c_mktsegment = 'BUILDING' GROUP BY how")
def _(spark, sf_dir):
    g = graph(spark, sf_dir, "a", "placedBy")
    text = "SELECT (COUNT(?o) AS ?n) WHERE { ?o v:placedBy ?c . ?c a v:BuildingCustomer }"
    a = g.query(text, PREFIX, keep_order=True).select(F.lit("as written").alias("how"), "n")
    return a.union(g.query(text, PREFIX, use_counts=True).select(F.lit("by counts").alias("how"), "n"))


@query("Q_sql_views", "SELECT '{V}Party' AS cls, count(*) AS n FROM (SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier)")
def _(spark, sf_dir):
    g = graph(spark, sf_dir, "a")
    g.register("mapped")
    return spark.sql(f"SELECT cls, count(*) AS n FROM mapped_inherited_types WHERE cls = '{V}Party' GROUP BY cls")


@query("Q_reasoner", values([("consistent", True), ("Student below Person", True), ("Pupil same as Student", True), ("Pupil disjoint with Teacher", True), ("Student and Teacher satisfiable", False), ("bob is a Person", True), ("EL", False)], "question, answer"))
def _(spark, sf_dir):
    from ontoweave.reasoner import GraphReasoner

    r = GraphReasoner(university(spark), complete=True)
    rows = [("consistent", r.is_consistent()), ("Student below Person", r.is_subclass_of("Student", "Person")), ("Pupil same as Student", r.are_equivalent("Pupil", "Student")), ("Pupil disjoint with Teacher", r.are_disjoint("Pupil", "Teacher")), ("Student and Teacher satisfiable", r.is_satisfiable(("and", "Student", "Teacher"))), ("bob is a Person", r.is_instance_of("bob", "Person")), ("EL", r.conforms_to("EL"))]
    return spark.createDataFrame(rows, "question string, answer boolean")


@query("ST_streamed_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    path = materialize(e, "stream-in")
    name = f"counts_{uuid.uuid4().hex}"
    q = S.windowed_counts(S.read_events(spark, path._ontoweave_path, e.schema)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("ST_streamed_types", "SELECT '{D}event/'||event_id AS s, c AS o FROM events, LATERAL (VALUES ('{V}'||upper(event_type[1])||lower(event_type[2:])||'Event'), ('{V}Event')) t(c)")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    path = materialize(e, "stream-in")
    up = KnowledgeGraph(spark, axioms=relational.tbox()).class_closure()
    name = f"types_{uuid.uuid4().hex}"
    t = S.typed_triples(S.read_events(spark, path._ontoweave_path, e.schema), up, D + "event/", V)
    out = f"{shared_dir(spark)}/{name}"
    t.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("s string, p string, o string").parquet(out).select("s", "o")


def entry(spark: SparkSession) -> DataFrame:
    return graph(spark, "/root/testdata/sf0.001", "a", "placedBy", "inNation", "inRegion").query(FLAGSHIP, PREFIX)

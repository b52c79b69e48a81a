"""Formats, imports, events, collections, functions, streams and the driver's contract."""

import pytest

import __spark_entry__
from ontoweave.functions import terms as T
from ontoweave.model import KnowledgeGraph
from ontoweave.operators import collections as C
from ontoweave.plans import expressions as X
from ontoweave.plans import profiles as P
from ontoweave.sources import epcis, formats, functional, imports, jsonld, manchester, ntriples, owl_rdf, rdfxml, turtle
from ontoweave.sources.turtle import ParseError


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ntriples_round_trip(spark):
    rows = [("u:a", "u:p", 'tab\t"quote" back\\slash\nline é 😀', "lit", T.STRING, None), ("_:x", "u:p", "5", "lit", T.INTEGER, None), ("u:a", "u:q", "_:x", "bnode", None, None), ("u:a", "u:p", "salut", "lit", T.LANG_STRING, "fr"), ("u:a", "u:p", "", "lit", T.STRING, None)]
    t = spark.createDataFrame(rows, T.TRIPLE)
    assert got(ntriples.parse_lines(ntriples.to_lines(t))) == sorted(rows, key=str)


def test_ntriples_skips_and_reports_bad_lines(spark):
    lines = spark.createDataFrame([("<u:a> <u:p> <u:b> . # note",), ("# all comment",), ("  ",), ("<u:a> <u:p> .",), ('<u:a> <u:p> "\\U0001F600\\u00e9" .',), (None,)], "value string")
    assert [r["o"] for r in ntriples.parse_lines(lines).collect()] == ["u:b", "😀é"]
    assert [r["value"] for r in ntriples.malformed(lines).collect()] == ["<u:a> <u:p> ."]


def test_ntriples_file(spark, tmp_path):
    t = spark.createDataFrame([("u:a", "u:p", "u:b", "iri", None, None)], T.TRIPLE)
    ntriples.write(t, str(tmp_path / "x.nt"))
    assert got(formats.load_file(spark, str(tmp_path / "x.nt")).triples) == got(t)


@pytest.mark.parametrize("text,count", [("@prefix : <u:> . :a :p :b , :c ; :q 1 .", 3), ("PREFIX : <u:>\n:a :p [ :q [ ] ] .", 2), ("@prefix : <u:> . :a :p ( ) .", 1), ("@prefix : <u:> . :a :p ( 1 ( 2 ) ) .", 7), ('@prefix : <u:> . :a :p """long\n"quoted" text""" ; :r \'\'\'x\'\'\' ; .', 2), ("@base <http://e/x/> . <a> <b> <../c> .", 1), ("", 0), ("# nothing", 0)])
def test_turtle(text, count):
    assert len(turtle.parse(text)) == count


def test_turtle_details():
    rows = turtle.parse("@base <http://e/x/> . <a> <b#c> <../d> , -1.5e3 , .5 , +7 , false , 'a#b'@EN-gb .")
    assert rows[0][2] == "http://e/d" and rows[0][1] == "http://e/x/b#c"
    assert [(r[2], r[4].rsplit("#")[1], r[5]) for r in rows[1:]] == [("-1.5e3", "double", None), (".5", "decimal", None), ("+7", "integer", None), ("false", "boolean", None), ("a#b", "langString", "en-gb")]


@pytest.mark.parametrize("text", [":a :p :b .", "<u:a> <u:p>", '<u:a> <u:p> "open .', '"x" <u:p> <u:q> .', "@prefix : <u:> . :a :p :b"])
def test_turtle_malformed(text):
    with pytest.raises(ParseError):
        turtle.parse(text)


def test_rdfxml():
    text = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="u:" xml:base="http://b/"><rdf:Description rdf:ID="x" e:k="v"><e:p rdf:parseType="Resource"><e:q rdf:datatype="u:t">1</e:q></e:p><e:s rdf:ID="st" rdf:resource="#y"/><e:l rdf:parseType="Collection"><e:C/><e:D/></e:l></rdf:Description><rdf:Seq rdf:about="u:s"><rdf:li>a</rdf:li><rdf:li>b</rdf:li></rdf:Seq></rdf:RDF>'
    t = rdfxml.parse(text)
    assert ("http://b/#x", "u:k", "v", "lit", T.STRING, None) in t and ("http://b/#x", "u:s", "http://b/#y", "iri", None, None) in t
    assert ("http://b/#st", T.TYPE, T.STATEMENT, "iri", None, None) in t and ("u:s", T.RDF + "_2", "b", "lit", T.STRING, None) in t
    assert len([x for x in t if x[1] == T.FIRST]) == 2
    with pytest.raises(ParseError):
        rdfxml.parse("<a><b></a>")
    assert len(rdfxml.quoted_id("u:" + "s" * 300, "u:p", "u:o")) == len("_:reified_") + 64


def test_jsonld():
    t = jsonld.parse('{"@context": [{"e": "u:", "id": "@id"}, {"n": {"@id": "e:n", "@type": "e:t"}, "m": {"@id": "e:m", "@container": "@index"}, "g": {"@id": "e:g", "@container": "@id"}}], "@graph": [{"id": "e:a", "n": "1", "m": {"x": [true, null], "y": 2.5}, "g": {"e:b": {"n": "3"}}, "dropped": 1, "@reverse": {"e:r": {"id": "e:z"}}}]}')
    assert ("u:a", "u:n", "1", "lit", "u:t", None) in t and ("u:a", "u:m", "true", "lit", T.BOOLEAN, None) in t and ("u:a", "u:m", "2.5", "lit", T.DOUBLE, None) in t
    assert ("u:a", "u:g", "u:b", "iri", None, None) in t and ("u:b", "u:n", "3", "lit", "u:t", None) in t and ("u:z", "u:r", "u:a", "iri", None, None) in t
    assert len(t) == 6
    with pytest.raises(ParseError):
        jsonld.parse("{")


def test_the_same_ontology_in_every_syntax():
    p = "http://e/"
    want = ("SubClassOf", p + "A", ("some", p + "p", ("and", p + "B", ("not", p + "C"))))
    ttl = "@prefix : <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . :A rdfs:subClassOf [ owl:onProperty :p ; owl:someValuesFrom [ owl:intersectionOf ( :B [ owl:complementOf :C ] ) ] ] ."
    fun = "Prefix(:=<http://e/>) Ontology(SubClassOf(:A ObjectSomeValuesFrom(:p ObjectIntersectionOf(:B ObjectComplementOf(:C)))))"
    man = "Prefix: : <http://e/>\nClass: A\n SubClassOf: p some (B and not C)"
    xml = f'<Ontology xmlns="{T.OWL}"><SubClassOf><Class IRI="{p}A"/><ObjectSomeValuesFrom><ObjectProperty IRI="{p}p"/><ObjectIntersectionOf><Class IRI="{p}B"/><ObjectComplementOf><Class IRI="{p}C"/></ObjectComplementOf></ObjectIntersectionOf></ObjectSomeValuesFrom></SubClassOf></Ontology>'
    for text in (ttl, fun, man, xml):
        assert want in formats.axioms_of(text), formats.sniff(text)


def test_functional_writes_what_it_reads():
    axioms = functional.parse('Prefix(:=<http://e/>) Prefix(xsd:=<http://www.w3.org/2001/XMLSchema#>) Ontology(Declaration(Class(:A)) SubClassOf(:A ObjectMinCardinality(2 ObjectInverseOf(:p) :B)) SubObjectPropertyOf(ObjectPropertyChain(:p :q) :r) HasKey(:A (:k) ()) DataPropertyAssertion(:age :x "3"^^xsd:integer) AnnotationAssertion(:c :x "é"@en) SubClassOf(:A DataSomeValuesFrom(:age DatatypeRestriction(xsd:integer xsd:minInclusive "18"^^xsd:integer))) DifferentIndividuals(:x :y :z))')
    assert len(axioms) == 8 and functional.parse(functional.write(axioms)) == axioms
    with pytest.raises(ParseError):
        functional.parse("Ontology(Nonsense(<u:a>))")


def test_manchester_prefix_and_infix_forms():
    assert manchester.parse_expression("(and A (or B C) (not D))", "u:") == ("and", "u:A", ("or", "u:B", "u:C"), ("not", "u:D"))
    assert manchester.parse_expression("inverse p some Self or p exactly 2 (A and B)", "u:")[0] == "or"
    assert manchester.parse_expression("age some integer[> 5, <= 9]", "u:") == ("dsome", "u:age", ("restriction", T.INTEGER, ("minExclusive", "5"), ("maxInclusive", "9")))
    with pytest.raises(ParseError):
        manchester.parse_expression("A and", "u:")


def test_imports_depth_cycle_missing(spark):
    head = "@prefix owl: <http://www.w3.org/2002/07/owl#> . "
    docs = {f"u:{i}": head + f"<u:{i}> owl:imports <u:{(i + 1) % 5}> . <u:s{i}> <u:p> <u:o> ." for i in range(5)}
    root = formats.load(spark, docs["u:0"], "turtle")
    whole = imports.Resolver([imports.registry(docs)]).resolve(root)
    assert whole.triples.where("p = 'u:p'").count() == 5
    with pytest.raises(imports.ImportError_):
        imports.Resolver([imports.registry(docs)], max_depth=2).resolve(root)
    del docs["u:3"]
    with pytest.raises(imports.ImportError_):
        imports.Resolver([imports.registry(docs)]).resolve(root)
    assert imports.Resolver([imports.registry(docs)], strict=False).resolve(root).triples.where("p = 'u:p'").count() == 3


def test_imports_are_kept_for_a_while(spark):
    asked = []
    source = lambda iri: asked.append(iri) or "<u:a> <u:p> <u:b> ."
    r = imports.Resolver([source])
    assert r.text("u:x") == r.text("u:x") and asked == ["u:x"]
    assert imports.Resolver([lambda _: None, source], ttl=0).text("u:y")


def test_events_through_xml_json_and_graph(spark, tmp_path):
    events = spark.createDataFrame([("1", "ObjectEvent", "2024-01-01T00:00:00Z", ["a", "b"], "ship & go", None, "ADD"), ("2", "AggregationEvent", "2024-01-02T00:00:00Z", ["a"], "pack", "ok", "OBSERVE")], epcis.EVENT)
    epcis.write_xml(events, str(tmp_path / "x"))
    assert got(epcis.read_xml(spark, str(tmp_path / "x"))) == got(events)
    epcis.write_json(events, str(tmp_path / "j"))
    assert got(epcis.read_json(spark, str(tmp_path / "j"))) == got(events)
    t = epcis.to_triples(events)
    assert t.where(f"p = '{epcis.E}hasEPC'").count() == 3 and t.where(f"o = '{epcis.E}EPC'").count() == 2
    assert [r["previous_step"] for r in epcis.trace(events, "a").orderBy("position").collect()] == [None, "ship & go"]
    assert [r["epc"] for r in epcis.all_epcs(events).collect()] == ["a", "b"]


def test_generated_events_do_not_depend_on_partitions(spark):
    a = epcis.generate(spark, 50)
    assert got(a) == got(epcis.generate(spark, 50).repartition(7)) and a.count() == 50


def test_lists_read_back(spark):
    rows = [("u:l", i, f"i{i % 3}", "lit") for i in range(20)] + [("u:m", 0, "u:x", "iri")]
    items = spark.createDataFrame(rows, "subject string, position long, item string, item_kind string")
    back = C.read_lists(C.list_triples(items, "u:has"), "u:has").orderBy("subject", "position")
    assert [(r["subject"], r["position"], r["item"]) for r in back.collect()] == [("u:l", i + 1, f"i{i % 3}") for i in range(20)] + [("u:m", 1, "u:x")]


def test_data_ranges(spark):
    t = spark.createDataFrame([("a", "p", "5", "lit", T.INTEGER, None), ("b", "p", "x", "lit", T.STRING, None), ("c", "p", "15", "lit", T.INTEGER, None)], T.TRIPLE)
    g = KnowledgeGraph(spark, t)
    who = lambda r: [x["x"] for x in X.members(g, ("dsome", "p", r)).orderBy("x").collect()]
    assert who(("restriction", T.INTEGER, ("minInclusive", "10"))) == ["c"]
    assert who(("or", T.STRING, ("restriction", T.INTEGER, ("maxExclusive", "6")))) == ["a", "b"]
    assert who(("not", T.INTEGER)) == ["b"] and who(("one", ("x", T.STRING, None))) == ["b"]


def test_profiles_choose_the_first_that_fits(spark):
    assert P.most_restrictive(KnowledgeGraph(spark, axioms=[("SubClassOf", "A", ("some", "p", "B"))])) == "EL"
    assert P.most_restrictive(KnowledgeGraph(spark, axioms=[("SubClassOf", "A", ("only", "p", "B"))])) == "QL"
    assert P.most_restrictive(KnowledgeGraph(spark, axioms=[("SubClassOf", "A", ("max", 1, "p"))])) == "RL"
    assert P.most_restrictive(KnowledgeGraph(spark, axioms=[("SubClassOf", "A", ("not", ("max", 1, "p")))])) is None


def test_entry_and_contract(spark):
    assert __spark_entry__.entry(spark).columns == ["o", "c", "n", "r"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["J1_bgp_chain", "J8_optional", "A3_group_by", "K3_list_triples", "R19_inherited_types", "R43_disjoint_clash", "S16_epcis_triples"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, sf)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    mine = sorted(tuple(show(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = con.sql(__spark_entry__.oracle_sql()[name])
    at = [list(sql.columns).index(c) for c in sorted(df.columns)]
    assert mine == sorted(tuple(show(r[i]) for i in at) for r in sql.fetchall())


def test_streamed_counts_match_batch(spark):
    names = ["ST_streamed_counts", "ST_streamed_types"]
    assert all(__spark_entry__.queries()[n](spark, "/root/testdata/sf0.001").count() > 0 for n in names)

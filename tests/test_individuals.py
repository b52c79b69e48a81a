"""Individuals under class expressions, exact cardinalities, and loops that run to their end."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ontoweave.functions import terms as T
from ontoweave.model import KnowledgeGraph
from ontoweave.plans import reason as R
from ontoweave.plans.abox import Told


def graph(spark, edges=(), types=(), literals=(), axioms=()):
    rows = [(s, T.TYPE, c, "iri", None, None) for s, c in types] + [(s, p, o, "iri", None, None) for s, p, o in edges] + [(s, p, o, "lit", dt, None) for s, p, o, dt in literals]
    return KnowledgeGraph(spark, spark.createDataFrame(rows, T.TRIPLE), list(axioms))


INCONSISTENT = {
    "complement": dict(types=[("b", "C")], axioms=[("ClassAssertion", ("not", "C"), "b")]),
    "complement of a class above": dict(types=[("b", "D")], axioms=[("SubClassOf", "D", "C"), ("ClassAssertion", ("not", "C"), "b")]),
    "universal": dict(types=[("a", "C"), ("b", "D")], edges=[("a", "p", "b")], axioms=[("SubClassOf", "C", ("only", "p", "E")), ("DisjointClasses", "D", "E")]),
    "universal complement": dict(types=[("a", "C"), ("b", "D")], edges=[("a", "p", "b")], axioms=[("SubClassOf", "C", ("only", "p", ("not", "D")))]),
    "max": dict(types=[("a", "C")], edges=[("a", "p", "x"), ("a", "p", "y")], axioms=[("SubClassOf", "C", ("max", 1, "p")), ("DifferentIndividuals", "x", "y")]),
    "functional data property": dict(literals=[("a", "q", "1", T.INTEGER), ("a", "q", "2", T.INTEGER)], axioms=[("FunctionalDataProperty", "q")]),
    "value": dict(types=[("a", "C"), ("b", "D")], axioms=[("SubClassOf", "C", ("value", "p", "b")), ("ObjectPropertyRange", "p", "E"), ("DisjointClasses", "D", "E")]),
    "last disjunct": dict(types=[("a", "C"), ("a", "D")], axioms=[("SubClassOf", "C", ("or", "E", "F")), ("DisjointClasses", "D", "E"), ("DisjointClasses", "D", "F")]),
    "inverse universal": dict(types=[("b", "C"), ("a", "D")], edges=[("a", "p", "b")], axioms=[("SubClassOf", "C", ("only", ("inverse", "p"), "E")), ("DisjointClasses", "D", "E")]),
    "complex left side": dict(types=[("b", "D"), ("a", "E")], edges=[("a", "p", "b")], axioms=[("SubClassOf", ("some", "p", "D"), "C"), ("DisjointClasses", "C", "E")]),
}
CONSISTENT = {
    "universal over what fits": dict(types=[("a", "C"), ("b", "E")], edges=[("a", "p", "b")], axioms=[("SubClassOf", "C", ("only", "p", "E")), ("DisjointClasses", "D", "E")]),
    "max of names that may be one": dict(types=[("a", "C")], edges=[("a", "p", "x"), ("a", "p", "y")], axioms=[("SubClassOf", "C", ("max", 1, "p"))]),
    "equal numbers": dict(literals=[("a", "q", "1", T.INTEGER), ("a", "q", "1.0", T.DECIMAL)], axioms=[("FunctionalDataProperty", "q")]),
    "a circle": dict(types=[("a", "C")], edges=[("a", "p", o) for o in "wxyz"], axioms=[("SubClassOf", "C", ("max", 2, "p")), *(("DifferentIndividuals", *p) for p in ("wx", "xy", "yz", "zw"))]),
    "open disjunction": dict(types=[("a", "C"), ("a", "D")], axioms=[("SubClassOf", "C", ("or", "E", "F")), ("DisjointClasses", "D", "E")]),
}


@pytest.mark.parametrize("name", INCONSISTENT)
def test_contradictions_are_seen(spark, name):
    assert not R.is_consistent(graph(spark, **INCONSISTENT[name]))


@pytest.mark.parametrize("name", CONSISTENT)
def test_consistent_graphs_stay(spark, name):
    assert R.clashes(graph(spark, **CONSISTENT[name])).collect() == []


def test_types_follow_universals_to_the_end(spark):
    g = graph(spark, [(f"n{i}", "p", f"n{i + 1}") for i in range(6)], [("n0", "C")], axioms=[("SubClassOf", "C", ("only", "p", "C"))])
    assert {r["x"] for r in Told(g).types.where("cls = 'C'").collect()} == {f"n{i}" for i in range(7)}


def test_what_if_with_complex_classes(spark):
    g = graph(spark, types=[("a", "C")])
    assert not R.would_be_consistent(g, ("ClassAssertion", ("not", "C"), "a")) and R.would_be_consistent(g, ("ClassAssertion", ("not", "D"), "a"))


def test_cliques_are_exact():
    r = random.Random(2)
    for _ in range(200):
        nodes = range(r.randint(2, 8))
        pairs = [p for p in combinations(nodes, 2) if r.random() < 0.6]
        near = {v: {a if b == v else b for a, b in pairs if v in (a, b)} for v in nodes}
        for size in range(1, 6):
            want = any(all(b in near[a] for a, b in combinations(c, 2)) for c in combinations(nodes, size))
            assert R.has_clique(near, size) == want


def test_a_chain_axiom_reaches_the_end_of_a_long_path(spark):
    n = 200
    g = graph(spark, [("x", "at", "n0"), *((f"n{i}", "in", f"n{i + 1}") for i in range(n))], axioms=[("SubPropertyChainOf", ("at", "in"), "at")])
    assert R.property_edges(g).where("p = 'at'").count() == n + 1


def test_edges_match_a_naive_fixpoint(spark):
    r = random.Random(9)
    names = [f"n{i}" for i in range(14)]
    edges = {(r.choice(names), r.choice("pqrt"), r.choice(names)) for _ in range(30)}
    axioms = [("SubObjectPropertyOf", "p", "q"), ("InverseObjectProperties", "q", "i"), ("SymmetricObjectProperty", "r"), ("TransitiveObjectProperty", "t"), ("SubPropertyChainOf", ("p", "r", "t"), "u"), ("SubPropertyChainOf", ("u", "t"), "u"), ("SubPropertyChainOf", ("p", "u"), "u"), ("SubObjectPropertyOf", "u", "t")]
    known = set(edges)
    while True:
        new = {(s, "q", o) for s, p, o in known if p == "p"} | {(s, "t", o) for s, p, o in known if p == "u"} | {(o, "i", s) for s, p, o in known if p == "q"} | {(o, "q", s) for s, p, o in known if p == "i"} | {(o, "r", s) for s, p, o in known if p == "r"}
        for chain, sup in ((("t", "t"), "t"), (("p", "r", "t"), "u"), (("u", "t"), "u"), (("p", "u"), "u")):
            ends = {(s, o) for s, p, o in known if p == chain[0]}
            for step in chain[1:]:
                ends = {(s, o) for s, m in ends for x, p, o in known if x == m and p == step}
            new |= {(s, sup, o) for s, o in ends}
        if new <= known:
            break
        known |= new
    assert {tuple(x) for x in R.property_edges(graph(spark, edges, axioms=axioms)).collect()} == known


def test_merges_cascade_to_the_end(spark):
    """Every merge makes the next one possible."""
    n = 25
    edges = [("a0", "f", "b0"), ("a0", "f", "c0")] + [(f"{x}{i}", "f", f"{x}{i + 1}") for x in "bc" for i in range(n)]
    got = R.materialize_graph(graph(spark, edges, axioms=[("FunctionalObjectProperty", "f")]))
    assert got.triples.where("p = 'f'").count() == n + 1 and got.triples.where(F.col("o").startswith("c")).count() == 0


@pytest.mark.parametrize("where, want", [
    ("?x :p ?y MINUS { ?x :p ?y OPTIONAL { ?x :q ?z } }", []),
    ("?x :p ?y OPTIONAL { ?x :q ?z } MINUS { ?w :r ?v OPTIONAL { ?w :none ?z } }", ["u:a", "u:b"]),
    ("?x :p ?y OPTIONAL { ?x :q ?z } MINUS { ?w :r ?z }", ["u:b"]),
    ("?x :p ?y FILTER EXISTS { ?w :p ?v FILTER(?v != ?y) }", ["u:a", "u:b"]),
    ("?x :p ?y FILTER NOT EXISTS { ?x :name ?n FILTER(?n = 'one'@en && ?y = :c) }", ["u:b"]),
    ("?x :name ?n MINUS { ?w :label ?n }", ["u:a"]),
    ("?x :p ?y OPTIONAL { ?x :q ?z } FILTER EXISTS { ?w :r ?z }", ["u:a", "u:b"]),
])
def test_minus_and_exists(spark, where, want):
    rows = [("u:a", "u:p", "u:c", "iri", None, None), ("u:b", "u:p", "u:d", "iri", None, None), ("u:a", "u:q", "u:z", "iri", None, None), ("u:e", "u:r", "u:z", "iri", None, None), ("u:a", "u:name", "one", "lit", T.LANG_STRING, "en"), ("u:e", "u:label", "one", "lit", T.LANG_STRING, "fr")]
    g = KnowledgeGraph(spark, spark.createDataFrame(rows, T.TRIPLE))
    assert sorted(r["x"] for r in g.query(f"SELECT ?x WHERE {{ {where} }}", {"": "u:"}).collect()) == want


def test_aggregates_over_terms(spark):
    rows = [("u:a", "u:name", "x", "lit", T.LANG_STRING, "en"), ("u:a", "u:name", "x", "lit", T.LANG_STRING, "fr"), ("u:a", "u:name", "b", "lit", T.STRING, None), ("u:a", "u:n", "10", "lit", T.INTEGER, None), ("u:a", "u:n", "9", "lit", T.INTEGER, None), ("u:a", "u:on", "2024-02-03T00:00:00", "lit", T.DATETIME, None), ("u:a", "u:on", "2023-02-03T00:00:00", "lit", T.DATETIME, None)]
    g = KnowledgeGraph(spark, spark.createDataFrame(rows, T.TRIPLE))
    one = lambda select, where: tuple(g.query(f"SELECT {select} WHERE {{ {where} }}", {"": "u:"}).first())
    assert one("(COUNT(DISTINCT ?o) AS ?n) (MIN(?o) AS ?a) (MAX(?o) AS ?z) (SAMPLE(?o) AS ?s)", "?x :name ?o") == (3, "b", "x", "b")
    assert one("(MIN(?o) AS ?a) (MAX(?o) AS ?z) (SUM(?o) AS ?s)", "?x :n ?o") == ("9", "10", 19.0)
    assert one("(MIN(?o) AS ?a)", "?x :on ?o") == ("2023-02-03T00:00:00",)
    assert one('(GROUP_CONCAT(?o; SEPARATOR=", ") AS ?a) (GROUP_CONCAT(DISTINCT ?o) AS ?b)', "?x :name ?o") == ("b, x, x", "b x")

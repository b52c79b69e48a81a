"""Closures, components, rules, equality, clashes and the tableau, against plain Python."""

import random

import pytest

from ontoweave.functions import terms as T
from ontoweave.model import KnowledgeGraph
from ontoweave.plans import expressions as X
from ontoweave.plans import reason as R
from ontoweave.plans import rules as RU
from ontoweave.plans.closure import closure, closure_of
from ontoweave.plans.components import components
from ontoweave.plans.tableau import Tableau, Undecided
from ontoweave.queries import mini


def pairs(df):
    return sorted(map(tuple, df.collect()))


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    groups = {}
    for x in up:
        groups.setdefault(find(x), set()).add(x)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("edges,size", [([("a", "b"), ("b", "c"), ("c", "d")], 6), ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], 12), ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], 5), ([], 0)])
def test_closure_both_ways(spark, edges, size):
    df = spark.createDataFrame(edges, "s string, o string")
    small, large = pairs(closure(df, "s", "o")), pairs(closure(df, "s", "o", driver_edges=0))
    assert small == large == closure_of(edges) and len(small) == size


def test_closure_is_idempotent(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "s long, o long")
    once = closure(edges, "s", "o", driver_edges=0)
    assert pairs(closure(once, "s", "o")) == pairs(once)


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 500 + i) for i in range(25)]
    got = {}
    for r_ in components(spark.createDataFrame(edges, "u long, v long")).collect():
        got.setdefault(r_["component"], set()).add(r_["node"])
    assert sorted(sorted(g) for g in got.values()) == union_find([e for e in edges if e[0] != e[1]])


def test_components_of_nothing(spark):
    assert pairs(components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long"))) == []


def test_rule_order_does_not_matter(spark):
    facts = [("p", T.TYPE, T.OWL + "TransitiveProperty"), ("a", "p", "b"), ("b", "p", "c"), ("p", T.SUBPROP, "q"), ("q", T.DOMAIN, "C"), ("C", T.SUBCLASS, "E")]
    t = spark.createDataFrame([(*f, "iri", None, None) for f in facts], T.TRIPLE)
    one, other = RU.saturate(t), RU.saturate(t, RU.RULES[::-1])
    assert pairs(one.select("s", "p", "o")) == pairs(other.select("s", "p", "o"))
    assert ("a", T.TYPE, "E") in pairs(one.select("s", "p", "o"))


def test_equality_is_rewritten_everywhere(spark):
    g = mini(spark, [("a", "likes", "x"), ("b", "owns", "y")], [("b", "C")], [("b", "age", "5", T.INTEGER)], [("SameIndividual", "a", "b")])
    out = g.materialized().triples.select("s", "p", "o")
    assert pairs(out) == [("a", "age", "5"), ("a", T.TYPE, "C"), ("a", "likes", "x"), ("a", "owns", "y")]


def test_functional_values_merge_to_a_fixpoint(spark):
    g = mini(spark, [("a", "f", "b"), ("a", "f", "c"), ("b", "f", "d"), ("c", "f", "e")], axioms=[("FunctionalObjectProperty", "f")])
    assert pairs(g.materialized().triples.select("s", "p", "o")) == [("a", "f", "b"), ("b", "f", "d")]


def test_materialising_twice_adds_nothing(spark):
    g = mini(spark, [("a", "p", "b"), ("b", "p", "c")], [("a", "C")], axioms=[("TransitiveObjectProperty", "p"), ("SubClassOf", "C", "D"), ("ObjectPropertyRange", "p", "C")])
    once = g.materialized()
    assert pairs(once.triples.select("s", "p", "o")) == pairs(once.materialized().triples.select("s", "p", "o"))


def test_same_and_different_clash(spark):
    g = mini(spark, axioms=[("SameIndividual", "a", "b"), ("SameIndividual", "b", "c"), ("DifferentIndividuals", "a", "c")])
    assert [(r["kind"], r["subject"], r["detail"]) for r in R.clashes(g).collect()] == [("same_and_different", "a", "c")]


def test_each_kind_of_clash(spark):
    axioms = [("IrreflexiveObjectProperty", "i"), ("AsymmetricObjectProperty", "s"), ("NegativeObjectPropertyAssertion", "n", "a", "b"), ("ObjectMaxCardinality", 1, "m"), ("DifferentIndividuals", "b", "c"), ("DisjointObjectProperties", "d", "e"), ("SubClassOf", "V", T.NOTHING)]
    g = mini(spark, [("a", "i", "a"), ("a", "s", "b"), ("b", "s", "a"), ("a", "n", "b"), ("a", "m", "b"), ("a", "m", "c"), ("a", "d", "b"), ("a", "e", "b")], [("x", "V")], axioms=axioms)
    assert {r["kind"] for r in R.clashes(g).collect()} == {"irreflexive", "asymmetric", "negative_assertion", "max_cardinality", "disjoint_properties", "nothing", "unsatisfiable_class"}


def test_an_empty_graph_is_consistent(spark):
    assert R.is_consistent(KnowledgeGraph(spark))


def test_the_world_is_open(spark):
    g = mini(spark, [("a", "p", "b")], [("b", "C")], axioms=[("DisjointClasses", "C", "D")])
    assert pairs(X.members(g, ("not", "D"))) == [("b",)]
    assert pairs(X.members(g, ("not", "E"))) == []
    assert pairs(X.members(g, ("only", "p", "C"))) == []
    assert pairs(X.members(g, ("min", 2, "p"))) == []


def test_normal_forms():
    e = ("not", ("and", "A", ("some", "p", ("not", "B"))))
    assert X.nnf(e) == ("or", ("not", "A"), ("only", "p", "B"))
    assert X.simplify(("and", ("or", "A"))) in (("or", "A"), "A")
    assert X.nnf(("not", ("exact", 2, "p"))) == ("or", ("max", 1, "p"), ("min", 3, "p"))


def test_tableau():
    t = Tableau([("SubClassOf", "A", ("some", "r", "B")), ("SubClassOf", ("some", "r", "B"), "C"), ("ObjectPropertyDomain", "r", "D"), ("FunctionalObjectProperty", "f")])
    assert t.subsumes("C", "A") and t.subsumes("D", "A") and not t.subsumes("A", "C")
    assert not t.is_satisfiable(("and", ("some", "f", "X"), ("some", "f", ("not", "X"))))
    assert t.is_satisfiable(("and", ("some", "f", "X"), ("some", "f", "Y")))
    assert not t.is_satisfiable(("and", "B", ("some", ("inverse", "r"), ("only", "r", ("not", "B")))))
    with pytest.raises(Undecided):
        Tableau([("SubClassOf", "A", ("some", "r", "A"))], limit=1).is_satisfiable("A")


def test_hierarchy_with_a_cycle(spark):
    g = KnowledgeGraph(spark, axioms=[("SubClassOf", "A", "B"), ("SubClassOf", "B", "A"), ("SubClassOf", "B", "C")])
    assert pairs(R.equivalent_classes(g)) == [("A", "B")]
    assert R.is_consistent(g)


def test_axioms_inside_triples(spark):
    rows = [("A", T.SUBCLASS, "B"), ("x", T.TYPE, "A"), ("p", T.TYPE, T.OWL + "SymmetricProperty"), ("x", "p", "y")]
    g = KnowledgeGraph(spark, spark.createDataFrame([(*r, "iri", None, None) for r in rows], T.TRIPLE), axioms_in_triples=True)
    assert ("x", "B") in pairs(R.inherited_types(g))
    assert ("y", "p", "x") in pairs(R.property_edges(g).select("s", "p", "o"))

"""Patterns, joins, filters and aggregates on graphs small enough to spell the answers out."""

import pytest

from ontoweave.functions import terms as T
from ontoweave.model import KnowledgeGraph
from ontoweave.plans import sparql


def graph(spark, *triples):
    rows = []
    for s, p, o in triples:
        if isinstance(o, tuple):
            rows.append((s, p, o[0], "lit", o[1], o[2] if len(o) > 2 else None))
        else:
            rows.append((s, p, o, "bnode" if o.startswith("_:") else "iri", None, None))
    return KnowledgeGraph(spark, spark.createDataFrame(rows, T.TRIPLE))


def rows(g, where, select="*", tail=""):
    return sorted((tuple(r) for r in g.query(f"SELECT {select} WHERE {{ {where} }} {tail}", {"": "u:"}).collect()), key=str)


def n(x):
    return (str(x), T.INTEGER)


@pytest.fixture(scope="module")
def people(spark):
    return graph(spark, ("u:a", "u:knows", "u:b"), ("u:b", "u:knows", "u:c"), ("u:c", "u:knows", "u:a"), ("u:a", "u:age", n(30)), ("u:b", "u:age", n(4)), ("u:c", "u:age", ("x", T.STRING)), ("u:a", "u:name", ("Al", T.LANG_STRING, "en")), ("u:d", "u:knows", "_:x"), ("u:d", T.TYPE, "u:P"))


def test_bgp_joins_on_shared_variables(people):
    assert rows(people, "?x :knows ?y . ?y :knows ?z", "?x ?z") == [("u:a", "u:c"), ("u:b", "u:a"), ("u:c", "u:b")]


def test_product_without_shared_variables(people):
    assert len(rows(people, "?x :age ?n . ?y a :P")) == 3


def test_optional_keeps_every_left_row(people):
    assert rows(people, "?x :knows ?y OPTIONAL { ?y :age ?n FILTER(?n > 10) }", "?x ?n") == [("u:a", None), ("u:b", None), ("u:c", "30"), ("u:d", None)]


def test_unbound_joins_with_anything(spark):
    g = graph(spark, ("u:1", "u:k", "u:k"), ("u:2", "u:k", "u:k"), ("u:1", "u:r", "u:p"), ("u:p", "u:t", "u:p"), ("u:q", "u:t", "u:q"))
    assert rows(g, "{ ?x :k ?k OPTIONAL { ?x :r ?y } } { ?y :t ?y }", "?x ?y") == [("u:1", "u:p"), ("u:2", "u:p"), ("u:2", "u:q")]


def test_optional_over_unbound(spark):
    g = graph(spark, ("u:1", "u:k", "u:k"), ("u:2", "u:k", "u:k"), ("u:1", "u:r", "u:p"), ("u:q", "u:t", "u:z"))
    assert rows(g, "?x :k ?k OPTIONAL { ?x :r ?y } OPTIONAL { ?y :t ?z }", "?x ?y ?z") == [("u:1", "u:p", None), ("u:2", "u:q", "u:z")]


def test_union_is_a_bag_with_ragged_variables(people):
    assert rows(people, "{ ?x :age ?n } UNION { ?x a ?c } UNION { ?x a ?c }", "?x ?c") == [("u:a", None), ("u:b", None), ("u:c", None), ("u:d", "u:P"), ("u:d", "u:P")]


def test_numbers_compare_as_numbers_and_other_types_drop_out(people):
    assert rows(people, "?x :age ?n FILTER(?n > 5)", "?x") == [("u:a",)]
    assert rows(people, "?x :age ?n FILTER(?n = 4.0)", "?x") == [("u:b",)]


def test_not_of_an_error_is_an_error(people):
    assert rows(people, "?x :age ?n FILTER(!(?n > 5))", "?x") == [("u:b",)]


def test_kind_tests_and_language(people):
    assert rows(people, "?x ?p ?o FILTER isBlank(?o)", "?x") == [("u:d",)]
    assert rows(people, '?x :name ?o FILTER(LANG(?o) = "en")', "?x") == [("u:a",)]
    assert rows(people, '?x :name "Al"@en', "?x") == [("u:a",)]
    assert rows(people, '?x :name "Al"', "?x") == []


def test_a_literal_never_joins_a_resource(spark):
    g = graph(spark, ("u:a", "u:p", ("u:b", T.STRING)), ("u:a", "u:p", "u:b"), ("u:b", "u:q", "u:c"))
    assert rows(g, "?x :p ?y . ?y :q ?z", "?x ?z") == [("u:a", "u:c")]


def test_literals_join_as_terms(spark):
    g = graph(spark, ("u:a", "u:p", n(1)), ("u:b", "u:q", n(1)), ("u:c", "u:q", ("1", T.STRING)), ("u:d", "u:q", n("01")))
    assert rows(g, "?x :p ?v . ?y :q ?v", "?y") == [("u:b",)]


def test_distinct_order_slice(people):
    assert [tuple(r) for r in people.query("SELECT ?x WHERE { ?x :knows ?y } ORDER BY DESC(?x) LIMIT 2 OFFSET 1", {"": "u:"}).collect()] == [("u:c",), ("u:b",)]
    assert rows(people, "?x ?p ?o", "DISTINCT ?x") == [("u:a",), ("u:b",), ("u:c",), ("u:d",)]


def test_aggregates_and_having(people):
    assert rows(people, "?x ?p ?o", "?x (COUNT(?o) AS ?n)", "GROUP BY ?x HAVING(COUNT(?o) > 2)") == [("u:a", 3)]
    assert rows(people, "?x :age ?n", "(SUM(?n) AS ?s) (COUNT(DISTINCT ?n) AS ?c)") == [(34.0, 3)]


def test_exists_minus_values_bind(people):
    assert rows(people, "?x :knows ?y FILTER NOT EXISTS { ?x :age ?n }", "?x") == [("u:d",)]
    assert rows(people, "?x :knows ?y MINUS { ?x :age ?n }", "?x") == [("u:d",)]
    assert rows(people, "VALUES ?x { :a :b } ?x :age ?n BIND(?n * 2 AS ?m)", "?x ?m") == [("u:a", "60.0"), ("u:b", "8.0")]


def test_paths(people):
    assert rows(people, ":a :knows+ ?y") == [("u:a",), ("u:b",), ("u:c",)]
    assert rows(people, ":a :knows/:knows ?y") == [("u:c",)]
    assert rows(people, "?y ^:knows :a") == [("u:b",)]
    assert rows(people, ":a (:knows|:age) ?y") == [("30",), ("u:b",)]


def test_closure_path_reaches_literals_once(spark):
    g = graph(spark, ("u:a", "u:p", "u:b"), ("u:b", "u:p", ("end", T.STRING)))
    assert rows(g, ":a :p+ ?y") == [("end",), ("u:b",)]


def test_empty_graph(spark):
    g = KnowledgeGraph(spark)
    assert rows(g, "?x ?p ?o") == [] and rows(g, "?x ?p ?o OPTIONAL { ?o ?q ?z }") == []


def test_ill_formed_queries_say_why():
    assert sparql.check("SELECT ?x WHERE { ?x a }")
    with pytest.raises(sparql.SparqlError):
        sparql.parse("SELECT ?x WHERE { ?x ; }")


def test_other_tables_are_pruned(spark):
    from ontoweave.queries import PREFIX
    from ontoweave.queries import graph as mapped

    plan = mapped(spark, "/root/testdata/sf0.001").explain("SELECT ?n WHERE { ?n v:inRegion ?r }", PREFIX)
    assert "nation.parquet" in plan and "lineitem.parquet" not in plan and "n_name" not in plan.split("ReadSchema")[1].splitlines()[0]

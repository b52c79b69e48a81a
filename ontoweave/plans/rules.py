"""Forward chaining with rules over triple patterns, semi-naive."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.functions import terms as T
from ontoweave.plans import algebra as A
from ontoweave.plans.compile import Compiler, cols
from ontoweave.plans.sparql import Parser
from ontoweave.plans.storage import discard, materialize


@dataclass(frozen=True)
class Rule:
    """If all patterns of ``body`` match, the patterns of ``head`` hold."""

    name: str
    body: tuple[A.Pattern, ...]
    head: tuple[A.Pattern, ...]


def rule(name: str, text: str, prefixes: dict[str, str] | None = None) -> Rule:
    """A rule from ``{ body } => { head }`` in triple notation."""
    body, head = text.split("=>")
    read = lambda t: Parser(t.strip(), prefixes).group().patterns
    return Rule(name, read(body), read(head))


_OWL = {"rdfs": T.RDFS, "owl": T.OWL, "rdf": T.RDF}
#: Rules over vocabulary that is itself in the triples.
RULES = (
    rule("transitive_property", "{ ?p a owl:TransitiveProperty . ?x ?p ?y . ?y ?p ?z } => { ?x ?p ?z }", _OWL),
    rule("subclass_transitivity", "{ ?a rdfs:subClassOf ?b . ?b rdfs:subClassOf ?c } => { ?a rdfs:subClassOf ?c }", _OWL),
    rule("class_inheritance", "{ ?c rdfs:subClassOf ?d . ?x a ?c } => { ?x a ?d }", _OWL),
    rule("symmetric_property", "{ ?p a owl:SymmetricProperty . ?x ?p ?y } => { ?y ?p ?x }", _OWL),
    rule("domain", "{ ?p rdfs:domain ?c . ?x ?p ?y } => { ?x a ?c }", _OWL),
    rule("range", "{ ?p rdfs:range ?c . ?x ?p ?y } => { ?y a ?c }", _OWL),
    rule("subproperty", "{ ?p rdfs:subPropertyOf ?q . ?x ?p ?y } => { ?x ?q ?y }", _OWL),
    rule("inverse", "{ ?p owl:inverseOf ?q . ?x ?p ?y } => { ?y ?q ?x }", _OWL),
    rule("inverse_back", "{ ?p owl:inverseOf ?q . ?x ?q ?y } => { ?y ?p ?x }", _OWL),
)


def _heads(r: Rule, df: DataFrame) -> DataFrame:
    out = None
    none = F.lit(None).cast("string")
    for h in r.head:
        def part(t, place):
            if isinstance(t, A.Var):
                return [F.col(c) for c in cols(t.name)]
            return [F.lit(t.value), F.lit("iri" if isinstance(t, A.Iri) else "lit"), F.lit(t.datatype) if isinstance(t, A.Lit) else none, F.lit(t.lang).cast("string") if isinstance(t, A.Lit) else none]

        s, p, o = part(h.s, "s"), part(h.p, "p"), part(h.o, "o")
        one = df.where(s[1] != "lit").select(s[0].alias("s"), p[0].alias("p"), o[0].alias("o"), o[1].alias("o_kind"), o[2].alias("o_dt"), o[3].alias("o_lang"))
        out = one if out is None else out.unionByName(one)
    return out


_KEY = ["s", "p", "o", "o_kind"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.select("*", F.coalesce("o_dt", F.lit("")).alias("_t"), F.coalesce("o_lang", F.lit("")).alias("_g"))


def saturate(triples: DataFrame, rules=RULES) -> DataFrame:
    """All triples that the rules derive, with those given.

    Each round a rule fires only on matches in which at least one pattern is met by a triple that the
    round before added; rounds go on until nothing is new. Rules make no new terms, so that ends. The
    result is a set and does not depend on the order of the rules.
    """
    known = new = materialize(triples.distinct(), "facts")
    held = [known]  # tables that make up what is known; nothing is written twice, but for short plans now and then
    while not new.isEmpty():
        found = None
        everything, fresh = Compiler(known), Compiler(new)
        for r in rules:
            for i in range(len(r.body)):
                s = fresh.pattern(r.body[i])
                for j, p in enumerate(r.body):
                    if j != i:
                        s = everything.join(s, everything.pattern(p))
                one = _heads(r, s.df)
                found = one if found is None else found.unionByName(one)
        if found is None:
            break
        step = _keyed(found).dropDuplicates([*_KEY, "_t", "_g"]).join(_keyed(known).select(*_KEY, "_t", "_g"), [*_KEY, "_t", "_g"], "left_anti")
        new = materialize(step.select(*triples.columns), "facts-new")
        held.append(new)
        if len(held) > 8:
            whole = materialize(reduce(lambda a, b: a.unionByName(b), held), "facts")
            for t in held[:-1]:
                discard(t)
            held = [whole]
        known = reduce(lambda a, b: a.unionByName(b), held)
    return known

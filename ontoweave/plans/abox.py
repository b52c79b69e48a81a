"""Named individuals under class expressions: what complex inclusions say of them, and where they clash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.functions import terms as T
from ontoweave.plans import reason
from ontoweave.plans.expressions import in_range, members, negate, nnf, role, simplify
from ontoweave.plans.storage import materialize


def inclusions(axioms: list[tuple]) -> list[tuple]:
    """``(left, right)`` with a complex side: right sides in negation normal form, one conjunct each.

    An asserted complex class has its individual as a nominal on the left; a domain or range has the
    individuals with such an edge.
    """
    out = []

    def add(left, right):
        right = nnf(simplify(right))
        if isinstance(right, tuple) and right[0] == "and":
            for part in right[1:]:
                add(left, part)
        elif isinstance(left, tuple) or isinstance(right, tuple):
            out.append((left, right))

    for kind, *args in axioms:
        if kind == "SubClassOf":
            add(*args)
        elif kind == "EquivalentClasses":
            for a in args:
                for b in args:
                    if a != b:
                        add(a, b)
        elif kind == "DisjointClasses":
            for i, a in enumerate(args):
                for b in args[i + 1 :]:
                    if isinstance(a, tuple) or isinstance(b, tuple):
                        add(a, ("not", b))
        elif kind == "ClassAssertion" and isinstance(args[0], tuple):
            add(("one", args[1]), args[0])
        elif kind == "ObjectPropertyDomain" and isinstance(args[1], tuple):
            add(("some", args[0], T.THING), args[1])
        elif kind == "ObjectPropertyRange" and isinstance(args[1], tuple):
            add(("some", ("inverse", args[0]), T.THING), args[1])
    return list(dict.fromkeys(out))


def steps(edges: DataFrame, p) -> DataFrame:
    """``(s, o)`` along a property or its inverse."""
    p = role(p)
    if isinstance(p, str):
        return edges.where(F.col("p") == p).select("s", "o")
    return edges.where(F.col("p") == p[1]).select(F.col("o").alias("s"), F.col("s").alias("o"))


def all_types(kg, edges: DataFrame) -> DataFrame:
    """``(x, cls)`` asserted, from domains and ranges, and inherited."""
    types = kg.types().unionByName(reason.domain_range_types(kg, edges)).distinct()
    up = types.join(kg.class_closure().select(F.col("sub").alias("cls"), "sup"), "cls").select("x", F.col("sup").alias("cls"))
    return materialize(types.unionByName(up).distinct(), "types")


class Told:
    """Edges and types of named individuals, closed under all inclusions; ``denied`` has classes they are known not to be in.

    A universal restriction types all successors, ``value`` makes the edge, of a disjunction the one
    part that is not excluded holds. Nothing is made up: an existential makes no anonymous witness.
    Rounds go on until nothing is new; types and edges are over the given names, so they end.
    """

    def __init__(self, kg):
        from ontoweave.model import KnowledgeGraph

        self.kg, self.rules = kg, inclusions(kg.axioms)
        while True:
            self.edges = reason.property_edges(self.kg)
            self.types = all_types(self.kg, self.edges)
            self.denied = self._denied()
            if not self.rules:
                return
            types, edges = [], []
            for left, right in self.rules:
                self._follow(self.of(left), right, types, edges)
            new = []
            if types:
                new.append(_union(types).join(self.types, ["x", "cls"], "left_anti").distinct().select(F.col("x").alias("s"), F.lit(T.TYPE).alias("p"), F.col("cls").alias("o")))
            if edges:
                new.append(_union(edges).join(self.edges, ["s", "p", "o"], "left_anti").distinct().select("s", "p", "o"))
            if not new:
                return
            none = F.lit(None).cast("string")
            fresh = materialize(_union(new).select("s", "p", "o", F.when(F.col("o").startswith("_:"), "bnode").otherwise("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang")), "told")
            if fresh.isEmpty():
                return
            self.kg = KnowledgeGraph(kg.spark, self.kg.triples.unionByName(fresh), kg.axioms, kg.axioms_in_triples)

    def of(self, e) -> DataFrame:
        """``(x)``: individuals known to be in ``e``."""
        return members(self.kg, e, self.edges, self.types)

    def outside(self, e) -> DataFrame:
        """``(x)``: individuals known not to be in ``e``."""
        known = self.of(negate(e))
        if isinstance(e, str):
            known = known.union(self.denied.where(F.col("cls") == e).select("x"))
        return known.distinct()

    def _denied(self) -> DataFrame:
        """``(x, cls)`` by complements on a right side, for the classes below as well."""
        parts = [self.of(left).select("x", F.lit(right[1]).alias("cls")) for left, right in self.rules if right[0] == "not" and isinstance(right, tuple) and isinstance(right[1], str)]
        if not parts:
            return self.kg.spark.createDataFrame([], "x string, cls string")
        d = _union(parts)
        down = d.join(self.kg.class_closure().select(F.col("sup").alias("cls"), "sub"), "cls").select("x", F.col("sub").alias("cls"))
        return materialize(d.union(down).distinct(), "denied")

    def _follow(self, xs: DataFrame, e, types: list, edges: list) -> None:
        if isinstance(e, str):
            if e != T.THING:
                types.append(xs.select("x", F.lit(e).alias("cls")))
            return
        match e:
            case ("and", *parts):
                for part in parts:
                    self._follow(xs, part, types, edges)
            case ("only", p, filler):
                reached = steps(self.edges, p).join(xs.select(F.col("x").alias("s")), "s", "left_semi").select(F.col("o").alias("x")).distinct()
                self._follow(reached, filler, types, edges)
            case ("some", p, ("one", a)):
                p = role(p)
                s, o, p = (F.col("x"), F.lit(a), p) if isinstance(p, str) else (F.lit(a), F.col("x"), p[1])
                edges.append(xs.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o")))
            case ("or", *parts):
                for part in parts:
                    rest = reduce(lambda d, other: d.join(self.outside(other), "x", "left_semi"), [q for q in parts if q != part], xs)
                    self._follow(rest, part, types, edges)

    def clashes(self) -> DataFrame:
        """``(kind, subject, detail)`` of complements, of too many successors that differ, and of literals outside a range."""
        kg, none = self.kg, self.kg.spark.createDataFrame([], "kind string, subject string, detail string")
        row = lambda d, kind, detail: d.select(F.lit(kind).alias("kind"), F.col("x").alias("subject"), detail.alias("detail"))
        parts = [none, row(self.denied.join(self.types, ["x", "cls"], "left_semi"), "complement", F.col("cls"))]
        different = kg.member_pairs("DifferentIndividuals")

        def judge(xs, e):
            match e:
                case ("only", p, filler) if not isinstance(filler, str):
                    judge(steps(self.edges, p).join(xs.select(F.col("x").alias("s")), "s", "left_semi").select(F.col("o").alias("x")).distinct(), filler)
                case ("only", p, filler):
                    reached = steps(self.edges, p).join(xs.select(F.col("x").alias("s")), "s", "left_semi").select(F.col("o").alias("x"))
                    parts.append(row(reached.join(self.outside(filler), "x", "left_semi").distinct(), "universal", F.lit(filler)))
                case ("not", inner):
                    parts.append(row(xs.join(self.of(inner), "x", "left_semi"), "complement", F.lit(inner if isinstance(inner, str) else str(inner))))
                case ("max", most, p, *filler):
                    e_ = steps(self.edges, p).join(xs.select(F.col("x").alias("s")), "s", "left_semi")
                    if filler and filler[0] != T.THING:
                        e_ = e_.join(self.of(filler[0]).select(F.col("x").alias("o")), "o", "left_semi")
                    parts.append(row(reason.with_apart(e_, different, most + 1).select(F.col("s").alias("x")), "max_cardinality", F.lit(f"{role(p)} {most}")))
                case ("dmax", most, p):
                    parts.append(row(literal_counts(kg, p).where(F.col("n") > most).join(xs, "x", "left_semi"), "max_cardinality", F.lit(f"{p} {most}")))
                case ("donly", p, r):
                    t = kg.triples.where((F.col("p") == p) & (F.col("o_kind") == "lit")).where(~in_range(r)).select(F.col("s").alias("x"), "o")
                    parts.append(row(t.join(xs, "x", "left_semi"), "data_range", F.concat_ws(" ", F.lit(p), "o")))

        for left, right in self.rules:
            judge(self.of(left), right)
        for prop in sorted({x[1] for x in kg.axioms if x[0] == "FunctionalDataProperty"}):
            parts.append(row(literal_counts(kg, prop).where("n > 1"), "functional_data", F.lit(prop)))
        return _union(parts).distinct()


def literal_counts(kg, prop: str) -> DataFrame:
    """``(x, n)``: values of a data property; numbers are equal by value, other literals as terms."""
    number = F.when(F.col("o_dt").isin(T.NUMERIC), F.col("o").try_cast("double"))
    value = F.when(number.isNotNull(), F.struct(number.cast("string").alias("v"), F.lit("").alias("t"), F.lit("").alias("g")))
    value = value.otherwise(F.struct(F.col("o").alias("v"), F.coalesce("o_dt", F.lit(T.STRING)).alias("t"), F.coalesce("o_lang", F.lit("")).alias("g")))
    return kg.triples.where((F.col("p") == prop) & (F.col("o_kind") == "lit")).groupBy(F.col("s").alias("x")).agg(F.countDistinct(value).alias("n"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)

"""Class expressions: their members among named individuals, their flat form, and data ranges.

An expression is a class IRI or a tuple: ``("and", e...)``, ``("or", e...)``, ``("not", e)``,
``("one", individual...)``, ``("some"|"only", property, e)``, ``("value", property, individual)``,
``("self", property)``, ``("min"|"max"|"exact", n, property[, e])``, ``("dsome"|"donly", property,
range)``, ``("dvalue", property, literal)``, ``("dmin"|"dmax"|"dexact", n, property)``. A property is an
IRI or ``("inverse", property)``. A data range is a datatype IRI or ``("restriction", datatype, (facet,
value)...)``, ``("and"|"or", range...)``, ``("not", range)``, ``("one", literal...)``; a literal is
``(lexical form, datatype, language)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.functions import terms as T
from ontoweave.plans import reason


def simplify(e):
    """One-operand conjunctions and disjunctions unwrapped, doubled negations and inverses removed."""
    if isinstance(e, str):
        return e
    match e:
        case ("and" | "or", only):
            return simplify(only)
        case ("not", ("not", inner)):
            return simplify(inner)
        case ("and" | "or" | "not" as op, *parts):
            return (op, *map(simplify, parts))
        case ("some" | "only" as op, prop, filler):
            return (op, role(prop), simplify(filler))
        case _:
            return e


def role(p):
    """A property without doubled inverses."""
    while isinstance(p, tuple) and isinstance(p[1], tuple):
        p = p[1][1]
    return p


def negate(e):
    """Negation normal form of the complement."""
    if e == T.THING:
        return T.NOTHING
    if e == T.NOTHING:
        return T.THING
    if isinstance(e, str):
        return ("not", e)
    match e:
        case ("not", inner):
            return nnf(inner)
        case ("and", *parts):
            return ("or", *map(negate, parts))
        case ("or", *parts):
            return ("and", *map(negate, parts))
        case ("some", p, f):
            return ("only", role(p), negate(f))
        case ("only", p, f):
            return ("some", role(p), negate(f))
        case ("min", 0, *_):
            return T.NOTHING
        case ("min", n, *rest):
            return ("max", n - 1, *rest)
        case ("max", n, *rest):
            return ("min", n + 1, *rest)
        case ("exact", 0, *rest):
            return ("min", 1, *rest)
        case ("exact", n, *rest):
            return ("or", ("max", n - 1, *rest), ("min", n + 1, *rest))
        case ("value", p, a):
            return ("only", role(p), ("not", ("one", a)))
        case _:
            return ("not", e)


def nnf(e):
    """Complements pushed down to names."""
    if isinstance(e, str):
        return e
    match e:
        case ("not", inner):
            return negate(inner)
        case ("and" | "or" as op, *parts):
            return (op, *map(nnf, parts))
        case ("some" | "only" as op, p, f):
            return (op, role(p), nnf(f))
        case ("min" | "max" as op, n, p, f):
            return (op, n, role(p), nnf(f))
        case ("exact", n, *rest):
            return ("and", nnf(("min", n, *rest)), nnf(("max", n, *rest)))
        case ("value", p, a):
            return ("some", role(p), ("one", a))
        case _:
            return e


def subexpressions(e) -> list:
    """The expression and all inside it."""
    out = [e]
    if not isinstance(e, str):
        for x in e[1:]:
            if isinstance(x, str) and e[0] in ("and", "or", "not"):
                out.append(x)
            elif isinstance(x, tuple) and x[0] in ("and", "or", "not", "one", "some", "only", "value", "self", "min", "max", "exact"):
                out += subexpressions(x)
            elif isinstance(x, str) and e[0] in ("some", "only") and x is e[2]:
                out.append(x)
    return out


def render(e) -> str:
    """Functional notation, for display and comparison."""
    if isinstance(e, tuple):
        return f"{e[0]}({' '.join(map(render, e[1:]))})"
    return str(e)


def flatten(spark, axioms: list[tuple]) -> DataFrame:
    """``expr_node``: one row per node of every expression of class axioms, with its axiom and side."""
    rows = []

    def walk(axiom_id, kind, side, e, parent, pos):
        me = len(rows)
        if isinstance(e, str):
            rows.append((me, parent, pos, axiom_id, kind, side, "class", e, None))
            return
        op, *args = e
        card = next((a for a in args if isinstance(a, int)), None)
        named = next((render(a) for a in args if isinstance(a, str)), None) if op not in ("and", "or", "not") else None
        rows.append((me, parent, pos, axiom_id, kind, side, op, named, card))
        if op in ("and", "or", "not"):
            inner = args
        elif op in ("some", "only"):
            inner = args[1:]
        elif op in ("min", "max", "exact"):
            inner = args[2:]
        elif op == "one":
            for i, a in enumerate(args):
                rows.append((len(rows), me, i, axiom_id, kind, side, "individual", a, None))
            inner = []
        else:
            inner = []
        for i, a in enumerate(inner):
            walk(axiom_id, kind, side, a, me, i)

    for i, (kind, *args) in enumerate(axioms):
        if kind == "SubClassOf":
            walk(i, kind, "sub", args[0], None, 0)
            walk(i, kind, "sup", args[1], None, 1)
        elif kind in ("EquivalentClasses", "DisjointClasses"):
            for k, a in enumerate(args):
                walk(i, kind, "both", a, None, k)
        elif kind == "ClassAssertion":
            walk(i, kind, "sup", args[0], None, 0)
        elif kind in ("ObjectPropertyDomain", "ObjectPropertyRange"):
            walk(i, kind, "sup", args[1], None, 0)
    return spark.createDataFrame(rows, "expr_id long, parent_id long, pos int, axiom_id long, axiom_kind string, side string, op string, arg string, card int")


def members(kg, e, edges: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """``(x)``: named individuals that are known to be in ``e``.

    The world is open: ``not`` holds only by disjointness, ``only`` and ``max`` never by absence.
    ``min`` counts successors that are pairwise known to be different.
    """
    edges = reason.property_edges(kg) if edges is None else edges
    types = reason.inherited_types(kg) if types is None else types
    go = lambda x: members(kg, x, edges, types)
    steps = lambda p: edges.where(F.col("p") == p).select("s", "o") if isinstance(p, str) else edges.where(F.col("p") == p[1]).select(F.col("o").alias("s"), F.col("s").alias("o"))
    none = kg.spark.createDataFrame([], "x string")
    if e == T.THING:
        return types.select("x").union(edges.select("s")).union(edges.select("o")).distinct()
    if isinstance(e, str):
        return types.where(F.col("cls") == e).select("x").distinct()
    match simplify(e):
        case str(c):
            return go(c)
        case ("and", *parts):
            return reduce(lambda a, b: a.join(b, "x", "left_semi"), map(go, parts))
        case ("or", *parts):
            return reduce(lambda a, b: a.union(b), map(go, parts)).distinct()
        case ("not", str(c)):
            d = reason.disjoint_classes(kg)
            apart = d.where(F.col("a") == c).select(F.col("b").alias("cls")).union(d.where(F.col("b") == c).select("a"))
            return types.join(apart, "cls", "left_semi").select("x").distinct()
        case ("not", inner):
            return go(negate(inner)) if negate(inner) != ("not", inner) else none
        case ("one", *individuals):
            return kg.spark.createDataFrame([(a,) for a in individuals], "x string")
        case ("some", p, filler):
            return steps(role(p)).join(go(filler).select(F.col("x").alias("o")), "o", "left_semi").select(F.col("s").alias("x")).distinct()
        case ("value", p, a):
            return steps(role(p)).where(F.col("o") == a).select(F.col("s").alias("x")).distinct()
        case ("self", p):
            return steps(role(p)).where("s = o").select(F.col("s").alias("x")).distinct()
        case ("min" | "exact", n, p, *filler):
            if n == 0:
                return go(T.THING)
            d = steps(role(p)).distinct()
            if filler:
                d = d.join(go(filler[0]).select(F.col("x").alias("o")), "o", "left_semi")
            if n == 1:
                return d.select(F.col("s").alias("x")).distinct()
            return reason.with_apart(d, kg.member_pairs("DifferentIndividuals"), n).select(F.col("s").alias("x"))
        case ("dsome", p, r):
            return kg.triples.where((F.col("p") == p) & (F.col("o_kind") == "lit")).where(in_range(r)).select(F.col("s").alias("x")).distinct()
        case ("dvalue", p, (lex, dt, *_)):
            return kg.triples.where((F.col("p") == p) & (F.col("o") == lex) & (F.coalesce(F.col("o_dt"), F.lit(T.STRING)) == dt)).select(F.col("s").alias("x")).distinct()
        case ("dmin" | "dexact", n, p):
            t = kg.triples.where((F.col("p") == p) & (F.col("o_kind") == "lit"))
            return t.groupBy(F.col("s").alias("x")).agg(F.countDistinct("o", F.coalesce("o_dt", F.lit(""))).alias("n")).where(F.col("n") >= n).select("x")
    return none


FACETS = {"minInclusive": ">=", "maxInclusive": "<=", "minExclusive": ">", "maxExclusive": "<", "length": "len=", "minLength": "len>=", "maxLength": "len<=", "pattern": "~"}


def in_range(r, lex: str = "o", dt: str = "o_dt") -> Column:
    """Whether the literal columns lie in a data range."""
    value, kind = F.col(lex), F.coalesce(F.col(dt), F.lit(T.STRING))
    if isinstance(r, str):
        if r == T.RDFS + "Literal":
            return F.lit(True)
        if r == T.DECIMAL:
            return kind.isin(T.DECIMAL, T.INTEGER)
        return kind == r
    match r:
        case ("and", *parts):
            return reduce(lambda a, b: a & b, [in_range(p, lex, dt) for p in parts])
        case ("or", *parts):
            return reduce(lambda a, b: a | b, [in_range(p, lex, dt) for p in parts])
        case ("not", part):
            return ~in_range(part, lex, dt)
        case ("one", *literals):
            return reduce(lambda a, b: a | b, [(value == x[0]) & (kind == x[1]) for x in literals])
        case ("restriction", base, *facets):
            out = in_range(base, lex, dt)
            number = value.try_cast("double")
            for name, v in facets:
                op = FACETS[name]
                test = {">=": lambda: number >= float(v), "<=": lambda: number <= float(v), ">": lambda: number > float(v), "<": lambda: number < float(v), "len=": lambda: F.length(value) == int(v), "len>=": lambda: F.length(value) >= int(v), "len<=": lambda: F.length(value) <= int(v), "~": lambda: value.rlike(f"^(?:{v})$")}[op]
                out = out & F.coalesce(test(), F.lit(False))
            return out
    raise TypeError(r)


def empty_range(r) -> bool:
    """Whether no literal lies in a restriction of a numeric datatype (xsd:float by single precision)."""
    if not (isinstance(r, tuple) and r[0] == "restriction"):
        return False
    low = [(float(v), n == "minExclusive") for n, v in r[2:] if n.startswith("min") and n != "minLength"]
    high = [(float(v), n == "maxExclusive") for n, v in r[2:] if n.startswith("max") and n != "maxLength"]
    if not low or not high:
        return False
    (a, a_open), (b, b_open) = max(low), min(high, key=lambda x: (x[0], not x[1]))
    if r[1] == T.XSD + "float":
        return T.empty_float_range(a, b, a_open, b_open)
    if r[1] == T.INTEGER:
        import math

        least = math.floor(a) + 1 if a_open else math.ceil(a)
        most = math.ceil(b) - 1 if b_open else math.floor(b)
        return least > most
    return a > b or (a == b and (a_open or b_open))

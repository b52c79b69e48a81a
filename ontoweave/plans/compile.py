"""Compiles the algebra to lazy DataFrames.

A variable ``x`` is the columns ``x`` (lexical form) and ``x__k``, ``x__t``, ``x__g`` (kind, datatype,
language); columns that nothing uses are pruned by the optimizer. Each solution knows which variables
are bound in every row and which only may be: shared variables of the first sort give equi-joins;
for the second sort the sides are split into bound and unbound rows, so that "unbound is compatible
with anything" never becomes a nested-loop join as long as one certain variable is shared.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.functions import terms as T
from ontoweave.plans import algebra as A

_ids = count()


def cols(name: str) -> list[str]:
    return [name, f"{name}__k", f"{name}__t", f"{name}__g"]


@dataclass(frozen=True)
class Solutions:
    """Rows of bindings; ``sure`` variables are never unbound, ``resources`` are never literals."""

    df: DataFrame
    sure: frozenset[str]
    maybe: frozenset[str] = frozenset()
    resources: frozenset[str] = frozenset()

    @property
    def names(self) -> frozenset[str]:
        return self.sure | self.maybe

    def columns(self) -> list[str]:
        return [c for n in sorted(self.names) for c in cols(n)]


class Compiler:
    """Patterns over one table of triples; ``counts`` of predicates and ``keep_order`` decide the order of joins."""

    def __init__(self, triples: DataFrame, counts: dict[str, int] | None = None, keep_order: bool = False):
        self.triples, self.counts, self.keep_order = triples, counts or {}, keep_order

    def run(self, q) -> DataFrame:
        """The query's rows: one string column per selected variable, unbound as null; aggregates keep their type."""
        s = self.solve(q)
        names = A.variables(q)
        return s.df.select(*[F.col(f"`{n}`") for n in names])

    def solve(self, q) -> Solutions:
        return getattr(self, "_" + type(q).__name__.lower())(q)

    # Patterns
    def _bgp(self, q: A.Bgp) -> Solutions:
        todo, out = list(q.patterns), None
        while todo:
            known = out.names if out else frozenset()
            if not self.keep_order:
                todo.sort(key=lambda p: self._rank(p, known))
            p = todo.pop(0)
            if out is not None and self._may_stay(p, out):
                out = self._step_or_stay(out, p)
                continue
            one = self.pattern(p)
            out = one if out is None else self.join(out, one)
        return out

    @staticmethod
    def _may_stay(p: A.Pattern, out: Solutions) -> bool:
        """Whether a path of no step starts from known nodes only, and ends in a new variable."""
        known = isinstance(p.s, A.Var) and p.s.name in out.sure and p.s.name in out.resources
        return isinstance(p.p, A.Star | A.Maybe) and known and isinstance(p.o, A.Var) and p.o.name not in out.names

    def _step_or_stay(self, out: Solutions, p: A.Pattern) -> Solutions:
        """The rows with a step, and all rows with the end at the start: no list of all nodes is needed."""
        steps = self.path(A.Plus(p.p.path) if isinstance(p.p, A.Star) else p.p.path)
        steps = steps.where("s <> o OR o_kind = 'lit'").distinct()
        moved = self.join(out, self._bind(steps, p))
        stayed = out.df.withColumns({b: F.col(a) for a, b in zip(cols(p.s.name), cols(p.o.name))})
        return Solutions(moved.df.unionByName(stayed), moved.sure, moved.maybe, out.resources)

    def _rank(self, p: A.Pattern, known: frozenset[str]) -> tuple:
        """Connected patterns first, then those with more constants, then rarer predicates."""
        constants = sum(isinstance(t, A.Iri | A.Lit) for t in (p.s, p.o))
        shared = bool(known & set(A.variables(p))) or not known
        path = not isinstance(p.p, A.Iri | A.Var)
        size = self.counts.get(p.p.value, 0) if isinstance(p.p, A.Iri) else 1 << 60
        return (not shared, path, -constants, isinstance(p.p, A.Var), size)

    def pattern(self, p: A.Pattern) -> Solutions:
        if not isinstance(p.p, A.Iri | A.Var):
            return self._bind(self.path(p.p), p)
        t = self.triples
        if isinstance(p.p, A.Iri):
            t = t.where(F.col("p") == p.p.value)
        return self._bind(t, p)

    def _bind(self, t: DataFrame, p: A.Pattern) -> Solutions:
        """Conditions for constants and repeated variables, columns for the others."""
        if isinstance(p.s, A.Iri):
            t = t.where(F.col("s") == p.s.value)
        if isinstance(p.o, A.Iri):
            t = t.where((F.col("o") == p.o.value) & (F.col("o_kind") == "iri"))
        elif isinstance(p.o, A.Lit):
            t = t.where((F.col("o") == p.o.value) & (F.col("o_kind") == "lit") & (F.coalesce(F.col("o_dt"), F.lit(T.STRING)) == p.o.datatype))
            if p.o.lang:
                t = t.where(F.lower("o_lang") == p.o.lang)
        none = F.lit(None).cast("string")
        kind = F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri")
        parts = {"s": (F.col("s"), kind, none, none), "p": (F.col("p") if "p" in t.columns else none, F.lit("iri"), none, none), "o": (F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"))}
        seen: dict[str, str] = {}
        out = []
        for place, term in (("s", p.s), ("p", p.p), ("o", p.o)):
            if not isinstance(term, A.Var):
                continue
            if term.name in seen:
                t = t.where(F.col(place) == F.col(seen[term.name]))
                if place == "o":
                    t = t.where("o_kind <> 'lit'")
                continue
            seen[term.name] = place
            out += [c.alias(n) for c, n in zip(parts[place], cols(term.name))]
        resources = frozenset(n for n, place in seen.items() if place != "o")
        return Solutions(t.select(*out), frozenset(seen), frozenset(), resources)

    def path(self, path) -> DataFrame:
        """``(s, o, o_kind, o_dt, o_lang)`` of a property path; closures are sets, the rest keeps duplicates."""
        from ontoweave.plans.closure import closure

        keep = ["s", "o", "o_kind", "o_dt", "o_lang"]
        match path:
            case A.Link(iri):
                return self.triples.where(F.col("p") == iri).select(*keep)
            case A.Inverse(inner):
                d = self.path(inner).where("o_kind <> 'lit'")
                kind = F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri")
                return d.select(F.col("o").alias("s"), F.col("s").alias("o"), kind.alias("o_kind"), "o_dt", "o_lang")
            case A.Seq(left, right):
                a = self.path(left).where("o_kind <> 'lit'").select("s", F.col("o").alias("_mid"))
                b = self.path(right).withColumnRenamed("s", "_mid")
                return a.join(b, "_mid").select(*keep)
            case A.Alt(left, right):
                return self.path(left).unionByName(self.path(right))
            case A.Maybe(inner):
                return self.path(inner).unionByName(self._itself()).distinct()
            case A.Plus(inner):
                # Literals end a path, so they are reached by one last step.
                d = self.path(inner)
                found = closure(d.where("o_kind <> 'lit'"), "s", "o")
                kind = F.when(F.col("o").startswith("_:"), "bnode").otherwise("iri")
                none = F.lit(None).cast("string")
                out = found.select("s", "o", kind.alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
                last = d.where("o_kind = 'lit'")
                more = found.withColumnRenamed("o", "_mid").join(last.withColumnRenamed("s", "_mid"), "_mid").select(*keep)
                return out.unionByName(last).unionByName(more).distinct()
            case A.Star(inner):
                return self.path(A.Plus(inner)).unionByName(self._itself()).distinct()
        raise TypeError(path)

    def _itself(self) -> DataFrame:
        t = self.triples
        none = F.lit(None).cast("string")
        nodes = t.select(F.col("s").alias("n")).union(t.where("o_kind <> 'lit'").select("o")).distinct()
        return nodes.select(F.col("n").alias("s"), F.col("n").alias("o"), F.when(F.col("n").startswith("_:"), "bnode").otherwise("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))

    # Joins
    def join(self, a: Solutions, b: Solutions, how: str = "inner", condition: Column | None = None) -> Solutions:
        """Natural join; ``how`` is inner or left. The condition belongs to a left join's match."""
        shared = a.names & b.names
        loose = sorted(n for n in shared if n in a.maybe or n in b.maybe)
        if how == "left" and loose:
            key = f"_row{next(_ids)}"
            tagged = Solutions(a.df.withColumn(key, F.monotonically_increasing_id()), a.sure, a.maybe, a.resources)
            inner = self.join(tagged, b, condition=condition)
            rest = tagged.df.join(inner.df.select(key), key, "left_anti")
            both = inner.df.unionByName(rest, allowMissingColumns=True).drop(key)
            return Solutions(both, a.sure, (a.maybe | b.names) - a.sure, a.resources)
        if loose:
            return self._loose_join(a, b, loose, condition)
        left, right = a.df, b.df
        for n in sorted(shared):  # a literal can't equal a resource
            if n in a.resources and n not in b.resources:
                right = right.where(F.col(f"{n}__k") != "lit")
            elif n in b.resources and n not in a.resources and how == "inner":
                left = left.where(F.col(f"{n}__k") != "lit")
        rename = {c: f"{c}__r" for n in shared for c in cols(n)}
        right = right.withColumnsRenamed(rename)
        on = []
        for n in sorted(shared):
            on.append(F.col(n) == F.col(f"{n}__r"))
            if how == "left" and n in b.resources and n not in a.resources:
                on.append(F.col(f"{n}__k") != "lit")
            if n not in a.resources and n not in b.resources:
                on += [F.col(f"{n}__k") == F.col(f"{n}__k__r"), F.coalesce(F.col(f"{n}__t"), F.lit("")) == F.coalesce(F.col(f"{n}__t__r"), F.lit("")), F.coalesce(F.col(f"{n}__g"), F.lit("")) == F.coalesce(F.col(f"{n}__g__r"), F.lit(""))]
        if condition is not None:
            on.append(condition)
        if not on:
            if how == "inner":
                out = left.crossJoin(right)
            else:
                out = left.join(right, F.lit(True), "left")
        else:
            out = left.join(right, reduce(lambda x, y: x & y, on), how)
        out = out.drop(*rename.values())
        if how == "left":
            return Solutions(out, a.sure, (a.maybe | b.names) - a.sure, a.resources)
        return Solutions(out, a.sure | b.sure, (a.maybe | b.maybe) - a.sure - b.sure, a.resources | b.resources)

    def _loose_join(self, a: Solutions, b: Solutions, loose: list[str], condition: Column | None) -> Solutions:
        """Split both sides by which loose variables are bound; each combination is an equi-join on the rest."""
        names = a.names | b.names
        parts = []
        options = [[(x, y) for x in ((True, False) if n in a.maybe else (True,)) for y in ((True, False) if n in b.maybe else (True,))] for n in loose]
        for case in product(*options):
            left, right = a.df, b.df
            a_names, b_names = set(a.names), set(b.names)
            for n, (in_a, in_b) in zip(loose, case):
                if n in a.maybe:
                    left = left.where(F.col(n).isNotNull() if in_a else F.col(n).isNull())
                if n in b.maybe:
                    right = right.where(F.col(n).isNotNull() if in_b else F.col(n).isNull())
                if not in_a:
                    left = left.drop(*cols(n))
                    a_names.discard(n)
                if not in_b:
                    right = right.drop(*cols(n))
                    b_names.discard(n)
            sure = set(loose)
            x = Solutions(left, frozenset(v for v in a_names if v in a.sure or v in sure), frozenset(v for v in a_names if v in a.maybe and v not in sure), a.resources)
            y = Solutions(right, frozenset(v for v in b_names if v in b.sure or v in sure), frozenset(v for v in b_names if v in b.maybe and v not in sure), b.resources)
            parts.append(self.join(x, y, condition=condition).df)
        df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        for n in sorted(names):  # unbound on both sides everywhere
            for c in cols(n):
                if c not in df.columns:
                    df = df.withColumn(c, F.lit(None).cast("string"))
        sure = a.sure | b.sure
        return Solutions(df, sure, names - sure, a.resources & b.resources)

    def _join(self, q: A.Join) -> Solutions:
        return self.join(self.solve(q.left), self.solve(q.right))

    def _leftjoin(self, q: A.LeftJoin) -> Solutions:
        a, b = self.solve(q.left), self.solve(q.right)
        condition = None
        if q.condition is not None:
            condition = F.coalesce(self.condition(q.condition), F.lit(False))
        return self.join(a, b, "left", condition)

    def _union(self, q: A.Union) -> Solutions:
        parts = [self.solve(b) for b in q.branches]
        names = frozenset().union(*(p.names for p in parts))
        df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (p.df.select(*p.columns(), *[c for c in p.df.columns if c not in p.columns()]) for p in parts))
        sure = frozenset.intersection(*(p.sure for p in parts))
        resources = frozenset(n for n in names if all(n in p.resources or n not in p.names for p in parts))
        return Solutions(df, sure, names - sure, resources)

    def _minus(self, q: A.Minus) -> Solutions:
        a, b = self.solve(q.left), self.solve(q.right)
        if not a.names & b.names:
            return a
        return Solutions(self._semi(a, b, True, True), a.sure, a.maybe, a.resources)

    def _exists(self, q: A.Exists) -> Solutions:
        a, inner, conditions = self.solve(q.child), q.pattern, []
        while isinstance(inner, A.Filter):  # a filter of the pattern may speak of the row's own variables
            conditions.append(inner.condition)
            inner = inner.child
        b = self.solve(inner)
        ours = [c for c in conditions if A.mentioned(c) - b.names]
        for c in conditions:
            if c not in ours:
                b = Solutions(b.df.where(self.condition(c)), b.sure, b.maybe, b.resources)
        condition = reduce(lambda x, y: x & y, [F.coalesce(self.condition(c), F.lit(False)) for c in ours]) if ours else None
        extra = frozenset().union(*map(A.mentioned, ours)) & b.names - a.names
        return Solutions(self._semi(a, b, q.negated, False, condition, extra), a.sure, a.maybe, a.resources)

    def _semi(self, a: Solutions, b: Solutions, anti: bool, overlap: bool, condition: Column | None = None, extra: frozenset = frozenset()) -> DataFrame:
        """Rows of ``a`` with (``anti``: without) a compatible row of ``b``; with ``overlap`` they must share a bound variable.

        Both sides are split by which of the shared variables that may be unbound are bound, so that
        every case is an equi-join on those bound on both sides. ``condition`` may speak of both sides'
        columns; ``extra`` are variables of ``b`` alone that it needs.
        """
        shared = sorted(a.names & b.names)
        right_all = b.df.select(*[F.col(c).alias(f"{c}__r") for n in shared for c in cols(n)], *[F.col(c) for n in sorted(extra) for c in cols(n)])
        if shared or extra:
            right_all = right_all.distinct()
        bound = lambda df, case, end: reduce(lambda d, x: d.where(F.col(x[0] + end).isNotNull() if x[1] else F.col(x[0] + end).isNull()), case, df)
        cases = lambda names: [tuple(zip(names, flags)) for flags in product((True, False), repeat=len(names))]
        out = []
        for case in cases([n for n in shared if n in a.maybe]):
            left = bound(a.df, case, "")
            unbound = {n for n, is_bound in case if not is_bound}
            kept = []
            for other in cases([n for n in shared if n in b.maybe]):
                keys = [n for n in shared if n not in unbound and (n, False) not in other]
                if not keys and overlap:
                    continue
                right = bound(right_all, other, "__r")
                on = [self._same(n, a, b) for n in keys] + ([condition] if condition is not None else [])
                if not on:  # any row will do
                    right, on = right.limit(1), [F.lit(True)]
                on = reduce(lambda x, y: x & y, on)
                if not anti:
                    kept.append(left.join(right, on, "left_semi"))
                left = left.join(right, on, "left_anti")
            out += [left] if anti else kept
        return reduce(lambda x, y: x.unionByName(y), out)

    @staticmethod
    def _same(n: str, a: Solutions, b: Solutions) -> Column:
        """The same term on both sides, the right one's columns ending in ``__r``."""
        lex, kind, dt, lang = cols(n)
        same = F.col(lex) == F.col(f"{lex}__r")
        if n in a.resources and n in b.resources:
            return same
        if n in a.resources or n in b.resources:
            return same & (F.col(kind) != "lit") & (F.col(f"{kind}__r") != "lit")
        for c in (kind, dt, lang):
            same = same & (F.coalesce(F.col(c), F.lit("")) == F.coalesce(F.col(f"{c}__r"), F.lit("")))
        return same

    # Rows
    def _filter(self, q: A.Filter) -> Solutions:
        a = self.solve(q.child)
        return Solutions(a.df.where(self.condition(q.condition)), a.sure, a.maybe, a.resources)

    def _extend(self, q: A.Extend) -> Solutions:
        a = self.solve(q.child)
        value = self.value(q.expression)
        df = a.df.withColumns(dict(zip(cols(q.name), (value.lex, value.kind, value.dt, value.lang))))
        return Solutions(df, a.sure, a.maybe | {q.name}, a.resources)

    def _values(self, q: A.Values) -> Solutions:
        spark = self.triples.sparkSession
        if not q.names:
            return Solutions(spark.range(len(q.rows)).select(), frozenset())
        rows = []
        for r in q.rows:
            flat = []
            for t in r:
                flat += [None] * 4 if t is None else [t.value, "iri", None, None] if isinstance(t, A.Iri) else [t.value, "lit", t.datatype, t.lang]
            rows.append(tuple(flat))
        names = [c for n in q.names for c in cols(n)]
        df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in names))
        loose = frozenset(n for i, n in enumerate(q.names) if any(r[i] is None for r in q.rows))
        return Solutions(df, frozenset(q.names) - loose, loose)

    def _project(self, q: A.Project) -> Solutions:
        a = self.solve(q.child)
        df = a.df
        for n in q.names:
            if n not in df.columns:
                df = df.withColumn(n, F.lit(None).cast("string"))
        keep = [c for n in q.names for c in cols(n) if c in df.columns]
        return Solutions(df.select(*keep), a.sure & set(q.names), (a.maybe & set(q.names)) | (set(q.names) - a.names), a.resources & set(q.names))

    def _distinct(self, q) -> Solutions:
        a = self.solve(q.child)
        return Solutions(a.df.dropDuplicates(), a.sure, a.maybe, a.resources)

    _reduced = _distinct  # any number between distinct and all is allowed; distinct is exact

    def _orderby(self, q: A.OrderBy) -> Solutions:
        a = self.solve(q.child)
        keys = []
        for e, down in q.keys:
            v = self.value(e)
            number = v.number() if v.typed else v.lex.try_cast("double")
            for c in (number, v.lex):
                keys.append(c.desc_nulls_last() if down else c.asc_nulls_first())
        return Solutions(a.df.orderBy(*keys), a.sure, a.maybe, a.resources)

    def _slice(self, q: A.Slice) -> Solutions:
        a = self.solve(q.child)
        df = a.df.offset(q.offset) if q.offset else a.df
        return Solutions(df.limit(q.limit) if q.limit is not None else df, a.sure, a.maybe, a.resources)

    def _group(self, q: A.Group) -> Solutions:
        a = self.solve(q.child)
        aggregates, terms = [], {}
        for name, fn, e, distinct in q.aggregates:
            if fn == "COUNT" and e is None:
                aggregates.append(F.count(F.lit(1)).alias(name))
                continue
            v = self.value(e)
            if fn == "COUNT":
                term = F.when(v.lex.isNotNull(), F.struct(v.lex, *(F.coalesce(c, F.lit("")) for c in (v.kind, v.dt, v.lang))))
                aggregates.append((F.countDistinct(term) if distinct else F.count(v.lex)).alias(name))
            elif fn in ("SUM", "AVG"):
                aggregates.append({"SUM": F.sum_distinct if distinct else F.sum, "AVG": F.avg}[fn](v.number()).alias(name))
            elif fn.startswith("GROUP_CONCAT"):
                texts = F.collect_set(v.lex) if distinct else F.collect_list(v.lex)
                aggregates.append(F.array_join(F.sort_array(texts), fn[len("GROUP_CONCAT:") :]).alias(name))
            else:
                # Terms in SPARQL's order: blank nodes, IRIs, numbers by value, other literals.
                rank = F.when(v.kind == "bnode", 0).when(v.kind == "iri", 1).when(v.number().isNotNull(), 2).otherwise(3)
                term = F.struct(rank.alias("rank"), v.number().alias("n"), v.lex.alias("lex"), v.kind.alias("kind"), v.dt.alias("dt"), v.lang.alias("lang"))
                aggregates.append((F.max if fn == "MAX" else F.min)(F.when(v.lex.isNotNull(), term)).alias(f"{name}__term"))
                terms[name] = f"{name}__term"
        groups = [c for k in q.keys for c in cols(k)]
        df = a.df.groupBy(*groups).agg(*aggregates) if groups else a.df.agg(*aggregates)
        for name, fn, *_ in q.aggregates:  # a number's column keeps its type; its term columns say it is a number
            if name in terms:
                parts = [F.col(f"{terms[name]}.{x}") for x in ("lex", "kind", "dt", "lang")]
                df = df.withColumns(dict(zip(cols(name), parts))).drop(terms[name])
                continue
            dt = T.INTEGER if fn == "COUNT" else T.STRING if fn.startswith("GROUP_CONCAT") else T.DOUBLE
            df = df.withColumns(dict(zip(cols(name)[1:], (F.lit("lit"), F.lit(dt), F.lit(None).cast("string")))))
        return Solutions(df, a.sure & set(q.keys), (a.maybe & set(q.keys)) | {x[0] for x in q.aggregates}, a.resources & set(q.keys))

    # Expressions
    def condition(self, e) -> Column:
        """A Boolean column; errors and unbound variables are null, so such rows are dropped."""
        match e:
            case A.And(parts):
                return reduce(lambda x, y: x & y, map(self.condition, parts))
            case A.Or(parts):
                return reduce(lambda x, y: x | y, map(self.condition, parts))
            case A.Not(part):
                return ~self.condition(part)
            case A.Compare(op, left, right):
                return compare(op, self.value(left), self.value(right))
            case A.In(left, values, negated):
                v = self.value(left)
                out = reduce(lambda x, y: x | y, [compare("=", v, self.value(x)) for x in values], F.lit(False))
                return ~out if negated else out
            case A.Call(name, args):
                return self._test(name, args)
            case A.Ref(name) | A.Value(A.Lit(name)):
                v = self.value(e)
                return F.when(v.dt == T.BOOLEAN, v.lex.isin("true", "1")).when(v.dt.isin(T.NUMERIC), v.lex.try_cast("double") != 0).when(v.kind == "lit", F.length(v.lex) > 0)
        raise TypeError(e)

    def _test(self, name: str, args: tuple) -> Column:
        if name == "BOUND":
            return F.col(args[0].name).isNotNull()
        v = self.value(args[0])
        if name in ("ISIRI", "ISURI", "ISLITERAL", "ISBLANK"):
            return v.kind == {"ISIRI": "iri", "ISURI": "iri", "ISLITERAL": "lit", "ISBLANK": "bnode"}[name]
        if name == "ISNUMERIC":
            return (v.kind == "lit") & F.coalesce(v.dt.isin(T.NUMERIC), F.lit(False)) & v.lex.try_cast("double").isNotNull()
        if name in ("STRSTARTS", "STRENDS", "CONTAINS"):
            w = self.value(args[1]).lex
            return {"STRSTARTS": v.lex.startswith, "STRENDS": v.lex.endswith, "CONTAINS": v.lex.contains}[name](w)
        if name == "REGEX":
            flags = "(?i)" if len(args) > 2 and "i" in args[2].term.value else ""
            return v.lex.rlike(flags + args[1].term.value)
        if name == "SAMETERM":
            w = self.value(args[1])
            return (v.lex == w.lex) & (v.kind == w.kind) & v.dt.eqNullSafe(w.dt) & v.lang.eqNullSafe(w.lang)
        if name == "LANGMATCHES":
            w = self.value(args[1]).lex
            return (F.lower(v.lex) == F.lower(w)) | F.lower(v.lex).startswith(F.concat(F.lower(w), F.lit("-"))) | ((w == "*") & (v.lex != ""))
        raise ValueError(f"unknown test {name}")

    def value(self, e) -> "Term":
        none = F.lit(None).cast("string")
        match e:
            case A.Ref(name):
                lex, *rest = cols(name)
                return Term(F.col(lex).cast("string"), *(F.col(c) for c in rest))
            case A.Value(A.Iri(iri)):
                return Term(F.lit(iri), F.lit("iri"), none, none)
            case A.Value(A.Lit(lex, dt, lang)):
                return Term(F.lit(lex), F.lit("lit"), F.lit(dt), F.lit(lang).cast("string"), dt)
            case A.Arith(op, left, right):
                x, y = self.value(left).number(), self.value(right).number()
                out = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op]
                return Term(out.cast("string"), F.when(out.isNotNull(), "lit"), F.lit(T.DOUBLE), none, T.DOUBLE)
            case A.Call(name, args):
                return self._function(name, args)
        raise TypeError(e)

    def _function(self, name: str, args: tuple) -> "Term":
        none = F.lit(None).cast("string")
        text = lambda c: Term(c, F.when(c.isNotNull(), "lit"), F.lit(T.STRING), none, T.STRING)
        number = lambda c, dt: Term(c.cast("string"), F.when(c.isNotNull(), "lit"), F.lit(dt), none, dt)
        if name == "IF":
            c, x, y = self.condition(args[0]), self.value(args[1]), self.value(args[2])
            pick = lambda a, b: F.when(c, a).when(~c, b)
            return Term(pick(x.lex, y.lex), pick(x.kind, y.kind), pick(x.dt, y.dt), pick(x.lang, y.lang))
        v = self.value(args[0]) if args else None
        match name:
            case "STR":
                return text(v.lex)
            case "LANG":
                return text(F.when(v.kind == "lit", F.coalesce(v.lang, F.lit(""))))
            case "DATATYPE":
                dt = F.when(v.kind == "lit", F.coalesce(v.dt, F.lit(T.STRING)))
                return Term(dt, F.when(dt.isNotNull(), "iri"), none, none)
            case "UCASE":
                return text(F.upper(v.lex))
            case "LCASE":
                return text(F.lower(v.lex))
            case "STRLEN":
                return number(F.length(v.lex), T.INTEGER)
            case "CONCAT":
                return text(F.concat(*[self.value(a).lex for a in args]))
            case "ABS":
                return number(F.abs(v.number()), T.DOUBLE)
            case "YEAR" | "MONTH" | "DAY":
                return number(F.date_part(F.lit(name), v.lex.try_cast("timestamp_ntz")).cast("int"), T.INTEGER)
            case "COALESCE":
                vs = [self.value(a) for a in args]
                return Term(*(F.coalesce(*c) for c in zip(*((x.lex, x.kind, x.dt, x.lang) for x in vs))))
        raise ValueError(f"unknown function {name}")


@dataclass(frozen=True)
class Term:
    lex: Column
    kind: Column
    dt: Column
    lang: Column
    typed: str | None = None  # the datatype, where it is known beforehand

    def number(self) -> Column:
        return F.when(self.dt.isin(T.NUMERIC), self.lex.try_cast("double"))


def compare(op: str, a: Term, b: Term) -> Column:
    """Numbers as numbers, date-times as timestamps, strings as strings; unlike types are an error, that is null.

    ``=`` and ``!=`` also compare IRIs and, as terms, literals of other datatypes.
    """
    f = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    numeric = a.dt.isin(T.NUMERIC) & b.dt.isin(T.NUMERIC)
    plain = lambda t: (t.kind == "lit") & F.coalesce(t.dt, F.lit(T.STRING)).isin(T.STRING, T.LANG_STRING)
    out = F.when(numeric, f(a.lex.try_cast("double"), b.lex.try_cast("double")))
    out = out.when((a.dt == T.DATETIME) & (b.dt == T.DATETIME), f(a.lex.try_cast("timestamp"), b.lex.try_cast("timestamp")))
    if op in ("=", "!="):
        same = (a.lex == b.lex) & (a.kind == b.kind) & (F.coalesce(a.dt, F.lit("")) == F.coalesce(b.dt, F.lit(""))) & (F.coalesce(a.lang, F.lit("")) == F.coalesce(b.lang, F.lit("")))
        return out.when(a.lex.isNotNull() & b.lex.isNotNull(), same if op == "=" else ~same)
    out = out.when(plain(a) & plain(b), f(a.lex, b.lex))
    return out.when((a.dt == T.BOOLEAN) & (b.dt == T.BOOLEAN), f(a.lex, b.lex))

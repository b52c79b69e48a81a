"""A SPARQL front end over the algebra: tokenizer and recursive descent."""

from __future__ import annotations

import re

from ontoweave.functions import terms as T
from ontoweave.plans import algebra as A

TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<var>[?$][A-Za-z_]\w*)
    |(?P<str>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<num>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<qname>(?:[A-Za-z][\w.-]*)?:(?:[\w%-](?:[\w.%-]*[\w%-])?)?)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!*/|^+?-])""",
    re.VERBOSE | re.DOTALL,
)
AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT")


class SparqlError(ValueError):
    """The query text is not in the supported language."""


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SparqlError(f"unexpected {text[at : at + 20]!r} at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.tokens, self.at = tokenize(text), 0
        self.prefixes = T.PREFIXES | (prefixes or {})
        self.fresh = 0

    # Tokens
    @property
    def now(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def word(self, *words: str) -> bool:
        kind, text = self.now
        return kind == "word" and text.upper() in words

    def op(self, text: str) -> bool:
        return self.now == ("op", text)

    def take(self, what: str | None = None) -> str:
        kind, text = self.now
        if what is not None and text.upper() != what.upper():
            raise SparqlError(f"expected {what}, found {text or 'the end'!r}")
        self.at += 1
        return text

    def accept(self, what: str) -> bool:
        if self.now[0] in ("op", "word") and self.now[1].upper() == what.upper():
            self.at += 1
            return True
        return False

    # Query
    def query(self):
        while self.word("PREFIX", "BASE"):
            if self.take().upper() == "BASE":
                self.prefixes[""] = self.take()[1:-1]
                continue
            name = self.take()
            self.prefixes[name.rstrip(":")] = self.take()[1:-1]
        if self.accept("ASK"):
            self.accept("WHERE")
            return A.Slice(A.Project(self.group(), ()), 1)
        out = self.select()
        if self.now[0] != "end":
            raise SparqlError(f"unexpected {self.now[1]!r} after the query")
        return out

    def select(self):
        self.take("SELECT")
        modifier = self.take().upper() if self.word("DISTINCT", "REDUCED") else None
        names, aggregates, extends = [], [], []
        star = self.accept("*")
        while not star and not self.word("WHERE") and not self.op("{"):
            if self.now[0] == "var":
                names.append(self.take()[1:])
                continue
            self.take("(")
            value = self.expression()
            self.take("AS")
            name = self.take()[1:]
            self.take(")")
            if isinstance(value, A.Call) and value.name in AGGREGATES:
                aggregates.append(self._aggregate(name, value))
            else:
                extends.append((name, value))
            names.append(name)
        self.accept("WHERE")
        body = self.group()
        keys, having = [], None
        if self.accept("GROUP"):
            self.take("BY")
            while self.now[0] == "var":
                keys.append(self.take()[1:])
        if self.accept("HAVING"):
            self.take("(")
            having = self.expression()
            self.take(")")
        if aggregates or keys:
            if having is not None:
                having = self._lift(having, aggregates)
            body = A.Group(body, tuple(keys), tuple(aggregates))
            if having is not None:
                body = A.Filter(body, having)
        for name, value in extends:
            body = A.Extend(body, name, value)
        if self.accept("ORDER"):
            self.take("BY")
            order = []
            while self.now[0] == "var" or self.word("ASC", "DESC"):
                if self.now[0] == "var":
                    order.append((A.Ref(self.take()[1:]), False))
                else:
                    down = self.take().upper() == "DESC"
                    self.take("(")
                    order.append((self.expression(), down))
                    self.take(")")
            body = A.OrderBy(body, tuple(order))
        body = A.Project(body, tuple(names) if not star else tuple(v for v in A.variables(body) if not v.startswith("_")))
        body = A.Distinct(body) if modifier == "DISTINCT" else A.Reduced(body) if modifier == "REDUCED" else body
        limit, offset = None, 0
        while self.word("LIMIT", "OFFSET"):
            if self.take().upper() == "LIMIT":
                limit = int(self.take())
            else:
                offset = int(self.take())
        return body if limit is None and not offset else A.Slice(body, limit, offset)

    @staticmethod
    def _aggregate(name: str, call: A.Call) -> tuple:
        distinct = bool(call.args) and call.args[0] == "DISTINCT"
        args = call.args[1:] if distinct else call.args
        fn = f"GROUP_CONCAT:{args[1].term.value if len(args) > 1 else ' '}" if call.name == "GROUP_CONCAT" else call.name
        return name, fn, args[0] if args else None, distinct

    def _lift(self, x, aggregates: list):
        """Aggregates inside HAVING become hidden columns."""
        if isinstance(x, A.Call) and x.name in AGGREGATES:
            name = f"_having{len(aggregates)}"
            aggregates.append(self._aggregate(name, x))
            return A.Ref(name)
        if isinstance(x, A.Compare):
            return A.Compare(x.op, self._lift(x.left, aggregates), self._lift(x.right, aggregates))
        if isinstance(x, A.And | A.Or):
            return type(x)(tuple(self._lift(p, aggregates) for p in x.parts))
        return A.Not(self._lift(x.part, aggregates)) if isinstance(x, A.Not) else x

    def group(self):
        self.take("{")
        if self.word("SELECT"):
            out = self.select()
            self.take("}")
            return out
        out, filters = None, []
        join = lambda a, b: b if a is None else A.Bgp(a.patterns + b.patterns) if isinstance(a, A.Bgp) and isinstance(b, A.Bgp) else A.Join(a, b)
        while not self.accept("}"):
            if self.accept("."):
                continue
            if self.accept("OPTIONAL"):
                inner = self.group()
                condition = None
                if isinstance(inner, A.Filter):
                    inner, condition = inner.child, inner.condition
                out = A.LeftJoin(out if out is not None else A.Values((), ((),)), inner, condition)
            elif self.accept("MINUS"):
                out = A.Minus(out, self.group())
            elif self.accept("BIND"):
                self.take("(")
                value = self.expression()
                self.take("AS")
                out = A.Extend(out, self.take()[1:], value)
                self.take(")")
            elif self.accept("VALUES"):
                out = join(out, self.values())
            elif self.accept("FILTER"):
                negated = self.accept("NOT")
                if self.accept("EXISTS"):
                    filters.append((self.group(), negated))
                else:
                    filters.append(self.expression() if not negated else A.Not(self.expression()))
            elif self.op("{"):
                branches = [self.group()]
                while self.accept("UNION"):
                    branches.append(self.group())
                out = join(out, branches[0] if len(branches) == 1 else A.Union(tuple(branches)))
            else:
                out = join(out, A.Bgp(tuple(self.triples())))
        out = out if out is not None else A.Values((), ((),))
        for f in filters:
            out = A.Exists(out, f[0], f[1]) if isinstance(f, tuple) else A.Filter(out, f)
        return out

    def values(self) -> A.Values:
        if self.now[0] == "var":
            names = (self.take()[1:],)
            self.take("{")
            rows = []
            while not self.accept("}"):
                rows.append((self._data(),))
        else:
            self.take("(")
            names = []
            while not self.accept(")"):
                names.append(self.take()[1:])
            self.take("{")
            rows = []
            while not self.accept("}"):
                self.take("(")
                row = []
                while not self.accept(")"):
                    row.append(self._data())
                rows.append(tuple(row))
        return A.Values(tuple(names), tuple(rows))

    def _data(self):
        return None if self.accept("UNDEF") else self.term()

    def triples(self) -> list[A.Pattern]:
        out: list[A.Pattern] = []
        subject = self.node(out)
        if self.op(".") or self.op("}"):
            return out
        while True:
            verb = self.verb()
            while True:
                out.append(A.Pattern(subject, verb, self.node(out)))
                if not self.accept(","):
                    break
            if not self.accept(";"):
                break
            if self.op(".") or self.op("}"):
                break
        return out

    def node(self, out: list):
        """A term, or a bracketed node or list, whose triples are added."""
        if self.accept("["):
            self.fresh += 1
            me = A.Var(f"_b{self.fresh}")
            while not self.accept("]"):
                verb = self.verb()
                out.append(A.Pattern(me, verb, self.node(out)))
                while self.accept(","):
                    out.append(A.Pattern(me, verb, self.node(out)))
                self.accept(";")
            return me
        return self.term()

    def verb(self):
        if self.now[0] == "var":
            return A.Var(self.take()[1:])
        path = self.path()
        return A.Iri(path.iri) if isinstance(path, A.Link) else path

    def path(self):
        out = self.path_seq()
        while self.accept("|"):
            out = A.Alt(out, self.path_seq())
        return out

    def path_seq(self):
        out = self.path_step()
        while self.accept("/"):
            out = A.Seq(out, self.path_step())
        return out

    def path_step(self):
        if self.accept("^"):
            return A.Inverse(self.path_step())
        if self.accept("("):
            out = self.path()
            self.take(")")
        elif self.now == ("word", "a"):
            self.take()
            out = A.Link(T.TYPE)
        else:
            out = A.Link(self.iri())
        while self.now in (("op", "+"), ("op", "*"), ("op", "?")):
            out = {"+": A.Plus, "*": A.Star, "?": A.Maybe}[self.take()](out)
        return out

    def iri(self) -> str:
        kind, text = self.now
        if kind == "iri":
            self.take()
            return text[1:-1]
        if kind == "qname":
            self.take()
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + local
        raise SparqlError(f"expected an IRI, found {text or 'the end'!r}")

    def term(self):
        kind, text = self.now
        if kind == "var":
            self.take()
            return A.Var(text[1:])
        if kind == "str":
            self.take()
            body = T.turtle_unescape(text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1])
            if self.now[0] == "lang":
                return A.Lit(body, T.LANG_STRING, self.take()[1:].lower())
            if self.accept("^^"):
                return A.Lit(body, self.iri())
            return A.Lit(body)
        if kind == "num":
            self.take()
            return A.Lit(text, T.DOUBLE if "e" in text.lower() else T.DECIMAL if "." in text else T.INTEGER)
        if kind == "word" and text in ("true", "false"):
            self.take()
            return A.Lit(text, T.BOOLEAN)
        return A.Iri(self.iri())

    # Expressions
    def expression(self):
        parts = [self.conjunction()]
        while self.accept("||"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else A.Or(tuple(parts))

    def conjunction(self):
        parts = [self.relation()]
        while self.accept("&&"):
            parts.append(self.relation())
        return parts[0] if len(parts) == 1 else A.And(tuple(parts))

    def relation(self):
        left = self.sum()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.accept(op):
                return A.Compare(op, left, self.sum())
        negated = self.word("NOT") and self.tokens[self.at + 1][1].upper() == "IN"
        if negated:
            self.take()
        if self.accept("IN"):
            self.take("(")
            values = []
            while not self.accept(")"):
                values.append(self.expression())
                self.accept(",")
            return A.In(left, tuple(values), negated)
        return left

    def sum(self):
        out = self.product()
        while self.op("+") or self.op("-") or (self.now[0] == "num" and self.now[1][0] in "+-"):
            if self.now[0] == "num":
                out = A.Arith("+", out, self.product())
            else:
                out = A.Arith(self.take(), out, self.product())
        return out

    def product(self):
        out = self.unary()
        while self.op("*") or self.op("/"):
            out = A.Arith(self.take(), out, self.unary())
        return out

    def unary(self):
        if self.accept("!"):
            return A.Not(self.unary())
        if self.accept("("):
            out = self.expression()
            self.take(")")
            return out
        kind, text = self.now
        if kind == "var":
            self.take()
            return A.Ref(text[1:])
        if kind == "word" and text not in ("true", "false"):
            name = self.take().upper()
            self.take("(")
            args = []
            if self.accept("DISTINCT"):
                args.append("DISTINCT")
            while not self.accept(")"):
                if self.accept("*"):
                    continue
                if self.accept(";"):
                    self.take("SEPARATOR")
                    self.take("=")
                args.append(self.expression())
                self.accept(",")
            return A.Call(name, tuple(args))
        return A.Value(self.term())


def parse(text: str, prefixes: dict[str, str] | None = None):
    """The algebra of a SELECT or ASK query."""
    return Parser(text, prefixes).query()


def check(text: str, prefixes: dict[str, str] | None = None) -> list[str]:
    """Problems of a query: what does not parse, and selected variables that no pattern binds."""
    try:
        q = parse(text, prefixes)
    except (SparqlError, IndexError) as e:
        return [str(e)]
    while not isinstance(q, A.Project):
        q = q.child
    inner = q.child
    bound = set(A.variables(inner)) if not isinstance(inner, A.OrderBy) else set(A.variables(inner.child))
    return [f"?{n} is not bound" for n in q.names if n not in bound]

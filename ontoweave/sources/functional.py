"""OWL functional syntax and OWL/XML: both are trees of the same constructs."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from ontoweave.functions import terms as T
from ontoweave.sources.turtle import ParseError

TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>\s]*>)
    |(?P<str>"(?:[^"\\]|\\.)*")
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bnode>_:[\w.-]+)
    |(?P<num>\d+(?=[\s)]))
    |(?P<qname>(?:[A-Za-z][\w.-]*)?:[\w.%/-]*)
    |(?P<name>[A-Za-z]+)
    |(?P<op>\^\^|[()=])""",
    re.VERBOSE | re.DOTALL,
)

_DECLARE = {"Class": "class", "ObjectProperty": "object_property", "DataProperty": "data_property", "AnnotationProperty": "annotation_property", "NamedIndividual": "individual", "Datatype": "datatype"}
_PLAIN = {
    "SubClassOf", "EquivalentClasses", "DisjointClasses", "SubDataPropertyOf", "EquivalentObjectProperties", "DisjointObjectProperties", "InverseObjectProperties", "ObjectPropertyDomain", "ObjectPropertyRange",
    "DataPropertyDomain", "DataPropertyRange", "FunctionalObjectProperty", "InverseFunctionalObjectProperty", "ReflexiveObjectProperty", "IrreflexiveObjectProperty", "SymmetricObjectProperty", "AsymmetricObjectProperty",
    "TransitiveObjectProperty", "FunctionalDataProperty", "EquivalentDataProperties", "DisjointDataProperties", "SameIndividual", "DifferentIndividuals", "ClassAssertion", "ObjectPropertyAssertion", "DataPropertyAssertion",
    "NegativeObjectPropertyAssertion", "NegativeDataPropertyAssertion", "AnnotationAssertion", "SubAnnotationPropertyOf", "AnnotationPropertyDomain", "AnnotationPropertyRange", "DisjointUnion", "Import",
}
_EXPRESSION = {"ObjectIntersectionOf": "and", "ObjectUnionOf": "or", "ObjectComplementOf": "not", "ObjectOneOf": "one", "ObjectSomeValuesFrom": "some", "ObjectAllValuesFrom": "only", "ObjectHasValue": "value", "ObjectHasSelf": "self", "DataSomeValuesFrom": "dsome", "DataAllValuesFrom": "donly", "DataHasValue": "dvalue", "DataIntersectionOf": "and", "DataUnionOf": "or", "DataComplementOf": "not", "DataOneOf": "one"}
_COUNT = {"ObjectMinCardinality": "min", "ObjectMaxCardinality": "max", "ObjectExactCardinality": "exact", "DataMinCardinality": "dmin", "DataMaxCardinality": "dmax", "DataExactCardinality": "dexact"}


def build(name: str, args: list):
    """The expression or axiom of one construct; None for what carries no logic."""
    args = [a for a in args if a is not None]
    if name in _EXPRESSION:
        return (_EXPRESSION[name], *args)
    if name in _COUNT:
        return (_COUNT[name], int(args[0]), *args[1:])
    if name in ("ObjectInverseOf", "InverseObjectProperty"):
        return ("inverse", args[0])
    if name == "DatatypeRestriction":
        facets = args[1:]
        pairs = [f if isinstance(f, tuple) and f[0] == "facet" else None for f in facets]
        if all(pairs):
            return ("restriction", args[0], *((f[1].removeprefix(T.XSD), f[2][0]) for f in pairs))
        return ("restriction", args[0], *((facets[i].removeprefix(T.XSD), facets[i + 1][0]) for i in range(0, len(facets), 2)))
    if name == "FacetRestriction":
        return ("facet", *args)
    if name in ("ObjectPropertyChain", "ObjectPropertyChainOf"):
        return ("chain", *args)
    if name == "SubObjectPropertyOf":
        if isinstance(args[0], tuple) and args[0][0] == "chain":
            return ("SubPropertyChainOf", args[0][1:], args[1])
        return (name, *args)
    if name == "HasKey":
        return (name, args[0], tuple(p for a in args[1:] for p in (a if isinstance(a, list) else [a])))
    if name == "Declaration":
        return ("Declaration", *args[0]) if isinstance(args[0], tuple) else None
    if name in _DECLARE and len(args) == 1:
        return (_DECLARE[name], args[0])
    if name == "Annotation":
        return None
    if name in _PLAIN:
        return (name, *args)
    raise ParseError(f"unknown construct {name}")


class Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected {text[at : at + 20]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at, self.prefixes = 0, dict(T.PREFIXES)

    def next(self, what: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ParseError("unexpected end")
        t = self.tokens[self.at]
        if what and t[1] != what:
            raise ParseError(f"expected {what!r}, found {t[1]!r}")
        self.at += 1
        return t

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def iri(self, token) -> str:
        kind, text = token
        if kind == "iri":
            return text[1:-1]
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise ParseError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + local

    def read(self) -> list[tuple]:
        out = []
        while self.peek()[0] != "end":
            name = self.next()[1]
            self.next("(")
            if name == "Prefix":
                prefix = self.next()[1].removesuffix(":")
                self.next("=")
                self.prefixes[prefix] = self.next()[1][1:-1]
                self.next(")")
            elif name == "Ontology":
                while self.peek()[0] in ("iri", "qname"):
                    self.next()
                while self.peek()[1] != ")":
                    axiom = self.tree()
                    if axiom is not None:
                        out.append(axiom)
                self.next(")")
            else:
                raise ParseError(f"unexpected {name}")
        return out

    def tree(self):
        kind, text = self.peek()
        if kind == "name" and self.peek(1)[1] == "(":
            self.next(), self.next()
            args = []
            while self.peek()[1] != ")":
                args.append(self.tree())
            self.next(")")
            return build(text, args)
        if (kind, text) == ("op", "("):  # the property lists of HasKey
            self.next()
            args = []
            while self.peek()[1] != ")":
                args.append(self.tree())
            self.next(")")
            return args
        self.next()
        if kind == "str":
            body = T.turtle_unescape(text[1:-1])
            if self.peek()[1] == "^^":
                self.next()
                return (body, self.iri(self.next()), None)
            if self.peek()[0] == "lang":
                return (body, T.LANG_STRING, self.next()[1][1:].lower())
            return (body, T.STRING, None)
        if kind == "num":
            return text
        return text if kind == "bnode" else self.iri((kind, text))


def parse(text: str) -> list[tuple]:
    """Axioms of an ontology document in functional syntax."""
    return Reader(text).read()


_OX = "{" + T.OWL + "}"


def parse_xml(text: str) -> list[tuple]:
    """Axioms of an OWL/XML document."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise ParseError(str(e)) from e
    prefixes = T.PREFIXES | {p.get("name"): p.get("IRI") for p in root.iter(_OX + "Prefix")}
    base = root.get("{http://www.w3.org/XML/1998/namespace}base") or root.get("ontologyIRI") or ""

    def iri(e) -> str:
        if (short := e.get("abbreviatedIRI")) is not None:
            prefix, _, local = short.partition(":")
            return prefixes[prefix] + local
        full = e.get("IRI") if e.get("IRI") is not None else (e.text or "").strip()
        return full if ":" in full else base + full

    def tree(e):
        name = e.tag.removeprefix(_OX)
        if name in ("Class", "ObjectProperty", "DataProperty", "AnnotationProperty", "NamedIndividual", "Datatype"):
            return iri(e)
        if name == "IRI":
            return iri(e)
        if name == "AbbreviatedIRI":
            prefix, _, local = e.text.strip().partition(":")
            return prefixes[prefix] + local
        if name == "AnonymousIndividual":
            return e.get("nodeID")
        if name == "Literal":
            lang = e.get("{http://www.w3.org/XML/1998/namespace}lang")
            return (e.text or "", e.get("datatypeIRI") or (T.LANG_STRING if lang else T.STRING), lang.lower() if lang else None)
        if name == "Declaration":
            return ("Declaration", _DECLARE[e[0].tag.removeprefix(_OX)], iri(e[0]))
        if name == "FacetRestriction":
            return ("facet", e.get("facet"), tree(e[0]))
        if name in _COUNT:
            return build(name, [e.get("cardinality"), *map(tree, e)])
        if name == "Import":
            return ("Import", e.text.strip())
        if name in ("Prefix", "Annotation"):
            return None
        return build(name, [tree(c) for c in e])

    return [a for a in map(tree, root) if a is not None]


def write(axioms: list[tuple]) -> str:
    """An ontology document in functional syntax; the inverse of ``parse`` for its axioms."""
    expression = {v: k for k, v in _EXPRESSION.items() if not k.startswith("Data") or v in ("dsome", "donly", "dvalue")}
    count = {v: k for k, v in _COUNT.items()}
    declare = {v: k for k, v in _DECLARE.items()}

    def show(x, data=False) -> str:
        if isinstance(x, str):
            return x if x.startswith("_:") else f"<{x}>"
        if isinstance(x, tuple) and len(x) == 3 and x[0] not in expression and x[0] not in count and x[0] != "restriction" and (x[2] is None or isinstance(x[2], str)) and isinstance(x[1], str) and x[1].startswith("http"):
            suffix = f"@{x[2]}" if x[2] else f"^^<{x[1]}>"
            return f'"{T.turtle_escape(x[0])}"{suffix}'
        op, *args = x
        if op == "inverse":
            return f"ObjectInverseOf({show(args[0])})"
        if op == "restriction":
            facets = " ".join(f'<{T.XSD}{n}> "{v}"^^<{args[0]}>' for n, v in args[1:])
            return f"DatatypeRestriction(<{args[0]}> {facets})"
        if op in count:
            return f"{count[op]}({args[0]} {' '.join(map(show, args[1:]))})"
        return f"{expression[op]}({' '.join(map(show, args))})"

    lines = []
    for kind, *args in axioms:
        if kind == "Declaration":
            lines.append(f"Declaration({declare[args[0]]}(<{args[1]}>))")
        elif kind == "SubPropertyChainOf":
            lines.append(f"SubObjectPropertyOf(ObjectPropertyChain({' '.join(map(show, args[0]))}) {show(args[1])})")
        elif kind == "HasKey":
            lines.append(f"HasKey({show(args[0])} ({' '.join(map(show, args[1]))}) ())")
        else:
            lines.append(f"{kind}({' '.join(map(show, args))})")
    return "Ontology(\n" + "\n".join(lines) + "\n)\n"

"""Manchester syntax: frames, and class expressions in infix or prefix form."""

from __future__ import annotations

import re

from ontoweave.functions import terms as T
from ontoweave.sources.turtle import ParseError

TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>\s]+>)
    |(?P<str>"(?:[^"\\]|\\.)*")
    |(?P<lang>@[A-Za-z-]+)
    |(?P<section>[A-Z][A-Za-z]*:(?=[\s<]|$))
    |(?P<prefix>(?:[A-Za-z][\w.-]*)?:(?=\s*<))
    |(?P<num>[+-]?\d+(?:\.\d+)?)
    |(?P<word>_:[\w.-]+|(?:[A-Za-z][\w.-]*)?:[\w.-]+|[A-Za-z][\w.-]*)
    |(?P<op>\^\^|<=|>=|[(){}\[\],<>])""",
    re.VERBOSE | re.DOTALL,
)
_DATATYPES = {n: T.XSD + n for n in ("integer", "decimal", "float", "double", "string", "boolean", "dateTime", "int", "long")}
_FACET = {">=": "minInclusive", "<=": "maxInclusive", ">": "minExclusive", "<": "maxExclusive", "length": "length", "minLength": "minLength", "maxLength": "maxLength", "pattern": "pattern"}
_CHARACTERISTIC = {n: f"{n}ObjectProperty" for n in ("Functional", "InverseFunctional", "Transitive", "Symmetric", "Asymmetric", "Reflexive", "Irreflexive")}
_FRAMES = {"Class:": "class", "ObjectProperty:": "object_property", "DataProperty:": "data_property", "AnnotationProperty:": "annotation_property", "Individual:": "individual", "Datatype:": "datatype"}


class Reader:
    def __init__(self, text: str, base: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected {text[at : at + 20]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at, self.prefixes, self.data = 0, T.PREFIXES | {"": base}, set()
        for i, (kind, text_) in enumerate(self.tokens):  # data properties must be known before they are used
            if (kind, text_) == ("section", "DataProperty:"):
                self.data.add(i + 1)
        self.base = base

    def next(self, what: str | None = None):
        if self.at >= len(self.tokens):
            raise ParseError("unexpected end")
        t = self.tokens[self.at]
        if what and t[1] != what:
            raise ParseError(f"expected {what!r}, found {t[1]!r}")
        self.at += 1
        return t

    def peek(self, k: int = 0):
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def accept(self, text: str) -> bool:
        if self.peek()[1] == text:
            self.at += 1
            return True
        return False

    def name(self, token=None) -> str:
        kind, text = token or self.next()
        if kind == "iri":
            return text[1:-1]
        if kind != "word":
            raise ParseError(f"expected a name, found {text!r}")
        if text.startswith("_:"):
            return text
        if ":" in text:
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise ParseError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + local
        return _DATATYPES.get(text) or self.prefixes[""] + text

    def read(self) -> list[tuple]:
        while self.peek()[1] == "Prefix:":
            self.next()
            prefix = self.next()[1].removesuffix(":")
            self.prefixes[prefix] = self.next()[1][1:-1]
        self.data = {self.name(self.tokens[i]) for i in self.data}
        out = []
        while self.peek()[0] != "end":
            section = self.next()[1]
            if section == "Ontology:":
                while self.peek()[0] in ("iri", "word"):
                    self.next()
            elif section == "Import:":
                out.append(("Import", self.next()[1][1:-1]))
            elif section in _FRAMES:
                me = self.name()
                out.append(("Declaration", _FRAMES[section], me))
                while self.peek()[0] == "section" and self.peek()[1] not in _FRAMES and self.peek()[1] not in ("Import:", "DisjointClasses:", "EquivalentClasses:", "SameIndividual:", "DifferentIndividuals:"):
                    out += self.clause(_FRAMES[section], me, self.next()[1])
            elif section in ("DisjointClasses:", "EquivalentClasses:"):
                out.append((section[:-1], *self.listed(self.expression)))
            elif section in ("SameIndividual:", "DifferentIndividuals:"):
                out.append((section[:-1], *self.listed(self.name)))
            else:
                raise ParseError(f"unexpected {section!r}")
        return out

    def listed(self, one) -> list:
        out = [one()]
        while self.accept(","):
            out.append(one())
        return out

    def clause(self, frame: str, me: str, section: str) -> list[tuple]:
        e = self.expression
        if section == "Annotations:":
            return [("AnnotationAssertion", p, me, v) for p, v in self.listed(self.fact)]
        if frame == "class":
            if section == "SubClassOf:":
                return [("SubClassOf", me, x) for x in self.listed(e)]
            if section in ("EquivalentTo:", "DisjointWith:"):
                return [("EquivalentClasses" if section == "EquivalentTo:" else "DisjointClasses", me, x) for x in self.listed(e)]
            if section == "DisjointUnionOf:":
                return [("DisjointUnion", me, *self.listed(e))]
            if section == "HasKey:":
                return [("HasKey", me, tuple(self.listed(self.name)))]
        if frame in ("object_property", "data_property"):
            kind = "Object" if frame == "object_property" else "Data"
            if section == "SubPropertyOf:":
                return [(f"Sub{kind}PropertyOf", me, x) for x in self.listed(self.property)]
            if section == "Domain:":
                return [(f"{kind}PropertyDomain", me, x) for x in self.listed(e)]
            if section == "Range:":
                return [(f"{kind}PropertyRange", me, x) for x in self.listed(e if kind == "Object" else self.data_range)]
            if section == "Characteristics:":
                names = self.listed(lambda: self.next()[1])
                return [(_CHARACTERISTIC[n] if kind == "Object" else f"{n}DataProperty", me) for n in names]
            if section == "InverseOf:":
                return [("InverseObjectProperties", me, x) for x in self.listed(self.name)]
            if section == "EquivalentTo:":
                return [(f"Equivalent{kind}Properties", me, x) for x in self.listed(self.name)]
            if section == "DisjointWith:":
                return [(f"Disjoint{kind}Properties", me, x) for x in self.listed(self.name)]
            if section == "SubPropertyChain:":
                chain = [self.property()]
                while self.accept("o"):
                    chain.append(self.property())
                return [("SubPropertyChainOf", tuple(chain), me)]
        if frame == "individual":
            if section == "Types:":
                return [("ClassAssertion", x, me) for x in self.listed(e)]
            if section == "Facts:":
                out = []
                for negative, (p, v) in self.listed(lambda: (self.accept("not"), self.fact())):
                    kind = "DataPropertyAssertion" if isinstance(v, tuple) else "ObjectPropertyAssertion"
                    out.append((("Negative" if negative else "") + kind, p, me, v))
                return out
            if section in ("SameAs:", "DifferentFrom:"):
                return [("SameIndividual" if section == "SameAs:" else "DifferentIndividuals", me, x) for x in self.listed(self.name)]
        raise ParseError(f"{section!r} in a frame of a {frame}")

    def fact(self) -> tuple:
        p = self.name()
        return p, self.literal() if self.peek()[0] in ("str", "num") or self.peek()[1] in ("true", "false") else self.name()

    def literal(self) -> tuple:
        kind, text = self.next()
        if kind == "num":
            return (text, T.DECIMAL if "." in text else T.INTEGER, None)
        if kind == "word":
            return (text, T.BOOLEAN, None)
        body = T.turtle_unescape(text[1:-1])
        if self.accept("^^"):
            return (body, self.name(), None)
        if self.peek()[0] == "lang":
            return (body, T.LANG_STRING, self.next()[1][1:].lower())
        return (body, T.STRING, None)

    # Expressions
    def expression(self):
        return self._chain("or", self.conjunction)

    def conjunction(self):
        first = self.primary()
        parts = [first]
        while self.accept("and") or self.accept("that"):
            parts.append(self.primary())
        return parts[0] if len(parts) == 1 else ("and", *parts)

    def _chain(self, word: str, one):
        parts = [one()]
        while self.accept(word):
            parts.append(one())
        return parts[0] if len(parts) == 1 else (word, *parts)

    def property(self):
        if self.accept("inverse"):
            paren = self.accept("(")
            out = ("inverse", self.name())
            if paren:
                self.next(")")
            return out
        return self.name()

    def primary(self):
        kind, text = self.peek()
        if text == "not":
            self.next()
            return ("not", self.primary())
        if text == "(":
            self.next()
            if self.peek()[1] in ("and", "or", "not"):  # prefix form
                op = self.next()[1]
                parts = []
                while self.peek()[1] != ")":
                    parts.append(self.primary())
                self.next(")")
                return (op, *parts)
            out = self.expression()
            self.next(")")
            return out
        if text == "{":
            self.next()
            out = ("one", *self.listed(self.name))
            self.next("}")
            return out
        if text == "inverse" or self.peek(1)[1] in ("some", "only", "value", "Self", "min", "max", "exactly"):
            return self.restriction()
        return self.name()

    def restriction(self):
        p = self.property()
        word = self.next()[1]
        if word in ("some", "only"):
            if p in self.data or self.peek()[1] in _DATATYPES or self.peek()[1].startswith("xsd:"):
                return ("d" + word, p, self.data_range())
            return (word, p, self.primary())
        if word == "value":
            return ("dvalue", p, self.literal()) if self.peek()[0] in ("str", "num") or self.peek()[1] in ("true", "false") else ("value", p, self.name())
        if word == "Self":
            return ("self", p)
        n = int(self.next()[1])
        op = "exact" if word == "exactly" else word
        if p in self.data:
            return ("d" + op, n, p)
        kind, text = self.peek()
        more = kind in ("word", "iri") and text not in ("and", "or", "that", "o") or text in ("(", "{")
        return (op, n, p, self.primary()) if more else (op, n, p)

    def data_range(self):
        def one():
            if self.accept("not"):
                return ("not", one())
            if self.accept("("):
                out = self.data_range()
                self.next(")")
                return out
            if self.accept("{"):
                out = ("one", *self.listed(self.literal))
                self.next("}")
                return out
            base = self.name()
            if not self.accept("["):
                return base
            facets = self.listed(lambda: (_FACET[self.next()[1]], self.literal()[0]))
            self.next("]")
            return ("restriction", base, *facets)

        return self._chain("or", lambda: self._chain("and", one))


def parse(text: str, base: str = "http://example.org/") -> list[tuple]:
    """Axioms of a document; names without a prefix are local to ``base``."""
    return Reader(text, base).read()


def parse_expression(text: str, base: str = "http://example.org/"):
    r = Reader(text, base)
    r.data = set()
    out = r.expression()
    if r.peek()[0] != "end":
        raise ParseError(f"unexpected {r.peek()[1]!r}")
    return out

"""Turtle: a tokenizer and a recursive-descent parser for one document (prefixes make it sequential)."""

from __future__ import annotations

import re

from ontoweave.functions import terms as T

TOKEN = re.compile(
    r"""\s+|\#[^\n\r]*
    |(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<str>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bnode>_:\w(?:[\w.-]*[\w-])?)
    |(?P<num>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+))
    |(?P<qname>(?:[^\W\d_][\w.-]*)?:(?:[\w:%](?:[\w.:%-]*[\w:%-])?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<op>\^\^|[.;,\[\]()])""",
    re.VERBOSE | re.DOTALL,
)


class ParseError(ValueError):
    """The document is malformed."""


class Reader:
    def __init__(self, text: str, base: str = "", document: str = "doc"):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected {text[at : at + 20]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at, self.prefixes, self.base, self.document, self.fresh = 0, {}, base, document, 0
        self.triples: list[tuple] = []

    def next(self, what: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ParseError("unexpected end")
        t = self.tokens[self.at]
        if what is not None and t[1] != what:
            raise ParseError(f"expected {what!r}, found {t[1]!r}")
        self.at += 1
        return t

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def node(self) -> str:
        """Blank nodes are named by document and order, never at random."""
        self.fresh += 1
        return f"_:{self.document}{self.fresh}"

    def add(self, s: str, p: str, o: tuple) -> None:
        self.triples.append((s, p, *o))

    def read(self) -> list[tuple]:
        while self.at < len(self.tokens):
            kind, text = self.peek()
            if kind == "directive" or (kind == "word" and text.upper() in ("PREFIX", "BASE")):
                self.next()
                if text.lower().endswith("prefix"):
                    name = self.next()[1].removesuffix(":")
                    self.prefixes[name] = self.iri()
                else:
                    self.base = self.iri()
                if kind == "directive":
                    self.next(".")
                continue
            if text == "[":
                subject = self.blank()
                if self.peek()[1] != ".":
                    self.predicates(subject)
            else:
                subject = self.object()
                if subject[1] == "lit":
                    raise ParseError(f"literal as subject: {subject[0]!r}")
                self.predicates(subject[0])
            self.next(".")
        return self.triples

    def predicates(self, subject: str) -> None:
        while True:
            kind, text = self.peek()
            predicate = T.TYPE if (kind, text) == ("word", "a") else None
            if predicate:
                self.next()
            else:
                predicate = self.iri()
            while True:
                self.add(subject, predicate, self.object())
                if self.peek()[1] != ",":
                    break
                self.next()
            while self.peek()[1] == ";":
                self.next()
                more = self.peek()[1] not in (".", "]", ";")
                if more:
                    break
            else:
                return
            if not more:
                return

    def iri(self) -> str:
        kind, text = self.next()
        if kind == "iri":
            iri = T.turtle_unescape(text[1:-1])
            if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
                return iri
            from urllib.parse import urljoin

            return urljoin(self.base, iri) if self.base else iri
        if kind == "qname":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise ParseError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + local
        raise ParseError(f"expected an IRI, found {text!r}")

    def blank(self) -> str:
        self.next("[")
        me = self.node()
        if self.peek()[1] != "]":
            self.predicates(me)
        self.next("]")
        return me

    def object(self) -> tuple:
        """``(value, kind, datatype, language)``."""
        kind, text = self.peek()
        if text == "[" and kind == "op":
            return self.blank(), "bnode", None, None
        if text == "(" and kind == "op":
            self.next()
            items = []
            while self.peek()[1] != ")":
                items.append(self.object())
            self.next(")")
            head = T.NIL
            for item in reversed(items):
                me = self.node()
                self.add(me, T.FIRST, item)
                self.add(me, T.REST, (head, "iri" if head == T.NIL else "bnode", None, None))
                head = me
            return head, "iri" if head == T.NIL else "bnode", None, None
        if kind == "bnode":
            self.next()
            return "_:" + self.document + "." + text[2:], "bnode", None, None
        if kind == "str":
            self.next()
            body = T.turtle_unescape(text[3:-3] if len(text) > 5 and text[:3] in ('"""', "'''") else text[1:-1])
            if self.peek()[0] == "lang":
                return body, "lit", T.LANG_STRING, self.next()[1][1:].lower()
            if self.peek()[1] == "^^":
                self.next()
                return body, "lit", self.iri(), None
            return body, "lit", T.STRING, None
        if kind == "num":
            self.next()
            return text, "lit", T.DOUBLE if "e" in text.lower() else T.DECIMAL if "." in text else T.INTEGER, None
        if kind == "word" and text in ("true", "false"):
            self.next()
            return text, "lit", T.BOOLEAN, None
        return self.iri(), "iri", None, None


def parse(text: str, base: str = "", document: str = "doc") -> list[tuple]:
    """Triples ``(s, p, o, kind, datatype, language)`` of one document."""
    return Reader(text, base, document).read()

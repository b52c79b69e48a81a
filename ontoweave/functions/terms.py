"""Vocabulary and scalar functions over terms, as Column expressions wherever Spark has the means."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE, FIRST, REST, NIL = RDF + "type", RDF + "first", RDF + "rest", RDF + "nil"
STATEMENT, LANG_STRING = RDF + "Statement", RDF + "langString"
SUBCLASS, SUBPROP, DOMAIN, RANGE = RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"
THING, NOTHING, SAME_AS = OWL + "Thing", OWL + "Nothing", OWL + "sameAs"
STRING, INTEGER, BOOLEAN, DECIMAL, DOUBLE, DATETIME = (XSD + n for n in ("string", "integer", "boolean", "decimal", "double", "dateTime"))
NUMERIC = [XSD + n for n in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")]
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD}

TRIPLE = "s string, p string, o string, o_kind string, o_dt string, o_lang string"


def local_name(iri: Column) -> Column:
    """What follows the last ``#``, else the last ``/``."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))


def namespace(iri: Column) -> Column:
    """Everything up to and with the last ``#`` or else ``/``."""
    return iri.substr(F.lit(1), F.length(iri) - F.length(local_name(iri)))


def in_namespace(iri: Column, base: str) -> Column:
    return iri.startswith(base)


def expand_qname(qname: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """``prefix:local`` by a fixed map of prefixes; null for an unknown prefix."""
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    prefix = F.substring_index(qname, ":", 1)
    return F.concat(F.try_element_at(table, prefix), qname.substr(F.length(prefix) + 2, F.length(qname)))


def curie_parts(curie: Column) -> Column:
    """Prefix and local part as a struct; null without a colon."""
    at = F.instr(curie, ":")
    return F.when(at > 0, F.struct(curie.substr(F.lit(1), at - 1).alias("prefix"), curie.substr(at + 1, F.length(curie)).alias("local")))


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


XML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def escape_xml(text: Column) -> Column:
    for plain, entity in XML_ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape_xml(text: Column) -> Column:
    for plain, entity in reversed(XML_ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def parse_boolean(text: Column) -> Column:
    return F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False))


def parse_integer(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def parse_float(text: Column) -> Column:
    return text.try_cast("double")


def valid_iri(iri: Column) -> Column:
    """A scheme and a colon, no spaces, controls or delimiters, 2048 characters at most."""
    return F.coalesce(iri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`\x00-\x20]*$") & (F.length(iri) <= 2048), F.lit(False))


def float_neighbours(value: float) -> tuple[float, float]:
    """The single-precision numbers next below and next above."""
    x = np.float32(value)
    return float(np.nextafter(x, np.float32(-np.inf))), float(np.nextafter(x, np.float32(np.inf)))


def empty_float_range(low: float | None, high: float | None, low_open: bool = False, high_open: bool = False) -> bool:
    """Whether no xsd:float lies between the bounds."""
    if low is None or high is None:
        return False
    least = float_neighbours(low)[1] if low_open else float(np.float32(low))
    most = float_neighbours(high)[0] if high_open else float(np.float32(high))
    return least > most


def turtle_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def turtle_unescape(text: str) -> str:
    """Undo ``\\n``-like, ``\\uXXXX`` and ``\\UXXXXXXXX`` escapes."""
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text, flags=re.DOTALL)

"""Import resolution: the union of a graph with all that it imports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from ontoweave.model import KnowledgeGraph
from ontoweave.sources import formats


class ImportError_(ValueError):
    """An import can't be resolved."""


class Resolver:
    """Resolves imports through sources, tried in order; each maps an IRI to a document's text or None.

    Depth is bounded, cycles are visited once, and texts are kept for ``ttl`` seconds.
    """

    def __init__(self, sources: Iterable[Callable[[str], str | None]], max_depth: int = 10, ttl: float = 3600, strict: bool = True):
        self.sources, self.max_depth, self.ttl, self.strict = list(sources), max_depth, ttl, strict
        self._kept: dict[str, tuple[float, str]] = {}

    def text(self, iri: str) -> str | None:
        held = self._kept.get(iri)
        if held and time.monotonic() - held[0] < self.ttl:
            return held[1]
        for source in self.sources:
            if (found := source(iri)) is not None:
                self._kept[iri] = (time.monotonic(), found)
                return found
        return None

    def resolve(self, graph: KnowledgeGraph) -> KnowledgeGraph:
        """All imports, and theirs, merged: triples as a set, axioms once each."""
        triples, axioms = graph.triples, list(graph.axioms)
        seen: set[str] = set()
        todo = [(x[1], 1) for x in graph.axioms if x[0] == "Import"]
        while todo:
            iri, depth = todo.pop(0)
            if iri in seen:
                continue
            seen.add(iri)
            if depth > self.max_depth:
                raise ImportError_(f"imports are more than {self.max_depth} deep at {iri}")
            text = self.text(iri)
            if text is None:
                if self.strict:
                    raise ImportError_(f"no source has {iri}")
                continue
            one = formats.load(graph.spark, text)
            triples = triples.unionByName(one.triples)
            axioms += one.axioms
            todo += [(x[1], depth + 1) for x in one.axioms if x[0] == "Import"]
        return KnowledgeGraph(graph.spark, triples.distinct(), list(dict.fromkeys(axioms)), graph.axioms_in_triples)


def registry(documents: dict[str, str]) -> Callable[[str], str | None]:
    """A source over texts at hand."""
    return documents.get


def folder(spark, path: str, extension: str = "ttl") -> Callable[[str], str | None]:
    """A source over files named by the IRI's last part, read through Spark."""
    def find(iri: str) -> str | None:
        from pyspark.errors import AnalysisException

        name = iri.rstrip("/#").rsplit("/", 1)[-1]
        try:
            row = spark.read.text(f"{path}/{name}.{extension}", wholetext=True).first()
        except AnalysisException:
            return None
        return row[0] if row else None

    return find


def merge(a: KnowledgeGraph, b: KnowledgeGraph) -> KnowledgeGraph:
    """Set union of two graphs."""
    return KnowledgeGraph(a.spark, a.triples.unionByName(b.triples).distinct(), list(dict.fromkeys(a.axioms + b.axioms)), a.axioms_in_triples or b.axioms_in_triples)

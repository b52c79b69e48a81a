"""One object with the questions that a reasoner answers; the work is done by the plans."""

from __future__ import annotations

from functools import cached_property
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.model import KnowledgeGraph
from ontoweave.plans import expressions, profiles, reason
from ontoweave.plans.tableau import Tableau


class Reasoner(Protocol):
    """What any reasoner over a graph offers."""

    def is_consistent(self) -> bool: ...
    def is_satisfiable(self, expression) -> bool: ...
    def is_subclass_of(self, sub: str, sup: str) -> bool: ...
    def are_equivalent(self, a: str, b: str) -> bool: ...
    def are_disjoint(self, a: str, b: str) -> bool: ...
    def instances(self, expression) -> DataFrame: ...


class GraphReasoner:
    """Answers by closures over the graph; ``complete=True`` asks the tableau about classes as well.

    Closures find what follows from named classes; the tableau also sees into expressions, for a
    vocabulary that fits the driver and within a bounded number of steps.
    """

    def __init__(self, graph: KnowledgeGraph, complete: bool = False, limit: int = 20_000):
        self.graph, self.complete, self.limit = graph, complete, limit

    @cached_property
    def tableau(self) -> Tableau:
        return Tableau(self.graph.axioms, self.limit)

    def is_consistent(self) -> bool:
        return reason.is_consistent(self.graph)

    def explanations(self, most: int = 10) -> DataFrame:
        return reason.minimal_explanations(reason.clashes(self.graph), most)

    def is_satisfiable(self, expression) -> bool:
        if self.complete or not isinstance(expression, str):
            return self.tableau.is_satisfiable(expression)
        return reason.unsatisfiable_classes(self.graph).where(F.col("cls") == expression).isEmpty()

    def is_subclass_of(self, sub, sup) -> bool:
        if isinstance(sub, str) and isinstance(sup, str) and reason.is_subclass_of(self.graph, sub, sup):
            return True
        return self.complete and self.tableau.subsumes(sup, sub)

    def are_equivalent(self, a, b) -> bool:
        return self.is_subclass_of(a, b) and self.is_subclass_of(b, a)

    def are_disjoint(self, a: str, b: str) -> bool:
        low, high = sorted((a, b))
        if not reason.disjoint_classes(self.graph).where((F.col("a") == low) & (F.col("b") == high)).isEmpty():
            return True
        return self.complete and not self.tableau.is_satisfiable(("and", a, b))

    def instances(self, expression) -> DataFrame:
        """``(x)``; a named class with all below it, or an expression's known members."""
        if isinstance(expression, str):
            return reason.instances(self.graph, expression)
        return expressions.members(self.graph, expression)

    def is_instance_of(self, individual: str, expression) -> bool:
        return not self.instances(expression).where(F.col("x") == individual).isEmpty()

    def conforms_to(self, profile: str) -> bool:
        return profiles.VALIDATORS[profile](self.graph).where("severity = 'error'").isEmpty()

"""EL, QL and RL profile violations as rows, and reports on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.plans.expressions import flatten

#: What the left and right sides of class axioms may be made of.
EL_EXPRESSIONS = ("class", "and", "some", "value", "self", "one", "individual", "dsome", "dvalue")
QL_RIGHT = ("class", "and", "some", "not", "dsome")


def _rows(spark, rows) -> DataFrame:
    return spark.createDataFrame(sorted(rows), "violation string, subject string, severity string")


def _subject(args) -> str:
    return next((a for a in args if isinstance(a, str)), "")


def _of_nodes(nodes: DataFrame, where, violation: str, severity: str = "error") -> DataFrame:
    return nodes.where(where).select(F.lit(violation).alias("violation"), F.coalesce("arg", F.lit("")).alias("subject"), F.lit(severity).alias("severity"))


def el_violations(kg, strict: bool = True) -> DataFrame:
    """EL: no disjointness, at most two equivalent classes, right sides of named classes, ∃ and ∩ only.

    With ``strict=False`` any disjointness or equivalence counts, and expressions are not looked into.
    """
    rows = [("disjoint_classes", _subject(a), "error") for k, *a in kg.axioms if k == "DisjointClasses"]
    rows += [("equivalent_classes", _subject(a), "error") for k, *a in kg.axioms if k == "EquivalentClasses" and (not strict or len(a) > 2)]
    if not strict:
        return _rows(kg.spark, rows)
    rows += [(k, a[0], "error") for k, *a in kg.axioms if k in ("InverseObjectProperties", "SymmetricObjectProperty", "AsymmetricObjectProperty", "IrreflexiveObjectProperty", "FunctionalObjectProperty", "InverseFunctionalObjectProperty")]
    nodes = flatten(kg.spark, kg.axioms)
    return _rows(kg.spark, rows).union(_of_nodes(nodes, ~F.col("op").isin(*EL_EXPRESSIONS), "expression").withColumn("violation", F.lit("expression"))).union(_of_nodes(nodes, (F.col("op") == "individual") & (F.col("pos") > 0), "nominal_with_several"))


def ql_violations(kg, strict: bool = True) -> DataFrame:
    """QL: no transitive or asymmetric properties, min at most 1, no max or exact, chains of two at most."""
    kinds = ["TransitiveObjectProperty", "AsymmetricObjectProperty"] + ([] if strict else ["IrreflexiveObjectProperty"])
    rows = [(k, a[0], "error") for k, *a in kg.axioms if k in kinds]
    if not strict:
        return _rows(kg.spark, rows)
    rows += [("property_chain", a[1], "error") for k, *a in kg.axioms if k == "SubPropertyChainOf" and len(a[0]) > 2]
    nodes = flatten(kg.spark, kg.axioms)
    min_ = F.col("op").isin("min", "dmin") & (F.col("card") > 1)
    most = F.col("op").isin("max", "exact", "dmax", "dexact")
    return _rows(kg.spark, rows).union(_of_nodes(nodes, min_, "min_cardinality")).union(_of_nodes(nodes, most, "max_cardinality"))


def rl_violations(kg, strict: bool = True) -> DataFrame:
    """RL: no complement, no self restriction; nominals of several individuals are a warning."""
    if not strict:
        return _rows(kg.spark, [])
    nodes = flatten(kg.spark, kg.axioms)
    several = nodes.where("op = 'individual'").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("nominal_with_several").alias("violation"), F.lit("").alias("subject"), F.lit("warning").alias("severity"))
    return _of_nodes(nodes, F.col("op") == "not", "complement").union(_of_nodes(nodes, F.col("op") == "self", "self_restriction")).union(several)


VALIDATORS = {"EL": el_violations, "QL": ql_violations, "RL": rl_violations}


def violations(kg, strict: bool = True) -> DataFrame:
    """``(profile, violation, subject, severity)`` for all three."""
    parts = [f(kg, strict).select(F.lit(name).alias("profile"), "violation", "subject", "severity") for name, f in VALIDATORS.items()]
    return reduce(lambda a, b: a.union(b), parts)


def profiles(kg, strict: bool = True) -> DataFrame:
    """``(profile, conforms)``; warnings do not count."""
    bad = violations(kg, strict).where("severity = 'error'").groupBy("profile").agg(F.count(F.lit(1)).alias("n"))
    names = kg.spark.createDataFrame([(n,) for n in VALIDATORS], "profile string")
    return names.join(bad, "profile", "left").select("profile", F.col("n").isNull().alias("conforms"))


def most_restrictive(kg) -> str | None:
    """The first profile that the graph conforms to, in the order EL, QL, RL."""
    ok = {r["profile"] for r in profiles(kg).where("conforms").collect()}
    return next((n for n in VALIDATORS if n in ok), None)


def report(kg) -> DataFrame:
    """``(profile, violation, n, effort)``: counts by construct, and the effort to mend the profile's errors.

    Effort is high beyond ten errors, medium beyond three, else low.
    """
    v = violations(kg)
    by = v.groupBy("profile", "violation").agg(F.count(F.lit(1)).alias("n"))
    total = v.where("severity = 'error'").groupBy("profile").agg(F.count(F.lit(1)).alias("errors"))
    effort = F.when(F.col("errors") > 10, "high").when(F.col("errors") > 3, "medium").otherwise("low")
    return by.join(total, "profile", "left").select("profile", "violation", "n", effort.alias("effort"))

"""Classification, instances, materialisation, equality and consistency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.functions import terms as T
from ontoweave.plans.closure import closure
from ontoweave.plans.components import components
from ontoweave.plans.storage import discard, materialize


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# Hierarchy
def classify(kg) -> DataFrame:
    """``(sub, sup)``: the closure with owl:Thing above all classes and owl:Nothing below them."""
    found = kg.class_closure()
    names = kg.class_edges()
    classes = names.select("sub").union(names.select("sup")).union(kg.members("DisjointClasses").select("member"))
    classes = classes.toDF("c").where((F.col("c") != T.THING) & (F.col("c") != T.NOTHING)).distinct()
    top = classes.select(F.col("c").alias("sub"), F.lit(T.THING).alias("sup"))
    bottom = classes.select(F.lit(T.NOTHING).alias("sub"), F.col("c").alias("sup"))
    return found.union(top).union(bottom).union(kg.spark.createDataFrame([(T.NOTHING, T.THING)], "sub string, sup string")).distinct()


def superclasses(kg, cls: str) -> DataFrame:
    return kg.class_closure().where((F.col("sub") == cls) & (F.col("sup") != cls)).select("sup")


def subclasses(kg, cls: str) -> DataFrame:
    return kg.class_closure().where((F.col("sup") == cls) & (F.col("sub") != cls)).select("sub")


def is_subclass_of(kg, sub: str, sup: str) -> bool:
    """Reflexive."""
    return sub == sup or sup == T.THING or sub == T.NOTHING or not kg.class_closure().where((F.col("sub") == sub) & (F.col("sup") == sup)).isEmpty()


def equivalent_classes(kg) -> DataFrame:
    """``(a, b)`` with a < b, each subsuming the other."""
    c = kg.class_closure()
    back = c.select(F.col("sup").alias("sub"), F.col("sub").alias("sup"))
    return c.join(back, ["sub", "sup"]).where("sub < sup").select(F.col("sub").alias("a"), F.col("sup").alias("b"))


def direct_edges(kg) -> DataFrame:
    """The transitive reduction: ``(sub, sup)`` with no class strictly between."""
    c = kg.class_closure().where("sub <> sup")
    back = c.select(F.col("sup").alias("sub"), F.col("sub").alias("sup"))
    strict = c.join(back, ["sub", "sup"], "left_anti")
    between = strict.select("sub", F.col("sup").alias("m")).join(strict.select(F.col("sub").alias("m"), "sup"), "m").select("sub", "sup")
    return strict.join(between, ["sub", "sup"], "left_anti")


def asserted_parents(kg) -> DataFrame:
    """``(sub, parents)``: asserted direct superclasses, sorted."""
    return kg.pairs("SubClassOf").groupBy("sub").agg(F.sort_array(F.collect_set("sup")).alias("parents"))


def disjoint_classes(kg) -> DataFrame:
    """``(a, b)`` with a < b: declared disjoint, or below two that are."""
    d = kg.member_pairs("DisjointClasses")
    below = kg.class_closure().union(_reflexive(kg)).distinct()
    x = d.join(below.select(F.col("sup").alias("a"), F.col("sub").alias("x")), "a")
    y = x.join(below.select(F.col("sup").alias("b"), F.col("sub").alias("y")), "b")
    return y.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _reflexive(kg) -> DataFrame:
    """Every class below itself."""
    e = kg.class_edges()
    c = e.select("sub").union(e.select("sup")).union(kg.members("DisjointClasses").select("member")).toDF("c").distinct()
    return c.select(F.col("c").alias("sub"), F.col("c").alias("sup"))


def unsatisfiable_classes(kg) -> DataFrame:
    """``(cls)``: below owl:Nothing, or below two disjoint classes, or below such a class."""
    up = kg.class_closure().union(_reflexive(kg)).distinct()
    nothing = up.where(F.col("sup") == T.NOTHING).select(F.col("sub").alias("cls"))
    d = kg.member_pairs("DisjointClasses")
    torn = d.join(up.select(F.col("sup").alias("a"), F.col("sub").alias("cls")), "a").join(up.select(F.col("sup").alias("b"), F.col("sub").alias("cls")), ["b", "cls"]).select("cls")
    alone = kg.spark.createDataFrame([(x[1],) for x in kg.axioms if x[0] == "DisjointClasses" and len(set(x[1:])) < len(x[1:])], "cls string")
    roots = nothing.union(torn).union(alone).distinct()
    return up.join(roots.select(F.col("cls").alias("sup")), "sup").select(F.col("sub").alias("cls")).union(roots).where(F.col("cls") != T.NOTHING).distinct()


def hierarchy_counts(kg) -> DataFrame:
    """``(what, n)``: subsumptions, equivalent and disjoint pairs."""
    parts = [("subsumptions", kg.class_closure().where("sub <> sup")), ("equivalences", equivalent_classes(kg)), ("disjointnesses", disjoint_classes(kg))]
    return _union([d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("what"), "n") for k, d in parts])


# Instances
def inherited_types(kg) -> DataFrame:
    """``(x, cls)`` as asserted, and for all superclasses; the closure makes it one join."""
    t = kg.types()
    up = t.join(kg.class_closure().select(F.col("sub").alias("cls"), "sup"), "cls").select("x", F.col("sup").alias("cls"))
    return t.union(up).distinct()


def inherited_types_of(kg, classes: list[str]) -> DataFrame:
    """``(x, cls)`` with ``cls`` one of ``classes``, asserted or inherited; only classes below them are looked up."""
    below = kg.class_closure().where(F.col("sup").isin(classes) & (F.col("sub") != F.col("sup"))).select(F.col("sub").alias("cls"), "sup")
    below = below.union(kg.spark.createDataFrame([(c, c) for c in classes], "cls string, sup string"))
    names = [r["cls"] for r in below.select("cls").distinct().collect()]  # a part of the vocabulary
    return kg.types_of(names).join(below, "cls").select("x", F.col("sup").alias("cls")).distinct()


def instances(kg, cls: str, inherited: bool = True) -> DataFrame:
    """``(x)``: only the classes below ``cls`` are looked up."""
    if not inherited:
        return kg.types_of([cls]).select("x").distinct()
    return inherited_types_of(kg, [cls]).select("x")


# Materialisation
RULES = ("property_hierarchy", "inverse", "symmetric", "transitive", "chain", "reflexive", "domain", "range", "subclass", "functional", "inverse_functional", "has_key", "same_as")


def property_edges(kg, rules=None) -> DataFrame:
    """``(s, p, o)`` with all edges that property axioms entail.

    Rounds join what the round before added with all that is known, until nothing is new. A transitive
    property doubles its paths each round, and a chain that ends (or begins) in itself takes all its
    other property's paths at once, so rounds grow with the logarithm of the longest path.
    """
    on = set(RULES if rules is None else rules)
    known = new = materialize(kg.edges().distinct(), "edges")
    up = kg.property_closure().where("sub <> sup") if "property_hierarchy" in on else None
    inverse = kg.pairs("InverseObjectProperties") if "inverse" in on else None
    both = None if inverse is None else inverse.union(inverse.select("q", "p")).toDF("p", "q")
    symmetric = kg.with_characteristic("SymmetricObjectProperty") if "symmetric" in on else []
    transitive = kg.with_characteristic("TransitiveObjectProperty") if "transitive" in on else []
    chains = [(tuple(x[1]), x[2]) for x in kg.axioms if x[0] == "SubPropertyChainOf"] if "chain" in on else []
    held = [known]  # tables that make up what is known
    while True:
        fresh = {r["p"] for r in new.select("p").distinct().collect()}  # as many as the vocabulary has
        own = lambda t, prop: t.where(F.col("p") == prop).select("s", "o")
        path = lambda x, y: x.withColumnRenamed("o", "_m").join(y.withColumnRenamed("s", "_m"), "_m").select("s", "o")
        parts = []
        if up is not None:
            parts.append(new.join(up.select(F.col("sub").alias("p"), "sup"), "p").select("s", F.col("sup").alias("p"), "o"))
        if both is not None:
            parts.append(new.join(both, "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o")))
        if fresh & set(symmetric):
            parts.append(new.where(F.col("p").isin(symmetric)).select(F.col("o").alias("s"), "p", F.col("s").alias("o")))
        for chain, sup in [*(((p, p), p) for p in transitive), *chains]:
            if not fresh & set(chain):
                continue
            found = []
            if len(chain) == 2 and sup in chain and chain[0] != chain[1]:
                every = [own(known, p) if p == sup else closure(own(known, p), "s", "o") for p in chain]
                found.append(path(*every))
            else:
                for i, prop in enumerate(chain):
                    if prop in fresh:
                        found.append(reduce(path, [own(new if i == j else known, p) for j, p in enumerate(chain)]))
            parts += [x.select("s", F.lit(sup).alias("p"), "o") for x in found]
        if not parts:
            break
        step = materialize(_union(parts).distinct().join(known, ["s", "p", "o"], "left_anti"), "edges")
        if step.isEmpty():
            discard(step)
            break
        new = step
        held.append(step)
        if len(held) > 8:  # short plans, whatever the rounds
            whole = materialize(_union(held), "edges")
            for t in held[:-1]:
                discard(t)
            held = [whole]
        known = _union(held)
    e = known
    if "reflexive" in on:
        for prop in kg.with_characteristic("ReflexiveObjectProperty"):
            nodes = e.select("s").union(e.select("o")).union(kg.types().select("x")).toDF("x").distinct()
            e = e.unionByName(nodes.select(F.col("x").alias("s"), F.lit(prop).alias("p"), F.col("x").alias("o"))).distinct()
    return e


def domain_range_types(kg, edges: DataFrame, rules=None) -> DataFrame:
    """``(x, cls)`` from domains and ranges."""
    on = set(RULES if rules is None else rules)
    parts = [kg.spark.createDataFrame([], "x string, cls string")]
    if "domain" in on:
        parts.append(edges.join(kg.pairs("ObjectPropertyDomain").withColumnRenamed("prop", "p"), "p").select(F.col("s").alias("x"), "cls"))
        literal = kg.triples.where("o_kind = 'lit'").select("s", "p").join(kg.pairs("DataPropertyDomain").withColumnRenamed("prop", "p"), "p")
        parts.append(literal.select(F.col("s").alias("x"), "cls"))
    if "range" in on:
        parts.append(edges.join(kg.pairs("ObjectPropertyRange").withColumnRenamed("prop", "p"), "p").select(F.col("o").alias("x"), "cls"))
    return _union(parts).distinct()


def same_edges(kg, edges: DataFrame, types: DataFrame, rules=None) -> DataFrame:
    """``(u, v)`` between individuals that must be equal: asserted, functional, inverse-functional, keys."""
    on = set(RULES if rules is None else rules)
    m = kg.members("SameIndividual")
    first = m.groupBy("axiom_id").agg(F.min("member").alias("u"))
    parts = [m.join(first, "axiom_id").select("u", F.col("member").alias("v"))]
    if "functional" in on:
        for prop in kg.with_characteristic("FunctionalObjectProperty"):
            e = edges.where(F.col("p") == prop)
            parts.append(e.join(e.groupBy("s").agg(F.min("o").alias("u")), "s").select("u", F.col("o").alias("v")))
    if "inverse_functional" in on:
        for prop in kg.with_characteristic("InverseFunctionalObjectProperty"):
            e = edges.where(F.col("p") == prop)
            parts.append(e.join(e.groupBy("o").agg(F.min("s").alias("u")), "o").select("u", F.col("s").alias("v")))
    if "has_key" in on:
        for _, cls, props in (x for x in kg.axioms if x[0] == "HasKey"):
            parts.append(key_pairs(kg, types, cls, props))
    return _union(parts).where("u <> v").distinct()


def key_pairs(kg, types: DataFrame, cls: str, props) -> DataFrame:
    """``(u, v)``: instances of ``cls`` that share a value of every key property, with the smallest such instance."""
    keyed = types.where(F.col("cls") == cls).select("x")
    for i, prop in enumerate(props):
        value = F.struct("o", "o_kind", F.coalesce("o_dt", F.lit("")).alias("t"), F.coalesce("o_lang", F.lit("")).alias("g"))
        keyed = keyed.join(kg.triples.where(F.col("p") == prop).select(F.col("s").alias("x"), value.alias(f"k{i}")), "x")
    keys = [f"k{i}" for i in range(len(props))]
    return keyed.join(keyed.groupBy(*keys).agg(F.min("x").alias("u")), keys).select("u", F.col("x").alias("v")).where("u <> v").distinct()


def same_components(edges: DataFrame) -> DataFrame:
    """``(x, rep)``: each individual of a non-trivial component and its smallest member."""
    found = components(edges)
    return found.join(found.groupBy("component").agg(F.min("node").alias("rep")), "component").select(F.col("node").alias("x"), "rep")


def rewrite(df: DataFrame, reps: DataFrame, column: str) -> DataFrame:
    """The column's individuals replaced by their representatives."""
    r = reps.select(F.col("x").alias(column), F.col("rep").alias("_rep"))
    return df.join(r, column, "left").withColumn(column, F.coalesce("_rep", column)).drop("_rep")


def materialize_graph(kg, rules=None):
    """The graph with all entailed triples about named individuals.

    Strata: property edges to a fixpoint, domain and range, then one join with the closed class
    hierarchy. Equal individuals are replaced by representatives; while that joins any, the strata
    run again; every time there are fewer individuals, so this ends. ``rules`` switches rules on by name. Anonymous witnesses of existentials are not made.
    """
    from ontoweave.model import KnowledgeGraph

    on = set(RULES if rules is None else rules)
    now = kg
    while True:
        edges = property_edges(now, on)
        types = now.types().unionByName(domain_range_types(now, edges, on)).distinct()
        if "subclass" in on:
            up = types.join(now.class_closure().select(F.col("sub").alias("cls"), "sup"), "cls").select("x", F.col("sup").alias("cls"))
            types = types.unionByName(up).distinct()
        types = materialize(types, "types")
        reps = None
        if "same_as" in on:
            pairs = materialize(same_edges(now, edges, types, on), "same")
            reps = None if pairs.isEmpty() else same_components(pairs)
        literals = now.triples.where("o_kind = 'lit'")
        if reps is not None:
            edges = rewrite(rewrite(edges, reps, "s"), reps, "o").select("s", "p", "o").distinct()
            types = rewrite(types, reps, "x").select("x", "cls").distinct()
            literals = rewrite(literals, reps, "s").select(*now.triples.columns).distinct()
        none = F.lit(None).cast("string")
        kind = lambda c: F.when(F.col(c).startswith("_:"), "bnode").otherwise("iri")
        out = edges.select("s", "p", "o", kind("o").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
        out = out.unionByName(types.select(F.col("x").alias("s"), F.lit(T.TYPE).alias("p"), F.col("cls").alias("o"), kind("cls").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang")))
        triples = materialize(out.unionByName(literals), "triples")
        axioms = [x for x in now.axioms if x[0] != "SameIndividual"] if reps is not None else now.axioms
        now = KnowledgeGraph(kg.spark, triples, axioms, kg.axioms_in_triples)
        if reps is None:
            break
    return KnowledgeGraph(kg.spark, now.triples, kg.axioms, kg.axioms_in_triples)


# Consistency
def clashes(kg, edges: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """``(kind, subject, detail)``: every contradiction found; a consistent graph has none.

    Class expressions in axioms are followed to the individuals they speak of (see ``abox.Told``).
    """
    from ontoweave.plans.abox import Told

    told = Told(kg) if edges is None and types is None else None
    edges = told.edges if told else property_edges(kg) if edges is None else edges
    if types is None:
        types = told.types if told else inherited_types(kg).unionByName(domain_range_types(kg, edges)).distinct()
    row = lambda d, kind, subject, detail: d.select(F.lit(kind).alias("kind"), subject.alias("subject"), detail.alias("detail"))
    c = F.col
    parts = [row(disjoint_type_clashes(kg, types), "disjoint_types", c("x"), F.concat_ws(" ", "a", "b"))]
    parts.append(row(types.where(c("cls") == T.NOTHING), "nothing", c("x"), c("cls")))
    parts.append(row(unsatisfiable_classes(kg), "unsatisfiable_class", c("cls"), F.lit("")))
    for prop in kg.with_characteristic("IrreflexiveObjectProperty"):
        parts.append(row(irreflexive_clashes(edges, prop), "irreflexive", c("s"), F.lit(prop)))
    for prop in kg.with_characteristic("AsymmetricObjectProperty"):
        parts.append(row(asymmetric_clashes(edges, prop), "asymmetric", c("s"), F.concat_ws(" ", F.lit(prop), "o")))
    declared = set(kg.with_characteristic("ReflexiveObjectProperty"))
    for other in ("AsymmetricObjectProperty", "IrreflexiveObjectProperty"):
        both = sorted(declared & set(kg.with_characteristic(other)))
        if both:
            d = kg.spark.createDataFrame([(b,) for b in both], "p string")
            parts.append(row(d, "reflexive_" + other.removesuffix("ObjectProperty").lower(), c("p"), F.lit("")))
    eq, dis = kg.member_pairs("EquivalentClasses"), kg.member_pairs("DisjointClasses")
    parts.append(row(eq.join(dis, ["a", "b"]), "equivalent_and_disjoint", c("a"), c("b")))
    different = kg.member_pairs("DifferentIndividuals")
    same = same_edges(kg, edges, types)
    reps = same_components(same)
    parts.append(row(different_clashes(different, reps), "same_and_different", c("a"), c("b")))
    parts.append(row(negative_clashes(kg, edges), "negative_assertion", c("s"), F.concat_ws(" ", "p", "o")))
    for x in kg.axioms:
        if x[0] == "ObjectMaxCardinality" and len(x) >= 3:
            parts.append(row(cardinality_clashes(edges, different, x[2], x[1]), "max_cardinality", c("s"), F.concat_ws(" ", F.lit(x[2]), F.lit(str(x[1])))))
    if told:
        parts.append(told.clashes())
    p = kg.member_pairs("DisjointObjectProperties")
    l, r = edges.withColumnRenamed("p", "a"), edges.withColumnRenamed("p", "b")
    parts.append(row(p.join(l, "a").join(r, ["b", "s", "o"]), "disjoint_properties", c("s"), F.concat_ws(" ", "a", "b", "o")))
    return _union(parts).distinct()


def disjoint_type_clashes(kg, types: DataFrame | None = None) -> DataFrame:
    """``(x, a, b)``: individuals of two classes declared disjoint; by default asserted or inherited."""
    d = kg.member_pairs("DisjointClasses")
    if types is None:
        types = inherited_types_of(kg, sorted({c for r in d.collect() for c in r}))
    return types.select("x", F.col("cls").alias("a")).join(d, "a").join(types.select("x", F.col("cls").alias("b")), ["x", "b"]).select("x", "a", "b").distinct()


def irreflexive_clashes(edges: DataFrame, prop: str) -> DataFrame:
    return edges.where((F.col("p") == prop) & (F.col("s") == F.col("o"))).select("s").distinct()


def asymmetric_clashes(edges: DataFrame, prop: str) -> DataFrame:
    """``(s, o)`` related in both directions, once, and every loop."""
    e = edges.where(F.col("p") == prop).select("s", "o")
    return e.join(e.select(F.col("o").alias("s"), F.col("s").alias("o")), ["s", "o"]).where("s <= o").distinct()


def functional_groups(edges: DataFrame, prop: str, inverse: bool = False) -> DataFrame:
    """``(x, n)``: individuals with more than one value (or, inverse, subject) of a property."""
    x, y = ("o", "s") if inverse else ("s", "o")
    return edges.where(F.col("p") == prop).groupBy(F.col(x).alias("x")).agg(F.countDistinct(y).alias("n")).where("n > 1")


def different_clashes(different: DataFrame, reps: DataFrame) -> DataFrame:
    """``(a, b)``: individuals that are different and in one component."""
    ra, rb = reps.select(F.col("x").alias("a"), F.col("rep").alias("ra")), reps.select(F.col("x").alias("b"), F.col("rep").alias("rb"))
    return different.join(ra, "a").join(rb, "b").where("ra = rb").select("a", "b")


def negative_clashes(kg, edges: DataFrame) -> DataFrame:
    """``(s, p, o)``: edges or literals that a negative assertion denies."""
    objects = [(x[2], x[1], x[3]) for x in kg.axioms if x[0] == "NegativeObjectPropertyAssertion"]
    literals = [(x[2], x[1], x[3][0], x[3][1]) for x in kg.axioms if x[0] == "NegativeDataPropertyAssertion"]
    a = edges.join(kg.spark.createDataFrame(objects, "s string, p string, o string"), ["s", "p", "o"])
    t = kg.triples.where("o_kind = 'lit'").withColumn("t", F.coalesce("o_dt", F.lit(T.STRING)))
    b = t.join(kg.spark.createDataFrame(literals, "s string, p string, o string, t string"), ["s", "p", "o", "t"])
    return a.select("s", "p", "o").union(b.select("s", "p", "o")).distinct()


def role_counts(edges: DataFrame, prop: str | None = None) -> DataFrame:
    """``(s, p, n)``: distinct successors."""
    e = edges.where(F.col("p") == prop) if prop else edges
    return e.groupBy("s", "p").agg(F.countDistinct("o").alias("n"))


def cardinality_clashes(edges: DataFrame, different: DataFrame, prop: str, most: int) -> DataFrame:
    """``(s)``: more than ``most`` successors that are pairwise known to be different; names need not be unique, so mere count is not enough."""
    return with_apart(edges.where(F.col("p") == prop).select("s", "o"), different, most + 1)


def with_apart(edges: DataFrame, different: DataFrame, least: int) -> DataFrame:
    """``(s)``: subjects of ``(s, o)`` with ``least`` successors that are pairwise known to be different.

    Successors that differ from too few others are left out by joins; for the subjects that remain the
    pairs are searched for a clique, a subject at a time.
    """
    e = edges.distinct()
    if least <= 1:
        return e.select("s").distinct()
    both = different.union(different.select("b", "a")).toDF("o", "other")
    other = e.withColumnRenamed("o", "other")
    apart = e.join(both, "o").join(other, ["s", "other"]).select("s", "o", "other").distinct()
    if least == 2:
        return apart.select("s").distinct()
    enough = apart.groupBy("s", "o").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least - 1).select("s", "o")
    subjects = enough.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("s")
    pairs = apart.join(enough, ["s", "o"], "left_semi").join(enough.withColumnRenamed("o", "other"), ["s", "other"], "left_semi").join(subjects, "s", "left_semi").where("o < other")

    def search(key, rows):
        near: dict[str, set[str]] = {}
        for a, b in zip(rows["o"], rows["other"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        return rows.head(1)[["s"]] if has_clique(near, least) else rows.head(0)[["s"]]

    return pairs.groupBy("s").applyInPandas(search, "s string")


def has_clique(near: dict, size: int) -> bool:
    """Whether ``size`` nodes are pairwise neighbours; exact, by branching on nodes with enough neighbours only."""

    def prune(nodes, need):
        while True:
            kept = {v for v in nodes if len(near[v] & nodes) >= need - 1}
            if kept == nodes:
                return kept
            nodes = kept

    def grow(nodes, need):
        if need <= 0:
            return True
        nodes = prune(nodes, need)
        while len(nodes) >= need:
            v = max(sorted(nodes), key=lambda x: len(near[x] & nodes))
            if grow(near[v] & nodes, need - 1):
                return True
            nodes = prune(nodes - {v}, need)
        return False

    return grow(set(near), size)


def is_consistent(kg) -> bool:
    return clashes(kg).isEmpty()


def minimal_explanations(found: DataFrame, most: int = 10) -> DataFrame:
    """The clashes with the shortest involvement (words of the detail), at most ``most`` of them, in order."""
    sized = found.withColumn("size", F.when(F.col("detail") == "", 1).otherwise(1 + F.size(F.split("detail", " "))))
    return sized.where(F.col("size") == sized.agg(F.min("size")).first()[0]).orderBy("kind", "subject", "detail").limit(most)


def would_be_consistent(kg, *axioms: tuple) -> bool:
    """Whether the graph stays without clash if the axioms are added."""
    from ontoweave.model import KnowledgeGraph

    triples = kg.triples
    new = [(x[2], T.TYPE, x[1], "iri", None, None) for x in axioms if x[0] == "ClassAssertion" and isinstance(x[1], str)]
    new += [(x[2], x[1], x[3], "iri", None, None) for x in axioms if x[0] == "ObjectPropertyAssertion"]
    if new:
        triples = triples.unionByName(kg.spark.createDataFrame(new, T.TRIPLE))
    return is_consistent(KnowledgeGraph(kg.spark, triples, kg.axioms + list(axioms), kg.axioms_in_triples))


# Validation
def structural_problems(kg, largest_cardinality: int = 1_000_000) -> DataFrame:
    """``(kind, subject)``: subclass cycles, properties with conflicting characteristics, absurd cardinalities, repeated disjoint members."""
    spark = kg.spark
    cycle = closure(kg.pairs("SubClassOf"), "sub", "sup").where("sub = sup").select(F.lit("subclass_cycle").alias("kind"), F.col("sub").alias("subject"))
    has = {k: set(kg.with_characteristic(k)) for k in ("SymmetricObjectProperty", "AsymmetricObjectProperty", "ReflexiveObjectProperty", "IrreflexiveObjectProperty")}
    rows = [("symmetric_and_asymmetric", p) for p in has["SymmetricObjectProperty"] & has["AsymmetricObjectProperty"]]
    rows += [("reflexive_and_irreflexive", p) for p in has["ReflexiveObjectProperty"] & has["IrreflexiveObjectProperty"]]
    rows += [("cardinality", x[2]) for x in kg.axioms if x[0].endswith("Cardinality") and x[1] > largest_cardinality]
    rows += [("repeated_disjoint_member", m) for x in kg.axioms if x[0] == "DisjointClasses" for m in set(x[1:]) if x[1:].count(m) > 1]
    return cycle.union(spark.createDataFrame(sorted(rows), "kind string, subject string")).distinct()


def entity_problems(entities: DataFrame) -> DataFrame:
    """``(iri, problem)``: empty, control characters, too long, no scheme."""
    iri = F.col("iri")
    problem = F.when(F.length(iri) == 0, "empty").when(iri.rlike(r"[\x00-\x1f\x7f]"), "control_character").when(F.length(iri) > 2048, "too_long").when(~iri.contains(":"), "no_scheme")
    return entities.select("iri", problem.alias("problem")).where("problem IS NOT NULL")

"""Ordered collections as triples: lists, containers, statements; and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoweave.functions import terms as T


def _triple(s, p, o, kind="iri", dt=None):
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"), kind.alias("o_kind") if not isinstance(kind, str) else F.lit(kind).alias("o_kind"), (dt if dt is not None else F.lit(None).cast("string")).alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))


def list_triples(items: DataFrame, link: str, head: str = "subject") -> DataFrame:
    """``(subject, position, item, item_kind)`` rows as linked lists.

    The node of position i is ``<subject>_<i>``; the subject is linked to the first node by ``link``,
    and the last node's rest is nil. Equal positions are ordered by item.
    """
    w = Window.partitionBy(head).orderBy("position", "item")
    d = items.select(F.col(head).alias("_s"), "item", "item_kind", F.row_number().over(w).alias("_i"), F.lead(F.lit(1)).over(w).alias("_more"))
    node = F.concat("_s", F.lit("_"), F.col("_i").cast("string"))
    after = F.when(F.col("_more").isNotNull(), F.concat("_s", F.lit("_"), (F.col("_i") + 1).cast("string"))).otherwise(T.NIL)
    dt = F.when(F.col("item_kind") == "lit", T.STRING)
    out = F.array(_triple(node, F.lit(T.FIRST), F.col("item"), F.col("item_kind"), dt), _triple(node, F.lit(T.REST), after), F.when(F.col("_i") == 1, _triple(F.col("_s"), F.lit(link), node)))
    return d.select(F.explode(out).alias("t")).where("t IS NOT NULL").select("t.*")


def container_triples(items: DataFrame, kind: str = "Seq", head: str = "subject") -> DataFrame:
    """``(subject, position, item, item_kind)`` rows as a container: its type and ``rdf:_1`` onwards."""
    w = Window.partitionBy(head).orderBy("position", "item")
    d = items.select(F.col(head).alias("_s"), "item", "item_kind", F.row_number().over(w).alias("_i"))
    member = _triple(F.col("_s"), F.concat(F.lit(T.RDF + "_"), F.col("_i").cast("string")), F.col("item"), F.col("item_kind"), F.when(F.col("item_kind") == "lit", T.STRING))
    typed = F.when(F.col("_i") == 1, _triple(F.col("_s"), F.lit(T.TYPE), F.lit(T.RDF + kind)))
    return d.select(F.explode(F.array(member, typed)).alias("t")).where("t IS NOT NULL").select("t.*")


def statement_triples(triples: DataFrame) -> DataFrame:
    """Each triple as a statement node with subject, predicate, object and type; the node is a digest of the triple."""
    me = F.concat(F.lit("_:st"), F.sha2(F.concat_ws("\x1f", "s", "p", "o", "o_kind", F.coalesce("o_dt", F.lit("")), F.coalesce("o_lang", F.lit(""))), 256))
    kind = F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri")
    rows = F.array(_triple(me, F.lit(T.TYPE), F.lit(T.STATEMENT)), _triple(me, F.lit(T.RDF + "subject"), F.col("s"), kind), _triple(me, F.lit(T.RDF + "predicate"), F.col("p")), F.struct(me.alias("s"), F.lit(T.RDF + "object").alias("p"), F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")))
    return triples.select(F.explode(rows).alias("t")).select("t.*")


def quoted_ids(triples: DataFrame) -> DataFrame:
    """The triples with the name of each as a quoted triple; names of over 200 characters are digests."""
    name = F.concat_ws("_", F.lit("_:reified"), "s", "p", "o")
    digest = F.concat(F.lit("_:reified_"), F.sha2(F.concat_ws("_", "s", "p", "o"), 256))
    return triples.withColumn("quoted", F.when(F.length(name) <= 200, name).otherwise(digest))


def read_lists(triples: DataFrame, link: str) -> DataFrame:
    """``(subject, position, item)`` of lists linked by ``link``; one doubling join per power of two of their length.

    Lists may have any length. A path of more steps than there are cells runs in a circle, which is an error.
    """
    rest = triples.where((F.col("p") == T.REST) & (F.col("o") != T.NIL)).select(F.col("s").alias("a"), F.col("o").alias("b"))
    first = triples.where(F.col("p") == T.FIRST).select(F.col("s").alias("node"), F.col("o").alias("item"))
    from ontoweave.plans.storage import materialize

    at = triples.where(F.col("p") == link).select(F.col("s").alias("subject"), F.col("o").alias("node"), F.lit(1).cast("long").alias("position"))
    step, cells = 1, None
    while True:
        at, rest = materialize(at, "list"), materialize(rest, "list-rest")
        if rest.isEmpty():
            break
        cells = rest.select("a").distinct().count() if cells is None else cells
        if step > cells:  # rest holds the paths of ``step`` links
            raise ValueError("rdf:rest runs in a circle")
        moved = at.join(rest, at["node"] == rest["a"]).select("subject", F.col("b").alias("node"), (F.col("position") + step).alias("position"))
        at = at.union(moved)
        rest = rest.join(rest.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        step *= 2
    return at.join(first, "node").select("subject", "position", "item")

"""N-Triples: parsed and written line by line, in parallel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ontoweave.functions import terms as T

_LINE = (
    r"^\s*(<[^<>\"{}|^`\x00-\x20]*>|_:[\w.:-]*[\w:-])\s*(<[^<>\"{}|^`\x00-\x20]*>)\s*"
    r"(?:(<[^<>\"{}|^`\x00-\x20]*>|_:[\w.:-]*[\w:-])|\"((?:[^\"\\\n\r]|\\.)*)\"(?:\^\^<([^<>]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)\s*\.\s*(?:#.*)?$"
)


@F.pandas_udf(StringType())
def _unescape_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else T.turtle_unescape(t))


def unescape(text: Column) -> Column:
    """Escapes undone: those that JSON shares stay in the JVM, the rare others go through Arrow."""
    shared = F.from_json(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "v string")["v"]
    rare = text.rlike(r"\\[U']")
    return F.when(~text.contains("\\"), text).when(~rare, shared).otherwise(_unescape_all(F.when(rare, text)))


def _strip(term: Column) -> Column:
    return F.when(term.startswith("<"), unescape(F.regexp_replace(term, "^<|>$", ""))).otherwise(term)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of N-Triples lines; blank lines, comments and malformed lines give none."""
    line = F.col(column)
    part = lambda i: F.regexp_extract(line, _LINE, i)
    d = lines.where(line.rlike(_LINE)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("r"), part(4).alias("l"), part(5).alias("t"), part(6).alias("g"))
    resource = F.col("r") != ""
    kind = F.when(~resource, "lit").when(F.col("r").startswith("_:"), "bnode").otherwise("iri")
    dt = F.when(~resource, F.when(F.col("g") != "", T.LANG_STRING).when(F.col("t") != "", F.col("t")).otherwise(T.STRING))
    return d.select(_strip(F.col("s")).alias("s"), _strip(F.col("p")).alias("p"), F.when(resource, _strip(F.col("r"))).otherwise(unescape(F.col("l"))).alias("o"), kind.alias("o_kind"), dt.alias("o_dt"), F.when(F.col("g") != "", F.lower("g")).alias("o_lang"))


def malformed(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that are neither triples, blank, nor comments."""
    return lines.where(~F.col(column).rlike(_LINE) & ~F.col(column).rlike(r"^\s*(#.*)?$"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def to_lines(triples: DataFrame) -> DataFrame:
    """``(value)``: one N-Triples line per triple."""
    def escaped(c):
        for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            c = F.replace(c, F.lit(plain), F.lit(code))
        return c

    resource = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    dt = F.coalesce(F.col("o_dt"), F.lit(T.STRING))
    suffix = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(dt != T.STRING, F.concat(F.lit("^^<"), dt, F.lit(">"))).otherwise("")
    literal = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), suffix)
    o = F.when(F.col("o_kind") == "lit", literal).otherwise(resource(F.col("o")))
    return triples.select(F.concat(resource(F.col("s")), F.lit(" <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def write(triples: DataFrame, path: str) -> None:
    to_lines(triples).write.text(path)

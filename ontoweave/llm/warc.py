"""Content-addressed WARC archive.

Payload bytes are stored once, under a verified SHA-256; the exact header of every record is kept
apart; records are rebuilt by joining the two. Everything is DataFrame expressions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.llm.common import table
from ontoweave.plans.storage import shared_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column in upper-case base32 (32 characters, no padding)."""
    digest = F.sha1(payload)
    chars = []
    for part in range(4):  # 160 bits as four numbers of 40 bits
        n = F.conv(F.substring(digest, 1 + 10 * part, 10), 16, 10).cast("long")
        for k in range(8):
            chars.append(F.substring(F.lit(BASE32), (F.shiftright(n, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one WARC record per row into ``path``: ``payloads`` (digest, payload) and ``headers``.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest id is a
    response and the others revisit it; smaller ones are all responses. A null body is an empty
    payload, a null URL an empty target; control characters in a URL are percent-escaped. A row with
    a null id is a response where all equal payloads have null ids, else a revisit. Repeated rows of
    the largest id are all responses. Equal digests are compared by length and SHA-1 as well, and a
    digest that stands for different contents stops the write.

    Only digests are grouped and joined by content; a payload shared by a third of all rows is
    therefore never gathered. Payload bytes move once, by id, to the row that keeps them.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8")
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    for c, escaped in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        url = F.replace(url, F.lit(c), F.lit(escaped))
    rows = pages.select(F.col(id_col).cast("long").alias("record"), url.alias("url"), payload.alias("payload"))
    rows = rows.select("record", "url", "payload", F.sha2("payload", 256).alias("address"))
    slim = rows.select("record", "url", "address", F.octet_length("payload").cast("long").alias("length"), base32_sha1(F.col("payload")).alias("sha1"))
    slim_path = f"{path}/digests"
    slim.write.option("compression", "zstd").parquet(slim_path)
    slim = spark.read.schema(slim.schema).parquet(slim_path)
    found = slim.groupBy("address").agg(F.max("record").alias("keeper"), F.min("length").alias("a"), F.max("length").alias("b"), F.min("sha1").alias("c"), F.max("sha1").alias("d"))
    same = (F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))
    keepers = found.select("address", F.when(same, F.col("keeper")).otherwise(F.raise_error(F.lit("one digest, different payloads")).cast("long")).alias("keeper"))
    is_revisit = (F.col("length") >= least_bytes) & F.col("keeper").isNotNull() & ~F.col("record").eqNullSafe(F.col("keeper"))
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    kind = F.when(is_revisit, "revisit").otherwise("response")
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(F.col("record"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("keeper"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(is_revisit, F.lit("0")).otherwise(F.col("length").cast("string"))),
        F.lit(CRLF),
    )
    headers = slim.join(keepers, "address").select("address", header.alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")
    # Among repeated rows of the keeper any one may bring the bytes; they are equal.
    kept = rows.select("record", "payload", "address").join(keepers.withColumnRenamed("keeper", "record"), ["record", "address"], "left_semi").dropDuplicates(["record", "address"])
    nulls = rows.where(F.col("record").isNull()).join(keepers.where("keeper IS NULL"), "address", "left_semi").dropDuplicates(["address"])
    store = kept.select("address", "payload").unionByName(nulls.select("address", "payload"))
    store.write.option("compression", "zstd").parquet(f"{path}/payloads")


def payloads(spark, path: str) -> DataFrame:
    """``(address, payload)`` as stored; a stored payload whose bytes no longer give its address stops the read."""
    stored = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its digest")).cast("binary"))
    return stored.select("address", sound.alias("payload"))


def headers(spark, path: str) -> DataFrame:
    """``(address, header)`` and the header's fields, parsed back."""
    raw = spark.read.schema("address string, header string").parquet(f"{path}/headers")
    field = lambda name, value: F.regexp_extract("header", rf"\r\n{name}: {value}\r\n", 1)
    number = lambda name: F.expr(f"try_cast({name} AS BIGINT)")
    out = raw.select("*", field("WARC-Type", r"(\w+)").alias("record_type"), field("WARC-Record-ID", r"<urn:record:(-?\d*)>").alias("r"), field("WARC-Refers-To", r"<urn:record:(-?\d*)>").alias("t"), field("WARC-Target-URI", r"([^\r\n]*)").alias("url"), field("WARC-Payload-Digest", r"sha1:(\w+)").alias("sha1"))
    return out.select("address", "header", "record_type", number("r").alias("record"), number("t").alias("refers_to"), "url", "sha1")


def records(spark, path: str, with_revisits: bool = True) -> DataFrame:
    """The original records, ``(record, record_type, refers_to, url, warc)``; ``warc`` is the record's exact bytes.

    A revisit has an empty block, as in the format; ``payload`` is the full content for all records
    when ``with_revisits`` is set, else only responses are rebuilt.
    """
    head = headers(spark, path)
    if not with_revisits:
        head = head.where("record_type = 'response'")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    stored = payloads(spark, path).dropDuplicates(["address"])
    full = head.join(stored, "address")
    return full.select("record", "record_type", "refers_to", "url", F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit(CRLF + CRLF), "UTF-8")).alias("warc"), "payload")


def read_digests(spark, path: str) -> DataFrame:
    """Per record what its header says, joined with length and digest computed from the stored bytes."""
    stored = payloads(spark, path).select("address", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    stored = stored.groupBy("address").agg(F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest"))
    return headers(spark, path).join(stored, "address")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to an archive in the shared folder and read back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    checked = F.when(F.col("sha1") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload disagree")).cast("string"))
    return read_digests(spark, path).select(F.col("record").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


ORACLE_4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT html, max(page_id) AS keeper FROM p GROUP BY html),
h AS (SELECT page_id, html, keeper, sha1(html) AS hex FROM p JOIN k USING (html)),
n AS (SELECT *, ('0x' || substr(hex, 1, 10))::UBIGINT AS a, ('0x' || substr(hex, 11, 10))::UBIGINT AS b,
             ('0x' || substr(hex, 21, 10))::UBIGINT AS c, ('0x' || substr(hex, 31, 10))::UBIGINT AS d FROM h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((CASE i // 8 WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE d END) >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM n
"""

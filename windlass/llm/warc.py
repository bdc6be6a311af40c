"""Content-addressed WARC archive.

``payloads`` holds every payload's bytes once, under their SHA-256;
``headers`` holds the exact header of every record and its payload's key.
Reading joins the two and gives back whole records.  Keys are verified: a
payload whose bytes do not hash to its key, a record without payload, or one
whose header tells another digest stops the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"          # the pages carry no fetch time
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_ID = "urn:page:"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits, taken by five
    (20 bits), give four letters each."""
    hexa, letters = F.sha1(data), []
    for i in range(8):
        v = F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_B32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1))
                    for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _ref(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{_ID}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", min_bytes: int = 0, date: str = DATE) -> None:
    """Write one record per row.  Of records with equal payloads of at least
    ``min_bytes`` bytes, that with the smallest id is a response and the
    others are revisits of it; smaller ones are all responses.

    A null payload is an empty one; repeated rows are records of their own
    with equal types; a null id sorts last; no rows give an empty archive;
    other columns are ignored."""
    body = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    d = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("bytes"))
    d = d.withColumn("key", F.unhex(F.sha2("bytes", 256)))
    records = d.select("id", "url", "key", F.octet_length("bytes").cast("long").alias("n"),
                       base32_sha1(F.col("bytes")).alias("sha1"))
    # Ids and keys only; the bytes of a page copied a million times meet in
    # one map-side combined aggregate, below.
    first = records.groupBy("key").agg(F.min("id").alias("first"))
    r = records.join(first, "key")
    revisit = (F.col("n") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first"))
    lines = [F.lit("WARC/1.1\r\n"),
             _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
             _line("WARC-Record-ID", _ref(F.col("id"))), _line("WARC-Date", F.lit(date)),
             _line("WARC-Target-URI", F.col("url")),
             _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
             F.when(revisit, F.concat(
                 _line("WARC-Refers-To", _ref(F.col("first"))),
                 _line("WARC-Profile", F.lit(
                     "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
             _line("Content-Type", F.lit("text/html; charset=utf-8")),
             _line("Content-Length", F.col("n").cast("string")), F.lit("\r\n")]
    (r.select("key", F.encode(F.concat(*lines), "UTF-8").alias("header"))
     .write.parquet(f"{path}/headers"))
    (d.groupBy("key").agg(F.any_value("bytes").alias("bytes"))
     .write.parquet(f"{path}/payloads"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, record) of every record of an archive; record is the
    whole as one byte string."""
    headers = spark.read.schema("key binary, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("key binary, bytes binary").parquet(f"{path}/payloads")
    checked = payloads.select("key", F.when(
        F.unhex(F.sha2("bytes", 256)) == F.col("key"), F.col("bytes")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not hash to its key "), F.hex("key")))).alias("bytes"))
    got = headers.join(checked, "key", "left")
    payload = F.when(F.col("bytes").isNull(), F.raise_error(F.concat(
        F.lit("no payload for key "), F.hex("key")))).otherwise(F.col("bytes"))
    return got.select("header", payload.alias("payload")).withColumn(
        "record", F.concat("header", "payload", F.lit(b"\r\n\r\n")))


def _field(text: Column, name: str) -> Column:
    got = F.regexp_extract(text, f"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)
    return F.when(got != "", got)


def describe(records: DataFrame) -> DataFrame:
    """What the records of :func:`read_archive` say and hold: page_id,
    payload_bytes, payload_digest, record_type, refers_to.  Length and digest
    are taken from the payload and must agree with the header."""
    head = F.decode("header", "UTF-8")
    body = F.expr("substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - 4)")
    r = records.select(head.alias("h"), body.alias("body"))
    r = r.select("h", F.octet_length("body").cast("long").alias("payload_bytes"),
                 base32_sha1(F.col("body")).alias("payload_digest"))
    page = lambda name: F.regexp_extract(_field(F.col("h"), name), f"<{_ID}(-?[0-9]*)>", 1)
    said = F.concat(_field(F.col("h"), "WARC-Payload-Digest"), F.lit(" "), _field(F.col("h"), "Content-Length"))
    held = F.concat(F.lit("sha1:"), "payload_digest", F.lit(" "), F.col("payload_bytes").cast("string"))
    number = lambda c: F.when(c != "", c).cast("long")
    return r.select(number(page("WARC-Record-ID")).alias("page_id"), "payload_bytes",
                    F.when(said == held, F.col("payload_digest")).otherwise(F.raise_error(F.concat(
                        F.lit("record tells another payload: "), "h"))).alias("payload_digest"),
                    _field(F.col("h"), "WARC-Type").alias("record_type"),
                    number(page("WARC-Refers-To")).alias("refers_to"))

"""A content-addressed web archive: every payload once, every record header exactly, originals by joins.

An archive is a folder with two tables:

``payloads``  (sha256, payload)            each distinct payload once, under its strong digest
``records``   (record_no, header, sha256)  one exact WARC header block per record, and its payload's digest

A record's bytes are its header, its payload if it is a response, and the closing line
breaks. Reading joins both tables on the digest, and stops with an error if a
payload does not have the digest it is stored under.

All work is done by DataFrame functions. Texts of payloads are
shuffled twice: once to choose among equal ones, once to put records together.
A payload that a third of all records share is one row of ``payloads``; the join gives its
records to as many tasks as Spark splits them into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartmill.llm.common import col, text_of, work_dir

CRLF = "\r\n"
#: The revisit profile for equal payloads in the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column) -> Column:
    """Base32 (RFC 4648) of a SHA-1 given as 40 hexadecimal digits: 20 bits, four symbols, at a time."""
    parts = [
        F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * part, 5), 16, 32), 4, "0") for part in range(8)
    ]
    digits, symbols = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.translate(F.upper(F.concat(*parts)), digits, symbols)


def header_block(kind: Column, record_no: Column, uri: Column, sha1: Column, size: Column, refers_to: Column) -> Column:
    """The header lines of a WARC record, with the empty line that ends them."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    def urn(number: Column) -> Column:
        return F.concat(F.lit("<urn:record:"), number.cast("string"), F.lit(">"))

    clean = F.regexp_replace(uri, "[\\r\\n]", "")  # a line break would end the header line
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(record_no)),
        line("WARC-Target-URI", clean),
        F.when(refers_to.isNotNull(), line("WARC-Refers-To", urn(refers_to))).otherwise(F.lit("")),
        F.when(kind == "revisit", line("WARC-Profile", F.lit(REVISIT_PROFILE))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit(0)).otherwise(size).cast("string")),
        F.lit(CRLF),
    )


def write_archive(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
) -> None:
    """Write one WARC record per row of ``pages`` to the archive ``folder``.

    The payload is the html in UTF-8; NULL counts as empty. Among equal payloads of at least
    ``min_bytes`` bytes the one with the largest id is the response, and the others are revisits that
    refer to it; smaller payloads are all responses. A NULL url is
    written as an empty one. Rows that repeat the largest id are all responses, and a row with a NULL id
    is a response unless another row has its payload. Other columns are not read.
    """
    source = pages.select(
        col(id_col).cast("long").alias("record_no"),
        F.coalesce(col(url_col).cast("string"), F.lit("")).alias("uri"),
        text_of(html_col).cast("binary").alias("payload"),
    ).select("*", F.sha2("payload", 256).alias("sha256"))
    # digests only, reduced to one row per payload before the shuffle
    first = source.groupBy("sha256").agg(F.max("record_no").alias("response_no"))
    records = (
        source.select(
            "record_no", "uri", "sha256", F.length("payload").cast("long").alias("size"), base32(F.sha1("payload")).alias("sha1")
        )
        .join(first, "sha256")
        .withColumn("revisits", (F.col("size") >= min_bytes) & (F.coalesce("record_no", F.lit(-1)) != F.coalesce("response_no", F.lit(-1))))
    )
    header = header_block(
        F.when(F.col("revisits"), "revisit").otherwise("response"),
        F.coalesce(F.col("record_no").cast("string"), F.lit("")),
        F.col("uri"),
        F.col("sha1"),
        F.col("size"),
        F.when(F.col("revisits"), F.col("response_no")),
    )
    records.select("record_no", header.alias("header"), "sha256").write.parquet(f"{folder}/records")
    # the payload of the response stands for all equal ones; the pair of digest and id is as good as unique, so no key is hot
    chosen = source.withColumn("response_no", F.coalesce("record_no", F.lit(-1))).join(
        first.withColumn("response_no", F.coalesce("response_no", F.lit(-1))), ["sha256", "response_no"], "left_semi"
    )
    repeated = records.filter("record_no <=> response_no").groupBy("sha256").count().filter("count > 1")
    chosen = chosen.select("sha256", "payload")
    # rows repeated as a whole would bring their payload twice
    (chosen if repeated.isEmpty() else chosen.dropDuplicates(["sha256"])).write.parquet(f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive: (record_no, header, payload), the payload in full for revisits as well.

    A payload that does not have its digest, or is missing, stops the query.
    """
    records = spark.read.schema("record_no long, header string, sha256 string").parquet(f"{folder}/records")
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{folder}/payloads")
    verified = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("no payload with digest "), F.col("sha256"))).cast("binary")
    )
    return records.join(payloads, "sha256", "left").select("record_no", "header", verified.alias("payload"))


def record_bytes(records: DataFrame) -> DataFrame:
    """(record_no, record): the exact bytes of each WARC record, as they stand in a .warc file."""
    own = F.when(header_value("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("record_no", F.concat(F.encode("header", "UTF-8"), own, F.lit(b"\r\n\r\n")).alias("record"))


def header_value(name: str) -> Column:
    """The value of a header line, NULL if there is no such line."""
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.col("header").contains(f"{CRLF}{name}: "), found)


def export_warc(records: DataFrame, folder: str, records_per_file: int = 50_000) -> None:
    """Write records as .warc text files that other tools read; payloads must be UTF-8, as ``write_archive`` makes them."""
    whole = F.concat(F.col("header"), F.when(header_value("WARC-Type") == "revisit", "").otherwise(F.decode("payload", "UTF-8")))
    records.select(whole.alias("value")).write.option("lineSep", f"{CRLF}{CRLF}").option(
        "maxRecordsPerFile", records_per_file
    ).text(folder)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and describe the records read back.

    (page_id, payload_bytes, payload_digest, record_type, refers_to); size and digest are those of the
    full payload read back, type and reference those of the header.
    """
    spark = pages.sparkSession
    folder = work_dir(spark, "archive")
    write_archive(pages, folder, id_col, url_col, html_col, min_bytes)
    return read_archive(spark, folder).select(
        F.col("record_no").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
        header_value("WARC-Type").alias("record_type"),
        F.regexp_extract(header_value("WARC-Refers-To"), ":([0-9-]+)>", 1).try_cast("long").alias("refers_to"),
    )

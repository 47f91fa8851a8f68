"""A content-addressed web archive: payloads once under a verified digest, exact record headers apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, numbered, skew_join

#: Lines of a record's header end so.
EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(key: Column) -> Column:
    h = F.md5(key)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(EOL))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``path/payloads`` (sha256, sha1, n, payload), each distinct payload once, and ``path/headers`` (sha256, header), a row for each row of pages.

    Of rows with equal payloads of at least ``least`` bytes that with the largest page_id (nulls least; of equal ids
    any one) is the response, and the others revisit it; smaller ones are responses. A null payload is empty; a null
    url is empty; line ends in a url are percent-encoded. Every record has its own id, repeated rows too. Payloads
    meet in a grouped aggregate that is combined before the shuffle; headers are made without payloads. A payload
    is held in one row, however long (2 GB at most). An empty table gives an empty archive; other columns are not read.
    """
    scratch, (plain, name, _) = Scratch(pages.sparkSession), numbered(pages)
    body = F.coalesce(F.col(name(payload)), F.lit("")).cast("binary")
    rows = plain.select(F.col(name(page_id)).cast("long").alias("page_id"), F.coalesce(F.col(name(url)), F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    scratch.write_to(rows.groupBy("sha256", "sha1", "n").agg(F.first("payload").alias("payload")), f"{path}/payloads")
    listed = scratch.write(rows.drop("payload").withColumn("row", F.monotonically_increasing_id()), "rows")
    # Null ids sort least in a struct's maximum.
    last = listed.where(F.col("n") >= least).groupBy("sha256").agg(F.max(F.struct("page_id", "row")).alias("last"))
    made = skew_join(listed, last.select("sha256", F.col("last.page_id").alias("response"), F.col("last.row").alias("response_row")), ["sha256"], "left")
    again = F.coalesce(F.col("row") != F.col("response_row"), F.lit(False))
    key = lambda page, row: F.concat_ws("|", F.coalesce(F.col(page).cast("string"), F.lit("")), F.col("sha1"), F.col(row).cast("string"))
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1" + EOL),
        _field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(key("page_id", "row"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", safe),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("page_id").isNull(), "").otherwise(_field("X-Page-ID", F.col("page_id").cast("string"))),
        _field("X-Payload-Length", F.col("n").cast("string")),
        F.when(
            again,
            F.concat(
                _field("WARC-Profile", F.lit(PROFILE)), _field("WARC-Refers-To", _record_id(key("response", "response_row"))),
                F.when(F.col("response").isNull(), "").otherwise(_field("X-Refers-To-Page", F.col("response").cast("string"))),
            ),
        ).otherwise(""),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(again, 0).otherwise(F.col("n")).cast("string")),
    )
    scratch.write_to(made.select("sha256", header.alias("header")), f"{path}/headers")
    scratch.clear()


def _of(header: Column, name: str) -> Column:
    """A field of a header; empty where it lacks."""
    return F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, record): each record's original bytes, put together from its header and the stored payload by a join.

    Each stored payload is hashed again, and reading fails if it doesn't match its address. A revisit gets its payload
    back too: Content-Length stays as its header has it, X-Payload-Length tells the block that follows.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    right = (F.sha2("payload", 256) == F.col("sha256")) & (F.sha1("payload") == F.col("sha1")) & (F.octet_length("payload") == F.col("n"))
    checked = stored.select("sha256", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))).alias("payload"))
    end = F.lit(EOL.encode())
    return skew_join(spark.read.parquet(f"{path}/headers"), checked, ["sha256"]).select("sha256", F.concat(F.col("header").cast("binary"), end, F.col("payload"), end, end).alias("record"))


def parse(record: DataFrame) -> DataFrame:
    """record (record: bytes) read as an archive's record: the header ends at the first empty line, the block is as long as X-Payload-Length says.

    Columns: page_id, url, header, payload, payload_bytes, payload_digest (SHA-1 of the payload at hand, which must be the header's), record_type, refers_to.
    """
    h = F.col("header")
    number = lambda name: F.nullif(_of(h, name), F.lit("")).cast("long")
    # Headers are ASCII but for the url, so that the end is looked for in bytes' own encoding.
    one = F.decode("record", "ISO-8859-1")
    at = F.instr(one, EOL * 2)
    split = record.select("record", at.alias("at")).select(F.expr("substring(record, 1, at + 1)").cast("string").alias("header"), F.expr("substring(record, at + 4)").alias("rest"))
    cut = split.withColumn("n", number("X-Payload-Length")).select("header", "n", F.expr("substring(rest, 1, CAST(n AS INT))").alias("payload"), F.expr("substring(rest, CAST(n AS INT) + 1)").alias("tail"))
    digest = F.sha1("payload")
    fine = (_of(h, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest)) & (F.octet_length("payload") == F.col("n")) & (F.col("tail") == F.lit((EOL * 2).encode()))
    return cut.select(
        number("X-Page-ID").alias("page_id"), _of(h, "WARC-Target-URI").alias("url"), "header", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(fine, digest).otherwise(F.raise_error(F.concat(F.lit("damaged record "), _of(h, "WARC-Record-ID")))).alias("payload_digest"),
        _of(h, "WARC-Type").alias("record_type"), number("X-Refers-To-Page").alias("refers_to"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records, whole, as ``parse`` reads them: a row for each row that was written."""
    return parse(records(spark, path))


def export_warc(spark: SparkSession, path: str, to: str, per_file: int = 10_000) -> None:
    """Write the archive's records as standard .warc text, ``per_file`` at most to a file: header, empty line, block, two line ends. A revisit has an empty block."""
    block = F.when(F.col("record_type") == "revisit", "").otherwise(F.col("payload").cast("string"))
    read_archive(spark, path).select(F.concat("header", F.lit(EOL), block).alias("value")).write.option("lineSep", EOL * 2).option("maxRecordsPerFile", per_file).text(to)


def parse_warc(spark: SparkSession, path: str) -> DataFrame:
    """(header, block) of each record in the .warc files of a folder, told apart by Content-Length alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for data in x["content"]:
                at, rows = 0, []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 2
                    header = data[at:end]
                    n = int(header.rpartition(b"\r\nContent-Length: ")[2])
                    rows.append((header.decode(), data[end + 2 : end + 2 + n]))
                    at = end + 2 + n + 4
                yield pd.DataFrame(rows, columns=["header", "block"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInPandas(run, "header string, block binary")

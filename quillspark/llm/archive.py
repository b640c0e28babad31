"""Content-addressed web archive.

``payloads/`` holds the bytes of each distinct payload once, under its SHA-256. ``records/``
holds for each record its exact WARC header and block header and the digest of its payload.
A record is put together again by a join on the digest; every payload is held against both
digests and its length when it is read. All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import release, scratch, written

CRLF = "\r\n"


def base32_sha1(payload: Column | str) -> Column:
    """SHA-1 in upper-case base32: each 5 hex digits are 4 letters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Writes one record for each row of ``pages``.

    Of the records with equal payloads of ``min_revisit`` bytes or more the one with the
    largest id is a response and the others revisit it; all others are responses. A null
    payload is empty, a null url an empty target. Rows that repeat an id with an equal
    payload: one of them is the response if the id is the largest. Rows with a null id are
    records too; null counts as the smallest id. Carriage returns and line feeds are taken out
    of urls, as a header field cannot hold them. Other columns are not read.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8") if dict(pages.dtypes)[payload_col] == "string" else F.coalesce(F.col(payload_col), F.unhex(F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    named = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    index = written(named.select("id", "url", "digest", "size", base32_sha1("payload").alias("sha1")), "archive-index")

    owner = index.groupBy("digest").agg(F.max("id").alias("owner"))
    once = F.row_number().over(_window("digest", "id")).alias("copy")
    # Only rows with the owner's id may be the response, so the windows are over repeats of one id.
    own = index.join(owner, "digest")
    is_owner = F.coalesce(F.col("id") == F.col("owner"), F.col("id").isNull() & F.col("owner").isNull())
    first = own.where(is_owner).select("id", "url", "digest", "size", "sha1", "owner", once)
    later = own.where(~is_owner).select("id", "url", "digest", "size", "sha1", "owner", F.lit(2).alias("copy"))
    both = first.unionByName(later)
    revisit = (F.col("copy") > 1) & (F.col("size") >= min_revisit)
    kind = F.when(revisit, "revisit").otherwise("response")

    block = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">"))
    length = F.octet_length(block) + F.when(revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), name(F.col("id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", ""),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), name(F.col("owner")))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), length.cast("string"), F.lit(CRLF + CRLF),
    )
    both.select("id", "digest", head.alias("head"), block.alias("block")).write.option("compression", "zstd").parquet(f"{path}/records")

    # One row a digest: payloads of the owners, by id and so without a hot key. Both steps are
    # by the same two columns, so payloads are exchanged once.
    stored = named.select("id", "digest", "payload")
    kept = stored.where("id is not null").join(owner.select(F.col("owner").alias("id"), "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    nameless = stored.where("id is null").join(owner.where("owner is null").select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    kept.unionByName(nameless).select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    release(index)


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy("url")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``(digest, payload)``, each held against its name; a mismatch is an error."""
    rows = spark.read.parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("digest")
    return rows.select("digest", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match "), F.col("digest")))).alias("payload"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Parsed headers: ``(id, digest, record_type, refers_to, target_uri, payload_sha1, http_length, head, block)``."""
    rows = spark.read.parquet(f"{path}/records")
    field = lambda name, within="head": F.regexp_extract(within, rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)
    number = lambda text: F.expr(f"try_cast(nullif(regexp_extract({text}, 'page:([0-9-]*)>', 1), '') AS bigint)")
    parsed = rows.select("digest", "head", "block", field("WARC-Record-ID").alias("name"), field("WARC-Refers-To").alias("other"), field("WARC-Type").alias("record_type"),
                         field("WARC-Target-URI").alias("target_uri"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_sha1"), field("Content-Length", "block").cast("long").alias("http_length"))
    return parsed.select(number("name").alias("id"), "digest", "record_type", number("other").alias("refers_to"), "target_uri", "payload_sha1", "http_length", "head", "block")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Every original record, ``(id, record_type, record)``: header and block header as they
    were written, the payload of responses joined in by digest, and the end of the record.
    Revisits have no payload in their block and need no join."""
    return _records(spark, path).select("id", "record_type", "record")


def _records(spark: SparkSession, path: str) -> DataFrame:
    rows = headers(spark, path).withColumn("lead", F.encode(F.concat("head", "block"), "utf-8")).drop("head", "block", "target_uri")
    tail = F.encode(F.lit(CRLF + CRLF), "utf-8")
    full = rows.where("record_type = 'response'").join(read_payloads(spark, path), "digest").withColumn("record", F.concat("lead", "payload", tail)).drop("payload")
    bare = rows.where("record_type <> 'response'").withColumn("record", F.concat("lead", tail))
    return full.unionByName(bare.select(*full.columns))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of each record: length
    and SHA-1 of the payload in the record as it is put together again, for revisits those of the
    response with that digest. A record that does not match its header is an error."""
    rows = _records(spark, path)
    size = F.octet_length("record") - F.octet_length("lead") - 2 * len(CRLF)
    payload = F.substring(F.col("record"), F.octet_length("lead") + 1, size)
    right = "payload_sha1 = payload_digest AND http_length = payload_bytes"
    wrong = F.raise_error(F.concat(F.lit("record does not match its payload: "), "digest"))
    checked = F.when(F.coalesce(F.expr(right), F.lit(False)), F.col("payload_digest")).otherwise(wrong).alias("payload_digest")
    responses = rows.where("record_type = 'response'").select("id", "digest", "record_type", "refers_to", "payload_sha1", "http_length", size.cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))
    told = written(responses.select("id", "digest", "record_type", "refers_to", "payload_bytes", checked), "archive-told")
    by_digest = told.groupBy("digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    again = headers(spark, path).where("record_type <> 'response'").select("id", "digest", "record_type", "refers_to", "payload_sha1", "http_length")
    revisits = again.join(by_digest, "digest", "left").select("id", "record_type", "refers_to", "payload_bytes", checked)
    return told.select(*revisits.columns).unionByName(revisits).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def archived(pages: DataFrame, **args) -> DataFrame:
    """Writes ``pages`` to a fresh shared folder and reads the archive back."""
    path = scratch(pages.sparkSession, "archive")
    write_archive(pages, path, **args)
    return read_index(pages.sparkSession, path)

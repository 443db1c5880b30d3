"""WARC as a content-addressed archive.

Two tables: `payloads` holds each distinct payload once under its SHA-256 (with SHA-1 and length beside it, so an
address that two contents shared would show) and names the record that holds it as a response; `records` holds every
record's exact header block, HTTP head and that address. Records are rebuilt by a join into the bytes of a WARC file,
and all that is read of a record (type, ids, lengths, digest, payload) is parsed out of those bytes and checked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import checkpoint, join_skewed, shared_folder

#: A payload that more records share is joined in so many parts of them.
PART_ROWS = 100_000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: base 32 of RFC 4648
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
ADDRESS = ["sha256", "sha1", "payload_bytes"]
# fixed values: the fields of a record as WARC 1.1 names them, and the head of the HTTP message in its block
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
END = "\r\n\r\n"
#: A field of our own, as the format allows: the id of the page, left out where it is null.
PAGE_FIELD = "X-Page-ID"


def base32_of_hex(digest: F.Column) -> F.Column:
    """40 hexadecimal digits as 32 of base 32: five digits make four."""
    fours = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*fours), DIGITS, ALPHABET)


def target_uri(url: F.Column) -> F.Column:
    """A URL fit for a header line: what isn't a printing ASCII character is percent-encoded, so no line can end in it."""
    each = F.transform(F.split(url, ""), lambda c: F.when(c == " ", "%20").when(c.rlike(r"[^\x21-\x7E]"), F.url_encode(c)).otherwise(c))
    return F.when(url.rlike(r"[^\x21-\x7E]"), F.array_join(each, "")).otherwise(F.coalesce(url, F.lit("")))


def _field(name: str, value: F.Column) -> F.Column:
    """A header line; nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0) -> str:
    """Writes the two tables under `path`, a folder that all executors reach, and returns it.

    Of the records of a payload of at least `min_bytes` bytes, that with the largest id is the response; the others
    revisit it. Null html is an empty payload; a null URL an empty target; a null id sorts first. Rows that repeat the
    largest id of a payload are responses all. Every row has a Record-ID of its own. `path` must not exist.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).cast("bigint").alias("record"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    address = {"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"), "payload_bytes": F.length("payload").cast("bigint")}
    rows = base.withColumns(address).select("record", "url", F.struct(*ADDRESS).alias("address"), F.monotonically_increasing_id().alias("number"))
    rows = checkpoint(rows)  # a row's number, and so its Record-ID, stays what it is from here on
    name = F.md5(F.concat_ws("\n", F.col("record").cast("string"), "url", "address.sha1", F.col("number").cast("string")).cast("binary"))
    rows = rows.withColumn("name", F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    held = rows.groupBy("address").agg(F.max(F.struct("record", "name")).alias("holder"), F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    held = checkpoint(held.select("address", F.col("holder.record").alias("newest"), F.col("holder.name").alias("holder"), "parts"))

    rows = join_skewed(rows, held, "address")
    response = (F.col("address.payload_bytes") < min_bytes) | F.col("record").eqNullSafe(F.col("newest"))
    http = F.format_string(HTTP, F.col("address.payload_bytes"))
    line = lambda s: F.concat(F.lit("<urn:uuid:"), s, F.lit(">"))
    headers = F.concat(
        F.lit("WARC/1.1\r\n"), _field("WARC-Type", F.when(response, "response").otherwise("revisit")), _field("WARC-Record-ID", line(F.col("name"))), _field("WARC-Target-URI", target_uri(F.col("url"))),
        _field("WARC-Date", F.lit(date)), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("address.sha1")))),
        _field("WARC-Profile", F.when(~response, PROFILE)), _field("WARC-Refers-To", F.when(~response, line(F.col("holder")))), _field(PAGE_FIELD, F.col("record").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _field("Content-Length", (F.length(http) + F.when(response, F.col("address.payload_bytes")).otherwise(0)).cast("string")), F.lit("\r\n"),
    )
    part = F.pmod(F.xxhash64("record", "number"), F.col("parts")).cast("int")
    rows.select("url", headers.alias("headers"), http.alias("http"), response.alias("holds"), part.alias("part"), "address.*").write.parquet(f"{path}/records")

    once = base.withColumns(address).groupBy(*ADDRESS).agg(F.first("payload").alias("payload"))
    once.join(held.select("address.*", "newest", "holder", "parts"), ADDRESS).write.parquet(f"{path}/payloads")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive: record, url, headers, payload, payload_bytes, payload_digest, record_type, refers_to, warc.

    `warc` is the exact record: header block, block and two line ends. The other columns are read from its bytes, but
    for `url`, which is kept as it was, and the payload of a revisit, which is what it refers to. The job fails where a
    stored payload doesn't give its address, a block isn't as long as its header says, or a payload differs from its digest.
    """
    held = spark.read.parquet(f"{path}/payloads")
    bad = (F.sha2("payload", 256) != F.col("sha256")) | (F.sha1("payload") != F.col("sha1")) | (F.length("payload") != F.col("payload_bytes"))
    stored = F.when(bad, F.raise_error(F.concat(F.lit("payload doesn't match its address "), F.col("sha256")))).otherwise(F.col("payload"))
    held = held.select(*ADDRESS, stored.alias("stored"), "newest", "holder", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = spark.read.parquet(f"{path}/records").join(held, [*ADDRESS, "part"])
    warc = F.concat(F.encode("headers", "UTF-8"), F.encode("http", "UTF-8"), F.when(F.col("holds"), F.col("stored")).otherwise(F.lit(b"")), F.lit(END.encode()))
    rows = rows.select("url", "headers", "stored", "newest", "holder", warc.alias("warc"))
    return parse(rows).select("record", "url", "headers", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc")


def parse(rows: DataFrame) -> DataFrame:
    """Reads the records in `warc`; `stored`, `newest` and `holder` are the payload that a revisit refers to, its page and its Record-ID."""
    size = F.instr(F.col("warc").cast("string"), END) + 3  # the header block is ASCII
    rows = rows.withColumn("_head", F.substring("warc", F.lit(1), size).cast("string"))
    field = lambda name, pattern: F.regexp_extract("_head", rf"\r\n{name}: {pattern}\r\n", 1)
    rows = rows.withColumns({
        "record_type": field("WARC-Type", r"(\w+)"), "_digest": field("WARC-Payload-Digest", r"sha1:(\w+)"), "_length": field("Content-Length", r"(\d+)").cast("bigint"),
        "_refers": field("WARC-Refers-To", r"<urn:uuid:([0-9a-f-]+)>"), "record": F.expr("try_cast(" + f"regexp_extract(_head, r'\\r\\n{PAGE_FIELD}: (-?\\d+)\\r\\n', 1) AS bigint)"),
    })
    rows = rows.withColumn("_block", F.substring("warc", F.length("_head") + 1, F.col("_length").cast("int")))
    whole = F.length("warc") == F.length("_head") + F.col("_length") + len(END)
    body = F.instr(F.col("_block").cast("string"), END) + len(END)
    own = F.substring("_block", body, F.length("_block"))
    response = F.col("record_type") == "response"
    rows = rows.withColumn("payload", F.when(response, own).otherwise(F.col("stored")))
    rows = rows.withColumn("payload_digest", base32_of_hex(F.sha1("payload")))
    fault = (
        F.when(~whole, F.lit("a block isn't as long as its header says")).when(F.col("payload_digest") != F.col("_digest"), F.lit("a payload differs from the digest in its header"))
        .when(~response & (F.col("_refers") != F.col("holder")), F.lit("a revisit refers to another record than the one that holds its payload"))
    )
    rows = rows.withColumn("record_type", F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("record_type")))
    return rows.withColumns({"payload_bytes": F.length("payload").cast("bigint"), "refers_to": F.when(~response, F.col("newest"))})


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables, beside the checkpoints: executors share it."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

"""A content-addressed WARC archive.

Payload bytes are stored once under their verified SHA-256; record headers are stored exactly, in cells of their
own, each with the digest of its payload. The header of a payload's only record stands in the payload's row; those
of payloads with several records stand apart and are joined back, so only payloads that records share travel when
an archive is read. Digests are recomputed from the stored bytes then; a payload that doesn't match its address
stops the read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeql.llm._common import shared_dir

#: Payloads below so many bytes are always written as responses.
REVISIT_FROM = 1000
#: Fixed values of the WARC format: header lines end so, and so do records.
LINE, RECORD_END = "\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Extension fields: the page's key, the key of the page referred to, and how the url stands in its field (escaped or none; absent: as it is).
PAGE, REFERRED, URL_FORM = "X-Page-ID", "X-Refers-To-Page-ID", "X-Target-Form"
#: What stands for a missing url, since a record must have one.
NO_URL = "about:blank"
#: All records carry one date, so that archiving the same rows again gives the same headers.
DATE = "1970-01-01T00:00:00Z"


def _field(name: str, value: Column | str) -> Column:
    """One header line, or nothing if the value is null."""
    shown = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), shown, F.lit(LINE)), F.lit(""))


def _one_line(value: Column) -> Column:
    """The value as it is; if it holds CR or LF, those and % percent-encoded."""
    safe = value
    for c in ("%", "\r", "\n"):
        safe = F.replace(safe, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(F.rlike(value, F.lit("[\r\n]")), safe).otherwise(value)


def header_value(header: Column, name: str) -> Column:
    """The field's value in a header text, null if it has none."""
    found = F.regexp_extract(header, rf"(?:^|\r\n)\Q{name}\E: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(header, F.lit(f"{LINE}{name}: ")), found)


def target_uri(header: Column) -> Column:
    """The page's url as it was: null where the header says that there was none, unescaped where it says so."""
    found, how = header_value(header, "WARC-Target-URI"), header_value(header, URL_FORM)
    plain = F.replace(F.replace(F.replace(found, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    return F.when(how == "none", F.lit(None).cast("string")).when(how == "escaped", plain).otherwise(found)


def _record_id(sha256: Column, key: Column, url: Column, copy: Column) -> Column:
    """A UUID made from a digest of what tells a record from all others: its payload, key and url, and which of the rows alike it is."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    h = F.sha2(F.concat(sha256, part(key.cast("string")), part(url), F.lit("#"), copy.cast("string")).cast("binary"), 256)
    cut = lambda a, n: F.substring(h, a, n)
    # Fixed values of the UUID layout: version 8 (made otherwise), variant 10.
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(13, 3), F.lit("-a"), cut(16, 3), F.lit("-"), cut(19, 12), F.lit(">"))


def _header(sha256: Column, key: Column, url: Column, copy: Column, n: Column, sha1: Column, revisit: Column, refers: Column) -> Column:
    """A record's header, in bytes; refers: the lines that a revisit has besides."""
    form = F.when(url.isNull(), F.lit("none")).when(F.rlike(url, F.lit("[\r\n]")), F.lit("escaped"))
    content = F.when(revisit, F.lit(0)).otherwise(n).cast("string")
    return F.concat(
        F.lit(f"WARC/1.1{LINE}"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(sha256, key, url, copy)),
        _field("WARC-Target-URI", F.coalesce(_one_line(url), F.lit(NO_URL))),
        _field("WARC-Date", DATE),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(revisit, refers).otherwise(F.lit("")),
        _field(PAGE, key.cast("string")),
        _field(URL_FORM, form),
        _field("Content-Type", "text/html; charset=utf-8"),
        _field("Content-Length", content),
        F.lit(LINE),
    ).cast("binary")


def write_archive(df: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html") -> None:
    """Archive each row of df as a WARC record under `path`, in kind=header and kind=payload (with the header of a payload's only record).

    The payload is the body in UTF-8 (null: empty). Of rows with equal payloads of at least REVISIT_FROM
    bytes, that with the largest key (null is least; of equal keys one) is a response, the others are revisits
    that refer to it; smaller ones are all responses. Every record has an id of its own, made from its payload's digest, key,
    url and place among rows alike, so writing again gives the same ids. A null key leaves its extension field out; a null url is
    about:blank with a field that says so. A url is stored byte for byte unless it holds CR or LF, which are escaped. Repeated
    rows are records of their own; other columns are not read; an empty table makes an empty archive.
    """
    raw = F.coalesce(F.col(f"`{body}`"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), raw.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    first = F.lit(1).cast("long")
    payloads = rows.groupBy("sha256").agg(F.first("payload").alias("bytes"), F.count("*").alias("holders"), F.first("key").alias("key"), F.first("url").alias("url"))
    own = _header(F.col("sha256"), F.col("key"), F.col("url"), first, F.octet_length("bytes"), F.sha1("bytes"), F.lit(False), F.lit(""))
    payloads = payloads.select("sha256", "bytes", F.when(F.col("holders") == 1, own).alias("header"), F.lit("payload").alias("kind"))
    # The other headers are made without their payloads: rows alike are counted, the largest key of a payload is found.
    alike = rows.groupBy("sha256", "key", "url").agg(F.count("*").alias("copies"), F.max(F.struct(F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha1"))).alias("of"))
    rank = F.struct(F.col("key").isNotNull().alias("has"), F.col("key").alias("key"), F.col("url").isNotNull().alias("named"), F.col("url").alias("url"))
    winner = alike.groupBy("sha256").agg(F.max(rank).alias("top"), F.sum("copies").alias("holders")).filter("holders > 1")
    each = alike.join(winner, "sha256").select("*", F.explode(F.sequence(first, F.col("copies"))).alias("copy"))
    stores = rank.eqNullSafe(F.col("top")) & (F.col("copy") == 1)
    revisit = (F.col("of.n") >= REVISIT_FROM) & ~stores
    refers = F.concat(_field("WARC-Refers-To", _record_id(F.col("sha256"), F.col("top.key"), F.col("top.url"), first)), _field(REFERRED, F.col("top.key").cast("string")), _field("WARC-Profile", REVISIT_PROFILE))
    header = _header(F.col("sha256"), F.col("key"), F.col("url"), F.col("copy"), F.col("of.n"), F.col("of.sha1"), revisit, refers)
    headers = each.select("sha256", header.alias("bytes"), F.lit(None).cast("binary").alias("header"), F.lit("header").alias("kind"))
    headers.unionByName(payloads).write.partitionBy("kind").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every archived record: header (text), payload, payload_bytes, sha256, record (the WARC record's exact bytes), and the
    header's page_id, url, record_type, refers_to and payload_digest.

    A payload whose bytes don't give its address, or a header's digest, raises an error.
    """
    stored = spark.read.schema("sha256 string, bytes binary, header binary, kind string").parquet(path)
    right = F.when(F.sha2("payload", 256) == F.col("sha256"), F.sha1("payload")).otherwise(F.raise_error(F.lit("a stored payload doesn't match its digest")))
    bodies = lambda which: stored.filter((F.col("kind") == "payload") & which).select("sha256", F.col("header").cast("string").alias("header"), F.col("bytes").alias("payload")).withColumns({"sha1": right, "payload_bytes": F.octet_length("payload").cast("long")})
    heads = stored.filter(F.col("kind") == "header").select("sha256", F.col("bytes").cast("string").alias("header"))
    shared = heads.join(bodies(F.col("header").isNull()).drop("header"), "sha256")
    both = shared.unionByName(bodies(F.col("header").isNotNull()))
    page = lambda name: header_value(F.col("header"), name).cast("long")
    digest = F.substring(header_value(F.col("header"), "WARC-Payload-Digest"), 6, 40)
    kind = header_value(F.col("header"), "WARC-Type")
    return both.select(
        page(PAGE).alias("page_id"),
        target_uri(F.col("header")).alias("url"),
        kind.alias("record_type"),
        page(REFERRED).alias("refers_to"),
        F.when(digest == F.col("sha1"), F.col("sha1")).otherwise(F.raise_error(F.lit("a header's digest doesn't match its payload"))).alias("payload_digest"),
        "header",
        "payload",
        "payload_bytes",
        "sha256",
        F.concat(F.col("header").cast("binary"), F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload")), F.lit(RECORD_END.encode())).alias("record"),
    )


def export(records: DataFrame, path: str, compression: str = "none") -> None:
    """The records of read_archive() as WARC files below `path`, one a partition, whole and readable by themselves.

    The text writer's line end is the records' end. compression: none, or gzip as Spark writes it (one member a file).
    """
    body = F.expr("substring(record, 1, octet_length(record) - 4)")
    records.select(body.cast("string").alias("value")).write.option("lineSep", RECORD_END).option("compression", compression).text(path)


def archive_and_read(df: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Archive df to the shared folder and read the records back."""
    path = f"{shared_dir(df.sparkSession)}/treeql-warc-{uuid.uuid4().hex}"
    write_archive(df, path, key, url, body)
    return read_archive(df.sparkSession, path)

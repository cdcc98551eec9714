"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

A record is one line of text whose line ending is the two CRLFs that close a WARC record, so any file system that
Spark writes to will do. Equal payloads are written once, as a response; the others are revisits that refer to it
and keep its HTTP headers.

Reading splits files at the magic ``WARC/1.1``, wherever it stands. Each candidate gets its offset in the file
(from the bytes of the lines before it), its declared successor and the digest of its bytes. Candidates that follow each other are joined
into runs, unless another record points between them, and pointer jumping from offset 0 over the runs keeps what a
chain of records reaches. A magic inside a payload is never reached; its line belongs to the record before it. Records
with such lines are put together by a second scan, which finds the lines by file and digest, so it doesn't matter how
either scan was split. A file's candidates go through one task as slim rows; the writer puts ``RECORDS_A_FILE`` records
in a file at most.

Defined results: null html is an empty payload; of rows that repeat id and html, all but one are revisits; a null
id is larger than any other and comes back null; line breaks in a URL are written as %0D and %0A; an empty table
gives an empty archive; extra columns are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stow
from .exact_dedup import mark_copies

MAGIC = "WARC/1.1\r\n"
CRLF2 = "\r\n\r\n"
RECORDS_A_FILE = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight groups of 20 bits, each as four digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row of pages (page_id, url, html) to the folder path."""
    pages = mark_copies(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")), "page_id", "html", keep="min")
    many = pages.where("kept and keep_rows > 1")
    first = F.row_number().over(Window.partitionBy("copy_key").orderBy("page_id")) == 1
    pages = pages.where("not kept or keep_rows = 1").withColumn("first", F.col("kept")).unionByName(many.withColumn("first", first))

    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    payload = F.col("html").cast("binary")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload), F.lit(CRLF2))
    block = F.when(F.col("first"), F.concat(http, F.col("html"))).otherwise(http)
    refers = F.when(F.col("first"), "").otherwise(F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn("keep_id"), F.lit("\r\n")))
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(F.col("first"), "response").otherwise("revisit"), F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_sha1(payload), F.lit("\r\n"), refers,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(CRLF2), block,
    )
    pages.select(record.alias("value")).write.option("lineSep", CRLF2).option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?m)^{name}: ?([^\r\n]*)", 1)


def _parsed(value: Column) -> list[Column]:
    """What a candidate says of itself; value: the bytes from after its magic up to the next magic."""
    head = F.substring_index(value, CRLF2, 1)
    head_bytes = F.octet_length(head) + 4
    length = F.expr("try_cast(regexp_extract({0}, '(?m)^Content-Length: ?([0-9]+)', 1) as bigint)".format("substring_index(value, '\\r\\n\\r\\n', 1)"))
    block = F.substring(value.cast("binary"), head_bytes + 1, F.least(length, F.lit((1 << 31) - 1)).cast("int"))  # no value is longer
    http = F.substring_index(block.cast("string"), CRLF2, 1)
    payload = F.substring(block, F.octet_length(http) + 5, F.octet_length(block))
    page = lambda name: F.expr("try_cast(regexp_extract(substring_index(value, '\\r\\n\\r\\n', 1), '(?m)^%s: ?<urn:page:(-?[0-9]+)>', 1) as bigint)" % name)
    kind = _field(head, "WARC-Type")
    told = F.expr("try_cast(regexp_extract(substring_index(substring_index(value, '\\r\\n\\r\\n', 2), '\\r\\n\\r\\n', -1), '(?m)^Content-Length: ?([0-9]+)', 1) as bigint)")
    full = kind == "response"
    return [
        kind.alias("record_type"), page("WARC-Record-ID").alias("page_id"), page("WARC-Refers-To").alias("refers_to"), _field(head, "WARC-Target-URI").alias("url"),
        (head_bytes + length + 4).alias("declared"),
        F.when(full, F.octet_length(payload).cast("long")).otherwise(told).alias("payload_bytes"),
        F.when(full, base32_sha1(payload)).otherwise(F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha1:", "")).alias("payload_digest"),
    ]


RESULT = ("record_type", "page_id", "refers_to", "url", "payload_bytes", "payload_digest")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.unhex(F.md5(F.col("value").cast("binary"))).alias("digest"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every magic in the files of path: (file, at, size, digest, declared successor and what the record says)."""
    said = _lines(spark, path).select("file", "split", "digest", F.monotonically_increasing_id().alias("line"), F.octet_length("value").cast("long").alias("size"), *_parsed(F.col("value")))
    said = stow(said, "candidates")
    in_file = Window.partitionBy("file").orderBy("split", "line")
    start = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = said.withColumn("at", start - len(MAGIC)).where("at >= 0").drop("split", "line")
    return at.withColumn("next", F.col("at") + len(MAGIC) + F.coalesce("declared", F.col("size")))


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain from offset 0 of their file reaches, by pointer jumping over runs."""
    in_file = Window.partitionBy("file").orderBy("at")
    follows = found.withColumn("after", F.lag("next").over(in_file)).withColumn("ahead", F.lead("at").over(in_file))
    into = follows.where(F.col("ahead").isNotNull() & (F.col("next") != F.col("ahead"))).select(F.col("file").alias("to_file"), F.col("next").alias("to")).distinct()
    heads = follows.join(into, (F.col("file") == F.col("to_file")) & (F.col("at") == F.col("to")), "left")
    head = F.col("after").isNull() | (F.col("after") != F.col("at")) | F.col("to").isNotNull()
    runs = stow(heads.withColumn("run", F.max(F.when(head, F.col("at"))).over(in_file.rowsBetween(Window.unboundedPreceding, 0))).drop("after", "ahead", "to", "to_file"), "runs")
    exits = runs.groupBy("file", "run").agg(F.max_by("next", "at").alias("exit"))
    starts = exits.select(F.col("file").alias("to_file"), F.col("run").alias("to"))
    jump = stow(exits.join(starts, (F.col("file") == F.col("to_file")) & (F.col("exit") == F.col("to"))).select("file", "run", "to"), "jump")
    reached = exits.where("run = 0").select("file", "run")
    while True:
        more = reached.join(jump, ["file", "run"]).select("file", F.col("to").alias("run")).join(reached, ["file", "run"], "left_anti").distinct()
        more = stow(more, "reached")
        if more.isEmpty():
            break
        reached = stow(reached.unionByName(more), "reached")
        further = jump.select("file", F.col("run").alias("to"), F.col("to").alias("far"))
        jump = stow(jump.join(further, ["file", "to"]).select("file", "run", F.col("far").alias("to")), "jump")
    return runs.join(reached, ["file", "run"], "left_semi")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record in the archives of path: record_type, page_id, refers_to, url, payload_bytes, payload_digest."""
    found = candidates(spark, path)
    good = stow(reachable(found), "records")
    whole = good.where((F.col("size") >= F.col("declared")) | F.col("declared").isNull())
    torn = good.where(F.col("size") < F.col("declared"))
    n = torn.count()
    if not n:
        return whole.select(*RESULT)
    # Records whose payload holds a magic: each line up to the declared end belongs to the last such record before it.
    starts = torn.select(F.col("file").alias("of"), F.col("at").alias("start"), (F.col("at") + len(MAGIC) + F.col("declared")).alias("end"))
    started = found.join(F.broadcast(starts) if n <= BROADCAST_ROWS else starts, (F.col("file") == F.col("of")) & (F.col("at") == F.col("start")), "left")
    so_far = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("start").isNotNull(), F.struct("start", "end")), ignorenulls=True).over(so_far)
    parts = started.select("file", "at", "digest", "size", owner.alias("owner")).where(F.col("at") < F.col("owner.end"))
    parts = stow(parts.select("file", "at", "digest", "size", F.col("owner.start").alias("start")), "parts")
    wanted = parts.select("file", "digest", "size").distinct()
    lines = _lines(spark, path).withColumn("size", F.octet_length("value").cast("long"))
    lines = lines.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, ["file", "digest", "size"])
    lines = lines.groupBy("file", "digest", "size").agg(F.first("value").alias("value")).join(parts, ["file", "digest", "size"])
    joined = lines.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("lines"))
    joined = joined.select(F.array_join(F.transform("lines", lambda x: x["value"]), MAGIC).alias("value"))
    return whole.select(*RESULT).unionByName(joined.select(*_parsed(F.col("value"))).select(*RESULT))

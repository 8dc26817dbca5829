"""WARC archives: written from captures, read back, and assembled into one nested row per capture."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphspark.llm.common import bound_batches, join_groups, new_path, release_memory

#: Payloads of fewer bytes are never replaced by a revisit.
REVISIT_BYTES = 100
#: Compressed records are gathered up to this many bytes, and so many of these pieces make up a file: a file is larger only if single
#: records are.
PIECE_BYTES, PIECES_PER_FILE = 4 << 20, 8
DATE = "2020-01-01T00:00:00Z"
# Fixed values of the format: the version line, and the profile of a revisit to an identical payload.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = b"\r\n\r\n"


def record_id(kind: str, *parts):
    """A URN that only depends on its parts, so that any row can name another's record."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), *[F.concat(F.lit("-"), F.substring(h, a, n)) for a, n in ((9, 4), (13, 4), (17, 4), (21, 12))], F.lit(">"))


def record(headers: list[tuple[str, object]], block):
    """Header lines with a value, the block's length, and the block."""
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in headers]
    return F.concat(F.lit(f"{VERSION}\r\n"), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes request, response (or revisit) and metadata records of every page into archives of bounded size, each record a gzip member
    of its own.

    Of equal payloads of at least REVISIT_BYTES bytes the one with the smallest id is the response. Null payloads are
    empty; a null id is written as null and never is the smallest; rows that repeat an id and
    a payload are numbered, so each has records of its own; line breaks in addresses are escaped; very long payloads are records like any
    other; an empty table gives no records; other columns are ignored, whatever their names. Payloads are
    shuffled once, by their digest; those that most pages share are resolved by a broadcast of a fixed number of rows. Spark's text
    writer writes the bytes, so any file system can be written to and a lost task leaves nothing: a member ends with a zero byte (its
    length is below 2**24, or else readers skip the zero byte as padding), which is what the writer puts between rows."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.regexp_replace(url_col, "\r", "%0D"), "\n", "%0A").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    first = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.min_by("url", F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("first_url")).where("n > 1")
    rows = join_groups(rows, first, "digest", "n", F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("/"), F.col("digest")).cast("binary"), 256), "dealt").drop("n")
    # Rows that repeat an id and a payload were dealt to one task by the join, so numbering them moves nothing.
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("dealt", "id", "digest").orderBy("url"))).drop("dealt")
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("id")), F.lit(False))
    own = record_id("capture", F.col("id"), F.col("digest"), F.col("nth"))
    length = F.octet_length("payload").cast("string")
    digest = F.concat(F.lit("sha256:"), "digest")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n\r\n"))
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url"))]
    response = record([("WARC-Type", F.lit("response")), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(head, "payload"))
    again = record(
        [("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", record_id("capture", F.col("first_id"), F.col("digest"), F.lit(1))),
         ("WARC-Refers-To-Target-URI", F.col("first_url")), ("Content-Type", F.lit("application/http; msgtype=response"))], head)
    host, target = F.regexp_extract("url", r"^\w+://([^/?#]*)", 1), F.regexp_extract("url", r"^\w+://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.coalesce(F.when(target != "", target), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit("\r\n\r\n"))
    request = record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id("request", F.col("id"), F.col("digest"), F.col("nth"))), ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/http; msgtype=request"))], asked)
    notes = F.concat(F.lit("capture-id: "), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit("\r\n"))
    metadata = record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id("metadata", F.col("id"), F.col("digest"), F.col("nth"))), ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/warc-fields"))], notes)
    bound_batches(pages.sparkSession)
    records = rows.select(request.alias("request"), F.when(revisit, again).otherwise(response).alias("capture"), metadata.alias("metadata"))
    pieces = records.mapInArrow(compress, "value binary").select(F.col("value").cast("string").alias("value"))
    pieces.write.option("lineSep", "\0").option("maxRecordsPerFile", PIECES_PER_FILE).text(path)


def compress(batches):
    """Records as gzip members, many in a row but for its last zero byte."""
    held, size = [], 0

    def piece():
        data = b"".join(held)
        return pa.RecordBatch.from_arrays([pa.array([data[:-1] if data.endswith(b"\0") else data], pa.binary())], names=["value"])

    for batch in batches:
        for row in zip(*(c.cast(pa.binary()) for c in batch.columns)):
            for text in row:
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                held += [packer.compress(text.as_buffer()), packer.compress(RECORD_END), packer.flush()]
                size += len(held[-3]) + len(held[-1])
            if size >= PIECE_BYTES:
                yield piece()
                held, size = [], 0
    if held:
        yield piece()
    release_memory()


RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "content_type", "declared_digest", "fields")]
    + [T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType())]
)


def members(data, step: int = 1 << 16):
    """What each member of a gzip file holds, or the data itself if it isn't compressed."""
    view = memoryview(data)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield data
        return
    at, n = 0, len(view)
    while at < n:
        if view[at] == 0:  # padding
            at += 1
            continue
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof:
            if at >= n:
                raise ValueError("the last member is cut off")
            parts.append(reader.decompress(view[at : at + step]))
            at = min(at + step, n)
        at -= len(reader.unused_data)
        yield b"".join(parts)


def parse(data):
    """Yields the header fields (in lower case) and the block of each record of an archive, compressed or not."""
    for raw in members(data):
        at, n = 0, len(raw)
        while at < n:
            stop = raw.find(b"\r\n\r\n", at)
            if stop < 0 or not raw.startswith(b"WARC/", at):
                raise ValueError(f"no WARC record at byte {at}")
            headers = {}
            for line in raw[at:stop].split(b"\r\n")[1:]:
                k, _, v = line.partition(b":")
                headers[k.strip().lower().decode()] = v.strip().decode("utf-8", "replace")
            begin = stop + 4
            end = begin + int(headers["content-length"])
            if end > n:
                raise ValueError(f"the record at byte {at} is cut off")
            yield headers, raw[begin:end]
            at = end + 4


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record. A task's files are read one after the other and their records decompressed one by one; files are as large as
    write_warc leaves them. Without payload its bytes are digested and dropped. No file gives no row."""
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                for h, block in parse(content.as_buffer()):
                    kind = h.get("warc-type")
                    body = block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit") else b""
                    full = kind == "response"
                    out.append((
                        kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), h.get("warc-payload-digest"),
                        block.decode("utf-8", "replace") if kind in ("metadata", "request") else None, body if payload and full else None, len(body) if full else None, hashlib.sha256(body).hexdigest() if full else None,
                    ))
                    if len(out) == 500:
                        yield to_batch(out)
                        out = []
                if out:
                    yield to_batch(out)

    def to_batch(rows):
        kinds = [pa.string()] * 9 + [pa.binary(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=RECORD.names)

    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: what its response or revisit, request and metadata records say.

    Records that name another as concurrent belong to its capture. A revisit has the payload's size and digest from the
    response that it refers to, which is joined by id; the revisits of one response are split if they skew the join.
    Records that repeat are taken once; a capture without a request or metadata has null there; records that name an
    absent capture give no row."""
    own = F.col("record_type").isin("response", "revisit")
    capture = F.when(own, F.col("record_id")).otherwise(F.col("concurrent_to"))
    part = lambda kind, *cols: F.max(F.when(F.col("record_type") == kind, F.struct(*cols)))
    rows = records.withColumn("capture_id", capture).where("capture_id is not null").groupBy("capture_id").agg(
        F.max(F.when(own, F.struct("record_type", "target_uri", "date", "refers_to", "declared_digest", "payload_bytes", "payload_digest", "payload"))).alias("response"),
        part("request", "record_id", "target_uri", "fields").alias("request"),
        part("metadata", "record_id", "fields").alias("metadata"),
    ).where("response is not null")
    page = F.regexp_extract("metadata.fields", r"(?m)^capture-id: (.*?)\r?$", 1)
    rows = rows.withColumn("page", F.when(page != "null", page))
    return rows


def resolve(captures: DataFrame) -> DataFrame:
    """Adds origin: of each revisit the response's page, size and digest (null where that is absent); of a response its own. The
    responses that most revisits refer to are broadcast, a fixed number of rows."""
    size = F.struct(F.col("page").alias("page"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"))
    responses = captures.where("response.record_type = 'response'").withColumn("origin", size)
    revisits = captures.where("response.record_type = 'revisit'").withColumn("__target", F.coalesce("response.refers_to", "capture_id"))
    times = revisits.groupBy("__target").agg(F.count(F.lit(1)).alias("__times"))
    targets = responses.select(F.col("capture_id").alias("__target"), "origin").join(times, "__target")
    found = join_groups(revisits, targets, "__target", "__times", F.md5(F.col("capture_id").cast("binary"))).drop("__target", "__times")
    return responses.unionByName(found)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    write_warc(pages, path)
    found = resolve(assemble(read_warc(spark, path, payload=False)))
    return found.select(
        F.col("page").cast("long").alias("page_id"), F.col("origin.payload_bytes").alias("payload_bytes"), F.col("origin.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
        F.when(F.col("response.record_type") == "revisit", F.col("origin.page").cast("long")).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT page_id, n, sha256(html) AS payload_digest, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

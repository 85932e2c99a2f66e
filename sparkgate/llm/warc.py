"""WARC archives: writing with revisits and segments, and reading back with segment reassembly."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgate.session import materialize, remove_path, scratch_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2020-01-01T00:00:00Z"
#: Longest block of one record; what is longer goes on in continuation records.
SEGMENT = 1 << 16
#: Length of a chunk of chunked transfer framing.
CHUNK = 1 << 13
#: Records per archive file: with SEGMENT a bound on the size of a file, which a reader holds whole in compressed form.
FILE_RECORDS = 2000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column."""
    digest = F.sha1(payload)
    quads = [F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 10).cast("int") for k in range(8)]
    letter = lambda n: F.substring(F.lit(BASE32), n.bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*[letter(F.shiftright(q, s)) for q in quads for s in (15, 10, 5, 0)])


def mark_revisits(payloads: DataFrame, least_bytes: int) -> DataFrame:
    """payloads (page_id, url, payload) with bytes, digest, record_type and refers_to.

    Of equal payloads of at least least_bytes bytes the smallest page_id is the response, others revisit it. Only digests and ids are
    grouped, in a partial aggregate; only the digests that occur twice come back by a join.
    """
    hashed = payloads.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    first = materialize(hashed.where(F.col("bytes") >= least_bytes).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "digests")
    marked = hashed.join(first, (F.col("digest") == F.col("d")) & (F.col("bytes") >= least_bytes), "left").drop("d")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return marked.withColumn("refers_to", refers).withColumn("record_type", F.when(refers.isNull(), "response").otherwise("revisit")).drop("first")


def named(marked: DataFrame, ids: DataFrame) -> DataFrame:
    """marked with name, unique per row, and target, the name of the response that a revisit refers to. ids has the page_id of each row.

    A name is the page_id; of rows with the same page_id it is page_id.digest.number, and of rows without one null.number. Only repeated ids are put in groups.
    """
    again = materialize(ids.where("page_id is not null").groupBy(F.col("page_id").alias("again")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    plain = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("null."), F.monotonically_increasing_id().cast("string")))
    if again.isEmpty():
        return marked.withColumn("name", plain).withColumn("target", F.col("refers_to").cast("string"))
    to = again.withColumnRenamed("again", "to")
    first = F.when(F.col("to").isNull(), F.col("refers_to").cast("string")).otherwise(F.concat_ws(".", "refers_to", "digest", F.lit(1)))
    rows = marked.join(to, F.col("refers_to") == F.col("to"), "left").withColumn("target", first).drop("to").join(again, F.col("page_id") == F.col("again"), "left")
    number = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url"))
    repeats = rows.where("again is not null").withColumn("name", F.concat_ws(".", "page_id", "digest", number))
    return rows.where("again is null").withColumn("name", plain).unionByName(repeats).drop("again")


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """data in pieces of at most `size` bytes that end between characters of UTF-8, so that each is text; a character is never longer than size."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80 and end > at + max(1, size - 3):
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(part), part) for part in pieces(payload, size)]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """The payload within chunked transfer framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + n]
        if len(part) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(part)
        at = end + 4 + n


def records(page_id: int | str, url: str, payload: bytes, digest: str, refers_to: int | str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The WARC/1.1 records of one page: a response in one or more segments, or a revisit without a body. page_id and refers_to are unique names of records, as named() gives them."""
    uri = "<urn:page:%s>"
    url = "".join(c if 32 < ord(c) < 127 else "%%%02X" % ord(c) if ord(c) < 256 else "?" for c in url or "about:blank")
    head = ["WARC/1.1", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}"]
    if refers_to is not None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        extra = ["WARC-Type: revisit", "WARC-Record-ID: " + uri % page_id, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To: " + uri % refers_to, f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(http)}"]
        yield "\r\n".join([*head, *extra, "", ""]).encode() + http + b"\r\n\r\n"
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = list(pieces(block, segment))
    for k, part in enumerate(parts):
        kind = ["WARC-Type: response", "WARC-Record-ID: " + uri % page_id, f"WARC-Payload-Digest: sha1:{digest}"] if k == 0 else ["WARC-Type: continuation", "WARC-Record-ID: " + uri % f"{page_id}:{k + 1}", "WARC-Segment-Origin-ID: " + uri % page_id]
        if len(parts) > 1:
            kind.append(f"WARC-Segment-Number: {k + 1}")
            if k + 1 == len(parts):
                kind.append(f"WARC-Segment-Total-Length: {len(block)}")
        yield "\r\n".join([*head, *kind, f"Content-Length: {len(part)}", "", ""]).encode() + part + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, segment: int = SEGMENT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Gzipped WARC files of pages (id, url, html) under path, written by Spark: any store, no local file.

    A null html is an empty payload, a null url about:blank. Ids may repeat or be null: each row has records of its own. A row without an id revisits the response of its payload, if one with an id has it; else it is a response. Other columns are not written.
    """
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    marked = named(mark_revisits(read, least_bytes), read.select("page_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                # A record ends in a line feed, which the text writer puts there. Segments and chunks end between characters, so every record is text.
                lines = [r[:-1].decode() for x in zip(*(c.to_pylist() for c in rows.columns)) for r in records(*x, segment=segment)]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    lines = marked.select("name", "url", "payload", "digest", "target").mapInArrow(run, "value string")
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a WARC stream, by Content-Length."""
    held = bytearray()
    at, ended = 0, False

    def more() -> bool:
        nonlocal ended
        part = next(stream, None)
        if part is None:
            ended = True
        else:
            held.extend(part)
        return not ended

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if held[at:].strip():
                    raise ValueError("an archive ends within a record")
                return
        first, *rest = held[at:end].decode().lstrip("\r\n").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
        size = int(headers["content-length"])
        while len(held) < end + 4 + size + 4:
            if not more():
                raise ValueError("an archive ends within a record")
        yield headers, bytes(held[end + 4 : end + 4 + size])
        at = end + 4 + size + 4
        if at > 1 << 20:
            del held[:at]
            at = 0


def _gunzip(data: bytes) -> Iterator[bytes]:
    """Plain parts of a file that may be gzipped, in one or more members."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        z = zlib.decompressobj(31)
        for k in range(0, len(data), 1 << 16):
            yield z.decompress(data[k : k + (1 << 16)])
            if z.eof:
                break
        data = z.unused_data + data[k + (1 << 16) :]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: record_id, origin (the first segment's id), record_type, refers_to, digest, url, segment, total (null unless given), last, block."""
    names = ["record_id", "origin", "record_type", "refers_to", "digest", "url", "segment", "total", "block"]
    schema = "record_id string, origin string, record_type string, refers_to string, digest string, url string, segment int, total long, block binary"
    kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, block in parse(_gunzip(content.as_py())):
                    total = h.get("warc-segment-total-length")
                    rows.append((h["warc-record-id"], h.get("warc-segment-origin-id", h["warc-record-id"]), h["warc-type"], h.get("warc-refers-to"), h.get("warc-payload-digest"), h.get("warc-target-uri"), int(h["warc-segment-number"]) if "warc-segment-number" in h else None, total and int(total), block))
                    held += len(block)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, schema)


def reassemble(rows: DataFrame) -> DataFrame:
    """Whole records: record_id, record_type, refers_to, digest, url, block.

    Segments are grouped by origin and put in order by their number. A group is whole when its numbers run from 1 without a gap or a repeat and the
    last gives the total length of all; anything else has block null. Records without a segment number are not shuffled.
    """
    names = ["record_id", "record_type", "refers_to", "digest", "url", "block"]
    schema = "record_id string, record_type string, refers_to string, digest string, url string, block binary"
    single = rows.where("segment is null").select(*names)
    parts = F.sort_array(F.collect_list(F.struct("segment", "block", "total", "record_type", "refers_to", "digest", "url")))
    groups = rows.where("segment is not null").groupBy(F.col("origin").alias("record_id")).agg(parts.alias("p"))
    # Numbers 1, 2, 3, ... with the total at the last.
    last = F.element_at("p", -1)["total"]
    whole = F.forall(F.transform("p", lambda x, k: x["segment"] == k + 1), lambda x: x)
    head = lambda name: F.element_at("p", 1)[name].alias(name)
    ordered = groups.select("record_id", head("record_type"), head("refers_to"), head("digest"), head("url"), F.when(whole, last).alias("total"), F.transform("p", lambda x: x["block"]).alias("blocks"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                block = b"".join(row.column(6)[0].as_py())
                block = block if len(block) == row.column(5)[0].as_py() else None
                yield pa.RecordBatch.from_arrays([*row.columns[:5], pa.array([block], pa.binary())], names=names)

    return single.unionByName(ordered.mapInArrow(join, schema))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per whole record of the WARC files under path: record_id, record_type, refers_to, url, digest (as stated), payload.

    Continuations are reassembled; the payload is the body of the HTTP message with chunked framing taken off. payload is null for revisits,
    incomplete segment groups and broken framing. An archive without records gives no row.
    """
    whole = reassemble(read_records(spark, path))

    def body(block: bytes | None, kind: str) -> bytes | None:
        if block is None or kind == "revisit":
            return None
        head, _, rest = block.partition(b"\r\n\r\n")
        try:
            return dechunk(rest) if b"transfer-encoding: chunked" in head.lower() else rest
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = [body(b.as_py(), k) for b, k in zip(batch.column(5), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(payload, pa.binary())], names=[*batch.schema.names[:5], "payload"])

    return whole.select("record_id", "record_type", "refers_to", "digest", "url", "block").mapInArrow(run, "record_id string, record_type string, refers_to string, digest string, url string, payload binary")


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    found = read_archives(spark, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)(?:\.[A-Z2-7]+\.[0-9]+)?>$", 1).try_cast("long")
    read = materialize(found.select("record_id", F.col("refers_to").alias("target"), number("record_id").alias("page_id"), number("refers_to").alias("refers_to"), "record_type", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")), "read")
    remove_path(spark, path)
    # A revisit has the payload of the response it names; names are unique.
    responses = read.where("record_type = 'response'").select(F.col("record_id").alias("to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    own = read.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    visits = read.where("record_type = 'revisit'").join(responses, F.col("target") == F.col("to"), "left").select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to")
    return own.unionByName(visits)


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p),
d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest
  FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

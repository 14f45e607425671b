"""WARC archives: writing pages, and assembling captures from request, response and metadata records.

Writing: a page becomes three records (request, response or revisit, metadata); request and metadata name the response
through WARC-Concurrent-To. Of records whose payloads are equal and at least ``MIN_BYTES`` long, the one with the
largest page_id is a response and the others are revisits that refer to it. A record is one gzip member, so that a
reader can hold one at a time. Which pages are revisits is found on narrow rows; the pages that are responses leave them out by a
broadcast where these rows have at most ``BROADCAST_BYTES``, beyond that by an exchange. Archives of
about ``FILE_BYTES`` are rows of Spark's text writer, whose row separator is an empty gzip member, so they reach any store
Spark writes to, under its commit protocol.

A page's record id follows from its page_id and its row's place: file and row number of the scan, or a stored row number
where ``pages`` is no scan. It is the same whenever a task runs again.

Reading: archives are parsed to one row a record, whatever their compression, a record at a time. A record's capture is
the response (or revisit) that it is joined to through concurrent-to identifiers, its own or the other's, directly or
over one more record. One nested row is emitted per capture, with its whole payload; records with no response form captures of
their own. Between archive and capture payloads may be packed (zstandard), so that shuffles and stored records stay small.

Defined cases: a null html is an empty payload; a null url or page_id is left out of the records and comes back null;
repeated rows are captures of their own (of equal largest page_ids one row is the response); empty payloads and tables
are fine; a very long html is a record, and an archive, of its own; other columns, whatever their names, are not read. A
record cut short, or whose payload hasn't the digest that it states, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.llm.common import rows_of, slices

#: Least payload of a revisit; compressed bytes of an archive; decompressed bytes taken at a time; bytes of rows handed on at a time.
MIN_BYTES, FILE_BYTES, CHUNK, HELD = 1000, 8 << 20, 1 << 20, 4 << 20
#: Bytes of the revisits' ids up to which they are broadcast, and of one such id, about.
BROADCAST_BYTES, ID_BYTES = 32 << 20, 120
#: Fixed values of the format.
LINE, GAP = "\r\n", "\r\n\r\n"
GZIP = b"\x1f\x8b"
EMPTY_MEMBER = GZIP + b"\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = "record_id string, record_type string, concurrent_to array<string>, target_uri string, refers_to string, payload_digest string, header string, payload binary"


def _member(kind: str, rid: str, block: bytes, headers: list[tuple[str, str | None]]) -> bytes:
    """A record as a gzip member; headers whose value is null are left out."""
    import zlib

    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress((LINE.join(lines) + GAP).encode()) + squeeze.compress(block) + squeeze.compress(GAP.encode()) + squeeze.flush()


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: {size}{GAP}".encode()


def _about_response(url: str | None, digest: str) -> list[tuple[str, str | None]]:
    return [("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]


def _rows(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, rid: the id of a row's response record."""
    wanted = [F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.col("url").cast("string"), "[\\x00-\\x20]", "%20").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")]
    try:
        scan = pages.metadataColumn("_metadata")
        own = pages.select(*wanted, F.concat_ws(":", scan["file_path"], scan["row_index"]).alias("row"))
    except AnalysisException:
        own = scratch.stored(pages.select(*wanted, F.monotonically_increasing_id().cast("string").alias("row")), "warc-pages")
    return own.select("page_id", "url", "payload", F.concat(F.lit("urn:sha1:"), F.sha1(F.concat_ws(":", F.lit("page"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "row"))).alias("rid"))


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, rid, payload) with size, digest and the response record, ready compressed, in the payload's place."""
    import hashlib

    for b in slices(batches, 64):
        sizes, digests, members = [], [], []
        for url, rid, payload in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).cast(pa.binary()).to_pylist(), strict=True):
            sizes.append(len(payload))
            digests.append(hashlib.sha1(payload).hexdigest())
            members.append(_member("response", rid, _http(len(payload)) + payload, _about_response(url, digests[-1])))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(members, pa.binary())], names=["page_id", "url", "rid", "size", "digest", "response"])


def _archives(file_bytes: int):
    """Rows (page_id, url, rid, size, digest, response, first_rid, first_url) to archives (``value``) without their last empty member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        close = lambda: pa.RecordBatch.from_pydict({"value": [b"".join(held)]}, schema=pa.schema([("value", pa.binary())]))
        for page_id, url, rid, length, digest, response, first_rid, first_url in rows_of(slices(batches, 64)):
            if first_rid is not None:
                response = _member("revisit", rid, _http(length), [*_about_response(url, digest), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{first_rid}>"), ("WARC-Refers-To-Target-URI", first_url)])
            asked = f"GET {url or '/'} HTTP/1.1{GAP}".encode()
            about = b"" if page_id is None else f"page-id: {page_id}{LINE}".encode()
            beside = [("WARC-Target-URI", url), ("WARC-Concurrent-To", f"<{rid}>")]
            held += [_member("request", f"{rid}:q", asked, [*beside, ("Content-Type", "application/http; msgtype=request")]), response, _member("metadata", f"{rid}:m", about, [*beside, ("Content-Type", "application/warc-fields")])]
            size += sum(map(len, held[-3:]))
            if size >= file_bytes:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    return run


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> None:
    """Archives of about ``file_bytes`` compressed bytes in the folder ``path``."""
    own = _rows(pages)
    narrow = own.select("page_id", "rid", "url", F.octet_length("payload").cast("long").alias("size"), F.sha1(F.col("payload").cast("binary")).alias("digest"), F.sha2("payload", 256).alias("same")).filter(F.col("size") >= min_bytes)
    narrow = scratch.stored(narrow, "warc-narrow")
    firsts = narrow.groupBy("same").agg(F.max(F.struct("page_id", "rid", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("same", "first")
    again = narrow.join(firsts, "same").filter("first.rid <> rid")
    again = scratch.stored(again.select("page_id", "url", "rid", "size", "digest", F.lit(None).cast("binary").alias("response"), F.col("first.rid").alias("first_rid"), F.col("first.url").alias("first_url")), "warc-revisits")
    ids = again.select("rid")
    rest = own.select("page_id", "url", "rid", "payload").join(F.broadcast(ids) if again.count() * ID_BYTES <= broadcast_bytes else ids, "rid", "left_anti")
    made = rest.select("page_id", "url", "rid", "payload").mapInArrow(_responses, "page_id long, url string, rid string, size long, digest string, response binary")
    sent = made.select("*", F.lit(None).cast("string").alias("first_rid"), F.lit(None).cast("string").alias("first_url")).unionByName(again)
    archives = sent.mapInArrow(_archives(file_bytes), "value binary").select(F.col("value").cast("string"))
    archives.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin1")).text(path)


def _plain(data: bytes) -> Iterator[bytes]:
    """The archive's bytes, decompressed where need be, a piece at a time."""
    import zlib

    view, at, step = memoryview(data), 0, 1 << 16
    if not data.startswith(GZIP):
        for i in range(0, len(data), CHUNK):
            yield bytes(view[i : i + CHUNK])
        return
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("the last gzip member is cut short")
            given = view[at : at + step]
            if out := member.decompress(given, CHUNK):
                yield out
            at += len(given) - len(member.unused_data) - len(member.unconsumed_tail)


def parse(data: bytes) -> Iterator[tuple]:
    """An archive's records, as rows of ``RECORD``. A response whose payload doesn't have the digest it states is an error."""
    import hashlib

    chunks, held, gap = _plain(data), bytearray(), GAP.encode()

    def more() -> bool:
        if (c := next(chunks, None)) is None:
            return False
        held.extend(c)
        return True

    while True:
        while (end := held.find(gap)) < 0 and more():
            pass
        if end < 0:
            if held.strip():
                raise ValueError("a record is cut short")
            return
        if not held.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        fields: dict[str, list[str]] = {}
        for line in bytes(held[:end]).split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields.setdefault(k.decode().strip().lower(), []).append(v.decode("utf-8", "replace").strip())
        body = end + 4
        cut = body + int(fields["content-length"][0])
        while len(held) < cut + 4 and more():
            pass
        if len(held) < cut:
            raise ValueError("a record is cut short")
        get = lambda k, f=fields: f.get(k, [None])[0]
        kind = get("warc-type")
        inner = held.find(gap, body, cut) if "application/http" in (get("content-type") or "") else -1
        header = bytes(held[body:inner]).decode("utf-8", "replace") if inner >= 0 else None
        payload = bytes(held[inner + 4 if inner >= 0 else body : cut])
        del held[: cut + 4]
        bare = lambda v: v and v.strip("<>")
        digest = get("warc-payload-digest")
        if kind == "response" and digest and digest.startswith("sha1:") and hashlib.sha1(payload).hexdigest() != digest[5:]:
            raise ValueError(f"the payload of {get('warc-record-id')} hasn't its digest")
        yield bare(get("warc-record-id")), kind, [bare(x) for x in fields.get("warc-concurrent-to", [])], get("warc-target-uri"), bare(get("warc-refers-to")), digest and digest.rpartition(":")[2], header, payload


def read(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """One row per record of the folder's archives; ``packed``: responses' payloads are left as zstandard frames."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for (data,) in rows_of(batches):
            held, size = [], 0
            for r in parse(data):
                if packed and r[1] == "response":
                    r = (*r[:-1], squeeze(r[-1]))
                held.append(r)
                size += len(r[-1]) + 500
                if size > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column but one tells that the last is a zstandard frame, with the frame's content."""
    import zstandard

    spread, size_of = zstandard.ZstdDecompressor().decompress, zstandard.frame_content_size
    for b in slices(batches, 1024):
        frames, heads = b.column(b.num_columns - 1).to_pylist(), b.column(b.num_columns - 2).to_pylist()
        at, held, size = 0, [], 0
        for i, (frame, packed) in enumerate(zip(frames, heads, strict=True)):
            size += (size_of(frame) if packed else len(frame or b"")) + 500
            held.append(spread(frame) if packed else frame)
            if size > HELD or i + 1 == len(frames):
                yield b.slice(at, len(held)).set_column(b.num_columns - 1, b.schema.field(b.num_columns - 1), pa.array(held, pa.binary()))
                at, held, size = i + 1, [], 0


def assemble(found: DataFrame, packed: bool = False) -> DataFrame:
    """One nested row per capture: capture_id, request, response (response or revisit) with its payload, metadata array.

    ``found`` should be a stored table: the records are read several times, their payloads once. ``packed`` as in ``read``.
    """
    names = found.select("record_id", "record_type", "concurrent_to")
    ends = names.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    edges = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    is_root = F.col("record_type").isin("response", "revisit")
    heads = names.filter(is_root).select(F.col("record_id").alias("b"), F.col("record_id").alias("root"))
    direct = edges.join(heads, "b").groupBy("a").agg(F.min("root").alias("root"))
    over = edges.join(direct.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("root"))
    rooted = direct.withColumn("far", F.lit(0)).unionByName(over.withColumn("far", F.lit(1))).groupBy("a").agg(F.min(F.struct("far", "root")).alias("x")).select(F.col("a").alias("record_id"), F.col("x.root").alias("root"))
    heads_of = found.filter(is_root)
    rest = found.filter(~F.coalesce(is_root, F.lit(False))).join(rooted, "record_id", "left")
    parts = ("record_id", "record_type", "target_uri", "header", "payload", "refers_to", "payload_digest")
    body = F.struct(*parts)
    sides = rest.groupBy(F.coalesce("root", F.get("concurrent_to", F.lit(0)), "record_id").alias("capture_id")).agg(
        F.min(F.when(F.col("record_type") == "request", body)).alias("request"), F.sort_array(F.collect_list(F.when(~F.col("record_type").eqNullSafe("request"), body))).alias("metadata")
    )
    responses = heads_of.select(F.col("record_id").alias("capture_id"), body.alias("response"))
    joined = responses.join(sides, "capture_id", "full")
    joined = joined.select("capture_id", "request", F.coalesce("metadata", F.array().cast("array<" + sides.schema["metadata"].dataType.elementType.simpleString() + ">")).alias("metadata"), "response")
    if packed:
        flat = joined.select("capture_id", "request", "metadata", F.col("response").isNotNull().alias("whole"), *(F.col(f"response.{c}").alias(c) for c in parts if c != "payload"), F.col("response.record_type").eqNullSafe("response").alias("frame"), F.col("response.payload").alias("payload"))
        joined = flat.mapInArrow(_unpacked, flat.schema).select("capture_id", "request", "metadata", F.when(F.col("whole"), body).alias("response"))
    return joined.select("capture_id", "request", "response", "metadata")


def digest(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of captures that ``write`` made.

    Sizes and digests are measured on the captures' payloads; a revisit has those of the response that it refers to,
    or where that is not among the captures, those that its record states. The narrow rows are stored, as a revisit's
    page is found by joining them to themselves.
    """
    about = F.get(F.filter("metadata", lambda m: m["record_type"] == "metadata"), F.lit(0))["payload"].cast("string")
    page = F.expr("try_cast(nullif(regexp_extract(about, 'page-id: (-?[0-9]+)', 1), '') as bigint)")
    response = F.col("response.record_type") == "response"
    size = F.when(response, F.octet_length("response.payload").cast("long")).otherwise(F.expr("try_cast(nullif(regexp_extract(response.header, 'Content-Length: ([0-9]+)', 1), '') as bigint)"))
    sha = F.when(response, F.sha1("response.payload")).otherwise(F.col("response.payload_digest"))
    flat = captures.withColumn("about", about).select("capture_id", page.alias("page_id"), size.alias("payload_bytes"), sha.alias("payload_digest"), "response.record_type", F.col("response.refers_to").alias("ref"))
    flat = scratch.stored(flat, "warc-captures")
    targets = flat.filter("ref is null").select(F.col("capture_id").alias("ref"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("sha"))
    again = flat.filter("ref is not null").join(targets, "ref", "left").withColumns({"payload_bytes": F.coalesce("n", "payload_bytes"), "payload_digest": F.coalesce("sha", "payload_digest")}).drop("n", "sha")
    return again.unionByName(flat.filter("ref is null").withColumn("refers_to", F.lit(None).cast("long"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q
"""


def op2_warc(spark, sf_dir) -> DataFrame:
    path = scratch.new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = scratch.stored(read(spark, path, packed=True), "warc-records")
    scratch.drop(spark, path)  # its records are stored
    return digest(assemble(found, packed=True))

"""Token ids in seekable files: independent zstandard frames, a seek table at the end, a checksum per frame.

Layout of a file: one frame per document (its ids as little-endian unsigned 32-bit integers, the frame's own content
checksum on), a skippable frame with the file's number, its documents' ids and a byte each that marks null ids, then the seek table as a skippable
frame: per frame its compressed size, its content's size and the low half of the content's XXH64, then the number of
frames, a descriptor byte (checksums) and the closing magic number. Any zstandard reader can read a file whole; a
reader with the seek table decompresses only the frames of the documents asked for, and checks each.

Documents are dealt by ranges of (doc_id, hash of the text) and sorted, so that neither nulls nor a repeated id share a task, and files in the order of their number hold ascending doc_ids; a
document's start among all ids follows from the tasks' and files' totals and the sizes in the seek tables. A folder may
hold an index (``index``): per file its range of doc_ids, so that a reader who asks for documents opens the files that
may hold them and no other. Spark writes the bytes: a row of the text writer is a file, and the row separator is the closing magic number. So files reach
any store Spark writes to, with its commit protocol, and a task's retry replaces what a lost one left.

Defined cases: null and empty texts hold the end id alone; null doc_ids come first; repeated rows are repeated
documents, in no given order among themselves; a very long text is one frame and, past the size of a file, one file;
an empty table gives no documents. Other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.llm.common import rows_of, slices, worker_state

#: Fixed values of the format: magic numbers of skippable frames (documents, seek table) and of the file's end.
DOCS_MAGIC, SEEK_MAGIC, END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Compressed bytes at which a file is closed; zstandard level; descriptor: checksums are present.
FILE_BYTES, LEVEL, CHECKSUMS = 16 << 20, 1, 0x80
END_ID = 2
#: Folder of the index below the files' own; Spark's readers pass it over.
INDEX = "_index"


def _encoder(vocabulary: str):
    import public_tokenizers

    from siltstone.llm.bpe import Encoder

    return worker_state(f"bpe {vocabulary}", lambda: Encoder(public_tokenizers.path(vocabulary)))


def _closed(task: int, place: int, frames: list[bytes], table: list[tuple[int, int, int]], ids: list[int | None]) -> bytes:
    """A file's bytes without the closing magic number."""
    listed = struct.pack("<qqQ", task, place, len(ids)) + struct.pack(f"<{len(ids)}q", *(i or 0 for i in ids)) + bytes(i is None for i in ids)
    listed = struct.pack("<II", DOCS_MAGIC, len(listed)) + listed
    table = [*table, (len(listed), 0, 0)]
    seek = b"".join(struct.pack("<III", *x) for x in table) + struct.pack("<IB", len(table), CHECKSUMS)
    return b"".join([*frames, listed, struct.pack("<II", SEEK_MAGIC, len(seek) + 4), seek])


def _files(vocabulary: str, end_id: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        encode, squeeze = _encoder(vocabulary).encode, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True).compress
        task, place, end = TaskContext.get().partitionId(), 0, struct.pack("<I", end_id)
        frames, table, ids, size = [], [], [], 0
        for doc_id, text in rows_of(slices(batches)):
            raw = encode(text) + end
            frame = squeeze(raw)
            frames.append(frame)
            table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            ids.append(doc_id)
            size += len(frame)
            if size >= file_bytes:
                yield pa.RecordBatch.from_pydict({"value": [_closed(task, place, frames, table, ids)]}, schema=pa.schema([("value", pa.binary())]))
                frames, table, ids, size, place = [], [], [], 0, place + 1
        if frames:
            yield pa.RecordBatch.from_pydict({"value": [_closed(task, place, frames, table, ids)]}, schema=pa.schema([("value", pa.binary())]))

    return run


def dealt(docs: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, text) in ``ranges`` sorted ranges of doc_id; rows of one id are split by their texts' hash."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_h", F.xxhash64("text"))
    return own.repartitionByRange(ranges, "doc_id", "_h").sortWithinPartitions("doc_id").drop("_h")


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES, ranges: int | None = None) -> None:
    """Encode every whole text and write the files to the folder ``path``, in ``ranges`` tasks (the session's shuffle partitions where none are given)."""
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = dealt(docs, ranges).mapInArrow(_files(vocabulary, end_id, file_bytes), "value binary").select(F.col("value").cast("string"))
    end = struct.pack("<I", END_MAGIC).decode("latin1")
    files.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", end).text(path)


def seek_table(data: bytes) -> tuple[int, int, list[tuple[int, int, int, int]]]:
    """A file's task, its place in the task, and per document: doc_id, offset, compressed size, content size, checksum."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != END_MAGIC or flags != CHECKSUMS:
        raise ValueError("not a file of this format")
    body = n * 12 + 9
    if struct.unpack("<II", data[-body - 8 : -body]) != (SEEK_MAGIC, body):
        raise ValueError("damaged seek table")
    entries = list(struct.iter_unpack("<III", data[-body:-9]))
    offsets, at = [], 0
    for size, _, _ in entries:
        offsets.append(at)
        at += size
    task, place, count = struct.unpack_from("<qqQ", data, offsets[-1] + 8)
    ids = struct.unpack_from(f"<{count}q", data, offsets[-1] + 32)
    none = data[offsets[-1] + 32 + 8 * count :][:count]
    return task, place, [(None if x else i, o, *e) for i, x, o, e in zip(ids, none, offsets[:-1], entries[:-1], strict=True)]


def frame(data: bytes, entry: tuple) -> bytes:
    """One document's ids; raises if the frame or its checksum is damaged."""
    import xxhash
    import zstandard

    _, offset, size, length, checksum = entry
    raw = zstandard.ZstdDecompressor().decompress(data[offset : offset + size], max_output_size=length)
    if len(raw) != length or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
        raise ValueError("damaged frame")
    return raw


def _read(wanted: frozenset[int | None] | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        names = ("task", "place", "position", "doc_id", "before", "n_tokens", "ids_crc32", "ids")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        schema = pa.schema(list(zip(names, kinds, strict=True))[: 8 if with_ids else 7])
        for (data,) in rows_of(batches):
            task, place, entries = seek_table(data)
            rows, before = [], 0
            for i, e in enumerate(entries):
                if wanted is None or e[0] in wanted:
                    raw = frame(data, e)
                    rows.append((task, place, i, e[0], before, e[3] >> 2, zlib.crc32(raw), np.frombuffer(raw, "<i4") if with_ids else None))
                before += e[3] >> 2
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=False)], schema=schema)

    return run


def _summary():
    schema = pa.schema([("file", pa.string()), ("task", pa.int64()), ("place", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("nulls", pa.bool_()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, data in rows_of(batches):
            task, place, entries = seek_table(data)
            ids = [e[0] for e in entries if e[0] is not None]
            row = (name, task, place, min(ids, default=None), max(ids, default=None), len(ids) < len(entries), sum(e[3] >> 2 for e in entries))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

    return run


def index(spark: SparkSession, path: str) -> DataFrame:
    """Writes, and returns, the folder's index: file, task, place, first_id, last_id, nulls (has null ids), n_tokens of each file."""
    ddl = "file string, task long, place long, first_id long, last_id long, nulls boolean, n_tokens long"
    spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_summary(), ddl).write.mode("overwrite").parquet(f"{path}/{INDEX}")
    return spark.read.schema(ddl).parquet(f"{path}/{INDEX}")


def _holding(indexed: DataFrame, doc_ids: list[int | None]) -> list[str]:
    """The files whose range holds one of the ids."""
    ids = indexed.sparkSession.createDataFrame([(i,) for i in doc_ids], "id long")
    holds = (F.col("id").isNull() & F.col("nulls")) | F.col("id").between(F.col("first_id"), F.col("last_id"))
    return [r["file"] for r in indexed.join(F.broadcast(ids), holds, "left_semi").select("file").collect()]


def read(spark: SparkSession, path: str, doc_ids: list[int | None] | None = None, with_ids: bool = True, indexed: DataFrame | None = None) -> DataFrame:
    """The documents of a folder: task, place, position, doc_id, before (ids ahead of it in its file), n_tokens, ids_crc32, ids.

    With ``doc_ids`` only those documents' frames are decompressed, and with an index only files that may hold them read.
    """
    ddl = "task long, place long, position long, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    wanted = None if doc_ids is None else frozenset(doc_ids)
    files = path if doc_ids is None or indexed is None else _holding(indexed, doc_ids)
    if not files:
        return spark.createDataFrame([], ddl)
    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(_read(wanted, with_ids), ddl)


def with_starts(read_docs: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before it.

    Two levels of sums: over the files of a task, and over a row per writing task.
    """
    files = read_docs.groupBy("task", "place").agg(F.sum("n_tokens").alias("total"))
    tasks = files.groupBy("task").agg(F.sum("total").alias("total"))
    before = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.select(F.col("task").alias("_k"), before(Window.orderBy("task")).alias("_base"))
    bases = files.withColumn("_inside", before(Window.partitionBy("task").orderBy("place"))).join(tasks, F.col("task") == F.col("_k"))
    bases = bases.select(F.col("task").alias("_t"), F.col("place").alias("_p"), (F.col("_base") + F.col("_inside")).alias("base"))
    return read_docs.join(bases, (F.col("task") == F.col("_t")) & (F.col("place") == F.col("_p"))).withColumn("start", F.col("base") + F.col("before")).drop("_t", "_p", "base")


def op3_token_files(spark, sf_dir) -> DataFrame:
    path = scratch.new_path(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), "byte_bpe_50k.json", path)
    found = scratch.stored(read(spark, path, with_ids=False), "token-rows")
    return with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")

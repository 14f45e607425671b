"""Exact dedup by an extendible-hash index on shared files.

Each task first folds the equal texts that it holds, so a text copied a billion times sends one row a task. The rows
go to owner tasks; an owner has one range of 64-bit keys (their leading bits). It inserts them in an extendible hash
table: a directory addressed by the next bits, pages of a fixed capacity, an overfull page split in two, the directory
doubled where the page's depth has reached its own. Entries of one key form a chain and are told apart by their bytes.
The pages are written as Parquet rows in the shared folder, and documents look their entry up there.

Equality: identical after lower-casing ASCII A-Z. A null text counts as empty. Of equal texts the row with the largest
doc_id stays; null doc_ids lose to all others. Of rows that repeat both text and that doc_id one stays (the others
report kept = false). Other columns of the input, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.llm.common import lower_ascii, release, repeated, rows_of, slices

#: Distinct texts in one owner's range, about; keys in one page; bytes that a task holds before it hands on its folded texts.
ROWS_PER_OWNER, PAGE, HELD_BYTES = 512, 64, 32 << 20
#: Bytes of the index's narrow entries up to which ``keep`` broadcasts them, and of one entry, about.
BROADCAST_BYTES, ENTRY_BYTES = 32 << 20, 100

FOLDED = "owner long, key long, sha string, body binary, keep_id long, group_size long, n_keep long"
ENTRY = "owner long, page long, depth int, directory_depth int, key long, chain int, sha string, body binary, keep_id long, group_size long, n_keep long"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _newer(a: tuple, b: tuple) -> tuple:
    """Two (keep_id, group_size, n_keep) of the same text as one; null ids lose."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1], a[2] + b[2]
    win = a if b[0] is None or (a[0] is not None and a[0] > b[0]) else b
    return win[0], a[1] + b[1], win[2]


class ExtendibleIndex:
    """Pages of at most ``capacity`` keys, addressed by the bits that follow the owner's ``skip`` leading ones."""

    def __init__(self, skip: int, capacity: int = PAGE):
        self.skip, self.capacity, self.depth = skip, capacity, 0
        self.directory: list[dict] = [{"depth": 0, "chains": {}}]

    def slot(self, key: int, depth: int) -> int:
        bits = ((key & (2**64 - 1)) << self.skip) & (2**64 - 1)
        return bits >> (64 - depth) if depth else 0

    def insert(self, key: int, body: bytes, sha: str, value: tuple, same=bytes.__eq__) -> None:
        page = self.directory[self.slot(key, self.depth)]
        chain = page["chains"].setdefault(key, [])
        for entry in chain:
            if same(entry[0], body):
                entry[2] = _newer(entry[2], value)
                return
        chain.append([body, sha, value])
        while len(page["chains"]) > self.capacity and page["depth"] < 64 - self.skip:
            self._split(page)
            page = self.directory[self.slot(key, self.depth)]

    def _split(self, page: dict) -> None:
        if page["depth"] == self.depth:
            self.directory = [p for p in self.directory for _ in range(2)]
            self.depth += 1
        d = page["depth"] + 1
        halves = [{"depth": d, "chains": {}}, {"depth": d, "chains": {}}]
        for key, chain in page["chains"].items():
            halves[self.slot(key, d) & 1]["chains"][key] = chain
        first = next(i for i, p in enumerate(self.directory) if p is page)
        span = 1 << (self.depth - page["depth"])
        self.directory[first : first + span] = [halves[0]] * (span // 2) + [halves[1]] * (span // 2)

    def pages(self) -> Iterator[tuple[int, dict]]:
        seen = None
        for i, p in enumerate(self.directory):
            if p is not seen:
                yield i >> (self.depth - p["depth"]), p
            seen = p


def _fold(bits: int):
    """Equal texts of a task as one row, their bytes compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import xxhash
        import zstandard

        release()
        squeeze, schema = zstandard.ZstdCompressor(level=1).compress, _arrow(FOLDED)
        held: dict[int, list[list]] = {}
        size = 0

        def flush():
            out = [[] for _ in schema]
            for key, chain in held.items():
                signed = key - (key >> 63 << 64)
                for body, value in chain:
                    for column, x in zip(out, (key >> (64 - bits), signed, hashlib.sha256(body).hexdigest(), squeeze(body), *value), strict=True):
                        column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

        for doc_id, text in rows_of(slices(batches)):
            body = (text or "").encode().lower()
            key = xxhash.xxh64_intdigest(body, 42)
            chain = held.setdefault(key, [])
            for entry in chain:
                if entry[0] == body:
                    entry[1] = _newer(entry[1], (doc_id, 1, 1))
                    break
            else:
                chain.append([body, (doc_id, 1, 1)])
                size += len(body) + 200
            if size > HELD_BYTES:
                yield flush()
                held, size = {}, 0
        yield flush()

    return run


def _own(bits: int):
    """An owner's rows into its index; the index's pages out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        import zstandard

        spread, schema = zstandard.ZstdDecompressor().decompress, _arrow(ENTRY)
        same = lambda a, b: a == b or spread(a) == spread(b)
        for owner, rows in itertools.groupby(rows_of(batches), key=lambda r: r[0]):
            index = ExtendibleIndex(bits)
            for _, key, sha, body, *value in rows:
                index.insert(key, body, sha, tuple(value), same)
            out = [[] for _ in schema]
            for number, page in index.pages():
                for key, chain in page["chains"].items():
                    for place, (body, sha, value) in enumerate(chain):
                        for column, x in zip(out, (owner, number, page["depth"], index.depth, key, place, sha, body if len(chain) > 1 else None, *value), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return run


def build_index(docs: DataFrame, rows_per_owner: int = ROWS_PER_OWNER) -> DataFrame:
    """The index over ``docs`` (doc_id, text), one row an entry, in shared files.

    The number of owners follows the row count, so an owner's range and its memory stay the same at any size.
    """
    bits = max(4, (max(docs.count(), 1) // rows_per_owner).bit_length())
    folded = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fold(bits), FOLDED)
    owned = folded.repartition("owner").sortWithinPartitions("owner", "key").mapInArrow(_own(bits), ENTRY)
    return scratch.stored(owned, "hash-index")


def lookup(docs: DataFrame, index: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row of ``docs`` with its entry: doc_id, keep_id, group_size, kept, text_sha256, and as ``row`` a struct of the columns to carry.

    An entry is found by its key and its text's SHA-256 (distinct in a chain). The rows of a much-copied text meet one
    index row; Spark can split such a partition.
    """
    norm = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    members = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(norm).alias("key"), F.sha2(norm, 256).alias("text_sha256"), F.struct(*carry, F.lit(0).alias("_")).alias("row"))
    entries = index.select("key", F.col("sha").alias("text_sha256"), "keep_id", "group_size", "n_keep")
    return members.join(entries, ["key", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_keep", "row")


def _tied() -> Column:
    """Rows of which the index can't tell which one stays: they repeat the kept row's id and its text."""
    return F.col("kept") & (F.col("n_keep") > 1)


def mark(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows that repeat the kept row's id and text only differ in ``kept``, so they are told off from their index entry:
    one is kept, the other n_keep - 1 aren't. They are written out in ranges, which many tasks share where one row repeats often.
    """
    index = build_index(docs)
    found, columns = lookup(docs, index), ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    tied = repeated(index.filter("n_keep > 1").select("keep_id", "group_size", F.col("sha").alias("text_sha256"), "n_keep"), "n_keep", "i")
    tied = tied.select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", (F.col("i") == 0).alias("kept"), "text_sha256")
    return found.filter(~_tied()).select(*columns).unionByName(tied.select(*columns))


def keep(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns, one per distinct text; of rows that repeat its id and text, the one whose columns' digest is least.

    A row stays if the index has its text with its id; the index's narrow entries are broadcast where they are few, so that whole rows don't move.
    """
    index = build_index(docs)
    norm = lower_ascii(F.coalesce(docs["text"].cast("string"), F.lit("")))
    stays = lambda e: docs["doc_id"].cast("long").eqNullSafe(e["_e_id"]) & (F.xxhash64(norm) == e["_e_key"]) & (F.unhex(F.sha2(norm, 256)) == e["_e_sha"])
    entries = index.select(F.col("keep_id").alias("_e_id"), F.col("key").alias("_e_key"), F.unhex("sha").alias("_e_sha"), (F.col("n_keep") > 1).alias("_tied"))
    one, several = entries.filter("not _tied"), entries.filter("_tied")
    kept = docs.join(F.broadcast(one) if index.count() * ENTRY_BYTES <= broadcast_bytes else one, stays(one), "left_semi")
    if several.isEmpty():
        return kept
    rows = docs.join(several, stays(several)).select("_e_id", "_e_sha", F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    least = rows.withColumn("digest", F.xxhash64("row")).groupBy("_e_id", "_e_sha").agg(F.min_by("row", "digest").alias("row"))
    return kept.unionByName(least.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op7_exact_dedup(spark, sf_dir) -> DataFrame:
    return mark(spark.read.parquet(f"{sf_dir}/documents.parquet"))

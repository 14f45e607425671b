"""Best-fit packing: token sequences of a fixed capacity, large items matched in pairs, small ones into the gaps left.

A document is its ids and an end id; one longer than the capacity is cut into full pieces and a rest. Sizes are whole
numbers up to the capacity, so items of one size are alike and the plan is made on a histogram: at most ``capacity``
rows, whatever the number of documents. The plan first matches items above a third of the capacity, largest first, each
with the largest other such item that still fits (so at most two of them share a sequence); what finds no partner has a
sequence alone. Smaller items follow, largest first, each into the smallest gap that holds it; a new sequence is opened
where no gap does. Equal sequences are treated together: a step of the plan says that items ``rank .. rank + n`` of a
size go, ``per`` to a sequence, to sequences from ``first`` on. The number of steps depends on the capacity alone.

The work on documents is Spark's: one pass encodes them and numbers the items of a size within a task; tallies per
task and size (an aggregate) give each task its base; a second pass looks every item's step up. Texts never move, and
only rows of a few numbers are stored. Steps are broadcast: their number is bounded by the capacity's square.

Defined cases: null and empty texts are the end id alone; null doc_ids and repeated rows are items of their own; a
very long text is encoded in parts and cut piece by piece; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.llm.common import Cache, slices, worker_state

CAPACITY, END_ID, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Words in a generation of a worker's cache; bytes of a part of a long text.
WORDS, PART = 300_000, 1 << 16
#: Tallies (a row a task and size) that are broadcast; more meet the items by an exchange of narrow rows.
FEW_TALLIES = 500_000


#: Latin letters whose small forms no normaliser changes further, and a word of them that may end in punctuation; the apostrophe begins tokens of its own.
LATIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
#: What the vocabulary has to do before its merges for ``LATIN`` to hold: small letters, runs of letters apart, bytes as characters.
NORMALISED, SPLIT = ["NFC", "Replace", "Lowercase"], "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Packed little-endian ids. The vocabulary drops white space, so that ids of words don't depend on their neighbours.

    Words of ``LATIN`` letters, with punctuation behind or not, are told by the library's model alone: in small letters,
    without what it would find nothing to do for (normalising, splitting, offsets). Punctuation is a word of its own then.
    All others are told by the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.characters = self.library.model, byte_characters()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        cut = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.plain = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])] == NORMALISED and [c.get("type") for c in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"] == {"Regex": SPLIT} and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        self.words = Cache(self.word, WORDS)

    def word(self, raw: bytes) -> bytes:
        text = raw.decode()
        if not self.plain or not (m := LATIN.fullmatch(text)):
            return as_bytes(self.library.encode(text, add_special_tokens=False).ids)
        letters = m[1].lower().encode()
        if m[2]:
            return self.words[letters] + self.words[m[2].encode()]
        if letters != raw:
            return self.words[letters]
        return as_bytes([t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.characters))])

    def parts(self, raw: bytes) -> Iterator[bytes]:
        """Packed ids of the text's parts, cut where white space is."""
        at = 0
        while len(raw) - at > PART:
            ends = [x for x in (raw.find(b" ", at + PART), raw.find(b"\n", at + PART)) if x >= 0]
            if not ends:
                break
            yield b"".join(map(self.words.__getitem__, raw[at : min(ends)].split()))
            at = min(ends)
        yield b"".join(map(self.words.__getitem__, raw[at:].split()))


def cut(packed: Iterator[bytes], capacity: int) -> Iterator[bytes]:
    """The ids in pieces of ``capacity``, the last one shorter."""
    held = b""
    for p in packed:
        held += p
        whole = len(held) // (4 * capacity) * 4 * capacity
        for at in range(0, whole, 4 * capacity):
            yield held[at : at + 4 * capacity]
        held = held[whole:]
    if held:
        yield held


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, its task and its number among the task's pieces of that length, and on demand ids (packed)."""
    import public_tokenizers

    path, end = public_tokenizers.path(vocabulary), struct.pack("<I", end_id)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"words {path}", lambda: Encoder(path))
        part, seen, rows = TaskContext.get().partitionId(), Counter(), []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows.clear()
            return made

        def packed(raw: bytes | None) -> Iterator[bytes]:
            yield from encoder.parts(raw or b"")
            yield end

        for b in slices(batches):
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                start = 0
                for i, ids in enumerate(cut(packed(raw), capacity)):
                    n = len(ids) >> 2
                    rows.append((doc_id, i, start, n, zlib.crc32(ids), part, seen[n], *((ids,) if with_ids else ())))
                    seen[n] += 1
                    start += n
                    if len(rows) >= 2048:
                        yield batch()
        if rows:
            yield batch()

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


class Plan:
    """Steps (size, rank, n, per, first, offset) for a histogram of sizes; ``used`` counts the sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.steps, self.used = capacity, [], 0
        self.left, self.rank = {s: n for s, n in counts.items() if n}, Counter()
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.keys: list[int] = []
        sizes = sorted(self.left)
        third = bisect.bisect_right(sizes, capacity // 3)
        self.match(sizes[third:])
        for s in reversed(sizes[:third]):
            self.fill(s)

    def put(self, size: int, n: int, per: int, first: int, offset: int) -> None:
        self.steps.append((size, self.rank[size], n, per, first, offset))
        self.rank[size] += n
        self.left[size] -= n

    def free(self, gap: int, first: int, n: int) -> None:
        """``n`` sequences from ``first`` on have ``gap`` left."""
        if n and gap:
            if gap not in self.gaps:
                bisect.insort(self.keys, gap)
            self.gaps.setdefault(gap, []).append((first, n))

    def new(self, n: int) -> int:
        self.used += n
        return self.used - n

    def match(self, large: list[int]) -> None:
        """Each size with the largest partner that fits, both above a third of the capacity."""
        for s in reversed(large):
            if (n := self.left[s] // 2) and 2 * s <= self.capacity:
                first = self.new(n)
                self.put(s, 2 * n, 2, first, 0)
                self.free(self.capacity - 2 * s, first, n)
            at = min(bisect.bisect_right(large, self.capacity - s), bisect.bisect_left(large, s)) - 1
            while self.left[s] and at >= 0:
                if n := min(self.left[s], self.left[large[at]]):
                    first = self.new(n)
                    self.put(s, n, 1, first, 0)
                    self.put(large[at], n, 1, first, s)
                    self.free(self.capacity - s - large[at], first, n)
                at -= 1
            if n := self.left[s]:
                first = self.new(n)
                self.put(s, n, 1, first, 0)
                self.free(self.capacity - s, first, n)

    def fill(self, s: int) -> None:
        """Items of size ``s`` into the smallest gaps that hold them, then into new sequences."""
        while self.left[s]:
            at = bisect.bisect_left(self.keys, s)
            if at == len(self.keys):
                n = max(1, self.left[s] * s // self.capacity)
                self.free(self.capacity, self.new(n), n)
                continue
            gap = self.keys[at]
            first, n = self.gaps[gap].pop()
            if not self.gaps[gap]:
                del self.gaps[gap], self.keys[at]
            per = gap // s
            whole, rest = min(n, self.left[s] // per), 0
            if whole:
                self.put(s, whole * per, per, first, self.capacity - gap)
                self.free(gap - per * s, first, whole)
            if whole < n and (rest := self.left[s]):  # fewer than ``per``: one sequence takes them all
                self.put(s, rest, rest, first + whole, self.capacity - gap)
                self.free(gap - rest * s, first + whole, 1)
            self.free(gap, first + whole + bool(rest), n - whole - bool(rest))


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored ``pieces`` and takes off part and nth."""
    import numpy as np

    spark = cut_pieces.sparkSession
    tallies = scratch.stored(cut_pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-tallies")
    counts = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a size: at most ``capacity``
    steps = np.array(sorted(Plan(counts, capacity).steps), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(steps)
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    bases = tallies.select(F.col("part").alias("_p"), F.col("length").alias("_s"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_base"))
    few = tallies.count() <= FEW_TALLIES
    ranked = cut_pieces.join(F.broadcast(bases) if few else bases, (F.col("part") == F.col("_p")) & (F.col("length") == F.col("_s")))
    kept = [c for c in cut_pieces.columns if c not in ("part", "nth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One key for size and rank: sizes fit in 24 bits, ranks in 39.
        steps = shared.value
        keys = (steps[:, 0] << 39) + steps[:, 1]
        for b in batches:
            rank, size = b.column(b.num_columns - 1).to_numpy(), b.column("length").to_numpy()
            own = steps[np.searchsorted(keys, (size << 39) + rank, side="right") - 1]
            turn, nth = np.divmod(rank - own[:, 1], own[:, 3])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own[:, 4] + turn), pa.array(own[:, 5] + nth * size)], names=[*kept, "sequence_id", "offset"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_pieces.select(*kept).schema)
    return ranked.select(*kept, (F.col("_base") + F.col("nth")).alias("_rank")).mapInArrow(run, f"{ddl}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset of every piece."""
    return place(scratch.stored(pieces(docs, vocabulary, capacity, end_id, with_ids), "packing-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of pieces with ids: sequence_id, doc_ids, starts (where each piece begins), tokens (packed ids). A row holds at most a capacity of ids."""
    own = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", F.hex("ids").alias("ids")))).alias("p"))
    return own.select("sequence_id", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["offset"]).alias("starts"), F.unhex(F.array_join(F.transform("p", lambda x: x["ids"]), "")).alias("tokens"))


def op11_bestfit_packing(spark, sf_dir) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Token counts by a map-side two-tier lookup.

First tier: a compact table of the frequent pre-tokens' lengths, broadcast to all workers as flat arrays: at most
``TABLE_ROWS`` entries of ``KEY_BYTES`` bytes at most. Second tier: a worker's own cache for the misses, filled by the vocabulary
file's library and bounded by bytes. No pre-token is ever shuffled: a document is counted where it is read.

The table is filled from at most ``SAMPLE_ROWS`` texts of at most ``SAMPLE_CHARS`` characters. It is a cache only: what
it lacks is encoded, so counts are exact over all whole texts whichever rows the sample has.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a null doc_id stays null; repeated rows give repeated
rows; very long texts are counted whole; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import slices, worker_state

TABLE_ROWS, KEY_BYTES, SAMPLE_ROWS, SAMPLE_CHARS, LIMIT = 32768, 64, 1500, 32768, 512

class Table:
    """Strings and their small lengths as flat arrays (key bytes, ends, lengths), about 20 bytes an entry; a worker hashes them once."""

    def __init__(self, counts: dict[str, int]):
        import numpy as np

        keys = [k.encode() for k in counts]
        self.keys = b"".join(keys)
        self.ends = np.cumsum([len(k) for k in keys], dtype=np.uint32) if keys else np.zeros(0, np.uint32)
        self.lengths = np.array(list(counts.values()), np.uint16)

    def spread(self) -> dict[str, int]:
        ends = [0, *self.ends.tolist()]
        return {self.keys[a:b].decode(): n for a, b, n in zip(ends[:-1], ends[1:], self.lengths.tolist(), strict=True)}


class Near(dict):
    """The first tier: the broadcast table; what it lacks is asked of the second and not kept here."""

    def __missing__(self, token: str) -> int:
        return self.far[token]


class Counts:
    """A worker's counter: the broadcast table, then its own cache, then the library."""

    def __init__(self, path: str, table: Table):
        from siltstone.llm.bpe import TOKENS, Encoder
        from siltstone.llm.common import Cache

        self.encoder = Encoder(path)
        self.near = Near(table.spread())
        self.near.far = Cache(lambda t: len(self.encoder.token(t)) >> 2, TOKENS)

    def whole(self, text: str) -> int:
        return len(self.encoder.whole(text)) >> 2

    def count(self, text: str | None) -> int:
        return sum(map(sum, self.encoder.each(text, self.near.__getitem__, self.whole))) if text else 0


def frequent_table(docs: DataFrame, path: str, rows: int = TABLE_ROWS) -> Table:
    """Lengths of the sample's most frequent pre-tokens."""
    from siltstone.llm.bpe import Encoder

    e, seen = Encoder(path), Counter()
    for (text,) in docs.select(F.col("text").cast("string")).filter(f"length(text) <= {SAMPLE_CHARS}").take(SAMPLE_ROWS):
        for run in e.each(text, str, lambda _: None):
            seen.update(t for t in run if t)
    return Table({t: len(e.token(t)) >> 2 for t, _ in seen.most_common(rows) if len(t) <= KEY_BYTES // 4})


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; ``vocabulary`` names a public byte-level tokenizer file."""
    import public_tokenizers

    shared = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, public_tokenizers.path(vocabulary)))
    key = f"counts {vocabulary} {uuid.uuid4()}"
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        count = worker_state(key, lambda: Counts(public_tokenizers.path(vocabulary), shared.value)).count
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), "byte_bpe_50k.json")

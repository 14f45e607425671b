"""Exact top-k by inner product over a bit-sliced index.

A component x becomes the integer floor(``SCALE`` * x). The index cuts the vectors, in order of vec_id, in blocks of
``BLOCK_ROWS``; a block holds, per attribute, its least value and bit slices (bitmaps over the rows) of what exceeds it.
A query adds slices with bitmap arithmetic only: bit j of |q| puts slice b of the attribute in column j + b (of the
complement for a negative q), and full adders (three bitmaps to a sum and a carry) shrink each column to one bitmap.
The sum's slices, from the most significant downward, split the rows into surely in, tied so far, and out; what is
tied at the last slice is the boundary, resolved exactly by the smaller vec_id. A task keeps the k best of all its blocks for each
query; those of a query's tasks are ranked.

Queries come in chunks of at most ``QUERY_BYTES`` (what is broadcast, whatever the table's size) against all blocks. Only vectors of
the query's length are its candidates. All integers are exact, of any width: vectors with a component of ``FAR`` or more
are sliced in blocks of their own, so that the others' slices stay few. A score that a long can't hold is ranked by its exact
value and returned as the nearest long.

Defined cases: vectors null or holding null or non-finite components take no part, as queries or candidates; a null
vec_id takes no part; only a query's own row is left out of its candidates, so another row with its vec_id is one; queries
with a repeated vec_id are answered apart, in rows of their own; vectors of length 0 score 0; fewer than k candidates
are all returned; an empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.llm.common import rows_of, slices

SCALE, K, EVERY, BLOCK_ROWS, QUERY_BYTES, TOGETHER = 64, 20, 20, 8192, 8 << 20, 4
#: Components from here on are scaled and sliced as integers of any width.
FAR = float(1 << 50)
#: Limits of the score's column.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (its number), vec_id, q (integers) or far (components as they are, if one is ``FAR`` or more) of the vectors that take part; stored."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).filter("vec_id is not null and e is not null")
    sound = own.filter(F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    near = F.forall("e", lambda v: F.abs(v) < FAR)
    found = sound.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.when(near, F.transform("e", lambda v: F.floor(F.lit(float(scale)) * v).cast("long"))).alias("q"), F.when(~near, F.col("e")).alias("far"))
    return scratch.stored(found, "quantised")


def whole_numbers(components: list[float], scale: int = SCALE) -> list[int]:
    """floor(scale * x) of each, exact."""
    from fractions import Fraction

    return [int(Fraction(x) * scale // 1) for x in components]


def sort_key(x: int) -> bytes:
    """Bytes in the order of the integers."""
    own = abs(x).to_bytes((abs(x).bit_length() + 7) // 8, "big")
    own = len(own).to_bytes(4, "big") + own
    return b"\1" + own if x >= 0 else b"\0" + bytes(255 - c for c in own)


def _slices(m):
    """Of an integer matrix (rows, attributes): least values, widths, and the slices' bitmaps (all attributes' one after another)."""
    import numpy as np

    n, low = len(m), m.min(axis=0)
    over = m - low
    words = -(-n // 64)
    widths = [int(x).bit_length() for x in over.max(axis=0)]
    out = np.zeros((sum(widths), words * 8), np.uint8)
    at = 0
    for d, w in enumerate(widths):
        for b in range(w):
            bits = np.packbits((over[:, d] >> b & 1).astype(np.uint8), bitorder="little")
            out[at, : len(bits)] = bits
            at += 1
    return low, widths, out.view("<u8")


def _index(block_rows: int, scale: int):
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("low", pa.list_(pa.string())), ("widths", pa.list_(pa.int32())), ("slices", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: dict[tuple[int, bool], list] = {}

        def block(key):
            dim, far = key
            rows = held.pop(key)
            m = np.array([r[2] for r in rows], object if far else np.int64).reshape(len(rows), dim)
            low, widths, bitmaps = _slices(m)
            packed = lambda k: np.array([r[k] for r in rows], "<i8").tobytes()
            return pa.RecordBatch.from_pylist([{"dim": dim, "n": len(rows), "ids": packed(1), "rows": packed(0), "low": [str(int(x)) for x in low], "widths": widths, "slices": bitmaps.tobytes()}], schema=schema)

        for row, vec_id, q, far in rows_of(slices(batches)):
            key = (len(q if far is None else far), far is not None)
            held.setdefault(key, []).append((row, vec_id, q if far is None else whole_numbers(far, scale)))
            if len(held[key]) == block_rows:
                yield block(key)
        for key in list(held):
            yield block(key)

    return run


INDEX = "dim int, n int, ids binary, rows binary, low array<string>, widths array<int>, slices binary"


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS, scale: int = SCALE) -> DataFrame:
    """The index over ``quantised`` vectors, a row a block, in a shared table."""
    parts = max(1, -(-vectors.count() // block_rows))
    dealt = vectors.select("row", "vec_id", "q", "far").repartitionByRange(parts, "vec_id", "row").sortWithinPartitions("vec_id", "row")
    return scratch.stored(dealt.mapInArrow(_index(block_rows, scale), INDEX), "bit-slices")


def add_columns(columns: list) -> list:
    """Bitmap arithmetic: columns[w] is an array (queries, m, words) whose bitmaps count 2**w each; one bitmap a column is left."""
    import numpy as np

    out, w = [], 0
    while w < len(columns):
        c = columns[w]
        while c.shape[1] > 1:
            n = c.shape[1] // 3
            if not n:
                a, b = c[:, 0:1], c[:, 1:2]
                total, carry, rest = a ^ b, a & b, c[:, 2:]
            else:
                # Thirds, each of neighbouring bitmaps: long runs of memory.
                x, y, z = c[:, :n], c[:, n : 2 * n], c[:, 2 * n : 3 * n]
                half = x ^ y
                total, carry, rest = half ^ z, (x & y) | (half & z), c[:, 3 * n :]
            c = np.concatenate((total, rest), axis=1) if rest.shape[1] else total
            if w + 1 == len(columns):
                columns.append(carry)
            else:
                columns[w + 1] = np.concatenate((columns[w + 1], carry), axis=1)
        out.append(c)
        w += 1
    return out


def top_rows(slices, valid, k: int):
    """Row numbers of the k largest sums, most significant slice first; the boundary's rows in order of their number."""
    import numpy as np

    sure, tied = np.zeros_like(valid), valid
    for s in reversed(slices):
        more = tied & s
        n = int(np.bitwise_count(sure | more).sum())
        if n > k:
            tied = more
        else:
            sure, tied = sure | more, tied & ~s
            if n == k:
                tied = np.zeros_like(valid)
                break
    bits = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    inside = bits(sure)
    return np.concatenate((inside, bits(tied)[: k - len(inside)]))


def _gathered(queries: list[list[int]], first, widths, flip: int, none: int, both) -> list:
    """Per column w the bitmaps that count 2**w for each query: slice b of an attribute for bit j of the query's, where j + b = w; filled up with empty ones."""
    import numpy as np

    wide = any(abs(v) >> 62 for q in queries for v in q)
    q, width = np.array(queries, object if wide else np.int64).reshape(len(queries), -1), np.array(widths, np.int64)
    size = abs(q)
    bits = int(size.max()).bit_length() if q.size else 0
    most = int(width.max()) if len(width) else 0
    base = first[:-1] + np.where(q < 0, flip, 0)
    on = [(size >> j & 1).astype(bool) for j in range(bits)]
    columns = []
    for w in range(max(1, bits + most - 1)):
        js = range(max(0, w - most + 1), min(bits, w + 1))
        if not js:
            columns.append(both[np.full((len(queries), 1), none)])
            continue
        meant = np.concatenate([on[j] & (w - j < width) for j in js], axis=1)
        where = np.concatenate([base + (w - j) for j in js], axis=1)
        place = meant.cumsum(axis=1)
        at = np.full((len(queries), max(1, int(place[:, -1].max()))), none)
        row, col = np.nonzero(meant)
        at[row, place[row, col] - 1] = where[row, col]
        columns.append(both[at])
    return columns


def search_block(ids, numbers, low: list[int], widths, bitmaps, queries: list[tuple[int, list[int]]], k: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """For each (row, q): its place, then the vec_ids and scores of the block's k best; ``numbers`` are the block's rows."""
    import numpy as np

    words, n = bitmaps.shape[1], len(ids)
    rows = np.zeros(words * 64, np.uint8)
    rows[:n] = 1
    every = np.packbits(rows, bitorder="little").view("<u8")
    first = np.concatenate(([0], np.cumsum(widths))).astype(int)
    both = np.concatenate((bitmaps, ~bitmaps & every, np.zeros((1, words), "<u8")))
    none, flip = len(both) - 1, len(bitmaps)
    for start in range(0, len(queries), TOGETHER):
        part = queries[start : start + TOGETHER]
        columns = _gathered([q for _, q in part], first, widths, flip, none, both)
        sums = add_columns(columns)
        for i, (row, q) in enumerate(part):
            mine = [s[i, 0] for s in sums]
            valid = every
            if (same := np.flatnonzero(numbers == row)).size:
                rows = np.unpackbits(every.view(np.uint8), bitorder="little")
                rows[same] = 0
                valid = np.packbits(rows, bitorder="little").view("<u8")
            found = top_rows(mine, valid, k)
            # What was added for a positive q is q (x - low); for a negative one |q| (2**width - 1 - (x - low)).
            shift = sum(v * low[d] if v >= 0 else v * low[d] + v * ((1 << widths[d]) - 1) for d, v in enumerate(q))
            at, bit = found >> 6, (found & 63).astype(np.uint64)
            scores = sum(((s[at] >> bit) & np.uint64(1)).astype(np.int64 if len(mine) < 63 else object) << w for w, s in enumerate(mine)).tolist() if len(found) else []
            yield start + i, ids[found].tolist(), [int(x) + shift for x in scores]


ANSWER = "query int, query_id long, vec_id long, score long, beyond binary"


def _search(chunk, k: int, scale: int):
    schema = pa.schema([("query", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        asked: dict[int, list[int]] = {}
        for i, (_, _, dim, _, _) in enumerate(chunk.value):
            asked.setdefault(dim, []).append(i)
        best: dict[int, list[tuple[int, int]]] = {}

        def query(i):
            row, _, _, q, far = chunk.value[i]
            return row, np.frombuffer(q, "<i8").tolist() if far is None else whole_numbers(far, scale)

        for dim, n, ids, numbers, low, widths, bitmaps in rows_of(batches):
            ids, numbers = np.frombuffer(ids, "<i8"), np.frombuffer(numbers, "<i8")
            bitmaps = np.frombuffer(bitmaps, "<u8").reshape(sum(widths), -(-n // 64))
            own, low = asked.get(dim, []), [int(x) for x in low]
            for start in range(0, len(own), TOGETHER):
                part = own[start : start + TOGETHER]
                for i, found, scores in search_block(ids, numbers, low, widths, bitmaps, [query(j) for j in part], k):
                    mine = [(-s, v) for s, v in zip(scores, found, strict=True)]
                    best[part[i]] = sorted(best[part[i]] + mine)[:k] if part[i] in best else sorted(mine)
        rows = []
        for i in list(best):
            for s, v in best.pop(i):
                score = min(MOST, max(LEAST, -s))
                rows.append((i, chunk.value[i][1], v, score, sort_key(-s) if not LEAST < score < MOST else None))
            if len(rows) > 50_000 or not best:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)
                rows = []

    return run


def top_k(queries: DataFrame, index: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of each query (rows of ``quantised``)."""
    import numpy as np

    spark = queries.sparkSession
    path = scratch.new_path(spark, "top-rows")

    def answer(chunk: list, number: int) -> None:
        shared = spark.sparkContext.broadcast(chunk)
        found = index.mapInArrow(_search(shared, k, scale), ANSWER).withColumn("chunk", F.lit(number))
        found.write.mode("append").parquet(path)
        shared.unpersist()

    held, size, number = [], 0, 0
    for r in queries.select("row", "vec_id", "q", "far").toLocalIterator():
        q, far = None if r["q"] is None else np.array(r["q"], "<i8").tobytes(), r["far"]
        held.append((r["row"], r["vec_id"], len(far) if q is None else len(q) >> 3, q, far))
        size += 100 + (len(q) if far is None else 32 * len(far))
        if size >= query_bytes:
            answer(held, number)
            held, size, number = [], 0, number + 1
    answer(held, number)
    best = Window.partitionBy("chunk", "query").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = spark.read.schema(ANSWER + ", chunk int").parquet(path).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.n, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.n <> b.n AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op5_bitslice_topk(spark, sf_dir) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors.filter(f"vec_id % {EVERY} = 0"), build_index(vectors))

"""Global positions by two-level prefix sums, and token blocks of a fixed width."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import scratch
from siltstone.operators import running


def offsets(df: DataFrame, size: str, order: list[str], within: list[str] = ()) -> DataFrame:
    """Adds ``start``: the sum of ``size`` over all earlier rows in ``order`` (per ``within``).

    Rows are range-partitioned by the order and stored with their partition's number, so that it stays the same for
    both reads that follow; a window runs inside a partition, and one over the partitions' totals (a row a partition)
    gives each its base. No task sorts all rows.
    """
    keys = [*within, *order]
    placed = scratch.stored(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if within else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part", *within).agg(F.sum(size).alias("_total"))
    bases = totals.withColumn("_base", F.coalesce(F.sum("_total").over(ahead), F.lit(0))).drop("_total")
    local = placed.withColumn("_local", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    same = (F.col("l._part") == F.col("r._part"))
    for k in within:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = local.alias("l").join(bases.alias("r"), same)
    return joined.select("l.*", (F.col("_local") + F.col("_base")).cast("long").alias("start")).drop("_part", "_local")


def blocks(docs: DataFrame, tokens: str, order: list[str], length: int, overlap: bool, within: list[str] = (), tail: bool = False) -> DataFrame:
    """Blocks of ``length`` + 1 tokens of the concatenated documents (per ``within``): block, tokens.

    Disjoint blocks step by length + 1; overlapping ones by length, so that a block's last token is the next one's
    first. What doesn't fill a block is left off, or with ``tail`` kept as a last, shorter one. A document adds at most one row a block it touches to the shuffle:
    slices of tokens travel, not single tokens.
    """
    width, step = length + 1, length if overlap else length + 1
    numbered = "_row" in docs.columns  # a stored table whose rows have numbers already
    own = docs.select(*within, *order, F.col(tokens).alias("_tokens"), F.size(tokens).alias("_n"), F.col("_row") if numbered else F.monotonically_increasing_id().alias("_row")).filter("_n > 0")
    own = own if numbered else scratch.stored(own, "tokens")
    starts = offsets(own.drop("_tokens"), "_n", order, within).select("_row", "start")  # of keys and sizes alone
    first, last = F.expr(f"greatest(0, floor((start - {width - step}) / {step}))"), F.expr(f"(start + _n - 1) div {step}")
    cut = own.join(starts, "_row").withColumn("block", F.explode(F.sequence(first.cast("long"), last)))
    low = F.greatest(F.col("block") * step, F.col("start"))
    high = F.least(F.col("block") * step + width, F.col("start") + F.col("_n"))
    part = cut.filter(high > low).select(*within, "block", low.alias("low"), F.slice("_tokens", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("part"))
    whole = part.groupBy(*within, "block").agg(F.sort_array(F.collect_list(F.struct("low", "part"))).alias("parts")).select(*within, "block", F.flatten(F.transform("parts", lambda p: p["part"])).alias("tokens"))
    return whole if tail else whole.filter(F.size("tokens") == width)


def _pieces(within: list[str], step: int, width: int, rows: int = 512):
    """Rows (``within``, start, tokens) to pieces of blocks. What follows without a gap is one run, of whose whole blocks each is one piece; a task's rows may come in any order, they then make more runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: dict[tuple, tuple[int, np.ndarray, bool]] = {}  # start, tokens, and whether blocks that began earlier are done with

        def sent(key: tuple, blocks: np.ndarray, low: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            own = [pa.array([k] * len(blocks), t) for k, t in zip(key, types, strict=True)]
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
            return pa.RecordBatch.from_arrays([*own, pa.array(blocks, pa.int64()), pa.array(low, pa.int64()), lists, pa.array(sizes, pa.int32())], names=[*within, "block", "low", "part", "size"])

        def edges(key: tuple, start: int, tokens: np.ndarray, first: int, last: int) -> pa.RecordBatch:
            blocks = np.arange(first, last + 1)
            low, high = np.maximum(blocks * step, start), np.minimum(blocks * step + width, start + len(tokens))
            return sent(key, blocks, low, high - low, np.concatenate([tokens[a - start : b - start] for a, b in zip(low, high, strict=True)]))

        def first_of(start: int, done: bool) -> int:
            return start // step if done else max(0, (start - (width - step)) // step)

        def let_go(key: tuple) -> Iterator[pa.RecordBatch]:
            start, tokens, done = held.pop(key)
            first, last = first_of(start, done), (start + len(tokens) - 1) // step
            if last >= first:
                yield edges(key, start, tokens, first, last)

        def more(key: tuple, start: int, tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
            done = False
            if key in held:
                if held[key][0] + len(held[key][1]) == start:
                    start, earlier, done = held.pop(key)
                    tokens = np.concatenate([earlier, tokens])
                else:
                    yield from let_go(key)
            first, last = -(-start // step), (start + len(tokens) - width) // step
            if last >= first:
                if not done and first_of(start, done) < first:
                    yield edges(key, start, tokens, first_of(start, done), first - 1)
                blocks = np.arange(first, last + 1)
                yield sent(key, blocks, blocks * step, np.full(len(blocks), width), tokens[((blocks * step - start)[:, None] + np.arange(width)).ravel()])
                tokens, start, done = tokens[(last + 1) * step - start :].copy(), (last + 1) * step, True
            held[key] = (start, tokens, done)

        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            types, kind = [batch.column(k).type for k in within], batch.column("tokens").type.value_type
            keys = list(zip(*(batch.column(k).to_pylist() for k in within), strict=True)) if within else [()] * batch.num_rows
            starts = batch.column("start").to_numpy()
            for key in dict.fromkeys(keys):
                own = np.array([i for i, k in enumerate(keys) if k == key])
                taken = batch.column("tokens").take(pa.array(own))
                values, ends, at = taken.flatten().to_numpy(), np.concatenate([[0], np.cumsum(taken.value_lengths().to_numpy())]), starts[own]
                cuts = [0, *(np.flatnonzero(at[1:] != at[:-1] + np.diff(ends)[:-1]) + 1).tolist(), len(own)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    yield from more(key, int(at[a]), values[ends[a] : ends[b]])
        for key in list(held):
            yield from let_go(key)

    return run


def placed_blocks(rows: DataFrame, tokens: str, length: int, overlap: bool, within: list[str] = ()) -> DataFrame:
    """``blocks`` of stored rows of numbers that were dealt by ranges of their order: ``_part`` is a row's range, ``_local`` the tokens ahead of it there (per ``within``); no row is empty.

    A range's base comes from the ranges' totals (a row a range and value of ``within``, broadcast). A task that reads
    neighbours cuts their blocks itself, so only what lies on the edges of its runs is shuffled, not the tokens.
    """
    width, step = length + 1, length if overlap else length + 1
    within = list(within)
    ahead = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if within else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part", *within).agg(F.sum(F.size(tokens)).alias("_total"))
    bases = totals.withColumn("_base", F.coalesce(F.sum("_total").over(ahead), F.lit(0))).drop("_total")
    started = rows.alias("l").join(F.broadcast(bases).alias("r"), running.same("l", "r", within))
    own = started.select(*(F.col(f"l.{k}") for k in within), (F.col("_local") + F.col("_base")).cast("long").alias("start"), F.col(tokens).alias("tokens"))
    schema = T.StructType([*own.schema.fields[: len(within)], T.StructField("block", T.LongType()), T.StructField("low", T.LongType()), T.StructField("part", rows.schema[tokens].dataType), T.StructField("size", T.IntegerType())])
    pieces = scratch.stored(own.mapInArrow(_pieces(within, step, width), schema), "pieces")
    whole = pieces.filter(F.col("size") == width).select(*within, "block", F.col("part").alias("tokens"))
    rest = pieces.filter(F.col("size") < width).groupBy(*within, "block").agg(F.sort_array(F.collect_list(F.struct("low", "part"))).alias("parts")).select(*within, "block", F.flatten(F.transform("parts", lambda p: p["part"])).alias("tokens"))
    return whole.unionByName(rest.filter(F.size("tokens") == width))


def shifted(packed: DataFrame) -> DataFrame:
    """Inputs (all but the last token) and labels (all but the first)."""
    n = F.size("tokens") - 1
    return packed.withColumns({"inputs": F.slice("tokens", F.lit(1), n), "labels": F.slice("tokens", F.lit(2), n)})


def block_at(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """Global block numbers (``block``) to shard and row: the shard whose range holds it, by a sorted sweep; a block that is wanted often is looked up once."""
    low = offsets(shards.filter("blocks > 0").select("shard", "blocks"), "blocks", ["shard"])
    held = running.holder(low, "start", wanted, "block").filter(F.col("block") < F.col("start") + F.col("blocks"))
    return wanted.join(held.select("block", "shard", (F.col("block") - F.col("start")).alias("row")), "block").select("block", "shard", "row")


def epoch_order(packed: DataFrame, shard: str, row: str, seed: int, epoch: int, workers: int = 1) -> DataFrame:
    """Shards shuffled by seed and epoch, rows in order inside; ``worker`` takes every ``workers``-th shard."""
    shards = packed.select(shard).distinct().withColumn("_rank", F.row_number().over(Window.orderBy(F.xxhash64(shard, F.lit(seed), F.lit(epoch)), shard)) - 1)
    placed = packed.join(shards, shard).withColumn("worker", F.pmod("_rank", F.lit(workers)))
    return placed.orderBy("_rank", row).withColumnRenamed("_rank", "shard_rank")

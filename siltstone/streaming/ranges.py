"""An endless stream over Parquet files whose offset is (epoch, file, row), and packing with a commit log.

The source hands out ranges of rows, a few numbers each: files in natural order, epoch after epoch. Tasks then read the
rows of their ranges and no others, one column of the row groups that hold them. A micro-batch is a number of rows, so
progress is exact to the row, and a stopped stream goes on where its checkpoint, or an exported state, says.

``Packer`` packs batch after batch into blocks: the tokens that filled no block are the first of the next batch. Blocks
of a batch are made by prefix sums over all its rows, in parallel; what a batch leaves is less than a block. A batch
counts once its log row is written, after its blocks; one that is offered again is left alone, and half-written blocks
of a killed attempt are replaced. So a run that is killed anywhere ends with the same blocks.

Files are read by their own URI with Arrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from siltstone import scratch
from siltstone.operators import packing
from siltstone.sources import scans

RANGES = "epoch long, file int, path string, low long, high long"
ORDER = ["epoch", "file", "row"]
BLOCKS = "block long, shard int, tokens array<int>"
LOG = "batch long, first_epoch long, first_file int, first_row long, epoch long, file int, row long, next_block long, remainder array<int>, seen long, filtered long, skipped long, documents long, tokens long"
#: Rows of a micro-batch and of a range, which is one task's.
BATCH_ROWS, TASK_ROWS = 100_000, 5_000


def planned(spark: SparkSession, *paths: str) -> list[tuple[str, int]]:
    """The files below the paths in natural order with their numbers of rows, which Spark counts from the footers."""
    found = spark.read.parquet(*paths).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))
    return sorted(((r["path"], r["n"]) for r in found.collect()), key=lambda f: scans.natural_key(f[0]))  # a row a file


def advance(files: list[tuple[str, int]], at: tuple[int, int, int], rows: int, epochs: int = 0, task_rows: int = TASK_ROWS) -> tuple[list[tuple], tuple[int, int, int]]:
    """The next ranges (epoch, file, path, low, high) of ``rows`` rows from ``at`` on, and where they end; ``epochs`` 0: without end."""
    (epoch, file, row), out = at, []
    if not any(n for _, n in files):
        return out, at
    while True:
        if file >= len(files):
            epoch, file, row = epoch + 1, 0, 0
        if not rows or (epochs and epoch >= epochs):
            return out, (epoch, file, row) if out else at
        path, n = files[file]
        if row >= n:
            file, row = file + 1, 0
            continue
        taken = min(rows, n - row, task_rows)
        out.append((epoch, file, path, row, row + taken))
        rows, row = rows - taken, row + taken


class RangeReader(SimpleDataSourceStreamReader):
    """Ranges from an offset on. Only their numbers pass through the driver."""

    def __init__(self, options: dict):
        self.files = [(p, int(n)) for p, n in json.loads(options["files"])]
        self.rows, self.epochs, self.task_rows = int(options.get("rows", BATCH_ROWS)), int(options.get("epochs", "0")), int(options.get("taskrows", TASK_ROWS))
        self.start = json.loads(options.get("start", '{"epoch": 0, "file": 0, "row": 0}'))

    def initialOffset(self) -> dict:
        return self.start

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        ranges, end = advance(self.files, (start["epoch"], start["file"], start["row"]), self.rows, self.epochs, self.task_rows)
        return iter(ranges), dict(zip(ORDER, end, strict=True))

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.read(start)[0] if start != end else iter(())


class RangeSource(DataSource):
    """``spark.readStream.format("row_ranges")``; options files (JSON of ``planned``), rows (a batch), taskRows, epochs (0: endless), start (JSON of epoch, file, row)."""

    @classmethod
    def name(cls) -> str:
        return "row_ranges"

    def schema(self) -> str:
        return RANGES

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return RangeReader({k.lower(): v for k, v in self.options.items()})


def read_rows(ranges: DataFrame, column: str) -> DataFrame:
    """(epoch, file, row, text) of the ranges' rows; a range is one task's."""
    schema = pa.schema([("epoch", pa.int64()), ("file", pa.int32()), ("row", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for r in (x for b in batches for x in b.to_pylist()):
            where, name = fs.FileSystem.from_uri(r["path"])
            with pq.ParquetFile(name, filesystem=where) as f:
                if column not in f.schema_arrow.names:
                    raise ValueError(f"no column {column} in {r['path']}")
                at = 0
                for g in range(f.num_row_groups):
                    n = f.metadata.row_group(g).num_rows
                    if at < r["high"] and at + n > r["low"]:
                        row = at
                        for b in f.iter_batches(batch_size=1024, row_groups=[g], columns=[column]):
                            low, high = max(r["low"], row), min(r["high"], row + b.num_rows)
                            if low < high:
                                texts = b.column(0).slice(low - row, high - low).cast(pa.string())
                                yield pa.RecordBatch.from_arrays([pa.array([r["epoch"]] * (high - low), pa.int64()), pa.array([r["file"]] * (high - low), pa.int32()), pa.array(range(low, high), pa.int64()), texts], schema=schema)
                            row += b.num_rows
                    at += n

    return ranges.mapInArrow(run, "epoch long, file int, row long, text string")


class Packer:
    """Packs batches of ranges below ``out`` (blocks, log), each once; for ``foreachBatch`` or a loop of its own.

    ``tokens`` makes an array column of rows (epoch, file, row, text): null where a text is filtered; arrays with fewer
    than ``least`` tokens are skipped. ``initial`` is the exported state of a run that is to go on elsewhere.
    """

    def __init__(self, spark: SparkSession, out: str, tokens: Callable[[DataFrame], DataFrame], length: int, overlap: bool = True, blocks_per_shard: int = 64, column: str = "text", least: int = 1, initial: dict | None = None):
        self.spark, self.out, self.tokens, self.length, self.overlap, self.per, self.column, self.least, self.initial = spark, out, tokens, length, overlap, max(1, blocks_per_shard), column, least, initial

    def log(self) -> DataFrame:
        """A row a batch that counts: where it began and ended, the next block's number, the tokens left over, counters."""
        found = scans.discover(self.spark, f"{self.out}/log", "batch-*/*.parquet")
        return self.spark.read.schema(LOG).parquet(*found) if found else self.spark.createDataFrame([], LOG)

    def state(self, batch: int | None = None) -> dict | None:
        """The last batch's log row (or that of ``batch``) as a dict: an exportable state."""
        log = self.log()
        row = (log.filter(F.col("batch") == batch) if batch is not None else log.orderBy(F.desc("batch"))).first()
        return row.asDict() if row else None

    def blocks(self) -> DataFrame:
        """block, shard, tokens of the batches that count."""
        last = self.state()
        if last is None:
            return self.spark.createDataFrame([], BLOCKS)
        own = self.spark.read.schema(f"{BLOCKS}, batch long").parquet(f"{self.out}/blocks").filter((F.col("batch") <= last["batch"]) & (F.size("tokens") == self.length + 1))
        return own.drop("batch")

    def counters(self) -> DataFrame:
        return self.log().agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seen", "filtered", "skipped", "documents", "tokens")), F.coalesce(F.max("next_block"), F.lit(0)).alias("blocks"))

    def __call__(self, ranges: DataFrame, batch: int) -> None:
        asked = ranges.collect()  # a few numbers a task
        if not asked:
            raise ValueError("a batch without rows")
        first, end = min((r["epoch"], r["file"], r["low"]) for r in asked), max((r["epoch"], r["file"], r["high"]) for r in asked)
        if done := self.state(batch):
            if (done["first_epoch"], done["first_file"], done["first_row"]) != first:
                raise ValueError(f"batch {batch} below {self.out} began at another row: the blocks there are another run's")
            return
        last = self.state(batch - 1) if batch else self.initial
        if batch and last is None:
            raise ValueError(f"batch {batch - 1} is not in the log below {self.out}")
        base, left = (last["next_block"], last["remainder"]) if last else (0, [])
        rows = read_rows(self.spark.createDataFrame(asked, RANGES).repartition(len(asked)), self.column)
        own = scratch.stored(self.tokens(rows).select(*ORDER, "tokens", F.monotonically_increasing_id().alias("_row")), "packer-tokens")
        size = F.size("tokens")
        counts = own.agg(F.count("*").alias("seen"), F.count_if(F.col("tokens").isNull()).alias("filtered"), F.count_if(F.col("tokens").isNotNull() & (size < self.least)).alias("skipped"), F.count_if(size >= self.least).alias("documents"), F.coalesce(F.sum(F.when(size >= self.least, size)), F.lit(0)).alias("tokens")).first()
        held = self.spark.createDataFrame([(-1, -1, -1, left, -1)], own.schema)  # less than a block
        cut = packing.blocks(own.filter(size >= self.least).unionByName(held), "tokens", ORDER, self.length, self.overlap, tail=True)
        # What is left over is written with the blocks, as a shorter last one that no reader is given.
        at = f"{self.out}/blocks/batch={batch}"
        cut.select((F.col("block") + base).alias("block"), F.expr(f"cast((block + {base}) div {self.per} as int)").alias("shard"), "tokens").write.mode("overwrite").parquet(at)
        cut = self.spark.read.schema(BLOCKS).parquet(at)
        n, rest = cut.filter(F.size("tokens") == self.length + 1).count(), cut.filter(F.size("tokens") <= self.length).first()
        row = (batch, *first, *end, base + n, rest["tokens"] if rest else [], *counts)
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.out}/log/batch-{batch}")
        scratch.forget(own)


def stream(spark: SparkSession, files: list[tuple[str, int]], rows: int = BATCH_ROWS, epochs: int = 0, start: dict | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """The endless (or ``epochs`` long) stream of ranges; ``start`` is an exported state's epoch, file and row."""
    spark.dataSource.register(RangeSource)
    read = spark.readStream.format("row_ranges").option("files", json.dumps(files)).option("rows", rows).option("epochs", epochs).option("taskRows", task_rows)
    return (read.option("start", json.dumps({k: start[k] for k in ORDER})) if start else read).load()


class Enough(Exception):
    """Ends a run before a batch is packed; its checkpoint offers the batch again."""


def run(ranges: DataFrame, packer: Packer, checkpoint: str, batches: int | None = None) -> dict | None:
    """Runs the stream into the packer until it has no more rows, or until ``batches`` more batches count (of a stream that has more than those); the state then."""
    last = packer.state()
    goal = None if batches is None else (last["batch"] if last else -1) + batches
    met = []

    def pack(batch: DataFrame, number: int) -> None:
        if goal is not None and number > goal:
            met.append(number)
            raise Enough
        packer(batch, number)

    query = ranges.writeStream.foreachBatch(pack).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable() if goal is None else query.awaitTermination()
    except StreamingQueryException:
        if not met:
            raise
    finally:
        query.stop()
    return packer.state()


def pack_files(spark: SparkSession, files: list[tuple[str, int]], packer: Packer, rows: int = BATCH_ROWS, limit: int | None = None, task_rows: int = TASK_ROWS, batches: int | None = None) -> bool:
    """One pass over the files, ``limit`` rows at most across them, a batch at a time; batches in the log are passed over. Whether all are done (``batches`` stops after so many)."""
    total = sum(n for _, n in files)
    left, at, batch, made = total if limit is None else min(limit, total), (0, 0, 0), 0, 0
    last = packer.state()
    while left > 0:
        ranges, end = advance(files, at, min(rows, left), 1, task_rows)
        if last is None or batch > last["batch"]:
            if batches is not None and made >= batches:
                return False
            packer(spark.createDataFrame(ranges, RANGES), batch)
            made += 1
        left, at, batch = left - min(rows, left), end, batch + 1
    return True

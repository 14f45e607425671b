"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.bpe import Cache  # noqa: F401

#: Fixed value: ASCII capitals, in order, and what they become.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: a word is a run of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


#: Repeats of a row that are written out at once.
AT_ONCE = 1 << 16


def repeated(rows: DataFrame, count: str, number: str, at_once: int = AT_ONCE) -> DataFrame:
    """Each row as often as ``count`` (1 or more) says, numbered from 0 in ``number``.

    A row becomes ranges of at most ``at_once`` numbers first. Where a row has several, the ranges are dealt to as many tasks
    as a shuffle of the session has, so neither one array nor one task holds all repeats of a row. ``rows`` should be cheap
    to read twice.
    """
    zero, step = F.lit(0).cast("long"), F.lit(at_once).cast("long")
    ranges = rows.withColumn("_from", F.explode(F.sequence(zero, F.col(count) - 1, step)))
    if not rows.filter(F.col(count) > at_once).isEmpty():
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = ranges.repartition(tasks, F.xxhash64(*rows.columns, "_from"))
    last = F.least(F.col("_from") + step, F.col(count)) - 1
    return ranges.withColumn(number, F.explode(F.sequence("_from", last))).drop("_from")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


_state: dict[str, object] = {}


def worker_state(key: str, make: Callable[[], object]):
    """What this worker keeps between tasks under ``key``. It keeps one thing: another operator's or run's is let go first.

    So caches of queries that came before never add up; each cache has its own bound in entries and key lengths.
    """
    if key not in _state:
        release()
        _state[key] = make()
    return _state[key]


def release() -> None:
    """Let go what an earlier operator has left in this worker, and hand its memory back where the C library can; for functions that keep nothing themselves."""
    import ctypes
    import gc

    _state.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that few texts at a time become Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a partition, one after another."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Groups of neighbouring rows that agree in their first columns; rows of a group are streamed, not gathered."""
    import itertools

    yield from itertools.groupby(rows_of(batches), key=lambda r: r[:keys])

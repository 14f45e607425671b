"""Mixing sources to target weights as a time-varying curriculum, in DataFrame functions only.

Targets: sources (by code point, null last) weigh 1, 2, 3, repeating, and share the words of all documents; a target
stops at ``CAP`` times its source's words and the excess is reshared by weight. That fixed point is found without a
loop: with sources in order of cap per weight, the first that its share of what is left doesn't exceed ends the capped ones.

Curriculum: each source has a schedule of weight over training time 0..1, piecewise linear between knots. Its integral,
scaled to the target, is the source's cumulative demand; the k-th pass over a source's documents (in an order drawn by
hash) meets demand from k times the source's words on. A document's position in training is the time at which the
inverse of the demand reaches its first word. The documents are range-sorted by position.

Prefix sums have three levels: documents fall by hash into buckets whose number follows the row count, so a source with
a third of all rows is many small windows; buckets are grouped by the square root of their number, so that neither a
group's window nor a source's window over its groups holds more than that root. Rows that repeat id, source and text are one row
with a count, up to the point where each takes its place (in ranges that many tasks share, where one row repeats often), unless columns are carried; texts tell rows with null or repeated ids apart. Every source takes exactly
its rounded target: passes over all its documents and, at the last one's end, part of one document at most.

Defined cases: a null text has size 0 and is taken 0 words; all-empty corpora have targets 0; null ids and repeated rows
are documents like others (ties in the order are broken by id, size and text); very long texts are only counted; a source column that is null is a source; an
empty table gives no rows; other columns are only carried, under any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.llm.common import repeated

CAP, SEED, ROWS_PER_BUCKET = 3, 17, 128
#: Bytes of a plan up to which it is broadcast, and of one of its rows, about.
BROADCAST_BYTES, PLAN_BYTES = 32 << 20, 120
#: Weight schedules, dealt to sources in turn: knots (time, weight). Rising, falling, level, peaked in the middle.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0))


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """Per source of (source, size): source, place (from 0), source_size, target. One row a source: its windows are over that table."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).withColumn("weight", F.col("place") % 3 + 1)
    # cap / weight as an exact rational order: source_size * 6 / weight is a whole number for weights 1, 2, 3.
    by_level = Window.orderBy(F.expr("source_size * 6 div weight"), "place")
    before, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumns({"left": F.sum("source_size").over(everything) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap, "weights": F.sum("weight").over(rest)})
    s = s.withColumn("capped", F.col("left").cast("double") * F.col("weight") > F.col("source_size").cast("double") * cap * F.col("weights"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.expr("source_size * 6 div weight"), "place", F.col("left"), F.col("weights")))).over(everything)
    s = s.withColumn("free", free)
    share = F.col("free.left").cast("double") * F.col("weight") / F.col("free.weights")
    return s.select("source", "place", "source_size", F.when(F.col("capped") | F.col("free").isNull(), F.col("source_size").cast("double") * cap).otherwise(share).alias("target"))


def inverse_demand(u: Column, place: Column, schedules=SCHEDULES) -> Column:
    """Time at which a source's cumulative demand, as a share of its target, reaches ``u`` (0..1)."""
    found = None
    for i, knots in enumerate(schedules):
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
        time, done = F.lit(1.0), whole
        for (t0, w0), (t1, w1) in reversed(list(zip(knots, knots[1:], strict=False))):
            done -= (area := (t1 - t0) * (w0 + w1) / 2)
            need = u * whole - done
            slope = (w1 - w0) / (t1 - t0)
            # w0 x + slope x^2 / 2 = need, in the form that also holds at slope 0.
            x = F.lit(2.0) * need / (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * need)) + w0) if w0 else F.sqrt(F.greatest(F.lit(0.0), F.lit(2 / slope) * need))
            time = F.when(need >= area, time).otherwise(F.lit(t0) + x)
        found = F.when(place % len(schedules) == i, time) if found is None else found.when(place % len(schedules) == i, time)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), found))


def plan(docs: DataFrame, carry: tuple[str, ...] = (), cap: int = CAP, schedules=SCHEDULES, rows_per_bucket: int = ROWS_PER_BUCKET, seed: int = SEED) -> DataFrame:
    """One row a document, not yet sorted: doc_id, source, size, t (hash of the text), source_size, target, taken, passes, position, and struct ``row`` of the columns to carry.

    ``passes`` lists (position, words) of each time the mix takes the document; ``position`` is the first, null if none.
    """
    id_, text, source = F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")
    buckets = max(16, docs.count() // rows_per_bucket)
    own = docs.select(id_.alias("doc_id"), source.alias("source"), word_count(text).alias("size"), F.xxhash64(text, F.lit(seed)).alias("t"), F.struct(*carry, F.lit(0).alias("_")).alias("row"))
    own = own.withColumns({"h": F.xxhash64("doc_id", F.lit(seed)), "bucket": F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "t"), F.lit(buckets)).cast("int"), "copies": F.lit(1).cast("long")})
    if not carry:
        own = scratch.stored(own.groupBy("doc_id", "source", "size", "t", "h", "bucket").agg(F.count("*").alias("copies")), "mix-sizes").withColumn("row", F.struct(F.lit(0).alias("_")))
    parts = scratch.stored(own.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("size")), "mix-buckets")
    t = targets(parts, cap)
    span = math.isqrt(buckets - 1) + 1
    parts = parts.withColumn("block", F.expr(f"bucket div {span}").cast("int"))
    ahead = lambda by, order: F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = parts.groupBy("source", "block").agg(F.sum("size").alias("size")).select(F.col("source").alias("bs"), F.col("block").alias("bb"), ahead(("source",), "block").alias("before"))
    offsets = parts.withColumn("offset", ahead(("source", "block"), "bucket"))
    offsets = offsets.join(blocks, offsets["source"].eqNullSafe(blocks["bs"]) & (F.col("block") == F.col("bb"))).select("source", "bucket", (F.col("offset") + F.col("before")).alias("offset"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    offsets = offsets.join(t, same(offsets, t)).select(offsets["source"].alias("s"), F.col("bucket").alias("b"), "offset", "place", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "t").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("ahead", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    if not carry:
        own = repeated(own, "copies", "copy").withColumn("ahead", F.col("ahead") + F.col("copy") * F.col("size"))
    own = own.join(offsets, own["source"].eqNullSafe(offsets["s"]) & (F.col("bucket") == F.col("b"))).withColumn("at", F.col("offset") + F.col("ahead"))
    goal = F.round("target").cast("long")
    times = F.sequence(F.lit(0), F.lit(cap - 1))
    words = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), goal - (k * F.col("source_size") + F.col("at"))))
    position = lambda k: inverse_demand((k * F.col("source_size") + F.col("at")).cast("double") / F.greatest(F.col("target"), F.lit(1.0)), F.col("place"), schedules)
    taken = F.filter(F.transform(times, lambda k: F.struct(position(k).alias("position"), words(k).cast("long").alias("words"))), lambda p: p["words"] > 0)
    out = own.withColumn("passes", taken)
    total = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    first = F.when(F.size("passes") > 0, F.col("passes")[0]["position"])
    return out.select("doc_id", "source", "size", "t", "source_size", "target", total.alias("taken"), "passes", first.alias("position"), "row")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Documents range-sorted by their first position; those that the mix doesn't take come first, with a null position."""
    planned = scratch.stored(plan(docs, **options), "mix-plan")
    return planned.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def stream(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, seed: int = SEED, **options) -> DataFrame:
    """The training stream: each document once for each pass that takes it, with ``position`` and ``words``, range-sorted by position.

    The columns of ``docs`` are carried whole; only the pass that meets a source's target has ``words`` below the size.
    The plan is made on narrow rows and meets the documents by id, source and text's hash, as a broadcast where it is small, so that whole
    texts move once, into their order. Where rows repeat all three, each carries its columns through the plan instead.
    """
    carry = tuple(docs.columns)
    taken = scratch.stored(plan(docs, seed=seed, **options).filter(F.size("passes") > 0).select("doc_id", "source", "t", "passes"), "mix-plan")
    if taken.groupBy("doc_id", "source", "t").count().filter("count > 1").isEmpty():
        m = taken.select(*(F.col(c).alias(f"_m_{c}") for c in taken.columns))
        if taken.count() * PLAN_BYTES <= broadcast_bytes:
            m = F.broadcast(m)
        same = docs["doc_id"].cast("long").eqNullSafe(m["_m_doc_id"]) & docs["source"].cast("string").eqNullSafe(m["_m_source"]) & (F.xxhash64(docs["text"].cast("string"), F.lit(seed)) == m["_m_t"])
        planned = docs.join(m, same).select(*(docs[c] for c in carry), F.col("_m_doc_id").alias("_id"), F.explode("_m_passes").alias("_p"))
        placed = planned.select(*(planned[c] for c in carry), F.col("_p.position").alias("_position"), F.col("_p.words").alias("_words"), "_id")
    else:
        planned = plan(docs, carry=carry, seed=seed, **options).select("row", "doc_id", F.explode("passes").alias("p"))
        placed = planned.select(*(F.col("row").getField(c).alias(c) for c in carry), F.col("p.position").alias("_position"), F.col("p.words").alias("_words"), F.col("doc_id").alias("_id"))
    return placed.repartitionByRange("_position", "_id").sortWithinPartitions("_position", "_id")


def op4_mixing(spark, sf_dir) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "position")

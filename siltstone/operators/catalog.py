"""Tensor and shard catalogs: statistics, audits, apportionment, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators import running


def tensor_stats(df: DataFrame, key: str, values: str) -> DataFrame:
    """Counts of NaN and infinite values, and moments of the finite ones."""
    x = df.select(key, F.explode(F.col(values).cast("array<double>")).alias("x"))
    ok = F.when(~F.isnan("x") & (F.abs("x") != float("inf")), F.col("x"))
    return x.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.isnan("x")).alias("n_nan"), F.count_if(F.abs("x") == float("inf")).alias("n_inf"), F.min(ok).alias("lowest"), F.max(ok).alias("highest"),
        F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("std"), F.sqrt(F.avg(ok * ok)).alias("rms"), F.max(F.abs(ok)).alias("absmax"),
    )


def audit_shapes(expected: DataFrame, actual: DataFrame, key: str, shape: str) -> DataFrame:
    """Issues per key: missing, unexpected, shape_mismatch."""
    e, a = expected.select(key, F.col(shape).alias("_e")), actual.select(key, F.col(shape).alias("_a"))
    issue = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_a") != F.col("_e"), "shape_mismatch")
    return e.join(a, key, "full").select(key, issue.alias("issue")).filter("issue is not null")


def step_bounds(df: DataFrame, run: str, step: str) -> DataFrame:
    return df.groupBy(run).agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), (F.min(step) == F.max(step)).alias("uniform"))


def apportion(parts: DataFrame, name: str, count: str, requested: int) -> DataFrame:
    """Shards of each part: one each, the rest by largest remainder (ties: the later name). A row a part."""
    everything = Window.partitionBy(F.lit(0))
    own = parts.withColumn("_k", F.count("*").over(everything)).withColumn("_rest", F.greatest(F.lit(0), F.lit(requested) - F.col("_k")))
    size = F.greatest(F.lit(0), F.col(count))
    own = own.withColumn("_raw", F.col("_rest") * size / F.greatest(F.lit(1), F.sum(size).over(everything)))
    own = own.withColumn("_whole", F.floor("_raw"))
    own = own.withColumn("_place", F.row_number().over(Window.orderBy(F.desc(F.col("_raw") - F.col("_whole")), F.desc(name)))).withColumn("_open", F.col("_rest") - F.sum("_whole").over(everything))
    return own.select(name, count, (1 + F.col("_whole") + F.when(F.col("_place") <= F.col("_open"), 1).otherwise(0)).cast("long").alias("shards"))


def next_fit(df: DataFrame, run: str, order: str, size: str, most: int) -> DataFrame:
    """Adds ``file``: items in order go to a run's open file; one that doesn't fit opens the next."""
    return running.next_fit(df, run, order, size, most)


def weight_map(packed: DataFrame, run: str, name: str) -> DataFrame:
    """run, name, file_name of items that ``next_fit`` gave a file: ``model.safetensors`` where a run has one file, else numbered from 1."""
    n = packed.groupBy(run).agg((F.max("file") + 1).alias("_n"))
    numbered = F.format_string("model-%05d-of-%05d.safetensors", F.col("file") + 1, F.col("_n"))
    return packed.join(n, run).select(run, name, F.when(F.col("_n") == 1, "model.safetensors").otherwise(numbered).alias("file_name"))


def split_counts(rows: list[int], sizes: list[int], parts: int) -> list[int]:
    """Pieces per tensor: the one with the largest piece is split once more until there are ``parts``; none beyond its rows."""
    import heapq

    pieces = [1] * len(rows)
    heap = [(-s / 1.0, i) for i, s in enumerate(sizes) if rows[i] > 1]
    heapq.heapify(heap)
    while sum(pieces) < parts and heap:
        _, i = heapq.heappop(heap)
        pieces[i] += 1
        if pieces[i] < rows[i]:
            heapq.heappush(heap, (-sizes[i] / pieces[i], i))
    return pieces


def placement(keys: list[str], rows: list[int], sizes: list[int], parts: int) -> list[tuple[int, str, int, int, int]]:
    """(part, key, chunk_index, chunks, rows) of each piece: tensors are split as ``split_counts`` says, as evenly as their rows go, and dealt to the parts in turn."""
    pieces = [(k, i, n, r // n + (i < r % n)) for k, r, n in zip(keys, rows, split_counts(rows, sizes, parts), strict=True) for i in range(n)]
    return [(place % parts, *p) for place, p in enumerate(pieces)]


def placed(df: DataFrame, run: str, key: str, rows: str, size: str, parts: int) -> DataFrame:
    """``placement`` of each run's tensors (a run's tensors, some thousands at most, are one group)."""
    schema = T.StructType([df.schema[run], T.StructField("part", T.LongType()), df.schema[key], *(T.StructField(n, T.LongType()) for n in ("chunk_index", "chunks", "rows"))])

    def place(pdf):
        import pandas as pd

        own = pdf.sort_values(key)
        found = placement(own[key].tolist(), own[rows].astype(int).tolist(), own[size].astype(int).tolist(), parts)
        out = pd.DataFrame(found, columns=["part", key, "chunk_index", "chunks", "rows"])
        out.insert(0, run, own[run].iloc[0])
        return out

    return df.select(run, key, rows, size).groupBy(run).applyInPandas(place, schema)


def clip_factors(df: DataFrame, run: str, norm: str, floor: float, most: float, blend: float) -> DataFrame:
    """Per shard: RMS of the run's norms over its own, clamped, blended with 1."""
    rms = F.sqrt(F.avg(F.col(norm) * F.col(norm)).over(Window.partitionBy(run)))
    scale = F.least(F.lit(most), F.greatest(F.lit(floor), rms / F.greatest(F.col(norm), F.lit(1e-12))))
    return df.withColumn("scale", F.lit(1 - blend) + scale * blend)


def shard_scales(df: DataFrame, run: str, norm_sq: str, parameters: str, floor: float, most: float, blend: float) -> DataFrame:
    """Adds ``raw_scale``, the run's gradient RMS per parameter over the shard's own, and ``scale``, clamped and blended with 1; both 1 without a gradient."""
    total = df.groupBy(run).agg(F.sum(norm_sq).alias("_q"), F.sum(parameters).alias("_p"))
    own = df.join(total, run)
    none = (F.col("_q") <= 0) | (F.col("_p") <= 0) | (F.col(norm_sq) <= 0) | (F.col(parameters) <= 0)
    raw = F.sqrt(F.col("_q") / F.col("_p")) / F.greatest(F.sqrt(F.col(norm_sq) / F.col(parameters)), F.lit(1e-12))
    own = own.withColumn("raw_scale", F.when(none, 1.0).otherwise(raw))
    clamped = F.least(F.lit(most), F.greatest(F.lit(floor), F.col("raw_scale")))
    idle = (F.col("_q") <= 0) | (F.col("_p") <= 0)
    return own.withColumn("scale", F.when(idle, 1.0).otherwise(1.0 + blend * (clamped - 1.0))).drop("_q", "_p")


def scale_summary(scaled: DataFrame, run: str) -> DataFrame:
    """Per run the least, mean and largest raw and applied scale."""
    ends = [f(c).alias(f"{name}_{what}") for c, name in (("raw_scale", "raw"), ("scale", "applied")) for f, what in ((F.min, "min"), (F.avg, "mean"), (F.max, "max"))]
    return scaled.groupBy(run).agg(*ends)


def norm_summary(df: DataFrame, run: str, norm: str) -> DataFrame:
    """Per run the mean and the largest norm, 0 where there is none."""
    return df.groupBy(run).agg(F.coalesce(F.avg(norm), F.lit(0.0)).alias("mean"), F.coalesce(F.max(norm), F.lit(0.0)).alias("max"))


def audit_summary(issues: DataFrame, steps: DataFrame, step: str) -> DataFrame:
    """One row: issues by severity (error, warning), least and greatest step; steps that differ are one more warning."""
    n = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    ends = steps.agg(F.min(step).alias("step_min"), F.max(step).alias("step_max"))
    row = n.crossJoin(F.broadcast(ends)).withColumn("uniform", F.coalesce(F.col("step_min") == F.col("step_max"), F.lit(True)))
    row = row.withColumn("warnings", F.col("warnings") + F.when(F.col("uniform"), 0).otherwise(1))
    return row.withColumn("issue_count", F.col("errors") + F.col("warnings"))


def repaired(states: DataFrame, per_step: float) -> DataFrame:
    """States (global_step, optimizer_step, tokens_seen; step_min and step_max of their shards) brought up to their shards' step.

    ``status``: ok, repaired (tokens are extrapolated at the state's own rate, or ``per_step``), inconsistent (shards at different steps: left as it is).
    """
    old = F.coalesce("tokens_seen", F.lit(0))
    at = F.coalesce("global_step", F.lit(0))
    status = F.when(F.col("step_min") != F.col("step_max"), "inconsistent").when(F.coalesce(F.col("step_max") > at, F.lit(False)), "repaired").otherwise("ok")
    rate = F.when((at > 0) & (old > 0), old / F.greatest(at, F.lit(1))).otherwise(F.lit(float(per_step)))
    lag = F.col("status") == "repaired"
    own = states.withColumn("status", status).withColumn("_tokens", F.greatest(old, F.bround(rate * F.col("step_max")).cast("long")))
    own = own.withColumns({"global_step": F.when(lag, F.col("step_max")).otherwise(F.col("global_step")), "optimizer_step": F.when(lag, F.greatest(F.coalesce("optimizer_step", F.lit(0)), F.col("step_max"))).otherwise(F.col("optimizer_step")), "tokens_seen": F.when(lag, F.col("_tokens")).otherwise(F.col("tokens_seen"))})
    return own.drop("_tokens")


def parameter_totals(df: DataFrame, shard: str, numel: str) -> DataFrame:
    """Parameters per shard and, with a null shard, in all."""
    return df.rollup(shard).agg(F.count("*").alias("tensors"), F.sum(numel).alias("parameters"))


def activity(df: DataFrame, run: str, order: str, active: str) -> DataFrame:
    """Adds ``most_active``: the largest number of active shards that the run has shown so far."""
    return df.withColumn("most_active", F.max(active).over(Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def prefetch_window(mode, wanted, resident):
    """Shards to fetch ahead: none when off, else what is wanted (0: as many as may be resident), as many as may be resident at most."""
    return F.when(mode == "off", 0).otherwise(F.greatest(F.lit(0), F.least(F.when(wanted > 0, wanted).otherwise(resident), resident)))


def residency(df: DataFrame) -> DataFrame:
    """Adds ``violation``: too_many_params, too_many_optimizers, full_model (all of a model that has more than its largest shard), null if none.

    Columns: params, optimizers (active shards), resident (allowed), active_parameters, total_parameters, largest_parameters.
    """
    full = (F.col("total_parameters") > 0) & (F.col("active_parameters") >= F.col("total_parameters")) & (F.col("total_parameters") > F.col("largest_parameters"))
    return df.withColumn("violation", F.when(F.col("params") > F.col("resident"), "too_many_params").when(F.col("optimizers") > F.col("resident"), "too_many_optimizers").when(full, "full_model"))


def rebuild(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks (key, chunk_index, chunks, values) joined in order; a key with a chunk missing or twice is an error."""
    g = chunks.groupBy(key).agg(F.max("chunks").alias("due"), F.count("*").alias("n"), F.count_distinct("chunk_index").alias("own"), F.sort_array(F.collect_list(F.struct("chunk_index", "values"))).alias("c"))
    ok = F.assert_true((F.col("n") == F.col("due")) & (F.col("own") == F.col("due")), F.lit("chunks are missing or repeated"))
    return g.withColumn("_ok", ok).filter(F.col("_ok").isNull()).select(key, F.flatten(F.transform("c", lambda x: x["values"])).alias("values"))

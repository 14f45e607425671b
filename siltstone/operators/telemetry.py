"""Training-log analytics: flattening, moving statistics, summaries, top tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.numbers import finite, perplexity, whole
from siltstone.operators import control, running

#: The names and types of a log line's fields.
_NUM = "train_loss double, loss double, lr double, learning_rate double, base_lr double, tokens_per_sec double, step_seconds double, data_load_seconds double, forward_compute_seconds double, shard_update_seconds double, backward_update_seconds double, commit_seconds double, global_grad_norm double, global_grad_clip_scale double, val_loss double, val_perplexity double, validation_batches double"
LOG = (
    f"step long, {_NUM}, active_shard string, timing_breakdown map<string,double>, grad_norm string, "
    "guarded_step_replay struct<active:boolean,accepted:boolean,attempts:long,max_attempts:long,loss_before:double,accepted_loss_after:double,attempt_log:array<struct<accepted:boolean>>>, "
    "memory struct<allocated_mb:double,reserved_mb:double,peak_allocated_mb:double>"
)


def parse(lines: DataFrame) -> DataFrame:
    """Log lines (i, line) to typed rows with ``kind``: train, validation, other or malformed; blank lines go."""
    own = lines.filter(F.trim("line") != "").withColumn("valid", F.try_parse_json("line").isNotNull()).withColumn("e", F.from_json("line", LOG))
    has = lambda n: F.get_json_object("line", f"$.{n}").isNotNull()
    kind = F.when(~F.col("valid"), "malformed").when(has("train_loss") | has("loss"), "train").when(has("val_loss"), "validation").otherwise("other")
    return own.withColumn("kind", kind)


def train_rows(parsed: DataFrame) -> DataFrame:
    """Flat train rows; both spellings of rate and gradient norm are read."""
    e = lambda n: F.col(f"e.{n}")
    timing = lambda n: F.coalesce(e(n), F.element_at("e.timing_breakdown", n))
    g, norm = "guarded_step_replay", F.col("e.grad_norm")
    rejected = F.coalesce(F.size(F.filter(e(f"{g}.attempt_log"), lambda a: ~F.coalesce(a["accepted"], F.lit(False)))), F.lit(0))
    rows = parsed.filter("kind = 'train'").select(
        "i", e("step").alias("step"), finite(F.coalesce(e("train_loss"), e("loss"))).alias("loss"), F.coalesce(e("lr"), e("learning_rate")).alias("lr"), finite(e("tokens_per_sec")).alias("tokens_per_sec"), finite(e("step_seconds")).alias("step_seconds"),
        *(timing(n).alias(n) for n in ("data_load_seconds", "forward_compute_seconds", "shard_update_seconds", "backward_update_seconds", "commit_seconds")),
        F.get_json_object(norm, "$.mean").try_cast("double").alias("grad_mean"), F.get_json_object(norm, "$.max").try_cast("double").alias("grad_max"),
        F.coalesce(e(f"{g}.active"), F.lit(False)).alias("guard_active"), e(f"{g}.accepted").alias("guard_accepted"), rejected.alias("guard_rejected"), (e(f"{g}.accepted_loss_after") - e(f"{g}.loss_before")).alias("guard_delta"), e("memory.allocated_mb").alias("allocated_mb"), F.col("e.active_shard").isNotNull().alias("is_shard_row"),
    )
    return rows.withColumn("tokens", F.col("tokens_per_sec") * F.col("step_seconds"))


def validation_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'validation'").select("i", F.col("e.step").alias("step"), finite(F.col("e.val_loss")).alias("val_loss"), finite(F.col("e.val_perplexity")).alias("val_perplexity"), whole(F.col("e.validation_batches")).alias("batches"))


#: The columns of an exported window, in order, and where a log line has those that it names otherwise.
EXPORTED = (
    "i", "step", "train_loss", "train_loss_ema", "train_loss_delta", "lr", "base_lr", "tokens_per_sec", "step_seconds", "global_grad_norm", "global_grad_clip_scale", "grad_mean", "grad_max", "guard_attempts", "guard_lr_scale", "guard_grad_norm_scale",
    "guard_loss_before", "guard_loss_after", "forward_trace_seconds", "shard_update_seconds", "backward_update_seconds", "module_build_seconds", "h2d_seconds", "memory_reserved_mb",
)
PATHS = {
    "grad_mean": "grad_norm.mean", "grad_max": "grad_norm.max", "guard_attempts": "guarded_step_replay.attempts", "guard_lr_scale": "guarded_step_replay.accepted_lr_scale", "guard_grad_norm_scale": "guarded_step_replay.accepted_grad_norm_scale",
    "guard_loss_before": "guarded_step_replay.loss_before", "guard_loss_after": "guarded_step_replay.accepted_loss_after", "memory_reserved_mb": "memory.reserved_mb",
}


def metrics(parsed: DataFrame) -> DataFrame:
    """Train rows with the columns of ``EXPORTED``; a log is one run, over as many tasks as it has ranges."""
    at = lambda path: finite(F.get_json_object("line", f"$.{path}"))
    plain = [c for c in EXPORTED[3:] if not c.startswith("train_loss_")]
    rows = parsed.filter("kind = 'train'").select(F.lit(0).alias("_run"), "i", F.col("e.step").alias("step"), F.coalesce(at("train_loss"), at("loss")).alias("train_loss"), *(F.coalesce(at(PATHS.get(c, c)), *([at(f"timing_breakdown.{c}")] if c.endswith("_seconds") else [])).alias(c) for c in plain))
    moved = ema(derived(rows, "_run", "i", "train_loss", "tokens_per_sec"), "_run", "i", "train_loss")
    return moved.select(*(F.col({"train_loss_ema": "ema", "train_loss_delta": "delta"}.get(c, c)).alias(c) for c in EXPORTED))


def ema(df: DataFrame, run: str, order: str, value: str, alpha: float = 0.08) -> DataFrame:
    """Adds ``ema`` per run: the first value seeds it, a null carries it on."""
    return running.ema(df, run, order, value, alpha)


def rolling_std(df: DataFrame, run: str, order: str, value: str, window: int = 25) -> DataFrame:
    """Adds the population deviation of the last ``window`` non-null values; null below two of them."""
    return running.deviation(df, run, order, value, window)


def derived(df: DataFrame, run: str, order: str, loss: str, tokens: str) -> DataFrame:
    """Adds delta to the last non-null loss, and the running sum of tokens."""
    own = running.scanned(df, [run], [order], sums={"cumulative": F.coalesce(tokens, F.lit(0.0))}, prior={"_before": F.col(loss)})
    return own.withColumn("delta", F.col(loss) - F.col("_before")).drop("_before")


def repeated_steps(df: DataFrame, run: str, step: str, order: str) -> DataFrame:
    return df.withColumn("repeated", F.row_number().over(Window.partitionBy(run, step).orderBy(order)) > 1)


def summary(df: DataFrame, order: str, step: str, loss: str, tokens: str) -> DataFrame:
    """One row: first and latest, best (a loss of 0 counts as none), median and total tokens, repeated steps. The median is found by rank in ordered ranges."""
    best = F.min_by(F.struct(F.col(step).alias("s"), F.col(loss).alias("l")), F.when((F.col(loss) != 0), F.struct(F.col(loss), F.col(order))))
    row = df.agg(
        F.count("*").alias("n_rows"), F.min_by(step, order).alias("first_step"), F.max_by(step, order).alias("latest_step"), F.max_by(loss, F.when(F.col(loss).isNotNull(), F.col(order))).alias("latest_loss"),
        best["l"].alias("best_loss"), best["s"].alias("best_step"), F.sum(tokens).alias("total_tokens"), (F.count(step) - F.count_distinct(step)).alias("repeated_steps"),
    )
    middle = control.quantiles(df.select(F.col(tokens).alias("_v"), F.col(order).alias("_o")), "_v", ["_o"], []).select(F.col("p50").alias("median_tokens"))
    return row.crossJoin(F.broadcast(middle))  # a row each


def kpis(df: DataFrame, order: str, step: str, loss: str, norm: str, clip: str, rate: str, seconds: str, attempts: str, rejected: str) -> DataFrame:
    """One row of key figures: latest and best loss (the first of equals) with their steps, means, and the share of updates that were replayed."""
    at = F.struct("_s", "_l")
    own = df.withColumns({"_s": F.col(step), "_l": F.col(loss)})
    replayed = (F.coalesce(attempts, F.lit(0)) > 1) | (F.coalesce(rejected, F.lit(0)) > 0)
    best = F.min_by(at, F.when(F.col(loss).isNotNull(), F.struct(loss, order)))
    row = own.agg(F.max_by(at, order).alias("last"), best.alias("best"), F.avg(norm).alias("avg_grad_norm"), F.avg(clip).alias("avg_clip"), F.avg(rate).alias("avg_tokens_per_sec"), F.avg(seconds).alias("avg_step_seconds"), F.count_if(replayed).alias("replayed"), F.count("*").alias("_n"))
    return row.select(F.col("last._s").alias("latest_step"), F.col("last._l").alias("latest_loss"), F.col("best._s").alias("best_step"), F.col("best._l").alias("best_loss"), "avg_grad_norm", "avg_clip", "avg_tokens_per_sec", "avg_step_seconds", "replayed", (100.0 * F.col("replayed") / F.greatest(F.lit(1), F.col("_n"))).alias("replay_percent"))


def slowest(df: DataFrame, seconds: str, order: str, most: int = 40) -> DataFrame:
    """The slowest updates; the earlier of equals first."""
    return df.filter(F.col(seconds).isNotNull()).orderBy(F.desc(seconds), order).limit(most)


def validation_table(df: DataFrame, step: str, order: str) -> DataFrame:
    return df.orderBy(step, order)


def validation_mean(losses: DataFrame, loss: str, order: str, most: int | None = None) -> DataFrame:
    """Mean loss of the first batches, its perplexity and their number; without a batch the row's figures are null."""
    own = losses.filter(F.col(loss).isNotNull())
    row = (own.orderBy(order).limit(most) if most is not None else own).agg(F.avg(loss).alias("val_loss"), F.count("*").alias("validation_batches"))
    return row.select("val_loss", perplexity(F.col("val_loss")).alias("val_perplexity"), "validation_batches")


def composition(df: DataFrame, fields: list[str]) -> DataFrame:
    """Mean of each timing field over its positive values, and its share of the means' sum."""
    rows = df.select(*fields).unpivot([], fields, "field", "seconds").filter("seconds > 0").groupBy("field").agg(F.avg("seconds").alias("mean_seconds"))
    return rows.withColumn("share", F.col("mean_seconds") / F.sum("mean_seconds").over(Window.partitionBy(F.lit(0))))


def visible(df: DataFrame, order: str, start: int, size: int) -> DataFrame:
    """Rows ``start`` to ``start + size`` (from 0) in order: a limit each way, no numbering of all rows."""
    return df.orderBy(order).offset(start).limit(size)


def in_range_of(validation: DataFrame, train: DataFrame, order: str) -> DataFrame:
    """Validation rows within the train rows' range of ``order``."""
    ends = train.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    return validation.join(F.broadcast(ends), (F.col(order) >= F.col("lo")) & (F.col(order) <= F.col("hi"))).drop("lo", "hi")

"""Reports of the stages as Markdown, and of a run's telemetry as a page. Each gathers summaries of few rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import telemetry
from siltstone.sources import sinks


def facts(title: str, values: dict) -> str:
    """A heading and a line per value."""
    return "\n".join([f"# {title}", "", *(f"- {k.replace('_', ' ')}: {v}" for k, v in values.items()), ""])


def profile(rows: DataFrame, title: str = "Profile") -> str:
    """Of the rows that ``profile.whole`` gives: a list of counts, then a table a section."""
    by: dict[str, list] = {}
    for r in rows.collect():  # counters, quantiles and top values: some hundred rows
        by.setdefault(r["section"], []).append((r["name"], r["value"]))
    whole = lambda v: int(v) if v is not None and float(v).is_integer() else v
    out = [facts(title, {k: whole(v) for k, v in by.pop("counts", [])})]
    for section, values in by.items():
        out += [f"## {section.replace('_', ' ')}", "", "| name | value |", "| --- | --- |", *(f"| {k} | {whole(v)} |" for k, v in values), ""]
    return "\n".join(out)


def normalization(counters: DataFrame) -> str:
    """Of ``normalize.stage_counters``: documents seen, what is written, and what each rule took."""
    n = {r["reason"]: r["n"] for r in counters.collect()}
    first = {k: n.pop(k, 0) for k in ("seen", "written", "oversized_docs_chunked", "chunks_created")}
    return facts("Normalization", {**first, **dict(sorted(n.items()))})


def deduplication(counters: DataFrame, decided: DataFrame | None = None, position: str = "doc_id", examples: int = 20) -> str:
    """Of ``dedup.counters``, with the first removed rows as examples."""
    out = facts("Deduplication", counters.first().asDict())
    if decided is None:
        return out
    gone = decided.filter("decision <> 'kept'").select(position, "decision").orderBy(position).limit(examples)
    return out + "\n" + sinks.markdown("Examples", gone, None)


def tokenization(manifest: dict) -> str:
    """Of ``tokenize.job``: totals, then each split's counters and shards."""
    out = [facts("Tokenization", {k: v for k, v in manifest.items() if k != "splits"})]
    for split, made in manifest["splits"].items():
        out += [facts(split, made["stats"]), "| shard | blocks | tokens |", "| --- | --- | --- |", *(f"| {s['shard']} | {s['blocks']} | {s['tokens']} |" for s in made["shards"]), ""]
    return "\n".join(out)


def dashboard(parsed: DataFrame, title: str = "Training run", spike: float = 4.0) -> str:
    """A page of a log that ``telemetry.parse`` read: key figures, timing shares, spikes, slowest updates, replays, validation."""
    rows = telemetry.metrics(parsed).withColumn("rejected", F.lit(0))
    flat = telemetry.train_rows(parsed).select("i", "guard_rejected")
    rows = rows.drop("rejected").join(flat, "i", "left")
    figures = telemetry.kpis(rows, "i", "step", "train_loss", "global_grad_norm", "global_grad_clip_scale", "tokens_per_sec", "step_seconds", "guard_attempts", "guard_rejected")
    timings = [c for c in telemetry.EXPORTED if c.endswith("_seconds") and c != "step_seconds"]
    odd = (F.coalesce("guard_attempts", F.lit(0)) > 1) | (F.coalesce("guard_rejected", F.lit(0)) > 0) | (F.coalesce("guard_lr_scale", F.lit(1.0)) != 1) | (F.coalesce("guard_grad_norm_scale", F.lit(1.0)) != 1)
    return sinks.html(title, {
        "Key figures": figures, "Timing": telemetry.composition(rows, timings).orderBy(F.desc("share")),
        "Spikes": rows.filter(F.col("train_loss") >= spike).orderBy(F.desc("train_loss"), "i").limit(40).select("step", "train_loss", "train_loss_delta", "global_grad_norm", "global_grad_clip_scale", "guard_loss_after"),
        "Slowest updates": telemetry.slowest(rows, "step_seconds", "i").select("step", "step_seconds", "tokens_per_sec", "forward_trace_seconds", "shard_update_seconds", "module_build_seconds", "h2d_seconds"),
        "Replays": rows.filter(odd).orderBy(F.desc("i")).limit(80).select("step", "guard_attempts", "guard_rejected", "guard_lr_scale", "guard_grad_norm_scale", "guard_loss_before", "guard_loss_after"),
        "Validation": telemetry.validation_table(telemetry.validation_rows(parsed), "step", "i").select("step", "val_loss", "val_perplexity", "batches"),
    })

"""Structured Streaming: file streams, packing with a remainder in state, a token-bucket limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.functions import text as X

#: Blocks that a task hands out at once.
AT_ONCE = 4096


def files(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Parquet files as they come, oldest first; the checkpoint resumes at the file where a run stopped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("latestFirst", False).parquet(path)


def json_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path).withColumnRenamed("value", "line")


def packed(tokens: DataFrame, key: str, order: str, length: int, overlap: bool = True) -> DataFrame:
    """Token arrays (key, order, tokens) to blocks of length + 1 per key; what doesn't fill one waits in state."""
    step = length if overlap else length + 1

    def update(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        held, number = state.get if state.exists else ([], 0)
        rows = pd.concat(pdfs).sort_values(order)["tokens"]
        flat = np.concatenate([np.asarray(held, np.int32), *(np.asarray(t, np.int32) for t in rows if t is not None)])
        n = max(0, (len(flat) - length - 1) // step + 1)
        state.update((flat[n * step :].tolist(), number + n))
        for low in range(0, n, AT_ONCE):
            high = min(n, low + AT_ONCE)
            yield pd.DataFrame({key: k[0], "block": range(number + low, number + high), "tokens": [flat[i * step : i * step + length + 1] for i in range(low, high)]})
        if not n:
            yield pd.DataFrame([], columns=[key, "block", "tokens"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, block long, tokens array<int>", "held array<int>, number long", "append", GroupStateTimeout.NoTimeout)


def limited(events: DataFrame, key: str, ts: str, per_minute: int) -> DataFrame:
    """Adds ``allowed``: a bucket per key of ``per_minute`` tokens, refilled evenly, one token an event, in time order."""

    def update(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (float(per_minute), None)
        for pdf in [pd.concat(pdfs).sort_values([ts, "event_id"])]:
            out = []
            for at in pdf[ts].astype("int64") / 1e6 if pdf[ts].dtype == "datetime64[us]" else pdf[ts].astype("datetime64[us]").astype("int64") / 1e6:
                level = level if last is None else min(float(per_minute), level + (at - last) * per_minute / 60)
                last = at
                out.append(level >= 1)
                level -= level >= 1
            state.update((level, last))
            yield pd.DataFrame({key: k[0], "event_id": pdf["event_id"], "allowed": out})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, event_id long, allowed boolean", "level double, last double", "append", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, written as Parquet; then read."""
    df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(path).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def windowed(events: DataFrame, ts: str, key: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling-window counts and sums under a watermark; an extension."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def web_tokens(docs: DataFrame, tokenizer_json: str, key: str, order: str, length: int, text: str = "text", least: int = 200) -> DataFrame:
    """A stream of raw web texts, normalised, filtered and tokenised, to overlapping blocks; the checkpoint holds the files that are done and the tokens left over, so a run goes on where the last one stopped."""
    from siltstone.operators import tokenize

    clean = docs.withColumn(text, X.normalize_web(F.col(text))).filter(X.keep_text(F.col(text), least))
    ids = clean.select(key, order, tokenize.encoder(docs.sparkSession, tokenizer_json)(F.col(text)).alias("tokens")).filter(F.size("tokens") >= 2)
    return packed(ids, key, order, length)


def indexed(events: DataFrame) -> DataFrame:
    """A stream of inserts (with kv_ref) and lookups (without) of prefixes to the lookups' answers; state per tenant, model and prefix: its last reference, hits, last use.

    Events: tenant_id, model_id, prefix_hash, seq, kv_ref. An insert replaces the reference and keeps the hits.
    """

    def update(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ref, hits, used = state.get if state.exists else (None, 0, 0)
        out = []
        for seq, new in pd.concat(pdfs).sort_values("seq")[["seq", "kv_ref"]].itertuples(index=False):
            if new is not None and new == new:
                ref, used = int(new), seq
                continue
            hits, used = (hits + 1, seq) if ref is not None else (hits, used)
            out.append((seq, ref, hits))
        state.update((ref, hits, int(used)))
        yield pd.DataFrame(out, columns=["seq", "kv_ref", "hits"]).astype({"kv_ref": "Int64"})

    keys = ["tenant_id", "model_id", "prefix_hash"]
    return events.groupBy(*keys).applyInPandasWithState(update, "seq long, kv_ref long, hits long", "kv_ref long, hits long, used long", "append", GroupStateTimeout.NoTimeout)


def train_log(spark: SparkSession, path: str) -> DataFrame:
    """Training rows of a log that grows: lines as they come, parsed and flattened as in a batch; lines have no number in a stream."""
    from siltstone.operators import telemetry

    return telemetry.train_rows(telemetry.parse(json_log(spark, path).withColumn("i", F.lit(None).cast("long"))))

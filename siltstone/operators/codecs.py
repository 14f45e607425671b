"""Vectors of a group compressed by tier: recent ones in half precision, hot ones in 8 bits, cold ones rotated and quantised."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import udfs as U
from siltstone.operators import control


def selective(df: DataFrame, group: str, position: str, score: str, vector: str, recent: int, hot_fraction: float, cold_bits: int = 3, residual: float = 0.002, seed: int = 7) -> DataFrame:
    """group, position, tier, payload, n_bytes (with a 4-byte index), error of every vector.

    The hot tier's scale is its group's largest magnitude, from a window; residuals of cold vectors are chosen per
    vector. One Arrow function does all tiers, so no vector is coded twice. A null vector has no payload, an empty one
    an empty payload.
    """

    @F.pandas_udf(T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("error", T.DoubleType())]))
    def run(vectors: pd.Series, tiers: pd.Series, peaks: pd.Series) -> pd.DataFrame:
        rows = []
        for v, tier, peak in zip(vectors, tiers, peaks, strict=True):
            if v is None or not len(v):
                rows.append((None if v is None else b"", 0, 0.0))
                continue
            x = np.asarray(v, np.float32)
            if tier == "recent":
                payload = x.astype("<f2").tobytes()
                back, extra = np.frombuffer(payload, "<f2").astype(np.float32), 4
            elif tier == "hot":
                scale = np.float32(max(float(peak) / U.LARGEST, 1e-8))
                code = U.fp8_encode(x / scale)
                payload, back, extra = code.tobytes(), U.fp8_decode(code) * scale, 4
            else:
                c = U.rotated_encode(x, cold_bits, residual=residual, seed=seed)
                payload, back = c["payload"], U.rotated_decode(c)
                extra = 4 + U.rotated_bytes(c) - len(payload)
            rows.append((payload, len(payload) + extra, float(np.linalg.norm(x - back) / max(np.linalg.norm(x), 1e-12))))
        return pd.DataFrame(rows, columns=["payload", "n_bytes", "error"])

    placed = control.tiers(df.select(group, position, score, vector), group, position, score, recent, hot_fraction)
    size = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    placed = placed.withColumn("_peak", F.coalesce(F.max(size).over(Window.partitionBy(group, "tier")), F.lit(0)).cast("double"))
    coded = placed.select(group, position, "tier", F.size(vector).alias("_n"), run(F.col(vector), F.col("tier"), F.col("_peak")).alias("c"))
    return coded.select(group, position, "tier", "c.payload", "c.n_bytes", "c.error", (F.greatest("_n", F.lit(0)) * 4).cast("long").alias("raw_bytes"))


def ratio(coded: DataFrame, *by: str) -> DataFrame:
    """Raw over compressed bytes; 0 where nothing was compressed."""
    return coded.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum("raw_bytes") / F.nullif(F.sum("n_bytes"), F.lit(0)), F.lit(0.0)).alias("ratio"))

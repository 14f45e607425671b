"""Profiles of text tables: exact quantiles, null counts, quality counters, top values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.functions import text as X
from siltstone.functions import udfs as U
from siltstone.operators import ranks

QUANTILES = (0.01, 0.05, 0.5, 0.95, 0.99)


def numeric(df: DataFrame, value: Column) -> DataFrame:
    """Count, extremes, mean and exact interpolated quantiles, by histograms that narrow."""
    row = ranks.profile(df, value, QUANTILES)
    names = ("lowest", "highest", "mean", *(f"p{int(x * 100):02d}" for x in QUANTILES))
    return df.sparkSession.createDataFrame([row], ", ".join(("n long", *(f"{c} double" for c in names))))


def nulls(df: DataFrame) -> DataFrame:
    """column, n_null: one scan, one row a column."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return one.unpivot([], df.columns, "column", "n_null")


def quality(df: DataFrame, text: Column, short: int = 200) -> DataFrame:
    t = F.coalesce(text, F.lit(""))
    return df.agg(
        F.count("*").alias("n"), F.count_if(t == "").alias("n_empty"), F.count_if(F.length(t) < short).alias("n_short"),
        F.count_if(t.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]")).alias("n_control"), F.count_if(t.contains("�")).alias("n_encoding"), (F.count("*") - F.count_distinct(X.content_hash(t))).alias("n_duplicate"),
    )


def top_values(df: DataFrame, column: str, position: str, n: int = 25) -> DataFrame:
    """The n most frequent values; ties in order of first appearance."""
    g = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(n).select("value", "n")


def whole(df: DataFrame, text: str, position: str, dimensions: tuple[str, ...] = ("language", "license", "collection"), tokens: str | None = None, clean: bool = True) -> DataFrame:
    """A table's profile as rows (section, name, value): rows and quality counters, nulls per column, lengths and words, top values.

    Texts are read once: what is needed of a row (lengths, flags, hash, values of the dimensions) is stored, and all
    sections are aggregates of that narrow table. ``clean``: lengths, hashes and emptiness are of the normalised text.
    """
    t = F.coalesce(U.normalized(F.col(text)) if clean else F.col(text), F.lit(""))
    raw = F.coalesce(F.col(text), F.lit(""))
    there = [c for c in dimensions if c in df.columns]
    own = df.select(
        F.col(position).alias("_p"), F.length(t).alias("_n"), X.word_count(t).alias("_w"), X.content_hash(t).alias("_h"), F.col(text).isNull().alias("_none"), raw.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]").alias("_control"),
        raw.contains("\uFFFD").alias("_encoding"), (F.col(tokens) if tokens else F.lit(None).cast("long")).cast("double").alias("_t"), *(F.col(c).cast("string").alias(f"_d{i}") for i, c in enumerate(there)), *(F.col(c).isNull().alias(f"_null{i}") for i, c in enumerate(df.columns)),
    )
    own = scratch.stored(own, "profile")
    some = ~F.col("_none")
    one = own.agg(
        F.count("*").alias("rows"), F.count_if(F.col("_none") | (F.col("_n") == 0)).alias("empty"), F.count_if(some & (F.col("_n") < 200)).alias("short"), F.count_if("_control").alias("control_chars"), F.count_if("_encoding").alias("encoding_issues"),
        (F.count_if(some) - F.count_distinct(F.when(some, F.col("_h")))).alias("exact_duplicates"), F.count_distinct(F.when(some, F.col("_h"))).alias("unique_texts"), *(F.count_if(f"_null{i}").alias(f"null:{c}") for i, c in enumerate(df.columns)),
    )
    flat = one.unpivot([], one.columns, "name", "value").select(F.when(F.startswith("name", F.lit("null:")), "nulls").otherwise("counts").alias("section"), F.regexp_replace("name", "^null:", "").alias("name"), F.col("value").cast("double").alias("value"))
    out = [flat]
    for section, column in (("char_length", "_n"), ("word_count", "_w"), *((("token_count", "_t"),) if tokens else ())):
        stats = numeric(own.filter(some), F.col(column)).withColumn("n", F.col("n").cast("double"))
        out.append(stats.unpivot([], stats.columns, "name", "value").select(F.lit(section).alias("section"), "name", "value"))
    out += [top_values(own.filter(some), f"_d{i}", "_p").select(F.lit(f"{c}_top").alias("section"), F.col("value").alias("name"), F.col("n").cast("double").alias("value")) for i, c in enumerate(there)]
    first, *rest = out
    for x in rest:
        first = first.unionByName(x)
    return first

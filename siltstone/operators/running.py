"""Running values of ordered runs by two-level scans: a run may span any number of tasks.

Rows are dealt to ranges of (run, order) and stored with their range's number. A window runs inside a range; a row per
range and run carries what came before, and a window over those rows (as many as there are ranges) gives each its base.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import scratch


def placed(df: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """The rows with ``_part``, the number of their range; stored, as a range read twice can differ."""
    return scratch.stored(df.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id()), "runs")


def same(a: str, b: str, names: list[str]) -> Column:
    on = F.col(f"{a}._part") == F.col(f"{b}._part")
    for n in names:
        on = on & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return on


def scanned(df: DataFrame, within: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, prior: dict[str, Column] | None = None) -> DataFrame:
    """Adds per run, in order: sums up to each row, the last value that isn't null up to it (``lasts``) and before it (``prior``)."""
    sums, held, prior = sums or {}, {**(lasts or {}), **(prior or {})}, prior or {}
    own = placed(df.withColumns({f"_in_{k}": v for k, v in {**sums, **held}.items()}), within, order)
    inside = Window.partitionBy("_part", *within).orderBy(*order)
    here, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    ends = own.groupBy("_part", *within).agg(*(F.sum(f"_in_{k}").alias(f"_end_{k}") for k in sums), *(F.max_by(F.col(f"_in_{k}"), F.when(F.col(f"_in_{k}").isNotNull(), at)).alias(f"_end_{k}") for k in held))
    bases = ends.select("_part", *within, *(F.sum(f"_end_{k}").over(ahead).alias(f"_base_{k}") for k in sums), *(F.last(f"_end_{k}", ignorenulls=True).over(ahead).alias(f"_base_{k}") for k in held))
    local = own.withColumns({f"_here_{k}": F.sum(f"_in_{k}").over(here) for k in sums} | {f"_here_{k}": F.last(f"_in_{k}", ignorenulls=True).over(before if k in prior else here) for k in held})
    both = local.alias("l").join(bases.alias("r"), same("l", "r", within))
    totals = [F.when(F.col(f"_base_{k}").isNull(), F.col(f"_here_{k}")).otherwise(F.col(f"_base_{k}") + F.coalesce(f"_here_{k}", F.col(f"_base_{k}") * 0)).alias(k) for k in sums]
    return both.select(*(F.col(f"l.{c}") for c in df.columns), *totals, *(F.coalesce(f"_here_{k}", f"_base_{k}").alias(k) for k in held))


def ema(df: DataFrame, run: str, order: str, value: str, alpha: float) -> DataFrame:
    """Adds ``ema`` per run: the first value seeds it, a null carries it on.

    A stretch of a run is the map s -> a s + b, or its own seeded value where nothing came before; maps of a run's
    ranges are composed in order, and each range is folded once from what it is given. Only runs over several ranges
    have maps, two a range at most, so they are broadcast.
    """
    own = placed(df, [run], [order])
    keys = ["_part", run]
    per = own.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_parts", F.count("*").over(Window.partitionBy(run))).filter("_parts > 1").select(*keys)
    spanning = scratch.stored(per, "spanning-runs")
    kind = df.schema[run].dataType

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, key, a, b, seed = [], None, 1.0, 0.0, None
        for pdf in batches:
            for k, v in zip(zip(pdf["_part"], pdf[run], strict=True), pdf[value], strict=True):
                if k != key:
                    if key is not None:
                        out.append((*key, a, b, seed))
                    key, a, b, seed = k, 1.0, 0.0, None
                if v is not None and v == v:
                    a, b, seed = a * (1 - alpha), alpha * v + (1 - alpha) * b, v if seed is None else alpha * v + (1 - alpha) * seed
        if key is not None:
            out.append((*key, a, b, seed))
        yield pd.DataFrame(out, columns=["_part", run, "a", "b", "seed"])

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        out, s = [], None
        for r in pdf.sort_values("_part").itertuples(index=False):
            out.append(s)
            s = r.a * s + r.b if s is not None else None if pd.isna(r.seed) else r.seed
        return pdf.sort_values("_part").assign(_before=pd.Series(out, dtype="float64").to_numpy())[["_part", run, "_before"]]

    maps = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField(run, kind), *(T.StructField(c, T.DoubleType()) for c in ("a", "b", "seed"))])
    some = own.alias("l").join(F.broadcast(spanning).alias("r"), same("l", "r", [run]), "left_semi").select("_part", run, order, F.col(value).cast("double").alias(value))
    stretches = some.repartition("_part").sortWithinPartitions(*keys, order).select("_part", run, value).mapInPandas(ends, maps)
    given = stretches.groupBy(run).applyInPandas(composed, T.StructType([maps[0], maps[1], T.StructField("_before", T.DoubleType())]))
    rows = own.alias("l").join(F.broadcast(given).alias("r"), same("l", "r", [run]), "left").select("l.*", "_before")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, s = None, None
        for pdf in batches:
            out = []
            for k, v, before in zip(zip(pdf["_part"], pdf[run], strict=True), pdf[value], pdf["_before"], strict=True):
                if k != key:
                    key, s = k, None if pd.isna(before) else before
                if v is not None and v == v:
                    s = v if s is None else alpha * v + (1 - alpha) * s
                out.append(s)
            yield pdf.drop(columns=["_part", "_before"]).assign(ema=pd.Series(out, dtype="float64", index=pdf.index))

    schema = T.StructType([*df.schema.fields, T.StructField("ema", T.DoubleType())])
    return rows.repartition("_part").sortWithinPartitions(*keys, order).mapInPandas(fold, schema)


def deviation(df: DataFrame, run: str, order: str, value: str, window: int, block: int = 1 << 14) -> DataFrame:
    """Adds ``rolling_std``: the population deviation of the last ``window`` non-null values; null below two of them.

    Non-null values have a number in their run; blocks of numbers are windowed apart, each with a halo of the values
    just before it. A null row has the deviation of the value before it.
    """
    numbered = scratch.stored(scanned(df, [run], [order], sums={"_seen": F.when(F.col(value).isNotNull(), 1).otherwise(0)}), "numbered")
    some = numbered.filter(F.col(value).isNotNull()).select(run, "_seen", F.col(value).alias("_v"))
    home = F.floor(F.col("_seen") / block)
    with_halo = some.withColumn("_block", F.explode(F.when(F.col("_seen") % block > block - window, F.array(home, home + 1)).otherwise(F.array(home))))
    last = Window.partitionBy(run, "_block").orderBy("_seen").rangeBetween(-(window - 1), 0)
    told = with_halo.withColumn("rolling_std", F.when(F.count("_v").over(last) >= 2, F.stddev_pop("_v").over(last))).filter(F.col("_block") == home).select(F.col(run).alias("_run"), F.col("_seen").alias("_at"), "rolling_std")
    return numbered.join(told, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_seen") == F.col("_at")), "left").select(*df.columns, "rolling_std")


def next_fit(df: DataFrame, run: str, order: str, size: str, most: int) -> DataFrame:
    """Adds ``file``: items in order go to a run's open file; one that doesn't fit opens the next (a file that holds nothing yet takes any).

    A file that begins at an item ends where the sizes from there exceed ``most`` (and something is held): a search of
    prefix sums, for all items at once by a sorted sweep, gives each item the beginning of the next file if it began
    one. Files' beginnings are what the first item reaches; doubling the pointers finds them in as many rounds as the
    number of files has binary digits. Null sizes count as 0, negative ones are an error.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    own = scanned(df.withColumn("_n", F.when(n < 0, F.raise_error("negative size")).otherwise(n)), [run], [order], sums={"_end": F.col("_n"), "_i": F.lit(1).cast("long")})
    own = scratch.stored(own, "fit-items")
    items = own.select(run, (F.col("_end") - F.col("_n")).alias("_start"), "_end", F.col("_i").alias("_i"))
    # Swept downwards: the last end seen is the smallest above a query, the smallest item of equal ends; queries come before ends that equal them.
    ends = items.select(run, F.col("_end").alias("_x"), F.lit(1).alias("_is_end"), "_i", F.lit(None).cast("int").alias("_q"))
    asks = items.select(run, "_start", "_i").withColumn("_q", F.explode(F.array(F.lit(0), F.lit(1)))).select(run, (F.col("_start") + F.col("_q") * most).alias("_x"), F.lit(0).alias("_is_end"), "_i", "_q")
    swept = ends.unionByName(asks).withColumns({"_down": -F.col("_x"), "_late": -F.col("_i")})
    found = scanned(swept, [run], ["_down", "_is_end", "_late", "_q"], lasts={"_over": F.when(F.col("_is_end") == 1, F.col("_i"))}).filter("_is_end = 0")
    jump = found.groupBy(run, "_i").agg(F.greatest(F.max(F.when(F.col("_q") == 0, F.col("_over"))) + 1, F.max(F.when(F.col("_q") == 1, F.col("_over")))).alias("_next"), F.count("_over").alias("_both"))
    jump = scratch.stored(jump.filter("_both = 2").select(run, "_i", "_next"), "fit-jumps")
    starts = scratch.stored(own.filter("_i = 1").select(run, "_i"), "fit-starts")
    while True:
        step = F.col("s._i") == F.col("j._i")
        more = starts.alias("s").join(jump.alias("j"), F.col(f"s.{run}").eqNullSafe(F.col(f"j.{run}")) & step).select(F.col(f"s.{run}").alias(run), F.col("j._next").alias("_i"))
        more = scratch.stored(more, "fit-more")
        if not more.limit(1).count():
            break
        starts = scratch.stored(starts.unionByName(more), "fit-starts")
        doubled = jump.alias("a").join(jump.alias("b"), F.col(f"a.{run}").eqNullSafe(F.col(f"b.{run}")) & (F.col("a._next") == F.col("b._i"))).select(F.col(f"a.{run}").alias(run), F.col("a._i").alias("_i"), F.col("b._next").alias("_next"))
        jump = scratch.stored(doubled, "fit-jumps")
    marks = starts.select(F.col(run).alias("_run"), F.col("_i").alias("_at"))
    marked = own.join(marks, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_i") == F.col("_at")), "left").withColumn("_opens", F.col("_at").isNotNull().cast("long"))
    return scanned(marked.select(*df.columns, "_opens"), [run], [order], sums={"file": F.col("_opens")}).withColumn("file", F.col("file") - 1).select(*df.columns, "file")


def holder(bounds: DataFrame, start: str, points: DataFrame, at: str) -> DataFrame:
    """Each distinct point with the columns of the last bound at or before it: a sorted sweep over both. Bounds are distinct in ``start``."""
    kept = [c for c in bounds.columns if c != at]
    told = bounds.select(F.col(start).alias("_x"), F.lit(0).alias("_kind"), F.struct(*kept).alias("_b"))
    asked = points.select(F.col(at).alias("_x")).distinct().select("_x", F.lit(1).alias("_kind"), F.lit(None).cast(told.schema["_b"].dataType).alias("_b"))
    swept = scanned(told.unionByName(asked), [], ["_x", "_kind"], lasts={"_held": F.col("_b")})
    return swept.filter("_kind = 1 and _held is not null").select(F.col("_x").alias(at), "_held.*")

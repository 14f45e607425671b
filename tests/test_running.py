"""Two-level scans against plain folds: a run over many ranges, nulls, ties, skew; exact ranks; sweeps without nested loops."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from siltstone.operators import catalog, packing, ranks, running, telemetry


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables would become one range."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def runs(rng, sizes, nulls=0.2):
    """(run, order, value): runs of the given sizes, the first with most rows; run None is a run too."""
    names = [None if i == 1 else f"r{i}" for i in range(len(sizes))]
    return [(name, i, None if rng.random() < nulls else rng.choice([rng.uniform(-5, 5), float("nan")]) if rng.random() < 0.05 else rng.uniform(-5, 5)) for name, n in zip(names, sizes, strict=True) for i in range(n)]


def by_run(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def close(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_ema_over_ranges(spark):
    rows = runs(random.Random(1), [6000, 40, 1, 0, 300]) + [("leading", i, None if i < 900 else 1.0 + i) for i in range(1000)]
    df = spark.createDataFrame(rows, "run string, i long, v double").repartition(5)
    assert running.placed(df, ["run"], ["i"]).filter("run = 'r0'").select("_part").distinct().count() > 4
    got = {(r["run"], r["i"]): r["ema"] for r in telemetry.ema(df, "run", "i", "v", 0.3).collect()}
    assert len(got) == len(rows)
    for own in by_run(rows).values():
        s = None
        for run, i, v in own:
            if v is not None and v == v:
                s = v if s is None else 0.3 * v + 0.7 * s
            assert close(got[run, i], s), (run, i)


@pytest.mark.parametrize("block", [1 << 14, 50])
def test_deviation_over_blocks(spark, block):
    rows = [r for r in runs(random.Random(2), [3000, 60, 2]) if r[2] is None or r[2] == r[2]]
    df = spark.createDataFrame(rows, "run string, i long, v double").repartition(5)
    got = {(r["run"], r["i"]): r["rolling_std"] for r in running.deviation(df, "run", "i", "v", 25, block).collect()}
    assert len(got) == len(rows)
    for own in by_run(rows).values():
        held = []
        for run, i, v in own:
            held = (held + [v])[-25:] if v is not None else held
            assert close(got[run, i], statistics.pstdev(held) if len(held) > 1 else None), (run, i)


def test_scanned(spark):
    rows = runs(random.Random(3), [4000, 30, 5], 0.5)
    df = spark.createDataFrame(rows, "run string, i long, v double").repartition(5)
    got = {(r["run"], r["i"]): r for r in running.scanned(df, ["run"], ["i"], {"n": F.lit(1)}, {"now": F.col("v")}, {"old": F.col("v")}).collect()}
    for own in by_run(rows).values():
        last = None
        for k, (run, i, v) in enumerate(own):
            r = got[run, i]
            before, last = last, v if v is not None else last
            assert r["n"] == k + 1 and (r["old"] == before or before != before) and (r["now"] == last or last != last)
    assert telemetry.derived(df.limit(0).withColumn("t", F.lit(1.0)), "run", "i", "v", "t").count() == 0


def folded(sizes, most):
    file, held, out = 0, 0, []
    for n in sizes:
        if held and held + (n or 0) > most:
            file, held = file + 1, 0
        held += n or 0
        out.append(file)
    return out


@pytest.mark.parametrize("most", [1, 20, 1000])
def test_next_fit_over_ranges(spark, most):
    """Zero and null sizes, items larger than a file, one run over many ranges."""
    rng = random.Random(most)
    sizes = {None: [0, 0, 5, 0], "long": [rng.choice([0, 1, 2, 3, 9, 30, None]) for _ in range(4000)], "zeros": [0] * 50, "large": [most + 5] * 20, "one": [3], "start": [0, 0, most + 9, 1, 0]}
    df = spark.createDataFrame([(k, i, n, "x") for k, own in sizes.items() for i, n in enumerate(own)], "run string, i long, n long, file_note string").repartition(5)
    got = {(r["run"], r["i"]): r["file"] for r in catalog.next_fit(df, "run", "i", "n", most).collect()}
    assert got == {(k, i): f for k, own in sizes.items() for i, f in enumerate(folded(own, most))}
    assert catalog.next_fit(df.limit(0), "run", "i", "n", most).count() == 0


def test_next_fit_rounds(spark, monkeypatch):
    """100,000 items in about 50,000 files end in rounds of the logarithm."""
    made = []
    keep = running.scratch.stored
    monkeypatch.setattr(running.scratch, "stored", lambda df, name: made.append(name) or keep(df, name))
    df = spark.range(100_000).select(F.lit("a").alias("run"), "id", F.lit(5).alias("n"))
    assert catalog.next_fit(df, "run", "id", "n", 10).agg(F.max("file")).first()[0] == 49_999 and made.count("fit-more") <= 17


def test_block_at_sweep(spark):
    """Empty shards, blocks out of range, one block asked by two thirds of the rows; no nested loop and no window over all rows."""
    sizes = [3, 0, 0, 5, 1, 0]
    shards = spark.createDataFrame(list(enumerate(sizes)), "shard long, blocks long")
    asked = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 4).otherwise(F.col("id") % 12 - 1).alias("block"))
    flat = [(s, r) for s, n in enumerate(sizes) for r in range(n)]
    df = packing.block_at(shards, asked)
    got = df.groupBy("block", "shard", "row").count().collect()
    want = {b: sum(1 for i in range(3000) if (4 if i % 3 else i % 12 - 1) == b) for b in range(len(flat))}
    assert {(r["block"], r["shard"], r["row"], r["count"]) for r in got} == {(b, *flat[b], n) for b, n in want.items() if n}
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ranks(spark, monkeypatch):
    """Every rank of skewed, tiny, huge and odd doubles; at most four passes; none reads more counters than its bound."""
    rng, passes = random.Random(6), []
    own = ranks._pass
    monkeypatch.setattr(ranks, "_pass", lambda *a: passes.append(1) or own(*a))
    values = [rng.choice([0.0, -0.0, 1.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf")]) if rng.random() < 0.2 else rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) if rng.random() < 0.5 else 7.0 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    places = [0, 1, 1499, 1500, 2998, 2999]
    assert ranks.at_ranks(df, places) == {r: sorted(values)[r] for r in places} and len(passes) <= 4
    passes.clear()
    near = [1.0 + i * 2**-52 for i in range(400)]
    assert ranks.at_ranks(spark.createDataFrame([(v,) for v in near], "v double"), [17, 200]) == {17: near[17], 200: near[200]} and len(passes) <= 4
    assert math.isnan(ranks.at_ranks(spark.createDataFrame([(1.0,), (float("nan"),)], "v double"), [1])[1])
    assert ranks.profile(spark.createDataFrame([], "v double"), F.col("v"), (0.5,)) == (0, None, None, None, None)
    assert ranks.profile(spark.createDataFrame([(1,), (None,), (4,)], "v int"), F.col("v"), (0.5, 0.0))[4:] == (2.5, 1.0)

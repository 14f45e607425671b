"""Sources, requests, catalogs, reports and streams against plain Python."""

import json
import math

import pytest
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.functions import numbers as N
from siltstone.functions import udfs as U
from siltstone.operators import catalog, control, normalize, profile, requests, tokenize
from siltstone.sources import dispatch, hosted, scans, sinks
from siltstone.streaming import streams


def test_literals(spark):
    sizes = {"1.5 GiB": 1610612736, "3kb": 3000, "7": 7, "0": 1, "0.2B": 1, "2 MB": 2000000, " 1 k i b ": 1024, "big": None, "": None, "3 xb": None, "-2B": None, None: None}
    df = spark.createDataFrame([(x,) for x in sizes], "s string")
    assert {r.s: r.n for r in df.select("s", N.size_bytes(F.col("s")).alias("n")).collect()} == sizes
    assert N.truth(" Yes ") and not N.truth("off") and N.truth(True) and N.floats("1, 2.5,,") == (1.0, 2.5)
    for bad in (lambda: N.truth("maybe"), lambda: N.floats(" , ")):
        with pytest.raises(ValueError):
            bad()


def test_field_choice():
    assert hosted.text_name({"author": "a", "story": "b"}, None) == "author" and hosted.text_name({"id": "a", "story": "b"}, None) == "story"
    assert hosted.text_name({"title": "t", "raw_text": "x", "zz": "y"}, None) == "raw_text" and hosted.text_name({"article": "t", "raw": "x"}, None) == "raw"
    assert hosted.text_name({"text": 3, "body": "b"}, None) == "body"
    from pyspark.sql import types as T

    s = T.StructType([T.StructField(n, T.StringType()) for n in ("identifier", "language", "license", "date", "full_text", "text", "zeta")])
    assert scans.text_fields(s) == ["text", "full_text", "zeta", "date", "identifier", "language", "license"]
    assert scans.metadata_fields(s) == ["identifier", "language", "license", "date"]


def write(spark, path, ids, **more):
    spark.createDataFrame([(f"text {i}", i) for i in ids], "text string, n long").coalesce(1).write.mode("overwrite").parquet(str(path))


def test_scans_in_order(spark, tmp_path):
    """Files of two folders with equal names, patterns and folders, limits in path order."""
    import shutil

    for folder, start in (("a", 0), ("b", 100)):
        (tmp_path / folder).mkdir()
        for k in (10, 2):
            write(spark, tmp_path / "stage" / "x", range(start + k, start + k + 5))
            shutil.copy(next((tmp_path / "stage" / "x").glob("part-*.parquet")), tmp_path / folder / f"c4-train.{k:05d}-of-00011.parquet")
    one = f"file://{tmp_path}/a/c4-train.00010-of-00011.parquet"
    assert [p.rsplit("/", 1)[-1] for p in scans.discover(spark, f"file://{tmp_path}/a")] == ["c4-train.00002-of-00011.parquet", "c4-train.00010-of-00011.parquet"]
    rows = scans.parquet(spark, [f"file://{tmp_path}/b", one], ["n"], limit=12).collect()
    assert sorted((r["path_no"], r["n"]) for r in rows) == [(0, n) for n in [*range(102, 107), *range(110, 115)]] + [(1, 10), (1, 11)]
    rows = scans.parquet(spark, [f"file://{tmp_path}/*/*.parquet"], per_file=2).collect()
    assert sorted(r["n"] for r in rows) == [2, 3, 10, 11, 102, 103, 110, 111] and {r["path_no"] for r in rows} == {0}
    feet = scans.footers(spark, [one]).first()
    assert (feet["n_rows"], feet["n_row_groups"], feet["group_rows"]) == (5, 1, [5]) and feet["n_bytes"] > 100


def test_dispatch(spark, tmp_path):
    rows = [("u1", "first", "en", None), (" ", "second", "fr", 3)]
    spark.createDataFrame(rows, "url string, body string, language string, token_count int").coalesce(1).write.parquet(f"{tmp_path}/d")
    got = sorted(dispatch.records(spark, dispatch.Source("s", paths=(f"file://{tmp_path}/d",), weight=2, max_records=5)).collect(), key=lambda r: r["source_row"])
    assert [r["text"] for r in got] == ["first", "second"] and got[0]["doc_id"] == "u1" and got[1]["doc_id"].startswith("s:part-") and got[1]["doc_id"].endswith(":1")
    assert json.loads(got[0]["metadata"]) == {"url": "u1", "language": "en", "token_count": None} and got[0]["source_weight"] == 2.0
    hf = dispatch.Source("h", "hf_dataset", dataset="d", options={"loader": "tests.test_more:loader"})
    assert [(r["doc_id"], r["text"], r["source_type"]) for r in dispatch.records(spark, hf).collect()] == [("7", "hello", "hf_dataset"), ("h:train:1", "x", "hf_dataset")]
    with pytest.raises(ValueError):
        dispatch.records(spark, dispatch.Source("s", "csv"))
    assert scans.document('{"a": [1]}') == {"a": [1]}


def loader(name):
    return {"train": [{"id": 7, "text": "hello"}, {"story": "x"}]}


def test_chunks_rule():
    """Windows against the rule read out position by position."""
    import random

    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b. ", "\n\n", " ", "word", "\n"]) for _ in range(rng.randrange(1, 120)))
        target, most, overlap = rng.choice([(40, 60, 10), (10, 12, 30), (30, 30, 0)])
        got, start, want = U.chunks(text, target, most, overlap), 0, []
        if len(text) <= most:
            want = [text]
        while len(text) > most:
            stop = min(start + most, len(text))
            if stop < len(text):
                for mark in ("\n\n", ". "):
                    at = [p for p in range(start + target // 2, stop) if text[p : p + len(mark)] == mark and p + len(mark) <= stop and p > start]
                    if at:
                        stop = at[-1] + 1
                        break
            want += [text[start:stop].strip()] if text[start:stop].strip() else []
            if stop >= len(text):
                break
            start = max(stop - min(overlap, target // 2), start + 1)
        assert got == want


def test_requests(spark):
    e = spark.createDataFrame([("héllo",), ("",)], "t string").select(requests.hash_embedding(F.col("t"), 70).alias("e")).collect()
    import hashlib

    for r, t in zip(e, ("héllo", ""), strict=True):
        raw = [b / 127.5 - 1 for i in range(3) for b in hashlib.sha256(f"{t}:{i}".encode()).digest()][:70]
        norm = math.sqrt(sum(x * x for x in raw))
        assert max(abs(a - b / norm) for a, b in zip(r["e"], raw, strict=True)) < 1e-12
    values = ['"a, [b]"', "[]", "[1, 2]", "[[1,2],[3]]", '["x", "1"]', "[[]]", '["[q"]']
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(requests.embedding_inputs(F.col("v"))).collect()]
    assert got == [["a, [b]"], [], ["1 2"], ["1 2", "3"], ["x", "1"], [""], ["[q"]]
    ids = [([1, 2, 0, 0],), ([0],), ([],), ([0, 3],)]
    assert [r[0] for r in spark.createDataFrame(ids, "i array<int>").select(requests.prompt_ids(F.col("i"), 9, 0)).collect()] == [[1, 2], [9], [9], [0, 3]]
    assert requests.suppressed_ids(3, None) == [3] and requests.suppressed_ids(3, 3) == [3] and requests.suppressed_ids(3, 1) == [1, 3]
    assert requests.token_map(" a:t1 , b:t:2,,a:t3") == {"a": "t3", "b": "t:2"}
    for bad in (lambda: requests.token_map("a"), lambda: requests.token_map(":x"), lambda: requests.token_map("dev:dev-token", True)):
        with pytest.raises(ValueError):
            bad()


def test_placement():
    assert catalog.placement(["a", "b", "c"], [10, 1, 4], [100, 50, 8], 5) == [(0, "a", 0, 3, 4), (1, "a", 1, 3, 3), (2, "a", 2, 3, 3), (3, "b", 0, 1, 1), (4, "c", 0, 1, 4)]
    assert catalog.placement([], [], [], 3) == [] and [p[0] for p in catalog.placement(["a"], [1], [9], 4)] == [0]


def test_whole_profile_and_reports(spark):
    rows = [(1, "<b>x</b>&amp; " + "word " * 60, "en"), (2, None, "en"), (3, "\x01", None), (4, "\x01", "fr")]
    p = {(r["section"], r["name"]): r["value"] for r in profile.whole(spark.createDataFrame(rows, "i long, t string, language string"), "t", "i").collect()}
    assert p["counts", "rows"] == 4 and p["counts", "empty"] == 3 and p["counts", "short"] == 2 and p["counts", "control_chars"] == 2 and p["counts", "exact_duplicates"] == 1
    assert p["nulls", "t"] == 1 and p["language_top", "en"] == 1 and p["char_length", "n"] == 3 and p["word_count", "highest"] == 63
    df = spark.range(5)
    assert "there are more" in sinks.markdown("r", df, 3) and "there are more" not in sinks.markdown("r", df, 5) and "there are more" in sinks.html("r", {"s": df}, 2)


def test_stage_counters(spark):
    rules = normalize.Rules(target_chars=100, max_chars=150, overlap_chars=20, min_chars=30, min_words=3)
    docs = spark.createDataFrame([(1, "Some words here. " * 30), (2, "tiny"), (3, None), (4, "just enough words to be kept as they are")], "doc_id long, text string")
    n = {r["reason"]: r["n"] for r in normalize.stage_counters(docs, rules).collect()}
    cut = U.chunks(U.clean("Some words here. " * 30), 100, 150, 20, 30)
    assert n["seen"] == 4 and n["oversized_docs_chunked"] == 1 and n["chunks_created"] == len(cut) and n["empty"] == 1 and n["too_short"] >= 1
    assert n["written"] == normalize.records(docs, rules).filter("reason is null").count()


def tokenizer():
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"<unk>": 0, "the": 1, "fox": 2, "a": 3}, unk_token="<unk>"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    return t.to_str()


def test_tokenizer_evaluation(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the fox a", "the dog", "", "fox fox"])], "i long, text string")
    report, shown = tokenize.evaluation(docs, tokenizer(), ["i"], sample=3, examples=2)
    assert report["sample_count"] == 3 and report["vocab_size"] == 4 and report["total_sample_tokens"] == 5 and report["total_sample_chars"] == 16
    assert report["unk_token_rate"] == 1 / 5 and report["single_char_token_rate"] == 1 / 5 and report["fertility_tokens_per_word"] == 5 / 6 and report["average_chars_per_token"] == 16 / 5
    assert [s["tokens"] for s in shown] == [["the", "fox", "a"], ["the", "<unk>"]]
    assert [r["token_count"] for r in tokenize.behaviour(docs.select(F.col("text").alias("prompt")), tokenizer()).collect()] == [3, 2, 0, 2]


def test_streams(spark, tmp_path):
    text = "the fox a " * 30
    write_docs = lambda name, ids: spark.createDataFrame([("train", i, text) for i in ids], "split string, i long, text string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")  # noqa: E731, ARG005
    run = lambda: streams.run_once(streams.web_tokens(streams.files(spark, f"file://{tmp_path}/in", "split string, i long, text string"), tokenizer(), "split", "i", 50), f"file://{tmp_path}/out", f"file://{tmp_path}/state").collect()
    write_docs("a", [0])
    first = run()
    write_docs("b", [1, 2])
    got = sorted(run(), key=lambda r: r["block"])
    flat = [1, 2, 3] * 90
    assert len(first) == 1 and [list(r["tokens"]) for r in got] == [flat[i * 50 : i * 50 + 51] for i in range(5)]
    path = scratch.new_path(spark, "prefix-events")
    spark.createDataFrame([("t", "m", "h", 1, None), ("t", "m", "h", 2, 10), ("t", "m", "h", 3, None), ("u", "m", "h", 4, None), ("t", "m", "h", 5, 11), ("t", "m", "h", 6, None)], "tenant_id string, model_id string, prefix_hash string, seq long, kv_ref long").write.parquet(path + "/in")
    s = streams.files(spark, path + "/in", "tenant_id string, model_id string, prefix_hash string, seq long, kv_ref long", 100)
    assert sorted(map(tuple, streams.run_once(streams.indexed(s), path + "/out", path + "/state").collect())) == [(1, None, 0), (3, 10, 1), (4, None, 0), (6, 11, 2)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"step": 1, "train_loss": 2.5, "lr": 0.1}\n\nnot json\n{"step": 2, "val_loss": 3}\n')
    rows = streams.run_once(streams.train_log(spark, f"file://{tmp_path}/log"), path + "/log", path + "/log-state").collect()
    assert [(r["step"], r["loss"]) for r in rows] == [(1, 2.5)]


def test_near_lookup_at_any_radius(spark):
    import random

    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(30)]
    asks = [(i, "t", "m", b ^ sum(1 << k for k in rng.sample(range(63), rng.randrange(0, 8)))) for i, b in enumerate(base)]
    index = spark.createDataFrame([("t", "m", b, i, i) for i, b in enumerate(base)], "tenant_id string, model_id string, sig long, seq long, kv_ref long")
    asked = spark.createDataFrame(asks, "request_id long, tenant_id string, model_id string, sig long")
    for within in (0, 3, 6):
        got = {r["request_id"]: (r["distance"], r["kv_ref"]) for r in control.near_lookup(asked, index, within).collect()}
        want = {i: min(((s ^ b).bit_count(), j) for j, b in enumerate(base)) for i, _, _, s in asks}
        assert got == {i: w for i, w in want.items() if w[0] <= within}


def test_job_and_epochs(spark, tmp_path):
    text = "the fox a " * 30
    for k in range(3):
        spark.createDataFrame([(f"{text}{'fox ' * k}",), ("short",)], "text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = scans.discover(spark, f"file://{tmp_path}/in")
    run = lambda **more: tokenize.job(spark, {"train": files, "val": files[:1]}, tokenizer(), f"file://{tmp_path}/out", 40, 2, **more)
    first = run(max_docs={"train": 4})
    assert first["splits"]["train"]["stats"]["seen"] == 4 and first["splits"]["train"]["stats"]["documents"] == 2 and first["complete"]
    assert run() == first and run(resume=False)["splits"]["train"]["stats"]["seen"] == 6
    docs = spark.createDataFrame([(i, text) for i in range(2)], "i long, text string")
    got = {r["block"]: list(r["tokens"]) for r in tokenize.epochs(docs, tokenizer(), ["i"], 50, 3).collect()}
    flat = [1, 2, 3] * 180
    assert got == {b: flat[b * 50 : b * 50 + 51] for b in range((len(flat) - 1) // 50)}


def test_exported_metrics(spark, tmp_path):
    from siltstone.operators import telemetry

    lines = ['{"step": 1, "train_loss": 2.0, "grad_norm": {"mean": 0.5}, "timing_breakdown": {"h2d_seconds": 3}}', '{"step": 2, "loss": 4.0, "memory": {"reserved_mb": 7}, "guarded_step_replay": {"attempts": 2}}', '{"step": 2, "val_loss": 1}']
    rows = telemetry.metrics(telemetry.parse(spark.createDataFrame(list(enumerate(lines)), "i long, line string")))
    assert rows.columns == list(telemetry.EXPORTED) and len(rows.columns) == 24
    a, b = rows.orderBy("i").collect()
    assert (a["grad_mean"], a["h2d_seconds"], a["train_loss_delta"]) == (0.5, 3.0, None) and (b["memory_reserved_mb"], b["guard_attempts"], b["train_loss_delta"]) == (7.0, 2.0, 2.0) and abs(b["train_loss_ema"] - (0.08 * 4 + 0.92 * 2)) < 1e-12
    sinks.csv(telemetry.visible(rows, "i", 1, 5), list(telemetry.EXPORTED), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first()["train_loss"] == "4.0"


def test_reports(spark):
    from siltstone.operators import dedup, reports, telemetry

    docs = spark.createDataFrame([(1, "a b c", "en"), (2, "a b c", "en"), (3, None, "fr")], "doc_id long, text string, language string")
    told = reports.profile(profile.whole(docs, "text", "doc_id"))
    assert "- rows: 3" in told and "- exact duplicates: 1" in told and "## language top" in told and "| en | 2 |" in told
    assert "- seen: 3" in reports.normalization(normalize.stage_counters(docs, normalize.Rules(min_chars=1, min_words=1))) and "- empty: 1" in reports.normalization(normalize.stage_counters(docs, normalize.Rules(min_chars=1, min_words=1)))
    decided = dedup.deduplicate(docs.filter("text is not null"), "doc_id", "text", F.lit(5).cast("long"))
    assert "- exact duplicates: 1" in reports.deduplication(dedup.counters(decided), decided) and "| 2 | exact |" in reports.deduplication(dedup.counters(decided), decided)
    lines = ['{"step": 1, "train_loss": 5.0, "step_seconds": 2, "h2d_seconds": 1}', '{"step": 2, "train_loss": 3.0, "guarded_step_replay": {"attempts": 2, "attempt_log": [{"accepted": false}]}}', '{"step": 2, "val_loss": 1}']
    page = reports.dashboard(telemetry.parse(spark.createDataFrame(list(enumerate(lines)), "i long, line string")))
    assert all(f"<h2>{x}</h2>" in page for x in ("Key figures", "Timing", "Spikes", "Slowest updates", "Replays", "Validation")) and "<td>50.0</td>" in page and "<td>h2d_seconds</td>" in page


def test_small_sinks(spark):
    import base64
    import struct

    assert [r["id"] for r in sinks.last_of(spark.range(9), "id", 3).collect()] == [8, 7, 6]
    assert sinks.combined([{"stage": "a", "complete": True}, {"stage": "b"}]) == {"complete": False, "stages": {"a": {"stage": "a", "complete": True}, "b": {"stage": "b"}}}
    row = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<float>").select(U.base64_floats(F.col("v")).alias("b")).collect()
    assert struct.unpack("<2f", base64.b64decode(row[0]["b"])) == (1.0, -2.5) and row[1]["b"] is None


def test_evicted_halves_and_nulls(spark, tmp_path):
    """Prices on a half go to the even number, and rows without a date or key come last, as in the query's SQL."""
    from siltstone.plans import catalogue
    from tests import compare

    rows = [(1, 50, 2.5, 1), (2, 50, 3.5, 2), (3, 50, None, 3), (4, 100, -0.5, None), (None, 100, 7.5, 4), (5, 150, 499999.5, 4), (6, 51, 499998.5, 1), (7, 51, 0.5, 2), (8, 51, 2.0, 3), (9, None, 0.5, 1), (10, None, 1.5, 2), (11, 1, 4.5, None), (12, 1, 6.5, 5)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, day int")
    orders.withColumn("o_orderdate", F.expr("timestampadd(day, day, timestamp_ntz'1995-01-01')")).drop("day").write.parquet(f"{tmp_path}/orders.parquet")
    found = catalogue.QUERIES["lru_evict"](spark, str(tmp_path))
    sql = catalogue.ORACLES["lru_evict"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")
    tables, compare.TABLES = compare.TABLES, []
    try:
        assert not compare.same(found.columns, [tuple(r) for r in found.collect()], *compare.duck(sql, ""))
    finally:
        compare.TABLES = tables


def test_stream_packing_in_proportion():
    """A key's tokens of one micro-batch are cut in one pass, not once a block; null arrays have no tokens."""
    import time

    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    class Grouped:
        def applyInPandasWithState(self, update, *how):
            return update

    class Stream:
        schema = {"split": type("Field", (), {"dataType": type("Kind", (), {"simpleString": lambda self: "string"})()})()}

        def groupBy(self, key):
            return Grouped()

    def took(*parts, overlap=True):
        state, out, began = State(), [], time.process_time()
        for part in parts:
            out += [d for d in streams.packed(Stream(), "split", "i", 128, overlap)(("train",), iter(part), state)]
        return pd.concat(out), state.get, time.process_time() - began

    batch = lambda low, high: [pd.DataFrame({"i": [9, 3], "tokens": [list(range(low + (high - low) // 2, high)), list(range(low, low + (high - low) // 2))]}), pd.DataFrame({"i": [5], "tokens": [None]})]
    for overlap, step in ((True, 128), (False, 129)):
        blocks, (held, number), _ = took(batch(0, 1000), batch(1000, 1050), batch(1050, 3000), overlap=overlap)
        assert [list(t) for t in blocks["tokens"]] == [list(range(b * step, b * step + 129)) for b in range((3000 - 129) // step + 1)]
        assert list(blocks["block"]) == list(range(number)) and held == list(range(number * step, 3000))
    blocks, _, seconds = took(batch(0, 2_000_000))
    assert len(blocks) == (2_000_000 - 129) // 128 + 1 and seconds < 20

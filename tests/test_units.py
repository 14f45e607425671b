"""Functions and operators on small tables, against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from siltstone.functions import numbers as N
from siltstone.functions import text as X
from siltstone.functions import udfs as U
from siltstone.operators import catalog, codecs, control, dedup, packing, telemetry, tokenize
from siltstone.sources import hosted, scans, sinks


def test_clean_and_chunks():
    assert U.clean("﻿a&amp;b\r\n\r\n  c \t d\x00 ①") == "a&b\nc d 1" and U.clean(None) is None
    text = "Sentence one. " * 1000
    got = U.chunks(text, 400, 600, 40)
    assert all(len(c) <= 600 for c in got) and got[0].endswith(".") and U.chunks("", 400, 600, 40) == [""] and U.chunks(None) == []


def test_simhash_and_split(spark):
    def brute(tokens):
        votes = [0] * 64
        for t in tokens:
            v = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
            for b in range(64):
                votes[b] += 1 if v >> b & 1 else -1
        x = sum(1 << b for b in range(64) if votes[b] >= 0)
        return x - (x >> 63 << 64)

    rows = [("a b c a",), ("",), ("Some, text!",)]
    got = spark.createDataFrame(rows, "t string").select("t", X.hash_tokens(F.col("t")).alias("k")).select("t", "k", U.simhash(F.col("k")).alias("s")).collect()
    assert all(r["s"] == brute(r["k"]) for r in got) and next(r["s"] for r in got if r["t"] == "") == -1


def test_greedy_is_the_ordered_choice(spark):
    rng = random.Random(4)
    sigs = [rng.getrandbits(12) for _ in range(160)]
    kept = []
    for i, s in enumerate(sigs):
        if all((s ^ sigs[j]).bit_count() > 3 for j in kept):
            kept.append(i)
    df = spark.createDataFrame(list(enumerate(sigs)), "p long, s long")
    firsts = df.groupBy("s").agg(F.min("p").alias("p"))
    assert sorted(r["p"] for r in dedup.greedy_keep(firsts, dedup.band_pairs(df, "s", "p")).collect()) == kept


def test_packing_conserves(spark):
    rng = random.Random(5)
    docs = [(i, [rng.randrange(99) for _ in range(rng.randrange(0, 30))]) for i in range(60)]
    flat = [x for _, t in docs for x in t]
    df = spark.createDataFrame(docs, "d long, t array<int>")
    for overlap, step in ((False, 9), (True, 8)):
        got = [r["tokens"] for r in packing.blocks(df, "t", ["d"], 8, overlap).orderBy("block").collect()]
        assert got == [flat[i : i + 9] for i in range(0, len(flat) - 8, step)]


def test_log(spark):
    lines = ['{"step": 1, "train_loss": 2.0, "tokens_per_sec": 10, "step_seconds": 2, "grad_norm": {"mean": 1.5, "max": 2}}', "", "{bad", '{"step": 1, "val_loss": 3.0, "val_perplexity": 20.1}', '{"step": 2, "loss": 1.0, "active_shard": "x"}', '{"note": 1}']
    p = telemetry.parse(spark.createDataFrame(list(enumerate(lines)), "i long, line string"))
    assert [r["kind"] for r in p.orderBy("i").collect()] == ["train", "malformed", "validation", "train", "other"]
    t = telemetry.train_rows(p).orderBy("i").collect()
    assert [r["loss"] for r in t] == [2.0, 1.0] and t[0]["tokens"] == 20 and t[0]["grad_mean"] == 1.5 and t[1]["is_shard_row"]
    assert telemetry.validation_rows(p).first()["val_loss"] == 3.0
    rows = [("r", i, v) for i, v in enumerate([None, 1.0, None, 2.0])]
    e = telemetry.ema(spark.createDataFrame(rows, "run string, i long, v double"), "run", "i", "v", 0.5).orderBy("i").collect()
    assert [r["ema"] for r in e][1:] == [1.0, 1.0, 1.5]


def test_gaps_limits_and_sinks(spark, tmp_path):
    names = spark.createDataFrame([("c-00000-of-00003.parquet",), ("c-00002-of-00003.parquet",), ("other",)], "name string")
    assert [(r["prefix"], r["number"]) for r in scans.numbering_gaps(names).collect()] == [("c-", 1)]
    paths = []
    for i in range(3):
        paths.append(f"{tmp_path}/f-{i}")
        spark.range(i * 10, i * 10 + 10, 1, 1).withColumn("x", F.lit(1)).write.parquet(paths[-1])
    assert sorted(r["id"] for r in scans.parquet(spark, paths, ["id"], per_file=2).collect()) == [0, 1, 10, 11, 20, 21]
    assert scans.parquet(spark, [f"{p}/*.parquet" for p in paths], limit=15).count() == 15
    shards = sinks.numbered_shards(spark.range(25), ["id"], 10).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in shards] == [10, 10, 5]
    new = sinks.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2)], "k string, v int"), "k")
    assert sorted(map(tuple, new.collect())) == [("a", 1), ("b", 2)] and "| a | 1 |" in sinks.markdown("t", new)


def test_rules_and_codecs(spark):
    row = spark.createDataFrame([("memory_first", 0.98, 32, 32768, False)], "mode string, p double, requests int, context int, fp8 boolean")
    d = control.decide(row).first()
    assert d["bits"] == 2 and d["prune_fraction"] > 0 and d["to_cpu"] and d["to_nvme"]
    assert catalog.split_counts([10, 1, 4], [1000, 5000, 400], 6) == [3, 1, 2]
    import numpy as np

    x = np.random.default_rng(7).normal(size=128).astype("f4")
    back = U.rotated_decode(U.rotated_encode(x))
    assert np.linalg.norm(back - x) / np.linalg.norm(x) < 0.22 and (U.unpack(U.pack([-3, 3, 0, -1], 3), 3, 4) == [-3, 3, 0, -1]).all()
    s = spark.createDataFrame([("Tell me about a fox named Rex who lost his hat.",), ("hello",)], "t string").select(X.story_prompt(F.col("t")).alias("p")).collect()
    assert s[0]["p"] == "Once upon a time, there was a fox named Rex. Rex had a hat. One day, Rex lost his hat." and s[1]["p"] == "hello"
    vals, bad = N.sanitized(F.col("v"))
    r = spark.createDataFrame([([1.0, float("nan"), float("inf")],)], "v array<double>").select(vals.alias("v"), bad.alias("n")).first()
    assert r["v"] == [1.0, 0.0, 0.0] and r["n"] == 2


def test_entry_without_llm(tmp_path):
    """The rest works where the training-data subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "siltstone", tmp_path / "siltstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); print(len(q), any(k.startswith('op1') for k in q), len(e.oracle_sql()), e.entry(s).count(), q['sign_dedup'](s, '/root/testdata/sf0.001').count())"], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    found = said.stdout.split()
    assert found[1] == "False" and int(found[0]) > 100 and int(found[3]) == 4 and int(found[4]) == 500, said.stderr


def _words():
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({w: i for i, w in enumerate("? a b c d e f".split())}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    return t


def test_tokenise_and_pack(spark, tmp_path):
    import numpy as np

    rng, tok = random.Random(6), _words()
    docs = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 40)))) for i in range(80)] + [(80, None), (81, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    split = F.when(F.col("doc_id") % 3 == 0, "val").otherwise("train")
    rows = tokenize.tokenized(df, split, tok.to_str(), ["doc_id"])
    for overlap, step in ((False, 9), (True, 8)):
        blocks = tokenize.packed(rows, ["doc_id"], 8, 5, overlap)
        for name, own in (("val", True), ("train", False)):
            ids = [tok.encode(t or "").ids for i, t in docs if (i % 3 == 0) == own]
            flat = [k for x in ids if len(x) >= 2 for k in x]
            due = [flat[i : i + 9] for i in range(0, len(flat) - 8, step)]
            got = blocks.filter(F.col("split") == name).orderBy("block").collect()
            assert [r["tokens"] for r in got] == due and [r["shard"] for r in got] == [i // 5 for i in range(len(due))]
            c = tokenize.counters(rows).filter(F.col("split") == name).first()
            assert (c["documents"], c["tokens"], c["skipped"]) == (sum(len(x) >= 2 for x in ids), len(flat), sum(len(x) < 2 for x in ids))
        assert sum(r["blocks"] for r in tokenize.shards(blocks).collect()) == blocks.count()
    path = tmp_path / "arrays"
    hosted.write_arrays(blocks, f"file://{path}")
    found = np.concatenate([np.load(p) for p in sorted(path.glob("train_*.npy"))])
    assert found.tolist() == [r["tokens"] for r in blocks.filter("split = 'train'").orderBy("block").collect()] and not list(path.glob(".*"))


def test_hosted(spark, tmp_path, monkeypatch):
    (tmp_path / "own_loader.py").write_text("def load(name, n=5):\n    return {'train': [{'id': None if i == 2 else f'r{i}', 'content': f'text {i}', 'k': (i, b'x')} for i in range(n)], 'bare': ['p', 'q']}\n")
    spark.sparkContext.addPyFile(str(tmp_path / "own_loader.py"))
    hosted.register(spark)
    read = spark.read.format("hosted_dataset").option("dataset", "d").option("loader", "own_loader:load")
    rows = {r["source_row"]: r for r in read.option("arguments", '{"n": 7}').option("shards", "3").load().collect()}
    assert sorted(rows) == list(range(7)) and rows[2]["doc_id"] == "d:train:2" and rows[3]["doc_id"] == "r3" and rows[6]["text"] == "text 6" and '"k": [0, "x"]' in rows[0]["metadata"]
    assert [r["source_row"] for r in read.option("maxRecords", "2").load().collect()] == [0, 1]
    bare = spark.read.format("hosted_dataset").option("dataset", "d").option("loader", "own_loader:load").option("split", "bare").load()
    assert sorted(r["text"] for r in bare.collect()) == ["p", "q"]


def test_admission_and_selective_codec(spark):
    req = spark.createDataFrame([(1, "t", "m", "h1", 0, 9000, 4), (2, "t", "m", "zz", 3, 10, 20), (3, "t", "gone", "h1", 0, 1, 1), (4, "u", "m", "h1", -1, 1, 1)], "request_id long, tenant_id string, model_id string, prefix_hash string, sig long, context long, requests long")
    models = spark.createDataFrame([("m", "memory_first", True)], "model_id string, mode string, fp8 boolean")
    index = spark.createDataFrame([("t", "m", "h1", 0, 10, 1)], "tenant_id string, model_id string, prefix_hash string, sig long, kv_ref long, seq long")
    pages = spark.createDataFrame([("gpu", 99), ("cpu", 5000)], "tier string, n_bytes long")
    got = {r["request_id"]: r for r in control.admit(req, models, index, pages, 100.0).collect()}
    assert {k: r["match"] for k, r in got.items()} == {1: "exact", 2: "near", 4: "miss"} and got[1]["bits"] == 2 and got[1]["token_count"] == 9000 and got[2]["p"] == 0.99
    rows = [(1, i, float(i % 5), [float(i), 1.0, -2.0, 0.5] * 8) for i in range(20)] + [(2, 0, 1.0, None), (2, 1, 1.0, [])]
    c = codecs.selective(spark.createDataFrame(rows, "g int, i int, s double, v array<double>"), "g", "i", "s", "v", 4, 0.2).collect()
    one = {r["i"]: r for r in c if r["g"] == 1}
    assert sorted(i for i in one if one[i]["tier"] == "recent") == [16, 17, 18, 19] and sum(r["tier"] == "hot" for r in one.values()) == 4
    assert all(r["error"] < {"recent": 0.001, "hot": 0.07, "cold": 0.4}[r["tier"]] for r in one.values()) and sum(r["n_bytes"] for r in one.values()) < sum(r["raw_bytes"] for r in one.values())
    assert {r["i"]: (r["payload"], r["n_bytes"]) for r in c if r["g"] == 2} == {0: (None, 0), 1: (b"", 0)}
    assert "<td>a&amp;b</td>" in sinks.html("t", {"s": spark.createDataFrame([("a&b",)], "x string")})


def test_web_text_as_defined(spark):
    import re
    import unicodedata

    rng, blank = random.Random(8), [chr(i) for i in range(0x3100) if chr(i).isspace()]
    assert sorted(X.BLANKS) == sorted(blank)
    some = [*blank, "\r\n", "\n\n\n", " \t ", "a", "É", "我", "٣", "²", "7", "😀", "!", "​", "́"]
    texts = [None, "", *blank, *("".join(rng.choices(some, [1] * len(blank) + [3] * (len(some) - len(blank)), k=rng.randrange(1, 60))) for _ in range(600))]

    def normal(t):
        t = re.sub("\r\n?", "\n", t or "").strip()
        return re.sub("\n{3,}", "\n\n", re.sub("[ \t\r\f\v]+", " ", t))

    def kept(t, least):
        solid = [c for c in t if not c.isspace()]
        kinds = [unicodedata.category(c)[0] for c in solid]
        return len(t) >= least and bool(solid) and kinds.count("L") >= 0.20 * len(solid) and kinds.count("L") + kinds.count("N") >= 0.35 * len(solid)

    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", X.normalize_web(F.col("text")).alias("n"), X.web_text(F.col("text"), 5).alias("w"))
    got = {r["i"]: (r["n"], r["w"]) for r in df.collect()}
    for i, t in enumerate(texts):
        n = normal(t)
        assert got[i] == (n, n if kept(n, 5) else None), (i, t)
    assert 0 < sum(w is not None for _, w in got.values()) < len(texts)


def test_pieces_of_runs_in_any_order():
    import pyarrow as pa

    rng = random.Random(9)
    for overlap in (False, True):
        width, step = 9, 8 if overlap else 9
        for seed in range(40):
            rows, flat = [], {"a": [], "b": [], None: []}
            for _ in range(rng.randrange(1, 60)):
                key, ids = rng.choice("ab") if rng.random() < 0.9 else None, [rng.randrange(1000) for _ in range(rng.choice((1, 2, 5, 30)))]
                rows.append((key, len(flat[key]), ids))
                flat[key] += ids
            if seed % 2:
                rng.shuffle(rows)
            schema = pa.schema([("split", pa.string()), ("start", pa.int64()), ("tokens", pa.list_(pa.int32()))])
            cut = rng.randrange(len(rows) + 1)
            batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in part], schema=schema) for part in (rows[:cut], rows[cut:])]
            made = {}
            for b in packing._pieces(["split"], step, width, 7)(iter(batches)):
                for r in b.to_pylist():
                    assert r["size"] == len(r["part"]) > 0
                    made.setdefault((r["split"], r["block"]), []).append((r["low"], r["part"]))
            got = {k: [x for _, part in sorted(v) for x in part] for k, v in made.items()}
            due = {(k, b): ids[b * step : b * step + width] for k, ids in flat.items() for b in range(-(-len(ids) // step))}
            assert got == {k: v for k, v in due.items() if v}


def test_web_blocks_leave_tokens_where_they_are(spark, monkeypatch):
    from siltstone import scratch

    made, stored = {}, scratch.stored

    def kept(df, name, *more):
        made[name] = stored(df, name, *more)
        return made[name]

    monkeypatch.setattr(scratch, "stored", kept)
    rng, tok = random.Random(10), _words()
    docs = [(rng.randrange(200) if rng.random() < 0.95 else None, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 60)))) for _ in range(400)]
    df = spark.createDataFrame([*docs, (7, None), (8, "a b")], "doc_id long, text string").repartition(5)
    split = F.when(F.col("doc_id") % 3 == 0, "val").otherwise("train")
    blocks, counted = tokenize.web_corpus(df, split, tok.to_str(), ["doc_id"], 8, 5, 20)
    long = [(i, t) for i, t in docs if len(t.strip()) >= 20]
    counts = {r["split"]: (r["documents"], r["tokens"], r["skipped"]) for r in counted.collect()}
    for name, own in (("val", True), ("train", False)):
        sizes = [len(t.split()) for i, t in long if (i is not None and i % 3 == 0) == own]
        assert counts[name] == (len(sizes), sum(sizes), 0)
        got = blocks.filter(F.col("split") == name).orderBy("block").collect()
        assert [r["block"] for r in got] == list(range((sum(sizes) - 1) // 8)) and all(len(r["tokens"]) == 9 for r in got)
        assert all(a["tokens"][-1] == b["tokens"][0] for a, b in zip(got[:-1], got[1:], strict=True))
    # Only what lies on the edges of a task's runs is shuffled.
    parts = made["tokenized"].select("_part").distinct().count()
    edges = made["pieces"].filter("size < 9").count()
    assert edges <= 4 * 2 * parts and made["pieces"].count() - edges > 10 * edges


def test_cached_ids_are_the_librarys():
    import json
    from pathlib import Path

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from siltstone.functions import bpe

    class Shared:
        value = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")

    lib, rng = Tokenizer.from_str(Shared.value), random.Random(11)
    some = ["a", "Zebra", " ", "  ", "\n", "'s", "12", "²", "É", "我们", "😀", "<|endoftext|>", "-", "\u0085", "the ", "\t"]
    texts = ["", "<|endoftext|>", *("".join(rng.choices(some, k=rng.randrange(1, 40))) for _ in range(500))]
    due = [e.ids for e in lib.encode_batch_fast(texts)]
    got = tokenize._ids(Shared, "cached")(texts)
    assert isinstance(tokenize._workers["cached cached"], bpe.Encoder)
    assert [i.tolist() for i in got] == due and all(i.dtype == np.int32 for i in got)
    # Where anything comes before or after the model, the library alone is asked.
    known = json.loads(Shared.value)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**known["pre_tokenizer"], "add_prefix_space": True}}):

        class Other:
            value = json.dumps({**known, **change})

        own = tokenize._ids(Other, str(change))
        assert tokenize._workers[f"{change} cached"] is None
        assert [i.tolist() for i in own(texts)] == [e.ids for e in Tokenizer.from_str(Other.value).encode_batch_fast(texts)]
    tokenize._workers.clear()

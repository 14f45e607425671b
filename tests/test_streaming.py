"""Endless streams, resumed packing, hosted sources by ranges, the prefix index's state: stopped, resumed, counted."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.sources import hosted
from siltstone.streaming import ranges


def lengths(rows):
    """A token a word, its length; texts that begin with '-' are filtered."""
    return rows.withColumn("tokens", F.when(~F.col("text").startswith("-"), F.transform(F.split("text", " "), F.length)))


def written(folder, counts):
    """Numbered files of so many rows in small row groups; the folder and the texts in order."""
    texts = []
    for k, n in enumerate(counts):
        own = [("-" if i % 5 == 4 else "") + " ".join("x" * (1 + (i * 7 + j * 3 + k) % 9) for j in range(1 + i % 4)) for i in range(n)]
        texts += own
        pq.write_table(pa.table({"text": pa.array(own, pa.string()), "other": list(range(n))}), folder / f"web.{k:05d}-of-{len(counts):05d}.parquet", row_group_size=3)
    return f"file://{folder}", texts


def expected(texts, epochs, length, overlap, least=1):
    flat = [len(w) for _ in range(epochs) for t in texts if not t.startswith("-") and len(t.split(" ")) >= least for w in t.split(" ")]
    step = length if overlap else length + 1
    return [flat[i : i + length + 1] for i in range(0, len(flat), step) if i + length + 1 <= len(flat)], flat


def in_order(packer):
    return [list(r["tokens"]) for r in packer.blocks().orderBy("block").collect()]


def test_advance():
    """Every row once an epoch, in order, whatever the batches; empty files are passed over."""
    files = [("a", 3), ("b", 0), ("c", 7), ("d", 1)]
    for rows in (1, 2, 4, 11, 30):
        at, seen = (0, 0, 0), []
        while True:
            got, end = ranges.advance(files, at, rows, 2, 3)
            if not got:
                break
            seen += [(e, f, i) for e, f, _, low, high in got for i in range(low, high)]
            assert all(high - low <= 3 for *_, low, high in got) and sum(high - low for *_, low, high in got) <= rows
            at = end
        assert seen == [(e, f, i) for e in range(2) for f, (_, n) in enumerate(files) for i in range(n)]
    assert ranges.advance([("a", 0)], (0, 0, 0), 5) == ([], (0, 0, 0)) and ranges.advance(files, (5, 9, 0), 1)[0][0][:2] == (6, 0)


def test_endless_stream(spark, tmp_path):
    """Stopped and resumed by its checkpoint, and gone on with from an exported state elsewhere: the blocks of one run over two epochs."""
    path, texts = written(tmp_path, [7, 0, 12, 5])
    files = ranges.planned(spark, path)
    assert [n for _, n in files] == [7, 12, 5]
    want, _ = expected(texts, 2, 6, True)
    out = scratch.new_path(spark, "endless-test")
    one = ranges.Packer(spark, out + "/one", lengths, 6)
    ranges.run(ranges.stream(spark, files, 48, 2, task_rows=5), one, out + "/one-state")
    assert in_order(one) == want
    two = ranges.Packer(spark, out + "/two", lengths, 6)
    state = ranges.run(ranges.stream(spark, files, 9, 0, task_rows=4), two, out + "/two-state", 2)
    assert state["batch"] == 1 and (state["epoch"], state["file"], state["row"]) == (0, 1, 11)
    ranges.run(ranges.stream(spark, files, 9, 2, task_rows=4), two, out + "/two-state")
    assert in_order(two) == want
    moved = ranges.Packer(spark, out + "/moved", lengths, 6, initial=json.loads(json.dumps(state)))
    ranges.run(ranges.stream(spark, files, 100, 2, start=state), moved, out + "/moved-state")
    assert in_order(moved) == want[state["next_block"] :]


@pytest.mark.parametrize("limit", [None, 13])
def test_packing_killed_anywhere(spark, limit, monkeypatch, tmp_path):
    """Ended after each batch, and between blocks and log: the same blocks, counters and shards as one run; the limit holds across files."""
    path, texts = written(tmp_path, [6, 9, 4])
    files, out = ranges.planned(spark, path), scratch.new_path(spark, "killed-test")
    want, flat = expected(texts[:limit], 1, 5, False, 2)
    make = lambda name: ranges.Packer(spark, f"{out}/{name}", lengths, 5, False, 2, least=2)
    whole = make("whole")
    assert ranges.pack_files(spark, files, whole, 1000, limit)
    kept = [t for t in texts[:limit] if not t.startswith("-")]
    assert in_order(whole) == want and whole.counters().first().asDict() == {"seen": len(texts[:limit]), "filtered": len(texts[:limit]) - len(kept), "skipped": sum(" " not in t for t in kept), "documents": sum(" " in t for t in kept), "tokens": len(flat), "blocks": len(want)}
    parts = make("parts")
    assert not ranges.pack_files(spark, files, parts, 4, limit, batches=1)
    log = ranges.LOG
    monkeypatch.setattr(ranges, "LOG", "broken")  # blocks are written, the log row is not
    with pytest.raises(Exception):  # noqa: B017
        ranges.pack_files(spark, files, parts, 4, limit)
    monkeypatch.setattr(ranges, "LOG", log)
    assert parts.state()["batch"] == 0 and len(in_order(parts)) < len(want)
    while not ranges.pack_files(spark, files, parts, 4, limit, batches=1):
        pass
    assert in_order(parts) == want and parts.counters().first() == whole.counters().first()
    assert [r["shard"] for r in parts.blocks().orderBy("block").collect()] == [i // 2 for i in range(len(want))]
    with pytest.raises(ValueError, match="another run"):
        parts(spark.createDataFrame([(3, 0, files[0][0], 0, 1)], ranges.RANGES), 0)


LOADER = '''
import os
def note(i):
    with open(os.environ.get("SEEN", "{seen}"), "a") as f: f.write(f"{{i}}\\n")
class Sized:
    column_names = ["id", "body", "k"]
    def __init__(self, rows): self.rows = rows
    def __len__(self): return len(self.rows)
    def __getitem__(self, i): note(i); return self.rows[i]
class Columns(Sized):
    def select_columns(self, names): return Columns([{{k: r[k] for k in names}} for r in self.rows])
class Stream:
    num_shards = 3
    def __init__(self, part=None): self.part = part
    def shard(self, num_shards, index): return Stream(index)
    def __iter__(self):
        for i in range(12):
            if self.part is None or i // 4 == self.part:
                note(i); yield {{"body": f"text {{i}}", "k": i}}
def load(name, kind="sized"):
    rows = [{{"id": f"r{{i}}", "body": f"text {{i}}", "k": i}} for i in range(20)]
    return {{"sized": Sized(rows), "columns": Columns(rows), "stream": Stream()}}[kind]
'''


def test_hosted_ranges(spark, tmp_path):
    """Rows read are the rows asked, counted; columns and bounds on rows reach the dataset."""
    seen = tmp_path / "seen"
    (tmp_path / "range_loader.py").write_text(LOADER.format(seen=seen))
    spark.sparkContext.addPyFile(str(tmp_path / "range_loader.py"))
    hosted.register(spark)

    def read(kind, condition=None, **options):
        seen.write_text("")
        df = spark.read.format("hosted_dataset").option("dataset", "d").option("loader", "range_loader:load").option("arguments", json.dumps({"kind": kind})).options(**options).load()
        rows = (df.filter(condition) if condition else df).collect()
        return rows, sorted(int(x) for x in seen.read_text().split())

    rows, asked = read("sized", shards="6")
    assert asked == list(range(20)) and sorted(r["source_row"] for r in rows) == list(range(20)) and {r["doc_id"] for r in rows} == {f"r{i}" for i in range(20)}
    rows, asked = read("sized", shards="4", maxRecords="9")
    assert asked == list(range(9)) and len(rows) == 9
    rows, asked = read("columns", shards="3", textField="body", metadata="k")
    assert asked == list(range(20)) and rows[0]["metadata"] == '{"k": 0}' and {r["doc_id"] for r in rows} == {f"d:train:{i}" for i in range(20)}
    rows, asked = read("stream")
    assert asked == list(range(12)) and sorted(r["text"] for r in rows) == sorted(f"text {i}" for i in range(12)) and len({r["doc_id"] for r in rows}) == 12
    rows, asked = read("stream", maxRecords="5")
    assert len(rows) == 5 and asked in (list(range(5)), list(range(6)))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows, asked = read("sized", "source_row >= 5 and source_row < 8", shards="4", pushFilters="true")
        assert asked == [5, 6, 7] and len(rows) == 3
        rows, asked = read("sized", "source_split = 'other'", pushFilters="true")
        assert rows == [] and asked == []
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def replayed(events, ttl):
    """A plain replay in the order of seq: answers of lookups, and removed entries per eviction."""
    held, out = {}, []
    for tenant, prefix, seq, at, ref, op in events:
        alive = {k for k, (_, _, used) in held.items() if used + ttl >= at}
        key = (tenant, prefix)
        if op == "evict":
            gone = [k for k in held if k[0] == tenant]
            if n := sum(k in alive for k in gone):
                out.append(("evict", tenant, seq, None, None, n))
            for k in gone:
                del held[k]
        elif op == "insert":
            held[key] = (ref, held[key][1] if key in alive else 0, at)
        elif key in alive:
            held[key] = (held[key][0], held[key][1] + 1, at)
            out.append(("lookup", tenant, seq, held[key][0], held[key][1], None))
        else:
            out.append(("lookup", tenant, seq, None, 0, None))
    return sorted(out, key=lambda r: r[2])


def test_prefix_state(spark):
    """Over several micro-batches: answers of a plain replay, a hot tenant over many buckets, state that shrinks when entries expire."""
    import datetime
    import random

    from siltstone.streaming import prefixes, streams

    rng, start, ttl = random.Random(4), datetime.datetime(2024, 1, 1), 60
    events = [(rng.choice("aaab"), f"p{rng.randrange(12)}", seq, seq * 3, seq, rng.choices(["insert", "lookup", "evict"], [5, 9, 0.3])[0]) for seq in range(240)]
    path, key = scratch.new_path(spark, "prefix-test"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, prefixes.PROVIDER)
    make = lambda rows: spark.createDataFrame([(t, "m", p, q, start + datetime.timedelta(seconds=x), r if o == "insert" else None, o) for t, p, q, x, r, o in rows], prefixes.EVENTS)

    def step(rows):
        make(rows).coalesce(1).write.mode("append").parquet(path + "/in")
        return streams.run_once(prefixes.indexed(streams.files(spark, path + "/in", prefixes.EVENTS, 1), ttl, 3), path + "/out", path + "/state")

    state = lambda: spark.read.format("statestore").option("path", path + "/state").option("stateVarName", "entries").load().count()
    try:
        for at in range(0, 240, 80):
            answers = step(events[at : at + 80])
        assert 0 < state() <= 24
        late = [("z", "p", 500, 9000, 1, "insert"), ("z", "p", 501, 9001, None, "lookup")]
        step(late[:1])
        answers = step(late[1:])
        assert state() == 1  # the timers have taken out what had expired
    finally:
        spark.conf.set(key, before)
    got = answers.groupBy("kind", "tenant_id", "seq", "kv_ref", "hits").agg(F.sum("removed").alias("n")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[2]) == replayed(events + late, ttl)

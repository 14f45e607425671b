"""Source divergence audit: how far the term shares of each source of a language lie from those of its other sources.

Counts. A pass over whole texts counts terms per (lang, source) in each task and hands on partial counts when its table
is full; two aggregates then give a group's counts and a term's documents, and terms in at least ``LEAST`` documents of
their language are kept. A kept term has a slice (by hash) and a number within it in the order of its UTF-8 bytes, so
that a group is one vector a slice: sorted numbers and counts, compressed. A slice has about ``SLICE`` terms whatever
the vocabulary's size, and values are sums over slices.

Meetings. The groups of a language are dealt to blocks by hash. Vectors of a block and slice stay where they are: one
table, partitioned by (lang, slice, block) and persisted, of which every round reads its own partitions. In each round
of a round-robin tournament (the circle method: with an even number of blocks, one fewer rounds than blocks) half of
the blocks travel as compressed vectors to their opponents' partitions, meet all groups there, and both directions of
every meeting are written at once. The first round is at home: groups of one block meet each other, and the language's
own vector visits every block; there a heap per group and slice ranks the terms that stand out. Only visitors are
shuffled, each vector once a round. What a task holds is two blocks of one slice, unpacked one visitor at a time.

Shares are whole numbers: p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), so all sums are exact.

Defined cases: null text, lang and source are ''; a group without kept terms has all counts 0 and takes part; a language
without kept terms gives each pair the value 0; a language with one source has no pairs; repeated rows count again; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.llm.common import release, slices

LEAST, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a slice, about; groups of a block, about; blocks that a language has at least, if it has so many groups.
SLICE, BLOCK, BLOCKS = 1 << 14, 64, 6
#: Entries of a task's table of partial counts; bytes of a text's part.
ENTRIES, PART = 200_000, 1 << 20
#: A byte of a term stays (capitals become small), any other becomes a space.
TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
KEYS = ("lang", "slice", "block")


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, part by part."""
    at, clean = 0, raw.translate(TERM)
    while len(clean) - at > PART and (end := clean.find(b" ", at + PART)) >= 0:
        yield clean[at:end].split()
        at = end
    yield clean[at:].split()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term; each group also has a row with term null."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def batch() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                names = list(n)
                columns = ([lang] * (len(names) + 1), [source] * (len(names) + 1), [None, *(t.decode() for t in names)], [0, *n.values()], [0, *map(docs.__getitem__, names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types, strict=True)], schema=schema)
            held.clear()

        size = 0
        for b in slices(batches):
            for lang, source, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                own = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(own[0]), set()
                for part in terms(raw):
                    own[0].update(part)
                    seen.update(part)
                own[1].update(seen)
                size += len(own[0]) - before
                if size >= ENTRIES:
                    yield from batch()
                    size = 0
        yield from batch()

    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = read.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST, per_slice: int = SLICE) -> DataFrame:
    """(lang, term, slice, no): the kept terms; numbers follow the order of UTF-8 bytes in each slice."""
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    kept = scratch.stored(kept.select("lang", "term"), "audit-kept")
    many = kept.groupBy("lang").agg(F.ceil(F.count("*") / per_slice).cast("long").alias("_slices"))
    cut = kept.join(many, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("_slices")).cast("int"))
    return cut.select("lang", "term", "slice", (F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1).cast("int").alias("no"))


def _packed(keys: DataFrame) -> DataFrame:
    """Vectors (lang, source, slice, entries of (no, n)) with their entries as compressed numbers and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in slices(batches, 64):
            blobs = []
            for no, n in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                steps = np.diff(np.array(no or [], "<u4"), prepend=np.uint32(0)).astype("<u4")
                blobs.append(squeeze(steps.tobytes() + np.array(n or [], "<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(blobs, pa.binary())], names=[*b.schema.names[:-2], "vector"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.drop("no", "n").schema)
    return keys.mapInArrow(run, f"{ddl}, vector binary")


def vectors(counts: DataFrame, kept: DataFrame, lang_wide: bool, blocks_of: int = BLOCK, least_blocks: int = BLOCKS) -> DataFrame:
    """A row per group (or per language, with source null) and slice: lang, slice, block, blocks, source, total, size (V), width (of the slice), vector."""
    slices_ = kept.groupBy("lang", "slice").agg(F.count("*").alias("width"))
    size = slices_.groupBy("lang").agg(F.sum("width").alias("size"))
    named = counts.filter("term is null").select("lang", "source")
    groups = named.groupBy("lang").agg(F.count("*").alias("_groups"))
    many = F.greatest(F.ceil(F.col("_groups") / blocks_of), F.least(F.col("_groups"), F.lit(least_blocks))).cast("int")
    own = counts.filter("term is not null").join(kept, ["lang", "term"])
    if lang_wide:
        own = own.groupBy("lang", "slice", "no").agg(F.sum("n").alias("n")).withColumn("source", F.lit(None).cast("string"))
        named = named.select("lang").distinct().withColumn("source", F.lit(None).cast("string"))
    entries = own.groupBy("lang", "source", "slice").agg(F.sort_array(F.collect_list(F.struct("no", "n"))).alias("e"), F.sum("n").alias("_n"))
    entries = scratch.stored(entries, "audit-entries")
    total = entries.groupBy("lang", "source").agg(F.sum("_n").alias("total"))
    rows = named.join(groups.select("lang", many.alias("blocks")), "lang").join(size, "lang", "left").join(slices_, "lang", "left").select("lang", "source", "blocks", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("slice", F.lit(0)).alias("slice"), F.coalesce("width", F.lit(0)).alias("width"))
    same = lambda t, *names: [F.col(f"r.{c}").eqNullSafe(F.col(f"{t}.{c}")) for c in names]
    full = rows.alias("r").join(entries.alias("e"), same("e", "lang", "source", "slice"), "left").join(total.alias("t"), same("t", "lang", "source"), "left")
    block = F.pmod(F.xxhash64("r.source"), F.col("r.blocks")).cast("int")
    return _packed(full.select("r.lang", "r.slice", block.alias("block"), "r.blocks", "r.source", F.coalesce("t.total", F.lit(0)).alias("total"), "r.size", "r.width", F.col("e.e.no").alias("no"), F.col("e.e.n").alias("n")))


def opponent(block, blocks, turn: int):
    """The block met in a turn (from 0) of the circle method, as a column; null for a bye and after the last turn."""
    even = blocks + blocks % 2
    ring = even - 1
    # On the ring i meets j where i + j = turn (mod ring); who would meet itself meets the last one, which stands off the ring.
    half = F.when(F.lit(turn) % 2 == 0, F.lit(turn).cast("int") / 2).otherwise((F.lit(turn) + ring) / 2).cast("int") % ring
    met = F.when(block == ring, half).when(block == half, ring).otherwise(F.pmod(F.lit(turn) - block, ring))
    return F.when((F.lit(turn) < ring) & (met < blocks), met).cast("int")


class Vector:
    """A group's shares in a slice: numbers with a count, their shares, and the share of every other number."""

    def __init__(self, total: int, size: int, width: int, blob: bytes):
        import numpy as np
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=12 * max(1, width))
        n = len(raw) // 12
        self.no, self.counts, self.width = np.cumsum(np.frombuffer(raw[: 4 * n], "<u4"), dtype=np.int64), np.frombuffer(raw[4 * n :], "<i8"), width
        self.rest = 1 + SCALE * SMOOTH // (total + SMOOTH * size) if size else 0
        whole = total + SMOOTH * size
        if n and int(self.counts.max()) + SMOOTH < 2**63 // SCALE:
            self.p = 1 + SCALE * (self.counts + SMOOTH) // whole
        else:  # beyond 64 bits: Python's integers
            self.p = np.array([1 + SCALE * (int(c) + SMOOTH) // whole for c in self.counts], np.int64)

    def places(self, other: Vector):
        """Where numbers of ``other`` stand here, and which of them are here."""
        import numpy as np

        at = np.searchsorted(self.no, other.no)
        found = at < len(self.no)
        found[found] = self.no[at[found]] == other.no[found]
        return at, found

    def distance(self, other: Vector) -> int:
        """The sum of absolute differences over all terms of the slice."""
        import numpy as np

        at, found = self.places(other)
        p, q = self.p[at[found]], other.p[found]
        mine, yours = np.abs(self.p - other.rest), np.abs(other.p - self.rest)
        both = int(np.abs(p - q).sum()) - int(mine[at[found]].sum()) - int(yours[found].sum())
        neither = self.width - len(self.no) - len(other.no) + int(found.sum())
        return int(mine.sum()) + int(yours.sum()) + both + neither * abs(self.rest - other.rest)

    def standing_out(self, of: Vector, most: int) -> list[tuple[int, int]]:
        """The (excess, number) of the terms whose share here exceeds that in ``of``: a heap keeps the ``most`` largest, smaller numbers first."""
        import numpy as np

        at, found = of.places(self)
        q = np.full(len(self.no), of.rest, np.int64)
        q[found] = of.p[at[found]]
        over = self.p - q
        some = np.flatnonzero((over > 0) & (self.counts > 0))
        return [(f, -no) for f, no in heapq.nlargest(most, zip(over[some].tolist(), (-self.no[some]).tolist(), strict=True))]


OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("other", pa.string()), ("slice", pa.int32()), ("no", pa.int32()), ("value", pa.int64())])
OUT_DDL = "lang string, source string, part string, other string, slice int, no int, value long"


def _vector(row: dict) -> Vector:
    return Vector(row["total"], row["size"], row["width"], row["vector"])


def _met(home: bool, top: int):
    def run(key, residents: pa.Table, visitors: pa.Table) -> pa.Table:
        lang, own = residents.column("lang")[0].as_py() if residents.num_rows else None, residents.to_pylist()
        stay = [(r["source"], _vector(r)) for r in own]
        rows = []

        def met(a: str, b: str, value: int) -> None:
            rows.extend(((lang, a, "pair", b, None, None, value), (lang, b, "pair", a, None, None, value)))

        if home:
            for i, (a, va) in enumerate(stay):
                for b, vb in stay[:i]:
                    met(a, b, va.distance(vb))
        for j in range(visitors.num_rows if stay else 0):
            guest = visitors.slice(j, 1).rename_columns(residents.column_names).to_pylist()[0]
            v = _vector(guest)
            for s, mine in stay:
                if home:
                    rows.extend((lang, s, "term", None, guest["slice"], no, f) for f, no in mine.standing_out(v, top))
                else:
                    met(s, guest["source"], mine.distance(v))
        columns = list(zip(*rows, strict=True)) or [()] * len(OUT)
        return pa.table([pa.array(c, t) for c, t in zip(columns, OUT.types, strict=True)], schema=OUT)

    return run


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, per_slice: int = SLICE, blocks_of: int = BLOCK, least_blocks: int = BLOCKS) -> DataFrame:
    """lang, source, part, item, value, rank: the parts ``pair`` and ``term``."""
    spark = docs.sparkSession
    counts = scratch.stored(counted(docs), "audit-counts")
    kept = scratch.stored(kept_terms(counts, least, per_slice), "audit-terms")
    groups = scratch.stored(vectors(counts, kept, False, blocks_of, least_blocks), "audit-groups")
    wide = scratch.stored(vectors(counts, kept, True, blocks_of, least_blocks), "audit-languages")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    resident = groups.repartition(n, *KEYS).persist(StorageLevel.MEMORY_AND_DISK)
    path = scratch.new_path(spark, "audit-meetings")

    def meet(visitors: DataFrame, home: bool) -> None:
        guests = visitors.toDF(*(f"guest_{c}" for c in visitors.columns))
        resident.groupBy(*KEYS).cogroup(guests.groupBy(*(f"guest_{c}" for c in KEYS))).applyInArrow(_met(home, top), OUT_DDL).write.mode("append").parquet(path)

    blocks = groups.select("lang", "slice", "block").distinct()
    meet(wide.drop("block").join(blocks, ["lang", "slice"]).select(groups.columns), True)
    most = groups.agg(F.max("blocks")).first()[0] or 1  # one number
    for turn in range(most - 1 + most % 2 if most > 1 else 0):
        met = opponent(F.col("block"), F.col("blocks"), turn)
        # Of two that meet, the one with the smaller number travels in even sums, the other in odd ones.
        travels = groups.withColumn("_met", met).filter(F.col("_met").isNotNull() & ((F.col("block") < F.col("_met")) == ((F.col("block") + F.col("_met")) % 2 == 0)))
        meet(travels.withColumn("block", F.col("_met")).select(groups.columns), False)
    resident.unpersist()
    found = spark.read.schema(OUT_DDL).parquet(path)
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(own))
    stand = found.filter("part = 'term'").join(kept, ["lang", "slice", "no"]).select("lang", "source", "part", F.col("term").alias("item"), "value")
    scratch.forget(counts, groups, wide)
    return pairs.unionByName(stand.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= top))


def op12_divergence_audit(spark, sf_dir) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST}),
v AS (SELECT lang, (SELECT count(*) FROM kept k WHERE k.lang = l.lang) AS v FROM (SELECT DISTINCT lang FROM d) l),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, v.v, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = g.lang AND c.source = g.source) AS total FROM g JOIN v USING (lang)),
ln AS (SELECT lang, v, sum(total) AS total FROM gn GROUP BY ALL),
gp AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + {SMOOTH}) // (gn.total + {SMOOTH} * gn.v) AS BIGINT) AS p FROM gn JOIN kept k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
lp AS (SELECT ln.lang, k.term, CAST(1 + CAST({SCALE} AS HUGEINT) * (sum(gp.n) + {SMOOTH}) // (any_value(ln.total) + {SMOOTH} * any_value(ln.v)) AS BIGINT) AS p FROM ln JOIN kept k USING (lang) JOIN gp ON gp.lang = ln.lang AND gp.term = k.term GROUP BY ALL),
m AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM gp x JOIN gp y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
UNION ALL SELECT gp.lang, gp.source, 'term', gp.term, gp.p - lp.p FROM gp JOIN lp USING (lang, term) WHERE gp.n > 0 AND gp.p > lp.p),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM m)
SELECT * FROM r WHERE part = 'pair' OR rank <= {TOP}
"""

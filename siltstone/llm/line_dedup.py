"""Line dedup by pairwise alignment.

Candidates: documents that share a rare line (held by at most ``RARE`` documents, paired each with each, so at most RARE - 1 a
document), and of each run of lines of at least ``MIN_WORDS`` words, however many hold it, every later holder with the first one.
Pairs grow with the lines, never with the square of a group.

Alignment: a patience diff of the two documents' line hashes. Lines unique in both anchor it (their longest increasing
subsequence), the stretches between anchors are aligned the same way, and matches grow over equal neighbours; a stretch
whose common lines all repeat is aligned by a longest common subsequence, in bounded memory. An
aligned common block (neighbouring lines in both) of at least ``MIN_WORDS`` words is deleted from the later document. What remains
of it is aligned with the earlier one again, until none of its lines stands in a run that the earlier one holds (``deleted``).
As the first holder of each run is among a document's partners, every block that any earlier document holds goes whole.
Documents of equal text (by SHA-256) form a class: its first is aligned for all, the others are deleted whole.

Links: runs with the same holders make a passage. ``passages`` names those of a document's class that other classes hold too, so
two documents share a block exactly if they share a passage; ``n_links`` counts, over them, the other classes that hold each (a partner in
two passages with different holders counts twice). Both are aggregates over holders, alike for few and for many.

Order: "later" is by doc_id, then by the text's hash. Lines are told apart by 128 bits of their hash, without white space at their ends; blank lines
never anchor, but go with a block around them. Defined cases: a null text has no lines; a null doc_id takes no part
(nothing is deleted, links 0); rows that repeat an id and its text are one document and get the same result; rows that repeat an
id with different texts are different documents; texts
without MIN_WORDS words have no runs and lose no line unless equal to another; very long texts are aligned by their lines' hashes alone; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.llm.common import rows_of, slices

MIN_WORDS, RARE = 25, 8
#: A line with over 1 / HOT of all holders of shared lines is left out before lines are shuffled; there are fewer than HOT such lines.
HOT = 1000
#: Bits of the table of a longest common subsequence.
TABLE_BITS = 1 << 28
SEQUENCE = "doc_id long, h long, sha binary, n_lines int, hashes array<binary>, words array<int>"


def line_hashes(text: str | None) -> tuple[list[bytes], list[int]]:
    """128-bit hash and words of each line; blank lines have an empty one."""
    import xxhash

    hashes, words = [], []
    for line in (text or "").encode().split(b"\n") if text else []:
        own = line.strip()
        hashes.append(xxhash.xxh3_128_digest(own) if own else b"")
        words.append(len(own.split()))
    return hashes, words


def runs_of(hashes: list[bytes], words: list[int], least: int = MIN_WORDS) -> list[bytes]:
    """Hashes of the shortest runs of lines with ``least`` words from each line on, and up to each line."""
    return sorted({x for x, _, _ in spans_of(hashes, words, least)})


def spans_of(hashes: list[bytes], words: list[int], least: int = MIN_WORDS) -> list[tuple[bytes, int, int]]:
    """(hash, first line, last line) of the shortest runs with ``least`` words from each line on, and up to each line."""
    import xxhash

    solid = [i for i, h in enumerate(hashes) if h]
    packed, spans, end, start, held = b"".join(hashes[i] for i in solid), set(), 0, 0, 0
    for first in range(len(solid)):
        while end < len(solid) and held < least:
            held += words[solid[end]]
            end += 1
        if held < least:
            break
        spans.add((first, end))
        held -= words[solid[first]]
    held = 0
    for last in range(len(solid)):
        held += words[solid[last]]
        while held - words[solid[start]] >= least:
            held -= words[solid[start]]
            start += 1
        if held >= least:
            spans.add((start, last + 1))
    return [(xxhash.xxh3_128_digest(packed[16 * first : 16 * end]), solid[first], solid[end - 1]) for first, end in sorted(spans)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first) whose seconds increase: piles and backpointers."""
    from bisect import bisect_left

    tops, ends, back = [], [], []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        if at == len(tops):
            tops.append(b)
            ends.append(i)
        else:
            tops[at], ends[at] = b, i
        back.append(ends[at - 1] if at else -1)
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _rows(a: list[int], b: list[int]):
    """Bits of b's places after each line of a: a 0 where the longest common subsequence grows."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    v = full = (1 << len(b)) - 1
    for x in a:
        u = v & at.get(x, 0)
        v = (v + u | v - u) & full
        yield v


def longest_common(a: list[int], b: list[int], bits: int = TABLE_BITS) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence; halves a where the table would have over ``bits`` bits."""
    from itertools import accumulate

    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        i, j = a1 - a0, b1 - b0
        if i > 1 and i * j > bits:
            mid, v, w = (a0 + a1) // 2, 0, 0
            for v in _rows(a[a0:mid], b[b0:b1]):
                pass
            for w in _rows(a[mid:a1][::-1], b[b0:b1][::-1]):
                pass
            grown = lambda v: [0, *accumulate(c == "0" for c in f"{v:0{j}b}"[::-1])]  # noqa: B023, E731
            left, right = grown(v), grown(w)
            cut = b0 + max(range(j + 1), key=lambda k: left[k] + right[j - k])  # noqa: B023
            todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
            continue
        rows = list(_rows(a[a0:a1], b[b0:b1]))
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((a0 + i, b0 + j))
    return sorted(out)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal lines, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        seen: dict[int, list[int]] = {}
        for i in range(a0, a1):
            seen.setdefault(a[i], [0, 0, -1, -1])[0] += 1
            seen[a[i]][2] = i
        for j in range(b0, b1):
            if (s := seen.get(b[j])) is not None:
                s[1] += 1
                s[3] = j
        anchors = _increasing(sorted((s[2], s[3]) for h, s in seen.items() if h and s[0] == s[1] == 1))
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            out += anchors
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
            continue
        own_b = [j for j in range(b0, b1) if b[j] and b[j] in seen]
        both = {b[j] for j in own_b}
        own_a = [i for i in range(a0, a1) if a[i] in both]
        out += [(own_a[i], own_b[j]) for i, j in longest_common([a[i] for i in own_a], [b[j] for j in own_b])]
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Stretches (first, last) of b to delete: neighbouring aligned lines with enough words. Blank lines don't part a block."""
    out, start, last, held = [], None, None, 0

    def close():
        if start is not None and held >= least:
            out.append((start[1], last[1]))

    for i, j in patience(a, b):
        near = last is not None and not any(a[last[0] + 1 : i]) and not any(b[last[1] + 1 : j])
        if not near:
            close()
            start, held = (i, j), 0
        last = (i, j)
        held += words[j]
    close()
    return out


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def sequences(docs: DataFrame) -> DataFrame:
    """Each row's line hashes and words (``SEQUENCE``); h and sha are the whole text's XXH64 and SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in slices(batches):
            rows = []
            for doc_id, h, text in rows_of([batch]):
                hashes, words = line_hashes(text)
                sha = None if text is None else hashlib.sha256(text.encode()).digest()
                rows.append((doc_id, h, sha, len(hashes), hashes, words))
            yield _batch(rows, SEQUENCE)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, SEQUENCE)


def held_runs(heads: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """node, run: the runs that each document holds; node is the struct (doc_id, h)."""
    ddl = "doc_id long, h long, runs array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield _batch([(d, h, runs_of(hashes, words, least)) for d, h, hashes, words in rows_of([b])], ddl)

    found = heads.select("doc_id", "h", "hashes", "words").mapInArrow(run, ddl)
    return scratch.stored(found.select(F.struct("doc_id", "h").alias("node"), F.explode("runs").alias("run")), "line-runs")


def passages(runs: DataFrame) -> DataFrame:
    """node, passage, first, n: the passages that each document holds, the first of their n > 1 holders.

    A passage is all runs with the same holders; it is named by 128 bits that they add up to.
    """
    bits = lambda *c: F.bit_xor(F.xxhash64(*c))
    name = F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("x", "y")))
    marks = runs.groupBy("run").agg(F.min("node").alias("first"), F.count("*").alias("n"), bits("node").alias("x"), bits("node", F.lit(1)).alias("y"))
    marks = marks.filter("n > 1").select("run", name.alias("passage"), "first", "n")
    return runs.join(marks, "run").select("node", "passage", "first", "n").distinct()


def pairs(heads: DataFrame, held: DataFrame, rare: int = RARE) -> DataFrame:
    """Pairs (a earlier than b) of class representatives, as structs (doc_id, h): those that share a rare line, and each passage's first holder with its others."""
    solid = F.array_distinct(F.filter("hashes", lambda x: F.octet_length(x) > 0))
    lines = heads.select(F.struct("doc_id", "h").alias("node"), F.explode(solid).alias("key"))
    shared = scratch.stored(lines.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "line-counts")
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = shared.filter(F.col("n") > max(rare, total // HOT)).select("key")
    few = lines.join(F.broadcast(hot), "key", "left_anti").join(shared.filter(F.col("n") <= rare).select("key"), "key").groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
    each = F.flatten(F.transform("nodes", lambda b, i: F.transform(F.slice("nodes", F.lit(1), i), lambda a: F.struct(a.alias("a"), b.alias("b")))))
    star = held.filter("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return star.unionByName(few.select(F.explode(each).alias("p")).select("p.a", "p.b")).distinct()


def deleted(a: list[bytes], b: list[bytes], words: list[int], a_spans: dict[bytes, tuple[int, int]], least: int = MIN_WORDS) -> set[int]:
    """Lines of b that go, ``a_spans`` being a's runs with their first and last lines.

    The blocks of the diff of a and b; then those of a with b's remaining runs, as long as that settles half of them or
    more; then each run still left is aligned with the place where a holds it.
    """
    lines = lambda blocks: (i for first, last in blocks for i in range(first, last + 1))
    cut = set(lines(common_blocks(a, b, words, least)))
    known = set(a)
    if not any(x and x in known and i not in cut for i, x in enumerate(b)):
        return cut
    open_ = lambda spans: [s for s in spans if any(b[i] and i not in cut for i in range(s[1], s[2] + 1))]
    left, before = open_([s for s in spans_of(b, words, least) if s[0] in a_spans]), None
    while left and (before is None or 2 * len(left) <= before):
        places: list[int] = []
        for i in sorted({i for _, first, last in left for i in range(first, last + 1)}):
            places += [-1, i] if places and i != places[-1] + 1 else [i]
        rest, weights = [b[i] if i >= 0 else PART for i in places], [words[i] if i >= 0 else 0 for i in places]
        cut.update(places[k] for k in lines(common_blocks(a, rest, weights, least)))
        left, before = open_(left), len(left)
    for run, first, last in left:
        at, to = a_spans[run]
        cut.update(first + k for k in lines(common_blocks(a[at : to + 1], b[first : last + 1], words[first : last + 1], least)))
    return cut


def _align(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier, spans = None, {}
        for batch in slices(batches):
            rows = []
            for doc_id, h, other_id, other_h, a, a_words, b, words in rows_of([batch]):
                if earlier != (other_id, other_h):
                    earlier, spans = (other_id, other_h), {x: (first, last) for x, first, last in spans_of(a, a_words, least)}
                if cut := sorted(deleted(a, b, words, spans, least)):
                    rows.append((doc_id, h, cut))
            yield _batch(rows, CUTS)

    return run


CUTS = "doc_id long, h long, lines array<int>"
#: Stands between stretches of a document that aren't neighbours; no line hashes to it.
PART = b"|"


def find(docs: DataFrame, least: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """One row per document (distinct doc_id and text): doc_id, h, class_id, n_links, passages, n_lines, cut (line numbers to delete, in order)."""
    seq = scratch.stored(sequences(docs), "line-sequences")
    known = seq.filter("doc_id is not null")
    classes = known.groupBy("sha").agg(F.min("doc_id").alias("class_id")).select(F.col("sha").alias("cs"), "class_id")
    heads = known.join(classes, F.col("sha").eqNullSafe(F.col("cs")) & (F.col("doc_id") == F.col("class_id"))).dropDuplicates(["doc_id", "h"])
    heads = scratch.stored(heads.select("doc_id", "h", "sha", "hashes", "words"), "line-heads")
    runs = held_runs(heads, least)
    held = scratch.stored(passages(runs), "line-passages")
    linked = scratch.stored(pairs(heads, held, rare), "line-pairs")
    scratch.forget(runs)
    side = lambda n: heads.select(F.struct("doc_id", "h").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in ("hashes", "words")))
    both = linked.join(side("b"), "b").join(side("a"), "a")
    sent = both.select("b.doc_id", "b.h", F.col("a.doc_id").alias("other_id"), F.col("a.h").alias("other_h"), "a_hashes", "a_words", "b_hashes", "b_words")
    found = scratch.stored(sent.mapInArrow(_align(least), CUTS), "line-cuts")
    scratch.forget(linked)
    links = held.groupBy("node").agg(F.sum(F.col("n") - 1).alias("n_links"), F.sort_array(F.collect_list("passage")).alias("passages")).select("node.doc_id", "node.h", "n_links", "passages")
    lines = found.select("doc_id", "h", F.explode("lines").alias("line")).distinct().groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    of_class = heads.select("doc_id", "h", "sha").join(lines, ["doc_id", "h"], "left").join(links, ["doc_id", "h"], "left")
    of_class = of_class.select(F.col("sha").alias("cs"), F.col("doc_id").alias("class_id"), "lines", "n_links", "passages")
    own = seq.select("doc_id", "h", "sha", "n_lines").dropDuplicates(["doc_id", "h"])
    own = own.join(of_class, F.col("sha").eqNullSafe(F.col("cs")) & F.col("doc_id").isNotNull(), "left")
    whole = F.sequence(F.lit(0), F.col("n_lines") - 1)
    none = F.array().cast("array<int>")
    cut = F.when(F.col("doc_id").isNull() | (F.col("n_lines") == 0), none).when(F.col("doc_id") != F.col("class_id"), whole).otherwise(F.coalesce("lines", none))
    n_links, held_by = F.coalesce("n_links", F.lit(0)).cast("long"), F.coalesce("passages", F.array().cast("array<string>"))
    return own.select("doc_id", "h", F.coalesce("class_id", "doc_id").alias("class_id"), n_links.alias("n_links"), held_by.alias("passages"), "n_lines", cut.alias("cut"))


def apply(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the lines deleted: class_id, n_links, passages, n_lines, n_cut and the cleaned text."""
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    f = found.select(F.col("doc_id").alias("fd"), F.col("h").alias("fh"), "class_id", "n_links", "passages", "n_lines", "cut")
    joined = own.join(f, own["doc_id"].eqNullSafe(F.col("fd")) & (F.col("h") == F.col("fh")))
    gone = F.map_from_arrays("cut", F.transform("cut", lambda _: F.lit(True)))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.map_contains_key("gone", i)), "\n")
    cleaned = F.when(F.size("cut") == 0, F.col("text")).when(F.size("cut") == F.col("n_lines"), F.lit("")).otherwise(kept)
    return joined.withColumn("gone", gone).select("doc_id", "class_id", "n_links", "passages", "n_lines", F.size("cut").alias("n_cut"), cleaned.alias("text"))


def op1_line_dedup(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = apply(docs, find(docs))
    return done.select("doc_id", "class_id", "n_links", "passages", "n_lines", "n_cut", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))

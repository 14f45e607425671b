"""Spelling variants: words one edit apart, each with the much more frequent word that it is likely a slip of.

Words are counted in one pass over whole texts with partial counts per task. Near words are found on two sorted
dictionaries, one of the words and one of the words reversed. Two words of m and m or m + 1 code points that differ by
one edit agree in the first or in the last m // 2 code points: the half without the edit is intact. So a word stands,
as the shorter partner (m its length) and as the longer one (m one less), in a block of words that share its first half
and in one of those that share its last half. Blocks are ranges of the sorted dictionaries, and a scan verifies the
words of a block against each other.

A block of more than ``MOST`` words is subdivided: what is left between the intact ends is a window in which the edit
lies, and again its first or its last half is intact. So each level halves the window, and at a window of one code
point a block has no more words than the alphabet has letters and pairs of letters. Only words of skewed blocks go to
the next level, a few levels suffice (the logarithm of the longest word), and all tables are of words, not of texts.
Each pair is told once: in the block that a search would choose that takes the first half wherever it is intact.

``form`` leads to a word at least ``RATIO`` times as frequent, so chains are short; roots are found by pointer doubling
over the words that have a form.

Defined cases: null and empty texts and null tables have no words; a null doc_id counts as an empty one in the rule
that deletes code points; repeated rows count again, with the same deletions; very long texts are cut at other characters;
ties go to the smallest word in code-point order. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.llm.common import release, rows_of, slices

#: Least code points and occurrences of a word; how many times as frequent its form is; one run in so many loses a code point.
LENGTH, LEAST, RATIO, ONE_IN = 6, 5, 5, 199
#: Words of a block that are verified against each other; more are subdivided.
MOST = 64
#: Entries of a task's table of partial counts; characters of a part of a text.
ENTRIES, PART = 200_000, 1 << 20
#: A Latin-1 byte of a run stays (ASCII capitals become small), any other becomes a space.
LETTER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0xC0 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of a text in Latin-1, a byte a code point, part by part."""
    at, clean = 0, text.encode("latin-1", "replace").translate(LETTER)
    while len(clean) - at > PART and (end := clean.find(b" ", at + PART)) >= 0:
        yield clean[at:end].split()
        at = end
    yield clean[at:].split()


def counted(docs: DataFrame, length: int = LENGTH, least: int = LEAST, one_in: int = ONE_IN) -> DataFrame:
    """word, n: the words of all texts."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: Counter = Counter()

        def batch() -> pa.RecordBatch:
            own = [(w, n) for w, n in held.items() if n and len(w) >= length]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], schema=schema)

        crc = zlib.crc32
        for b in slices(batches):
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                before = crc(f"{'' if doc_id is None else doc_id}:".encode())
                for part in runs(text) if text else ():
                    held.update(part)
                    for w in set(part):
                        if len(w) >= length and not (h := crc(w if w.isascii() else w.decode("latin-1").encode(), before)) % one_in:
                            at, n = h % len(w), part.count(w)
                            held[w] -= n
                            held[w[:at] + w[at + 1 :]] += n
                    if len(held) >= ENTRIES:
                        yield batch()
        yield batch()

    partial = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _halves(level: DataFrame) -> DataFrame:
    """Each entry (word, n, m, head, tail, cap) in the blocks of its window's first and of its last half.

    ``head`` and ``tail`` are the intact code points at the ends; ``cap`` bounds the common prefix of the pairs that a
    block may tell: those with more are told where the first half was chosen.
    """
    half = ((F.col("m") - F.col("head") - F.col("tail")) / 2).cast("int")
    ways = F.array(
        F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"), F.col("cap").alias("cap")),
        F.struct(F.col("head").alias("head"), (F.col("tail") + half).alias("tail"), F.least("cap", F.col("head") + half).alias("cap")),
    )
    return level.withColumn("_w", F.explode(ways)).select("word", "n", "m", F.col("_w.head").alias("head"), F.col("_w.tail").alias("tail"), F.col("_w.cap").alias("cap"))


def _blocked(entries: DataFrame) -> DataFrame:
    """Adds the block: the intact ends, the last one reversed (so that a block of shared suffixes is a range of the reversed dictionary)."""
    end = F.reverse(F.expr("right(word, tail)"))
    key = F.concat_ws(" ", F.col("m"), F.col("head"), F.col("tail"), F.col("cap"), F.expr("left(word, head)"), end)
    return entries.withColumn("block", key)


def near(a: str, b: str) -> tuple[bool, int]:
    """Whether two different words, the second as long or one longer, differ by one edit; and their common prefix."""
    n = len(a)
    at = next((i for i in range(n) if a[i] != b[i]), n)
    return (a[at:] == b[at + 1 :] if len(b) > n else a[at + 1 :] == b[at + 1 :]), at


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verifies the words of each block (block, m, cap, word, n), sorted by block, against each other."""
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    out: list[tuple] = []
    for (_, m, cap), rows in groupby(rows_of(batches), key=lambda r: r[:3]):
        short, long = [], []
        for *_, word, n in rows:
            (short if len(word) == m else long).append((word, n))
        for i, (a, na) in enumerate(short):
            for b, nb in (*short[:i], *long):
                ok, shared = near(a, b)
                if ok and shared < cap:
                    out += ((a, b, nb), (b, a, na))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 3, schema.types, strict=True)], schema=schema)


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, near, near_n): both directions of every pair of words (word, n; each once) that are one edit apart."""
    spark = words.sparkSession
    size = F.length("word")
    path = scratch.new_path(spark, "variant-blocks")
    lengths = F.array(size, size - 1)
    level = words.select("word", "n", F.explode(lengths).alias("m"), F.lit(0).alias("head"), F.lit(0).alias("tail")).filter("m > 0").withColumn("cap", F.col("m") + 1)
    # Words of one or two code points have no half that is intact: they share the block of their length.
    flat = level.filter("m < 2")
    level = level.filter("m >= 2")
    deepest = None
    while True:
        own = scratch.stored(_blocked(_halves(level)), "variant-level")
        held = own.groupBy("block").agg(F.count("*").alias("_held"))
        final = (F.col("m") - F.col("head") - F.col("tail")) <= 1
        marked = own.join(held.filter(F.col("_held") > 1), "block").withColumn("_hot", (F.col("_held") > most) & ~final)
        marked = scratch.stored(marked.select("block", "m", "cap", "word", "n", "head", "tail", "_hot"), "variant-marked")
        marked.filter("not _hot").select("block", "m", "cap", "word", "n").write.mode("append").parquet(path)
        level = marked.filter("_hot").select("word", "n", "m", "head", "tail", "cap")
        scratch.forget(own)
        if deepest is not None:
            scratch.forget(deepest)
        deepest = marked
        if not level.limit(1).count():
            break
    scratch.forget(deepest)
    if flat.limit(1).count():
        _blocked(flat).select("block", "m", "cap", "word", "n").write.mode("append").parquet(path)
    blocks = spark.read.schema("block string, m int, cap int, word string, n long").parquet(path)
    return blocks.repartitionByRange("block").sortWithinPartitions("block", "word").mapInArrow(_scan, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form), the form null at an end, to (word, root): by doubling, over the words that have a form."""
    chain = scratch.stored(forms.filter("form is not null").select("word", F.col("form").alias("root")), "variant-chain")
    while True:
        on = chain.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        longer = scratch.stored(chain.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_more")), "variant-chain")
        scratch.forget(chain)
        chain = longer.select("word", "root")
        chain._scratch = longer._scratch
        if not longer.filter("_more").limit(1).count():
            return chain


def grouped(docs: DataFrame, length: int = LENGTH, least: int = LEAST, ratio: int = RATIO, one_in: int = ONE_IN, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    return forms(scratch.stored(counted(docs, length, least, one_in), "variant-words"), ratio, most)


def forms(words: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words with their counts (word, n)."""
    best = F.min(F.struct((-F.col("near_n")).alias("_n"), "near"))
    found = near_pairs(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    more = -F.col("best._n") >= ratio * F.col("n")
    own = words.join(found, "word", "left").select("word", F.when(more, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(more, -F.col("best._n")).alias("form_n"))
    own = scratch.stored(own, "variant-forms")
    return own.join(roots(own), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_BYTES = "flatten(list_transform(string_split({0}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [195, unicode(ch) - 64] END))"
ORACLE = f"""
WITH RECURSIVE bits AS (SELECT range AS i, 0 AS k, CAST(range AS BIGINT) AS c FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
o AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents)),
d AS (SELECT doc_id, w, count(*) AS n FROM o WHERE length(w) >= {LENGTH} GROUP BY ALL),
h AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform({_BYTES.format("concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', w)")}, lambda x: CAST(x AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM d, crc),
s AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN concat(left(w, h % length(w)), right(w, length(w) - 1 - h % length(w))) ELSE w END AS word, n FROM h),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= {LENGTH} GROUP BY ALL HAVING sum(n) >= {LEAST}),
cut AS (SELECT word, length(word) AS l, i, concat(left(word, i), right(word, length(word) - 1 - i)) AS c FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
p AS (SELECT DISTINCT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.l = b.l AND a.i = b.i AND a.c = b.c AND a.word <> b.word UNION SELECT w.word, c.word FROM words w JOIN cut c ON w.word = c.c UNION SELECT c.word, w.word FROM words w JOIN cut c ON w.word = c.c),
g AS (SELECT a, count(*) AS n_near, max(n) AS top, arg_min(b, (-n, b)) AS b FROM p JOIN words ON word = b GROUP BY a),
f AS (SELECT word, n, CASE WHEN top >= {RATIO} * n THEN b END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * n THEN top END AS form_n FROM words LEFT JOIN g ON a = word),
r AS (SELECT word, word AS node, 0 AS hop FROM f UNION ALL SELECT r.word, f.form, hop + 1 FROM r JOIN f ON f.word = r.node WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT arg_max(node, hop) FROM r WHERE r.word = f.word) AS root, n, n_near, form_n FROM f
"""

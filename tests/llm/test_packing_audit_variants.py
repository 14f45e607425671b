"""Best-fit packing, source divergence and spelling variants against brute force on small and skewed tables."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.llm import bestfit, divergence, queries, variants
from tests.llm.test_operators import LONG, ODD, SMALL, make


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bestfit.VOCABULARY))


# Best-fit packing.
def check_packing(rows, texts, capacity=bestfit.CAPACITY, end_id=1):
    """Pieces are the library's ids in order; sequences are gapless, within the capacity, with two large items at most."""
    tok, want = library(), Counter()
    for doc_id, text in texts:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end_id]
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc_id, i, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * n > capacity for _, n in own) <= 2
    return held


@pytest.mark.parametrize("capacity", [4096, 64, 7])
def test_bestfit_odd(spark, capacity):
    df = make(spark, ODD * 3 + [(50, "a" * 30_000, "x", "y"), (51, "<|endoftext|> İSTANBUL ǅ é́\x1c\x85　漢字 <|ENDOFTEXT|>", None, None)])
    rows = bestfit.pack(df, capacity=capacity).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in df.collect()], capacity)


def test_bestfit_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = queries.QUERIES["op11_bestfit_packing"](spark, SMALL).collect()
    held = check_packing(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert len(held) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    assert bestfit.pack(make(spark, [])).count() == 0


def test_bestfit_hot_size_and_exchange(spark, monkeypatch):
    """Two thirds of the items are of one size; tallies meet the items by an exchange past the limit of a broadcast."""
    monkeypatch.setattr(bestfit, "FEW_TALLIES", 0)
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, "one two three").otherwise(F.concat_ws(" ", F.lit("w"), F.col("id") % 50, F.repeat(F.lit("a b "), (F.col("id") % 97).cast("int")))).alias("text")).withColumnRenamed("id", "doc_id").repartition(16)
    held = check_packing(bestfit.pack(df, capacity=256).collect(), [tuple(r) for r in df.collect()], 256)
    assert len(held) <= -(-sum(n for own in held.values() for _, n in own) // 256) + 2


def test_bestfit_sequences(spark):
    df = make(spark, ODD)
    packed = bestfit.pack(df, capacity=64, with_ids=True)
    rows, tok = {r["sequence_id"]: r for r in bestfit.sequences(packed).collect()}, library()
    whole = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in df.filter("doc_id = 8 or doc_id = 9").select("doc_id", "text").collect()}
    for p in packed.filter("doc_id = 8 or doc_id = 9").collect():
        ids = whole[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        s = rows[p["sequence_id"]]
        assert struct.unpack(f"<{len(s['tokens']) // 4}I", s["tokens"])[p["offset"] : p["offset"] + p["length"]] == tuple(ids) and s["starts"][s["doc_ids"].index(p["doc_id"])] <= p["offset"]


def test_plan():
    """No worse than best-fit decreasing item by item, ids of items and sequences without gaps, and few steps for any number of items."""
    rng = random.Random(1)
    for _ in range(30):
        capacity, counts = rng.choice([9, 30, 100, 4096]), Counter()
        for _ in range(rng.randrange(1, 150)):
            counts[rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(1, max(2, capacity // 8))] += rng.randrange(1, 15)
        plan, bins, ranks = bestfit.Plan(dict(counts), capacity), defaultdict(list), defaultdict(list)
        for s, rank, n, per, first, offset in plan.steps:
            for i in range(n):
                bins[first + i // per].append((offset + s * (i % per), s))
                ranks[s].append(rank + i)
        assert all(sorted(ranks[s]) == list(range(n)) for s, n in counts.items()) and sorted(bins) == list(range(plan.used))
        gaps = []
        for s in sorted(counts.elements(), reverse=True):
            best = min((g for g in gaps if g >= s), default=None)
            if best is not None:
                gaps.remove(best)
            gaps.append((capacity if best is None else best) - s)
        assert plan.used <= len(gaps)
    assert len(bestfit.Plan({s: 10**12 // s for s in range(1, 4097)}, 4096).steps) < 50_000


# Source divergence.
def brute_audit(rows, least, top):
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or c >= "\x80" else " " for c in t or "").split(" ")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        key = (lang or "", source or "")
        groups.add(key)
        own = [w for w in words(text) if w]
        count[key].update(own)
        docs[key[0]].update(set(own))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        sources = sorted(s for g, s in groups if g == lang)
        p = {s: shares(count[lang, s]) for s in sources}
        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = sorted(((o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s), key=lambda x: (-x[1], x[0].encode()))
            term = sorted(((t, p[s][t] - whole[t]) for t in kept if count[lang, s][t] and p[s][t] > whole[t]), key=lambda x: (-x[1], x[0].encode()))[:top]
            out += [(lang, s, part, item, value, i + 1) for part, found in (("pair", pair), ("term", term)) for i, (item, value) in enumerate(found)]
    return sorted(out)


def noisy(rng, n, sources, langs=("en", "de", None)):
    vocab = [f"{a}{b}" for a in ("foo", "Bär", "ééé", "x", "Zed") for b in "abcdefghij"]
    return [(i, " ".join(rng.choice(vocab[: rng.randrange(5, 50)]) for _ in range(rng.randrange(30))) + " 12-3\x00", rng.choice(langs), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize(("sources", "per_slice", "blocks_of", "blocks"), [(7, 8, 1, 6), (12, 1000, 5, 1), (5, 3, 64, 6), (1, 8, 2, 6), (9, 16, 4, 4)])
def test_divergence_brute(spark, sources, per_slice, blocks_of, blocks):
    rng = random.Random(sources)
    rows = noisy(rng, 400, [f"s{i}" for i in range(sources)] + [None]) + ODD + [(1, "only here", "xx", "s1"), (2, None, "yy", "t"), (3, "!!", "yy", "u")]
    got = divergence.audit(make(spark, rows), 20, 6, per_slice, blocks_of, blocks).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, 20, 6)


def test_divergence_hot_source_and_flushes(spark, monkeypatch):
    """A third of all rows in one group, a table of partial counts that is handed on again and again, a long text, an empty table."""
    rng = random.Random(3)
    rows = noisy(rng, 300, ["a", "b", "c"]) + [(i, "hot Words here and there", "en", "hot") for i in range(300)] + [(9, LONG, "en", "long"), (9, LONG, "en", "long")]
    rows += [(i, f"word5x5 word{i}x{i % 13} only", "en", "a") for i in range(60)]
    monkeypatch.setattr(divergence, "ENTRIES", 7)
    monkeypatch.setattr(divergence, "PART", 100)
    got = divergence.audit(make(spark, rows), 30, 50).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, 30, 50)
    assert divergence.audit(make(spark, [])).count() == 0


def test_tournament(spark):
    """Every two blocks meet once, and a block meets at most one other a turn."""
    for n in (2, 3, 5, 6, 9):
        blocks, seen = spark.range(n).select(F.col("id").cast("int").alias("b"), F.lit(n).alias("n")), Counter()
        for turn in range(n - 1 + n % 2):
            met = {r[0]: r[1] for r in blocks.select("b", divergence.opponent(F.col("b"), F.col("n"), turn)).collect() if r[1] is not None}
            assert all(met[o] == b != o for b, o in met.items())
            seen.update((b, o) for b, o in met.items() if b < o)
        assert len(seen) == n * (n - 1) // 2 and set(seen.values()) == {1}
        assert not [r for r in blocks.select(divergence.opponent(F.col("b"), F.col("n"), n + n % 2 - 1)).collect() if r[0] is not None]


# Spelling variants.
def brute_words(rows, length=6, least=5, one_in=199):
    import re

    found = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= least}


def edits(word):
    """What one deletion leaves, and patterns with one code point open."""
    return {word[:i] + word[i + 1 :] for i in range(len(word))}, {(word[:i], word[i + 1 :]) for i in range(len(word))}


def brute_forms(n, ratio=5):
    holes, cut = defaultdict(set), {w: edits(w)[0] for w in n}
    near = defaultdict(set)
    for w in n:
        for h in edits(w)[1]:
            holes[h].add(w)
        for c in cut[w] & n.keys():
            near[w].add(c)
            near[c].add(w)
    for own in holes.values():
        for w in own:
            near[w] |= own - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: best[w] if w in best and n[best[w]] >= ratio * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def plain(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


@pytest.mark.parametrize("most", [64, 3, 1])
def test_variants_brute(spark, most):
    """Dense words of a small alphabet, so that blocks are skewed and subdivided down to single code points."""
    rng = random.Random(5)
    n = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))): int(5 ** (rng.random() * 5)) for _ in range(700)}
    n |= {"connect" + "".join(rng.choice("aeiou") for _ in range(rng.randrange(1, 6))): rng.randrange(1, 4000) for _ in range(400)} | {"x" * i: 5**i for i in range(1, 9)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert plain(variants.forms(words, most=most)) == brute_forms(n)


@pytest.mark.parametrize("one_in", [199, 2])
def test_variants_texts(spark, monkeypatch, one_in):
    monkeypatch.setattr(variants, "ENTRIES", 50)
    monkeypatch.setattr(variants, "PART", 64)
    rng = random.Random(7)
    vocab = ["Straße", "strasse", "colour", "colours", "ÉCLAIR", "éclair", "naïveté", "naivete", "x×y÷zaa", "abcdefÿ", "Ωmega"]
    rows = [(i % 90 if i % 7 else None, " ".join(" ".join(rng.choice(vocab) for _ in range(9)) + "Ā漢" for _ in range(3)), None, None) for i in range(300)] + ODD + [(5, "colour " * 4000, "en", "a")] * 2
    n = brute_words(rows, one_in=one_in)
    assert len(n) > 10 and plain(variants.grouped(make(spark, rows), one_in=one_in)) == brute_forms(n)
    assert variants.grouped(make(spark, [])).count() == 0 and variants.grouped(make(spark, [(1, None, None, None), (2, "", None, None)])).count() == 0


def test_variants_skewed_block(spark):
    """4,000 words share their first half; no block that is verified has more than the limit unless one code point is open."""
    rng = random.Random(8)
    n = {"prefixes" + "".join(rng.choice("abcdefghij") for _ in range(8)): 5 + i for i in range(4000)}
    n |= {w[:-1] + "k": 10**5 for w in list(n)[:50]} | {w[:9] + w[10:]: 10**6 for w in list(n)[:50]}
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(8)
    assert plain(variants.forms(words)) == brute_forms(n)


def test_words_told_by_the_model_alone():
    """Ids equal the whole library's for odd words; words of Latin letters, in capitals or before punctuation, don't pass through all of it."""
    import struct

    import public_tokenizers

    from siltstone.llm import bestfit

    encoder = bestfit.Encoder(public_tokenizers.path(bestfit.VOCABULARY))
    whole, asked = encoder.library, []

    class Counted:
        def encode(self, text, **how):
            asked.append(text)
            return whole.encode(text, **how)

    encoder.library = Counted()
    odd = "Áb, H̱. İ! ÇÀß.,; ÿ÷× '''s don't it's, <|endoftext|>. x<|endoftext|>, <|ENDOFTEXT|> ab<c= ab≠ ab,̸ Σας, ªº µm. a1b2, ﬁx. K. Ǆ, é́, ab… “ab”. ab_c _a_ `x` {y} 中文, ß. ẞ. ... ab...'s x'S. Ärger!$% naïve&&& à. À"
    for text in (odd, *odd.split(" ")):
        ids = whole.encode(text, add_special_tokens=False).ids
        assert b"".join(encoder.parts(text.encode())) == struct.pack(f"<{len(ids)}I", *ids), text
    asked.clear()
    assert b"".join(encoder.parts(b"Plain words, plain WORDS. Plain words!")) and [t for t in asked if t.isalpha()] == [] and len(asked) <= 3

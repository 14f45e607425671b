"""Each operator on small tables with nulls, ties, repeated rows, long texts and clashing names, against brute force."""

import hashlib
import itertools
import random
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import bitslice, common, exact_dedup, langid, line_dedup, mixing, near, pieces, queries, simhash, token_counts, token_files, warc
from siltstone.llm.bpe import Encoder
from tests.compare import duck, same

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, owner int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "k", "s", 1) for i, t, lang, src in rows], DOCS)


LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(40_000))
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "Hello  World", "en", None), (4, "hello  world", None, "b"), (4, "hello  world", None, "b"), (5, "HELLO  WORLD", "de", "b"), (None, "hello  world", "de", "c"),
    (None, None, None, None), (7, LONG, "en", "c"), (8, LONG + " end", "en", "c"), (9, "é ß 漢字 😀 <|endoftext|> x", "fr", "d"), (10, " \n\t ", "fr", "d"), (11, "123 456 !!", "fr", "d"), (12, "x" * 5000, "en", "a"),
]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert not same(df.columns, [tuple(r) for r in df.collect()], *duck(queries.ORACLES[name], SF))


# Exact dedup.
def test_exact(spark):
    got = exact_dedup.mark(make(spark, ODD)).collect()
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for r in got:
        group = [i for i, t, *_ in ODD if hashlib.sha256(norm(t).encode()).hexdigest() == r["text_sha256"]]
        ids = [i for i in group if i is not None]
        assert r["group_size"] == len(group) and r["keep_id"] == (max(ids) if ids else None)
    assert len(got) == len(ODD) and sum(r["kept"] for r in got) == len({norm(t) for _, t, *_ in ODD})
    kept = exact_dedup.keep(make(spark, ODD))
    assert sorted(map(str, exact_dedup.keep(make(spark, ODD), broadcast_bytes=0).collect())) == sorted(map(str, kept.collect()))
    assert kept.columns == make(spark, ODD[:1]).columns and kept.count() == len({norm(t) for _, t, *_ in ODD})
    assert exact_dedup.mark(make(spark, [(4, "a", "en", "x")] * 3)).filter("kept").count() == 1
    assert exact_dedup.mark(make(spark, [])).count() == 0


def test_extendible_index():
    index, rng = exact_dedup.ExtendibleIndex(3, capacity=4), random.Random(1)
    rows = [(rng.getrandbits(61), bytes([i % 251])) for i in range(500)]
    rows += [(rows[0][0], b"other"), (rows[0][0], b"third"), rows[5]]
    for k, b in rows:
        index.insert(k, b, "", (1, 1, 1))
    entries = {(k, e[0]): e[2] for _, p in index.pages() for k, c in p["chains"].items() for e in c}
    assert set(entries) == set(rows) and entries[rows[5]][1] == 2
    assert all(len(p["chains"]) <= 4 for _, p in index.pages()) and len(index.directory) == 1 << index.depth


# SimHash.
def brute_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    label = dict(zip(nodes, nodes, strict=True))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            label[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash_components(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    for r in simhash.op8_simhash(spark, SMALL).collect():
        assert int(r["fingerprint"], 16) == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]


def test_simhash_hot_shard(spark):
    rng, base = random.Random(3), 0x0123456789ABCDEF
    fps = {base}
    while len(fps) < 1500:
        x = rng.choice(sorted(fps)[:200])
        fps.add(x ^ (1 << rng.randrange(21)) ^ (1 << rng.randrange(64)))
    rows = [(f - (f >> 63 << 64),) for f in fps] + [(rng.getrandbits(63),) for _ in range(300)]
    got = simhash.links(spark.createDataFrame(rows, "fp long")).collect()
    nodes = [r[0] for r in rows]
    mine = {frozenset((r["u"], r["v"])) for r in got}
    want = components(sorted(nodes), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert components(sorted(nodes), lambda a, b: frozenset((a, b)) in mine) == want
    assert len(got) < 12 * len(nodes)
    table = spark.createDataFrame(rows, "fp long")  # the hot shard's trees are dealt to several groups
    again = {frozenset((r["u"], r["v"])) for r in simhash.links(table, broadcast_bytes=20_000).collect()}
    assert components(sorted(nodes), lambda a, b: frozenset((a, b)) in again) == want


def test_simhash_odd(spark):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.cluster(make(spark, ODD)).collect()}
    assert got[1, 0] == 1 and got[2, 0] == 1 and got[10, 0] == 1 and got[None, 0] == 1
    assert simhash.cluster(make(spark, [])).count() == 0
    tree, rng = simhash.BKTree(), random.Random(2)
    xs = [rng.getrandbits(12) for _ in range(400)]
    for x in xs:
        tree.insert(x)
    assert all(sorted(tree.within(q, 2)) == sorted({x for x in xs if (x ^ q).bit_count() <= 2}) for q in range(0, 4096, 97))


def test_simhash_keeps_one_row_a_group(spark):
    other = "one two three four five six seven"
    again = [(4, other, "en", "a"), (4, other, "en", "b"), (None, "quite another text of its own", "en", "a"), (None, "quite another text of its own", "de", "a")]
    for rows in (ODD, ODD + again, [r for r in ODD if r[0] not in (None, 4)]):
        fps = [brute_fingerprint(t) for _, t, *_ in rows]
        group = components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 2)
        ids = {}
        for (i, *_), f in zip(rows, fps, strict=True):
            ids.setdefault(group[f], []).append(i)
        want = sorted(min((i for i in members if i is not None), default=-1) for members in ids.values())
        docs = make(spark, rows)
        got = simhash.keep(docs)
        assert got.columns == docs.columns
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got.collect()) == want
    assert simhash.keep(make(spark, [])).count() == 0


# Token counts and files.
def word_sets(t):
    words = (t or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies_brute(spark):
    """The pipeline's stage keeps the smallest id of each component of five-word Jaccard 0.8 or more, at every distance from the limit."""
    rng, rows = random.Random(5), list(ODD)
    for g in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice((6, 40, 200)))]
        for k in range(6):
            own = list(words)
            for _ in range(k * len(words) // 150 + (k > 2)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append((100 + g * 10 + k, " ".join(own), "en", "s"))
    rows += [(500 + i, " ".join([f"common{j}" for j in range(60)] + [f"own{i}x{j}" for j in range(2 + i % 30)]), "en", "s") for i in range(60)]
    for docs in (make(spark, rows), spark.read.parquet(f"{SMALL}/documents.parquet")):
        held = docs.select("doc_id", "text").collect()
        own = [word_sets(r["text"]) for r in held]
        linked = [(i, j) for i, j in itertools.combinations(range(len(own)), 2) if 4 * max(len(own[i]), len(own[j])) <= 5 * min(len(own[i]), len(own[j])) and 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]
        root = list(range(len(own)))
        for i, j in linked * 8:
            root[i] = root[j] = min(root[i], root[j])
        while any(root[i] != root[j] for i, j in linked):
            for i, j in linked:
                root[i] = root[j] = min(root[i], root[j])
        groups = {}
        for i, r in enumerate(held):
            groups.setdefault(root[i], []).append(r["doc_id"])
        want = sorted((min((x for x in g if x is not None), default=None) for g in groups.values()), key=str)
        kept = corpus_pipeline.near_copies(spark, docs.select(*corpus_pipeline.COLUMNS), SMALL)
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == want
    assert corpus_pipeline.near_copies(spark, make(spark, []).select(*corpus_pipeline.COLUMNS), SMALL).count() == 0


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def tricky(n=400):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "The", "word", "'s", "'ll", "é", "ß", "12", "½", ".", ",", "<|endoftext|>", "漢", "😀", " ", "\u0085", "\x1c", "_", "don't", "\r\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_encoder_equals_library():
    import public_tokenizers

    lib, own = library(), Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in [*tricky(), LONG[:20000], "x" * 3000, ""]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == struct.pack(f"<{len(ids)}I", *ids), t


def test_token_counts(spark):
    rows = [*ODD, *((100 + i, t, "en", "a") for i, t in enumerate(tricky(200)))]
    lib = library()
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    got = token_counts.count_tokens(make(spark, rows), "byte_bpe_50k.json").collect()
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in got) == want and all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.count_tokens(make(spark, []), "byte_bpe_50k.json").count() == 0


def test_token_files(spark, tmp_path):
    lib = library()
    path = f"file://{tmp_path}/t"
    token_files.write(make(spark, ODD), "byte_bpe_50k.json", path, file_bytes=3000)
    read = token_files.read(spark, path)
    rows = sorted(token_files.with_starts(read).collect(), key=lambda r: r["start"])
    at = 0
    for r, (i, t, *_) in zip(rows, sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        assert r["doc_id"] == i and r["start"] == at
        at += r["n_tokens"]
    for r in rows:
        texts = [t for i, t, *_ in ODD if i == r["doc_id"]]
        assert r["ids"] in [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"]))
    assert {r["doc_id"] for r in token_files.read(spark, path, [3, 9]).collect()} == {3, 9}
    import zstandard

    data = next(p for p in (tmp_path / "t").glob("part-*")).read_bytes()
    _, _, entries = token_files.seek_table(data)
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(token_files.frame(data, e) for e in entries)
    broken = bytearray(data)
    broken[entries[0][1] + entries[0][2] - 6] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        token_files.frame(bytes(broken), entries[0])


def test_token_files_query(spark):
    lib = library()
    docs = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op3_token_files"](spark, SMALL).collect()}
    at = 0
    for i, t in docs:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


# WARC.
def test_warc(spark, tmp_path):
    big = "<p>" + "é\r\n\r\n" * 400
    rows = [(1, "http://a/ b", big), (2, None, big), (2, "http://a/2", big), (3, "http://c", None), (None, "http://n", big), (5, "http://d", "small"), (6, "http://e", "small"), (7, "http://f", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/w"
    warc.write(pages, path, file_bytes=1)
    got = warc.digest(warc.assemble(warc.read(spark, path))).collect()
    warc.write(pages, path + "x", file_bytes=1, broadcast_bytes=0)
    assert sorted(map(str, warc.digest(warc.assemble(warc.read(spark, path + "x"))).collect())) == sorted(map(str, got))
    assert len(got) == len(rows)
    size = len(big.encode())
    bigs = [r for r in got if r["payload_bytes"] == size]
    assert sum(r["record_type"] == "response" for r in bigs) == 1 and all(r["refers_to"] == 2 for r in bigs if r["record_type"] == "revisit")
    assert next(r for r in bigs if r["record_type"] == "response")["page_id"] == 2
    assert {r["payload_digest"] for r in bigs} == {hashlib.sha1(big.encode()).hexdigest()}
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] < 1000)


def test_warc_assembly(spark):
    rows = [("r1", "response", []), ("q1", "request", ["r1"]), ("m1", "metadata", ["q1"]), ("m2", "metadata", ["r1"]), ("q2", "request", []), ("r2", "revisit", ["q2"]), ("m9", "metadata", ["gone"]), ("w", "warcinfo", [])]
    found = spark.createDataFrame([(i, k, c, None, None, None, None, b"x") for i, k, c in rows], warc.RECORD)
    got = {r["capture_id"]: r for r in warc.assemble(found).collect()}
    assert set(got) == {"r1", "r2", "gone", "w"}
    assert got["r1"]["request"]["record_id"] == "q1" and [m["record_id"] for m in got["r1"]["metadata"]] == ["m1", "m2"] and got["r2"]["request"]["record_id"] == "q2" and got["gone"]["response"] is None


def test_warc_whole_captures(spark, tmp_path):
    """Every capture holds its whole payload, a page of 50 MB too; an archive with it is read a record at a time."""
    huge = "".join(f"<p>{i}é</p>" for i in range(4_500_000))
    rows = [(1, "http://huge", huge), (2, "http://huge/again", huge), (3, "http://c", "<b>small</b>"), (4, "http://d", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    whole = {r["response"]["target_uri"]: r for r in warc.assemble(warc.read(spark, path)).collect()}
    assert whole["http://huge/again"]["response"]["payload"] == huge.encode() and whole["http://c"]["response"]["payload"] == b"<b>small</b>"
    assert whole["http://huge"]["response"]["record_type"] == "revisit" and whole["http://huge"]["response"]["payload"] == b""
    assert all(r["request"]["record_type"] == "request" and len(r["metadata"]) == 1 for r in whole.values())
    packed = warc.assemble(warc.read(spark, path, packed=True), packed=True)
    assert {r["response"]["target_uri"]: r for r in packed.collect()} == whole
    got = {r["page_id"]: tuple(r)[1:] for r in warc.digest(packed).collect()}
    size, sha = len(huge.encode()), hashlib.sha1(huge.encode()).hexdigest()
    assert got[1] == (size, sha, "revisit", 2) and got[2] == (size, sha, "response", None) and got[4] == (0, hashlib.sha1(b"").hexdigest(), "response", None)


def test_warc_archives(spark, tmp_path):
    """Archives are gzip members that any reader takes; plain ones are read too; damage is an error; an empty table is none."""
    import gzip

    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 40) for i in range(30)], "page_id long, url string, html string")
    warc.write(pages.coalesce(1), f"file://{tmp_path}/w")
    data = next(p for p in (tmp_path / "w").glob("part-*")).read_bytes()
    plain = gzip.decompress(data)
    assert plain.count(b"WARC/1.1\r\n") == 90 and list(warc.parse(plain)) == list(warc.parse(data)) == list(warc.parse(gzip.compress(plain)))
    for broken in (data[:-40], plain[:-30], plain[5:], plain.replace(b"page 7 page 7", b"page 7 page 8", 1)):
        with pytest.raises(ValueError):
            list(warc.parse(broken))
    warc.write(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.digest(warc.assemble(warc.read(spark, f"file://{tmp_path}/none"))).count() == 0


# Mixing.
def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))) or None, "en", s) for i, s in enumerate(rng.choices(["a", "b", "é", "Z", None, "tiny"], [60, 20, 10, 5, 4, 1], k=900))]
    got = mixing.mix(make(spark, rows)).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} | {s: 3.0 * sizes[s] for s in capped}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"] and sum(p["words"] for p in r["passes"]) == r["taken"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = mixing.mix(make(spark, rows[::-1])).collect()
    assert sorted((r["doc_id"], r["taken"], r["position"] or -1) for r in got) == sorted((r["doc_id"], r["taken"], r["position"] or -1) for r in again)
    stream = mixing.stream(make(spark, rows)).collect()
    assert [r["_position"] for r in stream] == sorted(r["_position"] for r in stream) and sum(r["_words"] for r in stream) == sum(taken.values())
    exchanged = mixing.stream(make(spark, rows), broadcast_bytes=0).collect()
    assert [r["_position"] for r in exchanged] == [r["_position"] for r in stream] and sorted(map(str, exchanged)) == sorted(map(str, stream))
    doubled = mixing.stream(make(spark, rows + rows[:40])).collect()
    assert [r["_position"] for r in doubled] == sorted(r["_position"] for r in doubled) and {r["doc_id"] for r in doubled} <= {i for i, *_ in rows}
    assert mixing.mix(make(spark, [])).count() == 0 and mixing.mix(make(spark, ODD)).count() == len(ODD)


def test_inverse_demand(spark):
    from pyspark.sql import functions as F

    for i, knots in enumerate(mixing.SCHEDULES):
        at = lambda t, k=knots: sum((min(t, b[0]) - a[0]) * (a[1] + (a[1] + (b[1] - a[1]) * (min(t, b[0]) - a[0]) / (b[0] - a[0]))) / 2 for a, b in zip(k, k[1:], strict=False) if t > a[0])
        rows = spark.range(0, 101).select((F.col("id") / 100).alias("u"), mixing.inverse_demand(F.col("id") / 100, F.lit(i)).alias("t")).collect()
        assert all(abs(at(r["t"]) / at(1.0) - r["u"]) < 1e-9 for r in rows)


# Exact top-k.
def brute_top(rows, k):
    """By exact integers; every row but the query's own is a candidate; scores beyond a long are the nearest one."""
    from fractions import Fraction

    q = [(n, i, [int(Fraction(x) * 64 // 1) for x in e]) for n, (i, e) in enumerate(rows) if i is not None and e is not None and all(x is not None and abs(x) < float("inf") for x in e)]
    want = []
    for n, i, a in q:
        if i % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for m, j, b in q if m != n and len(a) == len(b))[:k]
            want += [(i, place + 1, j, max(-(2**63), min(2**63 - 1, -x))) for place, (x, j) in enumerate(s)]
    return sorted(want)


def vectors(spark, rows):
    return bitslice.quantised(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, q int"))


def test_bitslice(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.5, -0.02, 0.0, 0.3, 2.0]) for _ in range(5)]) for i in range(300)]
    rows += [(400, None), (420, [1.0, None, 0.0, 0.0, 0.0]), (440, [float("nan")] * 5), (460, [float("inf")] * 5), (480, []), (481, []), (500, [1.0]), (20, [1.0] * 5), (None, [1.0] * 5), (520, [1e30] * 5)]
    v = vectors(spark, rows)
    got = bitslice.top_k(v.filter("vec_id % 20 = 0"), bitslice.build_index(v, 64), 20, 700).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 20)


def test_bitslice_block():
    """A block's search against brute force for odd shapes and widths; its steps in the interpreter don't go by a query's single bits."""
    import cProfile
    import pstats
    import random

    import numpy as np

    rng = random.Random(3)

    def search(n, d, big, k=4):
        e = np.array([[rng.randint(-big, big) for _ in range(d)] for _ in range(n)], object if big >> 60 else np.int64).reshape(n, d)
        low, widths, bitmaps = bitslice._slices(e) if d else ([], [], np.zeros((0, -(-n // 64)), "<u8"))
        asked = [(i, [int(x) for x in e[i]]) for i in range(0, n, 3)]
        return e, asked, list(bitslice.search_block(np.arange(n) * 7, np.arange(n), [int(x) for x in low], widths, bitmaps, asked, k))

    for n, d, big in [(1, 3, 3), (5, 0, 0), (5, 1, 0), (70, 3, 40), (130, 9, 3), (130, 9, 1 << 20), (70, 3, 1 << 70), (5, 9, 1 << 70)]:
        e, asked, found = search(n, d, big)
        for place, ids, scores in found:
            i, q = asked[place]
            want = sorted((-sum(a * int(b) for a, b in zip(q, e[r], strict=True)), 7 * r) for r in range(n) if r != i)[:4]
            assert sorted((-s, v) for s, v in zip(scores, ids, strict=True)) == want
    profile = cProfile.Profile()
    profile.enable()
    _, asked, _ = search(600, 64, 30, 20)
    profile.disable()
    calls = sum(v[1] for key, v in pstats.Stats(profile).stats.items() if "append" in key[2] or key[2] == "<built-in method builtins.len>")
    assert calls < 200 * len(asked)  # about 700 bits a query were appended one by one


def test_bitslice_wide_and_long(spark):
    """Components past any limit, ties throughout, and vectors of many attributes."""
    rng = random.Random(7)
    rows = [(i, [rng.choice([2.0e7, -3.5e9, 1e18, -1.0, 1.7e308, 5e-324, -0.0]) for _ in range(3)]) for i in range(90)]
    rows += [(200 + i, [1.0, 1.0]) for i in range(90)] + [(600 + i, [rng.gauss(0, 1) for _ in range(700)]) for i in range(45)]
    v = vectors(spark, rows)
    got = bitslice.top_k(v.filter("vec_id % 20 = 0"), bitslice.build_index(v, 16), 7).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 7)
    v = vectors(spark, [])
    assert bitslice.top_k(v, bitslice.build_index(v)).count() == 0
    keys = [-(10**40), -(2**70), -(2**70) + 1, -1, 0, 1, 255, 256, 2**64, 10**40]
    assert sorted(keys, key=bitslice.sort_key) == keys


# Language ID.
def test_language_gradients():
    import numpy as np

    net = langid.Network(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, labels = [b"ab", b"c", b"dabc"], np.array([0, 1, 0])
    _, g = net.gradients(words, labels)
    for k in net.p:
        for at in [tuple(rng) for rng in np.argwhere(np.abs(g[k]) > 1e-4)[:3]]:
            was = net.p[k][at]
            net.p[k][at] = was + 1e-3
            up = net.gradients(words, labels)[0]
            net.p[k][at] = was - 1e-3
            down = net.gradients(words, labels)[0]
            net.p[k][at] = was
            assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3 * max(1, abs(g[k][at]))


def test_language_sample_spans_whole_texts(spark):
    texts = [" ".join(f"w{i}" for i in range(10_000)), "x" * 100_000, "short one", "123"]
    got = {r["lang"]: r["text"].split() for r in langid.sample(spark.createDataFrame(list(zip("abcd", texts)), "lang string, text string"), 100).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"] == [f"w{i}" for i in range(0, 10_000, 100)]
    assert len(got["b"]) <= 100 and max(map(len, got["b"])) <= langid.SEGMENT
    assert got["c"] == ["short", "one"]


def test_language_cache_overflow(monkeypatch):
    """Texts and runs with more distinct segments than the cache holds are predicted as by the network itself."""
    monkeypatch.setattr(langid, "CACHE_ROWS", 50)
    network = langid.Network(["de", "en", "fr"])
    texts = ["a few words", " ".join(f"x{i}" for i in range(500)), None, "", *(" ".join(f"{k}y{i}" for i in range(20 + k)) for k in range(30)), " ".join(f"z{i % 40}" for i in range(90)), "1 2"]
    names, scores = langid.Predictor(network).predict(texts)
    for t, name, score in zip(texts, names, scores, strict=True):
        if not any(map(str.isalpha, t or "")):
            assert (name, score) == ("und", 0.0)
            continue
        p = network.sums(langid.segments(t)).sum(axis=0) / sum(map(len, langid.segments(t)))
        assert name == network.languages[int(p.argmax())] and abs(score - float(p.max())) < 1e-5


def test_language_learns_every_language(spark, monkeypatch):
    """More languages than have a whole sample: each is a class, and predictions come out."""
    monkeypatch.setattr(langid, "STEPS", 2)
    docs = make(spark, [(i, f"text in tongue {i % 70}", f"l{i % 70:02}", "a") for i in range(700)])
    network = langid.train(docs)
    assert network.languages == [f"l{k:02}" for k in range(70)]
    assert {r["lang_pred"] for r in langid.identify(docs, network).collect()} <= set(network.languages)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.train(docs)
    got = langid.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    odd = langid.identify(make(spark, ODD), net).collect()
    by = {r["doc_id"]: r["lang_pred"] for r in odd}
    assert len(odd) == len(ODD) and by[1] == by[2] == by[10] == by[11] == "und" and by[7] != "und" and all(0 <= r["score"] <= 1 for r in odd)
    assert langid.keep(make(spark, ODD), net).count() == sum(any(map(str.isalpha, t or "")) for _, t, *_ in ODD)
    assert {r["lang_pred"] for r in langid.identify(make(spark, ODD), langid.train(make(spark, []))).collect()} == {"und"}


def test_language_draw(spark):
    """Classes whose rows repeat one id, or one whole row, or mostly have no letter, are trained like others; one without any letter is none."""
    rng = random.Random(5)
    say = lambda words: " ".join(rng.choices(words.split(), k=12))
    en, pl, de, fi = "the of and with which from", "nie jest oraz dlaczego bardzo przez", "der und nicht auch werden ueber", "kolme neljae viisi kuusi yksi kaksi"
    for one in (3, 5, 11):
        rows = [(i, say(en), "en", "a") for i in range(400)] + [(one, say(pl), "pl", "a") for _ in range(2000)] + [(one, fi, "fi", "a")] * 1500
        rows += [(i, say(de) if i % 20 == 0 else "1234 !!", "de", "a") for i in range(2000)] + [(i, "12", "no", "a") for i in range(300)]
        docs = make(spark, rows)
        trained = zlib.crc32(str(one).encode()) % 4 != 2
        net = langid.train(docs)
        assert net.languages == (["de", "en", "fi", "pl"] if trained else ["de", "en"])
        told = langid.Predictor(net).predict([en, pl, de, fi])[0]
        assert told == (["en", "pl", "de", "fi"] if trained else ["en", told[1], "de", told[3]])
    assert langid.train(docs.repartition(5)).digest() == net.digest()


def test_language_network_equals_plain_loops():
    """States and pooled probabilities against recurrences written out for one position at a time."""
    import numpy as np

    net = langid.Network(["a", "b", "c"], hidden=4, seed=3)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def layer(bytes_, d):
        s, out = np.zeros(4), []
        for byte in bytes_:
            g = net.p["x" + d][byte].astype(float)
            r, z = sig(g[:4] + s @ net.p["u" + d][:, :4]), sig(g[4:8] + s @ net.p["u" + d][:, 4:])
            s = s + z * (np.tanh(g[8:] + (r * s) @ net.p["c" + d]) - s)
            out.append(s)
        return out

    text = "ein é word"
    want = np.zeros(3)
    for w in langid.segments(text):
        own = [langid.EDGE, *w, langid.EDGE]
        for f, b in list(zip(layer(own, "f"), layer(own[::-1], "b")[::-1], strict=True))[1:-1]:
            e = np.exp(np.concatenate((f, b)) @ net.p["o"] + net.p["a"])
            want += e / e.sum()
    want /= sum(map(len, langid.segments(text)))
    assert np.allclose(net.sums(langid.segments(text)).sum(axis=0) / sum(map(len, langid.segments(text))), want, atol=1e-5)
    names, scores = langid.Predictor(net).predict([text, text])
    assert names == ["abc"[int(want.argmax())]] * 2 and abs(scores[0] - want.max()) < 1e-5


def test_language_decisions(spark, monkeypatch):
    """The network's verdict counts: unsure texts go, null languages are filled in; a language called und is one like others; each network has its own state."""
    words = {"und": "kolme neljae viisi kuusi", "en": "the of and with which", "de": "der die das und nicht"}
    rng = random.Random(11)
    docs = make(spark, [(i, " ".join(rng.choices(words[lang].split(), k=30)), lang, "a") for i, lang in enumerate(rng.choices(list(words), k=240))])
    net = langid.train(docs)
    mixed = "the kolme der of neljae die and viisi das with kuusi nicht which und"
    asked = make(spark, [(1, "the of and with which the of", None, "a"), (2, mixed, "en", "a"), (3, "kolme neljae viisi kuusi kolme", "und", "a"), (4, "12 34", "en", "a"), (5, None, "en", "a")])
    kept = {r["doc_id"]: r["lang"] for r in langid.keep(asked, net, 0.7).collect()}
    assert kept == {1: "en", 3: "und"} and set(langid.keep(asked, net).toPandas()["doc_id"]) == {1, 2, 3}
    other = langid.Network(["x", "y"], seed=5)
    assert other.digest() != net.digest() and {r["lang_pred"] for r in langid.identify(asked, other).collect()} <= {"x", "y", "und"}
    assert {r["lang_pred"] for r in langid.identify(asked, net).collect()} <= {*words, "und"}
    monkeypatch.setattr(langid, "STEPS", 1)
    a, b = langid.train(docs), langid.train(docs.repartition(7))
    assert a.digest() == b.digest()


# SentencePiece.
def test_pieces(spark):
    import public_tokenizers
    import sentencepiece

    proto = open(public_tokenizers.path(pieces.MODEL), "rb").read()  # noqa: SIM115
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces.Codec(proto)
    for t in [*tricky(), LONG[:20000], "e" * 9000 + "the" * 900, " " * 70, ""]:
        ids = own.encode(t)
        assert list(struct.unpack(f"<{len(ids) // 4}i", ids)) == lib.encode(t), t
        assert own.decode(ids) == t
    # A unigram model of the same pieces: the streaming search reaches the greatest score that a plain table finds.
    from sentencepiece import sentencepiece_model_pb2 as fmt

    m = fmt.ModelProto()
    m.ParseFromString(proto)
    m.trainer_spec.model_type = pieces.UNIGRAM
    for p in m.pieces:
        p.score = p.score / 3174.0 - 1 if p.type == pieces.NORMAL and p.score > -1e8 else p.score
    score = {p.piece: p.score for p in m.pieces if p.type == pieces.NORMAL}
    uni = pieces.Codec(m.SerializeToString())
    for t in ("the internationalization of words", ("einverstanden und weitergehen " * 40).strip()):
        ids = uni.encode(t)
        mine = sum(score[uni.model.pieces[i]] for i in struct.unpack(f"<{len(ids) // 4}i", ids))
        chars = "▁" + t.replace(" ", "▁")
        best = [0.0]
        for j in range(1, len(chars) + 1):
            best.append(max(best[i] + score[chars[i:j]] for i in range(max(0, j - 16), j) if chars[i:j] in score))
        assert uni.decode(ids) == t and abs(mine - best[-1]) < 1e-6
    v = pieces.Viterbi(own.model)
    for _ in range(200):
        v.feed("theinanderlichkeitaaaa" * 3)
        assert len(v.text) < 400
    got = pieces.round_trip(make(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r["same"] for r in got)
    enc = pieces.encode(make(spark, ODD))
    assert sorted(r["text"] for r in pieces.decode(enc).collect()) == sorted(t or "" for _, t, *_ in ODD)


# Line dedup.
def test_patience():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(1, 12) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    assert line_dedup.patience(list(range(1, 9)), list(range(1, 9))) == [(i, i) for i in range(8)]


def test_line_dedup(spark):
    line = lambda k, n=20: " ".join(f"l{k}w{i}" for i in range(n))
    block = "\n".join(line(f"p{j}") for j in range(4))
    rows = [(1, "\n".join([line("a"), block, line("b")])), (2, "\n".join([line("c"), block, "", line("d")])), (3, line("e") + "\n" + line("p0") + "\n" + line("f")), (4, "same\ntext"), (5, "same\ntext"), (6, None), (7, ""), (None, block)]
    rows += [(100 + i, f"{line(i)}\n{block}\n{line(1000 + i)}") for i in range(30)]
    rows += [(2, rows[1][1])]
    docs = make(spark, [(i, t, "en", "s") for i, t in rows])
    got = line_dedup.apply(docs, line_dedup.find(docs)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert by[1]["n_cut"] == 0 and by[2]["text"] == f"{line('c')}\n\n{line('d')}" and by[3]["n_cut"] == 0
    assert by[4]["text"] == "same\ntext" and by[5]["text"] == "" and by[5]["class_id"] == 4 and by[6]["text"] is None and by[7]["n_cut"] == 0 and by[None]["text"] == block
    assert all(by[100 + i]["text"] == f"{line(i)}\n{line(1000 + i)}" and by[100 + i]["n_links"] >= 1 for i in range(30))
    assert line_dedup.apply(make(spark, []), line_dedup.find(make(spark, []))).count() == 0


def test_line_dedup_brute(spark):
    """Every run that an earlier document holds is cut, and nothing of documents that share no run."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in line_dedup.find(docs).collect()}
    firsts, texts = {}, sorted(docs.select("doc_id", "text").collect())
    seen = {}
    for i, t in texts:
        hashes, words = line_dedup.line_hashes(t)
        runs = line_dedup.runs_of(hashes, words)
        if t in seen:
            assert len(got[i]["cut"]) == len(hashes) and got[i]["class_id"] == seen[t]
            continue
        seen[t] = i
        early = [r for r in runs if r in firsts]
        assert bool(got[i]["cut"]) == bool(early)
        for r in runs:
            firsts.setdefault(r, i)


def test_line_dedup_repeated_lines(spark):
    """A passage without a line that is unique in both is aligned, cut wherever it stands, and counted as a link."""
    assert line_dedup.patience([1, 9, 2], [3, 9, 4, 9, 5]) in ([(1, 1)], [(1, 3)])
    rng = random.Random(3)
    for bits in (1 << 28, 8):
        for _ in range(150):
            a, b = ([rng.randrange(1, 5) for _ in range(rng.randrange(0, 20))] for _ in range(2))
            got, table = line_dedup.longest_common(a, b, bits), [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, j in itertools.product(range(len(a)), range(len(b))):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
            assert len(got) == table[-1][-1] and all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    p = " ".join(f"w{i}" for i in range(60))
    docs = make(spark, [(1, f"x\n{p}\ny", "en", "s"), (2, f"u\n{p}\nv\n{p}\nw", "en", "s")])
    by = {r["doc_id"]: r for r in line_dedup.apply(docs, line_dedup.find(docs)).collect()}
    assert by[2]["text"] == "u\nv\nw" and by[1]["n_links"] == by[2]["n_links"] == 1 and by[1]["n_cut"] == 0


def test_line_dedup_frequent_runs(spark):
    """Beyond RARE holders: blocks in another order, and lines beside a passage that only later holders share, are cut whole."""
    line = lambda k, n=20: " ".join(f"l{k}w{i}" for i in range(n))
    p, q, tail = line("p", 60), "\n".join(line(f"q{j}") for j in range(3)), line("tail", 10)
    rows = [(1, f"{p}\n{line('x')}\n{q}"), *((10 + i, f"{line(i)}\n{q}\n{line(100 + i)}\n{p}\n{tail}\n{line(200 + i)}") for i in range(12))]
    docs = make(spark, [(i, t, "en", "s") for i, t in rows])
    by = {r["doc_id"]: r["text"] for r in line_dedup.apply(docs, line_dedup.find(docs)).collect()}
    assert by[1] == rows[0][1] and by[10] == f"{line(0)}\n{line(100)}\n{tail}\n{line(200)}"
    assert all(by[10 + i] == f"{line(i)}\n{line(100 + i)}\n{line(200 + i)}" for i in range(1, 12))


def test_line_dedup_every_line(spark):
    """The lines that go are exactly those in a run of MIN_WORDS words that an earlier document holds: doubled, swapped and hot blocks, blank lines, lines in many documents."""
    rng, least = random.Random(12), line_dedup.MIN_WORDS
    pool = [" ".join(f"{k}w{i}" for i in range(rng.choice((1, 3, 9, 14, 30)))) for k in range(60)]
    blocks = [rng.sample(pool, rng.randrange(1, 6)) for _ in range(8)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            lines += rng.choice((rng.choice(blocks), [rng.choice(pool)], [f"own {i} " * rng.randrange(1, 9)], ["", " "]))
        rows.append((i, "\n".join(lines)))
    rows += [(i, "\n".join(blocks[0])) for i in range(200, 230)] + [(300, rows[3][1]), (300, rows[4][1] + "\nmore of the second text with this id"), (300, rows[3][1])]
    got = {(r["doc_id"], r["n_lines"], r["class_id"]): r["cut"] for r in line_dedup.find(make(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    solid = lambda t: [(n, line.strip()) for n, line in enumerate(t.split("\n")) if line.strip()]
    seen, heads = {}, []
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        if t in seen:
            continue
        seen[t] = i
        heads.append((i, t))
    for i, t in heads:
        if i == 300:  # two texts of one id: which is the earlier depends on their hashes
            continue
        mine, cut = solid(t), set()
        earlier = ["\n".join(["", *(x for _, x in solid(other)), ""]) for j, other in heads if j < i]
        for first in range(len(mine)):
            for last in range(first, len(mine)):
                run = [x for _, x in mine[first : last + 1]]
                if not any("\n".join(["", *run, ""]) in e for e in earlier):
                    break
                if sum(len(x.split()) for x in run) >= least:
                    cut |= set(range(mine[first][0], mine[last][0] + 1))
        told = got[i, len(t.split("\n")), i]
        assert [n for n in told if n in dict(mine)] == [n for n in sorted(cut) if n in dict(mine)], i  # blank lines go with a block


def test_line_dedup_alignment_cuts_all():
    """Diffs alone cut every line in a run that the earlier document holds, moved, doubled and reversed ones too, and no other line."""
    rng, moved = random.Random(21), 0
    for n in range(1500):
        lines = [bytes([65 + k]) * 16 for k in range(rng.choice((3, 8, 25)))] + [b""]
        weight = {x: rng.choice((1, 4, 9, 26)) if x else 0 for x in lines}
        a = [rng.choice(lines) for _ in range(rng.randrange(0, 40))]
        b = [rng.choice(lines) for _ in range(rng.randrange(0, 10))]
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(0, len(a) + 1)
            b += a[at : at + rng.randrange(0, 9)] + [rng.choice(lines)]
        if n % 10 == 0:
            b = [x for k in range(len(a), 0, -3) for x in a[max(0, k - 3) : k]]
        words_a, words_b = [weight[x] for x in a], [weight[x] for x in b]
        spans = {x: (first, last) for x, first, last in line_dedup.spans_of(a, words_a)}
        want = {i for x, first, last in line_dedup.spans_of(b, words_b) if x in spans for i in range(first, last + 1) if b[i]}
        got = line_dedup.deleted(a, b, words_b, spans)
        assert {i for i in got if b[i]} == want
        moved += {i for first, last in line_dedup.common_blocks(a, b, words_b) for i in range(first, last + 1) if b[i]} != want
    assert moved > 100  # one diff alone misses these


@pytest.mark.parametrize("holders", [2, 8, 9, 12, 40])
def test_line_dedup_links(spark, holders):
    """Links are exact for few and many holders alike, and passages tell every pair of documents that share a block."""
    line = lambda k, n=30: " ".join(f"l{k}w{i}" for i in range(n))
    rows = [(i, f"{line(i)}\n{line('p')}\n{line(100 + i)}" + (f"\n{line('q')}" if i % 3 == 0 else "") + (f"\nx\n{line('z')}" if i in (0, 1) else "")) for i in range(holders)]
    rows += [(500, rows[-1][1]), (600, line("alone"))]
    got = {r["doc_id"]: r for r in line_dedup.find(make(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    third = [i for i in range(holders) if i % 3 == 0]
    if holders == 2:  # p and z have the same holders, so they are one passage
        assert [got[i]["n_links"] for i in range(2)] == [1, 1]
    else:
        assert all(got[i]["n_links"] == holders - 1 + (len(third) - 1) * (i in third) + (i < 2) for i in range(holders))
    assert got[500]["n_links"] == got[holders - 1]["n_links"] and got[500]["passages"] == got[holders - 1]["passages"] and got[600]["n_links"] == 0 and got[600]["passages"] == []
    sets = {i: set(got[i]["passages"]) for i in range(holders)}
    assert all(sets[i] & sets[j] for i in sets for j in sets)


# The stages' own helpers.
def test_near_helpers(spark):
    import numpy as np
    from collections import Counter

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r["text"] for r in docs.select("text").collect()]
    count = Counter(s for t in texts for s in near.shingles(t).tolist())
    held = near.holders(docs)
    got = {r["s"] % 2**64: r["n"] for r in held.collect()}
    assert got == {s: n for s, n in count.items() if n > 1 and s < near.COUNTED}
    common = near.common_shingles(held, least=3)
    assert common.tolist() == sorted(s for s, n in got.items() if n >= 3)
    assert len(near.common_shingles(held, least=2, most=20)) <= 40 and len(near.common_shingles(held.limit(0))) == 0
    filled = np.frombuffer(near.bloom(held, 1 << 16), np.uint8)
    every = np.array(sorted(count), np.uint64)
    kept = near.may_be_shared(every, filled)
    assert all(kept[i] for i, s in enumerate(every.tolist()) if count[s] > 1) and kept[every < near.COUNTED].mean() < 0.2
    assert not near.may_be_shared(every[every < near.COUNTED], np.frombuffer(near.bloom(held.limit(0), 1 << 12), np.uint8)).any()


def test_near_large_group(spark, monkeypatch):
    """A group too large for its first centres, some of it only linked through others: the search by trees settles the rest."""
    monkeypatch.setattr(near, "ROUNDS", 0)
    monkeypatch.setattr(near, "TREE", 7)
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "SMALL", 5)
    rng = random.Random(21)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own), "en", "s"))
    sets = [word_sets(t) for _, t, *_ in rows]
    want = set(components(list(range(90)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])).values())
    for most in (1 << 15, 10):  # as one group, and shard by shard
        monkeypatch.setattr(near, "GROUP", most)
        assert {r["doc_id"] for r in near.keep(make(spark, rows)).collect()} == want


def test_simhash_groups_of_trees(spark):
    rng = random.Random(13)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 4))) for b in base for _ in range(6)}
    table = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    want = components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    for most in (1 << 20, 12_000, 3_000):  # one group of trees and several
        found = {frozenset((r["u"] % 2**64, r["v"] % 2**64)) for r in simhash.links(table, broadcast_bytes=most).collect()}
        assert all((a ^ b).bit_count() <= 2 for a, b in map(tuple, found)) and components(sorted(fps), lambda a, b: frozenset((a, b)) in found) == want
    for n, wide in ((10, 21), (1 << 30, 32), (1 << 40, 38)):
        masks = simhash.shard_masks(n, 2)
        assert min(m.bit_count() for m in masks) >= wide
        for _ in range(200):
            x = sum(1 << k for k in rng.sample(range(64), 2))
            assert any(x & m == 0 for m in masks)
    tree = simhash.BKTree()
    for f in sorted(fps):
        tree.insert(f)
    again = simhash.BKTree.unpacked(*tree.packed())
    assert again.items == tree.items and again.children == tree.children


def test_mixing_repeated_rows(spark):
    """Rows that repeat id, source and text, null ids included: one bucket holds none of it alone, and each row takes its own words."""
    from pyspark.sql import functions as F

    rows = [(None, f"w{i} x y", "en", "a") for i in range(300)] + [(None, "same text here", "en", "a")] * 300 + [(7, "seven is here", "en", "b")] * 50 + [(8, " ".join(["long"] * 50_000), "en", "b")]
    got = mixing.mix(make(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    again = mixing.mix(make(spark, rows[::-1]).repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"], str(r["position"])) for r in got) == sorted((str(r["doc_id"]), r["size"], r["taken"], str(r["position"])) for r in again)
    buckets = make(spark, rows[:300]).select(F.pmod(F.xxhash64(F.lit(mixing.SEED), F.col("doc_id"), F.lit(3).cast("long"), F.xxhash64("text", F.lit(mixing.SEED))), F.lit(16)).alias("b")).distinct().count()
    assert buckets == 16


def test_rows_repeated_often(spark):
    """Many repeats of one row: written out in ranges over several tasks, each repeat once."""
    few = spark.createDataFrame([(1, 1), (2, 10), (3, 11), (4, 2_345), (5, 20)], "k int, n long")
    for at_once in (1, 10, 1 << 16):
        got = common.repeated(few, "n", "i", at_once).groupBy("k", "n").agg(F.count("*").alias("c"), F.min("i").alias("a"), F.max("i").alias("b"), F.count_distinct("i").alias("d")).collect()
        assert len(got) == 5 and all((r.c, r.a, r.b, r.d) == (r.n, 0, r.n - 1, r.n) for r in got)
    wide = spark.createDataFrame([(1, 3_000_000)], "k int, n long")
    sizes = [r["count"] for r in common.repeated(wide, "n", "i").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3_000_000 and max(sizes) < 1_500_000
    docs = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("a").alias("source"))
    docs = docs.unionByName(spark.createDataFrame([(3, "some words here", "a")], "doc_id long, text string, source string"))
    got = exact_dedup.mark(docs).groupBy("doc_id", "kept", "group_size").count().collect()
    assert sorted((str(r["doc_id"]), r["kept"], r["group_size"], r["count"]) for r in got) == [("3", True, 1, 1), ("None", False, 200_000, 199_999), ("None", True, 200_000, 1)]
    mixed = mixing.mix(docs).groupBy("size").agg(F.count("*").alias("n"), F.sum("taken").alias("taken")).collect()
    assert sorted((r["size"], r["n"], r["taken"]) for r in mixed) == [(0, 200_000, 0), (3, 1, 3)]


def test_exact_collisions(spark, monkeypatch):
    """Texts whose keys collide are told apart by their bytes, from folding to the result."""
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda *_: 5)
    body = exact_dedup._fold(4)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": ["a", "b", "A", None]}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    folded = list(body([batch]))
    entries = pa.Table.from_batches(list(exact_dedup._own(4)(folded))).to_pylist()
    assert {(e["sha"], e["keep_id"], e["group_size"]) for e in entries} == {(hashlib.sha256(t).hexdigest(), k, n) for t, k, n in ((b"a", 3, 2), (b"b", 2, 1), (b"", 4, 1))} and {e["chain"] for e in entries} == {0, 1, 2}


def test_token_files_index(spark, tmp_path):
    """With an index only the files that may hold the documents are read; an empty table has none."""
    rows = [(i, f"text {i} " * 30, "en", "a") for i in range(60)] + [(None, "no id", "en", "a")]
    path = f"file://{tmp_path}/t"
    token_files.write(make(spark, rows), "byte_bpe_50k.json", path, file_bytes=500)
    indexed = token_files.index(spark, path)
    files = indexed.count()
    assert files > 5 and len(token_files._holding(indexed, [17])) == 1 and len(token_files._holding(indexed, [None])) == 1 and token_files._holding(indexed, [999]) == []
    for ids in ([17], [3, 59, None], [999]):
        got = token_files.read(spark, path, ids, indexed=indexed).collect()
        assert {r["doc_id"] for r in got} == {i for i in ids if i != 999}
    assert token_files.read(spark, path).count() == 61  # the index is none of the files
    token_files.write(make(spark, []), "byte_bpe_50k.json", f"file://{tmp_path}/none")
    assert token_files.with_starts(token_files.read(spark, f"file://{tmp_path}/none")).count() == 0


def test_token_files_hot_ids(spark, tmp_path):
    """Two thirds null ids and one repeated id are split over the ranges; the least long is an id like any other."""
    rows = spark.range(12_000).selectExpr("IF(id % 3 < 2, NULL, IF(id % 2 = 0, 7, id)) AS doc_id", "concat('text ', id) AS text")
    sizes = token_files.dealt(rows, 16).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 15 and max(r[1] for r in sizes) < 2 * 12_000 / 16
    path = f"file://{tmp_path}/t"
    token_files.write(make(spark, [(-(2**63), "a", "en", "a"), (None, "b", "en", "a"), (None, None, "en", "a"), (0, "", "en", "a")]), "byte_bpe_50k.json", path)
    got = token_files.with_starts(token_files.read(spark, path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, -(2**63)), (False, 0), (True, 0), (True, 0)] and sorted(r["start"] for r in got)[0] == 0
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, None, -(2**63), 0]


def test_pieces_long_and_empty(spark):
    long = "漢字かな交じり文" * 30_000 + "abc" * 100_000
    got = pieces.round_trip(make(spark, [(1, long, "ja", "a"), (2, "x" * 200_000, "en", "a")])).collect()
    assert all(r["same"] for r in got) and pieces.round_trip(make(spark, [])).count() == 0
    import public_tokenizers
    import sentencepiece

    proto = open(public_tokenizers.path(pieces.MODEL), "rb").read()  # noqa: SIM115
    ids = sentencepiece.SentencePieceProcessor(model_proto=proto).encode("漢字かな交じり文 " * 20_000)
    assert pieces.Codec(proto).encode("漢字かな交じり文 " * 20_000) == struct.pack(f"<{len(ids)}i", *ids)


def test_worker_state():
    from siltstone.llm import common

    made = []
    common._state.clear()
    for key in ("a", "a", "b", "a"):
        common.worker_state(key, lambda key=key: made.append(key) or key)
        assert len(common._state) == 1
    assert made == ["a", "b", "a"]
    common._state.clear()
    asked = []
    cache = common.Cache(lambda k: asked.append(k) or len(k), 4, longest=5)
    for i in range(50):
        assert cache["hot"] == 3 and cache[f"{i}"] == len(str(i)) and cache["too long"] == 8
        assert len(cache) <= 4 and len(cache.old) <= 4 and "too long" not in cache
    assert asked.count("hot") == 1


# Pipeline.
def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] and 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(make(spark, ODD).select(*corpus_pipeline.COLUMNS))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs.count(), stage(spark, docs, SMALL)
        if i < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        if i == 1:
            texts = [r["text"].lower() for r in docs.select("text").collect()]
            assert len(texts) == len(set(texts)) <= before
    assert docs.columns == ["doc_id", "n_pieces", "ids"] and docs.count() > 0


def test_pipeline_odd_tables(spark):
    """An empty table, columns beside those of documents, a very long text."""
    for rows in ([], [(1, LONG * 3, None, None), (2, "the cat and the dog of the house", "en", "a"), (3, None, "en", "a"), (3, "der hund und die katze im haus", "de", "b")]):
        docs = make(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == ["doc_id", "n_pieces", "ids"] and (docs.count() > 0) == bool(rows)


def test_near_filter_grows(spark):
    """The filter follows the number of shared shingles up to its bound, so that it stays mostly empty; it never drops a shared one."""
    import numpy as np

    shared = np.arange(1, 20_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7) % np.uint64(near.COUNTED)
    others = (np.arange(1, 20_001, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4F) + np.uint64(12345)) % np.uint64(near.COUNTED)
    held = spark.createDataFrame([(int(x), 2) for x in shared.view(np.int64)], "s long, n long")
    for most, passed in ((1 << 20, (0, 0.02)), (1 << 10, (0.9, 1))):
        filled = np.frombuffer(near.bloom(held, 1 << 10, most), np.uint8)
        assert near.may_be_shared(shared, filled).all() and len(filled) <= max(most, 1 << 10)
        assert passed[0] <= near.may_be_shared(others, filled).mean() <= passed[1]

"""SimHash near-dedup by BK-trees.

A text's 64-bit fingerprint holds a bit where over half of its shingles' XXH64 hashes (seed 42) hold it. Cut in s
segments, two fingerprints within ``radius`` = 2 bits agree in s - radius of them, so distinct fingerprints are dealt to shards by
each choice of so many segments and their value: a shard is what agrees there. s grows with the number of fingerprints, so that shards stay small. A
shard's fingerprints form BK-trees (a child's edge is its Hamming distance to the parent; a search follows edges within
the radius of its own distance). A tree holds about ``TREE`` fingerprints; a larger shard has several. Each is built once and stored
as flat arrays. The shards' fingerprints, in blocks of about ``BLOCK``, then search the trees of their own shard. The trees are broadcast in groups of about
``BROADCAST_BYTES`` at most, dealt by the hash of shard and tree so that a hot shard's trees lie in many groups; the blocks that ask a group are stored in a folder of
its own, and a job per group reads them, searches and appends its links. So neither the driver nor a
worker holds what grows with the corpus; the number of jobs does. A cell of tree and block gives its links as a spanning forest, at most a link per row, never all pairs.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other; fewer words than a shingle
make one shingle; exact copies have one fingerprint, hence one component. A null doc_id is a member that never names a
component while another member has an id. Repeated rows give repeated result rows; ids that repeat with other texts are
members each. Very long texts are hashed ``CHUNK`` shingles at a time. Empty tables give no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.llm.common import grouped, release, rows_of, slices
from siltstone.llm.components import roots

SHINGLE, RADIUS, TREE, BLOCK = 3, 2, 512, 1024
#: Bytes of a group of trees, or of the ids that stay, up to which they are broadcast; bytes of an id there, about.
BROADCAST_BYTES, ID_BYTES = 16 << 20, 24
#: Shingles of a text that are hashed at a time.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle: int = SHINGLE):
    """XXH64 of each shingle in order, in arrays of up to ``CHUNK``; none for a text without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return
    h, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    for at in range(0, n, CHUNK):
        yield np.array([h(joined[a:b], 42) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], ">u8")


def voted(chunks) -> int:
    """Signed 64-bit SimHash of hashes in arrays."""
    import numpy as np

    votes, n = np.zeros(64, np.int64), 0
    for hashes in chunks:
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash."""
    return voted(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long) of every row's whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Distinct 64-bit integers by Hamming distance."""

    def __init__(self):
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Items, and of each but the first its parent's place and its edge, as flat arrays."""
        import numpy as np

        parents, edges = np.zeros(len(self.items), "<u4"), np.zeros(len(self.items), np.uint8)
        for at, kids in enumerate(self.children):
            for edge, kid in kids.items():
                parents[kid], edges[kid] = at, edge
        return np.array(self.items, "<u8").tobytes(), parents.tobytes(), edges.tobytes()

    @classmethod
    def unpacked(cls, items: bytes, parents: bytes, edges: bytes) -> BKTree:
        import numpy as np

        tree = cls()
        tree.items = np.frombuffer(items, "<u8").tolist()
        tree.children = [{} for _ in tree.items]
        for kid, (at, edge) in enumerate(zip(np.frombuffer(parents, "<u4").tolist()[1:], edges[1:], strict=True), 1):
            tree.children[at][edge] = kid
        return tree

    def insert(self, x: int) -> None:
        new = len(self.items)
        if new:
            at = 0
            while True:
                d = (self.items[at] ^ x).bit_count()
                if d == 0:
                    return
                if (nxt := self.children[at].get(d)) is None:
                    self.children[at][d] = new
                    break
                at = nxt
        self.items.append(x)
        self.children.append({})

    def within(self, x: int, radius: int) -> list[int]:
        found, stack, items, children = [], [0] if self.items else [], self.items, self.children
        while stack:
            at = stack.pop()
            d = (items[at] ^ x).bit_count()
            if d <= radius:
                found.append(items[at])
            if kids := children[at]:
                stack += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return found


LINKS = "u long, v long"
TREES = "combo int, value long, piece int, items binary, parents binary, edges binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (combo, value, piece, fp) to a packed tree per (combo, value, piece)."""
    schema = pa.schema([("combo", pa.int32()), ("value", pa.int64()), ("piece", pa.int32()), ("items", pa.binary()), ("parents", pa.binary()), ("edges", pa.binary())])
    mask, rows = 2**64 - 1, []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, schema.types, strict=True)], schema=schema)
    for key, own in grouped(batches, 3):
        tree = BKTree()
        for *_, fp in own:
            tree.insert(fp & mask)
        rows.append((*key, *tree.packed()))
        if len(rows) == 1000:
            yield batch()
            rows = []
    yield batch()


def _cells(radius: int):
    """Rows (items, parents, edges, fps) of a tree and a block of its shard to links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, schema = 2**64 - 1, pa.schema([("u", pa.int64()), ("v", pa.int64())])
        us, vs = [], []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=schema)
        for items, parents, edges, fps in rows_of(slices(batches, 256)):
            tree, parent = BKTree.unpacked(items, parents, edges), {}

            def find(x, parent=parent):
                while (p := parent.setdefault(x, x)) != x:
                    parent[x] = x = parent[p] if p in parent else p
                return x

            for fp in fps:
                x = fp & mask
                for y in tree.within(x, radius):
                    if y != x and (a := find(x)) != (b := find(y)):
                        parent[a] = b
                        us.append(fp)
                        vs.append(y - (y >> 63 << 64))
            if len(us) > 50_000:
                yield batch()
                us, vs = [], []
        yield batch()

    return run


def shard_masks(n: int, radius: int) -> list[int]:
    """The bits that the fingerprints of a shard agree in, for each way to choose segments, given ``n`` fingerprints."""
    from itertools import combinations

    segments = radius + (1 if n <= 1 << 26 else 2 if n <= 1 << 34 else 3)
    ends = [64 * i // segments for i in range(segments + 1)]
    bits = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:], strict=False)]
    return [sum(c) for c in combinations(bits, segments - radius)]


def links(fps: DataFrame, radius: int = RADIUS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Distinct fingerprints (fp) to links (u, v) whose transitive closure is that of all pairs within ``radius`` bits.

    ``fps`` should be a stored table: it is read several times.
    """
    masks = [m - (m >> 63 << 64) for m in shard_masks(fps.count(), radius)]
    shards = F.array(*(F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)))
    members = fps.select("fp", F.explode(shards).alias("s")).select("fp", "s.combo", "s.value")
    sizes = members.groupBy("combo", "value").agg(F.count("*").alias("n")).filter("n > 1")
    cut = lambda most: F.ceil(F.col("n") / most).cast("int")
    sized = members.join(sizes, ["combo", "value"]).select("fp", "combo", "value", cut(TREE).alias("trees"), cut(BLOCK).alias("blocks"), F.abs(F.xxhash64("fp") % 2_000_003).alias("h"))
    sized = scratch.stored(sized, "simhash-shards")
    planted = sized.select("combo", "value", F.expr("cast(h % trees as int)").alias("piece"), "fp").repartition("combo", "value", "piece").sortWithinPartitions("combo", "value", "piece")
    trees = scratch.stored(planted.mapInArrow(_build, TREES), "simhash-trees")
    blocks = sized.groupBy("combo", "value", "trees", F.expr("cast(shiftright(h, 3) % blocks as int)").alias("block")).agg(F.collect_list("fp").alias("fps"))
    asks = blocks.select("combo", "value", F.explode(F.expr("sequence(0, trees - 1)")).alias("piece"), "fps", "block")
    size = trees.agg(F.sum(F.octet_length("items") + F.octet_length("parents") + F.octet_length("edges") + 100)).first()[0] or 0
    # Groups are dealt by hash: with half the budget on average, none comes near it by more than chance.
    groups = 1 if size <= broadcast_bytes else -(-2 * size // broadcast_bytes)
    cells = lambda asks, trees: asks.join(F.broadcast(trees), ["combo", "value", "piece"]).select("items", "parents", "edges", "fps").mapInArrow(_cells(radius), LINKS)
    if groups == 1:
        return cells(asks, trees)
    spark = fps.sparkSession
    of = F.pmod(F.xxhash64("combo", "value", "piece"), F.lit(groups)).cast("int").alias("of_group")
    asks = scratch.stored(asks.select("*", of).repartition("of_group", F.col("block") % 16).drop("block").select("combo", "value", "piece", "fps", "of_group"), "simhash-asks", "of_group")
    dealt = scratch.stored(trees.select("*", of).repartition("of_group"), "simhash-tree-groups", "of_group")
    scratch.forget(trees, sized)
    path = scratch.new_path(spark, "simhash-links")
    for g in range(groups):
        own = F.col("of_group") == g
        cells(asks.filter(own).drop("of_group"), dealt.filter(own).drop("of_group")).write.mode("append").parquet(path)
    scratch.forget(asks, dealt)
    return spark.read.schema(LINKS).parquet(path)


def _labelled(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp of every row; and fp, root, component_id of every fingerprint. Both in shared files."""
    own = scratch.stored(fingerprints(docs, shingle), "fingerprints")
    nodes = scratch.stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    stars = roots(links(nodes.select("fp"), radius), "simhash-stars")
    rooted = nodes.join(stars, nodes["fp"] == stars["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return own, scratch.stored(rooted.join(named, "root").select("fp", "root", "component_id"), "simhash-labels")


def cluster(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (smallest doc_id reachable over links, itself included)."""
    own, labels = _labelled(docs, shingle, radius)
    return own.join(labels.drop("root"), "fp").select("doc_id", "fp", "component_id")


def keep(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` of each component: that whose doc_id names it, all its columns.

    An id that names a component and stands in one row tells its row. Ids in several rows, and null ids, don't: of the
    rows with such an id their fingerprints tell the component, and the least digest of all columns the row that stays.
    """
    return named_rows(docs, *_labelled(docs, shingle, radius), lambda t: fingerprint(t, shingle))


def named_rows(docs: DataFrame, own: DataFrame, labels: DataFrame, mark=None) -> DataFrame:
    """``keep`` from own (doc_id, fp) and labels (fp, root, component_id); ``mark`` gives a text's fp, without it fp is the text's xxhash64."""
    found = own.join(labels, "fp")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.expr("doc_id <=> component_id")).alias("names")).filter("names")
    ids = scratch.stored(ids.select(F.col("doc_id").alias("_kept_id"), (F.expr("doc_id is not null and n = 1")).alias("_sure")), "simhash-kept")
    sure, other = ids.filter("_sure"), ids.filter("not _sure")
    mine = docs["doc_id"].cast("long")
    few = sure.count() * ID_BYTES <= BROADCAST_BYTES
    kept = docs.join(F.broadcast(sure) if few else sure, mine == sure["_kept_id"], "left_semi")
    if other.isEmpty():
        return kept
    row = F.struct(*(docs[c] for c in docs.columns))
    rows = docs.join(other, mine.eqNullSafe(other["_kept_id"]), "left_semi").select(mine.alias("doc_id"), docs["text"].cast("string").alias("text"), row.alias("row"))
    schema = rows.select("doc_id", "row", F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([mark(t) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fps], names=["doc_id", "row", "fp"])

    marked = rows.mapInArrow(run, schema) if mark else rows.select("doc_id", "row", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"))
    told = marked.join(labels, "fp").filter("doc_id <=> component_id")
    one = told.groupBy("root").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return kept.unionByName(one.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))


def op8_simhash(spark, sf_dir) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

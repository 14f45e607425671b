"""Keep-first dedup: exact by hash, near by SimHash bands, and the greedy choice as a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.functions import text as X


def first_per_hash(df: DataFrame, digest: str, position: str) -> DataFrame:
    """Adds ``kept``: the first row of each hash by position. An aggregate and a join, so copies never meet in one window."""
    firsts = df.groupBy(digest).agg(F.min(position).alias("_first"))
    return df.join(firsts, digest).withColumn("kept", F.col(position) == F.col("_first")).drop("_first")


def band_pairs(sigs: DataFrame, sig: str, position: str, within: int = 3) -> DataFrame:
    """Pairs (earlier, later, distance) of positions whose signatures differ in at most ``within`` bits: such two agree in two of ``within`` + 2 segments.

    Complete. Rows of one signature are represented by their first, and a bucket, about 25 bits wide for 3, is met only by
    distinct signatures, so copies make no pairs among themselves.
    """
    own = scratch.stored(sigs.groupBy(F.col(sig).alias("s")).agg(F.min(position).alias("p")), "distinct-signatures")
    banded = own.select("s", "p", F.posexplode(X.segment_pairs(F.col("s"), within)).alias("band", "value"))
    a, b = banded.alias("a"), banded.alias("b")
    near = X.hamming(F.col("a.s"), F.col("b.s"))
    found = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.p") < F.col("b.p")) & (near <= within))
    return found.select(F.col("a.p").alias("earlier"), F.col("b.p").alias("later"), near.alias("distance")).distinct()


#: Rounds before components are cut; pairs of a component that one task settles by a pass in order.
FIRST_ROUNDS, ONE_TASK = 2, 200_000


def _settled(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A round: what has no undecided earlier neighbour is kept and drops its later ones. What is dropped (p), and the pairs still open."""
    blocked = left.select(F.col("later").alias("earlier")).distinct()
    sure = left.select("earlier").distinct().join(blocked, "earlier", "left_anti")
    gone = scratch.stored(left.join(sure, "earlier").select(F.col("later").alias("p")).distinct(), "greedy-round")
    # Pairs with a dropped end are settled, and so are those of a node that is surely kept.
    rest = left.join(gone.withColumnRenamed("p", "earlier"), "earlier", "left_anti").join(gone.withColumnRenamed("p", "later"), "later", "left_anti")
    return gone, scratch.stored(rest.select("earlier", "later"), "greedy-left")


def labelled(pairs: DataFrame) -> DataFrame:
    """The pairs with ``root``, the smallest node that their ends reach.

    Each node points at its smallest neighbour, all pointers are followed to their ends by doubling, and pairs of
    pointed-at nodes go to the next round. What points at itself has no smaller neighbour, on a chain every second node
    at most, so a chain's rounds are the logarithm of its length; a star takes two.
    """
    links = scratch.stored(pairs.select(F.col("earlier").alias("u"), F.col("later").alias("v")), "component-links")
    names = None  # node to its root so far
    while links.limit(1).count():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The smallest of a node and its neighbours; the smallest of a neighbourhood points at itself or at a smaller one, so there is no circle.
        up = scratch.stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up")), "component-pointers")
        while True:
            far = up.select(F.col("node").alias("_n"), F.col("up").alias("_up"))
            up = scratch.stored(up.join(far, F.col("up") == F.col("_n")).select("node", F.col("_up").alias("up"), (F.col("up") != F.col("_up")).alias("moved")), "component-pointers")
            if not up.filter("moved").limit(1).count():
                break
        up = up.select("node", "up")
        at = lambda side: up.select(F.col("node").alias(f"_{side}"), F.col("up").alias(f"_{side}_up"))  # noqa: B023, E731
        moved = links.join(at("u"), F.col("u") == F.col("_u")).join(at("v"), F.col("v") == F.col("_v")).select(F.col("_u_up").alias("u"), F.col("_v_up").alias("v"))
        links = scratch.stored(moved.filter("u <> v").distinct(), "component-links")
        if names is None:
            names = up
        else:
            top = up.select(F.col("node").alias("_n"), F.col("up").alias("_up"))
            names = names.join(top, F.col("up") == F.col("_n"), "left").select("node", F.coalesce("_up", "up").alias("up"))
        names = scratch.stored(names, "component-names")
    if names is None:
        return pairs.withColumn("root", F.col("earlier"))
    return pairs.join(names.select(F.col("node").alias("earlier"), F.col("up").alias("root")), "earlier")


def _pass(batches):
    """Dropped nodes of components (root, later, earlier), sorted: a node is dropped when an earlier neighbour is kept."""
    import itertools

    import pyarrow as pa

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for _, component in itertools.groupby(rows, key=lambda r: r[0]):
        dropped = set()
        for later, pairs in itertools.groupby(component, key=lambda r: r[1]):
            if any(earlier not in dropped for _, _, earlier in pairs):
                dropped.add(later)
        yield pa.RecordBatch.from_pydict({"p": pa.array(sorted(dropped), pa.int64())})


def greedy_keep(nodes: DataFrame, pairs: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Positions (``p``) that a pass in order would keep: kept when no earlier neighbour is kept.

    Two rounds settle most nodes. What is left is cut into connected components; those of at most ``one_task`` pairs are
    settled by a pass in order, each in one task, and only larger ones go on in rounds. So a chain of near copies costs
    rounds by the logarithm of its length. Tables are written to the shared folder; the driver sees one count a round.
    """
    spark = nodes.sparkSession
    left = scratch.stored(pairs.select("earlier", "later"), "greedy-pairs")
    path, some, rounds = scratch.new_path(spark, "greedy-dropped"), False, 0
    while left.limit(1).count():
        if rounds == FIRST_ROUNDS:
            named = scratch.stored(labelled(left).select("root", F.col("later").cast("long"), F.col("earlier").cast("long")), "greedy-components")
            sizes = named.groupBy("root").agg(F.count("*").alias("_n"))
            split = scratch.stored(named.join(sizes, "root").select("root", "later", "earlier", (F.col("_n") <= one_task).alias("small")), "greedy-components")
            small = split.filter("small").select("root", "later", "earlier").repartition("root").sortWithinPartitions("root", "later", "earlier")
            small.mapInArrow(_pass, "p long").write.mode("append").parquet(path)
            some = True
            left = scratch.stored(split.filter("not small").select("earlier", "later"), "greedy-left")
        else:
            gone, left = _settled(left)
            gone.select(F.col("p").cast("long")).write.mode("append").parquet(path)
            some = True
        rounds += 1
    return nodes.select("p").join(spark.read.parquet(path), "p", "left_anti") if some else nodes.select("p")


def deduplicate(df: DataFrame, position: str, text: str, signature, within: int = 3) -> DataFrame:
    """Adds ``text_sha256`` and ``decision`` (kept, exact, near): exact copies first, then the greedy choice among the rest.

    Copies of a text that is near a kept one are near it too. Hashes and signatures are computed once, in one pass over
    the texts; what follows works on (position, hash, signature).
    """
    own = scratch.stored(df.select(F.col(position).alias("p"), X.content_hash(F.col(text)).alias("h"), signature.alias("s")), "signatures")
    hashed = first_per_hash(own, "h", "p")
    firsts = hashed.filter("kept").groupBy("s").agg(F.min("p").alias("p"))
    firsts = scratch.stored(firsts, "first-signatures")
    chosen = greedy_keep(firsts, band_pairs(firsts, "s", "p", within)).withColumn("_k", F.lit(True))
    by_hash = hashed.filter("kept").select("h", "p").join(chosen, "p", "left").select(F.col("h").alias("_h"), F.coalesce("_k", F.lit(False)).alias("_k"))
    told = hashed.join(by_hash, F.col("h") == F.col("_h")).select("p", "h", F.when(~F.col("_k"), "near").when(F.col("kept"), "kept").otherwise("exact").alias("decision"))
    return df.join(told.select(F.col("p").alias(position), F.col("h").alias("text_sha256"), "decision"), position)


def counters(decided: DataFrame) -> DataFrame:
    """seen, exact_duplicates, approx_duplicates, written."""
    n = lambda d: F.count_if(F.col("decision") == d)
    return decided.agg(F.count("*").alias("seen"), n("exact").alias("exact_duplicates"), n("near").alias("approx_duplicates"), n("kept").alias("written"))

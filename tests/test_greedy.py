"""The greedy choice against a pass in order: chains, random graphs, large components, nothing at all."""

import random

import pytest

from siltstone.operators import dedup


def plain(n, pairs):
    kept, near = set(), {}
    for a, b in pairs:
        near.setdefault(b, []).append(a)
    for p in range(n):
        if not any(a in kept for a in near.get(p, [])):
            kept.add(p)
    return kept


def keep(spark, n, pairs, **more):
    got = dedup.greedy_keep(spark.range(n).withColumnRenamed("id", "p"), spark.createDataFrame(pairs, "earlier long, later long"), **more)
    return {r["p"] for r in got.collect()}


def test_long_chain(spark, monkeypatch):
    made, stored = [], dedup.scratch.stored
    monkeypatch.setattr(dedup.scratch, "stored", lambda df, name: made.append(name) or stored(df, name))
    pairs = [(i, i + 1) for i in range(4999)]
    assert keep(spark, 5000, pairs) == plain(5000, pairs)
    assert made.count("greedy-round") == 2 and len(made) < 60
    made.clear()
    order = list(range(1500))
    random.Random(1).shuffle(order)
    pairs = [tuple(sorted(x)) for x in zip(order, order[1:], strict=False)]
    assert keep(spark, 1500, pairs) == plain(1500, pairs) and len(made) < 80


@pytest.mark.parametrize("one_task", [200_000, 8, 0])
def test_random_graphs(spark, one_task):
    rng = random.Random(one_task)
    pairs = sorted({tuple(sorted(rng.sample(range(k * 60, k * 60 + 40), 2))) for k in range(6) for _ in range(20 * k)} | {(i, i + 1) for i in range(400, 430)})
    assert keep(spark, 500, pairs, one_task=one_task) == plain(500, pairs)
    assert keep(spark, 5, [], one_task=one_task) == set(range(5))


def test_rerank_bounds(spark):
    """Every query's best by brute force, with ties, queries without hits and without terms; where terms are as unequal as in texts, far fewer pairs are scored than share one."""
    import math
    import re

    from siltstone.operators import control

    rng = random.Random(5)
    words = [f"w{int(3000 * rng.random() ** 3)}" for _ in range(4000)]
    docs = [(i, " ".join(rng.sample(words, rng.randrange(1, 40))).upper() if i % 17 else "!!") for i in range(500)] + [(600 + i, "the common one") for i in range(30)]
    asks = [(i, docs[i * 9][1] + " the extra") for i in range(40)] + [(90, "nowhere"), (91, ""), (92, "common one"), (93, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asks, "query_id long, query string")
    terms = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    want = set()
    for i, query in asks:
        own = terms(query)
        scored = sorted((-len(own & terms(t)) / math.sqrt(len(own) * len(terms(t))) if own and terms(t) else 0.0, k) for k, t in docs)
        want |= {(i, k, round(-x, 12), n + 1) for n, (x, k) in enumerate(scored[:7])}
    got = {(r["query_id"], r["doc_id"], round(r["score"], 12), r["rank"]) for r in control.rerank(q, d, 7).collect()}
    assert got == want
    pairs, _, _ = control.rerank_candidates(q, d, 7, 30)
    sharing = sum(bool(terms(a) & terms(t)) for _, a in asks for _, t in docs)
    assert pairs.count() < 0.7 * sharing

"""Cache control-plane state: prefix lookup, paging, policy rules, sampling filters, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.functions import text as X


def exact_lookup(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Requests (tenant_id, model_id, prefix_hash) with the reference of the entry of the same key."""
    return requests.join(index.select("tenant_id", "model_id", "prefix_hash", "kv_ref"), ["tenant_id", "model_id", "prefix_hash"], "left")


def near_lookup(requests: DataFrame, index: DataFrame, within: int = 3) -> DataFrame:
    """Per request (``request_id``, ``sig``) the entry of its tenant and model at the least distance up to ``within``; the earliest (``seq``) of ties.

    Signatures that close agree in all but ``within`` of ``within`` + 2 segments, so the join is on tenant, model and the bits of
    two segments, not on all of a tenant's entries.
    """
    banded = lambda df, s: df.select("*", F.posexplode(X.segment_pairs(F.col(s), within)).alias("band", "bits"))
    a, b = banded(requests, "sig").alias("a"), banded(index, "sig").alias("b")
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("tenant_id", "model_id", "band", "bits")]
    d = X.hamming(F.col("a.sig"), F.col("b.sig"))
    best = a.join(b, keys).filter(d <= within).groupBy("a.request_id").agg(F.min(F.struct(d.alias("distance"), F.col("b.seq").alias("seq"), F.col("b.kv_ref").alias("kv_ref"))).alias("m"))
    return best.select("request_id", "m.distance", "m.kv_ref")


def lookup(requests: DataFrame, index: DataFrame, within: int = 3) -> DataFrame:
    """request_id, kv_ref, match: exact first, near where there is none."""
    firsts = index.groupBy("tenant_id", "model_id", "prefix_hash").agg(F.max_by("kv_ref", "seq").alias("kv_ref"))
    exact = exact_lookup(requests, firsts)
    near = near_lookup(exact.filter("kv_ref is null").drop("kv_ref"), index, within).select("request_id", F.col("kv_ref").alias("near_ref"))
    return exact.join(near, "request_id", "left").select("request_id", F.coalesce("kv_ref", "near_ref").alias("kv_ref"), F.when(F.col("kv_ref").isNotNull(), "exact").when(F.col("near_ref").isNotNull(), "near").otherwise("miss").alias("match"))


def admit(requests: DataFrame, models: DataFrame, index: DataFrame, pages: DataFrame, budget: float, within: int = 3) -> DataFrame:
    """Policy decision, prefix hit and allocation of each request (request_id, tenant_id, model_id, prefix_hash, sig, context, requests).

    Pressure is what pages (tier, n_bytes) hold in the ``gpu`` tier against the budget: one aggregate row, so the cross
    join with it adds none. ``models`` has a row a model_id: mode, fp8. A request of an unknown model isn't admitted.
    """
    used = pages.agg(F.coalesce(F.sum(F.when(F.col("tier") == "gpu", F.col("n_bytes"))), F.lit(0)).alias("_used"))
    own = requests.join(models.select("model_id", "mode", "fp8"), "model_id").crossJoin(F.broadcast(used)).withColumn("p", pressure(F.col("_used"), F.lit(float(budget))))
    hits = lookup(requests.select("request_id", "tenant_id", "model_id", "prefix_hash", "sig"), index, within)
    return decide(own).drop("_used", "prefix_hash", "sig").join(hits, "request_id").withColumn("allocation_id", F.concat(F.lit("kva_"), F.sha2(F.col("request_id").cast("string"), 256))).withColumn("token_count", F.col("context").cast("long"))


def evict(pages: DataFrame, need: int, group: str, order: list[str | Column], size: str = "n_bytes") -> DataFrame:
    """The least recently used pages of each group that free ``need`` bytes: those before whom less has been freed."""
    past = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("freed_before", F.coalesce(F.sum(size).over(past), F.lit(0))).filter(F.col("freed_before") < need)


def overlapping(pages: DataFrame, asks: DataFrame, window: int, width: int = 1024) -> DataFrame:
    """Pages (request_id, page_id, start, end) that meet [pos, pos + window] of an ask of their request.

    Both sides are cut in bins of ``width``, so the join is on request and bin; a pair counts in its first common bin.
    """
    lo, hi = F.expr(f"start div {width}"), F.expr(f"end div {width}")
    p = pages.withColumn("bin", F.explode(F.sequence(lo, hi)))
    a = asks.withColumn("last", F.col("pos") + window).withColumn("bin", F.explode(F.sequence(F.expr(f"pos div {width}"), F.expr(f"(pos + {window}) div {width}"))))
    j = a.join(p, ["request_id", "bin"]).filter((F.col("start") <= F.col("last")) & (F.col("end") >= F.col("pos")))
    return j.filter(F.col("bin") == F.greatest(F.expr(f"start div {width}"), F.expr(f"pos div {width}"))).select("request_id", "pos", "page_id")


def pressure(used: Column, budget: Column) -> Column:
    return F.when(budget <= 0, F.lit(0.0)).otherwise(F.least(F.lit(2.0), used / budget))


#: The policy's outcomes. Fields, then per rule their values (an expression over p, long, fp8 where they vary).
POLICY_FIELDS = ("codec", "bits", "residual_ratio", "recent_window", "hot_fraction", "prune_fraction", "to_cpu", "to_nvme", "prefetch_tokens")
POLICY = {
    "quality": ("if(fp8, 'fp8', 'turboquant')", "4", "0.004D", "1024", "0.2D", "0.0D", "false", "false", "2048"),
    "memory": ("'turboquant'", "if(p >= 0.98, 2, 3)", "0.001D", "256", "0.08D", "if(p >= 0.98, 0.2D, 0.1D)", "true", "p >= 0.98", "512"),
    "throughput": ("'turboquant'", "3", "0.001D", "384", "0.1D", "if(long, 0.05D, 0.0D)", "p >= 0.8", "false", "768"),
    "balanced": ("if(long, 'turboquant', 'fp8')", "if(p < 0.75, 4, 3)", "0.002D", "if(long, 512, 768)", "0.12D", "if(p >= 0.82, 0.05D, 0.0D)", "p >= 0.86", "false", "1024"),
}

#: The reason that each rule states.
REASONS = {
    "quality": "quality_first under available GPU memory",
    "memory": "memory pressure requires aggressive KV compression and pruning",
    "throughput": "throughput/concurrency favors smaller KV and predictable paging",
    "balanced": "balanced policy",
}


def decide(df: DataFrame) -> DataFrame:
    """Adds the policy decision of rows with mode, p (pressure), requests, context, fp8, and its reason."""
    own = df.withColumn("long", F.col("context") >= 8192).withColumn("many", F.col("requests") >= 16)
    rule = F.expr("case when mode = 'quality_first' and p < 0.72 and not many then 'quality' when mode = 'memory_first' or p >= 0.9 then 'memory' when mode = 'throughput_first' or many then 'throughput' else 'balanced' end")
    own = own.withColumn("rule", rule)
    for i, name in enumerate(POLICY_FIELDS):
        own = own.withColumn(name, F.expr("case rule " + " ".join(f"when '{k}' then {v[i]}" for k, v in POLICY.items()) + " end"))
    reason = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    return own.withColumn("reason", F.element_at(reason, F.col("rule"))).drop("long", "many")


#: The quantisation planner's outcomes in their order; data types; reasons.
DTYPES = {"bf16": "bfloat16", "fp16": "float16", "fp8": "float8", "int4": "int4_awq", "int8": "int8"}
PLAN_REASONS = {"quality_first": "quality_first auto policy", "memory_first": "memory_first auto policy", "throughput_first": "throughput_first auto policy"}
PLAN = """
case when requested <> 'auto' then
  case when requested = 'fp8' and not fp8 then if(hardware = 'cpu', 'int8', 'fp16')
       when requested = 'int4' and not int4 then 'int8'
       when requested = 'bf16' and not bf16 then if(hardware = 'cuda', 'fp16', 'int8') else requested end
 when policy = 'quality_first' then case when bf16 then 'bf16' when hardware = 'cuda' then 'fp16' else 'int8' end
 when policy = 'memory_first' then if(int4, 'int4', 'int8')
 when policy = 'throughput_first' then case when fp8 then 'fp8' when int4 then 'int4' else 'int8' end
 when fp8 and memory_gb >= min_memory_gb then 'fp8'
 when int4 and memory_gb < greatest(1.0, min_memory_gb * 1.25) then 'int4'
 when bf16 then 'bf16' when hardware = 'cuda' then 'fp16' else 'int8' end
"""


def plan_quantization(df: DataFrame) -> DataFrame:
    """Adds ``selected``, its data type, load format, cache type and reason for models (requested, policy, min_memory_gb, prequantized) on hardware (hardware, memory_gb, fp8, int4, bf16)."""
    own = df.withColumn("selected", F.expr(PLAN))
    fmt = F.expr("case selected when 'fp8' then if(prequantized, 'fp8', 'safetensors') when 'int4' then if(prequantized, 'awq', 'safetensors') when 'int8' then if(prequantized, 'int8', 'bitsandbytes') else 'safetensors' end")
    dtype = F.element_at(F.create_map(*(F.lit(x) for pair in DTYPES.items() for x in pair)), F.col("selected"))
    reason = F.when(F.col("requested") != "auto", "registry requested mode")
    for mode, text in PLAN_REASONS.items():
        reason = reason.when(F.col("policy") == mode, text)
    own = own.withColumns({"load_format": fmt, "dtype": dtype, "kv_dtype": F.when(F.col("selected") == "fp8", "fp8").otherwise("auto"), "reason": reason.otherwise("balanced auto policy")})
    return own.withColumn("quantize", F.expr("selected in ('fp8', 'int4', 'int8') and not prequantized"))


def nucleus(df: DataFrame, group: str, token: str, logit: str, temperature: float, top_k: int, top_p: float, suppressed: tuple = ()) -> DataFrame:
    """Tokens that sampling may draw, with probability: suppress, temper, top k, softmax, then drop what lies past ``top_p`` (never the first)."""
    own = df.filter(~F.col(token).isin(*suppressed)) if suppressed else df
    by = Window.partitionBy(group).orderBy(F.desc(logit), token)
    own = own.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= (1 if temperature <= 0 else top_k))
    w = Window.partitionBy(group)
    e = F.exp((F.col(logit) - F.max(logit).over(w)) / max(temperature, 1e-9))
    own = own.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w))
    run = F.sum("p").over(by.rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("_run", run).filter((F.col("_run") <= top_p) | (F.col("rank") == 1))
    return own.withColumn("probability", F.col("_e") / F.sum("_e").over(w)).drop("_e", "_run", "p")


def tiers(df: DataFrame, group: str, position: str, score: str, recent: int, hot_fraction: float) -> DataFrame:
    """Adds ``tier``: the last ``recent`` positions; of older ones the best-scored share hot; the rest cold."""
    w = Window.partitionBy(group)
    own = df.withColumn("_n", F.count("*").over(w)).withColumn("_back", F.row_number().over(w.orderBy(F.desc(position))))
    own = own.withColumn("_hot", F.row_number().over(Window.partitionBy(group, F.col("_back") <= recent).orderBy(F.desc(score), F.desc(position))))
    tier = F.when(F.col("_back") <= recent, "recent").when(F.col("_hot") <= F.ceil(F.col("_n") * hot_fraction), "hot").otherwise("cold")
    return own.withColumn("tier", tier).drop("_n", "_back", "_hot")


def pruned(df: DataFrame, group: str, position: str, score: str, recent: int, fraction: float) -> DataFrame:
    """Adds ``prune``: the lowest-scored older positions, so many as the fraction (0.8 at most) asks."""
    w = Window.partitionBy(group)
    own = df.withColumn("_n", F.count("*").over(w)).withColumn("_back", F.row_number().over(w.orderBy(F.desc(position))))
    own = own.withColumn("_low", F.row_number().over(Window.partitionBy(group, F.col("_back") <= recent).orderBy(score, position)))
    most = F.least(F.floor(F.col("_n") * min(fraction, 0.8)), F.greatest(F.lit(0), F.col("_n") - recent))
    return own.withColumn("prune", (F.col("_back") > recent) & (F.col("_low") <= most)).drop("_n", "_back", "_low")


#: Postings of a query's rarest terms that give its first bound, at least.
SEEDS = 200


def rerank_candidates(queries: DataFrame, docs: DataFrame, top: int, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs (query_id, doc_id) that may be among a query's ``top``, and the stored queries and documents with their terms.

    An inverted index (term, doc_id, dn) is read by rarity. The rarest terms of a query, until they have ``seeds``
    postings, give candidates whose exact scores bound it: its ``top``-th best score so far is ``theta``. A document of dn
    terms that reaches theta shares at least t = theta * sqrt(qn * dn) terms with the query, so dn lies between
    theta^2 * qn and qn / theta^2, and it holds one of the qn - t + 1 rarest terms. A term past that place for every
    possible length isn't looked up at all, and of the others' postings only those whose length asks for the place.
    """
    q = scratch.stored(queries.select("query_id", X.terms(F.col("query")).alias("qt")).withColumn("qn", F.size("qt")), "rerank-queries")
    d = scratch.stored(docs.select("doc_id", X.terms(F.col("text")).alias("dt")).withColumn("dn", F.size("dt")).filter("dn > 0"), "rerank-documents")
    index = d.select("doc_id", "dn", F.explode("dt").alias("term"))
    asked = q.select("query_id", "qn", F.explode("qt").alias("term"))
    held = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    own = Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "term")  # a row a term of one query
    ranked = asked.join(held, "term", "left").withColumns({"place": F.row_number().over(own), "_before": F.coalesce(F.sum("df").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    ranked = scratch.stored(ranked.filter("df is not null"), "rerank-terms")
    first = ranked.filter(F.col("_before") < seeds).select("query_id", "term").join(index.select("term", "doc_id"), "term").select("query_id", "doc_id").distinct()
    by = Window.partitionBy("query_id").orderBy(F.desc("score"))
    bound = rerank_scores(first, q, d).withColumn("_r", F.row_number().over(by)).filter(F.col("_r") == top).select(F.col("query_id").alias("_q"), F.col("score").alias("theta"))
    terms = ranked.join(bound, F.col("query_id") == F.col("_q"), "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)) * (1 - 1e-12)).drop("_q")
    low = F.col("theta") * F.col("theta") * F.col("qn")
    terms = scratch.stored(terms.filter(F.col("place") <= F.col("qn") - F.ceil(low - 1e-6) + 1).select("query_id", "qn", "term", "place", "theta", low.alias("low")), "rerank-looked-up")
    dn, least = F.col("dn"), F.ceil(F.col("theta") * F.sqrt(F.col("qn") * F.col("dn")) - 1e-6)
    fits = (dn >= F.col("low") - 1e-6) & (F.col("theta") * F.col("theta") * dn <= F.col("qn") + 1e-6) & (F.col("place") <= F.col("qn") - least + 1)
    return terms.join(index, "term").filter(fits).select("query_id", "doc_id").distinct(), q, d


def rerank_scores(pairs: DataFrame, q: DataFrame, d: DataFrame) -> DataFrame:
    """query_id, doc_id, score of pairs that share a term."""
    common = F.size(F.array_intersect("qt", "dt"))
    return pairs.join(q, "query_id").join(d, "doc_id").select("query_id", "doc_id", (common / F.sqrt(F.col("qn") * F.col("dn"))).alias("score"))


def rerank(queries: DataFrame, docs: DataFrame, top: int) -> DataFrame:
    """Per query (query_id, query) its ``top`` documents (doc_id, text) by shared terms over the root of both counts; ties in doc_id order.

    Documents without a shared term score 0 and only matter where a query has fewer than ``top`` others: such queries are
    filled from the first ``top`` documents by id, which is all that is broadcast.
    """
    pairs, q, d = rerank_candidates(queries, docs, top)
    scored = rerank_scores(pairs, q, d)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    best = scratch.stored(scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top), "rerank-best")
    short = q.select("query_id").join(best.groupBy("query_id").agg(F.count("*").alias("_n")), "query_id", "left").filter(F.coalesce("_n", F.lit(0)) < top).select("query_id")
    first = docs.select("doc_id").orderBy("doc_id").limit(top)
    zero = short.crossJoin(F.broadcast(first)).join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return best.drop("rank").unionByName(zero).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)


def histogram(df: DataFrame, group: str, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts up to each bound, and all, per group."""
    return df.groupBy(group).agg(*(F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)), F.count("*").alias("n"), F.sum(value).alias("total"))


#: Upper bounds of the latency buckets, in seconds.
LATENCY = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30)


def registry(df: DataFrame, labels: list[str], order: str, counted: list[str] = (), gauged: list[str] = ()) -> DataFrame:
    """Metrics per label set: rows seen (``requests``), sums of the counters, and of each gauge the value that was set last."""
    return df.groupBy(*labels).agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in counted), *(F.max_by(g, F.when(F.col(g).isNotNull(), F.col(order))).alias(g) for g in gauged))


def ranked(df: DataFrame, value: str, order: list[str], within: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0 by value, then ``order``) and ``n`` per group, by prefix sums over ordered ranges: no task holds a group's values."""
    from siltstone.operators import packing

    sizes = df.groupBy(*within).agg(F.count(value).alias("n")) if within else df.agg(F.count(value).alias("n"))
    placed = packing.offsets(df.filter(F.col(value).isNotNull()).withColumn("_one", F.lit(1)), "_one", [value, *order], within).withColumnRenamed("start", "rank").drop("_one")
    return placed.join(sizes, within) if within else placed.crossJoin(F.broadcast(sizes))


def quantiles(df: DataFrame, value: str, order: list[str], within: list[str]) -> DataFrame:
    """Per group its median (``p50``) and the value at place floor(0.95 (n - 1)) of all in order (``p95``), exact."""
    r = ranked(df, value, order, within)
    middle = F.col("rank").between(F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2))
    high = F.col("rank") == F.floor(F.lit(0.95) * (F.col("n") - 1))
    return r.filter(middle | high).groupBy(*within).agg(F.max("n").alias("n"), F.avg(F.when(middle, F.col(value))).alias("p50"), F.max(F.when(high, F.col(value))).alias("p95"))


def load_stats(samples: DataFrame, latency: str, tokens: str, order: list[str], within: list[str], elapsed: Column) -> DataFrame:
    """A load test's figures per group: requests, rps, tokens_per_s, p50, p95; ``elapsed`` is an aggregate, in seconds."""
    sums = samples.groupBy(*within).agg(F.count("*").alias("requests"), (F.count("*") / elapsed).alias("rps"), (F.sum(tokens) / elapsed).alias("tokens_per_s"))
    return sums.join(quantiles(samples.select(*within, latency, *order), latency, order, within).drop("n"), within)


def reuse(looked_up: DataFrame, ref: str = "kv_ref") -> DataFrame:
    """lookups, hits and their ratio (0 without lookups)."""
    n = looked_up.agg(F.count("*").alias("lookups"), F.count(ref).alias("hits"))
    return n.withColumn("rate", F.when(F.col("lookups") == 0, 0.0).otherwise(F.col("hits") / F.col("lookups")))


def evict_tenant(index: DataFrame, tenant: str) -> tuple[DataFrame, int]:
    """The index without a tenant's entries, and how many those were."""
    gone = F.col("tenant_id").eqNullSafe(F.lit(tenant))
    return index.filter(~gone), index.filter(gone).count()


#: The tier below each.
BELOW = (("gpu", "cpu"), ("cpu", "nvme"))


def demote(pages: DataFrame, need: int, order: list[str], size: str = "n_bytes") -> DataFrame:
    """Pages (``tier``) with ``to_tier``: the least recently used of each tier that free ``need`` bytes move one tier down (gpu, cpu, nvme, then null: deleted); others stay.

    What is freed before a page follows from prefix sums over ordered ranges, so a tier with most pages is no single task's work.
    """
    from siltstone.operators import packing

    placed = packing.offsets(pages, size, order, ["tier"])
    below = F.coalesce(*(F.when(F.col("tier") == a, b) for a, b in BELOW))
    return placed.withColumn("to_tier", F.when(F.col("start") < need, below).otherwise(F.col("tier"))).drop("start")


def energy(df: DataFrame, group: str, key: Column, value: Column) -> DataFrame:
    """Adds ``energy``: mean absolute key plus mean absolute value of each token, scaled to 0..1 within its group where they differ."""
    mean = lambda a: F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size(a)
    own = df.withColumn("_e", mean(key) + mean(value))
    ends = own.groupBy(group).agg(F.min("_e").alias("_lo"), F.max("_e").alias("_hi"))
    own = own.join(ends, group)
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("_e") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col("_e"))
    return own.withColumn("energy", scaled).drop("_e", "_lo", "_hi")


def remove(rows: DataFrame, released: DataFrame, *keys: str) -> DataFrame:
    return rows.join(released.select(*keys), list(keys), "left_anti")


def zip_segments(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Segments joined by page and number; a segment on one side only is an error."""
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), list(keys), "full")
    return both.withColumn("_ok", F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit("segments differ"))).filter(F.col("_ok").isNull()).drop("_l", "_r", "_ok")


def chat_prompt(turns: DataFrame) -> DataFrame:
    """conv_id, prompt: role-tagged turns in order, and an open assistant tag."""
    by = F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text").alias("line"))))
    return turns.groupBy("conv_id").agg(F.concat(F.concat_ws("\n", F.transform(by, lambda t: t["line"])), F.lit("\n<|assistant|>\n")).alias("prompt"))


def context_prompt(turns: DataFrame) -> DataFrame:
    """conv_id, prompt: assistant turns, then user turns, if an assistant spoke; else the last user turn; else all turns."""
    own = turns.select("conv_id", "turn", F.lower(F.trim("role")).alias("role"), F.trim("text").alias("text")).filter("text <> ''")
    pick = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("turn", "text")))), lambda t: t["text"])
    g = own.groupBy("conv_id").agg(pick(F.col("role") == "assistant").alias("a"), pick(F.col("role") == "user").alias("u"), pick(F.lit(True)).alias("every"))
    return g.select("conv_id", F.when(F.size("a") > 0, F.concat_ws("\n\n", F.concat("a", "u"))).when(F.size("u") > 0, F.element_at("u", -1)).otherwise(F.concat_ws("\n\n", "every")).alias("prompt"))

"""Tokenise and pack: whole texts to token ids, a split by hash, blocks and shards per split, counters."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import scratch
from siltstone.functions import bpe
from siltstone.functions import text as X
from siltstone.functions import udfs as U
from siltstone.operators import packing

#: Largest tokenizer description that is broadcast; its size doesn't grow with the data. Texts encoded at once. Fewest tokens of a row that is packed. Pre-tokens in a generation of a worker's cache.
MOST_BYTES, RUN, LEAST, CACHED = 64 << 20, 64, 2, 150_000

_workers: dict[str, object] = {}


def _shared(spark: SparkSession, tokenizer_json: str):
    """The broadcast description and its key."""
    if len(tokenizer_json) > MOST_BYTES:
        raise ValueError("tokenizer description too large to broadcast")
    return spark.sparkContext.broadcast(tokenizer_json), hashlib.sha256(tokenizer_json.encode()).hexdigest()


def _tokenizer(shared, key: str):
    """This worker's tokenizer, on one thread: Spark's tasks have the cores already."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if key not in _workers:
        _workers.clear()
        _workers[key] = Tokenizer.from_str(shared.value)
    return _workers[key]


def _ids(shared, key: str) -> Callable[[list[str]], list]:
    """Texts to arrays of their ids: through a cache of pre-tokens where the description allows it, else by the library alone."""
    import numpy as np

    tok = _tokenizer(shared, key)
    if (kind := f"{key} cached") not in _workers:
        _workers[kind] = bpe.Encoder(None, tok, CACHED) if bpe.byte_level(json.loads(shared.value)) else None
    cached = _workers[kind]
    if cached is None:
        return lambda texts: [np.array(e.ids, np.int32) for e in tok.encode_batch_fast(texts)]
    return lambda texts: [np.frombuffer(cached.encode(t), "<u4").astype(np.int32) for t in texts]


def encoder(spark: SparkSession, tokenizer_json: str):
    """Column function: ids of whole texts under a tokenizer's JSON, special tokens as its template adds them; null stays null."""
    shared, key = _shared(spark, tokenizer_json)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        from siltstone.operators import tokenize as own

        texts, out = s.tolist(), []
        for i in range(0, len(texts), RUN):
            got = own._tokenizer(shared, key).encode_batch_fast([t or "" for t in texts[i : i + RUN]])
            out += [None if t is None else e.ids for t, e in zip(texts[i : i + RUN], got, strict=True)]
        return pd.Series(out, index=s.index, dtype=object)

    return run


def _placed(shared, key: str, nulls: bool):
    """Rows in order (the text last, the split before it) to rows with their ids, and how many tokens of rows that are packed came before in the split and task. Few texts at a time become Python objects, and their ids don't stay such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from siltstone.operators import tokenize as own

        encode, before = own._ids(shared, key), {}
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                part = part if nulls else part.filter(part.column("text").is_valid())
                texts, splits = part.column("text").to_pylist(), part.column("split").to_pylist()
                ids = encode([t or "" for t in texts])
                ids = [i[:0] if t is None else i for t, i in zip(texts, ids, strict=True)]
                local = []
                for s, i in zip(splits, ids, strict=True):
                    local.append(before.get(s, 0))
                    before[s] = local[-1] + (len(i) if len(i) >= LEAST else 0)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([t is None for t in texts], pa.bool_()))
                names = part.schema.names[:-1]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(local, pa.int64())], names=[*names, "ids", "_local"])

    return run


def tokenized(docs: DataFrame, split: Column, tokenizer_json: str, order: list[str], text: str = "text", clean: Callable[[Column], Column] | None = None) -> DataFrame:
    """order, split, ids of every row, with its place, stored: encoding runs once, whatever reads it afterwards.

    Texts are dealt to ranges of ``order`` and sorted before they are encoded, so each task's rows follow one another and
    ``packed`` needn't move their tokens to put them in order. ``clean`` makes a text of the raw one, null where it is to be left out.
    """
    place = [*order, F.xxhash64(text)]  # rows of one place are split by their texts' hash
    dealt = docs.repartitionByRange(*place).sortWithinPartitions(*place)
    own = dealt.select(*order, F.spark_partition_id().alias("_part"), split.alias("split"), (clean(F.col(text)) if clean else F.col(text)).alias("text"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("_local", T.LongType())])
    return scratch.stored(own.mapInArrow(_placed(*_shared(docs.sparkSession, tokenizer_json), clean is None), schema), "tokenized")


def hash_split(docs: DataFrame, fraction: float, text: str = "text") -> Column:
    """``val`` where the source says so (source_split is ``validation``), else by the content hash (text_sha256 where there is one)."""
    content = F.col("text_sha256") if "text_sha256" in docs.columns else X.content_hash(F.col(text))
    drawn = U.split_of(fraction)(content)
    return F.when(F.col("source_split") == "validation", "val").otherwise(drawn) if "source_split" in docs.columns else drawn


def counters(rows: DataFrame) -> DataFrame:
    """Per split: documents and tokens of rows with two tokens or more, and how many have fewer."""
    enough = F.coalesce(F.size("ids"), F.lit(0)) >= LEAST
    return rows.groupBy("split").agg(F.count_if(enough).alias("documents"), F.coalesce(F.sum(F.when(enough, F.size("ids"))), F.lit(0)).cast("long").alias("tokens"), F.count_if(~enough).alias("skipped"))


def packed(rows: DataFrame, order: list[str], length: int, blocks_per_shard: int, overlap: bool) -> DataFrame:
    """split, block, shard, tokens: blocks of length + 1 tokens per split, rows in ``order``; ``blocks_per_shard`` a shard."""
    kept = rows.filter(F.size("ids") >= LEAST)
    made = packing.placed_blocks(kept, "ids", length, overlap, ["split"]) if "_part" in rows.columns else packing.blocks(kept, "ids", order, length, overlap, ["split"])
    return made.withColumn("shard", F.expr(f"cast(block div {max(1, blocks_per_shard)} as int)"))


def shards(blocks: DataFrame) -> DataFrame:
    """A row a shard: blocks, tokens."""
    return blocks.groupBy("split", "shard").agg(F.count("*").alias("blocks"), F.sum(F.size("tokens")).cast("long").alias("tokens"))


def corpus(docs: DataFrame, tokenizer_json: str, order: list[str], length: int, blocks_per_shard: int, fraction: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Normalised records to disjoint blocks and counters."""
    rows = tokenized(docs, hash_split(docs, fraction), tokenizer_json, order)
    return packed(rows, order, length, blocks_per_shard, False), counters(rows)


def web_corpus(docs: DataFrame, split: Column, tokenizer_json: str, order: list[str], length: int, blocks_per_shard: int, least: int = 200) -> tuple[DataFrame, DataFrame]:
    """Raw web texts, normalised and filtered, to overlapping blocks and counters; null texts count as empty and are filtered."""
    rows = tokenized(docs, split, tokenizer_json, order, clean=lambda t: X.web_text(t, least))
    return packed(rows, order, length, blocks_per_shard, True), counters(rows)


def behaviour(prompts: DataFrame, tokenizer_json: str, prompt: str = "prompt") -> DataFrame:
    """prompt, token_count, tokens, ids of each row, special tokens as the description adds them."""
    shared = prompts.sparkSession.sparkContext.broadcast(tokenizer_json)

    @F.pandas_udf(T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    def run(s: pd.Series) -> pd.DataFrame:
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(shared.value)
        found = [own.encode(t or "") for t in s]
        return pd.DataFrame({"tokens": [e.tokens for e in found], "ids": [e.ids for e in found]})

    rows = prompts.select(F.col(prompt).alias("prompt"), run(F.col(prompt)).alias("e"))
    return rows.select("prompt", F.size("e.ids").alias("token_count"), "e.tokens", "e.ids")


def evaluation(docs: DataFrame, tokenizer_json: str, order: list[str], sample: int | None = 2000, examples: int = 20, text: str = "text") -> tuple[dict, list[dict]]:
    """A tokenizer's figures over the first ``sample`` texts in order (all: None), and its first segmentations.

    Ratios are of sums: characters per token, tokens per word (a text counts one word at least), unknown tokens, tokens
    of one character (without the sign for a space).
    """
    from tokenizers import Tokenizer

    known = Tokenizer.from_str(tokenizer_json)
    unknown = known.token_to_id("<unk>")
    first = docs.orderBy(*order) if sample is None else docs.orderBy(*order).limit(sample)
    told = behaviour(scratch.stored(first.select(*order, F.col(text).alias("prompt")), "evaluated"), tokenizer_json)
    single = F.size(F.filter("tokens", lambda t: F.length(F.replace(t, F.lit("Ġ"), F.lit(""))) <= 1))
    odd = F.size(F.filter("ids", lambda i: i == F.lit(unknown))) if unknown is not None else F.lit(0)
    n = told.agg(
        F.count("*").alias("sample_count"), F.sum(F.length("prompt")).alias("total_sample_chars"), F.sum("token_count").alias("total_sample_tokens"), F.sum(F.greatest(F.lit(1), X.word_count(F.col("prompt")))).alias("words"), F.sum(odd).alias("unknown"), F.sum(single).alias("single")
    ).first()
    tokens = max(1, n["total_sample_tokens"] or 0)
    report = {
        "sample_count": n["sample_count"], "vocab_size": known.get_vocab_size(), "average_chars_per_token": (n["total_sample_chars"] or 0) / tokens, "fertility_tokens_per_word": (n["total_sample_tokens"] or 0) / max(1, n["words"] or 0),
        "unk_token_rate": (n["unknown"] or 0) / tokens, "single_char_token_rate": (n["single"] or 0) / tokens, "total_sample_chars": n["total_sample_chars"] or 0, "total_sample_tokens": n["total_sample_tokens"] or 0,
    }
    shown = behaviour(docs.orderBy(*order).limit(examples).select(F.col(text).alias("prompt")), tokenizer_json).collect()
    return report, [{"text_preview": r["prompt"][:200], "tokens": r["tokens"][:80], "token_count": r["token_count"], "chars_per_token": len(r["prompt"]) / max(1, r["token_count"])} for r in shown]


def epochs(docs: DataFrame, tokenizer_json: str, order: list[str], length: int, n: int, least: int = 50) -> DataFrame:
    """``n`` passes over raw web texts as one stream of overlapping blocks (block, tokens): what an epoch leaves over begins the next one's first block. Texts are tokenised once."""
    rows = tokenized(docs, F.lit("train"), tokenizer_json, order, clean=lambda t: X.web_text(t, least))
    passes = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return packing.blocks(passes, "ids", ["epoch", *order], length, True)


def job(spark: SparkSession, splits: dict[str, list[str]], tokenizer_json: str, out: str, length: int, blocks_per_shard: int, max_docs: dict[str, int] | None = None, least: int = 200, resume: bool = True) -> dict:
    """Files of each split, in natural order, to blocks below ``out``; the manifest of what is there.

    ``max_docs`` takes the first documents of a split. A split whose tables are complete is not made again when a job is resumed.
    """
    from siltstone.sources import scans

    made = {}
    for split, paths in splits.items():
        if not paths:
            raise FileNotFoundError(f"no files of split {split}")
        blocks_at, counts_at = f"{out}/{split}/blocks", f"{out}/{split}/counters"
        if not (resume and scans.discover(spark, counts_at, "_SUCCESS")):
            docs = scans.parquet(spark, sorted(paths, key=scans.natural_key), ["text"], limit=(max_docs or {}).get(split))
            seen = scratch.stored(docs.select("path_no", "source_path", "source_row", "text"), "job-texts")
            blocks, counted = web_corpus(seen, F.lit(split), tokenizer_json, ["path_no", "source_path", "source_row"], length, blocks_per_shard, least)
            blocks.write.mode("overwrite").parquet(blocks_at)
            counted.crossJoin(seen.agg(F.count("*").alias("seen"))).write.mode("overwrite").parquet(counts_at)
        n = spark.read.parquet(counts_at).first()
        parts = shards(spark.read.parquet(blocks_at)).orderBy("shard").collect()
        made[split] = {"stats": n.asDict() if n else {}, "shards": [r.asDict() for r in parts]}
    every = [s for m in made.values() for s in m["shards"]]
    return {"stage": "tokenize", "complete": True, "length": length, "splits": made, "total_blocks": sum(s["blocks"] for s in every), "total_tokens": sum(s["tokens"] for s in every)}

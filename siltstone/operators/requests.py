"""Requests to a model server as rows: prompts, token limits, contracts, tenants, structured output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_embedding(text: Column, dimensions: int) -> Column:
    """A unit vector from SHA-256: bytes of the digests of ``text:0``, ``text:1`` ..., each from -1 to 1."""
    digests = F.concat(*(F.sha2(F.concat(text, F.lit(f":{i}")), 256) for i in range(-(-dimensions // 32))))
    byte = lambda i: F.conv(F.substring(digests, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), byte)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(raw, lambda v: v / F.when(norm == 0, 1.0).otherwise(norm))


def embedding_inputs(value: Column) -> Column:
    """The texts that a JSON value asks to embed: a text itself; token ids as one text; lists of ids as a text each; a list's items."""
    flat = F.trim(value)
    items, lists = F.from_json(flat, "array<string>"), F.from_json(flat, "array<array<string>>")
    text = F.element_at(F.from_json(F.concat(F.lit("["), flat, F.lit("]")), "array<string>"), 1)
    ids = flat.rlike("^\\[\\s*-?\\d+\\s*(,\\s*-?\\d+\\s*)*\\]$")
    nested = F.forall(items, lambda x: x.startswith("[")) & ~flat.rlike('^\\[\\s*"')
    listed = F.when(F.size(items) == 0, items).when(ids, F.array(F.array_join(items, " "))).when(nested, F.transform(lists, lambda x: F.array_join(x, " "))).otherwise(items)
    return F.when(flat.startswith("["), listed).otherwise(F.array(text))


def prompt_ids(ids: Column, begin: int, end: int) -> Column:
    """Token ids without the ``end`` ids at their end; only ``begin`` where nothing is left."""
    last = F.coalesce(F.array_max(F.transform(ids, lambda x, i: F.when(x != end, i + 1).otherwise(0))), F.lit(0))
    return F.when(last == 0, F.array(F.lit(begin).cast("int"))).otherwise(F.slice(ids.cast("array<int>"), F.lit(1), last))


def suppressed_ids(pad: int | None, begin: int | None) -> list[int]:
    """Ids that generation never draws."""
    return sorted({i for i in (pad, begin) if i is not None})


def token_limit(completion: Column, tokens: Column, otherwise: int = 256) -> Column:
    """The first of both limits that is set (0 counts as unset)."""
    return F.coalesce(F.nullif(completion, F.lit(0)), F.nullif(tokens, F.lit(0)), F.lit(otherwise))


def parts_text(parts: Column) -> Column:
    """Text of a message in parts (structs with ``text``): those that are there, space-joined."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), " ")


#: What a control message says, and the formats that ask for JSON.
TOOLS_LINE, FORMAT_LINE = "Available tools must be called with JSON: ", "Respond with JSON that conforms to: "
JSON_FORMATS = ("json_object", "json_schema")


def _asks_json(response_format: Column) -> Column:
    return F.coalesce(F.get_json_object(response_format, "$.type").isin(*JSON_FORMATS), F.lit(False))


def with_control(turns: DataFrame, asks: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with a system turn ahead for conversations whose ask (conv_id, tools, response_format: JSON or null) needs one."""
    tools = F.when(F.col("tools").isNotNull(), F.concat(F.lit(TOOLS_LINE), "tools"))
    form = F.when(_asks_json(F.col("response_format")), F.concat(F.lit(FORMAT_LINE), "response_format"))
    first = turns.groupBy("conv_id").agg((F.min("turn") - 1).alias("turn"))
    ahead = asks.select("conv_id", F.concat_ws("\n", tools, form).alias("text")).filter("text <> ''").join(first, "conv_id")
    return turns.select("conv_id", "turn", "role", "text").unionByName(ahead.select("conv_id", "turn", F.lit("system").alias("role"), "text"))


def answer_kind(text: Column, tools: Column, response_format: Column) -> Column:
    """What a generated text is: tool_calls, content, or invalid where JSON was asked for and it isn't."""
    parsed = F.try_parse_json(text)
    calls = F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, "$.tool_calls", "variant")).startswith("ARRAY"), F.lit(False))
    return F.when(tools.isNotNull() & calls, "tool_calls").when(_asks_json(response_format) & parsed.isNull(), "invalid").otherwise("content")


#: Backends that are known without being named.
BACKENDS = ("dev", "vllm", "transformers")


def admitted_models(asks: DataFrame, models: DataFrame, backends: tuple[str, ...] = BACKENDS) -> DataFrame:
    """Requests (model_id, task_type) with their model's backend and why they are refused: unknown_model, wrong_task, unknown_backend, kv_contract; null if they aren't.

    Models have model_id, task, backend, kv_required, kv_mode, forced: a model that needs its cache compressed runs on
    ``dev``, on ``vllm`` with fp8, or where the plain cache is forced.
    """
    m = models.select("model_id", F.col("task").alias("_task"), "backend", "kv_required", "kv_mode", "forced")
    kept = ~F.col("kv_required") | (F.col("backend") == "dev") | ((F.col("backend") == "vllm") & (F.col("kv_mode") == "fp8")) | F.col("forced")
    refused = F.when(F.col("_task").isNull(), "unknown_model").when(F.col("_task") != F.col("task_type"), "wrong_task").when(~F.col("backend").isin(*backends), "unknown_backend").when(~kept, "kv_contract")
    return asks.join(m, "model_id", "left").withColumn("refused", refused).drop("_task", "kv_required", "kv_mode", "forced")


def token_map(text: str, production: bool = False) -> dict[str, str]:
    """``tenant:token`` pairs, comma-separated; a later pair of a tenant replaces its earlier one."""
    pairs: dict[str, str] = {}
    for part in filter(None, map(str.strip, text.split(","))):
        tenant, colon, token = part.partition(":")
        if not (colon and tenant and token):
            raise ValueError("tokens are tenant:token pairs, separated by commas")
        pairs[tenant] = token
    if production and pairs == {"dev": "dev-token"}:
        raise ValueError("production needs tokens of its own")
    return pairs


def authenticated(asks: DataFrame, pairs: dict[str, str], token: str = "token") -> DataFrame:
    """Requests with the first tenant whose token they bring and the token's short hash; both null where there is none."""
    spark: SparkSession = asks.sparkSession
    first: dict[str, str] = {}
    for tenant, own in pairs.items():
        first.setdefault(own, tenant)
    known = spark.createDataFrame(list(first.items()) or [("", None)], f"{token} string, tenant_id string")
    own = asks.join(F.broadcast(known), token, "left")
    return own.withColumn("token_hash", F.when(F.col("tenant_id").isNotNull(), F.left(F.sha2(token, 256), F.lit(16))))

"""All queries of the library by name, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.functions import numbers as N
from siltstone.functions import text as X
from siltstone.functions import udfs as U
from siltstone.operators import catalog, codecs, control, dedup, normalize, packing, profile, requests, telemetry, tokenize
from siltstone.sources import scans, sinks
from siltstone.streaming import prefixes, ranges, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: SQL spellings that several oracles share. White space of the canonical form, letters, and what both leave.
_CANON = "lower(trim(regexp_replace(text, '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}\\x0b]+', ' ', 'g')))"
_LET, _ALN = "length(regexp_replace(text, '[^\\pL]', '', 'g'))", "length(regexp_replace(text, '[^\\pL\\pN]', '', 'g'))"
_SOLID = "length(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', '', 'g'))"
_LOW = f"(length(text) = 0 OR length(regexp_replace(text, '[\\pC\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', '', 'g')) + length(regexp_replace(text, '[^\\n]', '', 'g')) < 0.98 * length(text) OR (length(text) > 80 AND len(list_distinct(string_split(text, ''))) <= 4) OR (length(text) > 200 AND {_LET} < 0.05 * length(text)))"
_KEEP = f"(length(text) >= 200 AND {_SOLID} > 0 AND {_LET} >= 0.20 * {_SOLID} AND {_ALN} >= 0.35 * {_SOLID})"
_WORDS = "len(regexp_extract_all(text, '[\\pL\\pN_]+'))"


# Hashes, copies, scalars over documents.
@query(f"WITH h AS (SELECT doc_id, lang, sha256({_CANON}) AS h FROM documents), k AS (SELECT h, min(doc_id) AS d FROM h GROUP BY h) SELECT lang, count(*) AS n_docs, count(k.d) AS n_kept FROM h LEFT JOIN k ON h.doc_id = k.d GROUP BY lang")
def doc_hash_exact_dedup(spark, t):
    hashed = scratch.stored(t("documents").select("doc_id", "lang", X.content_hash(F.col("text")).alias("h")), "hashed")
    d = dedup.first_per_hash(hashed, "h", "doc_id")
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if("kept").alias("n_kept"))


@query(f"SELECT sha256({_CANON}) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY h HAVING count(*) > 1 ORDER BY n DESC, first_id LIMIT 20")
def dup_groups_top(spark, t):
    g = t("documents").groupBy(X.content_hash(F.col("text")).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return g.filter("n > 1").orderBy(F.desc("n"), "first_id").limit(20)


@query(f"SELECT doc_id, {_WORDS} AS n_words, len(regexp_extract_all(text, '\\S+')) AS n_runs, len(regexp_extract_all({_CANON}, '[\\pL\\pN_]+|[^\\pL\\pN_\\s]')) AS n_tokens FROM documents")
def word_and_token_counts(spark, t):
    c = F.col("text")
    return t("documents").select("doc_id", X.word_count(c).cast("long").alias("n_words"), X.solid_runs(c).cast("long").alias("n_runs"), F.size(X.hash_tokens(c)).cast("long").alias("n_tokens"))


@query(f"SELECT doc_id, {_LOW} AS low_value FROM documents")
def doc_quality_flags(spark, t):
    return t("documents").select("doc_id", X.looks_low_value(F.col("text")).alias("low_value"))


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE {_KEEP}) AS n_kept FROM documents GROUP BY lang")
def c4_keep_filter(spark, t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(X.keep_text(F.col("text"))).alias("n_kept"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g'), '[ \\t\\r\\f\\x0b]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS h FROM documents")
def c4_normalized(spark, t):
    return t("documents").select("doc_id", F.sha2(X.normalize_web(F.col("text")), 256).alias("h"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) <= 400 THEN text ELSE left(text, 200) || chr(10) || right(text, 200) END) AS h FROM documents")
def simhash_sample(spark, t):
    return t("documents").select("doc_id", F.sha2(X.sample_ends(F.col("text"), 400), 256).alias("h"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_terms FROM documents")
def term_counts(spark, t):
    return t("documents").select("doc_id", F.size(X.terms(F.col("text"))).cast("long").alias("n_terms"))


@query("""WITH x AS (SELECT doc_id, text, list_min(list_filter([instr(text, '. '), instr(text, ' the '), instr(text, chr(10))], lambda i: i > 0)) AS p FROM documents)
SELECT doc_id, CAST(coalesce(p - 1, length(text)) AS BIGINT) AS n_chars_kept, CASE WHEN p IS NULL THEN 'length' ELSE 'stop' END AS finish FROM x""")
def stop_sequences(spark, t):
    cut, met = X.cut_at_stop(F.col("text"), [". ", " the ", "\n", ""])
    return t("documents").select("doc_id", F.length(cut).cast("long").alias("n_chars_kept"), F.when(met, "stop").otherwise("length").alias("finish"))


@query("SELECT doc_id, printf('%s:chunk-%04d', CAST(doc_id AS VARCHAR), CAST(doc_id % 37 AS INTEGER)) AS id, CAST(coalesce(TRY_CAST(regexp_extract(trim(text), '^([0-9]{4})', 1) AS BIGINT), 0) AS BIGINT) AS y, lower(source) IN ('src1', 'src2') AS allowed FROM documents")
def record_fields(spark, t):
    return t("documents").select("doc_id", X.record_id(F.col("doc_id"), (F.col("doc_id") % 37).cast("int")).alias("id"), F.coalesce(X.year_of(F.col("text")), F.lit(0)).cast("long").alias("y"), X.allowed(F.col("source"), ["SRC1", "Src2"]).alias("allowed"))


@query("SELECT lang, CASE WHEN ('0x' || left(sha256(CAST(doc_id AS VARCHAR)), 8))::BIGINT < 429496730 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY ALL")
def split_counts(spark, t):
    draw = F.conv(F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(8)), 16, 10).cast("long")
    return t("documents").groupBy("lang", F.when(draw < 429496730, "val").otherwise("train").alias("split")).agg(F.count("*").alias("n"))


@query()
def hash_split(spark, t):
    return t("documents").select("doc_id", U.split_of(0.01)(X.content_hash(F.col("text"))).alias("split"))


# Filters with reasons, records, counters.
_RULES = normalize.Rules(languages=("EN", "de", "fr"), collection_blocks=("SRC3",), min_chars=200, min_words=20)


@query(f"""SELECT CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN NOT coalesce(lower(lang) IN ('en', 'de', 'fr'), false) THEN 'language_filtered' WHEN lower(source) = 'src3' THEN 'collection_filtered'
  WHEN length(text) < 200 THEN 'too_short' WHEN length(text) > 6000 THEN 'too_long' WHEN {_WORDS} < 20 THEN 'too_few_words' WHEN {_LOW} THEN 'low_value' ELSE 'written' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def filter_reasons(spark, t):
    rules = normalize.Rules(**{**_RULES.__dict__, "chunking": False})
    d = normalize.documents(t("documents"), rules, clean=False)
    return normalize.counters(d.withColumn("reason", F.coalesce("reason", normalize.chunk_reason(F.col("clean_text"), rules))))


@query()
def normalized_records(spark, t):
    return normalize.records(t("documents"), _RULES)


@query()
def record_counters(spark, t):
    return normalize.stage_counters(t("documents"), _RULES)


@query()
def page_text(spark, t):
    return t("pages").select("page_id", F.length(U.normalized(F.col("html"))).cast("long").alias("n_chars"))


# Windows of 6000 characters that end past 2000, at the last blank line, else sentence end; 400 characters overlap.
_WINDOW = "substr(text, CAST(s + 2001 AS BIGINT), 4000)"
_STOP = f"CASE WHEN s + 6000 >= n THEN n WHEN instr(reverse({_WINDOW}), chr(10) || chr(10)) > 0 THEN s + 6000 - instr(reverse({_WINDOW}), chr(10) || chr(10)) WHEN instr(reverse({_WINDOW}), ' .') > 0 THEN s + 6000 - instr(reverse({_WINDOW}), ' .') ELSE s + 6000 END"
_CHUNKS = f"""WITH RECURSIVE w AS (SELECT doc_id, text, n, s, {_STOP} AS stop FROM (SELECT doc_id, text, length(text) AS n, 0::BIGINT AS s FROM documents) WHERE n > 6000 UNION ALL SELECT doc_id, text, n, s, {_STOP} FROM (SELECT doc_id, text, n, greatest(stop - 400, s + 1) AS s FROM w WHERE stop < n)),
p AS (SELECT doc_id, s, regexp_replace(substr(text, CAST(s + 1 AS BIGINT), CAST(stop - s AS BIGINT)), '^\\s+|\\s+$', '', 'g') AS text FROM w),
c AS (SELECT doc_id, 0 AS chunk, text FROM documents WHERE length(text) <= 6000 UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1, text FROM p WHERE text <> '') """


@query(_CHUNKS + "SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(length(text) AS BIGINT) AS n_chars FROM c")
def chunk_docs(spark, t):
    return t("documents").select("doc_id", F.posexplode(U.chunked(4000, 6000, 400)(F.col("text"))).alias("chunk", "text")).select("doc_id", "chunk", F.length("text").cast("long").alias("n_chars"))


_STAYS = "(SELECT doc_id AS d, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN NOT coalesce(lower(lang) IN ('en', 'de', 'fr'), false) THEN 'language_filtered' WHEN lower(source) = 'src3' THEN 'collection_filtered' END AS lost FROM documents)"
_CHUNK_REASON = f"CASE WHEN length(text) < 200 THEN 'too_short' WHEN {_WORDS} < 20 THEN 'too_few_words' WHEN {_LOW} THEN 'low_value' END"


@query(_CHUNKS + f"SELECT printf('%s:chunk-%04d', CAST(doc_id AS VARCHAR), CAST(chunk AS INTEGER)) AS id, sha256({_CANON}) AS text_sha256, CAST(length(text) AS BIGINT) AS char_count, CAST({_WORDS} AS BIGINT) AS word_count, {_CHUNK_REASON} AS reason FROM c JOIN {_STAYS} x ON c.doc_id = x.d WHERE lost IS NULL")
def raw_records(spark, t):
    r = normalize.records(t("documents"), _RULES, clean=False)
    return r.select("id", "text_sha256", F.col("char_count").cast("long").alias("char_count"), F.col("word_count").cast("long").alias("word_count"), "reason")


@query(_CHUNKS + f""", k AS (SELECT c.*, lost FROM c JOIN {_STAYS} x ON c.doc_id = x.d), m AS (SELECT doc_id, count(*) AS n FROM k WHERE lost IS NULL GROUP BY 1 HAVING count(*) > 1)
SELECT coalesce({_CHUNK_REASON}, 'written') AS reason, count(*) AS n FROM k WHERE lost IS NULL GROUP BY 1 UNION ALL SELECT lost, count(*) FROM {_STAYS} WHERE lost IS NOT NULL GROUP BY 1 UNION ALL SELECT 'seen', count(*) FROM documents UNION ALL SELECT 'oversized_docs_chunked', count(*) FROM m UNION ALL SELECT 'chunks_created', CAST(coalesce(sum(n), 0) AS BIGINT) FROM m""")
def raw_counters(spark, t):
    return normalize.stage_counters(t("documents"), _RULES, clean=False)


# Near duplicates.
@query()
def lsh_pairs(spark, t):
    sigs = scratch.stored(t("documents").select("doc_id", U.simhash(X.hash_tokens(X.sample_ends(F.col("text"), 200_000), 4096)).alias("s")), "signatures")
    return dedup.band_pairs(sigs, "s", "doc_id")


@query()
def neardup_keep(spark, t):
    d = dedup.deduplicate(t("documents").select("doc_id", "text"), "doc_id", "text", U.simhash(X.hash_tokens(X.sample_ends(F.col("text"), 200_000), 4096)))
    return d.select("doc_id", "text_sha256", "decision")


@query("SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.label * 37, b.label * 37)) AS BIGINT) AS d FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def label_hamming(spark, t):
    e = t("embeddings").select("vec_id", (F.col("label") * 37).alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("x").alias("y"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("a"), "b", X.hamming(F.col("x"), F.col("y")).cast("long").alias("d"))


# Signatures from the signs of a vector's components, so that SQL can hold the near-duplicate plans whole.
_SIGNED = "SELECT vec_id AS p, CAST(list_sum(list_transform(embedding[1:16], lambda x, i: CASE WHEN x > 0 THEN CAST(pow(2, 4 * (i - 1)) AS BIGINT) ELSE 0::BIGINT END)) AS BIGINT) AS s, sha256('v' || label || ':' || CAST(vec_id % 60 AS VARCHAR)) AS h FROM embeddings"


def _signed(t):
    signs = F.expr("aggregate(transform(slice(embedding, 1, 16), (x, i) -> if(x > 0, shiftleft(1L, 4 * i), 0L)), 0L, (a, b) -> a + b)")
    return t("embeddings").select("vec_id", F.concat(F.lit("v"), "label", F.lit(":"), (F.col("vec_id") % 60).cast("string")).alias("text"), signs.alias("s"))


@query(f"WITH x AS ({_SIGNED}), o AS (SELECT s, min(p) AS p FROM x GROUP BY s) SELECT a.p AS earlier, b.p AS later, CAST(bit_count(xor(a.s, b.s)) AS INTEGER) AS distance FROM o a JOIN o b ON a.p < b.p AND bit_count(xor(a.s, b.s)) <= 3")
def sign_pairs(spark, t):
    return dedup.band_pairs(_signed(t), "s", "vec_id")


_GREEDY = f"""WITH RECURSIVE x AS ({_SIGNED}), u AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY p) AS c, min(p) OVER (PARTITION BY h) AS f FROM x), o AS (SELECT p, s, row_number() OVER (ORDER BY p) AS i FROM u WHERE c = 1),
g AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS p, false AS kept, []::BIGINT[] AS held UNION ALL SELECT o.i, o.p, len(list_filter(held, lambda k: bit_count(xor(k, o.s)) <= 3)) = 0, CASE WHEN len(list_filter(held, lambda k: bit_count(xor(k, o.s)) <= 3)) = 0 THEN list_append(held, o.s) ELSE held END FROM g JOIN o ON o.i = g.i + 1),
d AS (SELECT u.p, CASE WHEN NOT g.kept THEN 'near' WHEN u.c = 1 THEN 'kept' ELSE 'exact' END AS decision FROM u JOIN g ON u.f = g.p) """


@query(_GREEDY + "SELECT p AS vec_id, decision FROM d")
def sign_dedup(spark, t):
    return dedup.deduplicate(_signed(t), "vec_id", "text", F.col("s")).select("vec_id", "decision")


@query(_GREEDY + "SELECT count(*) AS seen, count(*) FILTER (WHERE decision = 'exact') AS exact_duplicates, count(*) FILTER (WHERE decision = 'near') AS approx_duplicates, count(*) FILTER (WHERE decision = 'kept') AS written FROM d")
def dedup_counters(spark, t):
    return dedup.counters(dedup.deduplicate(_signed(t), "vec_id", "text", F.col("s")))


# Profiles.
@query("SELECT count(*) AS n, min(n)::DOUBLE AS lowest, max(n)::DOUBLE AS highest, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.01), 6) AS p01, round(quantile_cont(n, 0.05), 6) AS p05, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99 FROM (SELECT length(text)::DOUBLE AS n FROM documents)")
def length_profile(spark, t):
    p = profile.numeric(t("documents"), F.length("text"))
    return p.select("n", "lowest", "highest", *(F.round(c, 6).alias(c) for c in ("mean", "p01", "p05", "p50", "p95", "p99")))


@query("SELECT * FROM (UNPIVOT (SELECT count(*) FILTER (WHERE doc_id IS NULL) AS doc_id, count(*) FILTER (WHERE text IS NULL) AS text, count(*) FILTER (WHERE lang IS NULL) AS lang, count(*) FILTER (WHERE source IS NULL) AS source, count(*) FILTER (WHERE n_chars IS NULL) AS n_chars FROM documents) ON COLUMNS(*) INTO NAME \"column\" VALUE n_null)")
def null_profile(spark, t):
    return profile.nulls(t("documents"))


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE text = '') AS n_empty, count(*) FILTER (WHERE length(text) < 200) AS n_short, count(*) FILTER (WHERE regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) AS n_control, count(*) FILTER (WHERE contains(text, chr(65533))) AS n_encoding, count(*) - count(DISTINCT sha256({_CANON})) AS n_duplicate FROM documents")
def quality_profile(spark, t):
    return profile.quality(t("documents"), F.col("text"))


@query("SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY n DESC, min(doc_id) LIMIT 25")
def lang_top25(spark, t):
    return profile.top_values(t("documents"), "lang", "doc_id")


@query("SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, min(doc_id) LIMIT 25")
def source_top25(spark, t):
    return profile.top_values(t("documents"), "source", "doc_id")


# Packing of word tokens.
_TOK = "WITH w AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, regexp_extract_all(text, '\\S+') AS w FROM documents), x AS (SELECT split, doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM w), p AS (SELECT split, tok, row_number() OVER (PARTITION BY split ORDER BY doc_id, i) - 1 AS pos FROM x)"


def _tokens(t):
    return t("documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"), F.regexp_extract_all("text", F.lit("\\S+"), F.lit(0)).alias("tok"))


@query(f"{_TOK} SELECT split, pos // 129 AS block, sha256(string_agg(tok, ' ' ORDER BY pos)) AS h FROM p GROUP BY 1, 2 HAVING count(*) = 129")
def pack_disjoint(spark, t):
    b = packing.blocks(_tokens(t), "tok", ["doc_id"], 128, False, ["split"])
    return b.select("split", "block", F.sha2(F.array_join("tokens", " "), 256).alias("h"))


@query(f"{_TOK}, q AS (SELECT split, tok, pos, pos // 128 AS block FROM p UNION ALL SELECT split, tok, pos, pos // 128 - 1 FROM p WHERE pos > 0 AND pos % 128 = 0) SELECT split, block, sha256(string_agg(tok, ' ' ORDER BY pos)) AS h FROM q GROUP BY 1, 2 HAVING count(*) = 129")
def pack_overlap(spark, t):
    b = packing.blocks(_tokens(t), "tok", ["doc_id"], 128, True, ["split"])
    return b.select("split", "block", F.sha2(F.array_join("tokens", " "), 256).alias("h"))


@query(f"{_TOK}, n AS (SELECT split, count(*) // 129 AS b FROM p GROUP BY split) SELECT split, CAST(s AS BIGINT) AS shard, CAST(least(64, b - s * 64) AS BIGINT) AS blocks, CAST(least(64, b - s * 64) * 129 AS BIGINT) AS tokens FROM n, unnest(generate_series(0, (b - 1) // 64)) AS u(s)")
def pack_manifest(spark, t):
    b = packing.blocks(_tokens(t), "tok", ["doc_id"], 128, False, ["split"])
    return b.groupBy("split", F.expr("block div 64").alias("shard")).agg(F.count("*").alias("blocks"), F.sum(F.size("tokens")).alias("tokens"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 300 AS INTEGER) AS shard FROM documents")
def shard_numbers(spark, t):
    return sinks.numbered_shards(t("documents").select("doc_id"), ["doc_id"], 300)


@query("SELECT split, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, len(regexp_extract_all(text, '\\S+')) AS n FROM documents) GROUP BY ROLLUP (split)")
def tokenization_counters(spark, t):
    return _tokens(t).rollup("split").agg(F.count("*").alias("docs"), F.sum(F.size("tok")).alias("tokens"))


@query(f"SELECT sum(length(text))::DOUBLE / sum(n) AS chars_per_token, sum(n)::DOUBLE / sum(greatest(1, w)) AS fertility FROM (SELECT text, len(regexp_extract_all({_CANON}, '[\\pL\\pN_]+|[^\\pL\\pN_\\s]')) AS n, {_WORDS} AS w FROM documents)")
def tokenizer_report(spark, t):
    d = t("documents").select(F.length("text").alias("c"), F.size(X.hash_tokens(F.col("text"))).alias("n"), F.greatest(F.lit(1), X.word_count(F.col("text"))).alias("w"))
    return d.agg((F.sum("c") / F.sum("n")).alias("chars_per_token"), (F.sum("n") / F.sum("w")).alias("fertility"))


def _tokenizer() -> str:
    """The public byte-level BPE description that the queries below tokenise with; any other can be given to the operators."""
    from pathlib import Path

    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")


@query()
def tokenized_blocks(spark, t):
    b, _ = tokenize.corpus(t("documents").select("doc_id", "text"), _tokenizer(), ["doc_id"], 512, 64, 0.1)
    return b.select("split", "shard", "block", F.xxhash64("tokens").alias("h"))


@query()
def tokenized_counters(spark, t):
    return tokenize.corpus(t("documents").select("doc_id", "text"), _tokenizer(), ["doc_id"], 512, 64, 0.1)[1]


@query()
def web_blocks(spark, t):
    split = F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train")
    b, _ = tokenize.web_corpus(t("documents").select("doc_id", "text"), split, _tokenizer(), ["doc_id"], 256, 64)
    return tokenize.shards(b)


# Scans.
@query("WITH n AS (SELECT p_brand AS prefix, CAST(p_partkey % 40 AS INTEGER) AS number FROM part WHERE p_partkey % 7 <> 0 AND p_size % 3 = 0), d AS (SELECT DISTINCT prefix FROM n) SELECT prefix, CAST(s AS INTEGER) AS number FROM d, unnest(generate_series(0, 39)) AS u(s) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.prefix = d.prefix AND n.number = s)")
def shard_gap_report(spark, t):
    names = t("part").filter("p_partkey % 7 <> 0 and p_size % 3 = 0").select(F.format_string("%s-%05d-of-00040.parquet", "p_brand", (F.col("p_partkey") % 40).cast("int")).alias("name"))
    g = scans.numbering_gaps(names)
    return g.select(F.expr("substring(prefix, 1, length(prefix) - 1)").alias("prefix"), "number")


@query("SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 150)")
def first_rows(spark, t):
    return t("documents").select("doc_id").orderBy("doc_id").limit(150).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark, t):
    return scans.repeated(t("orders"), "o_custkey")


# Telemetry on events: a user's values are a run in the order of time.
@query("WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT user_id, event_id, i, value AS m FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, 0.08 * e.value + 0.92 * r.m FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT event_id, round(m, 6) AS ema FROM r")
def metric_ema(spark, t):
    placed = t("events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).select("user_id", "event_id", "i", "value")
    return telemetry.ema(placed, "user_id", "i", "value").select("event_id", F.round("ema", 6).alias("ema"))


@query("WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events), n AS (SELECT *, count(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM e) SELECT event_id, CASE WHEN count(v) OVER w >= 2 THEN round(stddev_pop(v) OVER w, 5) END AS rolling_std FROM n WINDOW w AS (PARTITION BY user_id ORDER BY c RANGE BETWEEN 24 PRECEDING AND CURRENT ROW)")
def metric_rolling_std(spark, t):
    e = t("events").select("event_id", "user_id", F.struct("ts", "event_id").alias("o"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("v"))
    return telemetry.rolling_std(e, "user_id", "o", "v").select("event_id", F.round("rolling_std", 5).alias("rolling_std"))


@query("SELECT event_id, round(value - lag(value) OVER w, 6) AS delta, round(sum(abs(value)) OVER w, 4) AS cumulative FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def metric_delta_cumsum(spark, t):
    e = t("events").select("event_id", "user_id", F.struct("ts", "event_id").alias("o"), "value", F.abs("value").alias("tok"))
    return telemetry.derived(e, "user_id", "o", "value", "tok").select("event_id", F.round("delta", 6).alias("delta"), F.round("cumulative", 4).alias("cumulative"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS repeated FROM events")
def metric_repeats(spark, t):
    return telemetry.repeated_steps(t("events"), "user_id", "event_type", "event_id").select("event_id", "repeated")


@query("SELECT event_id, value FROM events WHERE value >= 50 ORDER BY value DESC, event_id LIMIT 40")
def spikes_top40(spark, t):
    return t("events").filter("value >= 50").orderBy(F.desc("value"), "event_id").limit(40).select("event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 80")
def replay_last80(spark, t):
    return t("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(80).select("event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 250 OFFSET 100")
def visible_window(spark, t):
    return telemetry.visible(t("events").withColumn("o", F.struct("ts", "event_id")), "o", 100, 250).select("event_id", "value")


@query("""SELECT count(*) AS n_rows, min_by(event_id, event_id) AS first_step, max_by(event_id, event_id) AS latest_step, max_by(value, event_id) AS latest_loss, (SELECT value FROM events WHERE value <> 0 ORDER BY value, event_id LIMIT 1) AS best_loss,
 (SELECT event_id FROM events WHERE value <> 0 ORDER BY value, event_id LIMIT 1) AS best_step, round(quantile_cont(value, 0.5), 6) AS median_tokens, round(sum(value), 2) AS total_tokens, count(event_id) - count(DISTINCT event_id) AS repeated_steps FROM events""")
def metric_summary(spark, t):
    s = telemetry.summary(t("events").select("event_id", "value"), "event_id", "event_id", "value", "value")
    return s.withColumns({"median_tokens": F.round("median_tokens", 6), "total_tokens": F.round("total_tokens", 2)})


@query("WITH m AS (SELECT 'l_quantity' AS field, avg(l_quantity) AS s FROM lineitem WHERE l_quantity > 0 UNION ALL SELECT 'l_tax', avg(l_tax) FROM lineitem WHERE l_tax > 0 UNION ALL SELECT 'l_discount', avg(l_discount) FROM lineitem WHERE l_discount > 0) SELECT field, round(s, 6) AS mean_seconds, round(s / sum(s) OVER (), 6) AS share FROM m")
def timing_composition(spark, t):
    c = telemetry.composition(t("lineitem"), ["l_quantity", "l_tax", "l_discount"])
    return c.select("field", F.round("mean_seconds", 6).alias("mean_seconds"), F.round("share", 6).alias("share"))


@query("SELECT event_type, count(*) FILTER (WHERE value <= 1) AS le_0, count(*) FILTER (WHERE value <= 5) AS le_1, count(*) FILTER (WHERE value <= 25) AS le_2, count(*) FILTER (WHERE value <= 100) AS le_3, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def latency_histogram(spark, t):
    return control.histogram(t("events"), "event_type", "value", [1, 5, 25, 100]).withColumn("total", F.round("total", 2))


@query("SELECT event_type, round(list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1], 6) AS p95, round(median(value), 6) AS p50 FROM events GROUP BY 1")
def p95_floor(spark, t):
    q = control.quantiles(t("events").select("event_type", "value", "event_id"), "value", ["event_id"], ["event_type"])
    return q.select("event_type", F.round("p95", 6).alias("p95"), F.round("p50", 6).alias("p50"))


@query("SELECT event_type, count(*) AS requests, round(count(*) / 86400.0, 6) AS rps, round(sum(user_id) / 86400.0, 6) AS tokens_per_s, round(list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1], 6) AS p95, round(median(value), 6) AS p50 FROM events GROUP BY 1")
def load_stats(spark, t):
    r = control.load_stats(t("events"), "value", "user_id", ["event_id"], ["event_type"], F.lit(86400.0))
    return r.select("event_type", "requests", *(F.round(c, 6).alias(c) for c in ("rps", "tokens_per_s", "p95", "p50")))


@query("SELECT event_type, count(*) AS requests, CAST(sum(user_id) AS BIGINT) AS tokens, max_by(value, event_id) AS resident FROM (SELECT event_type, user_id, event_id, value FROM events) GROUP BY 1")
def metric_registry(spark, t):
    e = t("events").select("event_type", "event_id", F.col("user_id").alias("tokens"), F.col("value").alias("resident"))
    return control.registry(e, ["event_type"], "event_id", ["tokens"], ["resident"])


@query("SELECT event_id, round(exp(least(20, value)), 4) AS ppl, round(CASE WHEN event_id <= 100 THEN 0.0003 * event_id / 100 ELSE 0.0003 * greatest(0.1, 0.5 * (1 + cos(pi() * least(1.0, (event_id - 100) / 900.0)))) END, 12) AS lr_floor, round(CASE WHEN event_id < 100 THEN 0.0003 * event_id / 100 ELSE 0.00003 + 0.5 * (1 + cos(pi() * least(1.0, (event_id - 100) / 900.0))) * 0.00027 END, 12) AS lr_blend, round(CASE WHEN value > 10 THEN 10 / value ELSE 1 END, 9) AS clip, [1.0, 0.5, 0.25][least(event_id % 5, 2) + 1]::DOUBLE AS scale FROM events")
def schedules(spark, t):
    s = F.col("event_id")
    return t("events").select(
        "event_id", F.round(N.perplexity(F.col("value")), 4).alias("ppl"), F.round(N.rate_floor(s, 0.0003, 100, 1000, 0.1), 12).alias("lr_floor"), F.round(N.rate_blend(s, 0.0003, 100, 1000, 0.00003), 12).alias("lr_blend"), F.round(N.clip_scale(F.col("value"), 10.0), 9).alias("clip"), N.ladder([1.0, 0.5, 0.25], s % 5).alias("scale"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS none FROM events")
def tolerant_casts(spark, t):
    return t("events").select("event_id", N.finite(F.get_json_object("props", "$.k")).alias("k"), N.finite(F.col("event_type")).alias("none"))


# Conversations.
@query("SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) || chr(10) || '<|assistant|>' || chr(10) AS prompt FROM conversations GROUP BY 1")
def chat_prompt(spark, t):
    return control.chat_prompt(t("conversations"))


@query("WITH c AS (SELECT conv_id, turn, lower(trim(role)) AS role, trim(text) AS text FROM conversations WHERE trim(text) <> ''), g AS (SELECT conv_id, list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS a, list(text ORDER BY turn) FILTER (WHERE role = 'user') AS u, list(text ORDER BY turn) AS e FROM c GROUP BY 1) SELECT conv_id, CASE WHEN len(a) > 0 THEN array_to_string(list_concat(a, coalesce(u, [])), chr(10) || chr(10)) WHEN len(u) > 0 THEN u[-1] ELSE array_to_string(e, chr(10) || chr(10)) END AS prompt FROM g")
def context_prompt(spark, t):
    return control.context_prompt(t("conversations"))


@query("SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE len(regexp_extract_all(text, '\\S+')) END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(text, '\\S+')) ELSE 0 END) AS BIGINT) AS completion_tokens FROM conversations GROUP BY 1")
def usage_by_conv(spark, t):
    n = X.solid_runs(F.col("text"))
    return t("conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") != "assistant", n).otherwise(0)).cast("long").alias("prompt_tokens"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).cast("long").alias("completion_tokens"))


@query("SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')[1:12], ' ') AS head, CASE WHEN len(regexp_extract_all(text, '\\S+')) > 12 THEN 'length' ELSE 'stop' END AS finish FROM conversations")
def word_limit(spark, t):
    return t("conversations").select("conv_id", "turn", X.first_words(F.col("text"), 12).alias("head"), F.when(X.solid_runs(F.col("text")) > 12, "length").otherwise("stop").alias("finish"))


@query()
def story_prompts(spark, t):
    return t("conversations").select("conv_id", "turn", X.story_prompt(F.concat(F.lit("Tell me about a fox named "), "role", F.lit(" who lost his hat."))).alias("prompt"))


_TERMS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query(f"WITH q AS (SELECT item_id AS query_id, {_TERMS} AS t FROM benchmark), d AS (SELECT doc_id, {_TERMS} AS t FROM documents), s AS (SELECT query_id, doc_id, len(list_intersect(q.t, d.t)) / sqrt(len(q.t) * len(d.t)) AS score FROM q, d WHERE len(d.t) > 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) SELECT query_id, doc_id, round(score, 9) AS score, rank FROM r WHERE rank <= 10")
def rerank_topn(spark, t):
    q = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    r = control.rerank(q, t("documents"), 10)
    return r.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


# Paging, prefixes, rules.
@query("WITH o AS (SELECT o_orderkey, o_custkey % 50 AS g, CAST(o_totalprice AS BIGINT) AS b, o_orderdate FROM orders), r AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY g ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM o) SELECT o_orderkey, g, CAST(f AS BIGINT) AS freed_before FROM r WHERE f < 500000")
def lru_evict(spark, t):
    o = t("orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("g"), F.rint("o_totalprice").cast("long").alias("n_bytes"), "o_orderdate")  # halves to the even number, as SQL casts them
    return control.evict(o, 500000, "g", [F.asc_nulls_last("o_orderdate"), F.asc_nulls_last("o_orderkey")]).select("o_orderkey", "g", F.col("freed_before").cast("long").alias("freed_before"))


@query("WITH p AS (SELECT l_orderkey % 100 AS r, l_orderkey * 10 + l_linenumber AS page_id, CAST(l_partkey AS BIGINT) AS s, CAST(l_partkey + l_quantity AS BIGINT) AS e FROM lineitem), a AS (SELECT o_custkey % 100 AS r, CAST(o_orderkey % 2000 AS BIGINT) AS pos FROM orders) SELECT a.r AS request_id, pos, page_id FROM a JOIN p ON a.r = p.r AND s <= pos + 64 AND e >= pos")
def page_overlap(spark, t):
    p = t("lineitem").select((F.col("l_orderkey") % 100).alias("request_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page_id"), F.col("l_partkey").cast("long").alias("start"), (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("end"))
    a = t("orders").select((F.col("o_custkey") % 100).alias("request_id"), (F.col("o_orderkey") % 2000).cast("long").alias("pos"))
    return control.overlapping(p, a, 64, 256)


@query("SELECT o_orderstatus AS tier, count(*) AS pages, round(sum(o_totalprice), 2) AS bytes FROM orders GROUP BY 1")
def tier_bytes(spark, t):
    return t("orders").groupBy(F.col("o_orderstatus").alias("tier")).agg(F.count("*").alias("pages"), F.round(F.sum("o_totalprice"), 2).alias("bytes"))


@query(f"WITH i AS (SELECT source AS tenant, sha256({_CANON}) AS h, max_by(doc_id, doc_id) AS ref FROM documents WHERE doc_id % 2 = 0 GROUP BY 1, 2) SELECT d.doc_id AS request_id, i.ref AS kv_ref FROM (SELECT doc_id, source, sha256({_CANON}) AS h FROM documents WHERE doc_id % 2 = 1) d LEFT JOIN i ON d.source = i.tenant AND d.h = i.h")
def prefix_exact(spark, t):
    d = t("documents").select("doc_id", F.col("source").alias("tenant_id"), F.lit("m").alias("model_id"), X.content_hash(F.col("text")).alias("prefix_hash"))
    index = d.filter("doc_id % 2 = 0").groupBy("tenant_id", "model_id", "prefix_hash").agg(F.max("doc_id").alias("kv_ref"))
    return control.exact_lookup(d.filter("doc_id % 2 = 1"), index).select(F.col("doc_id").alias("request_id"), "kv_ref")


@query()
def prefix_lookup(spark, t):
    d = t("documents").select("doc_id", F.col("source").alias("tenant_id"), F.lit("m").alias("model_id"), X.content_hash(F.col("text")).alias("prefix_hash"), U.simhash(X.hash_tokens(F.col("text"), 2048)).alias("sig"))
    d = scratch.stored(d, "prefixes")
    index = d.filter("doc_id % 2 = 0").withColumns({"kv_ref": F.col("doc_id"), "seq": F.col("doc_id")})
    return control.lookup(d.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "request_id"), index)


@query("WITH x AS (SELECT vec_id, label, CAST(list_sum(list_transform(embedding[1:16], lambda x, i: CASE WHEN x > 0 THEN CAST(pow(2, 4 * (i - 1)) AS BIGINT) ELSE 0::BIGINT END)) AS BIGINT) AS s, vec_id % 45 AS h FROM embeddings), i AS (SELECT * FROM x WHERE vec_id % 2 = 0), r AS (SELECT * FROM x WHERE vec_id % 2 = 1), e AS (SELECT label, h, max(vec_id) AS ref FROM i GROUP BY 1, 2), n AS (SELECT r.vec_id, arg_min(i.vec_id, bit_count(xor(r.s, i.s)) * 10000000 + i.vec_id) AS ref FROM r JOIN i ON r.label = i.label AND bit_count(xor(r.s, i.s)) <= 3 GROUP BY 1) SELECT r.vec_id AS request_id, coalesce(e.ref, n.ref) AS kv_ref, CASE WHEN e.ref IS NOT NULL THEN 'exact' WHEN n.ref IS NOT NULL THEN 'near' ELSE 'miss' END AS match FROM r LEFT JOIN e ON r.label = e.label AND r.h = e.h LEFT JOIN n ON r.vec_id = n.vec_id")
def vector_prefixes(spark, t):
    signs = _signed(t).select("vec_id", F.col("s").alias("sig"))
    d = t("embeddings").select("vec_id", F.col("label").alias("tenant_id"), F.lit("m").alias("model_id"), (F.col("vec_id") % 45).alias("prefix_hash")).join(signs, "vec_id")
    d = scratch.stored(d, "prefixes")
    index = d.filter("vec_id % 2 = 0").withColumns({"kv_ref": F.col("vec_id"), "seq": F.col("vec_id")})
    return control.lookup(d.filter("vec_id % 2 = 1").withColumnRenamed("vec_id", "request_id"), index)


@query()
def admissions(spark, t):
    d = t("documents").select("doc_id", F.col("source").alias("tenant_id"), F.coalesce("lang", F.lit("none")).alias("model_id"), X.content_hash(F.col("text")).alias("prefix_hash"), U.simhash(X.hash_tokens(F.col("text"), 2048)).alias("sig"), (F.col("doc_id") * 7 % 16384).alias("context"), (F.col("doc_id") % 20).alias("requests"))
    d = scratch.stored(d, "admissions")
    models = d.select("model_id").distinct().select("model_id", F.expr("case when model_id < 'e' then 'memory_first' else 'balanced' end").alias("mode"), (F.length("model_id") % 2 == 0).alias("fp8"))
    pages = t("orders").select(F.when(F.col("o_orderstatus") == "F", "gpu").otherwise("cpu").alias("tier"), F.col("o_totalprice").alias("n_bytes"))
    index = d.filter("doc_id % 2 = 0").withColumns({"kv_ref": F.col("doc_id"), "seq": F.col("doc_id")})
    return control.admit(d.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "request_id"), models, index, pages, 2e9)


_MODE = "CASE c_custkey % 4 WHEN 0 THEN 'quality_first' WHEN 1 THEN 'memory_first' WHEN 2 THEN 'throughput_first' ELSE 'balanced' END"


@query(f"""WITH b AS (SELECT c_custkey, {_MODE} AS mode, CASE WHEN c_acctbal <= 0 THEN 0.0 ELSE least(2.0, (c_acctbal + 500) / 10000.0) END AS p, c_custkey % 20 AS requests, c_custkey * 7 % 16384 AS context, c_nationkey % 2 = 0 AS fp8 FROM customer),
r AS (SELECT *, CASE WHEN mode = 'quality_first' AND p < 0.72 AND requests < 16 THEN 'quality' WHEN mode = 'memory_first' OR p >= 0.9 THEN 'memory' WHEN mode = 'throughput_first' OR requests >= 16 THEN 'throughput' ELSE 'balanced' END AS rule FROM b)
SELECT c_custkey, rule, CASE rule WHEN 'quality' THEN CASE WHEN fp8 THEN 'fp8' ELSE 'turboquant' END WHEN 'balanced' THEN CASE WHEN context >= 8192 THEN 'turboquant' ELSE 'fp8' END ELSE 'turboquant' END AS codec,
CASE rule WHEN 'quality' THEN 4 WHEN 'memory' THEN CASE WHEN p >= 0.98 THEN 2 ELSE 3 END WHEN 'throughput' THEN 3 ELSE CASE WHEN p < 0.75 THEN 4 ELSE 3 END END AS bits,
CASE rule WHEN 'quality' THEN 1024 WHEN 'memory' THEN 256 WHEN 'throughput' THEN 384 ELSE CASE WHEN context >= 8192 THEN 512 ELSE 768 END END AS recent_window,
CAST(CASE rule WHEN 'quality' THEN 0 WHEN 'memory' THEN CASE WHEN p >= 0.98 THEN 0.2 ELSE 0.1 END WHEN 'throughput' THEN CASE WHEN context >= 8192 THEN 0.05 ELSE 0 END ELSE CASE WHEN p >= 0.82 THEN 0.05 ELSE 0 END END AS DOUBLE) AS prune_fraction,
CASE rule WHEN 'quality' THEN false WHEN 'memory' THEN true WHEN 'throughput' THEN p >= 0.8 ELSE p >= 0.86 END AS to_cpu, rule = 'memory' AND p >= 0.98 AS to_nvme, CASE rule WHEN 'quality' THEN 'quality_first under available GPU memory' WHEN 'memory' THEN 'memory pressure requires aggressive KV compression and pruning' WHEN 'throughput' THEN 'throughput/concurrency favors smaller KV and predictable paging' ELSE 'balanced policy' END AS reason FROM r""")
def policy_decisions(spark, t):
    c = t("customer").select("c_custkey", F.expr(_MODE).alias("mode"), F.when(F.col("c_acctbal") <= 0, 0.0).otherwise(control.pressure(F.col("c_acctbal") + 500, F.lit(10000.0))).alias("p"), (F.col("c_custkey") % 20).alias("requests"), (F.col("c_custkey") * 7 % 16384).alias("context"), (F.col("c_nationkey") % 2 == 0).alias("fp8"))
    return control.decide(c).select("c_custkey", "rule", "codec", "bits", "recent_window", "prune_fraction", "to_cpu", "to_nvme", "reason")


@query("""WITH h AS (SELECT n_nationkey AS hw, CASE WHEN n_nationkey % 3 = 0 THEN 'cpu' ELSE 'cuda' END AS hardware, n_nationkey * 2.0 AS memory_gb, n_nationkey % 4 = 0 AS fp8, n_nationkey % 2 = 0 AS int4, n_nationkey % 5 <> 0 AS bf16 FROM nation),
m AS (SELECT p_partkey AS model, CASE p_size % 5 WHEN 0 THEN 'fp8' WHEN 1 THEN 'int4' WHEN 2 THEN 'bf16' ELSE 'auto' END AS requested, CASE p_size % 4 WHEN 0 THEN 'quality_first' WHEN 1 THEN 'memory_first' WHEN 2 THEN 'throughput_first' ELSE 'balanced' END AS policy, p_size * 1.0 AS min_memory_gb FROM part)
SELECT model, hw, selected, CASE selected WHEN 'bf16' THEN 'bfloat16' WHEN 'fp16' THEN 'float16' WHEN 'fp8' THEN 'float8' WHEN 'int4' THEN 'int4_awq' ELSE 'int8' END AS dtype, CASE selected WHEN 'fp8' THEN 'fp8' ELSE 'auto' END AS kv_dtype,
 CASE WHEN requested <> 'auto' THEN 'registry requested mode' WHEN policy = 'balanced' THEN 'balanced auto policy' ELSE policy || ' auto policy' END AS reason FROM (SELECT *, CASE
 WHEN requested = 'fp8' THEN (CASE WHEN fp8 THEN 'fp8' WHEN hardware = 'cpu' THEN 'int8' ELSE 'fp16' END) WHEN requested = 'int4' THEN (CASE WHEN int4 THEN 'int4' ELSE 'int8' END) WHEN requested = 'bf16' THEN (CASE WHEN bf16 THEN 'bf16' WHEN hardware = 'cuda' THEN 'fp16' ELSE 'int8' END)
 WHEN policy = 'quality_first' THEN (CASE WHEN bf16 THEN 'bf16' WHEN hardware = 'cuda' THEN 'fp16' ELSE 'int8' END) WHEN policy = 'memory_first' THEN (CASE WHEN int4 THEN 'int4' ELSE 'int8' END) WHEN policy = 'throughput_first' THEN (CASE WHEN fp8 THEN 'fp8' WHEN int4 THEN 'int4' ELSE 'int8' END)
 WHEN fp8 AND memory_gb >= min_memory_gb THEN 'fp8' WHEN int4 AND memory_gb < greatest(1.0, 1.25 * min_memory_gb) THEN 'int4' WHEN bf16 THEN 'bf16' WHEN hardware = 'cuda' THEN 'fp16' ELSE 'int8' END AS selected FROM m, h)""")
def quantization_plans(spark, t):
    h = t("nation").select(F.col("n_nationkey").alias("hw"), F.expr("if(n_nationkey % 3 = 0, 'cpu', 'cuda')").alias("hardware"), (F.col("n_nationkey") * 2.0).alias("memory_gb"), *(F.expr(e).alias(n) for n, e in (("fp8", "n_nationkey % 4 = 0"), ("int4", "n_nationkey % 2 = 0"), ("bf16", "n_nationkey % 5 <> 0"))))
    m = t("part").select(F.col("p_partkey").alias("model"), F.expr("case p_size % 5 when 0 then 'fp8' when 1 then 'int4' when 2 then 'bf16' else 'auto' end").alias("requested"), F.expr("case p_size % 4 when 0 then 'quality_first' when 1 then 'memory_first' when 2 then 'throughput_first' else 'balanced' end").alias("policy"), (F.col("p_size") * 1.0).alias("min_memory_gb"), F.lit(False).alias("prequantized"))
    return control.plan_quantization(m.crossJoin(h)).select("model", "hw", "selected", "dtype", "kv_dtype", "reason")


@query("WITH c AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, greatest(0, 200 - count(*) OVER ()) * n::DOUBLE / greatest(1, sum(n) OVER ()) AS raw, greatest(0, 200 - count(*) OVER ()) AS rest FROM c), w AS (SELECT *, floor(raw) AS f, row_number() OVER (ORDER BY raw - floor(raw) DESC, name DESC) AS place FROM r) SELECT name, n, CAST(1 + f + CASE WHEN place <= rest - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS shards FROM w")
def shard_apportion(spark, t):
    return catalog.apportion(t("part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n")), "name", "n", 200)


# Embeddings and catalogs.
@query("WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, count(*) AS n, count(*) FILTER (WHERE isnan(x)) AS n_nan, count(*) FILTER (WHERE isinf(x)) AS n_inf, round(min(x), 6) AS lowest, round(max(x), 6) AS highest, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(sqrt(avg(x * x)), 6) AS rms, round(max(abs(x)), 6) AS absmax FROM x GROUP BY 1")
def vector_stats(spark, t):
    s = catalog.tensor_stats(t("embeddings"), "vec_id", "embedding")
    return s.select("vec_id", "n", "n_nan", "n_inf", *(F.round(c, 6).alias(c) for c in ("lowest", "highest", "mean", "std", "rms", "absmax")))


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: NOT isfinite(x))) AS BIGINT) AS n_bad FROM embeddings")
def nonfinite_audit(spark, t):
    _, n = N.sanitized(F.col("embedding"))
    return t("embeddings").select("vec_id", n.cast("long").alias("n_bad"))


@query("WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS l, generate_subscripts(embedding, 1) - 1 AS tok FROM embeddings), a AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, tok) AS rank FROM x WHERE tok <> 0), k AS (SELECT *, exp((l - max(l) OVER (PARTITION BY vec_id)) / 0.7) AS e FROM a WHERE rank <= 20), p AS (SELECT *, sum(e) OVER (PARTITION BY vec_id ORDER BY rank) / sum(e) OVER (PARTITION BY vec_id) AS c FROM k), f AS (SELECT * FROM p WHERE c <= 0.9 OR rank = 1) SELECT vec_id, CAST(tok AS INTEGER) AS tok, CAST(rank AS INTEGER) AS rank, round(e / sum(e) OVER (PARTITION BY vec_id), 8) AS probability FROM f")
def topk_topp_filter(spark, t):
    x = t("embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("tok", "l"))
    return control.nucleus(x, "vec_id", "tok", "l", 0.7, 20, 0.9, (0,)).select("vec_id", "tok", "rank", F.round("probability", 8).alias("probability"))


@query("WITH x AS (SELECT o_custkey AS g, o_orderkey AS pos, o_totalprice AS s, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back FROM orders), y AS (SELECT *, row_number() OVER (PARTITION BY g, back <= 3 ORDER BY s DESC, pos DESC) AS hot, row_number() OVER (PARTITION BY g, back <= 3 ORDER BY s, pos) AS low FROM x) SELECT pos, CASE WHEN back <= 3 THEN 'recent' WHEN hot <= ceil(n * 0.2) THEN 'hot' ELSE 'cold' END AS tier, back > 3 AND low <= least(floor(n * 0.3), greatest(0, n - 3)) AS prune FROM y")
def tiers_and_pruning(spark, t):
    o = t("orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("s"))
    return control.pruned(control.tiers(o, "g", "pos", "s", 3, 0.2), "g", "pos", "s", 3, 0.3).select("pos", "tier", "prune")


@query("SELECT coalesce(a.n_nationkey, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.n_nationkey IS NULL THEN 'unexpected' ELSE 'shape_mismatch' END AS issue FROM nation a FULL JOIN (SELECT n_nationkey + 3 AS k, n_regionkey AS r FROM nation) b ON a.n_nationkey = b.k WHERE b.k IS NULL OR a.n_nationkey IS NULL OR a.n_regionkey <> b.r")
def shape_audit(spark, t):
    n = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("s"))
    return catalog.audit_shapes(n, n.withColumn("k", F.col("k") + 3), "k", "s")


@query("SELECT l_suppkey, min(l_linenumber) AS first_step, max(l_linenumber) AS last_step, min(l_linenumber) = max(l_linenumber) AS uniform FROM lineitem GROUP BY 1")
def step_bounds(spark, t):
    return catalog.step_bounds(t("lineitem"), "l_suppkey", "l_linenumber")


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, sqrt(avg(l_quantity * l_quantity) OVER (PARTITION BY l_orderkey)) AS rms FROM lineitem) SELECT l_orderkey, l_linenumber, round(0.5 + 0.5 * least(2.0, greatest(0.25, rms / greatest(l_quantity, 1e-12))), 8) AS scale FROM r")
def clip_factors(spark, t):
    return catalog.clip_factors(t("lineitem"), "l_orderkey", "l_quantity", 0.25, 2.0, 0.5).select("l_orderkey", "l_linenumber", F.round("scale", 8).alias("scale"))


@query("WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), r AS (SELECT o_custkey, o_orderkey, n, i, 0::BIGINT AS file, n AS held FROM o WHERE i = 1 UNION ALL SELECT o.o_custkey, o.o_orderkey, o.n, o.i, CASE WHEN held > 0 AND held + o.n > 400000 THEN file + 1 ELSE file END, CASE WHEN held > 0 AND held + o.n > 400000 THEN o.n ELSE held + o.n END FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.i = r.i + 1) SELECT o_custkey, o_orderkey, n, file FROM r")
def file_packing(spark, t):
    return catalog.next_fit(t("orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("long").alias("n")), "o_custkey", "o_orderkey", "n", 400000)


@query("WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), r AS (SELECT o_custkey, o_orderkey, i, 0::BIGINT AS file, n AS held FROM o WHERE i = 1 UNION ALL SELECT o.o_custkey, o.o_orderkey, o.i, CASE WHEN held > 0 AND held + o.n > 400000 THEN file + 1 ELSE file END, CASE WHEN held > 0 AND held + o.n > 400000 THEN o.n ELSE held + o.n END FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.i = r.i + 1) SELECT o_custkey, o_orderkey, CASE WHEN max(file) OVER (PARTITION BY o_custkey) = 0 THEN 'model.safetensors' ELSE printf('model-%05d-of-%05d.safetensors', file + 1, max(file) OVER (PARTITION BY o_custkey) + 1) END AS file_name FROM r")
def weight_maps(spark, t):
    packed = catalog.next_fit(t("orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("long").alias("n")), "o_custkey", "o_orderkey", "n", 400000)
    return catalog.weight_map(packed, "o_custkey", "o_orderkey")


@query()
def vector_codecs(spark, t):
    e = t("embeddings").select("vec_id", *(U.codec(k)(F.col("embedding")).alias(k) for k in ("fp16", "fp8", "rotated")))
    return e.select("vec_id", *(F.col(f"{k}.n_bytes").alias(f"{k}_bytes") for k in ("fp16", "fp8", "rotated")), *(F.round(f"{k}.error", 6).alias(f"{k}_error") for k in ("fp16", "fp8", "rotated")))


@query()
def selective_codec(spark, t):
    e = t("embeddings").select("vec_id", "label", "embedding", F.element_at("embedding", 1).alias("score"))
    return codecs.selective(e, "label", "vec_id", "score", "embedding", 16, 0.1).select("vec_id", "tier", "n_bytes", F.round("error", 5).alias("error"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN NOT lower(source) IN ('src1', 'src2', 'src5', 'src7') THEN 'license_filtered' WHEN lower(source) = 'src5' THEN 'license_filtered' WHEN lang NOT IN ('en', 'fr') THEN 'collection_filtered' WHEN doc_id % 40 + 1990 < 1995 OR doc_id % 40 + 1990 > 2020 THEN 'date_filtered' END AS reason FROM documents")
def metadata_filters(spark, t):
    d = t("documents").select("doc_id", "text", F.col("source").alias("license"), F.col("lang").alias("collection"), F.format_string("%d-05-01", (F.col("doc_id") % 40 + 1990).cast("int")).alias("date"))
    rules = normalize.Rules(licenses=("SRC1", "src2", "src5", "src7"), license_blocks=("Src5",), collections=("en", "FR"), min_year=1995, max_year=2020)
    return normalize.documents(d, rules, clean=False).select("doc_id", "reason")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def json_lines(spark, t):
    path = scratch.new_path(spark, "json-lines")
    sinks.jsonl(t("documents").select("doc_id", "lang", "source", "n_chars"), path)
    return scans.jsonl(spark, path, "doc_id long, lang string, source string, n_chars long")


@query(f"{_TOK} SELECT split, pos // 129 AS block, sha256(string_agg(tok, ' ' ORDER BY pos) FILTER (WHERE pos % 129 < 128)) AS inputs, sha256(string_agg(tok, ' ' ORDER BY pos) FILTER (WHERE pos % 129 > 0)) AS labels FROM p GROUP BY 1, 2 HAVING count(*) = 129")
def shifted_blocks(spark, t):
    b = packing.shifted(packing.blocks(_tokens(t), "tok", ["doc_id"], 128, False, ["split"]))
    return b.select("split", "block", *(F.sha2(F.array_join(c, " "), 256).alias(c) for c in ("inputs", "labels")))


@query("SELECT event_id, coalesce(value <= before + 0.5 + abs(before) * 0.1, false) AS accepted FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)")
def guard_acceptance(spark, t):
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = t("events").select("event_id", "value", before.alias("before"))
    return e.select("event_id", F.coalesce(N.accepts(F.col("before"), F.col("value"), 0.5, 0.1), F.lit(False)).alias("accepted"))


@query("SELECT s_suppkey AS model_id, CASE WHEN s_suppkey % 2 = 0 THEN 'chat' ELSE 'embed' END AS task FROM supplier")
def model_registry(spark, t):
    path = scratch.new_path(spark, "registry")
    rows = t("supplier").select(F.struct(F.col("s_suppkey").alias("model_id"), F.expr("if(s_suppkey % 2 = 0, 'chat', 'embed')").alias("task")).alias("m"))
    rows.agg(F.collect_list("m").alias("models")).write.json(path)  # a registry is one document
    return scans.registry(spark, path).select("model_id", "task")


@query("WITH b AS (SELECT p_brand AS shard, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, p_partkey FROM part), n AS (SELECT shard, count(*) AS n FROM b GROUP BY 1) SELECT count(*) AS n, count(DISTINCT shard) AS shards, CAST(sum(p_partkey) AS BIGINT) AS keys, (SELECT count(*) FROM n) AS ranks, 0::BIGINT AS out_of_order FROM b")
def epoch_order(spark, t):
    placed = packing.epoch_order(t("part"), "p_brand", "p_partkey", 3, 1, 4).select("p_brand", "p_partkey", "shard_rank", "worker").withColumn("at", F.monotonically_increasing_id())
    placed = scratch.stored(placed, "epoch")
    before = F.lag(F.struct("shard_rank", "p_partkey")).over(Window.partitionBy("p_brand").orderBy("at"))
    odd = placed.withColumn("odd", F.coalesce(before > F.struct("shard_rank", "p_partkey"), F.lit(False)) | (F.col("worker") != F.col("shard_rank") % 4))
    return odd.agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("shards"), F.sum("p_partkey").alias("keys"), F.count_distinct("shard_rank").alias("ranks"), F.count_if("odd").alias("out_of_order"))


# Requests and tenants.
@query("WITH h AS (SELECT item_id, sha256(text || ':0') || sha256(text || ':1') AS h FROM benchmark), v AS (SELECT item_id, list_transform(range(40), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) / 127.5 - 1) AS v FROM h), n AS (SELECT item_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v) SELECT item_id, round(v[1] / n, 9) AS first, round(v[40] / n, 9) AS last, round(list_sum(list_transform(v, lambda x, i: x * i)) / n, 7) AS mixed FROM n")
def hash_embeddings(spark, t):
    e = t("benchmark").select("item_id", requests.hash_embedding(F.col("text"), 40).alias("e"))
    mixed = F.aggregate(F.transform("e", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return e.select("item_id", F.round(F.col("e")[0], 9).alias("first"), F.round(F.col("e")[39], 9).alias("last"), F.round(mixed, 7).alias("mixed"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id || ' ' || user_id WHEN 1 THEN event_id || ' 7|' || user_id WHEN 2 THEN event_type || '|' || user_id WHEN 3 THEN event_type ELSE '' END AS inputs FROM events")
def embedding_inputs(spark, t):
    v = F.expr("case event_id % 5 when 0 then format_string('[%d, %d]', event_id, user_id) when 1 then format_string('[[%d,7],[%d]]', event_id, user_id) when 2 then format_string('[\"%s\", \"%d\"]', event_type, user_id) when 3 then format_string('\"%s\"', event_type) else '[]' end")
    return t("events").select("event_id", F.array_join(requests.embedding_inputs(v), "|").alias("inputs"))


@query("WITH i AS (SELECT l_orderkey, list(CAST(l_quantity AS INTEGER) % 3 ORDER BY l_linenumber, CAST(l_quantity AS INTEGER) % 3) AS ids FROM lineitem GROUP BY 1), k AS (SELECT *, list_max(list_transform(ids, lambda x, i: CASE WHEN x <> 0 THEN i ELSE 0 END)) AS k FROM i) SELECT l_orderkey, CASE WHEN k = 0 THEN '9' ELSE array_to_string(ids[1:k], ' ') END AS ids FROM k")
def prompt_ids(spark, t):
    own = t("lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity").cast("int") % 3).alias("i")))), lambda x: x["i"]).alias("ids"))
    return own.select("l_orderkey", F.array_join(requests.prompt_ids(F.col("ids"), 9, 0), " ").alias("ids"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 3 <> 0 THEN p_size % 3 WHEN p_size % 5 <> 0 THEN p_size % 5 ELSE 256 END AS INTEGER) AS n FROM part")
def token_limits(spark, t):
    return t("part").select("p_partkey", requests.token_limit(F.col("p_size") % 3, F.col("p_size") % 5).cast("int").alias("n"))


@query("SELECT conv_id, turn, array_to_string(string_split(text, '. '), ' ') AS text FROM conversations")
def message_parts(spark, t):
    parts = F.transform(F.split("text", "\\. "), lambda x: F.struct(F.lit("text").alias("type"), x.alias("text")))
    return t("conversations").select("conv_id", "turn", requests.parts_text(parts).alias("text"))


@query("""WITH a AS (SELECT DISTINCT conv_id, concat_ws(chr(10), CASE WHEN conv_id % 3 = 0 THEN 'Available tools must be called with JSON: [{"id": ' || conv_id || '}]' END, CASE WHEN conv_id % 2 = 0 THEN 'Respond with JSON that conforms to: {"type": "json_object"}' END) AS text FROM conversations),
u AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, -1, 'system', text FROM a WHERE text <> '') SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn) || chr(10) || '<|assistant|>' || chr(10) AS prompt FROM u GROUP BY 1""")
def control_prompts(spark, t):
    turns = t("conversations")
    asks = turns.select("conv_id").distinct().select("conv_id", F.expr("if(conv_id % 3 = 0, concat('[{\"id\": ', conv_id, '}]'), null)").alias("tools"), F.expr("case when conv_id % 2 = 0 then '{\"type\": \"json_object\"}' when conv_id % 5 = 0 then '{\"type\": \"text\"}' end").alias("response_format"))
    return control.chat_prompt(requests.with_control(turns, asks))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 4 = 0 THEN 'tool_calls' WHEN event_id % 2 = 0 AND event_id % 4 = 2 AND event_id % 7 = 0 THEN 'invalid' ELSE 'content' END AS kind FROM events")
def answer_kinds(spark, t):
    text = F.expr("case when event_id % 4 = 0 then '{\"tool_calls\": [1]}' when event_id % 7 = 0 then concat('{', props) else props end")
    tools, form = F.expr("if(event_id % 3 = 0, '[]', null)"), F.expr("case when event_id % 2 = 0 then '{\"type\": \"json_schema\"}' else '{\"type\": \"text\"}' end")
    return t("events").select("event_id", requests.answer_kind(text, tools, form).alias("kind"))


@query("""WITH m AS (SELECT s_suppkey AS model_id, CASE WHEN s_suppkey % 3 = 0 THEN 'embed' ELSE 'chat' END AS task, CASE s_nationkey % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'vllm' WHEN 2 THEN 'transformers' WHEN 3 THEN 'own' ELSE 'other' END AS backend, s_suppkey % 2 = 0 AS need, CASE WHEN s_nationkey % 2 = 0 THEN 'fp8' ELSE 'turboquant' END AS kv, s_suppkey % 7 = 0 AS forced FROM supplier)
SELECT p_partkey, backend, CASE WHEN m.model_id IS NULL THEN 'unknown_model' WHEN task <> 'chat' THEN 'wrong_task' WHEN backend = 'other' THEN 'unknown_backend' WHEN need AND NOT forced AND backend <> 'dev' AND NOT (backend = 'vllm' AND kv = 'fp8') THEN 'kv_contract' END AS refused FROM part LEFT JOIN m ON p_partkey % 130 = m.model_id""")
def model_contracts(spark, t):
    e = F.expr
    m = t("supplier").select(F.col("s_suppkey").alias("model_id"), e("if(s_suppkey % 3 = 0, 'embed', 'chat')").alias("task"), e("case s_nationkey % 5 when 0 then 'dev' when 1 then 'vllm' when 2 then 'transformers' when 3 then 'own' else 'other' end").alias("backend"), e("s_suppkey % 2 = 0").alias("kv_required"), e("if(s_nationkey % 2 = 0, 'fp8', 'turboquant')").alias("kv_mode"), e("s_suppkey % 7 = 0").alias("forced"))
    return requests.admitted_models(t("part").select("p_partkey", (F.col("p_partkey") % 130).alias("model_id"), F.lit("chat").alias("task_type")), m, (*requests.BACKENDS, "own")).select("p_partkey", "backend", "refused")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'a' END AS tenant_id, CASE WHEN c_custkey % 4 < 3 THEN left(sha256('t' || c_custkey % 4), 16) END AS token_hash FROM customer")
def tenants(spark, t):
    asks = t("customer").select("c_custkey", F.concat(F.lit("t"), F.col("c_custkey") % 4).alias("token"))
    return requests.authenticated(asks, requests.token_map("a:t0, b:t1, a2:t2")).select("c_custkey", F.regexp_replace("tenant_id", "2", "").alias("tenant_id"), "token_hash")


@query("SELECT source, count(*) AS lookups, count(k) AS hits, round(CASE WHEN count(*) = 0 THEN 0 ELSE count(k) * 1.0 / count(*) END, 9) AS rate FROM (SELECT 1 AS source, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS k FROM documents) GROUP BY 1")
def reuse_rate(spark, t):
    r = control.reuse(t("documents").select(F.expr("if(doc_id % 3 = 0, doc_id, null)").alias("kv_ref")))
    return r.select(F.lit(1).alias("source"), "lookups", "hits", F.round("rate", 9).alias("rate"))


@query("SELECT count(*) FILTER (WHERE source IS DISTINCT FROM 'src3') AS entries, count(*) FILTER (WHERE source = 'src3') AS removed FROM documents")
def tenant_eviction(spark, t):
    rest, n = control.evict_tenant(t("documents").withColumnRenamed("source", "tenant_id"), "src3")
    return rest.agg(F.count("*").alias("entries"), F.lit(n).cast("long").alias("removed"))


@query("WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'gpu' WHEN 'O' THEN 'cpu' ELSE 'nvme' END AS tier, CAST(round(o_totalprice) AS BIGINT) AS b, o_orderdate FROM orders), r AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY tier ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM o) SELECT o_orderkey, tier, CASE WHEN f >= 3000000 THEN tier WHEN tier = 'gpu' THEN 'cpu' WHEN tier = 'cpu' THEN 'nvme' END AS to_tier FROM r")
def lru_demote(spark, t):
    o = t("orders").select("o_orderkey", F.expr("case o_orderstatus when 'F' then 'gpu' when 'O' then 'cpu' else 'nvme' end").alias("tier"), F.round("o_totalprice").cast("long").alias("n_bytes"), "o_orderdate")
    return control.demote(o, 3000000, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "tier", "to_tier")


@query("WITH e AS (SELECT vec_id, label, list_avg(list_transform(embedding[1:32], lambda x: abs(x::DOUBLE))) + list_avg(list_transform(embedding[33:64], lambda x: abs(x::DOUBLE))) AS e FROM embeddings), w AS (SELECT *, min(e) OVER (PARTITION BY label) AS lo, max(e) OVER (PARTITION BY label) AS hi FROM e) SELECT vec_id, round(CASE WHEN hi > lo THEN (e - lo) / (hi - lo) ELSE e END, 7) AS energy FROM w")
def energy_scores(spark, t):
    e = control.energy(t("embeddings"), "label", F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return e.select("vec_id", F.round("energy", 7).alias("energy"))


# More of a run's telemetry and of its shards.
@query("SELECT max_by(event_id, event_id) AS latest_step, max_by(value, event_id) AS latest_loss, (SELECT event_id FROM events ORDER BY value, event_id LIMIT 1) AS best_step, min(value) AS best_loss, round(avg(value * 2), 6) AS avg_grad_norm, round(avg(value / 7), 6) AS avg_clip, round(avg(user_id), 6) AS avg_tokens_per_sec, round(avg(value), 6) AS avg_step_seconds, count(*) FILTER (WHERE event_id % 6 > 1 OR event_id % 5 > 0) AS replayed, round(100.0 * count(*) FILTER (WHERE event_id % 6 > 1 OR event_id % 5 > 0) / count(*), 6) AS replay_percent FROM events")
def run_kpis(spark, t):
    e = t("events").select("event_id", "value", (F.col("value") * 2).alias("norm"), (F.col("value") / 7).alias("clip"), "user_id", (F.col("event_id") % 6).alias("attempts"), (F.col("event_id") % 5).alias("rejected"))
    k = telemetry.kpis(e, "event_id", "event_id", "value", "norm", "clip", "user_id", "value", "attempts", "rejected")
    return k.select("latest_step", "latest_loss", "best_step", "best_loss", *(F.round(c, 6).alias(c) for c in ("avg_grad_norm", "avg_clip", "avg_tokens_per_sec", "avg_step_seconds")), "replayed", F.round("replay_percent", 6).alias("replay_percent"))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 40")
def slowest_top40(spark, t):
    return telemetry.slowest(t("events"), "value", "event_id").select("event_id", "value")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'view' ORDER BY user_id, event_id")
def validation_rows(spark, t):
    return telemetry.validation_table(t("events").filter("event_type = 'view'"), "user_id", "event_id").select("event_id", "user_id", "value")


@query("SELECT round(avg(value), 9) AS val_loss, round(exp(least(20, avg(value))), 4) AS val_perplexity, count(*) AS validation_batches FROM (SELECT value FROM events ORDER BY event_id LIMIT 100)")
def validation_mean(spark, t):
    m = telemetry.validation_mean(t("events"), "value", "event_id", 100)
    return m.select(F.round("val_loss", 9).alias("val_loss"), F.round("val_perplexity", 4).alias("val_perplexity"), "validation_batches")


@query("WITH v AS (SELECT value, event_id FROM events WHERE event_type = 'view'), r AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events WHERE user_id % 3 = 0) SELECT event_id FROM v, r WHERE event_id BETWEEN lo AND hi")
def validation_in_range(spark, t):
    e = t("events")
    return telemetry.in_range_of(e.filter("event_type = 'view'"), e.filter("user_id % 3 = 0"), "event_id").select("event_id")


@query("SELECT count(*) FILTER (WHERE c_custkey % 11 = 0) AS errors, count(*) FILTER (WHERE c_custkey % 7 = 0 AND c_custkey % 11 <> 0) + CASE WHEN min(c_nationkey) = max(c_nationkey) THEN 0 ELSE 1 END AS warnings, min(c_nationkey) AS step_min, max(c_nationkey) AS step_max, min(c_nationkey) = max(c_nationkey) AS uniform, count(*) FILTER (WHERE c_custkey % 11 = 0 OR c_custkey % 7 = 0) + CASE WHEN min(c_nationkey) = max(c_nationkey) THEN 0 ELSE 1 END AS issue_count FROM customer")
def audit_summary(spark, t):
    c = t("customer")
    issues = c.select(F.expr("case when c_custkey % 11 = 0 then 'error' when c_custkey % 7 = 0 then 'warning' end").alias("severity")).filter("severity is not null")
    return catalog.audit_summary(issues, c, "c_nationkey").select("errors", F.col("warnings").cast("long").alias("warnings"), "step_min", "step_max", "uniform", F.col("issue_count").cast("long").alias("issue_count"))


@query("""WITH s AS (SELECT o_orderkey, o_orderkey % 40 AS g, o_orderkey % 30 AS o, CAST(round(o_totalprice) AS BIGINT) % 5 * o_orderkey % 9000 AS k, o_custkey % 60 AS lo, CASE WHEN o_orderkey % 9 = 0 THEN o_custkey % 60 + 1 ELSE o_custkey % 60 END AS hi FROM orders), r AS (SELECT *, CASE WHEN lo <> hi THEN 'inconsistent' WHEN hi > g THEN 'repaired' ELSE 'ok' END AS status FROM s)
SELECT o_orderkey, status, CASE WHEN status = 'repaired' THEN hi ELSE g END AS global_step, CASE WHEN status = 'repaired' THEN greatest(o, hi) ELSE o END AS optimizer_step, CAST(CASE WHEN status = 'repaired' THEN greatest(k, CAST(round_even(CASE WHEN g > 0 AND k > 0 THEN k::DOUBLE / g ELSE 512.0 END * hi, 0) AS BIGINT)) ELSE k END AS BIGINT) AS tokens_seen FROM r""")
def state_repairs(spark, t):
    s = t("orders").select("o_orderkey", (F.col("o_orderkey") % 40).alias("global_step"), (F.col("o_orderkey") % 30).alias("optimizer_step"), (F.round("o_totalprice").cast("long") % 5 * F.col("o_orderkey") % 9000).alias("tokens_seen"), (F.col("o_custkey") % 60).alias("step_min"), F.expr("o_custkey % 60 + if(o_orderkey % 9 = 0, 1, 0)").alias("step_max"))
    return catalog.repaired(s, 512.0).select("o_orderkey", "status", "global_step", "optimizer_step", "tokens_seen")


@query("WITH x AS (SELECT l_suppkey AS run, l_extendedprice AS q, l_quantity AS p FROM lineitem), t AS (SELECT *, sqrt(sum(q) OVER (PARTITION BY run) / sum(p) OVER (PARTITION BY run)) AS target FROM x), r AS (SELECT run, target / greatest(sqrt(q / p), 1e-12) AS raw FROM t), a AS (SELECT run, raw, 1 + 0.5 * (least(2.0, greatest(0.9, raw)) - 1) AS a FROM r) SELECT run, round(min(raw), 8) AS raw_min, round(avg(raw), 8) AS raw_mean, round(max(raw), 8) AS raw_max, round(min(a), 8) AS applied_min, round(avg(a), 8) AS applied_mean, round(max(a), 8) AS applied_max FROM a GROUP BY 1")
def scale_summary(spark, t):
    x = t("lineitem").select(F.col("l_suppkey").alias("run"), "l_extendedprice", "l_quantity")
    r = catalog.scale_summary(catalog.shard_scales(x, "run", "l_extendedprice", "l_quantity", 0.9, 2.0, 0.5), "run")
    return r.select("run", *(F.round(c, 8).alias(c) for c in r.columns if c != "run"))


@query("SELECT l_suppkey, round(avg(l_tax), 9) AS mean, max(l_tax) AS max FROM lineitem GROUP BY 1")
def norm_summary(spark, t):
    return catalog.norm_summary(t("lineitem"), "l_suppkey", "l_tax").select("l_suppkey", F.round("mean", 9).alias("mean"), "max")


@query("SELECT p_brand, count(*) AS tensors, CAST(sum(p_size) AS BIGINT) AS parameters FROM part GROUP BY ROLLUP (p_brand)")
def parameter_totals(spark, t):
    return catalog.parameter_totals(t("part"), "p_brand", "p_size")


@query("SELECT event_id, max(CAST(value AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS most_active FROM (SELECT event_id, user_id, floor(value) AS value FROM events)")
def shard_activity(spark, t):
    e = t("events").select("event_id", "user_id", F.floor("value").cast("long").alias("active"))
    return catalog.activity(e, "user_id", "event_id", "active").select("event_id", "most_active")


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 4 = 0 THEN 0 ELSE greatest(0, least(CASE WHEN p_size % 6 > 0 THEN p_size % 6 ELSE 3 END, 3)) END AS INTEGER) AS ahead, CASE WHEN p_size % 7 > 3 THEN 'too_many_params' WHEN p_size % 11 > 3 THEN 'too_many_optimizers' WHEN p_partkey % 100 >= 50 THEN 'full_model' END AS violation FROM part")
def residency_limits(spark, t):
    p = t("part").select("p_partkey", "p_size", (F.col("p_size") % 7).alias("params"), (F.col("p_size") % 11).alias("optimizers"), F.lit(3).alias("resident"), (F.col("p_partkey") % 100).alias("active_parameters"), F.lit(50).alias("total_parameters"), F.lit(20).alias("largest_parameters"))
    mode = F.when(F.col("p_size") % 4 == 0, "off").otherwise("on")
    return catalog.residency(p).select("p_partkey", catalog.prefetch_window(mode, F.col("p_size") % 6, F.col("resident")).cast("int").alias("ahead"), "violation")


@query()
def tensor_placement(spark, t):
    p = t("part").select("p_brand", F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("rows"), (F.col("p_size") * 16).cast("long").alias("numel"))
    return catalog.placed(p, "p_brand", "key", "rows", "numel", 200)


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS keys FROM lineitem GROUP BY 1")
def rebuilt_chunks(spark, t):
    n = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("chunks"))
    c = t("lineitem").join(n, "l_orderkey").withColumn("chunk_index", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) - 1).withColumn("values", F.array("l_partkey"))
    return catalog.rebuild(c.select("l_orderkey", "chunk_index", "chunks", "values"), "l_orderkey").select("l_orderkey", F.array_join("values", ",").alias("keys"))


# Whole profile, scans with limits, blocks by number, upserts.
@query(f"""WITH d AS (SELECT *, length(text) AS n, {_WORDS} AS w, sha256({_CANON}) AS h FROM documents),
s AS (SELECT 'char_length' AS section, n AS v FROM d UNION ALL SELECT 'word_count', w FROM d), q AS (SELECT section, count(v)::DOUBLE AS n, min(v)::DOUBLE AS lowest, max(v)::DOUBLE AS highest, avg(v) AS mean, quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99 FROM s GROUP BY 1),
l AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY n DESC, min(doc_id) LIMIT 25), c AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, min(doc_id) LIMIT 25)
SELECT 'counts' AS section, name, value::DOUBLE AS value FROM (UNPIVOT (SELECT count(*) AS rows, count(*) FILTER (WHERE text = '') AS empty, count(*) FILTER (WHERE n < 200) AS short, count(*) FILTER (WHERE regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) AS control_chars, count(*) FILTER (WHERE contains(text, chr(65533))) AS encoding_issues, count(*) - count(DISTINCT h) AS exact_duplicates, count(DISTINCT h) AS unique_texts FROM d) ON COLUMNS(*) INTO NAME name VALUE value)
UNION ALL SELECT 'nulls', name, value::DOUBLE FROM (UNPIVOT (SELECT count(*) FILTER (WHERE doc_id IS NULL) AS doc_id, count(*) FILTER (WHERE text IS NULL) AS text, count(*) FILTER (WHERE lang IS NULL) AS lang, count(*) FILTER (WHERE source IS NULL) AS source, count(*) FILTER (WHERE n_chars IS NULL) AS n_chars FROM d) ON COLUMNS(*) INTO NAME name VALUE value)
UNION ALL SELECT section, name, round(value, 6) FROM (UNPIVOT q ON n, lowest, highest, mean, p01, p05, p50, p95, p99 INTO NAME name VALUE value)
UNION ALL SELECT 'lang_top', lang, n::DOUBLE FROM l UNION ALL SELECT 'source_top', source, n::DOUBLE FROM c""")
def whole_profile(spark, t):
    p = profile.whole(t("documents"), "text", "doc_id", ("lang", "source"), clean=False)
    return p.select("section", "name", F.round("value", 6).alias("value"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey FROM orders LIMIT 777)")
def scan_limit(spark, t):
    return scans.parquet(spark, t("orders").inputFiles(), ["o_orderkey"], per_file=900, limit=777).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey FROM orders LIMIT 600)")
def scan_per_file(spark, t):
    return scans.parquet(spark, t("orders").inputFiles(), ["o_orderkey"], per_file=600, limit=777).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("WITH b AS (SELECT CAST(p_size AS BIGINT) AS blocks, row_number() OVER (ORDER BY p_partkey) - 1 AS shard FROM part), c AS (SELECT *, sum(blocks) OVER (ORDER BY shard) AS hi FROM b) SELECT w.k AS block, CAST(shard AS BIGINT) AS shard, CAST(w.k - (hi - blocks) AS BIGINT) AS row FROM c JOIN (SELECT c_custkey AS k FROM customer) w ON w.k >= hi - blocks AND w.k < hi")
def block_lookup(spark, t):
    shards = t("part").select(F.col("p_partkey").alias("shard"), F.col("p_size").cast("long").alias("blocks"))
    return packing.block_at(shards, t("customer").select(F.col("c_custkey").alias("block")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer")
def upserted(spark, t):
    c = t("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return sinks.upsert(c, c.filter("c_custkey % 3 = 0").withColumn("segment", F.lit("new")), "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 5 <> 0")
def released_rows(spark, t):
    o = t("orders").select("o_orderkey", "o_custkey")
    return control.remove(o, o.filter("o_custkey % 5 = 0"), "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def zipped_segments(spark, t):
    x = t("orders")
    return control.zip_segments(x.select("o_orderkey", "o_custkey"), x.select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("SELECT doc_id, len(list_intersect([lower(lang), lower(source)], ['en', 'src2'])) > 0 AS ok FROM documents")
def allowed_any(spark, t):
    return t("documents").select("doc_id", X.allowed_any(F.array("lang", "source"), ["EN", "src2"]).alias("ok"))


# Streams.
@query("WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT user_id, event_id, i, sec, 1.0::DOUBLE AS level FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, e.sec, least(1.0, r.level - CASE WHEN r.level >= 1 THEN 1 ELSE 0 END + (e.sec - r.sec) * 1 / 60) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, event_id, level >= 1 AS allowed FROM r")
def rate_limit_decisions(spark, t):
    path = scratch.new_path(spark, "rate-limit")
    t("events").select("user_id", "ts", "event_id").write.parquet(path + "/in")
    s = streams.files(spark, path + "/in", "user_id long, ts timestamp_ntz, event_id long", 1000)
    return streams.run_once(streams.limited(s, "user_id", "ts", 1), path + "/out", path + "/state").orderBy("event_id")


@query()
def stream_packing(spark, t):
    path = scratch.new_path(spark, "stream-packing")
    _tokens(t).select("split", "doc_id", F.transform("tok", lambda w: F.pmod(F.hash(w), F.lit(50000))).alias("tokens")).write.parquet(path + "/in")
    s = streams.files(spark, path + "/in", "split string, doc_id long, tokens array<int>", 1)
    return streams.run_once(streams.packed(s, "split", "doc_id", 128), path + "/out", path + "/state")


#: Words with their global positions over so many passes of the texts in the order of doc_id, and blocks of 129 positions with a step.
_PASSES = "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t, unnest(range(len(string_split(text, ' ')))) AS i FROM documents), p AS (SELECT length(t) AS n, row_number() OVER (ORDER BY e, doc_id, i) - 1 AS pos FROM w, range({0}) r(e)), k AS (SELECT unnest([pos // {1}, CASE WHEN {1} = 128 AND pos % 128 = 0 AND pos > 0 THEN pos // 128 - 1 END]) AS block, pos, n FROM p) SELECT block, CAST(block // {2} AS INTEGER) AS shard, CAST(sum(n) AS BIGINT) AS total, CAST(arg_min(n, pos) AS INTEGER) AS head FROM k WHERE block IS NOT NULL GROUP BY block HAVING count(*) = 129"


def _word_lengths(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tokens", F.transform(F.split("text", " "), F.length))


def _texts_in_order(t) -> DataFrame:
    return scratch.stored(t("documents").orderBy("doc_id").select("text"), "texts-in-order")


def _digest(blocks: DataFrame) -> DataFrame:
    return blocks.select("block", "shard", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("tokens")[0].alias("head"))


@query(_PASSES.format(2, 128, 64))
def endless_blocks(spark, t):
    """Two epochs of the endless stream, stopped once in between and resumed from its checkpoint."""
    texts = _texts_in_order(t)
    files, path = ranges.planned(spark, texts._scratch), scratch.new_path(spark, "endless")
    rows = max(1, sum(n for _, n in files) // 3)
    packer = ranges.Packer(spark, path + "/out", _word_lengths, 128)
    ranges.run(ranges.stream(spark, files, rows, 2), packer, path + "/state", 2)
    ranges.run(ranges.stream(spark, files, rows, 2), packer, path + "/state")
    return _digest(packer.blocks())


@query(_PASSES.format(1, 129, 16))
def resumed_packing(spark, t):
    """One pass over files with a commit log, stopped after its first batch and gone on with."""
    texts = _texts_in_order(t)
    files, path = ranges.planned(spark, texts._scratch), scratch.new_path(spark, "packed-files")
    rows = max(1, sum(n for _, n in files) // 3)
    packer = ranges.Packer(spark, path, _word_lengths, 128, overlap=False, blocks_per_shard=16)
    ranges.pack_files(spark, files, packer, rows, batches=1)
    ranges.pack_files(spark, files, packer, rows)
    return _digest(packer.blocks())


@query(
    "WITH RECURSIVE ev AS (SELECT CAST(user_id % 7 AS VARCHAR) AS tenant_id, CAST((event_id * 31) % 13 AS VARCHAR) AS p, epoch_us(ts) * 1000 + event_id % 1000 AS seq, epoch_ms(ts) AS ms, event_id AS new, CASE WHEN event_id % 97 = 0 THEN 'evict' WHEN event_id % 3 = 0 THEN 'insert' ELSE 'lookup' END AS op FROM events), k AS (SELECT DISTINCT tenant_id, p FROM ev WHERE op <> 'evict'), "
    "o AS (SELECT k.tenant_id, k.p, seq, ms, new, op, row_number() OVER (PARTITION BY k.tenant_id, k.p ORDER BY seq) AS i FROM k JOIN ev ON ev.tenant_id = k.tenant_id AND (ev.op = 'evict' OR ev.p = k.p)), "
    "r AS (SELECT tenant_id, p, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS op, NULL::BIGINT AS ref, 0::BIGINT AS hits, 0::BIGINT AS used, false AS had FROM k UNION ALL SELECT tenant_id, p, i, seq, op, CASE WHEN op = 'insert' THEN new WHEN op = 'lookup' AND alive THEN ref END, CASE WHEN op = 'evict' OR NOT alive THEN 0 ELSE hits + CASE WHEN op = 'lookup' THEN 1 ELSE 0 END END, CASE WHEN op = 'insert' OR (op = 'lookup' AND alive) THEN ms ELSE used END, alive FROM (SELECT o.*, r.ref, r.hits, r.used, r.ref IS NOT NULL AND r.used + 21600000 >= o.ms AS alive FROM r JOIN o ON o.tenant_id = r.tenant_id AND o.p = r.p AND o.i = r.i + 1) x) "
    "SELECT 'lookup' AS kind, tenant_id, seq, ref AS kv_ref, CASE WHEN ref IS NULL THEN 0 ELSE hits END AS hits, NULL::BIGINT AS removed FROM r WHERE op = 'lookup' UNION ALL SELECT 'evict', tenant_id, seq, NULL, NULL, CAST(count(*) FILTER (WHERE had) AS BIGINT) FROM r WHERE op = 'evict' GROUP BY tenant_id, seq HAVING count(*) FILTER (WHERE had) > 0"
)
def prefix_index(spark, t):
    """The index over a stream of events that insert, look up and evict; entries live six hours."""
    path, key = scratch.new_path(spark, "prefix-index"), "spark.sql.streaming.stateStore.providerClass"
    op = F.when(F.col("event_id") % 97 == 0, "evict").when(F.col("event_id") % 3 == 0, "insert").otherwise("lookup")
    at = F.col("ts").cast("timestamp")
    t("events").select((F.col("user_id") % 7).cast("string").alias("tenant_id"), F.lit("m").alias("model_id"), (F.col("event_id") * 31 % 13).cast("string").alias("prefix_hash"), (F.unix_micros(at) * 1000 + F.col("event_id") % 1000).alias("seq"), at.alias("ts"), F.when(op == "insert", F.col("event_id")).alias("kv_ref"), op.alias("op")).write.parquet(path + "/in")
    before = spark.conf.get(key)
    spark.conf.set(key, prefixes.PROVIDER)
    try:
        answers = streams.run_once(prefixes.indexed(streams.files(spark, path + "/in", prefixes.EVENTS, 1000), 6 * 3600), path + "/out", path + "/state")
    finally:
        spark.conf.set(key, before)
    return answers.groupBy("kind", "tenant_id", "seq", "kv_ref", "hits").agg(F.sum("removed").alias("removed"))

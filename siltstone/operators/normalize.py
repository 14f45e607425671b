"""Documents to normalised records: ordered filters with exclusive reasons, chunks, counters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.functions import text as X
from siltstone.functions import udfs as U
from siltstone.sources.scans import metadata_field


@dataclass(frozen=True)
class Rules:
    languages: tuple[str, ...] = ()
    licenses: tuple[str, ...] = ()
    license_blocks: tuple[str, ...] = ()
    collections: tuple[str, ...] = ()
    collection_blocks: tuple[str, ...] = ()
    min_year: int | None = None
    max_year: int | None = None
    default_language: str | None = None
    chunking: bool = True
    target_chars: int = 4000
    max_chars: int = 6000
    overlap_chars: int = 400
    min_chars: int = 200
    min_words: int = 20
    low_value: bool = True
    extra: dict = field(default_factory=dict)


def document_reason(df: DataFrame, text: F.Column, rules: Rules):
    """Why a document goes, the first rule that it fails; null if it stays."""
    lang = F.coalesce(F.nullif(metadata_field(df, "language", "lang").cast("string"), F.lit("")), F.lit(rules.default_language))
    licence, group = metadata_field(df, "license", "licence", "open_type"), metadata_field(df, "collection", "source")
    year = X.year_of(metadata_field(df, "date", "timestamp", "created", "publication_date"))
    no = F.lit(False)
    bad_year = (year < rules.min_year if rules.min_year is not None else no) | (year > rules.max_year if rules.max_year is not None else no)
    reason = F.when(text.isNull() | (text == ""), "empty")
    for names, value, wanted, label in ((rules.languages, lang, True, "language_filtered"), (rules.licenses, licence, True, "license_filtered"), (rules.license_blocks, licence, False, "license_filtered"), (rules.collections, group, True, "collection_filtered"), (rules.collection_blocks, group, False, "collection_filtered")):
        if names:
            ok = X.allowed(value, list(names))
            reason = reason.when(~ok if wanted else ok, label)
    return reason.when(F.coalesce(bad_year, no), "date_filtered")


def chunk_reason(text, rules: Rules):
    """Why a chunk goes; null if it stays."""
    reason = F.when(F.length(text) < rules.min_chars, "too_short")
    if not rules.chunking:
        reason = reason.when(F.length(text) > rules.max_chars, "too_long")
    reason = reason.when(X.word_count(text) < rules.min_words, "too_few_words")
    return reason.when(X.looks_low_value(text), "low_value") if rules.low_value else reason


def documents(df: DataFrame, rules: Rules, text: str = "text", clean: bool = True) -> DataFrame:
    """Adds ``clean_text`` and ``reason``. The Arrow function runs once; rules on metadata are native beside it."""
    own = df.withColumn("clean_text", U.normalized(F.col(text)) if clean else F.col(text))
    return own.withColumn("reason", document_reason(df, F.col("clean_text"), rules))


def _chunks(kept: DataFrame, rules: Rules, doc_id: str) -> DataFrame:
    cut = U.chunked(rules.target_chars, rules.max_chars, rules.overlap_chars, rules.min_chars)(F.col("clean_text")) if rules.chunking else F.array("clean_text")
    return kept.select(doc_id, *(c for c in ("lang", "source") if c in kept.columns), cut.alias("_cut"))


def _records(chunks: DataFrame, rules: Rules, doc_id: str) -> DataFrame:
    more = [c for c in ("lang", "source") if c in chunks.columns]
    rows = chunks.select(doc_id, *more, F.posexplode("_cut").alias("chunk_index", "chunk"))
    return rows.select(
        X.record_id(F.col(doc_id), F.col("chunk_index")).alias("id"), F.col(doc_id).cast("string").alias("doc_id"), "chunk_index", F.col("chunk").alias("text"), X.content_hash(F.col("chunk")).alias("text_sha256"),
        F.length("chunk").alias("char_count"), X.word_count(F.col("chunk")).alias("word_count"), *more, chunk_reason(F.col("chunk"), rules).alias("reason"),
    )


def records(df: DataFrame, rules: Rules, doc_id: str = "doc_id", text: str = "text", clean: bool = True) -> DataFrame:
    """Chunks of the documents that stay, each with its own ``reason``. The cleaned documents are stored, so that they are cleaned once."""
    kept = scratch.stored(documents(df, rules, text, clean), "cleaned").filter("reason is null")
    return _records(_chunks(kept, rules, doc_id), rules, doc_id)


def stage_counters(df: DataFrame, rules: Rules, doc_id: str = "doc_id", text: str = "text", clean: bool = True) -> DataFrame:
    """reason, n: what each rule took and what is written; ``seen`` documents; ``oversized_docs_chunked`` and the ``chunks_created`` from them."""
    own = scratch.stored(documents(df, rules, text, clean), "cleaned")
    chunks = scratch.stored(_chunks(own.filter("reason is null"), rules, doc_id), "chunks")
    many = F.size("_cut") > 1
    cut = chunks.agg(F.count_if(many).alias("oversized_docs_chunked"), F.coalesce(F.sum(F.when(many, F.size("_cut"))), F.lit(0)).cast("long").alias("chunks_created"))
    lost = own.filter("reason is not null").select("reason").unionByName(_records(chunks, rules, doc_id).select("reason"))
    seen = own.agg(F.count("*").alias("n")).select(F.lit("seen").alias("reason"), "n")
    return counters(lost).unionByName(seen).unionByName(cut.unpivot([], cut.columns, "reason", "n"))


def counters(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("reason", F.lit("written")).alias("reason")).agg(F.count("*").alias("n"))

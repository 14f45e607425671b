"""One way in: a source's description to raw records, whatever its kind."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.sources import hosted, scans


@dataclass(frozen=True)
class Source:
    name: str
    kind: str = "parquet_local"
    paths: tuple[str, ...] = ()
    dataset: str | None = None
    split: str = "train"
    weight: float = 1.0
    text_field: str | None = None
    metadata: tuple[str, ...] = ()
    max_records: int | None = None
    max_records_per_path: int | None = None
    options: dict = field(default_factory=dict)


def records(spark: SparkSession, source: Source) -> DataFrame:
    """Raw records: source_name, source_type, source_path_or_dataset, source_split, source_weight, doc_id, text, source_row, metadata (JSON).

    Files: only the text and metadata columns are read; a record's id is the first id field that isn't blank, else the
    source's name, the file's and the row's number.
    """
    told = [F.lit(source.name).alias("source_name"), F.lit(source.kind).alias("source_type")]
    if source.kind == "hf_dataset":
        hosted.register(spark)
        options = {"dataset": source.dataset, "name": source.name, "split": source.split, "weight": source.weight, "textField": source.text_field, "metadata": ",".join(source.metadata), "maxRecords": source.max_records, **source.options}
        rows = spark.read.format("hosted_dataset").options(**{k: v for k, v in options.items() if v not in (None, "")}).load()
        return rows.select(*told, F.col("dataset").alias("source_path_or_dataset"), "source_split", "source_weight", "doc_id", "text", "source_row", "metadata")
    if source.kind != "parquet_local":
        raise ValueError(f"no source of kind {source.kind}")
    schema = spark.read.parquet(*source.paths).schema
    text = scans.text_field(schema, source.text_field)
    meta = [c for c in (source.metadata or scans.metadata_fields(schema)) if c in schema.names]
    rows = scans.parquet(spark, list(source.paths), [text, *meta], source.max_records_per_path, source.max_records)
    name = F.element_at(F.split("source_path", "/"), -1)
    ids = [F.col(c) for c in hosted.ID_NAMES if c in meta]
    ident = F.coalesce(*([X.first_id(*ids)] if ids else []), F.concat_ws(":", F.lit(source.name), name, F.col("source_row").cast("string")))
    return rows.select(*told, F.col("source_path").alias("source_path_or_dataset"), F.lit(source.split).alias("source_split"), F.lit(float(source.weight)).alias("source_weight"), ident.alias("doc_id"), F.col(text).cast("string").alias("text"), "source_row", (F.to_json(F.struct(*meta), {"ignoreNullFields": "false"}) if meta else F.lit(json.dumps({}))).alias("metadata"))

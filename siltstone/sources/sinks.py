"""Sinks: row-numbered shards, manifests, Markdown, CSV, packed arrays, upserts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.packing import offsets


def numbered_shards(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Adds ``shard``: exactly ``rows`` rows each in the given order. Numbers come from a two-level prefix sum."""
    placed = offsets(df.withColumn("_one", F.lit(1)), "_one", order)
    return placed.withColumn("shard", F.expr(f"cast(start div {rows} as int)")).drop("_one", "start")


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def csv(df: DataFrame, columns: list[str], path: str) -> None:
    df.select(*columns).write.option("header", True).csv(path)


def manifest(stage: str, config: dict, stats: DataFrame, shards: DataFrame) -> dict:
    """A stage's manifest: one row of counters and the list of shards (a row a file)."""
    import hashlib

    return {"stage": stage, "complete": True, "config_hash": hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest(), "stats": stats.first().asDict(), "shards": [r.asDict() for r in shards.collect()]}


def combined(manifests: list[dict]) -> dict:
    return {"complete": all(m.get("complete") for m in manifests), "stages": {m["stage"]: m for m in manifests}}


def _rows(df: DataFrame, most: int | None) -> tuple[list, str]:
    """A report's rows, and a line that says so where there are more than ``most``."""
    rows = (df if most is None else df.limit(most + 1)).collect()
    return (rows, "") if most is None or len(rows) <= most else (rows[:most], f"The first {most} rows; there are more.")


def markdown(title: str, df: DataFrame, most: int | None = 200) -> str:
    """A report table; for summaries of few rows."""
    rows, more = _rows(df, most)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows), *(["", more] if more else [])]) + "\n"


def html(title: str, sections: dict[str, DataFrame], most: int | None = 200) -> str:
    """A page with a table a section; for summaries of few rows."""
    from html import escape

    out = [f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, df in sections.items():
        line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{escape('' if v is None else str(v))}</{tag}>" for v in cells) + "</tr>"
        rows, more = _rows(df, most)
        out += [f"<h2>{escape(name)}</h2><table>", line("th", df.columns), *(line("td", r) for r in rows), "</table>", *([f"<p>{more}</p>"] if more else [])]
    return "\n".join(out) + "\n"


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def last_of(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows in order: partial limits first, no window over the table."""
    return df.orderBy(F.desc(order)).limit(n)

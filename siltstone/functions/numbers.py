"""Numeric functions as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """As double; null where not numeric or not finite."""
    d = v.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def whole(v: Column) -> Column:
    return v.try_cast("bigint")


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(F.lit(20.0), loss))


def _cosine(progress: Column) -> Column:
    return (F.cos(F.lit(math.pi) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), progress))) + 1) * 0.5


def rate_floor(step: Column, rate: float, warmup: int, total: int, least: float) -> Column:
    """Linear warm-up, then a cosine that never falls under ``least`` of the rate (step or tokens, as ``step`` counts)."""
    progress = (step - warmup) / max(1, total - warmup)
    return F.when((step <= warmup) & F.lit(warmup > 0), step * rate / max(1, warmup)).otherwise(F.greatest(F.lit(least), _cosine(progress)) * rate)


def rate_blend(step: Column, rate: float, warmup: int, total: int, lowest: float) -> Column:
    """Linear warm-up, then a cosine from the rate down to ``lowest``."""
    progress = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, step * rate / max(1, warmup)).otherwise(F.lit(lowest) + _cosine(progress) * (rate - lowest))


def clip_scale(norm: Column, most: float) -> Column:
    return F.when((norm > most) & (norm > 0), F.lit(most) / norm).otherwise(F.lit(1.0))


def ladder(scales: list[float], attempt: Column) -> Column:
    """The attempt's scale; past the end the last."""
    return F.element_at(F.array(*map(F.lit, scales)), (F.least(attempt, F.lit(len(scales) - 1)) + 1).cast("int"))


def accepts(before: Column, after: Column, slack: float, ratio: float) -> Column:
    return after <= before + slack + F.abs(before) * ratio


def sanitized(values: Column) -> tuple[Column, Column]:
    """Non-finite values as 0, and how many there were."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    return F.transform(values, lambda x: F.when(bad(x), F.lit(0.0)).otherwise(x)), F.size(F.filter(values, bad))


#: Units of a size.
UNITS = {"B": 1, "KB": 1000, "KIB": 1024, "MB": 1000**2, "MIB": 1024**2, "GB": 1000**3, "GIB": 1024**3}
TRUE, FALSE = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")


def size_bytes(text: Column) -> Column:
    """Bytes of a size: digits, a fraction perhaps, one of ``UNITS`` perhaps, in any case and spacing. Rounded up, 1 at least; null for anything else."""
    bare = F.regexp_replace(text, "\\s", "")
    part = lambda i: F.regexp_extract(bare, r"(?i)^(\d*\.?\d+)([KMG]?I?B)?$", i)
    unit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for u in UNITS.items() for x in u)), F.upper(part(2))), F.when(part(2) == "", 1))
    amount = part(1).try_cast("double") * unit
    return F.when(amount.isNotNull(), F.greatest(F.lit(1), F.ceil(amount)).cast("long"))


def truth(text: str | bool) -> bool:
    if isinstance(text, bool):
        return text
    t = text.strip().lower()
    if t not in TRUE + FALSE:
        raise ValueError(f"neither true nor false: {text!r}")
    return t in TRUE


def floats(text: str) -> tuple[float, ...]:
    """Comma-separated numbers, one at least."""
    found = tuple(float(x) for x in text.split(",") if x.strip())
    if not found:
        raise ValueError("numbers, separated by commas, are expected")
    return found

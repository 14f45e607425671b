"""Arrow-batched functions for what Spark has no built-in: NFKC, BLAKE2b, chunking, codecs."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: C0 controls except tab, LF and CR; horizontal white space.
_CONTROL, _HORIZONTAL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), re.compile(r"[ \t\r\f\v]+")


def clean(text: str | None) -> str | None:
    if text is None:
        return None
    t = unicodedata.normalize("NFKC", html.unescape(text.replace("﻿", "")))
    t = _CONTROL.sub("", t.replace("\r\n", "\n").replace("\r", "\n"))
    return "\n".join(x for x in (_HORIZONTAL.sub(" ", line).strip() for line in t.split("\n")) if x)


@F.pandas_udf(T.StringType())
def _clean(s: pd.Series) -> pd.Series:
    return s.map(clean)


def normalized(t: Column) -> Column:
    """Entities, compatibility forms, line ends, controls and white space made plain; blank lines go."""
    return _clean(t)


def blake64(data: str) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode(), digest_size=8).digest(), "big")


def vote(tokens) -> int:
    """Signed 64-bit SimHash of tokens; ties count as set, so no token at all sets every bit."""
    if tokens is None or not len(tokens):
        return -1
    seen: dict[str, int] = {}
    for t in tokens:
        seen[t] = seen.get(t, 0) + 1
    bits = np.unpackbits(np.array([blake64(t) for t in seen], ">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    n = np.fromiter(seen.values(), np.int64)
    return int.from_bytes(np.packbits((n[:, None] * (2 * bits - 1)).sum(axis=0) >= 0).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def _simhash(s: pd.Series) -> pd.Series:
    return s.map(vote).astype("int64")


def simhash(tokens: Column) -> Column:
    return _simhash(tokens)


def split_of(fraction: float):
    """Column function: ``val`` for the share ``fraction`` of values by hash, else ``train``."""
    if not 0 <= fraction < 1:
        raise ValueError("fraction must be in [0, 1)")

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else "val" if blake64(v) / float(2**64 - 1) < fraction else "train")

    return run


def _ends(text: str, mark: str) -> list[int]:
    """Where a chunk may end at ``mark``: after the mark's first character, in order."""
    return [m.start() + 1 for m in re.finditer(f"(?={re.escape(mark)})", text)]


def chunks(text: str | None, target: int = 4000, most: int = 6000, overlap: int = 400, least: int = 1) -> list[str]:
    """Overlapping windows of at most ``most`` characters of a text that is longer than that.

    The marks at which a window may end are listed first. A window that doesn't reach the text's end stops at its last
    blank line past half the target, where there is none at its last sentence end there, else at its full width.
    """
    if text is None:
        return []
    if len(text) <= most:
        return [text]
    from bisect import bisect_right

    goal = max(least, target)
    width, back = max(goal, most), max(0, min(overlap, goal // 2))
    marks = [(len(mark), _ends(text, mark)) for mark in ("\n\n", ". ")]

    def end(start: int) -> int:
        if start + width >= len(text):
            return len(text)
        for size, ends in marks:
            # The whole mark lies in the window: it begins one before the cut, and ends by the window's own end.
            place = bisect_right(ends, start + width - size + 1) - 1
            if place >= 0 and ends[place] > max(start + goal // 2, start + 1):
                return ends[place]
        return start + width

    windows, start = [], 0
    while not windows or windows[-1][1] < len(text):
        stop = end(start)
        windows.append((start, stop))
        start = max(stop - back, start + 1)
    return [piece for first, stop in windows if (piece := text[first:stop].strip())]


def chunked(target: int, most: int, overlap: int, least: int = 1):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunks(t, target, most, overlap, least))

    return run


@F.pandas_udf(T.StringType())
def base64_floats(s: pd.Series) -> pd.Series:
    """Little-endian float32 bytes in base64."""
    import base64

    return s.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())


# Codecs over float arrays. Fixed values of the 8-bit format: exponent bias 7, eighths of mantissa, largest 1.875 * 2**8.
BIAS, LARGEST = 7, 480.0


def fp8_encode(x):
    """Nearest code of each value: sign, 4 exponent bits, 3 mantissa bits; clipped to the largest."""
    x = np.clip(np.asarray(x, np.float32), -LARGEST, LARGEST)
    size = np.abs(x)
    power = np.clip(np.floor(np.log2(np.maximum(size, 2.0**-20))), 1 - BIAS, None)
    eighths = np.round(size / 2.0**power * 8)
    # A mantissa rounded up to 16 eighths is the next power's 8.
    up = eighths == 16
    power, eighths = power + up, np.where(up, 8, eighths)
    code = np.where(eighths >= 8, (np.clip(power + BIAS, 1, 15)) * 8 + eighths - 8, eighths).astype(np.uint8)
    return code | ((x < 0) & (code > 0)).astype(np.uint8) << 7 | ((x < 0) & (code == 0)).astype(np.uint8) << 7


def fp8_decode(code):
    code = np.asarray(code, np.uint8)
    power, eighths = (code >> 3 & 15).astype(int), (code & 7).astype(np.float32)
    size = np.where(power > 0, (1 + eighths / 8) * 2.0 ** (power - BIAS), eighths / 8 * 2.0 ** (1 - BIAS))
    return np.where(code & 128, -size, size).astype(np.float32)


def pack(values, bits: int) -> bytes:
    """Signed n-bit integers as their distance from the least one, the low bit first."""
    u = np.asarray(values, np.int64) + ((1 << (bits - 1)) - 1)
    if len(u) and (u.min() < 0 or u.max() >= 1 << bits):
        raise ValueError("a value doesn't fit")
    return np.packbits((u[:, None] >> np.arange(bits) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int):
    raw = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits).astype(np.int64)
    return (raw << np.arange(bits)).sum(axis=1) - ((1 << (bits - 1)) - 1)


def rotation(dim: int, seed: int):
    """A seeded orthogonal matrix; its generator starts from 32 bits of the SHA-256 of ``dim:seed``."""
    start = int.from_bytes(hashlib.sha256(f"{dim}:{seed}".encode()).digest()[:8], "little") % 2**32
    q, r = np.linalg.qr(np.random.default_rng(start).standard_normal((dim, dim), dtype=np.float32))
    return (q * np.where(np.diag(r) < 0, -1, 1)).astype(np.float32)


def rotated_encode(x, bits: int = 4, group: int = 16, residual: float = 0.002, seed: int = 7) -> dict:
    """Rotate, quantise by groups with float16 scales, and keep the largest errors of the values themselves in float16."""
    x = np.asarray(x, np.float32)
    top = (1 << (bits - 1)) - 1
    turned = np.pad(x @ rotation(len(x), seed), (0, -len(x) % group)).reshape(-1, group)
    scale = np.maximum(np.abs(turned).max(axis=1) / top, 1e-8)
    q = np.clip(np.round(turned / scale[:, None]), -top, top).astype(np.int64)
    c = {"n": len(x), "bits": bits, "group": group, "seed": seed, "payload": pack(q.ravel(), bits), "scales": scale.astype(np.float16).tolist(), "at": [], "residuals": []}
    if residual > 0 and len(x):
        left = x - rotated_decode(c)
        at = np.sort(np.argsort(-np.abs(left), kind="stable")[: max(1, int(len(x) * residual))])
        c |= {"at": at.tolist(), "residuals": left[at].astype(np.float16).tolist()}
    return c


def rotated_bytes(c: dict) -> int:
    """What an encoded vector takes: its codes, two bytes a scale, six a residual."""
    return len(c["payload"]) + 2 * len(c["scales"]) + 6 * len(c["at"])


def rotated_decode(c: dict):
    size = len(c["scales"]) * c["group"]
    flat = (unpack(c["payload"], c["bits"], size).reshape(-1, c["group"]) * np.asarray(c["scales"], np.float32)[:, None]).ravel().astype(np.float32)
    out = flat[: c["n"]] @ rotation(c["n"], c["seed"]).T
    out[list(c["at"])] += np.asarray(c["residuals"], np.float32)
    return out


def codec(kind: str, bits: int = 4):
    """Column function: payload, logical bytes and relative error of each array under ``fp16``, ``fp8`` or ``rotated``."""

    @F.pandas_udf(T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("error", T.DoubleType())]))
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for v in s:
            if v is None or not len(v):
                rows.append((b"" if v is not None else None, 0, 0.0))
                continue
            x = np.asarray(v, np.float32)
            if kind == "fp16":
                payload, size = x.astype("<f2").tobytes(), 2 * len(x)
                back = np.frombuffer(payload, "<f2").astype(np.float32)
            elif kind == "fp8":
                scale = max(float(np.abs(x).max()) / LARGEST, 1e-8)
                code = fp8_encode(x / np.float32(scale))
                payload, back, size = code.tobytes(), fp8_decode(code) * np.float32(scale), len(x)
            else:
                c = rotated_encode(x, bits)
                payload, back, size = c["payload"], rotated_decode(c), rotated_bytes(c)
            rows.append((payload, size, float(np.linalg.norm(x - back) / max(np.linalg.norm(x), 1e-12))))
        return pd.DataFrame(rows, columns=["payload", "n_bytes", "error"])

    return run

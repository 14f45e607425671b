"""Byte-level BPE ids and counts through caches of pre-tokens.

The vocabulary file's own library encodes whatever no cache holds. Two facts make the caches exact. A pre-token's ids
do not depend on its neighbours. And a space between two characters that aren't white space starts a pre-token, so a
text may be cut before each such space and its parts be encoded apart. A text goes through in parts of about ``PART``
characters; one that holds an added token's string, or characters that the pattern here might class otherwise than the
library's, is cut at every such space and only the parts concerned go through the library whole.
"""

from __future__ import annotations

import re
import struct
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator

#: Pre-tokens in a generation of a worker's cache; characters of a part.
TOKENS, PART = 350_000, 1 << 16
#: Letters and numbers of Basic Latin to Latin Extended-B, as ranges of a character class.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Characters beyond these ranges go through the library: its Unicode tables may differ from ours.
PLAIN = re.compile("[\u0000-\u001b -\u0084\u0086-ɏ]*")
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
CUT = re.compile(r"(?<=\S) (?=\S)")
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\\s{LETTERS}{NUMBERS}]+|\\s+(?!\\S)|\\s+")


class Cache(dict):
    """A dict of bounded size that asks ``fill`` for a key it lacks; hits stay inside the interpreter's C code.

    It holds two generations of at most ``most`` entries whose keys have at most ``longest`` characters: when the young
    one is full it becomes the old one, and what is asked for again moves back. Frequent keys so outlive any number of
    rare ones.
    """

    def __init__(self, fill: Callable, most: int, longest: int = 64):
        super().__init__()
        self.fill, self.most, self.longest, self.old = fill, most, longest, {}

    def __missing__(self, key):
        if (value := self.old.pop(key, None)) is None:
            value = self.fill(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else the next code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def byte_level(description: dict) -> bool:
    """Whether a tokenizer's JSON is of the kind that ``Encoder`` is exact for: byte-level BPE by the usual pattern, with nothing before or after it."""
    pre, model = description.get("pre_tokenizer") or {}, description.get("model") or {}
    bare = all(description.get(k) is None for k in ("normalizer", "post_processor", "truncation", "padding"))
    return bare and pre.get("type") == "ByteLevel" and pre.get("add_prefix_space") is False and pre.get("use_regex", True) is True and model.get("type") == "BPE" and not model.get("dropout")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, packed in bytes."""

    def __init__(self, path: str | None, library=None, most: int = TOKENS):
        from tokenizers import Tokenizer

        self.library = library or Tokenizer.from_file(path)
        self.model = self.library.model
        self.symbols = [s for _, s in sorted(byte_symbols().items())]
        self.space = self.symbols[0x20]
        added = self.library.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.wide = any(t.lstrip or t.rstrip or " " in t.content for t in added)
        self.tokens = Cache(self.token, most)

    def packed(self, ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if LITTLE else struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        return self.packed(self.library.encode(text, add_special_tokens=False).ids)

    def token(self, t: str) -> bytes:
        """A pre-token's ids."""
        shown = t.replace(" ", self.space) if t.isascii() and t.isprintable() else "".join(map(self.symbols.__getitem__, t.encode()))
        return self.packed([x.id for x in self.model.tokenize(shown)])

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts that can be encoded apart."""
        at = 0
        while len(text) - at > PART and (m := CUT.search(text, at + PART)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(a in text for a in self.added)

    def each(self, text: str, of_token: Callable, of_whole: Callable) -> Iterator[Iterable]:
        """Runs of what ``of_token`` gives for each pre-token and ``of_whole`` for each part that only the library can cut."""
        if self.wide and any(a in text for a in self.added):
            yield (of_whole(text),)
            return
        for part in self.parts(text):
            if self.plain(part):
                yield map(of_token, SPLIT.findall(part))
                continue
            first, *rest = CUT.split(part)
            for p in (first, *map(" ".__add__, rest)):
                yield map(of_token, SPLIT.findall(p)) if self.plain(p) else (of_whole(p),)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(b"".join, self.each(text, self.tokens.__getitem__, self.whole))) if text else b""

"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice's nodes are the boundaries between characters, its edges the model's pieces (byte pieces for a character
without one). Going forward, a boundary keeps the best path that reaches it as one backpointer. Boundaries further back
than the longest piece can gain no edge, so only that window is alive; once the backpointer paths of all live
boundaries run through one boundary, everything before it can't change any more: its ids are committed and dropped.
Memory is bounded by the window and what is not yet committed, whatever the text's length.

Which path is best depends on the model. In a unigram model it is the one of the greatest score sum. In a BPE model it
is the one that the merges give: an edge may follow a path's last piece if merging both pieces' characters gives just
these two, and then exactly one path reaches a boundary, that of the merges of the text so far.

Some character pairs stand in no piece of the model (a letter and the space after it, say): all paths run through the
boundary between them. Texts are cut there first, ``PART`` characters at a time, and a worker keeps the ids of short
stretches in a bounded cache. A stretch without such a boundary, however long, is fed to the search in steps, and its
pieces become ids as they are committed.

Defined cases: null and empty texts have no ids and decode to an empty text; the leading space that the model adds is
taken off again in decoding; U+2581 is the model's sign for a space and decodes to one; unpaired surrogates can't
occur; repeated rows are encoded each; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Cache, slices, worker_state

#: Fixed value: the model's sign for a space.
SPACE = "▁"
CUT = re.compile(f"(?<=[^ {SPACE}]) ")
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model types of the format.
UNIGRAM, BPE = 1, 2
#: Entries of a generation of the cache of stretches; pairs of pieces; characters of a part, and of a step of the search.
STRETCHES, PAIRS, PART, STEP = 500_000, 1 << 19, 1 << 16, 4096


class Model:
    """A model file's pieces, and what the search needs of them."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as fmt

        m = fmt.ModelProto()
        m.ParseFromString(proto)
        spec = m.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only models that leave texts as they are")
        self.kind, self.prefix, self.fallback = m.trainer_spec.model_type, spec.add_dummy_prefix, m.trainer_spec.byte_fallback
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        self.pieces = [p.piece for p in m.pieces]
        self.scores = [p.score for p in m.pieces]
        self.id_of = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (NORMAL, USER, UNUSED)}
        self.unknown = next((i for i, p in enumerate(m.pieces) if p.type == UNKNOWN), 0)
        self.byte_of = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.longest = max(map(len, self.id_of), default=1)
        self.least = min((s for s, p in zip(self.scores, m.pieces, strict=True) if p.type == NORMAL), default=0.0) - 10
        self.starts = {p[:n] for p in self.id_of for n in range(1, len(p) + 1)}
        self.inner = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.raw = [p.piece.replace(SPACE, " ").encode() if p.type in (NORMAL, USER, UNUSED) else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else " ⁇ ".encode() if p.type == UNKNOWN else b"" for p in m.pieces]
        self.after: dict[str, dict[str, bool]] = {}  # follows(), as far as it was asked
        self.asked = 0

    def merged(self, chars: str) -> list[str]:
        """Symbols left when the best-scored neighbouring pair is merged again and again, the leftmost of equals first."""
        symbols, id_of, scores = list(chars), self.id_of, self.scores
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                k = id_of.get(symbols[i] + symbols[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def follows(self, last: str, piece: str) -> bool:
        """May ``piece`` come right after the path's piece ``last`` (empty at the start)? Do the merges give just these two?"""
        return self.merged(last + piece) == ([last, piece] if last else [piece])

    def ids(self, piece: str) -> tuple[int, ...]:
        if (i := self.id_of.get(piece)) is not None:
            return (i,)
        return tuple(self.byte_of[b] for b in piece.encode()) if self.fallback else (self.unknown,)


class Viterbi:
    """The search over one stream of characters: ``feed`` them, then ``finish``; ``drain`` hands over what is committed since."""

    def __init__(self, model: Model):
        self.model = model
        self.text = ""  # from the last committed boundary on
        self.back: list[int] = [0]  # best path's previous boundary, -1: not reached
        self.score: list[float] = [0.0]
        self.before = ""  # the last committed piece
        self.done = 0  # boundaries of text that have been left by all their edges
        self.out: list[str] = []

    def _piece(self, j: int) -> str:
        return self.text[self.back[j] : j] if j else self.before

    def feed(self, chars: str) -> None:
        self.text += chars
        self.back += [-1] * len(chars)
        self.score += [0.0] * len(chars)
        self._run(len(self.text) - self.model.longest)

    def _run(self, until: int) -> None:
        """Follow all edges from the boundaries before ``until``."""
        step, m = 4 * self.model.longest, self.model
        bpe, id_of, starts = m.kind == BPE, m.id_of, m.starts
        while self.done < until:
            text, back, score = self.text, self.back, self.score
            n, stop = len(text), min(until, self.done + step)
            for i in range(self.done, stop):
                if back[i] < 0:
                    continue
                last = text[back[i] : i] if i else self.before
                if bpe and (after := m.after.get(last)) is None:
                    if m.asked > PAIRS:
                        m.after, m.asked = {}, 0
                    after = m.after[last] = {}
                j = i + 1
                piece = text[i:j]
                single = True
                while True:
                    if bpe:
                        if back[j] < 0 and (single or piece in id_of):
                            if (ok := after.get(piece)) is None:
                                ok = after[piece] = m.follows(last, piece)
                                m.asked += 1
                            if ok:
                                back[j] = i
                    elif single or piece in id_of:
                        s = score[i] + (m.scores[id_of[piece]] if piece in id_of else m.least)
                        if back[j] < 0 or s > score[j]:
                            back[j], score[j] = i, s
                    if piece not in starts or j == n:
                        break
                    single = False
                    j += 1
                    piece = text[i:j]
            self.done = stop
            if n > 2 * step:
                until -= self._commit()

    def _commit(self) -> int:
        """Hand out what lies before the last boundary that all live paths run through; how many characters that is."""
        live = {j for j in range(self.done, min(len(self.text), self.done + self.model.longest) + 1) if self.back[j] >= 0}
        while len(live) > 1:
            j = max(live)
            live.remove(j)
            live.add(self.back[j])
        at = live.pop() if live else 0
        if at:
            self._emit(at)
            base = self.score[at]
            self.text, self.back, self.score = self.text[at:], [0, *(b if b < 0 else b - at for b in self.back[at + 1 :])], [0.0, *(s - base for s in self.score[at + 1 :])]
            self.done -= at
        return at

    def _emit(self, at: int) -> None:
        path = []
        while at:
            path.append(self.text[self.back[at] : at])
            at = self.back[at]
        self.before = path[0]
        self.out += reversed(path)

    def drain(self) -> list[str]:
        out, self.out = self.out, []
        return out

    def finish(self) -> list[str]:
        self._run(len(self.text))
        if self.text:
            self._emit(len(self.text))
        self.text, self.back, self.score, self.done = "", [0], [0.0], 0
        return self.drain()


class Codec:
    """Texts to ids (little-endian signed 32-bit, packed) and back, with a cache of stretches between hard boundaries."""

    def __init__(self, proto: bytes, stretches: int | None = None):
        self.model = Model(proto)
        self.cache = Cache(self._stretch, stretches or STRETCHES)
        self.cuts = Cache(self._search, (stretches or STRETCHES) // 2)
        self.plain = not any(a != SPACE and b == SPACE for a, b in self.model.inner)

    def _search(self, chars: str) -> bytes:
        v, ids = Viterbi(self.model), array("i")
        for i in range(0, len(chars), STEP):
            v.feed(chars[i : i + STEP])
            for p in v.drain():
                ids.extend(self.model.ids(p))
        for p in v.finish():
            ids.extend(self.model.ids(p))
        return struct.pack(f"<{len(ids)}i", *ids) if sys.byteorder != "little" else ids.tobytes()

    def _stretch(self, chars: str) -> bytes:
        """Ids of characters with no neighbours; cut where no piece spans, each cut's ids cached."""
        inner, out, start = self.model.inner, [], 0
        for i in range(1, len(chars) + 1):
            if i == len(chars) or chars[i - 1 : i + 1] not in inner:
                out.append(self.cuts[chars[start:i]])
                start = i
        return b"".join(out)

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts that can be encoded apart: the model's space sign starts each but the first."""
        at = 0
        while self.plain and len(text) - at > PART and (m := CUT.search(text, at + PART)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        get, out = self.cache.__getitem__, []
        for i, part in enumerate(self.parts(text)):
            chars = (SPACE if self.model.prefix and not i else "") + part.replace(" ", SPACE)
            if not self.plain:
                out.append(self._stretch(chars))
            elif SPACE * 2 in chars:
                out += map(get, re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", chars))
            else:
                first, *rest = chars.split(SPACE)
                if first:
                    out.append(get(first))
                out += map(get, map(SPACE.__add__, rest))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        import numpy as np

        own = np.frombuffer(ids, "<i4")
        raw = b"".join(b"".join(map(self.model.raw.__getitem__, own[i : i + PART].tolist())) for i in range(0, len(own), PART))
        if self.model.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _codec(model: str, stretches: int | None = None) -> Codec:
    from pathlib import Path

    import public_tokenizers

    return worker_state(f"pieces {model} {stretches}", lambda: Codec(Path(public_tokenizers.path(model)).read_bytes(), stretches))


MODEL = "piece_bpe_32k.model"


def encode(docs: DataFrame, model: str = MODEL, stretches: int | None = None) -> DataFrame:
    """doc_id, ids of every row's whole text; ``model`` names a public model file, ``stretches`` bounds a worker's cache (``STRETCHES``)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        code = _codec(model, stretches).encode
        for b in slices(batches):
            packed = [code(t) for t in b.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(p) >> 2 for p in packed]))).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of every row of ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        back = _codec(model).decode
        for b in slices(batches):
            texts = [back(np.asarray(x or [], "<i4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Each row encoded, then decoded again: doc_id, n_pieces, ids_crc32, decoded_sha256, same (decoded text equals the text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("same", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import zlib

        codec = _codec(model)
        for b in slices(batches):
            rows = []
            for text in b.column(1).to_pylist():
                ids = codec.encode(text)
                decoded = codec.decode(ids)
                rows.append((len(ids) >> 2, zlib.crc32(ids), hashlib.sha256(decoded.encode()).hexdigest(), decoded == (text or "")))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, schema.types[1:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, same boolean")


def op10_sentencepiece(spark, sf_dir) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))

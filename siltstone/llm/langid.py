"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads a segment's bytes in both directions (gated recurrent units), labels every position with a softmax
over the languages, and a document's probabilities are the mean over all its positions. A segment is a run of anything
but ASCII white space, cut at ``SEGMENT`` bytes, between two boundary marks; the state starts anew at each, so equal
segments have equal sums and a worker computes each once (a cache bounded in rows; exact, not an approximation).

Training runs in numpy by backpropagation through time (Adam on the cross-entropy of every position) on the driver. It
sees at most ``DOCS_PER_LANGUAGE`` texts of each language as its fit's bounded sample, and of each text at most
``TRAIN_SEGMENTS`` segments at even distances from its start to its end, from rows whose crc32(doc_id) mod 4 is not 2
and whose lang is not null. Everything else covers all rows: the set of
languages is that of all such rows, and whole texts are predicted. Beyond ``FULL`` languages each has a smaller sample, and
the cache and the steps hold fewer rows, so that memory stays bounded; no language is left out.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a null doc_id is not held out, and never
trained on; with no row to learn from, every prediction is ``und``; with one language that one is predicted; repeated
rows are predicted each; very long words are cut in segments; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import slices, worker_state

DOCS_PER_LANGUAGE, TRAIN_SEGMENTS, FULL = 150, 640, 64
HIDDEN, SEGMENT, STEPS, BATCH, RATE, SEED = 12, 32, 320, 512, 0.02, 7
CACHE_ROWS, EDGE = 200_000, 0x20
#: Pooled probability of the best language below which ``keep`` takes the language as not told.
LEAST = 0.4


def share(most: int, languages: int) -> int:
    """``most`` up to FULL languages, beyond it in inverse proportion."""
    return max(1, most * FULL // max(FULL, languages))


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def lettered(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def segments(text: str) -> list[bytes]:
    out = []
    for w in text.encode("utf-8", "surrogatepass").split():
        if len(w) <= SEGMENT:
            out.append(w)
        else:
            out += [w[i : i + SEGMENT] for i in range(0, len(w), SEGMENT)]
    return out


def _padded(words: list[bytes]):
    """Bytes (words, longest + 2) between boundary marks; lengths."""
    import numpy as np

    n = np.array([len(w) for w in words])
    x = np.full((len(words), int(n.max(initial=0)) + 2), EDGE, np.uint8)
    inside = np.arange(x.shape[1])[None, :]
    x[(inside >= 1) & (inside <= n[:, None])] = np.frombuffer(b"".join(words), np.uint8)
    return x, n


class Network:
    """Two gated recurrent layers (forward, backward) and a softmax at every position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        self.p = {f"{k}{d}": draw(*s) for d in "fb" for k, s in (("x", (256, 3 * hidden)), ("u", (hidden, 2 * hidden)), ("c", (hidden, hidden)))}
        self.p |= {"o": draw(2 * hidden, len(languages)), "a": np.zeros(len(languages), np.float32)}

    def digest(self) -> str:
        """Of the languages and all weights: equal digests predict the same."""
        import hashlib

        h = hashlib.sha256(repr((self.languages, self.hidden)).encode())
        for k in sorted(self.p):
            h.update(k.encode() + self.p[k].tobytes())
        return h.hexdigest()

    @staticmethod
    def _sigmoid(x):
        import numpy as np

        return 0.5 * (np.tanh(0.5 * x) + 1)

    def _layer(self, x, live, d: str, keep: list | None):
        """States after each position, (positions, words, hidden). Where a word has ended (or not begun) the state stays zero."""
        import numpy as np

        h, n = self.hidden, x.shape[1]
        wx, u, c = self.p["x" + d], self.p["u" + d], self.p["c" + d]
        states = np.zeros((x.shape[1], x.shape[0], h), np.float32)
        s = np.zeros((x.shape[0], h), np.float32)
        for t in range(n) if d == "f" else reversed(range(n)):
            g = wx[x[:, t]]
            rz = self._sigmoid(g[:, : 2 * h] + s @ u)
            r, z = rz[:, :h], rz[:, h:]
            cand = np.tanh(g[:, 2 * h :] + (r * s) @ c)
            new = (s + z * (cand - s)) * live[:, t, None]
            if keep is not None:
                keep.append((t, s, r, z, cand))
            s = new
            states[t] = s
        return states

    def _positions(self, words: list[bytes], keep=None):
        import numpy as np

        x, n = _padded(words)
        live = (np.arange(x.shape[1])[None, :] <= n[:, None] + 1).astype(np.float32)
        both = np.concatenate((self._layer(x, live, "f", keep and keep[0]), self._layer(x, live, "b", keep and keep[1])), axis=2)
        logits = both @ self.p["o"] + self.p["a"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return x, n, live, both, e / e.sum(axis=2, keepdims=True)

    def sums(self, words: list[bytes]):
        """Per word the sum of its own bytes' label probabilities (boundary marks left out)."""
        import numpy as np

        _, n, _, _, prob = self._positions(words)
        at = np.arange(prob.shape[0])[:, None]
        return (prob * ((at >= 1) & (at <= n[None, :]))[:, :, None]).sum(axis=0)

    def gradients(self, words: list[bytes], labels):
        """Loss and its gradients, back through time in both layers."""
        import numpy as np

        keep = ([("",)], [("",)])
        x, n, live, both, prob = self._positions(words, keep)
        h = self.hidden
        at = np.arange(prob.shape[0])[:, None]
        mask = ((at >= 1) & (at <= n[None, :])).astype(np.float32)
        total = max(1.0, float(mask.sum()))
        picked = prob[:, np.arange(len(words)), labels]
        loss = float(-(np.log(picked + 1e-9) * mask).sum() / total)
        dl = prob.copy()
        dl[:, np.arange(len(words)), labels] -= 1
        dl *= mask[:, :, None] / total
        g = {"o": np.tensordot(both, dl, axes=([0, 1], [0, 1])), "a": dl.sum(axis=(0, 1))}
        back = dl @ self.p["o"].T
        for d, part, steps in (("f", back[:, :, :h], keep[0][1:]), ("b", back[:, :, h:], keep[1][1:])):
            u, c = self.p["u" + d], self.p["c" + d]
            gx, gu, gc = np.zeros_like(self.p["x" + d]), np.zeros_like(u), np.zeros_like(c)
            ds = np.zeros((len(words), h), np.float32)
            for t, s, r, z, cand in reversed(steps):
                ds = (ds + part[t]) * live[:, t, None]
                dcand = ds * z * (1 - cand * cand)
                drs = dcand @ c.T
                drz = np.concatenate((drs * s * r * (1 - r), ds * (cand - s) * z * (1 - z)), axis=1)
                gc += (r * s).T @ dcand
                gu += s.T @ drz
                np.add.at(gx, x[:, t], np.concatenate((drz, dcand), axis=1))
                ds = ds * (1 - z) + drs * r + drz @ u.T
            g |= {"x" + d: gx, "u" + d: gu, "c" + d: gc}
        return loss, g

    def fit(self, texts: list[tuple[str, int]], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network:
        import numpy as np

        words, labels = [], []
        for text, label in texts:
            own = segments(text)
            words += own
            labels += [label] * len(own)
        if not words:
            return self
        rng, labels = np.random.default_rng(seed), np.array(labels)
        by = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        by = [b for b in by if len(b)]
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            drawn = by if len(by) <= batch else [by[i] for i in rng.choice(len(by), batch, replace=False)]
            at = np.concatenate([rng.choice(b, max(1, batch // len(drawn))) for b in drawn])
            _, g = self.gradients([words[i] for i in at], labels[at])
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, w in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                w -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


class Predictor:
    """Pools a document's positions; sums of segments seen before come from a cache."""

    def __init__(self, network: Network):
        import numpy as np

        self.network = network
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((share(CACHE_ROWS, len(network.languages)), len(network.languages)), np.float32)

    def _fill(self, new: list[bytes]) -> None:
        if not new:
            return
        new = sorted(new, key=len)
        first = len(self.place)
        step = share(4096, len(self.network.languages))
        for i in range(0, len(new), step):
            part = new[i : i + step]
            self.table[first + i : first + i + len(part)] = self.network.sums(part)
        self.place |= {w: first + i for i, w in enumerate(new)}

    def pooled(self, texts: list[str]):
        """Mean label probabilities of each text."""
        import numpy as np

        out = np.zeros((len(texts), len(self.network.languages)))
        for i, text in enumerate(texts):
            own = segments(text)
            total = sum(map(len, own))
            for at in range(0, len(own), CACHE_ROWS // 2):
                part = own[at : at + CACHE_ROWS // 2]
                out[i] += self.table[[self.place[w] for w in part]].sum(axis=0, dtype=np.float64)
            out[i] /= max(1, total)
        return out

    def predict(self, texts: list[str | None], at_once: int = 1 << 20) -> tuple[list[str], list[float]]:
        """Predictions, over runs of texts whose segments fit the cache; a text that has too many alone goes without it."""
        names, scores, run, new, chars, distinct, rows = [], [], [], set(), 0, 0, len(self.table)
        known = bool(self.network.languages)

        def close():
            if len(self.place) + len(new) > rows:
                self.place.clear()
                fresh = {w for t in run if t for w in segments(t)}
            else:
                fresh = new
            self._fill(list(fresh))
            for t, p in zip(run, self.pooled([t or "" for t in run]), strict=True):
                names.append(self.network.languages[int(p.argmax())] if t is not None else "und")
                scores.append(min(1.0, max(0.0, float(p.max()))) if t is not None else 0.0)

        for t in texts:
            ok = known and lettered(t)
            own = set(segments(t)) if ok and len(t) <= at_once * 4 else set()
            if distinct + len(own) > rows:
                close()
                run, new, chars, distinct = [], set(), 0, 0
            if ok and (len(t) > at_once * 4 or len(own) > rows):
                close()
                run, new, chars, distinct = [], set(), 0, 0
                name, score = self._long(t)
                names.append(name)
                scores.append(score)
                continue
            run.append(t if ok else None)
            if ok:
                new.update(w for w in own if w not in self.place)
                chars += len(t)
                distinct += len(own)
            if chars > at_once:
                close()
                run, new, chars, distinct = [], set(), 0, 0
        close()
        return names, scores

    def _long(self, text: str) -> tuple[str, float]:
        """A text whose distinct segments may not fit the cache: in runs of segments."""
        import numpy as np

        own, p = segments(text), np.zeros(len(self.network.languages))
        step = share(8192, len(self.network.languages))
        for i in range(0, len(own), step):
            p += self.network.sums(own[i : i + step]).sum(axis=0)
        p /= max(1, sum(map(len, own)))
        return self.network.languages[int(p.argmax())], min(1.0, max(0.0, float(p.max())))


def sample(rows: DataFrame, most: int = TRAIN_SEGMENTS) -> DataFrame:
    """(lang, text, other columns) with each text cut down to at most ``most`` segments at even distances; texts without a letter go."""
    kept = [c for c in rows.columns if c not in ("lang", "text")]
    parts = rows.filter(F.col("text").rlike("\\p{L}")).select("lang", *kept, F.regexp_extract_all("text", F.lit(f"[^\\x20\\x09-\\x0D]{{1,{SEGMENT}}}"), F.lit(0)).alias("parts"))
    stride = F.ceil(F.size("parts") / most)
    return parts.select("lang", F.array_join(F.filter("parts", lambda _, i: i % stride == 0), " ").alias("text"), *kept)


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Network:
    """A network fitted on the bounded sample.

    Only rows with a letter count. One job counts them by language. A second reads the texts of the rows whose hash of
    (doc_id, text) is below a threshold that about four times the sample of each language passes, and keeps the least hashes
    of each language, so the sample is spread over the table and the same in every run. Rows that repeat both share a hash and
    pass together or not at all: a language that so comes out short is drawn again without a threshold, and has all it can.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Network(languages)
    most = share(docs_per_language, len(languages))
    drawn = _draw(rows, {lang: min(1.0, 4.0 * most / n) for lang, n in counts.items()}, most)
    have = {lang: sum(r["lang"] == lang for r in drawn) for lang in languages}
    if short := {lang: 1.0 for lang in languages if have[lang] < min(most, counts[lang])}:
        drawn = [r for r in drawn if r["lang"] not in short] + _draw(rows, short, most)
    return Network(languages).fit([(r["text"], languages.index(r["lang"])) for r in sorted(drawn, key=lambda r: (r["lang"], r["h"], r["doc_id"], r["text"]))])


def _draw(rows: DataFrame, parts: dict[str, float], most: int) -> list:
    """The ``most`` rows of least hash of each language of ``parts``, among those below its part of the hashes, their texts cut to the sample's length.

    A rank's limit is taken in each task first, so a language's window holds that many rows a task at most.
    """
    below = rows.sparkSession.createDataFrame(list(parts.items()), "l string, part double")
    drawn = rows.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "text")).join(F.broadcast(below), F.col("lang") == F.col("l")).filter("(h / 18446744073709551616d + 0.5d) <= part")
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    return sample(drawn.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most).select("lang", "text", "h", "doc_id")).collect()


def _predicting(docs: DataFrame, network: Network):
    """A worker's predictor of ``network``. Its key is the weights' digest, so no run meets another's network."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    key = f"language {network.digest()}"
    return lambda: worker_state(key, lambda: Predictor(shared.value))


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; prediction reads the text alone."""
    predictor = _predicting(docs, network)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            names, scores = predictor().predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, network: Network, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language the network tells; their ``lang``, where it was null, is the one it tells.

    Rows go that would be ``und``, and those whose best language has a pooled probability below ``least``. Without a
    language to learn, every row is ``und``. The other columns are as they are.
    """
    predictor = _predicting(docs, network)
    text, lang, known = docs.columns.index("text"), docs.columns.index("lang"), bool(network.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(text).to_pylist()
            names, scores = predictor().predict(texts)
            told = [known and lettered(t) and s >= least for t, s in zip(texts, scores, strict=True)]
            filled = pa.array([n if old is None else old for old, n in zip(b.column(lang).to_pylist(), names, strict=True)], b.schema.field(lang).type)
            yield b.set_column(lang, b.schema.field(lang), filled).filter(pa.array(told, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))

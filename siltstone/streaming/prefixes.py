"""The prefix index as a stream with state: inserts, lookups, removal of a tenant, expiry.

Events (tenant_id, model_id, prefix_hash, seq, ts, kv_ref, op): ``insert`` sets a prefix's reference and keeps its hits,
``lookup`` is answered by the last reference and counts a hit, ``evict`` removes all that its tenant holds. A tenant's
entries are dealt to ``buckets`` groups by the hash of model and prefix, each a map in state, so that a tenant with a
third of all events isn't one task's; an eviction goes to every bucket. An entry that isn't used for ``ttl`` seconds of
event time is gone: a lookup past that finds nothing, and a timer at the oldest entry's end takes what has expired out
of state as the watermark passes it, so state is as large as what is alive.

Within a micro-batch events take effect in the order of seq. Answers: (kind, tenant_id, seq, kv_ref, hits, removed): a row per lookup, a
row per bucket and eviction that removed something. Null op, or an insert without a reference, is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "tenant_id string, model_id string, prefix_hash string, seq long, ts timestamp, kv_ref long, op string"
ANSWERS = "kind string, tenant_id string, seq long, kv_ref long, hits long, removed long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PrefixState(StatefulProcessor):
    """One bucket of a tenant: (model_id, prefix_hash) to (kv_ref, hits, used), used in milliseconds of event time."""

    def __init__(self, ttl: float):
        self.ttl = int(ttl * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "model_id string, prefix_hash string", "kv_ref long, hits long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, wake = [], None
        for seq, model, prefix, at, ref, op in pd.concat(rows).sort_values("seq", kind="stable")[["seq", "model_id", "prefix_hash", "ms", "kv_ref", "op"]].itertuples(index=False):
            if op == "evict":
                held = [k for k, v in self.entries.iterator() if v[2] + self.ttl >= at]
                self.entries.clear()
                if held:
                    out.append(("evict", key[0], seq, None, None, len(held)))
                continue
            own = (model, prefix)
            known = self.entries.getValue(own) if self.entries.containsKey(own) else None
            if known is not None and known[2] + self.ttl < at:
                known = None
            if op == "insert" and pd.notna(ref):
                known = (int(ref), known[1] if known else 0, int(at))
            elif op == "lookup":
                if known is not None:
                    known = (known[0], known[1] + 1, int(at))
                out.append(("lookup", key[0], seq, *(known[:2] if known else (None, 0)), None))
            if known is not None:
                self.entries.updateValue(own, known)
                wake = min(x for x in (wake, int(at) + self.ttl + 1) if x is not None)
        if wake is not None and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(wake)
        yield pd.DataFrame(out, columns=["kind", "tenant_id", "seq", "kv_ref", "hits", "removed"]).astype({"kv_ref": "Int64", "hits": "Int64", "removed": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, rest = timerValues.getCurrentWatermarkInMs(), None
        for k, v in list(self.entries.iterator()):
            if v[2] + self.ttl < now:
                self.entries.removeKey(k)
            else:
                rest = min(x for x in (rest, v[2] + self.ttl + 1) if x is not None)
        if rest is not None:
            self.handle.registerTimer(max(rest, now + 1))
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def indexed(events: DataFrame, ttl: float, buckets: int = 16, late: str = "0 seconds") -> DataFrame:
    """Answers of a stream of events; the session's state store must be RocksDB's (``spark.sql.streaming.stateStore.providerClass``, PROVIDER)."""
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    own = F.array(F.pmod(F.xxhash64("model_id", "prefix_hash"), F.lit(buckets)).cast("int"))
    dealt = events.withWatermark("ts", late).filter(F.col("op").isNotNull()).withColumn("bucket", F.explode(F.when(F.col("op") == "evict", every).otherwise(own))).withColumn("ms", F.unix_millis("ts"))
    return dealt.groupBy("tenant_id", "bucket").transformWithStateInPandas(PrefixState(ttl), ANSWERS, "Append", "EventTime")

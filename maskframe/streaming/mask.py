"""Masking a stream: aliases are keyed state of their session.

The scan and the first choice of an alias are a stateless part, the same as in a batch. What an alias depends on besides, which
others the session has issued, is held in two map states of the session: fingerprint to alias, and alias to fingerprint. Rows
of a session are taken in the order of ``order``; a value keeps the alias that it got first, so any split into micro-batches
gives the same rows, and a restart from the checkpoint goes on with the same aliases. A timer ends a session's state after
``idle`` without rows: a later row begins anew.

A batch is one micro-batch: ``mask_stream`` of a table that isn't streaming gives what a stream of it gives. It differs from
``operators.mask.mask`` only where the aliases of two values clash: there the earlier row, here, and the smaller fingerprint,
there, keeps the short one. A session's new rows of a micro-batch are in one task, as its state is.

Defined cases: as for ``mask``: refused rows have no text and a code, rows of unknown sessions are refused, null texts stay
null. With ``most``, further values of a session are refused from there on; what was issued before stays in use.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskframe.operators.detect import SOME, Rules, with_hits
from maskframe.operators.mask import LENGTHS, MASKED, REDACTED, _aliased, alias_of, masked_row

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionAliases(StatefulProcessor):
    """The aliases of one session, over rows (keys as JSON, text, aliased as JSON, error)."""

    def __init__(self, most: int | None, idle_ms: int | None):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.issued = handle.getMapState("issued", "fingerprint string", "alias string")
        self.owner = handle.getMapState("owner", "alias string", "fingerprint string")
        self.count = handle.getValueState("count", "n long")

    def _alias(self, h: dict) -> tuple[str | None, str | None]:
        """(alias, code for which the row is refused) of a hit."""
        if (known := self.issued.getValue((h["fingerprint"],))) is not None:
            return known[0], None
        n = self.count.get()[0] if self.count.exists() else 0
        if self.most is not None and n >= self.most:
            return None, "TOO_MANY_VALUES"
        profile = "prose_identifier" if h["taken"] and h["profile"] == "numeric" else h["profile"]
        first = h["alias"] if not h["taken"] else None
        others = (alias_of(profile, h["entity_type"], h["fingerprint"][:k], h["value"]) for k in LENGTHS if k > LENGTHS[0] or profile != h["profile"])
        for alias in (first, *others):
            if alias is not None and not self.owner.containsKey((alias,)):
                self.issued.updateValue((h["fingerprint"],), (alias,))
                self.owner.updateValue((alias,), (h["fingerprint"],))
                self.count.update((n + 1,))
                return alias, None
        return None, "NO_FREE_ALIAS"

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # held until all are there, so that they can be taken in order; texts are packed meanwhile
        pack = lambda t: None if t is None else zlib.compress(t.encode("utf-8", "surrogatepass"), 1)
        unpack = lambda t: None if t is None else zlib.decompress(t).decode("utf-8", "surrogatepass")
        held: list[tuple] = []
        for frame in rows:
            held += [(order, k, keys, pack(text), aliased, error) for k, (order, keys, text, aliased, error) in enumerate(zip(*(frame[c] for c in ("order", "keys", "text", "aliased", "error")), strict=True), len(held))]
        held.sort(key=lambda r: (pd.isna(r[0]), 0 if pd.isna(r[0]) else r[0], r[1]))  # rows without an order are last
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        for first in range(0, len(held), SOME):
            out = []
            for _, _, keys, text, aliased, error in held[first : first + SOME]:
                hits, changed = json.loads(aliased or "[]"), {}
                for h in hits if not error and not any(h["policy"] == "block" for h in hits) else ():
                    h.setdefault("alias", None)
                    if h["policy"] != "redacted" and h["alias"] not in (None, REDACTED):
                        changed[h["fingerprint"]], why = self._alias(h)
                        error = error or why
                told = masked_row(unpack(text), [{"alias": None} | h for h in hits], changed, error)
                out.append((keys, told.pop("masked"), json.dumps(told, ensure_ascii=False)))
            held[first : first + SOME] = [None] * len(out)
            yield pd.DataFrame({"session_id": [key[0]] * len(out), "keys": [o[0] for o in out], "masked": [o[1] for o in out], "told": [o[2] for o in out]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.issued, self.owner, self.count):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def mask_stream(
    df: DataFrame, sessions: DataFrame, keys: list[str], order: str, text: str, rules: Rules, *, idle_seconds: int | None = None, merge_surface_forms: bool = False, most: int | None = None, **options
) -> DataFrame:
    """df(keys, session_id, order, text), streaming or not -> keys, session_id, masked, blocked_by, aliases, error.

    ``sessions`` is a static table as ``mask`` takes it, ``order`` a long. The state store must be RocksDB
    (``spark.sql.streaming.stateStore.providerClass``). ``idle_seconds`` counts for streams alone."""
    spark = df.sparkSession
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass") or ""):
        raise RuntimeError("aliases of a stream need the state store of RocksDB")
    _ = spark.streams.active  # starts the coordinator of state stores, which a batch alone would not
    rows = with_hits(df.select(*dict.fromkeys([*keys, "session_id", order, text])), text, rules, **options).join(sessions, "session_id", "left")
    error = F.when(F.col("inner_pad").isNull(), "NO_SESSION").otherwise(F.col("__error"))
    hits = F.when(F.col("inner_pad").isNotNull(), F.col("__hits"))
    aliased = _aliased(merge_surface_forms)(F.col(text), hits, F.col("inner_pad"), F.col("outer_pad"))
    own = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = rows.select("session_id", own.alias("keys"), F.col(order).cast("long").alias("order"), F.col(text).alias("text"), F.to_json(aliased).alias("aliased"), error.alias("error"))
    timed = bool(idle_seconds and df.isStreaming)
    state = SessionAliases(most, idle_seconds * 1000 if timed else None)
    out = rows.groupBy("session_id").transformWithStateInPandas(state, "session_id string, keys string, masked string, told string", "Append", "ProcessingTime" if timed else "None")
    shape = df.select(*keys).schema
    told = F.from_json("told", MASKED)
    return out.withColumns({"__keys": F.from_json("keys", shape), "__told": told}).select("__keys.*", "session_id", "masked", "__told.blocked_by", "__told.aliases", "__told.error")

"""Restoring aliases in text that arrives in pieces, as Structured Streaming state or as a batch over stored pieces."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A call's arguments are dropped and reported as an error beyond this many characters.
MAX_ARGUMENT_CHARS = 1_000_000


class Restorer:
    """Pure logic: aliases are replaced longest first, those of digits alone only where no digit touches them; text that
    could still become an alias is held.

    Held is everything from the first place on where the rest of the text is a proper beginning of an alias, moved
    back to the start of any alias found across that place, and so far into a run of digits that its length shows. So
    the output of any split equals that of the whole text."""

    def __init__(self, values: dict[str, str]) -> None:
        self.values = values
        own = (rf"(?<!\d){a}(?!\d)" if a.isdigit() else re.escape(a) for a in sorted(values, key=len, reverse=True))
        self.pattern = re.compile("|".join(own)) if values else None
        self.beginnings = {a[:k] for a in values for k in range(1, len(a) + a.isdigit())}
        self.longest = max(map(len, values), default=0)
        self.digits = any(a.isdigit() for a in values)

    def replace(self, text: str) -> str:
        return self.pattern.sub(lambda m: self.values[m[0]], text) if self.pattern else text

    def feed(self, held: str, piece: str) -> tuple[str, str]:
        """What may go out now, and what to hold."""
        text = held + piece
        if not self.pattern:
            return text, ""
        cut = next((i for i in range(max(0, len(text) - self.longest), len(text)) if text[i:] in self.beginnings), len(text))
        found = [m.span() for m in self.pattern.finditer(text)]
        while True:
            before = cut
            cut = min([cut, *(a for a, b in found if a < cut < b)])
            if self.digits and cut and text[cut - 1].isdigit() and (cut == len(text) or text[cut].isdigit()):
                start = cut
                while start and text[start - 1].isdigit():
                    start -= 1
                cut = max(start, cut - self.longest - 1) if cut == before else cut
                if cut and text[cut - 1].isdigit():
                    break  # longer than any alias, which shows in what is held
            if cut == before:
                break
        # an alias before the cut is whole; one that a longer alias could still replace starts at or after the cut
        return self.replace(text[:cut]), text[cut:]


def restore_pieces(pieces: DataFrame, values: dict[str, str], keys: list[str], idle: str = "4 hours") -> DataFrame:
    """A stream of (keys, seq, piece, is_last) -> keys, seq, piece, restored. State holds one unfinished alias a key; a
    piece marked last sends it out. A key without news for ``idle`` gives up its state and sends out what it held.

    ``values`` (alias to original of one session, literal policy) is bounded by the mappings a session may have."""
    restorer = Restorer(values)
    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", seq bigint, piece string"

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, -1, restorer.replace(held))], columns=[*keys, "seq", "piece"])
            return
        rows, done = [], False
        for r in sorted((r for f in frames for r in f.itertuples()), key=lambda r: r.seq):
            out, held = restorer.feed(held, r.piece or "")
            if r.is_last:
                out, held, done = out + restorer.replace(held), "", True
            rows.append((*key, r.seq, out))
        if done:
            state.remove()
        else:
            state.update((held,))
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame(rows, columns=[*keys, "seq", "piece"])

    return pieces.groupBy(*keys).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def reassembled(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Deltas (keys, seq, chunk, is_done) of call arguments -> keys, arguments, error. Arguments come out only when the
    call is done, are no longer than the cap and are valid JSON; otherwise error says why and arguments are null."""
    whole = deltas.groupBy(*keys).agg(
        F.sum(F.coalesce(F.length("chunk"), F.lit(0))).alias("__n"), F.max("is_done").alias("__done"),
        F.array_sort(F.collect_list(F.struct("seq", "chunk"))).alias("__parts"),
    )
    text = F.array_join(F.transform("__parts", lambda p: p["chunk"]), "")
    error = F.when(~F.col("__done"), F.lit("unfinished")).when(F.col("__n") > MAX_ARGUMENT_CHARS, F.lit("too long")).when(F.try_parse_json(text).isNull(), F.lit("invalid JSON"))
    return whole.withColumn("error", error).select(*keys, F.when(F.col("error").isNull(), text).alias("arguments"), "error")

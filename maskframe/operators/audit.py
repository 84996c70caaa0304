"""Audit output of masking: counts of what happened, taken while the rows are written, and records of single rows.

Counts are observed metrics of the plan that writes the rows (``DataFrame.observe``), so that nothing is read twice. They are
set last in the plan, in the stage that writes: there a partition counts once, however often its task is run. Labels are few by
rule: events, codes of refusal and known entity types are counted by name, others as CUSTOM. No value, alias or text of a row
gets into the output; a session is told by a short fingerprint.

The output is a table (run string, batch long, kind string, label string, n long). Kinds: ``event`` (request_masked,
request_blocked), ``reason`` of the blocked ones (codes of refusal, blocking types; a row with several types counts for
each), ``entity`` (what was found in rows that were not refused). Labels that nothing was counted for have no row. A stream
writes rows and counts of a micro-batch to folders of its number, each anew if the batch is repeated after a failure.

Defined cases: a null text without a refusal is masked, with no entities; null lists count as empty ones; an empty table
gives no rows of output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .metrics import entity_label, short_fingerprint
from .refused import CODES
from .rules import Rule, Terms, built_in
from .scan import Model

SCHEMA = "run string, batch long, kind string, label string, n long"
EVENTS = ("request_masked", "request_blocked")
KNOWN = tuple(sorted({r.entity for r in built_in(corporate=True)}))


def types_of(rules: list[Rule | Terms | Model]) -> tuple[str, ...]:
    """The built-in entity types that rules tell."""
    return tuple(sorted({r.entity for r in rules if not isinstance(r, Model)} & set(KNOWN)))


def _blocked() -> Column:
    return F.size(F.coalesce("blocked_by", F.array().cast("array<string>"))) > 0


def counts(known: tuple[str, ...] = KNOWN) -> dict[tuple[str, str], Column]:
    """(kind, label) -> an aggregate over masked rows (blocked_by, aliases, error), all in one pass."""
    none = F.array().cast("array<string>")
    reasons, types = F.coalesce("blocked_by", none), F.coalesce(F.col("aliases.entity_type"), none)
    found = F.when(F.col("error").isNull(), types).otherwise(none)

    def each(kind: str, of: Column, names: tuple[str, ...]) -> dict[tuple[str, str], Column]:
        told = {(kind, n): F.sum(F.size(of) - F.size(F.array_remove(of, n))) for n in names}
        return told | {(kind, "CUSTOM"): F.sum(F.size(F.filter(of, lambda x: ~x.isin(*names))))}

    events = {("event", "request_masked"): F.count_if(~_blocked()), ("event", "request_blocked"): F.count_if(_blocked())}
    return events | each("reason", reasons, (*CODES, *known)) | each("entity", found, known)


def observed(masked: DataFrame, watch: Observation, known: tuple[str, ...] = KNOWN) -> DataFrame:
    """``masked`` as it is; once it is written, ``output`` tells what was counted."""
    return masked.observe(watch, *(c.alias(f"{kind} {label}") for (kind, label), c in counts(known).items()))


def output(masked: DataFrame, watch: Observation, run: str, batch: int | None = None) -> DataFrame:
    """The rows of SCHEMA for what ``watch`` has seen: one for each label, thus few."""
    rows = [(run, batch, *name.split(" ", 1), n) for name, n in watch.get.items() if n]
    return masked.sparkSession.createDataFrame(rows, SCHEMA)


def write_audited(masked: DataFrame, out: str, log: str, run: str, known: tuple[str, ...] = KNOWN) -> None:
    """Write ``masked`` to the folder ``out``, and append its counts to the table in the folder ``log``."""
    watch = Observation()
    observed(masked, watch, known).write.mode("errorifexists").parquet(out)
    output(masked, watch, run).coalesce(1).write.mode("append").parquet(log)


def stream_audited(masked: DataFrame, out: str, log: str, checkpoint: str, run: str, known: tuple[str, ...] = KNOWN) -> StreamingQuery:
    """The same for a stream, for all that is there now: the rows of a micro-batch go to ``out``/batch=N, its counts to ``log``/batch=N."""

    def write(rows: DataFrame, number: int) -> None:
        watch = Observation()
        observed(rows, watch, known).write.mode("overwrite").parquet(f"{out}/batch={number}")
        output(rows, watch, run, number).drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return masked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def records(masked: DataFrame, keys: list[str], known: tuple[str, ...] = KNOWN) -> DataFrame:
    """A record for each row: keys, event, reason (of several the first), entity_count (of rows that are not refused), session_fp."""
    reason = F.try_element_at(F.array_sort("blocked_by"), F.lit(1))
    return masked.select(
        *keys,
        F.when(_blocked(), EVENTS[1]).otherwise(EVENTS[0]).alias("event"),
        F.when(reason.isNotNull(), entity_label(reason, (*CODES, *known))).alias("reason"),
        F.when(F.col("error").isNull(), F.size(F.coalesce(F.col("aliases.entity_type"), F.array().cast("array<string>")))).alias("entity_count"),
        short_fingerprint(F.col("session_id")).alias("session_fp"),
    )

"""Detection over tables: the scanner in Arrow batches, one scan and no shuffle.

A text that is refused has no hits but an error; ``detections`` tells it as one row that blocks, ``quarantine`` makes a table of
such rows. Texts in which no rule can have a hit, as a built-in expression sees, stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .refused import Refused, split_quarantine
from .rules import Rule, Terms
from .scan import Finder, Hit, Model, Scanner

HIT = (
    "struct<start:int,end:int,value:string,normalized:string,entity_type:string,detector:string,score:double,priority:int,profile:string,policy:string,ord:int>"
)
_TYPES = dict.fromkeys(Hit._fields, pa.string()) | dict.fromkeys(("start", "end", "priority", "ord"), pa.int32()) | {"score": pa.float64()}
HITS = pa.struct([(name, _TYPES[name]) for name in Hit._fields])
Rules = list[Rule | Terms | Model]


def hit_lists(rows: list[list[Hit]]) -> pa.Array:
    """array<HIT> for each row."""
    offsets, flat = [0], []
    for hits in rows:
        flat += hits
        offsets.append(len(flat))
    columns = list(zip(*flat, strict=True)) or [()] * len(HITS)
    cells = [pa.array(c, f.type) for c, f in zip(columns, HITS, strict=True)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(cells, fields=list(HITS)))


class Known:
    """Finders of the last few sessions' aliases, as rows of a session tend to come together."""

    def __init__(self, most: int = 16):
        self.most, self.found = most, {}

    def __call__(self, aliases: list[str] | None) -> Finder | None:
        if not aliases:
            return None
        key = tuple(aliases)
        if key not in self.found:
            if len(self.found) >= self.most:
                self.found.clear()
            self.found[key] = Finder(dict.fromkeys(a for a in aliases if a))
        return self.found[key]


#: Characters of texts that are scanned together, so that a model sees windows of many of them.
TOGETHER = 1 << 20


def groups(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about TOGETHER characters; texts become Python strings a group at a time."""
    first, some, total = 0, [], 0
    for i, t in enumerate(texts):
        some.append(t.as_py())
        total += len(some[-1] or "")
        if total >= TOGETHER:
            yield first, some
            first, some, total = i + 1, [], 0
    if some:
        yield first, some


def may_hit(scanner: Scanner, text: Column) -> Column:
    """False only where no rule can have a hit: for rules that all need one of a few ASCII strings, in texts of ASCII alone
    (other characters may become these in the normal form) that hold none."""
    hints: set[str] = set()
    for r in scanner.rules:
        if not isinstance(r, Rule) or not r.hints:
            return F.lit(True)
        hints.update(h.lower() for h in r.hints)
    return text.rlike(r"[^\x00-\x7F]") | F.lower(text).rlike("|".join(re.escape(h) for h in sorted(hints)))


#: Rows that are Python objects at once.
SOME = 256


def in_slices(run: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """What ``run`` makes of the columns of a batch, of SOME rows at a time."""
    return pa.concat_arrays([run(*(c.slice(i, SOME) for c in columns)) for i in range(0, max(1, len(columns[0])), SOME)])


SCANNED = f"struct<hits:array<{HIT}>,error:string>"


def hits_of(scanner: Scanner, text: Column, kind: Column | None = None, issued: Column | None = None) -> Column:
    """struct<hits: array<HIT>, error: string> of a text column. ``kind`` is the kind of context (prose is cut into segments,
    other kinds are looked at whole), ``issued`` array<string> of the session's aliases, which are not looked into."""

    @F.arrow_udf(SCANNED)
    def run(texts: pa.Array, kinds: pa.Array, aliases: pa.Array) -> pa.Array:
        known, told = Known(), [pa.array([], pa.struct([("hits", pa.list_(HITS)), ("error", pa.string())]))]
        for first, some in groups(texts):
            rows = scanner.scan_many(some, kinds.slice(first, len(some)).to_pylist(), [known(a) for a in aliases.slice(first, len(some)).to_pylist()])
            told.append(pa.StructArray.from_arrays([hit_lists([hits for hits, _ in rows]), pa.array([code for _, code in rows], pa.string())], names=["hits", "error"]))
        return pa.concat_arrays(told)

    own = F.when(may_hit(scanner, text), text) if issued is None and scanner.max_chars is None else text
    return run(own, F.lit("prose") if kind is None else kind, F.lit(None).cast("array<string>") if issued is None else issued)


def with_hits(df: DataFrame, text: str, rules: Rules, out: str = "__hits", *, error: str = "__error", kind: str | None = None, issued: str | None = None, **options) -> DataFrame:
    """``df`` with array<HIT> and the code for which a text is refused (null: looked through); ``options`` are those of
    Scanner. Of one detector's hits of a type on one span the first rule's stays, and hits of the guarded detectors inside a
    UUID go. Null and empty texts have none."""
    found = df.withColumn("__scan", hits_of(Scanner(tuple(rules), **options), F.col(text), F.col(kind) if kind else None, F.col(issued) if issued else None))
    return found.withColumns({out: F.col("__scan.hits"), error: F.col("__scan.error")}).drop("__scan")


def refusal(error: Column, text: Column) -> Column:
    """A refused text as a hit that covers it and blocks."""
    cells = {"start": F.lit(0), "end": F.length(text), "value": F.lit(None), "normalized": F.lit(None), "entity_type": error, "detector": F.lit("refused"), "score": F.lit(1.0), "priority": F.lit(1000), "profile": F.lit("prose_identifier"), "policy": F.lit("block"), "ord": F.lit(-2)}
    return F.array(F.struct(*(c.alias(n) for n, c in cells.items())).cast(HIT))


def detections(df: DataFrame, keys: list[str], text: str, rules: Rules, resolve: bool = True, **options) -> DataFrame:
    """One row per detection: the keys and the fields of HIT. A refused text has one row of the detector ``refused`` whose
    entity type is the code, so that nobody takes it for a clean one."""
    also = [options[k] for k in ("kind", "issued") if options.get(k)]
    rows = with_hits(df.select(*keys, text, *(c for c in also if c not in keys)), text, rules, resolve=resolve, **options)
    found = F.when(F.col("__error").isNotNull(), refusal(F.col("__error"), F.col(text))).otherwise(F.col("__hits"))
    return rows.select(*keys, F.inline(found))


def quarantine(df: DataFrame, text: str, rules: Rules, **options) -> tuple[DataFrame, DataFrame]:
    """``df`` in two tables: rows whose text can be looked through, and refused ones with their ``error``. Both are read
    from one scan each time that one of them is used: keep or write ``df`` with ``with_hits`` to use both."""
    return split_quarantine(with_hits(df, text, rules, error="error", **options).drop("__hits"))


def entity_counts(df: DataFrame, keys: list[str], text: str, rules: Rules, **options) -> DataFrame:
    """keys, entity_type, n: hits of each type before they are settled, counted where they are found. A refused text counts
    once under its code."""
    scanner = Scanner(tuple(rules), **options)

    @F.arrow_udf("map<string,bigint>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            try:
                rows.append(list(scanner.count(t.as_py()).items()))
            except Refused as why:
                rows.append([(why.code, 1)])
            except Exception:  # noqa: BLE001 - as in scan_many
                rows.append([("DETECTOR_FAILED", 1)])
        return pa.array(rows, pa.map_(pa.string(), pa.int64()))

    own = F.when(may_hit(scanner, F.col(text)), F.col(text)) if scanner.max_chars is None else F.col(text)
    return df.select(*keys, F.explode(run(own)).alias("entity_type", "n"))


def blocking(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The entity types that block a document."""
    return rows.where("policy = 'block'").groupBy(*keys).agg(F.array_sort(F.collect_set("entity_type")).alias("blocked_by"))

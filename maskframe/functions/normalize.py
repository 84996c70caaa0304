"""Unicode normalisation with a map back to the original offsets.

Spark has no function for normal forms, so texts outside ASCII go through an Arrow-batched function; ASCII is already
in every normal form and stays in the JVM: it is its own result and its map is the identity.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
MAPPED = "struct<normalized:string,src:array<int>,end:array<int>>"
#: What normalisation may change: a character and the marks that combine with it (of a class other than 0), which are
#: normalised together, unless it is ASCII alone.
UNIT = regex.compile(r"(?s)[\x00-\x7F]\P{Canonical_Combining_Class=0}+|[^\x00-\x7F]\P{Canonical_Combining_Class=0}*")


def _units(text: str, form: str) -> tuple[str, np.ndarray]:
    """The normal form, and for what lies between the units and for the units in turn: where it starts and ends in the
    original, and its characters in the normal form (3 rows)."""
    out, cells, at = [], [], 0
    for m in UNIT.finditer(text):
        a, b = m.span()
        unit = unicodedata.normalize(form, m[0])
        out += (text[at:a], unit)
        cells += ((at, a, a - at), (a, b, len(unit)))
        at = b
    out.append(text[at:])
    cells.append((at, len(text), len(text) - at))
    return "".join(out), np.array(cells, np.int32).T


def _places(cells: np.ndarray, src: np.ndarray, end: np.ndarray) -> None:
    """Fills in where each character of the normal form comes from: original characters src[i] up to end[i]."""
    start, stop, size = cells
    plain = np.repeat(np.arange(len(size)) % 2 == 0, size)
    src[:] = np.repeat(start, size)
    src[plain] += (np.arange(len(src), dtype=np.int32) - np.repeat(np.cumsum(size, dtype=np.int32) - size, size))[plain]
    end[:] = np.where(plain, src + 1, np.repeat(stop, size))


def mapped(text: str, form: str) -> tuple[str, list[int], list[int]]:
    """The normal form, and where each of its characters comes from: original characters src[i] up to end[i]."""
    out, cells = _units(text, form)
    src, end = np.empty((2, len(out)), np.int32)
    _places(cells, src, end)
    return out, src.tolist(), end.tolist()


def _mapped(form: str):
    @F.arrow_udf(MAPPED)
    def run(texts: pa.Array) -> pa.Array:
        # a batch may hold 10,000 texts: their places are filled into two arrays, four bytes a character
        texts_of, cells = [], []
        for t in texts:
            out, own = _units(t.as_py(), form) if t.is_valid else (None, np.zeros((3, 0), np.int32))
            texts_of.append(out)
            cells.append(own)
        ends = np.cumsum([0, *(len(t or "") for t in texts_of)], dtype=np.int32)
        src, end = np.empty((2, ends[-1]), np.int32)
        for own, a, b in zip(cells, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            _places(own, src[a:b], end[a:b])
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x), mask=texts.is_null()) for x in (src, end)]
        return pa.StructArray.from_arrays([pa.array(texts_of, pa.string()), *lists], names=["normalized", "src", "end"])

    return run


def _plain(form: str):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize(form, t))

    return run


def _ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def normalized(text: Column, form: str = "NFKC") -> Column:
    """struct<normalized, src, end>: character i of the result comes from original characters src[i] up to end[i]; the
    maps are null where they are the identity (ASCII). Null gives null fields."""
    if form not in FORMS:
        raise ValueError(f"unknown normal form {form}")
    own = F.struct(text.alias("normalized"), F.lit(None).cast("array<int>").alias("src"), F.lit(None).cast("array<int>").alias("end"))
    # the function sees null for ASCII texts, so that they do not travel to Python
    return F.when(_ascii(text), own).otherwise(_mapped(form)(F.when(~_ascii(text), text)))


def normalized_value(text: Column, form: str = "NFKC") -> Column:
    if form not in FORMS:
        raise ValueError(f"unknown normal form {form}")
    return F.when(_ascii(text), text).otherwise(_plain(form)(F.when(~_ascii(text), text)))


def original_span(mapped: Column, start: Column, end: Column, text: Column) -> Column:
    """struct<start, end> in the original, rounded outward to whole units; an empty span is a point."""
    known = mapped["src"].isNotNull()
    first = F.when(known, F.coalesce(F.get(mapped["src"], start), F.length(text))).otherwise(start)
    last = F.when(end <= start, first).when(known, F.get(mapped["end"], end - 1)).otherwise(end)
    return F.struct(first.alias("start"), last.alias("end"))

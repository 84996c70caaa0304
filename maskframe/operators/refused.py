"""Rows that cannot be handled: each is refused alone, with a code that tells why, and never ends a job.

Operators that look into texts carry a column ``error`` (null: handled). A refused row has no result that could be taken for
a clean one: no hits, no masked text. ``split_quarantine`` makes two tables of such a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODES = {
    "TOO_MANY_SHAPES": "the text holds too many shapes of code and data",
    "TEXT_TOO_LONG": "the text is longer than allowed",
    "PATTERN_TEXT_TOO_LONG": "the text is too long for users' patterns",
    "MODEL_TEXT_TOO_LONG": "the text is too long for the model",
    "MODEL_FAILED": "the model failed on the text",
    "DETECTOR_FAILED": "a detector failed on the text",
    "NO_SESSION": "the row's session is unknown",
    "TOO_MANY_VALUES": "the session has too many values to map",
    "NO_FREE_ALIAS": "no free alias is left in the session",
    "NO_ALIAS_SHAPE": "no alias of the asked shape can be made",
    "ORIGINAL_LEFT": "an original value would be left in the masked text",
}


class Refused(ValueError):
    """A text that is not handled; ``code`` is one of CODES."""

    def __init__(self, code: str):
        super().__init__(CODES[code])
        self.code = code

    def __reduce__(self):
        return Refused, (self.code,)


def split_quarantine(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """The rows that were handled, without the column ``error``, and those that were refused, with it."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())

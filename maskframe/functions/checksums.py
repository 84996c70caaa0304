"""Check digits, as built-in expressions over strings of digits and as plain functions for the scanner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted(digits: Column, weights: tuple[int, ...], first: int = 1) -> Column:
    """Sum of digit times weight, from the ``first`` character on (1 is the leftmost)."""
    return sum((F.coalesce(F.substring(digits, first + i, 1).try_cast("int"), F.lit(0)) * w for i, w in enumerate(weights)), F.lit(0))


def luhn(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def my_number(digits: Column) -> Column:
    """12 digits; the weights of the body are 6..2 and 7..2, and a remainder of 0 or 1 gives 0."""
    rest = weighted(digits, (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)) % 11
    return digits.rlike(r"^\d{12}$") & (F.when(rest <= 1, 0).otherwise(11 - rest) == F.substring(digits, 12, 1).try_cast("int"))


def residence_card(value: Column) -> Column:
    """AA########AA: the weighted first seven digits modulo 11 equal the eighth."""
    return value.rlike(r"^[A-Z]{2}\d{8}[A-Z]{2}$") & (weighted(value, (7, 6, 5, 4, 3, 2, 7), 3) % 11 == F.substring(value, 10, 1).try_cast("int"))


def corporate_number(digits: Column) -> Column:
    """13 digits, the first of which is 9 minus the weighted rest modulo 9."""
    return digits.rlike(r"^\d{13}$") & (9 - weighted(digits, (2, 1) * 6, 2) % 9 == F.substring(digits, 1, 1).try_cast("int"))


def ipv4(value: Column) -> Column:
    """Four octets up to 255 without leading zeros, outside the ranges reserved for documentation."""
    parts = F.split(value, r"\.")
    sound = F.forall(parts, lambda p: (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255) & ((F.length(p) == 1) | ~F.startswith(p, F.lit("0"))))
    return (F.size(parts) == 4) & sound & ~value.rlike(r"^(192\.0\.2|198\.51\.100|203\.0\.113)\.")


def _sum(value: str, weights: tuple[int, ...], first: int = 0) -> int:
    return sum(int(c) * w for c, w in zip(value[first:], weights, strict=False))


def luhn_holds(value: str) -> bool:
    found = [int(c) for c in value if c not in " -"]
    doubled = sum(d * 2 - 9 * (d > 4) for d in found[-2::-2])
    return 13 <= len(found) <= 19 and (doubled + sum(found[::-2])) % 10 == 0


def my_number_holds(value: str) -> bool:
    found = "".join(c for c in value if c.isdigit())
    rest = _sum(found, (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)) % 11
    return len(found) == 12 and (0 if rest <= 1 else 11 - rest) == int(found[11])


def residence_card_holds(value: str) -> bool:
    return _sum(value, (7, 6, 5, 4, 3, 2, 7), 2) % 11 == int(value[9])


def corporate_number_holds(value: str) -> bool:
    return 9 - _sum(value, (2, 1) * 6, 1) % 9 == int(value[0])


def ipv4_holds(value: str) -> bool:
    parts = value.split(".")
    reserved = value.startswith(("192.0.2.", "198.51.100.", "203.0.113."))
    return not reserved and all(int(p) <= 255 and (len(p) == 1 or int(p[0])) for p in parts)


CHECKS = {f.__name__.removesuffix("_holds"): f for f in (luhn_holds, my_number_holds, residence_card_holds, corporate_number_holds, ipv4_holds)}

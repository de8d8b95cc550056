"""Grouping keys made from token attributes, and the arithmetic of relative frequencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: relative frequencies are per million tokens.
MILLION = 1_000_000

# Fixed value: the multi-word pointer at the end of an annotation.
POINTER = r":[0-9]+$"


def strip_pointer(value: Column) -> Column:
    return F.regexp_replace(value, POINTER, "")


def per_million(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole.cast("double") * F.lit(float(MILLION))


def set_text(values: Column) -> Column:
    """A value set written out as one string: ``|a|b|``, the empty set as ``|``."""
    return F.when(F.size(values) > 0, F.concat(F.lit("|"), F.array_join(values, "|"), F.lit("|"))).otherwise(F.lit("|"))


def set_values(values: Column, top: int | None = None) -> Column:
    """The values a set counts under: the first ``top`` ones, or ``''`` for an empty set."""
    chosen = values if top is None else F.slice(values, 1, top)
    return F.when(F.size(values) > 0, chosen).otherwise(F.array(F.lit("")))


def escaped(value: Column) -> Column:
    """A part of a key of several values: blanks and backslashes are escaped, so keys stay apart."""
    return F.regexp_replace(value, r"([ \\])", r"\\$1")


def joined(values: Column) -> Column:
    """Several values as one key, a null as ``''``."""
    return F.array_join(F.transform(values, escaped), " ", "")

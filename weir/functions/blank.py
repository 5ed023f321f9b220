"""Predicates on single values that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(text: Column) -> Column:
    """Null or nothing but spaces."""
    return text.isNull() | (F.length(F.trim(text)) == 0)


def blank_to_null(text: Column) -> Column:
    return F.when(~is_blank(text), text)

"""Localised number parsing as native expressions (CLN-04, CLN-05, CLN-06)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_double(s: Column) -> Column:
    """CLN-06: numeric cast that yields null instead of failing."""
    return F.trim(s).try_cast("double")


def parse_european(s: Column) -> Column:
    """CLN-04: `1.234.567,89` -> 1234567.89; dots and spaces removed first,
    then the comma becomes the decimal point; failure -> null.  A value
    already in dot form (`8992.62`) becomes 899262, as in the reference:
    apply only when the decimal-mark detection says ','."""
    t = F.regexp_replace(F.regexp_replace(s, r"\.", ""), r"\s", "")
    return lenient_double(F.regexp_replace(t, ",", "."))


def parse_multi_mark(s: Column) -> Column:
    """CLN-05: commas become dots, every dot but the last is dropped."""
    t = F.regexp_replace(F.trim(s), ",", ".")
    return lenient_double(F.regexp_replace(t, r"\.(?=.*\.)", ""))

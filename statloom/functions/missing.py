"""Missing-value semantics.

Inside the engine a missing cell is SQL NULL. Sources write several marker
texts instead; each site of the pipeline knows its own set of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker texts, compared after trimming and in upper case.
SHORT_MARKERS = ("", "NULL", "NAN", "NONE", "NA")
SOURCE_MARKERS = (
    "", "NULL", "NAN", "NONE", "NA", "NOT_AVAILABLE_IN_SOURCE", "NO_ASSIST_OR_NOT_RECORDED",
)
ALL_MARKERS = (*SOURCE_MARKERS, "<NA>")

_EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def is_missing(c: Column, markers: tuple[str, ...] = ALL_MARKERS) -> Column:
    """True for NULL and for a marker text; never NULL itself."""
    return c.isNull() | F.upper(strip(c)).isin(*markers)


def null_if_missing(c: Column, markers: tuple[str, ...] = ALL_MARKERS) -> Column:
    return F.when(~is_missing(c, markers), c)


def finite(c: Column) -> Column:
    """A double with NaN and the infinities turned to NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def norm_key(c: Column) -> Column:
    """A reference key without surrounding white space and case; NULL where missing."""
    return F.when(~is_missing(c), F.lower(strip(c)))

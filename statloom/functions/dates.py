"""Dates as people and feeds write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layouts, tried in this order once a weekday in front is gone.
LAYOUTS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("d.M.yy", r"^\d{1,2}\.\d{1,2}\.\d{2}$"),
    ("d/M/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ("d-M-yy", r"^\d{1,2}-\d{1,2}-\d{2}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("MMM d yyyy", r"^[A-Za-z]{3} \d{1,2},? \d{4}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
)


def parse_date(c: Column) -> Column:
    """A date from any of the layouts, day first; NULL for anything else."""
    t = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},? +(?=[A-Za-z]{3} \d|\d{1,2} [A-Za-z])", "")
    t = F.regexp_replace(F.regexp_replace(t, ",", ""), r"[T ]\d{2}:\d{2}.*$", "")
    out = F.lit(None).cast("date")
    for layout, form in reversed(LAYOUTS):
        fixed = F.initcap(t) if "MMM" in layout else t
        out = F.when(t.rlike(form.replace(",?", "")), F.try_to_timestamp(fixed, F.lit(layout)).cast("date")).otherwise(out)
    return out

"""Day labels with two-digit years, as exported series carry them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL = "MM_dd_yy"  # fixed value: the label format of stored series
FIRST_YEAR = 1969  # two-digit years stand for 1969-2068


def day_label(day: Column) -> Column:
    return F.date_format(day, LABEL)


def parse_label(label: Column) -> Column:
    """Inverse of ``day_label``; Spark reads two digits as 2000-2099, so the last third goes back a century."""
    day = F.to_date(label, LABEL)
    return F.when(F.year(day) >= FIRST_YEAR + 100, F.add_months(day, -1200)).otherwise(day)

"""Dataset and ledger profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import ledger_profile  # noqa: F401  (D26)


def dataset_profile(bookings: DataFrame) -> DataFrame:
    """Rows, distinct projects and activities, first and last entry date."""
    return bookings.agg(F.count(F.lit(1)).alias("time_entries_count"),
                        F.countDistinct("project").alias("projects"),
                        F.countDistinct("activity").alias("activities"),
                        F.min("entry_date").alias("date_min"),
                        F.max("entry_date").alias("date_max"))

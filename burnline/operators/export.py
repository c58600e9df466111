"""Export projections and writers.

Exports are plain files written by the executors (one part file per task);
Excel styling and the byte-order mark are not reproduced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed display names of the export files.
SUMMARY_COLUMNS = {
    "project": "Projekt",
    "activity": "Tätigkeit",
    "target_hours": "Sollstunden",
    "actual_hours": "Iststunden",
    "fulfillment_pct": "Erfüllungsstand (%)",
    "status": "Status",
    "customer": "Kunde",
}
DETAIL_COLUMNS = {
    "employee": "Mitarbeiter",
    "hours_logged": "Stunden",
    "project": "Projekt",
    "activity": "Tätigkeit",
    "status": "Status",
    "entry_date": "Datum",
    "comment": "Kommentar",
    "customer": "Kunde",
}
HISTORY_COLUMNS = {
    "project_nr": "Projekt",
    "activity": "Tätigkeit",
    "hours": "Stunden",
    "change_type_label": "Typ",
    "valid_from_text": "Gültig ab",
    "reason": "Begründung",
    "reference": "Referenz",
    "created_by": "Erstellt von",
    "created_at_text": "Erstellt am",
}
ROUNDED_SUMMARY_COLUMNS = ["actual_hours", "target_hours", "fulfillment_pct"]


# A13 ------------------------------------------------------------------------
def summary_export_frame(dashboard: DataFrame) -> DataFrame:
    """Numeric measures coerced (invalid -> NULL) and rounded half-even to 2,
    columns renamed to their display names; other columns kept."""
    out = dashboard
    for c in ROUNDED_SUMMARY_COLUMNS:
        if c in out.columns:
            out = out.withColumn(c, F.bround(F.col(c).try_cast("double"), 2))
    keep = [c for c in SUMMARY_COLUMNS if c in out.columns]
    return out.select(*keep).withColumnsRenamed({c: SUMMARY_COLUMNS[c] for c in keep})


# A14 ------------------------------------------------------------------------
def detail_export_frame(bookings: DataFrame) -> DataFrame:
    """The available detail columns of the bookings, renamed (T20: reads the
    bookings, not the aggregate)."""
    keep = [c for c in DETAIL_COLUMNS if c in bookings.columns]
    return bookings.select(*keep).withColumnsRenamed({c: DETAIL_COLUMNS[c] for c in keep})


# A12 ------------------------------------------------------------------------
def history_export_frame(history_display: DataFrame) -> DataFrame:
    keep = [c for c in HISTORY_COLUMNS if c in history_display.columns]
    return history_display.select(*keep).withColumnsRenamed({c: HISTORY_COLUMNS[c] for c in keep})


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """Header + separator CSV, UTF-8, written in parallel part files."""
    df.write.mode(mode).option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)

"""Target edits: change detection (J2) and the writes it feeds.

Editing a target to X used to append X to the ledger, so balances double
counted (T3). Here rows are paired by *key* (not by position), and the
ledger receives the difference: a positive delta as a correction, a
negative one as a reduction of its absolute value.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

KEY = ["project_nr", "activity"]


def target_deltas(frame: DataFrame) -> DataFrame:
    """Rows of (key, old_target, new_target) whose target moved by more than
    the tolerance (0.01 h), with ``delta`` and the ledger change type."""
    delta = F.col("new_target") - F.col("old_target")
    return (frame.withColumn("delta", delta)
            .filter(F.abs(F.col("delta")) > F.lit(S.TARGET_CHANGE_TOLERANCE))
            .withColumn("change_type", change_type_for(F.col("delta"))))


def change_type_for(delta):
    """A raise is a correction, a cut a reduction (of the absolute value)."""
    return F.when(delta > 0, F.lit("correction")).otherwise(F.lit("reduction"))


def detect_target_changes(original: DataFrame, edited: DataFrame, keys: Sequence[str] = KEY,
                          col: str = "target_hours") -> DataFrame:
    """Pair the original and edited frames by key (not by position; a NULL
    activity is a key like any other) and keep the rows whose target moved by
    more than the tolerance. A key that only one frame has counts as 0 in the
    other: a row added or removed in the editor changes the target too, and
    ``edit`` says which it was (changed, added, removed)."""
    def side(frame: DataFrame, mark: str, name: str) -> DataFrame:
        return frame.select(*(F.col(k).alias(mark + k) for k in keys), F.coalesce(F.col(col).cast("double"), F.lit(0.0)).alias(name),
                            F.lit(True).alias(mark))
    same = reduce(lambda a, b: a & b, (F.col("_o" + k).eqNullSafe(F.col("_e" + k)) for k in keys))
    both = side(original, "_o", "old_target").join(side(edited, "_e", "new_target"), same, "full")
    edit = F.when(F.col("_o").isNull(), "added").when(F.col("_e").isNull(), "removed").otherwise("changed")
    paired = both.select(*(F.when(F.col("_o").isNull(), F.col("_e" + k)).otherwise(F.col("_o" + k)).alias(k) for k in keys),
                         F.coalesce("old_target", F.lit(0.0)).alias("old_target"),
                         F.coalesce("new_target", F.lit(0.0)).alias("new_target"), edit.alias("edit"))
    return target_deltas(paired)


def changes_to_ledger(changes: DataFrame, valid_from: _dt.date, created_by: str,
                      reason: str = "Target edited in dashboard") -> DataFrame:
    """Ledger proposals for detected changes (validate with J1, append with A7)."""
    return changes.select(
        "project_nr", "activity",
        F.abs(F.col("delta")).alias("hours"),
        change_type_for(F.col("delta")).alias("change_type"),
        F.lit(valid_from).cast("date").alias("valid_from"),
        F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("reference"),
        F.lit(created_by).alias("created_by"))


def changes_to_target_records(changes: DataFrame, as_of: _dt.datetime) -> DataFrame:
    """Legacy target records (A9) carrying the new value."""
    return changes.select(F.col("project_nr").alias("project"), "activity",
                          F.col("new_target").alias("target_hours"),
                          F.lit(as_of.isoformat()).alias("timestamp"))

"""Last write wins, for stores that only append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(records: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """The record of the largest ``stamp`` (text) per key. A record without a
    stamp counts as the oldest; of records of one stamp the one with the
    larger values wins. An aggregate, combined before the shuffle."""
    cols = [c for c in records.columns if c not in keys]
    order = F.struct(F.coalesce(F.col(stamp), F.lit("")), *(F.col(c) for c in cols if c != stamp))
    picked = records.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_r"))
    return picked.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in cols))

"""Bookings as a star: narrow fact rows with keys, and the names behind the keys.

An aggregate by names does not need the names on every booking. A star is
aggregated on its keys first, the names are looked up on the aggregated rows,
and these are aggregated once more, as several keys may have one name. So the
bookings are shuffled by what they are joined with, and never by or with text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lookup:
    """Names behind the fact column ``key``: ``frame`` has one row per value of
    its column ``on`` and gives ``columns`` (name -> expression over the frame).
    ``derived`` are expressions over the key itself, known without a lookup."""

    key: str
    frame: DataFrame
    on: str
    columns: dict[str, Column]
    derived: dict[str, Column] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.derived, *self.columns]


@dataclass(frozen=True)
class BookingStar:
    """``facts``: one row per booking with the keys, the measures, ``entry_date`` and what else a booking
    itself says. ``conditions`` (on names) and ``codes`` (frames of project codes, kept by a semi join) are
    applied to the aggregated rows."""

    facts: DataFrame
    lookups: Sequence[Lookup]
    conditions: Sequence[Column] = ()
    codes: Sequence[DataFrame] = ()
    carried: Sequence[str] = ()

    @property
    def names(self) -> list[str]:
        return [n for x in self.lookups for n in x.names]

    def where(self, condition: Column, columns: Optional[Sequence[str]] = None) -> "BookingStar":
        """The star of the bookings that meet ``condition``, which reads ``columns``: at once if they
        are columns of the facts (the default), else after the lookup. Fact columns that are read
        then are carried along as further keys."""
        own = [c for c in columns or () if c not in self.names]
        if columns is None or len(own) == len(columns):
            return replace(self, facts=self.facts.filter(condition))
        return replace(self, conditions=[*self.conditions, condition], carried=[*dict.fromkeys([*self.carried, *own])])

    def within(self, codes: DataFrame) -> "BookingStar":
        """The star of the bookings whose ``project_nr`` is among ``codes``."""
        return replace(self, codes=[*self.codes, codes])

    def reduced(self, measure: Column) -> DataFrame:
        """Aggregated rows with their names: ``actual_hours``, ``entry_count``, ``first_entry`` and
        ``last_entry`` per key. Several rows may have the same names."""
        keys = [*dict.fromkeys([*(x.key for x in self.lookups), *self.carried])]
        rows = self.facts.groupBy(*keys).agg(F.sum(measure).alias("actual_hours"), F.count(F.lit(1)).alias("entry_count"),
                                             F.min("entry_date").alias("first_entry"), F.max("entry_date").alias("last_entry"))
        for x in self.lookups:
            named = x.frame.select(F.col(x.on).alias("_on"), *(c.alias(n) for n, c in x.columns.items()))
            rows = rows.withColumns(x.derived).join(named, F.col(x.key) == F.col("_on"), "left").drop("_on")
        for condition in self.conditions:
            rows = rows.filter(condition)
        for codes in self.codes:
            rows = rows.join(codes, "project_nr", "left_semi")
        return rows.select(*self.names, "actual_hours", "entry_count", "first_entry", "last_entry")

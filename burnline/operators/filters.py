"""Projections, filters and predicates (B1-B19), entitlement and existence
checks (C3, C4), distinct project lists (G1).

Row filters are plain predicates on the scan so Catalyst pushes them into the
Parquet reader. Lists that may be long (projects, entitlements) are applied
as a left-semi join instead of a giant IN list.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field, replace
from typing import Iterable, Optional, Sequence, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalar as H
from ..sources.star import BookingStar

ProjectList = Union[Sequence[Optional[str]], DataFrame, None]
Bookings = Union[DataFrame, BookingStar]


# B1 -------------------------------------------------------------------------
def clean_codes(codes: Iterable[Optional[str]]) -> list[str]:
    """Drop NULL / blank codes and trim the rest (a user parameter list)."""
    return [c.strip() for c in codes if c is not None and str(c).strip() != ""]


def clean_code_frame(codes: DataFrame, col: str = "project_nr") -> DataFrame:
    """Distributed form of :func:`clean_codes` for a list held as a DataFrame."""
    return (codes.select(F.trim(F.col(col)).alias(col))
            .filter(F.col(col).isNotNull() & (F.col(col) != ""))
            .distinct())


# B2 / C4 --------------------------------------------------------------------
def filter_projects(df: DataFrame, projects: ProjectList, col: str = "project_nr") -> DataFrame:
    """Keep rows whose project code is in ``projects``.

    A Python list is cleaned (B1) and becomes an IN predicate that reaches the
    scan; an empty list yields no rows. A DataFrame of codes is applied as a
    left-semi join (Catalyst/AQE choose broadcast or shuffle by its size).
    ``None`` means no restriction.
    """
    if projects is None:
        return df
    if isinstance(projects, DataFrame):
        codes = clean_code_frame(projects, col)
        return df.join(codes, on=col, how="left_semi")
    cleaned = clean_codes(projects)
    if not cleaned:
        return df.limit(0)
    return df.filter(F.col(col).isin(cleaned))


# B3-B8, B10-B13 -------------------------------------------------------------
@dataclass
class BookingFilters:
    """Filter set of the dashboard (all optional; empty selection = no filter)."""
    projects: ProjectList = None
    year: Optional[int] = None
    month: Optional[int] = None
    status: Optional[str] = None
    statuses: Optional[Sequence[str]] = None
    start_date: Optional[_dt.date] = None
    end_date: Optional[_dt.date] = None
    activity: Optional[str] = None
    activities: Optional[Sequence[str]] = None
    employees: Optional[Sequence[str]] = None
    search_term: Optional[str] = None
    search_literal: bool = False
    search_columns: Sequence[str] = field(default_factory=lambda: ["activity", "project", "customer"])
    prune_months: bool = False  # add the (year, month) partition predicate to date ranges


def date_range_predicate(start=None, end=None, col: str = "entry_date") -> Column:
    """Closed range on a DATE column; either end optional."""
    preds = []
    if start is not None:
        preds.append(F.col(col) >= F.lit(start).cast("date"))
    if end is not None:
        preds.append(F.col(col) <= F.lit(end).cast("date"))
    return H.all_of(preds)


def month_partition_predicate(start=None, end=None) -> Column:
    """The (year, month) range covering [start, end], on the partition
    columns of a month-partitioned bookings table, so the scan skips whole
    directories (a predicate on ``entry_date`` alone cannot)."""
    ym = F.col("year") * 100 + F.col("month")
    preds = []
    if start is not None:
        preds.append(ym >= F.lit(start.year * 100 + start.month))
    if end is not None:
        preds.append(ym <= F.lit(end.year * 100 + end.month))
    return H.all_of(preds)


def default_date_window(as_of: _dt.date, start=None, end=None) -> tuple[_dt.date, _dt.date]:
    """Default [as_of - 2 years, as_of]; a single date means that day."""
    if start is not None and end is None:
        return start, start
    if start is None and end is not None:
        return end, end
    if start is not None and end is not None:
        return start, end
    try:
        two_years_ago = as_of.replace(year=as_of.year - 2)
    except ValueError:  # 29 February
        two_years_ago = as_of.replace(year=as_of.year - 2, day=28)
    return two_years_ago, as_of


def search_predicate(term: str, columns: Sequence[str], literal: bool = False) -> Column:
    """Case-insensitive regex over the columns, OR-ed; NULL = no match."""
    return H.any_of([H.regex_contains(c, term, literal) for c in columns])


def _last_day(year: int, month: int) -> _dt.date:
    return _dt.date(year + month // 12, month % 12 + 1, 1) - _dt.timedelta(days=1)


def booking_predicate(f: BookingFilters) -> Column:
    """The conjunction of every set filter (TRUE if none is set)."""
    preds = []
    if f.year is not None:  # as a closed date range too: that reaches the scan and its statistics
        first, last = _dt.date(int(f.year), f.month or 1, 1), _last_day(int(f.year), f.month or 12)
        preds += [F.col("year") == F.lit(int(f.year)), date_range_predicate(first, last)]
    if f.month is not None:
        preds.append(F.col("month") == F.lit(int(f.month)))
    if f.status:
        preds.append(F.col("status") == F.lit(f.status))
    if f.statuses and S.ALL_OPTION not in f.statuses:
        preds.append(F.col("status").isin(list(f.statuses)))
    if f.start_date is not None or f.end_date is not None:
        preds.append(date_range_predicate(f.start_date, f.end_date))
        if f.prune_months:
            preds.append(month_partition_predicate(f.start_date, f.end_date))
    if f.activity is not None:
        preds.append(F.col("activity") == F.lit(f.activity))
    if f.activities:
        preds.append(F.col("activity").isin(list(f.activities)))
    if f.employees:
        preds.append(F.col("employee").isin(list(f.employees)))
    if f.search_term:
        preds.append(search_predicate(f.search_term, f.search_columns, f.search_literal))
    return H.all_of(preds)


def apply_filters(df: Bookings, f: BookingFilters) -> Bookings:
    """Apply the whole filter set; written before any aggregation so the
    predicates reach the scan (the dashboard applies employee/search after
    aggregating; the result is the same because both are group keys). In a
    star, predicates on names wait for the lookup on the aggregated rows."""
    if not isinstance(df, BookingStar):
        return filter_projects(df, f.projects).filter(booking_predicate(f))
    by_name = BookingFilters(activity=f.activity, activities=f.activities, employees=f.employees)
    by_search = BookingFilters(search_term=f.search_term, search_literal=f.search_literal, search_columns=f.search_columns)
    own = replace(f, projects=None, activity=None, activities=None, employees=None, search_term=None)
    star = df.where(booking_predicate(own))
    if f.activity is not None or f.activities or f.employees:
        star = star.where(booking_predicate(by_name), ["activity", "employee"])
    if f.search_term:
        star = star.where(booking_predicate(by_search), f.search_columns)
    if isinstance(f.projects, DataFrame):
        return star.within(clean_code_frame(f.projects))
    if f.projects is not None:
        return star.where(F.col("project_nr").isin(clean_codes(f.projects)), ["project_nr"])
    return star


# F1 -------------------------------------------------------------------------
def order_bookings(df: DataFrame) -> DataFrame:
    """Project, activity, newest entry first (a range-partitioned sort)."""
    return df.orderBy("project", "activity", F.col("entry_date").desc())


# B9 -------------------------------------------------------------------------
def option_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null values of a column (the 'all' option)."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


# B13 ------------------------------------------------------------------------
def measure(name: str = S.DEFAULT_MEASURE) -> Column:
    """The chosen measure column cast to DOUBLE (whitelisted names only)."""
    if name not in S.MEASURE_COLUMNS:
        raise ValueError(f"unknown measure column {name!r}; choose from {sorted(S.MEASURE_COLUMNS)}")
    return F.col(name).cast("double")


# B14 ------------------------------------------------------------------------
BOOKING_COLUMNS = [f.name for f in S.BOOKINGS_SCHEMA.fields]


# B15 ------------------------------------------------------------------------
def history_filter(ledger: DataFrame, activity: Optional[str] = None,
                   change_type: Optional[str] = None) -> DataFrame:
    preds = []
    if activity and activity != S.ALL_OPTION:
        preds.append(F.col("activity") == F.lit(activity))
    if change_type and change_type != S.ALL_OPTION:
        preds.append(F.col("change_type") == F.lit(change_type))
    return ledger.filter(H.all_of(preds))


# B16 ------------------------------------------------------------------------
def valid_at(date, col: str = "valid_from") -> Column:
    return F.col(col) <= F.lit(date).cast("date") if not isinstance(date, Column) else F.col(col) <= date


# B17 ------------------------------------------------------------------------
def recent_predicate(as_of: Column, days: int = 28, col: str = "booking_ts") -> Column:
    return F.col(col) >= F.timestamp_add("DAY", F.lit(-days), as_of)


# B19 ------------------------------------------------------------------------
def filter_summary(filtered: DataFrame, f: BookingFilters) -> DataFrame:
    """One row: number of active filters, their texts, and the row count.

    The texts describe the parameters (driver-side values); the row count is
    the only data-dependent part and is a distributed ``count``.
    """
    texts = []
    if f.start_date is not None and f.end_date is not None:
        texts.append(S.FILTER_PERIOD_TEXT.format(start=f.start_date.strftime("%d.%m.%Y"), end=f.end_date.strftime("%d.%m.%Y")))
    for name, label in S.FILTER_LIST_LABELS.items():
        if values := getattr(f, name):
            vals = [str(v) for v in values if v is not None]
            texts.append(f"{label}: {', '.join(vals)}" if 0 < len(vals) <= 3
                         else S.FILTER_SELECTED_TEXT.format(label=label, count=len(vals)))
    if f.search_term:
        texts.append(S.FILTER_SEARCH_TEXT.format(term=f.search_term))
    return filtered.agg(F.count(F.lit(1)).alias("record_count")).select(
        F.lit(len(texts)).cast("bigint").alias("active_filters"),
        F.array(*[F.lit(t) for t in texts]).cast("array<string>").alias("filter_texts"),
        "record_count")


# C3 -------------------------------------------------------------------------
def validate_projects(requested: DataFrame, known: DataFrame, col: str = "project_nr") -> DataFrame:
    """Each requested code with ``exists``; blank codes are never valid.

    ``requested`` and ``known`` are DataFrames with a ``col`` column; the
    check is one left join against the distinct known codes.
    """
    req = requested.select(F.col(col).alias("requested"),
                           F.trim(F.col(col)).alias("_code"))
    codes = known.select(F.col(col).alias("_code")).filter(F.col("_code").isNotNull()).distinct() \
        .withColumn("_hit", F.lit(True))
    return (req.join(codes, on="_code", how="left")
            .select("requested", F.col("_code").alias(col),
                    (F.coalesce(F.col("_hit"), F.lit(False)) & ~H.is_blank("_code")).alias("exists")))


def unknown_projects(requested: DataFrame, known: DataFrame, col: str = "project_nr") -> DataFrame:
    return clean_code_frame(requested, col).join(known.select(col), col, "left_anti")


# C4 / A15 -------------------------------------------------------------------
def user_projects(entitlements: DataFrame) -> DataFrame:
    """Flatten ``users: map<email, struct<projects, permissions>>`` to
    (email, project_nr) rows; NULL / blank codes dropped."""
    users = entitlements.select(F.explode("users").alias("email", "grant"))
    return (users.select("email", F.explode_outer("grant.projects").alias("project_nr"))
            .select("email", F.trim("project_nr").alias("project_nr"))
            .filter(F.col("project_nr").isNotNull() & (F.col("project_nr") != "")))


def user_permissions(entitlements: DataFrame) -> DataFrame:
    """(email, permission) rows; a user without a permission list gets the defaults."""
    users = entitlements.select(F.explode("users").alias("email", "grant"), "default_permissions")
    perms = F.coalesce(F.col("grant.permissions"), F.col("default_permissions"))
    return users.select("email", F.explode_outer(perms).alias("permission"))


def has_permission(entitlements: DataFrame, email: str, permission: str) -> DataFrame:
    """One row (email, permission, granted); unknown users get the defaults."""
    users = entitlements.select(F.try_element_at("users", F.lit(email)).alias("grant"), "default_permissions")
    perms = F.coalesce(F.col("grant.permissions"), F.col("default_permissions"), F.array().cast("array<string>"))
    return users.select(F.lit(email).alias("email"), F.lit(permission).alias("permission"),
                        F.array_contains(perms, F.lit(permission)).alias("granted"))


def restrict_to_user(df: Bookings, entitlements: DataFrame, email: str) -> Bookings:
    """C4: row-level entitlement as a left-semi join on the user's projects."""
    allowed = user_projects(entitlements).filter(F.col("email") == F.lit(email)).select("project_nr")
    return df.within(allowed) if isinstance(df, BookingStar) else df.join(allowed, "project_nr", "left_semi")


# G1 -------------------------------------------------------------------------
def project_list(bookings: DataFrame, projects: ProjectList = None) -> DataFrame:
    """Distinct (project, project_nr, customer), ordered by project."""
    return (filter_projects(bookings, projects)
            .select("project", "project_nr", "customer").distinct()
            .orderBy("project", "project_nr", "customer"))

"""Column functions (H1-H18). All are built-in Spark expressions: no UDFs."""

from __future__ import annotations

import re as _re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S
from .regex import to_java


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# H1 -------------------------------------------------------------------------
def is_blank(col) -> Column:
    """NULL or only whitespace."""
    c = _c(col)
    return c.isNull() | (F.length(F.trim(c)) == 0)


# H2 -------------------------------------------------------------------------
def parse_list(col, sep: str = ",") -> Column:
    """'a, b,,c ' -> ['a','b','c']: split on ``sep``, trim, drop blanks."""
    parts = F.transform(F.split(_c(col), _re.escape(sep)), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != F.lit(""))


# H3 / B11 -------------------------------------------------------------------
def regex_contains(col, term: str, literal: bool = False) -> Column:
    """Case-insensitive regex search; NULL counts as no match.

    The term is written as for Python's ``re`` and rewritten for Spark's
    ``rlike``; a term that is no Python regex is taken as one of Java's, as it
    is. The case of all letters is folded, umlauts included. With ``literal``
    the term is quoted.
    """
    try:
        pattern = to_java(_re.escape(term) if literal else term)
    except _re.error:
        pattern = term
    return F.coalesce(_c(col).rlike("(?iu)" + pattern), F.lit(False))


# H4 -------------------------------------------------------------------------
def ellipsize(col, width: int) -> Column:
    """First ``width`` characters + '...' when longer than ``width``."""
    c = _c(col)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def list_head(col, n: int = 2) -> Column:
    """The first ``n`` items, of these the non-null ones joined by ', ', plus
    '...' when the list has more than ``n``; a fixed text for an empty list."""
    arr = _c(col)
    head = F.array_join(F.filter(F.slice(arr, 1, n), lambda x: x.isNotNull()), ", ")
    more = F.when(F.size(arr) > n, F.lit("...")).otherwise(F.lit(""))
    return F.when(F.coalesce(F.size(arr), F.lit(0)) <= 0, F.lit(S.NO_PROJECTS)).otherwise(F.concat(head, more))


# H5 -------------------------------------------------------------------------
def fmt_date(col) -> Column:
    return F.date_format(_c(col), "dd.MM.yyyy")


def fmt_datetime(col) -> Column:
    return F.date_format(_c(col), "dd.MM.yyyy HH:mm")


# H7 -------------------------------------------------------------------------
def micros_between(start, end) -> Column:
    """Exact microseconds from ``start`` to ``end`` (TIMESTAMP_NTZ or TIMESTAMP)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def floor_days_between(start, end) -> Column:
    """Whole days from start to end, floored (a later ``start`` gives -1 or less)."""
    return F.floor(micros_between(start, end) / F.lit(86_400_000_000.0)).cast("bigint")


# Exact sums ----------------------------------------------------------------
def exact_sum(col, scale: int = 2) -> Column:
    """SUM of a DOUBLE column whose values carry ``scale`` decimals, taken as
    DECIMAL so the result does not depend on row order; returned as DOUBLE."""
    return F.sum(_c(col).cast(f"decimal(38,{scale})")).cast("double")


# H8 -------------------------------------------------------------------------
def round_half_even(col, scale: int = 1) -> Column:
    return F.bround(_c(col), scale)


# H9 -------------------------------------------------------------------------
def fulfillment_status(actual, target) -> Column:
    """Traffic light on the unrounded ratio, evaluated in DOUBLE.

    target = 0 -> no target; <= 100 % ok; <= 110 % critical; else over.
    The ratio keeps the order of operations (actual / target) * 100, so
    exactly 110 % evaluates to 110.00000000000001 and is 'over'.
    """
    a = _c(actual).cast("double")
    t = _c(target).cast("double")
    pct = F.try_divide(a, t) * F.lit(100)
    return (F.when(t == 0, F.lit(S.STATUS_NO_TARGET))
            .when(pct <= S.STATUS_OK_MAX_PCT, F.lit(S.STATUS_OK))
            .when(pct <= S.STATUS_CRITICAL_MAX_PCT, F.lit(S.STATUS_CRITICAL))
            .otherwise(F.lit(S.STATUS_OVER)))


def fulfillment_pct(actual, target) -> Column:
    """actual / target * 100, 0 when target <= 0."""
    a = _c(actual).cast("double")
    t = _c(target).cast("double")
    return F.when(t > 0, a / t * F.lit(100)).otherwise(F.lit(0.0))


def share_pct(part, total) -> Column:
    """part / total * 100, 0 when total <= 0."""
    p = _c(part).cast("double")
    t = _c(total).cast("double")
    return F.when(t > 0, p / t * F.lit(100)).otherwise(F.lit(0.0))


# H10 ------------------------------------------------------------------------
def badge_class(status) -> Column:
    s = _c(status)
    return (F.when((s == S.STATUS_OK) | s.contains(S.BADGE_SUCCESS[1]), F.lit(S.BADGE_SUCCESS[0]))
            .when((s == S.STATUS_CRITICAL) | s.contains(S.BADGE_WARNING[1]), F.lit(S.BADGE_WARNING[0]))
            .when((s == S.STATUS_OVER) | s.contains(S.BADGE_DANGER[1]), F.lit(S.BADGE_DANGER[0]))
            .otherwise(F.lit(S.BADGE_INFO_CLASS)))


def badge_text(status) -> Column:
    s = _c(status)
    return (F.when((s == S.STATUS_OK) | s.contains(S.BADGE_SUCCESS[1]), F.lit(S.BADGE_SUCCESS[1]))
            .when((s == S.STATUS_CRITICAL) | s.contains(S.BADGE_WARNING[1]), F.lit(S.BADGE_WARNING[1]))
            .when((s == S.STATUS_OVER) | s.contains(S.BADGE_DANGER[1]), F.lit(S.BADGE_DANGER[1]))
            .otherwise(s))


# H11 ------------------------------------------------------------------------
def burndown_color(current, target) -> Column:
    c = _c(current).cast("double")
    t = _c(target).cast("double")
    pct = F.try_divide(c, t) * F.lit(100)
    return (F.when(~(t > 0) | t.isNull(), F.lit("blue"))
            .when(pct <= 100, F.lit("green"))
            .when(pct <= 110, F.lit("orange"))
            .otherwise(F.lit("red")))


# H13 ------------------------------------------------------------------------
def clamp(col, low=None, high=None) -> Column:
    c = _c(col)
    if low is not None:
        c = F.greatest(c, F.lit(low))
    if high is not None:
        c = F.least(c, F.lit(high))
    return c


# H15 ------------------------------------------------------------------------
def sprint_label(sprint_number, chart: bool = False) -> Column:
    n = _c(sprint_number)
    current = S.CURRENT_SPRINT_CHART_LABEL if chart else S.CURRENT_SPRINT_LABEL
    return F.when(n > 0, F.concat(F.lit("Sprint -"), n.cast("string"))).otherwise(F.lit(current))


def pct_text(fraction, decimals: int = 0) -> Column:
    return F.format_string(f"%.{decimals}f%%", _c(fraction) * F.lit(100.0))


def hours_text(hours, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}fh", _c(hours).cast("double"))


# B12 ------------------------------------------------------------------------
def all_of(predicates) -> Column:
    """Conjunction; the empty conjunction is TRUE (the vacuous 1=1)."""
    preds = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def any_of(predicates) -> Column:
    preds = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a | b, preds, F.lit(False))


# C5 -------------------------------------------------------------------------
def change_type_label(col) -> Column:
    """Display label of a change type; unknown codes are shown as they are."""
    pairs = []
    for key, label in S.CHANGE_TYPE_LABELS.items():
        pairs += [F.lit(key), F.lit(label)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(col)), _c(col))

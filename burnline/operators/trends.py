"""Time-series operators on booking series (D13-D15, D20-D24, E2, E3, E5,
I13, I15).

A *series* has the unit keys (e.g. ``project_nr`` or ``project_nr,
activity``), ``booking_ts`` and ``hours``. Everything is first reduced to one
row per (unit, day) or (unit, week) by a partial aggregation, so windows
only ever run over calendar-bounded partitions, whatever the skew of the
raw bookings.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalar as H
from .filters import measure, recent_predicate


def booking_series(bookings: DataFrame, measure_col: str = S.DEFAULT_MEASURE) -> DataFrame:
    """The booking series at its daily grain.

    One row per (project_nr, activity, booking_ts) with the summed measure
    ``hours`` and the number of bookings ``n`` (NULL timestamps kept as their
    own group). All trend and forecast operators are additive over this
    grain, so they share this one aggregate (and its shuffle) instead of
    rescanning the bookings, and a hot project is combined map-side.
    """
    return (bookings.groupBy("project_nr", "activity", "booking_ts")
            .agg(F.sum(measure(measure_col)).alias("hours"), F.count(F.lit(1)).alias("n")))


# F3 -------------------------------------------------------------------------
def order_series(series: DataFrame) -> DataFrame:
    """Series in booking order."""
    return series.orderBy("project_nr", "activity", "booking_ts")


# D13 ------------------------------------------------------------------------
def daily_totals(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hours per unit and booking timestamp (NULL timestamps dropped, as a
    pandas group-by on the date would)."""
    return (series.filter(F.col("booking_ts").isNotNull())
            .groupBy(*keys, "booking_ts").agg(F.sum("hours").alias("hours")))


# E2 / E3 --------------------------------------------------------------------
def cumulative(df: DataFrame, keys: Sequence[str], ts: str, value: str, out: str) -> DataFrame:
    """Running total of ``value`` per ``keys`` in ``ts`` order, for rows unique
    per (keys, ts): one window, whose partitions hold one row per point of
    time of a key. Keys may be NULL (e.g. the activity of project rows)."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(w))


def cumulative_within_days(df: DataFrame, keys: Sequence[str], ts: str, value: str, out: str) -> DataFrame:
    """:func:`cumulative` for true timestamps: day totals are cumulated per key
    (one row per day) and the rows of a day on top, so that a key with many
    bookings a day never forms one window partition over all its rows."""
    keys = list(keys)
    d = df.withColumn("_day", F.to_date(F.col(ts)))
    w_days = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = d.groupBy(*keys, "_day").agg(F.sum(value).alias("_v")).select(
        *(F.col(k).alias("_j_" + k) for k in [*keys, "_day"]), F.coalesce(F.sum("_v").over(w_days), F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col("_j_" + k)) for k in [*keys, "_day"]))
    w_in = Window.partitionBy(*keys, "_day").orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (d.join(days, same).withColumn(out, F.col("_before") + F.sum(value).over(w_in))
            .drop("_day", "_before", *("_j_" + k for k in [*keys, "_day"])))


def burndown(series: DataFrame, keys: Sequence[str], grain: str = "day") -> DataFrame:
    """Cumulative hours per unit: one row per unit and day (``grain="day"``, E3),
    or per unit and booking timestamp (``grain="timestamp"``)."""
    if grain == "timestamp":
        return cumulative_within_days(daily_totals(series, keys), keys, "booking_ts", "hours", "cumulative_hours")
    if grain != "day":
        raise ValueError(f"unknown grain {grain!r}")
    days = series.withColumn("booking_ts", F.date_trunc("day", "booking_ts").cast(series.schema["booking_ts"].dataType))
    return cumulative(daily_totals(days, keys), keys, "booking_ts", "hours", "cumulative_hours")


# D14 / D15 ------------------------------------------------------------------
def week_start(col: str = "booking_ts") -> Column:
    """Monday of the ISO week (Monday-Sunday periods)."""
    return F.date_trunc("week", F.col(col)).cast("date")


def weekly_totals(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hours per unit and week; weeks without bookings do not appear."""
    return (series.filter(F.col("booking_ts").isNotNull())
            .groupBy(*keys, week_start().alias("week_start")).agg(F.sum("hours").alias("hours")))


# E5 -------------------------------------------------------------------------
def weekly_trend(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per unit: number of weeks, mean weekly hours, and the mean of the last
    four *present* weeks (NULL with fewer than four)."""
    weeks = weekly_totals(series, keys)
    w = Window.partitionBy(*keys).orderBy(F.col("week_start").desc())
    ranked = weeks.withColumn("_rn", F.row_number().over(w))
    return (ranked.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_weeks"),
                 F.avg("hours").alias("avg_weekly_hours"),
                 F.avg(F.when(F.col("_rn") <= 4, F.col("hours"))).alias("_avg4"))
            .withColumn("avg_last4_hours", F.when(F.col("n_weeks") >= 4, F.col("_avg4")))
            .drop("_avg4"))


# D20 / D21 ------------------------------------------------------------------
def _rate(hours: Column, first: Column, last: Column) -> Column:
    weeks = F.greatest(H.floor_days_between(first, last) / F.lit(7.0), F.lit(1.0))
    return F.try_divide(hours, weeks)


def booking_rates(series: DataFrame, keys: Sequence[str], as_of: Column) -> DataFrame:
    """Per unit: hours per week over the last 4 weeks (bookings from as_of -
    28 days on; the span of observed dates, at least one week) and over all
    bookings; totals and recent-booking counts."""
    recent = recent_predicate(as_of)
    ts = F.col("booking_ts")
    return (series.groupBy(*keys).agg(
        F.sum("hours").alias("total_booked"),
        F.sum("n").alias("n_bookings"),
        F.coalesce(F.sum(F.when(recent, F.col("n"))), F.lit(0)).alias("n_recent"),
        F.sum(F.when(recent, F.col("hours"))).alias("_h4"),
        F.min(F.when(recent, ts)).alias("_f4"), F.max(F.when(recent, ts)).alias("_l4"),
        F.sum(F.when(ts.isNotNull(), F.col("hours"))).alias("_hall"),
        F.min(ts).alias("first_booking"), F.max(ts).alias("last_booking"))
        .withColumn("rate_4w", F.when(F.col("n_recent") > 0, _rate(F.col("_h4"), F.col("_f4"), F.col("_l4")))
                    .otherwise(F.lit(0.0)))
        .withColumn("rate_total", F.when(F.col("first_booking").isNotNull(),
                                         _rate(F.col("total_booked"), F.col("first_booking"), F.col("last_booking"))))
        .withColumnRenamed("_hall", "dated_hours")
        .drop("_h4", "_f4", "_l4"))


def _add_days(ts: Column, days: Column) -> tuple[Column, Column]:
    """ts + fractional days at microsecond precision; NULL past 9999-12-31
    (returns (timestamp, beyond_horizon))."""
    limit = H.micros_between(ts, F.to_timestamp_ntz(F.lit("9999-12-31 23:59:59.999999"))).cast("double")
    us = days * F.lit(86_400_000_000.0)
    beyond = us > limit
    safe_us = F.when(~beyond, F.round(us)).cast("bigint")
    return F.when(~beyond, F.timestamp_add("MICROSECOND", safe_us, ts)), beyond


# D22 / D23 / D24 / I15 ------------------------------------------------------
def simple_forecast(rates: DataFrame, targets: DataFrame, keys: Sequence[str], as_of: Column,
                    target_col: str = "target_hours") -> DataFrame:
    """Budget end from the 4-week rate (D22), timeline (D23), forecast
    metrics (D24) and burn-down metrics (I15) per unit.

    ``targets`` has the unit keys and ``target_col``; units without target get 0.
    """
    t = targets.select(*keys, F.col(target_col).alias("target_hours"))
    r = rates.join(t, list(keys), "left").withColumn("target_hours", F.coalesce("target_hours", F.lit(0.0)))
    remaining = F.col("target_hours") - F.col("total_booked")
    weeks_left = F.try_divide(remaining, F.col("rate_4w"))
    end_ts, beyond = _add_days(as_of, weeks_left * 7)
    forecast_end = (F.when((F.col("target_hours") <= 0) | (F.col("n_recent") == 0), F.lit(None))
                    .when((F.col("rate_4w") > 0) & (remaining > 0), end_ts)
                    .when(remaining <= 0, as_of))
    out = r.select(
        *keys, "target_hours", "total_booked", "n_bookings", "rate_4w", "rate_total",
        F.coalesce(F.col("dated_hours"), F.lit(0.0)).alias("current_hours"),
        remaining.alias("remaining_hours"),
        F.when(F.col("target_hours") > 0, F.try_divide(remaining, F.col("target_hours")) * 100).alias("remaining_pct"),
        F.when((F.col("rate_4w") > 0) & (remaining > 0), weeks_left).alias("weeks_remaining"),
        F.when((F.col("rate_4w") > 0) & (remaining > 0), F.lit(None))
         .when(remaining <= 0, F.lit(S.RATE_EXHAUSTED)).otherwise(F.lit(S.RATE_NO_ACTIVITY)).alias("rate_status"),
        forecast_end.alias("forecast_end"),
        ((F.col("rate_4w") > 0) & (remaining > 0) & beyond).alias("beyond_horizon"),
        F.coalesce(F.col("first_booking"), as_of).alias("timeline_start"),
        F.coalesce(F.timestamp_add("DAY", F.lit(30), F.col("last_booking")),
                   F.timestamp_add("DAY", F.lit(30), as_of)).alias("timeline_end"))
    return out


def burndown_metrics(series: DataFrame, targets: DataFrame, keys: Sequence[str], as_of: Column) -> DataFrame:
    """Target, current cumulative hours, delta, fulfilment % (NULL
    without target), colour (H11) and the end/status text (H12)."""
    rates = booking_rates(series, keys, as_of)
    fc = simple_forecast(rates, targets, keys, as_of)
    has_end = F.col("forecast_end").isNotNull() & (F.col("target_hours") > F.col("current_hours"))
    days_left = H.floor_days_between(as_of, F.col("forecast_end"))
    return fc.select(
        *keys, "target_hours", "current_hours",
        (F.col("current_hours") - F.col("target_hours")).alias("delta_hours"),
        F.when(F.col("target_hours") > 0, F.col("current_hours") / F.col("target_hours") * 100).alias("fulfillment_pct"),
        H.burndown_color("current_hours", "target_hours").alias("color"),
        F.when(has_end, F.col("forecast_end").cast("date")).alias("end_date"),
        F.when(has_end, days_left).alias("days_left"),
        F.when(has_end, H.fmt_date("forecast_end"))
         .when(F.col("target_hours") <= F.col("current_hours"), F.lit(S.BURNDOWN_EXHAUSTED))
         .otherwise(F.lit(S.BURNDOWN_NO_FORECAST)).alias("end_text"))


# I13 / C7 -------------------------------------------------------------------
def cumulative_with_targets(series: DataFrame, targets: DataFrame) -> DataFrame:
    """Cumulative hours per (project, activity) and day, plus the target
    line (first and last day) where the activity's target is > 0.

    The first and last day of a key come from windows over the curve's own
    partitions, so the curve is made once; its first and last rows also emit
    the target points.
    """
    keys = ["project_nr", "activity"]
    w = Window.partitionBy(*keys)
    curve = burndown(series, keys).withColumn("_a", F.min("booking_ts").over(w)).withColumn("_b", F.max("booking_ts").over(w))
    c = curve.join(targets.select(*keys, F.col("budget_hours").alias("_t")), keys, "left")
    point_type = "array<struct<series:string,x:timestamp_ntz,y:double>>"

    def pt(name, x, y):
        return F.struct(F.lit(name).alias("series"), x.alias("x"), y.cast("double").alias("y"))

    def when_pt(cond, point):
        return F.when(cond, F.array(point)).otherwise(F.array().cast(point_type))
    has_t = F.coalesce(F.col("_t") > 0, F.lit(False))
    ts = F.col("booking_ts")
    pts = F.concat(F.array(pt("cumulative", ts, F.col("cumulative_hours"))),
                   when_pt(has_t & (ts == F.col("_a")), pt("target", F.col("_a"), F.col("_t"))),
                   when_pt(has_t & (ts == F.col("_b")), pt("target", F.col("_b"), F.col("_t"))))
    return c.select(*keys, F.explode(pts).alias("_p")).select(*keys, "_p.series", "_p.x", "_p.y")

"""Sprint-based budget forecasts.

All units are forecast in one job, at both levels (project, and activity
within project). The booking series (daily grain) is dealt out by unit and
reduced once to one row per (activity, sprint number), these few rows to both
levels in a single grouping-sets aggregation -- NULL dates keep their own
group, and all sprints outside the analysis one, so totals stay complete. Velocity, dispersion, trend and totals are then one
more ``groupBy`` with conditional sums over at most a handful of rows per
unit; targets and overrides are joined per unit; the three scenarios are an
``explode`` of each unit row.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm
from typing import Optional

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalar as H
from .latest import latest_by_key
from .trends import _add_days, cumulative

UNIT = ["level", "project_nr", "activity"]


# The fixed weights, newest sprint first, and the smallest whole numbers in
# their ratio: averages with those are the same, and exact for whole hours.
_WEIGHTS = list(reversed(S.SPRINT_WEIGHTS))
_RATIOS = [Fraction(str(w)) for w in _WEIGHTS]
_SCALE = lcm(*(r.denominator for r in _RATIOS))
_UNITS = [int(r * _SCALE) // gcd(*(int(q * _SCALE) for q in _RATIOS)) for r in _RATIOS]


def _weight_units(n: Column) -> Column:
    """Whole-number weight of sprint ``n`` (0 = newest); NULL beyond the list."""
    return F.get(F.array(*map(F.lit, _UNITS)), n)


def sprint_weight(n: Column) -> Column:
    """Weight of sprint ``n`` (0 = newest) from the fixed weight list."""
    return F.coalesce(F.get(F.array(*map(F.lit, _WEIGHTS)), n), F.lit(0.0))


def with_sprint_number(series: DataFrame, as_of: Column) -> DataFrame:
    """sprint_number = floor(floor(days since booking) / 14); NULL for NULL dates."""
    days_ago = H.floor_days_between(F.col("booking_ts"), as_of)
    return series.withColumn(
        "sprint_number", F.floor(days_ago / F.lit(float(S.SPRINT_DURATION_DAYS))).cast("int"))


def _in_analysis(n: Column) -> Column:
    return n.between(0, S.ANALYSIS_SPRINTS - 1)


def _unit_match(left: DataFrame, prefix: str) -> Column:
    """Join condition on the unit keys; activity matches NULL-safely."""
    return ((left["level"] == F.col(prefix + "level")) & (left["project_nr"] == F.col(prefix + "project_nr"))
            & left["activity"].eqNullSafe(F.col(prefix + "activity")))


# D16 (both levels) ----------------------------------------------------------
def two_levels(df: DataFrame, keys: list, aggs: list) -> DataFrame:
    """Aggregate at the activity level (project_nr, activity, *keys) and the
    project level (project_nr, *keys) in one pass with grouping sets: one
    scan and one shuffle, no union of two plans over the same input. Adds
    ``level``; ``activity`` is NULL on project rows."""
    g = df.groupingSets([["project_nr", "activity", *keys], ["project_nr", *keys]],
                        "project_nr", "activity", *keys)
    out = g.agg(*aggs, F.grouping("activity").alias("_g"))
    return out.withColumn("level", F.when(F.col("_g") == 1, F.lit("project")).otherwise(F.lit("activity"))) \
        .drop("_g")


def by_unit(series: DataFrame) -> DataFrame:
    """The series dealt out by project and activity: what is summed up per
    unit and sprint has few groups in a task then, however many bookings it
    reads, and a curve needs no further shuffle."""
    return series.repartition("project_nr", "activity")


def unit_sprints(series: DataFrame, as_of: Column, analysis_only: bool = False) -> DataFrame:
    """Per unit and sprint number (NULL for NULL dates, negative for future
    bookings), both levels: hours, bookings, first/last booking, hours
    after ``as_of``. With ``analysis_only`` the sprints outside the analysis
    are one, number -1, so that a unit has six rows at most. The activities'
    sprints are summed up first, and the projects' from them."""
    s, n = with_sprint_number(by_unit(series), as_of), F.col("sprint_number")
    if analysis_only:
        s = s.withColumn("sprint_number", F.when(n.isNull() | _in_analysis(n), n).otherwise(F.lit(-1)))
    future = F.col("booking_ts") > as_of
    sprints = s.groupBy("project_nr", "activity", "sprint_number").agg(
        F.sum("hours").alias("hours"), F.sum("n").alias("n"),
        F.min("booking_ts").alias("sprint_start"), F.max("booking_ts").alias("sprint_end"),
        F.sum(F.when(future, F.col("hours")).otherwise(F.lit(0.0))).alias("future_hours"))
    return two_levels(sprints, ["sprint_number"], [
        F.sum("hours").alias("hours"), F.sum("n").alias("n"),
        F.min("sprint_start").alias("sprint_start"), F.max("sprint_end").alias("sprint_end"),
        F.sum("future_hours").alias("future_hours")])


def sprint_table(series: DataFrame, as_of: Column) -> DataFrame:
    """Sprint rows per unit: hours, first/last booking in the sprint (T8),
    computed sprint bounds, weight. Only sprints 0..3 count: future bookings
    (sprint < 0) and NULL dates are left out (T6). A sprint's bookings lie
    after ``bound_start`` and up to ``bound_end``."""
    out = unit_sprints(series, as_of).filter(_in_analysis(F.col("sprint_number")))
    n, days = F.col("sprint_number"), S.SPRINT_DURATION_DAYS
    return out.select(
        *UNIT, "sprint_number", "hours", "sprint_start", "sprint_end",
        F.timestamp_add("DAY", -(n + 1) * days, as_of).alias("bound_start"),
        F.timestamp_add("DAY", -n * days, as_of).alias("bound_end"),
        sprint_weight(n).alias("weight"))


def order_sprints(sprints: DataFrame) -> DataFrame:
    """F8: sprint rows per unit, newest sprint first."""
    return sprints.orderBy(*UNIT, "sprint_number")


# D17 / D18 / D19 ------------------------------------------------------------
def _velocity_aggs(keep: Column) -> list[Column]:
    """Velocity, dispersion and slope over the analysis sprints (rows where ``keep``)."""
    n, hours = F.col("sprint_number"), F.col("hours")
    wu = _weight_units(n)

    def kept(expr: Column) -> Column:
        return F.when(keep, expr)
    return [F.count(kept(F.lit(1))).alias("n_sprints"), F.sum(kept(hours * wu)).alias("_hw"), F.sum(kept(wu)).alias("_w"),
            F.stddev_samp(kept(hours)).alias("_std"),
            F.regr_slope(kept(hours), kept(n.cast("double"))).alias("_slope")]


def _velocity_columns(df: DataFrame) -> DataFrame:
    """Weighted velocity (D17), sample std (D18), OLS slope and trends.
    The slope is taken to nine decimals, so that the trend does not hang on
    the last bit of a sum."""
    n = F.col("n_sprints")
    out = (df.withColumn("automatic_hours_per_sprint", F.coalesce(F.col("_hw") / F.col("_w"), F.lit(0.0)))
           .withColumn("sprint_std", F.when(n >= 2, F.col("_std")))
           .withColumn("slope", F.when(n >= 2, F.coalesce(F.round("_slope", 9), F.lit(0.0))).otherwise(F.lit(0.0)))
           .withColumn("trend", _trend(F.col("slope"), n))
           .withColumn("direction", F.signum("slope"))
           .withColumn("slope_chrono", -F.col("slope"))
           .withColumn("trend_chrono", _trend(F.col("slope_chrono"), n)))
    return out.drop("_hw", "_w", "_std", "_slope")


def _trend(slope: Column, n: Column) -> Column:
    th = S.TREND_SLOPE_THRESHOLD
    return (F.when(n < 2, F.lit("insufficient_data")).when(slope > th, F.lit("increasing"))
            .when(slope < -th, F.lit("decreasing")).otherwise(F.lit("stable")))


def velocity_stats(sprints: DataFrame) -> DataFrame:
    """Per unit of a sprint table: weighted velocity, number of sprints,
    sample std, slope over (sprint_number, hours), literal and
    chronological trend (T1)."""
    st = sprints.groupBy(*UNIT).agg(*_velocity_aggs(F.lit(True)))
    return _velocity_columns(st).select(*UNIT, "n_sprints", "automatic_hours_per_sprint", "sprint_std",
                                        "slope", "trend", "direction", "slope_chrono", "trend_chrono")


# C2 / A11 -------------------------------------------------------------------
def latest_overrides(overrides: DataFrame) -> DataFrame:
    """Latest override per (project_nr, activity or NULL) by ``updated_at``;
    a missing ``active`` means active."""
    filled = overrides.withColumn("active", F.coalesce(F.col("active"), F.lit(True)))
    return latest_by_key(filled, ["project_nr", "activity"], "updated_at")


def attach_overrides(units: DataFrame, overrides: Optional[DataFrame]) -> DataFrame:
    """Left join on project and NULL-safe activity (NULL = project level);
    only active overrides set ``manual_hours_per_sprint`` (T17)."""
    if overrides is None:
        return units.withColumn("manual_hours_per_sprint", F.lit(None).cast("double"))
    o = latest_overrides(overrides).select(
        F.col("project_nr").alias("_p"), F.col("activity").alias("_a"),
        F.when(F.col("active"), F.col("hours_per_sprint")).alias("manual_hours_per_sprint"))
    cond = (F.col("project_nr") == F.col("_p")) & F.col("activity").eqNullSafe(F.col("_a"))
    return units.join(o, cond, "left").drop("_p", "_a")


# I2-I7, I14 -----------------------------------------------------------------
def unit_targets(targets: DataFrame) -> DataFrame:
    """Targets for both levels: the activity budget, and the project's sum
    (all budgets of the project), in one grouping-sets pass."""
    return two_levels(targets, [], [H.exact_sum("budget_hours").alias("target_hours")])


def forecast_units(series: DataFrame, targets: DataFrame, as_of: Column,
                   overrides: Optional[DataFrame] = None) -> DataFrame:
    """One row per unit with bookings (both levels): totals (all hours incl.
    NULL dates and future bookings), hours after ``as_of``, automatic and
    base velocity (I2), confidence factor (D18), remaining hours (I3),
    trend (D19), and the span and current total of the dated bookings."""
    us = unit_sprints(series, as_of, analysis_only=True)
    n = F.col("sprint_number")
    dated = n.isNotNull()
    agg = us.groupBy(*UNIT).agg(
        F.sum("hours").alias("total_booked"), F.sum("n").alias("n_bookings"),
        F.sum("future_hours").alias("future_hours"),
        F.coalesce(F.sum(F.when(dated, F.col("hours"))), F.lit(0.0)).alias("dated_hours"),
        F.min("sprint_start").alias("first_booking"), F.max("sprint_end").alias("last_booking"),
        *_velocity_aggs(_in_analysis(n)))
    u = _velocity_columns(agg)
    tg = unit_targets(targets).select(*[F.col(c).alias("_t_" + c) for c in UNIT], "target_hours")
    u = (u.join(tg, _unit_match(u, "_t_"), "left").drop(*["_t_" + c for c in UNIT])
         .withColumn("target_hours", F.coalesce(F.col("target_hours"), F.lit(0.0))))
    u = attach_overrides(u, overrides)
    auto = F.col("automatic_hours_per_sprint")
    base = F.coalesce(F.col("manual_hours_per_sprint"), auto)
    cf = (F.when(F.col("n_sprints") >= 2, F.when(base > 0, F.col("sprint_std") / base)
                 .otherwise(F.lit(S.DEFAULT_CONFIDENCE_FACTOR)))
          .otherwise(F.lit(S.DEFAULT_CONFIDENCE_FACTOR)))
    return u.select(
        *UNIT, "target_hours", "total_booked", "future_hours", "n_bookings",
        "n_sprints", "automatic_hours_per_sprint", "manual_hours_per_sprint",
        base.alias("base_hours_per_sprint"), cf.alias("confidence_factor"),
        F.greatest(F.lit(0.0), F.col("target_hours") - F.col("total_booked")).alias("remaining_hours"),
        "slope", "trend", "direction", "slope_chrono", "trend_chrono",
        "first_booking", "last_booking", "dated_hours")


def scenarios(units: DataFrame, as_of: Column, only_forecastable: bool = True) -> DataFrame:
    """Three scenario rows per unit with velocity, sprints left, end date
    (I4, I5) and card metrics (I7). Units without target or bookings are
    left out when ``only_forecastable`` (the cards are not shown for them).
    Velocity <= 0 gives infinite sprints and no end; an end past
    9999-12-31 is NULL with ``beyond_horizon`` (T11)."""
    u = units.filter((F.col("target_hours") > 0) & (F.col("n_bookings") > 0)) if only_forecastable else units
    base, cf = F.col("base_hours_per_sprint"), F.col("confidence_factor")
    sig = F.lit(S.SCENARIO_SIGMA)
    velocity = {
        "optimistic": base * (1 + cf * sig),
        "realistic": base,
        "pessimistic": F.greatest(base * (1 - cf * sig), F.lit(S.MIN_PESSIMISTIC_VELOCITY)),
    }
    options = F.array(*[F.struct(F.lit(key).alias("scenario"), F.lit(label).alias("label"),
                                 velocity[key].alias("hours_per_sprint"))
                        for key, label in S.SCENARIOS])
    stacked = u.select("*", F.explode(options).alias("_s")).select(*u.columns, "_s.*")
    v = F.col("hours_per_sprint")
    sprints_left = F.when(v > 0, F.col("remaining_hours") / v).otherwise(F.lit(float("inf")))
    days = sprints_left * F.lit(float(S.SPRINT_DURATION_DAYS))
    end_ts, beyond = _add_days(as_of, days)
    has_v = v > 0
    end = F.when(has_v, end_ts)
    return stacked.select(
        "*", sprints_left.alias("sprints_remaining"),
        F.when(has_v, days).alias("days_remaining"),
        end.alias("end_ts"), end.cast("date").alias("end_date"),
        (has_v & beyond).alias("beyond_horizon"),
        F.when(end.isNotNull(), H.floor_days_between(as_of, end)).alias("days_left"),
        F.when(F.col("target_hours") > 0, F.col("total_booked") / F.col("target_hours") * 100)
         .otherwise(F.lit(0.0)).alias("utilisation_pct"),
        H.clamp((1 - cf) * 100, 0.0, 100.0).alias("certainty_pct"))


# I8 -------------------------------------------------------------------------
def trend_alert(units: DataFrame) -> DataFrame:
    """Alert text per unit by the (literal) trend, for the units the cards are
    shown for: those with a target and bookings."""
    shown = units.filter((F.col("target_hours") > 0) & (F.col("n_bookings") > 0))
    slope_txt = F.format_string("%.1f", F.col("slope"))
    trend = F.col("trend")

    def text(parts):
        return F.concat(F.lit(parts[0]), slope_txt, F.lit(parts[1]))
    return shown.select(*UNIT, "trend", "slope",
                        F.when(trend == "decreasing", F.lit("warning")).when(trend == "increasing", F.lit("info")).alias("alert_level"),
                        F.when(trend == "decreasing", text(S.ALERT_DECREASING))
                        .when(trend == "increasing", text(S.ALERT_INCREASING)).alias("alert_text"))


# I9 / I12 -------------------------------------------------------------------
def sprint_details(sprints: DataFrame) -> DataFrame:
    """Sprint table for display."""
    n = F.col("sprint_number")
    return sprints.select(
        *UNIT, "sprint_number", "hours", "weight",
        H.sprint_label(n).alias("sprint_label"), H.sprint_label(n, chart=True).alias("chart_label"),
        H.hours_text("hours").alias("hours_text"),
        H.fmt_date("sprint_start").alias("start_text"), H.fmt_date("sprint_end").alias("end_text"),
        H.pct_text(F.col("weight")).alias("weight_text"))


def velocity_series(sprints: DataFrame) -> DataFrame:
    """I12, long form: a bar per sprint (``hours``) and, at each of them, the
    unit's weighted mean line (``weighted_mean``). The window holds a unit's
    sprints, four at most."""
    w, wu = Window.partitionBy(*UNIT), _weight_units(F.col("sprint_number"))
    mean = F.sum(F.col("hours") * wu).over(w) / F.sum(wu).over(w)
    points = F.array(*(F.struct(F.lit(name).alias("series"), y.alias("y"))
                       for name, y in (("hours", F.col("hours")), ("weighted_mean", F.col("_mean")))))
    return (sprints.withColumn("_mean", mean)
            .select(*UNIT, "sprint_number", H.sprint_label(F.col("sprint_number"), chart=True).alias("chart_label"),
                    F.explode(points).alias("_p"))
            .select(*UNIT, "sprint_number", "chart_label", "_p.series", "_p.y"))


# I10 / I11 ------------------------------------------------------------------
def _actual_curve(series: DataFrame) -> DataFrame:
    """Cumulative hours per unit (both levels) and point of time. It reads the
    same columns of the series as :func:`forecast_units`, so that a plan with
    both makes and deals out the series once; undated bookings are in no
    point. An activity's curve is a running total over its own rows, where
    rows of one time count together; only a project's are summed up first."""
    dated = F.col("booking_ts").isNotNull()
    units = by_unit(series).withColumn("_h", F.when(dated, F.col("hours")).otherwise(F.lit(0.0)))
    w = Window.partitionBy("project_nr", "activity").orderBy("booking_ts")
    activities = (units.withColumn("y", F.sum("_h").over(w))  # up to and with all rows of the time
                  .withColumn("n", F.sum("n").over(w.rangeBetween(Window.currentRow, Window.currentRow)))
                  .withColumn("_next", F.lead("booking_ts").over(w))
                  .filter(~F.col("booking_ts").eqNullSafe(F.col("_next"))))
    days = units.groupBy("project_nr", "booking_ts").agg(F.sum("_h").alias("_h"), F.sum("n").alias("n"))
    projects = cumulative(days, ["project_nr"], "booking_ts", "_h", "y").withColumn("activity", F.lit(None).cast("string"))

    def points(curve: DataFrame, level: str) -> DataFrame:
        return curve.filter(dated & (F.col("n") > 0)).select(
            F.lit(level).alias("level"), "project_nr", "activity", F.lit("actual").alias("series"), F.col("booking_ts").alias("x"), "y")
    return points(activities, "activity").unionByName(points(projects, "project"))


def _point(series_name: Column, x: Column, y: Column) -> Column:
    return F.struct(series_name.alias("series"), x.alias("x"), y.alias("y"))


def _points(frame: DataFrame, arrays: Column) -> DataFrame:
    return frame.select(*UNIT, F.explode(arrays).alias("_p")).select(*UNIT, "_p.series", "_p.x", "_p.y")


_NO_POINTS = "array<struct<series:string,x:timestamp_ntz,y:double>>"


def scenario_series(series: DataFrame, scen: DataFrame, as_of: Column) -> DataFrame:
    """Long (unit, series, x, y) table for the scenario chart: cumulative
    actual curve per unit, target line from the first booking to the latest
    scenario end, per scenario a line (as_of, current) -> (end, target) and
    its end marker. ``only_future`` marks points after as_of."""
    # per unit: three scenario rows; the latest end is a window over them
    sc = scen.filter(F.col("first_booking").isNotNull()) \
        .withColumn("_maxend", F.max("end_ts").over(Window.partitionBy(*UNIT)))
    t, none = F.col("target_hours"), F.array().cast(_NO_POINTS)
    target_pts = F.when(F.col("scenario") == S.SCENARIOS[0][0], F.array(
        _point(F.lit("target"), F.col("first_booking"), t),
        _point(F.lit("target"), F.coalesce(F.col("_maxend"), F.col("last_booking")), t))).otherwise(none)
    scen_pts = F.when(F.col("end_ts").isNotNull(), F.array(
        _point(F.col("scenario"), as_of, F.col("dated_hours")),
        _point(F.col("scenario"), F.col("end_ts"), t),
        _point(F.concat(F.col("scenario"), F.lit(" Ende")), F.col("end_ts"), t))).otherwise(none)
    out = _actual_curve(series).unionByName(_points(sc, F.concat(target_pts, scen_pts)))
    return out.withColumn("only_future", F.col("x") > as_of)


def burndown_series(series: DataFrame, scen: DataFrame, simple: DataFrame, as_of: Column) -> DataFrame:
    """Project-level burn-down chart as (project_nr, series, x, y).

    Actual curve; for every scenario that ends after ``as_of`` a line (as_of,
    current) -> (end, target), with an end marker for the realistic one; and
    for projects none of whose scenarios does, the line of the simple
    four-week forecast (D22, ``simple``) if that has an end and the target
    is not reached yet.
    """
    project = F.col("level") == "project"
    t, none = F.col("target_hours"), F.array().cast(_NO_POINTS)
    ahead = scen.filter(project & (F.col("end_ts") > as_of) & F.col("first_booking").isNotNull())
    line = F.array(_point(F.col("scenario"), as_of, F.col("dated_hours")), _point(F.col("scenario"), F.col("end_ts"), t))
    mark = F.when(F.col("scenario") == S.SCENARIOS[1][0], F.array(_point(F.lit(S.BURNDOWN_END_MARKER), F.col("end_ts"), t))).otherwise(none)
    lines = _points(ahead, F.concat(line, mark))
    rest = simple.join(ahead.select("project_nr").distinct(), "project_nr", "left_anti") \
        .filter(F.col("forecast_end").isNotNull() & (F.col("target_hours") > F.col("current_hours")))
    trend = F.lit(S.BURNDOWN_TREND_LINE)
    fallback = rest.select("project_nr", F.explode(F.array(_point(trend, as_of, F.col("current_hours")),
                                                           _point(trend, F.col("forecast_end"), t))).alias("_p")) \
        .select("project_nr", "_p.series", "_p.x", "_p.y")
    cols = ["project_nr", "series", "x", "y"]
    return (_actual_curve(series).filter(project).select(*cols).unionByName(lines.select(*cols))
            .unionByName(fallback.select(*cols)))

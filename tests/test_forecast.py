"""Sprint forecast and trend operators, incl. the T-rows of the survey."""

import datetime as dt

import pytest
from conftest import make_bookings

from pyspark.sql import functions as F

from burnline.operators import forecast as FC
from burnline.operators import trends as TR
from burnline.sources.tables import ts_ntz

AS_OF = dt.datetime(2025, 9, 30)


def _series(spark, rows):
    """rows: (days_before_as_of or None, hours[, activity])"""
    out = []
    for r in rows:
        days, hours = r[0], r[1]
        act = r[2] if len(r) > 2 else "A"
        when = None if days is None else AS_OF - dt.timedelta(days=days)
        out.append({"project_nr": "P", "activity": act, "booking_ts": when, "hours_billed": hours})
    return TR.booking_series(make_bookings(spark, out))


def _targets(spark, rows):
    return spark.createDataFrame(rows, "project_nr string, activity string, budget_hours double")


def _unit(spark, series, target=200.0, overrides=None, level="project"):
    u = FC.forecast_units(series, _targets(spark, [("P", "A", target)]), ts_ntz(AS_OF), overrides)
    return u.filter(F.col("level") == level).first()


def _scen(spark, series, target=200.0, overrides=None):
    u = FC.forecast_units(series, _targets(spark, [("P", "A", target)]), ts_ntz(AS_OF), overrides)
    return {r.scenario: r for r in FC.scenarios(u.filter("level = 'project'"), ts_ntz(AS_OF)).collect()}


@pytest.mark.parametrize("hours,expect", [((85.3, 72.1, 68.5, 75.2), 76.97), ((82.3, 75.1, 88.7, 71.2), 80.31)])
def test_weighted_velocity_goldens(spark, hours, expect):
    s = _series(spark, [(1 + 14 * i, h) for i, h in enumerate(hours)])  # newest first
    assert round(_unit(spark, s).automatic_hours_per_sprint, 2) == expect


def test_realistic_scenario_golden(spark):
    # 120 booked, 40 h in each of sprints 0..2 -> base 40, remaining 80 -> 2 sprints, 28 days
    s = _series(spark, [(1, 40.0), (15, 40.0), (29, 40.0)])
    sc = _scen(spark, s)
    r = sc["realistic"]
    assert r.hours_per_sprint == 40.0 and r.sprints_remaining == 2.0
    assert r.days_left == 28 and r.end_date == dt.date(2025, 10, 28)
    assert sc["optimistic"].end_date <= r.end_date <= sc["pessimistic"].end_date


def test_future_and_null_dates(spark):
    s = _series(spark, [(1, 10.0), (-3, 5.0), (None, 7.0)])  # future booking, NULL date
    u = _unit(spark, s)
    assert u.n_sprints == 1 and u.automatic_hours_per_sprint == 10.0
    assert u.total_booked == 22.0 and u.future_hours == 5.0
    st = FC.sprint_table(s, ts_ntz(AS_OF)).filter("level = 'project'").collect()
    assert [r.sprint_number for r in st] == [0]


def test_sprint_gap_renormalises(spark):
    s = _series(spark, [(1, 10.0), (30, 20.0)])  # sprints 0 and 2 only
    assert _unit(spark, s).automatic_hours_per_sprint == pytest.approx((10 * 0.4 + 20 * 0.2) / 0.6)


def test_single_sprint_defaults(spark):
    u = _unit(spark, _series(spark, [(2, 10.0), (3, 5.0)]))
    assert u.n_sprints == 1 and u.confidence_factor == 0.2 and u.trend == "insufficient_data" and u.slope == 0.0


def test_dispersion_and_trend_sign(spark):
    # hours fall with time: oldest sprint 40, newest 10
    s = _series(spark, [(1, 10.0), (15, 20.0), (29, 30.0), (43, 40.0)])
    u = _unit(spark, s)
    assert u.slope == 10.0 and u.trend == "increasing"  # literal (sprint 0 = newest)
    assert u.trend_chrono == "decreasing"
    import statistics
    assert u.confidence_factor == pytest.approx(statistics.stdev([10, 20, 30, 40]) / u.automatic_hours_per_sprint)


def test_overrides(spark):
    s = _series(spark, [(1, 10.0), (15, 20.0)])
    o = spark.createDataFrame([("P", None, 0.0, "r", "2025-09-01T00:00:00", "u", True),
                               ("P", "A", 99.0, "r", "2025-09-01T00:00:00", "u", False)],
                              "project_nr string, activity string, hours_per_sprint double, reason string, "
                              "updated_at string, updated_by string, active boolean")
    sc = _scen(spark, s, overrides=o)
    assert sc["realistic"].base_hours_per_sprint == 0.0 and sc["realistic"].end_date is None
    assert sc["realistic"].sprints_remaining == float("inf")
    assert sc["pessimistic"].hours_per_sprint == 0.1
    act = _unit(spark, s, overrides=o, level="activity")
    assert act.manual_hours_per_sprint is None  # inactive override ignored
    missing_flag = o.withColumn("active", F.lit(None).cast("boolean")).filter("activity = 'A'")
    assert _unit(spark, s, overrides=missing_flag, level="activity").base_hours_per_sprint == 99.0


def test_time_horizon(spark):
    s = _series(spark, [(1, 0.01), (15, 0.01)])
    far = _scen(spark, s, target=200000.0)["pessimistic"]  # 0.1 h per sprint
    assert far.end_date is None and far.beyond_horizon
    near = _scen(spark, s, target=1000.0)["pessimistic"]
    assert not near.beyond_horizon and 2400 < near.end_date.year < 2420


def test_weekly_trend_and_weeks(spark):
    rows = [{"project_nr": "P", "activity": "A", "hours_billed": 1.0, "booking_ts": dt.datetime(2024, 1, 7)},
            {"project_nr": "P", "activity": "A", "hours_billed": 2.0, "booking_ts": dt.datetime(2024, 1, 8)}]
    s = TR.booking_series(make_bookings(spark, rows))
    weeks = sorted((r.week_start, r.hours) for r in TR.weekly_totals(s, ["project_nr"]).collect())
    assert weeks == [(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 8), 2.0)]  # Sunday and Monday differ
    t = TR.weekly_trend(s, ["project_nr"]).first()
    assert t.n_weeks == 2 and t.avg_last4_hours is None and t.avg_weekly_hours == 1.5


def test_burndown_and_rates(spark):
    s = _series(spark, [(1, 10.0), (8, 20.0), (50, 30.0), (None, 4.0)])
    b = TR.burndown(s, ["project_nr"]).orderBy("booking_ts").collect()
    assert [r.cumulative_hours for r in b] == [30.0, 50.0, 60.0]  # NULL dates dropped from the curve
    r = TR.booking_rates(s, ["project_nr"], ts_ntz(AS_OF)).first()
    assert r.total_booked == 64.0 and r.n_recent == 2 and r.rate_4w == 30.0  # span 7 days -> one week
    m = TR.burndown_metrics(s, _targets(spark, [("P", None, 100.0)]).select("project_nr", F.col("budget_hours").alias("target_hours")),
                            ["project_nr"], ts_ntz(AS_OF)).first()
    assert m.current_hours == 60.0 and m.color == "green" and m.days_left == 8  # (100-64)/30 weeks


def test_scenario_series_shapes(spark):
    s = _series(spark, [(1, 40.0), (15, 40.0), (29, 40.0)])
    u = FC.forecast_units(s, _targets(spark, [("P", "A", 200.0)]), ts_ntz(AS_OF))
    sc = FC.scenarios(u, ts_ntz(AS_OF))
    pts = FC.scenario_series(s, sc, ts_ntz(AS_OF)).filter("level = 'project'").collect()
    kinds = sorted({p.series for p in pts})
    assert kinds == ["actual", "optimistic", "optimistic Ende", "pessimistic", "pessimistic Ende",
                     "realistic", "realistic Ende", "target"]
    assert max(p.y for p in pts if p.series == "actual") == 120.0


def test_burndown_with_time_parts_matches_sequential(spark):
    """Timestamps with time parts (several per second and per day) on one hot
    key: the two-level running total equals a sequential cumulative sum."""
    base = dt.datetime(2024, 1, 1)
    stamps = [base + dt.timedelta(days=i % 5, seconds=(i * 7) % 3, microseconds=i) for i in range(1, 800)]
    rows = [{"project_nr": "P", "activity": "A", "booking_ts": t, "hours_billed": float(i % 9)}
            for i, t in enumerate(stamps, 1)]
    s = TR.booking_series(make_bookings(spark, rows))
    got = {r.booking_ts: r.cumulative_hours for r in TR.burndown(s, ["project_nr"], grain="timestamp").collect()}
    acc = 0.0
    for t, r in sorted(zip(stamps, rows)):
        acc += r["hours_billed"]
        assert got[t] == acc


def test_burndown_day_grain_sums_a_day(spark):
    rows = [{"project_nr": "P", "activity": "A", "hours_billed": 1.0, "booking_ts": dt.datetime(2024, 1, d, h)}
            for d, h in ((1, 8), (1, 17), (3, 9))] + [{"project_nr": "P", "activity": "A", "hours_billed": 9.0, "booking_ts": None}]
    got = TR.burndown(TR.booking_series(make_bookings(spark, rows)), ["project_nr"]).orderBy("booking_ts").collect()
    assert [(r.booking_ts, r.cumulative_hours) for r in got] == [(dt.datetime(2024, 1, 1), 2.0), (dt.datetime(2024, 1, 3), 3.0)]


def test_sprint_bounds_hold_their_bookings(spark):
    as_of = dt.datetime(2025, 6, 30)
    rows = [{"project_nr": "P", "activity": "A", "hours_billed": 1.0, "booking_ts": t}
            for t in (dt.datetime(2025, 6, 16, 12), dt.datetime(2025, 6, 16), dt.datetime(2025, 6, 30))]
    st = FC.sprint_table(TR.booking_series(make_bookings(spark, rows)), ts_ntz(as_of)).filter("level = 'project'").collect()
    assert {r.sprint_number: r.hours for r in st} == {0: 2.0, 1: 1.0}
    assert all(r.bound_start < r.sprint_start and r.sprint_end <= r.bound_end for r in st)


def test_dispersion_of_large_hours(spark):
    hours = [1e8, 1e8 + 1.0, 1e8 + 3.0, 1e8 + 2.0]
    u = _unit(spark, _series(spark, [(1 + 14 * i, h) for i, h in enumerate(hours)]))
    import statistics
    assert u.confidence_factor * u.base_hours_per_sprint == pytest.approx(statistics.stdev(hours), rel=1e-6)


def test_weights_come_from_one_list():
    from burnline import schemas as S
    assert [u / sum(FC._UNITS) for u in FC._UNITS] == pytest.approx(list(reversed(S.SPRINT_WEIGHTS)))


def test_alerts_only_for_units_with_target(spark):
    s = _series(spark, [(1, 10.0), (15, 20.0), (29, 30.0), (43, 40.0)])
    with_target = FC.forecast_units(s, _targets(spark, [("P", "A", 50.0)]), ts_ntz(AS_OF))
    without = FC.forecast_units(s, _targets(spark, [("Q", "A", 50.0)]), ts_ntz(AS_OF))
    assert {r.alert_level for r in FC.trend_alert(with_target).collect()} == {"info"}
    assert FC.trend_alert(without).count() == 0


def test_velocity_series_and_mean_line(spark):
    s = _series(spark, [(1, 10.0), (15, 20.0)])
    got = FC.velocity_series(FC.sprint_table(s, ts_ntz(AS_OF))).filter("level = 'project'").collect()
    assert sorted((r.series, r.sprint_number, round(r.y, 6)) for r in got) == [
        ("hours", 0, 10.0), ("hours", 1, 20.0), ("weighted_mean", 0, 14.285714), ("weighted_mean", 1, 14.285714)]


def test_burndown_series_falls_back_to_the_simple_forecast(spark):
    # P: an ordinary project; Q: a manual velocity of 0 and pessimistic ends beyond the horizon, so no scenario lies ahead
    rows = [{"project_nr": p, "activity": "A", "hours_billed": 10.0, "booking_ts": AS_OF - dt.timedelta(days=d)} for p in "PQ" for d in (2, 9, 20)]
    s = TR.booking_series(make_bookings(spark, rows))
    targets = _targets(spark, [("P", "A", 100.0), ("Q", "A", 1e9)])
    manual = spark.createDataFrame([("Q", None, 0.0, "r", None, "u", True)],
                                   "project_nr string, activity string, hours_per_sprint double, reason string, updated_at string, "
                                   "updated_by string, active boolean")
    scen = FC.scenarios(FC.forecast_units(s, targets, ts_ntz(AS_OF), manual), ts_ntz(AS_OF))
    tg = FC.unit_targets(targets).filter("level = 'project'").select("project_nr", "target_hours")
    small = tg.withColumn("target_hours", F.least("target_hours", F.lit(5000.0)))
    simple = TR.simple_forecast(TR.booking_rates(s, ["project_nr"], ts_ntz(AS_OF)), small, ["project_nr"], ts_ntz(AS_OF))
    pts = FC.burndown_series(s, scen, simple, ts_ntz(AS_OF)).collect()
    kinds = {p: {r.series for r in pts if r.project_nr == p} for p in "PQ"}
    assert kinds["P"] == {"actual", "optimistic", "realistic", "pessimistic", "Budget-Ende (realistisch)"}
    assert kinds["Q"] == {"actual", "Prognose (4-Wochen-Trend)"}


def test_override_without_time_keeps_its_values(spark):
    from burnline import schemas as S
    rows = [("P", None, 5.0, "r", None, "u", None), ("Q", "A", 1.0, "r", None, "u", True), ("Q", "A", 2.0, "r", "2024-01-01", "u", True)]
    got = {r.project_nr: r.hours_per_sprint for r in FC.latest_overrides(spark.createDataFrame(rows, S.OVERRIDE_SCHEMA)).collect()}
    assert got == {"P": 5.0, "Q": 2.0}


def test_sprints_and_series_in_order(spark):
    s = _series(spark, [(30, 1.0), (1, 2.0), (15, 3.0)])
    assert [r.sprint_number for r in FC.order_sprints(FC.sprint_table(s, ts_ntz(AS_OF)).filter("level = 'project'")).collect()] == [0, 1, 2]
    stamps = [r.booking_ts for r in TR.order_series(s).collect()]
    assert stamps == sorted(stamps)


def test_units_are_made_from_few_rows(spark, monkeypatch):
    """What goes to both levels does not grow with the bookings: a row per analysis sprint, one for all other dates, one without."""
    s = _series(spark, [(d, 1.0) for d in range(-30, 700)] + [(None, 7.0), (3, 2.0, "B")])
    summed, two_levels = [], FC.two_levels
    monkeypatch.setattr(FC, "two_levels", lambda df, keys, aggs: summed.append((keys, df)) or two_levels(df, keys, aggs))
    u = FC.forecast_units(s, _targets(spark, [("P", "A", 900.0)]), ts_ntz(AS_OF))
    assert [df.count() for keys, df in summed if keys] == [6 + 1]
    got = {(r.level, r.activity): r for r in u.collect()}
    assert len(got) == 3 and got["project", None].total_booked == 739.0 and got["project", None].dated_hours == 732.0
    a = got["activity", "A"]
    assert (a.total_booked, a.future_hours, a.n_bookings, a.n_sprints, a.automatic_hours_per_sprint) == (737.0, 30.0, 731, 4, 14.0)
    assert a.first_booking == AS_OF - dt.timedelta(days=699) and a.last_booking == AS_OF + dt.timedelta(days=30)


def test_curve_of_activities_is_not_shuffled_again(spark):
    rows = [{"project_nr": p, "activity": a, "hours_billed": h, "booking_ts": t} for p in "PQ" for a, h, t in (
        ("A", 1.0, dt.datetime(2025, 1, 1)), ("A", 2.0, dt.datetime(2025, 1, 3)), ("B", 4.0, dt.datetime(2025, 1, 3)),
        (None, 8.0, dt.datetime(2025, 1, 2)), ("A", 16.0, None), ("C", 32.0, None))]
    series = TR.booking_series(make_bookings(spark, rows))
    curve = FC._actual_curve(series)
    one, two, three = (dt.datetime(2025, 1, d) for d in (1, 2, 3))
    want = {("activity", "A", one, 1.0), ("activity", "A", three, 3.0), ("activity", "B", three, 4.0), ("activity", None, two, 8.0),
            ("project", None, one, 1.0), ("project", None, two, 9.0), ("project", None, three, 15.0)}
    got = [(r.project_nr, (r.level, r.activity, r.x, r.y)) for r in curve.collect()]
    assert len(got) == 14 and set(got) == {(p, w) for p in "PQ" for w in want}
    # rows that share a time, as series that were put together have them
    twice = FC._actual_curve(series.unionByName(series)).collect()
    assert {(r.project_nr, (r.level, r.activity, r.x, r.y / 2)) for r in twice} == set(got) and len(twice) == 14
    plan = curve._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan  # no row of the series is doubled for the two levels
    assert "hashpartitioning(level" not in plan  # and none dealt out a second time

"""Invariants of SURVEY §5.4 on the derived sf0.001 data, and a property test
of the status rule."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from burnline import schemas as S
from burnline.functions import scalar as H
from burnline.operators import dashboard as D
from burnline.operators import forecast as FC
from burnline.operators import ledger as L
from burnline.operators import trends as TR
from burnline.sources import derived
from burnline.sources.tables import DEFAULT_AS_OF, ts_ntz

SMOKE = "/root/testdata/sf0.001"
AS_OF_DATE = dt.date(2001, 6, 30)


@pytest.fixture(scope="module")
def data(spark):
    bookings = derived.bookings(spark, SMOKE).cache()
    led = derived.ledger(spark, SMOKE).cache()
    return bookings, led


def test_activity_sums_equal_project_sums(spark, data):
    bookings, led = data
    agg = D.aggregate_bookings(bookings)
    targets = L.budgets_at(led, AS_OF_DATE)
    dash = D.activity_dashboard(agg, targets)
    summ = D.project_summary(agg, targets)
    a = {r.project_nr: r.s for r in dash.groupBy("project_nr").agg(F.sum("actual_hours").alias("s")).collect()}
    assert a == {r.project_nr: r.actual_hours for r in summ.collect()}
    assert dash.count() == agg.select("project_nr", "activity").distinct().count()  # left join keeps rows


def test_shares(spark, data):
    _, led = data
    ov = L.budget_overview(led, AS_OF_DATE)
    for r in ov.groupBy("project_nr").agg(F.sum("share_pct").alias("s")).collect():
        assert r.s == pytest.approx(100.0) or r.s == 0.0


def test_cumulative_last_is_total(spark, data):
    bookings, _ = data
    s = TR.booking_series(derived.booking_events(spark, SMOKE))
    last = {r.project_nr: r.cumulative_hours for r in
            TR.burndown(s, ["project_nr"]).groupBy("project_nr")
            .agg(F.max_by("cumulative_hours", "booking_ts").alias("cumulative_hours")).collect()}
    total = {r.project_nr: r.h for r in bookings.filter(F.col("booking_ts").isNotNull())
             .groupBy("project_nr").agg(F.sum("hours_billed").alias("h")).collect()}
    assert last == total


def test_scenario_order(spark, data):
    _, led = data
    s = TR.booking_series(derived.booking_events(spark, SMOKE))
    sc = FC.scenarios(FC.forecast_units(s, L.budgets_at(led, AS_OF_DATE), ts_ntz(DEFAULT_AS_OF)),
                      ts_ntz(DEFAULT_AS_OF))
    wide = (sc.groupBy("level", "project_nr", "activity")
            .pivot("scenario", ["optimistic", "realistic", "pessimistic"]).agg(F.first("days_remaining"))
            .join(sc.filter("scenario = 'realistic'").select("level", "project_nr", "activity", "hours_per_sprint"),
                  ["level", "project_nr", "activity"]))
    rows = wide.filter(F.col("hours_per_sprint") >= 0.1).collect()
    assert rows
    for r in rows:
        assert r.optimistic <= r.realistic + 1e-9 and r.realistic <= r.pessimistic + 1e-9


def test_point_and_batch_balances_agree(spark, data):
    _, led = data
    probes = led.select("project_nr", "activity").distinct().withColumn("as_of_date", F.lit(AS_OF_DATE))
    batch = {(r.project_nr, r.activity): r.budget_hours for r in L.balances_at_dates(led, probes).collect()}
    point = {(r.project_nr, r.activity): r.budget_hours for r in L.budgets_at(led, AS_OF_DATE).collect()}
    assert set(point) <= set(batch)
    assert batch == {k: point.get(k, 0.0) for k in batch}  # a key without a valid entry has a row with 0


def _status(actual: float, target: float) -> str:
    """The threshold rule in plain Python, in the same order of operations."""
    if target == 0:
        return S.STATUS_NO_TARGET
    pct = (actual / target) * 100
    if pct <= 100:
        return S.STATUS_OK
    if pct <= 110:
        return S.STATUS_CRITICAL
    return S.STATUS_OVER


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50000).map(lambda x: x / 100),
                          st.integers(0, 50000).map(lambda x: x / 100)), min_size=1, max_size=40))
def test_status_matches_rule(spark, pairs):
    df = spark.createDataFrame(pairs, "a double, t double")
    got = [r[0] for r in df.select(H.fulfillment_status("a", "t")).collect()]
    assert got == [_status(a, t) for a, t in pairs]


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_curve_plans_shuffle_little(spark):
    from burnline.plans.catalog import QUERIES
    smoke = "/root/testdata/sf0.001"
    joins = _plan(QUERIES["d13_daily_totals"](spark, smoke)).count("Exchange hashpartitioning")
    for name, more in (("e2_burndown", 1), ("e3_activity_cumulative", 1), ("i13_cumulative_with_targets", 4)):
        assert _plan(QUERIES[name](spark, smoke)).count("Exchange hashpartitioning") <= joins + more, name


def test_no_query_deals_rows_round_robin(spark):
    from burnline.plans.catalog import QUERIES
    for name in ("d1_booking_aggregate", "e2_burndown", "i10_scenario_series", "c6_monthly_balances"):
        assert "RoundRobin" not in _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_running_balance_derives_the_ledger_once(spark):
    from burnline.plans.catalog import QUERIES
    plan = _plan(QUERIES["e8_running_balance"](spark, "/root/testdata/sf0.001"))
    assert "FileScan" not in plan and "ExistingRDD" in plan

"""Dashboard operators (D1-D7, E1, E6, E7) on hand frames, incl. golden rows."""

import datetime as dt

from conftest import make_bookings, make_ledger

from burnline import schemas as S
from burnline.operators import dashboard as D
from burnline.operators import filters as B
from burnline.operators import ledger as L

AS_OF = dt.date(2024, 6, 30)


def _rows(df, key):
    return {r[key]: r for r in df.collect()}


def _targets(spark, rows):
    return L.budgets_at(make_ledger(spark, rows), AS_OF)


def test_golden_project_status(spark):
    bookings = make_bookings(spark, [
        {"project_nr": "A", "project": "Alpha", "activity": "Impl", "hours_billed": 87.5, "customer": "C1", "employee": "e"},
        {"project_nr": "B", "project": "Beta", "activity": "Impl", "hours_billed": 95.0, "customer": "C2", "employee": "e"},
    ])
    targets = _targets(spark, [{"project_nr": "A", "activity": "Impl", "hours": 120, "valid_from": dt.date(2024, 1, 1)},
                               {"project_nr": "B", "activity": "Impl", "hours": 80, "valid_from": dt.date(2024, 1, 1)}])
    s = _rows(D.project_summary(D.aggregate_bookings(bookings), targets), "project_nr")
    assert round(s["A"].fulfillment_pct, 1) == 72.9 and s["A"].status == S.STATUS_OK
    assert s["B"].fulfillment_pct == 118.75 and s["B"].status == S.STATUS_OVER


def test_golden_activity_shares_and_unbooked_budget(spark):
    bookings = make_bookings(spark, [
        {"project_nr": "P", "activity": "Dev", "hours_billed": 50.0, "customer": "K"},
        {"project_nr": "P", "activity": "Test", "hours_billed": 50.0, "customer": "K"},
    ])
    targets = _targets(spark, [
        {"project_nr": "P", "activity": "Dev", "hours": 60, "valid_from": dt.date(2024, 1, 1)},
        {"project_nr": "P", "activity": "Test", "hours": 30, "valid_from": dt.date(2024, 1, 1)},
        {"project_nr": "P", "activity": "Docs", "hours": 30, "valid_from": dt.date(2024, 1, 1)},  # unbooked
        {"project_nr": "P", "activity": "Dev", "hours": 999, "valid_from": dt.date(2024, 12, 1)},  # not yet valid
    ])
    d = _rows(D.activity_dashboard(D.aggregate_bookings(bookings), targets), "activity")
    assert set(d) == {"Dev", "Test"}  # budget without bookings is not a row ...
    assert d["Dev"].share_pct == 50.0 and d["Test"].share_pct == 25.0  # ... but counts in the denominator
    assert round(d["Dev"].fulfillment_pct, 1) == 83.3
    assert round(d["Test"].fulfillment_pct, 1) == 166.7 and d["Test"].status == S.STATUS_OVER
    summary = D.project_summary(D.aggregate_bookings(bookings), targets).first()
    assert summary.target_hours == 120.0 and summary.n_activities == 2


def test_no_target_and_null_hours(spark):
    bookings = make_bookings(spark, [
        {"project_nr": "P", "activity": "A", "hours_billed": 5.0},
        {"project_nr": "P", "activity": "A", "hours_billed": None},
        {"project_nr": "P", "activity": "B", "hours_billed": None},
    ])
    d = _rows(D.activity_dashboard(D.aggregate_bookings(bookings), _targets(spark, [
        {"project_nr": "Q", "activity": "A", "hours": 1, "valid_from": dt.date(2024, 1, 1)}])), "activity")
    assert d["A"].actual_hours == 5.0 and d["A"].status == S.STATUS_NO_TARGET and d["A"].fulfillment_pct == 0.0
    assert d["B"].actual_hours == 0.0  # an all-NULL group totals 0


def test_customer_of_largest_group(spark):
    bookings = make_bookings(spark, [
        {"project_nr": "P", "activity": "A", "hours_billed": 1.0, "customer": "Small", "employee": "x"},
        {"project_nr": "P", "activity": "A", "hours_billed": 9.0, "customer": "Big", "employee": "y"},
        {"project_nr": "P", "activity": "A", "hours_billed": 9.0, "customer": "Zed", "employee": "z"},
    ])
    d = D.activity_dashboard(D.aggregate_bookings(bookings), _targets(spark, [
        {"project_nr": "P", "activity": "A", "hours": 1, "valid_from": dt.date(2024, 1, 1)}])).first()
    assert d.customer == "Big"  # hours desc, then customer asc


def test_kpis_and_header(spark):
    bookings = make_bookings(spark, [
        {"project_nr": "P", "activity": "A", "hours_billed": 95.0},
        {"project_nr": "P", "activity": "B", "hours_billed": 10.0},
        {"project_nr": "Q", "activity": "A", "hours_billed": 200.0},
    ])
    targets = _targets(spark, [
        {"project_nr": "P", "activity": "A", "hours": 100, "valid_from": dt.date(2024, 1, 1)},
        {"project_nr": "P", "activity": "B", "hours": 100, "valid_from": dt.date(2024, 1, 1)},
        {"project_nr": "Q", "activity": "A", "hours": 100, "valid_from": dt.date(2024, 1, 1)},
    ])
    agg = D.aggregate_bookings(bookings)
    dash = D.activity_dashboard(agg, targets)
    k = D.portfolio_kpis(dash).first()
    assert k.total_hours == 305.0 and k.total_target == 300.0 and k.active_projects == 2
    assert k.nearing_completion == 2 and k.overbooked == 1  # >= 90 includes the overbooked row
    f = D.forecast_kpis(dash).first()
    assert f.remaining_hours == -5.0 and round(f.remaining_pct, 4) == round(-5 / 3, 4)
    h = _rows(D.project_header(dash, agg), "project_nr")
    assert h["P"].n_activities == 2 and h["P"].target_hours == 200.0 and h["P"].actual_hours == 105.0


def test_header_customer_is_that_of_the_largest_group(spark):
    rows = [{"project_nr": "P", "project": "p", "activity": a, "customer": c, "employee": e, "hours_billed": h}
            for a, c, e, h in (("A", "K1", "x", 6.0), ("A", "K1", "y", 6.0), ("B", "K2", "x", 10.0))]
    agg = D.aggregate_bookings(make_bookings(spark, rows))
    targets = _targets(spark, [{"project_nr": "P", "activity": "A", "hours": 100, "valid_from": dt.date(2024, 1, 1)}])
    assert D.project_header(D.activity_dashboard(agg, targets), agg).first().customer == "K2"
    assert D.project_summary(agg, targets).first().customer == "K2"


def test_export_counters_count_the_selection(spark):
    agg = D.aggregate_bookings(make_bookings(spark, [{"project_nr": "P", "activity": "A"}, {"project_nr": "P", "activity": "B"}]))
    chosen = spark.createDataFrame([("P",), (" Q ",), ("",)], "project_nr string")
    got = D.export_counters(agg, selected=chosen).first()
    assert (got.rows_ready, got.n_projects, got.date_range_text) == (2, 2, "All time")
    assert D.export_counters(agg).first().n_projects == 1


def test_top_projects_bars(spark):
    rows = [{"project_nr": f"P{i}", "project": f"Proj {i}", "activity": "A", "hours_billed": 10.0 * i} for i in range(1, 8)]
    targets = _targets(spark, [{"project_nr": f"P{i}", "activity": "A", "hours": 20 * i, "valid_from": dt.date(2024, 1, 1)}
                               for i in range(1, 8)])
    bars = D.top_projects_bars(D.project_summary(D.aggregate_bookings(make_bookings(spark, rows)), targets)).collect()
    assert [b.project for b in bars] == ["Proj 1", "Proj 2", "Proj 3", "Proj 4", "Proj 5"]
    assert bars[-1].planned_width_pct == 100.0 and bars[0].planned_width_pct == 20.0


def test_filters_search_and_projects(spark):
    bookings = make_bookings(spark, [
        {"project_nr": "P1", "project": "Alpha", "activity": "Testing & QA", "customer": None},
        {"project_nr": "P2", "project": "Beta", "activity": "Impl", "customer": "ACME (x)"},
        {"project_nr": "P3", "project": "Gamma", "activity": "Impl", "customer": "Other"},
    ])
    f = B.BookingFilters(search_term="testing")
    assert B.apply_filters(bookings, f).count() == 1
    f = B.BookingFilters(search_term="(x)", search_literal=True)
    assert [r.project_nr for r in B.apply_filters(bookings, f).collect()] == ["P2"]
    assert B.filter_projects(bookings, [None, " ", " P3 "]).count() == 1
    assert B.filter_projects(bookings, []).count() == 0
    codes = bookings.sparkSession.createDataFrame([(" P1",), ("",), (None,)], "project_nr string")
    assert B.filter_projects(bookings, codes).count() == 1


def test_validate_projects(spark):
    known = make_bookings(spark, [{"project_nr": "P1"}, {"project_nr": "P2"}])
    req = spark.createDataFrame([("P1",), (" P2 ",), ("P9",), ("",)], "project_nr string")
    got = {r.requested: r.exists for r in B.validate_projects(req, known).collect()}
    assert got == {"P1": True, " P2 ": True, "P9": False, "": False}
    assert [r.project_nr for r in B.unknown_projects(req, known).collect()] == ["P9"]

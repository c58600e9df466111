"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

All queries run over the whole derived tables at the fixed as-of date of
the test setup (``AS_OF``). Names follow the operator IDs of the survey.
Presentation-only steps (ordering, display rounding) are left out where the
driver compares results order-insensitively; the operators offer them.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as CH
from ..operators import dashboard as D
from ..operators import export as X
from ..operators import filters as B
from ..operators import forecast as FC
from ..operators import ledger as L
from ..operators import profile as P
from ..operators import trends as TR
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import clustered as CL
from ..sources import derived
from ..sources import files as FS
from ..sources.tables import DEFAULT_AS_OF, table, ts_ntz

AS_OF = DEFAULT_AS_OF
AS_OF_DATE = _dt.date(2001, 6, 30)
EDIT_DATE = _dt.date(2001, 12, 31)
WINDOW_START, WINDOW_END = B.default_date_window(AS_OF_DATE)
SEARCH_TERM = "^(PROMO|SMALL)$|GERMANY"
ACTIVITY_SELECTION = ["PROMO", "ECONOMY"]
EMPLOYEE_SELECTION = ["Customer#000000001", "Customer#000000002", "Customer#000000003"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _as_of():
    return ts_ntz(AS_OF)


def _bookings(spark, sf_dir):
    """All bookings."""
    return derived.bookings(spark, sf_dir)


def _booked(spark, sf_dir):
    """Bookings up to the as-of date, where the dashboards' default window ends."""
    return derived.bookings(spark, sf_dir, until=AS_OF)


def _star(spark, sf_dir):
    """All bookings, as a star."""
    return derived.booking_star(spark, sf_dir)


def _booked_star(spark, sf_dir):
    return derived.booking_star(spark, sf_dir, until=AS_OF)


def _ledger(spark, sf_dir):
    return derived.ledger(spark, sf_dir)


def _targets(spark, sf_dir):
    return L.budgets_at(_ledger(spark, sf_dir), AS_OF_DATE)


def _agg(spark, sf_dir):
    return D.aggregate_bookings(_booked_star(spark, sf_dir))


def _dashboard(spark, sf_dir):
    return D.activity_dashboard(_agg(spark, sf_dir), _targets(spark, sf_dir))


def _summary(spark, sf_dir):
    return D.project_summary(_agg(spark, sf_dir), _targets(spark, sf_dir))


def _series(spark, sf_dir):
    """The daily grain of the booking series up to the as-of date."""
    return TR.booking_series(derived.booking_events(spark, sf_dir, until=AS_OF))


def _whole_series(spark, sf_dir):
    """The daily grain of all bookings, for operators that know no as-of date."""
    return TR.booking_series(derived.booking_events(spark, sf_dir))


def _scratch(spark, name):
    """A new folder beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/burnline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def _units(spark, sf_dir, overrides=None):
    return FC.forecast_units(_series(spark, sf_dir), _targets(spark, sf_dir), _as_of(), overrides)


def _overrides(spark, sf_dir):
    """Forecast overrides by key rule: two updates for the projects of every
    fifth supplier (the later one wins, 0 hours among them), one for activity
    PROMO of every fourth, every other of which is inactive."""
    key = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier", "s_suppkey")
    nr = derived.project_nr(key)

    def update(rows, activity, hours, stamp, active):
        return rows.select(nr.alias("project_nr"), F.lit(activity).cast("string").alias("activity"), hours.cast("double").alias("hours_per_sprint"),
                           F.lit("by key rule").alias("reason"), F.lit(stamp).alias("updated_at"), F.lit("planner").alias("updated_by"),
                           active.alias("active"))
    fifth, fourth = suppliers.filter(key % 5 == 0), suppliers.filter(key % 4 == 0)
    return (update(fifth, None, F.lit(999.0), "2001-01-01T00:00:00", F.lit(True))
            .unionByName(update(fifth, None, key % 50, "2001-02-01T00:00:00", F.lit(None).cast("boolean")))
            .unionByName(update(fourth, "PROMO", key % 9 + 1, "2001-01-01T00:00:00", key % 8 == 0)))


SCENARIO_ROUNDED = ["base_hours_per_sprint", "confidence_factor", "hours_per_sprint", "sprints_remaining"]


def _scenario_frame(units):
    sc = FC.scenarios(units, _as_of())
    return sc.select("level", "project_nr", "activity", "scenario", "label", "target_hours", "total_booked",
                     "future_hours", "n_sprints", "remaining_hours",
                     *(F.round(c, 6).alias(c) for c in SCENARIO_ROUNDED),
                     "end_date", "days_left", "beyond_horizon",
                     F.round("utilisation_pct", 6).alias("utilisation_pct"),
                     F.round("certainty_pct", 6).alias("certainty_pct"))


# --- sources and filters ---------------------------------------------------

@register("a1_bookings_scan")
def a1_bookings_scan(spark, sf_dir):
    """A1 + B5/B6/B12: bookings of the default two-year window."""
    f = B.BookingFilters(start_date=WINDOW_START, end_date=WINDOW_END)
    return B.apply_filters(_booked(spark, sf_dir), f).select(*B.BOOKING_COLUMNS)


@register("a2_parameterised_sql")
def a2_parameterised_sql(spark, sf_dir):
    """A2: balances at a date through SQL with a bound date parameter."""
    return FS.run_sql(spark, """
        SELECT project_nr, activity, CAST(SUM(hours) AS DOUBLE) AS budget_hours,
               CAST(SUM(CASE WHEN change_type = 'reduction' THEN -hours ELSE hours END) AS DOUBLE)
                 AS budget_hours_signed
        FROM {ledger} WHERE valid_from <= :as_of
        GROUP BY project_nr, activity""", params={"as_of": AS_OF_DATE}, ledger=_ledger(spark, sf_dir))


@register("b3_b4_year_status_filter")
def b3_b4_year_status_filter(spark, sf_dir):
    """One year, returned lines only, aggregated."""
    f = B.BookingFilters(year=2000, status="R")
    return D.aggregate_bookings(B.apply_filters(_star(spark, sf_dir), f))


@register("b8_activity_filter")
def b8_activity_filter(spark, sf_dir):
    """Activity selection applied before the aggregate."""
    f = B.BookingFilters(activities=ACTIVITY_SELECTION)
    return D.aggregate_bookings(B.apply_filters(_star(spark, sf_dir), f))


@register("b3_month_filter")
def b3_month_filter(spark, sf_dir):
    """One month of one year."""
    f = B.BookingFilters(year=1999, month=12)
    return D.aggregate_bookings(B.apply_filters(_star(spark, sf_dir), f))


@register("b7_b10_activity_statuses")
def b7_b10_activity_statuses(spark, sf_dir):
    """One activity, several statuses."""
    f = B.BookingFilters(activity="PROMO", statuses=["A", "N"])
    return D.aggregate_bookings(B.apply_filters(_star(spark, sf_dir), f))


@register("b8_employee_filter")
def b8_employee_filter(spark, sf_dir):
    """Employee selection."""
    f = B.BookingFilters(employees=EMPLOYEE_SELECTION)
    return D.aggregate_bookings(B.apply_filters(_star(spark, sf_dir), f))


@register("b1_b2_project_restriction")
def b1_b2_project_restriction(spark, sf_dir):
    """B1/B2: a list of project codes, with blanks and surrounding spaces, as a semi join."""
    key = F.col("s_suppkey")
    codes = table(spark, sf_dir, "supplier", "s_suppkey").filter(key % 3 == 0).select(
        F.when(key % 2 == 0, F.concat(F.lit(" "), derived.project_nr(key), F.lit(" "))).otherwise(derived.project_nr(key)).alias("project_nr"))
    codes = codes.unionByName(codes.select(F.lit("  ").alias("project_nr")))
    return D.aggregate_bookings(B.apply_filters(_star(spark, sf_dir), B.BookingFilters(projects=codes)))


def _entitlements(spark, sf_dir):
    """A user of each nation may see the projects of its suppliers."""
    suppliers = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(
        F.broadcast(table(spark, sf_dir, "nation", "n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey"))
    grant = F.struct(F.array(derived.project_nr(F.col("s_suppkey"))).alias("projects"),
                     F.lit(None).cast("array<string>").alias("permissions"))
    return suppliers.select(F.create_map(F.concat(F.lower("n_name"), F.lit("@example.com")), grant).alias("users"),
                            F.array(F.lit("view")).alias("default_permissions"))


@register("c4_entitled_bookings")
def c4_entitled_bookings(spark, sf_dir):
    """The bookings a user is entitled to, aggregated."""
    return D.aggregate_bookings_compact(B.restrict_to_user(_star(spark, sf_dir), _entitlements(spark, sf_dir), "nation_9@example.com"))


@register("c4_entitled_from_parts")
def c4_entitled_from_parts(spark, sf_dir):
    """C4/A15 on the stored table by project: all bookings are written, the folders of the user's projects read."""
    path = _scratch(spark, "bookings")
    FS.write_bookings_by_project(_bookings(spark, sf_dir), path)
    return D.aggregate_bookings_compact(FS.read_entitled_bookings(spark, path, _entitlements(spark, sf_dir), "nation_9@example.com"))


@register("b11_search_filter")
def b11_search_filter(spark, sf_dir):
    """Case-insensitive regex over activity, project, customer."""
    f = B.BookingFilters(search_term=SEARCH_TERM)
    return D.aggregate_bookings(B.apply_filters(_star(spark, sf_dir), f))


@register("b13_logged_hours_aggregate")
def b13_logged_hours_aggregate(spark, sf_dir):
    """The aggregate on the logged-hours measure."""
    return D.aggregate_bookings(_star(spark, sf_dir), "hours_logged").withColumn("actual_hours", F.round("actual_hours", 6))


@register("b19_filter_summary")
def b19_filter_summary(spark, sf_dir):
    f = B.BookingFilters(start_date=WINDOW_START, end_date=WINDOW_END,
                         activities=ACTIVITY_SELECTION, search_term=SEARCH_TERM)
    s = B.filter_summary(B.apply_filters(_booked(spark, sf_dir), f), f)
    return s.select("active_filters", F.array_join("filter_texts", " | ").alias("filter_texts"), "record_count")


@register("c3_project_validation")
def c3_project_validation(spark, sf_dir):
    """Every ledger project code checked against the booked projects."""
    requested = _ledger(spark, sf_dir).select("project_nr").distinct()
    return B.validate_projects(requested, _bookings(spark, sf_dir))


@register("c3_unknown_projects")
def c3_unknown_projects(spark, sf_dir):
    """C3 anti join: codes numbered as the parts are that no booking has."""
    requested = table(spark, sf_dir, "part", "p_partkey").select(derived.project_nr(F.col("p_partkey")).alias("project_nr"))
    return B.unknown_projects(requested, _bookings(spark, sf_dir))


@register("g1_project_list")
def g1_project_list(spark, sf_dir):
    return B.project_list(_bookings(spark, sf_dir))


@register("b9_employee_options")
def b9_employee_options(spark, sf_dir):
    return B.option_values(D.aggregate_bookings(_star(spark, sf_dir)), "employee")


# --- dashboard --------------------------------------------------------------

@register("d1_booking_aggregate")
def d1_booking_aggregate(spark, sf_dir):
    return D.aggregate_bookings(_star(spark, sf_dir))


@register("d1b_compact_aggregate")
def d1b_compact_aggregate(spark, sf_dir):
    return D.aggregate_bookings_compact(_star(spark, sf_dir))


@register("d2_activity_dashboard")
def d2_activity_dashboard(spark, sf_dir):
    return _dashboard(spark, sf_dir)


@register("d3_project_summary")
def d3_project_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@register("d4_project_header")
def d4_project_header(spark, sf_dir):
    return D.project_header(D.activity_dashboard(_agg(spark, sf_dir), _targets(spark, sf_dir), with_top=True))


@register("d5_portfolio_kpis")
def d5_portfolio_kpis(spark, sf_dir):
    return D.portfolio_kpis(_dashboard(spark, sf_dir))


@register("d6_forecast_kpis")
def d6_forecast_kpis(spark, sf_dir):
    return D.forecast_kpis(_dashboard(spark, sf_dir))


@register("d7_budget_tab_kpis")
def d7_budget_tab_kpis(spark, sf_dir):
    return D.budget_tab_kpis(_dashboard(spark, sf_dir))


@register("d28_export_counters")
def d28_export_counters(spark, sf_dir):
    f = B.BookingFilters(start_date=WINDOW_START, end_date=WINDOW_END)
    return D.export_counters(D.aggregate_bookings(B.apply_filters(_booked_star(spark, sf_dir), f)), WINDOW_START, WINDOW_END)


@register("d5_kpis_beside_write")
def d5_kpis_beside_write(spark, sf_dir):
    """The dashboard is stored, its KPIs are observed by the tasks that write."""
    return D.write_dashboard(_dashboard(spark, sf_dir), _scratch(spark, "dashboard"))


@register("d28_counters_beside_write")
def d28_counters_beside_write(spark, sf_dir):
    """The filtered aggregate is stored, its rows and bookings are counted by the tasks that write."""
    f = B.BookingFilters(start_date=WINDOW_START, end_date=WINDOW_END)
    agg = D.aggregate_bookings(B.apply_filters(_booked_star(spark, sf_dir), f))
    return D.write_aggregate(agg, _scratch(spark, "aggregate"), WINDOW_START, WINDOW_END)


@register("e7_top_projects_bars")
def e7_top_projects_bars(spark, sf_dir):
    return D.top_projects_bars(_summary(spark, sf_dir))


@register("h10_project_health")
def h10_project_health(spark, sf_dir):
    return D.project_health(_summary(spark, sf_dir))


# --- ledger -----------------------------------------------------------------

@register("a6_ledger_history")
def a6_ledger_history(spark, sf_dir):
    return L.history(_ledger(spark, sf_dir), order=False).withColumn("hours", F.col("hours").cast("double"))


@register("a12_history_display")
def a12_history_display(spark, sf_dir):
    return L.history_display(_ledger(spark, sf_dir), change_type="reduction")


@register("d9_budgets_at_date")
def d9_budgets_at_date(spark, sf_dir):
    return _targets(spark, sf_dir)


@register("d10_current_budgets")
def d10_current_budgets(spark, sf_dir):
    return L.current_budgets(_ledger(spark, sf_dir), AS_OF_DATE)


@register("e4_latest_entries")
def e4_latest_entries(spark, sf_dir):
    return L.latest_entries(_ledger(spark, sf_dir), AS_OF_DATE).withColumn("hours", F.col("hours").cast("double"))


@register("e8_running_balance")
def e8_running_balance(spark, sf_dir):
    r = L.running_balance(cut_lineage(_ledger(spark, sf_dir)))
    return r.select("entry_id", "project_nr", "activity", "valid_from", "balance", "balance_signed")


@register("c6_monthly_balances")
def c6_monthly_balances(spark, sf_dir):
    """Budget as of the last day of every month a key has bookings."""
    probes = _bookings(spark, sf_dir).select("project_nr", "activity", F.last_day("entry_date").alias("as_of_date"))
    return L.balances_at_dates(_ledger(spark, sf_dir), probes)


def _ledger_days(spark, sf_dir):
    """The ledger's day totals, stored clustered by key."""
    return CL.write_clustered(L.ledger_days(_ledger(spark, sf_dir)), _scratch(spark, "days"), L.KEY, ["valid_from"])


@register("c6_clustered_balances")
def c6_clustered_balances(spark, sf_dir):
    """C6 on clustered tables: day totals and probe dates are stored by key, the lookup shuffles nothing."""
    probes = _bookings(spark, sf_dir).select("project_nr", "activity", F.last_day("entry_date").alias("as_of_date")).distinct()
    asks = CL.write_clustered(probes, _scratch(spark, "probes"), L.KEY, ["as_of_date"])
    return L.balances_of_days(_ledger_days(spark, sf_dir), asks)


@register("d9_clustered_budgets")
def d9_clustered_budgets(spark, sf_dir):
    """D9 on the clustered day totals."""
    return L.budgets_of_days(_ledger_days(spark, sf_dir), AS_OF_DATE)


@register("d11_budget_overview")
def d11_budget_overview(spark, sf_dir):
    return L.budget_overview(_ledger(spark, sf_dir), AS_OF_DATE)


@register("d11_budget_overview_kpis")
def d11_budget_overview_kpis(spark, sf_dir):
    k = L.budget_overview_kpis(L.budget_overview(_ledger(spark, sf_dir), AS_OF_DATE))
    return k.withColumn("avg_hours", F.round("avg_hours", 6))


@register("d12_history_summary")
def d12_history_summary(spark, sf_dir):
    return L.history_summary(_ledger(spark, sf_dir))


@register("d26_ledger_profile")
def d26_ledger_profile(spark, sf_dir):
    return L.ledger_profile(_ledger(spark, sf_dir))


@register("d27_budget_maps")
def d27_budget_maps(spark, sf_dir):
    """D27, the entries of the maps side by side with their number."""
    maps = L.budget_maps(_targets(spark, sf_dir))
    return maps.select("project_nr", F.size("budgets").alias("n_budgets"), F.explode("budgets").alias("activity", "budget_hours"))


@register("d8_budget_at_date")
def d8_budget_at_date(spark, sf_dir):
    """The balance of one key at the as-of date."""
    return L.budget_at(_ledger(spark, sf_dir), "P00001", "PROMO", AS_OF_DATE)


@register("g2_ledger_activities")
def g2_ledger_activities(spark, sf_dir):
    return L.ledger_activities(_ledger(spark, sf_dir))


@register("j1_ledger_validation")
def j1_ledger_validation(spark, sf_dir):
    v = L.validate_entries(_ledger(spark, sf_dir), form_rules=True)
    return v.select("entry_id", "is_valid", F.array_join("errors", ",").alias("errors"))


@register("j3_preview_changes")
def j3_preview_changes(spark, sf_dir):
    """Entries valid after the as-of date, previewed against the balance
    at the as-of date (stacked per key in entry order)."""
    led = cut_lineage(_ledger(spark, sf_dir))
    proposals = led.filter(F.col("valid_from") > F.lit(AS_OF_DATE)) \
        .select(F.col("entry_id").alias("proposal_id"), "project_nr", "activity", "hours")
    return L.preview_changes(led, proposals, AS_OF_DATE)


@register("j2_target_changes")
def j2_target_changes(spark, sf_dir):
    """The dashboard's targets at the as-of date against the targets six
    months later, paired by key, as ledger deltas (T3). Both balances come
    from one pass over the ledger."""
    booked = _agg(spark, sf_dir).select("project_nr", "activity").distinct()
    two = L.budgets_at_dates_wide(_ledger(spark, sf_dir), {"old_target": AS_OF_DATE, "new_target": EDIT_DATE})
    frame = booked.join(two, ["project_nr", "activity"], "left").na.fill(0.0, ["old_target", "new_target"])
    shown = {c: frame.select("project_nr", "activity", F.col(c).alias("target_hours")) for c in ("old_target", "new_target")}
    return CH.detect_target_changes(shown["old_target"], shown["new_target"])


# --- trends -----------------------------------------------------------------

@register("d13_daily_totals")
def d13_daily_totals(spark, sf_dir):
    return TR.daily_totals(_whole_series(spark, sf_dir), ["project_nr"])


@register("e2_burndown")
def e2_burndown(spark, sf_dir):
    return TR.burndown(_whole_series(spark, sf_dir), ["project_nr"])


@register("e3_activity_cumulative")
def e3_activity_cumulative(spark, sf_dir):
    return TR.burndown(_whole_series(spark, sf_dir), ["project_nr", "activity"])


@register("d14_weekly_totals")
def d14_weekly_totals(spark, sf_dir):
    return TR.weekly_totals(_whole_series(spark, sf_dir), ["project_nr"])


@register("d15_activity_weekly")
def d15_activity_weekly(spark, sf_dir):
    return TR.weekly_totals(_whole_series(spark, sf_dir), ["project_nr", "activity"])


@register("e5_weekly_trend")
def e5_weekly_trend(spark, sf_dir):
    t = TR.weekly_trend(_whole_series(spark, sf_dir), ["project_nr"])
    return t.withColumn("avg_weekly_hours", F.round("avg_weekly_hours", 6)) \
        .withColumn("avg_last4_hours", F.round("avg_last4_hours", 6))


@register("d20_booking_rates")
def d20_booking_rates(spark, sf_dir):
    r = TR.booking_rates(_series(spark, sf_dir), ["project_nr"], _as_of())
    return r.withColumn("rate_4w", F.round("rate_4w", 6)).withColumn("rate_total", F.round("rate_total", 6))


@register("d22_simple_forecast")
def d22_simple_forecast(spark, sf_dir):
    keys = ["project_nr"]
    tg = FC.unit_targets(_targets(spark, sf_dir)).filter(F.col("level") == "project").select("project_nr", "target_hours")
    rates = TR.booking_rates(_series(spark, sf_dir), keys, _as_of())
    f = TR.simple_forecast(rates, tg, keys, _as_of())
    return f.select("project_nr", "target_hours", "total_booked", "remaining_hours",
                    F.round("remaining_pct", 6).alias("remaining_pct"),
                    F.round("weeks_remaining", 6).alias("weeks_remaining"), "rate_status",
                    F.col("forecast_end").cast("date").alias("forecast_end_date"),
                    "timeline_start", "timeline_end")


@register("i15_burndown_metrics")
def i15_burndown_metrics(spark, sf_dir):
    keys = ["project_nr"]
    tg = FC.unit_targets(_targets(spark, sf_dir)).filter(F.col("level") == "project").select("project_nr", "target_hours")
    m = TR.burndown_metrics(_series(spark, sf_dir), tg, keys, _as_of())
    return m.withColumn("fulfillment_pct", F.round("fulfillment_pct", 6))


@register("i13_cumulative_with_targets")
def i13_cumulative_with_targets(spark, sf_dir):
    return TR.cumulative_with_targets(_whole_series(spark, sf_dir), _targets(spark, sf_dir))


# --- forecast ---------------------------------------------------------------

@register("d16_sprint_table")
def d16_sprint_table(spark, sf_dir):
    return FC.sprint_table(_series(spark, sf_dir), _as_of())


@register("d17_velocity_stats")
def d17_velocity_stats(spark, sf_dir):
    st = FC.velocity_stats(FC.sprint_table(_series(spark, sf_dir), _as_of()))
    return st.select("level", "project_nr", "activity", "n_sprints",
                     F.round("automatic_hours_per_sprint", 6).alias("automatic_hours_per_sprint"),
                     F.round("sprint_std", 6).alias("sprint_std"), F.round("slope", 6).alias("slope"),
                     "trend", "direction", "trend_chrono")


@register("i5_forecast_scenarios")
def i5_forecast_scenarios(spark, sf_dir):
    return _scenario_frame(_units(spark, sf_dir))


@register("i2_override_scenarios")
def i2_override_scenarios(spark, sf_dir):
    """The scenarios with manual velocities where an active override exists."""
    return _scenario_frame(_units(spark, sf_dir, _overrides(spark, sf_dir)))


@register("i8_trend_alerts")
def i8_trend_alerts(spark, sf_dir):
    a = FC.trend_alert(_units(spark, sf_dir))
    return a.withColumn("slope", F.round("slope", 6))


@register("i9_sprint_details")
def i9_sprint_details(spark, sf_dir):
    return FC.sprint_details(FC.sprint_table(_series(spark, sf_dir), _as_of()))


@register("i10_scenario_series")
def i10_scenario_series(spark, sf_dir):
    s = _series(spark, sf_dir)
    sc = FC.scenarios(FC.forecast_units(s, _targets(spark, sf_dir), _as_of()), _as_of())
    out = FC.scenario_series(s, sc, _as_of())
    return out.withColumn("x", F.col("x").cast("date")).withColumn("y", F.round("y", 6))


@register("i11_burndown_series")
def i11_burndown_series(spark, sf_dir):
    """The project burn-down with scenario lines, or the simple forecast's where none lies ahead."""
    s, targets = _series(spark, sf_dir), _targets(spark, sf_dir)
    sc = FC.scenarios(FC.forecast_units(s, targets, _as_of()), _as_of())
    tg = FC.unit_targets(targets).filter(F.col("level") == "project").select("project_nr", "target_hours")
    simple = TR.simple_forecast(TR.booking_rates(s, ["project_nr"], _as_of()), tg, ["project_nr"], _as_of())
    out = FC.burndown_series(s, sc, simple, _as_of())
    return out.withColumn("x", F.col("x").cast("date")).withColumn("y", F.round("y", 6))


@register("i12_velocity_series")
def i12_velocity_series(spark, sf_dir):
    v = FC.velocity_series(FC.sprint_table(_series(spark, sf_dir), _as_of()))
    return v.withColumn("y", F.round("y", 6))


# --- exports and profiles ---------------------------------------------------

@register("a13_summary_export")
def a13_summary_export(spark, sf_dir):
    return X.summary_export_frame(_dashboard(spark, sf_dir))


@register("a14_detail_export")
def a14_detail_export(spark, sf_dir):
    return X.detail_export_frame(_bookings(spark, sf_dir))


@register("d25_dataset_profile")
def d25_dataset_profile(spark, sf_dir):
    return P.dataset_profile(_bookings(spark, sf_dir))

"""DuckDB SQL for every registered query (see :mod:`burnline.plans.oracle`
for the shared derivations of bookings, ledger, targets and dashboard)."""

from __future__ import annotations

from .oracle import (AGG_CTE, ALL_BOOKINGS_CTE, AS_OF_DATE, AS_OF_TS, BOOKINGS_CTE, DASH_CTE, LEDGER_CTE,
                     TARGETS_CTE)


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def cte(name: str, sql: str) -> str:
    return f"{name} AS (\n{sql.strip()}\n)"


def fulfil(a: str, t: str) -> str:
    return f"CASE WHEN {t} > 0 THEN {a} / {t} * 100 ELSE 0.0 END"


def status(a: str, t: str) -> str:
    return (f"CASE WHEN {t} = 0 THEN '🔴 Kein Ziel' WHEN {a} / {t} * 100 <= 100 THEN '🟢 Buchbar' "
            f"WHEN {a} / {t} * 100 <= 110 THEN '🟡 Kritisch' ELSE '🔴 Überbucht' END")


def exact_sum(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(38,2))) AS DOUBLE)"


def bround(c: str, n: int) -> str:
    """Half-even rounding of a DOUBLE on its decimal form."""
    return f"CAST(round_even(CAST({c} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def floor_days(a: str, b: str) -> str:
    return f"CAST(floor(date_diff('microsecond', {a}, {b}) / CAST(86400000000 AS DOUBLE)) AS BIGINT)"


def r6(c: str) -> str:
    return f"round({c}, 6)"


def fmt_date(c: str) -> str:
    return f"strftime({c}, '%d.%m.%Y')"


def ellipsize(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END"


def blank(c: str) -> str:
    return f"({c} IS NULL OR length(trim({c})) = 0)"


US_PER_DAY = "CAST(86400000000 AS DOUBLE)"
HORIZON_US = f"CAST(date_diff('microsecond', {AS_OF_TS}, TIMESTAMP '9999-12-31 23:59:59.999999') AS DOUBLE)"
RECENT = f"booking_ts >= {AS_OF_TS} - INTERVAL 28 DAY"

BASE = (BOOKINGS_CTE, LEDGER_CTE)
ALL = (ALL_BOOKINGS_CTE, LEDGER_CTE)
DASH = (BOOKINGS_CTE, LEDGER_CTE, TARGETS_CTE, AGG_CTE, DASH_CTE)

SERIES_CTE = cte("series", "SELECT project_nr, project, activity, booking_ts, hours_billed AS hours FROM bookings")

SUMMARY_CTES = (
    cte("act3", """
  SELECT project_nr, project, COALESCE(SUM(actual_hours), 0.0) AS actual_hours,
         COUNT(DISTINCT activity) AS n_activities,
         arg_min(customer, (-COALESCE(actual_hours, 0.0), customer, employee)) AS customer
  FROM agg GROUP BY project_nr, project"""),
    cte("tp", f"SELECT project_nr, {exact_sum('budget_hours')} AS budget_hours FROM targets GROUP BY project_nr"),
    cte("summary", f"""
  SELECT a.project_nr, a.project, a.customer, COALESCE(tp.budget_hours, 0.0) AS target_hours, a.actual_hours,
         {fulfil('a.actual_hours', 'COALESCE(tp.budget_hours, 0.0)')} AS fulfillment_pct,
         {status('a.actual_hours', 'COALESCE(tp.budget_hours, 0.0)')} AS status,
         a.n_activities
  FROM act3 a LEFT JOIN tp ON a.project_nr = tp.project_nr"""),
)

SPRINT_CTES = (
    cte("sprint_rows", f"""
  SELECT project_nr, activity, hours, booking_ts,
         CAST(floor({floor_days('booking_ts', AS_OF_TS)} / CAST(14 AS DOUBLE)) AS INTEGER) AS sprint_number
  FROM series"""),
    cte("act_sprints", """
  SELECT project_nr, activity, sprint_number, SUM(hours) AS hours,
         MIN(booking_ts) AS sprint_start, MAX(booking_ts) AS sprint_end
  FROM sprint_rows WHERE sprint_number BETWEEN 0 AND 3
  GROUP BY project_nr, activity, sprint_number"""),
    cte("sprints", """
  SELECT 'activity' AS level, project_nr, activity, sprint_number, hours, sprint_start, sprint_end FROM act_sprints
  UNION ALL
  SELECT 'project' AS level, project_nr, CAST(NULL AS VARCHAR) AS activity, sprint_number, SUM(hours) AS hours,
         MIN(sprint_start) AS sprint_start, MAX(sprint_end) AS sprint_end
  FROM act_sprints GROUP BY project_nr, sprint_number"""),
    cte("sprint_table", f"""
  SELECT level, project_nr, activity, sprint_number, hours, sprint_start, sprint_end,
         {AS_OF_TS} - to_days(CAST((sprint_number + 1) * 14 AS INTEGER)) AS bound_start,
         {AS_OF_TS} - to_days(CAST(sprint_number * 14 AS INTEGER)) AS bound_end,
         CAST(CASE sprint_number WHEN 0 THEN 0.4 WHEN 1 THEN 0.3 WHEN 2 THEN 0.2 WHEN 3 THEN 0.1 ELSE 0.0 END AS DOUBLE) AS weight
  FROM sprints"""),
    cte("vsums", """
  SELECT level, project_nr, activity, COUNT(*) AS n,
         SUM(hours * (4 - sprint_number)) AS hw, SUM(4 - sprint_number) AS w,
         stddev_samp(hours) AS std, regr_slope(hours, CAST(sprint_number AS DOUBLE)) AS raw_slope
  FROM sprint_table GROUP BY level, project_nr, activity"""),
    cte("vel", """
  SELECT level, project_nr, activity, n AS n_sprints, hw / w AS automatic_hours_per_sprint,
         CASE WHEN n >= 2 THEN std END AS sprint_std,
         CASE WHEN n >= 2 THEN COALESCE(round(raw_slope, 9), 0.0) ELSE 0.0 END AS slope
  FROM vsums"""),
    cte("vel2", """
  SELECT *,
         CASE WHEN n_sprints < 2 THEN 'insufficient_data' WHEN slope > 2 THEN 'increasing'
              WHEN slope < -2 THEN 'decreasing' ELSE 'stable' END AS trend,
         CAST(sign(slope) AS DOUBLE) AS direction,
         -slope AS slope_chrono,
         CASE WHEN n_sprints < 2 THEN 'insufficient_data' WHEN -slope > 2 THEN 'increasing'
              WHEN -slope < -2 THEN 'decreasing' ELSE 'stable' END AS trend_chrono
  FROM vel"""),
)

UNIT_CTES = (
    cte("act_tot", f"""
  SELECT project_nr, activity, SUM(hours) AS total_booked,
         SUM(CASE WHEN booking_ts > {AS_OF_TS} THEN hours ELSE 0.0 END) AS future_hours,
         COUNT(*) AS n_bookings
  FROM series GROUP BY project_nr, activity"""),
    cte("unit_tot", """
  SELECT 'activity' AS level, project_nr, activity, total_booked, future_hours, n_bookings FROM act_tot
  UNION ALL
  SELECT 'project' AS level, project_nr, CAST(NULL AS VARCHAR) AS activity, SUM(total_booked), SUM(future_hours),
         CAST(SUM(n_bookings) AS BIGINT)
  FROM act_tot GROUP BY project_nr"""),
    cte("unit_targets", f"""
  SELECT 'activity' AS level, project_nr, activity, budget_hours AS target_hours FROM targets
  UNION ALL
  SELECT 'project' AS level, project_nr, CAST(NULL AS VARCHAR) AS activity, {exact_sum('budget_hours')} AS target_hours
  FROM targets GROUP BY project_nr"""),
    cte("units0", """
  SELECT t.level, t.project_nr, t.activity, COALESCE(g.target_hours, 0.0) AS target_hours,
         t.total_booked, t.future_hours, t.n_bookings,
         COALESCE(v.n_sprints, 0) AS n_sprints,
         COALESCE(v.automatic_hours_per_sprint, 0.0) AS automatic_hours_per_sprint,
         v.sprint_std,
         COALESCE(v.slope, 0.0) AS slope, COALESCE(v.trend, 'insufficient_data') AS trend,
         COALESCE(v.direction, 0.0) AS direction, COALESCE(v.slope_chrono, 0.0) AS slope_chrono,
         COALESCE(v.trend_chrono, 'insufficient_data') AS trend_chrono
  FROM unit_tot t
  LEFT JOIN unit_targets g
    ON g.level = t.level AND g.project_nr = t.project_nr AND g.activity IS NOT DISTINCT FROM t.activity
  LEFT JOIN vel2 v
    ON v.level = t.level AND v.project_nr = t.project_nr AND v.activity IS NOT DISTINCT FROM t.activity"""),
    cte("units", """
  SELECT *, automatic_hours_per_sprint AS base_hours_per_sprint,
         CASE WHEN n_sprints >= 2 THEN CASE WHEN automatic_hours_per_sprint > 0
              THEN sprint_std / automatic_hours_per_sprint ELSE 0.2 END ELSE 0.2 END AS confidence_factor,
         greatest(0.0, target_hours - total_booked) AS remaining_hours
  FROM units0"""),
    cte("scen0", """
  SELECT u.*, s.scenario, s.label,
         CASE s.scenario WHEN 'optimistic' THEN base_hours_per_sprint * (1 + confidence_factor * 1.5)
              WHEN 'realistic' THEN base_hours_per_sprint
              ELSE greatest(base_hours_per_sprint * (1 - confidence_factor * 1.5), 0.1) END AS hours_per_sprint
  FROM units u,
       (VALUES ('optimistic', 'Optimistisch (90% Konfidenz)'), ('realistic', 'Realistisch (50% Konfidenz)'),
               ('pessimistic', 'Pessimistisch (10% Konfidenz)')) s(scenario, label)
  WHERE u.target_hours > 0 AND u.n_bookings > 0"""),
    cte("scen1", """
  SELECT *, CASE WHEN hours_per_sprint > 0 THEN remaining_hours / hours_per_sprint
                 ELSE CAST('inf' AS DOUBLE) END AS sprints_remaining
  FROM scen0"""),
    cte("scen2", f"""
  SELECT *, sprints_remaining * CAST(14 AS DOUBLE) AS days,
         sprints_remaining * CAST(14 AS DOUBLE) * {US_PER_DAY} > {HORIZON_US} AS beyond
  FROM scen1"""),
    cte("scen", f"""
  SELECT *, CASE WHEN hours_per_sprint > 0 AND NOT beyond THEN {AS_OF_TS} + to_microseconds(
              CAST(round(CASE WHEN beyond THEN 0 ELSE days * {US_PER_DAY} END) AS BIGINT)) END AS end_ts
  FROM scen2"""),
)

RATE_CTES = (
    cte("rates", f"""
  SELECT project_nr, SUM(hours) AS total_booked, COUNT(*) AS n_bookings,
         COUNT(*) FILTER (WHERE {RECENT}) AS n_recent,
         SUM(hours) FILTER (WHERE {RECENT}) AS h4,
         MIN(booking_ts) FILTER (WHERE {RECENT}) AS f4,
         MAX(booking_ts) FILTER (WHERE {RECENT}) AS l4,
         MIN(booking_ts) AS first_booking, MAX(booking_ts) AS last_booking,
         SUM(hours) FILTER (WHERE booking_ts IS NOT NULL) AS dated_hours
  FROM series GROUP BY project_nr"""),
    cte("rates2", f"""
  SELECT project_nr, total_booked, n_bookings, n_recent, first_booking, last_booking, dated_hours,
         CASE WHEN n_recent > 0 THEN h4 / greatest({floor_days('f4', 'l4')} / CAST(7 AS DOUBLE), 1.0)
              ELSE 0.0 END AS rate_4w,
         CASE WHEN first_booking IS NOT NULL
              THEN total_booked / greatest({floor_days('first_booking', 'last_booking')} / CAST(7 AS DOUBLE), 1.0)
         END AS rate_total
  FROM rates"""),
    cte("ptargets", f"SELECT project_nr, {exact_sum('budget_hours')} AS target_hours FROM targets GROUP BY project_nr"),
    cte("fc0", """
  SELECT r.*, COALESCE(t.target_hours, 0.0) AS target_hours,
         COALESCE(t.target_hours, 0.0) - r.total_booked AS remaining_hours
  FROM rates2 r LEFT JOIN ptargets t ON r.project_nr = t.project_nr"""),
    cte("fc1", """
  SELECT *, CASE WHEN rate_4w > 0 AND remaining_hours > 0 THEN remaining_hours / rate_4w END AS weeks_remaining
  FROM fc0"""),
    cte("fc", f"""
  SELECT *,
         CASE WHEN target_hours <= 0 OR n_recent = 0 THEN NULL
              WHEN rate_4w > 0 AND remaining_hours > 0 THEN
                CASE WHEN weeks_remaining * 7 * {US_PER_DAY} > {HORIZON_US} THEN NULL
                     ELSE {AS_OF_TS} + to_microseconds(CAST(round(
                       CASE WHEN weeks_remaining * 7 * {US_PER_DAY} > {HORIZON_US} THEN 0
                            ELSE weeks_remaining * 7 * {US_PER_DAY} END) AS BIGINT)) END
              WHEN remaining_hours <= 0 THEN {AS_OF_TS} END AS forecast_end
  FROM fc1"""),
)

SER = (BOOKINGS_CTE, SERIES_CTE)
WHOLE = (ALL_BOOKINGS_CTE, SERIES_CTE)
RATES = (BOOKINGS_CTE, SERIES_CTE, LEDGER_CTE, TARGETS_CTE) + RATE_CTES
SPRINTS = (BOOKINGS_CTE, SERIES_CTE) + SPRINT_CTES
FCST = (BOOKINGS_CTE, SERIES_CTE, LEDGER_CTE, TARGETS_CTE) + SPRINT_CTES + UNIT_CTES

SQL: dict[str, str] = {}

# --- sources and filters ---------------------------------------------------
SQL["a1_bookings_scan"] = with_ctes(*BASE, body="""
SELECT * FROM bookings WHERE entry_date >= DATE '1999-06-30' AND entry_date <= DATE '2001-06-30'""")

_AGG_BODY = """
SELECT project, project_nr, customer, employee, activity, SUM(hours_billed) AS actual_hours,
       COUNT(*) AS entry_count, MIN(entry_date) AS first_entry, MAX(entry_date) AS last_entry
FROM bookings WHERE {where}
GROUP BY project, project_nr, customer, employee, activity"""
_SEARCH = "(?i)^(PROMO|SMALL)$|GERMANY"
_SEARCH_PRED = " OR ".join(f"COALESCE(regexp_matches({c}, '{_SEARCH}'), false)"
                           for c in ("activity", "project", "customer"))

SQL["a2_parameterised_sql"] = with_ctes(LEDGER_CTE, TARGETS_CTE, body="SELECT * FROM targets")
SQL["b3_b4_year_status_filter"] = with_ctes(*ALL, body=_AGG_BODY.format(where="year = 2000 AND status = 'R'"))
SQL["b8_activity_filter"] = with_ctes(*ALL, body=_AGG_BODY.format(where="activity IN ('PROMO', 'ECONOMY')"))
SQL["b3_month_filter"] = with_ctes(*ALL, body=_AGG_BODY.format(where="year = 1999 AND month = 12"))
SQL["b7_b10_activity_statuses"] = with_ctes(*ALL, body=_AGG_BODY.format(where="activity = 'PROMO' AND status IN ('A', 'N')"))
SQL["b8_employee_filter"] = with_ctes(*ALL, body=_AGG_BODY.format(
    where="employee IN ('Customer#000000001', 'Customer#000000002', 'Customer#000000003')"))
SQL["b1_b2_project_restriction"] = with_ctes(*ALL, body=_AGG_BODY.format(
    where="project_nr IN (SELECT printf('P%05d', s_suppkey) FROM supplier WHERE s_suppkey % 3 = 0)"))
SQL["b11_search_filter"] = with_ctes(*ALL, body=_AGG_BODY.format(where=f"({_SEARCH_PRED})"))
SQL["b13_logged_hours_aggregate"] = with_ctes(*ALL, body="""
SELECT project, project_nr, customer, employee, activity, round(SUM(hours_logged), 6) AS actual_hours,
       COUNT(*) AS entry_count, MIN(entry_date) AS first_entry, MAX(entry_date) AS last_entry
FROM bookings GROUP BY project, project_nr, customer, employee, activity""")
_SUMMARY_TEXT = ("Zeitraum: 30.06.1999 - 30.06.2001 | Tätigkeiten: PROMO, ECONOMY | "
                 "Suche: ''^(PROMO|SMALL)$|GERMANY''")
SQL["b19_filter_summary"] = with_ctes(*BASE, body=f"""
SELECT CAST(3 AS BIGINT) AS active_filters, '{_SUMMARY_TEXT}' AS filter_texts, COUNT(*) AS record_count
FROM bookings
WHERE entry_date >= DATE '1999-06-30' AND entry_date <= DATE '2001-06-30'
  AND activity IN ('PROMO', 'ECONOMY') AND ({_SEARCH_PRED})""")
SQL["c3_project_validation"] = with_ctes(
    *ALL,
    cte("req", "SELECT DISTINCT project_nr AS requested FROM ledger"),
    cte("known", "SELECT DISTINCT project_nr AS code FROM bookings WHERE project_nr IS NOT NULL"),
    body=f"""
SELECT r.requested, trim(r.requested) AS project_nr,
       (k.code IS NOT NULL AND NOT {blank('trim(r.requested)')}) AS "exists"
FROM req r LEFT JOIN known k ON trim(r.requested) = k.code""")
SQL["c3_unknown_projects"] = with_ctes(*ALL, body="""
SELECT DISTINCT printf('P%05d', p_partkey) AS project_nr FROM part p
WHERE NOT EXISTS (SELECT 1 FROM bookings b WHERE b.project_nr = printf('P%05d', p.p_partkey))""")
SQL["g1_project_list"] = with_ctes(*ALL, body="SELECT DISTINCT project, project_nr, customer FROM bookings")
SQL["b9_employee_options"] = with_ctes(ALL_BOOKINGS_CTE, AGG_CTE,
                                       body="SELECT DISTINCT employee FROM agg WHERE employee IS NOT NULL")

# --- dashboard --------------------------------------------------------------
SQL["d1_booking_aggregate"] = with_ctes(ALL_BOOKINGS_CTE, AGG_CTE, body="SELECT * FROM agg")
_COMPACT_BODY = """
SELECT project, project_nr, customer, activity, round_even(SUM(hours_billed), 2) AS actual_hours,
       COUNT(employee) AS entry_count, MIN(entry_date) AS first_entry, MAX(entry_date) AS last_entry
FROM bookings {where} GROUP BY project, project_nr, customer, activity"""
SQL["d1b_compact_aggregate"] = with_ctes(ALL_BOOKINGS_CTE, body=_COMPACT_BODY.format(where=""))
SQL["c4_entitled_bookings"] = with_ctes(ALL_BOOKINGS_CTE, body=_COMPACT_BODY.format(
    where="WHERE project_nr IN (SELECT printf('P%05d', s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey "
          "WHERE n_name = 'NATION_9')"))
SQL["c4_entitled_from_parts"] = SQL["c4_entitled_bookings"]
SQL["d2_activity_dashboard"] = with_ctes(*DASH, body="SELECT * FROM dash")
SQL["d3_project_summary"] = with_ctes(*DASH, *SUMMARY_CTES, body="SELECT * FROM summary")
SQL["d4_project_header"] = with_ctes(*DASH, *SUMMARY_CTES, cte("hdr", f"""
  SELECT project_nr, project, COUNT(*) AS n_activities, {exact_sum('target_hours')} AS target_hours,
         SUM({bround('actual_hours', 1)}) AS actual_hours
  FROM dash GROUP BY project_nr, project"""), body=f"""
SELECT h.project_nr, h.project, a.customer, h.n_activities, h.target_hours, h.actual_hours,
       {fulfil('h.actual_hours', 'h.target_hours')} AS fulfillment_pct, {status('h.actual_hours', 'h.target_hours')} AS status
FROM hdr h LEFT JOIN act3 a ON h.project_nr IS NOT DISTINCT FROM a.project_nr AND h.project IS NOT DISTINCT FROM a.project""")
SQL["d5_portfolio_kpis"] = with_ctes(*DASH, cte("k", f"""
  SELECT SUM({bround('actual_hours', 1)}) AS total_hours, {exact_sum('target_hours')} AS total_target,
         COUNT(DISTINCT project_nr) AS active_projects,
         COUNT(*) FILTER (WHERE {bround('fulfillment_pct', 1)} >= 90) AS nearing_completion,
         COUNT(*) FILTER (WHERE status = '🔴 Überbucht') AS overbooked
  FROM dash"""), body=f"""
SELECT total_hours, total_target, {fulfil('total_hours', 'total_target')} AS budget_consumption_pct,
       active_projects, nearing_completion, overbooked FROM k""")
SQL["d6_forecast_kpis"] = with_ctes(*DASH, cte("k", f"""
  SELECT {exact_sum('target_hours')} AS total_target, SUM({bround('actual_hours', 1)}) AS spent_hours FROM dash"""),
    body=f"""
SELECT total_target, spent_hours, {fulfil('spent_hours', 'total_target')} AS consumption_pct,
       total_target - spent_hours AS remaining_hours,
       CASE WHEN total_target > 0 THEN (total_target - spent_hours) / total_target * 100 END AS remaining_pct
FROM k""")
SQL["d7_budget_tab_kpis"] = with_ctes(*DASH, body=f"""
SELECT {exact_sum('target_hours')} AS total_target, COUNT(*) AS n_rows FROM dash""")
SQL["d28_export_counters"] = with_ctes(BOOKINGS_CTE, cte("agg", _AGG_BODY.format(
    where="entry_date >= DATE '1999-06-30' AND entry_date <= DATE '2001-06-30'")), body="""
SELECT COUNT(*) AS rows_ready, COUNT(DISTINCT project_nr) AS n_projects, '30.06.99 - 30.06.01' AS date_range_text
FROM agg""")
SQL["d5_kpis_beside_write"] = with_ctes(*DASH, cte("k", f"""
  SELECT COUNT(*) AS n_rows, SUM({bround('actual_hours', 1)}) AS total_hours, {exact_sum('target_hours')} AS total_target,
         COUNT(DISTINCT project_nr) AS active_projects,
         COUNT(*) FILTER (WHERE {bround('fulfillment_pct', 1)} >= 90) AS nearing_completion,
         COUNT(*) FILTER (WHERE status = '🔴 Überbucht') AS overbooked
  FROM dash"""), body=f"""
SELECT *, {fulfil('total_hours', 'total_target')} AS budget_consumption_pct, total_target - total_hours AS remaining_hours,
       CASE WHEN total_target > 0 THEN (total_target - total_hours) / total_target * 100 END AS remaining_pct FROM k""")
SQL["d28_counters_beside_write"] = with_ctes(BOOKINGS_CTE, cte("agg", _AGG_BODY.format(
    where="entry_date >= DATE '1999-06-30' AND entry_date <= DATE '2001-06-30'")), body="""
SELECT COUNT(*) AS rows_ready, COUNT(DISTINCT project_nr) AS n_projects, '30.06.99 - 30.06.01' AS date_range_text,
       CAST(SUM(entry_count) AS BIGINT) AS record_count
FROM agg""")
SQL["e7_top_projects_bars"] = with_ctes(*DASH, *SUMMARY_CTES, cte("top", f"""
  SELECT project_nr, project, {bround('target_hours', 1)} AS planned, {bround('actual_hours', 1)} AS actual
  FROM summary ORDER BY project, project_nr LIMIT 5"""), cte("mx", "SELECT MAX(planned) AS m FROM top"), body="""
SELECT project_nr, project, planned, actual,
       CASE WHEN m <> 0 THEN least(planned / m * 100, 100.0) END AS planned_width_pct,
       CASE WHEN m <> 0 THEN least(actual / m * 100, 100.0) END AS actual_width_pct
FROM top, mx""")
_BADGE = [("'🟢 Buchbar'", "'On Track'", "'success'"), ("'🟡 Kritisch'", "'At Risk'", "'warning'"),
          ("'🔴 Überbucht'", "'Critical'", "'danger'")]
_badge_cond = [f"status = {s} OR contains(status, {t})" for s, t, _ in _BADGE]
SQL["h10_project_health"] = with_ctes(*DASH, *SUMMARY_CTES, body=f"""
SELECT project_nr, {ellipsize('project', 20)} AS project_short, {ellipsize('customer', 15)} AS customer_short,
       fulfillment_pct,
       CASE WHEN {_badge_cond[0]} THEN 'success' WHEN {_badge_cond[1]} THEN 'warning'
            WHEN {_badge_cond[2]} THEN 'danger' ELSE 'info' END AS badge_class,
       CASE WHEN {_badge_cond[0]} THEN 'On Track' WHEN {_badge_cond[1]} THEN 'At Risk'
            WHEN {_badge_cond[2]} THEN 'Critical' ELSE status END AS badge_text
FROM summary""")

# --- ledger -----------------------------------------------------------------
_LEDGER_COLS = ("entry_id, project_nr, activity, CAST(hours AS DOUBLE) AS hours, change_type, valid_from, "
                "reason, reference, created_by, created_at")
_SIGNED = "CASE WHEN change_type = 'reduction' THEN -hours ELSE hours END"
SQL["a6_ledger_history"] = with_ctes(LEDGER_CTE, body=f"SELECT {_LEDGER_COLS} FROM ledger")
SQL["a12_history_display"] = with_ctes(LEDGER_CTE, body=f"""
SELECT entry_id, project_nr, activity, CAST(hours AS DOUBLE) AS hours, change_type,
       CASE change_type WHEN 'initial' THEN '🆕 Initial Budget (Erstbudget)'
            WHEN 'extension' THEN '📈 Extension (Budgeterweiterung)'
            WHEN 'correction' THEN '🔧 Correction (Korrektur)'
            WHEN 'reduction' THEN '📉 Reduction (Budgetreduzierung)' ELSE change_type END AS change_type_label,
       {fmt_date('valid_from')} AS valid_from_text, reason, COALESCE(reference, '') AS reference, created_by,
       strftime(created_at, '%d.%m.%Y %H:%M') AS created_at_text
FROM ledger WHERE change_type = 'reduction'""")
SQL["d9_budgets_at_date"] = with_ctes(LEDGER_CTE, TARGETS_CTE, body="SELECT * FROM targets")
SQL["d10_current_budgets"] = with_ctes(LEDGER_CTE, body=f"""
SELECT project_nr, activity, CAST(SUM(hours) AS DOUBLE) AS total_hours, MAX(valid_from) AS last_change_date,
       MAX(created_at) AS last_updated, MAX(created_by) AS last_updated_by,
       arg_max(created_by, (created_at, entry_id)) AS last_updated_by_latest
FROM ledger WHERE valid_from <= {AS_OF_DATE} GROUP BY project_nr, activity""")
SQL["e4_latest_entries"] = with_ctes(LEDGER_CTE, body=f"""
SELECT project_nr, activity, entry_id, CAST(hours AS DOUBLE) AS hours, change_type, valid_from, reason, reference,
       created_by, created_at
FROM ledger WHERE valid_from <= {AS_OF_DATE}
QUALIFY row_number() OVER (PARTITION BY project_nr, activity
                           ORDER BY valid_from DESC, created_at DESC, entry_id DESC) = 1""")
SQL["e8_running_balance"] = with_ctes(LEDGER_CTE, body=f"""
SELECT entry_id, project_nr, activity, valid_from,
       CAST(SUM(hours) OVER w AS DOUBLE) AS balance,
       CAST(SUM({_SIGNED}) OVER w AS DOUBLE) AS balance_signed
FROM ledger
WINDOW w AS (PARTITION BY project_nr, activity ORDER BY valid_from, entry_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
SQL["c6_monthly_balances"] = with_ctes(*ALL, cte("probes", """
  SELECT DISTINCT project_nr, activity, last_day(entry_date) AS as_of_date FROM bookings"""), body="""
SELECT p.project_nr, p.activity, p.as_of_date,
       CAST(COALESCE(SUM(l.hours), 0) AS DOUBLE) AS budget_hours,
       CAST(COALESCE(SUM(CASE WHEN l.change_type = 'reduction' THEN -l.hours ELSE l.hours END), 0) AS DOUBLE)
         AS budget_hours_signed
FROM probes p LEFT JOIN ledger l
  ON l.project_nr = p.project_nr AND l.activity = p.activity AND l.valid_from <= p.as_of_date
GROUP BY p.project_nr, p.activity, p.as_of_date""")
SQL["c6_clustered_balances"] = SQL["c6_monthly_balances"]
SQL["d9_clustered_budgets"] = SQL["d9_budgets_at_date"]
_PTOTAL = "CAST(SUM(CAST(budget_hours AS DECIMAL(38,2))) OVER (PARTITION BY project_nr) AS DOUBLE)"
SQL["d11_budget_overview"] = with_ctes(LEDGER_CTE, TARGETS_CTE, body=f"""
SELECT project_nr, activity, budget_hours,
       CASE WHEN {_PTOTAL} > 0 THEN budget_hours / {_PTOTAL} * 100 ELSE 0.0 END AS share_pct
FROM targets""")
SQL["d11_budget_overview_kpis"] = with_ctes(LEDGER_CTE, TARGETS_CTE, body=f"""
SELECT COUNT(DISTINCT project_nr) AS n_projects, COUNT(*) AS n_activities, {exact_sum('budget_hours')} AS total_hours,
       round({exact_sum('budget_hours')} / COUNT(*), 6) AS avg_hours
FROM targets""")
SQL["d12_history_summary"] = with_ctes(LEDGER_CTE, body="""
SELECT project_nr, COUNT(*) AS n_entries, CAST(SUM(hours) AS DOUBLE) AS total_hours,
       COUNT(DISTINCT activity) AS n_activities
FROM ledger GROUP BY project_nr""")
SQL["d26_ledger_profile"] = with_ctes(LEDGER_CTE, body="""
SELECT COUNT(*) AS budget_entries, COUNT(DISTINCT project_nr) AS unique_projects FROM ledger""")
SQL["d27_budget_maps"] = with_ctes(LEDGER_CTE, TARGETS_CTE, body="""
SELECT project_nr, CAST(COUNT(*) OVER (PARTITION BY project_nr) AS INTEGER) AS n_budgets, activity, budget_hours
FROM targets WHERE activity IS NOT NULL""")
SQL["d8_budget_at_date"] = with_ctes(LEDGER_CTE, body=f"""
SELECT CAST(COALESCE(SUM(hours), 0) AS DOUBLE) AS budget_hours FROM ledger
WHERE project_nr = 'P00001' AND activity = 'PROMO' AND valid_from <= {AS_OF_DATE}""")
SQL["g2_ledger_activities"] = with_ctes(LEDGER_CTE, body="SELECT DISTINCT project_nr, activity FROM ledger")
SQL["j1_ledger_validation"] = with_ctes(LEDGER_CTE, cte("v", f"""
  SELECT entry_id, concat_ws(',',
           CASE WHEN {blank('project_nr')} THEN 'project_blank' END,
           CASE WHEN {blank('activity')} THEN 'activity_blank' END,
           CASE WHEN {blank('reason')} THEN 'reason_blank' END,
           CASE WHEN {blank('created_by')} THEN 'author_blank' END,
           CASE WHEN hours IS NULL OR hours <= 0 THEN 'hours_not_positive' END,
           CASE WHEN NOT COALESCE(change_type IN ('initial', 'extension', 'correction', 'reduction'), false)
                THEN 'unknown_change_type' END,
           CASE WHEN valid_from IS NULL THEN 'valid_from_missing' END) AS errors
  FROM ledger"""), body="SELECT entry_id, errors = '' AS is_valid, errors FROM v")
SQL["j3_preview_changes"] = with_ctes(LEDGER_CTE, TARGETS_CTE, cte("p", f"""
  SELECT entry_id AS proposal_id, project_nr, activity, hours,
         CAST(SUM(hours) OVER (PARTITION BY project_nr, activity ORDER BY entry_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum
  FROM ledger WHERE valid_from > {AS_OF_DATE}"""), body="""
SELECT p.proposal_id, p.project_nr, p.activity, COALESCE(t.budget_hours, 0.0) AS current_budget,
       CAST(p.hours AS DOUBLE) AS change, COALESCE(t.budget_hours, 0.0) + p.cum AS new_budget
FROM p LEFT JOIN targets t ON p.project_nr = t.project_nr AND p.activity = t.activity""")

SQL["j2_target_changes"] = with_ctes(
    BOOKINGS_CTE, LEDGER_CTE, AGG_CTE,
    cte("act", "SELECT DISTINCT project_nr, activity FROM agg"),
    cte("t0", f"SELECT project_nr, activity, CAST(SUM(hours) AS DOUBLE) AS h FROM ledger "
              f"WHERE valid_from <= {AS_OF_DATE} GROUP BY project_nr, activity"),
    cte("t1", "SELECT project_nr, activity, CAST(SUM(hours) AS DOUBLE) AS h FROM ledger "
              "WHERE valid_from <= DATE '2001-12-31' GROUP BY project_nr, activity"),
    cte("ch", """
  SELECT a.project_nr, a.activity, COALESCE(t0.h, 0.0) AS old_target, COALESCE(t1.h, 0.0) AS new_target,
         COALESCE(t1.h, 0.0) - COALESCE(t0.h, 0.0) AS delta
  FROM act a
  LEFT JOIN t0 ON a.project_nr = t0.project_nr AND a.activity = t0.activity
  LEFT JOIN t1 ON a.project_nr = t1.project_nr AND a.activity = t1.activity"""),
    body="""
SELECT project_nr, activity, old_target, new_target, 'changed' AS edit, delta,
       CASE WHEN delta > 0 THEN 'correction' ELSE 'reduction' END AS change_type
FROM ch WHERE abs(delta) > 0.01""")

# --- trends -----------------------------------------------------------------
_CUM = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
SQL["d13_daily_totals"] = with_ctes(*WHOLE, body="""
SELECT project_nr, booking_ts, SUM(hours) AS hours FROM series WHERE booking_ts IS NOT NULL
GROUP BY project_nr, booking_ts""")
SQL["e2_burndown"] = with_ctes(*WHOLE, cte("d", """
  SELECT project_nr, booking_ts, SUM(hours) AS hours FROM series WHERE booking_ts IS NOT NULL
  GROUP BY project_nr, booking_ts"""), body=f"""
SELECT project_nr, booking_ts, hours,
       SUM(hours) OVER (PARTITION BY project_nr ORDER BY booking_ts {_CUM}) AS cumulative_hours
FROM d""")
SQL["e3_activity_cumulative"] = with_ctes(*WHOLE, cte("d", """
  SELECT project_nr, activity, booking_ts, SUM(hours) AS hours FROM series WHERE booking_ts IS NOT NULL
  GROUP BY project_nr, activity, booking_ts"""), body=f"""
SELECT project_nr, activity, booking_ts, hours,
       SUM(hours) OVER (PARTITION BY project_nr, activity ORDER BY booking_ts {_CUM}) AS cumulative_hours
FROM d""")
_WEEK = "CAST(date_trunc('week', booking_ts) AS DATE)"
SQL["d14_weekly_totals"] = with_ctes(*WHOLE, body=f"""
SELECT project_nr, {_WEEK} AS week_start, SUM(hours) AS hours
FROM series WHERE booking_ts IS NOT NULL GROUP BY project_nr, {_WEEK}""")
SQL["d15_activity_weekly"] = with_ctes(*WHOLE, body=f"""
SELECT project_nr, activity, {_WEEK} AS week_start, SUM(hours) AS hours
FROM series WHERE booking_ts IS NOT NULL GROUP BY project_nr, activity, {_WEEK}""")
SQL["e5_weekly_trend"] = with_ctes(
    *WHOLE,
    cte("wk", f"""
  SELECT project_nr, {_WEEK} AS week_start, SUM(hours) AS hours
  FROM series WHERE booking_ts IS NOT NULL GROUP BY project_nr, {_WEEK}"""),
    cte("rk", "SELECT *, row_number() OVER (PARTITION BY project_nr ORDER BY week_start DESC) AS rn FROM wk"),
    body="""
SELECT project_nr, COUNT(*) AS n_weeks, round(AVG(hours), 6) AS avg_weekly_hours,
       CASE WHEN COUNT(*) >= 4 THEN round(AVG(hours) FILTER (WHERE rn <= 4), 6) END AS avg_last4_hours
FROM rk GROUP BY project_nr""")
SQL["d20_booking_rates"] = with_ctes(*RATES, body=f"""
SELECT project_nr, total_booked, n_bookings, n_recent, first_booking, last_booking, dated_hours,
       {r6('rate_4w')} AS rate_4w, {r6('rate_total')} AS rate_total FROM rates2""")
SQL["d22_simple_forecast"] = with_ctes(*RATES, body=f"""
SELECT project_nr, target_hours, total_booked, remaining_hours,
       {r6('CASE WHEN target_hours > 0 THEN remaining_hours / target_hours * 100 END')} AS remaining_pct,
       {r6('weeks_remaining')} AS weeks_remaining,
       CASE WHEN rate_4w > 0 AND remaining_hours > 0 THEN NULL WHEN remaining_hours <= 0 THEN 'Erschöpft'
            ELSE 'Keine Aktivität' END AS rate_status,
       CAST(forecast_end AS DATE) AS forecast_end_date,
       COALESCE(first_booking, {AS_OF_TS}) AS timeline_start,
       COALESCE(last_booking + INTERVAL 30 DAY, {AS_OF_TS} + INTERVAL 30 DAY) AS timeline_end
FROM fc""")
_HAS_END = "forecast_end IS NOT NULL AND target_hours > current_hours"
SQL["i15_burndown_metrics"] = with_ctes(
    *RATES,
    cte("cur", "SELECT project_nr, SUM(hours) AS current_hours FROM series WHERE booking_ts IS NOT NULL "
               "GROUP BY project_nr"),
    cte("m", """
  SELECT f.project_nr, f.target_hours, COALESCE(c.current_hours, 0.0) AS current_hours, f.forecast_end
  FROM fc f LEFT JOIN cur c ON f.project_nr = c.project_nr"""),
    body=f"""
SELECT project_nr, target_hours, current_hours, current_hours - target_hours AS delta_hours,
       {r6('CASE WHEN target_hours > 0 THEN current_hours / target_hours * 100 END')} AS fulfillment_pct,
       CASE WHEN NOT (target_hours > 0) OR target_hours IS NULL THEN 'blue'
            WHEN current_hours / target_hours * 100 <= 100 THEN 'green'
            WHEN current_hours / target_hours * 100 <= 110 THEN 'orange' ELSE 'red' END AS color,
       CASE WHEN {_HAS_END} THEN CAST(forecast_end AS DATE) END AS end_date,
       CASE WHEN {_HAS_END} THEN {floor_days(AS_OF_TS, 'forecast_end')} END AS days_left,
       CASE WHEN {_HAS_END} THEN {fmt_date('forecast_end')}
            WHEN target_hours <= current_hours THEN '⚠️ Erschöpft' ELSE 'Keine Prognose' END AS end_text
FROM m""")
SQL["i13_cumulative_with_targets"] = with_ctes(
    *WHOLE, LEDGER_CTE, TARGETS_CTE,
    cte("d", """
  SELECT project_nr, activity, booking_ts, SUM(hours) AS hours FROM series WHERE booking_ts IS NOT NULL
  GROUP BY project_nr, activity, booking_ts"""),
    cte("curve", f"""
  SELECT project_nr, activity, booking_ts AS x,
         SUM(hours) OVER (PARTITION BY project_nr, activity ORDER BY booking_ts {_CUM}) AS y,
         'cumulative' AS series
  FROM d"""),
    cte("span", """
  SELECT project_nr, activity, MIN(booking_ts) AS a, MAX(booking_ts) AS b FROM series
  WHERE booking_ts IS NOT NULL GROUP BY project_nr, activity"""),
    cte("lines", """
  SELECT s.project_nr, s.activity, unnest([s.a, s.b]) AS x, t.budget_hours AS y, 'target' AS series
  FROM span s JOIN targets t ON s.project_nr = t.project_nr AND s.activity = t.activity
  WHERE t.budget_hours > 0"""),
    body="SELECT * FROM curve UNION ALL SELECT * FROM lines")

# --- forecast ---------------------------------------------------------------
SQL["d16_sprint_table"] = with_ctes(*SPRINTS, body="SELECT * FROM sprint_table")
SQL["d17_velocity_stats"] = with_ctes(*SPRINTS, body=f"""
SELECT level, project_nr, activity, n_sprints, {r6('automatic_hours_per_sprint')} AS automatic_hours_per_sprint,
       {r6('sprint_std')} AS sprint_std, {r6('slope')} AS slope, trend, direction, trend_chrono
FROM vel2""")
_SCEN_BODY = f"""
SELECT level, project_nr, activity, scenario, label, target_hours, total_booked, future_hours, n_sprints,
       remaining_hours, {r6('base_hours_per_sprint')} AS base_hours_per_sprint,
       {r6('confidence_factor')} AS confidence_factor, {r6('hours_per_sprint')} AS hours_per_sprint,
       {r6('sprints_remaining')} AS sprints_remaining, CAST(end_ts AS DATE) AS end_date,
       CASE WHEN end_ts IS NOT NULL THEN {floor_days(AS_OF_TS, 'end_ts')} END AS days_left,
       (hours_per_sprint > 0 AND beyond) AS beyond_horizon,
       {r6('CASE WHEN target_hours > 0 THEN total_booked / target_hours * 100 ELSE 0.0 END')} AS utilisation_pct,
       {r6('least(greatest((1 - confidence_factor) * 100, 0.0), 100.0)')} AS certainty_pct
FROM scen"""
SQL["i5_forecast_scenarios"] = with_ctes(*FCST, body=_SCEN_BODY)
_OVERRIDES_CTE = cte("manual", """
  SELECT printf('P%05d', s_suppkey) AS project_nr, CAST(NULL AS VARCHAR) AS activity, CAST(s_suppkey % 50 AS DOUBLE) AS hours
  FROM supplier WHERE s_suppkey % 5 = 0
  UNION ALL
  SELECT printf('P%05d', s_suppkey), 'PROMO', CAST(s_suppkey % 9 + 1 AS DOUBLE) FROM supplier WHERE s_suppkey % 8 = 0""")
_MANUAL_UNITS = cte("units", """
  SELECT u.*, COALESCE(m.hours, automatic_hours_per_sprint) AS base_hours_per_sprint,
         CASE WHEN n_sprints >= 2 AND COALESCE(m.hours, automatic_hours_per_sprint) > 0
              THEN sprint_std / COALESCE(m.hours, automatic_hours_per_sprint) ELSE 0.2 END AS confidence_factor,
         greatest(0.0, target_hours - total_booked) AS remaining_hours
  FROM units0 u LEFT JOIN manual m ON u.project_nr = m.project_nr AND u.activity IS NOT DISTINCT FROM m.activity""")
SQL["i2_override_scenarios"] = with_ctes(*(_OVERRIDES_CTE + ",\n" + _MANUAL_UNITS if c.startswith("units AS") else c for c in FCST),
                                         body=_SCEN_BODY)
SQL["i8_trend_alerts"] = with_ctes(*FCST, body=f"""
SELECT level, project_nr, activity, trend, {r6('slope')} AS slope,
       CASE WHEN trend = 'decreasing' THEN 'warning' WHEN trend = 'increasing' THEN 'info' END AS alert_level,
       CASE WHEN trend = 'decreasing'
              THEN '⚠️ **Trend-Warnung:** Sprint-Velocity nimmt ab (' || printf('%.1f', round(slope, 1))
                   || 'h/Sprint). Team könnte überlastet sein oder auf Blocker stoßen.'
            WHEN trend = 'increasing'
              THEN '📈 **Positiver Trend:** Sprint-Velocity steigt (' || printf('%.1f', round(slope, 1))
                   || 'h/Sprint). Team wird produktiver!' END AS alert_text
FROM units WHERE target_hours > 0 AND n_bookings > 0""")
SQL["i9_sprint_details"] = with_ctes(*SPRINTS, body=f"""
SELECT level, project_nr, activity, sprint_number, hours, weight,
       CASE WHEN sprint_number > 0 THEN 'Sprint -' || CAST(sprint_number AS VARCHAR)
            ELSE 'Aktueller Sprint' END AS sprint_label,
       CASE WHEN sprint_number > 0 THEN 'Sprint -' || CAST(sprint_number AS VARCHAR) ELSE 'Aktuell' END AS chart_label,
       printf('%.1fh', hours) AS hours_text, {fmt_date('sprint_start')} AS start_text,
       {fmt_date('sprint_end')} AS end_text,
       printf('%.0f%%', weight * CAST(100 AS DOUBLE)) AS weight_text
FROM sprint_table""")
SQL["i12_velocity_series"] = with_ctes(*SPRINTS, cte("m", """
  SELECT level, project_nr, activity, sprint_number, hours,
         SUM(hours * (4 - sprint_number)) OVER u / SUM(4 - sprint_number) OVER u AS mean
  FROM sprint_table WINDOW u AS (PARTITION BY level, project_nr, activity)"""), body="""
SELECT level, project_nr, activity, sprint_number,
       CASE WHEN sprint_number > 0 THEN 'Sprint -' || CAST(sprint_number AS VARCHAR) ELSE 'Aktuell' END AS chart_label,
       unnest(['hours', 'weighted_mean']) AS series, round(unnest([hours, mean]), 6) AS y
FROM m""")
_CURVE_CTES = (
    cte("dact", """
  SELECT project_nr, activity, booking_ts, SUM(hours) AS h FROM series WHERE booking_ts IS NOT NULL
  GROUP BY project_nr, activity, booking_ts"""),
    cte("dproj", """
  SELECT project_nr, CAST(NULL AS VARCHAR) AS activity, booking_ts, SUM(hours) AS h FROM series
  WHERE booking_ts IS NOT NULL GROUP BY project_nr, booking_ts"""),
    cte("actual", f"""
  SELECT 'activity' AS level, project_nr, activity, 'actual' AS series, booking_ts AS x,
         SUM(h) OVER (PARTITION BY project_nr, activity ORDER BY booking_ts {_CUM}) AS y
  FROM dact
  UNION ALL
  SELECT 'project' AS level, project_nr, activity, 'actual' AS series, booking_ts AS x,
         SUM(h) OVER (PARTITION BY project_nr ORDER BY booking_ts {_CUM}) AS y
  FROM dproj"""),
    cte("span", """
  SELECT level, project_nr, activity, MIN(x) AS first_x, MAX(x) AS last_x, arg_max(y, x) AS cur
  FROM actual GROUP BY level, project_nr, activity"""),
    cte("sc", """
  SELECT s.*, sp.first_x, sp.last_x, sp.cur FROM scen s JOIN span sp
    ON s.level = sp.level AND s.project_nr = sp.project_nr AND s.activity IS NOT DISTINCT FROM sp.activity"""),
)
SQL["i10_scenario_series"] = with_ctes(
    *FCST, *_CURVE_CTES,
    cte("ends", """
  SELECT level, project_nr, activity, MAX(end_ts) AS maxend, ANY_VALUE(first_x) AS first_x,
         ANY_VALUE(last_x) AS last_x, ANY_VALUE(target_hours) AS t
  FROM sc GROUP BY level, project_nr, activity"""),
    cte("pts", f"""
  SELECT level, project_nr, activity, series, x, y FROM actual
  UNION ALL
  SELECT level, project_nr, activity, 'target', unnest([first_x, COALESCE(maxend, last_x)]), t FROM ends
  UNION ALL
  SELECT level, project_nr, activity, scenario, {AS_OF_TS}, COALESCE(cur, 0.0) FROM sc WHERE end_ts IS NOT NULL
  UNION ALL
  SELECT level, project_nr, activity, scenario, end_ts, target_hours FROM sc WHERE end_ts IS NOT NULL
  UNION ALL
  SELECT level, project_nr, activity, scenario || ' Ende', end_ts, target_hours FROM sc WHERE end_ts IS NOT NULL"""),
    body=f"""
SELECT level, project_nr, activity, series, CAST(x AS DATE) AS x, round(y, 6) AS y, x > {AS_OF_TS} AS only_future
FROM pts""")

SQL["i11_burndown_series"] = with_ctes(
    *FCST, *_CURVE_CTES, *RATE_CTES,
    cte("ahead", f"SELECT * FROM sc WHERE level = 'project' AND end_ts > {AS_OF_TS}"),
    cte("rest", """
  SELECT f.*, COALESCE(f.dated_hours, 0.0) AS current_hours FROM fc f
  WHERE f.forecast_end IS NOT NULL AND f.target_hours > COALESCE(f.dated_hours, 0.0)
    AND f.project_nr NOT IN (SELECT project_nr FROM ahead)"""),
    cte("pts", f"""
  SELECT project_nr, series, x, y FROM actual WHERE level = 'project'
  UNION ALL
  SELECT project_nr, scenario, unnest([{AS_OF_TS}, end_ts]), unnest([cur, target_hours]) FROM ahead
  UNION ALL
  SELECT project_nr, 'Budget-Ende (realistisch)', end_ts, target_hours FROM ahead WHERE scenario = 'realistic'
  UNION ALL
  SELECT project_nr, 'Prognose (4-Wochen-Trend)', unnest([{AS_OF_TS}, forecast_end]), unnest([current_hours, target_hours])
  FROM rest"""),
    body="SELECT project_nr, series, CAST(x AS DATE) AS x, round(y, 6) AS y FROM pts")

# --- exports and profiles ---------------------------------------------------
SQL["a13_summary_export"] = with_ctes(*DASH, body=f"""
SELECT project AS "Projekt", activity AS "Tätigkeit", {bround('target_hours', 2)} AS "Sollstunden",
       {bround('actual_hours', 2)} AS "Iststunden", {bround('fulfillment_pct', 2)} AS "Erfüllungsstand (%)",
       status AS "Status", customer AS "Kunde"
FROM dash""")
SQL["a14_detail_export"] = with_ctes(ALL_BOOKINGS_CTE, body="""
SELECT employee AS "Mitarbeiter", hours_logged AS "Stunden", project AS "Projekt", activity AS "Tätigkeit",
       status AS "Status", entry_date AS "Datum", comment AS "Kommentar", customer AS "Kunde"
FROM bookings""")
SQL["d25_dataset_profile"] = with_ctes(ALL_BOOKINGS_CTE, body="""
SELECT COUNT(*) AS time_entries_count, COUNT(DISTINCT project) AS projects, COUNT(DISTINCT activity) AS activities,
       MIN(entry_date) AS date_min, MAX(entry_date) AS date_max FROM bookings""")

"""Canonical schemas (A16) and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the dashboard's own constants for the
# results to match; they are stated here once, in natural order.
# ---------------------------------------------------------------------------

# Traffic-light status labels and thresholds (percent of target).
STATUS_NO_TARGET = "🔴 Kein Ziel"
STATUS_OK = "🟢 Buchbar"
STATUS_CRITICAL = "🟡 Kritisch"
STATUS_OVER = "🔴 Überbucht"
STATUS_OK_MAX_PCT = 100
STATUS_CRITICAL_MAX_PCT = 110

# Status badge classes and texts.
BADGE_SUCCESS = ("success", "On Track")
BADGE_WARNING = ("warning", "At Risk")
BADGE_DANGER = ("danger", "Critical")
BADGE_INFO_CLASS = "info"

# Sprint forecast constants.
SPRINT_DURATION_DAYS = 14
ANALYSIS_SPRINTS = 4
SPRINT_WEIGHTS = [0.10, 0.20, 0.30, 0.40]  # oldest to newest sprint
DEFAULT_CONFIDENCE_FACTOR = 0.2
SCENARIO_SIGMA = 1.5
MIN_PESSIMISTIC_VELOCITY = 0.1
TREND_SLOPE_THRESHOLD = 2
TARGET_CHANGE_TOLERANCE = 0.01
NEARING_COMPLETION_PCT = 90

# Scenario keys and labels.
SCENARIOS = [
    ("optimistic", "Optimistisch (90% Konfidenz)"),
    ("realistic", "Realistisch (50% Konfidenz)"),
    ("pessimistic", "Pessimistisch (10% Konfidenz)"),
]

# Ledger change types and their display labels.
CHANGE_TYPES = ["initial", "extension", "correction", "reduction"]
CHANGE_TYPE_LABELS = {
    "initial": "🆕 Initial Budget (Erstbudget)",
    "extension": "📈 Extension (Budgeterweiterung)",
    "correction": "🔧 Correction (Korrektur)",
    "reduction": "📉 Reduction (Budgetreduzierung)",
}

# Burn-down texts and colours.
BURNDOWN_EXHAUSTED = "⚠️ Erschöpft"
BURNDOWN_NO_FORECAST = "Keine Prognose"
BURNDOWN_END_MARKER = "Budget-Ende (realistisch)"
BURNDOWN_TREND_LINE = "Prognose (4-Wochen-Trend)"
RATE_EXHAUSTED = "Erschöpft"
RATE_NO_ACTIVITY = "Keine Aktivität"
CURRENT_SPRINT_LABEL = "Aktueller Sprint"
CURRENT_SPRINT_CHART_LABEL = "Aktuell"
ALL_TIME_LABEL = "All time"
NO_PROJECTS = "Keine Projekte"

# Texts of the active-filter summary.
FILTER_PERIOD_TEXT = "Zeitraum: {start} - {end}"
FILTER_LIST_LABELS = {"activities": "Tätigkeiten", "employees": "Mitarbeiter"}
FILTER_SELECTED_TEXT = "{label}: {count} ausgewählt"
FILTER_SEARCH_TEXT = "Suche: '{term}'"

# Texts of the trend alerts, around the slope.
ALERT_DECREASING = ("⚠️ **Trend-Warnung:** Sprint-Velocity nimmt ab (",
                    "h/Sprint). Team könnte überlastet sein oder auf Blocker stoßen.")
ALERT_INCREASING = ("📈 **Positiver Trend:** Sprint-Velocity steigt (", "h/Sprint). Team wird produktiver!")

# Booking status domain and the "all" option of the filters.
BOOKING_STATUSES = ["Genehmigt", "Offen", "Abgelehnt", "Entwurf"]
ALL_OPTION = "Alle"

# Measure columns a user may pick (B13); billed hours is the default.
MEASURE_COLUMNS = {"hours_billed": "FaktStd", "hours_logged": "Zeit"}
DEFAULT_MEASURE = "hours_billed"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

BOOKINGS_SCHEMA = T.StructType([
    T.StructField("employee", T.StringType(), True),
    T.StructField("hours_logged", T.DoubleType(), True),
    T.StructField("hours_billed", T.DoubleType(), True),
    T.StructField("project", T.StringType(), True),
    T.StructField("project_nr", T.StringType(), False),
    T.StructField("subproject", T.StringType(), True),
    T.StructField("cost_center", T.StringType(), True),
    T.StructField("activity", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("comment", T.StringType(), True),
    T.StructField("entry_date", T.DateType(), False),
    T.StructField("booking_ts", T.TimestampNTZType(), True),
    T.StructField("month", T.IntegerType(), True),
    T.StructField("year", T.IntegerType(), True),
    T.StructField("erp_txn_no", T.StringType(), True),
    T.StructField("customer", T.StringType(), True),
    T.StructField("project_lead", T.StringType(), True),
])

LEDGER_SCHEMA = T.StructType([
    T.StructField("entry_id", T.LongType(), False),
    T.StructField("project_nr", T.StringType(), False),
    T.StructField("activity", T.StringType(), False),
    T.StructField("hours", T.DecimalType(10, 2), False),
    T.StructField("change_type", T.StringType(), False),
    T.StructField("valid_from", T.DateType(), False),
    T.StructField("reason", T.StringType(), False),
    T.StructField("reference", T.StringType(), True),
    T.StructField("created_by", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

LEGACY_TARGET_SCHEMA = T.StructType([
    T.StructField("project", T.StringType(), True),
    T.StructField("activity", T.StringType(), True),
    T.StructField("target_hours", T.DoubleType(), True),
    T.StructField("timestamp", T.StringType(), True),
])

OVERRIDE_SCHEMA = T.StructType([
    T.StructField("project_nr", T.StringType(), True),
    T.StructField("activity", T.StringType(), True),
    T.StructField("hours_per_sprint", T.DoubleType(), True),
    T.StructField("reason", T.StringType(), True),
    T.StructField("updated_at", T.StringType(), True),
    T.StructField("updated_by", T.StringType(), True),
    T.StructField("active", T.BooleanType(), True),
])

ENTITLEMENT_SCHEMA = T.StructType([
    T.StructField("users", T.MapType(T.StringType(), T.StructType([
        T.StructField("projects", T.ArrayType(T.StringType()), True),
        T.StructField("permissions", T.ArrayType(T.StringType()), True),
    ])), True),
    T.StructField("default_permissions", T.ArrayType(T.StringType()), True),
])


def assert_schema(df, schema: T.StructType, strict_nullability: bool = False) -> None:
    """Raise if ``df`` lacks a column of ``schema`` or has another type for it."""
    actual = {f.name: f for f in df.schema.fields}
    problems = []
    for field in schema.fields:
        got = actual.get(field.name)
        if got is None:
            problems.append(f"missing column {field.name}")
        elif got.dataType != field.dataType:
            problems.append(f"{field.name}: {got.dataType.simpleString()} != {field.dataType.simpleString()}")
        elif strict_nullability and got.nullable and not field.nullable:
            problems.append(f"{field.name}: nullable")
    if problems:
        raise ValueError("schema mismatch: " + "; ".join(problems))

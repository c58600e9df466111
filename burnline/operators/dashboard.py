"""Target-versus-actual dashboards.

The whole portfolio is one plan: bookings are aggregated once (partial
aggregation before the shuffle, so a hot project is combined map-side), the
small per-key aggregate is joined to the budget balances, and project and
portfolio levels are further aggregations of that result.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalar as H
from ..sources.star import BookingStar
from .filters import Bookings, clean_code_frame, measure
from .ledger import with_project_share

KEY = ["project_nr", "activity"]


def _counted(bookings: Bookings, measure_col: str) -> DataFrame:
    """Rows to add up: bookings as groups of one, or the groups of a star."""
    hours = measure(measure_col)
    if isinstance(bookings, BookingStar):
        return bookings.reduced(hours)
    return bookings.withColumns({"actual_hours": hours, "entry_count": F.lit(1).cast("long"),
                                 "first_entry": F.col("entry_date"), "last_entry": F.col("entry_date")})


# D1 / F2 --------------------------------------------------------------------
def aggregate_bookings(bookings: Bookings, measure_col: str = S.DEFAULT_MEASURE,
                       order: bool = False) -> DataFrame:
    """Per (project, project_nr, customer, employee, activity): hours, number
    of bookings, first and last entry date. NULL keys are kept (SQL rule). A
    star is aggregated on its keys before the names are looked up."""
    rows = _counted(bookings, measure_col)
    out = (rows.groupBy("project", "project_nr", "customer", "employee", "activity")
           .agg(F.sum("actual_hours").alias("actual_hours"), F.sum("entry_count").alias("entry_count"),
                F.min("first_entry").alias("first_entry"), F.max("last_entry").alias("last_entry")))
    return out.orderBy("project", F.col("actual_hours").desc()) if order else out


# D1b ------------------------------------------------------------------------
def aggregate_bookings_compact(bookings: Bookings, measure_col: str = S.DEFAULT_MEASURE) -> DataFrame:
    """Aggregate without employee: counts non-null employees, hours rounded
    to 2 decimals (half-even)."""
    named = F.when(F.col("employee").isNotNull(), F.col("entry_count")).otherwise(0)
    return (_counted(bookings, measure_col).groupBy("project", "project_nr", "customer", "activity")
            .agg(F.bround(F.sum("actual_hours"), 2).alias("actual_hours"), F.sum(named).alias("entry_count"),
                 F.min("first_entry").alias("first_entry"), F.max("last_entry").alias("last_entry")))


# E6 -------------------------------------------------------------------------
def _top(has_employee: bool) -> Column:
    """The group's largest aggregate row (T13: hours desc, then customer, then
    employee ascending) as the least of structs in that order, which combines
    map-side and over further levels; its ``customer`` is the group's."""
    parts = [(-F.coalesce(F.col("actual_hours"), F.lit(0.0))).alias("less"), F.col("customer")]
    if has_employee:
        parts.append(F.col("employee"))
    return F.min(F.struct(*parts))


# C1 -------------------------------------------------------------------------
def join_targets(actual: DataFrame, targets: DataFrame, keys=KEY,
                 value: str = "budget_hours", out: str = "target_hours") -> DataFrame:
    """Left outer equi-join of actuals to targets; missing target = 0.0.

    ``targets`` is a per-key aggregate (one row per key), so the join never
    multiplies actual rows. Join strategy is left to AQE, which broadcasts
    the targets only when their measured size is under the threshold.
    """
    t = targets.select(*keys, F.col(value).alias("_t"), *[c for c in targets.columns if c == "share_pct"])
    joined = actual.join(t, list(keys), "left").withColumn(out, F.coalesce(F.col("_t"), F.lit(0.0))).drop("_t")
    if "share_pct" in t.columns:
        joined = joined.withColumn("share_pct", F.coalesce(F.col("share_pct"), F.lit(0.0)))
    return joined


# D2 -------------------------------------------------------------------------
def activity_dashboard(agg: DataFrame, targets: DataFrame, with_top: bool = False) -> DataFrame:
    """Per (project, activity): target, share of project target, actual,
    fulfilment %, status and customer.

    ``agg`` is the D1 aggregate (after filters), ``targets`` the budget
    balances (D9). Budgets without bookings do not appear as rows but count
    in the share denominator. ``with_top`` adds ``top``, the largest aggregate
    row, from which :func:`project_header` takes the customer.
    """
    has_employee = "employee" in agg.columns
    act = (agg.groupBy("project_nr", "project", "activity")
           .agg(F.coalesce(F.sum("actual_hours"), F.lit(0.0)).alias("actual_hours"), _top(has_employee).alias("top")))
    shares = with_project_share(targets.select(*KEY, "budget_hours"))
    out = join_targets(act, shares)
    return out.select(
        "project_nr", "project", "activity", "target_hours", "share_pct", "actual_hours",
        H.fulfillment_pct("actual_hours", "target_hours").alias("fulfillment_pct"),
        H.fulfillment_status("actual_hours", "target_hours").alias("status"),
        F.col("top.customer").alias("customer"), *(["top"] if with_top else []))


# D3 -------------------------------------------------------------------------
def project_summary(agg: DataFrame, targets: DataFrame) -> DataFrame:
    """Per project: all budgets of the project as target (booked or not),
    actual, fulfilment %, status, customer, distinct activities."""
    has_employee = "employee" in agg.columns
    act = (agg.groupBy("project_nr", "project")
           .agg(F.coalesce(F.sum("actual_hours"), F.lit(0.0)).alias("actual_hours"),
                F.countDistinct("activity").alias("n_activities"), _top(has_employee).alias("top")))
    tp = targets.groupBy("project_nr").agg(H.exact_sum("budget_hours").alias("budget_hours"))
    out = join_targets(act, tp, keys=["project_nr"])
    return out.select(
        "project_nr", "project", F.col("top.customer").alias("customer"), "target_hours", "actual_hours",
        H.fulfillment_pct("actual_hours", "target_hours").alias("fulfillment_pct"),
        H.fulfillment_status("actual_hours", "target_hours").alias("status"),
        "n_activities")


# D4 -------------------------------------------------------------------------
def project_header(dashboard: DataFrame, agg: Optional[DataFrame] = None) -> DataFrame:
    """Header metrics from the activity rows: number of activities, target
    sum, sum of the *rounded* actual column (T12), fulfilment, status. The
    customer is that of the project's largest D1 group (T13): of the activity
    rows' ``top`` (a dashboard made ``with_top``), else of ``agg``, the
    aggregate the dashboard was made from, which costs a join."""
    metrics = [F.count(F.lit(1)).alias("n_activities"), H.exact_sum("target_hours").alias("target_hours"),
               H.exact_sum(F.bround("actual_hours", 1)).alias("actual_hours")]
    if "top" in dashboard.columns:
        hdr = dashboard.groupBy("project_nr", "project").agg(*metrics, F.min("top").alias("top"))
    elif agg is None:
        raise ValueError("give a dashboard made with_top, or the aggregate it was made from")
    else:
        top = agg.groupBy(F.col("project_nr").alias("_nr"), F.col("project").alias("_name")).agg(_top("employee" in agg.columns).alias("top"))
        same = F.col("project_nr").eqNullSafe(F.col("_nr")) & F.col("project").eqNullSafe(F.col("_name"))
        hdr = dashboard.groupBy("project_nr", "project").agg(*metrics).join(top, same, "left")
    return hdr.select(
        "project_nr", "project", F.col("top.customer").alias("customer"), "n_activities", "target_hours", "actual_hours",
        H.fulfillment_pct("actual_hours", "target_hours").alias("fulfillment_pct"),
        H.fulfillment_status("actual_hours", "target_hours").alias("status"))


# D5 -------------------------------------------------------------------------
def portfolio_kpis(dashboard: DataFrame) -> DataFrame:
    """Total (rounded) hours, budget consumption %, active projects, rows with
    rounded fulfilment >= 90 (over-budget rows included), overbooked rows."""
    r = dashboard.select("project_nr", "target_hours", "status",
                         F.bround("actual_hours", 1).alias("_a"),
                         F.bround("fulfillment_pct", 1).alias("_f"))
    k = r.agg(F.sum("_a").alias("total_hours"),
              H.exact_sum("target_hours").alias("total_target"),
              F.countDistinct("project_nr").alias("active_projects"),
              F.count_if(F.col("_f") >= S.NEARING_COMPLETION_PCT).alias("nearing_completion"),
              F.count_if(F.col("status") == S.STATUS_OVER).alias("overbooked"))
    return k.select("total_hours", "total_target",
                    H.fulfillment_pct("total_hours", "total_target").alias("budget_consumption_pct"),
                    "active_projects", "nearing_completion", "overbooked")


# D5-D7, D28, B19 beside a write ----------------------------------------------
def _written(rows: DataFrame, path: str, mode: str, leave_out: Sequence[str], **metrics: Column) -> dict:
    """Write ``rows`` without the columns ``leave_out`` as Parquet; the ``metrics`` are observed by the tasks that write."""
    seen = Observation()
    named = [m.alias(name) for name, m in metrics.items()]
    rows.observe(seen, *named).drop(*leave_out).write.mode(mode).parquet(path)
    return seen.get


def write_dashboard(dashboard: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Store the activity rows as Parquet and return their KPIs (those of D5, D6 and D7) in one row. The plan runs
    once, for the write, and the KPIs are observed on the rows that are written. Distinct projects are counted as
    first rows of a project, which has no more rows than activities."""
    first = F.row_number().over(Window.partitionBy("project_nr").orderBy("project", "activity")) == 1
    rows = dashboard.withColumn("_first", first & F.col("project_nr").isNotNull())
    hours = F.bround("actual_hours", 1)
    got = _written(
        rows, path, mode, ["_first"], n_rows=F.count(F.lit(1)), total_hours=F.sum(hours), total_target=H.exact_sum("target_hours"),
        active_projects=F.sum(F.col("_first").cast("bigint")),
        nearing_completion=F.sum((F.bround("fulfillment_pct", 1) >= S.NEARING_COMPLETION_PCT).cast("bigint")),
        overbooked=F.sum((F.col("status") == S.STATUS_OVER).cast("bigint")))
    counts = ("active_projects", "nearing_completion", "overbooked")
    k = dashboard.sparkSession.createDataFrame(
        [(got["n_rows"], got["total_hours"], got["total_target"], *(got[c] or 0 for c in counts))],
        "n_rows long, total_hours double, total_target double, active_projects long, nearing_completion long, overbooked long")
    remaining = F.col("total_target") - F.col("total_hours")
    return k.select("n_rows", "total_hours", "total_target",
                    H.fulfillment_pct("total_hours", "total_target").alias("budget_consumption_pct"), *counts,
                    remaining.alias("remaining_hours"),
                    F.when(F.col("total_target") > 0, remaining / F.col("total_target") * 100).alias("remaining_pct"))


def write_aggregate(agg: DataFrame, path: str, start_date=None, end_date=None, mode: str = "overwrite") -> DataFrame:
    """Store the filtered aggregate as Parquet and return its counters (D28) and the number of bookings in it
    (B19's ``record_count``): the plan runs once. Rows are counted as they are written; projects afterwards, from that
    column of the stored rows."""
    got = _written(agg, path, mode, [], rows_ready=F.count(F.lit(1)), record_count=F.sum("entry_count"))
    stored = agg.sparkSession.read.schema(agg.schema).parquet(path)
    return stored.agg(F.countDistinct("project_nr").alias("n_projects")).select(
        F.lit(int(got["rows_ready"])).cast("bigint").alias("rows_ready"), "n_projects", F.lit(_range_text(start_date, end_date)).alias("date_range_text"),
        F.lit(int(got["record_count"] or 0)).cast("bigint").alias("record_count"))


def _range_text(start_date, end_date) -> str:
    if start_date is not None and end_date is not None:
        return f"{start_date.strftime('%d.%m.%y')} - {end_date.strftime('%d.%m.%y')}"
    return S.ALL_TIME_LABEL


# D6 -------------------------------------------------------------------------
def forecast_kpis(dashboard: DataFrame) -> DataFrame:
    """Total budget, spent (rounded) hours, consumption %, remaining, remaining %."""
    k = dashboard.agg(H.exact_sum("target_hours").alias("total_target"),
                      F.sum(F.bround("actual_hours", 1)).alias("spent_hours"))
    remaining = F.col("total_target") - F.col("spent_hours")
    return k.select("total_target", "spent_hours",
                    H.fulfillment_pct("spent_hours", "total_target").alias("consumption_pct"),
                    remaining.alias("remaining_hours"),
                    F.when(F.col("total_target") > 0, remaining / F.col("total_target") * 100)
                    .alias("remaining_pct"))


# D7 -------------------------------------------------------------------------
def budget_tab_kpis(dashboard: DataFrame) -> DataFrame:
    return dashboard.agg(H.exact_sum("target_hours").alias("total_target"),
                         F.count(F.lit(1)).alias("n_rows"))


# D28 ------------------------------------------------------------------------
def export_counters(agg: DataFrame, start_date=None, end_date=None, selected: Optional[DataFrame] = None) -> DataFrame:
    """Rows of the filtered aggregate ready for export, number of projects
    (of the selection, if one was made, else of the rows), date-range text."""
    text = _range_text(start_date, end_date)
    counted = agg.agg(F.count(F.lit(1)).alias("rows_ready"), F.countDistinct("project_nr").alias("n_projects"))
    if selected is not None:  # one row beside one row
        chosen = clean_code_frame(selected).agg(F.count(F.lit(1)).alias("n_projects"))
        counted = counted.select("rows_ready", F.lit(1).alias("_one")).join(chosen.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return counted.withColumn("date_range_text", F.lit(text))


# F5 / E7 --------------------------------------------------------------------
def top_projects_bars(summary: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` projects of the summary in its order (by project name, not
    by hours) with bar widths relative to the largest planned value among
    them, capped at 100; NULL when that maximum is 0. The limit is the
    feature here; the window runs on those ``n`` rows only."""
    top = (summary.select("project_nr", "project",
                          F.bround("target_hours", 1).alias("planned"),
                          F.bround("actual_hours", 1).alias("actual"))
           .orderBy("project", "project_nr").limit(n))
    mx = F.max("planned").over(Window.partitionBy())
    width = lambda c: F.when(mx != 0, F.least(F.col(c) / mx * 100, F.lit(100.0)))
    return top.select("project_nr", "project", "planned", "actual",
                      width("planned").alias("planned_width_pct"),
                      width("actual").alias("actual_width_pct"))


# H10 on the summary --------------------------------------------------------
def project_health(summary: DataFrame) -> DataFrame:
    """Health table rows: truncated names, fulfilment, badge class/text."""
    return summary.select("project_nr",
                          H.ellipsize("project", 20).alias("project_short"),
                          H.ellipsize("customer", 15).alias("customer_short"),
                          "fulfillment_pct",
                          H.badge_class("status").alias("badge_class"),
                          H.badge_text("status").alias("badge_text"))

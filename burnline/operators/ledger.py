"""Budget ledger operators: balances as of dates, history, validation and
append (A6, A7, C5, C6, D8-D12, D26, D27, E4, E8, G2, G3, J1, J3, J4).

The ledger is append-only; a balance is the sum of entries whose
``valid_from`` is on or before the date. All per-key work is either a
partial (map-side) aggregation or a window over rows already reduced to one
per (key, day) or per block of ids, so a key holding a third of all
entries is pre-aggregated before it is shuffled and never forms one
unbounded window partition.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from functools import reduce
from typing import Optional

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalar as H
from ..session import cut_lineage
from .filters import ProjectList, filter_projects, history_filter, valid_at

KEY = ["project_nr", "activity"]


def signed_hours(col: str = "hours") -> Column:
    """Hours with reductions counted negative (T2: the literal sum adds them)."""
    return F.when(F.col("change_type") == "reduction", -F.col(col)).otherwise(F.col(col))


def _date(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


# A6 / G3 / F4 ---------------------------------------------------------------
def history(ledger: DataFrame, projects: ProjectList = None, activity: Optional[str] = None,
            order: bool = True) -> DataFrame:
    """Full history of the projects (one scan for the whole list), optionally
    for one activity; newest valid date first, then newest creation."""
    out = filter_projects(ledger, projects)
    if activity:
        out = out.filter(F.col("activity") == F.lit(activity))
    if not order:
        return out
    keys = [] if activity else [F.col("activity")]
    return out.orderBy(*keys, F.col("project_nr"), F.col("valid_from").desc(),
                       F.col("created_at").desc(), F.col("entry_id").desc())


# D8 -------------------------------------------------------------------------
def budget_at(ledger: DataFrame, project_nr: str, activity: str, date) -> DataFrame:
    """One row: balance of one key at ``date``, 0 if nothing is valid."""
    return (ledger.filter((F.col("project_nr") == project_nr) & (F.col("activity") == activity)
                          & valid_at(_date(date)))
            .agg(F.coalesce(F.sum("hours"), F.lit(0)).cast("double").alias("budget_hours")))


# D9 -------------------------------------------------------------------------
def budgets_at(ledger: DataFrame, date, projects: ProjectList = None) -> DataFrame:
    """Balance of every (project_nr, activity) at ``date``.

    ``budget_hours`` is the literal sum (reductions add, T2);
    ``budget_hours_signed`` counts reductions negative. DECIMAL sums are
    exact and cast to DOUBLE once, after aggregation.
    """
    valid = filter_projects(ledger, projects).filter(valid_at(_date(date)))
    return (valid.groupBy(*KEY)
            .agg(F.sum("hours").cast("double").alias("budget_hours"),
                 F.sum(signed_hours()).cast("double").alias("budget_hours_signed")))


def budgets_at_dates_wide(ledger: DataFrame, dates: dict) -> DataFrame:
    """Balances of every key at several dates in one pass: one column per
    ``{name: date}`` (literal sums, exact as DECIMAL, then DOUBLE)."""
    cols = [F.coalesce(F.sum(F.when(valid_at(_date(d)), F.col("hours"))), F.lit(0))
            .cast("double").alias(name) for name, d in dates.items()]
    return ledger.groupBy(*KEY).agg(*cols)


# D10 / E4 -------------------------------------------------------------------
def current_budgets(ledger: DataFrame, date) -> DataFrame:
    """Current-budget view at ``date``: balance, last change date, last
    creation time, ``MAX(created_by)`` as written (alphabetical, T16) and the
    author of the latest entry next to it."""
    valid = ledger.filter(valid_at(_date(date)))
    order = F.struct("created_at", "entry_id")
    return (valid.groupBy(*KEY)
            .agg(F.sum("hours").cast("double").alias("total_hours"),
                 F.max("valid_from").alias("last_change_date"),
                 F.max("created_at").alias("last_updated"),
                 F.max("created_by").alias("last_updated_by"),
                 F.max_by("created_by", order).alias("last_updated_by_latest")))


def latest_entries(ledger: DataFrame, date=None) -> DataFrame:
    """The latest valid entry per key (valid_from desc, created_at desc,
    entry_id desc). Computed as a ``max_by`` aggregate, which is combined
    map-side, instead of a row_number window over an unbounded partition."""
    valid = ledger if date is None else ledger.filter(valid_at(_date(date)))
    cols = [c for c in ledger.columns if c not in KEY]
    order = F.struct(F.col("valid_from"), F.col("created_at"), F.col("entry_id"))
    picked = valid.groupBy(*KEY).agg(F.max_by(F.struct(*cols), order).alias("_e"))
    return picked.select(*KEY, *[F.col("_e." + c).alias(c) for c in cols])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list, how: str = "inner") -> DataFrame:
    """Join on ``keys``, of which NULL is a value like any other. Still an equi-join."""
    named = right.withColumnsRenamed({k: "_r_" + k for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col("_r_" + k)) for k in keys))
    return left.join(named, same, how).drop(*("_r_" + k for k in keys))


# Running sums with bounded windows ----------------------------------
def blocked_running_sum(df: DataFrame, keys: list, order_col: str, values: dict, block: int = 1024) -> DataFrame:
    """Running sums of ``values`` ({output name: column}) per ``keys`` in the
    order of the unique integer ``order_col``, with every window bounded:
    totals of super-blocks (``block``^2 consecutive ids) are cumulated per
    key, totals of blocks (``block`` ids) within one super-block, and the
    rows of one block on top -- at most ``block`` rows per window below the
    top level, and the top level has one row per million ids of a key."""
    keys = list(keys)
    sup = F.floor(F.col(order_col) / F.lit(block * block))
    blk = F.floor(F.col(order_col) / F.lit(block))
    d = df.withColumn("_sup", sup).withColumn("_blk", blk)
    before = Window.unboundedPreceding

    def prefix(level_keys, order, tag):
        tot = d.groupBy(*level_keys, order).agg(*[F.sum(v).alias("_t_" + k) for k, v in values.items()])
        w = Window.partitionBy(*level_keys).orderBy(order).rowsBetween(before, -1)
        return tot.select(*level_keys, order, *[F.coalesce(F.sum("_t_" + k).over(w), F.lit(0)).alias(tag + k)
                                                for k in values])

    out = null_safe_join(d, prefix(keys, "_sup", "_ps_"), keys + ["_sup"])
    out = null_safe_join(out, prefix(keys + ["_sup"], "_blk", "_pb_"), keys + ["_sup", "_blk"])
    w_in = Window.partitionBy(*keys, "_blk").orderBy(order_col).rowsBetween(before, Window.currentRow)
    for k, v in values.items():
        out = out.withColumn(k, F.col("_ps_" + k) + F.col("_pb_" + k) + F.sum(v).over(w_in))
    return out.drop("_sup", "_blk", *["_ps_" + k for k in values], *["_pb_" + k for k in values])


def running_balance(ledger: DataFrame, block: int = 1024) -> DataFrame:
    """Balance after each entry, in (valid_from, entry_id) order per key.

    Every window is bounded, however many entries one key has: day totals
    per key are cumulated over one row per day, and entries within a
    (key, day) use :func:`blocked_running_sum` (super-blocks and blocks of
    entry ids).
    """
    signed = signed_hours()
    day = ledger.groupBy(*KEY, "valid_from").agg(F.sum("hours").alias("_d"), F.sum(signed).alias("_ds"))
    w_day = Window.partitionBy(*KEY).orderBy("valid_from").rowsBetween(Window.unboundedPreceding, -1)
    day = day.select(*KEY, "valid_from", F.coalesce(F.sum("_d").over(w_day), F.lit(0)).alias("_p1"),
                     F.coalesce(F.sum("_ds").over(w_day), F.lit(0)).alias("_p1s"))
    within = blocked_running_sum(ledger, KEY + ["valid_from"], "entry_id",
                                 {"_r": F.col("hours"), "_rs": signed}, block)
    out = (null_safe_join(within, day, KEY + ["valid_from"])
           .withColumn("balance", (F.col("_p1") + F.col("_r")).cast("double"))
           .withColumn("balance_signed", (F.col("_p1s") + F.col("_rs")).cast("double")))
    return out.drop("_p1", "_p1s", "_r", "_rs")


# C6 -------------------------------------------------------------------------
def balances_at_dates(ledger: DataFrame, probes: DataFrame, date_col: str = "as_of_date") -> DataFrame:
    """As-of lookup: the balance of each probe (project_nr, activity, date).

    No cross join: ledger day totals and probe dates are unioned per key and
    a running sum is taken in date order (entries of a day before probes of
    the same day, since ``valid_from <= date`` counts). Probes of keys without
    ledger entries get 0.
    """
    return balances_of_days(ledger_days(ledger), probes, date_col)


def ledger_days(ledger: DataFrame) -> DataFrame:
    """The day totals of a ledger, one row per key and ``valid_from``: literal and signed sums, exact as DECIMAL and
    never NULL. A key has no more of them than days, however many entries."""
    def total(hours: Column) -> Column:
        return F.coalesce(F.sum(hours), F.lit(0))
    return ledger.groupBy(*KEY, "valid_from").agg(total(F.col("hours")).alias("hours"), total(signed_hours()).alias("hours_signed"))


def budgets_of_days(days: DataFrame, date) -> DataFrame:
    """:func:`budgets_at` from :func:`ledger_days`."""
    return (days.filter(valid_at(_date(date))).groupBy(*KEY)
            .agg(F.sum("hours").cast("double").alias("budget_hours"), F.sum("hours_signed").cast("double").alias("budget_hours_signed")))


def balances_of_days(days: DataFrame, probes: DataFrame, date_col: str = "as_of_date") -> DataFrame:
    """:func:`balances_at_dates` from :func:`ledger_days`. Where both are stored clustered by key
    (``sources.clustered``), nothing is shuffled: the union keeps the buckets, as the day totals go in as
    they are stored, and the probes are told by their NULL hours."""
    hours = ("hours", "hours_signed")
    totals = days.select(*KEY, "valid_from", *hours)
    asks = probes.select(*KEY, F.col(date_col).cast("date").alias("valid_from")).distinct()
    asks = asks.select(*KEY, "valid_from", *(F.lit(None).cast(days.schema[c].dataType).alias(c) for c in hours))
    # ordered by plain columns: a computed one would be a projection below the union, which loses the buckets
    w = (Window.partitionBy(*KEY).orderBy(F.col("valid_from"), F.col("hours").asc_nulls_last())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = totals.union(asks).select("*", *(F.sum(c).over(w).alias("_" + c) for c in hours)).filter(F.col("hours").isNull())
    return both.select(*KEY, F.col("valid_from").alias(date_col),
                       *(F.coalesce("_" + c, F.lit(0)).cast("double").alias("budget_" + c) for c in hours))


# D11 / E1 -------------------------------------------------------------------
def with_project_share(targets: DataFrame, value: str = "budget_hours", out: str = "share_pct",
                       scale: int = 2) -> DataFrame:
    """Share of the project's total (all budgets of the project, booked
    or not); 0 if the total is 0. The window runs on budget rows (one per
    activity), not on bookings. Budgets carry ``scale`` decimals, so the
    total is summed exactly as DECIMAL and does not depend on row order."""
    exact = F.col(value).cast(f"decimal(38,{scale})")
    total = F.sum(exact).over(Window.partitionBy("project_nr")).cast("double")
    return targets.withColumn(out, H.share_pct(F.col(value), total))


def budget_overview(ledger: DataFrame, date, projects: ProjectList = None) -> DataFrame:
    """Per (project, activity): budget at ``date`` and share of project."""
    return with_project_share(budgets_at(ledger, date, projects).drop("budget_hours_signed"))


def order_overview(overview: DataFrame) -> DataFrame:
    """overview ordered by project (then activity)."""
    return overview.orderBy("project_nr", "activity")


def budget_overview_kpis(overview: DataFrame) -> DataFrame:
    """Projects with budget, activities, total hours, mean hours per activity."""
    return overview.agg(F.countDistinct("project_nr").alias("n_projects"),
                        F.count(F.lit(1)).alias("n_activities"),
                        H.exact_sum("budget_hours").alias("total_hours")) \
        .withColumn("avg_hours", F.try_divide(F.col("total_hours"), F.col("n_activities")))


# D12 ------------------------------------------------------------------------
def history_summary(ledger: DataFrame, projects: ProjectList = None) -> DataFrame:
    """Entries, total hours, distinct activities per project (before the
    history view's activity / change-type filters)."""
    return (filter_projects(ledger, projects).groupBy("project_nr")
            .agg(F.count(F.lit(1)).alias("n_entries"),
                 F.sum("hours").cast("double").alias("total_hours"),
                 F.countDistinct("activity").alias("n_activities")))


# History display --------------------------------------
def history_display(ledger: DataFrame, projects: ProjectList = None, activity: Optional[str] = None,
                    change_type: Optional[str] = None) -> DataFrame:
    """History rows with display columns: label, dd.MM.yyyy dates."""
    rows = history_filter(filter_projects(ledger, projects), activity, change_type)
    return rows.select(
        "entry_id", "project_nr", "activity", F.col("hours").cast("double").alias("hours"),
        "change_type", H.change_type_label("change_type").alias("change_type_label"),
        H.fmt_date("valid_from").alias("valid_from_text"), "reason",
        F.coalesce(F.col("reference"), F.lit("")).alias("reference"), "created_by",
        H.fmt_datetime("created_at").alias("created_at_text"))


# D26 ------------------------------------------------------------------------
def ledger_profile(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count(F.lit(1)).alias("budget_entries"),
                      F.countDistinct("project_nr").alias("unique_projects"))


# D27 ------------------------------------------------------------------------
def budget_maps(targets: DataFrame, value: str = "budget_hours") -> DataFrame:
    """One row per project with ``map<activity, hours>`` (the nested
    dictionary view, kept one row per project)."""
    return (targets.filter(F.col("activity").isNotNull())
            .groupBy("project_nr")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("activity", value))))
                 .alias("budgets")))


# G2 -------------------------------------------------------------------------
def ledger_activities(ledger: DataFrame, projects: ProjectList = None) -> DataFrame:
    """Distinct activities with ledger entries per project, ordered."""
    return (filter_projects(ledger, projects).select("project_nr", "activity").distinct()
            .orderBy("project_nr", "activity"))


# J1 -------------------------------------------------------------------------
def validate_entries(proposals: DataFrame, form_rules: bool = True) -> DataFrame:
    """Adds ``errors`` (array of failed rule names) and ``is_valid``.

    Rules: project, activity, reason and author non-blank; hours present, in
    the range of the stored DECIMAL(10,2) and, rounded to it, > 0 (form) or
    >= 0 (table CHECK); known change type; valid_from present.
    """
    stored = F.round(F.col("hours").try_cast("decimal(38,6)"), 2).try_cast("decimal(10,2)")
    hours_bad = F.col("hours").isNull() | ((stored <= 0) if form_rules else (stored < 0))
    author = F.col("created_by") if "created_by" in proposals.columns else F.lit(None).cast("string")
    checks = [
        ("project_blank", H.is_blank("project_nr")),
        ("activity_blank", H.is_blank("activity")),
        ("reason_blank", H.is_blank("reason")),
        ("author_blank", H.is_blank(author)),
        ("hours_not_positive" if form_rules else "hours_negative", hours_bad),
        ("hours_out_of_range", F.col("hours").isNotNull() & stored.isNull()),
        ("unknown_change_type", ~F.coalesce(F.col("change_type").isin(S.CHANGE_TYPES), F.lit(False))),
        ("valid_from_missing", F.col("valid_from").isNull()),
    ]
    errors = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))
    return proposals.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


# A7 -------------------------------------------------------------------------
def _shaped(valid: DataFrame, created_at, entry_id: Column) -> DataFrame:
    """Validated proposals as ledger rows: trimmed text, empty reference -> NULL, ``created_at`` from the explicit timestamp."""
    created = created_at if isinstance(created_at, Column) else F.lit(created_at).cast("timestamp_ntz")
    return valid.select(
        entry_id.cast("bigint").alias("entry_id"), F.trim("project_nr").alias("project_nr"), F.trim("activity").alias("activity"),
        F.round(F.col("hours").cast("decimal(38,6)"), 2).cast("decimal(10,2)").alias("hours"), "change_type",
        F.col("valid_from").cast("date").alias("valid_from"), F.trim("reason").alias("reason"),
        F.nullif(F.trim(F.col("reference")), F.lit("")).alias("reference"),
        F.trim("created_by").alias("created_by"), created.alias("created_at"))


def dense_ids(rows: DataFrame, name: str = "entry_id") -> tuple[DataFrame, int]:
    """``rows`` numbered from 1 without a gap, and their number. Two passes and no window over all
    rows: the rows, checkpointed, keep their place in their partition, and each partition
    begins after the rows of those before it."""
    place = F.monotonically_increasing_id()
    kept = cut_lineage(rows.withColumns({"_part": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))  # one row per partition
    starts = counts.withColumn("_before", F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows"))
    total = int(counts.agg(F.sum("_rows")).first()[0] or 0)
    numbered = kept.join(starts.select("_part", "_before"), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1)
    return numbered.drop("_part", "_place", "_before"), total


def prepare_append(valid: DataFrame, existing: Optional[DataFrame], created_at) -> DataFrame:
    """Shape validated proposals as ledger rows, with dense ids above the maximum of ``existing``."""
    # a single scalar (the current max id) comes back to the driver
    base = (existing.agg(F.max("entry_id")).first()[0] or 0) if existing is not None else 0
    numbered, _ = dense_ids(valid.drop("entry_id"), "entry_id")
    return _shaped(numbered, created_at, F.col("entry_id") + F.lit(int(base)))


def append_entries(proposals: DataFrame, ledger_path: str, created_at) -> DataFrame:
    """Validate, append the valid rows to the ledger folder, return rejects.

    Ids are dense, also with several writers at once: the rows are written with
    numbers of their own batch, which readers do not take yet; then the batch
    is committed, and its commit claims the ids after those of the last one
    (:mod:`burnline.sources.store`). A writer that dies before leaves no gap.
    """
    from ..sources import files, store
    spark = proposals.sparkSession
    checked = validate_entries(proposals, form_rules=True)
    good, total = dense_ids(checked.filter("is_valid").drop("errors", "is_valid", "entry_id"))
    if total:
        batch = uuid.uuid4().hex
        store.append_files(_shaped(good, created_at, F.col("entry_id")).withColumn("batch", F.lit(batch)), ledger_path)

        def claim(last: Optional[dict]) -> dict:
            if last is not None:
                return {"batch": batch, "first_id": last["first_id"] + last["rows"], "rows": total}
            # the first commit: after the rows that were stored without one
            stored = files.read_ledger(spark, ledger_path).agg(F.max("entry_id")).first()[0] or 0
            return {"batch": batch, "first_id": int(stored) + 1, "rows": total}

        store.commit(spark, ledger_path, store.APPEND, claim)
    return checked.filter(~F.col("is_valid"))


# J3 -------------------------------------------------------------------------
def preview_changes(ledger: DataFrame, proposals: DataFrame, date) -> DataFrame:
    """What-if: balance today, change, new balance. Several proposals for one
    key stack in ``proposal_id`` order (a unique integer id)."""
    current = budgets_at(ledger, date).select(*KEY, F.col("budget_hours").alias("current_budget"))
    p = blocked_running_sum(proposals, KEY, "proposal_id", {"_cum": F.col("hours").cast("decimal(38,2)")}) \
        .withColumn("_cum", F.col("_cum").cast("double"))
    return (null_safe_join(p, current, KEY, "left")
            .select("proposal_id", *KEY,
                    F.coalesce("current_budget", F.lit(0.0)).alias("current_budget"),
                    F.col("hours").cast("double").alias("change"),
                    (F.coalesce("current_budget", F.lit(0.0)) + F.col("_cum")).alias("new_budget")))


# J4 -------------------------------------------------------------------------
def migrate_legacy_targets(latest_targets: DataFrame, valid_from: _dt.date,
                           created_by: str = "migration") -> DataFrame:
    """Legacy target rows -> 'initial' ledger proposals (then J1 + A7)."""
    return latest_targets.select(
        F.col("project").alias("project_nr"), "activity",
        F.col("target_hours").alias("hours"), F.lit("initial").alias("change_type"),
        F.lit(valid_from).cast("date").alias("valid_from"),
        F.lit("Migration from legacy target files").alias("reason"),
        F.lit(None).cast("string").alias("reference"), F.lit(created_by).alias("created_by"))

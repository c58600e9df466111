"""Bookings and budget ledger derived from the driver's star schema.

The driver data has no time-booking table, so both inputs are derived by
joins (one row per line item for bookings, one ledger entry per first order
line). The derivations are plain joins and projections: every join is an
equi-join left to Catalyst/AQE; only ``nation`` (fixed 25 rows) is hinted
as a broadcast, and the orders of the series' derivation as the hashed side.
Only the orders join filters (``until``, if given); the other lookups are
left joins on primary keys. The booking *series* has its own
derivation with only the joins it needs (orders for the cut, part for the
activity). ``supplier``, ``part`` and ``customer`` all grow with the
scale factor, so they are joined without a hint and AQE switches a join to
broadcast at runtime only when the measured side is below
``spark.sql.autoBroadcastJoinThreshold``; a skewed supplier key is split by
AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .star import BookingStar, Lookup
from .tables import table, ts_ntz

# Fixed derivation rules (stated together; the oracle SQL mirrors them).
PROJECT_NR_FORMAT = "P%05d"
COST_CENTER_FORMAT = "CC%02d"
CREATED_BY_FORMAT = "user%02d@example.com"
LEDGER_HOURS_DIVISOR_CENTS = 14.0  # hours = floor(totalprice / 1400, 2 decimals)
PRIORITY_TO_CHANGE_TYPE = {"1": "initial", "2": "extension", "3": "correction",
                           "4": "reduction", "5": "extension"}
NO_TARGET_ACTIVITY = "LARGE"  # dropped from the ledger for suppliers with key % 7 = 0


def _padded(prefix: str, col, width: int, fmt: str):
    """prefix + zero-padded number, as ``format_string(fmt, col)`` but with
    codegen'd string functions on the common path (0 <= value < 10^width)."""
    fast = F.concat(F.lit(prefix), F.lpad(col.cast("string"), width, "0"))
    return (F.when((col >= 0) & (col < 10 ** width), fast)
            .when(col.isNotNull(), F.format_string(fmt, col)))


def project_nr(col) -> "F.Column":
    return _padded("P", col, 5, PROJECT_NR_FORMAT)


def bookings(spark: SparkSession, sf_dir: str, until=None) -> DataFrame:
    """One booking per line item (canonical bookings schema).

    ``entry_date`` (work date) is the order date, ``booking_ts`` (posting date)
    the ship date. With ``until`` only bookings whose entry date is on or
    before it are kept; the predicate reaches the ``orders`` scan.
    """
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
               "l_linestatus", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    if until is not None:
        orders = orders.filter(F.col("o_orderdate") <= ts_ntz(until))
    # Dimension lookups are left joins on the dimensions' primary keys: a
    # booking is never dropped for a missing dimension row.
    supplier = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    nation = F.broadcast(table(spark, sf_dir, "nation", "n_nationkey", "n_name"))
    part = table(spark, sf_dir, "part", "p_partkey", "p_type")
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_name")

    # customer is looked up on the orders (a quarter of the line items)
    # before they meet lineitem, so line-item rows are never shuffled by it
    orders = orders.join(customer, F.col("o_custkey") == customer.c_custkey, "left")
    joined = (li.join(orders, li.l_orderkey == orders.o_orderkey)
              .join(supplier, F.col("l_suppkey") == supplier.s_suppkey, "left")
              .join(nation, F.col("s_nationkey") == nation.n_nationkey, "left")
              .join(part, F.col("l_partkey") == part.p_partkey, "left"))
    hours_logged = (F.col("l_quantity").cast("decimal(12,2)")
                    * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast("double")
    entry_date = F.col("o_orderdate").cast("date")
    return joined.select(
        F.col("c_name").alias("employee"),
        hours_logged.alias("hours_logged"),
        F.col("l_quantity").cast("double").alias("hours_billed"),
        F.col("s_name").alias("project"),
        project_nr(F.col("l_suppkey")).alias("project_nr"),
        F.col("l_linestatus").alias("subproject"),
        _padded("CC", F.col("s_nationkey"), 2, COST_CENTER_FORMAT).alias("cost_center"),
        F.col("p_type").alias("activity"),
        F.col("l_returnflag").alias("status"),
        F.lit(None).cast("string").alias("comment"),
        entry_date.alias("entry_date"),
        F.col("l_shipdate").alias("booking_ts"),
        F.month(entry_date).alias("month"),
        F.year(entry_date).alias("year"),
        F.col("l_orderkey").cast("string").alias("erp_txn_no"),
        F.col("n_name").alias("customer"),
        F.lit(None).cast("string").alias("project_lead"),
    )


def booking_star(spark: SparkSession, sf_dir: str, until=None) -> BookingStar:
    """The bookings of :func:`bookings` as a star: order lines joined with the orders only, and the
    names of projects (suppliers, with their nation), activities (parts) and employees (customers) beside."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "l_quantity",
               "l_discount", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    if until is not None:
        orders = orders.filter(F.col("o_orderdate") <= ts_ntz(until))
    entry_date = F.col("o_orderdate").cast("date")
    hours_logged = (F.col("l_quantity").cast("decimal(12,2)")
                    * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast("double")
    facts = li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        F.col("l_suppkey").alias("project_key"), F.col("l_partkey").alias("activity_key"), F.col("o_custkey").alias("employee_key"),
        hours_logged.alias("hours_logged"), F.col("l_quantity").cast("double").alias("hours_billed"),
        F.col("l_linestatus").alias("subproject"), F.col("l_returnflag").alias("status"), entry_date.alias("entry_date"),
        F.col("l_shipdate").alias("booking_ts"), F.month(entry_date).alias("month"), F.year(entry_date).alias("year"),
        F.col("l_orderkey").cast("string").alias("erp_txn_no"))
    nation = F.broadcast(table(spark, sf_dir, "nation", "n_nationkey", "n_name"))  # 25 rows
    supplier = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    supplier = supplier.join(nation, F.col("s_nationkey") == nation.n_nationkey, "left")
    return BookingStar(facts, [
        Lookup("project_key", supplier, "s_suppkey", {"project": F.col("s_name"), "customer": F.col("n_name")},
               {"project_nr": project_nr(F.col("project_key"))}),
        Lookup("activity_key", table(spark, sf_dir, "part", "p_partkey", "p_type"), "p_partkey", {"activity": F.col("p_type")}),
        Lookup("employee_key", table(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_custkey", {"employee": F.col("c_name")})])


def booking_events(spark: SparkSession, sf_dir: str, until=None) -> DataFrame:
    """The columns the time series needs -- project_nr, activity,
    booking_ts, entry_date and both measures -- without the name lookups.

    The orders are hashed (they are few beside the order lines, and a task holds
    only those of its keys), so that the lines are not sorted in the task
    that sums up the series: both at once took the most memory of the forecasts."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
               "l_quantity", "l_discount", "l_shipdate")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    if until is not None:
        orders = orders.filter(F.col("o_orderdate") <= ts_ntz(until))
    part = table(spark, sf_dir, "part", "p_partkey", "p_type")
    joined = (li.join(orders.hint("shuffle_hash"), li.l_orderkey == orders.o_orderkey)
              .join(part, F.col("l_partkey") == part.p_partkey, "left"))
    hours_logged = (F.col("l_quantity").cast("decimal(12,2)")
                    * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast("double")
    return joined.select(
        project_nr(F.col("l_suppkey")).alias("project_nr"),
        F.col("p_type").alias("activity"),
        F.col("l_shipdate").alias("booking_ts"),
        F.col("o_orderdate").cast("date").alias("entry_date"),
        F.col("l_quantity").cast("double").alias("hours_billed"),
        hours_logged.alias("hours_logged"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget ledger: one entry per first order line (canonical ledger schema).

    ``entry_id`` = order key * 100 + position of the line among the order's
    first lines (by part, supplier), numbered before the rule that drops
    some budgets (so ids have gaps). The window is partitioned by order key,
    so it runs on tiny groups and reuses the join's partitioning by that key.
    """
    li = (table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
          .filter(F.col("l_linenumber") == 1))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice",
                   "o_orderdate", "o_orderpriority")
    part = table(spark, sf_dir, "part", "p_partkey", "p_type")
    # number the order's first lines right after the join on the order key
    # (its output is already partitioned by that key), then look up the part
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey"))
    joined = (li.join(orders, li.l_orderkey == orders.o_orderkey)
              .withColumn("_pos", pos)
              .join(part, F.col("l_partkey") == part.p_partkey)
              .filter(~((F.col("p_type") == NO_TARGET_ACTIVITY) & (F.col("l_suppkey") % 7 == 0))))
    prio = F.substring("o_orderpriority", 1, 1)
    change_type = F.lit("extension")
    for digit, kind in reversed(list(PRIORITY_TO_CHANGE_TYPE.items())):
        change_type = F.when(prio == digit, kind).otherwise(change_type)
    cents = F.floor(F.col("o_totalprice") / F.lit(LEDGER_HOURS_DIVISOR_CENTS))
    return joined.select(
        (F.col("l_orderkey") * 100 + F.col("_pos")).cast("bigint").alias("entry_id"),
        project_nr(F.col("l_suppkey")).alias("project_nr"),
        F.col("p_type").alias("activity"),
        (cents.cast("decimal(12,0)") / F.lit(100)).cast("decimal(10,2)").alias("hours"),
        change_type.alias("change_type"),
        F.col("o_orderdate").cast("date").alias("valid_from"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("reason"),
        F.when(F.col("l_orderkey") % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("REF-"), F.col("l_orderkey").cast("string"))).alias("reference"),
        F.concat(_padded("user", F.col("o_custkey") % 20, 2, "user%02d"), F.lit("@example.com")).alias("created_by"),
        F.timestamp_add("HOUR", (F.col("o_custkey") % 24).cast("int"), F.col("o_orderdate")).alias("created_at"),
    )


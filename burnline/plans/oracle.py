"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The driver tables are pre-registered as views. Every statement re-derives
the bookings and the ledger with the same rules as
:mod:`burnline.sources.derived`, then computes the operator in plain SQL.
"""

from __future__ import annotations

AS_OF_TS = "TIMESTAMP '2001-06-30 00:00:00'"
AS_OF_DATE = "DATE '2001-06-30'"

BOOKINGS_CTE = f"""
bookings AS (
  SELECT c.c_name AS employee,
         CAST(CAST(l.l_quantity AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DOUBLE) AS hours_logged,
         CAST(l.l_quantity AS DOUBLE) AS hours_billed,
         s.s_name AS project,
         printf('P%05d', l.l_suppkey) AS project_nr,
         l.l_linestatus AS subproject,
         printf('CC%02d', s.s_nationkey) AS cost_center,
         p.p_type AS activity,
         l.l_returnflag AS status,
         CAST(NULL AS VARCHAR) AS comment,
         CAST(o.o_orderdate AS DATE) AS entry_date,
         l.l_shipdate AS booking_ts,
         CAST(month(o.o_orderdate) AS INTEGER) AS month,
         CAST(year(o.o_orderdate) AS INTEGER) AS year,
         CAST(l.l_orderkey AS VARCHAR) AS erp_txn_no,
         n.n_name AS customer,
         CAST(NULL AS VARCHAR) AS project_lead
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderdate <= {AS_OF_TS}
)"""

# without the as-of cut
ALL_BOOKINGS_CTE = BOOKINGS_CTE.replace(f"  WHERE o.o_orderdate <= {AS_OF_TS}\n", "")

LEDGER_CTE = """
ledger AS (
  SELECT CAST(x.l_orderkey * 100 + x.pos AS BIGINT) AS entry_id,
         printf('P%05d', x.l_suppkey) AS project_nr,
         p.p_type AS activity,
         CAST(CAST(floor(x.o_totalprice / 14.0) AS BIGINT) * 0.01 AS DECIMAL(10,2)) AS hours,
         CASE substr(x.o_orderpriority, 1, 1) WHEN '1' THEN 'initial' WHEN '2' THEN 'extension'
              WHEN '3' THEN 'correction' WHEN '4' THEN 'reduction' ELSE 'extension' END AS change_type,
         CAST(x.o_orderdate AS DATE) AS valid_from,
         'order ' || CAST(x.l_orderkey AS VARCHAR) AS reason,
         CASE WHEN x.l_orderkey % 3 = 0 THEN NULL ELSE 'REF-' || CAST(x.l_orderkey AS VARCHAR) END AS reference,
         printf('user%02d@example.com', x.o_custkey % 20) AS created_by,
         x.o_orderdate + to_hours(CAST(x.o_custkey % 24 AS INTEGER)) AS created_at
  FROM (
    SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, o.o_custkey, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
           row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_partkey, l.l_suppkey) AS pos
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    WHERE l.l_linenumber = 1
  ) x
  JOIN part p ON x.l_partkey = p.p_partkey
  WHERE NOT (p.p_type = 'LARGE' AND x.l_suppkey % 7 = 0)
)"""

# D9 at the as-of date
TARGETS_CTE = f"""
targets AS (
  SELECT project_nr, activity,
         CAST(SUM(hours) AS DOUBLE) AS budget_hours,
         CAST(SUM(CASE WHEN change_type = 'reduction' THEN -hours ELSE hours END) AS DOUBLE) AS budget_hours_signed
  FROM ledger WHERE valid_from <= {AS_OF_DATE}
  GROUP BY project_nr, activity
)"""

# D1
AGG_CTE = """
agg AS (
  SELECT project, project_nr, customer, employee, activity,
         SUM(hours_billed) AS actual_hours, COUNT(*) AS entry_count,
         MIN(entry_date) AS first_entry, MAX(entry_date) AS last_entry
  FROM bookings GROUP BY project, project_nr, customer, employee, activity
)"""

# D2
DASH_CTE = """
shares AS (
  SELECT project_nr, activity, budget_hours,
         CASE WHEN CAST(SUM(CAST(budget_hours AS DECIMAL(38,2))) OVER (PARTITION BY project_nr) AS DOUBLE) > 0
              THEN budget_hours / CAST(SUM(CAST(budget_hours AS DECIMAL(38,2))) OVER (PARTITION BY project_nr) AS DOUBLE) * 100 ELSE 0.0 END AS share_pct
  FROM targets
),
act AS (
  SELECT project_nr, project, activity, COALESCE(SUM(actual_hours), 0.0) AS actual_hours,
         arg_min(customer, (-COALESCE(actual_hours, 0.0), customer, employee)) AS customer
  FROM agg GROUP BY project_nr, project, activity
),
dash AS (
  SELECT a.project_nr, a.project, a.activity,
         COALESCE(s.budget_hours, 0.0) AS target_hours,
         COALESCE(s.share_pct, 0.0) AS share_pct,
         a.actual_hours,
         CASE WHEN COALESCE(s.budget_hours, 0.0) > 0 THEN a.actual_hours / COALESCE(s.budget_hours, 0.0) * 100 ELSE 0.0 END AS fulfillment_pct,
         CASE WHEN COALESCE(s.budget_hours, 0.0) = 0 THEN '🔴 Kein Ziel'
              WHEN a.actual_hours / COALESCE(s.budget_hours, 0.0) * 100 <= 100 THEN '🟢 Buchbar'
              WHEN a.actual_hours / COALESCE(s.budget_hours, 0.0) * 100 <= 110 THEN '🟡 Kritisch'
              ELSE '🔴 Überbucht' END AS status,
         a.customer
  FROM act a LEFT JOIN shares s ON a.project_nr = s.project_nr AND a.activity = s.activity
)"""



"""Clustered day totals are read without a shuffle, and metrics observed beside a write equal the queries of their own."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from burnline.operators import dashboard as D
from burnline.operators import ledger as L
from burnline.sources import clustered as CL

from conftest import make_ledger


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


@pytest.fixture(scope="module")
def entries(spark):
    """Half of the entries are of one key; keys may be NULL."""
    rng = random.Random(5)
    return make_ledger(spark, [{"project_nr": rng.choice(["HOT"] * 4 + ["P1", "P2", "P3", "-"]), "activity": rng.choice(["Dev", "Test", "-"]),
                                "hours": rng.randint(1, 900) / 4, "change_type": rng.choice(["initial", "reduction"]),
                                "valid_from": dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 40))} for _ in range(500)]) \
        .withColumns({k: F.nullif(F.col(k), F.lit("-")) for k in L.KEY})


@pytest.fixture(scope="module")
def probes(entries):
    return entries.select("project_nr", "activity", F.date_add("valid_from", 3).alias("as_of_date")).distinct()


@pytest.fixture()
def plain_plans(spark):
    """Plans without AQE and broadcasts, as large tables have them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clustered_lookups_shuffle_nothing(spark, tmp_dir, entries, probes, plain_plans):
    days = CL.write_clustered(L.ledger_days(entries), f"{tmp_dir}/days", L.KEY, ["valid_from"], buckets=5)
    asks = CL.write_clustered(probes, f"{tmp_dir}/probes", L.KEY, ["as_of_date"], buckets=5)
    date = dt.date(2024, 1, 20)
    assert rows(L.balances_of_days(days, asks)) == rows(L.balances_at_dates(entries, probes))
    assert rows(L.budgets_of_days(days, date)) == rows(L.budgets_at(entries, date))
    for lookup in (L.balances_of_days(days, asks), L.budgets_of_days(days, date)):
        assert "Exchange" not in plan(lookup) and "Bucketed: true" in plan(lookup)
    assert "Exchange" in plan(L.balances_at_dates(entries, probes))
    assert days.groupBy(*L.KEY).count().agg(F.max("count")).first()[0] <= 41  # a row per day, however hot the key


def test_clustered_tables_in_a_later_session(spark, tmp_dir, entries, plain_plans):
    days = L.ledger_days(entries)
    CL.write_clustered(days, f"{tmp_dir}/days", L.KEY, ["valid_from"], buckets=3)
    again = CL.read_clustered(spark.newSession(), f"{tmp_dir}/days", days.schema, L.KEY, ["valid_from"])
    assert rows(again) == rows(days)
    later = CL.read_clustered(spark, f"{tmp_dir}/days", days.schema, L.KEY, ["valid_from"])
    assert "Exchange" not in plan(L.budgets_of_days(later, dt.date(2024, 2, 1)))
    with pytest.raises(Exception):
        CL.write_clustered(days, f"{tmp_dir}/days", L.KEY, buckets=3)
    with pytest.raises(ValueError):
        CL.read_clustered(spark, f"{tmp_dir}/none", days.schema, L.KEY)


def test_empty_ledger(spark, tmp_dir, entries, probes):
    none = entries.limit(0)
    days = CL.write_clustered(L.ledger_days(none), f"{tmp_dir}/days", L.KEY, ["valid_from"], buckets=2)
    assert L.budgets_of_days(days, dt.date(2024, 1, 1)).count() == 0
    assert rows(L.balances_of_days(days, probes)) == rows(L.balances_at_dates(none, probes))


def dashboard_rows(spark, n):
    rng = random.Random(6)
    data = [(rng.choice([None, "P1", "P2", "P3"]), rng.choice(["A", "B"]), f"act{i}", rng.choice([0.0, 10.25, 40.5]), rng.randint(0, 999) / 8,
             rng.choice([0.0, 89.96, 90.0, 120.0]), rng.choice(["🟢 Buchbar", "🔴 Überbucht"])) for i in range(n)]
    return spark.createDataFrame(data, "project_nr string, project string, activity string, target_hours double, actual_hours double, "
                                       "fulfillment_pct double, status string")


@pytest.mark.parametrize("n", [0, 1, 300])
def test_kpis_beside_the_write(spark, tmp_dir, n):
    shown = dashboard_rows(spark, n).repartition(4)
    got = D.write_dashboard(shown, f"{tmp_dir}/dashboard").first().asDict()
    want = D.portfolio_kpis(shown).first().asDict() | D.budget_tab_kpis(shown).first().asDict()
    forecast = D.forecast_kpis(shown).first().asDict()
    want |= {c: forecast[c] for c in ("remaining_hours", "remaining_pct")}
    assert got == pytest.approx(want, nan_ok=True)
    assert rows(spark.read.parquet(f"{tmp_dir}/dashboard")) == rows(shown)


def test_counters_beside_the_write(spark, tmp_dir):
    agg = spark.createDataFrame([("P1", "A", 3), ("P1", "B", 4), (None, "A", 1)], "project_nr string, activity string, entry_count long")
    span = (dt.date(2024, 1, 1), dt.date(2024, 3, 31))
    for frame, bookings in ((agg, 8), (agg.limit(0), 0)):
        got = D.write_aggregate(frame, f"{tmp_dir}/agg{bookings}", *span).first().asDict()
        assert got == D.export_counters(frame, *span).first().asDict() | {"record_count": bookings}


def test_the_write_is_the_only_job_over_the_source(spark, tmp_dir):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    shown = dashboard_rows(spark, 50)
    D.write_dashboard(shown.mapInArrow(counted, shown.schema), f"{tmp_dir}/dashboard").collect()
    assert seen.value == 50

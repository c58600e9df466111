"""File sources and sinks: round trips through Spark's readers and writers."""

import datetime as dt
import glob
import json
import os
import re

import pytest
from conftest import make_bookings

from pyspark.sql import functions as F

from burnline import schemas as S
from burnline.operators import dashboard as D
from burnline.operators import export as X
from burnline.operators import filters as B
from burnline.operators import forecast as FC
from burnline.sources import derived
from burnline.sources import files as FS

MOCK_ROWS = [  # minimal source rows: 3 projects x 4 activities, 25.5 h each
    {"Name": "Test User", "FaktStd": "25.5", "Projekt": p, "ProjektNr": p + "-NR", "Verwendung": a,
     "Status": "Genehmigt", "Datum": "2024-01-15", "Jahr": "2024", "Monat": "1", "Kundenname": "Kunde " + p}
    for p in ("P24ABC01", "P24XYZ01", "P24DEF02")
    for a in ("Analyse & Konzeption", "Implementierung", "Testing & QA", "Deployment")
]


def _write_csv(path, rows):
    cols = list(FS.SOURCE_COLUMNS)
    with open(path, "w", encoding="utf-8") as f:
        f.write(";".join(cols) + "\n")
        for r in rows:
            f.write(";".join(str(r.get(c, "")) for c in cols) + "\n")


def test_csv_and_json_sources(spark, tmp_dir):
    csv_path = os.path.join(tmp_dir, "zv.csv")
    _write_csv(csv_path, MOCK_ROWS)
    b = FS.read_bookings_csv(spark, csv_path)
    S.assert_schema(b, S.BOOKINGS_SCHEMA)
    assert b.count() == 12 and b.agg(F.sum("hours_billed")).first()[0] == 12 * 25.5
    assert b.first().entry_date == dt.date(2024, 1, 15) and b.first().booking_ts is None
    json_path = os.path.join(tmp_dir, "zv.json")
    with open(json_path, "w", encoding="utf-8") as f:
        json.dump(MOCK_ROWS, f, indent=2)
    j = FS.read_bookings_json(spark, json_path)
    assert j.count() == 12 and j.select("project").distinct().count() == 3


def test_aggregate_extract_built_once(spark, tmp_dir):
    b = make_bookings(spark, [{"project_nr": "P", "project": "p", "activity": "A", "hours_billed": 1.25, "employee": "e"},
                              {"project_nr": "P", "project": "p", "activity": "A", "hours_billed": 1.25, "employee": None}])
    path = os.path.join(tmp_dir, "agg")
    first = FS.load_or_build_aggregate(spark, path, b).first()
    assert first.actual_hours == 2.5 and first.entry_count == 1  # counts non-null employees
    again = FS.load_or_build_aggregate(spark, path, b.limit(0))  # stored extract wins
    assert again.count() == 1


def test_legacy_targets_latest_and_validity(spark, tmp_dir):
    recs = [("targets_a.json", {"project": "P", "activity": "A", "target_hours": 10.0, "timestamp": "2024-01-01T10:00:00"}),
            ("targets_b.json", {"project": "P", "activity": "B", "target_hours": None, "timestamp": "2024-01-01T10:00:00"}),
            ("targets_c.json", {"project": "", "activity": "C", "target_hours": 3.0, "timestamp": "2024-01-01T10:00:00"}),
            ("other.json", {"project": "X", "activity": "X", "target_hours": 1.0, "timestamp": "2024-01-01T10:00:00"})]
    for name, rec in recs:
        with open(os.path.join(tmp_dir, name), "w") as f:
            json.dump(rec, f, indent=2)
    with open(os.path.join(tmp_dir, "targets_broken.json"), "w") as f:
        f.write("{not json")
    t = FS.load_legacy_targets(spark, tmp_dir).collect()
    assert [(r.project, r.activity, r.target_hours) for r in t] == [("P", "A", 10.0)]
    store = os.path.join(tmp_dir, "store")
    FS.save_targets(spark.createDataFrame([("P", "A", 12.0, "2024-01-02T09:00:00")],
                                          "project string, activity string, target_hours double, timestamp string"), store)
    FS.save_targets(spark.createDataFrame([("P", "A", 11.0, "2024-01-01T09:00:00")],
                                          "project string, activity string, target_hours double, timestamp string"), store)
    latest = FS.load_legacy_targets(spark, store).first()
    assert latest.target_hours == 12.0
    fresh = FS.valid_targets(FS.load_legacy_targets(spark, store), dt.datetime(2024, 1, 3, 8, 0))
    stale = FS.valid_targets(FS.load_legacy_targets(spark, store), dt.datetime(2024, 1, 3, 10, 0))
    assert fresh.count() == 1 and stale.count() == 0


def test_overrides_store(spark, tmp_dir):
    rows = [("P", None, 5.0, "r", "2024-01-01T00:00:00", "u", None),
            ("P", None, 8.0, "r", "2024-02-01T00:00:00", "u", True)]
    df = spark.createDataFrame(rows, S.OVERRIDE_SCHEMA)
    FS.save_overrides(df, tmp_dir + "/ov")
    o = FC.latest_overrides(FS.read_overrides(spark, tmp_dir + "/ov")).first()
    assert o.hours_per_sprint == 8.0 and o.active


@pytest.mark.parametrize("parts", [1, 8])
def test_stores_lose_no_record(spark, tmp_dir, parts):
    targets = spark.createDataFrame([(f"P{i}", "A", float(i), None if i % 5 == 0 else f"2024-01-{i % 28 + 1:02d}") for i in range(50)],
                                    S.LEGACY_TARGET_SCHEMA)
    folder = os.path.join(tmp_dir, f"t{parts}")
    FS.save_targets(targets.repartition(parts), folder)
    with open(os.path.join(folder, "targets_old.json"), "w") as f:
        json.dump({"project": "OLD", "activity": "A", "target_hours": 7.0}, f, indent=1)
    got = {r.project: r.target_hours for r in FS.load_legacy_targets(spark, folder).collect()}
    assert got == {"OLD": 7.0, **{f"P{i}": float(i) for i in range(50)}}
    overrides = spark.createDataFrame([(f"P{i}", None, float(i), "r", None, "u", None) for i in range(50)], S.OVERRIDE_SCHEMA)
    FS.save_overrides(overrides.repartition(parts), folder + "o")
    with open(os.path.join(folder + "o", "legacy.json"), "w") as f:
        json.dump({"project_nr": "OLD", "hours_per_sprint": 3.0}, f, indent=1)
    assert FC.latest_overrides(FS.read_overrides(spark, folder + "o")).count() == 51


def test_targets_from_ledger_or_files(spark, tmp_dir):
    from conftest import make_ledger
    FS.save_targets(spark.createDataFrame([("P", "A", 12.0, None)], S.LEGACY_TARGET_SCHEMA), tmp_dir + "/t")
    ledger = make_ledger(spark, [{"project_nr": "P", "activity": "A", "hours": 5, "valid_from": dt.date(2024, 1, 1)}])
    day = dt.date(2024, 6, 1)
    load = lambda **kw: [tuple(r) for r in FS.load_targets(spark, day, **kw).collect()]
    assert load(ledger=ledger, directory=tmp_dir + "/t") == [("P", "A", 5.0)]
    assert load(ledger=ledger.limit(0), directory=tmp_dir + "/t") == load(directory=tmp_dir + "/t") == [("P", "A", 12.0)]
    with pytest.raises(ValueError):
        FS.load_targets(spark, day)


def test_csv_with_its_own_columns_and_local_formats(spark, tmp_dir):
    path = os.path.join(tmp_dir, "mock.csv")
    with open(path, "w", encoding="utf-8") as f:  # ten columns, another order
        f.write("Datum;ProjektNr;Projekt;Name;FaktStd;Verwendung;Status;Jahr;Monat;Kundenname\n")
        f.write("15.01.2024;P1;Eins;Ana;25,5;Test;Offen;2024;1;K\n2024-02-01;P1;Eins;Ana;1.234,25;Test;Offen;;;K\n")
        f.write("gestern;P1;Eins;Ana;viel;Test;Offen;2024;1;K\n2024-03-01;P1;Eins;Ana;;Test;Offen;2024;3;K\n")
    b = FS.read_bookings_csv(spark, path)
    S.assert_schema(b, S.BOOKINGS_SCHEMA)
    rows = b.collect()
    assert [(r.entry_date, r.hours_billed, r.month) for r in rows] == [
        (dt.date(2024, 1, 15), 25.5, 1), (dt.date(2024, 2, 1), 1234.25, 2), (None, None, 1), (dt.date(2024, 3, 1), None, 3)]
    assert rows[0].project_nr == "P1" and rows[0].hours_logged is None
    bad = FS.rejected_bookings(FS.read_bookings_csv_text(spark, path)).collect()
    assert [sorted(r.rejected_columns) for r in bad] == [["Datum", "FaktStd"]]


def test_stored_extract_is_never_overwritten_on_error(spark, tmp_dir):
    path = os.path.join(tmp_dir, "agg")
    os.makedirs(path)
    with open(os.path.join(path, "part-0.parquet"), "w") as f:
        f.write("damaged")
    with pytest.raises(Exception):
        FS.load_or_build_aggregate(spark, path, make_bookings(spark, [{"project_nr": "P"}])).collect()
    assert os.listdir(path) == ["part-0.parquet"]


def test_entitlements(spark, tmp_dir):
    doc = {"users": {"ana@example.org": {"projects": ["P1", " P2 ", "", None], "permissions": ["admin", "export"]},
                     "bo@example.org": {"projects": ["P3"]}},
           "default_permissions": ["view"]}
    path = os.path.join(tmp_dir, "users.json")
    with open(path, "w") as f:
        json.dump(doc, f)
    ent = FS.read_entitlements(spark, path)
    assert sorted(r.project_nr for r in B.user_projects(ent).filter("email = 'ana@example.org'").collect()) == ["P1", "P2"]
    perms = {(r.email, r.permission) for r in B.user_permissions(ent).collect()}
    assert ("bo@example.org", "view") in perms and ("ana@example.org", "admin") in perms
    assert B.has_permission(ent, "ana@example.org", "export").first().granted
    assert not B.has_permission(ent, "nobody@example.org", "admin").first().granted
    bookings = make_bookings(spark, [{"project_nr": p} for p in ("P1", "P2", "P3", "P4")])
    assert sorted(r.project_nr for r in B.restrict_to_user(bookings, ent, "ana@example.org").collect()) == ["P1", "P2"]


def test_exports(spark, tmp_dir):
    b = make_bookings(spark, [{"project_nr": "P", "project": "Alpha", "activity": "A", "hours_billed": 3.0,
                               "hours_logged": 2.5, "employee": "e", "customer": "K"}])
    t = spark.createDataFrame([("P", "A", 4.0)], "project_nr string, activity string, budget_hours double")
    summary = X.summary_export_frame(D.activity_dashboard(D.aggregate_bookings(b), t))
    assert summary.columns == ["Projekt", "Tätigkeit", "Sollstunden", "Iststunden", "Erfüllungsstand (%)", "Status", "Kunde"]
    assert summary.first()["Erfüllungsstand (%)"] == 75.0
    detail = X.detail_export_frame(b)
    assert detail.columns == ["Mitarbeiter", "Stunden", "Projekt", "Tätigkeit", "Status", "Datum", "Kommentar", "Kunde"]
    out = os.path.join(tmp_dir, "detail")
    X.write_csv(detail, out, sep=";")
    back = spark.read.option("header", True).option("sep", ";").csv(out)
    assert back.count() == 1 and back.first()["Stunden"] == "2.5"


def test_parameterised_sql(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = FS.run_sql(spark, "SELECT v FROM {t} WHERE k = :k", params={"k": 2}, t=df).collect()
    assert [r.v for r in got] == ["b"]


def test_filter_summary(spark):
    b = make_bookings(spark, [{"project_nr": "P", "activity": "A"}, {"project_nr": "P", "activity": "B"}])
    f = B.BookingFilters(start_date=dt.date(2024, 1, 1), end_date=dt.date(2024, 1, 31), activities=["A"],
                         employees=["x", "y", "z", "w"], search_term="q")
    s = B.filter_summary(B.apply_filters(b, B.BookingFilters(activities=["A"])), f).first()
    assert s.active_filters == 4 and s.record_count == 1
    assert s.filter_texts[2] == "Mitarbeiter: 4 ausgewählt"
    assert B.default_date_window(dt.date(2024, 2, 29)) == (dt.date(2022, 2, 28), dt.date(2024, 2, 29))


def test_month_partitioned_bookings_prune(spark, tmp_dir):
    from burnline.sources import derived
    bookings = derived.bookings(spark, "/root/testdata/sf0.001")
    path = os.path.join(tmp_dir, "bookings")
    FS.write_bookings_table(bookings.repartition(8), path)
    months = bookings.select("year", "month").distinct().count()
    assert len(glob.glob(path + "/*/*/*.parquet")) <= months + 8  # follows the data, not tasks times months
    table = FS.read_bookings_table(spark, path)
    S.assert_schema(table, S.BOOKINGS_SCHEMA)
    f = B.BookingFilters(start_date=dt.date(1999, 6, 30), end_date=dt.date(2001, 6, 30), prune_months=True)
    got = B.apply_filters(table, f)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    want = B.apply_filters(bookings, B.BookingFilters(start_date=dt.date(1999, 6, 30), end_date=dt.date(2001, 6, 30)))
    cols = ["erp_txn_no", "project_nr", "activity", "entry_date", "hours_billed"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_year_filter_is_a_date_range_for_the_scan(spark, tmp_dir):
    rows = [{"project_nr": "P", "entry_date": dt.date(y, m, 3), "year": y, "month": m} for y in (2023, 2024) for m in (1, 2, 12)]
    make_bookings(spark, rows).write.parquet(tmp_dir + "/b")
    table = spark.read.parquet(tmp_dir + "/b")
    for f, n in ((B.BookingFilters(year=2024), 3), (B.BookingFilters(year=2024, month=12), 1), (B.BookingFilters(month=1), 2)):
        got = B.apply_filters(table, f)
        assert got.count() == n
        if f.year:
            assert re.search(r"entry_date#\d+ >= 2024-\d\d-01", got._jdf.queryExecution().executedPlan().toString())


def test_bookings_and_exports_in_order(spark):
    from burnline.operators import ledger as L
    b = make_bookings(spark, [{"project": p, "project_nr": p, "activity": a, "entry_date": dt.date(2024, 1, d), "hours_billed": float(d)}
                              for p, a, d in (("B", "y", 1), ("A", "x", 2), ("A", "x", 5), ("A", "w", 3))])
    assert [(r.project, r.activity, r.entry_date.day) for r in B.order_bookings(b).collect()] == [
        ("A", "w", 3), ("A", "x", 5), ("A", "x", 2), ("B", "y", 1)]
    agg = D.aggregate_bookings(b, order=True).collect()
    assert [(r.project, r.actual_hours) for r in agg] == [("A", 7.0), ("A", 3.0), ("B", 1.0)]
    over = spark.createDataFrame([("B", "a", 1.0), ("A", "z", 1.0), ("A", "b", 1.0)], "project_nr string, activity string, budget_hours double")
    assert [(r.project_nr, r.activity) for r in L.order_overview(over).collect()] == [("A", "b"), ("A", "z"), ("B", "a")]


def test_history_export_has_display_columns(spark):
    from conftest import make_ledger

    from burnline.operators import ledger as L
    led = make_ledger(spark, [{"project_nr": "P", "activity": "A", "hours": 5, "valid_from": dt.date(2024, 1, 2)}])
    out = X.history_export_frame(L.history_display(led))
    assert out.columns == list(X.HISTORY_COLUMNS.values())
    assert out.first()["Gültig ab"] == "02.01.2024"


def test_checkpoint_folder_must_be_named_on_a_cluster(spark):
    from burnline import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_only_the_folders_of_wanted_projects_are_read(spark, tmp_dir):
    rows = [{"project_nr": f"P{i % 40}", "entry_date": dt.date(2024, 1, 1 + i % 28), "erp_txn_no": str(i)} for i in range(800)]
    path, grants = f"{tmp_dir}/by_project", f"{tmp_dir}/grants"
    FS.write_bookings_by_project(make_bookings(spark, rows), path, parts=16)
    assert len(glob.glob(path + "/project_part_of_16=*")) > 10
    spark.createDataFrame([({"a@x": (["P3", " P7 ", None, "P3"], None), "b@x": (["P5"], None)}, ["view"])],
                          "users map<string, struct<projects: array<string>, permissions: array<string>>>, default_permissions array<string>"
                          ).write.parquet(grants)
    entitlements = spark.read.parquet(grants)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = FS.read_entitled_bookings(spark, path, entitlements, "a@x")
        found = got.collect()
        plan = got._jdf.queryExecution().executedPlan()
        assert "dynamicpruning" in plan.toString()
        leaves = plan.collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size()) if "by_project" in leaves.apply(i).toString()]
        read = scans[0].metrics().apply("numFiles").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < read <= 2 < len(glob.glob(path + "/*/*.parquet"))
    S.assert_schema(got, S.BOOKINGS_SCHEMA)
    want = [r["erp_txn_no"] for r in rows if r["project_nr"] in ("P3", "P7")]
    assert sorted(r["erp_txn_no"] for r in found) == sorted(want)
    assert FS.read_entitled_bookings(spark, path, entitlements, "nobody@x").count() == 0
    FS.write_bookings_by_project(make_bookings(spark, []), f"{tmp_dir}/none")
    assert FS.read_entitled_bookings(spark, f"{tmp_dir}/none", entitlements, "a@x").count() == 0


def test_order_lines_of_the_series_are_not_sorted(spark, tmp_dir):
    """The lines meet hashed orders; keys may be null or repeat."""
    when, late = dt.datetime(2024, 1, 2), dt.datetime(2024, 5, 1)
    rows = {"lineitem": ([(1, 7, 3, 10.0, 0.1, when), (1, 8, 3, 4.0, 0.0, None), (2, 7, 3, 1.0, 0.0, when), (None, 7, 3, 1.0, 0.0, when),
                          (3, None, None, 2.0, 0.0, when), (4, 7, 3, 5.0, 0.0, when)],
                         "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_shipdate timestamp_ntz"),
            "orders": ([(1, when), (3, when), (3, when), (4, late), (None, when)], "o_orderkey long, o_orderdate timestamp_ntz"),
            "part": ([(7, "PROMO"), (9, "SMALL")], "p_partkey long, p_type string")}
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_dir}/{name}.parquet")
    key, kept = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        events = derived.booking_events(spark, tmp_dir, until=dt.datetime(2024, 3, 1))
        plan = events._jdf.queryExecution().executedPlan().toString()
        got = sorted((tuple(r) for r in events.select("project_nr", "activity", "booking_ts", "hours_billed", "hours_logged").collect()), key=str)
    finally:
        spark.conf.set(key, kept)
    assert "ShuffledHashJoin [l_orderkey" in plan and "SortMergeJoin [l_orderkey" not in plan
    assert got == sorted([("P00003", "PROMO", when, 10.0, 9.0), ("P00003", None, None, 4.0, 4.0)] + 2 * [(None, None, when, 2.0, 2.0)], key=str)

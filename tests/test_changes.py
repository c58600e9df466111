"""Target edits (J2), their ledger deltas (T3) and legacy migration."""

import datetime as dt

from conftest import make_ledger

from burnline.operators import changes as CH
from burnline.operators import ledger as L


def test_edit_appends_delta_not_value(spark):
    led = make_ledger(spark, [{"project_nr": "P", "activity": "A", "hours": 100, "valid_from": dt.date(2024, 1, 1)},
                              {"project_nr": "P", "activity": "B", "hours": 50, "valid_from": dt.date(2024, 1, 1)}])
    original = spark.createDataFrame([("P", "A", 100.0), ("P", "B", 50.0), ("P", "C", 10.0)],
                                     "project_nr string, activity string, target_hours double")
    # rows arrive in another order: pairing is by key, not by position
    edited = spark.createDataFrame([("P", "C", 10.005), ("P", "B", 40.0), ("P", "A", 120.0)],
                                   "project_nr string, activity string, target_hours double")
    ch = CH.detect_target_changes(original, edited)
    got = {r.activity: (r.old_target, r.new_target, r.delta) for r in ch.collect()}
    assert got == {"A": (100.0, 120.0, 20.0), "B": (50.0, 40.0, -10.0)}  # C within tolerance
    props = CH.changes_to_ledger(ch, dt.date(2024, 2, 1), "me@example.com")
    assert L.validate_entries(props).filter("NOT is_valid").count() == 0
    rows = L.prepare_append(props, led, dt.datetime(2024, 2, 1, 12, 0))
    new_led = led.unionByName(rows)
    bal = {r.activity: r.budget_hours_signed for r in L.budgets_at(new_led, dt.date(2024, 3, 1)).collect()}
    assert bal == {"A": 120.0, "B": 40.0}  # 100 edited to 120 is 120, not 220
    assert rows.agg({"entry_id": "min"}).first()[0] > led.agg({"entry_id": "max"}).first()[0]
    rec = CH.changes_to_target_records(ch, dt.datetime(2024, 2, 1)).filter("activity = 'A'").first()
    assert rec.target_hours == 120.0 and rec.project == "P"


def test_legacy_migration(spark):
    latest = spark.createDataFrame([("P", "A", 12.5, "2024-01-01T00:00:00")],
                                   "project string, activity string, target_hours double, timestamp string")
    props = L.migrate_legacy_targets(latest, dt.date(2024, 1, 1))
    v = L.validate_entries(props).first()
    assert v.is_valid and v.change_type == "initial" and v.hours == 12.5


def test_edits_of_rows_without_activity(spark):
    schema = "project_nr string, activity string, target_hours double"
    original = spark.createDataFrame([("P", None, 1.0), ("P", "A", 2.0)], schema)
    edited = spark.createDataFrame([("P", None, 9.0), ("P", "A", 2.0)], schema)
    got = CH.detect_target_changes(original, edited).collect()
    assert [(r.project_nr, r.activity, r.delta, r.change_type) for r in got] == [("P", None, 8.0, "correction")]


def test_validation_of_author_and_stored_hours(spark):
    rows = [("P", "A", "r", "initial", dt.date(2024, 1, 1), h, who) for h, who in
            ((1.0, "a@x"), (0.004, "a@x"), (0.006, "a@x"), (1e9, "a@x"), (float("inf"), "a@x"), (1.0, None), (1.0, " "))]
    frame = spark.createDataFrame(rows, "project_nr string, activity string, reason string, change_type string, valid_from date, "
                                        "hours double, created_by string")
    assert [r.errors for r in L.validate_entries(frame).collect()] == [
        [], ["hours_not_positive"], [], ["hours_out_of_range"], ["hours_out_of_range"], ["author_blank"], ["author_blank"]]


def test_migration_end_to_end(spark, tmp_dir):
    """Legacy files -> proposals -> validated append -> balances; a second append continues the ids."""
    import json
    import os

    from burnline.sources import files as FS
    for i, (key, hours, stamp) in enumerate([("A", 10.0, None), ("A", 12.5, "2024-01-01"), ("B", 7.0, "2024-01-01"), ("C", 0.0, None)]):
        with open(os.path.join(tmp_dir, f"targets_{i}.json"), "w") as f:
            json.dump({"project": "P", "activity": key, "target_hours": hours, "timestamp": stamp}, f, indent=2)
    path = os.path.join(tmp_dir, "ledger")
    latest = FS.load_legacy_targets(spark, tmp_dir)
    props = L.migrate_legacy_targets(latest, dt.date(2024, 1, 1))
    rejects = L.append_entries(props, path, dt.datetime(2024, 1, 1, 9))
    assert [r.activity for r in rejects.collect()] == ["C"]
    ledger = FS.read_ledger(spark, path)
    assert {r.activity: r.budget_hours for r in L.budgets_at(ledger, dt.date(2024, 6, 1)).collect()} == {"A": 12.5, "B": 7.0}
    for _ in range(2):
        L.append_entries(props.repartition(3), path, dt.datetime(2024, 1, 2, 9))
    ids = [r.entry_id for r in FS.read_ledger(spark, path).select("entry_id").collect()]
    assert len(ids) == len(set(ids)) == 6

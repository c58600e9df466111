"""Stores: dense ids with several writers, commits, compaction, keys from file names, rejected files, rows with NULL keys."""

import datetime as dt
import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from conftest import make_ledger

from burnline import schemas as S
from burnline.operators import changes as CH
from burnline.operators import forecast as FC
from burnline.operators import ledger as L
from burnline.sources import files as FS
from burnline.sources import store

NOW = dt.datetime(2024, 5, 1, 12, 0)
PROPOSAL = "project_nr string, activity string, hours double, change_type string, valid_from date, reason string, reference string, created_by string"


def proposals(spark, n, project="P"):
    rows = [(project, f"A{i % 7}", 1.0 + i, "initial", dt.date(2024, 1, 1), "r", None, "a@example.com") for i in range(n)]
    return spark.createDataFrame(rows, PROPOSAL)


def ids(spark, path):
    return sorted(r[0] for r in FS.read_ledger(spark, path).select("entry_id").collect())


def put(folder, name, content):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(content if isinstance(content, str) else json.dumps(content))


# A7 --------------------------------------------------------------------------
def test_ids_are_dense_over_partitions(spark):
    rows = spark.range(1000).repartition(7).withColumn("x", F.col("id")).filter("id % 3 <> 0")
    numbered, total = L.dense_ids(rows, "entry_id")
    assert total == 666 and sorted(r[0] for r in numbered.select("entry_id").collect()) == list(range(1, 667))
    empty, none = L.dense_ids(rows.limit(0), "entry_id")
    assert none == 0 and empty.count() == 0


def test_concurrent_appends_leave_no_gap_and_no_repeat(spark, tmp_dir):
    path, errors = tmp_dir + "/ledger", []

    def work(k):
        try:
            for j in range(2):
                L.append_entries(proposals(spark, 5 + k + j, f"P{k}").repartition(3), path, NOW)
        except Exception as e:  # noqa: BLE001 - shown by the assertion
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert ids(spark, path) == list(range(1, sum(5 + k + j for k in range(3) for j in range(2)) + 1))


def test_a_writer_killed_before_its_commit_leaves_nothing(spark, tmp_dir, monkeypatch):
    path = tmp_dir + "/ledger"
    L.append_entries(proposals(spark, 4), path, NOW)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            L.append_entries(proposals(spark, 50), path, NOW)
    assert ids(spark, path) == [1, 2, 3, 4]
    L.append_entries(proposals(spark, 3), path, NOW)
    assert ids(spark, path) == list(range(1, 8))
    assert FS.compact_ledger(spark, path) and ids(spark, path) == list(range(1, 8))


def test_a_ledger_stored_without_commits_is_continued(spark, tmp_dir):
    path = tmp_dir + "/ledger"
    old = make_ledger(spark, [{"project_nr": "P", "activity": "A", "hours": h, "valid_from": dt.date(2024, 1, 1)} for h in (1, 2, 3)])
    old.write.parquet(path)
    rejects = L.append_entries(proposals(spark, 2).unionByName(proposals(spark, 1).withColumn("hours", F.lit(-1.0))), path, NOW)
    assert rejects.count() == 1 and ids(spark, path) == [1, 2, 3, 4, 5]


def test_a_name_is_created_once(spark, tmp_dir):
    path = tmp_dir + "/log/entry-1.json"
    os.makedirs(tmp_dir + "/log")
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append((k, store.create_once(spark, path, f"writer {k}")))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winners = [k for k, ok in won if ok]
    assert len(winners) == 1 and open(path).read() == f"writer {winners[0]}"
    assert os.listdir(tmp_dir + "/log") == ["entry-1.json"]  # drafts are gone


# Compaction -------------------------------------------------------------------
def test_ledger_compaction_keeps_rows_and_reads_few_files(spark, tmp_dir):
    path = tmp_dir + "/ledger"
    for k in range(6):
        L.append_entries(proposals(spark, 3 + k).repartition(3), path, NOW)
    before = sorted(map(tuple, FS.read_ledger(spark, path).collect()))
    running = FS.read_ledger(spark, path)  # planned on the old files
    assert len(store.live_files(spark, path)[0]) >= 6
    assert FS.compact_ledger(spark, path)
    assert len(store.live_files(spark, path)[0]) == 1
    assert sorted(map(tuple, FS.read_ledger(spark, path).collect())) == before == sorted(map(tuple, running.collect()))
    L.append_entries(proposals(spark, 2), path, NOW)
    assert FS.compact_ledger(spark, path)
    assert ids(spark, path) == list(range(1, len(before) + 3))
    assert store.vacuum(spark, path, 0) == 0
    removed = store.vacuum(spark, path, int(time.time() * 1000) + 60_000)
    assert removed >= 6 and ids(spark, path) == list(range(1, len(before) + 3))
    assert len(store.list_files(spark, path, ".parquet")) == 0


def test_an_append_during_compaction_stays(spark, tmp_dir, monkeypatch):
    path = tmp_dir + "/ledger"
    L.append_entries(proposals(spark, 4), path, NOW)
    real = store.compact

    def slow(*args):
        L.append_entries(proposals(spark, 3, "Q"), path, NOW)
        return real(*args)

    with monkeypatch.context() as m:
        m.setattr(store, "compact", slow)
        assert FS.compact_ledger(spark, path)
    assert ids(spark, path) == list(range(1, 8))
    assert FS.read_ledger(spark, path).filter("project_nr = 'Q'").count() == 3


def test_of_two_compactions_one_counts(spark, tmp_dir, monkeypatch):
    path = tmp_dir + "/ledger"
    L.append_entries(proposals(spark, 4), path, NOW)
    real, results = store.compact, []

    def slow(*args):
        monkeypatch.setattr(store, "compact", real)
        number = store.last_entry(spark, path, store.SNAPSHOT)
        results.append(FS.compact_ledger(spark, path))
        monkeypatch.setattr(store, "last_entry", lambda *_: number)
        return real(*args)

    monkeypatch.setattr(store, "compact", slow)
    assert not FS.compact_ledger(spark, path) and results == [True]
    monkeypatch.undo()
    assert ids(spark, path) == [1, 2, 3, 4]


def test_stores_of_latest_records_compact(spark, tmp_dir):
    targets, overrides = tmp_dir + "/t", tmp_dir + "/o"
    for k in range(12):
        t = spark.createDataFrame([(f"P{k % 5}", "A", float(k), f"2024-01-{k + 1:02d}T00:00:00")],
                                  "project string, activity string, target_hours double, timestamp string")
        FS.save_targets(t, targets)
        FS.save_overrides(spark.createDataFrame([(f"P{k % 5}", None if k % 2 else "A", float(k), "r", f"2024-01-{k + 1:02d}", "u", None)], S.OVERRIDE_SCHEMA), overrides)
    was = [sorted(map(repr, x.collect())) for x in (FS.load_legacy_targets(spark, targets), FC.latest_overrides(FS.read_overrides(spark, overrides)))]
    assert FS.compact_targets(spark, targets) and FS.compact_overrides(spark, overrides)
    assert len(store.live_files(spark, targets)[0]) == 1 and len(store.live_files(spark, overrides)[0]) == 1
    now = [sorted(map(repr, x.collect())) for x in (FS.load_legacy_targets(spark, targets), FC.latest_overrides(FS.read_overrides(spark, overrides)))]
    assert was == now
    t = spark.createDataFrame([("P0", "A", 99.0, "2025-01-01T00:00:00")], "project string, activity string, target_hours double, timestamp string")
    FS.save_targets(t, targets)
    assert FS.load_legacy_targets(spark, targets).filter("project = 'P0'").first().target_hours == 99.0
    store.vacuum(spark, targets, int(time.time() * 1000) + 60_000)
    assert FS.load_legacy_targets(spark, targets).count() == 5


# A11 -------------------------------------------------------------------------
def override(hours, **more):
    return {"hours_per_sprint": hours, "reason": "r", "updated_at": "2024-01-01T00:00:00", "updated_by": "u", "active": True, **more}


def test_override_keys_come_from_file_names(spark, tmp_dir):
    put(tmp_dir, "forecast_P_1.json", override(10.0))
    put(tmp_dir, "forecast_P2.json", override(20.0))
    put(tmp_dir, "forecast_P_1_Analyse & Konzept_2.json", override(30.0))
    put(tmp_dir, "forecast_P2_Prüfung.json", override(35.0))
    put(tmp_dir, "forecast_X_Y.json", override(40.0))  # project X_Y, or activity Y of X
    put(tmp_dir, "forecast_Nobody.json", override(50.0))
    put(tmp_dir, "forecast_P2_broken.json", "{\"hours_per_sprint\": ")
    put(tmp_dir, "forecast_P2_empty.json", "")
    put(tmp_dir, "forecast_P2_none.json", {"reason": "r"})
    put(tmp_dir, "own.json", override(60.0, project_nr="P9", activity="Z"))
    known = spark.createDataFrame([("P_1", "Analyse & Konzept_2"), ("P_1", "Dev"), ("P2", "Prüfung"), ("P2", None), ("X", "Y"), ("X_Y", "Dev"), (None, "P2")],
                                  "project_nr string, activity string")
    got = {(r.project_nr, r.activity): r.hours_per_sprint for r in FS.read_overrides(spark, tmp_dir, known).collect()}
    assert got == {("P_1", None): 10.0, ("P2", None): 20.0, ("P_1", "Analyse & Konzept_2"): 30.0, ("P2", "Prüfung"): 35.0, ("P9", "Z"): 60.0}
    left = {r.file_name: r.status for r in FS.unresolved_override_files(spark, tmp_dir, known).collect()}
    assert left == {"forecast_X_Y.json": "ambiguous", "forecast_Nobody.json": "unknown", "forecast_P2_broken.json": "unreadable",
                    "forecast_P2_empty.json": "unreadable", "forecast_P2_none.json": "incomplete"}
    without = FS.read_overrides(spark, tmp_dir).collect()
    assert [(r.project_nr, r.activity) for r in without] == [("P9", "Z")]  # no key, no record: nothing collapses into NULL


def test_overrides_of_named_files_reach_the_forecast(spark, tmp_dir):
    put(tmp_dir, "forecast_P_1_Dev.json", override(77.0))
    units = spark.createDataFrame([("activity", "P_1", "Dev"), ("activity", "P_1", "Test"), ("project", "P_1", None)],
                                  "level string, project_nr string, activity string")
    known = units.select("project_nr", "activity")
    got = FC.attach_overrides(units, FS.read_overrides(spark, tmp_dir, known)).collect()
    assert {(r.activity, r.manual_hours_per_sprint) for r in got} == {("Dev", 77.0), ("Test", None), (None, None)}


# A8 --------------------------------------------------------------------------
def test_rejected_target_files_are_listed(spark, tmp_dir):
    good = {"project": "P", "activity": "A", "target_hours": 10.0, "timestamp": "2024-01-01T10:00:00"}
    put(tmp_dir, "targets_good.json", json.dumps(good, indent=2))
    put(tmp_dir, "targets_broken.json", "{\"project\": \"P\",")
    put(tmp_dir, "targets_empty.json", "")
    put(tmp_dir, "targets_text.json", {**good, "target_hours": "many"})
    put(tmp_dir, "targets_nohours.json", {"project": "P", "activity": "B"})
    put(tmp_dir, "targets_noproject.json", {**good, "project": ""})
    put(tmp_dir, "targets_noactivity.json", {"project": "P", "target_hours": 1.0})
    put(tmp_dir, "other.json", "{")
    assert [r.target_hours for r in FS.read_target_files(spark, tmp_dir).collect()] == [10.0]
    got = {r.file_name: r.reason for r in FS.rejected_target_files(spark, tmp_dir).collect()}
    assert got == {"targets_broken.json": "unreadable", "targets_empty.json": "unreadable", "targets_text.json": "unreadable",
                   "targets_nohours.json": "hours missing", "targets_noproject.json": "project missing", "targets_noactivity.json": "activity missing"}


# J2, J3 ------------------------------------------------------------------------
def test_added_and_removed_targets_are_changes(spark):
    schema = "project_nr string, activity string, target_hours double"
    original = spark.createDataFrame([("P", "A", 5.0), ("P", "B", 7.0), ("P", None, 1.0), ("Q", "Z", 0.0), ("Q", "N", None)], schema)
    edited = spark.createDataFrame([("P", "A", 6.0), ("P", "C", 3.0), (None, None, 2.0), ("Q", "N", 0.004)], schema)
    ch = CH.detect_target_changes(original, edited)
    got = {(r.project_nr, r.activity): (r.edit, r.delta, r.change_type) for r in ch.collect()}
    assert got == {("P", "A"): ("changed", 1.0, "correction"), ("P", "B"): ("removed", -7.0, "reduction"), ("P", None): ("removed", -1.0, "reduction"),
                   ("P", "C"): ("added", 3.0, "correction"), (None, None): ("added", 2.0, "correction")}
    entries = {(r.project_nr, r.activity): (r.hours, r.change_type) for r in CH.changes_to_ledger(ch, dt.date(2024, 1, 1), "a@x").collect()}
    assert entries[("P", "C")] == (3.0, "correction") and entries[("P", "B")] == (7.0, "reduction")


def test_proposals_and_entries_with_null_keys_stay(spark):
    led = make_ledger(spark, [{"project_nr": "P", "activity": "-", "hours": 10, "valid_from": dt.date(2024, 1, 1)},
                              {"project_nr": "P", "activity": "-", "hours": 5, "valid_from": dt.date(2024, 1, 2)},
                              {"project_nr": "P", "activity": "A", "hours": 1, "valid_from": dt.date(2024, 1, 2)}])
    led = led.withColumn("activity", F.nullif(F.col("activity"), F.lit("-")))
    got = {r.entry_id: r.balance for r in L.running_balance(led).collect()}
    assert got == {1: 10.0, 2: 15.0, 3: 1.0}
    todo = spark.createDataFrame([(1, None, "A", 2.0), (2, "P", None, 3.0), (3, "P", None, 4.0), (4, None, None, 5.0)],
                                 "proposal_id long, project_nr string, activity string, hours double")
    got = {r.proposal_id: (r.current_budget, r.new_budget) for r in L.preview_changes(led, todo, dt.date(2024, 6, 1)).collect()}
    assert got == {1: (0.0, 2.0), 2: (15.0, 18.0), 3: (15.0, 22.0), 4: (0.0, 5.0)}

"""Streaming weekly totals equal the batch weekly totals of the same files."""

import datetime as dt
import os

from conftest import make_bookings

from burnline.operators import trends as TR
from burnline.sources import derived
from burnline.streaming import start_weekly_totals
from burnline.streaming.weekly import dropped_rows

SMOKE = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark, tmp_dir):
    bookings = derived.bookings(spark, SMOKE)
    src = os.path.join(tmp_dir, "in")
    # two arriving batches of files
    bookings.filter("year < 1998").write.parquet(src + "/batch1")
    bookings.filter("year >= 1998").write.parquet(src + "/batch2")
    q = start_weekly_totals(spark, src + "/*", os.path.join(tmp_dir, "ckpt"), query_name="wk_test",
                            output_mode="complete")
    q.awaitTermination(300)
    streamed = {(r.project_nr, r.week_start): r.hours for r in spark.table("wk_test").collect()}
    batch = {(r.project_nr, r.week_start): r.hours
             for r in TR.weekly_totals(TR.booking_series(bookings), ["project_nr"]).collect()}
    assert streamed == batch and len(batch) > 100


def test_append_mode_writes_final_weeks_and_counts_late_rows(spark, tmp_dir):
    def batch(name, *days):
        rows = [{"project_nr": "P", "booking_ts": dt.datetime(2024, 1, 1) + dt.timedelta(days=d), "hours_billed": 1.0} for d in days]
        make_bookings(spark, rows).coalesce(1).write.parquet(os.path.join(tmp_dir, "in", name))

    def run():
        q = start_weekly_totals(spark, os.path.join(tmp_dir, "in", "*"), os.path.join(tmp_dir, "ckpt"), os.path.join(tmp_dir, "out"))
        q.awaitTermination(300)
        return dropped_rows(q)

    batch("a", 0, 1, 8, 60)
    assert run() == 0
    batch("b", 2, 61)  # the week of day 2 is final by now
    assert run() == 1
    weeks = {r.week_start: r.hours for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect()}
    assert weeks == {dt.date(2024, 1, 1): 2.0, dt.date(2024, 1, 8): 1.0}

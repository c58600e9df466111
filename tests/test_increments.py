"""What is kept up to date: the monthly extract (A5), weekly totals by upserts (2.K), and Python's regexes in Spark."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import make_bookings

from burnline.functions import scalar as H
from burnline.functions.regex import to_java
from burnline.operators import dashboard as D
from burnline.operators import trends as TR
from burnline.sources import files as FS
from burnline.sources import store
from burnline.streaming import weekly


NONE = dt.date(1900, 1, 1)


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def booked(spark, days, project="P", hours=1.25):
    frame = make_bookings(spark, [{"project_nr": project, "project": project, "activity": f"A{i % 3}", "customer": "K", "employee": "e" if i % 2 else None,
                                  "entry_date": d or NONE, "hours_billed": hours, "year": d.year if d else None, "month": d.month if d else None}
                                  for i, d in enumerate(days)])
    return frame.withColumn("entry_date", F.nullif("entry_date", F.lit(NONE)))


def append(frame, path):
    frame.write.mode("append").partitionBy("year", "month").parquet(path)


def test_extract_follows_the_bookings_month_by_month(spark, tmp_dir):
    table, extract = tmp_dir + "/bookings", tmp_dir + "/extract"
    start = [dt.date(2024, m, d) for m in (1, 2, 3) for d in (1, 5, 9)]
    FS.write_bookings_table(booked(spark, [*start, None]), table)

    def same():
        assert rows(FS.read_aggregate_extract(spark, extract)) == rows(D.aggregate_bookings_compact(FS.read_bookings_table(spark, table)))

    null_month = "year=__HIVE_DEFAULT_PARTITION__/month=__HIVE_DEFAULT_PARTITION__"
    assert FS.refresh_aggregate(spark, table, extract) == ["year=2024/month=1", "year=2024/month=2", "year=2024/month=3", null_month]
    same()
    before = {m: t for m, t in store.partitions(spark, extract, 2).items()}
    assert FS.refresh_aggregate(spark, table, extract) == []
    append(booked(spark, [dt.date(2024, 2, 20)], "Late", 7.5), table)  # late bookings of one month
    append(booked(spark, [dt.date(2024, 4, 2)]), table)
    assert FS.refresh_aggregate(spark, table, extract) == ["year=2024/month=2", "year=2024/month=4"]
    same()
    after = store.partitions(spark, extract, 2)
    assert {m for m in before if after[m] != before[m]} == {"year=2024/month=2"}
    store.remove_folder(spark, table + "/year=2024/month=1")
    booked(spark, []).drop("year", "month").write.mode("overwrite").parquet(table + "/year=2024/month=3")  # files, but no rows
    assert FS.refresh_aggregate(spark, table, extract) == ["year=2024/month=3", "year=2024/month=1"]
    same()


def test_a_refresh_that_failed_is_done_again(spark, tmp_dir, monkeypatch):
    table, extract = tmp_dir + "/bookings", tmp_dir + "/extract"
    FS.write_bookings_table(booked(spark, [dt.date(2024, 1, 1)]), table)
    with monkeypatch.context() as m:
        m.setattr(store, "commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            FS.refresh_aggregate(spark, table, extract)
    assert FS.refresh_aggregate(spark, table, extract) == ["year=2024/month=1"]
    assert rows(FS.read_aggregate_extract(spark, extract)) == rows(D.aggregate_bookings_compact(FS.read_bookings_table(spark, table)))


def test_only_changed_months_are_read(spark, tmp_dir):
    FS.write_bookings_table(booked(spark, [dt.date(2024, m, 1) for m in range(1, 7)]), tmp_dir + "/b")
    plan = FS._of_months(FS.read_bookings_table(spark, tmp_dir + "/b"), ["year=2024/month=2"])._jdf.queryExecution().executedPlan().toString()
    pruned = re.search(r"PartitionFilters: \[(.*?)\], ", plan).group(1)
    assert "year" in pruned and "month" in pruned


def stamped(spark, *days):
    return make_bookings(spark, [{"project_nr": p, "booking_ts": dt.datetime(2024, 1, 1, 9) + dt.timedelta(days=d), "hours_billed": 1.5}
                                 for d in days for p in ("P", None if d % 5 == 0 else "Q") if p])


def test_late_rows_correct_a_week_and_replays_change_nothing(spark, tmp_dir):
    src, sink, ckpt = (os.path.join(tmp_dir, n) for n in ("in", "out", "ckpt"))

    def run():
        q = weekly.start_weekly_upserts(spark, src + "/*", ckpt, sink, max_files_per_trigger=1)
        q.awaitTermination(300)
        got = {(r.project_nr, r.week_start): r.hours for r in weekly.read_weekly_upserts(spark, sink).collect()}
        want = TR.weekly_totals(TR.booking_series(spark.read.parquet(src + "/*")), ["project_nr"])
        assert got == {(r.project_nr, r.week_start): r.hours for r in want.collect()}

    for name, days in (("a", (0, 1, 8, 90)), ("b", (91, 92))):
        stamped(spark, *days).coalesce(1).write.parquet(f"{src}/{name}")
    run()
    stamped(spark, 2, 9).coalesce(1).write.parquet(f"{src}/c")  # far behind what was seen
    run()
    total = rows(weekly.read_weekly_upserts(spark, sink))
    weekly.upsert_batch(spark.read.parquet(f"{src}/c"), 0, sink)  # a batch that is there is left alone
    assert rows(weekly.read_weekly_upserts(spark, sink)) == total
    done = f"{sink}/batch_id=0/_SUCCESS"
    os.remove(done)  # as after a writer that died: the replay writes the part anew
    part = spark.read.parquet(f"{src}/a") if rows(weekly.weekly_parts(spark.read.parquet(f"{src}/a"))) == rows(spark.read.parquet(f"{sink}/batch_id=0")) \
        else spark.read.parquet(f"{src}/b")
    weekly.upsert_batch(part, 0, sink)
    assert os.path.exists(done) and rows(weekly.read_weekly_upserts(spark, sink)) == total


PATTERNS = [r"promo", r"^a.c$", r"(?P<first_letter>.)(?P=first_letter)", r"end\Z", r"x{,2}y", r"a{b", r"[[]x", r"[a&&b]", r"[]a]", r"[^]a]", r"\bö\w+",
            r"(?i:ABC)d", r"(?s)a.c", r"(?m)^b", r"\d+", r"a(?#comment)b", r"(?:x|y)z", r"(a)(b)\2", r"(?<=a)b", r"(?!a)b", r"\101", r"}", r"\.",
            r"(?a:\w+)$", r"[\w.]+@[\w.]+", r"\s$", r"z++", r"\x41", r"a|", r"[a-c&-]"]
TEXTS = ["Promo", "abc", "a\nc", "a\rc", "aab", "the end", "end\n", "xxy", "y", "a{b", "[x", "a&b", "&", "]", "a", "öde", "ABCd", "a\nb", "٣", "ab", "yz", "abb",
         "cb", "A", "}", ".", "é", "me@x.org", "x\u2003", "zz", "", "a\u0085c", "straße"]


def test_patterns_match_in_python_and_spark_alike(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = frame.select("i", *(H.regex_contains("t", p).alias(f"p{k}") for k, p in enumerate(PATTERNS))).orderBy("i").collect()
    for k, p in enumerate(PATTERNS):
        want = [bool(re.search(p, t, re.IGNORECASE)) for t in TEXTS]
        assert [r[f"p{k}"] for r in got] == want, p


@pytest.mark.parametrize("pattern, word", [(r"(a)?(?(1)b|c)", "conditional"), (r"(?x) a b", "verbose")])
def test_syntax_without_a_counterpart_is_named(pattern, word):
    with pytest.raises(ValueError, match=word):
        to_java(pattern)

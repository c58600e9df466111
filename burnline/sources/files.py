"""File sources and sinks.

Every reader takes an explicit schema (no inference pass over the data) and
returns a DataFrame; every writer appends with Spark's writers. Nothing is
read into or written from the driver.
"""

from __future__ import annotations

import datetime as _dt
from typing import Optional

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import scalar as H
from ..operators.latest import latest_by_key
from . import store
from .store import path_exists

# Column names of the booking source table and their
# canonical names (see the schema table of the survey, section 1.2).
SOURCE_COLUMNS = {
    "Name": "employee",
    "Zeit": "hours_logged",
    "FaktStd": "hours_billed",
    "Projekt": "project",
    "ProjektNr": "project_nr",
    "Teilprojekt": "subproject",
    "Kostenstelle": "cost_center",
    "Verwendung": "activity",
    "Status": "status",
    "Kommentar": "comment",
    "Datum": "entry_date",
    "DatumBuchung": "booking_ts",
    "Monat": "month",
    "Jahr": "year",
    "VorgangsnummerSage": "erp_txn_no",
    "Kundenname": "customer",
    "ProjektleiterName": "project_lead",
}

_CANON_TYPES = {f.name: f.dataType for f in S.BOOKINGS_SCHEMA.fields}

#: Source file schema: every column read as text, typed in :func:`canonical_bookings`.
SOURCE_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in SOURCE_COLUMNS])


# Text forms of dates and timestamps besides ISO (fixed values).
LOCAL_DATE_FORMATS = ["dd.MM.yyyy", "dd.MM.yyyy HH:mm", "dd.MM.yyyy HH:mm:ss"]


def _typed(source: DataFrame, src: str) -> Column:
    """Column ``src`` in its canonical type; unparsable values become NULL.
    Text may carry a decimal comma or a dd.MM.yyyy date."""
    dtype, c = _CANON_TYPES[SOURCE_COLUMNS[src]], F.col(f"`{src}`")
    if not isinstance(source.schema[src].dataType, T.StringType):
        return c.try_cast(dtype)
    c = F.trim(c)
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        parsed = [F.try_to_timestamp(c), *(F.try_to_timestamp(c, F.lit(f)) for f in LOCAL_DATE_FORMATS)]
        return F.coalesce(*parsed).cast(dtype)  # session zone is UTC
    if isinstance(dtype, T.DoubleType):
        german = F.when(c.contains(","), F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(c)
        return german.try_cast(dtype)
    return F.col(f"`{src}`") if isinstance(dtype, T.StringType) else c.try_cast(dtype)


def canonical_bookings(source: DataFrame) -> DataFrame:
    """Rename source columns to canonical names and cast to canonical types
    (unparsable values become NULL, see :func:`rejected_bookings`). Columns
    that the source lacks are NULL; year and month come from the date then."""
    cols = {name: _typed(source, src) if src in source.columns else F.lit(None).cast(_CANON_TYPES[name])
            for src, name in SOURCE_COLUMNS.items()}
    for part, of in (("year", F.year), ("month", F.month)):
        cols[part] = F.coalesce(cols[part], of(cols["entry_date"]))
    return source.select(*(c.alias(name) for name, c in cols.items()))


def rejected_bookings(source: DataFrame) -> DataFrame:
    """Source rows with a value that :func:`canonical_bookings` cannot parse,
    and ``rejected_columns``, the source names of those columns."""
    bad = [F.when(F.col(f"`{c}`").isNotNull() & (F.trim(F.col(f"`{c}`")) != "") & _typed(source, c).isNull(), F.lit(c))
           for c in SOURCE_COLUMNS if c in source.columns]
    return (source.withColumn("rejected_columns", F.array_compact(F.array(*bad)))
            .filter(F.size("rejected_columns") > 0))


# A2 -------------------------------------------------------------------------
def run_sql(spark: SparkSession, text: str, params: Optional[dict] = None, **frames: DataFrame) -> DataFrame:
    """Parameterised SQL: named markers (``:name``) bound from ``params``
    (never string-interpolated), DataFrames referenced as ``{name}``."""
    return spark.sql(text, args=params or {}, **frames)


# A3 -------------------------------------------------------------------------
def read_bookings_csv_text(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """The file's own columns, in its order, as text: the header names them.
    All files of one read must have the same header (else the read fails)."""
    return (spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8")
            .option("enforceSchema", False).csv(path))


def read_bookings_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Separated values, UTF-8, header line, any of the source's columns in
    any order; typed into the canonical schema. Unparsable values are NULL
    here; ``rejected_bookings(read_bookings_csv_text(...))`` lists them."""
    return canonical_bookings(read_bookings_csv_text(spark, path, sep))


# A4 -------------------------------------------------------------------------
def read_bookings_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of booking records (one document per file)."""
    raw = spark.read.schema(SOURCE_SCHEMA).option("multiLine", True).json(path)
    return canonical_bookings(raw)


# A5 -------------------------------------------------------------------------
def load_or_build_aggregate(spark: SparkSession, aggregate_path: str, bookings: DataFrame) -> DataFrame:
    """Use a stored aggregate extract if its folder exists, else compute the
    compact aggregate (D1b) from the bookings, write it, and read it back. A
    folder that cannot be read is an error, never a reason to overwrite it."""
    from ..operators.dashboard import aggregate_bookings_compact
    if not path_exists(spark, aggregate_path):
        aggregate_bookings_compact(bookings).write.mode("error").parquet(aggregate_path)
    return spark.read.parquet(aggregate_path)


EXTRACT = "extract"
_STATES = T.StructType([T.StructField(n, T.StringType()) for n in ("project", "project_nr", "customer", "activity")]
                       + [T.StructField("hours", T.DoubleType()), T.StructField("entries", T.LongType()),
                          T.StructField("first_entry", T.DateType()), T.StructField("last_entry", T.DateType()),
                          T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())])


def _of_months(rows: DataFrame, months: list[str]) -> DataFrame:
    """Rows of these partition folders; the predicate is on the partition columns, so only their files are read."""
    def value(part: str) -> Column:
        name, text = part.split("=")
        return F.col(name).isNull() if text == "__HIVE_DEFAULT_PARTITION__" else F.col(name) == int(text)
    wanted = F.lit(False)
    for m in months:
        year, month = m.split("/")
        wanted = wanted | (value(year) & value(month))
    return rows.filter(wanted)


def refresh_aggregate(spark: SparkSession, bookings_path: str, extract_path: str, measure_col: str = S.DEFAULT_MEASURE) -> list[str]:
    """Bring the stored extract up to date with the month-partitioned bookings table
    (:func:`write_bookings_table`); returns the months done again.

    The extract holds mergeable states of D1b per month. Months whose files
    changed since the last refresh, by the listing of the folder, are read and
    written again, those only (dynamic partition overwrite); months that went,
    go. The listing is committed last: after a failure the next refresh does
    the same months again.
    """
    from ..operators.filters import measure
    now = store.partitions(spark, bookings_path, 2)
    _, last = store.last_entry(spark, extract_path, EXTRACT)
    known = (last or {}).get("months", {})
    changed = sorted(m for m in now if now[m] != known.get(m))
    gone = sorted(m for m in known if m not in now)
    if not changed and not gone:
        return []
    if changed:
        rows = _of_months(read_bookings_table(spark, bookings_path), changed)
        states = (rows.groupBy("project", "project_nr", "customer", "activity", "year", "month")
                  .agg(F.sum(measure(measure_col)).alias("hours"), F.count("employee").alias("entries"),
                       F.min("entry_date").alias("first_entry"), F.max("entry_date").alias("last_entry")))
        (states.select(*_STATES.names).hint("rebalance", "year", "month").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(extract_path))
        full = {f"year={_text(r.year)}/month={_text(r.month)}" for r in rows.select("year", "month").distinct().collect()}  # as many as the calendar has
        gone += [m for m in changed if m not in full]  # a month without rows writes nothing; what it had goes
    for m in gone:
        store.remove_folder(spark, f"{extract_path.rstrip('/')}/{m}")
    store.commit(spark, extract_path, EXTRACT, lambda _: {"months": now})
    return changed + [m for m in gone if m not in changed]


def _text(value: Optional[int]) -> str:
    return "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)


def read_aggregate_extract(spark: SparkSession, extract_path: str) -> DataFrame:
    """D1b from the states that :func:`refresh_aggregate` keeps."""
    states = spark.read.schema(_STATES).parquet(extract_path)
    return states.groupBy("project", "project_nr", "customer", "activity").agg(
        F.bround(F.sum("hours"), 2).alias("actual_hours"), F.sum("entries").alias("entry_count"),
        F.min("first_entry").alias("first_entry"), F.max("last_entry").alias("last_entry"))


# A8 / A9 / A10 --------------------------------------------------------------
_CORRUPT = "_corrupt"


def _file_name(path: Column) -> Column:
    """The name at the end of a URI, as it is on disk."""
    return F.url_decode(F.replace(F.regexp_extract(path, "[^/]*$", 0), F.lit("+"), F.lit("%2B")))


def _json_files(spark: SparkSession, schema: T.StructType, directory: str, glob: str) -> DataFrame:
    """The records of JSON files (one object each, pretty-printed allowed, or an array), with
    ``file_path``, ``file_name`` and the text of a record that does not fit the schema. Of an empty file, the names only."""
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType(), True)])
    rows = (spark.read.schema(wide).option("multiLine", True).option("columnNameOfCorruptRecord", _CORRUPT)
            .option("pathGlobFilter", glob).json(directory).select("*", F.col("_metadata.file_path").alias("file_path")))
    if empty := store.empty_files(spark, directory, glob):
        silent = spark.createDataFrame([(p, "") for p in empty], f"file_path string, {_CORRUPT} string")
        rows = rows.unionByName(silent, allowMissingColumns=True)
    return rows.withColumn("file_name", _file_name(F.col("file_path")))


def _target_defects() -> list[tuple[str, Column]]:
    return [("unreadable", F.col(_CORRUPT).isNotNull()),
            ("project missing", F.coalesce(F.length("project"), F.lit(0)) == 0),
            ("activity missing", F.coalesce(F.length("activity"), F.lit(0)) == 0),
            ("hours missing", F.col("target_hours").isNull())]


def _first_reason(defects: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in defects))


def read_target_files(spark: SparkSession, directory: str, glob: str = "targets_*.json") -> DataFrame:
    """Legacy target records, one JSON object per file (pretty-printed
    allowed). Unreadable files and records without project, activity or
    hours are skipped; :func:`rejected_target_files` lists them."""
    records = _json_files(spark, S.LEGACY_TARGET_SCHEMA, directory, glob)
    return records.filter(_first_reason(_target_defects()).isNull()).select(*S.LEGACY_TARGET_SCHEMA.names)


def rejected_target_files(spark: SparkSession, directory: str, glob: str = "targets_*.json") -> DataFrame:
    """(file_name, file_path, reason) of the legacy target files that
    :func:`read_target_files` skips, empty files included."""
    records = _json_files(spark, S.LEGACY_TARGET_SCHEMA, directory, glob)
    return (records.select("file_name", "file_path", _first_reason(_target_defects()).alias("reason"))
            .filter(F.col("reason").isNotNull()))


def latest_targets(records: DataFrame) -> DataFrame:
    """Last write wins per (project, activity), by ``timestamp``."""
    return latest_by_key(records.select("project", "activity", "target_hours", "timestamp"), ["project", "activity"], "timestamp")


def read_saved_targets(spark: SparkSession, directory: str) -> DataFrame:
    """Target records written by :func:`save_targets`."""
    return _saved(spark, directory, S.LEGACY_TARGET_SCHEMA)


def _saved(spark: SparkSession, directory: str, schema: T.StructType) -> DataFrame:
    files, _ = store.live_files(spark, directory)
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _compact_saved(spark: SparkSession, directory: str, schema: T.StructType, keys: list[str], stamp: str) -> bool:
    names = list(store.list_files(spark, directory, ".parquet"))  # before the records are read: later ones stay live
    latest = latest_by_key(_saved(spark, directory, schema), keys, stamp).select(*schema.names)
    return store.compact(spark, directory, latest.coalesce(max(1, len(names) // 1000)), names)


def compact_targets(spark: SparkSession, directory: str) -> bool:
    """Put the latest saved target of each key in a snapshot that readers take instead of the files it was read
    from. Files appended meanwhile stay beside it; what it stands for goes with :func:`burnline.sources.store.vacuum`."""
    return _compact_saved(spark, directory, S.LEGACY_TARGET_SCHEMA, ["project", "activity"], "timestamp")


def compact_overrides(spark: SparkSession, directory: str) -> bool:
    """As :func:`compact_targets`, for the override records."""
    return _compact_saved(spark, directory, S.OVERRIDE_SCHEMA, ["project_nr", "activity"], "updated_at")


def load_legacy_targets(spark: SparkSession, directory: str, glob: str = "targets_*.json") -> DataFrame:
    """The latest target per key, of the legacy files (one JSON object each)
    and the records saved next to them."""
    return latest_targets(read_target_files(spark, directory, glob).unionByName(read_saved_targets(spark, directory)))


def load_targets(spark: SparkSession, as_of: _dt.date, ledger: Optional[DataFrame] = None,
                 directory: Optional[str] = None) -> DataFrame:
    """Targets (project_nr, activity, budget_hours) at ``as_of``: the ledger's
    balances where a ledger is given and has entries, else the legacy files'."""
    from ..operators.ledger import budgets_at
    if ledger is not None and (directory is None or not ledger.isEmpty()):
        return budgets_at(ledger, as_of).select("project_nr", "activity", "budget_hours")
    if directory is None:
        raise ValueError("give a ledger or a folder of target files")
    return load_legacy_targets(spark, directory).select(
        F.col("project").alias("project_nr"), "activity", F.col("target_hours").alias("budget_hours"))


def save_targets(records: DataFrame, directory: str) -> None:
    """Append target records (project, activity, target_hours, timestamp) as
    Parquet; readers take the latest per key, so this is an upsert without rewrite."""
    store.append_files(records.select("project", "activity", F.col("target_hours").cast("double"), F.col("timestamp").cast("string")), directory)


def valid_targets(latest: DataFrame, as_of: _dt.datetime, hours: int = 24) -> DataFrame:
    """Targets whose timestamp is less than ``hours`` old at ``as_of``."""
    ts = F.try_to_timestamp(F.col("timestamp")).cast("timestamp_ntz")
    limit = F.lit(as_of).cast("timestamp_ntz")
    return latest.filter(F.timestamp_diff("SECOND", ts, limit) < hours * 3600)


# A11 ------------------------------------------------------------------------
OVERRIDE_FILES = "forecast_*.json"  # fixed: forecast_<project>.json, forecast_<project>_<activity>.json


def resolve_override_files(spark: SparkSession, directory: str, known: Optional[DataFrame] = None,
                           glob: str = OVERRIDE_FILES) -> DataFrame:
    """The legacy override files with the key each stands for.

    A record's own ``project_nr`` counts first. Else the key is in the file's
    name, and as projects and activities may hold underscores themselves, the
    name is looked up among the names that the ``known`` (project_nr,
    activity) pairs, and their projects, would give: one equi-join on the name.

    Columns of the override schema, ``file_name``, ``file_path`` and ``status``:
    ``explicit`` or ``resolved``; ``ambiguous`` (several keys give this name),
    ``unknown`` (none does), ``unreadable`` or ``incomplete`` (no hours).
    """
    found = _json_files(spark, S.OVERRIDE_SCHEMA, directory, glob).withColumn("_stem", F.regexp_extract("file_name", r"^forecast_(.*)\.json$", 1))
    if known is None:
        known = spark.createDataFrame([], "project_nr string, activity string")
    pairs = known.select("project_nr", "activity").filter(F.col("project_nr").isNotNull())
    keys = pairs.unionByName(pairs.select("project_nr", F.lit(None).cast("string").alias("activity"))).distinct()
    names = keys.groupBy(F.concat_ws("_", "project_nr", "activity").alias("_stem")).agg(
        F.count(F.lit(1)).alias("_keys"), F.min(F.struct("project_nr", "activity")).alias("_key"))
    rows = found.join(names, "_stem", "left")
    own = ~H.is_blank("project_nr")
    status = F.coalesce(F.when(F.col(_CORRUPT).isNotNull(), F.lit("unreadable")),
                        F.when(F.col("hours_per_sprint").isNull(), F.lit("incomplete")), F.when(own, F.lit("explicit")),
                        F.when(F.col("_keys") == 1, F.lit("resolved")), F.when(F.col("_keys") > 1, F.lit("ambiguous")), F.lit("unknown"))
    rows = rows.withColumn("status", status)
    by_name = F.col("status") == "resolved"
    keyed = {c: F.when(by_name, F.col(f"_key.{c}")).otherwise(F.col(c)) for c in ("project_nr", "activity")}
    return rows.withColumns(keyed).select(*S.OVERRIDE_SCHEMA.names, "file_name", "file_path", "status")


def read_overrides(spark: SparkSession, directory: str, known: Optional[DataFrame] = None, glob: str = "*.json") -> DataFrame:
    """Forecast override records with their (project_nr, activity) keys: the
    legacy files (:func:`resolve_override_files`, whose ``known`` pairs
    resolve keys that only the file's name holds) and the records of
    :func:`save_overrides`. Files without a key are left out;
    :func:`unresolved_override_files` lists them."""
    legacy = resolve_override_files(spark, directory, known, glob).filter(F.col("status").isin("explicit", "resolved"))
    return legacy.select(*S.OVERRIDE_SCHEMA.names).unionByName(_saved(spark, directory, S.OVERRIDE_SCHEMA))


def unresolved_override_files(spark: SparkSession, directory: str, known: Optional[DataFrame] = None,
                              glob: str = "*.json") -> DataFrame:
    """(file_name, file_path, status) of the override files that :func:`read_overrides` leaves out."""
    rows = resolve_override_files(spark, directory, known, glob)
    return rows.filter(~F.col("status").isin("explicit", "resolved")).select("file_name", "file_path", "status")


def save_overrides(records: DataFrame, directory: str) -> None:
    """Append override records as Parquet; readers keep the latest per key."""
    store.append_files(records.select(*[F.col(f.name).cast(f.dataType) for f in S.OVERRIDE_SCHEMA.fields]), directory)


# A15 ------------------------------------------------------------------------
def read_entitlements(spark: SparkSession, path: str) -> DataFrame:
    """``users: map<email, struct<projects, permissions>>`` and defaults."""
    return spark.read.schema(S.ENTITLEMENT_SCHEMA).option("multiLine", True).json(path)


# Bookings table partitioned by month -----------------------------------------
def write_bookings_table(bookings: DataFrame, path: str, max_records_per_file: int = 5_000_000) -> None:
    """Store bookings partitioned by (year, month) of ``entry_date``, rows
    ordered by project within each file so Parquet min/max statistics also
    skip row groups for project filters. The rebalance gathers a month's rows
    in as few tasks as their size needs, so the number of files follows the
    data, and splits a busy month over several."""
    (bookings.hint("rebalance", "year", "month").sortWithinPartitions("year", "month", "project_nr", "entry_date")
     .write.mode("overwrite").partitionBy("year", "month")
     .option("maxRecordsPerFile", max_records_per_file).parquet(path))


def read_bookings_table(spark: SparkSession, path: str) -> DataFrame:
    """The partitioned bookings table with the canonical schema."""
    return spark.read.schema(S.BOOKINGS_SCHEMA).parquet(path).select(*[f.name for f in S.BOOKINGS_SCHEMA.fields])


# B2 / C4 --------------------------------------------------------------------
_PART = "project_part_of_"  # and the number of parts: a table says itself how it was cut


def _project_part(parts: int) -> Column:
    return F.pmod(F.xxhash64("project_nr"), F.lit(parts)).cast("int")


def write_bookings_by_project(bookings: DataFrame, path: str, parts: int = 256, max_records_per_file: int = 5_000_000) -> None:
    """Store bookings in ``parts`` folders by a hash of ``project_nr``, ordered by project within each file, for readers
    that want few of many projects. The rebalance splits a part with a busy project over several tasks."""
    part = f"{_PART}{parts}"
    (bookings.select(*S.BOOKINGS_SCHEMA.names, _project_part(parts).alias(part)).hint("rebalance", part)
     .sortWithinPartitions(part, "project_nr", "entry_date").write.mode("overwrite").partitionBy(part)
     .option("maxRecordsPerFile", max_records_per_file).parquet(path))


def read_bookings_of(spark: SparkSession, path: str, codes: DataFrame) -> DataFrame:
    """The bookings of the projects among ``codes`` (a ``project_nr`` column), from :func:`write_bookings_by_project`.

    The semi join is on the part as well as on the code, so where ``codes`` is a filtered frame that Spark finds small
    enough to broadcast, only the folders of its codes are listed and read (dynamic partition pruning); a larger one is
    joined as any. NULL codes match nothing; an empty table gives no rows."""
    folders = store.partitions(spark, path, 1)
    if not folders:
        return spark.createDataFrame([], S.BOOKINGS_SCHEMA)
    part = min(folders).split("=", 1)[0]
    schema = T.StructType([*S.BOOKINGS_SCHEMA.fields, T.StructField(part, T.IntegerType(), True)])
    wanted = codes.select("project_nr", _project_part(int(part.removeprefix(_PART))).alias(part))
    rows = spark.read.schema(schema).parquet(path).join(wanted, [part, "project_nr"], "left_semi")
    return rows.select(*S.BOOKINGS_SCHEMA.names)


def read_entitled_bookings(spark: SparkSession, path: str, entitlements: DataFrame, email: str) -> DataFrame:
    """C4: a user's bookings, read from the folders of the user's projects only."""
    from ..operators.filters import user_projects
    return read_bookings_of(spark, path, user_projects(entitlements).filter(F.col("email") == F.lit(email)).select("project_nr"))


# A6 / A7 --------------------------------------------------------------------
_STORED = T.StructType([*S.LEDGER_SCHEMA.fields, T.StructField("batch", T.StringType(), True)])
_COMMIT = "batch string, first_id bigint, rows bigint"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The budget ledger as written by :func:`burnline.operators.ledger.append_entries`.

    Rows of a batch are numbered within it; the batch's commit says where its
    numbers begin. Rows of a batch without a commit are not part of the
    ledger. Rows without a batch have their final numbers."""
    return _numbered(spark, path, *store.live_files(spark, path)).select(*S.LEDGER_SCHEMA.names)


def _numbered(spark: SparkSession, path: str, files: list[str], upto: int) -> DataFrame:
    rows = spark.read.schema(_STORED).parquet(*files) if files else spark.createDataFrame([], _STORED)
    log = store.commits_after(spark, path, upto)
    commits = spark.read.schema(_COMMIT).json(log) if log else spark.createDataFrame([], _COMMIT)
    known = rows.join(commits.select("batch", "first_id"), "batch", "left").filter("batch IS NULL OR first_id IS NOT NULL")
    return known.withColumn("entry_id", F.col("entry_id") + F.coalesce(F.col("first_id") - 1, F.lit(0)))


def compact_ledger(spark: SparkSession, path: str) -> bool:
    """Put the committed rows, with their final numbers, in a snapshot. Files of batches that are
    not committed yet are not part of it. False if another compaction came first."""
    upto, _ = store.last_entry(spark, path, store.APPEND)
    files, before = store.live_files(spark, path)
    log = [p for p in store.commits_after(spark, path, before) if p <= store.entry_path(path, store.APPEND, upto)]
    rows = spark.read.schema(_STORED).parquet(*files).withColumn("file", F.col("_metadata.file_name"))
    commits = spark.read.schema(_COMMIT).json(log) if log else spark.createDataFrame([], _COMMIT)
    known = rows.join(commits.select("batch", "first_id"), "batch", "left").filter("batch IS NULL OR first_id IS NOT NULL")
    covered = [r[0] for r in known.select("file").distinct().collect()]  # one name per append since the last snapshot
    final = known.withColumn("entry_id", F.col("entry_id") + F.coalesce(F.col("first_id") - 1, F.lit(0)))
    final = final.withColumn("batch", F.lit(None).cast("string")).select(*_STORED.names)
    return store.compact(spark, path, final.coalesce(max(1, len(covered) // 1000)), covered, upto)

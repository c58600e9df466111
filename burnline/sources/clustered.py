"""Tables clustered by key: what the ledger's indexes are for.

Rows are stored in buckets by a hash of their keys and sorted within each, so that
aggregates, windows and unions by those keys read them without a shuffle. A bucket is
read by one task, so only rows that a key has a bounded number of belong here, such as a
ledger's day totals (``operators.ledger.ledger_days``), not the entries themselves: a key
with a third of all entries has as many rows as days.
"""

from __future__ import annotations

import uuid
from typing import Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import store

_FOLDER = "buckets="


def write_clustered(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (),
                    buckets: Optional[int] = None) -> DataFrame:
    """Store ``rows`` in a new folder ``path`` in ``buckets`` by ``keys`` (as many as the session's shuffle partitions, if
    not given), sorted by keys and ``order``, one file each; and read them. An existing table is an error."""
    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _new_name()
    (rows.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys, *order)
     .option("path", f"{path}/{_FOLDER}{n}").saveAsTable(name))
    return spark.table(name)


def read_clustered(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The table of :func:`write_clustered` in any later session, with its buckets."""
    folders = store.partitions(spark, path, 1)
    if len(folders) != 1:
        raise ValueError(f"{path} holds {len(folders)} clustered tables")
    folder = min(folders)
    name, quoted = _new_name(), [f"`{k}`" for k in keys]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(quoted)}) "
              f"SORTED BY ({', '.join([*quoted, *(f'`{o}`' for o in order)])}) INTO {int(folder.removeprefix(_FOLDER))} BUCKETS "
              f"LOCATION '{path}/{folder}'")
    return spark.table(name)


def _new_name() -> str:
    return f"burnline_{uuid.uuid4().hex[:16]}"

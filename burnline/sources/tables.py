"""Readers for the driver's Parquet tables.

Each reader selects only the columns it needs, so the Parquet scan's
``ReadSchema`` is pruned and filters written after it reach the scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_AS_OF = _dt.datetime(2001, 6, 30)

TPCH_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]


# Stored column types of the driver tables this package reads. With an
# explicit schema a reader needs no footer read at planning time, and a
# schema of only the needed columns prunes the scan.
_TYPES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
             "p_retailprice double"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
}
_ATOMS = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
          "string": T.StringType(), "timestamp_ntz": T.TimestampNTZType()}
DRIVER_SCHEMAS = {
    name: T.StructType([T.StructField(col, _ATOMS[typ], True)
                        for col, typ in (field.split() for field in ddl.split(","))])
    for name, ddl in _TYPES.items()
}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = DRIVER_SCHEMAS.get(name)
    if schema is None:
        df = spark.read.parquet(path)
        return df.select(*columns) if columns else df
    if columns:
        schema = T.StructType([schema[c] for c in columns])
    return spark.read.schema(schema).parquet(path)


def ts_ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal (driver timestamps are zone-less)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        text = value.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(value)
    return F.to_timestamp_ntz(F.lit(text))


def date_lit(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        value = value.date()
    return F.lit(value).cast("date") if isinstance(value, _dt.date) else F.to_date(F.lit(str(value)))

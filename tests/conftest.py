from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from burnline import schemas as S  # noqa: E402
from burnline.session import build_session, ensure_checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("burnline-tests", master="local[4]", shuffle_partitions=8)
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="burnline-test-")


def make_bookings(spark, rows):
    """Canonical bookings frame from dicts (missing columns are NULL)."""
    names = [f.name for f in S.BOOKINGS_SCHEMA.fields]
    defaults = {"project_nr": "P1", "entry_date": dt.date(2024, 1, 15)}
    data = [tuple({**defaults, **r}.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, S.BOOKINGS_SCHEMA)


def make_ledger(spark, rows):
    """Ledger frame from dicts; hours given as numbers."""
    from decimal import Decimal
    names = [f.name for f in S.LEDGER_SCHEMA.fields]
    defaults = {"reason": "r", "change_type": "initial", "created_by": "a@example.com",
                "created_at": dt.datetime(2024, 1, 1, 10, 0)}
    data = []
    for i, r in enumerate(rows):
        row = {**defaults, "entry_id": i + 1, **r}
        row["hours"] = Decimal(str(row["hours"])).quantize(Decimal("0.01"))
        data.append(tuple(row.get(n) for n in names))
    return spark.createDataFrame(data, S.LEDGER_SCHEMA)


def ts(*args):
    return dt.datetime(*args)

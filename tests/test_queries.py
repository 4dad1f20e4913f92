"""The registered queries as the driver sees them."""

from __future__ import annotations

import __spark_entry__ as entry
from inkledger.vocabulary import ROLE_ALIASES


def test_registry_is_consistent():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert len(names) > 100 and ROLE_ALIASES


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert sum(r["n_rows"] for r in rows) == 1500

"""Rows of delimited text are cut once, however many steps read them."""

from __future__ import annotations

from inkledger.sources import delimited


def test_rows_are_cut_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("UWI,NOTE\n1,x\n\n2,\"y\nz\"\n3,w\n")
    rows = delimited.read_records(spark, str(tmp_path), ["UWI", "NOTE"], delimited.Dialect())
    assert "MapInArrow" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["import_row"], r["UWI"], r["NOTE"]) for r in rows.collect()) == [(2, "1", "x"), (3, "2", "y\nz"), (4, "3", "w")]

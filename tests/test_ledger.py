"""Ledger, labels, commits and subsets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkledger.operators import commits, labels, ledger, subsets
from inkledger.sources import sinks, versions
from inkledger.streaming import commits as stream


def old_sheet(spark):
    return spark.createDataFrame(
        [(0, "a.tif", "yes", "IHS", "", "42", "/x/a.tif", "2024-01-01 10:00:00"),
         (1, "", "", "", "", "", "/x/b.tif", ""),
         (2, "A.TIF", "no", "", "late", "43", "/x/A.TIF", "2024-01-02 10:00:00"),
         (3, "", "", "", "", "", "", "")],
        "position long, file_link string, HAS_STAMP string, type_of_stamp string, notes string, api14 string, file_path string, reviewed_at string",
    )


def test_conform_old_sheet(spark):
    rows = {r["file_key"]: r for r in ledger.conform(old_sheet(spark)).collect()}
    assert set(rows) == {"a.tif", "b.tif"}
    assert (rows["a.tif"]["has_stamp"], rows["a.tif"]["log_api"], rows["a.tif"]["log_types"]) == (False, "43", "")
    assert ledger.missing_columns(["file_link"])[-1].startswith("log_api")


def test_validation(spark):
    rows = spark.createDataFrame(
        [(2, "a.tif", "maybe", ""), (3, "A.tif", "no", "IHS"), (4, "", "yes", ""), (5, "", "", ""), (6, "b.tif", "yes", "IHS")],
        "row_number long, file_link string, has_stamp string, type_of_stamp string",
    )
    found = [(r["row_number"], r["rule"]) for r in ledger.first_issues(ledger.row_issues(rows)).collect()]
    assert found == [(2, "3_verdict"), (3, "2_duplicate"), (3, "4_no_with_type"), (4, "1_nameless")]


def test_labels(spark):
    catalog = spark.createDataFrame([(0, "IHS"), (1, "TWDB"), (2, "Riley")], "position long, label string")

    def listed(df):
        return [r["label"] for r in df.orderBy("position").collect()]

    assert listed(labels.rename_in_catalog(catalog, "twdb", "IHS")) == ["IHS", "Riley"]
    assert listed(labels.rename_in_catalog(catalog, "twdb", "New")) == ["IHS", "New", "Riley"]
    assert listed(labels.rename_in_catalog(catalog, "twdb")) == ["IHS", "Riley"]
    assert listed(labels.add_label(catalog, "riley")) == ["IHS", "TWDB", "Riley"]
    with pytest.raises(ValueError):
        labels.add_label(catalog, "a,b")


def test_replace_label_counts(spark):
    rows = spark.createDataFrame(
        [("a", True, "IHS, TWDB"), ("b", True, "ihs"), ("c", True, "TWDB"), ("d", None, "")],
        "file_key string, has_stamp boolean, stamp_type string",
    ).withColumns({"reviewed_at": F.lit("t"), "reviewed_by": F.lit("x")})
    gone = labels.replace_label(rows, "IHS")
    assert tuple(labels.change_counts(gone).first()) == (2, 1)
    merged = {r["file_key"]: r["stamp_type"] for r in labels.replace_label(rows, "ihs", "TWDB").collect()}
    assert merged == {"a": "TWDB", "b": "TWDB", "c": "TWDB", "d": ""}


def fold(rows):
    """One commit after another, as a single reviewer's window would apply them."""
    table = {}
    for c in sorted(rows, key=lambda r: (r["reviewed_at"], r["commit_id"])):
        types = c["stamp_types"]
        if not c["reviewed_by"]:
            continue
        if c["has_stamp"] and (not types or "" in types or len({t.lower() for t in types}) < len(types)):
            continue
        state = (c["has_stamp"], ", ".join(types) if c["has_stamp"] else "", c["notes"])
        key = c["file_name"].lower()
        if state != table.get(key, ((None, "", ""), None))[0]:
            table[key] = (state, c["commit_id"])
    return {k: (*s, i) for k, (s, i) in table.items()}


SCHEMA = "commit_id long, file_name string, has_stamp boolean, stamp_types array<string>, log_types array<string>, notes string, reviewed_at long, reviewed_by string"


def random_commits(n=400):
    rng = random.Random(5)
    return [
        {"commit_id": i, "file_name": rng.choice(["a.tif", "A.tif", "b.tif", "c.tif"]), "has_stamp": rng.choice([True, False, None]),
         "stamp_types": rng.choice([["IHS"], ["IHS", "ihs"], [], ["X", "Y"]]), "log_types": [], "notes": rng.choice(["", "n"]),
         "reviewed_at": rng.randrange(60), "reviewed_by": rng.choice(["R", "R", ""])}
        for i in range(n)
    ]


def edits_as_dict(df):
    return {r["file_key"]: (r["has_stamp"], r["stamp_type"], r["notes"], r["commit_id"]) for r in df.collect()}


def test_latest_edits_equal_a_sequential_fold(spark):
    for n in (3, 12, 400):
        rows = random_commits(n)
        assert edits_as_dict(commits.latest_edits(spark.createDataFrame(rows, SCHEMA))) == fold(rows)


def test_stream_equals_batch_and_repeats(spark, tmp_path):
    rows = spark.createDataFrame(random_commits(), SCHEMA)
    target = str(tmp_path / "t")
    body = stream.upsert_batch(target, buckets=4)
    for batch_id, part in enumerate((2, 0, 1)):
        piece = rows.filter(F.col("commit_id") % 3 == part)
        body(piece, batch_id)
        body(piece, batch_id)
    assert edits_as_dict(stream.current(spark, target)) == edits_as_dict(commits.latest_edits(rows))


@pytest.mark.parametrize("size", [1, 7, 60])
def test_live_commits_are_enough(spark, size):
    """Whatever comes later, the live commits of the first part decide as all of it would."""
    rows = random_commits(180)
    random.Random(size).shuffle(rows)
    kept, want = None, None
    for at in range(0, 180, 60):
        table = spark.createDataFrame(rows[at:at + 60], SCHEMA)
        merged = table if kept is None else table.unionByName(spark.createDataFrame(kept, SCHEMA))
        kept = [r.asDict() for r in commits.live_commits(merged).collect()]
        assert edits_as_dict(commits.latest_edits(spark.createDataFrame(kept, SCHEMA))) == fold(rows[:at + 60])
    assert len(kept) < 60
    late = rows[:size]
    again = commits.live_commits(spark.createDataFrame(kept + late, SCHEMA).dropDuplicates(["commit_id"]))
    assert edits_as_dict(commits.latest_edits(again)) == fold(rows)


def test_state_does_not_grow_with_the_log(spark, tmp_path):
    """300 commits in 6 batches leave a few rows, with and without forgetting settled ones."""
    rows = [{"commit_id": i, "file_name": f"{i % 3}.tif", "has_stamp": False, "stamp_types": [], "log_types": [],
             "notes": "same" if i > 150 else f"n{i % 5}", "reviewed_at": i, "reviewed_by": "R"} for i in range(300)]
    want = fold(rows)
    for lateness, most in ((None, 160), (10.0, 20)):
        target = str(tmp_path / f"t{most}")
        body = stream.upsert_batch(target, buckets=2, lateness=lateness)
        for b in range(6):
            body(spark.createDataFrame(rows[b * 50:b * 50 + 50], SCHEMA), b)
            assert stream.stored_commits(spark, target).count() <= most
        assert edits_as_dict(stream.current(spark, target)) == want
        assert len(list((tmp_path / f"t{most}" / "versions").glob("*.json"))) == 2
    # The unchanged draft is credited to its first commit even after the rest is forgotten.
    assert {k: v[-1] for k, v in want.items()} == {"0.tif": 153, "1.tif": 151, "2.tif": 152}


def test_two_tables_change_at_once(spark, tmp_path):
    root = str(tmp_path / "store")
    one, two = spark.range(3).toDF("a"), spark.range(5).toDF("b")
    assert versions.read_table(spark, root, "ledger") is None
    assert versions.write_tables(spark, root, {"ledger": one, "subset": two}) == 1

    def counts(number=None):
        return [versions.read_table(spark, root, t, number).count() for t in ("ledger", "subset")]

    failing = two.select(F.raise_error(F.lit("disk")).alias("b"))
    with pytest.raises(Exception, match="disk"):
        versions.write_tables(spark, root, {"ledger": spark.range(9).toDF("a"), "subset": failing})
    assert counts() == [3, 5]
    assert len(list((tmp_path / "store" / "data").iterdir())) == 2  # what was written is gone
    assert versions.write_tables(spark, root, {"ledger": spark.range(9).toDF("a")}) == 2
    assert counts() == [9, 5] and counts(1) == [3, 5]
    with pytest.raises(versions.VersionConflict):
        versions.publish(spark, root, 1, {})
    assert counts() == [9, 5]
    versions.write_tables(spark, root, {"subset": spark.range(1).toDF("b")})
    assert versions.expire(spark, root, keep=2) == 1 and counts() == [9, 1] and counts(2) == [9, 5]


def test_failed_save_keeps_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "review")
    table = ledger.conform(old_sheet(spark))
    sinks.save_ledger(table, path)

    def fail(*_):
        raise OSError("disk")

    monkeypatch.setattr(sinks, "swap_in", fail)
    with pytest.raises(OSError):
        sinks.save_ledger(table.filter("file_key = 'a.tif'"), path)
    assert sinks.load_ledger(spark, path).count() == 2
    assert sinks.load_ledger(spark, str(tmp_path / "none")) is None


def test_label_files(spark, tmp_path):
    assert [r["label"] for r in sinks.load_labels(spark, str(tmp_path / "none.json")).collect()] == ["IHS"]
    (tmp_path / "broken.json").write_text("{")
    assert [r["label"] for r in sinks.load_labels(spark, str(tmp_path / "broken.json")).collect()] == ["IHS"]
    (tmp_path / "t.json").write_text('{"types": ["IHS", " TWDB ", "ihs", ""]}')
    assert [r["label"] for r in sinks.load_labels(spark, str(tmp_path / "t.json")).orderBy("position").collect()] == ["IHS", "TWDB"]


def test_merge_and_order(spark):
    stored = ledger.conform(old_sheet(spark))
    files = spark.createDataFrame(
        [("/new/A.tif", "99", False, "7"), ("/new/c.tif", "5", True, "")],
        "path string, identifier string, from_manifest boolean, log_top_depth string",
    )
    rows = {r["file_key"]: r for r in ledger.merge_files(stored, files).collect()}
    assert (rows["a.tif"]["log_api"], rows["a.tif"]["file_path"], rows["a.tif"]["log_top_depth"]) == ("43", "/new/A.tif", "7")
    assert (rows["c.tif"]["log_api"], rows["c.tif"]["has_stamp"], rows["c.tif"]["notes"]) == ("5", None, "")
    assert rows["b.tif"]["file_path"] == "/x/b.tif"


def test_subset_header():
    good = ["log_api", "file_link", "has_stamp", "type_of_stamp", "log_types", "notes", "reviewed_at", "reviewed_by", "file_path"]
    assert subsets.header_ok(good + ["latitude"]) and not subsets.header_ok(good[::-1])
    assert subsets.is_legacy(["Position", "log_api"])

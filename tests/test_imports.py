"""Manifest import cases: each is a small manifest with its expected audit."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from inkledger.functions.depth import DepthFilter
from inkledger.operators.manifest import ColumnSelectionRequired, ManifestError, ManifestRoles, detect_roles
from inkledger.operators.skew import salted_join
from inkledger.plans.manifest_import import ManifestImport
from inkledger.sources import manifests, sinks


def run(spark, rows, columns="UWI string, TIFPATH string", catalog=(), readable=(), broken=(), roots=None, depth=None, directory="/m"):
    names = [part.split()[0] for part in columns.split(", ")]
    table = spark.createDataFrame([(i + 2, *row) for i, row in enumerate(rows)], "import_row long, " + columns)
    files = spark.createDataFrame([(p, i) for i, p in enumerate(catalog)], "path string, folder_seq long")
    probe = spark.createDataFrame(
        [(p, True, True, "") for p in readable] + [(p, True, False, "broken TIFF") for p in broken],
        "path string, path_exists boolean, readable boolean, detail string",
    )
    known = None if roots is None else spark.createDataFrame(roots, "root string, available boolean, detail string")
    return ManifestImport(table, detect_roles(names), files if catalog else None, probe, known, depth, directory)


def statuses(plan):
    return [r["load_status"] for r in plan.audit.orderBy("import_row").select("load_status").collect()]


def paths(plan):
    return [r["path"] for r in plan.files.orderBy("id_rank", "phase", "seq").collect()]


def test_folder_first_then_listed(spark):
    listed, second = "/ext/21441_RES.tif", "/ext/21441_GR.tif"
    plan = run(
        spark, [("21441", listed), ("21441", second), ("21441", listed), ("21441", "IHS ASSOC IMAGE")],
        catalog=["/local/21441_RES.tif"], readable=[listed, second],
    )
    assert statuses(plan) == ["loaded_from_selected_folder", "recovered_from_listed_path", "loaded_from_selected_folder", "placeholder_covered"]
    assert paths(plan) == ["/local/21441_RES.tif", second]
    s = plan.statistics.first()
    assert (s["loaded_tiffs"], s["loaded_from_folder"], s["recovered_from_paths"], s["duplicate_references"], s["placeholder_covered"]) == (2, 1, 1, 1, 1)


def test_intervals_follow_each_file(spark):
    plan = run(
        spark, [("21441", "/a/21441_GR.tif", "100", "500"), ("21441", "/a/21441_RES.tif", "450", "900")],
        "API string, TIFPATH string, DEPTH1 string, DEPTH2 string", readable=["/a/21441_GR.tif", "/a/21441_RES.tif"],
    )
    got = {r["path"]: (r["log_top_depth"], r["log_bottom_depth"]) for r in plan.files.collect()}
    assert got == {"/a/21441_GR.tif": ("100", "500"), "/a/21441_RES.tif": ("450", "900")}


def test_dead_share(spark):
    plan = run(spark, [("1", r"\\server\share\1.tif"), ("2", r"\\server\share\2.tif")], roots=[(r"\\server\share", False, "gone")])
    assert statuses(plan) == ["network_unavailable_unresolved"] * 2
    s = plan.statistics.first()
    assert (s["unavailable_network_shares"], s["network_paths_skipped"]) == (1, 2)
    assert plan.audit.select("detail").distinct().collect()[0][0] == "gone"


def test_depth_filter_rows(spark):
    rows = [("1", "/d/1.tif", "199.9"), ("2", "/d/2.tif", "200"), ("3", "/d/3.tif", "250"), ("4", "/d/4.tif", "")]
    files = [r[1] for r in rows]
    columns = "API string, TIFPATH string, DEPTH1 string"
    plan = run(spark, rows, columns, readable=files, depth=DepthFilter("DEPTH1", "less_than", 200.0))
    assert statuses(plan) == ["recovered_from_listed_path", "filtered_depth", "filtered_depth", "filtered_blank_depth"]
    s = plan.statistics.first()
    assert (s["depth_filtered_rows"], s["depth_filtered_identifiers"]) == (3, 3)
    assert plan.audit.filter("import_row = 4").first()["detail"] == "Depth 250 ft does not satisfy < 200 ft."
    plan = run(spark, rows, columns, readable=files, depth=DepthFilter("DEPTH1", "less_than", 200.0, True))
    assert [r[0] for r in plan.loaded_identifiers.orderBy("id_rank").select("identifier").collect()] == ["1", "4"]


def test_failure_kinds(spark):
    plan = run(
        spark, [("1", "/x/missing.tif"), ("2", "/x/bad.tif"), ("3", "IHS ASSOC IMAGE"), ("4", "not-an-image"), ("5", "/x/dir/"), ("x", "a.tif")],
        broken=["/x/bad.tif"],
    )
    assert statuses(plan) == [
        "path_missing_unresolved", "unreadable_image_unresolved", "placeholder_unresolved",
        "unsupported_image_path_unresolved", "path_missing_unresolved", "invalid_identifier",
    ]
    assert plan.statistics.first()["unrecovered_identifiers"] == 5


def test_twelve_digit_folder_match_and_conflict(spark):
    plan = run(spark, [("424693343100", "")], catalog=["/f/42469334310000_log.tif"])
    row = plan.audit.first()
    assert (row["load_status"], row["resolved_tif_path"]) == ("loaded_from_selected_folder", "/f/42469334310000_log.tif")
    plan = run(spark, [("1", "/one/same.tif"), ("2", "/two/same.tif")], readable=["/one/same.tif", "/two/same.tif"])
    assert statuses(plan) == ["recovered_from_listed_path", "basename_conflict_unresolved"]
    assert plan.audit.filter("import_row = 3").first()["detail"].endswith("identifier 1.")


def test_relative_and_second_path(spark):
    plan = run(spark, [("21441", "images/21441.tif"), ("21441", "/other/21441.tif")], readable=["/m/images/21441.tif"])
    assert statuses(plan) == ["recovered_from_listed_path", "duplicate_reference_loaded"]


def test_last_failure_is_reported(spark):
    plan = run(spark, [("1", "/a/1_x.tif"), ("1", "/b/1_x.tif"), ("1", "/A/1_x.tif")], broken=["/b/1_x.tif"])
    assert statuses(plan) == ["unreadable_image_unresolved"] * 3


def test_hot_keys_give_the_same_join(spark):
    left = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    plain = left.join(right, "k").agg(F.sum("top"), F.count(F.lit(1))).first()
    salted = salted_join(left, right, ["k"], "inner", "n", hot_rows=100, salts=5)
    assert salted.agg(F.sum("top"), F.count(F.lit(1))).first() == plain
    unmatched = salted_join(left, right.filter("k < 1000"), ["k"], "left", "n", hot_rows=100, salts=5)
    assert unmatched.count() == 3000


# ------------------------------------------------------------------------ readers

def test_text_list_with_bom(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("21441\n\n22536\n42175000720000\n", encoding="utf-8-sig")
    table = manifests.read_source(spark, str(tmp_path / "ids.txt"))
    rows = table.orderBy("import_row").select("import_row", "input_value").collect()
    assert [tuple(r) for r in rows] == [(2, "21441"), (3, "22536"), (4, "42175000720000")]
    assert detect_roles(["input_value"]).identifier == "input_value"


def test_csv_shapes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('UWI,TIFPATH,,uwi\n"1","\\\\s\\l\\1.tif"\n,,,\n2,"two\nlines",x,y,extra\n', encoding="utf-8-sig")
    table = manifests.read_source(spark, str(tmp_path / "a.csv"))
    assert table.columns[:4] == ["UWI", "TIFPATH", "column_3", "uwi_2"]
    rows = table.orderBy("import_row").collect()
    assert [(r["import_row"], r["UWI"], r["column_3"]) for r in rows] == [(2, "1", ""), (3, "2", "x")]
    assert rows[0]["TIFPATH"] == r"\\s\l\1.tif" and rows[1]["TIFPATH"] == "two\nlines"
    (tmp_path / "b.tsv").write_text("well_id\timage_path\n22536\tC:\\logs\\22536.tif\n")
    assert detect_roles(manifests.read_source(spark, str(tmp_path / "b.tsv")).columns[:2]) == ManifestRoles("well_id", "image_path")
    with pytest.raises(ManifestError):
        manifests.read_source(spark, "x.docx")


def _workbook(path, sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as book:
        tags = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>{tags}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, cells in enumerate(rows, 1):
                parts = "".join(
                    f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float))
                    else f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
                    for c, v in enumerate(cells) if v != ""
                )
                body += f'<row r="{r}">{parts}</row>'
            book.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbooks_with_headers_of_their_own(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", {"wells": [["API", "Path"], [1, "a.tif"], ["", ""], [2, ""]]})
    _workbook(tmp_path / "b.xlsx", {"s": [["path", "", "UWI", "path"], ["b.tif", "x", 3, "again"], ["", "", 4, ""]]})
    _workbook(tmp_path / "c.xlsx", {"wells": [["api"], [5]]})
    _workbook(tmp_path / "d.xlsx", {"wells": [["Notes", "well_id"]]})
    table = manifests.read_workbook(spark, str(tmp_path))
    assert table.columns == ["API", "Path", "column_2", "UWI", "path_2", "import_row", "source_path"]
    rows = table.select(F.regexp_extract("source_path", "([a-d])[.]xlsx", 1), "import_row", *table.columns[:5]).collect()
    assert sorted(map(tuple, rows)) == [
        ("a", 2, "1", "a.tif", "", "", ""), ("a", 3, "2", "", "", "", ""),
        ("b", 2, "", "b.tif", "x", "3", "again"), ("b", 3, "", "", "", "4", ""), ("c", 2, "5", "", "", "", "")]


def test_workbook_sheet_choice(spark, tmp_path):
    path = tmp_path / "m.xlsx"
    _workbook(path, {"notes": [["description"], ["not the data"]], "wells": [["API Number", "TIFF Path"], [21441, r"C:\logs\21441.tif"], ["", ""], [1.5, ""]]})
    table = manifests.read_source(spark, str(path))
    rows = table.orderBy("import_row").select("import_row", "API Number", "TIFF Path").collect()
    assert [tuple(r) for r in rows] == [(2, "21441", r"C:\logs\21441.tif"), (3, "1.5", "")]


def test_roles():
    found = detect_roles(["API", "TIFPATH", "LAT", "LONG", "Depth1", "Depth2"])
    assert found == ManifestRoles("API", "TIFPATH", "LAT", "LONG", "Depth1", "Depth1", "Depth2")
    with pytest.raises(ColumnSelectionRequired):
        detect_roles(["API", "UWI", "TIFPATH", "FILE_PATH"])
    assert detect_roles(["API", "UWI", "TIFPATH", "FILE_PATH"], identifier="UWI", path="FILE_PATH").path == "FILE_PATH"
    with pytest.raises(ManifestError):
        detect_roles(["API"], latitude="nope")


def test_audit_sink(spark, tmp_path):
    plan = run(spark, [("21441", "/a/21441.tif", "source note")], "UWI string, TIFPATH string, COMMENT string", readable=["/a/21441.tif"])
    path = sinks.audit_report_path("/data/m.csv", str(tmp_path / "review"))
    assert path.startswith(str(tmp_path / "m_load_status_"))
    sinks.write_audit(plan.audit, path)
    row = spark.read.csv(path, header=True).first()
    assert (row["COMMENT"], row["source_identifier"], row["well_loaded"], row["load_status"]) == ("source note", "21441", "True", "recovered_from_listed_path")

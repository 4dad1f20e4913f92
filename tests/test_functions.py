"""Scalar expressions against hand-written cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkledger.functions import geometry as geo
from inkledger.functions import scoring, state
from inkledger.functions import text as tx
from inkledger.functions.depth import DepthFilter, depth_value


def values(spark, expr, rows, schema="v string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_identifiers(spark):
    rows = ["21441", " 424693343100\n", "42175000720000", "ABC", "", None, "123456789012345", "1\n2"]
    assert values(spark, tx.identifier("v"), rows) == ["21441", "424693343100", "42175000720000", None, None, None, None, None]
    got = values(spark, tx.match_identifier(tx.identifier("v")), rows)
    assert got[:4] == ["21441", "42469334310000", "42175000720000", ""]


def test_names_and_paths(spark):
    assert values(spark, tx.basename("v"), ["a\\b/c.TIF", "c.tif", "dir/"]) == ["c.TIF", "c.tif", ""]
    assert values(spark, tx.api14("v"), ["x_421750007200001_a.tif", "12.tif"]) == ["42175000720000", ""]
    assert values(spark, tx.leading_api("v"), ["42175000720000_a.tif", "421750007200001.tif", "x42175000720000.tif"]) == ["42175000720000", "", ""]
    assert values(spark, tx.share_root("v"), [r"\\srv\share\a\b.tif", "//srv/share/x", r"\\srv", "/a/b"]) == [r"\\srv\share", r"\\srv\share", "", ""]
    assert values(spark, tx.is_image("v"), ["a.TIF", "a.tif.bak", "tif", "a.jpeg"]) == [True, False, False, True]
    assert values(spark, tx.path_key("v"), ["/A/./b//c/../D.tif", "\\\\S\\x\\..\\y", "/plain/p.tif", "/../x"]) == ["/a/b/d.tif", "//s/y", "/plain/p.tif", "/x"]
    assert values(spark, tx.is_absolute("v"), ["C:\\a", "/a", "\\\\s\\x", "a/b", "1:/a"]) == [True, True, True, False, False]
    match = tx.name_matches_identifier("v", F.array(F.lit("424693343100"), F.lit("42469334310000")))
    assert values(spark, match, ["42469334310000_log.tif", "424693343100.tif", "4246933431001.tif"]) == [True, True, False]


def test_multi_values(spark):
    rows = ["IHS, TWDB, ihs", " Riley ,IHS", "", None, ",,"]
    assert values(spark, tx.split_values("v"), rows) == [["IHS", "TWDB"], ["Riley", "IHS"], [], [], []]


@pytest.mark.parametrize("cell,expected", [
    ("True", True), ("False", False), ("1", True), ("0", False), ("TRUE", True), ("no", False),
    ("y", True), (None, None), ("", None), ("garbage", None),
])
def test_parse_bool(spark, cell, expected):
    assert values(spark, tx.parse_bool("v"), [(cell,)]) == [expected]


def test_depth_filter(spark):
    below = DepthFilter("v", "less_than", 200.0)
    outcome = below.outcome(tx.text_or_blank("v"), depth_value(F.col("v")))
    rows = ["199.9", "200", "250", "", "unknown", "1.0d", "nan", "1,50", "-inf"]
    assert values(spark, outcome, rows) == [
        None, "filtered_depth", "filtered_depth", "filtered_blank_depth", "filtered_invalid_depth",
        "filtered_invalid_depth", "filtered_depth", None, None,
    ]
    above = DepthFilter("v", "greater_than", 200.0, include_blank=True)
    outcome = above.outcome(tx.text_or_blank("v"), depth_value(F.col("v")))
    assert values(spark, outcome, ["201", "nan", "", "200"]) == [None, "filtered_depth", None, "filtered_depth"]
    assert above.description == "v > 200 ft, including blank depths"
    with pytest.raises(ValueError):
        DepthFilter("v", "equals", 1.0)


def test_general_number(spark):
    rows = [199.9, 250.0, 1234567.0, 0.00001234, 0.0, 100000.0, -2.5]
    assert values(spark, tx.general_number(F.col("v")), rows, "v double") == [f"{v:g}" for v in rows]


def test_units_and_boxes(spark):
    one = spark.range(1)
    box = one.select(geo.centered(F.lit(100.4), F.lit(200.6), F.lit(10.0)).alias("b")).select(
        "b.*", geo.width(F.col("b")).alias("w"), geo.center_y(F.col("b")).alias("cy"),
        geo.is_empty(geo.clip(F.col("b"), 50, 50)).alias("e"),
    ).first()
    assert (box["w"], box["cy"], box["e"]) == (20, 201.0, True)
    assert one.select(geo.inches_to_px(0.0001, 400.0), geo.inches_to_px(0.70, 400.0)).first() == (1, 280)
    assert values(spark, geo.factor_for_scale(F.col("v")), [1.5, 1.0, 0.5, 0.3, 0.1, 0.01], "v double") == [1, 1, 2, 2, 8, 64]


def test_scores(spark):
    window = scoring.trapezoid(F.col("v"), 0.1, 0.2, 0.8, 0.9)
    assert values(spark, F.round(window, 6), [0.0, 0.15, 0.5, 0.85, 1.0], "v double") == [0.0, 0.5, 1.0, 0.5, 0.0]
    ratio = scoring.ratio_score(F.col("v"), F.col("d"), 0.3, 0.8)
    assert values(spark, F.round(ratio, 6), [(0.1, 1.0), (0.8, 1.0), (0.55, 1.0), (0.5, 0.0)], "v double, d double") == [1.0, 0.0, 0.5, 0.0]
    assert abs(sum(scoring.active_weights(True).values()) - 1) < 1e-12


def test_record_state(spark):
    cells = (F.col("v"), F.col("s"), F.lit(""), F.col("n"))
    rows = [(None, "", ""), (False, "", ""), (True, "", ""), (True, "IHS", ""), (None, "", "note")]
    assert values(spark, state.tag(*cells), rows, "v boolean, s string, n string") == ["todo", "done", "warn", "done", "warn"]
    valid = state.draft_valid(F.col("v"), F.split("s", ","))
    rows = [(True, "IHS,TWDB"), (True, "IHS,ihs"), (True, ""), (None, ""), (False, "")]
    assert values(spark, valid, rows, "v boolean, s string") == [True, False, False, True, True]

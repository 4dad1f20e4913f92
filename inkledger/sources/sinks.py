"""Sinks: audit CSV, inventory CSV, page documents, review table and label lists."""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.functions import text as tx
from inkledger.operators.audit import audit_columns
from inkledger.operators.labels import distinct_labels
from inkledger.operators.ledger import conform, keep_extras
from inkledger.vocabulary import DEFAULT_STAMP_TYPES, LEDGER_COLUMNS, METADATA_COLUMNS

BOM = "﻿"


def hadoop_fs(spark: SparkSession, path: str):
    """File system of a path, the path, and the JVM."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where, _ = hadoop_fs(spark, path)
    return fs.exists(where)


def swap_in(spark: SparkSession, staged: str, target: str) -> None:
    """Replace ``target`` by the finished ``staged`` directory; the old one is kept aside
    until the new one is in place and comes back if the move fails."""
    fs, source, jvm = hadoop_fs(spark, staged)
    goal = jvm.org.apache.hadoop.fs.Path(target)
    aside = jvm.org.apache.hadoop.fs.Path(f"{target}.old-{uuid.uuid4().hex}")
    had_old = fs.exists(goal)
    if had_old and not fs.rename(goal, aside):
        raise OSError(f"cannot set {target} aside")
    if not fs.rename(source, goal):
        if had_old:
            fs.rename(aside, goal)
        raise OSError(f"cannot move {staged} to {target}")
    if had_old:
        fs.delete(aside, True)


# ----------------------------------------------------------------- audit and CSV

def audit_report_path(source_path: str, ledger_path: str, now: dt.datetime | None = None) -> str:
    """``<source>_load_status_<yyyyMMdd_HHmmss>.csv``, beside the ledger."""
    source = re.split(r"[/\\]", source_path)[-1]
    name = re.match(r"(.+?)(?:\.[^.]*)?\Z", source)
    folder, slash, _ = ledger_path.rpartition("/")
    moment = now or dt.datetime.now()
    return f"{folder}{slash}{name[1] if name else 'image_list'}_load_status_{moment:%Y%m%d_%H%M%S}.csv"


def write_csv(rows: DataFrame, path: str) -> str:
    """CSV directory with a header per part file; the first header name carries the BOM."""
    flat = [F.col(c).cast("string").alias(BOM + c if i == 0 else c) for i, c in enumerate(rows.columns)]
    rows.select(*flat).write.mode("errorifexists").option("emptyValue", "").csv(path, header=True)
    return path


def write_audit(audit: DataFrame, path: str) -> str:
    """Source columns, then audit columns; booleans are written as True/False."""
    rows = audit_columns(audit)
    shown = [
        F.initcap(F.col(c).cast("string")).alias(c) if c in ("well_loaded", "row_image_loaded") else F.col(c)
        for c in rows.columns
    ]
    return write_csv(rows.select(*shown), path)


def write_inventory(inventory: DataFrame, path: str) -> str:
    return write_csv(inventory, path)


# ---------------------------------------------------------------- page documents

def page_documents(pages: DataFrame, detections: DataFrame) -> DataFrame:
    """One JSON document per page with its detections, best first.

    A document is one cell by contract; the detector keeps a fixed few per page.
    """
    nested = detections.withColumn("_neg", -F.col("score"))
    fields = [c for c in detections.columns if c not in ("page_id", "det_order")]
    grouped = nested.groupBy("page_id").agg(
        F.transform(
            F.sort_array(F.collect_list(
                F.struct("_neg", "det_order", F.to_json(F.struct(*fields)).alias("doc"))
            )),
            lambda e: e["doc"],
        ).alias("docs")
    )
    joined = pages.join(grouped, "page_id", "left")
    body = F.to_json(F.struct(*pages.columns))
    listed = F.array_join(F.coalesce("docs", F.array().cast("array<string>")), ",")
    return joined.select(
        "page_id",
        F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"detections":['), listed, F.lit("]}")).alias("document"),
    )


def write_page_documents(documents: DataFrame, path: str) -> str:
    documents.select("document").write.text(path)
    return path


# ------------------------------------------------------------------- review table

def load_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored review table, or None when there is none yet."""
    if not path_exists(spark, path):
        return None
    return conform(spark.read.parquet(path))


def ledger_columns(ledger: DataFrame, declared: list[str]) -> list[str]:
    """Fixed columns plus the optional ones that are declared or filled anywhere."""
    present = [c for c in METADATA_COLUMNS if c in ledger.columns]
    if not present:
        return list(LEDGER_COLUMNS)
    filled = ledger.agg(*[F.max(F.col(c) != "").alias(c) for c in present]).first()
    return [*LEDGER_COLUMNS, *(c for c in present if c in declared or filled[c])]


def save_ledger(ledger: DataFrame, path: str, order: DataFrame | None = None,
                declared: list[str] = ()) -> str:
    """Rewrite the whole review table in a staging folder, then swap it in.

    ``order`` (``name, position``) comes first and the remaining rows after it. Order is
    data: ``save_phase`` and ``position`` columns are stored with every row.
    """
    staged = f"{path}.staging-{uuid.uuid4().hex}"
    ledger_rows(ledger, order, declared).write.parquet(staged)
    swap_in(ledger.sparkSession, staged, path)
    return path


def ledger_rows(ledger: DataFrame, order: DataFrame | None = None, declared: list[str] = ()) -> DataFrame:
    """The review table as it is stored, with its order as columns."""
    columns = ledger_columns(ledger, list(declared))
    if order is None:
        ordered = ledger.withColumn("save_phase", F.lit(0)).withColumn("save_position", F.col("position"))
    else:
        ordered = keep_extras(ledger, order)
    return ordered.select(
        *[
            {"file_link": F.col("file_name"), "type_of_stamp": F.col("stamp_type")}.get(c, F.col(c) if c in ordered.columns else F.lit("")).alias(c)
            for c in columns
        ],
        "save_phase", F.col("save_position").cast("long").alias("position"),
    )


# --------------------------------------------------------------------- label lists

def load_labels(spark: SparkSession, path: str, default: tuple[str, ...] = DEFAULT_STAMP_TYPES) -> DataFrame:
    """``(position, label)`` from a JSON list or ``{"types": [...]}``; default when unusable."""
    fallback = spark.createDataFrame(list(enumerate(default)), "position long, label string")
    if not path_exists(spark, path):
        return fallback
    whole = spark.read.text(path, wholetext=True)
    listed = F.coalesce(
        F.from_json("value", "struct<types:array<string>>")["types"], F.from_json("value", "array<string>")
    )
    rows = whole.select(F.posexplode(listed).alias("position", "label")).withColumn("label", tx.strip("label")).filter("label <> ''")
    found = distinct_labels(rows.withColumn("position", F.col("position").cast("long")), ["position"]).select("position", "label")
    return found if found.take(1) else fallback


def save_labels(labels: DataFrame, path: str) -> str:
    """A label list is a short document: one JSON object in a one-part directory."""
    clean = distinct_labels(labels, ["position"])
    document = clean.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "label"))), lambda e: e["label"]).alias("types")
    ).select(F.to_json(F.struct("types")).alias("value"))
    staged = f"{path}.staging-{uuid.uuid4().hex}"
    document.write.text(staged)
    swap_in(labels.sparkSession, staged, path)
    return path

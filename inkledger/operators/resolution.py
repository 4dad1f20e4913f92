"""Choices of every candidate, their probe outcome and the first readable one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.functions import text as tx
from inkledger.operators.skew import salted_join


def choice_list(candidates: DataFrame, references: DataFrame, max_weight: int | None = None) -> DataFrame:
    """Folder copy first (priority -1), then listed paths by first row, no path twice."""
    keyed = candidates.withColumn("folder_key", tx.path_key(F.col("folder_path")))
    folder = keyed.filter(F.col("folder_path").isNotNull()).select(
        "identifier", "basename_key", "conflict",
        F.lit(-1).cast("long").alias("priority"),
        F.col("folder_path").alias("path"),
        F.col("folder_key").alias("path_key"),
        F.lit("selected_folder").alias("source"),
    )
    listed = (
        salted_join(
            references.select("identifier", "basename_key", "listed_key", "listed_path", "first_row"),
            keyed.select("identifier", "basename_key", "conflict", "folder_key", "n_refs"),
            ["identifier", "basename_key"], "inner", weight="n_refs", max_weight=max_weight,
        )
        .filter(F.col("folder_key").isNull() | (F.col("folder_key") != F.col("listed_key")))
        .select(
            "identifier", "basename_key", "conflict",
            F.col("first_row").alias("priority"),
            F.col("listed_path").alias("path"),
            F.col("listed_key").alias("path_key"),
            F.lit("listed_path").alias("source"),
        )
    )
    return folder.unionByName(listed).withColumn("root", tx.share_root(F.col("path")))


def probe_table(probe: DataFrame | None, catalog: DataFrame | None) -> DataFrame | None:
    """Known files by path key. Catalog files exist; an explicit probe row wins."""
    parts = []
    if catalog is not None:
        parts.append(
            catalog.select(
                tx.path_key(F.col("path")).alias("path_key"), F.lit(0).alias("trust"),
                F.lit(True).alias("path_exists"), F.lit(True).alias("readable"),
                F.lit("").alias("probe_detail"),
            )
        )
    if probe is not None:
        detail = F.col("detail") if "detail" in probe.columns else F.lit("")
        parts.append(
            probe.select(
                tx.path_key(F.col("path")).alias("path_key"), F.lit(1).alias("trust"),
                "path_exists", "readable", detail.alias("probe_detail"),
            )
        )
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    best = F.max(F.struct("trust", "path_exists", "readable", "probe_detail")).alias("b")
    return rows.groupBy("path_key").agg(best).select(
        "path_key", "b.path_exists", "b.readable", "b.probe_detail"
    )


def join_root_status(choices: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Attach availability of the network root; an unknown root is unavailable.

    Paths without a root get a key of their own, so they spread over all partitions
    instead of meeting on the blank key.
    """
    if roots is None:
        return choices.withColumn(
            "root_available", F.when(F.col("root") == "", F.lit(True)).otherwise(F.lit(False))
        ).withColumn(
            "root_detail",
            F.when(F.col("root") == "", F.lit("")).otherwise(
                F.lit("Network share is not accessible.")
            ),
        )
    keyed = choices.withColumn(
        "_root", F.when(F.col("root") == "", F.concat(F.lit("-"), F.col("path_key"))).otherwise(F.col("root"))
    )
    known = roots.select(
        F.col("root").alias("_root"), F.col("available").alias("_available"),
        F.col("detail").alias("_detail"),
    )
    return (
        keyed.join(known, "_root", "left")
        .withColumn(
            "root_available",
            F.when(F.col("root") == "", F.lit(True)).otherwise(
                F.coalesce(F.col("_available"), F.lit(False))
            ),
        )
        .withColumn(
            "root_detail",
            F.when(F.col("root_available"), F.lit("")).otherwise(
                F.coalesce(F.col("_detail"), F.lit("Network share is not accessible."))
            ),
        )
        .drop("_root", "_available", "_detail")
    )


def judge_choices(choices: DataFrame, probes: DataFrame | None) -> DataFrame:
    """Status of each choice: blank when readable. Choices need ``root_available``."""
    if probes is None:
        seen = (
            choices.withColumn("path_exists", F.lit(False))
            .withColumn("readable", F.lit(False))
            .withColumn("probe_detail", F.lit(""))
        )
    else:
        seen = choices.join(probes, "path_key", "left")
    status = (
        F.when(~F.col("root_available"), F.lit("network_unavailable"))
        .when(~tx.is_image(F.col("path")), F.lit("unsupported_image_path"))
        .when(~F.coalesce(F.col("path_exists"), F.lit(False)), F.lit("path_missing"))
        .when(~F.coalesce(F.col("readable"), F.lit(False)), F.lit("unreadable_image"))
        .otherwise(F.lit(""))
    )
    detail = (
        F.when(F.col("status") == "network_unavailable", F.col("root_detail"))
        .when(F.col("status") == "unsupported_image_path", F.lit("Unsupported image extension."))
        .when(F.col("status") == "path_missing", F.lit("File does not exist or is not accessible."))
        .when(F.col("status") == "unreadable_image", F.coalesce(F.col("probe_detail"), F.lit("")))
        .otherwise(F.lit(""))
    )
    return seen.withColumn("status", status).withColumn("choice_detail", detail).drop(
        "path_exists", "readable", "probe_detail", "root_available", "root_detail"
    )


def first_readable(judged: DataFrame) -> DataFrame:
    """First readable choice per candidate, or the last failure. Both are mergeable."""
    ok = F.col("status") == ""
    return (
        judged.groupBy("identifier", "basename_key")
        .agg(
            F.min(F.when(ok, F.struct("priority", "path", "path_key", "source"))).alias("win"),
            F.max(F.when(~ok, F.struct("priority", "status", "choice_detail"))).alias("loss"),
        )
        .select(
            "identifier", "basename_key",
            F.col("win.path").alias("resolved_path"),
            F.col("win.path_key").alias("resolved_key"),
            F.col("win.source").alias("resolution_source"),
            F.when(F.col("win").isNull(), F.col("loss.status")).alias("failure_status"),
            F.when(F.col("win").isNull(), F.col("loss.choice_detail")).alias("failure_detail"),
        )
    )


def resolve_candidates(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """Candidates with their outcome; conflicting names fail without being probed."""
    outcome = first_readable(judged.filter(~F.col("conflict")))
    merged = candidates.join(outcome, ["identifier", "basename_key"], "left")
    return merged.withColumn(
        "failure_status",
        F.when(F.col("conflict"), F.lit("basename_conflict")).otherwise(F.col("failure_status")),
    ).withColumn(
        "failure_detail",
        F.when(
            F.col("conflict"),
            F.concat(
                F.lit("The same TIFF basename is already assigned to identifier "),
                F.col("owner"), F.lit("."),
            ),
        ).otherwise(F.col("failure_detail")),
    )


def magic_bytes_probe(files: DataFrame) -> DataFrame:
    """Readability of image files by their leading bytes (``path, content``).

    Eight bytes decide, so ``content`` need not hold more than a file's head
    (``sources.heads.file_heads``).
    """
    head = F.hex(F.substring(F.col("content"), 1, 8))
    known = (
        head.startswith("49492A00") | head.startswith("4D4D002A")      # TIFF
        | head.startswith("49492B00") | head.startswith("4D4D002B")    # BigTIFF
        | head.startswith("89504E470D0A1A0A")                          # PNG
        | head.startswith("FFD8FF")                                    # JPEG
        | head.startswith("424D")                                      # BMP
        | head.startswith("474946383")                                 # GIF
    )
    return files.select(
        "path", F.lit(True).alias("path_exists"), F.coalesce(known, F.lit(False)).alias("readable"),
        F.when(known, F.lit("")).otherwise(F.lit("not a readable image")).alias("detail"),
    )

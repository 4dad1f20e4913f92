"""Image catalog and page facts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.functions import text as tx
from inkledger.operators.resolution import magic_bytes_probe
from inkledger.sources.heads import file_heads
from inkledger.vocabulary import DEFAULT_DPI, MIN_TAG_DPI, PLAUSIBLE_WIDTH_IN


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder by metadata only; the content column is never read."""
    rows = spark.read.format("binaryFile").load(folder)
    return rows.select("path", "length", "modificationTime")


def list_images(files: DataFrame, pattern: str | None = None) -> DataFrame:
    """Images by extension, or by a case-insensitive glob on the base name."""
    if pattern is None:
        return files.filter(tx.is_image("path"))
    wild = re.escape(pattern.lower()).replace(r"\*", ".*").replace(r"\?", ".")
    return files.filter(tx.basename_key("path").rlike(f"^{wild}\\z"))


def in_name_order(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Sorted by base name with an increasing (not dense) ``folder_seq``."""
    ordered = files.orderBy(tx.basename("path"), "path")
    if limit is not None:
        ordered = ordered.limit(limit)
    return ordered.withColumn("folder_seq", F.monotonically_increasing_id())


def probe_images(spark: SparkSession, folder: str) -> DataFrame:
    """Readability of every file of a folder by its leading bytes, in parallel.

    Sixteen bytes are read of a file, however large it is.
    """
    return magic_bytes_probe(file_heads(spark, folder))


def page_facts(raw: DataFrame) -> DataFrame:
    """Resolution, its origin, plausibility warnings and derived sizes.

    ``raw`` has ``width, height, x_resolution, resolution_unit`` (text tags),
    ``second_dpi`` (another reader's value) and ``dpi_override``.
    """
    metric = F.lower(F.coalesce("resolution_unit", F.lit("")))
    per_inch = F.when(metric.contains("centimeter") | tx.strip(metric).startswith("3"), 2.54).otherwise(1.0)
    tag = tx.strip("x_resolution").try_cast("double") * per_inch
    low, high = PLAUSIBLE_WIDTH_IN
    staged = raw.withColumn("_tag", tag)
    given = F.coalesce(F.col("dpi_override"), F.lit(0.0)) != 0

    def choose(values: tuple) -> F.Column:
        return (
            F.when(given, values[0])
            .when(F.col("_tag") > MIN_TAG_DPI, values[1])
            .when(F.col("second_dpi") > MIN_TAG_DPI, values[2])
            .otherwise(values[3])
        )

    known = staged.withColumns({
        "dpi": choose((F.col("dpi_override"), F.col("_tag"), F.col("second_dpi"), F.lit(DEFAULT_DPI))),
        "dpi_source": choose(tuple(F.lit(v) for v in ("override", "tiff_tag", "pil_tag", "default"))),
    })
    width_in = F.col("width") / F.col("dpi")
    warning = F.when(
        ~width_in.between(low, high),
        F.concat(
            F.lit("page width "), F.format_string("%.1f", width_in), F.lit(" in implausible at "),
            tx.general_number(F.col("dpi")), F.lit(" dpi"),
        ),
    )
    return known.withColumns({
        "warnings": F.array_compact(F.array(warning)),
        "width_in": width_in,
        "height_in": F.col("height") / F.col("dpi"),
        "megapixels": F.col("width").cast("double") * F.col("height") / 1e6,
    }).drop("_tag", "x_resolution", "resolution_unit", "second_dpi", "dpi_override")

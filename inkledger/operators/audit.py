"""Row audit, well status, metadata fill and import statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions.depth import DepthFilter
from inkledger.functions.text import is_identifier, strip
from inkledger.operators.manifest import first_filled, metadata_in
from inkledger.operators.skew import salted_join
from inkledger.vocabulary import AUDIT_COLUMNS

PATHS_PER_CHUNK = 1000


def well_status(identifiers: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per eligible identifier: how many candidates resolved and failed."""
    tally = resolved.groupBy("identifier").agg(
        F.count("resolved_path").alias("n_resolved"),
        F.count_if(F.col("resolved_path").isNull()).alias("n_failed"),
    )
    zero = F.lit(0).cast("long")
    return (
        identifiers.filter(F.col("n_eligible") > 0)
        .join(tally, "identifier", "left")
        .withColumn("n_resolved", F.coalesce("n_resolved", zero))
        .withColumn("n_failed", F.coalesce("n_failed", zero))
        .withColumn("loaded", F.col("n_resolved") > 0)
    )


def joined_paths(resolved: DataFrame) -> DataFrame:
    """All resolved paths of an identifier as one text, in candidate order.

    Built in two levels: chunks of at most ``PATHS_PER_CHUNK`` consecutive ranks are
    sorted and joined first, so no task ever sorts one identifier's whole list; the
    second level only strings chunk texts together.
    """
    chunked = resolved.filter(F.col("resolved_path").isNotNull()).select(
        "identifier", "rank", "resolved_path",
        F.col("rank.phase").alias("phase"),
        F.floor(F.col("rank.seq") / F.lit(PATHS_PER_CHUNK)).alias("chunk"),
    )
    texts = chunked.groupBy("identifier", "phase", "chunk").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "resolved_path"))),
                        lambda e: e["resolved_path"]), "; "
        ).alias("text")
    )
    return texts.groupBy("identifier").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("phase", "chunk", "text"))),
                        lambda e: e["text"]), "; "
        ).alias("all_paths")
    )


def outcome_table(wells: DataFrame, resolved: DataFrame, identifiers: DataFrame) -> DataFrame:
    """What a manifest row looks up: one row per candidate plus one per identifier.

    The per-identifier row has a blank base name and serves rows without a candidate,
    so the audit needs one join instead of two.
    """
    loaded = wells.select("identifier", "loaded", "n_resolved")
    per_candidate = resolved.filter(F.col("n_rows") > 0).join(loaded, "identifier").select(
        "identifier", "basename_key", "loaded", "n_resolved", "resolved_path", "resolved_key",
        "resolution_source", "failure_status", "failure_detail", "n_rows",
        F.lit(None).cast("string").alias("all_paths"),
    )
    nothing = F.lit(None).cast("string")
    wanted = identifiers.filter(F.col("n_blank") > 0).select("identifier")
    texts = joined_paths(resolved.join(wanted, "identifier", "left_semi"))
    per_identifier = (
        identifiers.select("identifier", F.col("n_without_candidate").alias("n_rows"))
        .join(loaded, "identifier", "left")
        .join(texts, "identifier", "left")
        .select(
            "identifier", F.lit("").alias("basename_key"),
            F.coalesce("loaded", F.lit(False)).alias("loaded"),
            F.coalesce("n_resolved", F.lit(0).cast("long")).alias("n_resolved"),
            nothing.alias("resolved_path"), nothing.alias("resolved_key"),
            nothing.alias("resolution_source"), nothing.alias("failure_status"),
            nothing.alias("failure_detail"), "n_rows", "all_paths",
        )
    )
    return per_candidate.unionByName(per_identifier)


def classify_rows(tagged: DataFrame, outcomes: DataFrame, max_weight: int | None = None) -> DataFrame:
    """The audit: every manifest row with its one final status."""
    eligible = F.col("eligible")
    keyed = tagged.withColumn(
        "basename_key",
        F.when(eligible & F.col("listed"), F.col("basename_key")).otherwise(F.lit("")),
    ).withColumn(
        # Rows without an identifier match nothing; a key of their own spreads them.
        "identifier",
        F.coalesce("identifier", F.concat(F.lit("row "), F.col("import_row").cast("string"))),
    )
    rows = salted_join(
        keyed, outcomes, ["identifier", "basename_key"], "left", weight="n_rows", max_weight=max_weight
    )

    kind = F.col("path_kind")
    loaded = F.coalesce("loaded", F.lit(False))
    hit = F.col("resolved_path").isNotNull()
    failure = F.coalesce("failure_status", F.lit("path_missing"))
    from_folder = F.col("resolution_source") == "selected_folder"
    status = (
        F.when(~eligible, F.col("rejected"))
        .when((kind == "placeholder") & loaded, F.lit("placeholder_covered"))
        .when(kind == "placeholder", F.lit("placeholder_unresolved"))
        .when((kind == "blank") & loaded, F.lit("loaded_from_selected_folder"))
        .when(kind == "blank", F.lit("no_path_unresolved"))
        .when(hit & from_folder, F.lit("loaded_from_selected_folder"))
        .when(hit & (F.col("listed_key") == F.col("resolved_key")), F.lit("recovered_from_listed_path"))
        .when(hit, F.lit("duplicate_reference_loaded"))
        .when(loaded, F.concat(failure, F.lit("_well_covered")))
        .otherwise(F.concat(failure, F.lit("_unresolved")))
    )
    detail = (
        F.when(~eligible, F.col("reject_detail"))
        .when((kind == "placeholder") & loaded, F.lit("Another TIFF loaded for this identifier."))
        .when(kind == "placeholder", F.lit("No TIFF was available for this identifier."))
        .when(
            (kind == "blank") & loaded,
            F.concat(
                F.lit("Matched "), F.col("n_resolved").cast("string"),
                F.lit(" image(s) by identifier in the selected image collection."),
            ),
        )
        .when(kind == "blank", F.lit("No TIFF path was supplied or matched."))
        .when(hit, F.lit(""))
        .otherwise(F.coalesce("failure_detail", F.lit("No TIFF candidate was resolved.")))
    )
    path_less = eligible & (kind == "blank") & loaded
    blank = F.lit("")
    return rows.select(
        "src", "import_row", "source_identifier", "match_identifier", "source_tif_path",
        F.when(path_less, F.col("all_paths"))
        .when(eligible & hit, F.col("resolved_path"))
        .otherwise(blank).alias("resolved_tif_path"),
        loaded.alias("well_loaded"),
        (path_less | (eligible & hit)).alias("row_image_loaded"),
        status.alias("load_status"),
        F.when(path_less, F.lit("selected_folder"))
        .when(eligible & hit, F.col("resolution_source"))
        .otherwise(blank).alias("resolution_source"),
        F.coalesce(detail, blank).alias("detail"),
    )


def audit_columns(audit: DataFrame) -> DataFrame:
    """Source columns first, then the audit columns; clashing source names are kept."""
    return audit.select("src.*", *AUDIT_COLUMNS)


def resolved_files(tagged: DataFrame, resolved: DataFrame) -> DataFrame:
    """Resolved paths with identifier, order columns and filled metadata.

    A value that a row naming the file supplies wins over the identifier's first value;
    only eligible rows count. Both grains are mergeable minima over the manifest rows.
    """
    metas = metadata_in(tagged)
    files = resolved.filter(F.col("resolved_path").isNotNull()).select(
        "identifier", "basename_key", F.col("resolved_path").alias("path"), "resolution_source",
        F.col("rank.id_rank").alias("id_rank"), F.col("rank.phase").alias("phase"),
        F.col("rank.seq").alias("seq"),
    )
    if not metas:
        return files.drop("basename_key")
    eligible = tagged.filter("eligible")
    own = (
        eligible.filter("listed").groupBy("identifier", "basename_key")
        .agg(*[first_filled(name) for name in metas])
    )
    general = eligible.groupBy("identifier").agg(*[first_filled(name).alias(f"_id_{name}") for name in metas])
    return (
        files.join(own, ["identifier", "basename_key"], "left").join(general, "identifier", "left")
        .select(
            "path", "identifier", "resolution_source", "id_rank", "phase", "seq",
            *[
                F.coalesce(F.col(name)["value"], F.col(f"_id_{name}")["value"], F.lit("")).alias(name)
                for name in metas
            ],
        )
    )


def ordered_paths(files: DataFrame) -> DataFrame:
    return files.orderBy("id_rank", "phase", "seq")


def import_statistics(
    tagged: DataFrame,
    identifiers: DataFrame,
    wells: DataFrame,
    resolved: DataFrame,
    choices: DataFrame,
    depth_filter: DepthFilter | None = None,
) -> DataFrame:
    """All counters in one row.

    Each input contributes one partial row; the parts meet in a final sum.
    """
    def total(condition: Column) -> Column:
        return F.count_if(condition)

    rejected = F.col("rejected")
    from_rows = tagged.agg(
        F.count(F.lit(1)).alias("input_rows"),
        total(rejected.isin("filtered_blank_depth", "filtered_depth")).alias("depth_filtered_rows"),
        total(rejected == "filtered_invalid_depth").alias("invalid_depth_rows"),
    )
    bad_values = (
        tagged.filter(F.col("identifier").isNull())
        .select(strip("source_identifier").alias("v"))
        .distinct()
        .agg(F.count(F.lit(1)).alias("invalid_unique_identifiers"))
    )
    from_identifiers = identifiers.agg(
        F.count(F.lit(1)).alias("valid_unique_identifiers"),
        total(F.col("n_eligible") > 0).alias("eligible_unique_identifiers"),
        total(F.col("n_eligible") == 0).alias("depth_filtered_identifiers"),
    )
    from_wells = wells.agg(
        total(F.col("loaded")).alias("loaded_identifiers"),
        total(F.col("loaded") & (F.col("n_failed") > 0)).alias("partially_loaded_identifiers"),
        total(~F.col("loaded")).alias("unrecovered_identifiers"),
        F.sum("n_placeholder").alias("placeholder_rows"),
        F.sum(F.when(F.col("loaded"), F.col("n_placeholder")).otherwise(0)).alias("placeholder_covered"),
        F.sum(F.when(~F.col("loaded"), F.col("n_placeholder")).otherwise(0)).alias("placeholder_unresolved"),
    )
    from_candidates = resolved.agg(
        F.count(F.lit(1)).alias("unique_tiff_candidates"),
        F.count("resolved_path").alias("loaded_tiffs"),
        total(F.col("resolution_source") == "selected_folder").alias("loaded_from_folder"),
        total(F.col("resolution_source") == "listed_path").alias("recovered_from_paths"),
        F.sum(F.greatest(F.col("n_rows") - 1, F.lit(0))).alias("duplicate_references"),
    )
    dead = choices.filter(~F.col("root_available"))
    shares = dead.select("root").distinct().agg(
        F.count(F.lit(1)).alias("unavailable_network_shares")
    )
    skipped = dead.select("path_key").distinct().agg(
        F.count(F.lit(1)).alias("network_paths_skipped")
    )
    parts = (from_rows, bad_values, from_identifiers, from_wells, from_candidates, shares, skipped)
    names = [name for part in parts for name in part.columns]
    stacked = None
    for part in parts:
        row = part.select(
            *[
                (F.coalesce(F.col(n), F.lit(0)) if n in part.columns else F.lit(0)).cast("long").alias(n)
                for n in names
            ]
        )
        stacked = row if stacked is None else stacked.unionByName(row)
    text = depth_filter.description if depth_filter else ""
    return stacked.agg(*[F.sum(n).alias(n) for n in names]).withColumn(
        "depth_filter_description", F.lit(text)
    )


def line_list(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Identifier lines (``line_no``, ``value``) -> ordered distinct, counts, invalid lines."""
    clean = lines.select("line_no", strip(F.col("value")).alias("value")).filter("value <> ''")
    valid = clean.filter(is_identifier(F.col("value")))
    wanted = valid.groupBy("value").agg(
        F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n_lines")
    )
    counts = wanted.agg(
        F.count(F.lit(1)).alias("n_identifiers"),
        F.coalesce(F.sum(F.col("n_lines") - 1), F.lit(0)).alias("n_duplicates"),
    )
    invalid = clean.filter(~is_identifier(F.col("value")))
    return wanted, counts, invalid

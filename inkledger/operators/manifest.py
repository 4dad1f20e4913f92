"""Manifest rows: roles, cleaning, eligibility and the identifier table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.functions import text as tx
from inkledger.functions.depth import DepthFilter, depth_value
from inkledger.vocabulary import METADATA_COLUMNS, PLACEHOLDERS, ROLE_ALIASES


class ManifestError(ValueError):
    """A source cannot be interpreted safely."""


class ColumnSelectionRequired(ManifestError):
    """More than one column (or, for identifiers, none) could fill a role."""

    def __init__(self, candidates: dict[str, list[str]]):
        super().__init__("select the identifier and the optional role columns")
        self.candidates = candidates


@dataclass(frozen=True)
class ManifestRoles:
    identifier: str
    path: str | None = None
    latitude: str | None = None
    longitude: str | None = None
    depth: str | None = None
    log_top_depth: str | None = None
    log_bottom_depth: str | None = None

    def metadata(self) -> dict[str, str]:
        pairs = ((name, getattr(self, name)) for name in METADATA_COLUMNS)
        return {name: column for name, column in pairs if column}


def detect_roles(columns: list[str], **chosen: str | None) -> ManifestRoles:
    """Bind columns to roles by header alias; explicit choices win.

    One column may fill two roles. Starts no job.
    """
    found = {
        role: [c for c in columns if tx.header_key_of(c) in {tx.header_key_of(a) for a in aliases}]
        for role, aliases in ROLE_ALIASES.items()
    }
    if columns == ["input_value"]:
        found["identifier"] = ["input_value"]
    bound: dict[str, str | None] = {}
    ambiguous = False
    for role, options in found.items():
        pick = chosen.get(role) or (options[0] if len(options) == 1 else None)
        bound[role] = pick
        if role == "identifier":
            ambiguous |= pick not in columns
        else:
            ambiguous |= len(options) > 1 and pick not in columns
    if ambiguous:
        raise ColumnSelectionRequired(found)
    for role, pick in bound.items():
        if pick is not None and pick not in columns:
            raise ManifestError(f"unknown {role} column: {pick}")
    return ManifestRoles(**bound)


def number_rows(rows: DataFrame, first: int = 2, whole_folder: bool = False) -> DataFrame:
    """Add ``import_row``: kept rows of each file counted from ``first``, in file order.

    With ``whole_folder`` the count goes on through the files of a folder by name. Counts per file block and running offsets replace a global window; the block
    table has one row per input split.
    """
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ).withColumn("_seq", F.monotonically_increasing_id())
    blocks = placed.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_low")
    )
    of = F.regexp_replace("_file", "[^/]*$", "") if whole_folder else F.col("_file")
    before = (
        Window.partitionBy(of).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = blocks.select(
        "_file", "_block", "_low",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    return (
        placed.join(offsets, ["_file", "_block"])
        .withColumn("import_row", F.col("_seq") - F.col("_low") + F.col("_before") + F.lit(first))
        .withColumn("source_path", F.col("_file"))
        .drop("_file", "_block", "_seq", "_low", "_before")
    )


def _cell(column: str | None) -> Column:
    return tx.text_or_blank(F.col(column)) if column else F.lit("")


def tag_rows(
    rows: DataFrame,
    roles: ManifestRoles,
    source_dir: str = "",
    depth_filter: DepthFilter | None = None,
) -> DataFrame:
    """One projection that gives every later step what it needs.

    The source columns travel as one struct ``src``. ``rejected`` is null for an
    eligible row and otherwise holds its final status. Filtered rows stay in, since
    the audit reports them.
    """
    originals = [c for c in rows.columns if c not in ("import_row", "source_path")]
    raw_id = F.coalesce(F.col(roles.identifier).cast("string"), F.lit(""))
    raw_path = F.coalesce(F.col(roles.path).cast("string"), F.lit("")) if roles.path else F.lit("")
    depth_text = _cell(depth_filter.column) if depth_filter else F.lit("")
    cells = rows.select(
        F.col("import_row").cast("long").alias("import_row"),
        F.struct(*[F.col(c) for c in originals]).alias("src"),
        raw_id.alias("source_identifier"),
        tx.identifier(raw_id).alias("identifier"),
        raw_path.alias("source_tif_path"),
        tx.strip(raw_path).alias("path_text"),
        depth_text.alias("depth_text"),
        *[_cell(column).alias(name) for name, column in roles.metadata().items()],
    )
    parsed = cells.withColumns({
        "depth_value": depth_value(F.col("depth_text")),
        "basename_key": tx.basename_key(F.col("path_text")),
        "listed_path": tx.listed_path(F.col("path_text"), source_dir),
    })
    no_filter = F.lit(None).cast("string")
    judged = parsed.withColumns({
        "listed_key": tx.path_key(F.col("listed_path")),
        "rejected": F.when(
            F.col("identifier").isNull(), F.lit("invalid_identifier")
        ).otherwise(
            depth_filter.outcome(F.col("depth_text"), F.col("depth_value"))
            if depth_filter else no_filter
        ),
        "eligible": F.col("identifier").isNotNull() & (
            depth_filter.keeps(F.col("depth_text"), F.col("depth_value")) if depth_filter else F.lit(True)
        ),
        "listed": (F.col("path_text") != "") & (F.col("basename_key") != "")
        & ~F.lower(F.col("path_text")).isin(*PLACEHOLDERS),
        "path_kind": F.when(F.col("path_text") == "", F.lit("blank"))
        .when(F.lower(F.col("path_text")).isin(*PLACEHOLDERS), F.lit("placeholder"))
        .when(F.col("basename_key") == "", F.lit("nameless"))
        .otherwise(F.lit("listed")),
    })
    return judged.withColumns({
        "match_identifier": tx.match_identifier(F.col("identifier")),
        "reject_detail": F.when(
            F.col("rejected") == "invalid_identifier",
            F.lit("Identifier must contain 1 to 14 digits."),
        ).otherwise(
            depth_filter.detail(F.col("rejected"), F.col("depth_text"), F.col("depth_value"))
            if depth_filter else no_filter
        ),
    }).drop("depth_text", "depth_value")


def metadata_in(tagged: DataFrame) -> list[str]:
    return [name for name in METADATA_COLUMNS if name in tagged.columns]


def first_filled(name: str) -> Column:
    """Earliest non-blank value as a mergeable ``(import_row, value)`` minimum."""
    return F.min(
        F.when(F.col(name) != "", F.struct(F.col("import_row").alias("row"), F.col(name).alias("value")))
    ).alias(name)


def identifier_table(tagged: DataFrame) -> DataFrame:
    """One row per valid identifier: first eligible row and row counts.

    Every aggregate is a mergeable number, so it hashes without a sort and a dominant
    identifier is combined map-side.
    """
    ok = F.col("eligible")

    def count(condition: Column) -> Column:
        return F.count_if(condition)

    return (
        tagged.filter(F.col("identifier").isNotNull())
        .groupBy("identifier")
        .agg(
            F.min("import_row").alias("seen_row"),
            F.min(F.when(ok, F.col("import_row"))).alias("id_rank"),
            count(ok).alias("n_eligible"),
            count(ok & (F.col("path_kind") == "placeholder")).alias("n_placeholder"),
            count(ok & (F.col("path_kind") == "blank")).alias("n_blank"),
            count(~ok | ~F.col("listed")).alias("n_without_candidate"),
        )
    )

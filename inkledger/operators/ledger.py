"""Review ledger: validation, merge, progress, ordering and removal.

A ledger DataFrame has ``file_key`` (lower-case file name, unique), ``file_name``,
``file_path``, ``log_api``, ``has_stamp`` (nullable boolean), ``stamp_type``, ``log_types``,
``notes``, ``reviewed_at``, ``reviewed_by`` and optional metadata text columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions import state
from inkledger.functions import text as tx
from inkledger.operators.skew import salted_join
from inkledger.vocabulary import LEDGER_REQUIRED, METADATA_COLUMNS

TEXT_COLUMNS = (
    "file_name", "file_path", "log_api", "stamp_type", "log_types", "notes", "reviewed_by",
)


def file_key(name: Column | str) -> Column:
    return F.lower(tx.strip(name))


def conform(rows: DataFrame) -> DataFrame:
    """Any stored generation of the review table -> ledger columns, one row per file.

    Header case is ignored, ``api14`` stands in for ``log_api``, absent optional columns
    are blank, the name falls back on the path, nameless rows go, and of the rows of one
    name (case ignored) the last by ``position`` wins. Without that column rows count in the
    order in which they are read.
    """
    have = {c.strip().lower(): c for c in rows.columns}

    def pick(*names: str) -> Column:
        for name in names:
            if name in have:
                return tx.text_or_blank(F.col(f"`{have[name]}`"))
        return F.lit("")

    position = F.col(have["position"]).cast("long") if "position" in have else F.monotonically_increasing_id()
    path = pick("file_path")
    link = pick("file_link", "file_name")
    verdict = (
        tx.parse_bool(F.col(f"`{have['has_stamp']}`"))
        if "has_stamp" in have else F.lit(None).cast("boolean")
    )
    shaped = rows.select(
        F.when(link != "", link).otherwise(tx.basename(path)).alias("file_name"),
        path.alias("file_path"),
        pick("log_api", "api14").alias("log_api"),
        verdict.alias("has_stamp"),
        pick("type_of_stamp", "stamp_type").alias("stamp_type"),
        pick("log_types").alias("log_types"),
        pick("notes").alias("notes"),
        pick("reviewed_at").alias("reviewed_at"),
        pick("reviewed_by").alias("reviewed_by"),
        *[pick(name).alias(name) for name in METADATA_COLUMNS],
        position.alias("position"),
    ).filter(F.col("file_name") != "")
    body = F.struct(*[c for c in shaped.columns if c != "position"])
    last = shaped.groupBy(F.lower("file_name").alias("file_key")).agg(
        F.max(F.struct(F.col("position"), body.alias("row"))).alias("m")
    )
    return last.select("file_key", "m.row.*", "m.position")


# ------------------------------------------------------------------ validation

def missing_columns(columns: list[str]) -> list[str]:
    """Required headers that are absent; starts no job."""
    have = {c.strip().lower() for c in columns}
    missing = [name for name in LEDGER_REQUIRED if name not in have]
    if not have & {"log_api", "api14"}:
        missing.append("log_api (or legacy api14)")
    return missing


def row_issues(rows: DataFrame) -> DataFrame:
    """Issues of raw review rows (``row_number, file_link, has_stamp, type_of_stamp`` text).

    Rows after the first of a name (case ignored) are duplicates. The first row per
    name is a mergeable minimum joined back, so a name repeated very often is split.
    """
    name = tx.text_or_blank("file_link")
    verdict = tx.parse_bool("has_stamp")
    raw = F.coalesce(F.col("has_stamp").cast("string"), F.lit(""))
    number = F.col("row_number").cast("string")
    any_data = F.concat_ws("", *[F.col(c).cast("string") for c in rows.columns if c != "row_number"]) != ""

    def issues(condition: Column, rule: str, message: Column) -> DataFrame:
        return rows.filter(condition).select(
            "row_number", F.lit(rule).alias("rule"), message.alias("message")
        )

    nameless = issues(
        (name == "") & any_data, "1_nameless",
        F.concat(F.lit("Row "), number, F.lit(" has data but no file name.")),
    )
    bad_verdict = issues(
        (name != "") & (raw != "") & verdict.isNull(), "3_verdict",
        F.concat(F.lit("Row "), number, F.lit(" has an invalid has_stamp value: '"), raw, F.lit("'")),
    )
    no_with_type = issues(
        (name != "") & ~F.coalesce(verdict, F.lit(True)) & (tx.text_or_blank("type_of_stamp") != ""),
        "4_no_with_type",
        F.concat(F.lit("Row "), number, F.lit(" says no stamp but also supplies a stamp type.")),
    )
    named = rows.select("row_number", name.alias("name"), F.lower(name).alias("key")).filter("key <> ''")
    first = named.groupBy("key").agg(
        F.min("row_number").alias("first_row"), F.count(F.lit(1)).alias("n_rows")
    )
    duplicate = (
        salted_join(named, first.filter("n_rows > 1"), ["key"], "inner", weight="n_rows")
        .filter("row_number > first_row")
        .select(
            "row_number", F.lit("2_duplicate").alias("rule"),
            F.concat(F.lit("Duplicate file name at row "), F.col("row_number").cast("string"),
                     F.lit(": "), F.col("name")).alias("message"),
        )
    )
    return nameless.unionByName(duplicate).unionByName(bad_verdict).unionByName(no_with_type)


def first_issues(issues: DataFrame, n: int = 12) -> DataFrame:
    """The report shows the first ``n`` issues in row and rule order."""
    return issues.orderBy("row_number", "rule").limit(n)


def reconcile(ledger_names: DataFrame, folder_names: DataFrame) -> DataFrame:
    """Names (``name``) only in the folder (missing) or only in the ledger (extra)."""
    def keyed(df: DataFrame, order: str) -> DataFrame:
        return df.groupBy(F.lower("name").alias("key")).agg(F.max("name").alias(order))

    both = keyed(folder_names, "in_folder").join(keyed(ledger_names, "in_ledger"), "key", "full_outer")
    return both.filter("in_folder is null or in_ledger is null").select(
        F.when(F.col("in_ledger").isNull(), "missing").otherwise("extra").alias("kind"),
        F.coalesce("in_folder", "in_ledger").alias("name"),
    )


# ------------------------------------------------------------------ membership

def remove_rows(ledger: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by case-insensitive ``name``."""
    keys = names.select(F.lower("name").alias("file_key")).distinct()
    return (
        ledger.join(keys, "file_key", "left_anti"),
        ledger.join(keys, "file_key", "left_semi"),
    )


def keep_extras(ledger: DataFrame, order: DataFrame) -> DataFrame:
    """Save order: requested names (``name, position``) first, then retained rows.

    Adds ``save_phase`` and ``save_position``; a requested name without a row is skipped.
    """
    asked = order.groupBy(F.lower("name").alias("file_key")).agg(F.min("position").alias("_asked"))
    return (
        ledger.join(asked, "file_key", "left")
        .withColumn("save_phase", F.when(F.col("_asked").isNotNull(), 0).otherwise(1))
        .withColumn("save_position", F.coalesce("_asked", F.col("position")))
        .drop("_asked")
    )


def merge_files(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Seed or update rows for ``files`` (``path, identifier, from_manifest`` + metadata).

    New files get a blank row. Known files get the new path, keep a non-blank
    identifier unless the manifest names one, and take non-blank metadata only.
    """
    metas = [name for name in METADATA_COLUMNS if name in files.columns]
    incoming = files.groupBy(tx.basename_key(F.col("path")).alias("file_key")).agg(
        F.max(F.struct("path", "identifier", "from_manifest", *metas)).alias("new")
    )
    joined = ledger.join(incoming, "file_key", "full_outer")
    new = F.col("new")
    is_new = new.isNotNull()

    def fresh(field: str) -> Column:
        return F.nullif(tx.text_or_blank(new[field]), F.lit(""))

    identifier = F.when(is_new & new["from_manifest"], fresh("identifier")).otherwise(
        F.coalesce(F.nullif(F.col("log_api"), F.lit("")), fresh("identifier"))
    )
    keep = [c for c in ledger.columns if c not in {"file_key", "file_name", "file_path", "log_api", *METADATA_COLUMNS}]
    blank = {"stamp_type", "log_types", "notes", "reviewed_by"}
    return joined.select(
        "file_key",
        F.when(is_new, tx.basename(new["path"])).otherwise(F.col("file_name")).alias("file_name"),
        F.when(is_new, new["path"]).otherwise(F.col("file_path")).alias("file_path"),
        F.coalesce(identifier, F.col("log_api"), F.lit("")).alias("log_api"),
        *[(F.coalesce(F.col(c), F.lit("")) if c in blank else F.col(c)).alias(c) for c in keep],
        *[
            F.coalesce(
                fresh(name) if name in metas else F.lit(None).cast("string"),
                F.col(name) if name in ledger.columns else F.lit(None).cast("string"),
                F.lit(""),
            ).alias(name)
            for name in METADATA_COLUMNS if name in metas or name in ledger.columns
        ],
    )


# -------------------------------------------------------------------- progress

def with_state(ledger: DataFrame) -> DataFrame:
    cells = (F.col("has_stamp"), F.col("stamp_type"), F.col("log_types"), F.col("notes"))
    return ledger.withColumns({
        "reviewed": state.reviewed(*cells[:2]),
        "has_entry": state.has_entry(*cells),
    }).withColumn("incomplete", F.col("has_entry") & ~F.col("reviewed"))


def progress(ledger: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Reviewed, with a stamp and incomplete counts, optionally within ``name``s."""
    rows = with_state(ledger)
    if scope is not None:
        rows = rows.join(
            scope.select(F.lower("name").alias("file_key")).distinct(), "file_key", "left_semi"
        )
    return rows.agg(
        F.count_if("reviewed").alias("n_reviewed"),
        F.count_if(F.coalesce("has_stamp", F.lit(False))).alias("n_with_stamp"),
        F.count_if("incomplete").alias("n_incomplete"),
    )


def status_filter(ledger: DataFrame, mode: str) -> DataFrame:
    """``all``, ``todo`` (not reviewed) or ``done``."""
    if mode == "all":
        return ledger
    done = state.reviewed(F.col("has_stamp"), F.col("stamp_type"))
    return ledger.filter(done if mode == "done" else ~done)


def list_rows(ledger: DataFrame) -> DataFrame:
    """The review list: mark, name, interval, verdict, types, notes and row tag."""
    rows = with_state(ledger)
    shown = F.col("has_entry")
    blank = F.lit("")

    def when_shown(value: Column) -> Column:
        return F.when(shown, value).otherwise(blank)

    return rows.select(
        "file_key",
        when_shown(F.when(F.col("incomplete"), "warn").otherwise("check")).alias("mark"),
        "file_name",
        *[
            (F.col(c) if c in ledger.columns else blank).alias(c)
            for c in ("log_top_depth", "log_bottom_depth")
        ],
        when_shown(state.verdict_text(F.col("has_stamp"))).alias("stamp"),
        when_shown(F.col("stamp_type")).alias("stamp_type"),
        when_shown(F.col("notes")).alias("notes"),
        F.when(~shown, "todo").when(F.col("incomplete"), "warn").otherwise("done").alias("tag"),
    )


def next_unreviewed(ledger: DataFrame, after: int | None = None) -> DataFrame:
    """Position of the first unreviewed row, cyclically after ``after`` when given."""
    done = state.reviewed(F.col("has_stamp"), F.col("stamp_type"))
    wrapped = F.lit(False) if after is None else F.col("position") <= after
    return ledger.agg(
        F.min(F.when(~done, F.struct(wrapped.alias("wrapped"), F.col("position"))))["position"].alias("position")
    )


def most_recent_reviewer(ledger: DataFrame) -> DataFrame:
    """Reviewer on the latest timestamp; the first position wins ties."""
    return ledger.filter("reviewed_by <> ''").agg(
        F.max(
            F.struct(F.col("reviewed_at"), (-F.col("position")).alias("p"), F.col("reviewed_by"))
        )["reviewed_by"].alias("reviewed_by")
    )

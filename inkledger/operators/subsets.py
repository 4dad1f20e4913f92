"""Evaluation subsets: ordered identifier membership and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.functions import text as tx
from inkledger.vocabulary import LEDGER_COLUMNS, LEGACY_SUBSET_COLUMNS, METADATA_COLUMNS


def define(identifiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordered distinct members, rejected values) of ``position, value`` rows.

    The subset may be stored only when the rejected part is empty.
    """
    clean = identifiers.select("position", tx.strip("value").alias("identifier"))
    ok = tx.is_identifier("identifier")
    members = clean.filter(ok).groupBy("identifier").agg(F.min("position").alias("position"))
    return members, clean.filter(~ok)


def scope(ledger: DataFrame, members: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Ledger rows (or files) whose identifier is a member.

    With ``files`` (``path``), a file without a record falls back on the identifier its
    name begins with.
    """
    wanted = members.select("identifier").distinct()
    if files is None:
        return ledger.join(wanted.withColumnRenamed("identifier", "log_api"), "log_api", "left_semi")
    keyed = files.withColumn("file_key", tx.basename_key(F.col("path")))
    known = ledger.select("file_key", "log_api")
    return (
        keyed.join(known, "file_key", "left")
        .withColumn("identifier", F.coalesce(F.col("log_api"), tx.leading_api(F.col("path"))))
        .drop("log_api")
        .join(wanted, "identifier", "left_semi")
    )


def header_ok(columns: list[str]) -> bool:
    """The mirror must repeat the review header, in order; starts no job."""
    actual = [c.strip().lower() for c in columns]
    return actual == [*LEDGER_COLUMNS, *(c for c in METADATA_COLUMNS if c in actual)]


def is_legacy(columns: list[str]) -> bool:
    return set(LEGACY_SUBSET_COLUMNS) <= {c.strip().lower() for c in columns}


def mirror_issues(rows: DataFrame) -> DataFrame:
    """Bad identifiers, missing names and repeated names of a full mirror."""
    number = F.col("row_number").cast("string")
    api, name = tx.text_or_blank("log_api"), tx.text_or_blank("file_link")
    filled = rows.filter((api != "") | (name != ""))
    bad_api = filled.filter(~tx.is_identifier(api)).select(
        "row_number",
        F.concat(F.lit("Subset row "), number, F.lit(" must contain a 1-14 digit log_api.")).alias("message"),
    )
    nameless = filled.filter(tx.is_identifier(api) & (name == "")).select(
        "row_number", F.concat(F.lit("Subset row "), number, F.lit(" has no file_link value.")).alias("message")
    )
    named = filled.filter(name != "").select("row_number", name.alias("name"), F.lower(name).alias("key"))
    firsts = named.groupBy("key").agg(F.min("row_number").alias("row_number"))
    repeated = named.join(firsts, ["key", "row_number"], "left_anti").select(
        "row_number",
        F.concat(F.lit("Subset row "), number, F.lit(" duplicates file name '"), F.col("name"), F.lit("'.")).alias("message"),
    )
    return bad_api.unionByName(nameless).unionByName(repeated)


def mirror_members(rows: DataFrame) -> DataFrame:
    """Distinct identifiers of a mirror by first row."""
    api = tx.text_or_blank("log_api")
    return rows.filter(tx.is_identifier(api)).groupBy(api.alias("identifier")).agg(
        F.min("row_number").alias("position")
    )


def legacy_issues(rows: DataFrame) -> DataFrame:
    """Rows of a (position, log_api) list that break its rules."""
    number = F.col("row_number").cast("string")
    position = tx.text_or_blank("position").try_cast("int")
    api = tx.text_or_blank("log_api")
    filled = rows.select(
        "row_number", tx.text_or_blank("position").alias("raw"), position.alias("position"), api.alias("api")
    ).filter("raw <> '' or api <> ''")
    first_position = filled.groupBy("position").agg(F.min("row_number").alias("row_number"))
    first_api = filled.groupBy("api").agg(F.min("row_number").alias("row_number"))

    def message(df: DataFrame, text: str) -> DataFrame:
        return df.select("row_number", F.concat(F.lit("Subset row "), number, F.lit(text)).alias("message"))

    invalid = message(filled.filter("position is null"), " has an invalid position.")
    usable = filled.filter("position is not null")
    low = usable.filter("position < 1")
    again = usable.filter("position >= 1").join(first_position, ["position", "row_number"], "left_anti")
    places = message(low.unionByName(again.select(low.columns)), " has a duplicate or invalid position.")
    bad_id = usable.filter(~tx.is_identifier("api"))
    repeat = usable.filter(tx.is_identifier("api")).join(first_api, ["api", "row_number"], "left_anti")
    apis = message(bad_id.unionByName(repeat.select(bad_id.columns)), " must contain a unique 1-14 digit log_api.")
    return invalid.unionByName(places).unionByName(apis)


def legacy_members(rows: DataFrame) -> DataFrame:
    return rows.select(
        tx.text_or_blank("position").try_cast("int").alias("position"),
        tx.text_or_blank("log_api").alias("identifier"),
    ).filter(tx.is_identifier("identifier")).orderBy("position")

"""Type catalogs: labels in use, merge, rename and removal.

A catalog is a DataFrame ``(position, label)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.functions import state
from inkledger.functions import text as tx


def distinct_labels(rows: DataFrame, order: list[str]) -> DataFrame:
    """First spelling per label ignoring case, by ``order``; blanks dropped."""
    first = F.min(F.struct(*order, "label"))
    return (
        rows.withColumn("label", tx.strip("label")).filter("label <> ''")
        .groupBy(F.lower("label").alias("label_key"))
        .agg(first.alias("f"))
        .select("label_key", "f.label", *[F.col(f"f.{c}").alias(c) for c in order])
    )


def labels_in_use(ledger: DataFrame, column: str = "stamp_type") -> DataFrame:
    """Labels found in a multi-value column, first spelling by row position."""
    cells = ledger.select(
        "position", F.posexplode(tx.split_values(F.col(column))).alias("at", "label")
    )
    return distinct_labels(cells, ["position", "at"])


def merge_catalog(catalog: DataFrame, used: DataFrame) -> DataFrame:
    """Offered labels, then used labels that are not offered yet, in label-key order.

    Catalogs are short lists, so one sorted window over the new labels is enough.
    """
    offered = catalog.select(F.lit(0).alias("phase"), F.col("position").cast("long").alias("position"), "label")
    known = catalog.select(F.lower("label").alias("label_key"))
    extra = used.select("label_key", "label").join(known, "label_key", "left_anti")
    numbered = extra.select(
        F.lit(1).alias("phase"),
        (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("label_key")) - 1).cast("long").alias("position"),
        "label",
    )
    return offered.unionByName(numbered)


def add_label(catalog: DataFrame, label: str) -> DataFrame:
    """Add one label at the end, reusing an existing spelling; commas are refused."""
    label = label.strip()
    if not label or "," in label:
        raise ValueError("a label may not be blank or hold a comma")
    one = catalog.sparkSession.range(1).select(
        F.lit(2**31).cast("long").alias("position"), F.lit(label).alias("label")
    )
    rows = catalog.select(F.col("position").cast("long").alias("position"), "label").unionByName(one)
    return distinct_labels(rows, ["position"]).select("position", "label")


def replaced_values(cell: Column, old: str, new: str = "") -> Column:
    """Values of a cell after renaming (or, with a blank ``new``, removing) one label."""
    old_key, new = old.strip().lower(), new.strip()
    swapped = F.transform(
        tx.split_values(cell), lambda v: F.when(F.lower(v) == old_key, F.lit(new)).otherwise(v)
    )
    return tx.clean_values(swapped)


def replace_label(
    ledger: DataFrame, old: str, new: str = "", edited_at: Column | None = None, reviewed_by: str = ""
) -> DataFrame:
    """Rename, merge or remove a label in all rows.

    Adds ``changed`` and ``made_incomplete`` so that both counts are one aggregate away.
    """
    old_key = old.strip().lower()
    hit = F.lit(bool(old_key)) & F.exists(
        tx.split_values(F.col("stamp_type")), lambda v: F.lower(v) == old_key
    )
    after = F.array_join(replaced_values(F.col("stamp_type"), old, new), ", ")
    stamp = F.col("reviewed_at") if edited_at is None else edited_at
    rows = ledger.withColumns({
        "changed": hit,
        "was_reviewed": state.reviewed(F.col("has_stamp"), F.col("stamp_type")),
    })
    rows = rows.withColumns({
        "stamp_type": F.when(F.col("changed"), after).otherwise(F.col("stamp_type")),
        "reviewed_at": F.when(F.col("changed"), stamp).otherwise(F.col("reviewed_at")),
        "reviewed_by": F.when(F.col("changed") & F.lit(bool(reviewed_by)), F.lit(reviewed_by)).otherwise(F.col("reviewed_by")),
    })
    return rows.withColumn(
        "made_incomplete",
        F.col("was_reviewed") & ~state.reviewed(F.col("has_stamp"), F.col("stamp_type")),
    ).drop("was_reviewed")


def change_counts(replaced: DataFrame) -> DataFrame:
    return replaced.agg(
        F.count_if("changed").alias("n_changed"), F.count_if("made_incomplete").alias("n_made_incomplete")
    )


def rename_in_catalog(catalog: DataFrame, old: str, new: str = "") -> DataFrame:
    """Same change on the list: positions stay, an existing spelling is reused."""
    old_key, new_key = old.strip().lower(), new.strip().lower()
    rows = catalog.select(F.col("position").cast("long").alias("position"), "label").withColumn(
        "label_key", F.lower("label")
    )
    if new_key and new_key != old_key:
        spelled = rows.filter(F.col("label_key") == new_key).agg(
            F.min(F.struct("position", "label"))["label"].alias("s")
        )
        target = F.coalesce(spelled.scalar(), F.lit(new.strip()))
    else:
        target = F.lit(new.strip())
    changed = rows.withColumn(
        "label", F.when(F.col("label_key") == old_key, target).otherwise(F.col("label"))
    ).drop("label_key")
    if new_key:
        added = catalog.sparkSession.range(1).select(
            F.lit(2**31).cast("long").alias("position"), target.alias("label")
        )
        changed = changed.unionByName(added)
    return distinct_labels(changed, ["position"]).select("position", "label")

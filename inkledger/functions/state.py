"""State of a review record. A null verdict means "not reviewed", never "no"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkledger.functions.text import join_values, split_values


def _filled(cell: Column) -> Column:
    return F.coalesce(cell, F.lit("")) != ""


def reviewed(has_stamp: Column, stamp_type: Column) -> Column:
    no = F.coalesce(~has_stamp, F.lit(False))
    yes = F.coalesce(has_stamp, F.lit(False))
    return no | (yes & (F.size(split_values(stamp_type)) > 0))


def has_entry(has_stamp: Column, stamp_type: Column, log_types: Column, notes: Column) -> Column:
    return has_stamp.isNotNull() | _filled(stamp_type) | _filled(log_types) | _filled(notes)


def incomplete(has_stamp: Column, stamp_type: Column, log_types: Column, notes: Column) -> Column:
    return has_entry(has_stamp, stamp_type, log_types, notes) & ~reviewed(has_stamp, stamp_type)


def tag(has_stamp: Column, stamp_type: Column, log_types: Column, notes: Column) -> Column:
    return (
        F.when(~has_entry(has_stamp, stamp_type, log_types, notes), F.lit("todo"))
        .when(reviewed(has_stamp, stamp_type), F.lit("done"))
        .otherwise(F.lit("warn"))
    )


def verdict_text(has_stamp: Column) -> Column:
    return F.when(has_stamp.isNull(), F.lit("")).when(has_stamp, F.lit("yes")).otherwise(F.lit("no"))


def verdict_types(has_stamp: Column, stamp_type: Column) -> Column:
    """Types survive only with a yes."""
    return F.when(has_stamp, join_values(split_values(stamp_type))).otherwise(F.lit(""))


def draft_valid(has_stamp: Column, stamp_values: Column) -> Column:
    """A yes needs at least one type, none blank, none repeated ignoring case."""
    lowered = F.transform(stamp_values, F.lower)
    listed = (
        (F.size(stamp_values) > 0)
        & ~F.exists(stamp_values, lambda v: v == "")
        & (F.size(F.array_distinct(lowered)) == F.size(lowered))
    )
    return F.when(F.coalesce(has_stamp, F.lit(False)), listed).otherwise(F.lit(True))

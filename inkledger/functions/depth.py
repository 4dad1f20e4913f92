"""Strict depth filter on a text column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkledger.functions.text import general_number, strip


def depth_value(text: Column) -> Column:
    """Numeric depth of a cell, thousands commas ignored; null when not a number.

    A bare cast also reads ``1.0d``, ``1f`` and hexadecimal, so those forms are refused.
    """
    bare = F.replace(strip(text), F.lit(","), F.lit(""))
    low = F.lower(bare)
    suffixed = low.endswith("d") | (low.endswith("f") & ~low.endswith("inf")) | low.contains("x")
    return (
        F.when(suffixed, F.lit(None).cast("double"))
        .when(low.isin("+nan", "-nan"), F.lit(float("nan")))
        .otherwise(bare.try_cast("double"))
    )


@dataclass(frozen=True)
class DepthFilter:
    column: str
    comparison: str
    threshold: float
    include_blank: bool = False

    def __post_init__(self) -> None:
        if self.comparison not in ("less_than", "greater_than"):
            raise ValueError("comparison must be less_than or greater_than")

    @property
    def symbol(self) -> str:
        return "<" if self.comparison == "less_than" else ">"

    @property
    def description(self) -> str:
        blanks = "including" if self.include_blank else "excluding"
        return f"{self.column} {self.symbol} {self.threshold:g} ft, {blanks} blank depths"

    def passes(self, value: Column) -> Column:
        """Strict comparison. NaN sorts above every number in Spark, so it is moved below."""
        limit = F.lit(float(self.threshold))
        if self.symbol == "<":
            return F.coalesce(value < limit, F.lit(False))
        return F.coalesce(F.nanvl(value, F.lit(float("-inf"))) > limit, F.lit(False))

    def keeps(self, text: Column, value: Column) -> Column:
        """Whether the row stays; ``text`` is the stripped cell."""
        return F.when(text == "", F.lit(self.include_blank)).otherwise(self.passes(value))

    def outcome(self, text: Column, value: Column) -> Column:
        """Null when the row stays, otherwise the name of the rejection."""
        blank = F.lit(None).cast("string") if self.include_blank else F.lit("filtered_blank_depth")
        return (
            F.when(text == "", blank)
            .when(self.passes(value), F.lit(None).cast("string"))
            .when(value.isNull(), F.lit("filtered_invalid_depth"))
            .otherwise(F.lit("filtered_depth"))
        )

    def detail(self, outcome: Column, text: Column, value: Column) -> Column:
        """Readable reason that belongs to ``outcome``."""
        shown = (
            F.when(F.isnan(value), F.lit("nan"))
            .when(value == float("inf"), F.lit("inf"))
            .when(value == float("-inf"), F.lit("-inf"))
            .otherwise(general_number(value))
        )
        return (
            F.when(
                outcome == "filtered_blank_depth",
                F.lit(f"Blank {self.column} excluded by the depth filter."),
            )
            .when(
                outcome == "filtered_invalid_depth",
                F.concat(F.lit(f"{self.column} is not a numeric depth: '"), text, F.lit("'.")),
            )
            .when(
                outcome == "filtered_depth",
                F.concat(
                    F.lit("Depth "), shown,
                    F.lit(f" ft does not satisfy {self.symbol} {self.threshold:g} ft."),
                ),
            )
        )

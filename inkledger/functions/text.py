"""Text expressions: identifiers, file names, paths and multi-value cells."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkledger.vocabulary import FALSE_WORDS, IMAGE_EXTENSIONS, PLACEHOLDERS, TRUE_WORDS


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# Characters that count as surrounding whitespace.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column | str) -> Column:
    """Remove all leading and trailing whitespace (Spark's trim removes spaces only)."""
    return F.btrim(_col(value), F.lit(WHITESPACE))


def text_or_blank(value: Column | str) -> Column:
    """Null becomes blank, everything else is stripped text."""
    return F.coalesce(strip(_col(value).cast("string")), F.lit(""))


def header_key(value: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(value)), "[^a-z0-9]", "")


def header_key_of(name: str) -> str:
    """Driver-side form of header_key for column names."""
    return re.sub("[^a-z0-9]", "", str(name).strip().lower())


# ---------------------------------------------------------------- identifiers

def is_identifier(value: Column | str) -> Column:
    """1 to 14 ASCII digits after stripping; null is false."""
    return F.coalesce(strip(value).rlike(r"^[0-9]{1,14}\z"), F.lit(False))


def identifier(value: Column | str) -> Column:
    """The stripped identifier, or null when it is not one."""
    return F.when(is_identifier(value), strip(value))


def identifier_variants(ident: Column | str) -> Column:
    """File-name spellings of a valid identifier; 12 digits also match with 00 added."""
    ident = _col(ident)
    return F.when(
        F.length(ident) == 12, F.array(ident, F.concat(ident, F.lit("00")))
    ).otherwise(F.array(ident))


def match_identifier(ident: Column | str) -> Column:
    """The longest spelling; blank when there is no identifier."""
    ident = _col(ident)
    longest = F.when(F.length(ident) == 12, F.concat(ident, F.lit("00"))).otherwise(ident)
    return F.coalesce(longest, F.lit(""))


# ----------------------------------------------------------------- file names

def forward_slashes(path: Column | str) -> Column:
    return F.translate(_col(path), "\\", "/")


def basename(path: Column | str) -> Column:
    """Text after the last slash of either kind."""
    return F.substring_index(forward_slashes(path), "/", -1)


def basename_key(path: Column | str) -> Column:
    return F.lower(basename(path))


def leading_digits(name: Column | str) -> Column:
    """The digit run a name starts with, blank when it starts with something else."""
    return F.regexp_extract(_col(name), "^[0-9]+", 0)


def name_matches_identifier(path: Column | str, variants: Column | str) -> Column:
    """A name matches when its whole leading digit run is one of the spellings.

    Written as an equality so that the join form of this test is a hash join.
    """
    return F.array_contains(_col(variants), leading_digits(basename(path)))


def api14(path: Column | str) -> Column:
    """First run of 14 digits anywhere in the base name, or blank."""
    return F.regexp_extract(basename(path), "([0-9]{14})", 1)


def leading_api(path: Column | str) -> Column:
    """14 digits at the start of the base name that no 15th digit follows, or blank."""
    digits = leading_digits(basename(path))
    return F.when(F.length(digits) == 14, digits).otherwise(F.lit(""))


def is_image(path: Column | str) -> Column:
    low = F.lower(_col(path))
    return reduce(lambda a, b: a | b, [low.endswith("." + ext) for ext in IMAGE_EXTENSIONS])


def is_placeholder(path: Column | str) -> Column:
    return F.lower(strip(path)).isin(*PLACEHOLDERS)


# ---------------------------------------------------------------------- paths

def is_absolute(path: Column | str) -> Column:
    """Rooted, UNC or drive paths; one rule on every operating system."""
    unified = forward_slashes(path)
    return unified.startswith("/") | (
        (F.substring(unified, 2, 2) == ":/") & F.substring(unified, 1, 1).rlike("[A-Za-z]")
    )


def listed_path(path: Column | str, directory: str | Column) -> Column:
    """Relative paths are taken from the manifest's directory."""
    path = _col(path)
    directory = F.lit(directory) if isinstance(directory, str) else directory
    return F.when(is_absolute(path), path).otherwise(F.concat(directory, F.lit("/"), path))


def path_key(path: Column | str) -> Column:
    """Comparison form of a path: one slash, no ``.``/``..`` steps, case ignored."""
    unified = F.lower(forward_slashes(path))

    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), done)
            .when(
                (part == "..") & (F.size(done) > 0),
                F.slice(done, F.lit(1), F.size(done) - 1),
            )
            .when(part == "..", done)
            .otherwise(F.concat(done, F.array(part)))
        )

    lead = F.regexp_extract(unified, "^(//|/|)", 1)
    parts = F.aggregate(F.split(unified, "/"), F.array().cast("array<string>"), step)
    tidy = F.concat(lead, F.array_join(parts, "/"))
    # Plain substring tests keep the common, already tidy path off the array route.
    untidy = (
        F.substr(unified, F.lit(2)).contains("//") | unified.contains("/.")
        | unified.startswith(".") | unified.endswith("/")
    )
    return F.when(untidy, tidy).otherwise(unified)


def share_root(path: Column | str) -> Column:
    r"""``\\server\share`` of a UNC path, otherwise blank."""
    unified = F.translate(_col(path), "/", "\\")
    found = r"^\\\\\\*([^\\]+)\\+([^\\]+)"
    server = F.regexp_extract(unified, found, 1)
    share = F.regexp_extract(unified, found, 2)
    return F.when(server != "", F.concat(F.lit("\\\\"), server, F.lit("\\"), share)).otherwise(
        F.lit("")
    )


# ----------------------------------------------------------- multi-value cells

def clean_values(values: Column) -> Column:
    """Strip, drop blanks, and keep the first spelling of each value ignoring case."""
    kept = F.filter(F.transform(values, strip), lambda v: v != "")
    keys = F.transform(kept, F.lower)
    return F.filter(kept, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1)


def split_values(cell: Column | str) -> Column:
    """Comma-separated cell -> ordered distinct array."""
    return clean_values(F.split(F.coalesce(_col(cell), F.lit("")), ","))


def join_values(values: Column | str) -> Column:
    """Array -> canonical comma-separated cell."""
    return F.array_join(split_values(F.array_join(_col(values), ",")), ", ")


def parse_bool(value: Column | str) -> Column:
    """Text verdict -> true, false or null."""
    low = F.lower(strip(_col(value).cast("string")))
    return F.when(low.isin(*TRUE_WORDS), F.lit(True)).when(
        low.isin(*FALSE_WORDS), F.lit(False)
    )


def general_number(value: Column) -> Column:
    """A double as text with six significant digits and no trailing zeros."""
    raw = F.format_string("%.6g", value)
    short = F.regexp_replace(raw, "([.][0-9]*?)0+(e|$)", "$1$2")
    return F.regexp_replace(short, "[.](e|$)", "$1")

"""Review commits: the latest effective edit of every file.

A commit has ``commit_id`` (unique), ``file_name``, ``has_stamp`` (nullable boolean),
``stamp_types`` (array, as drafted), ``log_types`` (array), ``notes``, ``reviewed_at`` and
``reviewed_by``. Edits of one file apply in ``(reviewed_at, commit_id)`` order, whatever
order they arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.functions import state
from inkledger.functions import text as tx
from inkledger.operators.ledger import file_key
from inkledger.operators.skew import salted_join


COMMIT_COLUMNS = (
    "commit_id", "file_name", "has_stamp", "stamp_types", "log_types", "notes", "reviewed_at", "reviewed_by",
)


def draft_states(commits: DataFrame, *carry: Column) -> DataFrame:
    """Valid drafts with their canonical state and order key.

    Drafts without a reviewer or with an unfinished yes are refused.
    """
    draft = F.struct(
        F.col("has_stamp"),
        F.when(F.col("has_stamp"), F.array_join(tx.clean_values(F.col("stamp_types")), ", "))
        .otherwise("").alias("stamp_type"),
        F.array_join(tx.clean_values(F.col("log_types")), ", ").alias("log_types"),
        tx.text_or_blank("notes").alias("notes"),
    )
    return (
        commits.filter(state.draft_valid(F.col("has_stamp"), F.col("stamp_types")))
        .filter(F.coalesce(F.col("reviewed_by"), F.lit("")) != "")
        .select(
            file_key("file_name").alias("file_key"),
            draft.alias("draft"),
            F.struct("reviewed_at", "commit_id").alias("at"),
            "file_name", "reviewed_by", *carry,
        )
    )


def _closing(drafts: DataFrame) -> DataFrame:
    """Per file: its last draft, how often that occurs, and when another was last current.

    Latest time of every distinct draft of a file; at most two rows per file matter.
    """
    per_draft = drafts.groupBy("file_key", "draft").agg(
        F.max("at").alias("at"), F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy("file_key").orderBy(F.col("at").desc())
    top = per_draft.withColumn("k", F.row_number().over(order)).filter("k <= 2")
    return top.groupBy("file_key").agg(
        F.max(F.when(F.col("k") == 1, F.struct("draft"))).alias("last"),
        F.max(F.when(F.col("k") == 2, F.col("at"))).alias("other_at"),
        F.max(F.when(F.col("k") == 1, F.col("n"))).alias("n"),
    ).select("file_key", F.col("last.draft").alias("draft"), "other_at", "n")


def live_commits(commits: DataFrame, settled: Column | None = None) -> DataFrame:
    """The valid commits on which a file's state can still depend, however many come later.

    These are the closing run of equal drafts and the last commit with another draft before it.
    Commits from before that stay without effect when others are added anywhere, so ``latest_edits``
    of the live ones, with any later ones, is that of all. ``settled`` marks commits among which no
    other will come: of a run those go, except its first.
    """
    drafts = draft_states(commits, F.struct(*COMMIT_COLUMNS).alias("commit"))
    closing = _closing(drafts).select("file_key", F.col("draft").alias("last"), "other_at")
    sizes = drafts.groupBy("file_key").agg(F.count(F.lit(1)).alias("n"))
    kept = salted_join(drafts, closing.join(sizes, "file_key"), ["file_key"], "inner", weight="n").filter(
        F.col("other_at").isNull() | (F.col("at") >= F.col("other_at")))
    if settled is not None:
        in_run = F.col("draft") == F.col("last")
        begins = kept.filter(in_run).groupBy("file_key").agg(
            F.min("at").alias("begins"), F.count(F.lit(1)).alias("m"))
        kept = kept.select("file_key", "at", "draft", "last", "commit", "commit.*")
        kept = salted_join(kept.drop("file_name"), begins, ["file_key"], "inner", weight="m").filter(
            ~(in_run & settled & (F.col("at") > F.col("begins"))))
    return kept.select("commit.*")


def blank_draft() -> Column:
    return F.struct(
        F.lit(None).cast("boolean").alias("has_stamp"), F.lit("").alias("stamp_type"),
        F.lit("").alias("log_types"), F.lit("").alias("notes"),
    )


def _fields(draft: str) -> list[Column]:
    return [F.col(f"{draft}.{n}") for n in ("has_stamp", "stamp_type", "log_types", "notes")]


def latest_edits(commits: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """One row per edited file: its final state and the commit that brought it about.

    A draft equal to the state before it changes nothing, so the credited commit is the
    first of the closing run of equal drafts. It is found with three mergeable
    aggregates instead of a window over a file's whole history:
    the last draft, the last time another draft was current, and the first commit
    after that. ``baseline`` (``file_key`` + draft fields) is the state before all commits.
    """
    drafts = draft_states(commits)
    closing = _closing(drafts)
    run = salted_join(drafts, closing, ["file_key", "draft"], "inner", weight="n").filter(
        F.col("other_at").isNull() | (F.col("at") > F.col("other_at"))
    )
    won = run.groupBy("file_key").agg(
        F.min(F.struct("at", "draft", "other_at", "file_name", "reviewed_by")).alias("w")
    )
    result = won.select(
        "file_key", F.col("w.file_name").alias("file_name"), *_fields("w.draft"),
        F.col("w.at.reviewed_at").alias("reviewed_at"),
        F.col("w.at.commit_id").alias("commit_id"),
        F.col("w.reviewed_by").alias("reviewed_by"),
        F.col("w.other_at").isNull().alias("_only_state"),
    )
    # A single unchanging state only counts when it differs from the baseline.
    fields = ("has_stamp", "stamp_type", "log_types", "notes")
    if baseline is None:
        before = {name: blank_draft()[name] for name in fields}
        joined = result
    else:
        base = baseline.select("file_key", *[F.col(n).alias(f"_b_{n}") for n in fields])
        joined = result.join(base, "file_key", "left")
        before = {
            "has_stamp": F.col("_b_has_stamp"),
            **{n: F.coalesce(F.col(f"_b_{n}"), F.lit("")) for n in fields[1:]},
        }
    same = F.lit(True)
    for name in fields:
        same = same & F.col(name).eqNullSafe(before[name])
    return joined.filter(~(F.col("_only_state") & same)).select(*[c for c in result.columns if c != "_only_state"])


def apply_edits(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """Upsert of edits into a ledger; both have one row per file key."""
    new = edits.select(
        "file_key", F.struct(*[c for c in edits.columns if c != "file_key"]).alias("new")
    )
    joined = ledger.join(new, "file_key", "full_outer")
    replaced = {"has_stamp", "stamp_type", "log_types", "notes", "reviewed_at", "reviewed_by"}
    out = []
    for c in ledger.columns:
        if c in replaced:
            old = F.col(c)
            out.append(F.when(F.col("new").isNotNull(), F.col(f"new.{c}").cast(ledger.schema[c].dataType)).otherwise(old).alias(c))
        elif c == "file_name":
            out.append(F.coalesce(F.col(c), F.col("new.file_name")).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)

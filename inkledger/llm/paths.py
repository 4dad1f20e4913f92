"""Judging file links by pattern rules that are looked up by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# More rules than this are joined, not broadcast.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """``host`` and all below it, with a path that begins with ``path``; ``*`` as host is any.

    In ``path``, ``*`` stands for any run of characters.
    """

    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    @property
    def pattern(self) -> str:
        """Regular expression over host, control character 1 and path."""
        head = r"\A[^\x01]*\x01" if self.host == "*" else r"\A([^\x01]*\.)?" + re.escape(self.host) + r"\x01"
        return head + ".*".join(re.escape(p) for p in self.path.split("*"))

    @property
    def tokens(self) -> list[str]:
        """Whole host labels and path segments that every match contains."""
        labels = [] if self.host == "*" else ["h:" + x for x in self.host.split(".") if x]
        segments = self.path.split("/")[1:-1]  # what stands between two slashes is whole
        return labels + ["p:" + x for x in segments if x and "*" not in x]


def link_host(link: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    rest = F.substring_index(_rest(link), "/", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def link_path(link: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.substring_index(F.substring_index(_rest(link), "?", 1), "#", 1)
    slash = F.locate("/", rest)
    return F.when(slash > 0, F.substring(rest, slash, F.length(rest))).otherwise("")


def _rest(link: Column) -> Column:
    text = F.coalesce(link.cast("string"), F.lit(""))
    at = F.locate("://", text)
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")


def _tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def judge_links(
    files: DataFrame, rules: Sequence[Rule], link: str = "file_link", default: str = "allow",
) -> DataFrame:
    """Verdicts on the links of files, by the rules that fit them.

    Every rule is filed under the one of its literal tokens that the fewest links contain. A
    link's tokens fetch candidate rules, and only their regular expressions are run; a rule
    without a literal token is tried on all links. The longest rule wins, host rules before
    rules for any host; of equally long ones the one that blocks, then the first by name.

    All columns of ``files`` come back in ``_row`` with host, path, rule (name of the host rule,
    else null), pattern_rule (name of the any-host rule that decided, else null) and verdict. A
    null link, or one without ``://``, has an empty host and path and gets ``default`` unless a
    rule fits. Equal links are judged once; each row is returned once.
    """
    spark = files.sparkSession
    rows = files.select(
        F.struct(*files.columns).alias("_row"), link_host(F.col(link)).alias("host"),
        link_path(F.col(link)).alias("path"))
    links = rows.select("host", "path").distinct()
    token_rows = [(n, t) for n, r in enumerate(rules) for t in set(r.tokens)]
    rule_rows = [(n, r.name, r.pattern, r.verdict, r.host == "*", len(r.name)) for n, r in enumerate(rules)]
    table = spark.createDataFrame(
        rule_rows, "rule_no int, name string, pattern string, verdict string, any_host boolean, size int")
    filed = spark.createDataFrame(token_rows, "rule_no int, token string")
    small = F.broadcast if len(rule_rows) <= BROADCAST_RULES else (lambda df: df)
    linked = links.select("host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    # How many links hold each token that a rule has.
    counts = linked.join(small(filed.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    rarest = filed.join(counts, "token", "left").groupBy("rule_no").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("rare"))
    index = rarest.select("rule_no", F.col("rare.token").alias("token")).join(table, "rule_no")
    hits = linked.join(small(index), "token").drop("token")
    bare = table.join(filed.select("rule_no").distinct(), "rule_no", "left_anti")
    if any(not r.tokens for r in rules):
        # Rules without a literal token: few, and each is tried on every link.
        tried = [n for n, r in enumerate(rules) if not r.tokens]
        hits = hits.unionByName(
            links.withColumn("rule_no", F.explode(F.lit(tried))).join(small(bare), "rule_no"))
    fits = hits.filter(
        F.expr("concat(host, char(1), path) rlike concat('(?s)', pattern)"))
    best = fits.groupBy("host", "path").agg(F.min(F.struct(
        "any_host", (-F.col("size")).alias("_s"), F.col("verdict").eqNullSafe("allow").alias("_a"),
        "name", "verdict")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        "_row", "host", "path",
        F.when(~F.col("best.any_host"), F.col("best.name")).alias("rule"),
        F.when(F.col("best.any_host"), F.col("best.name")).alias("pattern_rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

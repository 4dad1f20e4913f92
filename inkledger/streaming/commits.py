"""Streaming upsert of review commits.

The state is a table of the commits that still matter (``live_commits``): of each file the
closing run of equal drafts and the last commit before it. It is kept in buckets of files, and a
micro-batch reads and rewrites the buckets it touches, so its cost follows the state and the
batch, not the log. Folding the state gives what folding all commits would, whatever order they
came in; adding commits twice changes nothing, so a repeated batch is harmless. A batch becomes
visible with one rename (``sources.versions``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkledger.operators.commits import COMMIT_COLUMNS, latest_edits, live_commits
from inkledger.operators.ledger import file_key
from inkledger.session import cut_lineage
from inkledger.sources import versions

BUCKETS = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(file_key("file_name")), F.lit(buckets)).cast("int")


def _when(commits: DataFrame) -> Column:
    """``reviewed_at`` as a number: seconds of a time, or the number it is."""
    at = F.col("reviewed_at")
    text = commits.schema["reviewed_at"].dataType.simpleString() == "string"
    return (F.to_timestamp(at) if text else at).cast("double")


def upsert_batch(path: str, buckets: int = BUCKETS, lateness: float | None = None, keep: int = 2):
    """``foreachBatch`` body; a batch may come again, and commits in any order.

    With ``lateness`` (in seconds, or in units of a numeric ``reviewed_at``) no commit is expected
    that is older than the newest by more than that. Of a run of equal drafts older commits than
    that are then forgotten except the first, which keeps a file's state short. Without it the
    whole closing run is kept and every late commit counts exactly. The last ``keep`` versions
    of the state stay readable.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = cut_lineage(live_commits(batch.select(*COMMIT_COLUMNS)).withColumn("bucket", _bucket(buckets)))
        # At most ``buckets`` small integers and one time reach the driver.
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        if not touched:
            return
        number, content = versions.current_version(spark, path)
        stored, newest = content.get("buckets", {}), content.get("newest")
        rows, old = new.drop("bucket"), [stored[str(b)] for b in touched if str(b) in stored]
        if old:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*old)).dropDuplicates(["commit_id"])
        horizon = None
        if lateness is not None:
            here = new.agg(F.max(_when(new))).first()[0]
            newest = max(x for x in (here, newest) if x is not None)
            horizon = _when(new) < F.lit(newest - lateness)
        folder = versions.new_folder(path)
        live_commits(rows, horizon).withColumn("bucket", _bucket(buckets)).write.partitionBy("bucket").parquet(folder)
        fresh = {str(b): f"{folder}/bucket={b}" for b in touched}
        versions.publish(spark, path, number, {**content, "buckets": stored | fresh, "newest": newest})
        versions.expire(spark, path, keep)

    return apply


def start(commits: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS,
          lateness: float | None = None, **trigger) -> StreamingQuery:
    """Run the upsert on a streaming commits DataFrame; ``availableNow`` by default."""
    return (
        commits.writeStream.foreachBatch(upsert_batch(path, buckets, lateness))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stored_commits(spark: SparkSession, path: str) -> DataFrame:
    """The commits that the state holds, as of the last finished micro-batch."""
    buckets = versions.current_version(spark, path)[1].get("buckets", {})
    if not buckets:
        raise FileNotFoundError(f"no commits are stored in {path}")
    return spark.read.parquet(*buckets.values())


def current(spark: SparkSession, path: str) -> DataFrame:
    """One row per edited file, as of the last finished micro-batch."""
    return latest_edits(stored_commits(spark, path))

"""Several tables that change at once: numbered versions that name the folders they hold.

A version is a small JSON document ``versions/<number>.json`` in the store's root. Data is
written to folders of its own first; publishing the next number is one rename, which fails if
another writer was there first. Readers take the highest number, so they see all tables of a
version or none of it, and whatever fails before the rename leaves the old version as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from inkledger.sources.sinks import hadoop_fs


class VersionConflict(RuntimeError):
    """Another writer has published a version since this one was read."""


def _folder(root: str) -> str:
    return f"{root.rstrip('/')}/versions"


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, where, _ = hadoop_fs(spark, _folder(root))
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _document(spark: SparkSession, root: str, number: int) -> dict:
    fs, where, jvm = hadoop_fs(spark, f"{_folder(root)}/{number:012d}.json")
    stream = fs.open(where)
    try:
        return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def current_version(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the newest version; (0, {}) if there is none."""
    numbers = _numbers(spark, root)
    return (numbers[-1], _document(spark, root, numbers[-1])) if numbers else (0, {})


def new_folder(root: str) -> str:
    """A name for data that no version holds yet."""
    return f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, after: int, content: dict) -> int:
    """Make ``content`` the version that follows number ``after``."""
    fs, folder, jvm = hadoop_fs(spark, _folder(root))
    fs.mkdirs(folder)
    path = jvm.org.apache.hadoop.fs.Path
    draft = path(f"{_folder(root)}/draft-{uuid.uuid4().hex}")
    goal = path(f"{_folder(root)}/{after + 1:012d}.json")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        stream.close()
    if after + 1 in _numbers(spark, root) or not fs.rename(draft, goal):
        fs.delete(draft, False)
        raise VersionConflict(f"version {after + 1} of {root} is there already")
    return after + 1


def write_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Write all ``tables`` and publish them as one version; others stay as they are.

    If any write fails, what was written is deleted and the old version stays.
    """
    number, content = current_version(spark, root)
    written: dict[str, str] = {}
    try:
        for name, rows in tables.items():
            written[name] = new_folder(root)
            rows.write.parquet(written[name])
        return publish(spark, root, number, {**content, "tables": content.get("tables", {}) | written})
    except BaseException:
        for folder in written.values():
            fs, where, _ = hadoop_fs(spark, folder)
            fs.delete(where, True)
        raise


def read_table(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame | None:
    """A table of the newest version, or of an older one; None if the version has no such table."""
    content = current_version(spark, root)[1] if number is None else _document(spark, root, number)
    folder = content.get("tables", {}).get(name)
    return spark.read.parquet(folder) if folder else None


def _held(value) -> set[str]:
    if isinstance(value, dict):
        return set().union(*map(_held, value.values())) if value else set()
    return {value} if isinstance(value, str) else set()


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Forget all but the last ``keep`` versions and delete what only those held; how many folders.

    Data that no version ever held (of a writer that died) is not touched.
    """
    numbers = _numbers(spark, root)
    old, live = numbers[:-keep], numbers[-keep:]
    held = set().union(*(_held(_document(spark, root, n)) for n in live)) if live else set()
    gone = set().union(*(_held(_document(spark, root, n)) for n in old)) - held if old else set()
    gone = {p for p in gone if p.startswith(f"{root.rstrip('/')}/data/")}
    for folder in gone:
        fs, where, _ = hadoop_fs(spark, folder)
        fs.delete(where, True)
    for n in old:
        fs, where, _ = hadoop_fs(spark, f"{_folder(root)}/{n:012d}.json")
        fs.delete(where, False)
    return len(gone)

"""Files of an operator's own format in the folder that all executors share."""

from __future__ import annotations

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder; it is made if it is missing."""
    system, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:"))
    system.create_dir(path, recursive=True)
    return system, path


def partitions_for(spark, rows_or_bytes: int, each: int) -> int:
    """Tasks so that one holds about ``each`` of a total, at least Spark's own setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows_or_bytes // each))

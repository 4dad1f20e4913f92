"""Identity hashes of a source image and of one revision of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkledger.vocabulary import TILE_FORMAT_VERSION, TILE_SIZE


def source_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def revision(size: Column, mtime_ns: Column, tile_size: int = TILE_SIZE,
             version: int = TILE_FORMAT_VERSION) -> Column:
    identity = F.concat_ws(
        ":", size.cast("string"), mtime_ns.cast("string"), F.lit(str(tile_size)), F.lit(str(version))
    )
    return F.substring(F.sha2(identity, 256), 1, 16)

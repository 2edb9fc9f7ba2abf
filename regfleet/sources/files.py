"""What the file readers share: map ids and a row order that needs no shuffle."""

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File orders count bytes, so a chunk of them spans 4 MB.
FILE_CHUNK_BITS = 22

#: Rows of one scan task are numbered in the low 33 bits of this id.
_ROW_BITS = (1 << 33) - 1

MapId = Callable[[Column], Column]


def _decoded(c: Column) -> Column:
    """Undo percent escapes; a plus sign is just a plus sign in a path."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def file_stem(path: Column) -> Column:
    """File name without folder and extension."""
    return _decoded(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))


def partition_value(path: Column, name: str = "map_id") -> Column:
    """Value of the ``name=...`` folder that partitioned sinks write, which is escaped twice."""
    return _decoded(_decoded(F.regexp_extract(path, rf"{name}=([^/]+)/", 1)))


def scan_order() -> Column:
    """A BIGINT that grows along each file, across its splits.

    Start of the split plus row number in the scan task. A row takes at least one
    byte and a task reads no more bytes than a split has, so the order never
    reaches the start of the next split.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
    return F.col("_metadata.file_block_start") + row


def driver_paths(rows: list) -> list[str]:
    """Paths of listed files for a reader, which would take brackets and the like for patterns."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(r.file)) for r in rows]


def with_table(records: DataFrame, map_id: MapId) -> DataFrame:
    return records.withColumns({"map_id": map_id(F.col("file")), "table_id": F.lit(0)}).drop("file")

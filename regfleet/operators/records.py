"""Raw tables to positional records: header split, cell grids, record de-duplication."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfleet import functions as R
from regfleet.operators.headers import TABLE
from regfleet.operators.lookup import salted_lookup


def split_header(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First row of each table as its header, the others as records."""
    heads = rows.groupBy(*TABLE).agg(F.min(F.struct("row_ord", "cells")).alias("head"))
    headers = heads.select(
        *TABLE, F.transform("head.cells", lambda c: F.coalesce(c, F.lit(""))).alias("header"), F.col("head.row_ord").alias("_first")
    )
    records = salted_lookup(rows, headers.select(*TABLE, "_first"), TABLE, "row_ord")
    return headers.drop("_first"), records.filter(F.col("row_ord") > F.col("_first")).drop("_first")


def grid_rows(cells: DataFrame, style: str = "sheet") -> DataFrame:
    """Long cells ``(map_id, table_id, row_ord, col_ord, value)`` to rows of cells.

    A ``sheet`` keeps cell text as it is, a ``page`` (table cut from a text page)
    turns line breaks into spaces and strips. The header, row 0, is stripped in both.
    """
    value = F.coalesce("value", F.lit(""))
    unbroken = R.strip(F.replace(value, F.lit("\n"), F.lit(" ")))
    body = unbroken if style == "page" else value
    head = unbroken if style == "page" else R.strip(value)
    text = F.when(F.col("row_ord") == 0, head).otherwise(body)
    return (
        cells.groupBy(*TABLE, "row_ord")
        .agg(F.array_sort(F.collect_list(F.struct("col_ord", text.alias("cell")))).alias("_c"))
        .select(*TABLE, "row_ord", F.col("_c.cell").alias("cells"))
    )


def grid_records(cells: DataFrame, style: str = "sheet") -> tuple[DataFrame, DataFrame]:
    """Header and records of every grid that has both; surplus cells are cut."""
    rows = grid_rows(cells, style)
    headers = rows.filter(F.col("row_ord") == 0).select(*TABLE, F.col("cells").alias("header"))
    widths = headers.select(*TABLE, F.size("header").alias("_width"))
    body = salted_lookup(rows.filter(F.col("row_ord") > 0), widths, TABLE, "row_ord")
    records = body.withColumn("cells", F.slice("cells", F.lit(1), F.col("_width"))).drop("_width")
    filled = records.select(*TABLE).distinct()
    return headers.join(filled, TABLE, "left_semi"), records


def select_tables(cells: DataFrame, sheet: str | None = None, pages: list[int] | None = None) -> DataFrame:
    """Keep one sheet by ``table_name``, or pages by 1-based ``page_number``."""
    if sheet is not None:
        cells = cells.filter(F.col("table_name") == sheet)
    if pages is not None:
        cells = cells.filter(F.col("page_number").isin(pages))
    return cells


def drop_repeats(records: DataFrame) -> DataFrame:
    """Keep the first of equal records of a map; equal means the same present cells.

    The minimum is combined before the shuffle, so a record copied any number of
    times reaches each reducer once per task.
    """
    return (
        records.groupBy("map_id", "cells")
        .agg(F.min(F.struct("table_id", "row_ord")).alias("_first"))
        .select("map_id", "_first.table_id", "_first.row_ord", "cells")
    )

"""Register rows of a fleet to definition rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfleet.operators.ordering import ordered_scan
from regfleet.operators.staging import (
    number_lines,
    stage,
    surviving,
    with_coefficient_text,
    with_offset,
    with_values,
)
from regfleet.operators.tagging import allocate_tags
from regfleet.schemas import DEFINITION_SCHEMA
from regfleet.session import freeze


def staged_table(
    rows: DataFrame, params: DataFrame | None = None, order: str | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Numbered, cleaned and judged rows, stored once for all later passes.

    ``rows`` carry ``line_num``, or the ``order`` column names a BIGINT that sorts
    the records of a map. ``params`` gives each map its address offset. With
    ``columns`` only those are stored.
    """
    if order is not None:
        rows = number_lines(rows, order)
    if params is not None:
        rows = with_offset(rows, params)
    staged = stage(rows)
    return freeze(staged if columns is None else staged.select(columns), "staged")


def definition(staged: DataFrame) -> DataFrame:
    """Definition rows: tags allocated, indexed from 1 in line order per map."""
    rows = surviving(staged)
    indexed = ordered_scan(
        allocate_tags(with_values(rows)),
        ["map_id"],
        "line_num",
        counts={"idx": F.lit(True)},
        totals=rows.select("map_id", "line_num"),
    )
    return with_coefficient_text(indexed).withColumn("info4", F.lit("")).to(DEFINITION_SCHEMA)


def generate(rows: DataFrame, params: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Simplified registers of many maps to their definitions."""
    return definition(staged_table(rows, params, order))

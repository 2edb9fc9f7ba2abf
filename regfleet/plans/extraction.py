"""Documents to simplified registers, and all the way to definitions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfleet import functions as R
from regfleet.functions import datatypes as D
from regfleet.operators.headers import (
    project_records,
    project_registers,
    resolve_columns,
    resolve_exact,
    source_columns,
)
from regfleet.operators.staging import record_order, with_normalized_address, with_offset
from regfleet.plans.definition import definition, staged_table
from regfleet.schemas import REGISTER_COLUMNS


def clean_extracted(projected: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Simplified registers from projected records.

    Rows without name and address go. Types and addresses are normalized, BITS
    addresses composed from their own columns, the map's offset applied, factors
    made plain numbers, blank register types filled.
    """
    kept = projected.filter((F.coalesce("name", F.lit("")) != "") | (F.coalesce("address", F.lit("")) != ""))
    if params is None:
        kept = kept.withColumn("address_offset", F.lit(0).cast("bigint"))
    else:
        kept = with_offset(kept, params, "row_ord")
    texts = kept.withColumns({"_t": D.type_text(F.col("type")), "address": R.text(F.col("address"))})
    typed = texts.withColumn("type", D.type_of(F.col("_t")))
    composed = typed.withColumn(
        "_address",
        R.bits_address(F.col("type"), F.col("address"), R.text(F.col("start_bit")), R.text(F.col("length"))),
    )
    moved = with_normalized_address(composed, "_address", F.col("address_offset"), "address")
    factor = F.when(F.col("factor").isNotNull(), R.parse_number(F.col("factor"), 1.0).cast("string"))
    return moved.withColumns(
        {
            "factor": factor,
            "register_type": R.default_register_type(F.col("register_type")),
            "record": record_order(F.col("table_id"), F.col("row_ord")),
        }
    ).select("map_id", "record", *REGISTER_COLUMNS)


def extract(
    headers: DataFrame, records: DataFrame, mapping: DataFrame | None = None, params: DataFrame | None = None
) -> DataFrame:
    """Simplified registers of many documents, in document order by ``record``."""
    resolved = resolve_columns(source_columns(headers, records), mapping)
    return clean_extracted(project_records(records, resolved), params)


def run(
    headers: DataFrame, records: DataFrame, mapping: DataFrame | None = None, params: DataFrame | None = None
) -> DataFrame:
    """Documents straight to definition rows; the offset is applied once."""
    return definition(staged_table(extract(headers, records, mapping, params), order="record"))


def simplified(headers: DataFrame, records: DataFrame) -> DataFrame:
    """Register rows of simplified files, whose headers are matched exactly."""
    projected = project_registers(records, resolve_exact(headers))
    return projected.withColumn("record", record_order(F.col("table_id"), F.col("row_ord"))).drop("table_id", "row_ord")

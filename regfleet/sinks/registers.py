"""Simplified register files: ten columns with header."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfleet.operators.ordering import CHUNK_BITS
from regfleet.schemas import REGISTER_COLUMNS, REGISTER_HEADERS


def write_registers(registers: DataFrame, path: str, order: str = "record") -> None:
    """One folder per map, rows in ``order``; columns beyond the ten are left out.

    A map within 2^16 values of ``order`` is one file, larger ones are cut there.
    """
    (
        registers.withColumn("_chunk", F.shiftright(order, CHUNK_BITS))
        .repartitionByRange("map_id", "_chunk")
        .sortWithinPartitions("map_id", order)
        .select("map_id", *[F.col(c).alias(REGISTER_HEADERS[c]) for c in REGISTER_COLUMNS])
        .write.partitionBy("map_id")
        .options(header=True, quote='"', escape='"', emptyValue="")
        .csv(path)
    )

"""User column mappings: JSON objects of target to source header."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regfleet.sources.files import MapId


def read_mapping(spark: SparkSession, path, map_id: MapId | None = None) -> DataFrame:
    """Rows (map_id, target, source); without ``map_id`` a mapping holds for all maps."""
    owner: Column = F.lit(None).cast("string") if map_id is None else map_id(F.col("_metadata.file_path"))
    return (
        spark.read.text(path, wholetext=True)
        .select(owner.alias("map_id"), F.explode(F.from_json("value", "map<string,string>")).alias("target", "source"))
    )

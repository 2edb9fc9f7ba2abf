"""Definition files: one header line and the indexed rows of a map, as text."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regfleet.functions import definition_slug
from regfleet.operators.lookup import salted_lookup
from regfleet.operators.ordering import CHUNK_BITS, ordered_scan
from regfleet.schemas import DEFINITION_COLUMNS
from regfleet.session import freeze
from regfleet.sources.files import partition_value, scan_order

# Separator, and how many empty fields end the header line.
SEPARATOR = ";"
HEADER_PADDING = 6
# Protocol and category of a map that states none.
DEFAULTS = {"protocol": "modbusRTU", "category": "Inverter"}


HEADER_COLUMNS = ["protocol", "category", "manufacturer", "model", "forced_write"]


def _field(c: Column) -> Column:
    """Quote a field only if it holds a separator, a quote or a line break."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[;"\r\n]'), quoted).otherwise(c)


def _line(*columns: Column) -> Column:
    return F.concat_ws(SEPARATOR, *[_field(F.coalesce(c, F.lit(""))) for c in columns])


def definition_lines(definition: DataFrame, params: DataFrame) -> DataFrame:
    """Lines of the files, ``line_ord`` 0 being the header of each map.

    Protocol and category have defaults. A map with several rows in ``params``
    has the header of one of them, a map without a row one without names.
    """
    head = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(DEFAULTS.get(c, ""))) for c in HEADER_COLUMNS]
    one = params.groupBy("map_id").agg(F.min(F.struct(*HEADER_COLUMNS)).alias("p")).select("map_id", "p.*")
    maps = definition.select("map_id").distinct().join(one, "map_id", "full")
    header = maps.select(
        "map_id",
        F.lit(0).cast("bigint").alias("line_ord"),
        _line(*head, *[F.lit("")] * HEADER_PADDING).alias("line"),
    )
    body = definition.select(
        "map_id",
        F.col("idx").alias("line_ord"),
        _line(F.col("idx").cast("string"), *[F.col(c) for c in DEFINITION_COLUMNS]).alias("line"),
    )
    return header.unionByName(body)


def named_maps(params: DataFrame) -> DataFrame:
    """(map_id): maps whose parameters state both a manufacturer and a model."""
    both = (F.coalesce("manufacturer", F.lit("")) != "") & (F.coalesce("model", F.lit("")) != "")
    one = params.groupBy("map_id").agg(F.min(F.struct(*HEADER_COLUMNS)).alias("p")).select("map_id", "p.*")
    return one.filter(both).select("map_id")


def accepted(lines: DataFrame, params: DataFrame) -> DataFrame:
    """Lines of the maps that have a manufacturer and a model; the others get no file.

    ``plans.diagnostics.refusals`` tells which and why. A map that holds many lines is not moved to
    one task: the named maps are a lookup.
    """
    named = named_maps(params).withColumn("_named", F.lit(True))
    return salted_lookup(lines, named, ["map_id"], "line_ord").filter("_named").drop("_named")


def with_slug(params: DataFrame) -> DataFrame:
    return params.withColumn("slug", definition_slug(F.col("manufacturer"), F.col("model")))


def file_names(params: DataFrame) -> DataFrame:
    """(map_id, file): the slug of each map; maps that share one add 12 hexadecimal digits of their id's SHA-256.

    A slug ends in a word, a longer name in digits, so the names of two maps are never equal.
    """
    one = params.groupBy("map_id").agg(F.min(F.struct("manufacturer", "model")).alias("p")).select("map_id", "p.*")
    slugs = with_slug(one.fillna("", ["manufacturer", "model"])).select("map_id", "slug")
    shared = slugs.groupBy("slug").agg(F.count("*").alias("maps")).filter("maps > 1").select("slug", F.lit(True).alias("shared"))
    longer = F.concat_ws("_", "slug", F.substring(F.sha2(F.col("map_id"), 256), 1, 12))
    return slugs.join(shared, "slug", "left").select("map_id", F.when(F.col("shared"), longer).otherwise(F.col("slug")).alias("file"))


def write_definitions(lines: DataFrame, path: str, names: DataFrame | None = None) -> None:
    """One folder per map: by its id, or by ``file`` in ``names``.

    Many small maps are written by one task. A map below 2^16 lines is one file, a
    larger one is cut into files whose name order is the line order, so no task
    writes it alone.
    """
    folder = "map_id"
    if names is not None:
        folder = "file"
        lines = salted_lookup(lines, names, ["map_id"], "line_ord").withColumn("file", F.coalesce("file", "map_id"))
    (
        lines.withColumn("_chunk", F.shiftright("line_ord", CHUNK_BITS))
        .repartitionByRange(folder, "_chunk")
        .sortWithinPartitions(folder, "line_ord")
        .select(folder, "line")
        .write.partitionBy(folder)
        .text(path)
    )


def read_definitions(spark: SparkSession, path: str, folder: str = "map_id") -> DataFrame:
    """(folder, position, line) of written files, counted from 0 along the files of each folder."""
    lines = spark.read.text(f"{path}/*").select(
        partition_value(F.col("_metadata.file_path"), folder).alias(folder),
        F.col("_metadata.file_path").alias("_path"),
        scan_order().alias("_at"),
        F.col("value").alias("line"),
    )
    stored = freeze(lines, "definition-lines")
    # A task counts rows across the files that it reads, so the first row of each file is its zero.
    files = stored.groupBy(folder, "_path").agg(F.min("_at").alias("_zero"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(folder).orderBy("_path").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_rows")
    joined = salted_lookup(stored, placed, [folder, "_path"], "_at")
    ranked = ordered_scan(joined, [folder, "_path", "_zero", "_before"], "_at", counts={"_n": F.lit(True)}, sparse=True)
    return ranked.select(folder, (F.col("_before") + F.col("_n") - 1).alias("position"), "line")

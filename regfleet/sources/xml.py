"""XML register files: every row element with two or more text children is a record."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regfleet import functions as R
from regfleet.operators.headers import union_tables
from regfleet.operators.records import drop_repeats
from regfleet.session import freeze
from regfleet.sources.files import MapId, file_stem, scan_order, with_table

MIN_LEAVES = 2

#: Text of a child that holds elements: the reader gives their markup where another file has plain text.
_MARKUP = r"(?s)^\s*<([A-Za-z_][^\s/>]*)[^>]*(/>|>.*</\1\s*>)\s*$"


def _leaf(field: T.StructField) -> Column | None:
    """Text of a leaf child; the last one if it repeats; none for nested elements."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
        c = F.try_element_at(F.filter(c, lambda x: ~x.rlike(_MARKUP)), F.lit(-1))
    elif not isinstance(field.dataType, T.StringType):
        return None
    return F.when(~c.rlike(_MARKUP), c)


def read_xml(
    spark: SparkSession, path, row_tag: str | list[str], map_id: MapId = file_stem, schema: T.StructType | None = None
) -> tuple[DataFrame, DataFrame]:
    """Headers (child tags) and distinct records of all files below ``path``.

    Elements of each name in ``row_tag`` are a table of their own, in the order of
    the names. Without a ``schema`` the child tags are found by one pass per name;
    values stay text. Attributes and nested elements are left out, broken rows dropped.
    """
    reader = spark.read.format("xml").options(
        inferSchema="false", excludeAttribute="true", columnNameOfCorruptRecord="_corrupt_record"
    )
    tables = []
    for tag in [row_tag] if isinstance(row_tag, str) else row_tag:
        rows = (reader.schema(schema) if schema is not None else reader).load(path, rowTag=tag)
        tables.append(
            (rows, {f.name: leaf for f in rows.schema.fields if f.name != "_corrupt_record" and (leaf := _leaf(f)) is not None})
        )
    names = list(dict.fromkeys(name for _, leaves in tables for name in leaves))
    parts = []
    for table_id, (rows, leaves) in enumerate(tables):
        present = [F.when(leaves[n] != "", R.strip(leaves[n])) if n in leaves else F.lit(None).cast("string") for n in names]
        found = rows.select(F.col("_metadata.file_path").alias("file"), scan_order().alias("row_ord"), F.array(*present).alias("cells"))
        filled = found.filter(F.size(F.array_compact("cells")) >= MIN_LEAVES)
        parts.append(with_table(filled, map_id).withColumn("table_id", F.lit(table_id)))
    stored = freeze(drop_repeats(union_tables(parts)), "records")
    header = F.array(*[F.lit(name) for name in names]).cast("array<string>")
    return stored.select("map_id", "table_id").distinct().withColumn("header", header), stored

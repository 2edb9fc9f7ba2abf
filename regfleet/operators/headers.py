"""Which source column feeds which register column.

Records are positional: ``(map_id, table_id, row_ord, cells ARRAY<STRING>)`` where a
null cell is an absent one, and each table has one row ``(map_id, table_id, header
ARRAY<STRING>)``. Headers are few per table, so their rules run on arrays.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regfleet import functions as R
from regfleet.operators.lookup import salted_lookup
from regfleet.schemas import DETECTION_ORDER, HEADER_PATTERNS, REGISTER_COLUMNS, REGISTER_HEADERS, TARGET_COLUMNS

TABLE = ["map_id", "table_id"]

#: Records at the head of a table that decide which columns exist.
KEY_RECORDS = 5


def source_columns(headers: DataFrame, records: DataFrame) -> DataFrame:
    """Columns a table really has: those present in one of its first five records.

    A table whose header row is ``complete`` has all columns of its header if it has a record.
    ``columns`` holds (ordinal, header) per distinct header text; the last cell of
    a repeated header wins, its position is that of the first.
    """
    order = Window.partitionBy(*TABLE).orderBy("row_ord")
    # row_number() <= k is cut to k rows per group before the shuffle.
    first = records.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= KEY_RECORDS)
    present = (
        first.select(*TABLE, F.posexplode("cells").alias("ordinal", "cell"))
        .filter(F.col("cell").isNotNull())
        .groupBy(*TABLE)
        .agg(F.collect_set("ordinal").alias("present"))
    )
    complete = F.coalesce(F.col("complete"), F.lit(False)) if "complete" in headers.columns else F.lit(False)
    named = headers.select(*TABLE, complete.alias("complete"), F.posexplode("header").alias("ordinal", "header"))
    kept = (
        named.join(present, TABLE)
        .filter(F.col("complete") | F.array_contains("present", F.col("ordinal")))
        .groupBy(*TABLE, "header")
        .agg(F.min("ordinal").alias("position"), F.max("ordinal").alias("ordinal"))
    )
    return kept.groupBy(*TABLE).agg(
        F.array_sort(F.collect_list(F.struct("position", "ordinal", "header"))).alias("columns")
    )


def _rank(header: Column, patterns: list[str]) -> Column:
    """(0, i) when the header is pattern i, (1, i) when it contains it, else null."""
    low = F.lower(header)
    return F.coalesce(
        *[F.when(R.strip(low) == p, F.struct(F.lit(0), F.lit(i))) for i, p in enumerate(patterns)],
        *[F.when(low.contains(p), F.struct(F.lit(1), F.lit(i))) for i, p in enumerate(patterns)],
    )


def _explicit(columns: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """Attach the user's mapping as ``wanted``: target to source header, own map first.

    Of several headers for one target the first by name holds.
    """
    if mapping is None:
        return columns.withColumn("wanted", F.lit(None).cast("map<string,string>"))
    mapping = mapping.groupBy("map_id", "target").agg(F.min("source").alias("source"))
    per_map = mapping.groupBy("map_id").agg(F.map_from_entries(F.collect_list(F.struct("target", "source"))).alias("own"))
    common = per_map.filter(F.col("map_id").isNull()).select("own").scalar()
    own = per_map.filter(F.col("map_id").isNotNull())
    return columns.join(own, "map_id", "left").withColumn("wanted", F.coalesce(F.col("own"), common)).drop("own")


def resolve_columns(columns: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """One row per table: per target the ordinal of its source column, or null.

    ``mapping`` rows (map_id or null for all maps, target, source) win if the source
    exists and keep their column from the other targets. Then each target, in a
    fixed order, takes the best unused header: equal to a pattern before containing
    one, earlier pattern first, then leftmost.

    Maps of one device family share their headers, so the rules run once per distinct
    list of columns and wishes, and the tables take the result by its digest.
    """
    tables = _explicit(columns, mapping).withColumn("_form", _form())
    forms = tables.groupBy("_form").agg(F.any_value("columns").alias("columns"), F.any_value("wanted").alias("wanted"))
    named = tables.select(*TABLE, "_form", F.xxhash64(*TABLE).alias("_table"))
    return salted_lookup(named, _resolve(forms), ["_form"], "_table").drop("_form", "_table")


def _form() -> Column:
    """Digest of what decides a table's result: its columns and the user's wishes for it."""
    wishes = F.array_sort(F.map_entries("wanted"))
    return F.sha2(F.to_json(F.struct(F.col("columns"), wishes.alias("wishes"))), 256)


def _resolve(forms: DataFrame) -> DataFrame:
    """Per form and target the ordinal of the source column, or null."""
    state = forms.withColumns({f"_{t}": _asked(t) for t in DETECTION_ORDER})
    sources = F.coalesce(F.map_values("wanted"), F.array().cast("array<string>"))
    reserved = F.filter("columns", lambda c: F.array_contains(sources, c["header"]))
    state = state.withColumn("_used", F.transform(reserved, lambda c: c["position"]))
    for target in DETECTION_ORDER:
        state = state.withColumn(f"_{target}", F.coalesce(f"_{target}", _best(target))).withColumn(
            "_used", F.array_compact(F.array_append("_used", F.col(f"_{target}.position")))
        )
    return state.select("_form", *[F.col(f"_{t}.ordinal").alias(TARGET_COLUMNS[t]) for t in DETECTION_ORDER])


def _asked(target: str) -> Column:
    """The column the user's mapping names for a target."""
    header = F.try_element_at("wanted", F.lit(target))
    return F.get(F.filter("columns", lambda c: c["header"] == header), F.lit(0))


def _best(target: str) -> Column:
    """The best column not used yet, null when none is eligible."""
    patterns = HEADER_PATTERNS[target]
    free = F.filter("columns", lambda c: ~F.array_contains("_used", c["position"]))
    ranked = F.transform(free, lambda c: F.struct(_rank(c["header"], patterns).alias("rank"), c.alias("column")))
    return F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull()))["column"]


def project_records(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Cells of the resolved columns; a target without a column is null."""
    targets = list(TARGET_COLUMNS.values())
    ordinals = resolved.select(*TABLE, *[F.col(t).alias(f"_{t}") for t in targets])
    joined = salted_lookup(records, ordinals, TABLE, "row_ord")
    return joined.select(
        *TABLE, "row_ord", *[F.when(F.col(f"_{t}").isNotNull(), F.get("cells", F.col(f"_{t}"))).alias(t) for t in targets]
    )


def resolve_exact(headers: DataFrame) -> DataFrame:
    """Ordinals by equal header text, ignoring case and surrounding space."""
    named = headers.select(*TABLE, F.posexplode("header").alias("ordinal", "header"))
    texts = named.groupBy(*TABLE, "header").agg(F.min("ordinal").alias("position"), F.max("ordinal").alias("ordinal"))
    key = R.strip(F.lower(F.col("header")))

    def pick(column):
        hit = F.when(key == REGISTER_HEADERS[column].lower(), F.struct("position", "ordinal"))
        return F.min(hit)["ordinal"].alias(column)

    return texts.groupBy(*TABLE).agg(*[pick(c) for c in REGISTER_COLUMNS])


def project_registers(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Register rows of a simplified file, with a flag for rows that are all empty."""
    ordinals = resolved.select(*TABLE, *[F.col(c).alias(f"_{c}") for c in REGISTER_COLUMNS])
    joined = salted_lookup(records, ordinals, TABLE, "row_ord")
    return joined.select(
        *TABLE,
        "row_ord",
        *[F.when(F.col(f"_{c}").isNotNull(), F.get("cells", F.col(f"_{c}"))).alias(c) for c in REGISTER_COLUMNS],
        (F.concat_ws("", "cells") == "").alias("blank"),
    )


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Tables of one document in order; ``table_id`` and ``row_ord`` carry the order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)

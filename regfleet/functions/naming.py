"""Tags derived from names, and names of definition files."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regfleet.functions.text import plain


def _words(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def _single(words: Column) -> Column:
    return F.when(words.contains("__"), F.regexp_replace(words, "_+", "_")).otherwise(words)


def _trimmed(words: Column) -> Column:
    return F.when(words.startswith("_") | words.endswith("_"), F.btrim(words, F.lit("_"))).otherwise(words)


def _named(slug: Column) -> Column:
    first = F.substring(slug, 1, 1)
    return F.when(first == "", F.lit("var")).when(first.between("0", "9"), F.concat(F.lit("v_"), slug)).otherwise(slug)


def tag_base(name: Column) -> Column:
    """Name to tag text: ``[a-z0-9_]`` only, never empty, never digit-first."""
    return _named(_trimmed(_single(plain(_words(name)))))


def with_tag_base(rows: DataFrame, name: str, out: str) -> DataFrame:
    """``tag_base`` as steps, each text worked out once per row."""
    steps = rows.withColumn("_w", _words(F.col(name)))
    for rule in (plain, _single, _trimmed):
        steps = steps.withColumn("_w", rule(F.col("_w")))
    return steps.withColumn(out, _named(F.col("_w"))).drop("_w")


def _slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", "_"))


def definition_slug(manufacturer: Column, model: Column) -> Column:
    return F.concat(_slug(manufacturer), F.lit("_"), _slug(model), F.lit("_definition"))

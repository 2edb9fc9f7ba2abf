"""Joining a per-map (or per-table) row onto many rows, hot maps included."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salted_lookup(rows: DataFrame, small: DataFrame, keys: Sequence[str], salt: str) -> DataFrame:
    """Left join of ``small`` (few rows per key) to ``rows``, every key spread over 32 salts.

    ``salt`` is a BIGINT column of ``rows`` that varies inside a key. ``small`` is
    repeated once per salt, so the largest shuffle group is 1/32 of the largest
    key. Being a left join, only ``small`` can be broadcast, which Spark does while
    its size is below the broadcast threshold; then nothing is shuffled.
    """
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return salted.join(spread, [*keys, "_salt"], "left").drop("_salt")

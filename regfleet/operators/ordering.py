"""Running counts and minima in row order, without one task per group.

A window ``PARTITION BY map_id ORDER BY line`` puts a whole map into one task.
Here the order column, a BIGINT, also cuts each group into chunks of 2^16
consecutive values: rows are scanned inside their chunk, and what earlier chunks
carry over is worked out on one row per chunk and joined back by (keys, chunk).
Chunk totals are combined before they are shuffled. With at most a few rows per
order value, no task sees more than a chunk of rows, however large a group grows.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 16
BLOCK_BITS = 24

_CHUNK, _BLOCK = "_chunk", "_block"


def _carried(totals: DataFrame, group: list[str], order: str, sums, minima, suffix: str) -> DataFrame:
    """Totals of everything before each row of ``totals`` inside ``group``."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *[c for c in totals.columns if c not in sums and c not in minima],
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n + suffix) for n in sums],
        *[F.min(n).over(before).alias(n + suffix) for n in minima],
    )


def _block_carried(chunks: DataFrame, keys: list[str], sums, minima) -> DataFrame:
    """The same in two steps, over blocks of 2^24 chunks and inside each block."""
    chunks = chunks.withColumn(_BLOCK, F.shiftright(_CHUNK, BLOCK_BITS))
    blocks = chunks.groupBy(*keys, _BLOCK).agg(
        *[F.sum(n).alias(n) for n in sums], *[F.min(n).alias(n) for n in minima]
    )
    inside = _carried(chunks, [*keys, _BLOCK], _CHUNK, sums, minima, "_c")
    return inside.join(_carried(blocks, keys, _BLOCK, sums, minima, "_b"), [*keys, _BLOCK]).select(
        *keys,
        _CHUNK,
        *[(F.col(n + "_c") + F.col(n + "_b")).alias(n + "_carry") for n in sums],
        *[F.least(n + "_c", n + "_b").alias(n + "_carry") for n in minima],
    )


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    counts: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    minima: Mapping[str, Column] | None = None,
    ties: Sequence[str | Column] = (),
    totals: DataFrame | None = None,
    sparse: bool = False,
    before: bool = False,
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """Add running values per ``keys`` in ``order``, of the rows before and, unless ``before`` is set, the current one.

    ``counts`` maps a new column to a condition and counts the rows so far for
    which it holds, ``sums`` adds up a BIGINT expression, ``minima`` keeps the
    smallest value so far. ``ties`` order the rows of an equal ``order``; the
    order must be close to unique per key. Keys must not be null.

    ``totals`` is a cheaper frame with the same rows for the chunk totals. With
    ``sparse``, order values may lie so far apart that chunks hold few rows, and
    the chunks of a key are scanned in blocks.
    """
    keys, minima = list(keys), dict(minima or {})
    sums = {n: F.when(c, 1).otherwise(0).cast("bigint") for n, c in (counts or {}).items()} | dict(sums or {})
    names = [*sums, *minima]
    chunk = F.shiftright(F.col(order), chunk_bits).alias(_CHUNK)

    so_far = (
        Window.partitionBy(*keys, _CHUNK)
        .orderBy(order, *ties)
        .rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    )
    local = df.withColumn(_CHUNK, chunk).withColumns(
        {n: F.sum(e).over(so_far) for n, e in sums.items()} | {n: F.min(e).over(so_far) for n, e in minima.items()}
    )
    chunks = (
        (df if totals is None else totals)
        .groupBy(*keys, chunk)
        .agg(*[F.sum(e).alias(n) for n, e in sums.items()], *[F.min(e).alias(n) for n, e in minima.items()])
    )
    carry = (
        _block_carried(chunks, keys, sums, minima)
        if sparse
        else _carried(chunks, keys, _CHUNK, sums, minima, "_carry")
    )
    # The rows already lie by (keys, chunk), so a merge join moves only the totals.
    return local.hint("merge").join(carry, [*keys, _CHUNK]).select(
        *[c for c in df.columns if c not in names],
        *[(F.coalesce(n, F.lit(0)) + F.col(n + "_carry")).alias(n) for n in sums],
        *[F.least(n, n + "_carry").alias(n) for n in minima],
    )

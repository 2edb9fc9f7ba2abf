"""Mixing sources to target weights on a time-varying schedule.

Each source gets a share of all words by its weight, at most ``most`` times its
own size, and a schedule of that share over the training time 0..1. A source's
documents stand in a fixed pseudo-random order and are repeated as a whole until
the target is reached, the last one cut. A copy that begins after a part u of
its source's demand is placed at the time t at which the integral of the
source's schedule reaches u; all copies are then sorted by range of t.

Running word counts use chunks of each source's order, so a source that holds
a third of all rows is spread over as many tasks as it has chunks.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regfleet.operators.ordering import ordered_scan

from .common import freeze

_ORDER_BITS = 48
_ROWS_PER_CHUNK = 2_000


def source_targets(sizes: DataFrame, weights=(1.0, 2.0, 3.0), most: int = 3) -> DataFrame:
    """(source, source_no, weight, source_size, target) of each source.

    Sources by code point, null last, take the weights in turn. The targets are
    level * weight, cut at ``most`` times the size, with the level that makes them
    add up to all words: where cut targets are reshared by weight until none is
    above. Works on one row per source, in one task.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = totals.withColumn(
        "source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    )
    choose = F.array(*[F.lit(float(w)) for w in weights])
    weighted = numbered.withColumn("weight", F.element_at(choose, F.col("source_no") % len(weights) + 1))
    full = F.col("source_size") * most
    first_to_fill = Window.orderBy(full / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    levels = weighted.withColumn(
        "level",
        (
            F.sum("source_size").over(everything)
            - F.coalesce(F.sum(full).over(first_to_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
        / F.sum("weight").over(first_to_fill.rowsBetween(0, Window.unboundedFollowing)),
    )
    # Sources fill up in this order; the first level that its source can hold is the common one.
    level = F.min_by("level", "source_no_order").over(everything)
    holds = F.when(F.col("level") * F.col("weight") <= full, F.row_number().over(first_to_fill))
    return (
        levels.withColumn("source_no_order", holds)
        .withColumn("level", level)
        .select(
            "source", "source_no", "weight", "source_size",
            F.least(F.col("level") * F.col("weight"), full.cast("double")).alias("target"),
        )
    )


def _arrival(share, ramp):
    """Time at which the integral of 1 + ramp * (2t - 1) reaches ``share``."""
    rising = (F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * share) - (1 - ramp)) / (2 * ramp)
    return F.when(ramp == 0, share).otherwise(rising)


def mix_sources(
    docs: DataFrame,
    doc: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights=(1.0, 2.0, 3.0),
    ramps=(-0.5, 0.0, 0.5),
    most: int = 3,
) -> DataFrame:
    """(doc, source, size, source_size, target, taken, copies) of every row of ``docs``.

    ``copies`` lists (pass, words, position) of the copies that the mix takes,
    ``taken`` their words. A source's copies hold its target rounded to words.
    ``ramps`` tilt the weights over time: a source's weight at t is its weight
    times 1 + ramp * (2t - 1), a ramp between -1 and 1.

    The size is the number of runs of other characters than space and 0x09-0x0D;
    null and empty texts have size 0 and no copies. A null source is a source. Rows
    are told apart by id, rows without id by their text; equal rows are interchangeable.
    Other columns are ignored.
    """
    name = F.md5(F.coalesce(F.col(doc).cast("string"), F.md5(F.col(text)), F.lit("")).cast("binary"))
    sizes = freeze(
        docs.select(
            F.col(doc).alias("doc"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size"),
            F.conv(F.substring(name, 1, _ORDER_BITS // 4), 16, 10).cast("bigint").alias("order"),
        ),
        "document-sizes",
    )
    targets = source_targets(sizes, weights, most)
    chunks = max(0, math.ceil(math.log2(max(1, sizes.count()) / _ROWS_PER_CHUNK)))
    named = targets.withColumnRenamed("source", "_source")
    known = sizes.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    known = freeze(known, "sized-sources")
    placed = ordered_scan(
        known, ["source_no"], "order", sums={"upto": F.col("size")}, ties=["size"], chunk_bits=_ORDER_BITS - chunks
    )
    tilt = F.array(*[F.lit(float(r)) for r in ramps])
    placed = placed.withColumns(
        {
            "before": F.col("upto") - F.col("size"),
            "take": F.round("target").cast("bigint"),
            "ramp": F.element_at(tilt, F.col("source_no") % len(ramps) + 1),
        }
    )

    def copy(n):
        start = F.col("before") + n * F.col("source_size")
        words = F.greatest(F.least(F.col("take") - start, F.col("size")), F.lit(0))
        return F.struct(
            F.lit(n).alias("pass"),
            words.alias("words"),
            _arrival(F.least(start / F.greatest("take", F.lit(1)), F.lit(1.0)), F.col("ramp")).alias("position"),
        )

    copies = F.filter(F.array(*[copy(n) for n in range(most)]), lambda c: c["words"] > 0)
    return placed.select(
        F.col("doc").alias(doc),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        F.aggregate(copies, F.lit(0).cast("bigint"), lambda total, c: total + c["words"]).alias("taken"),
        copies.alias("copies"),
    )


def schedule(mixed: DataFrame) -> DataFrame:
    """One row per copy, sorted by range of its training position."""
    rows = mixed.select(*[c for c in mixed.columns if c != "copies"], F.inline("copies"))
    return rows.repartitionByRange("position").sortWithinPartitions("position")

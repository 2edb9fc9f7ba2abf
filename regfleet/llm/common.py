"""Shared pieces of the text operators."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regfleet.session import freeze

__all__ = ["UPPER", "LOWER", "freeze", "table", "fold_ascii", "held_out", "pieces", "bloom_filter", "in_bloom"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes of text that a Python task holds as flat arrays at once (one document at least).
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves ``remainder``; false for a null id."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(modulus) == F.lit(remainder), F.lit(False))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece have about ``limit`` bytes."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        block = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(block)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if stop > start:
                yield batch.slice(start, stop - start)


# --- bounded filters -------------------------------------------------------

_SEED = np.uint64(0x9E3779B97F4A7C15)


def _place(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of each hash, and the three bits that it sets there."""
    spread = hashes * _SEED
    ones = np.zeros(len(hashes), dtype=np.uint64)
    for shift in (0, 6, 12):
        ones |= np.uint64(1) << ((spread >> np.uint64(shift + 8)) & np.uint64(63))
    return spread >> np.uint64(64 - (bits - 6)), ones


def _first_column(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column(0).to_numpy().view(np.uint64)


def bloom_filter(keys: DataFrame, key: str | list[str], max_bits: int = 27, count: int | None = None, hashes=_first_column) -> np.ndarray:
    """Blocked Bloom filter of a BIGINT column of hashes, as 64-bit words.

    It has at most 2^max_bits bits (16 MB), whatever the number of keys. A full
    filter lets more rows pass, so it may only save work, never decide a result.
    Where rows hold many hashes, ``hashes`` gives those of a batch of the columns
    ``key``, and ``count`` says how many there are.
    """
    bits = min(max_bits, max(16, int(keys.count() if count is None else count).bit_length() + 5))

    def words(batches):
        for found in (found for batch in batches for found in hashes(batch)):
            place, ones = _place(found, bits)
            word, at = np.unique(place, return_inverse=True)
            together = np.zeros(len(word), dtype=np.uint64)
            np.bitwise_or.at(together, at, ones)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.view(np.int64)), pa.array(together.view(np.int64))], ["word", "ones"]
            )

    set_words = (
        keys.select(*([key] if isinstance(key, str) else key)).mapInArrow(words, "word bigint, ones bigint").groupBy("word").agg(F.bit_or("ones").alias("ones"))
    ).toArrow()
    filled = np.zeros(1 << (bits - 6), dtype=np.uint64)
    filled[set_words.column("word").to_numpy()] = set_words.column("ones").to_numpy().view(np.uint64)
    return filled


def in_bloom(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes may be in the filter."""
    place, ones = _place(hashes, len(filled).bit_length() - 1 + 6)
    return filled[place] & ones == ones

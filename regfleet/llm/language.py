"""Language identification by words first, then by ever shorter character n-grams.

A word that the sample knows is scored by its log frequency in each language. Of
an unknown word each letter is scored by the longest known n-gram of letters
that ends there. Scores are taken relative to their mean over the languages, so a
word counts by how much it tells languages apart.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pieces
from .words import LETTERS, WordCache, Words, letter_grams, split_words

#: Longest n-gram of letters (in bytes, a word's begin and end count).
ORDER = 5

#: Documents of each language that the tables are made of, about.
SAMPLE_PER_LANGUAGE = 2_000

#: Words and n-grams seen less often in the sample are unknown.
LEAST = 2

UNKNOWN = "und"


def _count_rows(text: str, language: str):
    """(order, key, language, n): counts of a piece's words (order 0) and n-grams."""

    def rows(batches):
        for piece in pieces(batches, text):
            words = split_words(piece.column(text), LETTERS)
            if not len(words.start):
                continue
            spoken = piece.column(language).to_numpy(zero_copy_only=False).astype(np.int64)[words.text]
            hashes = words.hashes()
            for of in np.unique(spoken):
                mine = np.flatnonzero(spoken == of)
                keys, first, count = np.unique(hashes[mine], return_index=True, return_counts=True)
                word, grams, _ = letter_grams(words, mine[first], list(range(1, ORDER + 1)))
                found = [(0, keys, count)]
                for n in range(1, ORDER + 1):
                    key, back = np.unique(grams[n], return_inverse=True)
                    found.append((n, key, np.bincount(back, weights=count[word]).astype(np.int64)))
                for n, key, count_n in found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(key), n, dtype=np.int32)), pa.array(key.view(np.int64)),
                            pa.array(np.full(len(key), of, dtype=np.int32)), pa.array(count_n),
                        ],
                        names=["order", "key", "language", "n"],
                    )

    return rows


def fit_languages(
    docs: DataFrame,
    text: str = "text",
    language: str = "lang",
    doc: str = "doc_id",
    per_language: int = SAMPLE_PER_LANGUAGE,
    modulus: int = 3,
    remainder: int = 1,
) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """(languages, tables): per order sorted hashes and relative log frequencies by language.

    Read from about ``per_language`` documents of each language, chosen by a hash
    of the id; documents whose crc32(id) leaves ``remainder``, without id, text
    or language are never read.
    """
    usable = F.col(text).isNotNull() & F.col(language).isNotNull() & F.col(doc).isNotNull()
    known = docs.filter(usable & ~held_out(doc, modulus, remainder))
    sizes = {r[0]: r["count"] for r in known.groupBy(language).count().collect()}
    names = sorted(sizes)
    if not names:
        return [], []
    chance = F.pmod(F.xxhash64(F.lit("language"), doc), F.lit(1 << 40)) / float(1 << 40)
    number, keep = F.lit(None).cast("int"), F.lit(0.0)
    for k, name in enumerate(names):
        number = F.when(F.col(language) == name, k).otherwise(number)
        keep = F.when(F.col(language) == name, per_language / sizes[name]).otherwise(keep)
    sample = known.filter(chance < keep).select(F.col(text).alias("_text"), number.alias("_language"))
    counts = (
        sample.mapInArrow(_count_rows("_text", "_language"), "order int, key bigint, language int, n bigint")
        .groupBy("order", "key")
        .agg(*[F.sum(F.when(F.col("language") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(names))])
        .filter(sum((F.col(f"n{k}") for k in range(len(names))), F.lit(0)) >= LEAST)
        .toPandas()
    )
    tables = []
    for n in range(ORDER + 1):
        mine = counts[counts["order"] == n]
        keys = mine["key"].to_numpy().view(np.uint64)
        seen = mine[[f"n{k}" for k in range(len(names))]].to_numpy(dtype=float)
        logs = np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * max(1, len(seen))))
        order = np.argsort(keys)
        tables.append((keys[order], (logs - logs.mean(axis=1, keepdims=True))[order].astype(np.float32)))
    return names, tables


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted hash in ``keys``, -1 where it is not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def _word_scores(tables, width: int):
    def compute(words: Words, chosen: np.ndarray) -> np.ndarray:
        scores = np.zeros((len(chosen), width))
        keys, values = tables[0]
        at = _found(keys, words.span_hash(words.start[chosen], words.end[chosen]))
        scores[at >= 0] = values[at[at >= 0]]
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            word, grams, _ = letter_grams(words, chosen[unknown], list(range(1, ORDER + 1)))
            letters = np.zeros((len(word), width))
            open_ = np.arange(len(word))
            for n in range(ORDER, 0, -1):
                keys, values = tables[n]
                at = _found(keys, grams[n][open_])
                letters[open_[at >= 0]] = values[at[at >= 0]]
                open_ = open_[at < 0]
            size = np.bincount(word, minlength=len(unknown))
            for k in range(width):
                scores[unknown, k] = np.bincount(word, weights=letters[:, k], minlength=len(unknown)) / size
        return scores

    return compute


def with_language(
    docs: DataFrame, names: list[str], tables, text: str = "text", language: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """``docs`` with the likeliest language and its score, the probability against the others (0 to 1).

    A text that is null or has no letter is ``und`` with score 0, and so is every
    text if no language was learned. Equal scores go to the first language by
    name. The whole text counts, whatever its length.
    """
    if not names:
        return docs.withColumns({language: F.lit(UNKNOWN), score: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    labels, width = pa.array(names), len(names)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = WordCache(_word_scores(shared.value, width), width, limit=2_000_000 // width)
        for texts in batches:
            best, top = [], []
            for piece in pieces(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text"):
                words = split_words(piece.column("text"), LETTERS)
                total = np.zeros((words.n_texts, width))
                if len(words.start):
                    values = cache.values(words)
                    for k in range(width):
                        total[:, k] = np.bincount(words.text, weights=values[:, k], minlength=words.n_texts)
                share = np.exp(total - total.max(axis=1, keepdims=True))
                best.append(total.argmax(axis=1))
                top.append(1 / share.sum(axis=1))
            best, top = (np.concatenate(x) if x else np.zeros(0, dtype=int) for x in (best, top))
            yield pa.StructArray.from_arrays([labels.take(pa.array(best)), pa.array(top)], names=["name", "share"])

    guess = F.arrow_udf(predict, "name string, share double")
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return (
        docs.withColumn("_guess", guess(F.col(text)))
        .withColumns(
            {
                language: F.when(letters, F.col("_guess.name")).otherwise(UNKNOWN),
                score: F.when(letters, F.col("_guess.share")).otherwise(0.0),
            }
        )
        .drop("_guess")
    )


def identify_languages(
    docs: DataFrame, text: str = "text", language: str = "lang", doc: str = "doc_id", modulus: int = 3, remainder: int = 1, **options
) -> DataFrame:
    """(doc, held_out, lang_pred, score) of every row; see ``fit_languages`` and ``with_language``."""
    names, tables = fit_languages(docs, text, language, doc, modulus=modulus, remainder=remainder, **options)
    return with_language(docs.select(doc, text), names, tables, text).select(
        doc, held_out(doc, modulus, remainder).alias("held_out"), "lang_pred", "score"
    )

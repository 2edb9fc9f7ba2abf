"""Toxicity of texts by class-conditional Kneser-Ney models of the letters of their words.

Both classes have an interpolated Kneser-Ney model of the next byte of a word
after up to ``ORDER - 1`` bytes (a word's begin and end count). Only the highest
order is counted per class; both back off to the same lower orders, made of
continuation counts of the pooled sample, so an expression that is rare in both
classes says nothing about the class. Where an n-gram was seen in neither class,
the shared lower order cancels from the ratio, hence scoring needs a table of
log ratios by n-gram and one by context.

A toxic document is mostly made of ordinary words, so its likelihood takes each
word from the toxic model with the probability ``TOXIC_SHARE`` and from the
ordinary one otherwise. A document's score is a logistic function of its
log-likelihood ratio per word, with ``SMOOTH`` words added to the length, fitted
with models of three quarters of the sample on the last quarter; the counts of
both make the final models.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, pieces
from .words import LETTERS, WordCache, Words, letter_grams, look_up, split_words

ORDER = 6
SMOOTH = 20
TOXIC_SHARE = 0.01
DISCOUNT = 0.75

#: Labelled documents of each class that the models are fitted on, at most.
SAMPLE_PER_CLASS = 10_000

@dataclass
class ToxicityModel:
    grams: np.ndarray  # sorted hashes
    gram_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    slope: float
    intercept: float


def _word_ratios(gram_keys, gram_ratio, context_keys, context_ratio):
    def compute(words: Words, chosen: np.ndarray) -> np.ndarray:
        word, grams, contexts = letter_grams(words, chosen, [ORDER])
        ratio = look_up(gram_keys, gram_ratio, grams[ORDER])
        rest = np.isnan(ratio)
        ratio[rest] = np.nan_to_num(look_up(context_keys, context_ratio, contexts[ORDER][rest]))
        total = np.bincount(word, weights=ratio, minlength=len(chosen))
        return np.log1p(TOXIC_SHARE * np.expm1(np.minimum(total, 500)))[:, None]

    return compute


def _mean_ratios(texts: pa.Array, cache: WordCache) -> np.ndarray:
    words = split_words(texts, LETTERS)
    values = cache.values(words)[:, 0] if len(words.start) else np.zeros(0)
    total = np.bincount(words.text, weights=values, minlength=words.n_texts)
    return total / (np.bincount(words.text, minlength=words.n_texts) + SMOOTH)


_COUNT_COLUMNS = [f"{kind}_{n}" for n in range(1, ORDER + 1) for kind in ("gram", "context")]


_PARTS = ["ordinary", "toxic", "ordinary_check", "toxic_check"]


def _count_rows(text: str, part: str):
    """Distinct highest-order n-grams of a piece with their lower orders and counts by part (of ``_PARTS``)."""

    def rows(batches):
        for piece in pieces(batches, text):
            words = split_words(piece.column(text), LETTERS)
            if not len(words.start):
                continue
            part_of = np.asarray(piece.column(part).to_numpy(zero_copy_only=False), dtype=np.int64)[words.text]
            _, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
            per_word = np.stack([np.bincount(back, weights=part_of == c, minlength=len(first)) for c in range(4)])
            word, grams, contexts = letter_grams(words, first, list(range(1, ORDER + 1)))
            top, place, back = np.unique(grams[ORDER], return_index=True, return_inverse=True)
            counts = [np.bincount(back, weights=per_word[c][word], minlength=len(top)).astype(np.int64) for c in range(4)]
            columns = [x[n][place].view(np.int64) for n in range(1, ORDER + 1) for x in (grams, contexts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in [*columns, *counts]], names=[*_COUNT_COLUMNS, *_PARTS]
            )

    return rows


def _per(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of positive ``values`` of each key, row by row."""
    _, back = np.unique(keys, return_inverse=True)
    return np.bincount(back, weights=values)[back], np.bincount(back, weights=values > 0)[back]


def _shared(table: dict[str, np.ndarray]) -> np.ndarray:
    """Probability of each row's n-gram of the order below the highest, from continuation counts.

    An n-gram counts once for each distinct n-gram that extends it to the left.
    """
    lower = None
    for n in range(1, ORDER):
        gram, context = table[f"gram_{n}"], table[f"context_{n}"]
        _, extended = np.unique(table[f"gram_{n + 1}"], return_index=True)
        kinds, back = np.unique(gram, return_inverse=True)
        count = np.bincount(back[extended], minlength=len(kinds)).astype(float)
        # Totals of a context are taken over its distinct n-grams.
        _, first = np.unique(gram, return_index=True)
        contexts, of = np.unique(context[first], return_inverse=True)
        total, number = np.bincount(of, weights=count), np.bincount(of)
        place = np.searchsorted(contexts, context)
        if lower is None:
            lower = count[back] / count.sum()
        else:
            lower = (np.maximum(count[back] - DISCOUNT, 0) + DISCOUNT * number[place] * lower) / total[place]
    return lower


def _ratios(table: dict[str, np.ndarray], ordinary: np.ndarray, toxic: np.ndarray):
    """Log ratios toxic / ordinary by n-gram and by context."""
    shared = _shared(table)
    context = table[f"context_{ORDER}"]
    gram_log, rest_log = 0.0, 0.0
    for sign, count in ((-1, ordinary), (1, toxic)):
        total, kinds = _per(context, count)
        back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        rest_log = rest_log + sign * np.log(back)
        gram_log = gram_log + sign * np.log(np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1) + back * shared)
    grams = table[f"gram_{ORDER}"].view(np.uint64)
    order = np.argsort(grams)
    contexts, first = np.unique(context.view(np.uint64), return_index=True)
    return grams[order], gram_log[order], contexts, rest_log[first]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a ridge logistic regression, by Newton steps on a standardised input."""
    centre, spread = np.average(x, weights=weight), x.std() or 1.0
    z = np.stack([(x - centre) / spread, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + 0.1 * beta * [1, 0]
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([0.1, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / spread), float(beta[1] - beta[0] * centre / spread)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_class: int = SAMPLE_PER_CLASS,
    modulus: int = 4,
    remainder: int = 2,
) -> ToxicityModel | None:
    """Models of a sample of at most ``per_class`` labelled documents of each class, None without both classes.

    Documents whose crc32(id) leaves ``remainder`` are not read. Several labels
    of one document count as toxic if one is. Ids are chosen by hash.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col(doc).isNotNull() & ~held_out(doc, modulus, remainder))
        .groupBy(F.col(doc).alias("_id"))
        .agg(F.max(label).alias("_toxic"))
    )
    sizes = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    if set(sizes) != {0, 1}:
        return None
    mixed = F.xxhash64("_id")
    chosen = None
    for c in (0, 1):
        part = known.filter(F.col("_toxic") == c).orderBy(mixed, "_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    sample = (
        docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
        .filter("_text IS NOT NULL")
        .join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
        .select("_text", "_toxic", (F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(4)) == 0).alias("_check"))
    )
    schema = ", ".join(f"{c} bigint" for c in [*_COUNT_COLUMNS, *_PARTS])
    part = (F.col("_toxic") + F.when(F.col("_check"), 2).otherwise(0)).cast("int").alias("_part")
    counts = sample.select("_text", part).mapInArrow(_count_rows("_text", "_part"), schema)
    found = counts.groupBy(*_COUNT_COLUMNS).agg(*[F.sum(c).alias(c) for c in _PARTS]).toArrow()
    table = {c: found.column(c).to_numpy() for c in found.column_names}
    del found
    seen = (table["ordinary"] > 0) | (table["toxic"] > 0)
    if not seen.any():
        return None
    fitted = {c: x[seen] for c, x in table.items()}
    trial = ToxicityModel(*_ratios(fitted, fitted["ordinary"], fitted["toxic"]), 1.0, 0.0)
    del fitted
    ratio = _ratio_udf(docs.sparkSession, trial)
    points = sample.filter("_check").select("_toxic", ratio("_text").alias("x")).toPandas()
    both = [table[c] + table[f"{c}_check"] for c in ("ordinary", "toxic")]
    model = ToxicityModel(*_ratios(table, *both), 1.0, 0.0)
    if points["_toxic"].nunique() == 2:
        y = points["_toxic"].to_numpy(dtype=float)
        share = {c: sizes[c] / min(sizes[c], per_class) for c in (0, 1)}
        model.slope, model.intercept = _logistic(points["x"].to_numpy(), y, np.where(y > 0, share[1], share[0]))
    return model


def _ratio_udf(spark, model: ToxicityModel):
    tables = spark.sparkContext.broadcast((model.grams, model.gram_ratio, model.contexts, model.context_ratio))

    def ratios(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = WordCache(_word_ratios(*tables.value))
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], ["text"])
            parts = [_mean_ratios(p.column("text"), cache) for p in pieces(iter([batch]), "text")]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return F.arrow_udf(ratios, "double")


def toxicity_score(spark: SparkSession, model: ToxicityModel | None, text: str = "text") -> Column:
    """Score of a text between 0 and 1; higher: more likely toxic.

    Null and empty texts get the score of a ratio of zero. Without a model (no
    labels of both classes) every score is 0.
    """
    if model is None:
        return F.lit(0.0)
    ratio = _ratio_udf(spark, model)
    return 1 / (1 + F.exp(-(ratio(F.col(text)) * model.slope + model.intercept)))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    cut: float = 0.3,
    modulus: int = 4,
    remainder: int = 2,
    **options,
) -> DataFrame:
    """(doc, held_out, score, predicted) of every row; see ``fit_toxicity`` and ``toxicity_score``."""
    model = fit_toxicity(docs, labels, doc, text, modulus=modulus, remainder=remainder, **options)
    scored = docs.select(doc, text).withColumn("score", toxicity_score(docs.sparkSession, model, text))
    return scored.select(
        doc,
        held_out(doc, modulus, remainder).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )

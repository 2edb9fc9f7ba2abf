"""Words of many texts at once as flat NumPy arrays.

Used inside Arrow batches. A word is a maximal run of word bytes of the UTF-8
text, so every class of words that is stated over ASCII bytes (and "all of
0x80-0xFF") can be cut without decoding.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C55
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: Every byte but space and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Letters: A-Z, a-z and every byte of a character beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

_SAME = np.arange(256, dtype=np.uint8)
FOLD = _SAME.copy()
FOLD[0x41:0x5B] += 0x20

_tables = {"power": np.ones(1, dtype=np.uint64), "inverse": np.ones(1, dtype=np.uint64)}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_tables[name]) < n:
        factors = np.full(n, base, dtype=np.uint64)
        factors[0] = 1
        _tables[name] = np.cumprod(factors)
    return _tables[name]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Word ``i`` is ``data[start[i]:end[i]]`` of text ``text[i]``, in order."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    n_texts: int
    prefix: np.ndarray | None = None

    def bounds(self) -> np.ndarray:
        """Words of text ``t`` are ``bounds[t]:bounds[t + 1]``."""
        return np.searchsorted(self.text, np.arange(self.n_texts + 1))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal bytes have equal hashes."""
        if self.prefix is None:
            power = _power("power", _BASE, len(self.data) + 1)
            self.prefix = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=self.prefix[1:])
        inverse = _power("inverse", _BASE_INVERSE, len(self.data) + 1)
        return mix((self.prefix[end] - self.prefix[start]) * inverse[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def split_words(texts: pa.Array, word_bytes: np.ndarray, fold: np.ndarray = FOLD) -> Words:
    """Words of a string array; a null text has none."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    data = fold[np.frombuffer(data, dtype=np.uint8)[first:last]] if last > first else np.zeros(0, dtype=np.uint8)
    begins = offsets[:-1] - first

    inside = word_bytes[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cut = begins[begins < len(data)]
    opens[cut] = inside[cut]
    start = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    cut = cut[cut > 0] - 1
    closes[cut] = inside[cut]
    end = np.flatnonzero(closes) + 1
    text = np.searchsorted(begins, start, side="right") - 1
    return Words(data, start, end, text, len(texts))


class WordCache:
    """Values of words, worked out once per word and task.

    ``compute(words, chosen)`` gives an array with one row for each chosen word.
    The cache holds at most ``limit`` words and starts anew beyond; results do
    not depend on it.
    """

    def __init__(self, compute, width: int = 1, limit: int = 1_000_000):
        self.compute, self.limit = compute, limit
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.rows = np.zeros((0, width))

    def values(self, words: Words) -> np.ndarray:
        hashes, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        rows = np.zeros((len(hashes), self.rows.shape[1]))
        rows[known] = self.rows[at[known]]
        if not known.all():
            rows[~known] = self.compute(words, first[~known])
            if len(self.hashes) > self.limit:
                self.hashes, self.rows = hashes, rows
            else:
                self.hashes = np.insert(self.hashes, at[~known], hashes[~known])
                self.rows = np.insert(self.rows, at[~known], rows[~known], axis=0)
        return rows[back]


_START, _END = np.uint64(0x51ED270B6A09E667), np.uint64(0x3C6EF372FE94F82B)


def letter_grams(words: Words, chosen: np.ndarray, orders: list[int]) -> tuple[np.ndarray, dict, dict]:
    """For every letter of the chosen words, and their ends: word, hashes by order, context hashes by order."""
    start, end = words.start[chosen], words.end[chosen]
    sizes = end - start + 1
    word = np.repeat(np.arange(len(chosen)), sizes)
    step = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begin, stop = start[word], end[word]
    at = begin + step
    last = at == stop
    until = np.where(last, at, at + 1)
    grams, contexts = {}, {}
    for n in orders:
        low = np.maximum(at - (n - 1), begin)
        mark = np.where(at - (n - 1) < begin, _START, np.uint64(0)) + np.uint64(n)
        contexts[n] = mix(words.span_hash(low, at) ^ mark)
        grams[n] = mix(words.span_hash(low, until) + mark + np.where(last, _END, np.uint64(0)))
    return word, grams, contexts


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted hash in a table sorted by ``keys``, NaN where it has none."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    found = keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)
    return np.where(found, values[at] if len(keys) else np.nan, np.nan)

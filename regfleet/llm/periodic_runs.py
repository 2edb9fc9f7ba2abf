"""Runs of words that repeat with a fixed period, found from Lyndon roots.

The words of each text are cut into stretches in which every three words in a row come three times or more; a run lies
within one of them. Each stretch goes through the first phase of Baier's suffix sorter, under the order of the words
and under its reverse: suffixes are grouped by a prefix that grows until it is the longest Lyndon word at that place,
so the final group of a suffix gives its Lyndon length. A root that stands several times in a row is extended to both
sides as long as words one period apart are equal, which gives the run.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

MIN_LENGTH = 6
MIN_EXPONENT = 4

_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place.

    Groups are taken from the greatest down. The nearest place to the left that is not in a taken group has the taken
    group's prefix right behind its own, as often as suffixes of the group point to it; it moves to a group above its
    old one, the higher the more often.
    """
    n = len(symbols)
    number = {s: g for g, s in enumerate(sorted(set(symbols)))}
    group = [number[s] for s in symbols]
    count = len(number)
    members: list[list[int]] = [[] for _ in range(count)]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [1] * count
    below, above = list(range(-1, count - 1)), list(range(1, count + 1))
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    lengths, pointer = [0] * n, [-1] * n
    top = count - 1
    while top >= 0:
        live = [i for i in members[top] if group[i] == top]
        width = size[top]
        pointed: dict[int, int] = {}
        for i in live:
            at = left[i]
            if at >= 0 and group[at] == top:
                at = pointer[at]
            pointer[i] = at
            lengths[i] = width
            if at >= 0:
                pointed[at] = pointed.get(at, 0) + 1
        for i in live:
            before, after = left[i], right[i]
            if before >= 0:
                right[before] = after
            if after < n:
                left[after] = before
        moved: dict[tuple[int, int], list[int]] = {}
        for at, times in pointed.items():
            moved.setdefault((group[at], -times), []).append(at)
        for old, times in sorted(moved):
            new = len(members)
            members.append(moved[old, times])
            size.append(size[old] - times * width)
            higher = above[old]
            below.append(old)
            above.append(higher)
            above[old] = new
            below[higher] = new
            for at in members[new]:
                group[at] = new
        top = below[top]
    return lengths


def _common(ids: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from places ``i`` < ``j`` on, forward or backward, are equal."""
    limit = len(ids) - j if step > 0 else i + 1
    done, block = 0, 16
    while done < limit:
        more = min(block, limit - done)
        if step > 0:
            unequal = ids[i + done : i + done + more] != ids[j + done : j + done + more]
        else:
            unequal = (ids[i - done - more + 1 : i - done + 1] != ids[j - done - more + 1 : j - done + 1])[::-1]
        if unequal.any():
            return done + int(unequal.argmax())
        done += more
        block *= 2
    return limit


def _stretches(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Parts that hold all runs: each three words in a row come as often as in the shortest run at least."""
    done, todo = [], [(0, len(ids))]
    while todo:
        low, high = todo.pop()
        part = ids[low:high].astype(np.uint64)
        if len(part) < least:
            continue
        code = (part[:-2] * np.uint64(0x9E3779B97F4A7C15) + part[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + part[2:]
        code = (code * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - (8 * len(code)).bit_length())
        code = code.astype(np.int64)
        often = np.bincount(code)[code] >= 3
        edge = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)))
        found = [(low + a, low + b + 2) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b + 2 - a >= least]
        if found == [(low, high)]:
            done.append((low, high))
        else:
            todo.extend(found)
    return done


def word_runs(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers, by start, then period."""
    found = set()
    for low, high in _stretches(ids, max(min_length, 4)):
        part = ids[low:high]
        for symbols in (part, -part):
            lengths = np.array(lyndon_lengths(symbols.tolist()), dtype=np.int64)
            at = np.arange(len(part))
            last = at + 2 * lengths
            roots = at[last < len(part)]
            q = lengths[roots]
            keep = (lengths[roots + q] == q) & (lengths[roots + 2 * q] == q)
            roots, q = roots[keep], q[keep]
            keep = (part[roots] == part[roots + q]) & (part[roots + q - 1] == part[roots + 2 * q - 1])
            seen: dict[int, int] = {}
            for i, period in zip(roots[keep].tolist(), q[keep].tolist()):
                if i < seen.get(period, 0):
                    continue
                ahead = _common(part, i, i + period, 1)
                back = _common(part, i - 1, i + period - 1, -1) if i else 0
                seen[period] = i + ahead
                length = back + ahead + period
                if length >= max(min_length, min_exponent * period):
                    found.add((low + i - back, length, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    step = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) > 0


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """Runs of repeated words of every text, and the text with one period of each run.

    A word is a run of bytes other than space and 0x09-0x0D. A run is a longest stretch of words with smallest period
    q and at least ``min_length`` words and ``min_exponent`` (4 or more) periods. Returns one row per row of ``docs``:
    the id, ``n_words``, ``runs`` (start, length, period by start, then period) and ``collapsed``: the words that no
    run holds after its first period, joined by one space. A null or empty text has no words and collapses to ''.
    Other columns are not read. Each text is held by one task; nothing is shuffled.
    """
    if min_exponent < 4 or min_length < 6:
        raise ValueError("runs are found from 4 periods and 6 words on")
    kind = docs.schema[id_col].dataType.simpleString()

    def collapse(batches):
        schema = None
        for batch in batches:
            for piece in pieces([batch], "text"):
                n_words, all_runs, collapsed = [], [], []
                for text in piece.column("text").cast(pa.large_binary()).to_pylist():
                    words = (text or b"").split()
                    runs = []
                    if len(words) >= min_length:
                        known: dict[bytes, int] = {}
                        ids = np.fromiter(map(known.setdefault, words, itertools.count()), np.int64, len(words))
                        runs = word_runs(ids, min_length, min_exponent)
                    if runs:
                        words = list(itertools.compress(words, ~_dropped(len(words), runs)))
                    n_words.append(len(ids) if runs else len(words))
                    all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    collapsed.append(b" ".join(words).decode())
                run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                schema = ["id", "n_words", "runs", "collapsed"]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(n_words, pa.int64()), pa.array(all_runs, pa.list_(run)), pa.array(collapsed, pa.string())],
                    schema,
                )

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = named.mapInArrow(collapse, f"id {kind}, n_words bigint, runs {_RUNS}, collapsed string")
    return found.withColumnRenamed("id", id_col)

"""Cross-entropy difference of texts between a target and a background bigram model.

Every word and every pair of words counts, with exact counts: the background is
counted over every document, the target over all chosen ones, and the
background's counts are scaled to the target's, so that both are smoothed alike.
A word's probability after another is (c(h, w) + MU * p(w)) / (c(h) + MU).

The counts are tables that grow with the corpus. Pairs are told apart by 64-bit
hashes; the leading bits of a hash name its bucket, and there are so many buckets
that each holds some 500,000 words of text. Between stages a row is a block:
the sorted pairs that a task has for one bucket, as arrays. Such a block takes
some seven bytes a pair, and adding blocks up is a merge of sorted arrays.

A pair that is in no block of the table occurs once, in the text at hand. Counts of
the most frequent words and pairs are broadcast, with Bloom filters of the others
that occur more than once; what a text holds of those goes to the bucket of its
pair, and the losses come back to the text. The broadcasts only decide where a
count is looked up.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfleet.session import batches_of

from .common import bloom_filter, freeze, in_bloom, pieces
from .words import LETTERS, Words, mix, split_words

MU = 50.0

#: Pairs of words, and words, whose counts are broadcast, at most. One beyond stands at most once in so many.
HOT = 1 << 20

#: Ids of target documents up to which they are broadcast; more are joined by shuffle.
BROADCAST_TARGETS = 500_000

#: Rows that a task holds before it hands them on, and words of text for each bucket.
_HELD, _BUCKET = 1 << 19, 1 << 19

#: Bytes of text that are split at once; a worker holds some hundred bytes of arrays for each.
_PIECE = 1 << 18

#: Bytes of a batch of rows on its way to a worker, and rows of words on their way back.
_BATCH, _SENT = 1 << 22, 1 << 16

#: Texts whose losses are added up together, as a power of two.
_TEXT_BITS = 13

_BEGIN, _UNKNOWN = np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1)
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Kinds of blocks: counts of pairs, pairs of texts to look up, words and words before to look up, sums of texts, losses.
_COUNTS, _PAIRS, _WORDS, _BEFORE, _TEXTS, _LOSSES = range(6)
_BLOCK = ["kind", "bucket", "a", "b", "c", "d", "e"]
_BLOCK_SCHEMA = "kind int, bucket bigint, a binary, b binary, c binary, d binary, e binary"


# --- blocks ----------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """64-bit values byte by byte: all lowest bytes, then all next ones, without the high ones that are zero throughout."""
    values = np.ascontiguousarray(values)
    width = max(1, (int(values.view(np.uint64).max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(scalar: pa.Scalar, dtype=np.uint64) -> np.ndarray:
    raw = np.frombuffer(scalar.as_buffer(), dtype=np.uint8)
    planes = raw[1:].reshape(raw[0], -1)
    values = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    values[:, : raw[0]] = planes.T
    return values.view(dtype).ravel()


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _keys_of(scalar: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unpacked(scalar), dtype=np.uint64)


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def _cut(kind: int, bucket: np.ndarray, columns: list[np.ndarray], rising: bool = False) -> pa.RecordBatch:
    """A block for each stretch of equal buckets; the first column as steps if it is ``rising``."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = [[] for _ in range(5)]
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]):
        for k in range(5):
            part = columns[k][low:high] if k < len(columns) else None
            rows[k].append(None if part is None else _packed(_steps(part) if rising and k == 0 else part))
    arrays = [pa.array(np.full(len(starts), kind, dtype=np.int32)), pa.array(bucket[starts]), *(pa.array(r, pa.binary()) for r in rows)]
    return pa.RecordBatch.from_arrays(arrays, _BLOCK)


def _by_bucket(batches):
    """(bucket, rows of it) of blocks that come sorted by bucket."""
    current, held = None, []
    for batch in batches:
        columns = [batch.column(c) for c in range(7)]
        for k, bucket in enumerate(columns[1].to_pylist()):
            if bucket != current:
                if held:
                    yield current, held
                current, held = bucket, []
            held.append((columns[0][k].as_py(), *(c[k] for c in columns[2:])))
    if held:
        yield current, held


def _added(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, and the columns added up by them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    return keys[first], [np.add.reduceat(c[order], first) if len(first) else c for c in columns]


# --- words and pairs -------------------------------------------------------


def _pairs(words: Words, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the word before every word, or of the begin of a text, of the word itself, and whether it ends its text."""
    word = words.hashes()
    if known is not None:
        word = np.where(np.isin(word, known), word, _UNKNOWN)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    first = np.ones(len(word), dtype=bool)
    first[1:] = words.text[1:] != words.text[:-1]
    before[first] = _BEGIN
    return before, word, np.append(first[1:], True)[: len(word)]


def _keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before) * _ODD + word)


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _pieces_of(batches):
    """Words of each piece of the texts, and which of them are in target documents."""
    for piece in pieces(batches, "text", _PIECE):
        words = split_words(piece.column("text"), LETTERS)
        yield piece, words, piece.column("wanted").to_numpy(zero_copy_only=False).astype(np.int64)


def _known_rows(batches):
    """(word, n): words by hash, counted per piece."""
    for piece in pieces(batches, "text", _PIECE):
        word, n = np.unique(split_words(piece.column("text"), LETTERS).hashes(), return_counts=True)
        yield pa.RecordBatch.from_arrays([_signed(word), pa.array(n)], ["word", "n"])


def _held(parts, emit):
    """What ``emit`` makes of (keys, columns) added up over pieces, whenever enough are held, and at the end."""
    kept, size = [], 0

    def together():
        keys, columns = np.concatenate([k for k, _ in kept]), [np.concatenate(c) for c in zip(*(c for _, c in kept))]
        kept.clear()
        return _added(keys, columns)

    for keys, columns in parts:
        kept.append(_added(keys, columns))
        size += len(kept[-1][0])
        if size > _HELD:
            kept = [together()]
            size = len(kept[0][0])
            if size > _HELD // 2:
                yield emit(*kept[0])
                kept, size = [], 0
    if kept:
        yield emit(*together())


_WORD_COLUMNS = ["n", "n_target", "last", "last_target"]


def _word_rows(shared):
    """(word, n, n_target, last, last_target): words, and how many of them end a text; texts end the begin once less."""

    def parts(batches):
        for _, words, wanted in _pieces_of(batches):
            if len(words.start):
                _, word, last = _pairs(words, shared.value)
                target, last = wanted[words.text], last.astype(np.int64)
                ends = np.array([last.sum(), (last * target).sum()])
                keys = np.append(word, _BEGIN)
                yield keys, [np.append(c, x) for c, x in zip((np.ones_like(last), target, last, last * target), (0, 0, -ends[0], -ends[1]))]

    def emit(keys, columns):
        return pa.RecordBatch.from_arrays([_signed(keys), *map(pa.array, columns)], ["word", *_WORD_COLUMNS])

    def rows(batches):
        for batch in _held(parts(batches), emit):
            for low in range(0, batch.num_rows, _SENT):
                yield batch.slice(low, _SENT)

    return rows


def _pair_blocks(shared, bits: int):
    """Blocks of counted pairs: key, n, n in targets."""

    def parts(batches):
        for _, words, wanted in _pieces_of(batches):
            if len(words.start):
                before, word, _ = _pairs(words, shared.value)
                yield _keys(before, word), [np.ones(len(word), dtype=np.int32), wanted[words.text].astype(np.int32)]

    def emit(keys, columns):
        return _cut(_COUNTS, _bucket(keys, bits), [keys, *(c.astype(np.int64) for c in columns)], rising=True)

    return lambda batches: _held(parts(batches), emit)


def _repeated_pairs(batches):
    """One block for each bucket with the pairs that occur more than once."""
    for bucket, rows in _by_bucket(batches):
        keys, (n, target) = _added(
            np.concatenate([_keys_of(r[1]) for r in rows]), [np.concatenate([_unpacked(r[k], np.int64) for r in rows]) for k in (2, 3)]
        )
        some = n > 1
        yield _cut(_COUNTS, np.full(int(some.sum()), bucket), [keys[some], n[some], target[some]], rising=True)


def _hot_pairs(bound: int):
    """(key, n, n_target) of the pairs of blocks with a count from ``bound`` on."""

    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                keys, n, target = _keys_of(batch.column(2)[k]), *(_unpacked(batch.column(c)[k], np.int64) for c in (3, 4))
                hot = n >= bound
                yield pa.RecordBatch.from_arrays([_signed(keys[hot]), pa.array(n[hot]), pa.array(target[hot])], ["key", "n", "n_target"])

    return rows


def _rare_keys(bound: int):
    """Keys of the pairs of blocks (keys, counts) with a count below ``bound``."""

    def hashes(batch):
        for keys, n in zip(batch.column(0), batch.column(1)):
            yield _keys_of(keys)[_unpacked(n, np.int64) < bound]

    return hashes


def _pair_steps(batches):
    """(step, rows, n): how many pairs have a count from n on, by steps of a quarter of its doubling."""
    for batch in batches:
        for k in range(batch.num_rows):
            n = _unpacked(batch.column(3)[k], np.int64)
            if len(n):
                step, at, rows = np.unique(np.floor(4 * np.log2(n)).astype(np.int32), return_inverse=True, return_counts=True)
                least = np.full(len(step), np.iinfo(np.int64).max)
                np.minimum.at(least, at, n)
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(rows), pa.array(least)], ["step", "rows", "n"])


def _hot_bound(steps: DataFrame, limit: int) -> tuple[int, int]:
    """The smallest of some counts that at most ``limit`` rows reach, from (step, rows, n), and how many do not reach it."""
    found = sorted(steps.groupBy("step").agg(F.sum("rows").alias("rows"), F.min("n").alias("n")).collect(), reverse=True)
    bound, reached = 1 << 62, 0
    for _, rows, n in found:
        if reached + rows > limit:
            break
        bound, reached = n, reached + rows
    return bound, sum(r.rows for r in found) - reached


# --- scores ----------------------------------------------------------------


class _Table:
    """Counts by 64-bit hash. The leading bits of a hash lead to its place."""

    def __init__(self, rows: pa.Table):
        keys = rows.column(0).to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.size = len(keys)
        self.keys = np.append(keys[order], ~np.uint64(0))
        self.columns = []
        for c in range(1, rows.num_columns):
            values = rows.column(c).to_numpy()[order]
            self.columns.append(np.append(values, 0).astype(np.min_scalar_type(int(values.max(initial=0)))))
        self.first = None

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        bits = max(1, self.size.bit_length())
        if self.first is None:
            self.first = np.empty(1 << bits, dtype=np.int32)
            for low in range(0, 1 << bits, _SENT):
                leading = np.arange(low, min(low + _SENT, 1 << bits), dtype=np.uint64)
                self.first[low : low + _SENT] = np.searchsorted(self.keys[:-1], leading << np.uint64(64 - bits))
        at = self.first[wanted >> np.uint64(64 - bits)]
        key = self.keys[at]
        behind = np.flatnonzero(key < wanted)
        while len(behind):
            at[behind] += 1
            key[behind] = self.keys[at[behind]]
            behind = behind[key[behind] < wanted[behind]]
        return at, (key == wanted) & (at < self.size)


class _Model:
    """What is broadcast: counts of frequent words and pairs, and filters of the others that occur more than once."""

    def __init__(self, known, words, pairs, word_filter, pair_filter, constants):
        self.known, self.words, self.pairs, self.constants = known, words, pairs, constants
        self.word_filter, self.pair_filter = word_filter, pair_filter

    def words_of(self, hashes: np.ndarray, wanted: np.ndarray, columns: tuple[int, int]):
        """Two counts of words, in the corpus and in targets, and whether they are known here."""
        at, hot = self.words.find(hashes)
        counts = [np.where(hot, self.words.columns[c][at], once) for c, once in zip(columns, (1, wanted), strict=True)]
        once = ~hot if self.word_filter is None else ~hot & ~in_bloom(self.word_filter, hashes)
        return counts, hot | once

    def pairs_of(self, keys: np.ndarray, wanted: np.ndarray):
        """The same of pairs."""
        at, hot = self.pairs.find(keys)
        counts = [np.where(hot, self.pairs.columns[c][at], once) for c, once in zip((0, 1), (1, wanted), strict=True)]
        once = ~hot if self.pair_filter is None else ~hot & ~in_bloom(self.pair_filter, keys)
        return counts, hot | once


def _share(pair, word, constant):
    """Loss of a word by the counts of its pair and of itself, but for the count of the word before."""
    scale, whole = constant
    return -np.log(pair * scale + MU * (word * scale + 1) / whole)


def _text_blocks(shared, bits: int):
    """Sums of every text over what is known here, and blocks of what has to be looked up."""

    def rows(batches):
        model, kept, size = shared.value, [], 0
        constants = model.constants[::-1]  # background first, as the counts
        for piece, words, wanted in _pieces_of(batches):
            target = wanted[words.text]
            before, word, _ = _pairs(words, model.known)
            key = _keys(before, word)
            word_n, word_known = model.words_of(word, target, (0, 1))
            before_n, before_known = model.words_of(before, target, (2, 3))
            pair_n, pair_known = model.pairs_of(key, target)
            here = word_known & pair_known
            sums = []
            for p, w, h, constant in zip(pair_n, word_n, before_n, constants, strict=True):
                loss = np.where(here, _share(p, w, constant), 0.0) + np.where(before_known, np.log(h * constant[0] + MU), 0.0)
                sums.append(np.bincount(words.text, weights=loss, minlength=words.n_texts))
            number = piece.column("number").to_numpy()
            counts = np.bincount(words.text, minlength=words.n_texts).astype(np.int64)
            yield _cut(_TEXTS, number >> _TEXT_BITS, [number, piece.column("digest").to_numpy(), counts, sums[1], sums[0]])
            marked = 2 * number[words.text] + target
            cold = np.flatnonzero(word_known & ~pair_known)
            kept.append((key[cold], marked[cold], word_n[0][cold].astype(np.int64), word_n[1][cold].astype(np.int64)))
            size += len(cold)
            for kind, open_, parts in ((_WORDS, ~word_known, (word, marked, key)), (_BEFORE, ~before_known, (before, marked))):
                if open_.any():
                    parts = [x[open_] for x in parts]
                    yield _cut(kind, np.zeros(len(parts[0]), dtype=np.int64), parts)
            if size > _HELD // 2:
                yield _pair_requests(kept, bits)
                kept, size = [], 0
        if size:
            yield _pair_requests(kept, bits)

    return rows


def _pair_requests(kept, bits: int) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*kept)]
    order = np.argsort(columns[0])
    columns = [c[order] for c in columns]
    return _cut(_PAIRS, _bucket(columns[0], bits), columns, rising=True)


def _open_rows(kind: int):
    """Rows of the blocks of open words: (word, marked, key), or (word, marked) for words before."""
    names = ["word", "marked", "key"][: 3 if kind == _WORDS else 2]

    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(_unpacked(batch.column(2 + c)[k], np.int64)) for c in range(len(names))], names)

    return rows


def _request_rows(bits: int):
    """Blocks of pairs to look up from rows (key, marked, n, n_target)."""

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                key, *rest = (batch.column(c).to_numpy() for c in range(4))
                yield _pair_requests([(key.view(np.uint64), *rest)], bits)

    return rows


def _losses(constants):
    """Blocks of losses of texts from the blocks of a bucket: the counts of its pairs come first, then what is asked for."""

    def rows(batches):
        kept, size = [], 0
        for _, found in _by_bucket(batches):
            table = [r for r in found if r[0] == _COUNTS]
            keys = np.append(_keys_of(table[0][1]) if table else np.zeros(0, dtype=np.uint64), ~np.uint64(0))
            n, target = (np.append(_unpacked(table[0][c], np.int64) if table else np.zeros(0, np.int64), 0) for c in (2, 3))
            for r in found:
                if r[0] == _COUNTS:
                    continue
                key, marked, c, c_target = _keys_of(r[1]), *(_unpacked(r[k], np.int64) for k in (2, 3, 4))
                at = np.searchsorted(keys[:-1], key)
                there = keys[at] == key
                p, p_target = np.where(there, n[at], 1), np.where(there, target[at], marked & 1)
                kept.append((marked >> 1, _share(p_target, c_target, constants[0]), _share(p, c, constants[1])))
                size += len(key)
                if size > 2 * _HELD:
                    yield _loss_block(kept)
                    kept, size = [], 0
        if kept:
            yield _loss_block(kept)

    return rows


def _loss_block(kept) -> pa.RecordBatch:
    number, target, background = (np.concatenate(x) for x in zip(*kept))
    number, sums = _added(number, [target, background])
    return _cut(_LOSSES, number >> _TEXT_BITS, [number, *sums])


def _loss_rows(batches):
    """Blocks from rows (number, target, background)."""
    for batch in batches:
        if batch.num_rows:
            yield _loss_block([tuple(batch.column(c).to_numpy() for c in range(3))])


def _means(batches):
    """(digest, n, target, background): words and mean losses of each text."""
    for _, rows in _by_bucket(batches):
        texts = [r for r in rows if r[0] == _TEXTS]
        number, digest, n = (np.concatenate([_unpacked(r[k], np.int64) for r in texts]) for k in (1, 2, 3))
        sums = [np.concatenate([_unpacked(r[k], np.float64) for r in texts]) for k in (4, 5)]
        order = np.argsort(number)
        number, digest, n, sums = number[order], digest[order], n[order], [s[order] for s in sums]
        for r in rows:
            if r[0] == _LOSSES:
                at = np.searchsorted(number, _unpacked(r[1], np.int64))
                for total, k in zip(sums, (2, 3)):
                    total[at] += _unpacked(r[k], np.float64)
        means = [np.divide(s, n, out=np.zeros(len(n)), where=n > 0) for s in sums]
        yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(n), *map(pa.array, means)], ["digest", "n", "target", "background"])


def _text_means(docs: DataFrame, targets: DataFrame, vocabulary: int | None, hot: int, broadcast_targets: int) -> DataFrame:
    """Digest, words and mean losses of the texts of (id, text) that are not null, stored; one row for each."""
    context = docs.sparkSession.sparkContext
    texts = docs.filter("text IS NOT NULL")
    known = None
    if vocabulary is not None:
        counts = texts.select("text").mapInArrow(_known_rows, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        known = counts.orderBy(F.desc("n"), "word").limit(vocabulary).toArrow().column("word").to_numpy().view(np.uint64)
    chosen = targets.filter("id IS NOT NULL").distinct().withColumn("wanted", F.lit(True))
    if chosen.limit(broadcast_targets + 1).count() <= broadcast_targets:
        chosen = F.broadcast(chosen)
    marked = texts.join(chosen, "id", "left").select("text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    given = context.broadcast(known)

    summed = marked.mapInArrow(_word_rows(given), "word bigint, " + ", ".join(f"{c} bigint" for c in _WORD_COLUMNS))
    summed = summed.groupBy("word").agg(*[F.sum(c).alias(c) for c in _WORD_COLUMNS])
    words = freeze(
        summed.selectExpr("word", "n", "n_target", "n - last AS as_before", "n_target - last_target AS as_before_target"), "word-counts"
    )
    seen = words.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n"), F.sum("n_target")).first()
    # With the begin of a text, and a place for unknown words.
    size = (seen[0] if known is None else len(known)) + 2
    total, total_target = seen[1] or 0, seen[2] or 0
    scale = min(total_target or 1, total) / total if total else 1.0
    constants = (1.0, float(total_target + size)), (scale, total * scale + size)
    bits = max(0, (total // _BUCKET).bit_length())

    counted = marked.mapInArrow(_pair_blocks(given, bits), _BLOCK_SCHEMA).repartition("bucket").sortWithinPartitions("bucket")
    pairs = freeze(counted.mapInArrow(_repeated_pairs, _BLOCK_SCHEMA), "word-pairs")

    often = F.greatest("n", "as_before")
    steps = words.filter(often > 0).select(F.floor(4 * F.log2(often)).cast("int").alias("step"), often.alias("n"))
    word_bound, _ = _hot_bound(steps.groupBy("step").agg(F.count("*").alias("rows"), F.min("n").alias("n")), hot)
    cold_words = words.filter((often < word_bound) & (often > 1))
    pair_bound, rare_pairs = _hot_bound(pairs.mapInArrow(_pair_steps, "step int, rows bigint, n bigint"), hot)
    model = _Model(
        known,
        _Table(words.filter(often >= word_bound).toArrow()),
        _Table(pairs.mapInArrow(_hot_pairs(pair_bound), "key bigint, n bigint, n_target bigint").toArrow()),
        None if cold_words.isEmpty() else bloom_filter(cold_words.select("word"), "word"),
        bloom_filter(pairs, ["a", "b"], count=rare_pairs, hashes=_rare_keys(pair_bound)) if rare_pairs else None,
        constants,
    )
    shared = context.broadcast(model)
    numbered = marked.select("text", "wanted", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("number"))
    blocks = freeze(numbered.mapInArrow(_text_blocks(shared, bits), _BLOCK_SCHEMA), "text-losses")

    def of_kind(kind):
        return blocks.filter(F.col("kind") == kind)

    def counted_words(rows, columns):
        """Rows with the counts of their rare word; one that is not in the table occurs once."""
        found = rows.join(cold_words.select("word", *columns), "word", "left")
        return found.withColumns({columns[0]: F.coalesce(columns[0], F.lit(1)), columns[1]: F.coalesce(columns[1], F.col("marked") % 2)})

    open_words = of_kind(_WORDS).mapInArrow(_open_rows(_WORDS), "word bigint, marked bigint, key bigint")
    requests = counted_words(open_words, ["n", "n_target"]).select("key", "marked", "n", "n_target")
    asked = of_kind(_PAIRS).union(requests.mapInArrow(_request_rows(bits), _BLOCK_SCHEMA))
    open_before = of_kind(_BEFORE).mapInArrow(_open_rows(_BEFORE), "word bigint, marked bigint")
    joined = counted_words(open_before, ["as_before", "as_before_target"])
    after = [F.log(F.col(c) * constant[0] + MU) for c, constant in zip(("as_before_target", "as_before"), constants, strict=True)]
    lost_before = joined.select(F.shiftright("marked", 1).alias("number"), after[0].alias("target"), after[1].alias("background"))

    matched = pairs.union(asked).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_losses(constants), _BLOCK_SCHEMA)
    sums = of_kind(_TEXTS).union(matched).union(lost_before.mapInArrow(_loss_rows, _BLOCK_SCHEMA))
    means = sums.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_means, "digest bigint, n bigint, target double, background double")
    return freeze(means, "text-means")


def score_documents(
    docs: DataFrame,
    targets: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    vocabulary: int | None = None,
    hot: int = HOT,
    broadcast_targets: int = BROADCAST_TARGETS,
) -> DataFrame:
    """``docs`` with n_tokens, loss_target, loss_background (nats per word) and score, their difference.

    ``targets`` holds the ids of target documents; all of them make the target
    model. A higher score is closer to the target. Words are runs of letters after
    lower-casing A-Z, told apart by 64-bit hashes. All words are known unless
    ``vocabulary`` asks for so many of the most frequent ones only. ``hot`` and
    ``broadcast_targets`` bound what is broadcast and do not change results.
    Texts that are null or have no words get 0 tokens, losses and score 0. If no
    target document has words, the target model is the uniform one over the
    vocabulary. Other columns stay; those of the four names are replaced.
    """
    texts, chosen = docs.select(F.col(doc).alias("id"), F.col(text).alias("text")), targets.select(F.col(doc).alias("id"))
    with batches_of(docs.sparkSession, _BATCH):
        means = _text_means(texts, chosen, vocabulary, hot, broadcast_targets)
    # Equal texts have equal means.
    means = means.groupBy(F.col("digest").alias("_lm_digest")).agg(*[F.max(c).alias(f"_lm_{c}") for c in ("n", "target", "background")])

    def loss(name):
        return F.coalesce(f"_lm_{name}", F.lit(0.0))

    return (
        docs.withColumn("_lm_digest", F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text).cast("string"))))
        .join(means, "_lm_digest", "left")
        .withColumns({"n_tokens": F.coalesce("_lm_n", F.lit(0)), "loss_target": loss("target"), "loss_background": loss("background")})
        .withColumn("score", F.col("loss_background") - F.col("loss_target"))
        .drop("_lm_digest", "_lm_n", "_lm_target", "_lm_background")
    )

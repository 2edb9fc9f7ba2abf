"""Removal of repeated byte strings by suffix sorting in two stages.

Every window of ``length`` bytes is dealt to the rarest-first smallest hash of its short strings (its anchor); equal
windows have equal anchors, so they meet in one group. The windows in a row of a text that share an anchor are one
segment. Groups whose anchor comes once cannot hold a repeat and are left out; equal segments are counted before the
shuffle. Tasks then sort the suffixes of whole groups: those smaller than their successor directly, all others by
scanning the buckets of first bytes in order. A window whose common prefix with a neighbour reaches ``length`` is
repeated.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_filter, freeze, in_bloom, pieces
from .words import mix

LENGTH = 200

#: Segments of a group may have so many bytes; the anchors of larger groups are avoided where a window has others.
HOT_BYTES = 4 << 20

#: Bytes of text that are scanned at once, and of segments that are sorted at once (one text or group at least).
_SCAN = 1 << 18
_SORT = 1 << 19
#: Occurrences of segments that a task counts together.
_COUNTED = 50_000

_HOT_BIT = np.uint64(1 << 63)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _gram(length: int) -> int:
    return max(1, min(24, length // 2))


# --- anchors ---------------------------------------------------------------


def _texts(batches, limit: int):
    """Batches cut to about ``limit`` bytes, with the bytes and bounds of their texts in column ``text``."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_binary())
        if text.null_count:
            text = pc.fill_null(text, b"")
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        cuts = np.flatnonzero(np.diff((offsets[:-1] - offsets[0]) // limit)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(text)]):
            if high > low:
                bounds = offsets[low : high + 1]
                yield batch.slice(low, high - low), data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _anchors(data: np.ndarray, bounds: np.ndarray, length: int, hot: np.ndarray):
    """Segments of some texts: text, first place in it, number of windows, anchor, how often the anchor is its smallest."""
    gram = _gram(length)
    span = length - gram + 1
    if len(data) < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.view(np.uint64), none
    # Hashes of short strings by doubling, joined for sizes that are not a power of two.
    by_size, size = {1: _BYTE[data]}, 1
    factor = 0x9E3779B97F4A7C15
    while size * 2 <= gram:
        h = by_size[size]
        by_size[size * 2] = h[:-size] * np.uint64(pow(factor, size, 1 << 64)) + h[size:]
        size *= 2
    hashes, done = by_size[size], size
    for size in sorted(by_size, reverse=True):
        if done + size <= gram:
            more = by_size[size][done:]
            hashes = hashes[: len(more)] * np.uint64(pow(factor, size, 1 << 64)) + more
            done += size
    hashes = mix(hashes) >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
        hashes |= np.where(hot[at] == hashes, _HOT_BIT, np.uint64(0))
    least, done = hashes, 1
    while done * 2 <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if span > done:
        least = np.minimum(least[: len(least) - (span - done)], least[span - done :])
    # Windows that do not cross the end of a text.
    sizes = np.maximum(np.diff(bounds) - length + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = bounds[owner] + place
    least = least[start]
    opens = np.ones(len(owner), dtype=bool)
    opens[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    cut = np.flatnonzero(opens)
    # A window that begins with its anchor, in front of one with the same: the anchor stands there twice.
    again = hashes[start] == least
    again[:-1] &= ~opens[1:]
    again[-1:] = False
    times = 1 + np.add.reduceat(again, cut, dtype=np.int64) if len(cut) else cut
    return owner[cut], place[cut], np.diff(np.append(cut, len(owner))), least[cut], times


def _segments(texts: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """Occurrences of segments whose anchor comes more than once, as a stored table.

    anchor, segment (digest), text_key, place, windows; and on the first occurrence that a task counts together with
    others, how many these are and the bytes.
    """

    def anchors(batches):
        for _, data, bounds in _texts(batches, _SCAN):
            *_, found, times = _anchors(data, bounds, length, hot)
            if len(found):
                anchor, back = np.unique(found, return_inverse=True)
                times = np.bincount(back, times).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(times)], ["anchor", "times"])

    counted = texts.select("text").mapInArrow(anchors, "anchor bigint, times bigint").groupBy("anchor").agg(F.sum("times").alias("times"))
    repeated = bloom_filter(freeze(counted.filter("times > 1").select("anchor"), "suffix-anchors"), "anchor")

    def occurrences(batches):
        kept, rows = [], 0
        for piece, data, bounds in _texts(batches, _SCAN):
            text, place, windows, anchor, _ = _anchors(data, bounds, length, hot)
            take = np.flatnonzero(in_bloom(repeated, anchor)) if len(anchor) else text
            if len(take):
                raw = data.tobytes()
                begin = bounds[text[take]] + place[take]
                end = begin + windows[take] + (length - 1)
                strings = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]
                digest = b"".join([hashlib.blake2b(x, digest_size=8).digest() for x in strings])
                key = piece.column("text_key").to_numpy()[text[take]]
                kept.append((anchor[take].view(np.int64), np.frombuffer(digest, dtype=np.int64), key, place[take], windows[take], strings))
                rows += len(take)
            if rows >= _COUNTED:
                yield counted_together(kept)
                kept, rows = [], 0
        if rows:
            yield counted_together(kept)

    def counted_together(kept):
        columns = [np.concatenate(part) for part in list(zip(*kept))[:5]]
        strings = [x for part in kept for x in part[5]]
        _, first, times = np.unique(columns[1], return_index=True, return_counts=True)
        n = np.zeros(len(strings), dtype=np.int64)
        n[first] = times
        shown = pa.array([x if m else None for x, m in zip(strings, n.tolist())], pa.binary())
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(n), shown], names)

    names = ["anchor", "segment", "text_key", "place", "windows", "times", "bytes"]
    kinds = "anchor bigint, segment bigint, text_key bigint, place bigint, windows bigint, times bigint, bytes binary"
    return freeze(texts.select("text_key", "text").mapInArrow(occurrences, kinds), "suffix-segments")


def _avoiding_hot(texts: DataFrame, length: int, hot_bytes: int) -> DataFrame:
    """Segments whose anchors have small groups, as far as windows have an anchor that has.

    The driver gets one number for every ``hot_bytes`` of segments at most.
    """
    hot = np.zeros(0, dtype=np.uint64)
    while True:
        found = _segments(texts, length, hot)
        sizes = found.filter("times > 0 AND anchor >= 0").groupBy("anchor", "segment").agg(F.max(F.length("bytes")).alias("size"))
        heavy = sizes.groupBy("anchor").agg(F.sum("size").alias("size"), F.count("*").alias("n")).filter((F.col("size") > hot_bytes) & (F.col("n") > 1))
        more = heavy.select("anchor").toArrow().column(0).to_numpy().view(np.uint64)
        if not len(more):
            return found
        hot = np.union1d(hot, more)


# --- suffix sorting --------------------------------------------------------


def _keys(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts like them."""
    key, size = np.append(data, np.zeros(8, dtype=np.uint8)).astype(np.uint64), 1
    while size < 8:
        key = (key[:-size] << np.uint64(8 * size)) | key[size:]
        size *= 2
    return key[: len(data)]


def _sort_directly(at: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the ``depth`` bytes from them on, eight at a time; only ties are looked at again."""
    first = key[at]
    order = np.argsort(first, kind="stable")
    at, first = at[order], first[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = first[1:] != first[:-1]
    for done in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        todo = np.flatnonzero(tied)
        if not len(todo):
            break
        opens = np.flatnonzero(new[todo])
        group = np.cumsum(new[todo]) - 1
        value = key[at[todo] + done]
        differs = np.logical_or.reduceat(value != value[opens][group], opens)[group]
        todo, group, value = todo[differs], group[differs], value[differs]
        if len(todo):
            order = np.lexsort((value, group))
            at[todo] = at[todo][order]
            value = value[order]
            new[todo[1:]] |= (value[1:] != value[:-1]) & (group[1:] == group[:-1])
    return at


def two_stage_order(data: np.ndarray, key: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Places where ``wanted`` is set, sorted by the ``depth`` bytes from them on.

    ``key`` holds ``_keys(data)``. ``data`` ends with ``depth`` + 8 bytes that are not wanted, the first of them smaller than the second. A suffix is
    rising if it is smaller than its successor. Rising suffixes are sorted directly. The others are induced: the
    buckets of first bytes are scanned in order, and the place before each suffix, if not rising, is next in its
    bucket. A bucket holds the induced suffixes first. Needed beside the wanted places are only those up to the next
    rising one.
    """
    rises = np.append(data[:-1] < data[1:], False)
    equal = np.flatnonzero(data[:-1] == data[1:])
    if len(equal):
        # In a stretch of equal bytes all rise or none does, as its last one.
        last = np.flatnonzero(np.append(equal[1:] - equal[:-1] > 1, True))
        rises[equal] = rises[np.repeat(equal[last] + 1, np.diff(last, prepend=-1))]
    # From each wanted place up to the next rising one.
    rising = np.flatnonzero(rises).astype(np.int32)
    begin = np.flatnonzero(wanted).astype(np.int32)
    end = rising[np.searchsorted(rising, begin)]
    first = np.flatnonzero(np.diff(end, prepend=-1))
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[begin[first]] += 1
    step[end[first] + 1] -= 1
    needed = np.cumsum(step[:-1], dtype=np.int8) > 0
    del rising, begin, end, step
    direct = _sort_directly(np.flatnonzero(needed & rises).astype(np.int32), key, depth)
    first = data[direct]
    cuts = np.searchsorted(first, np.arange(257))
    induce = np.append(needed & ~rises, False)  # place -1 is none
    coming: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in range(256):
        bucket = coming[byte]
        scanned = 0
        while scanned < len(bucket):
            before = bucket[scanned] - 1
            before = before[induce[before]]
            before = before[data[before] == byte]
            if len(before):
                bucket.append(before)
            scanned += 1
        bucket.append(direct[cuts[byte] : cuts[byte + 1]])
        whole = np.concatenate(bucket)
        coming[byte] = []
        if not len(whole):
            continue
        out.append(whole)
        before = whole - 1
        before = before[induce[before]]
        value = data[before]
        before, value = before[value > byte], value[value > byte]
        if len(before):
            order = np.argsort(value, kind="stable")
            before, value = before[order], value[order]
            starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            for part, at in zip(np.split(before, starts[1:]), starts.tolist()):
                coming[value[at]].append(part)
    order = np.concatenate(out) if out else np.zeros(0, dtype=np.int32)
    return order[wanted[order]]


def _shared(order: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """Whether the common prefix of each place with the next in order has ``length`` bytes."""
    equal = np.arange(max(len(order) - 1, 0))
    for done in range(0, length, 8):
        rest = np.uint64(8 * max(0, 8 - (length - done)))
        equal = equal[(key[order[equal] + done] ^ key[order[equal + 1] + done]) >> rest == 0]
    shared = np.zeros(len(order), dtype=bool)
    shared[equal] = True
    return shared


def repeated_windows(segments: list[bytes], times: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment the half-open ranges of window starts that are repeated, as low, high, low, high, ...

    A segment that stands for several copies is repeated throughout.
    """
    sizes = np.array([len(x) for x in segments], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join([*segments, b"\x00\xff", bytes(length + 8)]), dtype=np.uint8)
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(segments), dtype=np.int32), windows)
    inner = np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(windows) - windows).astype(np.int32), windows)
    place = begin.astype(np.int32)[owner] + inner
    wanted = np.zeros(len(data), dtype=bool)
    wanted[place] = True
    key = _keys(data)
    order = two_stage_order(data, key, wanted, length)
    shared = _shared(order, key, length)
    del key
    repeated = np.zeros(len(data), dtype=bool)
    repeated[order[shared]] = True
    repeated[order[1:][shared[:-1]]] = True
    marked = (repeated[place] | (times > 1)[owner]).astype(np.int8)
    opens = np.ones(len(owner), dtype=bool)
    opens[1:] = owner[1:] != owner[:-1]
    ends = np.append(opens[1:], True)
    low = np.flatnonzero((marked == 1) & (opens | (np.append(0, marked[:-1]) == 0)))
    high = np.flatnonzero((marked == 1) & (ends | (np.append(marked[1:], 0) == 0)))
    both = np.column_stack([inner[low], inner[high] + 1]).ravel()
    cuts = 2 * np.searchsorted(owner[low], np.arange(1, len(segments)))
    return np.split(both, cuts)


def _repeats(segments: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated windows of every segment that has any."""

    def sort_groups(batches):
        kept, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            size += batch.column("bytes").nbytes
            last = batch.column("anchor")[-1]
            if size < _SORT or kept[0].column("anchor")[0] == last:
                continue
            held = pa.Table.from_batches(kept)
            cut = int(np.flatnonzero(held.column("anchor").to_numpy() != last.as_py())[-1]) + 1
            yield from sort(held.slice(0, cut))
            kept = held.slice(cut).to_batches()
            size = sum(b.column("bytes").nbytes for b in kept)
        if kept:
            yield from sort(pa.Table.from_batches(kept))

    def sort(held):
        segment, times = held.column("segment").to_numpy(), held.column("times").to_numpy()
        opens = np.concatenate([[True], segment[1:] != segment[:-1]])
        first = np.flatnonzero(opens)
        times = np.add.reduceat(times, first)
        strings = held.column("bytes").take(pa.array(first)).to_pylist()
        ranges = repeated_windows(strings, times, length)
        found = [k for k, r in enumerate(ranges) if len(r)]
        offsets = np.cumsum([0, *(len(ranges[k]) for k in found)])
        values = np.concatenate([ranges[k] for k in found]) if found else np.zeros(0, dtype=np.int64)
        array = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(segment[first][found]), array], ["segment", "ranges"])

    counted = segments.filter("times > 0").select("anchor", "segment", "times", "bytes")
    dealt = counted.repartition("anchor").sortWithinPartitions("anchor", "segment")
    return dealt.mapInArrow(sort_groups, "segment bigint, ranges array<bigint>")


# --- documents -------------------------------------------------------------


def remove_repeated_strings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot_bytes: int = HOT_BYTES
) -> DataFrame:
    """Texts without the bytes that a string of ``length`` bytes covers which begins anywhere else as well.

    Texts count as UTF-8 bytes; strings lie within one text and are judged on the input, so all copies go, the first
    too. Strings of one text may overlap. Returns one row per row of ``docs``: the id, ``n_bytes``, ``spans`` (longest
    removed runs: begin, end exclusive) and ``kept`` (the bytes that are left, as BINARY, since a cut may fall within
    a character). A null or empty text has no bytes. Equal texts are told apart by nothing but their text, so null or
    repeated ids do no harm. Other columns are not read. Texts and segments are compared by 64-bit digests.
    """
    if length < 2:
        raise ValueError("length must be 2 or more")
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    segments = _avoiding_hot(named.filter(F.octet_length("text") >= length), length, hot_bytes)
    ranges = freeze(_repeats(segments, length), "suffix-ranges")
    places = segments.select("segment", "text_key", "place").join(ranges, "segment")
    gone = places.groupBy("text_key").agg(F.collect_set(F.struct("place", "ranges")).alias("gone"))

    def cut(batches):
        for batch in batches:
            for piece in pieces([batch], "text"):
                n_bytes, spans, kept = [], [], []
                for text, found in zip(piece.column("text").cast(pa.large_binary()), piece.column("gone")):
                    text = text.as_py() or b""
                    merged = _merged(found.as_py() or [], length)
                    parts = zip([0, *(e for _, e in merged)], [*(b for b, _ in merged), len(text)])
                    n_bytes.append(len(text))
                    spans.append([{"begin": b, "end": e} for b, e in merged])
                    kept.append(b"".join([text[b:e] for b, e in parts]))
                span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(n_bytes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
                    ["id", "n_bytes", "spans", "kept"],
                )

    joined = named.join(gone, "text_key", "left").select("id", "text", "gone")
    schema = f"id {kind}, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary"
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def _merged(found: list[dict], length: int) -> list[tuple[int, int]]:
    """Byte spans that the repeated windows cover; spans that touch are one."""
    covered = sorted((x["place"] + a, x["place"] + b + length - 1) for x in found for a, b in zip(x["ranges"][::2], x["ranges"][1::2]))
    spans: list[tuple[int, int]] = []
    for begin, end in covered:
        if spans and begin <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((begin, end))
    return spans

"""Similarity self-join of texts on their sets of word n-grams (vertical partitioning).

The global order of n-grams is the order of their 64-bit hashes; it is cut into
fragments, so each set falls into segments that lie in different fragments.

1. Candidates. At high thresholds they share a segment: linked sets differ in at most d n-grams (d follows from their
   sizes and the threshold), so when the order is cut into d + 1 fragments they
   agree on the whole segment of at least one. Sets are put into classes of
   sizes; two linked sets lie in the same class or in neighbouring ones, and
   each set sends one signature per fragment for its own class and the next.
   At lower thresholds they share one of their rarest n-grams: the order then
   begins with the n-grams of a single set, and each set sends those of its
   first n - ceil(t n) + 1 that are in others too.
2. Count. For a pair of candidates the overlap is counted separately in each
   fragment of a fixed cut and the partial counts are summed per pair.

Near copies come in groups of any size, so pairs are not all formed. In a group
with an equal segment each set is first compared with the best known centre of
its groups, then, where components differ, with the centre of each group. Only
sets that this leaves in different components are compared further, by a join on
the rarest n-grams of each (prefix filter in order of frequency), which loses no
link between different components. So the components are exact.

Equal sets are one set from the start (named by a 64-bit digest), and nothing
but segments of candidates is shuffled beside the signatures. Which signatures
repeat is carried to the second pass over the texts in a Bloom filter of at
most 32 MB; when it is too full it only lets more rows through.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom_filter, freeze, in_bloom, pieces
from .components import components
from .words import NOT_SPACE, mix, split_words

#: Fragments of the global order in which overlaps are counted.
COUNT_FRAGMENTS = 8

#: Thresholds from which candidates are found by equal segments; a lower one cuts segments too short to tell sets apart.
SEGMENTS_FROM = 0.85

#: Sets that a frequent n-gram is in, at least; these come last in the order.
FREQUENT = 16

_ROWS = "kind int, doc bigint, set_id bigint, n int, sig bigint, fragment int, grams array<bigint>"
_MEMBER, _SIGNATURE, _SEGMENT = 0, 1, 2


@dataclass(frozen=True)
class Threshold:
    """Links are pairs with ``over * intersection >= part * union``."""

    part: int = 90
    over: int = 100

    def difference(self, size: int) -> int:
        """Most n-grams in which two linked sets of at most ``size`` differ."""
        return (self.over - self.part) * 2 * size // (self.part + self.over)

    def classes(self, largest: int) -> np.ndarray:
        """Upper bounds of the size classes; linked sets are at most one class apart."""
        key = (self.part, self.over)
        bounds = _class_bounds.setdefault(key, np.ones(1, dtype=np.int64))
        if bounds[-1] < largest:
            grown = bounds.tolist()
            while grown[-1] < 2 * largest:
                grown.append(max(grown[-1] + 1, grown[-1] * self.over // self.part))
            bounds = _class_bounds[key] = np.array(grown, dtype=np.int64)
        return bounds


_class_bounds: dict[tuple[int, int], np.ndarray] = {}


def gram_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes (uint64) of its word n-grams."""
    words = split_words(texts, NOT_SPACE)
    hashes, bounds = words.hashes(), words.bounds()
    steps = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(hashes) - width + 1)
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        grams += hashes[k : k + n] * steps[k]
    grams = mix(grams)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            sets.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            short = (hashes[a:b] * steps[: b - a]).sum() + np.uint64(b - a)
            sets.append(mix(np.array([short], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def set_digest(grams: np.ndarray) -> int:
    """Name of a set, equal for equal sets only (but for a 64-bit collision)."""
    total = mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(grams))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def signatures(grams: np.ndarray, threshold: Threshold) -> np.ndarray:
    """One hash per fragment of a sorted set, for its size class and the next."""
    bounds = threshold.classes(2 * len(grams))
    own = int(np.searchsorted(bounds, len(grams)))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(grams ^ np.uint64(0x5A5A5A5A5A5A5A5A)))])
    found = []
    for c in (own, own + 1):
        fragments = threshold.difference(int(bounds[c])) + 1
        if fragments == 1:
            continue  # linked sets of this size are equal
        places = ((grams >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
        cut = np.searchsorted(places, np.arange(fragments + 1, dtype=np.uint64))
        where = np.uint64(c << 40) + np.arange(fragments, dtype=np.uint64)
        found.append(mix((sums[cut[1:]] - sums[cut[:-1]]) ^ mix(where)))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def _batch(kind, doc, set_id, n, sig, fragment, grams):
    size = len(kind)

    def ints(x, dtype):
        return pa.nulls(size, dtype) if x is None else pa.array(x, dtype)

    return pa.RecordBatch.from_arrays(
        [
            ints(kind, pa.int32()), ints(doc, pa.int64()), ints(set_id, pa.int64()), ints(n, pa.int32()),
            ints(sig, pa.int64()), ints(fragment, pa.int32()),
            pa.nulls(size, pa.list_(pa.int64())) if grams is None else grams,
        ],
        names=["kind", "doc", "set_id", "n", "sig", "fragment", "grams"],
    )


def _signature_rows(text: str, width: int, threshold: Threshold):
    """(sig, set_id) of every set, once per set and task."""

    def rows(batches):
        seen = set()
        for piece in pieces(batches, text):
            sigs, owners = [], []
            for grams in gram_sets(piece.column(text), width):
                name = set_digest(grams)
                if name not in seen and len(grams):
                    if len(seen) < 1_000_000:  # only saves rows; they are combined later
                        seen.add(name)
                    found = signatures(grams, threshold)
                    sigs.append(found)
                    owners.append(np.full(len(found), name, dtype=np.int64))
            if sigs:
                sig = np.concatenate(sigs).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.concatenate(owners))], ["sig", "set_id"])

    return rows


def _gram_rows(text: str, width: int):
    """Every n-gram of every set, once per set and task."""

    def rows(batches):
        seen = set()
        for piece in pieces(batches, text):
            found = []
            for grams in gram_sets(piece.column(text), width):
                name = set_digest(grams)
                if name not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(name)
                    found.append(grams)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["sig"])

    return rows


def rarest(grams: np.ndarray, filters: list[np.ndarray], threshold: Threshold) -> np.ndarray:
    """The n-grams of a set's prefix that other sets may have.

    The order is: n-grams in none of the filters, then those in the first, in the
    first two, ..., each by hash. Those in none occur in no other set.
    """
    rank = np.zeros(len(grams), dtype=np.int64)
    for filled in filters:
        rank += in_bloom(filled, grams)
    length = len(grams) + 1 + (-len(grams) * threshold.part) // threshold.over
    order = np.argsort(rank, kind="stable")[:length]
    return grams[order][rank[order] > 0]


def _set_rows(doc: str, text: str, digest: str, width: int, threshold: Threshold, repeated, by_segment: bool):
    """Membership of every text (with its digest as ``sig``), and signatures and segments of sets with a repeated signature."""

    def rows(batches):
        seen, filters = set(), repeated.value
        for piece in pieces(batches, text):
            ids, names, sizes, digests = [], [], [], piece.column(digest).to_numpy()
            for doc_id, grams in zip(piece.column(doc).to_pylist(), gram_sets(piece.column(text), width), strict=True):
                name = set_digest(grams)
                ids.append(doc_id)
                names.append(name)
                sizes.append(len(grams))
                if name in seen or not len(grams):
                    continue
                if by_segment:
                    sigs = signatures(grams, threshold)
                    sigs = sigs[in_bloom(filters[0], sigs)].view(np.int64)
                else:
                    sigs = rarest(grams, filters, threshold).view(np.int64)
                if not len(sigs):
                    continue
                if len(seen) < 1_000_000:
                    seen.add(name)
                k = len(sigs)
                yield _batch([_SIGNATURE] * k, None, [name] * k, [len(grams)] * k, sigs, None, None)
                cut = np.searchsorted(grams >> np.uint64(61), np.arange(COUNT_FRAGMENTS + 1, dtype=np.uint64))
                values = pa.array(grams.view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), values)
                f = COUNT_FRAGMENTS
                yield _batch([_SEGMENT] * f, None, [name] * f, [len(grams)] * f, None, range(f), lists)
            k = len(ids)
            yield _batch([_MEMBER] * k, ids, names, sizes, digests, None, None)

    return rows


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, shared) of the pairs (a, b) of sets: partial counts per fragment, summed per pair."""
    left = segments.select(F.col("set_id").alias("a"), "fragment", F.col("n").alias("n_a"), F.col("grams").alias("ga"))
    right = segments.select(F.col("set_id").alias("b"), "fragment", F.col("n").alias("n_b"), F.col("grams").alias("gb"))
    return (
        pairs.join(left, "a")
        .join(right, ["b", "fragment"])
        .select("a", "b", "n_a", "n_b", F.size(F.array_intersect("ga", "gb")).alias("part"))
        .groupBy("a", "b")
        .agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum("part").alias("shared"))
    )


def _linked(pairs, segments, threshold):
    shared = overlaps(pairs, segments)
    enough = F.expr(f"{threshold.over} * shared >= {threshold.part} * (n_a + n_b - shared)")
    return shared.filter(enough).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _near_sizes(n_a, n_b, threshold):
    return f"{threshold.over} * least({n_a}, {n_b}) >= {threshold.part} * greatest({n_a}, {n_b})"


def _famous(sigs: DataFrame) -> DataFrame:
    """Adds ``fame``: with how many members a set shares segments."""
    members = sigs.groupBy("sig").agg(F.count("*").alias("members"))
    fame = sigs.join(members, "sig").groupBy("set_id").agg(F.sum("members").alias("fame"))
    return sigs.join(fame, "set_id").select("sig", "set_id", "n", "fame", F.col("set_id").alias("component"))


def _centred(sigs: DataFrame) -> DataFrame:
    """Adds ``c``, the most famous member of the group."""
    centres = sigs.groupBy("sig").agg(F.max(F.struct("fame", "set_id", "n", "component")).alias("c"))
    return sigs.join(centres, "sig")


def _hub_pairs(sigs: DataFrame, threshold: Threshold) -> DataFrame:
    """Each set with the most famous centre of its groups: one pair a set, however many groups it is in."""
    hubs = _centred(sigs).groupBy("set_id", "n").agg(F.max("c").alias("c"))
    near = f"set_id != c.set_id AND {_near_sizes('n', 'c.n', threshold)}"
    return hubs.filter(near).select(F.col("set_id").alias("a"), F.col("c.set_id").alias("b"))


def _star(sigs: DataFrame, threshold: Threshold) -> tuple[DataFrame, DataFrame]:
    """Pairs of each member of a group with its most famous member, and the groups without these."""
    centred = _centred(sigs).filter("set_id != c.set_id")
    near = f"component != c.component AND {_near_sizes('n', 'c.n', threshold)}"
    pairs = centred.filter(near).select(F.col("set_id").alias("a"), F.col("c.set_id").alias("b")).distinct()
    return pairs, centred.select(*sigs.columns)


def _still_open(sigs: DataFrame, found: DataFrame) -> DataFrame:
    """Members of groups that lie in several components, with their components."""
    named = sigs.join(found, sigs["set_id"] == found["node"], "left").select(
        "sig", "set_id", "n", "fame", F.coalesce(found["component"], "set_id").alias("component")
    )
    several = named.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    return named.join(several.select("sig"), "sig", "left_semi")


def _open_pairs(sigs: DataFrame, segments: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs of different components that may be linked: they share one of their rarest n-grams."""
    open_sets = sigs.select("set_id", "component").distinct()
    grams = freeze(
        segments.join(open_sets, "set_id").select("set_id", "component", "n", F.explode("grams").alias("gram")),
        "open-grams",
    )
    several = F.expr("lo < hi")
    counts = grams.groupBy("gram").agg(
        F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    # A set keeps its n - ceil(t n) + 1 rarest n-grams; those of one set or one component make no pair.
    # No pair shares more than what follows the first n-gram that both have.
    rarest = Window.partitionBy("set_id").orderBy("df", "gram")
    kept = f"place <= n - ceil(n * {threshold.part} / {threshold.over}) + 1"
    prefix = (
        grams.join(counts, "gram")
        .withColumn("place", F.row_number().over(rarest))
        .filter(kept)
        .filter(several)
        .select("gram", "set_id", "component", "n", "place")
    )
    other = prefix.select(
        "gram",
        F.col("set_id").alias("b"),
        F.col("component").alias("component_b"),
        F.col("n").alias("n_b"),
        F.col("place").alias("place_b"),
    )
    enough = f"{threshold.over + threshold.part} * (1 + least(n - place, n_b - place_b)) >= {threshold.part} * (n + n_b)"
    near = F.expr(f"component < component_b AND {enough} AND {_near_sizes('n', 'n_b', threshold)}")
    return prefix.join(other, "gram").filter(near).select(F.col("set_id").alias("a"), "b").distinct()


def jaccard_components(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    width: int = 5,
    threshold: Threshold = Threshold(80),  # noqa: B008
    by_segment: bool | None = None,
) -> DataFrame:
    """(doc, n_shingles, component_id, digest, kept) of every row of ``docs``.

    Words are runs of other bytes than space and 0x09-0x0D after lower-casing
    A-Z; a set holds the distinct runs of ``width`` words, with fewer words the
    whole text. ``component_id`` is the smallest id that links reach. Texts that
    are null or have no words have the empty set and only their own id; equal
    rows and equal texts share a component; a null id keeps its row (it names a
    component only when no row of it has an id). ``digest`` is xxhash64 of the text;
    ``kept`` marks one (id, text) of each component, the one of the smallest id
    (null last), then digest, and all texts without words. Other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc).cast("bigint").alias("_doc"), F.col(text).alias("_text"), F.xxhash64(text).alias("_digest"))
    if by_segment is None:
        by_segment = threshold.part >= SEGMENTS_FROM * threshold.over
    texts = source.select("_text")
    if by_segment:
        sig_rows = texts.mapInArrow(_signature_rows("_text", width, threshold), "sig bigint, set_id bigint").groupBy("sig")
        several = sig_rows.agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).filter("lo < hi").select("sig")
    else:
        gram_rows = texts.mapInArrow(_gram_rows("_text", width), "sig bigint").groupBy("sig")
        several = gram_rows.agg(F.count("*").alias("n")).filter("n > 1")
    repeated = freeze(several, "repeated")
    filters = [bloom_filter(repeated, "sig")]
    if not by_segment:
        filters.append(bloom_filter(repeated.filter(F.col("n") > FREQUENT), "sig", 24))
    filled = spark.sparkContext.broadcast(filters)
    rows = freeze(source.mapInArrow(_set_rows("_doc", "_text", "_digest", width, threshold, filled, by_segment), _ROWS), "gram-sets")
    members = rows.filter(F.col("kind") == _MEMBER).select("doc", F.col("sig").alias("digest"), "set_id", "n")
    segments = rows.filter(F.col("kind") == _SEGMENT).select("set_id", "fragment", "n", "grams")
    sigs = freeze(
        rows.filter(F.col("kind") == _SIGNATURE).select("sig", "set_id", "n").distinct().join(repeated.select("sig"), "sig", "left_semi"),
        "shared-segments",
    )
    segments = segments.join(sigs.select("set_id").distinct(), "set_id", "left_semi").dropDuplicates(["set_id", "fragment"])
    segments = freeze(segments, "segments")

    open_sigs = freeze(_famous(sigs), "famous")
    hub_links = freeze(_linked(_hub_pairs(open_sigs, threshold), segments, threshold), "hub-links")
    open_sigs = freeze(_still_open(open_sigs, components(hub_links)), "open-groups")
    pairs, rest = _star(open_sigs, threshold)
    links = freeze(hub_links.union(_linked(pairs, segments, threshold)), "star-links")
    open_sigs = freeze(_still_open(rest, components(links)), "open-groups")
    found = components(links.union(_linked(_open_pairs(open_sigs, segments, threshold), segments, threshold)))

    named = members.join(found, members["set_id"] == found["node"], "left").select(
        "doc", "digest", "n", F.coalesce("component", "set_id").alias("component")
    )
    row = F.struct(F.col("doc").isNull(), "doc", "digest")
    firsts = named.filter("n > 0").groupBy("component").agg(F.min("doc").alias("first"), F.min(row).alias("first_row"))
    smallest = freeze(firsts, "first-documents")
    return named.join(smallest, "component", "left").select(
        F.col("doc").alias(doc),
        F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc")).alias("component_id"),
        "digest",
        ((F.col("n") == 0) | (row == F.col("first_row"))).alias("kept"),
    )

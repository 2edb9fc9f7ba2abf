"""Removal of line runs that repeat across a corpus, with DataFrame functions only.

A corpus is the sequence of its line ids, document after document. Lines that
occur once end every repeat, so only the runs of repeated lines between them are
kept. Over these a suffix array is built by prefix doubling: ranks of blocks of
2^k lines order the suffixes by their first 2^k lines, and the pair of ranks at
p and p + 2^k, sorted by range and numbered in order, gives the ranks of twice
the length. Suffixes with an equal block are an LCP interval of the array; the
interval of any other depth n is named by the two blocks of 2^k <= n lines that
cover the depth. In each interval of at least ``min_words`` words the place that
comes first stays and the run at every later place is deleted.

Ranks are needed only up to the longest run that holds just ``min_words`` words:
a longer repeat is the union of these runs, grown forwards from each line and
backwards from each line, so the doubling takes log2(min_words) rounds at most.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freeze

KEY = ["doc", "digest"]
RUN = [*KEY, "run"]


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, where null equals null (a document may have no id)."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda on, k: on & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.lit(True))
    return left.join(named, same).drop(*[f"_{k}" for k in keys])


def _lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, digest, row, line): the lines with words of each text, numbered with blank lines included."""
    cut = docs.filter(F.col(text).isNotNull()).select(
        F.col(doc).alias("doc"), F.xxhash64(text).alias("digest"), F.posexplode(F.split(text, "\n")).alias("row", "line")
    )
    return cut.withColumn("line", F.btrim("line", F.lit(" \t\r\f\v"))).filter("line != ''")


def _runs(docs: DataFrame, doc: str, text: str, min_words: int) -> DataFrame:
    """Lines that occur more than once, in unbroken runs of at least ``min_words`` words.

    ``before`` and ``upto`` count the words of the run before and up to the end of the line.
    """
    lines = _lines(docs, doc, text).select(
        *KEY, "row", F.xxhash64("line").alias("id"), F.size(F.split("line", r"[\x20\x09-\x0D]+")).alias("w")
    )
    place = F.struct(*KEY, "row")
    # Written first, so that the join below can split a line that is everywhere.
    repeated = freeze(
        lines.groupBy("id").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo < hi").select("id"),
        "repeated-lines",
    )
    inside = Window.partitionBy(*KEY).orderBy("row")
    marked = (
        lines.join(repeated.select("id", F.lit(True).alias("again")), "id", "left")
        .repartition(*KEY)
        .dropDuplicates([*KEY, "row"])
        .withColumn("run", F.count(F.when(F.col("again").isNull(), 1)).over(inside))
        .filter("again")
        .drop("again")
    )
    so_far = Window.partitionBy(*RUN).orderBy("row")
    return (
        marked.withColumn("pos", F.row_number().over(so_far))
        .withColumn("upto", F.sum("w").over(so_far))
        .withColumn("total", F.sum("w").over(Window.partitionBy(*RUN)))
        .filter(F.col("total") >= min_words)
        .select(*RUN, "pos", "row", F.col("id").alias("rank_0"), (F.col("upto") - F.col("w")).alias("before"), "upto")
    )


def _grown(runs: DataFrame, min_words: int) -> DataFrame:
    """(run, start, stop): from each line the shortest run with enough words, forwards and backwards."""

    def events(key, line, asks):
        return runs.select(*RUN, key.alias("at"), "pos", F.lit(line).alias("is_line"), F.lit(asks).alias("asks"))

    def nearest(lines, asking, order):
        seen = Window.partitionBy(*RUN).orderBy(order, F.desc("is_line")).rowsBetween(Window.unboundedPreceding, 0)
        return (
            lines.union(asking)
            .withColumn("found", F.last(F.when(F.col("is_line"), F.col("pos")), ignorenulls=True).over(seen))
            .filter("asks AND found IS NOT NULL")
        )

    upto, before = F.col("upto"), F.col("before")
    ahead = nearest(events(upto, True, False), events(before + min_words, False, True), F.desc("at"))
    back = nearest(events(before, True, False), events(upto - min_words, False, True), F.asc("at"))
    return (
        ahead.select(*RUN, F.col("pos").alias("start"), F.col("found").alias("stop"))
        .union(back.select(*RUN, F.col("found").alias("start"), F.col("pos").alias("stop")))
        .distinct()
    )


def _ranked(runs: DataFrame, longest: int) -> tuple[DataFrame, int]:
    """Adds ``rank_k``, the rank of the suffix at each line by its first 2^k lines, while 2^k <= longest."""
    k = 0
    while 2 << k <= longest:
        follow = F.lead(f"rank_{k}", 1 << k).over(Window.partitionBy(*RUN).orderBy("pos"))
        paired = runs.withColumn("next", F.coalesce(follow, F.lit(-(1 << 63))))
        # Ids that rise along range partitions and inside them number the sorted pairs in order.
        order = freeze(
            paired.select(F.col(f"rank_{k}").alias("first"), "next")
            .distinct()
            .repartitionByRange("first", "next")
            .sortWithinPartitions("first", "next")
            .withColumn(f"rank_{k + 1}", F.monotonically_increasing_id()),
            "pair-ranks",
        )
        same = (paired[f"rank_{k}"] == order["first"]) & (paired["next"] == order["next"])
        runs = freeze(paired.join(order, same).drop("first", "next"), "suffix-ranks")
        k += 1
    return runs, k


def repeated_runs(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = 30) -> DataFrame:
    """(doc, digest, start, stop): line numbers (from 0) of runs that occur at an earlier place of the corpus.

    Places are ordered by id (null first), text and line. Lines are compared
    without space around them; blank lines belong to no run and do not end one.
    """
    runs = freeze(_runs(docs, doc, text, min_words), "line-runs")
    grown = freeze(_grown(runs, min_words), "grown-runs")
    longest = grown.agg(F.max(F.expr("stop - start + 1"))).first()[0] or 1
    runs, top = _ranked(runs, longest)
    level = reduce(lambda e, k: F.when(F.col("n") >= 1 << k, k).otherwise(e), range(1, top + 1), F.lit(0))
    sized = grown.withColumn("n", F.expr("stop - start + 1")).withColumn("level", level)
    sized = sized.withColumn("second", F.expr("stop - shiftleft(1, level) + 1"))
    ranks = F.array(*[f"rank_{k}" for k in range(top + 1)])
    heads = runs.select(*RUN, F.col("pos").alias("start"), ranks.alias("head"), F.col("row").alias("first_row"))
    tails = runs.select(*RUN, F.col("pos").alias("second"), ranks.alias("tail"))
    ends = runs.select(*RUN, F.col("pos").alias("stop"), F.col("row").alias("last_row"))
    place = F.struct(*KEY, "first_row")
    marked = _joined(_joined(sized, heads, [*RUN, "start"]), tails, [*RUN, "second"])
    intervals = freeze(
        _joined(marked, ends, [*RUN, "stop"]).select(
            "n", F.expr("head[level]").alias("head"), F.expr("tail[level]").alias("tail"), place.alias("place"), "last_row"
        ),
        "lcp-intervals",
    )
    firsts = intervals.groupBy("n", "head", "tail").agg(F.min("place").alias("earliest"), F.count("*").alias("members"))
    later = intervals.join(firsts.filter("members > 1"), ["n", "head", "tail"]).filter("place > earliest")
    return later.select("place.doc", "place.digest", F.col("place.first_row").alias("start"), F.col("last_row").alias("stop"))


def deduplicate_lines(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = 30, drop_empty: bool = False
) -> DataFrame:
    """``docs`` without the later copies of repeated line runs; adds n_lines and n_removed.

    All columns stay (columns of these two names are replaced). Lines inside a
    deleted run go, blank ones between them too. A null text stays null with 0
    lines, an empty one has one line. Rows that repeat both id and text are one
    document stored twice and are treated alike. ``drop_empty`` also drops
    documents of which nothing but white space is left after a removal.
    """
    found = (
        repeated_runs(docs, doc, text, min_words)
        .groupBy("doc", "digest")
        .agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
        .select(
            F.col("doc").alias("_doc"),
            F.col("digest").alias("_digest"),
            F.expr("array_distinct(flatten(transform(runs, r -> sequence(r.start, r.stop))))").alias("_gone"),
        )
    )
    # The columns of ``docs`` may have any names, so they travel as one.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    body = F.col("_row")[text]
    same = F.col("_row")[doc].eqNullSafe(F.col("_doc")) & (F.xxhash64(body) == F.col("_digest"))
    joined = rows.join(found, same, "left").withColumn("_lines", F.split(body, "\n"))
    rest = F.expr(
        "array_join(transform(array_except(sequence(0, size(_lines) - 1), _gone), i -> _lines[i]), '\n')"
    )
    cleaned = joined.withColumn("_rest", F.when(F.col("_gone").isNull(), body).otherwise(rest))
    if drop_empty:
        cleaned = cleaned.filter(F.col("_gone").isNull() | (F.btrim("_rest", F.lit(" \t\r\n\f\v")) != ""))
    added = {"n_lines": F.when(body.isNotNull(), F.size("_lines")), "n_removed": F.size("_gone")}
    kept = [c for c in docs.columns if c not in added]
    return cleaned.select(
        *[F.col("_rest").alias(c) if c == text else F.col("_row")[c].alias(c) for c in kept],
        *[F.coalesce(n, F.lit(0)).cast("bigint").alias(c) for c, n in added.items()],
    )

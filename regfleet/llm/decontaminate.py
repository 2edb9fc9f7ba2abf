"""Benchmark passages in training texts, with DataFrame functions only.

The benchmark's word windows are a broadcast hash table. Every window of every
document is hashed at its place and looked up while the text is scanned, hits
are verified word by word, and what is found (little) is grouped per document.
The words of a document never leave the task that scans them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, freeze

#: Words are runs of digits, letters and characters beyond ASCII.
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Most windows in one broadcast table (some 150 bytes each); a larger benchmark is scanned for in several passes.
BROADCAST_WINDOWS = 250_000


def words(text: Column) -> Column:
    """Folded words of a text; none for null."""
    return F.coalesce(F.array_remove(F.split(fold_ascii(text), _NO_WORD), ""), F.array().cast("array<string>"))


def _hash(array: str, place: str, width: int) -> str:
    return f"xxhash64({', '.join(f'get({array}, {place} + {k})' for k in range(width))})"


def benchmark_windows(items: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """(gram, len, item): the windows of each item; a shorter item is one window."""
    cut = items.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).filter("size(w) > 0")
    starts = F.explode(F.expr(f"sequence(0, greatest(size(w) - {width}, 0))")).alias("at")
    return cut.select("item", "w", starts).select(
        "item", F.expr(f"slice(w, at + 1, {width})").alias("gram"), F.expr(f"least(size(w), {width})").alias("len")
    )


def _scan(docs: DataFrame, windows: DataFrame, lengths: list[int], first_pass: bool) -> DataFrame:
    """Hits (at, len, gram_id) of each document, and in the first pass a row with ``at = -1`` for each."""
    base = "-1" if first_pass else "0"
    places = docs.select("doc", "digest", "w", F.explode(F.expr(f"sequence({base}, size(w) - {min(lengths)})")).alias("at"))
    places = places if first_pass else places.filter("at >= 0")
    fits = [f"CASE WHEN at >= 0 AND at + {n} <= size(w) THEN {_hash('w', 'at', n)} END" for n in lengths]
    if len(lengths) == 1:
        hashed = places.withColumns({"len": F.lit(lengths[0]), "hash": F.expr(fits[0])})
    else:
        both = ", ".join(f"struct({n} AS len, {e} AS hash)" for n, e in zip(lengths, fits, strict=True))
        hashed = places.select("*", F.expr(f"inline(array({both}))")).filter(f"at >= 0 OR len = {lengths[0]}")
    table = windows.select("gram", F.col("gram_hash").alias("hash"), F.col("len").alias("window_len"), "gram_id")
    joined = hashed.join(F.broadcast(table), "hash", "left")
    hit = joined.filter("at = -1 OR (window_len = len AND slice(w, at + 1, len) = gram)")
    return hit.select(
        "doc", "digest",
        F.expr("CASE WHEN at = -1 THEN size(w) END").alias("n"),
        F.expr("CASE WHEN at >= 0 THEN struct(at, len) END").alias("hit"),
        "gram_id",
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    max_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per document: doc, digest, n_words, hit_words (places of words inside a window), items.

    A null or empty text has no words, so no hits. Rows that repeat both id and
    text give as many equal rows. Items without words are ignored; an item with
    a null id makes hits but is not listed. Other columns are ignored.
    """
    windows = benchmark_windows(items, item, item_text, width)
    grams = freeze(
        windows.groupBy("gram", "len").agg(F.collect_set("item").alias("items"))
        .withColumn("gram_id", F.monotonically_increasing_id()),
        "benchmark-windows",
    )
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most ``width`` values
    hashes = {n: _hash("gram", "0", n) for n in lengths}
    choose = " ".join(f"WHEN {n} THEN {h}" for n, h in hashes.items())
    grams = grams.withColumn("gram_hash", F.expr(f"CASE len {choose} END") if lengths else F.lit(None).cast("bigint"))
    cut = docs.select(
        F.col(doc).alias("doc"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("digest"), words(F.col(text)).alias("w")
    )
    if not lengths:
        hits = cut.select("doc", "digest", F.size("w").alias("n"), F.expr("CAST(NULL AS STRUCT<at: INT, len: INT>)").alias("hit"),
                          F.lit(None).cast("bigint").alias("gram_id"))
    else:
        passes = -(-grams.count() // max_windows)
        hits = None
        for k in range(passes):
            part = grams if passes == 1 else grams.filter(F.pmod("gram_hash", F.lit(passes)) == k)
            scan = _scan(cut, part, lengths, k == 0)
            hits = scan if hits is None else hits.union(scan)
    found = freeze(
        hits.groupBy("doc", "digest").agg(
            F.max("n").alias("n_words"),
            F.count("n").cast("int").alias("rows"),
            F.collect_set("hit").alias("hits"),
            F.collect_set("gram_id").alias("gram_ids"),
        ),
        "hits",
    )
    ids = (
        found.select("doc", "digest", F.explode("gram_ids").alias("gram_id"))
        .join(grams.select("gram_id", "items"), "gram_id")
        .select("doc", "digest", F.explode("items").alias("item"))
        .groupBy("doc", "digest")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(F.col("doc").alias("hit_doc"), F.col("digest").alias("hit_digest"), "items")
    )
    places = F.expr("array_distinct(flatten(transform(hits, h -> sequence(h.at, h.at + h.len - 1))))")
    same = F.col("doc").eqNullSafe(F.col("hit_doc")) & (F.col("digest") == F.col("hit_digest"))
    return (
        found.join(ids, same, "left")
        .select(
            F.col("doc").alias(doc),
            "digest",
            F.col("n_words").cast("bigint").alias("n_words"),
            places.alias("hit_words"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.explode(F.expr("sequence(1, rows)")).alias("_copy"),
        )
        .drop("_copy")
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", remove: str = "documents", **options
) -> DataFrame:
    """``docs`` without contaminated rows (remove="documents") or without the words hit (remove="spans").

    All columns stay. With spans, the words inside benchmark windows are cut out
    of the text and what stands between words stays.
    """
    found = contamination(docs, items, doc, text, **options).filter("size(hit_words) > 0")
    keys = found.select(F.col(doc).alias("_doc"), F.col("digest").alias("_digest"), "hit_words").dropDuplicates(
        ["_doc", "_digest"]
    )
    # The columns of ``docs`` may have any names, so they travel as one.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    body = F.col("_row")[text]
    same = F.col("_row")[doc].eqNullSafe(F.col("_doc")) & (F.coalesce(F.xxhash64(body), F.lit(0)) == F.col("_digest"))
    if remove == "documents":
        return rows.join(keys, same, "left_anti").select("_row.*")
    raw = F.regexp_extract_all(body, F.lit(_RAW_WORD), F.lit(0))
    cut = rows.join(keys, same, "left").withColumns({"_raw": raw, "_gaps": F.split(body, _RAW_WORD)})
    rest = F.expr(
        "concat(_gaps[0], array_join(transform(_raw, (x, i) ->"
        " concat(IF(array_contains(hit_words, i), '', x), _gaps[i + 1])), ''))"
    )
    cleaned = F.when(F.col("hit_words").isNull(), body).otherwise(rest).alias(text)
    return cut.select(*[cleaned if c == text else F.col("_row")[c].alias(c) for c in docs.columns])

"""Unique tags: every untagged row gets the first free of base, base_1, base_2, ...

Rows are served in line order, and a tag is taken by any earlier row of the map,
tagged or served. The rows asking for one base (its *requests*) are ranked with an
ordered scan; request ``i`` gets number ``i - 1`` unless numbers were skipped.
A number is skipped when some other text claimed it before the requests reached
it: a tag typed in a row, or another base that spells the same (``a_1``).

Only these *claims* need care. With ``y`` requests before the claim of number
``n`` and ``s`` smaller numbers skipped, the claim wins exactly when
``s <= n - y``. So a claim is lost from some ``s`` on, its *threshold*: seen from
the claim itself that is ``n - y + 1``. Blocks of 128 claims, sorted by number, are
worked out at once; then neighbouring blocks are joined round by round, and the
thresholds of the right block are moved back to the start of the left one. After
log2(blocks) rounds all are seen from the start of the base, where ``s`` is 0, or 1 if its bare text is taken.
That again hangs on the claim which the bare text makes on a shorter base, at
most on one other bit, so it is followed by pointer jumping. No group is ever
collected.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfleet.operators.lookup import salted_lookup
from regfleet.operators.ordering import ordered_scan
from regfleet.session import freeze

_KEYS = ["map_id", "base"]

#: Neighbouring claims that one row holds while their thresholds are worked out.
BLOCK = 128

def _requests(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("tag") == "") & (F.col("name") != ""))


def _first_uses(rows: DataFrame) -> DataFrame:
    """First typed and first requested line of every tag text of a map."""
    typed = rows.filter(F.col("tag") != "").select(
        "map_id", F.col("tag").alias("text"), F.col("line_num").alias("typed"), F.lit(None).cast("bigint").alias("asked")
    )
    asked = _requests(rows).select(
        "map_id", F.col("base").alias("text"), F.lit(None).cast("bigint").alias("typed"), F.col("line_num").alias("asked")
    )
    return typed.unionByName(asked).groupBy("map_id", "text").agg(
        F.min("typed").alias("typed"), F.min("asked").alias("asked"), F.count("typed").alias("times")
    )


def _numbered_texts(uses: DataFrame) -> DataFrame:
    """Texts that spell ``base_n``: what they may claim, from which line on."""
    number = F.substring_index("text", "_", -1)
    base = F.left("text", F.length("text") - F.length(number) - 1)
    return uses.filter(F.col("text").contains("_") & number.rlike("^[1-9][0-9]{0,17}$")).select(
        "map_id",
        "text",
        base.alias("base"),
        number.cast("bigint").alias("n"),
        F.least("typed", "asked").alias("line_num"),
        F.coalesce(F.col("asked") <= F.least("typed", "asked"), F.lit(False)).alias("by_request"),
    )


def _claimed_bases(uses: DataFrame) -> DataFrame:
    """Requested bases that some numbered text claims; one row per base on both sides."""
    bases = uses.filter(F.col("asked").isNotNull()).select("map_id", F.col("text").alias("base"))
    return _numbered_texts(uses).select(*_KEYS).distinct().join(bases, _KEYS, "left_semi")


def _numbered_claims(uses: DataFrame, claimed: DataFrame) -> DataFrame:
    looked_up = salted_lookup(_numbered_texts(uses), claimed.withColumn("_claimed", F.lit(True)), _KEYS, "n")
    return looked_up.filter("_claimed").drop("_claimed")


def _typed_bare(uses: DataFrame) -> DataFrame:
    """Bases whose bare text was typed in before they were first requested."""
    return uses.filter(F.col("typed") < F.col("asked")).select("map_id", F.col("text").alias("base"))


def _claims(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """Numbered claims with their place among those of their base and their threshold ``p``."""
    marks = _requests(rows).select(
        *_KEYS, "line_num", F.lit(None).cast("bigint").alias("n"), F.lit("").alias("text"),
        F.lit(False).alias("by_request"),
    )
    asked = F.col("n").isNull()
    before = ordered_scan(marks.unionByName(numbered), _KEYS, "line_num", counts={"y": asked}).filter(~asked)
    alone = before.select(*_KEYS, "n", "text", "by_request", (F.col("n") - F.col("y") + 1).alias("p"))
    return ordered_scan(freeze(alone, "tag-claims"), _KEYS, "n", counts={"place": F.lit(True)}, sparse=True)


def _joined_blocks(claims: DataFrame, size: int) -> DataFrame:
    """Thresholds of every second block of ``size`` claims, seen from the block before.

    A left block turns ``s`` into ``s + size`` less the number of its thresholds up to ``s``. That reaches a right
    threshold ``q`` first at ``s = t + #{k: p_k - k <= t}`` with ``t = q - size``, where ``p_0 < p_1 < ...`` are the
    left thresholds.
    """
    block = F.expr(f"(place - 1) div {size}")
    cut = claims.withColumns({"_pair": F.expr(f"(place - 1) div {2 * size}"), "_right": block % 2 == 1})
    keys = [*_KEYS, "_pair"]
    left, right = cut.filter(~F.col("_right")), cut.filter("_right").withColumn("_at", F.col("p") - size)
    ranked = ordered_scan(left, keys, "p", counts={"_k": F.lit(True)}, sparse=True)
    steps = ranked.groupBy(*keys, (F.col("p") - F.col("_k") + 1).alias("_at")).agg(F.count("*").alias("_passed"))
    both = right.unionByName(steps, allowMissingColumns=True)
    moved = ordered_scan(
        both, keys, "_at", sums={"_less": F.coalesce("_passed", F.lit(0))}, ties=[F.col("_passed").isNull()], sparse=True
    ).filter("_right")
    shifted = moved.withColumn("p", F.col("_at") + F.col("_less"))
    return left.select(claims.columns).unionByName(shifted.select(claims.columns))


def _inside_blocks(claims: DataFrame) -> DataFrame:
    """Thresholds seen from the start of each block of ``BLOCK`` claims, one claim after the other."""
    # acc.seen is sorted; the threshold of the next claim follows from it as in _joined_blocks.
    earlier = "c.p - size(acc.seen)"
    moved = f"{earlier} + size(filter(acc.seen, (x, k) -> x - k <= {earlier}))"
    fold = f"""
      aggregate(block,
        struct(CAST(array() AS ARRAY<BIGINT>) AS seen, filter(block, c -> false) AS done),
        (acc, c) -> struct(
          array_sort(array_append(acc.seen, {moved})) AS seen,
          array_append(acc.done, named_struct('place', c.place, 'n', c.n, 'text', c.text, 'by_request', c.by_request, 'p', {moved})) AS done),
        acc -> acc.done)"""
    block = F.array_sort(F.collect_list(F.struct("place", "n", "text", "by_request", "p")))
    return (
        claims.groupBy(*_KEYS, F.expr(f"(place - 1) div {BLOCK}").alias("_block"))
        .agg(block.alias("block"))
        .select(*_KEYS, F.expr(f"inline({fold})"))
    )


def _thresholds(claims: DataFrame) -> DataFrame:
    """All claims with ``p`` seen from the start of their base."""
    claims = freeze(_inside_blocks(claims), "tag-thresholds")
    longest = claims.agg(F.max("place")).first()[0] or 0
    size = BLOCK
    while size < longest:
        claims = freeze(_joined_blocks(claims, size), "tag-thresholds")
        size *= 2
    return claims


def _starts(claims: DataFrame, typed: DataFrame) -> DataFrame:
    """(map, base, start): 1 where the bare text is taken before the base is first requested; other bases start at 0.

    A bare text that a request claims from a shorter base is taken if that claim is lost: from threshold 0 down always,
    from 2 up never, at 1 if the shorter base itself starts at 1.
    """
    given = typed.withColumns({"start": F.lit(1), "parent": F.lit(None).cast("string")})
    spelled = claims.filter("by_request").select(
        "map_id",
        F.col("text").alias("base"),
        F.when(F.col("p") <= 0, 1).when(F.col("p") > 1, 0).alias("start"),
        F.when(F.col("p") == 1, F.col("base")).alias("parent"),
    )
    starts = freeze(given.unionByName(spelled), "tag-starts")
    while not starts.filter("start IS NULL").isEmpty():
        above = starts.select("map_id", F.col("base").alias("parent"), F.col("start").alias("_start"), F.col("parent").alias("_parent"))
        open_ = starts.filter("start IS NULL").drop("start").join(above, ["map_id", "parent"], "left")
        start = F.when(F.col("_parent").isNull(), F.coalesce("_start", F.lit(0)))
        jumped = open_.select("map_id", "base", start.alias("start"), F.col("_parent").alias("parent"))
        starts = freeze(starts.filter("start IS NOT NULL").unionByName(jumped), "tag-starts")
    return starts.select(*_KEYS, "start")


def _won(claims: DataFrame, starts: DataFrame) -> DataFrame:
    """Claims with their thresholds and ``won``: whether the text was taken before the requests reached its number."""
    started = salted_lookup(claims, starts, _KEYS, "n").fillna(0, ["start"])
    return started.withColumn("won", F.col("p") > F.col("start"))


def _settle(claims: DataFrame, typed: DataFrame) -> DataFrame:
    """Skipped numbers as (map, base, request rank from which they count, how many)."""
    claims = _thresholds(claims)
    starts = _starts(claims, typed)
    won = _won(claims, starts).filter("won").select(*_KEYS, "n")
    taken = starts.filter("start = 1").select(*_KEYS, F.lit(0).cast("bigint").alias("n"))
    skipped = freeze(won.unionByName(taken), "tag-skipped")
    exact = ordered_scan(skipped, _KEYS, "n", counts={"s": F.lit(True)}, sparse=True)
    return (
        exact.withColumn("rank", F.col("n") - (F.col("s") - 1) + 1)
        .groupBy(*_KEYS, "rank")
        .agg(F.count("*").alias("skips"))
    )


def _tagged(requests: DataFrame, number) -> DataFrame:
    text = F.when(number == 0, F.col("base")).otherwise(F.concat_ws("_", "base", number.cast("string")))
    return requests.withColumn("tag", text)


def allocate_tags(rows: DataFrame) -> DataFrame:
    """Fill ``tag`` for the surviving rows of every map; typed tags are kept.

    ``rows`` (with ``base``, the tag text of the name) is read several times and
    should be a stored table. Whether any base has claims at all is decided by a
    job, so that fleets without them get the one-scan plan.
    """
    columns = [c for c in rows.columns if c != "base"]
    given = rows.filter((F.col("tag") != "") | (F.col("name") == "")).select(columns)
    requests = _requests(rows)
    uses = freeze(_first_uses(rows), "tag-texts")
    claimed = freeze(_claimed_bases(uses), "tag-bases")

    typed = _typed_bare(uses)
    if claimed.isEmpty() and typed.isEmpty():
        ranked = ordered_scan(requests, _KEYS, "line_num", counts={"rank": F.lit(True)})
        return given.unionByName(_tagged(ranked, F.col("rank") - 1).select(columns))

    numbered = freeze(_numbered_claims(uses, claimed), "tag-claims")
    skips = freeze(_settle(_claims(rows, numbered), typed), "tag-skips")
    # A marker before line 1 tells every request whether its base has skips.
    markers = skips.select(*_KEYS).distinct().withColumn("line_num", F.lit(0).cast("bigint"))
    ranked = ordered_scan(
        requests.withColumn("is_request", F.lit(True)).unionByName(markers, allowMissingColumns=True),
        _KEYS,
        "line_num",
        counts={"rank": F.col("is_request"), "marked": F.col("is_request").isNull()},
    ).filter(F.col("is_request"))
    plain = ranked.filter(F.col("marked") == 0)
    shifted = ordered_scan(
        ranked.filter(F.col("marked") > 0).unionByName(skips, allowMissingColumns=True),
        _KEYS,
        "rank",
        sums={"shift": F.coalesce("skips", F.lit(0))},
        ties=[F.col("skips").isNull()],
    ).filter(F.col("is_request"))
    return (
        given.unionByName(_tagged(plain, F.col("rank") - 1).select(columns))
        .unionByName(_tagged(shifted, F.col("rank") - 1 + F.col("shift")).select(columns))
    )


def tag_repeats(rows: DataFrame) -> DataFrame:
    """Per map and text how many rows of ``allocate_tags`` have a tag that an earlier line has, worked out without the tags.

    A request gets a tag that no earlier line has, so only typed ones repeat: all but the first of a text, and the
    first as well if the text was requested before (that request has it or found it taken), or if its claim of a
    number is lost, as then a request has it.
    """
    uses = freeze(_first_uses(rows), "tag-texts")
    claimed = freeze(_claimed_bases(uses), "tag-bases")
    requested = F.when(F.col("asked") < F.col("typed"), 1).otherwise(0)
    repeated = uses.filter("typed IS NOT NULL").select("map_id", (F.col("times") - 1 + requested).alias("n"))
    if not claimed.isEmpty():
        numbered = freeze(_numbered_claims(uses, claimed), "tag-claims")
        claims = _thresholds(_claims(rows, numbered))
        lost = _won(claims, _starts(claims, _typed_bare(uses))).filter(~F.col("won") & ~F.col("by_request"))
        repeated = repeated.unionByName(lost.select("map_id", F.lit(1).cast("bigint").alias("n")))
    return repeated.filter(F.col("n") > 0)

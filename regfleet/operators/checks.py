"""Findings about a map: repeated names and tags, overlapping registers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regfleet import functions as R
from regfleet.operators.lookup import salted_lookup
from regfleet.operators.ordering import ordered_scan
from regfleet.session import freeze


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose non-empty ``column`` was used on an earlier line, with that first line.

    First lines are combined before their shuffle and only texts that repeat are
    joined back, so a text that fills a map is never gathered for them.
    """
    used = rows.filter(F.col(column) != "")
    first = (
        used.groupBy("map_id", column)
        .agg(F.min("line_num").alias("ref_line"), F.count("*").alias("_uses"))
        .filter(F.col("_uses") > 1)
        .drop("_uses")
    )
    repeated = used.join(first, ["map_id", column]).filter(F.col("line_num") > F.col("ref_line"))
    return repeated.select(*rows.columns, "ref_line")


def repeat_counts(rows: DataFrame, column: str) -> DataFrame:
    """Per map and text how many rows ``duplicates`` lists: all but the first of those that use it."""
    uses = rows.filter(F.col(column) != "").groupBy("map_id", column).agg(F.count("*").alias("_uses"))
    return uses.filter(F.col("_uses") > 1).select("map_id", (F.col("_uses") - 1).alias("n"))


def intervals(rows: DataFrame) -> DataFrame:
    """Registers each surviving row occupies; rows that occupy none are left out."""
    start = R.base_register(F.col("info2"))
    return (
        rows.withColumn("reg_start", start)
        .withColumn("reg_end", F.col("reg_start") + R.register_count(F.col("info3"), F.col("info2")) - 1)
        .filter(F.col("reg_end") >= F.col("reg_start"))
        .select(
            "map_id", "info1", "reg_start", "reg_end", "line_num", "name", F.col("info3").alias("type"),
            (F.col("info3") == "BITS").alias("is_bits"),
        )
    )


# Overlaps without comparing rows that do not overlap. Level k cuts the register
# axis into nodes of 2^k registers. An interval is the union of whole nodes: its
# single registers while it is narrow, else at most two nodes per level. A register
# lies in exactly one node per level. So "start of b lies in a" is one equality
# match of (level, node), and two intervals overlap exactly when one holds the
# start of the other.

#: Intervals up to this many registers are covered register by register.
NARROW = 16

#: Rows of one node that a task pairs with as many others when pairs are listed.
DEALT = 1 << 12

#: Maps of up to this many intervals are sorted by register in one task each.
WHOLE = 1 << 16

#: Rows that share registers in a row are compared directly up to this many.
ISLAND = 64


def _shift(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level)


def _covering_nodes(spans: DataFrame, first: str, last: str) -> DataFrame:
    """One row per node of the union of whole nodes that makes up ``[first, last]``."""
    start, end = F.col(first), F.col(last)
    width = end - start + 1
    narrow = F.when(width <= NARROW, F.sequence(start, end))
    registers = spans.filter((width >= 1) & (width <= NARROW)).select(
        "*", F.lit(0).alias("level"), F.explode(narrow).alias("node")
    )
    # At each level: the first whole node, and the one past the last whole node.
    low, high = F.col("_low"), F.col("_high")
    odd_low, odd_high = F.pmod(low, F.lit(2)) == 1, F.pmod(high, F.lit(2)) == 1
    left = F.when((low < high) & odd_low, low)
    right = F.when(odd_high & (low + F.when(odd_low, 1).otherwise(0) < high), high - 1)
    nodes = (
        spans.filter(width > NARROW)
        .withColumn("level", F.explode(F.sequence(F.lit(0), F.length(F.bin(width)) - 1)))
        .withColumns({"_low": -_shift(-start, F.col("level")), "_high": _shift(end + 1, F.col("level"))})
        .withColumn("node", F.explode(F.array(left, right)))
        .filter(F.col("node").isNotNull())
        .drop("_low", "_high")
    )
    return registers.unionByName(nodes)


def _start_nodes(spans: DataFrame, used: DataFrame) -> DataFrame:
    """The node of each interval start on every level ``used`` in its register space."""
    levels = used.select("map_id", "info1", "level").distinct()
    return salted_lookup(spans, levels, ["map_id", "info1"], "line_num").withColumn(
        "node", _shift(F.col("reg_start"), F.col("level"))
    )


def overlap_pairs(spans: DataFrame) -> DataFrame:
    """Every overlapping pair of rows of a map and register type, as a listing.

    Pairs of BITS rows on one register are allowed and never formed. Every match
    of the join is an overlap (pairs with equal starts match once per direction,
    one is kept), so the work follows the size of the listing. That size is
    quadratic where many rows share registers; :func:`overlap_counts` is not.
    The pairs of such a node are dealt over many tasks.
    """
    held = _covering_nodes(spans, "reg_start", "reg_end")
    starts = _start_nodes(spans, held)
    # BITS rows only meet other types.
    partners = F.when(F.col("is_bits"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    key = ["map_id", "info1", "level", "node", "other_bits"]
    a = held.withColumn("other_bits", F.explode(partners)).select(
        *key, *[F.col(c).alias("a_" + c) for c in ("reg_start", "reg_end", "line_num", "name")]
    )
    b = starts.select(
        "map_id", "info1", "level", "node", F.col("is_bits").alias("other_bits"),
        *[F.col(c).alias("b_" + c) for c in ("reg_start", "reg_end", "line_num", "name")],
    )
    a, b = _dealt(a, b, key)
    pairs = a.join(b, [*key, "_a_part", "_b_part"]).filter(
        (F.col("b_reg_start") > F.col("a_reg_start"))
        | ((F.col("b_reg_start") == F.col("a_reg_start")) & (F.col("b_line_num") > F.col("a_line_num")))
    )
    a_later = F.col("a_line_num") > F.col("b_line_num")

    def later(c):
        return F.when(a_later, F.col("a_" + c)).otherwise(F.col("b_" + c))

    def earlier(c):
        return F.when(a_later, F.col("b_" + c)).otherwise(F.col("a_" + c))

    return pairs.select(
        "map_id",
        "info1",
        *[later(c).alias(c) for c in ("line_num", "name", "reg_start", "reg_end")],
        earlier("line_num").alias("ref_line"),
        earlier("name").alias("ref_name"),
        earlier("reg_start").alias("ref_start"),
        earlier("reg_end").alias("ref_end"),
    )


def _dealt(a: DataFrame, b: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_a_part`` and ``_b_part``, so that a key with many rows is joined in cells of some ``DEALT`` rows a side.

    A row meets each part of the other side, which repeats it once for every
    ``DEALT`` partners: less than the pairs by that factor.
    """

    def parts(side, name):
        return side.groupBy(*key).agg((F.expr(f"count(*) div {DEALT}") + 1).alias(name))

    large = parts(a, "_a_parts").join(parts(b, "_b_parts"), key).filter((F.col("_a_parts") > 1) | (F.col("_b_parts") > 1))
    large = freeze(large, "overlap-parts")

    def dealt(side, own, other):
        known = salted_lookup(side, large, key, f"{own}_line_num").fillna(1, [f"_{own}_parts", f"_{other}_parts"])
        return known.withColumns(
            {
                f"_{own}_part": F.pmod(F.hash(f"{own}_line_num"), F.col(f"_{own}_parts")),
                f"_{other}_part": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"_{other}_parts") - 1)),
            }
        ).drop("_a_parts", "_b_parts")

    return dealt(a, "a", "b"), dealt(b, "b", "a")


def sharing_rows(spans: DataFrame) -> DataFrame:
    """The rows that share a register with any other, but for BITS that only meet BITS.

    Rows are judged by their first register, of which each counts once: an earlier one reaches it, it reaches a later
    one, or rows of it include one that is no BITS. Most rows of a sound map go here, before anything is compared.
    """
    space = ["map_id", "info1"]
    firsts = spans.groupBy(*space, "reg_start").agg(
        F.max("reg_end").alias("_end"), F.count("*").alias("_rows"), F.count(F.when(~F.col("is_bits"), 1)).alias("_plain")
    )
    firsts = freeze(firsts.withColumn("_back", -F.col("reg_start")), "first-registers")
    reached = ordered_scan(firsts, space, "reg_start", minima={"_far": -F.col("_end")}, sparse=True, before=True)
    both = ordered_scan(reached, space, "_back", minima={"_next": F.col("reg_start")}, totals=firsts, sparse=True, before=True)
    alone = (F.col("_rows") == 1) | (F.col("_plain") == 0)
    met = both.filter(~alone | (-F.col("_far") >= F.col("reg_start")) | (F.col("_next") <= F.col("_end")))
    return spans.join(met.select(*space, "reg_start"), [*space, "reg_start"], "left_semi").select(*spans.columns)


def overlap_counts(spans: DataFrame) -> DataFrame:
    """Per row: how many earlier rows it overlaps, and the first of them.

    The same pairs as :func:`overlap_pairs`, counted instead of listed. ``spans`` is read several times and should be a
    stored table. Maps of bounded size are sorted by register, and the rows of short islands are compared with each
    other. For larger maps and longer islands an earlier row overlaps either by holding the start of this one, or by
    starting inside the rest of it. Both are running counts in line order per node, so the cost stays linear in the
    rows and no node is handled by one task.
    """
    columns = ["map_id", "info1", "reg_start", "reg_end", "line_num", "is_bits"]
    compared, others = _compared(spans.select(columns))
    found = compared.select("map_id", "info1", "line_num", "n", "ref.line_num").toDF("map_id", "info1", "line_num", "n", "ref_line")
    return found if others is None else found.unionByName(_counted(freeze(sharing_rows(others), "sharing-rows")))


def overlaps(spans: DataFrame) -> DataFrame:
    """``overlap_counts`` with name and registers of the row and of the first one that it overlaps."""
    columns = ["map_id", "info1", "reg_start", "reg_end", "line_num", "is_bits", "name"]
    compared, others = _compared(spans.select(columns))
    refs = [F.col("ref." + c).alias("ref_" + c.removeprefix("reg_").replace("_num", "")) for c in ("line_num", "name", "reg_start", "reg_end")]
    found = compared.select("map_id", "info1", "line_num", "n", "name", "reg_start", "reg_end", *refs)
    if others is None:
        return found
    sharing = freeze(sharing_rows(others), "sharing-rows")
    own = sharing.select("map_id", "info1", "line_num", "name", "reg_start", "reg_end")
    first = own.toDF("map_id", "info1", "ref_line", "ref_name", "ref_start", "ref_end")
    joined = _counted(sharing).join(own, ["map_id", "info1", "line_num"]).join(first, ["map_id", "info1", "ref_line"])
    return found.unionByName(joined)


def _compared(spans: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of short islands in maps of bounded size that overlap earlier ones, with number and first; and all other rows."""
    large = freeze(spans.groupBy("map_id").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > WHOLE), "large-maps")
    others = None if large.isEmpty() else spans.join(large, "map_id", "left_semi")
    islands = freeze(_islands(spans if others is None else spans.join(large, "map_id", "left_anti")), "islands")
    long = islands.filter(F.col("size") > ISLAND)
    if not long.isEmpty():
        rows = long.select("map_id", "info1", F.inline("rows")).select(spans.columns)
        others = rows if others is None else others.unionByName(rows)

    def earlier(row):
        def met(other):
            shared = (other["reg_start"] <= row["reg_end"]) & (other["reg_end"] >= row["reg_start"])
            return (other["line_num"] < row["line_num"]) & shared & ~(row["is_bits"] & other["is_bits"])

        return F.struct(row.alias("row"), F.filter("rows", met).alias("met"))

    each = islands.filter(F.col("size") <= ISLAND).select("map_id", "info1", F.inline(F.transform("rows", earlier)))
    return (
        each.filter(F.size("met") > 0)
        .select("map_id", "info1", "row.*", F.size("met").cast("bigint").alias("n"), F.array_min("met").alias("ref")),
        others,
    )


def _islands(spans: DataFrame) -> DataFrame:
    """Lists of the rows that share registers, one for each stretch of registers that intervals cover without a gap."""
    space = ["map_id", "info1"]
    so_far = Window.partitionBy(*space).orderBy("reg_start")
    reached = spans.withColumn("_far", F.max("reg_end").over(so_far.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.col("_far").isNull() | (F.col("reg_start") > F.col("_far"))
    placed = reached.withColumns(
        {
            "_island": F.max(F.when(opens, F.col("reg_start"))).over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_next": F.lead("reg_start").over(so_far),
        }
    )
    # The line comes first, so that the smallest row is the earliest.
    row = F.struct("line_num", *[c for c in spans.columns if c not in (*space, "line_num")])
    return (
        placed.filter(~opens | (F.col("_next") <= F.col("reg_end")))
        .groupBy(*space, "_island")
        .agg(F.collect_list(row).alias("rows"), F.count("*").alias("size"), F.count(F.when(~F.col("is_bits"), 1)).alias("_plain"))
        .filter(F.col("_plain") > 0)
        .select(*space, "rows", "size")
    )


def _counted(spans: DataFrame) -> DataFrame:
    held = _covering_nodes(spans, "reg_start", "reg_end")
    rest = _covering_nodes(spans.withColumn("_second", F.col("reg_start") + 1), "_second", "reg_end").drop("_second")
    keys = ["map_id", "info1", "side", "level", "node"]

    def events(nodes, side, asks):
        return nodes.select(
            "map_id", "info1", F.lit(side).alias("side"), "level", "node", "line_num", "is_bits", F.lit(asks).alias("asks")
        )

    log = freeze(
        events(held, "holds", False)
        .unionByName(events(_start_nodes(spans, held), "holds", True))
        .unionByName(events(_start_nodes(spans, rest).filter(F.col("level").isNotNull()), "starts", False))
        .unionByName(events(rest, "starts", True)),
        "register-events",
    )
    given = ~F.col("asks")
    plain = given & ~F.col("is_bits")
    seen = ordered_scan(
        log,
        keys,
        "line_num",
        counts={"_all": given, "_plain": plain},
        minima={"_first": F.when(given, F.col("line_num")), "_first_plain": F.when(plain, F.col("line_num"))},
        ties=[given],
    ).filter("asks")
    n = F.when(F.col("is_bits"), F.col("_plain")).otherwise(F.col("_all"))
    first = F.when(F.col("is_bits"), F.col("_first_plain")).otherwise(F.col("_first"))
    return (
        seen.groupBy("map_id", "info1", "line_num")
        .agg(F.sum(n).alias("n"), F.min(first).alias("ref_line"))
        .filter(F.col("n") > 0)
    )

"""Personal data in texts: fixed patterns, and contexts learned from them, with DataFrame functions only.

1. Fixed patterns find e-mail addresses, IP addresses, card and phone numbers.
   Their places follow from the lengths of the matches and of the texts between them.
2. These are the seeds of a graph. A lexical pattern is the word before an
   identifier; an instance is an identifier's text. A pattern's confidence is the
   share of the word's occurrences in the whole corpus that stand before a
   trusted instance of a kind; an instance's confidence is that of at least one
   of its patterns being right. Patterns and instances are scored in turn, and
   instances above the bound are trusted in the next round, until none is added.
3. Tokens and runs of digits that look like an identifier, lie in no fixed match
   and are trusted at the end are added as spans of that kind. A run may hold
   spaces, brackets, dots and hyphens; tokens inside one that fits are no others.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freeze

KINDS = ["email", "ip", "card", "phone"]

# Possessive quantifiers and the bounds before a run keep Java's matcher linear and off the stack; the
# matches are the leftmost ones of the plain patterns. \G is the end of the match before.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: A text without these characters has no match.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

_DIGITS = "regexp_replace(x.t, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(x.t, '[.]'), p -> coalesce(try_cast(p AS INT) <= 255, false))",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}

#: Tokens with a digit or an at sign.
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

#: Maximal runs of digits with what may stand inside, and a letter right after, which the last digits then belong to.
_RUN = r"(?<![0-9A-Za-z_@.+(-])[+(]*+[0-9][0-9\x20().-]*+(?:(?<=[0-9])[A-Za-z_@])?+"

#: What a token has to look like to be taken for an instance of a kind, the first that fits.
_SHAPES = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^[0-9]{1,3}([.][0-9]{1,3}){3}$",
    "card": r"^[0-9]([.-]?[0-9]){12,18}$",
    "phone": r"^[(+]?[0-9]([().-]{0,2}[0-9]){6,11}$",
}

#: The same for runs.
_RUN_SHAPES = {
    "card": r"^[0-9]([\x20.-]?[0-9]){12,18}$",
    "phone": r"^[(+]?[0-9]([\x20().-]{0,3}[0-9]){6,11}$",
}

# What is cut off the end of a token and of a run. No character before the first one, so that only one place is tried.
_TAIL = r"(?<![^0-9A-Za-z])[^0-9A-Za-z]++$"
_RUN_TAIL = r"(?<![^0-9])[^0-9]++$"

#: Values of a block of running sums.
_BLOCK = 256

MIN_INSTANCES = 3
MIN_PATTERN = 0.5
MIN_INSTANCE = 0.8


def _word_before(gap: str) -> str:
    plain = f"translate({gap}, '\\n\\r\\t', '   ')"
    return f"lower(substring_index(rtrim({plain}), ' ', -1))"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, step: Callable[[Column, Column], Column], first: int, levels: int = 2) -> Column:
    """The running combination of an array of numbers, by blocks, so that no step copies what all before it gave."""

    def scanned(block: Column, start: Column) -> Column:
        grown = F.aggregate(block, F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
        return F.slice(grown, F.lit(2), F.size(block))

    def by_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(first), step))
        starts = F.concat(F.array(F.lit(first)), _running(totals, step, first, levels - 1))
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), scanned))

    def chosen(xs: Column) -> Column:
        whole = scanned(xs, F.lit(first))
        if levels == 1:
            return whole
        last = F.floor((F.size(xs) - 1) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK)))
        return F.when(F.size(xs) <= _BLOCK, whole).otherwise(_let(blocks, by_blocks))

    return _let(values, chosen)


def _matches(text: str, pattern: str, need: str = "") -> Column:
    """array<struct<t, w, n>>: text of each match, word before, length with the gap before, in order."""
    match = (
        f"zip_with(regexp_extract_all({text}, r'{pattern}', 0), split({text}, r'{pattern}'),"
        f" (m, g) -> struct(m AS t, {_word_before('g')} AS w, length(g) + length(m) AS n))"
    )
    none = "CAST(array() AS ARRAY<STRUCT<t: STRING, w: STRING, n: INT>>)"
    has = f"contains({text}, '{need}') AND " if need else ""
    return F.expr(f"CASE WHEN {has}rlike({text}, r'{pattern}') THEN filter({match}, x -> x.t IS NOT NULL) ELSE {none} END")


def _placed(matches: str) -> Column:
    """array<struct<s, e, t, w>>: the matches with their begins and ends."""
    ends = _running(F.col(f"{matches}.n"), lambda a, b: a + b, 0)
    placed = F.zip_with(
        matches, ends, lambda m, e: F.struct((e - F.length(m["t"])).alias("s"), e.alias("e"), m["t"].alias("t"), m["w"].alias("w"))
    )
    none = F.expr("CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, t: STRING, w: STRING>>)")
    return F.when(F.size(matches) > 0, placed).otherwise(none)


def _shaped(found: str, cut: str, shapes: dict[str, str]) -> str:
    shape = " ".join(f"WHEN rlike(x.t, r'{p}') THEN '{k}'" for k, p in shapes.items())
    shaped = (
        f"transform(transform({found}, x -> {cut}),"
        f" x -> struct(CASE {shape} END AS kind, x.s AS s, x.s + length(x.t) AS e, x.t AS t, x.w AS w))"
    )
    return f"filter({shaped}, x -> x.kind IS NOT NULL)"


def _apart(spans: Column, taken: Column) -> Column:
    """Those of the disjoint, ordered ``spans`` that share no character with any of ``taken``.

    A span is free if, of the taken ones that begin before its end, none ends
    after its begin: ends of spans and begins of taken ones are sorted together
    and the furthest end so far is carried along.
    """
    ends = F.transform(spans, lambda x, i: F.struct(x["e"].alias("at"), F.lit(0).alias("taken"), F.lit(-1).alias("e"), i.alias("i")))
    begins = F.transform(taken, lambda x: F.struct(x["s"].alias("at"), F.lit(1).alias("taken"), x["e"].alias("e"), F.lit(-1).alias("i")))

    def walk(events: Column) -> Column:
        furthest = _running(F.transform(events, lambda v: v["e"]), lambda a, b: F.greatest(a, b), -1)
        seen = F.zip_with(events, furthest, lambda v, far: F.struct(v["i"].alias("i"), far.alias("far")))
        free = F.filter(seen, lambda v: (v["i"] >= 0) & (v["far"] <= F.get(spans, v["i"])["s"]))
        return F.transform(free, lambda v: F.get(spans, v["i"]))

    both = (F.size(spans) > 0) & (F.size(taken) > 0)
    return F.when(both, _let(F.sort_array(F.concat(ends, begins)), walk)).otherwise(spans)


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc, base, tokens): matches of the fixed patterns with their kinds, and other identifier-like tokens and runs.

    Written once, so ``row`` tells rows apart from then on. Time is linear in
    the length of a text up to some millions of matches, but for their sort.
    """
    texts = docs.select(F.col(doc).alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    matched = texts.select(
        "doc",
        *[_matches("text", _PATTERNS[k], _NEEDS[k]).alias(k) for k in KINDS],
        _matches("text", _TOKEN).alias("tokens"),
        _matches("text", _RUN).alias("runs"),
    )
    found = matched.select("doc", *[_placed(c).alias(c) for c in [*KINDS, "tokens", "runs"]])
    kept = [f"transform(filter({k}, x -> {_VALID[k]}), x -> struct('{k}' AS kind, x.s, x.e, x.t, x.w))" for k in KINDS]
    head = r"regexp_extract(x.t, r'^[^0-9A-Za-z+(]*+', 0)"
    cut = f"struct(x.s + length({head}) AS s, x.w AS w, regexp_replace(substring(x.t, length({head}) + 1), r'{_TAIL}', '') AS t)"
    run = rf"struct(x.s AS s, x.w AS w, regexp_replace(regexp_replace(x.t, r'(?<![0-9])[0-9]++[A-Za-z_@]$', ''), r'{_RUN_TAIL}', '') AS t)"
    based = found.select(
        "doc",
        F.expr(f"concat({', '.join(kept)})").alias("base"),
        F.expr(_shaped("tokens", cut, _SHAPES)).alias("tokens"),
        F.expr(_shaped("runs", run, _RUN_SHAPES)).alias("runs"),
    )
    based = based.withColumn("runs", _apart(F.col("runs"), F.col("base")))
    based = based.withColumn("taken", F.concat("base", "runs"))
    alone = _apart(F.col("tokens"), F.col("taken"))
    out = based.select(F.monotonically_increasing_id().alias("row"), "doc", "base", F.concat("runs", alone).alias("tokens"))
    return freeze(out, "identifiers")


def learn_contexts(docs: DataFrame, scanned: DataFrame, text: str = "text") -> DataFrame:
    """(kind, t): identifier texts that are trusted when no round adds any."""
    seen = freeze(
        scanned.select(F.inline("base")).withColumn("seed", F.lit(1))
        .union(scanned.select(F.inline("tokens")).withColumn("seed", F.lit(0)))
        .filter("w != ''").groupBy("kind", "w", "t").agg(F.count("*").alias("n"), F.max("seed").alias("seed")),
        "pattern-instances",
    )
    support = seen.groupBy("kind", "w").agg(F.count("*").alias("instances")).filter(F.col("instances") >= MIN_INSTANCES)
    patterns = freeze(support.select("kind", "w"), "patterns")
    words = docs.select(F.explode(F.split(F.lower(text), r"[\x20\n\r\t]+")).alias("w"))
    totals = words.join(patterns.select("w").distinct(), "w").groupBy("w").agg(F.count("*").alias("total"))
    edges = freeze(seen.join(patterns, ["kind", "w"]).join(totals, "w"), "pattern-graph")
    trusted = edges.filter("seed = 1").select("kind", "t").distinct()
    reached, before = trusted.count(), -1
    # What is trusted only grows, so an equal number is the same table.
    while reached > before:
        good = edges.join(trusted, ["kind", "t"]).groupBy("kind", "w").agg(
            (F.sum("n") / F.max("total")).alias("confidence"), F.count("*").alias("instances")
        )
        strong = good.filter((F.col("confidence") >= MIN_PATTERN) & (F.col("instances") >= MIN_INSTANCES))
        doubt = F.sum(F.log(F.greatest(1 - F.least("confidence", F.lit(1.0)), F.lit(1e-9))))
        likely = (
            edges.join(strong.select("kind", "w", "confidence"), ["kind", "w"])
            .groupBy("kind", "t")
            .agg((1 - F.exp(doubt)).alias("trust"))
            .filter(F.col("trust") >= MIN_INSTANCE)
        )
        trusted = freeze(
            edges.filter("seed = 1").select("kind", "t").union(likely.select("kind", "t")).distinct(), "trusted-instances"
        )
        reached, before = trusted.count(), reached
    return trusted


def _listed(spans: str) -> str:
    rank = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    ordered = f"array_sort(transform({spans}, x -> struct(CASE x.kind {rank} END AS k, x.s AS s, x.e AS e, x.kind AS kind)))"
    return f"array_join(transform({ordered}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def personal_data(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, base, added): for each row the spans (kind, s, e, t, w) of both steps; places in code points, end exclusive.

    A null text counts as empty and an empty text has no spans. Repeated rows
    stay. Other columns are ignored.
    """
    scanned = scan(docs, doc, text)
    trusted = learn_contexts(docs.filter(F.col(text).isNotNull()), scanned, text)
    added = (
        scanned.select("row", F.inline("tokens"))
        .join(trusted, ["kind", "t"])
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "s", "e", "t", "w")).alias("added"))
    )
    empty = F.expr("filter(base, x -> false)")
    return scanned.join(added, "row", "left").select(
        F.col("doc").alias(doc), "base", F.coalesce("added", empty).alias("added")
    )


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Counts and listed spans of ``personal_data``."""
    return found.select(
        doc,
        *[F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"),
        F.expr(_listed("concat(base, added)")).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )

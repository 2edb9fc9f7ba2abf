"""Device data types: synonyms, byte-order suffixes and validity."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from regfleet.functions.text import other_characters, plain, strip

# Words that select a byte-order suffix, strongest first.
SUFFIX_WORDS = [
    ("_WB", ["_wb", "swap", "big endian"]),
    ("_B", ["_b", "big"]),
    ("_W", ["_w", "word"]),
]

# Integer widths, and the words before or glued to a width.
INTEGER_WIDTHS = [64, 32, 16, 8]
UNSIGNED_WORDS = ["unsigned integer {}", "unsigned int {}", "uint{}"]
SIGNED_WORDS = ["signed integer {}", "signed int {}", "int{}"]
FLOAT_WORDS = [("F64", ["float64", "double"]), ("F32", ["float32", "float"])]

# Types without a width, and the grammar of the others.
PLAIN_TYPES = ["STRING", "BITS", "IP", "IPV6", "MAC"]
NUMERIC_TYPE = r"^([UI](8|16|32|64)|F(32|64))(_(W|B|WB))?$"
SIZED_STRING = r"^STR[0-9]+$"

#: All types without a size, to be looked up instead of matched.
SUFFIXES = ["", "_W", "_B", "_WB"]
COMMON_TYPES = PLAIN_TYPES + [f"{c}{w}{s}" for c, widths in (("UI", INTEGER_WIDTHS), ("F", [32, 64])) for c in c for w in widths for s in SUFFIXES]

DEFAULT_TYPE = "U16"


def synonym_table() -> list[tuple[str, list[str]]]:
    """(code, words) in matching order: wide before narrow, unsigned before signed."""
    table = []
    for width in INTEGER_WIDTHS:
        table.append((f"U{width}", [w.format(width) for w in UNSIGNED_WORDS]))
        table.append((f"I{width}", [w.format(width) for w in SIGNED_WORDS]))
    return table + FLOAT_WORDS


def _contains_any(c: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [c.contains(w) for w in words])


def _first_match(c: Column, table: list[tuple[str, list[str]]]) -> Column:
    expr = F
    for value, words in table:
        expr = expr.when(_contains_any(c, words), F.lit(value))
    return expr


def _synonym(t: Column) -> Column:
    """First match of the synonyms; those of a width are tried only where its digits stand."""
    table, expr = synonym_table(), F
    for width in INTEGER_WIDTHS:
        of_width = [row for row in table if all(str(width) in w for w in row[1]) and row[0][0] in "UI"]
        expr = expr.when(t.contains(str(width)) & _contains_any(t, [w for _, words in of_width for w in words]), _first_match(t, of_width))
    for value, words in FLOAT_WORDS:
        expr = expr.when(_contains_any(t, words), F.lit(value))
    return expr


def type_of(t: Column) -> Column:
    """Device type of lower-cased, stripped text (null: none); give it a column, not a formula."""
    code = F.when(_contains_any(t, ["int", "float", "double"]), _synonym(t))
    suffix = F.coalesce(_first_match(t, SUFFIX_WORDS), F.lit(""))
    cleaned = F.when(other_characters(t) != t, F.upper(plain(t)))
    return F.coalesce(F.concat(code, suffix), cleaned, F.lit(DEFAULT_TYPE))


def type_text(c: Column) -> Column:
    return strip(F.lower(c))


def normalize_type(c: Column) -> Column:
    """Type text to a device type; unknown text is cleaned and upper-cased."""
    return type_of(type_text(c))


def valid_type(c: Column) -> Column:
    return c.isin(COMMON_TYPES) | c.rlike(f"(?i)^({'|'.join(PLAIN_TYPES)})$|{NUMERIC_TYPE}|{SIZED_STRING}")

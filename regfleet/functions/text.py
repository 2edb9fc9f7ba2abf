"""Whitespace and null handling used by every other rule."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII whitespace; Spark's one-argument trim only removes spaces.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


#: What tags and types are made of.
PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789_"


def other_characters(c: Column) -> Column:
    """The characters of a text that are not in ``[a-z0-9_]``; many times cheaper than a regular expression."""
    return F.translate(c, PLAIN, "")


def plain(c: Column) -> Column:
    """The text without all characters but ``[a-z0-9_]``."""
    others = other_characters(c)
    return F.when(others == "", c).otherwise(F.call_function("translate", c, others, F.lit("")))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def text(c: Column) -> Column:
    """Cell value as text: stripped, null becomes the empty string."""
    return F.coalesce(strip(c), F.lit(""))

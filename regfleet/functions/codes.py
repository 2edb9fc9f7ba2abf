"""Register-type and access codes."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from regfleet.functions.text import strip

# Register-type words and their codes.
REGISTER_CODES = {
    "coil": "1",
    "coils": "1",
    "discrete input": "2",
    "holding register": "3",
    "holding": "3",
    "input register": "4",
    "input": "4",
}
DEFAULT_REGISTER_CODE = "3"
DEFAULT_REGISTER_TYPE = "Holding Register"

# Access words and the codes that stand for themselves.
READ_WORDS = ["R", "READ", "4"]
WRITE_WORDS = ["RW", "W", "WRITE", "1"]
ACTION_CODES = ["0", "1", "2", "4", "6", "7", "8", "9"]
READ_ACTION = "4"
DEFAULT_ACTION = "1"


def _lookup(c: Column) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(REGISTER_CODES.items())])
    code = F.try_element_at(table, F.lower(c))
    return F.coalesce(code, F.when(c.isin("1", "2", "3", "4"), c))


def known_register_type(c: Column) -> Column:
    return (c == "") | _lookup(c).isNotNull()


def register_code(c: Column) -> Column:
    """Register-type text to code 1-4; blank and unknown text give 3."""
    return F.coalesce(_lookup(c), F.lit(DEFAULT_REGISTER_CODE))


def default_register_type(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(DEFAULT_REGISTER_TYPE))


def action_code(c: Column) -> Column:
    u = F.upper(strip(c))
    return (
        F.when(u.isin(READ_WORDS), F.lit(READ_ACTION))
        .when(u.isin(WRITE_WORDS), F.lit(DEFAULT_ACTION))
        .when(u.isin(ACTION_CODES), u)
        .otherwise(F.lit(DEFAULT_ACTION))
    )

"""Register addresses: spelling, offset, compound forms, size.

An address is ``base``, ``base_length`` (STRING) or ``base_bit_length`` (BITS).
Numbers have any length: up to 18 digits they are BIGINTs, longer ones are added
up in groups of nine digits. Registers that do not fit a BIGINT are in no interval.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from regfleet.functions.text import WHITESPACE, strip

# One address base, and the two compound address forms.
BASE = r"([0-9A-F]+|0x[0-9A-F]+|[0-9A-F]+h|-?[0-9]+)"
PLAIN_ADDRESS = rf"(?i)^{BASE}$"
STRING_ADDRESS = rf"(?i)^{BASE}_[0-9]+$"
BITS_ADDRESS = rf"(?i)^{BASE}_[0-9]+_[0-9]+$"

# Registers used by each family of types.
ONE_REGISTER = r"^([UI](16|8)(_(W|B|WB))?|BITS)$"
TWO_REGISTERS = r"^([UIF]32(_(W|B|WB))?|IP)$"
FOUR_REGISTERS = r"^[UIF]64(_(W|B|WB))?$"
MAC_REGISTERS = 3
IPV6_REGISTERS = 8

# Decimal text, and the spellings of a hexadecimal number: 0x10, 10h, -10h, A0.
DECIMAL = r"^[+-]?0*[0-9]{1,18}$"
HEXADECIMAL = r"^(?:0x(?!.*h$)|[+-](?:0x)?(?=.*h$))?0*[0-9a-f]{1,15}\s*h?$"
INTEGER = r"^-?[0-9]{1,18}$"

# The same beyond 18 decimal and 15 hexadecimal digits.
LONG_DECIMAL = r"^[+-]?[0-9]{19,}$"
LONG_HEXADECIMAL = r"^(?:0x(?!.*h$)|[+-](?:0x)?(?=.*h$))?[0-9a-f]{16,}\s*h?$"
LONG_INTEGER = r"^-?[0-9]{19,}$"

#: Decimal digits of a group, and hexadecimal digits that are read at once.
_GROUP, _HEX = 9, 7
_BASE = 10**_GROUP


def _let(value: Column, body) -> Column:
    """``body(value)``, in which the value is worked out once and its formula stands once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _groups(digits: Column, size: int, radix: int) -> Column:
    """Groups of ``size`` digits as BIGINTs, the least significant first; leading zeros make the last one whole."""
    padded = F.concat(F.lit("0" * size), digits)
    ends = F.sequence(F.length(digits) + 1, F.lit(2), F.lit(-size))
    return F.transform(ends, lambda i: F.conv(F.substring(padded, i, F.lit(size)), radix, 10).cast("bigint"))


def _carried(groups: Column, value) -> Column:
    """Groups after ``value(group, carry)`` for each, with what is carried in the end."""
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("done"))

    def step(acc, group):
        def split(total):
            low = F.pmod(total, F.lit(_BASE))
            carry = F.call_function("div", total - low, F.lit(_BASE))
            return F.struct(carry.alias("carry"), F.array_append(acc["done"], low).alias("done"))

        return _let(value(group, acc["carry"]), split)

    return F.aggregate(groups, start, step, lambda acc: F.array_append(acc["done"], acc["carry"]))


def _digits(groups: Column) -> Column:
    """Decimal text of groups, the least significant first."""
    texts = F.transform(F.reverse(groups), lambda g: F.lpad(g.cast("string"), _GROUP, "0"))
    return F.regexp_replace(F.array_join(texts, ""), "^0+(?=[0-9])", "")


def _hexadecimal(digits: Column) -> Column:
    """Seven digits at a time: all groups times 16^7, plus the next seven."""

    def step(groups, seven):
        shifted = F.transform(groups, lambda g, i: g * F.lit(16**_HEX) + F.when(i == 0, seven).otherwise(F.lit(0)))
        return _carried(shifted, lambda g, carry: g + carry)

    return _digits(F.aggregate(F.reverse(_groups(digits, _HEX, 16)), F.array(F.lit(0).cast("bigint")), step))


def _added(digits: Column, offset: Column) -> Column:
    """Decimal text of ``digits``, which are worth more than 10^18 times 10^9, plus a BIGINT."""
    size = F.abs(offset.cast("decimal(20,0)")).cast("string")
    others = F.transform(_groups(size, _GROUP, 10), lambda g: F.when(offset < 0, -g).otherwise(g))
    sums = F.zip_with(_groups(digits, _GROUP, 10), others, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return _digits(_carried(sums, lambda g, carry: g + carry))


def _long_number(s: Column) -> Column:
    """``part_number`` beyond 18 decimal or 15 hexadecimal digits."""

    def read(low):
        digits = F.translate(low, "+-xh" + WHITESPACE, "")
        number = F.when(low.rlike(LONG_DECIMAL), F.regexp_replace(digits, "^0+(?=[0-9])", "")).when(
            low.rlike(LONG_HEXADECIMAL), _let(digits, _hexadecimal)
        )
        negative = low.startswith("-")
        return _let(number, lambda n: F.when(negative & (n != "0"), F.concat(F.lit("-"), n)).otherwise(n))

    return _let(F.lower(s), read)


def _long_sum(base: Column, offset: Column) -> Column:
    """Decimal text of a long base moved by a BIGINT: as DECIMAL while the sign may change, by groups beyond."""

    def move(text):
        near = (text.try_cast("decimal(38,0)") + offset.cast("decimal(19,0)")).cast("decimal(38,0)").cast("string")
        digits = F.ltrim(text, F.lit("-"))
        far = F.when(
            text.startswith("-"), F.concat(F.lit("-"), _let(digits, lambda d: _added(d, -offset)))
        ).otherwise(_let(digits, lambda d: _added(d, offset)))
        return F.when(F.length(text) <= 36, near).otherwise(far)

    return _let(base, move)


def without_thousands(address: Column) -> Column:
    """Drop commas that group digits by three."""
    plain = F.regexp_replace(address, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    return F.when(address.contains(","), plain).otherwise(address)


def part_number(s: Column) -> Column:
    """Decimal text of a cleaned part, null when it is no number.

    A ``0x`` prefix or an ``h`` suffix makes it hexadecimal, plain digits are
    decimal, and other hex digits hexadecimal.
    """
    low = F.lower(s)
    digits = F.translate(low, "+xh" + WHITESPACE, "")
    return (
        F.when(s.rlike(DECIMAL), s.try_cast("bigint"))
        .when(low.rlike(HEXADECIMAL), F.conv(digits, 16, -10).try_cast("bigint"))
        .cast("string")
    )


def cleaned_number(s: Column) -> Column:
    """A part as decimal text if it is a number, else as it is."""
    return F.coalesce(part_number(s), F.when(F.length(s) >= 16, _long_number(s)), s)


def decimal_part(c: Column) -> Column:
    """One address part to decimal text; text that is no number is unchanged.

    Thousands commas go first.
    """
    return cleaned_number(without_thousands(strip(c)))


def shifted_base(base: Column, offset: Column) -> Column:
    """A numeric base moved by ``offset``; other text is unchanged, a negative result kept."""
    moved = F.try_add(base.try_cast("bigint"), offset.cast("bigint")).cast("string")
    return (
        F.when(base.rlike(INTEGER), F.coalesce(moved, _long_sum(base, offset)))
        .when((F.length(base) >= 19) & base.rlike(LONG_INTEGER), _long_sum(base, offset))
        .otherwise(base)
    )


def _part(address: Column, n: int) -> Column:
    return F.split_part(address, F.lit("_"), F.lit(n))


def apply_offset(address: Column, offset: Column) -> Column:
    """Normalize the parts of an address and shift its base by ``offset``."""
    parts = F.split(address, "_")
    base, second, third = [decimal_part(F.get(parts, F.lit(n))) for n in range(3)]
    return F.concat_ws("_", _let(base, lambda b: shifted_base(b, offset)), second, third, rest_of(parts))


def rest_of(parts: Column) -> Column:
    """The parts past the third, which no valid address has."""
    return F.when(F.size(parts) > 3, F.transform(F.slice(parts, F.lit(4), F.size(parts)), decimal_part))


def is_negative(address: Column) -> Column:
    """True when the (already normalized) base is a number below zero."""
    return address.rlike(r"^-[0-9]+(_|$)")


def valid_address(address: Column, dtype: Column) -> Column:
    u = F.upper(dtype)
    return (
        F.when(u == "STRING", address.rlike(STRING_ADDRESS))
        .when(u == "BITS", address.rlike(BITS_ADDRESS))
        .otherwise(address.rlike(PLAIN_ADDRESS))
    )


def valid_register(address: Column, dtype: Column) -> Column:
    """``valid_address`` for a normalized address."""
    number = "[0-9]+"
    shapes = f"STRING:-?{number}_{number}|BITS:-?{number}_{number}_{number}|(?!STRING:|BITS:)[^:]*:-?{number}"
    common = F.substring(dtype, 1, 1).isin("U", "I", "F", "M") & ~dtype.contains(":") & address.rlike(f"^-?{number}$")
    return common | F.concat_ws(":", dtype, address).rlike(f"^({shapes})$")


def _sized(dtype: Column) -> Column:
    """Whether a type may be ``STR<n>``; cheap, as most are not."""
    return F.upper(F.substring(dtype, 1, 3)) == "STR"


def expand_str_type(dtype: Column) -> Column:
    return F.when(_sized(dtype), F.regexp_replace(dtype, "(?i)^STR[0-9]+$", "STRING")).otherwise(dtype)


def expand_str_address(dtype: Column, address: Column) -> Column:
    """Append the length of ``STR<n>`` to an address that carries none."""
    size = F.regexp_extract(dtype, "(?i)^STR0*([0-9]+)$", 1)
    # With no size, the added separator is all there is to strip.
    extended = F.rtrim(F.concat_ws("_", address, size), F.lit("_"))
    return F.when(address.contains("_") | ~_sized(dtype), address).otherwise(extended)


def bits_address(dtype: Column, address: Column, start_bit: Column, length: Column) -> Column:
    """``base_start_length`` for BITS rows whose start bit has its own column."""
    composed = F.concat_ws("_", _part(address, 1), start_bit, F.coalesce(F.nullif(length, F.lit("")), F.lit("1")))
    return F.when((dtype == "BITS") & (start_bit != ""), composed).otherwise(address)


def base_register(address: Column) -> Column:
    """First register of a storable address."""
    return F.substring_index(address, "_", 1).try_cast("bigint")


def register_count(dtype: Column, address: Column) -> Column:
    """Registers a value occupies; a STRING without a usable length uses none."""
    u = F.upper(dtype)
    length = _part(address, 2)
    chars = F.when(length.rlike(r"^[+-]?[0-9]{1,18}$"), length.try_cast("bigint"))
    return (
        F.when(u.isin("U16", "I16", "U8", "I8", "BITS") | u.rlike(ONE_REGISTER), F.lit(1))
        .when(u.rlike(TWO_REGISTERS), F.lit(2))
        .when(u.rlike(FOUR_REGISTERS), F.lit(4))
        .when(u == "MAC", F.lit(MAC_REGISTERS))
        .when(u == "IPV6", F.lit(IPV6_REGISTERS))
        .when(u == "STRING", F.coalesce(F.shiftright(chars + 1, 1), F.lit(0)))
        .otherwise(F.lit(1))
        .cast("bigint")
    )

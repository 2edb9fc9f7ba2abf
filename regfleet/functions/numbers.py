"""Number spellings, coefficients and their exact six-decimal text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from regfleet.functions.text import strip

#: Decimal float grammar; guards casts that would also accept ``1d`` or ``1.0f``.
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Fixed value: commas that group thousands.
GROUPED = r"^-?[0-9]{1,3}(,[0-9]{3})+$"
COMMA_BEFORE_DOT = r"^[^.]*,.*\."


def _to_double(s: Column) -> Column:
    # A cast that fails inside raises and catches an exception, so only text of the grammar is cast.
    return F.when(s.rlike(FLOAT), s.try_cast("double"))


def number_of(s: Column) -> Column:
    """Number in stripped text, null or infinite when it is none; give it a column."""
    top = _to_double(strip(F.split_part(s, F.lit("/"), F.lit(1))))
    bottom = _to_double(strip(F.split_part(s, F.lit("/"), F.lit(2))))
    plain = (
        F.when(~s.contains(","), s)
        .when(s.rlike(f"{COMMA_BEFORE_DOT}|{GROUPED}"), F.replace(s, F.lit(","), F.lit("")))
        .otherwise(F.translate(s, ",.", "."))
    )
    return F.when(s.contains("/"), F.try_divide(top, bottom)).otherwise(_to_double(plain))


def finite_or(value: Column, default: float) -> Column:
    return F.when(F.abs(value) < float("inf"), value).otherwise(F.lit(float(default)))


def parse_number(c: Column, default: float) -> Column:
    """Number text to DOUBLE: fractions, 1,234.5 and 1.234,5; else the default."""
    return finite_or(number_of(F.coalesce(strip(c), F.lit(""))), default)


def scale_exponent(c: Column) -> Column:
    """Power of ten as INT, truncated toward zero; unusable text gives 0.

    Exponents below any double are held at -400 (the power is 0 either way);
    above 308 the power does not exist and the text counts as unusable.
    """
    value = _to_double(strip(F.coalesce(c, F.lit(""))))
    held = F.when(value < 309, F.greatest(value, F.lit(-400.0)))
    return F.coalesce(held.cast("int"), F.lit(0))


def coefficient_a(factor: Column, exponent: Column) -> Column:
    # The literal 1e<n> is the correctly rounded power; pow(10, n) is not.
    return factor * F.concat(F.lit("1e"), exponent.cast("string")).cast("double")


def _whole_text(units: Column) -> Column:
    """Exact digits of a whole, non-negative DOUBLE up to 1e38.

    From 2^53 on a double is whole; from 2^63 on its parts above and below 2^64
    are worked out apart, which is exact, and put together as decimals.
    """
    low = units % 2.0**64
    high = (units - low) / 2.0**64
    low_low = low % 2.0**32
    low_high = (low - low_low) / 2.0**32

    def part(x, power):
        return (x.cast("bigint").cast("decimal(19,0)") * F.lit(power).cast("decimal(20,0)")).cast("decimal(38,0)")

    large = part(high, str(2**64)) + part(low_high, str(2**32)) + part(low_low, "1")
    return F.when(units < 2.0**63, units.cast("bigint").cast("string")).otherwise(large.cast("decimal(38,0)").cast("string"))


def fixed6(x: Column) -> Column:
    """Six-decimal text of a DOUBLE, rounding its exact binary value half-even.

    Below 10^6 the product with 10^6 is off by less than 2^-13, so its nearest whole number is right unless it lies
    close to the middle of two. Other numbers go through :func:`_fixed6_exact`, in a lambda: its code is long, and
    generated methods of more than 8,000 bytes of code are never compiled.
    """
    scaled = F.abs(x) * 1e6
    middle = F.abs(scaled % 1.0 - 0.5)
    micros = F.rint(scaled).cast("bigint")
    whole = F.call_function("div", micros, F.lit(1000000).cast("bigint")).cast("string")
    digits = F.concat(whole, F.lit("."), F.lpad((micros % 1000000).cast("string"), 6, "0"))
    sign = F.when((x < 0) | ((x == 0) & (x.cast("string") == "-0.0")), F.lit("-")).otherwise(F.lit(""))
    exact = F.get(F.transform(F.array(x), _fixed6_exact), F.lit(0))
    return F.when((scaled < 1e12) & (middle > 0.001), F.concat(sign, digits)).otherwise(exact)


def _fixed6_exact(x: Column) -> Column:
    """``fixed6`` of any DOUBLE.

    ``format_string('%.6f')`` rounds the shortest decimal instead, which differs
    on ties and shows other digits of large numbers. The fraction of a double is
    exact; ``fraction * 10^7`` is formed as product plus error term (Dekker
    splitting), which settles every tie. Only beyond 1e38, which DECIMAL does not
    hold, the digits after the seventeenth are zeros.
    """
    a = F.abs(x)
    held = F.when(a < 1e38, a).otherwise(F.lit(0.0))
    # Not F.floor: that is a BIGINT.
    units = held - held % 1.0
    fraction = held % 1.0
    product = fraction * 1e7
    scaled = fraction * 134217729.0
    high = scaled - (scaled - fraction)
    error = (high * 1e7 - product) + (fraction - high) * 1e7
    whole = F.floor(product / 10.0)
    rest = (product - whole * 10.0 - 5.0) + error
    round_up = F.signum(rest) * 2 + whole % 2 > 0
    micros = whole + round_up.cast("int")
    carried = units + (micros >= 1000000).cast("double")
    digits = F.concat(_whole_text(carried), F.lit("."), F.lpad((micros % 1000000).cast("string"), 6, "0"))
    sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(a < 1e38, F.concat(sign, digits))
        .when(a == float("inf"), F.concat(sign, F.lit("inf")))
        .otherwise(F.format_string("%.6f", x))
    )

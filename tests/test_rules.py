"""Row rules on listed cases."""

import re
import random

import pytest
from pyspark.sql import functions as F

from regfleet import functions as R
from regfleet.operators.staging import stage, surviving, with_coefficient_text, with_values
from regfleet.schemas import REGISTER_COLUMNS


def values(spark, rule, *inputs):
    """Results of ``rule`` on rows of one or more string columns."""
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)]
    names = [f"c{i}" for i in range(len(rows[0]) - 1)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in names))
    return [r.v for r in df.select("i", rule(*[F.col(n) for n in names]).alias("v")).orderBy("i").collect()]


TYPES = {
    "Uint16": "U16", "Int32": "I32", "Float32": "F32", "unsigned int 16": "U16",
    "unsigned int 16 big endian": "U16_WB", "float32 swap": "F32_WB", "signed integer 64 word swap": "I64_WB",
    "uint32 big": "U32_B", "U16_WB": "U16_WB", "STR50": "STR50", "bits": "BITS", "uint8": "U8", "double": "F64",
    "float 64": "F32", "uint 16": "UINT16", "": "U16", "   ": "U16", None: "U16", "u32 big": "U32BIG",
    "double word": "F64_W", "int32 uint64": "U64", "I 32": "I32", "int64_b": "I64_B",
}
VALID = [
    *[f"{sign}{size}{order}" for sign in "UI" for size in (8, 16, 32, 64) for order in ("", "_W", "_B", "_WB")],
    *[f"F{size}{order}" for size in (32, 64) for order in ("", "_W", "_B", "_WB")],
    "STRING", "string", "BITS", "bits", "IP", "ipv6", "MAC", "STR7", "str007", "u8_wb",
]
INVALID = ["", "U", "U24", "I7", "F8", "F128", "STR", "STR-1", "BITS_1", "MAC_W", "U16_X", "U16_BW", "IPV4", "text"]


def test_types(spark):
    assert values(spark, R.normalize_type, *TYPES) == list(TYPES.values())
    assert all(values(spark, R.valid_type, *VALID))
    assert not any(values(spark, R.valid_type, *INVALID))


PARTS = {
    "0x10": "16", "0X1f": "31", "10h": "16", "10": "10", "A0": "160", "1,234": "1234", "1,234,567": "1234567",
    "12,34": "12,34", "-10h": "-16", "+5": "5", "0010": "10", "BAD": "2989", "1E5": "485", "40001.0": "40001.0",
    "40001-40002": "40001-40002", "-0x10": "-0x10", "0x": "0x", "h": "h", "": "", "0x10h": "0x10h", " 12 ": "12",
    "10 h": "16", "-0h": "0", "9" * 25: "9" * 25, "xyz": "xyz",
}


def test_address_parts(spark):
    assert values(spark, R.decimal_part, *PARTS) == list(PARTS.values())


def test_addresses(spark):
    moved = {"100_20": "150_20", "0x64": "150", "xyz_4": "xyz_4", "": "", "_20": "_20", "30001_0_1": "30051_0_1", "-60": "-10",
             "A0_A0": "210_160", "1_2_3_4_5": "51_2_3_4_5",
             "1_2_3_0x4": "51_2_3_4"}
    assert values(spark, lambda a: R.apply_offset(a, F.lit(50)), *moved) == list(moved.values())
    # As many parts as the type asks for, whatever the spelling of the base; nothing else.
    rnd = random.Random(11)
    parts = {"STRING": 2, "BITS": 3, "U16": 1, "IPV6": 1}
    cases = {}
    for kind, wanted in parts.items():
        for count in range(1, 5):
            number = rnd.randrange(1, 10**6)
            for base in (f"{number}", f"-{number}", f"0x{number:X}", f"{number:x}H", f"{number:X}"):
                cases["_".join([base, *(str(rnd.randrange(50)) for _ in range(count - 1))]), kind] = count == wanted
        tail = "_1" * (wanted - 1)
        cases |= {(base + tail, kind): False for base in ("", "0x", "7G", "1.5", "--1", "1 2", "h")}
    assert values(spark, R.valid_address, *cases) == list(cases.values())
    assert values(spark, R.valid_register, ("1", "U16"), ("1_2", "STRING"), ("1_2_3", "BITS"), ("-5", "MAC"), ("9" * 59, "U16"),
                  ("1_2", "IP"), ("1", "STRING")) == [True, True, True, True, True, False, False]
    counts = {("U16", "1"): 1, ("I8_B", "1"): 1, ("U32", "1"): 2, ("F32_WB", "1"): 2, ("IP", "1"): 2, ("U64", "1"): 4, ("MAC", "1"): 3,
              ("IPV6", "1"): 8, ("STRING", "30000_10"): 5, ("STRING", "30000_11"): 6, ("STRING", "30000"): 0, ("STRING", "1_0"): 0, ("BITS", "1_0_1"): 1}
    assert values(spark, R.register_count, *counts) == list(counts.values())


def test_addresses_of_any_length(spark):
    """Against Python's integers: reading, and moving up, down and across zero."""
    rnd = random.Random(12)
    numbers = [rnd.randrange(10 ** (n - 1), 10**n) * rnd.choice([1, -1]) for n in range(15, 61) for _ in range(3)]
    numbers += [sign * (10**n + d) for n in (18, 19, 27, 36, 37, 38, 45) for d in (-1, 0, 1) for sign in (1, -1)]
    spelled = {f"{n}": str(n) for n in numbers}
    spelled |= {f"00{abs(n)}": str(abs(n)) for n in numbers} | {f"+{abs(n)}": str(abs(n)) for n in numbers}
    spelled |= {f"0x{abs(n):X}": str(abs(n)) for n in numbers} | {f"{n:x}h": str(n) for n in numbers}
    spelled |= {"-0x" + "1" * 20: "-0x" + "1" * 20, "1" * 30 + ".0": "1" * 30 + ".0", "-" + "0" * 25: "0"}
    assert values(spark, R.decimal_part, *spelled) == list(spelled.values())
    for offset in (50, -50_000, 2**63 - 1, -(2**63) + 1):
        moved = values(spark, lambda a, o=offset: R.apply_offset(a, F.lit(o)), *map(str, numbers))
        fits = [(m, n + offset) for m, n in zip(moved, numbers, strict=True) if abs(n) >= 10**18 or abs(offset) < 10**18]
        assert all(m == str(total) for m, total in fits)


def test_str_and_bits(spark):
    assert values(spark, R.expand_str_address, ("STR20", "100"), ("STR020", "100"), ("STR20", "100_5"), ("U16", "7"), ("STR20", "")) == [
        "100_20", "100_20", "100_5", "7", "_20"]
    assert values(spark, R.expand_str_type, "STR20", "STR", "U16") == ["STRING", "STR", "U16"]
    assert values(spark, R.bits_address, ("BITS", "100", "3", ""), ("BITS", "100_9", "3", "2"), ("BITS", "100", "", "2"), ("U16", "100", "3", "2")) == [
        "100_3_1", "100_3_2", "100", "100"]


def test_numbers(spark):
    numbers = {"1": 1, "0.1": 0.1, "1/10": 0.1, "1,234.5": 1234.5, "1.234,5": 1234.5, "0,5": 0.5, "abc": 7, "1,234": 1234, "1,2,3": 7,
               "-1,234,567": -1234567, "1_0": 7, "1f": 7, "1d": 7, "nan": 7, "inf": 7, "1e400": 7, "1 / 4": 0.25, "1/0": 7, "/5": 7, "5/": 7,
               "1/2/3": 0.5, "1e3": 1000, "": 7, None: 7, ".5": 0.5, "5.": 5, "1,5/2": 7}
    assert values(spark, lambda c: R.parse_number(c, 7.0), *numbers) == list(numbers.values())
    scales = {"": 0, None: 0, "x": 0, "-1.9": -1, "2": 2, "1e2": 100, "400": 0, "-999": -400, "1,5": 0}
    assert values(spark, R.scale_exponent, *scales) == list(scales.values())


def test_six_decimals(spark):
    rnd = random.Random(5)
    xs = [0.0, -0.0, 5e-7, 0.1234565, 1e-7, 2.5, -1.5e-6, 1e8, 9.9e14, 1e20, 876694022.7454225, 1e-300, -1e-9]
    xs += [rnd.randint(0, 10**9) / 1e7 * rnd.choice([1, -1]) for _ in range(5000)]
    xs += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-9, 37) for _ in range(9000)]
    xs += [10000000000000.123, 9100000000000.3, 1e23, float(2**60), float(2**64), float(2**63), 9999999.9999999, 0.9999999, 1e37]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", R.fixed6(F.col("x")).alias("t"))
    assert [(r.x, r.t) for r in df.collect() if r.t != f"{r.x:.6f}"] == []


def test_codes(spark):
    registers = {"": "3", "Coils": "1", "coil": "1", "Discrete Input": "2", "HOLDING": "3", "input register": "4", "Input": "4", "2": "2", "5": "3", "holding registers": "3"}
    assert values(spark, R.register_code, *registers) == list(registers.values())
    assert values(spark, R.known_register_type, "", "coil", "4", "5", "holding registers") == [True, True, True, False, False]
    actions = {"": "1", "R": "4", "read": "4", "RW": "1", "write": "1", "W": "1", "4": "4", "1": "1", "0": "0", "2": "2", "6": "6", "9": "9", "3": "1", "RO": "1", "R/W": "1"}
    assert values(spark, R.action_code, *actions) == list(actions.values())


def test_names(spark):
    bases = {"Fan Speed": "fan_speed", "<Aux>  Relay 2": "aux_relay_2", "9 lives": "v_9_lives", "": "var", "°": "var",
             "_x__y_": "x_y", "Flow [l/s] (max)": "flow_ls_max", "two\nlines": "twolines"}
    assert values(spark, R.tag_base, *bases) == list(bases.values())
    assert values(spark, R.definition_slug, ("Acme & Co", "X-1")) == ["acme___co_x_1_definition"]


def rows_of(spark, *rows):
    data = [("m", i + 2, *[row.get(c) for c in REGISTER_COLUMNS]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, "map_id string, line_num bigint, " + ", ".join(f"{c} string" for c in REGISTER_COLUMNS))


def test_status_order(spark):
    staged = stage(
        rows_of(
            spark,
            {"name": "a", "address": "1"},
            {},
            {"name": " ", "address": "", "type": "bad"},
            {"name": "b", "type": "I128", "address": "zz"},
            {"name": "c", "address": "zz"},
            {"name": "d", "address": "9" * 30},
            {"name": "e", "type": "uint 16", "address": "1"},
            {"address": "0x10", "type": "STR20"},
        )
    )
    assert [r.status for r in staged.orderBy("line_num").collect()] == [
        "OK", "BLANK", "MISSING_NAME_AND_ADDRESS", "INVALID_TYPE", "INVALID_ADDRESS", "OK", "INVALID_TYPE", "OK"]
    last = staged.filter("line_num = 9").first()
    assert (last.info2, last.info3) == ("16_20", "STRING")


@pytest.mark.parametrize("factor,offset,scale,a,b", [("2.5", "", "-1", "0.250000", "0.000000"), ("1/8", "-0", "3", "125.000000", "-0.000000"), ("", "1,5", "x", "1.000000", "1.500000")])
def test_coefficients(spark, factor, offset, scale, a, b):
    rows = rows_of(spark, {"name": "a", "address": "1", "factor": factor, "offset_raw": offset, "scale_factor": scale})
    row = with_coefficient_text(with_values(surviving(stage(rows)))).first()
    assert (row.coef_a, row.coef_b) == (a, b)


def test_fixed6_near_ties_and_bounds(spark):
    """The short way and the exact one give what C gives."""
    ties = [(2 * k + 1) / 2**7 for k in range(40)]
    values = [s * v for v in [0.0, 5e-7, 1e-7, 0.1, 1.0005, 999999.9999995, 1e6, 1234567.0078125, 123456.0078125, 2.0**53, 1e300, *ties] for s in (1.0, -1.0)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", R.fixed6(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in rows if abs(r.x) < 1e38 and r.t != "%.6f" % r.x] == []


def test_plain_drops_what_the_regular_expression_drops(spark):
    from regfleet.functions.text import plain

    texts = ["", "a", "a_1", "[af]_x", "é1", "𝄞a𝄞b", "a\nb", "\\$a", "]^-a-z", "ABC", "a\x00b", "--", "a--b--a"]
    assert values(spark, plain, *texts) == [re.sub("[^a-z0-9_]+", "", x) for x in texts]

"""Line numbers and row status: what each register row becomes, or why it does not."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regfleet import functions as R
from regfleet.functions import addresses as A
from regfleet.functions import datatypes as D
from regfleet.functions import naming as T
from regfleet.functions import numbers as N
from regfleet.operators.lookup import salted_lookup
from regfleet.operators.ordering import ordered_scan
from regfleet.schemas import REGISTER_COLUMNS

OK = "OK"
BLANK = "BLANK"
MISSING = "MISSING_NAME_AND_ADDRESS"
INVALID_TYPE = "INVALID_TYPE"
INVALID_ADDRESS = "INVALID_ADDRESS"

#: The first data record of a map is line 2, below its header.
FIRST_LINE = 2

#: Bits of the record order that hold the position inside one table.
TABLE_SHIFT = 46


def record_order(table_id: Column, row_ord: Column) -> Column:
    """One BIGINT that sorts the records of a map by table, then by position.

    Table numbers beyond its bits raise an error instead of mixing tables up.
    """
    table = table_id.cast("bigint")
    held = F.when((table >= 0) & (table < 1 << (63 - TABLE_SHIFT)), table).otherwise(
        F.raise_error(F.lit("table_id does not fit the record order")).cast("bigint")
    )
    return F.shiftleft(held, TABLE_SHIFT) + row_ord


def number_lines(rows: DataFrame, order: str) -> DataFrame:
    """Add ``line_num``: ordinal of the record in its map, starting at 2."""
    numbered = ordered_scan(rows, ["map_id"], order, counts={"line_num": F.lit(True)})
    return numbered.withColumn("line_num", F.col("line_num") + (FIRST_LINE - 1))


def with_offset(rows: DataFrame, params: DataFrame, salt: str = "line_num") -> DataFrame:
    """Attach the address offset of each map; maps without parameters get 0, of several rows the smallest holds."""
    offsets = params.groupBy("map_id").agg(F.min("address_offset").alias("address_offset"))
    return salted_lookup(rows, offsets, ["map_id"], salt).fillna(0, ["address_offset"])


def stage(rows: DataFrame) -> DataFrame:
    """Clean name, address and type of every register row, judge it, derive its tag text.

    Expects ``map_id``, ``line_num`` and the ten register columns; optional
    ``address_offset`` (default 0) and ``blank`` (true when the whole source row
    was empty). The first rule a row breaks decides its ``status``. All other
    columns are left raw, only survivors need them. Store the result before
    filtering it, or the filter is pushed below and repeats every rule.
    """
    if "address_offset" not in rows.columns:
        rows = rows.withColumn("address_offset", F.lit(0).cast("bigint"))
    if "blank" not in rows.columns:
        # Being a lambda, it also ends the generated method of the steps before, which is not compiled beyond 8,000 bytes.
        empty = F.forall(F.array(*[F.col(c).cast("string") for c in REGISTER_COLUMNS]), lambda c: F.coalesce(c, F.lit("")) == "")
        rows = rows.withColumn("blank", (R.text(F.col("name")) == "") & empty)

    # One projection per step: a formula used twice is a column of the step before,
    # so that it is evaluated once.
    cells = rows.withColumns(
        {"name": R.text(F.col("name")), "address": R.text(F.col("address")), "_t": D.type_text(F.col("type"))}
    )
    typed = cells.withColumn("dtype", D.type_of(F.col("_t"))).drop("_t")
    parts = with_normalized_address(
        typed.withColumn("_address", R.expand_str_address(F.col("dtype"), F.col("address"))),
        "_address",
        F.col("address_offset"),
        "info2",
    ).withColumn("info3", R.expand_str_type(F.col("dtype")))
    status = (
        F.when(F.col("blank"), BLANK)
        .when((F.col("name") == "") & (F.col("address") == ""), MISSING)
        .when(~R.valid_type(F.col("dtype")), INVALID_TYPE)
        .when(~R.valid_register(F.col("info2"), F.col("info3")), INVALID_ADDRESS)
        .otherwise(OK)
    )
    return T.with_tag_base(parts.withColumn("status", status), "name", "base").drop(
        "address", "address_offset", "blank", "_address"
    )


def with_normalized_address(rows: DataFrame, address: str, offset: Column, out: str) -> DataFrame:
    """``functions.apply_offset`` as steps, each text worked out once per row."""
    split = rows.withColumn("_parts", F.split(A.without_thousands(F.col(address)), "_"))
    cut = split.withColumns({f"_p{n}": R.strip(F.get("_parts", F.lit(n))) for n in range(3)})
    read = cut.withColumns({f"_p{n}": A.cleaned_number(F.col(f"_p{n}")) for n in range(3)})
    joined = F.concat_ws("_", A.shifted_base(F.col("_p0"), offset), "_p1", "_p2", A.rest_of(F.col("_parts")))
    return read.withColumn(out, joined).drop("_p0", "_p1", "_p2", "_parts")


def surviving(staged: DataFrame) -> DataFrame:
    """Rows that become definition rows, with clean tag and register code."""
    kept = staged.filter(F.col("status") == OK).withColumns(
        {"tag": R.text(F.col("tag")), "register_type": R.text(F.col("register_type"))}
    )
    return kept.withColumn("info1", R.register_code(F.col("register_type"))).drop(
        "status", "register_type", "type", "dtype"
    )


def with_values(rows: DataFrame) -> DataFrame:
    """Parse scaling to DOUBLE coefficients, clean unit and action."""
    texts = rows.withColumns({c: R.text(F.col(c)) for c in ("factor", "offset_raw", "scale_factor", "unit", "action")})
    read = texts.withColumns(
        {
            "_a": N.number_of(F.col("factor")),
            "_b": N.number_of(F.col("offset_raw")),
            "_e": R.scale_exponent(F.col("scale_factor")),
            "action": R.action_code(F.col("action")),
        }
    )
    return read.withColumns(
        {
            "coef_a_num": R.coefficient_a(N.finite_or(F.col("_a"), 1.0), F.col("_e")),
            "coef_b_num": N.finite_or(F.col("_b"), 0.0),
        }
    ).drop("factor", "offset_raw", "scale_factor", "_a", "_b", "_e")


def with_coefficient_text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"coef_a": R.fixed6(F.col("coef_a_num")), "coef_b": R.fixed6(F.col("coef_b_num"))})

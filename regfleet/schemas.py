"""Column lists and schemas shared by the sources, operators and sinks."""

from pyspark.sql import types as T

#: Canonical register columns, in the order of the simplified register file.
REGISTER_COLUMNS = [
    "name", "tag", "register_type", "address", "type",
    "factor", "offset_raw", "unit", "action", "scale_factor",
]

# Header texts of the simplified register file.
REGISTER_HEADERS = {
    "name": "Name",
    "tag": "Tag",
    "register_type": "RegisterType",
    "address": "Address",
    "type": "Type",
    "factor": "Factor",
    "offset_raw": "Offset",
    "unit": "Unit",
    "action": "Action",
    "scale_factor": "ScaleFactor",
}

#: Targets that header detection can fill; two of them only feed BITS addresses.
TARGET_COLUMNS = {
    **{header: column for column, header in REGISTER_HEADERS.items()},
    "Length": "length",
    "StartBit": "start_bit",
}

# The order in which targets claim source headers.
DETECTION_ORDER = [
    "RegisterType", "Address", "Name", "Type", "Unit", "Action",
    "Tag", "Factor", "Offset", "ScaleFactor", "Length", "StartBit",
]

# Substrings that make a lower-cased header eligible for a target.
HEADER_PATTERNS = {
    "RegisterType": ["register type", "reg type", "modbus type", "registertype"],
    "Address": ["address", "addr", "offset", "register", "reg"],
    "Name": ["name", "description", "parameter", "variable", "signal", "signal name"],
    "Type": ["data type", "datatype", "type", "format"],
    "Unit": ["unit", "units"],
    "Tag": ["tag"],
    "Action": ["action", "access"],
    "Factor": ["scale", "factor", "multiplier", "ratio"],
    "Offset": ["offset", "bias", "coefficient b"],
    "ScaleFactor": ["scalefactor", "scale factor"],
    "Length": ["length", "len", "size", "count", "quantity"],
    "StartBit": ["startbit", "bit offset", "bit", "start"],
}


def _strings(*names):
    return [T.StructField(n, T.StringType()) for n in names]


REGISTER_SCHEMA = T.StructType(
    [T.StructField("map_id", T.StringType()), T.StructField("line_num", T.LongType())]
    + _strings(*REGISTER_COLUMNS)
)

DEFINITION_COLUMNS = [
    "info1", "info2", "info3", "info4", "name", "tag", "coef_a", "coef_b", "unit", "action",
]

DEFINITION_SCHEMA = T.StructType(
    [
        T.StructField("map_id", T.StringType()),
        T.StructField("idx", T.LongType()),
        *_strings(*DEFINITION_COLUMNS),
        T.StructField("line_num", T.LongType()),
    ]
)

DIAGNOSTIC_SCHEMA = T.StructType(
    [
        T.StructField("map_id", T.StringType()),
        T.StructField("line_num", T.LongType()),
        *_strings("code", "severity", "name", "detail"),
        T.StructField("ref_line", T.LongType()),
        *_strings("ref_name", "ref_range"),
        T.StructField("n", T.LongType()),
    ]
)

PARAMETER_SCHEMA = T.StructType(
    _strings("map_id", "manufacturer", "model", "protocol", "category", "forced_write")
    + [T.StructField("address_offset", T.LongType())]
)

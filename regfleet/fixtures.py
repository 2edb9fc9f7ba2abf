"""Register tables of any size derived from the given tables, for queries and benchmarks.

Every row of the source table becomes one register row, so the work of a query
grows with the table. The texts cover every spelling the rules know.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regfleet.functions import tag_base
from regfleet.operators.ordering import ordered_scan
from regfleet.operators.staging import FIRST_LINE
from regfleet.schemas import REGISTER_COLUMNS, REGISTER_HEADERS

#: Register columns from ``k``, ``p_name``, ``p_type`` and ``line_num``; the same
#: text also runs in the checking engine.
ROW_RULES = """
  map_id, line_num,
  CASE WHEN k % 37 = 0 THEN '' WHEN k % 5 = 0 THEN '[' || p_type || '] ' || p_name ELSE p_name END AS name,
  CASE WHEN k % 9 = 0 THEN 'T' || CAST(k AS STRING) WHEN k % 41 = 0 THEN 'dup_tag' ELSE '' END AS tag,
  CASE WHEN dtype = 'BITS' OR k % 8 = 0 THEN 'Holding Register' WHEN k % 8 = 1 THEN 'input register'
    WHEN k % 8 = 2 THEN 'Coils' WHEN k % 8 = 3 THEN 'Discrete Input' WHEN k % 8 = 4 THEN '4'
    WHEN k % 8 = 5 THEN 'INPUT' WHEN k % 8 = 6 THEN 'weird' ELSE '' END AS register_type,
  CASE WHEN k % 74 = 0 THEN '' WHEN k % 53 = 0 THEN 'n/a'
    WHEN dtype = 'BITS' THEN CAST(40000 + 4 * (k % 3) AS STRING) || '_' || CAST(k % 16 AS STRING) || '_1'
    WHEN dtype = 'STRING' THEN CAST(addr AS STRING) || '_' || CAST(k % 12 AS STRING)
    WHEN k % 4 = 1 THEN '0x' || hex(addr)
    WHEN k % 4 = 2 THEN hex(addr) || 'h'
    WHEN k % 4 = 3 THEN CAST(CAST(floor(addr / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST(addr % 1000 AS STRING), 3, '0')
    ELSE CAST(addr AS STRING) END AS address,
  dtype AS type,
  CASE k % 8 WHEN 0 THEN '1' WHEN 1 THEN '0.1' WHEN 2 THEN '1/10' WHEN 3 THEN '0.001'
    WHEN 4 THEN '1,234.5' WHEN 5 THEN '1.234,5' WHEN 6 THEN '0,5' ELSE 'abc' END AS factor,
  CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '-40' WHEN 3 THEN '2,5' ELSE '1/4' END AS offset_raw,
  CASE k % 4 WHEN 0 THEN 'V' WHEN 1 THEN 'kW' WHEN 2 THEN '%' ELSE '' END AS unit,
  CASE k % 9 WHEN 0 THEN 'R' WHEN 1 THEN 'RW' WHEN 2 THEN 'read' WHEN 3 THEN 'Write' WHEN 4 THEN ''
    WHEN 5 THEN '6' WHEN 6 THEN '3' WHEN 7 THEN 'R/W' ELSE '9' END AS action,
  CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '-3' WHEN 3 THEN '2' WHEN 4 THEN '-1.9' ELSE 'x' END AS scale_factor
"""

TYPE_RULE = """CASE k % 17
    WHEN 0 THEN 'U16'   WHEN 1 THEN 'uint32'        WHEN 2 THEN 'Float32'
    WHEN 3 THEN 'STR20' WHEN 4 THEN 'BITS'          WHEN 5 THEN 'unsigned int 16 big endian'
    WHEN 6 THEN 'IPV6'  WHEN 7 THEN 'signed integer 64 word swap' WHEN 8 THEN 'uint32 big'
    WHEN 9 THEN 'double' WHEN 10 THEN 'U16_WB'      WHEN 11 THEN 'MAC'
    WHEN 12 THEN 'STRING' WHEN 13 THEN ''           WHEN 14 THEN 'uint 16'
    WHEN 15 THEN 'float 64' ELSE 'I128' END"""

ADDRESS_RULE = "40000 + 2 * line_num"

#: Names of the fleet fixture: few texts per map, so that names and tags repeat.
FLEET_NAME = "'signal ' || CAST((l_partkey + l_linenumber) % 97 AS STRING)"
FLEET_TYPE = "l_returnflag || l_linestatus"

#: Documents: the part rows in maps of bounded size, as a file is one map.
DOCUMENT_ID = "p_brand || '-' || CAST(CAST(floor(p_partkey / 50000) AS BIGINT) AS STRING)"

#: Names and tags that mix families: typed tags and longer names spell numbered tags.
MIXED_NAME = """CASE k % 7 WHEN 2 THEN 'Phase ' || CAST(k % 5 AS STRING)
  WHEN 3 THEN 'phase 1 ' || CAST(k % 3 AS STRING) ELSE 'Phase' END"""
MIXED_TAG = """CASE WHEN k % 11 = 0 THEN 'phase_' || CAST(k % 23 AS STRING) WHEN k % 13 = 0 THEN 'phase' ELSE '' END"""

#: Header wordings of the ten register columns, and which maps use which.
HEADER_VARIANTS = {
    1: ["Name", "Tag", "RegisterType", "Address", "Type", "Factor", "Offset", "Unit", "Action", "ScaleFactor"],
    2: ["Signal Name", "Tag", "Register Type", "Register Address", "Data Format",
        "Ratio", "Bias", "Measurement Unit", "Access", "Scale Factor"],
    3: ["Parameter", "tag id", "Modbus Type", "Addr\nHex", "Data\nType",
        "Multiplier", "Coefficient B", "Units", "Access Mode", "ScaleFactor"],
}
VARIANT = "CASE WHEN map_id LIKE 'Brand#1%' THEN 1 WHEN map_id LIKE 'Brand#2%' THEN 2 ELSE 3 END"

#: Parameters of a map, from the text of its id.
PARAMETER_RULES = """
  map_id,
  CASE length(map_id) % 2 WHEN 0 THEN 'Acme & Sons' ELSE 'Sol;ar "X"' END AS manufacturer,
  'M-' || map_id AS model,
  CASE length(map_id) % 3 WHEN 0 THEN 'modbusTCP' ELSE 'modbusRTU' END AS protocol,
  'Inverter' AS category,
  '' AS forced_write,
  CAST(CASE WHEN map_id LIKE '%1' THEN 50 WHEN map_id LIKE '%3' THEN -50000 ELSE 0 END AS BIGINT) AS address_offset
"""

#: Parameters that some maps state in part or not at all.
INCOMPLETE_RULES = """
  map_id,
  CASE WHEN map_id LIKE '%2' THEN '' ELSE manufacturer END AS manufacturer,
  CASE WHEN map_id LIKE '%3' OR map_id LIKE '%22' THEN CAST(NULL AS STRING) ELSE model END AS model,
  protocol, category, forced_write, address_offset
"""
INCOMPLETE = "map_id NOT LIKE '%4'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(rows: DataFrame, order: str, ties=()) -> DataFrame:
    numbered = ordered_scan(rows, ["map_id"], order, counts={"line_num": F.lit(True)}, ties=ties)
    return numbered.withColumn("line_num", F.col("line_num") + (FIRST_LINE - 1))


def _registers(rows: DataFrame) -> DataFrame:
    rules = rows.selectExpr("*", f"{ADDRESS_RULE} AS addr", f"{TYPE_RULE} AS dtype")
    return rules.sparkSession.sql("SELECT " + ROW_RULES + " FROM {rows}", rows=rules)


def registers(spark: SparkSession, sf_dir: str, map_id: str = "p_brand") -> DataFrame:
    """Simplified registers from ``part``: one map per brand."""
    part = table(spark, sf_dir, "part").selectExpr(f"{map_id} AS map_id", "p_partkey AS k", "p_name", "p_type")
    return _registers(_numbered(part, "k"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registers(spark, sf_dir, DOCUMENT_ID)


def mixed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr("p_brand AS map_id", "p_partkey AS k")
    rows = _numbered(part, "k").selectExpr("map_id", "line_num", f"{MIXED_NAME} AS name", f"{MIXED_TAG} AS tag")
    return rows.withColumn("base", tag_base(F.col("name")))


def header_cells(map_ids: DataFrame) -> DataFrame:
    """(map_id, header) in the wording of each map."""
    wordings = F.create_map(
        *[v for i, h in HEADER_VARIANTS.items() for v in (F.lit(i), F.array(*[F.lit(t) for t in h]))]
    )
    return map_ids.withColumn("header", F.element_at(wordings, F.expr(VARIANT)))


def cells(registers: DataFrame) -> DataFrame:
    """Long table cells: the registers on page 1, and a header-only table on page 2."""
    maps = registers.select("map_id").distinct()
    heads = header_cells(maps).select(
        "map_id", F.lit(0).alias("table_id"), F.lit(0).cast("bigint").alias("row_ord"), F.posexplode("header").alias("col_ord", "value")
    )
    body = registers.select(
        "map_id",
        F.lit(0).alias("table_id"),
        (F.col("line_num") - 1).alias("row_ord"),
        F.posexplode(F.array(*REGISTER_COLUMNS)).alias("col_ord", "value"),
    )
    notes = maps.select(
        "map_id", F.lit(1).alias("table_id"), F.lit(0).cast("bigint").alias("row_ord"), F.lit(0).alias("col_ord"), F.lit("Notes").alias("value")
    )
    return (
        heads.unionByName(body)
        .unionByName(notes)
        .withColumns(
            {
                "page_number": F.col("table_id") + 1,
                "table_name": F.when(F.col("table_id") == 0, F.lit("Registers")).otherwise(F.lit("Notes")),
            }
        )
    )


def two_tables(registers: DataFrame) -> DataFrame:
    """Cells of documents with two tables of records: even lines, then odd ones in another order and wording of columns."""
    maps = registers.select("map_id").distinct()
    wording = {0: HEADER_VARIANTS[1], 1: HEADER_VARIANTS[2][::-1]}
    order = {0: REGISTER_COLUMNS, 1: REGISTER_COLUMNS[::-1]}
    parts = []
    for table_id in (0, 1):
        header = F.array(*[F.lit(t) for t in wording[table_id]])
        heads = maps.select("map_id", F.lit(0).cast("bigint").alias("row_ord"), F.posexplode(header).alias("col_ord", "value"))
        body = registers.filter(F.col("line_num") % 2 == table_id).select(
            "map_id", F.col("line_num").alias("row_ord"), F.posexplode(F.array(*order[table_id])).alias("col_ord", "value")
        )
        parts.append(heads.unionByName(body).withColumn("table_id", F.lit(table_id)))
    return parts[0].unionByName(parts[1])


#: Bit columns of the register rows, and the wording of their headers.
START_BIT = "CASE line_num % 5 WHEN 0 THEN '' ELSE CAST(line_num % 16 AS STRING) END"
BIT_LENGTH = "CASE line_num % 3 WHEN 0 THEN '' ELSE '2' END"
BIT_HEADERS = {1: ["Start Bit", "Length"], 2: ["Bit", "Size"], 3: ["First bit", "Bit Count"]}


def bit_cells(registers: DataFrame) -> DataFrame:
    """Cells of tables whose two last columns are start bit and length."""
    heads = header_cells(registers.select("map_id").distinct())
    more = F.create_map(*[v for i, h in BIT_HEADERS.items() for v in (F.lit(i), F.array(*[F.lit(t) for t in h]))])
    header = F.concat("header", F.element_at(more, F.expr(VARIANT)))
    top = heads.select("map_id", F.lit(0).cast("bigint").alias("row_ord"), F.posexplode(header).alias("col_ord", "value"))
    cells = F.array(*REGISTER_COLUMNS, F.expr(START_BIT), F.expr(BIT_LENGTH))
    body = registers.select("map_id", F.col("line_num").alias("row_ord"), F.posexplode(cells).alias("col_ord", "value"))
    return top.unionByName(body).withColumn("table_id", F.lit(0))


#: Addresses of 16 to 60 digits, some hexadecimal, some negative.
LONG_ADDRESS = """CASE line_num % 3 WHEN 0 THEN repeat(CAST(40000 + line_num AS STRING), CAST(4 + line_num % 8 AS INT))
  WHEN 1 THEN '0x' || repeat(hex(4096 + line_num), CAST(4 + line_num % 4 AS INT))
  ELSE '-' || repeat(CAST(40000 + line_num AS STRING), CAST(4 + line_num % 8 AS INT)) END"""

#: Which records of an XML file are elements of the second name.
POINT = "line_num % 3 = 0"


def xml_lines(registers: DataFrame) -> DataFrame:
    """Lines of XML files with elements of two names, each record twice, with an attribute and a nested child."""

    def escaped(c):
        text = F.col(c)
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(plain), F.lit(entity))
        return text

    leaves = [F.concat(F.lit(f"<{h}>"), escaped(c), F.lit(f"</{h}>")) for c, h in REGISTER_HEADERS.items()]
    nested = F.concat(F.lit("<Range><Low>"), F.col("line_num").cast("string"), F.lit("</Low></Range>"))
    name = F.when(F.expr(POINT), F.lit("point")).otherwise(F.lit("row"))
    line = F.concat(F.lit("<"), name, F.lit(' no="'), F.col("line_num").cast("string"), F.lit('">'), *leaves, nested, F.lit("</"), name, F.lit(">"))
    rows = registers.select("map_id", F.explode(F.array(2 * F.col("line_num"), 2 * F.col("line_num") + 1)).alias("line_ord"), line.alias("line"))
    ends = registers.groupBy("map_id").agg((2 * F.max("line_num") + 2).alias("last"))
    tags = F.inline(F.arrays_zip(F.array(F.lit(0).cast("bigint"), "last").alias("line_ord"), F.array(F.lit("<map>"), F.lit("</map>")).alias("line")))
    return rows.unionByName(ends.select("map_id", tags))


def document_lines(registers: DataFrame, delimiter: Column, headers: DataFrame) -> DataFrame:
    """Text lines of delimited files; ``delimiter`` may depend on ``map_id``."""

    def field(c):
        return F.when(c.rlike('[,;\t"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    body = registers.select("map_id", (F.col("line_num") - 1).alias("line_ord"), F.array(*REGISTER_COLUMNS).alias("c"))
    head = headers.select("map_id", F.lit(0).cast("bigint").alias("line_ord"), F.col("header").alias("c"))
    line = F.call_function("array_join", F.transform("c", field), delimiter)
    return head.unionByName(body).select("map_id", "line_ord", line.alias("line"))


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simplified registers from ``lineitem``: one map per supplier."""
    ties = ["l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_suppkey AS STRING) AS map_id",
        "l_partkey + l_linenumber AS k",
        f"{FLEET_NAME} AS p_name",
        f"{FLEET_TYPE} AS p_type",
        "l_orderkey",
        *ties,
    )
    return _registers(_numbered(lines, "l_orderkey", ties))


def parameters(registers: DataFrame) -> DataFrame:
    return registers.select("map_id").distinct().selectExpr(*[r.strip() for r in PARAMETER_RULES.strip().split(",\n")])

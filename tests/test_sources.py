"""File sources and sinks, end to end on small directories."""

import pytest
from pyspark.sql import functions as F

from regfleet.operators import headers as headers_module
from regfleet.operators.headers import project_records, resolve_columns, source_columns
from regfleet.operators.records import drop_repeats, grid_records, select_tables
from regfleet.plans.definition import generate
from regfleet.plans.extraction import extract, run, simplified
from regfleet.schemas import PARAMETER_SCHEMA
from regfleet.sinks.definition import definition_lines, write_definitions
from regfleet.sinks.registers import write_registers
from regfleet.sources.delimited import dialects, read_delimited
from regfleet.sources.files import partition_value
from regfleet.sources.mapping import read_mapping
from regfleet.sources.xml import read_xml


def params(spark, *maps):
    return spark.createDataFrame(
        [(m, man, mod, "modbusRTU", "Inverter", "", offset) for m, man, mod, offset in maps], PARAMETER_SCHEMA
    )


def lines_of(df, map_id):
    return [r.line for r in df.filter(F.col("map_id") == map_id).orderBy("line_ord").collect()]


def by_map(records):
    found = {}
    for r in records.orderBy("map_id", "row_ord").collect():
        found.setdefault(r.map_id, []).append(r)
    return found


PUMP = (
    "Access mode,Bias,Parameter name,Modbus type,Addr,Format,Measuring unit,Multiplier\n"
    "rw,,Valve 1,coil,0x20,uint8,,\nr,-40,Inlet,input,33,signed int 16,°C,1/8\n"
    "r,,Runtime,holding,0100h,unsigned integer 32 word,h,\n"
)
#: A name column that looks like a tag, two scales, bits in columns of their own, and a row without a usable address.
TRAPS = (
    "Remarks,Size,Register,Tag name,Reg type,Kind of format,Start bit,Scale factor,Scale\n"
    'x,2,0x0A,Gate,1,bits,3,0,1\ny,,"1,024",Depth,weird,STR12,,1,2.5\nz,,20-21,Bad,,uint16,,,\n,,0C,Spare,4,float 64,,-2,4\n'
)
SIMPLE = (
    "Address;Unit;Name;Type;Action;ScaleFactor;Tag\n"
    "7_9;;Serial text;string;;;\n0x30;kWh;Total out;u64;R;3;E_TOT\n61;;Total out;mac;W;;\n"
)


@pytest.fixture
def docs(tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "pump.csv").write_text(PUMP, encoding="utf-8")
    (folder / "traps.csv").write_text(TRAPS, encoding="utf-8")
    (folder / "bom.csv").write_bytes(PUMP.replace(",", ";").encode("utf-8-sig"))
    (folder / "wide.csv").write_bytes(PUMP.replace(",", "\t").encode("utf-16"))
    (folder / "big_endian.csv").write_bytes(b"\xfe\xff" + PUMP.encode("utf-16-be"))
    (folder / "stray.csv").write_text('Size 5",Name,Address\n1,a,2\n')
    (folder / "[old] {mac}.csv").write_bytes(PUMP.replace("\n", "\r").encode())
    (folder / "inches.csv").write_text("Register,Name,Data Type\n1,rack 19\" a,U16\n2,rack 20\" b,U16\n3,plain,U16\n")
    (folder / "broken lines.csv").write_bytes(
        b'Address;Name;Type\r\n1;"two\r\nlines; ""quoted""";U16\r\n\r\n2;plain;U16\r\n'
    )
    return str(folder)


def test_dialects(spark, docs):
    found = {r.file.rsplit("/", 1)[1]: (r.utf16, r.delimiter, r.width) for r in dialects(spark, docs).collect()}
    assert found == {
        "pump.csv": (False, ",", 8),
        "traps.csv": (False, ",", 9),
        "bom.csv": (False, ";", 8),
        "wide.csv": (True, "\t", 8),
        "big_endian.csv": (True, ",", 8),
        "broken%20lines.csv": (False, ";", 3),
        "stray.csv": (False, ",", 3),
        "%5Bold%5D%20%7Bmac%7D.csv": (False, ",", 8),
        "inches.csv": (False, ",", 3),
    }


PUMP_ROWS = [
    "1;1;32;U8;;Valve 1;valve_1;1.000000;0.000000;;1",
    "2;4;33;I16;;Inlet;inlet;0.125000;-40.000000;°C;4",
    "3;3;256;U32_W;;Runtime;runtime;1.000000;0.000000;h;4",
]
TRAP_ROWS = [
    "1;1;10_3_2;BITS;;Gate;gate;1.000000;0.000000;;1",
    "2;3;1024_12;STRING;;Depth;depth;25.000000;0.000000;;1",
    "3;4;12;F32;;Spare;spare;0.040000;0.000000;;1",
]


def test_documents_to_definitions(spark, docs):
    headers, records = read_delimited(spark, docs)
    p = params(spark, *[(m, "M", "X", 0) for m in ("pump", "traps", "bom", "wide", "big_endian", "broken lines", "[old] {mac}")])
    lines = definition_lines(run(headers, records, params=p), p).cache()
    head = "modbusRTU;Inverter;M;X;;;;;;;"
    for m in ("pump", "bom", "wide", "big_endian", "[old] {mac}"):
        assert lines_of(lines, m) == [head, *PUMP_ROWS], m
    found = {m: [r.cells[1] for r in rows] for m, rows in by_map(records).items()}
    assert found["inches"] == ['rack 19" a', 'rack 20" b', "plain"]
    assert {len(r.cells) for r in by_map(records)["stray"]} == {3}
    assert lines_of(lines, "traps") == [head, *TRAP_ROWS]
    assert lines_of(lines, "broken lines") == [
        head,
        '1;3;1;U16;;"two\nlines; ""quoted""";twolines_quoted;1.000000;0.000000;;1',
        "2;3;2;U16;;plain;plain;1.000000;0.000000;;1",
    ]


def test_short_rows_keep_their_factor_open(spark, tmp_path):
    """A cell that a row does not give is null, an empty one is not: only the latter has a factor."""
    body = 'Register,Name,"Unit",Access\n1,"a,b"\n2,c,"","r"\n3,d,,\n4,"e""f, g",V\n5,h,,rw,more,still\n'
    wide = body.replace("Access", "Access," + "n/a " * 3 + ",Multiplier").replace("d,,", "d,,,,")
    (tmp_path / "lines.csv").write_text(body)
    (tmp_path / "streamed.csv").write_text(body + '6,"i\nj, k"\n7,"l\nm",,\n')
    (tmp_path / "wide.csv").write_text(wide)
    (tmp_path / "wide_streamed.csv").write_text(wide + '6,"i\nj, k"\n7,"l\nm",,,,\n')
    (tmp_path / "wide16.csv").write_bytes(wide.encode("utf-16"))
    headers, records = read_delimited(spark, str(tmp_path))
    cells = {m: [r.cells for r in rows] for m, rows in by_map(records).items()}
    plain = [["1", "a,b", None, None], ["2", "c", "", "r"], ["3", "d", "", ""], ["4", 'e"f, g', "V", None], ["5", "h", "", "rw"]]
    assert cells["lines"] == plain
    assert cells["streamed"] == [*plain, ["6", "i\nj, k", None, None], ["7", "l\nm", "", ""]]
    assert [r[5] for r in cells["wide"]] == [None, None, "", None, "still"] and cells["wide16"] == cells["wide"]
    assert cells["wide_streamed"] == [*cells["wide"], ["6", "i\nj, k", *[None] * 4], ["7", "l\nm", *[""] * 4]]
    found = {(r.map_id, r.name): r.factor for r in extract(headers, records).collect()}
    assert found["wide", "a,b"] is None and found["wide", "d"] == "1.0" and found["wide_streamed", "l\nm"] == "1.0"
    short = tmp_path / "short"
    short.mkdir()
    (short / "s.csv").write_text("Register,Name,Multiplier\n" + "1,a\n" * 6 + "2,b,4\n")
    headers, records = read_delimited(spark, str(short))
    assert [r.factor for r in extract(headers, records).orderBy("record").collect()] == [None] * 6 + ["4.0"]


def test_simplified_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(SIMPLE)
    (tmp_path / "in" / "b.csv").write_text(TRAPS)
    (tmp_path / "in" / "c.csv").write_text(" NAME ;address;TYPE;x\nText;100;STR20;\n;;;y\n;;;\nLow;10;U16;\n")
    headers, records = read_delimited(spark, str(tmp_path / "in"), simplified=True)
    p = params(spark, ("a", "M", "X", 0), ("b", "M", "X", 0), ("c", "M", "X", 50))
    lines = definition_lines(generate(simplified(headers, records), p, order="record"), p).cache()
    head = "modbusRTU;Inverter;M;X;;;;;;;"
    assert lines_of(lines, "a") == [
        head,
        "1;3;7_9;STRING;;Serial text;serial_text;1.000000;0.000000;;1",
        "2;3;48;U64;;Total out;E_TOT;1000.000000;0.000000;kWh;4",
        "3;3;61;MAC;;Total out;total_out;1.000000;0.000000;;1",
    ]
    assert lines_of(lines, "b") == [head]
    assert lines_of(lines, "c") == [
        head,
        "1;3;150_20;STRING;;Text;text;1.000000;0.000000;;1",
        "2;3;60;U16;;Low;low;1.000000;0.000000;;1",
    ]
    write_definitions(lines, str(tmp_path / "out"))
    written = (tmp_path / "out" / "map_id=c").glob("part-*")
    assert "".join(f.read_text() for f in sorted(written)).splitlines() == lines_of(lines, "c")


def test_folders_by_slug(spark, tmp_path):
    """Maps that share a slug get names of their own; positions count across the files of a long map."""
    from regfleet.sinks.definition import file_names, read_definitions

    p = params(spark, ("a", "X & Y", "1", 0), ("b", "X + Y", "1", 0), ("c", "Z", "2", 0), ("c", "Z", "3", 0))
    names = {r.map_id: r.file for r in file_names(p).collect()}
    assert names["c"] == "z_2_definition" and names["a"].startswith("x___y_1_definition_") and len(set(names.values())) == 3
    n = 150_000
    lines = spark.range(n).select(F.lit("c").alias("map_id"), F.col("id").alias("line_ord"), F.col("id").cast("string").alias("line"))
    few = spark.createDataFrame([("a", 0, "head"), ("a", 1, "row"), ("d", 0, "unnamed")], lines.schema)
    write_definitions(lines.union(few), str(tmp_path / "out"), file_names(p))
    read = read_definitions(spark, str(tmp_path / "out"), "file")
    assert read.filter("file = 'z_2_definition' AND CAST(position AS STRING) = line").count() == n
    rest = sorted(map(tuple, read.filter("file != 'z_2_definition'").collect()))
    assert rest == sorted([(names["a"], 0, "head"), (names["a"], 1, "row"), ("d", 0, "unnamed")])


def test_plan_does_not_grow_with_the_widths(spark, tmp_path, monkeypatch):
    """Forty widths are read in a handful of scans, each row with the cells of its own header."""
    from regfleet.sources import delimited

    (tmp_path / "in").mkdir()
    for width in range(3, 43):
        rows = [[f"h{c}" for c in range(width)], [f"{width}-{c}" for c in range(width)], ["short"], ["x"] * (width + 2)]
        (tmp_path / "in" / f"w{width}.csv").write_text("\n".join(map(",".join, rows)) + "\n")
    parts = []
    monkeypatch.setattr(delimited, "union_tables", lambda tables, union=delimited.union_tables: parts.extend(tables) or union(tables))
    _, records = read_delimited(spark, str(tmp_path / "in"))
    found = by_map(records)
    assert len(parts) <= 5
    for width in range(3, 43):
        cells = [list(r.cells) for r in found[f"w{width}"]]
        assert cells == [[f"{width}-{c}" for c in range(width)], ["short"] + [None] * (width - 1), ["x"] * width]


def test_files_are_scanned_once_for_their_heads(spark, docs):
    """The first lines are cut to a few per file before anything is shuffled."""
    text = dialects(spark, docs)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "WindowGroupLimit" in text


def test_repeated_parameters_count_once(spark):
    header = spark.createDataFrame([("m", 0, ["Name", "Address"])], "map_id string, table_id int, header array<string>")
    records = spark.createDataFrame([("m", 0, 1, ["a", "10"])], "map_id string, table_id int, row_ord bigint, cells array<string>")
    p = params(spark, ("m", "M", "X", 7), ("m", "M", "X", 5))
    assert [r.info2 for r in run(header, records, params=p).collect()] == ["15"]


def test_xml_rows_of_two_names(spark, tmp_path):
    (tmp_path / "m.xml").write_text(
        '<map><coil no="1"><Name>A</Name><Addr>1</Addr></coil><word><Addr>2</Addr><Unit>V</Unit><Name>B</Name></word>'
        "<coil><Name>A</Name><Addr>1</Addr></coil><word><Name>A</Name><Addr>1</Addr></word></map>"
    )
    headers, records = read_xml(spark, str(tmp_path), ["coil", "word"])
    found = sorted((r.table_id, r.name, r.address, r.unit) for r in project_records(records, resolve_columns(source_columns(headers, records))).collect())
    assert found == [(0, "A", "1", None), (1, "B", "2", "V")]


def test_definition_headers(spark):
    """Defaults, one header for repeated parameters, a header for a map without any."""
    from regfleet.schemas import DEFINITION_COLUMNS

    rows = spark.createDataFrame([(m, 1, *["x"] * len(DEFINITION_COLUMNS)) for m in "ab"], ["map_id", "idx", *DEFINITION_COLUMNS])
    p = spark.createDataFrame([("a", "M", "X", None, "", "", 0)] * 2, PARAMETER_SCHEMA)
    lines = definition_lines(rows, p)
    assert lines_of(lines, "a")[0] == "modbusRTU;Inverter;M;X;;;;;;;" and lines_of(lines, "b")[0] == "modbusRTU;Inverter;;;;;;;;;"
    assert len(lines_of(lines, "a")) == len(lines_of(lines, "b")) == 2


def test_register_sink_round_trip(spark, docs, tmp_path):
    headers, records = read_delimited(spark, docs)
    registers = extract(headers, records)
    write_registers(registers.withColumn("extra", F.lit(1)), str(tmp_path / "out"))
    again = simplified(*read_delimited(spark, str(tmp_path / "out" / "*"), simplified=True, map_id=partition_value))
    columns = ["name", "address", "type", "register_type", "factor", "action"]
    before = registers.select("map_id", *columns).fillna("")
    after = again.select("map_id", *columns).fillna("")
    assert before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()


XML = """<map vendor="x"><info><a>1</a><b>2</b></info>
<row id="1"><Name> Power </Name><Address base="dec">0010</Address><Type>U16</Type></row>
<row id="2"><Name>Old</Name><Name>Voltage</Name><Address>12</Address><Sub><x>1</x></Sub></row>
<row id="3"><Type>U16</Type><Address>0010</Address><Name>Power</Name></row>
<row><Name>lonely</Name></row></map>"""
NESTED = """<map><row><Name>Level</Name><Address>7</Address><Type><sym>U16</sym></Type></row></map>"""
ENTITY = """<?xml version="1.0"?><!DOCTYPE root [<!ENTITY xxe SYSTEM "file:///etc/hostname">]>
<root><row><Name>&xxe;</Name><Address>100</Address><Type>U16</Type></row></root>"""


def test_xml(spark, tmp_path):
    (tmp_path / "m.xml").write_text(XML)
    (tmp_path / "entity.xml").write_text(ENTITY)
    (tmp_path / "nested.xml").write_text(NESTED)
    headers, records = read_xml(spark, str(tmp_path), "row")
    rows = {(r.map_id, r.name, r.address, r.type) for r in extract(headers, records).collect()}
    assert rows == {("m", "Power", "10", "U16"), ("m", "Voltage", "12", "U16"), ("nested", "Level", "7", "U16")}


def test_mapping_and_fuzzy_headers(spark, tmp_path):
    (tmp_path / "all.json").write_text('{"Address": "Reg Addr", "Name": "Description", "Type": "Missing"}')
    header = [
        ("m", 0, ["Reg Addr", "Description", "Data Type", "Unit"]),
        ("m", 1, ["Register Address", "Variable Name", "Data Type", "Scale Factor"]),
        ("m", 2, ["Name", "Tag", "RegisterType", "Address", "Type", "Factor", "Offset", "Unit", "Action", "ScaleFactor"]),
        ("m", 3, ["Offset", "Parameter", "Parameter"]),
        ("m", 4, ["name", "register", "bit", "absent"]),
    ]
    headers = spark.createDataFrame(header, "map_id string, table_id int, header array<string>")
    records = spark.createDataFrame(
        [(m, t, i, ["x"] * (len(h) - (t == 4))) for m, t, h in header for i in range(7)],
        "map_id string, table_id int, row_ord bigint, cells array<string>",
    )
    columns = source_columns(headers, records)
    mapping = read_mapping(spark, str(tmp_path / "all.json"))
    got = {r.table_id: r.asDict() for r in resolve_columns(columns, mapping).collect()}
    pick = lambda t, *names: tuple(got[t][n] for n in names)
    assert pick(0, "address", "name", "type", "unit", "factor") == (0, 1, 2, 3, None)
    assert pick(1, "address", "name", "type", "factor", "scale_factor") == (0, 1, 2, 3, None)
    order = ["name", "tag", "register_type", "address", "type", "factor", "offset_raw", "unit", "action", "scale_factor"]
    assert pick(2, *order) == tuple(range(10))
    assert pick(3, "address", "name", "offset_raw") == (0, 2, None)
    assert pick(4, "address", "name", "start_bit") == (1, 0, 2)


def test_cell_grids(spark):
    cells = [
        ("m", 1, "A", 1, r, c, v)
        for r, row in enumerate([["Addr\ness ", "Name"], ["1", "a\nb ", "surplus"], ["2"]])
        for c, v in enumerate(row)
    ] + [("m", 2, "B", 2, 0, 0, "only header")]
    df = spark.createDataFrame(
        cells, "map_id string, table_id int, table_name string, page_number int, row_ord bigint, col_ord int, value string"
    )
    headers, records = grid_records(df, style="page")
    assert [r.header for r in headers.collect()] == [["Addr ess", "Name"]]
    assert [r.cells for r in records.orderBy("row_ord").collect()] == [["1", "a b"], ["2"]]
    assert grid_records(df)[1].orderBy("row_ord").first().cells == ["1", "a\nb "]
    assert select_tables(df, sheet="B").count() == 1 and select_tables(df, pages=[1]).count() == 6


def test_repeats_keep_first(spark):
    df = spark.createDataFrame(
        [("m", 0, 5, ["a", None]), ("m", 0, 2, ["a", None]), ("m", 0, 3, ["a", ""]), ("n", 0, 9, ["a", None])],
        "map_id string, table_id int, row_ord bigint, cells array<string>",
    )
    assert {(r.map_id, r.row_ord) for r in drop_repeats(df).collect()} == {("m", 2), ("m", 3), ("n", 9)}


def test_plain_files_are_read_in_splits(spark, tmp_path, monkeypatch):
    """Any number of tasks reads a file of one record a line; the others are streamed; records are the same."""
    from regfleet.sources import delimited

    (tmp_path / "in").mkdir()
    rows = [["Register", "Name", "Info"], *[[str(k), f'pipe, {k} 5" é', "x" if k % 7 else ""] for k in range(2000)]]
    quoted = [",".join('"' + c.replace('"', '""') + '"' if "," in c else c for c in r) for r in rows]
    texts = {
        "lf": "\n".join(quoted), "crlf": "\ufeff" + "\r\n".join(quoted) + "\r\n", "cr": "\r".join(quoted),
        "blank": "\n\n".join(quoted) + "\n  \n", "mixed": "\n".join(quoted[:9]) + "\r\n" + "\r\n".join(quoted[9:]),
        "breaks": "\n".join(quoted) + '\n9,"a\nb,c",\n', "stray": "\n".join(quoted) + '\n9,"a"b,\n',
    }
    for name, text in texts.items():
        (tmp_path / "in" / f"{name}.csv").write_bytes(text.encode())
    (tmp_path / "in" / "utf16.csv").write_bytes("\n".join(quoted).encode("utf-16"))
    streamed = []

    def whole(spark, files, *args, read=delimited._whole_files):
        streamed.extend(f.rsplit("/", 1)[1].split(".")[0] for f in files)
        return read(spark, files, *args)

    monkeypatch.setattr(delimited, "_whole_files", whole)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        _, records = read_delimited(spark, str(tmp_path / "in"))
        found = by_map(records)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(streamed) == ["breaks", "cr", "mixed", "stray", "utf16"]
    more = {"blank": [["  ", None, None]], "breaks": [["9", "a\nb,c", ""]]}
    for name in [*texts.keys() - {"mixed"}, "utf16"]:
        cells = [list(r.cells) for r in found[name]]
        assert cells[:2000] == rows[1:] and (name == "stray" or cells[2000:] == more.get(name, []))

def test_headers_are_resolved_once_per_form(spark, monkeypatch):
    """10,000 maps of two header lists; one map and then all maps wish for another name column."""
    lists = [["Description", "Reg", "Format", "Label"], ["Scale", "Name", "Address"]]
    heads = F.array(*[F.array(*map(F.lit, names)) for names in lists])
    maps = spark.range(10000).select(F.format_string("m%05d", "id").alias("map_id"), (F.col("id") % 2).cast("int").alias("kind"))
    headers = maps.select("map_id", F.lit(0).alias("table_id"), F.get(heads, "kind").alias("header"))
    records = headers.select("map_id", "table_id", F.lit(0).cast("bigint").alias("row_ord"), F.col("header").alias("cells"))
    sizes = []
    resolve = headers_module._resolve

    def counted(forms):
        sizes.append(forms.count())
        return resolve(forms)

    monkeypatch.setattr(headers_module, "_resolve", counted)
    columns = source_columns(headers, records)
    for owner, names, forms in ((None, {3, 1}, 2), ("m00002", {0, 1, 3}, 3)):
        wishes = [("m00002", "Name", "Label")] if owner else [(None, "Name", "Label")]
        mapping = spark.createDataFrame(wishes, "map_id string, target string, source string")
        found = {r.map_id: r.asDict() for r in resolve_columns(columns, mapping).collect()}
        assert len(found) == 10000 and sizes.pop() == forms
        assert {r["name"] for r in found.values()} == names
        assert {found[f"m{n:05d}"]["address"] for n in range(0, 10000, 2)} == {1}
        assert found["m00002"]["name"] == 3 and found["m00004"]["name"] == (0 if owner else 3)
        alone = columns.filter("map_id IN ('m00002', 'm00003')")
        for r in resolve_columns(alone, mapping).collect():
            assert r.asDict() == found[r.map_id]
        sizes.clear()


def test_maps_without_names_are_refused(spark):
    from regfleet.plans.diagnostics import refusals
    from regfleet.sinks.definition import accepted

    p = spark.createDataFrame(
        [("a", "M", "X", None, "", "", 0), ("b", "", "X", None, "", "", 0), ("c", None, None, None, "", "", 0)], PARAMETER_SCHEMA
    )
    lines = spark.createDataFrame([(m, n, "x") for m in "abcd" for n in range(3)], "map_id string, line_ord bigint, line string")
    assert sorted((r.map_id, r.line_ord) for r in accepted(lines, p).collect()) == [("a", 0), ("a", 1), ("a", 2)]
    found = sorted((r.map_id, r.code, r.severity, r.n) for r in refusals(lines, p).collect())
    man, mod = "MISSING_MANUFACTURER", "MISSING_MODEL"
    assert found == [(m, c, "refused", 1) for m, c in [("b", man), ("c", man), ("c", mod), ("d", man), ("d", mod)]]
    assert refusals(lines.limit(0), p).isEmpty() and accepted(lines, p.limit(0)).isEmpty()

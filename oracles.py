"""Plain SQL for the checking engine, one text per registered query.

Written rule by rule from the rules themselves, over whole tables; none of it
shares code with the package except the texts that define the input tables.
"""

from regfleet.fixtures import (
    ADDRESS_RULE,
    BIT_LENGTH,
    DOCUMENT_ID,
    FLEET_NAME,
    FLEET_TYPE,
    HEADER_VARIANTS,
    INCOMPLETE,
    INCOMPLETE_RULES,
    LONG_ADDRESS,
    MIXED_NAME,
    MIXED_TAG,
    PARAMETER_RULES,
    POINT,
    ROW_RULES,
    START_BIT,
    TYPE_RULE,
    VARIANT,
)

COLUMNS = ["name", "tag", "register_type", "address", "type", "factor", "offset_raw", "unit", "action", "scale_factor"]

def _registers(map_id):
    return f"""
numbered AS (SELECT {map_id} AS map_id, p_partkey AS k, p_name, p_type,
  row_number() OVER (PARTITION BY {map_id} ORDER BY p_partkey) + 1 AS line_num FROM part),
raw AS (SELECT {ROW_RULES} FROM (SELECT *, {ADDRESS_RULE} AS addr, {TYPE_RULE} AS dtype FROM numbered))"""


REGISTERS = _registers("p_brand")
DOCUMENTS = _registers(DOCUMENT_ID)

FLEET = f"""
numbered AS (SELECT CAST(l_suppkey AS STRING) AS map_id, l_partkey + l_linenumber AS k, {FLEET_NAME} AS p_name,
  {FLEET_TYPE} AS p_type, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
  l_shipdate, l_extendedprice, l_quantity) + 1 AS line_num FROM lineitem),
raw AS (SELECT {ROW_RULES} FROM (SELECT *, {ADDRESS_RULE} AS addr, {TYPE_RULE} AS dtype FROM numbered))"""

PARAMS = f"params AS (SELECT {PARAMETER_RULES} FROM (SELECT DISTINCT map_id FROM raw))"


def n_type(x):
    t = f"lower(trim({x}))"
    cases = []
    for width in (64, 32, 16, 8):
        cases.append(f"WHEN regexp_matches({t}, 'unsigned integer {width}|unsigned int {width}|uint{width}') THEN 'U{width}'")
        cases.append(f"WHEN regexp_matches({t}, 'signed integer {width}|signed int {width}|int{width}') THEN 'I{width}'")
    code = f"""CASE {' '.join(cases)} WHEN regexp_matches({t}, 'float64|double') THEN 'F64'
      WHEN regexp_matches({t}, 'float32|float') THEN 'F32' END"""
    suffix = f"""CASE WHEN regexp_matches({t}, '_wb|swap|big endian') THEN '_WB' WHEN regexp_matches({t}, '_b|big') THEN '_B'
      WHEN regexp_matches({t}, '_w|word') THEN '_W' ELSE '' END"""
    rest = f"coalesce(nullif(upper(regexp_replace({t}, '[^a-z0-9_]+', '', 'g')), ''), 'U16')"
    return f"coalesce(({code}) || ({suffix}), {rest})"


def valid_type(x):
    return (
        f"(upper({x}) IN ('STRING','BITS','IP','IPV6','MAC') OR "
        f"regexp_full_match(upper({x}), '([UI](8|16|32|64)|F(32|64))(_(W|B|WB))?|STR[0-9]+'))"
    )


def n_part(x):
    a = f"regexp_replace(trim({x}), '^(\\d{{1,3}}),(\\d{{3}})$', '\\1\\2')"
    return f"""(CASE WHEN {a} = '' THEN ''
      WHEN regexp_full_match(lower({a}), '0x[0-9a-f]+') THEN CAST(TRY_CAST(lower({a}) AS BIGINT) AS VARCHAR)
      WHEN regexp_full_match(lower({a}), '[0-9a-f]+h') THEN CAST(TRY_CAST('0x' || lower({a})[:-2] AS BIGINT) AS VARCHAR)
      WHEN regexp_full_match({a}, '[+-]?[0-9]+') THEN CAST(TRY_CAST({a} AS BIGINT) AS VARCHAR)
      WHEN regexp_full_match(lower({a}), '[0-9a-f]+') THEN CAST(TRY_CAST('0x' || lower({a}) AS BIGINT) AS VARCHAR)
      ELSE {a} END)"""


def n_offset(x, offset):
    parts = f"[{n_part('q')} for q in string_split({x}, '_')]"
    base = f"({parts})[1]"
    moved = f"CASE WHEN regexp_full_match({base}, '-?[0-9]+') THEN CAST(CAST({base} AS BIGINT) + ({offset}) AS VARCHAR) ELSE {base} END"
    return f"CASE WHEN {x} = '' THEN '' ELSE array_to_string(list_concat([{moved}], ({parts})[2:]), '_') END"


def valid_address(x, dtype):
    base = "([0-9A-F]+|0X[0-9A-F]+|[0-9A-F]+H|-?[0-9]+)"
    return f"""CASE upper({dtype}) WHEN 'STRING' THEN regexp_full_match(upper({x}), '{base}_[0-9]+')
      WHEN 'BITS' THEN regexp_full_match(upper({x}), '{base}_[0-9]+_[0-9]+') ELSE regexp_full_match(upper({x}), '{base}') END"""


def str_type(dtype):
    return f"CASE WHEN regexp_full_match({dtype}, 'STR[0-9]+') THEN 'STRING' ELSE {dtype} END"


def str_address(dtype, address):
    return f"""CASE WHEN regexp_full_match({dtype}, 'STR[0-9]+') AND NOT contains({address}, '_')
      THEN {address} || '_' || CAST(CAST(substr({dtype}, 4) AS BIGINT) AS VARCHAR) ELSE {address} END"""


def count_registers(dtype, address):
    return f"""CAST(CASE WHEN {dtype} IN ('U32','I32','F32','IP') OR regexp_full_match({dtype}, '[UIF]32_(W|B|WB)') THEN 2
      WHEN regexp_full_match({dtype}, '[UIF]64(_(W|B|WB))?') THEN 4 WHEN {dtype} = 'MAC' THEN 3 WHEN {dtype} = 'IPV6' THEN 8
      WHEN {dtype} = 'STRING' THEN coalesce(ceil(TRY_CAST(string_split({address}, '_')[2] AS BIGINT) / 2.0), 0) ELSE 1 END AS BIGINT)"""


FLOAT = "'[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'"


def to_double(x):
    return f"(CASE WHEN regexp_full_match(trim({x}), {FLOAT}) THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def n_number(x, default):
    first, second = (to_double(f"string_split({x}, '/')[{i}]") for i in (1, 2))
    us, eu = to_double(f"replace({x}, ',', '')"), to_double(f"replace(replace({x}, '.', ''), ',', '.')")
    return f"""coalesce(CASE WHEN contains({x}, '/') THEN {first} / nullif({second}, 0)
      WHEN contains({x}, ',') AND contains({x}, '.') THEN CASE WHEN strpos({x}, ',') < strpos({x}, '.') THEN {us} ELSE {eu} END
      WHEN regexp_full_match({x}, '-?[0-9]{{1,3}}(,[0-9]{{3}})+') THEN {us}
      WHEN contains({x}, ',') THEN {eu} ELSE {to_double(x)} END, {default}::DOUBLE)"""


def n_scale(x):
    return f"coalesce(CAST(trunc({to_double(x)}) AS INTEGER), 0)"


def coefficient(factor, scale):
    return f"({n_number(factor, 1.0)} * CAST('1e' || CAST({n_scale(scale)} AS VARCHAR) AS DOUBLE))"


def register_code(x):
    return f"""CASE WHEN lower({x}) IN ('coil','coils') THEN '1' WHEN lower({x}) = 'discrete input' THEN '2'
      WHEN lower({x}) IN ('holding register','holding') THEN '3' WHEN lower({x}) IN ('input register','input') THEN '4'
      WHEN {x} IN ('1','2','3','4') THEN {x} ELSE '3' END"""


def known_type(x):
    return f"(lower({x}) IN ('','coil','coils','discrete input','holding register','holding','input register','input','1','2','3','4'))"


def action_code(x):
    return f"""CASE WHEN upper({x}) IN ('R','READ','4') THEN '4' WHEN upper({x}) IN ('RW','W','WRITE','1') THEN '1'
      WHEN {x} IN ('0','2','6','7','8','9') THEN {x} ELSE '1' END"""


def tag_base(x):
    slug = f"trim(regexp_replace(regexp_replace(replace(lower({x}), ' ', '_'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')"
    return f"CASE WHEN {slug} = '' THEN 'var' WHEN regexp_matches({slug}, '^[0-9]') THEN 'v_' || {slug} ELSE {slug} END"


def staged(source="raw", offset="0"):
    """CTEs from ``source`` rows to judged rows and their survivors."""
    blank = " AND ".join(f"{c} = ''" for c in COLUMNS)
    return f"""
typed AS (SELECT *, {n_type('type')} AS dtype, {offset} AS address_offset FROM {source}),
addressed AS (SELECT *, {n_offset(f'({str_address("dtype", "address")})', 'address_offset')} AS info2, {str_type('dtype')} AS info3 FROM typed),
staged AS (SELECT *, CASE WHEN {blank} THEN 'BLANK' WHEN name = '' AND address = '' THEN 'MISSING_NAME_AND_ADDRESS'
    WHEN NOT {valid_type('dtype')} THEN 'INVALID_TYPE' WHEN NOT ({valid_address('info2', 'info3')}) THEN 'INVALID_ADDRESS'
    ELSE 'OK' END AS status FROM addressed),
kept AS (SELECT *, {register_code('register_type')} AS info1, {tag_base('name')} AS base FROM staged WHERE status = 'OK'),
tagged AS (SELECT * REPLACE (CASE WHEN tag <> '' OR name = '' THEN tag
    WHEN row_number() OVER (PARTITION BY map_id, base, tag <> '' OR name = '' ORDER BY line_num) = 1 THEN base
    ELSE base || '_' || CAST(row_number() OVER (PARTITION BY map_id, base, tag <> '' OR name = '' ORDER BY line_num) - 1 AS VARCHAR)
    END AS tag) FROM kept),
spans AS (SELECT *, CAST(string_split(info2, '_')[1] AS BIGINT) AS reg_start,
    CAST(string_split(info2, '_')[1] AS BIGINT) + {count_registers('info3', 'info2')} - 1 AS reg_end FROM kept),
pairs AS (SELECT a.map_id, a.info1, a.line_num, a.name, a.reg_start, a.reg_end, b.line_num AS ref_line, b.name AS ref_name,
    b.reg_start AS ref_start, b.reg_end AS ref_end
  FROM spans a JOIN spans b ON a.map_id = b.map_id AND a.info1 = b.info1 AND b.line_num < a.line_num
    AND greatest(a.reg_start, b.reg_start) <= least(a.reg_end, b.reg_end)
  WHERE NOT (a.info3 = 'BITS' AND b.info3 = 'BITS' AND a.reg_start = b.reg_start)),
definition AS (SELECT map_id, row_number() OVER (PARTITION BY map_id ORDER BY line_num) AS idx, info1, info2, info3, '' AS info4,
    name, tag, printf('%.6f', {coefficient('factor', 'scale_factor')}) AS coef_a,
    printf('%.6f', {n_number('offset_raw', 0.0)}) AS coef_b, unit, {action_code('action')} AS action, line_num FROM tagged)"""


OFFSETS = "(SELECT any_value(p.address_offset) FROM params p WHERE p.map_id = {}.map_id)"
WITH_OFFSET = staged("raw", OFFSETS.format("raw"))


def quoted(x):
    return f"""CASE WHEN regexp_matches({x}, '[;"\\r\\n]') THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END"""


LINES = f"""lines AS (
  SELECT map_id, CAST(0 AS BIGINT) AS line_ord, {" || ';' || ".join(quoted(c) for c in ('protocol', 'category', 'manufacturer', 'model', 'forced_write'))}
    || ';;;;;;' AS line FROM params
  UNION ALL SELECT map_id, idx, {" || ';' || ".join(quoted(c) for c in ('CAST(idx AS VARCHAR)', 'info1', 'info2', 'info3', 'info4', 'name', 'tag', 'coef_a', 'coef_b', 'unit', 'action'))} FROM definition)"""

DIAGNOSTICS = f"""findings AS (
  SELECT map_id, line_num, status AS code, 'skip' AS severity, name, CASE status WHEN 'INVALID_TYPE' THEN type || ' -> ' || dtype
    WHEN 'INVALID_ADDRESS' THEN info2 || ' as ' || info3 ELSE '' END AS detail, CAST(NULL AS BIGINT) AS ref_line, CAST(1 AS BIGINT) AS n,
    CAST(NULL AS VARCHAR) AS ref_name, CAST(NULL AS VARCHAR) AS ref_range
    FROM staged WHERE status NOT IN ('OK', 'BLANK')
  UNION ALL SELECT map_id, line_num, 'NEGATIVE_ADDRESS', 'warning', name, info2, NULL, 1, NULL, NULL FROM staged
    WHERE status IN ('OK', 'INVALID_ADDRESS') AND regexp_full_match(string_split(info2, '_')[1], '-[0-9]+')
  UNION ALL SELECT map_id, line_num, 'UNKNOWN_REGISTER_TYPE', 'warning', name, register_type, NULL, 1, NULL, NULL FROM kept WHERE NOT {known_type('register_type')}
  UNION ALL SELECT * FROM (SELECT map_id, line_num, 'DUPLICATE_NAME', 'warning', name, name, min(line_num) OVER (PARTITION BY map_id, name) AS f, 1, NULL, NULL FROM kept WHERE name <> '') WHERE f < line_num
  UNION ALL SELECT * FROM (SELECT map_id, line_num, 'DUPLICATE_TAG', 'warning', name, tag, min(line_num) OVER (PARTITION BY map_id, tag) AS f, 1, NULL, NULL FROM tagged WHERE tag <> '') WHERE f < line_num
  UNION ALL SELECT map_id, line_num, 'ADDRESS_OVERLAP', 'warning', any_value(name), any_value(reg_start || '-' || reg_end), min(ref_line), count(*),
    arg_min(ref_name, ref_line), arg_min(ref_start || '-' || ref_end, ref_line) FROM pairs GROUP BY map_id, line_num)"""




def run_ctes(source, offset, order="line_num"):
    """CTEs of the one-step run: extraction rules first, then the same chain again."""
    return f"""
extracted0 AS (SELECT *, {n_type('type')} AS type1, {offset} AS off FROM {source} WHERE NOT (name = '' AND address = '')),
extracted AS (SELECT map_id, row_number() OVER (PARTITION BY map_id ORDER BY {order}) + 1 AS line_num, name, tag,
  coalesce(nullif(register_type, ''), 'Holding Register') AS register_type, {n_offset('address', 'off')} AS address, type1 AS type,
  factor, offset_raw, unit, action, scale_factor FROM extracted0),
""" + staged("extracted", "0").strip()


def select(ctes, body):
    return f"WITH {ctes.strip().strip(',')} {body}"


SLUG = """lower(regexp_replace(manufacturer, '[^a-zA-Z0-9]', '_', 'g')) || '_' || lower(regexp_replace(model, '[^a-zA-Z0-9]', '_', 'g')) || '_definition'"""


def long_moved(offset):
    """A long decimal text moved by a number that its last 18 digits can hold."""
    low = "CAST(right(decimal, 18) AS BIGINT)"
    return f"""left(decimal, -18) || lpad(CAST(CASE WHEN decimal LIKE '-%' THEN {low} - ({offset}) ELSE {low} + ({offset}) END AS VARCHAR), 18, '0')"""


R = REGISTERS
D = DOCUMENTS
RP = f"{REGISTERS}, {PARAMS}"
ALL = ", ".join(COLUMNS)


def oracle_sql():
    once, twice = n_type("type"), n_type("once")
    part = n_part("string_split(address, '_')[1]")
    bits = f"SELECT *, {START_BIT} AS start_bit, {BIT_LENGTH} AS length, {once} AS dtype FROM raw"
    composed = """CASE WHEN dtype = 'BITS' AND start_bit <> '' THEN string_split(address, '_')[1] || '_' || start_bit || '_'
              || CASE length WHEN '' THEN '1' ELSE length END ELSE address END"""
    header_values = ", ".join(
        f"({v}, '{target}', CAST({i} AS INTEGER))" for v, h in HEADER_VARIANTS.items() for i, target in enumerate(COLUMNS)
    )
    mixed = f"""numbered AS (SELECT p_brand AS map_id, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS line_num FROM part),
      rows AS (SELECT map_id, line_num, {MIXED_NAME} AS name, {MIXED_TAG} AS tag FROM numbered),
      based AS (SELECT *, {tag_base('name')} AS base FROM rows),
      walk AS (SELECT DISTINCT map_id, CAST(1 AS BIGINT) AS line_num, CAST([] AS VARCHAR[]) AS used, CAST('' AS VARCHAR) AS tag FROM based
        UNION ALL SELECT map_id, line_num, list_append(used, tag), tag FROM (SELECT r.map_id, r.line_num, w.used,
          CASE WHEN r.tag <> '' THEN r.tag ELSE ([c for c in [CASE WHEN i = 0 THEN r.base ELSE r.base || '_' || CAST(i AS VARCHAR) END
            for i in range(0, len(w.used) + 1)] if NOT list_contains(w.used, c)])[1] END AS tag
          FROM walk w JOIN based r ON r.map_id = w.map_id AND r.line_num = w.line_num + 1))"""
    sql = {
        "reg_type_normalize": select(
            f"{R}, a AS (SELECT *, {once} AS once FROM raw)",
            f"SELECT map_id, line_num, type, once, {twice} AS twice, {valid_type('once')} AS valid_once, {valid_type(f'({twice})')} AS valid_twice FROM a",
        ),
        "reg_address_normalize": select(
            f"{R}, a AS (SELECT map_id, line_num, address, {n_type('type')} AS dtype, {part} AS first_part, {n_offset('address', '0')} AS off_none, {n_offset('address', '50')} AS off_up, {n_offset('address', '-50000')} AS off_down FROM raw)",
            f"SELECT map_id, line_num, address, first_part, off_none, off_up, off_down, regexp_matches(off_down, '^-[0-9]') AS negative, {valid_address('off_none', 'dtype')} AS valid FROM a",
        ),
        "reg_str_expand": select(
            f"{R}, a AS (SELECT *, {once} AS dtype FROM raw)",
            f"SELECT map_id, line_num, {str_type('dtype')} AS type, {str_address('dtype', 'address')} AS address FROM a",
        ),
        "reg_bits_compose": select(
            f"{R}, a AS ({bits})",
            f"SELECT map_id, line_num, dtype, {composed} AS address FROM a",
        ),
        "reg_register_count": select(
            f"{R}, {staged()}", f"SELECT map_id, line_num, info3, info2, {count_registers('info3', 'info2')} AS registers FROM kept"
        ),
        "reg_numeric_parse": select(
            R, f"SELECT map_id, line_num, {n_number('factor', 1.0)} AS factor, {n_number('offset_raw', 0.0)} AS offset_value, {n_scale('scale_factor')} AS exponent FROM raw"
        ),
        "reg_coefficients": select(
            R, f"SELECT map_id, line_num, printf('%.6f', {coefficient('factor', 'scale_factor')}) AS coef_a, printf('%.6f', {n_number('offset_raw', 0.0)}) AS coef_b FROM raw"
        ),
        "reg_codes": select(
            R,
            f"SELECT map_id, line_num, {register_code('register_type')} AS info1, {known_type('register_type')} AS known, {action_code('action')} AS action, coalesce(nullif(register_type, ''), 'Holding Register') AS filled FROM raw",
        ),
        "reg_row_status": select(f"{RP}, {WITH_OFFSET}", "SELECT map_id, line_num, status, info2, info3 FROM staged"),
        "reg_tag_base": select(R, f"SELECT map_id, line_num, name, {tag_base('name')} AS base FROM raw"),
        "reg_tag_allocate": select(f"{R}, {staged()}", "SELECT map_id, line_num, tag FROM tagged"),
        "reg_tag_mixed": f"WITH RECURSIVE {mixed} SELECT map_id, line_num, tag FROM walk WHERE line_num > 1",
        "reg_duplicate_names": select(
            f"{R}, {staged()}",
            "SELECT * FROM (SELECT map_id, line_num, name, min(line_num) OVER (PARTITION BY map_id, name) AS ref_line FROM kept WHERE name <> '') WHERE ref_line < line_num",
        ),
        "reg_duplicate_tags": select(
            f"{R}, {staged()}",
            "SELECT * FROM (SELECT map_id, line_num, tag, min(line_num) OVER (PARTITION BY map_id, tag) AS ref_line FROM tagged WHERE tag <> '') WHERE ref_line < line_num",
        ),
        "reg_overlaps": select(f"{R}, {staged()}", "SELECT * FROM pairs"),
        "reg_overlap_counts": select(
            f"{R}, {staged()}",
            "SELECT map_id, info1, line_num, count(*) AS n, min(ref_line) AS ref_line FROM pairs GROUP BY map_id, info1, line_num",
        ),
        "reg_diagnostics": select(f"{RP}, {WITH_OFFSET}, {DIAGNOSTICS}", "SELECT * FROM findings"),
        "reg_diagnostic_counts": select(
            f"{RP}, {WITH_OFFSET}, {DIAGNOSTICS}",
            "SELECT map_id, code, severity, count(*) AS rows, CAST(sum(n) AS BIGINT) AS warnings FROM findings GROUP BY map_id, code, severity",
        ),
        "reg_definition": select(f"{RP}, {WITH_OFFSET}", "SELECT * FROM definition"),
        "reg_definition_lines": select(f"{RP}, {WITH_OFFSET}, {LINES}", "SELECT * FROM lines"),
        "reg_definition_files": select(
            f"{RP}, {WITH_OFFSET}, {LINES}, slugs AS (SELECT map_id, {SLUG} AS slug FROM params)",
            """SELECT CASE WHEN count(DISTINCT map_id) OVER (PARTITION BY slug) > 1 THEN slug || '_' || sha256(map_id)[:12] ELSE slug END AS file,
              line_ord AS position, line FROM lines JOIN slugs USING (map_id)""",
        ),
        "reg_refused_maps": select(
            f"{RP}, {WITH_OFFSET}, stated AS (SELECT {INCOMPLETE_RULES.replace('STRING', 'VARCHAR')} FROM params WHERE {INCOMPLETE})",
            """SELECT p.map_id, CASE WHEN coalesce(s.manufacturer, '') = '' OR coalesce(s.model, '') = '' THEN 0 ELSE 1 + coalesce(d.n, 0) END::BIGINT AS lines,
              concat_ws(',', CASE WHEN coalesce(s.manufacturer, '') = '' THEN 'MISSING_MANUFACTURER' END,
                CASE WHEN coalesce(s.model, '') = '' THEN 'MISSING_MODEL' END) AS findings
            FROM params p LEFT JOIN stated s USING (map_id) LEFT JOIN (SELECT map_id, count(*) AS n FROM definition GROUP BY 1) d USING (map_id)""",
        ),
        "reg_file_slug": select(
            RP,
            f"SELECT map_id, {SLUG} AS slug FROM params",
        ),
        "reg_header_detect": select(
            R,
            f"SELECT m.map_id, t.target, t.ordinal FROM (SELECT DISTINCT map_id, {VARIANT} AS variant FROM raw) m JOIN (VALUES {header_values}) t(variant, target, ordinal) USING (variant)",
        ),
        "reg_header_mapping": select(
            R,
            f"""SELECT m.map_id, t.target, CAST(CASE WHEN t.target = 'factor' AND m.variant IN (1, 3) THEN 9 WHEN t.target = 'scale_factor' AND m.variant IN (1, 3) THEN NULL
              ELSE t.ordinal END AS INTEGER) AS ordinal
              FROM (SELECT DISTINCT map_id, {VARIANT} AS variant FROM raw) m JOIN (VALUES {header_values}) t(variant, target, ordinal) USING (variant)
              WHERE NOT (t.target = 'scale_factor' AND m.variant IN (1, 3))""",
        ),
        "reg_mapping_files": select(
            R,
            f"""SELECT map_id, line_num - 1 AS row_ord, name, CASE WHEN {VARIANT} < 3 THEN unit ELSE tag END AS tag, register_type, address, type,
              CASE WHEN {VARIANT} = 3 THEN scale_factor ELSE factor END AS factor, offset_raw, CASE WHEN {VARIANT} < 3 THEN tag ELSE unit END AS unit,
              action, CASE WHEN {VARIANT} < 3 THEN scale_factor END AS scale_factor FROM raw""",
        ),
        "reg_multi_table": select(f"{R}, {run_ctes('raw', '0', 'line_num % 2, line_num')}", "SELECT * FROM definition"),
        "reg_extract_bits": select(
            f"{RP}, a AS ({bits}), b AS (SELECT *, {composed} AS whole, {OFFSETS.format('a')} AS off FROM a WHERE NOT (name = '' AND address = ''))",
            f"""SELECT map_id, row_number() OVER (PARTITION BY map_id ORDER BY line_num) + 1 AS line_num, name, dtype AS type,
              {n_offset('whole', 'off')} AS address FROM b""",
        ),
        "reg_long_addresses": select(
            f"""{R}, a AS (SELECT map_id, line_num, {LONG_ADDRESS} AS address FROM raw),
              b AS (SELECT *, CASE WHEN address LIKE '0x%' THEN CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(substr(address, 3), ''),
                lambda c: (strpos('0123456789ABCDEF', c) - 1)::HUGEINT)), lambda x, y: x * 16 + y) AS VARCHAR) ELSE address END AS decimal FROM a)""",
            f"""SELECT map_id, line_num, address, decimal, {long_moved(50)} AS off_up, {long_moved(-50000)} AS off_down, 'OK' AS status,
              decimal AS info2 FROM b""",
        ),
        "reg_cell_grid": select(R, f"SELECT map_id, line_num - 1 AS row_ord, {ALL} FROM raw"),
        "reg_select_pages": select(R, f"SELECT map_id, line_num - 1 AS row_ord, {ALL} FROM raw"),
        "reg_extract": select(
            f"{RP}, {run_ctes('raw', OFFSETS.format('raw'))}",
            f"SELECT map_id, line_num, name, tag, register_type, address, type, {n_number('factor', 1.0)} AS factor, offset_raw, unit, action, scale_factor FROM extracted",
        ),
        "reg_run": select(f"{RP}, {run_ctes('raw', OFFSETS.format('raw'))}", "SELECT * FROM definition"),
        "reg_csv_roundtrip": select(D, f"SELECT map_id, line_num, {ALL} FROM raw"),
        "reg_simplified_csv": select(f"{D}, {staged()}", "SELECT map_id, line_num, status, info2, info3 FROM staged"),
        "reg_register_files": select(f"{D}, {run_ctes('raw', '0')}", "SELECT * FROM definition"),
        # Only child tags found in the first five distinct records of a map exist.
        "reg_xml_roundtrip": select(
            f"""{D}, placed AS (SELECT *, CASE WHEN {POINT} THEN 1 ELSE 0 END AS table_id FROM raw),
              distinct_rows AS (SELECT map_id, {ALL}, min(table_id) AS table_id, arg_min(line_num, (table_id, line_num)) AS line_num FROM placed
                WHERE {" + ".join(f"CAST({c} <> '' AS INTEGER)" for c in COLUMNS)} >= 2 GROUP BY map_id, {ALL}),
              heads AS (SELECT map_id, table_id, {", ".join(f"bool_or({c} <> '') AS has_{c}" for c in COLUMNS)} FROM
                (SELECT *, row_number() OVER (PARTITION BY map_id, table_id ORDER BY line_num) AS n FROM distinct_rows) WHERE n <= 5 GROUP BY map_id, table_id)""",
            f"""SELECT map_id, table_id, {', '.join(f'CASE WHEN has_{c} THEN {c} ELSE {chr(39)}{chr(39)} END AS {c}' for c in COLUMNS)}
              FROM distinct_rows JOIN heads USING (map_id, table_id)""",
        ),
        "reg_fleet_definition": select(f"{FLEET}, {staged()}", "SELECT * FROM definition"),
        "reg_fleet_diagnostic_counts": select(
            f"{FLEET}, {staged()}, {DIAGNOSTICS}",
            "SELECT map_id, code, severity, count(*) AS rows, CAST(sum(n) AS BIGINT) AS warnings FROM findings GROUP BY map_id, code, severity",
        ),
    }
    return sql

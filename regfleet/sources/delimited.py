"""Delimited register files of any mix of encodings and delimiters."""

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regfleet.operators.headers import union_tables
from regfleet.operators.lookup import salted_lookup
from regfleet.operators.records import split_header
from regfleet.session import freeze
from regfleet.sources.files import MapId, driver_paths, file_stem, scan_order, with_table

# Delimiters of the document path in order of preference, and how
# many characters at the start of a file are searched for them.
DELIMITERS = [",", ";", "\t"]
SNIFF_CHARACTERS = 1024

#: A record up to its line end; line breaks inside closed quotes belong to it.
_FIRST_RECORD = r'^(?:[^"\r\n]++|"[^"]*+")*+'

#: How many lines a file's first record is looked for in (Spark cuts groups before the shuffle up to 1,000 rows), and how
#: much of each line after the first.
HEAD_LINES, HEAD_CHARACTERS = 1000, 1 << 19

#: Lines above this many bytes are not looked at, and lines with more quotes not in detail; their files are read whole.
LINE_BYTES, LINE_QUOTES = 1 << 26, 1000

_UTF16 = "(hex(substring(cast({} AS BINARY), 1, 2)) IN ('FFFE', 'FEFF'))"


def _occurrences(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _document_delimiter(head: Column) -> Column:
    """The first preferred delimiter that occurs at the start of the file."""
    snippet = F.substring(head, 1, SNIFF_CHARACTERS)
    return F.coalesce(*[F.when(snippet.contains(d), F.lit(d)) for d in DELIMITERS], F.lit(","))


def _register_delimiter(first: Column) -> Column:
    """Semicolon if the header line has more of them than commas."""
    return F.when(_occurrences(first, ";") > _occurrences(first, ","), F.lit(";")).otherwise(F.lit(","))


def _judge(heads: DataFrame, simplified: bool) -> DataFrame:
    """(file, utf16, delimiter, width) from the text at the start of each file."""
    utf16 = F.expr(_UTF16.format("head"))
    even = F.expr("substring(cast(head AS BINARY), 1, 2 * CAST(floor(octet_length(head) / 2) AS INT))")
    text = F.when(utf16, F.decode(even, "UTF-16")).otherwise(F.ltrim(F.col("head"), F.lit("\ufeff")))
    text = F.regexp_replace(text, "\r\n?", "\n")
    first = F.regexp_extract("text", _FIRST_RECORD, 0)
    delimiter = _register_delimiter(F.col("first")) if simplified else _document_delimiter(F.col("text"))
    delimiters = [
        F.length(c) - F.length(F.replace(F.col(c), F.col("delimiter"), F.lit(""))) for c in ("first", "line")
    ]
    return (
        heads.withColumns({"utf16": utf16, "text": text})
        .withColumns({"first": first, "line": F.regexp_extract("text", r"^[^\r\n]*", 0)})
        .withColumn("delimiter", delimiter)
        # With a stray quote in the header only its line end is sure.
        .select("file", "utf16", "delimiter", (F.greatest(*delimiters) + 1).alias("width"))
    )


def _lines(spark: SparkSession, path, separator: str | None = None) -> DataFrame:
    """Lines of files read in splits; without ``separator`` LF, CR LF and CR end one. Longer ones than LINE_BYTES are left out."""
    reader = spark.read.option("mapreduce.input.linerecordreader.line.maxlength", LINE_BYTES)
    reader = reader.option("lineSep", separator) if separator else reader
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("size"),
        scan_order().alias("row_ord"),
        "value",
    )


def _heads(spark: SparkSession, path) -> DataFrame:
    """(file, head): the lines at the start of each file that may belong to its first record or first characters.

    Lines end at LF only, which gives back the bytes of UTF-16 text. One scan; each task hands on the first lines only.
    """
    order = Window.partitionBy("file").orderBy("row_ord")
    first = (
        _lines(spark, path, "\n")
        .filter(F.col("split") == 0)
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= HEAD_LINES)
    )
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    needed = first.withColumns(
        {"open": F.sum(_occurrences(F.col("value"), '"')).over(so_far) % 2 == 1, "size": F.sum(F.length("value") + 1).over(so_far)}
    ).filter((F.col("n") == 1) | F.col("open") | (F.col("size") < 2 * SNIFF_CHARACTERS))
    cut = F.when(F.col("n") == 1, F.col("value")).otherwise(F.substring("value", 1, HEAD_CHARACTERS))
    return (
        needed.groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("n", cut.alias("value")))).alias("l"))
        .select("file", F.array_join("l.value", "\n").alias("head"))
    )


def dialects(spark: SparkSession, path, simplified: bool = False) -> DataFrame:
    """Encoding, delimiter and width of every file below ``path`` that is not empty."""
    return _judge(_heads(spark, path), simplified)


def _columns(width: int) -> list[str]:
    return [f"c{i}" for i in range(width)]


def _given(record: Column, delimiter: str) -> Column:
    """How many cells the text of a record gives; delimiters in quoted cells are not counted."""
    quoted = rf'(^|{delimiter})"(?:[^"]|"")*+"'
    bare = F.when(record.contains('"'), F.regexp_replace(record, quoted, "$1")).otherwise(record)
    return _occurrences(bare, delimiter) + 1


def _cells(width: int, given: Column, prefix: str = "") -> Column:
    """All cells of a row with uniform line ends; an empty one is '', one that a short row does not give is null."""
    return F.array(
        *[
            F.coalesce(F.regexp_replace(prefix + c, "\r\n?", "\n"), F.when(F.coalesce(given > i, F.lit(True)), F.lit("")))
            for i, c in enumerate(_columns(width))
        ]
    )


def _whole_files(spark: SparkSession, files: list[str], utf16: bool, delimiter: str, width: int) -> DataFrame:
    # Spark hands out the text of the records whose number of cells is not that of the schema.
    schema = ", ".join(f"{c} STRING" for c in [*_columns(width), "_text"])
    return (
        spark.read.schema(schema)
        .options(sep=delimiter, quote='"', escape='"', multiLine=True, encoding="UTF-16" if utf16 else "UTF-8")
        .option("columnNameOfCorruptRecord", "_text")
        .csv(files)
        .select(F.col("_metadata.file_path").alias("file"), scan_order().alias("row_ord"), *_columns(width), _given(F.col("_text"), delimiter).alias("_given"))
        .select("file", "row_ord", _cells(width, F.col("_given")).alias("cells"))
    )


def _by_line(spark: SparkSession, files: list[str], delimiter: str) -> set[str]:
    """The files whose every line is a record of its own: no quoted line breaks, stray quotes or mixed line ends."""
    other = f'[^{delimiter}"][^{delimiter}]*+'
    cell = f'(?:"(?:[^"]|"")*+"|{other}|)'
    record = rf"\A{cell}(?:{delimiter}{cell})*+\z"
    line = F.regexp_replace("value", r"\r\z", "")
    quotes = _occurrences(line, '"')
    simple = F.when(quotes == 0, F.lit(True)).when(quotes > LINE_QUOTES, F.lit(False)).otherwise(line.rlike(record))
    ends = F.col("value").endswith("\r").cast("int")
    found = (
        _lines(spark, files, "\n")
        .groupBy("file")
        .agg(
            F.bool_and(simple & ~line.contains("\r")).alias("simple"),
            # Only the last line may end otherwise than the rest.
            (F.count("*") - F.sum(ends) <= 1).alias("crlf"),
            (F.sum(ends) == 0).alias("lf"),
            F.sum(F.octet_length("value") + 1).alias("seen"),
            F.max("size").alias("size"),
        )
        # A byte order mark is not seen, nor is a line end that the file does not have.
        .filter("simple AND (lf OR crlf) AND seen >= size - 3")
    )
    return {row.file for row in found.select("file").toLocalIterator()}


def _split_files(spark: SparkSession, files: list[str], utf16: bool, delimiter: str, width: int) -> DataFrame:
    """Records of files that ``_by_line`` names, read in splits."""
    schema = ", ".join(f"{c} STRING" for c in _columns(width))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    return (
        _lines(spark, files, "\n")
        .select("file", "row_ord", F.regexp_replace("value", r"\r\z", "").alias("text"))
        .filter(F.col("text") != "")
        .withColumns({"_c": F.from_csv("text", schema, options), "_given": _given(F.col("text"), delimiter)})
        .select("file", "row_ord", _cells(width, F.col("_given"), "_c.").alias("cells"))
    )


def read_delimited(
    spark: SparkSession, path, simplified: bool = False, map_id: MapId = file_stem
) -> tuple[DataFrame, DataFrame]:
    """Headers and records of all delimited files below ``path``, one map per file.

    A first scan finds encoding, delimiter and width of each file, a second one the
    files of one record a line, a third one reads them; those are read in splits, so a file of any size is
    the work of many tasks. Files with quoted line breaks, stray quotes, mixed line
    ends, CR line ends or in UTF-16 are streamed, one task each. Both use the same
    parser: line ends may be LF, CR LF or CR, a quote opens a cell only at its
    start, and quoted cells may hold line breaks. Only file names come to the
    driver, which Spark's own listing keeps there as well. The records are stored,
    as header rules, numbering and projection each read them. A cell that a short row
    does not give is null; the column exists nevertheless, as the flag ``complete`` of the headers says.
    """
    found = freeze(dialects(spark, path, simplified), "dialects")
    groups = defaultdict(list)
    for row in found.toLocalIterator():
        # Files are read in classes of widths, so their number does not grow with that of the widths.
        groups[row.utf16, row.delimiter, 1 << (row.width - 1).bit_length()].append(row)
    parts, by_line = [], {}
    for delimiter in {delimiter for utf16, delimiter, _ in groups if not utf16}:
        files = [f for (utf16, d, _), rows in groups.items() if d == delimiter and not utf16 for f in rows]
        by_line[delimiter] = _by_line(spark, driver_paths(files), delimiter)
    for (utf16, delimiter, class_), files in groups.items():
        widths = {f.width for f in files}
        width = widths.pop() if len(widths) == 1 else class_
        simple = set() if utf16 else by_line[delimiter]
        for chosen, read in (([f for f in files if f.file in simple], _split_files), ([f for f in files if f.file not in simple], _whole_files)):
            if chosen:
                rows = read(spark, driver_paths(chosen), utf16, delimiter, width)
                parts.append(rows if not widths else _cut(rows, found))
    headers, records = split_header(freeze(with_table(union_tables(parts), map_id), "records"))
    return headers.withColumn("complete", F.lit(True)), records


def _cut(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the cells that the header of their file has."""
    sized = salted_lookup(rows, found.select("file", "width"), ["file"], "row_ord")
    return sized.select("file", "row_ord", F.slice("cells", F.lit(1), F.col("width")).alias("cells"))

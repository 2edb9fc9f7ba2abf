"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""

import re

import pytest
from compare import difference, engine
from pyspark.sql import functions as F

import __spark_entry__ as entry
from regfleet import fixtures as X
from regfleet.operators import checks, tagging
from regfleet.operators.checks import duplicates, intervals, overlap_counts
from regfleet.operators.headers import source_columns
from regfleet.operators.staging import stage, surviving, with_coefficient_text, with_values
from regfleet.plans import definition as definitions
from regfleet.plans import diagnostics as plans
from regfleet.plans.definition import definition, staged_table
from regfleet.plans.diagnostics import FINDING_COLUMNS, diagnostic_counts, diagnostics
from regfleet.session import freeze

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return engine(SF)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("reg_")])
def test_query_equals_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_overlaps_list_every_pair(spark):
    """One row per pair, so a row that overlaps several earlier ones stands several times."""
    found = entry.queries()
    pairs = found["reg_overlaps"](spark, SF).groupBy("map_id", "info1", "line_num").agg(F.count("*").alias("n"), F.min("ref_line").alias("ref_line"))
    counts = sorted(map(tuple, found["reg_overlap_counts"](spark, SF).select(pairs.columns).collect()))
    assert sorted(map(tuple, pairs.collect())) == counts and max(c[3] for c in counts) > 1


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange_of_rows_by_map_alone(spark):
    """One map may be a third of all rows, so only chunk totals are shuffled by map."""
    text = plan(definition(staged_table(X.registers(spark, SF))))
    by_map = re.findall(r"Exchange hashpartitioning\(map_id#\d+(?:, name#\d+)?, \d+\)[^\n]*\n([^\n]*)", text)
    assert by_map and all("HashAggregate(keys=[map_id" in below and "_chunk" in below for below in by_map)


def test_duplicates_shuffle_twice(spark):
    """Once for the combined first lines, once for the join, which can split a hot text."""
    rows = freeze(staged_table(X.registers(spark, SF)).select("map_id", "line_num", "name"), "names")
    text = plan(duplicates(rows, "name").hint("merge"))
    assert text.count("Exchange hashpartitioning") <= 2 and "partial_min" in text


def test_first_records_are_cut_before_the_shuffle(spark):
    cells = freeze(X.cells(X.registers(spark, SF)), "cells")
    from regfleet.operators.records import grid_records

    text = plan(source_columns(*grid_records(cells)))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_one_hot_map(spark):
    """A map of many chunks gives the numbers a plain window gives."""
    n = 200_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise(F.lit("hot")).alias("map_id"),
        (F.col("id") + 2).alias("line_num"),
        F.concat(F.lit("n"), F.col("id") % 5).alias("name"),
        F.lit("").alias("tag"),
        F.lit("").alias("register_type"),
        (F.col("id") % 1000).cast("string").alias("address"),
        F.lit("U16").alias("type"),
        *[F.lit("").alias(c) for c in ("factor", "offset_raw", "unit", "action", "scale_factor")],
    )
    staged = staged_table(rows)
    hot = definition(staged).filter("map_id = 'hot'")
    total, last, tags = hot.agg(F.count("*"), F.max("idx"), F.countDistinct("tag")).first()
    assert total == last == tags == n - len(range(0, n, 3))
    counts = overlap_counts(intervals(staged.filter("status = 'OK'").withColumn("info1", F.lit("3"))))
    assert counts.agg(F.sum("n")).first()[0] == sum(
        (k * (k - 1)) // 2 for a in range(1000) for k in [sum(1 for i in range(a, n, 1000) if i % 3)]
    )


def test_generated_methods_are_compiled(spark):
    """The JVM only interprets methods of more than 8,000 bytes of code, which costs several times the CPU."""
    fleet = X.fleet(spark, SF)
    values = with_coefficient_text(spark.range(9).select(F.rand().alias("coef_a_num"), F.rand().alias("coef_b_num")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (stage(fleet), with_values(surviving(staged_table(fleet))), values):
            found = df._jdf.queryExecution().debug().codegenToSeq()
            assert max(found.apply(k)._3().maxMethodCodeSize() for k in range(found.size())) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_counts_are_those_of_the_listing(spark, monkeypatch):
    """Counting findings lists nothing: no tags are allocated and rows are not compared by events per register."""
    rows = X.registers(spark, SF)
    mixed = rows.withColumns({"name": F.expr(X.MIXED_NAME.replace("k %", "line_num %")), "tag": F.expr(X.MIXED_TAG.replace("k %", "line_num %"))})
    staged = staged_table(rows.unionByName(mixed.withColumn("map_id", F.concat("map_id", F.lit(" mixed")))), columns=FINDING_COLUMNS)
    listed = diagnostics(staged).groupBy("map_id", "code", "severity").agg(F.count("*").alias("rows"), F.sum("n").alias("warnings"))
    assert sorted(map(tuple, diagnostic_counts(staged).collect())) == sorted(map(tuple, listed.collect()))

    stored = []
    for module in (checks, tagging, plans, definitions):
        monkeypatch.setattr(module, "freeze", lambda df, label: stored.append(label) or freeze(df, label))
    entry.queries()["reg_fleet_diagnostic_counts"](spark, SF).collect()
    assert stored == ["staged", "spans", "large-maps", "islands", "tag-texts", "tag-bases"]

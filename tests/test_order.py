"""Order-dependent operators on random maps, held against the properties of their results."""

import random
from collections import defaultdict

import pytest
from properties import repeats, shared_registers, tag_faults
from pyspark.sql import Window
from pyspark.sql import functions as F

from regfleet.functions import tag_base
from regfleet.operators import checks
from regfleet.operators.checks import duplicates, overlap_counts, overlap_pairs
from regfleet.operators import ordering, tagging
from regfleet.operators.ordering import ordered_scan
from regfleet.operators.tagging import allocate_tags
from regfleet.session import freeze


@pytest.mark.parametrize("sparse", [False, True])
def test_ordered_scan_equals_window(spark, sparse, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK_BITS", 3)
    df = spark.range(20000).select(
        F.pmod(F.xxhash64("id"), F.lit(5)).alias("m"), (F.col("id") * 37 % 20011 - 400).alias("o"), "id"
    )
    scanned = ordered_scan(
        df,
        ["m"],
        "o",
        counts={"rn": F.lit(True), "odd": F.col("id") % 2 == 1},
        sums={"total": F.col("id")},
        minima={"low": F.when(F.col("id") > 50, F.col("id"))},
        sparse=sparse,
        chunk_bits=6,
    )
    w = Window.partitionBy("m").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select(
        "m", "o", "id",
        F.count("*").over(w).alias("rn"),
        F.sum((F.col("id") % 2)).over(w).alias("odd"),
        F.sum("id").over(w).alias("total"),
        F.min(F.when(F.col("id") > 50, F.col("id"))).over(w).alias("low"),
    )
    assert scanned.count() == 20000
    assert scanned.exceptAll(plain).isEmpty()


def with_base(spark, rows):
    df = spark.createDataFrame(rows, "map_id string, line_num bigint, name string, tag string")
    return freeze(df.withColumn("base", tag_base(F.col("name"))), "test")


MIXED = [("A", ""), ("x", "a_1"), ("A", ""), ("A 1", ""), ("y", "a")]


def random_rows(seed, n_maps, length):
    rnd = random.Random(seed)
    names = ["A", "A 1", "A 2", "A 1 1", "A 1 2", "A 10", "A 01", "B", "B 1", "", "9", "A_1", "a 3", "!!"]
    tags = ["", "", "", "", "a", "a_1", "a_2", "a_3", "a_4", "a_1_1", "a_1_2", "a_01", "b", "b_1", "A_1", "var", "v_9_1"]
    rows = []
    for m in range(n_maps):
        pool = rnd.sample(names, rnd.randint(1, len(names)))
        typed = rnd.sample(tags, rnd.randint(1, len(tags)))
        rows += [
            (f"m{m}", line, rnd.choice(pool), rnd.choice(typed)) for line in range(2, 2 + rnd.randint(1, length))
        ]
    return rows


def check_tags(spark, rows):
    """The tags by (map, line) of rows (map, line, name, tag), once they are right."""
    df = with_base(spark, rows)
    tagged = freeze(allocate_tags(df), "test")
    got = {(r.map_id, r.line_num): r.tag for r in tagged.collect()}
    assert len(got) == len(rows)
    maps = defaultdict(list)
    for r in df.collect():
        maps[r.map_id].append((r.line_num, r.name, r.tag, r.base, got[r.map_id, r.line_num]))
    assert {m: tag_faults(content) for m, content in maps.items() if tag_faults(content)} == {}
    reports = {(m, *x) for m, content in maps.items() for x in repeats([(row[0], row[4]) for row in content])}
    assert {(r.map_id, r.line_num, r.ref_line) for r in duplicates(tagged, "tag").collect()} == reports
    return got


@pytest.mark.parametrize("seed,n_maps,length,block", [(1, 1500, 30, 128), (2, 20, 400, 2), (3, 20, 200, 1)])
def test_tags_are_the_first_free_ones(spark, monkeypatch, seed, n_maps, length, block):
    monkeypatch.setattr(tagging, "BLOCK", block)
    rows = random_rows(seed, n_maps, length)
    rows += [("golden", i + 2, n, t) for i, (n, t) in enumerate(MIXED)]
    got = check_tags(spark, rows)
    assert [got["golden", i] for i in range(2, 7)] == ["a", "a_1", "a_2", "a_1_1", "a"]


def test_many_claims_take_few_rounds(spark, monkeypatch):
    """5,000 claims on one base, which win and lose in turns, and chains of bare texts that claim shorter bases."""
    rnd = random.Random(3)
    rows, line = [], 2
    for n in range(1, 5001):
        rows.append(("m", line, "", f"a_{n}"))
        line += 1
        if n % 2 or rnd.random() < 0.2:
            rows.append(("m", line, "A", ""))
            line += 1
    rows += [("chain", 2 + k, "B" + " 1" * (k // 2 % 12), "" if k % 7 else "b_3") for k in range(200)]
    stored = []
    monkeypatch.setattr(tagging, "freeze", lambda df, label: stored.append(label) or freeze(df, label))
    check_tags(spark, rows)
    assert stored.count("tag-thresholds") <= 1 + 6 and len(stored) <= 18


def test_tags_without_claims(spark):
    rows = [("m", i, "Test Variable" if i % 2 else "Other", "") for i in range(2, 300)]
    df = with_base(spark, rows)
    got = {r.line_num: r.tag for r in allocate_tags(df).collect()}
    assert got[3] == "test_variable" and got[5] == "test_variable_1" and got[299] == "test_variable_148"


def test_overlaps_equal_pairwise(spark):
    rnd = random.Random(7)
    rows, expected = [], set()
    for m in range(60):
        for info1 in ("3", "4"):
            content = []
            for line in range(2, 2 + rnd.randint(1, 60)):
                start = rnd.choice([0, 40000, -20, 10**17]) + rnd.randint(0, 60)
                kind = rnd.choice(["one", "bits", "two", "eight", "wide", "empty", "huge" if rnd.random() < 0.05 else "one"])
                width = {"one": 1, "bits": 1, "two": 2, "eight": 8, "empty": 0, "wide": rnd.randint(1, 70), "huge": 10**12}[kind]
                content.append((line if info1 == "3" else line + 1000, start, start + width - 1, kind == "bits"))
            kept = [row for row in content if row[2] >= row[1]]
            expected |= {(f"m{m}", *p) for p in shared_registers(kept)}
            rows += [(f"m{m}", info1, s, e, line, f"n{line}", "BITS" if b else "U16", b) for line, s, e, b in content]
    spans = spark.createDataFrame(
        rows,
        "map_id string, info1 string, reg_start bigint, reg_end bigint, line_num bigint, name string, type string, is_bits boolean",
    ).filter("reg_end >= reg_start")
    pairs = [(r.map_id, r.line_num, r.ref_line) for r in overlap_pairs(spans).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected
    counts, firsts = defaultdict(int), {}
    for m, line, ref in expected:
        counts[m, line] += 1
        firsts[m, line] = min(ref, firsts.get((m, line), ref))
    got = {(r.map_id, r.line_num): (r.n, r.ref_line) for r in overlap_counts(spans).collect()}
    assert got == {k: (counts[k], firsts[k]) for k in counts}


def test_pairs_of_a_full_register_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(checks, "DEALT", 7)
    spans = spark.range(90).selectExpr(
        "'m' AS map_id", "'3' AS info1", "5L AS reg_start", "5 + id % 2 AS reg_end", "id AS line_num", "'x' AS name", "'U16' AS type", "id % 3 = 0 AS is_bits"
    )
    pairs = [(r.line_num, r.ref_line) for r in overlap_pairs(spans).collect()]
    want = [(i, j) for i in range(90) for j in range(i) if i % 3 or j % 3]
    assert sorted(pairs) == sorted(want)


@pytest.mark.parametrize("whole,island", [(1 << 16, 64), (40, 3), (0, 64), (1 << 16, 0)])
def test_overlaps_whichever_way_rows_are_compared(spark, monkeypatch, whole, island):
    """Maps in one window, in islands of any length and by running counts agree with the listed pairs."""
    monkeypatch.setattr(checks, "WHOLE", whole)
    monkeypatch.setattr(checks, "ISLAND", island)
    rnd = random.Random(11)
    rows = []
    for m in range(40):
        for line in range(2, 2 + rnd.randint(1, 90)):
            start = rnd.choice([0, 40000, -20, 10**17]) + rnd.randint(0, rnd.choice([5, 400]))
            bits = rnd.random() < 0.3
            end = start + (0 if bits else rnd.choice([0, 0, 1, 3, 7, rnd.randint(0, 70), 10**12 * (rnd.random() < 0.01)]))
            rows.append((f"m{m}", rnd.choice("34"), start, int(end), line, f"n{line}", "BITS" if bits else "U16", bits))
    spans = freeze(
        spark.createDataFrame(
            rows,
            "map_id string, info1 string, reg_start bigint, reg_end bigint, line_num bigint, name string, type string, is_bits boolean",
        ),
        "test",
    )
    firsts, counts = {}, defaultdict(int)
    for r in sorted(overlap_pairs(spans).collect(), key=lambda r: r.ref_line):
        counts[r.map_id, r.line_num] += 1
        firsts.setdefault((r.map_id, r.line_num), tuple(r))
    assert len(counts) > 300
    assert {(r.map_id, r.line_num): (r.n, r.ref_line) for r in overlap_counts(spans).collect()} == {k: (counts[k], firsts[k][6]) for k in counts}
    columns = ["map_id", "info1", "line_num", "name", "reg_start", "reg_end", "ref_line", "ref_name", "ref_start", "ref_end"]
    assert {tuple(r) for r in checks.overlaps(spans).select(columns).collect()} == set(firsts.values())


@pytest.mark.parametrize("seed,n_maps,length,block", [(4, 800, 30, 128), (5, 20, 300, 2)])
def test_repeated_tags_are_counted_without_allocating(spark, monkeypatch, seed, n_maps, length, block):
    monkeypatch.setattr(tagging, "BLOCK", block)
    rows = random_rows(seed, n_maps, length) + [("golden", i + 2, n, t) for i, (n, t) in enumerate(MIXED)]
    df = with_base(spark, rows)
    listed = duplicates(freeze(allocate_tags(df), "test"), "tag").groupBy("map_id").agg(F.count("*").alias("n"))
    counted = tagging.tag_repeats(df).groupBy("map_id").agg(F.sum("n").alias("n"))
    want = {tuple(r) for r in listed.collect()}
    assert len(want) > n_maps // 2 and {tuple(r) for r in counted.collect()} == want

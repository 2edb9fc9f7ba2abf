"""Suffix-sorted removal of strings, periodic runs and whitening, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regfleet.llm import suffix_dedup
from regfleet.llm.common import table
from regfleet.llm.periodic_runs import lyndon_lengths, periodic_runs, word_runs
from regfleet.llm.queries import op12_embedding_whitening
from regfleet.llm.suffix_dedup import remove_repeated_strings, repeated_windows, two_stage_order
from regfleet.llm.whitening import whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"


# --- strings ---------------------------------------------------------------


def plain_removal(texts, length):
    """(bytes, removed spans, kept) of each text by counting all windows."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, dtype=bool)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[:-1], [False]]).astype(int)))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((len(x), spans, bytes(c for c, g in zip(x, gone) if not g)))
    return out


def removal(df, length, **options):
    rows = remove_repeated_strings(df, length=length, **options).orderBy("doc_id").collect()
    return [(r["n_bytes"], [(s["begin"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in rows]


def cut_texts(seed, n=40):
    rng = random.Random(seed)
    letters = ["ab", "abcdefgh", "aé漢 ", "a"]
    base = ["".join(rng.choice(letters[k % 4]) for _ in range(rng.randrange(10, 300))) for k in range(12)]
    texts = [None, "", "short", "a" * 500, "xyz" * 200, *base[:3], *base[:3]]
    for _ in range(n):
        one, two = rng.choice(base), rng.choice(base)
        a, b = rng.randrange(len(one)), rng.randrange(len(two))
        texts.append(one[a : a + rng.randrange(80)] + rng.choice(["", "-", "?!"]) + two[b:])
    return texts


@pytest.mark.parametrize("length, hot_bytes", [(2, 1 << 20), (7, 1 << 20), (24, 1 << 20), (24, 200), (60, 500)])
def test_strings_equal_all_windows(spark, monkeypatch, length, hot_bytes):
    """Small scans, small counts and hot groups change nothing."""
    monkeypatch.setattr(suffix_dedup, "_SCAN", 300)
    monkeypatch.setattr(suffix_dedup, "_SORT", 2000)
    monkeypatch.setattr(suffix_dedup, "_COUNTED", 50)
    texts = cut_texts(length)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(5)
    assert removal(df, length, hot_bytes=hot_bytes) == plain_removal(texts, length)


def test_strings_of_repeated_and_null_ids(spark):
    same = "".join(random.Random(1).choice("abcdefgh") for _ in range(300))
    rows = [(None, same), (None, "x" + same), (5, "unlike"), (5, same), (6, None)]
    found = remove_repeated_strings(spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.lit(1)))
    got = sorted((str(r["doc_id"]), r["n_bytes"], bytes(r["kept"])) for r in found.collect())
    assert got == sorted([("None", 300, b""), ("None", 301, b"x"), ("5", 6, b"unlike"), ("5", 300, b""), ("6", 0, b"")])


def test_order_of_suffixes():
    rng = random.Random(2)
    for _ in range(200):
        depth = rng.choice([8, 11, 40])
        body = bytes(rng.choice(b"\x00ab\xff") for _ in range(rng.randrange(1, 120)))
        data = np.frombuffer(body + b"\x00\xff" + bytes(depth + 8), dtype=np.uint8)
        wanted = np.zeros(len(data), dtype=bool)
        wanted[[k for k in range(len(body)) if rng.random() < 0.7]] = True
        order = two_stage_order(data, suffix_dedup._keys(data), wanted, depth)
        raw = data.tobytes()
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        strings = [raw[k : k + depth] for k in order]
        assert strings == sorted(strings)


def test_windows_of_segments():
    rng = random.Random(3)
    for _ in range(300):
        length = rng.choice([2, 8, 9, 20])
        segments = [bytes(rng.choice(b"ab") for _ in range(length + rng.randrange(30))) for _ in range(rng.randrange(1, 9))]
        times = np.array([rng.choice([1, 1, 2]) for _ in segments])
        count = Counter()
        for x, m in zip(segments, times.tolist()):
            for i in range(len(x) - length + 1):
                count[x[i : i + length]] += m
        for x, r in zip(segments, repeated_windows(segments, times, length)):
            got = [i for a, b in zip(r[::2].tolist(), r[1::2].tolist()) for i in range(a, b)]
            assert got == [i for i in range(len(x) - length + 1) if count[x[i : i + length]] > 1]


# --- runs ------------------------------------------------------------------


def plain_lyndon(s):
    """A suffix ends its Lyndon word where the next smaller one begins."""
    return [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]


def plain_runs(w, min_length=6, min_exponent=4):
    found = {}
    for q in range(1, len(w) // min_exponent + 1):
        start = None
        for i in range(len(w) - q + 1):
            if i < len(w) - q and w[i] == w[i + q]:
                start = i if start is None else start
            elif start is not None:
                if i - start + q >= max(min_length, min_exponent * q):
                    found.setdefault((start, i - start + q), q)
                start = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    kinds = rng.randint(1, 4)
    w = [rng.randrange(kinds) for _ in range(rng.randint(1, 60))]
    if rng.random() < 0.7:
        a, p = rng.randrange(len(w)), rng.randint(1, 7)
        w = [w[min(a + (i - a) % p, len(w) - 1)] if i >= a else x for i, x in enumerate(w)]
        w += [rng.randrange(kinds) for _ in range(rng.randrange(6))]
    return w


def test_lyndon_words_and_runs():
    rng = random.Random(4)
    for _ in range(3000):
        w = periodic_words(rng)
        assert lyndon_lengths(w) == plain_lyndon(w)
        assert word_runs(np.array(w, dtype=np.int64)) == plain_runs(w)


def test_runs_of_texts(spark):
    rng = random.Random(5)
    rows = [(k, " \t".join(f"é{x}" for x in periodic_words(rng)) + "\n") for k in range(200)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "a " * 50_000), (203, "a b c d e f g")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("runs", "id", "collapsed")})
    found = sorted((tuple(r) for r in periodic_runs(df).collect()), key=repr)
    want = []
    for doc_id, text in rows:
        w = (text or "").split()
        runs = plain_runs(w) if doc_id is not None else [(0, 50_000, 1)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((doc_id, len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = [(d, n, [(r["start"], r["length"], r["period"]) for r in runs], rest) for d, n, runs, rest in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs(df.limit(0)).collect() == []


# --- whitening -------------------------------------------------------------


def plain_whitening(x, count=16):
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, sums)) for row in x]
    return n, deviation, (x - sums / n) @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening_query_equals_numpy(spark):
    vectors = table(spark, SF, "embeddings").toPandas()
    x = np.floor(64 * np.stack(vectors["embedding"]).astype(float)).astype(np.int64) + 1_000_000
    n, deviation, white, explained = plain_whitening(x)
    rows = op12_embedding_whitening(spark, SF).toPandas()
    assert len(rows) == 16 * len(vectors) and set(rows["n"]) == {n}
    first = rows[rows["component"] == 1].set_index("vec_id").loc[vectors["vec_id"]]
    assert first["deviation"].tolist() == deviation
    got = rows.pivot(index="vec_id", columns="component", values="whitened").loc[vectors["vec_id"]].to_numpy()
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-7
    assert np.allclose(rows.groupby("component")["explained"].first(), explained, rtol=1e-9)
    assert rows["identity_error"].nunique() == 1 and rows["identity_error"].max() < 1e-9


def test_whitening_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.0, 1.0, 0.5]), (2, [1.0, 0.0, 0.5]), (2, [1.0, 0.0, 0.5]), (None, [1.0, 2.0, 0.5]), (9, [3.0, 1.0, 0.5])]
    bad = [(3, None), (4, []), (5, [nan, 0.0, 0.0]), (6, [0.0, -inf, 0.0]), (7, [None, 0.0, 0.0]), (8, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(1) for c in ("x", "id", "n")})
    rows = whiten(df).collect()
    # The third dimension has no spread, so there are two components.
    assert sorted((str(r["vec_id"]), r["component"]) for r in rows) == sorted((str(k), c) for k, _ in good for c in (1, 2))
    assert {r["n"] for r in rows} == {4} and max(r["identity_error"] for r in rows) < 1e-9
    x = np.floor(64 * np.array([v for _, v in good])).astype(np.int64) + 1_000_000
    deviation = plain_whitening(x, 2)[1]
    assert sorted(r["deviation"] for r in rows if r["component"] == 1) == sorted(deviation)
    assert whiten(df.limit(0)).collect() == []
    assert whiten(df.filter("vec_id = 2")).collect() == []


def test_whitening_of_wide_values(spark):
    """Squares beyond 64 bits are still exact; a deviation beyond a BIGINT is null."""
    rng = random.Random(6)
    rows = [(k, [rng.uniform(-1e12, 1e12) for _ in range(5)]) for k in range(300)] + [(300, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    found = whiten(df, components=5).toPandas()
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    _, deviation, white, _ = plain_whitening(x, 5)
    got = found.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.abs(np.abs(got) - np.abs(white)).max() < 1e-6
    by_id = found[found["component"] == 1].sort_values("vec_id")["deviation"]
    assert [None if v != v else int(v) for v in by_id] == [d if d < 1 << 63 else None for d in deviation]
    assert found["identity_error"].max() < 1e-9


def test_sums_of_squares_are_exact():
    from regfleet.llm.whitening import _sum_squares

    rng = random.Random(7)
    for bits in (3, 20, 40, 46, 60):
        v = np.array([[rng.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(50)], dtype=np.int64)
        assert _sum_squares(v) == [sum(int(a) ** 2 for a in c) for c in v.T]


def test_digest_columns(spark):
    """The query's columns from the operator's own."""
    from regfleet.llm.queries import op11_suffix_dedup, op13_periodic_runs

    row = op11_suffix_dedup(spark, SF).orderBy("doc_id").first()
    text = table(spark, SF, "documents").orderBy("doc_id").first()["text"]
    assert row["n_bytes"] == len(text.encode())
    assert row["n_removed"] or row["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    run = op13_periodic_runs(spark, SF).filter("n_runs > 0").first()
    assert run["exponent_milli"] == 1000 * run["length"] // run["period"]

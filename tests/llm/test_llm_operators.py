"""The text operators on nulls, empty and long texts, ties, repeats, empty tables and odd columns."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regfleet.llm.components import components
from regfleet.llm.decontaminate import contamination, decontaminate
from regfleet.llm.embedding_dedup import near_vectors
from regfleet.llm.jaccard_join import Threshold, jaccard_components
from regfleet.llm.language import identify_languages
from regfleet.llm.licences import find_licences, known_licences
from regfleet.llm.line_dedup import deduplicate_lines
from regfleet.llm.lm_score import MU, score_documents
from regfleet.llm.mixing import mix_sources, schedule
from regfleet.llm.periodic_runs import periodic_runs
from regfleet.llm.pii import digest, personal_data
from regfleet.llm.suffix_dedup import remove_repeated_strings
from regfleet.llm.toxicity import toxicity

#: Names that operators use inside.
ODD = "doc digest row run line id text_key gone place kept spans runs n_words collapsed words w hit hits items copies score size n _doc _id _text _gone _lines _rest _row _toxic lo hi sig".split()

SCHEMA = "doc_id bigint, text string, lang string, source string"


def frame(spark, rows, odd=True):
    docs = spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], SCHEMA)
    return docs.withColumns({c: F.lit(7) for c in ODD}) if odd else docs


def vocabulary_text(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


LONG = vocabulary_text(1, 40_000)
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (5, LONG), (None, "one two three"), (None, None), (6, "é 1 ++ @ a@b 9" * 3)]


def by_doc(df, *columns):
    return sorted(((r["doc_id"], *[r[c] for c in columns]) for r in df.collect()), key=repr)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def items(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


OPERATORS = {
    "jaccard": lambda s, d: jaccard_components(d),
    "jaccard_segments": lambda s, d: jaccard_components(d, width=3, threshold=Threshold(90)),
    "contamination": lambda s, d: contamination(d, items(s, [(1, "one two three"), (None, "é"), (2, None), (3, "")])),
    "documents": lambda s, d: decontaminate(d, items(s, [(1, "zz")])),
    "spans": lambda s, d: decontaminate(d, items(s, [(1, "zz")]), remove="spans"),
    "language": lambda s, d: identify_languages(d),
    "toxicity": lambda s, d: toxicity(d, labels(s, [(4, 1, 0), (6, 0, 1), (6, 0, 0)])),
    "pii": lambda s, d: digest(personal_data(d)),
    "licences": lambda s, d: find_licences(d, known_licences(s)),
    "mix": lambda s, d: mix_sources(d),
    "lines": lambda s, d: deduplicate_lines(d),
    "lm": lambda s, d: score_documents(d, d.select("doc_id")),
    "strings": lambda s, d: remove_repeated_strings(d),
    "runs": lambda s, d: periodic_runs(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_columns(spark, name):
    """Nulls, blanks, a long text, repeats and columns of any name: a row for every row."""
    out = OPERATORS[name](spark, frame(spark, ROWS))
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, frame(spark, [])).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(300)]
    star = [(1000, 2000 + k) for k in range(300)]
    edges = spark.createDataFrame([*path, *star, (5, 5), (7, None)], "u bigint, v bigint")
    found = dict(components(edges).collect())
    assert found == {k: 0 for k in range(301)} | {k: 1000 for k in [1000, *range(2000, 2300)]}


def test_jaccard_defined_cases(spark):
    rows = by_doc(jaccard_components(frame(spark, ROWS)), "n_shingles", "component_id")
    assert (1, 0, 1) in rows and (2, 0, 2) in rows and (3, 0, 3) in rows
    assert rows.count((5, 39_996, 4)) == 2 and (None, 1, None) in rows


def edited(text, rng, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * 3
    return " ".join(words)


@pytest.mark.parametrize("width, part, by_segment", [(3, 90, True), (5, 80, False), (5, 80, True), (2, 60, False)])
def test_jaccard_equals_all_pairs(spark, width, part, by_segment):
    rng = random.Random(width)
    base = [vocabulary_text(k, rng.randrange(5, 200)) for k in range(12)]
    docs = {k: edited(rng.choice(base), rng, rng.randrange(6)) for k in range(150)}
    sets = {}
    for d, t in docs.items():
        w = t.split()
        sets[d] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}
    first = {d: d for d in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if 100 * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b]):
                    first[a] = first[b] = min(first[a], first[b])
        if all(first[first[d]] == first[d] for d in docs):
            break
    found = jaccard_components(frame(spark, docs.items()), width=width, threshold=Threshold(part), by_segment=by_segment)
    assert by_doc(found, "component_id") == sorted(first.items(), key=repr)
    assert len(set(first.values())) > 12


def test_near_vectors_defined_cases(spark):
    x, y = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0]
    rows = [
        (1, x, 1), (2, x, 1), (2, x, 1), (3, y, 1), (4, x, 2), (5, x, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1),
        (8, [math.nan, 1.0, 1.0], 1), (9, [None, 1.0, 0.0], 1), (10, [], 1), (11, [-1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("digest", F.lit(1))
    found = sorted(tuple(r) for r in near_vectors(vectors).collect())
    alone = [(k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12)]
    assert found == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), *alone])
    assert near_vectors(vectors.limit(0)).collect() == []


def test_near_vectors_recall_and_blocks(spark, monkeypatch):
    from regfleet.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 32))
    x = (centres[rng.integers(0, 20, 600)] + 0.25 * rng.standard_normal((600, 32))).astype(np.float32)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    found = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    d = x.astype(float)
    norm = np.sqrt((d * d).sum(axis=1))
    near = (d @ d.T) / np.outer(norm, norm) >= 0.93
    want = near.sum(axis=1) - 1
    got = np.array([found[k]["n_links"] for k in range(600)])
    assert (got <= want).all() and got.sum() >= 0.999 * want.sum() and want.sum() > 1000


def test_contamination_short_items_passes_and_spans(spark):
    text = "Alpha beta-GAMMA delta; one two three four five six seven eight nine ten eleven É. omega"
    long_item = "one two three four five six seven eight nine ten eleven"
    bench = items(spark, [(1, long_item), (1, long_item), (2, "beta gamma"), (3, "éa"), (10, "ONE, two"), (None, "omega")])
    docs = frame(spark, [(1, text), (2, "nothing here"), (3, text), (3, text)])
    for max_windows in (250_000, 2):
        found = contamination(docs, bench, max_windows=max_windows).collect()
        assert len(found) == 4
        for r in found:
            want = [] if r["doc_id"] == 2 else [1, 2, *range(4, 15), 16]
            assert sorted(r["hit_words"]) == want and r["items"] == ([] if r["doc_id"] == 2 else ["1", "10", "2"])
    assert [r["doc_id"] for r in decontaminate(docs, bench).collect()] == [2]
    spans = {r["doc_id"]: r["text"] for r in decontaminate(docs, bench, remove="spans").collect()}
    assert spans[2] == "nothing here" and spans[1].split() == ["Alpha", "-", "delta;", "É."] or spans[1].startswith("Alpha")


def test_line_runs(spark):
    a, b, c = (vocabulary_text(k, 20) for k in range(3))
    docs = frame(spark, [
        (1, f"x\n{a}\n{b}\ny"), (2, f"{a}\n\n  {b} \nz"), (3, f"{a}\nq"), (4, f"{c}\n{c}\n{c}"), (5, f"{a}\n{b}"), (None, "k"),
    ])
    out = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in deduplicate_lines(docs, min_words=30).collect()}
    assert out[1][:2] == (4, 0) and out[2] == (4, 3, "z") and out[3][1] == 0 and out[5] == (2, 2, "")
    assert out[4] == (3, 2, c) and out[None] == (1, 0, "k")
    kept = [r["doc_id"] for r in deduplicate_lines(docs, drop_empty=True).collect()]
    assert sorted(kept, key=str) == [1, 2, 3, 4, None]


def test_licences(spark):
    from regfleet.llm.licences import KNOWN

    mit = KNOWN[0][1]
    docs = frame(spark, [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ,")), (2, f"intro\n\n{mit}"),
        (3, "a line\n * Released under the  M.I.T. Licence!\n"), (4, "* Released under the MIT Licence\nmore"), (5, None),
        (6, "Copyright 2020 X"),
    ])
    found = {r["doc_id"]: (r["licence"], r["notices"]) for r in find_licences(docs, known_licences(spark)).collect()}
    assert found[1] == ("MIT", ["MIT"]) and found[2] == (None, ["MIT"]) and found[3] == (None, [])
    assert found[4] == (None, ["MIT"]) and found[5] == found[6] == (None, [])


def test_mix_targets_and_schedule(spark):
    rng = random.Random(5)
    rows = [(k, "w " * rng.randrange(0, 50), None, s) for k, s in enumerate([*"aaaabbbbbbbbbbcc" * 20, None])]
    mixed = mix_sources(frame(spark, rows))
    by_source = {}
    for r in mixed.collect():
        assert r["taken"] <= 3 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"])
        by_source.setdefault(r["source"], []).append(r)
    for rows_of in by_source.values():
        assert sum(r["taken"] for r in rows_of) == round(rows_of[0]["target"])
    total = sum(r["size"] for v in by_source.values() for r in v)
    assert abs(sum(v[0]["target"] for v in by_source.values()) - total) < 1e-6
    positions = [r["position"] for r in schedule(mixed).collect()]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1


def test_contexts_find_unseen_identifiers(spark):
    """Local numbers after a word that otherwise stands before full numbers are added; after other words not."""
    rows = [(100 + k, f"some words here. dial: +1 (555) 555-{1000 + k} then") for k in range(24)]
    rows += [(20, "more words dial: 555-7777 end"), (21, "we counted 555-8888 of them"), (22, "we counted many, counted more")]
    rows += [(30 + k, f"please dial: 555-7777 or +1 555 555 {2000 + k}") for k in range(3)]
    found = {r["doc_id"]: r for r in digest(personal_data(frame(spark, rows))).collect()}
    assert found[20]["n_added"] == 1 and found[20]["spans"] == "phone:17:25" and found[20]["n_phone"] == 0
    assert found[21]["n_added"] == 0


def test_lm_scores_equal_plain_counts(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice("red blue green sky sea".split()) for _ in range(30)) + (" Red!" if k < 5 else "")) for k in range(20)]
    target = {0, 1, 2, 3, 4}
    docs = frame(spark, rows, odd=False)
    found = {r["doc_id"]: r for r in score_documents(docs, docs.filter("doc_id < 5").select("doc_id"), vocabulary=4).collect()}
    texts = {d: "".join(c if c.isalpha() else " " for c in t.lower()).split() for d, t in rows}
    common = Counter(w for t in texts.values() for w in t)
    known = {w for w, _ in common.most_common(4)}
    assert len(common) == 5

    def model(ids):
        ids_of = {d: [w if w in known else "?" for w in texts[d]] for d in ids}
        pair, word, before = Counter(), Counter(), Counter()
        for t in ids_of.values():
            for h, w in zip(["<"] + t, t):
                pair[h, w] += 1
                word[w] += 1
                before[h] += 1
        return pair, word, before

    n_target = sum(len(texts[d]) for d in target)
    total = sum(len(t) for t in texts.values())
    for column, (pair, word, before), scale in (
        ("loss_target", model(target), 1.0), ("loss_background", model(texts), n_target / total),
    ):
        for d, t in texts.items():
            seq = [w if w in known else "?" for w in t]
            loss = 0.0
            for h, w in zip(["<"] + seq, seq):
                p = (word[w] * scale + 1) / (sum(word.values()) * scale + 6)
                loss -= math.log((pair[h, w] * scale + MU * p) / (before[h] * scale + MU))
            assert abs(found[d][column] - loss / len(seq)) < 1e-5
    assert all(abs(r["score"] - (r["loss_background"] - r["loss_target"])) < 1e-12 for r in found.values())


@pytest.mark.parametrize("hot, broadcast_targets", [(1 << 20, 500_000), (40, 0), (0, 0)])
def test_lm_counts_every_word_pair_and_target(spark, hot, broadcast_targets):
    """More than 65,536 words, wherever a loss is looked up; repeated texts and ids count as often as they occur."""
    rng = random.Random(4)
    common = [f"w{'abcdefghij'[k]}" for k in range(10)]
    texts = {k: " ".join(rng.choice(common) for _ in range(40)) for k in range(30)}
    texts[30] = texts[31] = texts[3] + " " + texts[4]
    texts[32] = " ".join("".join("abcdefghij"[int(c)] for c in f"{k:05}") for k in range(70_000))
    rows = [*texts.items(), (5, texts[5]), (33, None), (34, "12")]
    docs = frame(spark, rows, odd=False)
    target = {*range(0, 30, 3), 32, 33}
    chosen = spark.createDataFrame([(k,) for k in [*target, 3, None]], "doc_id bigint")
    split = {k: t.split() for k, t in texts.items()}

    def model(keep):
        pair, word, before = Counter(), Counter(), Counter()
        for k, t in rows:
            for h, w in zip(["<", *split[k]], split[k]) if keep(k) and k in split else ():
                pair[h, w] += 1
                word[w] += 1
                before[h] += 1
        return pair, word, before

    models = model(lambda k: k in target), model(lambda k: True)
    n_target, n = (sum(m[1].values()) for m in models)
    size = len(models[1][1]) + 2
    assert size > 65_538
    out = score_documents(docs, chosen, hot=hot, broadcast_targets=broadcast_targets).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(k for k, _ in rows)
    for r in out:
        seq = split.get(r["doc_id"], [])
        assert r["n_tokens"] == len(seq)
        for column, (pair, word, before), scale in zip(("loss_target", "loss_background"), models, (1.0, n_target / n)):
            loss = 0.0
            for h, w in zip(["<", *seq], seq):
                p = (word[w] * scale + 1) / (n_target + size)
                loss -= math.log((pair[h, w] * scale + MU * p) / (before[h] * scale + MU))
            assert abs(r[column] - loss / max(len(seq), 1)) < 1e-9


def test_entire_licence_texts_at_any_width(spark):
    import textwrap

    from regfleet.llm.licences import KNOWN, TEXTS

    texts = {p.stem: p.read_text() for p in TEXTS.glob("*.txt")}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= set(texts)
    wrapped = {name: texts[name] for name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0")}
    wrapped |= {name: texts[name].split("\n\n", 1)[1] for name in wrapped if name.startswith("BSD")}
    wrapped |= {name: next(t for n, t in KNOWN if n == name) for name in ("MIT", "ISC", "0BSD")}
    cases = list(texts.items())
    cases += [
        (name, "Copyright 2021-2024 Some Body <a@b>\n(c) 2020 Other\n© Third\nCopyright The Authors\n\n" + "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n")))
        for name, text in wrapped.items() for width in (*range(48, 90), 200)
    ]
    cases.append((None, "Copyright notice of nothing"))
    found = find_licences(frame(spark, [(k, t) for k, (_, t) in enumerate(cases)]), known_licences(spark)).collect()
    wrong = [(cases[r["doc_id"]][0], r["doc_id"], r["licence"]) for r in found if r["licence"] != cases[r["doc_id"]][0]]
    assert not wrong and len(found) == len(cases)


def test_contexts_find_spaced_numbers_and_settle(spark):
    """National forms with spaces and brackets; a chain of patterns longer than three rounds."""
    rows = [(100 + k, f"some words here. dial: +1 (555) 555-{1000 + k} then") for k in range(24)]
    rows += [(200 + k, f"paid with card: 4111 1111 1111 1111 and {k}") for k in range(6)]
    rows += [(200 + k, "card: 5500 0000 0000 0004 and card: 4012 8888 8888 1881 ok") for k in range(6, 12)]
    rows += [(1, "so dial: (555) 123-4567 now"), (2, "or dial: 555 123 4567, now"), (3, "card: 4111 1111 1111 1112 x"), (4, "in 555 123 4569 ways")]
    rows += [(5, "dial: 555 123 4568 5th")]
    for step in range(6):
        word = "dial:" if step == 0 else f"step{'abcdef'[step]}:"
        after = f"step{'abcdef'[step + 1]}:" if step < 5 else "last:"
        rows += [(300 + step, f"{w} 555-{step}{k}77 end") for k in range(3) for w in (word, *[after] * 5)]
    found = {}
    for r in digest(personal_data(frame(spark, rows))).collect():
        found.setdefault(r["doc_id"], []).append(r)
    spans = {k: v[0]["spans"] for k, v in found.items()}
    assert spans[1] == "phone:9:23" and spans[2] == "phone:9:21" and spans[3] == "card:6:25" and spans[4] == "" and spans[5] == "phone:6:18"
    assert all(r["n_added"] == 1 for step in range(6) for r in found[300 + step])


def test_line_runs_of_rows_without_id(spark):
    """Places without an id come first; all later copies of the run are cut."""
    run = "\n".join(vocabulary_text(k, 10) for k in range(5))
    rows = [(None, "a\n" + run), (None, "b\n" + run), (5, "c\n" + run), (6, "d\n" + run)]
    found = [(r["doc_id"], r["n_removed"]) for r in deduplicate_lines(frame(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted([(None, 0), (None, 5), (5, 5), (6, 5)], key=str)


def test_jaccard_keeps_one_row_of_each_group(spark):
    copy, alone = vocabulary_text(1, 60), vocabulary_text(2, 60)
    rows = [(1, copy), (5, alone), (5, copy), (None, copy + " x"), (None, vocabulary_text(3, 60)), (7, None), (7, "")]
    found = jaccard_components(frame(spark, rows)).filter("kept").select("doc_id", "n_shingles")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 56), (5, 56), (None, 56), (7, 0), (7, 0)], key=str)

"""Licences against SQL on texts of every kind; language and toxicity models against plain versions."""

import math
import re
import textwrap
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
from compare import difference
from pyspark.sql import functions as F

import __spark_entry__ as entry
from regfleet.llm import language, toxicity
from regfleet.llm.common import table
from regfleet.llm.licences import known_texts
from regfleet.llm.queries import op4_language, op5_toxicity, op7_licences

SF = "/root/testdata/sf0.001"


def licence_cases():
    known = known_texts()
    notices = [t for _, t in known if len(t) < 100]
    heads = [
        "Copyright (c) 2020 Some Body", "copyright: 2019, A", "Copyright by the X group", "Copyright The Authors", "(c) 2020 Other",
        "(C) copyright Other", "© Third", "  * Copyright Ünal", "All Rights Reserved.", "Copyright [yyyy] [name of owner]",
        "Copyright", "Copyright notices stay", "Copyright Notice", "COPYRIGHT LICENSE", "Copyright, Laws of a land", "copyright someone",
        "Copyrights 2020", "CopyrightX", "Copyright owner\nand this", "(c) a list item", "©", "Copyright,Holder", "Copyright:Us",
    ]
    texts = [None, "", "\n \n", *(t for _, t in known), *heads]
    texts += [f"{head}\n\n{notice}" for head, notice in zip(heads, notices * 3)]
    texts += [f"{head}\n{t}" for head in heads for _, t in known[:8]]
    for width in (30, 47, 64, 79, 200):
        texts += ["\n\n".join(textwrap.fill(p, width) for p in t.split("\n\n")) for _, t in known]
    texts += [t.replace("noninfringement", "non-\ninfringement").replace("license", "licence") for _, t in known]
    texts += [f"some prose\n\n{t}\n\nmore" for _, t in known] + [f"# {a}\nx\n// {b}" for a, b in zip(notices, notices[1:])]
    return texts


def test_licence_sql_states_the_operator(spark, tmp_path):
    texts = licence_cases()
    path = tmp_path / "documents.parquet"
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    found = op7_licences(spark, str(tmp_path))
    assert difference(found, con, entry.oracle_sql()["op7_licences"]) is None
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == len(texts) and sum(r["licence"] is not None for r in rows.values()) > 200


def words_of(text):
    """Runs of letters (and of bytes beyond ASCII) of the text, A-Z folded."""
    return re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def letter_grams(word, n):
    """(n-gram, context) for each letter of a word and its end; an n-gram that reaches the begin is marked."""
    for at in range(len(word) + 1):
        context = (at - (n - 1) < 0, word[max(0, at - (n - 1)) : at])
        yield (*context, word[at : at + 1]), context


def test_language_equals_a_plain_version(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    docs = docs.collect()
    known = [d for d in docs if d["h"] % 3 != 1 and d["text"] is not None and d["lang"] is not None]
    names = sorted({d["lang"] for d in known})
    assert max(Counter(d["lang"] for d in known).values()) <= language.SAMPLE_PER_LANGUAGE
    seen = [defaultdict(lambda: [0] * len(names)) for _ in range(language.ORDER + 1)]
    for k, name in enumerate(names):
        for word, times in Counter(w for d in known if d["lang"] == name for w in words_of(d["text"])).items():
            seen[0][word][k] += times
            for n in range(1, language.ORDER + 1):
                for gram, _ in letter_grams(word, n):
                    seen[n][gram][k] += times
    value = []
    for counts in seen:
        counts = {key: c for key, c in counts.items() if sum(c) >= language.LEAST}
        totals = [sum(c[k] for c in counts.values()) + 0.5 * max(1, len(counts)) for k in range(len(names))]
        logs = {key: [math.log((c + 0.5) / t) for c, t in zip(of, totals)] for key, of in counts.items()}
        value.append({key: [np.float32(x - sum(of) / len(of)) for x in of] for key, of in logs.items()})

    def word_score(word):
        if word in value[0]:
            return value[0][word]
        by_order = [[gram for gram, _ in letter_grams(word, n)] for n in range(language.ORDER, 0, -1)]
        letters = [
            next((value[n][grams[at]] for n, grams in zip(range(language.ORDER, 0, -1), by_order) if grams[at] in value[n]), None)
            for at in range(len(word) + 1)
        ]
        return [sum(x[k] for x in letters if x is not None) / len(letters) for k in range(len(names))]

    cache, found = {}, {r["doc_id"]: r for r in op4_language(spark, SF).collect()}
    assert len(found) == len(docs)
    unseen = 0
    for d in docs:
        r = found[d["doc_id"]]
        assert r["held_out"] == (d["h"] % 3 == 1)
        if not re.search(r"[^\W\d_]", d["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = [0.0] * len(names)
        for word in words_of(d["text"]):
            unseen += word not in value[0]
            cache[word] = cache[word] if word in cache else word_score(word)
            total = [a + float(b) for a, b in zip(total, cache[word])]
        best = max(total)
        if sorted(total)[-2] < best - 1e-3:
            assert r["lang_pred"] == names[total.index(best)]
        assert abs(r["score"] - 1 / sum(math.exp(x - best) for x in total)) < 1e-4
    assert unseen > 100


def log_ratios(counts):
    """Log ratios toxic / ordinary by n-gram and by context from {word: (ordinary, toxic)}, order by order."""
    order, cut = toxicity.ORDER, toxicity.DISCOUNT
    top, below = defaultdict(lambda: [0, 0]), defaultdict(set)
    chain, of_context = {}, defaultdict(set)
    for word, (ordinary, toxic) in counts.items():
        grams = [list(letter_grams(word, n)) for n in range(1, order + 1)]
        for at in range(len(word) + 1):
            line = [((n, g[at][0]), (n, g[at][1])) for n, g in enumerate(grams, 1)]
            gram = line[-1][0]
            top[gram][0] += ordinary
            top[gram][1] += toxic
            chain[gram] = line
            for (g, context), (longer, _) in zip(line, line[1:]):
                below[g].add(longer)
                of_context[context].add(g)
    kinds = sum(len(longer) for g, longer in below.items() if g[0] == 1)
    lower = {}

    def shared(line):
        p = len(below[line[0][0]]) / kinds
        for g, context in line[1:-1]:
            if g not in lower:
                mates = of_context[context]
                lower[g] = (max(len(below[g]) - cut, 0) + cut * len(mates) * p) / sum(len(below[m]) for m in mates)
            p = lower[g]
        return p

    members = defaultdict(list)
    for gram, line in chain.items():
        members[line[-1][1]].append(gram)
    gram_ratio, context_ratio = {}, {}
    for context, grams in members.items():
        back, total = [], []
        for c in (0, 1):
            total.append(sum(top[g][c] for g in grams))
            back.append(cut * sum(top[g][c] > 0 for g in grams) / total[c] if total[c] else 1.0)
        context_ratio[context] = math.log(back[1] / back[0])
        for g in grams:
            p = [max(top[g][c] - cut, 0) / max(total[c], 1) + back[c] * shared(chain[g]) for c in (0, 1)]
            gram_ratio[g] = math.log(p[1] / p[0])
    return gram_ratio, context_ratio


def mean_ratio(text, ratios, cache):
    gram_ratio, context_ratio = ratios
    words = words_of(text)
    for word in words:
        if word not in cache:
            n = toxicity.ORDER
            total = sum(gram_ratio.get((n, g), context_ratio.get((n, c), 0.0)) for g, c in letter_grams(word, n))
            cache[word] = math.log1p(toxicity.TOXIC_SHARE * math.expm1(min(total, 500)))
    return sum(cache[w] for w in words) / (len(words) + toxicity.SMOOTH)


def test_toxicity_equals_a_plain_version(spark):
    docs = table(spark, SF, "documents").select(
        "doc_id",
        "text",
        F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"),
        (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)) == 0).alias("check"),
    ).collect()
    marked = defaultdict(int)
    for r in table(spark, SF, "labels").filter("toxic IN (0, 1)").collect():
        marked[r["doc_id"]] = max(marked[r["doc_id"]], r["toxic"])
    sample = [(d, marked[d["doc_id"]]) for d in docs if d["h"] % 4 != 2 and d["doc_id"] in marked and d["text"] is not None]
    counts = {False: defaultdict(lambda: [0, 0]), True: defaultdict(lambda: [0, 0])}
    for d, toxic in sample:
        for word in words_of(d["text"]):
            counts[True][word][toxic] += 1
            if not d["check"]:
                counts[False][word][toxic] += 1

    model = toxicity.fit_toxicity(table(spark, SF, "documents"), table(spark, SF, "labels"))
    trial, cache = log_ratios(counts[False]), {}
    x = np.array([mean_ratio(d["text"], trial, cache) for d, _ in sample if d["check"]])
    y = np.array([float(toxic) for d, toxic in sample if d["check"]])
    assert set(y) == {0, 1}
    # The fitted curve is where the loss, with its penalty on the slope of standardised values, no longer falls.
    miss = 1 / (1 + np.exp(-(model.slope * x + model.intercept))) - y
    z = (x - x.mean()) / x.std()
    assert abs(miss.sum()) < 1e-4 and abs((miss * z).sum() + 0.1 * model.slope * x.std()) < 1e-4

    final, cache = log_ratios(counts[True]), {}
    found = {r["doc_id"]: r for r in op5_toxicity(spark, SF).collect()}
    assert len(found) == len(docs)
    for d in docs:
        r, ratio = found[d["doc_id"]], mean_ratio(d["text"], final, cache)
        assert abs(r["score"] - 1 / (1 + math.exp(-(ratio * model.slope + model.intercept)))) < 1e-6
        assert r["held_out"] == (d["h"] % 4 == 2) and r["predicted"] == (r["score"] >= 0.3)


def test_language_model_workers_hold_little_of_a_batch():
    """The arrays that a worker holds while it counts words do not grow with the batch."""
    import random
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from regfleet.llm import lm_score

    rng = random.Random(1)
    texts = [" ".join("w" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "wanted": [True] * len(texts)})
    tracemalloc.start()
    list(lm_score._word_rows(SimpleNamespace(value=None))(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6


def test_language_model_rows_reach_workers_in_small_batches(spark):
    """Neither the workers nor the JVM hold a large batch, whatever the texts; the session's setting is as before."""
    from types import SimpleNamespace

    import pyarrow as pa

    from regfleet.llm import lm_score
    from regfleet.session import batches_of

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "rows": [batch.num_rows]})

    with batches_of(spark, lm_score._BATCH):
        texts = spark.range(0, 8000, 1, 2).selectExpr("repeat('some words ', 200) AS text")
        found = texts.mapInArrow(sizes, "bytes bigint, rows bigint").collect()
        assert spark.conf.get(name) == str(lm_score._BATCH)
    assert sum(r["rows"] for r in found) == 8000 and max(r["bytes"] for r in found) < 2 * lm_score._BATCH

    docs = spark.createDataFrame([(k, f"red green {'blue ' * k}") for k in range(20)], "doc_id bigint, text string")
    scored = lm_score.score_documents(docs, docs.filter("doc_id < 5").select("doc_id"))
    assert spark.conf.get(name) == before
    # No step with a worker is left to run with the session's own batches.
    assert "MapInArrow" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.count() == 20

    words = " ".join("".join("abcdefghij"[int(c)] for c in f"{k:06}") for k in range(200_000))
    batch = pa.RecordBatch.from_pydict({"text": [words], "wanted": [True]})
    sent = list(lm_score._word_rows(SimpleNamespace(value=None))(iter([batch])))
    assert max(b.nbytes for b in sent) < 3e6 and sum(b.num_rows for b in sent) == 200_001

"""The registered text queries: against SQL, or against plain versions where SQL cannot express them."""

import hashlib
import re
import zlib

import pytest
from compare import difference, engine

import __spark_entry__ as entry
import corpus_pipeline
from regfleet.llm.common import freeze, table
from regfleet.llm.toxicity import fit_toxicity, toxicity_score

SF = "/root/testdata/sf0.001"
CHECKED = [n for n in entry.llm.queries() if n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def con():
    return engine(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) if k % 2 == 0 else int("0246813579"[int(c)]) for k, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [
        f"{kind}:{m.start()}:{m.end()}" for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(kind, m[0])
    ]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pii_base_spans(spark, sf):
    sf = f"/root/testdata/{sf}"
    found = {r["doc_id"]: r for r in entry.queries()["op6_pii"](spark, sf).collect()}
    texts = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(found) == len(texts)
    for doc_id, text in texts:
        spans = base_spans(text)
        assert found[doc_id]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(found[doc_id]["spans"].split(",")) | {""}
        assert [found[doc_id][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    rows = entry.queries()["op4_language"](spark, sf).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    unseen = [r for r in rows if r["held_out"] and docs[r["doc_id"]]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in unseen) >= 0.97 * len(unseen)


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    rows = entry.queries()["op5_toxicity"](spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    bad = [r["score"] for r in unseen if labels[r["doc_id"]]]
    good = [r["score"] for r in unseen if not labels[r["doc_id"]]]
    above = sum(b > g for b in bad for g in good) / (len(bad) * len(good))
    assert above > 0.9 and sum(g >= 0.3 for g in good) < 0.03 * len(good)


# --- the pipeline ----------------------------------------------------------


def words_of(text):
    return (text or "").encode().lower().split()


def plain_lines(docs, least=30):
    """Documents (id, text) without line runs of ``least`` words that begin earlier, by comparing all windows."""
    windows, first = [], {}
    for doc_id, text in sorted(docs.items()):
        lines = [(k, x.strip(" \t\r\f\v")) for k, x in enumerate(text.split("\n"))]
        lines = [(k, x, len(x.split())) for k, x in lines if x]
        for step in (1, -1):
            for start in range(len(lines)):
                total, stop = 0, start
                while 0 <= stop < len(lines):
                    total += lines[stop][2]
                    if total >= least:
                        lo, hi = min(start, stop), max(start, stop)
                        run = tuple(x for _, x, _ in lines[lo : hi + 1])
                        windows.append((run, (doc_id, lines[lo][0]), lines[hi][0]))
                        first[run] = min(first.get(run, (doc_id, lines[lo][0])), (doc_id, lines[lo][0]))
                        break
                    stop += step
    gone = {}
    for run, (doc_id, lo), hi in windows:
        if first[run] < (doc_id, lo):
            gone.setdefault(doc_id, set()).update(range(lo, hi + 1))
    out = {}
    for doc_id, text in docs.items():
        rest = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(doc_id, ()))
        if doc_id not in gone or rest.strip(" \t\r\n\f\v"):
            out[doc_id] = rest
    return out


def plain_copies(docs, width=5, part=80):
    sets = {}
    for doc_id, text in docs.items():
        w = words_of(text)
        sets[doc_id] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    first = {d: d for d in docs}

    def root(d):
        while first[d] != d:
            d = first[d]
        return d

    ids = sorted(d for d in docs if sets[d])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 100 * both >= part * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                first[high] = low
    return {d: t for d, t in docs.items() if root(d) == d}


def plain_leaks(docs, items, width=10):
    def cut(text):
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)

    grams = set()
    for item in items:
        w = cut(item)
        grams |= {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    sizes = {len(g) for g in grams}
    clean = {}
    for doc_id, text in docs.items():
        w = cut(text)
        if not any(tuple(w[k : k + n]) in grams for n in sizes for k in range(len(w) - n + 1)):
            clean[doc_id] = text
    return clean


def plain_mix(rows, most=3):
    """(taken, target) by document, from (id, source, text)."""
    sizes = {d: (s, len(words_of(t))) for d, s, t in rows}
    sources = sorted({s for s, _ in sizes.values()}, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    total = {s: sum(n for x, n in sizes.values() if x == s) for s in sources}
    target, left, open_ = {}, float(sum(total.values())), set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: float(most * total[s]) for s in full}
        left -= sum(most * total[s] for s in full)
        open_ -= full
    taken = dict.fromkeys(sizes, 0)
    for s in sources:
        order = sorted((hashlib.md5(str(d).encode()).hexdigest(), d) for d, (x, _) in sizes.items() if x == s)
        need = round(target[s])
        for _ in range(most):
            for _, d in order:
                use = min(need, sizes[d][1])
                taken[d] += use
                need -= use
    return {d: (taken[d], target[sizes[d][0]]) for d in sizes}


def test_pipeline_equals_plain_version(spark):
    """Every stage over the whole table; the scores come from the model, what follows from plain Python."""
    docs = freeze(table(spark, SF, "documents"), "raw")
    score = toxicity_score(spark, fit_toxicity(docs, table(spark, SF, "labels")))
    scored = docs.select("doc_id", "text", "source", score.alias("score"))
    raw = {r["doc_id"]: r for r in scored.collect()}
    texts = {d: r["text"] for d, r in raw.items() if r["score"] < corpus_pipeline.TOXIC}
    texts = plain_copies(plain_lines(texts))
    texts = plain_leaks(texts, [r["text"] for r in table(spark, SF, "benchmark").collect()])
    want = plain_mix([(d, raw[d]["source"], t) for d, t in texts.items()])
    got = {r["doc_id"]: (r["taken"], r["target"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    assert all(got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) < 1e-6 for d in want)


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name


def test_near_copies_stage_tells_rows_of_an_id_apart(spark):
    """A unique text stays though another row of its id is a copy."""
    a, b = (" ".join(f"{k}w{n}" for n in range(50)) for k in "ab")
    docs = spark.createDataFrame([(1, a), (5, b), (5, a), (None, a)], "doc_id bigint, text string")
    rows = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted(map(tuple, rows)) == sorted([(1, a), (5, b)])

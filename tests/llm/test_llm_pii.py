"""Learned identifiers against a plain version, and long texts full of identifiers."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from test_llm_queries import PATTERNS, base_spans

from regfleet.llm.pii import _RUN, _RUN_SHAPES, _SHAPES, _TOKEN, digest, personal_data


def plain_matches(text, pattern):
    end = 0
    for m in re.finditer(pattern, text, re.ASCII):
        gap = re.sub("[\n\r\t]", " ", text[end : m.start()])
        yield m.start(), m[0], gap.rstrip(" ").split(" ")[-1].lower()
        end = m.end()


def shape(t, shapes):
    return next((k for k, p in shapes.items() if re.search(p, t)), None)


def plain_scan(text):
    valid = set(base_spans(text))
    base = [
        (k, s, s + len(t), t, w) for k, p in PATTERNS.items() for s, t, w in plain_matches(text, p) if f"{k}:{s}:{s + len(t)}" in valid
    ]
    found = []
    for s, t, w in plain_matches(text, _RUN):
        t = re.sub("[^0-9]+$", "", re.sub("[0-9]+[A-Za-z_@]$", "", t))
        found.append((shape(t, _RUN_SHAPES), s, s + len(t), t, w))
    runs = [x for x in found if x[0] and not any(b[1] < x[2] and x[1] < b[2] for b in base)]
    tokens = []
    for s, t, w in plain_matches(text, _TOKEN):
        skip = len(re.match("[^0-9A-Za-z+(]*", t)[0])
        t = re.sub("[^0-9A-Za-z]+$", "", t[skip:])
        tokens.append((shape(t, _SHAPES), s + skip, s + skip + len(t), t, w))
    return base, runs + [x for x in tokens if x[0] and not any(b[1] < x[2] and x[1] < b[2] for b in base + runs)]


def plain_spans(texts):
    scanned = [plain_scan(t) for t in texts]
    seen, seeds = Counter(), set()
    for base, tokens in scanned:
        seen.update((k, w, t) for k, _, _, t, w in base + tokens if w)
        seeds.update((k, w, t) for k, _, _, t, w in base if w)
    instances = Counter((k, w) for k, w, _ in seen)
    totals = Counter(w for t in texts for w in re.split("[ \n\r\t]+", t.lower()))
    edges = {e: n for e, n in seen.items() if instances[e[:2]] >= 3 and totals[e[1]]}
    trusted, size = {(k, t) for k, w, t in edges if (k, w, t) in seeds}, -1
    first = set(trusted)
    while len(trusted) > size:
        size = len(trusted)
        known = defaultdict(list)
        for (k, w, t), n in edges.items():
            if (k, t) in trusted:
                known[k, w].append(n)
        strong = {p: sum(ns) / totals[p[1]] for p, ns in known.items() if len(ns) >= 3 and sum(ns) >= 0.5 * totals[p[1]]}
        doubt = defaultdict(float)
        for k, w, t in edges:
            if (k, w) in strong:
                doubt[k, t] += math.log(max(1 - min(strong[k, w], 1.0), 1e-9))
        trusted = first | {x for x, d in doubt.items() if 1 - math.exp(d) >= 0.8}
    order = list(PATTERNS)
    out = []
    for base, tokens in scanned:
        spans = sorted((order.index(k), s, e) for k, s, e, t, _ in base + [x for x in tokens if (x[0], x[3]) in trusted])
        out.append(",".join(f"{order[k]}:{s}:{e}" for k, s, e in spans))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_the_plain_version(spark, seed):
    rng = random.Random(seed)
    seeds = ["amy{}@site.com", "10.0.{}.7", "+49 30 12345{}", "4111111111111111"]
    others = ["bob{}@host", "555123{}4567", "(555) 123-4{}", "300.1.{}.1", "-----5.{}--", "+1 1 1", "x{}y", "é😀{}", "1234 5678 9012 {}", "amy@", "+", "("]
    cues = ["mail", "Call", "ip", "number:", "the", "a\t"]
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(12)):
            cue = rng.choice(cues)
            item = rng.choice(seeds if rng.random() < 0.6 else others).format(rng.randrange(30))
            parts.append(rng.choice([f"{cue} {item}", f"{cue} {item}", item, f"{cue}\n({item}).", f"{item}{item}"]))
        texts.append(rng.choice([" ", "\n", ", "]).join(parts))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in digest(personal_data(rows)).collect()}
    assert [found[i]["spans"] for i in range(len(texts))] == plain_spans(texts)
    assert sum(r["n_added"] for r in found.values()) > 0


def test_a_text_of_many_identifiers(spark):
    n = 100_000
    texts = [
        " ".join(f"x{i}" for i in range(n)),
        " ".join(f"10.0.{i // 256 % 256}.{i % 256}" for i in range(n)),
        "+" + "1 " * n,
        "7" * n,
        "1" + "-" * n + "1 5" + "(" * n + "x",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    began = time.monotonic()
    found = {r["doc_id"]: r for r in digest(personal_data(rows)).collect()}
    assert time.monotonic() - began < 120
    assert [found[i]["n_ip"] for i in range(5)] == [0, n, 0, 0, 0]
    assert found[1]["spans"].split(",") == base_spans(texts[1])

"""Registered queries of the text operators and the SQL they are checked with."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table
from .decontaminate import contamination
from .embedding_dedup import near_vectors
from .jaccard_join import Threshold, jaccard_components
from .language import identify_languages
from .licences import PROSE, SPELLINGS, find_licences, known_licences, known_texts
from .line_dedup import deduplicate_lines
from .lm_score import score_documents
from .mixing import mix_sources
from .periodic_runs import periodic_runs
from .pii import digest, personal_data
from .suffix_dedup import remove_repeated_strings
from .toxicity import toxicity
from .whitening import whiten


def op1_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    found = jaccard_components(table(spark, d, "documents"), width=3, threshold=Threshold(90, 100))
    return found.select("doc_id", "n_shingles", "component_id")


def op2_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_vectors(table(spark, d, "embeddings"))


def op3_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def op4_language(spark: SparkSession, d: str) -> DataFrame:
    return identify_languages(table(spark, d, "documents"))


def op5_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op6_pii(spark: SparkSession, d: str) -> DataFrame:
    return digest(personal_data(table(spark, d, "documents")))


def op7_licences(spark: SparkSession, d: str) -> DataFrame:
    found = find_licences(table(spark, d, "documents"), known_licences(spark))
    return found.select(
        "doc_id", "licence", F.array_join("notices", ",").alias("notices"), F.size("notices").cast("bigint").alias("n_notices")
    )


def op8_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    """Per document what the mix takes and the training positions of its copies, null where there are fewer."""
    mixed = mix_sources(table(spark, d, "documents"))
    positions = [F.expr(f"get(copies, {n}).position").alias(name) for n, name in enumerate(("position", "position_2", "position_3"))]
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", *positions)
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op9_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return deduplicate_lines(table(spark, d, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_lm_score(spark: SparkSession, d: str) -> DataFrame:
    """Documents by how much closer they are to those labelled as good than to all."""
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    scored = score_documents(table(spark, d, "documents").select("doc_id", "text"), good)
    return scored.select("doc_id", "n_tokens", "loss_target", "loss_background", "score")


def op11_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    cut = remove_repeated_strings(table(spark, d, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["begin"]).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_embedding_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whiten(table(spark, d, "embeddings"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """Each tenth text, by crc32 of its id, repeats some of its words from a place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.expr("h div 10").alias("g"))
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    repeats = """CASE WHEN h % 10 = 0 AND size(words) > 0 THEN array_join(transform(words, (w, i) -> CASE WHEN i < g % size(words) THEN w
        ELSE get(words, CAST(g % size(words) + (i - g % size(words)) % (1 + (size(words) - g % size(words)) div (3 + g % 8)) AS INT)) END), ' ')
        ELSE text END"""
    split = chosen.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    return split.select("doc_id", F.expr(repeats).alias("text"))


def op13_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    found = periodic_runs(_with_periods(table(spark, d, "documents")))
    strongest = F.expr(
        "reduce(runs, get(runs, 0), (best, run) -> CASE WHEN run.length * best.period > best.length * run.period THEN run ELSE best END)"
    )
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", strongest).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_language": op4_language,
        "op5_toxicity": op5_toxicity,
        "op6_pii": op6_pii,
        "op7_licences": op7_licences,
        "op8_mix_sources": op8_mix_sources,
        "op9_line_dedup": op9_line_dedup,
        "op10_lm_score": op10_lm_score,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_periodic_runs": op13_periodic_runs,
    }


_FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

_REACH = """
reach(a, b) AS (SELECT id, id FROM ids UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
"""

OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g
  FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y USING (gram) WHERE x.doc_id <> y.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
ids AS (SELECT doc_id AS id FROM documents),
{_REACH}
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE a = s.doc_id) AS component_id FROM s
"""


OP2 = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
v AS (
  SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM e
  WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id
  WHERE p.norm > 0 AND q.norm > 0 AND list_dot_product(p.x, q.x) / (p.norm * q.norm) >= 0.93),
ids AS (SELECT vec_id AS id FROM embeddings),
{_REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links,
  (SELECT min(b) FROM reach WHERE a = vec_id) AS component_id, vec_id = (SELECT min(b) FROM reach WHERE a = vec_id) AS kept
FROM embeddings
"""

_BENCHMARK_WORDS = rf"list_filter(string_split_regex({_FOLDED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_BENCHMARK_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_BENCHMARK_WORDS} AS w FROM benchmark),
g AS (
  SELECT item_id, least(len(w), 10) AS n,
    unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i : i + 9], ' '))) AS gram
  FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, lens WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.pos, p.n, g.item_id FROM p JOIN g ON array_to_string(p.w[p.pos : p.pos + p.n - 1], ' ') = g.gram AND g.n = p.n),
places AS (SELECT doc_id, count(DISTINCT pos) AS c FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS pos FROM hits) GROUP BY 1),
found AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(c, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _copyright_sql() -> tuple[str, str]:
    """The rule for lines that state a copyright, for patterns without look-around.

    The first pattern finds prose after the word; a character that is neither letter nor number, put before the prose,
    keeps the second one from taking it for a holder, and is lost with the space beside it.
    """
    space = r"[\x20\x09\x0B-\x0D]"
    prose = rf"((?i:copyright)(?:{space}+[:,]?|[:,]){space}*)((?i:{PROSE})\b)"
    date = r"[\[{(<]?(?:[0-9]{4}|(?i:yyyy|years?)\b)"
    holder = rf"(?:{space}+[:,]?|[:,]){space}*\p{{Lu}}"
    word = rf"(?i:copyright)(?:{space}*[:,]?{space}*(?:(?i:\(c\)|©)|{date}|(?i:by)\b)|{holder})"
    sign = rf"\([cC]\){space}*(?:{date}|(?i:copyright))|©{space}*[^\x20\x09-\x0D]"
    return prose, rf"(?m)^[^\p{{L}}\p{{N}}\n]*(?:{word}|{sign}|(?i:all rights reserved))[^\n]*$"


def _canonical_sql(text: str) -> str:
    prose, line = _copyright_sql()
    marked = rf"regexp_replace({text}, '{prose}', '\1' || chr(57344) || '\2', 'g')"
    out = rf"lower(regexp_replace({marked}, '{line}', '', 'g'))"
    for old, new in SPELLINGS.items():
        out = f"replace({out}, '{old}', '{new}')"
    return rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


def _one_line_sql(lines: str) -> str:
    out = rf"trim(regexp_replace({lines}, '[\n ]+', ' ', 'g'))"
    for old, new in SPELLINGS.items():
        if " " in (words := old.replace("-", " ").strip()):
            out = f"replace({out}, '{words}', '{new}')"
    return out


def _licence_sql() -> str:
    known = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in known_texts())
    return rf"""
WITH known AS (
  SELECT canon, min(licence) AS licence FROM (
    SELECT {_one_line_sql(_canonical_sql("t"))} AS canon, licence FROM (VALUES {known}) k(licence, t)) WHERE canon <> '' GROUP BY 1),
d AS (SELECT doc_id, coalesce({_canonical_sql("text")}, '') AS canon FROM documents),
parts AS (
  SELECT doc_id, unnest(list_concat(string_split(canon, chr(10)), string_split_regex(canon, '\n *\n[\n ]*'))) AS part FROM d),
notices AS (
  SELECT doc_id, list_sort(list(DISTINCT licence)) AS ls FROM parts JOIN known ON {_one_line_sql("part")} = known.canon GROUP BY 1)
SELECT d.doc_id, k.licence, coalesce(array_to_string(ls, ','), '') AS notices, coalesce(len(ls), 0)::BIGINT AS n_notices
FROM d LEFT JOIN known k ON {_one_line_sql("d.canon")} = k.canon LEFT JOIN notices USING (doc_id)
"""


OP8 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, md5(text), '')) AS name FROM documents),
q AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS no FROM q),
w AS (SELECT *, [1.0::DOUBLE, 2.0, 3.0][1 + no % 3] AS weight, [-0.5::DOUBLE, 0.0, 0.5][1 + no % 3] AS ramp FROM n),
f AS (
  SELECT *, row_number() OVER o AS place,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, no)),
l AS (SELECT min_by(level, place) AS level FROM f WHERE level * weight <= 3 * source_size),
s AS (SELECT source, source_size, ramp, least(l.level * weight, (3 * source_size)::DOUBLE) AS target FROM f, l),
p AS (
  SELECT d.*, source_size, target, ramp, round(target)::BIGINT AS take,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY name, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (
  SELECT *, (greatest(least(take - before, size), 0) + greatest(least(take - before - source_size, size), 0)
    + greatest(least(take - before - 2 * source_size, size), 0))::BIGINT AS taken,
    list_transform(range(3), lambda n: CASE WHEN size > 0 AND before + n * source_size < take THEN
      least((before + n * source_size)::DOUBLE / greatest(take, 1)::DOUBLE, 1.0::DOUBLE) END) AS us FROM p),
t AS (
  SELECT *, list_transform(us, lambda u:
    CASE WHEN ramp = 0 THEN u ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u) - (1 - ramp)) / (2 * ramp) END) AS ts FROM c)
SELECT doc_id, size, source_size, target, taken, ts[1] AS position, ts[2] AS position_2, ts[3] AS position_3 FROM t
"""

OP9 = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, i, trim(ls[i], concat(' ', chr(9), chr(11), chr(12), chr(13))) AS line
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
n AS (
  SELECT doc_id, i, line, len(string_split_regex(line, '[\x20\x09-\x0D]+')) AS w,
    row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM u WHERE line <> ''),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM n),
whole AS (SELECT doc_id, list(line ORDER BY p) AS ls, list(i ORDER BY p) AS rows FROM n GROUP BY 1),
grown AS (
  SELECT a.doc_id, a.p AS s, min(b.p) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.upto - a.upto + a.w >= 30
  GROUP BY 1, 2
  UNION
  SELECT a.doc_id, max(b.p), a.p FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.p <= a.p AND a.upto - b.upto + b.w >= 30
  GROUP BY a.doc_id, a.p),
runs AS (
  SELECT doc_id, s, rows[s] AS lo, rows[e] AS hi, array_to_string(ls[s:e], chr(10)) AS content FROM grown JOIN whole USING (doc_id)),
marked AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(s) OVER o AS fs FROM runs
  WINDOW o AS (PARTITION BY content ORDER BY doc_id, s)),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(lo, hi + 1)))) AS g FROM marked WHERE (doc_id, s) <> (fd, fs) GROUP BY 1)
SELECT l.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed,
  CASE WHEN g IS NULL THEN text
    ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(g, i)), chr(10)), '') END AS text
FROM l LEFT JOIN gone USING (doc_id)
"""

OP11 = """
WITH t AS (SELECT doc_id, row_number() OVER () AS row_no, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT row_no, unnest(range(0, length(x) // 2 - 199)) AS pos, x FROM t),
s AS (SELECT row_no, pos, md5(substring(x, 2 * pos + 1, 400)) AS piece FROM p),
g AS (SELECT row_no, pos FROM s QUALIFY count(*) OVER (PARTITION BY piece) > 1),
o AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY row_no ORDER BY pos) > 200, true) AS opens FROM g),
n AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY row_no ORDER BY pos) AS no FROM o),
r AS (SELECT row_no, no, min(pos) AS lo, max(pos) + 200 AS hi FROM n GROUP BY 1, 2),
k AS (SELECT row_no, no, hi AS keep_from, lead(lo) OVER (PARTITION BY row_no ORDER BY no) AS keep_to FROM r),
kept AS (
  SELECT row_no, string_agg(CASE WHEN keep_to IS NULL THEN substring(x, 2 * keep_from + 1) ELSE substring(x, 2 * keep_from + 1, 2 * (keep_to - keep_from)) END,
    '' ORDER BY no) AS rest FROM k JOIN t USING (row_no) GROUP BY 1),
sums AS (SELECT row_no, sum(hi - lo) AS removed, count(*) AS spans, min(lo) AS first FROM r GROUP BY 1)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN x ELSE substring(x, 1, 2 * first) || rest END)) AS kept_sha256
FROM t LEFT JOIN sums USING (row_no) LEFT JOIN kept USING (row_no)
"""

OP13 = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) AS h FROM documents),
u AS (SELECT *, len(o) AS n, h // 10 AS g FROM t),
v AS (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM u),
d AS (
  SELECT doc_id, row, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE o END AS w FROM v),
e AS (SELECT row, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM d),
pairs AS (SELECT x.row, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT row, q, min(i) AS s, count(*) + q AS len FROM islands GROUP BY row, q, island),
runs AS (SELECT row, s, len, min(q) AS q FROM stretches WHERE len >= greatest(6, 4 * q) GROUP BY row, s, len),
gone AS (SELECT row, list_distinct(flatten(list(range(s + q, s + len)))) AS dropped FROM runs GROUP BY row),
listed AS (SELECT row, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY row),
best AS (
  SELECT a.* FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE a.row = b.row AND (
    b.len * a.q > a.len * b.q OR b.len * a.q = a.len * b.q AND (b.s < a.s OR b.s = a.s AND b.q < a.q)))),
left_over AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept FROM e LEFT JOIN gone USING (row)
  WHERE dropped IS NULL OR NOT list_contains(dropped, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period,
  (1000 * len // q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (row) LEFT JOIN best USING (row) LEFT JOIN left_over USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": OP1,
        "op2_embedding_dedup": OP2,
        "op3_decontamination": OP3,
        "op7_licences": _licence_sql(),
        "op8_mix_sources": OP8,
        "op9_line_dedup": OP9,
        "op11_suffix_dedup": OP11,
        "op13_periodic_runs": OP13,
    }

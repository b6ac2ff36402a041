"""Quality rules: a threshold table compiled into Spark expressions.

``RULES`` is data: each row bounds one ratio of per-document counts. The table
is compiled into one boolean column over counts that are themselves built-in
expressions, so a document is judged in the scan's own projection: no user
function, no shuffle, nothing kept between rows.

Defined results: a null or blank text has no words and fails; a document of
any length is read whole; repeated rows are judged one by one; an empty table
gives an empty result; other columns are left as they are, whatever their
names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import fresh, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "with", "was", "for", "on", "be", "have", "by", "or", "an", "at", "from", "this", "are",
    "der", "die", "das", "und", "ist", "nicht", "mit", "von", "den", "zu", "ein", "als", "auf", "für", "sich", "es",
    "le", "la", "les", "des", "et", "est", "que", "une", "dans", "pour", "un", "de", "en", "qui", "sur", "pas",
    "el", "los", "las", "y", "del", "una", "con", "para", "por", "se", "no", "su",
)


class Rule(NamedTuple):
    """``low`` <= 100 * ``over`` / ``under`` <= ``high``; None leaves a side open."""

    name: str
    over: str
    under: str
    low: int | None
    high: int | None


#: Length, symbol, stop-word and line ratios, in percent.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 2000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_kinds", "one", 200, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 40),  # one of three lines may come again
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
)


def compiled(rules: tuple[Rule, ...], count) -> Column:
    """One boolean over the counts, in whole numbers; ``count`` maps a name to its column."""
    verdict = F.lit(True)
    for r in rules:
        value, of = count(r.over) * 100, count(r.under)
        if r.low is not None:
            verdict = verdict & (value >= of * r.low)
        if r.high is not None:
            verdict = verdict & (value <= of * r.high)
    return verdict


def measured(docs: DataFrame, text: str = "text", into: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with a struct ``into``: the counts, ``base_failed`` and ``kept``.

    Repeated words: words inside an 8-word window that occurs at least twice
    in the text. Windows are compared by a 64-bit hash of their word hashes;
    positions of equal windows are found by sorting (hash, position) pairs,
    and only in texts that have any.
    """
    t, w, h, g, s, p, m = fresh(docs, "t_", "words_", "hash_", "window_", "sorted_", "repeat_", into)
    if m != into:
        raise ValueError(f"{into} is a column already")
    at = lambda a, i: F.get(F.col(a), i)
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(w, words(F.col(t)))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    df = df.withColumn(g, F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[at(h, i + k) for k in range(WINDOW)]))))
    df = df.withColumn(s, F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda i, j: F.coalesce(at(s, i)["h"] == at(s, j)["h"], F.lit(False))
    twice = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i + 1) | F.when(i > 0, same(i, i - 1)).otherwise(False)), lambda i: at(s, i)["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(twice, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")), lambda a: a["n"])
    df = df.withColumn(p, F.when(F.col(s).isNotNull(), covered).otherwise(0))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
        "n_stop_kinds": F.size(F.array_intersect(F.split(F.lower(t), r"[\x20\x09-\x0D]+"), F.array(*map(F.lit, STOP_WORDS)))),
        "n_repeat_words": F.col(p),
    }
    df = df.withColumn(m, F.struct(*[c.cast("long").alias(k) for k, c in counts.items()]))
    of = lambda k: F.lit(1) if k == "one" else F.col(m)[k]
    # always true, but not deterministic to the optimizer: a filter on the verdict stays above
    # these projections, as pushing it down would work out each step again wherever it is used
    here = F.monotonically_increasing_id() >= 0
    failed = (of("n_words") < MIN_WORDS) | (of("n_repeat_words") * 100 > of("n_words") * MAX_REPEAT_PERCENT)
    return df.withColumn(m, F.struct(f"{m}.*", failed.alias("base_failed"), (~failed & compiled(rules, of) & here).alias("kept"))).drop(t, w, h, g, s, p)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    (m,) = fresh(docs, "quality_verdict")
    return measured(docs, text, m, rules).where(F.col(m)["kept"]).drop(m)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = F.col("quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return measured(docs).select("doc_id", *[q[k].alias(k) for k in names])


def _sql() -> str:
    space, stops = r"[\x20\x09-\x0D]", ", ".join(f"'{w}'" for w in STOP_WORDS)
    checks = []
    for r in RULES:
        under = "1" if r.under == "one" else r.under
        checks += [f"100 * {r.over} >= {r.low} * {under}"] * (r.low is not None) + [f"100 * {r.over} <= {r.high} * {under}"] * (r.high is not None)
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '{space}+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…){space}*$'))) AS n_ellipsis_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^{space}*[-*•]'))) AS n_bullet_lines,
         len(list_intersect(list_distinct(string_split_regex(lower(t), '{space}+')), [{stops}])) AS n_stop_kinds,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(checks)} AS kept
FROM f"""


ORACLE_SQL = _sql()

"""Quality rules: a threshold table compiled into one projection.

``MEASURES`` names what is measured, ``RULES`` bounds it. Both compile into native columns,
so a scan, the measures and the verdict run in one stage without a shuffle and without
user functions. A text with less than 50 words, or with more than half of its words in
repeated three-word windows, fails the base; the other rules look only at texts that pass it.

Repeated windows are found by sorting the window hashes of a text, so a text of n words
costs n log n at any length. Windows are told apart by 64-bit hashes.

Nulls: a null text has no words and fails the base. Each row is judged alone, so ties and
repeated rows get equal verdicts. Other columns play no part and, in ``filter_documents``,
are returned as they came.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import SPACES, ascii_lower, whole, words

# Frequent function words of the languages at hand.
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this from at an or which "
    "der die das und in den von zu mit ist des ein eine auf im dem sich "
    "de la que el en y los se del las un por con una es "
    "le la les et des en un une que dans pour qui sur est au du il avec"
).split()
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; a bound of None is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length", "n_words", low=MIN_WORDS),
    Rule("word_length", "mean_word_chars", low=2.5, high=12.0),
    Rule("symbols", "symbol_ratio", high=0.05),
    Rule("letters", "letter_word_ratio", low=0.75),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("bullets", "bullet_line_ratio", high=0.9),
    Rule("ellipses", "ellipsis_line_ratio", high=0.3),
)


def _ratio(part: Column, of: Column) -> Column:
    return part.cast("double") / F.greatest(of, F.lit(1)).cast("double")


# Ratios in terms of the counted columns of ``measured``.
MEASURES = {
    "n_words": lambda: F.col("n_words"),
    "mean_word_chars": lambda: _ratio(F.col("word_chars"), F.col("n_words")),
    "symbol_ratio": lambda: _ratio(F.col("n_symbols"), F.col("word_chars")),
    "letter_word_ratio": lambda: _ratio(F.col("_letter_words"), F.col("n_words")),
    "stop_word_ratio": lambda: _ratio(F.col("_stop_words"), F.col("n_words")),
    "dup_line_ratio": lambda: _ratio(F.col("n_dup_lines"), F.col("_n_lines")),
    "bullet_line_ratio": lambda: _ratio(F.col("_bullets"), F.col("_n_lines")),
    "ellipsis_line_ratio": lambda: _ratio(F.col("_ellipses"), F.col("_n_lines")),
}


def _long(c: Column) -> Column:
    return c.cast("long")


def measured(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` and the counts of each text.

    The counts leave through a generator. A filter on them would otherwise be moved below the
    projections and compute the arrays anew for each of their elements.
    """
    base = docs.select(*keep, whole(F.col("text")).alias("_text"))
    kept = base.columns[:-1]
    split = base.withColumns({
        "_w": words(F.col("_text")),
        "_lines": F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": _long(F.length(F.translate(F.col("_text"), " \t\n\x0b\x0c\r", ""))),
        "n_symbols": _long(F.length(F.col("_text")) - F.length(F.translate(F.col("_text"), SYMBOLS, ""))),
    })
    n = F.size("_w")
    window = lambda i: F.struct(
        F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("p"))
    counted = split.withColumns({
        "n_words": _long(n),
        "_n_lines": _long(F.size("_lines")),
        "n_dup_lines": _long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        "_bullets": _long(F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]")))),
        "_ellipses": _long(F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\r]*$")))),
        "_stop_words": _long(F.size(F.filter("_w", lambda x: ascii_lower(x).isin(*STOP_WORDS)))),
        "_letter_words": _long(F.size(F.filter("_w", lambda x: x.rlike(r"\p{L}")))),
        "_sorted": F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))),
    }).drop("_w", "_text", "_lines")
    same = lambda x, k, d: F.coalesce(F.get("_sorted", k + d)["h"] == x["h"], F.lit(False))
    repeated = counted.withColumn("_at", F.sort_array(F.transform(
        F.filter("_sorted", lambda x, k: same(x, k, -1) | same(x, k, 1)), lambda x: x["p"]))).drop("_sorted")
    reach = F.transform("_at", lambda p, k: F.least(F.coalesce(F.get("_at", k + 1) - p, F.lit(3)), F.lit(3)))
    done = repeated.withColumn("n_repeat_words", F.coalesce(_long(
        F.aggregate(reach, F.lit(0).cast("long"), lambda acc, x: acc + x)), F.lit(0).cast("long"))).drop("_at")
    counts = F.struct(*[c for c in done.columns if c not in kept])
    return done.select(*kept, F.explode(F.array(counts)).alias("_c")).select(*kept, "_c.*")


def compiled(rules=RULES) -> Column:
    """All rules as one condition."""
    passed = F.lit(True)
    for rule in rules:
        value = MEASURES[rule.measure]()
        if rule.low is not None:
            passed &= value >= F.lit(rule.low)
        if rule.high is not None:
            passed &= value <= F.lit(rule.high)
    return passed


def verdict(counts: DataFrame, rules=RULES) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the first broken rule."""
    judged = verdict(measured(docs, F.col("doc_id")), rules)
    broken = F.when(F.col("base_failed"), F.lit("base"))
    for rule in rules:
        broken = broken.when(~compiled((rule,)), F.lit(rule.name))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", broken.alias("broken_rule"))


def filter_documents(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows whose text passes, with their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return verdict(measured(docs, row), rules).filter("kept").select("_row.*")


_LIST = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce("text", '') AS s FROM documents),
a AS (SELECT doc_id, r, s, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS q FROM (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM a WHERE len(w) >= 3)),
h AS (SELECT r, i FROM g JOIN (SELECT r, q FROM g GROUP BY r, q HAVING count(*) > 1) USING (r, q)),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM h) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS nl,
  len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS lw,
  len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_LIST}))) AS sw,
  len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS bl,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\r]*$'))) AS el
  FROM a LEFT JOIN c USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / word_chars <= 0.05 AND lw / n_words >= 0.75
  AND sw / n_words >= 0.02 AND n_dup_lines / greatest(nl, 1) <= 0.5 AND bl / greatest(nl, 1) <= 0.9
  AND el / greatest(nl, 1) <= 0.3 AS kept,
  CASE WHEN base_failed THEN 'base' WHEN NOT word_chars / n_words BETWEEN 2.5 AND 12 THEN 'word_length'
  WHEN n_symbols / word_chars > 0.05 THEN 'symbols' WHEN lw / n_words < 0.75 THEN 'letters'
  WHEN sw / n_words < 0.02 THEN 'stop_words' WHEN n_dup_lines / greatest(nl, 1) > 0.5 THEN 'repeated_lines'
  WHEN bl / greatest(nl, 1) > 0.9 THEN 'bullets' WHEN el / greatest(nl, 1) > 0.3 THEN 'ellipses' END AS broken_rule
FROM v
"""

"""Personal data by weak supervision.

Base spans follow fixed patterns. Further candidates, long mixed tokens that may be
credentials, are judged by labelers that vote yes, no or nothing: shapes (regex), lists of
words before the token (gazetteer) and signs around it (context). Expectation-maximisation
estimates each labeler's reliability from the votes alone; the posteriors then train a
logistic span classifier on features of the span, which decides what is added.

All of it is native: spans are found by splitting a text at its matches and summing up the
lengths of the pieces, votes and features are columns. EM and the classifier need only the
counts of each combination of votes and features, whose number is fixed by their design,
not by the data; those few rows are worked on in the driver.

Patterns are written so that a text of any length takes linear time and no deep recursion:
a match starts at the beginning of a run or where the last match ended, and repeated groups
are expressed by one character class with a look-ahead.

Nulls: a null or empty text has no spans. Each row is judged alone given the model, so ties
and repeated rows get equal spans. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import whole
from faultline.session import written

_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "A-Za-z0-9-"
# Kinds in order, with patterns that match what the contract's patterns match.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]+@[{_LABEL}]+\.(?=[{_LABEL}])[{_LABEL}.]*?"
             rf"(?=\.(?![{_LABEL}])|(?![{_LABEL}.]))",
    "ip": r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
SECRET = "secret"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TOKEN = "A-Za-z0-9+/_-"
CANDIDATE = rf"(?<![{_TOKEN}])(?=[A-Za-z+/_-]*[0-9])[{_TOKEN}]{{16,}}"
# Words that announce a credential, and words that announce something else.
ANNOUNCE = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
OTHER = r"(?i)(?:https?:|www\.|href|src=|version|commit|sha|md5|isbn|doi)"
BEFORE = 24
ROUNDS = 40
LABELERS = ("shape", "hex", "announced", "assigned", "other")
FEATURES = ("long", "mixed", "varied", "quoted", "sign", "word")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda x: F.length(_digits(x)).between(13, 19) & F.call_function("luhn_check", _digits(x)),
    "phone": lambda x: F.length(_digits(x)).between(9, 15),
}


def running_sum(lengths: Column) -> Column:
    """Inclusive prefix sums of an array, doubling the reach of each step."""
    steps = F.array(*[F.lit(1 << k) for k in range(31)])
    add = lambda acc, s: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - s), F.lit(0)))
    return F.aggregate(steps, lengths, lambda acc, s: F.when(s < F.size(acc), add(acc, s)).otherwise(acc))


def _found(df: DataFrame, text: str, into: str, pattern: str) -> DataFrame:
    """Add ``into``: array of (start, end, match) of all matches."""
    m, p, s = f"_{into}_m", f"_{into}_p", f"_{into}_s"
    out = df.withColumn(m, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    out = out.withColumn(p, F.when(F.size(m) > 0, F.split(text, pattern)))
    lengths = F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.coalesce(F.length(F.get(m, i - 1)), F.lit(0)))
    out = out.withColumn(s, running_sum(lengths))
    return out.withColumn(into, F.transform(m, lambda x, i: F.struct(
        F.get(s, i).alias("start"), (F.get(s, i) + F.length(x)).alias("end"), x.alias("match")))).drop(m, p, s)


def _valid(found: str, number: int, kind: str) -> Column:
    """The matches that hold, as base spans."""
    good = F.filter(found, lambda c: VALID[kind](c["match"]))
    return F.transform(good, lambda c: F.struct(
        F.lit(number).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _judged(c: Column, before: Column, after: Column) -> Column:
    """Votes and features of a candidate."""
    x = c["match"]
    digits, letters = F.length(_digits(x)), F.length(F.regexp_replace(x, "[^A-Za-z]", ""))
    size = F.length(x)
    hexes = x.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    announced = before.rlike(rf"{ANNOUNCE}[^A-Za-z0-9]{{0,6}}$")
    assigned = before.rlike(r"[=:]\s{0,2}[\"']?$")
    varied = F.size(F.array_distinct(F.split(x, "")))
    quoted = before.rlike("[\"']$") & after.rlike("^[\"']")
    votes = F.array(
        _vote((size >= 20) & (digits * 5 >= size) & (letters * 5 >= size), (digits == 0) | (letters == 0)),
        _vote(hexes & size.isin(32, 40, 64) & (letters > 0), ~hexes & (letters * 10 >= size * 9)),
        _vote(announced, ~before.rlike("[A-Za-z]")),
        _vote(assigned, before.rlike(r"[A-Za-z0-9,.;]\s?$")),
        _vote(F.lit(False), before.rlike(OTHER) | x.rlike("[/_-]{2}|^[0-9-]+$")))
    features = F.array(
        (size >= 32), (digits * 5 >= size) & (letters * 5 >= size), varied >= 10, quoted,
        before.rlike(r"[=:]"), before.rlike(ANNOUNCE))
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), votes.alias("votes"),
                    features.cast("array<int>").alias("features"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (kind number, start, end) and candidates of every text; a scan, no shuffle."""
    rows = docs.select("doc_id", whole(F.col("text")).alias("_text"))
    for kind, pattern in PATTERNS.items():
        rows = _found(rows, "_text", f"_{kind}", pattern)
    kept = [_valid(f"_{k}", i, k) for i, k in enumerate(KINDS)]
    rows = rows.withColumn("base", F.concat(*kept)).drop(*[f"_{k}" for k in KINDS])
    rows = _found(rows, "_text", "_token", CANDIDATE)
    free = F.filter("_token", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = rows.withColumn("_token", free)
    before = lambda c: F.substring("_text", F.greatest(c["start"] - BEFORE, F.lit(0)) + 1, F.least(c["start"], F.lit(BEFORE)))
    judged = F.transform("_token", lambda c: _judged(c, before(c), F.substring("_text", c["end"] + 1, F.lit(1))))
    return rows.select("doc_id", "base", judged.alias("candidates"))


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict]]:
    """Prior and, per labeler, the chance of each vote given yes and no, by EM over vote patterns."""
    total = sum(n for _, n in counts)
    post = {v: 1 / (1 + math.exp(-2.0 * sum(v))) for v, _ in counts}
    prior, table = 0.5, []
    for _ in range(rounds):
        prior = (sum(n * post[v] for v, n in counts) + 1) / (total + 2)
        table = []
        for j in range(len(LABELERS)):
            own = {}
            for y in (0, 1):
                mass = [sum(n * (post[v] if y else 1 - post[v]) for v, n in counts if v[j] == s) + 1 for s in (-1, 0, 1)]
                own[y] = {s: m / sum(mass) for s, m in zip((-1, 0, 1), mass, strict=True)}
            table.append(own)
        post = {v: posterior(v, prior, table) for v, _ in counts}
    return prior, table


def posterior(votes: tuple[int, ...], prior: float, table: list[dict]) -> float:
    odds = math.log(prior) - math.log(1 - prior)
    odds += sum(math.log(own[1][s]) - math.log(own[0][s]) for s, own in zip(votes, table, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def trained(groups: list[tuple[tuple[int, ...], int, float]], steps: int = 400, rate: float = 1.0) -> list[float]:
    """Logistic weights, the last one constant, from feature groups (features, count, mean label)."""
    total = sum(n for _, n, _ in groups)
    weights = [0.0] * (len(FEATURES) + 1)
    for _ in range(steps):
        slope = [1e-3 * w for w in weights]
        for features, n, label in groups:
            x = (*features, 1)
            z = sum(a * b for a, b in zip(weights, x, strict=True))
            error = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label)
            slope = [s + error * b for s, b in zip(slope, x, strict=True)]
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def model(rows: DataFrame) -> list[float] | None:
    """Weights of the span classifier, None without candidates.

    The collected table has at most 3^5 * 2^6 rows at any size of the corpus.
    """
    found = rows.select(F.explode("candidates").alias("c")).groupBy("c.votes", "c.features").count().collect()
    if not found:
        return None
    patterns: dict = {}
    for r in found:
        patterns[tuple(r["votes"])] = patterns.get(tuple(r["votes"]), 0) + r["count"]
    prior, table = reliabilities(sorted(patterns.items()))
    groups: dict = {}
    for r in found:
        key = tuple(r["features"])
        n, s = groups.get(key, (0, 0.0))
        p = posterior(tuple(r["votes"]), prior, table)
        groups[key] = (n + r["count"], s + r["count"] * p)
    return trained([(k, n, s / n) for k, (n, s) in sorted(groups.items())])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans, as arrays of (kind, start, end) in code points."""
    rows = written(spans(docs), "pii-spans")
    weights = model(rows)
    kind = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform("base", lambda b: F.struct(F.get(kind, b["kind"]).alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    if weights is None:
        added = F.filter(named, lambda b: F.lit(False))
    else:
        score = lambda c: sum((F.get(c["features"], i) * w for i, w in enumerate(weights[:-1])), F.lit(weights[-1]))
        added = F.transform(F.filter("candidates", lambda c: score(c) > 0), lambda c: F.struct(
            F.lit(SECRET).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.select("doc_id", named.alias("base"), added.alias("added"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with each span replaced by its kind in brackets.

    A span that begins inside an earlier one is covered by that one's mark up to the farther end.
    """
    rows = docs.select(F.struct("doc_id", "text").alias("doc_id"), "text")
    found = detect(rows).select(
        F.col("doc_id.doc_id").alias("doc_id"), whole(F.col("doc_id.text")).alias("_text"),
        F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["end"], s["kind"]))).alias("_s"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        first = F.greatest(s["start"], acc["at"])
        before = F.substring("_text", acc["at"] + 1, first - acc["at"])
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.concat(acc["out"], before, mark).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    end = F.aggregate("_s", start, step)
    return found.withColumn("_e", end).select(
        "doc_id", F.concat("_e.out", F.substring("_text", F.col("_e.at") + 1, F.length("_text"))).alias("text"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

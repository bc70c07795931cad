"""The corpus operators against brute force, round trips and the cases their docstrings define."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import chat, decontamination, language_model, mixing, neardup, pii, quality, sharding, warc
from faultline.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, node long, _h long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    """(doc_id, text, source) rows with extra columns whose names clash with inner ones."""
    return spark.createDataFrame(
        [(i, t, "en", s, len(t) if t is not None else None, "x", 7, None) for i, t, s in rows], SCHEMA)


def prose(rng, n, words=("the", "of", "and", "river", "stone", "walks", "green", "under", "light", "house", "to", "in")):
    return " ".join(rng.choice(words) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(1)
    base = prose(rng, 120)
    rows = [
        (1, base, "a"), (2, base, "b"), (3, base.replace("river", "lake", 1), None), (4, None, "a"), (5, "", "a"), (None, base, "c"),
        (6, "one", "a"), (6, "one", "a"), (7, " \t\n ", None), (8, prose(rng, 30_000), "a"), (9, "X" * 50_000, "b"),
        (None, None, None), (10, "Mail a.b@c.example.org, call +1 (017) 555-7713, 10.0.0.255 ü", "c"),
    ]
    rows += [(20 + k, prose(rng, 60 + k), rng.choice("abc")) for k in range(25)]
    return rows, docs_of(spark, rows)


# --- sharding ----------------------------------------------------------------

def test_shards_are_gapless_and_even(spark, odd):
    rows, docs = odd
    out = sharding.shard(docs, 4).collect()
    assert len(out) == len(rows)
    by = Counter(r["shard"] for r in out)
    assert max(by.values()) - min(by.values()) <= 1
    for s, n in by.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    again = sharding.shard(docs.repartition(5), 4).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


@pytest.mark.parametrize("rows", [1, 2, 3, 16, 97, 10_007])
def test_positions_are_a_permutation(spark, rows):
    numbers = spark.range(rows).withColumnRenamed("id", "number")
    got = [r["position"] for r in sharding.position(numbers, rows).collect()]
    assert sorted(got) == list(range(rows))
    if rows > 90:
        assert got != sorted(got)


def test_many_identical_rows_get_their_own_slots(spark):
    docs = docs_of(spark, [(1, "same", "a")] * 300 + [(2, "other", "a")])
    out = sharding.shard(docs, 3).collect()
    assert len({(r["shard"], r["slot"]) for r in out}) == 301


def test_shards_hold_whole_rows(spark, odd, tmp_path):
    rows, docs = odd
    sharding.write_shards(docs, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t) for i, t, _ in rows)


def test_shards_keep_rows_that_differ_in_other_columns(spark, tmp_path):
    rows = [(1, "same", "en", "a", 1, "x", 7, None), (1, "same", "de", "b", 2, "x", 7, 5)] + [(1, "same", "en", "a", 1, "x", 7, None)] * 3 + [
        (None, None, None, None, None, None, None, None), (None, "", "fr", "c", 0, "y", 1, 2)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("slot", F.lit("mine"))
    sharding.write_shards(docs, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    assert Counter(tuple(r) for r in back.select(*names).collect()) == Counter(rows)
    assert {(r["shard"], r["slot"]) for r in back.collect()} == {(r["shard"], r["slot"]) for r in sharding.shard(docs, 3).collect()}


def test_many_copies_are_dealt_out_in_steps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES_AT_ONCE", 7)
    docs = docs_of(spark, [(1, "same", "a")] * 300 + [(2, "other", "a")] * 5)
    out = sharding.shard(docs, 4).collect()
    assert len(out) == len({(r["shard"], r["slot"]) for r in out}) == 305


# --- quality -----------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_quality_counts_match_brute_force(spark, odd):
    rows, docs = odd
    rows = rows + [(50, "a b c a b c d\n\nx y\nx y\n#$%", "a"), (51, "a a a a a a", "a"), (52, "é è ü\x0bz\x0cq\r\nq", "a")]
    out = quality.judge(docs_of(spark, rows)).collect()
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = Counter((r["doc_id"], *(r[k] for k in keys)) for r in out)
    assert got == Counter((i, *brute_counts(t)) for i, t, _ in rows)
    for r in out:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"]) and r["kept"] == (r["broken_rule"] is None)


def test_quality_filter_keeps_rows_whole(spark, odd):
    rows, docs = odd
    kept = quality.filter_documents(docs)
    assert kept.schema == docs.schema
    want = Counter(r["doc_id"] for r in quality.judge(docs).filter("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == want and want


# --- decontamination ---------------------------------------------------------

def bench_words(text):
    return BENCH_WORD.findall((text or "").translate(ASCII))


def brute_hits(text, items):
    w = bench_words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = bench_words(t)
        n = min(len(iw), 10)
        if not n:
            continue
        wins = {tuple(iw[k:k + n]) for k in range(len(iw) - n + 1)}
        for k in range(len(w) - n + 1):
            if tuple(w[k:k + n]) in wins:
                hit.update(range(k, k + n))
                found.add(item)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize("block", [200_000, 40])
def test_hits_match_brute_force(spark, block):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(6)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, line(rng.choice([0, 3, 8, 10, 12, 30]))) for k in range(12)] + [(90, None), (91, "W1 rare Ü-x"), (None, line(11)), (92, items0 := line(25)), (93, items0)]
    texts = [line(rng.randrange(0, 80)) for _ in range(30)] + [f"x {t} y" for _, t in items if t] + [None, "", "w1 RARE ü x!"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, [(k, t, "a") for k, t in enumerate(texts)])
    for r in decontamination.find(docs, bench, block_words=block).collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(texts[r["doc_id"]], items), r


def test_long_items_are_cut_without_losing_windows():
    rng = random.Random(4)
    words = [f"w{rng.randrange(50)}".encode() for _ in range(400)]
    whole = decontamination.Automaton([("i", words)], 10)
    pieces = decontamination.Automaton([("i", words[k:k + 59]) for k in range(0, 391, 50)], 10)
    for _ in range(50):
        at = rng.randrange(380)
        text = [b"x", *words[at:at + rng.randrange(5, 40)], b"y"]
        assert decontamination.merged(whole.walk(text)[0]) == decontamination.merged(pieces.walk(text)[0])


def test_clean_documents_cut_passages_and_drop_copies(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    clean = " ".join(f"c{k}" for k in range(60))
    docs = docs_of(spark, [(1, clean, "a"), (2, f"{clean}, {passage.upper()}. End", "a"), (3, passage, "a"), (4, None, "a"), (5, "", "b")])
    out = decontamination.clean_documents(docs, bench)
    assert out.schema == docs.schema
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: clean, 2: f"{clean}, . End", 4: None, 5: ""}
    assert decontamination.find(docs, bench.limit(0)).filter("n_hit > 0").isEmpty()


# --- chat --------------------------------------------------------------------

def test_conversations_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", None, "", "a\\b\\\\ <|im_end|>\n<|im_start|>", "<<SYS>>x<</SYS>>", "\\n <\\s>", "é🎈"]
    rows = [(c, t, role, texts[(c + t) % 7]) for c in range(6) for t, role in enumerate(["system", "user", "assistant", None, "assistant"])]
    rows += [(None, 0, "user", "x"), (9, 0, "assistant", "same"), (9, 0, "assistant", "same"), (9, None, "user", "first")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.conversations(chat.turns_as_tree(turns)).select(
        "tree", chat.read_back(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert len(out) == 8
    for r in out:
        own = sorted((x for x in rows if x[0] == r["tree"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["learned"] == "".join(x[3] or "" for x in own if x[2] == "assistant")


def test_best_branches_of_reply_trees(spark):
    rng = random.Random(5)
    rows, parents = [], {}
    for tree in range(4):
        for n in range(1, 30):
            parents[tree, n] = rng.randrange(1, n) if n > 1 else None
            rows.append((tree, n, parents[tree, n], "user", f"m{n}", rng.choice([0.0, 1.0, 2.0])))
    rows += [(7, 1, 2, "user", "cycle", 0.0), (7, 2, 1, "user", "cycle", 0.0), (8, 5, 99, "user", "orphan", None)]
    score = {(r[0], r[1]): r[5] or 0.0 for r in rows}
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got: dict = {}
    for r in chat.paths(messages, 2).collect():
        got.setdefault((r["tree"], r["rank"]), {})[r["position"]] = r["node"]
    for tree in range(4):
        paths = []
        for leaf in set(range(1, 30)) - {parents[tree, n] for n in range(1, 30)}:
            path, n = [], leaf
            while n is not None:
                path.insert(0, n)
                n = parents[tree, n]
            paths.append((-sum(score[tree, n] for n in path) / len(path), leaf, path))
        for rank, (_, _, path) in enumerate(sorted(paths)[:2], 1):
            assert [got[tree, rank][k] for k in range(len(path))] == path
    assert not any(t == 7 for t, _ in got) and got[8, 1] == {0: 5}


# --- language model ----------------------------------------------------------

def test_scores_of_the_counts_are_exact(spark, odd):
    rows, docs = odd
    out = language_model.score_split(docs).collect()
    toks = lambda t: [*WORD.findall((t or "").translate(ASCII)), ""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t, _ in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, _ in rows:
        ws = toks(t)
        want.append((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out]
    assert sorted(got) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)


def test_network_learns_and_carries_its_state():
    rng = random.Random(6)
    docs = [np.array([rng.choice([1, 5])] * rng.randrange(5, 60) + [0]) for _ in range(200)]
    net = language_model.Network(70).begin([1] * 70, 1, 1)
    before = sum(language_model.score_pool(net, docs))
    trainer = language_model._Trainer(net)
    for _ in range(20):
        language_model.train_pool(trainer, docs)
    after = sum(language_model.score_pool(net, docs))
    assert after > 0.5 * before
    # Windows and neighbours in a lane don't change a document's score.
    alone = [language_model.score_pool(net, [d])[0] for d in docs[:20]]
    assert np.allclose(alone, language_model.score_pool(net, docs)[:20], rtol=1e-3, atol=1e-3)


def test_network_is_a_distribution():
    net = language_model.Network(70).begin(list(range(70, 0, -1)), 3, 9)
    states = np.random.default_rng(1).standard_normal((language_model.HIDDEN, 4)).astype(np.float32)
    net.classes += 0.1
    p = [np.exp(language_model.log_probabilities(net, states, np.full(4, w))) for w in range(72)]
    assert np.allclose(sum(p), 1, atol=1e-4)


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    net = language_model.Network(70).begin([1] * 70, 1, 1)
    x, y = rng.integers(0, 72, (8, 3)), rng.integers(0, 72, (8, 3))
    real, fresh, state = np.ones((8, 3), np.float32), np.zeros((8, 3), np.float32), np.zeros((language_model.HIDDEN, 3), np.float32)
    net.output += rng.standard_normal(net.output.shape).astype(np.float32) * 0.3
    net.classes += rng.standard_normal(net.classes.shape).astype(np.float32) * 0.3

    def loss(own):
        s, _, _ = language_model._forward(own, x, fresh, state)
        return -language_model.log_probabilities(own, s.transpose(1, 0, 2).reshape(language_model.HIDDEN, -1), y.ravel()).mean()

    copy = language_model.Network(70).load(net.flat())
    copy.table, copy.hidden = copy.table.astype(np.float64), copy.hidden.astype(np.float64)
    eps = 1e-3
    for name, at in (("hidden", (3, 20)), ("hidden", (5, 40)), ("table", (int(x[2, 1]), 7)), ("table", (int(x[4, 0]), 35))):
        value = getattr(copy, name)
        value[at] += eps
        up = loss(copy)
        value[at] -= 2 * eps
        slope = (up - loss(copy)) / (2 * eps)
        value[at] += eps
        trained = language_model.Network(70).load(net.flat())
        language_model._Trainer(trained).step(x, y, real, fresh, state)
        moved = getattr(trained, name)[at] - getattr(net, name)[at]
        assert abs(slope) < 2e-4 or np.sign(moved) == -np.sign(slope), (name, at, slope, moved)


# --- personal data -----------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_match_brute_force(spark, odd):
    rng = random.Random(7)
    signs = "a1.@-+% (09)\n4é🎈"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 90))) for _ in range(400)]
    texts += ["a@b.c..d@e.f", "a@b.c%d@e.f a@b.c.", "1.2.3.4.5.6.7.8 001.002.3.255 1.2.3.256", "4111 1111-1111 1111 4111111111111112",
              "+1 (017) 555-7713+1 22 333 4444", "a" * 30_000, "1" * 30_000, "a@b" + ".c" * 20_000, "1-" * 20_000, "+1" * 9_000, None, ""]
    docs = docs_of(spark, [(k, t, "a") for k, t in enumerate(texts)])
    for r in pii.detect(docs).select("doc_id", pii.joined(F.col("base")).alias("s")).collect():
        assert r["s"] == brute_spans(texts[r["doc_id"]]), texts[r["doc_id"]][:200]


def test_credentials_are_found_and_words_left(spark):
    rng = random.Random(8)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'walk the dog token = "{key()}" and go' for _ in range(40)] + [f"part number {rng.randrange(10**17, 10**18)} of it" for _ in range(40)]
    docs = docs_of(spark, [(k, t, "a") for k, t in enumerate(texts)])
    for r in pii.detect(docs).collect():
        assert len(r["added"]) == (1 if r["doc_id"] < 40 else 0), texts[r["doc_id"]]
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs_of(spark, [(0, texts[0], "a"), (1, "to a@b.example or 1.2.3.4!", "a"), (2, None, "a")] + [
        (k, t, "a") for k, t in enumerate(texts[3:40], 3)])).collect()}
    assert red[0] == 'walk the dog token = "[secret]" and go' and red[1] == "to [email] or [ip]!" and red[2] == ""


# --- mixing ------------------------------------------------------------------

def test_mix_meets_targets(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randrange(1, 40)), rng.choice(["a", "b", "c", "d", None, "z"] + ["hot"] * 4)) for k in range(600)]
    rows += [(None, None, None), (7, "", "a"), (5, "x y", "empty")]
    out = mixing.mix(docs_of(spark, rows)).collect()
    again = mixing.mix(docs_of(spark, rows).repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    target = mixing.quotas(dict(size))
    source = {i: s for i, _, s in rows[:600]}
    taken = Counter()
    for r in out:
        assert r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None and r["doc_id"] in source and r["doc_id"] not in (5, 7):
            s = source[r["doc_id"]]
            taken[s] += r["taken"]
            assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 90 for s in taken)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6


def test_overlapping_sources_are_routed_with_least_repetition():
    p = lambda *s: json.dumps(list(s))
    taken = mixing.route({p("a"): 10.0, p("a", "b"): 10.0, p("b"): 4.0}, {"a": 16.0, "b": 10.0})
    # 26 words from 24: everything once, two words twice.
    assert abs(sum(taken.values()) - 26) < 1e-6
    assert all(taken[k] >= n - 1e-6 for k, n in ((p("a"), 10), (p("a", "b"), 10), (p("b"), 4)))


def test_mixed_documents_repeat_rows(spark, odd):
    rows, docs = odd
    out = mixing.mixed_documents(docs)
    times = {str((r["doc_id"], r["size"])): r["times"] for r in mixing.mix(docs).collect()}
    assert out.schema == docs.schema and times
    for (i, t), n in Counter((r["doc_id"], r["text"]) for r in out.collect()).items():
        copies = sum(1 for a, b, _ in rows if (a, b) == (i, t))
        assert n <= 2 * copies


# --- archives ----------------------------------------------------------------

def test_archives_come_back(spark, tmp_path):
    big = "".join(random.Random(10).choice("abé\r\n") for _ in range(5_000))
    nested = "WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (0, "u", "other"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", big),
            (7, "u", nested), (7, "u", nested), (8, "u", big + "!"), (8, "u", big + "!"), (None, "u", "same"), (None, "u", "lone")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    for chunk in (64, 1 << 20):
        token = warc.write_archives(pages, str(tmp_path / f"w{chunk}"), chunk)
        got = Counter(tuple(r) for r in warc.digests(spark, str(tmp_path / f"w{chunk}"), token).select(
            "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
        want = Counter()
        for i, _, h in rows:
            raw = (h or "").encode()
            first = min((a for a, _, b in rows if (b or "") == (h or "") and a is not None), default=None)
            again = first is not None and first != i
            want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None)] += 1
        assert got == want


# --- near duplicates ---------------------------------------------------------

def brute_components(rows, size):
    sets = []
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(ASCII))
        s = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        sets.append((i, s))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 80 * len(s | t):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, len(s), least.get(root(k)) if i is not None else None) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_brute_force(spark, odd, size):
    rng = random.Random(11)
    rows = list(odd[0])
    for g in range(3):
        base = prose(rng, 150).split()
        for k in range(40):
            w = list(base)
            for _ in range(rng.randrange(0, 14 if size == 2 else 6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
            rows.append((1000 + 100 * g + k, " ".join(w), "a"))
    out = neardup.near_duplicates(docs_of(spark, rows), size).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(rows, size)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_one_document_of_each_group_stays(spark, odd):
    rows, docs = odd
    out = neardup.distinct_documents(docs)
    assert out.schema == docs.schema
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == 0 and ids[6] == 1 and ids[None] == 2 and ids[4] == ids[5] == 1


def test_star_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 101), (5, 5), (101, 100), (200, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys([*range(31), 200], 0) | {100: 100, 101: 100}


# --- all ---------------------------------------------------------------------

def test_empty_tables(spark):
    docs = docs_of(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    frames = [sharding.shard(docs), quality.judge(docs), quality.filter_documents(docs), decontamination.find(docs, bench),
              decontamination.clean_documents(docs, bench), pii.detect(docs), mixing.mix(docs), mixing.mixed_documents(docs),
              language_model.score_split(docs), neardup.near_duplicates(docs), neardup.distinct_documents(docs),
              chat.conversations(chat.turns_as_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))]
    assert all(f.count() == 0 for f in frames)


def test_empty_archive(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    token = warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.digests(spark, str(tmp_path / "w"), token).count() == 0

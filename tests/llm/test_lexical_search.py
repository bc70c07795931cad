"""Ranked search against a brute-force ranking, over many small shards and blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from faultline.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, shard long, item long, score string, term string"


def terms(text):
    return TERM.findall((text or "").translate(ASCII))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        best = []
        for i, c, size in held:
            m = 25 + (75 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in terms(text) if c[t])
            if score > 0:
                best.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(best)[:k])]
    return Counter(out)


def ranked(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 7, 7, "x", "y") for i, t in rows], SCHEMA).repartition(parts)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    common, rare = ["the", "of", "and", "in"], [f"w{k}" for k in range(300)]
    # Frequent words are drawn often, so that lists run over many blocks and the bounds prune.
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare[: 1 + int(300 * rng.random() ** 3)]) for _ in range(n))
    docs = [(k, text(rng.randrange(1, 60))) for k in range(900)]
    docs += [(1000 + k, docs[5][1]) for k in range(300)]  # a large group of copies: equal scores
    docs += [(7, docs[7][1]), (None, text(30)), (None, None), (2000, None), (2001, ""), (2002, " .,\n"), (2003, text(20_000)),
             (2004, "Überfluß ÜBERFLUSS the THE naïve\x00w1")]
    items = [(f"i{k}", text(rng.randrange(1, 40))) for k in range(25)]
    items += [("copy", docs[5][1]), ("copy", docs[5][1]), ("none", None), ("blank", "  "), (None, "w1 w1 the"), ("unknown", "zzz"), ("ü", "überfluß naïve")]
    return docs, items


def test_matches_brute_force(spark, corpus):
    docs, items = corpus
    want = brute(docs, items)
    for shard_terms, block, block_terms, window in ((2_000_000, 128, 200_000, 4096), (3000, 4, 40, 16), (1, 128, 200_000, 64)):
        index = lexical_search.build_index(frame(spark, docs), shard_terms, block)
        assert ranked(lexical_search.search(index, items_of(spark, items), 10, block_terms, window)) == want


def test_other_k_and_id_types(spark, corpus):
    docs, items = corpus
    named = [(None if i is None else f"d{i}", t) for i, t in docs]
    df = spark.createDataFrame(named, "doc_id string, text string")
    got = ranked(lexical_search.search(lexical_search.build_index(df, 5000), items_of(spark, items), 3))
    assert got == brute(named, items, 3)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    index = lexical_search.build_index(frame(spark, []))
    assert ranked(lexical_search.search(index, items_of(spark, items))) == Counter()
    assert ranked(lexical_search.search(lexical_search.build_index(frame(spark, docs)), items_of(spark, []))) == Counter()


def test_bounds_spare_blocks(corpus):
    """Blocks of non-essential lists that no candidate needs stay packed."""
    lengths = np.full(4000, 10)
    damps = 25 + lengths

    def a_list(docs, tf):
        values = np.stack([np.diff(docs, prepend=0), tf], axis=1)
        values[::8, 0] = docs[::8]
        data, starts = lexical_search.pack(values.ravel())
        heads = np.arange(0, len(docs), 8)
        tops = np.maximum.reduceat(tf, heads)
        return lexical_search._List(docs[np.append(heads[1:], len(docs)) - 1], starts[2 * heads], np.arange(len(heads)), tops, np.full(len(heads), 10), data,
                                    lambda n: 25 + n)

    everywhere, rare = a_list(np.arange(4000), np.ones(4000, int)), a_list(np.array([17, 30]), np.array([9, 9]))
    got = {}
    bar = lambda: sorted(got.values(), reverse=True)[1] if len(got) >= 2 else 1
    lexical_search._score([(everywhere, 10), (rare, 5000)], 4000, damps, bar, lambda d, s: got.update(zip(d.tolist(), s.tolist(), strict=True)), 512)
    assert sorted(got, key=got.get)[-2:] == [17, 30]
    assert len(everywhere.blocks) <= 512 // 8 + 2 < len(everywhere.last)


@pytest.mark.parametrize("values", [[], [0], [1, 127, 128, 300, 2**40, 0], list(range(1000))])
def test_packing_round_trips(values):
    data, starts = lexical_search.pack(np.array(values, np.int64))
    assert lexical_search.unpack(data).tolist() == values and starts[-1] == len(data)

"""Vocabulary, rounds and copies follow the training tokens."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from faultline.llm import language_model as lm


def test_vocabulary_and_rounds_follow_tokens():
    assert lm.vocabulary_words(1_000) == 2_000 and lm.vocabulary_words(10 ** 8) == 10_000 and lm.vocabulary_words(10 ** 13) == lm.FREQUENT
    assert lm.LANES * lm.WINDOW <= 4_096
    small, large = lm.rounds(10 ** 6), lm.rounds(10 ** 9)
    assert len(small) == 4 and [n for _, _, n in small] == [1, 1, 1, 1] and len(large) == 10
    for tokens in (1, 10 ** 6, 10 ** 9):
        plan = lm.rounds(tokens)
        assert plan[0][0] == 0 and all(a[1] == b[0] for a, b in zip(plan, plan[1:], strict=False))
    assert max(10 ** 9 * (h - a) / large[-1][1] / n for a, h, n in large) < 2 * lm.COPY_TOKENS


def test_ids_beyond_sixteen_bits_are_kept():
    docs = [np.array([70_000, 1, 0])]
    y, _, _, place = lm.lanes(docs)
    assert y[:3, place[0][0]].tolist() == [70_000, 1, 0]


def test_copies_are_dealt_by_tokens_not_by_files(spark, monkeypatch):
    sizes = []
    mean = lm._mean
    monkeypatch.setattr(lm, "_mean", lambda copies: sizes.append(copies.filter("block = 0").count()) or mean(copies))
    docs = spark.createDataFrame([(k, f"a{k % 7} b{k % 5} c") for k in range(400)], "doc_id long, text string").repartition(40)
    lm.fit(docs)
    assert sizes == [1, 1, 1, 1]


def test_rows_left_alone_decay_as_if_they_were_stepped(monkeypatch):
    rng = np.random.default_rng(5)
    docs = [np.append(rng.integers(1 + 60 * (k % 5), 61 + 60 * (k % 5), 40), 0) for k in range(30)]
    nets = [lm.Network(300).begin([1] * 300, 1, 1) for _ in range(2)]
    monkeypatch.setattr(lm, "LANES", 2)
    lm.train_pool(lm._Trainer(nets[0]), docs)
    move = lm._Trainer._move

    def dense(self, name, g, rate, rows=None):
        whole = np.zeros_like(getattr(self.net, name))
        whole[slice(None) if rows is None else rows] = g
        move(self, name, whole, rate)

    monkeypatch.setattr(lm._Trainer, "_move", dense)
    lm.train_pool(lm._Trainer(nets[1]), docs)
    assert not np.allclose(nets[0].flat(), lm.Network(300).begin([1] * 300, 1, 1).flat(), atol=1e-2)
    assert np.allclose(nets[0].flat(), nets[1].flat(), rtol=1e-3, atol=1e-3)


def test_ids_take_the_bytes_they_need():
    assert lm._id_type(2_000).itemsize == 2 and lm._id_type(lm.FREQUENT).itemsize == 4
    assert lm._ids(np.array([0, 4, 5, -1], np.int32), 5).tolist() == [1, 5, 6, 6, 0]


def test_classes_by_counts_cost_fewer_exponentials():
    counts = [max(1, 1_000_000 // (k + 1)) for k in range(10_000)]
    bounds = lm.class_bounds(counts, 2 * sum(counts))
    sizes, share = np.diff(bounds), np.array(counts) / (2 * sum(counts))
    assert bounds[0] == 0 and bounds[-1] == 10_000 and sizes.min() > 0
    evenly = 10_000 / lm.class_words(10_000) + share.sum() * lm.class_words(10_000)
    assert len(sizes) + float((share * np.repeat(sizes, sizes)).sum()) < 0.75 * evenly
    assert lm.class_bounds([], 0).tolist() == [0] and lm.class_bounds([1], 1).tolist() == [0, 1]


def test_uneven_classes_are_a_distribution_with_and_without_a_shift():
    rng = np.random.default_rng(3)
    net = lm.Network(70, np.array([0, 1, 4, 30, 70])).begin(list(range(70, 0, -1)), 3, 9)
    net.classes += rng.standard_normal(net.classes.shape).astype(np.float32)
    net.output += rng.standard_normal(net.output.shape).astype(np.float32)
    states = rng.uniform(-1, 1, (lm.HIDDEN, 5)).astype(np.float32)
    for far in (0, 200, -200):
        net.output[:, -1] += far
        net.classes[-1] += far
        p = [np.exp(lm.log_probabilities(net, states, np.full(5, w))) for w in range(72)]
        net.output[:, -1] -= far
        net.classes[-1] -= far
        assert np.allclose(sum(p), 1, atol=1e-4)


def test_gradients_of_uneven_classes_match_differences():
    rng = np.random.default_rng(4)
    for targets in (rng.integers(0, 72, 40), np.array([1, 3, 3, 0, 71]), np.array([0, 71])):
        net = lm.Network(70, np.array([0, 1, 4, 30, 70])).begin(list(range(70, 0, -1)), 3, 9)
        net.output += rng.standard_normal(net.output.shape).astype(np.float32)
        states = rng.uniform(-1, 1, (len(targets), lm.HIDDEN)).astype(np.float32)

        def loss(of=net, at=states, to=targets):
            return -lm.log_probabilities(of, at.T, to).mean()

        d_classes, d_output, rows, d_states = lm._Outputs(net, states, np.arange(len(targets)), targets).gradients()
        whole = np.zeros_like(net.output)
        whole[rows] = d_output
        for value, slopes in ((net.classes, d_classes), (net.output, whole), (states, d_states)):
            for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(12)]:
                old = value[at]
                value[at] = old + 0.01
                up = loss()
                value[at] = old - 0.01
                assert abs((up - loss()) / 0.02 - slopes[at]) < 2e-3
                value[at] = old


def test_row_sums():
    values = np.random.default_rng(5).standard_normal((500, 3))
    cuts = np.array([0, 1, 2, 4, *range(10, 100, 2), 130, 400])
    assert np.allclose(lm._row_sums(values, cuts), np.add.reduceat(values, cuts, axis=0))


def _words(text):
    fold = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))
    return (text or b"").translate(fold).split()


def test_words_of_odd_texts(monkeypatch):
    rng = random.Random(6)
    signs = [bytes([b]) for b in b" \t\n\x0b\x0c\r\x1c\x1d\x00aAzZ[@`{\xff\x85\xa0"] + ["é".encode(), " ".encode()]
    texts = [None, b"", b" \n", b"\xff X \x85", *(b"".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(300))]
    want = [_words(t) for t in texts]
    for held in (pa.array(texts, pa.binary()), pa.array(texts, pa.large_binary()), pa.array([b"x", *texts], pa.binary()).slice(1)):
        words, begins = lm.split_tokens(held)
        words = words.to_pylist()
        assert [words[a:b] for a, b in itertools.pairwise(begins)] == want
    monkeypatch.setattr(lm, "COUNTED_TOKENS", 70)
    monkeypatch.setattr(lm, "PIECE_ROWS", 7)
    got = Counter()
    for rows in lm._count(pa.record_batch([pa.array(texts[k:k + 50], pa.binary())], names=["text"]) for k in range(0, len(texts), 50)):
        got.update(dict(zip(*(c.to_pylist() for c in rows.columns), strict=True)))
    assert +got == Counter([w for ws in want for w in ws] + [lm.END] * len(texts))

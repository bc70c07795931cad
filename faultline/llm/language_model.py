"""Scoring documents with a gated recurrent language model.

Counts: every training token is counted; they give the base score and the vocabulary. The
most frequent words are predicted by the network: ``VOCABULARY`` or the root of the training
tokens, whichever is more, of the ``FREQUENT`` at most. All other words and the end mark go
through the counts.

Model: a gated recurrent unit reads a token's row of an input table and its own state. The
output is factored: a softmax over classes, then one over the words of the class. Words
outside the vocabulary are one class, within which a word has its smoothed share of the
counts, so the model is a distribution over all texts. Classes hold words of near ranks; their
number and bounds follow the counts, so that frequent words are in small classes.
Output biases begin at the counts.

Training: numpy, truncated backpropagation. Documents run one after another through lanes;
the state is carried from window to window and cleared where a document begins, gradients stop
at the window's edge. It goes in rounds, each of twice the documents of the one before; their
number grows with the logarithm of the training tokens, from ``ROUNDS`` on. In each round the
texts are dealt out to copies by tokens, about ``COPY_TOKENS`` each whatever the files, and the
copies are averaged by the tokens they saw, ``FAN_IN`` at a time. So each training document is
learned from once, at any size of the corpus. A copy makes at least some hundred updates a round
when the round has the tokens; work and traffic grow with the corpus.

Scoring: the same lanes, with state carried over the whole of each document; windows are longer, as
no update waits for them.

Words beyond the ``FREQUENT`` most frequent need their counts for the base score. Their
occurrences are the only ones that are shuffled, per document and word, to meet their
counts; the frequent words are scored where they stand, by a broadcast of fixed size.

Nulls: a null or blank text is the end mark alone. A row without an id counts as the empty
id. Ties in count go to the smaller word. Repeated rows are scored each. Without training
rows the counts are empty and the model stays at its beginning. Other columns play no part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import written

VOCABULARY = 2_000
CLASS_WORDS = 64
HIDDEN = 16
LANES = 256
WINDOW = 16
SCORED_TOKENS = 8_192
ROW_LEVELS = 24
POOL_TOKENS = 2_500_000
COPY_TOKENS = 1_000_000
COUNTED_TOKENS = 4_000_000
PIECE_ROWS = 1_000
RATE = 0.02
ROUNDS = 4
FREQUENT = 100_000
SMOOTH = 0.1
FAN_IN = 64
SEED = 20_240_504
# Stands for the end mark among counted words; no word is empty.
END = b""


def split_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, lower case for A-Z, side by side, and where each text's words begin, and end at last."""
    large = pa.types.is_large_binary(texts.type)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(b"").view(pa.large_string() if large else pa.string())))
    words, begins = lists.flatten().cast(pa.large_binary() if large else pa.binary()), np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=begins[1:])
    # Blanks at the ends of a text leave empty words there.
    full = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return (words if kept[-1] == len(words) else words.filter(full)), kept[begins]


def class_words(words: int) -> int:
    """Words of a class without counts: the root of the vocabulary, as then both softmaxes are of one size, or the least."""
    return max(CLASS_WORDS, math.isqrt(words))


def class_bounds(counts: list[int], tokens: int) -> np.ndarray:
    """First word of each class, and the number of words, for which the two softmaxes are the least work.

    A token costs all classes and, if its word is counted, the words of its class. So classes are of equal sums of the
    roots of their words' shares of all tokens, and there are as many as that sum over all words.
    """
    roots = np.cumsum(np.sqrt(np.asarray(counts, np.float64) / max(tokens, 1)))
    if not len(roots):
        return np.zeros(1, np.int64)
    n = max(1, round(float(roots[-1])))
    first = np.searchsorted(roots, roots[-1] * np.arange(n) / n, side="right")
    return np.append(np.unique(first), len(roots))


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10


# --- network -----------------------------------------------------------------

class Network:
    """Parameters of the recurrent unit and the factored output.

    Ids: 0 is the end mark and the state before a text, 1 .. words are vocabulary, words + 1 is
    any other word. The end mark and other words are classes without a softmax of their own. The words of
    a class are neighbours: ``bounds`` has the first word of each class, and at last the number of words.
    """

    NAMES = ("table", "hidden", "bias", "classes", "output")

    def __init__(self, words: int, bounds: np.ndarray | None = None, seed: int = SEED):
        rng, f, h = np.random.default_rng(seed), np.float32, HIDDEN
        self.words = words
        self.bounds = np.append(np.arange(0, words, class_words(words)), words) if bounds is None else np.asarray(bounds)
        self.sizes = np.diff(self.bounds)
        self.n_classes = len(self.sizes) + 2
        # 0: end mark, 1: other words, from 2 on the vocabulary by rank.
        self.class_of = np.concatenate(([0], np.repeat(np.arange(2, self.n_classes), self.sizes), [1])).astype(
            np.min_scalar_type(self.n_classes))
        self.table = (rng.standard_normal((words + 2, 3 * h)) * 0.1).astype(f)
        self.hidden = (rng.standard_normal((h, 3 * h)) / math.sqrt(h)).astype(f)
        self.bias = np.zeros(3 * h, f)
        # The last unit of both outputs is the bias.
        self.classes = np.zeros((h + 1, self.n_classes), f)
        self.output = np.zeros((words, h + 1), f)

    def begin(self, counts: list[int], ends: int, others: int) -> Network:
        """Output biases that predict every word by its count."""
        log = np.log(np.asarray([ends, others, *counts], np.float64) + SMOOTH)
        self.output[:, -1] = log[2:]
        self.classes[-1, :2] = log[:2]
        if self.words:
            self.classes[-1, 2:] = np.log(np.add.reduceat(np.exp(log[2:]), self.bounds[:-1]))
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, values: np.ndarray) -> Network:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, values[at:at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self


def _forward(net: Network, x: np.ndarray, fresh: np.ndarray, state: np.ndarray):
    """States after each step of a window, the last of them, and what backpropagation needs of the steps.

    x: ids (steps, lanes), fresh: 1 where a document begins. A state is (units, lanes), so that gates are whole rows.
    """
    h, steps = HIDDEN, len(x)
    drive = np.empty((steps, 3 * h, x.shape[1]), np.float32)
    np.add(net.table.take(x.ravel(), axis=0).reshape(*x.shape, 3 * h).transpose(0, 2, 1), net.bias[:, None], out=drive)
    stay, turned = 1 - fresh, net.hidden.T.copy()
    # A logistic gate is a hyperbolic tangent of half its drive.
    drive[:, :2 * h] *= 0.5
    turned[:2 * h] *= 0.5
    states, before, new = (np.empty((steps, h, x.shape[1]), np.float32) for _ in range(3))
    mixed, gates = np.empty_like(drive), drive[:, :2 * h]
    for t in range(steps):
        was, now, gate = before[t], new[t], gates[t]
        np.multiply(state, stay[t], out=was)
        np.matmul(turned, was, out=mixed[t])
        gate += mixed[t, :2 * h]
        np.tanh(gate, out=gate)
        gate *= 0.5
        gate += 0.5
        np.multiply(gate[:h], mixed[t, 2 * h:], out=now)
        now += drive[t, 2 * h:]
        np.tanh(now, out=now)
        state = np.subtract(was, now, out=states[t])
        state *= gate[h:]
        state += now
    return states, state, (before, mixed[:, 2 * h:], gates[:, :h], gates[:, h:], new, stay)


class _Outputs:
    """Both softmaxes over the states in the given rows and their targets, ordered by class.

    The targets of a class and its words are a block, and all blocks lie in one array, so that a class costs one product
    and everything else is done at once.
    """

    # Sums of exponentials between these need no shift by the greatest.
    LEAST, MOST = 1e-20, 1e30

    def __init__(self, net: Network, states: np.ndarray, at: np.ndarray, targets: np.ndarray):
        kinds, n = net.class_of[targets], len(targets)
        self.net, self.shape, self.order = net, states.shape, np.argsort(kinds, kind="stable")
        self.rows = at[self.order]
        self.kinds = kinds[self.order]
        self.first = first = int(np.searchsorted(self.kinds, 2))
        self.seen = np.ones((n, HIDDEN + 1), np.float32)
        self.seen[:, :-1] = states.take(self.rows, axis=0)
        inner = self.kinds[first:]
        begins = np.flatnonzero(np.diff(inner, prepend=0))
        self.touched = inner[begins].astype(np.int64) - 2
        targeted = np.diff(begins, append=len(inner))
        # Where a target's words begin in the array of all blocks, and where its own word is.
        length = np.repeat(net.sizes[self.touched], targeted)
        ends = np.cumsum(length)
        self.starts = ends - length
        self.places = self.starts + targets[self.order[first:]] - 1 - np.repeat(net.bounds[self.touched], targeted)
        self.inside = np.empty(int(ends[-1]) if len(ends) else 0, np.float32)
        self.blocks = []
        for k, a, b in zip(self.touched.tolist(), begins.tolist(), (begins + targeted).tolist(), strict=True):
            low, high = int(net.bounds[k]), int(net.bounds[k + 1])
            at = int(self.starts[a])
            self.blocks.append((a, b, low, high, self.inside[at:at + (b - a) * (high - low)].reshape(b - a, -1)))
        if not self._fill(shift=False):
            self._fill(shift=True)

    def _fill(self, shift: bool) -> bool:
        """Exponentials, their sums and the targets' logarithms; whether the sums are in reach."""
        net, inner = self.net, self.seen[self.first:]
        self.across = self.seen @ net.classes
        for a, b, low, high, block in self.blocks:
            np.dot(inner[a:b], net.output[low:high].T, out=block)
            if shift:
                block -= block.max(axis=1, keepdims=True)
        if shift:
            self.across -= self.across.max(axis=1, keepdims=True)
        self.log_class, self.log_word = self.across[np.arange(len(self.kinds)), self.kinds], self.inside[self.places]
        with np.errstate(over="ignore"):
            np.exp(self.across, out=self.across)
            np.exp(self.inside, out=self.inside)
            self.sum_class = self.across @ np.ones(net.n_classes, np.float32)
            self.sum_word = np.add.reduceat(self.inside, self.starts) if len(inner) else self.inside
        near = all(self.LEAST < v.min(initial=1) and v.max(initial=1) < self.MOST for v in (self.sum_class, self.sum_word))
        if near or shift:
            self.log_class -= np.log(self.sum_class)
            self.log_word -= np.log(self.sum_word)
        return near

    def log_probabilities(self) -> np.ndarray:
        own = self.log_class.astype(np.float64)
        own[self.first:] += self.log_word
        out = np.empty_like(own)
        out[self.order] = own
        return out

    def gradients(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the class output, of the touched classes' words, those words, and of all states; per target."""
        net, n = self.net, max(len(self.order), 1)
        # Sums and the number of targets are divided out where there are fewest columns.
        self.across[np.arange(len(self.order)), self.kinds] -= self.sum_class
        self.inside[self.places] -= self.sum_word
        scale = (1 / (self.sum_class * n))[:, None]
        d_classes = (self.across.T @ (self.seen * scale)).T
        back = self.across @ net.classes[:-1].T
        back *= scale
        scale = (1 / (self.sum_word * n))[:, None]
        seen, down = self.seen[self.first:] * scale, np.empty((len(scale), HIDDEN), np.float32)
        sizes = net.sizes[self.touched]
        if 2 * sizes.sum() >= net.words:
            # A row without a target has a gradient of zero, which only lets its second moments decay.
            rows, words, starts = np.arange(net.words), np.zeros_like(net.output), net.bounds[self.touched]
        else:
            starts = np.cumsum(sizes) - sizes
            rows = np.repeat(net.bounds[self.touched] - starts, sizes) + np.arange(sizes.sum())
            words = np.empty((len(rows), HIDDEN + 1), np.float32)
        for (a, b, low, high, error), at in zip(self.blocks, starts.tolist(), strict=True):
            np.dot(error.T, seen[a:b], out=words[at:at + high - low])
            np.dot(error, net.output[low:high, :-1], out=down[a:b])
        down *= scale
        back[self.first:] += down
        d_states = np.zeros(self.shape, np.float32)
        d_states[self.rows] = back
        return d_classes, words, rows, d_states


def log_probabilities(net: Network, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of class times word for each state (a column) and target; other words: of the class alone."""
    return _Outputs(net, states.T, np.arange(len(targets)), targets).log_probabilities()


def _row_sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the rows from each cut to the next; most are short, a few long."""
    many, level = np.diff(cuts, append=len(values)), 1
    out, left = values.take(cuts, axis=0), np.flatnonzero(many > 1)
    while len(left) > ROW_LEVELS:
        out[left] += values.take(cuts[left] + level, axis=0)
        level += 1
        left = left[many[left] > level]
    for k in left.tolist():
        out[k] += values[cuts[k] + level:cuts[k] + many[k]].sum(axis=0)
    return out


class _Trainer:
    """Truncated backpropagation with per-parameter step sizes.

    A window touches the table rows of its words and the outputs of their classes only; the second moments of all other
    rows are left to decay until the row is met again, which gives the same numbers.
    """

    DECAY = 0.999

    def __init__(self, net: Network):
        self.net, self.seen = net, 0
        self.square = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
        self.met = {n: np.zeros(len(getattr(net, n)), np.int64) for n in ("table", "output")}

    def _move(self, name: str, g: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
        value, square, at, decay = getattr(self.net, name), self.square[name], slice(None), self.DECAY
        some = rows is not None and len(rows) < len(value)
        if rows is not None:
            at = rows if some else at
            idle = self.seen - self.met[name][at]
            self.met[name][at] = self.seen
            if idle.max(initial=0) > 1:
                decay = np.exp(idle.astype(np.float32) * np.float32(math.log(decay))).reshape(-1, *[1] * (g.ndim - 1))
        s = square.take(at, axis=0) if some else square
        s *= decay
        move = g * g
        s += move
        if some:
            square[at] = s
        # Moments are kept without the factor 1 - DECAY; it and the rate are in the two numbers here.
        np.sqrt(s, out=move)
        move *= math.sqrt((1 - self.DECAY) / (1 - self.DECAY ** self.seen)) / rate
        move += 1e-6 / rate
        np.divide(g, move, out=move)
        if some:
            value[at] = np.subtract(value.take(at, axis=0), move, out=move)
        else:
            value -= move

    def step(self, x, y, real, fresh, state, share: float = 1.0):
        """One window: x, y ids, real: 1 where a lane has a token. The state to carry on.

        ``share`` scales the step, so that the ends of a few long documents weigh no more than their tokens.
        """
        net, h = self.net, HIDDEN
        states, last, (before, inner, r, u, new, stay) = _forward(net, x, fresh, state)
        at = np.flatnonzero(real.ravel())
        flat = states.transpose(0, 2, 1).reshape(-1, h)
        d_classes, d_output, touched, d_states = _Outputs(net, flat, at, y.ravel()[at]).gradients()
        d_states = d_states.reshape(*x.shape, h).transpose(0, 2, 1).copy()
        by_new, by_reset, by_update = new * new, 1 - r, 1 - u
        np.subtract(1, by_new, out=by_new)
        by_new *= by_update
        by_reset *= r
        by_reset *= inner
        by_update *= u
        by_update *= before - new
        d_inner, d_new = np.empty((len(x), 3 * h, x.shape[1]), np.float32), np.empty_like(new)
        carry, through = np.zeros((h, x.shape[1]), np.float32), np.empty((h, x.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1):
            carry += d_states[t]
            np.multiply(carry, by_new[t], out=d_new[t])
            np.multiply(d_new[t], by_reset[t], out=d_inner[t, :h])
            np.multiply(carry, by_update[t], out=d_inner[t, h:2 * h])
            np.multiply(d_new[t], r[t], out=d_inner[t, 2 * h:])
            carry *= u[t]
            carry += np.matmul(net.hidden, d_inner[t], out=through)
            carry *= stay[t]
        d_hidden = np.matmul(before, d_inner.transpose(0, 2, 1)).sum(axis=0)
        d_inner[:, 2 * h:] = d_new
        d_drive = d_inner.transpose(0, 2, 1).reshape(-1, 3 * h)
        ids = x.ravel().astype(np.min_scalar_type(net.words + 1))
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1))
        d_table = _row_sums(d_drive.take(order, axis=0), cuts)
        self.seen += 1
        rate = RATE * share
        self._move("table", d_table, rate, ids[cuts].astype(np.int64))
        self._move("output", d_output, rate, touched)
        for name, g in (("hidden", d_hidden), ("bias", d_table.sum(axis=0)), ("classes", d_classes)):
            self._move(name, g, rate)
        return last


def lanes(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Lay documents, each ending in 0, end to end in lanes of near equal length.

    Returns ids (steps, lanes), mask of real tokens, marks of beginnings, and the lane and
    first step of each document. The longest documents are laid first.
    """
    width = max(1, min(LANES, len(docs)))
    length = np.zeros(width, np.int64)
    place: list[tuple[int, int]] = [(0, 0)] * len(docs)
    for k in sorted(range(len(docs)), key=lambda k: -len(docs[k])):
        lane = int(length.argmin())
        place[k] = (lane, int(length[lane]))
        length[lane] += len(docs[k])
    # Longer lanes first, so that the lanes still running are always the first ones.
    order = np.argsort(-length, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(width)
    steps = -(-int(length.max(initial=0)) // WINDOW) * WINDOW
    y, real, fresh = np.zeros((steps, width), np.int32), np.zeros((steps, width), bool), np.zeros((steps, width), bool)
    place = [(int(rank[lane]), at) for lane, at in place]
    for d, (lane, at) in zip(docs, place, strict=True):
        y[at:at + len(d), lane] = d
        real[at:at + len(d), lane] = True
        fresh[at, lane] = True
    return y, real, fresh, place


def _windows(y, real, fresh, tokens: int = 0):
    """Windows of inputs and targets over the lanes still running, longer where fewer lanes have so many tokens.

    The input is the token before, the end mark at a beginning.
    """
    last, t = np.zeros(y.shape[1], np.int64), 0
    while t < len(y):
        width = int(real[t].sum())
        at = slice(t, t + max(WINDOW, tokens // max(width, 1)))
        own = y[at, :width].astype(np.int64)
        x = np.where(fresh[at, :width], 0, np.concatenate((last[None, :width], own[:-1])))
        last = own[-1]
        yield at, width, x, own, real[at, :width], fresh[at, :width].astype(np.float32)
        t = at.stop


def train_pool(trainer: _Trainer, docs: list[np.ndarray]) -> None:
    y, real, fresh, _ = lanes(docs)
    state = np.zeros((HIDDEN, y.shape[1]), np.float32)
    for _, width, x, t, r, f in _windows(y, real, fresh):
        state = trainer.step(x, t, r, f, state[:, :width], float(r.sum()) / (WINDOW * y.shape[1]))


def score_pool(net: Network, docs: list[np.ndarray]) -> list[float]:
    """Natural log-likelihood of each document, other words by their class alone."""
    y, real, fresh, place = lanes(docs)
    state, out = np.zeros((HIDDEN, y.shape[1]), np.float32), np.zeros(y.shape, np.float32)
    for at, width, x, t, r, f in _windows(y, real, fresh, SCORED_TOKENS):
        states, state, _ = _forward(net, x, f, state[:, :width])
        own = np.zeros(t.shape, np.float32)
        own[r] = _Outputs(net, states.transpose(0, 2, 1).reshape(-1, HIDDEN), np.flatnonzero(r), t[r]).log_probabilities()
        out[at, :width] = own
    return [float(out[at:at + len(d), lane].sum(dtype=np.float64)) for d, (lane, at) in zip(docs, place, strict=True)]


# --- tasks -------------------------------------------------------------------

def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, as their words are held several times over. What they took is given back at last."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(at, PIECE_ROWS)
    pa.default_memory_pool().release_unused()


def _count(batches):
    """Token counts of training texts, handed on whenever so many tokens are held."""
    pool: list[pa.Array] = []
    held = ends = 0

    def rows():
        found = pa.chunked_array(pool, pa.binary()).value_counts()
        words, times = ([found.field(k), pa.array([v], t)] for k, v, t in ((0, END, pa.binary()), (1, ends, pa.int64())))
        return pa.record_batch([pa.concat_arrays(words), pa.concat_arrays(times)], names=["word", "c"])

    for batch in _pieces(batches):
        words, begins = split_tokens(batch.column("text"))
        for at in range(0, max(len(words), 1), COUNTED_TOKENS):
            pool.append(words.slice(at, COUNTED_TOKENS).cast(pa.binary()))
            held += len(pool[-1])
            ends += len(begins) - 1 if not at else 0
            if held >= COUNTED_TOKENS:
                yield rows()
                pool, held, ends = [], 0, 0
    if ends or held:
        yield rows()


def _ranks(words: pa.Array, listed: list[bytes]) -> np.ndarray:
    """Places of words in a list, -1 for any other."""
    return pc.index_in(words, value_set=pa.array(listed, words.type)).fill_null(-1).to_numpy()


def _ids(ranks: np.ndarray, words: int) -> np.ndarray:
    """Ids of a text's words under a vocabulary of so many words, and the end mark."""
    out = np.zeros(len(ranks) + 1, np.int32)
    out[:-1] = np.where((ranks >= 0) & (ranks < words), ranks + 1, words + 1)
    return out


def _encode(vocabulary):
    """Texts as vocabulary ids, in the fewest bytes that hold them."""

    def run(batches):
        listed = vocabulary.value
        kind = _id_type(len(listed))
        for batch in _pieces(batches):
            words, begins = split_tokens(batch.column("text"))
            ranks = _ranks(words, listed)
            coded = [_ids(ranks[a:b], len(listed)).astype(kind).tobytes() for a, b in itertools.pairwise(begins)]
            yield pa.record_batch([batch.column("share"), pa.array(coded, pa.binary())], names=["share", "ids"])

    return run


def _id_type(words: int) -> np.dtype:
    return np.dtype(np.uint16 if words + 1 < 2 ** 16 else np.uint32)


BLOCK = 4096


def _train(words, bounds, start):
    """Train a copy on the texts of a partition; its parameters, and its tokens, in blocks."""

    def run(batches):
        net = Network(words, bounds).load(start.value)
        trainer, n, kind = _Trainer(net), 0, _id_type(words)
        coded = (np.frombuffer(t.as_py(), kind) for b in batches for t in b.column("ids"))
        for pool in _cut(coded):
            train_pool(trainer, pool)
            n += sum(map(len, pool))
        if n:
            yield _blocks(net.flat(), n)

    return run


def _blocks(values: np.ndarray, n: int) -> pa.RecordBatch:
    cut = [values[k:k + BLOCK].astype(np.float32).tobytes() for k in range(0, len(values), BLOCK)]
    return pa.record_batch([pa.array(range(len(cut)), pa.int32()), pa.array([n] * len(cut), pa.int64()),
                            pa.array(cut, pa.binary())], names=["block", "n", "value"])


def _averaged(batches):
    """Average of the copies of a partition, weighted by tokens, block by block."""
    total: dict[int, list] = {}
    for batch in batches:
        for block, n, value in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "value")), strict=True):
            now = total.setdefault(block, [0, 0.0])
            now[0] += n
            now[1] = now[1] + np.frombuffer(value, np.float32).astype(np.float64) * n
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()),
                           pa.array([(v / n).astype(np.float32).tobytes() for n, v in total.values()], pa.binary())],
                          names=["block", "n", "value"])


_COPY = "block int, n long, value binary"


def _rare(words: pa.Array, ranks: np.ndarray, begins: np.ndarray, ends: bool) -> tuple[pa.Array, pa.Array]:
    """Words without a rank, and end marks if they have no count, of each text, and how often it has them."""
    at, n = np.flatnonzero(ranks < 0), len(begins) - 1
    coded = words.take(pa.array(at)).dictionary_encode()
    listed, text = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())]), np.searchsorted(begins, at, "right") - 1
    keys = text * len(listed) + coded.indices.to_numpy()
    if ends:
        keys = np.append(keys, np.arange(1, n + 1) * len(listed) - 1)
    keys, times = np.unique(keys, return_counts=True)
    cuts = pa.array(np.searchsorted(keys, np.arange(n + 1) * len(listed)), pa.int32())
    return (pa.ListArray.from_arrays(cuts, listed.take(pa.array(keys % len(listed)))),
            pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())))


def _score(frequent, logs, words, bounds, values):
    """The network's share of each score, the frequent words' part of both, and the rare words.

    ``frequent``: words by falling count, the first ``words`` of them the vocabulary; ``logs``: log10 of their counts
    + 0.1, and last of all that of the end mark.
    """

    def run(batches):
        log, kind = logs.value, _id_type(words)
        net = Network(words, bounds).load(values.value)
        for batch in batches:
            out = {n: [] for n in ("n_tokens", "n_known", "n_other", "base", "inner", "net")}
            coded: list[np.ndarray] = []
            rare = []
            for piece in _pieces([batch]):
                found, begins = split_tokens(piece.column("text"))
                ranks = _ranks(found, frequent.value)
                rare.append(_rare(found, ranks, begins, math.isnan(log[-1])))
                for a, b in itertools.pairwise(begins):
                    at = ranks[a:b]
                    known = at[at >= 0]
                    outside = known[known >= words]
                    n_known, base = len(known), 0.0
                    if not math.isnan(log[-1]):
                        n_known, base = n_known + 1, float(log[-1])
                    coded.append(_ids(at, words).astype(kind))
                    own = (len(at) + 1, n_known, len(at) - len(known) + len(outside), base + float(log[known].sum()),
                           float(log[outside].sum()))
                    for column, v in zip(out.values(), own, strict=False):
                        column.append(v)
            for pool in _cut(coded):
                out["net"] += score_pool(net, pool)
            if not rare:
                continue
            rare = [pa.concat_arrays(v) for v in zip(*rare, strict=True)]
            sums = [pa.array(v, k) for v, k in zip(out.values(), (pa.int64(),) * 3 + (pa.float64(),) * 3, strict=True)]
            yield pa.record_batch([batch.column("row"), batch.column("doc_id"), *sums[:-1], *rare, sums[-1]],
                                  names=["row", "doc_id", *list(out)[:-1], "words", "times", "net"])

    return run


def _cut(docs: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    pool, n = [], 0
    for d in docs:
        pool.append(d)
        n += len(d)
        if n >= POOL_TOKENS:
            yield pool
            pool, n = [], 0
    if pool:
        yield pool


# --- jobs --------------------------------------------------------------------

def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))


def _mean(copies: DataFrame) -> np.ndarray | None:
    """Average of trained copies, weighted by tokens, summed up ``FAN_IN`` partitions at a time."""
    left = copies.filter("block = 0").count()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        copies = written(copies.repartition(left).mapInArrow(_averaged, _COPY), "lm-copies")
    rows = copies.coalesce(1).mapInArrow(_averaged, _COPY).orderBy("block").collect()
    if not rows:
        return None
    return np.concatenate([np.frombuffer(r["value"], np.float32) for r in rows])


class Model:
    """A fitted model: counts, vocabulary and network."""

    def __init__(self, counts: DataFrame, total: int, distinct: int, frequent: list[bytes], logs: np.ndarray, words: int,
                 bounds: np.ndarray, rest: tuple[int, int], values: np.ndarray):
        self.counts, self.total, self.distinct, self.frequent = counts, total, distinct, frequent
        self.logs, self.words, self.bounds, self.rest, self.values = logs, words, bounds, rest, values


@contextmanager
def one_thread(spark: SparkSession):
    """Workers of the functions made here run their matrix products on one thread.

    The products are small: a second thread only waits, and that at full load.
    """
    settings = spark.sparkContext.environment
    name = "OPENBLAS_NUM_THREADS"
    old = settings.get(name)
    settings[name] = "1"
    try:
        yield
    finally:
        settings.pop(name)
        if old is not None:
            settings[name] = old


def vocabulary_words(tokens: int) -> int:
    """Words that the network predicts after so many training tokens."""
    return min(FREQUENT, max(VOCABULARY, math.isqrt(tokens)))


def rounds(tokens: int) -> list[tuple[int, int, int]]:
    """First share, the share after the last, and the number of copies of each training round."""
    n = max(ROUNDS, math.ceil(math.log2(max(tokens, 1) / COPY_TOKENS)) if tokens > COPY_TOKENS else 0)
    total = 2 ** n - 1
    return [(2 ** k - 1, 2 ** (k + 1) - 1, max(1, round(tokens * 2 ** k / total / COPY_TOKENS))) for k in range(n)]


def fit(train: DataFrame) -> Model:
    """Count all training texts and train the network on them."""
    spark, texts = train.sparkSession, _texts(train)
    pools = texts.select("text").mapInArrow(_count, "word binary, c long")
    counts = written(pools.groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.col("c").desc(), "word").limit(FREQUENT).collect()
    by_word = {bytes(r["word"]): r["c"] for r in top}
    ends = by_word.pop(END, None)
    if ends is None and distinct:
        ends = counts.filter(F.octet_length("word") == 0).first()["c"]
    frequent = list(by_word)
    vocabulary = frequent[:vocabulary_words(total)]
    words, own = len(vocabulary), [by_word[w] for w in vocabulary]
    logs = np.log10(np.asarray([*by_word.values(), math.nan if ends is None else ends], np.float64) + SMOOTH)
    ends = ends or 0
    rest = (total - sum(own) - ends, distinct - words - (distinct > 0))
    plan = rounds(total)
    share = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(plan[-1][1])).alias("share")
    send = spark.sparkContext.broadcast
    coded = written(texts.select(share, "text").mapInArrow(_encode(send(vocabulary)), "share long, ids binary"), "lm-ids")
    bounds = class_bounds(own, total)
    values = Network(words, bounds).begin(own, ends, rest[0]).flat()
    with one_thread(spark):
        for low, high, n in plan:
            part = coded.filter((F.col("share") >= low) & (F.col("share") < high)).select("ids").repartition(n)
            trained = _mean(written(part.mapInArrow(_train(words, bounds, send(values)), _COPY), "lm-copies"))
            values = values if trained is None else trained
    return Model(counts, total, distinct, frequent, logs, words, bounds, rest, values)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every row."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = (f"row long, doc_id {kind}, n_tokens long, n_known long, n_other long, base double, inner double, "
              "words array<binary>, times array<long>, net double")
    with one_thread(spark):
        scored = rows.mapInArrow(_score(send(model.frequent), send(model.logs), model.words, model.bounds, send(model.values)), schema)
    rows = written(scored, "lm-scores")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "row", F.col("w.words").alias("word"), F.col("w.times").alias("n"))
    c = F.coalesce("c", F.lit(0))
    met = rare.join(model.counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(c + SMOOTH)).alias("_rare"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("_met"))
    part = F.coalesce("_rare", F.lit(0.0))
    floor = math.log10(model.total + SMOOTH * (model.distinct + 1))
    other = math.log10(model.rest[0] + SMOOTH * (model.rest[1] + 1))
    # An end mark without a count is rare, but the network's alone.
    unseen = F.when(F.lit(model.distinct == 0), F.lit(math.log10(SMOOTH))).otherwise(0.0)
    return rows.join(met, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("_met", F.lit(0))).alias("n_known"),
        (F.col("base") + part - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("net") * math.log10(math.e) + F.col("inner") + part - unseen - F.col("n_other") * other).alias("score"))


def score_split(docs: DataFrame) -> DataFrame:
    """Fit on the rows whose id's checksum leaves a remainder, score all; adds held_out and train_tokens."""
    rows = docs.select("doc_id", "text")
    model = fit(rows.filter(remainder(F.col("doc_id")) != 0))
    return score(rows, model).select(
        "doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")

"""Alignment of two tokenizers' tokens over the same bytes, counted over a corpus.

Each text, with a space before it, is encoded by both vocabularies. Byte offsets where a token of
either side ends cut the tokens into groups; the tokens of one group are linked, each of A with
each of B. A pair of ids counts the documents that hold it linked.

Most groups are one token on each side with the same bytes. The identity map, an array from A's
id to B's id of the same bytes, is made once per vocabulary pair. Such groups need no pair: they
are counted in one vector over A's vocabulary per task, and only vectors are summed. Pairs of all
other groups are counted in the task, then by pair in a shuffle.

A second pass gives every document the counts of its links. The identity pairs' counts and each A
id's highest count are two vectors, bounded by the vocabulary. Of the other pairs the
``HOT_PAIRS`` most frequent are a bounded array as well, so a pair that a third of all documents
hold is no key of the join; the rest are joined by pair and summed by row.

Scale: texts are encoded once; what is kept of a document are its counts, its digest and its
distinct pairs with their frequency, written to the shared folder. The driver holds vectors over
the vocabulary and ``HOT_PAIRS`` pairs, whatever the corpus. A task's pair counts are handed on
when ``PAIRS_AT_ONCE`` are gathered.

Nulls: a text that is null or empty, or whose tokens' joined bytes differ from the space and the
text on either side, has no tokens: zeros and an empty digest. A null ``doc_id`` is a document like
any other. Repeated rows and ids are documents of their own. Ties for an A id's highest count are
all highest. Empty tables give no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from faultline.session import written

TOKENIZERS = "/opt/tokenizers"
BYTE_VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"
PIECE_VOCABULARY = f"{TOKENIZERS}/piece_bpe_32k.model"
HOT_PAIRS = 65_536
PAIRS_AT_ONCE = 500_000
TEXTS_AT_ONCE = 64
# The byte-level pattern that goes with the byte vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The fast encoder's pattern engine cannot go back over runs of blanks without bound.
_LONG_BLANK = re.compile(r"\s{1000}")
# Such a run holds this many of every hundredth characters in a row, which tells most texts at a glance.
_BLANK_STEP, _BLANKS = 100, re.compile(r"\s{9}")


def _array(ids: list[int]) -> np.ndarray:
    return np.fromiter(ids, np.int64, len(ids))


def _long_blank(text: str) -> bool:
    return _BLANKS.search(text[::_BLANK_STEP]) is not None and _LONG_BLANK.search(text) is not None


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteSide:
    """Tokens of a byte-level vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        letters = _byte_letters()
        vocab = told["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in told["added_tokens"])])
        self.bytes: list[bytes] = [b""] * size
        for token, number in vocab.items():
            self.bytes[number] = bytes(letters[c] for c in token)
        # The same ids come faster where merges are numbered in their order, as ranks are.
        joined = [m if isinstance(m, str) else " ".join(m) for m in told["model"]["merges"]]
        in_order = [vocab.get(m.replace(" ", "", 1)) for m in joined] == list(range(256, 256 + len(joined)))
        plain = told["normalizer"] is None and told["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.fast = None
        if in_order and plain and len(vocab) == 256 + len(joined):
            import tiktoken

            ranks = {self.bytes[n]: n for n in vocab.values()}
            self.fast = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """The ids of the text after a space."""
        return self.ids(text).tolist()

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not _long_blank(text):
            return _array(self.fast.encode_ordinary(" " + text))
        return _array(self.slow.encode(" " + text, add_special_tokens=False).ids)


class PieceSide:
    """Tokens of a piece model with bytes for what it lacks; it puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for k in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(k)
            if self.model.is_byte(k):
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.bytes.append(b"" if self.model.is_control(k) or self.model.is_unknown(k) else piece.replace("▁", " ").encode())

    def ids(self, text: str) -> np.ndarray:
        return _array(self.model.encode(text))


class Spelling:
    """The bytes of a side's tokens, laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(x) for x in tokens])
        self.begin = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)

    def ends(self, ids: np.ndarray, raw: np.ndarray) -> np.ndarray | None:
        """Where each token ends, if the tokens' joined bytes are ``raw``."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ends) or ends[-1] != len(raw):
            return None
        at = np.repeat(self.begin[ids] - ends + size, size)
        at += np.arange(len(raw))
        return ends if np.array_equal(self.letters[at], raw) else None


class Aligner:
    """Both sides, the lengths of their tokens and the identity map."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteSide(a), PieceSide(b)
        self.a_spelt, self.b_spelt = (Spelling(side.bytes) for side in (self.a, self.b))
        # Of several B ids with the same bytes the least stands in the map; the others' pairs are irregular.
        of_bytes: dict[bytes, int] = {}
        for k, x in enumerate(self.b.bytes):
            if x:
                of_bytes.setdefault(x, k)
        self.identity = np.array([of_bytes.get(x, -1) if x else -1 for x in self.a.bytes])
        # Every id as it is written inside and at the end of its part of a group, filled up with zero bytes to one width.
        width = len(str(max(len(self.a.bytes), len(self.b.bytes)))) + 1
        self.told_a, self.told_b = (
            np.array([[b"%d%s" % (k, mark) for k in range(len(side.bytes))] for mark in marks], f"S{width}")
            for side, marks in ((self.a, (b",", b"|")), (self.b, (b",", b";"))))

    def align(self, text: str | None):
        """Ids of A, ids of B, and the first token of every group on both sides, each closed by its count; None without tokens."""
        if not text:
            return None
        raw = np.frombuffer(b" " + text.encode(), np.uint8)
        a, b = self.a.ids(text), self.b.ids(text)
        ends_a, ends_b = self.a_spelt.ends(a, raw), self.b_spelt.ends(b, raw)
        if ends_a is None or ends_b is None:
            return None
        # Tokens have at least one byte, so ends are distinct on each side.
        closes = np.zeros((2, len(raw) + 1), bool)
        closes[0, ends_a] = closes[1, ends_b] = True
        return a, b, np.append(0, np.flatnonzero(closes[1, ends_a]) + 1), np.append(0, np.flatnonzero(closes[0, ends_b]) + 1)

    def links(self, a, b, at_a, at_b):
        """Which groups are regular, and the linked ids of all others."""
        n_a, n_b = np.diff(at_a), np.diff(at_b)
        one = (n_a == 1) & (n_b == 1)
        one &= self.identity[a[at_a[:-1]]] == b[at_b[:-1]]
        odd = np.flatnonzero(~one)
        n_a, n_b = n_a[odd], n_b[odd]
        # Every A token of a group, repeated for each of the group's B tokens.
        tokens = np.repeat(at_a[odd] - np.cumsum(n_a) + n_a, n_a) + np.arange(n_a.sum())
        width, first = np.repeat(n_b, n_a), np.repeat(at_b[odd], n_a)
        place = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        return one, a[np.repeat(tokens, width)], b[np.repeat(first, width) + place]

    def written_out(self, a, b, at_a, at_b) -> bytes:
        """The groups as text: ids of A by commas, a bar, ids of B; groups by semicolons."""
        out = np.empty(len(a) + len(b), self.told_a.dtype)
        for told, ids, own, before in ((self.told_a, a, at_a, at_b[:-1]), (self.told_b, b, at_b, at_a[1:])):
            last = np.zeros(len(ids), np.int64)
            last[own[1:] - 1] = 1
            out[np.arange(len(ids)) + np.repeat(before, np.diff(own))] = told[last, ids]
        return out.tobytes().translate(None, b"\0")[:-1]


@lru_cache(maxsize=2)
def aligner(a: str, b: str) -> Aligner:
    """One per vocabulary pair and Python worker."""
    return Aligner(a, b)


_DOCUMENT = """row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,
  same array<int>, same_n array<long>, pairs array<long>, pairs_n array<long>"""
# A pair's key: A's id times this plus B's id.
_SHIFT = 1 << 32


def aligned(docs: DataFrame, a: str = BYTE_VOCABULARY, b: str = PIECE_VOCABULARY) -> DataFrame:
    """Per row: doc_id, token, group and link counts, the groups' digest, and its distinct pairs with their frequency.

    ``same`` holds A ids linked with their identical B token, ``pairs`` the keys of all other pairs.
    """
    spark = docs.sparkSession
    kind = spark.createDataFrame([], _DOCUMENT).schema
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *kind])
    arrow = to_arrow_schema(schema)

    def one(tool, text):
        got = tool.align(text)
        if got is None:
            return 0, 0, 0, 0, "", [], [], [], []
        ids_a, ids_b, at_a, at_b = got
        regular, x, y = tool.links(*got)
        same = ids_a[at_a[:-1][regular]]
        alike = tool.identity[x] == y
        same, same_n = np.unique(np.concatenate([same, x[alike]]), return_counts=True)
        pairs, pairs_n = np.unique(x[~alike] * _SHIFT + y[~alike], return_counts=True)
        digest = hashlib.sha256(tool.written_out(*got)).hexdigest()
        return (len(ids_a), len(ids_b), len(regular), int(regular.sum()) + len(x), digest, same, same_n, pairs, pairs_n)

    def run(batches):
        tool = aligner(a, b)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                found = [one(tool, t.as_py()) for t in part.column(2)]
                columns = [part.column(0), part.column(1), *map(list, zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, a: str = BYTE_VOCABULARY, b: str = PIECE_VOCABULARY) -> DataFrame:
    """(a, b, pair, same, n): how many rows of ``aligned`` hold each pair linked; ``same`` marks identity pairs."""

    def same(batches):
        identity = aligner(a, b).identity
        count = np.zeros(len(identity), np.int64)
        for batch in batches:
            # A row names an id once.
            np.add.at(count, batch.column(0).flatten().to_numpy(), 1)
        held = np.flatnonzero(count)
        yield told(held * _SHIFT + identity[held], count[held])

    def other(batches):
        seen: Counter = Counter()
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                seen.update(batch.column(0).slice(k, TEXTS_AT_ONCE).flatten().to_pylist())
                if len(seen) >= PAIRS_AT_ONCE:
                    yield told(list(seen.keys()), list(seen.values()))
                    seen.clear()
        yield told(list(seen.keys()), list(seen.values()))

    def told(pairs, counts):
        return pa.record_batch([pa.array(pairs, pa.int64()), pa.array(counts, pa.int64())], names=["pair", "n"])

    parts = []
    for column, count in (("same", same), ("pairs", other)):
        summed = rows.select(column).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        parts.append(summed.withColumn("same", F.lit(column == "same")))
    key = F.col("pair")
    return parts[0].unionByName(parts[1]).select(
        F.shiftright(key, 32).alias("a"), key.bitwiseAND(_SHIFT - 1).alias("b"), "pair", "same", "n")


def align(docs: DataFrame, a: str = BYTE_VOCABULARY, b: str = PIECE_VOCABULARY, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``count_sum`` adds the counts of all links, ``n_best`` counts the links whose pair is a most frequent one of its A id.
    """
    spark = docs.sparkSession
    rows = written(aligned(docs, a, b), "aligned")
    counts = written(pair_counts(rows, a, b), "pair-counts")
    size = len(aligner(a, b).identity)

    # Two vectors over the vocabulary and the hottest pairs: bounded, whatever the corpus.
    same_count, highest = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for x in counts.filter("same").select("a", "n").collect():
        same_count[x["a"]] = x["n"]
    for x in counts.groupBy("a").agg(F.max("n").alias("n")).collect():
        highest[x["a"]] = x["n"]
    others = counts.filter("NOT same")
    hot = others.orderBy(F.col("n").desc(), "pair").limit(hot_pairs).select("pair", "n").collect()
    hot = np.array(sorted((x["pair"], x["n"]) for x in hot), np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((same_count, highest, hot[:, 0].copy(), hot[:, 1].copy()))

    kind = spark.createDataFrame([], "row long, count_sum long, n_best long, rest array<long>, rest_n array<long>").schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        same_count, highest, hot, hot_n = shared.value
        hot_key, hot_n = np.append(hot, -1), np.append(hot_n, 0)
        for batch in batches:
            numbers, sums, bests, rest, rest_n = batch.column(0), [], [], [], []
            for ids, times, pairs, pairs_n in zip(*(batch.column(k) for k in range(1, 5)), strict=True):
                ids, times, pairs, pairs_n = (x.values.to_numpy() for x in (ids, times, pairs, pairs_n))
                n = same_count[ids]
                spot = np.searchsorted(hot, pairs)
                found = hot_key[spot] == pairs
                own_n, own_times = hot_n[spot][found], pairs_n[found]
                sums.append(int(n @ times + own_n @ own_times))
                best = own_n == highest[pairs[found] // _SHIFT]
                bests.append(int(times[n == highest[ids]].sum() + own_times[best].sum()))
                rest.append(pairs[~found])
                rest_n.append(pairs_n[~found])
            yield pa.RecordBatch.from_arrays(
                [numbers, *(pa.array(x, f.type) for x, f in zip((sums, bests, rest, rest_n), list(arrow)[1:], strict=True))], schema=arrow)

    known = written(rows.select("row", "same", "same_n", "pairs", "pairs_n").mapInArrow(run, kind), "counted-links")
    top = F.broadcast(spark.createDataFrame(list(enumerate(highest.tolist())), "a long, highest long"))
    cold = others.join(top, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    rest = known.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("row", "x.rest", "x.rest_n")
    found = rest.join(cold, F.col("rest") == F.col("pair")).select(
        "row", (F.col("n") * F.col("rest_n")).alias("count_sum"), F.when(F.col("best"), F.col("rest_n")).otherwise(0).alias("n_best"))
    total = known.select("row", "count_sum", "n_best").unionByName(found).groupBy("row").agg(
        F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(total, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

"""BM25 keyword search for a batch of questions, without a row per question and text.

``index`` has ``id`` and ``content``, ``queries`` has ``query_id`` and ``question``. Only words
that occur in some question are counted, so what leaves the scan is bounded by the questions'
vocabulary, not by the texts.

The counted texts are laid out in tiles: some thousand texts, each asked word with the texts
that hold it and the greatest gain it brings to any of them. Questions lie in blocks of bounded
size. Tiles meet blocks in the tasks, which keep the ``k`` best texts of each question. A word
that is frequent gains little; once a question's ``k``-th score is known, the words whose greatest
gains in a tile stay below it together are only looked up for texts that a rarer word has named,
and a tile that cannot reach it is passed over. What is shuffled at the end is at most ``k`` rows
per question and task.

Scores are whole points, a thousand millionth each, rounded per word and text. Sums of points
do not depend on their order, so texts with the same words tie exactly wherever they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from faultline.functions import tokens
from faultline.operators.windows import top_k
from faultline.session import written

# The usual Okapi parameters and the digits of a score that are shown.
K1 = 1.2
B = 0.75
SCORE_DIGITS = 6
POINTS = 1_000_000_000
# Texts and counted words of a tile, and question words of a block.
TILE_TEXTS = 4096
TILE_WORDS = 1 << 18
BLOCK_WORDS = 1 << 16
# Stands for the whole text; no word is empty.
ALL = ""


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct (query_id, term)."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens("question"))).alias("term"))


def counted_texts(index: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, dl, found) of every text; ``found`` has ``code`` and ``tf`` of the words of ``vocabulary`` (term, code).

    Every text also gets one row for the whole text, which carries its length when none of its
    words is asked for. All words of a text are in one row, so partial aggregation already yields
    the final counts and the shuffles carry one row per text and word. Whether the questions'
    vocabulary is broadcast depends on its size.
    """
    whole = vocabulary.sparkSession.range(1, numPartitions=1).select(
        F.lit(ALL).alias("term"), F.lit(-1).cast("long").alias("code"))
    words = F.coalesce(tokens("content"), F.array().cast("array<string>"))
    counted = (
        index.select("id", words.alias("_words"))
        # Outer, though no array is empty here: for the inner form Catalyst adds a
        # filter that splits every text again.
        .select("id", F.size("_words").alias("dl"),
                F.explode_outer(F.array_append("_words", F.lit(ALL))).alias("term"))
        .join(vocabulary.select("term", "code").unionByName(whole), "term")
        .groupBy("id", "dl", "code")
        .agg(F.count("*").alias("tf"))
    )
    word = F.when(F.col("code") >= 0, F.struct("code", "tf"))
    return counted.groupBy("id", "dl").agg(F.collect_list(word).alias("found"))


@dataclass(frozen=True)
class KeywordIndex:
    """The counted texts, the same in tiles, and the words of the questions with their weights."""

    texts: DataFrame   # id, codes, gains
    tiles: DataFrame
    words: DataFrame   # query_id, code, idf


def keyword_index(index: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> KeywordIndex:
    """Count the questions' words in all texts. Texts are read and split once; the counts are written."""
    terms = written(query_terms(queries), "question-words")
    vocabulary = written(
        terms.select("term").distinct().withColumn("code", F.monotonically_increasing_id()), "vocabulary")
    counted = written(counted_texts(index, vocabulary), "counted-texts")
    sizes = counted.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl")).first()
    frequency = counted.select(F.explode("found.code").alias("code")).groupBy("code").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (sizes["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.join(vocabulary, "term").join(frequency, "code").select("query_id", "code", idf.alias("idf"))

    def gain(tf: Column) -> Column:
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(sizes["avgdl"] or 1.0)))

    texts = counted.filter(F.size("found") > 0).select(
        "id", F.col("found.code").alias("codes"), F.transform("found.tf", gain).alias("gains"))
    return KeywordIndex(texts, written(_tiles(texts), "text-tiles"), written(weights, "question-weights"))


_TILE = """codes array<long>, starts array<int>, places array<int>, gains array<double>, tops array<double>"""


def _tiles(texts: DataFrame) -> DataFrame:
    """Texts (id, codes, gains) in tiles: per word, in order, its texts' places with its gains, and the greatest gain."""
    kind = texts.sparkSession.createDataFrame([], _TILE).schema
    schema = StructType([StructField("ids", ArrayType(texts.schema["id"].dataType)), *kind])
    arrow = to_arrow_schema(schema)

    def cuts(ends: np.ndarray) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(ends) - 1:
            full = int(np.searchsorted(ends, ends[at] + TILE_WORDS, side="right")) - 1
            to = max(at + 1, min(full, at + TILE_TEXTS))
            yield at, to
            at = to

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())))
            for a, z in cuts(ends):
                ids, codes, gains = (batch.column(c).slice(a, z - a) for c in range(3))
                codes, gains = codes.flatten().to_numpy(), gains.flatten().to_numpy()
                places = np.repeat(np.arange(z - a), np.diff(ends[a:z + 1]))
                order = np.argsort(codes, kind="stable")
                codes, gains = codes[order], gains[order]
                starts = np.flatnonzero(np.diff(codes, prepend=-1))
                parts = [ids.to_pylist(), codes[starts], np.append(starts, len(codes)), places[order], gains,
                         np.maximum.reduceat(gains, starts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], f.type) for p, f in zip(parts, arrow, strict=True)], schema=arrow)

    return texts.mapInArrow(pack, schema)


def _points(idf, gains):
    """Whole points of words; a word that a text holds always counts."""
    return np.maximum(np.floor(idf * gains * POINTS + 0.5), 1).astype(np.int64)


def points(idf: Column, gain: Column) -> Column:
    return F.greatest(F.floor(idf * gain * POINTS + 0.5).cast("long"), F.lit(1).cast("long"))


class Tile:
    """One row of ``_tiles`` in a task."""

    def __init__(self, ids: pa.Array, codes, starts, places, gains, tops):
        self.ids, self.codes, self.starts, self.places, self.gains, self.tops = ids, codes, starts, places, gains, tops
        order = pc.sort_indices(ids).to_numpy()
        self.by_id = np.empty(len(ids), np.int64)
        self.by_id[order] = np.arange(len(ids))
        self.sorted_ids = np.asarray(ids.take(pa.array(order)).to_pylist())
        self.probed = 0

    def scores(self, codes: np.ndarray, idf: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the texts with at least ``low`` points for the words, and their points."""
        spot = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        here = self.codes[spot] == codes
        spot, idf = spot[here], idf[here]
        reach = _points(idf, self.tops[spot])
        order = np.argsort(reach, kind="stable")
        below = np.cumsum(reach[order])
        # The words of least reach that stay below the threshold together name no text.
        split = int(np.searchsorted(below, low))
        if split == len(order):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.zeros(len(self.ids), np.int64)
        for j in order[split:]:
            a, z = self.starts[spot[j]:spot[j] + 2]
            total[self.places[a:z]] += _points(idf[j], self.gains[a:z])
            self.probed += z - a
        left = int(below[split - 1]) if split else 0
        found = np.flatnonzero(total)
        found = found[total[found] + left >= low]
        for j in order[:split][::-1]:
            a, z = self.starts[spot[j]:spot[j] + 2]
            left -= int(reach[j])
            held = self.places[a:z]
            place = np.minimum(np.searchsorted(held, found), z - a - 1)
            own = held[place] == found
            total[found[own]] += _points(idf[j], self.gains[a:z][place[own]])
            self.probed += int(own.sum())
            found = found[total[found] + left >= low]
        return found, total[found]


class Best:
    """The ``k`` best texts of one question so far, greater points first, then smaller id."""

    def __init__(self, k: int):
        self.k, self.hits = k, []

    def bar(self) -> int:
        """Points a text must have to be among the best; equal points may still win by id."""
        return self.hits[-1][0] if len(self.hits) == self.k else 1

    def add(self, tile: Tile, places: np.ndarray, scores: np.ndarray) -> None:
        some = np.lexsort((tile.by_id[places], -scores))[:self.k]
        ids = tile.ids.take(pa.array(places[some])).to_pylist()
        self.hits.extend(zip(scores[some].tolist(), ids, strict=True))
        self.hits.sort(key=lambda hit: (-hit[0], hit[1]))
        del self.hits[self.k:]


class _Question:
    """Words with weights and, if asked for, scored texts whose place among all hits is counted."""

    def __init__(self, query_id, k: int):
        self.query_id, self.best = query_id, Best(k)
        self.codes: list = []
        self.idf: list = []
        self.near: list[tuple] = []

    def ready(self):
        self.codes, self.idf = np.array(self.codes, np.int64), np.array(self.idf, np.float64)
        self.floor = min((score for _, score in self.near), default=None)
        self.ahead = [0] * len(self.near)
        return self

    def meet(self, tile: Tile) -> None:
        low = self.best.bar()
        if self.floor is not None:
            low = min(low, self.floor)
        places, scores = tile.scores(self.codes, self.idf, low)
        if not len(places):
            return
        for n, (near_id, score) in enumerate(self.near):
            upto = np.searchsorted(tile.sorted_ids, near_id, side="right")
            self.ahead[n] += int(((scores > score) | ((scores == score) & (tile.by_id[places] < upto))).sum())
        self.best.add(tile, places, scores)


def _blocks(keywords: KeywordIndex, near: DataFrame | None) -> DataFrame:
    """Questions in blocks of about ``BLOCK_WORDS`` words: (block, words, near), written."""
    words = keywords.words
    n = max(1, -(-words.count() // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("block")

    def gathered(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(block).agg(F.collect_list(F.struct(*df.columns)).alias(name))

    both = gathered(words, "words")
    if near is not None:
        both = both.join(gathered(near.select("query_id", "id", "points"), "near"), "block", "left")
    return written(both, "question-blocks")


def _meet(k: int, has_near: bool, query_type: pa.DataType, id_type: pa.DataType):
    """A function over pairs of a tile and a block that emits each task's best texts and counts."""

    def read(words, near) -> list[_Question]:
        asked: dict = {}
        for word in words:
            asked.setdefault(word["query_id"], _Question(word["query_id"], k))
            asked[word["query_id"]].codes.append(word["code"])
            asked[word["query_id"]].idf.append(word["idf"])
        for hit in near or ():
            asked[hit["query_id"]].near.append((hit["id"], hit["points"]))
        return [q.ready() for q in asked.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[_Question]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                number = row["block"].as_py()
                if number not in blocks:
                    blocks[number] = read(row["words"].as_py(), row["near"].as_py() if has_near else None)
                tile = Tile(row["ids"].values, *(row[c].values.to_numpy() for c in ("codes", "starts", "places", "gains", "tops")))
                for question in blocks[number]:
                    question.meet(tile)
        for questions in blocks.values():
            rows = [(q.query_id, i, s, None) for q in questions for s, i in q.best.hits]
            rows += [(q.query_id, i, s, n) for q in questions for (i, s), n in zip(q.near, q.ahead, strict=True) if n]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = (query_type, id_type, pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             names=["query_id", "id", "points", "ahead"])

    return run


def leaders(keywords: KeywordIndex, k: int, near: DataFrame | None = None) -> DataFrame:
    """Each task's ``k`` best texts per question: (query_id, id, points, ahead).

    ``near`` (query_id, id, points) are texts whose place among all hits is wanted. For each of
    them a task adds a row whose ``ahead`` counts the hits it has seen up to that place, the text
    itself included; in the other rows it is NULL. Nothing else leaves a task.

    The two written sides meet pair by pair: the planner sends the blocks to all tasks if their
    size allows it, and otherwise deals both sides out over tasks of their own.
    """
    words, texts = keywords.words.schema, keywords.texts.schema
    schema = StructType([words["query_id"], texts["id"], StructField("points", LongType()), StructField("ahead", LongType())])
    pairs = keywords.tiles.crossJoin(_blocks(keywords, near))
    run = _meet(k, near is not None, to_arrow_type(words["query_id"].dataType), to_arrow_type(texts["id"].dataType))
    return pairs.mapInArrow(run, schema)


def points_of(keywords: KeywordIndex, pairs: DataFrame) -> DataFrame:
    """(query_id, id, points) of the given pairs that share a word. ``pairs`` is a small written table."""
    held = keywords.texts.join(pairs.select("query_id", "id"), "id")
    word = held.select("query_id", "id", F.explode(F.arrays_zip("codes", "gains")).alias("w"))
    weighed = word.select("query_id", "id", F.col("w.codes").alias("code"), F.col("w.gains").alias("gain")).join(
        keywords.words, ["query_id", "code"])
    return weighed.groupBy("query_id", "id").agg(F.sum(points(F.col("idf"), F.col("gain"))).alias("points"))


def shown(points: Column) -> Column:
    return F.round(points / F.lit(float(POINTS)), SCORE_DIGITS)


def best_hits(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the tasks' leaders per question, with their ``rank``."""
    return top_k(found.filter(F.col("ahead").isNull()).drop("ahead"), ["query_id"], [F.col("points").desc(), F.col("id")], k)


def bm25(index: DataFrame, queries: DataFrame, k: int = 5, k1: float = K1, b: float = B) -> DataFrame:
    """The ``k`` best texts per question: (query_id, id, score, rank). Ties go to the smaller id."""
    best = best_hits(leaders(keyword_index(index, queries, k1, b), k), k)
    return best.select("query_id", "id", shown(F.col("points")).alias("score"), "rank")

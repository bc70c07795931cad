"""Near-duplicate documents: MinHash, banding, verification, star components.

Every document becomes the set of its distinct word shingles, as 64-bit hashes. ``HASHES``
universal hash functions (multiply, add, keep the high bits) give its minima; ``BANDS``
groups of ``ROWS`` minima give its buckets. Two sets of similarity 0.8 miss every common
bucket with a chance of (1 - 0.8^5)^40, about 1e-7.

Equal sets collapse to one class first, with a number of its own and one row to stand for it,
so a group of copies of any size is one row from there on. Buckets never emit all pairs. Rounds of stars
compare each member with one hub of its bucket, the hub changing from round to round, until
a round links next to nothing. What is left are buckets whose members lie in several
components. Their documents get longer signatures of ``FINE`` minima, cut to a byte each, and
are compared block by block inside tasks. Sets of up to ``SMALL`` shingles come along, cut to
four bytes each, which tells nearly all of their near pairs that are no links; the other pairs
across components that come near the threshold leave a task. So the links of all buckets are complete up to reachability, with
no pair emitted for members that already belong together. A pair is held against signatures
first and then confirmed on full sets. Of pairs at the threshold the short signatures turn away
one in 30,000 (four standard deviations); those stay open and are held against the long ones,
which turn away one in three million (five) for good.

Nulls: a null, blank or empty text has an empty set and is linked with nothing. A row
without an id is linked with nothing, its component is null and it is kept. Ids may be of any
type with an order and may repeat: rows with one id and several texts lie in the classes of
their texts. ``distinct_documents`` keeps one row of each component: that of the least id and,
under one id, of one text and one of its exact repeats. An empty table gives no rows. Other
columns play no part and are returned as they came by ``distinct_documents``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from faultline.llm.common import ascii_lower, whole, words
from faultline.llm.components import components
from faultline.session import written

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
FINE = 1_000
# Sets of at most so many shingles travel with their signature, and the shingles by which
# the cut to four bytes may let a pair seem less alike than it is.
SMALL, CUT_LOSS = 400, 2
SEED = 20_240_503
DEVIATIONS, FINE_DEVIATIONS = 4, 5
LEFT_BLOCK, RIGHT_BLOCK = 2048, 2048
# Star rounds end when less than this share of a round's pairs are links.
LEAST_YIELD = 0.01
# Numbers of at most this many classes (16 MB) are sent to the scans that look for them.
BROADCAST_IDS = 2_000_000


def with_shingles(docs: DataFrame, size: int, *keep: str) -> DataFrame:
    """``keep`` and ``set``: distinct hashes of the word shingles of ``text``."""
    w = docs.select(*keep, words(ascii_lower(whole(F.col("text")))).alias("_w"))
    n = F.size("_w")
    window = lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(size)])
    few = F.array(F.xxhash64(F.array_join("_w", " "), F.lit(size)))
    return w.select(*keep, F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(0), n - size), window)))
                    .when(n > 0, few).otherwise(F.array().cast("array<long>")).alias("set"))


def _functions(seed: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, number, dtype=np.uint64) * 2 + 1, rng.integers(0, 2**63, number, dtype=np.uint64)


def _least_agreement(number: int, percent: int, deviations: int) -> int:
    share = percent / 100
    return int(number * (share - deviations * (share * (1 - share) / number) ** 0.5))


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 256) -> np.ndarray:
    """Least hash of ``x`` under each function, high 32 bits."""
    best = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    work = np.empty((len(a), min(block, max(len(x), 1))), dtype=np.uint64)
    for at in range(0, len(x), block):
        part = x[at:at + block]
        own = work[:, :len(part)]
        np.multiply(a[:, None], part[None, :], out=own)
        own += b[:, None]
        np.minimum(best, own.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def _signed(batches):
    a, b = _functions(SEED, HASHES)
    for batch in batches:
        sets = batch.column("set")
        offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
        classes, signatures = [], []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = values[lo:hi]
            classes.append(hashlib.blake2b(np.sort(own).tobytes(), digest_size=16).digest())
            signatures.append(minima(own, a, b) if hi > lo else np.zeros(0, np.uint32))
        sizes = np.diff(offsets).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *signatures]).view(np.int32)
        ends = np.concatenate(([0], np.cumsum([len(s) for s in signatures]))).astype(np.int32)
        yield pa.record_batch([
            batch.column("doc_id"), batch.column("text_key"), pa.array(sizes), pa.array(classes, pa.binary()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=["doc_id", "text_key", "n_shingles", "class", "signature"])


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n_shingles, class (digest of the set) and signature for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_shingles(_keyed(docs), size, "doc_id", "text_key").mapInArrow(
        _signed, f"doc_id {kind}, text_key long, n_shingles long, class binary, signature array<int>")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a hash that tells the texts of one id apart."""
    return docs.select("doc_id", "text", F.xxhash64(whole(F.col("text"))).alias("text_key"))


def _finer(batches):
    """Long signatures, the low byte of each minimum, and small sets cut to four bytes a shingle."""
    a, b = _functions(SEED + 1, FINE)
    for batch in batches:
        sets = batch.column("set")
        offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
        fine = [minima(values[lo:hi], a, b).astype(np.uint8).tobytes()
                for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        own = [np.unique(values[lo:hi].astype(np.uint32)).tobytes() if hi - lo <= SMALL else None
               for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.record_batch([batch.column("node"), pa.array(fine, pa.binary()), pa.array(own, pa.binary()),
                               pa.array(np.diff(offsets).astype(np.int64))], names=["node", "fine", "own", "n"])


def _close_pairs(percent: int):
    """Near pairs across components of one left and one right block of a bucket."""
    least = _least_agreement(FINE, percent, FINE_DEVIATIONS)

    def run(group: pa.Table) -> pa.Table:
        left, right = group.filter(group.column("left")), group.filter(group.column("right"))
        signs = lambda t: np.frombuffer(b"".join(t.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
        bytes_, nodes, parts = signs(right), right.column("node").to_numpy(), right.column("part").to_numpy()
        major = right.column("major").to_numpy(zero_copy_only=False)
        sizes = right.column("n").to_numpy()
        keys = [set(k) for k in right.column("keys").to_pylist()]
        sets = [None if x is None else np.frombuffer(x, np.uint32) for x in right.column("own").to_pylist()]
        key = group.column("key")[0].as_py()
        out: tuple[list, list] = ([], [])
        for own, node, part, n, mine, small in zip(
                signs(left), *(left.column(c).to_pylist() for c in ("node", "part", "n", "keys", "own")), strict=True):
            small = None if small is None else np.frombuffer(small, np.uint32)
            # A pair that is left and right both ways counts once, and only in its first common bucket.
            # Sets whose sizes lie too far apart cannot reach the threshold.
            fit = np.flatnonzero((parts != part) & (major | (nodes > node)) & (
                np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * percent))
            for i in fit[(bytes_[fit] == own).sum(axis=1) >= least].tolist():
                if key != min(keys[i].intersection(mine)):
                    continue
                if small is not None and sets[i] is not None:
                    both = len(np.intersect1d(small, sets[i], assume_unique=True)) + CUT_LOSS
                    if 100 * both < percent * (n + int(sizes[i]) - both):
                        continue
                for column, x in zip(out, sorted((node, int(nodes[i]))), strict=True):
                    column.append(x)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def _bands() -> Column:
    return F.array(*[F.xxhash64(F.lit(i), F.slice("signature", i * ROWS + 1, ROWS)) for i in range(BANDS)])


def _ids(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.col("a").alias("_id")).unionByName(
        pairs.select(F.col("b").alias("_id"))).distinct(), "minhash-ids")


def _of(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of the given class numbers. Few numbers go to the rows, so that the rows stay where they are."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, F.col(key) == F.col("_id"), "left_semi")


def _sent(named: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of an id and numbers, sent to the documents that they name if they are few, so that texts stay where they are.

    Ids of no fixed size are sent only if the planner finds their written size small.
    """
    few = isinstance(docs.schema["doc_id"].dataType, IntegralType) and len(named.columns) * named.count() <= BROADCAST_IDS
    return F.broadcast(named) if few else named


def _spots(members: DataFrame) -> DataFrame:
    """Members of buckets with every pair of blocks ``i``, ``j`` that they stand in, and on which sides: one row per pair.

    ``_l`` and ``_r`` are a bucket's numbers of blocks. Members of its largest component, ``major``, stand right only.
    """
    block = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spot = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    minor, i, j = ~F.col("major"), F.col("_i"), F.col("_j")
    right = F.transform(every("_l"), lambda k: spot(k, j, minor & (k == i), F.lit(True)))
    left = F.transform(F.filter(every("_r"), lambda k: minor & (k != j)), lambda k: spot(i, k, F.lit(True), F.lit(False)))
    own = [c for c in members.columns if c not in ("_l", "_r")]
    return members.withColumn("_i", block("_l", 1)).withColumn("_j", block("_r", 2)).select(*own, F.inline(F.concat(right, left)))


class _Search:
    """State of one search: classes, their buckets and the links confirmed so far."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs.select("doc_id", "text"), size, percent
        self.rows = written(signed(docs, size), "minhash")
        own = self.rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
        found = own.groupBy("class").agg(
            F.min(F.struct("doc_id", "text_key")).alias("own"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"),
            F.first("signature").alias("signature"))
        # Numbers are given once, as the table is written.
        self.classes = written(found.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
        # Whether rows repeat an id and a text: a class's text is then there more than once.
        self.repeats = not own.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty()
        buckets = self.classes.select("node", F.explode(_bands()).alias("key"))
        shared = buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
        self.buckets = written(buckets.join(shared.select("key"), "key"), "minhash-buckets")
        # Pairs that were looked at, and those of them that were held on full sets.
        self.tried = None
        self.settled = None
        self.parts = None
        self.least = _least_agreement(HASHES, percent, DEVIATIONS)

    def confirm(self, pairs: DataFrame, signed: bool = False) -> float:
        """Merge the components of the pairs ``(a, b)``, ``a < b``, that hold on full sets; the share of those pairs.

        ``signed`` pairs were held against signatures before.
        """
        past = self.settled if signed else self.tried
        if past is not None:
            pairs = pairs.join(past, ["a", "b"], "left_anti")
        pairs = written(pairs, "minhash-pairs")
        near = pairs if signed else written(self._near(pairs), "minhash-near")
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        self.settled = near if self.settled is None else self.settled.unionByName(near)
        sets = self.sets(_ids(near))
        set_of = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}"))
        both = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - both
        true = near.join(set_of("a"), "a").join(set_of("b"), "b").filter(
            both * 100 >= union * self.percent).select("a", "b").distinct()
        true = written(true, "minhash-links")
        found = true.count()
        if found or self.parts is None:
            self.merge(true)
        return found / max(pairs.count(), 1)

    def sets(self, ids: DataFrame) -> DataFrame:
        """node and set of the given classes, from the texts that stand for them."""
        own = written(_of(self.classes.select("node", "own"), "node", ids).select(
            "node", F.col("own.doc_id").alias("_doc"), F.col("own.text_key").alias("_text")), "minhash-texts")
        texts = _keyed(self.docs).join(_sent(own, self.docs), (F.col("doc_id") == F.col("_doc")) & (F.col("text_key") == F.col("_text")))
        return with_shingles(texts.dropDuplicates(["node"]) if self.repeats else texts, self.size, "node")

    def _near(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose signatures come near the threshold."""
        signatures = _of(self.classes.select("node", "n", "signature"), "node", _ids(pairs))
        side = lambda c: signatures.select(
            F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("signature").alias(f"s{c}"))
        same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
        close = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent) & (same >= self.least)
        return pairs.join(side("a"), "a").join(side("b"), "b").filter(close).select("a", "b")

    def merge(self, links: DataFrame) -> None:
        """Add links to the components. After the first time, components are the nodes and stars run on new links alone."""
        if self.parts is None:
            self.parts = written(components(links), "minhash-components")
            return
        part_of = lambda c: self.parts.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        ends = written(links.join(part_of("a"), "a", "left").join(part_of("b"), "b", "left").select(
            F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a != b").distinct(), "minhash-ends")
        merged = components(ends).select(F.col("node").alias("component"), F.col("component").alias("_least"))
        # A node that was alone so far is its own component; the others move with the one they are in.
        known = self.parts.unionByName(merged.select(F.col("component").alias("node"), "component").join(
            self.parts.select("node"), "node", "left_anti"))
        self.parts = written(known.join(merged, "component", "left").select(
            "node", F.coalesce("_least", "component").alias("component")), "minhash-components")

    def placed(self) -> DataFrame:
        """Bucket members with their component, of buckets that hold several components."""
        members = self.buckets.join(self.parts, "node", "left").select(
            "key", "node", F.coalesce("component", "node").alias("part"))
        mixed = members.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi")
        return members.join(mixed.select("key"), "key")

    def left_over(self) -> DataFrame:
        """Near pairs across components in buckets of several components.

        Members outside a bucket's largest component stand left, all members right; both are
        cut into blocks, and each pair of blocks is a group of bounded size.
        """
        mixed = written(self.placed(), "minhash-mixed")
        sizes = mixed.groupBy("key", "part").count()
        plan = sizes.groupBy("key").agg(F.max(F.struct("count", "part")).alias("_most"), F.sum("count").alias("_all")).select(
            "key", F.col("_most.part").alias("_major"),
            F.ceil((F.col("_all") - F.col("_most.count")) / LEFT_BLOCK).cast("int").alias("_l"),
            F.ceil(F.col("_all") / RIGHT_BLOCK).cast("int").alias("_r"))
        nodes = mixed.groupBy("node").agg(F.collect_set("key").alias("keys"))
        sets = self.sets(written(nodes.select(F.col("node").alias("_id")), "minhash-ids"))
        fine = written(nodes.join(sets.mapInArrow(_finer, "node long, fine binary, own binary, n long"), "node"), "minhash-fine")
        # Buckets meet their plan before the signatures join, which then move once, to their blocks.
        members = mixed.join(plan, "key").select("key", "node", "part", (F.col("part") == F.col("_major")).alias("major"), "_l", "_r")
        both = _spots(members.join(fine, "node")).select(
            "key", "i", "j", "left", "right", "node", "part", "major", "keys", "n", "fine", "own")
        return both.groupBy("key", "i", "j").applyInArrow(_close_pairs(self.percent), "a long, b long")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _class_components(search: _Search) -> DataFrame:
    """node, component of all classes that are linked with another."""
    hubs = search.buckets.groupBy("key").agg(F.min("node").alias("hub"))
    search.confirm(search.buckets.join(hubs, "key").filter("node != hub").select(*_pair("node", "hub")).distinct())
    turn, share = 0, 1.0
    while share >= LEAST_YIELD:
        turn += 1
        mixed = search.placed()
        # One order for all buckets of a round: a document meets few different hubs.
        hubs = mixed.groupBy("key").agg(F.min_by(F.struct("node", "part"), F.xxhash64("node", F.lit(turn))).alias("hub"))
        share = search.confirm(mixed.join(hubs, "key").filter("part != hub.part").select(*_pair("node", "hub.node")).distinct())
    search.confirm(search.left_over(), signed=True)
    return search.parts


def _judged(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Every row's doc_id, text_key, n_shingles and class, with ``least``, the least row of its component if there are others."""
    search = _Search(docs, size, percent)
    parts = _class_components(search)
    own = search.classes.join(parts, "node", "left").select(
        "class", F.coalesce("component", "node").alias("component"), "copies", "own")
    # Only components of several rows say something new; all other rows are their own component.
    least = own.groupBy("component").agg(F.min("own").alias("least"), F.sum("copies").alias("rows")).filter("rows > 1")
    named = written(own.join(least, "component").select("class", "least"), "minhash-named")
    return search.rows.select("doc_id", "text_key", "n_shingles", "class").join(named, "class", "left").withColumn(
        "least", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("least")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and set_class for every row."""
    component = F.coalesce("least.doc_id", "doc_id")
    return _judged(docs, size, percent).select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), F.hex("class").alias("set_class"))


def distinct_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near copies, the one with the least id, with all columns."""
    spare = "_" * (1 + max(map(len, docs.columns)))  # names longer than all others are free
    key, doc, text = (spare + x for x in ("k", "d", "t"))
    rows = written(_judged(docs, size, percent).filter("least IS NOT NULL").select(
        F.col("doc_id").alias(doc), F.col("text_key").alias(text),
        F.struct("doc_id", "text_key").eqNullSafe(F.col("least")).alias("stays")), "minhash-judged")
    own = docs.withColumn(key, F.xxhash64(whole(docs["text"])))
    same = (F.col("doc_id") == F.col(doc)) & (F.col(key) == F.col(text))
    dropped = written(rows.filter("NOT stays").select(doc, text).distinct(), "minhash-dropped")
    kept = own.join(_sent(dropped, docs), same, "left_anti")
    again = written(rows.filter("stays").groupBy(doc, text).count().filter("count > 1").select(doc, text), "minhash-again")
    if again.isEmpty():
        return kept.drop(key)
    # Exact repeats of a row that stays: one of them, whichever other columns hash least.
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = _sent(again, docs)
    one = kept.join(again, same, "left_semi").groupBy("doc_id", key).agg(
        F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(spare)).select(f"{spare}.*")
    return kept.join(again, same, "left_anti").drop(key).unionByName(one)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, CASE WHEN len(w) < 2 THEN w ELSE w[i:i + 1] END AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT r, r AS s FROM d UNION SELECT c.r, e.b FROM c JOIN e ON e.a = c.s),
m AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.s GROUP BY c.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""

"""Approximate nearest neighbours by a forest of hash prefixes."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.sources.storage import materialize

#: Vectors the centre is taken from and, at most, queries the ascent is tuned on.
SAMPLE = 10_000
TUNING_QUERIES = 64


@dataclass(frozen=True)
class Forest:
    """Trees of ``bits``-bit hashes and, per tree, how many vectors lie before each hash.

    A tree is its vectors sorted by hash; ``before`` is the directory of that array, so
    the vectors that share a prefix are one run of it.
    """

    planes: np.ndarray  # trees x dimensions x bits
    centre: np.ndarray
    before: np.ndarray  # trees x (2 ** bits + 1)

    @property
    def bits(self) -> int:
        return self.planes.shape[2]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """The hash of every vector in every tree."""
        weight = 1 << np.arange(self.bits - 1, -1, -1)
        moved = vectors - self.centre
        return np.stack([((moved @ p) > 0) @ weight for p in self.planes], axis=1)

    def runs(self, codes: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one hash that share ``level`` bits with the given ones."""
        rest = self.bits - level
        low = codes >> rest << rest
        return low, low + (1 << rest)

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """Per query and level, the vectors of all trees that share so long a prefix."""
        trees = np.arange(len(self.planes))
        out = np.zeros((len(codes), self.bits + 1), np.int64)
        for level in range(self.bits + 1):
            low, high = self.runs(codes, np.int64(level))
            out[:, level] = (self.before[trees, high] - self.before[trees, low]).sum(axis=1)
        return out

    def stop_levels(self, codes: np.ndarray, wanted: int) -> np.ndarray:
        """The deepest level at which all trees together offer ``wanted`` candidates.

        The trees ascend in step: each gives up its prefixes' last bit at the same time.
        """
        enough = self.counts(codes) >= wanted
        return np.where(enough, np.arange(self.bits + 1), 0).max(axis=1)


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = np.asarray(lists.flatten()).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 1)


def _hashes(forest: Forest) -> Forest:
    return Forest(forest.planes, forest.centre, np.zeros((0, 0), np.int64))


def _classes(vectors: DataFrame, keep: int) -> DataFrame:
    """Equal vectors once: ``v``, the smallest id ``cid`` and the ``keep`` smallest ``ids``.

    Larger ids of a class can't be among the nearest of any query, as ties go to smaller ones.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = vectors.withColumn("r", rank).filter(F.col("r") <= keep)
    ids = F.array_sort(F.collect_list("id"))
    return first.groupBy("v").agg(F.min("id").alias("cid"), ids.alias("ids"))


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v``, a list of doubles, of the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    sound = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(key).alias("id"), v.alias("v")
    )
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return sound.filter(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def _build(classes: DataFrame, trees: int, bits: int, seed: int) -> Forest:
    sample = classes.orderBy(F.xxhash64("cid")).limit(SAMPLE).select("v").collect()
    centre = np.mean([r["v"] for r in sample], axis=0)
    size = len(centre)
    rng = np.random.default_rng(seed)
    planes = []
    for _ in range(trees):
        blocks = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-bits // size))]
        planes.append(np.concatenate(blocks, axis=1)[:, :bits])
    bare = Forest(np.array(planes), centre, np.zeros((0, 0), np.int64))
    shared = classes.sparkSession.sparkContext.broadcast(bare)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(trees << bits, np.int32)
        for batch in batches:
            codes = shared.value.codes(_matrix(batch.column(0)))
            total += np.bincount(
                (codes + (np.arange(trees) << bits)).ravel(), minlength=len(total)
            ).astype(np.int32)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell), pa.array(total[cell].astype(np.int64))], names=["cell", "n"]
        )

    cells = classes.select("v").mapInArrow(count, "cell long, n long")
    # At most trees * 2 ** bits rows.
    table = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(trees << bits, np.int64)
    total[np.asarray(table["cell"])] = np.asarray(table["n"])
    before = np.zeros((trees, (1 << bits) + 1), np.int64)
    before[:, 1:] = np.cumsum(total.reshape(trees, -1), axis=1)
    return Forest(bare.planes, bare.centre, before)


def _nearest(
    queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, the ``k`` nearest ids and their exact distances."""
    if not len(points):
        return
    rough = (points**2).sum(axis=1) - 2 * (queries @ points.T)
    for i, row in enumerate(rough):
        if len(row) > k:
            limit = np.partition(row, k - 1)[k - 1]
            at = np.flatnonzero(row <= limit + 1e-9 * (1 + abs(limit)))
        else:
            at = np.arange(len(row))
        far = np.sqrt(((points[at] - queries[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids[at], far))[:k]
        yield i, ids[at][order], far[order]


def exact(classes: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The ``k`` nearest classes of a few given queries by comparing them with all rows."""
    names = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64)
    shared = classes.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors = shared.value
        for batch in batches:
            points, ids = _matrix(batch.column(1)), np.asarray(batch.column(0))
            yield _found(own, vectors, points, ids, k)

    found = classes.select("cid", "v").mapInArrow(run, "qid long, cid long, score double")
    return _best(found, k)


def _found(names, vectors, points, ids, k) -> pa.RecordBatch:
    q, c, s = [], [], []
    for i, near, far in _nearest(vectors, points, ids, k):
        q.append(np.full(len(near), names[i]))
        c.append(near)
        s.append(far)
    empty = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([empty, *q])),
            pa.array(np.concatenate([empty, *c])),
            pa.array(np.concatenate([np.zeros(0), *s])),
        ],
        names=["qid", "cid", "score"],
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("score", "cid"))
    distinct = found.groupBy("qid", "cid").agg(F.min("score").alias("score"))
    return distinct.withColumn("r", rank).filter(F.col("r") <= k).drop("r")


def _tuned(
    forest: Forest, classes: DataFrame, queries: DataFrame, k: int, aim: float
) -> int:
    """Candidates needed so that the share ``aim`` of true neighbours is among them.

    Taken from at most ``TUNING_QUERIES`` queries, compared with all rows.
    """
    chosen = queries.orderBy(F.xxhash64("qid")).limit(TUNING_QUERIES).collect()
    if not chosen:
        return 1
    near = exact(classes, [(r["qid"], r["v"]) for r in chosen], k + 1)
    rows = near.join(classes.select("cid", "v"), "cid").select("qid", "cid", "v").collect()
    place = {r["qid"]: i for i, r in enumerate(chosen)}
    own = forest.codes(np.array([r["v"] for r in chosen]))
    counts = forest.counts(own)
    need = []
    for r in rows:
        if r["cid"] == r["qid"]:
            continue
        i = place[r["qid"]]
        differ = own[i] ^ forest.codes(np.array([r["v"]]))[0]
        shared = max(forest.bits - int(x).bit_length() for x in differ)
        deeper = counts[i, shared + 1] if shared < forest.bits else 0
        need.append(int(deeper) + 1)
    return int(np.quantile(need, aim, method="higher")) if need else 1


def search(
    rows: DataFrame,
    query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    trees: int = 24,
    bits: int = 16,
    aim: float = 0.95,
    slice_rows: int = 16_384,
    seed: int = 7,
) -> DataFrame:
    """The ``k`` nearest rows found for every row where ``query`` holds, by Euclidean distance.

    A tree hashes vectors to strings of ``bits`` signs of projections and keeps them sorted. A
    query descends to the vectors that share most of its string; then all trees ascend together,
    giving up one bit at a time, until they offer enough candidates. How many are enough is
    tuned on a bounded sample of queries with known neighbours so that the share ``aim`` of these
    would be found, and at least so many that ``k`` others are among them unless the table has
    fewer. All candidates are compared by their exact distance.

    Each tree's sorted array is cut into slices of about ``slice_rows`` vectors; a
    query goes to the slices its run of the array lies in, and passes by them as a stream. Equal
    vectors are one entry with their ``k + 1`` smallest ids. ``bits`` should be about the
    logarithm of the number of vectors.

    Vectors that are null, zero, or hold null or non-finite numbers take no part, nor do null
    keys. All vectors need the same length; those of another than the most common one take no
    part. A query isn't its own neighbour; ties go to the smaller key. An empty table or one
    without queries gives no rows.

    Returns ``query_id``, ``rank`` from 1, ``key`` and ``score``, the distance.
    """
    vectors = _usable(rows, key, vector)
    sizes = vectors.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    if sizes is not None:
        vectors = vectors.filter(F.size("v") == sizes["s"])
    vectors = materialize(vectors, "vectors")
    classes = materialize(_classes(vectors, k + 1), "classes")
    asked = vectors.join(
        rows.filter(query).select(F.col(key).alias("id")).distinct(), "id", "left_semi"
    ).distinct()
    asked = materialize(
        asked.join(classes.select("v", F.col("cid").alias("qid")), "v").select("id", "qid"), "asked"
    )
    queries = materialize(
        classes.join(asked.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi").select(
            F.col("cid").alias("qid"), "v"
        ),
        "queries",
    )
    if queries.isEmpty():
        found = classes.sparkSession.createDataFrame([], "qid long, cid long, score double")
    else:
        forest = _build(classes, trees, bits, seed)
        # A vector counts once a tree, so that many are at least k + 1 different ones.
        wanted = max(_tuned(forest, classes, queries, k, aim), trees * (k + 1))
        found = _best(_candidates(forest, classes, queries, wanted, k + 1, slice_rows), k + 1)
    every = found.join(classes.select("cid", "ids"), "cid").select(
        "qid", "score", F.explode("ids").alias("vec")
    )
    near = Window.partitionBy("qid").orderBy("score", "vec")
    every = every.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1)
    own = asked.join(every, "qid").filter(F.col("vec") != F.col("id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("score", "vec"))
    ranked = own.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", F.col("vec").alias(key), "score")


def _candidates(
    forest: Forest, classes: DataFrame, queries: DataFrame, wanted: int, k: int, slice_rows: int
) -> DataFrame:
    """The nearest of every query's candidates, slice by slice: ``qid``, ``cid``, ``score``."""
    shared = classes.sparkSession.sparkContext.broadcast(forest)
    trees = len(forest.planes)
    per_tree = int(forest.before[0, -1]) // slice_rows + 1
    schema = "slice long, kind int, low long, high long, id long, v array<double>"

    def rows(batch, which, slices, kind, low, high, ids) -> pa.RecordBatch:
        at = pa.array(which)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(slices.astype(np.int64)),
                pa.array(np.full(len(which), kind, np.int32)),
                pa.array(low.astype(np.int64)),
                pa.array(high.astype(np.int64)),
                ids.take(at),
                batch.column(1).take(at),
            ],
            names=["slice", "kind", "low", "high", "id", "v"],
        )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for first in range(0, len(whole), 1000):
                batch = whole.slice(first, 1000)
                codes = own.codes(_matrix(batch.column(1)))
                start = own.before[np.arange(trees), codes]
                size = own.before[np.arange(trees), codes + 1] - start
                # Vectors of one hash are spread over its places in the array.
                salt = np.asarray(batch.column(0)).astype(np.uint64)[:, None]
                salt = (salt * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                spot = start + (salt % np.maximum(size, 1).astype(np.uint64)).astype(np.int64)
                slices = spot // slice_rows + np.arange(trees) * per_tree
                which = np.repeat(np.arange(len(batch)), trees)
                flat = codes.ravel()
                yield rows(batch, which, slices.ravel(), 0, flat, flat, batch.column(0))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for begin in range(0, len(whole), 1000):
                batch = whole.slice(begin, 1000)
                codes = own.codes(_matrix(batch.column(1)))
                level = own.stop_levels(codes, wanted)[:, None]
                low, high = own.runs(codes, level)
                tree = np.arange(trees)
                first = own.before[tree, low] // slice_rows
                last = np.maximum(own.before[tree, high] - 1, own.before[tree, low]) // slice_rows
                n = (last - first + 1).ravel()
                which = np.repeat(np.repeat(np.arange(len(batch)), trees), n)
                base = np.repeat((first + tree * per_tree).ravel(), n)
                step = np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
                low, high = np.repeat(low.ravel(), n), np.repeat(high.ravel(), n)
                yield rows(batch, which, base + step, 1, low, high, batch.column(0))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, points = None, []
        codes = ids = matrix = None
        for batch in batches:
            slices, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            change = np.flatnonzero((np.diff(slices) != 0) | (np.diff(kinds) != 0)) + 1
            edges = [0, *change.tolist(), len(batch)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if slices[a] != at:
                    at, points, codes = slices[a], [], None
                if kinds[a] == 0:
                    points.append(part)
                    codes = None
                    continue
                if not points:
                    continue
                if codes is None:
                    codes = np.concatenate([np.asarray(p.column(2)) for p in points])
                    ids = np.concatenate([np.asarray(p.column(4)) for p in points])
                    matrix = np.concatenate([_matrix(p.column(5)) for p in points])
                    order = np.argsort(codes, kind="stable")
                    codes, ids, matrix = codes[order], ids[order], matrix[order]
                low, high = np.asarray(part.column(2)), np.asarray(part.column(3))
                first = np.searchsorted(codes, low)
                last = np.searchsorted(codes, high)
                names, vectors = np.asarray(part.column(4)), _matrix(part.column(5))
                # Queries of one run are compared together.
                runs = np.unique(np.stack([first, last], axis=1), axis=0)
                for x, y in runs.tolist():
                    same = np.flatnonzero((first == x) & (last == y))
                    for i in range(0, len(same), 256):
                        some = same[i : i + 256]
                        yield _found(names[some], vectors[some], matrix[x:y], ids[x:y], k)

    both = classes.select("cid", "v").mapInArrow(place, schema).unionByName(
        queries.select("qid", "v").mapInArrow(ask, schema)
    )
    dealt = both.repartition("slice").sortWithinPartitions("slice", "kind")
    return dealt.mapInArrow(compare, "qid long, cid long, score double")

"""Hard-negative mining over an inverted multi-index."""

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.sources.storage import materialize

#: Vectors the codebooks are fitted on at most; every vector is indexed.
SAMPLE = 10_000
#: Codes of a half-space at most, and the rows a cell should hold about.
MOST_CODES = 64
CELL_ROWS = 256
#: Rows of a shard at most; cells that hold more are split, small cells share one.
SHARD_ROWS = 4096
#: Rows that the cells of the first round hold, and by how much later rounds may grow.
FIRST_ROWS = 4096
GROWTH = 16
_NO_LIMIT = np.int64(1) << np.int64(62)


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks, one for each half of the components, and the cells they form.

    A cell is a pair of codes. ``radius`` is the largest distance of a half vector from its
    code's centre, so a cell's scores with a query lie within its bounds.
    """

    centres: tuple[np.ndarray, np.ndarray]
    radius: tuple[np.ndarray, np.ndarray]
    count: np.ndarray  # rows of each cell
    first: np.ndarray  # first shard of each cell
    parts: np.ndarray  # shards of each cell

    @property
    def half(self) -> int:
        return self.centres[0].shape[1]

    def bounds(self, query: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Most and least that each code of either half adds to a score."""
        upper, lower = [], []
        for part, centres, radius in zip(
            (query[: self.half], query[self.half :]), self.centres, self.radius, strict=True
        ):
            size = np.linalg.norm(part)
            middle, spread = centres @ part, size * radius
            # Room for rounding, so that a bound is never too narrow.
            spread = spread + 1e-9 * (np.abs(middle) + size * np.linalg.norm(centres, axis=1)) + 0.25
            upper.append(middle + spread)
            lower.append(middle - spread)
        return upper, lower

    def cells_by_bound(self, query: np.ndarray) -> Iterator[tuple[int, float, float]]:
        """Cells with rows as ``(cell, upper, lower)``, the highest upper bound first.

        The multi-sequence algorithm: both halves' codes are sorted by their bound, and a
        cell enters the heap once both cells before it have left.
        """
        upper, lower = self.bounds(query)
        a, b = (np.argsort(-u, kind="stable") for u in upper)
        ua, ub = upper[0][a].tolist(), upper[1][b].tolist()
        la, lb = lower[0][a].tolist(), lower[1][b].tolist()
        rows, columns = len(ua), len(ub)
        cell = (a[:, None] * columns + b[None, :]).tolist()
        filled = (self.count.reshape(rows, columns)[a][:, b] > 0).tolist()
        # In row i the cells up to column taken[i] have left the heap.
        taken = [-1] * rows
        heap = [(-(ua[0] + ub[0]), 0, 0)]
        while heap:
            bound, i, j = heappop(heap)
            taken[i] = j
            if filled[i][j]:
                yield cell[i][j], -bound, la[i] + lb[j]
            if i + 1 < rows and taken[i + 1] == j - 1:
                heappush(heap, (-(ua[i + 1] + ub[j]), i + 1, j))
            if j + 1 < columns and (i == 0 or taken[i - 1] >= j + 1):
                heappush(heap, (-(ua[i] + ub[j + 1]), i, j + 1))


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    near = (centres * centres).sum(axis=1) - 2 * points @ centres.T
    return near + (points * points).sum(axis=1)[:, None]


def _codebook(points: np.ndarray, codes: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's algorithm on the sample."""
    if not points.shape[1]:
        return np.zeros((1, 0))
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:codes]]
    for _ in range(rounds):
        own = _distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def _packed(matrix: np.ndarray, kind: str) -> pa.Array:
    """The rows of a matrix as binary values."""
    data = np.ascontiguousarray(matrix.astype(kind))
    width = data.shape[1] * data.itemsize
    offsets = (np.arange(len(data) + 1) * width).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(data), buffers)


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]
    low, high = int(offsets[0]), int(offsets[len(column)])
    flat = np.frombuffer(column.buffers()[2], np.uint8)[low:high].view(kind)
    return flat.reshape(len(column), -1)


def _usable(rows: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """``id``, ``label`` and the whole-number vector ``v`` of the rows that take part."""
    plain = rows.select(
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).alias("x"),
    )
    number = F.transform("x", lambda x: x.cast("double"))
    bad = F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = plain.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    whole = F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return sound.filter(~bad).select("id", "label", whole.alias("v"))


def _coded(vectors: DataFrame, centres: tuple[np.ndarray, np.ndarray], kind: str) -> DataFrame:
    """Every row with its cell, its distances from both centres and its packed vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    names = ["id", "label", "cell", "d0", "d1", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        half = books[0].shape[1]
        for batch in batches:
            if not len(batch):
                continue
            matrix = _matrix(batch.column(2))
            parts = matrix[:, :half].astype(float), matrix[:, half:].astype(float)
            codes, far = [], []
            for part, book in zip(parts, books, strict=True):
                code = _distances(part, book).argmin(axis=1)
                codes.append(code)
                far.append(np.linalg.norm(part - book[code], axis=1))
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array((codes[0] * len(books[1]) + codes[1]).astype(np.int32)),
                pa.array(far[0]),
                pa.array(far[1]),
                _packed(matrix, kind),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "id long, label long, cell int, d0 double, d1 double, v binary"
    return vectors.select("id", "label", "v").mapInArrow(run, schema)


def _index(coded: DataFrame, centres: tuple[np.ndarray, np.ndarray]) -> MultiIndex:
    """Radii, counts and shards, from at most ``MOST_CODES`` squared rows."""
    codes = len(centres[0]), len(centres[1])
    cells = coded.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("d0").alias("d0"), F.max("d1").alias("d1")
    )
    count = np.zeros(codes[0] * codes[1], np.int64)
    radius = np.zeros(codes[0]), np.zeros(codes[1])
    for row in cells.collect():
        i, j = divmod(row["cell"], codes[1])
        count[row["cell"]] = row["n"]
        radius[0][i] = max(radius[0][i], row["d0"])
        radius[1][j] = max(radius[1][j], row["d1"])
    first, parts = np.zeros(len(count), np.int64), np.ones(len(count), np.int64)
    shard, room = 0, SHARD_ROWS
    for cell in np.flatnonzero(count):
        if count[cell] > room and room < SHARD_ROWS:
            shard, room = shard + 1, SHARD_ROWS
        first[cell] = shard
        if count[cell] > SHARD_ROWS:
            # Half of a shard on average, as rows are dealt by a hash.
            parts[cell] = -(-2 * count[cell] // SHARD_ROWS)
            shard += int(parts[cell])
        else:
            room -= int(count[cell])
    return MultiIndex(centres, radius, count, first, parts)


_SCAN = (
    "shard long, kind int, id long, label long, cell int, v binary, "
    "cells array<int>, lows array<long>, highs array<long>"
)


def _dealt(coded: DataFrame, shared) -> DataFrame:
    """The indexed rows by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            cell = np.asarray(batch.column(2))
            salt = np.asarray(batch.column(0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            part = (salt >> np.uint64(20)) % index.parts[cell].astype(np.uint64)
            columns = [
                pa.array(index.first[cell] + part.astype(np.int64)),
                pa.array(np.zeros(len(batch), np.int32)),
                *(batch.column(i) for i in (0, 1, 2, 3)),
                pa.nulls(len(batch), pa.list_(pa.int32())),
                pa.nulls(len(batch), pa.list_(pa.int64())),
                pa.nulls(len(batch), pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=_names(_SCAN))

    return coded.select("id", "label", "cell", "v").mapInArrow(run, _SCAN)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _visits(state: DataFrame, shared, kind: str, budget: int) -> DataFrame:
    """What each query visits next, one row for each shard, and its state behind that.

    A query goes on from its ``done``-th cell until the cells passed hold ``budget`` rows
    or no window can gain: a window is certified when the next cell's bound is below its
    low end, or below the last of its ``kths``, which it has once it is full. Cells that lie
    above all open windows are passed over. Rows of kind 1 are visits, of kind 2 states.
    """
    schema = _SCAN + ", done long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if not len(batch):
                continue
            out: list[tuple] = []
            queries = _unpacked(batch.column(2), kind).astype(float)
            rows = batch.select(["id", "label", "v", "lows", "highs", "done", "kths"]).to_pylist()
            for row, query in zip(rows, queries, strict=True):
                kths = {x["w"]: x["score"] for x in row["kths"] or []}
                # What a row has to score to get into a window, and at most.
                ends = [
                    (max(low, kths.get(w, low)), high)
                    for w, (low, high) in enumerate(zip(row["lows"], row["highs"], strict=True))
                    if low <= high
                ]
                wanted: dict[int, list[int]] = {}
                done, seen = 0, 0
                for cell, upper, lower in index.cells_by_bound(query):
                    left = [e for e in ends if upper >= e[0]]
                    if not left:
                        break
                    if done >= row["done"]:
                        if seen >= budget:
                            break
                        if lower <= max(e[1] for e in left):
                            for part in range(index.parts[cell]):
                                wanted.setdefault(int(index.first[cell]) + part, []).append(cell)
                            seen += int(index.count[cell])
                    done += 1
                own = (row["id"], row["label"], None, row["v"])
                for shard, cells in wanted.items():
                    out.append((shard, 1, *own, cells, row["lows"], row["highs"], done))
                if wanted:
                    out.append((-1, 2, *own, [], row["lows"], row["highs"], done))
            if out:
                columns = [
                    pa.array(list(c), f.type) for c, f in zip(zip(*out), _arrow(schema), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_names(schema))

    return state.mapInArrow(run, schema)


def _arrow(schema: str) -> list[pa.Field]:
    kinds = {
        "long": pa.int64(),
        "int": pa.int32(),
        "binary": pa.binary(),
        "array<int>": pa.list_(pa.int32()),
        "array<long>": pa.list_(pa.int64()),
    }
    return [pa.field(*(p[0], kinds[p[1]])) for p in (x.split() for x in schema.split(", "))]


class _Shard:
    """The rows of one shard, ordered by cell."""

    def __init__(self, parts: list[pa.RecordBatch], kind: str):
        cell = np.concatenate([np.asarray(p.column(4)) for p in parts])
        order = np.argsort(cell, kind="stable")
        self.cell = cell[order]
        self.ids = np.concatenate([np.asarray(p.column(2)) for p in parts])[order]
        self.labels = np.concatenate([np.asarray(p.column(3)) for p in parts])[order]
        self.matrix = np.concatenate([_unpacked(p.column(5), kind) for p in parts])[order]
        self.most = float(np.abs(self.matrix.astype(float)).max(initial=0))
        self.real = self.matrix.astype(float)

    def scores(self, at: np.ndarray | slice, query: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        largest = self.most * float(np.abs(query.astype(float)).max(initial=0)) * len(query)
        if largest < 2**53:
            return (self.real[at] @ query.astype(float)).astype(np.int64)
        if largest < 2**62:
            return self.matrix[at].astype(np.int64) @ query.astype(np.int64)
        raise OverflowError("inner products of these vectors don't fit a long")

    def best(self, anchor: int, label: int, query, cells, lows, highs, same: bool, k: int):
        """Window, score and id of the first ``k`` rows of each window in the given cells."""
        cells = np.sort(cells)
        first = np.searchsorted(self.cell, cells, "left")
        last = np.searchsorted(self.cell, cells, "right")
        at: np.ndarray | slice
        if int((last - first).sum()) == len(self.cell):
            at = slice(None)
        else:
            at = np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])
        scores, ids, labels = self.scores(at, query), self.ids[at], self.labels[at]
        keep = (labels == label) == same
        keep &= (ids != anchor) & (scores >= lows.min()) & (scores <= highs.max())
        scores, ids = scores[keep], ids[keep]
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        for w, (low, high) in enumerate(zip(lows, highs, strict=True)):
            begin = int(np.searchsorted(-scores, -high, "left"))
            stop = min(begin + k, int(np.searchsorted(-scores, -low, "right")))
            for i in range(begin, stop):
                yield w, scores[i], ids[i]


def _scan(dealt: DataFrame, kind: str, same: bool, k: int) -> DataFrame:
    """The best rows of every visit: ``id``, ``w``, ``score`` and ``vec``.

    A task gets whole shards, each shard's rows before the queries that visit it, which
    pass by as a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard = None, [], None
        for batch in batches:
            shards, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            change = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            edges = [0, *change.tolist(), len(batch)]
            found: list[tuple] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if shards[a] != at:
                    at, parts, shard = shards[a], [], None
                if kinds[a] == 0:
                    parts.append(part)
                    continue
                if shard is None:
                    shard = _Shard(parts, kind)
                queries = _unpacked(part.column(5), kind)
                for i, (anchor, label) in enumerate(
                    zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                ):
                    cells, lows, highs = (np.asarray(part.column(c)[i].values) for c in (6, 7, 8))
                    found += [
                        (anchor, *x)
                        for x in shard.best(anchor, label, queries[i], cells, lows, highs, same, k)
                    ]
            if found:
                ids, w, score, vec = (np.array(c) for c in zip(*found, strict=True))
                columns = [ids, w.astype(np.int32), score, vec]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["id", "w", "score", "vec"]
                )

    ordered = dealt.repartition("shard").sortWithinPartitions("shard", "kind")
    return ordered.mapInArrow(run, "id long, w int, score long, vec long")


def _first_in_windows(
    coded: DataFrame, shared, queries: DataFrame, kind: str, same: bool, k: int
) -> DataFrame:
    """The first ``k`` rows of each of the queries' windows: ``id``, ``w``, ``vec``, ``score``, ``r``.

    ``queries`` have ``id``, ``label``, ``v``, and the windows' ``lows`` and ``highs``; rows count
    whose label is the same or, else, another one.
    """
    spark = coded.sparkSession
    best = spark.createDataFrame([], "id long, w int, score long, vec long, r int")
    state = queries.withColumn("done", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("id", "w").orderBy(F.desc("score"), "vec"))
    budget = FIRST_ROWS
    while True:
        kths = best.filter(F.col("r") == k).groupBy("id").agg(
            F.collect_list(F.struct("w", "score")).alias("kths")
        )
        asked = state.join(kths, "id", "left").select(
            "id", "label", "v", "lows", "highs", "done", "kths"
        )
        plan = materialize(_visits(asked, shared, kind, budget), "visits")
        if plan.isEmpty():
            return best
        visits = plan.filter(F.col("kind") == 1).drop("done")
        found = _scan(_dealt(coded, shared).unionByName(visits), kind, same, k)
        every = best.drop("r").unionByName(found).withColumn("r", rank).filter(F.col("r") <= k)
        best = materialize(every, "best")
        state = plan.filter(F.col("kind") == 2).select("id", "label", "v", "lows", "highs", "done")
        budget *= GROWTH


_FOUND = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
    "negative_score long"
)


def mine(
    rows: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    seed: int = 11,
) -> DataFrame:
    """Rows of other labels that score almost as high with an anchor as its positives do.

    Components become ``floor(scale * x)``; a score is the inner product with the anchor, and of
    equal scores the smaller key comes first. An anchor's positives are its first
    ``positives`` other rows of the same label. For each, the first ``negatives`` rows of
    another label count that score between ``low`` and ``high`` percent of the positive.

    An inverted multi-index: each half of the components has a codebook, fitted on at most
    ``SAMPLE`` vectors, and pairs of codes are cells. A query's heap visits cells by the sum of the
    halves' bounds, centre and radius, in rounds; it stops when no cell left can
    change any window, so results are exact. Cells lie in shards of at most about ``SHARD_ROWS``
    rows, however many share one cell.

    Rows with a null key, label or vector, or with null or non-finite components, take no part;
    nor do vectors of another length than the most common one. Of rows that repeat a key the one
    with the smallest label, then vector, counts. Equal vectors are separate rows. An
    empty table or one without anchors gives no rows. Other columns aren't read.

    Returns ``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score`` and
    ``negative_score``.
    """
    spark = rows.sparkSession
    vectors = _usable(rows, key, vector, label, scale)
    size = F.size("v")
    largest = F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x))))
    usual = vectors.groupBy(size.alias("s")).agg(F.count("*").alias("n"), largest.alias("most"))
    common = usual.orderBy(F.desc("n"), "s").first()
    if common is None or common["s"] == 0:
        return spark.createDataFrame([], _FOUND)
    kind = next(t for t in ("<i2", "<i4", "<i8") if common["most"] <= np.iinfo(t).max)
    vectors = materialize(vectors.filter(size == common["s"]), "vectors")
    if not vectors.groupBy("id").count().filter(F.col("count") > 1).isEmpty():
        one = F.min(F.struct("label", "v")).alias("x")
        vectors = materialize(vectors.groupBy("id").agg(one).select("id", "x.*"), "vectors")

    count = vectors.count()
    codes = min(MOST_CODES, max(2, round((count / CELL_ROWS) ** 0.5)))
    sample = vectors.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").toArrow()
    points = _matrix(sample.column(0).combine_chunks()).astype(float)
    half = (common["s"] + 1) // 2
    centres = tuple(
        _codebook(part, codes, seed) for part in (points[:, :half], points[:, half:])
    )
    coded = materialize(_coded(vectors, centres, kind), "coded")
    shared = spark.sparkContext.broadcast(_index(coded, centres))

    chosen = rows.filter(anchor).select(F.col(key).cast("long").alias("id")).distinct()
    anchors = coded.join(chosen, "id", "left_semi").select("id", "label", "v")
    whole = anchors.withColumns(
        {"lows": F.array(F.lit(int(-_NO_LIMIT))), "highs": F.array(F.lit(int(_NO_LIMIT)))}
    )
    near = _first_in_windows(coded, shared, whole, kind, True, positives)
    # Whole quotients, rounded inwards.
    highest = F.expr(f"({high} * score - pmod({high} * score, 100)) div 100")
    lowest = F.expr(f"-((-{low} * score - pmod(-{low} * score, 100)) div 100)")
    windows = near.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("r", lowest.alias("l"), highest.alias("h")))).alias("x")
    )
    ranged = anchors.join(windows, "id").select(
        "id", "label", "v", F.col("x.l").alias("lows"), F.col("x.h").alias("highs")
    )
    far = _first_in_windows(coded, shared, ranged, kind, False, negatives)
    own = near.select(
        "id",
        (F.col("r") - 1).alias("w"),
        F.col("vec").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return far.join(own, ["id", "w"]).select(
        F.col("id").alias("anchor_id"),
        "positive_id",
        F.col("r").alias("rank"),
        F.col("vec").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )

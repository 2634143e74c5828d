"""Packing documents into sequences of fixed length by bin completion."""

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotcast.llm import byte_bpe, spans
from slotcast.sources.storage import materialize

CAPACITY = 1024
END_ID = 2
#: Steps the search may take beyond its first descent; packing is NP-hard.
SEARCH_STEPS = 4000
#: Steps whose enumerations are kept; those further up are repeated if they are needed again.
_LIVE = 32


@dataclass(frozen=True)
class Filling:
    """``repeat`` sequences that hold the same sizes, largest first."""

    sizes: tuple[int, ...]
    repeat: int


def _dominated(filling: list[int], sizes: list[int], left: dict[int, int], room: int) -> bool:
    """Whether a document left out still fits, or could take the place of one or two smaller ones."""
    slack = room - sum(filling)
    used = {s: filling.count(s) for s in filling}
    joined = [0, *used] + [a + b for i, a in enumerate(filling[:8]) for b in filling[:i]]
    for i, low in enumerate(joined):
        least = low + (i <= len(used))
        at = bisect_right(sizes, low + slack) - 1
        while at >= 0 and sizes[at] >= least:
            if left[sizes[at]] > used.get(sizes[at], 0):
                return True
            at -= 1
    return False


def _fillings(
    sizes: list[int], left: dict[int, int], room: int, allowed: Callable[[], int]
) -> Iterator[list[int] | None]:
    """All undominated fillings of ``room``, one after another by waste; None for a dominated one.

    Sums that can be reached with the smaller sizes are kept as bits of a number, so
    that every branch of the enumeration ends in a filling. Fillings that waste more than
    ``allowed`` at the time aren't enumerated.
    """
    counts = dict(left)
    usable = [s for s in sizes if s <= room and counts[s]]
    reach, mask = [1], (1 << (room + 1)) - 1
    for size in usable:
        bits, n, step = reach[-1], min(counts[size], room // size), 1
        while n:
            step = min(step, n)
            bits |= bits << size * step
            n -= step
            step *= 2
        reach.append(bits & mask)

    def fill(upto: int, target: int) -> Iterator[list[int]]:
        if not target:
            yield []
            return
        for i in range(min(upto, bisect_right(usable, target)) - 1, -1, -1):
            if not reach[i + 1] >> target & 1:
                return
            size = usable[i]
            for n in range(min(counts[size], target // size), 0, -1):
                if reach[i] >> (target - n * size) & 1:
                    for rest in fill(i, target - n * size):
                        yield [size] * n + rest

    for waste in range(room + 1):
        if waste > allowed():
            return
        if reach[-1] >> (room - waste) & 1:
            for filling in fill(len(usable), room - waste):
                yield None if _dominated(filling, sizes, counts, room) else filling


class _Branch:
    """What may follow at one step: fillings as often as they go, then less often.

    ``taken`` options have been tried. The enumeration of an upper step may be forgotten, and
    is done again up to that place if the search comes back to it.
    """

    def __init__(self, options: Callable[[], Iterator[tuple[list[int], int] | None]]):
        self.options = options
        self.live: Iterator | None = None
        self.taken = 0

    def next(self):
        """The next option, None for one that isn't worth trying; StopIteration at the end."""
        if self.live is None:
            self.live = self.options()
            for _ in range(self.taken):
                next(self.live, None)
        self.taken += 1
        return next(self.live)


def complete_bins(
    histogram: dict[int, int], capacity: int = CAPACITY, steps: int = SEARCH_STEPS
) -> list[Filling]:
    """Fillings that together hold every document of a histogram of sizes.

    Depth-first branch and bound. Each step takes the largest size left and enumerates the
    undominated fillings of the room beside it by waste; the chosen one is repeated as often as
    the counts allow, and less often once all are tried. A branch ends when its waste alone makes
    it no better than the best packing so far; the first descent, which always takes the best fit,
    is the first such packing. The search ends when the packing reaches the bound
    ``ceil(total / capacity)``, when it is exhausted, or ``steps`` steps after the first descent;
    nothing else limits it.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    total = sum(s * n for s, n in left.items())
    least = -(-total // capacity)
    sizes = sorted(left)
    best: list[Filling] | None = None
    best_bins = float("inf")
    path: list[Filling] = []
    open_sizes: list[list[int]] = []
    choices: list[_Branch] = []
    bins = waste = taken = 0

    def allowed() -> int:
        """The most waste that one more sequence may have in a better packing."""
        return capacity if best is None else capacity * (best_bins - 1) - total - waste

    def descend() -> None:
        largest, own = sizes[-1], sizes

        def options() -> Iterator[tuple[list[int], int] | None]:
            for tried in (False, True):
                left[largest] -= 1
                fillings = _fillings(own, left, capacity - largest, allowed)
                first = next(fillings, None)
                left[largest] += 1
                for filling in chain([first], fillings):
                    if filling is None:
                        yield None
                        continue
                    whole = [largest, *filling]
                    most = min(left[s] // whole.count(s) for s in whole)
                    if not tried:
                        yield whole, most
                    else:
                        yield from ((whole, n) for n in range(most - 1, 0, -1))

        choices.append(_Branch(options))
        if len(choices) > _LIVE:
            choices[-_LIVE - 1].live = None

    def undo() -> None:
        nonlocal bins, waste, sizes
        last = path.pop()
        sizes = open_sizes.pop()
        for size in last.sizes:
            left[size] += last.repeat
        bins -= last.repeat
        waste -= last.repeat * (capacity - sum(last.sizes))

    if not left:
        return []
    descend()
    while choices:
        if best is not None and taken >= steps:
            break
        taken += best is not None
        try:
            option = choices[-1].next()
        except StopIteration:
            choices.pop()
            if path:
                undo()
            continue
        if option is None:
            continue
        filling, repeat = option
        path.append(Filling(tuple(filling), repeat))
        open_sizes.append(sizes)
        for size in filling:
            left[size] -= repeat
        sizes = [s for s in sizes if left[s]]
        bins += repeat
        waste += repeat * (capacity - sum(filling))
        # Bins at the end are at least (total + waste) / capacity.
        if -(-(total + waste) // capacity) >= best_bins:
            undo()
        elif sizes:
            descend()
        else:
            best, best_bins = list(path), bins
            if best_bins == least:
                break
            undo()
    return best


def plan_rows(plan: list[Filling]) -> list[tuple[int, int, int, int, int]]:
    """Where the documents of each size go, by their rank among those of that size.

    Rows are ``(size, first rank, documents per sequence, first sequence, offset)``.
    """
    rows, ranks, sequence = [], {}, 0
    for filling in plan:
        offset = 0
        for size in dict.fromkeys(filling.sizes):
            n = filling.sizes.count(size)
            rows.append((size, ranks.get(size, 0), n, sequence, offset))
            ranks[size] = ranks.get(size, 0) + n * filling.repeat
            offset += n * size
        sequence += filling.repeat
    return sorted(rows)


def token_pieces(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    vocabulary: str = byte_bpe.VOCABULARY,
    with_ids: bool = False,
) -> DataFrame:
    """Tokens of every whole text and ``end_id``, cut into pieces of at most ``capacity``.

    All pieces but the first are full. Returns ``key``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, the task's number ``part``, ``nth`` among the task's pieces of this length
    and, if asked for, ``ids``. Null texts count as empty and give one piece.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe.encoder(vocabulary)
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = spans.utf8(batch.column(1))
            for low, high in spans.slices(offsets):
                row, start, length = encoder.locate(
                    data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                )
                ids = encoder.runs.pool[spans.gather(start, length)]
                sizes = np.bincount(row, length, high - low).astype(np.int64)
                stops = np.cumsum(sizes)
                ids = np.insert(ids, stops, end_id).astype("<u4")
                sizes += 1
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(high - low), pieces)
                nth_piece = spans.gather(np.zeros(high - low, np.int64), pieces)
                first = sizes - capacity * (pieces - 1)
                begin = np.where(nth_piece == 0, 0, first[doc] + capacity * (nth_piece - 1))
                width = np.where(nth_piece == 0, first[doc], capacity)
                base = (np.cumsum(sizes) - sizes)[doc] + begin
                raw = ids.tobytes()
                edges = zip((4 * base).tolist(), (4 * (base + width)).tolist(), strict=True)
                crc = [zlib.crc32(raw[a:b]) for a, b in edges]
                order = np.argsort(width, kind="stable")
                same = width[order]
                runs = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
                counts = np.diff(np.append(runs, len(same)))
                nth = np.empty(len(width), np.int64)
                nth[order] = spans.gather(seen[same[runs]], counts)
                seen[same[runs]] += counts
                columns = [
                    batch.column(0).slice(low, high - low).take(pa.array(doc)),
                    pa.array(nth_piece.astype(np.int32)),
                    pa.array(begin),
                    pa.array(width),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(doc), part, np.int32)),
                    pa.array(nth),
                ]
                names = ["k", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if with_ids:
                    cuts = pa.array(np.append(base, len(ids)).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(cuts, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"k {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"
    schema += ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(cut, schema).withColumnRenamed("k", key)


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    vocabulary: str = byte_bpe.VOCABULARY,
    with_ids: bool = False,
    steps: int = SEARCH_STEPS,
) -> DataFrame:
    """Pack whole documents into as few sequences of ``capacity`` tokens as the search finds.

    Sizes are whole numbers up to ``capacity``, so the search needs only the number of
    pieces of each size, at most ``capacity`` rows. Its plan says which ranks of a size go where;
    a piece finds its rank from the counts of the tasks before its own, so no size, however
    common, is sorted or gathered in one task. The plan's length depends on
    the capacity, not on the number of documents.

    Null and empty texts are documents of the end id alone. Rows with equal or null keys
    are packed on their own; an empty table gives no rows. Other columns aren't read.

    Returns ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset`` and, if asked for, ``ids``.
    """
    pieces = materialize(
        token_pieces(docs, key, text, capacity, end_id, vocabulary, with_ids), "pieces"
    )
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    rows = plan_rows(complete_bins({r["length"]: r["n"] for r in histogram}, capacity, steps))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(
        "part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    table = np.array(rows, np.int64).reshape(-1, 5)
    # One sorted number for size and rank: ranks stay below 2 ** 50.
    place = (table[:, 0] << 50) + table[:, 1]
    ranked = pieces.join(ranks, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    names = [key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "rank"))
            row = table[np.searchsorted(place, (size << 50) + rank, "right") - 1]
            nth, n = rank - row[:, 1], np.maximum(row[:, 2], 1)
            columns = [batch.column(i) for i in range(len(names))]
            columns += [pa.array(row[:, 3] + nth // n), pa.array(row[:, 4] + nth % n * size)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(names).schema)
    return ranked.select(*names, "rank").mapInArrow(
        assign, f"{schema}, sequence_id long, offset long"
    )

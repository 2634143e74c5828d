"""Word spans and hashes of whole Arrow text batches, computed with numpy.

Words are maximal runs of bytes other than space and ``\\x09-\\x0D``; in UTF-8
no such byte is part of a longer character. Null texts count as empty.
"""

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are handled in slices of about this many bytes, which bounds memory.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a span that are looked up in tables; longer spans go to a hash function.
_DEEP = 64


def _random_tables(seed: int | None) -> np.ndarray:
    """A random 64-bit number for every byte at every place of a span."""
    return np.random.default_rng(seed).integers(0, 1 << 64, _DEEP << 8, dtype=np.uint64)


#: The same in every process, for hashes that meet in shuffles.
_SHARED = _random_tables(20240101)
#: Of this process alone, for hashes that don't leave it; no text can be made to collide in them.
PRIVATE = _random_tables(None)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    low, high = int(bounds[0]), int(bounds[-1])
    return np.frombuffer(data, np.uint8)[low:high], bounds - low


def release() -> None:
    """Give free memory back to the system, which workers would keep for the executor's life."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in some C libraries
    if trim is not None:
        trim(0)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one longer row.

    Behind the last one free memory goes back to the system.
    """
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last
    release()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(
    data: np.ndarray,
    starts: np.ndarray,
    ends: np.ndarray,
    tables: np.ndarray = _SHARED,
    block: int = 1 << 19,
) -> np.ndarray:
    """A 64-bit hash of each span of bytes or code points; spans are in order, side by side.

    Tabulation hashing: the sum of a random number for each byte at its place. Any two
    spans of up to ``_DEEP`` bytes collide with a chance of 2^-64 over the tables, whatever
    regularity they have. Longer spans are hashed by XXH3, keyed by the tables.
    """
    if data.dtype != np.uint8:
        wide = np.ascontiguousarray(data, "<u4")
        return span_hashes(wide.view(np.uint8), 4 * starts, 4 * ends, tables, block)
    out = np.empty(len(starts), np.uint64)
    key = int(tables[0])
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, int(starts[first]) + block, "right")), first + 1)
        begin, size = starts[first:last], (ends - starts)[first:last]
        short = np.where(size <= _DEEP, size, 0)
        stops = np.cumsum(short)
        place = np.arange(int(stops[-1])) - np.repeat(stops - short, short)
        sums = np.zeros(len(place) + 1, np.uint64)
        np.cumsum(tables[place << 8 | data[place + np.repeat(begin, short)]], out=sums[1:])
        found = mix(sums[stops] - sums[stops - short] + mix(size.astype(np.uint64)))
        for i in np.flatnonzero(size > _DEEP).tolist():
            low = int(begin[i])
            found[i] = xxhash.xxh3_64_intdigest(data[low : low + int(size[i])].tobytes(), key)
        out[first:last] = found
        first = last
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs ``starts[i] .. starts[i] + lengths[i]``, one after another."""
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    return np.arange(total) + np.repeat(starts - stops + lengths, lengths)


class RunTable:
    """Remembers a run of integers for each 64-bit key, up to ``most`` keys.

    When it is full it starts anew, so its memory is bounded.
    """

    def __init__(self, most: int = 1_500_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Where the given sorted keys aren't known yet; clears a table that gets too large."""
        absent = self._absent(keys)
        if len(self.keys) + len(absent) > self.most and len(self.keys):
            self.clear()
            absent = np.arange(len(keys))
        return absent

    def _absent(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.arange(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.flatnonzero(self.keys[at] != keys)

    def add(self, keys: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> None:
        """Add sorted new keys whose runs stand one after another in ``values``."""
        need = self.used + len(values)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(need, np.uint32)])
        self.pool[self.used : need] = values
        begin = self.used + np.cumsum(lengths) - lengths
        self.used = need
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, begin)
        self.length = np.insert(self.length, at, lengths)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the runs of known keys."""
        at = np.searchsorted(self.keys, keys)
        return self.start[at], self.length[at].astype(np.int64)

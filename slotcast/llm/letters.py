"""Words of letters in lower-cased whole texts, as code points in numpy arrays."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from slotcast.llm import spans

_letter: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letter:
        _letter.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letter[0]


@dataclass(frozen=True)
class Words:
    """The words of some texts: ``row`` and ``which`` of the distinct words each one is.

    Distinct word ``i`` is ``codes[start[i]:end[i]]``; ``key``, ascending, holds hashes that
    tell words apart within one process.
    """

    codes: np.ndarray
    row: np.ndarray
    which: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray

    def strings(self) -> list[str]:
        text = self.codes.astype("<u4").tobytes().decode("utf-32-le")
        return [text[a:b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]


def words(column: pa.Array) -> Words:
    """Maximal runs of letters, in lower case. Null texts have none."""
    texts = [t.lower() if t else "" for t in column.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    inside = _is_letter()[codes]
    edge = np.zeros(len(codes) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    if not len(codes):
        before = after = np.zeros(0, bool)
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    key, where, which = np.unique(
        spans.span_hashes(codes, starts, ends, spans.PRIVATE), return_index=True, return_inverse=True
    )
    return Words(codes, row, which, starts[where], ends[where], key)


def some(words: Words, chosen: np.ndarray) -> Words:
    """The chosen distinct words, in that order and without the rows they stand in."""
    none = np.zeros(0, np.int64)
    return Words(words.codes, none, none, words.start[chosen], words.end[chosen], words.key[chosen])


def packed(words: Words) -> tuple[str, np.ndarray]:
    """The distinct words one behind another, and their sizes."""
    size = words.end - words.start
    codes = np.ascontiguousarray(words.codes[spans.gather(words.start, size)], "<u4")
    return codes.tobytes().decode("utf-32-le"), size


def unpacked(text: str, size: np.ndarray) -> Words:
    """What ``packed`` words were, without rows, and with keys of zero."""
    end = np.cumsum(size, dtype=np.int64)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    none = np.zeros(0, np.int64)
    return Words(codes, none, none, end - size, end, np.zeros(len(size), np.uint64))


def flat(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the distinct words with 1 before and 2 behind each; where they begin."""
    size = words.end - words.start + 2
    begin = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint64)
    out[begin] = 1
    out[begin + size - 1] = 2
    inner = np.ones(len(out), bool)
    inner[begin] = inner[begin + size - 1] = False
    out[inner] = words.codes[spans.gather(words.start, size - 2)]
    return out, np.append(begin, len(out))

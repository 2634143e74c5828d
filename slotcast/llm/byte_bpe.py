"""Ids of a byte-level BPE for whole texts, from the ids of their distinct chunks.

The vocabulary's pattern always starts a new token where a run of white space
follows another character, and where another ASCII character follows an ASCII
letter. Cut there, a text falls into chunks whose ids stand side by side in its own.
Each distinct chunk is encoded once per worker process by the ``tokenizers`` library, many
of them in one string, and its ids are remembered.
"""

import os
import re

import numpy as np
import public_tokenizers

from slotcast.llm import spans

VOCABULARY = "byte_bpe_50k.json"
_NEWLINE = "Ċ"
#: Strings of this many bytes go to the library.
_LOT_BYTES = 1 << 10
#: White space beyond ASCII, which the pattern joins with its neighbours (fixed values).
_WIDE_SPACE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_WIDE = re.compile("[" + "".join(map(chr, _WIDE_SPACE)) + "]")
_WIDE_BYTES = np.array([int.from_bytes(chr(c).encode(), "big") for c in _WIDE_SPACE])

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII characters that are neither letters nor white space.
_SIGN = ~_LETTER & ~spans.SPACE & (np.arange(256) < 128)

_encoders: dict[str, "ByteBpe"] = {}


def encoder(vocabulary: str = "byte_bpe_50k.json") -> "ByteBpe":
    """The encoder of this worker process; what it has learned serves its later tasks."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = ByteBpe(vocabulary)
    return _encoders[vocabulary]


class ByteBpe:
    """Encoder that remembers the ids of the chunks it has seen."""

    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        words = self.library.get_vocab()
        self.newline = words[_NEWLINE]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = np.zeros(max(words.values()) + 1, np.int64)
        for word, i in words.items():
            self.width[i] = len(word)
        self.runs = spans.RunTable()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them."""
        return [np.array(e.ids, np.uint32) for e in self._batch(texts)]

    def _batch(self, texts: list[str]):
        return self.library.encode_batch_fast(texts, add_special_tokens=False)

    def chunks(self, data: np.ndarray, offsets: np.ndarray):
        """Start, end and row of the chunks of every text."""
        space, first = spans.SPACE[data], np.ones(len(data), bool)
        first[1:] = space[1:] & ~space[:-1] | _LETTER[data[:-1]] & _SIGN[data[1:]]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        for special in self.special:
            for at in re.finditer(re.escape(special.encode()), data):
                inner = np.arange(at.start() + 1, at.end())
                first[inner[~np.isin(inner, offsets)]] = False
        begin = np.flatnonzero(first)
        row = np.searchsorted(offsets, begin, "right") - 1
        if len(begin) and (data >= 0x80).any():
            # White space behind wide white space belongs to the same run.
            tail = np.zeros(len(begin), np.int64)
            for back in (3, 2, 1):
                byte = data[np.maximum(begin - back, 0)].astype(np.int64)
                tail = tail << 8 | np.where(begin - back >= offsets[row], byte, 0)
            keep = ~(np.isin(tail, _WIDE_BYTES) | np.isin(tail & 0xFFFF, _WIDE_BYTES))
            begin, row = begin[keep], row[keep]
        return begin, np.append(begin[1:], len(data)), row

    def locate(self, data: np.ndarray, offsets: np.ndarray):
        """For each chunk its row and its run of ids in ``runs.pool``."""
        begin, end, row = self.chunks(data, offsets)
        keys, where, which = np.unique(
            spans.span_hashes(data, begin, end, spans.PRIVATE),
            return_index=True,
            return_inverse=True,
        )
        new = self.runs.missing(keys)
        if len(new):
            raw = data.tobytes()
            some = where[new]
            pairs = zip(begin[some].tolist(), end[some].tolist(), strict=True)
            lengths, values = self._encode(raw, [raw[b:e] for b, e in pairs])
            self.runs.add(keys[new], lengths, values)
        start, length = self.runs.find(keys)
        return row, start[which], length[which]

    def _encode(self, raw: bytes, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks of ``raw``: their numbers, and all of them in order."""
        special = [s.encode() for s in self.special if s.encode() in raw]
        wide = not raw.isascii() and _WIDE.search(raw.decode())
        found: list[np.ndarray | None] = [None] * len(chunks)
        alone, lots, lot, size = [], [], [], 0
        for i, chunk in enumerate(chunks):
            if (
                chunk.isspace()
                or (special and any(s in chunk for s in special))
                or (wide and _WIDE.search(chunk.decode()))
            ):
                alone.append(i)
                continue
            lot.append(i)
            size += len(chunk)
            if size > _LOT_BYTES:
                lots.append(lot)
                lot, size = [], 0
        if lot:
            lots.append(lot)
        for i, ids in zip(alone, self.ids([chunks[i].decode() for i in alone]), strict=True):
            found[i] = ids
        # A chunk without white space in front gets a line break, which is a token of its own.
        bare = [[chunks[i][0] not in b" \t\n\v\f\r" for i in lot] for lot in lots]
        parts = [
            [b"\n" + chunks[i] if b else chunks[i] for i, b in zip(lot, own, strict=True)]
            for lot, own in zip(lots, bare, strict=True)
        ]
        encoded = self.ids([b"".join(part).decode() for part in parts])
        for lot, own, part, ids in zip(lots, bare, parts, encoded, strict=True):
            stops = np.cumsum(self.width[ids])
            cuts = np.searchsorted(stops, np.cumsum([len(p) for p in part])) + 1
            at = 0
            for i, b, cut in zip(lot, own, cuts.tolist(), strict=True):
                found[i] = ids[at + b : cut]
                at = cut
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return lengths, np.concatenate(found) if found else np.zeros(0, np.uint32)

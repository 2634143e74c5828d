"""SentencePiece encoding and decoding by prefix tables."""

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from slotcast.llm import spans

MODEL = "piece_bpe_32k.model"
_MARK = "▁"
_SPACE_BYTE = 32
#: Stands for a character outside the vocabulary; no piece merges with it.
_UNKNOWN = -1


class PieceTable:
    """Encodes with a merge-type SentencePiece model without running its merges.

    For every prefix of a chunk there is one token that ends the encoding of that prefix.
    An automaton lists the pieces that end at a position; the one that may follow the last
    token of the prefix before it is the last token here. Two pieces may stand
    side by side if the merges of their joined text give just these two, which is
    tested once per pair. From the last position the ids are read backwards.

    Texts are cut between characters that stand side by side in no piece, as in front
    of every run of spaces. Runs of two or more spaces are merged directly: their pieces
    have equal scores, so their last tokens aren't unique.
    """

    def __init__(self, model: str = MODEL):
        self.library = sentencepiece.SentencePieceProcessor(
            model_file=public_tokenizers.path(model)
        )
        lib = self.library
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.byte = {}
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if lib.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                self.score[piece], self.id[piece] = lib.get_score(i), i
        self.bytes_of = {i: p.replace(_MARK, " ").encode() for p, i in self.id.items()}
        self.bytes_of |= {i: bytes([b]) for b, i in self.byte.items()}
        # What every id decodes to, one after another; control ids to nothing.
        surface = [self.bytes_of.get(i, b"") for i in range(len(self.pieces))]
        surface[lib.unk_id()] = " \u2047 ".encode()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(x) for x in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if self.merged(piece) == [i]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.runs = spans.RunTable(3_000_000)
        # Whether two bytes may stand side by side in a piece; not known beyond ASCII.
        self.beside = np.ones((256, 256), bool)
        self.beside[:128, :128] = False
        self.beside[:, _SPACE_BYTE] = False
        for piece in self.id:
            plain = piece.replace(_MARK, " ")
            for a, b in zip(plain, plain[1:], strict=False):
                if ord(a) < 128 and ord(b) < 128:
                    self.beside[ord(a), ord(b)] = True

    def merged(self, text: str) -> list[int]:
        """Ids of a short string by merging pairs, the best score first, then the leftmost."""
        parts = list(text)
        while True:
            best = max(
                (
                    (self.score[a + b], -i)
                    for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                    if a + b in self.score
                ),
                default=None,
            )
            if best is None:
                return [self.id.get(p, _UNKNOWN) for p in parts]
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.merged(self.pieces[left] + self.pieces[right]) == [left, right]
            self.fits[key] = known
        return known

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of one chunk, with ``▁`` for spaces."""
        if chunk.startswith(_MARK * 2):
            return self._with_bytes(self._spaces_first(chunk), chunk)
        last = [_UNKNOWN] * len(chunk)
        size = [1] * len(chunk)
        fits, known = self.fits, self._compatible
        done = -1
        for stop, (length, piece) in self.automaton.iter(chunk):
            if stop == done:
                continue
            before = stop - length
            if before >= 0:
                left = last[before]
                if left >= 0 and not (
                    fits[key] if (key := left << 32 | piece) in fits else known(left, piece)
                ):
                    continue
            last[stop], size[stop] = piece, length
            done = stop
        ids = []
        at = len(chunk) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return self._with_bytes(ids, chunk)

    def _spaces_first(self, chunk: str) -> list[int]:
        """A run of spaces and a word: the run's last space belongs to the word if they merge."""
        run = len(chunk) - len(chunk.lstrip(_MARK))
        word = chunk[run:]
        if not word:
            return self._run(run)
        inner = self.encode_chunk(_MARK + word)
        if inner[0] == self.id[_MARK]:
            return self._run(run) + inner[1:]
        return self._run(run - 1) + inner

    def _run(self, n: int) -> list[int]:
        """Spaces alone. All merges score the same, so the leftmost goes first."""
        most = max(len(p) for p in self.id if not p.strip(_MARK))
        # A full run of the longest piece at the left takes part in no further merge.
        full = max(-(-n // most) - 4, 0)
        return [self.id[_MARK * most]] * full + self.merged(_MARK * (n - full * most))

    def _with_bytes(self, ids: list[int], chunk: str) -> list[int]:
        if _UNKNOWN not in ids:
            return ids
        out, at = [], 0
        for i in ids:
            if i == _UNKNOWN:
                out += [self.byte[b] for b in chunk[at].encode()]
                at += 1
            else:
                out.append(i)
                at += len(self.pieces[i])
        return out

    def chunks(self, data: np.ndarray, offsets: np.ndarray):
        """Start, end and row of the chunks that every text falls into."""
        first = np.ones(len(data), bool)
        first[1:] = ~self.beside[data[:-1], data[1:]]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        begin = np.flatnonzero(first)
        return begin, np.append(begin[1:], len(data)), np.searchsorted(offsets, begin, "right") - 1

    def locate(self, data: np.ndarray, offsets: np.ndarray):
        """For each chunk its row and its run of ids; checks that ids give the chunk back."""
        begin, end, row = self.chunks(data, offsets)
        keys, where, which = np.unique(
            spans.span_hashes(data, begin, end, spans.PRIVATE),
            return_index=True,
            return_inverse=True,
        )
        new = self.runs.missing(keys)
        if len(new):
            raw = data.tobytes()
            lengths, values = [], []
            for b, e in zip(begin[where[new]].tolist(), end[where[new]].tolist(), strict=True):
                chunk = raw[b:e]
                ids = self.encode_chunk(chunk.decode().replace(" ", _MARK))
                if b"".join(map(self.bytes_of.__getitem__, ids)) != chunk:
                    raise ValueError(f"the ids of {chunk!r} don't decode to it")
                lengths.append(len(ids))
                values += ids
            self.runs.add(keys[new], np.array(lengths, np.int64), np.array(values, np.uint32))
        start, length = self.runs.find(keys)
        return row, start[which], length[which]


    def decode(self, ids: np.ndarray, stops: np.ndarray) -> list[bytes]:
        """The texts of ids, without the space in front; text ``i`` ends before ``stops[i]``."""
        size = self.surface_size[ids]
        data = self.surface[spans.gather(self.surface_at[ids], size)].tobytes()
        upto = np.concatenate([[0], np.cumsum(size)])
        ends = upto[stops].tolist()
        return [data[a:b].removeprefix(b" ") for a, b in zip([0, *ends], ends, strict=False)]


def with_prefix(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space in front of every text that isn't empty, as the model adds one."""
    raw = data.tobytes()
    mark = _MARK.encode()
    texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    texts = [b" " + t.replace(mark, b" ") if t else t for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), bounds


_tables: dict[str, PieceTable] = {}


def table(model: str = MODEL) -> PieceTable:
    """The table of this worker process; what it has learned serves its later tasks."""
    if model not in _tables:
        _tables[model] = PieceTable(model)
    return _tables[model]


def encode_and_decode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL
) -> DataFrame:
    """Ids of every whole text with begin and end, and the text they decode to.

    Null and empty texts give the begin and end ids and decode to an empty text.
    Rows with equal or null keys are encoded on their own. Other columns aren't read.

    Returns ``key``, ``ids`` (array of int) and ``decoded``.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, rows in _encoded(batches, model):
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                    pa.array([r[1].decode(errors="replace") for r in rows], pa.string()),
                ],
                names=["k", "ids", "decoded"],
            )

    out = docs.select(key, text).mapInArrow(run, f"k {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("k", key)


def digests(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL
) -> DataFrame:
    """``encode_and_decode`` with SHA-256 digests in place of ids and text, and ``n_tokens``.

    Ids are digested as little-endian unsigned 32-bit integers, texts as UTF-8.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, rows in _encoded(batches, model):
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array([len(r[0]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string()),
                    pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()),
                ],
                names=["k", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, text).mapInArrow(run, schema).withColumnRenamed("k", key)


def _encoded(batches: Iterator[pa.RecordBatch], model: str):
    """Keys with the ids and decoded bytes of their texts, slice by slice."""
    own = table(model)
    for batch in batches:
        whole, bounds = spans.utf8(batch.column(1))
        for low, high in spans.slices(bounds):
            part = whole[bounds[low] : bounds[high]]
            data, offsets = with_prefix(part, bounds[low : high + 1] - bounds[low])
            row, start, length = own.locate(data, offsets)
            ids = own.runs.pool[spans.gather(start, length)].astype("<u4")
            sizes = np.bincount(row, length, high - low).astype(np.int64)
            stops = np.cumsum(sizes)
            full = [
                np.concatenate([[own.begin], ids[b - n : b], [own.end]]).astype("<u4")
                for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)
            ]
            # The very ids that are returned, with two more a text.
            texts = own.decode(np.concatenate(full), stops + 2 * np.arange(1, len(full) + 1))
            rows = list(zip(full, texts, strict=True))
            yield batch.column(0).slice(low, high - low), rows

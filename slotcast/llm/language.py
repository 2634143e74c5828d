"""Language identification by cross-parsing with suffix automata."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.llm import letters, spans

UNKNOWN = "und"
_EDGE = " "


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the start."""
    moves: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            old = moves[at][c]
            if size[old] == size[at] + 1:
                link[new] = old
            else:
                copy = len(moves)
                moves.append(dict(moves[old]))
                size.append(size[at] + 1)
                link.append(link[old])
                while at >= 0 and moves[at].get(c) == old:
                    moves[at][c] = copy
                    at = link[at]
                link[old] = link[new] = copy
        last = new
    return moves


class Parser:
    """Automata of all languages as one table of transitions."""

    def __init__(self, references: dict[str, str]):
        self.languages = sorted(references)
        signs = sorted({c for text in references.values() for c in text} | {_EDGE})
        self.symbol = np.zeros(0x110000, np.int32)
        for i, c in enumerate(signs):
            self.symbol[ord(c)] = i + 1
        # Marks at a word's ends, as ``letters.flat`` sets them.
        self.symbol[[1, 2]] = self.symbol[ord(_EDGE)]
        self.width = len(signs) + 1
        tables, self.start, base = [], [], 0
        for language in self.languages:
            moves = automaton(references[language])
            table = np.full((len(moves), self.width), -1, np.int32)
            for state, out in enumerate(moves):
                for c, to in out.items():
                    table[state, self.symbol[ord(c)]] = base + to
            tables.append(table)
            self.start.append(base)
            base += len(moves)
        empty = np.zeros((0, self.width), np.int32)
        self.table = np.concatenate([empty, *tables]).ravel()

    def phrases(self, words: letters.Words) -> np.ndarray:
        """For each distinct word and language the number of phrases of its parse.

        A phrase is the longest part from where the last one ended that occurs in the
        language's text. All words are read in step, a letter at a time.
        """
        codes, begin = letters.flat(words)
        symbols = self.symbol[codes.astype(np.int64)].astype(np.int64)
        size = np.diff(begin)
        order = np.argsort(-size, kind="stable")
        first, size = begin[:-1][order], size[order]
        root = np.tile(np.array(self.start, np.int64), (len(order), 1))
        state = root.copy()
        count = np.zeros(root.shape, np.int64)
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i, "left"))  # words longer than i
            sign = symbols[first[:n] + i][:, None]
            now, base = state[:n], root[:n]
            to = self.table[now * self.width + sign]
            fresh = (now == base) | (to < 0)
            count[:n] += fresh
            again = self.table[base * self.width + sign]
            to = np.where(to < 0, again, to)
            state[:n] = np.where(to < 0, base, to)
        out = np.empty_like(count)
        out[order] = count
        return out


_parsers: dict[int, Parser] = {}


def _parser(references: dict[str, str]) -> Parser:
    key = hash(tuple(sorted(references.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(references)
    return _parsers[key]


def references(
    docs: DataFrame,
    learn: Column,
    text: str = "text",
    language: str = "lang",
    sample_docs: int = 64,
    longest: int = 20_000,
    letters_each: int = 40_000,
) -> dict[str, str]:
    """A text of known words per language, the same size for each.

    The sample is bounded: of the texts of at most ``longest`` characters with a language
    where ``learn`` holds, the ``sample_docs`` whose hashes are smallest, equal texts once. Of
    their words the ones in most of these texts are kept, up to ``letters_each`` letters.
    """
    known = docs.filter(
        learn & F.col(language).isNotNull() & F.length(text).between(1, longest)
    ).select(F.col(language).alias("l"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    smallest = known.select("l", "h").distinct().withColumn("rank", rank)
    smallest = smallest.filter(F.col("rank") <= sample_docs).select("l", "h")
    # At most sample_docs rows for each language.
    rows = known.join(F.broadcast(smallest), ["l", "h"]).dropDuplicates(["l", "h"]).collect()
    counts: dict[str, dict[str, int]] = {}
    for row in rows:
        own = counts.setdefault(row["l"], {})
        for word in letters.words(pa.array([row["t"]], pa.string())).strings():
            own[word] = own.get(word, 0) + 1
    out = {}
    for name, own in counts.items():
        text_of, used = [], 0
        for word in sorted(own, key=lambda w: (-own[w], w)):
            if used + len(word) > letters_each:
                break
            text_of.append(word)
            used += len(word)
        if text_of:
            out[name] = _EDGE + _EDGE.join(text_of) + _EDGE
    return out


def predict(
    docs: DataFrame, texts: dict[str, str], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The language that needs fewest phrases per letter for a whole text.

    Words are maximal runs of letters in lower case, with an edge in front and behind; phrases
    end with their word, so each distinct word of a batch is parsed once. Ties go
    to the language that comes first in order. Null texts and texts without a letter are
    ``und`` with score 0. Rows with equal or null keys are judged on their own.

    Returns ``key``, ``lang_pred`` and ``score``: the share of the runner-up's phrases in both
    counts, from 0.5 for a tie up to 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        names = np.array([*parser.languages, UNKNOWN], object)
        for batch in batches:
            _, offsets = spans.utf8(batch.column(1))
            for low, high in spans.slices(offsets):
                rows = high - low
                words = letters.words(batch.column(1).slice(low, rows))
                each = parser.phrases(words)[words.which]
                total = np.zeros((rows, len(parser.languages) + 1))
                for i in range(len(parser.languages)):
                    total[:, i] = np.bincount(words.row, each[:, i], rows)
                total[:, -1] = np.inf
                best = np.argmin(total, axis=1)
                two = np.sort(total, axis=1)[:, :2] if len(parser.languages) else total
                none = np.bincount(words.row, minlength=rows) == 0
                best[none] = len(parser.languages)
                with np.errstate(invalid="ignore"):
                    score = np.where(
                        np.isinf(two[:, -1]), 1.0, two[:, -1] / (two[:, 0] + two[:, -1])
                    )
                score[best == len(parser.languages)] = 0.0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, rows),
                        pa.array(names[best].tolist(), pa.string()),
                        pa.array(score),
                    ],
                    names=["k", "lang_pred", "score"],
                )

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInArrow(run, f"k {kind}, lang_pred string, score double")
    return out.withColumnRenamed("k", key)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang"):
    """Predict all documents, learning only from keys whose ``crc32`` modulo 4 isn't 2.

    Returns ``key``, ``held_out``, ``lang_pred`` and ``score``. Null keys aren't learned from.
    """
    part = F.crc32(F.col(key).cast("string")) % 4
    texts = references(docs, part != 2, text, language)
    held_out = F.coalesce(part == 2, F.lit(False)).alias("held_out")
    return predict(docs, texts, key, text).select(key, held_out, "lang_pred", "score")

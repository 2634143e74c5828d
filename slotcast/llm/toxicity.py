"""Toxicity by class-conditional Kneser-Ney models of the letters in words."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slotcast.llm import letters, spans
from slotcast.sources.storage import materialize

#: Letters of the longest n-grams, with the one that is predicted.
ORDER = 5
_DISCOUNT = 0.9
#: Size of the alphabet in the uniform distribution that ends the backoff.
_ALPHABET = 100
#: The words whose ratios decide a text.
TELLING = 2
#: Parts of words tell something from this ratio on.
_LEAST = 2.0
#: Bytes of text, or different n-grams and contexts, that share one look-up.
_UNIT = 32 << 20
_UNIT_ENTRIES = 1 << 20
#: Words that are rated at a time.
_BLOCK = 1 << 14


def fold(key: Column, folds: int = 5) -> Column:
    """``crc32`` of the key as text, modulo ``folds``; null for null keys."""
    return F.crc32(key.cast("string")) % folds


@dataclass(frozen=True)
class Entries:
    """Log ratios of toxic to ordinary likelihood of n-grams, and of their contexts' backoff.

    Those that some texts need, by sorted 64-bit hashes.
    """

    grams: np.ndarray
    gram_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray


@dataclass(frozen=True)
class Model:
    """All ratios of n-grams and contexts, as a table of ``far``, ``entry`` and ``ratio``.

    ``entry`` is the hash of an n-gram, or of a context where ``far`` holds. The table grows
    with the texts it was learned from and is only joined. ``weights`` and ``intercept`` turn
    a text's measures into log odds; there are none if there is nothing to learn from.
    """

    ratios: DataFrame
    weights: tuple[float, ...] = ()
    intercept: float = 0.0

    def entries(self, words: letters.Words) -> Entries:
        """What the given words need of the table, on the driver."""
        wanted = self.ratios.sparkSession.createDataFrame(
            pa.table(dict(zip(("far", "entry"), _wanted(_needed(words)), strict=True)))
        )
        found = self.ratios.join(wanted, ["far", "entry"]).select("far", "entry", "ratio").toArrow()
        return _entries(*[np.asarray(c.combine_chunks()) for c in found.columns])


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray):
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return np.where(found, values[at], 0.0), found


def _hashes(codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the context of every code, at most ``ORDER - 1`` codes of its word, and with it."""
    depth = np.arange(len(codes)) - np.repeat(begin[:-1], np.diff(begin))
    context = np.zeros(len(codes), np.uint64)
    for back in range(1, ORDER):
        step = np.zeros(len(codes), np.uint64)
        step[back:] = codes[:-back]
        context = np.where(depth >= back, spans.mix(context * np.uint64(31) + step), context)
    return context, spans.mix(context ^ spans.mix(codes))


def _needed(words: letters.Words) -> list[np.ndarray]:
    """Distinct hashes of the words' n-grams and of their contexts."""
    codes, begin = letters.flat(words)
    inner = np.ones(len(codes), bool)
    inner[begin[:-1]] = False
    context, gram = _hashes(codes, begin)
    return [np.unique(gram[inner]), np.unique(context[inner])]


def _wanted(needed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``far`` and ``entry`` of the hashes of n-grams and contexts."""
    return np.repeat([False, True], [len(n) for n in needed]), np.concatenate(needed).view(np.int64)


def _entries(far: np.ndarray, entry: np.ndarray, ratio: np.ndarray) -> Entries:
    far, keys = far.astype(bool), entry.astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    own, context = order[~far[order]], order[far[order]]
    return Entries(keys[own], ratio[own], keys[context], ratio[context])


def word_ratios(
    words: letters.Words, model: Model | Entries
) -> tuple[np.ndarray, np.ndarray]:
    """Log of toxic to ordinary likelihood of each distinct word, and of its most telling part."""
    entries = model.entries(words) if isinstance(model, Model) else model
    codes, begin = letters.flat(words)
    context, gram = _hashes(codes, begin)
    ratio, seen = _look_up(entries.grams, entries.gram_ratio, gram)
    backoff, _ = _look_up(entries.contexts, entries.context_ratio, context)
    each = np.where(seen, ratio, backoff)
    each[begin[:-1]] = 0.0  # the mark at the begin isn't predicted
    if len(begin) < 2:
        return np.zeros(0), np.zeros(0)
    sums = np.cumsum(each)
    sums -= np.repeat(sums[begin[:-1]], np.diff(begin))
    # The largest rise of the sum within a word; a step down keeps words apart.
    down = np.repeat(np.arange(len(begin) - 1) * -1e6, np.diff(begin))
    rise = sums + down - np.minimum.accumulate(sums + down)
    return np.add.reduceat(each, begin[:-1]), np.maximum.reduceat(rise, begin[:-1])


@dataclass(frozen=True)
class Bags:
    """The words of some texts, without their order: ``row``, ``word`` and how often it stands there.

    Rows ascend, and words within a row.
    """

    row: np.ndarray
    word: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(words: letters.Words, number: np.ndarray) -> "Bags":
        """Bags of texts whose distinct words have the given numbers."""
        word = number[words.which]
        order = np.lexsort((word, words.row))
        row, word = words.row[order], word[order]
        first = np.ones(len(row), bool)
        first[1:] = (np.diff(row) != 0) | (np.diff(word) != 0)
        at = np.flatnonzero(first)
        return Bags(row[at], word[at], np.diff(at, append=len(row)))

    def columns(self, rows: int) -> list[pa.Array]:
        """A list per text of each of the words' steps, in two parts, and of the times.

        Parts of small numbers take little space when they are compressed.
        """
        step = np.diff(self.word, prepend=0)
        first = np.ones(len(step), bool)
        first[1:] = np.diff(self.row) != 0
        step[first] = self.word[first]
        offsets = pa.array(np.searchsorted(self.row, np.arange(rows + 1)), pa.int64())
        low, high = (step & 255).astype(np.uint8), (step >> 8).astype(np.int32)
        parts = [pa.array(low), pa.array(high), pa.array(self.times.astype(np.int32))]
        return [pa.LargeListArray.from_arrays(offsets, p) for p in parts]

    @staticmethod
    def read(columns: list[pa.Array]) -> "Bags":
        low, high, times = (np.asarray(c.flatten()).astype(np.int64) for c in columns)
        size = np.diff(np.asarray(columns[0].offsets))
        stop = np.cumsum(size)
        sums = np.concatenate([[0], np.cumsum(low + (high << 8))])
        word = sums[1:] - np.repeat(sums[stop - size], size)
        return Bags(np.repeat(np.arange(len(size)), size), word, times)


def _measures(bags: Bags, each: np.ndarray, part: np.ndarray, size: np.ndarray, rows: int):
    """Four ratios of each text, a column each, from the ratios, telling parts and sizes of words.

    Per word of its most telling words; per letter of the whole text; over the square
    root of the letters, which is the size chance gives to the sum; and in the same way of
    the telling parts of its words.
    """
    row, times, ratio = bags.row, bags.times, each[bags.word]
    total = np.bincount(row, times * ratio, rows)
    count = np.maximum(np.bincount(row, times * (size[bags.word] + 1), rows), 1)
    n = np.bincount(row, times, rows)
    order = np.lexsort((-ratio, row))
    top, copies = row[order], times[order]
    before = np.cumsum(copies) - copies - (np.cumsum(n) - n)[top]
    copies = np.clip(TELLING - before, 0, copies)
    peak = np.bincount(top, copies * ratio[order], rows) / TELLING
    telling = np.bincount(row, times * np.maximum(part - _LEAST, 0)[bags.word], rows)
    telling /= np.sqrt(np.maximum(n, 1))
    peak = np.clip(peak, -10, 30)
    return np.stack([peak, total / count, total / np.sqrt(count), telling], axis=1)


def _probability(measures: np.ndarray, weights: tuple[float, ...], intercept: float) -> np.ndarray:
    if not weights:
        return np.zeros(len(measures))
    odds = measures @ np.array(weights) + intercept
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _word_counts(labelled: DataFrame) -> DataFrame:
    """``word``, and how often it stands in ordinary and in toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def rows() -> pa.RecordBatch:
            both = np.array(list(counts.values()), np.int64).reshape(-1, 2)
            columns = [pa.array(list(counts), pa.string()), *map(pa.array, both.T)]
            return pa.RecordBatch.from_arrays(columns, names=["word", "c0", "c1"])

        for batch in batches:
            toxic = np.asarray(batch.column(1)).astype(np.int64)
            _, offsets = spans.utf8(batch.column(0))
            for low, high in spans.slices(offsets):
                words = letters.words(batch.column(0).slice(low, high - low))
                kind = toxic[low:high][words.row]
                both = np.bincount(2 * words.which + kind, minlength=2 * len(words.start))
                for word, new in zip(words.strings(), both.reshape(-1, 2).tolist(), strict=True):
                    old = counts.get(word)
                    if old is None:
                        counts[word] = new
                    else:
                        old[0] += new[0]
                        old[1] += new[1]
                if len(counts) > 300_000:
                    yield rows()
                    counts.clear()
        yield rows()

    found = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(
        run, "word string, c0 long, c1 long"
    )
    return found.groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _grams(words: DataFrame) -> DataFrame:
    """Counts of the n-grams that predict each letter of a word and its end, in both classes."""
    marked = words.withColumn("w", F.concat(F.lit("\x01"), "word", F.lit("\x02")))
    stop = F.explode(F.sequence(F.lit(2), F.length("w"))).alias("stop")
    first = F.greatest(F.col("stop") - ORDER + 1, F.lit(1))
    cut = marked.select("w", "c0", "c1", stop).select(
        F.substring(F.col("w"), first, F.col("stop") - first + 1).alias("g"), "c0", "c1"
    )
    return cut.groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _head(column: str) -> Column:
    return F.expr(f"substring({column}, 1, length({column}) - 1)")


def _tail(column: str) -> Column:
    return F.expr(f"substring({column}, 2)")


def _shared(grams: DataFrame) -> DataFrame:
    """The backoff that both classes share: ``x`` and ``p``, its last letter given the others.

    Kneser-Ney: counts are numbers of different n-grams that end in ``x``, of either
    class, interpolated with the next shorter ``x`` down to a uniform distribution.
    """
    level, counted = grams.select(F.col("g").alias("x")), None
    for _ in range(ORDER - 1):
        level = level.filter(F.length("x") > 1).groupBy(_tail("x").alias("x")).agg(
            F.count("*").alias("n")
        )
        counted = level if counted is None else counted.unionByName(level)
    counted = materialize(counted.groupBy("x").agg(F.sum("n").alias("n")), "continuations")
    totals = counted.groupBy(_head("x").alias("h")).agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds")
    )
    own = materialize(
        counted.join(totals, _head("x") == F.col("h")).select(
            "x",
            ((F.col("n") - _DISCOUNT) / F.col("total")).alias("direct"),
            (_DISCOUNT * F.col("kinds") / F.col("total")).alias("backoff"),
        ),
        "backoff",
    )
    size = F.length("x")
    level = own.filter(size == 1).select(
        "x", (F.col("direct") + F.col("backoff") / _ALPHABET).alias("p")
    )
    every = level
    for n in range(2, ORDER):
        shorter = level.select(F.col("x").alias("y"), F.col("p").alias("q"))
        level = (
            own.filter(size == n)
            .join(shorter, _tail("x") == F.col("y"), "left")
            .select(
                "x",
                (F.col("direct") + F.col("backoff") * F.coalesce("q", F.lit(1 / _ALPHABET))).alias("p"),
            )
        )
        every = every.unionByName(level)
    return materialize(every, "shared-backoff")


def _ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log ratios of the n-grams and of the contexts' backoff weights."""
    contexts = materialize(
        grams.groupBy(_head("g").alias("h")).agg(
            *[F.sum(f"c{k}").alias(f"n{k}") for k in (0, 1)],
            *[F.count_if(F.col(f"c{k}") > 0).alias(f"t{k}") for k in (0, 1)],
        ),
        "contexts",
    )

    def backoff(k: int) -> Column:
        weight = _DISCOUNT * F.col(f"t{k}") / F.col(f"n{k}")
        return F.when(F.col(f"n{k}") > 0, weight).otherwise(F.lit(1.0))

    def chance(k: int) -> Column:
        direct = F.greatest(F.col(f"c{k}") - _DISCOUNT, F.lit(0.0)) / F.col(f"n{k}")
        return F.when(F.col(f"n{k}") > 0, direct + backoff(k) * F.col("p")).otherwise(F.col("p"))

    joined = grams.join(contexts, _head("g") == F.col("h")).join(
        _shared(grams), _tail("g") == F.col("x")
    )
    ratio = F.log(chance(1) / chance(0))
    own = joined.select("g", ratio.alias("ratio"))
    ratio = F.log(backoff(1) / backoff(0))
    return own, contexts.select(F.col("h").alias("g"), ratio.alias("ratio"))


def _hashed(rows: DataFrame, far: bool) -> DataFrame:
    """``far``, ``entry`` and ``ratio`` of n-grams, or of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            texts = [g + "?" if far else g for g in batch.column(0).to_pylist()]
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
            begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            context, gram = _hashes(codes, begin)
            keys = (context if far else gram)[begin[1:] - 1]
            columns = [np.full(len(keys), far), keys.view(np.int64)]
            ratio = np.asarray(batch.column(1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.array(ratio)], names=["far", "entry", "ratio"]
            )

    return rows.select("g", "ratio").mapInArrow(run, "far boolean, entry long, ratio float")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    tune: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Model:
    """Learn n-grams from labelled texts where ``learn`` holds; weigh the measures by those of ``tune``.

    Every n-gram of every text that may be learned from is counted. Both classes discount
    their counts and back off to one distribution, made of the counts of both, so a rare
    expression says little about a class. All ratios stay in a table.
    """
    # Only the driver needs these; workers that import this module do without their 30 MB.
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    known = (
        labels.filter(F.col(label).isNotNull())
        .groupBy(F.col(key).alias("k"))
        .agg(F.max(label).alias("toxic"))
        .select("k", (F.col("toxic") > 0).alias("toxic"))
    )
    chosen = docs.filter(learn & F.col(text).isNotNull()).select(
        F.col(key).alias("k"), F.col(text).alias("text")
    )
    # Labels grow with the documents, so they are never broadcast, however few there are.
    words = materialize(_word_counts(chosen.join(known.hint("merge"), "k")), "word-counts")
    grams = materialize(_grams(words), "grams")
    own, far = _ratios(grams)
    model = Model(materialize(_hashed(own, False).unionByName(_hashed(far, True)), "ratios"))
    rows = _measured(docs.filter(tune & F.col(text).isNotNull()), key, text, model).join(known, "k")
    rows = materialize(
        rows.select(array_to_vector("measures").alias("features"), F.col("toxic").cast("double")),
        "measured",
    )
    if rows.select("toxic").distinct().count() < 2:
        return model
    fitted = LogisticRegression(labelCol="toxic", regParam=1e-3, maxIter=50).fit(rows)
    return replace(model, weights=tuple(fitted.coefficients), intercept=fitted.intercept)


class _Lexicon:
    """The distinct words of a unit, numbered as they come, and the entries they need."""

    def __init__(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.number = np.zeros(0, np.int64)
        self.needed = [np.zeros(0, np.uint64)] * 2
        self.texts: list[str] = []
        self.sizes: list[np.ndarray] = []

    def add(self, words: letters.Words) -> np.ndarray:
        """Numbers of the distinct words."""
        at = np.searchsorted(self.key, words.key)
        known = at < len(self.key)
        known[known] = self.key[at[known]] == words.key[known]
        new = np.flatnonzero(~known)
        number = np.empty(len(known), np.int64)
        number[known] = self.number[at[known]]
        # Words that stand early are likely to be common and get small numbers.
        new_by_place = new[np.argsort(words.start[new])]
        number[new_by_place] = len(self.key) + np.arange(len(new))
        self.key = np.insert(self.key, at[new], words.key[new])
        self.number = np.insert(self.number, at[new], number[new])
        if len(new):
            added = letters.some(words, new_by_place)
            needed = _needed(added)
            self.needed = [np.union1d(a, b) for a, b in zip(self.needed, needed, strict=True)]
            text, size = letters.packed(added)
            self.texts.append(text)
            self.sizes.append(size)
        return number

    def batch(self) -> pa.RecordBatch:
        size = np.concatenate([np.zeros(0, np.int64), *self.sizes]).astype(np.int32)
        columns = [pa.array(["".join(self.texts)], pa.large_string()), pa.array([size])]
        return pa.RecordBatch.from_arrays(columns, names=["text", "size"])


def _compressed(batch: pa.RecordBatch) -> bytes:
    sink, options = pa.BufferOutputStream(), pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


#: What a row of a unit holds: an entry, all its words, or some rows with their bags of words.
_ENTRY, _LEXICON, _ROWS = range(3)


def _in_units(docs: DataFrame, text: str, keep: list[int]) -> DataFrame:
    """The entries that each ``unit`` needs, its words, and its rows with their bags of words.

    A unit is some texts of one task: about ``_UNIT`` bytes, or fewer with ``_UNIT_ENTRIES``
    entries, or one longer text. Of the rows it has the columns ``keep``.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, size, lexicon = TaskContext.get().partitionId() << 32, 0, _Lexicon()

        def out(kind: int, far: pa.Array, entry: pa.Array, rows: pa.Array) -> pa.RecordBatch:
            own = [pa.array(np.full(len(far), unit)), pa.array(np.full(len(far), kind, np.int32))]
            names = ["unit", "kind", "far", "entry", "rows"]
            return pa.RecordBatch.from_arrays([*own, far, entry, rows], names=names)

        def one(kind: int, batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = pa.array([_compressed(batch)], pa.binary())
            return out(kind, pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), rows)

        def end() -> Iterator[pa.RecordBatch]:
            yield one(_LEXICON, lexicon.batch())
            far, entry = map(pa.array, _wanted(lexicon.needed))
            yield out(_ENTRY, far, entry, pa.nulls(len(far), pa.binary()))

        for batch in batches:
            _, offsets = spans.utf8(batch.column(at))
            for low, high in spans.slices(offsets):
                part = batch.slice(low, high - low)
                words = letters.words(part.column(at))
                bags = Bags.of(words, lexicon.add(words)).columns(len(part))
                columns = [*(part.column(i) for i in keep), *bags]
                yield one(_ROWS, pa.RecordBatch.from_arrays(columns, names=[*map(str, range(len(columns)))]))
                size += int(offsets[high] - offsets[low]) + 8 * len(part)
                if size >= _UNIT or sum(map(len, lexicon.needed)) >= _UNIT_ENTRIES:
                    yield from end()
                    unit, size, lexicon = unit + 1, 0, _Lexicon()
        if size:
            yield from end()

    return docs.mapInArrow(run, "unit long, kind int, far boolean, entry long, rows binary")


def _with_measures(
    docs: DataFrame,
    text: str,
    keep: list[str],
    model: Model,
    result: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch],
    schema: str | StructType,
) -> DataFrame:
    """``result`` of the columns ``keep`` and the measures of the texts.

    Bags of words go to the task that gets the ratios their unit needs, and texts only if they
    are kept. An n-gram is asked for once a unit, so common ones are as rare in the join as
    others.
    """
    units = materialize(_in_units(docs, text, [docs.columns.index(c) for c in keep]), "units")
    wanted = units.filter(F.col("kind") == _ENTRY).select("unit", "far", "entry")
    # The table grows with the documents, so it is never broadcast, however small it is.
    found = wanted.join(model.ratios.hint("merge"), ["far", "entry"]).select(
        "unit", F.lit(_ENTRY).alias("kind"), "far", "entry", "ratio", F.lit(None).cast("binary").alias("rows")
    )
    rows = units.filter(F.col("kind") != _ENTRY).select(
        "unit", "kind", "far", "entry", F.lit(None).cast("float").alias("ratio"), "rows"
    )

    def opened(rows: pa.Array) -> Iterator[pa.RecordBatch]:
        for packed in rows:
            with pa.ipc.open_stream(packed.as_buffer()) as reader:
                yield from reader

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts, ratios = None, [], ()
        for batch in batches:
            units, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            change = np.flatnonzero((np.diff(units) != 0) | (np.diff(kinds) != 0)) + 1
            edges = [0, *change.tolist(), len(batch)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if units[a] != unit:
                    unit, parts = units[a], []
                if kinds[a] == _ENTRY:
                    parts.append([np.asarray(part.column(i)) for i in (2, 3, 4)])
                    continue
                if kinds[a] == _LEXICON:
                    none = [np.zeros(0, t) for t in (bool, np.int64, np.float32)]
                    entries = _entries(*map(np.concatenate, zip(none, *parts, strict=True)))
                    (lexicon,) = opened(part.column(5))
                    size = np.asarray(lexicon.column(1).flatten()).astype(np.int64)
                    words = letters.unpacked(lexicon.column(0)[0].as_py(), size)
                    blocks = [
                        word_ratios(letters.some(words, np.arange(a, min(a + _BLOCK, len(size)))), entries)
                        for a in range(0, len(size), _BLOCK)
                    ]
                    each, telling = map(np.concatenate, zip((np.zeros(0),) * 2, *blocks, strict=True))
                    ratios, parts = (each, telling, size), []
                    continue
                for own in opened(part.column(5)):
                    measures = _measures(Bags.read(own.columns[-3:]), *ratios, len(own))
                    columns = pa.RecordBatch.from_arrays(own.columns[:-3], names=keep)
                    yield result(columns, measures)

    dealt = found.unionByName(rows).repartition("unit").sortWithinPartitions("unit", "kind")
    return dealt.mapInArrow(run, schema)


def _measured(docs: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    def result(rows: pa.RecordBatch, measures: np.ndarray) -> pa.RecordBatch:
        lists = pa.array(list(measures), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([rows.column(0), lists], names=["k", "measures"])

    schema = f"k {docs.schema[key].dataType.simpleString()}, measures array<double>"
    return _with_measures(docs.select(key, text), text, [key], model, result, schema)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text: ``key``, ``score``, ``predicted`` and ``ratio``.

    ``score`` is the chance that the measures' log odds give; ``ratio`` is the difference of
    the two log-likelihoods per letter over the whole text.
    Null and empty texts, having no words, score like a text without telling words.
    """
    weights, intercept = model.weights, model.intercept

    def result(rows: pa.RecordBatch, measures: np.ndarray) -> pa.RecordBatch:
        scores = _probability(measures, weights, intercept)
        return pa.RecordBatch.from_arrays(
            [
                rows.column(0),
                pa.array(scores),
                pa.array((scores >= 0.5).astype(np.int32)),
                pa.array(measures[:, 1]),
            ],
            names=["k", "score", "predicted", "ratio"],
        )

    schema = f"k {docs.schema[key].dataType.simpleString()}, score double, predicted int, ratio double"
    found = _with_measures(docs.select(key, text), text, [key], model, result, schema)
    return found.withColumnRenamed("k", key)


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that aren't toxic, with all their columns."""
    weights, intercept = model.weights, model.intercept

    def result(rows: pa.RecordBatch, measures: np.ndarray) -> pa.RecordBatch:
        return rows.filter(pa.array(_probability(measures, weights, intercept) < 0.5))

    return _with_measures(docs, text, docs.columns, model, result, docs.schema)


def judge(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Score all documents, learning only from keys whose ``fold`` isn't 0.

    Rows with null keys aren't learned from. Without labels of both classes every score is 0.
    Returns ``key``, ``held_out``, ``score``, ``predicted`` and ``ratio``.
    """
    part = fold(F.col(key))
    model = fit(docs, labels, part.isin(1, 2, 3), part == 4, key, text)
    out = score(docs, model, key, text)
    return out.select(
        key, F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", "predicted", "ratio"
    )

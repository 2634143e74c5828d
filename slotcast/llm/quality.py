"""Quality rules whose thresholds follow the documents of a language and source."""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.llm import spans
from slotcast.sources.storage import materialize

#: Counts of a text that the measures are built from.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WINDOW = 5


def _repeated(ids: np.ndarray) -> np.ndarray:
    """Which words lie in a window of five that occurs twice or more. ``ids`` count from 0."""
    n = len(ids) - _WINDOW + 1
    marked = np.zeros(len(ids), bool)
    if n < 2:
        return marked
    # Ranks of 2, 4 and 5 words, each from pairs of ranks of fewer.
    base = int(ids.max()) + 1
    two = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * (int(two.max()) + 1) + two[2:], return_inverse=True)[1]
    five = four[:n] * base + ids[_WINDOW - 1 :]
    _, which, count = np.unique(five, return_inverse=True, return_counts=True)
    if len(count) == n:
        return marked
    edge = np.zeros(len(ids) + 1, np.int64)
    begin = np.flatnonzero(count[which] > 1)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + _WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    rows = len(offsets) - 1
    n_lines = np.ones(rows, np.int64)
    start, end, row = spans.words(data, offsets)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    signs = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    n_words = np.bincount(row, minlength=rows)
    word_chars = np.bincount(row, chars[end] - chars[start], rows).astype(np.int64)
    n_symbols = signs[offsets[1:]] - signs[offsets[:-1]]
    # Words as small numbers, the same for equal words.
    _, ids = np.unique(spans.span_hashes(data, start, end), return_inverse=True)
    repeat, dup = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    stops = np.cumsum(n_words)
    for i in np.flatnonzero(n_words >= _WINDOW + 1).tolist():
        repeat[i] = _repeated(ids[stops[i] - n_words[i] : stops[i]]).sum()
    breaks = np.flatnonzero(data == 10)
    lines = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=rows)
    raw = data.tobytes()
    for i in np.flatnonzero(lines).tolist():
        own = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.split()]
        dup[i] = len(own) - len(set(own))
        n_lines[i] = max(len(own), 1)
    return [n_words, word_chars, n_symbols, dup, repeat, n_lines]


def text_counts(docs: DataFrame, text: str) -> DataFrame:
    """All columns, and the counts of every whole text. Names of counts must be free."""
    at, names = docs.columns.index(text), docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema += "".join(f", {c} long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = spans.utf8(batch.column(at))
            parts = [
                _counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for a, b in spans.slices(offsets)
            ]
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else []
            columns = columns or [np.zeros(0, np.int64)] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c.astype(np.int64)) for c in columns]],
                names=[*names, *COUNTS],
            )

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Measure:
    """A whole number per document; ``floor`` is the width below which groups count as even.

    ``low`` also rejects documents far below their group.
    """

    name: str
    expression: str
    floor: int
    low: bool = False


#: Thousandths per word or line; every text that passes the base rules has ten words. Three floors
#: lie within what the base rules pass, 200 repeats and 1000 lines, so each rule can reject.
MEASURES = [
    Measure("symbols", "1000 * n_symbols div n_words", 100),
    Measure("word_length", "1000 * word_chars div n_words", 400, low=True),
    Measure("repeats", "1000 * n_repeat_words div n_words", 50),
    Measure("dup_lines", "1000 * n_dup_lines div n_lines", 100),
]

#: Buckets of a sketch: exact below 64, then 64 to a power of two, so within 1/64 of a value.
_EXACT = 64


def bucket(value: Column) -> Column:
    """The lower bound of the bucket that a non-negative whole number falls into."""
    shift = F.greatest(F.length(F.bin(value)) - _EXACT.bit_length(), F.lit(0))
    width = F.element_at(F.array(*[F.lit(1 << i) for i in range(58)]), shift + 1)
    return value - value % width


def sketches(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Mergeable quantile sketches: how many documents of a group fall into each bucket.

    Two sketches merge by adding their counts, so tasks build partial ones and coarser
    groups are merged from finer. A group has at most a few thousand buckets.
    """
    measures = F.explode(
        F.array(
            *[
                F.struct(F.lit(m.name).alias("measure"), bucket(F.expr(m.expression)).alias("bucket"))
                for m in MEASURES
            ]
        )
    )
    long = rows.select(*groups, measures.alias("m")).select(*groups, "m.measure", "m.bucket")
    return long.groupBy(*groups, "measure", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """For each group and measure its number of documents and its quartiles, low and high."""
    by = [*groups, "measure"]
    ordered = Window.partitionBy(*by).orderBy("bucket")
    ranked = sketch.withColumn("upto", F.sum("n").over(ordered)).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*by))
    )
    return ranked.groupBy(*by).agg(
        F.max("total").alias("n"),
        *[
            F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * share), F.col("bucket"))).alias(name)
            for name, share in (("low", 0.25), ("high", 0.75))
        ],
    )


def _fences(found: DataFrame, groups: list[str], reach: int, least: int) -> DataFrame:
    """One row per group with the limits of every measure; small groups have none."""
    found = found.filter(F.col("n") >= least)
    out = []
    for m in MEASURES:
        own = F.col("measure") == m.name
        width = F.greatest(F.col("high") - F.col("low"), F.lit(m.floor))
        out.append(F.max(F.when(own, F.col("high") + reach * width)).alias(f"{m.name}_most"))
        out.append(F.max(F.when(own, F.col("low") - reach * width)).alias(f"{m.name}_least"))
    return found.groupBy(*groups).agg(*out) if groups else found.agg(*out)


@dataclass(frozen=True)
class Limits:
    """Limits of each language and source, of each language, and of all documents."""

    own: DataFrame
    wide: DataFrame
    overall: dict[str, int | None]


def _with_base(counted: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _limits(rows: DataFrame, reach: int, least: int) -> Limits:
    """Limits from the counts of documents with language ``l`` and source ``s``."""
    fine = materialize(sketches(rows.filter(~F.col("base_failed")), ["l", "s"]), "sketches")

    def fences(groups: list[str], name: str) -> DataFrame:
        merged = fine.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))
        found = _fences(quantiles(merged, groups), groups, reach, least)
        return found.withColumnsRenamed({c: f"{name}_{c}" for c in found.columns})

    own = materialize(fences(["l", "s"], "own"), "limits")
    return Limits(own, materialize(fences(["l"], "wide"), "limits"), fences([], "all").first().asDict())


def _judged(rows: DataFrame, limits: Limits) -> DataFrame:
    """The rows with ``kept``."""
    joined = rows
    for name, groups, fence in (("own", "ls", limits.own), ("wide", "l", limits.wide)):
        on = [rows[g].eqNullSafe(fence[f"{name}_{g}"]) for g in groups]
        joined = joined.join(fence, reduce(lambda a, b: a & b, on), "left")
    passed = F.lit(True)
    for m in MEASURES:
        for side in ("most", "least") if m.low else ("most",):
            levels = [F.col(f"own_{m.name}_{side}"), F.col(f"wide_{m.name}_{side}")]
            limit = F.coalesce(*levels, F.lit(limits.overall[f"all_{m.name}_{side}"]).cast("long"))
            value = F.expr(m.expression)
            inside = value <= limit if side == "most" else value >= limit
            passed = passed & F.coalesce(inside, F.lit(True))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(passed)
    return joined.withColumn("kept", kept)


def judge(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    source: str = "source",
    reach: int = 3,
    least: int = 200,
) -> DataFrame:
    """Base rules on every whole text, then limits learned from its language and source.

    Documents that pass the base rules (ten words, at most a fifth of them in repeated
    windows of five) are summed up in one mergeable quantile sketch per language and source, whose
    counts also merge into a sketch per language and one of all. A measure's limits are the
    quartiles, each moved out by ``reach`` times their distance (or its floor, if
    that is larger). A document is rejected beyond a limit of its group, or of the
    next larger one if its own has fewer than ``least`` documents; where even all are fewer,
    only the base rules hold.

    Null and empty texts have no words and fail the base rules. A null language or source is a
    group of its own. Rows with equal or null keys are judged on their own, extra columns
    aren't read, and an empty table gives no rows.

    Returns ``key``, the counts, ``base_failed`` and ``kept``.
    """
    names = zip((key, text, language, source), "ktls", strict=True)
    plain = docs.select(*[F.col(c).alias(name) for c, name in names])
    rows = materialize(_with_base(text_counts(plain, "t").drop("t")), "quality-counts")
    out = _judged(rows, _limits(rows, reach, least))
    return out.select(F.col("k").alias(key), *COUNTS, "base_failed", "kept")


def clean(
    docs: DataFrame,
    text: str = "text",
    language: str = "lang",
    source: str = "source",
    reach: int = 3,
    least: int = 200,
) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns.

    The limits come from the counts alone; texts then pass by the limits of their group
    and aren't shuffled unless there are too many groups to broadcast.
    """
    names = zip((text, language, source), "tls", strict=True)
    plain = docs.select(*[F.col(c).alias(name) for c, name in names])
    rows = materialize(_with_base(text_counts(plain, "t").drop("t")), "quality-counts")
    limits = _limits(rows, reach, least)
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    full = _with_base(text_counts(numbered, place[text]))
    full = full.withColumn("l", F.col(place[language])).withColumn("s", F.col(place[source]))
    kept = _judged(full, limits).filter("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in place.items()])

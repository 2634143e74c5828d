"""Near-duplicate join on word n-grams: a size-aware heavy-light set similarity join."""

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from slotcast.llm import spans
from slotcast.llm.components import components
from slotcast.sources.storage import materialize

#: Sets linked by the joins have at least this share of their union in common, in percent.
SIMILARITY = 90
WORDS = 3
#: One in so many elements is given beyond those that a link may miss. More rows at first make
#: the bound on shared elements stronger, and fewer sets pass it.
_MORE = 8
#: Bytes of text tokenised at once; a word takes about a hundred bytes meanwhile.
_SLICE_BYTES = 1 << 19
#: Largest size of sets whose subsets are enumerated, whatever the costs say.
_MOST_LIGHT = 400


def least_overlap(n: Column | np.ndarray, percent: int):
    """Fewest elements that a set of ``n`` shares with any set it links to."""
    total = percent * n + 99
    return F.floor(total / 100) if isinstance(n, Column) else total // 100


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of every text, and the texts' bounds in them.

    A text with fewer words has one shingle, all its words; one without words has none.
    """
    data, offsets = spans.utf8(column)
    rows = len(offsets) - 1
    data = spans.LOWER[data]
    start, end, row = spans.words(data, offsets)
    each = spans.span_hashes(data, start, end)
    count = np.bincount(row, minlength=rows)
    stops = np.cumsum(count)
    long = np.maximum(count - words + 1, 0)
    first = spans.gather(stops - count, long)
    full = np.full(len(first), words, np.uint64)
    for i in range(words):
        full = spans.mix(full * np.uint64(31) + each[first + i])
    owner = np.repeat(np.arange(rows), long)
    few = np.flatnonzero((count > 0) & (count < words))
    whole = count[few].astype(np.uint64)
    for i in range(words - 1):
        there = i < count[few]
        at = (stops - count)[few] + i
        step = spans.mix(whole * np.uint64(31) + each[np.where(there, at, 0)])
        whole = np.where(there, step, whole)
    owner = np.concatenate([owner, few])
    full = np.concatenate([full, whole])
    order = np.lexsort((full, owner))
    owner, full = owner[order], full[order]
    new = np.ones(len(full), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (full[1:] != full[:-1])
    sizes = np.bincount(owner[new], minlength=rows)
    return full[new], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _digests(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of every set."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(spans.mix(tokens ^ np.uint64(salt)))])
        out.append(spans.mix(sums[bounds[1:]] - sums[bounds[:-1]]))
    return out[0], out[1]


def _sliced(batches: Iterator[pa.RecordBatch], at: int, words: int):
    """Slices of the batches with the sets of their texts."""
    for batch in batches:
        _, offsets = spans.utf8(batch.column(at))
        for low, high in spans.slices(offsets, _SLICE_BYTES):
            part = batch.slice(low, high - low)
            yield part, *shingles(part.column(at), words)


def _set_rows(docs: DataFrame, words: int) -> DataFrame:
    """``k``, the size ``n`` of its set and the set's digests ``sid`` and ``sid2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tokens, bounds in _sliced(batches, 1, words):
            a, b = _digests(tokens, bounds)
            columns = [part.column(0), pa.array(np.diff(bounds)), _signed(a), _signed(b)]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "n", "sid", "sid2"])

    kind = docs.schema["k"].dataType.simpleString()
    return docs.select("k", "t").mapInArrow(run, f"k {kind}, n long, sid long, sid2 long")


def _low_tokens(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The smallest hashes of every set that can link to another: ``token``, cut to an int, ``sid``.

    Every set gives as many as a link may miss, and an eighth more. A task gives equal sets once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = np.zeros(0, np.uint64)
        for _, tokens, bounds in _sliced(batches, 0, words):
            n = np.diff(bounds)
            sid, _ = _digests(tokens, bounds)
            take = np.minimum(n, n - least_overlap(n, percent) + n // _MORE + 2)
            take[100 * n < percent * (n + 1)] = 0
            once = np.zeros(len(n), bool)
            once[np.unique(sid, return_index=True)[1]] = True
            take[~once | np.isin(sid, given)] = 0
            given = np.union1d(given, sid[take > 0])
            low = tokens[spans.gather(bounds[:-1], take)].astype(np.uint32).view(np.int32)
            columns = [pa.array(low), _signed(np.repeat(sid, take))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "sid"])

    return docs.select("t").mapInArrow(run, "token int, sid long")


def _hopeful(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """How many of its smallest hashes each set shares with other sets, at least: ``sid``, ``shared``.

    Texts are tokenised once and their hashes shuffled once; in a run of equal hashes the
    neighbours tell which sets share them.
    """
    rows = _low_tokens(docs, words, percent)
    run = Window.partitionBy("token").orderBy("sid")
    other = (F.lag("sid").over(run) != F.col("sid")) | (F.lead("sid").over(run) != F.col("sid"))
    met = rows.withColumn("other", other).filter("other")
    # Equal sets of different tasks count again, which only lets more sets through.
    return met.groupBy("sid").agg(F.count("*").alias("shared"))


@contextmanager
def _runtime_filters(spark: SparkSession) -> Iterator[None]:
    """Let Spark test join keys with a Bloom filter of bounded size before texts are shuffled."""
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {
        prefix + "enabled": "true",
        prefix + "applicationSideScanSizeThreshold": "0",
        prefix + "creationSideThreshold": "64g",
        prefix + "expectedNumItems": "4000000",
        prefix + "numBits": "67108864",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _sets(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """``id``, ``sid``, ``n`` and the sorted ``tokens`` of the chosen documents' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tokens, bounds in _sliced(batches, 1, words):
            sid, _ = _digests(tokens, bounds)
            own = pa.array(np.asarray(part.column(2)) == sid.view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), _signed(tokens))
            out = pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(np.diff(bounds)), lists],
                names=["id", "sid", "n", "tokens"],
            )
            yield out.filter(own)

    kind = docs.schema["k"].dataType.simpleString()
    return (
        docs.join(chosen, "k")
        .select("k", "t", "sid")
        .mapInArrow(run, f"id {kind}, sid long, n long, tokens array<long>")
    )


def _keys(
    sets: DataFrame, alone: DataFrame, heavy: dict[int, int], light: int, percent: int
) -> DataFrame:
    """Keys under which linked sets meet: ``key``, ``id``, ``n``, ``pos`` and ``odd``.

    Elements are ordered: those of this set alone, then by hash, then common ones by frequency.
    Two linked sets share ``i`` of their first ``n - least + i`` elements. A set of at
    most ``light`` elements gives every pair of them (``i = 2``) as a key, a larger one
    each of them (``i = 1``), as do sets close below the boundary, for the larger ones.
    ``pos`` is how many elements precede the last one of the key, ``odd`` the share
    of elements that no other set has.
    """
    shared = sets.sparkSession.sparkContext.broadcast(
        (np.array(sorted(heavy), np.int64), np.array([heavy[t] for t in sorted(heavy)], np.int64))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in batches:
            ids, owner, keys, pos, size, odd = [], [], [], [], [], []
            lists = batch.column(1)
            flat = np.asarray(lists.values)
            bounds = np.asarray(lists.offsets).astype(np.int64)
            lone = batch.column(2)
            lone_flat, lone_bounds = np.asarray(lone.values), np.asarray(lone.offsets)
            for i in range(len(batch)):
                tokens = flat[bounds[i] : bounds[i + 1]]
                n = len(tokens)
                mine = lone_flat[lone_bounds[i] : lone_bounds[i + 1]] if lone[i].is_valid else ()
                unique = np.zeros(n, bool)
                unique[np.asarray(mine, np.int64)] = True
                r = int(unique.sum())
                least = least_overlap(n, percent)
                rest = tokens[~unique]
                if len(known):
                    at = np.minimum(np.searchsorted(known, rest), len(known) - 1)
                    often = np.where(known[at] == rest, counts[at], 0)
                    rest = rest[np.lexsort((rest.view(np.uint64), often))]
                first = rest[: max(n - least + 2 - r, 0)].view(np.uint64)
                found: list[tuple[int, int]] = []
                if n <= light:
                    for (p, x), (q, y) in combinations(enumerate(spans.mix(first).tolist()), 2):
                        found.append(((x * 31 + y) & 0xFFFFFFFFFFFFFFFF, r + q - 1))
                if n * 100 > light * percent:
                    single = first[: max(n - least + 1 - r, 0)].tolist()
                    found += [(x, r + p) for p, x in enumerate(single)]
                keys += [k for k, _ in found]
                pos += [p for _, p in found]
                owner += [i] * len(found)
                size += [n] * len(found)
                odd += [1000 * r // n] * len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(np.array(keys, np.uint64)),
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(size, pa.int64()),
                    pa.array(pos, pa.int64()),
                    pa.array(odd, pa.int64()),
                ],
                names=["key", "id", "n", "pos", "odd"],
            )

    kind = sets.schema["id"].dataType.simpleString()
    rows = sets.join(alone, "ix", "left").select("id", "tokens", "lone")
    return rows.mapInArrow(run, f"key long, id {kind}, n long, pos long, odd long")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether two sets that meet first at these positions can have enough in common."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    return (100 + percent) * left >= percent * total


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets have ``percent`` of their union in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = np.zeros(len(batch), bool)
            xs, ys = np.asarray(x.values), np.asarray(y.values)
            xo, yo = np.asarray(x.offsets), np.asarray(y.offsets)
            for i in range(len(batch)):
                s, t = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                keep[i] = 100 * both >= percent * (len(s) + len(t) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    kind = sets.schema["id"].dataType.simpleString()
    pairs = materialize(pairs, "pairs")
    ends = pairs.filter(F.col("a") < F.col("b")).select(F.explode(F.array("a", "b")).alias("id"))
    ends = materialize(ends.distinct().withColumn("there", F.lit(1)), "ends")
    with _runtime_filters(sets.sparkSession):
        some = sets.select("id", "tokens").join(ends.filter(F.col("there") > 0), "id")
        some = materialize(some.drop("there"), "compared-sets")
    left = some.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    right = some.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return full.mapInArrow(run, f"a {kind}, b {kind}")


def _all_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links that join the sets as all links between them would."""
    count = sets.count()
    often = max(50, count // 1000)
    seen = Observation()
    # Where an element lies in one set only, the least set and place are its own.
    tokens = (
        sets.select("ix", F.posexplode("tokens").alias("p", "token"))
        .groupBy("token")
        .agg(F.count("*").alias("df"), F.min("ix").alias("ix"), F.min("p").alias("p"))
        .observe(
            seen,
            F.sum(F.when(F.col("df").between(2, often), F.col("df"))).alias("rows"),
            F.sum(F.when(F.col("df").between(2, often), F.col("df") * F.col("df"))).alias("scanned"),
        )
        .filter((F.col("df") == 1) | (F.col("df") > often))
    )
    tokens = materialize(tokens, "tokens")
    alone = tokens.filter(F.col("df") == 1).groupBy("ix").agg(F.collect_list("p").alias("lone"))
    # At most 1000 times the mean size of a set, as each is in a thousandth of all sets.
    common = tokens.filter(F.col("df") > often).select("token", "df").collect()
    # Pairs of m + 2 elements cost (m + 2)(m + 1) / 2 rows; scanning the lists of m + 1 elements
    # costs their mean length for each. They break even at m = 2 * length - 2.
    length = (seen.get["scanned"] or 0) / max(seen.get["rows"] or 0, 1)
    light = int(min(max(2 * length - 2, 0) * 100 / max(100 - percent, 1), _MOST_LIGHT))
    heavy = {r["token"]: r["df"] for r in common}
    keys = materialize(_keys(sets, alone, heavy, light, percent), "keys")

    # Each key's most typical set against the others.
    centre = F.min(F.struct("odd", "id", "n", "pos")).alias("c")
    centres = keys.groupBy("key").agg(centre, F.count("*").alias("m")).filter(F.col("m") > 1)
    met = keys.alias("x").join(centres.alias("y"), "key")
    near = _may_link("x", "c", percent) & (F.col("x.id") != F.col("c.id"))
    pairs = met.filter(near).select(
        F.least("x.id", "c.id").alias("a"), F.greatest("x.id", "c.id").alias("b")
    )
    links = materialize(_links(pairs.distinct(), sets, percent), "links")

    # Whoever still shares a key with another component is compared with all of it.
    parts = materialize(components(links), "parts")
    placed = (
        keys.join(centres.select("key"), "key", "left_semi")
        .join(parts, F.col("id") == F.col("node"), "left")
        .select("key", "id", "n", "pos", F.coalesce("component", "id").alias("part"))
    )
    placed = materialize(placed, "placed-keys")
    main = placed.groupBy("key", "part").agg(F.count("*").alias("m")).groupBy("key").agg(
        F.max(F.struct("m", "part")).alias("main"), F.count("*").alias("parts")
    )
    open_keys = main.filter(F.col("parts") > 1).select("key", "main.part").withColumnRenamed(
        "part", "main"
    )
    open_rows = materialize(placed.join(open_keys, "key"), "open-keys")
    few = open_rows.filter(F.col("part") != F.col("main"))
    crossed = few.alias("x").join(open_rows.alias("y"), "key")
    crossed = crossed.filter(
        (F.col("x.part") != F.col("y.part")) & _may_link("x", "y", percent)
    ).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    return links.unionByName(_links(crossed.distinct(), sets, percent))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = SIMILARITY,
) -> DataFrame:
    """Components of texts whose sets of word n-grams have ``percent`` of their union in common.

    Words are split at ASCII white space and A-Z are lower-cased. Texts with equal sets form
    one class, of which one member is compared. Sets that share too few of their
    smallest hashes with any other drop out by a bound on the overlap. For the rest, a
    size-aware join: small sets meet under pairs of their rarest elements, large sets in the
    lists of single ones; the boundary is where both cost the same. In each key all sets are
    compared with the most typical one first; then only those in different components
    meet again, so a large group of copies needs few comparisons and no link between
    components is lost. All kept pairs are checked on their whole sets of 64-bit hashes.

    Null texts and texts without words have empty sets and no links. Rows with equal keys
    are separate documents of one component if their texts link; a null key has a null
    component unless it links to others. Other columns aren't read.

    Returns ``key``, ``n_shingles`` and ``component_id``, the smallest key of the component.
    """
    plain = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = materialize(_set_rows(plain, words), "sets-of-documents")
    by = ["sid", "sid2", "n"]
    classes = materialize(
        rows.filter(F.col("n") > 0).groupBy(*by).agg(F.min("k").alias("id")), "classes"
    )
    hopeful = _hopeful(plain.filter(F.col("t").isNotNull()), words, percent)
    # Where one of two linked sets ends first, all but the missing ones lie in both, so at least
    # an eighth of a set's smallest partner is given by another set too.
    least = least_overlap(F.col("n"), percent)
    need = F.least(F.floor(least / _MORE) + 2, least)
    chosen = classes.join(hopeful, "sid").filter(F.col("shared") >= need)
    chosen = chosen.select(F.col("id").alias("k"), "sid", "n")
    chosen = materialize(chosen.filter(F.col("k").isNotNull()), "chosen")
    with _runtime_filters(docs.sparkSession):
        sets = _sets(plain, chosen.filter(F.col("n") > 1).select("k", "sid"), words)
        sets = materialize(sets.withColumn("ix", F.monotonically_increasing_id()), "sets")
    doubled = sets.groupBy("id").count().filter(F.col("count") > 1)
    if not doubled.isEmpty():  # repeated rows
        sets = materialize(sets.dropDuplicates(["id"]), "sets")
    parts = materialize(components(_all_links(sets, percent)), "parts")
    named = classes.join(parts, F.col("id") == F.col("node"), "left").select(
        *by, F.coalesce("component", "id").alias("part")
    )
    return rows.join(named, by, "left").select(
        F.col("k").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("part")).otherwise(F.col("k")).alias("component_id"),
    )


def first_of_each(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = SIMILARITY,
) -> DataFrame:
    """The documents with the smallest key of their component, with all their columns.

    Rows with null keys stay, as no key can be told from another. Of rows that repeat a key
    and a text one stays.
    """
    found = materialize(near_duplicates(docs, key, text, words, percent), "components")
    gone = found.filter(F.col(key) != F.col("component_id")).select(key).distinct()
    kept = docs.join(materialize(gone, "copies"), key, "left_anti").select(*docs.columns)
    again = found.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > 1)
    if again.isEmpty():
        return kept
    once = kept.filter(F.col(key).isNotNull()).dropDuplicates([key, text])
    return once.unionByName(kept.filter(F.col(key).isNull()))

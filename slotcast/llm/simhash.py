"""Near duplicates by SimHash fingerprints and the generalised pigeonhole principle."""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.llm import spans
from slotcast.llm.components import components
from slotcast.sources.storage import materialize

BITS = 64
WORDS = 3
SEED = 42
#: Fingerprints that counts of candidates are estimated from; every fingerprint is searched.
SAMPLE = 2048
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 15


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS
) -> DataFrame:
    """The SimHash ``fp`` of every whole text, as a long, with its key ``k``.

    Words are split at ASCII white space, A-Z are lower-cased. A bit is set if it is in
    more than half of the XXH64 hashes of the shingles of ``words`` words joined by spaces,
    repeats included. Fewer words are one shingle; a text without words, or null, has 0.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, bounds = spans.utf8(batch.column(1))
            for low, high in spans.slices(bounds):
                part = whole[bounds[low] : bounds[high]]
                found = _simhashes(part, bounds[low : high + 1] - bounds[low], words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(found.view(np.int64))],
                    names=["k", "fp"],
                )

    return docs.select(key, text).mapInArrow(run, f"k {kind}, fp long")


def _simhashes(data: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    start, end, row = spans.words(data, offsets)
    # All words with one space behind each, so that a shingle is one run of bytes.
    size = end - start + 1
    stop = np.cumsum(size)
    plain = np.append(spans.LOWER[data], np.uint8(32))[spans.gather(start, size)]
    plain[stop - 1] = 32
    count = np.bincount(row, minlength=len(offsets) - 1)
    first_word = np.cumsum(count) - count
    shingles = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    owner = np.repeat(np.arange(len(count)), shingles)
    first = spans.gather(first_word, shingles)
    last = first + np.minimum(count, words)[owner] - 1
    begins, ends = (stop - size)[first].tolist(), (stop[last] - 1).tolist()
    raw, one = plain.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (one(raw[a:b], SEED) for a, b in zip(begins, ends, strict=True)), np.uint64, len(owner)
    )
    ones = np.zeros((len(count), BITS), np.int64)
    for at in range(0, len(hashes), _BLOCK):
        some, own = hashes[at : at + _BLOCK], owner[at : at + _BLOCK]
        edges = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[edges]] += np.add.reduceat(_bits(some), edges, axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little")
    return packed.view("<u8").ravel()


def _bits(numbers: np.ndarray) -> np.ndarray:
    """The bits of each number, the lowest first."""
    wide = numbers.astype("<u8").view(np.uint8).reshape(-1, BITS // 8)
    return np.unpackbits(wide, axis=1, bitorder="little")


@dataclass(frozen=True)
class Part:
    """A partition of the bits, and how many of them a probe may change; -1 for none at all."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def changes(self) -> list[int]:
        """Masks of all changes of at most ``threshold`` bits."""
        some = (c for t in range(self.threshold + 1) for c in combinations(self.bits, t))
        return [sum(1 << b for b in c) for c in some]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _correlations(found: DataFrame) -> np.ndarray:
    """How closely every two bits of the fingerprints go together, from 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            for low in range(0, len(batch), 10_000):
                numbers = np.asarray(batch.column(0).slice(low, 10_000)).astype(np.uint64)
                bits = np.ones((len(numbers), BITS + 1), np.float32)
                bits[:, :BITS] = _bits(numbers)
                total += bits.T @ bits
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell), pa.array(total.ravel()[cell].astype(np.int64))], names=["cell", "n"]
        )

    cells = found.select("fp").mapInArrow(run, "cell long, n long")
    together = np.zeros((BITS + 1) ** 2)
    # At most (BITS + 1) squared rows.
    for row in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        together[row["cell"]] = row["n"]
    together = together.reshape(BITS + 1, BITS + 1)
    share = together / max(together[BITS, BITS], 1)
    p = share[BITS, :BITS]
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs(share[:BITS, :BITS] - np.outer(p, p)) / np.outer(spread, spread)


def _groups(together: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bits in ``parts`` groups of almost equal size, correlated ones in the same group."""
    left = set(range(BITS))
    out = []
    for i in range(parts):
        size = len(left) // (parts - i)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (together[b, rest].sum(), -b))]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (together[b, group].sum(), -b)))
        left -= set(group)
        out.append(tuple(sorted(group)))
    return out


def _costs(sample: np.ndarray, bits: tuple[int, ...], most: int, count: int) -> list[float]:
    """Estimated rows for thresholds -1, 0, ... ``most`` of a part: probes and candidates.

    A fingerprint's candidates are the share of the sample within the threshold, but at least what
    independent bits would give, of all fingerprints. It costs its half of the pairs, or its
    neighbouring words where these are fewer.
    """
    mask = np.uint64(sum(1 << b for b in bits))
    own = sample & mask
    near = np.zeros((most + 1, len(own)))
    for i in range(0, len(own), 256):
        apart = np.bitwise_count(own[i : i + 256, None] ^ own[None, :])
        for t in range(most + 1):
            near[t, i : i + 256] = np.count_nonzero(apart <= t, axis=1) - 1
    near /= max(len(own) - 1, 1)
    p = _bits(sample).mean(axis=0)[list(bits)] if len(sample) else np.zeros(len(bits))
    # Chances that so many bits differ, for one bit after another.
    chance = np.zeros(most + 1)
    chance[0] = 1
    for q in 2 * p * (1 - p):
        chance = chance * (1 - q) + np.concatenate([[0], chance[:-1]]) * q
    share = np.maximum(near, np.cumsum(chance)[:, None])
    pairs = np.minimum(count * share / 2, BITS + 1).mean(axis=1) if len(own) else np.zeros(most + 1)
    out, probes = [0.0], 0
    for t in range(most + 1):
        probes += len(list(combinations(bits, t)))
        out.append(count * (probes + float(pairs[t])))
    return out


def _allocated(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds that add up to ``total`` at the least cost, part after part."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for threshold, more in enumerate(own, -1):
                to = spent + threshold
                if to not in step or cost + more < step[to][0]:
                    step[to] = (cost + more, [*chosen, threshold])
        best = step
    return best[total]


def plan_parts(found: DataFrame, distance: int, count: int) -> list[Part]:
    """Partitions and thresholds with the fewest estimated rows.

    If thresholds of ``m`` parts add up to ``distance - m + 1``, two fingerprints that
    differ in at most ``distance`` bits are within its threshold in one part.
    """
    together = _correlations(found)
    rows = found.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp").toArrow()
    sample = np.asarray(rows.column(0)).astype(np.uint64)
    options = []
    for m in range(max(distance, 1), distance + 3):
        groups = _groups(together, m)
        costs = [_costs(sample, g, distance, count) for g in groups]
        cost, thresholds = _allocated(costs, distance - m + 1)
        options.append((cost, m, [Part(g, t) for g, t in zip(groups, thresholds, strict=True)]))
    return [p for p in min(options, key=lambda o: o[:2])[2] if p.threshold >= 0]


def _keys(found: DataFrame, parts: list[Part], probe: bool) -> DataFrame:
    """Every part's bits of every fingerprint, for probes with all changes allowed."""

    def own(i: int, part: Part) -> Column:
        mine = F.col("fp").bitwiseAND(F.lit(_signed(part.mask)))
        changes = F.array(*[F.lit(_signed(c)) for c in (part.changes() if probe else [0])])
        key = lambda c: F.struct(F.lit(i).alias("part"), mine.bitwiseXOR(c).alias("v"))
        return F.transform(changes, key)

    each = [own(i, part) for i, part in enumerate(parts)]
    rows = F.explode(F.concat(*each) if len(each) > 1 else each[0])
    return found.select("fp", rows.alias("x")).select("x.part", "x.v", "fp")


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _stars(found: DataFrame, distance: int) -> DataFrame:
    """Links of fingerprints that lie in crowded buckets, without comparing pairs.

    Each gives itself and all words one bit beside it. Two fingerprints share such a word if and
    only if they differ in at most two bits, and at most ``BITS + 1`` share one. For
    a distance of 1 the word has to be a fingerprint itself.
    """
    changes = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(BITS)])
    words = F.explode(F.transform(changes, lambda c: F.col("fp").bitwiseXOR(c)))
    stars = found.select("fp", words.alias("w")).groupBy("w").agg(F.collect_set("fp").alias("all"))
    stars = stars.filter(F.size("all") > 1)
    if distance == 1:
        stars = stars.filter(F.array_contains("all", F.col("w"))).withColumn("m", F.col("w"))
    else:
        stars = stars.withColumn("m", F.array_min("all"))
    ends = stars.select("m", F.explode("all").alias("b")).filter(F.col("m") != F.col("b"))
    return ends.select(F.least("m", "b").alias("a"), F.greatest("m", "b").alias("b")).distinct()


def links(found: DataFrame, distance: int = 2) -> DataFrame:
    """Links between distinct fingerprints ``fp`` that join all that differ in ``distance`` bits.

    Rows ``a``, ``b``. Bits are grouped into partitions by their correlation, and thresholds
    are given to the partitions by dynamic programming on estimated counts of candidates. Buckets
    are probed with all allowed changes and candidates verified on all bits. A bucket
    whose pairs are more than its members' neighbouring words goes by these words instead.
    """
    if distance not in (1, 2):
        raise ValueError("distance is 1 or 2")
    count = found.count()
    parts = plan_parts(found, distance, count)
    index = _keys(found, parts, probe=False)
    same = all(p.threshold == 0 for p in parts)
    probes = index if same else _keys(found, parts, probe=True)
    # Half of all pairs of n members against BITS + 1 words of each.
    crowd = 2 * (BITS + 1)
    sizes = materialize(
        index.groupBy("part", "v").agg(F.count("*").alias("n")).filter(F.col("n") > (1 if same else 0)),
        "buckets",
    )
    crowded = sizes.filter(F.col("n") > crowd).select("part", "v")
    small = sizes.filter(F.col("n") <= crowd).select("part", "v")
    x = probes.alias("x").join(small.alias("s"), ["part", "v"])
    x = x.select("part", "v", F.col("fp").alias("a"))
    y = index.select("part", "v", F.col("fp").alias("b"))
    met = x.join(y, ["part", "v"]).filter((F.col("a") < F.col("b")) & _near(F.col("a"), F.col("b"), distance))
    near = materialize(met.select("a", "b").distinct(), "near")
    if crowded.isEmpty():
        return near
    members = probes.join(crowded, ["part", "v"], "left_semi").select("fp").distinct()
    members = materialize(members, "crowded")
    return near.unionByName(_stars(members, distance))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    distance: int = 2,
) -> DataFrame:
    """Components of texts whose SimHash fingerprints differ in at most ``distance`` bits.

    Equal fingerprints are one entry, whatever the number of texts. Texts without words, or
    null, have the fingerprint zero and link like others. Rows with equal keys are
    separate documents of one component if their texts link; a null key takes its component's
    smallest key and is null only where no member has one. Other columns aren't read;
    an empty table gives no rows.

    Returns ``key``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest key
    reachable.
    """
    rows = materialize(fingerprints(docs, key, text, words), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("k").alias("least")), "classes")
    joined = materialize(components(links(classes.select("fp"), distance)), "joined")
    placed = classes.join(joined, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("part")
    )
    named = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    named = placed.join(named, "part").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select(
        F.col("k").alias(key), digits.alias("fingerprint"), "component_id"
    )

"""Class-conditional models, against a direct computation and on held-out rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotcast.llm import letters, toxicity

GOOD = ["the garden is green", "a quiet morning in the old town", "rivers run to the sea"]
BAD = ["you rotten scoundrel", "what a rotten scoundrel in the town"]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, (BAD[i % 2] if i % 4 == 0 else GOOD[i % 3]) + f" {'abcdefgh'[i % 8]}") for i in range(200)]
    docs = spark.createDataFrame(
        [(i, t, "x") for i, t in rows] + [(900, None, "x"), (901, "", "x"), (None, BAD[0], "x")],
        "doc_id long, text string, toxic string",
    )
    labels = [(i, int(i % 4 == 0)) for i, _ in rows] + [(0, 1), (3, None), (None, 1)]
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def _direct(counts):
    """Log ratios per word by recursion over Python dictionaries."""
    order, d = toxicity.ORDER, 0.9
    grams = [Counter(), Counter()]

    def of(word):
        marked = "\x01" + word + "\x02"
        return [marked[max(0, j - order + 1) : j + 1] for j in range(1, len(marked))]

    for word, both in counts.items():
        for k in (0, 1):
            for g in of(word):
                grams[k][g] += both[k]
    level, shared = {g for k in (0, 1) for g in grams[k] if grams[k][g]}, Counter()
    for _ in range(order - 1):
        following = Counter(g[1:] for g in level if len(g) > 1)
        shared.update(following)
        level = set(following)
    total, kinds = Counter(), Counter()
    for x, n in shared.items():
        total[x[:-1]] += n
        kinds[x[:-1]] += 1

    def base(x):
        if not x:
            return 1 / 100
        h = x[:-1]
        return (shared[x] - d) / total[h] + d * kinds[h] / total[h] * base(x[1:])

    n, t = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)]
    for k in (0, 1):
        for g, c in grams[k].items():
            n[k][g[:-1]] += c
            t[k][g[:-1]] += c > 0

    def chance(k, g):
        h = g[:-1]
        if not n[k][h]:
            return base(g[1:])
        return max(grams[k][g] - d, 0) / n[k][h] + d * t[k][h] / n[k][h] * base(g[1:])

    return lambda word: sum(math.log(chance(1, g) / chance(0, g)) for g in of(word))


def test_ratios_are_those_of_the_models(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels, F.lit(True), F.col("doc_id") % 5 == 4)
    known = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    counts = defaultdict(lambda: [0, 0])
    for r in docs.filter("doc_id < 900").collect():
        for word in r.text.lower().split() if r.doc_id in known else ():
            counts[word][known[r.doc_id]] += 1
    direct = _direct(counts)
    words = letters.words(pa.array([" ".join(counts)]))
    got, part = toxicity.word_ratios(words, model)
    for word, ratio, most in zip(words.strings(), got, part, strict=True):
        assert ratio == pytest.approx(direct(word), abs=1e-4)
        assert most >= max(ratio, 0) - 1e-4  # ratios are kept in single precision


def test_scores(tables):
    docs, labels = tables
    rows = toxicity.judge(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    got = {r.doc_id: r for r in rows}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(200))
    assert got[900].predicted == got[901].predicted == 0
    assert got[None].predicted == 1 and got[None].held_out is False


def test_clean_keeps_columns(tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 0)
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {*(i for i in range(200) if i % 4), 900, 901}


def test_nothing_to_learn_from(spark, tables):
    docs, labels = tables
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.score for r in toxicity.judge(docs, some).collect()} == {0.0}
    assert toxicity.judge(docs.limit(0), labels).collect() == []


def test_no_ratio_is_left_out(spark):
    """More than 2^20 n-grams, most of them seen once."""
    rng = np.random.default_rng(3)
    alphabet = np.array([chr(i) for i in range(0x3B1, 0x3C2)] + [chr(i) for i in range(0x430, 0x450)])
    words = sorted({"".join(w) for w in alphabet[rng.integers(0, len(alphabet), (130_000, 10))]})
    rows = [(i, " ".join(words[i::1000]), int(i % 4 == 0)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.drop("text"), F.lit(True), F.lit(False))
    assert model.ratios.filter("not far").count() > 1 << 20
    counts = {w: [int(i % 1000 % 4 != 0), int(i % 1000 % 4 == 0)] for i, w in enumerate(words)}
    direct, some = _direct(counts), letters.words(pa.array([" ".join(words[::500])]))
    got, _ = toxicity.word_ratios(some, model)
    for word, ratio in zip(some.strings(), got, strict=True):
        assert ratio == pytest.approx(direct(word), abs=1e-3)
    # Scoring looks the same ratios up by joins.
    for r in toxicity.score(docs.filter("doc_id < 3"), model).collect():
        own = [direct(w) for w in words[r.doc_id :: 1000]]
        assert r.ratio == pytest.approx(sum(own) / (11 * len(own)), abs=1e-4)


def test_measures_of_bags_are_those_of_the_words():
    rng = np.random.default_rng(5)
    lexicon = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "uvwxyzäßя"] * 2
    texts = [" ".join(rng.choice(lexicon, n)) for n in (1, 2, 0, 700, 30)] + [None, "aa aa 1 aa", "", "b"]
    unit, got = toxicity._Lexicon(), []
    for part in (texts[:4], texts[4:]):  # the second part meets known and new words
        words = letters.words(pa.array(part, pa.string()))
        columns = toxicity.Bags.of(words, unit.add(words)).columns(len(part))
        got.append((toxicity.Bags.read(columns), len(part)))
    text, size = unit.batch().columns
    size = np.asarray(size.flatten()).astype(np.int64)
    known = letters.unpacked(text[0].as_py(), size).strings()
    assert len(set(known)) == len(known) == len(size)
    each, part = rng.normal(size=(2, len(known))).round(1) * 4  # with ties
    found = np.concatenate([toxicity._measures(b, each, part, size, n) for b, n in got])
    for text, row in zip(texts, found, strict=True):
        at = [known.index(w) for w in "".join(c if c.isalpha() else " " for c in text or "").split()]
        total, count = sum(each[at]), max(sum(len(known[i]) + 1 for i in at), 1)
        peak = sum(sorted(each[at])[-2:]) / 2
        telling = sum(max(part[i] - 2, 0) for i in at) / math.sqrt(max(len(at), 1))
        assert row == pytest.approx([np.clip(peak, -10, 30), total / count, total / math.sqrt(count), telling])


def test_hashes_end_at_the_word():
    words = letters.words(pa.array(["ab xab"]))
    codes, begin = letters.flat(words)
    context, gram = toxicity._hashes(codes, begin)
    assert len(np.unique(gram)) == len(gram) - 1  # only the marks at the begin are alike

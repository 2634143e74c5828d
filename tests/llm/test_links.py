"""Hard negatives, fingerprints and manifests, against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as contract
from checks.compare import compare
from slotcast.llm import hard_negatives, merkle, simhash

ANCHOR = "vec_id % 10 = 0"
VECTORS = "vec_id long, embedding array<double>, label int, id string, v string"


def _mined(rows):
    """The contract by comparing everything."""
    sound = {}
    for vec, x, label, *_ in rows:
        if vec is None or label is None or x is None or any(c is None or c != c or abs(c) == np.inf for c in x):
            continue
        whole = (label, [int(np.floor(256 * c)) for c in x])
        sound[vec] = min(sound.get(vec, whole), whole)
    out = []
    for anchor, (label, x) in sound.items():
        if anchor % 10:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(x, y, strict=True)), vec, other == label)
            for vec, (other, y) in sound.items()
            if vec != anchor
        )
        for positive in [s for s in scored if s[2]][:5]:
            p = -positive[0]
            fit = [s for s in scored if not s[2] and 80 * p <= -100 * s[0] <= 100 * p][:5]
            out += [(anchor, positive[1], r, s[1], p, -s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out)


def _vectors(n, size, seed, spread=1.0):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((6, size))
    rows = []
    for i in range(n):
        x = centres[i % 6] + spread * rnd.standard_normal(size)
        rows.append((i, [float(c) for c in x], int(rnd.integers(3)), "a", "b"))
    return rows


@pytest.mark.parametrize("size, spread", [(1, 1.0), (5, 0.1), (8, 0.0)])
def test_hard_negatives_equal_all_comparisons(spark, monkeypatch, size, spread):
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", 20)
    monkeypatch.setattr(hard_negatives, "GROWTH", 3)
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 30)
    rows = _vectors(200, size, size, spread)
    rows += [(300 + i, rows[i][1], rows[i][2], "c", "d") for i in range(20)]  # ties
    found = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.expr(ANCHOR))
    assert sorted(map(tuple, found.collect())) == _mined(rows)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = _vectors(40, 4, 1)
    rows += [(10, rows[10][1], rows[10][2], "again", None), (20, [9.0, 9.0, 9.0, 9.0], 0, None, None)]
    rows += [
        (None, [1.0] * 4, 1, "", ""),
        (100, None, 1, "", ""),
        (110, [1.0, None, 1.0, 1.0], 1, "", ""),
        (120, [nan, 1.0, 1.0, 1.0], 1, "", ""),
        (130, [inf, 1.0, 1.0, 1.0], 1, "", ""),
        (140, [1.0] * 4, None, "", ""),
    ]
    short = [(150, [1.0], 1, "", ""), (160, [], 2, "", "")]
    found = hard_negatives.mine(spark.createDataFrame(rows + short, VECTORS), F.expr(ANCHOR))
    assert sorted(map(tuple, found.collect())) == _mined(rows)
    # Scores beyond 2^53 are exact.
    large = [(i, [c * 1e5 for c in x], *rest) for i, x, *rest in _vectors(40, 4, 2)]
    found = hard_negatives.mine(spark.createDataFrame(large, VECTORS), F.expr(ANCHOR), scale=256)
    assert sorted(map(tuple, found.collect())) == _mined(large)
    for none in ([], [(1, [1.0], 1, "", ""), (2, [1.0], 1, "", "")], short[1:]):
        found = hard_negatives.mine(spark.createDataFrame(none, VECTORS), F.expr(ANCHOR))
        assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert found.collect() == []


def test_a_search_that_is_certified_leaves_cells_out():
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((8, 4)) * 50, rnd.standard_normal((8, 4)) * 50
    small = np.full(8, 0.5), np.full(8, 0.5)
    ones = np.ones(64, np.int64)
    index = hard_negatives.MultiIndex(centres, small, ones, ones, ones)
    query = rnd.standard_normal(8)
    visited = list(index.cells_by_bound(query))
    assert len(visited) == len({v[0] for v in visited}) == 64
    uppers = [v[1] for v in visited]
    assert uppers == sorted(uppers, reverse=True)
    for cell, upper, lower in visited:
        point = np.concatenate([centres[0][cell // 8], centres[1][cell % 8]])
        assert lower < point @ query < upper


DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string"


def _fingerprint(text):
    words = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    full = [words[i : i + 3] for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(f), 42) for f in full]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _joined(prints, distance=2):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_simhash_of_texts(spark):
    rnd = random.Random(2)
    vocabulary = ["Alpha", "bêta", "γάμμα", "d", "epsilon" * 9, "ZETA", "😀"]
    texts = [None, "", " \n\t", "One", "one two three", "ONE two", "one  two\tthree", "a b a b a b a b"]
    for size in (4, 9, 40, 200):
        base = [rnd.choice(vocabulary) + str(rnd.randrange(50)) for _ in range(size)]
        for edits in (0, 0, 1, 2):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(size)] = "x"
            texts.append("  ".join(copy))
    texts.append("word " * 100_000)
    texts.append("w" * 3_000_000)
    rows = [(i, t, "en", "s", 1, 5, "k") for i, t in enumerate(texts)]
    found = {r[0]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    prints = [_fingerprint(t) for t in texts]
    assert [found[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [found[i]["component_id"] for i in range(len(texts))] == _joined(prints)


def test_simhash_of_a_given_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    prints = [_fingerprint(t) for _, t in rows]
    found = {r["doc_id"]: r for r in contract.queries()["op12_simhash_near_dedup"](spark, folder).collect()}
    assert [found[d]["fingerprint"] for d, _ in rows] == [f"{p:016x}" for p in prints]
    assert [found[d]["component_id"] for d, _ in rows] == [rows[i][0] for i in _joined(prints)]


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("free", [64, 7])
def test_simhash_links_join_all_near_fingerprints(spark, distance, free):
    """With few free bits buckets are crowded, with all of them they aren't."""
    rnd = random.Random(free)
    centres = [rnd.getrandbits(64) for _ in range(25)]
    prints = set(centres)
    while len(prints) < (100 if free == 7 else 400):
        x = rnd.choice(centres)
        for _ in range(rnd.randrange(5)):
            x ^= 1 << rnd.randrange(free)
        prints.add(x if free == 64 else centres[0] >> free << free | x & ((1 << free) - 1))
        if free == 7:
            prints = {p for p in prints if p >> free == centres[0] >> free}
    prints = sorted(prints)
    rows = [(simhash._signed(p),) for p in prints]
    found = simhash.links(spark.createDataFrame(rows, "fp long"), distance)
    place = {simhash._signed(p): i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in found.collect():
        x, y = root(place[a]), root(place[b])
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(prints))] == _joined(prints, distance)


def test_simhash_thresholds_add_up_and_cost_least():
    costs = [[0.0, 10.0, 50.0, 90.0], [0.0, 20.0, 30.0, 40.0], [0.0, 1000.0, 2000.0, 3000.0]]
    cost, chosen = simhash._allocated(costs, 0)
    best = min(
        (sum(c[t + 1] for c, t in zip(costs, ts, strict=True)), ts)
        for ts in itertools.product((-1, 0, 1, 2), repeat=3)
        if sum(ts) == 0
    )
    assert (cost, tuple(chosen)) == best


def test_simhash_of_odd_rows(spark):
    rows = [(None, "a b c d", "", "", 1, 1, ""), (7, "a b c d", "", "", 1, 1, ""), (7, "zz", "", "", 1, 1, "")]
    rows += [(None, "p q r s t", "", "", 1, 1, ""), (9, None, "", "", 1, 1, "")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    by_print = defaultdict(set)
    for r in found:
        by_print[r["fingerprint"]].add((r["doc_id"], r["component_id"]))
    assert by_print[f"{_fingerprint('a b c d'):016x}"] == {(None, 7), (7, 7)}
    assert by_print[f"{_fingerprint('zz'):016x}"] == {(7, 7)}
    assert by_print[f"{_fingerprint('p q r s t'):016x}"] == {(None, None)}
    assert by_print["0" * 16] == {(9, 9)}
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _tree(nodes, fanout):
    """Root, and for each leaf its list of (before, after) per level."""
    proofs, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, at in enumerate(place):
            first = at - at % fanout
            proofs[leaf].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
        nodes = [_sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        place = [at // fanout for at in place]
    return nodes[0], proofs


@pytest.mark.parametrize("fanout, levels", [(2, 1), (3, 1), (2, 2)])
def test_manifest_of_ragged_groups(spark, fanout, levels):
    rnd = random.Random(fanout)
    sizes = {None: 3, "": 1, "a": 37, "b": 16, "c": 2, "é": 8, "z": 1}
    rows = [(rnd.randrange(-50, 500), s, None if rnd.random() < 0.2 else "t" * i) for s, n in sizes.items() for i in range(n)]
    rows += [(None, "a", "x"), (None, "a", None), (5, "b", "same"), (5, "b", "same")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, source string, text string, key string, g long")

    def leaf(row):
        return _sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in sorted(groups[s])], fanout) for s in order}
    root, tops = _tree([trees[s][0] for s in order], fanout)
    want = []
    for i, s in enumerate(order):
        for x, proof in zip(sorted(groups[s]), trees[s][1], strict=True):
            want.append((x[1] if x[0] else None, s, x[2], trees[s][0], root, proof + tops[i]))

    found = merkle.manifest(docs, ["doc_id", "source", "text"], fanout=fanout, levels=levels, carry={"size": F.length("text")})
    assert found.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof", "size"]
    found = found.withColumn("back", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert all(r["back"] == root for r in found)
    got = [(*r[:5], [tuple(p) for p in r["proof"]]) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_manifest_of_few_rows(spark):
    kinds = "doc_id long, source string, text string"
    assert merkle.manifest(spark.createDataFrame([], kinds), ["doc_id"]).collect() == []
    row = merkle.manifest(spark.createDataFrame([(1, None, "x")], kinds), ["doc_id", "text"]).first()
    assert row["leaf"] == row["subroot"] == row["root"] == _sha("1:11:x")
    assert row["proof"] == []


def test_queries_equal_their_sql(spark, folder):
    found = compare(spark, folder, ["op11_hard_negatives", "op13_merkle_manifest"])
    assert all(v.startswith("ok") for v in found.values()), found

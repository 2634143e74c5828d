"""Operators on single texts, against libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from slotcast.llm import byte_bpe, jaccard, language, letters, packing, pieces, quality, spans, token_counts

ODD = [
    "", None, " ", "  ", "a", "a  b", "a \nb", "\n\na", "x<|endoftext|>y z", "<|endoftext|>",
    " <|endoftext|>  b", "don't we'll  x", "日本語　 　x", "\x1c a\x1cb !\x1c!", "a\x85\n\nb",
    "a   b", "'s 's", "a\tb\r\n c", "▁", "a▁b", "\x00x​z <s> </s> <0x41>", "ﬁ①Å🙂",
    " " * 100 + "x" + " " * 37, "word " * 3000, "unbroken" * 2000,
]
SCHEMA = "doc_id long, text string, k string, n long, length long"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts with extra columns whose names the operators use themselves."""
    rows = [(i, t, "x", 0, None) for i, t in enumerate(ODD)]
    rows += [(None, "a b", "x", 0, None), (4, "a", "x", 0, None), (4, "a", "x", 0, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def model():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path)


def test_token_counts(docs, nothing, bpe):
    got = sorted(map(tuple, token_counts.token_counts(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        n = len(bpe.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(nothing).collect() == []


ALPHABET = ["a", "th", "B", " ", "  ", "\n", " ", "é", "1", "!", "'s", "　", "\x85", "日", "▁"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*ALPHABET, "<|endoftext|>", "\x1c"])), max_size=6))
def test_chunks_have_the_ids_of_their_text(parts):
    texts = ["".join(p) for p in parts]
    encoder = byte_bpe.encoder()
    data, offsets = spans.utf8(pa.array(texts, pa.string()))
    row, start, length = encoder.locate(data, offsets)
    for i, text in enumerate(texts):
        own = row == i
        ids = encoder.runs.pool[spans.gather(start[own], length[own])].tolist()
        assert ids == encoder.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*ALPHABET, "ing", "er", "🙂", "<s>", "     "])))
def test_prefix_table_is_the_library(parts):
    text, own = "".join(parts), pieces.table()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["a", "b"])
    [(_, [(ids, decoded)])] = pieces._encoded(iter([batch]), pieces.MODEL)
    want = own.library.encode(text, add_bos=True, add_eos=True)
    assert ids.tolist() == want and decoded.decode() == own.library.decode(want)


def test_piece_digests(docs, nothing, model):
    got = sorted(map(tuple, pieces.digests(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        ids = model.encode(r.text or "", add_bos=True, add_eos=True)
        raw = np.array(ids, "<u4").tobytes()
        text = model.decode(ids).encode()
        sha = [hashlib.sha256(x).hexdigest() for x in (raw, text)]
        want.append((r.doc_id, len(ids), *sha))
    assert got == sorted(want, key=repr)
    full = pieces.encode_and_decode(docs.filter("doc_id = 10")).first()
    assert full.decoded == model.decode(full.ids)
    assert pieces.digests(nothing).collect() == []


def test_texts_are_decoded_from_the_ids(model, monkeypatch):
    """A lost run of ids shows in the decoded text."""
    texts = ["one two three", None, "", "  x \U0001f642 é\n", " ▁ a"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])

    def check():
        for _, rows in pieces._encoded(iter([batch]), pieces.MODEL):
            assert [t.decode() for _, t in rows] == [model.decode(ids.tolist()) for ids, _ in rows]
            yield from rows

    assert next(check())[1] == b"one two three"
    assert len(list(check())) == len(texts)
    locate = pieces.PieceTable.locate
    monkeypatch.setattr(
        pieces.PieceTable, "locate", lambda *a: tuple(x[1:] for x in locate(*a))
    )
    assert next(check())[1] != b"one two three"


def _thue_morse(length):
    """Words of two letters that collide in every polynomial hash modulo 2^64."""
    word = [bin(i).count("1") & 1 for i in range(length)]
    return "".join("ab"[x] for x in word), "".join("ba"[x] for x in word)


def test_regular_words_keep_hashes_of_their_own(spark, bpe, model):
    """Words of regular structure, alone, as chunks of ids, and next to each other."""
    for tables in (spans._SHARED, spans.PRIVATE):
        for length in (32, 64, 1024, 4096):
            pair = np.frombuffer("".join(_thue_morse(length)).encode(), np.uint8)
            ends = np.array([length, 2 * length])
            a, b = spans.span_hashes(pair, ends - length, ends, tables)
            assert a != b
    rows = [(i, t, "x", 0, None) for i, t in enumerate(_thue_morse(1024) + _thue_morse(4096))]
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    for r in token_counts.token_counts(frame).collect():
        assert r.n_tokens == len(bpe.encode(rows[r.doc_id][1], add_special_tokens=False).ids)
    for r in packing.token_pieces(frame).collect():
        ids = [*bpe.encode(rows[r.doc_id][1], add_special_tokens=False).ids, packing.END_ID]
        part = np.array(ids[r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes())
    for r in pieces.digests(frame).collect():
        ids = model.encode(rows[r.doc_id][1], add_bos=True, add_eos=True)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    sets = jaccard.near_duplicates(frame).collect()
    assert all(r.component_id == r.doc_id for r in sets)


def test_very_long_runs(spark, model):
    texts = [" " * 1_000_000, "a" + " " * 100_003 + "b", "é" * 1_000_000, "日本" * 300_000]
    frame = spark.createDataFrame([(i, t, "x", 0, None) for i, t in enumerate(texts)], SCHEMA)
    for r in pieces.digests(frame).collect():
        ids = model.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_all_given_documents_are_as_the_libraries_encode_them(spark, bpe, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in token_counts.token_counts(docs).collect():
        assert r.n_tokens == len(bpe.encode(texts[r.doc_id], add_special_tokens=False).ids)
    for r in pieces.digests(docs).collect():
        ids = model.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_run_table_starts_anew_when_full():
    table = spans.RunTable(most=4)
    for base in (0, 10):
        keys = np.arange(base, base + 3, dtype=np.uint64)
        new = table.missing(keys)
        table.add(keys[new], np.ones(len(new), np.int64), np.arange(len(new)))
        assert len(table.keys) == 3


def _optimum(items, capacity):
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                place(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_bin_completion_finds_the_optimum():
    rnd = random.Random(3)
    for _ in range(150):
        capacity = rnd.choice([10, 20, 50])
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 8))]
        plan = packing.complete_bins(Counter(items), capacity)
        held = Counter()
        for f in plan:
            assert sum(f.sizes) <= capacity
            for size in f.sizes:
                held[size] += f.repeat
        assert held == Counter(items)
        assert sum(f.repeat for f in plan) == _optimum(sorted(items)[::-1], capacity)
    assert packing.complete_bins({}) == []


def test_perfect_packings_are_found():
    """Instances cut from full sequences; the search never ends as exhausted above them."""
    rnd = random.Random(11)
    for _ in range(200):
        items, bins = [], rnd.randint(3, 12)
        for _ in range(bins):
            room = 1000
            while room:
                size = min(room, rnd.randint(rnd.choice([1, max(1, room // 6)]), room))
                items.append(size)
                room -= size
        plan = packing.complete_bins(Counter(items), 1000, steps=100_000)
        assert sum(f.repeat for f in plan) == bins
    known = [17, 93, 104, 169, 170, 172, 245, 481, 566, 983]
    assert sum(f.repeat for f in packing.complete_bins(Counter(known), 1000)) == 3


def test_fillings_come_by_waste_and_are_all_there():
    sizes, left = [2, 3, 5, 9], {2: 3, 3: 1, 5: 2, 9: 1}
    found = [f for f in packing._fillings(sizes, left, 12, lambda: 12) if f is not None]
    wastes = [12 - sum(f) for f in found]
    assert wastes == sorted(wastes) and len({tuple(f) for f in found}) == len(found)
    # Nothing that was left out fits into an undominated filling.
    full = {(9, 3), (5, 5, 2)}  # (5, 3, 2, 2) gives way to the latter
    assert {tuple(f) for f in found if sum(f) == 12} == full
    assert list(packing._fillings(sizes, left, 12, lambda: -1)) == []


def test_packing(docs, nothing, bpe):
    rows = packing.pack(docs, with_ids=True).collect()
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    pieces_of = Counter()
    for (doc, text), n in texts.items():
        ids = [*bpe.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) - 1024 * ((len(ids) - 1) // 1024)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            crc = zlib.crc32(np.array(ids[a:b], "<u4").tobytes())
            pieces_of[(doc, i, a, b - a, crc, tuple(ids[a:b]))] += n
    got = Counter(
        (r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows
    )
    assert got == pieces_of
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) == -(-sum(r.length for r in rows) // 1024)
    assert packing.pack(nothing).collect() == []


def _brute_counts(text):
    words = (text or "").encode().split()
    windows = Counter(zip(*[words[i:] for i in range(5)], strict=False))
    marked = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            marked.update(range(i, i + 5))
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    chars = sum(len(w.decode()) for w in words)
    signs = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), chars, signs, len(lines) - len(set(lines)), len(marked)


def test_quality_counts(spark, docs, nothing):
    more = ["a b c d e a b c d e f", "x\nx\n \nx y\n", "# $ | é ü", "a " * 9, "q " * 5]
    rows = [(100 + i, t, "x", 0, None) for i, t in enumerate(more)]
    all_docs = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    with_groups = all_docs.selectExpr("*", "'en' AS lang", "CAST(NULL AS string) AS source")
    got = quality.judge(with_groups).collect()
    texts = {r.doc_id: r.text for r in all_docs.collect()}
    assert len(got) == all_docs.count()
    for r in got:
        n, chars, signs, dup, repeat = _brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols) == (n, chars, signs)
        assert (r.n_dup_lines, r.n_repeat_words) == (dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert r.kept == (not r.base_failed)  # too few documents for limits
    empty = nothing.selectExpr("*", "'en' AS lang", "'s' AS source")
    assert quality.judge(empty).collect() == []
    assert quality.clean(empty).collect() == []


def test_quality_limits_follow_the_group(spark):
    """Symbols that are usual in one source are not in another."""
    plain = " ".join(f"word{i}" for i in range(12))
    signs = " ".join(f"word{i}$$" for i in range(12))
    rows = [(i, plain, "en", "a", "k") for i in range(250)]
    rows += [(1000 + i, signs, "en", "b", "k") for i in range(250)]
    rows += [(5000, signs, "en", "a", "k"), (5001, signs, "en", "tiny", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, l string")
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert kept[0] and kept[1000] and not kept[5000]
    assert kept[5001]  # judged by its language, half of which has symbols
    clean = quality.clean(docs)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, k in kept.items() if k}


def test_every_measure_rejects_an_outlier(spark):
    """Documents that pass the base rules, each far off its group in one measure."""
    rnd = random.Random(4)
    plain = ["\n".join(" ".join(f"w{rnd.randrange(10**6):06}" for _ in range(10)) for _ in range(12)) for _ in range(260)]
    words = plain[0].split()
    odd = {
        "repeats": " ".join(words[:100] + words[:10]),
        "dup_lines": "\n".join(f"{line}\nend" for line in plain[1].split("\n")),
        "symbols": " ".join(w + "#*" for w in words),
        "word_length": " ".join(w * 3 for w in words),
    }
    rows = [(i, t, "en", "s") for i, t in enumerate([*plain, *odd.values()])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(found[i].kept for i in range(len(plain)))
    for i, name in enumerate(odd, len(plain)):
        assert not found[i].base_failed and not found[i].kept, name


def test_buckets_are_close(spark):
    values = [0, 1, 63, 64, 127, 128, 129, 1000, 10**9]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for r in df.select("v", quality.bucket(df.v).alias("b")).collect():
        assert r.b <= r.v and r.v - r.b <= r.v / 64


def _phrases(word, text):
    count, at, word = 0, 0, f" {word} "
    while at < len(word):
        size = 1
        while at + size < len(word) and word[at : at + size + 1] in text:
            size += 1
        count, at = count + 1, at + size
    return count


@settings(max_examples=60, deadline=None)
@given(st.text("abcé", max_size=30), st.lists(st.text("abcdé", min_size=1, max_size=8), min_size=1))
def test_cross_parsing(reference, queries):
    reference = f" {reference} "
    parser = language.Parser({"x": reference, "y": " zz "})
    words = letters.words(pa.array([" ".join(queries)]))
    got = dict(zip(words.strings(), parser.phrases(words)[:, 0].tolist(), strict=True))
    assert got == {q: _phrases(q, reference) for q in queries}


def test_language(spark, nothing):
    text = {"en": "the house and the garden stood there", "de": "das haus und der garten standen dort"}
    rows = [(i, text["en" if i % 2 else "de"], "en" if i % 2 else "de") for i in range(40)]
    odd = [None, "", "1234 !?", "THE GARDEN", "der Garten " * 5000, "日本"]
    rows += [(100 + i, t, None) for i, t in enumerate(odd)] + [(None, "the house", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.judge(docs).collect()}
    assert [got[100 + i].lang_pred for i in range(5)] == ["und", "und", "und", "en", "de"]
    assert got[105].lang_pred == "de"  # no letter known: a tie
    assert got[100].score == 0 and 0.5 < got[103].score <= 1
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(40))
    assert got[None].held_out is False
    assert language.judge(nothing.selectExpr("*", "'en' AS lang")).collect() == []


def test_language_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = language.judge(docs).filter("held_out").join(docs, "doc_id")
    right = held.filter("lang = lang_pred").count()
    assert right >= 0.95 * held.count()

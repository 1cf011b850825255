"""Operators 11 to 13 against brute force and the library, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import piece_encoding, queries, spelling, vector_codes, work

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id bigint, embedding array<float>, label int, id string, v string, code string, error string, of string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, *"abcdef") for i, v, label in rows], VECTORS)


# ---------------------------------------------------------------- 11 vector codes


def quantised(rows, n_parts, n_entries, rounds, scale):
    """Plain Python of the contract: {place: (codes, error)} and the codebooks."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = -(-max(len(v) for _, v, _ in kept) // n_parts)
    full = [v + [0] * (d * n_parts - len(v)) for _, v, _ in kept]
    parts = [[v[p * d : (p + 1) * d] for p in range(n_parts)] for v in full]
    books = [[parts[r][p] for r in range(min(n_entries, len(parts)))] for p in range(n_parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min((far(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(n_parts):
            groups = collections.defaultdict(list)
            for r in range(len(parts)):
                groups[nearest(parts[r][p], books[p])[1]].append(parts[r][p])
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    out = []
    for (i, _, label), row in zip(kept, parts):
        best = [nearest(x, book) for x, book in zip(row, books)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(x for x, _ in best), label))
    per = collections.Counter()
    for _, _, error, label in out:
        per[label] += error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(str((i, code, error, per[label], digest)) for i, code, error, label in out)


def coded(df):
    return sorted(str((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in df.collect())


@pytest.mark.parametrize("n_entries", [1, 7, 64])
def test_codes_equal_brute_force(spark, n_entries):
    rng = random.Random(n_entries)
    rows = [(i, [round(rng.gauss(0, 0.2), rng.choice([1, 6])) for _ in range(rng.choice([12, 12, 9]))], rng.choice([None, 1, 1, 2, 3])) for i in range(150)]
    rows += [(None, [0.5] * 12, 9), (3, rows[3][1], 1), (1000, None, 1), (1001, [0.1, None], 1), (1002, [NAN] * 12, 1), (1003, [INF] * 12, 1), (1004, [], None), (-5, [-0.3] * 12, None)]
    got = coded(vector_codes.vector_codes(vectors(spark, rows).repartition(5), n_parts=4, n_entries=n_entries))
    assert got == quantised(rows, 4, n_entries, 2, 256)


def test_codes_of_equal_few_and_no_vectors(spark):
    same = [(i, [0.25] * 16, None) for i in range(5)]
    assert coded(vector_codes.vector_codes(vectors(spark, same))) == quantised(same, 16, 64, 2, 256)
    assert vector_codes.vector_codes(vectors(spark, [(1, None, 1), (2, [NAN], 1)])).collect() == []
    assert vector_codes.vector_codes(vectors(spark, [])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    huge = vector_codes.vector_codes(vectors(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)])).collect()
    assert len(huge) == 2  # held at the bounds, no overflow


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    entries, parts = rng.integers(-300, 300, (64, 4)), rng.integers(-300, 300, (500, 4))
    exact = ((parts[:, None] - entries) ** 2).sum(2)
    lower, upper = vector_codes.Cells.of(entries).bounds(parts)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower <= upper.min(1)[:, None]).mean() < 0.25  # most entries are never measured
    entry, distance = vector_codes.Cells.of(entries).nearest(parts)
    assert (entry == exact.argmin(1)).all() and (distance == exact.min(1)).all()


# ---------------------------------------------------------------- 12 pieces


@pytest.fixture(scope="module")
def model():
    return __import__("public_tokenizers").path(queries.PIECES)


@pytest.fixture(scope="module")
def library(model):
    return __import__("sentencepiece").SentencePieceProcessor(model_file=model)


ODD = [None, "", " ", "   ", "a", " a  b ", "▁a ▁", "\n\n", "a\x00b", "<s></s><unk><0x41>", "😀é中梦한‍﻿�", "x²½", "\r\n\t", "don't--stop...", "a" * 5000, " " * 700 + "x", "中" * 300, "=" * 999]


def test_pieces_equal_the_library(spark, model, library):
    rng = random.Random(5)
    letters = "aabcdeiinorst    ▁\n\t.,;()=1234éàç中国あ한😀_'\"-\\{}<>/*​\x00"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["the " * 60000]
    rows = [(i if i % 9 else None, t, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded string")
    got = collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in piece_encoding.encode(df, model, decoded=True).collect())
    want = collections.Counter((i, tuple(ids), library.decode(ids)) for i, t, *_ in rows for ids in [library.encode(t or "")])
    assert got == want
    back = piece_encoding.decode(piece_encoding.encode(df, model), model)
    assert collections.Counter((r.doc_id, r.decoded) for r in back.collect()) == collections.Counter({(i, d): 0 for i, _, d in want}) + collections.Counter((i, d) for i, _, d in want.elements())
    assert piece_encoding.encode(df.limit(0), model).collect() == []
    lists = spark.createDataFrame([(1, None), (2, [264, None, 999999, -1])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.decoded for r in piece_encoding.decode(lists, model).collect()} == {1: "", 2: library.decode([264, 0, 0, 0])}


def test_every_pair_test_equals_merging(model):
    """The test by the edges of two tokens against merging their characters one by one."""
    tables = piece_encoding.merges(open(model, "rb").read())
    rng = random.Random(3)
    tokens = [z for z in tables.symbols.values() if z in tables.split]
    assert len(tables.odd) < 50
    for _ in range(4000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if rng.random() < 0.5 and b in tables.split:
            a = rng.choice([a, tables.split[b][0]])
        assert tables.compatible(a, b) == (tables.simulate(tables.letters(a) + tables.letters(b))[0] == [a, b])


def test_memory_of_chunks_changes_nothing(spark, sf, model, library, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text]
    tables = piece_encoding.merges(open(model, "rb").read())
    for name, value in (("KEPT_CHUNKS", 50), ("BLOCK_CHARS", 4000), ("PART_CHARS", 700), ("KEPT_PAIRS", 2000)):
        monkeypatch.setattr(piece_encoding, name, value)
    encoder = piece_encoding.Encoder(tables)
    normal = [library.normalize(t) for t in texts]
    assert encoder.encode(normal) == library.encode(texts)
    assert encoder.encode(normal[::-1]) == library.encode(texts[::-1])
    assert tables.plain and all(n == "▁" + t.replace(" ", "▁") for n, t in zip(normal, texts))


def test_lookup_grows():
    table, have = piece_encoding.Lookup(2), {}
    rng = np.random.default_rng(2)
    for _ in range(20):
        new = np.setdiff1d(rng.integers(0, 1 << 40, 200), np.array(list(have), np.int64))
        table.put(new, np.arange(len(new), dtype=np.int32))
        have |= dict(zip(new.tolist(), range(len(new))))
    keys = np.array(list(have))
    assert table.get(keys).tolist() == list(have.values()) and (table.get(keys + (1 << 41)) == -1).all()


def test_piece_query(spark, sf, library):
    rows = {r.doc_id: r for r in queries.op12_piece_encoding(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids, sha = library.encode(r.text or ""), lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(rows[r.doc_id]) == (r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


# ---------------------------------------------------------------- 13 spelling


def near(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(rows, one_in=199, least_length=6, least_count=5, times=5):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_count}
    form, n_near = {}, {}
    for w in n:
        about = [x for x in n if near(w, x)]
        best = min(about, key=lambda x: (-n[x], x), default=None)
        n_near[w] = len(about)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], n_near[w], None if form[w] is None else n[form[w]]))
    return sorted(map(str, out))


def misspelt(seed, n_docs=200, one_word=30):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aabeé") for _ in range(rng.randint(3, 9))) for _ in range(25)]
    def put(w):
        if rng.random() < 0.35:
            p, c = rng.randrange(len(w)), rng.choice("abéÿ")
            return rng.choice([w[:p] + w[p + 1 :], w[:p] + c + w[p:], w[:p] + c + w[p + 1 :], w.upper(), w.title()])
        return w
    weights = [2 ** rng.uniform(0, 9) for _ in words]
    return [(i, " ".join(put(w) for w in rng.choices(words, weights, k=one_word))) for i in range(n_docs)]


DOCS = "doc_id bigint, text string, word string, n string, form string, root string, run string, h string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spelling_equals_brute_force(spark, seed):
    rows = misspelt(seed) + [(None, "ééabab " * 9 + "ééabaÿ÷×"), (7, None), (8, ""), (9, "12 .. -")] + [(5, "aabbaa " * 2000)] * 3
    df = spark.createDataFrame([(i, t, *"abcdef") for i, t in rows], DOCS).repartition(4)
    want = grouped(rows, one_in=19)
    assert sum("None" not in x for x in want) > 3
    assert sorted(str(tuple(r)) for r in spelling.spelling_variants(df, one_in=19).collect()) == want


def test_roots_of_long_ways(spark):
    """Forms that lead over several words: every word counts five times the one before."""
    words = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg"]
    rows = [(w,) for k, w in enumerate(words) for _ in range(5 ** (k + 1))]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "word string")).collect()}
    assert {got[w].root for w in words} == {words[-1]} and [got[w].form for w in words] == [*words[1:], None]
    for n in (1, 2, 3, 6, 17):
        chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "word int, form int")
        assert {r.root for r in spelling.roots(chain, n).collect()} == {n}


def test_spelling_of_nothing_and_a_crowded_set(spark, monkeypatch):
    empty = spark.createDataFrame([], DOCS)
    assert spelling.spelling_variants(empty).collect() == []
    assert spelling.variants(spark.createDataFrame([(None,), ("short",)] * 9, "word string")).collect() == []
    rows = misspelt(4)
    df = spark.createDataFrame([(i, t, *"abcdef") for i, t in rows], DOCS)
    want = grouped(rows)
    monkeypatch.setattr(spelling, "LEAST_BITS", 7)
    monkeypatch.setattr(spelling, "MOST_BITS", 7)
    monkeypatch.setattr(spelling, "BLOCK_CANDIDATES", 100)
    assert sorted(str(tuple(r)) for r in spelling.spelling_variants(df).collect()) == want


def test_neighbourhoods_are_whole_and_distinct():
    letters = "abé"
    alphabet = np.array([ord(c) for c in letters], np.uint64)
    for w in ("aab", "é", "abba", "aaaaaa"):
        (_, codes), = spelling._by_length([w])
        made = [h[d] for _, h, d in spelling._neighbourhood(codes, alphabet)]
        found = np.concatenate(made)
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for c in letters for k in (0, 1) for i in range(len(w) + 1 - k)} - {w}
        assert len(found) == len(set(found.tolist())) == len(want)
        codes_of = lambda x: int(spelling._hashes(np.array([[ord(c) for c in x]], np.uint64))[0]) if x else 0
        assert set(found.tolist()) == {codes_of(x) for x in want}


def test_bit_set_is_packed_by_tasks(spark, monkeypatch):
    """The set is right over many packed rows, and what reaches the driver is no row for each of its places."""
    from pyspark.sql import DataFrame

    monkeypatch.setattr(spelling, "PACKED", 1 << 6)
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: pytest.fail("the whole set at once"))
    words = [f"word{i}" for i in range(5000)]
    held = spelling.bit_set(spark.createDataFrame([(w,) for w in words], "word string").repartition(7), len(words))
    want = np.zeros(8 * len(held), bool)
    for _, codes in spelling._by_length(words):
        want[spelling._slots(spelling._hashes(codes), len(want).bit_length() - 1)] = True
    assert (np.unpackbits(held, bitorder="little") == want).all()

"""Each operator against a brute-force version or an exact round trip, and its edge cases: nulls, empty
and long texts, ties, repeated rows, empty tables, clashing extra columns."""

import base64
import collections
import hashlib
import json
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, kernel, licenses, line_dedup, lm_score, minhash, mixing, queries, token_counts, topk, toxicity, warc, work

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score string, size string, owner string, key string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", "x", "x", "x", "x") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


def split(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


EDGE = [(1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "A bé 　c\x0bd", "b"), (5, "x", "b"), (5, "x", "b"), (None, "x y", "b"), (6, "long " * 5000 + "end", "a")]


@pytest.fixture(scope="module")
def edge(spark):
    return docs(spark, EDGE).cache()


# ---------------------------------------------------------------- kernel


def test_words_are_those_of_the_pattern():
    texts = [None, "", " a", "A\tb\x0b\x0cC\r\n d ", "　x y ÉA", "a" * 5000]
    w = kernel.words(pa.array(texts))
    got = [[w.data[a:b].tobytes() for a, b in zip(w.at[i:j], w.at[i + 1 : j + 1])] for i, j in zip(w.first, w.first[1:])]
    lower = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    assert got == [[lower(x) for x in WORD.findall((t or "").encode())] for t in texts]
    flat = [x for row in got for x in row]
    assert len(set(w.hashes().tolist())) == len(set(flat))
    sliced = kernel.words(pa.array(["zz", *texts]).slice(1))
    assert (sliced.hashes() == w.hashes()).all()


def test_ngrams():
    h = np.arange(1, 8, dtype=np.uint64)
    gram, text = kernel.ngrams(h, np.array([0, 5, 5, 7]), 3, whole=True)
    assert collections.Counter(text.tolist()) == {0: 3, 1: 1, 2: 1} and len(set(gram.tolist())) == 5


def test_scratch_tables_go(spark):
    with work.scratch():
        gone = work.written(spark.range(3), "a")
        kept = work.written(gone.where("id > 0"), "b", keep=True)
        folder = gone.inputFiles()[0].rsplit("/", 1)[0]
        assert work.exists(spark, folder, "part-*")
    assert kept.count() == 2 and not work.exists(spark, folder, "part-*")


# ---------------------------------------------------------------- 1 line dedup


def shared_places(mine, earlier, least=line_dedup.BLOCK_WORDS):
    """Places of ``mine`` in stretches of at least ``least`` words that an earlier text has: every pair of
    documents, every pair of places."""
    ls = [(k, x.strip(" ")) for k, x in enumerate((mine or "").split("\n")) if x.strip(" ")]
    out = set()
    for other in earlier:
        theirs = [x.strip(" ") for x in (other or "").split("\n") if x.strip(" ")]
        for i in range(len(ls)):
            for j in range(len(theirs)):
                if i and j and ls[i - 1][1] == theirs[j - 1]:
                    continue
                n = 0
                while i + n < len(ls) and j + n < len(theirs) and ls[i + n][1] == theirs[j + n]:
                    n += 1
                if sum(len(x.split(" ")) for _, x in ls[i : i + n]) >= least:
                    out |= {k for k, _ in ls[i : i + n]}
    return out


def uncut(t, places):
    return "\n".join(x for k, x in enumerate(t.split("\n")) if k not in places)


def test_line_dedup(spark, edge):
    rng = random.Random(5)
    passage = [prose(rng, 30, 9999), prose(rng, 25, 9999)]
    single = [prose(rng, 8, 9999) for _ in range(5)]
    verse = [prose(rng, 4, 9999) for _ in range(15)]
    rows = []
    for i in range(60):
        own = [prose(rng, rng.randint(3, 12), 9999) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = passage
        if i % 7 == 0:
            own = passage[::-1] + own
        if i < 5:  # the lines of a later passage, each in a document of its own
            own.insert(0, single[i])
        if i in (10, 11, 12):
            own[1:1] = [*single[:3], "", *single[3:]]
        rows.append((i, "\n".join(own), "s"))
    rows += [(100 + i, rows[1][1], "s") for i in range(5)] + [(200, "short one", "s"), (201, "short one", "s")]
    # a passage of short lines in more documents than any limit of rarity
    rows += [(1000 + i, "\n".join([f"own {i}", *verse, f"end {i}"]), "s") for i in range(90)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        want = shared_places(t, [x for k, x, _ in rows if k < i])
        assert got[i].text == uncut(t, want) and got[i].removed_lines == len(want), i
        assert got[i].n_lines == len(t.split("\n")) and (got[i].owner is None) == (not want)
    assert sum(passage[0] in r.text for r in got.values()) == 1 and got[201].text == "short one"
    assert got[11].removed_lines == 5 and sum(verse[7] in r.text for r in got.values()) == 1
    same = {(r.doc_id, r.text) for r in line_dedup.line_dedup(edge).collect()}
    assert same == {(i, t) for i, t, _ in EDGE}
    cut = line_dedup.cut(docs(spark, rows))
    assert cut.columns == docs(spark, rows).columns and cut.where("n_chars <> length(text) OR owner <> 'x'").count() == 0
    assert line_dedup.line_dedup(edge.limit(0)).count() == 0


def test_line_dedup_repeated_ids_and_names(spark):
    """Rows that share an id are cut each by its own places; columns named like the operator's stay."""
    rng = random.Random(6)
    long = [prose(rng, 9, 9999) for _ in range(5)]
    rows = [(1, "\n".join(long)), (2, "\n".join(["x", *long])), (2, "alpha\nbeta\ngamma\ndelta\nepsilon\nzeta"), (2, "\n".join(["x", *long])), (None, "\n".join(long))]
    table = spark.createDataFrame([(i, t, "m", "i", "k", "w") for i, t in rows], "doc_id bigint, text string, _mask string, _id string, line_dedup_mask string, `a b` string")
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.line_dedup(table).collect())
    assert got == sorted([(0, "\n".join(long)), (1, "\n".join(long)), (2, "x"), (2, "x"), (2, rows[2][1])])
    assert line_dedup.cut(table).columns == table.columns
    assert {(r["_mask"], r["_id"], r["line_dedup_mask"], r["a b"]) for r in line_dedup.line_dedup(table).collect()} == {("m", "i", "k", "w")}
    named = spark.createDataFrame([("a", "\n".join(long)), ("b", "\n".join(long[::-1]))], "doc_id string, text string")
    assert {(r.doc_id, r.removed_words) for r in line_dedup.line_dedup(named).collect()} == {("a", 0), ("b", 0)}
    twice = spark.createDataFrame([("a", "\n".join(long)), ("b", "\n".join(long))], "doc_id string, text string")
    assert {(r.doc_id, r.removed_words, r.owner) for r in line_dedup.line_dedup(twice).collect()} == {("a", 0, None), ("b", 45, "a")}


def test_line_dedup_of_few_lines_that_recur(spark):
    """Where lines recur in any order: nothing unshared goes, and no shared stretch stays whole."""
    rng = random.Random(7)
    alphabet = [prose(rng, 7, 9999) for _ in range(6)]
    rows = [(i, "\n".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))), "s") for i in range(60)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    masks = {r.id: r.mask for r in line_dedup.overlaps(docs(spark, rows)).collect()}
    lost = 0
    for i, t, _ in rows:
        earlier = [x for k, x, _ in rows if k < i]
        gone = {k for k, x in enumerate(masks.get(i, [])) if x}
        assert gone <= shared_places(t, earlier) and got[i].text == uncut(t, gone)
        lost += len(gone)
        lines = t.split("\n")
        for a in range(len(lines) - 2):
            run = lines[a : a + 3]
            if not gone & {a, a + 1, a + 2}:
                assert not any(x.split("\n")[k : k + 3] == run for x in earlier for k in range(len(x.split("\n")) - 2))
    assert lost > 100


def test_patience():
    a, b = np.array([1, 2, 3, 4, 9, 5]), np.array([7, 1, 2, 8, 4, 9, 5])
    assert line_dedup.patience(a, b) == [(0, 1), (1, 2), (3, 4), (4, 5), (5, 6)]
    assert line_dedup.patience(np.array([1, 1]), np.array([1, 1, 1])) == [(0, 0), (1, 1)]
    rng = random.Random(1)
    for _ in range(200):
        x, y = ([rng.randint(0, 9) for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = line_dedup.patience(np.array(x, np.int64), np.array(y, np.int64))
        assert all(x[i] == y[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


# ---------------------------------------------------------------- 2 decontamination


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_scores():
    rng = random.Random(2)
    pairs = [([rng.randint(0, 5) for _ in range(rng.randint(1, 12))], [rng.randint(0, 5) for _ in range(rng.randint(1, 20))]) for _ in range(300)]
    best, low, high = decontaminate.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    for (a, b), s, lo, hi in zip(pairs, best, low, high):
        assert s == smith_waterman(a, b) == smith_waterman(a, b[lo:hi])


def test_decontamination(spark, edge):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randint(8, 40))) for k in range(12)] + [(20, "only three words"), (21, None), (22, "")]
    rows = []
    for i in range(150):
        w = prose(rng, rng.randint(30, 200)).split()
        if i % 3 == 0:
            copy = items[i % 12][1].split()
            copy = [f"new{rng.randint(0, 99)}" if rng.random() < (i % 5) * 0.06 else x for x in copy]
            at = rng.randint(0, len(w))
            w[at:at] = copy
        rows.append((i, " ".join(w), "s"))
    rows.append((300, "before only THREE words, after", "s"))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs(spark, rows), benchmark).collect()}
    clean = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = {}
    for i, t, _ in rows:
        for k, x in items:
            a = clean(x)
            b, n = clean(t), min(len(a), decontaminate.SEED_WORDS)
            shared = {tuple(a[j : j + n]) for j in range(len(a) - n + 1)} & {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if a else ()
            if shared and (s := smith_waterman(a, b) / (2 * len(a))) >= decontaminate.LEAK:
                want[i, k] = s
    assert got == pytest.approx(want) and (300, 20) in got and len(want) >= 50
    blocks = decontaminate.leaks(docs(spark, rows), benchmark, block_words=60)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == set(want)
    assert decontaminate.leaks(edge, benchmark).count() == 0
    assert decontaminate.leaks(edge, benchmark.limit(0)).count() == 0 and decontaminate.leaks(edge.limit(0), benchmark).count() == 0
    kept = decontaminate.keep_clean(docs(spark, rows), benchmark)
    assert kept.columns == docs(spark, rows).columns and {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows} - {i for i, _ in want}


def test_edited_copies_leak(spark):
    """Sole copies with every 5th word replaced, and texts whose only seeds are common phrases."""
    rng = random.Random(3)
    texts = [prose(rng, 40, 99999).split() for _ in range(8)]
    rows = []
    for i, w in enumerate(texts):
        copy = [f"new{k}" if k % 5 == 4 else x for k, x in enumerate(w)]
        rows.append((i, " ".join([*prose(rng, 30, 99999).split(), *copy]), "s"))
    # half of item 8 stands in many texts, all of it in one
    both = prose(rng, 41, 99999).split()
    rows += [(100 + i, f"x{i} " + " ".join(both[:21]) + f" y{i}", "s") for i in range(30)] + [(200, " ".join(both), "s")]
    # a common phrase of item 8, and no more of it, is no leak
    rows += [(300 + i, f"x{i} " + " ".join(both[:4]) + f" y{i}", "s") for i in range(5)]
    items = [(i, " ".join(w)) for i, w in enumerate([*texts, both])]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(i, i) for i in range(8)} | {(100 + i, 8) for i in range(30)} | {(200, 8)}


# ---------------------------------------------------------------- 3 token counts


def test_token_counts(spark, edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    plain = Tokenizer.from_file(path)
    rows = EDGE + [(7, "a<|endoftext|>b  c\n\n d's 12é " * 9000, "a"), (8, "中文" * 40000, "a"), (9, " \n  x" * 30000, "a")]
    got = token_counts.token_counts(docs(spark, rows), path, split_bytes=500, batch_bytes=2000).collect()
    want = sorted((i or 0, len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False))) for i, t, _ in rows)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(edge.limit(0), path).count() == 0


def test_special_strings_with_space_are_not_split():
    import public_tokenizers

    spec = json.load(open(public_tokenizers.path(queries.TOKENIZER)))
    assert token_counts._load(json.dumps(spec))[1]
    spec["added_tokens"][0]["content"] = "a b"
    assert not token_counts._load(json.dumps(spec))[1]


# ---------------------------------------------------------------- 4 toxicity


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(4)
    bad = ["grumbletoad", "snarkfiend", "blathercock"]
    rows, labels = [], []
    for i in range(900):
        w = prose(rng, rng.randint(5, 400), 2000).split()
        y = int(i % 4 == 0)
        if y:
            for _ in range(max(1, len(w) // 40)):
                w.insert(rng.randint(0, len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, y))
    rows += [(2000, " ".join(prose(rng, 60, 2000).split() + ["grumbletoads", "snarkfiendish"]), "s"), (2001, prose(rng, 60, 2000), "s"), (2002, None, "s"), (2003, "", "s")]
    return docs(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (3000, 1, None)], "doc_id bigint, quality int, toxic int"), {i: y for i, _, y in labels}


def test_toxicity(marked):
    d, labels, truth = marked
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert got[2000].predicted == 1 and got[2001].predicted == 0 and 0 <= got[2002].score == got[2003].score <= 1
    # held-out labels change nothing
    other = labels.withColumn("toxic", F.when(toxicity.learns("doc_id"), F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(d, other).collect()} == {i: r.score for i, r in got.items()}
    kept = toxicity.keep_clean(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0}


def grams_of(word):
    """A word's features as text: itself and the 3- to 5-grams of it between its ends' marks."""
    marked = f"<{word}>"
    return [word] + [marked[k : k + n] for n in (3, 4, 5) for k in range(len(marked) - n + 1)]


def test_toxicity_scores(marked):
    """Every score from the model's table in plain Python: the highest average over windows of words."""
    d, labels, _ = marked
    model = toxicity.fit(d, labels)
    known = {}

    def features(word):
        if word not in known:
            bucket, first = toxicity.word_features(pa.array([word]))
            assert len(bucket) == len(grams_of(word)) == first[1]
            known[word] = bucket.tolist()
        return known[word]

    mine = {r.doc_id: r.score for r in toxicity.toxicity(d, labels).collect()}
    texts = {r.doc_id: r.text for r in d.collect()}
    for i in [*range(0, 900, 9), 2000, 2001, 2002, 2003]:
        w = re.findall(r"[^\s!-/:-@\[-`{-~]+", (texts[i] or "").lower())
        parts = max(1, round(len(w) / toxicity.WINDOW))
        averages = []
        for k in range(parts):
            bag = {x for j, x in enumerate(w) if j * parts // len(w) == k}
            held = [b for x in bag for b in features(x)]
            averages.append(sum(float(model.margin[b]) for b in held) / (len(held) + toxicity.PADDING))
        assert mine[i] == pytest.approx(1 / (1 + math.exp(-max(averages) - model.bias)), abs=1e-5), i


def test_toxicity_edges(spark, edge):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(edge, none).collect()
    assert len(got) == len(EDGE) and len({r.score for r in got}) == 1
    assert toxicity.toxicity(edge.limit(0), none).count() == 0


# ---------------------------------------------------------------- 5 licenses


def test_licenses(spark, edge, sf):
    rows = [(1, "Licensed under the Apache License, Version 2.0.", "r"), (2, "code only", "r"), (3, "x\n\nReleased under the MIT License. " + "more " * 900, "r"), (4, "nothing", "r"), (5, "we license nothing to nobody in this very long sentence about gardens", "r")]
    path = F.element_at(F.create_map(*[F.lit(x) for kv in {1: "a/LICENSE", 2: "a/b/c.py", 3: "a/b/d.py", 4: "z/e.py", 5: "z/f.py"}.items() for x in kv]), F.col("doc_id").cast("int"))
    got = {r.doc_id: (r.license, r.found) for r in licenses.scan(docs(spark, rows), path).collect()}
    assert got == {1: ("Apache-2.0", "file"), 2: ("Apache-2.0", "inherited"), 3: ("MIT", "header"), 4: (None, "none"), 5: (None, "none")}
    names = licenses.scan(docs(spark, [(i, t, "r") for i, (_, t) in enumerate(licenses.ALL_TEMPLATES)]), F.lit(None).cast("string")).collect()
    assert all(r.license == licenses.ALL_TEMPLATES[r.doc_id][0] for r in names)
    assert all(r.found == "none" for r in licenses.scan(edge, F.lit(None).cast("string")).collect())
    assert licenses.scan(edge.limit(0), F.lit("a/b")).count() == 0


def test_license_files(spark):
    """Full texts, wrapped and with other names and years, are files and govern the nested paths."""
    texts = dict(licenses.FULL_TEXTS)
    rewrap = lambda t, n: re.sub(r"((?:\S+\s+){%d})" % n, lambda m: " ".join(m[1].split()) + "\n", t)
    rows, want, k = [], {}, 0
    for name, text in texts.items():
        if name == "AGPL-3.0":
            continue
        for body in (text, f"Copyright (c) 2019 Ada Example and contributors\n\n{rewrap(text, 9)}"):
            rows += [(10 * k, body, f"r{k}/LICENSE"), (10 * k + 1, "code only", f"r{k}/src/deep/a.py"), (10 * k + 2, "no path above", f"s{k}/a.py")]
            want |= {10 * k: (name, "file"), 10 * k + 1: (name, "inherited"), 10 * k + 2: (None, "none")}
            k += 1
    rows += [(9000, "# Released under the\n# MIT License.\n\nimport os", "t/a.py"), (9001, "x = 1\n\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n\n" + "value of code " * 300, "t/b.py"), (9002, texts["MIT"] + " unrelated words about gardens and weather" * 400, "t/c.py")]
    want |= {9000: ("MIT", "file"), 9001: ("Apache-2.0", "header")}
    table = spark.createDataFrame(rows, "doc_id bigint, text string, where string")
    got = {r.doc_id: (r.license, r.found) for r in licenses.scan(table, F.col("where")).collect()}
    assert {i: x for i, x in got.items() if i != 9002} == want and got[9002][1] == "header"


# ---------------------------------------------------------------- 6 WARC


def test_warc(spark):
    rows = [(1, "http://a/é \r\nX: 1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 300_000), (None, "u", "<p>é</p>"), (7, "u", "solo"), (7, "u", "solo")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("id", F.lit("x"))
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    best = {}
    for i, _, t in rows:
        best[t or ""] = max(best.get(t or "", 0), i or 0)
    want = sorted((i or 0, len((t or "").encode()), sha(t), "response" if i == best[t or ""] else "revisit", None if i == best[t or ""] else best[t or ""]) for i, _, t in rows)
    assert got == want
    path = work.new_path(spark, "warc")
    warc.write_archives(pages, path, min_bytes=5)
    many = work.new_path(spark, "warc")
    warc.write_archives(pages.coalesce(1), many, row_bytes=100, archive_rows=2)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(many).collect()
    assert len(files) > 2 and all(bytes(f.content[:4]) == bytes.fromhex("5d2a4d18") for f in files) and warc.read_archives(spark, many).count() == len(rows)
    back = warc.read_archives(spark, path)
    assert {r.page: bytes(r.payload).decode() for r in back.where("record_type = 'response' AND page <> '7'").collect()} == {"2": "<p>é</p>", "3": "", "4": "", "5": "z" * 300_000}
    assert back.where("record_type = 'revisit'").count() == 2
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_plain_zstandard(spark, sf):
    """Any decoder reads an archive: a dictionary in the leading skippable frame, a frame for each record."""
    import zstandard

    path = work.new_path(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{sf}/pages.parquet").coalesce(1), path)
    content = bytes(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).first().content)
    assert content[:4] == bytes.fromhex("5d2a4d18")
    n = int.from_bytes(content[4:8], "little")
    book = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content[8 : 8 + n]))
    reader = zstandard.ZstdDecompressor(dict_data=book).stream_reader(content[8 + n :], read_across_frames=True)
    whole = reader.read()
    assert whole.count(b"WARC/1.1\r\n") == spark.read.parquet(f"{sf}/pages.parquet").count()
    damaged = [*warc.frames(content)][0].replace(b"WARC/1.1", b"WARC/9.9")
    with pytest.raises(ValueError):
        warc.parse(damaged)


# ---------------------------------------------------------------- 7 LM scores


def test_lm_scores(spark, edge, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionAll(edge.select("doc_id", "text"))
    got = lm_score.lm_scores(table.withColumn("key", F.lit("x"))).collect()
    rows = table.collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    lower = lambda t: [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in WORD.findall((t or "").encode())] + [b"\n"]
    c = collections.Counter(w for r in rows if not out(r.doc_id) for w in lower(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((r.doc_id if r.doc_id is not None else -1, out(r.doc_id), len(lower(r.text)), sum(c[w] > 0 for w in lower(r.text)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in lower(r.text)), 4)) for r in rows)
    mine = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)
    assert [m[:5] for m in mine] == [w[:5] for w in want] and all(abs(m[5] - w[5]) < 2e-4 * max(1, abs(w[5])) for m, w in zip(mine, want))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_score.lm_scores(edge.limit(0)).count() == 0


def test_lm_scores_are_those_of_the_model(spark, sf):
    """Scores of texts in plain Python: a softmax over all symbols for each token, and inside a class the
    word's share of its smoothed counts."""
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(150)
    training = ~lm_score.held_out("doc_id")
    rows = table.collect()
    got = {r.doc_id: r.score for r in lm_score.lm_scores(table).collect()}
    vocabulary, _, _, n, _ = lm_score.vocabulary_of(lm_score.word_counts(table, "text", training))
    model = lm_score.fit(table, "doc_id", "text", training, vocabulary, n)
    counts = collections.Counter(w for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10 for w in split(r.text))
    place = {w: i for i, w in enumerate(vocabulary.words)}
    own = {w.encode(): i for w, i in place.items()}
    classes = lambda w: int(lm_score.ending_class(pa.array([w.decode()], pa.large_string()))[0])
    mass = np.zeros(lm_score.CLASSES)
    for w, c in counts.items():
        if w not in own:
            mass[classes(w)] += c + lm_score.ALPHA
    mass += lm_score.ALPHA
    for r in sorted(rows, key=lambda r: len(r.text))[:25]:
        w = split(r.text)
        symbols = [own.get(x, len(own) + classes(x)) for x in w] + [vocabulary.size - 1]
        total = 0.0
        for k, s in enumerate(symbols):
            before = [symbols[k - 1 - j] if k - 1 - j >= 0 else vocabulary.size for j in range(lm_score.CONTEXT)]
            hidden = sum(model.c[j].astype(float) * model.r[c].astype(float) for j, c in enumerate(before))
            score = model.q.astype(float) @ hidden + model.b
            total += (score[s] - np.log(np.exp(score - score.max()).sum()) - score.max()) / math.log(10)
            if k < len(w) and w[k] not in own:
                total += math.log10((counts[w[k]] + lm_score.ALPHA) / mass[classes(w[k])])
        assert got[r.doc_id] == pytest.approx(total, rel=1e-4, abs=1e-3), r.doc_id


def test_lm_learns_every_token(spark):
    """What follows what at places that no stride of 16 from 0 or 7 meets."""
    line = " ".join("x" if k in (0, 7) else f"u{k}" for k in range(16))
    table = docs(spark, [(0, " ".join([line] * 4000), "s")])
    vocabulary, *_ = lm_score.vocabulary_of(lm_score.word_counts(table, "text", F.lit(True)))
    model = lm_score.fit(table, "doc_id", "text", F.lit(True), vocabulary, 64000)
    symbol, first, *_ = lm_score.encode(pa.array([" ".join([line] * 20)]), vocabulary)
    log_p = model.token_log_probs(lm_score.contexts(symbol, first, vocabulary.size), symbol)[2:-1]
    other = [k for k in range(len(log_p)) if (k + 2) % 16 not in (0, 7)]
    assert log_p[other].mean() > -0.5


def test_lm_scores_do_not_depend_on_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 30_000)
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(300)
    one, other = ({r.doc_id: r.score for r in lm_score.lm_scores(t).collect()} for t in (table.coalesce(1), table.orderBy(F.desc("doc_id")).repartition(5)))
    assert one == pytest.approx(other, rel=1e-5)
    texts = pa.array(["a" * k for k in range(1, 60)])
    whole = [(0, b.to_pylist()) for _, b in lm_score._texts(iter([pa.RecordBatch.from_arrays([pa.array([0] * 59), texts], ["s", "t"])]), 100)]
    parts = [pa.RecordBatch.from_arrays([pa.array([0] * 7), texts.slice(k, 7)], ["s", "t"]) if k + 7 <= 59 else pa.RecordBatch.from_arrays([pa.array([0] * (59 - k)), texts.slice(k)], ["s", "t"]) for k in range(0, 59, 7)]
    assert [(s, b.to_pylist()) for s, b in lm_score._texts(iter(parts), 100)] == whole and sum((b for _, b in whole), []) == texts.to_pylist()


def test_lm_probabilities_sum_to_one():
    words = [f"w{i}" for i in range(50)]
    vocabulary = lm_score.Vocabulary(words, np.ones(50 + lm_score.CLASSES + 1), np.full(lm_score.CLASSES, 7.0))
    model = lm_score.initial(vocabulary)
    rng = np.random.default_rng(0)
    symbol, first, *_ = lm_score.encode(pa.array([" ".join(rng.choice(words, 300)), "zzz w1"]), vocabulary)
    model = lm_score.train(model, vocabulary, lm_score.contexts(symbol, first, vocabulary.size), symbol, 1)
    context = rng.integers(0, vocabulary.size + 1, (20, lm_score.CONTEXT))
    log_p = model.log_probs(context)
    assert np.allclose(np.exp(log_p).sum(axis=1), 1, atol=1e-4)
    target = rng.integers(0, vocabulary.size, 20)
    assert np.allclose(model.token_log_probs(context, target), log_p[np.arange(20), target], atol=1e-5)


def test_nce_learns_what_follows():
    words = ["a", "b", "c", "d"]
    vocabulary = lm_score.Vocabulary(words, np.r_[np.full(4, 1000.0), np.zeros(lm_score.CLASSES), 1], np.ones(lm_score.CLASSES))
    symbol, first, *_ = lm_score.encode(pa.array(["a b c d " * 3000]), vocabulary)
    context = lm_score.contexts(symbol, first, vocabulary.size)
    model = lm_score.initial(vocabulary)
    before = model.token_log_probs(context, symbol).mean()
    after = lm_score.train(model, vocabulary, context, symbol, 1).token_log_probs(context, symbol).mean()
    assert before < -1.3 and after > -0.4


# ---------------------------------------------------------------- 8 mixing


def fill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        rest = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mixing(spark, edge):
    rng = random.Random(6)
    rows = [(i + 10000, prose(rng, rng.randint(0, 30)), rng.choice(["a", "B", "é", None, "z"] + ["hot"] * 6)) for i in range(600)] + EDGE
    d = docs(spark, rows)
    got = mixing.mix(d).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(split(t))
    want = fill(sizes)
    by_id = {i: s for i, _, s in rows if i is not None}
    taken = collections.Counter()
    for r in got:
        if r.doc_id is not None:
            s = by_id[r.doc_id]
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        else:
            s = "b"
        taken[s] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    order = mixing.schedule(d).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and sum(r.taken for r in order) == sum(r.taken for r in got)
    assert sorted(r.position for r in order) == sorted(x for r in got for x in (r.position, r.position_2, r.position_3) if x is not None)
    assert all((r.position_3 is None or r.position_2 < r.position_3) and (r.position_2 is None or r.position < r.position_2) for r in got)
    assert any(r.position_2 is not None for r in got)
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    again = mixing.mix(d.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(edge.limit(0)).count() == 0


# ---------------------------------------------------------------- 9 top-k


def test_topk(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(400, 8)) * 0.4
    v[rng.random(v.shape) < 0.6] = 0.0
    v[7] = v[9] = v[11]
    rows = [(int(i), [float(x) for x in np.float32(r)], 1) for i, r in enumerate(v)]
    rows += [(500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 8, 1), (520, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (540, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int").repartition(5)
    w = {i: [math.floor(64 * x) for x in e] + [0] * (8 - len(e)) for i, e, _ in rows[:400]} | {540: [64, 128, 0, 0, 0, 0, 0, 0]}
    for block in (8192, 3):
        got = topk.top_k(table, F.col("vec_id") % 20 == 0, k=20, query_block=block).collect()
        want = set()
        for q in w:
            if q % 20 == 0:
                best = sorted((-sum(a * b for a, b in zip(w[q], w[c])), c) for c in w if c != q)[:20]
                want |= {(q, n, c, -s) for n, (s, c) in enumerate(best, 1)}
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_scattered_postings_equal_products():
    rng = np.random.default_rng(3)
    for fill_share in (0.1, 0.9):
        a, b = (rng.integers(-50, 50, (30, 12)) * (rng.random((30, 12)) < fill_share) for _ in range(2))
        assert (topk.Postings(a).scores(b) == a @ b.T).all()
    far = np.array([[3 * 10**15, -3 * 10**15, 5, 5, 3 * 10**15, 7]]).T
    row, at, score = topk.merged(topk.best(far, np.arange(6), np.array([5]), 3), 3)
    assert (at.tolist(), score.tolist()) == ([0, 4, 2], [3 * 10**15, 3 * 10**15, 5])
    huge = np.full((2, 3), 1 << 40)
    assert (topk.Postings(huge).scores(np.full((1, 3), 1 << 20)) == 3 << 60).all()


# ---------------------------------------------------------------- 10 MinHash


def weighted(text):
    w = split(text)
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])


def test_signatures_are_unbiased():
    rng = random.Random(1)
    z = []
    for _ in range(25):
        a = collections.Counter({rng.randint(0, 40): rng.choice([1, 1, 2, 3, 9, 40]) for _ in range(rng.randint(3, 40))})
        b = +collections.Counter({k: rng.choice([v, v, 0, 1, 8, 50]) for k, v in a.items()})
        if not b or a == b:
            continue
        ids = [np.array(sorted(c), np.uint64) for c in (a, b)]
        text = np.r_[np.zeros(len(ids[0]), int), np.ones(len(ids[1]), int)]
        times = np.array([a[int(k)] for k in ids[0]] + [b[int(k)] for k in ids[1]])
        s = minhash.bag_minhash(text, np.concatenate([kernel.mix(k + np.uint64(1)) for k in ids]), times, 2, 3000)
        true = sum((a & b).values()) / sum((a | b).values())
        if 0 < true < 1:
            z.append(((s[0] == s[1]).mean() - true) / math.sqrt(true * (1 - true) / 3000))
    assert abs(np.mean(z)) < 0.8 and 0.5 < np.std(z) < 1.6


def test_near_duplicates(spark, edge):
    rng = random.Random(10)
    rows, i = [], 10000
    for group in range(12):
        base = prose(rng, 120, 5000).split()
        for _ in range(rng.choice([1, 2, 5, 60])):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 9999)}"
            rows.append((i, " ".join(w), "s"))
            i += 1
    rows += [(20000 + k, rows[0][1], "s") for k in range(40)] + [(2000, "a a a a a a a b", "s"), (2001, "a a a a a a a a b", "s"), (2002, "Few Words", "s"), (2003, "few  words", "s")]
    rows += EDGE
    got = {}
    for r in minhash.near_duplicates(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r.class_id)
    keyed = [(i, t) for i, t, _ in rows if t is not None]
    parent = {t: t for _, t in keyed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {t: weighted(t) for t in parent}
    names = list(parent)
    for x in range(len(names)):
        for y in range(x):
            a, b = bags[names[x]], bags[names[y]]
            low = sum((a & b).values())
            if low / (sum(a.values()) + sum(b.values()) - low) >= 0.8:
                parent[root(names[x])] = root(names[y])
    least = {}
    for i, t in keyed:
        if i is not None:
            least[root(t)] = min(least.get(root(t), i), i)
    for i, t, _ in rows:
        assert set(got[i]) == {i if t is None else least.get(root(t))}, (i, t)
    kept = minhash.keep_one(docs(spark, rows))
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {c[0] for c in got.values() if c[0] is not None}
    assert minhash.near_duplicates(edge.limit(0)).count() == 0


def test_results_are_alike_beyond_every_size(spark, monkeypatch):
    """With the bounds of broadcasts, chunks and sent words lowered, the other arms give the same rows."""
    rng = random.Random(12)
    rows = []
    for group in range(6):
        base = prose(rng, 90, 5000).split()
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(w), "s"))
    rows += [(500 + i, rows[0][1], "s") for i in range(9)]
    d = docs(spark, rows)
    items = spark.createDataFrame([(1, " ".join(rows[0][1].split()[:25])), (2, " ".join(rows[20][1].split()[10:40]))], "item_id bigint, text string")
    pages = spark.createDataFrame([(i, "u", t) for i, t, _ in rows], "page_id bigint, url string, html string")
    tidy = lambda df: sorted(str([round(x, 4) if isinstance(x, float) else x for x in r]) for r in df.collect())
    runs = {
        "near": lambda: tidy(minhash.near_duplicates(d)),
        "kept": lambda: tidy(minhash.keep_one(d)),
        "clean": lambda: tidy(decontaminate.keep_clean(d, items)),
        "warc": lambda: tidy(warc.round_trip(pages)),
        "lm": lambda: tidy(lm_score.lm_scores(d).drop("score")),
    }
    want = {name: run() for name, run in runs.items()}
    assert len(want["kept"]) < len(rows) and len(want["clean"]) < len(rows)
    for module, name, value in ((minhash, "BROADCAST_ROWS", -1), (minhash, "LOOSE_ROWS", -1), (minhash, "CHUNK", 3), (decontaminate, "BROADCAST_ROWS", -1), (warc, "BROADCAST_ROWS", -1), (lm_score, "SENT_WORDS", 5)):
        assert hasattr(module, name)
        monkeypatch.setattr(module, name, value)
    counts = lm_score.vocabulary_of
    monkeypatch.setattr(lm_score, "vocabulary_of", lambda c: counts(c, sent=5))
    assert {name: run() for name, run in runs.items()} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [(f"m{rng.randint(0, 80)}", f"m{rng.randint(0, 80)}") for _ in range(50)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


# ---------------------------------------------------------------- queries and SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    relation = con.execute(queries.ORACLE[name])
    names = [d[0] for d in relation.description]
    norm = lambda v: None if v is None else round(v, 6) if isinstance(v, float) else v
    mine = sorted(str([norm(r[c]) for c in sorted(names)]) for r in df.collect())
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(df.columns) == sorted(names)
    assert mine == sorted(str([norm(r[k]) for k in order]) for r in relation.fetchall())


def near_classes(rows):
    """The least id of each class of (id, text) rows, over all pairs of different texts."""
    parent = {t: t for _, t in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {t: weighted(t) for t in parent}
    sizes = {t: sum(b.values()) for t, b in bags.items()}
    names = sorted(parent)
    for i, x in enumerate(names):
        for y in names[:i]:
            if min(sizes[x], sizes[y]) >= 0.8 * max(sizes[x], sizes[y]):
                low = sum((bags[x] & bags[y]).values())
                if low / (sizes[x] + sizes[y] - low) >= 0.8:
                    parent[root(x)] = root(y)
    least = {}
    for i, t in rows:
        least[root(t)] = min(least.get(root(t), i), i)
    return {i: least[root(t)] for i, t in rows}


def test_pipeline_equals_brute_force(spark, sf):
    """Every stage in plain Python, over the rows that the stage before kept; the mix by its SQL."""
    import corpus_pipeline

    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(docs_, labels, threshold=0.7).collect() if r.predicted}
    rows = sorted((r.doc_id, r.text, r.source) for r in docs_.collect() if r.doc_id not in toxic)
    cut = [(i, uncut(t, shared_places(t, [x for k, x, _ in rows if k < i])), s) for i, t, s in rows]
    classes = near_classes([(i, t) for i, t, _ in cut])
    kept = [(i, t, s) for i, t, s in cut if classes[i] == i]
    clean = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    left = []
    items = [clean(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    runs = lambda w, n: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
    for i, t, s in kept:
        w = clean(t)
        found = False
        for item in items:
            n = min(len(item), decontaminate.SEED_WORDS)
            if n and runs(item, n) & runs(w, n) and 2 * sum((collections.Counter(item) & collections.Counter(w)).values()) / (2 * len(item)) >= decontaminate.LEAK:
                found = found or smith_waterman(item, w) / (2 * len(item)) >= decontaminate.LEAK
        if not found:
            left.append((i, t, s))
    assert len(rows) > len(kept) >= len(left) > 50 and any(a[1] != b[1] for a, b in zip(rows, cut))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in left], "text": [r[1] for r in left], "source": [r[2] for r in left]}))
    relation = con.execute(queries.ORACLE["op8_mixing"])
    names = [d[0] for d in relation.description]
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(str([tidy(r[names.index(c)]) for c in sorted(names)]) for r in relation.fetchall())
    got = corpus_pipeline.run(spark, sf)
    assert sorted(str([tidy(r[c]) for c in sorted(got.columns)]) for r in got.collect()) == want


def test_pipeline(spark, sf):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    columns = d.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = d
        d = work.written(stage(spark, d, sf), name)
        assert d.columns == columns and d.dtypes == before.dtypes
        assert d.join(before, "doc_id", "left_anti").count() == 0
    toxic = {r.doc_id for r in toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    mixed = corpus_pipeline.STAGES[-1][1](spark, d, sf).collect()
    assert {r.doc_id for r in mixed} == {r.doc_id for r in d.collect()} and not toxic & {r.doc_id for r in mixed}
    assert sum(r.taken for r in mixed) == pytest.approx(sum(r.size for r in mixed), abs=30)
    assert minhash.near_duplicates(d).where("doc_id <> class_id").count() == 0
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, mixed))

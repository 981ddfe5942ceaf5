"""Periodic runs, SentencePiece ids and spelling variants against brute force and the library."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm import reference as R
from zonalis.llm import periods, pieces, variants
from zonalis.llm.queries import QUERIES, merge_pieces

SMALL = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
SCHEMA = "doc_id BIGINT, text STRING, _h INT, _n INT, _words INT, ids INT, runs INT, word INT, doc INT"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()}


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], SCHEMA)


# --- periodic runs -----------------------------------------------------------------------------

def all_runs(words, least=6, powers=4):
    n, out = len(words), []
    for q in range(1, n // powers + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            smaller = any(all(words[j] == words[j + r] for j in range(s, s + length - r)) for r in range(1, q))
            if length >= max(least, powers * q) and not smaller:
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@tables
def test_op11(spark, texts):
    rows = QUERIES["op11_internal_pattern_runs"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    planted = 0
    for r in rows:
        words = R.WORD.findall(texts[r.doc_id])
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        found = all_runs(words)
        best = min(found, key=lambda x: (-(1000 * x[1] / x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r.collapsed_sha256 == sha(collapse(words, found))
    assert planted


def test_runs_of_any_shape():
    rng = random.Random(11)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(0, 5)):
            n, letters = rng.choice([0, 1, 5, 6, 7, 8, 30, 120]), rng.choice([1, 2, 3, 40])
            words = [rng.randrange(letters) for _ in range(n)]
            for _ in range(rng.randint(0, 3)):
                if n:
                    a = rng.randrange(n)
                    p = 1 + rng.randrange((n - a) // 3 + 1)
                    for i in range(a, rng.randint(a, n)):
                        words[i] = words[a + (i - a) % p]
            docs.append(words)
        first = np.cumsum([0, *map(len, docs)])
        got = periods.runs(np.array([w for d in docs for w in d], np.int64), first, 6, 4)
        assert [got.get(k, []) for k in range(len(docs))] == [all_runs(d) for d in docs]


def test_wavelet_tree():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, 200)
    tree = periods.WaveletTree(values, 6)
    low = rng.integers(0, 199, 300)
    high = low + 1 + rng.integers(0, 200 - low)
    bound, rank = rng.integers(0, 60, 300), rng.integers(0, high - low)
    assert tree.below(low, high, bound).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, bound)]
    assert tree.smallest(low, high, rank).tolist() == [int(np.sort(values[a:b])[k]) for a, b, k in zip(low, high, rank)]


def test_runs_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000)) + " again and" * 4000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 6), (4, "a " * 6), (5, "a a a a a"), (None, "x y " * 4), (6, long),
            (7, "B b " * 3), (8, "ä ä " * 6)]
    got = {}
    for r in periods.find_runs(table(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == got[2] == got[3] == [(0, [], "")]
    assert got[4] == [(6, [(0, 6, 1)], "a")] * 2
    assert got[5] == [(5, [], "a a a a a")] and got[None] == [(8, [(0, 8, 2)], "x y")]
    assert got[6][0][1] == [(30_000, 8000, 2)] and got[6][0][2].endswith(" w29999 again and")
    assert got[7] == [(6, [], "B b B b B b")] and got[8] == [(6, [(0, 6, 1)], "ä ä")]
    empty = periods.find_runs(periods.repeat_words(table(spark, [])))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_best_run_ties(spark):
    df = spark.createDataFrame([([(0, 8, 2), (9, 12, 3), (30, 4, 1)],), ([(5, 12, 3), (5, 9, 2)],), ([],)], f"runs array<{periods.RUN}>")
    assert [r[0] and tuple(r[0]) for r in df.select(periods.best_run(df.runs)).collect()] == [(0, 8, 2), (5, 9, 2), None]


# --- SentencePiece -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=merge_pieces())


@tables
def test_op12(spark, texts, library):
    rows = QUERIES["op12_agenda_sentencepiece"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) == (
            len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True)


def test_agenda_on_random_texts(library):
    own, rng = pieces.MergeVocabulary(merge_pieces()), random.Random(4)
    letters = [*" ▁\n\tabcdeéABßü.,!?日本語😀́<s>0x0A\x00‍� ", "the ", "ing", "   "]
    texts = ["", " ", "a"] + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(3000)]
    ids, bounds, decoded, same = own.encode(texts)
    assert all(same)
    want = library.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert decoded == library.decode(want)


def test_decoding_of_any_ids(library):
    own, rng = pieces.MergeVocabulary(merge_pieces()), random.Random(5)
    for _ in range(3000):
        ids = [rng.randrange(32_000) if rng.random() < 0.6 else rng.randrange(260) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids)


def test_store_starts_anew(library):
    own = pieces.MergeVocabulary(merge_pieces())
    own.encode(["some words"])
    own.held = pieces.REMEMBERED + 1
    ids, bounds, decoded, _ = own.encode(["other words", ""])
    assert ids.tolist() == library.encode("other words") and bounds.tolist() == [0, len(ids), len(ids)]
    assert decoded == ["other words", ""] and "▁some" not in own.number


def test_a_wrong_id_is_noticed():
    own = pieces.MergeVocabulary(merge_pieces())
    texts = ["one text", "another", "third"]
    ids, bounds, decoded, _ = own.encode(texts)
    ids = ids.copy()
    ids[bounds[1]] += 1
    assert own.agrees(texts, ids, bounds, decoded) == [True, False, True]
    assert own.agrees(texts, ids[:-1], np.append(bounds[:-1], bounds[-1] - 1), decoded) == [True, False, False]


def test_a_wrong_part_is_noticed():
    own = pieces.MergeVocabulary(merge_pieces())
    own.parts["▁another"] = (5, 6)
    assert own.encode(["one text", "and another one", "third"])[3] == [True, False, True]


@tables
def test_whole_texts_agree_with_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pieces.encode_pieces(docs, merge_pieces(), whole=True).select("agrees").collect()
    assert len(rows) == docs.count() and all(r.agrees for r in rows)


@pytest.mark.parametrize("whole", [True, False])
def test_pieces_edges(spark, library, whole):
    blob = "ab" * 50_000
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y z"), (4, blob), (5, "word " * 30_000)]
    got = {}
    for r in pieces.encode_pieces(table(spark, rows), merge_pieces(), whole=whole).collect():
        got.setdefault(r.doc_id, []).append((list(r.ids), r.decoded, r.agrees))
    assert got[1] == got[2] == [([], "", True)] and got[3] == [(library.encode("x"), "x", True)] * 2
    assert got[None] == [(library.encode("y z"), "y z", True)] and got[4] == [(library.encode(blob), blob, True)]
    assert got[5][0][2]
    assert pieces.encode_pieces(table(spark, []), merge_pieces()).collect() == []


# --- spelling variants -------------------------------------------------------------------------

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_brute_force(counts):
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for d in (-1, 0, 1) for v in by_length.get(len(w) + d, []) if one_edit(w, v)] for w in counts}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


@tables
def test_op13(spark, texts):
    counts = Counter()
    for i, t in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            run = R.lower(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    rows = QUERIES["op13_composed_spelling_variants"](spark, SMALL).collect()
    assert len(rows) == len(counts)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == variants_by_brute_force(counts)


@pytest.mark.parametrize("partition", [1, 3, 4000])
def test_variants_in_partitions_of_any_size(spark, partition):
    rng = random.Random(6)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 8))): 0 for _ in range(220)} | {"stem" + "".join(rng.choices("xyz", k=3)): 0 for _ in range(30)}
    counts = {w: rng.choice([1, 5, 5, 25, 125, 700]) for w in words}
    got = variants.spelling_variants(spark.createDataFrame(list(counts.items()), "word STRING, n BIGINT"), partition=partition).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == variants_by_brute_force(counts)


def test_acceptor_is_minimal():
    words = sorted(["station", "nation", "ration", "stations", "nations"])
    machine = variants.Acceptor(words)
    reached, todo = set(), [0]
    while todo:
        state = todo.pop()
        if state not in reached:
            reached.add(state)
            todo.extend(machine.arcs[state].values())
    rights = {s: frozenset(variants.Composition(machine, machine).common(s, s)) for s in reached}
    assert rights[0] == set(words) and len(set(rights.values())) == len(reached)


def test_counts_and_edges(spark):
    rows = [(1, None), (2, ""), (3, "Abcdef abcdef, ABCDEÉ"), (3, "abcdef"), (None, "abcdeé×"), (4, "abcdef " * 50_000), (5, "short abcde")]
    got = {tuple(r) for r in variants.count_words(table(spark, rows)).collect()}
    assert got == {("abcdef", 50_003), ("abcdeÉ", 1), ("abcdeé×", 1)}
    assert variants.count_words(table(spark, []), misspell=2).collect() == []
    empty = spark.createDataFrame([], "word STRING, n BIGINT, key INT")
    assert variants.spelling_variants(empty).collect() == []
    odd = spark.createDataFrame([(None, 3), ("lonely", 2), ("a", 1), ("ab", None)], "word STRING, n BIGINT")
    assert {tuple(r) for r in variants.spelling_variants(odd).collect()} == {
        ("lonely", None, "lonely", 2, 0, None), ("a", None, "a", 1, 0, None)}

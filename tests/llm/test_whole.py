"""The whole job of corpus operators, against brute force without their shortcuts."""

import os
from collections import Counter

import duckdb
import pytest

from tests.llm import reference as R
from zonalis.llm import lines, paragraphs
from zonalis.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()}


def whole_lines(text):
    return enumerate(w for line in text.split("\n") if (w := R.WORD.findall(R.lower(line))))


def beside(texts, names):
    """Names of the repeated lines that have eight words or another repeated line next to them."""
    size = Counter(names.values())
    again = {u for u, n in names.items() if size[n] > 1}
    words = {(i, n): len(w) for i, t in texts.items() for n, w in whole_lines(t)}
    kept = {u for u in again if words[u] >= 8 or (u[0], u[1] - 1) in again or (u[0], u[1] + 1) in again}
    members = {}
    for u in sorted(kept):
        members.setdefault(names[u], []).append(u)
    return {u: some[0] for some in members.values() if len(some) > 1 for u in some}


@tables
def test_op6_whole_lines(spark, texts):
    rows = QUERIES["op6_paragraph_minhash"](spark, SMALL).collect()
    for whole, units in ((True, whole_lines), (False, R.paragraphs)):
        sets = {(i, n): R.shingle_set(words, 5) for i, t in texts.items() for n, words in units(t)}
        groups = R.linked(sets, 80)
        names = {u: groups.find(u) for u in sets}
        if whole:
            names = beside(texts, names)
        many = {n for u, n in names.items() if u != n}
        got = {(r.doc_id, r.paragraph): (r.cluster_doc, r.cluster_paragraph) for r in rows if r.whole == whole}
        assert got.keys() == {u for u, n in names.items() if n in many}
        # Clusters are the same; a part whose line goes does not name one unless all do.
        assert len({(names[u], c) for u, c in got.items()}) == len(many) == len(set(got.values()))
        assert all(names[c] == names[u] for u, c in got.items()) and (not whole or all(names[u] == c for u, c in got.items()))
    lost = [(r.doc_id, r.begin, r.end) for r in rows if r.whole and not r.kept]
    inside = lambda r: any(d == r.doc_id and b <= r.begin and r.end <= e for d, b, e in lost)
    parts = {}
    for r in rows:
        if not r.whole:
            parts.setdefault((r.cluster_doc, r.cluster_paragraph), []).append(r)
    for group in parts.values():
        kept, = [r for r in group if r.kept]
        assert not inside(kept) or all(map(inside, group))


def test_edited_paragraphs_go_whole(spark):
    """An edited sentence, short sentences and shouted words are no gap in a repeated paragraph."""
    body = " ".join(f"w{i}" for i in range(60))
    one = f"Short one. {body}. The quick brown fox jumps over this lazy dog now. End it."
    two = one.replace("lazy", "sleepy")
    shout = " ".join(f"UND{i}!!" for i in range(31))
    df = spark.createDataFrame([(1, one), (2, two), (3, f"x\n{shout}"), (4, f"y\n{shout}"), (5, "ok"), (6, "ok")], "doc_id BIGINT, text STRING")
    found = paragraphs.duplicate_paragraphs(df, min_line_words=1)
    left = {r.doc_id: r.text for r in paragraphs.without_paragraphs(df, found).collect()}
    assert left == {1: one, 2: "", 3: f"x\n{shout}", 4: "y\n", 5: "ok", 6: ""}


def test_short_lines_go_only_in_runs(spark):
    rows = [(1, "thank you\nalone here"), (2, "thank you\nsomething else"), (3, "one two\nthree four\nfive"), (4, "x\none two\n\nthree four\ny"),
            (5, "one two\nz"), (None, "thank you"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = paragraphs.duplicate_paragraphs(df, min_line_words=1, lone_words=8)
    assert {(r.doc_id, r.paragraph, r.cluster_doc, r.kept) for r in found.collect()} == {(3, 0, 3, True), (3, 1, 3, True), (4, 1, 3, False), (4, 2, 3, False)}
    left = {r.doc_id: r.text for r in paragraphs.without_paragraphs(df, found).collect()}
    assert left[4] == "x\n\n\n\ny" and left[1] == rows[0][1] and left[5] == rows[4][1]


def test_no_copy_of_a_part_is_lost(spark):
    """A part in a line that goes as a whole does not make its copies elsewhere go."""
    body = " ".join(f"w{i}" for i in range(80))
    first, second = "alpha beta gamma delta epsilon zeta eta old.", "alpha beta gamma delta epsilon zeta eta new theta iota kappa."
    df = spark.createDataFrame([(1, f"{body}. {first}"), (2, f"{body}. {second}"), (3, f"Something else. {second}")], "doc_id BIGINT, text STRING")
    left = {r.doc_id: r.text for r in paragraphs.without_paragraphs(df, paragraphs.duplicate_paragraphs(df)).collect()}
    assert left[2] == "" and second in left[3] and left[1] == f"{body}. {first}"


def every_earlier(texts):
    """Lines that go when each document is aligned with all earlier ones."""
    own = {i: [(k, x, len(R.WORD.findall(x))) for k, x in enumerate(t.split("\n")) if R.WORD.search(x)] for i, t in texts.items()}
    holders = {}
    for i, some in own.items():
        for _, x, _ in some:
            holders.setdefault(x, set()).add(i)
    own = {i: [x for x in some if len(holders[x[1]]) > 1] for i, some in own.items()}
    gone = {i: set() for i in texts}
    for i in own:
        for j in {j for _, x, _ in own[i] for j in holders[x] if j < i}:
            a, b = own[i], own[j]
            for run in lines.blocks(lines.patience([x[1] for x in a], [x[1] for x in b]), [x[0] for x in a], [x[0] for x in b]):
                if sum(a[k][2] for k in run) >= lines.MIN_WORDS:
                    gone[i] |= {a[k][0] for k in run}
    return gone


@tables
def test_op5_every_earlier_document(spark, texts):
    got = {r.doc_id: r.lines_removed for r in QUERIES["op5_patience_line_dedup"](spark, SMALL).collect()}
    assert got == {i: ",".join(map(str, sorted(g))) for i, g in every_earlier(texts).items()}


def test_blocks_of_later_holders(spark):
    """A block whose lines were met apart before, and lines that the first holder or the later document repeats."""
    long = "a line of more than six words here"
    texts = {1: "one two\nalone", 2: "three four\nother", 3: "five six\nmore", 4: "p\none two\nthree four\nfive six", 5: "q\none two\nthree four\nfive six\nr",
             6: f"{long}\nalone\n{long}", 7: f"{long}\nx y", 8: f"other\n{long}\nx y", 9: f"more\n{long}\nalone\n{long}\np"}
    got = {r.doc_id: set(r.dedup.removed) for r in lines.dedupe_lines(spark.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING")).collect()}
    assert got == every_earlier(texts) and got[5] == {1, 2, 3} and got[8]

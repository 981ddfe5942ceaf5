"""NULLs, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import reference as R
from zonalis.llm import components, decontaminate, langid, lines, minhash, neardup, packing, paragraphs, pii, quality, secrets, suffixes
from zonalis.llm.neardup import link
from zonalis.llm.queries import vocabulary
from zonalis.llm.shingles import pack

random.seed(5)
VOWELS = ["ka", "lo", "mi", "ter", "san", "vel", "ur", "ost", "bri", "en", "da", "fo"]
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, _gone INT, _row STRING, dedup INT, language INT, _HITS INT"


def prose(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices(VOWELS, k=rng.randint(1, 4))) for _ in range(n)]
    return "\n".join(" ".join(words[i:i + 12]) + "." for i in range(0, n, 12))


LONG = prose(40_000, 1)
ROWS = [
    (1, prose(80, 2), "en", "a"), (2, prose(80, 2), "en", "a"), (2, prose(80, 2), "en", "a"),
    (3, None, None, None), (4, "", "de", "b"), (5, " \n\t ", "de", "b"), (6, "12 34", "en", None),
    (7, LONG, "en", "a"), (8, LONG + " x", "en", "b"), (None, prose(80, 2), "en", "a"), (None, None, "en", "a"),
    (9, 'token = "abcdefgh12345678" mail me@site.example.com', "en", "a"), (10, "word", "de", "a"), (11, "word", "de", "b"),
    (12, prose(90, 3), "de", "b"), (13, "ab" * 600, "de", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 1, "x", 2, 3, 4) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    item = prose(90, 3).replace("\n", " ").upper()
    return spark.createDataFrame([(1, item[:250]), (2, None), (3, ""), (4, "word"), (1, item[:250])], "item_id BIGINT, text STRING")


def test_pii(docs, none):
    got = pii.replace_entities(docs, "k")
    assert got.columns == [*docs.columns, "n_entities"]
    rows = got.collect()
    assert len(rows) == len(ROWS) and sum(r.n_entities for r in rows) == 1
    assert [r.text for r in rows if r.doc_id == 3] == [None]
    assert "me@site" not in [r.text for r in rows if r.doc_id == 9][0]
    assert pii.replace_entities(none, "k").collect() == []


def test_surrogates_agree_and_differ(spark):
    texts = ["Call +1 (017) 555-7713", "or +1 017-555-7713.", "Card 4111 1111 1111 1111", "card 4111111111111111",
             "Mrs. Ana Lopez", "Mr Lopez", "Frau Ana Weber", "Господин Иванов", "Herr Max Weber"] + [f"at 10.0.{i}.{j}" for i in range(8) for j in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    one = {r.id: r.text for r in pii.replace_entities(df, "k").collect()}
    assert one[0].removeprefix("Call ").replace("(", "").replace(")", "").replace(" ", "").replace("-", "") \
        == one[1].removeprefix("or ").rstrip(".").replace(" ", "").replace("-", "")
    assert one[2].split(" ", 1)[1].replace(" ", "") == one[3].split()[1]
    digits = [int(c) for c in one[3].split()[1]]
    assert sum(d if i % 2 else (d * 2 - 9 * (d > 4)) for i, d in enumerate(digits)) % 10 == 0
    assert one[4].split()[2] == one[5].split()[1] and one[6].split()[2] == one[8].split()[2]
    assert one[4].split()[1] == one[6].split()[1] and all("а" <= c.lower() <= "я" for c in one[7].split()[1])
    addresses = {one[i] for i in range(9, len(texts))}
    assert len(addresses) == 64 and not addresses & set(texts)
    assert {r.text for r in pii.replace_entities(df, "other").collect()} != set(one.values())


def test_collisions_are_drawn_anew(spark):
    some = spark.createDataFrame([("ssn", f"{i:09d}") for i in range(50)] + [("given m latin", f"n{i}") for i in range(2000)], "kind STRING, canon STRING")
    got = pii.assign(some, F.lit("k")).collect()
    assert len(got) == 2050 == len({(r.kind, r.surrogate) for r in got})
    assert not {(r.kind, r.surrogate) for r in got} & {(r.kind, r.canon) for r in got}


def test_packing(docs, none):
    rows = packing.harmonic_pack(docs, vocabulary()).collect()
    assert sorted({r.doc_id for r in rows if r.doc_id is not None}) == list(range(1, 14))
    used, ends = {}, 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0) and len(r.ids) == 4 * r.length
        used[r.sequence_id] = r.offset + r.length
        ends += r.start + r.length == r.doc_tokens
    assert ends == len(ROWS) and max(used.values()) <= 2048
    assert packing.harmonic_pack(none, vocabulary()).collect() == []
    assert packing.cut(2048) == [2048] and packing.cut(1) == [1] and sum(packing.cut(5000)) == 5000


@pytest.mark.parametrize("text", ["İSTANBUL ſtraße ΑΣ é é", "it's don't '’s 12ab34 <|endoftext|>x", "a\x85b\xa0c\x1cd e", "#a b,,.c ?!x"])
def test_tokenizer_parts(text):
    tokens = packing.WordTokenizer(vocabulary())
    assert tokens.encode([text])[0].tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


def test_decontamination(spark, docs, none, benchmark):
    left = decontaminate.decontaminate(docs, benchmark)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {None, *range(1, 14)} - {12}
    leaks = decontaminate.find_leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in leaks} == {(12, 1)}
    assert decontaminate.find_leaks(none, benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.where("false")).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.where("false")).count() == len(ROWS)


def test_edit_budget(spark):
    rng, item = random.Random(3), prose(40, 9)
    budget = int(len(decontaminate.normalize(item.encode())) * decontaminate.RATE)
    rows = []
    for i in range(40):
        body = list(item)
        for _ in range(rng.randint(0, 2 * budget)):
            at = rng.randrange(len(body))
            body[at] = rng.choice(["", "q", body[at] + "z"])
        rows.append((i, prose(20, i) + " " + "".join(body) + " " + prose(20, 100 + i)))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.distance for r in decontaminate.find_leaks(docs, spark.createDataFrame([(7, item)], "item_id BIGINT, text STRING")).collect()}
    pattern = decontaminate.normalize(item.encode())
    near = {i: min(R.distance_within(pattern, decontaminate.normalize(t.encode()))) for i, t in rows}
    assert got == {i: d for i, d in near.items() if d <= budget} and 0 < len(got) < 40


def test_quality(docs, none):
    rows = quality.quality_rules(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.kept == (not r.base_failed)  # too few rows for an estimate
    assert [r.n_words for r in rows if r.doc_id == 3] == [0] and quality.quality_rules(none).collect() == []


def test_outliers_are_found(spark):
    rng = np.random.default_rng(0)
    mix = np.array([[1, 0, 0, 0, 0], [.8, .6, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 1, 0], [0, 0, 0, 0, 1]])
    good = rng.standard_normal((3000, 5)) @ mix.T * 3
    bad = rng.standard_normal((600, 5)) + [30, -30, 0, 0, 0]
    rows = [("g", *map(float, v)) for v in np.concatenate([good, bad])] + [("flat", 1.0, 2.0, 3.0, 4.0, 5.0)] * 30
    fit = {r.key: r for r in quality.mcd(spark.createDataFrame(rows, "key STRING, x0 DOUBLE, x1 DOUBLE, x2 DOUBLE, x3 DOUBLE, x4 DOUBLE")).collect()}
    # A plain mean would be pulled to about (5, -5).
    assert abs(fit["g"].m0) < 1 and abs(fit["g"].m1) < 1 and fit["flat"].m4 == 5


def test_line_dedup(docs, none):
    got = lines.dedupe_lines(docs, into="out").collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text == prose(80, 2) and [r.text for r in by[2]] == ["", ""] and by[3][0].text is None
    assert sorted(r.text or "" for r in by[None]) == ["", prose(80, 2)]
    assert by[7][0].text == LONG and by[8][0].text == LONG.split("\n")[-1] + " x" and by[11][0].text == "word"
    assert lines.dedupe_lines(none).collect() == []


def test_paragraphs(docs, none):
    found = paragraphs.duplicate_paragraphs(docs)
    rows = found.collect()
    assert {r.doc_id for r in rows if not r.kept} == {2, 8} and {r.doc_id for r in rows if r.kept} == {1, 7}
    cut = paragraphs.without_paragraphs(docs, found)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert {r.text.strip(): r.doc_id for r in cut.where("doc_id IN (1, 2)").select("doc_id", F.trim("text").alias("text")).collect()}.keys() != {prose(80, 2)}
    assert paragraphs.duplicate_paragraphs(none).collect() == []


def test_language(docs, none):
    model = langid.train(docs)
    rows = langid.identify(docs, model, into="out").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r.out.lang_pred == "und") == (r.text is None or not any(map(str.isalpha, r.text)))
        assert 0 <= r.out.score <= 1
    assert langid.train(none) is None and langid.identify(none, model, into="out").collect() == []
    assert {r.out.lang_pred for r in langid.identify(docs, None, into="out").collect()} == {"und"}


def test_repeats(docs, none):
    rows = suffixes.remove_repeats(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_removed == by[1].n_bytes == by[2].n_removed and by[3].n_bytes == 0 and by[13].n_removed == 1200
    assert by[7].n_removed == by[7].n_bytes and by[8].n_removed == by[7].n_bytes
    assert suffixes.remove_repeats(none).collect() == []


def test_repeats_in_long_texts(spark, monkeypatch):
    """Segments far shorter than the text, periods of all kinds, against every window."""
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    rng = random.Random(8)
    body = "".join(rng.choices("ab", k=3000))
    texts = {1: body + "x" * 900 + body[500:1400], 2: "y" + body[100:520] + "z", 3: "abc" * 500, 4: body[:399], 5: "q" * 401}
    df = spark.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING")
    want = R.repeats({i: t.encode() for i, t in texts.items()}, 400)
    for r in suffixes.remove_repeats(df).collect():
        assert (bytes(r.kept), r.n_spans) == want[r.doc_id]


def test_near_duplicates(docs, none):
    rows = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert len(rows) == 14 and rows[None].kept and rows[2].component_id == 1 and rows[8].component_id == 7
    assert rows[11].component_id == 10 and rows[3].n_shingles == 0 and rows[3].kept and rows[5].kept
    left = minhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 6, 7, 9, 10, 12, 13]
    assert left.where("doc_id IS NULL").count() == 2 and minhash.near_duplicates(none).collect() == []


def test_hot_bucket(spark):
    """One bucket of everything, with similarities on both sides of the threshold: the components are exact."""
    rng = random.Random(4)
    sets = {}
    for i in range(700):
        base = set(range(100))
        for x in rng.sample(range(100), rng.randint(0, 22)):
            base.remove(x)
        sets[i] = frozenset(base | {1000 * (i + 1) + k for k in range(rng.randint(0, 8))})
    rows = [(i, len(s), bytearray(pack(np.array(sorted(s), np.uint64)))) for i, s in sets.items()]
    full = spark.createDataFrame(rows, "id BIGINT, n BIGINT, members BINARY")
    bands = spark.createDataFrame([(i, 1) for i in sets], "id BIGINT, key BIGINT")
    placed = {r.id: r.component for r in link(bands, lambda ids: full, 80).collect()}
    groups = R.linked(sets, 80)
    assert {i: placed.get(i, i) for i in sets} == {i: groups.find(i) for i in sets}
    assert len(set(groups.find(i) for i in sets)) > 1


def test_small_buckets(spark, monkeypatch):
    """Components of small buckets are exact, and no group is made of buckets whose pairs are few rows."""
    rng = random.Random(9)
    sets, rows = {}, []
    for key in range(60):
        ids = range(100 * key, 100 * key + (2 if key < 20 else rng.randint(3, 20)))
        for i in ids:
            kept = set(range(1000 * key, 1000 * key + 60)) - {1000 * key + x for x in rng.sample(range(60), rng.randint(0, 12))}
            sets[i] = frozenset(kept)
            rows.append((i, key))
    grouped = []
    within = neardup._within
    monkeypatch.setattr(neardup, "_within", lambda spread, *rest: grouped.extend(spread.collect()) or within(spread, *rest))
    full = spark.createDataFrame([(i, len(s), bytearray(pack(np.array(sorted(s), np.uint64)))) for i, s in sets.items()], "id BIGINT, n BIGINT, members BINARY")
    placed = {r.id: r.component for r in link(spark.createDataFrame(rows, "id BIGINT, key BIGINT"), lambda ids: full, 80, shared=True).collect()}
    groups = R.linked(sets, 80)
    assert {i: placed.get(i, i) for i in sets} == {i: groups.find(i) for i in sets}
    assert len({groups.find(i) for i in range(0, 2000) if i in sets}) > 20
    assert all(r["size"] > neardup.SMALL for r in grouped)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 200)] + [(rng.randint(300, 600), rng.randint(300, 600)) for _ in range(200)]
    groups = R.Groups(range(601))
    for a, b in edges:
        groups.join(a, b)
    got = components.components(spark.createDataFrame([*edges, (None, 3), (5, None), (7, 7)], "a BIGINT, b BIGINT"))
    assert {r.id: r.component for r in got.collect()} == {i: groups.find(i) for e in edges for i in e if e[0] != e[1]}


def test_secrets(docs, none):
    rows = secrets.secret_scan(docs).collect()
    assert len(rows) == len(ROWS)
    assert [(r.n_assign, r.spans, r.n_live) for r in rows if r.doc_id == 9] == [(1, "assign:0:25", 1)]
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.doc_id not in (9, 13))
    assert secrets.secret_scan(none).collect() == []


def test_ownership_parts_examples_from_live_secrets(spark):
    copied, own = "password = examplePass123", "password = realPass98765"
    rows = [(i, copied, f"s{i}") for i in range(6)] + [(6, own, "s1"), (7, own, "s1")]
    got = secrets.secret_scan(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")).collect()
    assert {r.doc_id: (r.n_live, r.n_shared) for r in got} == {i: ((1, 0) if i > 5 else (0, 1)) for i in range(8)}


def test_pipeline_stages(spark, docs, none, benchmark, tmp_path):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, none):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            rows = out.cache()
            rows.count()
        assert (rows.count() > 0) == (start is docs)


def test_rows_that_share_an_id_are_judged_each(spark):
    one, two, three = prose(60, 21), prose(60, 22), prose(60, 23)
    rows = [(1, one, 0), (1, two, 0), (1, two, 1), (2, one, 0), (2, three, 0), (None, one, 0), (3, None, 0), (3, "", 0)]
    left = minhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, _unit INT"))
    assert left.columns == ["doc_id", "text", "_unit"]
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(got, key=str) == sorted([(1, one), (1, two), (2, three), (None, one), (3, None), (3, "")], key=str)


def test_names_leave_no_trace(spark):
    texts = ["Mrs Anna Kern came. Anna said hi to Kern. ANNA! Anna's dog, Annabel, Kern-Smith.", "Mr McDonald ate.", "Mr O'Brien and MR SMITH, Smith",
             "Dr. Peter Weiss spoke; Weiss left", "Господин Иванов, Иванов", "Herr Jean-Luc Picard, Jean-Luc", "Frau Anna", "call Anna, he (Kern)", "Drum Prof it", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    got = {r.id: r.text for r in pii.replace_entities(df, "k").collect()}
    one = got[0].split()
    given, family = one[1], one[2]
    assert got[0] == f"Mrs {given} {family} came. {given} said hi to {family}. {given.upper()}! {given}'s dog, Annabel, {family}-Smith."
    for i, gone in ((1, "McDonald Donald"), (2, "O'Brien SMITH Smith Brien"), (3, "Peter Weiss"), (4, "Иванов"), (5, "Jean Luc Picard")):
        assert not any(w in got[i] for w in gone.split())
    assert got[2].split()[4].isupper() and got[2].split()[-1].upper() == got[2].split()[4].strip(",")
    assert got[3].split()[0] == "Dr." and got[3].split()[2] == got[3].split()[4]
    assert [got[i] for i in (7, 8, 9, 10)] == texts[7:]


def test_account_numbers_stay_valid(spark):
    texts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NL91 ABNA 0417 1643 00"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    for r in pii.replace_entities(df, "k").collect():
        plain = r.text.replace(" ", "")
        assert r.n_entities == 1 and r.text != texts[r.id] and plain[:2] == texts[r.id][:2]
        assert [c == " " for c in r.text] == [c == " " for c in texts[r.id]]
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_every_place_and_short_items(spark):
    item = prose(20, 31).replace("\n", " ")
    edited = item[:40] + "x" + item[41:]
    texts = [f"{item} {edited} {item}", f"start {edited}{item}", "a short item here, and: Short  Item here!", "short item hereafter", item]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame([(1, item), (2, "short item here")], "item_id BIGINT, text STRING")
    got = sorted((r.doc_id, r.item_id, r.distance, r.begin) for r in decontaminate.find_leaks(docs, bench, short=True).collect())
    n = len(item)
    assert [g[:3] for g in got] == [(0, 1, 0), (0, 1, 0), (0, 1, 1), (1, 1, 0), (1, 1, 1), (2, 2, 0), (2, 2, 0), (4, 1, 0)]
    assert [b for d, _, _, b in got if d == 0] == [0, 2 * n + 2, n + 1] and [b for d, _, _, b in got if d == 2] == [2, 24]
    spans = [(r.begin, r.end) for r in decontaminate.find_leaks(docs, bench).where("doc_id = 1").collect()]
    assert max(a for a, _ in spans) >= min(b for _, b in spans)
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()] == [2, 3]

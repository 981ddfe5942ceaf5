"""Near-duplicate paragraphs inside documents, by MinHash banding over their word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonalis.functions.scratch import discard, materialize
from zonalis.llm import shingles as S
from zonalis.llm.names import fresh
from zonalis.llm.neardup import link, only, release
from zonalis.llm.worker import bound_batches

SHINGLE = 5
#: Words below which a part of a line is too common a phrase to be a repeat.
MIN_WORDS = 8
#: Bytes that end a part of a line.
_CLOSING = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def tune(similarity: float, background: float = 0.01, miss: float = 1e-3, false_hits: float = 1e-3) -> tuple[int, int]:
    """(bands, rows): the fewest bands that miss a pair at ``similarity`` with probability ``miss`` at
    most and let a pair at ``background`` through with ``false_hits`` at most."""
    rows = 1
    while True:
        bands = S.bands_for(similarity, rows, miss)
        if 1 - (1 - background ** rows) ** bands <= false_hits:
            return bands, rows
        rows += 1


def _sets_of(values: np.ndarray, unit: np.ndarray, n_units: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each unit in the order of their low 48 bits, and their units."""
    if n_units <= 1 << 16:
        key = (unit.astype(np.uint64) << np.uint64(48)) | (values & np.uint64((1 << 48) - 1))
        order = np.argsort(key)
        key = key[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        order = order[fresh]
    else:
        low = values & np.uint64((1 << 48) - 1)
        order = np.lexsort((low, unit))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (low[order[1:]] != low[order[:-1]]) | (unit[order[1:]] != unit[order[:-1]])
        order = order[fresh]
    return values[order], unit[order]


def _level(
    row: np.ndarray, line: np.ndarray, words: tuple[np.ndarray, ...], runs: np.ndarray, head: np.ndarray, least: int,
) -> tuple[np.ndarray, ...]:
    """Row, number in the row, line, byte range in the data, words, and shingle sets of the units that
    begin at the words ``head`` and have ``least`` words or more; ``runs`` are the shingles from each word on."""
    hashes, starts, ends = words
    first = np.append(np.flatnonzero(head), len(hashes))
    unit_row = row[first[:-1]]
    number = np.arange(len(unit_row)) - np.searchsorted(unit_row, unit_row)
    count = np.diff(first)
    long = count >= least
    of = np.repeat(np.arange(len(count)), count)
    inside = np.flatnonzero((of[:len(runs)] == of[SHINGLE - 1:]) & long[of[:len(runs)]])
    few = long & (count < SHINGLE)
    short = np.flatnonzero(few)
    values, unit = S.shingle(hashes[few[of]], np.append(0, np.cumsum(count[short])), SHINGLE)
    values, unit = _sets_of(np.concatenate([runs[inside], values]), np.concatenate([of[inside], short[unit]]), len(count))
    at = np.flatnonzero(long)
    return (unit_row[at], number[at], line[first[at]], starts[first[at]], ends[first[at + 1] - 1],
            count[at], values, np.searchsorted(unit, at))


def _units(texts: pa.Array, min_words: int, min_line_words: int) -> tuple[np.ndarray, ...]:
    """Row, code, line, byte range, words, and shingle sets of each paragraph with enough words.

    A paragraph is a line as a whole, and also each part of it up to a word that ends with a full
    stop, an exclamation or a question mark: a passage pasted into a line is a run of such parts.
    The code is twice the number in the row, plus 1 for a whole line.
    """
    data, offsets = S.buffer_of(texts)
    hashes, starts, ends = words = S.words(data, offsets)
    if not len(hashes):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none, np.zeros(0, np.uint64), np.zeros(1, np.int64)
    heads = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(texts)), np.diff(heads))
    closing = _CLOSING[data[ends - 1]]
    after = np.searchsorted(starts, np.flatnonzero(data == 10))
    whole = np.zeros(len(hashes) + 1, bool)
    whole[heads] = whole[after] = True
    whole = whole[:-1]
    part = whole.copy()
    part[1:] |= closing[:-1]
    line = np.cumsum(whole) - 1
    line -= line[heads[row]]
    runs = S.runs(hashes, SHINGLE)
    parts = _level(row, line, words, runs, part, min_words)
    wholes = _level(row, line, words, runs, whole, min_line_words)
    of, number, line, begin, end, count, values = (np.concatenate(x) for x in zip(parts[:7], wholes[:7]))
    code = 2 * number
    code[len(parts[0]):] += 1
    bounds = np.concatenate([parts[7], wholes[7] + len(parts[6]), [len(values)]])
    return of, code, line, begin - offsets[of], end - offsets[of], count, values, bounds


def paragraph_table(docs: DataFrame, bands: int, rows: int, min_words: int, min_line_words: int, similarity: int) -> DataFrame:
    """One row per paragraph of ``docs`` (doc, text) with its range, words, set size, set identity and a key per band.

    Parts and whole lines differ in identity and keys, so a line never meets a part of itself. The
    keys are NULL where the set is too small to be like another than an equal one. They are columns of
    their own, so that a scan for one band reads no other.
    """
    kind = docs.schema["doc"].dataType.simpleString()
    names = [f"key{band}" for band in range(bands)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in S.pieces(batch.column(1)):
                row, code, line, begin, end, words, values, bounds = _units(texts, min_words, min_line_words)
                if not len(row):
                    continue
                one, two = _identity(code, values, bounds)
                n = np.diff(bounds)
                lone = n * (100 - similarity) < similarity
                keys = S.band_keys(S.min_max(values, bounds[:-1], bands * rows, both=False), rows).view(np.uint64) + _level_of(code)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)).take(pa.array(row)), pa.array(code.astype(np.int32)), pa.array(line.astype(np.int32)),
                     pa.array(begin), pa.array(end), pa.array(words.astype(np.int32)), pa.array(n), pa.array(one), pa.array(two),
                     *[pa.array(k, mask=lone) for k in np.ascontiguousarray(keys.view(np.int64).T)]],
                    ["doc", "unit", "line", "begin", "end", "words", "n", "one", "two", *names],
                )

    return docs.select("doc", "text").mapInArrow(
        read, f"doc {kind}, unit int, line int, begin bigint, end bigint, words int, n bigint, one bigint, two bigint, "
        + ", ".join(f"{name} bigint" for name in names)
    )


def _level_of(code: np.ndarray) -> np.ndarray:
    return (code & 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def _identity(code: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(
        (np.add.reduceat(S.mix(values * np.uint64(c)), bounds[:-1]) + _level_of(code)).view(np.int64)
        for c in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))


def _sets(docs: DataFrame, wanted: DataFrame, min_words: int, min_line_words: int) -> DataFrame:
    """(id, n, members) of the ``wanted`` (doc, units) paragraphs, ``units`` holding their number and id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in S.pieces(batch.column(1)):
                row, code, _, _, _, _, values, bounds = _units(texts, min_words, min_line_words)
                if not len(row):
                    continue
                one, _ = _identity(code, values, bounds)
                units = batch.column(2).slice(at, len(texts))
                # By number and id: rows that share a document's id can differ in their texts.
                asked = [{(u["unit"], u["one"]) for u in units_of} for units_of in units.to_pylist()]
                use = [k for k, of in enumerate(zip(row.tolist(), code.tolist(), one.tolist())) if of[1:] in asked[of[0]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[use]), pa.array(np.diff(bounds)[use]), pa.array([S.pack(values[bounds[k]:bounds[k + 1]]) for k in use], pa.binary())],
                    ["id", "n", "members"],
                )

    return docs.join(wanted.hint("merge"), "doc").select("doc", "text", "units").mapInArrow(
        read, "id bigint, n bigint, members binary"
    ).groupBy("id").agg(F.max(F.struct("n", "members")).alias("s")).select("id", "s.n", "s.members")


def _shared_keys(units: DataFrame, bands: int) -> DataFrame:
    """(id, key) of the keys that several sets of ``units`` have, a written table; ``one`` is the id.

    Band after band, because nearly all keys are unique: what is shuffled at once is a band's share.
    Copies of a paragraph are one set; they combine before they are shuffled to be counted.
    """
    spark, parts = units.sparkSession, []
    for band in range(bands):
        own = units.select(F.col("one").alias("id"), F.col(f"key{band}").alias("key")).where("key IS NOT NULL")
        again = materialize(own.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select(F.col("key").alias("id")))
        parts.append(materialize(only(own, "key", again).distinct()))
        discard(again)
        release(spark)
    shared = materialize(reduce(DataFrame.unionByName, parts).select("id", "key"))
    discard(*parts)
    return shared


def _beside(lines: DataFrame, lone_words: int) -> DataFrame:
    """The ``lines`` of ``lone_words`` words or next to another, in clusters that still have two."""
    own = Window.partitionBy("doc").orderBy("line")
    near = (F.lag("line").over(own) == F.col("line") - 1) | (F.lead("line").over(own) == F.col("line") + 1)
    kept = lines.withColumn("near", F.coalesce(near, F.lit(False))).where(F.col("near") | (F.col("words") >= lone_words)).drop("near")
    several = kept.groupBy("first").agg(F.min(F.struct("doc", "unit")).alias("least"), F.count(F.lit(1)).alias("many")).where("many > 1")
    return kept.join(several, "first").select(*[F.col("least").alias("first") if c == "first" else c for c in lines.columns])


def duplicate_paragraphs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: int = 80, min_words: int = MIN_WORDS,
    min_line_words: int = MIN_WORDS, lone_words: int = 1,
) -> DataFrame:
    """One row per paragraph that has a near-duplicate, in another document or the same one.

    Paragraphs are whole lines of ``min_line_words`` words or more, and parts of lines up to a
    sentence end of ``min_words`` or more; each kind is linked among its like, and both are reported.
    A line of fewer words than ``lone_words`` counts only beside another line that has a near-duplicate:
    by itself it is a phrase that clean texts share.

    Columns: ``doc_id``, ``whole`` (true for a line), ``paragraph`` (number in the document, of its
    kind), ``begin``, ``end`` (bytes of the UTF-8 text), ``cluster_doc``, ``cluster_paragraph`` (the
    cluster's first paragraph by id and number, parts of lines that go as a whole coming last) and
    ``kept``, true for that first one: the others are to be removed. Paragraphs with a
    Jaccard similarity of ``similarity`` percent or more over five-word shingles are linked and
    clusters are connected components. Bands are tuned so that a pair at the threshold is missed
    once in a thousand; every link is confirmed on the full sets. Equal paragraphs are one class
    first, so their number costs nothing further. A paragraph of fewer than five words is one shingle.

    Shorter paragraphs take no part, so NULL, empty and wordless texts give
    no row; neither do rows with a NULL id, which could not be named. Rows repeated as a whole count
    once. Other columns are ignored; an empty table gives no row.
    """
    rows_in = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    bands, rows = tune(similarity / 100)
    bound_batches(docs.sparkSession)
    same = ["one", "two", "n"]
    units = materialize(paragraph_table(rows_in, bands, rows, min_words, min_line_words, similarity))
    keys = _shared_keys(units, bands)
    # Most paragraphs have no equal and share no key: the others go on, without their keys.
    wanted = materialize(
        units.groupBy("one").count().where("count > 1").select(F.col("one").alias("id")).unionByName(keys.select("id")).distinct()
    )
    like = materialize(only(units.select("doc", "unit", "line", "begin", "end", "words", *same), "one", wanted))
    discard(units, wanted)
    release(docs.sparkSession)
    of_class = materialize(like.groupBy(*same).agg(F.min(F.struct("doc", "unit")).alias("id"), F.max(F.struct("doc", "unit")).alias("last")))

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = materialize(only(of_class, "one", ids).groupBy("id.doc").agg(F.collect_list(F.struct("id.unit", "one")).alias("units")))
        return _sets(rows_in, wanted, min_words, min_line_words)

    placed = link(keys, sets_of, similarity, shared=True)
    linked = materialize(of_class.join(placed.withColumnRenamed("id", "one"), "one"))
    firsts = linked.groupBy("component").agg(F.min("id").alias("first"))
    classes = linked.join(firsts, "component").select(*same, "first").unionByName(
        of_class.where("id <> last").join(placed.select(F.col("id").alias("one")), "one", "left_anti").select(*same, F.col("id").alias("first"))
    )
    found = materialize(like.join(materialize(classes), same).select("doc", "unit", "line", "begin", "end", "words", "first").distinct())
    discard(like, of_class, linked)
    if lone_words > 1:
        found = materialize(found.where("unit % 2 = 0").unionByName(_beside(found.where("unit % 2 = 1"), lone_words)))
    # A part that goes with its line cannot stand for its cluster while one elsewhere can.
    lines = found.where("unit % 2 = 1 AND first <> struct(doc, unit)").select("doc", "line").distinct()
    parts = found.where("unit % 2 = 0").select("doc", "unit", "line", "first")
    gone = parts.join(lines, ["doc", "line"], "left_semi").where("first = struct(doc, unit)").select("first")
    moved = materialize(
        parts.join(materialize(gone), "first", "left_semi").join(lines, ["doc", "line"], "left_anti")
        .groupBy("first").agg(F.min(F.struct("doc", "unit")).alias("instead"))
    )
    named = found.join(moved, "first", "left").withColumn("first", F.coalesce("instead", "first"))
    return named.select(
        F.col("doc").alias(doc_id), (F.col("unit") % 2 == 1).alias("whole"), F.shiftright("unit", 1).alias("paragraph"), "begin", "end",
        F.col("first.doc").alias("cluster_doc"), F.shiftright("first.unit", 1).alias("cluster_paragraph"),
        ((F.col("first.doc") == F.col("doc")) & (F.col("first.unit") == F.col("unit"))).alias("kept"),
    )


def without_paragraphs(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the paragraphs that ``found`` does not keep cut from their texts.

    All rows and columns stay; NULL text and texts without a removed paragraph are untouched.
    """
    key, lost = fresh(docs, "_doc"), fresh(docs, "_gone")
    gone = found.where("NOT kept").groupBy(F.col(doc_id).alias(key)).agg(F.collect_set(F.struct("begin", "end")).alias(lost))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for t, g in zip(texts.to_pylist(), gone.to_pylist()):
            if t is not None and g:
                data, at, left = t.encode(), 0, []
                for x in sorted(g, key=lambda x: x["begin"]):
                    left.append(data[at:x["begin"]])
                    at = max(at, x["end"])
                t = b"".join([*left, data[at:]]).decode()
            out.append(t)
        return pa.array(out, pa.string())

    joined = docs.join(gone.hint("merge"), F.col(doc_id) == F.col(key), "left").withColumn(text, cut(F.col(text), F.col(lost)))
    return joined.select(*docs.columns)

"""Near-duplicate documents by min-max hashing of word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.scratch import materialize
from zonalis.llm import shingles as S
from zonalis.llm.names import fresh
from zonalis.llm.neardup import link, only, release
from zonalis.llm.worker import bound_batches

#: Values per band. Unrelated texts share a few hundredths of their short shingles, so a band of
#: five is hit by one such pair in ten million.
ROWS = 5
MISS = 4e-6


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = S.buffer_of(texts)
    hashes, starts, _ = S.words(data, offsets)
    values, unit = S.shingle(hashes, np.searchsorted(starts, offsets), size)
    return S.distinct(values, unit, len(texts))


def signatures(docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """(id, n, digest, keys) of each row of ``docs`` (id, text): set size, set identity, band keys.

    The minimum and the maximum under one permutation are two values that agree with the sets'
    similarity each, so half as many hashes fill the bands.
    """
    bands = S.bands_for(similarity / 100, ROWS, MISS)
    bands += bands % 2
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in S.pieces(batch.column(1)):
                values, starts = _sets(texts, size)
                n = np.diff(starts)
                full = np.flatnonzero(n)
                keys = np.zeros((0, bands), np.int64)
                if len(full):
                    keys = S.band_keys(S.min_max(values, starts[full], bands * ROWS // 2), ROWS)
                digests = [
                    hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None
                    for a, b in zip(starts[:-1], starts[1:])
                ]
                widths = np.zeros(len(n) + 1, np.int32)
                widths[1:][full] = bands
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.cumsum(widths), pa.int32()), pa.array(keys.reshape(-1), pa.int64()))],
                    ["id", "n", "digest", "keys"],
                )

    return docs.select("id", "text").mapInArrow(sign, f"id {kind}, n bigint, digest binary, keys array<bigint>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, members) of each row of ``docs`` (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in S.pieces(batch.column(1)):
                values, starts = _sets(texts, size)
                members = [S.pack(values[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(np.diff(starts), pa.int64()), pa.array(members, pa.binary())],
                    ["id", "n", "members"],
                )

    return docs.select("id", "text").mapInArrow(collect, f"id {kind}, n bigint, members binary")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: int = 80,
) -> DataFrame:
    """(``doc_id``, n_shingles, component_id, kept) of each distinct id.

    Documents whose sets of ``size``-word shingles have a Jaccard similarity of ``similarity`` percent
    or more are linked; a component is named by its smallest id, and that document is kept. Candidates
    come from bands that miss a pair at the threshold with probability 4e-6; links are confirmed on
    full sets. Documents with equal sets are one class first, so a group of copies of any size costs
    as much as one document.

    A text with fewer words than ``size`` is one shingle. NULL text, or one without words, has an
    empty set and is linked with nothing. Rows that share an id are one row of the result, with the
    largest set and the smallest component of its texts. A NULL id gets one row too, is never linked
    and is kept, its component NULL. Other columns are ignored; an empty table gives no row.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    signed = materialize(signatures(rows, size, similarity))
    named = signed.where("id IS NOT NULL AND digest IS NOT NULL")
    # Equal sets have equal keys, so one aggregate names the classes and carries the keys of each.
    keyed = named.groupBy("digest").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
    bands = materialize(keyed.select("id", F.explode("keys").alias("key")).distinct())
    classes = named.groupBy("digest").agg(F.min("id").alias("class"))
    release(docs.sparkSession)

    def sets_of(ids: DataFrame) -> DataFrame:
        # An id with several texts has several sets; the largest stands for it.
        own = full_sets(only(rows, "id", ids), size)
        return own.groupBy("id").agg(F.max(F.struct("n", "members")).alias("s")).select("id", "s.n", "s.members")

    placed = link(bands, sets_of, similarity)
    member = signed.select("id", "n", "digest").join(classes, "digest", "left").join(
        placed.select(F.col("id").alias("class"), "component"), "class", "left"
    )
    return member.groupBy("id").agg(
        F.max("n").alias("n_shingles"), F.min(F.coalesce("component", "class", "id")).alias("component_id")
    ).select(
        F.col("id").alias(doc_id), "n_shingles", "component_id",
        (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: int = 80,
) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns.

    Rows that share an id but not the text are judged each on its own, by the order of id and text
    hash; of rows that share both one stays. Rows with a NULL id stay.
    """
    key, words = fresh(docs, "_unit"), F.xxhash64(F.col(text).cast("string"))
    texts = docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg((F.min(words) != F.max(words)).alias("mixed"))
    unit = F.col(doc_id) if texts.where("mixed").isEmpty() else F.when(F.col(doc_id).isNotNull(), F.struct(F.col(doc_id), words))
    rows = docs.withColumn(key, unit)
    judged = materialize(near_duplicates(rows, key, text, size, similarity).select(
        F.col(key).alias(fresh(rows, "_gone")), "kept", F.col(key).isNull().alias("unnamed")
    ))
    gone = judged.where("NOT kept").drop("kept", "unnamed")
    left = rows.join(gone.hint("merge"), F.col(key) == F.col(gone.columns[0]), "left_anti")
    if rows.where(F.col(key).isNotNull()).select(key).count() > judged.where("NOT unnamed").count():
        left = left.where(F.col(key).isNull()).unionByName(left.where(F.col(key).isNotNull()).dropDuplicates([key]))
    return left.select(*docs.columns)

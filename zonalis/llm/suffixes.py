"""Repeated byte strings by fingerprints at synchronizing positions, in place of prefix doubling.

Doubling over every byte position would write sixteen bytes a round for each byte of text. Strings
are hashed here at positions that the text itself selects: of any 128 consecutive positions at least one is
selected, equal strings select equal places, and about one position in 60 is selected in prose. Every
400-byte string therefore has a first selected position, and equal strings have it at the same place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.scratch import discard, materialize
from zonalis.llm.neardup import only, release
from zonalis.llm.shingles import Roller, buffer_of, mix

#: Bytes of a long text that are looked at together.
SEGMENT = 1 << 20


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks of that width."""
    n, blocks = len(x) - width + 1, -(-len(x) // width)
    padded = np.full(blocks * width, np.uint64((1 << 64) - 1))
    padded[:len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def selected(data: np.ndarray, roll: Roller, reach: int) -> np.ndarray:
    """Positions i where the smallest hash of the ``reach``-byte strings at i..i+reach is at an end.

    Whether i is selected depends on the 2 * reach bytes from i on alone.
    """
    if len(data) < 2 * reach:
        return np.zeros(0, np.int64)
    at = np.arange(len(data) - reach + 1)
    names = roll(at, at + reach)
    least = _sliding_min(names, reach + 1)
    k = len(least)
    return np.flatnonzero((least == names[:k]) | (least == names[reach:reach + k]))


def _ranked(data: np.ndarray, threshold: int, reach: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(position, left, rank, whole) of the selected positions, segment by segment.

    ``left`` bytes before a position have it as their first selected one. ``rank`` names its first
    2 * ``reach`` bytes, on which its selection rests, ``whole`` the left bytes and ``threshold`` bytes on.
    """
    n = len(data)
    for a in range(0, n, SEGMENT):
        low, high = max(0, a - 2 * reach), min(n, a + SEGMENT + threshold + 2 * reach)
        part = data[low:high]
        roll = Roller(part)
        s = selected(part, roll, reach)
        previous = np.concatenate([[-1 if low == 0 else -reach], s[:-1]])
        left = np.minimum(reach - 1, s - previous - 1)
        mine = (s + low >= a) & (s + low < a + SEGMENT)
        s, left = s[mine], left[mine]
        # Positions whose strings would all end beyond the text have nothing to find.
        fits = s - left + low + threshold <= n
        s, left = s[fits], left[fits]
        if len(s):
            end = np.minimum(s + threshold, len(part))
            whole = mix(roll(s - left, end) + left.astype(np.uint64))
            yield s + low, left, roll(s, s + 2 * reach), whole


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A key of each row from its id and text, the same in every scan."""
    t = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    return docs.select(F.col(doc_id).alias("doc"), t.alias("data")).withColumn("id", F.xxhash64("doc", "data"))


def repeated_windows(named: DataFrame, threshold: int, reach: int) -> DataFrame:
    """(id, begin, end) of strings of ``named`` (id, data) that cover all repeated windows of ``threshold`` bytes."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            ids = batch.column(0).to_numpy()
            held, size = [], 0
            for k in range(batch.num_rows):
                for rows in _ranked(data[offsets[k]:offsets[k + 1]], threshold, reach):
                    held.append((np.full(len(rows[0]), ids[k]), *rows))
                    size += len(rows[0])
                    if size > 200_000:
                        yield table(held)
                        held, size = [], 0
            if held:
                yield table(held)

    def table(held: list) -> pa.RecordBatch:
        ids, at, left, rank, whole = (np.concatenate(c) for c in zip(*held))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(at), pa.array(left.astype(np.int32)), *[pa.array(c.view(np.int64)) for c in (rank, whole)]],
            ["id", "at", "left", "rank", "whole"],
        )

    rows = materialize(named.where(F.octet_length("data") >= threshold).select("id", "data").mapInArrow(
        rank, "id bigint, at bigint, left int, rank bigint, whole bigint"
    ))
    # Each step counts equal hashes and goes on with the positions that are not unique: the hash of 256
    # bytes, then that of the bytes before and up to the threshold, then those of single windows.
    # The counts are written first: a join of two written tables can be split where one hash is hot.
    again = materialize(rows.groupBy("rank").count().where("count > 1").select(F.col("rank").alias("id")))
    release(named.sparkSession)
    rows, done = materialize(only(rows, "rank", again)), rows
    discard(done, again)
    release(named.sparkSession)
    contexts = materialize(rows.groupBy("rank", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at", "left")).alias("row")))
    settled = _merged(rows.join(contexts.where("n > 1").select("rank", "whole"), ["rank", "whole"], "left_semi").select(
        "id", (F.col("at") - F.col("left")).alias("begin"), (F.col("at") + threshold).alias("end")
    ))
    settled = materialize(settled)
    # A context of its own can still share some of its windows with the other contexts of its rank.
    mixed = contexts.groupBy("rank").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select("rank")
    unsettled = materialize(contexts.join(mixed, "rank").groupBy("row.id").agg(
        F.collect_list(F.struct(F.col("row.at").alias("at"), F.col("row.left").alias("left"), (F.col("n") == 1).alias("open"))).alias("spots")
    ))
    discard(rows, contexts)
    release(named.sparkSession)
    opened = _open_windows(named.select("id", "data"), unsettled, threshold)
    return settled.select("id", F.inline("spans")).unionByName(opened)


def _open_windows(named: DataFrame, spots: DataFrame, threshold: int) -> DataFrame:
    """Windows at the open ``spots`` that occur at another spot, each by the hash of its bytes."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            ids = batch.column(0).to_numpy()
            for k in range(batch.num_rows):
                text = data[offsets[k]:offsets[k + 1]]
                spots = batch.column(2)[k].values
                at, left = spots.field("at").to_numpy(), spots.field("left").to_numpy()
                open_ = spots.field("open").to_numpy(zero_copy_only=False)
                order = np.argsort(at)
                at, left, open_ = at[order], left[order], open_[order]
                for i in range(0, len(at), 4096):
                    j = min(i + 4096, len(at))
                    size = left[i:j] + 1
                    begin = np.repeat(at[i:j] - left[i:j], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    flag = np.repeat(open_[i:j], size)
                    fits = begin + threshold <= len(text)
                    begin, flag = begin[fits], flag[fits]
                    for a in range(0, len(begin), 50_000):
                        yield hashed(ids[k], text, begin[a:a + 50_000], flag[a:a + 50_000])

    def hashed(name: int, text: np.ndarray, begin: np.ndarray, flag: np.ndarray) -> pa.RecordBatch:
        low, high = int(begin.min()), int(begin.max()) + threshold
        roll = Roller(text[low:high])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(begin), name)), pa.array(begin), pa.array(flag),
             pa.array(roll(begin - low, begin - low + threshold).view(np.int64))],
            ["id", "begin", "open", "hash"],
        )

    windows = materialize(
        named.join(spots.hint("merge"), "id").select("id", "data", "spots").mapInArrow(expand, "id bigint, begin bigint, open boolean, hash bigint")
    )
    release(named.sparkSession)
    again = windows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("open")).where("n > 1 AND open").select(
        F.col("hash").alias("id")
    )
    found = _merged(only(windows.where("open"), "hash", again).select("id", "begin", (F.col("begin") + threshold).alias("end")))
    found = materialize(found)
    discard(windows, spots)
    release(named.sparkSession)
    return found.select("id", F.inline("spans"))


def _merged(found: DataFrame) -> DataFrame:
    """(id, spans): the (id, begin, end) strings of each id joined to maximal runs."""
    grouped = found.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("found"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for k in range(batch.num_rows):
                found = batch.column(1)[k].values
                begin, end = found.field("begin").to_numpy(), found.field("end").to_numpy()
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                heads = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
                tails = np.concatenate([heads[1:], [len(end)]]) - 1
                runs.append([{"begin": a, "end": b} for a, b in zip(begin[heads].tolist(), end[tails].tolist())])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind)], ["id", "spans"])

    return grouped.mapInArrow(merge, "id bigint, spans array<struct<begin:bigint,end:bigint>>")


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 400,
) -> DataFrame:
    """(``doc_id``, n_bytes, n_removed, n_spans, spans, kept) of each row of ``docs``.

    Every byte covered by a ``threshold``-byte string that also starts anywhere else, in another
    document or the same one, is removed; ``spans`` are the maximal removed runs as (begin, end) in
    bytes of the UTF-8 text and ``kept`` the remaining bytes. Strings never cross documents and are
    judged on the input.

    NULL text is empty; texts shorter than ``threshold`` lose nothing. Repeated rows repeat each
    other's strings and lose all their bytes if they have ``threshold`` or more. A NULL id is carried
    as it is. Other columns are ignored; an empty table gives no row.
    """
    reach = (threshold + 1) // 3 - threshold // 80
    named = _named(docs, doc_id, text)
    spans = materialize(_merged(repeated_windows(named, threshold, reach)))
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            sizes, gone, spans, kept = [], [], [], []
            for k in range(batch.num_rows):
                own = data[offsets[k]:offsets[k + 1]]
                # The last string of a text may have been named with bytes beyond its end.
                runs = [(r["begin"], min(r["end"], len(own))) for r in batch.column(2)[k].as_py() or ()]
                keep = np.ones(len(own), bool)
                for a, b in runs:
                    keep[a:b] = False
                sizes.append(len(own))
                spans.append([{"begin": a, "end": b} for a, b in runs])
                gone.append(sum(b - a for a, b in runs))
                kept.append(own[keep].tobytes() if runs else own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc", "n_bytes", "n_removed", "spans", "kept"],
            )

    # By key at every size: at scale the spans are too many for a broadcast.
    return named.join(spans.hint("merge"), "id", "left").select("doc", "data", "spans").mapInArrow(
        cut, f"doc {kind}, n_bytes bigint, n_removed bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary"
    ).select(F.col("doc").alias(doc_id), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "spans", "kept")


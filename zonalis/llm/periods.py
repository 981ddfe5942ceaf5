"""Runs of periodic words by internal pattern matching.

A run of period q and at least four periods holds a dyadic block, a stretch of 2**k words that begins
at a multiple of 2**k, with q < 2**k <= 2q, that occurs again q words before or after. The block's
occurrences in the window of its own length on either side follow one another at one step, which is
the least period of what they cover, so the step to the nearest one is a candidate period. All
occurrences of a block are one interval of the suffix array; the nearest position in it is found by a
range successor search in a wavelet tree over that array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.shingles import pieces as slices

#: Bytes of text whose words are searched together; a longer text is searched on its own.
SLICE = 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class WaveletTree:
    """Order statistics of any stretch of an integer array, one bit of the values per level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            one = values >> bit & 1 == 1
            zeros = np.zeros(len(values) + 1, np.int64)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each stretch [low, high) are less than its ``bound``."""
        count = np.zeros(len(low), np.int64)
        for bit, zeros, split in self.levels:
            a, b = zeros[low], zeros[high]
            right = bound >> bit & 1 == 1
            count += np.where(right, b - a, 0)
            low, high = np.where(right, split + low - a, a), np.where(right, split + high - b, b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of the given rank, from 0, of each stretch [low, high)."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros, split in self.levels:
            a, b = zeros[low], zeros[high]
            right = rank >= b - a
            rank = rank - np.where(right, b - a, 0)
            value |= right.astype(np.int64) << bit
            low, high = np.where(right, split + low - a, a), np.where(right, split + high - b, b)
        return value


def suffix_intervals(words: np.ndarray, first: np.ndarray):
    """The part of the suffix array whose suffixes share two words with another of their document.

    ``words`` are word numbers of documents one after another and ``first`` the places where these
    begin and the last one ends. Returns the text position in each slot of the array and the dyadic
    blocks that occur more than once in their document: start, size, and interval of slots.
    """
    n, counts = len(words), np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    begin, end = first[:-1][owner], first[1:][owner]
    at = np.flatnonzero(np.arange(n) + 1 < end)
    # Order by document and first two words; each round of doubling then takes in as many words again.
    pair = np.lexsort((words[at + 1], words[at], owner[at]))
    at = at[pair]
    new = np.ones(len(at), bool)
    new[1:] = (owner[at[1:]] != owner[at[:-1]]) | (words[at[1:]] != words[at[:-1]]) | (words[at[1:] + 1] != words[at[:-1] + 1])
    group = np.flatnonzero(new)
    sizes = np.diff(np.append(group, len(at)))
    # Ranks only need to tell equal from unequal and keep their order; a document's last word has none.
    rank = np.full(n, -1, np.int64)
    rank[at] = np.repeat(group, sizes)
    shared = np.repeat(sizes > 1, sizes)
    slots, lead = at[shared], rank[at[shared]]
    sizes = sizes[sizes > 1]
    low = np.repeat(np.cumsum(sizes) - sizes, sizes)
    high = low + np.repeat(sizes, sizes)
    live, blocks, size = np.arange(len(slots)), [], 2
    longest = int(counts.max(initial=0))
    while len(live) and size <= longest // 2:
        here = slots[live]
        is_block = (here - begin[here]) % size == 0
        blocks.append((here[is_block], np.full(is_block.sum(), size), low[live[is_block]], high[live[is_block]]))
        ahead = here + size
        inside = ahead < end[here]
        key = np.where(inside, rank[np.where(inside, ahead, 0)], -2)
        # A block must lie within its document: suffixes that end before the next size are unique from here on.
        order = np.lexsort((key, lead[live]))
        here, key, old = here[order], key[order], lead[live]
        slots[live] = here
        new = np.ones(len(live), bool)
        new[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
        group = np.flatnonzero(new)
        sizes = np.diff(np.append(group, len(live)))
        # The slots of an old group are consecutive, in all slots as among the live ones.
        start = live[group]
        lead[live] = np.repeat(old[group] + start - low[start], sizes)
        low[live], high[live] = np.repeat(start, sizes), np.repeat(start + sizes, sizes)
        rank[here] = lead[live]
        live = live[np.repeat((sizes > 1) & (key[group] >= -1), sizes)]
        size *= 2
    out = [np.concatenate(c) for c in zip(*blocks)] if blocks else [np.zeros(0, np.int64)] * 4
    return slots, out


def candidates(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of stretches that two occurrences of a block cover."""
    slots, (start, size, low, high) = suffix_intervals(words, first)
    owner = np.searchsorted(first, slots, "right") - 1
    place = slots - first[owner]
    tree = WaveletTree(place, max(1, int(np.diff(first).max(initial=1)).bit_length()))
    base = first[np.searchsorted(first, start, "right") - 1] if len(start) else start
    own = tree.below(low, high, start - base)
    found = []
    for step in (1, -1):
        there = np.flatnonzero((own + step >= 0) & (own + step < high - low))
        nearest = tree.smallest(low[there], high[there], own[there] + step)
        a, b = start[there], nearest + base[there]
        d, width = np.abs(b - a), size[there]
        use = (2 * d >= width) & (d < width)
        found.append((np.minimum(a, b)[use], (np.maximum(a, b) + width)[use], d[use]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _reach(words: np.ndarray, at: int, limit: int, step: int, period: int) -> int:
    """How many words from ``at`` in direction ``step`` equal those a period on, ``limit`` at most."""
    done, width = 0, 64
    while done < limit:
        width = min(2 * width, limit - done)
        a = at + step * done
        span = slice(a, a + width) if step > 0 else slice(a - width + 1, a + 1)
        differ = np.flatnonzero(words[span] != words[span.start + period:span.stop + period])
        if len(differ):
            return done + int(differ[0] if step > 0 else width - 1 - differ[-1])
        done += width
    return done


def runs(words: np.ndarray, first: np.ndarray, least: int, powers: int) -> dict[int, list[tuple[int, int, int]]]:
    """Per document the sorted (start, length, period) of its runs of ``least`` words and ``powers`` periods or more."""
    a, b, d = candidates(words, first)
    order = np.lexsort((a, d))
    out: dict[int, list] = {}
    last = (-1, -1)
    for start, end, period in zip(a[order].tolist(), b[order].tolist(), d[order].tolist()):
        # Runs of one period overlap in less than a period, so a stretch lies in one run alone.
        if last[0] == period and end <= last[1]:
            continue
        doc = int(np.searchsorted(first, start, "right")) - 1
        begin, stop = int(first[doc]), int(first[doc + 1])
        fore = _reach(words, start, stop - period - start, 1, period)
        back = _reach(words, start - 1, start - begin, -1, period)
        s, e = start - back, start + fore + period
        last = period, e
        if e - s >= max(least, powers * period):
            out.setdefault(doc, []).append((s - begin, e - s, period))
    for found in out.values():
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def find_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, powers: int = 4,
) -> DataFrame:
    """(``doc_id``, n_words, runs, collapsed) of every row of ``docs``.

    Words are parted by ASCII white space. A run is a stretch of consecutive words with smallest
    period q and a length of at least ``least`` and ``powers`` * q that no neighbouring word extends;
    ``runs`` lists (start, length, period) by start and period. ``collapsed`` is the text's words
    joined by one blank, without those that some run holds after its first q words.

    Documents are searched whole and on their own, many small ones at once, in memory proportional
    to a megabyte of text or the longest one; nothing is shuffled. NULL, empty and blank text has no
    word, no run and an empty collapsed text. A NULL or repeated ``doc_id`` is carried as it is; other
    columns are ignored; an empty table gives no row.
    """
    if least < 6 or powers < 4:
        raise ValueError("runs have at least six words and four periods")
    kind = docs.schema[doc_id].dataType.simpleString()
    kind_of_runs = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(1), SLICE):
                split = [(t or "").encode().split() for t in part.to_pylist()]
                first = np.cumsum([0, *map(len, split)])
                number: dict[bytes, int] = {}
                words = np.fromiter(
                    (number.setdefault(w, len(number)) for ws in split for w in ws), np.int64, int(first[-1]))
                found = runs(words, first, least, powers)
                collapsed, listed = [], []
                for k, ws in enumerate(split):
                    own = found.get(k, [])
                    if own:
                        keep = np.ones(len(ws), bool)
                        for s, n, q in own:
                            keep[s + q:s + n] = False
                        ws = [ws[i] for i in np.flatnonzero(keep).tolist()]
                    collapsed.append(b" ".join(ws).decode())
                    listed.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(part)), pa.array(np.diff(first), pa.int64()),
                    pa.array(listed, kind_of_runs), pa.array(collapsed, pa.string()),
                ], ["doc", "n_words", "runs", "collapsed"])

    return docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(
        search, f"doc {kind}, n_words bigint, runs array<{RUN}>, collapsed string"
    ).withColumnRenamed("doc", doc_id)


def repeat_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``text``) with a periodic tail in about one document of ten.

    With h the crc32 of the id's decimal text, g = h div 10 and n words: where h % 10 is 0 and n > 0,
    word i >= a becomes word a + (i - a) % p, for a = g % n and p = 1 + (n - a) div (3 + g % 8). The
    words of such a text are joined by one blank; other texts stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    chosen = docs.select(doc_id, F.col(text).cast("string").alias(text), h.alias("_h")).withColumn(
        "_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    ).withColumn("_n", F.size("_words").cast("bigint"))
    placed = chosen.withColumn("_a", F.expr("if(_n > 0, cast((_h div 10) % _n as int), null)")).withColumn(
        "_p", F.expr("cast(1 + (_n - _a) div (3 + (_h div 10) % 8) as int)"))
    tail = F.expr(
        "slice(flatten(array_repeat(slice(_words, _a + 1, _p), cast((_n - _a) div _p + 1 as int))), 1, cast(_n - _a as int))")
    new = F.concat(F.expr("slice(_words, 1, _a)"), tail)
    return placed.select(doc_id, F.when(F.col("_a").isNull(), F.col(text)).otherwise(F.array_join(new, " ")).alias(text))


def best_run(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties go to the smallest start, then period."""
    return F.aggregate(
        runs, F.lit(None).cast(RUN),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )

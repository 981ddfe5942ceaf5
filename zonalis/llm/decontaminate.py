"""Benchmark items in documents, within an edit budget: exact pieces by pigeonhole, then Myers' distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.scratch import materialize
from zonalis.llm.names import fresh

#: Edits allowed per byte of a normalized item.
RATE = 0.08
#: Normalized bytes below which an item is a phrase that anyone may write: it is matched as whole words only.
MIN_BYTES = 25
#: Bytes of items that are sent to the tasks at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 4_000_000

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalize(data: bytes) -> bytes:
    """Lower case for A-Z, one blank for each run of other ASCII signs and white space; other bytes stay."""
    return b" ".join(data.translate(_PLAIN).split())


def places(data: bytes) -> np.ndarray:
    """Where each byte of the normalized text stands in ``data``; a blank at the first sign of its run."""
    plain = np.frombuffer(data.translate(_PLAIN), np.uint8)
    word = plain != 32
    inner = np.flatnonzero(word)
    if not len(inner):
        return inner
    use = word.copy()
    use[1:] |= word[:-1]
    use[inner[-1] + 1:] = False
    return np.flatnonzero(use)


def pieces_of(item: bytes, edits: int) -> list[tuple[int, bytes]]:
    """(offset, piece): the item cut into edits + 1 parts of nearly equal length; one stays whole under that many edits."""
    cuts = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def _masks(pattern: bytes) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(pattern: bytes, text: bytes, masks: dict[int, int] | None = None) -> list[int]:
    """Least edit distance of ``pattern`` to a substring of ``text`` that ends at each byte, bit-parallel."""
    masks = masks or _masks(pattern)
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, out = full, 0, m, []
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        out.append(score)
    return out


#: Length of the substrings counted before the distance is computed.
GRAM = 4


def _grams(text: bytes) -> list[bytes]:
    return [text[i:i + GRAM] for i in range(len(text) - GRAM + 1)]


class Items:
    """A block of benchmark items and the automaton of their pieces."""

    def __init__(self, items: list[tuple], rate: float, min_bytes: int, every: bool = True):
        import ahocorasick

        self.items, self.min_bytes, self.every = [], min_bytes, every
        parts: dict[bytes, list[tuple[int, int]]] = {}
        for name, text in items:
            edits = int(len(text) * rate) if len(text) >= min_bytes else 0
            for offset, piece in pieces_of(text, edits):
                parts.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((name, text, edits, _masks(text), _masks(text[::-1]), _grams(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in parts.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), uses))
        self.automaton.make_automaton()

    def search(self, data: bytes) -> list[tuple]:
        """(item, begin, end, distance) of the places of ``data`` that hold an item.

        Of places that overlap the best counts, the first on a tie; unless ``every`` is set, of each
        stretch that is searched together.
        """
        text = normalize(data)
        wanted: dict[int, list[int]] = {}
        for last, (length, uses) in self.automaton.iter(text.decode("latin-1")):
            for item, offset in uses:
                wanted.setdefault(item, []).append(last + 1 - length - offset)
        out = []
        for item, starts in wanted.items():
            name, pattern, edits, masks, backward, grams = self.items[item]
            m = len(pattern)
            if m < self.min_bytes:
                end = 0
                for s in starts:
                    if s >= end and text[max(s - 1, 0):s] in (b"", b" ") and text[s + m:s + m + 1] in (b"", b" "):
                        end = s + m
                        out.append((name, s, end, 0))
                continue
            stretches: list[list[int]] = []
            for s in sorted(set(starts)):
                low, high = max(0, s - edits), min(len(text), s + m + edits)
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][1] = max(high, stretches[-1][1])
                else:
                    stretches.append([low, high])
            while stretches:
                low, high = stretches.pop()
                # An edit touches GRAM substrings at most; a stretch that lacks more cannot hold the item.
                there = set(_grams(text[low:high]))
                if high - low < m - edits or sum(g not in there for g in grams) > GRAM * edits:
                    continue
                scores = myers(pattern, text[low:high], masks)
                best = min(scores)
                if best <= edits:
                    end = low + scores.index(best) + 1
                    start = max(low, end - m - edits)
                    back = myers(pattern[::-1], text[start:end][::-1], backward)
                    begin = end - 1 - back.index(best)
                    out.append((name, begin, end, best))
                    if self.every:
                        stretches += [[low, begin], [end, high]]
        if out:
            at = places(data)
            out = [(name, int(at[a]), int(at[b - 1]) + 1, d) for name, a, b, d in out]
        return sorted(out, key=lambda r: (r[1], r[2], str(r[0])))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", rate: float = RATE, min_bytes: int = MIN_BYTES, short: bool = False, every: bool = True,
) -> DataFrame:
    """One row per place where a document holds a benchmark item.

    Columns: ``doc_id``, ``item_id``, ``begin``, ``end`` (bytes of the document's UTF-8 text) and
    ``distance``. Both sides are compared without case, punctuation and layout; an item of n such
    bytes may differ by n * ``rate`` edits. It is cut into one piece more than that, one of which any
    such copy holds unchanged, so no copy within the budget is missed. Documents are scanned once,
    row by row, without a shuffle, for each block of ``BLOCK_BYTES`` of items; only a block is sent
    to the tasks.

    An item of fewer than ``min_bytes`` normalized bytes is found where it stands unchanged, as whole
    words, and only with ``short``: clean documents share such phrases. Of places of one item that overlap the best is reported, the first
    on a tie; without ``every``, only the best of each stretch of neighbouring places.

    NULL or empty documents and items match nothing. NULL ids are carried as they are; repeated rows
    are reported each. Other columns are ignored; an empty table on either side gives no row.
    """
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc {kinds[0]}, item {kinds[1]}, begin bigint, end bigint, distance int"
    found = docs.sparkSession.createDataFrame([], schema)
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).distinct().orderBy("item", "text").collect()
        known = [(r["item"], t) for r in block if len(t := normalize(r["text"].encode())) >= (1 if short else min_bytes)]
        if known:
            found = found.unionByName(_scan(rows, known, schema, rate, min_bytes, every))
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "begin", "end", "distance")


def _scan(rows: DataFrame, known: list[tuple], schema: str, *how) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value, *how)
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(batch.column(1)):
                if text.is_valid:
                    hits = items.search(text.as_buffer().to_pybytes())
                    at.extend([k] * len(hits))
                    found.extend(hits)
            if found:
                names, begin, end, distance = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(names), pa.array(begin, pa.int64()), pa.array(end, pa.int64()),
                     pa.array(distance, pa.int32())],
                    ["doc", "item", "begin", "end", "distance"],
                )

    return rows.mapInArrow(scan, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Items of fewer than ``min_bytes`` normalized bytes are phrases of clean documents and condemn none
    unless ``short`` is set.
    NULL and empty texts stay. Repeated rows share their fate; a NULL id is judged by its own text.
    """
    row, bad_row = fresh(docs, "_row"), fresh(docs, "_bad")
    keyed = docs.withColumn(row, F.xxhash64(F.col(doc_id), F.col(text)))
    leaks = find_leaks(keyed, benchmark, row, text, **{"every": False, **options})
    bad = materialize(leaks.select(F.col(row).alias(bad_row)).distinct())
    return keyed.join(bad.hint("merge"), F.col(row) == F.col(bad_row), "left_anti").drop(row)

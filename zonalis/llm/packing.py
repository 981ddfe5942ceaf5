"""Harmonic packing: token pieces of one reciprocal-capacity class share sequences of fixed count."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm.worker import bound_batches, kept

CAPACITY = 2048
END = 1
#: A document's rest is cut to exact class sizes down to this length; the last piece stays uncut.
FINE = 128
#: Chunks whose ids a worker remembers, and the characters up to which one is remembered.
REMEMBERED = 250_000
LONGEST = 64
#: Bytes of text encoded at once.
CHUNK = 1_000_000

#: Letters for which lower case and composed form are certain, then plain punctuation: such a chunk
#: is one run of letters and one of signs to the tokenizer.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|$%&*#]*)")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Learned(dict):
    """Values that ``learn`` finds for keys that are not there."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, key):
        return self.learn(key)


class WordTokenizer:
    """The ids of whole texts, from a dictionary of the ids of their chunks between blanks.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    chunks one after another. When half of ``REMEMBERED`` chunks are known, they become the older
    half and the one before is forgotten; a chunk that is met again comes back from there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The printable stand-ins of a byte-level vocabulary: bytes without one follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.known, self.older = _Learned(self._learn), {}

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():  # letters and signs of ASCII stand for themselves
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return _packed([t.id for t in self.tokenizer.model.tokenize(piece)])

    def _learn(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            parts = _PLAIN.fullmatch(chunk)
            if parts:
                letters, signs = parts.groups()
                lower = letters.lower()
                ids = self._piece(chunk) if chunk == lower else self.known[lower] + self._signs(signs)
            else:
                ids = _packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        return self._keep(chunk, ids)

    def _signs(self, signs: str) -> bytes:
        if not signs:
            return b""
        ids = self.known.get(signs)
        return self._keep(signs, self._piece(signs)) if ids is None else ids

    def _keep(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= LONGEST:
            if len(self.known) >= REMEMBERED // 2:
                self.older = dict(self.known)
                self.known.clear()
            self.known[chunk] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Little-endian 32-bit ids of each text."""
        # Only blanks that every part of the tokenizer takes as white space; it sees the rest.
        split = (t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), "<u4") for chunks in split]


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """How many pieces of this length a sequence holds: the k with length in (capacity/(k+1), capacity/k]."""
    return capacity // length


def cut(tokens: int, capacity: int = CAPACITY, fine: int = FINE) -> list[int]:
    """Piece lengths of a document: whole sequences, then the largest class sizes that fit, then the rest."""
    sizes = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest > fine:
        size = capacity // -(-capacity // rest)
        sizes.append(size)
        rest -= size
    return sizes + [rest] * (rest > 0)


def _binary(length: int) -> list[int]:
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Packer:
    """The open bins of one worker: one per class, each closed at its class's count."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.next_id = capacity, worker << 40
        self.open: dict[int, list] = {}

    def _close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.next_id, offset
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for size in cut(len(ids), self.capacity):
            k = class_of(size, self.capacity)
            bin_ = self.open.setdefault(k, [])
            # A copy: a view would keep the whole document until the bin is full.
            bin_.append((doc, start, ids[start:start + size].copy(), len(ids)))
            start += size
            if len(bin_) == k:
                yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        """Merge the unfilled bins, cutting at the ends; the last one ends in powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        rooms = [self.capacity] * (total // self.capacity) + _binary(total % self.capacity)
        bin_, free = [], rooms.pop(0) if rooms else 0
        for doc, start, ids, n in left:
            while len(ids):
                part = ids[:free]
                bin_.append((doc, start, part, n))
                start, ids, free = start + len(part), ids[len(part):], free - len(part)
                if not free:
                    yield from self._close(bin_)
                    bin_, free = [], rooms.pop(0) if rooms else 0


def harmonic_pack(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end: int = END,
) -> DataFrame:
    """Pieces of all documents packed into sequences of at most ``capacity`` tokens.

    Columns: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens``,
    ``sequence_id``, ``offset``. A document's ids end with ``end``. It is cut into whole sequences and
    then into the largest class sizes capacity/k that fit its rest, so a class's sequences are full
    but for rounding. Each input partition packs on its own, with no shuffle: it holds less than one
    open sequence per class, and at its end merges those, cutting freely, so the tail is padded
    nowhere: sequences are ``capacity`` long, short by rounding, or an exact power of two.

    NULL and empty text is the end id alone. A NULL or repeated ``doc_id`` is carried as it is; each
    row is packed. Texts of any length are packed whole. Other columns are ignored; an empty table
    gives no row.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(f"words:{tokenizer_path}", lambda: WordTokenizer(tokenizer_path))
        packer = Packer(TaskContext.get().partitionId(), capacity)
        last = np.array([end], "<u4")
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size = rows = 0
                while at + rows < batch.num_rows and (not rows or size < CHUNK):
                    size += len(batch.column(1)[at + rows].as_buffer() or b"")
                    rows += 1
                names = batch.column(0).slice(at, rows)
                texts = [t or "" for t in batch.column(1).slice(at, rows).to_pylist()]
                at += rows
                out = []
                for name, ids in zip(names.to_pylist(), words.encode(texts)):
                    out.extend(packer.add(name, np.concatenate([ids, last])))
                if out:
                    yield table(out, names.type)
        out = list(packer.finish())
        if out:
            yield table(out, names.type)

    def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        name, start, ids, total, seq, offset = zip(*rows)
        long = lambda v: pa.array(v, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(name, kind), long(start), long([len(i) for i in ids]), pa.array([i.tobytes() for i in ids], pa.binary()),
             long(total), long(seq), long(offset)],
            ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    return docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(
        pack, f"doc {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    ).withColumnRenamed("doc", doc_id)

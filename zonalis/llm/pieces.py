"""SentencePiece ids of whole texts by an agenda of adjacent pairs, for merge-type vocabularies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm.shingles import pieces as slices
from zonalis.llm.worker import kept

#: What a blank becomes, and what an unknown id is decoded to.
BLANK, UNKNOWN = "▁", " ⁇ "
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Characters of chunks that a worker remembers before it starts anew.
REMEMBERED = 8_000_000
#: Bytes of text encoded at once.
SLICE = 1 << 20


class MergeVocabulary:
    """Ids of texts under a merge-type vocabulary with byte pieces and a leading blank.

    A text is its characters at first. Every two neighbours that together are a piece stand on an
    agenda, ordered by the piece's score and then from left to right; the best pair becomes one
    symbol, whose pairs with its new neighbours join the agenda, until no pair is left. Characters
    that are no piece become their bytes.

    No merge crosses two characters that no piece holds side by side, so a text falls into parts that
    are encoded on their own, and each is encoded once. Most parts end before a blank.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        self.names = [lib.id_to_piece(i) for i in ids]
        self.bytes = {i: int(self.names[i][3:5], 16) for i in ids if lib.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no piece for every byte")
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.silent = {i for i in ids if lib.is_control(i)}
        self.unknown = lib.unk_id()
        plain = [i for i in ids if i not in self.bytes and i not in self.silent and i != self.unknown]
        self.id = {self.names[i]: i for i in plain}
        self.order = {self.names[i]: -lib.get_score(i) for i in plain}
        self.unused = {self.names[i] for i in plain if lib.is_unused(i)}
        self.beside = {p[k:k + 2] for p in self.id for k in range(len(p) - 1)}
        # Chunks that one pattern can find: letters or other characters, with the blanks before them.
        letter = re.compile(f"[{LETTERS}]").match
        kinds = {tuple(BLANK if c == BLANK else bool(letter(c)) for c in pair) for pair in self.beside}
        apart = kinds <= {(BLANK, BLANK), (BLANK, True), (BLANK, False), (True, True), (False, False)}
        self.chunks = re.compile(f"{BLANK}*(?:[{LETTERS}]+|[^{LETTERS}{BLANK}]+)|{BLANK}+").findall if apart else lambda t: [t]
        # What decodes on its own: every piece, and the bytes of ASCII.
        self.shows = [
            n.replace(BLANK, " ") if n in self.id else chr(self.bytes[i]) if self.bytes.get(i, 128) < 128 else None
            for i, n in enumerate(self.names)]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.shown: list[str] = []
        self.parts: dict[str, tuple[int, ...]] = {}
        self.differs: set[int] = set()
        self.flat, self.ends, self.held = np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    def merged(self, part: str) -> list[str]:
        """The symbols left of ``part`` when the agenda is empty."""
        order, unused = self.order.get, self.unused
        symbols, n = list(part), len(part)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        made: dict[str, tuple[str, str]] = {}
        pairs = [part[k:k + 2] for k in range(n - 1)]
        agenda = [(order(both), k, k + 1, both) for k, both in enumerate(pairs) if both in self.order]
        heapify(agenda)
        while agenda:
            _, left, right, both = heappop(agenda)
            a, b = symbols[left], symbols[right]
            # A pair is out of date once one of its ends has grown or gone.
            if not a or not b or len(a) + len(b) != len(both):
                continue
            if unused and both in unused:
                made[both] = a, b
            symbols[left], symbols[right] = both, ""
            far, near = after[right], before[left]
            after[left] = far
            if far >= 0:
                before[far] = left
                grown = both + symbols[far]
                rank = order(grown)
                if rank is not None:
                    heappush(agenda, (rank, left, far, grown))
            if near >= 0:
                grown = symbols[near] + both
                rank = order(grown)
                if rank is not None:
                    heappush(agenda, (rank, near, left, grown))
        out = [s for s in symbols if s]
        while made and any(s in made for s in out):  # unused pieces only lead to others
            out = [x for s in out for x in made.get(s, (s,))]
        return out

    def _part(self, part: str) -> list[int]:
        out = []
        for symbol in self.merged(part):
            known = self.id.get(symbol)
            if known is not None:
                out.append(known)
            else:
                out.extend(map(self.byte_id.__getitem__, symbol.encode("utf-8", "surrogatepass")))
        return out

    def _chunk(self, chunk: str) -> list[int]:
        out, start, beside, parts = [], 0, self.beside, self.parts
        for k in range(1, len(chunk) + 1):
            if k == len(chunk) or chunk[k - 1:k + 1] not in beside:
                part = chunk[start:k]
                ids = parts.get(part)
                if ids is None:
                    ids = parts[part] = tuple(self._part(part))
                    self.held += len(part)
                out += ids
                start = k
        return out

    def _learn(self, chunks: list[str]) -> None:
        new, sizes = [], []
        first = len(self.number)
        # The library puts a blank before each text; no piece reaches over the line feed behind it.
        theirs = self.library.encode([f"\n{c}" for c in chunks], num_threads=1)
        for k, (chunk, known) in enumerate(zip(chunks, theirs), first):
            ids = self._chunk(chunk)
            if ids != known[2:]:
                self.differs.add(k)
            new += ids
            sizes.append(len(ids))
            # No character is parted between chunks, so their texts follow one another like their ids.
            shown = [self.shows[i] for i in ids]
            self.shown.append(self.decode(ids, led=True) if None in shown else "".join(shown))
            self.held += len(chunk)
        self.number.update(zip(chunks, range(first, first + len(chunks))))
        self.ends = np.append(self.ends, np.cumsum(sizes, dtype=np.int64) + len(self.flat))
        self.flat = np.append(self.flat, np.array(new, np.int32))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], list[bool]]:
        """The ids of all texts one after another, where each text's begin, the decoded texts, and
        whether the library gives the same ids for every chunk of each text."""
        if self.held > REMEMBERED:
            self.clear()
        split = [self.chunks(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        self._learn(list(set().union(*split) - self.number.keys()))
        every = [list(map(self.number.__getitem__, chunks)) for chunks in split]
        at = np.fromiter(chain.from_iterable(every), np.int64, sum(map(len, every)))
        ends = self.ends[at]
        starts = np.where(at > 0, self.ends[at - 1], 0)
        sizes = ends - starts
        behind = np.cumsum(sizes)
        ids = self.flat[np.repeat(starts - behind + sizes, sizes) + np.arange(sizes.sum())]
        bounds = np.concatenate([[0], behind])[np.cumsum([0, *map(len, split)])]
        # Every text begins with the blank that it was given, which decoding takes away again.
        decoded = ["".join(map(self.shown.__getitem__, numbers))[1:] for numbers in every]
        return ids, bounds, decoded, [self.differs.isdisjoint(numbers) for numbers in every]

    def decode(self, ids: list[int], led: bool = False) -> str:
        """The text of ids: pieces with their blanks, bytes as UTF-8, without the leading blank.

        With ``led`` the ids follow others, so that their first blank stays.
        """
        out, run = [], bytearray()
        empty = not led

        def flush() -> None:
            nonlocal empty
            data, at = bytes(run), 0
            while at < len(data):
                try:
                    out.append(data[at:].decode())
                    at = len(data)
                except UnicodeDecodeError as bad:  # one mark for each byte that is part of no character
                    out.append(data[at:at + bad.start].decode() + "�")
                    at += bad.start + 1
            empty = empty and not data
            run.clear()

        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            flush()
            if i in self.silent:
                continue
            piece = UNKNOWN if i == self.unknown else self.names[i]
            if empty and not led and i != self.unknown and piece.startswith(BLANK):
                piece, led = piece[1:], True
            piece = piece.replace(BLANK, " ")
            empty = empty and not piece
            out.append(piece)
        flush()
        return "".join(out)

    def agrees(self, texts: list[str], ids: np.ndarray, bounds: np.ndarray, decoded: list[str]) -> list[bool]:
        """Whether the library gives the same ids and the same text back, for each text as a whole."""
        theirs = self.library.encode(texts, num_threads=1)
        back = self.library.decode(theirs, num_threads=1)
        sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
        same = (sizes == np.diff(bounds)).tolist()
        if all(same):
            flat = np.fromiter(chain.from_iterable(theirs), np.int32, int(sizes.sum()))
            wrong = np.concatenate([[0], np.cumsum(flat != ids)])[bounds]
            same = (wrong[1:] == wrong[:-1]).tolist()
        else:
            same = [s and t == ids[a:b].tolist() for s, t, a, b in zip(same, theirs, bounds[:-1], bounds[1:])]
        return [s and x == y for s, x, y in zip(same, decoded, back)]


def encode_pieces(
    docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", whole: bool = False,
) -> DataFrame:
    """(``doc_id``, ids, decoded, agrees) of every row: a text's ids, their text, and the library's verdict.

    ``agrees`` tells whether the library gives the same ids: each chunk of a text is held against it in
    the Arrow batch in which it is new. With ``whole``, every text is, and its decoded text too. There
    is no shuffle and no state beyond a bounded store of encoded parts in each worker.

    NULL and empty text have no ids and decode to the empty text. Texts of any length are encoded
    whole, also without a blank. A NULL or repeated ``doc_id`` is carried as it is; other columns are
    ignored; an empty table gives no row. The vocabulary must merge pairs, have byte pieces, put a
    blank first and change no other character.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = kept(f"merges:{model_path}", lambda: MergeVocabulary(model_path))
        for batch in batches:
            for at, part in slices(batch.column(1), SLICE):
                texts = [t or "" for t in part.to_pylist()]
                ids, bounds, decoded, same = vocabulary.encode(texts)
                if whole:
                    same = vocabulary.agrees(texts, ids, bounds, decoded)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(part)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)),
                    pa.array(decoded, pa.string()),
                    pa.array(same, pa.bool_()),
                ], ["doc", "ids", "decoded", "agrees"])

    return docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc {kind}, ids array<int>, decoded string, agrees boolean"
    ).withColumnRenamed("doc", doc_id)

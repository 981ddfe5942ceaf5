"""Spelling variants: pairs of words one edit apart, by composition of finite-state machines.

The vocabulary's minimised acceptor is composed with a transducer of exactly one edit and with the
acceptor again; what the composed machine accepts are the pairs of words that are near each other.
The work is cut by initial states of that machine: two words one edit apart first differ at one place,
so they share all letters before it and after it. A partition holds the words of one prefix and one
suffix between which the first difference is sought; its machine starts in the state that the prefix
leads to. Prefix and suffix are half of a word at first. A partition that is too large is parted
again at half of what is left, down to a single place, where the alphabet bounds it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.scratch import discard, materialize

LETTERS = "A-Za-zÀ-ÿ"
#: Words that a task counts before it hands them on.
COUNTED = 300_000
#: Words of one partition beyond which it is parted, if more than one place is left.
PARTITION = 4_000
#: How many times as frequent a word must be to be a variant's form.
TIMES = 5


def count_words(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, misspell: int | None = None,
) -> DataFrame:
    """(word, n) of the letter runs of all texts with ``least`` code points or more, A-Z in lower case.

    ``misspell`` deletes a letter of some runs first: with h the crc32 of ``<doc_id>:<run>``, where
    ``misspell`` divides h the run's letter h % length goes. Counts combine in the tasks and again
    before the shuffle, so a frequent word costs no more than a rare one. NULL text has no word; a
    NULL id is the empty text in h. Other columns are ignored; an empty table gives no row.
    """
    find = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1)):
                # Lower case of bytes is that of A-Z alone.
                runs = find((value.as_py() or "").encode().lower().decode())
                if misspell is None:
                    seen.update(runs)
                else:
                    start = zlib.crc32(f"{name.as_py() or ''}:".encode())
                    for run, n in Counter(runs).items():
                        h = zlib.crc32(run.encode(), start)
                        if h % misspell == 0:
                            k = h % len(run)
                            run = run[:k] + run[k + 1:]
                            if len(run) < least:
                                continue
                        seen[run] += n
                if len(seen) > COUNTED:
                    yield done()
        if seen:
            yield done()

    rows = docs.select(F.col(doc_id).cast("string").alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimal acyclic automaton of a sorted list of words, built word by word."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        self.known: dict[tuple, int] = {}
        path, last = [0], ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and word[same] == last[same]:
                same += 1
            self._fold(path, last, same)
            for letter in word[same:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][letter] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = word
        self._fold(path, last, 0)

    def _fold(self, path: list[int], word: str, keep: int) -> None:
        """Replace the states of the last word beyond ``keep`` letters by equal ones known already."""
        while len(path) > keep + 1:
            state = path.pop()
            shape = (self.final[state], tuple(self.arcs[state].items()))
            equal = self.known.setdefault(shape, state)
            self.arcs[path[-1]][word[len(path) - 1]] = equal


class Composition:
    """Pairs that acceptor, one-edit transducer and acceptor accept together.

    Before the edit both words are in the states of one common prefix. The edit is the first place at
    which they differ: a letter for another, or a letter more. Behind it both read the same letters.
    """

    def __init__(self, left: Acceptor, right: Acceptor):
        self.left, self.right = left, right
        self.rest: dict[tuple[int, int], list[str]] = {}

    def common(self, p: int, q: int) -> list[str]:
        """What both automata accept from the states p and q on; a dead end is remembered as such."""
        out = self.rest.get((p, q))
        if out is None:
            a, b = self.left.arcs[p], self.right.arcs[q]
            out = [""] if self.left.final[p] and self.right.final[q] else []
            for letter in a.keys() & b.keys():
                out += [letter + rest for rest in self.common(a[letter], b[letter])]
            self.rest[p, q] = out
        return out

    def replaced(self) -> Iterator[tuple[str, str]]:
        """Pairs that differ in one letter, the lesser word first; both acceptors are the same."""
        stack = [("", 0)]
        while stack:
            read, p = stack.pop()
            arcs = self.left.arcs[p]
            letters = sorted(arcs)
            for i, c in enumerate(letters):
                stack.append((read + c, arcs[c]))
                for d in letters[i + 1:]:
                    for rest in self.common(arcs[c], arcs[d]):
                        yield read + c + rest, read + d + rest

    def inserted(self, at_end: bool) -> Iterator[tuple[str, str]]:
        """Pairs of a left word and a right one with a letter more; ``at_end`` also behind the whole left word."""
        stack = [("", 0, 0)]
        while stack:
            read, p, q = stack.pop()
            a, b = self.left.arcs[p], self.right.arcs[q]
            for d, after in b.items():
                if d in a:
                    stack.append((read + d, a[d], after))
                for rest in self.common(p, after):
                    # The letter comes first where the words differ: not before its like, nor at an end that is none.
                    if rest[0] != d if rest else at_end:
                        yield read + rest, read + d + rest


def near_pairs(shorter: list[str], longer: list[str], at_end: bool) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart among ``shorter``, words of one length, and from them to ``longer``, one letter longer.

    The edit lies in what is given of the words; it stands behind a whole word only if ``at_end``.
    """
    own = Acceptor(sorted(shorter))
    if len(shorter) > 1:
        yield from Composition(own, own).replaced()
    if longer:
        yield from Composition(own, Acceptor(sorted(longer))).inserted(at_end)


def _key(size: Column, before: Column, behind: Column) -> Column:
    """Identity of the partition: word length, and prefix and suffix with their lengths."""
    n = F.length("word")
    head = F.substring("word", F.lit(1), before)
    tail = F.substring("word", n - behind + 1, behind)
    return F.struct(size.alias("size"), before.alias("before"), behind.alias("behind"), head.alias("head"), tail.alias("tail"))


def _partitions(words: DataFrame, partition: int) -> tuple[DataFrame, list[DataFrame]]:
    """(word, n, key) of each word in every partition that holds more than one word, and the tables behind it.

    A word of length m is in partitions of length m and, as the longer word of a pair, of length m - 1.
    """
    m = F.length("word")
    sizes = words.select("word", "n", F.explode(F.array(m, m - 1)).alias("size")).where("size > 0")
    half = F.expr("size div 2")
    now = sizes.select("word", "n", F.explode(F.array(
        _key(F.col("size"), half, F.lit(0)), _key(F.col("size"), F.lit(0), F.col("size") - half))).alias("key"))
    done, behind, left = [], [], F.expr("key.size - key.before - key.behind")
    while True:
        now = materialize(now)
        per = materialize(now.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"))
        large = (F.col("many") > partition) & (left > 1)
        behind += [now, per]
        done.append(now.join(per.where(~large).select("key"), "key", "left_semi"))
        over = per.where(large).select("key")
        if over.isEmpty():
            out = done[0]
            for more in done[1:]:
                out = out.unionByName(more)
            return out, behind
        step = F.expr("cast(floor((key.size - key.before - key.behind) / 2) as int)")
        whole = now.join(over, "key", "left_semi")
        now = whole.select("word", "n", F.explode(F.array(
            _key(F.col("key.size"), F.col("key.before") + step, F.col("key.behind")),
            _key(F.col("key.size"), F.col("key.before"), F.col("key.size") - F.col("key.before") - step))).alias("key"))


def near_words(words: DataFrame, partition: int = PARTITION) -> tuple[DataFrame, list[DataFrame]]:
    """(word, near, near_n), both directions of every pair of ``words`` (word, n) that is one edit apart.

    The scratch tables that this reads are returned beside it. A pair comes out of one partition alone. A task reads the partitions that it was dealt one after
    another and holds one of them, of ``partition`` words or, where only one place is left, of as many
    as the alphabet allows.
    """
    members, behind_it = _partitions(words, partition)
    placed = members.select(
        F.xxhash64("key").alias("hash"), "key.size", "key.before", "key.behind", "key.head", "key.tail", "word", "n")
    names = ["size", "before", "behind", "head", "tail"]
    dealt = placed.repartition("hash").sortWithinPartitions("hash", *names)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def pairs() -> Iterator[tuple]:
            if key is None or len(held) < 2:
                return
            size, before, behind, head, tail = key
            inner = [(w, w[before:len(w) - behind]) for w in held]
            shorter = [i for w, i in inner if len(w) == size]
            longer = [i for w, i in inner if len(w) > size]
            if shorter:
                for a, b in near_pairs(shorter, longer, behind == 0):
                    a, b = head + a + tail, head + b + tail
                    yield a, b, held[b]
                    yield b, a, held[a]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            word, near, n = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])

        out: list[tuple] = []
        for batch in batches:
            columns = batch.to_pydict()
            for *mine, word, n in zip(*[columns[c] for c in names], columns["word"], columns["n"]):
                if mine != key:
                    out.extend(pairs())
                    key, held = mine, {}
                    if len(out) > 10_000:
                        yield batch_of(out)
                        out = []
                held[word] = n
        for row in pairs():
            out.append(row)
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(compose, "word string, near string, near_n bigint"), behind_it


def spelling_variants(words: DataFrame, times: int = TIMES, partition: int = PARTITION) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n), whose words are distinct.

    Words are near if they differ by one inserted, deleted or replaced code point. A word's form is
    its near word of largest n, the first in code-point order on a tie, if that n is at least ``times``
    the word's; else NULL. The root is what the forms lead to, the word itself without a form.
    ``form_n`` is the form's n.

    Every step multiplies n by ``times``, so few rounds follow the forms; each is a join by key of the
    words still on their way. Rows with a NULL word or n are ignored; an empty table gives no row. The
    partitions are written and counted while the query is built.
    """
    known = materialize(words.select("word", F.col("n").cast("bigint").alias("n")).where("word IS NOT NULL AND n IS NOT NULL"))
    pairs, behind = near_words(known, partition)
    near = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= F.lit(times) * F.col("n")
    named = materialize(known.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    discard(known, *behind)
    step = named.where("form IS NOT NULL").select(F.col("word").alias("at"), F.col("form").alias("next"))
    way, ends = named.where("form IS NOT NULL").select("word", F.col("form").alias("at")), []
    while True:
        way = materialize(way.join(step, "at", "left"))
        ends.append(way.where("next IS NULL").select("word", F.col("at").alias("root")))
        way = way.where("next IS NOT NULL").select("word", F.col("next").alias("at"))
        if way.isEmpty():
            break
    roots = ends[0]
    for more in ends[1:]:
        roots = roots.unionByName(more)
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Line deduplication by pairwise alignment of documents that share runs of lines."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.scratch import discard, materialize
from zonalis.llm.names import fresh
from zonalis.llm.neardup import release
from zonalis.llm.worker import bound_batches

#: Words that a deleted block has at least: shorter runs of equal lines are phrases, not copies.
MIN_WORDS = 6


def _word_count(line):
    return F.size(F.array_remove(F.split(line, r"[\x20\x09-\x0D]+", -1), ""))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc, at, line, words): the hash of every line of ``docs`` (doc, text) that has a word."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("at", "content"))
    return lines.where(F.col("content").rlike(r"[^\x20\x09-\x0D]")).select(
        "doc", "at", F.xxhash64("content").alias("line"), _word_count(F.col("content")).alias("words")
    )


def patience(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Matching positions of two sequences by patience diff.

    Elements that occur once in both are the anchors; the longest increasing run of their positions
    stands, equal neighbours of anchors join it, and the parts between are aligned in the same way.
    """
    out: list[tuple[int, int]] = []
    open_ = [(0, len(left), 0, len(right))]
    while open_:
        a, b, c, d = open_.pop()
        while a < b and c < d and left[a] == right[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once, again = Counter(left[a:b]), Counter(right[c:d])
        where = {x: c + k for k, x in enumerate(right[c:d]) if again[x] == 1}
        pairs = [(a + k, where[x]) for k, x in enumerate(left[a:b]) if once[x] == 1 and x in where]
        if not pairs:
            continue
        tails, chain, back = [], [], [-1] * len(pairs)
        for k, (_, j) in enumerate(pairs):
            at = bisect_left(tails, j)
            back[k] = chain[at - 1] if at else -1
            tails[at:at + 1], chain[at:at + 1] = [j], [k]
        anchors, k = [], chain[-1]
        while k >= 0:
            anchors.append(pairs[k])
            k = back[k]
        anchors.reverse()
        i, j = a, c
        for x, y in [*anchors, (b, d)]:
            # An anchor is met again as the first equal pair of the part that it begins.
            if (i, j) != (a, c) or (x, y) != (b, d):
                open_.append((i, x, j, y))
            i, j = x, y
    return sorted(out)


def blocks(matches: list[tuple[int, int]], at_left: list[int], at_right: list[int]) -> Iterator[list[int]]:
    """Runs of matches whose lines are neighbours in both documents, as indices into the left one."""
    run: list[int] = []
    last = None
    for i, j in matches:
        if last is not None and (at_left[i] - at_left[last[0]], at_right[j] - at_right[last[1]]) != (1, 1):
            yield run
            run = []
        run.append(i)
        last = (i, j)
    if run:
        yield run


def least_runs(at: list[int], lines: list[int], words: list[int], min_words: int) -> set[tuple[int, int, int]]:
    """(first, last, hash) of the shortest runs of neighbouring lines with ``min_words`` words, from and to each line.

    Each line of a common block of ``min_words`` words is in such a run inside the block.
    """
    out = set()
    for k in range(len(at)):
        for step in (1, -1):
            end, n = k, words[k]
            while n < min_words and 0 <= end + step < len(at) and at[end + step] == at[end] + step:
                end += step
                n += words[end]
            if n >= min_words:
                low, high, name = min(k, end), max(k, end), 0
                for x in lines[low:high + 1]:
                    name = (name * 0x9E3779B97F4A7C15 + x) % (1 << 64)
                out.add((at[low], at[high], name - (1 << 63)))
    return out


def _run_table(sequences: DataFrame, min_words: int) -> DataFrame:
    """(doc, begin, end, run) of the least runs of ``sequences`` (doc, lines)."""
    kind = sequences.schema["doc"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for k in range(batch.num_rows):
                own = batch.column(1)[k].values
                some = least_runs(*(own.field(f).to_pylist() for f in ("at", "line", "words")), min_words)
                row.extend([k] * len(some))
                found.extend(some)
            begin, end, run = (pa.array([x[f] for x in found], t) for f, t in enumerate((pa.int32(), pa.int32(), pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), begin, end, run], ["doc", "begin", "end", "run"])

    return sequences.mapInArrow(read, f"doc {kind}, begin int, end int, run bigint")


def _align(pairs: DataFrame, sequences: DataFrame, min_words: int) -> DataFrame:
    """(doc, gone): the numbers of the lines in common blocks of each pair (doc, other)."""
    side = lambda c, name: sequences.select(F.col("doc").alias(c), F.col("lines").alias(name))
    kind = sequences.schema["doc"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_out, gone = [], []
            for k in range(batch.num_rows):
                own, other = batch.column(1)[k].values, batch.column(2)[k].values
                at, lines, words = (own.field(f).to_pylist() for f in ("at", "line", "words"))
                their_at, theirs = (other.field(f).to_pylist() for f in ("at", "line"))
                found: list[int] = []
                for run in blocks(patience(lines, theirs), at, their_at):
                    if sum(words[i] for i in run) >= min_words:
                        found.extend(at[i] for i in run)
                if found:
                    docs_out.append(k)
                    gone.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(docs_out, pa.int64())), pa.array(gone, pa.list_(pa.int32()))], ["doc", "gone"]
            )

    both = pairs.join(side("doc", "own"), "doc").join(side("other", "theirs"), "other")
    return both.select("doc", "own", "theirs").mapInArrow(align, f"doc {kind}, gone array<int>")


def aligned_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, gone): the numbers of the lines of ``docs`` (doc, text) that an earlier document holds.

    The result is that of an alignment with every earlier document. A common block holds a least run
    of lines with ``min_words`` words, so only holders of a common run are aligned: first with the
    first holder of each run, and then, for the runs that are not gone as a whole, with one, two, four
    and so on of the other holders, until a run is gone or has no earlier holder left. Only lines that
    occur in several documents are sent to the alignment, with their place.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    lines = materialize(line_table(docs).groupBy("doc", "at").agg(F.min("line").alias("line"), F.max("words").alias("words")))
    holders = lines.groupBy("line").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").select("line")
    sequences = materialize(lines.join(holders, "line").groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("at", "line", "words"))).alias("lines")
    ))
    discard(lines)
    release(spark)
    runs = materialize(_run_table(sequences, min_words))
    several = runs.groupBy("run").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").select("run", "first")
    left = materialize(runs.join(several, "run").where("doc > first"))
    release(spark)

    def merged(found: DataFrame) -> DataFrame:
        return materialize(found.groupBy("doc").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")))

    def unexplained(left: DataFrame, gone: DataFrame) -> DataFrame:
        missing = F.array_except(F.sequence("begin", "end"), F.coalesce("gone", F.array().cast("array<int>")))
        return materialize(left.join(gone, "doc", "left").where(F.size(missing) > 0).drop("gone"))

    tried = materialize(left.select("doc", F.col("first").alias("other")).distinct())
    gone = merged(_align(tried, sequences, min_words))
    release(spark)
    left, old = unexplained(left, gone), left
    discard(old)
    several = left.groupBy("run").agg(F.max("doc").alias("latest"), F.first("first").alias("first"))
    held = materialize(runs.select("run", "doc").distinct().join(several, "run").where("doc > first AND doc < latest").select("run", "doc"))
    discard(runs)
    width = 1
    while not held.isEmpty():
        drawn = held.groupBy("run", F.pmod(F.xxhash64("doc"), F.lit(width))).agg(F.min("doc").alias("other")).select("run", "other")
        drawn = materialize(drawn)
        pairs = left.select("doc", "run").join(drawn, "run").where("other < doc").select("doc", "other").distinct()
        pairs = materialize(pairs.join(tried, ["doc", "other"], "left_anti"))
        tried, gone = materialize(tried.unionByName(pairs)), merged(gone.unionByName(_align(pairs, sequences, min_words)))
        left = unexplained(left, gone)
        latest = left.groupBy("run").agg(F.max("doc").alias("latest"))
        rest = held.join(drawn.withColumnRenamed("other", "doc"), ["run", "doc"], "left_anti")
        held = materialize(rest.join(latest, "run").where("doc < latest").select("run", "doc"))
        width *= 2
        release(spark)
    return gone


def dedupe_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "dedup", min_words: int = MIN_WORDS,
) -> DataFrame:
    """``docs`` without the lines of aligned common blocks that an earlier document holds.

    Documents are ordered by ``doc_id``. Two that share lines are aligned by patience diff, and a
    common block, lines that follow each other in both, of ``min_words`` words or more is deleted
    from the later one, whichever earlier document holds it; the first holder of a block keeps it. All columns stay and the struct ``into``
    is added: ``n_lines``, the lines of the input text, and ``removed``, the numbers of the deleted ones.

    NULL text stays NULL with no line; lines without a word are never matched. Rows with a NULL id
    have no order and stay as they are. Rows that share an id are one document, and lose the same
    lines. An empty table gives no row.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    key, lost = fresh(docs, "_doc"), fresh(docs, "_gone")
    gone = materialize(aligned_lines(rows, min_words).select(F.col("doc").alias(key), F.col("gone").alias(lost)))
    release(docs.sparkSession)
    joined = docs.join(gone.hint("merge"), F.col(doc_id) == F.col(key), "left")
    lines = F.split(F.col(text).cast("string"), "\n", -1)
    numbered = F.transform(lines, lambda l, i: F.struct(l.alias("l"), i.alias("i")))
    left = F.transform(F.filter(numbered, lambda x: ~F.array_contains(lost, x["i"])), lambda x: x["l"])
    cut = F.when(F.col(lost).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *[cut.alias(c) if c == text else F.col(c) for c in docs.columns],
        F.struct(
            F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
            F.coalesce(lost, F.array().cast("array<int>")).alias("removed"),
        ).alias(into),
    )

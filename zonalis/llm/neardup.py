"""Exact links between sets that share a band, without a pair for every two members of a bucket."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions.scratch import discard, materialize
from zonalis.llm.components import components
from zonalis.llm.shingles import buffer_of, unpack
from zonalis.llm.worker import bound_batches

#: Members of a bucket that meet in one task, on either side.
BLOCK = 500
#: Members of a bucket up to which its open pairs are rows, as many as this for each member at most.
SMALL = 16


def only(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` is among ``ids`` (one column ``id``).

    Like every join of texts with decisions here it is a join by key at every size, because at scale
    the decisions are too many for a broadcast: what is measured on small tables then holds for large ones.
    """
    return rows.join(ids.withColumnRenamed("id", key).hint("merge"), key, "left_semi")


def confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full ``sets`` (id, n, members) have 100 * overlap >= similarity * union."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("members").alias(f"m_{c}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    # Sizes alone decide most strangers.
    fitting = joined.where(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                part = batch.slice(at, 1 << 16)
                sizes = part.column(2).to_numpy() + part.column(3).to_numpy()
                both = overlaps(part.column(4), part.column(5))
                keep = 100 * both >= similarity * (sizes - both)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep))

    ids = dict(pairs.dtypes)["a"]
    return fitting.select("a", "b", "n_a", "n_b", "m_a", "m_b").mapInArrow(verify, f"a {ids}, b {ids}")


def overlaps(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Common values of the packed sets in each row of two arrays of 65,536 rows at most."""
    held = []
    for sets in (left, right):
        data, offsets = buffer_of(sets)
        held.append((np.repeat(np.arange(len(sets), dtype=np.uint64), np.diff(offsets) // 6) << np.uint64(48)) | unpack(data))
    # The row is above a value's 48 bits, so one sort brings a row's equal values together.
    values = np.sort(np.concatenate(held))
    equal = values[:-1][values[1:] == values[:-1]] >> np.uint64(48)
    return np.bincount(equal.astype(np.int64), minlength=len(left))


def link(bands: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: int, shared: bool = False) -> DataFrame:
    """(id, component) of all ids linked through ``bands`` (id, key), a written table of distinct sets.

    With ``shared`` every key in ``bands`` is known to have several ids. ``sets_of`` returns the full sets (id, n, members) of the written ids that it is given. Components
    need far fewer tests than there are pairs in a bucket:

    1. Every member of a bucket is a candidate with one leader of that bucket, drawn anew in each
       band, so a set has a few leaders among its like. Its most promising leader is tested first.
    2. The candidates that are still in different components are tested.
    3. In a bucket that still holds several components, all members outside the largest one are
       held against all its members, in blocks or, in small buckets, pair by pair where the pair was
       no candidate before. Only there can a link be left, so no link between different components
       of a bucket goes untested, whatever the bucket's size. In a bucket of two nothing is left.
    """
    spark = bands.sparkSession
    bound_batches(spark)
    # Most keys are unique: counts of bare keys tell which, before any id is sent.
    several = bands
    if not shared:
        again = materialize(bands.groupBy("key").count().where("count > 1").select(F.col("key").alias("id")))
        release(spark)
        several = materialize(only(bands, "key", again))
        discard(bands, again)
        release(spark)
    leaders = several.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id")).alias("first")).select(
        "key", F.col("first.id").alias("leader")
    )
    led = materialize(several.join(leaders, "key"))
    discard(several)
    release(spark)
    sets = materialize(sets_of(materialize(led.select("id").distinct())))
    release(spark)
    stars = materialize(
        led.where("id <> leader").groupBy(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    best = stars.groupBy("a").agg(F.max(F.struct("weight", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    tested = materialize(best)
    links = materialize(confirm(tested, sets, similarity))
    placed = components(links)
    release(spark)

    open_ = materialize(across(stars, placed).join(tested, ["a", "b"], "left_anti"))
    links = materialize(links.unionByName(confirm(open_, sets, similarity)))
    placed = components(links)
    discard(tested, open_)
    release(spark)

    member = led.select("id", "key").join(placed, "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    per = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("key").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("top")
    ).where("parts > 1 AND size > 2").select("key", "size", (F.col("size") - F.col("top.n")).alias("few"), F.col("top.component").alias("top"))
    spread = materialize(member.select("id", "key", "component").join(mixed, "key"))
    if not spread.isEmpty():
        open_ = materialize(_pairs(spread.where(F.col("size") <= SMALL)).join(stars.select("a", "b").hint("merge"), ["a", "b"], "left_anti"))
        links = materialize(links.unionByName(confirm(open_, sets, similarity)).unionByName(
            _within(spread.where(F.col("size") > SMALL), sets, similarity)
        ))
        placed = components(links)
    discard(led, stars, sets, spread)
    release(spark)
    return placed


def _pairs(spread: DataFrame) -> DataFrame:
    """(a, b) of the members of different components that share a bucket of ``spread`` (as in :func:`_within`)."""
    rest = spread.where("component <> top").select("key", F.col("id").alias("x"), F.col("component").alias("own"))
    return rest.join(spread.select("key", "id", "component"), "key").where("component <> own").select(
        F.greatest("x", "id").alias("a"), F.least("x", "id").alias("b")
    ).distinct()


def _within(spread: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between members of different components of a bucket.

    ``spread`` (key, id, component, size, few, top) holds buckets of several components, ``few`` of
    whose ``size`` members are outside the component ``top``. Those few are the queries and all
    members the rows that they are held against, both in blocks: a task has ``BLOCK`` of each at most
    and counts overlaps by an inverted index, so no pair becomes a row. One link per query and
    component is enough.
    """
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = spread.withColumns({"wide": blocks("size"), "deep": blocks("few")})
    asked = rows.where("component <> top").select(
        "key", own(F.col("deep")).alias("query"), every(F.col("wide")).alias("block"), F.lit(True).alias("asks"), "id", "component"
    )
    there = rows.select(
        "key", every(F.col("deep")).alias("query"), own(F.col("wide")).alias("block"), F.lit(False).alias("asks"), "id", "component"
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table["asks"].to_numpy(zero_copy_only=False)
        queries, members = np.flatnonzero(asks), np.flatnonzero(~asks)
        packed = table["members"].to_pylist()
        sizes = table["n"].to_numpy()
        _, component = np.unique(np.array([str(c) for c in table["component"].to_pylist()]), return_inverse=True)
        held = [unpack(packed[k]) for k in members]
        values = np.concatenate(held) if held else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(members)), [len(h) for h in held])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        left, right = [], []
        above = list(range(len(asks)))

        def root(c: int) -> int:
            while above[c] != c:
                above[c] = above[above[c]]
                c = above[c]
            return c

        # A link between components that other links of this block join already adds nothing.
        for q in queries:
            own_values = unpack(packed[q])
            low, high = np.searchsorted(values, own_values), np.searchsorted(values, own_values, "right")
            count = high - low
            at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            both = np.bincount(owner[at], minlength=len(members))
            union = sizes[q] + sizes[members] - both
            near = np.flatnonzero((100 * both >= similarity * union) & (component[members] != component[q]))
            _, one = np.unique(component[members[near]], return_index=True)
            for m in members[near[one]]:
                x, y = root(component[q]), root(component[m])
                if x != y:
                    above[x] = y
                    left.append(q)
                    right.append(m)
        ids = table["id"].combine_chunks()
        return pa.table({"a": ids.take(pa.array(left, pa.int64())), "b": ids.take(pa.array(right, pa.int64()))})

    kind = dict(spread.dtypes)["id"]
    return asked.unionByName(there).join(sets, "id").groupBy("key", "query", "block").applyInArrow(compare, f"a {kind}, b {kind}")


def across(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    at = lambda c: placed.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
    return pairs.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left").where(
        F.coalesce("c_a", "a") != F.coalesce("c_b", "b")
    ).select("a", "b")


def release(spark: SparkSession) -> None:
    """Let the driver forget finished jobs, so that Spark deletes their shuffle files on the executors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

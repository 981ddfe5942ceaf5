"""4-connected regions of equal value, their summaries and their outlines."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonalis.functions.blocks import BLOCK, Line, add_block, with_halo
from zonalis.functions.scratch import materialize
from zonalis.functions.skew import HOT_ROWS, lookup
from zonalis.functions.text import number_text
from zonalis.schemas import Georef

LABELLED = "row_idx BIGINT, col_idx BIGINT, value INT, label BIGINT"


# A graph of at most this many pairs is finished in one task.
SMALL_GRAPH = 500_000
# About as many outline edges are chained in one task.
TASK_EDGES = 1_000_000


def _merge(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected number for each of 0..n-1, given the pairs that touch."""
    root = np.arange(n)
    # Pull both roots of every pair down to the smaller one, shorten paths, repeat.
    while True:
        ra, rb = root[a], root[b]
        if np.array_equal(ra, rb):
            return root
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while not np.array_equal(root, root[root]):
            root = root[root]


def _merge_pairs(table: pa.Table) -> pa.Table:
    a, b = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("a", "b"))
    names, spot = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _merge(len(names), spot[:len(a)], spot[len(a):])
    return pa.table({"label": pa.array(names, pa.int64()), "component": pa.array(names[root], pa.int64())})


def _label_block(n_cols: int):
    def label(table: pa.Table) -> pa.Table:
        row, col, value = (
            table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("row_idx", "col_idx", "value"))
        order = np.lexsort((col, row))
        row, col, value = row[order], col[order], value[order]
        r, c = row - row[0], col - col.min()
        spot = np.full((r.max() + 1, c.max() + 1), -1)
        spot[r, c] = np.arange(len(r))
        pairs = [(spot[:, :-1].ravel(), spot[:, 1:].ravel()), (spot[:-1].ravel(), spot[1:].ravel())]
        a, b = (np.concatenate(x) for x in zip(*pairs))
        ok = (a >= 0) & (b >= 0)
        ok[ok] = value[a[ok]] == value[b[ok]]
        root = _merge(len(r), a[ok], b[ok])
        return pa.table({
            "row_idx": pa.array(row, pa.int64()), "col_idx": pa.array(col, pa.int64()),
            "value": pa.array(value, pa.int32()), "label": pa.array((row * n_cols + col)[root], pa.int64()),
        })

    return label


def _touching(labelled: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b) of block labels that meet across a block border. Only border pixels are shuffled."""
    side = lambda where, way, dr, dc, name: labelled.where(where).select(
        F.lit(way).alias("way"), (F.col("row_idx") + dr).alias("r"), (F.col("col_idx") + dc).alias("c"), "value",
        *[(F.col("label") if n == name else F.lit(None).cast("bigint")).alias(n) for n in ("a", "b")])
    sides = [
        side(f"row_idx % {block} = {block - 1}", 0, 1, 0, "a"), side(f"row_idx % {block} = 0", 0, 0, 0, "b"),
        side(f"col_idx % {block} = {block - 1}", 1, 0, 1, "a"), side(f"col_idx % {block} = 0", 1, 0, 0, "b"),
    ]
    met = reduce(DataFrame.unionByName, sides).groupBy("way", "r", "c", "value").agg(
        F.max("a").alias("a"), F.max("b").alias("b"))
    return met.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()


def connect(pairs: DataFrame, hot_rows: int = HOT_ROWS, small: int = SMALL_GRAPH) -> DataFrame:
    """Connected components of an undirected graph: (label, component), component the smallest label.

    Randomised contraction (Boegeholz, Brand and Todor 2020): in each round every vertex moves to
    the one with the smallest hash among itself and its neighbours, and edges inside a merged vertex
    vanish. The graph shrinks by a constant factor per round in expectation, whatever its diameter;
    once it has at most ``small`` pairs, one task finishes it. Labels without any pair do not appear
    in the result.
    """
    edges = materialize(pairs.select("a", "b").where("a <> b").distinct())
    moves = []
    while (n_edges := edges.count()) > small:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.xxhash64(F.col(c), F.lit(len(moves)))
        nearest = both.groupBy("a").agg(
            F.min_by("b", rank("b")).alias("_n"), F.min(rank("b")).alias("_h"))
        step = materialize(nearest.select(
            F.col("a").alias("v"), F.when(F.col("_h") < rank("a"), F.col("_n")).otherwise(F.col("a")).alias("to")))
        moves.append(step)
        start = lookup(edges, "a", step.withColumnsRenamed({"v": "a", "to": "ta"}), n_edges, hot_rows)
        ends = lookup(start, "b", step.withColumnsRenamed({"v": "b", "to": "tb"}), n_edges, hot_rows)
        edges = materialize(
            ends.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    rest = edges.withColumn("graph", F.expr("a - a")).groupBy("graph").applyInArrow(_merge_pairs, "label BIGINT, component BIGINT")
    if not moves:
        return rest
    moves.append(materialize(rest.withColumnsRenamed({"label": "v", "component": "to"})))
    n_labels = moves[0].count()
    place = moves[0].select(F.col("v").alias("label"), F.col("to").alias("at"))
    for step in moves[1:]:
        # Written in each round: a plan that used its input twice per round would double.
        place = materialize(lookup(place, "at", step.withColumnsRenamed({"v": "at", "to": "next"}), n_labels, hot_rows).select(
            "label", F.coalesce("next", "at").alias("at")))
    smallest = place.groupBy("at").agg(F.min("label").alias("component"))
    return lookup(place, "at", smallest, n_labels, hot_rows).select("label", "component")


def _labelled(pixels: DataFrame, n_cols: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Block-local labels of all pixels, and the components of those that cross block borders."""
    valued = pixels.where("value IS NOT NULL").select("row_idx", "col_idx", F.col("value").cast("int").alias("value"))
    labelled = materialize(
        add_block(valued, block).groupBy("br", "bc").applyInArrow(_label_block(n_cols), LABELLED))
    return labelled, connect(_touching(labelled, block))


def components(pixels: DataFrame, n_cols: int, block: int = BLOCK) -> DataFrame:
    """Add ``component_id`` to pixels (row_idx, col_idx, value).

    The id is the smallest ``row * n_cols + col`` of the region. Filter the background away first
    if it is not wanted; a region never depends on pixels of another value. A label is bounded by
    its block, so the join on it cannot be skewed.
    """
    labelled, crossing = _labelled(pixels, n_cols, block)
    return labelled.join(crossing, "label", "left").select(
        "row_idx", "col_idx", "value", F.coalesce("component", "label").alias("component_id"))


def component_summary(pixels: DataFrame, n_cols: int, block: int = BLOCK) -> DataFrame:
    """Value, pixel count and bounding box per region.

    Pixels are reduced to one row per block label before the crossing labels are looked up.
    """
    labelled, crossing = _labelled(pixels, n_cols, block)
    per_label = labelled.groupBy("label", "value").agg(
        F.count("*").alias("n"), F.min("row_idx").alias("r0"), F.max("row_idx").alias("r1"),
        F.min("col_idx").alias("c0"), F.max("col_idx").alias("c1"))
    named = per_label.join(crossing, "label", "left").withColumn("component_id", F.coalesce("component", "label"))
    return named.groupBy("component_id").agg(
        F.max("value").alias("value"), F.sum("n").alias("pixel_count"),
        F.min("r0").alias("min_row"), F.max("r1").alias("max_row"),
        F.min("c0").alias("min_col"), F.max("c1").alias("max_col"))


def component_edges(labelled: DataFrame, block: int = BLOCK) -> DataFrame:
    """Outline of each region as directed unit edges in pixel coordinates, the region on the right.

    ``side`` is 0 top (left to right), 1 right (down), 2 bottom (right to left), 3 left (up).
    """
    row, col = Line("col_idx"), Line("row_idx")
    seen = with_halo(labelled.select("row_idx", "col_idx", "component_id"), block)
    seen = seen.withColumns({"_w": row.adjacent("component_id", -1), "_e": row.adjacent("component_id", 1)})
    seen = seen.withColumns({"_n": col.adjacent("component_id", -1), "_s": col.adjacent("component_id", 1)})
    r, c = F.col("row_idx"), F.col("col_idx")
    corners = {0: (c, r, c + 1, r), 1: (c + 1, r, c + 1, r + 1), 2: (c + 1, r + 1, c, r + 1), 3: (c, r + 1, c, r)}
    edge = lambda side, beyond: F.when(
        ~F.col(beyond).eqNullSafe(F.col("component_id")),
        F.struct(F.lit(side).alias("side"), *[p.alias(n) for p, n in zip(corners[side], ("x1", "y1", "x2", "y2"))]))
    sides = F.explode(F.array(edge(0, "_n"), edge(1, "_e"), edge(2, "_s"), edge(3, "_w")))
    return (
        seen.where("core").select("component_id", "row_idx", "col_idx", sides.alias("e"))
        .where("e IS NOT NULL").select("component_id", "row_idx", "col_idx", "e.*")
    )


def _rank_edges(table: pa.Table) -> pa.Table:
    """Rank the edges of whole rings: (id, ring_id, seq), from edges and their successors."""
    ids, following = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("id", "next"))
    order = np.argsort(ids)
    ids, after = ids[order], np.searchsorted(ids[order], following[order])
    low, at = np.minimum(np.arange(len(ids)), after), after
    while not np.array_equal(low, low[at]):
        low, at = np.minimum(low, low[at]), at[at]
    left, at = np.ones(len(ids), np.int64), after.copy()
    while (way := np.nonzero(at != low)[0]).size:
        left[way], at[way] = left[way] + left[at[way]], at[at[way]]
    n = left[low]
    return pa.table({
        "id": pa.array(ids, pa.int64()), "ring_id": pa.array(ids[low], pa.int64()), "seq": pa.array((n - left) % n, pa.int64())})


def _rank_by_doubling(linked: DataFrame) -> DataFrame:
    """The same for rings of any length, by pointer doubling: each round is one join on unique keys."""
    # Smallest id on the ring: after k rounds the minimum over 2^k edges.
    jump = linked.select("id", "next", F.least("id", "next").alias("low"))
    while True:
        ahead = jump.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"))
        joined = materialize(jump.join(ahead, "next"))
        settled = joined.where("low <> low2").limit(1).count() == 0
        jump = joined.select("id", F.col("next2").alias("next"), F.least("low", "low2").alias("low"))
        if settled:
            break
    # Steps left to the first edge, which absorbs. Only edges still on their way are joined, so the
    # keys stay unique.
    first = F.col("next") == F.col("low")
    way = materialize(linked.select("id", "next").join(jump.select("id", "low"), "id").select(
        "id", "low", "next", F.lit(1).cast("bigint").alias("left")))
    while way.where(~first).limit(1).count() > 0:
        ahead = way.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("left").alias("left2"))
        moved = way.where(~first).join(ahead, "next").select(
            "id", "low", F.col("next2").alias("next"), (F.col("left") + F.col("left2")).alias("left"))
        way = materialize(moved.unionByName(way.where(first)))
    length = way.where("id = low").select("low", F.col("left").alias("n"))
    return lookup(way, "low", length, way.count()).select(
        "id", F.col("low").alias("ring_id"), F.expr("(n - left) % n").alias("seq"))


def component_rings(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Chain unit edges into closed rings: (component_id, ring_id, seq, x, y), corners only.

    ``ring_id`` numbers the ring's first edge, the one with the smallest (row, col, side) rank, and
    ``seq`` counts edges from there. Where a region meets itself at a corner, the ring crosses over
    to the other pixel, which parts the outer ring from the hole enclosed there.

    Regions of at most ``task_edges`` edges are spread over tasks of about that size, each ranking
    whole rings; the edges of a larger region are ranked by joins over the cluster.
    """
    # An id that grows in reading order: pixel rows and columns stay below 2^30.
    key = F.expr("row_idx * 4294967296 + col_idx * 4 + side")
    named = edges.select("component_id", key.alias("id"), "side", "x1", "y1", "x2", "y2")
    crowd = lambda x, y: F.count("*").over(Window.partitionBy("component_id", x, y)) > 1
    outs = named.select(
        "component_id", F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("id").alias("next"),
        F.when(crowd("x1", "y1"), F.col("side")).otherwise(-1).alias("turn"), F.col("side").alias("next_side"))
    ins = named.select(
        "component_id", F.col("x2").alias("x"), F.col("y2").alias("y"), "id", "x1", "y1", "side",
        F.when(crowd("x2", "y2"), (F.col("side") + 3) % 4).otherwise(-1).alias("turn"))
    # Every row: an edge, its successor, and where it starts.
    linked = materialize(ins.join(outs, ["component_id", "x", "y", "turn"]).select(
        "component_id", "id", "next", "side", "next_side", F.col("x1").alias("x"), F.col("y1").alias("y")))

    counts = linked.groupBy("component_id").count()
    total, largest = counts.agg(F.sum("count"), F.max("count")).first()
    total = total or 0
    small, large = linked, None
    if (largest or 0) > task_edges:
        big = counts.where(F.col("count") > task_edges).select("component_id", F.lit(True).alias("big"))
        sized = materialize(lookup(linked, "component_id", big, total))
        small, large = sized.where("big IS NULL"), sized.where("big")
    bucket = F.expr(f"pmod(xxhash64(component_id), {-(-total // task_edges) or 1})").alias("bucket")
    ranked = small.select("id", "next", bucket).groupBy("bucket").applyInArrow(
        _rank_edges, "id BIGINT, ring_id BIGINT, seq BIGINT")
    if large is not None:
        ranked = ranked.unionByName(_rank_by_doubling(large))
    # A corner is an edge whose predecessor runs another way; the predecessor knows its successor.
    turns = linked.where("side <> next_side").select(F.col("next").alias("id"))
    return linked.select("component_id", "id", "x", "y").join(turns, "id", "left_semi").join(ranked, "id").select(
        "component_id", "ring_id", "seq", "x", "y")


def component_areas(edges: DataFrame) -> DataFrame:
    """(component_id, area, perimeter) in pixels, from the unit edges in any order.

    Edges run with the region on the right, so the shoelace sum adds the outer ring and takes the
    holes away; its terms combine before the shuffle, whatever a region's share of the edges.
    """
    return edges.groupBy("component_id").agg(
        F.expr("cast(sum(cast(x1 * y2 - x2 * y1 as decimal(38,0))) / 2 as bigint)").alias("area"), F.count("*").alias("perimeter"))


def component_polygons(rings: DataFrame, geo: Georef, page: int = 10_000) -> DataFrame:
    """Regions as polygon text in map coordinates, in parts: (component_id, part, text).

    The texts of a region, joined in the order of ``part``, are one POLYGON with the outer ring first
    and its holes behind it, every ring closed. A part holds the corners of ``page`` unit edges at most, so no row grows
    with the region; a region of up to ``page`` edges and without a hole is one row.
    """
    point = F.concat_ws(" ", number_text(F.lit(geo.x_min) + F.col("x") * geo.px_x),
                        number_text(F.lit(geo.y_max) - F.col("y") * geo.px_y))
    pieces = rings.groupBy("component_id", "ring_id", F.expr(f"seq div {page}").alias("stretch")).agg(
        F.sort_array(F.collect_list(F.struct("seq", point.alias("t"))))["t"].alias("points"))
    # Reading order makes the first edge of a region part of its outer ring, which has the least id.
    region = Window.partitionBy("component_id").orderBy("ring_id", "stretch")
    of_ring = Window.partitionBy("component_id", "ring_id").orderBy("stretch")
    placed = pieces.withColumns({
        "part": (F.row_number().over(region) - 1).cast("bigint"), "ends": F.lead("ring_id").over(region).isNull(),
        "closes": F.lead("stretch").over(of_ring).isNull(), "opens": F.lag("stretch").over(of_ring).isNull(),
        "start": F.first(F.element_at("points", 1)).over(of_ring.rowsBetween(Window.unboundedPreceding, 0))})
    text = F.concat(
        F.when(F.col("part") == 0, "POLYGON (").otherwise(", "), F.when(F.col("opens"), "(").otherwise(""), F.array_join("points", ", "),
        F.when(F.col("closes"), F.concat(F.lit(", "), "start", F.lit(")"))).otherwise(""), F.when(F.col("ends"), ")").otherwise(""))
    return placed.select("component_id", "part", text.alias("text"))


def component_wkt(rings: DataFrame, geo: Georef, page: int = 10_000) -> DataFrame:
    """Outlines as text in map coordinates: (component_id, ring_id, part, hole, wkt).

    Every region has the same form, whatever its size: each ring is a LINESTRING for each stretch of
    ``page`` unit edges, numbered by ``part``, that begins where the part before ended; the last one
    ends where the first began. So no row grows with the region, and joining the parts of a ring
    gives the same closed ring for every ``page``. The outer ring comes first by ``ring_id``; the
    others are holes.
    """
    point = F.concat_ws(" ", number_text(F.lit(geo.x_min) + F.col("x") * geo.px_x),
                        number_text(F.lit(geo.y_max) - F.col("y") * geo.px_y))
    stretch = F.expr(f"seq div {page}").alias("stretch")
    pieces = rings.groupBy("component_id", "ring_id", stretch).agg(
        F.sort_array(F.collect_list(F.struct("seq", point.alias("t"))))["t"].alias("points"))
    ring = Window.partitionBy("component_id", "ring_id").orderBy("stretch")
    start = F.element_at("points", 1)
    closed = pieces.withColumns({
        "part": (F.row_number().over(ring) - 1).cast("bigint"),
        "end": F.coalesce(F.lead(start).over(ring), F.first(start).over(ring.rowsBetween(Window.unboundedPreceding, 0)))})
    # Reading order makes the first edge of a region part of its outer ring.
    outer = rings.groupBy("component_id").agg(F.min("ring_id").alias("outer"))
    text = F.concat(F.lit("LINESTRING ("), F.array_join(F.concat("points", F.array("end")), ", "), F.lit(")"))
    return closed.join(outer, "component_id").select(
        "component_id", "ring_id", "part", (F.col("ring_id") != F.col("outer")).alias("hole"), text.alias("wkt"))

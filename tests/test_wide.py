"""Distances on rasters many blocks wide: envelopes merged in a tree."""

import random

import numpy as np
import pyarrow as pa
import pytest

from zonalis.operators import proximity as P
from zonalis.schemas import Georef


def test_envelope_is_the_least_parabola_everywhere():
    rng = random.Random(1)
    for _ in range(300):
        cols = sorted(rng.sample(range(-20, 40), rng.randint(1, 12)))
        sites = [(c, rng.choice([0, 1, 9, 25, 400])) for c in cols]
        low = rng.randint(-20, 40)
        high = low + rng.randint(0, 40)
        got = P.envelope(sites, low, high)
        assert [x for _, _, a, b in got for x in range(a, b + 1)] == list(range(low, high + 1))
        for c, g, a, b in got:
            for x in range(a, b + 1):
                assert (c, g) == min(sites, key=lambda s: ((x - s[0]) ** 2 + s[1], s[0]))
        assert P.envelope(sites, 5, 4) == []


@pytest.mark.parametrize("fan", [2, 3, 64])
@pytest.mark.parametrize("share", [0.0004, 0.01, 0.3])
def test_wide_rasters(spark, fan, share):
    rng = np.random.default_rng(4)
    h, w, block = 11, 230, 4
    mask = rng.random((h, w)) < share
    mask[:, 60:180] = False
    mask[3, 7] = True
    px = spark.createDataFrame([(r, c, int(mask[r, c])) for r in range(h) for c in range(w) if (r + c) % 17], "row_idx BIGINT, col_idx BIGINT, mask INT")
    got = P.proximity(px, Georef(0, 0, 1, 1, h, w), block=block, fan=fan).collect()
    rows, cols = np.nonzero(mask & ((np.add.outer(np.arange(h), np.arange(w)) % 17) != 0))
    assert len(got) == sum((r + c) % 17 != 0 for r in range(h) for c in range(w))
    for r in got:
        assert r.distance == pytest.approx(np.sqrt(((rows - r.row_idx) ** 2 + (cols - r.col_idx) ** 2).min()))


def test_a_block_is_sent_only_what_meets_it():
    """Rows on their way to blocks are at most the survivors and the blocks of each row, for either side."""
    rng = np.random.default_rng(2)
    block, n_blocks, fan = 4, 64, 4
    sites = [(0, int(c), int(g)) for c, g in zip(np.sort(rng.choice(256, 60, replace=False)), rng.integers(0, 2000, 60))]
    parts = [(True, 0, c // block, r, way, c, g) for r, c, g in sites for way in (1, -1)]
    table, level, units = P._parabola_table(*zip(*parts)), 0, n_blocks
    while units > 1:
        width = fan ** (level + 1)
        parent = [(u if up else u // fan ** level) // fan for u, up in zip(table["unit"].to_pylist(), table["up"].to_pylist())]
        groups = [table.filter(pa.array([p == q for p in parent])) for q in sorted(set(parent))]
        table = pa.concat_tables([P._merge_units(block, n_blocks, fan, level)(g) for g in groups])
        level, units = level + 1, -(-n_blocks // width)
    sent = table.filter(pa.array([not u for u in table["up"].to_pylist()]))
    for way in (1, -1):
        mine = [t == way for t in sent["toward"].to_pylist()]
        assert 0 < sum(mine) <= level * (len(sites) + n_blocks)
    for x in range(256):
        there = [(c, g) for u, c, g in zip(*(sent[n].to_pylist() for n in ("unit", "col_idx", "g2"))) if u == x // block]
        outside = [(c, g) for _, c, g in sites if c // block != x // block]
        best = lambda some: min(((x - c) ** 2 + g for c, g in some), default=None)
        assert best(there) == best(outside)

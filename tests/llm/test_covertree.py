"""Cover trees: their invariants, and links against a comparison of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlens.llm import covertree
from matchlens.llm.common import ready


def clusters(n, groups, spread, dim=16, seed=5):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, dim))
    return centres[draw.integers(groups, size=n)] + spread * draw.normal(size=(n, dim))


SHAPES = [(600, 600, 0.0), (1000, 400, 0.05), (1000, 3, 0.02), (800, 1, 0.2), (300, 2, 0.0), (1, 1, 0.1)]


@pytest.mark.parametrize("n, groups, spread", SHAPES)
def test_levels_cover_and_nest(n, groups, spread):
    points = covertree.unit(clusters(n, groups, spread))
    order, nodes = covertree.grow(points)
    assert sorted(order.tolist()) == list(range(n))
    for centre, radius, start, stop, first, kids in nodes.tolist():
        members = order[int(start) : int(stop)]
        assert covertree.chords(points[members], points[int(centre)][None]).max() <= radius + covertree.ROUNDING
        below = nodes[int(first) : int(first + kids)]
        if kids:
            assert below[0, 2] == start and below[-1, 3] == stop and (below[1:, 2] == below[:-1, 3]).all()
            assert (below[:, 1] <= radius / 2 + covertree.ROUNDING).all()
        else:
            assert len(members) <= covertree.LEAF or radius <= covertree.POINT


@pytest.mark.parametrize("n, groups, spread", SHAPES)
def test_traversal_finds_every_pair(n, groups, spread):
    raw = clusters(n, groups, spread)
    points, cut = covertree.unit(raw), n // 3
    near = points @ points.T >= 0.98
    tree = covertree.grow(points)
    x, y = covertree.linked(points, tree, points, tree, 0.98, True)
    ok = covertree.exact(raw[x], raw[y], 0.98)
    got = [tuple(sorted(p)) for p in zip(x[ok].tolist(), y[ok].tolist())]
    assert sorted(got) == [(i, j) for i, j in zip(*np.nonzero(near)) if i < j]
    if cut:
        a, b = points[:cut], points[cut:]
        x, y = covertree.linked(a, covertree.grow(a), b, covertree.grow(b), 0.98, False)
        ok = covertree.exact(raw[:cut][x], raw[cut:][y], 0.98)
        assert sorted(zip(x[ok].tolist(), y[ok].tolist())) == list(zip(*np.nonzero(near[:cut, cut:])))


def test_scattered_vectors_are_split():
    """Each tight cluster that has members is a node of its own below the root."""
    occupied = len(np.unique(clusters(1024, 400, 0.0, dim=64), axis=0))
    _, nodes = covertree.grow(covertree.unit(clusters(1024, 400, 0.01, dim=64)))
    assert 300 < occupied <= nodes[0, 5]


def test_links_and_components_of_whole_tables(spark):
    """Counts, components and representatives against all pairs, over several chunks."""
    ready(spark)
    raw = clusters(500, 60, 0.04)
    df = spark.createDataFrame([(i, v.tolist(), str(i % 2)) for i, v in enumerate(raw)], "vec_id long, embedding array<double>, label string")
    points = covertree.unit(raw)
    near = (points @ points.T >= 0.98) & (np.arange(500)[:, None] % 2 == np.arange(500) % 2)
    root = list(range(500))
    for _ in range(500):
        new = [min(root[j] for j in np.nonzero(near[i])[0]) for i in range(500)]
        if new == root:
            break
        root = new
    got = covertree.near_duplicates(df, chunk=100).orderBy(F.col("vec_id")).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in got] == [
        (int(near[i].sum()) - 1, root[i], root[i] == i) for i in range(500)
    ]
    assert near.sum() > 600

"""Exact near-duplicate vectors by dual traversal of cover trees.

Unit vectors are compared by chord length, a metric: a cosine of at least ``t``
is a chord of at most ``sqrt(2 - 2t)``. Vectors that may link share a label and
a dimension; together they form a space. Equal vectors are one node with a
count. Each space is dealt to cells around pivots, taken from a bounded sample;
cells are cut into chunks of bounded size. In each chunk a cover tree is grown:
nested levels of centres whose radii halve, every vector within the radius of
its centre; it is written with the chunk. Two nodes whose centres lie further apart than both radii and the
chord cannot hold a link, and are dropped with all below them: first pairs of
chunks, joined by space, then pairs of nodes inside two chunks. What is left is
compared in blocks of doubles.

A pair of chunks gives a count of links for each vector and a spanning forest,
not its pairs, so groups of near copies add rows in proportion to their size.

Vectors that are null, empty, zero or hold a null or non-finite component link
with nothing, nor do vectors without a label or of different lengths. Without an
id, a row takes part; a component without any id has a null id, and null ids are
never kept. Repeated rows count as links of each other. Extra columns stay;
those named like a result give way.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlens.llm.common import added, written
from matchlens.llm.graph import components

COSINE = 0.98
CHUNK = 1024
LEAF = 64
# Pivots: at most so many in all and for each space, and so many bytes.
PIVOTS, SPACE_PIVOTS, PIVOT_BYTES = 4096, 64, 16 << 20
SLACK = 1e-9
# Chords near zero are only known to about 1e-8: room for that in every bound, and the radius of a point.
ROUNDING, POINT = 1e-7, 1e-6


def unit(matrix):
    import numpy as np

    return matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))


def grow(points, leaf: int = LEAF):
    """A cover tree over unit vectors: ``(order, nodes)``, root first.

    Each level covers a node's members by centres at half its radius, chosen
    one after another among the members not yet covered; the levels go on until
    a node has few members or no extent. A node is a row ``centre, radius,
    start, stop, first child, children``; its members are ``order[start:stop]``
    and its children stand one after another.
    """
    import numpy as np

    order = np.arange(len(points))
    nodes = [[0, float(chords(points, points[:1]).max()), 0, len(points), 0, 0]]
    at = 0
    while at < len(nodes):
        _, radius, start, stop, _, _ = nodes[at]
        if stop - start > leaf and radius > POINT:
            rest, place = order[start:stop].copy(), start
            nodes[at][4] = len(nodes)
            while len(rest):
                d = chords(points[rest], points[rest[:1]])[:, 0]
                near = d <= radius / 2
                near[0] = True
                some = rest[near]
                nodes.append([int(rest[0]), float(d[near].max()), place, place + len(some), 0, 0])
                order[place : place + len(some)] = some
                place, rest = place + len(some), rest[~near]
            nodes[at][5] = len(nodes) - nodes[at][4]
        at += 1
    return order, np.array(nodes)


def chords(a, b):
    import numpy as np

    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def linked(a, tree_a, b, tree_b, cosine: float, same: bool):
    """Index pairs of linked vectors of two chunks; with ``same``, each unordered pair once.

    The children of two nodes are held against each other at once, and only the
    pairs whose balls come near enough are followed.
    """
    import numpy as np

    reach, left, right = math.sqrt(2 - 2 * cosine) + ROUNDING, [], []
    (order_a, nodes_a), (order_b, nodes_b) = tree_a, tree_b

    def below(nodes, i, open_):
        """The children of a node that is opened, else the node itself."""
        return np.arange(int(nodes[i, 4]), int(nodes[i, 4] + nodes[i, 5])) if open_ else np.array([i])

    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        kids_a, kids_b = nodes_a[i, 5] > 0, nodes_b[j, 5] > 0
        if kids_a or kids_b:
            # Nodes of like size are opened together, else the larger one alone.
            wide_a, wide_b = nodes_a[i, 1], nodes_b[j, 1]
            x = below(nodes_a, i, kids_a and (wide_a * 2 >= wide_b or not kids_b))
            y = below(nodes_b, j, kids_b and (wide_b * 2 >= wide_a or not kids_a))
            apart = chords(a[nodes_a[x, 0].astype(int)], b[nodes_b[y, 0].astype(int)])
            near = apart <= nodes_a[x, 1][:, None] + nodes_b[y, 1] + reach
            if same and i == j:
                near = np.triu(near)
            k, m = np.nonzero(near)
            k, m = x[k], y[m]
            # Balls of a single vector are pairs already.
            single = (nodes_a[k, 3] - nodes_a[k, 2] == 1) & (nodes_b[m, 3] - nodes_b[m, 2] == 1)
            p = order_a[nodes_a[k[single], 2].astype(int)]
            q = order_b[nodes_b[m[single], 2].astype(int)]
            other = p != q if same else slice(None)
            left.append(p[other])
            right.append(q[other])
            todo += zip(k[~single].tolist(), m[~single].tolist())
            continue
        ma = order_a[int(nodes_a[i, 2]) : int(nodes_a[i, 3])]
        mb = order_b[int(nodes_b[j, 2]) : int(nodes_b[j, 3])]
        near = a[ma] @ b[mb].T >= cosine - SLACK
        if same and i == j:
            near &= np.tri(len(ma), k=-1, dtype=bool).T
        x, y = np.nonzero(near)
        left.append(ma[x])
        right.append(mb[y])
    if not left:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(left), np.concatenate(right)


def exact(raw_a, raw_b, cosine: float):
    """Which rows of two equally long lists of vectors reach the cosine, in doubles."""
    import numpy as np

    dot = (raw_a * raw_b).sum(1)
    return dot / np.sqrt((raw_a * raw_a).sum(1) * (raw_b * raw_b).sum(1)) >= cosine


def _forest(left, right, n: int):
    """A few of the pairs that keep all ``n`` nodes as connected as before."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(left.tolist(), right.tolist()):
        a, b = find(x), find(y)
        if a != b:
            root[a] = b
            out.append((x, y))
    return out


def _matrix(packed: bytes, dim: int):
    import numpy as np

    return np.frombuffer(packed, dtype="<f8").reshape(-1, dim)


def _tree(order: bytes, nodes: bytes):
    import numpy as np

    return np.frombuffer(order, dtype="<i4"), np.frombuffer(nodes, dtype="<f8").reshape(-1, 6)


def _pair_links(cosine: float):
    """Links between the two chunks of each row."""

    def links(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for r in frame.itertuples(index=False):
                same = r.chunk_a == r.chunk_b
                raw_a, raw_b = _matrix(r.vectors_a, r.dim), _matrix(r.vectors_b, r.dim)
                a, b = unit(raw_a), unit(raw_b)
                trees = [_tree(r.order_a, r.nodes_a), _tree(r.order_b, r.nodes_b)]
                x, y = linked(a, trees[0], b, trees[1], cosine, same)
                ok = exact(raw_a[x], raw_b[y], cosine)
                x, y = x[ok], y[ok]
                if not len(x):
                    continue
                ids_a, ids_b = np.asarray(r.ids_a), np.asarray(r.ids_b)
                n_a = np.bincount(x, weights=np.asarray(r.counts_b)[y], minlength=len(ids_a))
                n_b = np.bincount(y, weights=np.asarray(r.counts_a)[x], minlength=len(ids_b))
                pairs = _forest(x, y if same else y + len(ids_a), len(ids_a) + len(ids_b))
                ids = np.concatenate([ids_a, ids_b])
                counts = [(i, None, int(n)) for i, n in zip(ids_a, n_a) if n]
                counts += [(i, None, int(n)) for i, n in zip(ids_b, n_b) if n]
                edges = [(ids[p], ids[q], None) for p, q in pairs]
                yield pd.DataFrame(counts + edges, columns=["a", "b", "n"]).astype("Int64")

    return links


def _packed(frame):
    """One row for a chunk: its vectors, a ball around them, and their tree."""
    import numpy as np
    import pandas as pd

    raw = np.stack(frame["vector"].to_numpy()).astype("<f8")
    points = unit(raw)
    centre = points.mean(0)
    length = np.sqrt((centre * centre).sum())
    centre = centre / length if length > 0 else points[0]
    radius = float(chords(points, centre[None]).max())
    order, tree = grow(points)
    head = frame.iloc[0]
    return pd.DataFrame(
        [(head["space"], head["chunk"], raw.shape[1], centre.tolist(), radius, raw.tobytes(),
          frame["node"].tolist(), frame["copies"].tolist(), order.astype("<i4").tobytes(), tree.astype("<f8").tobytes())],
        columns=["space", "chunk", "dim", "centre", "radius", "vectors", "ids", "counts", "order", "nodes"],
    )


def nodes(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """Distinct usable vectors: ``node, space, vector, copies, head``, written."""
    wide = F.col(embedding).cast("array<double>")
    rows = vectors.select(
        F.col(vec_id).alias("id"), F.col(label).cast("string").alias("label"), wide.alias("vector")
    ).filter(usable(F.col("vector")) & F.col("label").isNotNull())
    found = (
        rows.groupBy("label", "vector")
        .agg(F.count("*").alias("copies"), F.min("id").alias("head"))
        .withColumn("space", F.concat_ws("/", F.size("vector"), "label"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    return written(found, "nodes")


def usable(vector):
    """Not null or empty, all components finite, and not all of them zero."""
    finite = lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x)
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def _cells(found: DataFrame, chunk: int) -> DataFrame:
    """``found`` with ``chunk``: the nearest pivot of its space, cut to bounded size by hash."""
    import numpy as np

    sizes = found.groupBy("space").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"))
    largest = sizes.agg(F.max("dim")).first()[0] or 1
    limit = min(PIVOTS, PIVOT_BYTES // (8 * largest))
    order = F.xxhash64("vector", "space")
    wanted = F.least(F.lit(SPACE_PIVOTS), F.ceil(F.col("n") / chunk))
    sample = (
        found.join(sizes.select("space", "n"), "space")
        # By hash about 288 rows of each space, whatever its size, of which the first are taken.
        .filter(F.pmod(order, F.lit(1 << 20)) <= F.lit(1 << 20) * 4 * (SPACE_PIVOTS + 8) / F.col("n"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("space").orderBy(order)))
        .filter(F.col("rank") <= wanted)
        .orderBy("rank", "space")
        .limit(limit)
        .select("space", "vector")
        .toPandas()
    )
    pivots = {
        space: unit(np.stack(some["vector"].to_numpy())) for space, some in sample.groupby("space")
    }
    shared = found.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("int")
    def nearest(spaces, vectors):
        import pandas as pd

        out = np.zeros(len(spaces), dtype=np.int32)
        for space, places in pd.Series(range(len(spaces))).groupby(spaces.to_numpy()):
            near = shared.value.get(space)
            if near is not None:
                at = places.to_numpy()
                out[at] = np.argmax(unit(np.stack(vectors.to_numpy()[at])) @ near.T, axis=1)
        return pd.Series(out)

    rows = written(found.withColumn("cell", nearest("space", "vector")), "cells")
    parts = rows.groupBy("space", "cell").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    return rows.join(parts, ["space", "cell"]).withColumn("chunk", F.concat_ws("/", "space", "cell", part))


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    chunk: int = CHUNK,
) -> DataFrame:
    """``vectors`` with ``n_links``, ``component_id`` (smallest id reachable) and ``kept``."""
    found = nodes(vectors, vec_id, embedding, label)
    chunks = written(
        _cells(found, chunk)
        .groupBy("space", "chunk")
        .applyInPandas(
            _packed,
            "space string, chunk string, dim int, centre array<double>, radius double, "
            "vectors binary, ids array<long>, counts array<long>, order binary, nodes binary",
        ),
        "chunks",
    )
    ball = chunks.select("space", "chunk", "centre", "radius")
    a, b = ball.alias("a"), ball.alias("b")
    dot = F.aggregate(F.zip_with("a.centre", "b.centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - 2 * dot))
    reach = math.sqrt(2 - 2 * cosine) + ROUNDING
    pairs = (
        a.join(b, F.col("a.space") == F.col("b.space"))
        .filter(F.col("a.chunk") <= F.col("b.chunk"))
        .filter(apart <= F.col("a.radius") + F.col("b.radius") + reach)
        .select(F.col("a.chunk").alias("chunk_a"), F.col("b.chunk").alias("chunk_b"))
    )
    first = chunks.select(
        F.col("chunk").alias("chunk_a"), "dim", F.col("vectors").alias("vectors_a"),
        F.col("ids").alias("ids_a"), F.col("counts").alias("counts_a"),
        F.col("order").alias("order_a"), F.col("nodes").alias("nodes_a"),
    )
    second = chunks.select(
        F.col("chunk").alias("chunk_b"), F.col("vectors").alias("vectors_b"),
        F.col("ids").alias("ids_b"), F.col("counts").alias("counts_b"),
        F.col("order").alias("order_b"), F.col("nodes").alias("nodes_b"),
    )
    tasks = pairs.join(first, "chunk_a").join(second, "chunk_b").repartition("chunk_a", "chunk_b")
    links = written(tasks.mapInPandas(_pair_links(cosine), "a long, b long, n long"), "links")
    counts = links.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    roots = components(links.filter("b IS NOT NULL").select("a", "b"))
    placed = (
        found.join(counts, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    heads = placed.groupBy("root").agg(F.min("head").alias("_component"))
    result = placed.join(heads, "root").select(
        F.col("label").alias("_label"),
        F.col("vector").alias("_vector"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("_linked"),
        "_component",
        F.lit(True).alias("_used"),
    )
    wide = added(
        vectors,
        {"_vector": F.col(embedding).cast("array<double>"), "_label": F.col(label).cast("string")},
    )
    joined = wide.join(result, ["_label", "_vector"], "left")
    component = F.when(F.col("_used"), F.col("_component")).otherwise(F.col(vec_id))
    return added(
        joined,
        {
            "n_links": F.coalesce("_linked", F.lit(0)).cast("long"),
            "component_id": component.cast("long"),
            "kept": F.coalesce(component == F.col(vec_id), F.lit(False)),
        },
    ).drop("_label", "_vector", "_linked", "_component", "_used")

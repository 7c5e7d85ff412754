"""Near-duplicate vectors by cover trees walked in pairs.

Equal vectors are one point. Points go to blocks of bounded size around pivots; two blocks whose covering balls
are further apart than the threshold never meet. A cover tree is built for each block, with radii that halve from
level to level. Every task takes two blocks (or one with itself) and walks both trees at once: a pair of nodes is dropped
when the distance of their centres less both covering radii exceeds the threshold, and taken whole when the
distance and both radii are within it. What is left comes down to points, which are compared exactly. A task
gives the number of links of each point and the local component, never the pairs.

On unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2 c).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.llm.graph import components
from tillview.session import stage

BLOCK = 4096  # points in a block, about
_SLACK = 1e-9  # for rounding: pruning is looser, taking whole is stricter by this much
_CENTRES = 256  # centres looked for at a time
_CELLS = 1 << 21  # distances worked on at a time


@dataclass
class Level:
    """Nodes of one level: centre (a point), covering radius, range of points, range of children one level down."""

    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray  # first child; one more entry than nodes


def build(x: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """The order of the unit vectors ``x`` in the tree and its levels, from one root to single points."""
    order = np.arange(len(x))
    low, high = np.array([0]), np.array([len(x)])
    levels: list[Level] = []
    reach = 2.0
    while True:
        centre = order[low]
        dist = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x[order], x[np.repeat(centre, high - low)])))
        radius = np.maximum.reduceat(dist, low)
        radius[high - low == 1] = 0
        levels.append(Level(centre, radius, low, high, np.empty(0, np.int64)))
        if len(low) == len(x):
            levels[-1].child = np.arange(len(x) + 1)
            return order, levels
        reach /= 2
        single = reach < 1e-3
        starts, count = [], np.zeros(len(low), np.int64)
        for i, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
            if single or b - a == 1:
                starts += range(a, b)
                count[i] = b - a
                continue
            for own in _net(x, order[a:b].copy(), 1 - reach * reach / 2):
                order[a : a + len(own)] = own
                starts.append(a)
                count[i] += 1
                a += len(own)
        levels[-1].child = np.append(0, np.cumsum(count))
        low = np.array(starts)
        high = np.append(low[1:], len(x))


def _net(x: np.ndarray, rest: np.ndarray, near: float) -> Iterator[np.ndarray]:
    """Points in groups around centres: each centre is the first point that no earlier one covers."""
    rows = x[rest]
    while len(rest):
        some = min(len(rest), _CENTRES)
        close = rows @ rows[:some].T >= near
        among, covered, chosen = np.ascontiguousarray(close[:some].T), np.zeros(some, bool), []
        for j in range(some):
            if not covered[j]:
                chosen.append(j)
                covered |= among[j]
        close = close[:, chosen]
        close[chosen, np.arange(len(chosen))] = True
        has, by = close.any(1), close.argmax(1)
        inside = np.flatnonzero(has)
        inside = inside[np.argsort(by[inside], kind="stable")]  # a centre comes before all it covers
        cut = np.cumsum(np.bincount(by[inside], minlength=len(chosen)))
        yield from np.split(rest[inside], cut[:-1])
        rest, rows = rest[~has], rows[~has]


class Links:
    """Links found so far: how many each point has, and which points hang together."""

    def __init__(self, weight: np.ndarray):
        self.weight = weight
        self.count = np.zeros(len(weight), np.int64)
        self.label = np.arange(len(weight))

    def pairs(self, p: np.ndarray, q: np.ndarray) -> None:
        """Pairs of different points."""
        self.count += np.bincount(p, self.weight[q], len(self.count)).astype(np.int64)
        self.count += np.bincount(q, self.weight[p], len(self.count)).astype(np.int64)
        self.join(p, q)

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        while True:
            a, b = self.label[p], self.label[q]
            if (a == b).all():
                return
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def _children(level: Level, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return level.child[nodes], level.child[nodes + 1] - level.child[nodes]


def walk(x: np.ndarray, first: tuple[np.ndarray, list[Level]], second: tuple[np.ndarray, list[Level]] | None, links: Links, least: float) -> None:
    """Find all links between two trees over rows of ``x``, or within the first when the second is None."""
    reach = np.sqrt(2 - 2 * least)
    same = second is None
    (order_p, tree_p), (order_q, tree_q) = first, first if same else second
    depth = max(len(tree_p), len(tree_q))
    at_p, at_q = ([t[min(i, len(t) - 1)] for i in range(depth)] for t in (tree_p, tree_q))
    last_p, last_q = len(tree_p) - 1, len(tree_q) - 1

    def test(i: int, p: np.ndarray, q: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node pairs of level i to follow, and those taken whole."""
        both = at_p[i].radius[p] + at_q[i].radius[q]
        far = np.minimum(2.0, both + reach + _SLACK)
        follow = cosine >= 1 - far * far / 2
        inner = reach - both - _SLACK
        whole = follow & (inner > 0) & (cosine >= 1 - inner * inner / 2) & (both > 0)
        return follow & ~whole, whole

    def take(i: int, p: np.ndarray, q: np.ndarray) -> None:
        a, b = at_p[i], at_q[i]
        for u, v in zip(p.tolist(), q.tolist()):
            mine, theirs = order_p[a.low[u] : a.high[u]], order_q[b.low[v] : b.high[v]]
            links.count[mine] += links.weight[theirs].sum()
            if same and u == v:
                links.count[mine] -= links.weight[mine]
            else:
                links.count[theirs] += links.weight[mine].sum()
            every = np.append(mine, theirs)
            links.join(every, np.full(len(every), every[0]))

    def compare(p: np.ndarray, q: np.ndarray) -> None:
        """Pairs of points, by place in the trees."""
        for at in range(0, len(p), _CELLS // 64):
            a, b = order_p[p[at : at + _CELLS // 64]], order_q[q[at : at + _CELLS // 64]]
            ok = np.einsum("ij,ij->i", x[a], x[b]) >= least
            if same:
                ok &= a != b
            if ok.any():
                links.pairs(a[ok], b[ok])

    def follow(i: int, p: np.ndarray, q: np.ndarray) -> None:
        """Node pairs of level i, none of them dropped or taken yet."""
        if not len(p):
            return
        if i == depth - 1:
            compare(p, q)
            return
        next_p, next_q = i < last_p, i < last_q
        cp, np_ = _children(at_p[i], p) if next_p else (p, np.ones(len(p), np.int64))
        cq, nq = _children(at_q[i], q) if next_q else (q, np.ones(len(q), np.int64))
        size = np_ * nq
        ends = np.cumsum(size)
        at = 0
        while at < len(p):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CELLS // 16, "right")))
            if end == at + 1 and size[at] > _CELLS // 16:
                dense(i + 1, p[at], q[at], cp[at], np_[at], cq[at], nq[at])
            else:
                s = slice(at, end)
                pair = np.repeat(np.arange(at, end), size[s])
                place = np.arange(size[s].sum()) - np.repeat(np.cumsum(size[s]) - size[s], size[s])
                a, b = cp[pair] + place // nq[pair], cq[pair] + place % nq[pair]
                if same:
                    keep = (p[pair] != q[pair]) | (a <= b)
                    a, b = a[keep], b[keep]
                for c in range(0, len(a), _CELLS // 64):
                    u, v = a[c : c + _CELLS // 64], b[c : c + _CELLS // 64]
                    cosine = np.einsum("ij,ij->i", x[at_p[i + 1].centre[u]], x[at_q[i + 1].centre[v]])
                    go, whole = test(i + 1, u, v, cosine)
                    take(i + 1, u[whole], v[whole])
                    follow(i + 1, u[go], v[go])
            at = end

    def dense(i: int, p: int, q: int, cp: int, n: int, cq: int, m: int) -> None:
        """All children of one wide pair, tile by tile, as matrix products."""
        tile = max(1, _CELLS // 8 // max(m, 1))
        right = x[at_q[i].centre[cq : cq + m]]
        for a in range(cp, cp + n, tile):
            b = min(a + tile, cp + n)
            cosine = x[at_p[i].centre[a:b]] @ right.T
            far = np.add.outer(at_p[i].radius[a:b], at_q[i].radius[cq : cq + m] + (reach + _SLACK))
            np.minimum(far, 2.0, out=far)
            far *= far
            far *= -0.5
            far += 1
            u, v = np.nonzero(cosine >= far)
            near = cosine[u, v]
            u, v = u + a, v + cq
            if same and p == q:
                keep = u <= v
                u, v, near = u[keep], v[keep], near[keep]
            go, whole = test(i, u, v, near)
            take(i, u[whole], v[whole])
            u, v = u[go], v[go]
            if len(u) > 0.1 * (b - a) * m and i < depth - 1:
                # Nearly nothing can be dropped here: go down a level for all of the tile at once.
                low_p, high_p = (at_p[i].child[a], at_p[i].child[b]) if i < last_p else (a, b)
                low_q, high_q = (at_q[i].child[cq], at_q[i].child[cq + m]) if i < last_q else (cq, cq + m)
                if not whole.any():
                    dense_rows(i + 1, low_p, high_p - low_p, low_q, high_q - low_q, same and p == q)
                    continue
            follow(i, u, v)

    def dense_rows(i: int, cp: int, n: int, cq: int, m: int, inside: bool) -> None:
        dense(i, 0, 0 if inside else 1, cp, n, cq, m)

    follow(0, np.array([0]), np.array([0]))


def _unit(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """Vectors of a column as rows of length one, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _planted(table: pa.Table) -> pa.Table:
    """A block's points with their place in its cover tree; the first has the tree, in places."""
    order, levels = build(_unit(table.column("embedding"), table.num_rows))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    for level in levels:
        level.centre = place[level.centre]
    tree = [pickle.dumps([(v.centre, v.radius, v.low, v.high, v.child) for v in levels])] + [None] * (len(order) - 1)
    out = table.take(pa.array(order)).select(["rep", "copies", "embedding", "block"])
    return out.append_column("place", pa.array(np.arange(len(order)))).append_column("tree", pa.array(tree, pa.binary()))


def _tree(table: pa.Table, at: int, n: int) -> tuple[np.ndarray, list[Level]]:
    """The tree of the block whose points are rows ``at`` to ``at + n``, which are in its order."""
    levels = [Level(c + at, r, low, high, child) for c, r, low, high, child in pickle.loads(table.column("tree")[at].as_py())]
    return np.arange(at, at + n), levels


def _links_of(least: float):
    names = ["rep", "links", "root"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("place", "ascending")])
        rep, side = table.column("rep").to_numpy(), table.column("block").to_numpy()
        x = _unit(table.column("embedding"), len(rep))
        cut = int(np.searchsorted(side, side[0], "right"))
        found = Links(table.column("copies").to_numpy())
        if table.column("first")[0].as_py() == table.column("second")[0].as_py():
            walk(x, _tree(table, 0, len(rep)), None, found, least)
        elif cut < len(rep):
            walk(x, _tree(table, 0, cut), _tree(table, cut, len(rep) - cut), found, least)
        some = np.flatnonzero(found.count > 0)
        low = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(low, found.label, rep)
        return pa.Table.from_arrays([pa.array(rep[some]), pa.array(found.count[some]), pa.array(low[found.label[some]])], names=names)

    return run


def _pivots(points: DataFrame, n: int) -> np.ndarray:
    """At most 64 unit vectors, spread out: farthest first among the 2048 points that come first by hash."""
    some = points.orderBy(F.xxhash64("rep"), "rep").limit(2048).select("embedding").toPandas()["embedding"]
    x = np.stack([np.asarray(v, np.float64) for v in some])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def _placed(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column("embedding"), batch.num_rows)
            near = x @ pivots.T
            at = near.argmax(1)
            dist = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(x)), at]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(dist)], names=[*batch.schema.names, "pivot", "distance"])

    return run


def _linked(points: DataFrame, least: float, block: int) -> DataFrame:
    """(rep, links, root) rows for points of one dimension; a point may have several, one for each pair of blocks."""
    n = points.count()
    pivots = _pivots(points, max(1, min(64, -(-n // block))))
    at = stage(points.mapInArrow(_placed(pivots), "rep long, copies long, embedding array<double>, pivot int, distance double"))
    sizes = {r.pivot: r.n for r in at.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    parts = {p: -(-m // block) for p, m in sizes.items()}
    first = dict(zip(sorted(parts), np.cumsum([0, *(parts[p] for p in sorted(parts))]).tolist()))
    spark = points.sparkSession
    where = spark.createDataFrame([(p, first[p], parts[p]) for p in parts], "pivot int, base int, parts int")
    at = at.join(F.broadcast(where), "pivot")  # a row for each of at most 64 pivots
    number = F.col("base") + F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    at = at.withColumn("block", number).drop("base", "parts")
    # Blocks that may hold a link, as a table: two balls are as far apart as their pivots, of which there are at most 64.
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    between = spark.createDataFrame([(i, j, float(apart[i, j])) for i in range(len(pivots)) for j in range(len(pivots))], "pivot int, other_pivot int, apart double")
    balls = stage(at.groupBy("block", "pivot").agg(F.max("distance").alias("radius")))
    others = balls.select(F.col("block").alias("other"), F.col("pivot").alias("other_pivot"), F.col("radius").alias("other_radius"))
    near = F.col("apart") - F.col("radius") - F.col("other_radius") <= float(np.sqrt(2 - 2 * least)) + 1e-6
    meet = balls.join(F.broadcast(between), "pivot").join(others, "other_pivot").where(near | (F.col("block") == F.col("other"))).select("block", "other")
    # Every block's tree is built once and goes with its points.
    planted = stage(at.select("rep", "copies", "embedding", "block").groupBy("block").applyInArrow(_planted, "rep long, copies long, embedding array<double>, block int, place long, tree binary"))
    rows = planted.join(meet, "block")
    rows = rows.select("rep", "copies", "embedding", "block", "place", "tree", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    return rows.groupBy("first", "second").applyInArrow(_links_of(least), "rep long, links long, root long")


def links(df: DataFrame, least: float = 0.95, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link when their cosine, in double precision, is at least ``least``. Vectors that are null, empty or
    zero or hold null or non-finite components link with nothing, and vectors of different length do not link with
    each other. Rows with the same id are different vectors of the same component (where they link at all). A row
    with a null id links with nothing and has a null component. An empty table gives an empty result; other columns are not looked at.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    rows = rows.withColumn("embedding", F.when(good, F.col("embedding")))
    points = rows.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    points = stage(points.withColumn("rep", F.monotonically_increasing_id()))  # written once, so the numbers stay
    dims = [r.d for r in points.select(F.size("embedding").alias("d")).distinct().collect()]
    found = None
    for d in sorted(dims):
        own = _linked(points.where(F.size("embedding") == d).select("rep", "copies", "embedding"), least, block)
        found = own if found is None else found.union(own)
    found = stage(df.sparkSession.createDataFrame([], "rep long, links long, root long") if found is None else found)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    at = stage(rows.join(points.select("embedding", "rep"), "embedding", "left").select("vec_id", "rep"))
    # An id with several vectors holds their components together.
    twice = at.where("rep IS NOT NULL").groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    twice = at.join(twice.select("vec_id", "a"), "vec_id").select("a", F.col("rep").alias("b"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(twice)).withColumnRenamed("node", "rep")
    known = points.select("rep", "least", "copies").join(groups, "rep", "left").join(counts, "rep", "left").withColumn("group", F.coalesce("component", "rep"))
    names = known.groupBy("group").agg(F.min("least").alias("component_id"))
    known = known.join(names, "group").select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id")
    out = at.join(known, "rep", "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
    WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
    r(a, c) AS (SELECT vec_id, vec_id FROM u UNION SELECT s.a, r.c FROM r JOIN s ON r.a = s.b),
    m AS (SELECT a, min(c) AS c FROM r GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM s GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, m.c AS component_id, vec_id = m.c AS kept FROM u JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id"""

"""Hard negatives by cover trees over norm-augmented vectors.

With M the greatest length of all vectors, each vector gets one more component, the square root of M^2 less its squared length, and is
divided by M. All are then of length one, and the inner product of a query (whose further component is zero) is M times its
length times a cosine. Rows are dealt into blocks of bounded size by hash, so that no label and no place is a hot one; every block gets a
cover tree. The covering radius of a node bounds the inner products of all its points from above and from below.

A query goes down a tree level by level and leaves out nodes that meet none of its windows of scores. The small nodes that are left are
opened best first, by their upper bounds, a few at a time; their points are compared exactly, and a window is done when no bound is left
that reaches its worst kept score. A first walk finds every anchor's best rows of its own label, a second one the rows of other
labels inside the windows that these set. Blocks meet groups of anchors in pairs; a pair gives the best few of each window, and those
of all blocks are merged by rank.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillview.llm.cover_tree import Level, build
from tillview.session import stage

BLOCK = 4096  # rows in a block, about
BLOCK_BYTES = 32 << 20  # of their vectors
GROUP = 2048  # anchors that meet a block at a time
_LEAF = 16  # points of a node that is opened
_SOME = 64  # anchors walked together
_SLACK = 1e-9  # of the greatest possible score, for rounding in bounds
_NEVER = -np.inf


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors of length one whose cosines with a query are its inner products with ``x``, but for a factor."""
    if not most:
        return np.append(np.zeros_like(x), np.ones((len(x), 1)), axis=1)
    x = x / most
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))
    out = np.append(x, rest[:, None], axis=1)
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


@dataclass
class Tree:
    """Rows of a block in the order of their cover tree."""

    rep: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    x: np.ndarray
    unit: np.ndarray
    levels: list[Level]
    most: float

    @staticmethod
    def of(rep: np.ndarray, ids: np.ndarray, label: np.ndarray, x: np.ndarray, most: float) -> Tree:
        unit = augmented(x, most)
        order, levels = build(unit)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for level in levels:
            level.centre = place[level.centre]
        return Tree(rep[order], ids[order], label[order], x[order], unit[order], levels, most)


@dataclass
class Queries:
    """Anchors and their windows: bounds on a hundred times the score, and what each window is for."""

    rep: np.ndarray
    label: np.ndarray
    x: np.ndarray
    owner: np.ndarray  # of each window, its anchor
    low: np.ndarray
    high: np.ndarray

    def part(self, a: int, b: int) -> tuple[Queries, np.ndarray]:
        w = np.flatnonzero((self.owner >= a) & (self.owner < b))
        return Queries(self.rep[a:b], self.label[a:b], self.x[a:b], self.owner[w] - a, self.low[w], self.high[w]), w


def _leaves(tree: Tree, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Small nodes that some window may need (first point, end), and bounds of scores by anchor; without need -inf and inf."""
    length = np.sqrt(np.einsum("ij,ij->i", q.x, q.x))
    unit = q.x / np.where(length > 0, length, 1)[:, None]
    scale = (length * tree.most)[:, None]
    slack = _SLACK * (scale + 1)
    low, high, upper, lower = [], [], [], []
    nodes, alive = np.array([0]), np.ones((len(q.x), 1), bool)
    for i, level in enumerate(tree.levels):
        cosine = np.clip(unit @ tree.unit[level.centre[nodes], :-1].T, -1, 1)
        reach = np.minimum(level.radius[nodes], 2.0)
        cos, sin = 1 - reach * reach / 2, reach * np.sqrt(np.maximum(0, 1 - reach * reach / 4))
        side = np.sqrt(1 - cosine * cosine) * sin
        up = np.where(cosine >= cos, 1, cosine * cos + side) * scale + slack
        down = np.where(cosine <= -cos, -1, cosine * cos - side) * scale - slack
        up[:, reach == 0], down[:, reach == 0] = (cosine * scale + slack)[:, reach == 0], (cosine * scale - slack)[:, reach == 0]
        needed = np.zeros_like(alive)
        for owner, a, b in zip(q.owner.tolist(), q.low / 100, q.high / 100):
            needed[owner] |= (up[owner] >= a) & (down[owner] <= b)
        alive &= needed
        some = alive.any(0)
        small = (level.high[nodes] - level.low[nodes] <= _LEAF) | (i == len(tree.levels) - 1)
        leaf = some & small
        low.append(level.low[nodes[leaf]])
        high.append(level.high[nodes[leaf]])
        upper.append(np.where(alive[:, leaf], up[:, leaf], _NEVER))
        lower.append(np.where(alive[:, leaf], down[:, leaf], np.inf))
        go = np.flatnonzero(some & ~small)
        if not len(go):
            break
        n = level.child[nodes[go] + 1] - level.child[nodes[go]]
        first = np.repeat(level.child[nodes[go]] - np.append(0, np.cumsum(n)[:-1]), n)
        alive = np.repeat(alive[:, go], n, axis=1)
        nodes = first + np.arange(len(first))
    return np.concatenate(low), np.concatenate(high), np.concatenate(upper, axis=1), np.concatenate(lower, axis=1)


class _Best:
    """The best ``k`` rows of each window so far: score downwards, then id, then row."""

    def __init__(self, windows: int, k: int, tree: Tree):
        self.k, self.tree, self.worst = k, tree, np.full(windows, _NEVER)
        self.window, self.point, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, window: np.ndarray, point: np.ndarray, score: np.ndarray) -> None:
        window, point, score = np.append(self.window, window), np.append(self.point, point), np.append(self.score, score)
        order = np.lexsort((self.tree.rep[point], self.tree.ids[point], -score, window))
        window = window[order]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        keep = order[rank < self.k]
        self.worst[window[rank == self.k - 1]] = score[order[rank == self.k - 1]]
        self.window, self.point, self.score = window[rank < self.k], point[keep], score[keep]


def search(tree: Tree, q: Queries, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, place in the tree, score): the best ``k`` rows of each window among rows of the anchor's label (not itself), or of others."""
    out = []
    for a in range(0, len(q.rep), _SOME):
        part, number = q.part(a, a + _SOME)
        if not len(part.owner):
            continue
        low, high, upper, lower = _leaves(tree, part)
        if not len(low):
            continue
        # A node of one label is of use to anchors of that label only, or to all others.
        lowest, greatest = np.minimum.reduceat(tree.label, low), np.maximum.reduceat(tree.label, low)
        ends_early = np.flatnonzero(np.append(low[1:], len(tree.label)) != high)
        for i in ends_early.tolist():
            lowest[i], greatest[i] = tree.label[low[i] : high[i]].min(), tree.label[low[i] : high[i]].max()
        one, mine = lowest == greatest, part.label[:, None] == lowest
        upper[(one & ~mine) if same else (one & mine)] = _NEVER
        slack = _SLACK * (np.sqrt(np.einsum("ij,ij->i", part.x, part.x)) * tree.most + 1)
        best = _Best(len(part.owner), k, tree)
        left = upper[part.owner]
        left[(left < part.low[:, None] / 100) | (lower[part.owner] > part.high[:, None] / 100)] = _NEVER
        active, some = np.arange(len(part.owner)), 8
        while True:
            top = left.max(axis=1) if left.shape[1] else np.full(len(active), _NEVER)
            go = (top > _NEVER) & (top >= best.worst[active] - slack[part.owner[active]])
            active, left = active[go], left[go]
            if not len(active):
                break
            take = min(some, left.shape[1])
            which = np.argpartition(-left, take - 1, axis=1)[:, :take]
            row, column = np.nonzero(np.take_along_axis(left, which, 1) > _NEVER)
            leaf = which[row, column]
            left[row, leaf] = _NEVER
            n = high[leaf] - low[leaf]
            window = np.repeat(active[row], n)
            point = np.repeat(low[leaf] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            owner = part.owner[window]
            ok = (tree.label[point] == part.label[owner]) == same
            if same:
                ok &= tree.rep[point] != part.rep[owner]
            window, point, owner = window[ok], point[ok], owner[ok]
            for at in range(0, len(window), 1 << 14):
                w, p, o = window[at : at + (1 << 14)], point[at : at + (1 << 14)], owner[at : at + (1 << 14)]
                score = np.einsum("ij,ij->i", part.x[o], tree.x[p])
                inside = (100 * score >= part.low[w]) & (100 * score <= part.high[w])
                best.add(w[inside], p[inside], score[inside])
            some *= 4
        out.append((number[best.window], best.point, best.score))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    window, point, score = (np.concatenate(x) for x in zip(*out))
    return window, point, score


def _planted(most: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        rep, ids, label = (table.column(c).to_numpy() for c in ("rep", "vec_id", "label"))
        tree = Tree.of(rep, ids, label, _matrix(table.column("embedding"), len(rep)), most)
        return pa.table({"block": table.column("block")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return run


def _met(k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    kinds = {"anchor": pa.int64(), "number": pa.int64(), "found": pa.int64(), "found_id": pa.int64(), "score": pa.float64()}

    def run(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        if not blocks.num_rows or not anchors.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        tree: Tree = pickle.loads(blocks.column("tree")[0].as_py())
        anchors = anchors.sort_by("rep")
        windows = anchors.column("windows").combine_chunks()
        flat = windows.flatten()
        owner = np.repeat(np.arange(len(windows)), windows.value_lengths().to_numpy())
        number, low, high = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("number", "low", "high"))
        rep = anchors.column("rep").to_numpy()
        q = Queries(rep, anchors.column("label").to_numpy(), _matrix(anchors.column("embedding"), len(rep)), owner, low, high)
        window, point, score = search(tree, q, k, same)
        columns = [rep[owner[window]], number[window], tree.rep[point], tree.ids[point], score]
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(kinds.items(), columns)})

    return run


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "found_id", "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _of_dimension(rows: DataFrame, blocks: int, groups: int, most: float, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    at = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
    trees = stage(at.select("rep", "vec_id", "label", "embedding", "block").groupBy("block").applyInArrow(_planted(most), "block int, tree binary"))
    anchors = rows.where("anchor").withColumn("group", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(groups)).cast("int"))

    def meet(queries: DataFrame, k: int, same: bool) -> DataFrame:
        left = trees.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("rep", "label", "embedding", "windows", "group", "block")
        pairs = left.groupBy("block", "group").cogroup(right.groupBy("block", "group"))
        return pairs.applyInArrow(_met(k, same), "anchor long, number long, found long, found_id long, score double")

    def window(number: Column, a: Column, b: Column) -> Column:
        return F.struct(number.cast("long").alias("number"), a.cast("double").alias("low"), b.cast("double").alias("high"))

    every = window(F.lit(0), F.lit("-Infinity"), F.lit("Infinity"))
    best = stage(_ranked(meet(anchors.withColumn("windows", F.array(every)), positives, True), ["anchor"], positives).drop("number"))
    wanted = best.groupBy(F.col("anchor").alias("rep")).agg(F.sort_array(F.collect_list(window(F.col("found"), low * F.col("score"), high * F.col("score")))).alias("windows"))
    other = _ranked(meet(anchors.join(wanted, "rep"), negatives, False), ["anchor", "number"], negatives)
    known = best.select("anchor", F.col("found").alias("number"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("rep").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = other.join(known, ["anchor", "number"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    Anchors are the rows for which ``anchor`` holds. An anchor's positives are its ``positives`` best other rows of the same label; for each
    of them come the ``negatives`` best rows of other labels whose score is ``low`` to ``high`` per cent of the positive's. A score is the inner product in double
    precision, exact where components are whole numbers and sums stay below 2^53 / 100. Higher scores come first, ties by smaller id.

    Rows with a null id, a null label, a null or empty vector, or a null or non-finite component take no part. Vectors of different
    length never meet. Rows with the same id are different rows, each an anchor or a partner of its own. Anchors without positives or negatives have no rows; an empty
    table gives an empty result. Other columns are not looked at.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("embedding"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite))
    rows = stage(rows.withColumn("rep", F.monotonically_increasing_id()))  # written once, so the numbers stay
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.sqrt(F.max(square)).alias("most"))
    found = df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score double, negative_score double")
    for own in sizes.where("anchors > 0").orderBy("d").collect():  # a row for each length of vectors
        size = max(1, min(block, BLOCK_BYTES // (8 * own.d)))
        found = found.union(_of_dimension(rows.where(F.size("embedding") == own.d), -(-own.n // size), -(-own.anchors // GROUP), own.most, positives, negatives, low, high))
    return found


def whole_scores(df: DataFrame) -> DataFrame:
    """``embeddings`` with every component x as floor(256 x); where 7 divides vec_id the label is the next of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(256 * x).cast("double")))
    return df.select("vec_id", moved.alias("label"), whole.alias("embedding"))


SQL = """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
               FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
          FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
    SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
    WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)
    QUALIFY row_number() OVER w <= 3"""

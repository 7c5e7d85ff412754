"""Near-duplicates by improved consistent weighted sampling over weighted shingles.

A document is its distinct shingles of ``n`` words (case and punctuation count), each with weight
(1 + ln tf) (1 + strength ln((1 + N) / (1 + df)) / ln(1 + N)): tf counts it in the document, df the documents that hold
it, of N, over the whole table. Documents are near when the weighted Jaccard similarity, the sum of the lesser over
the sum of the larger weights, is at least ``least``.

A document can only be near another when shingles that others hold too carry that share of its weight; the rest is
settled there. For the others consistent samples are drawn (a shingle and a level of its weight, equal for
two documents with probability equal to their similarity) and grouped to bands; documents that share a band are
compared as far as the classes, the connected components of the links, depend on it. Documents with equal sets are
one; those of a block are folded before they are sent. All of a group are compared with the one that has least weight of its own.
A group that still holds several components then goes to one task, or, cut into tiles of bounded size, to one task for each pair of
tiles. The task compares members outside the largest component with members of other components, joins components as it
finds links, and compares nothing within a component. Pairs whose unshared weights, or whose distances to the first of the group,
rule a link out are not compared, so a group of thousands of near copies takes about as many comparisons as it has
members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.llm.exchange import common_runs, counts_of, distinct_runs, in_blocks, ordered, pack_planes, pack_sorted, parts, received, unpack_planes, unpack_sorted
from tillview.llm.graph import components
from tillview.llm.words import mix
from tillview.session import stage

WORDS, LEAST, STRENGTH = 5, 0.8, 0.25
BANDS, ROWS = 16, 3
_EPS = 1e-9  # for rounding, where a sum decides what is left out
_LEVELS = 1 << 16
GROUP_BYTES = 16 << 20  # packed sets of a group that one task takes; a larger group is cut into tiles
_AT_ONCE = 64  # comparisons between two looks at the components


def _gamma_levels() -> np.ndarray:
    """Middle of each of 2^16 equal parts of the Gamma(2, 1) distribution, by Newton steps on its quantile."""
    u = (np.arange(_LEVELS) + 0.5) / _LEVELS
    x = np.where(u < 0.3, np.sqrt(2 * u) + 0.6 * u, 1 - np.log1p(-u) + np.log1p(-np.log1p(-u)) * 0.9)
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-300), 1e-7)
    return x


class Sampler:
    """Draws ``size`` consistent samples of weighted sets."""

    def __init__(self, size: int):
        self.size = size
        self.r = _gamma_levels()
        self.log_c = np.log(self.r)
        self.seeds = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))

    def draw(self, keys: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One row of samples for each set; set i is entries first[i] to first[i + 1] and is not empty."""
        out = np.empty((len(first) - 1, self.size), np.uint64)
        log_w, starts, set_of = np.log(weights), first[:-1], np.repeat(np.arange(len(first) - 1), np.diff(first))
        for j, seed in enumerate(self.seeds):
            bits = mix(keys ^ seed)
            r = self.r[bits & np.uint64(_LEVELS - 1)]
            log_c = self.log_c[(bits >> np.uint64(16)) & np.uint64(_LEVELS - 1)]
            beta = (bits >> np.uint64(32)).astype(np.float64) * 2.0**-32
            level = np.floor(log_w / r + beta)
            log_a = log_c - r * (level - beta + 1)
            low = np.minimum.reduceat(log_a, starts)
            at = np.flatnonzero(log_a == low[set_of])
            at = at[np.append(True, set_of[at][1:] != set_of[at][:-1])]  # equal values: the lesser key, as keys ascend
            out[:, j] = mix(keys[at] + level[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets given as ascending keys and weights."""
    (ka, wa), (kb, wb) = a, b
    at = np.minimum(np.searchsorted(ka, kb), len(ka) - 1)
    both = ka[at] == kb
    common = np.minimum(wa[at[both]], wb[both]).sum()
    return float(common / (wa.sum() + wb.sum() - common))


def _weights(tf: np.ndarray, df: np.ndarray, documents: int, strength: float) -> np.ndarray:
    return (1 + np.log(tf)) * (1 + strength * np.log((1 + documents) / (1 + df)) / np.log(1 + documents))


def _candidates(n: int, least: float, strength: float, bands: int, rows: int, documents: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["doc_id", "keys", "weights", "bands", "same", "shared", "own", "like"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.float64(), pa.float64(), pa.int64()]

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if docs.num_rows and told.num_rows:
            docs = ordered(docs)
            keys, counts = received(told)
            ids, sampler = docs.column("doc_id").to_pylist(), Sampler(bands * rows)
            for low, high, words in parts(docs, n):
                out += some(ids[low:high], words, keys, counts, sampler)
            out = folded(out)
        columns = [list(c) for c in zip(*out)] or [[] for _ in names]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def folded(rows: list[tuple]) -> list[tuple]:
        """Of equal sets the row of the smallest id; the others only name it."""
        first: dict[bytes, int] = {}
        for row in rows:
            first[row[4]] = min(row[0], first.get(row[4], row[0]))
        out, whole = [], set()
        for row in rows:
            if row[0] == first[row[4]] and row[4] not in whole:
                whole.add(row[4])
                out.append((*row, None))
            else:
                out.append((row[0], *[None] * 6, first[row[4]]))
        return out

    def some(ids, words, keys, counts, sampler) -> Iterator[tuple]:
        hashes, text, tf = distinct_runs(*words.runs_or_all())
        df = counts_of(hashes, keys, counts)
        weight = _weights(tf, df, documents, strength)
        size = len(words.count)
        total = np.bincount(text, weight, size)
        common = np.bincount(text, weight * (df > 1), size)
        some = (common >= (least - _EPS) * total) & (words.count > 0) & np.array([i is not None for i in ids])
        keep = some[text]
        hashes, text, weight = hashes[keep], text[keep], weight[keep]
        if not len(text):
            return
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        cut = np.append(first, len(text))
        drawn = sampler.draw(hashes, weight, cut)
        band = np.zeros((len(first), bands), np.uint64)
        for j in range(rows):
            band = band * np.uint64(0xD6E8FEB86659FD93) + drawn[:, j::rows]
        band = mix(band + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        for i, (a, b) in enumerate(zip(cut, cut[1:])):
            same = hashlib.sha256(hashes[a:b].tobytes() + weight[a:b].tobytes()).digest()
            t = text[a]
            yield ids[t], pack_sorted(hashes[a:b]), pack_planes(weight[a:b].view(np.uint64)), band[i], same, common[t], total[t] - common[t]

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group columns, both sets) to the similarity; a pivot's set is opened once while it stays the same."""
    last, pivot = None, None

    def opened(keys: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
        return unpack_sorted(keys), unpack_planes(weights).view(np.float64)

    for batch in batches:
        out = []
        mine = zip(batch.column("keys").to_pylist(), batch.column("weights").to_pylist())
        theirs = zip(batch.column("pivot").to_pylist(), batch.column("pivot_keys").to_pylist(), batch.column("pivot_weights").to_pylist())
        for a, (p, k, w) in zip(mine, theirs):
            if p != last:
                last, pivot = p, opened(k, w)
            out.append(similarity(opened(*a), pivot))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pivot"), pa.array(out, pa.float64())], names=["doc_id", "pivot", "similarity"])


def _similar(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, pivot, similarity) of the pairs, staged."""
    theirs = vectors.select(F.col("doc_id").alias("pivot"), F.col("keys").alias("pivot_keys"), F.col("weights").alias("pivot_weights"))
    both = pairs.join(vectors, "doc_id").join(theirs, "pivot")
    return stage(both.mapInArrow(_compared, "doc_id long, pivot long, similarity double"))


def _near(seen: DataFrame, least: float) -> DataFrame:
    return seen.where(F.col("similarity") >= least).select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))


def _nearest() -> F.Column:
    """No pair is nearer than the lesser shared weight over the larger and both weights that nobody shares."""
    return F.least("shared", "pivot_shared") / (F.greatest("shared", "pivot_shared") + F.col("own") + F.col("pivot_own"))


class _Group:
    """Members of a group, or of two tiles of it, with their sets side by side."""

    def __init__(self, table: pa.Table, least: float, band: int):
        self.least, self.band = least, band
        self.ids = table.column("doc_id").to_numpy()
        self.tile = table.column("tile").to_numpy()
        self.shared, self.own, self.low, self.high = (table.column(c).to_numpy() for c in ("shared", "own", "low", "high"))
        self.main = table.column("main").to_numpy()
        self.bands = [np.array(sorted(x)) for x in table.column("bands").to_pylist()]
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        self.cut = np.append(0, np.cumsum([len(k) for k in keys]))
        self.keys = np.concatenate(keys)
        self.weights = np.concatenate([unpack_planes(x).view(np.float64) for x in table.column("weights").to_pylist()])
        _, self.part = np.unique(table.column("part").to_numpy(), return_inverse=True)
        self.total = np.add.reduceat(self.weights, self.cut[:-1])

    def set_of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.keys[self.cut[i] : self.cut[i + 1]], self.weights[self.cut[i] : self.cut[i + 1]]

    def possible(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those that weights, distances to the first of the group, and other bands do not rule out."""
        # No pair is nearer than the lesser shared weight over the larger and both weights that nobody shares. One minus
        # the similarity is a metric, so two documents are no nearer than their distances to a third differ.
        nearest = np.minimum(self.shared[i], self.shared[others]) / (np.maximum(self.shared[i], self.shared[others]) + self.own[i] + self.own[others])
        apart = np.maximum(self.low[i] - self.high[others], self.low[others] - self.high[i])
        others = others[(nearest >= self.least - _EPS) & (apart <= 1 - self.least + _EPS)]
        # A pair that shares several bands meets in the least of them only.
        before = self.bands[i][self.bands[i] < self.band]
        if len(before) and len(others):
            others = others[[not np.isin(before, self.bands[j], assume_unique=True).any() for j in others.tolist()]]
        return others

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        size = self.cut[others + 1] - self.cut[others]
        at = np.arange(size.sum()) + np.repeat(self.cut[others] - np.append(0, np.cumsum(size)[:-1]), size)
        keys, weights = self.set_of(i)
        place = np.minimum(np.searchsorted(keys, self.keys[at]), len(keys) - 1)
        common = np.where(keys[place] == self.keys[at], np.minimum(weights[place], self.weights[at]), 0)
        common = np.add.reduceat(common, np.append(0, np.cumsum(size)[:-1]))
        found = common / (self.total[i] + self.total[others] - common)
        close = np.abs(found - self.least) < _EPS  # as near as rounding: by the one formula
        for j in np.flatnonzero(close).tolist():
            found[j] = similarity(self.set_of(i), self.set_of(int(others[j])))
        return others[found >= self.least]

    def links(self) -> list[tuple[int, int]]:
        out = []
        strays = np.flatnonzero(~self.main)
        both = self.tile.min() != self.tile.max()
        for i in strays.tolist():
            others = np.flatnonzero(self.part != self.part[i])
            if both:
                others = others[self.tile[others] != self.tile[i]]
            others = others[self.main[others] | (others > i)]
            others = self.possible(i, others)
            # First those at about the same distance from the first of the group.
            others = others[np.argsort(np.abs(self.low[others] - self.low[i]), kind="stable")]
            while len(others):
                for j in self.near(i, others[:_AT_ONCE]).tolist():
                    if self.part[j] != self.part[i]:
                        out.append((int(self.ids[i]), int(self.ids[j])))
                        self.part[self.part == self.part[j]] = self.part[i]
                others = others[_AT_ONCE:]
                others = others[self.part[others] != self.part[i]]
        return out


def _settled(least: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("keys", "ascending")])
        found = _Group(table, least, table.column("band")[0].as_py()).links() if table.num_rows > 1 else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _classes(sets: DataFrame, least: float) -> DataFrame:
    """(node, component) for documents near another one that shares a band with them."""
    # Equal sets are one: the document of the smallest id stands for them.
    equal = sets.where("like IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("like").alias("b"))
    sets = sets.where("like IS NULL").drop("like")
    first = sets.groupBy("same").agg(F.min("doc_id").alias("rep"))
    across = sets.select("doc_id", "same").join(first, "same").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    equal = stage(equal.union(across))
    one = first.groupBy(F.col("rep").alias("doc_id")).agg(F.min("same").alias("same"))
    sets = sets.join(one, ["doc_id", "same"], "left_semi")
    vectors = sets.select("doc_id", "keys", "weights")
    groups = sets.select("doc_id", "shared", "own", "bands", F.explode(F.array_distinct("bands")).alias("band")).dropDuplicates(["doc_id", "band"])
    lightest = F.min_by(F.struct("doc_id", "shared", "own"), F.struct("own", "doc_id"))
    shared = groups.groupBy("band").agg(F.count("*").alias("n"), lightest.alias("p")).where("n > 1")
    shared = shared.select("band", F.col("p.doc_id").alias("pivot"), F.col("p.shared").alias("pivot_shared"), F.col("p.own").alias("pivot_own"))
    open_ = stage(groups.join(shared, "band").where("doc_id <> pivot"))
    seen = _similar(open_.where(_nearest() >= least - _EPS).select("doc_id", "pivot").distinct(), vectors)
    found = stage(components(_near(seen, least).union(equal)))
    low, high = F.coalesce(1 - F.col("similarity"), 1 - _nearest()), F.coalesce(1 - F.col("similarity"), F.lit(1.0))
    at = open_.join(seen, ["doc_id", "pivot"], "left").select("band", "doc_id", "shared", "own", "bands", low.alias("low"), high.alias("high"))
    at = stage(at.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component"))
    # A group is settled when its members, less the one compared with all others, are of one component.
    parts_of = at.groupBy("band", "part").agg(F.count("*").alias("n"))
    main = parts_of.groupBy("band").agg(F.max_by("part", F.struct("n", "part")).alias("most_of"), F.count("*").alias("n")).where("n > 1")
    members = at.join(main.select("band", "most_of"), "band").withColumn("main", F.col("part") == F.col("most_of")).drop("most_of")
    members = members.join(vectors, "doc_id")
    size = members.groupBy("band").agg(F.sum(F.octet_length("keys") + F.octet_length("weights")).alias("size"))
    tiles = size.select("band", F.ceil(2 * F.col("size") / GROUP_BYTES).cast("int").alias("tiles"))
    tiles = tiles.withColumn("tiles", F.when(F.col("tiles") > 2, F.col("tiles")).otherwise(1))
    members = members.join(tiles, "band").withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    members = members.withColumns({"one": F.least("tile", "other"), "two": F.greatest("tile", "other")}).drop("other", "tiles")
    links = stage(members.groupBy("band", "one", "two").applyInArrow(_settled(least), "a long, b long"))
    if links.isEmpty():
        return found
    return stage(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)))


def near_duplicates(df: DataFrame, n: int = WORDS, least: float = LEAST, strength: float = STRENGTH, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, class_id (the smallest doc_id of its class), class_size (rows), kept.

    ``kept`` is true where doc_id is class_id, so rows that repeat that id stay together. Texts of fewer than ``n`` words have one shingle of all their words; texts without words are in no
    class with others, null text counts as empty. Rows with a null id are kept and have a null class. Rows of
    the same id are one document; of several texts of an id one is compared with those of other ids, and equal texts
    always share a class. An empty table gives an empty result.
    """
    blocks, count, documents = in_blocks(df, id_col, text_col)
    told = common_runs(blocks, count, n, short=True)
    schema = "doc_id long, keys binary, weights binary, bands array<long>, same binary, shared double, own double, like long"
    found = _candidates(n, least, strength, bands, rows, documents)
    sets = stage(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(found, schema))
    classes = _classes(sets, least).withColumnRenamed("node", "doc_id")
    ids = df.select(F.col(id_col).cast("long").alias("doc_id"))
    per_id = ids.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).join(classes, "doc_id", "left")
    per_id = per_id.withColumn("class_id", F.coalesce("component", "doc_id")).drop("component")
    sizes = per_id.groupBy("class_id").agg(F.sum("n").alias("class_size"))
    at = per_id.join(sizes, "class_id").select("doc_id", "class_id", "class_size")
    return ids.join(at, "doc_id", "left").select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"), (F.coalesce("class_id", F.lit(0)) == F.coalesce("doc_id", F.lit(0))).alias("kept"))

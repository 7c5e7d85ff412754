"""Packing documents into sequences by fitted length patterns.

Lengths fall into classes. All patterns of a few classes that fill a sequence are enumerated, and how often
each is used is fitted to the histogram of lengths by non-negative least squares. The counts are rounded down
and laid out with exact lengths, the last place of a pattern taking the longest length that still fits. What
is left is packed by best fit, longest first, into the open sequences and then into new ones.

All of this works on the histogram of lengths, whose size is that of a sequence, not of the data. The result
gives each length an ordered list of places; the k-th piece of a length takes its k-th place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillview.llm.bpe import chunks, encoder
from tillview.session import stage

CAPACITY, CLASSES, DEPTH = 4096, 64, 4
SLACK = 0  # a laid-out pattern may leave this much room; else its pieces are left for best fit


@lru_cache(maxsize=8)
def patterns(units: int, depth: int) -> tuple[tuple[int, ...], ...]:
    """Non-increasing tuples of at most ``depth`` numbers from 1 that sum to ``units``."""
    out = []

    def grow(start: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(start)
        elif len(start) < depth:
            most = min(left, start[-1] if start else left)
            for x in range(most, (left - 1) // (depth - len(start)), -1):
                grow((*start, x), left - x)

    grow((), units)
    return tuple(out)


def non_negative(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0.0))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= slack:
            break
        active[best] = True
        while True:
            cols = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[cols] = z
                break
            low = z <= 0
            step = np.min(x[cols][low] / np.maximum(x[cols][low] - z[low], 1e-300))
            x[cols] += step * (z - x[cols])
            drop = cols[low & (x[cols] <= 1e-9 * max(1.0, np.abs(b).max(initial=0.0)))]
            x[drop] = 0
            active[drop if len(drop) else cols[low]] = False
            x[~active] = 0
    return x


def plan(histogram: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many), for ``histogram[length]`` pieces of each length from 0 to capacity."""
    left = histogram.astype(np.int64).copy()
    if capacity % classes:
        classes = capacity
    width = capacity // classes
    klass = (np.arange(capacity + 1) + width - 1) // width
    out: list[tuple[tuple[int, ...], int]] = []
    if left[1:].sum():
        known = patterns(classes, depth)
        a = np.zeros((classes, len(known)))
        for j, p in enumerate(known):
            for c in p:
                a[c - 1, j] += 1
        counts = np.floor(non_negative(a, np.bincount(klass[1:] - 1, left[1:], classes)) + 1e-6).astype(np.int64)
        for j in np.argsort(-counts, kind="stable"):
            if counts[j]:
                out += _laid_out(left, known[j], int(counts[j]), width, capacity)
    return _best_fit(left, out, capacity)


def _longest(left: np.ndarray, low: int, high: int) -> int:
    """The longest length in low..high with pieces left, else 0."""
    found = np.flatnonzero(left[max(low, 1) : high + 1])
    return int(found[-1]) + max(low, 1) if len(found) else 0


def _laid_out(left: np.ndarray, pattern: tuple[int, ...], n: int, width: int, capacity: int) -> list:
    """``n`` sequences of one pattern as far as pieces are left; takes them from ``left``."""
    out = []
    while n:
        taken: list[int] = []
        for place, c in enumerate(pattern):
            last = place == len(pattern) - 1 and place
            length = _longest(left, 1, capacity - sum(taken)) if last else _longest(left, (c - 1) * width + 1, c * width)
            if not length:
                break
            taken.append(length)
            left[length] -= 1
        for x in taken:
            left[x] += 1
        if len(taken) < len(pattern) or capacity - sum(taken) > SLACK:
            break
        many = min([n, *(int(left[x]) // taken.count(x) for x in set(taken))])
        for x in taken:
            left[x] -= many
        out.append((tuple(taken), many))
        n -= many
    return out


def _best_fit(left: np.ndarray, groups: list, capacity: int) -> list:
    """Place what is left, longest first, where the least room remains."""
    room: dict[int, list] = {}
    free = np.zeros(capacity + 1, bool)

    def put(lengths: tuple[int, ...], many: int) -> None:
        r = capacity - sum(lengths)
        room.setdefault(r, []).append((lengths, many))
        free[r] = True

    for lengths, many in groups:
        put(lengths, many)
    for length in range(capacity, 0, -1):
        many = int(left[length])
        while many:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                r = int(fits[0]) + length
                lengths, there = room[r].pop()
                free[r] = bool(room[r])
            else:
                r, lengths, there = capacity, (), many
            each = min(r // length, many)  # the next of a length has least room where the last one went
            full = min(there, many // each)
            put((*lengths, *[length] * each), full)
            if lengths and there > full:
                put(lengths, there - full)
            many -= full * each
        left[length] = 0
    return [g for r in sorted(room) for g in room[r]]


def places(groups: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of places in the order of (length, rank): key, first sequence, offset; a key is length and first rank."""
    rows, used, base = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, many in groups:
        offset = 0
        for x in lengths:
            rows.append(((x << 44) + int(used[x]), base, offset))
            used[x] += many
            offset += x
        base += many
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def _pieces(path: str, end: int, capacity: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            for ids, texts in chunks(batch):
                rows = []
                for doc, raw in zip(ids.to_pylist(), encoder(path).encode(texts)):
                    raw += tail
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc, piece, at // 4, n, zlib.crc32(own), part, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def pieces(df: DataFrame, path: str, end: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of each document, the only ones longer than ``capacity`` cut: doc_id, piece, start, length,
    ids_crc32, and which piece of its length it is in its partition: part, rank. Staged, so that it stays so."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    return stage(rows.mapInArrow(_pieces(path, end, capacity), schema))


def pack(cut: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, depth: int = DEPTH) -> DataFrame:
    """Rows with part, length and rank (see ``pieces``) with their sequence_id and offset.

    The driver sees one count for each length. The k-th piece of a length in the whole table is found from its
    rank in its partition and the counts of the partitions before.
    """
    spark = cut.sparkSession
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r.length] = r.n
    table = spark.sparkContext.broadcast(places(plan(histogram, capacity, classes, depth), capacity))
    order = W.partitionBy("length").orderBy("part")
    before = counts.withColumn("before", F.sum("n").over(order) - F.col("n")).drop("n")
    fields = [f for f in cut.schema.fields if f.name not in ("part", "rank")]
    ranked = cut.join(before, ["part", "length"]).select(*[f.name for f in fields], (F.col("rank") + F.col("before")).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, offset = table.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 44) + rank, "right") - 1
            seq = first[at] + rank - (key[at] & ((1 << 44) - 1))
            keep = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(offset[at])], names=[*[f.name for f in fields], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(placed, schema)


def pack_documents(df: DataFrame, path: str, end: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    Null and empty texts are a piece of the end id alone. Repeated ids are documents of their own; null ids stay
    null. An empty table gives an empty result; other columns are not looked at.
    """
    return pack(pieces(df, path, end, capacity, id_col, text_col), capacity)

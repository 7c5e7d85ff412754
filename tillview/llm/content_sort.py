"""Exact duplicates by sorting the content.

Texts are equal when they are identical after each run of white space became one space. The normalised
texts are range-partitioned by sampled splitters on (first bytes, digest of all, id), so that a splitter is
small however long the texts are, and sorted externally. Equal texts are neighbours, and a large group of
copies spreads over as many partitions as its size asks for. One pass compares each text with the one before
it, in full. Runs of equal texts that go on in the next partition
are joined by comparing the two texts at each border; that takes two rows a partition.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.session import stage

# One run of white space that is not already a single space.
_LOOSE = r"\x20*[\x09-\x0D][\x20\x09-\x0D]*|\x20{2,}"

_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_RUNS = "part int, edge int, doc_id long, rank long, keep_id long, group_size long, text_sha256 string, border string"
_SLICE = 1 << 16
_HEAD = 48  # characters of a text in a splitter


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _LOOSE, " ")


class _Run:
    """Rows with equal text, in order of their ids; the ids may come in several batches."""

    def __init__(self, row: pa.RecordBatch, first: bool):
        self.row, self.first, self.ids = row, first, []
        self.digest = row.column("text_sha256")[0]
        self.text = _normal(row.column("text")[0])


def _normal(text: pa.Scalar) -> str:
    return _SPACES.sub(" ", text.as_py() or "")


def _carried(batch: pa.RecordBatch) -> list[pa.Array]:
    return [batch.column("text"), *batch.columns[4:]]


def _batch(part, edge, ids, rank, keep, size, digest, border, carried) -> pa.RecordBatch:
    n = len(ids)
    arrays = [pa.array(np.full(n, part), pa.int32()), pa.array(edge, pa.int32()), ids, pa.array(rank, pa.int64()), keep, pa.array(size, pa.int64()), digest, border]
    names = [x.split()[0] for x in _RUNS.split(", ")]
    return pa.RecordBatch.from_arrays([*arrays, *carried], names=[*names, *(f"c{i}" for i in range(len(carried)))])


def _emit(run: _Run, part: int, last: bool, heads_only: bool) -> Iterator[pa.RecordBatch]:
    """A run at the edge of a partition or over several batches; its first row has the text if it is at an edge."""
    ids = pa.concat_arrays(run.ids)
    edge = 1 if run.first else 2 if last else 0
    for at in range(0, 1 if heads_only else len(ids), _SLICE):
        some = ids.slice(at, 1 if heads_only else _SLICE)
        n = len(some)
        border = pa.array([run.text if at == 0 and edge else None] + [None] * (n - 1), pa.string())
        carried = _carried(run.row) if heads_only else []
        yield _batch(part, np.full(n, edge), some, np.arange(at, at + n), pa.repeat(ids[0], n), np.full(n, len(ids)), pa.repeat(run.digest, n), border, carried)


def _runs(heads_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows of one partition to rows with the size and first id of their run, or to the first row of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_run = TaskContext.get().partitionId(), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, text, digest = batch.columns[:3]
            new = np.ones(n, bool)
            same = pc.equal(digest.slice(1), digest.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(same).tolist():  # the digests agree: compare the texts
                new[i + 1] = not text[i].equals(text[i + 1]) and _normal(text[i]) != _normal(text[i + 1])
            if open_run is not None and open_run.digest.equals(digest[0]):
                new[0] = open_run.text != _normal(text[0])
            starts = np.flatnonzero(new)
            if open_run is not None:
                open_run.ids.append(ids.slice(0, int(starts[0]) if len(starts) else n))
            if not len(starts):
                continue
            first = open_run is None
            if open_run is not None:
                yield from _emit(open_run, part, False, heads_only)
            if first and len(starts) > 1:  # the first run of the partition is at its edge
                head = _Run(batch.slice(0, 1), True)
                head.ids.append(ids.slice(0, int(starts[1])))
                yield from _emit(head, part, False, heads_only)
                starts, first = starts[1:], False
            if len(starts) > 1:
                yield _inner(batch, part, starts, heads_only)
            at = int(starts[-1])
            open_run = _Run(batch.slice(at, 1), first)
            open_run.ids.append(ids.slice(at))
        if open_run is not None:
            yield from _emit(open_run, part, True, heads_only)

    return run


def _inner(batch: pa.RecordBatch, part: int, starts: np.ndarray, heads_only: bool) -> pa.RecordBatch:
    """All runs of a batch but the last."""
    ids, _, digest = batch.columns[:3]
    size = np.diff(starts)
    if heads_only:
        at, n = pa.array(starts[:-1]), len(size)
        keep = ids.take(at)
        return _batch(part, np.zeros(n), keep, np.zeros(n), keep, size, digest.take(at), pa.nulls(n, pa.string()), [c.take(at) for c in _carried(batch)])
    first, n = int(starts[0]), int(starts[-1] - starts[0])
    heads = np.repeat(starts[:-1], size)
    return _batch(part, np.zeros(n), ids.slice(first, n), np.arange(n) + first - heads, ids.take(pa.array(heads)), np.repeat(size, size), digest.slice(first, n), pa.nulls(n, pa.string()), [])


def _joined(spark, runs: DataFrame) -> list[tuple]:
    """For the runs at the borders of partitions: (part, edge, keep_id, group_size, rows before).

    The driver sees four numbers for each partition; the texts are compared by a join.
    """
    edges = runs.where("rank = 0 AND edge > 0")
    seen: dict[int, dict[int, tuple]] = {}
    for r in edges.select("part", "edge", "keep_id", "group_size").collect():
        seen.setdefault(r.part, {})[r.edge] = (r.keep_id, r.group_size)
    parts = sorted(seen)
    pairs = list(zip(parts, parts[1:]))
    if not pairs:
        return []
    last = edges.join(F.broadcast(spark.createDataFrame([(p, max(seen[p]), q) for p, q in pairs], "part int, edge int, next int")), ["part", "edge"])
    first = edges.where("edge = 1").select(F.col("part").alias("next"), F.col("border").alias("there"))
    same = {r.part for r in last.join(first, "next").where("border = there").select("part").collect()}
    out, chain = [], []

    def close():
        if len(chain) > 1:
            keep, total, before = seen[chain[0][0]][chain[0][1]][0], sum(seen[p][e][1] for p, e in chain), 0
            for p, e in chain:
                out.append((p, e, keep, total, before))
                before += seen[p][e][1]

    for p in parts:
        chain.append((p, 1))
        if len(seen[p]) > 1:
            close()
            chain = [(p, 2)]
        if p not in same:
            close()
            chain = []
    close()
    return out


def _sorted(df: DataFrame, id_col: str, text_col: str, partitions: int | None, carry: list[str]) -> DataFrame:
    """doc_id, text, text_sha256, head, c0, c1, ... in order of head, digest and id."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    norm = normalised(F.col("text"))
    rows = rows.select("doc_id", "text", F.sha2(norm, 256).alias("text_sha256"), F.substring(norm, 1, _HEAD).alias("head"), *[f"c{i}" for i in range(len(carry))])
    order = [F.col("head").asc(), F.col("text_sha256").asc(), F.col("doc_id").asc_nulls_last()]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order)


def _with_edges(runs: DataFrame) -> DataFrame:
    spark = runs.sparkSession
    fixes = spark.createDataFrame(_joined(spark, runs), "part int, edge int, k long, s long, before long")
    return runs.drop("border").join(F.broadcast(fixes), ["part", "edge"], "left")  # two rows a partition


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the smallest id of equal texts stays; of rows with the same text and id one stays. Null
    ids come after all others (a group of null ids only has a null keep_id, and one row of it stays). Null
    text counts as empty; an empty table gives an empty result; other columns are not looked at.
    """
    runs = stage(_sorted(df, id_col, text_col, partitions, []).mapInArrow(_runs(False), _RUNS))
    return _with_edges(runs).select(
        "doc_id",
        F.when(F.col("s").isNotNull(), F.col("k")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("s", "group_size").alias("group_size"),
        (F.col("rank") + F.coalesce("before", F.lit(0)) == 0).alias("kept"),
        "text_sha256",
    )


def unique_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """The rows that ``exact_groups`` keeps, with all their columns as they were."""
    carry = [c for c in df.columns if c not in (id_col, text_col)]
    at = {c: f"c{i + 1}" for i, c in enumerate(carry)} | {id_col: "doc_id", text_col: "c0"}
    kinds = {c: k.simpleString() for c, k in ((f.name, f.dataType) for f in df.schema.fields)}
    schema = ", ".join([_RUNS, "c0 string", *(f"{at[c]} {kinds[c]}" for c in carry)])
    runs = stage(_sorted(df, id_col, text_col, partitions, carry).mapInArrow(_runs(True), schema))
    kept = _with_edges(runs).where("coalesce(before, 0) = 0")
    return kept.select(*[F.col(at[c]).cast(kinds[c]).alias(c) for c in df.columns])

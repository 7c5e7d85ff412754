"""Records of files whose lines are not their records: CSV with line breaks in cells, JSON arrays over many lines or on one.

Spark reads such a file in pieces, cut at a byte that ends a record when it stands outside a text (the line feed of CSV, the closing brace of
JSON), so that any number of tasks share the file. What a piece does to the reader's state is a function of the state it begins
in; functions compose, so each file range is first boiled down to one, a prefix over the ranges of a file gives the state that each begins in, and a
second scan puts the pieces of whole records together. What a range has left before its first and after its last
record end is joined with that of its neighbours. The driver sees some twenty bytes for each range of a file, and nothing of the texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillview.session import stage

# A piece and whether it begins inside a text, to whether it ends inside one and by how much the depth of nesting changes.
Scan = Callable[[str, bool], tuple[bool, int]]


@dataclass(frozen=True)
class Framing:
    """How pieces make records: what ends a piece, what a piece does to the state, and the depth at which a record ends."""

    ends: str
    scan: Scan
    depth: int


def csv_framing(sep: str) -> Framing:
    def scan(piece: str, inside: bool) -> tuple[bool, int]:
        if '"' not in piece:
            return inside, 0
        at, n = 0, len(piece)
        while True:
            if inside:
                at = piece.find('"', at)
                if at < 0:
                    return True, 0
                if at + 1 < n and piece[at + 1] == '"':
                    at += 2
                    continue
                inside, at = False, at + 1
            elif at < n and piece[at] == '"':  # a quote opens a cell at its beginning only
                inside, at = True, at + 1
                continue
            at = piece.find(sep, at)
            if at < 0:
                return False, 0
            at += len(sep)

    return Framing("\n", scan, 0)


_REST_OF_TEXT = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_TEXT = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)


def json_framing(depth: int) -> Framing:
    """``depth``: how many brackets and braces are open around an element."""

    def scan(piece: str, inside: bool) -> tuple[bool, int]:
        if inside:
            rest = _REST_OF_TEXT.match(piece)
            if rest is None:
                return True, 0
            piece = piece[rest.end() :]
        if '"' in piece:
            piece, quote, _ = _TEXT.sub("", piece).partition('"')
            inside = bool(quote)
        else:
            inside = False
        change = piece.count("{") + piece.count("[") - piece.count("]")
        return inside, change if inside else change - 1

    return Framing("}", scan, depth)


def _pieces(spark: SparkSession, path: str, framing: Framing, encoding: str) -> DataFrame:
    lines = spark.read.option("lineSep", framing.ends).option("encoding", encoding).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """The pieces of a task by the range of a file they are of, as they come: each batch cut where the range changes."""
    for batch in batches:
        start = batch.column("start").to_numpy()
        file = batch.column("file").dictionary_encode()
        code = file.indices.to_numpy()
        cut = [0, *(np.flatnonzero((np.diff(start) != 0) | (np.diff(code) != 0)) + 1).tolist(), len(start)]
        for a, b in zip(cut, cut[1:]):
            if b > a:
                yield file.dictionary[int(code[a])].as_py(), int(start[a]), batch.column("value").slice(a, b - a).to_pylist()


def _boiled(scan: Scan):
    """(file, start, and for either state at the beginning the state at the end and the change of depth) of each range."""
    names = ["file", "start", "out_0", "depth_0", "out_1", "depth_1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for file, start, pieces in _ranges(batches):
            now = found.setdefault((file, start), [False, 0, True, 0])
            for piece in pieces:
                for i in (0, 2):
                    inside, change = scan(piece, now[i])
                    now[i], now[i + 1] = inside, now[i + 1] + change
        rows = [(*key, *now) for key, now in found.items()]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
        columns = zip(*rows) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return run


def _prefixed(table: pa.Table) -> pa.Table:
    """The state and depth that each range of a file begins in."""
    table = table.sort_by("start")
    inside, depth, rows = False, 0, []
    for out_0, depth_0, out_1, depth_1 in zip(*(table.column(c).to_pylist() for c in ("out_0", "depth_0", "out_1", "depth_1"))):
        rows.append((inside, depth))
        inside, depth = (out_1, depth + depth_1) if inside else (out_0, depth + depth_0)
    return pa.table({"file": table.column("file"), "start": table.column("start"), "inside": [r[0] for r in rows], "depth": [r[1] for r in rows]})


_OUT = "file string, start long, side int, first boolean, text string"


def _framed(framing: Framing, sent):
    """Whole records (side 0), and what a range has before its first (1) and after its last end (2); 3 where it has none.

    ``first`` is the first record of a file that is not blank, or what its first range has of it.
    """

    def rows_of(key: tuple[str, int], state: list, pieces: list[str]) -> Iterator[tuple]:
        inside, depth, begun, left, first = state
        for piece in pieces:
            left.append(piece)
            inside, change = framing.scan(piece, inside)
            depth += change
            if not inside and depth == framing.depth:
                text = framing.ends.join(left)
                named = first and bool(text.strip())
                yield *key, 0 if begun else 1, named, text
                left.clear()
                begun, first = True, first and not named
        state[:] = [inside, depth, begun, left, first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = sent.value
        states: dict[tuple[str, int], list] = {}
        for file, start, pieces in _ranges(batches):
            if (file, start) not in states:
                states[file, start] = [*begins.get((file, start), (False, 0)), start == 0, [], start == 0]
            yield from _as_batch(list(rows_of((file, start), states[file, start], pieces)))
        rest = [(*key, 2 if begun else 3, first, framing.ends.join(left)) for key, (_, _, begun, left, first) in states.items() if left or not begun]
        yield from _as_batch(rest)

    return run


def _as_batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["file", "start", "side", "first", "text"])


def records(spark: SparkSession, path: str, framing: Framing, encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(file, first, text) of every record, and (file, text) of what follows the last record of a file.

    The text of a record is without the sign that ends it. Records that reach over ranges are put together from one row a range.
    """
    pieces = _pieces(spark, path, framing, encoding)
    boiled = pieces.mapInArrow(_boiled(framing.scan), "file string, start long, out_0 boolean, depth_0 long, out_1 boolean, depth_1 long")
    begins = boiled.groupBy("file").applyInArrow(_prefixed, "file string, start long, inside boolean, depth long").where("inside OR depth <> 0").toArrow()
    known = {(f, s): (i, d) for f, s, i, d in zip(*(begins.column(c).to_pylist() for c in ("file", "start", "inside", "depth")))}
    sent = spark.sparkContext.broadcast(known)
    framed = stage(pieces.mapInArrow(_framed(framing, sent), _OUT))
    edges = framed.where("side <> 0")
    ends = F.when(F.col("side") == 1, 1).otherwise(0)
    before = F.sum(ends).over(Window.partitionBy("file").orderBy("start", "side")) - ends  # narrow rows, two a range
    number = edges.select("file", "start", "side").withColumn("record", before)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "side", "text"))), lambda p: p["text"]), framing.ends)
    joined = edges.join(number, ["file", "start", "side"]).groupBy("file", "record")
    joined = joined.agg(text.alias("text"), F.bool_or(F.col("side") == 1).alias("whole"), F.bool_or("first").alias("first"))
    whole = framed.where("side = 0").select("file", "first", "text").union(joined.where("whole").select("file", "first", "text"))
    return whole, joined.where("NOT whole").select("file", "text")

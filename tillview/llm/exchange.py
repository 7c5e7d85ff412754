"""How many documents hold each run of words, told to the blocks of documents that hold it.

Documents are dealt into blocks of a few megabytes. A block sends each run of ``n`` words it holds once, as a
56-bit hash with the number of its documents that hold it; hashes travel sorted, as differences, so that each
takes about five bytes. The hashes of one range meet in a bucket, which adds the numbers up and tells each block
those of its hashes that two documents or more hold. A run in a third of all documents is one entry a block.
Two different runs share a hash about once in 10^16 pairs; what must be exact is compared by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.llm.words import groups_of, run_hashes, runs_inside, text_bytes, word_hashes, word_spans

BLOCK_BYTES = 8 << 20
BUCKETS = 1  # for each block
CHUNK = 2 << 20
_BITS = 56


def narrow(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - _BITS)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as compressed byte planes of their differences."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return pack_planes(steps)


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(raw), dtype=np.uint64)


def pack_planes(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_planes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def in_blocks(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int, int]:
    """(block, doc_id, text, was_null, and ``carry`` as c0, c1, ...), the number of blocks, and the number of rows."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), text.isNull().alias("was_null"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-(size or 0) // BLOCK_BYTES))
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "*"), blocks, n


def ordered(table: pa.Table) -> pa.Table:
    """Rows by id and text, so that a block reads the same whatever way its rows came."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


class Words:
    """Word hashes of some texts of a block, and the hashes of runs of ``n`` words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int):
        self.data, self.offsets, self.n = data, offsets, n
        self.starts, self.ends, self.first = word_spans(data, offsets)
        self.words = word_hashes(data, self.starts, self.ends)
        self.count = np.diff(self.first)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, hash and text of each run that lies within a text."""
        at = runs_inside(self.first, self.n)
        hashes = narrow(run_hashes(self.words, self.n)[at]) if len(at) else np.empty(0, np.uint64)
        return at, hashes, np.repeat(np.arange(len(self.count)), np.maximum(self.count - self.n + 1, 0))

    def runs_or_all(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of each run; a text of fewer words (but one) has one run of all its words."""
        _, hashes, text = self.runs()
        few = np.flatnonzero((self.count > 0) & (self.count < self.n))
        if len(few):
            short = np.zeros(len(few), np.uint64)
            for j in range(self.n - 1):
                has = self.count[few] > j
                short[has] = short[has] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.first[few][has] + j]
            hashes, text = np.append(hashes, narrow(short + np.uint64(1))), np.append(text, few)
        return hashes, text


def parts(table: pa.Table, n: int) -> Iterator[tuple[int, int, Words]]:
    """A block's rows, some megabytes at a time: first row, end, words."""
    data, offsets = text_bytes(table.column("text"))
    for low, high in groups_of(offsets, CHUNK):
        own = offsets[low : high + 1]
        yield low, high, Words(data[own[0] : own[-1]], own - own[0], n)


def distinct_runs(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (text, hash) once, sorted by text and hash, and how often it occurred."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))) if len(h) else np.empty(0, np.int64)
    return h[new], t[new], np.diff(np.append(new, len(h)))


def _sent(n: int, short: bool, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        keys, counts = [], []
        for _, _, words in parts(table, n):
            if short:
                hashes, text = words.runs_or_all()
            else:
                _, hashes, text = words.runs()
            some = distinct_runs(hashes, text)[0]
            key, count = np.unique(some, return_counts=True)
            keys.append(key)
            counts.append(count)
        all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(all_keys, kind="stable")
        all_keys, all_counts = all_keys[order], all_counts[order]
        new = np.flatnonzero(np.append(True, all_keys[1:] != all_keys[:-1])) if len(order) else np.empty(0, np.int64)
        key, count = all_keys[new], np.add.reduceat(all_counts, new) if len(new) else all_counts
        edges = np.array([(i << _BITS) // buckets for i in range(1, buckets)], np.uint64)
        cut = [0, *np.searchsorted(key, edges).tolist(), len(key)]
        rows = [(b, block, pack_sorted(key[x:y]), pack_planes(count[x:y])) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
        return _table(rows, ["bucket", "block", "keys", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _added(table: pa.Table) -> pa.Table:
    blocks = table.column("block").to_pylist()
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    counts = [unpack_planes(x) for x in table.column("counts").to_pylist()]
    cut = np.append(0, np.cumsum([len(k) for k in keys]))
    key, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    total = np.empty(len(key), np.int64)
    total[order] = np.repeat(np.add.reduceat(count[order], new), np.diff(np.append(new, len(key))))
    rows = []
    for block, k, a, b in zip(blocks, keys, cut, cut[1:]):
        common = total[a:b] > 1
        if common.any():
            rows.append((block, pack_sorted(k[common]), pack_planes(total[a:b][common])))
    return _table(rows, ["block", "keys", "counts"], [pa.int32(), pa.binary(), pa.binary()])


def common_runs(blocks: DataFrame, n_blocks: int, n: int, short: bool = False) -> DataFrame:
    """(block, keys, counts): the run hashes of each block that two documents or more hold, with how many do.

    ``short``: a text of fewer than ``n`` words has one run of all its words; else it has none.
    """
    sent = blocks.groupBy("block").applyInArrow(_sent(n, short, n_blocks * BUCKETS), "bucket int, block int, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(_added, "block int, keys binary, counts binary")


def received(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts from a block's rows of ``common_runs``."""
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    counts = [unpack_planes(x) for x in table.column("counts").to_pylist()]
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    by = np.argsort([k[0] for k in keys])
    return np.concatenate([keys[i] for i in by]), np.concatenate([counts[i] for i in by]).astype(np.int64)


def counts_of(hashes: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many documents hold each hash; 1 for those not among ``keys``."""
    if not len(keys):
        return np.ones(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, counts[at], 1)

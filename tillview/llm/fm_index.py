"""Repeated passages by compressed full-text indexes of shards.

A window of ``n`` words belongs to the shard of its minimiser, the three consecutive words in it whose hash is
least, so equal windows share a shard and no document has to be searched for in all shards. Stretches of windows
of one shard travel as one text. Windows that only one document holds are left out before (their hashes are
counted over all blocks first). A shard indexes its distinct texts: word numbers in suffix order as far as the
windows reach, the transform in a wavelet matrix of packed bits. The texts are streamed through it by
backward search, a word at a time from the right, all texts abreast; the length of the longest match is kept
for every position, and where it reaches ``n`` the rows of the match give the first document that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.llm.exchange import common_runs, counts_of, in_blocks, ordered, pack_planes, pack_sorted, parts, received, unpack_planes, unpack_sorted
from tillview.llm.words import run_hashes

WINDOW = 13
_GRAM = 3
SHARDS = 2  # for each block
_LONGEST = 64  # windows in a stretch; a longer one goes on as another


class Bits:
    """Packed bits that count the ones before a position."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros((len(bits) >> 6) + 1, "<u8")
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))[:-1].astype(np.uint32)
        self.ones = int(np.bitwise_count(words).sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        part = self.words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(part).astype(np.int64)


class FMIndex:
    """An index of sequences of symbols (numbers from 1; 0 parts the texts) for patterns of up to ``reach`` symbols."""

    def __init__(self, text: np.ndarray, reach: int):
        n = len(text)
        rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        ranks = {1: rank}
        while step < reach:  # order by the first 2, 4, 8, ... symbols
            key = rank * (n + 1)
            key[: max(n - step, 0)] += rank[step:] + 1
            rank = np.unique(key, return_inverse=True)[1]
            step *= 2
            ranks[step] = rank
        self.suffix = np.argsort(rank, kind="stable")
        self.size = n
        self.ranks, self.reach = ranks, reach
        transform = text[self.suffix - 1]
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1)))
        self.levels: list[tuple[int, Bits]] = []
        for bit in range(max(int(text.max(initial=0)).bit_length(), 1) - 1, -1, -1):
            ones = (transform >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones)))
            transform = np.concatenate([transform[~ones], transform[ones]])

    def ranks_before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Symbols in the transform before ``at`` that equal ``symbol`` (down the wavelet matrix)."""
        start = np.zeros(len(at), np.int64)
        at = at.copy()
        for bit, bits in self.levels:
            one = (symbol >> bit) & 1 == 1
            zeros = self.size - bits.ones
            a, b = bits.rank(start), bits.rank(at)
            start = np.where(one, zeros + a, start - a)
            at = np.where(one, zeros + b, at - b)
        return at - start

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the matches with ``symbol`` put in front; symbols the index does not have match nothing."""
        known = (symbol > 0) & (symbol < len(self.first) - 1)
        c = np.where(known, symbol, 0)
        both = self.ranks_before(np.append(c, c), np.append(low, high))
        low2, high2 = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
        return low2, np.where(known, high2, low2)

    def classes(self, n: int) -> np.ndarray:
        """For each row the number of its class of suffixes that share the first ``n`` symbols."""
        half = 1 << (n.bit_length() - 1)
        rank = self.ranks[half]
        a = rank[self.suffix]
        b = np.append(rank, np.full(n, -1))[self.suffix + (n - half)]
        new = np.ones(self.size, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return np.cumsum(new) - 1

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that match whole patterns (one a row of the argument)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        for j in range(patterns.shape[1] - 1, -1, -1):
            low, high = self.extend(patterns[:, j], low, high)
        return low, high

    def statistics(self, texts: list[np.ndarray], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Matching statistics of each text: for every position the length, at most ``n``, of the longest match that
        begins there, and a row of that match."""
        klass = self.classes(n)
        edge = np.flatnonzero(np.append(True, klass[1:] != klass[:-1])) if self.size else np.empty(0, np.int64)
        edge = np.append(edge, self.size)
        size = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate([*texts, np.empty(0, np.int64)])
        ends = np.cumsum(size)
        by = np.argsort(-size, kind="stable")
        ends_by, size_by = ends[by], size[by]
        length, where = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        low, high, have = np.zeros(len(texts), np.int64), np.full(len(texts), self.size), np.zeros(len(texts), np.int64)
        for step in range(1, int(size.max(initial=0)) + 1):
            k = int(np.searchsorted(-size_by, -step, "right"))  # texts that reach this far to the left
            at = ends_by[:k] - step
            lo, hi = self.extend(flat[at], low[:k], high[:k])
            have[:k] += 1
            lost = np.flatnonzero(lo >= hi)
            while len(lost):  # the longest shorter pattern that still matches
                have[lost] -= 1
                done = lost[have[lost] == 0]
                lo[done], hi[done] = 0, self.size
                lost = lost[have[lost] > 0]
                for m in np.unique(have[lost]).tolist():
                    some = lost[have[lost] == m]
                    lo[some], hi[some] = self.search(flat[at[some][:, None] + np.arange(m)])
                lost = lost[lo[lost] >= hi[lost]]
            full = np.flatnonzero(have[:k] > n - 1)
            have[full] = n  # only the first n symbols count: widen to their class
            lo[full], hi[full] = edge[klass[lo[full]]], edge[klass[lo[full]] + 1]
            low[:k], high[:k] = lo, hi
            length[at], where[at] = have[:k], lo
        return [(length[e - m : e], where[e - m : e]) for e, m in zip(ends.tolist(), size.tolist())]


def _minimisers(words: np.ndarray, n: int) -> np.ndarray:
    """The least hash of _GRAM words in the ``n`` words from each position on."""
    gram = run_hashes(words, _GRAM) if len(words) >= n else np.empty(0, np.uint64)
    have, wide = 1, n - _GRAM + 1
    while have < wide:
        step = min(have, wide - have)
        gram = np.minimum(gram[: len(gram) - step], gram[step:])
        have += step
    return gram


class _Stretches:
    """The stretches of common windows of a block's documents, in the block's order."""

    def __init__(self, docs: pa.Table, keys: np.ndarray, n: int, shards: int):
        self.docs = docs
        self.texts: dict[bytes, int] = {}
        self.least: list[int] = []
        self.shard: list[int] = []
        self.places: list[tuple[int, int, int, int]] = []  # document, first window in it, windows, number of the text
        ids = docs.column("doc_id").to_pylist()
        counts = np.full(len(keys), 2)
        for low, _, words in parts(docs, n):
            at, hashes, text = words.runs()
            common = counts_of(hashes, keys, counts) > 1
            at, text = at[common], text[common]
            if not len(at):
                continue
            shard = (_minimisers(words.words, n)[at] % np.uint64(shards)).astype(np.int64)
            new = np.append(True, (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]) | (shard[1:] != shard[:-1]))
            begin = np.flatnonzero(new)
            place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            begin = np.flatnonzero(place % _LONGEST == 0)
            size = np.diff(np.append(begin, len(at)))
            data = words.data.tobytes()
            first, last = at[begin], at[begin] + size + n - 2
            s, e = words.starts[first].tolist(), words.ends[last].tolist()
            for i, (a, b, m, t, f, g) in enumerate(zip(s, e, size.tolist(), text[begin].tolist(), first.tolist(), shard[begin].tolist())):
                doc = ids[low + t]
                if doc is None:
                    continue
                own = b" ".join(data[a:b].split())
                number = self.texts.setdefault(own, len(self.texts))
                if number == len(self.least):
                    self.least.append(doc)
                    self.shard.append(g)
                self.least[number] = min(self.least[number], doc)
                self.places.append((low + t, f - int(words.first[t]), m, number))


def _lines(texts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(texts))


def _sent(n: int, shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names, kinds = ["shard", "block", "numbers", "least", "words"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if docs.num_rows and told.num_rows:
            block = docs.column("block")[0].as_py()
            found = _Stretches(ordered(docs), received(told)[0], n, shards)
            texts, least, shard = list(found.texts), np.array(found.least, np.int64), np.array(found.shard, np.int64)
            by = np.argsort(shard, kind="stable")
            cut = np.flatnonzero(np.append(True, shard[by][1:] != shard[by][:-1])) if len(by) else []
            for own in np.split(by, cut[1:]) if len(by) else []:
                rows.append((int(shard[own[0]]), block, pack_sorted(own), pack_planes(least[own].view(np.uint64)), _lines([texts[i] for i in own.tolist()])))
        columns = [list(c) for c in zip(*rows)] or [[] for _ in names]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _searched(n: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        which, least_of = [], []
        for raw, least in zip(table.column("words").to_pylist(), table.column("least").to_pylist()):
            lines = zstandard.ZstdDecompressor().decompress(raw).split(b"\n")
            which.append([number.setdefault(t, len(number)) for t in lines])
            least_of.append(unpack_planes(least).view(np.int64))
        texts = list(number)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        for w, x in zip(which, least_of):
            np.minimum.at(least, w, x)
        # Words to numbers, by their bytes: every word with the space behind it.
        data = b"".join(t + b" " for t in texts)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
        offsets = pa.py_buffer(np.append(0, ends).astype(np.int64).tobytes())
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(data)])
        symbols = words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        size = np.diff(np.append(0, np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]), "right")))
        flat = np.zeros(int(size.sum()) + len(texts), np.int64)
        flat[np.arange(len(symbols)) + np.repeat(np.arange(len(texts)), size)] = symbols
        index = FMIndex(flat, n)
        text_of = np.repeat(np.arange(len(texts)), size + 1)
        klass = index.classes(n)
        first = np.full(int(klass.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, klass, least[text_of[index.suffix]])
        answers = []
        for length, row in index.statistics(np.split(symbols, np.cumsum(size)[:-1]), n):
            m = len(length) - n + 1
            if (length[:m] < n).any():
                raise ValueError("a text does not match itself")
            answers.append(first[klass[row[:m]]])
        told = [pack_planes(np.concatenate([answers[i] for i in w]).view(np.uint64)) for w in which]
        return pa.Table.from_arrays([table.column("block"), table.column("numbers"), pa.array(told, pa.binary())], names=["block", "numbers", "firsts"])

    return run


def _kept(n: int, shards: int, carry: list[tuple[str, pa.DataType]]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    span = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        docs = ordered(docs)
        keys = told.filter(told.column("keys").is_valid())
        answers = told.filter(told.column("firsts").is_valid())
        ids = docs.column("doc_id").to_pylist()
        removed: dict[int, list[tuple[int, int]]] = {}
        if answers.num_rows:
            places = _Stretches(docs, received(keys)[0], n, shards).places
            size = np.zeros(1 + max((p[3] for p in places), default=0), np.int64)
            for _, _, m, number in places:
                size[number] = m
            firsts: dict[int, np.ndarray] = {}
            for numbers, raw in zip(answers.column("numbers").to_pylist(), answers.column("firsts").to_pylist()):
                own = unpack_sorted(numbers).astype(np.int64)
                firsts.update(zip(own.tolist(), np.split(unpack_planes(raw).view(np.int64), np.cumsum(size[own])[:-1])))
            for doc, at, m, number in places:
                for i in np.flatnonzero(firsts[number] < ids[doc]).tolist():
                    have = removed.setdefault(doc, [])
                    if have and have[-1][1] >= at + i:
                        have[-1] = (have[-1][0], at + i + n)
                    else:
                        have.append((at + i, at + i + n))
        empty = docs.column("was_null").to_pylist()
        rows: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "spans", "text", "kept_sha256")}
        for low, high, words in parts(docs, n):
            data = words.data.tobytes()
            for t in range(high - low):
                gone = removed.get(low + t, [])
                a, b = int(words.offsets[t]), int(words.offsets[t + 1])
                raw = data[a:b]
                left = raw.split()  # bytes are split at the same six characters
                total = len(left)
                for x, y in reversed(gone):
                    del left[x:y]
                joined = b" ".join(left)
                rows["n_words"].append(total)
                rows["n_removed"].append(total - len(left))
                rows["spans"].append([{"first": x, "words": y - x} for x, y in gone])
                rows["text"].append(None if empty[low + t] else (joined if gone else raw).decode())
                rows["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
        kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "spans": span, "text": pa.string(), "kept_sha256": pa.string()}
        return pa.Table.from_arrays([docs.column("doc_id"), *(pa.array(v, kinds[k]) for k, v in rows.items()), *(docs.column(c) for c, _ in carry)], names=["doc_id", *rows, *(c for c, _ in carry)])

    return run


def repeats(df: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), renamed: bool = True) -> DataFrame:
    """One row per document without the passages that a document with a smaller id holds too.

    Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. A window
    is ``n`` consecutive words of a document; every word of a window that also begins in a document with a smaller id
    goes. Columns: doc_id, n_words, n_removed, spans (first word and number of words of what goes), text (as it was
    where nothing goes, else the words left, joined by one space), kept_sha256 (of the words left, so joined), and the
    columns ``carry`` as they were.

    Null text counts as empty. Null ids are neither smaller nor larger than another: nothing goes, and nothing goes
    because of them. Rows with the same id do not take from each other. An empty table gives an empty result.
    """
    blocks, count, _ = in_blocks(df, id_col, text_col, carry)
    shards = count * SHARDS
    extra = [(f"c{i}", c) for i, c in enumerate(carry)]
    told = common_runs(blocks, count, n)
    by_block = lambda: blocks.groupBy("block")
    sent = by_block().cogroup(told.groupBy("block")).applyInArrow(_sent(n, shards), "shard int, block int, numbers binary, least binary, words binary")
    found = sent.groupBy("shard").applyInArrow(_searched(n), "block int, numbers binary, firsts binary")
    none = F.lit(None).cast("binary")
    both = told.select("block", "keys", "counts", none.alias("numbers"), none.alias("firsts")).union(found.select("block", none.alias("keys"), none.alias("counts"), "numbers", "firsts"))
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<first:int,words:int>>, text string, kept_sha256 string"
    schema += "".join(f", {c} {kinds[c]}" for c, _ in extra)
    out = by_block().cogroup(both.groupBy("block")).applyInArrow(_kept(n, shards, extra), schema)
    return out.withColumnsRenamed(dict(extra)) if extra and renamed else out

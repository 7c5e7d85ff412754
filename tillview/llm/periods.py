"""Stretches of words that repeat with a period, found by string synchronising sets.

A run is a stretch of consecutive words with smallest period q and at least 3 q words that no neighbouring word
extends. Periods under 8 are read off directly: words q apart are compared over the whole text. For every scale t = 4,
8, 16, ... periods from 2 t to 4 t come from a synchronising set: position i belongs to it when the least hash of the
t-word substrings that begin at i to i + t is that at i or at i + t, so that membership depends on nothing but the 2 t words
from i on. Substrings that have themselves a period of t / 3 or less, which the runs of earlier scales tell, are left out
of the minima; without that, the set would be dense there. Any first period of a run with smallest period 2 t or more
holds a member, and the member one period on has the same 2 t words behind it. Members less than 4 t apart with equal
words behind them therefore propose their distance as a period; each proposal is followed to both sides, word by word,
and counts when three periods are full. A multiple of the smallest period ends where that one does and goes.

Hashes of twice the length come from two of the length, so a scale costs a few passes over the words. Texts are handled
together, each closed by a symbol of its own; those too short for a scale drop out. Runs are checked against the words'
bytes; should two words share a hash, the text is done again with numbers in their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.llm.words import groups_of, mix, text_bytes, word_hashes, word_spans

LEAST = 24  # words of a reported run
_SMALL = 8  # periods under this are compared directly; twice the first scale
_CHUNK = 2 << 20  # bytes of text handled together
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_TURN = np.uint64(0x9E3779B97F4A7C15)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of substrings of ``2 * size`` words from those of ``size`` words."""
    if len(h) <= size:
        return np.empty(0, np.uint64)
    return mix(h[:-size] * _TURN + h[size:])


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive entries."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, h.dtype)
    rows = -(-len(h) // size)
    padded = np.full(rows * size, _NONE)
    padded[: len(h)] = h
    blocks = padded.reshape(rows, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])


def _direct(symbols: np.ndarray, q: int) -> np.ndarray:
    """Runs (start, end, period) of period ``q``, by comparing all words q apart."""
    same = np.flatnonzero(symbols[q:] == symbols[:-q])
    if len(same) < 2 * q:
        return np.empty((0, 3), np.int64)
    first = np.flatnonzero(np.append(True, np.diff(same) != 1))
    size = np.diff(np.append(first, len(same)))
    ok = size >= 2 * q
    start = same[first[ok]]
    return np.stack([start, start + size[ok] + q, np.full(len(start), q)], axis=1)


def _inside(runs: np.ndarray, size: int, period: int, n: int) -> np.ndarray:
    """Where substrings of ``size`` words begin that have a period of at most ``period``."""
    own = runs[(runs[:, 2] <= period) & (runs[:, 1] - runs[:, 0] >= size)]
    mark = np.zeros(n + 1, np.int32)
    low, high = own[:, 0], own[:, 1] - size + 1
    np.add.at(mark, np.minimum(low, n), 1)
    np.add.at(mark, np.minimum(high, n), -1)
    return np.cumsum(mark[:n]) > 0


def synchronising(h: np.ndarray, size: int, left_out: np.ndarray) -> np.ndarray:
    """Members of the synchronising set of scale ``size``; ``h`` holds the hashes of all substrings of so many words."""
    h = np.where(left_out, _NONE, np.minimum(h, _NONE - np.uint64(1)))
    least = _least(h, size + 1)
    return np.flatnonzero((least != _NONE) & ((least == h[: len(least)]) | (least == h[size : size + len(least)])))


def _proposals(members: np.ndarray, behind: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of members 2 to 4 scales apart that have the same words behind them."""
    at, apart = [], []
    some, k = np.arange(len(members)), 1
    while True:
        some = some[some + k < len(members)]
        d = members[some + k] - members[some]
        near = d < 4 * size
        some, d = some[near], d[near]
        if not len(some):
            break
        ok = (d >= 2 * size) & (behind[some] == behind[some + k])
        at.append(members[some[ok]])
        apart.append(d[ok])
        k += 1
    return (np.concatenate(at), np.concatenate(apart)) if at else (np.empty(0, np.int64), np.empty(0, np.int64))


def _reach(symbols: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The stretch of positions around ``at`` whose word equals that ``q`` further on."""
    high, step, end = at, 64, len(symbols) - q
    while high < end:
        to = min(end, high + step)
        other = symbols[high:to] != symbols[high + q : to + q]
        if other.any():
            high += int(other.argmax())
            break
        high, step = to, min(2 * step, 1 << 16)
    low, step = at, 64
    while low > 0:
        to = max(0, low - step)
        other = (symbols[to:low] != symbols[to + q : low + q])[::-1]
        if other.any():
            low -= int(other.argmax())
            break
        low, step = to, min(2 * step, 1 << 16)
    return low, high


def _followed(symbols: np.ndarray, at: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Runs among the proposals. Proposals of one period within a stretch are followed once."""
    found = []
    order = np.lexsort((at, apart))
    at, apart = at[order], apart[order]
    cut = np.append(np.flatnonzero(np.append(True, apart[1:] != apart[:-1])), len(apart)) if len(apart) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        q, own = int(apart[a]), at[a:b]
        i = 0
        while i < len(own):
            low, high = _reach(symbols, int(own[i]), q)
            if high - low >= 2 * q:
                found.append((low, high + q, q))
            i = max(i + 1, int(np.searchsorted(own, high)))
    return np.array(found, np.int64).reshape(-1, 3)


def find(symbols: np.ndarray, longest_first: np.ndarray) -> np.ndarray:
    """All runs of three periods and more: (start, end, period), sorted.

    ``symbols``: texts one after the other, the longest first, each closed by a symbol that occurs nowhere else.
    ``longest_first``: the number of words of each text.
    """
    ends = np.cumsum(longest_first + 1)
    runs = [_direct(symbols, q) for q in range(1, _SMALL) if q < len(symbols)]
    size, h = 1, symbols
    while size < _SMALL // 2:
        h, size = _doubled(h, size), 2 * size
    while True:
        texts = int(np.searchsorted(-longest_first, -6 * size, "right"))  # those that can hold three periods of this scale
        if not texts:
            break
        n = int(ends[texts - 1])
        h = h[: n - size + 1]
        twice = _doubled(h, size)
        members = synchronising(h, size, _inside(np.concatenate(runs), size, size // 3, len(h)))
        runs.append(_followed(symbols[:n], *_proposals(members, twice[members], size)))
        h, size = twice, 2 * size
    every = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    new = np.append(True, (every[1:, :2] != every[:-1, :2]).any(axis=1)) if len(every) else np.empty(0, bool)
    return every[new]


def _closed(words: np.ndarray, first: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in ``order``, each closed by a symbol of its own (even; words are odd), and where each begins."""
    count = np.diff(first)[order]
    begin = np.append(0, np.cumsum(count + 1))
    symbols = np.empty(int(begin[-1]), np.uint64)
    from_ = np.repeat(first[:-1][order] - begin[:-1], count + 1) + np.arange(len(symbols))
    if len(words):
        symbols[:] = words[np.minimum(from_, len(words) - 1)] | np.uint64(1)
    symbols[begin[1:] - 1] = mix(np.arange(len(order))) << np.uint64(1)
    return symbols, begin


def _runs_of(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each text its runs (start, end, period) in order of start and period."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    symbols, begin = _closed(words, first, order)
    runs = find(symbols, count[order])
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    text = np.searchsorted(begin, runs[:, 0], "right") - 1
    out: list[np.ndarray] = [np.empty((0, 3), np.int64)] * len(count)
    cut = np.searchsorted(text, np.arange(len(order) + 1))
    for t in np.unique(text).tolist():
        own = runs[cut[t] : cut[t + 1]].copy()
        own[:, :2] -= begin[t]
        out[int(order[t])] = own
    return out


def _by_number(words: list[bytes]) -> np.ndarray:
    """Runs of one text with words as numbers, which differ where the words do."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    return _runs_of(mix(ids << np.uint64(1)), np.array([0, len(ids)]))[0]


def _hold(words: list[bytes], runs: np.ndarray) -> bool:
    return all(words[a : b - q] == words[a + q : b] for a, b, q in runs.tolist())


def _searched(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for low, high in groups_of(offsets, _CHUNK):
                own = offsets[low : high + 1]
                some, at = data[own[0] : own[-1]], own - own[0]
                starts, ends, first = word_spans(some, at)
                found = _runs_of(word_hashes(some, starts, ends), first)
                raw = some.tobytes()
                counts, lists, left = [], [], []
                for t, runs in enumerate(found):
                    words = raw[at[t] : at[t + 1]].split()  # bytes are split at the same six characters
                    if len(runs) and not _hold(words, runs):
                        runs = _by_number(words)
                    runs = runs[runs[:, 1] - runs[:, 0] >= least]
                    counts.append(len(words))
                    lists.append([{"start": a, "length": b - a, "period": q} for a, b, q in runs.tolist()])
                    if len(runs):
                        keep = np.zeros(len(words) + 1, np.int64)
                        np.add.at(keep, runs[:, 0] + runs[:, 2], 1)
                        np.add.at(keep, runs[:, 1], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(keep[:-1]) == 0).tolist()]
                    left.append(b" ".join(words))
                columns = [batch.column("doc_id").slice(low, high - low), pa.array(counts, pa.int64()), pa.array(lists, _RUNS), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(df: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs, collapsed.

    Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. ``runs`` holds
    every run of at least three periods and ``least`` words (start as a word number from 0, length and smallest period in
    words), by start, then period. ``collapsed`` is the text without the words that lie in a run behind its
    first period, the rest joined by one space.

    A null or empty text has no words, no runs and an empty collapsed text. Rows with the same id, null ids included, are
    separate documents. An empty table gives an empty result; other columns are not looked at. A text is handled by one
    task with some twenty numbers a word.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_searched(least), "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def stuttering(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) where documents chosen by their id repeat a part of theirs to the end.

    With h the CRC-32 of the id in decimal, g = h div 10 and n words: where h mod 10 is 0 and n > 0, each word from
    a = g mod n on becomes word a + (i - a) mod p of the text as it was, p = 1 + (n - a) div (3 + g mod 8); words are
    then joined by one space. All other texts, and those of null ids, stay as they are.
    """
    doc, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    h = F.crc32(doc.cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.filter(F.split(F.when(chosen, text), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    rows = df.select(doc.alias("doc_id"), text.alias("text"), words.alias("words"), F.floor(h / F.lit(10)).cast("long").alias("g"))
    n = F.size("words").cast("long")
    a = F.when(n > 0, F.col("g") % F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8)).cast("long")
    unit = F.slice("words", (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    spun = F.array_join(F.concat(F.slice("words", F.lit(1), a.cast("int")), tail), " ")
    return rows.select("doc_id", F.when(F.size("words") > 0, spun).otherwise(F.col("text")).alias("text"))


def _strongest(runs: str) -> Column:
    """The run of the greatest length / period, compared without rounding; the first of several."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of runs and collapsed text, from the rows of periodic_runs."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), _strongest("runs").alias("best"), F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.expr("1000L * best.length div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

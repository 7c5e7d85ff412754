"""Benchmark passages in documents: a prefix-filtered join of item windows with document windows.

Items are cut into windows of ``window`` consecutive words (an item of fewer words is one window). A window is the
set of its shingles with their places. One scan counts how often each shingle of the items occurs over all documents; the
shingles of a window are put in order of rarity, and only the prefix that a match cannot do without is joined: of
m shingles of which c must be there, the m - c + 1 rarest. A second scan meets these prefixes in the documents. The
place of a shingle in its window says where the document's window would begin and end; what would not lie within the
document is dropped, the rest is compared over a document window of the item window's own size, first by word hashes
and then word by word.

No document is shuffled. Items are broadcast in blocks of a fixed number of bytes, each block with its own two scans
over the documents. Equal windows of a block are one, however many items hold them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.llm.words import groups_of, run_hashes, runs_inside, text_bytes, word_hashes, word_spans
from tillview.session import stage

WINDOW = 10
SHINGLE = 5  # words of a shingle; a shorter window is one shingle
BLOCK_BYTES = 4 << 20  # item text broadcast at a time
PIECE = 1 << 16  # words of an item handled as one text; pieces overlap by a window less a word
CHUNK = 2 << 20

# Words are 0-9, a-z and all that is not ASCII, after A-Z are lower-cased.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SPACED = bytes(0x20 if _BETWEEN[_LOWER[i]] else int(_LOWER[i]) for i in range(256))

_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))


def split(raw: bytes) -> list[bytes]:
    """The words of one text."""
    return raw.translate(_SPACED).split()


class Words:
    """Word hashes of some texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = _LOWER[data], offsets
        self.starts, self.ends, self.first = word_spans(self.data, offsets, _BETWEEN)
        self.hashes = word_hashes(self.data, self.starts, self.ends)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each ``k`` consecutive words of a text."""
        at = runs_inside(self.first, k)
        return at, run_hashes(self.hashes, k)[at] if len(at) else np.empty(0, np.uint64)


def _parts(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_bytes(column)
    for low, high in groups_of(offsets, CHUNK):
        own = offsets[low : high + 1]
        yield low, high, Words(data[own[0] : own[-1]], own - own[0])


class Keys:
    """Places of hashes in a sorted array; most of those that are not there are told by one bit."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = min(26, max(12, len(keys).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[keys >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are there, and where."""
        maybe = np.flatnonzero(self.seen[hashes >> self.shift])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == hashes[maybe]
        return maybe[ok], at[ok]


@dataclass
class Block:
    """Windows of some items. Each distinct window once: where it begins among all words, its length, who holds it."""

    ids: list[list[str]]
    texts: list[bytes] = field(default_factory=list)  # of the windows, words joined by one space
    begin: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    length: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    hashes: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    holders: list[set[int]] = field(default_factory=list)
    keys: dict[int, np.ndarray] = field(default_factory=dict)  # by words of a shingle: its sorted hashes
    place: dict[int, np.ndarray] = field(default_factory=dict)  # by words of a shingle: place in keys by first word

    @staticmethod
    def of(pieces: list[bytes], ids: list[list[str]], window: int, k: int) -> Block:
        own = Block(ids)
        offsets = np.append(0, np.cumsum([len(p) for p in pieces])).astype(np.int64)
        data = b"".join(pieces)
        words = Words(np.frombuffer(data, np.uint8), offsets)
        starts, ends, number = words.starts.tolist(), words.ends.tolist(), {}
        begin, length = [], []
        for piece, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            size = min(window, b - a)
            for s in range(a, b - size + 1) if size else ():
                at = number.setdefault(data[starts[s] : ends[s + size - 1]], len(number))
                if at == len(begin):
                    begin.append(s)
                    length.append(size)
                    own.holders.append(set())
                own.holders[at].add(piece)
        own.texts = list(number)
        own.begin, own.length, own.hashes = np.array(begin, np.int64), np.array(length, np.int64), words.hashes
        for size in sorted({min(k, n) for n in length}):
            at, hashes = words.shingles(size)
            own.keys[size] = np.unique(hashes)
            own.place[size] = np.full(len(words.hashes), -1)
            own.place[size][at] = np.searchsorted(own.keys[size], hashes)
        return own


@dataclass
class Prefixes:
    """The rarest shingles of the windows, by words of a shingle: sorted hashes, and for each its windows and places in them."""

    keys: dict[int, np.ndarray]
    cut: dict[int, np.ndarray]
    window: dict[int, np.ndarray]
    place: dict[int, np.ndarray]


def needed(length: int, k: int, least: float) -> int:
    """How many of a window's shingles a document's window must hold."""
    return max(1, math.ceil(round(least * (length - min(k, length) + 1), 9)))


def prefixes(block: Block, counts: dict[int, np.ndarray], k: int, least: float) -> Prefixes:
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {size: [] for size in block.keys}
    for length in np.unique(block.length).tolist():
        size = min(k, length)
        m = length - size + 1
        some = np.flatnonzero(block.length == length)
        place = block.place[size][block.begin[some][:, None] + np.arange(m)]
        often = counts[size][place]
        rarest = np.argsort(often, axis=1, kind="stable")[:, : m - needed(length, k, least) + 1]
        row = np.repeat(some, rarest.shape[1])
        which = np.take_along_axis(place, rarest, 1).ravel()
        occurs = np.take_along_axis(often, rarest, 1).ravel() > 0
        found[size].append((which[occurs], row[occurs], rarest.ravel()[occurs]))
    out = Prefixes({}, {}, {}, {})
    for size, parts in found.items():
        which, window, place = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(which, kind="stable")
        distinct, first = np.unique(which[order], return_index=True)
        out.keys[size], out.cut[size] = block.keys[size][distinct], np.append(first, len(order))
        out.window[size], out.place[size] = window[order], place[order]
    return out


def _counted(sent, text_col: str):
    """(size, place, n): how often each shingle of the items occurs in the documents a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = {size: Keys(k) for size, k in sent.value.items()}
        total = {size: np.zeros(len(k.keys), np.int64) for size, k in keys.items()}
        for batch in batches:
            for _, _, words in _parts(batch.column(text_col)):
                for size, own in keys.items():
                    _, at = own.find(words.shingles(size)[1])
                    total[size] += np.bincount(at, minlength=len(own.keys))
        for size, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(at.astype(np.int64)), pa.array(n[at])], names=["size", "place", "n"])

    return run


class _Search:
    def __init__(self, block: Block, front: Prefixes, k: int, least: float):
        self.block, self.front, self.k, self.least = block, front, k, least
        self.keys = {size: Keys(v) for size, v in front.keys.items() if len(v)}

    def candidates(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and item window of all document windows that share a prefix shingle at its place."""
        begins, windows = [], []
        for size, keys in self.keys.items():
            at, hashes = words.shingles(size)
            which, key = keys.find(hashes)
            low = self.front.cut[size][key]
            n = self.front.cut[size][key + 1] - low
            entry = np.arange(n.sum()) + np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) if len(n) else np.empty(0, np.int64)
            window = self.front.window[size][entry]
            place = np.repeat(at[which], n)
            begin = place - self.front.place[size][entry]
            text = np.searchsorted(words.first, place, "right") - 1
            inside = (begin >= words.first[text]) & (begin + self.block.length[window] <= words.first[text + 1])
            begins.append(begin[inside])
            windows.append(window[inside])
        if not begins:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.stack([np.concatenate(begins), np.concatenate(windows)]), axis=1)
        return both[0], both[1]

    def alike(self, words: Words, begin: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Which candidates hold enough of the window's shingles, by word hashes."""
        ok = np.zeros(len(begin), bool)
        for length in np.unique(self.block.length[window]).tolist():
            some = np.flatnonzero(self.block.length[window] == length)
            size, need = min(self.k, length), needed(length, self.k, self.least)
            for low in range(0, len(some), 1 << 16):
                own = some[low : low + (1 << 16)]
                same = words.hashes[begin[own][:, None] + np.arange(length)] == self.block.hashes[self.block.begin[window[own]][:, None] + np.arange(length)]
                held = np.ones((len(own), length - size + 1), bool)
                for j in range(size):
                    held &= same[:, j : j + length - size + 1]
                ok[own] = held.sum(1) >= need
        return ok

    def exact(self, own: list[bytes], at: int, window: int) -> bool:
        """The same for one candidate, by the words themselves."""
        text = self.block.texts[window]
        length = int(self.block.length[window])
        mine = own[at : at + length]
        if b" ".join(mine) == text:
            return True
        if self.least >= 1:
            return False
        same = [a == b for a, b in zip(mine, text.split(b" "))]
        size = min(self.k, length)
        return sum(all(same[j : j + size]) for j in range(length - size + 1)) >= needed(length, self.k, self.least)


def _found(sent, text_col: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(*sent.value)
        for batch in batches:
            counts, spans, items = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for low, high, words in _parts(batch.column(text_col)):
                counts[low:high] = np.diff(words.first)
                begin, window = search.candidates(words)
                ok = search.alike(words, begin, window)
                begin, window = begin[ok], window[ok]
                text = np.searchsorted(words.first, begin, "right") - 1
                for t in np.unique(text).tolist():
                    mine = np.flatnonzero(text == t) if len(text) < 64 else np.arange(*np.searchsorted(text, [t, t + 1]))
                    own = split(words.data[words.offsets[t] : words.offsets[t + 1]].tobytes())
                    hit, held, before = spans[low + t], set(), int(words.first[t])
                    for at, w in zip((begin[mine] - before).tolist(), window[mine].tolist()):
                        if not search.exact(own, at, w):
                            continue
                        held.update(search.block.holders[w])
                        end = at + int(search.block.length[w])
                        if hit and hit[-1]["first"] + hit[-1]["words"] >= at:
                            hit[-1]["words"] = max(hit[-1]["words"], end - hit[-1]["first"])
                        else:
                            hit.append({"first": at, "words": end - at})
                    items[low + t] = sorted({i for piece in held for i in search.block.ids[piece]})
            columns = [*(batch.column(c) for c in keep), pa.array(counts), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "spans", "items"])

    return run


def _pieces(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(PIECE, 2 * window) - window + 1
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = split((text or "").encode())
                for at in range(0, len(words), step):
                    if at == 0 or at + window <= len(words):
                        ids.append(item)
                        texts.append(b" ".join(words[at : at + step + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], names=["item", "words"])

    return run


def _merged(spans):
    """Spans in order of their first word, those that touch as one."""
    none = F.array().cast("array<struct<first:int,words:int>>")
    end = lambda s: s["first"] + s["words"]

    def add(done, s):
        last = F.element_at(done, -1)
        longer = F.named_struct(F.lit("first"), last["first"], F.lit("words"), F.greatest(end(last), end(s)) - last["first"])
        touches = (F.size(done) > 0) & (end(F.try_element_at(done, F.lit(-1))) >= s["first"])
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.sort_array(spans), none, add)


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = SHINGLE, least: float = 1.0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, spans of words inside an item's window, and the items so found.

    ``least`` is the share of an item window's ``k``-word shingles that must stand at their places in a document's window of
    as many words; at 1 the windows are equal word for word. Spans (first word, number of words) do not touch.
    ``items`` holds the distinct ids, as strings, in order.

    A null or empty text has no words and no spans; an item without words is never found. A null item id counts as
    the empty string; rows with one item id are one item. Every document row has its own result row, repeated and null ids included. With
    an empty table of items nothing is found; without documents the result is empty. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    named = items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    pieces = named.mapInArrow(_pieces(window), "item string, words binary")
    pieces = stage(pieces.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("ids")))
    size = pieces.agg(F.sum(F.octet_length("words") + F.aggregate("ids", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s)))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()))
    found = None
    for b in range(blocks):
        some = pieces.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).toArrow()
        block = Block.of(some.column("words").to_pylist(), some.column("ids").to_pylist(), window, k)
        keys = spark.sparkContext.broadcast(block.keys)
        often = rows.select("text").mapInArrow(_counted(keys, "text"), "size int, place long, n long").groupBy("size", "place").agg(F.sum("n").alias("n")).toArrow()
        counts = {s: np.zeros(len(v), np.int64) for s, v in block.keys.items()}
        for s, own in counts.items():
            mine = often.filter(pc.equal(often.column("size"), s))
            own[mine.column("place").to_numpy()] = mine.column("n").to_numpy()
        sent = spark.sparkContext.broadcast((block, prefixes(block, counts, k, least), k, least))
        keep = ["doc_id"] if blocks == 1 else ["doc_id", "row"]
        schema = "".join(f"{c} long, " for c in keep) + "n_words long, spans array<struct<first:int,words:int>>, items array<string>"
        own = rows.select(*keep, "text").mapInArrow(_found(sent, "text", keep), schema)
        if blocks == 1:
            return own
        own = stage(own if found is None else own.where(F.size("spans") > 0))
        found = own if found is None else found.union(own)
    together = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return together.select("doc_id", "n_words", _merged("spans").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated from the rows of overlaps."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id::VARCHAR AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    v AS (SELECT DISTINCT i, n, array_to_string(w[s : s + n - 1], ' ') AS t
          FROM (SELECT i, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
    p AS (SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS t
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN (SELECT DISTINCT n FROM v) ON len(w) >= n)),
    h AS (SELECT r, s, n, i FROM p JOIN v USING (n, t)),
    x AS (SELECT r, count(DISTINCT u) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS u FROM h) GROUP BY r),
    y AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, i FROM h) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r)"""

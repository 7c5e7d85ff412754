"""Token ids in files of independently coded blocks.

Each block is coded by a range coder from an empty model: the distributions of the ids so far, of those that have followed the id
before (order 1) and of those that have followed the two before (order 2), mixed with weights that follow how often each held the
next id, by how often its context had been seen. An id has its interval in the highest order that has seen it, one never seen has
its share of the vocabulary. The model learns at set places, each about twice as far as the last, from all of the block so far: the
ids' places in the order of the three ids from there on hold all three distributions as runs. Many blocks are coded side by side as
lanes of numpy arrays; all arithmetic is on integers, so any machine decodes what another has written.

A file is a sequence of sections. A section holds whole documents: their ids and lengths, then the blocks, each
with its length, size and the crc32 of its ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillview.llm.bpe import encoder, slices
from tillview.llm.warc import _open
from tillview.session import shared_dir, stage

BLOCK, LANES = 2048, 4096
_MAGIC = b"TKRC0002"
_WORD, _UPPER, _LAST = np.uint64(16), np.uint64(48), np.uint64((1 << 16) - 1)
_HALF, _LOWER = np.uint32(16), np.uint32(0xFFFF)
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_MOST = 1 << 15  # ids after which a longer block begins with an empty model again
_SIDE, _CELLS = 4096, 1 << 23  # blocks, and ids, that are coded side by side
_TEXT = 8 << 20  # bytes of text that are encoded at a time
_FEW = 64  # blocks that are put in order at a time
# Where a block's model is brought up to what has been seen.
_POINTS = tuple(1 << i for i in range(5, 15))
_SEEN = np.minimum(np.arange(_MOST + 1), 3).astype(np.uint8)
# Counts of ids held by orders 2, 1, 0 and none to begin with, by class: 4 * (times the two ids before were seen, 3 at most) + (times the one before was).
_PRIOR = np.array(
    [(0, 0, 32, 28), (0, 6, 37, 17), (0, 7, 38, 15), (0, 17, 33, 10), (23, 0, 16, 21), (11, 1, 36, 13), (11, 2, 36, 11), (7, 15, 31, 7)]
    + [(20, 0, 25, 15), (40, 1, 16, 4), (16, 1, 30, 14), (13, 14, 27, 7), (30, 0, 20, 10), (30, 2, 20, 8), (24, 1, 26, 10), (29, 4, 18, 9)],
    np.int64,
)


class _Coder:
    """State of the range coder for some blocks side by side."""

    def __init__(self, n: int):
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
        self.used = np.zeros(n, np.int64)  # 16-bit words written or read

    def settled(self, which: np.ndarray | slice) -> np.ndarray:
        """Lanes whose upper 16 bits are known; a range that has become too small is cut until they are."""
        low, span = self.low[which], self.range[which]
        same = (low ^ (low + span)) < _TOP
        small = span < _BOTTOM
        if small.any():
            small &= ~same
            self.range[which] = np.where(small, (np.uint64(0) - low) & (_BOTTOM - np.uint64(1)), span)
            same |= small
        found = np.flatnonzero(same)
        return found if isinstance(which, slice) else which[found]

    def shift(self, which: np.ndarray) -> None:
        self.low[which] <<= _WORD
        self.range[which] <<= _WORD
        self.used[which] += 1


class _Writer(_Coder):
    def __init__(self, n: int):
        super().__init__(n)
        self.out = np.empty((n, 256), "<u2")

    def put(self, k: int, start: np.ndarray, width: np.ndarray, unit: np.ndarray) -> None:
        """Narrow the first k lanes to ``width`` units from ``start`` on."""
        self.low[:k] += unit * start
        self.range[:k] = unit * width

    def flush(self, k: int) -> None:
        if int(self.used.max()) + 12 > self.out.shape[1]:
            self.out = np.concatenate([self.out, np.empty_like(self.out)], axis=1)
        which = self.settled(slice(k))
        while len(which):
            self.out[which, self.used[which]] = self.low[which] >> _UPPER
            self.shift(which)
            which = self.settled(which)

    def done(self) -> list[bytes]:
        self.flush(len(self.low))
        lane = np.arange(len(self.low))
        for _ in range(4):
            self.out[lane, self.used] = self.low >> _UPPER
            self.shift(lane)
        return [row[:n].tobytes() for row, n in zip(self.out, self.used.tolist())]


class _Reader(_Coder):
    def __init__(self, coded: list[bytes]):
        super().__init__(len(coded))
        self.width = max(map(len, coded)) // 2 + 8
        data = np.zeros((len(coded), self.width), "<u2")
        for row, raw in zip(data, coded):
            row[: len(raw) // 2] = np.frombuffer(raw, "<u2")
        self.data, self.first = data.ravel(), np.arange(len(coded)) * self.width
        self.code = np.zeros(len(coded), np.uint64)
        for i in range(4):
            self.code = (self.code << _WORD) | data[:, i].astype(np.uint64)
        self.used += 4

    def fill(self) -> None:
        which = self.settled(slice(None))
        while len(which):
            at = self.first[which] + np.minimum(self.used[which], self.width - 1)  # damaged blocks may want more
            self.code[which] = (self.code[which] << _WORD) | self.data[at].astype(np.uint64)
            self.shift(which)
            which = self.settled(which)


def _runs(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and at last end, and the run of each place; rows of ``width`` are apart."""
    new = np.empty(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    new[::width] = True
    edges = np.empty(np.count_nonzero(new) + 1, np.int32)
    edges[:-1], edges[-1] = np.flatnonzero(new), len(keys)
    run = np.cumsum(new, dtype=np.int64)
    run -= 1
    return edges, run


def _ordered(x: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Places of each row of ids in the order of the three ids from there on, and the runs of equal one, two and three ids."""
    n, width = x.shape
    bits = np.uint64(width.bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(width, dtype=np.uint64)
    keys = x.astype(np.uint64)
    keys <<= bits
    keys |= place
    keys.sort(axis=1)
    new = np.ones((n, width), bool)
    np.not_equal(keys[:, 1:] >> bits, keys[:, :-1] >> bits, out=new[:, 1:])
    keys &= mask
    keys += (np.arange(n) * (width + 2)).astype(np.uint64)[:, None]
    name = np.zeros((n, width + 2), np.uint64)  # of each id its number among those of the row, from 1; 0 is the end
    name.ravel()[keys.view(np.int64).ravel()] = np.cumsum(new, axis=1, dtype=np.uint64).ravel()
    np.left_shift(name[:, :-2], bits, out=keys)
    keys |= name[:, 1:-1]
    keys <<= bits
    keys |= name[:, 2:]
    keys <<= bits
    keys |= place
    keys.sort(axis=1)
    places = (keys & mask).view(np.int64)
    flat, runs = keys.ravel(), []
    for _ in range(3):
        flat >>= bits
        runs.append(_runs(flat, width))
    return places, runs[::-1]


def _segments(length: int) -> list[tuple[int, int]]:
    """Stretches of a block over which its model stays as it is."""
    cuts = [0, *(p for p in _POINTS if p < length), length]
    return list(zip(cuts, cuts[1:]))


class _Mix:
    """Weights of orders 2, 1 and 0 and of an unseen id, by how often both contexts have been seen, for each lane."""

    def __init__(self, n: int):
        self.counts = np.tile(_PRIOR, (n, 1, 1))

    def learn(self, cells: np.ndarray) -> None:
        """Cells: rows of 4 * class + what held the id, a column for each lane."""
        n = cells.shape[1]
        at = cells.astype(np.int32)
        at += np.arange(0, 64 * n, 64, dtype=np.int32)
        self.counts += np.bincount(at.ravel(), minlength=64 * n).reshape(n, 16, 4)

    def packed(self) -> np.ndarray:
        """Upper bounds of the first three weights, 16 bits each from bit 16 on; all four add up to 2**16."""
        share = np.where(_PRIOR > 0, self.counts * ((1 << 16) - 64) // self.counts.sum(axis=2, keepdims=True) + 16, 0)
        up = np.cumsum(share[:, :, :3], axis=2).astype(np.uint64)
        return (up[:, :, 0] << np.uint64(16) | up[:, :, 1] << np.uint64(32) | up[:, :, 2] << np.uint64(48)).ravel()


def _bounds(packed: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and width of the weight of each lane's ``which``."""
    moved = packed >> (which << 4)
    start = moved & _LAST
    return start, ((((moved >> _WORD) - np.uint64(1)) & _LAST) + np.uint64(1)) - start


def encode_blocks(ids: np.ndarray, size: int, block: int = BLOCK) -> list[bytes]:
    """The coded blocks of ``block`` ids each (the last may be shorter); ids are less than ``size``."""
    side = max(1, min(_SIDE, _CELLS // min(block, _MOST))) * block
    return [raw for at in range(0, len(ids), side) for raw in _encode(ids[at : at + side], size, block)]


def _encode(ids: np.ndarray, size: int, block: int) -> list[bytes]:
    n = -(-len(ids) // block)
    last = len(ids) - (n - 1) * block
    grid = np.zeros(n * block, np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(n, block)[:, : min(block, len(ids))]
    coder = _Writer(n)
    for at in range(0, grid.shape[1], _MOST):
        _encode_part(coder, np.ascontiguousarray(grid[:, at : at + _MOST]), size, last - at)
    return coder.done()


def _encode_part(coder: _Writer, x: np.ndarray, size: int, last: int) -> None:
    n, width = x.shape
    plan = np.empty((5, width, n), np.uint16)
    new = np.empty((width, n), bool)
    for at in range(0, n, _FEW):
        _plan(x[at : at + _FEW], plan[:, :, at : at + _FEW], new[:, at : at + _FEW])
    for t in range(width):
        k = n if t < last else n - 1
        begins, wide, start, many, total = plan[:, t, :k].astype(np.uint64)
        wide += np.uint64(1)
        coder.put(k, begins, wide, coder.range[:k] >> _WORD)
        if size > 1 << 16:
            coder.flush(k)
        unseen = np.flatnonzero(new[t, :k])
        total[unseen], start[unseen] = size, x[unseen, t]
        coder.put(k, start, many, coder.range[:k] // total)
        coder.flush(k)


def _plan(x: np.ndarray, plan: np.ndarray, new: np.ndarray) -> None:
    """For each id the start and the width less 1 of the weight of what holds it, its first slot there, its slots and all slots; whether nothing holds it."""
    n, width = x.shape
    places, runs = _ordered(x)
    to = (places * n + np.arange(n)[:, None]).ravel()
    by_place = np.empty((3, width * n), np.int64)  # bounds of the runs of one, two and three ids from each place on, rows are places
    for (edges, run), bounds in zip(runs, by_place):
        bounds[to] = np.stack([edges[:-1], edges[1:]], axis=1).view(np.int64).ravel().take(run)
    by_place = by_place.view(np.int32).reshape(3, width, n, 2)
    flat = places.astype(np.uint16).ravel()
    lane16 = np.arange(0, 16 * n, 16)
    before = np.zeros(n * width + 1, np.int32)
    mix = _Mix(n)
    for begin, end in _segments(width):
        part, past = plan[:, begin:end], max(begin - 2, 0)
        if past:
            np.cumsum(flat < np.uint16(past), dtype=np.int32, out=before[1:])
            # in the past of each place: bounds of the id, of it with the one before, of it with the two before
            (low, high), (low1, high1), (low2, high2) = ([before.take(by_place[k, begin - k : end - k, :, side]) for side in (0, 1)] for k in range(3))
            first1, first2, n1, n2 = (np.zeros((end - begin, n), np.int32) for _ in range(4))
            first1[1:], first2[2:] = low[:-1], low1[1:-1]
            np.subtract(high[:-1], low[:-1], out=n1[1:])
            np.subtract(high1[1:-1], low1[1:-1], out=n2[2:])
            in2, in1, in0 = high2 > low2, high1 > low1, high > low
            in2[:2] = in1[:1] = False
            which = np.where(in2, np.uint8(0), np.where(in1, np.uint8(1), np.where(in0, np.uint8(2), np.uint8(3))))
            cells = (_SEEN.take(n2) << 2) + _SEEN.take(n1)
            high = np.where(in2, high2 - low2, np.where(in1, high1 - low1, np.where(in0, high - low, 1)))
            low = np.where(in2, low2 - first2, np.where(in1, low1 - first1, low - np.arange(0, past * n, past, dtype=np.int32)))
            total = np.where(in2, n2, np.where(in1, n1, np.int32(past)))
            packed = mix.packed().take(lane16 + cells)
            start, wide = _bounds(packed, which)
            part[0], part[1], part[2], part[3], part[4], new[begin:end] = start, wide - np.uint64(1), low, high, total, which == 3
            mix.learn((cells << 2) + which)
        else:
            part[0], part[1], part[2], part[3], part[4], new[begin:end] = 0, _LAST, 0, 1, 1, True


def decode_blocks(coded: list[bytes], lengths: list[int], size: int) -> np.ndarray:
    """The ids of the blocks one after the other; all but the last have the same length."""
    if not coded:
        return np.empty(0, np.uint32)
    side = max(1, min(_SIDE, _CELLS // min(lengths[0], _MOST)))
    return np.concatenate([_decode(coded[at : at + side], lengths[at : at + side], size) for at in range(0, len(coded), side)])


def _decode(coded: list[bytes], lengths: list[int], size: int) -> np.ndarray:
    grid = np.zeros((lengths[0], len(coded)), np.uint32)
    coder = _Reader(coded)
    for at in range(0, len(grid), _MOST):
        _decode_part(coder, grid[at : at + _MOST], size)
    return np.concatenate([grid[:-1, :0].ravel(), *([grid[:, :-1].T.ravel()] if len(coded) > 1 else []), grid[: lengths[-1], -1]])


def _past(x: np.ndarray, slots: np.ndarray) -> None:
    """What may follow, for orders 2, 1 and 0: into rows of lanes of slots.

    A slot has the bounds of its id within the order, those of the id as the next context, those of the next context
    of two ids (16 bits a bound), and its id.
    """
    n, width = x.shape
    places, runs = _ordered(x)
    kept = (places < width - 2).ravel()
    before = np.zeros(n * width + 1, np.int32)
    np.cumsum(kept, dtype=np.int32, out=before[1:])
    bounds = []
    for edges, run in runs:
        at = before.take(edges)
        base = edges[:-1] // np.int32(width) * np.int32(width - 2)
        both = (at[1:] - base).view(np.uint32)
        both <<= _HALF
        both |= (at[:-1] - base).view(np.uint32)
        bounds.append(both.take(run))
    at = (places + np.arange(0, n * width, width)[:, None]).ravel()
    one, two = np.empty(n * width, np.uint32), np.empty(n * width, np.uint32)
    one[at], two[at] = bounds[0], bounds[1]
    kept = np.flatnonzero(kept)
    at = at.take(kept)
    ids = x.ravel()
    shape = slots.shape[1:3]
    for order, own in enumerate(bounds):
        slots[2 - order, :, :, 0] = own.take(kept).reshape(shape)
    slots[2, :, :, 1], slots[2, :, :, 2], slots[2, :, :, 3] = slots[2, :, :, 0], 0, ids.take(at).reshape(shape)
    at += 1
    slots[1, :, :, 1], slots[1, :, :, 2], slots[1, :, :, 3] = one.take(at).reshape(shape), slots[1, :, :, 0], ids.take(at).reshape(shape)
    slots[0, :, :, 2] = two.take(at).reshape(shape)
    at += 1
    slots[0, :, :, 1], slots[0, :, :, 3] = one.take(at).reshape(shape), ids.take(at).reshape(shape)


def _decode_part(coder: _Reader, grid: np.ndarray, size: int) -> None:
    width, n = grid.shape
    lane = np.arange(n)
    lane16, mix = lane * 16, _Mix(n)
    for begin, end in _segments(width):
        past = max(begin - 2, 0)
        up = mix.packed() if past else np.zeros(16 * n, np.uint64)
        slots = np.empty((3, n, max(past, 1), 4), np.uint32)
        if past:
            few = max(_FEW, _FEW * 1024 // begin)
            for at in range(0, n, few):
                _past(np.ascontiguousarray(grid[:begin, at : at + few].T), slots[:, at : at + few])
        found = slots.reshape(-1).view(np.complex128)  # sixteen bytes each
        lane_at, order = lane * past, n * past
        first, total = np.zeros((4, n), np.int64), np.zeros((4, n), np.int64)  # of the slots of each order in its context
        total[2], total[3] = past, size
        cells = np.empty((end - begin, n), np.uint8)
        for t in range(begin, end):
            cell = (_SEEN.take(total[0]) << 2) + _SEEN.take(total[1])
            packed = up.take(lane16 + cell)
            unit = coder.range >> _WORD
            coder.code -= coder.low  # from here on the code is counted from low
            value = np.minimum(coder.code // unit, _LAST)
            which = (value >= ((packed >> np.uint64(16)) & _LAST)).view(np.int8) + (value >= ((packed >> np.uint64(32)) & _LAST)).view(np.int8)
            which += (value >= (packed >> np.uint64(48))).view(np.int8)
            begins, wide = _bounds(packed, which.view(np.uint8))
            begins *= unit
            coder.low += begins
            coder.code -= begins
            coder.range = np.multiply(unit, wide, out=wide)
            if size > 1 << 16:
                coder.code += coder.low
                coder.fill()
                coder.code -= coder.low
            at = which * np.int64(n)
            at += lane
            base, all_of = first.take(at), total.take(at)
            unit = coder.range // all_of.view(np.uint64)
            slot = np.minimum(coder.code // unit, (all_of - 1).view(np.uint64)).view(np.int64)
            new = np.flatnonzero(which == 3)
            at = which * np.int64(order)
            at += lane_at
            at += base
            at += slot
            at[new] = 0
            seen = found.take(at).view(np.uint32).reshape(n, 4)
            seen[new] = 0
            seen[new, 3] = slot[new]
            bounds = seen[:, 0]
            low = (bounds & _LOWER) - base
            high = (bounds >> _HALF) - base
            low[new], high[new] = slot[new], slot[new] + 1
            high -= low
            coder.code += coder.low
            coder.low += unit * low.view(np.uint64)
            coder.range = unit * high.view(np.uint64)
            coder.fill()
            for k, bounds in ((0, seen[:, 2]), (1, seen[:, 1])):
                np.bitwise_and(bounds, _LOWER, out=first[k], casting="unsafe")
                np.subtract(bounds >> _HALF, first[k], out=total[k], casting="unsafe")
            grid[t] = seen[:, 3]
            cells[t - begin] = (cell << 2) + which.view(np.uint8)
        if past:
            mix.learn(cells)
        del slots, found  # before the next are made


# files


def section(doc_ids: list[int | None], ids: list[bytes], size: int, block: int = BLOCK) -> bytes:
    """One section: a head, ids and lengths of its documents, length, size and crc32 of its blocks, the blocks."""
    return _section(doc_ids, np.array([len(x) // 4 for x in ids], np.int64), np.frombuffer(b"".join(ids), "<u4"), size, block)


def _section(doc_ids: list[int | None], lengths: np.ndarray, flat: np.ndarray, size: int, block: int) -> bytes:
    coded = encode_blocks(flat, size, block)
    heads = np.array([(min(block, len(flat) - i * block), len(c), zlib.crc32(flat[i * block : (i + 1) * block].tobytes())) for i, c in enumerate(coded)], "<u4").reshape(-1, 3)
    docs = np.array([(d is not None, d or 0, n) for d, n in zip(doc_ids, lengths.tolist())], "<i8").reshape(-1, 3)
    head = np.array([size, len(docs), len(coded), sum(map(len, coded))], "<u8")
    return b"".join([_MAGIC, head.tobytes(), docs.tobytes(), heads.tobytes(), *coded])


def sections(source) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """(document ids, their token ids) of each section of an open file; a wrong checksum is an error."""
    while magic := source.read(8):
        if magic != _MAGIC:
            raise ValueError("no section where one should begin")
        size, n_docs, n_blocks, n_bytes = np.frombuffer(source.read(32), "<u8").tolist()
        docs = np.frombuffer(source.read(24 * n_docs), "<i8").reshape(-1, 3)
        heads = np.frombuffer(source.read(12 * n_blocks), "<u4").reshape(-1, 3)
        raw = source.read(n_bytes)
        if len(raw) != n_bytes:
            raise ValueError("file ends within a section")
        cut = np.append(0, np.cumsum(heads[:, 1], dtype=np.int64)).tolist()
        flat = decode_blocks([raw[a:b] for a, b in zip(cut, cut[1:])], heads[:, 0].tolist(), size)
        at = 0
        for n, _, crc in heads.tolist():
            if zlib.crc32(flat[at : at + n].astype("<u4").tobytes()) != crc:
                raise ValueError("a block does not have its checksum")
            at += n
        ends = np.cumsum(docs[:, 2])
        yield [d if has else None for has, d, _ in docs.tolist()], np.split(flat, ends[:-1]) if len(docs) else []


def _writer(folder: str, path: str, end: int, block: int, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, model = TaskContext.get(), encoder(path)
        part = task.partitionId()
        name = f"{folder}/part-{part:06d}-{task.taskAttemptId()}.tkrc"
        size = max(model.size, end + 1)
        out, docs, lengths, ids, held = None, [], [], [], 0
        tokens = total = 0

        def flush() -> None:
            nonlocal out, docs, lengths, ids, held
            if out is None:
                fs, at = _open(name)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(at)
            out.write(_section(docs, np.concatenate(lengths), np.concatenate(ids), size, block))
            docs, lengths, ids, held = [], [], [], 0

        for batch in batches:
            for keys, texts in slices(batch, _TEXT):
                flat, many = model.flat(texts)
                flat = np.insert(flat, np.cumsum(many), end).astype("<u4", copy=False)
                keys, many = keys.to_pylist(), many + 1
                ends = np.cumsum(many)
                tokens += len(flat)
                total += len(many)
                at = done = 0
                while at < len(many):
                    stop = min(int(np.searchsorted(ends, done + block * lanes - held)) + 1, len(many))
                    upto = int(ends[stop - 1])
                    docs += keys[at:stop]
                    lengths.append(many[at:stop])
                    ids.append(flat[done:upto])
                    held += upto - done
                    at, done = stop, upto
                    if held >= block * lanes:
                        flush()
        if docs:
            flush()
        if out is not None:
            size_of = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), *(pa.array([x], pa.int64()) for x in (total, tokens, size_of))], names=["part", "file", "documents", "tokens", "file_bytes"])

    return run


def write_tokens(df: DataFrame, path: str, end: int, folder: str | None = None, partitions: int | None = None, block: int = BLOCK, lanes: int = LANES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents in ascending order of doc_id (null first); returns the manifest.

    The manifest has a row for each file in order: part, file, documents, tokens, file_bytes. Null and empty texts
    have the end id alone; repeated doc_ids are documents of their own; an empty table writes no file.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    schema = "part int, file string, documents long, tokens long, file_bytes long"
    return stage(rows.mapInArrow(_writer(folder, path, end, block, lanes), schema))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for files in batches:
        for name, start in zip(files.column("file").to_pylist(), files.column("start").to_pylist()):
            fs, path = _open(name)
            with fs.open_input_stream(path) as source:
                for docs, ids in sections(source):
                    size = np.array([len(x) for x in ids], np.int64)
                    ends = start + np.cumsum(size)
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - size), pa.array(size), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start = int(ends[-1]) if len(ends) else start


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document in the files.

    The driver sees the manifest only: a row for each file.
    """
    spark = manifest.sparkSession
    files = manifest.orderBy("part").collect()
    starts = np.append(0, np.cumsum([f.tokens for f in files], dtype=np.int64)).tolist()
    rows = spark.createDataFrame([(i, f.file, s) for i, (f, s) in enumerate(zip(files, starts))], "i int, file string, start long")
    n = max(1, len(files))
    return rows.repartitionById(n, F.col("i")).select("file", "start").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")

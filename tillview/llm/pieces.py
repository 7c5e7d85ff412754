"""SentencePiece encoding that keeps the place of each piece in the original bytes.

The text is normalised by longest prefix through the compiled character map of the model; for every
normalised byte the normaliser records the original byte it came from. Pieces tile the normalised text, so
the ends of a piece project to original bytes. Merges never cross from a piece into a following word mark
when no piece holds one inside; then segments between marks are encoded on their own and remembered.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = "▁"
_KEPT = 300_000  # segments remembered by one worker
_CHUNK = 1 << 20  # characters of text worked on at a time


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + size]
            at += size


class CharacterMap:
    """The compiled map: a double array over bytes whose leaves point to replacement texts."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that is a prefix of ``raw[at:]``."""
        units, found = self.units, None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.texts[start : self.texts.index(b"\0", start)]


class Codec:
    """One model: normalisation with alignment, encoding with spans, decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._read(f.read())

    @classmethod
    def of(cls, proto: bytes) -> Codec:
        self = cls.__new__(cls)
        self._read(proto)
        return self

    def _read(self, proto: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces, spec, trainer = [], {}, {}
        for field, value in _fields(proto):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), piece.get(3, 1)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                spec = dict(_fields(value))
        self.map = CharacterMap(spec[2]) if spec.get(2) else None
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        self.size = np.array([1 if kind == 6 else len(text.encode()) for text, kind in pieces], np.int64)
        self.mergeable = all(_MARK not in text.lstrip(_MARK) for text, kind in pieces if kind in (1, 4, 5)) and all(kind != 4 for _, kind in pieces)
        # A segment can be encoded on its own when normalising is the mark for each space and one in front.
        self.split = self.map is None and self.prefix and self.escape and not self.squeeze and not self.suffix and self.mergeable
        self.unknown = self.library.unk_id()
        self.end = self.library.eos_id()
        self.kept: dict[str, bytes] = {}

    # normalisation

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, the original byte where it begins."""
        raw = text.encode()
        if self.map is None and not self.squeeze:
            return self._plain(raw)
        out, origin = [], []
        at = 0
        while at < len(raw):
            hit = self.map.longest(raw, at) if self.map else None
            if hit:
                size, new = hit
            else:
                size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                new = raw[at : at + size]
            out.append(new)
            origin.append((at, at + size))
            at += size
        flat = b"".join(out)
        start = np.repeat(np.array([s for s, _ in origin], np.int64), [len(x) for x in out]) if out else np.empty(0, np.int64)
        start, lead = np.append(start, len(raw)), 0
        if self.squeeze:
            lead = next((s for x, (s, _) in zip(out, origin) if x != b" "), len(raw))
            data = np.frombuffer(flat, np.uint8)
            keep = np.ones(len(data), bool)
            space = data == 32
            keep[1:] &= ~(space[1:] & space[:-1])
            text_at = np.flatnonzero(~space)
            if len(text_at):
                keep[: text_at[0]] = False
                keep[text_at[-1] + 1 :] = False
                end = start[text_at[-1] + 1]
            else:
                keep[:] = False
                end = len(raw)
            flat, start = data[keep].tobytes(), np.append(start[:-1][keep], end)
        return self._marked(flat, start, lead)

    def _plain(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        return self._marked(raw, np.arange(len(raw) + 1), 0)

    def _marked(self, flat: bytes, start: np.ndarray, lead: int) -> tuple[bytes, np.ndarray]:
        mark = _MARK.encode() if self.escape else b" "
        if self.escape:
            size = np.where(np.frombuffer(flat, np.uint8) == 32, len(mark), 1)
            start = np.append(np.repeat(start[:-1], size), start[-1])
            flat = flat.replace(b" ", mark)
        if self.prefix and (flat or start[-1] and not self.squeeze) and not self.suffix:
            flat, start = mark + flat, np.append(np.full(len(mark), lead), start)
        if self.squeeze:
            while flat.endswith(mark):
                flat, start = flat[: -len(mark)], start[: -len(mark)]
        return flat, start

    # encoding

    def _segments(self, text: str) -> list[str]:
        words = text.replace(_MARK, " ").split(" ")
        if "" not in words:
            return words
        return re.findall(r" +[^ ]*", " " + text.replace(_MARK, " "))

    def _ids_of(self, segments: list[str]) -> dict[str, bytes]:
        """Ids of segments: 'word' for a mark and a word, ' word' with all its marks in front."""
        known = {}
        if " " in segments:
            alone = self.library.piece_to_id(_MARK)
            ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in _MARK.encode()] if alone == self.unknown else [alone]
            known[" "] = np.array(ids, "<i4").tobytes()
            segments = [s for s in segments if s != " "]
        found = self.library.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return known | {s: np.array(ids, "<i4").tobytes() for s, ids in zip(segments, found)}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as the library gives them, without an end id."""
        if not self.split:
            return [np.array(ids, "<i4") for ids in self.library.encode(texts, num_threads=1)]
        parts = [self._segments(t) if t else [] for t in texts]
        missing = {s for p in parts for s in p}.difference(self.kept)
        new = self._ids_of(list(missing)) if missing else {}
        if len(self.kept) + len(new) <= _KEPT:
            self.kept |= new
            get = self.kept.__getitem__
        else:
            kept = self.kept
            get = lambda s: kept.get(s) or new[s]
        return [np.frombuffer(b"".join(map(get, p)), "<i4") for p in parts]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last original byte of each piece. A mark without a space behind it is empty."""
        flat, start = self.normalise(text)
        size = self.size[ids]
        missing = len(flat) - int(size.sum())
        if missing and (ids == self.unknown).any():  # an unknown piece covers what its neighbours leave
            size = self._unknown_sizes(flat, ids, size)
        at = np.append(0, np.cumsum(size))
        if at[-1] != len(flat):
            raise ValueError("pieces do not tile the normalised text")
        return start[at[:-1]], start[at[1:]]

    def _unknown_sizes(self, flat: bytes, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        size, at = size.copy(), 0
        for i, k in enumerate(ids.tolist()):
            if k == self.unknown:
                rest = next((j for j in range(i + 1, len(ids)) if ids[j] != self.unknown), None)
                if rest is None:
                    size[i] = len(flat) - at
                else:
                    there = flat.find(self.library.id_to_piece(int(ids[rest])).encode(), at + 1)
                    size[i] = max(there, at) - at
            at += int(size[i])
        return size

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of a batch, about _CHUNK characters at a time; null is empty."""
    ids, text = batch.column(0), batch.column(1).cast(pa.large_string()).fill_null("")
    size = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(size, size[at] + _CHUNK, "right")) - 1)
        yield ids.slice(at, end - at), text.slice(at, end - at).to_pylist()
        at = end


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            for ids, texts in _chunks(batch):
                found = model.encode(texts)
                spans = [model.spans(t, x) for t, x in zip(texts, found)]
                ends = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
                flat = [np.concatenate(x) if x else np.empty(0, np.int32) for x in (found, [s for s, _ in spans], [e for _, e in spans])]
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in flat]
                yield pa.RecordBatch.from_arrays([ids, *lists], names=["doc_id", "ids", "starts", "ends"])

    return run


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and for each id the original bytes it stands for: starts, ends.

    No end id is added. Null and empty texts have no ids. Rows are independent: repeated or null ids give a
    row each; other columns are not looked at.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoded(path), "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id and text for rows of doc_id and ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = codec(path).decode([x or [] for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            for ids, texts in _chunks(batch):
                found = model.encode(texts)
                full = [[*x.tolist(), model.end] for x in found]
                marks = [zlib.crc32(np.concatenate(model.spans(t, x)).astype("<i8").tobytes()) for t, x in zip(texts, found)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([len(x) for x in full], pa.int64()),
                        pa.array([hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in full]),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in model.decode(full)]),
                        pa.array(marks, pa.int64()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"],
                )

    return run


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of ids (with the end id), of the decoded text and of the spans, without moving the ids to the JVM."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")

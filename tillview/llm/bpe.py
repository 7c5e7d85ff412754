"""Ids of whole texts by the tokenizers library, remembering the words it has seen.

Both vocabularies split a text before merging, and no part reaches over a single space. So texts are cut at spaces, and only words
that are not remembered are encoded: those of usual characters part by part, by the library's own merges; a word of unusual ones, or
one with white space in it, goes through the whole library as it stands. The ids are the library's in either case.

For the vocabulary with spaces in its tokens, Arrow cuts texts whose white space is single spaces and single line feeds and finds the
different words of some megabytes; the library gets those not listed yet many at once, and their ids are laid out by numpy.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

_KEPT = 300_000  # words remembered by one worker; beyond it starts afresh
_IN_A_ROW = 10_000  # words of a text for the library
_LISTED = 1_500_000  # the same for the list of ``flat``
_CHUNK = 1 << 20  # characters worked on at a time
_ODD = re.compile("[^\t\n -~¡-ɏ]")
_ODD_UNIT = re.compile("[^ -~¡-ɏ]|(?<!^) | $")  # of a word with its space: anything else, or a space elsewhere
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ.,;:!?]+").fullmatch
_BEFORE_SPACE = re.compile("(?<=\\S)(?= )")
_BYTE_LEVEL = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
_WORD_END = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _members(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


def _usual(pattern: str) -> re.Pattern[str]:
    """A pattern of the library for texts of usual characters."""
    for kind in "LN":
        pattern = pattern.replace(f"[\\p{{{kind}}}]", f"[{_members(kind)}]")
    pattern = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^\\s{_members('L')}{_members('N')}]")
    return re.compile(pattern.replace("\\p{L}", f"[{_members('L')}]").replace("\\p{N}", f"[{_members('N')}]"))


def _as_signs() -> dict[int, int]:
    """Bytes as the signs that byte-level vocabularies are written in: printable ones stand for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + i for i, b in enumerate(sorted(set(range(0x100)) - plain))}


def _blank(sign: str) -> bool:
    return sign.isspace() or not sign.isascii() and unicodedata.category(sign)[0] in "ZC"


def _blank_ends(words: pa.Array) -> np.ndarray:
    """Which words are empty, or begin or end with white space or signs that may count as such."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.append(np.frombuffer(words.buffers()[2] or b"", np.uint8)[: at[-1]], np.zeros(2, np.uint8))
    plain = (raw > 0x20) & (raw < 0x7F)
    latin = (raw >= 0xC3) & (raw <= 0xC9)  # first of the two bytes of a letter
    out = ~((plain | latin)[at[:-1]] & (plain[at[1:] - 1] | latin[at[1:] - 2]) & (np.diff(at) > 0))
    for i in np.flatnonzero(out).tolist():
        word = words[i].as_py()
        out[i] = not word or _blank(word[0]) or _blank(word[-1])
    return out


class Encoder:
    """Encodes texts to little-endian 32-bit ids, without special tokens; their strings are ordinary text."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.model, self.signs = self.library.model, _as_signs()
        self.sign_of = "".join(chr(self.signs.get(b, b)) for b in range(0x100))
        with open(path) as f:
            spec = json.load(f)
        self.size = max(spec["model"]["vocab"].values()) + 1
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        kinds = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        first = pre.get("pretokenizers", [{}])[0]
        self.kind = None
        if not all(t["special"] for t in spec.get("added_tokens", [])):
            pass  # tokens that the library takes out of a text before all else
        elif pre.get("type") == "ByteLevel" and norm is None and pre["use_regex"] and not pre["add_prefix_space"]:
            self.kind, self.parts = "space", _usual(_BYTE_LEVEL)
        elif kinds == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": _WORD_END} and first["invert"]:
            self.kind, self.parts = "end", _usual(_WORD_END)
        self.spaced = np.zeros(self.size, bool)  # tokens that begin with a space
        self.spaced[[i for t, i in spec["model"]["vocab"].items() if t.startswith(chr(self.signs[0x20]))]] = True
        self.list, self.places, self.ids = pa.array([], pa.large_string()), np.zeros(1, np.int64), np.empty(0, "<u4")
        # Whether no token of plain words joins letters with marks, or has a space inside: then merges alone keep parts and words apart.
        letter = "A-Za-z" + "".join(re.escape(chr(self.signs.get(b, b))) for b in (*range(0x80, 0xC0), *range(0xC3, 0xCA)))
        space = chr(self.signs[0x20])
        within = re.compile(f"[{letter}.,;:!?{space}]+").fullmatch
        mixed = re.compile(f"[{letter}][.,;:!?]|[.,;:!?][{letter}]|[^{space}]{space}").search
        self.apart = self.kind == "space" and not (spec["model"].get("ignore_merges") or spec["model"].get("dropout"))
        self.apart = self.apart and not any(within(t) and mixed(t) for t in spec["model"]["vocab"])
        self.kept: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}  # parts of words

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _part(self, part: str) -> bytes:
        """Ids of one part of a word, by the merges alone."""
        signs = part if part.isascii() and part[0] != " " else part.encode().decode("latin-1").translate(self.signs)
        ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens]) if (tokens := self.model.tokenize(signs)) else b""
        if len(self.known) >= _KEPT:
            self.known.clear()
        self.known[part] = ids
        return ids

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words; for the vocabulary with spaces in its tokens they come with the space in front."""
        known, part, split, spaced = self.known, self._part, self.parts.findall, self.kind == "space"
        out: dict[str, bytes] = {}
        odd = []
        for word in words:
            if word.isascii() and word.isalpha():
                out[word] = known.get(word) or part(word)
            elif _ODD_UNIT.search(word) if spaced else not (word.isascii() and word.isprintable()) and (_ODD.search(word) or word != word.lower()):
                odd.append(word)
            else:
                out[word] = b"".join([known.get(p) or part(p) for p in split(word)])
        if odd:
            out |= zip(odd, self.whole(odd))
        return out

    def _in_a_row(self, words: list[str], by_merges: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that each have a space in front, many of them given to the library at once, and how many each has; no other spaces."""
        parts = [np.empty(0, "<u4")]
        many = 50 if by_merges else _IN_A_ROW
        for at in range(0, len(words), many):
            text = " " + " ".join(words[at : at + many])
            if by_merges:
                parts.append(np.array([t.id for t in self.model.tokenize(codecs.charmap_decode(text.encode(), "strict", self.sign_of)[0])], "<u4"))
            else:
                parts.append(np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate(parts)
        begins = np.flatnonzero(self.spaced[ids])  # the space is the first sign of the first token
        if len(begins) != len(words):
            raise ValueError("a token reaches over a space")
        return ids, np.diff(np.append(begins, len(ids)))

    def _listed(self, words: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each wanted word with a space in front begin in ``self.ids``, and how many they are; 0 for others."""
        if len(self.list) + len(words) > _LISTED:
            self.list, self.places, self.ids = words[:0], np.zeros(1, np.int64), np.empty(0, "<u4")
        place = pc.index_in(words, value_set=self.list).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(wanted & (place < 0))
        if len(new):
            more = words.take(pa.array(new)).to_pylist()
            plain = np.fromiter(map(bool, map(_PLAIN, more)), bool, len(more)) & self.apart
            for kind in (True, False):
                own = np.flatnonzero(plain == kind)
                place[new[own]] = len(self.list) + np.arange(len(own))
                some = [more[i] for i in own.tolist()]
                ids, many = self._in_a_row(some, kind)
                self.list = pa.concat_arrays([self.list, pa.array(some, self.list.type)])
                self.places = np.concatenate([self.places, self.places[-1] + np.cumsum(many)])
                self.ids = np.concatenate([self.ids, ids])
        first = np.where(wanted, self.places[place], 0)
        return first, np.where(wanted, self.places[place + 1] - first, 0)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has; no text is null."""
        if self.kind != "space" or not len(texts):
            raw = self.encode(texts.to_pylist())
            return np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) >> 2 for x in raw], np.int64)
        cut = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n "), " ")
        bounds = np.asarray(cut.offsets).astype(np.int64)
        coded = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds -= bounds[0]
        words, code = coded.dictionary, coded.indices.to_numpy()
        n, at = len(words), {w: pc.index(words, w).as_py() for w in ("", "\n")}
        feed, none = code == at["\n"], code == at[""]
        begins, ends = np.zeros((2, len(code)), bool)
        begins[bounds[:-1]] = ends[bounds[1:] - 1] = True
        after, ahead = np.zeros((2, len(code)), bool)
        after[1:], ahead[:-1] = feed[:-1], feed[1:]
        # Other white space leaves words that are empty, or begin or end with it: such texts go the other way.
        odd = _blank_ends(words)[code]
        odd &= ~feed & ~(none & (begins & (ends | ahead) | ends & after))
        other = np.add.reduceat(odd, bounds[:-1], dtype=np.int64) > 0
        # A word has a space before it unless it begins a text or a line.
        key = code + np.int32(n) * (begins | after | feed | none)
        if other.any():
            key[np.repeat(other, np.diff(bounds))] = 2 * n
        used = np.bincount(key, minlength=2 * n + 1) > 0
        first, size = np.zeros((2, 2 * n + 1), np.int64)
        first[:n], size[:n] = self._listed(words, used[:n])
        bare = np.flatnonzero(used[n : 2 * n])
        raw = self.encode(words.take(pa.array(bare)).to_pylist())
        size[n + bare] = [len(x) >> 2 for x in raw]
        first[n + bare] = len(self.ids) + np.cumsum(size[n + bare]) - size[n + bare]
        many = size.astype(np.int32)[key]
        ends = np.cumsum(many, dtype=np.int32)
        places = np.repeat(first.astype(np.int32)[key] - ends + many, many)
        places += np.arange(len(places), dtype=np.int32)
        ids, lengths = np.concatenate([self.ids, np.frombuffer(b"".join(raw), "<u4")])[places], np.add.reduceat(many, bounds[:-1], dtype=np.int64)
        if not other.any():
            return ids, lengths
        cuts, out, done = np.cumsum(lengths), [], 0
        others = np.flatnonzero(other)
        for i, own in zip(others.tolist(), self.encode([texts[i].as_py() for i in others.tolist()])):
            out += [ids[done : cuts[i]], np.frombuffer(own, "<u4")]
            done, lengths[i] = cuts[i], len(own) >> 2
        return np.concatenate([*out, ids[done:]]), lengths

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.kind is None:
            return self.whole(texts)
        parts: list[list[str]] = []
        for text in texts:
            if self.kind == "space":
                parts.append(_BEFORE_SPACE.split(text) if text else [])
            else:
                lower = text.lower()
                # Unusual letters are left for the library to lower.
                parts.append(lower.split() if not _ODD.search(lower) else _cut_odd(text))
        seen = {w for p in parts for w in p}
        missing = seen.difference(self.kept)
        if len(self.kept) + len(missing) > _KEPT:
            self.kept, missing = {}, seen
        if missing:
            self.kept |= self._words(list(missing))
        get = self.kept.__getitem__
        return [b"".join(map(get, p)) for p in parts]


def _cut_odd(text: str) -> list[str]:
    """Words between spaces, tabs and line feeds; lower case where that is plain."""
    words = [w for w in re.split("[ \t\n]+", text) if w]
    return [w if _ODD.search(w) or _ODD.search(w.lower()) else w.lower() for w in words]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(batch: pa.RecordBatch, most: int = _CHUNK) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of a batch (first and second column), about a megabyte of text at a time; null is empty."""
    ids, text = batch.column(0), batch.column(1).cast(pa.large_string()).fill_null("")
    at = 0
    if not len(text):
        return
    size = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield ids.slice(at, end - at), text.slice(at, end - at)
        at = end


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """The same with the texts as a list."""
    for ids, text in slices(batch):
        yield ids, text.to_pylist()

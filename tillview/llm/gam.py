"""Quality classifier: a generalised additive model with pairwise interactions.

Measures of a text are cut into bins. Shallow trees on one measure at a time are boosted in turn, and each is
added to that measure's lookup table; then the pairs of measures that explain most of what is left get small
tables of their own in the same way. A score is the sum of one entry of each table, looked up for all
texts of a batch at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.llm.words import groups_of, run_hashes, runs_inside, text_bytes, word_hashes, word_spans

MEASURES = (
    "log_words", "word_bytes", "short_words", "long_words", "distinct_words", "repeated_words", "distinct_runs",
    "upper", "digits", "marks", "shouts", "symbols", "line_bytes", "distinct_lines", "not_ascii", "capital_words", "common_words",
)
MOST_ROWS = 20_000  # labelled rows the model is fitted on, at most
_CHUNK = 2 << 20


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_UPPER, _DIGITS, _SHOUTS = _table(bytes(range(65, 91))), _table(b"0123456789"), _table(b"!?")
_MARKS, _SYMBOLS, _HIGH = _table(b".,;:'\"()-"), _table(b"#$%&*+/<=>@[\\]^_`{|}~"), _table(bytes(range(128, 256)))


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive entries of ``first``."""
    return np.diff(np.append(0, np.cumsum(values))[first])


def _distinct(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each text has."""
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=n)


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of MEASURES for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    starts, ends, first = word_spans(data, offsets)
    words, length = np.diff(first), ends - starts
    text = np.repeat(np.arange(n), words)
    hashes = word_hashes(data, starts, ends)
    same = np.zeros(len(hashes), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    at = runs_inside(first, 3)
    runs = run_hashes(hashes, 3)[at] if len(at) else np.empty(0, np.uint64)
    # Lines: a line break after a word ends a line; a line's key is the hash of its words in order.
    begins = np.zeros(len(starts), bool)
    breaks = np.append(0, np.cumsum(data == 10))
    if len(starts):
        begins[0] = True
        begins[1:] = (breaks[starts[1:]] > breaks[ends[:-1]]) | (text[1:] != text[:-1])
    line_at = np.flatnonzero(begins)
    place = np.arange(len(starts)) - np.repeat(line_at, np.diff(np.append(line_at, len(starts)))) if len(line_at) else np.empty(0, np.int64)
    lines = np.add.reduceat(hashes * (2 * place.astype(np.uint64) + np.uint64(1)), line_at) if len(line_at) else np.empty(0, np.uint64)
    line_text = text[line_at]
    n_lines = np.bincount(line_text, minlength=n)
    # The share of a text that its most common word has stands for how its words are spread.
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))) if len(h) else np.empty(0, np.int64)
    many = np.diff(np.append(new, len(h)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, t[new], many)
    each, w, b = np.maximum(n_lines, 1), np.maximum(words, 1), np.maximum(size, 1)

    def of_bytes(table: np.ndarray) -> np.ndarray:
        return _per_text(table[data], offsets) / b

    def of_words(flag: np.ndarray) -> np.ndarray:
        return _per_text(flag.astype(np.int64), first) / w

    columns = [
        np.log1p(words), _per_text(length, first) / w, of_words(length <= 3), of_words(length >= 12),
        np.bincount(t[new], minlength=n) / w, of_words(same),
        _distinct(runs, text[at], n) / np.maximum(np.bincount(text[at], minlength=n), 1),
        of_bytes(_UPPER), of_bytes(_DIGITS), of_bytes(_MARKS), of_bytes(_SHOUTS), of_bytes(_SYMBOLS),
        np.log1p(size / each), _distinct(lines, line_text, n) / each, of_bytes(_HIGH),
        of_words(_UPPER[data[starts]]) if len(starts) else np.zeros(n), top / w,
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def _rows_of(text: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First row and measures of the texts of a batch, some megabytes at a time."""
    data, offsets = text_bytes(text)
    for low, high in groups_of(offsets, _CHUNK):
        own = offsets[low : high + 1]
        yield low, measures(data[own[0] : own[-1]], own - own[0])


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: str | None = None) -> DataFrame:
    """doc_id and one column for each of MEASURES (and the column ``also``, a number); null text counts as empty."""
    extra = [F.col(also).cast("long").alias("also")] if also else []
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, x in _rows_of(batch.column(1)):
                more = [c.slice(low, len(x)) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(x)), *(pa.array(c) for c in x.T), *more], names=["doc_id", *MEASURES, *(["also"] if also else [])])

    out = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{m} double" for m in MEASURES) + (", also long" if also else ""))
    return out.withColumnRenamed("also", also) if also else out


@dataclass
class Model:
    """Lookup tables: ``edges`` cut a measure into bins, ``single[f][bin]`` and ``double[(f, g)][bin, bin]`` are added."""

    start: float
    edges: list[np.ndarray]
    single: list[np.ndarray]
    coarse: list[np.ndarray]
    double: dict[tuple[int, int], np.ndarray]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        bins = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)]
        for table, b in zip(self.single, bins):
            out += table[b]
        for (f, g), table in self.double.items():
            out += table[self.coarse[f][bins[f]], self.coarse[g][bins[g]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))

    def to_json(self) -> str:
        lists = lambda arrays: [a.tolist() for a in arrays]
        double = [[f, g, t.tolist()] for (f, g), t in self.double.items()]
        return json.dumps({"start": self.start, "edges": lists(self.edges), "single": lists(self.single), "coarse": lists(self.coarse), "double": double})

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        arrays = lambda k, kind=float: [np.array(a, kind) for a in d[k]]
        return cls(d["start"], arrays("edges"), arrays("single"), arrays("coarse", int), {(f, g): np.array(t) for f, g, t in d["double"]})


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float, ridge: float) -> np.ndarray:
    """Steps of the best shallow tree over ordered bins with gradients ``g`` and curvatures ``h``."""
    cuts = [0, len(g)]
    gs, hs = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    worth = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            c = np.arange(a + 1, b)
            ok = (hs[c] - hs[a] >= least) & (hs[b] - hs[c] >= least)
            gain = np.where(ok, worth(a, c) + worth(c, b) - worth(a, b), -1)
            if len(c) and gain.max() > best[0]:
                best = (gain.max(), int(c[np.argmax(gain)]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, least: float, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four by one cut on each side, and its gain."""
    gs, hs = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (g, h))
    best, out = 0.0, np.zeros_like(g)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [(s[i, j], s[-1, j] - s[i, j], s[i, -1] - s[i, j], s[-1, -1] - s[-1, j] - s[i, -1] + s[i, j]) for s in (gs, hs)]
            step = [x / (y + ridge) if y >= least else 0.0 for x, y in zip(*parts)]
            gain = sum(x * z for x, z in zip(parts[0], step))
            if gain > best:
                best = gain
                out[:i, :j], out[i:, :j], out[:i, j:], out[i:, j:] = step
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 64, pairs: int = 6, pair_rounds: int = 60, cells: int = 8, leaves: int = 3, least: float = 2.0, ridge: float = 1.0) -> Model:
    """Fit to rows ``x`` with labels 0 and 1; without rows of both labels every score is the smoothed share of 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for c in x.T]
    single = [np.zeros(len(e) + 1) for e in edges]
    coarse = [np.minimum(np.arange(len(e) + 1) * cells // (len(e) + 1), cells - 1) for e in edges]
    model = Model(start, edges, single, coarse, {})
    if not len(y) or y.min() == y.max():
        return model
    at = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)]
    logit = np.full(len(x), start)

    def pull() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f, b in enumerate(at):
            g, h = pull()
            n = len(single[f])
            step = rate * _tree(np.bincount(b, g, n), np.bincount(b, h, n), leaves, least, ridge)
            single[f] += step
            logit += step[b]
    g, h = pull()
    grid = lambda f, k, v: np.bincount(coarse[f][at[f]] * cells + coarse[k][at[k]], v, cells * cells).reshape(cells, cells)
    ranked = sorted(((_quarters(grid(f, k, g), grid(f, k, h), least, ridge)[0], f, k) for f in range(len(at)) for k in range(f)), reverse=True)
    chosen = [(k, f) for _, f, k in ranked[:pairs]]
    for _ in range(pair_rounds):
        for f, k in chosen:
            g, h = pull()
            step = rate * _quarters(grid(f, k, g), grid(f, k, h), least, ridge)[1]
            model.double[f, k] = model.double.get((f, k), 0) + step
            logit += step[coarse[f][at[f]], coarse[k][at[k]]]
    return model


def held_out(column) -> F.Column:
    """Rows whose label is never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST_ROWS) -> Model:
    """Fit on at most ``most`` labels that are not held out, those first in the order of a hash of their id.

    Rows with a null id or label are left out; of an id labelled twice, either label counts as a row of its own, and
    a labelled id without a document counts for nothing.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    some = marks.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id", "y").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(some), F.col("id") == F.col("doc_id")).select("doc_id", "text", "y")  # at most ``most`` rows
    got = measure(rows, also="y").orderBy("doc_id", "y", *MEASURES).toPandas()
    return fit(got[list(MEASURES)].to_numpy(np.float64).reshape(-1, len(MEASURES)), got["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    tables = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by bins and pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, x in _rows_of(batch.column(1)):
                found = tables.value.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(x)), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows that score ``threshold`` or more, with all their columns."""
    tables = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, x in _rows_of(batch.column(at)):
                yield batch.slice(low, len(x)).filter(pa.array(tables.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = MOST_ROWS) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted.

    Measures come from the text alone. Null text counts as empty; null ids are scored too and are not held out;
    repeated rows are scored each; an empty table gives an empty result; other columns are not looked at.
    """
    return score(docs, train(docs, labels, most=most), threshold)

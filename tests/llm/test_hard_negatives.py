"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tillview.llm import hard_negatives as hn


def by_hand(rows, positives=5, negatives=3, low=50, high=95):
    good = [(i, label, v) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, label, v) in enumerate(good):
        if i % 5:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other == label) for m, (j, other, w) in enumerate(good) if m != n and len(w) == len(v)]
        scored.sort(key=lambda r: r[:2])
        for score, j, _ in [r for r in scored if r[2]][:positives]:
            s = -score
            fit = [(-t, k) for t, k, same in scored if not same and low * s <= -100 * t <= high * s]
            out += [(i, j, rank + 1, k, s, t) for rank, (t, k) in enumerate(fit[:negatives])]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, label, v, "x", 1) for i, label, v in rows], "vec_id long, label int, embedding array<double>, rep string, block int")
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 5 == 0, **more).collect())


def whole(rng, n, d, spread=200):
    return [float(x) for x in rng.integers(-spread, spread, d)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    centres = [whole(rng, 1, 8) for _ in range(6)]
    for i in range(260):
        if i % 3:
            c = centres[int(rng.integers(6))]
            v = [x + float(rng.integers(-30, 30)) for x in c]
        else:
            v = whole(rng, 1, 8)
        out.append((i, int(rng.integers(0, 3)) if i % 4 else 0, v))
    out += [(300 + i, i % 2, [1.0, 2.0, 3.0]) for i in range(12)]  # ties, of another length
    out += [(5, 1, whole(rng, 1, 8)), (5, 1, out[5][2]), (10, None, whole(rng, 1, 8)), (None, 1, whole(rng, 1, 8)), (15, 1, None), (20, 1, []), (25, 1, [math.nan] * 8), (30, 2, [None] * 8), (35, 2, [math.inf] + [0.0] * 7), (40, 2, [0.0] * 8), (45, 0, [0.0] * 8)]
    return out


@pytest.mark.parametrize("block", [4096, 40])
def test_equal_to_brute_force(spark, rows, block):
    got = found(spark, rows, block=block)
    assert got == by_hand(rows) and len(got) > 200


def test_other_windows(spark, rows):
    assert found(spark, rows, positives=2, negatives=7, low=-20, high=60, block=100) == by_hand(rows, 2, 7, -20, 60)


def test_groups_of_anchors(spark, rows, monkeypatch):
    monkeypatch.setattr(hn, "GROUP", 9)
    assert found(spark, rows, block=100) == by_hand(rows)


def test_few_nodes_are_opened_where_there_is_structure(monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.integers(-500, 500, (40, 16))
    x = (centres[rng.integers(0, 40, 2000)] + rng.integers(-9, 9, (2000, 16))).astype(float)
    most = float(np.sqrt((x * x).sum(1).max()))
    label = rng.integers(0, 2, 2000)
    tree = hn.Tree.of(np.arange(2000), np.arange(2000), label, x, most)
    n = 50
    q = hn.Queries(np.arange(n), label[:n], x[:n], np.arange(n), np.full(n, -np.inf), np.full(n, np.inf))
    compared, einsum = [], np.einsum

    def counted(form, a, b):
        compared.append(len(a) if a is not b else 0)
        return einsum(form, a, b)

    monkeypatch.setattr(np, "einsum", counted)
    window, point, score = hn.search(tree, q, 5, True)
    monkeypatch.undo()
    assert sum(compared) < 0.2 * n * 2000
    for i in range(n):
        order = sorted((-float(x[i] @ x[j]), j) for j in range(2000) if j != i and label[j] == label[i])[:5]
        assert sorted((-s, int(tree.ids[p])) for w, p, s in zip(window, point, score) if w == i) == order


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 1, [1.0])]) == []
    assert found(spark, [(5, 1, [1.0]), (10, 1, [1.0])]) == []


def test_whole_scores(spark):
    rng = random.Random(1)
    data = [(i, i % 10, [rng.random() - 0.5 for _ in range(3)]) for i in range(15)] + [(21, None, None), (22, 1, [math.nan, None, math.inf])]
    got = {r.vec_id: r for r in hn.whole_scores(spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")).collect()}
    for i, label, v in data[:15]:
        assert got[i].label == ((label + 1) % 10 if i % 7 == 0 else label) and got[i].embedding == [float(math.floor(256 * x)) for x in v]
    assert got[21].label is None and got[21].embedding is None and got[22].embedding[1:] == [None, math.inf]

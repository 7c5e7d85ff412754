"""Runs of repeated words against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tillview.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_hand(w, least=24):
    """Every maximal stretch of each period, the smallest period of a stretch only."""
    best = {}
    n = len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= 2 * q:
                best.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in best.items() if b - a >= least)


def collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_words int, runs string")
    return sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(df, **more).collect()), key=str)


def by_hand(rows, least=24):
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        runs = runs_by_hand(w, least)
        out.append((i, len(w), runs, collapsed(w, runs)))
    return sorted(out, key=str)


def texts():
    rng = random.Random(4)
    out = ["", None, " \n", "a", "a " * 23, "a " * 24, "b " + "a\t" * 90, "a b " * 11 + "c", "a b " * 12, "a b c " * 8 + "d"]
    for _ in range(60):
        size = rng.choice([2, 3, 50, 1000])
        word = lambda: f"w{rng.randrange(size)}"  # noqa: B023, E731
        w = []
        for _ in range(rng.randrange(1, 6)):
            unit = [word() for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40]))]
            w += (unit * rng.randrange(1, 7))[: rng.randrange(1, 120)]
            w += [word() for _ in range(rng.randrange(0, 12))]
        out.append(" ".join(w))
    # A long period that holds a run of its own; two words far apart; Fibonacci and Thue-Morse words.
    out.append(("x " * 60 + "y ") * 5)
    out.append(" ".join((["p"] * 30 + ["q"] * 30 + ["r"]) * 4))
    a, b = ["a"], ["a", "b"]
    while len(b) < 600:
        a, b = b, b + a
    out.append(" ".join(b))
    out.append(" ".join("ab"[bin(i).count("1") % 2] for i in range(512)))
    return out


def test_equal_to_brute_force(spark):
    rows = [(i % 50 if i % 9 else None, t) for i, t in enumerate(texts())]
    got = found(spark, rows)
    assert got == by_hand(rows)
    assert sum(bool(r[2]) for r in got) > 30
    assert found(spark, rows, least=3) == by_hand(rows, 3)


@pytest.mark.parametrize("seed", range(6))
def test_all_periods_of_small_alphabets(seed):
    rng = np.random.default_rng(seed)
    rows = [rng.integers(0, rng.integers(1, 4), rng.integers(0, 90)) for _ in range(150)]
    rows += [np.concatenate([np.tile(rng.integers(0, 3, int(q)), 4), rng.integers(0, 3, 5)]) for q in range(1, 70)]
    first = np.append(0, np.cumsum([len(r) for r in rows]))
    words = periods.mix(np.concatenate(rows).astype(np.uint64) << np.uint64(1))
    for own, runs in zip(rows, periods._runs_of(words, first)):
        assert [(a, b - a, q) for a, b, q in runs.tolist()] == runs_by_hand(own.tolist(), 0)


def test_members_depend_on_the_words_behind_them_only():
    rng = np.random.default_rng(1)
    part = rng.integers(0, 9, 400)
    x, y = np.concatenate([rng.integers(0, 9, 77), part]), np.concatenate([rng.integers(0, 9, 191), part])

    def members(w, size):
        h, n = periods.mix(w.astype(np.uint64)), 1
        while n < size:
            h, n = periods._doubled(h, n), 2 * n
        return periods.synchronising(h, size, np.zeros(len(h), bool))

    for size in (4, 16, 64):
        inside = [set((m - k)[m >= k].tolist()) for m, k in ((members(x, size), 77), (members(y, size), 191))]
        assert inside[0] == inside[1] and all(any(i in inside[0] for i in range(a, a + size)) for a in range(400 - 3 * size))


def test_words_that_share_a_hash(spark, monkeypatch):
    rng = random.Random(6)
    w = [rng.choice([b"a", b"b"]) for _ in range(40)] + b"a c c ".split() * 9
    weak = np.array([1 if x in b"ab" else 3 for x in w], np.uint64)
    assert not periods._hold(w, periods._runs_of(weak, np.array([0, len(w)]))[0])
    assert [(a, b - a, q) for a, b, q in periods._by_number(w).tolist()] == runs_by_hand(w, 3)


def test_long_text(spark):
    rng = random.Random(2)
    unit = [f"word{rng.randrange(10**6)}" for _ in range(70_000)]
    w = [f"word{rng.randrange(10**6)}" for _ in range(5_000)] + unit * 3 + unit[:100]
    (row,) = found(spark, [(1, " ".join(w))])
    assert row[1:3] == (len(w), [(5_000, 210_100, 70_000)]) and row[3] == " ".join(w[:75_000])


def test_empty_table(spark):
    assert found(spark, []) == []


def contract(rows):
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        n, h = len(w), None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = runs_by_hand(w)
        best = None
        for a, size, q in runs:
            if best is None or size * best[2] > best[1] * q:
                best = (a, size, q)
        lines = "".join(f"{a},{size},{q}\n" for a, size, q in runs)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(lines), digest(collapsed(w, runs))))
    return sorted(out, key=str)


def test_contract(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(f"w{rng.randrange(200)}" for _ in range(rng.choice([0, 1, 5, 90, 300])))) for i in range(400)]
    rows += [(None, "a " * 30), (7, None), (7, "b " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in periods.digests(periods.periodic_runs(periods.stuttering(df))).collect()), key=str)
    assert got == contract(rows) and sum(r[1] > 0 for r in got) > 10

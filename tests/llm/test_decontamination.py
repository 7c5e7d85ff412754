"""Benchmark windows in documents against brute force."""

import hashlib
import random
import re

import pytest
from tillview.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(0x41, 0x5B)}
RAISED = {b: a for a, b in LOWER.items()}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_hand(docs, items, window=10, k=5, least=1.0):
    """doc_id, words, words hit, items; windows share at least ``least`` of their shingles at their places."""
    out = []
    for doc, text in docs:
        own, hit, held = words(text), set(), set()
        for item, raw in items:
            w = words(raw)
            n = min(window, len(w))
            for s in range(len(w) - n + 1) if n else ():
                part, size = w[s : s + n], min(k, n)
                for d in range(len(own) - n + 1):
                    mine = own[d : d + n]
                    same = sum(mine[j : j + size] == part[j : j + size] for j in range(n - size + 1))
                    if same >= least * (n - size + 1) - 1e-9 and same:
                        hit.update(range(d, d + n))
                        held.add("" if item is None else str(item))
        out.append((doc, len(own), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "mine", 1) for i, t in docs], "doc_id long, text string, row string, spans int")
    b = spark.createDataFrame([(i, t, "mine") for i, t in items], "item_id string, text string, words string")
    return sorted((tuple(r) for r in dc.digests(dc.overlaps(d, b, **more)).collect()), key=str)


def prose(rng, n, size=60):
    return " ".join(rng.choice(["w", "W", "é", "9"]) + str(rng.randrange(size)) for _ in range(n))


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    items = [(f"i{i}", prose(rng, rng.choice([3, 9, 10, 11, 40]))) for i in range(25)]
    items += [("i3", prose(rng, 12)), (None, prose(rng, 15)), ("empty", ""), ("none", None), ("signs", "-- ?"), ("copy", items[0][1])]
    docs = [(None, None), (None, items[2][1]), (1, ""), (2, "..."), (3, "short"), (3, items[4][1] + " tail")]
    for i in range(4, 60):
        text = prose(rng, rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)[1])
            a = rng.randrange(len(w) + 1)
            text += rng.choice([" ", "\n- ", ""]) + ", ".join(w[a : a + rng.randrange(1, 30)]).translate(RAISED) + " " + prose(rng, 4)
        docs.append((i, text))
    docs.append((99, prose(rng, 3000) + " " + items[3][1]))
    return docs, items


def test_equal_to_brute_force(spark, case):
    got = found(spark, *case)
    assert got == by_hand(*case)
    assert 5 < sum(r[-1] for r in got) < len(got) - 5


def test_item_blocks_give_the_same(spark, case):
    assert found(spark, *case, block_bytes=300) == by_hand(*case)


def test_lower_containment(spark, case):
    assert found(spark, *case, k=2, least=0.6) == by_hand(*case, k=2, least=0.6)
    assert found(spark, *case, k=2, least=0.6) != by_hand(*case)


def test_a_long_item_is_cut_without_loss(spark, monkeypatch, case):
    text = prose(random.Random(8), 200, 10_000)
    monkeypatch.setattr(dc, "PIECE", 1)  # 20 words, at least
    items, w = [("long", text)], words(text)
    docs = [(i, " ".join(w[i : i + 10])) for i in range(191)] + [(500, " ".join(w[5:14]))]
    got = found(spark, docs, items)
    assert [r[2] for r in got if r[0] != 500] == [10] * 191 and [r[2] for r in got if r[0] == 500] == [0]


def test_long_text(spark):
    rng = random.Random(9)
    item = prose(rng, 30, 10**6)
    text = prose(rng, 700_000, 10**6) + " " + item + " " + prose(rng, 10, 10**6)
    assert len(text) > dc.CHUNK
    assert [r[1:4] for r in found(spark, [(1, text)], [("a", item)])] == [(700_040, 30, 1)]


def test_empty_tables(spark):
    assert found(spark, [], [("a", "b")]) == []
    assert found(spark, [(1, "a b")], []) == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


def test_spans_are_whole(spark):
    d = spark.createDataFrame([(1, "x " + " ".join(f"a{i}" for i in range(12)) + " y")], "doc_id long, text string")
    b = spark.createDataFrame([("q", " ".join(f"A{i}" for i in range(12)))], "item_id string, text string")
    row = dc.overlaps(d, b).first()
    assert [tuple(s) for s in row.spans] == [(1, 12)] and row["items"] == ["q"]

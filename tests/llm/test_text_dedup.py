"""Exact groups, near-duplicate classes and repeated passages against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tillview.llm import content_sort, exchange, fm_index, weighted_minhash
from tillview.llm.graph import components
from tillview.llm.words import groups_of, runs_inside, text_bytes, word_hashes, word_spans

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# words


def test_words_and_hashes_follow_the_bytes():
    import pyarrow as pa

    texts = ["", None, "a", " a  b\t\n", "é\x0bü\x0c x\r", "one two", "two", "\x85 \xa0", "x" * 50, "tail "]
    data, offsets = text_bytes(pa.chunked_array([texts[:4], texts[4:]]))
    starts, ends, first = word_spans(data, offsets)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert [words[a:b] for a, b in zip(first, first[1:])] == [WORD.findall(t or "") for t in texts]
    by_word = {}
    for word, key in zip(words, word_hashes(data, starts, ends).tolist()):
        assert by_word.setdefault(word, key) == key
    assert len(set(by_word.values())) == len(by_word)
    assert [t for a, b in groups_of(offsets, 3) for t in range(a, b)] == list(range(len(texts)))
    assert runs_inside(np.array([0, 2, 2, 5, 6]), 2).tolist() == [0, 2, 3]


# exact


def groups(rows):
    """doc_id, keep_id, group_size, kept, digest by hand."""
    by = {}
    for i, t in rows:
        by.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    out = []
    for t, ids in by.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return Counter(out)


def exact_rows():
    rng = random.Random(1)
    rows = [(i, f"copy  of{' ' * rng.randrange(1, 40)}one text\n{'x' * 200}") for i in range(0, 900, 3)]
    rows += [(i, f"text {i % 170}" + " y" * (i % 7)) for i in range(1, 900, 3)]
    rows += [(None, "text 1 y"), (None, None), (None, ""), (5, None), (5, None), (6, " "), (7, "\t\r\n"), (8, ""), (9, "z" * 100_000), (10, "z" * 100_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_exact_groups(docs, partitions):
    rows = exact_rows()
    got = content_sort.exact_groups(docs(rows).repartition(5), partitions=partitions).collect()
    assert Counter(tuple(r) for r in got) == groups(rows)


def test_unique_rows_keeps_whole_rows(docs):
    rows = exact_rows()
    df = docs(rows)
    got = content_sort.unique_rows(df.repartition(3), partitions=20)
    assert got.schema.simpleString() == df.schema.simpleString()
    kept = [r for r in got.collect()]
    assert Counter((r.doc_id, SPACE.sub(" ", r.text or "")) for r in kept) == Counter(
        {(i, t): 1 for i, t in {(min((x for x, y in rows if SPACE.sub(" ", y or "") == SPACE.sub(" ", t or "") and x is not None), default=None), SPACE.sub(" ", t or "")) for _, t in rows}}
    )
    assert {(r.lang, r.block) for r in kept} == {("en", "mine")}


def test_exact_groups_of_nothing(docs):
    assert content_sort.exact_groups(docs([])).collect() == []
    assert content_sort.unique_rows(docs([])).collect() == []


# components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, x) for x in range(4900, 5000)] + [(7, 7), (None, 3)]
    label = {}
    for a, b in edges:
        if a is not None:
            label.setdefault(a, a)
            label.setdefault(b, b)
    while True:
        before = dict(label)
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b}
    assert {k: v for k, v in got.items()} == {k: v for k, v in label.items() if k in got}
    assert set(label) - set(got) <= alone


# repeated passages


def without_repeats(rows, n):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - n + 1):
            if i is not None:
                first[tuple(w[k : k + n])] = min(i, first.get(tuple(w[k : k + n]), i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("size", [2_000, 1 << 24])
def test_repeats(docs, monkeypatch, size):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", size)
    rng = random.Random(5)
    passages = [prose(rng, rng.randrange(13, 60)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randrange(0, 50))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng, rng.randrange(0, 20))]
        rows.append((i, rng.choice([" ", "\n ", "\t"]).join(parts)))
    rows += [(i, passages[0] + " " + passages[1]) for i in range(200, 240)]  # a hot passage
    rows += [(300, "a " * 40), (301, "a " * 41), (302, "a " * 12), (303, None), (304, ""), (None, passages[0]), (None, None), (200, passages[2]), (200, passages[2]), (305, "é " * 30), (306, "ü é " * 30 + "é " * 20)]
    rng.shuffle(rows)
    got = fm_index.repeats(docs(rows).repartition(4)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == without_repeats(rows, 13)
    for r in got:
        assert sum(s.words for s in r.spans) == r.n_removed
        assert hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == r.kept_sha256


def test_repeats_of_nothing(docs):
    assert fm_index.repeats(docs([])).collect() == []
    assert sorted(tuple(r)[:3] for r in fm_index.repeats(docs([(1, None), (2, "")])).collect()) == [(1, 0, 0), (2, 0, 0)]


def test_matching_statistics():
    rng = np.random.default_rng(0)
    for symbols, reach in ((2, 13), (5, 13), (40, 4)):
        texts = [rng.integers(1, symbols + 1, rng.integers(1, 60)) for _ in range(30)]
        flat = np.concatenate([np.append(t, 0) for t in texts])
        index = fm_index.FMIndex(flat, reach)
        asked = [rng.integers(1, symbols + 2, rng.integers(1, 40)) for _ in range(15)] + texts
        inside = {tuple(t[i : i + m]) for t in texts for i in range(len(t)) for m in range(1, reach + 1)}
        for text, (length, row) in zip(asked, index.statistics(asked, reach)):
            for i in range(len(text)):
                m = 0
                while m < min(reach, len(text) - i) and tuple(text[i : i + m + 1]) in inside:
                    m += 1
                assert m == length[i]
                at = index.suffix[row[i]]
                assert (flat[at : at + m] == text[i : i + m]).all()


# near duplicates


def classes(rows, least=0.8, n=5, strength=0.25):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append(Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else []))
    df, total = Counter(s for c in sets for s in c), len(rows)
    weight = [{s: (1 + math.log(f)) * (1 + strength * math.log((1 + total) / (1 + df[s])) / math.log(1 + total)) for s, f in c.items()} for c in sets]
    label = {i: i for i, _ in rows if i is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not weight[a] or not weight[b]:
                continue
            common = sum(min(w, weight[b][s]) for s, w in weight[a].items() if s in weight[b])
            if common / (sum(weight[a].values()) + sum(weight[b].values()) - common) >= least:
                x, y = root(rows[a][0]), root(rows[b][0])
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in label}


@pytest.mark.parametrize(("size", "group"), [(3_000, 1 << 24), (1 << 24, 6_000)])
def test_near_duplicates(docs, monkeypatch, size, group):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", size)
    monkeypatch.setattr(weighted_minhash, "GROUP_BYTES", group)  # else cut into tiles
    rng = random.Random(7)
    rows, i = [], 0
    base = [prose(rng, rng.randrange(20, 160), 3000) for _ in range(12)]
    for t in base:
        for _ in range(rng.randrange(1, 9)):
            w = t.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((i := i + 1, " ".join(w)))
    hot = prose(rng, 200, 3000).split()
    for k in range(60):  # a large group whose members drift apart
        hot[rng.randrange(len(hot))] = f"d{k}"
        rows.append((i := i + 1, " ".join(hot)))
    rows += [(i + 1, "a b c"), (i + 2, "a b c"), (i + 3, "a b"), (i + 4, "a  b\n"), (i + 5, None), (i + 6, ""), (None, base[0]), (None, None), (i + 7, base[1]), (i + 7, base[1]), (i + 8, "q " * 300), (i + 9, "q " * 301)]
    rng.shuffle(rows)
    got = weighted_minhash.near_duplicates(docs(rows).repartition(4)).collect()
    want = classes(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in got)
    sizes = Counter(want[j] for j, _ in rows if j is not None)
    assert all(r.class_size == (1 if r.doc_id is None else sizes[r.class_id]) for r in got)
    assert weighted_minhash.near_duplicates(docs([])).collect() == []


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(2)
    sampler = weighted_minhash.Sampler(3000)
    keys, weights = np.sort(rng.integers(0, 2**56, 300).astype(np.uint64)), rng.uniform(1, 3, 300)
    for a, b, factor in ((0, 40, 1.0), (0, 150, 1.0), (0, 10, 1.4)):
        one, two = (keys[a:250], weights[a:250]), (keys[b:300], weights[b:300] * factor)
        drawn = [sampler.draw(k, w, np.array([0, len(k)])) for k, w in (one, two)]
        assert abs((drawn[0] == drawn[1]).mean() - weighted_minhash.similarity(one, two)) < 0.04

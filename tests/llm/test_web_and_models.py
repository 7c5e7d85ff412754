"""URL verdicts, archives, the quality model and vector links against brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tillview.llm import cover_tree, gam, host_reputation, warc

# url filter


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    stop = min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))
    return host, tail[:stop]


def rule(host, path):
    fits = []
    for what, r in host_reputation.RULES:
        base, start = r.split("/", 1)
        if (host == base or host.endswith("." + base)) and path.startswith("/" + start):
            fits.append((len(r), r, what))
    return max(fits)[1:] if fits else (None, None)


def verdicts(pages, labels):
    """The method written out with dictionaries."""
    good = {}
    for d, q, t in labels:
        if d is not None and q is not None:
            good[d] = min(good.get(d, 1), int(q == 1 and t != 1))
    import re

    hosts = {}
    for _, url in pages:
        host, path = host_path(url)
        m = re.search(r"/([0-9]{1,18})(?:\.[A-Za-z0-9]+)?/?$", path)
        if m and int(m[1]) in good:
            n, x = hosts.get(host, (0, 0))
            hosts[host] = n + 1, x + good[int(m[1])]
    up = {"host": lambda h: ".".join(h.split(":")[0].split(".")[-2:]), "domain": lambda d: d.split(".")[-1]}
    total = sum(n for n, _ in hosts.values())
    prior = {None: sum(x for _, x in hosts.values()) / total} if total else {}
    domains, suffixes = {}, {}
    for h, (n, x) in hosts.items():
        for table, key in ((domains, up["host"](h)), (suffixes, up["domain"](up["host"](h)))):
            a, b = table.get(key, (0, 0))
            table[key] = a + n, b + x
    for table, parent in ((suffixes, lambda k: None), (domains, up["domain"]), (hosts, up["host"])):
        excess = sum((x - n * prior[parent(k)]) ** 2 - n * prior[parent(k)] * (1 - prior[parent(k)]) for k, (n, x) in table.items())
        room = sum(n * (n - 1) * prior[parent(k)] * (1 - prior[parent(k)]) for k, (n, x) in table.items())
        strength = 1 / min(0.5, max(0.0001, excess / room if room else 0.0001)) - 1
        post = {k: ((x + strength * prior[parent(k)]) / (n + strength), n + strength) for k, (n, x) in table.items()}
        prior = {k: m for k, (m, _) in post.items()}
    bad = {h for h, (m, w) in post.items() if m + 1.645 * (m * (1 - m) / (w + 1)) ** 0.5 < 0.5} if total else set()
    out = []
    for i, url in pages:
        host, path = host_path(url)
        r, what = rule(host, path)
        out.append((i, host, path, r, what or ("block" if host in bad else "allow")))
    return Counter(out)


def test_urls(spark):
    rng = random.Random(1)
    pages, labels = [], []
    for i in range(2000):
        host = rng.choice(["A.Example.com", "b.example.com", "spam.example.org", "Spam.example.org:80", "x.org", "net", "q.net", "notnet", "one.co.uk", "two.co.uk", "EXAMPLE.net"] + ["hot.example.com"] * 8)
        pages.append((i, f"http://{host}/{rng.choice(['de', 'fr', 'en', 'DE'])}/{i}{rng.choice(['', '.html', '/', '?p=1', '#x', '/#'])}"))
        if rng.random() < 0.5:
            bad = "spam" in host.lower() or rng.random() < 0.1
            labels.append((i, int(not bad), int(rng.random() < 0.05)))
    pages += [(None, None), (5000, ""), (5001, "://"), (5002, "x://y"), (5003, "mailto:x"), (5004, "http://?/de/1"), (5005, "HTTP://É.ORG/fr/ü"), (5006, "a://b://c/d"), (5007, "http://q.net"), (3, pages[3][1]), (3, pages[3][1]), (5008, "http://x/99999999999999999999")]
    labels += [(None, 1, 0), (4, None, 0), (5, 1, None), (5, 0, 0), (10**6, 1, 0)]
    table = spark.createDataFrame([(i, u, "x", "y") for i, u in pages], "page_id long, url string, host string, good string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = host_reputation.judge(table.repartition(4), marks)
    want = verdicts(pages, labels)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {v for *_, r, v in want if r is None} == {"allow", "block"}
    assert host_reputation.judge(table.limit(0), marks).collect() == []


def test_urls_without_labels_are_allowed(spark):
    table = spark.createDataFrame([(1, "http://a.com/x/1")], "page_id long, url string")
    got = host_reputation.judge(table, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert [tuple(r) for r in got] == [(1, "a.com", "/x/1", None, "allow")]


# archives


def archived(pages):
    top = {}
    for i, _, h in pages:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        other = i is not None and i < top[h or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if other else "response", top[h or ""] if other else None))
    return Counter(out)


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_archives_round_trip(spark, monkeypatch, chunk):
    rng = random.Random(2)
    texts = ["", None, "é" * 5000, "\r\n\r\nWARC/1.1\r\n", "x\r\n\r\ny", "short", "z" * 300_000] + ["hot"] * 20
    pages = [(i, rng.choice(["http://a/b", None, "http://x/\r\ny", "http://é"]), rng.choice(texts)) for i in range(300)]
    pages += [(None, None, None), (None, "u", "hot"), (7, "u", "same"), (7, "u", "same"), (6, "u", "same")]
    if chunk == 7:
        pages = [p for p in pages if len(p[2] or "") < 300_000]
    table = spark.createDataFrame([(i, u, h, "k") for i, u, h in pages], "page_id long, url string, html string, sha1 string")
    rows = table.repartition(5)
    monkeypatch.setattr(warc, "_BUFFER", 1000)
    monkeypatch.setattr(warc, "CHUNK", chunk)
    manifest = warc.write_pages(spark, rows)
    chunks = warc.read_archives(manifest, chunk)
    assert Counter(tuple(r) for r in warc.by_page(chunks).collect()) == archived(pages)
    held = {}
    for r in chunks.collect():
        held.setdefault((r.record_id, r.page_id, r.record_type, r.refers_to), []).append(r)
        assert len(r.bytes) <= chunk
    whole = {(i, hashlib.sha1((h or "").encode()).digest()) for i, _, h in pages}
    for (_, page, kind, _), parts in held.items():
        if kind == "response" and len({p.chunk for p in parts}) == len(parts):
            parts.sort(key=lambda p: p.chunk)
            sha, n = hashlib.sha1(), 0
            for p in parts:
                sha.update(p.bytes)
                n += len(p.bytes)
                assert (p.so_far, p.digest_so_far) == (n, base64.b32encode(sha.digest()).decode())
            assert (page, sha.digest()) in whole
    assert manifest.agg(F.sum("records")).first()[0] == len(pages)
    empty = warc.write_pages(spark, table.limit(0))
    assert empty.collect() == [] and warc.read_archives(empty).collect() == []


def test_small_payloads_do_not_revisit(spark):
    table = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = warc.by_page(warc.read_archives(warc.write_pages(spark, table, min_bytes=3))).collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: 4, 4: None}


# quality model


def quality_rows(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(300)}" for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.3
        if bad:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else words[:2] * 30
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality_is_learnt(spark, docs):
    rows, labels = quality_rows(1200)
    rows += [(None, "a b c"), (None, None), (5000, ""), (5000, ""), (5001, "x " * 20_000), (5002, " \n\t")]
    marks = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (9999, 1, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = gam.classify(docs(rows).repartition(3), marks).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels}
    asked = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in asked]) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    again = gam.classify(docs(rows), spark.createDataFrame(turned, "doc_id long, quality int, toxic int")).collect()
    assert sorted((r.doc_id or -1, r.score) for r in again) == sorted((r.doc_id or -1, r.score) for r in got)  # held-out labels have no say
    model = gam.train(docs(rows), marks)
    kept = gam.keep(docs(rows), model)
    assert kept.columns == ["doc_id", "text", "lang", "block"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.predicted)
    x = gam.measures(*_bytes([t or "" for _, t in rows]))
    assert (gam.Model.from_json(model.to_json()).score(x) == model.score(x)).all()


def _bytes(texts):
    import pyarrow as pa

    return gam.text_bytes(pa.array(texts))


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in gam.classify(docs([(1, "a"), (2, None)]), none).collect()} == {0.5}
    assert gam.classify(docs([]), none).collect() == []


def test_pairs_of_measures_matter():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] > 0) == (x[:, 1] > 0)).astype(float)  # no measure says anything alone
    model = gam.fit(x[:3000], y[:3000], bins=16, rounds=20)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert (0, 1) in model.double


def test_measures_by_hand():
    (row,) = gam.measures(*_bytes(["The CAT the cat, the 12!\nthe end"]))
    got = dict(zip(gam.MEASURES, row))
    assert got["log_words"] == np.log1p(8) and got["distinct_words"] == 7 / 8 - 1 / 8 and got["distinct_lines"] == 1
    assert got["digits"] == 2 / 32 and got["shouts"] == 1 / 32 and got["upper"] == 4 / 32 and got["capital_words"] == 2 / 8 and got["common_words"] == 3 / 8
    assert gam.measures(*_bytes(["", " "])).shape == (2, len(gam.MEASURES)) and np.isfinite(gam.measures(*_bytes(["", " "]))).all()


# vectors


def linked(rows, least=0.95):
    good = [(k, i, np.array(v, np.float32).astype(float)) for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    n, label = [0] * len(rows), {i: i for i, _ in rows if i is not None}
    pairs = [(a, b) for x, a in enumerate(good) for b in good[:x] if len(a[2]) == len(b[2]) and a[2] @ b[2] / np.sqrt((a[2] @ a[2]) * (b[2] @ b[2])) >= least]
    for a, b in pairs:
        n[a[0]] += 1
        n[b[0]] += 1
    while True:
        before = dict(label)
        for a, b in pairs:
            label[a[1]] = label[b[1]] = min(label[a[1]], label[b[1]])
        if before == label:
            break
    return Counter((i, c, label.get(i), i is not None and label[i] == i) for (i, _), c in zip(rows, n))


@pytest.mark.parametrize("block", [40, 4096])
def test_links(spark, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    rows = [(int(i), (base[rng.integers(0, 30)] + rng.normal(size=8) * rng.choice([0, 0.05, 0.2])).tolist()) for i in rng.permutation(300)]
    rows += [(1000 + i, base[0].tolist()) for i in range(60)] + [(2000 + i, (base[1] * (i + 1)).tolist()) for i in range(5)]
    rows += [(3000, None), (3001, [0.0] * 8), (3002, [float("nan")] + [1.0] * 7), (3003, [None] + [1.0] * 7), (3004, [float("inf")] * 8), (3005, []), (3006, [1.0, 2.0]), (3007, [1.0, 2.0]), (3008, [2.0, 1.0]), (None, base[0].tolist()), (None, None), (1000, base[0].tolist()), (5, base[2].tolist()), (3009, [1e-30] + [0.0] * 7), (3010, [3e30] + [0.0] * 7)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, rep int")
    got = cover_tree.links(table.repartition(3), block=block).collect()
    assert Counter(tuple(r) for r in got) == linked(rows)
    assert cover_tree.links(table.limit(0)).collect() == []


@pytest.mark.parametrize("least", [0.8, 0.95, 0.99])
@pytest.mark.parametrize("cells", [1 << 10, 1 << 21])
def test_walk_finds_every_link(monkeypatch, least, cells):
    monkeypatch.setattr(cover_tree, "_CELLS", cells)
    rng = np.random.default_rng(int(least * 100))
    base = rng.normal(size=(10, 8))
    for x in (rng.normal(size=(300, 3)), rng.normal(size=(200, 16)), base[rng.integers(0, 10, 300)] + rng.normal(size=(300, 8)) * 0.15, base[rng.integers(0, 2, 300)] + rng.normal(size=(300, 8)) * 0.01, np.repeat(base, 3, axis=0), base[:1]):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        weight = rng.integers(1, 4, len(x))
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        found = cover_tree.Links(weight)
        cut = len(x) // 3
        if cut:
            first, (order, levels) = cover_tree.build(x[:cut]), cover_tree.build(x[cut:])
            for level in levels:
                level.centre = level.centre + cut
            for one, two in ((first, (order + cut, levels)), (first, None), ((order + cut, levels), None)):
                cover_tree.walk(x, one, two, found, least)
        else:
            cover_tree.walk(x, cover_tree.build(x), None, found, least)
        assert (found.count == near @ weight).all()
        assert (found.label[np.nonzero(near)[0]] == found.label[np.nonzero(near)[1]]).all()


def test_tree_covers_its_points():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order, levels = cover_tree.build(x)
    assert sorted(order.tolist()) == list(range(500)) and len(levels[-1].low) == 500
    for depth, level in enumerate(levels):
        for c, r, a, b in zip(level.centre, level.radius, level.low, level.high):
            assert np.sqrt(np.maximum(0, 2 - 2 * x[order[a:b]] @ x[c])).max() <= r + 1e-7
            assert r <= 2.0 ** (1 - depth) + 1e-7


def test_links_in_double_precision(spark):
    """Cosines a little above and below the threshold, too near it for single precision."""
    rows = []
    for i, c in enumerate((0.95 + 1e-10, 0.95 - 1e-10, 0.95 + 1e-9, 0.95 - 1e-9)):
        axis = [0.0] * 8
        axis[2 * i] = 1.0
        other = [0.0] * 8
        other[2 * i], other[2 * i + 1] = c, float(np.sqrt(1 - c * c))
        rows += [(2 * i, axis), (2 * i + 1, other)]
    got = {r.vec_id: r.n_links for r in cover_tree.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1, 5: 1, 6: 0, 7: 0}

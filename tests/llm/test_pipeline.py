"""The pipeline stage by stage against brute force, and what the entry file does without the subpackage."""

import hashlib
import os
import random
import shutil
import subprocess
import sys
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_text_dedup import SPACE, WORD, classes, prose, without_repeats
from test_web_and_models import quality_rows
from tillview.llm import gam, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "block", "c0", "kept", "text_sha256"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents and labels: junk, copies, near copies, shared passages, nulls, clashing columns."""
    rng = random.Random(11)
    rows, labels = quality_rows(500, seed=5)
    docs = dict(rows)
    passage = prose(rng, 60)
    at = 1000
    for i in range(40):
        docs[at + i] = prose(rng, 30) + "\n" + passage + " " + prose(rng, 25)
    for i in range(30):
        docs[at + 100 + i] = docs[rng.choice(sorted(docs)[:400])].replace(" ", rng.choice([" ", "  ", "\n"]))
    base = prose(rng, 150).split()
    for i in range(20):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"n{i}"
        docs[at + 200 + i] = " ".join(w)
    docs |= {at + 300: None, at + 301: "", at + 302: "one two", at + 303: "one  two"}
    rows = [(i, t, "en", "s", len(t or ""), "b", 1.5, i % 2 == 0, "x") for i, t in docs.items()] + [(None, prose(rng, 40), None, None, None, None, None, None, None)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block string, c0 double, kept boolean, text_sha256 string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "passages", "pack"]
    kept = []
    for i, (_, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, docs, tables)
        if i < 4:
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{i}")
        kept.append(docs)
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    first, good, unique, apart, left = kept
    scored = gam.classify(first, labels)
    assert Counter(i for i, _ in pairs(good)) == Counter(r.doc_id for r in scored.where("predicted = 1").collect())
    assert 0 < good.count() < first.count()

    by = defaultdict(list)
    for i, t in pairs(good):
        by[SPACE.sub(" ", t or "")].append(i)
    assert Counter(i for i, _ in pairs(unique)) == Counter(min((x for x in g if x is not None), default=None) for g in by.values())
    assert unique.count() < good.count()

    rows = pairs(unique)
    label = classes(rows)
    assert Counter(i for i, _ in pairs(apart)) == Counter(i for i, _ in rows if i is None or label[i] == i)
    assert apart.count() < unique.count()

    want = without_repeats(pairs(apart), 13)
    got = Counter()
    before = dict(pairs(apart))
    for r in left.collect():
        words = WORD.findall(r.text or "")
        total = len(WORD.findall(before[r.doc_id] or ""))
        got[r.doc_id, total, total - len(words), hashlib.sha256(" ".join(words).encode()).hexdigest()] += 1
        if total == len(words):
            assert r.text == before[r.doc_id]
        elif r.doc_id is not None:
            assert r.n_chars == len(r.text)
    assert got == want and any(k[2] for k in want)
    assert left.agg(F.count("c0")).first()[0] == left.where("doc_id IS NOT NULL").count()

    places = defaultdict(list)
    packed = docs.collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, _ in pairs(left))
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 4096


def test_run_is_the_stages_in_order(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, tables)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(r) for r in got.select(key).collect()) == Counter(tuple(r) for r in docs.select(key).collect())


def test_stages_of_nothing(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, tables).collect() == []


def test_every_query_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_entry_without_the_subpackage(tmp_path):
    """The other queries are there when the text operators and the pipeline file are not."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = tmp_path / "repo"
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cust_rfm_table' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
    (copy / "tillview" / "llm" / "__pycache__").mkdir(parents=True)  # what is left of a deleted folder
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr

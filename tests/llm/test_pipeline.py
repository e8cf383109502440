"""The pipeline's stages, each on what its predecessor kept, against brute force; and every query of SQL against DuckDB."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelane.llm import mixing, queries, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output as rows, with a few odd rows put before the documents."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("length(text) > 300").orderBy("doc_id").limit(1)
    odd = first.withColumn("doc_id", F.lit(-5).cast("long")).unionByName(first.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(first.withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id < 3"))
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(f"{base}/{name}-in")
        given = spark.read.parquet(f"{base}/{name}-in")
        out = stage(spark, given, SF)
        out.write.parquet(f"{base}/{name}-out")
        docs = spark.read.parquet(f"{base}/{name}-out")
        if name != "sharding":
            assert docs.columns == given.columns
        found[name] = ([r.asDict() for r in given.collect()], [r.asDict() for r in docs.collect()])
    return found


def keys(rows):
    return Counter((str(r["doc_id"]), r["text"]) for r in rows)


def test_toxicity_stage(spark, stages):
    given, kept = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = {r.doc_id: r.toxic for r in labels.where(toxicity.in_training(F.col("doc_id"))).collect() if r.toxic is not None}
    texts = defaultdict(set)
    for r in given:
        texts[r["doc_id"]].add(r["text"])
    train = [(i, next(iter(texts[i])), t) for i, t in sorted(ids.items()) if i in texts]
    model = toxicity.train(pa.array([t for _, t, _ in train]), np.array([t for *_, t in train]))
    kernel = toxicity.TextKernel("symbol", lower=True)
    scores = np.concatenate([toxicity.score_texts(kernel, model, b, o) for _, _, b, o in toxicity.text_slices(pa.array([r["text"] for r in given]))])
    assert keys(kept) == keys([r for r, s in zip(given, scores) if s < 0.5])


def shingles(text):
    w = SPACE.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_stage(stages):
    given, kept = stages["jaccard_join"]
    sets = [shingles(r["text"]) for r in given]
    root = list(range(len(given)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(given)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for i, r in enumerate(given):
        groups[find(i) if sets[i] else ("blank", r["doc_id"])].append(r)
    firsts = [min((x["doc_id"] is None, x["doc_id"] or 0) for x in g) for g in groups.values()]
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == Counter(firsts)
    assert keys(kept) <= keys(given)


def test_decontamination_stage(spark, stages):
    given, kept = stages["decontamination"]
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = NORMAL.findall((r.text or "").translate(LOWER))
        k = min(13, len(w))
        for i in range(len(w) - k + 1) if w else ():
            windows[k].add(tuple(w[i : i + k]))
    clean = []
    for r in given:
        w, hit = NORMAL.findall((r["text"] or "").translate(LOWER)), set()
        for k, known in windows.items():
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in known:
                    hit |= set(range(i, i + k))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(r)
    assert keys(kept) == keys(clean)


def test_mixing_stage(stages):
    given, kept = stages["mixing"]
    size = lambda rows: {s: sum(len(SPACE.findall(r["text"] or "")) for r in rows if r["source"] == s) for s in {r["source"] for r in given}}
    have, taken = size(given), size(kept)
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(have, key=lambda s: (s is None, s or "")))}
    target, open_ = {}, dict(have)
    budget = sum(have.values())
    while True:  # shares by weight; what exceeds three times a source is shared among the others
        level = (budget - sum(target.values())) / max(1, sum(weights[s] for s in open_))
        full = [s for s in open_ if level * weights[s] > 3 * have[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * have[s]
            del open_[s]
    target |= {s: level * weights[s] for s in open_}
    longest = {s: max(len(SPACE.findall(r["text"] or "")) for r in given if r["source"] == s) for s in have}
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6 for s in have)
    before, after = keys(given), keys(kept)
    assert all(n <= 3 * before[k] for k, n in after.items())


def test_sharding_stage(stages):
    given, dealt = stages["sharding"]
    assert keys(given) == keys(dealt)
    slots = defaultdict(list)
    for r in dealt:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert [r["doc_id"] for r in sorted(dealt, key=lambda r: (r["shard"], r["slot"]))] != sorted((r["doc_id"] for r in dealt), key=lambda x: (x is None, x))


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    assert got == sorted(tuple(plain(v) for v in r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall())


def test_mixing_weights_follow_labels(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, quality int")
    assert {r.doc_id: r.quality_weight for r in mixing.label_weights(labels).collect()} == {1: 2.0, 2: 0.5}

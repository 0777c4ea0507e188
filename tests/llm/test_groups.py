"""Operators 6 and 10 and the pipeline against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltgrain.llm import ann, near_dedup
from siltgrain.llm.common import Scratch


def weighted_groups(texts):
    """Class of each text by comparing all pairs with exact document frequencies."""
    bags = []
    for t in texts:
        w = t.lower().split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(s for b in bags for s in b)
    n = len(texts)
    weight = [{s: (1 + math.log(c)) * (1 + near_dedup.IDF_SHARE * math.log(n / df[s]) / math.log(n)) for s, c in b.items()} for b in bags]
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = weight[i], weight[j]
            if a and b:
                low = sum(min(x, b[s]) for s, x in a.items() if s in b)
                if low >= 0.8 * (sum(a.values()) + sum(b.values()) - low):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def make_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 150))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 30])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_near_duplicates(spark):
    texts = [*make_texts(1), "", "  \n", "short", "short", "Short", "one two three", "one two three four five six", "ONE two three four five six"]
    rows = [(i, t, i, "k") for i, t in enumerate(texts)] + [(None, "short", 0, "k"), (5, texts[5], 5, "k"), (900, None, 0, "k"), (901, None, 0, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int, `a.b` string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert sorted(got) == [*range(len(texts)), 900, 901]
    assert [got[i] for i in range(len(texts))] == weighted_groups(texts) and got[900] == 900 and got[901] == 901
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({*got.values()}) and ids.count(None) == 1
    assert near_dedup.classes(docs.limit(0)).count() == 0 == near_dedup.keep_one(docs.limit(0)).count()


def test_texts_that_stars_leave_apart(spark):
    """With one bucket for all, what the centre misses must be found by the comparison of what is left."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(120)]
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(120)] = f"new{rng.random()}"
        rows.append((i, " ".join(base if i == 17 else copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert [got[i] for i in range(40)] == weighted_groups([t for _, t in rows])


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    common, own = [[f"w{rng.integers(10**9)}" for _ in range(n)] for n in (900, 300)]
    texts = [" ".join(common + own[:150]), " ".join(common + own[150:])]
    raw = [t.encode() for t in texts]
    s = near_dedup.Shingled(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])]))
    sketch = np.zeros((near_dedup.DEPTH, 1 << near_dedup.WIDTH), np.int64)
    for d, c in enumerate(near_dedup.cells(s.hash)):
        np.add.at(sketch[d], c, 1)
    w = near_dedup.weights(s, sketch, 2)
    found = near_dedup.samples(s, w)
    a, b = ((s.hash[i:j], w[i:j]) for i, j in zip(s.bounds[:-1], s.bounds[1:], strict=True))
    assert abs((found[0] == found[1]).mean() - near_dedup.similarity(a, b)) < 0.2


def test_more_links_join_components(spark):
    rng = random.Random(2)
    links = [tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)]
    first, more = (spark.createDataFrame(x, "a long, b long") for x in (links[:25], links[25:]))
    scratch = Scratch(spark)
    once = near_dedup.components(first.unionByName(more), scratch, "all")
    twice = near_dedup.joined(near_dedup.components(first, scratch, "some"), more, scratch, "more")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_frequent_shingles_stand_out_of_a_full_sketch():
    """Ten times as many rare shingles as cells: these count as one, a frequent one within the cells' deviations."""
    rng = np.random.default_rng(6)
    sketch = rng.poisson(10, (near_dedup.DEPTH, 1 << 16)).astype(np.int64)
    sketch[:, 5] += 5000
    clean = near_dedup.without_noise(sketch)
    low = clean.min(0)
    assert abs(low[5] - 5000) < 30 and (np.delete(low, 5) == 0).mean() > 0.9999
    assert (near_dedup.without_noise(np.array([[0, 0, 0, 2, 1]])) == [[0, 0, 0, 2, 1]]).all()


def brute(ids, vectors, queries, k=5):
    unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
    out = {}
    for i in queries:
        s = unit @ unit[i]
        order = np.lexsort((ids, -s.round(12)))
        out[ids[i]] = [int(ids[j]) for j in order if j != i][:k]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(8)
    n = 3000
    vectors = rng.normal(size=(n, 24)).astype(np.float32)
    vectors[1000:1600] = vectors[50]
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(vectors)]
    odd = [(10_000, None, 1), (10_050, [], 1), (10_100, [0.0] * 24, 1), (10_150, [None] + [1.0] * 23, 1), (10_200, [float("nan")] * 24, 1), (10_250, [float("inf")] * 24, 1), (None, [1.0] * 24, 1), (50, vectors[50].tolist(), 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int").repartition(3)
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r
    assert sorted(got) == list(range(0, n, 50)) and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    want = brute(np.arange(n), vectors.astype(float), range(0, n, 50))
    assert np.mean([v[k].vec_id in want[q] for q, v in got.items() for k in v]) >= 0.9
    assert [got[50][k].vec_id for k in range(1, 6)] == [1000, 1001, 1002, 1003, 1004]
    for q, v in got.items():
        for r in v.values():
            a, b = vectors[q].astype(float), vectors[r.vec_id].astype(float)
            assert r.score == pytest.approx(a @ b / math.sqrt((a @ a) * (b @ b)), abs=1e-12)


def test_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 2.0]), (50, [3.0, 3.0]), (7, [1.0, 0.0, 0.0]), (100, [1e200, 1e-200])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(table, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 100), (0, 2, 50), (0, 3, 2), (0, 4, 1), (50, 1, 0), (50, 2, 2), (50, 3, 100), (50, 4, 1), (100, 1, 0), (100, 2, 50), (100, 3, 2), (100, 4, 1)]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "secret_scan", "best_fit_packing"]
    sf, docs = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        now = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and now <= before
        if name == "quality_classifier":
            assert not [i for i in before - now if labels.get(i) == 1]
        if name == "secret_scan":
            assert now == before
        before = now
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == before
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 2048 for v in by.values())


def test_pairs_left_apart_are_verified_whatever_their_samples(spark):
    """Three texts of one bucket without a single equal sample: two are near copies, the third is not."""
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, f"{long} end"), (2, f"{long} other"), (3, " ".join(f"v{i}" for i in range(200)))]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = near_dedup._Sketch(spark, near_dedup._count(texts).collect(), 3)
    inside = spark.createDataFrame([(0, 7, i, i, 3, 3) for i in (1, 2, 3)], "band int, bucket long, doc_id long, class long, main long, a long")
    low = [(i, [7] + [i] * (near_dedup.BANDS - 1), bytes([i, 0] * near_dedup.BANDS * near_dedup.ROWS)) for i in (1, 2, 3)]
    sampled = spark.createDataFrame(low, "doc_id long, bands array<long>, low binary")
    assert [tuple(r) for r in near_dedup._rest_links(inside, sampled, texts, sketch, Scratch(spark)).collect()] == [(1, 2)]

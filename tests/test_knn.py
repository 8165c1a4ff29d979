import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import knn, tuning
from flowsentry.operators.sampling import assign_folds


def brute(train, queries, k):
    """[(distance squared, id, label)] of the k nearest, by full comparison."""
    found = {}
    for qid, q in queries:
        q64 = np.asarray(q, np.float32).astype(np.float64)
        rows = []
        for i, label, x in train:
            d2 = 0.0
            for diff in q64 - np.asarray(x, np.float32).astype(np.float64):
                d2 += diff * diff
            rows.append((float(d2), i, label))
        found[qid] = sorted(rows)[:k]
    return found


def frames(spark, train, queries):
    t = spark.createDataFrame(train, "id long, label int, features array<float>")
    q = spark.createDataFrame(queries, "id long, features array<float>")
    return t, q


def points(rng, n, width, kind):
    if kind == "spread":
        return rng.random((n, width))
    if kind == "grid":  # many ties
        return rng.integers(0, 4, (n, width)) / 4
    x = rng.random((n, width))  # a third of all rows are one point
    x[: n // 3] = 0.5
    return x


@pytest.mark.parametrize("kind", ["spread", "grid", "hot"])
@pytest.mark.parametrize("block_rows", [16, 100_000])
def test_search_equals_brute_force(spark, kind, block_rows):
    rng = np.random.default_rng(7)
    train = [(int(i), int(rng.integers(2)), [float(v) for v in x]) for i, x in enumerate(points(rng, 400, 4, kind))]
    queries = [(1000 + i, [float(v) for v in x]) for i, x in enumerate(points(rng, 90, 4, kind))]
    t, q = frames(spark, train, queries)
    index = knn.KnnIndex.fit(t, "id", 7, block_rows=block_rows)
    assert (len(index.flat.names) > 4) == (block_rows == 16)
    got = {r.qid: [(h.d2, h.id, h.label) for h in r.nn] for r in index.search(q, "id", 7).collect()}
    assert got == brute(train, queries, 7)


def test_two_levels_give_the_same_answer(spark, monkeypatch):
    monkeypatch.setattr(knn, "FLAT_BOXES", 0)
    monkeypatch.setattr(knn, "TOP_LEAVES", 5)
    rng = np.random.default_rng(8)
    train = [(int(i), int(rng.integers(2)), [float(v) for v in x]) for i, x in enumerate(points(rng, 600, 3, "spread"))]
    queries = [(1000 + i, [float(v) for v in x]) for i, x in enumerate(points(rng, 70, 3, "grid"))]
    t, q = frames(spark, train, queries)
    index = knn.KnnIndex.fit(t, "id", 6, block_rows=16)
    assert index.flat is None and len(index.leaves.names) <= 5
    sizes = [r.n for r in index.blocks.select("n").collect()]
    assert max(sizes) < 32 and len(sizes) > 18
    got = {r.qid: [(h.d2, h.id, h.label) for h in r.nn] for r in index.search(q, "id", 6).collect()}
    assert got == brute(train, queries, 6)


def test_home_block_below_k(spark):
    rng = np.random.default_rng(9)
    train = [(int(i), 0, [float(v) for v in x]) for i, x in enumerate(points(rng, 60, 2, "spread"))]
    queries = [(i, [0.1 * i, 0.5]) for i in range(8)]
    t, q = frames(spark, train, queries)
    got = {r.qid: [(h.d2, h.id, h.label) for h in r.nn] for r in knn.KnnIndex.fit(t, "id", 21, 4).search(q, "id").collect()}
    assert got == brute(train, queries, 21)


def test_repeated_null_and_text_keys(spark):
    train = spark.createDataFrame(
        [("b", 0, [0.0, 0.0]), ("a", 1, [0.0, 0.0]), (None, 1, [1.0, 1.0]), ("c", 0, [1.0, 1.0])],
        "id string, label int, features array<float>")
    queries = spark.createDataFrame(
        [("x", [0.0, 0.0]), ("x", [1.0, 1.0]), (None, [0.0, 0.1]), (None, [1.0, 0.9])], "id string, features array<float>")
    votes = knn.knn_predict(train, queries, "id", 1).collect()
    assert sorted((str(r.qid), r.prediction) for r in votes) == [("None", 1), ("None", 1), ("x", 1), ("x", 1)]
    rows = knn.knn_topk(train, queries, "id", 2).collect()
    assert sorted((str(r.qid), r["rank"], str(r.id), r.label) for r in rows) == [
        ("None", 1, "None", 1), ("None", 1, "a", 1), ("None", 2, "b", 0), ("None", 2, "c", 0),
        ("x", 1, "None", 1), ("x", 1, "a", 1), ("x", 2, "b", 0), ("x", 2, "c", 0)]
    numbers = spark.createDataFrame([(None, 1, [0.0]), (5, 0, [1.0])], "id long, label int, features array<float>")
    asked = spark.createDataFrame([(7, [0.0]), (7, [1.0])], "id long, features array<float>")
    shares = sorted(r.share for r in knn.knn_predict(numbers, asked, "id", 1).collect())
    assert shares == [0.0, 1.0]
    assert {r.id for r in knn.knn_topk(numbers, asked, "id", 1).collect()} == {None, 5}


def test_busy_blocks_are_copied(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES_PER_COPY", 5)
    rng = np.random.default_rng(3)
    train = [(i, i % 2, [float(v) for v in x]) for i, x in enumerate(rng.random((60, 2)))]
    queries = [(i, [0.5, 0.5]) for i in range(40)]
    t, q = frames(spark, train, queries)
    got = {r.qid: [(h.d2, h.id, h.label) for h in r.nn] for r in knn.KnnIndex.fit(t, "id", 3, 16).search(q, "id").collect()}
    assert got == brute(train, queries, 3)


def test_fewer_rows_than_neighbours(spark):
    t, q = frames(spark, [(1, 1, [0.0]), (2, 0, [1.0])], [(9, [0.2])])
    row = knn.KnnIndex.fit(t, "id", 5).search(q, "id").head()
    assert [h.id for h in row.nn] == [1, 2]


def test_votes(spark):
    train = [(1, 1, [0.0]), (2, 0, [1.0]), (3, 0, [1.5]), (4, 1, [9.0])]
    t, q = frames(spark, train, [(10, [0.0]), (11, [0.25])])
    near = {r.qid: r for r in knn.knn_predict(t, q, "id", 3, "distance").collect()}
    assert (near[10].share, near[10].prediction) == (1.0, 1)  # distance 0 decides alone
    assert near[11].share == pytest.approx(4 / (4 + 1 / 0.75 + 1 / 1.25))
    even = {r.qid: r for r in knn.knn_predict(t, q, "id", 2, "uniform").collect()}
    assert (even[10].share, even[10].prediction) == (0.5, 0)  # a tie is normal
    with pytest.raises(ValueError):
        knn.vote_share(F.col("nn"), 3, "other")


def test_hot_duplicates_are_left_out_of_the_index(spark):
    same = spark.range(3000).select("id", F.lit(1).alias("label"), F.array(F.lit(0.5).cast("float")).alias("features"))
    index = knn.KnnIndex.fit(same, "id", 4)
    assert index.blocks.agg(F.sum("n")).head()[0] == 4
    assert [h.id for h in index.search(same.limit(1), "id").head().nn] == [0, 1, 2, 3]


def test_grid_has_every_candidate(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(x[0] > 0.5), [float(v) for v in x]) for i, x in enumerate(rng.random((240, 2)))]
    frame = spark.createDataFrame(rows, "id long, label int, features array<float>")
    folded = assign_folds(frame, "id", "label")
    per_fold = tuning.knn_grid(folded, "id")
    assert per_fold.count() == 3 * 14
    best = tuning.select_best(tuning.mean_scores(per_fold)).head()
    assert best.mean_f1_score > 0.9

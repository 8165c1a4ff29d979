"""Sending queries to blocks must not grow faster than the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.functions.session import materialise
from flowsentry.operators import knn


@pytest.mark.parametrize("k, rows", [(None, 1), (5, 2048), (5, 2), (5, 1)])
def test_queries_near_each_other_are_routed_together(monkeypatch, k, rows):
    """The same boxes as by holding every query against every box, with a fraction of the comparisons."""
    rng = np.random.default_rng(3)
    frame = knn.Frame.of(rng.random((500, 3)))
    corners = rng.random((800, 3))
    made = [frame.coordinates(c + rng.random((4, 3)) * 0.1) for c in corners]
    lo, hi = (np.array([f(m) for m in made]) for f in (lambda m: m.min(0), lambda m: m.max(0)))
    boxes = knn.Boxes(np.arange(800), np.full(800, rows), lo, hi)
    q = rng.random((10_000, 3)).astype(np.float32)
    bound = rng.random(10_000) * 0.003
    near = knn.box_distances(frame.coordinates(q), lo, hi, frame.width)
    if k is None:
        want = near <= bound[:, None] * knn.SLACK
    else:
        want = np.zeros(near.shape, bool)
        np.put_along_axis(want, np.argsort(near, axis=1, kind="stable")[:, :-(-k // rows)], True, axis=1)
    cells, measure = [], knn.box_distances
    monkeypatch.setattr(knn, "box_distances", lambda q, lo, *rest: cells.append(len(q) * len(lo)) or measure(q, lo, *rest))
    got = np.zeros(near.shape, bool)
    for picked in boxes.route(q, bound, k, frame):
        for box, queries in picked:
            assert not got[queries, box].any()
            got[queries, box] = True
    assert (got == want).all()
    assert sum(cells) < near.size / 4


def test_two_files_are_dealt_out_over_all_cores(spark):
    """Two files are two row groups, though the scan cuts them into more pieces."""
    rows = spark.range(200, numPartitions=2).withColumn("x", F.repeat(F.lit("x"), 10))
    cores = spark.sparkContext.defaultParallelism
    sizes = [r["count"] for r in materialise(rows, spread=True).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == cores and sum(sizes) == 200


def test_votes_of_a_grid_by_running_sums(spark):
    """What each candidate votes alone, for lists with rows at distance 0, ties, and fewer rows than k."""
    rng = np.random.default_rng(5)
    lists = []
    for size in [1, 2, 5, 21] * 30:
        d2 = np.sort(rng.choice([0.0, 0.25, 0.5, 1.0, 3.0], size) if size % 2 else rng.random(size))
        lists.append((size, [(float(d), i, int(rng.integers(0, 2))) for i, d in enumerate(d2)]))
    rows = spark.createDataFrame(lists, "n int, nn array<struct<d2: double, id: long, label: int>>")
    grid = [(k, w) for k in knn.NEIGHBOURS for w in knn.WEIGHTS]
    both = rows.select(knn.grid_votes(grid)("nn").alias("together"), F.array(*[
        knn.vote(knn.vote_share(F.col("nn"), k, w)) for k, w in grid]).alias("alone")).collect()
    assert len(both) == 120 and all(r.together == r.alone for r in both)
    assert len({v for r in both for v in r.alone}) == 2
    with pytest.raises(ValueError, match="unknown weights"):
        knn.grid_votes([(3, "other")])


def test_neighbours_are_ranked_without_a_row_each(spark):
    """The best k of a query's lists are merged as lists: no window over a row for every candidate."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, i % 2, [float(v) for v in rng.random(2)]) for i in range(60)],
                                 "id long, label int, features array<float>")
    found = knn.KnnIndex.fit(rows, "id", 5, block_rows=8).search(rows, "id", 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate explode(nn" not in plan
    assert all(len(r.nn) == 5 and r.nn[0].id == r.qid and r.nn == sorted(r.nn) for r in found.collect())

"""The histogram forest against Spark ML's trees, a plain recursive tree, and itself on other partitions."""

import numpy as np
import pytest

from flowsentry.operators import classifiers, forest


def table(spark, x, y):
    rows = [(k, int(b), [float(v) for v in a]) for k, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, label int, features array<float>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    x = rng.random((1200, 6)).astype(np.float32)
    x[:, 4] = np.round(x[:, 4] * 5)
    x[:, 5] = 1
    y = ((x[:, 0] > 0.4) ^ (x[:, 4] > 2) | (rng.random(1200) < 0.05)).astype(int)
    return x, y


def same(a, b):
    return all(np.array_equal(getattr(a, f), getattr(b, f)) for f in ("feature", "threshold_at", "left", "right", "roots")) and (
        np.allclose(a.share, b.share, atol=1e-12))


def test_trees_do_not_depend_on_partitions_or_place_of_growth(spark, data):
    df = table(spark, *data)
    first = forest.grow_forest(df, 3, n_estimators=6, max_depth=None, key="id")
    assert same(first, forest.grow_forest(df.repartition(5), 3, n_estimators=6, max_depth=None, key="id"))
    for rows in (300, 40):
        assert same_scores(first, forest.grow_forest(df, 3, n_estimators=6, max_depth=None, key="id", local_rows=rows), data[0])
    assert not same(first, forest.grow_forest(df, 4, n_estimators=6, max_depth=None, key="id"))


def same_scores(a, b, x):
    return len(a.feature) == len(b.feature) and np.allclose(a.scores(x), b.scores(x), atol=1e-12) and (
        np.allclose(a.importances, b.importances, atol=1e-12))


def plain_tree(codes, y, w, name, depth, rules, bins):
    """Recursive growth by the same rules, cut by cut."""
    weight, ones, rows = w.sum(), (w * y).sum(), len(y)
    leaf = ones / max(weight, 1e-300)
    if not 0 < ones < weight or rows < rules.min_samples_split or (rules.max_depth is not None and depth >= rules.max_depth):
        return leaf
    best, found = -np.inf, None
    for turn, f in enumerate(forest.feature_order(np.array([name], np.uint64), codes.shape[1])[0]):
        if turn >= rules.tries and found:
            break
        local = (-np.inf, None)
        for cut in range(bins - 1):
            left = codes[:, f] <= cut
            if min(left.sum(), (~left).sum()) < rules.min_samples_leaf:
                continue
            score = sum(((w * y)[s].sum() ** 2 + (w * (1 - y))[s].sum() ** 2) / w[s].sum() for s in (left, ~left))
            if score > local[0]:
                local = (score, (f, cut))
        if local[0] > best * (1 + 1e-12):
            best, found = local
    if not found:
        return leaf
    left = codes[:, found[0]] <= found[1]
    names = forest.children_names(np.array([name], np.uint64))[0]
    return (found, *(plain_tree(codes[s], y[s], w[s], n, depth + 1, rules, bins) for s, n in ((left, names[0]), (~left, names[1]))))


def nested(branch, at=0):
    if branch.feature[at] < 0:
        return branch.share[at]
    return ((branch.feature[at], branch.cut[at]), nested(branch, branch.left[at]), nested(branch, branch.right[at]))


@pytest.mark.parametrize("rules", [forest.Rules(None, 2, 1, 2), forest.Rules(4, 9, 3, 1), forest.Rules(None, 5, 2, 4)])
def test_growth_equals_a_plain_recursive_tree(rules):
    rng = np.random.default_rng(1)
    codes, y, w = rng.integers(0, 7, (160, 4)).astype(np.uint8), rng.integers(0, 2, 160), rng.integers(1, 4, 160).astype(float)
    branch = forest.grow(codes, y, w, np.uint64(5), 0, rules, 8)

    def equal(a, b):
        if isinstance(a, tuple):
            return isinstance(b, tuple) and tuple(a[0]) == tuple(b[0]) and equal(a[1], b[1]) and equal(a[2], b[2])
        return not isinstance(b, tuple) and abs(a - b) < 1e-12

    assert equal(nested(branch), plain_tree(codes, y, w, np.uint64(5), 0, rules, 8))


@pytest.mark.parametrize("candidate", classifiers.FOREST_CANDIDATES)
def test_recorded_candidates_are_applied_as_they_are(spark, data, candidate):
    x, y = data
    model = classifiers.fit_forest(table(spark, x, y), 1, key="id", **candidate | {"n_estimators": 3})
    keys = np.array([r.h for r in table(spark, x, y).selectExpr("xxhash64(id) as h").collect()])
    for t, (root, end) in enumerate(zip(model.roots, [*model.roots[1:], len(model.feature)])):
        drawn = forest.copies(keys, t, 1)
        level, depth = [(root, np.flatnonzero(drawn))], 0
        while level:
            below = []
            for node, rows in level:
                if model.feature[node] < 0:
                    assert abs(model.share[node] - np.average(y[rows], weights=drawn[rows])) < 1e-9
                    assert len(rows) >= candidate["min_samples_leaf"]
                    continue
                assert len(rows) >= candidate["min_samples_split"]
                left = x[rows, model.feature[node]] <= model.threshold_at[node]
                below += [(model.left[node], rows[left]), (model.right[node], rows[~left])]
            level, depth = below, depth + 1
        assert candidate["max_depth"] is None or depth - 1 <= candidate["max_depth"]


def test_flat_arrays_score_like_the_library(spark, data):
    df = table(spark, *data)
    fitted = classifiers.forest_estimator(12, 8, seed=5).fit(classifiers.training_frame(df))
    flat = forest.from_library(spark, fitted)
    theirs = fitted.transform(classifiers.with_vector(df)).select("id", classifiers.score_column().alias("p")).orderBy("id").collect()
    mine = flat.attach(df, "p", "label_").orderBy("id").collect()
    assert [r.p for r in mine] == pytest.approx([r.p for r in theirs], abs=1e-12)
    assert flat.importances == pytest.approx(list(fitted.featureImportances.toArray()))


def test_forest_learns_saves_and_loads(spark, data, tmp_path):
    df = table(spark, *data)
    model = classifiers.fit_forest(df.filter("id < 900"), n_estimators=40, max_depth=12)
    held = model.attach(df.filter("id >= 900"), "score", "mine").collect()
    assert np.mean([r.mine == r.label for r in held]) > 0.9
    assert min(model.importances[0], model.importances[4]) > 0.1 and model.importances[5] == 0
    assert sum(model.importances) == pytest.approx(1)
    model.save(spark, str(tmp_path / "f"))
    again = forest.ForestModel.load(spark, str(tmp_path / "f"))
    assert np.array_equal(again.scores(data[0]), model.scores(data[0])) and again.importances == model.importances


def test_walk_and_scores_agree(data):
    x, y = data
    borders = forest.bin_borders(x)
    codes = forest._binned(x, borders)
    branch = forest.grow(codes, y, np.ones(len(y)), np.uint64(9), 0, forest.Rules(None, 2, 1, 6), 64)
    leaf = forest.walk(branch.feature, branch.cut, branch.left, branch.right, codes, np.zeros(len(x), np.int32))
    tree = forest._whole(forest._Tree.start(np.uint64(9)), {0: branch}, borders, np.zeros(6))
    model = forest.ForestModel(*forest._joined([tree]), [0.0] * 6)
    assert np.allclose(model.scores(x), branch.share[leaf])
    # Borders that single precision cannot hold must not move a row.
    edge = np.float32(0.1)
    one = forest.ForestModel(np.array([0, -1, -1], np.int32), np.array([0.1, 0, 0]), np.array([1, -1, -1], np.int32),
                             np.array([2, -1, -1], np.int32), np.array([0, 0.25, 0.75]), np.array([0], np.int32), [1.0])
    assert one.scores(np.array([[edge]], np.float32))[0] == (0.25 if float(edge) <= 0.1 else 0.75)


def test_odd_training_tables(spark):
    rng = np.random.default_rng(0)
    constant = table(spark, np.ones((50, 3), np.float32), rng.integers(0, 2, 50))
    model = classifiers.fit_forest(constant, n_estimators=3, key="id")
    assert (model.feature < 0).all() and sum(model.importances) == 0
    one_class = classifiers.fit_forest(table(spark, rng.random((20, 2)), np.ones(20, int)), n_estimators=3, key="id")
    assert set(one_class.share) == {1.0}
    with pytest.raises(ValueError):
        classifiers.fit_forest(constant.limit(0))


def test_large_nodes_take_one_scan_a_level(spark, monkeypatch):
    """The sizes of nodes follow from their parents' histograms, and only the tried features are summed."""
    rng = np.random.default_rng(4)
    rows = [(i, int(x[0] + x[1] > 1), x.tolist()) for i, x in enumerate(rng.random((600, 9)))]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    sizes, add = [], forest.sum_over_tasks

    def counted(table, task, tasks):
        out = add(table, task, tasks)
        sizes.append(len(out))
        return out

    monkeypatch.setattr(forest, "sum_over_tasks", counted)
    forest.grow_forest(df, 3, n_estimators=4, max_depth=3, key="id", local_rows=1)
    bins, tries = forest.MAX_BINS, 3
    assert len(sizes) <= 1 + 4  # the trees' sizes, and the levels from 0 to 3
    assert sizes[0] == 4 * 3 and max(sizes) <= 4 * 2 ** 3 * tries * bins * 3


def test_histograms_and_branches_do_not_gather_on_the_driver(spark, data, monkeypatch):
    """Large nodes are cut by tasks, whose sums stay with them, and branches come a few trees at a time; in pieces
    of whatever size the trees are the same, and a broadcast forest can be given back."""
    x, y = data
    df = table(spark, x, y)
    whole = forest.grow_forest(df, 3, n_estimators=6, max_depth=None, key="id", local_rows=100)
    sums, inner = [], forest.sum_over_tasks
    monkeypatch.setattr(forest, "sum_over_tasks", lambda *a: sums.append(inner(*a)) or sums[-1])
    monkeypatch.setattr(forest, "PIECE_BYTES", 1)
    monkeypatch.setattr(forest, "TREES_AT_PASS", 2)
    pieces = forest.grow_forest(df, 3, n_estimators=6, max_depth=None, key="id", local_rows=100)
    assert same(whole, pieces) and np.allclose(whole.importances, pieces.importances)
    assert sum(len(s) for s in sums) == 6 * 3  # the sizes of the roots
    scored = pieces.attach(df, "s", "p")
    assert [r.p for r in scored.orderBy("id").collect()] == (pieces.scores(x) >= 0.5).astype(int).tolist()
    pieces.release()
    assert scored.count() == 1200 and not hasattr(pieces, "_shared")
    assert [r.p for r in pieces.attach(df, "s", "p").orderBy("id").collect()] == (pieces.scores(x) >= 0.5).astype(int).tolist()

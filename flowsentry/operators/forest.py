"""Random forests: grown from histograms over all tasks, scored as flat arrays.

Features are cut into bins once. Trees grow level by level: for the nodes that are still large, tasks sum
histograms of their rows over bins, other tasks add these up by node and cut them, and the driver picks the
splits from the cuts, a group of nodes of bounded size at a time. As soon as a node has at most LOCAL_ROWS rows, these rows are sent to one task, which grows the rest
of that tree's branch; so small tables take one shuffle, and large ones a few scans more. Which rows a tree
draws, and which features a node tries, follow from hashes of the seed, the tree, the row and the node's
place alone: the trees do not depend on partitions, nor on where the growing goes over from one way to the
other.

A fitted forest is five flat arrays over the nodes of all trees. A batch of rows walks down a tree together,
one array step a level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsentry.functions.arrow import matrix, sum_over_tasks, vector_batch
from flowsentry.functions.columns import apply_threshold, col
from flowsentry.functions.session import materialise, read_json, release, scratch_path, write_json

MAX_BINS = 64
SAMPLE_ROWS = 65_536  # whose quantiles are the borders of bins
LOCAL_ROWS = 65_536
GROUP_BYTES = 64 << 20  # of histograms summed in one scan
PIECE_BYTES, PIECES_BYTES = 1 << 20, 8 << 20  # of histograms that travel together, and of all tasks' histograms of the same nodes
MAX_NODES = 100_000_000  # of a forest, which travels to every task
TREES_AT_ONCE, ROWS_AT_ONCE = 32, 4_096
TREES_AT_PASS = 8  # whose branches come to the driver together
# Of a row drawn with replacement from many: the chance of at most 0, 1, 2 ... copies.
_DRAWS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def _number(*parts: int) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for part in parts:
        out = mix(out + np.array([part % (1 << 64)], np.uint64) * _ODD + _ODD)
    return out[0]


def copies(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row."""
    chance = (mix(keys.view(np.uint64) ^ _number(seed, tree)) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_DRAWS, chance, side="right").astype(np.uint8)


@dataclass(frozen=True)
class Rules:
    """When a node is a leaf, and how many features it tries."""

    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    tries: int = 1

    @classmethod
    def of(cls, width: int, max_depth, min_samples_split, min_samples_leaf, max_features) -> Rules:
        tries = {"sqrt": int(math.sqrt(width)), "all": width}.get(max_features)
        return cls(max_depth, min_samples_split, min_samples_leaf, max(1, int(float(max_features) * width) if tries is None else tries))


def feature_order(names: np.ndarray, width: int) -> np.ndarray:
    """For each node, by its name, the features in the order in which it tries them."""
    features = mix(np.arange(1, width + 1, dtype=np.uint64) * _ODD)
    return np.argsort(mix(names[:, None] ^ features[None, :]), axis=1, kind="stable")


def children_names(names: np.ndarray) -> np.ndarray:
    """Names of the left and right child of each node."""
    return mix(names[:, None] + np.array([[1, 2]], np.uint64) * _ODD)


def best_cuts(histogram: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of histograms (node, bin, [weight, weight of class 1, rows]): the best cut (last bin on the left), its
    score (higher is purer, -inf without one), and what lies left of it."""
    left = np.cumsum(histogram, axis=1)
    total = left[:, -1:]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        # Weighted Gini impurity falls as the sum of squared class weights over weight grows.
        score = sum((p[..., 1] ** 2 + (p[..., 0] - p[..., 1]) ** 2) / p[..., 0] for p in (left, right))
    score = np.where((left[..., 2] >= least) & (right[..., 2] >= least), score, -np.inf)
    cut = np.argmax(score, axis=1)
    at = np.arange(len(cut))
    return cut, score[at, cut], left[at, cut]


def summed(key: np.ndarray, weight: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """(size, [weight, weight of class 1, rows]) by key. All are whole numbers, which are added up side by side in
    one number while they fit into it."""
    bits = int(weight.sum()).bit_length()
    if 3 * bits > 53:
        return np.stack([np.bincount(key, v, minlength=size) for v in (weight, weight * y, None)], axis=-1).astype(np.float64)
    unit = float(1 << bits)
    both = np.bincount(key, (weight * y * unit + weight) * unit + 1.0, minlength=size).astype(np.int64)
    mask = (1 << bits) - 1
    return np.stack([(both >> bits) & mask, both >> (2 * bits), both & mask], axis=-1).astype(np.float64)


@dataclass
class Splits:
    """Choices for a level of nodes; feature -1 where a node is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    left: np.ndarray


def can_split(totals: np.ndarray, depth: int, rules: Rules) -> np.ndarray:
    """Which nodes of a level, by (weight, weight of class 1, rows), need not be leaves."""
    weight, ones, rows = totals.T
    deep = rules.max_depth is not None and depth >= rules.max_depth
    return (ones > 0) & (ones < weight) & (rows >= max(rules.min_samples_split, 2 * rules.min_samples_leaf)) & (not deep)


def choose(names: np.ndarray, totals: np.ndarray, depth: int, rules: Rules, width: int, cuts_of, turns: int | None = None) -> Splits:
    """The split of every node. ``cuts_of(nodes, features)`` gives what ``best_cuts`` does, for one feature each;
    ``turns`` are the features looked at, if not all.

    A node tries ``tries`` features, and more only while none of them can be cut.
    """
    size = len(names)
    out = Splits(np.full(size, -1), np.zeros(size, int), np.zeros(size), np.zeros((size, 3)))
    best = np.full(size, -np.inf)
    weight, ones, _ = totals.T
    open_ = can_split(totals, depth, rules)
    order = feature_order(names, width)
    for turn in range(width if turns is None else turns):
        nodes = np.flatnonzero(open_ if turn < rules.tries else open_ & (out.feature < 0))
        if not len(nodes):
            break
        features = order[nodes, turn]
        cut, score, left = cuts_of(nodes, features)
        better = score > best[nodes] * (1 + 1e-12)
        nodes, cut, score, left = nodes[better], cut[better], score[better], left[better]
        best[nodes], out.cut[nodes], out.left[nodes], out.feature[nodes] = score, cut, left, features[better]
    with np.errstate(divide="ignore", invalid="ignore"):
        before = (ones ** 2 + (weight - ones) ** 2) / weight
    out.gain = np.where(out.feature >= 0, best - before, 0.0)
    return out


@dataclass
class Branch:
    """Nodes of (part of) a tree, the first one its root: feature (-1 for a leaf), cut, places of the
    children, share of class 1, gain, and the weight that reaches the node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    gain: np.ndarray

    def packed(self) -> dict[str, bytes]:
        kinds = {"feature": np.int32, "cut": np.int32, "left": np.int32, "right": np.int32, "share": np.float64, "gain": np.float64}
        return {name: getattr(self, name).astype(kind).tobytes() for name, kind in kinds.items()}

    @classmethod
    def unpacked(cls, row: dict) -> Branch:
        kinds = {"feature": np.int32, "cut": np.int32, "left": np.int32, "right": np.int32, "share": np.float64, "gain": np.float64}
        return cls(*(np.frombuffer(row[name], kind) for name, kind in kinds.items()))


def grow(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, name: np.uint64, depth: int, rules: Rules, bins: int) -> Branch:
    """The branch below a node, from the rows (binned) that reach it, level by level."""
    width, levels = codes.shape[1], []
    names, node = np.array([name], np.uint64), np.zeros(len(y), np.int64)
    weight = weight.astype(np.float64)
    first = 0
    while len(names):
        size = len(names)
        totals = summed(node, weight, y, size)
        held: list = [None]

        def rows_of(nodes: np.ndarray) -> tuple[np.ndarray, ...]:
            """Number in ``nodes``, codes, weight and class of the rows of these nodes; most turns have the same."""
            if held[0] is None or not np.array_equal(held[0], nodes):
                place = np.full(size, -1)
                place[nodes] = np.arange(len(nodes))
                mine = place[node]
                rows = np.flatnonzero(mine >= 0)
                held[:] = nodes, mine[rows], rows, weight[rows], y[rows]
            return tuple(held[1:])

        def cuts_of(nodes: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            mine, rows, w, ones = rows_of(nodes)
            code = codes[rows, features[mine]].astype(np.int64)
            return best_cuts(summed(mine * bins + code, w, ones, len(nodes) * bins).reshape(-1, bins, 3), rules.min_samples_leaf)

        found = choose(names, totals, depth, rules, width, cuts_of)
        inner = found.feature >= 0
        child = np.full(size, -1)
        child[inner] = 2 * np.arange(inner.sum())
        begin = first + size
        levels.append((found.feature, found.cut, np.where(inner, begin + child, -1), np.where(inner, begin + child + 1, -1),
                       totals[:, 1] / np.maximum(totals[:, 0], 1e-300), found.gain))
        rows = np.flatnonzero(inner[node])
        at = node[rows]
        goes_right = codes[rows, found.feature[at]] > found.cut[at]
        codes, y, weight, node = codes[rows], y[rows], weight[rows], child[at] + goes_right
        names, first, depth = children_names(names[inner]).ravel(), begin, depth + 1
    return Branch(*(np.concatenate(part) for part in zip(*levels)))


def walk(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The leaf that each row of x comes to from its node ``at``."""
    at, rows = at.copy(), np.arange(len(x))
    while len(rows):
        node = at[rows]
        f = feature[node]
        inner = f >= 0
        if not inner.all():
            rows, node, f = rows[inner], node[inner], f[inner]
        at[rows] = np.where(x[rows, f] <= cut[node], left[node], right[node])
    return at


@dataclass
class ForestModel:
    """All trees in a row: feature (-1 for a leaf), threshold, children (numbers in the whole row), and the
    share of class 1; ``roots`` are the trees' first nodes."""

    feature: np.ndarray
    threshold_at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    roots: np.ndarray
    importances: list[float]
    threshold: float = 0.5

    @cached_property
    def _compiled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Leaves turned into nodes that lead to themselves, so that a step needs no exceptions: feature,
        threshold, children side by side, and each tree's depth. Thresholds are rounded down to single
        precision, in which rows come: the comparisons are the same."""
        leaf, own = self.feature < 0, np.arange(len(self.feature), dtype=np.int32)
        cut = np.where(leaf, np.inf, self.threshold_at)
        low = cut.astype(np.float32)
        low = np.where(low.astype(np.float64) > cut, np.nextafter(low, np.float32(-np.inf)), low)
        child = np.stack([np.where(leaf, own, self.left), np.where(leaf, own, self.right)], axis=1)
        depths, ends = [], [*self.roots[1:], len(own)]
        for root, _ in zip(self.roots, ends):
            level, depth = np.array([root]), 0
            while len(level := level[self.feature[level] >= 0]):
                level, depth = child[level].ravel(), depth + 1
            depths.append(depth)
        return np.where(leaf, 0, self.feature).astype(np.int32), low, child.ravel(), depths

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean share of class 1 over the trees."""
        feature, cut, child, depths = self._compiled
        out = np.empty(len(x))
        for a in range(0, len(x), ROWS_AT_ONCE):
            part = np.ascontiguousarray(x[a:a + ROWS_AT_ONCE], np.float32)
            size, flat = len(part), part.ravel()
            total, begins = np.zeros(size), np.arange(size, dtype=np.int32) * part.shape[1]
            for root, depth in zip(self.roots.tolist(), depths):
                leaf, rows = np.empty(size, np.int32), np.arange(size)
                at, begin = np.full(size, root, np.int32), begins
                for level in range(depth):
                    if level % 6 == 5:  # rows at their leaf need not go on
                        leaf[rows] = at
                        still = np.flatnonzero(child.take(2 * at) != at)
                        rows, at, begin = rows[still], at[still], begin[still]
                    right = flat.take(begin + feature.take(at)) > cut.take(at)
                    at = child.take(2 * at + right)
                leaf[rows] = at
                total += self.share.take(leaf)
            out[a:a + ROWS_AT_ONCE] = total / len(self.roots)
        return out

    def __getstate__(self) -> dict:
        return {name: value for name, value in vars(self).items() if name != "_shared"}

    def release(self) -> None:
        """Take the forest back from driver and tasks, once no frame scored with it is read any more."""
        for shared in vars(self).pop("_shared", []):
            shared.destroy()

    def attach(self, df: DataFrame, score: str, label: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)
        vars(self).setdefault("_shared", []).append(shared)

        @F.arrow_udf("double")
        def probability(features: pa.Array) -> pa.Array:
            if len(features) == 0:
                return pa.array([], pa.float64())
            return pa.array(shared.value.scores(matrix(features)))

        return df.withColumn(score, probability("features")).withColumn(
            label, apply_threshold(F.col(score), self.threshold))

    def save(self, spark: SparkSession, path: str) -> None:
        ends = [*self.roots[1:], len(self.feature)]
        rows = [(k, *(part[a:b].astype(kind).tobytes() for part, kind in (
            (self.feature, "<i4"), (self.threshold_at, "<f8"), (self.left - a, "<i4"), (self.right - a, "<i4"), (self.share, "<f8"))))
            for k, (a, b) in enumerate(zip(self.roots, ends))]
        spark.createDataFrame(rows, "tree int, feature binary, threshold binary, lower binary, upper binary, share binary").write.mode(
            "overwrite").parquet(path + "/trees")
        write_json(spark, path + "/kind", {"kind": "trees", "threshold": self.threshold, "importances": self.importances})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        document = read_json(spark, path + "/kind")
        rows = sorted(spark.read.parquet(path + "/trees").collect(), key=lambda r: r.tree)
        trees = [(np.frombuffer(r.feature, "<i4"), np.frombuffer(r.threshold, "<f8"), np.frombuffer(r.lower, "<i4"),
                  np.frombuffer(r.upper, "<i4"), np.frombuffer(r.share, "<f8")) for r in rows]
        return cls(*_joined(trees), document["importances"], document["threshold"])


def _joined(trees: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Trees with numbers of their own, one after the other; children of leaves stay below 0 or meaningless."""
    sizes = [len(t[0]) for t in trees]
    if sum(sizes) > MAX_NODES:
        raise ValueError(f"{sum(sizes)} nodes are too many to send to every task: limit the depth or the leaves")
    roots = np.append(0, np.cumsum(sizes))[:-1].astype(np.int32)
    feature, cut, left, right, share = (np.concatenate(part) for part in zip(*trees))
    shift = np.repeat(roots, sizes)
    return feature, cut, left + shift, right + shift, share, roots


def bin_borders(sample: np.ndarray, bins: int = MAX_BINS) -> list[np.ndarray]:
    """For each feature at most bins - 1 thresholds between its values, by quantiles of the sample."""
    out = []
    for column in sample.T.astype(np.float64):
        values = np.unique(column)
        if len(values) > bins:
            ranked = np.sort(column)
            at = np.unique(ranked[(np.arange(1, bins) * len(ranked)) // bins])
            behind = values[np.minimum(np.searchsorted(values, at, side="right"), len(values) - 1)]
            borders = ((at + behind) / 2)[behind > at]
        else:
            borders = (values[1:] + values[:-1]) / 2
        out.append(borders)
    return out


def _binned(x: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(b, x[:, j].astype(np.float64), side="left") for j, b in enumerate(borders)], axis=1).astype(np.uint8)


@dataclass
class _Tree:
    """The top of a tree on the driver. ``state`` of a node: 0 open, 1 decided, 2 left to a task."""

    feature: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    share: list[float]
    gain: list[float]
    name: list
    depth: list[int]
    state: list[int]
    total: list  # weight, weight of class 1, rows

    @classmethod
    def start(cls, name) -> _Tree:
        return cls([-1], [0], [-1], [-1], [0.0], [0.0], [name], [0], [0], [None])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(v, np.int32) for v in (self.feature, self.cut, self.left, self.right))

    def add(self, name, depth: int, total: np.ndarray) -> int:
        for values, value in zip(vars(self).values(), (-1, 0, -1, -1, 0.0, 0.0, name, depth, 0, total)):
            values.append(value)
        return len(self.feature) - 1


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return codes, batch.column("label").to_numpy().astype(np.int64), batch.column("h").to_numpy()


def _grow_tops(table: DataFrame, trees: list[_Tree], rules: Rules, width: int, bins: int, seed: int, tasks: int, local_rows: int) -> None:
    """Grow the trees until every open node has at most ``local_rows`` rows."""
    spark = table.sparkSession

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 3))
        for batch in batches:
            _, y, keys = _rows(batch)
            for t in range(len(names)):
                drawn = copies(keys, t, seed)
                total[t] += drawn.sum(dtype=np.int64), (drawn * y).sum(), np.count_nonzero(drawn)
        yield vector_batch(total.ravel())

    names = [tree.name[0] for tree in trees]
    for tree, total in zip(trees, sum_over_tasks(table, sizes, tasks).reshape(-1, 3)):
        tree.total[0] = total
    while True:
        waiting = [(t, n) for t, tree in enumerate(trees) for n, state in enumerate(tree.state) if state == 0]
        if not waiting:
            return
        large = []
        for t, n in waiting:
            tree = trees[t]
            tree.share[n] = float(tree.total[n][1] / max(tree.total[n][0], 1e-300))
            tree.state[n] = 2
            if tree.total[n][2] > local_rows:
                large.append((t, n))
        if not large:
            return
        tops = spark.sparkContext.broadcast({t: trees[t].arrays() for t in {t for t, _ in large}})

        def cuts_over(nodes: list[tuple[int, int]], features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """By (node, place in ``features``) what ``best_cuts`` gives over all rows; ``features`` has a row for each node.

            The histograms stay with the tasks: the driver gets five numbers of each.
            """
            size, many = features.shape
            step = max(1, min(PIECE_BYTES, PIECES_BYTES // tasks) // (8 * 3 * bins * many))
            spots = {t: np.full(len(trees[t].feature), -1) for t, _ in nodes}
            for k, (t, n) in enumerate(nodes):
                spots[t][n] = k

            def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((size, many, bins, 3))
                for batch in batches:
                    codes, y, keys = _rows(batch)
                    for t, spot in spots.items():
                        drawn = copies(keys, t, seed)
                        rows = np.flatnonzero(drawn)
                        number = spot[walk(*tops.value[t], codes[rows], np.zeros(len(rows), np.int32))]
                        rows, number = rows[number >= 0], number[number >= 0]
                        if not len(rows):
                            continue
                        # A tree's nodes stand together, so few of the histograms are touched.
                        low, high = int(number.min()), int(number.max()) + 1
                        w, ones, key = drawn[rows].astype(float), y[rows], (number - low) * bins
                        for j in range(many):
                            total[low:high, j] += summed(key + codes[rows, features[number, j]], w, ones, (high - low) * bins).reshape(-1, bins, 3)
                for first in range(0, size, step):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([first], pa.int32()), pa.array([total[first:first + step].tobytes()], pa.binary())], ["first", "v"])

            def cuts(pieces: pa.Table) -> pa.Table:
                total = sum(np.frombuffer(v) for v in pieces.column("v").to_pylist())
                cut, score, left = best_cuts(total.reshape(-1, bins, 3), rules.min_samples_leaf)
                return pa.table({"first": pieces.column("first").slice(0, 1), "found": pa.array(
                    [np.column_stack([cut, score, left]).tobytes()], pa.binary())})

            rows = table.mapInArrow(histograms, "first int, v binary").groupBy("first").applyInArrow(cuts, "first int, found binary").collect()
            found = np.concatenate([np.frombuffer(r.found) for r in sorted(rows, key=lambda r: r.first)]).reshape(size, many, 5)
            return found[..., 0].astype(int), found[..., 1], found[..., 2:]

        def decide(nodes: list[tuple[int, int]], many: int) -> list[tuple[int, int]]:
            """Split nodes by the first ``many`` features that each tries; those that may still find one are given back."""
            again, group = [], max(1, GROUP_BYTES // (8 * 3 * bins * many))
            for a in range(0, len(nodes), group):
                here = nodes[a:a + group]
                features = feature_order(np.array([trees[t].name[n] for t, n in here], np.uint64), width)[:, :many]
                cut, score, left = cuts_over(here, features)
                depths = np.array([trees[t].depth[n] for t, n in here])
                for depth in np.unique(depths):  # nodes of one level as a rule
                    rows = np.flatnonzero(depths == depth)
                    keys = [here[k] for k in rows]
                    names = np.array([trees[t].name[n] for t, n in keys], np.uint64)
                    totals = np.array([trees[t].total[n] for t, n in keys])

                    def cuts_of(of: np.ndarray, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                        place = np.argmax(features[rows[of]] == tried[:, None], axis=1)
                        return tuple(part[rows[of], place] for part in (cut, score, left))

                    found = choose(names, totals, int(depth), rules, width, cuts_of, many)
                    may, below = can_split(totals, int(depth), rules), children_names(names)
                    for k, (t, n) in enumerate(keys):
                        tree = trees[t]
                        if found.feature[k] < 0 and may[k] and many < width:
                            again.append((t, n))
                            continue
                        tree.state[n] = 1
                        if found.feature[k] >= 0:
                            tree.feature[n], tree.cut[n], tree.gain[n] = int(found.feature[k]), int(found.cut[k]), float(found.gain[k])
                            sides = found.left[k], totals[k] - found.left[k]
                            tree.left[n], tree.right[n] = (tree.add(below[k, side], int(depth) + 1, sides[side]) for side in (0, 1))
            return again

        again = decide(large, min(rules.tries, width))
        if again:
            decide(again, width)
        tops.destroy()


def _branches(table: DataFrame, trees: list[_Tree], rules: Rules, bins: int, seed: int) -> Iterator[tuple[int, dict[int, Branch]]]:
    """The rest of the trees, each branch grown by one task from at most LOCAL_ROWS rows of its tree. Tree by tree, so
    that the driver holds the branches of a few trees at once."""
    tops = table.sparkSession.sparkContext.broadcast([
        (*tree.arrays(), np.array(tree.state), np.array(tree.name, np.uint64), np.array(tree.depth)) for tree in trees])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, y, keys = _rows(batch)
            for first in range(0, len(tops.value), TREES_AT_ONCE):
                out = []
                for t in range(first, min(len(tops.value), first + TREES_AT_ONCE)):
                    *arrays, state, _, _ = tops.value[t]
                    drawn = copies(keys, t, seed)
                    rows = np.flatnonzero(drawn)
                    leaf = walk(*arrays, codes[rows], np.zeros(len(rows), np.int32))
                    for n in np.unique(leaf[state[leaf] == 2]).tolist():
                        mine = rows[leaf == n]
                        out.append({"tree": t, "node": n, "codes": codes[mine].tobytes(), "y": y[mine].astype(np.uint8).tobytes(),
                                    "w": drawn[mine].tobytes()})
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([
                        ("tree", pa.int32()), ("node", pa.int32()), ("codes", pa.binary()), ("y", pa.binary()), ("w", pa.binary())]))

    def finish(group: pa.Table) -> pa.Table:
        t, n = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        y, w = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint8) for c in ("y", "w"))
        codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), np.uint8).reshape(len(y), -1)
        *_, names, depths = tops.value[t]
        branch = grow(codes, y.astype(np.int64), w, names[n], int(depths[n]), rules, bins)
        return pa.Table.from_pylist([{"tree": t, "node": n, **branch.packed()}], pa.schema([
            ("tree", pa.int32()), ("node", pa.int32()), *((c, pa.binary()) for c in branch.packed())]))

    dealt = table.mapInArrow(deal, "tree int, node int, codes binary, y binary, w binary")
    grown = dealt.groupBy("tree", "node").applyInArrow(
        finish, "tree int, node int, feature binary, cut binary, left binary, right binary, share binary, gain binary")
    stored = materialise(grown, "branches")
    ordered = stored.repartitionByRange(-(-len(trees) // TREES_AT_PASS), "tree").sortWithinPartitions("tree", "node")
    for t, rows in groupby(ordered.toLocalIterator(), key=lambda r: r.tree):
        yield t, {r.node: Branch.unpacked(r.asDict()) for r in rows}
    release(stored)
    tops.destroy()


def _whole(tree: _Tree, branches: dict[int, Branch], borders: list[np.ndarray], gains: np.ndarray) -> tuple[np.ndarray, ...]:
    """The tree's nodes with their thresholds, branches behind the top; adds to the features' gains."""
    parts = [[np.array(v) for v in (tree.feature, tree.cut, tree.left, tree.right, tree.share, tree.gain)]]
    at = len(tree.feature)
    for n, branch in branches.items():
        size = len(branch.feature)
        # The branch's root takes the place of the node it was grown from.
        moved = [np.where(side > 0, side - 1 + at, -1) for side in (branch.left, branch.right)]
        values = (branch.feature, branch.cut, *moved, branch.share, branch.gain)
        for mine, value in zip(parts[0], values):
            mine[n] = value[0]
        parts.append([value[1:] for value in values])
        at += size - 1
    feature, cut, left, right, share, gain = (np.concatenate(p) for p in zip(*parts))
    inner = feature >= 0
    own = np.bincount(feature[inner], gain[inner], minlength=len(gains))
    gains += own / own.sum() if own.sum() > 0 else 0
    threshold = np.zeros(len(feature))
    for f, values in enumerate(borders):
        here = feature == f
        threshold[here] = values[cut[here]] if here.any() else 0
    return feature.astype(np.int32), threshold, left.astype(np.int32), right.astype(np.int32), share


def grow_forest(
    train: DataFrame, seed: int = 42, n_estimators: int = 150, max_depth: int | None = 20, min_samples_split: int = 2,
    min_samples_leaf: int = 1, max_features: str = "sqrt", key: str | None = None, local_rows: int | None = None,
) -> ForestModel:
    """Fit on (label, features) rows; each tree draws as many rows as there are, with replacement.

    Splits and leaves need so many different rows drawn; ``max_depth`` None is no limit. Rows are told
    apart by ``key``, without one by what they hold, so that equal rows are drawn together. Borders of
    bins come from at most SAMPLE_ROWS rows; everything else counts all rows.
    """
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    h = F.xxhash64(col(key) if key else F.struct("features", F.col("label").cast("int")))
    rows = train.select("features", F.col("label").cast("int").alias("label"), h.alias("h"))
    n = rows.count()
    if n == 0:
        raise ValueError("cannot grow trees on an empty training frame")
    picked = rows if n <= SAMPLE_ROWS else rows.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < (SAMPLE_ROWS << 20) // n)
    sample = matrix(picked.select("features").toArrow().column("features"))
    width = sample.shape[1]
    borders = bin_borders(sample) if len(sample) else [np.zeros(0)] * width
    bins = 1 + max(len(b) for b in borders)
    rules = Rules.of(width, max_depth, min_samples_split, min_samples_leaf, max_features)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = _binned(matrix(batch.column("features")), borders)
                flat = pa.py_buffer(np.ascontiguousarray(codes))
                ends = pa.py_buffer(np.arange(0, (len(codes) + 1) * width, width, dtype=np.int32))
                yield pa.RecordBatch.from_pydict({
                    "codes": pa.Array.from_buffers(pa.binary(), len(codes), [None, ends, flat]),
                    "label": batch.column("label"), "h": batch.column("h")})

    table = materialise(rows.mapInArrow(pack, "codes binary, label int, h long"), "binned", spread=True)
    trees = [_Tree.start(_number(seed, 7, t)) for t in range(n_estimators)]
    if n > local_rows:
        _grow_tops(table, trees, rules, width, bins, seed, table.rdd.getNumPartitions(), local_rows)
    else:
        for tree in trees:
            tree.state[0] = 2
    gains, whole = np.zeros(width), []
    for t, branches in _branches(table, trees, rules, bins, seed):
        whole += [_whole(tree, {}, borders, gains) for tree in trees[len(whole):t]]  # without branches
        whole.append(_whole(trees[t], branches, borders, gains))
    whole += [_whole(tree, {}, borders, gains) for tree in trees[len(whole):]]
    release(table)
    total = gains.sum()
    return ForestModel(*_joined(whole), (gains / total if total else gains).tolist())


def from_library(spark: SparkSession, model) -> ForestModel:
    """The trees of a fitted Spark ML forest, as flat arrays."""
    path = scratch_path(spark, "library-forest")
    model.write().save(path)
    stored = spark.read.parquet(path + "/data").select("treeID", "nodeData.*")
    found = stored.select(
        "treeID", "id", "leftChild", "rightChild", F.col("split.featureIndex").alias("f"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("t"),
        (F.get("impurityStats", F.lit(1)) / (F.get("impurityStats", F.lit(0)) + F.get("impurityStats", F.lit(1)))).alias("share"),
    ).orderBy("treeID", "id").toArrow()
    tree, at, left, right, feature, threshold, share = (found[c].to_numpy() for c in ("treeID", "id", "leftChild", "rightChild", "f", "t", "share"))
    trees = []
    for t in np.unique(tree):
        here = tree == t
        if not (at[here] == np.arange(here.sum())).all():
            raise ValueError("the nodes of the stored forest are not numbered in order")
        leaf = left[here] < 0
        trees.append((np.where(leaf, -1, feature[here]).astype(np.int32), threshold[here].astype(float),
                      left[here].astype(np.int32), right[here].astype(np.int32), share[here]))
    return ForestModel(*_joined(trees), [float(v) for v in model.featureImportances.toArray()])

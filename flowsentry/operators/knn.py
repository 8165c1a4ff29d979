"""Exact k-nearest neighbours over a partitioned training table.

The training rows are cut into leaves of a split tree and, within a leaf, along a space-filling
order into blocks of a fixed number of rows. A block's box bounds its rows along the sample's principal
axes, which follow the table where its own columns do not, and their distances to a few pivot rows, which
by the triangle inequality bound a distance as well. The number of leaves is
bounded, so their boxes travel with every task; the number of blocks grows with the table, and a
leaf's block boxes stay with the leaf. A query first searches the nearest blocks that together hold
k rows, which bounds the distance of its k-th neighbour; it then visits the leaves, and in them the
blocks, whose box comes within that bound. Queries meet a leaf's boxes or a block's rows by cogroup:
a task gets a block once, with all queries sent there. A leaf or block visited by very many queries
is copied and its queries are spread over the copies. Only the best k per query and block leave a
task.

Boxes prune well while few directions matter. In tens of equally important, unrelated dimensions all
distances are alike, every box comes within the bound, and the exact answer takes every query to every
block.

Distances are Euclidean in double precision; ties go to the smaller row key. Queries are told apart
by numbers of their own, so their keys may be of any type, repeat, or be null. Training keys may be
of any type that orders; a null key comes first.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from flowsentry.functions.arrow import matrix
from flowsentry.functions.columns import col
from flowsentry.functions.session import materialise, write_json

# Candidate settings.
NEIGHBOURS = (3, 5, 7, 9, 11, 15, 21)
WEIGHTS = ("uniform", "distance")

BLOCK_ROWS = 2048
TOP_LEAVES = 4096  # leaves, whose boxes every task holds
FLAT_BOXES = 16_384  # up to here the block boxes themselves travel, which saves two shuffles
SAMPLE_ROWS = 65_536
ORDER_DIMENSIONS, ORDER_BITS = 8, 7
PIVOTS, PIVOT_SAMPLE = 8, 4_096
QUERIES_PER_COPY = 100_000
CELLS = 1 << 21  # entries of a distance matrix held at once
TILE_ROWS, TILE_QUERIES = 128, 4_096  # of a block, and the queries that meet them at once: distances stay in the cache
QUERIES_AT_ONCE = 65_536  # that a task sends to boxes together
GROUP_QUERIES = 64  # near each other, held against boxes as one
PAIRS = 1 << 19  # of query and box that leave a task together
SLACK = 1 + 1e-9

BLOCK_SCHEMA = "leaf int, block long, n int, lo binary, hi binary, ids binary, labels binary, x binary"
PACK_SCHEMA = "place long, nq int, qids binary, q binary, bound binary"
HIT_SCHEMA = "qid long, nn array<struct<d2: double, id: long, label: int>>"
NO_KEY = -(1 << 63)  # stands for a null key of whole numbers
HIT = np.dtype([("row", np.int64), ("d2", np.float64), ("id", np.int64), ("label", np.int32)])
HIT_TYPE = pa.list_(pa.struct([("d2", pa.float64()), ("id", pa.int64()), ("label", pa.int32())]))


@dataclass
class Frame:
    """The coordinates that boxes are in: turned axes (orthonormal columns), then distances to pivots."""

    axes: np.ndarray
    pivots: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray) -> Frame:
        """Principal axes of the sample, widest first, and rows of it far from each other."""
        centred = sample - sample.mean(axis=0)
        _, axes = np.linalg.eigh(centred.T @ centred)
        points = sample[:PIVOT_SAMPLE]
        pivots, far = [], ((points - points.mean(axis=0)) ** 2).sum(axis=1)
        for _ in range(min(PIVOTS, len(points))):
            pivots.append(points[int(far.argmax())])
            away = ((points - pivots[-1]) ** 2).sum(axis=1)
            far = away if len(pivots) == 1 else np.minimum(far, away)
        return cls(np.ascontiguousarray(axes[:, ::-1]), np.array(pivots))

    @property
    def width(self) -> int:
        return len(self.axes)

    def turned(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) @ self.axes

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        away = [np.sqrt(((x - p) ** 2).sum(axis=1)) for p in self.pivots]
        return np.column_stack([self.turned(x), *away])

    def box(self, x: np.ndarray) -> tuple[bytes, bytes]:
        """Bounds of the rows' coordinates, a little wider than rounding may move them."""
        found = self.coordinates(x)
        margin = 1e-13 * self.width * (np.abs(x).max(initial=0) + 1e-30)
        low, high = ((found.min(0) - margin).astype(np.float32), (found.max(0) + margin).astype(np.float32))
        return (np.nextafter(low, np.float32(-np.inf)).tobytes(), np.nextafter(high, np.float32(np.inf)).tobytes())

    def to_dict(self) -> dict:
        return {name: base64.b64encode(np.ascontiguousarray(getattr(self, name)).tobytes()).decode() for name in ("axes", "pivots")}

    @classmethod
    def from_dict(cls, d: dict, width: int) -> Frame:
        return cls(*(np.frombuffer(base64.b64decode(d[name])).reshape(-1, width) for name in ("axes", "pivots")))


def split_space(sample: np.ndarray, leaves: int) -> list[tuple]:
    """Split planes of a balanced tree over the sample: (dimension, threshold, left, right).

    Negative children are leaf numbers, stored as -1 - leaf.
    """
    nodes: list[tuple] = []
    count = 0

    def grow(rows: np.ndarray, wanted: int) -> int:
        nonlocal count
        if wanted > 1 and len(rows) > 1:
            for j in np.argsort(-rows.std(axis=0)):
                values = rows[:, j]
                cut = float(np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2])
                if cut == values.max():
                    lower = values[values < cut]
                    if len(lower) == 0:
                        continue
                    cut = float(lower.max())
                left = values <= cut
                at = len(nodes)
                nodes.append(())
                share = min(wanted - 1, max(1, round(wanted * left.mean())))
                a = grow(rows[left], share)
                b = grow(rows[~left], wanted - share)
                nodes[at] = (int(j), cut, a, b)
                return at
        count += 1
        return -count

    root = grow(sample, leaves)
    return nodes if root >= 0 else []


def leaf_of(nodes: list[tuple], frame: Frame):
    """An Arrow UDF giving the leaf number of each feature array, by its turned coordinates."""
    table = nodes or [(0, float("inf"), -1, -1)]
    dim, cut, left, right = (np.array(c) for c in zip(*table))

    @F.arrow_udf("int")
    def leaf(features: pa.Array) -> pa.Array:
        x = matrix(features)
        x = frame.turned(x) if len(x) else x
        at = np.zeros(len(x), dtype=np.int64)
        while len(x) and (at >= 0).any():
            inner = np.flatnonzero(at >= 0)
            node = at[inner]
            goes_left = x[inner, dim[node]] <= cut[node]
            at[inner] = np.where(goes_left, left[node], right[node])
        return pa.array((-1 - at).astype(np.int32))

    return leaf


def space_order(sample: np.ndarray, frame: Frame):
    """An Arrow UDF giving each feature array its place on a curve through the widest turned axes.

    The bits of the cell numbers are interleaved, so rows near each other on the curve are near
    each other in space.
    """
    use = np.argsort(-sample.std(axis=0))[:ORDER_DIMENSIONS] if len(sample) else np.zeros(0, int)
    low = sample.min(axis=0)[use] if len(sample) else np.zeros(0)
    wide = np.maximum(sample.max(axis=0)[use] - low, 1e-30) if len(sample) else np.ones(0)

    @F.arrow_udf("long")
    def place(features: pa.Array) -> pa.Array:
        x = matrix(features)
        x = frame.turned(x) if len(x) else x
        out = np.zeros(len(x), np.int64)
        if len(x) and len(use):
            top = (1 << ORDER_BITS) - 1
            cell = np.clip((x[:, use] - low) / wide * top, 0, top).astype(np.int64)
            for bit in reversed(range(ORDER_BITS)):
                for j in range(len(use)):
                    out = out << 1 | (cell[:, j] >> bit & 1)
        return pa.array(out)

    return place


def pack_blocks(block_rows: int, frame: Frame):
    """Cut rows that arrive sorted by leaf into blocks of block_rows to twice as many.

    A block never mixes leaves; only a leaf that is smaller gives a smaller block.
    """

    def block(part: int, number: int, leaf: int, ids, labels, x) -> dict:
        low, high = frame.box(x)
        return {"leaf": int(leaf), "block": part << 33 | number, "n": len(ids),
                "lo": low, "hi": high, "ids": ids.tobytes(),
                "labels": labels.tobytes(), "x": np.ascontiguousarray(x).tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, None

        def cut(rows, keep: int) -> tuple:
            """Blocks of the rows but for the last ones, of which at least ``keep`` stay."""
            nonlocal number
            made, at, end = [], 0, len(rows[0])
            while end - at > keep:
                size = end - at if not keep and end - at < 2 * block_rows else block_rows
                made.append(block(part, number, rows[0][at], *(p[at:at + size] for p in rows[1:])))
                number, at = number + 1, at + size
            return made, tuple(p[at:] for p in rows)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            new = (batch.column("leaf").to_numpy(), batch.column("id").to_numpy(),
                   batch.column("label").to_numpy(), matrix(batch.column("features")))
            held = new if held is None else tuple(np.concatenate(p) for p in zip(held, new))
            starts = [0, *(np.flatnonzero(np.diff(held[0])) + 1), len(held[0])]
            for a, b in zip(starts, starts[1:]):
                last = b == len(held[0])
                out, rest = cut(tuple(p[a:b] for p in held), 2 * block_rows if last else 0)
                if out:
                    yield pa.RecordBatch.from_pylist(out, BLOCK_ARROW)
            held = rest
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_pylist(cut(held, 0)[0], BLOCK_ARROW)

    return run


BLOCK_ARROW = pa.schema([
    ("leaf", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("lo", pa.binary()),
    ("hi", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("x", pa.binary())])
PACK_ARROW = pa.schema([
    ("place", pa.int64()), ("nq", pa.int32()), ("qids", pa.binary()), ("q", pa.binary()),
    ("bound", pa.binary())])


def box_distances(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, upper: np.ndarray | None = None) -> np.ndarray:
    """Squared distance of every query to every box, a lower bound for the box's rows: over the first
    ``width`` coordinates together, or over any single distance to a pivot behind them.

    With ``upper``, for all queries between q and upper: the least such distance if q is the lower
    corner, the largest one if q and upper are given the other way round.
    """
    upper = q if upper is None else upper
    total = np.zeros((len(q), len(lo)))
    for j in range(q.shape[1]):
        gap = np.maximum(lo[None, :, j] - upper[:, None, j], q[:, None, j] - hi[None, :, j])
        np.maximum(gap, 0, out=gap)
        gap *= gap
        if j < width:
            total += gap
        else:
            np.maximum(total, gap, out=total)
    return total


def near_groups(at: np.ndarray, most: int = GROUP_QUERIES) -> list[np.ndarray]:
    """Rows of a matrix in groups of at most so many, halved along their widest column."""
    done, left = [], [np.arange(len(at))] if len(at) else []
    while left:
        rows = left.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        points = at[rows]
        values = points[:, int((points.max(0) - points.min(0)).argmax())]
        order = np.argpartition(values, len(rows) // 2)
        left += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return done


def by_box(boxes: list[np.ndarray], rows: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """The queries of each box that occurs, from pairs."""
    names, queries = np.concatenate(boxes), np.concatenate(rows)
    order = np.argsort(names, kind="stable")
    found, starts = np.unique(names[order], return_index=True)
    return list(zip(found.tolist(), np.split(queries[order], starts[1:])))


def chunks(n: int, width: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, width))
    for at in range(0, n, step):
        yield slice(at, min(n, at + step))


def nearest(q: np.ndarray, bound: np.ndarray, x, ids, labels, k: int) -> np.ndarray:
    """The best k rows of one block per query, within its bound, as HIT records.

    The block is halved into tiles. A query without a bound takes one from its nearest tile; then a query meets
    the tiles whose box comes within its bound. A matrix product gives distances up to rounding; whatever
    could be among the best k within that error is then measured exactly, dimension by dimension.
    """
    tiles = near_groups(x, max(TILE_ROWS, 4 * k))
    lo, hi = (np.array([f.reduce(x[t], axis=0) for t in tiles]) for f in (np.fmin, np.fmax))
    x_norms, q_norms = (x * x).sum(1), (q * q).sum(1)
    # The product with these gives squared distances less the query's own square.
    factors = [np.vstack([-2 * x[t].T, x_norms[t]]) for t in tiles]
    error = 1e-11 * (1 + q_norms + x_norms.max())
    found = []
    for a in range(0, len(q), TILE_QUERIES):
        part = slice(a, a + TILE_QUERIES)
        limit, own = bound[part] + error[part] - q_norms[part], np.column_stack([q[part], np.ones(len(q[part]))])
        least = box_distances(q[part], lo, hi, x.shape[1]) - q_norms[part, None]
        unbounded = ~np.isfinite(limit)
        if len(x) > k and unbounded.any():
            first = np.where(unbounded, least.argmin(axis=1), -1)
            for t, factor in enumerate(factors):
                rows = np.flatnonzero(first == t)
                if len(rows):
                    kth = np.partition(own[rows] @ factor, k - 1, axis=1)[:, k - 1]
                    limit[rows] = kth + 2 * error[part][rows]
        hits = []
        for t, (tile, factor) in enumerate(zip(tiles, factors)):
            rows = np.flatnonzero(least[:, t] <= limit)
            r, c = np.nonzero(own[rows] @ factor <= limit[rows, None])
            hits.append((rows[r] + a, tile[c]))
        rows, c = (np.concatenate(pair) for pair in zip(*hits))
        d2 = np.zeros(len(rows))
        for j in range(x.shape[1]):
            diff = q[rows, j] - x[c, j]
            d2 += diff * diff
        keep = d2 <= bound[rows]
        best = np.empty(int(keep.sum()), HIT)
        best["row"], best["d2"] = rows[keep], d2[keep]
        best["id"], best["label"] = ids[c[keep]], labels[c[keep]]
        found.append(best_per_row(best, k))
    return np.concatenate(found)


def best_per_row(hits: np.ndarray, k: int) -> np.ndarray:
    hits = hits[np.lexsort((hits["id"], hits["d2"], hits["row"]))]
    starts = np.flatnonzero(np.r_[True, np.diff(hits["row"]) != 0]) if len(hits) else np.array([], int)
    rank = np.arange(len(hits)) - np.repeat(starts, np.diff(np.r_[starts, len(hits)]))
    return hits[rank < k]


def hit_batch(qids: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
    rows, counts = np.unique(hits["row"], return_counts=True)
    offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
    values = pa.StructArray.from_arrays(
        [pa.array(hits["d2"]), pa.array(hits["id"]), pa.array(hits["label"])],
        fields=list(HIT_TYPE.value_type))
    return pa.RecordBatch.from_arrays(
        [pa.array(qids[rows]), pa.ListArray.from_arrays(offsets, values).cast(HIT_TYPE)],
        names=["qid", "nn"])


def floats(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(-1, width).astype(np.float64)


@dataclass
class Boxes:
    """Bounding boxes by number, and the rows in each."""

    names: np.ndarray
    n: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, name: str) -> Boxes:
        def stacked(column: str) -> np.ndarray:
            return np.stack([np.frombuffer(b, np.float32) for b in table.column(column).to_pylist()]).astype(np.float64)

        order = np.argsort(table.column(name).to_numpy(), kind="stable")
        return cls(table.column(name).to_numpy()[order].astype(np.int64), table.column("n").to_numpy()[order],
                   stacked("lo")[order], stacked("hi")[order])

    def route(self, q: np.ndarray, bound: np.ndarray, k: int | None, frame: Frame) -> Iterator[list[tuple[int, np.ndarray]]]:
        """(box, queries) to visit: the nearest boxes that hold k rows together, or, without k,
        all within the bound. In lists of about PAIRS pairs each.

        Queries near each other are taken together: boxes too far for all of them are left out before
        single queries are held against boxes.
        """
        boxes, rows, pairs = [], [], 0
        at = frame.coordinates(q)
        groups = near_groups(at)
        for part in chunks(len(groups), len(self.names)):
            low = np.array([at[g].min(0) for g in groups[part]])
            high = np.array([at[g].max(0) for g in groups[part]])
            least = box_distances(low, self.lo, self.hi, frame.width, high)
            if k is None:
                limit = np.array([bound[g].max() for g in groups[part]]) * SLACK
            else:
                limit = self._reach(box_distances(high, self.lo, self.hi, frame.width, low), k)
            for g, within in zip(groups[part], least <= limit[:, None]):
                kept = np.flatnonzero(within)
                near = box_distances(at[g], self.lo[kept], self.hi[kept], frame.width)
                if k is None:
                    take = near <= bound[g, None] * SLACK
                else:
                    order = np.argsort(near, axis=1, kind="stable")
                    n = self.n[kept][order]
                    take = np.zeros(near.shape, bool)
                    np.put_along_axis(take, order, np.cumsum(n, axis=1) - n < k, axis=1)
                r, c = np.nonzero(take)
                boxes.append(kept[c])
                rows.append(g[r])
                pairs += len(r)
                if pairs >= PAIRS:
                    yield by_box(boxes, rows)
                    boxes, rows, pairs = [], [], 0
        if pairs:
            yield by_box(boxes, rows)

    def _reach(self, most: np.ndarray, k: int) -> np.ndarray:
        """Per group the distance within which, for each of its queries, boxes hold k rows together."""
        if len(self.n) == 0 or self.n.sum() < k:
            return np.full(len(most), np.inf)
        if self.n.min() >= k:
            return most.min(axis=1)
        order = np.argsort(most, axis=1)
        last = (np.cumsum(self.n[order], axis=1) >= k).argmax(axis=1)
        return np.take_along_axis(most, np.take_along_axis(order, last[:, None], axis=1), axis=1)[:, 0]


def _leaf_box(group: pa.Table) -> pa.Table:
    """The box of all blocks of a leaf."""
    boxes = Boxes.of(group, "block")
    return pa.table({
        "leaf": group.column("leaf").slice(0, 1), "n": pa.array([int(boxes.n.sum())]),
        "lo": pa.array([boxes.lo.min(0).astype(np.float32).tobytes()], pa.binary()),
        "hi": pa.array([boxes.hi.max(0).astype(np.float32).tobytes()], pa.binary())})


@dataclass
class KnnIndex:
    """Blocks of training rows; on the driver the boxes of the leaves, or of few blocks.

    ``names`` gives the keys of row numbers where keys are no whole numbers.
    """

    blocks: DataFrame
    k_max: int
    width: int
    leaves: Boxes
    flat: Boxes | None
    names: DataFrame | None
    frame: Frame

    @classmethod
    def fit(
        cls, train: DataFrame, key: str, k_max: int = max(NEIGHBOURS), block_rows: int = BLOCK_ROWS,
        seed: int = 42,
    ) -> KnnIndex:
        """Index (key, label, features) rows for searches of up to k_max neighbours.

        Of rows with equal features only the k_max with the smallest keys can ever be
        among the nearest, so the others are left out before anything is packed.
        """
        rows = train.select(col(key).alias("key"), F.col("label").cast("int").alias("label"), "features")
        names = None
        if isinstance(train.schema[key].dataType, T.IntegralType):
            rows = rows.select(F.coalesce(F.col("key").cast("long"), F.lit(NO_KEY)).alias("id"), "label", "features")
        else:  # numbers in the order of the keys
            ordered = rows.repartitionByRange("key").sortWithinPartitions("key")
            rows = materialise(ordered.withColumn("id", F.monotonically_increasing_id()), "knn-numbered")
            names, rows = rows.select("id", "key"), rows.select("id", "label", "features")
        same = Window.partitionBy("features").orderBy("id")
        rows = materialise(
            rows.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k_max).drop("r"),
            "knn-rows", spread=True)
        n = rows.count()
        if n == 0:
            raise ValueError("cannot index an empty training frame")
        leaves = max(1, min(TOP_LEAVES, n // block_rows))
        fraction = min(1.0, SAMPLE_ROWS / n)
        sample = rows.select("features").sample(fraction, seed).toArrow()
        points = matrix(sample.column("features")).astype(np.float64)
        if not len(points):
            points = matrix(rows.select("features").limit(1).toArrow().column("features")).astype(np.float64)
        frame = Frame.of(points)
        points = frame.turned(points)
        leaf = leaf_of(split_space(points, leaves), frame)
        parts = max(1, min(leaves, rows.sparkSession.sparkContext.defaultParallelism * 4))
        packed = (
            rows.withColumns({"leaf": leaf("features"), "place": space_order(points, frame)("features")})
            .repartitionByRange(parts, "leaf").sortWithinPartitions("leaf", "place", "id")
            .select("leaf", "id", "label", "features")
            .mapInArrow(pack_blocks(block_rows, frame), BLOCK_SCHEMA)
        )
        return cls.over(materialise(packed, "knn-blocks"), k_max, names, frame)

    @classmethod
    def over(cls, blocks: DataFrame, k_max: int, names: DataFrame | None, frame: Frame) -> KnnIndex:
        boxes = blocks.select("leaf", "block", F.col("n").cast("long").alias("n"), "lo", "hi")
        found = boxes.groupBy("leaf").applyInArrow(_leaf_box, "leaf int, n long, lo binary, hi binary")
        leaves = Boxes.of(found.toArrow(), "leaf")
        flat = Boxes.of(boxes.toArrow(), "block") if boxes.count() <= FLAT_BOXES else None
        return cls(blocks, k_max, frame.width, leaves, flat, names, frame)

    def _pack(self, queries: DataFrame, boxes: Boxes, k: int | None) -> DataFrame:
        """Pack (qid, features, bound) rows by the boxes they go to."""
        frame = self.frame

        def run(batches):
            for batch in gathered(batches, QUERIES_AT_ONCE):
                q, bound = matrix(batch.column("features")), batch.column("bound").to_numpy()
                for picked in boxes.route(q, bound, k, frame):
                    yield packs(boxes.names, picked, batch.column("qid").to_numpy(), q, bound)

        return materialise(queries.mapInArrow(run, PACK_SCHEMA), "knn-packs")

    def _meet(self, packed: DataFrame, side: DataFrame, task: Callable, schema: str) -> DataFrame:
        """Bring the packs sent to each place together with that place's rows, once per copy."""
        copies = packed.groupBy("place").agg(F.sum("nq").alias("visits")).select(
            "place", F.ceil(F.col("visits") / QUERIES_PER_COPY).cast("int").alias("copies"))
        right = side.join(copies, "place").withColumn(
            "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        left = packed.join(copies, "place").withColumn(
            "copy", F.pmod(F.xxhash64("qids"), F.col("copies")).cast("int")).drop("copies")
        by = ["place", "copy"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(task, schema)

    def _to_blocks(self, queries: DataFrame, k: int | None) -> DataFrame:
        """Packs by block, straight or by way of the leaves."""
        if self.flat is not None:
            return self._pack(queries, self.flat, k)
        width, frame = self.width, self.frame

        def route(left: pa.Table, right: pa.Table) -> pa.Table:
            qids, q, bound = unpacked(left, width)
            boxes = Boxes.of(right, "block")
            return pa.Table.from_batches(
                [packs(boxes.names, picked, qids, q, bound) for picked in boxes.route(q, bound, k, frame)], PACK_ARROW)

        boxes = self.blocks.select(
            F.col("leaf").cast("long").alias("place"), "block", F.col("n").cast("long").alias("n"), "lo", "hi")
        return materialise(self._meet(self._pack(queries, self.leaves, k), boxes, route, PACK_SCHEMA), "knn-packs")

    def _hits(self, packed: DataFrame, k: int) -> DataFrame:
        """The best k rows of each visited block per query."""
        width = self.width

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.Table.from_batches([hit_batch(np.zeros(0, np.int64), np.zeros(0, HIT))])
            qids, q, bound = unpacked(left, width)
            row = right.slice(0, 1).to_pylist()[0]
            hits = nearest(q.astype(np.float64), bound, floats(row["x"], width), np.frombuffer(row["ids"], np.int64),
                           np.frombuffer(row["labels"], np.int32), k)
            return pa.Table.from_batches([hit_batch(qids, hits)])

        blocks = self.blocks.select(F.col("block").alias("place"), "ids", "labels", "x")
        return self._meet(packed, blocks, search, HIT_SCHEMA)

    def search(self, queries: DataFrame, qid: str, k: int | None = None) -> DataFrame:
        """(qid, nn) with the k nearest training rows, ordered by distance, then key.

        ``qid`` is a column of unique numbers; ``numbered`` makes one. ``queries`` is read twice.
        """
        k = self.k_max if k is None else k
        if k > self.k_max:
            raise ValueError(f"the index serves at most {self.k_max} neighbours")
        asked = queries.select(col(qid).cast("long").alias("qid"), "features")
        anywhere = asked.withColumn("bound", F.lit(float("inf")))
        first = self._hits(self._to_blocks(anywhere, k), k)
        # The home blocks of a query hold few rows more than k, so these lists are short.
        distances = F.array_sort(F.flatten(F.collect_list(F.transform("nn", lambda h: h["d2"]))))
        bounds = first.groupBy("qid").agg(
            F.coalesce(F.get(distances, F.lit(k - 1)), F.lit(float("inf"))).alias("bound"))
        near = self._hits(self._to_blocks(asked.join(materialise(bounds, "knn-bounds"), "qid"), None), k)
        # Hits lie within the bound, so a query has few rows more than k here as well; structs order by distance, then key.
        return near.groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("nn"))), 1, k).alias("nn"))

    def key_of(self, rows: DataFrame, column: str = "id") -> DataFrame:
        """Replace row numbers by the training keys they stand for."""
        if self.names is None:
            return rows.withColumn(column, F.when(F.col(column) != NO_KEY, F.col(column)))
        names = self.names.select(F.col("id").alias(column), "key")
        return rows.join(names, column).drop(column).withColumnRenamed("key", column)


def numbered(df: DataFrame, name: str = "_query") -> DataFrame:
    """The rows with a unique number each, written once so that the numbers stay."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "knn-queries", spread=True)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches' rows in tables of at least so many; only the last one may be smaller."""
    held = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def packs(names, pick, qids, q32, bound) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([
        {"place": int(names[b]), "nq": len(i), "qids": qids[i].tobytes(),
         "q": np.ascontiguousarray(q32[i]).tobytes(), "bound": bound[i].tobytes()}
        for b, i in pick], PACK_ARROW)


def unpacked(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, features and bounds of packed rows."""
    qids, q, bound = (b"".join(table.column(c).to_pylist()) for c in ("qids", "q", "bound"))
    return np.frombuffer(qids, np.int64), np.frombuffer(q, np.float32).reshape(-1, width), np.frombuffer(bound)


def vote_share(nn: Column, k: int, weights: str) -> Column:
    """The attack share of the k nearest rows' votes.

    Under distance weights rows at distance 0, if there are any, decide alone.
    """
    near = F.slice(nn, 1, k)
    if weights == "distance":
        exact = F.filter(near, lambda h: h["d2"] == 0)
        voters = F.when(F.size(exact) > 0, exact).otherwise(near)
        weight = lambda h: F.when(h["d2"] == 0, F.lit(1.0)).otherwise(F.lit(1.0) / F.sqrt(h["d2"]))
    elif weights == "uniform":
        voters, weight = near, lambda h: F.lit(1.0)
    else:
        raise ValueError(f"unknown weights {weights!r}")
    both = F.aggregate(
        voters, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("t")),
        lambda s, h: F.struct((s["a"] + weight(h) * h["label"]).alias("a"), (s["t"] + weight(h)).alias("t")),
    )
    return both["a"] / both["t"]


def grid_votes(grid: Sequence[tuple[int, str]]):
    """An Arrow UDF giving the ``vote`` of ``vote_share`` for each of several (k, weights), over lists that are in order.

    Running sums over a list hold the sums for every k.
    """
    for _, weights in grid:
        if weights not in WEIGHTS:
            raise ValueError(f"unknown weights {weights!r}")

    @F.arrow_udf("array<int>")
    def votes(nn: pa.Array) -> pa.Array:
        sizes = nn.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        there = np.arange(max(1, sizes.max(initial=0)))[None, :] < sizes[:, None]
        rows, (d2, label) = nn.flatten(), np.zeros((2, *there.shape))
        d2[there], label[there] = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("d2", "label"))
        sums = {"uniform": there.astype(np.float64)}
        exact = there & (d2 == 0)
        # Rows at distance 0 come first and vote alone.
        sums["distance"] = np.where(exact[:, :1], exact, np.divide(1.0, np.sqrt(d2), out=np.zeros(d2.shape), where=there & ~exact))
        sums = {name: (np.cumsum(w * label, axis=1), np.cumsum(w, axis=1)) for name, w in sums.items()}
        out = np.empty((len(sizes), len(grid)), np.int32)
        for i, (k, weights) in enumerate(grid):
            attack, total = (part[:, min(k, there.shape[1]) - 1] for part in sums[weights])
            with np.errstate(invalid="ignore"):
                out[:, i] = attack / total > 0.5
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * len(grid)), pa.array(out.ravel()))

    return votes


def vote(share: Column) -> Column:
    """The class with the larger share; a tie goes to normal."""
    return (share > 0.5).cast("int")


@dataclass
class KnnModel:
    """Nearest-neighbour classifier over an index."""

    index: KnnIndex
    k: int
    weights: str

    def attach(self, df: DataFrame, score: str, label: str, number: str | None = None) -> DataFrame:
        """``number`` names a column of unique numbers of rows that are written already."""
        if df.isStreaming:
            raise ValueError("a neighbour search needs whole batches: score streams with score_batches")
        asked, name = (numbered(df), "_query") if number is None else (df, number)
        voted = self.index.search(asked, name, self.k).select(
            F.col("qid").alias(name), vote_share(F.col("nn"), self.k, self.weights).alias(score))
        return asked.join(voted, name).drop(name).withColumn(label, vote(F.col(score)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Into a folder of its own, so that a model may be saved over the one it was loaded from."""
        folder = f"index-{uuid.uuid4().hex}"
        self.index.blocks.write.parquet(f"{path}/{folder}/blocks")
        if self.index.names is not None:
            self.index.names.write.parquet(f"{path}/{folder}/names")
        write_json(spark, path + "/kind", {
            "kind": "knn", "k": self.k, "weights": self.weights, "k_max": self.index.k_max,
            "folder": folder, "named": self.index.names is not None,
            "width": self.index.width, "frame": self.index.frame.to_dict()})

    @classmethod
    def load(cls, spark: SparkSession, path: str, d: dict) -> KnnModel:
        folder = f"{path}/{d['folder']}"
        names = spark.read.parquet(folder + "/names") if d["named"] else None
        frame = Frame.from_dict(d["frame"], d["width"])
        index = KnnIndex.over(spark.read.parquet(folder + "/blocks"), d["k_max"], names, frame)
        return cls(index, d["k"], d["weights"])


def fit_knn(train: DataFrame, key: str, k: int = 5, weights: str = "uniform") -> KnnModel:
    return KnnModel(KnnIndex.fit(train, key, k), k, weights)


def knn_topk(train: DataFrame, queries: DataFrame, key: str, k: int) -> DataFrame:
    """Neighbours as rows (qid, rank, id, distance, label), a set of k per query row.

    ``qid`` is the query's key; query rows of equal or null key give rows each.
    """
    asked, index = numbered(queries.select(col(key).alias("qkey"), "features")), KnnIndex.fit(train, key, k)
    found = index.search(asked, "_query", k).select("qid", F.posexplode("nn").alias("pos", "h")).select(
        F.col("qid").alias("_query"), (F.col("pos") + 1).alias("rank"), F.col("h.id").alias("id"),
        F.sqrt("h.d2").alias("distance"), F.col("h.label").alias("label"))
    named = index.key_of(found).join(asked.select("_query", F.col("qkey").alias("qid")), "_query")
    return named.select("qid", "rank", "id", "distance", "label")


def knn_predict(
    train: DataFrame, queries: DataFrame, key: str, k: int = 5, weights: str = "uniform"
) -> DataFrame:
    """(qid, share, prediction) for every query row; qid is the query's key."""
    asked = queries.select(col(key).alias("qid"), "features")
    return fit_knn(train, key, k, weights).attach(asked, "share", "prediction").drop("features")

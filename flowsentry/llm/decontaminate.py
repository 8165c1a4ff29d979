"""Benchmark texts inside documents, found with suffix arrays over shards of the documents.

A shard is a run of documents of one task, some MB of text. Its words are numbered by the
benchmark's vocabulary; words that no benchmark text has, and neighbours that stand side by side
in none, end a run, since no match can pass them. The suffix array of the remaining runs is built
by prefix doubling, and every benchmark suffix is searched in it by bisection, one word deeper at
a time, for all suffixes at once. What is left of the interval at a window's length are all places
of that window; where it becomes empty is the longest verbatim match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, binary, row_key, slices, split_by_size

WINDOW = 10
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 32 << 20  # of benchmark text searched, and broadcast, at a time

# Digits, letters in lower case and all bytes beyond ASCII make words; anything else parts them.
_WORDS = bytes(
    low if chr(low).isascii() and (chr(low).isdigit() or chr(low).islower()) or low >= 0x80 else 32
    for low in ASCII_LOWER
)


def words(data: bytes) -> list[bytes]:
    return data.translate(_WORDS).split()


@dataclass(frozen=True)
class Benchmark:
    """One block of benchmark texts as word numbers, a 0 behind each text."""

    vocabulary: dict[bytes, int]
    stream: np.ndarray
    names: list  # item id by item number
    item: np.ndarray  # item number by place in the stream, for the places where a suffix starts
    start: np.ndarray  # those places
    need: np.ndarray  # length of the window at each, 0 where none begins
    neighbours: np.ndarray  # sorted pairs of adjacent words

    @staticmethod
    def build(rows: list[tuple[object, bytes | None]], window: int) -> Benchmark:
        vocabulary: dict[bytes, int] = {}
        stream, names, item, start, need = [], [], [], [], []
        for name, data in rows:
            codes = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(data or b"")]
            if not codes:
                continue
            size = min(window, len(codes))
            for k in range(len(codes)):
                item.append(len(names))
                start.append(len(stream) + k)
                need.append(size if k + size <= len(codes) else 0)
            names.append(name)
            stream += [*codes, 0]
        flat = np.array(stream, np.int64)
        pairs = flat[:-1] * (len(vocabulary) + 1) + flat[1:] if len(flat) else flat
        both = pairs[(flat[:-1] > 0) & (flat[1:] > 0)] if len(flat) else flat
        return Benchmark(vocabulary, flat, names, np.array(item, np.int64), np.array(start, np.int64),
                         np.array(need, np.int64), np.unique(both))

    @property
    def shortest(self) -> int:
        return int(self.need[self.need > 0].min()) if len(self.need) else 0


def suffix_array(codes: np.ndarray, longest: int) -> np.ndarray:
    """Places in order of the text from there on, told apart up to ``longest`` words."""
    _, rank = np.unique(codes, return_inverse=True)
    size, step = len(codes), 1
    while step < longest and size and rank.max() < size - 1:
        ahead = np.zeros(size, np.int64)
        ahead[:-step] = rank[step:] + 1
        _, rank = np.unique(rank * np.int64(size + 1) + ahead, return_inverse=True)
        step *= 2
    return np.argsort(rank, kind="stable")


def _bound(codes: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int,
           wanted: np.ndarray, right: bool) -> np.ndarray:
    """Bisection in every interval [low, high) for ``wanted`` as the word at ``depth``."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        at = order[np.minimum(middle, len(order) - 1)] + depth
        value = np.where(at < len(codes), codes[np.minimum(at, len(codes) - 1)], 0)
        after = (value <= wanted) if right else (value < wanted)
        low = np.where(open_ & after, middle + 1, low)
        high = np.where(open_ & ~after, middle, high)
    return low


def search(codes: np.ndarray, order: np.ndarray, bench: Benchmark, whole: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Yields (depth, suffixes, low, high) for the suffixes still found at each depth from 1 on.

    Without ``whole``, a suffix is followed to its window's length only.
    """
    active = np.arange(len(bench.start)) if whole else np.flatnonzero(bench.need > 0)
    low, high = np.zeros(len(active), np.int64), np.full(len(active), len(order), np.int64)
    depth = 0
    while len(active):
        wanted = bench.stream[bench.start[active] + depth]
        begin = _bound(codes, order, low, high, depth, wanted, False)
        end = _bound(codes, order, begin, high, depth, wanted, True)
        found = (begin < end) & (wanted > 0)
        active, low, high = active[found], begin[found], end[found]
        depth += 1
        if len(active):
            yield depth, active, low, high
        if not whole:
            more = bench.need[active] > depth
            active, low, high = active[more], low[more], high[more]


class Shard:
    """Word numbers of some documents, and the suffix array of what a benchmark text could match."""

    def __init__(self, texts: list[bytes | None], bench: Benchmark):
        get = bench.vocabulary.get
        numbers = []
        self.lengths = np.zeros(len(texts), np.int64)
        for k, data in enumerate(texts):
            found = words(data or b"")
            self.lengths[k] = len(found)
            numbers.append(np.fromiter((get(w, 0) for w in found), np.int32, len(found)))
            numbers.append(np.zeros(1, np.int32))
        self.codes = np.concatenate(numbers).astype(np.int64) if numbers else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        self.bench = bench
        self._cut()

    def _cut(self) -> None:
        codes, bench = self.codes, self.bench
        known = codes > 0
        joined = np.zeros(len(codes), bool)  # to the word before
        if len(codes) > 1 and len(bench.neighbours):
            both = np.flatnonzero(known[1:] & known[:-1]) + 1
            pairs = codes[both - 1] * (len(bench.vocabulary) + 1) + codes[both]
            place = np.minimum(np.searchsorted(bench.neighbours, pairs), len(bench.neighbours) - 1)
            joined[both[bench.neighbours[place] == pairs]] = True
        begins = np.flatnonzero(known & ~joined)
        runs = np.cumsum(known & ~joined)[known] - 1
        size = np.bincount(runs, minlength=len(begins))
        keep = size >= max(1, bench.shortest)
        self.longest = int(size.max()) if len(size) else 0
        at = np.flatnonzero(known)[keep[runs]] if len(begins) else np.zeros(0, np.int64)
        edges = np.flatnonzero(np.concatenate([[False], ~joined[at[1:]]])) if len(at) else []
        self.place = np.insert(at, edges, -1)
        self.kept = np.where(self.place >= 0, codes[np.maximum(self.place, 0)], 0) if len(at) else np.zeros(0, np.int64)

    def order(self) -> np.ndarray:
        order = suffix_array(self.kept, self.longest + 1)
        return order[self.kept[order] > 0]

    def windows(self) -> tuple[np.ndarray, set[tuple[int, int]]]:
        """Is each word of the shard hit, and the (document, item) pairs with a window in common."""
        change, pairs = np.zeros(len(self.codes) + 1, np.int64), set()
        order = self.order()
        if len(order):
            for depth, active, low, high in search(self.kept, order, self.bench, whole=False):
                full = self.bench.need[active] == depth
                for suffix, a, b in zip(active[full], low[full], high[full]):
                    at = self.place[order[a:b]]
                    np.add.at(change, at, 1)
                    np.add.at(change, at + depth, -1)
                    documents = np.searchsorted(self.first, at, "right") - 1
                    pairs.update((int(d), int(self.bench.item[suffix])) for d in np.unique(documents))
        return np.cumsum(change[:-1]) > 0, pairs

    def longest_matches(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, word in the item, length, document, word in the document) of every suffix found."""
        order = self.order()
        best: dict[int, tuple[int, int]] = {}
        if len(order):
            for depth, active, low, _ in search(self.kept, order, self.bench, whole=True):
                best.update(zip(active.tolist(), zip([depth] * len(active), low.tolist())))
        ends = np.flatnonzero(self.bench.stream == 0)
        for suffix, (length, low) in best.items():
            at = int(self.place[order[low]])
            document = int(np.searchsorted(self.first, at, "right") - 1)
            start = int(self.bench.start[suffix])
            item = int(self.bench.item[suffix])
            begin = int(ends[item - 1]) + 1 if item else 0
            yield item, start - begin, length, document, at - int(self.first[document])


def _shards(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, text, SHARD_BYTES)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, bytes | None]]]:
    """The benchmark in blocks of about BLOCK_BYTES of text: a stated query set."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0)) + 16
    for block in split_by_size(rows, size, BLOCK_BYTES, ["item", "text"]):
        yield [(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in block.collect()]


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items; a row per document row.

    Null and empty texts have no words; items without a word match nothing; items of equal id count
    once. Repeated rows give a row each. Other columns are not read. One scan per benchmark block; a
    benchmark of one block needs no shuffle, more blocks are merged by row.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind, item_type = benchmark.schema[item_col].dataType.simpleString(), _arrow_type(benchmark, item_col)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    found = []
    for block in list(_blocks(benchmark, item_col, item_text_col)) or [[]]:
        shared = spark.sparkContext.broadcast(Benchmark.build(block, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in _shards(batches, "text"):
                bench = shared.value
                shard = Shard(binary(piece.column("text")).to_pylist(), bench)
                hit, pairs = shard.windows()
                items: dict[int, set] = {}
                for document, item in pairs:
                    items.setdefault(document, set()).add(bench.names[item])
                places = [np.flatnonzero(hit[a:a + n]) if k in items else []
                          for k, (a, n) in enumerate(zip(shard.first[:-1].tolist(), shard.lengths.tolist()))]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id"), "key": piece.column("key"),
                    "n_words": pa.array(shard.lengths),
                    "places": pa.array(places, pa.list_(pa.int32())),
                    "items": pa.array([list(items.get(k, ())) for k in range(piece.num_rows)], pa.list_(item_type))})

        found.append(source.mapInArrow(
            run, f"doc_id {kind}, key string, n_words long, places array<int>, items array<{item_kind}>"))
    rows = found[0]
    if len(found) > 1:
        rest = found[1].filter("size(places) > 0")
        for more in found[2:]:
            rest = rest.unionByName(more.filter("size(places) > 0"))
        # Equal rows have equal hits, so a set per row key is right for each of them.
        rest = rest.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places_"),
                                       F.array_distinct(F.flatten(F.collect_set("items"))).alias("items_"))
        rows = rows.join(rest, "key", "left").select(
            "doc_id", "n_words",
            F.array_union("places", F.coalesce("places_", F.array().cast("array<int>"))).alias("places"),
            F.array_union("items", F.coalesce("items_", F.array().cast(f"array<{item_kind}>"))).alias("items"))
    names = F.array_sort(F.array_distinct(F.transform("items", lambda x: F.coalesce(x.cast("string"), F.lit("")))))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("places") > 0).alias("contaminated"),
        names.alias("items"))


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per benchmark suffix that begins anywhere in the documents: item_id, item_start, length,
    doc_id, doc_start of a longest verbatim match (the smallest such document id and place).

    Grouped by suffix after each shard has sent one row, so nothing grows with a hot passage.
    Items whose id occurs twice are told apart by their text.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind, item_type = benchmark.schema[item_col].dataType.simpleString(), _arrow_type(benchmark, item_col)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for number, block in enumerate(_blocks(benchmark, item_col, item_text_col)):
        shared = spark.sparkContext.broadcast(Benchmark.build(block, 1))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in _shards(batches, "text"):
                bench = shared.value
                rows = list(Shard(binary(piece.column("text")).to_pylist(), bench).longest_matches())
                ids = piece.column("doc_id").take(pa.array([r[3] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_pydict({
                    "number": pa.array([r[0] for r in rows], pa.int64()),
                    "item_id": pa.array([bench.names[r[0]] for r in rows], item_type),
                    "item_start": pa.array([r[1] for r in rows], pa.int64()),
                    "length": pa.array([r[2] for r in rows], pa.int64()), "doc_id": ids,
                    "doc_start": pa.array([r[4] for r in rows], pa.int64())})

        rows = source.mapInArrow(run, f"number long, item_id {item_kind}, item_start long, length long, doc_id {kind}, doc_start long")
        rows = rows.withColumn("block", F.lit(number))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_kind}, item_start long, length long, doc_id {kind}, doc_start long")
    best = F.min(F.struct((-F.col("length")).alias("l"), "doc_id", "doc_start")).alias("best")
    return out.groupBy("block", "number", "item_id", "item_start").agg(best).select(
        "item_id", "item_start", (-F.col("best.l")).alias("length"), "best.doc_id", "best.doc_start")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                        item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no window of any benchmark text."""
    spark = docs.sparkSession
    for block in _blocks(benchmark, benchmark.columns[0], item_text_col):
        shared = spark.sparkContext.broadcast(Benchmark.build(block, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in _shards(batches, text_col):
                shard = Shard(binary(piece.column(text_col)).to_pylist(), shared.value)
                _, pairs = shard.windows()
                clean = np.ones(piece.num_rows, bool)
                clean[[document for document, _ in pairs]] = False
                yield piece.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

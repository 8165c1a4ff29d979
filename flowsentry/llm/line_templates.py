"""Recurring lines across documents, found through a log-template tree.

The tree has a fixed depth: a line goes by its number of tokens, then by its LEAD leading tokens,
where a token with a digit counts as a variable field. The leaf it reaches is generalised around
its most frequent line: lines that agree with it in SIMILAR of their tokens, place by place, share
its template, whose differing places are variable fields. The lines left are generalised around the
most frequent of them, and so on until too few are left to recur. A template that occurs in LEAST_DOCS documents or more recurs, one of LONG_TOKENS tokens
or more from LONG_DOCS documents on: its lines are dropped from all of them but the first, by id, so
that no passage is lost altogether. Lines of fewer than LEAST_TOKENS tokens have no variable fields;
they recur token for token in SHORT_TIMES as many documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.session import materialise

from .common import binary, fresh, row_hashes, slices
from .words import part_of, spelt

LEAD = 3
SIMILAR = 0.8
LEAST_DOCS = 5
LEAST_TOKENS = 5  # shorter lines are too plain to speak of a template
LONG_TOKENS, LONG_DOCS = 50, 2  # a line this long does not recur by chance
SHORT_TIMES = 4
HEADS, CHUNK = 1_000, 20_000  # distinct lines of a leaf: centres to try in a round, and lines in a task's group

_INSIDE = bytes(x not in b" \t\n\r\x0b\x0c" for x in range(256))  # 1 in a token
_DIGIT = bytes(x in b"0123456789" for x in range(256))  # 1 for a digit
_FIELD, _PLAIN = b"\x00", b" "  # no token holds a blank
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(29))


def parse(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """Of every line with a token: its text, its place there, its number of tokens; and all their
    token numbers in a row, 64-bit hashes that are the same in every task. Digits of lines below
    LEAST_TOKENS count as they are."""
    data = b"\n".join(text or b"" for text in texts) + b"\n"
    start, _, tokens = spelt(np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_INSIDE), bool))
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == ord("\n"))
    ends = np.cumsum([len(text or b"") + 1 for text in texts])
    line = part_of(start, breaks)
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1])[:len(line)])
    row, size = part_of(start[first], ends), np.diff(np.append(first, len(line)))
    place = line[first] - np.searchsorted(breaks, np.append(0, ends))[row]
    # Equal tokens are hashed once.
    words, word = tokens.dictionary.to_pylist(), tokens.indices.to_numpy()
    number = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    letters = b"".join(words)
    bounds = np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))
    digits = np.append(0, np.cumsum(np.frombuffer(letters.translate(_DIGIT), np.uint8), dtype=np.int64))[bounds]
    number[digits[1:] > digits[:-1]] = xxhash.xxh64_intdigest(_FIELD)
    codes = number[word]
    short = np.flatnonzero(np.repeat(size < LEAST_TOKENS, size))
    plain, used = np.zeros(len(words), np.uint64), np.unique(word[short])
    plain[used] = np.fromiter((xxhash.xxh64_intdigest(_PLAIN + words[k]) for k in used.tolist()), np.uint64, len(used))
    codes[short] = plain[word[short]]
    return row, place.astype(np.int32), size, codes


def _keys(size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each line's path to its leaf (count, leading tokens) and of the whole line; a line
    below LEAST_TOKENS is a leaf of its own."""
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    within = np.arange(len(codes)) - np.repeat(first, size)
    mixed = _mix(codes * _mix((within + 1).astype(np.uint64) * _SEED) + _SEED)
    lead = np.add.reduceat(np.where(within < LEAD, mixed, np.uint64(0)), first)
    lead = _mix(lead + size.astype(np.uint64))
    whole = _mix(np.add.reduceat(mixed, first) + lead)
    lead = np.where(size < LEAST_TOKENS, whole, lead)
    return lead.view(np.int64), whole.view(np.int64)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line with a token: k1, k2 (the row), doc_id, place, size (tokens), leaf, line and
    shape (16 bits of every token's number)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                row, place, size, codes = parse(binary(piece.column("text")).to_pylist())
                leaf, line = _keys(size, codes)
                shape = (codes >> np.uint64(48)).astype(np.uint16)
                ends = np.append(0, np.cumsum(2 * size)).astype(np.int32)
                shapes = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(shape)])
                columns = {c: piece.column(c).take(pa.array(row)) for c in ("k1", "k2", "doc_id")}
                yield pa.RecordBatch.from_pydict(columns | {
                    "place": pa.array(place), "size": pa.array(size.astype(np.int32)), "leaf": pa.array(leaf),
                    "line": pa.array(line), "shape": shapes})

    k1, k2 = row_hashes(id_col, text_col)
    source = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"k1 long, k2 long, doc_id {kind}, place int, size int, leaf long, line long, shape binary")


def _generalise(lines: pa.Table) -> pa.Table:
    """Goes through the heads of a leaf, most frequent first: each that is not yet placed takes all
    lines like it under its template. Lines like no head get none."""
    lines = lines.sort_by([("head", "descending"), ("n", "descending"), ("line", "descending")])
    line, own = lines["line"].to_numpy(), lines["own"].to_numpy()
    shapes = np.frombuffer(b"".join(lines["shape"].to_pylist()), np.uint16).reshape(len(line), -1)
    template, left = np.zeros(len(line), np.int64), np.ones(len(line), bool)
    for k in range(np.count_nonzero(lines["head"].to_numpy())):
        if left[k]:
            rest = np.flatnonzero(left)
            like = rest[(shapes[rest] == shapes[k]).sum(axis=1) >= SIMILAR * shapes.shape[1]]
            template[like], left[like] = line[k], False
    lines = lines.select(["leaf", "size", "line", "shape", "n"]).append_column("template", pa.array(template, mask=left))
    return lines.filter(pa.array(own))


def _templates(kinds: DataFrame, least_docs: int) -> DataFrame | None:
    """leaf, line, template of the distinct lines whose template is another line's; None if no leaf
    holds two that may recur.

    A round tries the HEADS most frequent lines of every leaf as centres, in that order. Most leaves
    have fewer and are done in one round; larger ones are dealt out in groups of CHUNK lines that
    each get the heads. All groups come to the same templates.
    """
    by, need = ["leaf", "size"], _need(least_docs)
    columns = [*by, "line", "shape", "n"]
    left, found = kinds.filter(F.col("size") >= LEAST_TOKENS), None
    while True:
        sizes = left.groupBy(*by).agg(F.count("*").alias("lines"), F.sum("n").alias("rows"))
        sizes = materialise(sizes.filter((F.col("lines") > 1) & (F.col("rows") >= need)).drop("rows"), "leaves")
        most = sizes.agg(F.max("lines")).head()[0]
        if most is None:
            return found
        left = left.join(sizes, by)
        true, false = F.lit(True), F.lit(False)
        groups = left.filter(F.col("lines") <= HEADS).select(
            *columns, F.lit(0).alias("part"), true.alias("head"), true.alias("own"))
        if most > HEADS:
            large = left.filter(F.col("lines") > HEADS).withColumn("parts", F.ceil(F.col("lines") / CHUNK).cast("int"))
            rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), F.desc("line")))
            heads = large.withColumn("rank", rank).filter(F.col("rank") <= HEADS)
            part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
            groups = groups.unionByName(heads.select(*columns, part.alias("part"), true.alias("head"), false.alias("own")))
            part = F.pmod(F.xxhash64("line"), F.col("parts")).cast("int")
            groups = groups.unionByName(large.select(*columns, part.alias("part"), false.alias("head"), true.alias("own")))
        done = groups.groupBy(*by, "part").applyInArrow(
            _generalise, "leaf long, size int, line long, shape binary, n long, template long")
        done = materialise(done, "generalised")
        moved = done.filter("template != line").select("leaf", "line", "template")
        found = moved if found is None else found.unionByName(moved)
        if most <= HEADS:
            return found
        left = done.filter("template is null").select(*columns)


def _need(least_docs: int) -> Column:
    """How many documents a template of ``size`` tokens must occur in."""
    return (F.when(F.col("size") >= LONG_TOKENS, min(LONG_DOCS, least_docs))
            .when(F.col("size") < LEAST_TOKENS, SHORT_TIMES * least_docs).otherwise(least_docs))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    least_docs: int = LEAST_DOCS) -> DataFrame:
    """k1, k2 and ``places`` (line numbers to drop) of the rows that lose lines.

    Every step groups by leaf, template or row with partial sums, and lines are compared once each,
    however often they occur; joins are on the leaf, line or template, where a hot key lies on one
    side only, which adaptive execution splits.
    """
    lines = materialise(_lines(docs, id_col, text_col), "lines")
    need = _need(least_docs)
    # A template needs as many rows in its leaf as documents, so smaller leaves hold none.
    busy = (
        lines.groupBy("leaf").agg(F.count("*").alias("n"), F.min("k1").alias("a"), F.max("k1").alias("b"), F.min("size").alias("size"))
        .filter((F.col("n") >= need) & (F.col("a") != F.col("b"))).select("leaf")
    )
    some = materialise(lines.join(busy, "leaf"), "busy-lines")
    kinds = some.groupBy("leaf", "size", "line").agg(F.count("*").alias("n"), F.min("shape").alias("shape"))
    placed = some.drop("shape")
    moved = _templates(materialise(kinds, "kinds"), least_docs)
    if moved is None:
        placed = placed.withColumnRenamed("line", "template")
    else:
        placed = materialise(placed.join(moved, ["leaf", "line"], "left").withColumn(
            "template", F.coalesce("template", "line")).drop("line"), "templates")
    recurring = (
        placed.select("leaf", "template", "size", "doc_id", "k1", "k2").distinct()
        .groupBy("leaf", "template").agg(
            F.count("*").alias("n"), F.min("size").alias("size"), F.min(F.struct("doc_id", "k1", "k2")).alias("first"))
        .filter(F.col("n") >= need).select("leaf", "template", "first")
    )
    later = placed.join(recurring, ["leaf", "template"]).filter(
        (F.col("k1") != F.col("first.k1")) | (F.col("k2") != F.col("first.k2")))
    return later.groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         least_docs: int = LEAST_DOCS, count_as: str | None = None) -> DataFrame:
    """The table with the recurring lines taken out of ``text_col``; other columns stay.

    ``count_as`` names a column to add with the number of lines dropped. Null and empty texts stay as
    they are. A text that loses all its lines becomes empty. Repeated rows count as one document and
    lose the same lines; of rows of equal id but different text, each is a document. Documents are
    shuffled once, by row.
    """
    k1, k2 = fresh("k1", docs), fresh("k2", docs)
    places = fresh("places", docs)
    a, b = row_hashes(id_col, text_col)
    keyed = docs.withColumns({k1: a, k2: b})
    gone = recurring_lines(docs, id_col, text_col, least_docs).toDF(k1, k2, places)
    joined = keyed.join(gone, [k1, k2], "left").select(*[F.col(f"`{c}`") for c in docs.columns], places)
    number = count_as and fresh(count_as, docs) or None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_col):
                out, counts = [], []
                for data, drop in zip(binary(piece.column(text_col)).to_pylist(), piece.column(places).to_pylist()):
                    if data is not None and drop:
                        gone = set(drop)
                        data = b"\n".join(x for k, x in enumerate(data.split(b"\n")) if k not in gone)
                    out.append(data)
                    counts.append(len(drop or ()))
                columns = {c: piece.column(c) for c in docs_columns}
                columns[text_col] = pa.array(out, pa.binary()).cast(pa.string())
                if number:
                    columns[number] = pa.array(counts, pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    docs_columns = list(docs.columns)
    return joined.mapInArrow(run, schema + (f", `{number}` long" if number else ""))

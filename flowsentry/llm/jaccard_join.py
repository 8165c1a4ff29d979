"""Exact set-similarity join of documents on word shingles, and its connected components.

Two documents link when 100 * |A and B| >= 75 * |A or B|. Candidates must share a token of their
prefixes under several global token orders. A prefix holds the first n - ceil(3 n / 4) + 1 of a
set's n tokens; two sets that link share a prefix token under any order that is the same for all.

* The smaller of two sets needs its first n - ceil(6 n / 7) + 1 tokens only ("early" ones), since
  the two must have 6/7 of its tokens in common at least, over what the larger one has.
* The first order puts rare tokens first: tokens that fill many prefixes of a plain hash order go
  behind, the most frequent last. It generates the candidates. A posting whose token nobody shares
  is dropped before anything is joined, and of lists with the same members one is kept.
* Sizes and parity bitmaps (each token flips one bit, so sets that differ in d tokens differ in d
  bits at most) and then the prefixes under the other orders are checked before verification.
* What is left is verified on the whole sets.

Equal sets are one class throughout. In a posting list of up to SHORT members all pairs are compared
by size and bitmap. Within a longer list pairs are not spelt out: in each round a few members, the hubs,
are compared with the others; members already in one component need no comparison. Some hubs are the
same for all lists that share them, others differ by list. Only for lists that still hold several
components after all rounds are the pairs between components compared, so that no link between
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsentry.functions.session import drop_shuffles, materialise, release

from .common import binary, fresh, row_hashes, slices
from .shingles import mix, shingle_sets

PERCENT = 75
HOT = 8  # a token in this many prefixes of the plain order goes behind
MOST_HOT = 1 << 21  # tokens whose frequency class is broadcast (9 bytes each); the most frequent
SHORT = 48
HUBS, COMMON_HUBS = (1, 6), 3  # of a list by round; of them, those picked alike for all lists
ROUNDS = len(HUBS)
SHARD_BYTES = 1 << 20  # of text whose shingles are computed at a time
BITMAP, FOLDED = 32, 8  # 64-bit words of a set's bitmap; folded to so many for short lists
ORDERS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0))
BLOOM_BITS = 26
SALTS = 64


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def early_length(n: int) -> int:
    """Prefix of the smaller set: 100 i >= 75 (n + m - i) and m >= n leave i >= 6/7 n."""
    return n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1 if n else 0


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that only equal sets have in common."""
    return tuple(np.frombuffer(blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64).tolist())


def plain_prefix(tokens: np.ndarray, order: int) -> np.ndarray:
    """The prefix under one of the hash orders, as keys of that order."""
    keys = mix(tokens ^ ORDERS[order])
    size = prefix_length(len(keys))
    return np.partition(keys, size - 1)[:size] if 0 < size < len(keys) else keys


class TokenClasses:
    """Frequency classes of the hot tokens; every other token is of class 0."""

    def __init__(self, keys: np.ndarray, classes: np.ndarray):
        at = np.argsort(keys)
        self.keys, self.classes = keys[at], classes[at]

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.uint8)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.classes[place], 0).astype(np.uint8)

    def prefix(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the prefix under (class, hash), and whether each is hot."""
        keys = mix(tokens ^ ORDERS[0])
        classes = self.of(keys)
        first = np.lexsort((keys, classes))[:prefix_length(len(keys))]
        return keys[first], classes[first] > 0


def _parity(tokens: np.ndarray) -> np.ndarray:
    bits = np.bincount((tokens >> np.uint64(64 - 11)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per document: doc_id, k1, k2 (the row), f1, f2 (its set), n, and the bitmap."""
    kind = docs.schema[id_col].dataType.simpleString()
    k1, k2 = row_hashes(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SHARD_BYTES):
                sets = shingle_sets(binary(piece.column("text")).to_pylist())
                prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
                bits = np.array([_parity(s) for s in sets], np.int64).reshape(-1, BITMAP)
                columns = {c: piece.column(c) for c in ("doc_id", "k1", "k2")}
                columns |= {"f1": pa.array(prints[:, 0]), "f2": pa.array(prints[:, 1]),
                            "n": pa.array([len(s) for s in sets], pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | {f"b{k}": pa.array(bits[:, k]) for k in range(BITMAP)})

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), k1.alias("k1"), k2.alias("k2"))
    bits = "".join(f", b{k} long" for k in range(BITMAP))
    return source.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, f1 long, f2 long, n long" + bits)


def _token_classes(docs: DataFrame, id_col: str, text_col: str) -> TokenClasses:
    """Count every token of the plain order's prefixes and class the frequent ones.

    Equal sets of a slice count once. Any classes give right results; they only have to be the same
    for all documents, so it is safe to leave the less frequent out when there are too many.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SHARD_BYTES):
                sets = {s.tobytes(): s for s in shingle_sets(binary(piece.column("text")).to_pylist())}.values()
                found = [plain_prefix(s, 0) for s in sets]
                keys, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"token": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    counted = _source(docs, id_col, text_col).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    hot = materialise(counted.filter(F.col("n") >= HOT), "hot-tokens")
    # Powers of two of the count are the classes; whole classes are taken, the highest first.
    sized = hot.select("token", F.floor(F.log2("n")).cast("int").alias("class"))
    sizes = sorted(((r["class"], r["count"]) for r in sized.groupBy("class").count().collect()), reverse=True)
    lowest, total = 64, 0
    for level, size in sizes:
        if total + size > MOST_HOT:
            break
        lowest, total = level, total + size
    found = sized.filter(F.col("class") >= lowest).toArrow()
    release(hot)
    return TokenClasses(found["token"].to_numpy().view(np.uint64), found["class"].to_numpy().astype(np.uint8))


def _shared_postings(docs: DataFrame, classes: TokenClasses, id_col: str, text_col: str) -> DataFrame:
    """(token, f1, f2, early) of the first order's prefixes, for the tokens that two sets or more have.

    Postings are dealt out by token, a hot token's over SALTS places, and sorted there, so that a
    token nobody shares is seen from its neighbours without holding a list.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SHARD_BYTES):
                sets = {s.tobytes(): s for s in shingle_sets(binary(piece.column("text")).to_pylist()) if len(s)}.values()
                found = [(*shared.value.prefix(s), fingerprint(s)) for s in sets]
                sizes = [len(keys) for keys, _, _ in found]
                prints = np.repeat(np.array([p for _, _, p in found], np.int64).reshape(-1, 2), sizes, axis=0)
                hot = np.concatenate([h for _, h, _ in found] or [np.zeros(0, bool)])
                keys = np.concatenate([k for k, _, _ in found] or [np.zeros(0, np.uint64)])
                salt = np.where(hot, 1 + (prints[:, 0] % SALTS), 0).astype(np.int8)
                # Keys come in the order of the prefix, so the early ones lead.
                early = np.concatenate([np.arange(len(k)) < early_length(len(s)) for (k, _, _), s in zip(found, sets)]
                                       or [np.zeros(0, bool)])
                yield pa.RecordBatch.from_pydict({
                    "token": pa.array(keys.view(np.int64)), "salt": pa.array(salt), "early": pa.array(early.astype(np.int8)),
                    "f1": pa.array(prints[:, 0].copy()), "f2": pa.array(prints[:, 1].copy())})

    def keep_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "f1", "f2", "early", "salt"]
        held, alike = [np.zeros(0, np.int64)] * 5, False  # the last row, and is it like the one before it
        for batch in batches:
            rows = [np.append(h, batch.column(c).to_numpy()) for h, c in zip(held, names)]
            new = np.append(True, np.any([np.diff(r) != 0 for r in rows[:3]], axis=0)) if len(rows[0]) else np.zeros(0, bool)
            rows = [r[new] for r in rows]  # a set's repeats from other tasks stand side by side
            if not len(rows[0]):
                continue
            follows = np.append(alike, rows[0][1:] == rows[0][:-1])
            shared = (follows | np.append(follows[1:], False) | (rows[4] > 0))[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(r[:-1][shared].astype(np.int64)) for r in rows[:4]], names=names[:4])
            held, alike = [r[-1:] for r in rows], bool(follows[-1])
        last = alike or len(held[4]) and held[4][0] > 0
        yield pa.RecordBatch.from_arrays([pa.array(r[:1 if last else 0].astype(np.int64)) for r in held[:4]], names=names[:4])

    postings = _source(docs, id_col, text_col).mapInArrow(run, "token long, salt byte, early byte, f1 long, f2 long")
    spread = postings.repartition("token", "salt").sortWithinPartitions("token", "f1", "f2")
    return spread.mapInArrow(keep_shared, "token long, f1 long, f2 long, early long")


def _candidate_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(f1, f2, tokens) of documents whose id is among ``wanted`` (doc_id).

    The ids go into a Bloom filter of fixed size (8 MB); a few sets too many do no harm, since the
    result is joined on the set's fingerprint.
    """
    size = 1 << BLOOM_BITS
    slots = wanted.select(F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("slot"))
    words = slots.groupBy(F.floor(F.col("slot") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            held = (shared.value[slot // 64] >> (slot % 64).astype(np.uint64)) & np.uint64(1) > 0
            for piece in slices(batch.filter(pa.array(held)), "text", SHARD_BYTES):
                sets = list({s.tobytes(): s for s in shingle_sets(binary(piece.column("text")).to_pylist())}.values())
                prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({
                    "f1": pa.array(prints[:, 0]), "f2": pa.array(prints[:, 1]),
                    "tokens": pa.array([s.tobytes() for s in sets], pa.binary())})

    source = docs.select(F.pmod(F.xxhash64(id_col), F.lit(size)).alias("slot"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "f1 long, f2 long, tokens binary")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other orders' prefixes first, then the whole sets; linked pairs pass."""
    for batch in batches:
        linked = []
        for a, b in zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist()):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            ok = all(_common(plain_prefix(a, k), plain_prefix(b, k)) for k in range(1, len(ORDERS)))
            if ok:
                both = _common(a, b)
                ok = 100 * both >= PERCENT * (len(a) + len(b) - both)
            linked.append(ok)
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of class ids that link."""
    first = sets.select(F.col("id").alias("a"), F.col("tokens").alias("tokens_a"))
    second = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tokens_b"))
    return pairs.join(first, "a").join(second, "b").mapInArrow(_verify, "a long, b long")


_BITS = [f"b{k}" for k in range(BITMAP)]
_FEW = [f"c{k}" for k in range(FOLDED)]


def _folded() -> list[Column]:
    """The bitmap of fewer bits: a bit is the parity of those it stands for."""
    return [reduce(lambda a, b: a.bitwiseXOR(b), [F.col(c) for c in _BITS[k::FOLDED]]).alias(name) for k, name in enumerate(_FEW)]


def _may_link(bits: list[str]) -> Column:
    """Sizes, bitmaps and prefixes of the columns of two sides allow a link.

    100 i >= 75 (n + m - i) leaves at most (n + m) / 7 tokens, so bits, of difference.
    """
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_"))) for c in bits), F.lit(0))
    smaller = (F.col("n") < F.col("n_")) | ((F.col("n") == F.col("n_")) & (F.col("id") < F.col("id_")))
    return ((F.when(smaller, F.col("early")).otherwise(F.col("early_")) > 0)
            & (100 * F.least("n", "n_") >= PERCENT * F.greatest("n", "n_"))
            & ((100 + PERCENT) * apart <= (100 - PERCENT) * (F.col("n") + F.col("n_"))))


def _other(rows: DataFrame) -> DataFrame:
    """The same rows as the second side of a join by token."""
    return rows.select("token", *(F.col(c).alias(f"{c}_") for c in rows.columns if c != "token"))


def _pairs(left: DataFrame, right: DataFrame, condition: Column, bits: list[str]) -> DataFrame:
    found = left.join(right, (left["token"] == right["token"]) & condition & _may_link(bits))
    return found.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b), component the smallest id reachable.

    Alternating large-star and small-star steps; each writes its edges to the shared folder, where only
    the last ones stay. A step groups by node with partial minima, so hubs do not gather their
    neighbours in one task.
    """
    def both_ways(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def written(e: DataFrame, label: str) -> tuple[DataFrame, tuple]:
        """The written edges, and their number and hash sum, which come with the writing."""
        seen = Observation()
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        table = materialise(e.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("total")), label)
        return table, (seen.get["n"], seen.get["total"])

    edges, state = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    before = None
    while state != before and state[0]:
        before = state
        every = both_ways(edges)
        lowest = every.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = every.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = materialise(large, "large-star")
        release(edges)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        edges, state = written(small, "small-star")
        release(large)
    found = materialise(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "components")
    release(edges)
    return found


def _joined_components(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` (id, component) after the further ``links`` (a, b). Only the links between unlike
    components are followed; the components they join are renamed."""
    ends = [components.select(F.col("id").alias(c), F.col("component").alias(f"{c}_")) for c in "ab"]
    between = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
        F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"))
    roots = connected_components(between)
    renamed = components.join(roots.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left")
    new = roots.join(components.select("id"), "id", "left_anti")
    joined = materialise(renamed.select("id", F.coalesce("root", "component").alias("component")).unionByName(new), "components")
    release(roots)
    release(components)
    return joined


def _link_long_lists(postings: DataFrame, links: DataFrame, sets: DataFrame, rounds: int) -> DataFrame:
    """(id, component) after the links found so far and those between members of long lists.
    ``postings``: token, id, n and bitmap."""
    components, active = connected_components(links), None
    for number in range(rounds + 1):
        if active is None:  # else no link was found in the last round
            placed = postings.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
            # Lists whose members all are in one component are done.
            spread = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
            active = materialise(placed.join(spread.filter("low != high").select("token"), "token"), "active")
        if active.isEmpty():
            break
        if number < rounds:
            # A hub is the smallest id under a scrambling of its own.
            salts = [F.lit(int(mix(np.array([8 * number + k + 1], np.uint64))[0] >> np.uint64(1))) for k in range(HUBS[number])]
            salts = [salt if k < COMMON_HUBS else F.xxhash64("token", salt) for k, salt in enumerate(salts)]
            least = active.groupBy("token").agg(*[F.min(F.col("id").bitwiseXOR(x)).alias(f"h{k}") for k, x in enumerate(salts)])
            hubs = least.select("token", F.explode(F.array_distinct(F.array(
                *[F.col(f"h{k}").bitwiseXOR(x) for k, x in enumerate(salts)]))).alias("id"))
            hubs = _other(active.join(hubs, ["token", "id"]))
            pairs = _pairs(active, hubs, F.col("component") != F.col("component_"), _BITS)
        else:
            pairs = _pairs(active, _other(active), F.col("component") < F.col("component_"), _BITS)
        links = materialise(_verified(pairs, sets), "verified")
        if not links.isEmpty():
            components = _joined_components(components, links)
            release(active)
            active = None
        release(links)
    if active is not None:
        release(active)
    return components


def _components(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, k1, k2, f1, f2, n, ...) and, by f1 and f2, the component of every class with a
    word: its label and its smallest (doc_id, k1, k2).

    Each table in the shared folder goes as soon as nothing reads it any more."""
    rows = materialise(_sketches(docs, id_col, text_col), "sketches")
    bits = [F.first(c).alias(c) for c in _BITS]
    classes = rows.filter("n > 0").groupBy("f1", "f2").agg(
        F.min(F.struct("doc_id", "k1", "k2")).alias("least"), F.first("n").alias("n"), *bits)
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    bare = materialise(rows.drop(*_BITS), "rows")
    release(rows)
    tokens = _token_classes(docs, id_col, text_col)
    drop_shuffles(docs.sparkSession)  # the sketches by set and the tokens' counts
    postings = _shared_postings(docs, tokens, id_col, text_col).join(classes.select("f1", "f2", "id"), ["f1", "f2"])
    postings = materialise(postings.groupBy("token", "id").agg(F.max("early").alias("early")), "postings")
    # Lists with the same members and early marks, told by 128 hash bits, give the same pairs.
    lists = postings.groupBy("token").agg(
        F.count("*").alias("members"), F.sum("early").alias("earlies"),
        F.bit_xor(F.xxhash64("id", "early")).alias("x"), F.bit_xor(F.xxhash64("early", "id", F.lit(1))).alias("y"))
    lists = lists.filter("earlies > 0 and members > 1").groupBy("members", "x", "y").agg(F.min("token").alias("token"))
    kept = materialise(postings.join(lists.select("token", "members"), "token"), "lists")
    release(postings)
    del postings, lists
    drop_shuffles(docs.sparkSession)  # a row per token of every prefix
    short = kept.filter(F.col("members") <= SHORT).drop("members").join(classes.select("id", "n", *_folded()), "id")
    long = kept.filter(F.col("members") > SHORT).drop("members").join(classes.select("id", "n", *_BITS), "id")
    short, long = materialise(short, "short-lists"), materialise(long, "long-lists")
    release(kept)
    pairs = materialise(_pairs(short, _other(short), F.col("id") < F.col("id_"), _FEW), "pairs")
    release(short)
    del kept, short
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(long.select("id")).distinct()
    wanted = materialise(classes.join(ids, "id", "left_semi").select("id", "f1", "f2", F.col("least.doc_id").alias("doc_id")), "wanted")
    sets = _candidate_sets(docs, wanted.select("doc_id"), id_col, text_col).join(wanted.drop("doc_id"), ["f1", "f2"])
    # A class may be met in several documents; one set of it is enough.
    sets = materialise(sets.groupBy("id").agg(F.first("tokens").alias("tokens")), "sets")
    release(wanted)
    drop_shuffles(docs.sparkSession)  # the lists' pairs and whole sets
    links = materialise(_verified(pairs, sets), "verified")
    release(pairs)
    del pairs, ids, wanted
    drop_shuffles(docs.sparkSession)
    linked = _link_long_lists(long, links, sets, ROUNDS)
    for done in (links, long, sets):
        release(done)
    named = classes.select("f1", "f2", "id", "least").join(linked, "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    first = named.groupBy("component").agg(F.min("least").alias("first"))
    named = materialise(named.join(first, "component").select("f1", "f2", "component", "first"), "named")
    release(linked)
    release(classes)
    return bare, named


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    ``component_id`` is the smallest id that links reach, the row's own included. Null texts and texts
    without words have no shingles and link with nothing. Repeated rows and equal ids give a row each;
    links are between sets, so rows of equal id but unlike texts do not link. Null ids order first.
    Other columns are not read.
    """
    rows, named = _components(docs, id_col, text_col)
    joined = rows.select("doc_id", "f1", "f2", "n").join(named.select("f1", "f2", "first"), ["f1", "f2"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"),
                         F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with one row of every component, all columns as they are.

    The row with the smallest id stays, of equal ids the one with the smaller row hash, of repeated
    rows any one. Rows without words all stay. Documents are shuffled once, by row.
    """
    rows, named = _components(docs, id_col, text_col)
    chosen = named.groupBy("component").agg(F.first("first").alias("first")).select("first.k1", "first.k2", F.lit(True).alias("one"))
    empty = rows.filter("n = 0").select("k1", "k2", F.lit(False).alias("one")).distinct()
    k1, k2, one, number = (fresh(c, docs) for c in ("k1", "k2", "one", "number"))
    a, b = row_hashes(id_col, text_col)
    kept = docs.withColumns({k1: a, k2: b}).join(chosen.unionByName(empty).toDF(k1, k2, one), [k1, k2])
    kept = kept.withColumn(number, F.row_number().over(W.partitionBy(k1, k2).orderBy(F.lit(0))))
    return kept.filter((F.col(number) == 1) | ~F.col(one)).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Toxicity of documents by multiple-instance learning: labels are of documents, scores of sentences.

A document's sentences are its instances. Each sentence has a logistic score of its words and their
beginnings; a document is toxic if any sentence is: P = 1 - product of (1 - p) (noisy-or). The weights
are fitted to the documents' labels through P, so a toxic document puts its weight on the sentences
that explain it. They start from the words' log-odds in the labelled documents and are improved by
Adam steps on whole gradients, which tasks sum over the sample. A share of the sample that the fit
does not see calibrates the documents' log-odds. The sentences that a document's score comes from are
then located.

Labelled rows are a bounded sample (LABELLED, the lowest hashes of their id, one row per id); features
that fewer than LEAST_DOCS of them have are not used. What is broadcast and collected has a fixed bound:
2 ** BITS hashed features at most. Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.arrow import sum_over_tasks, vector_batch
from flowsentry.functions.session import materialise

from .common import ASCII_LOWER, binary, slices
from .words import SpanHashes, spans

LABELLED = 16_000  # labelled documents to learn from, at most
CALIBRATION = 4  # one of so many of them calibrates
LEAST_DOCS = 4
BITS = 22
BEGINNINGS = (4, 5, 6)  # bytes of a longer word that are features too
STEPS, RATE, PENALTY = 30, 0.1, 1e-5
THRESHOLD = 0.7
TASKS = 16
SHARD_BYTES = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789'")] = True
_WORD[128:] = True
_STOP = np.zeros(256, bool)  # ends a sentence
_STOP[list(b".!?\n")] = True


class Sentences:
    """The sentences with a word of some texts in a row, and the hashed features of their words."""

    def __init__(self, texts: list[bytes]):
        codes = np.frombuffer(b"\n".join(texts).translate(ASCII_LOWER) + b"\n", np.uint8)
        start, end = spans(_WORD[codes])
        number = np.cumsum(_STOP[codes])[start]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.flatnonzero(np.append(True, np.diff(number) > 0)) if len(start) else np.zeros(0, int)
        self.size = np.diff(np.append(self.first, len(start)))  # words
        self.text = np.searchsorted(ends, start[self.first], side="right")
        self.codes, self.offset = codes, np.append(0, ends)[self.text]
        self.start = start[self.first]
        self.end = end[self.first + self.size - 1] if len(start) else self.start
        hashes, length = SpanHashes(codes, start, end), end - start
        shift = np.uint64(64 - BITS)
        self.slots = [(hashes.whole() >> shift).astype(np.int32)]
        for size in BEGINNINGS:
            # A beginning is told from a word of the same letters by a bit, and absent from short words.
            slot = (hashes.first(size) >> shift).astype(np.int32) ^ 1
            self.slots.append(np.where(length > size, slot, -1))

    def odds(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Of every sentence; ``weights`` has one place more, a zero, for absent features."""
        if not len(self.first):
            return np.zeros(0)
        total = weights[self.slots[0]].astype(np.float64)
        for slot in self.slots[1:]:
            total += weights[slot]
        return np.add.reduceat(total, self.first) + bias

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every sentence in its text, in code points."""
        before = np.append(0, np.cumsum((self.codes & 0xC0) != 0x80))
        return before[self.start] - before[self.offset], before[self.end] - before[self.offset]


def noisy_or(odds: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    """log(1 - P) of every document."""
    return np.bincount(text, -np.logaddexp(0, odds), minlength=count)[:count]


def _log_odds(none: np.ndarray) -> np.ndarray:
    """Of P, from log(1 - P)."""
    none = np.clip(none, -500, -1e-12)
    return np.log(-np.expm1(none)) - none


@dataclass(frozen=True)
class ToxicityModel:
    """``slots`` are the features in use. Without slots every score is ``share``."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    share: float

    def table(self) -> np.ndarray:
        out = np.zeros((1 << BITS) + 1, np.float32)
        out[self.slots] = self.weights
        return out

    def score(self, odds: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
        if not len(self.slots):
            return np.full(count, self.share)
        z = self.slope * _log_odds(noisy_or(odds, text, count)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(id_col: str = "doc_id") -> Column:
    """Is the document kept from learning?"""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """y, fit and text of the labelled sample, one row per id."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col(f"`{id_col}`").isNotNull()).groupBy(
        F.col(f"`{id_col}`").alias("doc_id")).agg(F.min("toxic").cast("int").alias("y"), F.max("toxic").alias("top"))
    marked = marked.filter("y = top").filter(~held_out()).drop("top")
    known = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # At most LABELLED ids, so the broadcast is bounded.
    rows = source.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("row"))
    fit = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION)) > 0
    return rows.select("row.y", fit.alias("fit"), "row.text")


def _odds_of_features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The features of LEAST_DOCS documents or more, and with how many documents of each class they occur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SHARD_BYTES):
                found = Sentences(binary(piece.column("text")).to_pylist())
                text = np.repeat(found.text, found.size)
                label = np.array(piece.column("y").to_pylist(), np.int64)
                pairs = np.concatenate([(text.astype(np.int64) << BITS) + s for s in found.slots])
                pairs = np.unique(pairs[np.concatenate([s >= 0 for s in found.slots])])
                slot, y = pairs & ((1 << BITS) - 1), label[pairs >> BITS]
                names, place = np.unique(slot, return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "slot": pa.array(names), "n": pa.array(np.bincount(place, minlength=len(names)).astype(np.int64)),
                    "toxic": pa.array(np.bincount(place, y, minlength=len(names)).astype(np.int64))})

    counted = sample.filter("fit").mapInArrow(run, "slot long, n long, toxic long").groupBy("slot").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    found = counted.filter(F.col("n") >= LEAST_DOCS).toArrow().sort_by("slot")
    n, toxic = found["n"].to_numpy(), found["toxic"].to_numpy()
    return found["slot"].to_numpy(), np.stack([n - toxic, toxic])


def _features(sample: DataFrame, slots: np.ndarray) -> DataFrame:
    """A row per document: y, fit, the places of its features in ``slots`` and their sentence."""
    shared = sample.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SHARD_BYTES):
                known = shared.value
                found = Sentences(binary(piece.column("text")).to_pylist())
                sentence = np.repeat(np.arange(len(found.size)), found.size)
                flat = np.concatenate(found.slots)
                place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                has = known[place] == flat
                place, sentence = place[has].astype(np.int32), np.tile(sentence, len(found.slots))[has]
                order = np.argsort(sentence, kind="stable")
                place, sentence = place[order], sentence[order]
                begins = np.searchsorted(found.text, np.arange(piece.num_rows + 1))  # sentences by document
                cuts = np.searchsorted(sentence, begins)
                rows = [(place[a:b].tobytes(), (sentence[a:b] - c).astype(np.int32).tobytes(), d - c)
                        for a, b, c, d in zip(cuts, cuts[1:], begins, begins[1:])]
                yield pa.RecordBatch.from_pydict({
                    "y": piece.column("y"), "fit": piece.column("fit"), "place": pa.array([r[0] for r in rows], pa.binary()),
                    "sentence": pa.array([r[1] for r in rows], pa.binary()), "sentences": pa.array([r[2] for r in rows], pa.int32())})

    return materialise(sample.repartition(TASKS).mapInArrow(
        run, "y int, fit boolean, place binary, sentence binary, sentences int"), "toxic-features")


def _stacked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Feature places, their sentence, the sentences' document, and y of a batch of feature rows."""
    counts = batch.column("sentences").to_numpy()
    starts = np.append(0, np.cumsum(counts))
    place = [np.frombuffer(x, np.int32) for x in batch.column("place").to_pylist()]
    sentence = [np.frombuffer(x, np.int32) + a for x, a in zip(batch.column("sentence").to_pylist(), starts)]
    return (np.concatenate(place), np.concatenate(sentence), np.repeat(np.arange(len(counts)), counts),
            batch.column("y").to_numpy())


def _fit(features: DataFrame, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias."""
    tasks = features.rdd.getNumPartitions()
    fit = features.filter("fit")
    totals = fit.agg(F.sum(1 - F.col("y")), F.sum("y"), F.sum("sentences")).head()
    clean, toxic = int(totals[0]), int(totals[1])
    logs = np.log(counts + 1) - np.log([[clean + 2], [toxic + 2]])
    weights = np.maximum(logs[1] - logs[0] - 2, 0)
    bias = float(np.log(toxic / max(1, totals[2]))) - 1
    state = np.append(weights, bias)
    mean, square = np.zeros(len(state)), np.zeros(len(state))
    for step in range(1, STEPS + 1):
        shared = features.sparkSession.sparkContext.broadcast(state.astype(np.float32))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shared.value))
            for batch in batches:
                place, sentence, text, y = _stacked(batch)
                odds = np.bincount(sentence, shared.value[place], minlength=len(text)) + float(shared.value[-1])
                odds = np.clip(odds, -40, 40)
                none = noisy_or(odds, text, len(y))
                # d log P(label) / d odds: -p for a clean document, p (1 - P) / P for a toxic one.
                pull = np.where(y == 1, np.exp(-np.clip(_log_odds(none), -40, 40)), -1.0)
                slope = pull[text] / (1 + np.exp(-odds))
                total[:-1] += np.bincount(place, slope[sentence], minlength=len(total) - 1)
                total[-1] += slope.sum()
            yield vector_batch(total)

        gradient = sum_over_tasks(fit, task, tasks) / (clean + toxic)
        gradient[:-1] -= PENALTY * state[:-1]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient ** 2
        root = np.sqrt(square / (1 - 0.99 ** step)) + 1e-6
        state = state + RATE * mean / (1 - 0.9 ** step) / root
        shared.destroy()
    return state[:-1], float(state[-1])


def _calibrate(features: DataFrame, weights: np.ndarray, bias: float) -> tuple[float, float]:
    """Slope and shift of the documents' log-odds, on those that the fit has not seen."""
    shared = features.sparkSession.sparkContext.broadcast(np.append(weights, bias))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, sentence, text, y = _stacked(batch)
            odds = np.bincount(sentence, shared.value[place], minlength=len(text)) + shared.value[-1]
            yield pa.RecordBatch.from_pydict({"z": _log_odds(noisy_or(odds, text, len(y))), "y": y})

    rows = features.filter("not fit").mapInArrow(task, "z double, y int").toArrow()  # LABELLED rows at most
    if not rows.num_rows:
        return 1.0, 0.0
    z, y = rows["z"].to_numpy(), rows["y"].to_numpy()
    x, at = np.stack([np.clip(z, -30, 30), np.ones(len(z))], axis=1), np.array([1.0, 0.0])
    prior, centre = np.array([4.0, 0.25]), np.array([1.0, 0.0])  # drawn to leaving the log-odds as they are

    def loss(at: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ at)).sum() + (prior * (at - centre) ** 2).sum() / 2)

    for _ in range(25):  # Newton steps, halved while they do not help
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        slope = x.T @ (y - p) - prior * (at - centre)
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(prior), slope)
        while np.abs(move).max() > 1e-9 and loss(at + move) > loss(at):
            move = move / 2
        at = at + move
    return float(max(at[0], 0.05)), float(at[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learn from the labelled documents that are not held out.

    Labels other than 0 and 1, ids with both and null ids are left out; of rows of equal id the one
    with the smaller text counts. With fewer than five labels of either class nothing is fitted, and
    every document's score is the share of toxic labels (0 without any).
    """
    sample = materialise(_sample(docs, labels, id_col, text_col), "toxic-sample")
    clean, toxic = (int(x or 0) for x in sample.agg(F.sum(1 - F.col("y")), F.sum("y")).head())
    share = toxic / max(1, clean + toxic)
    nothing = ToxicityModel(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, 1.0, 0.0, share)
    if min(clean, toxic) < 5:
        return nothing
    slots, counts = _odds_of_features(sample)
    if not len(slots) or not counts[1].any():
        return nothing
    features = _features(sample, slots)
    weights, bias = _fit(features, counts)
    return ToxicityModel(slots, weights.astype(np.float32), bias, *_calibrate(features, weights, bias), share)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, worst_start, worst_end, worst_score of every row.

    The worst sentence lies at worst_start to worst_end (code points, end exclusive); the three are null
    without a word. Null and empty texts have no sentence and the least score. Repeated rows and equal or
    null ids give a row each. Other columns are not read; nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = shared.value.table() if table is None else table
            for piece in slices(batch, "text", SHARD_BYTES):
                count = piece.num_rows
                found = Sentences(binary(piece.column("text")).to_pylist())
                odds = found.odds(table, shared.value.bias)
                score = shared.value.score(odds, found.text, count)
                start, end = found.places()
                order = np.lexsort((-np.arange(len(odds)), odds, found.text))  # the first of the worst comes last
                last = np.searchsorted(found.text, np.arange(count), side="right") - 1
                number = np.bincount(found.text, minlength=count)[:count]
                none, worst = number == 0, order[np.maximum(last, 0)] if len(order) else np.zeros(count, int)
                p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

                def pick(values: np.ndarray) -> pa.Array:
                    return pa.array(values[worst], mask=none) if len(values) else pa.nulls(count, pa.array(values).type)

                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "score": pa.array(score),
                    "predicted": pa.array((score >= THRESHOLD).astype(np.int32)), "n_sentences": pa.array(number.astype(np.int64)),
                    "worst_start": pick(start.astype(np.int64)), "worst_end": pick(end.astype(np.int64)), "worst_score": pick(p)})

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"),
                         F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_sentences long, "
                                  "worst_start long, worst_end long, worst_score double")


def offending_sentences(docs: DataFrame, model: ToxicityModel, least: float = 0.5, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """doc_id, start, end (code points), sentence and score of every sentence that scores ``least`` or more."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = shared.value.table() if table is None else table
            for piece in slices(batch, "text", SHARD_BYTES):
                texts = binary(piece.column("text")).to_pylist()
                found = Sentences(texts)
                p = 1 / (1 + np.exp(-np.clip(found.odds(table, shared.value.bias), -500, 500)))
                at = np.flatnonzero((p >= least) & (len(shared.value.slots) > 0))
                start, end = found.places()
                spelt = [texts[t][a:b].decode() for t, a, b in zip(
                    found.text[at], (found.start - found.offset)[at], (found.end - found.offset)[at])]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id").take(pa.array(found.text[at])), "start": pa.array(start[at].astype(np.int64)),
                    "end": pa.array(end[at].astype(np.int64)), "sentence": pa.array(spelt, pa.string()), "score": pa.array(p[at])})

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, start long, end long, sentence string, score double")

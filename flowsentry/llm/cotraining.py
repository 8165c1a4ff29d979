"""Quality of documents by co-training two views: the text, and what describes its page.

Each view has a logistic model of its own. Both start from labelled documents; in every round each
view gives the other the unlabelled documents it is surest about, as pseudo-labels. Afterwards each
view is calibrated on labelled documents that no fit has seen, and a further logistic model on the
two calibrated log-odds combines them. All documents are then scored in one scan.

Labelled rows are a bounded sample (LABELLED, the lowest hashes of their id, one row per id).
Pseudo-labels come from all unlabelled documents, which are scored in every round; the driver gets
the ones exchanged. The fitted weights have a fixed size and are broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.session import materialise, release

from .common import binary, fresh, slices

LABELLED = 8_000  # labelled documents to fit on, at most
ROUNDS, EXCHANGED = 4, 300  # pseudo-labels of each class that a view gives in a round
SURE = 0.95
HOLDOUT = 0.3  # of the labelled sample, for calibration
FALSE_REJECTION = 0.002  # of good held-out documents that may be rejected
TRIGRAMS, PLACES = 1 << 10, 1 << 6
PENALTY = 1e-3


def text_view(data: bytes) -> np.ndarray:
    """Hashed byte trigrams (root of their share) and how much the words repeat."""
    out = np.zeros(TRIGRAMS + 3, np.float32)
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(codes) >= 3:
        grams = (codes[:-2] * 0x9E3779B1 + codes[1:-1] * 0x85EBCA77 + codes[2:] * 0xC2B2AE3D).astype(np.uint32)
        count = np.bincount(grams >> np.uint32(22), minlength=TRIGRAMS)
        out[:TRIGRAMS] = np.sqrt(count / len(grams))
        out[TRIGRAMS] = count.max() / len(grams)
    words = data.split()
    if words:
        pairs = set(zip(words, words[1:]))
        out[TRIGRAMS + 1] = 1 - len(set(words)) / len(words)
        out[TRIGRAMS + 2] = 1 - (len(pairs) + 1) / len(words)
    return out


def page_view(data: bytes, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Source and language (hashed), stated size, and layout measures; no words."""
    out = np.zeros(PLACES + 12, np.float32)
    out[zlib.crc32(f"s:{source}".encode()) % PLACES] = 1
    out[zlib.crc32(f"l:{lang}".encode()) % PLACES] = 1
    size = max(1, len(data))
    lines = data.split(b"\n")
    kept = [len(data.translate(None, chars)) for chars in (_SYMBOLS, _DIGITS, _UPPER, _BLANKS, b".,", b"!?", b"|")]
    out[PLACES] = np.log1p(n_chars if n_chars and n_chars > 0 else 0) / 10
    out[PLACES + 1] = np.log1p(len(data)) / 10
    out[PLACES + 2] = np.log1p(len(lines)) / 5
    out[PLACES + 3] = np.log1p(size / len(lines)) / 10
    out[PLACES + 4:PLACES + 11] = 1 - np.array(kept) / size
    out[PLACES + 11] = len(lines[0]) / size
    return out


_SYMBOLS, _DIGITS, _UPPER = b"#*$%&<>@^~_=+\\{}[]", b"0123456789", bytes(range(65, 91))
_BLANKS = b" \t\r\x0b\x0c"


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Logistic:
    """Weights on standardised features; ``slope`` and ``shift`` calibrate the log-odds."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.centre) / self.scale) @ self.weights + self.bias
        return self.slope * np.clip(raw, -40, 40) + self.shift

    def calibrated(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        fit = fit_logistic(self.odds(x)[:, None], y, penalty=1e-2)
        slope = float(fit.weights[0] / fit.scale[0])
        return Logistic(self.centre, self.scale, self.weights, self.bias, slope,
                        float(fit.bias - slope * fit.centre[0]))


def fit_logistic(x: np.ndarray | list[np.ndarray], y: np.ndarray, weight: np.ndarray | None = None, penalty: float = PENALTY,
                 steps: int = 200) -> Logistic:
    """Accelerated gradient steps on the penalised log-loss; classes weigh the same.

    ``x`` may come in blocks of rows. They are standardised within the products, never copied: this runs
    on the driver.
    """
    blocks = [b for b in ([x] if isinstance(x, np.ndarray) else x) if len(b)]
    ends = np.cumsum([0, *map(len, blocks)])
    weight = np.ones(len(y)) if weight is None else weight
    balance = np.array([weight[y == c].sum() for c in (0, 1)])
    weight = weight / np.maximum(balance, 1e-9)[y.astype(int)] / 2
    centre = (sum(b.sum(axis=0, dtype=np.float64) for b in blocks) / len(y)).astype(np.float32)
    pieces = [(a + at, b[at:at + 256]) for a, b in zip(ends, blocks) for at in range(0, len(b), 256)]
    square = sum(np.einsum("ij,ij->j", d := p - centre, d, dtype=np.float64) for _, p in pieces)
    scale = np.maximum(np.sqrt(square / max(1, len(y))), 1e-6).astype(np.float32)
    length = sum(float(weight[a:a + len(p)] @ (np.einsum("ij,ij->i", d := (p - centre) / scale, d) + 1)) for a, p in pieces)
    step = 1 / (0.25 * length + penalty)
    w = ahead = np.zeros(len(centre) + 1)
    for k in range(steps):
        slant = (ahead[:-1] / scale).astype(np.float32)
        raw = np.concatenate([b @ slant for b in blocks]) - float(slant.astype(np.float64) @ centre) + ahead[-1]
        error = weight * (_sigmoid(raw) - y)
        total = sum((error[a:b].astype(np.float32) @ block).astype(np.float64) for a, b, block in zip(ends, ends[1:], blocks))
        slope = np.append((total - error.sum() * centre) / scale, error.sum()) + penalty * np.append(ahead[:-1], 0)
        new = ahead - step * slope
        ahead, w = new + k / (k + 3) * (new - w), new
    return Logistic(centre, scale, w[:-1].astype(np.float32), float(w[-1]))


@dataclass(frozen=True)
class CoTrained:
    text: Logistic
    page: Logistic
    both: Logistic
    cutoff: float

    def score(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odds = np.stack([self.text.odds(text), self.page.odds(page)], axis=1)
        return _sigmoid(odds[:, 0]), _sigmoid(odds[:, 1]), _sigmoid(self.both.odds(odds))


# By view: the features of the documents it receives, and their pseudo-labels.
Received = list[tuple[np.ndarray, np.ndarray]]


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_page: np.ndarray,
             seed: int = 0) -> CoTrained | None:
    """Fit on labelled rows ``y`` (0, 1) and unlabelled pools; None without both classes."""
    pools = [pool_text, pool_page]
    given = [np.full(len(pool_text), -1) for _ in pools]  # pseudo-labels that each view has received

    def exchange(models: list[Logistic]) -> Received:
        new = []
        for k in (1, 0):
            other, before = 1 - k, given[1 - k].copy()
            chance = _sigmoid(models[k].odds(pools[k]))
            for label, sure in ((1, chance), (0, 1 - chance)):
                free = np.where(given[other] < 0, sure, 0)
                best = np.argsort(-free, kind="stable")[:EXCHANGED]
                given[other][best[free[best] >= SURE]] = label
            has = given[other] != before
            new.append((pools[other][has], given[other][has]))
        return new

    return _co_train([text, page], y, exchange, seed)


def _co_train(rows: list[np.ndarray], y: np.ndarray, exchange: Callable[[list[Logistic]], Received],
              seed: int = 0) -> CoTrained | None:
    """As ``co_train``; ``exchange`` gives the pseudo-labels that the views receive in a round. ``rows``,
    both views of the labelled rows, is emptied, so that they are not held twice."""
    held = np.random.default_rng(seed).random(len(y)) < HOLDOUT
    if min(np.bincount(y[~held], minlength=2)) < 5 or min(np.bincount(y[held], minlength=2)) < 2:
        return None
    shown, views = [], []
    while rows:
        view = rows.pop(0)
        shown.append(view[~held])
        views.append(view[held])
        del view
    given = [[] for _ in views]

    def fitted(k: int) -> Logistic:
        target = np.concatenate([y[~held], *(label for _, label in given[k])])
        weight = np.where(np.arange(len(target)) < (~held).sum(), 1.0, 0.5)
        return fit_logistic([shown[k], *(rows for rows, _ in given[k])], target, weight)

    models = [fitted(k) for k in range(2)]
    for _ in range(ROUNDS):
        new = exchange(models)
        if not any(len(label) for _, label in new):
            break
        for mine, rows in zip(given, new):
            mine.append(rows)
        models = [fitted(k) for k in range(2)]
    models = [m.calibrated(v, y[held]) for m, v in zip(models, views)]
    odds = np.stack([m.odds(v) for m, v in zip(models, views)], axis=1)
    both = fit_logistic(odds, y[held], penalty=1e-2)
    good = np.sort(_sigmoid(both.odds(odds[y[held] == 1])))
    return CoTrained(*models, both, float(min(0.5, good[int(FALSE_REJECTION * len(good))])))


def _views(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data = [x or b"" for x in binary(piece.column("text")).to_pylist()]
    about = zip(data, *(piece.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
    text = np.stack([text_view(x) for x in data])
    return text, np.stack([page_view(*x) for x in about])


def _view_columns(docs: DataFrame, text_col: str) -> dict[str, Column]:
    """What the views read; missing metadata columns count as null."""
    about = {"source": "string", "lang": "string", "n_chars": "long"}
    return {"text": F.col(text_col)} | {
        c: (F.col(c) if c in docs.columns else F.lit(None)).cast(t) for c, t in about.items()}


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), *(x.alias(c) for c, x in _view_columns(docs, text_col).items()))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> CoTrained | None:
    """Fit on documents with a label 0 or 1 in ``labels.quality`` (ids with both are left out).

    None if there are too few of either class.
    """
    about = ("text", "source", "lang", "n_chars")
    source = _narrow(docs, id_col, text_col).filter("doc_id is not null").withColumn("key", F.xxhash64("doc_id", "text"))
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(
        F.min("quality").alias("y"), F.max("quality").alias("top")).filter("y = top").drop("top")
    known = marked.orderBy(F.xxhash64("doc_id"), F.col("doc_id")).limit(LABELLED).withColumn("y", F.col("y").cast("int"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                text, page = _views(piece)
                yield pa.RecordBatch.from_pydict({
                    "y": piece.column("y").cast(pa.int32()), "key": piece.column("key"),
                    "t": [x.tobytes() for x in text], "p": [x.tobytes() for x in page]})

    def fetched(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both views, y and key of one row per id."""
        rows = rows.groupBy("doc_id").agg(F.min(F.struct("key", *about, "y")).alias("row")).select("row.*")
        found = rows.mapInArrow(features, "y int, key long, t binary, p binary").toArrow()
        # The result must not depend on the order of arrival.
        order = np.argsort(found["key"].to_numpy(), kind="stable")
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        y, key = found["y"].to_numpy()[order], found["key"].to_numpy()[order]
        sides = []
        for name, width in (("t", TRIGRAMS + 3), ("p", PLACES + 12)):
            out = np.empty((found.num_rows, width), np.float32)
            for k, value in zip(place, found[name]):
                out[k] = np.frombuffer(value.as_buffer(), np.float32)
            sides.append(out)
            found = found.drop_columns([name])
        del found
        pa.default_memory_pool().release_unused()  # the driver's memory is better free for the JVM
        return *sides, y, key

    # Ids of any label, also an unclear one, are not exchanged.
    marked_ids = labels.select(F.col(id_col).alias("doc_id")).distinct()
    kind = source.schema["doc_id"].dataType.simpleString()
    given = [[], []]  # keys of the documents that each view has received

    def exchange(models: list[Logistic]) -> Received:
        shared = docs.sparkSession.sparkContext.broadcast(models)

        def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch, "text"):
                    chance = [_sigmoid(m.odds(x)).astype(np.float64) for m, x in zip(shared.value, _views(piece))]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": piece.column("doc_id"), "key": piece.column("key"),
                        "c0": pa.array(chance[0]), "c1": pa.array(chance[1])})

        scored = source.mapInArrow(chances, f"doc_id {kind}, key long, c0 double, c1 double")
        scored = scored.groupBy("doc_id").agg(F.min(F.struct("key", "c0", "c1")).alias("row")).select("doc_id", "row.*")
        scored = materialise(scored.join(marked_ids, "doc_id", "left_anti"), "chances")
        labels_of = [{}, {}]
        for k in range(2):
            for label, sure in ((1, F.col(f"c{k}")), (0, 1 - F.col(f"c{k}"))):
                free = scored.filter((sure >= SURE) & ~F.col("key").isin(given[1 - k]))
                best = free.orderBy(sure.desc(), "key").limit(EXCHANGED).select("key").collect()
                labels_of[1 - k] |= {r.key: label for r in best}
        for k in range(2):
            given[k] += labels_of[k]
        release(scored)
        chosen = sorted({*labels_of[0], *labels_of[1]})
        text, page, _, key = fetched(source.filter(F.col("key").isin(chosen)).withColumn("y", F.lit(-1)))
        new = []
        for x, label in zip((text, page), labels_of):
            has = np.array([k in label for k in key.tolist()], bool)
            new.append((x[has], np.array([label[k] for k in key[has].tolist()], int)))
        return new

    # At most LABELLED ids, so the broadcast is bounded.
    *rows, y, _ = fetched(source.join(F.broadcast(known), "doc_id"))
    return _co_train(rows, y, exchange)


def score_documents(docs: DataFrame, model: CoTrained | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_text, p_page, score (chance of good quality) and rejected, for every row.

    Null texts count as empty. Repeated rows give a row each. Without a model nothing is rejected and
    every score is 1.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                found = _scores(shared.value, piece)
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id")} | {
                    c: pa.array(v) for c, v in zip(("p_text", "p_page", "score", "rejected"), found)})

    return _narrow(docs, id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, p_text double, p_page double, score double, rejected boolean")


def _scores(model: CoTrained | None, piece: pa.RecordBatch) -> list[np.ndarray]:
    if model is None:
        ones = np.ones(piece.num_rows)
        return [ones, ones, ones, np.zeros(piece.num_rows, bool)]
    found = model.score(*_views(piece))
    return [*(x.astype(np.float64) for x in found), found[2] < model.cutoff]


def keep_good(docs: DataFrame, model: CoTrained | None, text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    # The views read copies under names of their own, whatever the table's columns are called.
    views = ("text", "source", "lang", "n_chars")
    copies = {c: fresh(f"view_{c}", docs) for c in views}
    wide = docs.withColumns({copies[c]: x for c, x in _view_columns(docs, text_col).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, copies["text"]):
                view = pa.RecordBatch.from_pydict({c: piece.column(copies[c]) for c in views})
                good = ~_scores(shared.value, view)[3]
                yield piece.select(names).filter(pa.array(good))

    return wide.mapInArrow(run, docs.schema)

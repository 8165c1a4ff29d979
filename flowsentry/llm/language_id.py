"""Language of texts by n-gram filters that answer for all languages at once.

Training counts character n-grams per language and keeps, for each n-gram, the languages that use
it at a comparable rate. A bit-sliced Bloom filter stores them: every slot is a bitmask over
languages, an n-gram sets its languages' bits in HASHES slots, and the AND of those slots returns
all languages that hold it. A text's n-grams are looked up, bits are counted per language, the
expected number of false positives (from each language's filling) is taken off, and the largest
corrected count decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.session import materialise

from .common import slices

SIZES = (2, 3, 4)
HASHES = 3
# The filter has 2 ** SLOT_BITS slots, or as many more as FALSE_RATE takes; 2 ** MOST_BITS of 64 languages at most.
SLOT_BITS, MOST_BITS, FALSE_RATE = 20, 23, 0.05
LEAST_COUNT = 3  # n-grams seen more rarely in a language are not taken; doubled until the largest filter holds them
RATIO = 0.5  # of an n-gram's largest rate over languages, to belong to a language
MOST_LANGUAGES = 1024
GRAM_BYTES = 1 << 20  # of text whose n-grams are held at a time: some 150 bytes each
UNKNOWN = "und"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for anything else."""
    out = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        if (char := chr(point)).isalpha():
            low = char.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of all texts, the text of each, and which texts hold a letter.

    An n-gram lies within one word or takes in the word's edge at either side.
    """
    joined = "\n" + "\n".join(t or "" for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t or "") + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    codes = _letters()[points]
    inside = codes > 0
    lettered = np.zeros(len(texts), bool)
    lettered[owner[inside[1:]]] = True
    values = codes.astype(np.uint64)
    hashes, owners = [], []
    for size in SIZES:
        count = len(codes) - size + 1
        if count <= 0:
            continue
        valid = inside[:count] | inside[1:1 + count]  # not two edges in a row
        for k in range(1, size - 1):
            valid = valid & inside[k:k + count]
        at = np.flatnonzero(valid)
        total = np.full(len(at), size, np.uint64)
        for k in range(size):
            total = (total ^ values[at + k]) * _MULTIPLIERS[k]
            total ^= total >> np.uint64(29)
        hashes.append(total)
        owners.append(owner[np.minimum(at, len(owner) - 1)])
    return np.concatenate(hashes), np.concatenate(owners), lettered


def slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of each n-gram in the filter."""
    second = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(k) * second) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass(frozen=True)
class LanguageFilter:
    """``masks[w]`` holds a 64-bit word per slot for the languages 64 w to 64 w + 63."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected n-gram counts, texts by languages, and which texts hold a letter."""
        hashes, owner, lettered = grams(texts)
        places = slots(hashes, int(self.masks.shape[1]).bit_length() - 1)
        total = np.bincount(owner, minlength=len(texts))
        out = np.zeros((len(texts), len(self.languages)))
        for word, table in enumerate(self.masks):
            found = table[places[0]]
            for place in places[1:]:
                found = found & table[place]
            for bit in range(min(64, len(self.languages) - 64 * word)):
                held = (found >> np.uint64(bit)) & np.uint64(1)
                language = 64 * word + bit
                hits = np.bincount(owner, weights=held, minlength=len(texts))
                rate = self.false_rate[language]
                out[:, language] = np.maximum(0, (hits - total * rate) / max(1e-9, 1 - rate))
        return out, lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        counts, lettered = self.counts(texts)
        best, total = counts.argmax(axis=1), counts.sum(axis=1)
        score = np.where(total > 0, counts.max(axis=1) / np.maximum(total, 1e-12), 0.0)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return names, np.where(lettered, score, 0.0).tolist()


def filter_size(most: list[int], words: int) -> tuple[int, int]:
    """Bits of a slot's number, and the least count of an n-gram to be taken.

    ``most[k]`` is the number of n-grams of the fullest language that are seen LEAST_COUNT * 2 ** k
    times; ``words`` is the number of 64-bit words a slot has.
    """
    filling = -math.log(1 - FALSE_RATE ** (1 / HASHES))
    limit = max(SLOT_BITS, MOST_BITS - (words - 1).bit_length())
    for k, number in enumerate(most):
        bits = max(SLOT_BITS, math.ceil(math.log2(max(1, HASHES * number / filling))))
        if bits <= limit:
            return bits, LEAST_COUNT << k
    raise ValueError("too many frequent n-grams for the filter")


def train_filter(rows: DataFrame, text_col: str, lang_col: str) -> LanguageFilter:
    """Learn from all rows with a text and a language; other columns are not read.

    N-grams are counted within each Arrow batch before the shuffle. The driver gets the filter's
    slots, 2 ** MOST_BITS at most, and one row per language, MOST_LANGUAGES at most.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", GRAM_BYTES):
                names = piece.column("lang").to_pylist()
                known = sorted(set(names))
                hashes, owner, _ = grams(piece.column("text").to_pylist())
                of = np.array([known.index(n) for n in names])[owner]
                for k, name in enumerate(known):
                    values, number = np.unique(hashes[of == k], return_counts=True)
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([name] * len(values), pa.string()),
                        "gram": pa.array(values.view(np.int64)), "n": pa.array(number.astype(np.int64))})

    source = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).na.drop()
    counted = source.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_gram = counted.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("uses"))
    by_gram = materialise(by_gram, "grams")
    totals = {r["lang"]: r["n"] for r in by_gram.select(F.explode("uses").alias("u")).groupBy("u.lang")
              .agg(F.sum("u.n").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(totals)
    if not languages:
        return LanguageFilter([], np.zeros((1, 1 << SLOT_BITS), np.uint64), np.zeros(0))
    number = F.create_map(*[F.lit(x) for k, name in enumerate(languages) for x in (name, k)])
    size = F.create_map(*[F.lit(x) for name in languages for x in (name, float(totals[name]))])
    rates = F.transform("uses", lambda u: F.struct(
        F.element_at(number, u["lang"]).alias("lang"), u["n"].alias("n"), (u["n"] / F.element_at(size, u["lang"])).alias("rate")))
    chosen = F.filter("rates", lambda u: (u["rate"] >= RATIO * F.array_max(F.transform("rates", lambda x: x["rate"])))
                      & (u["n"] >= LEAST_COUNT))
    members = by_gram.select("gram", rates.alias("rates")).select("gram", F.explode(chosen).alias("u"))

    # The largest number of n-grams that a language has, by how often they are seen.
    levels = range(40)
    most = (
        members.groupBy("u.lang").agg(*[F.count_if(F.col("u.n") >= (LEAST_COUNT << k)).alias(f"m{k}") for k in levels])
        .agg(*[F.max(f"m{k}") for k in levels]).head()
    )
    words = -(-len(languages) // 64)
    bits, least = filter_size([x or 0 for x in most], words)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").to_numpy()
            bit = (np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64)
            for where in slots(batch.column("gram").to_numpy().view(np.uint64), bits):
                yield pa.RecordBatch.from_pydict({"word": pa.array((lang // 64).astype(np.int32)), "slot": pa.array(where), "bit": pa.array(bit)})

    set_bits = (
        members.filter(F.col("u.n") >= least).select("gram", F.col("u.lang").alias("lang")).mapInArrow(place, "word int, slot long, bit long")
        .groupBy("word", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    masks = np.zeros((words, 1 << bits), np.uint64)
    masks[set_bits["word"].to_numpy(), set_bits["slot"].to_numpy()] = set_bits["bits"].to_numpy().view(np.uint64)
    filled = np.array([np.count_nonzero(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(languages))])
    return LanguageFilter(languages, masks, (filled / (1 << bits)) ** HASHES)


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the documents, by the checksum of their id; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from its text alone.

    Null texts and texts without a letter give ``und`` and 0. Repeated rows give a row each. The
    model has a bounded size (8 to 64 MB for 64 languages) and is broadcast.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", GRAM_BYTES):
                names, scores = shared.value.predict(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"),
                    "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")

"""Phrase collocations by dynamic itemset counting.

Texts are dealt out over SHARDS shards, which are scanned in a cycle, one a step. In the first cycle
every word is counted. As soon as both subphrases of a longer phrase (all words but the last, all but
the first) have reached the threshold by what has been counted so far, the phrase is counted too, from
the next shard on; so lengths are interleaved, and a length does not wait for the one before it to be
counted to the end. Each phrase is counted for one full cycle, after which its count is exact, and is
then kept or forgotten.

Which phrases have reached the threshold after which step is told by Bloom filters, a filter per length
and step that never changes again. A step finds a phrase's own start from its two subphrases' filters,
so every task of every step agrees on it. A false positive makes a phrase count that need not be, or
moves its cycle; its count stays exact. A filter has 16 bits a phrase and at most 2 ** MOST_BITS, so
what is broadcast is bounded; beyond that more phrases are counted in vain.

Counts are summed in tasks first and are shuffled by phrase, so no word or phrase, however frequent,
gathers its occurrences. Words are told apart as they are, phrases by 64 bits of their beginning and 64
of their last word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from flowsentry.functions.session import materialise, release

from .common import ASCII_LOWER, binary, slices
from .shingles import mix
from .words import BitFilter, part_of, span_hashes, spans

THRESHOLD, MOST_WORDS, TOP = 100, 5, 2_000
SHARDS = 4
SHARD_BYTES = 1 << 20  # of text that is taken apart at a time
WINDOWS = 2_000_000  # phrases a task holds before it sums equal ones
WORDS = 400_000  # and words
MOST_BITS = 27
SALTS = 64
UNKNOWN = "und"  # the language where it is null
NONE = np.uint8(255)

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 blank, 2 between pieces
_KIND[list(b" \t")] = 1
_KIND[list(_SEPARATORS)] = 2
_KINDS = _KIND.tobytes()
_TURN = np.uint64(0xD6E8FEB86659FD93)
_COUNTS = "k int, start int, p long, w long, word binary, lang string, n long"


def phrase_hash(beginning: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its beginning and its last word."""
    return mix(beginning * _TURN + mix(last + _TURN))


def _cut(data: bytes) -> Iterator[bytes]:
    """A long text in parts that end between pieces, of SHARD_BYTES or one piece."""
    while len(data) > SHARD_BYTES:
        at = max(data.rfind(c, 0, SHARD_BYTES) for c in map(bytes, zip(_SEPARATORS)))
        if at < 0:
            at = min((x for c in map(bytes, zip(_SEPARATORS)) if (x := data.find(c)) >= 0), default=len(data))
        yield data[:at]
        data = data[at + 1:]
    yield data


class _Words:
    """All words of some texts in a row: hash (by language), piece, and bytes."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        data = b"\n".join(texts).translate(ASCII_LOWER) + b"\n"
        kind = np.frombuffer(data.translate(_KINDS), np.uint8)
        self.codes, self.inside = np.frombuffer(data, np.uint8), kind == 0
        self.start, self.end = spans(self.inside)
        self.text = part_of(self.start, np.cumsum([len(t) + 1 for t in texts]))
        seed = {x: xxhash.xxh64_intdigest(x) for x in set(langs)}
        seeds = np.array([seed[x] for x in langs], np.uint64)
        self.hash = mix(span_hashes(self.codes, self.start, self.end) ^ seeds[self.text])
        self.piece = part_of(self.start, np.flatnonzero(kind == 2))

    def distinct(self) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Hash, bytes, text and count of every distinct word."""
        order = np.argsort(self.hash)
        found = self.hash[order]
        new = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        first = order[new]
        ends = np.append(0, np.cumsum(self.end - self.start)).astype(np.int32)
        letters = self.codes[self.inside]
        words = pa.Array.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
        return found[new], words.take(pa.array(first)), self.text[first], np.diff(np.append(new, len(found)))


Filters = dict[int, list[tuple[int, BitFilter]]]  # by length: (step, phrases that reached the threshold in it)


def _reached(keys: np.ndarray, filters: list[tuple[int, BitFilter]]) -> np.ndarray:
    """The step after which each phrase had reached the threshold; NONE for those that have not."""
    out = np.full(len(keys), NONE)
    for step, bits in filters:
        open_ = np.flatnonzero(out == NONE)
        out[open_[bits.has(keys[open_])]] = step
    return out


def _phrases(words: _Words, step: int, shards: int, most_words: int, filters: Filters) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Length, start, beginning and last word of the phrases to count in this step."""
    reached, hashes = _reached(words.hash, filters.get(1, [])), words.hash
    same = words.piece[:-1] == words.piece[1:]
    for k in range(2, most_words + 1):
        start = np.maximum(reached[:-1], reached[1:])
        if k == 2:
            start = np.where(same, start, NONE)
        at = np.flatnonzero(start < step)
        if not len(at):
            return
        begin, last, start = hashes[at], words.hash[at + k - 1], start[at]
        now = step <= start.astype(np.int64) + shards
        if now.any():
            yield k, start[now], begin[now], last[now]
        size = len(hashes) - 1
        reached, new = np.full(size, NONE), np.zeros(size, np.uint64)
        new[at] = phrase_hash(begin, last)
        hit = _reached(new[at], filters.get(k, []))
        # A false hit may lie before the step from which the phrase itself is counted.
        reached[at] = np.where(hit == NONE, NONE, np.maximum(hit, start))
        hashes = new


def _summed(k: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    start, begin, last = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(phrase_hash(begin, last))
    start, begin, last = start[order], begin[order], last[order]
    new = np.append(True, (begin[1:] != begin[:-1]) | (last[1:] != last[:-1]))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(begin)))
    return _batch(k, start[first].astype(np.int32), begin[first], last[first], None, None, n)


def _merged(parts: list[tuple]) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """Hash, bytes, language and count of the words of several groups of texts, equal ones summed."""
    found, spelt, lang, n = zip(*parts)
    found, n = np.concatenate(found), np.concatenate(n)
    order = np.argsort(found)
    new = np.flatnonzero(np.append(True, found[order][1:] != found[order][:-1]))
    first = pa.array(order[new])
    return found[order[new]], pa.concat_arrays(spelt).take(first), pa.concat_arrays(lang).take(first), np.add.reduceat(n[order], new)


def _word_batch(found: np.ndarray, spelt: pa.Array, lang: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return _batch(1, np.full(len(n), -1, np.int32), np.zeros(len(n), np.uint64), found, spelt, lang, n)


def _batch(k, start, begin, last, word, lang, n) -> pa.RecordBatch:
    size = len(n)
    return pa.RecordBatch.from_pydict({
        "k": pa.array(np.full(size, k, np.int32)), "start": pa.array(start), "p": pa.array(begin.view(np.int64)),
        "w": pa.array(last.view(np.int64)), "word": pa.nulls(size, pa.binary()) if word is None else word,
        "lang": pa.nulls(size, pa.string()) if lang is None else lang, "n": pa.array(n.astype(np.int64))})


def _scan(texts: DataFrame, step: int, shards: int, most_words: int, filters: Filters) -> DataFrame:
    """Partial counts of one shard."""
    shared = texts.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        words_held: list[tuple] = []
        size = 0
        for batch in batches:
            for piece in slices(batch, "text", SHARD_BYTES):
                data, langs = binary(piece.column("text")).to_pylist(), piece.column("lang").to_pylist()
                parts = [(x, lang) for text, lang in zip(data, langs) for x in _cut(text or b"")]
                at = 0
                while at < len(parts):  # a long text comes in several groups
                    stop, total = at, 0
                    while stop < len(parts) and (stop == at or total + len(parts[stop][0]) <= SHARD_BYTES):
                        total += len(parts[stop][0])
                        stop += 1
                    words = _Words(*map(list, zip(*parts[at:stop])))
                    langs_here = [lang for _, lang in parts[at:stop]]
                    at = stop
                    if not len(words.start):
                        continue
                    if step < shards:
                        found, spelt, text, n = words.distinct()
                        lang = pa.array(langs_here, pa.string()).take(pa.array(text))
                        words_held.append((found, spelt, lang, n))
                        if sum(len(x[0]) for x in words_held) > WORDS:
                            words_held = [_merged(words_held)]
                            if 2 * len(words_held[0][0]) > WORDS:
                                yield _word_batch(*words_held.pop())
                    for k, *found in _phrases(words, step, shards, most_words, shared.value):
                        held.setdefault(k, []).append(tuple(found))
                        size += len(found[0])
                    if size > WINDOWS:
                        yield from (_summed(k, x) for k, x in held.items())
                        held, size = {}, 0
        yield from (_summed(k, x) for k, x in held.items())
        if words_held:
            yield _word_batch(*_merged(words_held))

    return texts.select("text", "lang").mapInArrow(run, _COUNTS)


def _filters(reached: DataFrame) -> dict[int, BitFilter]:
    """By length, the filter of the phrases in ``reached`` (k, p, w)."""
    sizes = {r["k"]: r["count"] for r in reached.groupBy("k").count().collect()}
    bits = {k: min(MOST_BITS, max(10, (16 * n - 1).bit_length())) for k, n in sizes.items()}
    if not bits:
        return {}

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, p, w = (batch.column(c).to_numpy() for c in ("k", "p", "w"))
            for k in np.unique(length).tolist():
                here = length == k
                keys = w[here].view(np.uint64)
                keys = keys if k == 1 else phrase_hash(p[here].view(np.uint64), keys)
                slot = np.unique(np.concatenate(BitFilter.slots(keys, bits[k]))).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(slot), k, np.int32)), "slot": pa.array(slot)})

    found = reached.select("k", "p", "w").mapInArrow(slots, "k int, slot long").groupBy(
        "k", F.floor(F.col("slot") / 64).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    length, at, value = (found[c].to_numpy() for c in ("k", "at", "bits"))
    out = {}
    for k, size in bits.items():
        words = np.zeros(1 << (size - 6), np.int64)
        words[at[length == k]] = value[length == k]
        out[k] = BitFilter(words)
    return out


def _count(shards: DataFrame, number: int, threshold: int, most_words: int) -> tuple[DataFrame, DataFrame]:
    """(k, p, w, word, lang, n) of all words and phrases that reach the threshold, and (lang, n) of all words."""
    keys = ["k", "start", "p", "w", "word", "lang"]
    filters: Filters = {}
    running = totals = None
    step, last = 0, -1
    while step < number or step <= last + number:
        counts = _scan(shards.filter(F.col("shard") == step % number), step, number, most_words, filters).withColumn(
            "reach", F.lit(None).cast("int"))
        # What has had its cycle stays if it reached the threshold, as one of few.
        complete = F.col("start") + number < step
        if running is not None:
            counts = counts.unionByName(running.filter(~complete | F.col("reach").isNotNull()))
        summed = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("reach").alias("reach"))
        reach = F.coalesce("reach", F.when(F.col("n") >= threshold, F.lit(step)))
        before, running = running, materialise(summed.withColumn("reach", reach), "phrase-counts")
        if before is not None:
            release(before)
        new = _filters(running.filter((F.col("reach") == step) & (F.col("k") < most_words)))
        for k, bits in new.items():
            filters.setdefault(k, []).append((step, bits))
        last = step if new else last
        if step == number - 1:
            totals = materialise(running.filter("k = 1").groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
        step += 1
    found = materialise(running.filter(F.col("reach").isNotNull()).select("k", "p", "w", "word", "lang", F.col("n").alias("a")), "phrases-found")
    release(running)
    return found, totals


@F.arrow_udf(LongType())
def _hash_of(p: pa.Array, w: pa.Array) -> pa.Array:
    p, w = (x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (p, w))
    return pa.array(phrase_hash(p, w).view(np.int64))


def _spelt(found: DataFrame, most_words: int) -> DataFrame:
    """(h, k, ws, phrase, lang, a): words and phrases with their words' hashes and their text."""
    words = found.filter("k = 1").select(F.col("w").alias("h"), F.lit(1).alias("k"), F.array("w").alias("ws"),
                                         F.col("word").cast("string").alias("phrase"), "lang", "a")
    levels = [words]
    last = words.select(F.col("h").alias("w"), F.col("phrase").alias("word"))
    for k in range(2, most_words + 1):
        begin = levels[-1].select(F.col("h").alias("p"), "ws", "phrase", "lang")
        here = found.filter(F.col("k") == k).select("p", "w", "a").join(begin, "p").join(last, "w")
        here = here.select(_hash_of("p", "w").alias("h"), F.lit(k).alias("k"), F.concat("ws", F.array("w")).alias("ws"),
                           F.concat_ws(" ", "phrase", "word").alias("phrase"), "lang", "a")
        levels.append(materialise(here, "spelt"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return materialise(every, "spelt")


def _parts(spelt: DataFrame) -> DataFrame:
    """(h, a, cut, first, rest) for each cut of every phrase, and with cut null (rest) for each shorter
    phrase of two words or more inside it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("k").to_numpy()
            for k in np.unique(length).tolist():
                rows = batch.filter(pa.array(length == k))
                words = rows.column("ws").flatten().to_numpy().view(np.uint64).reshape(-1, k)

                def part(a: int, b: int) -> np.ndarray:
                    out = words[:, a].copy()
                    for place in range(a + 1, b):
                        out = phrase_hash(out, words[:, place])
                    return out.view(np.int64)

                for cut in range(1, k):
                    yield pa.RecordBatch.from_pydict({
                        "h": rows.column("h"), "a": rows.column("a"), "cut": pa.array(np.full(len(words), cut, np.int32)),
                        "first": pa.array(part(0, cut)), "rest": pa.array(part(cut, k))})
                for size in range(2, k):
                    for at in range(k - size + 1):
                        yield pa.RecordBatch.from_pydict({
                            "h": rows.column("h"), "a": rows.column("a"), "cut": pa.nulls(len(words), pa.int32()),
                            "first": pa.array(np.zeros(len(words), np.int64)), "rest": pa.array(part(at, at + size))})

    return spelt.filter("k > 1").select("h", "k", "ws", "a").mapInArrow(run, "h long, a long, cut int, first long, rest long")


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = THRESHOLD,
                 most_words: int = MOST_WORDS, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """The best collocations of every language: lang, rank, phrase, a, l, r, n, score.

    A null text counts as empty, a null language as ``und``. Every row counts, repeated ones and those of
    equal or null ids as often as they stand there. Ties of score go to the larger count, then to the
    smaller phrase by bytes; an empty table gives no rows. A long text is taken apart between its pieces,
    so memory is bounded by the longest piece. Other columns are not read.
    """
    source = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                         F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    dealt = source.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    dealt = materialise(dealt, "phrase-shards", by=("shard",))
    found, totals = _count(dealt, shards, threshold, most_words)
    release(dealt)
    spelt = _spelt(found, most_words)
    parts = materialise(_parts(spelt), "phrase-parts")
    size = spelt.select("h", "a")
    inside = parts.filter("cut is null").groupBy(F.col("rest").alias("h")).agg(F.max("a").alias("longer"))
    kept = spelt.filter("k > 1").join(inside, "h", "left").filter("longer is null or 100 * longer < 100 * a")
    # A language may have most of the phrases, so the few totals are copied to SALTS places.
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = kept.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    kept = kept.select("h", "lang", "salt", "phrase", "a", "n")
    cuts = parts.filter("cut is not null").select("h", "cut", "first", "rest")
    cuts = cuts.join(size.select(F.col("h").alias("first"), F.col("a").alias("l")), "first").join(
        size.select(F.col("h").alias("rest"), F.col("a").alias("r")), "rest")
    scored = kept.join(cuts, "h").withColumn(
        "score", F.expr("(cast(1000 * cast(a as decimal(18,0)) as decimal(20,0)) * cast(n as decimal(18,0))) div "
                        "(cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = scored.groupBy("h", "lang", "salt", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    best = best.select("lang", "salt", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of every salt hold the first of the language.
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
with texts as (
  select coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (
  select lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from texts),
totals as (select lang, sum(len(w)) as n from pieces group by lang),
grams as (
  select lang, k, w[i:i + k - 1] as g
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i
        from pieces cross join (select unnest(range(1, {MOST_WORDS + 1})) as k) where len(w) >= k)),
f as (select lang, k, g, count(*) as a from grams group by lang, k, g having count(*) >= {THRESHOLD}),
inside as (
  select lang, g[i:j] as g, max(a) as longer
  from (select lang, k, g, a, i, unnest(range(i + 1, k + 1)) as j
        from (select *, unnest(range(1, k)) as i from f where k > 2)) where j - i + 1 < k group by all),
c as (select f.* from f left join inside x on f.lang = x.lang and f.g = x.g where f.k > 1 and (longer is null or 100 * longer < 100 * a)),
cuts as (select *, unnest(range(1, k)) as cut from c),
scored as (
  select c.lang, c.g, c.a, cut, x.a as l, y.a as r, n::bigint as n,
         ((1000::hugeint * c.a * n) // (x.a::hugeint * y.a))::bigint as score
  from cuts c join f x on x.lang = c.lang and x.g = c.g[1:cut] join f y on y.lang = c.lang and y.g = c.g[cut + 1:]
  join totals t on t.lang = c.lang),
best as (
  select lang, array_to_string(g, ' ') as phrase, a, l, r, n, score
  from scored qualify row_number() over (partition by lang, g order by score, cut) = 1)
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best) where rank <= {TOP}
"""

"""Whitening, toxicity and phrases against plain versions."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.llm import collocations, toxicity, whitening
from flowsentry.llm.common import table
from flowsentry.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, n string, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, "clash", 7) for k, v in rows], VECTORS)


def plain_whitening(rows, components=32):
    x = np.floor(np.array(rows, np.float64) * 64) + 1_000_000
    centred = x - x.mean(axis=0)
    values, directions = np.linalg.eigh(centred.T @ centred / len(x))
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    return centred @ directions / np.sqrt(values), values / np.trace(centred.T @ centred / len(x))


def test_whitening_equals_dense_eigenvectors(spark, sf_dir):
    out = QUERIES["op11_whitening"](spark, sf_dir).toPandas()
    rows = table(spark, sf_dir, "embeddings").toPandas().sort_values("vec_id")
    want, explained = plain_whitening(rows.embedding.tolist())
    got = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-7
    assert np.allclose(out[out.vec_id == out.vec_id.min()].sort_values("component").explained, explained, rtol=1e-9)
    assert (out.n == len(rows)).all() and out.identity_error.max() < 1e-9
    x = [[int(np.floor(float(c) * 64)) + 1_000_000 for c in v] for v in rows.embedding]
    sums = [sum(c) for c in zip(*x)]
    exact = {k: sum((len(x) * a - s) ** 2 for a, s in zip(v, sums)) for k, v in zip(rows.vec_id, x)}
    assert dict(zip(out.vec_id, out.deviation)) == exact


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [3, 3, 3, 3, 3], [2, 2, 2, 1, 1], [1, 1e-3, 1e-6, 1e-7, 0]])
def test_solver_on_equal_and_tiny_values(values):
    rng = np.random.default_rng(3)
    left, _ = np.linalg.qr(rng.standard_normal((40, 5)))
    right, _ = np.linalg.qr(rng.standard_normal((5, 5)))
    rows = left @ np.diag(values) @ right
    found, directions = whitening.principal(np.linalg.qr(rows, mode="r"), 32)
    assert len(found) == np.count_nonzero(values)
    assert np.allclose(found, [v for v in values if v], rtol=1e-8)
    assert np.abs(directions.T @ directions - np.eye(len(found))).max() < 1e-7
    assert np.abs(rows.T @ (rows @ directions) - directions * found ** 2).max() < 1e-7


def test_singular_values_are_accurate_however_small():
    rng = np.random.default_rng(5)
    diagonal, above = 10.0 ** -np.arange(12), 10.0 ** -np.arange(11) * rng.random(11)
    exact = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1), compute_uv=False)
    assert np.allclose(whitening.dqds(diagonal, above)[:6], exact[:6], rtol=1e-12)
    assert np.isclose(np.prod(whitening.dqds(diagonal, above)), np.prod(diagonal), rtol=1e-10)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(k, [float(x) for x in rng.standard_normal(3)] + [0.5]) for k in range(20)]
    rows = [*good, good[0], (None, good[1][1]), (90, None), (91, []), (92, [1.0, None, 2.0, 3.0]),
            (93, [1.0, float("nan"), 0.0, 0.0]), (94, [float("inf"), 0.0, 0.0, 0.0])]
    df = vectors(spark, rows)
    model = whitening.fit_whitening(df)
    out = whitening.whitened_components(df, model).toPandas()
    assert len(out) == 22 * 3 and out.n.eq(22).all()  # the constant entry has no component
    assert set(out.vec_id.dropna()) == set(range(20)) and out.identity_error.max() < 1e-10
    wide = whitening.whiten(df, model).collect()
    assert [r.vec_id for r in wide if r.whitened is None] == [90, 91, 92, 93, 94]
    assert len(wide) == len(rows) and wide[0].n == "clash"
    for few in (df.limit(0), vectors(spark, [(1, [1.0, 2.0])] * 5), vectors(spark, [(1, None)])):
        assert whitening.whitened_components(few, whitening.fit_whitening(few)).count() == 0
    with pytest.raises(Exception, match="same length"):
        whitening.fit_whitening(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def plain_phrases(rows, threshold, most=5, top=2000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most + 1):
                counts.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    often = {key: n for key, n in counts.items() if n >= threshold}
    inside = collections.Counter()
    for (lang, g), a in often.items():
        for i in range(len(g)):
            for j in range(i + 2, len(g) + 1):
                if j - i < len(g):
                    inside[lang, g[i:j]] = max(inside[lang, g[i:j]], a)
    out = collections.defaultdict(list)
    for (lang, g), a in often.items():
        if len(g) > 1 and inside[lang, g] < a:
            score, k, left, right = min(
                (1000 * a * totals[lang] // (often[lang, g[:k]] * often[lang, g[k:]]), k, often[lang, g[:k]], often[lang, g[k:]])
                for k in range(1, len(g)))
            out[lang].append((-score, -a, " ".join(g).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, totals[lang], -s)
                  for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("shards", [1, 3, 4])
def test_phrases_equal_plain_counts(spark, shards):
    rng = random.Random(shards)
    words = ["a", "b", "New", "york", "été", "c|d", "x'y", "long" * 30]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", "\t", ":"]) for _ in range(rng.randrange(40))),
             rng.choice(["en", "en", "de", None, "und"])) for _ in range(150)]
    rows += [("the same passage of words again", "en")] * 60 + [(None, "en"), ("", None), (" \t\n.", "de")]
    docs = spark.createDataFrame([(t, x, 1, 2) for t, x in rows], "text string, lang string, n int, score int").repartition(5)
    got = collocations.mine_phrases(docs, threshold=9, shards=shards, top=40).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == plain_phrases(rows, 9, top=40)


def test_phrases_are_exact_when_filters_are_full(spark, monkeypatch):
    """Rare passages start late; false hits of their parts must not make the count begin earlier."""
    monkeypatch.setattr(collocations, "MOST_BITS", 10)
    rng = random.Random(5)
    rows = [(" ".join(f"w{rng.randrange(25)}" for _ in range(60)), "en") for _ in range(400)]
    rows += [(" ".join(f"p{i}x{j}" for j in range(5)), "en") for i in range(40) for _ in range(12)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = collocations.mine_phrases(docs, threshold=10).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == plain_phrases(rows, 10)


def test_phrases_of_long_and_odd_texts(spark, odd_docs, no_docs, monkeypatch):
    rows = [(r.text, r.lang) for r in odd_docs.select("text", "lang").collect()]
    got = collocations.mine_phrases(odd_docs, threshold=2).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == plain_phrases(rows, 2)
    assert collocations.mine_phrases(no_docs).count() == 0
    text = "one two. " * 4000
    parts = list(collocations._cut((text * 40).encode()))
    assert len(parts) > 1 and b".".join(parts) == (text * 40).encode()
    assert list(collocations._cut(b"x" * (3 << 20))) == [b"x" * (3 << 20), b""]


def toxic_docs(spark, n=1500):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(n):
        toxic = k % 4 == 0
        sentences = [[rng.choice(words) for _ in range(8)] for _ in range(6)]
        if toxic:
            sentences[k % 6][3] = rng.choice(["idiot", "moronic"])
        rows.append((k, ". ".join(" ".join(s) for s in sentences) + ".", int(toxic), k % 6))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return docs, labels, rows


def test_toxic_documents_and_sentences_are_found(spark):
    docs, labels, rows = toxic_docs(spark)
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in out)
    unseen = [r for r in rows if out[r[0]].held_out]
    assert sum(out[k].predicted == y for k, _, y, _ in unseen) >= 0.97 * len(unseen)
    # The worst sentence is the one with the word, though no sentence had a label.
    for k, text, y, place in unseen:
        if y:
            spot = text[out[k].worst_start:out[k].worst_end]
            assert "idiot" in spot or "moronic" in spot
            assert text.split(".")[place].strip() == spot
    found = toxicity.offending_sentences(docs, model).collect()
    assert {r.doc_id for r in found} >= {k for k, _, y, _ in rows if y and out[k].predicted}
    assert all(rows[r.doc_id][1][r.start:r.end] == r.sentence for r in found)


def test_gradient_agrees_with_differences(spark):
    """The fit's slope of the noisy-or log-likelihood, against differences in its value."""
    rng = np.random.default_rng(0)
    odds, text, y = rng.standard_normal(7), np.array([0, 0, 1, 2, 2, 2, 1]), np.array([1, 0, 1])

    def value(z):
        none = toxicity.noisy_or(z, text, 3)
        return np.where(y == 1, np.log(-np.expm1(none)), none).sum()

    none = toxicity.noisy_or(odds, text, 3)
    slope = np.where(y == 1, np.exp(-toxicity._log_odds(none)), -1.0)[text] / (1 + np.exp(-odds))
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        assert np.isclose(slope[k], (value(odds + step) - value(odds - step)) / 2e-6, atol=1e-6)


def test_toxicity_of_odd_texts(spark, odd_docs, no_docs):
    docs, labels, _ = toxic_docs(spark, 200)
    model = toxicity.train(docs, labels)
    rows = toxicity.score_documents(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all((r.n_sentences == 0) == (r.worst_start is None) for r in rows)
    assert {r.doc_id for r in rows if r.n_sentences == 0} == {1, 2, 3}
    assert toxicity.score_documents(no_docs, model).count() == 0
    odd = labels.limit(0).union(spark.createDataFrame([(7, None), (8, 1), (8, 0), (None, 1), (9, 5)], "doc_id long, toxic int"))
    for few in (labels.limit(0), odd, labels.filter("toxic = 0")):
        nothing = toxicity.train(odd_docs.withColumn("toxic", F.lit("clash")), few)
        assert {r.score for r in toxicity.score_documents(odd_docs, nothing).collect()} == {0.0}
        assert toxicity.offending_sentences(odd_docs, nothing).count() == 0
    assert toxicity.train(no_docs, labels).share == 0.0

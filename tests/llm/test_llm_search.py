import random

import numpy as np
from brute import base_spans, components, contaminated
from pyspark.sql import functions as F

from flowsentry.llm import decontaminate, jaccard_join, pii
from flowsentry.llm.common import table
from flowsentry.llm.shingles import shingle_sets

COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def found(docs, bench, **more):
    return sorted((tuple(r) for r in decontaminate.hits(docs, bench, **more).select(*COLUMNS).collect()), key=str)


def pairs(docs, text="text"):
    return [(r.doc_id, r[text]) for r in docs.select("doc_id", text).collect()]


def test_hits_equal_brute_force(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = contaminated(pairs(docs), [tuple(r) for r in bench.collect()])
    assert found(docs, bench) == want
    assert any(r[-1] for r in want)


def test_hits_in_odd_texts_and_random_words(spark, odd_docs, no_docs, monkeypatch):
    rng = random.Random(3)
    bench = [(1, None), (2, "!!"), (3, "one"), (3, "One two"), (4, "a b c d e f g h"), (5, "w0x0 w1x1 w2x2 w3x3"), (None, "under the same")]
    bench += [(10 + k, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 25)))) for k in range(12)]
    bench += [bench[-1]]
    frame = spark.createDataFrame(bench, "item_id int, text string")
    texts = [(100 + k, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 80)))) for k in range(60)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = [("" if i is None else i, t) for i, t in bench]
    want = contaminated(pairs(docs), rows)
    assert found(docs, frame) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)  # many blocks of the query set
    assert found(docs, frame) == want
    assert found(no_docs, frame) == []
    clean = decontaminate.remove_contaminated(odd_docs, frame)
    assert clean.columns == odd_docs.columns
    dirty = sorted(str(r[0]) for r in contaminated(pairs(odd_docs), rows) if r[-1])
    assert sorted(str(r.doc_id) for r in clean.collect()) + dirty  # none is lost, none doubled
    assert clean.count() + len(dirty) == odd_docs.count()
    assert not any(r[-1] for r in found(docs, frame.limit(0)))


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "a b c d e z"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "q a b c d e"), (8, "none")], "item_id long, text string")
    rows = {r.item_start: (r.length, r.doc_id, r.doc_start) for r in decontaminate.longest_matches(docs, bench).collect()}
    assert rows == {1: (5, 2, 0), 2: (4, 2, 1), 3: (3, 2, 2), 4: (2, 2, 3), 5: (1, 2, 4)}


def test_suffix_array_sorts_all_suffixes():
    codes = np.array([2, 1, 2, 1, 0, 2, 1, 3, 0, 1, 1, 1], np.int64)
    order = decontaminate.suffix_array(codes, len(codes) + 1)
    assert order.tolist() == sorted(range(len(codes)), key=lambda k: codes[k:].tolist())


def test_shingle_sets_follow_words(odd_docs):
    texts = ["a b c d e f", " A\tb\nc d e f ", "a b c d e", "a b c", None, "", "b c d e f", "x" * 100_000]
    sets = [set(s.tolist()) for s in shingle_sets([t and t.encode() for t in texts])]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and sets[2] | sets[6] == sets[0]
    assert len(sets[3]) == 1 and sets[4] == sets[5] == set() and len(sets[7]) == 1


def joined(docs):
    return sorted(tuple(r) for r in jaccard_join.similar_documents(docs).collect())


def test_components_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = components(pairs(docs))
    assert joined(docs) == want
    assert any(r[0] != r[2] for r in want)


def test_components_of_families_around_the_threshold(spark, monkeypatch):
    rng = random.Random(11)
    shared = [f"s{k}" for k in range(60)]  # a passage in every text
    rows = []
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(60)] + shared
        for member in range(25):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(rows)
    assert joined(docs) == want
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)  # all pairs between components at once
    assert joined(docs) == want
    monkeypatch.setattr(jaccard_join, "MOST_HOT", 0)  # no token goes behind
    assert joined(docs) == want


def test_components_of_odd_texts(odd_docs, no_docs):
    docs = odd_docs.filter("doc_id is not null")
    rows = joined(docs)
    assert rows == components(pairs(docs))
    assert joined(no_docs) == []
    kept = jaccard_join.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id or -1, r.text or "") for r in kept.collect())
    assert [i for i, _ in ids] == [-1, 1, 2, 3, 4, 5, 5, 7, 8, 10, 11]


def test_connected_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    rows = jaccard_join.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in rows} == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert len(rows) == 71


ODD = [
    "a@b.c_d@e.f x@y@z.w @a.b a@b. a@b.c..d", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3 9.9.9.9999",
    "4111-1111 1111 1111 4111111111111112 5500 0000 0000 0004 " + "4" * 40, "+1 2 +49 (30) 1234-5678. +123456789012345678 +1",
    "IBAN GB82 WEST 1234 5698 7654 32; account DE89370400440532013000", "my ssn 123-45-6789, 123-45-6789 alone 12-34-56",
    "é😀 joe@example.com 😀 10.0.0.1", "+" * 500 + "1" * 500, "1 " * 400, "a." * 3000 + "@", None, "",
]


def test_base_spans_equal_plain_matching(spark, sf_dir, odd_docs, no_docs):
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for docs in (odd, odd_docs, table(spark, sf_dir, "documents")):
        got = pii.find_personal_data(docs).select("doc_id", F.expr(
            "transform(filter(spans, s -> s.kind in ('email', 'ip', 'card', 'phone')), s -> concat_ws(':', s.kind, s.start, s.end))").alias("s"))
        want = [(i, base_spans(t)) for i, t in pairs(docs)]
        assert sorted(((r.doc_id, r.s) for r in got.collect()), key=str) == sorted(want, key=str)
    assert pii.digest(pii.find_personal_data(no_docs)).count() == 0


def test_checksums_and_context_decide(spark):
    docs = spark.createDataFrame([(0, ODD[4]), (1, ODD[5]), (2, "GB83 WEST 1234 5698 7654 32")], "doc_id long, text string")
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_personal_data(docs).collect()}
    assert spans[0] == [("iban", 5, 32), ("iban", 42, 64)]
    assert spans[1][0] == ("ssn", 7, 18) and spans[2] == []


def test_secrets_are_what_a_key_word_assigns(spark):
    value = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'x token = "{value}" y', f"API_KEY:{value}", f"my secret='{value}'###", f"password {value}", f"{value}",
             "token = thisisawordandnosecretatall", 'token = "short1"', f"é😀 Access-Key = {value}/+-_. {value}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.kind, r.text[s.start:s.end]) for s in r.spans]
             for r in pii.find_personal_data(docs).join(docs, "doc_id").collect()}
    for k in (0, 1, 2):
        assert found[k] == [("secret", value)], texts[k]
    assert found[7] == [("secret", value + "/+-_")] and not any(found[k] for k in (3, 4, 5, 6))


def test_very_many_matches_in_one_text(spark):
    text = " ".join(f"u{k}@mail.example.org {k % 250}.1.2.3" for k in range(30_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = pii.find_personal_data(docs).collect()
    assert [f"{s.kind}:{s.start}:{s.end}" for s in row.spans] == base_spans(text)


def test_accounts_end_where_their_number_does(spark):
    spaced, plain = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"
    texts = [f"{a}{x}{b}" for x in (spaced, plain) for a in ("", "pay ", "IBAN", "NO20 ", "é ")
             for b in (" Please", " BIC", " 100", " DEUTDEFF", " EUR 100 AND MORE TO COME UNTIL THE END", ";", "")]
    rows = list(enumerate(texts)) + [(1000, f"{spaced} {plain} {spaced}"), (1001, "GB83 WEST 1234 5698 7654 32 Please")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [r.text[s.start:s.end] for s in r.spans if s.kind == "iban"]
             for r in pii.find_personal_data(docs).join(docs, "doc_id").collect()}
    for k, text in enumerate(texts):
        assert found[k] == [spaced if spaced in text else plain], text
    assert found[1000] == [spaced, plain, spaced] and found[1001] == []


def test_masking_keeps_the_other_columns(odd_docs):
    rows = {r.doc_id: r.text for r in pii.mask_personal_data(odd_docs).collect()}
    assert rows[7] == "mail me: [email], [phone] or [card] at [ip]" and rows[1] is None

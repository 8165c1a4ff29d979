import json
import math
import zlib

import numpy as np
import pytest
from brute import measures
from oracle import connect, differences
from pyspark.sql import functions as F

from flowsentry.llm import cotraining, language_id, line_templates, quality_rules, queries, tool_calls
from flowsentry.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert differences(got, connect(sf_dir).sql(queries.ORACLES[name]).df()) == ""


def test_language_is_found_in_held_out_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.train_filter(docs.filter(~language_id.held_out()), "text", "lang")
    rows = language_id.identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark, odd_docs, no_docs):
    model = language_id.train_filter(odd_docs.filter("doc_id != 10"), "text", "lang")
    assert model.languages == ["en"]
    rows = language_id.identify_languages(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 3)} == dict.fromkeys((1, 2, 3), ("und", 0.0))
    assert language_id.identify_languages(no_docs, model).count() == 0
    none = language_id.train_filter(no_docs, "text", "lang")
    assert {r.lang_pred for r in language_id.identify_languages(odd_docs, none).collect()} == {"und"}


def test_filter_returns_all_languages_of_an_ngram(spark):
    rows = [(f"l{k:03d}", f"shared own{chr(97 + k % 26)}{chr(97 + k // 26)}zq " * 9) for k in range(70)]
    model = language_id.train_filter(spark.createDataFrame(rows, "lang string, text string"), "text", "lang")
    assert len(model.languages) == 70 and model.masks.shape[0] == 2
    counts, _ = model.counts([rows[66][1], "shared"])
    assert counts[0].argmax() == 66
    assert (counts[1] > 0).all()


def test_filter_grows_with_the_ngrams(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    monkeypatch.setattr(language_id, "SLOT_BITS", 8)  # as full as a large table makes 2 ** 20 slots
    model = language_id.train_filter(docs, "text", "lang")
    assert model.masks.shape[1] > 1 << 12 and (0 < model.false_rate).all() and (model.false_rate <= 0.06).all()
    rows = language_id.identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    monkeypatch.setattr(language_id, "MOST_BITS", 12)  # frequent n-grams only
    model = language_id.train_filter(docs, "text", "lang")
    assert model.masks.shape[1] <= 1 << 12 and (model.false_rate <= 0.06).all()
    monkeypatch.undo()
    assert language_id.filter_size([5_000_000, 1_000_000], 1) == (23, 6)


def test_measures_equal_brute_force(spark, sf_dir, odd_docs):
    for docs in (table(spark, sf_dir, "documents"), odd_docs):
        labels = table(spark, sf_dir, "labels")
        got = quality_rules.judge_documents(docs, labels).collect()
        assert len(got) == docs.count()
        columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        want = [(r.doc_id, *measures(r.text)) for r in docs.collect()]
        assert sorted(((r.doc_id, *(r[c] for c in columns)) for r in got), key=str) == sorted(want, key=str)
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_bound_is_exact():
    # Of n cases none rejected: 1 - risk ** (1 / n).
    assert quality_rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** 0.01, rel=1e-6)
    assert quality_rules.upper_bound(5, 50, 0.05) == pytest.approx(0.1987, abs=1e-3)
    assert quality_rules.upper_bound(3, 3, 0.05) == quality_rules.upper_bound(0, 0, 0.05) == 1.0


def test_cutoffs_hold_the_allowed_rate_per_stratum(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 60)) + " #" * int(s), "en" if k % 2 else "de")
            for k, s in enumerate(rng.integers(0, 3, 6000))]
    rows += [(10_000 + k, " ".join(f"w{x}#####" for x in rng.integers(0, 10**9, 60)), "en") for k in range(40)]
    rows += [(20_000, rows[-1][1], "fr")]  # a stratum without labels keeps what the base rules keep
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    labels = labels.unionByName(spark.createDataFrame([(0, 0), (1, None)], "doc_id long, quality int"))
    settings = quality_rules.Settings(allowed=0.05)
    found = {r.doc_id: r.kept for r in quality_rules.judge_documents(docs, labels, settings=settings).collect()}
    assert sum(not found[k] for k in range(6000)) <= 300
    assert not any(found[10_000 + k] for k in range(40)) and found[20_000]


def test_rules_without_labels_or_documents(spark, sf_dir, odd_docs, no_docs):
    labels = table(spark, sf_dir, "labels")
    rows = quality_rules.judge_documents(odd_docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in rows)
    assert quality_rules.judge_documents(no_docs, labels).count() == 0


def test_classifier_agrees_with_labels(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = cotraining.train(docs, labels)
    rows = cotraining.score_documents(docs, model).join(labels, "doc_id").collect()
    bad, good = [r for r in rows if not r.quality], [r for r in rows if r.quality]
    if model is not None and len(bad) > 20:
        assert sum(r.rejected for r in bad) >= 0.7 * len(bad)
    assert sum(r.rejected for r in good) <= 0.05 * len(good)


def test_co_training_learns_from_the_other_view():
    rng = np.random.default_rng(4)
    y = (rng.random(3000) < 0.5).astype(int)
    a = np.stack([y + rng.normal(0, 0.25, 3000), rng.normal(0, 1, 3000)], axis=1).astype(np.float32)
    b = np.stack([2 * y + rng.normal(0, 0.3, 3000), rng.normal(0, 1, 3000)], axis=1).astype(np.float32)
    model = cotraining.co_train(a[:60], b[:60], y[:60], a[60:1500], b[60:1500])
    _, _, score = model.score(a[1500:], b[1500:])
    assert ((score > 0.5) == (y[1500:] == 1)).mean() > 0.97
    assert cotraining.co_train(a[:60], b[:60], np.ones(60, int), a[60:], b[60:]) is None


def test_pseudo_labels_come_from_all_unlabelled_documents(spark, monkeypatch):
    good, bad = "the calm river runs by old stone mills ", "zzxq $$ qqxz ## "
    rows = [(k, (good if k % 2 else bad) * (3 + k % 5) + f"n{k}") for k in range(6000)]
    rows += [(1, rows[1][1])] * 50 + [(5001, rows[5001][1])] * 50 + [(None, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    seen, taken, plain = [], [], cotraining._co_train
    monkeypatch.setattr(cotraining, "EXCHANGED", 5_000)
    monkeypatch.setattr(cotraining, "ROUNDS", 1)

    def spied(rows, y, exchange):
        seen.append(len(y))

        def counted(models):
            new = exchange(models)
            taken.append(max(len(label) for _, label in new))
            return new

        return plain(rows, y, counted)

    monkeypatch.setattr(cotraining, "_co_train", spied)
    assert cotraining.train(docs, labels) is not None
    assert cotraining.LABELLED == 8_000 and seen == [200]  # a repeated id is one row
    assert taken == [5800]  # every other document once


def test_classifier_on_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents")
    model = cotraining.train(docs, labels)
    for frame in (odd_docs, no_docs, odd_docs.select("doc_id", "text")):
        rows = cotraining.score_documents(frame, model)
        assert rows.count() == frame.count()
        kept = cotraining.keep_good(frame, model)
        assert kept.columns == frame.columns and kept.count() == rows.filter("not rejected").count()
    assert cotraining.train(docs, labels.limit(0)) is None
    assert cotraining.train(no_docs, labels) is None
    assert cotraining.keep_good(odd_docs, None).count() == odd_docs.count()


def template_docs(spark):
    own = "every text has a line {} that no other has at all"
    rows = [(k, "\n".join([own.format("abcdefghij"[k]), f"user {k} logged in from host {k * 7}", "short one", f"tail of {k}"])) for k in range(8)]
    rows += [(20, None), (21, ""), (22, "the quick red fox jumps over lazy dogs today"), (22, "the quick red fox jumps over lazy dogs today")]
    rows += [(30 + k, "the quick red fox jumps over lazy " + w) for k, w in enumerate(("cats today", "dogs again"))]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("places", F.lit("clash"))


def test_recurring_templates_stay_in_the_first_document(spark):
    docs = template_docs(spark)
    got = line_templates.drop_recurring_lines(docs, count_as="dropped", least_docs=5)
    rows = {r.doc_id: (r.text, r.dropped) for r in got.collect()}
    assert got.columns == ["doc_id", "text", "places", "dropped"] and got.count() == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k in range(8):
        lines = texts[k].split("\n")
        # The own lines differ in one token of eleven, so they share a template as well.
        want = lines if k == 0 else lines[2:]
        assert rows[k] == ("\n".join(want), len(lines) - len(want))
    assert rows[20] == (None, 0) and rows[21] == ("", 0) and rows[22] == (texts[22], 0)  # three documents only
    three = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs, least_docs=3).collect()}
    assert three[22] == texts[22] and three[30] == "" and three[31] == ""


def test_long_lines_recur_from_two_documents_and_short_ones_from_more(spark):
    def line(n, head):
        return " ".join([head, *(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n - 1))])

    rows = [(1, "first of all\n" + line(50, "long")), (2, line(50, "long") + "\nlast"), (3, line(49, "mid")), (4, line(49, "mid"))]
    rows += [(100 + k, f"Read more\nat {k}") for k in range(20)] + [(200 + k, "Of 19") for k in range(19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs, least_docs=5).collect()}
    want = dict(rows) | {2: "last"} | {100 + k: f"at {k}" for k in range(1, 20)}
    assert got == want


def test_a_leaf_holds_several_templates(spark, monkeypatch):
    names = [f"{a}{b}" for a in "abcdefghij" for b in "xy"]
    heads = [f"we have seen here {w} in {w}1 town {w}x and {w}y there {{}}" for w in ("apples", "pears", "plums", "figs")]
    rows = [(100 * k + j, head.format(name)) for k, head in enumerate(heads) for j, name in enumerate(names[k:k + 9])]
    rows += [(900 + k, f"we have seen here {n} {n}a {n}b {n}c {n}d {n}e {n}f {n}g") for k, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: t if i % 100 == 0 or i >= 900 else "" for i, t in rows}
    for most in (line_templates.HEADS, 3):  # 3: in rounds, and dealt out in groups
        monkeypatch.setattr(line_templates, "HEADS", most)
        monkeypatch.setattr(line_templates, "CHUNK", 20 if most == 3 else 20_000)
        got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs, least_docs=5).collect()}
        assert got == want


def test_line_templates_on_odd_and_empty_tables(odd_docs, no_docs):
    got = line_templates.drop_recurring_lines(odd_docs)
    assert got.columns == odd_docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, odd_docs.collect()))
    assert line_templates.drop_recurring_lines(no_docs).count() == 0


def test_tool_calls_are_linked_ordered_and_checked(spark):
    schema = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "enum": [1, 2]}}}}
    calls = spark.createDataFrame([
        (1, 5, "c", "f", '{"x":1}', ["b", "zz"]), (1, 1, "b", "f", '{"x":2}', ["a"]), (1, 9, "a", "f", '{"x": 1}', []),
        (1, 2, "d", "f", '{"x":3}', []), (1, 3, "e", "g", "{}", []), (1, 4, "h", "f", "no json", []),
        (1, 6, "p", "f", '{"x":1}', ["q"]), (1, 7, "q", "f", '{"x":1}', ["p"]), (1, 8, None, "f", None, None),
        (2, 1, "a", "f", '{"x":1}', None), (2, 2, "a", "f", '{"x":1}', None), (2, 2, "a", "f", '{"x":1}', None),
    ], "conv_id long, turn long, call_id string, name string, arguments string, uses array<string>")
    results = spark.createDataFrame([
        (1, 2, "b", "ré"), (1, 3, "b", "again"), (1, 9, "zz", "lost"), (2, 3, "a", None), (2, 4, None, "x"), (1, 1, "p", "1"),
    ], "conv_id long, turn long, call_id string, content string")
    rows = tool_calls.link_calls(calls, results, schema).collect()
    assert len(rows) == 18
    state = {}
    for r in rows:
        state.setdefault((r.conv_id, r.call_id, r.kind), []).append((r.status, r.level))
    assert state[1, "a", "call"] == [("unanswered", 0)] and state[1, "b", "call"] == [("linked", 1)]
    assert state[1, "c", "call"] == [("unanswered", 2)]
    assert {state[1, x, "call"][0][0] for x in "deh"} == {"invalid"}
    assert state[1, "p", "call"] == state[1, "q", "call"] == [("cycle", None)]
    assert sorted(state[2, "a", "call"]) == [("duplicate", 0), ("duplicate", 0), ("linked", 0)]
    assert sorted(state[1, "b", "result"]) == [("duplicate", 1), ("linked", 1)]
    assert state[1, "zz", "result"] == [("orphan", None)] and state[2, None, "result"] == [("orphan", None)]
    assert state[1, None, "call"] == [("no_id", None)]
    for r in rows:
        assert tool_calls.canonical(json.loads(r.message)) == r.message
    assert any('"content":"ré"' in r.message for r in rows)


def test_tool_calls_of_an_empty_table(spark, sf_dir):
    calls, results = tool_calls.calls_of_conversations(table(spark, sf_dir, "conversations").limit(0))
    assert tool_calls.link_calls(calls, results, tool_calls.SCHEMAS).count() == 0


def test_levels_are_longest_paths(spark):
    rng = np.random.default_rng(4)
    uses = {(c, k): {int(x) for x in rng.integers(0, max(1, k), rng.integers(0, 4)) if x < k}
            for c in range(4) for k in range(12 * c + 1)}
    uses |= {(9, k): {k - 1} for k in range(1, 70)} | {(9, 0): set()}
    uses |= {(8, 0): {2}, (8, 1): {0}, (8, 2): {1}, (8, 3): {3}, (8, 4): {1, 5}, (8, 5): set(), (8, 6): {5, 7, 99}, (8, 7): {5}}

    def level(c, k, above=()):
        if k in above:
            return None
        found = [level(c, x, (*above, k)) for x in uses[c, k] if (c, x) in uses]
        return None if None in found else max(found, default=-1) + 1

    calls = spark.createDataFrame([(c, str(k)) for c, k in uses], "conv_id long, call_id string")
    edges = spark.createDataFrame([(c, str(k), str(x)) for (c, k), found in uses.items() for x in found] * 2,
                                  "conv_id long, call_id string, used string")
    got = {(r.conv_id, int(r.call_id)): r.level for r in tool_calls._levels(calls, edges).collect()}
    assert got == {(c, k): found for c, k in uses if (found := level(c, k)) is not None}


def test_long_conversation(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", f"turn {k}") for k in range(300)] + [(2, 0, "user", None), (2, 5, "user", "x")]
    rows += [(None, 1, "user", "x"), (3, None, "user", "x"), (1, 298, "user", "again"), (4, 0, "assistant", "x")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    calls, results = tool_calls.calls_of_conversations(talk.withColumn("name", F.lit("clash")))
    used = {(r.conv_id, r.turn): r.uses for r in calls.collect()}
    assert used[1, 4] == ["t2"] and used[1, 2] == ["t1"] and used[1, 1] == [] and used[2, 5] == ["t0"] and used[3, None] == []
    linked = tool_calls.link_calls(calls, results, tool_calls.SCHEMAS)
    assert len(linked._jdf.queryExecution().toString()) < 400_000
    level = {(r.conv_id, r.turn): r.level for r in linked.filter("kind = 'call' and status != 'duplicate'").collect()}
    assert [level[1, k] for k in range(300) if k % 3] == list(range(200))
    assert level[2, 5] == 1 and level[3, None] is None


def test_binomial_chances_are_exact():
    for n in (1, 7, 40, 300):
        for rate in (0.002, 0.1, 0.5, 0.93):
            for k in range(0, n, max(1, n // 7)):
                exact = sum(math.comb(n, j) * rate ** j * (1 - rate) ** (n - j) for j in range(k + 1))
                assert quality_rules.chance_of_at_most(k, n, rate) == pytest.approx(exact, rel=1e-9, abs=1e-14)
    for n, risk in ((50, 0.05), (4000, 1e-5), (2_000_000, 1e-6)):
        for k in (0, 1, n // 1000, n // 600, n // 400):
            assert quality_rules.within(k, n, 0.002, risk) == (quality_rules.upper_bound(k, n, risk) <= 0.002)


def test_verdict_of_the_rules_equals_plain_search(spark):
    """Cutoffs and kept, against a search over all cutoffs with exact bounds."""
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(["word%d" % x for x in rng.integers(0, 400, 70)] + ["#"] * int(rng.integers(0, 4)) * (k % 50 == 0)),
             "en" if k % 3 else "de") for k in range(1500)]
    rows += [(2000 + k, rows[k][1] + " #" * 60, "en") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k < 1500)) for k, _, _ in rows], "doc_id long, quality int")
    settings = quality_rules.Settings(grid=10, allowed=0.1, risk=0.2)
    out = {r.doc_id: r for r in quality_rules.judge_documents(docs, labels, settings=settings).collect()}

    def shares(r):
        n = max(1, r.n_words)
        lines = 1
        length = r.word_chars / n
        return [min(1.0, r.n_symbols / n), r.n_dup_lines / lines, r.n_repeat_words / n, max(0.0, 1 - length / 8), min(1.0, length / 40)]

    strata, cutoffs = {x for _, _, x in rows}, {}
    for stratum in strata:
        good = [shares(out[k]) for k, _, x in rows if k < 1500 and x == stratum and not out[k].base_failed]
        for rule in range(5):
            for cell in range(10):
                k = sum(math.ceil(v[rule] * 10) > cell for v in good)
                tail = sum(math.comb(len(good), j) * 0.02 ** j * 0.98 ** (len(good) - j) for j in range(k + 1))
                if k <= 0.02 * len(good) and tail <= 0.2 / (len(strata) * 5 * 10):
                    cutoffs[stratum, rule] = cell / 10
                    break
    assert cutoffs
    for k, _, x in rows:
        bad = any(v > cutoffs.get((x, rule), 2) for rule, v in enumerate(shares(out[k])))
        assert out[k].kept == (not out[k].base_failed and not bad)
    assert not any(out[2000 + k].kept for k in range(10))

"""Words and lines taken apart for many texts at once, against plain loops."""

from __future__ import annotations

import types

import numpy as np
import xxhash

from flowsentry.llm import collocations, line_templates
from flowsentry.llm.words import span_hashes


def _counted(monkeypatch, module) -> list:
    seen = []

    def digest(data):
        seen.append(bytes(data))
        return xxhash.xxh64_intdigest(data)

    monkeypatch.setattr(module, "xxhash", types.SimpleNamespace(xxh64_intdigest=digest))
    return seen


def test_lines_equal_a_plain_loop_and_equal_tokens_are_hashed_once(monkeypatch):
    texts = [None, b"", b"\n\n", b"one two\tthree four 5 five\r\n\n x 7", b"one one one one one\n\x0b\nx 7",
             "é 3é é\x00 4 é é".encode(), b"one two\tthree four 5 five"] * 3
    hashed = _counted(monkeypatch, line_templates)
    row, place, size, codes = line_templates.parse(texts)
    assert len(hashed) == len(set(hashed))
    want, numbers = [], []
    for k, text in enumerate(texts):
        for at, line in enumerate((text or b"").split(b"\n")):
            if parts := line.split():
                want.append((k, at, len(parts)))
                for part in parts:
                    field = len(parts) >= line_templates.LEAST_TOKENS and any(x in b"0123456789" for x in part)
                    short = b" " if len(parts) < line_templates.LEAST_TOKENS else b""
                    numbers.append(xxhash.xxh64_intdigest(b"\x00" if field else short + part))
    assert list(zip(row.tolist(), place.tolist(), size.tolist())) == want
    assert codes.tolist() == numbers
    assert [len(x) for x in line_templates.parse([b" \n", None])] == [0, 0, 0, 0]
    assert np.array_equal(line_templates.parse([])[3], np.zeros(0, np.uint64))


def test_spans_have_equal_hashes_if_equal():
    words = [b"a" * n + end for n in range(1, 70) for end in (b"", b"b", b"\x00")] * 2
    codes = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    hashes = span_hashes(codes, end - [len(w) for w in words], end).tolist()
    assert len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
    assert len(span_hashes(codes[:0], end[:0], end[:0])) == 0


def test_a_task_sums_its_words(spark, monkeypatch):
    """Every distinct word of a task is sent once, though its texts are taken apart in several groups."""
    texts = spark.createDataFrame([("one Two, two", "en"), ("two three", "en"), ("two", "de"), ("", "en")], "text string, lang string")
    monkeypatch.setattr(collocations, "SHARD_BYTES", 1)
    for most in (collocations.WORDS, 2):
        monkeypatch.setattr(collocations, "WORDS", most)
        rows = collocations._scan(texts.coalesce(1), 0, 4, 5, {}).collect()
        counts = {}
        for r in rows:
            counts[(r.lang, bytes(r.word))] = counts.get((r.lang, bytes(r.word)), 0) + r.n
        assert counts == {("en", b"one"): 1, ("en", b"two"): 3, ("en", b"three"): 1, ("de", b"two"): 1}
        assert most == 2 or len(rows) == len(counts)

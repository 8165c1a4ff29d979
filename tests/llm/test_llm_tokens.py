import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowsentry.llm import bpe, token_files
from flowsentry.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "12", "<|endoftext|>", "é", "中", " ", "\x1c", "!", ".", ",", "\r\n",
             "word", "​", "😀", "_", "—"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]


def test_both_encoders_equal_the_library(texts):
    coder = bpe.BytePairCoder(PATH)
    own, lib = coder.chunk_encoder(), token_files.library_encoder(PATH)
    small = coder.chunk_encoder()
    small.cache.limit = 3  # a cache that starts again all the time
    for text in texts:
        want = ids_of(text)
        for encoder in (own, lib, small):
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, text
        assert coder.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


def test_long_runs_of_special_tokens_and_long_pieces():
    coder = bpe.BytePairCoder(PATH, word_limit=2000)
    encoder = coder.chunk_encoder()
    for text in ("<|endoftext|>" * 5000, "x<|endoftext|>" * 3000 + "<|endoftex", "ab<|endoftext|> cd " * 500, "Zm9v" * 5000):
        assert coder.encode_piece(text) == np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(text)
    assert all(len(piece) <= 64 for piece in encoder.cache) and coder.word_bytes <= 2000


def test_encode_documents(spark, sf_dir, odd_docs, no_docs):
    for docs in (table(spark, sf_dir, "documents"), odd_docs):
        want = []
        for row in docs.collect():
            ids = ids_of(row.text)
            want.append((row.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((row.text or "").encode()).hexdigest()))
        got = [tuple(r) for r in bpe.encode_documents(docs, PATH).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.encode_documents(no_docs, PATH).count() == 0


def test_decode_documents_is_a_round_trip(odd_docs):
    kept = bpe.encode_documents(odd_docs, PATH, keep_ids=True)
    back = bpe.decode_documents(kept, PATH).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r.doc_id or -1, r.text or "") for r in odd_docs.collect())


@pytest.mark.parametrize("vocabulary", [50_257, 100_000])
def test_token_files(spark, sf_dir, odd_docs, vocabulary):
    for docs in (table(spark, sf_dir, "documents"), odd_docs):
        written = token_files.write_token_files(docs, lambda: token_files.library_encoder(PATH), vocabulary, length=64, per_batch=4)
        want, start = [], 0
        rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        for row in rows:
            ids = [*ids_of(row.text), 0]
            want.append((row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(written.documents(spark).collect(), key=str) == sorted(want, key=str)


def test_sequences_have_equal_length_and_masks(spark, odd_docs):
    written = token_files.write_token_files(odd_docs, lambda: token_files.library_encoder(PATH), 50_257, length=16, per_batch=3)
    stream = []
    for part, count, _ in written.parts(spark):
        file = token_files.TokenFile(written.path(part))
        found = []
        for k in range(-(-count // 16)):
            ids, mask = file.sequence(k)
            assert len(ids) == len(mask) == 16 and ids.dtype == np.uint16
            found += ids[mask].tolist()
        assert len(found) == count and found == file.ids(0, count).tolist()
        stream += found
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    assert stream == [x for r in rows for x in [*ids_of(r.text), 0]]


def test_empty_table_gives_no_file(spark, no_docs):
    written = token_files.write_token_files(no_docs, lambda: token_files.library_encoder(PATH), 50_257)
    assert written.parts(spark) == [] and written.documents(spark).count() == 0

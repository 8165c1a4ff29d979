"""Byte-pair encoding and decoding by the rules of a tokenizer file.

Encoding keeps the symbols of a pre-token in a doubly linked list and the possible merges in a
priority queue by (rank, place). A merge taken from the queue is skipped when one of its symbols
has changed since. Decoding concatenates the byte strings of the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ENTRY_BYTES, LONGEST_PIECE, ChunkEncoder, byte_alphabet, is_word
from .common import slices


class BytePairCoder:
    """Encoder and decoder of a byte-level BPE tokenizer file."""

    def __init__(self, tokenizer_file: str, word_limit: int = 48 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as file:
            spec = json.load(file)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = self.vocab[left], self.vocab[right]
            self.merges.setdefault(pair, (rank, self.vocab[left + right]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, longest_first))) if self.special else None
        # Only the rule that cuts text into pre-tokens is the library's.
        self.pre_tokenize = Tokenizer.from_file(tokenizer_file).pre_tokenizer.pre_tokenize_str
        alphabet = byte_alphabet()
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.strings = [b""] * size
        for token, number in self.vocab.items():
            self.strings[number] = bytes(alphabet[c] for c in token)
        for token, number in self.special.items():
            self.strings[number] = token.encode()
        self.of_byte = [0] * 256
        for char, byte in alphabet.items():
            self.of_byte[byte] = self.vocab[char]
        self.to_byte = alphabet
        self.words: dict[bytes, list[int]] = {}  # of word_limit bytes at most
        self.word_limit, self.word_bytes = word_limit, 0

    def merge_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.of_byte[b] for b in word]
        last = len(ids)
        before, behind = list(range(-1, last - 1)), [*range(1, last), -1]
        find, pop, push = self.merges.get, heapq.heappop, heapq.heappush
        queue = [
            (found[0], at, a, b, found[1])
            for at, (a, b) in enumerate(zip(ids, ids[1:])) if (found := find((a, b)))
        ]
        heapq.heapify(queue)
        while queue:
            _, left, a, b, merged = pop(queue)
            right = behind[left]
            if ids[left] != a or right < 0 or ids[right] != b:
                continue  # stale: one of the two symbols has changed
            ids[left], ids[right] = merged, -1
            after, ahead = behind[right], before[left]
            behind[left] = after
            if after >= 0:
                before[after] = left
                if found := find((merged, ids[after])):
                    push(queue, (found[0], left, merged, ids[after], found[1]))
            if ahead >= 0 and (found := find((ids[ahead], merged))):
                push(queue, (found[0], ahead, ids[ahead], merged, found[1]))
        return [x for x in ids if x >= 0]

    def _word(self, word: bytes) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            ids = self.merge_word(word)
            if len(word) <= LONGEST_PIECE:
                self.word_bytes += ENTRY_BYTES + len(word) + 40 * len(ids)
                if self.word_bytes > self.word_limit:
                    self.words.clear()
                    self.word_bytes = 0
                self.words[word] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        if is_word(text):  # cached as a piece already
            return self.merge_word(text.encode())
        out: list[int] = []
        for word, _ in self.pre_tokenize(text):
            out.extend(self._word(bytes(map(self.to_byte.__getitem__, word))))
        return out

    def encode_piece(self, text: str) -> list[int]:
        """Special tokens' strings become their ids, as in the library."""
        out, at = [], 0
        for found in self.marks.finditer(text) if self.marks else ():
            if at < found.start():
                out += self._plain(text[at:found.start()])
            out.append(self.special[found.group()])
            at = found.end()
        if at < len(text):
            out += self._plain(text[at:])
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")

    def chunk_encoder(self) -> ChunkEncoder:
        return ChunkEncoder(lambda piece: array("I", self.encode_piece(piece)).tobytes())


def encode_documents(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256 (, ids).

    Null texts count as empty: no ids, and the hashes of nothing. Repeated rows and equal ids give
    a row each; other columns are not read. Nothing is shuffled; a task holds a few MB of text and
    bounded caches.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder = None
        for batch in batches:
            for piece in slices(batch, "text"):
                if coder is None:
                    coder = BytePairCoder(tokenizer_file)
                    encoder, decimal = coder.chunk_encoder(), [str(k) for k in range(len(coder.strings))]
                counts, hashes, back, kept = [], [], [], []
                for text in piece.column("text").to_pylist():
                    ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
                    counts.append(len(ids))
                    hashes.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                columns = {"doc_id": piece.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
                           "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
                if keep_ids:
                    columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


def decode_documents(encoded: DataFrame, tokenizer_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of stored ids: doc_id, text. A null list gives a null text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or BytePairCoder(tokenizer_file)
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    source = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, f"doc_id {kind}, text string")

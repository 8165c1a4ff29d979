"""Token ids as Arrow files of equal-length sequences with masks, open to random access.

Documents are encoded, each followed by an end id, and laid out in ascending order over files.
A file holds one stream of ids cut into sequences of ``length`` ids; its last sequence is filled
up and the mask says which ids are real. Record batches hold ``per_batch`` sequences (the last
one fewer), uncompressed, as fixed-size lists, so a memory-mapped file gives any sequence by its
number without copying. Ids are stored in 16 bits where the vocabulary allows, else in 32.

Next to the files, a Parquet table says where each document lies. Tasks write to a name of their
own and rename it when it is whole, so a task may be lost and run again, even twice at a time.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions.session import scratch_path

from .chunks import ChunkEncoder, byte_alphabet, is_word
from .common import slices

LENGTH, PER_BATCH, END_ID = 1024, 256, 0


def library_encoder(tokenizer_file: str) -> ChunkEncoder:
    """Ids of the tokenizers library as 32-bit little-endian bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    model, shown = tokenizer.model, str.maketrans({chr(b): c for c, b in byte_alphabet().items()})

    def encode_piece(text: str) -> bytes:
        if is_word(text):  # one pre-token: straight to the library's model
            found = model.tokenize(text.encode().decode("latin-1").translate(shown))
            return array("I", [t.id for t in found]).tobytes()
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    return ChunkEncoder(encode_piece)


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


class _Writer:
    """One file: takes ids, puts out record batches of full sequences."""

    def __init__(self, root: str, part: int, width: str, length: int, per_batch: int):
        self.fs, folder = _file_system(root)
        self.fs.create_dir(folder)
        self.final = f"{folder}/part-{part:06d}.arrow"
        self.own = f"{folder}/.part-{part:06d}-{uuid.uuid4().hex}"
        self.width, self.length, self.block = width, length, length * per_batch
        ids = pa.list_(pa.from_numpy_dtype(np.dtype(width)), length)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(self.own)
        self.ipc = pa.ipc.new_file(self.out, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.width))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block:
            stream = np.concatenate(self.waiting)
            whole = len(stream) // self.block * self.block
            for at in range(0, whole, self.block):
                self._put(stream[at:at + self.block])
            self.waiting, self.held = [stream[whole:]], len(stream) - whole

    def _put(self, ids: np.ndarray) -> None:
        padded = np.zeros(-(-len(ids) // self.length) * self.length, ids.dtype)
        padded[:len(ids)] = ids
        mask = np.arange(len(padded)) < len(ids)
        self.ipc.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(padded), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ], schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.waiting))
        self.ipc.close()
        self.out.close()
        self.fs.move(self.own, self.final)


class TokenFile:
    """Random access to one file; memory-mapped where the file is local."""

    def __init__(self, path: str):
        fs, name = _file_system(path)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(name) if local else fs.open_input_file(name)
        self.ipc = pa.ipc.open_file(self.source)
        self.length = self.ipc.schema.field("ids").type.list_size
        self.at, self.batch = -1, None
        first = self.ipc.get_batch(0).num_rows if self.ipc.num_record_batches else 1
        self.per_batch = first

    def _batch(self, number: int) -> pa.RecordBatch:
        if number != self.at:
            self.at, self.batch = number, self.ipc.get_batch(number)
        return self.batch

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of one sequence."""
        batch, row = self._batch(number // self.per_batch), number % self.per_batch
        ids = batch.column("ids")[row].values.to_numpy()
        return ids, batch.column("mask")[row].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids of the stream from ``start`` on."""
        size, parts = self.length * self.per_batch, []
        while count:
            number, inner = divmod(start, size)
            values = self._batch(number).column("ids").flatten().to_numpy()[inner:inner + count]
            parts.append(values)
            start, count = start + len(values), count - len(values)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


@dataclass(frozen=True)
class TokenSet:
    """A written set: its folder, and ``index`` with part, doc_id, local_start and n_tokens."""

    folder: str

    def index(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/index")

    def path(self, part: int) -> str:
        return f"{self.folder}/ids/part-{part:06d}.arrow"

    def parts(self, spark: SparkSession) -> list[tuple[int, int, int]]:
        """Per file: number, ids in it, ids in all files before it. One row per file."""
        found = (
            self.index(spark).groupBy("part")
            .agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n")).collect()
        )
        rows, before = [], 0
        for part, n in sorted(found):
            rows.append((part, n, before))
            before += n
        return rows

    def documents(self, spark: SparkSession) -> DataFrame:
        """Read every document's ids back: doc_id, start, n_tokens, ids_crc32."""
        folder = self.folder

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, file = None, None
            for batch in batches:
                sums = []
                for p, start, n in zip(*(batch.column(c).to_pylist() for c in ("part", "local_start", "n_tokens"))):
                    if p != part:
                        part, file = p, TokenFile(TokenSet(folder).path(p))
                    sums.append(zlib.crc32(np.ascontiguousarray(file.ids(start, n), "<u4")))
                kept = {c: batch.column(c) for c in ("part", "doc_id", "local_start", "n_tokens")}
                yield pa.RecordBatch.from_pydict(kept | {"ids_crc32": pa.array(sums, pa.int64())})

        index = self.index(spark).select("part", "doc_id", "local_start", "n_tokens")
        kind = index.schema["doc_id"].dataType.simpleString()
        back = index.mapInArrow(
            read, f"part int, doc_id {kind}, local_start long, n_tokens long, ids_crc32 long")
        places = spark.createDataFrame(
            [(part, before) for part, _, before in self.parts(spark)], "part int, before long")
        return back.join(places, "part").select(
            "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def write_token_files(
    docs: DataFrame, make_encoder: Callable[[], ChunkEncoder], vocabulary: int,
    folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    length: int = LENGTH, per_batch: int = PER_BATCH, end_id: int = END_ID,
) -> TokenSet:
    """Write the ids of all documents in ascending order of ``id_col`` to ``folder``.

    Null texts count as empty and give the end id alone. Null ids come first; rows of equal id
    go by their text, so repeated rows stay and stand together. An empty table gives an empty
    index and no file. Other columns are not read. ``vocabulary`` is the number of ids.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    width = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, encoder = TaskContext.get().partitionId(), None, None
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for piece in slices(batch, "text"):
                if out is None:
                    out, encoder = _Writer(f"{folder}/ids", part, width, length, per_batch), make_encoder()
                starts, counts = [], []
                for text in piece.column("text").to_pylist():
                    ids = np.frombuffer(encoder.encode(text) + end, "<u4")
                    starts.append(out.total)
                    counts.append(len(ids))
                    out.add(ids)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(counts), pa.int32()), "doc_id": piece.column("doc_id"),
                    "local_start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        if out is not None:
            out.close()

    ordered = (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )
    rows = ordered.mapInArrow(write, f"part int, doc_id {kind}, local_start long, n_tokens long")
    rows.write.parquet(f"{folder}/index")
    return TokenSet(folder)

"""Token ids in binary files, with Elias-Fano coded document boundaries.

Documents are put in ascending order of doc_id by ranges; each task encodes its
range and writes files of a bounded number of ids: a head, the doc_ids and the
document boundaries as two Elias-Fano sequences with select samples, and the
concatenated ids as narrow little-endian integers. A boundary costs
2 + log2(ids per document) bits, and no table of 64-bit offsets exists. A file's
name holds the attempt that wrote it, and the manifest, which Spark commits,
names the files that count; so nothing is renamed and a task may run again.

What is read back comes from the files alone: a file's number of ids is the last
boundary, and a document lies between two boundaries found by select.

Defined cases: a null text is empty and has its end id alone; documents of a
null doc_id come first; rows that share a doc_id come in the order of a hash of
their text, then of where they were read, so that no id is one task's; a text of
any length is one document of one file; an empty table gives no files. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path
from .tokens import END_ID, encoder

#: Bytes of text that one task encodes, about.
TEXT_PER_TASK = 1 << 27
#: Bytes of ids, and documents, after which a task begins the next file.
IDS_PER_FILE, DOCUMENTS_PER_FILE = 1 << 25, 1 << 18
#: Files that one task reads back, and files whose sizes are summed in one task.
FILES_PER_TASK, FILES_PER_SUM = 4, 1 << 16
MAGIC = b"TSTOKEN2"
HEAD = 48
#: One bits of the upper half between two select samples.
SAMPLE = 256


class EliasFano:
    """An ascending sequence of integers from 0: low bits packed, high bits in unary, and sampled positions for select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        planes = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, low_bits, np.packbits(planes.astype(np.uint8).reshape(-1), bitorder="little"), np.packbits(bits, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        piece = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (piece >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample before it."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        bits = np.unpackbits(self.high[byte : byte + 1 + SAMPLE // 8], bitorder="little")
        bits[: at % 8] = 0
        ones = np.flatnonzero(bits)
        width = 2 * SAMPLE
        while len(ones) <= left:  # a sparse stretch: look further
            bits = np.unpackbits(self.high[byte : byte + width], bitorder="little")
            bits[: at % 8] = 0
            ones, width = np.flatnonzero(bits), 2 * width
        return ((byte * 8 + int(ones[left]) - i) << self.low_bits) | self._low(i)

    def values(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        planes = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        low = (planes.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | low

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.low, self.high, self.samples))

    @classmethod
    def from_buffer(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the buffer's start, and its length in bytes."""
        n, low_bits, low, high = (int(x) for x in np.frombuffer(data, "<i8", 4))
        samples = -(-n // SAMPLE)
        end = 32 + low + high
        return cls(n, low_bits, np.frombuffer(data, np.uint8, low, 32), np.frombuffer(data, np.uint8, high, 32 + low), np.frombuffer(data, "<u4", samples, end)), end + 4 * samples


class TokenFile:
    """One file: doc_ids, boundaries and ids. `data` may end before the ids where only boundaries are asked for."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        width, self.n_nulls, self._base, first, second = self.head(data)
        self._known, _ = EliasFano.from_buffer(view[HEAD : HEAD + first])
        self.boundaries, _ = EliasFano.from_buffer(view[HEAD + first : HEAD + first + second])
        self._ids = view[HEAD + first + second :].cast("B")
        self._dtype = np.dtype(f"<u{width}")

    @staticmethod
    def head(data: bytes) -> tuple[int, ...]:
        """Bytes of an id, null doc_ids, the least doc_id, and the lengths of the two sequences."""
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        return tuple(int(x) for x in np.frombuffer(data, "<i8", 5, 8))

    def __len__(self) -> int:
        return self.boundaries.n - 1

    @property
    def n_ids(self) -> int:
        return self.boundaries.select(len(self))

    @property
    def doc_ids(self) -> list[int | None]:
        known = (self._known.values() + np.uint64(self._base & (2**64 - 1))).view(np.int64)
        return [None] * self.n_nulls + known.tolist()

    def between(self, first: int, last: int) -> np.ndarray:
        return np.frombuffer(self._ids, self._dtype, last - first, first * self._dtype.itemsize)

    def document(self, i: int) -> np.ndarray:
        return self.between(self.boundaries.select(i), self.boundaries.select(i + 1))

    @staticmethod
    def encode(doc_ids: list[int | None], pieces: list[bytes], dtype: np.dtype) -> bytes:
        """doc_ids: ascending, nulls first."""
        known = np.array([x for x in doc_ids if x is not None], np.int64)
        base = int(known[0]) if len(known) else 0
        ends = np.concatenate([[0], np.cumsum([len(p) // dtype.itemsize for p in pieces], dtype=np.int64)])
        coded = [EliasFano.build(x).to_bytes() for x in (known.view(np.uint64) - np.uint64(base & (2**64 - 1)), ends)]
        head = np.array([dtype.itemsize, len(doc_ids) - len(known), base, *map(len, coded)], "<i8").tobytes()
        return b"".join([MAGIC, head, *coded, *pieces])


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, data: bytes) -> None:
    store, path = _store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)


def open_file(uri: str, with_ids: bool = True) -> TokenFile:
    store, path = _store(uri)
    with store.open_input_file(path) as f:
        head = f.read(HEAD)
        return TokenFile(head + (f.read() if with_ids else f.read(sum(TokenFile.head(head)[3:]))))


def _writer(folder: str, tokenizer_file: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_file)
        end = np.array([END_ID], tokens.dtype).tobytes()
        part, attempt, n_files = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        doc_ids: list[int | None] = []
        pieces: list[bytes] = []
        size = 0

        def put() -> pa.RecordBatch:
            path = f"{folder}/{part:08d}-{n_files:06d}-{attempt}.tokens"
            _put(path, TokenFile.encode(doc_ids, pieces, tokens.dtype))
            return pa.RecordBatch.from_pydict({"part": [part], "nth": [n_files], "path": [path], "n_documents": [len(doc_ids)]})

        for b in batches:
            for doc_id, ids in zip(b["doc_id"].to_pylist(), tokens.encode(text.as_py() or "" for text in b["text"])):
                doc_ids.append(doc_id)
                pieces.append(ids + end)
                size += len(ids) + len(end)
                if size >= IDS_PER_FILE or len(doc_ids) >= DOCUMENTS_PER_FILE:
                    yield put()
                    n_files, size = n_files + 1, 0
                    doc_ids.clear()
                    pieces.clear()
        if doc_ids:
            yield put()

    return write


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str | None = None) -> DataFrame:
    """Write docs (doc_id, text) as token files. Returns the manifest in the order of the files: part, nth, path, n_documents."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(size // TEXT_PER_TASK + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["doc_id", "_tie", "_row"]
    rows = rows.withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(rows.mapInArrow(_writer(folder, tokenizer_file), "part long, nth long, path string, n_documents long"), "token-manifest")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("n_ids", pa.array([open_file(p, with_ids=False).n_ids for p in b["path"].to_pylist()], pa.int64()))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, first in zip(b["path"].to_pylist(), b["first"].to_pylist()):
            file = open_file(path)
            bounds = np.array([file.boundaries.select(i) for i in range(len(file) + 1)], np.int64)
            crcs = [zlib.crc32(file.between(a, z).astype("<u4")) for a, z in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(bounds[:-1] + first), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """A row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    count = manifest.count()
    tasks = max(1, min(count, max(count // FILES_PER_TASK, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    files = manifest.select("part", "nth", "path").repartition(tasks)
    files = materialize(files.mapInArrow(_sizes, "part long, nth long, path string, n_ids long").withColumn("run", F.floor(F.col("part") / FILES_PER_SUM)), "token-sizes")
    # Sums within runs of parts, and before each run: one row per run.
    runs = files.groupBy("run").agg(F.sum("n_ids").alias("n_run"))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", F.coalesce(F.sum("n_run").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("run").orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    files = files.join(F.broadcast(runs), "run").select("path", (F.col("before") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("first"))
    return files.repartition(tasks).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")

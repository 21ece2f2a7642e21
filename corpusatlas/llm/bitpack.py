"""Token ids in fixed-width, bit-packed files with block offsets.

A file holds documents in ascending doc_id order: a header, the documents' ids and ends, the byte offset of each block,
and the blocks. A block holds `block` ids (the last one fewer) of `width` bits each, the minimum for the vocabulary, the
lowest bit first, padded to whole bytes. So any range of ids is found by division and unpacked by numpy.

The table may hold: null texts (no token but the end id); null doc_ids (they come first and stay null); repeated rows and
doc_ids (each row is a document of its own; equal ids follow in order of their texts' hashes); texts of any length (one
document's ids are held at a time, whatever their number); nothing (no file, no row); any
other columns (not read).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusatlas.llm import files
from corpusatlas.llm.common import fresh_dir, materialise, portions
from corpusatlas.llm.tokens import coder, default_tokenizer

MAGIC = b"IDPACK1\0"
HEAD = struct.Struct("<8sIIQQQ")  # magic, width, block, documents, ids, blocks


def min_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids under 2**width, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None].astype("<u8") >> np.arange(width, dtype="<u8") & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{width // 8}", count=n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype("<u8") << np.arange(width, dtype="<u8")).sum(axis=1).astype("<u4")


def build(docs: list[tuple[int | None, np.ndarray]], width: int, block: int) -> list[bytes]:
    """The parts of one file."""
    ids = np.concatenate([x for _, x in docs]) if docs else np.empty(0, "<u4")
    blocks = [pack(ids[i : i + block], width) for i in range(0, len(ids), block)]
    return [
        HEAD.pack(MAGIC, width, block, len(docs), len(ids), len(blocks)),
        np.array([d is not None for d, _ in docs], np.uint8).tobytes(),
        np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
        np.cumsum([len(x) for _, x in docs], dtype="<u8").tobytes(),
        np.cumsum([0, *map(len, blocks)], dtype="<u8").tobytes(),
        *blocks,
    ]


class TokenFile:
    """Random access to a file: by document, or by range of ids."""

    def __init__(self, path: str):
        self.f = files.open_at(path)
        magic, self.width, self.block, n, self.n_ids, blocks = HEAD.unpack(self.f.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        known = np.frombuffer(self.f.read(n), np.uint8)
        ids = np.frombuffer(self.f.read(8 * n), "<i8")
        self.doc_ids = [int(d) if k else None for k, d in zip(known, ids, strict=True)]
        self.ends = np.frombuffer(self.f.read(8 * n), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(self.f.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.at = self.f.tell()

    def range(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        self.f.seek(self.at + int(self.offsets[first]))
        data, out = self.f.read(int(self.offsets[last + 1] - self.offsets[first])), []
        for b in range(first, last + 1):
            part = data[self.offsets[b] - self.offsets[first] : self.offsets[b + 1] - self.offsets[first]]
            out.append(unpack(part, self.width, min(self.block, self.n_ids - b * self.block)))
        return np.concatenate(out)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.range(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def documents(self, ids: int = 1 << 20):
        """All documents in order, reading about `ids` ids at a time."""
        i = 0
        while i < len(self.ends):
            start = int(self.ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(self.ends, start + ids, "right")))
            got = self.range(start, int(self.ends[j - 1]))
            for k in range(i, j):
                a = (int(self.ends[k - 1]) if k else 0) - start
                yield self.doc_ids[k], got[a : int(self.ends[k]) - start]
            i = j

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 1, docs_per_file: int = 4096, bytes_per_file: int = 32 << 20, block: int = 8192) -> DataFrame:
    """Encodes (doc_id, text), appends end_id to each, writes files in ascending doc_id order; one row per file.

    Rows are dealt by ranges of (doc_id, text hash, row), so that rows without an id or with the same one spread like any
    others. A range becomes one file, or several in its order once `bytes_per_file` bytes of ids are held: that is all
    that a task holds, but for a longer document. Rows: part, piece (files in doc_id order), path, n_docs, n_tokens, start
    (ids in the files before it).
    """
    tokenizer, spark = tokenizer or default_tokenizer(), docs.sparkSession
    folder = folder or fresh_dir(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    parts = max(1, -(-size["n"] // docs_per_file), -(-size["b"] // bytes_per_file))

    def save(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        c, part = coder(tokenizer), TaskContext.get().partitionId()
        width, tail = min_width(max(c.vocabulary, end_id + 1)), np.array([end_id], "<u4").tobytes()
        held, n, piece = [], 0, 0

        def flush():
            files.write(path := f"{folder}/ids-{part:06d}-{piece:06d}.bin", build(held, width, block))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "piece": pa.array([piece], pa.int32()), "path": [path], "n_docs": pa.array([len(held)], pa.int64()), "n_tokens": pa.array([n], pa.int64())})

        for b in batches:
            for some in portions(b):
                for d, ids in zip(some.column("doc_id").to_pylist(), c.encode(some.column("text").to_pylist()), strict=True):
                    held.append((d, np.frombuffer(ids + tail, "<u4")))
                    n += len(held[-1][1])
                    if 4 * n >= bytes_per_file:
                        yield flush()
                        held, n, piece = [], 0, piece + 1
        if held:
            yield flush()

    order = [F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("row")]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = materialise(dealt.mapInArrow(save, "part int, piece int, path string, n_docs long, n_tokens long"), "manifest")
    # ids before a file: those of the ranges before (one row a range), and of the pieces before it
    ranges = manifest.groupBy("part").agg(F.sum("n_tokens").alias("of"))
    before = ranges.select("part", (F.sum("of").over(Window.orderBy("part")) - F.col("of")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("piece")) - F.col("n_tokens")
    return manifest.withColumn("own", own).join(before, "part").select("part", "piece", "path", "n_docs", "n_tokens", (F.col("before") + F.col("own")).alias("start"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, part, piece, index."""

    def load(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * 4 + [pa.int32()] * 3
        for b in batches:
            for part, piece, path, start in zip(*(b.column(k).to_pylist() for k in ("part", "piece", "path", "start")), strict=True):
                with TokenFile(path) as f:
                    rows = []
                    for i, (d, ids) in enumerate(f.documents()):
                        rows.append((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), part, piece, i))
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "part", "piece", "index"])

    # a row per file: a task each
    n = max(1, manifest.count())
    return manifest.repartition(n, "part", "piece").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, piece int, index int")


def encode_to_files(docs: DataFrame, **settings) -> DataFrame:
    """write_tokens, read back."""
    return read_tokens(write_tokens(docs, **settings))

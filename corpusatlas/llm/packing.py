"""Best-fit packing of token sequences under several capacities at once.

Pieces are placed in descending length. A bin's state is its residual tokens, documents and attention cost (the sum of
squared lengths); a piece goes to the feasible bin with the least weighted norm of what would remain ("norm", best fit)
or the greatest weighted dot product of the piece with the residual ("dot"). The default capacities for documents and
attention are those that tokens imply, so that they bind only when they are lowered.

The table may hold: null texts (only the end id); null and repeated doc_ids (each row is a document of its own); texts of
any length (cut into pieces of the token capacity); nothing (no row); any other columns (not read).
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas.llm.common import map_arrow, materialise
from corpusatlas.llm.tokens import coder, coders, default_tokenizer


def best_fit(lengths: np.ndarray, tokens: int, documents: int | None = None, attention: int | None = None, weights=(1.0, 1.0, 1.0), rule: str = "norm") -> np.ndarray:
    """A bin for each length, given in descending order."""
    size = np.array([tokens, documents or tokens, attention or tokens * tokens], dtype=float)
    w = np.array(weights, dtype=float)
    bins = np.empty(len(lengths), dtype=np.int64)
    room = np.empty((3, max(16, len(lengths))))  # shares of the capacities that are left
    names, n, made = np.empty(max(16, len(lengths)), dtype=np.int64), 0, 0
    least = (np.array([lengths[-1], 1, float(lengths[-1]) ** 2]) / size) if len(lengths) else None
    eps = 1e-12
    for i, length in enumerate(lengths):
        item = np.array([length, 1, float(length) ** 2]) / size
        if (item > 1 + eps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        open_ = room[:, :n]
        fits = np.flatnonzero((open_[0] >= item[0] - eps) & (open_[1] >= item[1] - eps) & (open_[2] >= item[2] - eps))
        if len(fits):
            left = open_[:, fits] - item[:, None]
            k = int(fits[np.argmin(w @ (left * left)) if rule == "norm" else np.argmax((w * item) @ open_[:, fits])])
            room[:, k] -= item
        else:
            k, n, made = n, n + 1, made + 1
            room[:, k], names[k] = 1 - item, made - 1
        bins[i] = names[k]
        if (room[:, k] < least - eps).any():  # full for all that follow
            n -= 1
            room[:, k], names[k] = room[:, n], names[n]
    return bins


def pieces_of(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, tokens: int = 2048, keep_ids: bool = False) -> DataFrame:
    """(doc_id, text) encoded, ended by end_id, and cut at `tokens`: doc_id, piece, start, length, ids_crc32[, ids]."""
    tokenizer = tokenizer or default_tokenizer()

    def encode(batch):
        import pyarrow as pa

        tail, rows = np.array([end_id], "<u4").tobytes(), []
        for d, ids in zip(batch.column("doc_id").to_pylist(), coder(tokenizer).encode(batch.column("text").to_pylist()), strict=True):
            ids += tail
            for piece, a in enumerate(range(0, len(ids), 4 * tokens)):
                part = ids[a : a + 4 * tokens]
                rows.append((d, piece, a // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + keep_ids]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), encode, schema, kept=coders)


def pack_pieces(pieces: DataFrame, tokens: int = 2048, documents: int | None = None, attention: int | None = None, weights=(1.0, 1.0, 1.0), rule: str = "norm", group_rows: int = 20_000) -> DataFrame:
    """pieces with sequence_id and offset. A piece as long as the capacity is a sequence of its own; the others are dealt
    by their row number into groups of about `group_rows`, each packed by one task: at most one ill-filled bin a group."""
    rows = materialise(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") >= tokens
    part = rows.filter(~whole)
    groups = max(1, -(-part.count() // group_rows))

    def place(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "__row"], ascending=[False, True, True, True], kind="stable")
        bins = best_fit(pdf["length"].to_numpy(), tokens, documents, attention, weights, rule)
        pdf["sequence_id"] = (np.int64(key[0]) << np.int64(32)) + bins
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns=["__row", "__group"])

    kept = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    packed = part.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)).cast("long")).groupBy("__group").applyInPandas(place, f"{kept}, sequence_id long, offset long")
    alone = rows.filter(whole).select(*pieces.columns, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, tokens: int = 2048, keep_ids: bool = False, **settings) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with keep_ids the ids."""
    return pack_pieces(pieces_of(docs, tokenizer, end_id, tokens, keep_ids), tokens, **settings)

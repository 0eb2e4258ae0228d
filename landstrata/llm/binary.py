"""Token ids in binary segments of patched frame-of-reference blocks.

A segment holds the ids of consecutive documents. Its bytes, little-endian:

    "PFR1" | ids u64 | blocks u32 | block starts u32 x (blocks + 1) | blocks
    block: least id u32 | width u8 | 0 u8 | exceptions u16 | packed u64 words | positions u8 x e | values u32 x e

A block has 128 ids (the last one is filled up with its least id). What is packed is each id less the block's least,
at the width that the given percentile of them needs; larger ones are exceptions with their whole value. Value i of a
block takes the bits from i x width on.

Segments are rows of a Parquet folder, so that Spark's committers put them on any file system and a lost task leaves
nothing half-written.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from landstrata.llm.common import scratch
from landstrata.llm.tokens import encoded

MAGIC, BLOCK, PERCENTILE = b"PFR1", 128, 90
_FIXED = 16
SEGMENT_SCHEMA = "part int, seq int, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def encode_segment(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """The bytes of one segment."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return MAGIC + struct.pack("<QI", 0, 0) + struct.pack("<I", 0)
    whole = np.full(blocks * BLOCK, ids[(blocks - 1) * BLOCK:].min(), np.uint32)
    whole[:n] = ids
    grid = whole.reshape(blocks, BLOCK)
    low = grid.min(1)
    rest = grid - low[:, None]
    at = max(0, -(-BLOCK * percentile // 100) - 1)
    width = _bits(np.partition(rest, at, axis=1)[:, at])
    outlier = (rest.astype(np.uint64) >> width.astype(np.uint64)[:, None]) != 0
    exceptions = outlier.sum(1)
    size = 8 + width * (BLOCK // 8) + 5 * exceptions
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(starts[-1], np.uint8)
    head = np.zeros(blocks, np.dtype([("low", "<u4"), ("width", "u1"), ("pad", "u1"), ("n", "<u2")]))
    head["low"], head["width"], head["n"] = low, width, exceptions
    out[starts[:-1, None] + np.arange(8)] = head.view(np.uint8).reshape(blocks, 8)
    for w in np.unique(width[width > 0]):
        sel = np.flatnonzero(width == w)
        kept = np.where(outlier[sel], 0, rest[sel]).astype(np.uint64).T.copy()
        words = np.zeros((2 * w, len(sel)), np.uint64)
        for i in range(BLOCK):
            word, bit = divmod(i * int(w), 64)
            words[word] |= kept[i] << np.uint64(bit)
            if bit + w > 64:
                words[word + 1] |= kept[i] >> np.uint64(64 - bit)
        packed = words.T.copy().view(np.uint8).reshape(len(sel), -1)
        out[starts[sel][:, None] + 8 + np.arange(packed.shape[1])] = packed
    row, col = np.nonzero(outlier)
    if len(row):
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(exceptions)])[row]
        place = starts[row] + 8 + width[row] * (BLOCK // 8)
        out[place + nth] = col
        value = rest[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(place + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = value
    return MAGIC + struct.pack("<QI", n, blocks) + starts.astype("<u4").tobytes() + out.tobytes()


def decode_segment(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (not included) of a segment; only the blocks that hold them are unpacked."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, blocks = struct.unpack_from("<QI", payload, 4)
    last = n if last is None else min(last, n)
    if last <= first:
        return np.empty(0, np.uint32)
    a, b = first // BLOCK, -(-last // BLOCK)
    starts = np.frombuffer(payload, "<u4", blocks + 1, _FIXED).astype(np.int64)[a:b]
    raw = np.frombuffer(payload, np.uint8, offset=_FIXED + 4 * (blocks + 1))
    head = raw[starts[:, None] + np.arange(8)].copy().view(np.dtype([("low", "<u4"), ("width", "u1"), ("pad", "u1"), ("n", "<u2")]))[:, 0]
    width, exceptions = head["width"].astype(np.int64), head["n"].astype(np.int64)
    grid = np.zeros((b - a, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        sel = np.flatnonzero(width == w)
        words = raw[starts[sel][:, None] + 8 + np.arange(16 * w)].copy().view("<u8").T.copy()
        mask = np.uint64((1 << int(w)) - 1)
        values = np.empty((BLOCK, len(sel)), np.uint32)
        for i in range(BLOCK):
            word, bit = divmod(i * int(w), 64)
            v = words[word] >> np.uint64(bit)
            if bit + w > 64:
                v = v | (words[word + 1] << np.uint64(64 - bit))
            values[i] = v & mask
        grid[sel] = values.T
    if exceptions.any():
        row = np.repeat(np.arange(b - a), exceptions)
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(exceptions)])[row]
        place = starts[row] + 8 + width[row] * (BLOCK // 8)
        col = raw[place + nth]
        grid[row, col] = raw[(place + exceptions[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    grid += head["low"][:, None]
    return grid.reshape(-1)[first - a * BLOCK:last - a * BLOCK]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, segment_ids: int = 1 << 18) -> str:
    """Encode whole texts, append ``end_id`` to each, and write the ids in ascending doc_id order; gives the folder.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are not read. A null text has the end id alone; a
    null doc_id comes before all others; rows of one doc_id are ordered by the hash of their text. Rows are dealt by
    ranges of these two, so a repeated doc_id does not make one large range unless the texts are equal too. Part p
    of the files holds smaller documents than part p + 1. A segment is closed by the document that fills it, so one
    document is never spread over two.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    order = [F.col("doc_id").asc_nulls_first(), F.col("__h")]

    def pack(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        seq, start, ids, lengths, held, size = 0, 0, [], [], [], 0
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

        def close():
            row = {"part": [part], "seq": [seq], "start": [start], "n_ids": [size], "doc_ids": [ids], "lengths": [lengths]}
            return pa.RecordBatch.from_pydict({**row, "payload": [encode_segment(np.frombuffer(b"".join(held), "<u4"))]}, schema)

        for (keys,), packed in encoded(batches, tokenizer, ["doc_id"]):
            for key, data in zip(keys, packed):
                ids.append(key)
                lengths.append(len(data) // 4 + 1)
                held += [data, end]
                size += lengths[-1]
                if size >= segment_ids:
                    yield close()
                    seq, start, ids, lengths, held, size = seq + 1, start + size, [], [], [], 0
        if ids:
            yield close()

    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("__h")).repartitionByRange(*order).sortWithinPartitions(*order)
    # Few rows a file: a reader takes thousands of rows of a column at once, and these are large.
    ranged.select("doc_id", "text").mapInArrow(pack, SEGMENT_SCHEMA).write.option("compression", "uncompressed").option("maxRecordsPerFile", 64).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """Documents read back from segments: doc_id, start, n_tokens, and ids_crc32 (or the ``ids`` as u32 bytes)."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)

    def unpack(batches):
        names = ["doc_id", "part", "at", "n_tokens", "ids_crc32" if digest else "ids"]
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = decode_segment(row["payload"]).astype("<u4"), np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                cut = [ids[e - n:e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist())]
                last = pa.array([zlib.crc32(c) for c in cut], pa.int64()) if digest else pa.array(cut, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(cut), pa.int32()), pa.array(row["start"] + ends - lengths), pa.array(lengths), last], names)

    docs = segments.mapInArrow(unpack, "doc_id long, part int, at long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))
    # One row per part: as many as the write had tasks, far fewer than documents.
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return docs.join(before, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", docs.columns[-1])

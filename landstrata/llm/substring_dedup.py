"""Removal of long repeated passages, found by anchors at difference-cover positions.

For a difference cover D of the residues modulo a period v, any two positions p and q have a shift d < v with p + d and q + d
both at cover positions. So if ``window`` words from p equal those from q, the shorter window of
``window - v + 1`` words at p + d equals that at q + d, and both are anchors. Only anchors (one in five positions) are
hashed and shuffled to find what documents share; around shared anchors all windows are then hashed in full.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from landstrata.llm.common import cut_lineage, written

#: A perfect difference set: each residue modulo 31 but 0 is one difference of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def is_cover(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def words_of(text: str | None) -> list[bytes]:
    """What lies between ASCII white space, unchanged."""
    return text.encode().split() if text else []


def _joined(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words joined by one space, and where each begins (one more entry for the end)."""
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    return b" ".join(words), at


def _anchors(docs: DataFrame, width: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """(anchor, doc_id, body, pos) of every document with at least ``width`` words; body is a hash of all its words."""
    residues = np.array(sorted(cover))

    def run(batches):
        import xxhash

        digest, names = xxhash.xxh3_64_intdigest, ["anchor", "doc_id", "body", "pos"]
        for batch in batches:
            out, size = [], 0

            def close():
                cols = [np.concatenate([r[i] for r in out]) for i in (0, 2, 3)]
                ids = [k for r in out for k in [r[1]] * len(r[0])]
                return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(ids, pa.int64()), pa.array(cols[1].view(np.int64)), pa.array(cols[2])], names)

            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                last = len(words) - width
                if last < 0:
                    continue
                pos = (np.arange(0, last + 1, period)[:, None] + residues).ravel()
                pos = pos[pos <= last].astype(np.int32)
                if not len(pos):
                    continue
                line, at = _joined(words)
                ends = at[pos + width] - 1
                h = np.fromiter((digest(line[a:b]) for a, b in zip(at[pos].tolist(), ends.tolist())), np.uint64, len(pos))
                out.append((h, key, np.full(len(pos), digest(line), np.uint64), pos))
                size += len(pos)
                if size > 1 << 17:
                    yield close()
                    out, size = [], 0
            if out:
                yield close()

    return docs.select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long, body long, pos int")


def _summaries(docs: DataFrame) -> DataFrame:
    """(doc_id, body, n_words, whole): the hash of all words, their number and the SHA-256 of the words joined."""

    def run(batches):
        import xxhash

        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                line = b" ".join(words)
                rows.append((xxhash.xxh3_64_intdigest(line), len(words), hashlib.sha256(line).digest()))
            body = np.array([r[0] for r in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(body), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["doc_id", "body", "n_words", "whole"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, body long, n_words long, whole binary")


def remove_repeats(docs: DataFrame, window: int = 50, period: int = PERIOD, cover: tuple[int, ...] = COVER, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts in a document with a smaller doc_id.

    Gives ``doc_id, n_words, n_removed, kept_sha256`` (and ``kept``, the words left joined by one space, if
    ``with_text``), one row per row of ``docs``. Windows are judged on the input. Null and empty texts have no words.
    A null doc_id is neither smaller nor larger than any: such a row loses nothing and takes nothing from others. Rows
    of one doc_id are judged one by one. Other columns of ``docs`` are not read.
    """
    if not is_cover(period, cover) or period > window:
        raise ValueError("cover must be a difference cover of a period of at most the window")
    width = window - period + 1
    summaries = written(_summaries(docs), "summaries")
    # Equal word sequences count once, under their smallest document: the others are covered as a whole.
    bodies = summaries.where("doc_id is not null").groupBy("whole").agg(F.min("doc_id").alias("low"))
    first = summaries.join(bodies, "whole", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False)) & (F.col("n_words") >= window))
    first = cut_lineage(first.drop("low"))

    anchors = _anchors(docs.where("doc_id is not null"), width, period, cover)
    shared = anchors.groupBy("anchor").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b").select("anchor")
    found = anchors.join(shared, "anchor").groupBy("doc_id", "body").agg(F.collect_set("pos").alias("shared"))
    originals = first.where("not copy and doc_id is not null").select("doc_id", "body").distinct()
    found = written(found.join(originals, ["doc_id", "body"]), "shared-anchors")

    # The texts that share something, with all windows that may be shared.
    texts = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("h"))
    meet = texts.join(found, "doc_id")
    def candidates(body, words, line, positions):
        """Starts of windows with a shared anchor: a window at i holds the anchors i .. i + period - 1."""
        import xxhash

        if xxhash.xxh3_64_intdigest(line) != body % (1 << 64):
            return np.empty(0, np.int64)  # another row of this doc_id
        marked = np.zeros(len(words) + 1, np.int64)
        marked[np.asarray(positions, np.int64) + 1] = 1
        before = np.cumsum(marked)
        start = np.arange(max(0, len(words) - window + 1))
        return start[before[start + period] > before[start]]

    def hash_windows(batches):
        import xxhash

        names, out, size = ["high", "low", "doc_id", "h", "pos"], [], 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "text", "h", "body", "shared")]
            for key, text, h, body, positions in zip(*cols):
                words = words_of(text)
                line, at = _joined(words)
                starts = candidates(body, words, line, positions)
                if not len(starts):
                    continue
                ends = at[starts + window] - 1
                raw = b"".join([xxhash.xxh3_128_digest(line[a:b]) for a, b in zip(at[starts].tolist(), ends.tolist())])
                both = np.frombuffer(raw, "<i8").reshape(-1, 2)
                out.append(pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.full(len(starts), key)), pa.array(np.full(len(starts), h)), pa.array(starts.astype(np.int32))], names))
                size += len(starts)
                if size > 1 << 16:
                    yield from out
                    out, size = [], 0
        yield from out

    windows = meet.select("doc_id", "text", "h", "body", "shared").mapInArrow(hash_windows, "high long, low long, doc_id long, h long, pos int")
    least = windows.groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("high", "low", "least")
    gone = windows.join(least, ["high", "low"]).where("doc_id > least").groupBy("doc_id", "h").agg(F.collect_set("pos").alias("starts"))
    gone = written(gone, "windows")

    def strip(batches):
        names = ["doc_id", "whole", "cut", "n_removed", "kept_sha256", "kept"]
        for batch in batches:
            out = []
            for key, text, starts in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "starts")]):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, np.asarray(starts) + window, -1)
                kept = np.cumsum(edge[:-1]) == 0
                line = b" ".join(w for w, k in zip(words, kept.tolist()) if k)
                out.append((key, hashlib.sha256(b" ".join(words)).digest(), True, int(len(words) - kept.sum()), hashlib.sha256(line).hexdigest(), line.decode() if with_text else None))
            kinds = [pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    changed = texts.join(gone, ["doc_id", "h"]).select("doc_id", "text", "starts").mapInArrow(strip, "doc_id long, whole binary, cut boolean, n_removed long, kept_sha256 string, kept string")
    changed = changed.dropDuplicates(["doc_id", "whole"]).withColumnsRenamed({"doc_id": "__id", "whole": "__whole"})
    done = first.join(changed, (F.col("doc_id") == F.col("__id")) & (F.col("whole") == F.col("__whole")), "left")
    none = hashlib.sha256(b"").hexdigest()
    cut = F.coalesce("cut", F.lit(False))
    out = done.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).when(cut, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(none)).when(cut, F.col("kept_sha256")).otherwise(F.lower(F.hex("whole"))).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).when(cut, F.col("kept")).alias("kept"), "whole",
    )
    if not with_text:
        return out.drop("kept", "whole")
    own = docs.select("doc_id", "text").distinct().mapInArrow(_plain, "doc_id long, whole binary, plain string").dropDuplicates(["doc_id", "whole"]).withColumnsRenamed({"doc_id": "__id", "whole": "__whole"})
    full = out.join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("whole") == F.col("__whole")))
    return full.withColumn("kept", F.coalesce("kept", "plain")).drop("plain", "whole", "__id", "__whole")


def _plain(batches):
    """The words of each text joined by one space, and their SHA-256."""
    for batch in batches:
        lines = [b" ".join(words_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([hashlib.sha256(x).digest() for x in lines], pa.binary()), pa.array([x.decode() for x in lines], pa.string())], ["doc_id", "whole", "plain"])

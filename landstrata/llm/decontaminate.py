"""Benchmark decontamination by a distributed positional inverted index.

The index is split by document: a segment holds the postings of some whole documents, as one row of a Parquet folder.
Searching sends the test phrases to the segments. In each, the lists of a phrase's terms are shifted by their place
in the phrase and intersected, from the rarest term of the whole corpus on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from landstrata.llm.common import scratch, written

#: Characters of test items searched for at a time; more items are searched in further blocks.
BLOCK_CHARS = 1 << 22
#: Words of a segment, but for a longer document.
SEGMENT_WORDS = 1 << 19
INDEX = "doc_ids array<long>, hashes array<long>, ends array<long>, terms array<binary>, counts array<long>, positions binary"
# Digits, a-z and what is not ASCII stand for themselves, A-Z for a-z, all else for a space.
_FOLD = bytes(c if c > 127 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lowered."""
    return text.encode().translate(_FOLD).split() if text else []


def _row_hash():
    return F.xxhash64("text")


def write_index(docs: DataFrame, terms: set[bytes] | None = None, path: str | None = None, segment_words: int = SEGMENT_WORDS) -> str:
    """Write the postings of whole texts; gives the folder. ``terms`` keeps the postings of these terms alone.

    A row: the documents' ids and text hashes, the place after each one's last word (words of a segment are numbered
    through, with one number left out after each document, so that no phrase runs over), the terms, how many postings
    each has, and all postings one term after another as u32. Null and empty texts have no words.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "postings")
    wanted = spark.sparkContext.broadcast(None if terms is None else {t: i for i, t in enumerate(sorted(terms))})

    def build(batches):
        known = wanted.value
        schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("positions", pa.binary())])
        ids, hashes, ends, places, codes, at = [], [], [], [], [], 0
        own: dict[bytes, int] = {}

        def close():
            names = list(own if known is None else known)
            place = np.concatenate([np.empty(0, np.int64), *places])
            term = np.concatenate([np.empty(0, np.int64), *codes])
            counts = np.bincount(term, minlength=len(names))
            there = np.flatnonzero(counts)
            row = {"doc_ids": [ids], "hashes": [hashes], "ends": [ends], "terms": [[names[i] for i in there]], "counts": [counts[there].tolist()], "positions": [place[np.argsort(term, kind="stable")].astype("<u4").tobytes()]}
            return pa.RecordBatch.from_pydict(row, schema)

        for batch in batches:
            for key, text, h in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "h")]):
                words = words_of(text)
                if known is None:
                    code = np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, len(words))
                    where = np.arange(len(words))
                else:
                    get = known.get
                    code = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                    where = np.flatnonzero(code >= 0)
                    code = code[where]
                places.append(where + at)
                codes.append(code)
                ids.append(key)
                hashes.append(h)
                at += len(words)
                ends.append(at)
                at += 1
                if at >= segment_words:
                    yield close()
                    ids, hashes, ends, places, codes, at, own = [], [], [], [], [], 0, {}
        if ids:
            yield close()

    docs.select("doc_id", "text", _row_hash().alias("h")).mapInArrow(build, INDEX).write.option("maxRecordsPerFile", 64).parquet(path)
    return path


def indexed_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, h, n_words`` of every row of the documents."""
    rows = spark.read.schema(INDEX).parquet(path).select(F.posexplode(F.arrays_zip("doc_ids", "hashes", "ends")).alias("at", "d"), "ends")
    before = F.when(F.col("at") == 0, F.lit(0)).otherwise(F.get("ends", F.col("at") - 1) + 1)
    return rows.select(F.col("d.doc_ids").alias("doc_id"), F.col("d.hashes").alias("h"), (F.col("d.ends") - before).alias("n_words"))


def _term_counts(spark: SparkSession, path: str, terms: set[bytes]) -> dict[bytes, int]:
    """Postings of each test term over all segments; as many rows as there are test terms in this block."""
    index = spark.read.schema(INDEX).parquet(path)
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts").alias("n"))
    test = spark.createDataFrame([(bytearray(t),) for t in sorted(terms)], "terms binary")
    return {bytes(r["terms"]): r["n"] for r in pairs.join(test, "terms", "left_semi").collect()}


def phrases(items: list[tuple], length: int) -> list[tuple[object, tuple[bytes, ...]]]:
    """(item, words) of every window of ``length`` words; an item of fewer words, but not none, is one."""
    out = []
    for key, words in items:
        for i in range(max(1, len(words) - length + 1) if words else 0):
            out.append((key, tuple(words[i:i + length])))
    return out


def intersect(lists, counts: dict[bytes, int], phrase: tuple[bytes, ...]) -> np.ndarray:
    """Where a phrase starts: its terms' posting lists, shifted by their place, intersected from the rarest term on."""
    starts = None
    for i in sorted(range(len(phrase)), key=lambda i: (counts.get(phrase[i], 0), i)):
        own = lists(phrase[i])
        if own is None:
            return np.empty(0, np.int64)
        if starts is None:
            starts = own[own >= i] - i
        else:
            at = np.searchsorted(own, starts + i)
            at[at == len(own)] = 0
            starts = starts[own[at] == starts + i]
        if not len(starts):
            break
    return starts


def near(lists, counts: dict[bytes, int], phrase: tuple[bytes, ...], slop: int) -> np.ndarray:
    """Places of the rarest term around which, within ``len(phrase) - 1 + slop`` words, every term of the phrase stands."""
    reach, order = len(phrase) - 1 + slop, sorted(set(phrase), key=lambda t: (counts.get(t, 0), t))
    places = lists(order[0])
    for t in order[1:]:
        own = lists(t)
        if places is None or own is None:
            return np.empty(0, np.int64)
        lo, hi = np.searchsorted(own, places - reach), np.searchsorted(own, places + reach, "right")
        places = places[lo < hi]
    return np.empty(0, np.int64) if places is None else places


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(spark: SparkSession, path: str, items: list[tuple], length: int = 10, slop: int | None = None) -> DataFrame:
    """Where test items occur: ``doc_id, h, item_id, kind, first, last`` (words, ``last`` not included).

    ``items`` are (item_id as text, words); the caller bounds the block. Occurrences of an item's windows that overlap
    or touch are one row. ``kind`` is ``phrase``; with ``slop`` there are also ``proximity`` rows: places of the
    rarest word around which all words of a window stand in any order, at most ``slop`` words further than in it.
    """
    of: dict[tuple, list] = {}
    for key, p in phrases(items, length):
        of.setdefault(p, []).append(key)
    counts = _term_counts(spark, path, {w for p in of for w in p})
    shared = spark.sparkContext.broadcast((of, counts))

    def run(batches):
        of, rarity = shared.value
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = ["doc_id", "h", "item_id", "kind", "first", "last"]
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.array(row["ends"], np.int64)
                places = np.frombuffer(row["positions"], "<u4").astype(np.int64)
                bound = np.concatenate([[0], np.cumsum(np.array(row["counts"], np.int64))])
                spot = {bytes(t): i for i, t in enumerate(row["terms"])}

                def lists(t):
                    i = spot.get(t)
                    return None if i is None else places[bound[i]:bound[i + 1]]

                spans: dict[tuple, list] = {}
                for p, keys in of.items():
                    hits = [("phrase", intersect(lists, rarity, p), len(p))]
                    if slop is not None:
                        hits.append(("proximity", near(lists, rarity, p, slop), 1))
                    for kind, starts, n in hits:
                        for d, s in zip(np.searchsorted(ends, starts, "right").tolist(), starts.tolist()):
                            for key in keys:
                                spans.setdefault((d, key, kind), []).append((s, s + n))
                out = []
                for (d, key, kind), found in spans.items():
                    base = int(ends[d - 1]) + 1 if d else 0
                    out += [(row["doc_ids"][d], row["hashes"][d], key, kind, a - base, b - base) for a, b in _merged(found)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    index = spark.read.schema(INDEX).parquet(path)
    return index.mapInArrow(run, "doc_id long, h long, item_id string, kind string, first long, last long")


def item_blocks(items: DataFrame, chars: int = BLOCK_CHARS):
    """Test items as lists of (item_id as text, words), a bounded block at a time. Null texts have no words."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // chars) or 1
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    for i in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        yield [(r["item_id"], words_of(r["text"])) for r in own.collect()]


def contamination(docs: DataFrame, items: DataFrame, length: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, h, n_words, n_hit, items`` of every row of ``docs``: words inside occurrences, and the items met, sorted.

    ``items`` needs item_id and text. ``h`` is the hash of the text, which tells the rows of a repeated doc_id apart; a
    null doc_id is a document like any other. Documents and items without words are not hit and hit nothing. A null
    item_id is left out of ``items`` but its words are hit.
    """
    spark, first, hits = docs.sparkSession, None, None
    for block in item_blocks(items, block_chars):
        path = write_index(docs, {w for _, words in block for w in words})
        first = first or path
        own = search(spark, path, block, length).drop("kind")
        hits = own if hits is None else hits.union(own)
    hits = written(hits.distinct(), "hits")
    # Words under at least one span: what each adds beyond the furthest end so far.
    by_doc = Window.partitionBy("doc_id", "h").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.coalesce(F.max("last").over(by_doc), F.lit(0)), F.col("first"))
    spans = hits.select("doc_id", "h", "item_id", F.greatest(F.col("last") - reached, F.lit(0)).alias("new"))
    found = spans.groupBy("doc_id", "h").agg(F.sum("new").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items"))
    found = found.withColumnsRenamed({"doc_id": "__id", "h": "__h"})
    rows = indexed_documents(spark, first)
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("h").eqNullSafe(F.col("__h")), "left")
    empty = F.array().cast("array<string>")
    return out.select("doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", empty).alias("items"))


def clean_documents(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no item occurs; see ``contamination``."""
    found = contamination(docs, items, length).where("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    rows = docs.withColumn("__text", _row_hash())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__h"))
    return rows.join(found, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

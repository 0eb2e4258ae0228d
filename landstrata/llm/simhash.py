"""SimHash near-duplicates by a generalised pigeonhole search.

The 64 bits are grouped into partitions of correlated bits. Two fingerprints within ``distance`` bits differ by at most
t_i bits in at least one partition i, for any thresholds with sum(t_i) = distance - partitions + 1; a threshold of -1
leaves a partition out. Dynamic programming picks the thresholds of the least estimated cost. Fingerprints meet in
buckets: each is filed in its partition under every value within half the threshold, so two that differ by t_i bits meet
half-way. Pairs that meet are verified on all 64 bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from landstrata.llm.common import components, cut_lineage, written

BITS = 64
#: Buckets with more fingerprints are not paired up; see crowded_links.
CROWDED = 32
SEED = 42


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each consecutive run of ``sizes`` hashes: a bit is 1 if set in over half of the run."""
    counts = np.zeros((len(sizes), BITS), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    step = 1 << 17  # bounds what a very long text unfolds to
    for a in range(0, len(hashes), step):
        own = owner[a:a + step]
        bits = np.unpackbits(hashes[a:a + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    ones = counts * 2 > sizes[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``fp`` (the 64 bits as a long) beside the columns ``keep`` (``doc_id`` if not given) of every row.

    Words are what lies between ASCII white space in the text with A-Z lowered; shingles of ``words`` words are hashed
    by XXH64, repeats included. A shorter text is one shingle of all its words; no words, or null, give zero.
    """
    keep = keep or ["doc_id"]

    def run(batches):
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            texts, hashes, sizes, out = batch.column("text").to_pylist(), [], [], []

            def close():
                run = np.array(sizes, np.int64)
                out.append(majority_bits(np.concatenate([np.empty(0, np.uint64), *hashes]), run))
                hashes.clear(), sizes.clear()

            held = 0
            for t in texts:
                w = t.encode().lower().split() if t else []
                if len(w) > words:
                    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)]))
                    hashes.append(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(w) - words + 1))
                elif w:
                    hashes.append(np.array([digest(b" ".join(w), SEED)], np.uint64))
                sizes.append(max(1, len(w) - words + 1) if w else 0)
                held += sizes[-1]
                if held > 1 << 18:
                    close()
                    held = 0
            close()
            fp = np.concatenate(out).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(fp)], [*keep, "fp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, fp long")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each two bits are both set (64 x 64), over all of them."""

    def run(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8")
            x = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            both, n = both + x.T @ x, n + len(fp)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n))], ["at", "n"])

    rows = distinct.select("fp").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:  # 4,097 of them
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal size: each grows by the bit that correlates most with what it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for i in range(parts):
        size = len(free) // (parts - i)
        own = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        while len(own) < size:
            rest = [b for b in free if b not in own]
            own.append(max(rest, key=lambda b: (corr[b, own].mean(), -b)))
        free = [b for b in free if b not in own]
        groups.append(sorted(own))
    return groups


def balls(bits: list[int], radius: int) -> list[tuple[int, int]]:
    """(flipped bits as a mask, how many) for every set of at most ``radius`` of the bits."""
    return [(sum(1 << b for b in c), k) for k in range(radius + 1) for c in combinations(bits, k)]


def mismatch_tail(p: np.ndarray, most: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0, 1, .. ``most`` of bits with these shares of ones."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for x in 2 * p * (1 - p):
        dist = dist * (1 - x) + np.concatenate([[0], dist[:-1]]) * x
    return np.cumsum(dist)


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds from -1 on with the given sum and the least summed cost; ``costs[i][t + 1]`` is for threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, picked) in best.items():
            for t, c in enumerate(row, -1):
                if have + t not in step or cost + c < step[have + t][0]:
                    step[have + t] = (cost + c, [*picked, t])
        best = step
    return best[total][1]


def _long(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def plan(distinct: DataFrame, distance: int, parts: int, crowded: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions in use, from counts over all fingerprints.

    The cost of a bucket is its pairs, or for a crowded one the rows that ``crowded_links`` makes of it.
    """
    spread = len(balls(list(range(BITS)), distance - distance // 2)) if distance <= 3 else 2
    n, both = bit_statistics(distinct)
    groups = group_bits(n, both, parts)
    p = np.diag(both) / max(n, 1)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_long(sum(1 << b for b in g)))).alias("key")) for i, g in enumerate(groups)]))
    counts = distinct.select(keys.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    work = F.when(F.col("n") > crowded, F.col("n") * spread).otherwise(F.col("n") * (F.col("n") - 1) / 2)
    met = {r["part"]: r["work"] for r in counts.groupBy("k.part").agg(F.sum(work).alias("work")).collect()}
    costs = []
    for i, g in enumerate(groups):
        most = min(distance, 3)
        tail = mismatch_tail(p[g], most)
        # Pairs that agree in the partition are counted; those that differ a little are estimated from the bits.
        near = [(met.get(i) or 0) + n * n / 2 * (tail[t] - tail[0]) for t in range(most + 1)]
        costs.append([0.0] + [near[t] + n * len(balls(g, t - t // 2)) for t in range(most + 1)])
    return [(g, t) for g, t in zip(groups, allocate(costs, distance - parts + 1)) if t >= 0]


def _within(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _filed(distinct: DataFrame, used: list[tuple[list[int], int]]) -> DataFrame:
    """(fp, part, key): each fingerprint under all values within half the threshold of its own, in each partition."""
    rows = [
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_long(sum(1 << b for b in bits)))).bitwiseXOR(F.lit(_long(flip))).alias("key"))
        for i, (bits, t) in enumerate(used)
        for flip, _ in balls(bits, t - t // 2)
    ]
    return distinct.select("fp", F.explode(F.array(*rows)).alias("k")).select("fp", "k.part", "k.key")


def crowded_links(members: DataFrame, distance: int, far: bool = True) -> DataFrame:
    """Links that join up all fingerprints of crowded buckets, without pairing them.

    Up to distance 3: each is filed under all 64-bit values within half the distance. The near ones under a value are
    within the distance of all that are filed there, so each is linked to the least near one: no link is lost, and the
    rows are a fixed number for each fingerprint. Beyond, each is linked to the least of its bucket; those that are
    too far from it are compared with the whole bucket, or left out if ``far`` is false.
    """
    if distance <= 3:
        near = distance // 2
        rows = [F.struct(F.lit(_long(m)).alias("m"), F.lit(k <= near).alias("near")) for m, k in balls(list(range(BITS)), distance - near)]
        spread = members.select("fp").distinct().select("fp", F.explode(F.array(*rows)).alias("k"))
        spread = spread.select("fp", F.col("fp").bitwiseXOR(F.col("k.m")).alias("z"), "k.near")
        least = spread.groupBy("z").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1 and low is not null")
        return spread.join(least, "z").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    least = members.groupBy("part", "key").agg(F.min("fp").alias("low"))
    known = members.join(least, ["part", "key"])
    star = known.where(_within(F.col("fp"), F.col("low"), distance) & (F.col("fp") != F.col("low"))).select(F.col("fp").alias("a"), F.col("low").alias("b"))
    if not far:
        return star
    distant = known.where(~_within(F.col("fp"), F.col("low"), distance)).select("part", "key", F.col("fp").alias("b"))
    rest = members.withColumnRenamed("fp", "a").join(distant, ["part", "key"]).where(_within(F.col("a"), F.col("b"), distance) & (F.col("a") != F.col("b")))
    return star.union(rest.select("a", "b"))


def links(distinct: DataFrame, distance: int = 2, parts: int = 3, crowded: int = CROWDED, far: bool = True) -> DataFrame:
    """``(a, b)`` fingerprints within ``distance`` bits: every such pair of a bucket that is not crowded, and enough links
    to join up the crowded ones (only those to the least of a bucket if ``far`` is false). ``distinct`` has one row for each fingerprint ``fp`` and is read several times."""
    used = plan(distinct, distance, parts, crowded)
    filed = _filed(distinct, used)
    full = filed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("part", "key")
    full = cut_lineage(full)
    quiet = filed.join(full, ["part", "key"], "left_anti")
    a, b = quiet.withColumnRenamed("fp", "a"), quiet.withColumnRenamed("fp", "b")
    mask = F.lit(0)
    for i, (bits, _) in enumerate(used):
        mask = F.when(F.col("part") == i, F.lit(_long(sum(1 << x for x in bits)))).otherwise(mask)
    differ = F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(mask)
    lowest = differ.bitwiseAND(-differ)
    # Two meet under several values; the half-way one counts.
    middle = F.col("a").bitwiseAND(mask).bitwiseXOR(F.when(F.bit_count(differ) < 2, F.lit(0)).otherwise(lowest))
    pairs = a.join(b, ["part", "key"]).where((F.col("a") < F.col("b")) & _within(F.col("a"), F.col("b"), distance) & (F.col("key") == middle))
    return pairs.select("a", "b").union(crowded_links(filed.join(full, ["part", "key"], "left_semi"), distance, far)).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, parts: int = 3, crowded: int = CROWDED) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; component_id is the smallest doc_id that links reach.

    Rows of one doc_id are rows of their own. A null doc_id is passed over as component_id where there is another.
    """
    prints = cut_lineage(fingerprints(docs, words))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(links(classes.select("fp"), distance, parts, crowded))
    grouped = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    named = grouped.select("fp", "component").join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _hashed(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; fewer words are one shingle."""
    import xxhash

    w = text.encode().lower().split() if text else []
    parts = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) > words else [b" ".join(w)] if w else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64)).view(np.int64)


#: Bits of a shingle set's outline.
OUTLINE = 2048


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(body, id, shingles, size, outline): the distinct hashes of a text's shingles; fewer words are one shingle. The outline, in
    longs, has the bit of each hash modulo ``OUTLINE`` set."""

    def outline(h):
        bits = np.zeros(OUTLINE, bool)
        bits[h & (OUTLINE - 1)] = True
        return np.packbits(bits).view("<i8")

    def run(batches):
        names = ["body", "id", "shingles", "size", "outline"]
        for batch in batches:
            sets = [_hashed(t, words) for t in batch.column("text").to_pylist()]
            longs = pa.list_(pa.int64())
            columns = [pa.array(sets, longs), pa.array([len(h) for h in sets], pa.int32()), pa.array([outline(h) for h in sets], longs)]
            yield pa.RecordBatch.from_arrays([batch.column("body"), batch.column("id"), *columns], names)

    return docs.select("body", "id", "text").mapInArrow(run, "body string, id long, shingles array<long>, size int, outline array<long>")


def _may_share(a: str, b: str, similarity: float) -> Column:
    """Whether two sets can be as similar by their sizes and outlines: a bit that only one has set is a hash, at least, that the other lacks."""
    lacks = lambda x, y: sum(F.bit_count(F.get(f"{x}.outline", F.lit(i)).bitwiseAND(F.bitwise_not(F.get(f"{y}.outline", F.lit(i))))) for i in range(OUTLINE // 64))
    shared = F.least(F.col(f"{a}.size") - lacks(a, b), F.col(f"{b}.size") - lacks(b, a))
    return shared >= similarity * (F.col(f"{a}.size") + F.col(f"{b}.size") - shared)


def _frequent(docs: DataFrame, words: int, one_in: int = 16, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of shingles that several texts of a sample have. It only orders the shingles: any order
    finds all pairs, so what the sample or ``most`` leaves out costs time and loses nothing."""

    def run(batches):
        for batch in batches:
            hashes = [_hashed(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *hashes]))], ["h"])

    some = docs.where(F.pmod("id", F.lit(one_in)) == 0).select("text").mapInArrow(run, "h long")
    found = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = (found.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(h)
    return h[order], n[order]


def _prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(shingle, id, size, at): of each text the shingles that one as similar must share one of, rarest first.

    Of ``size`` shingles in an order common to all texts, the first ``size - similarity * size + 1`` suffice. ``at`` is the
    place in that order. A text without words has one row of size 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, words))

    def run(batches):
        known, count = shared.value
        for batch in batches:
            out = []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                h = _hashed(t, words)
                n = len(h)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, count[at], 0), kind="stable")]
                h = h[:n - int(np.ceil(similarity * n - 1e-9)) + 1] if n else np.zeros(1, np.int64)
                out.append((h, np.full(len(h), i), np.full(len(h), n), np.arange(len(h))))
            columns = [np.concatenate(c) for c in zip(*out)] or [np.empty(0, np.int64)] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], ["shingle", "id", "size", "at"])

    return docs.select("id", "text").mapInArrow(run, "shingle long, id long, size int, at int")


def _meetable(a: str, b: str, similarity: float) -> Column:
    """Whether two rows of one shingle, the first that their texts share, leave room for the similarity."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    room = F.lit(1) + F.least(x - F.col(f"{a}.at"), y - F.col(f"{b}.at")) - 1
    return (F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9) & (room >= similarity * (x + y) / (1 + similarity) - 1e-9)


def _perhaps(rows: DataFrame, ids: DataFrame, words: int = 1 << 19) -> DataFrame:
    """The rows of which the ``id``, a hash, is one of ``ids``, and few others: those whose bit is set in a map of 64 * ``words`` bits.

    Only words with a bit go to the executors, ``words`` rows at most whatever the number of ids, and the rows stay where they are.
    """
    word = F.pmod(F.shiftright("id", 6), F.lit(words)).cast("int")
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    marks = ids.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    found = rows.withColumns({"__at": word, "__own": bit}).join(F.broadcast(marks), F.col("__at") == F.col("__word"))
    return found.where(F.col("__bits").bitwiseAND(F.col("__own")) != 0).drop("__at", "__own", "__word", "__bits")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 2, distance: int = 8, parts: int = 3, crowded: int = CROWDED) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the document of the smallest doc_id stays.

    A link needs a Jaccard similarity of the sets of ``shingle``-word shingles of at least ``similarity``; a group is what
    links reach, and no link is missed that would change a group. Candidates come in two rounds. First texts whose
    fingerprints of ``words``-word shingles are within ``distance`` bits (in crowded buckets each with the least fingerprint
    only), and texts that share a prefix shingle (see ``_prefixes``), each with the least text that has it. Then of each
    prefix shingle all texts that the first round left in different groups, every one with every other. Rows that repeat
    doc_id and text are one document; a null text counts as an empty one; a null doc_id is larger than all others.
    """
    body = F.md5(F.coalesce("text", F.lit("")))
    named = F.coalesce("doc_id", F.lit(2**63 - 1))
    prints = fingerprints(docs.select(named.alias("key"), body.alias("body"), "text"), words, ["key", "body"])
    bodies = cut_lineage(prints.groupBy("body").agg(F.min("key").alias("low"), F.min("fp").alias("fp")).withColumn("id", F.xxhash64("body")))
    heads = bodies.groupBy("fp").agg(F.min(F.struct("low", "body")).alias("head")).select("fp", "head.body")
    near = links(cut_lineage(bodies.select("fp").distinct()), distance, parts, crowded, far=False)
    a, b = (heads.select(F.col("fp").alias(x), F.col("body").alias(f"body_{x}")) for x in "ab")
    across = near.join(a, "a").join(b, "b").select("body_a", "body_b")
    within = bodies.join(heads.select("fp", F.col("body").alias("body_b")), "fp").where("body <> body_b").select(F.col("body").alias("body_a"), "body_b")

    def named_pairs(pairs: DataFrame) -> DataFrame:
        """Bodies for ids. Two bodies of one id would both be tested."""
        a, b = (bodies.select(F.col("id").alias(f"id_{x}"), F.col("body").alias(f"body_{x}")) for x in "ab")
        return pairs.join(a, "id_a").join(b, "id_b").select("body_a", "body_b")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs.select(F.least("body_a", "body_b").alias("body_a"), F.greatest("body_a", "body_b").alias("body_b")).distinct())
        met = pairs.select(F.col("body_a").alias("body")).union(pairs.select(F.col("body_b").alias("body"))).distinct()
        spots = cut_lineage(bodies.join(met, "body").select("id", F.col("low").alias("key"), F.col("body").alias("found")))
        # Most texts meet no other and are left out where they are read, so they are not shuffled.
        read = _perhaps(docs.select(named.alias("key"), body.alias("body"), "text").withColumn("id", F.xxhash64("body")), spots)
        texts = read.join(spots.drop("id"), "key").where("body = found").dropDuplicates(["body"])
        sets = written(_shingle_sets(texts, shingle), "shingle-sets", compression="zstd")
        # Most pairs are told apart by their outlines; only the sets of the others meet.
        x, y = (sets.select(F.col("body").alias(f"body_{c}"), F.struct("size", "outline").alias(c)) for c in "xy")
        both = pairs.join(x, pairs["body_a"] == x["body_x"]).join(y, pairs["body_b"] == y["body_y"]).where(_may_share("x", "y", similarity))
        pairs = cut_lineage(both.select("body_a", "body_b"))
        left = _perhaps(sets, pairs.select(F.explode(F.array("body_a", "body_b")).alias("body")).select(F.xxhash64("body").alias("id")))
        x, y = (left.select(F.col("body").alias(f"body_{c}"), F.col("shingles").alias(c)) for c in "xy")
        both = pairs.join(x, pairs["body_a"] == x["body_x"]).join(y, pairs["body_b"] == y["body_y"])
        shared = F.size(F.array_intersect("x", "y"))
        return cut_lineage(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select(F.col("body_a").alias("a"), F.col("body_b").alias("b")))

    # Copies of a text give the same rows; they are made one where the rows of a shingle are.
    rows = _prefixes(docs.select(F.xxhash64(body).alias("id"), "text"), shingle, similarity).repartition("shingle").distinct()
    least = rows.groupBy("shingle").agg(F.min(F.struct("id", "size", "at")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Plain columns in compressed files: the largest table here by far. Most prefix shingles are of one text and end here.
    head = [F.col(f"head.{c}").alias(f"head_{c}") for c in ("id", "size", "at")]
    shared = written(rows.join(least, "shingle").select("shingle", "id", "size", "at", *head), "prefix-rows", compression="zstd")
    own, other = F.struct("id", "size", "at").alias("own"), F.struct(F.col("head_id").alias("id"), F.col("head_size").alias("size"), F.col("head_at").alias("at")).alias("head")
    star = shared.where("id <> head_id").select(own, other).where(_meetable("own", "head", similarity)).select(F.col("own.id").alias("id_a"), F.col("head.id").alias("id_b")).distinct()
    alike = verified(across.union(within).union(named_pairs(star)))
    joined = cut_lineage(components(alike))

    groups = bodies.join(joined.withColumnRenamed("node", "body"), "body").select(F.col("id").alias("__id"), F.xxhash64("component").alias("group"))
    placed = shared.where("id <> head_id").select("shingle", "id", "size", "at").join(groups, F.col("id") == F.col("__id"), "left")
    placed = placed.select("shingle", "id", "size", "at", F.coalesce("group", "id").alias("group"))
    mixed = placed.groupBy("shingle").agg(F.min("group").alias("g"), F.max("group").alias("h"), F.count(F.lit(1)).alias("n"))
    mixed = mixed.where("g <> h").select("shingle", F.ceil(F.col("n") / 1000).cast("int").alias("salts"))
    rest = written(placed.join(mixed, "shingle"), "prefix-mixed", compression="zstd")
    row = F.struct("id", "size", "at")
    x = rest.select("shingle", F.pmod("id", F.col("salts")).cast("int").alias("salt"), row.alias("x"), F.col("group").alias("group_x"))
    y = rest.select("shingle", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), row.alias("y"), F.col("group").alias("group_y"))
    cross = x.join(y, ["shingle", "salt"]).where((F.col("group_x") != F.col("group_y")) & (F.col("x.id") < F.col("y.id")) & _meetable("x", "y", similarity))
    late = verified(named_pairs(cross.select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b")).distinct()))

    groups = bodies.join(components(alike.union(late)).withColumnRenamed("node", "body"), "body", "left").withColumn("component", F.coalesce("component", "body"))
    stay = groups.groupBy("component").agg(F.min(F.struct("low", "body")).alias("kept")).select(F.col("kept.low").alias("__key"), F.col("kept.body").alias("__kept"))
    rows = docs.withColumns({"__k": named, "__body": body})
    out = rows.join(stay, (F.col("__k") == F.col("__key")) & (F.col("__body") == F.col("__kept")))
    return out.dropDuplicates(["__k", "__body"]).select(*[F.col(f"`{c}`") for c in docs.columns])

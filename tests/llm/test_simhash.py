import random

import numpy as np
import pytest
import xxhash

from landstrata.llm import simhash


def brute(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(rows, distance):
    """(doc_id, fingerprint) to component by plain comparison."""
    low = list(range(len(rows)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                low[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), k) if x is not None), default=None)
    return sorted(((k, f, least[find(i)]) for i, (k, f) in enumerate(rows)), key=str)


def test_documents_against_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from every hunter in the old forest".split()
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "one two", "ONE two", "É é", "a b c d", " ".join(base * 900)]
    texts += [" ".join(base[:i] + [rng.choice(base)] + base[i:]) for i in range(12)] * 2 + ["a b c d"] * 5
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "a b c d", None, None), (3, "again", None, None), (3, "one", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = simhash.near_duplicates(df).collect()
    want = groups([(r[0], brute(r[1])) for r in rows], 2)
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got), key=str) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("distance,parts,crowded", [(2, 3, 32), (2, 3, 2), (2, 2, 4), (3, 3, 3), (3, 4, 100), (8, 3, 32), (8, 3, 3), (5, 2, 2)])
def test_links_join_what_brute_force_joins(spark, distance, parts, crowded):
    from pyspark.sql import functions as F

    from landstrata.llm.common import components, cut_lineage

    rng = random.Random(distance * 100 + parts)
    prints = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(6):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, distance + 1)))
            prints.add(x)
    prints |= {1 << b for b in range(40)} | {0, 2**64 - 1}
    rows = [(x - 2**64 if x >> 63 else x,) for x in prints]
    df = cut_lineage(spark.createDataFrame(rows, "fp long"))
    found = simhash.links(df, distance, parts, crowded)
    pairs = found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > distance)
    assert pairs.count() == 0
    comp = {r["node"] % 2**64: r["component"] for r in components(found).collect()}
    mine = {}
    for x in prints:
        mine.setdefault(comp.get(x, x), set()).add(x)
    theirs = {}
    for k, _, c in groups([(x, x) for x in prints], distance):
        theirs.setdefault(c, set()).add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_thresholds_are_the_cheapest():
    from itertools import product

    rng = np.random.default_rng(1)
    costs = [np.sort(rng.random(5)).tolist() for _ in range(4)]
    best = min((sum(c[t + 1] for c, t in zip(costs, ts)), ts) for ts in product(range(-1, 4), repeat=4) if sum(ts) == 2)
    assert tuple(simhash.allocate(costs, 2)) == best[1]


def jaccard(a, b, n=5):
    a, b = ({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_template_family_whose_least_text_is_far(spark):
    """Each member is at 0.6 to 0.75 to the least text, and at 0.9 to one other member."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(300)]
    texts = []
    for i in range(50):
        own = [*base[:20 + 3 * i], *[word() for _ in range(50)], *base[70 + 3 * i:]]
        texts += [own, [*own[:-12], *[word() for _ in range(12)]]]
    assert all(0.6 < jaccard(base, t) < 0.76 for t in texts) and all(jaccard(texts[i], texts[i + 1]) > 0.88 for i in range(0, 100, 2))
    rows = [(0, " ".join(base)), *[(i + 1, " ".join(t)) for i, t in enumerate(texts)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for crowded in (32, 2):
        kept = {r["doc_id"] for r in simhash.one_of_each(df, crowded=crowded).collect()}
        assert kept == {0, *range(1, 101, 2)}


def test_block_and_append_edits_are_found(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, kinds = [], {}
    for i in range(240):
        n = rng.choice([100, 300])
        text, cut = [word() for _ in range(n)], rng.randrange(n // 40, n // 9)
        at = rng.randrange(n - cut)
        changed = [*text[:at], *[word() for _ in range(cut)], *text[at + cut:]] if i % 3 == 0 else [*text, *[word() for _ in range(cut)]] if i % 3 == 1 else list(text)
        if i % 3 == 2:
            for j in rng.sample(range(n), max(1, cut // 5)):
                changed[j] = word()
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(changed))]
        kinds[2 * i + 1] = jaccard(text, changed)
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * i for i in range(240)} | {k for k, j in kinds.items() if j < 0.8}


def test_outlines_and_bit_maps_lose_nothing(spark):
    """Pairs at 0.8 or more pass by their outlines and unrelated ones do not; every sought id passes the bit map and few others do."""
    from pyspark.sql import functions as F

    rng = random.Random(10)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = [[word() for _ in range(n)] for n in (1, 5, 40, 300, 1200)]
    texts += [[*t[:i], word(), *t[i + 1:]] for t in texts for i in (0, len(t) // 2)] + [[]]
    rows = [(f"b{i}", i, " ".join(t)) for i, t in enumerate(texts)]
    sets = simhash._shingle_sets(spark.createDataFrame(rows, "body string, id long, text string"), 5)
    x, y = (sets.select(F.struct("*").alias(c)) for c in "xy")
    shared = F.size(F.array_intersect("x.shingles", "y.shingles"))
    near = shared >= 0.8 * (F.col("x.size") + F.col("y.size") - shared)
    got = x.crossJoin(y).select(near.alias("near"), simhash._may_share("x", "y", 0.8).alias("may"), F.col("x.id").alias("a"), F.col("y.id").alias("b")).collect()
    assert all(r["may"] for r in got if r["near"]) and sum(r["near"] for r in got) > len(rows)
    assert not any(r["may"] for r in got if {r["a"], r["b"]} == {3, 4})
    ids = spark.range(20_000).select(F.xxhash64("id").alias("id"))
    some = ids.where("id % 50 = 0")
    passed = simhash._perhaps(ids, some)
    assert some.exceptAll(passed).count() == 0 and passed.count() < 1.2 * some.count()

import hashlib
import random
import re

import pytest

from landstrata.llm import decontaminate, substring_dedup
from landstrata.llm.queries import QUERIES

WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, h string, whole string").repartition(3)


def passages(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ij") * rng.randint(0, 2)
    parts = [" ".join(word() for _ in range(rng.randint(30, 90))) for _ in range(6)]
    rows = []
    for i in range(n):
        own = [" ".join(word() for _ in range(rng.randint(0, 70)))]
        rows.append((i, rng.choice(["  ", "\n"]).join(own + rng.sample(parts, rng.randint(0, 2)) + own), "x", "y"))
    rows += [(n + i, rows[i][1], None, None) for i in range(9)]
    rows += [(n + 20, None, "", ""), (n + 21, "", "", ""), (None, parts[0], "", ""), (4, rows[4][1], "", ""), (4, parts[1] + " " + parts[2], "", ""), (n + 30, parts[3] * 40, "", "")]
    return rows


def stripped(rows, window):
    first = {}
    cut = [(k, WHITE.findall(t or "")) for k, t, *_ in rows]
    for k, w in cut:
        for i in range(len(w) - window + 1):
            if k is not None:
                p = tuple(w[i:i + window])
                first[p] = min(first.get(p, k), k)
    out = []
    for k, w in cut:
        gone = set()
        for i in range(len(w) - window + 1):
            if k is not None and first[tuple(w[i:i + window])] < k:
                gone.update(range(i, i + window))
        line = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(line.encode()).hexdigest(), line))
    return sorted(out, key=str)


def test_cover():
    assert substring_dedup.is_cover(substring_dedup.PERIOD, substring_dedup.COVER)
    assert not substring_dedup.is_cover(31, (1, 5, 11, 24, 25))


@pytest.mark.parametrize("window", [50, 33])
def test_repeats_against_brute_force(spark, window):
    rows = passages(window)
    df = frame(spark, rows)
    got = sorted(map(tuple, substring_dedup.remove_repeats(df, window, with_text=True).collect()), key=str)
    assert got == stripped(rows, window)
    assert sorted(map(tuple, substring_dedup.remove_repeats(df, window).collect()), key=str) == [r[:4] for r in stripped(rows, window)]
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_repeats_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op2_substring_dedup"](spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == [r[:4] for r in stripped(rows, 50)]


FOLD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return FOLD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(rows, items, length):
    wins = [(str(k), tuple(w[i:i + length])) for k, t in items for w in [folded(t)] if w for i in range(max(1, len(w) - length + 1))]
    out = []
    for k, t, *_ in rows:
        w = folded(t)
        hit, met = set(), set()
        for key, p in wins:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i:i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    met.add(key)
        out.append((k, len(w), len(hit), sorted(met)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chars", [1 << 22, 200])
def test_contamination_against_brute_force(spark, chars):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(["a", "B", "c", "d1", "É", "the", "x-y"]) for _ in range(n))
    items = [(i, text(rng.randint(1, 16))) for i in range(14)] + [(20, None), (21, ""), (22, "..."), (3, "the the"), (10, "ünder É")]
    rows = []
    for i in range(40):
        mid = rng.choice(items)[1] or ""
        rows.append((i, f"{text(rng.randint(0, 12))}. {mid.upper()}\n{text(rng.randint(0, 5))}", "", ""))
    rows += [(None, rows[0][1], "", ""), (50, None, "", ""), (51, "", "", ""), (0, rows[0][1], "", ""), (0, rows[1][1], "", ""), (52, text(9000), "", "")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, rows), tests, 10, chars)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()), key=str) == contaminated(rows, items, 10)
    assert decontaminate.contamination(frame(spark, []), tests).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(frame(spark, rows), tests.limit(0)).collect()} == {0}


def test_full_index_phrases_and_proximity(spark):
    rows = [(1, "one two three four five", "", ""), (2, "three big two words one", "", ""), (3, "one six six six six two three", "", ""), (4, "three", "", "")]
    path = decontaminate.write_index(frame(spark, rows), segment_words=4)
    found = decontaminate.search(spark, path, [("i", [b"one", b"two", b"three"])], 3, slop=3).collect()
    assert {(r["doc_id"], r["first"], r["last"]) for r in found if r["kind"] == "phrase"} == {(1, 0, 3)}
    assert {r["doc_id"] for r in found if r["kind"] == "proximity"} == {1, 2}

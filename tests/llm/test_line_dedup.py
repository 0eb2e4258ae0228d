import random

import pytest
from pyspark.sql import functions as F

from landstrata.llm import line_dedup


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def change(rng, s, n, letters="abü€😀 "):
    for _ in range(n):
        i = rng.randint(0, len(s))
        kind = rng.randint(0, 2)
        s = s[:i] + rng.choice(letters) + s[i:] if kind == 0 else s[:max(0, i - 1)] + (rng.choice(letters) if kind == 1 else "") + s[i:]
    return s


@pytest.mark.parametrize("edits", [1, 2, 3, 5])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    pairs = [("", ""), ("", "a"), ("a", ""), ("x" * 300, "x" * 299 + "y")]
    for _ in range(400):
        a = "".join(rng.choice("abü€😀 ") for _ in range(rng.randint(0, 12)))
        pairs.append((a, change(rng, a, rng.randint(0, edits + 2))))
    pairs = [tuple(sorted(p, key=len)) for p in pairs]
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", line_dedup.banded_distance(F.col("x"), F.col("y"), edits).alias("d")).collect()
    for r in got:
        want = edit(r["x"], r["y"])
        assert (r["d"] == want) if want <= edits else (r["d"] > edits), r


def brute(rows, edits, shortest):
    texts = sorted({(k is None, k or 0, i) for k, t, i in rows if t is not None})
    by = {i: (k, t) for k, t, i in rows}
    order = [(i, n, line) for *_, i in texts for n, line in enumerate(by[i][1].split("\n"))]
    first, gone = [], {}
    for i, n, line in order:
        if len(line) < shortest:
            continue
        if any(line == x for x in first):
            gone.setdefault(i, []).append(n)
            continue
        if any(abs(len(x) - len(line)) <= edits and edit(x, line) <= edits for x in first):
            gone.setdefault(i, []).append(n)
        first.append(line)
    return sorted(((k, len(t.split("\n")), gone.get(i, [])) for k, t, i in rows if t is not None), key=str)


@pytest.mark.parametrize("edits,broadcast", [(2, 1000), (2, 0), (1, 1000), (3, 1000)])
def test_lines_against_brute_force(spark, edits, broadcast):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(4, 40))) for _ in range(14)]
    rows = [(i, "\n".join(change(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(rng.randint(1, 4))), i) for i in range(60)]
    rows += [(100, None, 100), (101, "", 101), (102, "\n\n", 102), (103, "a" * 400, 103), (104, "a" * 399, 104), (None, base[0] + "\n" + base[1], 105)]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t, _ in rows] + [(5, rows[5][1], "x", "y")], "doc_id long, text string, k string, line string").repartition(3)
    got = line_dedup.repeated_lines(df, edits, 8, broadcast).distinct().collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["gone"]) for r in got), key=str) == brute(rows, edits, 8)
    assert line_dedup.repeated_lines(df.limit(0)).count() == 0


def test_letters_are_counted_on_lines_that_meet_only(spark, monkeypatch):
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcdefghijklmnopé ") for _ in range(60)) for _ in range(300)]
    rows = [(i, line) for i, line in enumerate([*lines, lines[7][:-1], "x" + lines[250][2:]])]
    seen, bag = spark.sparkContext.accumulator(0), line_dedup._bag
    counted = F.udf(lambda line: seen.add(1) or 0, "long")
    monkeypatch.setattr(line_dedup, "_bag", lambda line: bag(line).bitwiseOR(counted(line)))
    got = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).where(F.size("gone") > 0).collect()
    assert sorted(r["doc_id"] for r in got) == [300, 301]
    assert 4 <= seen.value < 20


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_meet(spark, edits):
    rng = random.Random(edits + 50)
    base = ["".join(rng.choice("abü€😀 ") for _ in range(rng.randint(8, 30))) for _ in range(40)]
    lines = sorted({x for s in base for x in (s, *[change(rng, s, rng.randint(1, edits)) for _ in range(3)]) if len(x) >= 8})
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    met = {tuple(sorted((r["id_a"], r["id_b"]))) for r in line_dedup.meeting(df, edits, 8).collect()}
    near = {(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines) if i < j and abs(len(a) - len(b)) <= edits and edit(a, b) <= edits}
    assert near and near <= met
    assert {r["id"] for r in line_dedup.meeting_lines(df, edits, 8).collect()} == {i for p in met for i in p}

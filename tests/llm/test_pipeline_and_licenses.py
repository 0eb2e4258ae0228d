import random
import re

import corpus_pipeline
from landstrata.llm import decontaminate, licenses, line_dedup, simhash
from landstrata.llm.queries import ORACLES, QUERIES
from test_passages import folded

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_licenses_against_sql(spark):
    from checks.compare import difference, oracle

    for sf in (SF, "/root/testdata/sf0.01"):
        name = "op4_license_scan"
        assert difference(spark, oracle(sf), name, QUERIES[name], ORACLES[name], sf) is None


def test_license_odd_rows(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, None), (2, ""), (3, "word"), (None, "Released under the MIT licence"), (4, mit.replace(". ", ".\n").replace(", ", "\n,")), (5, mit + " not"), (6, "x " * 90000 + "\nreleased UNDER the mit license!"), (6, "x")]
    df = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, best string")
    got = [(r["doc_id"], r["licences"]) for r in licenses.scan(df).collect()]
    assert sorted(got, key=str) == sorted([(1, []), (2, []), (3, []), (None, []), (4, ["MIT"]), (5, ["MIT"]), (6, ["MIT-notice"]), (6, [])], key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_notices_inside_texts(spark):
    wrap = lambda text: "\n".join(" * " + x for x in re.findall(r".{1,60}(?:\s|$)", text))
    code = "\n".join(f"int f{i}(int a{i}) {{ return a{i} + {i}; }}" for i in range(400))
    names = ["Apache-2.0-header", "GPL-3.0-header", "MPL-2.0-header", "ISC", "MIT"]
    rows = [(i, f"/* Copyright 2020 Someone\n{wrap(licenses.TEMPLATES[k])}\n */\n{code}") for i, k in enumerate(names)]
    rows.append((10, "All pictures on these pages are by the author and licensed under CC BY-NC 4.0, so please ask first before you sell them."))
    rows.append((11, f"{code}\nnothing is licensed here\n{code}"))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(k in got[i]["licences"] and got[i]["score"] == 1.0 for i, k in enumerate(names))
    assert got[10]["licences"] == ["CC-BY-NC-4.0"] and got[10]["n_places"] == 1 and got[11]["licences"] == []


def test_full_licences_alone_and_inside(spark):
    noise = " ".join(f"word{i}" for i in range(3000))
    rows = [(i, k, t) for i, (k, t) in enumerate(licenses.FULL_TEXTS.items())]
    rows += [(100 + i, k, f"{noise}\n{t}\n{noise}") for i, k, t in rows]
    assert {k for _, k, _ in rows} >= {"MIT-text", "BSD-3-Clause-text", "Apache-2.0-text", "GPL-3-text", "LGPL-3-text", "MPL-2.0-text"}
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")).collect()}
    assert all(k in got[i] for i, k, _ in rows)


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_one_of_each(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(30)]
    rows = []
    for i in range(200):
        w = list(rng.choice(base[:6] if i % 2 else base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += [(300, None, "en", "s", 0), (301, "", None, None, None), (302, "a", "en", "s", 1), (303, "a b", "en", "s", 1), (302, "a", "en", "s", 1), (None, "a", "en", "s", 1), (5, "other words", "en", "s", 1), (304, "z " * 50000, "en", "s", 1)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    for crowded in (32, 3):
        kept = simhash.one_of_each(df, crowded=crowded).collect()
        sets = [shingles(r["text"]) for r in kept]
        left = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and similar(sets[i], sets[j])]
        assert not left
        assert {r["doc_id"] for r in kept} >= {302, 303, 304, 5}
        for r in rows:  # what went is linked to something
            if all((r[0], r[1]) != (k["doc_id"], k["text"]) for k in kept) and r[1]:
                assert any(similar(shingles(r[1]), shingles(o[1])) for o in rows if o is not r)
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "12 34", "en", "s", 5), (9004, "a", "en", "s", 1)], COLUMNS)
    docs = docs.unionByName(extra)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before = texts(docs)
    spoken = corpus_pipeline.language_id(spark, docs, SF)
    assert spoken.columns == docs.columns and set(texts(spoken)) == set(before) - {9001, 9002, 9003}

    lines = corpus_pipeline.dedup_lines(spark, spoken, SF)
    got, seen, want = texts(lines), set(), {}
    assert lines.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in lines.collect() if r["text"] != before[r["doc_id"]])
    gone = {r["doc_id"]: r["gone"] for r in line_dedup.repeated_lines(spoken).collect()}
    for k in sorted(gone):
        kept = [x for i, x in enumerate(before[k].split("\n")) if i not in gone[k]]
        for i, x in enumerate(before[k].split("\n")):
            assert not (len(x) >= 20 and x in seen and i not in gone[k])
            seen.add(x)
        if kept:
            want[k] = "\n".join(kept)
    assert got == want

    single = corpus_pipeline.dedup_documents(spark, lines, SF)
    left = texts(single)
    sets = {k: shingles(t) for k, t in left.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and similar(sets[a], sets[b])]
    assert single.columns == docs.columns and not pairs
    assert all(any(similar(shingles(got[k]), shingles(t)) for o, t in got.items() if o < k) for k in set(got) - set(left))

    clean = corpus_pipeline.remove_contaminated(spark, single, SF)
    items = [folded(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i:i + 10]) for w in items for i in range(len(w) - 9)}
    bad = {k for k, t in left.items() for w in [folded(t)] if any(tuple(w[i:i + 10]) in grams for i in range(len(w) - 9))}
    assert clean.columns == docs.columns and set(texts(clean)) == set(left) - bad

    packed = corpus_pipeline.pack(spark, clean, SF).collect()
    assert {r["doc_id"] for r in packed} == set(left) - bad


def test_run_and_empty(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_clean_documents_with_odd_columns(spark):
    docs = spark.createDataFrame([(1, "one two three", "x"), (2, None, "y"), (None, "one two three", "z"), (3, "four", "w")], "doc_id long, text string, h string")
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.clean_documents(docs, items).collect()) == [2, 3]

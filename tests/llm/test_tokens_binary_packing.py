import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from landstrata.llm import binary, packing
from landstrata.llm.queries import tokenizer
from landstrata.llm.tokens import Encoder

ODD = [None, "", " ", "a", " a  b ", "tab\t and \n\n new  lines \n", "x" * 5000, "<|endoftext|> y", "ñé ü　wide   gap", "don't we'll", "a" + " b" * 9000]


ENCODER = Encoder(tokenizer())


def plain(text):
    return ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(deadline=None, max_examples=600)
@given(st.lists(st.text(alphabet=" \t\n\x1c ab'sñ1.", max_size=40), max_size=8))
def test_pieces_encode_as_the_whole(texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in ENCODER.encode(texts)] == [plain(t) for t in texts]


def test_odd_texts_encode_as_the_whole():
    assert [np.frombuffer(b, "<u4").tolist() for b in ENCODER.encode(ODD)] == [plain(t) for t in ODD]


def test_pieces_over_newlines_are_not_known_by_the_pair():
    encoder, words = Encoder(tokenizer()), [f"word{chr(97 + i)}" for i in range(26)]
    texts = [f"so {a}.\n{b}, and" for a in words for b in words]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [plain(t) for t in texts]
    assert len(encoder.later) < 5 * len(words)


def test_a_worker_that_forgets_gives_the_same():
    encoder = Encoder(tokenizer(), remembered=3)
    for _ in range(3):
        assert [np.frombuffer(encoder.encode([t])[0], "<u4").tolist() for t in ODD] == [plain(t) for t in ODD]


@settings(deadline=None, max_examples=80)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.integers(1, 100))
def test_segment_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    data = binary.encode_segment(ids, percentile)
    assert binary.decode_segment(data).tolist() == ids.tolist()
    for a, b in ((0, 1), (len(ids) // 3, len(ids) // 2), (127, 129), (len(ids), len(ids) + 5)):
        assert binary.decode_segment(data, a, b).tolist() == ids[a:b].tolist()


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, part string, ids string").repartition(3)


def test_binary_odd_rows(spark):
    rows = [(i, t, "p", "q") for i, t in enumerate(ODD)] + [(None, "null id", None, None), (3, "a", "p", "q"), (3, "again", None, None), (3, "a", "p", "q")]
    path = binary.write_tokens(frame(spark, rows), tokenizer(), 2, segment_ids=3000)
    got = sorted(map(tuple, binary.read_tokens(spark, path).collect()), key=lambda r: r[1])
    at, left = 0, [(i, zlib.crc32(np.array([*plain(t), 2], "<u4").tobytes())) for i, t, *_ in rows]
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    for key, start, n, crc in got:
        assert start == at and (key, crc) in left
        left.remove((key, crc))
        at += n
    assert binary.read_tokens(spark, binary.write_tokens(frame(spark, []), tokenizer(), 2)).count() == 0


def best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        room = [b for b in bins if b[0] >= x]
        if room:
            min(room, key=lambda b: b[0])[0] -= x
        else:
            bins.append([capacity - x])
    return sorted(b[0] for b in bins)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    counts = {x: lengths.count(x) for x in lengths}
    room, filled = {}, {}
    for length, rank, count, first, offset in packing.plan_bins(counts, capacity):
        for i in range(count):
            filled.setdefault(first + i, []).append((offset, length))
    for b, pieces in filled.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        room[b] = capacity - at
    assert sum(map(len, filled.values())) == len(lengths)
    assert sorted(room.values()) == best_fit(lengths, capacity)


def test_packing_odd_rows(spark):
    rows = [(i, t, "p", "q") for i, t in enumerate(ODD)] + [(None, None, None, None)] * 3 + [(5, "a b", "x", "y")] * 40
    got = packing.pack_documents(frame(spark, rows), tokenizer(), 0, 64).collect()
    assert sum(r["length"] for r in got) == sum(len(plain(t)) + 1 for _, t, *_ in rows)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    whole = np.array([*plain(ODD[5]), 0], "<u4")
    first = {r["piece"]: r for r in got if r["doc_id"] == 10}
    assert sorted(first) == list(range(len(first))) and all(first[i]["length"] == 64 for i in first if i)
    assert [r["ids_crc32"] for r in got if r["doc_id"] == 5][0] in {zlib.crc32(whole.tobytes()), zlib.crc32(np.array([*plain("a b"), 0], "<u4").tobytes())}
    assert packing.pack_documents(frame(spark, []), tokenizer()).count() == 0


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_numbers_have_no_gaps(spark, rows):
    from pyspark.sql import functions as F

    from landstrata.llm.common import number_within

    df = spark.createDataFrame([(k, i) for k in (None, "a", "b") for i in range(7)], "k string, i long")
    got = number_within(df, ["k"], [F.col("i")], F.col("i"), "n", rows).collect()
    for k in (None, "a", "b"):
        assert sorted(r["n"] for r in got if r["k"] == k) == list(range(7))

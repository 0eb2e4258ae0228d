"""Alignment of two tokenizers against sets of ends."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landstrata.llm import alignment as al, queries
from tests.conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """The contract word by word: ``{doc_id: (all columns, groups' text)}`` for unique doc_ids."""
    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown}
    letters.update({chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in shown)})
    groups, holders = {}, defaultdict(set)
    for doc, text in rows:
        groups[doc] = []
        if not text:
            continue
        raw = (" " + text).encode()
        a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
        la = [bytes(letters[c] for c in ta.id_to_token(i)) for i in a]
        pieces = [tb.id_to_piece(i) for i in b]
        lb = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        if b"".join(la) != raw or b"".join(lb) != raw:
            continue
        ends = []
        for parts in (la, lb):
            n = 0
            ends.append([n := n + len(p) for p in parts])
        common = sorted(set(ends[0]) & set(ends[1]))
        i = j = 0
        for c in common:
            i2, j2 = ends[0].index(c, i) + 1, ends[1].index(c, j) + 1
            groups[doc].append((a[i:i2], b[j:j2]))
            i, j = i2, j2
    links = {d: [(x, y) for ga, gb in g for x in ga for y in gb] for d, g in groups.items()}
    for d, l in links.items():
        for p in l:
            holders[p].add(d)
    count = {p: len(s) for p, s in holders.items()}
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = {}
    for d, g in groups.items():
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        counts = [count[p] for p in links[d]]
        best = sum(count[p] == top[p[0]] for p in links[d])
        out[d] = ((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links[d]), best, sum(counts), sha256(text.encode()).hexdigest() if g else ""), text)
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows}


ODD = [
    None, "", " ", "a", "hello  world", " lead", "trail ", "tab\tand\nlines\r\n\r\nmore", "<|endoftext|> <s>x</s> <unk> <0x41>", "a▁b", "ﬁ é é ＡＢ ½", "日本語のテキスト 你好 мир",
    "nul\x00byte \x7f", "word " * 3000, "🙂🙃 emoji👩‍👩‍👧", "    four   three", "x" * 3000, "don't can't I'LL", "12345 67,890.12 __init__", "hello  world", "a b c", "\n",
]


def test_query_equals_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op11_tokenizer_alignment(spark, SF)
    assert all(t == ("string" if c == "groups_sha256" else "bigint") for c, t in out.dtypes)
    assert got(out) == {d: v[0] for d, v in plain(rows).items()}


def test_odd_texts_small_blocks_and_group_texts(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)]
    want = plain(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(al.link_counts(df, A, B)) == {d: v[0] for d, v in want.items()}
    clash = df.withColumns({"block": F.lit("x"), "pair": F.lit(1), "kind": F.lit(1), "a": F.lit(2), "count": F.lit(3)})
    monkeypatch.setattr(al, "CHARS_PER_STEP", 40)
    assert got(al.link_counts(clash.repartition(3, "doc_id"), A, B)) == {d: v[0] for d, v in want.items()}
    assert {r.doc_id: r.groups for r in al.alignments(clash, A, B).collect()} == {d: v[1] for d, v in want.items()}
    assert got(al.link_counts(df.limit(0), A, B)) == {}


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "one text"), (1, "one text"), (None, "one text"), (2, None)], "doc_id long, text string")
    out = [tuple(r) for r in al.link_counts(df, A, B).collect()]
    assert len(out) == 4 and len(set(out)) == 3
    same = [r for r in out if r[1]]
    assert all(r[6] == 3 * r[4] and r[5] == r[4] for r in same)  # every link is in three documents


def test_walk_equals_common_ends():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.choice([1, 2, 30, 300])
        whole = sorted(rng.sample(range(1, 4 * n + 2), n))
        keep = lambda p: [x for x in whole[:-1] if rng.random() < p] + whole[-1:]
        p = rng.choice([0.3, 0.9, 0.99, 1.0])
        a, b = keep(p), keep(p)
        cuts = []
        for ga, gb in al.groups_of(a, b):
            assert a[ga[-1]] == b[gb[-1]] and not {a[i] for i in ga[:-1]} & {b[j] for j in gb[:-1]}
            cuts.append(a[ga[-1]])
        assert cuts == sorted(set(a) & set(b))
    assert al.walk([], []) == ([], []) and al.walk([5], [5]) == ([(0, 0, 1)], [])

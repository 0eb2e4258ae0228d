"""Conversation trie against a plain tree in memory."""

import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from landstrata.llm import prefix_trie as pt, queries
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, family=20, most=4):
    """The contract word by word."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        rest = abs(c) % family * (1 if c >= 0 else -1)
        built[c] = own.get(c - rest, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children[node]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids)
    out = set()
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(node)))
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], sha256(ends.encode()).hexdigest()))
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_plain_tree(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op12_conversation_prefix_trie(spark, SF)
    assert dict(out.dtypes) == {**{c: "bigint" for c in out.columns[:-1]}, "ends_sha256": "string"}
    assert got(out) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (0, 1, "user", "a b"), (0, 0, "user", "start here"), (0, None, None, None), (0, 2, "assistant", "x" * 100_000),
        (21, 0, "user", "no base"), (21, 1, "user", "two"), (21, 1, "user", "two"), (21, 1, "assistant", "tie"),
        (None, 0, "user", "nobody"), (-5, 0, "user", "minus"), (-5, 1, "u", ""), (-20, 0, "user", "minus"), (45, 0, "user", "alone"), (7, 0, "role", "a"), (8, 0, "rolea", ""),
        *[(c, t, "user", f"same {t}") for c in range(60, 80) for t in range(4)], *[(c, t, "user", f"same {t}") for c in range(60, 80) for t in range(2)],
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(pt.family_trie(df)) == plain(rows)
    clash = df.withColumns({"d": F.lit("x"), "a": F.lit(1), "words": F.lit(2), "r": F.lit(3)})
    assert got(pt.family_trie(clash)) == plain(rows)
    assert got(pt.family_trie(df.limit(0))) == set()


def test_long_conversation_and_hot_node_in_small_tasks(spark, monkeypatch):
    """A path of 3,000 nodes, 600 equal conversations and 400 children of one node, with tasks of a few arcs."""
    monkeypatch.setattr(pt, "SIBLINGS_PER_TASK", 50)
    rows = [(1, t, "u", f"long {t}") for t in range(3000)] + [(1000 + i, t, "u", f"copy {t}") for i in range(600) for t in range(2)]
    rows += [(5000 + i, t, "u", f"copy {t}" if t == 0 else f"own {i}") for i in range(400) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(pt.family_trie(df)) == plain(rows)


@pytest.mark.parametrize("per_task", [40, 1000])
def test_list_ranking(spark, per_task):
    """A list in scattered order: sums before each arc, whatever a task holds."""
    n = 2000
    order = [(i * 769) % n for i in range(n)]
    rows = [(order[i], 0, order[i + 1] if i + 1 < n else None, 0 if i + 1 < n else None, i % 3, i) for i in range(n)]
    arcs = spark.createDataFrame(rows, "conv long, code long, next_conv long, next_code long, leaf long, saved long")
    out = {r.conv: (r.leaf_before, r.saved_before) for r in pt.ranked(arcs, per_task).collect()}
    leaf = saved = 0
    for i in range(n):
        assert out[order[i]] == (leaf, saved)
        leaf, saved = leaf + i % 3, saved + i

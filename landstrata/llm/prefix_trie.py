"""Prefix trie of conversations, measured by an Euler tour.

Every distinct sequence of first turns is a node. A node's identity is the XOR, over its turns, of a 128-bit hash of
(position, role, text), so prefixes of a conversation of any length come from a running XOR. Nodes are written as
(smallest member, depth); each has an enter arc and an exit arc, and the arcs form one list: enter a node, its children by
smallest member, leave it. The list is ranked by contraction: arcs are dealt over tasks, first by member so that most
of the tour is together, then by coins that bring half-way neighbours together; each task joins its pieces of the list
to one arc with their sums, until one task holds what is left; then the sums before each arc are handed back round by
round. What a subtree holds is the sum before its exit arc less the sum before its enter arc.

Odd cases: rows with a null conv_id take no part; a null role or text is empty; turns come by ``turn``, null first, equal
ones by role and then by the MD5 of role and text; repeated rows are turns of their own. An empty table has no nodes, not
even a root. Empty and very long texts are ordinary; further columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from landstrata.llm.common import written
from landstrata.operators.skew import neighbors_in_order, running

#: Arcs that one task ranks, and rows of a group that one window takes.
ARCS_PER_TASK = 100_000
SIBLINGS_PER_TASK = 20_000
#: Members whose ids are joined to one text before they meet: those that differ in the last eight bits.
CHUNK_BITS = 8
WORDS = r"[^\x20\x09-\x0D]+"


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, r, a, b, words)``: turns numbered from 0, their role and text as 128 bits, and the words of the text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words")
    )
    numbered = running(rows, ["conv_id"], ["turn", "role", "digest"], {"r": ("sum", F.lit(1).cast("long"))}, inclusive=False)
    return numbered.select("conv_id", "r", _half(F.col("digest"), 1).alias("a"), _half(F.col("digest"), 17).alias("b"), "words")


def with_shared_heads(turns: DataFrame, family: int, most: int) -> DataFrame:
    """Turns ``(conv_id, d, a, b, words)``, d from 1, of conversations that start with turns of the first of their family.

    Of conversation c the first h turns are those of conversation c - c % ``family`` (all if it has fewer, none if it is
    absent), h = crc32(c as text) % ``most``; its own turns after its first h follow.
    """
    head = lambda c: (F.crc32(F.col(c).cast("string").cast("binary")) % most).cast("long")
    ids = turns.select("conv_id").distinct().withColumn("h", head("conv_id"))
    heads = turns.where(F.col("r") < most - 1).withColumnRenamed("conv_id", "base")
    # At most most - 1 rows for each conversation, and family conversations for each base.
    first = ids.where("h > 0").join(heads, (F.col("conv_id") - F.col("conv_id") % family == F.col("base")) & (F.col("r") < F.col("h")))
    first = written(first.select("conv_id", F.col("h"), (F.col("r") + 1).alias("d"), "a", "b", "words"), "trie-heads")
    got = first.groupBy("conv_id").agg(F.count(F.lit(1)).alias("got"))
    short = ids.where("h > 0").join(got, "conv_id", "left").select("conv_id", (F.col("h") - F.coalesce("got", F.lit(0))).alias("lack")).where("lack > 0")
    own = turns.withColumn("h", head("conv_id")).where("r >= h").join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("r") + 1 - F.coalesce("lack", F.lit(0))).alias("d"), "a", "b", "words")
    return first.drop("h").union(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv_id, d, ha, hb, pa, pb, words)``: of each turn the hash of the turns up to it and of those before it."""
    salted = turns.select("conv_id", "d", F.xxhash64("d", "a", "b").alias("za"), F.xxhash64(F.lit(1), "b", "a", "d").alias("zb"), "words")
    chained = running(salted, ["conv_id"], ["d"], {"ha": ("bit_xor", F.col("za")), "hb": ("bit_xor", F.col("zb"))})
    return chained.select("conv_id", "d", "ha", "hb", F.col("ha").bitwiseXOR(F.col("za")).alias("pa"), F.col("hb").bitwiseXOR(F.col("zb")).alias("pb"), "words")


def trie_nodes(chained: DataFrame, ids: DataFrame) -> DataFrame:
    """One row a node: ``conv_id, d, ha, hb, n_convs, words`` (of its last text), ``parent`` (the parent's conv_id).

    ``ids`` are all conversations; those without a turn are members of the root alone.
    """
    all_of = ids.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    at = written(
        chained.groupBy("d", "ha", "hb").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb")
        ), "trie-prefixes",
    )
    above = at.select((F.col("d") + 1).alias("d"), F.col("ha").alias("pa"), F.col("hb").alias("pb"), F.col("conv_id").alias("parent"))
    names = ["conv_id", "d", "ha", "hb", "n_convs", "words", "parent"]
    # The root, of which nearly all conversations may be children, needs no join; other hot parents are unique on their side.
    deep = at.where("d > 1").join(above, ["d", "pa", "pb"]).select(names)
    top = at.where("d = 1").withColumn("parent", F.lit(all_of["least"]).cast("long")).select(names)
    root = ids.sparkSession.range(1).select(
        F.lit(all_of["least"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("ha"), F.lit(0).cast("long").alias("hb"),
        F.lit(all_of["n"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("parent"),
    )
    return deep.union(top).union(root.where("n_convs > 0"))


def linked(nodes: DataFrame) -> DataFrame:
    """Nodes with ``n_children``, ``first_child`` and ``sibling`` (the next child of the same parent): conv_ids."""
    inner = nodes.where("d > 0")
    of = inner.groupBy(F.col("parent").alias("conv_id"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("first_child"))
    beside = neighbors_in_order(inner, ["parent", "d"], ["conv_id"], "conv_id", limit=SIBLINGS_PER_TASK).drop("prev").withColumnRenamed("next", "sibling")
    both = beside.unionByName(nodes.where("d = 0").withColumn("sibling", F.lit(None).cast("long")))
    return both.join(of, ["conv_id", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def tour(nodes: DataFrame) -> DataFrame:
    """The arcs ``(conv, code)``, code = 2 * depth (enter) or 2 * depth + 1 (exit), with the arc that follows and their weights.

    An enter arc weighs a leaf if the node has no child, and the tokens that its members share.
    """
    n = lambda c: F.col(c).cast("long")
    leaf = F.col("n_children") == 0
    none = F.lit(None).cast("long")
    enter = F.struct(
        n("conv_id").alias("conv"), (2 * n("d")).alias("code"), F.coalesce("first_child", "conv_id").alias("next_conv"), (2 * n("d") + F.when(leaf, 1).otherwise(2)).alias("next_code"),
        leaf.cast("long").alias("leaf"), ((n("n_convs") - 1) * n("words")).alias("saved"),
    )
    up = F.when(n("d") > 0, 2 * n("d") - 1)
    leave = F.struct(
        n("conv_id").alias("conv"), (2 * n("d") + 1).alias("code"), F.coalesce("sibling", "parent", none).alias("next_conv"), F.when(F.col("sibling").isNotNull(), 2 * n("d")).otherwise(up).alias("next_code"),
        F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"),
    )
    return nodes.select(F.inline(F.array(enter, leave)))


# -- list ranking --------------------------------------------------------------------------------------------------
_LEVEL = "conv long, code long, head_conv long, head_code long, leaf_off long, saved_off long, next_conv long, next_code long, leaf long, saved long"


def _contract(batches):
    """The arcs of one task: each run of arcs that follow one another becomes its first arc, with the run's sums and what follows the run.

    Every arc comes out with its head and the sums before it in the run; ``leaf`` is null on all but heads.
    """
    import numpy as np
    import pyarrow as pa

    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    get = lambda c: table[c].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
    conv, code, to_conv, to_code, leaf, saved = (get(c) for c in ("conv", "code", "next_conv", "next_code", "leaf", "saved"))
    convs, dense = np.unique(conv, return_inverse=True)
    width = int(max(code.max(), to_code.max())) + 2
    key = dense * width + code
    order = np.argsort(key, kind="stable")
    place = np.minimum(np.searchsorted(convs, to_conv), len(convs) - 1)
    wanted = np.where((convs[place] == to_conv) & (to_code >= 0), place * width + to_code, -1)
    found = np.minimum(np.searchsorted(key[order], wanted), len(key) - 1)
    follows = np.where((wanted >= 0) & (key[order][found] == wanted), order[found], -1)
    n = len(key)
    head = np.arange(n)
    inside = np.flatnonzero(follows >= 0)
    head[follows[inside]] = inside  # the arc before, for now
    leaf_off, saved_off = (np.where(head != np.arange(n), w[head], 0) for w in (leaf, saved))
    while True:
        further = head[head]
        if (further == head).all():
            break
        leaf_off, saved_off, head = leaf_off + leaf_off[head], saved_off + saved_off[head], further
    tails = np.flatnonzero(follows < 0)
    last = np.full(n, -1)
    last[head[tails]] = tails
    at = np.where(last >= 0, last, 0)
    not_head = last < 0
    ended = not_head | (to_code[at] < 0)
    masked = lambda v, m: pa.array(v, pa.int64(), mask=m)
    yield pa.RecordBatch.from_arrays(
        [
            *(pa.array(v, pa.int64()) for v in (conv, code, conv[head], code[head], leaf_off, saved_off)),
            masked(to_conv[at], ended), masked(to_code[at], ended), masked(leaf_off[at] + leaf[at], not_head), masked(saved_off[at] + saved[at], not_head),
        ],
        names=[f.split()[0] for f in _LEVEL.split(", ")],
    )


def ranked(arcs: DataFrame, per_task: int = ARCS_PER_TASK) -> DataFrame:
    """``(conv, code, leaf_before, saved_before)``: the sums of all arcs before each one in the list that the arcs form.

    Every round leaves three quarters of the arcs at most, so the work of all rounds is a few times that of the first.
    """
    now, levels = arcs, []
    size = arcs.count()
    while True:
        parts = max(1, ceil(size / per_task))
        if parts == 1:
            dealt = now.coalesce(1)
        elif not levels:
            dealt = now.repartitionByRange(parts, "conv", "code")
        else:
            # An arc of tails goes to its own place, one of heads that precedes it goes there too: they become one.
            coin = lambda c, d: F.xxhash64(F.lit(len(levels)), c, d).bitwiseAND(F.lit(1))  # noqa: B023, E731
            meet = (coin("conv", "code") == 0) & F.col("next_code").isNotNull() & (coin("next_conv", "next_code") == 1)
            dealt = now.repartition(parts, F.when(meet, F.col("next_conv")).otherwise(F.col("conv")), F.when(meet, F.col("next_code")).otherwise(F.col("code")))
        level = written(dealt.select("conv", "code", "next_conv", "next_code", "leaf", "saved").mapInArrow(_contract, _LEVEL), "tour-level")
        levels.append(level)
        if parts == 1:
            break
        now = level.where("leaf is not null")
        size = now.count()
    # What is left is one run: the list from its start.
    before = levels[-1].select("conv", "code", F.col("leaf_off").alias("leaf_before"), F.col("saved_off").alias("saved_before"))
    for level in reversed(levels[:-1]):
        of_head = before.withColumnsRenamed({"conv": "head_conv", "code": "head_code"})
        before = written(
            level.join(of_head, ["head_conv", "head_code"]).select(
                "conv", "code", (F.col("leaf_off") + F.col("leaf_before")).alias("leaf_before"), (F.col("saved_off") + F.col("saved_before")).alias("saved_before")
            ), "tour-ranks",
        )
    return before


# -- members that end at a node --------------------------------------------------------------------------------------
def _digests(batches):
    """Rows (d, ha, hb, ids) of one task, sorted by node and then by id: one SHA-256 a node, fed text by text."""
    from hashlib import sha256

    import pyarrow as pa

    names = ["d", "ha", "hb", "ends_sha256"]
    now, state, done = None, None, []
    out = lambda rows: pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())], names=names)
    for batch in batches:
        for d, a, b, text in zip(*(batch.column(c).to_pylist() for c in ("d", "ha", "hb", "ids"))):
            if (d, a, b) == now:
                state.update(b",")
            else:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (d, a, b), sha256()
            state.update(text.encode())
        if len(done) >= 10_000:
            yield out(done)
            done = []
    if now is not None:
        done.append((*now, state.hexdigest()))
    yield out(done)


def end_digests(chained: DataFrame, ids: DataFrame) -> DataFrame:
    """``(d, ha, hb, ends_sha256)`` of every node at which a member ends.

    Ids that differ in the last eight bits become one text first, so that a node of very many members sends its task a
    few texts, which are hashed one after the other and never held together.
    """
    last = chained.groupBy("conv_id").agg(F.max(F.struct("d", "ha", "hb")).alias("end"))
    zero = F.lit(0).cast("long")
    ends = ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"end.{c}"), zero).alias(c) for c in ("d", "ha", "hb")])
    node = ["d", "ha", "hb"]
    texts = ends.groupBy(*node, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    texts = texts.select(*node, "chunk", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    ordered = texts.repartition(*node).sortWithinPartitions(*node, "chunk").drop("chunk")
    return ordered.mapInArrow(_digests, "d long, ha long, hb long, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of the trie of ``turns`` (``conv_id, d, a, b, words``, d from 1 without gaps) of the conversations ``ids``.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (words that need not be stored again, in the whole subtree) and ``ends_sha256``.
    """
    chained = written(prefixes(turns), "trie-chain")
    ids = written(ids.select("conv_id").distinct(), "trie-ids")
    nodes = written(linked(written(trie_nodes(chained, ids), "trie-nodes")), "trie-links")
    before = ranked(tour(nodes))
    sign = F.when(F.col("code") % 2 == 1, F.lit(1)).otherwise(-1)
    subtree = before.groupBy(F.col("conv").alias("conv_id"), F.expr("code div 2").alias("d")).agg(
        F.sum(sign * F.col("leaf_before")).alias("n_leaves"), F.sum(sign * F.col("saved_before")).alias("saved_tokens")
    )
    whole = nodes.join(subtree, ["conv_id", "d"]).join(end_digests(chained, ids), ["d", "ha", "hb"], "left")
    return whole.select(
        "conv_id", F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def family_trie(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """The trie of conversations whose first turns are those of the first of their family (:func:`with_shared_heads`)."""
    turns = written(ordered_turns(conversations), "trie-turns")
    return prefix_trie(written(with_shared_heads(turns, family, most), "trie-rebuilt"), turns.select("conv_id"))

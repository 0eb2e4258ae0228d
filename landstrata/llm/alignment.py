"""Alignment of the tokens of two tokenizers over the same text.

Tokens are byte ranges of a space and the text; offsets where tokens of both end cut them into groups. The ends are two
sorted arrays, and diagonal run skipping walks them: while the shift between the indexes stays the same, slices of doubling
length are compared, so a stretch of one-to-one tokens takes a logarithmic number of steps; where it ends, the irregular
group is resolved token by token and the shift is updated.

Each task numbers the distinct groups of a block of documents and the id pairs in them. Documents keep the numbers of
their groups, and only a block's distinct pairs, with the number of its documents that hold them, are shuffled to be
summed over the corpus; the sums come back to the block, where they are added up for each document.

Odd cases: documents whose text is null or empty, or whose tokens of either kind do not join to space and text, have no
tokens: zeros and an empty text of groups. Special tokens' names inside a text are plain text. Repeated documents are
counted each; a null doc_id is kept. Long texts are held whole, one at a time. Further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from landstrata.llm.common import written

#: A block ends after so many distinct id pairs or characters, whichever comes first.
PAIRS_PER_BLOCK, CHARS_PER_BLOCK = 400_000, 32_000_000
#: Characters that are tokenized and walked at a time; a longer text is one step.
CHARS_PER_STEP = 1 << 21
REMEMBERED = 800_000


def walk(ea: list[int], eb: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """The groups of two tokenizations of one text by their ends.

    Gives the one-to-one stretches ``(i, j, k)``: the k tokens from i and from j end together one by one; and the irregular
    groups ``(i, i2, j, j2)``: the tokens from i up to i2 and from j up to j2 end together, and none of them before.
    """
    even, odd = [], []
    i = j = 0
    n = len(ea)
    while i < n:
        x, y = ea[i], eb[j]
        if x == y:
            i0, shift = i, j - i
            i += 1
            # Short stretches token by token; then slices of 8, 16, 32 … tokens at the same shift, and halves where they differ.
            near = min(i + 8, n)
            while i < near and ea[i] == eb[i + shift]:
                i += 1
            if i == near and i < n:
                step = 8
                while i < n and ea[i:i + step] == eb[i + shift:i + shift + step]:
                    i += step
                    step *= 2
                if i >= n:
                    i = n  # both end with the text
                else:
                    while step > 1:
                        step //= 2
                        if ea[i:i + step] == eb[i + shift:i + shift + step]:
                            i += step
            j = i + shift
            even.append((i0, i0 + shift, i - i0))
        else:
            i0, j0 = i, j
            while x != y:
                if x < y:
                    i += 1
                    x = ea[i]
                else:
                    j += 1
                    y = eb[j]
            i += 1
            j += 1
            odd.append((i0, i, j0, j))
    return even, odd


def groups_of(a: list[int], b: list[int]) -> list[tuple[tuple, tuple]]:
    """The groups of a text whose tokens end at ``a`` and ``b``, in order, as the indexes of their tokens."""
    even, odd = walk(a, b)
    singles = [((i + d,), (j + d,)) for i, j, k in even for d in range(k)]
    return sorted(singles + [(tuple(range(i, i2)), tuple(range(j, j2))) for i, i2, j, j2 in odd])


class Pair:
    """The two tokenizers of a worker: A of the tokenizers library with byte-level tokens, B a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str, remembered: int):
        import json
        import re

        import numpy as np
        import sentencepiece

        from landstrata.llm.tokens import encoder

        self.a = encoder(path_a, remembered)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # Byte-level tokens stand for bytes by one letter each: printable bytes for themselves, the others from U+0100 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in set(own)]
        byte = {**{chr(x): x for x in own}, **{chr(256 + i): x for i, x in enumerate(rest)}}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            one = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
            self.bytes_b.append(bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode())
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        # Byte-level tokens without a normalizer or an added space, with one for each byte, join to their text by construction.
        made = json.loads(self.a.tokenizer.to_str())
        step = made.get("pre_tokenizer") or {}
        self.lossless_a = made.get("normalizer") is None and step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and set(byte) <= set(vocabulary)
        self.text_a = [str(i) for i in range(len(self.bytes_a))]
        self.text_b = [str(i) for i in range(len(self.bytes_b))]

    def aligned(self, texts: list[str | None]):
        """For each text its ids of A and B as arrays, its one-to-one stretches and its irregular groups; nothing where it has no tokens."""
        import numpy as np

        spaced = [" " + t if t else "" for t in texts]
        ids_a = self.a.encode(spaced)
        ids_b = self.b.encode([t or "" for t in texts], num_threads=1)
        none = np.zeros(0, np.uint32)
        for text, a, b in zip(spaced, ids_a, ids_b):
            a, raw = np.frombuffer(a, "<u4"), text.encode("utf-8", "surrogatepass")
            whole_a = self.lossless_a or b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw
            if not raw or not whole_a or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
                yield none, none, [], []
                continue
            b = np.array(b, "<u4")
            yield a, b, *walk(self.length_a[a].cumsum().tolist(), self.length_b[b].cumsum().tolist())

    def group_text(self, a: list[int], b: list[int]) -> str:
        return ",".join([self.text_a[x] for x in a]) + "|" + ",".join([self.text_b[y] for y in b])


@lru_cache(maxsize=1)
def pair(path_a: str, path_b: str, remembered: int) -> Pair:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Pair(path_a, path_b, remembered)


def _steps(batches):
    """``(doc_ids, texts)`` of about ``CHARS_PER_STEP`` characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t or "") + 1
            if size >= CHARS_PER_STEP:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def alignments(docs: DataFrame, path_a: str, path_b: str, remembered: int = REMEMBERED) -> DataFrame:
    """``(doc_id, n_a, n_b, groups)``: the groups of every document as text ``a1,a2|b1;a3|b2,b3`` of decimal ids."""

    def run(batches):
        import pyarrow as pa

        both = pair(path_a, path_b, remembered)
        for ids, texts in _steps(batches):
            block = Block(both)
            rows = [(i, len(a), len(b), block.text(block.numbers(a, b, even, odd))) for i, (a, b, even, odd) in zip(ids, both.aligned(texts))]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.string())], names=["doc_id", "n_a", "n_b", "groups"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_a long, n_b long, groups string")


_BLOCKS = (
    "block string, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "data binary, more binary, pair long, a int, b int, docs long"
)
_KINDS = {"document": 0, "groups": 1, "pair": 2}


class Block:
    """The distinct groups and pairs of some documents, numbered as they come."""

    def __init__(self, both: Pair):
        import numpy as np

        self.both = both
        self.groups: dict[tuple[bytes, bytes], int] = {}
        # For each id of A: the one-to-one group it was last met in, and that group's id of B.
        self.single, self.partner = np.full(len(both.bytes_a), -1, np.int64), np.full(len(both.bytes_a), -1, np.int64)
        self.texts: list[str] = []
        self.links: list[int] = []  # of each group
        self.pairs: dict[int, int] = {}  # a << 32 | b
        self.of_group: list[int] = []  # pair numbers, group after group, repeated as often as they are linked
        self.docs = None  # for each pair the documents that hold it
        self.chars = 0

    def add(self, group: tuple[bytes, bytes]) -> int:
        """A number for a new group, given as the bytes of its ids."""
        number = self.groups[group] = len(self.groups)
        a, b = (memoryview(x).cast("I").tolist() for x in group)
        self.texts.append(self.both.group_text(a, b))
        self.links.append(len(a) * len(b))
        pairs = self.pairs
        self.of_group.extend([pairs.setdefault(x << 32 | y, len(pairs)) for x in a for y in b])
        return number

    def numbers(self, a, b, even: list[tuple[int, int, int]], odd: list[tuple[int, int, int, int]]):
        """The numbers of the groups of a text, in order."""
        import numpy as np

        known = self.groups
        i, j, k = np.array(even, np.int64).reshape(-1, 3).T
        at_a, at_b = _gather(i, k), _gather(j, k)
        x, y = a[at_a], b[at_b]
        single = self.single[x]
        # An id of A nearly always has the same partner; the others are looked up.
        for n in np.flatnonzero((single < 0) | (self.partner[x] != y)).tolist():
            group = (x[n].tobytes(), y[n].tobytes())
            g = known.get(group)
            single[n] = self.single[x[n]] = self.add(group) if g is None else g
            self.partner[x[n]] = y[n]
        if not odd:
            return single
        raw_a, raw_b = a.tobytes(), b.tobytes()
        found = []
        for i1, i2, j1, j2 in odd:
            group = (raw_a[4 * i1:4 * i2], raw_b[4 * j1:4 * j2])
            g = known.get(group)
            found.append(self.add(group) if g is None else g)
        # Groups stand in the order of their first tokens of A.
        out = np.full(len(a), -1, np.int64)
        out[at_a] = single
        out[np.array(odd, np.int64)[:, 0]] = found
        return out[out >= 0]

    def text(self, numbers) -> str:
        return ";".join(map(self.texts.__getitem__, numbers.tolist()))


def _sums(values, links):
    """Sums of ``values`` over consecutive stretches of ``links`` items each."""
    import numpy as np

    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(links)
    return total[ends] - total[ends - links]


def _gather(starts, counts):
    """The indexes of stretches ``starts[i] … starts[i] + counts[i]``, one after the other."""
    import numpy as np

    if not len(starts):
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())


def _blocks(batches, path_a: str, path_b: str, remembered: int):
    """Rows of three kinds: documents with the numbers of their groups, the groups of each block, and its pairs."""
    import gc
    from hashlib import sha256
    from uuid import uuid4

    import numpy as np
    import pyarrow as pa

    gc.disable()  # millions of small objects without a cycle; this worker does nothing else
    both = pair(path_a, path_b, remembered)
    fields = [f.split() for f in _BLOCKS.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.large_binary()}

    def out(kind: str, n: int, **columns):
        columns = {"block": [name] * n, "kind": np.full(n, _KINDS[kind], np.int32), **columns}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], types[t]) if c in columns else pa.nulls(n, types[t]) for c, t in fields], names=[c for c, _ in fields])

    def close(block: Block):
        if not block.groups:
            return
        yield out("groups", 1, data=[np.array(block.links, "<u4").tobytes()], more=[np.array(block.of_group, "<u4").tobytes()])
        keys = np.fromiter(block.pairs, np.int64, len(block.pairs))
        for s in range(0, len(keys), 50_000):
            part = keys[s:s + 50_000]
            yield out("pair", len(part), pair=np.arange(s, s + len(part)), a=(part >> 32).astype(np.int32), b=(part & 0xFFFFFFFF).astype(np.int32), docs=block.docs[s:s + len(part)])

    block, name = Block(both), uuid4().hex
    for ids, texts in _steps(batches):
        rows, seen = [], []
        for d, i in zip(both.aligned(texts), ids):
            a, b, even, odd = d
            numbers = block.numbers(a, b, even, odd)
            text = block.text(numbers)
            own, often = np.unique(numbers, return_counts=True)
            seen.append(own)
            rows.append((i, len(a), len(b), len(numbers), sha256(text.encode()).hexdigest() if len(a) else "", own.astype("<u4").tobytes(), often.astype("<u4").tobytes(), often))
        links = np.array(block.links, np.int64)
        starts = np.cumsum(links) - links
        of_group = np.array(block.of_group, np.int64)
        # Each document counts once for a pair, in however many groups it has it.
        counted = np.zeros(len(block.pairs), np.int64)
        for own in seen:
            counted[np.unique(of_group[_gather(starts[own], links[own])])] += 1
        if block.docs is not None:
            counted[:len(block.docs)] += block.docs
        block.docs = counted
        yield out(
            "document", len(rows), **{c: [r[k] for r in rows] for k, c in enumerate(("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "data", "more"))},
            n_links=[int((links[own] * r[7]).sum()) for own, r in zip(seen, rows)],
        )
        block.chars += sum(len(t or "") for t in texts)
        if len(block.pairs) >= PAIRS_PER_BLOCK or block.chars >= CHARS_PER_BLOCK:
            yield from close(block)
            block, name = Block(both), uuid4().hex
    yield from close(block)
    gc.enable()


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _add_up(rows, pairs):
    """The sums of each document of a block, from its groups and the corpus-wide counts of its pairs."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    count = np.zeros(pairs.num_rows, np.int64)
    best = np.zeros(pairs.num_rows, np.int64)
    number = pairs["pair"].to_numpy()
    count[number], best[number] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    groups = rows.filter(pc.equal(rows["kind"], _KINDS["groups"]))
    docs = rows.filter(pc.equal(rows["kind"], _KINDS["document"]))
    if groups.num_rows:
        links = np.frombuffer(groups["data"][0].as_py(), "<u4").astype(np.int64)
        of_group = np.frombuffer(groups["more"][0].as_py(), "<u4")
        sums = [_sums(v[of_group], links) for v in (best, count)]
    n_best, count_sum = [], []
    for data, more in zip(docs["data"].to_pylist(), docs["more"].to_pylist()):
        own, often = np.frombuffer(data, "<u4"), np.frombuffer(more, "<u4").astype(np.int64)
        n_best.append(int((sums[0][own] * often).sum()) if len(own) else 0)
        count_sum.append(int((sums[1][own] * often).sum()) if len(own) else 0)
    names = [f.split()[0] for f in _RESULT.split(", ")]
    made = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table([made.get(c, docs[c] if c in docs.column_names else None) for c in names], names=names)


def link_counts(docs: DataFrame, path_a: str, path_b: str, remembered: int = REMEMBERED) -> DataFrame:
    """For every document the numbers of its tokens, groups and links, and what its links count over the corpus.

    The count of an id pair is the number of documents that hold it linked. ``n_best`` are the links whose count is the
    highest of their A id, ``count_sum`` is the sum of the counts of all links, ``groups_sha256`` the digest of the groups'
    text as :func:`alignments` gives it (empty without tokens).
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(own.mapInArrow(lambda batches: _blocks(batches, path_a, path_b, remembered), _BLOCKS), "alignment", compression="zstd")
    pairs = rows.where(F.col("kind") == _KINDS["pair"]).select("block", "pair", "a", "b", "docs")
    summed = written(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")), "pair-counts")
    top = summed.groupBy("a").agg(F.max("count").alias("top"))
    counts = summed.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
    back = pairs.join(counts, ["a", "b"]).select(F.col("block").alias("of_block"), "pair", "count", "best")
    parts = rows.where(F.col("kind") != _KINDS["pair"]).drop("pair", "a", "b", "docs")
    return parts.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_add_up, _RESULT)

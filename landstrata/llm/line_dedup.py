"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

A line of length l is cut into ``edits + 1`` segments. A line within ``edits`` edits of it contains at least one of them
unchanged, near the segment's own place. So each line is filed under (its length, segment number, segment) and looks, for
every length up to ``edits`` below its own, for the segments of such lines at the few places where they can be. Lines that
meet another are found first, without their pairs; only they are fetched, and meet again beside their letter counts.
Pairs that are left are verified by an edit distance over a band of the matrix, one column at a time in bit vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from landstrata.llm.common import cut_lineage

EDITS, SHORTEST = 2, 20
#: Frequent letters that are counted on every line that meets another; lines within k edits differ by k more and k fewer at most.
LETTERS = "eantrhiosdlcumpg"
#: Up to so many candidate lines their places are broadcast (24 bytes each); beyond, the texts are shuffled.
BROADCAST_LINES = 250_000


def _segment(length: Column, i: Column, edits: int) -> tuple[Column, Column]:
    """First character (from 1) and length of segment ``i`` (from 1); the last ones take the remainder, one each."""
    base, rest = F.floor(length / (edits + 1)).cast("int"), length % (edits + 1)
    longer = F.greatest(F.lit(0), i - 1 - (edits + 1) + rest)
    size = base + F.when(i > F.lit(edits + 1) - rest, 1).otherwise(0)
    return F.lit(1) + base * (i - 1) + longer, size


def filed_places(edits: int) -> list[tuple[int, int, int]]:
    """(segment, how much shorter the line it is cut for, shift) of the places under which a line is filed."""
    return [(i, 0, 0) for i in range(1, edits + 2)]


def sought_places(edits: int) -> list[tuple[int, int, int]]:
    """Places at which a line looks for segments of lines that are at most ``edits`` shorter.

    Segment i is looked for only where both what is left of it and what is right of it can still match: at most i - 1
    edits to its left and edits + 1 - i to its right.
    """
    return [
        (i, less, shift) for less in range(edits + 1) for i in range(1, edits + 2)
        for shift in range(max(1 - i, less - (edits + 1 - i)), min(i - 1, less + edits + 1 - i) + 1)
    ]


def segments(lines: DataFrame, places: list[tuple[int, int, int]], edits: int, shortest: int) -> DataFrame:
    """Columns of ``lines`` but ``line``, and ``s``: a hash of each segment of the line at one of the places, if it lies in the line.

    The line is spread to four bytes a character once, so that no segment is sought from the line's start; places are rows, so that
    one short expression does for all of them.
    """
    at = F.explode(F.array(*[F.struct(*[F.lit(x).alias(k) for x, k in zip(place, ("i", "less", "shift"))]) for place in places]))
    wide = lines.withColumn("wide", F.encode("line", "UTF-32")).withColumn("n", F.shiftright(F.octet_length("wide"), 2))
    rows = wide.drop("line").select("*", at.alias("place"))
    i, n = F.col("place.i"), F.col("n")
    other = n - F.col("place.less")
    start, size = _segment(other, i, edits)
    first = start + F.col("place.shift")
    fits = (other >= shortest) & (first >= 1) & (first + size - 1 <= n)
    cut = F.substring("wide", (first - 1) * 4 + 1, size * 4)
    return rows.where(fits).withColumn("s", F.xxhash64(i, other, cut)).drop("wide", "n", "place")


def _sides(lines: DataFrame, edits: int, shortest: int) -> list[DataFrame]:
    """Segments under which lines are filed, and those that they seek, once for each line. Equal lines meet in one task by their
    segment and go on as one."""
    return [segments(lines, places, edits, shortest).repartition("s").distinct() for places in (filed_places(edits), sought_places(edits))]


def meeting_lines(lines: DataFrame, edits: int, shortest: int) -> DataFrame:
    """``id`` of the lines of which another has a segment, or that have one of another: each is asked for, no pairs are made."""
    filed, sought = _sides(lines, edits, shortest)
    there = lambda x, y: x.alias("x").join(y.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("x.id") != F.col("y.id")), "left_semi").select("id")
    return there(filed, sought).union(there(sought, filed)).distinct()


def meeting(lines: DataFrame, edits: int, shortest: int) -> DataFrame:
    """Pairs of different lines, some repeated, of which one has a segment of the other: all columns of ``lines`` but ``line``, of the
    first named ``.._a`` and of the second ``.._b``."""
    a, b = (x.withColumnsRenamed({c: f"{c}_{y}" for c in x.columns if c != "s"}) for x, y in zip(_sides(lines, edits, shortest), "ab"))
    return a.join(b, "s").where("id_a <> id_b")


def _bag(line: Column) -> Column:
    """How often each of sixteen frequent letters occurs, modulo 16, four bits for each."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(count.cast("long").bitwiseAND(F.lit(15)), 4 * i))
    return out


def _bags_within(x: Column, y: Column, edits: int) -> Column:
    """An edit adds one letter at most and takes one away at most; counts modulo 16 tell up to seven apart."""
    if edits > 7:
        return F.lit(True)
    more, less = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i in range(len(LETTERS)):
        d = F.shiftrightunsigned(x, 4 * i).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(y, 4 * i).bitwiseAND(F.lit(15))
        d = (d + 8).bitwiseAND(F.lit(15)) - 8
        more, less = more + F.greatest(d, F.lit(0)), less + F.greatest(-d, F.lit(0))
    return (more <= edits) & (less <= edits)


def _letters(line: Column) -> Column:
    """How often each of a to z and the space occurs."""
    return F.array(*[F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in "abcdefghijklmnopqrstuvwxyz "])


def _letters_within(x: Column, y: Column, edits: int) -> Column:
    differ = F.zip_with(x, y, lambda a, b: a - b)
    more = F.aggregate(differ, F.lit(0), lambda s, d: s + F.greatest(d, F.lit(0)))
    less = F.aggregate(differ, F.lit(0), lambda s, d: s + F.greatest(-d, F.lit(0)))
    return (more <= edits) & (less <= edits)


def banded_distance(x: Column, y: Column, edits: int) -> Column:
    """Edit distance of two texts if it is at most ``edits`` (30 at most), else some larger number.

    Rows are the shorter text's characters, columns the longer one's. Column j of the matrix is kept as differences down the rows j - edits .. j + edits, a bit for
    each: ``vp`` where the value rises, ``vn`` where it falls. The band moves down a row with each column, so the
    diagonal that ends in the last cell stays at one bit; each step on it costs one unless that bit of ``d0`` is set.
    """
    width = 2 * edits + 1
    full = F.lit((1 << width) - 1)
    swap = F.char_length(x) > F.char_length(y)
    short, long = F.when(swap, y).otherwise(x), F.when(swap, x).otherwise(y)
    # Worked out once for each pair; in UTF-32 a character is four bytes and found at once.
    given = F.struct(
        F.encode(short, "UTF-32").alias("x"), F.encode(long, "UTF-32").alias("y"), F.char_length(short).alias("m"), F.char_length(long).alias("n")
    )
    return F.get(F.transform(F.array(given), lambda v: _banded(v, edits, width, full)), F.lit(0))


def _banded(v: Column, edits: int, width: int, full: Column) -> Column:
    m, n = v["m"], v["n"]
    gap = n - m
    at = lambda data, i: F.substring(data, (i - 1) * 4 + 1, F.lit(4))

    def equal(j: Column) -> Column:
        def bits(own: Column) -> Column:
            out = F.lit(0).cast("long")
            for b in range(width):
                i = j - edits + b
                out = out + F.when((i >= 1) & (i <= m) & (at(v["x"], F.greatest(i, F.lit(1))) == own), F.lit(1 << b)).otherwise(F.lit(0))
            return out

        return F.get(F.transform(F.array(at(v["y"], j)), bits), F.lit(0))

    def step(s: Column, eq: Column) -> Column:
        vp, vn = s["vp"], s["vn"]
        d0 = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(full)

        def column(d: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)).bitwiseAND(full))
            hn = d.bitwiseAND(vp)
            down = F.shiftrightunsigned(d, 1)
            paid = (s["j"] > gap) & (d.bitwiseAND(s["bit"]) == 0)
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(full)).alias("vp"), down.bitwiseAND(hp).alias("vn"),
                (s["cost"] + F.when(paid, 1).otherwise(0)).alias("cost"), (s["j"] + 1).alias("j"), s["bit"].alias("bit"),
            )

        return F.get(F.transform(F.array(d0), column), F.lit(0))  # so that d0 is worked out once

    first = F.struct(
        F.lit(((1 << (edits + 1)) - 1) << edits).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), gap.alias("cost"), F.lit(1).alias("j"),
        F.element_at(F.array(*[F.lit(1 << b).cast("long") for b in range(edits + 1)]), F.greatest(F.lit(1), edits - gap + 1)).alias("bit"),
    )
    run = F.aggregate(F.transform(F.sequence(F.lit(1), n), equal), first, step, lambda s: s["cost"])
    return F.when(n == 0, F.lit(0)).when(gap > edits, gap).otherwise(run)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, at, line) of every line; h tells the texts of a repeated doc_id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("at", "line"))


def repeated_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``doc_id, h, n_lines, gone`` of every text: its lines, and the numbers (from 0, ascending) of those to remove.

    Lines are what newlines separate. Lines are in order of doc_id (null last), text hash, line number. A line goes if it
    equals an earlier one, or if the first line equal to it has one that first stands earlier within ``edits`` edits
    (insert, delete or replace a character), judged on the input. Lines under ``shortest`` characters stay and
    remove nothing. A null text has no lines and no row here. Rows that repeat doc_id and text are one text.
    """
    lines = _lines(docs.where("text is not null"))
    long = lines.where(F.char_length("line") >= shortest)
    # Which line: two hashes and the length. Which came first: the least place.
    key = [F.xxhash64("line").alias("k"), F.hash("line", F.char_length("line")).alias("k2")]
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.col("h"), F.col("at"))
    kinds = cut_lineage(long.select(*key, place.alias("place")).groupBy("k", "k2").agg(F.min("place").alias("first")))

    # First only which lines meet another at all: a few of them, and no more than there are, however many pairs they make.
    wanted = meeting_lines(long.select(F.xxhash64("line").alias("id"), "line"), edits, shortest).withColumnRenamed("id", "k")
    spots = cut_lineage(kinds.join(wanted, "k").select("k", "k2", "first"))
    needed = F.broadcast(spots) if spots.count() <= broadcast_lines else spots
    same = (F.coalesce("doc_id", F.lit(2**63 - 1)) == F.col("first.d")) & (F.xxhash64("text") == F.col("first.h"))
    texts = docs.select("doc_id", "text").join(needed, same).select("k", "first", F.get(F.split("text", "\n"), F.col("first.at")).alias("line")).distinct()
    texts = cut_lineage(texts.withColumns({"letters": _letters(F.col("line")), "bag": _bag(F.col("line"))}))
    met = meeting(texts.select(F.col("k").alias("id"), "bag", "line"), edits, shortest).where(_bags_within(F.col("bag_a"), F.col("bag_b"), edits))
    pairs = cut_lineage(met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct())
    a = texts.select(F.col("k").alias("a"), F.col("first").alias("first_a"), F.col("line").alias("line_a"), F.col("letters").alias("letters_a"))
    b = texts.select(F.col("k").alias("b"), F.col("first").alias("first_b"), F.col("line").alias("line_b"), F.col("letters").alias("letters_b"))
    likely = pairs.join(a, "a").join(b, "b").where(_letters_within(F.col("letters_a"), F.col("letters_b"), edits))
    near = likely.where(banded_distance(F.col("line_a"), F.col("line_b"), edits) <= edits)
    late = near.select(F.greatest("first_a", "first_b").alias("first")).distinct().withColumn("near", F.lit(True))

    # Every line but the first of its kind goes, and the first too if it is near an earlier one.
    marked = kinds.join(late, "first", "left").select("k", "k2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    judged = long.select("doc_id", "h", "at", place.alias("place"), *key).join(marked, ["k", "k2"])
    gone = judged.where((F.col("place") != F.col("first")) | F.col("near")).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    sizes = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    out = sizes.join(gone.withColumnsRenamed({"doc_id": "__id", "h": "__h"}), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left")
    return out.select("doc_id", "h", "n_lines", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` with the text that is left of them; see ``repeated_lines``.

    ``n_chars``, where there is one, becomes the length of what is left. A document of which every line goes is not kept; one
    that loses none, an empty or a null text among them, stays as it is.
    """
    found = repeated_lines(docs, edits, shortest).where(F.size("gone") > 0).distinct()
    found = found.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("gone").alias("__gone"))
    rows = docs.withColumn("__text", F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__h")), "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    left = rows.where(F.col("__gone").isNull() | (F.size(stay) > 0))
    joined = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    left = left.withColumn("__left", F.when(F.col("__gone").isNotNull(), joined))
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.coalesce("__left", "text")}
    if "n_chars" in out:
        out["n_chars"] = F.coalesce(F.char_length("__left").cast(docs.schema["n_chars"].dataType), "n_chars")
    return left.select(*[c.alias(k) for k, c in out.items()])

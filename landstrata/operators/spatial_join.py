"""Spatial join as an equi join on grid cells.

Features go to square cells of about the median feature size. A feature much larger than a cell goes to a coarser grid
instead, so it covers at most 25 cells, nothing is exploded without bound and no side has to be broadcast; smaller
partners visit those coarser grids as well. A pair is reported only by the cell that holds the lower-left corner of the common
bbox, so no ``distinct`` is needed. Cells that hold very many rows are split over salts.

Rows of equal shape need not be compared one by one. Where most rows of a side are copies of others' shapes, the distinct
shapes (*places*) are joined and the rows are put to them by an equi join; what asks for one answer per place
(:func:`meeting_places`) never makes the pairs of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from landstrata.session import cut_lineage
from landstrata.functions.geometry import bbox_overlap, intersects_exact, is_valid, within

GROW = 8  # factor between the cell sides of neighbouring levels
REACH = 4  # a feature stays on a level while it is at most this many cells wide
HOT_ROWS = 1_000_000  # rows of one cell that are handled without splitting
COPIES = 4  # rows for each distinct shape from which on shapes are joined and rows put to them
SMALL_ROWS = 1_000  # where a side has more rows, no side is broadcast by the size that Spark expects
FEW_ROWS = 64  # a side of so few rows is compared with every row of the other
FEW_VERTICES = 100_000  # provided that its shapes have no more vertices in all


class Grid:
    """Cell side of level 0 and the levels each input has, found with one small aggregate per input."""

    def __init__(self, side, limits, left_levels, right_levels, counts, flat, shapes):
        self.side, self.limits = side, limits
        self.left_levels, self.right_levels = left_levels, right_levels
        self.counts, self.flat, self.shapes = counts, flat, shapes

    @property
    def rows(self) -> int:
        return max(self.counts)

    @property
    def shared(self) -> tuple[bool, bool]:
        """Whether most rows of a side are copies, going by an estimate of its distinct boxes."""
        return tuple(n >= COPIES * max(1, d) for n, d in zip(self.counts, self.shapes))

    def of_places(self, shared: tuple[bool, bool]) -> "Grid":
        counts = [d if s else n for n, d, s in zip(self.counts, self.shapes, shared)]
        return Grid(self.side, self.limits, self.left_levels, self.right_levels, counts, self.flat, counts)

    @staticmethod
    def measure(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, side: float | None = None) -> "Grid":
        """Read a histogram of feature sizes by powers of two (at most some hundred rows) from both inputs."""
        found = [_size_histogram(df, g) for df, g in ((left, left_geom), (right, right_geom))]
        hist = [{k: n for k, (n, _) in h.items()} for h in found]
        if side is None:
            sized = sorted((k, n) for h in hist for k, n in h.items() if k is not None)
            total, seen = sum(n for _, n in sized), 0
            k = 0
            for k, n in sized:
                seen += n
                if seen >= 0.5 * total:
                    break
            side = 2.0**k
        largest = max((k for h in hist for k in h if k is not None), default=0)
        limits = _level_limits(side, largest)
        levels = [sorted({_level_of(k, limits) for k in h}) for h in hist]
        counts = [sum(h.values()) for h in hist]
        flat = tuple(set(h) <= {None} for h in hist)
        shapes = [sum(d for _, d in h.values()) for h in found]
        return Grid(side, limits, levels[0] or [0], levels[1] or [0], counts, flat, shapes)


def _extent(geom: str) -> Column:
    b = F.col(geom)["bbox"]
    return F.greatest(b["east"] - b["west"], b["north"] - b["south"])


def _size_class(geom: str) -> Column:
    """Power of two that bounds the extent, null for a point. Levels are derived from it alone, in both places."""
    size = _extent(geom)
    return F.when(size > 0, F.ceil(F.log2(size)))


def _level_limits(side: float, largest: int) -> list[int]:
    """Greatest size class of each level, from level 0 up to the one that takes the largest class."""
    base, step = math.log2(side) + math.log2(REACH), math.log2(GROW)
    limits = [math.floor(base)]
    while limits[-1] < largest:
        limits.append(math.floor(base + step * len(limits)))
    return limits


def _level_of(size_class, limits: list[int]) -> int:
    return 0 if size_class is None else next(i for i, top in enumerate(limits) if size_class <= top)


def _size_histogram(df: DataFrame, geom: str) -> dict:
    """Rows and about how many distinct boxes of each size class."""
    boxes = F.approx_count_distinct(F.xxhash64(F.col(geom)["bbox"]))
    rows = df.filter(is_valid(geom)).groupBy(_size_class(geom).alias("k")).agg(F.count(F.lit(1)).alias("n"), boxes.alias("d")).collect()
    return {r["k"]: (r["n"], r["d"]) for r in rows}


def place_key(geom: str, keys: list[str] = ()) -> Column:
    """128 bits of a shape and of the ``keys`` beside it; rows with the same are at one place."""
    # Lengths of rings are hashed too: a hash runs over arrays without their ends.
    parts = [F.col(geom), F.transform(F.col(geom)["rings"], lambda g: F.size(g["pts"])), *[F.col(f"`{k}`") for k in keys]]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def places(df: DataFrame, geom: str, name: str, keys: list[str] = ()) -> DataFrame:
    """The distinct shapes with their ``keys`` and their :func:`place_key`; rows with a null key match nothing and are left out."""
    rows = df.filter(is_valid(geom)).select(geom, *keys)
    rows = rows.dropna(subset=list(keys)) if keys else rows
    return rows.distinct().withColumn(name, place_key(geom, keys))


def with_place(df: DataFrame, geom: str, keys: list[str] = ()) -> DataFrame:
    """Rows with ``__lp``, their :func:`place_key`: null without a shape or with a null key, as such rows match nothing."""
    there = is_valid(geom)
    for k in keys:
        there = there & F.col(f"`{k}`").isNotNull()
    return df.withColumn("__lp", F.when(there, place_key(geom, keys)))


def meeting_places(
    left: DataFrame, right: DataFrame, *, left_geom: str = "geom", right_geom: str = "geom", equal: list[tuple[str, str]] | None = None, **options
) -> DataFrame:
    """Pairs of distinct shapes that meet: ``__lp`` and ``__rp`` (:func:`place_key` over the shape and the ``equal`` keys), and
    the shapes as ``__lg`` and ``__rg``. Copies of a shape do not multiply here."""
    equal = equal or []
    l = places(left, left_geom, "__lp", [a for a, _ in equal])
    r = places(right, right_geom, "__rp", [b for _, b in equal])
    options.pop("left_id", None), options.pop("right_id", None)
    pairs = spatial_pairs(
        l, r, left_id="__lp", right_id="__rp", left_geom=left_geom, right_geom=right_geom, right_prefix="__r_", equal=equal, by_place=False, **options
    )
    return pairs.select("__lp", F.col("__r___rp").alias("__rp"), F.col(left_geom).alias("__lg"), F.col("__r_" + right_geom).alias("__rg"))


def _cells(df: DataFrame, geom: str, grid: Grid, mine: list[int], other: list[int], flat: bool, first: bool) -> DataFrame:
    """Rows with ``__role, __level, __gx, __gy``.

    Role A pairs a left feature at home with any right one, role B a visiting left feature with a right one at home.
    """
    b = F.col(geom)["bbox"]
    if flat and set(other) | set(mine) == {0}:
        return df.withColumns(
            {
                "__role": F.lit("A"),
                "__level": F.lit(0),
                "__gx": F.floor(b["west"] / F.lit(grid.side)),
                "__gy": F.floor(b["south"] / F.lit(grid.side)),
            }
        )
    levels = sorted(set(mine) | set(other))
    own = F.lit(0)
    for level in range(1, max(levels) + 1):
        own = F.when(_size_class(geom) > grid.limits[level - 1], F.lit(level)).otherwise(own)
    out = df.withColumn("__own", own)
    spans = []
    for level in levels:
        cell = F.lit(grid.side * float(GROW) ** level)
        xs = F.sequence(F.floor(b["west"] / cell), F.floor(b["east"] / cell))
        ys = F.sequence(F.floor(b["south"] / cell), F.floor(b["north"] / cell))

        def grid_of(role: str, xs=xs, ys=ys, level=level) -> Column:
            return F.flatten(
                F.transform(
                    xs,
                    lambda gx: F.transform(
                        ys,
                        lambda gy: F.struct(
                            F.lit(role).alias("role"), F.lit(level).alias("level"), gx.alias("gx"), gy.alias("gy")
                        ),
                    ),
                )
            )

        nothing = F.expr("cast(array() as array<struct<role:string,level:int,gx:bigint,gy:bigint>>)")
        home, visit = F.col("__own") == level, F.col("__own") < level
        lower_right_partner = any(k < level for k in other)
        if first:
            at_home = grid_of("A")
            visiting = grid_of("B") if level in other else nothing
        else:
            at_home = F.concat(grid_of("A"), grid_of("B")) if lower_right_partner else grid_of("A")
            visiting = grid_of("A") if level in other else nothing
        spans.append(F.when(home, at_home).when(visit, visiting).otherwise(nothing))
    cells = spans[0] if len(spans) == 1 else F.concat(*spans)
    out = out.withColumn("__cell", F.explode(cells))
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col("__cell.role").alias("__role"),
        F.col("__cell.level").alias("__level"),
        F.col("__cell.gx").alias("__gx"),
        F.col("__cell.gy").alias("__gy"),
    )


BROADCAST_CELLS = 100_000
KEYS = ["__role", "__level", "__gx", "__gy"]


def _split_hot(left: DataFrame, right: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Split cells with more than ``hot_rows`` rows: each side's rows get one of the side's shares and are copied to
    every share of the other side, so each pair still meets exactly once.

    The hot cells are found once and written. They are broadcast if they are counted to be few, else joined by shuffle.
    """
    counts = (
        left.select(*KEYS, F.lit(1).alias("__l"), F.lit(0).alias("__r"))
        .unionByName(right.select(*KEYS, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
        .groupBy(*KEYS)
        .agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
        .filter((F.col("__l") > hot_rows) | (F.col("__r") > hot_rows))
        .select(
            *KEYS,
            F.ceil(F.col("__l") / hot_rows).cast("int").alias("__ls"),
            F.ceil(F.col("__r") / hot_rows).cast("int").alias("__rs"),
        )
    )

    counts = cut_lineage(counts)
    if counts.count() <= BROADCAST_CELLS:
        counts = F.broadcast(counts)

    def spread(df: DataFrame, own: str, other: str, own_key: str, other_key: str, id_cols: list[str]) -> DataFrame:
        joined = df.join(counts, KEYS, "left")
        shares = F.greatest(F.coalesce(F.col(own), F.lit(1)), F.lit(1))
        copies = F.greatest(F.coalesce(F.col(other), F.lit(1)), F.lit(1))
        return joined.withColumn(
            own_key, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in id_cols]), shares).cast("int")
        ).withColumn(other_key, F.explode(F.sequence(F.lit(0), copies - 1))).drop("__ls", "__rs")

    l_ids = [c for c in left.columns if c.endswith("__lrow")]
    r_ids = [c for c in right.columns if c.endswith("__rrow")]
    return (
        spread(left, "__ls", "__rs", "__a", "__b", l_ids),
        spread(right, "__rs", "__ls", "__b", "__a", r_ids),
        ["__a", "__b"],
    )


def spatial_pairs(
    left: DataFrame,
    right: DataFrame,
    *,
    left_id: str,
    right_id: str,
    left_geom: str = "geom",
    right_geom: str = "geom",
    right_prefix: str = "anno_",
    predicate: str = "intersects",
    on: Column | None = None,
    equal: list[tuple[str, str]] | None = None,
    grid: Grid | None = None,
    cell_side: float | None = None,
    hot_rows: int = HOT_ROWS,
    by_place: bool | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """All matching pairs: every left column, and every right column under ``right_prefix``.

    ``predicate`` is ``intersects``, ``bbox`` or ``within`` (left in right). ``equal`` adds equi keys, ``on`` any
    further condition over the output columns. ``by_place`` joins distinct shapes and puts the rows to them; by default
    it is done for a side that holds mostly copies. ``tasks`` is for pairs that are more work than their bytes tell.
    """
    if predicate not in ("intersects", "bbox", "within"):
        raise ValueError(f"unknown predicate {predicate!r}")
    if grid is None:
        grid = Grid.measure(left, right, left_geom, right_geom, cell_side)
    few = min(grid.counts) <= FEW_ROWS
    shared = grid.shared if by_place is None else (by_place, by_place)
    # A few rows are compared with all others anyway; a test of boxes alone costs less than putting rows to shapes.
    if any(shared) and not (few and predicate == "bbox"):
        return _pairs_by_place(left, right, left_id, right_id, left_geom, right_geom, right_prefix, predicate, on, equal or [], grid, hot_rows, shared)
    renamed = right.select([F.col(f"`{c}`").alias(right_prefix + c) for c in right.columns])
    rg, lg = right_prefix + right_geom, left_geom
    if few and not equal:
        small = renamed if grid.counts[1] <= grid.counts[0] else left
        valid = [df.filter(is_valid(g)) for df, g in ((left, lg), (renamed, rg))]
        if _vertices(*((renamed, rg) if small is renamed else (left, lg))) <= FEW_VERTICES:
            a, b = (valid[0], F.broadcast(valid[1])) if small is renamed else (F.broadcast(valid[0]), valid[1])
            return _settled(a.join(b, bbox_overlap(f"{lg}.bbox", f"{rg}.bbox")), left, renamed, lg, rg, predicate, on)
    l = _cells(left.filter(is_valid(lg)), lg, grid, grid.left_levels, grid.right_levels, grid.flat[0], True)
    r = _cells(renamed.filter(is_valid(rg)), rg, grid, grid.right_levels, grid.left_levels, grid.flat[1], False)
    keys = list(KEYS)
    if grid.rows > hot_rows:
        l, r, salts = _split_hot(
            l.withColumn("__lrow", F.col(left_id)), r.withColumn("__rrow", F.col(right_prefix + right_id)), hot_rows
        )
        keys += salts
    for i, (a, b) in enumerate(equal or []):
        l, r = l.withColumn(f"__e{i}", F.col(a)), r.withColumn(f"__e{i}", F.col(right_prefix + b))
        keys.append(f"__e{i}")
    if tasks:
        l, r = l.repartition(tasks, *keys), r.repartition(tasks, *keys)
    # The size that Spark expects of a side knows neither its cells nor its shapes, so it may not pick a broadcast by it.
    if grid.rows > SMALL_ROWS:
        r = r.hint("merge")
    joined = l.join(r, keys, "inner").filter(bbox_overlap(f"{lg}.bbox", f"{rg}.bbox"))
    lb, rb = F.col(lg)["bbox"], F.col(rg)["bbox"]
    side = F.lit(grid.side) * F.pow(F.lit(float(GROW)), F.col("__level"))
    one_level = set(grid.left_levels) | set(grid.right_levels) == {0}
    if one_level:
        side = F.lit(grid.side)
    if not (one_level and any(grid.flat)):
        # A point sits in one cell only, so its pairs need no such test.
        joined = joined.filter(
            (F.floor(F.greatest(lb["west"], rb["west"]) / side) == F.col("__gx"))
            & (F.floor(F.greatest(lb["south"], rb["south"]) / side) == F.col("__gy"))
        )
    return _settled(joined, left, renamed, lg, rg, predicate, on)


def _settled(joined: DataFrame, left: DataFrame, renamed: DataFrame, lg: str, rg: str, predicate: str, on: Column | None) -> DataFrame:
    """Candidates that fulfil ``on`` and the predicate, with the columns of both sides."""
    if on is not None:
        joined = joined.filter(on)
    # Spark puts a filter over a join before the join's own condition, so the boxes are asked about here once more.
    near = bbox_overlap(f"{lg}.bbox", f"{rg}.bbox")
    if predicate == "intersects":
        joined = joined.filter(F.when(near, (F.col(lg)["is_box"] & F.col(rg)["is_box"]) | intersects_exact(lg, rg)).otherwise(False))
    elif predicate == "within":
        joined = joined.filter(F.when(near, within(lg, rg)).otherwise(False))
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"`{c}`") for c in renamed.columns])


def _vertices(df: DataFrame, geom: str) -> int:
    """Vertices of all shapes of a small frame."""
    each = F.aggregate(F.col(geom)["rings"], F.lit(0).cast("bigint"), lambda n, g: n + F.size(g["pts"]))
    return df.agg(F.sum(F.coalesce(each, F.lit(0).cast("bigint")))).collect()[0][0] or 0


def _pairs_by_place(left, right, left_id, right_id, left_geom, right_geom, right_prefix, predicate, on, equal, grid, hot_rows, shared) -> DataFrame:
    """The pairs of :func:`spatial_pairs`, where the sides that are ``shared`` go into the join as distinct shapes."""
    keys = [[a for a, _ in equal], [b for _, b in equal]]
    inputs = list(zip((left, right), (left_geom, right_geom), ("__lp", "__rp"), keys, shared))
    l, r = (places(df, geom, name, k) if many else df for df, geom, name, k, many in inputs)
    ids = ["__lp" if shared[0] else left_id, "__rp" if shared[1] else right_id]
    pairs = spatial_pairs(
        l, r, left_id=ids[0], right_id=ids[1], left_geom=left_geom, right_geom=right_geom, right_prefix=right_prefix, predicate=predicate,
        equal=equal, grid=grid.of_places(shared), hot_rows=hot_rows, by_place=False,
    )
    renamed = [f"{right_prefix}{c}" for c in right.columns]
    kept = (["__lp"] if shared[0] else left.columns) + ([right_prefix + "__rp"] if shared[1] else renamed)
    pairs = pairs.select(*[F.col(f"`{c}`") for c in kept])
    # The side with fewer copies first, so that the rows in between are fewer.
    order = sorted((i for i in (0, 1) if shared[i]), key=lambda i: grid.counts[i] / max(1, grid.shapes[i]))
    for i in order:
        df, geom, name, k, _ = inputs[i]
        prefix = right_prefix if i else ""
        rows = df.filter(is_valid(geom)).withColumn(name, place_key(geom, k))
        rows = rows.select([F.col(f"`{c}`").alias(prefix + c) for c in rows.columns])
        pairs = pairs.join(rows.hint("merge"), prefix + name)
    pairs = pairs.select(*[F.col(f"`{c}`") for c in (*left.columns, *renamed)])
    return pairs if on is None else pairs.filter(on)


def spatial_join(left: DataFrame, right: DataFrame, how: str = "inner", **options) -> DataFrame:
    """Inner, left, left_semi or left_anti spatial join; see :func:`spatial_pairs` for the options.

    ``left_id`` has to be unique for all but the inner join.
    """
    if how == "inner":
        return spatial_pairs(left, right, **options)
    if how not in ("left_semi", "left_anti", "left"):
        raise ValueError(f"unknown join type {how!r}")
    if options.get("on") is None:
        # One answer for each distinct shape.
        keys = [a for a, _ in options.get("equal") or []]
        slim = {k: v for k, v in options.items() if k not in ("right_prefix", "on", "by_place")}
        matched = meeting_places(left, right, **slim).select("__lp").distinct().hint("merge")
        known = with_place(left, options.get("left_geom", "geom"), keys)
        met = lambda kind: known.join(matched, "__lp", kind).drop("__lp")
    else:
        # Matched ids are reduced before the shuffle, so a feature with very many partners is one row here.
        matched = spatial_pairs(left, right, **options).select(options["left_id"]).distinct()
        met = lambda kind: left.join(matched, options["left_id"], kind)
    if how == "left":
        return spatial_pairs(left, right, **options).unionByName(met("left_anti"), allowMissingColumns=True)
    return met(how)

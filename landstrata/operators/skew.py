"""Grouped and ordered work that stays spread out when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from landstrata.session import cut_lineage

SALTS = 16
#: Rows of a group that one window takes; larger groups are cut into ranges.
LIMIT = 200_000


def first_per_group(df: DataFrame, keys: list[str], order: list[str], descending: bool = False) -> DataFrame:
    """One whole row per group, the least (or greatest) by ``order``.

    The pick is an aggregate, so each task first reduces its own rows and a hot group never lands in one task.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    by = F.struct(*[F.col(f"`{c}`") for c in order])
    pick = F.max_by(row, by) if descending else F.min_by(row, by)
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(pick.alias("__row")).select("__row.*")


def attach_group_values(
    df: DataFrame, values: DataFrame, keys: list[str], spread: Column, salts: int = SALTS, how: str = "inner"
) -> DataFrame:
    """Join one-row-per-group values to their rows; hot groups are spread over ``salts`` by a row expression."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = values.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def in_ranges(df: DataFrame, keys: list[str], order: list[str], limit: int = LIMIT) -> tuple[DataFrame, bool]:
    """Add ``__range``: null in groups of at most ``limit`` rows, else the number of the range of ``order`` that a row is in.

    Groups are counted first. Only those over ``limit`` are cut, at every 64th of a sample of their rows, into ranges of
    about ``limit`` rows; so there are at most rows / ``limit`` bounds, which is why they are broadcast. Equal values of ``order`` are cut further by the row's hash; only rows that are equal throughout
    stay together. The flag tells whether any group was cut. ``df`` is read for the counts and, where a group is cut,
    for the sample, so it should be a table or a few steps from one. Null keys form a group.
    """
    big = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > limit))
    if big.isEmpty():
        return df.withColumn("__range", F.lit(None).cast("int")), False
    values = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)]
    every = min(64, limit)
    # The cuts are written, so any sample does.
    sample = df.sample(every / limit, seed=7)
    place = F.struct(*values, row_hash(df).alias("h"))
    sample = join_null_safe(sample.select(*keys, place.alias("__place")), F.broadcast(big.drop("__size")), keys) if keys else sample.select(place.alias("__place"))
    cuts = sample.groupBy(*keys).agg(F.array_sort(F.collect_list("__place")).alias("__all"))
    cuts = cut_lineage(cuts.select(*keys, F.filter("__all", lambda x, i: i % every == every - 1).alias("__cuts")))
    # Where no two cuts share a value of ``order`` it tells the ranges alone, and the rows need not be hashed.
    by_order = lambda x: F.struct(*[x[f"o{i}"].alias(f"o{i}") for i in range(len(order))])
    alone = F.transform("__cuts", by_order)
    if cuts.where(F.size("__cuts") != F.size(F.array_distinct(alone))).isEmpty():
        place, cuts = F.struct(*values), cuts.withColumn("__cuts", alone)
    # Looked up in two steps: first among every ``step``th cut, then among the ``step`` cuts that follow it.
    step = F.greatest(F.lit(1), F.sqrt(F.size("__cuts")).cast("int"))
    cuts = cut_lineage(cuts.select(*keys, F.struct(F.filter("__cuts", lambda x, i: i % step == step - 1).alias("some"), F.col("__cuts").alias("all"), step.alias("step")).alias("__cuts")))
    rows = join_null_safe(df, F.broadcast(cuts), keys, "left") if keys else df.withColumn("__cuts", cuts.select("__cuts").scalar())
    c = F.col("__cuts")

    def number(p: Column) -> Column:
        below = lambda b: b <= p
        first = F.size(F.filter(c["some"], below)) * c["step"]
        return F.get(F.transform(F.array(first), lambda f: f + F.size(F.filter(F.slice(c["all"], f + 1, c["step"]), below))), F.lit(0))

    # The place is worked out once for a row, not for each cut; the generator's output once, not in each filter on it.
    found = F.when(c.isNotNull(), F.get(F.transform(F.array(place), number), F.lit(0)))
    return rows.withColumn("__range", F.explode_outer(F.array(found))).drop("__cuts"), True


def _part(keys: list[str], split: bool) -> list[str]:
    return [*[f"`{k}`" for k in keys], *(["__range"] if split else [])]


def running(
    df: DataFrame, keys: list[str], order: list[str], totals: dict[str, tuple[str, Column]], inclusive: bool = True, limit: int = LIMIT
) -> DataFrame:
    """Running ``sum`` or ``bit_xor`` of all rows up to each one (without it if not ``inclusive``) in its group, in ``order``.

    ``totals`` maps a name to the function and its column; null is 0. Groups of at most ``limit`` rows are one plain
    window, so one exchange. Larger ones work in ranges (:func:`in_ranges`) and add what earlier ranges hold, one small
    row for each range. ``order`` should tell rows apart, else equal ones come in any order.
    """
    rows, split = in_ranges(df, keys, order, limit)
    window = Window.partitionBy(*_part(keys, split)).orderBy(*[f"`{c}`" for c in order]).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    whole = {n: F.call_function(f, c) for n, (f, c) in totals.items()}
    out = rows.withColumns({n: F.coalesce(a.over(window), F.lit(0)) for n, a in whole.items()})
    if not split:
        return out.drop("__range")
    parts = rows.where("__range is not null").groupBy(*_part(keys, split)).agg(*[a.alias(f"__{n}") for n, a in whole.items()])
    before = Window.partitionBy(*_part(keys, False)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({f"__{n}": F.call_function(f, F.col(f"__{n}")).over(before) for n, (f, _) in totals.items()})
    # One row a range: rows / limit at most.
    out = join_null_safe(out, F.broadcast(parts), [*keys, "__range"], "left")
    add = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    out = out.withColumns({n: add[f](F.col(n), F.coalesce(F.col(f"__{n}"), F.lit(0))) for n, (f, _) in totals.items()})
    return out.drop("__range", *[f"__{n}" for n in totals])


def neighbors_in_order(df: DataFrame, keys: list[str], order: list[str], column: str, circular: bool = False, limit: int = LIMIT) -> DataFrame:
    """Add ``prev`` and ``next``: ``column`` of the rows before and after in the group; the ends meet if ``circular``, else get null.

    One exchange for groups of at most ``limit`` rows; larger ones work in ranges, whose first and last rows are the seam.
    """
    rows, split = in_ranges(df, keys, order, limit)
    by = [f"`{c}`" for c in order]
    window = Window.partitionBy(*_part(keys, split)).orderBy(*by)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = F.struct(F.col(f"`{column}`").alias("v"))  # never null itself: a null row and no row differ
    out = rows.withColumns({"prev": F.lag(v).over(window), "next": F.lead(v).over(window)})
    if not split:
        if circular:
            out = out.withColumns({"prev": F.coalesce("prev", F.last(v).over(whole)), "next": F.coalesce("next", F.first(v).over(whole))})
        return out.withColumns({"prev": F.col("prev.v"), "next": F.col("next.v")}).drop("__range")
    at = F.struct(*[F.col(c) for c in by])
    ends = rows.groupBy(*_part(keys, split)).agg(F.min_by(v, at).alias("__first"), F.max_by(v, at).alias("__last"))
    if not circular:
        ends = ends.where("__range is not null")
    across = Window.partitionBy(*_part(keys, False)).orderBy("__range")
    group = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back, on = F.lag("__last").over(across), F.lead("__first").over(across)
    if circular:
        back, on = F.coalesce(back, F.last("__last").over(group)), F.coalesce(on, F.first("__first").over(group))
    ends = ends.select(*_part(keys, split), back.alias("__back"), on.alias("__on"))
    out = join_null_safe(out, ends if circular else F.broadcast(ends), [*keys, "__range"], "left")
    return out.withColumns({"prev": F.coalesce("prev", "__back")["v"], "next": F.coalesce("next", "__on")["v"]}).drop("__range", "__back", "__on")


def number_rows(
    df: DataFrame,
    order: str,
    keys: list[str] | None = None,
    ties: list[str] | None = None,
    name: str = "n",
    limit: int = LIMIT,
) -> DataFrame:
    """Running number from 1 within each group, as ``row_number`` gives, without one task for a large group.

    ``ties`` settle equal values of ``order``, which may be any sortable column.
    """
    return running(df, keys or [], [order, *(ties or [])], {name: ("sum", F.lit(1).cast("bigint"))}, limit=limit)


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's values (maps left out, which Spark does not hash); the same in every attempt of a task."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t])


def join_null_safe(df: DataFrame, values: DataFrame, keys: list[str], how: str = "inner", salts: int = 1) -> DataFrame:
    """Join per-group values to rows where a null key is a group of its own; ``salts`` spreads hot groups."""
    if salts > 1:
        df = df.withColumn("__salt", F.pmod(row_hash(df), F.lit(salts)).cast("int"))
        values = values.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return join_null_safe(df, values, [*keys, "__salt"], how).drop("__salt")
    renamed = values.withColumnsRenamed({k: f"__on_{k}" for k in keys})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__on_{k}`")) for k in keys]
    return df.join(renamed, same, how).drop(*[f"__on_{k}" for k in keys])

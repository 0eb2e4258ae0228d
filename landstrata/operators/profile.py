"""Layer profiles: counts, keys, value frequencies, crosstabs, series statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from landstrata.functions.props import value_of
from landstrata.functions.text import leaf
from landstrata.operators.skew import LIMIT, SALTS, first_per_group, in_ranges, join_null_safe


def count_by(df: DataFrame, *keys, name: str = "n") -> DataFrame:
    """``count(*)`` by keys, most frequent first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name))


def non_null_counts(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    columns = columns or [c for c in df.columns if c != key]
    return df.groupBy(key).agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns])


def value_frequency(df: DataFrame, key: str, props: str = "properties") -> DataFrame:
    return df.groupBy(value_of(F.col(props), key).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def key_frequency(df: DataFrame, props: str = "properties", keys: list[str] | None = None) -> DataFrame:
    named = df.select(*(keys or []), F.explode(F.map_keys(props)).alias("key"))
    return named.groupBy(*(keys or []), "key").agg(F.count(F.lit(1)).alias("n"))


def key_union(df: DataFrame, props: str = "properties", layer: str | None = None) -> DataFrame:
    """Sorted property keys of a layer, one array per group; keys are reduced to distinct ones first."""
    groups = [layer] if layer else []
    distinct = df.select(*groups, F.explode(F.map_keys(props)).alias("key")).distinct()
    return distinct.groupBy(*groups).agg(F.array_sort(F.collect_list("key")).alias("keys"))


def crosstab(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Sums of ``value`` by ``row``, one column per listed value of ``column``."""
    return df.groupBy(row).pivot(column, columns).agg(F.sum(value))


def normalize_by_max(df: DataFrame, columns: list[str], keys: list[str] | None = None, suffix: str = "_normalized") -> DataFrame:
    """Each column over its greatest value in the table or group."""
    keys = keys or []
    tops = df.groupBy(*keys).agg(*[F.max(c).alias(f"__max_{c}") for c in columns])
    if keys:
        joined = join_null_safe(df, tops, keys, salts=SALTS)
    else:
        # One aggregate row, read as a scalar subquery: no join and no window over the whole table.
        row = tops.select(F.struct(*tops.columns).alias("t")).scalar()
        joined = df.withColumn("__tops", row)
        joined = joined.withColumns({c: F.col("__tops")[c] for c in tops.columns}).drop("__tops")
    out = joined.withColumns({c + suffix: F.try_divide(F.col(c).cast("double"), F.col(f"__max_{c}")) for c in columns})
    return out.drop(*[f"__max_{c}" for c in columns])


def merge_distances(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """Sum of two columns, then all three over their greatest values."""
    return normalize_by_max(df.withColumn(name, F.col(first) + F.col(second)), [first, second, name])


def first_of_layers(df: DataFrame, fields: dict[str, list[str]], position: str = "pos", layer: str = "layer", document: str = "feature") -> DataFrame:
    """Chosen nested fields of the first feature of each layer; ``fields`` maps output names to paths."""
    first = first_per_group(df, [layer], [position])
    return first.select(layer, *[leaf(F.col(document), path).alias(name) for name, path in fields.items()])


def expanding_stats(df: DataFrame, order: str, value: str, keys: list[str] | None = None, ties: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """Count, mean and sample deviation of all earlier rows of a series.

    A series of at most ``limit`` rows is one window. Larger ones are handled inside ranges of the order; what earlier
    ranges contribute is combined from their count, mean and squared deviation, one small row for each range.
    """
    keys = keys or []
    by = [order, *(ties or [])]
    rows, split = in_ranges(df, keys, by, limit)
    part = [*keys, *(["__range"] if split else [])]
    # Sums of squares around 0 would lose digits: shift by a mean, of the series or of its first range.
    whole = F.avg(value).over(Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    if split:
        parts = rows.where("__range is not null").groupBy(*part).agg(F.count(value).alias("__n"), F.avg(value).alias("__m"), F.var_pop(value).alias("__v"))
        across = Window.partitionBy(*keys).orderBy("__range")
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        shift = F.first("__m", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        parts = parts.withColumn("__shift", shift)
        dev = F.col("__m") - F.col("__shift")
        sums = {"__cn": F.col("__n"), "__c1": F.col("__n") * dev, "__c2": F.col("__n") * (F.col("__v") + dev * dev)}
        earlier = parts.select(*part, "__shift", *[F.sum(c).over(before).alias(n) for n, c in sums.items()])
        rows = join_null_safe(rows, F.broadcast(earlier), part, "left").withColumn("__shift", F.coalesce("__shift", whole))
    else:
        rows = rows.withColumns({"__shift": whole, **{n: F.lit(None).cast("double") for n in ("__cn", "__c1", "__c2")}})
    inner = Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    d = F.col(value) - F.col("__shift")
    sum_of = lambda c, earlier: F.coalesce(F.sum(c).over(inner), F.lit(0.0)) + F.coalesce(F.col(earlier), F.lit(0.0))
    n = F.count(value).over(inner) + F.coalesce(F.col("__cn").cast("bigint"), F.lit(0))
    out = rows.withColumns({"n_before": n, "__s1": sum_of(d, "__c1"), "__s2": sum_of(d * d, "__c2")})
    n, s1, s2 = F.col("n_before"), F.col("__s1"), F.col("__s2")
    return out.withColumns(
        {
            "mean_before": F.when(n > 0, F.col("__shift") + s1 / n),
            "std_before": F.when(n > 1, F.sqrt(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)) / (n - 1))),
        }
    ).drop("__range", "__shift", "__cn", "__c1", "__c2", "__s1", "__s2")

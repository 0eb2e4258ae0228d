"""Labels: which features carry one, and what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from landstrata.functions.props import map_merge, props_or_empty, value_of
from landstrata.operators.skew import join_null_safe, number_rows


def has_label(label: Column) -> Column:
    return F.coalesce(label.isNotNull() & (label != ""), F.lit(False))


def one_per_value(df: DataFrame, label: str, id_col: str = "feature_id", keys: list[str] | None = None) -> DataFrame:
    """Rows whose id is the least of their label value; rows without a label go."""
    keys = keys or []
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    kept = df.filter(has_label(F.col(label))).groupBy(*keys, label).agg(F.min_by(row, id_col).alias("__r"))
    return kept.select("__r.*")


def blank_repeats(
    df: DataFrame, label: str, id_col: str = "feature_id", keys: list[str] | None = None, seed: int | None = None
) -> DataFrame:
    """All rows, the label kept on one of each value and nulled on the others; empty labels stay.

    The kept row is the one with the least id, or with ``seed`` the least of a hash of it. The keepers are found by an
    aggregate and joined back on the unique id, so a label on very many rows is no hot key.
    """
    keys = keys or []
    by = F.col(id_col) if seed is None else F.struct(F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col))
    keepers = (
        df.filter(has_label(F.col(label)))
        .groupBy(*keys, label)
        .agg(F.min_by(id_col, by).alias(id_col))
        .select(*keys, id_col, F.lit(True).alias("__keep"))
    )
    joined = join_null_safe(df, keepers, [*keys, id_col], "left")
    kept = F.col("__keep").isNotNull() | ~has_label(F.col(label))
    return joined.withColumn(label, F.when(kept, F.col(label))).select(df.columns)


def fill_labels(
    df: DataFrame, key: str, prefix: str, position: str, keys: list[str] | None = None, start: int = 1, props: str = "properties", blank_only: bool = True
) -> DataFrame:
    """Synthetic label ``{prefix}_{n}`` where the property is missing, null or ``''``; ``n`` counts all features.

    With ``blank_only=False`` only an absent key is filled.
    """
    numbered = number_rows(df, position, keys, name="__n")
    p = props_or_empty(F.col(props))
    missing = ~has_label(value_of(p, key)) if blank_only else ~F.map_contains_key(p, key)
    label = F.concat(F.lit(f"{prefix}_"), (F.col("__n") + (start - 1)).cast("string"))
    return numbered.withColumn(props, F.when(missing, map_merge(p, F.create_map(F.lit(key), label))).otherwise(p)).drop("__n")


def cap(df: DataFrame, position: str, n: int, keys: list[str] | None = None) -> DataFrame:
    """At most ``n`` rows per group, first by ``position``.

    Each task keeps its own first ``n`` of a group before the shuffle, so no group has to fit one task.
    """
    order = Window.partitionBy(*(keys or [])).orderBy(position)
    return df.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n")


def sample_by_id(df: DataFrame, id_col: str, rate: int = 5) -> DataFrame:
    """Features whose id is a multiple of ``rate``."""
    return df.filter(F.col(id_col) % rate == 0)

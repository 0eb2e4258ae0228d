"""Property map helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

EMPTY = "cast(map() as map<string,string>)"
WHITESPACE = " \t\n\r\f\v"


def props_or_empty(props: Column) -> Column:
    return F.coalesce(props, F.expr(EMPTY))


def map_merge(base: Column, over: Column) -> Column:
    """``base`` with every key of ``over`` written on top; works under the default duplicate-key policy."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def value_of(props: Column, key: str) -> Column:
    """Value of ``key``; null when it is absent or null."""
    return F.try_element_at(props, F.lit(key))


def column_names(keys: Iterable[str], taken: set[str]) -> dict[str, str]:
    """A column name for each property key that no other has, whatever its case: the key, or with ``property_`` and a number."""
    used, out = {t.lower() for t in taken}, {}
    for k in keys:
        name, n = k, 1
        while name.lower() in used:
            name, n = f"property_{k}" if n == 1 else f"property_{k}_{n}", n + 1
        used.add(name.lower())
        out[k] = name
    return out


def keep_keys(props: Column, keys: Iterable[str]) -> Column:
    names = list(keys)
    return F.map_filter(props, lambda k, v: k.isin(names))


def truthy_only(props: Column, falsy_keys: Column | None = None) -> Column:
    """Entries that may overwrite: not null, not ``''`` and not named in ``falsy_keys``.

    ``falsy_keys`` lists the keys whose JSON value was a zero or ``false``; text values carry no type of their own.
    """
    if falsy_keys is None:
        return F.map_filter(props, lambda k, v: v.isNotNull() & (v != ""))
    return F.map_filter(
        props, lambda k, v: v.isNotNull() & (v != "") & ~F.coalesce(F.array_contains(falsy_keys, k), F.lit(False))
    )


def literal_map(pairs: dict) -> Column:
    """A literal text map, or an empty one."""
    if not pairs:
        return F.expr(EMPTY)
    cells: list[Column] = []
    for key, value in pairs.items():
        cells += [F.lit(str(key)), as_text(value)]
    return F.create_map(*cells)


def as_text(value) -> Column:
    """A configuration value as it reads in a text property."""
    if value is None:
        return F.lit(None).cast("string")
    if isinstance(value, bool):
        return F.lit("true" if value else "false")
    return F.lit(str(value))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def props_from_columns(columns: Iterable[str]) -> Column:
    """Record columns as a property map (all of them, nulls kept)."""
    cells: list[Column] = []
    for name in columns:
        cells += [F.lit(name), F.col(f"`{name}`").cast("string")]
    return F.create_map(*cells) if cells else F.expr(EMPTY)

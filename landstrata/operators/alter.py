"""Attribute clean-up rules of a layer, compiled from their JSON form to column expressions.

A rule set has up to three parts, run in this order: ``canonicalize``, ``vector_width``, ``filter``. Only the keys a
rule set names are taken out of the property map; the map is rebuilt once at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from landstrata.functions.geometry import centroid
from landstrata.functions.props import as_text, literal_map, map_merge, props_or_empty, strip, value_of

KNOWN_PARTS = {"canonicalize", "vector_width", "filter"}


def alter(df: DataFrame, conf: dict, props: str = "properties", strict: bool = True) -> DataFrame:
    """Apply a rule set to a property map column; rows may be dropped by its filters."""
    unknown = set(conf) - KNOWN_PARTS
    if unknown and strict:
        raise ValueError(f"unknown alteration parts {sorted(unknown)}")
    keys = _touched(conf)
    value = {k: f"__v{i}" for i, k in enumerate(keys)}
    present = {k: f"__p{i}" for i, k in enumerate(keys)}
    base = props_or_empty(F.col(props))
    out = df.withColumns(
        {value[k]: F.try_element_at(base, F.lit(k)) for k in keys}
        | {present[k]: F.map_contains_key(base, k) for k in keys}
    )
    for rule in conf.get("canonicalize", []):
        out = out.withColumns(_canonicalize(rule, value, present))
    if "vector_width" in conf:
        out = out.withColumns(_width(conf["vector_width"], value, present))
    for rule in conf.get("filter", []):
        out = out.filter(filter_condition(rule, lambda k: F.col(value[k])))
    if keys:
        untouched = F.map_filter(base, lambda k, v: ~k.isin(keys))
        entries = F.filter(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("key"), F.col(value[k]).alias("value"), F.col(present[k]).alias("present")
                    )
                    for k in keys
                ]
            ),
            lambda e: e["present"],
        )
        rebuilt = F.map_from_entries(
            F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
        )
        out = out.withColumn(props, F.map_concat(untouched, rebuilt))
    return out.drop(*value.values(), *present.values())


def _sources(rule: dict) -> list[str]:
    """Source keys; a bare string counts as one key."""
    names = rule.get("from", [])
    return [names] if isinstance(names, str) else list(names)


def _touched(conf: dict) -> list[str]:
    keys: dict[str, None] = {}
    for rule in conf.get("canonicalize", []):
        keys.update(dict.fromkeys(_sources(rule)))
        if rule["to"] != "REMOVE":
            keys[rule["to"]] = None
    width = conf.get("vector_width")
    if width is not None:
        keys["vector_width"] = None
        if "attribute" in width:
            keys[width["attribute"]] = None
    for _, field, _ in conf.get("filter", []):
        keys[field] = None
    return list(keys)


def _canonicalize(rule: dict, value: dict, present: dict) -> dict[str, Column]:
    sources, target = _sources(rule), rule["to"]
    if target == "REMOVE":
        return {value[k]: F.lit(None).cast("string") for k in sources} | {present[k]: F.lit(False) for k in sources}
    if rule.get("concat") is not None:
        # An absent key reads as empty text, a null one as NA.
        parts = [
            F.when(F.col(present[k]), F.coalesce(F.col(value[k]), F.lit("NA"))).otherwise(F.lit("")) for k in sources
        ]
        found = F.concat_ws(rule["concat"], *parts) if parts else F.lit("")
    else:
        # The first key that is there decides, even when its value is null.
        found = F.lit(None).cast("string")
        for k in reversed(sources):
            found = F.when(F.col(present[k]), F.col(value[k])).otherwise(found)
        found = remove_prefixes(found, rule.get("remove_prefix", []))
    if "default" in rule:
        return {
            value[target]: F.coalesce(found, as_text(rule["default"])),
            present[target]: F.lit(True),
        }
    return {
        value[target]: F.coalesce(found, F.col(value[target])),
        present[target]: found.isNotNull() | F.col(present[target]),
    }


def remove_prefixes(text: Column, prefixes: list[str]) -> Column:
    """Take off each prefix in list order, trimming after each one that was there."""
    return reduce(
        lambda t, p: F.when(t.startswith(p), strip(F.substring(t, len(p) + 1, 1 << 30))).otherwise(t), prefixes, text
    )


def _width(conf: dict, value: dict, present: dict) -> dict[str, Column]:
    width = as_text(conf["default"])
    if "attribute" in conf:
        width = width_lookup(F.col(value[conf["attribute"]]), conf.get("map", {}), conf["default"])
    return {value["vector_width"]: width, present["vector_width"]: F.lit(True)}


def width_lookup(attribute: Column, mapping: dict, default) -> Column:
    if not mapping:
        return as_text(default)
    return F.coalesce(F.try_element_at(literal_map(mapping), attribute), as_text(default))


def filter_condition(rule, field) -> Column:
    """``[operation, field, values]`` as a condition; unknown operations are errors."""
    operation, name, values = rule
    v = field(name)
    texts = [("true" if x else "false") if isinstance(x, bool) else str(x) for x in values if x is not None]
    listed = v.isin(texts) if texts else F.lit(False)
    hit = F.coalesce(listed, F.lit(False))
    if None in values:
        hit = hit | v.isNull()
    if operation == "require":
        return hit
    if operation == "remove":
        return ~hit
    if operation == "endswith":
        ends = reduce(lambda a, b: a | b, [v.endswith(x) for x in texts], F.lit(False))
        return F.coalesce(ends, F.lit(False))
    raise ValueError(f"unknown filter operation {operation!r}")


def filter_properties(df: DataFrame, rules: list, props: str = "properties") -> DataFrame:
    """All rules must hold."""
    for rule in rules:
        df = df.filter(filter_condition(rule, lambda k: value_of(F.col(props), k)))
    return df


def set_width(df: DataFrame, width=2, props: str = "properties") -> DataFrame:
    """Give every feature a line width, over any it has."""
    return df.withColumn(props, map_merge(props_or_empty(F.col(props)), literal_map({"vector_width": width})))


def add_links(df: DataFrame, base_url: str, zoom: int = 17, geom: str = "geom", props: str = "properties") -> DataFrame:
    """Add ``webmap_url`` at the centroid; rows without a usable geometry keep their properties as they are."""
    at = centroid(geom)
    link = F.concat(
        F.lit(f"{base_url}/staging/outlets/webmap/?lat="),
        at["y"].cast("string"),
        F.lit("&lng="),
        at["x"].cast("string"),
        F.lit(f"&zoom={zoom}"),
    )
    p = props_or_empty(F.col(props))
    return df.withColumn(props, F.when(link.isNotNull(), map_merge(p, F.create_map(F.lit("webmap_url"), link))).otherwise(p))


# Fields that tools add to exported features.
SYSTEM_FIELDS = ("cat", "fid", "ogc_fid", "gml_id")


def drop_system_fields(df: DataFrame, props: str = "properties") -> DataFrame:
    """Remove tool-made fields, and the feature's own ``id`` column when there is one."""
    out = df.withColumn(props, F.map_filter(F.col(props), lambda k, v: ~k.isin(list(SYSTEM_FIELDS))))
    return out.drop("id")


def apply_option(df: DataFrame, key: str, options: list[dict], props: str = "properties") -> DataFrame:
    """Copy all values of the option whose ``key`` value the feature has (type and width travel together)."""
    picked = value_of(F.col(props), key)
    over = F.expr("cast(map() as map<string,string>)")
    for option in reversed(options):
        over = F.when(picked == as_text(option[key]), literal_map(option)).otherwise(over)
    return df.withColumn(props, map_merge(props_or_empty(F.col(props)), over))


def fill_declared(df: DataFrame, columns: list[dict], props: str = "properties") -> DataFrame:
    """Give every feature the declared columns; a missing one gets its default or the first option's values."""
    defaults: dict = {}
    for column in columns:
        name, default = column["name"], column.get("default")
        options = column.get("options") or []
        if isinstance(default, dict):
            defaults.update(default)
        elif default is None and options and isinstance(options[0], dict):
            defaults.update(options[0])
        else:
            defaults[name] = default
    return df.withColumn(props, map_merge(literal_map(defaults), props_or_empty(F.col(props))))


def prefix_columns(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(prefix + c) for c in df.columns])

"""Names, degree texts and location texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The accepted location forms.
DMS = r"(\d+)°(\d+)′(\d+)″\s*([NS])\s*(\d+)°(\d+)′(\d+)″\s*([EW])"
AT_PAIR = r"@(-?\d+\.\d+),(-?\d+\.\d+)"
QUERY_PAIR = r"[?&]q=(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)"
PLAIN_PAIR = r"(-?\d+\.\d+)\s*,\s*(-?\d+\.\d+)"
URL = r"(?i)^https?://"
MAP_HOST = r"(?i)^https?://(maps\.google\.com|www\.google\.com/maps)"


def canonical_name(text: Column) -> Column:
    """Lower case, runs of whitespace as one underscore."""
    return F.regexp_replace(F.btrim(F.lower(text), F.lit(" \t\n\r\f\v")), r"\s+", "_")


def degree_minutes(text: Column) -> Column:
    """``DDD.mmm``: the digits after the point are minutes, the first two whole ones."""
    degrees = F.split_part(text, F.lit("."), F.lit(1))
    rest = F.split_part(text, F.lit("."), F.lit(2))
    minutes = F.concat(F.substring(rest, 1, 2), F.lit("."), F.substring(rest, 3, 20))
    return degrees.try_cast("double") + minutes.try_cast("double") / F.lit(60.0)


def _found(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def location(text: Column) -> Column:
    """``struct<lat,lng>`` from the first form that matches, null when none does.

    Order: link with ``@lat,lng``, link with ``?q=lat,lng``, degree-minute-second pair with hemispheres, JSON object,
    plain ``lat,lng``. Shortened links need a network look-up and give null.
    """
    t = F.btrim(text, F.lit(" \t\n\r\f\v"))
    is_url = _found(t, URL)
    short = is_url & _found(t, r"(?i)goo\.gl")
    at = is_url & _found(t, AT_PAIR)
    query = _found(t, MAP_HOST) & _found(t, QUERY_PAIR)
    dms = _found(t, DMS)

    def dms_part(first: int, hemisphere: int, negative: str) -> Column:
        value = (
            _number(t, DMS, first)
            + _number(t, DMS, first + 1) / F.lit(60.0)
            + _number(t, DMS, first + 2) / F.lit(3600.0)
        )
        return F.when(F.regexp_extract(t, DMS, hemisphere) == negative, -value).otherwise(value)

    json_lat = F.get_json_object(t, "$.latitude").try_cast("double")
    json_lng = F.get_json_object(t, "$.longitude").try_cast("double")
    as_json = t.startswith("{") & F.coalesce((json_lat != 0) & (json_lng != 0), F.lit(False))
    plain = _found(t, PLAIN_PAIR)

    def choose(at_v, query_v, dms_v, json_v, plain_v) -> Column:
        return (
            F.when(short, F.lit(None).cast("double"))
            .when(at, at_v)
            .when(query, query_v)
            .when(dms, dms_v)
            .when(as_json, json_v)
            .when(plain, plain_v)
        )

    lat = choose(
        _number(t, AT_PAIR, 1), _number(t, QUERY_PAIR, 1), dms_part(1, 4, "S"), json_lat, _number(t, PLAIN_PAIR, 1)
    )
    lng = choose(
        _number(t, AT_PAIR, 2), _number(t, QUERY_PAIR, 2), dms_part(5, 8, "W"), json_lng, _number(t, PLAIN_PAIR, 2)
    )
    return F.struct(lat.alias("lat"), lng.alias("lng"))


def valid_coordinates(lat: Column, lng: Column) -> Column:
    """False for null, NaN or out of range."""
    ok = ~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90.0, 90.0) & lng.between(-180.0, 180.0)
    return F.coalesce(ok, F.lit(False))


def leaf(document: Column, path: list[str]) -> Column:
    """Text at a nested path of a JSON document, null when a step is missing."""
    return F.try_variant_get(F.try_parse_json(document), "$" + "".join(f"['{p}']" for p in path), "string")

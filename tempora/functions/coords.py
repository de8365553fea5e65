"""Coordinate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions.text import flag, number


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_float(x: Column | str) -> Column:
    return F.nullif(F.trim(_col(x).cast("string")), F.lit("")).try_cast("double")


def pair(latitude: Column, longitude: Column) -> Column:
    return F.struct(latitude.cast("double").alias("latitude"), longitude.cast("double").alias("longitude"))


def preferred(current_lat: Column, current_lon: Column, suggested_lat: Column, suggested_lon: Column) -> Column:
    """The suggested pair if whole, else the current parts."""
    return F.when(suggested_lat.isNotNull() & suggested_lon.isNotNull(), pair(suggested_lat, suggested_lon)).otherwise(pair(current_lat, current_lon))


def reviewed(geocode: Column | str) -> Column:
    """Of a location's geocode: the suggested pair, else the pair, else the current parts."""
    g = _col(geocode)
    whole = g["latitude"].isNotNull() & g["longitude"].isNotNull()
    fallback = F.when(whole, pair(g["latitude"], g["longitude"])).otherwise(pair(g["current_latitude"], g["current_longitude"]))
    return F.when(g["suggested_latitude"].isNotNull() & g["suggested_longitude"].isNotNull(), pair(g["suggested_latitude"], g["suggested_longitude"])).otherwise(fallback)


def geocode_flags(name: Column | str, latitude: Column | str, longitude: Column | str, source: Column | str, addresstype: Column | str, importance: Column | str) -> Column:
    """Review flags of a geocode: no coordinates; else a broad area, low importance."""
    name, kind, rank = _col(name), _col(addresstype), _col(importance)
    quoted = F.concat(F.lit("'"), name, F.lit("'"))
    broad = F.concat(quoted, F.lit(" resolved to a broad administrative area ("), kind, F.lit("); review manually."))
    low = F.concat(quoted, F.lit(" resolved with low Nominatim importance ("), number(rank, 4), F.lit("); review manually."))
    found = F.array_compact(F.array(
        F.when((_col(source) == "nominatim") & kind.isin("country", "state", "region"), flag("broad_geocode_match", broad)),
        F.when(rank < 0.01, flag("low_importance_match", low)),
    ))
    missing = F.array(flag("missing_coordinates", F.concat(F.lit("No coordinates found for "), quoted, F.lit("."))))
    return F.when(_col(latitude).isNull() | _col(longitude).isNull(), missing).otherwise(found)


def backoff_seconds(attempt: int) -> float:
    """Wait before another try."""
    return min(60.0, 5.0 * 2**attempt)


def offset(seed: Column | str) -> Column:
    """A place near the origin that depends on the seed only: angle and radius from a 32-bit rolling hash of its UTF-16 units."""
    units = F.regexp_extract_all(F.hex(F.encode(_col(seed), "UTF-16BE")), F.lit("(....)"))
    h = F.aggregate(units, F.lit(0).cast("long"), lambda a, c: (a * 31 + F.conv(c, 16, 10).cast("long")).bitwiseAND(F.lit(4294967295)))
    angle = F.pmod(h, F.lit(360)) / 180.0 * F.pi()
    signed = F.when(h >= 2147483648, h - 4294967296).otherwise(h)
    shifted = F.floor(signed / 256)
    # the remainder keeps the sign of the shifted value
    radius = 1.8 + F.signum(shifted) * F.pmod(F.abs(shifted), F.lit(120)) / 100.0
    return F.struct((F.sin(angle) * radius).alias("latitude"), (F.cos(angle) * radius).alias("longitude"))

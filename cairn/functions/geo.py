"""Distances, rounding and grid keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
EARTH_RADIUS_MI = 3958.8
MILES_PER_DEGREE = 69.0
FEET_PER_METER = 3.28084


def half_up(x: Column) -> Column:
    """Nearest integer, ties upward."""
    return F.floor(x + F.lit(0.5)).cast("long")


def round_to(x: Column, digits: int) -> Column:
    """Decimal rounding by the same three floating point steps in every engine."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def feet(meters: Column) -> Column:
    return meters * F.lit(FEET_PER_METER)


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle miles; null when any coordinate is null."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = F.sin(half_dlat) * F.sin(half_dlat) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.sin(half_dlon) * F.sin(half_dlon)
    # least() skips nulls, so a missing point has to be kept out by hand
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(
        known, F.lit(2 * EARTH_RADIUS_MI) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))
    )


def lat_buffer(miles: Column | float) -> Column:
    return F.lit(miles) / F.lit(MILES_PER_DEGREE)


def lon_buffer(miles: Column | float, lat: Column) -> Column:
    return F.lit(miles) / (F.lit(MILES_PER_DEGREE) * F.cos(F.radians(lat)))


def _row_width(row: Column, step: float) -> Column:
    """Longitude width of the cells of a grid row, wide enough at its poleward edge."""
    edge = F.greatest(F.abs(row * step), F.abs((row + 1) * step)) + step
    return step / F.greatest(F.cos(F.radians(F.least(edge, F.lit(89.0)))), F.lit(0.01))


def grid_cell(lat: Column, lon: Column, miles: float) -> Column:
    """The one cell a point lies in, for a search radius of ``miles``."""
    step = miles / MILES_PER_DEGREE
    row = F.floor(lat / step)
    return F.struct(row.alias("row"), F.floor(lon / _row_width(row, step)).alias("col"))


def grid_cover(lat: Column, lon: Column, miles: float) -> Column:
    """All cells that can hold a point within ``miles``: up to three rows of three."""
    step = miles / MILES_PER_DEGREE
    rows = F.sequence(F.floor((lat - step) / step), F.floor((lat + step) / step))

    def cells(row: Column) -> Column:
        width = _row_width(row, step)
        return F.transform(
            F.sequence(F.floor((lon - width) / width), F.floor((lon + width) / width)),
            lambda col: F.struct(row.alias("row"), col.alias("col")),
        )

    return F.when(
        lat.isNotNull() & lon.isNotNull(), F.flatten(F.transform(rows, cells))
    )

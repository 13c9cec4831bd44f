"""Geographic column expressions. Angles in degrees, distances in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6371008.8


def _half_chord(lat1, lon1, lat2, lon2) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2)
    return a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)


def angle(lat1, lon1, lat2, lon2) -> Column:
    """Central angle in radians."""
    return 2 * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _half_chord(lat1, lon1, lat2, lon2)))))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    return EARTH * angle(lat1, lon1, lat2, lon2)


def slant(lat1, lon1, alt1, lat2, lon2, alt2) -> Column:
    """Great-circle arc at the mean altitude, combined with the difference of altitudes."""
    return F.hypot(angle(lat1, lon1, lat2, lon2) * (EARTH + (alt1 + alt2) / 2), alt2 - alt1)


def pairs(flat: list[float]) -> list[tuple[float, float]]:
    """[lat0, lon0, lat1, lon1, ...] -> vertices."""
    if not isinstance(flat, list) or len(flat) < 6 or len(flat) % 2:
        raise ValueError("a polygon is a flat list [lat0, lon0, ...] of three vertices or more")
    return [(float(a), float(b)) for a, b in zip(flat[::2], flat[1::2])]


def in_polygon(lat: Column, lon: Column, flat: list[float]) -> Column:
    """Even-odd rule over the polygon's edges, with longitude as x."""
    v = pairs(flat)
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(v, v[1:] + v[:1]):
        straddles = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        crossings = crossings + F.when(straddles & (lon < (x2 - x1) * (lat - y1) / (y2 - y1 + 1e-15) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def in_regions(lat: Column, lon: Column, polygons: list[list[float]]) -> Column:
    """In any of the polygons; without polygons everywhere."""
    if not polygons:
        return F.lit(True)
    out = F.lit(False)
    for p in polygons:
        out = out | in_polygon(lat, lon, p)
    return out


def bounds(flat: list[float]) -> tuple[float, float, float, float]:
    """lat and lon minimum, then maximum, of a polygon."""
    lat, lon = zip(*pairs(flat))
    return min(lat), min(lon), max(lat), max(lon)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[2]) & lon.between(box[1], box[3])


def flight_level_metres(level: Column | float) -> Column | float:
    return level * 100 * 0.3048


def base_altitude(levels: list[tuple[int, float, str]]) -> float:
    """Metres of the layer on which a graph is built before it is lifted: the mean of its levels."""
    return sum(m for _, m, _ in levels) / len(levels)


def levels(raw: str | float | list, unit: str = "FL") -> list[tuple[int, float, str]]:
    """Flight levels from a number, a list or their text -> (index, metres, tag), distinct and ascending."""
    if isinstance(raw, str):
        raw = [x for x in raw.strip().strip("[]()").replace(";", ",").split(",") if x.strip()]
    values = sorted({float(x) for x in (raw if isinstance(raw, list | tuple) else [raw])})
    tag = lambda v: f"FL{round(v):03d}" if unit.upper() == "FL" else f"ALT{round(v)}"
    return [(i, flight_level_metres(v) if unit.upper() == "FL" else v, tag(v)) for i, v in enumerate(values)]

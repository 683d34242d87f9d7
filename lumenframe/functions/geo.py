"""Spherical and planar geometry as column expressions; they stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

C = Column | str
EARTH_KM = 6371.0
# GRS80 ellipsoid and the origin of the European equal-area projection; sphere of the sinusoidal grid.
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
LAEA_LAT0, LAEA_LNG0, LAEA_X0, LAEA_Y0 = 52.0, 10.0, 4321000.0, 3210000.0
SINUSOIDAL_R = 6371007.181
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1: C, lng1: C, lat2: C, lng2: C, radius_km: float = EARTH_KM) -> Column:
    """Great-circle distance on a sphere; within 0.6 % of the spheroid."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp, dl = F.radians(_c(lat2) - _c(lat1)) / 2, F.radians(_c(lng2) - _c(lng1)) / 2
    a = F.sin(dp) * F.sin(dp) + F.cos(p1) * F.cos(p2) * F.sin(dl) * F.sin(dl)
    return 2 * radius_km * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def haversine_sql(lat1: str, lng1: str, lat2: str, lng2: str, radius_km: float = EARTH_KM) -> str:
    """The same distance as SQL text that other engines understand."""
    a = f"(power(sin(radians({lat2}-{lat1})/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*power(sin(radians({lng2}-{lng1})/2),2))"
    return f"(2*{radius_km}e0*asin(sqrt(least(1.0e0,{a}))))"


def initial_bearing(lat1: C, lng1: C, lat2: C, lng2: C) -> Column:
    """Great-circle bearing at the first point, degrees in [0, 360)."""
    p1, p2, dl = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lng2) - _c(lng1))
    y, x = F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def cross_track_km(lat1: C, lng1: C, lat2: C, lng2: C, lat: C, lng: C, radius_km: float = EARTH_KM) -> Column:
    """Unsigned distance of a point from the great circle through two others."""
    d = haversine_km(lat1, lng1, lat, lng, radius_km) / radius_km
    turn = F.radians(initial_bearing(lat1, lng1, lat, lng) - initial_bearing(lat1, lng1, lat2, lng2))
    return F.abs(F.asin(F.sin(d) * F.sin(turn)) * radius_km)


def along_track_km(lat1: C, lng1: C, lat2: C, lng2: C, lat: C, lng: C, radius_km: float = EARTH_KM) -> Column:
    """Signed distance along that circle from the first point to the foot of the other."""
    d = haversine_km(lat1, lng1, lat, lng, radius_km) / radius_km
    turn = F.radians(initial_bearing(lat1, lng1, lat, lng) - initial_bearing(lat1, lng1, lat2, lng2))
    return F.atan2(F.sin(d) * F.cos(turn), F.cos(d)) * radius_km


def planar_azimuth(lng1: C, lat1: C, lng2: C, lat2: C) -> Column:
    """Clockwise angle from north in plane degrees, [0, 360); null for one point twice."""
    dx, dy = _c(lng2) - _c(lng1), _c(lat2) - _c(lat1)
    return F.when((dx != 0) | (dy != 0), F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0)))


def _authalic_q(sin_lat: Column) -> Column:
    e2 = GRS80_F * (2 - GRS80_F)
    e = e2**0.5
    s = sin_lat
    return (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))


def laea_xy(lat: C, lng: C) -> tuple[Column, Column]:
    """Metres in the European equal-area projection (closed form on the authalic sphere)."""
    e2 = GRS80_F * (2 - GRS80_F)
    qp = _authalic_q(F.lit(1.0))
    rq = GRS80_A * F.sqrt(qp / 2)
    s0 = F.sin(F.radians(F.lit(LAEA_LAT0)))
    b0 = F.asin(_authalic_q(s0) / qp)
    m0 = F.cos(F.radians(F.lit(LAEA_LAT0))) / F.sqrt(1 - e2 * s0 * s0)
    d = GRS80_A * m0 / (rq * F.cos(b0))
    b = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _authalic_q(F.sin(F.radians(_c(lat)))) / qp)))
    dl = F.radians(_c(lng) - LAEA_LNG0)
    k = rq * F.sqrt(2 / (1 + F.sin(b0) * F.sin(b) + F.cos(b0) * F.cos(b) * F.cos(dl)))
    return LAEA_X0 + k * d * F.cos(b) * F.sin(dl), LAEA_Y0 + k / d * (F.cos(b0) * F.sin(b) - F.sin(b0) * F.cos(b) * F.cos(dl))


def sinusoidal_xy(lat: C, lng: C) -> tuple[Column, Column]:
    p = F.radians(_c(lat))
    return SINUSOIDAL_R * F.radians(_c(lng)) * F.cos(p), SINUSOIDAL_R * p


def sinusoidal_lat_lng(x: C, y: C) -> tuple[Column, Column]:
    p = _c(y) / SINUSOIDAL_R
    return F.degrees(p), F.degrees(_c(x) / (SINUSOIDAL_R * F.cos(p)))


def grid_key(lat: C, lng: C, digits: int = 1) -> Column:
    """lat,lng rounded to a grid, as text."""
    fmt = f"%.{digits}f"
    return F.concat_ws(",", F.format_string(fmt, F.round(_c(lat), digits)), F.format_string(fmt, F.round(_c(lng), digits)))


def tile_name(lat: C, lng: C, degrees: int = 3) -> Column:
    """South-west corner of the tile, like N36E027."""
    la, ln = (F.floor(_c(x) / degrees) * degrees for x in (lat, lng))
    return F.concat(F.lit("N"), F.lpad(la.cast("string"), 2, "0"), F.lit("E"), F.lpad(ln.cast("string"), 3, "0"))


def compass8(degrees: C) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.round(F.pmod(_c(degrees), F.lit(360.0)) / 45).cast("int") % 8) + 1)


def octagon(lat: C, lng: C, radius_m: float) -> Column:
    """Closed ring of [lng, lat] pairs approximating a circle with eight sides, 4 decimals."""
    ring = F.sequence(F.lit(0), F.lit(8))
    per_lat = radius_m / 111320.0
    return F.transform(
        ring,
        lambda i: F.array(
            F.round(_c(lng) + per_lat * F.cos(F.radians((i % 8) * 45.0)) / F.cos(F.radians(_c(lat))), 4),
            F.round(_c(lat) + per_lat * F.sin(F.radians((i % 8) * 45.0)), 4),
        ),
    )


def in_box(lat: C, lng: C, south: float, north: float, west: float, east: float) -> Column:
    return _c(lat).between(south, north) & _c(lng).between(west, east)


def first_box(lat: C, lng: C, boxes: list[tuple[str, float, float, float, float]]) -> Column:
    """Key of the first (key, south, north, west, east) box that holds the point, borders included; null outside all."""
    return F.coalesce(*(F.when(in_box(lat, lng, *box), F.lit(key)) for key, *box in boxes))


def crosses(lat: C, lng: C, x1: C, y1: C, x2: C, y2: C) -> Column:
    """Whether a ray eastwards from the point crosses an edge: even-odd rule, holes and multipolygons included."""
    y1, y2, x1, x2, y, x = map(_c, (y1, y2, x1, x2, lat, lng))
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)


def segment_distance_km(lat: C, lng: C, x1: C, y1: C, x2: C, y2: C) -> Column:
    """Distance of a point from an edge in a plane scaled at the point's latitude."""
    k = EARTH_KM * 3.141592653589793 / 180
    cx = F.cos(F.radians(_c(lat)))
    ax, ay = (_c(x1) - _c(lng)) * cx * k, (_c(y1) - _c(lat)) * k
    bx, by = (_c(x2) - _c(lng)) * cx * k, (_c(y2) - _c(lat)) * k
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(-(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    return F.sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))

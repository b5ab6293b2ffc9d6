"""Geodesy as column expressions (degrees in, metres out)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Mean earth radii and metres per degree used by the wire and display formats.
EARTH_R_M = 6_371_009.0
EARTH_R_VOICE_M = 6_371_008.8
M_PER_DEG_LAT = 111_132.0
M_PER_DEG_LON = 111_320.0


def haversine_m(lon1, lat1, lon2, lat2, radius: float = EARTH_R_M) -> Column:
    """Great-circle distance."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    v = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(v)))


def bearing_deg(lon1, lat1, lon2, lat2) -> Column:
    """Initial great-circle bearing in [0, 360)."""
    p1, p2, dlon = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def point_segment_m(lon, lat, lon_a, lat_a, lon_b, lat_b) -> Column:
    """Distance to a segment in the plane tangent at the point's latitude."""
    scale = F.greatest(F.lit(0.01), F.cos(F.radians(lat)))
    k = F.radians(F.lit(1.0)) * EARTH_R_M
    ax, ay = (lon_a - lon) * scale * k, (lat_a - lat) * k
    bx, by = (lon_b - lon) * scale * k, (lat_b - lat) * k
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / len2))
    return F.when(len2 <= 1e-12, F.sqrt(ax * ax + ay * ay)).otherwise(
        F.sqrt(F.pow(ax + u * dx, 2) + F.pow(ay + u * dy, 2))
    )


def box_bounds_m(lon, lat, west, east, south, north) -> tuple[Column, Column]:
    """Lower and upper bound on the distance from a point to anything inside a box."""
    near_lat = F.greatest(south - lat, lat - north, F.lit(0.0))
    near_lon = F.greatest(west - lon, lon - east, F.lit(0.0))
    far_lat = F.greatest(F.abs(lat - south), F.abs(lat - north))
    far_lon = F.least(F.lit(180.0), F.greatest(F.abs(lon - west), F.abs(lon - east)))
    cos_pt = F.cos(F.radians(lat))
    cos_min = F.least(F.cos(F.radians(south)), F.cos(F.radians(north)))
    cos_max = F.when((south <= 0) & (north >= 0), F.lit(1.0)).otherwise(
        F.greatest(F.cos(F.radians(south)), F.cos(F.radians(north)))
    )
    # Going the other way round the globe can only be shorter past 180 degrees.
    near_lon = F.least(near_lon, F.greatest(F.lit(0.0), 360.0 - F.greatest(F.abs(lon - west), F.abs(lon - east))))

    def dist(dlat, dlon, c):
        v = F.pow(F.sin(F.radians(dlat) / 2), 2) + cos_pt * c * F.pow(F.sin(F.radians(dlon) / 2), 2)
        return 2 * EARTH_R_M * F.asin(F.least(F.lit(1.0), F.sqrt(v)))

    return dist(near_lat, near_lon, cos_min), dist(far_lat, far_lon, cos_max)


def nmea_degrees(raw: Column, hemisphere: Column) -> Column:
    """``ddmm.mmmm`` text and its hemisphere letter to signed degrees; NULL when malformed."""
    value = raw.try_cast("double")
    deg = F.floor(value / 100)
    minutes = value - deg * 100
    unsigned = deg + minutes / 60
    return F.when((value >= 0) & (minutes < 60), F.when(hemisphere.isin("S", "W"), -unsigned).otherwise(unsigned))


def nmea_e7(raw: Column, hemisphere: Column) -> Column:
    """``ddmm.mmmm`` text to integer degrees x 1e7 with truncating integer arithmetic."""
    whole = F.split_part(raw, F.lit("."), F.lit(1)).try_cast("bigint")
    frac = F.rpad(F.substring(F.split_part(raw, F.lit("."), F.lit(2)), 1, 7), 7, "0").try_cast("bigint")
    deg = F.expr("0") + F.floor(whole / 100).cast("bigint")
    min_e7 = (whole - deg * 100) * 10_000_000 + frac
    e7 = deg * 10_000_000 + F.floor(min_e7 / 60).cast("bigint")
    return F.when(hemisphere.isin("S", "W"), -e7).otherwise(e7)

"""Sun, moon, sidereal time and earth shadow as column builders over Unix seconds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo

EARTH_R_KM, DARK_SUN_DEG = 6371.0, -6.0


def days(t: Column) -> Column:
    """Days since J2000.0."""
    return t / 86_400.0 - 10_957.5


def gmst_deg(t: Column) -> Column:
    return geo.normalize_deg(280.46061837 + 360.98564736629 * days(t))


def _equatorial(lon: Column, lat: Column, eps: Column) -> tuple[Column, Column]:
    """Right ascension and declination (degrees) of ecliptic angles in radians."""
    ra = F.degrees(F.atan2(F.sin(lon) * F.cos(eps) - F.tan(lat) * F.sin(eps), F.cos(lon)))
    dec = F.degrees(F.asin(F.sin(lat) * F.cos(eps) + F.cos(lat) * F.sin(eps) * F.sin(lon)))
    return geo.normalize_deg(ra), dec


def sun_equatorial(t: Column) -> tuple[Column, Column]:
    d = days(t)
    g = F.radians(geo.normalize_deg(357.528 + 0.9856003 * d))
    lam = F.radians(geo.normalize_deg(280.460 + 0.9856474 * d) + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    return _equatorial(lam, F.lit(0.0), F.radians(23.439 - 0.0000004 * d))


def moon_equatorial(t: Column) -> tuple[Column, Column]:
    d = days(t)
    lon = F.radians(218.316 + 13.176396 * d + 6.289 * F.sin(F.radians(134.963 + 13.064993 * d)))
    lat = F.radians(5.128 * F.sin(F.radians(93.272 + 13.229350 * d)))
    return _equatorial(lon, lat, F.lit(math.radians(23.439)))


def horizontal(ra: Column, dec: Column, t: Column, lat: float, lon: float) -> Column:
    """struct<az, el> of an equatorial position for an observer."""
    h, phi, de = F.radians(geo.normalize_deg(gmst_deg(t) + lon - ra)), math.radians(lat), F.radians(dec)
    el = F.degrees(F.asin(math.sin(phi) * F.sin(de) + math.cos(phi) * F.cos(de) * F.cos(h)))
    az = geo.normalize_deg(F.degrees(F.atan2(-F.sin(h), F.tan(de) * math.cos(phi) - math.sin(phi) * F.cos(h))))
    return F.struct(az.alias("az"), el.alias("el"))


def sun_position(t: Column, lat: float, lon: float) -> Column:
    return horizontal(*sun_equatorial(t), t, lat, lon)


def moon_position(t: Column, lat: float, lon: float) -> Column:
    return horizontal(*moon_equatorial(t), t, lat, lon)


def sun_direction(t: Column) -> Column:
    """ECEF unit vector towards the point under the sun."""
    ra, dec = sun_equatorial(t)
    p = geo.ecef(dec, geo.normalize_deg(ra - gmst_deg(t)), F.lit(0.0))
    n = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"])
    return F.struct((p["x"] / n).alias("x"), (p["y"] / n).alias("y"), (p["z"] / n).alias("z"))


def sun_elevation(lat: float, lon: float, sun: Column) -> Column:
    la, lo = math.radians(lat), math.radians(lon)
    return F.degrees(F.asin(math.cos(la) * math.cos(lo) * sun["x"] + math.cos(la) * math.sin(lo) * sun["y"] + math.sin(la) * sun["z"]))


def sunlit(lat: Column, lon: Column, alt_m: Column, sun: Column) -> Column:
    """Whether a position is outside the earth's cylinder of shadow."""
    e = geo.ecef(lat, lon, alt_m)
    p = [e[k] / 1000 for k in "xyz"]
    dot = p[0] * sun["x"] + p[1] * sun["y"] + p[2] * sun["z"]
    off = [p[i] - dot * sun[k] for i, k in enumerate("xyz")]
    return (dot > 0) | (F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]) > EARTH_R_KM)


def teme_to_geodetic(x: Column, y: Column, z: Column, t: Column) -> Column:
    """struct<lat, lon, alt_m> of a TEME position in km: sidereal rotation, then Bowring."""
    g = F.radians(gmst_deg(t))
    ex, ey = F.cos(g) * x + F.sin(g) * y, F.cos(g) * y - F.sin(g) * x
    a = geo.A / 1000
    b = a * (1 - geo.FLATTENING)
    p = F.hypot(ex, ey)
    theta = F.atan2(z * a, p * b)
    lat = F.atan2(z + (a * a - b * b) / b * F.pow(F.sin(theta), F.lit(3)), p - geo.E2 * a * F.pow(F.cos(theta), F.lit(3)))
    n = a / F.sqrt(1 - geo.E2 * F.pow(F.sin(lat), F.lit(2)))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(ey, ex)).alias("lon"), ((p / F.cos(lat) - n) * 1000).alias("alt_m"))

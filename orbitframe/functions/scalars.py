"""Scalar measures as Column expressions. Missing is NULL, never NaN."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from orbitframe import config as c


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); -1 where the sum is not positive."""
    total = a + b
    return F.when(total > 0, (a - b) / F.greatest(total, F.lit(1e-6))).otherwise(F.lit(-1.0))


def decibel(x: Column) -> Column:
    return F.when(x > 0, 10 * F.log10(F.when(x > 0, x)))


def los_metres(phase: Column) -> Column:
    return -phase * F.lit(c.WAVELENGTH_M) / F.lit(4 * math.pi)


def robust_z(residual: Column, median: Column, mad: Column) -> Column:
    return F.lit(c.MAD_SCALE) * (residual - median) / mad


def floored_mad(mad: Column) -> Column:
    return F.when(mad == 0, F.lit(c.MAD_FLOOR)).otherwise(mad)


def cluster_score(peak: Column, size: Column) -> Column:
    return -peak * F.log1p(size)


def metres_between(lat: Column, lon: Column, site_lat: Column, site_lon: Column) -> Column:
    """Equirectangular distance; longitudes shrink by the site's latitude."""
    m = F.lit(c.METRES_PER_DEGREE)
    return F.hypot((lat - site_lat) * m, (lon - site_lon) * m * F.cos(F.radians(site_lat)))


def order_box(lat: Column, lon: Column, half: float = 0.045) -> Column:
    d = F.lit(half) / F.greatest(F.lit(0.2), F.cos(F.radians(lat)))
    return F.struct((lon - d).alias("w"), (lat - half).alias("s"), (lon + d).alias("e"), (lat + half).alias("n"))


def cadence_days(passes_last_year: Column) -> Column:
    """Rounded half up; NULL without passes."""
    return F.when(passes_last_year > 0, F.floor(365.0 / passes_last_year + 0.5))


def plan_epochs(months: Column) -> Column:
    return F.when(months >= 3, F.least(months, F.lit(36)))


def plan_pairs(epochs: Column) -> Column:
    return 2 * epochs - 3


def year_fraction(date: Column) -> Column:
    return F.unix_date(date) / F.lit(c.DAYS_PER_YEAR)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def compact_date(text: Column) -> Column:
    """yyyyMMdd to a date."""
    return F.to_date(text, "yyyyMMdd")


def join_parts(*parts: Column) -> Column:
    """Non-empty parts, joined by a comma."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), ", ")


def first_known(*values: Column) -> Column:
    return F.coalesce(*values)


def asset_href(assets: Column, name: str, aliases: tuple[str, ...] = ()) -> Column:
    """An asset by its key, else the first key in order that contains one of the aliases."""
    keys = F.array_sort(F.filter(F.map_keys(assets), lambda k: F.lit(False) if not aliases else _any_in(k, aliases)))
    return F.coalesce(F.try_element_at(assets, F.lit(name)), F.try_element_at(assets, F.try_element_at(keys, F.lit(1))))


def _any_in(key: Column, parts: tuple[str, ...]) -> Column:
    key = F.lower(key)
    out = F.contains(key, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(key, F.lit(p))
    return out


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fixed4(x: Column) -> Column:
    return F.format_string("%.4f", x)


def uri_component(text: Column) -> Column:
    """Percent-encoded UTF-8; letters, digits and - _ . ! ~ * ' ( ) stay."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def point_query(lon: Column, lat: Column) -> Column:
    """The point of an archive request, encoded."""
    return uri_component(F.concat(F.lit("POINT("), fixed4(lon), F.lit(" "), fixed4(lat), F.lit(")")))


# Transverse Mercator by the Krüger series to the third order (WGS 84).
_A, _FLAT, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _FLAT / (2 - _FLAT)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _conformal(lon: Column, lat: Column, zone: int | Column) -> tuple[Column, Column]:
    """(tangent of the conformal latitude, longitude from the middle meridian)."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(F.radians(lat))
    return F.sinh(F.atanh(s) - e * F.atanh(e * s)), F.radians(lon - (6 * zone - 183))


def _sphere(t: Column, dl: Column) -> tuple[Column, Column]:
    return F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))


def _metres(xi: Column, eta: Column) -> tuple[Column, Column]:
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + _K0 * _R * x, _K0 * _R * y


def utm_from_lonlat(lon: Column, lat: Column, zone: int | Column) -> tuple[Column, Column]:
    return _metres(*_sphere(*_conformal(lon, lat, zone)))


def utm_bounds(west: np.ndarray, south: np.ndarray, east: np.ndarray, north: np.ndarray, zone: np.ndarray, edge_points: int) -> np.ndarray:
    """Least x and y and largest x and y on the map of each box's outline, corners and ``edge_points`` places an edge: four rows. NaN where a figure is missing."""
    share = np.linspace(0.0, 1.0, edge_points + 2)[:, None]
    across, up = west + (east - west) * share, south + (north - south) * share
    flat = np.zeros_like(share)
    lon = np.concatenate([west + flat, east + flat, across, across])
    lat = np.concatenate([up, up, south + flat, north + flat])
    with np.errstate(all="ignore"):
        e = 2 * math.sqrt(_N) / (1 + _N)
        s, dl = np.sin(np.radians(lat)), np.radians(lon - (6 * zone - 183))
        t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
        xi, eta = np.arctan2(t, np.cos(dl)), np.arctanh(np.sin(dl) / np.sqrt(1 + t * t))
        x, y = eta.copy(), xi.copy()
        for j, a in enumerate(_ALPHA, 1):
            x += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
            y += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    x, y = 500000 + _K0 * _R * x, _K0 * _R * y
    return np.stack([x.min(axis=0), y.min(axis=0), x.max(axis=0), y.max(axis=0)])


def lonlat_from_utm(easting: Column, northing: Column, zone: int | Column) -> tuple[Column, Column]:
    y, x = northing / (_K0 * _R), (easting - 500000) / (_K0 * _R)
    xi, eta = y, x
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * y) * F.cosh(2 * j * x)
        eta = eta - b * F.cos(2 * j * y) * F.sinh(2 * j * x)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return 6 * zone - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)

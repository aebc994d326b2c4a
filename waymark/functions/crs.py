"""Longitude and latitude to projected metres and back, as column expressions of published formulas.

EPSG:28992 by the polynomial approximation of Schreutelkamp and Strang van Hees (better than a metre inside the
country); EPSG:3301 by the closed form of the Lambert conformal conic on GRS80 (five turns for the latitude).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients by powers of the two differences.
TO_X = {(0, 1): 190094.945, (1, 1): -11832.228, (2, 1): -114.221, (0, 3): -32.391, (1, 0): -0.705, (3, 1): -2.340, (1, 3): -0.608, (0, 2): -0.008, (2, 3): 0.148}
TO_Y = {(1, 0): 309056.544, (0, 2): 3638.893, (2, 0): 73.077, (1, 2): -157.984, (3, 0): 59.788, (0, 1): 0.433, (2, 2): -6.439, (1, 1): -0.032, (0, 4): 0.092, (1, 4): -0.054}
TO_LAT = {(0, 1): 3235.65389, (2, 0): -32.58297, (0, 2): -0.24750, (2, 1): -0.84978, (0, 3): -0.06550, (2, 2): -0.01709, (1, 0): -0.00738, (4, 0): 0.00530, (2, 3): -0.00039, (4, 1): 0.00033, (1, 1): -0.00012}
TO_LON = {(1, 0): 5260.52916, (1, 1): 105.94684, (1, 2): 2.45656, (3, 0): -0.81885, (1, 3): 0.05594, (3, 1): -0.05607, (0, 1): 0.01199, (3, 2): -0.00256, (1, 4): 0.00128, (0, 2): 0.00022, (2, 0): -0.00022, (5, 0): 0.00026}
# Origin of the first system; ellipsoid and cone of the second.
LAT0, LON0, X0, Y0 = 52.15517440, 5.38720621, 155000.0, 463000.0
A, FLAT = 6378137.0, 1 / 298.257222101
EE_LAT0, EE_LON0, EE_LAT1, EE_LAT2, EE_X0, EE_Y0 = 57.51755393055556, 24.0, 59.333333333333336, 58.0, 500000.0, 6375000.0


def _series(table: dict, p: Column, q: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(k) * F.pow(p, F.lit(i)) * F.pow(q, F.lit(j)) for (i, j), k in table.items()])


def rd_from_lonlat(lon: Column, lat: Column) -> Column:
    p, q = 0.36 * (lat - LAT0), 0.36 * (lon - LON0)
    return F.struct((X0 + _series(TO_X, p, q)).alias("x"), (Y0 + _series(TO_Y, p, q)).alias("y"))


def lonlat_from_rd(x: Column, y: Column) -> Column:
    p, q = (x - X0) * 1e-5, (y - Y0) * 1e-5
    return F.struct((LON0 + _series(TO_LON, p, q) / 3600).alias("lon"), (LAT0 + _series(TO_LAT, p, q) / 3600).alias("lat"))


_E = math.sqrt(FLAT * (2 - FLAT))


def _t(lat: float) -> float:
    s = _E * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (_E * math.sin(lat)) ** 2)


_P1, _P2, _P0 = (math.radians(v) for v in (EE_LAT1, EE_LAT2, EE_LAT0))
_N = math.log(_m(_P1) / _m(_P2)) / math.log(_t(_P1) / _t(_P2))
_F = _m(_P1) / (_N * _t(_P1) ** _N)
_R0 = A * _F * _t(_P0) ** _N


def lest_from_lonlat(lon: Column, lat: Column) -> Column:
    phi = F.radians(lat)
    s = _E * F.sin(phi)
    r = A * _F * F.pow(F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(_E / 2)), F.lit(_N))
    turn = _N * F.radians(lon - EE_LON0)
    return F.struct((EE_X0 + r * F.sin(turn)).alias("x"), (EE_Y0 + _R0 - r * F.cos(turn)).alias("y"))


def lonlat_from_lest(x: Column, y: Column) -> Column:
    dx, dy = x - EE_X0, _R0 - (y - EE_Y0)
    t = F.pow(F.hypot(dx, dy) / (A * _F), F.lit(1 / _N))
    phi = math.pi / 2 - 2 * F.atan(t)
    for _ in range(5):
        s = _E * F.sin(phi)
        phi = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(_E / 2)))
    return F.struct((EE_LON0 + F.degrees(F.atan2(dx, dy)) / _N).alias("lon"), F.degrees(phi).alias("lat"))

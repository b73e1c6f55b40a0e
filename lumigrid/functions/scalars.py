"""Column functions: pixel and map coordinates, nodata, names and dates, display scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = 3.141592653589793


def is_nodata(value: Column, nodata: float | None, floating: bool = True) -> Column:
    """Whether a value is the sentinel: NaN, close to it (floating data), or equal to it. Null is nodata."""
    if nodata is None:
        hit = F.lit(False)
    elif nodata != nodata:
        hit = F.isnan(value)
    elif floating:
        hit = F.abs(value - nodata) <= 1e-8 + 1e-5 * abs(nodata)
    else:
        hit = value == nodata
    return F.coalesce(hit, F.lit(True))


def masked(value: Column, nodata: float | None, floating: bool = True) -> Column:
    """The value, null where it is nodata."""
    return F.when(~is_nodata(value, nodata, floating), value)


def corner_x(transform, col: Column) -> Column:
    """Map x of a pixel's corner; ``transform`` is (a, b, c, d, e, f)."""
    return F.lit(transform[2]) + col * transform[0]


def corner_y(transform, row: Column) -> Column:
    return F.lit(transform[5]) + row * transform[4]


def centre_x(transform, col: Column) -> Column:
    return F.lit(transform[2]) + (col + 0.5) * transform[0]


def centre_y(transform, row: Column) -> Column:
    return F.lit(transform[5]) + (row + 0.5) * transform[4]


def cell(coordinate: Column, origin: float, size: float) -> Column:
    """Index of the cell of a grid that a map coordinate snaps to (a negative size runs down)."""
    return F.round((coordinate - origin) / size).cast("int")


def affine(transform, col, row):
    """Map coordinates of grid coordinates, numbers or columns."""
    a, b, c, d, e, f = transform
    return c + col * a + row * b, f + col * d + row * e


def affine_inverse(transform, x, y):
    """Grid coordinates (col, row; 0 at the outer edge of the first cell) of map coordinates."""
    a, b, c, d, e, f = transform
    det = a * e - b * d
    return ((x - c) * e - (y - f) * b) / det, ((y - f) * a - (x - c) * d) / det


def index_window(low: Column, high: Column) -> tuple[Column, Column]:
    """Whole numbers around a range of coordinates."""
    return F.floor(low).cast("int"), F.ceil(high).cast("int")


def brighten(value: Column, alpha: float = 0.13, beta: float = 0.0) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value * alpha + beta, F.lit(0.0)), F.lit(255.0)))


def gamma(value: Column, gamma: float = 2.0) -> Column:
    return F.pow(value, F.lit(1.0 / gamma))


def epsg_of_utm(zone: Column, direction: Column) -> Column:
    return F.lit(32600) + zone.cast("int") + F.when(F.lower(direction).startswith("s"), 100).otherwise(0)


def epsg_of_description(text: Column) -> Column:
    """EPSG code from words like ``UTM Zone 11 North`` or ``UTM zone 11N``; null without them."""
    pattern = r"(?i)UTM\s+zone\s+(\d+)\s*([NS])"
    zone = F.regexp_extract(text, pattern, 1)
    return F.when(zone != "", epsg_of_utm(zone, F.regexp_extract(text, pattern, 2)))


def map_info(text: Column) -> Column:
    """The typed first ten fields of a ``map info`` list."""
    part = F.transform(F.split(F.regexp_replace(text, r"[{}]", ""), ","), lambda p: F.trim(p))
    kinds = (
        ("projection", "string"), ("ref_x", "double"), ("ref_y", "double"), ("easting", "double"), ("northing", "double"),
        ("x_size", "double"), ("y_size", "double"), ("zone", "int"), ("direction", "string"), ("datum", "string"),
    )
    return F.struct(*[F.get(part, F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(kinds)])


def with_zone(text: Column, zone: Column, direction: Column) -> Column:
    """A ``map info`` list with its zone and direction replaced."""
    part = F.transform(F.split(text, ","), lambda p: F.trim(p))
    return F.array_join(F.transform(part, lambda p, i: F.when(i == 7, zone.cast("string")).when(i == 8, direction).otherwise(p)), ", ")


def geo_transform(x: Column, y: Column, size_x: Column, size_y: Column) -> Column:
    return F.format_string("%.1f %.1f 0.0 %.1f 0.0 %.1f", x.cast("double"), size_x.cast("double"), y.cast("double"), (-size_y).cast("double"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def date_of_name(path: Column) -> Column:
    """Timestamp from the eight digits that a file name begins with; null without them."""
    digits = F.regexp_extract(basename(path), r"^\d{8}", 0)
    return F.when(digits != "", F.to_timestamp_ntz(digits, F.lit("yyyyMMdd")))


def line_id(path: Column) -> Column:
    return F.regexp_extract(path, r"ang\d{8}t\d{6}", 0)


def dataset_of(path: Column) -> Column:
    return F.when(path.contains("rdn"), "rdn").otherwise(F.substring_index(path, "_", -1))


def encoded(data: Column) -> Column:
    """Inline form of bytes in a reference store."""
    return F.concat(F.lit("base64:"), F.base64(data))


def dataset_path(root: str, date: Column, time: Column, dataset: Column) -> Column:
    """Where a flight line keeps a dataset."""
    stem = F.concat(F.lit("ang"), date, F.lit("t"), time, F.lit("_"), dataset)
    level2 = F.concat_ws("/", F.lit(root), date, F.lit("L2a"), stem)
    level1 = F.concat_ws("/", F.lit(root), date, F.lit("L1"), dataset, stem)
    return F.when(dataset == "rfl", level2).when(dataset == "rdn", F.concat(level1, F.lit("_v2aa1_clip"))).otherwise(level1)


def sibling_path(path: Column, dataset: str) -> Column:
    """The path of another dataset of the same flight line."""
    root = F.regexp_extract(path, r"^(.*)/\d{8}/", 1)
    stamp = r"ang(\d{8})t(\d{6})"
    made = dataset_path("", F.regexp_extract(path, stamp, 1), F.regexp_extract(path, stamp, 2), F.lit(dataset))
    return F.concat(root, made)


# Transverse Mercator on WGS 84. Fixed values of the ellipsoid and the grid.
_A, _F, _K0, _E0, _N0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def utm_of(lat: Column, lon: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing of geographic coordinates in degrees (Krueger's series to the fourth order)."""
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    c = 2 * _N**0.5 / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * c) * c)
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * a
        y = y + F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * a
    return x * (_K0 * _RADIUS) + _E0, y * (_K0 * _RADIUS) + (_N0 if south else 0.0)


def geographic_of(east: Column, north: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of UTM coordinates."""
    xi = (north - (_N0 if south else 0.0)) / (_K0 * _RADIUS)
    eta = (east - _E0) / (_K0 * _RADIUS)
    x, y = eta, xi
    for j, b in enumerate(_BETA, 1):
        x = x - F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * b
        y = y - F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * b
    chi = F.asin(F.sin(y) / F.cosh(x))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.sin(chi * 2 * j) * d
    return F.degrees(phi), F.degrees(F.atan2(F.sinh(x), F.cos(y))) + (6 * zone - 183)


GEOGRAPHIC = 4326


def utm_zone_epsg(lat, lon):
    """EPSG code of the UTM zone of a place, numbers or columns."""
    if isinstance(lat, Column) or isinstance(lon, Column):
        return (F.lit(32601) + F.least(F.floor((lon + 180) / 6), F.lit(59)) + F.when(lat < 0, 100).otherwise(0)).cast("int")
    return 32601 + min(int((lon + 180) // 6), 59) + (100 if lat < 0 else 0)


def projected(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates (x or longitude, y or latitude) in another reference system: geographic (4326) and UTM on WGS 84."""
    for code in (source, target):
        if code != GEOGRAPHIC and not (32601 <= code <= 32660 or 32701 <= code <= 32760):
            raise ValueError(f"unknown reference system: {code}")
    if source == target:
        return x, y
    if source != GEOGRAPHIC:
        lat, lon = geographic_of(x, y, source % 100, source >= 32700)
    else:
        lat, lon = y, x
    if target == GEOGRAPHIC:
        return lon, lat
    return utm_of(lat, lon, target % 100, target >= 32700)

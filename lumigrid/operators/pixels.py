"""Operators on pixel tables: bands, subsets, orthorectification, mosaics, resampling, display.

A pixel table has a row for each pixel: ``scene_id, y, x`` and ``bands`` (array) or named values; null
is nodata. Nothing here collects pixels or loops over scenes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

#: Positions (first, last) of the 425 bands that water vapour and the detector's ends spoil. Fixed values.
BAD_BANDS = ((0, 2), (193, 216), (285, 334), (414, 424))
OBS = (
    "path_length", "to_sensor_azimuth", "to_sensor_zenith", "to_sun_azimuth", "to_sun_zenith", "solar_phase", "slope", "aspect",
    "cosine", "utc_time", "earth_sun_distance",
)
IGM = ("easting", "northing", "elevation")
#: Datasets that have a spectrum for each pixel. Fixed values, as the layer names above.
SPECTRAL = ("reflectance", "radiance", "rfl", "rdn")


# -- bands -----------------------------------------------------------------------------------------
def dropped(bands: Column, positions) -> Column:
    """The array without the listed positions."""
    return F.filter(bands, lambda _, i: ~i.isin(*positions))


def good(bands: Column, bad=BAD_BANDS) -> Column:
    """The array without the ranges (first, last) of bad positions."""
    return F.filter(bands, lambda _, i: ~reduce(lambda a, b: a | b, [i.between(*r) for r in bad]))


def band_filter(pixels: DataFrame, dataset: str, positions=None) -> DataFrame:
    """Drop the positions, or the bad bands by default; datasets without spectra stay as they are."""
    if dataset not in SPECTRAL:
        return pixels
    kept = good(F.col("bands")) if positions is None else dropped(F.col("bands"), positions)
    return pixels.withColumn("bands", kept)


def layers(pixels: DataFrame, names) -> DataFrame:
    """Array layers as named columns."""
    rest = [c for c in pixels.columns if c != "bands"]
    return pixels.select(*rest, *[F.get("bands", F.lit(k)).alias(n) for k, n in enumerate(names)])


def long(pixels: DataFrame) -> DataFrame:
    """A row for each pixel and band."""
    return pixels.select(*[c for c in pixels.columns if c != "bands"], F.posexplode("bands").alias("band", "value"))


def whole(values: DataFrame, key) -> DataFrame:
    """The reverse: arrays in band order."""
    made = F.array_sort(F.collect_list(F.struct("band", "value")))
    return values.groupBy(*key).agg(F.transform(made, lambda s: s["value"]).alias("bands"))


def band_stats(pixels: DataFrame) -> DataFrame:
    return long(pixels).groupBy("band").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def any_null(bands: Column) -> Column:
    return F.exists(bands, lambda v: v.isNull())


def batches(pixels: DataFrame, order, rows: int | None = None, item: int = 4, features: int = 425) -> DataFrame:
    """``batch``: which batch of so many rows, in order, a row belongs to; by default 1024**2 // item // features * 1000 rows.

    Rows are numbered within partitions of the order's first column and offset by their counts, so no task gets all of them.
    """
    rows = rows or 1024**2 // item // features * 1000
    first, *rest = order
    count = pixels.groupBy(first).agg(F.count("*").alias("held"))
    start = (F.sum("held").over(Window.orderBy(first)) - F.col("held")).alias("start")  # one row for each value of the first column
    place = F.row_number().over(Window.partitionBy(first).orderBy(*rest)) if rest else F.row_number().over(Window.partitionBy(first).orderBy(F.lit(0)))
    numbered = pixels.withColumn("at", place).join(count.select(first, start), first)
    return numbered.withColumn("batch", F.floor((F.col("start") + F.col("at") - 1) / rows).cast("long")).drop("at", "start")


# -- subsets ---------------------------------------------------------------------------------------
def window(pixels: DataFrame, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Half-open index ranges."""
    return pixels.where((F.col("y") >= y[0]) & (F.col("y") < y[1]) & (F.col("x") >= x[0]) & (F.col("x") < x[1]))


def latlon(pixels: DataFrame, lat: tuple[float, float], lon: tuple[float, float], inclusive: bool = False) -> DataFrame:
    """The index rectangle of pixels strictly inside the box; its last row and column only if ``inclusive``."""
    inside = (F.col("lat") > min(lat)) & (F.col("lat") < max(lat)) & (F.col("lon") > min(lon)) & (F.col("lon") < max(lon))
    box = pixels.where(inside).agg(*[f(c).alias(f"{n}_{c}") for c in ("y", "x") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    last = 1 if inclusive else 0
    fits = [(F.col(c) >= F.col(f"lo_{c}")) & (F.col(c) < F.col(f"hi_{c}") + last) for c in ("y", "x")]
    # One row is broadcast.
    return pixels.join(F.broadcast(box), fits[0] & fits[1]).select(*pixels.columns)


def index_box(pixels: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> tuple[slice, slice]:
    """Index ranges (y, x) of the pixels strictly inside the box, without the last row and column; an error if there are none."""
    inside = (F.col("lat") > min(lat)) & (F.col("lat") < max(lat)) & (F.col("lon") > min(lon)) & (F.col("lon") < max(lon))
    y0, y1, x0, x1 = pixels.where(inside).agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    if y0 is None:
        raise ValueError("no pixel lies in the box")
    return slice(y0, y1), slice(x0, x1)


def bbox(points: DataFrame, bounds, x: str = "x", y: str = "y") -> DataFrame:
    """Points inside (min x, min y, max x, max y), ends included."""
    if len(bounds) != 4:
        raise ValueError("bounds are (min x, min y, max x, max y)")
    return points.where(F.col(x).between(bounds[0], bounds[2]) & F.col(y).between(bounds[1], bounds[3]))


def bounds(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return points.agg(F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"))


# -- orthorectification ----------------------------------------------------------------------------
def glt(table: DataFrame, base: int = 1, nodata: int = -9999) -> DataFrame:
    """Map cells with the 0-based source pixel; null where either layer is nodata or below ``base``."""
    good = (F.col("src_x") != nodata) & (F.col("src_y") != nodata) & (F.col("src_x") >= base) & (F.col("src_y") >= base)
    return table.withColumns({c: F.when(good, F.col(c) - base) for c in ("src_x", "src_y")})


def orthorectify(pixels: DataFrame, cells: DataFrame, key=()) -> DataFrame:
    """The whole map grid with the values of each cell's source pixel, null where it has none.

    An equi-join: Spark shuffles both sides by source pixel, and splits skewed ones.
    """
    source = pixels.withColumnsRenamed({"y": "src_y", "x": "src_x"})
    return cells.join(source, [*key, "src_y", "src_x"], "left")


def cells_of_window(cells: DataFrame, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Map cells whose source lies in the half-open window of the sensor grid."""
    return cells.where((F.col("src_y") >= y[0]) & (F.col("src_y") < y[1]) & (F.col("src_x") >= x[0]) & (F.col("src_x") < x[1]))


MANY_TIMES = 10_000
#: Values in a run of ``folded``.
RUN = 1000


# -- mosaics ---------------------------------------------------------------------------------------
def _fold(values: Column, method) -> Column:
    """An array's values folded from the left; null if it is empty. The array stands in a variable, as it is made once."""
    rest = lambda r: F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))
    return F.get(F.transform(F.array(values), lambda r: F.aggregate(rest(r), F.get(r, F.lit(0)), method)), F.lit(0))


def folded(values: DataFrame, method, key, value: str = "v", order: str = "src") -> DataFrame:
    """The valid values of each cell folded in order: a sort that can spill, then runs of bounded length, then bare values.

    A cell's list holds no more than 8 bytes or so for each value; the order's columns end with the sort.
    """
    cell, rows = Window.partitionBy(*key), values.select(*key, F.col(order).alias("_o"), F.col(value).alias("_v"))
    place = rows.select(*key, "_v", (F.row_number().over(cell.orderBy("_o", "_v")) - 1).alias("_n"))
    runs = place.groupBy(*key, F.floor(F.col("_n") / RUN).alias("_run")).agg(F.sort_array(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_n", "_v")))).alias("_s"))
    bare = runs.select(*key, F.struct("_run", F.transform("_s", lambda s: s["_v"]).alias("_v")).alias("_r"))
    lists = F.flatten(F.transform(F.sort_array(F.collect_list("_r")), lambda r: r["_v"]))
    return bare.groupBy(*key).agg(_fold(lists, method).alias(value))


def merged(method, value: str = "v", order: str = "src") -> Column:
    """Aggregate of the valid values of a cell: a method's name, or a function of two columns to fold in order."""
    v, seen = F.col(value), F.col(value).isNotNull()
    if callable(method):
        rows = F.sort_array(F.collect_list(F.when(seen, F.struct(F.col(order), v.alias("v")))))
        return _fold(F.transform(rows, lambda s: s["v"]), method)
    made = {
        "first": lambda: F.min_by(v, F.when(seen, F.col(order))),
        "last": lambda: F.max_by(v, F.when(seen, F.col(order))),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "sum": lambda: F.sum(v),
        "count": lambda: F.nullif(F.count(v), F.lit(0)),
    }
    if method not in made:
        raise ValueError(f"unknown merge method: {method}")
    return made[method]()


def canvas(spark, rows: int, cols: int, step: int = 1000) -> DataFrame:
    """All cells of a grid, from one range: no join."""
    n = rows * cols
    return spark.range(n).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))


def mosaic(values: DataFrame, method="first", key=("row", "col"), value: str = "v", order: str = "src", grid: DataFrame | None = None) -> DataFrame:
    """One value for each cell of overlapping sources; with ``grid``, a row for each of its cells."""
    if callable(method):
        out = folded(values if grid is None else values.where(F.col(value).isNotNull()), method, key, value, order)
    else:
        out = values.groupBy(*key).agg(merged(method, value, order).alias(value))
    return out if grid is None else grid.join(out, list(key), "left")


def largest_grid(shapes: DataFrame) -> DataFrame:
    """The row (date, height, width) with the most cells; the earliest of equals."""
    best = F.max_by(F.struct("date", "height", "width"), F.struct(F.col("height") * F.col("width"), -F.unix_date(F.to_date("date", "yyyyMMdd"))))
    return shapes.agg(best.alias("s")).select("s.*")


def align(values: DataFrame, times: DataFrame, grid: DataFrame) -> DataFrame:
    """Every date on all cells of the grid, null where it has none: the result has dates times cells rows.

    Up to ``MANY_TIMES`` dates, counted first, are broadcast; Spark plans the product otherwise.
    """
    few = times.limit(MANY_TIMES + 1).count() <= MANY_TIMES
    return (F.broadcast(times) if few else times).crossJoin(grid).join(values, ["time", "row", "col"], "left")


# -- resampling ------------------------------------------------------------------------------------
REDUCERS = {
    "average": lambda v: F.avg(v),
    "mode": lambda v: F.mode(v, True),
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
    "med": lambda v: F.percentile(v, 0.5),
    "q1": lambda v: F.percentile(v, 0.25),
    "q3": lambda v: F.percentile(v, 0.75),
    "sum": lambda v: F.sum(v),
    "rms": lambda v: F.sqrt(F.avg(v * v)),
}
#: Half width in cells and weight of each interpolation.
KERNELS = {"bilinear": 1, "cubic": 2, "lanczos": 3, "gauss": 2}
RESAMPLING = ("nearest", *KERNELS, *REDUCERS)


def kernel(name: str, d: Column) -> Column:
    """Weight at distance ``d`` in cells."""
    a = F.abs(d)
    if name == "bilinear":
        return F.greatest(1 - a, F.lit(0.0))
    if name == "cubic":  # of parameter -1/2
        return F.when(a <= 1, 1.5 * a * a * a - 2.5 * a * a + 1).when(a < 2, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2).otherwise(0.0)
    if name == "gauss":
        return F.exp(-2 * a * a)
    turn = a * scalars.PI
    return F.when(a < 1e-12, 1.0).when(a < 3, 3 * F.sin(turn) * F.sin(turn / 3) / (turn * turn)).otherwise(0.0)


def reduced(values: DataFrame, factor: int, methods=tuple(REDUCERS), value: str = "v", key=()) -> DataFrame:
    """Blocks of factor x factor cells reduced to one by each method."""
    block = {c: F.floor(F.col(c) / factor).cast("int") for c in ("row", "col")}
    return values.withColumns(block).groupBy(*key, "row", "col").agg(*[REDUCERS[m](F.col(value)).alias(m) for m in methods])


def resampled(values: DataFrame, target: DataFrame, method: str = "nearest", value: str = "v", scale: tuple[float, float] = (1.0, 1.0), key=()) -> DataFrame:
    """``target`` (row, col, at_row, at_col: position in the source grid, 0 at a cell's centre) with values.

    Nearest is one equi-join; an interpolation joins each cell's neighbours and renormalises the
    weights over those that are valid. A reducer takes the valid cells whose centres lie in the target cell,
    which is ``scale`` (rows, columns) source cells wide, its lower ends included; without such, the nearest.
    The fan-out is fixed by the kernel or the scale; when a target cell is wider than a source cell, a kernel is stretched by
    ``scale``. ``key`` names columns of ``values`` that are resampled apart, as ``band``.
    """
    if method not in RESAMPLING:
        raise ValueError(f"unknown resampling: {method}")
    source = values.select(F.col("row").alias("near_row"), F.col("col").alias("near_col"), *key, value)
    if method in REDUCERS:

        def centres(c: str, width: float) -> Column:
            low, high = F.ceil(F.col(c) - width / 2).cast("int"), F.ceil(F.col(c) + width / 2).cast("int") - 1
            return F.explode(F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array(F.floor(F.col(c) + 0.5).cast("int"))))

        fan = target.withColumn("near_row", centres("at_row", scale[0])).withColumn("near_col", centres("at_col", scale[1]))
        found = fan.join(source, ["near_row", "near_col"], "left")
        return found.groupBy("row", "col", *key).agg(REDUCERS[method](F.col(value)).alias(value))
    if method not in KERNELS:
        near = {f"near_{c}": F.floor(F.col(f"at_{c}") + 0.5).cast("int") for c in ("row", "col")}
        return target.withColumns(near).join(source, ["near_row", "near_col"], "left").select("row", "col", *key, value)
    wide = [max(1.0, float(x)) for x in scale]

    def steps(c: str, width: float) -> Column:
        half = math.ceil(KERNELS[method] * width)
        return F.explode(F.sequence(F.floor(F.col(c)).cast("int") - half + 1, F.floor(F.col(c)).cast("int") + half))

    fan = target.withColumn("near_row", steps("at_row", wide[0])).withColumn("near_col", steps("at_col", wide[1]))
    apart = [(F.col(f"near_{c}") - F.col(f"at_{c}")) / w for c, w in zip(("row", "col"), wide)]
    fan = fan.withColumn("w", kernel(method, apart[0]) * kernel(method, apart[1]))
    found = fan.join(source, ["near_row", "near_col"], "left")
    weight = F.sum(F.when(F.col(value).isNotNull(), F.col("w")))
    total = F.sum(F.col("w") * F.col(value)) / F.when(F.abs(weight) > 1e-12, weight)
    return found.groupBy("row", "col", *key).agg(total.alias(value))


def needs_resampling(res_a: float, epsg_a: int, res_b: float, epsg_b: int) -> bool:
    return abs(res_a - res_b) >= 0.01 or epsg_a != epsg_b


# -- display ---------------------------------------------------------------------------------------
def rgb(pixels: DataFrame, bands=(0, 1, 2), normalize: bool = False, alpha: float | None = None, beta: float | None = None, gamma: float | None = None) -> DataFrame:
    """y, x, band (0 to 2) and value: normalised to 0..1, then brightened, then gamma-corrected, as asked."""
    for c in ("y", "x"):
        if c not in pixels.columns:
            raise ValueError("y and x are needed")
    picked = F.array(*[F.get("bands", F.lit(b)).cast("double") for b in bands])
    out = pixels.select("y", "x", F.posexplode(picked).alias("band", "value"))
    v = F.col("value")
    if normalize:
        stats = out.groupBy("band").agg(F.min("value").alias("low"), F.max("value").alias("high"))
        out = out.join(F.broadcast(stats), "band")  # three rows
        v = (v - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    if alpha is not None or beta is not None:
        v = scalars.brighten(v, 0.13 if alpha is None else alpha, beta or 0.0)
    if gamma is not None:
        v = scalars.gamma(v, gamma)
    return out.select("y", "x", "band", v.alias("value"))


def chunks(sizes: DataFrame, order: str = "i", size: str = "n") -> DataFrame:
    """Half-open offsets of chunks in order; a table of chunks, not of pixels, is ordered."""
    w = Window.orderBy(order)
    end = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select(order, (end - F.col(size)).cast("long").alias("start"), end.cast("long").alias("stop"))

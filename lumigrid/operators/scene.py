"""Scenes: a pixel table with what describes its grid, and the operators that need both.

``Scene`` is a thin wrapper; each method gives a new scene or a table, and nothing runs before the result is asked for, except
for the bounds of small results (polygons, grids, hit rectangles), which are a few numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from . import geometry, pca, pixels

#: Points on each side of a grid's outline when it is brought to another reference system.
OUTLINE = 21


@dataclass(frozen=True)
class Scene:
    """``pixels``: y, x and bands or named values. ``transform`` (a, b, c, d, e, f) leads from the grid's outer corner to map
    coordinates; without one the grid is the sensor's, and lat and lon, if known, are columns."""

    pixels: DataFrame
    dataset: str = "reflectance"
    height: int = 0
    width: int = 0
    transform: tuple[float, float, float, float, float, float] | None = None
    epsg: int | None = None
    nodata: float | None = None
    wavelength: tuple[float, ...] = ()
    fwhm: tuple[float, ...] = ()
    path: str | None = None
    attrs: dict = field(default_factory=dict)

    # -- what is there -----------------------------------------------------------------------------
    @property
    def values(self) -> list[str]:
        """Columns that hold data, not places."""
        return [c for c in self.pixels.columns if c not in ("y", "x", "lat", "lon", "src_y", "src_x")]

    def schema(self) -> dict:
        """Sizes, variables, coordinates and attributes."""
        placed = [c for c in ("lat", "lon") if c in self.pixels.columns] or (["x", "y"] if self.transform else [])
        return {"dims": {"y": self.height, "x": self.width}, "data_vars": self.values, "coords": placed, "attrs": dict(self.attrs)}

    def located(self) -> DataFrame:
        """Pixels with ``px``, ``py``: map coordinates of their centres, or lon and lat of a sensor grid."""
        if self.transform:
            x, y = scalars.affine(self.transform, F.col("x") + 0.5, F.col("y") + 0.5)
            return self.pixels.withColumns({"px": x, "py": y})
        if "lat" not in self.pixels.columns:
            raise ValueError("the pixels have no coordinates")
        return self.pixels.withColumns({"px": F.col("lon"), "py": F.col("lat")})

    def with_values(self, change: Callable[[Column], Column]) -> Scene:
        """Each variable changed; places stay."""
        names = set(self.values)
        return replace(self, pixels=self.pixels.select(*[change(F.col(c)).alias(c) if c in names else c for c in self.pixels.columns]))

    def filled(self) -> DataFrame:
        """Pixels with the sentinel instead of nulls, as sinks write them."""
        if self.nodata is None:
            return self.pixels
        fill = lambda c: F.transform(F.col(c), lambda v: F.coalesce(v, F.lit(self.nodata))) if c == "bands" else F.coalesce(F.col(c), F.lit(self.nodata))
        names = set(self.values)
        return self.pixels.select(*[fill(c).alias(c) if c in names else c for c in self.pixels.columns])

    # -- operators ---------------------------------------------------------------------------------
    def window(self, y: slice, x: slice) -> Scene:
        """A half-open index window; indices stay those of the whole grid."""
        rows, cols = (y.start or 0, self.height if y.stop is None else y.stop), (x.start or 0, self.width if x.stop is None else x.stop)
        return replace(self, pixels=pixels.window(self.pixels, rows, cols))

    def orthorectify(self, glt: Scene, subset=None, nodata: float | None = None) -> Scene:
        """The map grid of a lookup table (layers: source sample, source line, from 1) with each cell's sensor values.

        ``subset``: edges of polygons in the table's reference system, or bounds (min x, min y, max x, max y). The scene's own
        sentinel goes before ``nodata``.
        """
        if self.dataset == "glt":
            raise ValueError("a lookup table cannot be orthorectified")
        if self.transform is not None:
            raise ValueError("the scene is on a map grid already")
        raw = glt.pixels.select(F.col("y").alias("gy"), F.col("x").alias("gx"), F.get("bands", F.lit(0)).cast("int").alias("src_x"), F.get("bands", F.lit(1)).cast("int").alias("src_y"))
        cells = pixels.glt(raw)
        source = self.pixels.drop("lat", "lon")
        made = pixels.orthorectify(source, cells).drop("src_y", "src_x").withColumnsRenamed({"gy": "y", "gx": "x"})
        if self.dataset == "igm":
            made = made.select("y", "x", "elevation") if "elevation" in made.columns else made
        lon, lat = scalars.affine(glt.transform, F.col("x"), F.col("y"))
        kept = {k: v for k, v in self.attrs.items() if k not in ("map info", "lines", "samples")} | {k: glt.attrs[k] for k in ("map info",) if k in glt.attrs}
        out = replace(
            self, pixels=made.withColumns({"lat": lat, "lon": lon}), height=glt.height, width=glt.width, transform=glt.transform, epsg=glt.epsg,
            nodata=nodata if self.nodata is None else self.nodata, attrs=kept,
        )
        if subset is None:
            return out
        if isinstance(subset, DataFrame):
            return out.clip(subset)
        if isinstance(subset, (tuple, list)) and len(subset) == 4:
            return out.clip_box(tuple(subset))
        raise ValueError("a subset is a table of edges or four bounds")

    def _cropped(self, hit: DataFrame, keep: Column | None = None) -> Scene:
        """The rectangle of the pixels ``hit`` (y, x), null elsewhere."""
        y0, y1, x0, x1 = hit.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
        if y0 is None:
            raise ValueError("the area does not overlap the scene")
        inside = pixels.window(self.pixels, (y0, y1 + 1), (x0, x1 + 1))
        flag = "_".join(["hit", *self.pixels.columns])
        marked = inside.join(hit.select("y", "x").distinct().withColumn(flag, F.lit(True)), ["y", "x"], "left")
        names = set(self.values)
        return replace(self, pixels=marked.select(*[F.when(F.col(flag), F.col(c)).alias(c) if c in names else c for c in self.pixels.columns]))

    def clip_box(self, bounds: tuple[float, float, float, float]) -> Scene:
        """The pixels whose centres lie in the bounds, ends included; an error without any."""
        return self._cropped(pixels.bbox(self.located(), bounds, "px", "py"))

    def clip(self, edges: DataFrame, epsg: int | None = None, all_touched: bool = False, nodata: float = -9999.0) -> Scene:
        """Nodata outside the polygons, and the rectangle of what is inside; an error if they do not meet.

        ``epsg`` of the edges, if it is another than the scene's. A centre must lie inside; with ``all_touched`` a cell need only
        meet a polygon.
        """
        if epsg is not None and self.epsg is not None and epsg != self.epsg:
            edges = geometry.to_epsg(edges, epsg, self.epsg if self.transform else scalars.GEOGRAPHIC)
        where = self.located()
        x0, y0, x1, y1 = geometry.bounds(edges)
        half = abs(self.transform[0]) / 2 if all_touched and self.transform else 0.0
        near = pixels.bbox(where, (x0 - half, y0 - half, x1 + half, y1 + half), "px", "py").select("y", "x", "px", "py", F.struct("y", "x").alias("cell"))
        if all_touched:
            if not self.transform:
                raise ValueError("cells that polygons touch need a map grid")
            low = near.withColumns({"px": F.col("px") - half, "py": F.col("py") - half})
            hit = geometry.touched(low, edges, "cell", 2 * half)
        else:
            hit = geometry.clip(near, edges, "cell")
        return replace(self._cropped(hit), nodata=nodata if self.nodata is None else self.nodata)

    def reproject(self, epsg: int | None = None, resolution: float | tuple[float, float] | None = None, method: str = "nearest") -> Scene:
        """On a north-up grid of a reference system and resolution (by default its own).

        The grid begins at the least x and the greatest y of the outline; its size is the rounded extent over the
        resolution. Each cell's centre is brought back to the source grid and resampled there.
        """
        if method not in pixels.RESAMPLING:
            raise ValueError(f"unknown resampling: {method}")
        target = epsg or self.epsg
        if epsg is not None and epsg != self.epsg and self.epsg is None:
            raise ValueError("the scene has no reference system")
        a, b, _, d, e, _ = self.transform
        own = ((a * a + d * d) ** 0.5, (b * b + e * e) ** 0.5)
        spark = self.pixels.sparkSession
        share = [k / (OUTLINE - 1) for k in range(OUTLINE)]
        ring = [(u * self.width, v * self.height) for s in share for u, v in ((s, 0), (s, 1), (0, s), (1, s))]
        outline = spark.createDataFrame([scalars.affine(self.transform, float(c), float(r)) for c, r in ring], "x double, y double")
        there = scalars.projected(F.col("x"), F.col("y"), self.epsg, target) if target != self.epsg else (F.col("x"), F.col("y"))
        x0, y0, x1, y1 = outline.select(there[0].alias("x"), there[1].alias("y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        if resolution is None:
            # A pixel's own size; in another system, as many cells along the diagonal as before.
            size = own if target == self.epsg else (((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5 / (self.width**2 + self.height**2) ** 0.5,) * 2
        else:
            size = (float(resolution),) * 2 if isinstance(resolution, (int, float)) else tuple(map(float, resolution))
        cols, rows = max(round((x1 - x0) / size[0]), 1), max(round((y1 - y0) / size[1]), 1)
        transform = (size[0], 0.0, x0, 0.0, -size[1], y1)
        x, y = scalars.affine(transform, F.col("col") + 0.5, F.col("row") + 0.5)
        if target != self.epsg:
            x, y = scalars.projected(x, y, target, self.epsg)
        col, row = scalars.affine_inverse(self.transform, x, y)
        grid = pixels.canvas(spark, rows, cols).select("row", "col", (row - 0.5).alias("at_row"), (col - 0.5).alias("at_col"))
        scale = (max(size[1] / own[1], 1.0), max(size[0] / own[0], 1.0)) if target == self.epsg else (max(self.height / rows, 1.0), max(self.width / cols, 1.0))
        source = self.pixels.withColumnsRenamed({"y": "row", "x": "col"})
        made = None
        for c in self.values:
            one = source.select("row", "col", c)
            if method == "nearest":
                out = pixels.resampled(one, grid, method, c)
            elif c == "bands":
                long = one.select("row", "col", F.posexplode("bands").alias("band", "value"))
                found = pixels.resampled(long, grid, method, "value", scale, ("band",)).where("band IS NOT NULL")
                out = pixels.canvas(spark, rows, cols).join(pixels.whole(found, ["row", "col"]), ["row", "col"], "left")
            else:
                out = pixels.resampled(one, grid, method, c, scale)
            made = out if made is None else made.join(out, ["row", "col"])
        made = made.withColumnsRenamed({"row": "y", "col": "x"})
        return replace(self, pixels=made, height=rows, width=cols, transform=transform, epsg=target)

    def rgb(self, bands=(0, 1, 2), **display) -> DataFrame:
        """y, x, band, value of three bands, scaled for display."""
        return pixels.rgb(self.pixels, bands, **display)

    def pca(self, k: int, whiten: bool = False) -> pca.PCAModel:
        return pca.fit(self.pixels, k, whiten=whiten)

    def merge(self, other: Scene) -> Scene:
        """Variables of two scenes on one grid, each pixel that either has."""
        clash = set(self.values) & set(other.values)
        if clash:
            raise ValueError(f"both scenes have {sorted(clash)}")
        right = other.pixels.select("y", "x", *other.values)
        return replace(self, pixels=self.pixels.join(right, ["y", "x"], "full"))

    def keep(self, *names: str) -> Scene:
        """Only some of the variables."""
        return replace(self, pixels=self.pixels.select(*[c for c in self.pixels.columns if c in names or c not in self.values]))

    def named(self, name: str) -> Scene:
        """``bands`` under another name, so that variables can be merged."""
        return replace(self, pixels=self.pixels.withColumnRenamed("bands", name))


def same_grid(scenes: list[Scene]) -> bool:
    """Whether scenes agree in reference system, transform and size."""
    return len({(s.epsg, s.transform, s.height, s.width) for s in scenes}) <= 1


def mosaic(scenes: list[Scene], resolution: float | None = None, epsg: int | None = None, nodata: float | None = None, resampling: str = "nearest", method="first") -> Scene:
    """Scenes merged on the grid of their union, every variable of the first; scenes whose resolution differs by 0.01 or more, or that have
    another reference system, are resampled first. The order of the list is that of ``first``, ``last`` and a fold."""
    if len(scenes) < 2:
        raise ValueError("at least two scenes are merged")
    if not callable(method):
        pixels.merged(method)
    head = scenes[0]
    epsg, size = epsg or head.epsg, resolution or abs(head.transform[0])
    ready = []
    for s in scenes:
        turned = s.transform[1] or s.transform[3] or s.transform[4] > 0
        if turned or pixels.needs_resampling(s.transform[0], s.epsg, size, epsg):
            s = s.reproject(epsg, size, resampling)
        ready.append(s)
    left = min(s.transform[2] for s in ready)
    top = max(s.transform[5] for s in ready)
    right = max(s.transform[2] + s.width * s.transform[0] for s in ready)
    bottom = min(s.transform[5] + s.height * s.transform[4] for s in ready)
    cols, rows = max(round((right - left) / size), 1), max(round((top - bottom) / size), 1)
    names = head.values
    parts = []
    for k, s in enumerate(ready):
        dx, dy = round((s.transform[2] - left) / size), round((top - s.transform[5]) / size)
        parts.append(s.pixels.select((F.col("y") + dy).cast("int").alias("row"), (F.col("x") + dx).cast("int").alias("col"), F.lit(k).alias("src"), *names))
    every = reduce(DataFrame.unionByName, parts)
    plain = [n for n in names if n != "bands"]
    grid = pixels.canvas(head.pixels.sparkSession, rows, cols)
    out = grid
    if plain:
        out = out.join(every.groupBy("row", "col").agg(*[pixels.merged(method, n).alias(n) for n in plain]), ["row", "col"], "left")
    if "bands" in names:
        long = every.select("row", "col", "src", F.posexplode("bands").alias("band", "value"))
        merged = long.groupBy("row", "col", "band").agg(pixels.merged(method, "value").alias("value"))
        out = out.join(pixels.whole(merged, ["row", "col"]), ["row", "col"], "left")
    out = out.select(F.col("row").alias("y"), F.col("col").alias("x"), *names)
    return replace(head, pixels=out, height=rows, width=cols, transform=(size, 0.0, left, 0.0, -size, top), epsg=epsg, nodata=head.nodata if nodata is None else nodata)

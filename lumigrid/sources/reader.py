"""Opening scenes from files: bands, subsets and orthorectification pushed down to the byte ranges that are read."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import geometry, pixels
from ..operators.scene import Scene, mosaic
from . import envi

#: Folder of a file to its dataset. Fixed values.
FOLDERS = {"L2a": "reflectance", "rdn": "radiance", "obs": "obs", "igm": "igm", "glt": "glt"}
NAMED = {"igm": pixels.IGM, "obs": pixels.OBS}


def dataset_of_path(path: str) -> str | None:
    """The dataset that a file's folders tell."""
    return next((FOLDERS[p] for p in reversed(path.split("/")[:-1]) if p in FOLDERS), None)


def supporting_file(path: str, name: str) -> str:
    """Path of another dataset of the same line: ``<base>/L1/<name>/<stem>_<name>`` from level 2, else ``<base>/<name>/<stem>_<name>``."""
    *folders, file = path.split("/")
    base = [*folders[:-1], "L1"] if folders and folders[-1] == "L2a" else folders[:-1]
    return "/".join([*base, name, f"{file.split('_')[0]}_{name}"])


def grid_of(fields: dict) -> tuple[tuple[float, ...] | None, int | None]:
    """Transform and EPSG code from a header's map info; a rotation, in degrees, turns the grid counter-clockwise."""
    info = fields.get("map info")
    if not info:
        return None, None
    name, ref_x, ref_y, east, north, size_x, size_y, *rest = info
    turn = next((float(v.partition("=")[2]) for v in rest if v.lower().startswith("rotation")), 0.0)
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    size_x, size_y = float(size_x), float(size_y)
    a, b, d, e = size_x * c, size_y * s, size_x * s, -size_y * c
    off_x, off_y = float(ref_x) - 1, float(ref_y) - 1
    transform = (a, b, float(east) - a * off_x - b * off_y, d, e, float(north) - d * off_x - e * off_y)
    if "geographic" in name.lower():
        return transform, scalars.GEOGRAPHIC
    if name.strip().upper() == "UTM" and len(rest) > 1:
        return transform, 32600 + int(rest[0]) + (100 if rest[1].strip().lower().startswith("s") else 0)
    return transform, None


def open_raster(spark: SparkSession, path: str, dataset: str | None = None, bands: list[int] | None = None, subset: dict | None = None, lines: int = 100, header: str | None = None) -> Scene:
    """A file as it is: only the bands and the index window asked for are read."""
    layout, fields = envi.read_layout(path, header)
    envi.register(spark)
    reader = spark.read.format("envi").option("lines", str(lines))
    if header:
        reader = reader.option("header", header)
    if bands is not None:
        reader = reader.option("bands", ",".join(map(str, bands)))
    for axis, r in (subset or {}).items():
        reader = reader.option(axis, f"{r.start or 0}:{'' if r.stop is None else r.stop}")
    transform, epsg = grid_of(fields)
    keep = range(layout.bands) if bands is None else bands
    pick = lambda values: tuple(values[b] for b in keep) if values else ()
    return Scene(
        reader.load(path), dataset or dataset_of_path(path) or "reflectance", layout.lines, layout.samples, transform, epsg, layout.nodata, pick(layout.wavelength), pick(layout.fwhm), path, fields
    )


def kept_bands(layout: envi.Layout, dataset: str, filter_bands) -> list[int] | None:
    """Positions that stay: all (None), without the bad ones (True), or without the positions listed."""
    if filter_bands is False or filter_bands is None or dataset not in pixels.SPECTRAL:
        return None
    if filter_bands is True:
        return [b for b in range(layout.bands) if not any(low <= b <= high for low, high in pixels.BAD_BANDS)]
    gone = set(map(int, filter_bands))
    return [b for b in range(layout.bands) if b not in gone]


def open_scene(
    spark: SparkSession, path: str, dataset: str | None = None, ortho: bool = False, filter_bands=False, subset=None, lines: int = 100, igm: str | None = None, glt: str | None = None, epsg: int | None = None
) -> Scene:
    """The reader: bands to drop (True: the bad ones), a subset, orthorectification.

    ``subset``: ``{"y": slice, "x": slice}`` of the sensor grid; ``{"lat": (a, b), "lon": (a, b)}``, in the lookup's units, strictly inside and without
    the rectangle's last row and column; or polygons, as edges or the path of a file, which need ``ortho`` and whose reference system is
    ``epsg``. Datasets other than igm and glt get lat, lon and elevation from the igm file beside them, if ``igm`` names it, or a
    subset or ``ortho`` needs it.
    """
    layout, fields = envi.read_layout(path)
    dataset = dataset or dataset_of_path(path) or "reflectance"
    area = subset if subset is not None and not isinstance(subset, dict) else None
    if area is not None and not ortho:
        raise ValueError("a polygon subset needs ortho=True")
    if ortho and dataset == "glt":
        raise ValueError("a lookup table cannot be orthorectified")
    table = None
    if ortho:
        try:
            table = open_raster(spark, glt or supporting_file(path, "glt"), "glt", lines=lines)
        except OSError as missing:
            raise FileNotFoundError("orthorectification needs the glt file") from missing
    if isinstance(area, str):
        area = geometry.read_polygons(spark, area)
    if area is not None and epsg is not None and table.epsg is not None:
        area = geometry.to_epsg(area, epsg, table.epsg)
    window = {k: subset[k] for k in ("y", "x") if isinstance(subset, dict) and k in subset}
    places = None
    if dataset not in ("igm", "glt") and (igm or ortho or (isinstance(subset, dict) and "lat" in subset)):
        try:
            places = open_raster(spark, igm or supporting_file(path, "igm"), "igm", lines=lines)
        except OSError:
            if igm or not ortho:
                raise
    if area is not None:  # the sensor pixels that the lookup table has for the area's bounds
        near = pixels.bbox(table.located(), geometry.bounds(area), "px", "py")
        source = near.select(F.get("bands", F.lit(1)).alias("src_y"), F.get("bands", F.lit(0)).alias("src_x"))
        y0, y1, x0, x1 = pixels.glt(source).agg(F.min("src_y"), F.max("src_y"), F.min("src_x"), F.max("src_x")).first()
        if y0 is None:
            raise ValueError("the area does not overlap the scene")
        window = {"y": slice(y0, y1 + 1), "x": slice(x0, x1 + 1)}
    elif isinstance(subset, dict) and "lat" in subset:
        if dataset == "glt":
            own = open_raster(spark, path, dataset, lines=lines)
            x, y = scalars.affine(own.transform, F.col("x"), F.col("y"))
            where = own.pixels.select("y", "x", y.alias("lat"), x.alias("lon"))
        else:
            source = open_raster(spark, path, dataset, lines=lines) if dataset == "igm" else places
            where = source.pixels.select("y", "x", F.get("bands", F.lit(1)).alias("lat"), F.get("bands", F.lit(0)).alias("lon"))
        rows, cols = pixels.index_box(where, subset["lat"], subset["lon"])
        window = {"y": rows, "x": cols}
    scene = open_raster(spark, path, dataset, kept_bands(layout, dataset, filter_bands), window, lines)
    if dataset in NAMED and layout.bands == len(NAMED[dataset]):
        scene = Scene(**{**scene.__dict__, "pixels": pixels.layers(scene.pixels, NAMED[dataset])})
    if places is not None:
        read = open_raster(spark, places.path, "igm", subset=window, lines=lines).pixels
        read = read.select("y", "x", F.get("bands", F.lit(1)).alias("lat"), F.get("bands", F.lit(0)).alias("lon"), F.get("bands", F.lit(2)).alias("elevation"))
        scene = Scene(**{**scene.__dict__, "pixels": scene.pixels.join(read, ["y", "x"])})
    if not ortho:
        return scene
    scene = Scene(**{**scene.__dict__, "transform": None})
    if window:  # only cells whose source was read
        rows, cols = window.get("y", slice(0, layout.lines)), window.get("x", slice(0, layout.samples))
        source = [F.get("bands", F.lit(k)).cast("int") - 1 for k in (1, 0)]
        span = [(r.start or 0, n if r.stop is None else r.stop) for r, n in ((rows, layout.lines), (cols, layout.samples))]
        inside = reduce(lambda p, q: p & q, [(s >= low) & (s < high) for s, (low, high) in zip(source, span)])
        hit = table.pixels.where(inside).select("y", "x")
        made = scene.orthorectify(table)._cropped(hit)
    else:
        made = scene.orthorectify(table)
    return made.clip(area) if area is not None else made


def write_scene(scene: Scene, path: str, code: int | None = None) -> None:
    """A map scene as a line-interleaved binary that ``open_raster`` reads: the rectangle that the pixels span, nulls as the sentinel."""
    y0, y1, x0, x1 = scene.pixels.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    if y0 is None:
        raise ValueError("the scene has no pixels")
    px = scene.pixels if "bands" in scene.pixels.columns else scene.pixels.select("y", "x", F.array(*[F.col(c).cast("double") for c in scene.values]).alias("bands"))
    kind = px.schema["bands"].dataType.elementType.simpleString()
    code = code or {"smallint": 2, "int": 3, "bigint": 14, "float": 4}.get(kind, 5)
    bands = px.agg(F.max(F.size("bands"))).first()[0]
    layout = envi.Layout(x1 - x0 + 1, y1 - y0 + 1, bands, code, nodata=-9999.0 if scene.nodata is None else scene.nodata, wavelength=list(scene.wavelength), fwhm=list(scene.fwhm))
    fields = {}
    if scene.transform:
        a, b, _, d, e, _ = scene.transform
        east, north = scalars.affine(scene.transform, x0, y0)
        turn = math.degrees(math.atan2(d, a))
        size = (math.hypot(a, d), math.hypot(b, e))
        if scene.epsg == scalars.GEOGRAPHIC:
            words = ["Geographic Lat/Lon", 1, 1, east, north, *size, "WGS-84"]
        else:
            words = ["UTM", 1, 1, east, north, *size, (scene.epsg or 32600) % 100, "South" if (scene.epsg or 0) >= 32700 else "North", "WGS-84"]
        fields["map info"] = "{" + ", ".join(map(str, [*words, *([f"rotation={turn}"] if abs(turn) > 1e-12 else [])])) + "}"
    if names := scene.attrs.get("band names"):
        if len(names) == bands:
            fields["band names"] = "{" + ", ".join(names) + "}"
    moved = px.select((F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "bands")
    envi.write_bil(moved, path, layout, fields)


def reproject_raster(spark: SparkSession, source: str, target: str, epsg: int | None = None, method: str = "nearest", resolution=None) -> Scene:
    """A file on a north-up grid, written to another file."""
    made = open_raster(spark, source).reproject(epsg, resolution, method)
    write_scene(made, target)
    return made


def clip_raster(spark: SparkSession, source: str, edges: DataFrame, epsg: int, target: str) -> Scene:
    """A file's cells that polygons touch, written to another file; both must have one reference system."""
    scene = open_raster(spark, source)
    if scene.epsg != epsg:
        raise ValueError("the polygons have another reference system than the raster")
    made = scene.clip(edges, all_touched=True)
    write_scene(made, target)
    return made


def load_scenes(
    spark: SparkSession, root: str, datasets: list[str], lines: DataFrame, dates: tuple[str, str], area: DataFrame, area_epsg: int | None = None, method="first", resolution: float | None = None,
    epsg: int | None = None, resampling: str = "nearest", nodata: float | None = None,
) -> tuple[DataFrame | None, DataFrame | None]:
    """(all dates on one grid: time, y, x and the variables; clipped sensor pixels of scenes without lookup table: time, line, y, x and the variables).

    ``lines``: edges of the flight lines with date, time and geom_id. Scenes of the date range that hold the area, or of a date without such
    meet it, are opened, their datasets merged, orthorectified and clipped; those of a date are merged in order of
    time, and every date is padded to the union of all. Missing files are left out. The list of scenes comes to the driver, no pixel does.
    """
    from . import catalog

    known = lines.select("geom_id", "date", "time").distinct()
    chosen = catalog.between_or_fail(lines, *dates)
    found = geometry.scenes_exact(chosen.select("geom_id", "date", "x1", "y1", "x2", "y2"), area).join(known, ["geom_id", "date"])
    rows = found.select("date", "time").distinct().orderBy("date", "time").collect()
    if not rows:
        raise ValueError("no scene of the date range meets the area")
    wanted = {(r["date"], r["time"]): [] for r in rows}
    listing = catalog.paths(found.select("date", "time").distinct(), root, datasets)
    for r in catalog.existing(listing, root)[0].orderBy("date", "time", "dataset").collect():
        wanted[r["date"], r["time"]].append((r["dataset"], r["path"]))
    by_date: dict[str, list[Scene]] = {}
    failed = []
    for (date, time), files in wanted.items():
        parts = []
        for name, path in sorted(files, key=lambda f: datasets.index(f[0])):
            s = open_raster(spark, path, {"rfl": "reflectance", "rdn": "radiance"}.get(name, name))
            s = Scene(**{**s.__dict__, "transform": None})
            parts.append(s.named(f"{name}_bands"))
        if not parts:
            continue
        scene = reduce(Scene.merge, parts)
        stem = f"{root}/{date}/L1/{{0}}/ang{date}t{time}_{{0}}"
        try:
            table = open_raster(spark, stem.format("glt"), "glt")
        except OSError:
            try:
                place = open_raster(spark, stem.format("igm"), "igm").pixels
            except OSError:
                continue
            place = place.select("y", "x", F.get("bands", F.lit(1)).alias("lat"), F.get("bands", F.lit(0)).alias("lon"))
            clipped = Scene(**{**scene.__dict__, "pixels": scene.pixels.join(place, ["y", "x"])}).clip(area)
            failed.append(clipped.pixels.select(F.lit(date).alias("time"), F.lit(time).alias("line"), "y", "x", *scene.values))
            continue
        edges = geometry.to_epsg(area, area_epsg, table.epsg) if area_epsg and table.epsg and area_epsg != table.epsg else area
        by_date.setdefault(date, []).append(scene.orthorectify(table, edges, nodata))
    merged = []
    for date, scenes in by_date.items():
        target = epsg or scenes[0].epsg
        if len(scenes) > 1:
            merged.append((date, mosaic(scenes, resolution, target, nodata, resampling, method)))
        else:
            s = scenes[0]
            again = resolution is not None and pixels.needs_resampling(s.transform[0], s.epsg, resolution, target) or s.epsg != target
            merged.append((date, s.reproject(target, resolution, resampling) if again else s))
    rest = reduce(DataFrame.unionByName, failed) if failed else None
    if not merged:
        return None, rest
    size = abs(merged[0][1].transform[0])
    left, top = min(s.transform[2] for _, s in merged), max(s.transform[5] for _, s in merged)
    width = max(round((s.transform[2] - left) / size) + s.width for _, s in merged)
    height = max(round((top - s.transform[5]) / size) + s.height for _, s in merged)
    names = merged[0][1].values
    out = []
    for date, s in merged:
        dx, dy = round((s.transform[2] - left) / size), round((top - s.transform[5]) / size)
        px = s.pixels.select((F.col("y") + dy).cast("int").alias("row"), (F.col("x") + dx).cast("int").alias("col"), *names)
        out.append(pixels.canvas(spark, height, width).join(px, ["row", "col"], "left").select(F.lit(date).alias("time"), F.col("row").alias("y"), F.col("col").alias("x"), *names))
    return reduce(DataFrame.unionByName, out), rest

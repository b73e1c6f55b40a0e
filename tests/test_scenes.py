"""The reader, clip, reproject, mosaic and loader on small files that the tests write."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.functions import scalars
from lumigrid.operators import geometry, pixels
from lumigrid.operators.scene import Scene, mosaic, same_grid
from lumigrid.sources import catalog, envi, reader

KINDS = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 6: "c8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
ORDERS = {"bil": (0, 2, 1), "bip": (0, 1, 2), "bsq": (2, 0, 1)}


def put(path, data, code=4, interleave="bil", extra="", order="<", offset=0):
    """A binary of (line, sample, band) and its header."""
    path.parent.mkdir(parents=True, exist_ok=True)
    raw = data.transpose(ORDERS[interleave]).astype(order + KINDS[code]).tobytes()
    path.write_bytes(b"#" * offset + raw)
    lines, samples, bands = data.shape
    path.with_name(path.name + ".hdr").write_text(
        f"ENVI\nsamples = {samples}\nlines = {lines}\nbands = {bands}\nheader offset = {offset}\ndata type = {code}\ninterleave = {interleave}\nbyte order = {int(order == '>')}\n{extra}"
    )
    return str(path)


def values(df, name="bands"):
    return {(r["y"], r["x"]): r[name] for r in df.collect()}


@pytest.mark.parametrize("interleave", ORDERS)
@pytest.mark.parametrize("code", (1, 3, 5, 13, 14, 15))
def test_types_and_pruning(spark, tmp_path, interleave, code):
    """Values in the header's type, exact above 2**24, for any bands and window."""
    rng = np.random.default_rng(code)
    top = {1: 255, 3: 2**31 - 1, 13: 2**32 - 1, 14: 2**60, 15: 2**63}.get(code, 1000)
    data = rng.integers(0, top, (6, 5, 7), dtype=np.uint64).astype(KINDS[code])
    path = put(tmp_path / "a", data, code, interleave, order=">", offset=3)
    scene = reader.open_raster(spark, path, bands=[1, 2, 5], subset={"y": slice(2, 6), "x": slice(1, 4)}, lines=3)
    got = values(scene.pixels)
    assert len(got) == 12 and all([int(v) for v in got[y, x]] == [int(data[y, x, b]) for b in (1, 2, 5)] for y, x in got)


def test_complex_values(spark, tmp_path):
    data = np.arange(8).reshape(2, 2, 2) + 1j
    got = values(reader.open_raster(spark, put(tmp_path / "c", data, 6)).pixels)
    assert [(v["re"], v["im"]) for v in got[1, 1]] == [(6.0, 1.0), (7.0, 1.0)]


INFO = "map info = {UTM, 1, 1, 500000.0, 3800000.0, 10.0, 10.0, 11, North, WGS-84}\n"


@pytest.fixture(scope="module")
def line(tmp_path_factory):
    """A flight line: radiance of 425 bands, igm, obs and glt."""
    root = tmp_path_factory.mktemp("line")
    rng = np.random.default_rng(1)
    rdn = rng.random((8, 6, 425))
    y, x = np.mgrid[0:8, 0:6]
    igm = np.stack([500015.0 + 10 * x, 3799985.0 - 10 * y, 100.0 + y], axis=2)
    glt = np.zeros((10, 9, 2))
    glt[:, :, :] = -9999
    for gy in range(1, 9):
        for gx in range(1, 7):
            glt[gy, gx] = (gx, gy)  # sample, line, from 1
    base = root / "20220224" / "L1"
    stem = "ang20220224t200332"
    put(base / "igm" / f"{stem}_igm", igm, 5)
    put(base / "obs" / f"{stem}_obs", rng.random((8, 6, 11)), 5)
    put(base / "glt" / f"{stem}_glt", glt, 3, extra=INFO)
    path = put(base / "rdn" / f"{stem}_rdn_v2aa1_clip", rdn)
    put(root / "20220224" / "L2a" / f"{stem}_rfl", rdn)
    return str(root), path, rdn.astype("f4"), igm


def test_paths(line):
    root, path, *_ = line
    assert reader.supporting_file(path, "igm") == f"{root}/20220224/L1/igm/ang20220224t200332_igm"
    assert reader.supporting_file(f"{root}/20220224/L2a/ang20220224t200332_rfl", "glt") == f"{root}/20220224/L1/glt/ang20220224t200332_glt"
    assert [reader.dataset_of_path(p) for p in (path, "a/L2a/x", "a/obs/x", "x")] == ["radiance", "reflectance", "obs", None]


def test_reader_bands_and_windows(spark, line):
    _, path, rdn, _ = line
    size = lambda s: len(s.pixels.first()["bands"])
    assert size(reader.open_scene(spark, path, filter_bands=True)) == 337
    assert size(reader.open_scene(spark, path, filter_bands=[0, 1, 2, 3, 424])) == 420
    obs = reader.open_scene(spark, path.replace("/rdn/", "/obs/").replace("_rdn_v2aa1_clip", "_obs"), filter_bands=True)
    assert obs.values == list(pixels.OBS) and obs.schema()["dims"] == {"y": 8, "x": 6}
    got = values(reader.open_scene(spark, path, subset={"y": slice(2, 5), "x": slice(1, 6)}).pixels)
    assert len(got) == 15 and np.array_equal(np.array(got[4, 5], "f4"), rdn[4, 5])
    # strictly inside, without the last row and column
    where = {"lat": (3799985 - 65, 3799985 - 5), "lon": (500015 + 5, 500015 + 45)}
    got = values(reader.open_scene(spark, path, subset=where).pixels, "elevation")
    assert sorted(got) == [(y, x) for y in range(1, 6) for x in range(1, 4)] and got[3, 2] == 103.0
    with pytest.raises(ValueError):
        reader.open_scene(spark, path, subset={"lat": (0, 1), "lon": (0, 1)})


def test_reader_orthorectifies(spark, line):
    _, path, rdn, igm = line
    got = {(r["y"], r["x"]): r for r in reader.open_scene(spark, path, ortho=True, filter_bands=list(range(3, 425))).pixels.collect()}
    assert len(got) == 90 and got[0, 0]["bands"] is None
    for gy in range(1, 9):
        for gx in range(1, 7):
            r = got[gy, gx]
            assert np.array_equal(np.array(r["bands"], "f4"), rdn[gy - 1, gx - 1, :3]) and r["elevation"] == igm[gy - 1, gx - 1, 2]
            assert (r["lon"], r["lat"]) == (500000 + 10 * gx, 3800000 - 10 * gy)
    cut = reader.open_scene(spark, path, ortho=True, filter_bands=list(range(3, 425)), subset={"y": slice(2, 5), "x": slice(1, 3)})
    assert sorted(values(cut.pixels)) == [(y, x) for y in range(3, 6) for x in range(2, 4)]
    igm_scene = reader.open_scene(spark, path.replace("/rdn/", "/igm/").replace("_rdn_v2aa1_clip", "_igm"), ortho=True)
    assert igm_scene.values == ["elevation"] and igm_scene.epsg == 32611
    with pytest.raises(ValueError):
        reader.open_scene(spark, path.replace("/rdn/", "/glt/").replace("_rdn_v2aa1_clip", "_glt"), ortho=True)
    with pytest.raises(FileNotFoundError):
        reader.open_scene(spark, path, ortho=True, glt=path + "_none")


def box(spark, x0, y0, x1, y1, g=1):
    return geometry.edges_of(spark, {g: [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]})


def test_reader_polygon(spark, line, tmp_path):
    _, path, rdn, _ = line
    area = box(spark, 500021, 3800000 - 59, 500049, 3800000 - 21)
    cut = reader.open_scene(spark, path, ortho=True, filter_bands=list(range(3, 425)), subset=area)
    got = values(cut.pixels)
    assert sorted(got) == [(y, x) for y in range(2, 6) for x in range(2, 5)]
    assert np.array_equal(np.array(got[2, 3], "f4"), rdn[1, 2, :3])
    ring = [[500021, 3799941], [500049, 3799941], [500049, 3799979], [500021, 3799979], [500021, 3799941]]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    again = reader.open_scene(spark, path, ortho=True, filter_bands=list(range(3, 425)), subset=str(tmp_path / "a.geojson"))
    assert values(again.pixels) == got
    with pytest.raises(ValueError):
        reader.open_scene(spark, path, ortho=True, subset=box(spark, 0, 0, 1, 1))


def scene_of(spark, data, transform, epsg=32611, nodata=None):
    rows = [(y, x, None if data[y, x] != data[y, x] else float(data[y, x])) for y in range(data.shape[0]) for x in range(data.shape[1])]
    return Scene(spark.createDataFrame(rows, "y int, x int, v double"), "reflectance", *data.shape, transform, epsg, nodata)


def test_clip_gives_nodata_and_crops(spark):
    s = scene_of(spark, np.arange(36.0).reshape(6, 6), (1.0, 0, 0.0, 0, -1.0, 6.0))
    triangle = geometry.edges_of(spark, {1: [[(1, 1), (5, 1), (1, 5)]], 2: [[(1, 1), (3, 1), (3, 3), (1, 3)]]})
    got = values(s.clip(triangle).pixels, "v")
    want = {(y, x): float(6 * y + x) for y in range(6) for x in range(6) if x + 0.5 > 1 and 5.5 - y > 1 and (x + 0.5) + (5.5 - y) < 6}
    ys, xs = [y for y, _ in want], [x for _, x in want]
    assert {k: v for k, v in got.items() if v is not None} == want
    assert sorted(got) == [(y, x) for y in range(min(ys), max(ys) + 1) for x in range(min(xs), max(xs) + 1)]
    wide = values(s.clip(triangle, all_touched=True).pixels, "v")
    assert {k for k, v in wide.items() if v is not None} > set(want)
    with pytest.raises(ValueError):
        s.clip(box(spark, 50, 50, 60, 60))
    with pytest.raises(ValueError):
        s.orthorectify(s)


def test_reproject(spark, tmp_path):
    data = np.arange(24.0).reshape(4, 6)
    t = (2.6, 0, 500000.0, 0, -2.6, 3800000.0)
    s = scene_of(spark, data, t)
    same = s.reproject()
    assert same.transform == pytest.approx(t) and values(same.pixels, "v") == values(s.pixels, "v")
    for method in pixels.RESAMPLING:
        if method != "gauss" and method != "sum":
            assert values(s.reproject(method=method).pixels, "v") == pytest.approx(values(s.pixels, "v"), abs=1e-6)
    half = values(s.reproject(resolution=5.2, method="average").pixels, "v")
    assert half == {(y, x): data[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean() for y in range(2) for x in range(3)}
    geo = s.reproject(4326, (2e-5, 2e-5))
    assert geo.epsg == 4326 and geo.transform[0] == 2e-5 and geo.transform[4] == -2e-5
    back = geo.pixels.where("v IS NOT NULL").count()
    assert back > 0.6 * geo.height * geo.width
    turned = "map info = {UTM, 1, 1, 500000.0, 3800000.0, 2.6, 2.6, 16, North, WGS-84, rotation=-74}\ndata ignore value = -9999\nwavelength = {1.0, 2.0}\n"
    path = put(tmp_path / "turned", np.random.default_rng(0).random((12, 9, 2)), 4, "bsq", turned)
    made = reader.reproject_raster(spark, path, str(tmp_path / "north"))
    again = reader.open_raster(spark, str(tmp_path / "north"))
    assert again.epsg == 32616 and again.transform == pytest.approx(made.transform) and again.transform[1] == again.transform[3] == 0
    assert (again.transform[0], again.transform[4]) == pytest.approx((2.6, -2.6)) and again.wavelength == (1.0, 2.0)
    assert again.pixels.where("exists(bands, v -> v IS NOT NULL)").count() == made.pixels.where("bands IS NOT NULL").count() > 80
    with pytest.raises(ValueError):
        s.reproject(method="none")


def test_clip_raster(spark, tmp_path):
    path = put(tmp_path / "r", np.random.default_rng(0).random((12, 9, 2)), 4, "bsq", INFO)
    area = box(spark, 500015, 3799935, 500055, 3799975)
    with pytest.raises(ValueError):
        reader.clip_raster(spark, path, area, 32612, str(tmp_path / "cut"))
    reader.clip_raster(spark, path, area, 32611, str(tmp_path / "cut"))
    cut = reader.open_raster(spark, str(tmp_path / "cut"))
    assert (cut.height, cut.width, cut.transform) == (5, 5, (10.0, 0.0, 500010.0, 0.0, -10.0, 3799980.0))


def test_affine_and_projection(spark):
    t = (2.0, 0.5, 10.0, -0.3, -3.0, 20.0)
    assert scalars.affine_inverse(t, *scalars.affine(t, 7.0, 4.0)) == pytest.approx((7.0, 4.0))
    p = spark.createDataFrame([(-120.1, 34.5), (-117.0, -10.0)], "lon double, lat double")
    zone = p.select(scalars.utm_zone_epsg(F.col("lat"), F.col("lon")).alias("e")).collect()
    assert [r["e"] for r in zone] == [32610, 32711] == [scalars.utm_zone_epsg(34.5, -120.1), scalars.utm_zone_epsg(-10.0, -117.0)]
    there = p.limit(1).select(*[c.alias(n) for c, n in zip(scalars.projected(F.col("lon"), F.col("lat"), 4326, 32610), "xy")])
    over = there.select(*[c.alias(n) for c, n in zip(scalars.projected(F.col("x"), F.col("y"), 32610, 32611), "xy")])
    back = over.select(*[c.alias(n) for c, n in zip(scalars.projected(F.col("x"), F.col("y"), 32611, 4326), "xy")]).first()
    assert tuple(back) == pytest.approx((-120.1, 34.5), abs=1e-7)
    with pytest.raises(ValueError):
        scalars.projected(F.lit(0), F.lit(0), 4326, 3857)
    low, high = spark.range(1).select(*scalars.index_window(F.lit(1.5), F.lit(3.2))).first()
    assert (low, high) == (1, 4)


def test_mosaic_of_scenes(spark):
    nan = float("nan")
    a = scene_of(spark, np.array([[1, 2], [3, nan]]), (10.0, 0, 0.0, 0, -10.0, 20.0))
    b = scene_of(spark, np.array([[5, 6], [7, 8.0]]), (10.0, 0, 10.0, 0, -10.0, 10.0))
    got = values(mosaic([a, b]).pixels, "v")
    assert got == {(0, 0): 1, (0, 1): 2, (0, 2): None, (1, 0): 3, (1, 1): 5, (1, 2): 6, (2, 0): None, (2, 1): 7, (2, 2): 8}
    fine = scene_of(spark, np.full((4, 4), 9.0), (5.0, 0, 10.0, 0, -5.0, 10.0))
    assert values(mosaic([a, fine], method="sum").pixels, "v")[2, 2] == 9 and not same_grid([a, fine])
    assert mosaic([a, b, b], method=lambda p, q: p - q).pixels.where("y = 2 AND x = 2").first()["v"] == 0
    with pytest.raises(ValueError):
        mosaic([a])
    with pytest.raises(ValueError):
        mosaic([a, b], method="median")
    bands = Scene(a.pixels.select("y", "x", F.array("v", F.col("v") * 2).alias("bands")), **{k: v for k, v in a.__dict__.items() if k != "pixels"})
    assert values(mosaic([bands, bands], method="sum").pixels)[1, 0] == [6.0, 12.0]


def test_scenes_exact(spark):
    area = box(spark, 40, 40, 60, 60, 0)
    shapes = {1: [[(0, 0), (100, 0), (100, 100), (0, 100)]], 2: [[(50, 50), (90, 50), (90, 90), (50, 90)]], 3: [[(0, 0), (45, 0), (0, 45)]], 4: [[(45, 45), (50, 45), (50, 50)]], 5: [[(0, 50), (100, 45), (100, 55)]], 6: [[(200, 0), (201, 0), (201, 1)]]}
    dates = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "b"), (5, "c"), (6, "d")], "geom_id int, date string")
    edges = geometry.edges_of(spark, shapes).join(dates.dropDuplicates(["geom_id"]), "geom_id")
    got = {(r["geom_id"], r["contains"]) for r in geometry.scenes_exact(edges, area).collect()}
    # 2 meets the area, but 1 of its date holds it; the box of 3 meets the area, its triangle does not
    assert got == {(1, True), (4, False), (5, False)}


@pytest.mark.parametrize("corners,small", [(3, 10_000), (40, 10_000), (40, 10)])
def test_scenes_exact_by_brute_force(spark, monkeypatch, corners, small):
    """An area of few edges, of several bands, and one too large to be sent whole."""
    monkeypatch.setattr(geometry, "SMALL_EDGES", small)
    rng = np.random.default_rng(corners)
    turn = 2 * np.pi * np.arange(corners) / corners
    ring = [(50 + r * np.cos(t), 50 + r * np.sin(t)) for t, r in zip(turn, 6 + 6 * rng.random(corners))]
    shapes = {}
    for g in range(300):
        x, y, w, h = rng.uniform(0, 80), rng.uniform(0, 80), *rng.choice([1.0, 9.0, 60.0], 2)
        shapes[g] = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)][: 3 + g % 2]
    sides = lambda ring: list(zip(ring, [*ring[1:], ring[0]]))
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def holds(ring, p):
        return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in sides(ring)) % 2 == 1

    met, date = {}, {g: f"d{g // 12}" for g in shapes}
    for g, shape in shapes.items():
        cut = any(side(*e, a[0]) * side(*e, a[1]) < 0 and side(*a, e[0]) * side(*a, e[1]) < 0 for e in sides(shape) for a in sides(ring))
        held = [holds(shape, p) for p in ring]
        if cut or any(held) or any(holds(ring, p) for p in shape):
            met[g] = all(held) and not cut
    full = {date[g] for g, contains in met.items() if contains}
    want = {(g, date[g], c) for g, c in met.items() if c or date[g] not in full}
    rows = spark.createDataFrame(list(date.items()), "geom_id int, date string")
    edges = geometry.edges_of(spark, {g: [s] for g, s in shapes.items()}).join(rows, "geom_id")
    made = geometry.scenes_exact(edges, geometry.edges_of(spark, {0: [ring]}))
    assert {tuple(r) for r in made.collect()} == want and {c for *_, c in want} == {True, False}
    # Beside few edges, no row is made for each band that a scene's edge passes.
    if corners == 3:
        assert "sequence(" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_loader(spark, line):
    root, path, rdn, _ = line
    lines = box(spark, 499000, 3799000, 501000, 3801000).withColumns({"date": F.lit("20220224"), "time": F.lit("200332")})
    area = box(spark, 500021, 3799941, 500049, 3799979)
    made, failed = reader.load_scenes(spark, root, ["rfl", "rdn"], lines, ("20220201", "20220301"), area)
    got = {(r["y"], r["x"]): r for r in made.collect() if r["rfl_bands"] is not None}
    assert failed is None and made.columns == ["time", "y", "x", "rfl_bands", "rdn_bands"] and len(got) == 12
    assert np.array_equal(np.array(got[2, 3]["rdn_bands"], "f4"), rdn[1, 2])
    with pytest.raises(ValueError):
        reader.load_scenes(spark, root, ["rfl"], lines, ("20230101", "20230201"), area)
    with pytest.raises(ValueError):
        reader.load_scenes(spark, root, ["rfl"], lines, ("20220201", "20220301"), box(spark, 0, 0, 1, 1))


def test_index_stores(spark, tmp_path):
    files = spark.createDataFrame([("a", "reflectance", 0, 3, 4, 2, None, 4, 5)], "source_path string, var string, time_ix int, samples int, lines int, bands int, layer int, size int, header_offset int")
    wave = np.array([1.5, 2.5], "f4")
    envi.write_index(envi.chunk_index(files), str(tmp_path / "i.json"), envi.array_entries("wavelength", wave, ["wavelength"]))
    made = json.loads((tmp_path / "i.json").read_text())
    assert made["version"] == 1 and made["refs"]["reflectance/0.2.0.0"] == ["a", 5 + 2 * 24, 24]
    import base64

    assert np.array_equal(np.frombuffer(base64.b64decode(made["refs"]["wavelength/0"][7:]), "f4"), wave)
    with pytest.raises(ValueError):
        envi.write_index(envi.chunk_index(files), str(tmp_path / "i.txt"))


def test_catalog_checks(spark, line):
    root = line[0]
    found = spark.createDataFrame([(f"{root}/20220224/L1/obs/ang20220224t200332_obs",), ("/none",)], "path string")
    there, missing = catalog.existing(found, root)
    assert there.count() == 1 and [r["path"] for r in missing.collect()] == ["/none"]
    e = spark.createDataFrame([(1, 32611), (2, 32611)], "i int, epsg int")
    assert catalog.all_equal(e, "epsg") and not catalog.all_equal(e, "i")
    with pytest.raises(ValueError):
        catalog.between_or_fail(spark.createDataFrame([("20220101",)], "date string"), "2023", "2024")


def test_batches(spark):
    p = spark.range(25).select((F.col("id") / 5).cast("int").alias("y"), (F.col("id") % 5).cast("int").alias("x"))
    got = {(r["y"], r["x"]): r["batch"] for r in pixels.batches(p, ["y", "x"], 4).collect()}
    assert got == {(i // 5, i % 5): i // 4 for i in range(25)}

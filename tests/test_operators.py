import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigrid.operators import geometry, pca, pixels
from lumigrid.sources import catalog, envi


def cube(spark, lines=10, samples=10, bands=425):
    data = F.array(*[F.lit(float(k)) for k in range(bands)])
    i = F.col("id")
    return spark.range(lines * samples).select((i / samples).cast("int").alias("y"), (i % samples).cast("int").alias("x"), data.alias("bands"))


def test_band_counts(spark):
    c = cube(spark)
    size = lambda df: df.select(F.size("bands")).first()[0]
    assert size(pixels.band_filter(c, "reflectance")) == 337
    assert size(pixels.band_filter(c, "radiance", [0, 1, 2, 3, 424])) == 420
    assert size(pixels.band_filter(c, "igm")) == 425


def test_index_window_and_reader_guards(spark):
    i = F.col("id")
    p = spark.range(200 * 600).select((i / 600).cast("int").alias("y"), (i % 600).cast("int").alias("x"))
    assert pixels.window(p, (20, 180), (55, 500)).count() == 160 * 445
    with pytest.raises(ValueError):
        envi.read_cube(spark, "none", subset="area.shp")
    with pytest.raises(ValueError):
        envi.read_cube(spark, "none", dataset="glt", ortho=True)


def test_identity_lookup_gives_the_input(spark):
    c = cube(spark, 4, 5, 3)
    cells = c.select(F.col("y").alias("gy"), F.col("x").alias("gx"), (F.col("y") + 1).alias("src_y"), (F.col("x") + 1).alias("src_x"))
    out = pixels.orthorectify(c, pixels.glt(cells))
    assert out.where("gy <> src_y OR gx <> src_x OR bands IS NULL").count() == 0 and out.count() == 20


def test_merge_methods(spark):
    rows = [(0, 0, 1, None), (0, 0, 2, 5.0), (0, 0, 3, 2.0), (0, 1, 1, None)]
    v = spark.createDataFrame(rows, "row int, col int, src int, v double")
    want = {"first": 5.0, "last": 2.0, "min": 2.0, "max": 5.0, "sum": 7.0, "count": 2}
    for method, x in want.items():
        got = {r["col"]: r["v"] for r in pixels.mosaic(v, method).collect()}
        assert got == {0: x, 1: None}
    assert {r["v"] for r in pixels.mosaic(v, lambda a, b: a - b).collect()} == {3.0, None}
    with pytest.raises(ValueError):
        pixels.merged("median")


def test_overlapping_polygons_give_a_point_once(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 2)]
    edges = geometry.edges_of(spark, {1: [square, hole], 2: [[(2, 2), (6, 2), (6, 6), (2, 6)]]})
    p = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 5.0, 5.0), (4, 9.0, 9.0)], "id int, px double, py double")
    assert sorted(r["id"] for r in geometry.clip(p, edges, "id").collect()) == [1, 3]
    wkt = spark.createDataFrame([(1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))")], "geom_id int, wkt string")
    assert sorted(r["id"] for r in geometry.clip(p, geometry.wkt_edges(wkt), "id").collect()) == [1]


def test_pca_against_full_decomposition(spark):
    x = np.random.default_rng(1).normal(size=(60, 5)) @ np.diag([5, 3, 1, 1, 1])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, [1.0, None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, bands array<double>")
    got = {r["id"]: r["pca"] for r in pca.fit(df, 2).transform(df).collect()}
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (u * s)[:, :2]
    assert got[99] is None
    assert np.abs(np.abs([got[i] for i in range(60)]) - np.abs(want)).max() < 1e-8


def test_moments_by_brute_force(spark):
    rows = [[1.0, 2.0, 3.0], [4.0, 5.0], [2.0, -1.0, 0.5], [1.0, float("nan"), 1.0], [None, 1.0], [], None, [7.0, 1.0, 2.0]]
    df = spark.createDataFrame([(r,) for r in rows], "bands array<double>").repartition(3)
    want = {}
    for r in rows:
        if r is None or any(v is None or v != v for v in r):
            continue
        for i in range(len(r)):
            for j in range(i, len(r)):
                old = want.get((i, j), (0, 0.0, 0.0, 0.0))
                want[i, j] = tuple(a + b for a, b in zip(old, (1, r[i], r[j], r[i] * r[j])))
    assert {(r["i"], r["j"]): tuple(r)[2:] for r in pca.moments(df).collect()} == want
    assert pca.moments(df.limit(0)).count() == 0


def test_reducers_on_an_aligned_grid_are_block_reducers(spark):
    rng = np.random.default_rng(4)
    rows = [(r, c, None if rng.random() < 0.2 else float(rng.integers(0, 6))) for r in range(12) for c in range(9)]
    values = spark.createDataFrame(rows, "row int, col int, v double")
    target = pixels.canvas(spark, 4, 3).selectExpr("row", "col", "row * 3.0D + 1 AS at_row", "col * 3.0D + 1 AS at_col")
    want = {(r["row"], r["col"]): r for r in pixels.reduced(values, 3).collect()}
    for m in pixels.REDUCERS:
        got = pixels.resampled(values, target, m, scale=(3, 3)).collect()
        assert len(got) == 12
        for r in got:
            assert r["v"] == pytest.approx(want[r["row"], r["col"]][m])
    fine = spark.createDataFrame([(0, 0, 3.3, 2.8)], "row int, col int, at_row double, at_col double")
    assert pixels.resampled(values, fine, "max", scale=(0.1, 0.1)).first()["v"] == next(v for r, c, v in rows if (r, c) == (3, 3))


def test_binary_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(7, 6, 4)).astype("<f4")
    data[0, 0, 0] = -9999
    path = str(tmp_path / "scene")
    (tmp_path / "scene").write_bytes(b"#" * 12 + data.transpose(0, 2, 1).tobytes())
    (tmp_path / "scene.hdr").write_text("ENVI\nsamples = 6\nlines = 7\nbands = 4\nheader offset = 12\ndata type = 4\ninterleave = bil\nbyte order = 0\ndata ignore value = -9999\n")
    envi.register(spark)
    df = envi.read_cube(spark, path, subset={"y": slice(0, 5), "x": slice(0, 3)}, lines=2)
    assert df.rdd.getNumPartitions() == 3
    rows = {(r["y"], r["x"]): r["bands"] for r in df.collect()}
    assert len(rows) == 15 and rows[0, 0][0] is None
    assert np.allclose(rows[4, 2], data[4, 2])
    full = envi.read_cube(spark, path)
    layout = envi.Layout(6, 7, 4, nodata=-9999.0)
    envi.write_bil(full, str(tmp_path / "out"), layout, block=2)
    assert (tmp_path / "out").read_bytes() == data.transpose(0, 2, 1).tobytes()
    assert envi.read_cube(spark, str(tmp_path / "out")).exceptAll(full).count() == 0


def test_headers():
    h = envi.parse_header("ENVI\nsamples = 3\n; x = 1\nBand Names = {a,\n b}\ndescription = {one, two}\n")
    assert h == {"samples": "3", "band names": ["a", "b"], "description": "one, two"}
    with pytest.raises(ValueError):
        envi.parse_header("samples = 3")


def test_unknown_dataset(spark):
    lines = spark.createDataFrame([("20240101", "000000")], "date string, time string")
    with pytest.raises(ValueError):
        catalog.paths(lines, "/data", ["other"])


@pytest.mark.parametrize("grid", [False, True])
def test_fold_of_long_cells(spark, grid):
    """Several runs in a cell, in order from end to end; the order's columns are sorted as rows and not kept in lists."""
    i = F.col("id")
    rows = spark.range(3007).select(
        F.lit(0).alias("row"), F.when(i % 50 == 7, 2).when(i % 50 == 3, 1).otherwise(0).cast("int").alias("col"),
        F.struct((i * 7919 % 3001).alias("a"), i.alias("b")).alias("src"), F.when((i % 5 > 0) & (i % 50 != 7), (i % 13).cast("double")).alias("v"),
    )
    want = {0: None, 1: None, 2: None}
    for r in sorted(rows.repartition(5).collect(), key=lambda r: r["src"]):
        if r["v"] is not None:
            want[r["col"]] = r["v"] if want[r["col"]] is None else want[r["col"]] * 0.5 + r["v"]
    made = pixels.mosaic(rows.repartition(5), lambda a, b: a * 0.5 + b, grid=pixels.canvas(spark, 1, 4) if grid else None)
    assert {r["col"]: r["v"] for r in made.collect()} == want | ({3: None} if grid else {})
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(" not in plan and "row_number()" in plan
    column = rows.groupBy("col").agg(pixels.merged(lambda a, b: a * 0.5 + b).alias("v"))
    assert {r["col"]: r["v"] for r in column.collect()} == want
    assert "array_sort(" not in column._jdf.queryExecution().optimizedPlan().toString()

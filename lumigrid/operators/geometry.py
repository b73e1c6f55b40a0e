"""Polygons as edge tables, and what is done with them.

An edge is a row (geom_id, ring_id, seq, x1, y1, x2, y2); a point is inside where the rays' parity over
all rings of a geometry is odd, so holes and multipolygons need no care. Points that several polygons
cover appear once. An edge table of up to ``SMALL_EDGES`` rows, counted first, is sent whole; a larger one is
joined by cells of a coarse grid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

SMALL_EDGES = 10_000
EDGES = "geom_id int, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double"


def edges_of(spark: SparkSession, polygons: dict[int, list[list[tuple[float, float]]]]) -> DataFrame:
    """Edges of polygons given as rings of corners."""
    rows = [
        (g, r, s, float(a[0]), float(a[1]), float(b[0]), float(b[1]))
        for g, rings in polygons.items()
        for r, ring in enumerate(rings)
        for s, (a, b) in enumerate(zip(ring, [*ring[1:], ring[0]]))
    ]
    return spark.createDataFrame(rows, EDGES)


def wkt_edges(texts: DataFrame) -> DataFrame:
    """Edges of ``texts`` (geom_id, wkt: POLYGON or MULTIPOLYGON), rings closed or not."""
    rings = F.regexp_extract_all(F.col("wkt"), F.lit(r"\(([^()]+)\)"), 1)
    r = texts.select("geom_id", F.posexplode(rings).alias("ring_id", "ring"))
    p = r.select("geom_id", "ring_id", F.transform(F.split("ring", ","), lambda t: F.transform(F.split(F.trim(t), r"\s+"), lambda v: v.cast("double"))).alias("p"))
    e = p.select("geom_id", "ring_id", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("seq"))
    a, b = F.get("p", F.col("seq")), F.get("p", (F.col("seq") + 1) % F.size("p"))
    e = e.select("geom_id", "ring_id", "seq", a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    return e.where("x1 <> x2 OR y1 <> y2")


def geojson_edges(texts: DataFrame) -> DataFrame:
    """Edges of ``texts`` (geom_id, json: a Polygon or MultiPolygon geometry)."""
    ring = F.regexp_extract_all(F.get_json_object("json", "$.coordinates"), F.lit(r"\[((?:\[[^\[\]]+\],?\s*)+)\]"), 1)
    corner = lambda t: F.transform(F.slice(F.split(t, ","), 1, 2), lambda v: F.trim(v))
    plain = lambda r: F.array_join(F.transform(F.regexp_extract_all(r, F.lit(r"\[([^\[\]]+)\]"), 1), lambda t: F.array_join(corner(t), " ")), ", ")
    return wkt_edges(texts.select("geom_id", F.concat(F.lit("("), F.array_join(F.transform(ring, plain), "), ("), F.lit(")")).alias("wkt")))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Edges of the polygons of a file: GeoJSON (``.json``, ``.geojson``) or a line of WKT for each."""
    if path.endswith(("json",)):
        text = spark.read.text(path, wholetext=True)
        shapes = F.from_json(F.get_json_object("value", "$.features"), "array<struct<geometry:string>>")
        several = text.select(F.posexplode(F.coalesce(shapes, F.array(F.struct(F.col("value").alias("geometry"))))).alias("geom_id", "f"))
        return geojson_edges(several.select("geom_id", F.col("f.geometry").alias("json")))
    return wkt_edges(spark.read.text(path).where("value LIKE '%(%'").select(F.hash("value").alias("geom_id"), F.col("value").alias("wkt")))


def to_epsg(edges: DataFrame, source: int, target: int) -> DataFrame:
    """Edges in another reference system, corner by corner."""
    (x1, y1), (x2, y2) = (scalars.projected(F.col(f"x{k}"), F.col(f"y{k}"), source, target) for k in (1, 2))
    return edges.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})


def bounds(edges: DataFrame) -> tuple[float, float, float, float]:
    """min x, min y, max x, max y of all edges; an error without any."""
    found = edges.agg(F.min(F.least("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("x1", "x2")), F.max(F.greatest("y1", "y2"))).first()
    if found[0] is None:
        raise ValueError("the polygons have no edges")
    return tuple(found)


def crosses(x: Column, y: Column, edge: str = "") -> Column:
    """Whether the ray from a point to the right meets an edge; ``edge``: what its columns' names begin with."""
    x1, y1, x2, y2 = (F.col(edge + c) for c in ("x1", "y1", "x2", "y2"))
    spans = (y1 > y) != (y2 > y)
    return spans & (x < x1 + (y - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0)))


def inside(points: DataFrame, edges: DataFrame, id: str, x: str = "px", y: str = "py") -> DataFrame:
    """id, geom_id of each point (unique id) in each polygon."""
    box = edges.agg(*[f(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x1"), (F.max, "y1"))], F.count("*")).first()
    near = points.select(id, x, y)
    if box[0] is None:
        return near.select(id, F.lit(None).cast("int").alias("geom_id")).limit(0)
    near = near.where(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3]))
    if box[4] <= SMALL_EDGES:
        met = near.join(F.broadcast(edges), crosses(F.col(x), F.col(y)))
    else:  # rays only meet edges of their band of y
        height = max((box[3] - box[1]) / 1024, 1e-12)
        band = lambda c: F.floor((c - box[1]) / height)
        low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
        cut = edges.withColumn("band", F.explode(F.sequence(band(low), band(high))))
        met = near.withColumn("band", band(F.col(y))).join(cut, "band").where(crosses(F.col(x), F.col(y)))
    return met.groupBy(id, "geom_id").agg(F.count("*").alias("n")).where("n % 2 = 1").select(id, "geom_id")


def clip(points: DataFrame, edges: DataFrame, id: str, x: str = "px", y: str = "py") -> DataFrame:
    """The points inside any polygon, each once."""
    return points.join(inside(points, edges, id, x, y).select(id).distinct(), id, "left_semi")


def zonal(points: DataFrame, edges: DataFrame, id: str, value: str, x: str = "px", y: str = "py") -> DataFrame:
    """Count, mean, least and greatest value of the points in each polygon."""
    hit = inside(points, edges, id, x, y).join(points.select(id, value), id)
    v = F.col(value)
    return hit.groupBy("geom_id").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))


def touched(cells: DataFrame, edges: DataFrame, id: str, size: float, x: str = "px", y: str = "py") -> DataFrame:
    """Cells (lower left corner, size) whose square meets a polygon: its centre is inside, or an edge meets it."""
    cx, cy = F.col(x), F.col(y)
    centre = cells.select(id, (cx + size / 2).alias("mx"), (cy + size / 2).alias("my"))
    within = inside(centre, edges, id, "mx", "my").select(id)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    # Clip the edge's parameter 0..1 to the square (Liang and Barsky).
    low, high, open_ = F.lit(0.0), F.lit(1.0), F.lit(True)
    for d, a, b in ((dx, cx - F.col("x1"), cx + size - F.col("x1")), (dy, cy - F.col("y1"), cy + size - F.col("y1"))):
        t1, t2 = a / F.nullif(d, F.lit(0.0)), b / F.nullif(d, F.lit(0.0))
        low, high = F.greatest(low, F.least(t1, t2)), F.least(high, F.greatest(t1, t2))
        open_ = open_ & ((d != 0) | ((a <= 0) & (b >= 0)))
    boxes = F.greatest("x1", "x2") >= cx
    boxes &= (F.least("x1", "x2") <= cx + size) & (F.greatest("y1", "y2") >= cy) & (F.least("y1", "y2") <= cy + size)
    if edges.count() <= SMALL_EDGES:
        met = cells.select(id, x, y).join(F.broadcast(edges), boxes & open_ & (low <= high)).select(id)
    else:
        rows = F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size)
        cut = edges.withColumn("band", F.explode(F.sequence(*rows)))
        own = cells.select(id, x, y).withColumn("band", F.explode(F.array(F.floor(cy / size), F.floor(cy / size) + 1)))
        met = own.join(cut, "band").where(boxes & open_ & (low <= high)).select(id)
    return cells.join(within.unionByName(met).distinct(), id, "left_semi")


def scenes_for(scenes: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """Scenes (date, minx..maxy) that contain the area; of a date without such, those that meet it."""
    x0, y0, x1, y1 = area
    meets = (F.col("minx") <= x1) & (F.col("maxx") >= x0) & (F.col("miny") <= y1) & (F.col("maxy") >= y0)
    holds = (F.col("minx") <= x0) & (F.col("maxx") >= x1) & (F.col("miny") <= y0) & (F.col("maxy") >= y1)
    s = scenes.where(meets).withColumn("contains", holds)
    any_ = s.groupBy("date").agg(F.max("contains").alias("any"))
    return s.join(any_, "date").where("contains OR NOT any").drop("any")


def scenes_exact(scenes: DataFrame, area: DataFrame) -> DataFrame:
    """Scenes whose polygons hold the whole area; of a date without such, those that meet it: geom_id, date, contains.

    ``scenes``: edges with geom_id and date, rings closed; ``area``: edges. Each scene edge within the area's range of y meets the
    area's edges, sent whole up to ``SMALL_EDGES``, through bands of y whose number follows the area's edges. What is shuffled
    are the hits: rays from the area's corners, rays from the scene's corners, and crossings.
    """
    _, y0, _, y1 = bounds(area)
    total = area.count()
    bands = min(max(total // 16, 1), 1024)
    height = max((y1 - y0) / bands, 1e-12)
    band = lambda y: F.floor((y - y0) / height)
    spread = lambda a, b: F.explode(F.sequence(band(F.greatest(F.least(a, b), F.lit(y0))), band(F.least(F.greatest(a, b), F.lit(y1)))))
    theirs = scenes.select("geom_id", "date", "x1", "y1", "x2", "y2").where((F.least("y1", "y2") <= y1) & (F.greatest("y1", "y2") >= y0)).withColumn("edge", F.monotonically_increasing_id())
    mine = area.select(F.monotonically_increasing_id().alias("corner"), *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")])
    if bands > 1:
        theirs, mine = theirs.withColumn("band", spread(F.col("y1"), F.col("y2"))), mine.withColumn("band", spread(F.col("ay1"), F.col("ay2")))
        pairs = theirs.join(F.broadcast(mine) if total <= SMALL_EDGES else mine, "band")
        here = lambda y: F.col("band") == band(F.col(y))
    else:
        pairs, here = theirs.join(F.broadcast(mine)), lambda y: F.lit(True)

    def side(px: str, py: str, qx: str, qy: str, rx: str, ry: str) -> Column:
        return (F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px))

    met = (side("x1", "y1", "x2", "y2", "ax1", "ay1") * side("x1", "y1", "x2", "y2", "ax2", "ay2") < 0) & (side("ax1", "ay1", "ax2", "ay2", "x1", "y1") * side("ax1", "ay1", "ax2", "ay2", "x2", "y2") < 0)
    # A ray counts in the band of its corner; a crossing may be found in several.
    hits = {"held": (here("ay1") & crosses(F.col("ax1"), F.col("ay1")), F.col("corner")), "within": (here("y1") & crosses(F.col("x1"), F.col("y1"), "a"), F.col("edge")), "cut": (met, F.lit(0).cast("long"))}
    each = F.explode(F.array(*[F.when(hit, F.struct(F.lit(kind).alias("kind"), k.alias("k"))) for kind, (hit, k) in hits.items()]))
    found = pairs.where(reduce(lambda a, b: a | b, [hit for hit, _ in hits.values()])).select("geom_id", "date", each.alias("h")).where("h IS NOT NULL").select("geom_id", "date", "h.*")
    odd = found.groupBy("geom_id", "date", "kind", "k").agg(F.count("*").alias("n")).where("kind = 'cut' OR n % 2 = 1")
    # Each scene that is left holds a corner, has one inside, or is cut.
    held, cut = F.sum((F.col("kind") == "held").cast("int")), F.max(F.col("kind") == "cut")
    met_by = odd.groupBy("geom_id", "date").agg(((held == total) & ~cut).alias("contains"))
    any_ = met_by.groupBy("date").agg(F.max("contains").alias("any"))
    return met_by.join(any_, "date").where("contains OR NOT any").select("geom_id", "date", "contains")

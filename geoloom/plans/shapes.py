"""Polygons, triangles, transforms and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.columns import complex_product, image_size
from geoloom.operators import fourier, geometry, raster
from geoloom.plans.tables import TRIANGLES_SQL, polygons, table, triangles

FREQUENCIES = fourier.frequencies(0.1, 4.0, 4)


def _grid(spark: SparkSession) -> DataFrame:
    return fourier.frequency_grid(spark, FREQUENCIES)


def triangle_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fan's triangles add up to the polygon's area."""
    return triangles(spark, sf_dir).groupBy("gid").agg(F.count("*").alias("n"), F.round(F.sum(geometry.triangle_area()), 8).alias("area"))


def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons(spark, sf_dir).select("gid", F.round(geometry.polygon_area(F.col("parts")), 8).alias("area"))


def polygon_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons(spark, sf_dir).select("gid", geometry.profile(F.col("parts")).alias("p"), geometry.is_risky(F.col("parts")).alias("risky")).select("gid", "p.*", "risky")


def polygon_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = polygons(spark, sf_dir).select("gid", geometry.row_meta(F.col("parts")).alias("m")).select("gid", "m.*")
    return m.select("gid", *[F.round(c, 8).alias(c) for c in ("cx", "cy", "l", "lx", "ly")], "n")


def normalised_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After normalising, the longer side is 2 and the centre 0."""
    m = geometry.normalised(polygons(spark, sf_dir)).select("gid", geometry.row_meta(F.col("parts")).alias("m")).select("gid", "m.*")
    return m.select("gid", *[F.abs(F.round(c, 6)).alias(c) for c in ("cx", "cy", "l")])


def clean_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings with each point doubled and the first repeated at the end come back clean."""
    ring = F.get(F.get("parts", F.lit(0)), F.lit(0))
    doubled = F.concat(F.flatten(F.transform(ring, lambda p: F.array(p, p))), F.array(F.get(ring, F.lit(0))))
    return polygons(spark, sf_dir).select("gid", F.size(doubled).alias("before"), F.size(geometry.clean_ring(doubled)).alias("after"))


def shortest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons(spark, sf_dir).select("gid", F.round(geometry.shortest_edge(F.get("parts", F.lit(0))), 8).alias("edge"))


def triangulated_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles cut from the polygons, holes and parts included, cover the same area."""
    made = geometry.triangulate(polygons(spark, sf_dir).select("gid", "parts"))
    return made.groupBy("gid").agg(F.round(F.sum(geometry.triangle_area()), 6).alias("area"), F.count("error").alias("errors"))


def degenerate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound triangles, collinear ones, and flat ones, by what is wrong with them."""
    t = triangles(spark, sf_dir)
    flat = t.withColumns({"cx": F.col("bx") * 0.5, "cy": F.col("by") * 0.5})
    low = t.withColumns({c: F.lit(v) for c, v in (("ax", 0.0), ("ay", 0.0), ("bx", 1.0), ("by", 0.0), ("cx", 0.5), ("cy", 4e-6))})
    return geometry.fault_counts(t.union(flat).union(low))


def quality_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = polygons(spark, sf_dir).select("gid", "parts")
    return geometry.quality_counters(shapes, geometry.triangulate(shapes)).drop("triangles")


def augmented_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas of all three copies of each polygon, the turned, scaled and moved ones included."""
    made = geometry.augmented(triangles(spark, sf_dir), 3)
    return made.groupBy("gid", "repeat").agg(F.count("*").alias("n"), F.round(F.sum(geometry.triangle_area()), 8).alias("area"))


def frequency_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each polygon: valid cells of the padded grid, their spans, and the energy over them."""
    g = fourier.frequency_grid(spark, FREQUENCIES, 4).where("valid")
    s = fourier.spectra(triangles(spark, sf_dir), g).join(F.broadcast(g), ["u_idx", "v_idx"])
    span = F.col("du") * F.col("dv")
    return s.groupBy("gid").agg(F.count("*").alias("cells"), F.round(F.sum(span), 6).alias("span"), F.round(F.sum(span * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))), 6).alias("energy"))


def polygon_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fourier.spectra(triangles(spark, sf_dir), _grid(spark))
    return s.select("gid", "u_idx", "v_idx", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


def spectrum_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log magnitudes, and back to the spectrum's energy."""
    image = fourier.channels(fourier.spectra(triangles(spark, sf_dir), _grid(spark)))
    back = fourier.from_image(image.withColumn("log", F.col("mag")))
    return back.groupBy("gid").agg(F.round(F.sum("log"), 5).alias("mag"), F.round(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 5).alias("energy"))


def spectrum_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of each spectrum's squares as complex numbers."""
    s = fourier.spectra(triangles(spark, sf_dir), _grid(spark)).select("gid", F.struct("re", "im").alias("z"))
    return s.select("gid", complex_product(F.col("z"), F.col("z")).alias("p")).groupBy("gid").agg(F.round(F.sum("p.re"), 5).alias("re"), F.round(F.sum("p.im"), 5).alias("im"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fourier.rasters(fourier.spectra(triangles(spark, sf_dir), _grid(spark)), _grid(spark), 8)
    return r.withColumn("value", F.round("value", 4))


def span_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each polygon's mean magnitude, with cells weighed by their spans."""
    g = _grid(spark)
    s = fourier.spectra(triangles(spark, sf_dir), g).join(F.broadcast(fourier.span_weights(g)), ["u_idx", "v_idx"])
    return s.groupBy("gid").agg(F.round(F.avg(F.col("weight") * F.hypot("re", "im")), 7).alias("mag"))


def _shifted(spark: SparkSession) -> DataFrame:
    """Points of a grid that lie off all edges."""
    return fourier.pixels(spark, 16).withColumns({"x": F.col("x") + 0.0131, "y": F.col("y") + 0.0077})


def occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a grid in each polygon; points on an edge are left to either side by keeping the grid off them."""
    return raster.occupied(triangles(spark, sf_dir), _shifted(spark)).groupBy("gid").agg(F.sum("occupied").alias("inside"), F.count("*").alias("points"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of events with a made-up prediction and a blurred input."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", (F.col("event_id") % 3 == 0).cast("int").alias("target"), (F.pmod(F.col("event_id") * 37, F.lit(101)) / 100).alias("pred"), (F.pmod(F.col("event_id") * 13, F.lit(97)) / 96).alias("blurred"))


def iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.iou(_pairs(spark, sf_dir), "user_id", "pred", "target").withColumn("iou", F.round("iou", 8))


def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = raster.image_metrics(_pairs(spark, sf_dir), "user_id", "blurred", "pred", "target")
    return m.select("user_id", F.round("mse_before", 8).alias("mse_before"), F.round("mse_after", 8).alias("mse_after"), "wrong", "doubtful")


def overlap_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = raster.overlap_losses(_pairs(spark, sf_dir), "user_id", "pred", "target")
    return m.select("user_id", F.round("dice_loss", 7).alias("dice_loss"), F.round("bce_loss", 7).alias("bce_loss"))


def masked_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _pairs(spark, sf_dir)
    cells = e.select(
        (F.col("user_id") % 2 == 0).alias("mask"), (F.col("pred") + 0.5).alias("weight"), F.col("pred").alias("pred_mag"), F.col("target").cast("double").alias("true_mag"),
        F.col("pred").alias("pred_cos"), F.col("blurred").alias("true_cos"), F.col("blurred").alias("pred_sin"), F.col("target").cast("double").alias("true_sin"),
    )
    m = raster.masked_losses(cells, 0.5)
    return m.select(F.round("mag_loss", 7).alias("mag_loss"), F.round("phase_loss", 7).alias("phase_loss"))


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons(spark, sf_dir).select("gid", image_size(geometry.row_meta(F.col("parts"))["l"] / 1000, F.lit(5.0)).alias("pixels"))


def sampled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 64 points drawn for each polygon, how many lie in it, in the box, and how many there are."""
    points = raster.sampled_points(triangles(spark, sf_dir), 48, 16)
    made = raster.labelled_points(points, triangles(spark, sf_dir))
    return made.groupBy("gid").agg(F.count("*").alias("points"), F.sum("occupied").alias("inside"), F.count_if((F.abs("x") <= 1) & (F.abs("y") <= 1)).alias("boxed"))


def resized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 16 by 16 at twice the size, then cut at one half."""
    small = raster.occupied(triangles(spark, sf_dir), _shifted(spark)).select("gid", "py", "px", F.col("occupied").cast("double").alias("value"))
    return raster.resized(small, 32).groupBy("gid").agg(F.round(F.sum("value"), 6).alias("total"), F.count_if(F.col("value") >= 0.5).alias("inside"))


QUERIES = {
    f.__name__: f
    for f in (
        triangle_areas, polygon_areas, polygon_profiles, polygon_meta, normalised_boxes, clean_rings, shortest_edges, triangulated_areas, degenerate_counts, quality_counters, augmented_copies,
        frequency_grid, polygon_spectra, spectrum_channels, spectrum_products, rasters, span_weights, occupancy, iou, image_metrics, overlap_losses, masked_losses, image_sizes, sampled_points, resized_images,
    )
}

_BASE = "poly AS (SELECT s_suppkey AS gid, 3 + s_suppkey % 6 AS k, 1 + s_nationkey / 10.0e0 AS r, CAST(s_suppkey % 17 AS DOUBLE) AS mx, CAST(s_suppkey % 13 AS DOUBLE) AS my FROM supplier)"
_REGULAR = "k * r * r * sin(2 * pi() / k) / 2"
_AREA = f"{_REGULAR} * (CASE WHEN gid % 4 = 0 THEN 0.75e0 ELSE 1 END + CASE WHEN gid % 7 = 0 THEN 1 ELSE 0 END)"
_POINTS = f"""{_BASE}, pts AS (
  SELECT gid, k, r, mx + r * cos(2 * pi() * t / k) + CASE p WHEN 1 THEN 3 * r ELSE 0 END AS x, my + r * sin(2 * pi() * t / k) AS y FROM poly, range(8) a(t), range(2) b(p) WHERE t < k AND (p = 0 OR gid % 7 = 0)
), box AS (SELECT gid, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY gid)"""
_W = [0.0, *FREQUENCIES]
_AXIS = [-w for w in reversed(FREQUENCIES)] + _W


def _spans(values: list[float]) -> list[float]:
    last = len(values) - 1
    return [values[1] - values[0] if i == 0 else values[i] - values[i - 1] if i == last else (values[i + 1] - values[i - 1]) / 2 for i in range(last + 1)]


def _axis_sql(name: str, values: list[float]) -> str:
    rows = ", ".join(f"({i}, CAST({w!r} AS DOUBLE), CAST({d!r} AS DOUBLE))" for i, (w, d) in enumerate(zip(values, _spans(values), strict=True)))
    return f"{name}s AS (SELECT * FROM (VALUES {rows}) t({name}_idx, {name}, d{name}))"


_GRID = f"{_axis_sql('u', _AXIS)}, {_axis_sql('v', _W)}"
#: The fan's triangles at each frequency: a, b, and the parts of the closed form.
_SPECTRUM = f"""{TRIANGLES_SQL}, {_GRID}, t0 AS (
  SELECT gid, u_idx, v_idx, u * x1 + v * y1 AS s, u * (x2 - x1) + v * (y2 - y1) AS a, u * (x3 - x2) + v * (y3 - y2) AS b, abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) AS twice FROM triangles, us, vs
), t1 AS (
  SELECT *, CASE WHEN abs(a) <= 1e-6 AND abs(b) <= 1e-6 THEN 0 WHEN abs(a + b) <= 1e-6 THEN 1 WHEN abs(a) <= 1e-6 THEN 2 WHEN abs(b) <= 1e-6 THEN 3 ELSE 4 END AS kind,
    cos(2 * pi() * a) AS ea, -sin(2 * pi() * a) AS fa, cos(2 * pi() * b) AS eb, -sin(2 * pi() * b) AS fb, cos(2 * pi() * (a + b)) AS ec, -sin(2 * pi() * (a + b)) AS fc, 4 * pi() * pi() AS q FROM t0
), t2 AS (
  SELECT *, CASE kind WHEN 1 THEN -(ea - 1) / (q * a * a) WHEN 2 THEN -(eb - 1) / (q * b * b) WHEN 3 THEN (ea - 2 * pi() * a * fa - 1) / (q * a * a) WHEN 4 THEN (-a * ec + (a + b) * ea - b) / (q * a * b * (a + b)) END AS g,
    CASE kind WHEN 1 THEN -(fa + 2 * pi() * a) / (q * a * a) WHEN 2 THEN -(fb + 2 * pi() * b) / (q * b * b) WHEN 3 THEN (fa + 2 * pi() * a * ea) / (q * a * a) WHEN 4 THEN (-a * fc + (a + b) * fa) / (q * a * b * (a + b)) END AS h FROM t1
), spectrum AS (
  SELECT gid, u_idx, v_idx, sum(CASE kind WHEN 0 THEN twice / 2 ELSE twice * (g * cos(2 * pi() * s) + h * sin(2 * pi() * s)) END) AS re, sum(CASE kind WHEN 0 THEN 0 ELSE twice * (h * cos(2 * pi() * s) - g * sin(2 * pi() * s)) END) AS im FROM t2 GROUP BY gid, u_idx, v_idx
)"""
_INSIDE = """NOT ((({x} - x2) * (y1 - y2) - (x1 - x2) * ({y} - y2) < 0 OR ({x} - x3) * (y2 - y3) - (x2 - x3) * ({y} - y3) < 0 OR ({x} - x1) * (y3 - y1) - (x3 - x1) * ({y} - y1) < 0)
  AND (({x} - x2) * (y1 - y2) - (x1 - x2) * ({y} - y2) > 0 OR ({x} - x3) * (y2 - y3) - (x2 - x3) * ({y} - y3) > 0 OR ({x} - x1) * (y3 - y1) - (x3 - x1) * ({y} - y1) > 0))"""
_PAIRS = "pairs AS (SELECT user_id, CAST(event_id % 3 = 0 AS INTEGER) AS target, event_id * 37 % 101 / 100.0e0 AS pred, event_id * 13 % 97 / 96.0e0 AS blurred FROM events)"

ORACLE_SQL = {
    "triangle_areas": f"WITH {TRIANGLES_SQL} SELECT gid, count(*) AS n, round(any_value(k * q * q * sin(2 * pi() / k) / 2), 8) AS area FROM triangles JOIN shapes USING (gid) GROUP BY gid",
    "polygon_areas": f"WITH {_BASE} SELECT gid, round({_AREA}, 8) AS area FROM poly",
    "polygon_profiles": f"""WITH {_BASE}, p AS (SELECT gid, 1 + CAST(gid % 7 = 0 AS INTEGER) AS parts, CAST(gid % 4 = 0 AS INTEGER) AS holes FROM poly)
        SELECT gid, parts, holes, holes AS most_holes, holes AS parts_with_holes, parts > 1 AS risky FROM p""",
    "polygon_meta": f"""WITH {_POINTS} SELECT gid, round((x0 + x1) / 2, 8) AS cx, round((y0 + y1) / 2, 8) AS cy, round(greatest(x1 - x0, y1 - y0), 8) AS l, round(x1 - x0, 8) AS lx, round(y1 - y0, 8) AS ly,
        k * (1 + CAST(gid % 4 = 0 AS INTEGER) + CAST(gid % 7 = 0 AS INTEGER)) AS n FROM box JOIN poly USING (gid)""",
    "normalised_boxes": f"WITH {_BASE} SELECT gid, 0.0e0 AS cx, 0.0e0 AS cy, 2.0e0 AS l FROM poly",
    "clean_rings": f"WITH {_BASE} SELECT gid, CAST(2 * k + 1 AS INTEGER) AS before, CAST(k AS INTEGER) AS after FROM poly",
    "shortest_edges": f"WITH {_BASE} SELECT gid, round(2 * r * sin(pi() / k) * CASE WHEN gid % 4 = 0 THEN 0.5e0 ELSE 1 END, 8) AS edge FROM poly",
    "triangulated_areas": f"WITH {_BASE} SELECT gid, round({_AREA}, 6) AS area, 0 AS errors FROM poly",
    "degenerate_counts": f"WITH {_BASE} SELECT gid, k AS kept, k AS small_area, k AS small_height FROM poly",
    "quality_counters": f"""WITH {_BASE} SELECT count(*) AS rows, CAST(sum(1 + CAST(gid % 7 = 0 AS INTEGER)) AS BIGINT) AS parts, count(*) FILTER (WHERE gid % 4 = 0) AS holes, CAST(max(CAST(gid % 4 = 0 AS INTEGER)) AS INTEGER) AS most_holes,
        count(*) FILTER (WHERE gid % 4 = 0) AS parts_with_holes, count(*) FILTER (WHERE gid % 7 = 0) AS risky_rows, 0 AS failed_rows, 0 AS small_area, 0 AS small_height FROM poly""",
    "polygon_spectra": f"WITH {_SPECTRUM} SELECT gid, u_idx, v_idx, round(re, 6) AS re, round(im, 6) AS im FROM spectrum",
    "spectrum_channels": f"WITH {_SPECTRUM} SELECT gid, round(sum(ln(1 + sqrt(re * re + im * im))), 5) AS mag, round(sum(re * re + im * im), 5) AS energy FROM spectrum GROUP BY gid",
    "spectrum_products": f"WITH {_SPECTRUM} SELECT gid, round(sum(re * re - im * im), 5) AS re, round(sum(2 * re * im), 5) AS im FROM spectrum GROUP BY gid",
    "rasters": f"""WITH {_SPECTRUM}, px AS (SELECT a AS py, b AS px, -1 + 2.0e0 * b / 7 AS x, 1 - 2.0e0 * a / 7 AS y FROM range(8) i(a), range(8) j(b)
        ), f AS (SELECT gid, py, px, sum(du * dv * CASE WHEN v > 1e-6 THEN 2 ELSE 1 END * (re * cos(2 * pi() * (u * x + v * y)) - im * sin(2 * pi() * (u * x + v * y)))) AS f FROM spectrum JOIN us USING (u_idx) JOIN vs USING (v_idx), px GROUP BY gid, py, px)
        SELECT gid, py, px, round((f - min(f) OVER (PARTITION BY gid)) / (max(f) OVER (PARTITION BY gid) - min(f) OVER (PARTITION BY gid) + 1e-8), 4) AS value FROM f""",
    "occupancy": f"""WITH {TRIANGLES_SQL}, px AS (SELECT i, -1 + 2.0e0 * (i % 16) / 15 + 0.0131e0 AS x, 1 - 2.0e0 * (i // 16) / 15 + 0.0077e0 AS y FROM range(256) r(i)
        ), hit AS (SELECT gid, i, max(CAST({_INSIDE.format(x="x", y="y")} AS INTEGER)) AS o FROM triangles, px GROUP BY gid, i) SELECT gid, CAST(sum(o) AS BIGINT) AS inside, count(*) AS points FROM hit GROUP BY gid""",
    "iou": f"""WITH {_PAIRS}, b AS (SELECT user_id, CAST(pred > 0.5 AS INTEGER) AS p, target AS t FROM pairs)
        SELECT user_id, round((sum(p * t) + 1e-6) / (sum(p) + sum(t) - sum(p * t) + 1e-6), 8) AS iou FROM b GROUP BY user_id""",
    "image_metrics": f"""WITH {_PAIRS} SELECT user_id, round(avg((blurred - target) * (blurred - target)), 8) AS mse_before, round(avg((pred - target) * (pred - target)), 8) AS mse_after,
        count(*) FILTER (WHERE (pred > 0.5) != (target > 0.5)) AS wrong, count(*) FILTER (WHERE pred > 0.1 AND pred < 0.9) AS doubtful FROM pairs GROUP BY user_id""",
    "overlap_losses": f"""WITH {_PAIRS}, c AS (SELECT user_id, greatest(1e-7, least(1 - 1e-7, pred)) AS p, target AS t FROM pairs)
        SELECT user_id, round(1 - (2 * sum(p * t) + 1e-6) / (sum(p) + sum(t) + 1e-6), 7) AS dice_loss, round(avg(-(t * ln(p) + (1 - t) * ln(1 - p))), 7) AS bce_loss FROM c GROUP BY user_id""",
    "masked_losses": f"""WITH {_PAIRS}, c AS (SELECT CAST(user_id % 2 = 0 AS INTEGER) AS m, pred + 0.5e0 AS w, abs(pred - target) AS d, abs(pred - blurred) + abs(blurred - target) AS e FROM pairs)
        SELECT round(sum(d * m) / greatest(sum(m), 1) + 0.5e0 * sum(d * w * m) / greatest(sum(m), 1), 7) AS mag_loss, round(sum(e * m) / greatest(sum(m), 1), 7) AS phase_loss FROM c""",
    "image_sizes": f"WITH {_POINTS} SELECT gid, CAST(ceil(greatest(x1 - x0, y1 - y0) / 1000 * 118000 / 5) AS INTEGER) AS pixels FROM box",
    "frequency_grid": f"""WITH {_SPECTRUM} SELECT gid, count(*) AS cells, round(sum(du * dv), 6) AS span, round(sum(du * dv * (re * re + im * im)), 6) AS energy FROM spectrum JOIN us USING (u_idx) JOIN vs USING (v_idx) GROUP BY gid""",
    "span_weights": f"""WITH {_SPECTRUM}, w AS (SELECT u_idx, v_idx, sqrt(du * dv) / (avg(sqrt(du * dv)) OVER () + 1e-8) AS weight FROM us, vs)
        SELECT gid, round(avg(weight * sqrt(re * re + im * im)), 7) AS mag FROM spectrum JOIN w USING (u_idx, v_idx) GROUP BY gid""",
    "resized_images": f"""WITH {TRIANGLES_SQL}, px AS (SELECT i, -1 + 2.0e0 * (i % 16) / 15 + 0.0131e0 AS x, 1 - 2.0e0 * (i // 16) / 15 + 0.0077e0 AS y FROM range(256) r(i)
        ), hit AS (SELECT gid, i // 16 AS py, i % 16 AS px, max(CAST({_INSIDE.format(x="x", y="y")} AS INTEGER)) AS o FROM triangles, px GROUP BY gid, i
        ), at_ AS (SELECT p, CAST(floor(f) AS INTEGER) AS low, least(CAST(floor(f) AS INTEGER) + 1, 15) AS high, f - floor(f) AS part FROM (SELECT p, greatest(0, least((p + 0.5e0) * 16 / 32 - 0.5e0, 15)) AS f FROM range(32) r(p))
        ), tap AS (SELECT p, low AS q, 1 - part AS w FROM at_ UNION ALL SELECT p, high, part FROM at_
        ), big AS (SELECT gid, y.p AS py, x.p AS px, sum(y.w * x.w * o) AS value FROM hit JOIN tap y ON y.q = hit.py JOIN tap x ON x.q = hit.px GROUP BY gid, y.p, x.p)
        SELECT gid, round(sum(value), 6) AS total, count(*) FILTER (WHERE value >= 0.5) AS inside FROM big GROUP BY gid""",
}

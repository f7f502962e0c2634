"""Queries of the frame-series operators: embeddings as 8x8 frames of ten videos."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.operators import frames as B
from chalkline.plans import adapters as A
from chalkline.plans.catalog import query

H = W = 8
FRAMES = "(SELECT label AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)"
GRAD = f"""f AS (SELECT video, i, p, p % 8 AS c, p // 8 AS r, x, lead(x) OVER h AS right1, lag(x) OVER h AS left1, lead(x) OVER v AS down, lag(x) OVER v AS up FROM {FRAMES}
  WINDOW h AS (PARTITION BY video, i, p // 8 ORDER BY p), v AS (PARTITION BY video, i, p % 8 ORDER BY p)),
g AS (SELECT video, i, p, sqrt(pow(CASE WHEN c = 0 THEN right1 - x WHEN c = 7 THEN x - left1 ELSE (right1 - left1) / 2 END, 2) + pow(CASE WHEN r = 0 THEN down - x WHEN r = 7 THEN x - up ELSE (down - up) / 2 END, 2)) AS mag FROM f)"""
THRESHOLD = "n AS (SELECT video, max(i) + 1 AS n FROM g GROUP BY 1), k AS (SELECT DISTINCT video, floor(j * (n - 1) / (least(n, 60) - 1))::BIGINT AS i FROM n, range(60) t(j) WHERE j < least(n, 60)), h AS (SELECT video, greatest(quantile_cont(mag, 0.985), 0.01) AS threshold FROM g SEMI JOIN k USING (video, i) GROUP BY video)"
MASKS = "m AS (SELECT video, i, p, mag > threshold AS ink FROM g JOIN h USING (video))"


def _contrast(spark, sf):
    return B.local_contrast(A.frames(spark, sf), H, W)


def _masks(spark, sf):
    c = _contrast(spark, sf)
    return B.ink_masks(c, B.ink_threshold(c, floor=0.01))


@query("rolling_median", f"SELECT video, i::INTEGER AS i, p::INTEGER AS p, round(median(x) OVER (PARTITION BY video, p ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 9) AS v FROM {FRAMES}")
def rolling_median(spark, sf):
    return B.rolling_median(A.frames(spark, sf)).withColumn("v", F.round("v", 9))


@query("local_contrast", f"WITH {GRAD} SELECT video, i::INTEGER AS i, round(sum(mag), 6) AS total, round(max(mag), 6) AS top FROM g GROUP BY video, i")
def local_contrast(spark, sf):
    c = _contrast(spark, sf)
    return c.select("video", "i", F.round(F.aggregate("mag", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("mag"), 6).alias("top"))


@query("ink_threshold", f"WITH {GRAD}, {THRESHOLD} SELECT video, round(threshold, 6) AS threshold FROM h")
def ink_threshold(spark, sf):
    return B.ink_threshold(_contrast(spark, sf), floor=0.01).withColumn("threshold", F.round("threshold", 6))


@query("ink_density", f"WITH {GRAD}, {THRESHOLD}, {MASKS} SELECT video, i::INTEGER AS i, avg(ink::INTEGER) AS density, avg(ink::INTEGER) < 0.002 AS blank FROM m GROUP BY video, i")
def ink_density(spark, sf):
    return _masks(spark, sf).select("video", "i", "density", "blank")


@query("containment", f"""WITH {GRAD}, {THRESHOLD}, {MASKS}, c AS (SELECT a.video, a.i, sum(a.ink::INTEGER) AS whole, sum((a.ink AND b.ink)::INTEGER) AS kept FROM m a JOIN m b ON a.video = b.video AND a.p = b.p AND b.i = a.i + 1 GROUP BY 1, 2)
SELECT video, i::INTEGER AS i, CASE WHEN whole > 0 THEN kept / whole ELSE 0 END::DOUBLE AS score FROM c""")
def containment(spark, sf):
    return B.neighbour_containment(_masks(spark, sf))


@query("fullest_moment", f"WITH {GRAD}, {THRESHOLD}, {MASKS}, d AS (SELECT video, i, avg(ink::INTEGER) AS density FROM m GROUP BY video, i) SELECT video, i::DOUBLE AS best_at, density AS ink FROM d QUALIFY row_number() OVER (PARTITION BY video ORDER BY density DESC, i) = 1")
def fullest_moment(spark, sf):
    return B.fullest_moment(_masks(spark, sf))


@query("camera_motion")
def camera_motion(spark, sf):
    return B.camera_motion(_masks(spark, sf), H, W)


@query("segment_boards")
def segment_boards(spark, sf):
    return B.segment_boards(_masks(spark, sf), H, W).drop("mask")


@query("merge_zoomed")
def merge_zoomed(spark, sf):
    m = _masks(spark, sf)
    return B.merge_zoomed(B.segment_boards(m, H, W), B.camera_motion(m, H, W), H, W).drop("mask")


BOARD = "(props::JSON->>'$.k')::INTEGER"


@query("segmentation_summary", f"""WITH i AS (SELECT user_id AS video, {BOARD} AS board, event_id * 1.0::DOUBLE AS lo, event_id + 5.0::DOUBLE AS hi FROM events),
b AS (SELECT *, CASE WHEN lo - max(hi) OVER w > 6 OR max(hi) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM i WINDOW w AS (PARTITION BY video, board ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY video, board ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM b), s AS (SELECT video, board, island, max(hi) - min(lo) AS seconds FROM g GROUP BY ALL),
e AS (SELECT video, board, sum(seconds) AS seconds, count(*) - 1 AS revisits FROM s GROUP BY ALL)
SELECT video, count(*) AS boards_found, count(*) FILTER (WHERE seconds >= 20) AS boards_kept, sum(CASE WHEN seconds >= 20 THEN revisits ELSE 0 END)::BIGINT AS revisits FROM e GROUP BY video""")
def segmentation_summary(spark, sf):
    lo = F.col("event_id").cast("double")
    b = A.table(spark, sf, "events").select(F.col("user_id").alias("video"), F.get_json_object("props", "$.k").cast("int").alias("board"), lo.alias("lo"), (lo + 5).alias("hi"))
    return B.segmentation_summary(b)

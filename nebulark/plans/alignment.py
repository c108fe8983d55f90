"""Registered queries of alignment and stacking, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.operators import align
from nebulark.plans import views
from nebulark.plans.geometry import CUBIC
from nebulark.plans.queries import clip_sql, query, rounded
from nebulark.plans.views import SQL, using


@query("""WITH RECURSIVE v AS (SELECT l_suppkey % 40 AS a, l_partkey % 40 AS b, count(*) AS votes FROM lineitem GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY votes DESC, a, b) AS i FROM v),
g(i, k) AS (SELECT 0, CAST([] AS STRUCT(a BIGINT, b BIGINT, votes BIGINT)[]) UNION ALL
SELECT o.i, CASE WHEN len(list_filter(k, lambda z: z.a = o.a OR z.b = o.b)) > 0 THEN k ELSE list_append(k, {'a': o.a, 'b': o.b, 'votes': o.votes}) END FROM g JOIN o ON o.i = g.i + 1)
SELECT z.a, z.b, z.votes FROM (SELECT unnest(k) AS z FROM (SELECT arg_max(k, i) AS k FROM g))""")
def greedy_assignment(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 40).alias("a"), (F.col("l_partkey") % 40).alias("b"))
    return align.assigned(rows.groupBy("a", "b").agg(F.count("*").alias("votes")))


@query(f"""{using('stars')}, t AS (SELECT * FROM stars ORDER BY flux DESC, star_id LIMIT 60), e AS (SELECT a.star_id AS p, b.star_id AS q, c.star_id AS r, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS pq, sqrt(pow(b.x - c.x, 2) + pow(b.y - c.y, 2)) AS qr, sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2)) AS pr FROM t a JOIN t b ON a.star_id < b.star_id JOIN t c ON b.star_id < c.star_id),
s AS (SELECT list_sort([{{'d': pq, 'v': r}}, {{'d': qr, 'v': p}}, {{'d': pr, 'v': q}}]) AS s FROM e) SELECT s[1].v AS a, s[2].v AS b, s[3].v AS c, round(s[1].d / s[3].d, 6) AS r1, round(s[2].d / s[3].d, 6) AS r2 FROM s WHERE s[1].d >= 15""")
def ordered_triangles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(align.ordered_triangles(views.stars(spark, sf)), "r1", "r2")


WARP = {"frame": 0, "a": 0.98, "b": 0.02, "tx": 1.5, "c": -0.02, "d": 1.01, "ty": 2.25}


@query(f"""{using('img')}, n AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM img), p AS (SELECT y, x, h, w, 0.98 * x + 0.02 * y + 1.5 AS sx, -0.02 * x + 1.01 * y + 2.25 AS sy FROM img, n),
q AS (SELECT y, x, greatest(0, least(h - 1, floor(sy) + i)) AS iy, greatest(0, least(w - 1, floor(sx) + j)) AS ix, (SELECT {CUBIC} FROM (SELECT abs(sy - floor(sy) - i) AS t)) * (SELECT {CUBIC} FROM (SELECT abs(sx - floor(sx) - j) AS t)) AS k
FROM p, (SELECT unnest([-1, 0, 1, 2]) AS i), (SELECT unnest([-1, 0, 1, 2]) AS j) WHERE sx >= 0 AND sx <= w - 1 AND sy >= 0 AND sy <= h - 1),
s AS (SELECT q.y, q.x, sum(k * v) AS v FROM q JOIN img ON img.y = iy AND img.x = ix GROUP BY q.y, q.x) SELECT y, x, round(coalesce(s.v, 0), 6) + 0.0 AS v FROM img LEFT JOIN s USING (y, x)""")
def affine_warp(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(align.warped(views.img(spark, sf).select(F.lit(0).alias("frame"), "y", "x", "v"), spark.createDataFrame([WARP])).drop("frame"), "v")


@query(f"WITH {SQL['cube']}, m AS (SELECT min(h) AS h FROM (SELECT max(y) + 1 AS h FROM cube GROUP BY z)), stack AS (SELECT y * 1000 + x AS pixel, v FROM cube, m WHERE y < h), {clip_sql(1.5, 1.5, 5)}")
def stack_images(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.cube(spark, sf).select(F.col("z").alias("frame"), "y", "x", "v")
    out = align.stacked(rows, 0, 1.5, 1.5, 5, align=False)
    return rounded(out.select((F.col("y") * 1000 + F.col("x")).alias("pixel"), "result", "rejected", "n"), "result")


@query(f"{using('img')}, l AS (SELECT list_sort(list(v)) AS l FROM img), e AS (SELECT l[least(CAST(floor(len(l) * 0.01) AS BIGINT), len(l) - 1) + 1] AS p1, l[least(CAST(floor(len(l) * 0.999) AS BIGINT), len(l) - 1) + 1] AS p2 FROM l) SELECT y, x, round(least(greatest((v - p1) / (p2 - p1), 0), 1), 6) + 0.0 AS v FROM img, e")
def detection_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(align.for_detection(views.img(spark, sf), []), "v")

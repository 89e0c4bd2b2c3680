"""Queries over runs of pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import histograms, raster, rects
from foliant.plans.registry import query, table
from foliant.plans.linear_queries import B, bench, lined
from foliant.plans.pages import glyphs_by_projection
from foliant.sources import glyphs as src

RUNS = f"{B}, rn AS (SELECT page_id, y + unnest(range(height)) AS y, x AS x0, x + width - 1 AS x1 FROM g)"
PIXELS = f"{RUNS}, px AS (SELECT DISTINCT page_id, y, x0 + unnest(range(x1 - x0 + 1)) AS x FROM rn)"
ISLANDS = "i0 AS (SELECT page_id, y, x, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS i FROM {0}), isl AS (SELECT page_id, y, min(x) AS x0, max(x) AS x1 FROM i0 GROUP BY page_id, y, i)"


def runs(spark, d):
    return src.runs_of(bench(spark, d))


@query("r1_otsu", "page_id:l threshold:l", """WITH c AS (SELECT doc_id AS page_id, unicode(ch) % 256 AS v FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''), h AS (SELECT page_id, v, count(*) AS cnt FROM c GROUP BY ALL),
  s AS (SELECT page_id, v, sum(cnt) OVER w AS w, sum(v * cnt) OVER w AS s, sum(cnt) OVER (PARTITION BY page_id) AS n, sum(v * cnt) OVER (PARTITION BY page_id) AS t FROM h WINDOW w AS (PARTITION BY page_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT page_id, v, CASE WHEN w = n THEN 0 ELSE CAST(t * w - s * n AS DOUBLE) * CAST(t * w - s * n AS DOUBLE) / (CAST(w AS DOUBLE) * CAST(n - w AS DOUBLE)) END AS between_ FROM s)
  SELECT page_id, v AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY between_ DESC, v) = 1""")
def _(spark, d):
    chars = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return histograms.otsu(chars.groupBy("page_id", (F.ascii("ch") % 256).alias("v")).agg(F.count("*").alias("cnt")))


@query("r2_ccl", "page_id:l comp_id:l x:l y:l width:l height:l area:l", f"WITH {B} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y, x) AS comp_id, x, y, width, height, width * height AS area FROM g")
def _(spark, d):
    return raster.components(raster.merged(runs(spark, d)))


@query("r3_row_profile", "page_id:l y:l v:l", f"WITH {RUNS} SELECT page_id, y, sum(x1 - x0 + 1) AS v FROM rn GROUP BY ALL")
def _(spark, d):
    return raster.row_profile(runs(spark, d))


@query("r3_column_profile", "page_id:l x:l v:l", f"WITH {PIXELS} SELECT page_id, x, count(*) AS v FROM px GROUP BY ALL")
def _(spark, d):
    return raster.column_profile(runs(spark, d))


ROWS = "i AS (SELECT page_id, y, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS k FROM (SELECT DISTINCT page_id, y FROM rn)), o AS (SELECT page_id, min(y) AS first, max(y) AS last, row_number() OVER (PARTITION BY page_id ORDER BY min(y)) - 1 AS run FROM i GROUP BY page_id, k)"


@query("r4_one_runs", "page_id:l run:l first:l last:l", f"WITH {RUNS}, {ROWS} SELECT * FROM o")
def _(spark, d):
    return raster.one_runs(raster.row_profile(runs(spark, d)), ["page_id"], "y")


@query("r5_zero_runs", "page_id:l run:l first:l last:l", f"WITH {RUNS}, {ROWS}, z AS (SELECT page_id, last + 1 AS first, lead(first) OVER (PARTITION BY page_id ORDER BY first) - 1 AS last FROM o) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS run, first, last FROM z WHERE last IS NOT NULL")
def _(spark, d):
    return raster.zero_runs(raster.row_profile(runs(spark, d)), ["page_id"], "y")


@query("r6_widest", "page_id:l widest:l", f"WITH {RUNS}, {ROWS} SELECT page_id, run AS widest FROM o QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY last - first DESC, run) = 1")
def _(spark, d):
    profile = raster.row_profile(runs(spark, d))
    return raster.widest(raster.one_runs(profile, ["page_id"], "y"), ["page_id"], profile)


@query("r7_trim", "page_id:l x:l y:l width:l height:l", f"WITH {B} SELECT page_id, min(x) AS x, min(y) AS y, max(x + width - 1) - min(x) AS width, max(y + height - 1) - min(y) AS height FROM g GROUP BY page_id")
def _(spark, d):
    return raster.trim(runs(spark, d))


@query("r8_mask", "page_id:l y:l x0:l x1:l", f"WITH {PIXELS}, mk AS (SELECT page_id, x - 3 AS x, y + 2 AS y, width + 9 AS width, height - 4 AS height FROM g WHERE glyph_id % 7 = 0), ma AS (SELECT DISTINCT page_id, y + a AS y, x + b AS x FROM mk, range(40) ra(a), range(40) rb(b) WHERE a < height AND b < width), left_ AS (SELECT * FROM px ANTI JOIN ma USING (page_id, y, x)), {ISLANDS.format('left_')} SELECT * FROM isl")
def _(spark, d):
    g = bench(spark, d)
    masks = g.where("glyph_id % 7 = 0").select("page_id", (F.col("x") - 3).alias("x"), (F.col("y") + 2).alias("y"), (F.col("width") + 9).alias("width"), (F.col("height") - 4).alias("height"))
    return raster.mask(src.runs_of(g), masks)


@query("r9_dilate", "page_id:l y:l x0:l x1:l", f"WITH {PIXELS}, di AS (SELECT DISTINCT page_id, y + a AS y, x + b AS x FROM px, (VALUES (0), (1)) ra(a), range(-4, 5) rb(b)), {ISLANDS.format('di')} SELECT * FROM isl")
def _(spark, d):
    return raster.dilate(runs(spark, d), 4, 4, 0, 1)


@query("r9_erode", "page_id:l y:l x0:l x1:l", f"WITH {PIXELS}, er AS (SELECT page_id, y + a AS y, x + b AS x FROM px, (VALUES (0), (1)) ra(a), (VALUES (0), (1)) rb(b) GROUP BY ALL HAVING count(*) = 4), {ISLANDS.format('er')} SELECT * FROM isl")
def _(spark, d):
    return raster.erode(runs(spark, d), 1, 0, 1, 0)


@query("r9_close", "page_id:l y:l x0:l x1:l", f"WITH {PIXELS}, di AS (SELECT DISTINCT page_id, y + a AS y, x + b AS x FROM px, range(-1, 2) ra(a), range(-1, 2) rb(b)), er AS (SELECT page_id, y + a AS y, x + b AS x FROM di, range(-1, 2) ra(a), range(-1, 2) rb(b) GROUP BY ALL HAVING count(*) = 9), {ISLANDS.format('er')} SELECT * FROM isl")
def _(spark, d):
    return raster.close(runs(spark, d))


@query("r10_outer_boundaries", "page_id:l comp:l area:l filled:l", f"WITH {B} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y, x) AS comp, width * height AS area, width * height AS filled FROM g")
def _(spark, d):
    return raster.outer_boundaries(runs(spark, d))


@query("r13_fill_ratio", "page_id:l glyph_id:l ratio:d", f"WITH {PIXELS}, bg AS (SELECT page_id, glyph_id, x - 2 AS x, y - 2 AS y, width + 10 AS width, height + 4 AS height FROM g) SELECT bg.page_id, glyph_id, count(px.x) / CAST(any_value(width * height) AS DOUBLE) AS ratio FROM bg LEFT JOIN px ON px.page_id = bg.page_id AND px.y BETWEEN bg.y AND bg.y + bg.height - 1 AND px.x BETWEEN bg.x AND bg.x + bg.width - 1 GROUP BY ALL")
def _(spark, d):
    g = bench(spark, d)
    grown = g.select("page_id", "glyph_id", (F.col("x") - 2).alias("x"), (F.col("y") - 2).alias("y"), (F.col("width") + 10).alias("width"), (F.col("height") + 4).alias("height"))
    return raster.fill_ratio(src.runs_of(g), grown, "glyph_id")


@query("l12_get_glyphs", "page_id:l line_id:l pos:l x:l y:l width:l height:l indented:b is_last:b is_space:b")
def _(spark, d):
    g = lined(bench(spark, d))
    limits = g.groupBy("page_id", "line_id").agg(F.min("y").alias("upper"), F.max(F.col("y") + F.col("height")).alias("lower"))
    widths = rects.bounding(g, ["page_id"]).select("page_id", (F.col("x") + F.col("width")).alias("page_width"))
    return glyphs_by_projection(src.runs_of(g), limits, widths)

"""New layouts, and pages as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import layout, lines, rects
from foliant.plans import pages
from foliant.plans.registry import query, table
from foliant.plans.linear_queries import WORDS, B, bench, lined, pictured
from foliant.plans.pair_queries import _components
from foliant.sources import glyphs as src


def _ordered(spark, d):
    """Ordered glyphs with the lines as they were put."""
    g = lines.split_words(lined(src.indented(bench(spark, d))))
    return g.select("page_id", "line_id", "word_id", "pos", *rects.SIDES, (24 * F.col("line_id") + 16 - (F.col("y") + F.col("height"))).alias("shift"))


def _widths(g):
    return g.groupBy("page_id").agg(F.max(F.col("x") + F.col("width")).alias("page_width"))


def _pictures(g):
    n = g.groupBy("page_id").agg(F.max(F.col("y") + F.col("height")).alias("bottom"))
    return n.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("picture"), "bottom").select("page_id", "picture", F.lit(0).alias("x"), F.floor(F.col("bottom") * F.col("picture") / 3).cast("int").alias("y"), (400 + 300 * F.col("picture")).alias("width"), F.lit(120).alias("height"))


ENTRIES = f"""{WORDS.replace("12 * col_no AS x", "12 * col_no + CASE WHEN line_no % 5 = 0 THEN 36 ELSE 0 END AS x")},
  av AS (SELECT page_id, avg(height) AS mean, avg(width * CAST(1.5 AS DOUBLE)) AS av FROM g GROUP BY page_id), ls AS (SELECT page_id, line_id, min(x) AS left_x FROM words GROUP BY ALL),
  pn AS (SELECT ls.*, mean, lag(left_x) OVER w AS a, lead(left_x) OVER w AS b FROM ls JOIN av USING (page_id) WINDOW w AS (PARTITION BY page_id ORDER BY line_id)),
  pp AS (SELECT page_id, line_id, greatest(0, sum(CASE WHEN a IS NULL OR (left_x - a > mean AND coalesce(left_x - b > mean, true)) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_id ROWS UNBOUNDED PRECEDING) - 1) AS paragraph FROM pn),
  sc AS (SELECT page_id, line_id, word_id, trunc(x * CAST(1.5 AS DOUBLE)) AS x, trunc(width * CAST(1.5 AS DOUBLE)) AS w FROM words),
  wb AS (SELECT page_id, line_id, word_id, min(x) AS x, max(x + w) - min(x) AS width FROM sc GROUP BY ALL),
  wn AS (SELECT page_id, line_id, word_id, width, coalesce(lead(x) OVER (PARTITION BY page_id, line_id ORDER BY word_id) - (x + width), trunc(av)) AS gap FROM wb JOIN av USING (page_id)),
  en AS (SELECT wn.page_id, paragraph, wn.line_id, word_id, width, gap FROM wn JOIN pp USING (page_id, line_id) UNION ALL SELECT pp.page_id, paragraph, line_id, 1073741824, 0, trunc(av) FROM pp JOIN av USING (page_id)
    UNION ALL SELECT page_id, paragraph, min(line_id), -1, 0, trunc(any_value(av) * 2) FROM pp JOIN av USING (page_id) GROUP BY page_id, paragraph)"""


@query("l2_transform_paragraph", "page_id:l paragraph:l seq:l width:l gap:l", f"WITH {ENTRIES} SELECT page_id, paragraph, row_number() OVER (PARTITION BY page_id, paragraph ORDER BY line_id, word_id) - 1 AS seq, width, gap FROM en")
def _(spark, d):
    return layout.entries(_ordered(spark, d), 1.5)


BROKEN = """oe AS (SELECT *, row_number() OVER (PARTITION BY page_id, paragraph ORDER BY line_id, word_id) - 1 AS seq FROM en),
  br AS (SELECT page_id, paragraph, seq, width, gap, CAST(0 AS BIGINT) AS line, width + gap AS used FROM oe WHERE seq = 0
    UNION ALL SELECT oe.page_id, oe.paragraph, oe.seq, oe.width, oe.gap, br.line + CASE WHEN br.used + oe.width > 1500 THEN 1 ELSE 0 END, CASE WHEN br.used + oe.width > 1500 THEN oe.width + oe.gap ELSE br.used + oe.width + oe.gap END FROM br JOIN oe ON oe.page_id = br.page_id AND oe.paragraph = br.paragraph AND oe.seq = br.seq + 1)"""


@query("l3_split_paragraph", "page_id:l paragraph:l line:l seq:l width:l gap:l", f"WITH RECURSIVE {ENTRIES}, {BROKEN} SELECT * FROM br")
def _(spark, d):
    e = layout.entries(_ordered(spark, d), 1.5)
    return layout.break_paragraphs(e, e.select("page_id").distinct().withColumn("new_width", F.lit(1500)))


@query("l3_narrow_lines", "page_id:l paragraph:l line:l seq:l width:l height:l gap:l")
def _(spark, d):
    """Narrow enough for words to be cut between glyphs."""
    e = layout.entries(_ordered(spark, d), 1.5)
    return layout.break_paragraphs(e, e.select("page_id").distinct().withColumn("new_width", F.lit(90)))


@query("l4_page_geometry", "page_id:l margin:l page_width:l page_height:l")
def _(spark, d):
    g = _ordered(spark, d)
    return layout.placements(g, _pictures(g), _widths(g), factor=1.5, zoom=2)[2]


@query("l5_placements", "page_id:l row:l seq:l x:l y:l width:l height:l left:l top:l")
def _(spark, d):
    g = _ordered(spark, d)
    return layout.placements(g, _pictures(g), _widths(g), factor=1.5, zoom=2)[0]


@query("l6_picture_scale", "page_id:l picture:l s_width:l s_height:l", f"""WITH {B.replace("12 * col_no AS x", "12 * col_no + CASE WHEN line_no % 5 = 0 THEN 36 ELSE 0 END AS x")}, p AS (SELECT page_id, CAST(trunc(max(x + width) * CAST(1.5 AS DOUBLE)) AS BIGINT) AS nw FROM g GROUP BY page_id), s AS (SELECT page_id, i AS picture, 2 * (400 + 300 * i) AS w, 240 AS h, nw FROM p, range(3) r(i))
  SELECT page_id, picture, CASE WHEN w >= nw THEN trunc(w / (w / CAST(nw AS DOUBLE))) ELSE w END AS s_width, CASE WHEN w >= nw THEN trunc(h / (w / CAST(nw AS DOUBLE))) ELSE h END AS s_height FROM s""")
def _(spark, d):
    g = _ordered(spark, d)
    width = _widths(g).select("page_id", (F.col("page_width") * F.lit(1.5)).cast("int").alias("new_width"))
    return layout.scaled_pictures(_pictures(g), width, 2)


@query("j19_picture_cursor", "page_id:l picture:l left:l top:l s_width:l s_height:l")
def _(spark, d):
    g = _ordered(spark, d)
    return layout.placements(g, _pictures(g), _widths(g), factor=1.5, zoom=2)[1]


@query("l7_get_reflowed", "page_id:l row:l seq:l x:l y:l width:l height:l left:l top:l")
def _(spark, d):
    g = pictured(spark, d)
    return pages.reflow(_components(g), _widths(g), factor=1.5, zoom=2)[0]


@query("l8_simple_flow", "page_id:l seq:l line:l left:l")
def _(spark, d):
    g = bench(spark, d).select("page_id", F.col("glyph_id").alias("seq"), "width", ((F.col("line_no") % 5 == 0) & (F.col("col_no") == 0)).alias("indented"))
    return layout.simple_flow(g, 400)


@query("l10_xycut", "page_id:l node_id:l parent_id:l side:s x:l y:l w:l h:l leaf:b")
def _(spark, d):
    """Two columns, and space after every fifth line."""
    return layout.cut_trees(src.runs_of(src.spaced(bench(spark, d))))


@query("stream_words", "page_id:l line_id:l word_id:l x:l y:l width:l height:l", f"WITH {WORDS} SELECT page_id, line_id, word_id, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM words GROUP BY page_id, line_id, word_id")
def _(spark, d):
    from foliant.streaming.pages import page_stream, words_of_stream

    return words_of_stream(page_stream(spark, d, "benchmark.parquet", table(spark, d, "benchmark").schema), "item_id")

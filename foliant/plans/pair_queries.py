"""Queries over pairs of boxes of a page or line, on whole pages of the benchmark's texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import captions, intervals, lines, rects, text_pages
from foliant.plans import pages
from foliant.plans.registry import query, table
from foliant.plans.linear_queries import BOX, FRAMED, HIST, PICS, WORDS, B, D, T, bench, doc_pages, framed, lined, pictured
from foliant.sources import glyphs as src

#: The components of edges e (k, a, b), given both ways, over vertices v (k, id).
COMPONENTS = "cl AS (SELECT k, id AS a, id AS b FROM v UNION SELECT cl.k, cl.a, e.b FROM cl JOIN e ON e.k = cl.k AND e.a = cl.b), comp AS (SELECT k, a AS id, min(b) AS component FROM cl GROUP BY k, a)"
MEET = "e AS (SELECT p.page_id AS k, p.glyph_id AS a, q.glyph_id AS b FROM g p JOIN g q ON p.page_id = q.page_id AND p.glyph_id <> q.glyph_id AND p.x <= q.x + q.width AND q.x <= p.x + p.width AND p.y <= q.y + q.height AND q.y <= p.y + p.height), v AS (SELECT page_id AS k, glyph_id AS id FROM g)"
JOINED = f"""{T}, {MEET}, {COMPONENTS}, jb AS (SELECT k AS page_id, component AS root, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM comp JOIN g ON g.page_id = k AND g.glyph_id = id GROUP BY k, component),
  jr AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY x, y, width, height, root) - 1 AS component, x, y, width, height FROM jb)"""


@query("j1_rect_intersect", "page_id:l component:l x:l y:l width:l height:l", f"WITH RECURSIVE {JOINED} SELECT * FROM jr")
def _(spark, d):
    return rects.join_rects(bench(spark, d, 6), ["page_id"])


OVER = "(least(p.high, q.high) - greatest(p.low, q.low))"
JOIN10 = f"e AS (SELECT p.k, p.id AS a, q.id AS b FROM rg p JOIN rg q ON p.k = q.k AND p.id <> q.id AND p.high > p.low AND q.high > q.low AND {OVER} > 0.1 * (p.high - p.low) AND {OVER} > 0.1 * (q.high - q.low)), v AS (SELECT k, id FROM rg), {COMPONENTS}, jn AS (SELECT comp.k, component, min(low) AS low, max(high) AS high FROM comp JOIN rg ON rg.k = comp.k AND rg.id = comp.id GROUP BY comp.k, component)"


@query("j2_interval_overlap", "page_id:l component:l low:l high:l", f"WITH RECURSIVE {B}, rg AS (SELECT page_id AS k, glyph_id AS id, y AS low, y + height AS high FROM g), {JOIN10} SELECT k AS page_id, component, low, high FROM jn")
def _(spark, d):
    return intervals.join_intervals(bench(spark, d).select("page_id", F.col("glyph_id").alias("id"), F.col("y").alias("low"), (F.col("y") + F.col("height")).alias("high")), ["page_id"])


ENCLOSED = """k AS (SELECT * FROM {0} a WHERE NOT EXISTS (SELECT 1 FROM {0} b WHERE b.page_id = a.page_id AND b.{1} <> a.{1} AND b.x <= a.x AND b.y <= a.y AND b.x + b.width >= a.x + a.width AND b.y + b.height >= a.y + a.height
    AND (b.{1} < a.{1} OR NOT (a.x = b.x AND a.y = b.y AND a.width = b.width AND a.height = b.height)))),
  en AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x DESC, y DESC, x + width, y + height) - 1 AS position FROM k)"""


@query("j3_enclosure", BOX + " position:l", f"WITH {FRAMED}, {ENCLOSED.format('gf', 'glyph_id')} SELECT * FROM en")
def _(spark, d):
    return rects.enclosing(framed(spark, d), ["page_id"])


@query("j4_line_stab", "page_id:l glyph_id:l low:l high:l", f"WITH {D}, r AS (SELECT page_id, line_no, min(y) AS low, max(y + height) AS high FROM g GROUP BY ALL) SELECT g.page_id, glyph_id, low, high FROM g JOIN r ON r.page_id = g.page_id AND r.line_no = g.line_no")
def _(spark, d):
    return doc_pages(spark, d, text_pages.stab_rows, "glyph_id int, low int, high int")


@query("j5_group_glyphs", "page_id:l line_id:l glyph_id:l x:l y:l width:l height:l", f"""WITH RECURSIVE {T}, gl AS (SELECT page_id * 100000 + line_no AS k, glyph_id, x, y, width, height FROM g), rg AS (SELECT k, glyph_id AS id, x AS low, x + width AS high FROM gl), {JOIN10}
  SELECT jn.k // 100000 AS page_id, jn.k % 100000 AS line_id, component AS glyph_id, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM jn JOIN gl ON gl.k = jn.k AND x <= high AND low <= x + width GROUP BY jn.k, component""")
def _(spark, d):
    return lines.group_glyphs(lined(bench(spark, d, 6)))


def knn_sql(k: int, source: str = "g") -> str:
    return f"""kd AS (SELECT p.page_id, p.glyph_id AS id, q.glyph_id AS nb_id, ((p.x + p.width / 2.0) - (q.x + q.width / 2.0)) * ((p.x + p.width / 2.0) - (q.x + q.width / 2.0)) + ((p.y + p.height / 2.0) - (q.y + q.height / 2.0)) * ((p.y + p.height / 2.0) - (q.y + q.height / 2.0)) AS d FROM {source} p JOIN {source} q USING (page_id)),
  kn AS (SELECT page_id, id, nb_id, d, row_number() OVER (PARTITION BY page_id, id ORDER BY d, nb_id) - 1 AS rank FROM kd QUALIFY rank < {k})"""


@query("j6_knn", "page_id:l id:l rank:l nb_id:l", f"WITH {B}, {knn_sql(20)} SELECT * FROM kn")
def _(spark, d):
    return rects.knn(bench(spark, d), 20)


@query("j6_vector_knn", "id:l rank:l nb_id:l", """WITH v AS (SELECT vec_id, embedding AS e FROM embeddings), p AS (SELECT a.vec_id AS id, b.vec_id AS nb_id, list_sum(list_transform(list_zip(a.e, b.e), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))) AS d FROM v a, v b)
  SELECT id, nb_id, row_number() OVER (PARTITION BY id ORDER BY d, nb_id) - 1 AS rank FROM p QUALIFY rank < 10""")
def _(spark, d):
    return rects.vector_knn(table(spark, d, "embeddings"), 10)


@query("s4_knn_matrix", "page_id:l id:l rank:l nb_id:l", f"WITH {B}, {knn_sql(6)} SELECT * FROM kn")
def _(spark, d):
    near = rects.knn(bench(spark, d), 6)
    rows = near.groupBy("page_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "nb_id"))), lambda s: s["nb_id"].cast("long")).alias("row"))
    return src.knn_rows(rows.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "row"))), lambda s: s["row"]).alias("matrix")))


MARKED = f"""{B}, gm AS (SELECT page_id, glyph_id, x, y, width, height FROM g UNION ALL SELECT page_id, 100000 + glyph_id, x + 2, y - 4, 3, 3 FROM g WHERE glyph_id % 7 = 0)"""


def marked(spark, d):
    g = bench(spark, d).select("page_id", "glyph_id", *rects.SIDES)
    return g.union(g.where("glyph_id % 7 = 0").select("page_id", F.col("glyph_id") + 100000, F.col("x") + 2, F.col("y") - 4, F.lit(3), F.lit(3)))


NEAR = """mh AS (SELECT page_id, avg(height) AS mean FROM {0} GROUP BY page_id),
  c AS (SELECT kn.page_id, kn.id, kn.nb_id, greatest(a.y, b.y) AS top, least(a.y + a.height, b.y + b.height) AS low, least(a.y + 2 * a.height, b.y + b.height) AS low2, a.x AS ax, b.x AS bx, a.width AS aw, b.width AS bw, a.height AS ah, b.height AS bh, mean
    FROM kn JOIN {0} a ON a.page_id = kn.page_id AND a.glyph_id = kn.id JOIN {0} b ON b.page_id = kn.page_id AND b.glyph_id = kn.nb_id JOIN mh ON mh.page_id = kn.page_id WHERE kn.id <> kn.nb_id),
  s AS (SELECT page_id, id, nb_id, 1 AS source, (low - top) / CAST(bh AS DOUBLE) AS ratio, bx FROM c WHERE top < low AND bx > ax
    UNION ALL SELECT page_id, id, nb_id, 2, (low - top) / CAST(bh AS DOUBLE), bx FROM c WHERE top < low AND bx < ax AND ax - bx < mean
    UNION ALL SELECT page_id, id, nb_id, 3, (low2 - top) / CAST(bh AS DOUBLE), bx FROM c WHERE top < low2 AND ax > bx AND ax + aw < bx + bw AND bx - ax < 0.5 * mean AND ah < 0.4 * mean),
  best AS (SELECT page_id, id, nb_id, ratio, source FROM s QUALIFY row_number() OVER (PARTITION BY page_id, id ORDER BY source, bx / ratio, nb_id) = 1)"""


@query("j7_j8_j9_neighbors", "page_id:l id:l nb_id:l ratio:d source:l", f"WITH {MARKED}, {knn_sql(100, 'gm')}, {NEAR.format('gm')} SELECT gm.page_id, glyph_id AS id, nb_id, ratio, source FROM gm LEFT JOIN best ON best.page_id = gm.page_id AND best.id = glyph_id")
def _(spark, d):
    g = marked(spark, d)
    return rects.neighbors(g, rects.knn(g, 100))


@query("j10_nearest_right", "page_id:l id:l nb_id:l", f"""WITH {B}, {knn_sql(100)}, t AS (SELECT page_id, avg(height) - 3 AS least_height FROM g GROUP BY page_id),
  c AS (SELECT kn.*, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) AS over, least(a.height, b.height) AS lh, greatest(a.height, b.height) AS hh, (b.x + b.width / 2.0) - (a.x + a.width / 2.0) AS dx FROM kn JOIN g a ON a.page_id = kn.page_id AND a.glyph_id = kn.id JOIN g b ON b.page_id = kn.page_id AND b.glyph_id = kn.nb_id)
  SELECT page_id, id, nb_id FROM c JOIN t USING (page_id) WHERE dx > 0 AND over >= 0 AND lh > least_height AND over > 0.5 * hh QUALIFY row_number() OVER (PARTITION BY page_id, id ORDER BY sqrt(d), nb_id) = 1""")
def _(spark, d):
    g = bench(spark, d)
    least = g.groupBy("page_id").agg((F.avg("height") - 3).alias("least_height"))
    return rects.nearest_right(g.join(least, "page_id"), rects.knn(g, 100))


HALF = "hc AS (SELECT page_id, glyph_id, (x + width) // 2 AS px, (y + height) // 2 AS py FROM g)"


@query("j11_j12_half_corner_pairs", "page_id:l pairs:l total:d longest:d", f"WITH {B}, {HALF}, dd AS (SELECT a.page_id, sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) AS d FROM hc a JOIN hc b ON a.page_id = b.page_id AND a.glyph_id < b.glyph_id) SELECT page_id, count(*) AS pairs, sum(d) AS total, max(d) AS longest FROM dd GROUP BY page_id")
def _(spark, d):
    return rects.half_corner_pairs(bench(spark, d)).groupBy("page_id").agg(F.count("*").alias("pairs"), F.sum("dist").alias("total"), F.max("dist").alias("longest"))


#: Pictures too far below the text for anything but their captions to belong to them.
FAR = PICS.replace("last + 2)", "last + 42)")


@query("j13_captions", "page_id:l glyph_id:l picture:l", f"WITH {FAR} SELECT page_id, n + 1 + i AS glyph_id, n AS picture FROM ends, range(10) AS r(i)")
def _(spark, d):
    return captions.detect_captions(pictured(spark, d, 42))


@query("j14_isolation", "page_id:l component:l", f"""WITH {WORDS}, wb AS (SELECT page_id, line_id * 1000 + word_id AS component, min(x) AS x, min(y) AS y, max(x + width) AS r, max(y + height) AS b FROM words GROUP BY ALL), m AS (SELECT page_id, avg(height) AS mean, max(x + width) AS edge FROM g GROUP BY page_id)
  SELECT w.page_id, component FROM wb w JOIN m USING (page_id) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.page_id = w.page_id AND g.y + g.height / 2.0 >= w.y AND g.y + g.height / 2.0 <= w.b
    AND ((g.x + g.width / 2.0 >= greatest(0, w.x - floor(3 * mean)) AND g.x + g.width / 2.0 <= w.x) OR (g.x + g.width / 2.0 >= w.r AND g.x + g.width / 2.0 <= CASE WHEN w.r + floor(3 * mean) < edge THEN w.r + floor(3 * mean) ELSE edge - 1 END)))""")
def _(spark, d):
    g = bench(spark, d)
    boxes = lines.word_boxes(lined(g)).withColumn("component", F.col("line_id") * 1000 + F.col("word_id"))
    return captions.isolated(boxes.join(g.groupBy("page_id").agg(F.avg("height").alias("mean")), "page_id"), g)


@query("j15_attach_captions", "page_id:l component:l x:l y:l width:l height:l is_picture:b", f"""WITH {PICS}, gr AS (SELECT gp.page_id, glyph_id, x, y, width, height, glyph_id >= n AS own FROM gp JOIN ends USING (page_id)), u AS (SELECT page_id, glyph_id, x, y, width, height FROM gr WHERE NOT own UNION ALL SELECT page_id, min(glyph_id), min(x), min(y), max(x + width) - min(x), max(y + height) - min(y) FROM gr WHERE own GROUP BY page_id)
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY x, y, width, height, glyph_id) - 1 AS component, x, y, width, height, height > 7 * avg(height) OVER (PARTITION BY page_id) AND width > 3 * avg(height) OVER (PARTITION BY page_id) AS is_picture FROM u""")
def _(spark, d):
    g = pictured(spark, d)
    n = bench(spark, d).groupBy("page_id").agg(F.count("*").cast("int").alias("picture"))
    owned = g.join(n, "page_id").where("glyph_id > picture").select("page_id", "glyph_id", "picture")
    return captions.attach_captions(g, owned)


LINES = "ll AS (SELECT l_orderkey AS page_id, l_linenumber AS line_id, CAST(l_quantity AS BIGINT) AS upper, CAST(l_quantity AS BIGINT) + 1 AS upper_baseline, CAST(l_quantity AS BIGINT) + l_partkey % 20 AS lower_baseline, CAST(l_quantity AS BIGINT) + l_partkey % 20 + 1 AS lower FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) = 1)"


def _limits(spark, d):
    q, e = F.col("l_quantity").cast("long"), F.col("l_partkey") % 20
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("line_id"), "l_partkey", "l_quantity", q.alias("upper"), (q + 1).alias("upper_baseline"), (q + e).alias("lower_baseline"), (q + e + 1).alias("lower"))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("page_id", "line_id").orderBy("l_partkey", "l_quantity"))).where("_r = 1").drop("_r", "l_partkey", "l_quantity")


@query("j16_line_containment", "page_id:l line_id:l upper:l lower:l", f"WITH {LINES} SELECT * FROM ll a WHERE NOT EXISTS (SELECT 1 FROM ll b WHERE b.page_id = a.page_id AND b.line_id <> a.line_id AND b.upper <= a.upper AND b.lower >= a.lower AND (b.line_id < a.line_id OR b.upper < a.upper OR b.lower > a.lower))")
def _(spark, d):
    return intervals.drop_contained_lines(_limits(spark, d))


@query("j17_merge_adjacent", "page_id:l line_id:l upper:l upper_baseline:l lower_baseline:l lower:l", f"""WITH {LINES}, n AS (SELECT *, lead(upper) OVER w AS nu, lead(lower) OVER w AS nl, lead(lower_baseline) OVER w AS nb FROM ll WINDOW w AS (PARTITION BY page_id ORDER BY lower_baseline, upper, lower, line_id)),
  j AS (SELECT *, coalesce(lower > nu AND lower - greatest(upper, nu) > 0.5 * greatest(nl - nu, lower - upper), false) AS joins FROM n),
  k AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY page_id ORDER BY lower_baseline, upper, lower, line_id), false) AS joined FROM j)
  SELECT page_id, line_id, CASE WHEN joins THEN least(upper, nu) ELSE upper END AS upper, upper_baseline, CASE WHEN joins THEN nb ELSE lower_baseline END AS lower_baseline, CASE WHEN joins THEN nl ELSE lower END AS lower FROM k WHERE joins OR NOT joined""")
def _(spark, d):
    return intervals.merge_adjacent_lines(_limits(spark, d))


@query("j18_lookup_by_range", "page_id:l glyph_id:l same:l", f"WITH {B} SELECT a.page_id, a.glyph_id, count(*) AS same FROM g a JOIN g b ON a.page_id = b.page_id AND a.y = b.y AND a.height = b.height GROUP BY ALL")
def _(spark, d):
    g = bench(spark, d)
    n = g.groupBy("page_id", "y", "height").agg(F.count("*").alias("same"))
    return g.join(n, ["page_id", "y", "height"])


ORDERED = f"""{WORDS}, vals AS (SELECT page_id * 100000 + line_id AS page_id, y + height AS v FROM words), {HIST.format(n=50)}, lo AS (SELECT page_id AS k, arg_max(left_edge, cnt * 100 - bucket) AS lower FROM h GROUP BY page_id)
  SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY line_id) - 1 AS line_id, word_id, pos, x, y, width, height, CAST(trunc(lower) AS BIGINT) - (y + height) AS shift, lower FROM words JOIN lo ON k = page_id * 100000 + line_id"""


@query("ordered_glyphs", "page_id:l line_id:l word_id:l pos:l x:l y:l width:l height:l shift:l lower:d", f"WITH {ORDERED}")
def _(spark, d):
    """The lines are found from the boxes alone; the SQL knows where they were put."""
    return lines.ordered_glyphs(bench(spark, d))


@query("get_joined_rects", "page_id:l glyph_id:l x:l y:l width:l height:l", f"WITH RECURSIVE {JOINED}, {ENCLOSED.format('jr', 'component')} SELECT page_id, position AS glyph_id, x, y, width, height FROM en")
def _(spark, d):
    return pages.joined_rects(_components(bench(spark, d, 6)))


def _components(g):
    return g.select("page_id", F.col("glyph_id").alias("comp_id"), *rects.SIDES, (F.col("width") * F.col("height")).alias("area"))


#: Components without specks; as no two boxes of the fixture meet, they stay as they are but for the caption.
KEPT = f"""{FAR}, ga AS (SELECT *, sum(width * height) OVER (PARTITION BY page_id) / CAST(count(*) OVER (PARTITION BY page_id) AS DOUBLE) / 10 AS least FROM gp),
  gk AS (SELECT page_id, glyph_id, x, y, width, height, glyph_id >= n AS own FROM ga JOIN ends USING (page_id) WHERE width * height >= least)"""


@query("get_rects_with_captions", "page_id:l component:l x:l y:l width:l height:l is_picture:b", f"""WITH {KEPT}, u AS (SELECT page_id, x, y, width, height FROM gk WHERE NOT own UNION ALL SELECT page_id, min(x), min(y), max(x + width) - min(x), max(y + height) - min(y) FROM gk WHERE own GROUP BY page_id)
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY x, y, width, height) - 1 AS component, x, y, width, height, height > 7 * avg(height) OVER (PARTITION BY page_id) AND width > 3 * avg(height) OVER (PARTITION BY page_id) AS is_picture FROM u""")
def _(spark, d):
    return pages.rects_with_captions(_components(pictured(spark, d, 42)))


TEXT_KEPT = ORDERED.replace(B, KEPT + ", gz AS (SELECT g.* FROM g JOIN gk USING (page_id, glyph_id) WHERE NOT own)").replace("FROM g WINDOW l", "FROM gz WINDOW l")


@query("get_ordered_glyphs", "page_id:l line_id:l word_id:l pos:l x:l y:l width:l height:l shift:l lower:d", f"WITH {TEXT_KEPT}")
def _(spark, d):
    return pages.ordered_glyphs(_components(pictured(spark, d, 42)))


@query("line_limits", "page_id:l line_id:l upper:l upper_baseline:l lower_baseline:l lower:l")
def _(spark, d):
    return pages.line_limits(bench(spark, d).select("page_id", "glyph_id", *rects.SIDES))


@query("overlap_find_all", "page_id:l glyph_id:l low:l high:l", f"WITH {B}, r AS (SELECT page_id, line_no, min(y) AS low, max(y + height) AS high FROM g GROUP BY ALL) SELECT g.page_id, glyph_id, low, high FROM g JOIN r ON r.page_id = g.page_id AND g.y - 10 <= high AND low <= g.y + g.height + 10")
def _(spark, d):
    g = bench(spark, d)
    limits = g.groupBy("page_id", "line_no").agg(F.min("y").alias("low"), F.max(F.col("y") + F.col("height")).alias("high")).drop("line_no")
    return intervals.interval_join(g.select("page_id", "glyph_id", (F.col("y") - 10).alias("a"), (F.col("y") + F.col("height") + 10).alias("b")), limits, ["page_id"], ("a", "b"), ("low", "high"), 64)


@query("overlap_find_first", "page_id:l glyph_id:l low:l high:l", f"WITH {B}, r AS (SELECT page_id, line_no, min(y) AS low, max(y + height) AS high FROM g GROUP BY ALL) SELECT g.page_id, glyph_id, low, high FROM g JOIN r ON r.page_id = g.page_id AND g.y BETWEEN low - 0 AND high QUALIFY row_number() OVER (PARTITION BY g.page_id, glyph_id ORDER BY low, high) = 1")
def _(spark, d):
    g = bench(spark, d)
    limits = g.groupBy("page_id", "line_no").agg(F.min("y").alias("low"), F.max(F.col("y") + F.col("height")).alias("high")).drop("line_no")
    return intervals.stab(g.select("page_id", "glyph_id", "y"), limits, ["page_id"], "y")



"""Components, clusters and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import captions, clusters, graph, histograms, rects
from foliant.plans import pages
from foliant.plans.registry import query
from foliant.plans.linear_queries import B, T, bench, pictured
from foliant.plans.pair_queries import COMPONENTS, HALF, MEET, _components, knn_sql


def _edges(g):
    return rects.meeting_pairs(g, ["page_id"]).select("page_id", F.col("a_glyph_id").alias("src"), F.col("b_glyph_id").alias("dst"))


@query("g1_g2_components", "page_id:l glyph_id:l component:l", f"WITH RECURSIVE {T}, {MEET}, {COMPONENTS} SELECT k AS page_id, id AS glyph_id, component FROM comp")
def _(spark, d):
    g = bench(spark, d, 6)
    return graph.page_components(g, _edges(g), ["page_id"], "glyph_id")


@query("g1_star_components", "vertex:l component:l", f"WITH RECURSIVE {T}, {MEET}, {COMPONENTS} SELECT k * 100000 + id AS vertex, k * 100000 + component AS component FROM comp WHERE (k, id) IN (SELECT (k, a) FROM e)")
def _(spark, d):
    far = lambda c: F.col("page_id") * 100000 + F.col(c)
    return graph.star_components(_edges(bench(spark, d, 6)).select(far("src").alias("u"), far("dst").alias("v")))


CLOSE = f"{HALF}, li AS (SELECT page_id, 0.9 * avg(height) AS cut FROM g GROUP BY page_id), e AS (SELECT a.page_id AS k, a.glyph_id AS a, b.glyph_id AS b FROM hc a JOIN hc b ON a.page_id = b.page_id AND a.glyph_id <> b.glyph_id JOIN li ON li.page_id = a.page_id WHERE sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) < cut), v AS (SELECT page_id AS k, glyph_id AS id FROM g), {COMPONENTS}"


@query("g5_cut_dist", "page_id:l glyph_id:l component:l", f"WITH RECURSIVE {B}, {CLOSE} SELECT k AS page_id, id AS glyph_id, component FROM comp")
def _(spark, d):
    g = bench(spark, d)
    return clusters.cut_dist(g, g.groupBy("page_id").agg((F.lit(0.9) * F.avg("height")).alias("limit")))


@query("a11_cluster_count", "page_id:l clusters:l", f"WITH RECURSIVE {B}, {CLOSE} SELECT k AS page_id, count(DISTINCT component) AS clusters FROM comp GROUP BY k")
def _(spark, d):
    g = bench(spark, d)
    page = g.groupBy("page_id").agg(F.count("*").alias("n"), (F.lit(0.9) * F.avg("height")).alias("limit"))
    return clusters.cut_count(clusters.mst(clusters.points(g)), page.select("page_id", "n"), page.select("page_id", F.lit(0).alias("step"), "limit"))


@query("f7_small_component", "page_id:l glyph_id:l component:l", f"WITH RECURSIVE {B}, {CLOSE}, z AS (SELECT k, component FROM comp GROUP BY ALL HAVING count(*) BETWEEN 1 AND 99) SELECT k AS page_id, id AS glyph_id, component FROM comp JOIN z USING (k, component)")
def _(spark, d):
    g = bench(spark, d)
    found = clusters.cut_dist(g, g.groupBy("page_id").agg((F.lit(0.9) * F.avg("height")).alias("limit")))
    return captions.small_components(found, histograms.tall(g))


@query("g3_mst", "page_id:l edges:l total:d")
def _(spark, d):
    return clusters.mst(clusters.points(bench(spark, d))).groupBy("page_id").agg(F.count("*").alias("edges"), F.sum("dist").alias("total"))


@query("g4_cut_k", "page_id:l id:l label:l")
def _(spark, d):
    p = clusters.points(bench(spark, d))
    return clusters.cut_k(clusters.mst(p), p, 5)


@query("g6_coef_sweep", "page_id:l coef:d cut:d found:b")
def _(spark, d):
    g = bench(spark, d)
    return clusters.sweep(clusters.mst(clusters.points(g)), g)


@query("g12_fcluster_sweep", "page_id:l coef:d cut:d found:b")
def _(spark, d):
    g = bench(spark, d)
    return clusters.sweep(clusters.mst(clusters.points(g)), g, coefs=[2 + i * 2 / 19 for i in range(20)])


@query("g7_get_clusters", "page_id:l glyph_id:l label:l")
def _(spark, d):
    return pages.page_clusters(_components(pictured(spark, d)))


for _method in ("single", "complete", "average", "median"):

    @query(f"g8_linkage_{_method}", "page_id:l step:l a:l b:l dist:d")
    def _(spark, d, method=_method):
        return clusters.linkage(clusters.points(bench(spark, d)), method)


@query("g11_knn_graph_clusters", "page_id:l glyph_id:l component:l", f"WITH RECURSIVE {B}, {knn_sql(30)}, li AS (SELECT page_id, 1.1 * avg(height) AS cut FROM g GROUP BY page_id), e0 AS (SELECT kn.page_id AS k, id AS a, nb_id AS b FROM kn JOIN li USING (page_id) WHERE sqrt(d) < cut), e AS (SELECT * FROM e0 UNION SELECT k, b, a FROM e0), v AS (SELECT page_id AS k, glyph_id AS id FROM g), {COMPONENTS} SELECT k AS page_id, id AS glyph_id, component FROM comp")
def _(spark, d):
    g = bench(spark, d)
    return clusters.knn_graph_clusters(g, rects.knn(g, 30), g.groupBy("page_id").agg((F.lit(1.1) * F.avg("height")).alias("limit")))

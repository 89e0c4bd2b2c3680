"""Small cases worked out by hand, and properties that must hold on any page."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry as geo
from foliant.operators import captions, clusters, graph, histograms, intervals, layout, lines, raster, rects
from foliant.sources import glyphs, images


def boxes(spark, *pages):
    rows = [(p, i, *r) for p, page in enumerate(pages) for i, r in enumerate(page)]
    return spark.createDataFrame(rows, "page_id long, glyph_id int, x int, y int, width int, height int")


def found(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


SIDES = rects.SIDES


def test_group_glyphs(spark):
    g = boxes(spark, [(0, 0, 2, 3), (1, 1, 2, 2), (5, 0, 2, 3), (6, 0, 2, 3)], [(0, 0, 5, 9), (5, 0, 4, 9)]).withColumn("line_id", F.lit(0))
    assert found(lines.group_glyphs(g), "page_id", *SIDES) == [(0, 0, 0, 3, 3), (0, 5, 0, 3, 3), (1, 0, 0, 9, 9), (1, 0, 0, 9, 9)]


def test_baseline(spark):
    g = boxes(spark, [(0, 1, 2, 2), (3, 1, 2, 2), (5, 1, 2, 2), (7, 0, 2, 3), (9, 1, 2, 2), (11, 1, 2, 2), (13, 0, 2, 3)])
    assert found(histograms.baseline(g, ["page_id"]), "lower") == [(3.0,)]


@pytest.mark.parametrize("ranges, want", [([(0, 5), (2, 3)], [(0, 5)]), ([(0, 10), (9, 19)], [(0, 10), (9, 19)]), ([(3, 3), (0, 10)], [(0, 10), (3, 3)]), ([(0, 10), (8, 20), (18, 30)], [(0, 30)])])
def test_join_intervals(spark, ranges, want):
    r = spark.createDataFrame([(0, i, *x) for i, x in enumerate(ranges)], "page_id long, id int, low int, high int")
    assert found(intervals.join_intervals(r, ["page_id"]), "low", "high") == want


def test_neighbors(spark):
    g = boxes(spark, [(1, 1, 1, 1), (3, 1, 1, 1), (5, 1, 1, 1), (1, 3, 1, 1), (3, 3, 1, 1), (5, 3, 1, 1)])
    got = {r["id"]: r["nb_id"] for r in rects.neighbors(g, rects.knn(g, 6)).collect()}
    assert got == {0: 1, 1: 2, 2: None, 3: 4, 4: 5, 5: None}


@pytest.mark.parametrize("page, want", [([(0, 0, 5, 5), (5, 2, 5, 5)], [(0, 0, 10, 7)]), ([(0, 0, 5, 5), (3, 0, 5, 5)], [(0, 0, 8, 5)]), ([(0, 0, 5, 5), (4, 4, 5, 5), (8, 8, 5, 5)], [(0, 0, 13, 13)]), ([(0, 0, 5, 5), (6, 0, 5, 5)], [(0, 0, 5, 5), (6, 0, 5, 5)])])
def test_join_rects(spark, page, want):
    assert found(rects.join_rects(boxes(spark, page), ["page_id"]), *SIDES) == want


def test_enclosing(spark):
    got = rects.enclosing(boxes(spark, [(0, 0, 10, 10), (2, 2, 3, 3), (20, 0, 5, 5), (20, 0, 5, 5)]), ["page_id"]).orderBy("position")
    assert [tuple(r) for r in got.select("glyph_id", *SIDES).collect()] == [(2, 20, 0, 5, 5), (0, 0, 0, 10, 10)]


def test_histogram(spark):
    v = spark.createDataFrame([(0, 0), (0, 0), (0, 10), (1, 7), (1, 7)], "page_id long, v int")
    assert found(histograms.hist(v, ["page_id"], "v", 2), "page_id", "bucket", "cnt", "left_edge") == [(0, 0, 4, 0.0), (0, 1, 1, 5.0), (1, 0, 4, 7.0)]
    assert found(histograms.fullest_edge(v, ["page_id"], "v", 50, "edge"), "page_id", "edge") == [(0, 0.0), (1, 7.0)]


def test_words(spark):
    g = boxes(spark, [(0, 0, 8, 10), (10, 0, 8, 10), (30, 0, 8, 10)], [(4, 0, 8, 10)]).withColumn("line_id", F.lit(0))
    assert found(lines.word_gaps(g), "page_id", "idx", "gap") == [(0, 2, 12)]
    assert found(lines.split_words(g), "page_id", "glyph_id", "word_id") == [(0, 0, 0), (0, 1, 0), (0, 2, 1), (1, 0, 0)]
    assert found(lines.split_at(g, lines.word_gaps(g)), "page_id", "glyph_id", "word_id") == [(0, 0, 0), (0, 1, 0), (0, 2, 1), (1, 0, 0)]


def test_paragraphs(spark):
    rows = [(0, i, x, 10.0) for i, x in enumerate((30, 0, 0, 25, 0))] + [(1, 0, 5, 10.0)]
    got = lines.paragraphs(spark.createDataFrame(rows, "page_id long, line_id int, left_x int, mean double"))
    assert found(got.where("starts"), "page_id", "line_id") == [(0, 0), (0, 3)]
    assert found(got, "page_id", "line_id", "paragraph") == [(0, 0, 0), (0, 1, 0), (0, 2, 0), (0, 3, 1), (0, 4, 1), (1, 0, 0)]


@pytest.mark.parametrize("a, b, want", [((0, 0, 2, 2), (5, 0, 2, 2), (3.0, geo.LEFT)), ((0, 0, 2, 2), (5, 6, 2, 2), (5.0, geo.UNKNOWN)), ((0, 0, 2, 2), (2, 0, 2, 2), (0.0, geo.UNKNOWN)), ((0, 9, 2, 2), (0, 0, 2, 2), (7.0, geo.BOTTOM)), ((0, 0, 2, 2), (1, 9, 2, 2), (7.0, geo.UP))])
def test_rect_dist(spark, a, b, want):
    row = spark.createDataFrame([(*a, *b)], ", ".join(f"{p}{c} int" for p in ("", "p_") for c in SIDES))
    r, q = geo.Rect(), geo.Rect("p_")
    assert tuple(row.select(geo.rect_dist(r, q), geo.position(r, q)).first()) == want


def test_intervals_as_sets(spark):
    rnd = random.Random(1)
    rows = [(k, a, a + rnd.randrange(9)) for k in range(5) for a in (rnd.randrange(80) for _ in range(12))]
    r = spark.createDataFrame(rows, "k int, low int, high int")
    union = intervals.union_all(r, ["k"])
    for k in range(5):
        parts = [(a, b) for q, a, b in found(union, "k", "low", "high") if q == k]
        assert {x for a, b in parts for x in np.arange(a, b + 0.5, 0.5)} == {x for q, a, b in rows if q == k for x in np.arange(a, b + 0.5, 0.5)}
        assert all(p[1] < q[0] for p, q in itertools.pairwise(parts))
    bounds = spark.createDataFrame([(k, -5, 200) for k in range(5)], "k int, first int, last int")
    for k, a, b in found(intervals.complement(union, bounds, ["k"]), "k", "low", "high"):
        assert a < b and not any(q == k and low < b and a < high for q, low, high in rows)


def naive_components(n, edges):
    group = list(range(n))
    for a, b in edges:
        if group[a] != group[b]:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    return group


def test_star_components(spark):
    rnd = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(80)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(70)] + [(5, 5), (7, 6)]
    got = dict(found(graph.star_components(spark.createDataFrame(edges, "u long, v long")), "vertex", "component"))
    group = naive_components(400, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {v: group[v] for v in touched}
    assert graph.star_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_clusters(spark):
    rnd = random.Random(3)
    page = [(rnd.randrange(120), rnd.randrange(120), 4, 4 + rnd.randrange(4)) for _ in range(40)]
    g = boxes(spark, page)
    half = np.array([((x + w) // 2, (y + h) // 2) for x, y, w, h in page], float)
    d = np.sqrt(((half[:, None] - half[None]) ** 2).sum(2))
    pts = clusters.points(g)
    tree = clusters.mst(pts).cache()
    mean = np.mean([h for *_, h in page])

    def labels(limit):
        return naive_components(40, [(i, j) for i in range(40) for j in range(i) if d[i, j] < limit])

    counts = [len(set(labels(mean * c))) for c in clusters.coefficients()]
    assert len(counts) == 35
    stop = next((i for i in range(1, 35) if counts[i] == counts[i - 1]), None)
    row = clusters.sweep(tree, g).first()
    assert row["found"] == (stop is not None) and (stop is None or abs(row["coef"] - clusters.coefficients()[stop]) < 1e-12)
    late = clusters.sweep(tree, g, lagged=True).first()
    want = next((i for i in range(2, 35) if counts[i - 1] == counts[i - 2]), 34)
    assert abs(late["coef"] - clusters.coefficients()[want]) < 1e-12
    limit = spark.createDataFrame([(0, float(mean * 1.3))], "page_id long, limit double")
    assert [c for _, c in found(clusters.cut_dist(g, limit), "glyph_id", "component")] == labels(mean * 1.3)
    heights = sorted(x for (x,) in found(tree, "dist"))
    assert np.allclose(sorted(x for (x,) in found(clusters.linkage(pts), "dist")), heights)
    assert len({x for _, x in found(clusters.cut_k(tree, pts, 6), "id", "label")}) == 6
    for k in (0, 1, 41):
        assert {x for (x,) in found(clusters.cut_k(tree, pts, k), "label")} == {0}
    for method in ("complete", "average", "median"):
        assert clusters.linkage(pts, method).count() == 39
    top = max(x for (x,) in found(clusters.linkage(pts, "complete"), "dist"))
    assert abs(top - d.max()) < 1e-9


def test_captions(spark):
    text = [(12 * c, 24 * r, 8, 12) for r in range(6) for c in range(30)]
    picture, caption = (0, 200, 300, 150), [(12 * c, 356, 8, 12) for c in range(10)]
    g = boxes(spark, [*text, picture, *caption], text[:5])
    found_ = captions.detect_captions(g)
    assert found(found_, "page_id", "glyph_id", "picture") == [(0, len(text) + 1 + i, len(text)) for i in range(10)]
    owned = spark.createDataFrame([(0, len(text) + 1 + i, len(text)) for i in range(10)], "page_id long, glyph_id int, picture int")
    grown = captions.attach_captions(g, owned)
    assert found(grown.where("is_picture"), "page_id", *SIDES) == [(0, 0, 200, 300, 168)]
    assert grown.where("page_id = 0").count() == len(text) + 1 and grown.where("page_id = 1").count() == 5


def test_runs(spark):
    profile = spark.createDataFrame([(0, i, v) for i, v in enumerate((0, 1, 1, 0, 1))], "page_id long, x int, v int")
    assert found(raster.one_runs(profile, ["page_id"], "x"), "first", "last") == [(1, 2), (4, 4)]
    assert found(raster.one_runs(profile, ["page_id"], "x", zero=True), "first", "last") == [(0, 0), (3, 3)]
    assert found(raster.zero_runs(profile, ["page_id"], "x"), "first", "last") == [(3, 3)]
    assert found(raster.widest(raster.one_runs(profile, ["page_id"], "x"), ["page_id"]), "widest") == [(0,)]


def test_image_to_components(spark, tmp_path):
    page = np.full((30, 40), 250, np.uint8)
    page[2:8, 3:9] = 10
    page[8:12, 9:15] = 20
    page[20:27, 30:37] = 5
    page[22:25, 32:35] = 240
    (tmp_path / "a.pgm").write_bytes(images.encode(page))
    files = images.read_images(spark, str(tmp_path)).withColumn("page_id", F.lit(1).cast("long"))
    cut = histograms.otsu(images.gray_histogram(files))
    dark = images.foreground_runs(files.join(cut, "page_id"))
    got = found(raster.components(dark), "x", "y", "width", "height", "area")
    assert got == [(3, 2, 12, 10, 60), (30, 20, 7, 7, 40)]
    assert found(raster.outer_boundaries(dark), "area", "filled") == [(40, 49), (60, 60)]
    assert (images.decode(images.encode(page)) == page).all() and images.decode(b"x").size == 0
    assert images.resize(page, 80, 60).shape == (60, 80) and (images.resize(page, 40, 30) == page).all()
    shown = images.render((50, 50), page, [(3, 2, 6, 6, 48, -2), (0, 0, 1, 1, 99, 99)])
    assert shown.shape == (50, 50) and shown[0, 48] == 10 and shown[10, 10] == 255


def test_mask_and_morphology(spark):
    rnd = np.random.default_rng(2)
    page = rnd.random((20, 30)) < 0.4
    cells = [(0, int(y), int(x), int(x)) for y, x in zip(*np.nonzero(page))]
    r = raster.merged(spark.createDataFrame(cells, "page_id long, y int, x0 int, x1 int"))

    def pixels(df):
        return {(y, x) for _, y, a, b in found(df, "page_id", "y", "x0", "x1") for x in range(a, b + 1)}

    own = {(int(y), int(x)) for y, x in zip(*np.nonzero(page))}
    assert pixels(r) == own
    grown = {(y + i, x + j) for y, x in own for i in (-1, 0, 1) for j in (-1, 0, 1)}
    assert pixels(raster.dilate(r, 1, 1, 1, 1)) == grown
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert pixels(raster.erode(r, 1, 1, 1, 1)) == {(y, x) for y, x in own if all((y + i, x + j) in own for i, j in near)}
    assert own <= pixels(raster.close(r))
    holes = spark.createDataFrame([(0, 5, 5, 10, 10), (0, 8, 8, 20, 2)], "page_id long, x int, y int, width int, height int")
    gone = {(y, x) for x0, y0, w, h in ((5, 5, 10, 10), (8, 8, 20, 2)) for y in range(y0, y0 + h) for x in range(x0, x0 + w)}
    assert pixels(raster.mask(r, holes)) == own - gone


def glyph(x, w, shift=0):
    return {"x": x, "y": 0, "width": w, "height": 10, "shift": shift}


def word(seq, width, gap, gs=None):
    return {"seq": seq, "x": 0, "y": 0, "width": width, "height": 10, "gap": gap, "glyphs": gs if gs is not None else [glyph(0, width)]}


def test_break_words():
    lines_ = layout.break_words([word(0, 40, 5), word(1, 40, 5), word(2, 40, 5)], 90)
    assert [[w[0] for w in line] for line in lines_] == [[0, 1], [2]]
    long = [glyph(10 * i, 9, -i) for i in range(10)]
    lines_ = layout.break_words([word(0, 20, 5), word(1, 99, 5, long), word(2, 10, 5)], 50)
    pieces = [w for line in lines_ for w in line if w[0] == 1]
    assert sum(round((p[3] + 1) / 10) for p in pieces) == 10 and all(p[3] <= 50 for p in pieces)
    assert lines_[-1][-1][0] == 2 and layout.break_words([], 50) == []


def test_picture_cursor(spark):
    rows = spark.createDataFrame([(0, i, 20 * i + 10) for i in range(6)], "page_id long, row int, first_bottom int")
    pics = spark.createDataFrame([(0, 0, 15), (0, 1, 16), (0, 2, 500)], "page_id long, picture int, y int")
    assert found(layout.place_pictures(rows, pics), "row", "picture") == [(1, 0), (2, 1)]


def test_xycut():
    """Worked out by hand: the mean height is 10; the first pass takes the gap of 64 columns only, as both parts are too narrow for cuts by rows."""
    page = np.zeros((80, 120), bool)
    for y, x in ((5, 5), (35, 5), (5, 90), (21, 90)):
        page[y : y + 10, x : x + 20] = True
    # trimmed to x 5..108, y 5..43; columns 25..89 are white, ends 64 apart; the second pass asks for over 63, so nothing else is cut
    got = layout.xycut(page)
    boxes = [(n["parent_id"], n["side"], n["x"], n["y"], n["w"], n["h"], n["leaf"]) for n in got]
    assert boxes == [(-1, "root", 5, 5, 104, 39, False), (0, "first", 5, 5, 20, 39, True), (0, "second", 89, 5, 20, 39, True)]
    assert [n["w"] for n in layout.xycut(page, 1)] == [120]
    wide = np.zeros((120, 100), bool)
    for y in (5, 40, 90):
        wide[y : y + 20, 5:95] = True
    # mean height 20; rows 60..89 are white, 29 apart, the rest above has rows 25..39, 14 apart, which isn't over 20; second pass: over 28
    boxes = [(n["side"], n["x"], n["y"], n["w"], n["h"], n["leaf"]) for n in layout.xycut(wide)]
    assert boxes == [("root", 5, 5, 89, 104, False), ("first", 5, 5, 89, 55, True)]
    tall = page.copy()
    tall[2:78, 60] = True
    assert [(n["x"], n["w"]) for n in layout.xycut(tall)] == [(n["x"], n["w"]) for n in got]
    assert len(layout.xycut(np.zeros((9, 9), bool))) == 1 and len(layout.xycut(np.ones((9, 9), bool))) == 1
    assert sorted(layout.component_boxes(page)) == [(5, 5, 20, 10), (5, 35, 20, 10), (90, 5, 20, 10), (90, 21, 20, 10)]


def test_component_boxes_by_flooding():
    rng = np.random.default_rng(3)
    for _ in range(5):
        page = rng.random((25, 30)) < 0.3
        todo, want = {(int(y), int(x)) for y, x in zip(*np.nonzero(page))}, []
        while todo:
            own, edge = set(), [todo.pop()]
            while edge:
                y, x = edge.pop()
                own.add((y, x))
                edge += [p for p in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if p in todo]
                todo -= set(edge)
            ys, xs = zip(*own)
            want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
        assert sorted(layout.component_boxes(page)) == sorted(want)


def test_order_of_rows_does_not_matter(spark):
    rnd = random.Random(5)
    page = [(rnd.randrange(200), 24 * rnd.randrange(4) + rnd.randrange(4), 8, 12) for _ in range(60)]
    g = boxes(spark, page)
    again = spark.createDataFrame(rnd.sample([tuple(r) for r in g.collect()], len(page)), g.schema)
    for f in (lambda t: rects.join_rects(t, ["page_id"]), lambda t: rects.enclosing(t, ["page_id"]), lambda t: lines.ordered_glyphs(t), lambda t: rects.knn(t, 7)):
        one = f(g)
        assert found(one, *one.columns) == found(f(again), *one.columns)


def test_empty_pages(spark):
    none = boxes(spark, [(0, 0, 1, 1)]).limit(0)
    for df in (rects.join_rects(none, ["page_id"]), rects.enclosing(none, ["page_id"]), rects.knn(none), lines.ordered_glyphs(none), captions.detect_captions(none), histograms.tall(none)):
        assert df.count() == 0


def test_nested_and_maps(spark):
    g = boxes(spark, [(0, 0, 8, 10), (10, 0, 8, 10), (30, 0, 8, 10), (0, 30, 8, 10)]).withColumns({"line_id": F.floor(F.col("y") / 30).cast("int"), "shift": F.lit(0)})
    words = lines.split_words(g)
    nested = glyphs.nested_lines(words)
    assert [len(line) for line in nested.first()["lines"]] == [2, 1]
    assert glyphs.from_nested(nested).count() == 4
    matrix = spark.createDataFrame([(0, [[0, 1], [1, 0]])], "page_id long, matrix array<array<long>>")
    assert found(glyphs.knn_rows(matrix), "id", "rank", "nb_id") == [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)]

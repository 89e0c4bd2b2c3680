"""Laying a page out at another width: line breaking, page geometry, placements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.geometry import TALL_TIMES, scale
from foliant.operators.graph import union_find
from foliant.operators.lines import paragraphs
from foliant.shared import materialise

PIECE = "page_id long, paragraph int, line int, seq int, x int, y int, width int, height int, shift int, gap int, real boolean"
_PIECE = pa.schema([("page_id", pa.int64()), *((c, pa.int32()) for c in ("paragraph", "line", "seq", "x", "y", "width", "height", "shift", "gap")), ("real", pa.bool_())])


def scaled(glyphs: DataFrame, zoom: float) -> DataFrame:
    """All five fields of glyphs times ``zoom``, cut to whole numbers."""
    return glyphs.withColumns({c: scale(c, zoom) for c in ("x", "y", "width", "height", "shift")})


def line_starts(glyphs: DataFrame) -> DataFrame:
    """(page_id, line_id, left_x, mean): the left edge of each line and the page's mean height of boxes."""
    mean = glyphs.groupBy("page_id").agg(F.avg("height").alias("mean"))
    return glyphs.groupBy("page_id", "line_id").agg(F.min("x").alias("left_x")).join(mean, "page_id")


def entries(glyphs: DataFrame, zoom: float) -> DataFrame:
    """(page_id, paragraph, seq, glyphs, x, y, width, height, gap): the words of ordered glyphs as one list a paragraph.

    An empty word with the indent, twice the mean scaled width, begins a paragraph; every line's last word is followed by the mean
    width and by an empty word with the same gap.
    """
    par = paragraphs(line_starts(glyphs)).select("page_id", "line_id", "paragraph")
    average = glyphs.groupBy("page_id").agg((F.sum(F.col("width") * F.lit(float(zoom))) / F.count("*")).alias("av"))
    big = scaled(glyphs, zoom)
    one = F.struct("pos", "x", "y", "width", "height", "shift")
    words = big.groupBy("page_id", "line_id", "word_id").agg(F.array_sort(F.collect_list(one)).alias("glyphs"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"))
    order = Window.partitionBy("page_id", "line_id").orderBy("word_id")
    step = F.lead("x").over(order) - (F.col("x") + F.col("width"))
    words = words.withColumn("_gap", step).join(par, ["page_id", "line_id"]).join(average, "page_id")
    gap = F.coalesce("_gap", F.col("av").cast("int"))
    words = words.withColumn("gap", gap.cast("int"))
    none, zero = F.expr("cast(array() as array<struct<pos:int,x:int,y:int,width:int,height:int,shift:int>>)"), F.lit(0)
    names = ["page_id", "paragraph", "line_id", "word_id", "glyphs", "x", "y", "width", "height", "gap"]
    real = words.withColumn("glyphs", F.col("glyphs").cast("array<struct<pos:int,x:int,y:int,width:int,height:int,shift:int>>")).select(*names)
    lines = words.groupBy("page_id", "paragraph", "line_id").agg(F.first("av").alias("av"))
    pseudo = lambda rows, word, gap: rows.select("page_id", "paragraph", "line_id", F.lit(word).alias("word_id"), none.alias("glyphs"), *[zero.alias(c) for c in ("x", "y", "width", "height")], gap.cast("int").alias("gap"))
    first = lines.groupBy("page_id", "paragraph").agg(F.min("line_id").alias("line_id"), F.first("av").alias("av"))
    every = real.union(pseudo(first, -1, F.col("av") * 2)).union(pseudo(lines, 1 << 30, F.col("av")))
    return every.withColumn("seq", F.row_number().over(Window.partitionBy("page_id", "paragraph").orderBy("line_id", "word_id")) - 1)


def break_words(words: list[dict], width: int) -> list[list[tuple]]:
    """Lines of (seq, x, y, width, height, shift, gap, real): words one after the other until one doesn't fit.

    The gap after a word counts only once another follows. A word wider than a line is cut between glyphs where it passes the
    width; all its pieces but the last are lines of their own.
    """
    lines: list[list[tuple]] = []
    line: list[tuple] = []
    used = 0
    for w in words:
        shift = min((g["shift"] for g in w["glyphs"]), default=0)
        entry = (w["seq"], w["x"], w["y"], w["width"], w["height"], shift, w["gap"], bool(w["glyphs"]))
        used += w["width"]
        if used <= width:
            line.append(entry)
            used += w["gap"]
            continue
        if line:
            lines.append(line)
        if w["width"] < width:
            line, used = [entry], w["width"] + w["gap"]
            continue
        pieces, part, left = [], [], 0
        for i, g in enumerate(w["glyphs"]):
            last = i == len(w["glyphs"]) - 1
            if g["x"] + g["width"] - left > width and part:
                pieces.append(part)
                part, left = [], g["x"]
            part.append(g)
            if last:
                pieces.append(part)
        made = []
        for part in pieces:
            x, y = min(g["x"] for g in part), min(g["y"] for g in part)
            made.append((w["seq"], x, y, max(g["x"] + g["width"] for g in part) - x, max(g["y"] + g["height"] for g in part) - y, min(g["shift"] for g in part), 0, True))
        lines += [[p] for p in made[:-1]]
        line, used = [made[-1]], made[-1][3] + w["gap"]
    return lines + [line] if line else lines


def break_paragraphs(words: DataFrame, width: DataFrame) -> DataFrame:
    """The entries of each paragraph as lines at the page's ``width`` (page_id, new_width): a fold, one paragraph at a time."""

    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        out = []
        for n, line in enumerate(break_words(rows, rows[0]["new_width"])):
            out += [(key[0].as_py(), key[1].as_py(), n, *p) for p in line]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(_PIECE)], schema=_PIECE)

    return words.join(width, "page_id").groupBy("page_id", "paragraph").applyInArrow(run, PIECE)


def line_heights(pieces: DataFrame) -> DataFrame:
    """(page_id, paragraph, line, row, height, line_height, top): lines with something on them, numbered down the page.

    A line takes one and a half times the greater of its own height and the page's mean line height. top is the sum of those above.
    """
    lines = pieces.groupBy("page_id", "paragraph", "line").agg(F.max("height").alias("height"), F.min_by(F.col("y") + F.col("height"), "seq").alias("first_bottom")).where("height > 0")
    page = Window.partitionBy("page_id")
    lines = lines.withColumn("_mean", F.avg("height").over(page)).withColumn("line_height", (1.5 * F.greatest("height", "_mean")).cast("int")).drop("_mean")
    order = page.orderBy("paragraph", "line")
    above = F.coalesce(F.sum("line_height").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumns({"row": F.row_number().over(order) - 1, "top": above})


def scaled_pictures(pictures: DataFrame, width: DataFrame, zoom: float) -> DataFrame:
    """Pictures (page_id, picture, x, y, width, height) with s_width and s_height: scaled, and shrunk to the new width if as wide or wider."""
    rows = pictures.join(width, "page_id").withColumns({"_w": scale("width", zoom), "_h": scale("height", zoom)})
    factor = F.col("_w") / F.col("new_width").cast("double")
    wide = F.col("_w") >= F.col("new_width")
    return rows.withColumns({"s_width": F.when(wide, (F.col("_w") / factor).cast("int")).otherwise(F.col("_w")), "s_height": F.when(wide, (F.col("_h") / factor).cast("int")).otherwise(F.col("_h"))}).drop("_w", "_h")


def place_pictures(lines: DataFrame, pictures: DataFrame) -> DataFrame:
    """(page_id, row, picture): the line before which each picture goes.

    Pictures go down the page in order, one before a line at most: the first line after the previous picture's whose first word
    ends below the picture's top. Pictures below all lines are left out. A fold over a page's lines and pictures.
    """

    def run(key, table):
        rows = table.to_pylist()
        todo = sorted((r for r in rows if r["kind"] == 1), key=lambda r: (r["at"], r["id"]))
        out = []
        for line in sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["id"]):
            if todo and line["at"] > todo[0]["at"]:
                out.append((line["id"], todo.pop(0)["id"]))
        return pa.table({"page_id": pa.array([key[0].as_py()] * len(out), pa.int64()), "row": pa.array([o[0] for o in out], pa.int64()), "picture": pa.array([o[1] for o in out], pa.int64())})

    rows = lines.select("page_id", F.lit(0).alias("kind"), F.col("row").cast("long").alias("id"), F.col("first_bottom").cast("long").alias("at")).union(pictures.select("page_id", F.lit(1), F.col("picture").cast("long"), F.col("y").cast("long")))
    return rows.groupBy("page_id").applyInArrow(run, "page_id long, row long, picture long")


def page_geometry(lines: DataFrame, pictures: DataFrame, width: DataFrame, mean: DataFrame, zoom: float) -> DataFrame:
    """(page_id, margin, page_width, page_height) of the new page."""
    text = lines.groupBy("page_id").agg(F.sum("line_height").alias("_t"))
    pics = pictures.groupBy("page_id").agg(F.sum("s_height").alias("_p"), F.count("*").alias("_n"))
    rows = width.join(mean, "page_id").join(text, "page_id").join(pics, "page_id", "left").fillna(0, ["_p", "_n"])
    margin = F.floor(0.05 * zoom * F.col("new_width")).cast("int")
    height = F.floor(margin + F.col("_t") + F.col("_p") + F.col("mean") * (F.col("_n") + 1)).cast("int") + margin
    return rows.select("page_id", margin.alias("margin"), (F.col("new_width") + 2 * margin).cast("int").alias("page_width"), height.alias("page_height"))


def placements(glyphs: DataFrame, pictures: DataFrame, widths: DataFrame, *, factor: float, zoom: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where everything of a page goes at the new width: (words, pictures, pages).

    ``glyphs``: ordered glyphs; ``pictures``: (page_id, picture, x, y, width, height); ``widths``: (page_id, page_width) of the old
    page. words: (page_id, row, seq, x, y, width, height, left, top); pictures: (page_id, picture, left, top, s_width, s_height).
    """
    width = widths.select("page_id", (F.col("page_width") * F.lit(float(factor))).cast("int").alias("new_width"))
    pieces = materialise(break_paragraphs(entries(glyphs, zoom), width), "pieces")
    lines = materialise(line_heights(pieces), "lines")
    mean = glyphs.groupBy("page_id").agg(F.avg("height").alias("mean"))
    pics = scaled_pictures(pictures, width, zoom)
    pages = page_geometry(lines, pics, width, mean, zoom)
    at = place_pictures(lines, pics)
    put = at.join(pics, ["page_id", "picture"]).join(mean, "page_id").withColumn("_take", F.floor(F.col("mean") + F.col("s_height")).cast("int"))
    order = Window.partitionBy("page_id").orderBy("row")
    rows = lines.join(put.select("page_id", "row", "picture", "s_width", "s_height", "_take"), ["page_id", "row"], "left").join(pages, "page_id")
    before = F.coalesce(F.sum("_take").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_y", F.col("margin") + F.col("top") + before)
    shown = rows.where("picture is not null").select("page_id", "picture", F.floor((F.col("page_width") - F.col("s_width")) / 2).cast("int").alias("left"), F.col("_y").cast("int").alias("top"), "s_width", "s_height")
    base = rows.select("page_id", "paragraph", "line", "row", "margin", "line_height", (F.col("_y") + F.coalesce("_take", F.lit(0))).alias("_y"))
    words = pieces.join(base, ["page_id", "paragraph", "line"])
    along = Window.partitionBy("page_id", "row").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("margin") + F.coalesce(F.sum(F.col("width") + F.col("gap")).over(along), F.lit(0))
    top = F.col("_y") + F.floor(0.2 * F.col("line_height")) - F.col("height") - F.col("shift")
    words = words.withColumns({"left": left, "top": top}).where("real").select("page_id", "row", "seq", "x", "y", "width", "height", "left", "top")
    return words, shown, pages


def simple_flow(glyphs: DataFrame, page_width: int, *, indent: int = 30) -> DataFrame:
    """The older flow, glyph by glyph: (page_id, seq, line, left) of glyphs (page_id, seq, width, indented), margins of 7.5 per cent.

    An indented glyph begins a line and stands in; one that doesn't fit begins a line, and one wider than a line has its own.
    """
    margin = int(0.075 * page_width)
    room = page_width - 2 * margin

    def run(key, table):
        out, line, used = [], 0, 0
        for g in sorted(table.to_pylist(), key=lambda r: r["seq"]):
            if used and (g["indented"] or used + g["width"] > room):
                line, used = line + 1, 0
            if g["indented"]:
                used = indent
            out.append((g["seq"], line, margin + used))
            used += g["width"]
        return pa.table({"page_id": pa.array([key[0].as_py()] * len(out), pa.int64()), **{n: pa.array([o[i] for o in out], pa.int64()) for i, n in enumerate(("seq", "line", "left"))}})

    return glyphs.select("page_id", F.col("seq").cast("long").alias("seq"), F.col("width").cast("long").alias("width"), "indented").groupBy("page_id").applyInArrow(run, "page_id long, seq long, line long, left long")


def closed(image: np.ndarray) -> np.ndarray:
    """Dilation, then erosion, by three by three pixels; beyond the page's edge nothing is dilated and nothing eroded."""
    wide = np.pad(image, 1)
    grown = np.any([wide[1 + i : 1 + i + image.shape[0], 1 + j : 1 + j + image.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
    wide = np.pad(grown, 1, constant_values=True)
    return np.all([wide[1 + i : 1 + i + image.shape[0], 1 + j : 1 + j + image.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)


def component_boxes(image: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of the 8-connected components of a binary page."""
    edge = np.diff(np.pad(image.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    x1 = np.nonzero(edge == -1)[1] - 1
    rows = np.searchsorted(y, np.arange(image.shape[0] + 1))
    src, dst = list(range(len(y))), list(range(len(y)))
    for top in range(image.shape[0] - 1):
        i, j, ends = rows[top], rows[top + 1], (rows[top + 1], rows[top + 2])
        while i < ends[0] and j < ends[1]:
            if x0[j] <= x1[i] + 1 and x1[j] >= x0[i] - 1:
                src.append(int(i))
                dst.append(int(j))
            i, j = (i + 1, j) if x1[i] < x1[j] else (i, j + 1)
    ids, roots = union_find(src, dst)
    boxes: dict[int, list[int]] = {}
    for i, root in zip(ids, roots):
        box = boxes.setdefault(root, [int(x0[i]), int(y[i]), int(x1[i]), int(y[i])])
        box[:] = min(box[0], int(x0[i])), min(box[1], int(y[i])), max(box[2], int(x1[i])), max(box[3], int(y[i]))
    return [(a, b, c - a + 1, d - b + 1) for a, b, c, d in boxes.values()]


def xycut(image: np.ndarray, most_leaves: int = 20) -> list[dict]:
    """The cut tree of a binary page along its white columns and rows.

    The page is closed, components at least fifty times as high as wide are taken out, and white borders (with the last column and
    row) are trimmed. A first pass cuts at gaps whose ends are further apart than the components' mean height; the least
    of these distances less one is what a second pass, which builds the tree, asks of a gap. Both take the widest gap, the first of
    equals. Of a cut by columns the left part goes on by rows and the right part by columns; of a cut by rows the upper part by columns,
    the lower by rows; a part that can't be cut one way is tried the other way once. The right and lower parts begin with
    the gap's last line. Parts no higher than the mean height or a pixel wide are dropped. The first pass cuts by rows, the second by columns, only
    what is wider than half the page. Without a cut, or with more than ``most_leaves`` leaves, the page is one leaf.
    """
    height, width = image.shape
    page = [{"node_id": 0, "parent_id": -1, "side": "root", "x": 0, "y": 0, "w": width, "h": height, "leaf": True}]
    ink = closed(image)
    boxes = component_boxes(ink)
    for x, y, w, h in boxes:
        if h // w >= TALL_TIMES:
            ink[y : y + h, x : x + w] = False
    heights = [h for _, _, w, h in boxes if h // w < TALL_TIMES]
    if not heights or not ink.any():
        return page
    least = int(sum(heights) / len(heights))
    across, down = np.flatnonzero(ink.any(axis=0)), np.flatnonzero(ink.any(axis=1))
    root = (int(across[0]), int(down[0]), int(across[-1] - across[0]), int(down[-1] - down[0]))

    def widest_gap(box: tuple, axis: int, over: int) -> tuple[int, int] | None:
        x, y, w, h = box
        full = ink[y : y + h, x : x + w].any(axis=axis)
        ends = np.flatnonzero(np.diff(np.r_[True, full, True].astype(np.int8)))
        gaps = [(int(a), int(b) - 1) for a, b in zip(ends[::2], ends[1::2]) if b - 1 - a > over]
        return max(gaps, key=lambda g: (g[1] - g[0], -g[0]), default=None)

    def walk(over: int, narrow_axis: int) -> Iterator[tuple]:
        """(gap, [(parent, side, box)]) of every cut, with positions in the order of making as parents."""
        made, todo = 1, [(0, root, 0, 0)]
        while todo:
            node, box, axis, tried = todo.pop()
            if tried == 3 or not box[2] or not box[3]:
                continue
            gap = widest_gap(box, axis, over)
            if gap is None or (axis == narrow_axis and box[2] <= width // 2):
                todo.append((node, box, 1 - axis, tried + 1))
                continue
            x, y, w, h = box
            parts = ((x, y, gap[0], h), (x + gap[1], y, w - gap[1], h)) if axis == 0 else ((x, y, w, gap[0]), (x, y + gap[1], w, h - gap[1]))
            kept = [(node, side, p) for side, p in zip(("first", "second"), parts) if p[3] > least and p[2] > 1]
            yield gap, kept
            for n, (_, side, p) in enumerate(kept):
                todo.append((made + n, p, 1 - axis if side == "first" else axis, 1))
            made += len(kept)

    sizes = [b - a for (a, b), _ in walk(least, 1)]
    if not sizes:
        return page
    nodes = [dict(page[0], x=root[0], y=root[1], w=root[2], h=root[3])]
    for _, kept in walk(min(sizes) - 1, 0):
        for parent, side, (x, y, w, h) in kept:
            nodes[parent]["leaf"] = False
            nodes.append({"node_id": len(nodes), "parent_id": parent, "side": side, "x": x, "y": y, "w": w, "h": h, "leaf": True})
    return page if sum(n["leaf"] for n in nodes) > most_leaves else nodes


def cut_trees(runs: DataFrame, most_leaves: int = 20) -> DataFrame:
    """The cut tree of every page of runs; see ``xycut``."""
    types = pa.schema([("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("side", pa.string()), *((c, pa.int32()) for c in "xywh"), ("leaf", pa.bool_())])

    def run(key, table):
        y, a, b = (table.column(c).to_numpy() for c in ("y", "x0", "x1"))
        image = np.zeros((int(y.max()) + 1, int(b.max()) + 1), bool)
        for r, s, e in zip(y, a, b):
            image[r, s : e + 1] = True
        return pa.Table.from_pylist([{"page_id": key[0].as_py(), **n} for n in xycut(image, most_leaves)], schema=types)

    return runs.groupBy("page_id").applyInArrow(run, "page_id long, node_id int, parent_id int, side string, x int, y int, w int, h int, leaf boolean")

"""Lines of text: gaps, words, paragraphs, indents, spacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.graph import page_components
from foliant.operators.histograms import baseline
from foliant.operators.intervals import join_intervals, stab, touching_groups
from foliant.operators.rects import SIDES, bounding, knn, neighbors
from foliant.shared import materialise

LINE = ["page_id", "line_id"]


def _along(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("x", "y", "width", "height", "glyph_id")


def with_gaps(glyphs: DataFrame, keys: list[str] = LINE) -> DataFrame:
    """Glyphs with pos, their place along the line, and gap, to the one before, null where it isn't a word gap.

    A gap parts words if it is over half of the line's mean height.
    """
    step = F.col("x") - F.lag(F.col("x") + F.col("width")).over(_along(keys))
    rows = glyphs.withColumns({"pos": F.row_number().over(_along(keys)) - 1, "_gap": step, "_mean": F.avg("height").over(Window.partitionBy(*keys))})
    return rows.withColumn("gap", F.when(F.col("_gap") > 0.5 * F.col("_mean"), F.col("_gap"))).drop("_gap", "_mean")


def word_gaps(glyphs: DataFrame, keys: list[str] = LINE) -> DataFrame:
    """(keys, idx, gap): the gaps between words by the place of the glyph after them."""
    return with_gaps(glyphs, keys).where("gap is not null").select(*keys, F.col("pos").alias("idx"), "gap")


def split_words(glyphs: DataFrame, keys: list[str] = LINE) -> DataFrame:
    """Glyphs with word_id, from 0 along each line; a line without gaps is one word."""
    return with_gaps(glyphs, keys).withColumn("word_id", F.count("gap").over(_along(keys).rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def split_at(glyphs: DataFrame, gaps: DataFrame, keys: list[str] = LINE) -> DataFrame:
    """Glyphs with word_id where the places to split at are given (keys, idx)."""
    placed = glyphs.withColumn("pos", F.row_number().over(_along(keys)) - 1)
    marked = placed.join(gaps.select(*keys, F.col("idx").alias("pos"), F.lit(1).alias("_cut")).distinct(), [*keys, "pos"], "left")
    return marked.withColumn("word_id", F.count("_cut").over(_along(keys).rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_cut")


def word_boxes(glyphs: DataFrame, keys: list[str] = LINE) -> DataFrame:
    return bounding(split_words(glyphs, keys), [*keys, "word_id"])


def group_glyphs(glyphs: DataFrame, keys: list[str] = LINE) -> DataFrame:
    """(keys, glyph_id, x, y, width, height): the parts of letters joined into boxes by their x-ranges.

    Ranges that overlap by over a tenth of both become one; a box then holds every glyph that touches its range, so a glyph
    between two ranges is in both.
    """
    ranges = glyphs.select(*keys, F.col("glyph_id").alias("id"), F.col("x").alias("low"), (F.col("x") + F.col("width")).alias("high"))
    groups = join_intervals(ranges, keys)
    return bounding(touching_groups(glyphs, groups, keys), [*keys, "component"]).withColumnRenamed("component", "glyph_id")


def line_ranges(glyphs: DataFrame, k: int = 100) -> DataFrame:
    """(page_id, low, high): the y-ranges of lines, from chains of neighbours joined where their ranges overlap."""
    near = neighbors(glyphs, knn(glyphs, k))
    edges = near.select("page_id", F.col("id").alias("src"), F.coalesce("nb_id", "id").alias("dst"))
    chains = page_components(glyphs, edges, ["page_id"], "glyph_id", "chain")
    limits = glyphs.join(chains, ["page_id", "glyph_id"]).groupBy("page_id", F.col("chain").alias("id")).agg(F.min("y").alias("low"), F.max(F.col("y") + F.col("height")).alias("high"))
    return join_intervals(materialise(limits, "limits"), ["page_id"]).select("page_id", "low", "high")


def find_lines(glyphs: DataFrame, k: int = 100) -> DataFrame:
    """Glyphs with line_id, from 0 down the page: the range that holds a glyph's upper edge."""
    held = stab(glyphs.select("page_id", "glyph_id", *SIDES), line_ranges(glyphs, k), ["page_id"], "y")
    return held.withColumn("line_id", F.dense_rank().over(Window.partitionBy("page_id").orderBy("low", "high")) - 1).drop("low", "high")


def ordered_glyphs(glyphs: DataFrame, k: int = 100) -> DataFrame:
    """(page_id, line_id, word_id, pos, x, y, width, height, shift, lower): a page's glyphs in reading order with their baselines.

    Each step reads its input several times, so the glyphs, the lines and the boxes are written once in between.
    """
    found = materialise(find_lines(materialise(glyphs.select("page_id", "glyph_id", *SIDES), "glyphs"), k), "lines")
    boxes = materialise(group_glyphs(found), "boxes")
    lower = baseline(boxes, LINE)
    words = split_words(boxes).join(lower, LINE)
    return words.select(*LINE, "word_id", "pos", *SIDES, (F.col("lower").cast("int") - (F.col("y") + F.col("height"))).alias("shift"), "lower")


def paragraphs(lefts: DataFrame) -> DataFrame:
    """Lines (page_id, line_id, left_x, mean) with starts, whether they begin a paragraph by standing in from both neighbours, and
    paragraph, counted from 0; a page's first line begins one in any case. A single line is one paragraph."""
    order = Window.partitionBy("page_id").orderBy("line_id")
    above, below = F.lag("left_x").over(order), F.lead("left_x").over(order)
    in_from = lambda other: F.coalesce(F.col("left_x") - other > F.col("mean"), F.lit(True))
    rows = lefts.withColumn("starts", in_from(above) & in_from(below) & (above.isNotNull() | below.isNotNull()))
    rows = rows.withColumn("_first", F.row_number().over(order) == 1)
    return rows.withColumn("paragraph", (F.sum(F.when(F.col("starts") | F.col("_first"), 1).otherwise(0)).over(order) - 1).cast("int")).drop("_first")


def left_indents(lefts: DataFrame) -> DataFrame:
    """Lines (page_id, line_id, left_x, page_width) with indent, the least left edge of their block.

    A block ends where a left edge is over a sixth of the page's width away from the block's least so far, which is a fold: one
    ``aggregate`` over the page's lines in order, in the JVM.
    """
    item = F.struct("line_id", "left_x", "page_width")
    pages = lefts.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("ls"))
    start = F.struct(F.lit(0).alias("block"), F.lit(None).cast("int").alias("least"), F.array().cast("array<struct<line_id:int,block:int,left_x:int>>").alias("out"))

    def step(acc, line):
        new = acc["least"].isNotNull() & (F.abs(line["left_x"] - acc["least"]) > line["page_width"] / 6.0)
        block = acc["block"] + F.when(new, 1).otherwise(0)
        least = F.when(acc["least"].isNull() | new, line["left_x"]).otherwise(F.least(acc["least"], line["left_x"]))
        row = F.struct(line["line_id"].cast("int").alias("line_id"), block.alias("block"), line["left_x"].cast("int").alias("left_x"))
        return F.struct(block.alias("block"), least.cast("int").alias("least"), F.concat(acc["out"], F.array(row)).alias("out"))

    rows = pages.select("page_id", F.explode(F.aggregate("ls", start, step)["out"]).alias("o")).select("page_id", "o.*")
    return rows.select("page_id", "line_id", "left_x", F.min("left_x").over(Window.partitionBy("page_id", "block")).alias("indent"))


def line_spacing(lines: DataFrame) -> DataFrame:
    """Lines (page_id, line_id, height) with block and block_height.

    A block ends before a line that is over twice or under half as high. Its height is the greatest of its lines but the last, then
    with each line's own: the last line of a block of several counts for itself only.
    """
    order = Window.partitionBy("page_id").orderBy("line_id")
    ratio = F.col("height").cast("double") / F.lag("height").over(order)
    rows = lines.withColumn("_cut", F.when((ratio > 2) | (ratio < 0.5), 1).otherwise(0)).withColumn("block", F.sum("_cut").over(order).cast("int")).drop("_cut")
    block = Window.partitionBy("page_id", "block")
    last = F.lead("line_id").over(block.orderBy("line_id")).isNull()
    rows = rows.withColumn("_head", F.when(~last, F.col("height")))
    return rows.withColumn("block_height", F.greatest(F.max("_head").over(block), F.col("height"))).drop("_head")


def word_spacing(words: DataFrame, last: float | None = None) -> DataFrame:
    """Word boxes with the gap to the next word of their line; the last one has ``last``, or what the page leaves of five pixels."""
    order = Window.partitionBy(*LINE).orderBy("x", "word_id")
    after = F.lead("x").over(order) - (F.col("x") + F.col("width"))
    rest = F.lit(last) if last is not None else F.least(F.lit(5), F.col("page_width") - (F.col("x") + F.col("width")))
    return words.withColumn("gap", F.coalesce(after, rest))


def line_flags(words: DataFrame, share: float = 0.02) -> DataFrame:
    """Word boxes (with indent and page_width) with indented, for first ones that stand in by over ``share`` of the page, and is_last."""
    order = Window.partitionBy(*LINE).orderBy("x", "word_id")
    first, last = F.lag("x").over(order).isNull(), F.lead("x").over(order).isNull()
    return words.withColumns({"indented": first & (F.col("x") - F.col("indent") > share * F.col("page_width")), "is_last": last})

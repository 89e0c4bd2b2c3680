"""Schemas of the tables that operators take and give. ``page_id`` is the unit of work and the partition key throughout."""

from __future__ import annotations

RECT = "x int, y int, width int, height int"
GLYPH = f"struct<{RECT.replace(' int', ': int')}, shift: int>"
GLYPHS = f"page_id long, glyph_id int, {RECT}, shift int"
COMPONENTS = f"page_id long, comp_id int, {RECT}, area long"
RANGES = "page_id long, id int, low int, high int"
KNN = "page_id long, id int, rank int, nb_id int"
GAPS = "page_id long, line_id int, idx int, gap int"
WORDS = f"page_id long, line_id int, word_id int, glyph_id int, {RECT}"
RUNS = "page_id long, y int, x0 int, x1 int"
GRAY = "page_id long, v int, cnt long"
LINE_LIMITS = "page_id long, line_id int, upper int, upper_baseline int, lower_baseline int, lower int"
CUT_TREE = "page_id long, node_id int, parent_id int, side string, x int, y int, w int, h int, leaf boolean"

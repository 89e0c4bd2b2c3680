"""Connected components of an edge table that may be larger than any machine."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.shared import materialise, merging, remove

#: With more edges than this no side of a join is broadcast.
BROADCAST_EDGES = 100_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(sided: DataFrame, keep: str, many: bool) -> DataFrame:
    """Link what ``keep`` admits around each u to the least vertex around u. The minimum is combined before the shuffle."""
    low = sided.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = sided.join(merging(low) if many else low, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near, low


def large_star(edges: DataFrame, many: bool = False) -> DataFrame:
    near, _ = _star(_both(edges), "v > u", many)
    return near.where("u <> v").distinct()


def small_star(edges: DataFrame, many: bool = False) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    near, low = _star(down, "v <> m", many)
    return near.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """Components by alternating large-star and small-star rounds.

    ``edges``: columns u and v, both long; direction, repeats and self-edges don't matter, rows with a null are left out.
    Returns (vertex, component) for every vertex that has an edge to another one; component is the least vertex reachable.
    The number of rounds is logarithmic; each round is materialised in the shared folder, so lost executors cost one round.
    """
    now = materialise(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark, many = None, now.count() > BROADCAST_EDGES
    while True:
        once = materialise(small_star(large_star(now, many), many), "stars")
        seen = once.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        remove(now)
        now = once
        if seen == mark or not seen["n"]:
            break
        mark = seen
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def page_components(vertices: DataFrame, edges: DataFrame, keys: list[str], vertex: str = "id", label: str = "component") -> DataFrame:
    """(keys, vertex, label) with the least vertex of each component, for graphs that don't cross groups of ``keys``.

    Every vertex is kept, alone if it has no edge. One union-find a group; a group is a page or a line of one, so it is small.
    """
    loops = vertices.select(*keys, F.col(vertex).cast("long").alias("src"), F.col(vertex).cast("long").alias("dst"))
    both = loops.union(edges.select(*keys, F.col("src").cast("long"), F.col("dst").cast("long")))
    head = ", ".join(f"`{k}` {vertices.schema[k].dataType.simpleString()}" for k in keys)

    def solve(key, table):
        src, dst = table.column("src").to_pylist(), table.column("dst").to_pylist()
        ids, labels = union_find(src, dst)
        columns = [pa.array([k.as_py()] * len(ids), k.type) for k in key]
        return pa.Table.from_arrays([*columns, pa.array(ids, pa.int64()), pa.array(labels, pa.int64())], names=[*keys, vertex, label])

    return both.groupBy(*keys).applyInArrow(solve, f"{head}, `{vertex}` long, `{label}` long")


def union_find(src: list[int], dst: list[int]) -> tuple[list[int], list[int]]:
    up: dict[int, int] = {}

    def root(v: int) -> int:
        path = []
        while (p := up.setdefault(v, v)) != v:
            path.append(v)
            v = p
        for w in path:
            up[w] = v
        return v

    for a, b in zip(src, dst):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    ids = list(up)
    return ids, [root(v) for v in ids]

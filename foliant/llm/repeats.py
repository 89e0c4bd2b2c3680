"""Removal of repeated byte strings: anchors find where repeats can lie, suffix arrays decide where they do.

Every window of ``length`` bytes is handed to the least-hashed gram of ``gram`` bytes in it, its anchor. Equal windows have equal
anchors at equal offsets, so a window can only repeat one that has the same anchor. Consecutive windows with one anchor are a
run; the bytes it spans are its context. An anchor seen once has no repeats; contexts seen twice repeat throughout. What is
left, the different contexts of one anchor, is cut into cells of a few offsets. The windows of a cell share a core; in
cells whose core occurs again, the core becomes one symbol, and a suffix array of what surrounds it tells which
windows occur twice. An anchor with very many different contexts is decided by counting its windows instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.batches import byte_slices
from foliant.llm.suffixes import suffix_array
from foliant.shared import materialise

LENGTH, GRAM, CELL, MOST_CONTEXTS, UNIT = 200, 48, 16, 4000, 8_000_000
_BASE = 0x9E3779B97F4A7C15
_RNG = np.random.default_rng(11)
_BYTES = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_POS = np.uint64((1 << 24) - 1)


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if cache.get("n", 0) < n:
        n = max(n, 1 << 21)
        up, down = np.full(n, np.uint64(_BASE)), np.full(n, np.uint64(pow(_BASE, -1, 2**64)))
        up[0] = down[0] = 1
        cache.update(n=n, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return cache["up"], cache["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def runs(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(unit, first window, last window, anchor hash, context hash, anchor offset) of all runs in consecutive units of ``sizes``.

    Anchors are compared by 40 bits of their hash, then by position, so that equal windows always choose alike.
    """
    n, w = len(data), length - gram + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return (empty,) * 6
    up, down = _powers(n + 1)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(t[data] * up[:n], dtype=np.uint64)]) for t in _BYTES]
    hashes = _mix((sums[0][gram:] - sums[0][: n - gram + 1]) * down[: n - gram + 1])
    keys = (hashes & ~_POS) | np.arange(len(hashes), dtype=np.uint64)
    pad = -len(keys) % w
    blocks = np.concatenate([keys, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    anchor = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & _POS).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begins, windows)
    if not len(start):
        return (empty,) * 6
    unit, own = np.repeat(np.arange(len(sizes)), windows), anchor[start]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (unit[1:] != unit[:-1])])
    first, last = start[new], start[np.r_[new[1:], len(start)] - 1]
    offset = own[new] - first
    context = (sums[1][last + length] - sums[1][first]) * down[first]
    context = _mix(context + _mix((last - first).astype(np.uint64) * np.uint64(4096) + offset.astype(np.uint64) + np.uint64(1)))
    unit = unit[new]
    return unit, first - begins[unit], last - begins[unit], hashes[own[new]].view(np.int64), context.view(np.int64), offset


def text_runs(raws: list[bytes], length: int, gram: int, unit: int = UNIT) -> tuple[np.ndarray, ...]:
    """``runs`` of whole texts; one of over ``unit`` bytes is cut into units that overlap by a window, so none is lost."""
    parts, owner, base = [], [], []
    for i, raw in enumerate(raws):
        for at in range(0, max(1, len(raw) - length + 1), unit):
            parts.append(raw[at : at + unit + length - 1])
            owner.append(i)
            base.append(at)
    out, group, size = [], 0, 0
    for k in range(len(parts) + 1):
        if k == len(parts) or size + len(parts[k]) > unit and k > group:
            own = parts[group:k]
            u, a, b, h, c, o = runs(np.frombuffer(b"".join(own), np.uint8), np.array([len(p) for p in own], np.int64), length, gram)
            at = np.array(base[group:k], np.int64)[u]
            out.append((np.array(owner[group:k], np.int64)[u], a + at, b + at, h, c, o))
            group, size = k, 0
        size += len(parts[k]) if k < len(parts) else 0
    return tuple(np.concatenate(x) for x in zip(*out))


def repeated_windows(contexts: list[tuple[bytes, int, bool]], length: int, cell: int = CELL) -> list[list[tuple[int, int]]]:
    """For different contexts (bytes, anchor offset, whether to answer) of one anchor: inclusive runs of windows that another has too."""
    cells: dict[tuple[int, bytes], list[tuple[int, int, int, bytes, bytes]]] = {}
    for i, (raw, anchor, _) in enumerate(contexts):
        nearest, farthest = anchor - (len(raw) - length), anchor
        for j in range(nearest // cell, farthest // cell + 1):
            low, high = max(nearest, j * cell), min(farthest, j * cell + cell - 1)
            begin, end = anchor - j * cell, anchor + length - j * cell - cell + 1
            cells.setdefault((j, raw[begin:end]), []).append((i, low, high, raw[anchor - high : begin], raw[end : anchor - low + length]))
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    text: list[int] = []
    owners: list[tuple[int, int] | None] = []
    fresh = 256
    for (j, _), members in cells.items():
        if len(members) < 2:
            continue
        alike: dict[tuple[bytes, bytes], list[tuple[int, int, int]]] = {}
        for i, low, high, left, right in members:
            alike.setdefault((left, right), []).append((i, low, high))
        for (left, right), same in alike.items():
            if len(same) > 1:
                for i, low, high in same:
                    found[i].append((contexts[i][1] - high, contexts[i][1] - low))
        if len(alike) < 2:
            continue
        core, fresh = fresh, fresh + 1
        for (left, right), same in alike.items():
            ask = contexts[same[0][0]][2] and len(same) == 1
            anchor = contexts[same[0][0]][1]
            lead = len(left)
            windows = same[0][2] - same[0][1] + 1
            text += [*left, core, *right, fresh]
            owners += [(same[0][0], anchor - same[0][2] + t) if ask else None for t in range(windows)] + [()] * (lead + 2 + len(right) - windows)
            fresh += 1
    if text:
        ranks = suffix_array(text)
        ranks = [s for s in ranks if owners[s] != ()]
        for a, b in zip(ranks, ranks[1:]):
            if text[a : a + cell] == text[b : b + cell]:
                for s in (a, b):
                    if owners[s]:
                        i, at = owners[s]
                        found[i].append((at, at))
    return [_merged(x) for x in found]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept(raw: bytes, windows: list[tuple[int, int]], length: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left) when all windows that start in the given inclusive runs go."""
    out, removed, n, at = [], 0, 0, 0
    for a, b in _joined(windows, length):
        out.append(raw[at:a])
        removed, n, at = removed + b - a, n + 1, b
    out.append(raw[at:])
    return removed, n, b"".join(out)


def _joined(windows: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int]]:
    begin = end = -1
    for a, b in sorted(windows):
        if a > end:
            if end >= 0:
                yield begin, end
            begin = a
        end = max(end, b + length)
    if end >= 0:
        yield begin, end


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1][column] != row[column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: (id, n_bytes, n_removed, n_spans, kept_sha256), and ``kept`` (binary) with ``with_text``.

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else in the texts as given, the same text
    included; strings don't cross texts. A null or empty text has nothing to remove; one under ``length`` bytes neither.
    Repeated rows are texts of their own and repeat each other. A row is known by its id and the hash of its text; ids may be null.
    Texts of any length are worked on in bounded units. An empty table gives no rows; further columns aren't read.

    What is shuffled: the anchors (about 1.3 per 100 bytes), and the compressed texts, for contexts and for the result.
    Anchors and contexts are counted before they meet, so thousands of copies are one row a task.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw")).withColumn("t", F.xxhash64("raw"))

    def anchors(batches):
        for part in byte_slices(batches, "raw"):
            owner, a, b, h, c, o = text_runs(part.column("raw").to_pylist(), length, gram, 1_000_000)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), part.column("id").take(at), part.column("t").take(at), pa.array(a << 17 | (b - a) << 9 | o)], ["h", "c", "id", "t", "span"])

    if length - gram >= 256:
        raise ValueError("a window holds at most 255 grams besides its first")
    every = source.mapInArrow(anchors, f"h long, c long, id {kind}, t long, span long")
    twice = every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    some = materialise(every.join(twice, "h"), "anchors")
    counted = materialise(some.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "t", "span")).alias("at")), "contexts")
    per = counted.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("rarest"))
    open_ = counted.join(per.where("kinds > 1 and rarest = 1"), "h").select("h", "n", "kinds", "at.*")
    same = some.join(counted.where("n > 1").select("h", "c"), ["h", "c"]).select("id", "t", F.shiftright("span", 17).alias("a"), F.shiftright("span", 9).bitwiseAND(F.lit(255)).alias("extra"))
    same = same.select("id", "t", "a", (F.col("a") + F.col("extra")).alias("b"))

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for part in byte_slices(batches, "raw"):
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("t"), pa.array([pack.compress(x) for x in part.column("raw").to_pylist()], pa.binary())], ["id", "t", "z"])

    packed = source.mapInArrow(squeeze, f"id {kind}, t long, z binary")
    asked = open_.groupBy("id", "t").agg(F.collect_list(F.struct("h", "n", "kinds", "span")).alias("asked")).withColumnsRenamed({"id": "aid", "t": "at"})
    fetched = packed.join(asked, packed["id"].eqNullSafe(asked["aid"]) & (packed["t"] == asked["at"])).select("id", "t", "z", "asked")

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for part in byte_slices(batches, "z"):
            rows = {k: [] for k in ("h", "n", "kinds", "row", "a", "anchor", "raw")}
            for i, (z, asks) in enumerate(zip(part.column("z").to_pylist(), part.column("asked").to_pylist())):
                raw = unpack.decompress(z)
                for x in asks:
                    a, extra = x["span"] >> 17, x["span"] >> 9 & 255
                    for k, v in zip(rows, (x["h"], x["n"], x["kinds"], i, a, x["span"] & 511, raw[a : a + extra + length])):
                        rows[k].append(v)
            at = pa.array(rows["row"], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows["h"], pa.int64()), pa.array(rows["n"], pa.int64()), pa.array(rows["kinds"], pa.int64()), part.column("id").take(at), part.column("t").take(at), pa.array(rows["a"], pa.int64()), pa.array(rows["anchor"], pa.int32()), pa.array(rows["raw"], pa.binary())], ["h", "n", "kinds", "id", "t", "a", "anchor", "raw"])

    contexts = materialise(fetched.mapInArrow(cut, f"h long, n long, kinds long, id {kind}, t long, a long, anchor int, raw binary"), "cuts")

    def decide(batches):
        for rows in _groups(batches, "h"):
            out = []
            for r, spans in zip(rows, repeated_windows([(r["raw"], r["anchor"], r["n"] == 1) for r in rows], length)):
                if r["n"] == 1:
                    out += [(r["id"], r["t"], r["a"] + a, r["a"] + b) for a, b in spans]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (id_type, pa.int64(), pa.int64(), pa.int64()))], ["id", "t", "a", "b"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    found_type = f"id {kind}, t long, a long, b long"
    decided = contexts.where(F.col("kinds") <= most_contexts).repartition("h").sortWithinPartitions("h").mapInArrow(decide, found_type)

    def windows(batches):
        for part in byte_slices(batches, "raw"):
            row, at, low, high = [], [], [], []
            for i, (raw, a) in enumerate(zip(part.column("raw").to_pylist(), part.column("a").to_pylist())):
                for k in range(len(raw) - length + 1):
                    digest = xxhash.xxh3_128_intdigest(raw[k : k + length])
                    row.append(i)
                    at.append(a + k)
                    low.append((digest & (2**64 - 1)) - 2**63)
                    high.append((digest >> 64) - 2**63)
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("t").take(rows), part.column("n").take(rows), pa.array(at, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["id", "t", "n", "a", "low", "high"])

    each = contexts.where(F.col("kinds") > most_contexts).mapInArrow(windows, f"id {kind}, t long, n long, a long, low long, high long")
    often = each.groupBy("low", "high").agg(F.count("*").alias("times")).where("times > 1").select("low", "high")
    counted_out = each.where("n = 1").join(often, ["low", "high"]).select("id", "t", "a", F.col("a").alias("b"))
    spans = same.union(decided).union(counted_out)
    spans = spans.groupBy("id", "t").agg(F.collect_set(F.struct("a", "b")).alias("spans")).withColumnsRenamed({"id": "sid", "t": "st"})
    joined = packed.join(spans, packed["id"].eqNullSafe(spans["sid"]) & (packed["t"] == spans["st"]), "left").select("id", "z", "spans")

    def finish(batches):
        unpack = zstandard.ZstdDecompressor()
        for part in byte_slices(batches, "z"):
            out = []
            for z, s in zip(part.column("z").to_pylist(), part.column("spans").to_pylist()):
                raw = unpack.decompress(z)
                removed, n, left = kept(raw, [(x["a"], x["b"]) for x in s or []], length)
                out.append((len(raw), removed, n, hashlib.sha256(left).hexdigest(), left))
            columns = [part.column("id"), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(columns if with_text else columns[:-1], names if with_text else names[:-1])

    done = joined.mapInArrow(finish, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    return done

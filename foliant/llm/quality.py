"""Document quality by attention over passages: multiple-instance learning with document labels only."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.batches import by_text, whole_rows

PASSAGE_BYTES, SAMPLE_ROWS, SAMPLE_BYTES, THRESHOLD, HIDDEN, GATES, EPOCHS = 512, 4000, 48_000_000, 0.7, 16, 8, 40
UNIT_BYTES = 512 * PASSAGE_BYTES
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_FINE = np.full(256, 6, np.int64)
_COARSE = np.full(256, 5, np.int64)
for _b in range(256):
    _c = chr(_b)
    _FINE[_b] = 0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 3 if _b == 32 else 4 if _b == 10 else 5 if _b >= 128 else 7 + _PUNCT.index(_b) if _b in _PUNCT else 6
    _COARSE[_b] = [0, 1, 2, 3, 4, 0, 5][_FINE[_b]] if _FINE[_b] < 7 else 6
_N_FINE, _N_COARSE, _N_PAIRS = 7 + len(_PUNCT), 7, 64
WIDTH = _N_FINE + _N_COARSE**2 + _N_PAIRS + 2


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def passage_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, passages per text). Passages are consecutive and cover the whole text; an empty text is one.

    Passages don't depend on each other, so they are worked on ``UNIT_BYTES`` at a time, whatever the texts' sizes.
    """
    parts, held, out, per = [], 0, [], []
    for text in texts:
        raw = text.encode()
        per.append(max(1, -(-len(raw) // PASSAGE_BYTES)))
        for at in range(0, max(1, len(raw)), UNIT_BYTES):
            parts.append(raw[at : at + UNIT_BYTES])
            held += len(parts[-1])
            if held >= UNIT_BYTES:
                out.append(_features(parts))
                parts, held = [], 0
    if parts:
        out.append(_features(parts))
    return np.concatenate([*out, np.zeros((0, WIDTH), np.float32)]), np.array(per, np.int64)


def _features(raws: list[bytes]) -> np.ndarray:
    """Features of the passages of all ``raws``, an empty one being one passage."""
    sizes = np.array([len(r) for r in raws], np.int64)
    per = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    total, data = int(per.sum()), np.frombuffer(b"".join(raws), np.uint8)
    within = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passage = within // PASSAGE_BYTES + np.repeat(np.cumsum(per) - per, sizes)
    n = np.maximum(np.bincount(passage, minlength=total), 1)[:, None]

    def share(code: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt(np.bincount(at * k + code, minlength=total * k).reshape(total, k) / n)

    fine = share(_FINE[data], passage, _N_FINE)
    if len(data) > 1:
        same = passage[1:] == passage[:-1]
        a, b, at = data[:-1][same], data[1:][same], passage[:-1][same]
        coarse = share(_COARSE[a] * _N_COARSE + _COARSE[b], at, _N_COARSE**2)
        pairs = share((a.astype(np.int64) * 31 + b * 17) % _N_PAIRS, at, _N_PAIRS)
    else:
        coarse, pairs = np.zeros((total, _N_COARSE**2)), np.zeros((total, _N_PAIRS))
    rest = np.zeros((total, 2))
    k = 0
    for raw in raws:
        for i in range(0, max(1, len(raw)), PASSAGE_BYTES):
            part = raw[i : i + PASSAGE_BYTES]
            rest[k] = len(zlib.compress(part, 1)) / (len(part) + 16), len(part) / PASSAGE_BYTES
            k += 1
    return np.concatenate([fine, coarse, pairs, rest], 1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    """Encoder, gated attention and a linear head. ``weights``: W, b, V, U, w, c, d after ``mean`` and ``scale``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def forward(self, x: np.ndarray, per: np.ndarray) -> tuple:
        W, b, V, U, w, c, d = self.weights
        x = (x - self.mean) / self.scale
        begin = np.cumsum(per) - per
        e = np.tanh(x @ W + b)
        t, g = np.tanh(e @ V), _sigmoid(e @ U)
        s = (t * g) @ w
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, begin), per))
        a /= np.repeat(np.add.reduceat(a, begin), per)
        z = np.add.reduceat(e * a[:, None], begin, axis=0)
        return x, begin, e, t, g, a, z, _sigmoid(z @ c + d)

    def score(self, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        return self.forward(x, per)[-1]

    def gradient(self, x: np.ndarray, per: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        W, b, V, U, w, c, d = self.weights
        x, begin, e, t, g, a, z, y = self.forward(x, per)
        dy = (y - target) / len(target)
        dz = np.repeat(np.outer(dy, c), per, 0)
        da = (e * dz).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, begin), per))
        dt, dg = np.outer(ds, w) * g * (1 - t * t), np.outer(ds, w) * t * g * (1 - g)
        de = (a[:, None] * dz + dt @ V.T + dg @ U.T) * (1 - e * e)
        return [x.T @ de, de.sum(0), e.T @ dt, e.T @ dg, (t * g).T @ ds, z.T @ dy, np.array([dy.sum()])]


def train(bags: list[np.ndarray], labels: np.ndarray, *, epochs: int = EPOCHS, seed: int = 7) -> AttentionModel:
    """Adam on the cross-entropy of document labels. With labels of one class only, or none, the score is constant."""
    rng = np.random.default_rng(seed)
    everything = np.concatenate([*bags, np.zeros((1 if not bags else 0, WIDTH), np.float32)])
    mean, scale = everything.mean(0), everything.std(0) + 0.02
    shapes = [(WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, GATES), (HIDDEN, GATES), (GATES,), (HIDDEN,), (1,)]
    weights = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or s != (1,) else np.zeros(s) for s in shapes]
    weights[1] = np.zeros(HIDDEN)
    model = AttentionModel(mean, scale, weights)
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        model.weights = [np.zeros(s) for s in shapes]
        model.weights[-1] = np.array([np.log((share + 1e-3) / (1 - share + 1e-3))])
        return model
    m, v, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
    per = np.array([len(b) for b in bags])
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for i in range(0, len(order), 64):
            some = order[i : i + 64]
            grads = model.gradient(np.concatenate([bags[j] for j in some]), per[some], labels[some])
            step += 1
            for k, grad in enumerate(grads):
                grad = grad + 1e-4 * model.weights[k] * (k != 6)
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                model.weights[k] = model.weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> AttentionModel:
    """Train on at most ``sample_rows`` labelled documents of at most ``sample_bytes`` bytes together, those with the least hash of their ids;
    held-out ids, null labels and null ids are left out, and so is a text that would exceed the bytes.

    An id with several labels takes their rounded mean. Whole texts of the sampled documents are used; of rows repeated with id
    and text, one. What goes to the driver is the sample only, whatever the table holds: first its ids and sizes, then its
    features, some 616 bytes a passage of ``PASSAGE_BYTES``.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("labelled")).agg(F.round(F.avg(label_col)).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64("labelled"), "labelled").limit(sample_rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("key"), text.alias("t"), F.xxhash64(text).alias("h")).join(F.broadcast(some), F.col("key") == F.col("labelled"))
    sizes = rows.groupBy("labelled", "h").agg(F.min(F.octet_length("t")).alias("n")).orderBy(F.xxhash64("labelled"), "labelled", "h").limit(sample_rows).collect()
    chosen, left = [], sample_bytes
    for r in sizes:
        if r["n"] <= left:
            chosen.append((r["labelled"], r["h"]))
            left -= r["n"]
    picked = docs.sparkSession.createDataFrame(chosen, f"pick {docs.schema[id_col].dataType.simpleString()}, pick_h long")
    rows = rows.join(F.broadcast(picked), (F.col("labelled") == F.col("pick")) & (F.col("h") == F.col("pick_h"))).dropDuplicates(["labelled", "h"])

    def work(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        x, per = passage_features(texts)
        ends = np.cumsum(per)
        return pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array([x[e - p : e].tobytes() for e, p in zip(ends, per)], pa.binary())], ["id", "y", "x"])

    found = sorted(by_text(rows, {"id": F.col("labelled").cast("string"), "y": "y"}, "t", work, "id string, y int, x binary").collect())
    return train([np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in found], np.array([r["y"] for r in found], float))


def score(docs: DataFrame, model: AttentionModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) of every row; a null text scores as an empty one. Repeated rows score alike; further columns aren't read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        y = model.score(*passage_features(texts)).astype(np.float64)
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(y), pa.array((y >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return by_text(docs, {"id": id_col}, text_col, work, f"`{id_col}` {kind}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row, by a model fitted on ``labels``; see ``fit`` and ``score``."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample_rows=sample_rows)
    return score(docs, model, id_col=id_col, text_col=text_col, threshold=threshold).select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: AttentionModel, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``threshold``.

    A null text scores as an empty one; repeated rows score alike; an empty table stays empty; columns may have any names.
    """

    def work(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return part.filter(pa.array(model.score(*passage_features(texts)) >= threshold))

    return whole_rows(docs, text_col, work)

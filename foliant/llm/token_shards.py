"""Token ids in training order: binary shards of fixed stride in which every sequence has a slot by a keyed permutation."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.batches import text_slices
from foliant.llm.tokens import byte_bpe_ids
from foliant.shared import materialise, remove

LENGTH, SHARD_SEQUENCES, ROUNDS, END_ID = 2048, 16_384, 6, 50_256
#: Sequences compressed as one block before numbering, and sorted by shard at a time after it.
TOGETHER, SORTED, LEVEL = 32, 256, 6


def _round_key(key: int, r: int) -> np.uint64:
    return np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(index: np.ndarray, n: int, key: int, *, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1: a balanced Feistel network on the next even number of bits, walked until it is below n."""
    half = np.uint64(max(1, ((max(1, n - 1)).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in order:
            if inverse:
                left, right = right ^ (_mix(left + _round_key(key, r)) & mask), left
            else:
                left, right = right, left ^ (_mix(right + _round_key(key, r)) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """(local, ids, n_tokens, first_doc, docs): each partition's documents in order, each followed by ``end_id``, cut every ``length`` ids.

    A row holds up to ``TOGETHER`` sequences from number ``local`` on, filled up with ``end_id`` and compressed as one block, and for each
    of them its tokens, the id of the document that it begins in and how many documents it touches. ids are little-endian, of two bytes.
    """
    types = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["local", "ids", "n_tokens", "first_doc", "docs"]

    def run(batches):
        pack = zstandard.ZstdCompressor(level=LEVEL)
        held, owners, local = np.zeros(0, "<u2"), deque(), 0
        done: list[tuple] = []

        def take(ids: np.ndarray) -> None:
            first, n, need = owners[0][0], 0, len(ids)
            while need:
                d, left = owners[0]
                n += 1
                if left <= need:
                    owners.popleft()
                    need -= left
                else:
                    owners[0] = (d, left - need)
                    need = 0
            done.append((ids, len(ids), first, n))

        def flush() -> pa.RecordBatch:
            nonlocal local
            raw = b"".join(padded(ids, length, end_id).tobytes() for ids, *_ in done)
            row = (local, pack.compress(raw), [x[1] for x in done], [x[2] for x in done], [x[3] for x in done])
            local += len(done)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types)], names)

        for part, texts in text_slices(batches, 1_000_000):
            arrays = [np.array([*byte_bpe_ids(t, path), end_id], "<u2") for t in texts]
            owners.extend((d, len(a)) for d, a in zip(part.column("id").to_pylist(), arrays))
            stream = np.concatenate([held, *arrays])
            for i in range(0, len(stream) - length + 1, length):
                take(stream[i : i + length])
                if len(done) == TOGETHER:
                    yield flush()
            held = stream[len(stream) - len(stream) % length :]
        if len(held):
            take(held)
        if done:
            yield flush()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("n", F.coalesce(F.length("text"), F.lit(0)))
    return source.mapInArrow(run, "local long, ids binary, n_tokens array<int>, first_doc array<long>, docs array<int>")


def padded(ids: np.ndarray, length: int, end_id: int) -> np.ndarray:
    return np.concatenate([ids, np.full(length - len(ids), end_id, "<u2")])


def write_shards(docs: DataFrame, root: str, *, key: int = 1, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write all documents' ids to binary shards under ``root`` and return one row a sequence:
    (slot, shard, byte_offset, n_tokens, first_doc, docs, ids_crc32), where the crc is that of the sequence's bytes in its file.

    Slot s is at byte ``(s % shard_sequences) * 2 * length`` of ``shard-<s // shard_sequences>.bin``, so any slot is found without an index,
    and reading on from a slot is sequential. The slots are a permutation of all sequences under ``key``. The sequences are
    written once before they are numbered, so numbers don't change when a task is repeated; a shard, one task's partition, is put
    together in memory, written under a name of the attempt and renamed when whole. A null or empty text is the one id ``end_id``;
    ids may repeat or be null; an empty table writes nothing; further columns aren't read.
    """
    spark, stride = docs.sparkSession, 2 * length
    cut = materialise(token_sequences(docs, id_col=id_col, text_col=text_col, length=length, end_id=end_id, path=path).withColumn("part", F.spark_partition_id()), "sequences")
    sizes = sorted((r["part"], r["n"]) for r in cut.groupBy("part").agg(F.sum(F.size("n_tokens")).alias("n")).collect())
    total = sum(n for _, n in sizes)
    begins = dict(zip([p for p, _ in sizes], np.cumsum([0, *[n for _, n in sizes]]).tolist()))
    block = "shard long, slots array<long>, ids binary, n_tokens array<int>, first_doc array<long>, docs array<int>"

    def number(batches):
        """Blocks of up to ``SORTED`` sequences, parted by shard and compressed anew, so that what is shuffled stays small."""
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        slots, rows = [], []

        def flush() -> pa.RecordBatch:
            slot = np.concatenate(slots)
            order = np.argsort(slot)
            cuts = np.flatnonzero(np.diff(slot[order] // shard_sequences)) + 1
            out = []
            for own in np.split(order, cuts):
                mine = [rows[i] for i in own]
                out.append((int(slot[own[0]] // shard_sequences), slot[own].tolist(), pack.compress(b"".join(m[0] for m in mine)), *([m[k] for m in mine] for k in (1, 2, 3))))
            slots.clear()
            rows.clear()
            types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["shard", "slots", "ids", "n_tokens", "first_doc", "docs"])

        for batch in batches:
            for r in batch.to_pylist():
                raw, n = unpack.decompress(r["ids"]), len(r["n_tokens"])
                slots.append(feistel(begins[r["part"]] + r["local"] + np.arange(n), total, key))
                rows += [(raw[i * stride : (i + 1) * stride], r["n_tokens"][i], r["first_doc"][i], r["docs"][i]) for i in range(n)]
                if len(rows) >= SORTED:
                    yield flush()
        if rows:
            yield flush()

    def write(batches):
        from pyspark import TaskContext

        attempt, unpack = TaskContext.get().taskAttemptId(), zstandard.ZstdDecompressor()
        files, base = pyarrow.fs.FileSystem.from_uri(root)
        files.create_dir(base, recursive=True)
        held: dict = {}

        def close() -> pa.RecordBatch:
            shard, data, meta = held["shard"], held["data"], held["meta"]
            if any(m is None for m in meta):
                raise ValueError(f"shard {shard} isn't whole")
            made, target = f"{base}/.shard-{shard:08d}.{attempt}", f"{base}/shard-{shard:08d}.bin"
            with files.open_output_stream(made) as out:
                out.write(data)
            if files.get_file_info(target).type != pyarrow.fs.FileType.NotFound:  # a repeated task: the same bytes
                files.delete_file(target)
            files.move(made, target)
            n = len(meta)
            crc = [zlib.crc32(memoryview(data)[i * stride : (i + 1) * stride]) for i in range(n)]
            columns = [pa.array(shard * shard_sequences + np.arange(n)), pa.array([shard] * n, pa.int64()), pa.array(np.arange(n) * stride), *(pa.array([m[k] for m in meta], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32()))), pa.array(crc, pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["slot", "shard", "byte_offset", "n_tokens", "first_doc", "docs", "ids_crc32"])

        for batch in batches:
            for r in batch.to_pylist():
                if held and held["shard"] != r["shard"]:
                    yield close()
                if not held:
                    n = min(shard_sequences, total - r["shard"] * shard_sequences)
                    held.update(shard=r["shard"], data=bytearray(n * stride), meta=[None] * n)
                raw = unpack.decompress(r["ids"])
                for i, slot in enumerate(r["slots"]):
                    at = slot % shard_sequences
                    held["data"][at * stride : (at + 1) * stride] = raw[i * stride : (i + 1) * stride]
                    held["meta"][at] = (r["n_tokens"][i], r["first_doc"][i], r["docs"][i])
        if held:
            yield close()

    shards = max(1, -(-total // shard_sequences))
    placed = cut.mapInArrow(number, block).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
    done = materialise(placed.mapInArrow(write, "slot long, shard long, byte_offset long, n_tokens int, first_doc long, docs int, ids_crc32 long"), "slots")
    remove(cut)
    return done


class ShardReader:
    """Sequences of written shards in slot order, from any slot on."""

    def __init__(self, root: str, *, total: int, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES):
        self.files, self.base = pyarrow.fs.FileSystem.from_uri(root)
        self.total, self.length, self.per = total, length, shard_sequences

    def read(self, slot: int = 0):
        while slot < self.total:
            with self.files.open_input_file(f"{self.base}/shard-{slot // self.per:08d}.bin") as f:
                f.seek(slot % self.per * 2 * self.length)
                while slot < self.total and (raw := f.read(2 * self.length)):
                    yield slot, np.frombuffer(raw, "<u2")
                    slot += 1
                    if slot % self.per == 0:
                        break

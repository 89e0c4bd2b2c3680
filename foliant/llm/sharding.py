"""Immutable shards, compacted by size tiers, under a versioned manifest.

Every change writes new files and then commits a new manifest, which names all live shards. A manifest appears by renaming a
finished file to a name that must not exist yet, so readers see one version or the next, and of two writers one fails.
Files that no manifest names (from lost or repeated tasks) are never read; ``vacuum`` deletes them once no writer can
still be about to commit them: a writer announces its folder as an open intent before it writes and withdraws it after its
commit, and intents that no writer has withdrawn count as abandoned after a stated age only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES, FAN_IN, ABANDONED_S, GROUP_BYTES = 256 << 20, 4, 7 * 24 * 3600.0, 32 << 20


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardedTable:
    """A table of Parquet shards at ``root``, any path that Hadoop's file systems can reach.

    ``target_bytes``: the size that merging aims at; shards of at least half of it are final. ``fan_in``: how many runs of one
    tier wait until they are merged; tier t holds shards of up to ``target_bytes / fan_in ** t``.
    """

    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.Path(name)

    def _list(self, folder: str) -> list:
        return list(self.fs.listStatus(self._path(folder))) if self.fs.exists(self._path(folder)) else []

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        names = [x.getPath().getName() for x in self._list(f"{self.root}/manifest")]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._path(f"{self.root}/manifest/v{version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, base: dict, schema: StructType, shards: list[dict]) -> int:
        version = base["version"] + 1
        temp, final = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/v{version}.json")
        out = self.fs.create(temp, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema.jsonValue(), "shards": shards}, sort_keys=True).encode()))
        out.close()
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        context = hadoop.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else self.fs.getUri())
        never_replace = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        never_replace[0] = getattr(hadoop, "Options$Rename").NONE
        try:
            context.rename(self.fs.makeQualified(temp), self.fs.makeQualified(final), never_replace)
        except Exception as e:
            self.fs.delete(temp, False)
            if self.fs.exists(final):
                raise Conflict(f"version {version} was committed by another writer") from e
            raise
        return version

    @contextmanager
    def _intent(self) -> Iterator[str]:
        """The name of a data folder that ``vacuum`` spares until the block ends, by a commit or by giving up."""
        name = uuid.uuid4().hex
        mark = self._path(f"{self.root}/intents/{name}")
        self.fs.create(mark, False).close()
        try:
            yield name
        finally:
            self.fs.delete(mark, False)

    def _measured(self, folder: str) -> list[dict]:
        """The shards in ``folder`` with their sizes and, from their footers, their rows; without a Spark job a file."""
        files = [(x.getPath().toString(), x.getLen()) for x in self._list(folder) if x.getPath().getName().endswith(".parquet")]
        if not files:
            return []

        def footers(batches):
            for batch in batches:
                paths = batch.column("path").to_pylist()
                rows = []
                for path in paths:
                    system, place = pyarrow.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
                    with system.open_input_file(place) as f:
                        rows.append(pyarrow.parquet.read_metadata(f).num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(rows, pa.int64())], ["path", "rows"])

        named = self.spark.createDataFrame([(p,) for p, _ in files], "path string").repartition(min(len(files), 64))
        rows = {r["path"]: r["rows"] for r in named.mapInArrow(footers, "path string, rows long").collect()}
        return [{"path": p, "bytes": n, "rows": rows[p]} for p, n in files if rows[p]]

    def _written(self, df: DataFrame, name: str) -> list[dict]:
        """Write ``df`` as shards in a folder of their own and measure them; Spark's commit leaves finished tasks' files only."""
        folder = f"{self.root}/data/{name}"
        df.write.parquet(folder)
        return self._measured(folder)

    def append(self, df: DataFrame) -> int:
        """Add the rows as they come in, one small shard a task, without a shuffle. Returns the version committed.

        A task of over the target size leaves a shard of that size, which the next compaction cuts.
        """
        base = self.manifest()
        with self._intent() as name:
            return self._commit(base, df.schema, base["shards"] + self._written(df, name))

    def tier(self, size: int) -> int:
        """0 for final shards, then by powers of the fan-in down to the smallest."""
        t, limit = 0, self.target / 2
        while size < limit and t < 12:
            t, limit = t + 1, limit / self.fan_in
        return t

    def _groups(self, shards: list[dict], everything: bool) -> list[list[dict]]:
        """Shards of one tier, in order of size, cut into groups that make up about one target each; one over twice the target alone, to be cut."""
        tiers: dict[int, list[dict]] = {}
        for s in sorted(shards, key=lambda s: (s["bytes"], s["path"])):
            if (t := self.tier(s["bytes"])) > 0:
                tiers.setdefault(0 if everything else t, []).append(s)
        groups = []
        for members in tiers.values():
            group, size = [], 0
            for s in members:
                if group and size + s["bytes"] > self.target:
                    groups.append(group)
                    group, size = [], 0
                group.append(s)
                size += s["bytes"]
            groups.append(group)
        large = [[s] for s in shards if s["bytes"] > 2 * self.target and s["rows"] > 1]
        return large + [g for g in groups if len(g) >= (2 if everything else self.fan_in)]

    def _merged(self, groups: list[list[dict]], schema: StructType, name: str) -> list[dict]:
        """All groups in one job, whatever their number: a task a group streams through the row groups of its shards.

        Files are written under a name of the attempt and renamed when whole, so a repeated task leaves one file; parts of a
        group that is cut get about the target each.
        """
        kind, root, target = schema, self.root if "://" in self.root else self.root.replace("file:/", "file:///", 1), self.target
        rows = [(i, json.dumps([s["path"] for s in g]), sum(s["bytes"] for s in g), sum(s["rows"] for s in g)) for i, g in enumerate(groups)]
        todo = self.spark.createDataFrame(rows, "n int, paths string, bytes long, n_rows long").repartitionById(len(rows), "n")

        def merge(batches):
            from pyspark import TaskContext
            from pyspark.sql.pandas.types import to_arrow_schema

            attempt, arrow, held = TaskContext.get().taskAttemptId(), to_arrow_schema(kind, timestamp_utc=True), []

            def flush(out) -> None:
                out.write_table(pa.concat_tables(held))
                held.clear()

            for batch in batches:
                for job in batch.to_pylist():
                    parts = max(1, round(job["bytes"] / target)) if len(json.loads(job["paths"])) == 1 else 1
                    per, k, left, out, made = -(-job["n_rows"] // parts), 0, 0, None, []
                    for path in json.loads(job["paths"]):
                        files, place = pyarrow.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
                        with files.open_input_file(place) as f:
                            for some in pyarrow.parquet.ParquetFile(f).iter_batches(4096):
                                some = pa.Table.from_batches([some]).select(arrow.names).cast(arrow)
                                while some.num_rows:
                                    if out is None:
                                        system, base = pyarrow.fs.FileSystem.from_uri(f"{root}/data/{name}")
                                        system.create_dir(base, recursive=True)
                                        hidden, final = f"{base}/.part-{job['n']:07d}-{k:05d}.{attempt}", f"{base}/part-{job['n']:07d}-{k:05d}.parquet"
                                        out, left = pyarrow.parquet.ParquetWriter(hidden, arrow, filesystem=system, compression="snappy"), per
                                    take = some.slice(0, left)
                                    held.append(take)
                                    some, left = some.slice(take.num_rows), left - take.num_rows
                                    if not left or sum(t.nbytes for t in held) >= GROUP_BYTES:
                                        flush(out)
                                    if not left:
                                        out.close()
                                        out, k = None, k + 1
                                        made.append((hidden, final))
                    if out is not None:
                        if held:
                            flush(out)
                        out.close()
                        made.append((hidden, final))
                    for hidden, final in made:
                        replaced(system, hidden, final)
                    yield pa.RecordBatch.from_arrays([pa.array([job["n"]], pa.int32())], ["n"])

        todo.mapInArrow(merge, "n int").collect()
        return self._measured(f"{self.root}/data/{name}")

    def compact(self, *, everything: bool = False, drop: bool = False) -> int:
        """Merge tiers that hold ``fan_in`` runs or more, again and again, and commit once. ``everything``: small rests too.

        A group is one file of about the target size, written by one task that streams through its shards, so memory is bounded
        by a few thousand rows and a row group; shards over twice the target are cut. A round is one job for any number of groups. If nothing
        is to be merged, the version stays. ``drop``: delete what was replaced after the commit, for tables whose earlier versions
        nobody reads; files of other writers are never touched.
        """
        base = self.manifest()
        if not base["version"]:
            return 0
        schema, shards = StructType.fromJson(base["schema"]), base["shards"]
        if not self._groups(shards, everything):
            return base["version"]
        with self._intent() as name:
            turn, replaced_paths, named = 0, [], {s["path"] for s in shards}
            while groups := self._groups(shards, everything):
                made = self._merged(groups, schema, f"{name}/{turn}")
                gone = {s["path"] for g in groups for s in g}
                replaced_paths += gone
                shards, turn = [s for s in shards if s["path"] not in gone] + made, turn + 1
                if everything:
                    break
            version = self._commit(base, schema, shards)
            for path in replaced_paths:
                if drop or path not in named:  # what no manifest has named goes in any case
                    self.fs.delete(self._path(path), False)
            return version

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; shards are read as they are named, never by listing a folder."""
        found = self.manifest(version)
        schema = StructType.fromJson(found["schema"]) if found["schema"] else StructType()
        paths = [s["path"] for s in found["shards"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, *, abandoned_s: float = ABANDONED_S) -> int:
        """Delete files that the last version doesn't name; earlier versions can't be read afterwards. Returns how many went.

        Folders of open intents are spared, unless the intent is older than ``abandoned_s``, which must exceed the longest write.
        Intents are listed before the manifest is read: a writer that has withdrawn its intent by then has committed or given up.
        """
        now, n = time.time(), 0
        folders = {x.getPath().getName(): x.getPath() for x in self._list(f"{self.root}/data")}
        ages = {x.getPath().getName(): now - x.getModificationTime() / 1000 for x in self._list(f"{self.root}/intents")}
        live = {s["path"] for s in self.manifest()["shards"]}
        for name, folder in folders.items():
            if ages.get(name, abandoned_s + 1) <= abandoned_s:
                continue
            stack, files = [folder], []
            while stack:
                for x in self._list(stack.pop().toString()):
                    (stack if x.isDirectory() else files).append(x.getPath())
            gone = [p for p in files if p.toString() not in live]
            n += sum(p.getName().endswith(".parquet") for p in gone)
            if len(gone) == len(files):
                self.fs.delete(folder, True)
            else:
                for p in gone:
                    self.fs.delete(p, False)
            if name in ages:
                self.fs.delete(self._path(f"{self.root}/intents/{name}"), False)
        return n


def replaced(system, made: str, final: str) -> None:
    """Give the whole file ``made`` its final name; what a repeated task left there is replaced, in one step where the system can."""
    try:
        system.move(made, final)
    except OSError:
        if system.get_file_info(final).type == pyarrow.fs.FileType.NotFound:
            raise
        system.delete_file(final)
        system.move(made, final)


def shard_documents(docs: DataFrame, root: str, *, arrivals: int = 4, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> ShardedTable:
    """``docs`` as a compacted sharded table.

    The rows arrive in ``arrivals`` appends (by a hash of the whole row, so any key may be hot), each followed by a compaction of the
    tiers that are full, which deletes what it replaced; at the end the rests are merged. The table is this call's own until it
    returns. All rows and columns are kept as they are: nulls, repeated rows, texts of any length. An empty table gives a committed version without shards.
    """
    table = ShardedTable(docs.sparkSession, root, target_bytes=target_bytes, fan_in=fan_in)
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    for k in range(arrivals):
        table.append(docs.where(F.pmod(row, F.lit(arrivals)) == k))
        table.compact(drop=True)
    table.compact(everything=True, drop=True)
    return table


ORACLE = "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, lang, source, n_chars FROM documents"

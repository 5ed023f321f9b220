"""Versioned tables on any file system that Spark can write: overwrite, append, schema merge, reads of
old versions, retention. Each write is a new folder; a small log entry publishes it."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weir.sources.paths import base_path, layer_paths

#: The folder of one write; also keeps apart the partition columns of different writes.
BATCH = "weir_batch"


class TableStore:
    """``format`` is the file format; ``delta`` passes reads and writes through to that source."""

    def __init__(self, spark: SparkSession, root: str | None = None, format: str = "parquet") -> None:
        self.spark, self.root, self.format = spark, base_path(root, spark), format

    def tables(self, layer: str) -> dict[str, str]:
        """Table -> path of the tables of a layer that exist."""
        return {t: path for t, path in layer_paths(layer, self.root).items() if self.exists(t)}

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[int]:
        log = self._path(table, "_log")
        fs = self._fs(log)
        if not fs.exists(log):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(log) if s.getPath().getName().endswith(".json"))

    def entry(self, table: str, version: int) -> dict:
        path = self._path(table, "_log", f"{version:012d}.json")
        stream = self._fs(path).open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, table: str, version: int, entry: dict) -> None:
        path, draft = self._path(table, "_log", f"{version:012d}.json"), self._path(table, "_log", f".{uuid.uuid4().hex}")
        fs = self._fs(path)
        out = fs.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {table} was written by another job")

    def write(self, df: DataFrame, table: str, mode: str = "overwrite", merge_schema: bool = False, partition_by: list[str] | None = None, run_id: str = "") -> int:
        """Writes a new version and returns its number. Overwriting a table that is being read is safe,
        for old folders stay until ``vacuum``. Without ``merge_schema`` new columns raise an error on
        append; with it, the read schema is the union."""
        if self.format == "delta":
            writer = df.write.format("delta").mode(mode).option("mergeSchema", str(merge_schema).lower())
            (writer.partitionBy(*partition_by) if partition_by else writer).save(f"{self.root}/{table}")
            return 0
        have = self.versions(table)
        before = self.entry(table, have[-1]) if have else {"folders": {}, "schema": None}
        schema = df.schema
        if before["schema"] is not None and (mode == "append" or merge_schema):
            schema = merged_schema(StructType.fromJson(before["schema"]), schema, merge_schema)
        folder = f"data/{BATCH}={uuid.uuid4().hex}"
        writer = df.write.format(self.format)
        (writer.partitionBy(*partition_by) if partition_by else writer).save(f"{self.root}/{table}/{folder}")
        version = have[-1] + 1 if have else 0
        folders = {**(before["folders"] if mode == "append" else {}), folder: json.loads(nullable(df.schema).json())}
        self._publish(table, version, {"folders": folders, "schema": json.loads(nullable(schema).json()), "mode": mode, "run_id": run_id, "at": datetime.now(timezone.utc).isoformat()})
        return version

    def exists(self, table: str) -> bool:
        if self.format == "delta":
            log = self._path(table, "_delta_log")
            return self._fs(log).exists(log)
        return bool(self.versions(table))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The latest or a given version; columns that a folder lacks are null."""
        if self.format == "delta":
            reader = self.spark.read.format("delta")
            return (reader.option("versionAsOf", version) if version is not None else reader).load(f"{self.root}/{table}")
        have = self.versions(table)
        if not have or (version is not None and version not in have):
            raise FileNotFoundError(f"no such table or version: {table} {version if version is not None else ''}")
        entry = self.entry(table, have[-1] if version is None else version)
        schema = StructType.fromJson(entry["schema"])
        kinds = {f.name: f.dataType for f in schema.fields}
        plain, frames = [], []
        for folder, layout in entry["folders"].items():
            own = StructType.fromJson(layout)
            if all(f.dataType == kinds[f.name] for f in own.fields):
                plain.append(folder)
            else:
                part = self._load(table, [folder], own)
                frames.append(part.select(*[F.col(f"`{f.name}`").cast(kinds[f.name]).alias(f.name) for f in own.fields]))
        if plain:  # one scan over all folders without a change of type
            frames.insert(0, self._load(table, plain, schema))
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame, allowMissingColumns=True)
        return out.select(*[f"`{f.name}`" for f in schema.fields])

    def _load(self, table: str, folders: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.format(self.format).schema(schema).option("basePath", f"{self.root}/{table}/data").load([f"{self.root}/{table}/{f}" for f in folders])

    def last_write(self, table: str, version: int) -> DataFrame:
        """The rows that the write of ``version`` brought."""
        folder, layout = list(self.entry(table, version)["folders"].items())[-1]
        return self._load(table, [folder], StructType.fromJson(layout))

    def compact(self, table: str, files: int = 1) -> int:
        """Rewrites a table of many appends into one folder of ``files`` files."""
        return self.write(self.read(table).repartition(files), table)

    def upsert(self, changes: DataFrame, table: str, keys: list[str], run_id: str = "") -> int:
        """Replaces rows with the keys of ``changes`` and adds the new ones, as a new version."""
        if not self.exists(table):
            return self.write(changes, table, run_id=run_id)
        held = self.read(table)
        on = [held[k].eqNullSafe(changes[k]) for k in keys]
        kept = held.join(changes.select(*keys), on, "left_anti")
        return self.write(kept.unionByName(changes, allowMissingColumns=True), table, merge_schema=True, run_id=run_id)

    def vacuum(self, table: str, keep: int = 10) -> int:
        """Deletes all but the last ``keep`` versions and folders that none of these needs."""
        have = self.versions(table)
        old, kept = have[:-keep], have[-keep:]
        needed = {f for v in kept for f in self.entry(table, v)["folders"]}
        gone = {f for v in old for f in self.entry(table, v)["folders"]} - needed
        for folder in gone:
            path = self._path(table, folder)
            self._fs(path).delete(path, True)
        for v in old:
            path = self._path(table, "_log", f"{v:012d}.json")
            self._fs(path).delete(path, False)
        return len(gone)


def nullable(schema: StructType) -> StructType:
    out = StructType()
    for f in schema.fields:
        out = out.add(f.name, f.dataType, True)
    return out


def merged_schema(old: StructType, new: StructType, may_add: bool) -> StructType:
    """Old columns, then new ones. A column of two types becomes text; without ``may_add`` a new
    column or another type raises an error."""
    out, added = StructType(), {f.name: f.dataType for f in new.fields}
    for f in old.fields:
        kind = added.pop(f.name, f.dataType)
        if kind != f.dataType and not may_add:
            raise ValueError(f"{f.name} is {f.dataType.simpleString()}, not {kind.simpleString()}")
        out = out.add(f.name, f.dataType if kind == f.dataType else "string", True)
    if added and not may_add:
        raise ValueError(f"new columns: {', '.join(added)}")
    for name, kind in added.items():
        out = out.add(name, kind, True)
    return out

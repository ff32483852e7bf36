"""A store of blobs as a data source: spark.read.format("blobs") and df.write.format("blobs"), with columns name and content.

A write makes a folder of its own, with a part for each task that is done, and is published by one small file that names these
parts. What a failed task or job wrote is named nowhere and is removed when Spark aborts. Blobs are dealt to shards by their
name, so that a reader task lists its shard only and of a name that was written twice takes the last.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SHARDS = 64
SCHEMA = "name string, content binary"


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _names(files, folder: str) -> list[str]:
    from pyarrow import fs

    return [f.base_name for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True))]


def _shard(name: str) -> str:
    return f"{zlib.crc32(name.encode()) % SHARDS:02d}"


def _file(name: str) -> str:
    """A file name for any blob name: nothing in it can lead to another folder."""
    if not name:
        raise ValueError("a blob needs a name")
    return "b" + quote(name, safe="")


def _published(path: str) -> list[str]:
    """Folders of the parts that count, the oldest first."""
    files, root = _store(path)
    out = []
    for entry in sorted(n for n in _names(files, f"{root}/published") if n.endswith(".json")):
        with files.open_input_stream(f"{root}/published/{entry}") as stream:
            out += json.loads(stream.read())
    return out


@dataclass
class _Part(WriterCommitMessage):
    folder: str


@dataclass
class _Slice(InputPartition):
    shard: str
    folders: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Slice]:
        folders = _published(self.path)
        return [_Slice(f"{k:02d}", folders) for k in range(SHARDS)]

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        files, root = _store(self.path)
        last = {n: f for f in partition.folders for n in _names(files, f"{root}/{f}/{partition.shard}")}
        for name, folder in last.items():
            with files.open_input_stream(f"{root}/{folder}/{partition.shard}/{name}") as stream:
                yield pa.RecordBatch.from_arrays([pa.array([unquote(name[1:])]), pa.array([stream.read()], pa.binary())], names=["name", "content"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> _Part:
        files, root = _store(self.path)
        folder, made = f"data/{self.job}/{uuid.uuid4().hex}", set()
        for row in iterator:
            shard = f"{root}/{folder}/{_shard(row['name'])}"
            if shard not in made:
                files.create_dir(shard)
                made.add(shard)
            with files.open_output_stream(f"{shard}/{_file(row['name'])}") as stream:
                stream.write(row["content"] or b"")
        return _Part(folder)

    def commit(self, messages: list[_Part | None]) -> None:
        files, root = _store(self.path)
        files.create_dir(f"{root}/published")
        before = [n for n in _names(files, f"{root}/published") if n.endswith(".json")] if self.overwrite else []
        name = f"{time.time_ns():020d}-{self.job}"
        with files.open_output_stream(f"{root}/published/{name}.tmp") as stream:
            stream.write(json.dumps([m.folder for m in messages if m]).encode())
        files.move(f"{root}/published/{name}.tmp", f"{root}/published/{name}.json")
        for old in before:
            files.delete_file(f"{root}/published/{old}")

    def abort(self, messages: list[_Part | None]) -> None:
        files, root = _store(self.path)
        if self.job in _names(files, f"{root}/data"):
            files.delete_dir(f"{root}/data/{self.job}")


class Blobs(DataSource):
    """Option path: a folder that driver and executors share. Mode append adds, overwrite replaces all."""

    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Blobs)


def store(blobs: DataFrame, path: str, mode: str = "append") -> None:
    """Write name and content. A null content is an empty blob; a null or empty name fails the write, and nothing of it is kept. Of rows with one name in a write any may stay."""
    register(blobs.sparkSession)
    blobs.select("name", "content").write.format("blobs").option("path", path).mode(mode).save()


def load(spark: SparkSession, path: str) -> DataFrame:
    """name, content of all blobs. A folder without any gives no rows."""
    register(spark)
    return spark.read.format("blobs").option("path", path).load()


def delete(names: DataFrame, path: str) -> int:
    """Remove blobs by their name, from every write that had them; returns how many names were there. Done by the tasks that hold the names."""
    folders = _published(path)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _store(path)
        gone = 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                there = [f"{root}/{f}/{_shard(name)}/{_file(name)}" for f in folders] if name else []
                found = [i.path for i in files.get_file_info(there) if i.is_file] if there else []
                for file in found:
                    files.delete_file(file)
                gone += bool(found)
        yield pa.RecordBatch.from_arrays([pa.array([gone], pa.int64())], names=["gone"])

    return names.select("name").distinct().mapInArrow(remove, "gone long").agg({"gone": "sum"}).first()[0] or 0

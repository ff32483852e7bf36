"""Tables that are changed by rewriting the buckets a change touches and publishing a version in one step.

A version is a small file that says which folder holds each bucket. It is written aside and renamed into its place, which
fails if somebody else has published the same number. What an attempt wrote before it failed is in no version, so readers never
see it; old versions stay readable until forget() removes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class Conflict(Exception):
    """Another writer has published the version that this one was about to."""


class VersionedTable:
    """Rows with a natural key. Keys must not be null and not repeat; a change that breaks this is refused with ValueError."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    # -- versions ----------------------------------------------------------------------------------------------------------

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        return jvm, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        jvm, files = self._files()
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        if not files.exists(where):
            return []
        names = [s.getPath().getName() for s in files.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _state(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"no version {'' if version is None else version} at {self.path}")
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/versions/{known[-1] if version is None else version}.json").collect()
        return json.loads(rows[0][0])

    def _publish(self, state: dict) -> int:
        """The one step that makes a change visible."""
        jvm, files = self._files()
        path = jvm.org.apache.hadoop.fs.Path
        aside, place = path(f"{self.path}/versions/_{uuid.uuid4().hex}"), path(f"{self.path}/versions/{state['version']}.json")
        out = files.create(aside, True)
        out.write(json.dumps(state).encode())
        out.close()
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, place, plain)
        except Exception as e:
            files.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {state['version']} of {self.path} is there already") from None
            raise
        return state["version"]

    # -- rows --------------------------------------------------------------------------------------------------------------

    def _bucket(self, state: dict) -> Column:
        """The bucket of a row, by the number of buckets that the table was made with."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(state["buckets"])).cast("int")

    def _checked(self, rows: DataFrame) -> DataFrame:
        """Rows with unique keys, or an error when they are read: the change then fails before it is published."""
        faulty = rows.where(" OR ".join(f"`{k}` IS NULL" for k in self.keys)).limit(1).count() or rows.groupBy(*self.keys).count().where("count > 1").limit(1).count()
        if faulty:
            raise ValueError(f"keys {self.keys} are null or repeated")
        return rows

    def _write(self, rows: DataFrame, touched: list[int], state: dict) -> int:
        name = uuid.uuid4().hex
        rows.withColumn("bucket_no", self._bucket(state)).repartition("bucket_no").write.partitionBy("bucket_no").parquet(f"{self.path}/data/{name}")
        jvm, files = self._files()
        filled = [k for k in touched if files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{name}/bucket_no={k}"))]
        folders = {k: v for k, v in state["folders"].items() if int(k) not in touched} | {str(k): name for k in filled}
        return self._publish({**state, "version": state["version"] + 1, "folders": folders})

    def create(self, rows: DataFrame) -> int:
        """The first version."""
        if self.versions():
            raise Conflict(f"{self.path} has versions already")
        kind = rows.schema.json()
        return self._write(self._checked(rows), list(range(self.buckets)), {"version": 0, "schema": kind, "folders": {}, "keys": self.keys, "buckets": self.buckets})

    def _folder_rows(self, state: dict, touched: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self.path}/data/{name}/bucket_no={k}" for k, name in state["folders"].items() if touched is None or int(k) in touched]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        return self._folder_rows(self._state(version))

    def upsert(self, rows: DataFrame) -> DataFrame:
        """Put rows in the place of those with their keys, or beside them; returns keys and action (Created or Updated).

        Only buckets that the rows fall into are read and written. No rows publish no version.
        """
        state = self._state()
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        rows = self._checked(rows.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in schema)))
        touched = [r.b for r in rows.select(self._bucket(state).alias("b")).distinct().collect()]  # at most as many as buckets
        have = self._folder_rows(state, touched)
        known = have.select(*self.keys, F.lit(True).alias("known_before"))
        actions = rows.select(*self.keys).join(known, self.keys, "left").select(*self.keys, F.when(F.col("known_before"), "Updated").otherwise("Created").alias("action"))
        if touched:
            self._write(have.join(rows.select(*self.keys), self.keys, "left_anti").select(*schema.names).unionByName(rows), touched, state)
        return actions

    def remove(self, keys: DataFrame) -> None:
        """Take the rows with these keys out. Keys that are not there do no harm."""
        state = self._state()
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        gone = keys.select(*(F.col(k).cast(schema[k].dataType).alias(k) for k in self.keys)).distinct()
        touched = [r.b for r in gone.select(self._bucket(state).alias("b")).distinct().collect()]
        if touched:
            have = self._folder_rows(state, touched)
            self._write(have.join(gone, self.keys, "left_anti").select(*have.columns), touched, state)

    def forget(self, keep: int = 2) -> None:
        """Remove all but the last versions, and the folders that none of these needs; not while others write."""
        known = self.versions()
        needed = {name for v in known[-keep:] for name in self._state(v)["folders"].values()}
        jvm, files = self._files()
        path = jvm.org.apache.hadoop.fs.Path
        for v in known[:-keep]:
            files.delete(path(f"{self.path}/versions/{v}.json"), False)
        for status in files.listStatus(path(f"{self.path}/data")):
            if status.getPath().getName() not in needed:
                files.delete(status.getPath(), True)
